"""Growth of persons' incomes by recent income and age, from one array of years per person.

A panel (id, yr, yob and incomes) becomes one row a person by one aggregate that combines in the map tasks. Base years t, horizons and
averages over coming years are expressions in the arrays. Of each base year the persons stay who are `begin` or older in t - 1 and
`retire` or younger in t + 1. Recent income is the mean of max(y, floor) over the years seen in t - 5..t - 1, where income in t - 1
and at least `least` of those years reach the floor; persons are ranked within year and age group by its log less the log of its mean
at their age. Means by age are over the persons that are left then. Statistics come for every group, for its age group (bin null)
and for the year (both null), in one pass: a value goes to its three groups, which are told apart null-safely.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import moments as mo
from cohortlake.functions import quantiles as qu
from cohortlake.functions.scalar import arc_change
from cohortlake.operators.panel import pair_stayers
from cohortlake.session import staged

BEGIN, RETIRE = 25, 60


def person_arrays(panel: DataFrame, years: Sequence[int], values: Sequence[str] = ("y",)) -> DataFrame:
    """id, yob and for each value an array over the years, null where the person has no row."""
    at = lambda v: F.array(*[F.max(F.when(F.col("yr") == t, F.col(v))) for t in years]).alias(v)
    return panel.groupBy("id").agg(F.max("yob").alias("yob"), *map(at, values))


def at_base(value: str, k: int, first: int) -> Column:
    """The value in t + k."""
    return F.get(value, (F.col("base") - first + k).cast("int"))


def five_year_bins(age: Column, begin: int = BEGIN, retire: int = RETIRE) -> Column:
    """Groups of five years from `begin`; the last one takes the retirement age in."""
    return F.least(F.floor((age - begin) / 5) + 1, F.lit((retire - begin) // 5)).cast("long")


def eligible(persons: DataFrame, base_years: Sequence[int], begin: int = BEGIN, retire: int = RETIRE) -> DataFrame:
    """One row per person and base year, with the age in t - 1."""
    rows = persons.withColumn("base", F.explode(F.array(*map(F.lit, base_years)).cast("array<bigint>"))).withColumn("age", F.col("base") - F.col("yob"))
    return rows.filter((F.col("age") >= begin) & (F.col("age") + 2 <= retire))


def recent(floor: float, least: int, first: int, value: str = "y", years: int = 5) -> Column:
    past = [at_base(value, -k, first) for k in range(1, years + 1)]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    valid = total([F.coalesce((p >= floor).cast("int"), F.lit(0)) for p in past])
    seen = total([p.isNotNull().cast("int") for p in past])
    amount = total([F.when(p.isNotNull(), F.greatest(p, F.lit(floor))).otherwise(0.0) for p in past])
    return F.when((past[0] >= floor) & (valid >= least), amount / seen)


def base_people(persons: DataFrame, first: int, base_years: Sequence[int], floor: float, least: int, ahead: Sequence[int], values: Sequence[str] = ("y",), begin: int = BEGIN, retire: int = RETIRE) -> DataFrame:
    """id, base, age, agebin, re and <value><k> in t + k for 0 and each k of ahead; persons with recent income only."""
    columns = [at_base(v, k, first).alias(f"{v}{k}") for v in values for k in sorted({0, *ahead})]
    rows = eligible(persons, base_years, begin, retire).withColumn("re", recent(floor, least, first)).filter("re is not null")
    return rows.select("id", "base", "age", five_year_bins(F.col("age"), begin, retire).alias("agebin"), "re", *columns)


def log_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def with_means(rows: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = ("base", "age")) -> DataFrame:
    """rows with m_<name>, the mean of each value over year and age."""
    means = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{k}") for k, c in values.items()])
    return qu.null_safe(rows, means, keys)


def change_measures(horizons: Sequence[int], floor: float, value: str = "y", own: str = "y") -> tuple[dict[str, Column], dict[str, Column]]:
    """(values whose means by age are needed, measures). log<h>: the log change less its mean, where the own income (which ranks
    persons) reaches the floor in t and a third of it in t + h; arc<h>: the arc change of incomes over their means, where the own
    income reaches the floor in either year."""
    c = F.col
    name = "" if value == own else f"_{value}"
    need = {f"{value}{k}": c(f"{value}{k}") for k in (0, *horizons)} | {f"log{name}{h}": log_ratio(c(f"{value}{h}"), c(f"{value}0")) for h in horizons}
    found = {}
    for h in horizons:
        now, then = c(f"{own}0"), c(f"{own}{h}")
        found[f"log{name}{h}"] = F.when((then >= floor / 3) & (now >= floor), need[f"log{name}{h}"] - c(f"m_log{name}{h}"))
        found[f"arc{name}{h}"] = F.when((then >= floor) | (now >= floor), arc_change(c(f"{value}{h}") / c(f"m_{value}{h}"), c(f"{value}0") / c(f"m_{value}0")))
    return need, found


def coming_measures(lengths: Sequence[int], floor: float) -> tuple[dict[str, Column], dict[str, Column]]:
    """next<n>: the log of mean income (with the floor under it) over t..t + n - 1, less the log of that mean at the age and less the
    residual recent income. The mean divides by n whatever is missing; one year needs its income, longer ones count zero without any."""
    floored = lambda k: F.when(F.col(f"y{k}").isNotNull(), F.greatest(F.col(f"y{k}"), F.lit(floor)))
    need = {f"next{n}": floored(0) if n == 1 else reduce(lambda a, b: a + b, [F.coalesce(floored(k), F.lit(0.0)) for k in range(n)]) / n for n in lengths}
    return need, {k: F.when(v > 0, F.ln(v) - F.ln(F.col(f"m_{k}"))) - F.col("residual") for k, v in need.items()}


def ranked_people(rows: DataFrame, need: Mapping[str, Column], groups: int) -> DataFrame:
    """rows with means by age, residual recent income and its percentile group (bin) within year and age group."""
    kept = staged(rows, "base-people")
    placed = with_means(kept, {"re": F.col("re"), **need}).withColumn("residual", F.ln("re") - F.ln("m_re"))
    return qu.xtile(placed, ["base", "agebin"], "residual", groups, "bin")


def described(rows: DataFrame, measures: Mapping[str, Column], keys: Sequence[str], percentiles: Sequence[float], totals: bool = True) -> DataFrame:
    """keys, measure, n, moments, extremes and percentiles of each measure. keys: the first is kept in the totals; with totals the
    others leave one by one from the last, null in their place."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("g")) for k, v in measures.items()]))
    long = rows.select(*keys, values.alias("_m")).select(*keys, "_m.*").filter("g is not null")
    if totals:
        kinds = dict(long.dtypes)
        level = lambda n: F.struct(*[(F.col(k) if i < n else F.lit(None).cast(kinds[k])).alias(k) for i, k in enumerate(keys)])
        long = long.select("measure", "g", F.explode(F.array(*[level(n) for n in range(len(keys), 0, -1)])).alias("_k")).select("measure", "g", "_k.*")
    g = F.col("g")
    extra = [c.alias(k) for k, c in (mo.raw(g) | {"min": F.min(g), "max": F.max(g)}).items()]
    return qu.group_percentiles(long, [*keys, "measure"], "g", percentiles, extra=extra)


def growth_statistics(panel: DataFrame, years: Sequence[int], base_years: Sequence[int], floor: float, least: int = 3, horizons: Sequence[int] = (1, 5), lengths: Sequence[int] = (1, 3, 5), groups: int = 100, percentiles: Sequence[float] = qu.FIFTEEN) -> DataFrame:
    """base, agebin, bin, measure and statistics of log and arc changes from t and of coming averages. panel: id, yr, yob, y."""
    changes, coming = change_measures(horizons, floor), coming_measures(lengths, floor)
    ahead = {*horizons, *range(max(lengths, default=1))}
    people = base_people(person_arrays(panel, years), years[0], base_years, floor, least, sorted(ahead))
    rows = ranked_people(people, changes[0] | coming[0], groups)
    return described(rows, changes[1] | coming[1], ["base", "agebin", "bin"], percentiles)


def total_income_statistics(panel: DataFrame, years: Sequence[int], base_years: Sequence[int], floor: float, least: int = 3, horizons: Sequence[int] = (1, 5), groups: int = 100, percentiles: Sequence[float] = qu.FIFTEEN) -> DataFrame:
    """The same of changes in total income, for persons ranked and chosen by labour income. panel: id, yr, yob, y (labour), total."""
    need, measures = change_measures(horizons, floor, "total")
    people = base_people(person_arrays(panel, years, ("y", "total")), years[0], base_years, floor, least, horizons, ("y", "total"))
    return described(ranked_people(people, need, groups), measures, ["base", "agebin", "bin"], percentiles)


def growth_by_age(panel: DataFrame, years: Sequence[int], base_years: Sequence[int], floor: float, horizons: Sequence[int] = (1, 5), percentiles: Sequence[float] = qu.FIFTEEN) -> DataFrame:
    """base, age, measure and statistics of log and arc changes, whatever income was before t."""
    need, measures = change_measures(horizons, floor)
    columns = [at_base("y", k, years[0]).alias(f"y{k}") for k in (0, *horizons)]
    rows = staged(eligible(person_arrays(panel, years), base_years).select("base", "age", *columns), "people-by-age")
    return described(with_means(rows, need), measures, ["base", "age"], percentiles)


def income_dispersion(panel: DataFrame, years: Sequence[int], at_years: Sequence[int], floor: float, least: int = 3, begin: int = BEGIN, retire: int = RETIRE) -> DataFrame:
    """year, age, n, mean, mean_log, sd_log of incomes in a year for persons of working age who reach the floor in it and are attached:
    in `least` of it and the four years before, or up to age begin + 1 in `least` of it and the two years after."""
    persons = person_arrays(panel, years)
    rows = persons.withColumn("year", F.explode(F.array(*map(F.lit, at_years)).cast("array<bigint>"))).withColumn("age", F.col("year") - F.col("yob") + 1)
    at = lambda k: F.get("y", (F.col("year") - years[0] + k).cast("int"))
    reach = lambda ks: reduce(lambda a, b: a + b, [F.coalesce((at(k) >= floor).cast("int"), F.lit(0)) for k in ks])
    attached = F.when(F.col("age") > begin + 1, reach(range(-4, 1))).otherwise(reach(range(3)))
    rows = rows.filter(F.col("age").between(begin, retire) & (at(0) >= floor) & (attached >= least)).select("year", "age", at(0).alias("y"))
    return rows.groupBy("year", "age").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.avg(F.ln("y")).alias("mean_log"), F.stddev_samp(F.ln("y")).alias("sd_log"))


#: Last ages of the three age groups of stayers' statistics.
STAYER_AGES = (35, 45, 55)


def stayer_statistics(panel: DataFrame, jobs: DataFrame, years: Sequence[int], base_years: Sequence[int], floor: float, least: int = 3, method: str = "IIv2", groups: int = 100, percentiles: Sequence[float] = qu.FIFTEEN) -> DataFrame:
    """base, agebin (of three), bin, stay, measure and statistics of the log change from t to t + 1 over the age profile, less its
    mean at the age, for stayers (1) and switchers (0) of pair_stayers. Persons reach the floor in both years and have a main
    employer in both. Recent income is ranked over the profile of the ages it spans, in groups of five years from begin + 1 on, of
    which the first takes in `begin`. panel: id, yr, yob, age, y."""
    profile = staged(panel.filter(F.col("age").between(BEGIN, RETIRE)).groupBy("age").agg(F.avg("y").alias("_dummy")), "profile")
    spans = profile.select("age", F.ln(F.avg("_dummy").over(Window.orderBy("age").rangeBetween(-4, 0))).alias("_profile"))  # a row an age
    people = base_people(person_arrays(panel, years), years[0], base_years, floor, least, (1,))
    group = F.least(F.greatest(F.floor((F.col("age") - BEGIN - 1) / 5) + 1, F.lit(1)), F.lit((RETIRE - BEGIN) // 5)).cast("long")
    people = people.join(spans, "age").select("id", "base", "age", group.alias("agebin"), "y0", "y1", (F.ln("re") - F.col("_profile")).alias("residual"))
    ranked = qu.xtile(people, ["base", "agebin"], "residual", groups, "bin")
    kinds = pair_stayers(jobs, method, floor).filter("stay is not null").select("id", F.col("yr").alias("base"), F.col("stay").cast("long").alias("stay"))
    wide = F.when(F.col("age") <= STAYER_AGES[0], 1).when(F.col("age") <= STAYER_AGES[1], 2).when(F.col("age") <= STAYER_AGES[2], 3).cast("long")
    rows = ranked.filter((F.col("y0") >= floor) & (F.col("y1") >= floor)).withColumn("agebin", wide).filter("agebin is not null").join(kinds, ["id", "base"])
    dummies = [profile.select((F.col("age") - k).alias("age"), F.col("_dummy").alias(f"_d{k}")) for k in (1, 2)]
    rows = rows.join(dummies[0], "age").join(dummies[1], "age").withColumn("change", F.ln(F.col("y1") / F.col("_d2")) - F.ln(F.col("y0") / F.col("_d1")))
    rows = with_means(staged(rows.select("base", "age", "agebin", "bin", "stay", "change"), "stayers"), {"change": F.col("change")})
    return described(rows, {"log1": F.col("change") - F.col("m_change")}, ["base", "agebin", "bin", "stay"], percentiles, totals=False)
