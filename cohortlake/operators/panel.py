"""Person-year panel operators over (id, yr, ...). Gaps are real: what a calendar lag means is settled by the year, never by position
unless the name says so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.quantiles import null_safe, ranked
from cohortlake.functions.scalar import arc_change


def history(id_: str = "id", year: str = "yr"):
    """The window of a person's rows by calendar year, for frames given in years."""
    return Window.partitionBy(id_).orderBy(year)


def annual_panel(orders: DataFrame) -> DataFrame:
    """id, yr, y: a customer's yearly order total, to the cent."""
    return orders.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("yr")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))


def with_age(panel: DataFrame, birth: Column, convention: int = 1) -> DataFrame:
    """yob and age = yr - yob + convention: 1 counts the birth year as the first, 0 does not."""
    return panel.withColumn("yob", birth.cast("long")).withColumn("age", F.col("yr") - F.col("yob") + convention)


def calendar_shift(panel: DataFrame, values: Sequence[str], k: int, suffix: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """The values k years on (or back, if negative); null where that year has no row. A range frame of exactly one year needs the
    panel's own sort only, where a self-join would shuffle it twice. Needs one row per (id, year)."""
    w = history(id_, year).rangeBetween(k, k)
    return panel.withColumns({f"{v}{suffix}": F.max(v).over(w) for v in values})


def calendar_self_join(panel: DataFrame, values: Sequence[str], k: int, suffix: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """The same by a left join, for panels with several rows a year."""
    other = panel.select(id_, (F.col(year) - k).alias(year), *[F.col(v).alias(f"{v}{suffix}") for v in values])
    return panel.join(other, [id_, year], "left")


def shifted(panel: DataFrame, value: str, k: int, name: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """The value k rows before (k > 0) or after."""
    w = history(id_, year)
    return panel.withColumn(name, F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w))


def filled(panel: DataFrame, value: str, name: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """Forward fill, then backward fill."""
    w = history(id_, year)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return panel.withColumn(name, F.coalesce(back, ahead))


def recent_income(panel: DataFrame, value: str = "y", floor: float = 0.0, years: int = 5, least: int = 3, name: str = "re", id_: str = "id", year: str = "yr") -> DataFrame:
    """Mean of max(value, floor) over the last `years` calendar years, where the current value reaches the floor and at least
    `least` of them do; with the number of those as nv."""
    w = history(id_, year).rangeBetween(-(years - 1), 0)
    mean, valid = F.avg(F.greatest(F.col(value), F.lit(floor))).over(w), F.count(F.when(F.col(value) >= floor, 1)).over(w)
    return panel.withColumn("nv", valid).withColumn(name, F.when((F.col(value) >= floor) & (valid >= least), mean))


def future_average(panel: DataFrame, value: str, years: int, name: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """Sum over this and the next years - 1 calendar years, over the nominal length."""
    return panel.withColumn(name, F.sum(value).over(history(id_, year).rangeBetween(0, years - 1)) / years)


def normalised(panel: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """The value over its group's mean; null keys are a group. Means come from a map-side aggregate and a join, planned by their size, so no group is sorted
    in one task."""
    means = panel.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return null_safe(panel, means, keys).withColumn(name, F.try_divide(F.col(value), F.col("_mean"))).drop("_mean")


def demeaned(panel: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    means = panel.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return null_safe(panel, means, keys).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


def arc_changes(panel: DataFrame, value: str, k: int, name: str, means: DataFrame | None = None, mean_key: str = "yr", floor: float | None = None) -> DataFrame:
    """Arc-percent change from yr to yr + k of the value over its mean by mean_key (a small table), where either side reaches the
    floor."""
    out = calendar_shift(panel, [value, *([mean_key] if mean_key != "yr" else [])], k, "_next")
    now, then = F.col(value), F.col(f"{value}_next")
    if means is not None:
        m = means.select(F.col(mean_key), F.col("mean").alias("_m0"))
        ahead = means.select((F.col(mean_key) - k).alias(mean_key), F.col("mean").alias("_m1"))
        out = out.join(F.broadcast(m), mean_key, "left").join(F.broadcast(ahead), mean_key, "left")
        now, then = now / F.col("_m0"), then / F.col("_m1")
    change = arc_change(then, now)
    if floor is not None:
        change = F.when((F.col(value) >= floor) | (F.col(f"{value}_next") >= floor), change)
    return out.withColumn(name, change).drop(f"{value}_next", "_m0", "_m1")


def transitions(panel: DataFrame, flag: str, step: int = 1, id_: str = "id", year: str = "yr") -> DataFrame:
    """entry (0 to 1) and exit (1 to 0) against the flag `step` years before; null over a gap."""
    out = calendar_shift(panel, [flag], -step, "_before", id_, year)
    before = F.col(f"{flag}_before")
    known = before.isNotNull()
    return out.withColumn("entry", F.when(known, ((before == 0) & (F.col(flag) == 1)).cast("int"))).withColumn("exit", F.when(known, ((before == 1) & (F.col(flag) == 0)).cast("int"))).drop(f"{flag}_before")


def spells_cleaned(panel: DataFrame, value: str, name: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """A value between two equal others takes theirs."""
    w = history(id_, year)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return panel.withColumn(name, F.when((before == after) & (before != F.col(value)), before).otherwise(F.col(value)))


def anchored_age(panel: DataFrame, age: str, name: str, id_: str = "id", year: str = "yr") -> DataFrame:
    """Ages recounted from the person's last row."""
    everyone = Window.partitionBy(id_)
    return panel.withColumn(name, F.max_by(age, year).over(everyone) - F.max(year).over(everyone) + F.col(year))


def employers(items: DataFrame, rank: int = 3) -> DataFrame:
    """id, yr, ein1..: the employers with the largest sums of a person-year (id, yr, ein, amount)."""
    sums = items.groupBy("id", "yr", "ein").agg(F.round(F.sum("amount"), 2).alias("amount"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("id", "yr").orderBy(F.desc("amount"), "ein"))).filter(F.col("k") <= rank)
    columns = [F.max(F.when(F.col("k") == k, F.col("ein"))).alias(f"ein{k}") for k in range(1, rank + 1)]
    return top.groupBy("id", "yr").agg(*columns, F.max(F.when(F.col("k") == 1, F.col("amount"))).alias("amount1"), F.sum("amount").alias("amount_all"))


def paid_jobs(items: DataFrame, selfinc: DataFrame, rank: int = 3) -> DataFrame:
    """id, yr, ein1.., wage1.., wage, labor, selfinc: the best-paid employers of a person-year (id, yr, ein, amount), all its wages, and
    labor income with two thirds of self-employment income (id, yr, selfinc)."""
    sums = items.groupBy("id", "yr", "ein").agg(F.round(F.sum("amount"), 2).alias("amount"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("id", "yr").orderBy(F.desc("amount"), "ein")))
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    ranks = range(1, rank + 1)
    out = top.groupBy("id", "yr").agg(*[at("ein", k).alias(f"ein{k}") for k in ranks], *[at("amount", k).alias(f"wage{k}") for k in ranks], F.sum("amount").alias("wage"))
    return out.join(selfinc, ["id", "yr"]).select("*", (F.col("wage") + F.col("selfinc") * 2 / 3).alias("labor")).select(*out.columns, "labor", "selfinc")


def stayers(jobs: DataFrame, method: str = "any") -> DataFrame:
    """stayer: the main employer of yr is also one of the employers of the years around it.
    any: among the employers of yr - 1 and yr + 1; strict: the main one in both; share: as any, with half of all pay from it."""
    names = [c for c in jobs.columns if c.startswith("ein")]
    packed = jobs.withColumn("all_", F.array(*names))
    both = calendar_shift(calendar_shift(packed, ["all_", "ein1"], -1, "_b"), ["all_", "ein1"], 1, "_a")
    inside = F.array_contains("all__b", F.col("ein1")) & F.array_contains("all__a", F.col("ein1"))
    test = {"any": inside, "strict": (F.col("ein1_b") == F.col("ein1")) & (F.col("ein1_a") == F.col("ein1")), "share": inside & (F.col("amount1") >= 0.5 * F.col("amount_all"))}[method]
    known = F.col("ein1_b").isNotNull() & F.col("ein1_a").isNotNull()
    return both.withColumn("stayer", F.when(known, F.coalesce(test, F.lit(False)).cast("int"))).drop("all_", "all__b", "all__a", "ein1_b", "ein1_a")


def pair_stayers(jobs: DataFrame, method: str, floor: float = 0.0) -> DataFrame:
    """stay of the pair (yr, yr + 1), where both years have a main employer. jobs: id, yr, ein1..3 and wage1..3 in order of pay, wage
    (all), labor, selfinc.

    I: a switcher has another main employer, each paying half of its year's wages or more, and each absent from the other year's
    next two employers or paying there less than a quarter of the other's main wage; all others stay. II: one main employer from
    yr - 1 to yr + 2. IIv2: the same main employer, paying four fifths of labor income in both years, among the three of yr - 1 and
    of yr + 2, with self-employment income below the floor or a tenth of labor income."""
    names = [*(f"ein{k}" for k in (1, 2, 3)), *(f"wage{k}" for k in (1, 2, 3)), "wage", "labor", "selfinc"]
    out = calendar_shift(calendar_shift(calendar_shift(jobs, names, 1, "_n"), names[:3], -1, "_b"), names[:3], 2, "_a")
    c = F.col

    def apart(own: str, other: str) -> Column:
        """The main employer of one side against the second and third of the other."""
        main, pay = c(f"ein1{own}"), c(f"wage1{own}")
        among = [c(f"ein{k}{other}") for k in (2, 3)]
        neither = ~main.eqNullSafe(among[0]) & ~main.eqNullSafe(among[1])
        little = [main.eqNullSafe(e) & F.coalesce(c(f"wage{k}{other}") < 0.25 * pay, F.lit(False)) for k, e in zip((2, 3), among)]
        return neither | little[0] | little[1]

    same = c("ein1") == c("ein1_n")
    if method == "I":
        half = (c("wage1") / c("wage") >= 0.5) & (c("wage1_n") / c("wage_n") >= 0.5)
        test = ~(~same & F.coalesce(half, F.lit(False)) & apart("", "_n") & apart("_n", ""))
    elif method == "II":
        test = same & (c("ein1_b") == c("ein1")) & (c("ein1_n") == c("ein1_a"))
    else:
        most = (c("wage1") / c("labor") >= 0.8) & (c("wage1_n") / c("labor_n") >= 0.8)
        seen = F.array_contains(F.array("ein1_b", "ein2_b", "ein3_b"), c("ein1")) & F.array_contains(F.array("ein1_a", "ein2_a", "ein3_a"), c("ein1_n"))
        paid = (c("selfinc") < F.greatest(F.lit(floor), 0.1 * c("labor"))) & (c("selfinc_n") < F.greatest(F.lit(floor), 0.1 * c("labor_n")))
        test = same & most & seen & paid
    known = c("ein1").isNotNull() & c("ein1_n").isNotNull()
    return out.withColumn("stay", F.when(known, F.coalesce(test, F.lit(False)).cast("int"))).select(*jobs.columns, "stay")


def growth_blocks(panel: DataFrame, blocks: Sequence[tuple[int, int]], value: str = "y", id_: str = "id", age: str = "age") -> DataFrame:
    """id and g_<from>_<to>: the log growth between the first and the last age of each block, null where either is missing."""
    at = lambda k: F.max(F.when(F.col(age) == k, F.col(value)))
    return panel.groupBy(id_).agg(*[(F.ln(at(b)) - F.ln(at(a))).alias(f"g_{a}_{b}") for a, b in blocks])


def lifetime_at_ages(panel: DataFrame, ages: Sequence[int], floor: float, least: int, value: str = "y", id_: str = "id", age: str = "age") -> DataFrame:
    """id, lt, emp and y<age> at chosen ages, with the floor put under them; persons below `least` years are left out."""
    at = [F.max(F.when(F.col(age) == k, F.greatest(F.col(value), F.lit(floor)))).alias(f"y{k}") for k in ages]
    sums = panel.groupBy(id_).agg(F.avg(F.greatest(F.col(value), F.lit(floor))).alias("lt"), F.count(F.when(F.col(value) >= floor, 1)).alias("emp"), *at)
    return sums.filter(F.col("emp") >= least)


def lifetime_income(panel: DataFrame, floor: float, least: int, value: str = "y", id_: str = "id") -> DataFrame:
    """id, lt, emp: mean of max(value, floor) and years at or above it; lt is null with fewer than `least`."""
    out = panel.groupBy(id_).agg(F.avg(F.greatest(F.col(value), F.lit(floor))).alias("lt"), F.count(F.when(F.col(value) >= floor, 1)).alias("emp"))
    return out.withColumn("lt", F.when(F.col("emp") >= least, F.col("lt")))


def autocovariances(panel: DataFrame, value: str, key: str, max_lag: int | None = None, id_: str = "id") -> DataFrame:
    """key_a <= key_b, n, cov, corr over persons seen at both: a join of the panel with itself by person, reduced in the map tasks."""
    a = panel.filter(F.col(value).isNotNull()).select(id_, F.col(key).alias("key_a"), F.col(value).alias("a"))
    b = panel.filter(F.col(value).isNotNull()).select(id_, F.col(key).alias("key_b"), F.col(value).alias("b"))
    pairs = a.join(b, id_).filter("key_a <= key_b" + (f" and key_b - key_a <= {max_lag}" if max_lag is not None else ""))
    return pairs.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("a", "b").alias("cov"), F.corr("a", "b").alias("corr"))


def leading(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, k: int) -> DataFrame:
    """keys, leading: the values at the first k places of each group. Only they leave the sort, which keeps k rows a group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.withColumn("_k", place).filter(F.col("_k") <= k)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value]).alias("leading"))


def rank_matched(left: DataFrame, right: DataFrame, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each left row gets the right value of its own rank (1 is the least) within keys."""
    a = ranked(left, keys, [value, "id"]).drop("_n")
    b = ranked(right, keys, [name]).select(*keys, "_k", name)
    return a.join(b, [*keys, "_k"], "left").drop("_k")


def mapped_bins(df: DataFrame, bin_: str, groups: Mapping[int, tuple[int, int]], name: str) -> DataFrame:
    """Coarse groups of fine bins: group -> inclusive (first, last)."""
    out = None
    for g, (a, b) in groups.items():
        out = F.when(F.col(bin_).between(a, b), F.lit(g)) if out is None else out.when(F.col(bin_).between(a, b), F.lit(g))
    return df.withColumn(name, out)
