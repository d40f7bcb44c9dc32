"""Pipelines over long panels: cross-sectional change statistics, impulse responses, the toolbox summaries and lifecycle profiles. Base
years are a column, not a loop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import moments as mo
from cohortlake.functions import quantiles as qu
from cohortlake.functions.scalar import age_bin, arc_change
from cohortlake.operators import panel as pn
from cohortlake.session import staged


def base_rows(panel: DataFrame, base_years: Sequence[int], ahead: Sequence[int], floor: float, least: int, bins: Column | None = None, begin: int = 25, retire: int = 60) -> DataFrame:
    """One row per person and base year t, at yr = t - 1, staged: recent income re over t-5..t-1 (which the change after t does not
    touch), the age group, y0 (income in t) and y<h> (in t + h). Persons are `begin` or older then, and `retire` or younger in t + 1."""
    w = pn.history()
    at = lambda k: F.max("y").over(w.rangeBetween(k, k))
    rows = pn.recent_income(panel, "y", floor, 5, least).withColumns({"y0": at(1)} | {f"y{h}": at(1 + h) for h in ahead})
    rows = rows.filter((F.col("yr") + 1).isin(list(base_years)) & F.col("re").isNotNull() & F.col("age").between(begin, retire - 2))
    return staged(rows.withColumn("agebin", bins if bins is not None else age_bin(F.col("age"))), "base-rows")


def change_statistics(panel: DataFrame, base_years: Sequence[int], horizons: Sequence[int] = (1, 5), floor: float = 0.0, least: int = 3, groups: int = 100, measure: str = "arc", percentiles: Sequence[float] = qu.FIFTEEN, bin_column: Column | None = None) -> DataFrame:
    """horizon, agebin, bin, moments and percentiles of income changes from t to t + horizon, averaged over base years t.

    panel: id, yr, age, y. Persons are grouped within year and age group by the log of recent income before t less the log of
    its mean at their age. measure: arc (both incomes over their means at the age, where either reaches the floor) or log (the log
    change less its mean at the age, where the income in t reaches the floor and the later one a third of it)."""
    rows = base_rows(panel, base_years, horizons, floor, least, bin_column)
    ages = ["yr", "age"]
    changes = {h: F.when((F.col("y0") > 0) & (F.col(f"y{h}") > 0), F.ln(F.col(f"y{h}") / F.col("y0"))) for h in horizons}
    means = [F.avg("re").alias("m_re"), F.avg("y0").alias("m0"), *[F.avg(f"y{h}").alias(f"m{h}") for h in horizons], *[F.avg(c).alias(f"c{h}") for h, c in changes.items()]]
    rows = qu.null_safe(rows, rows.groupBy(*ages).agg(*means), ages).withColumn("residual", F.ln("re") - F.ln("m_re"))
    for h in horizons:
        then = F.col(f"y{h}")
        if measure == "log":
            value = F.when((then >= floor / 3) & (F.col("y0") >= floor), changes[h] - F.col(f"c{h}"))
        else:
            value = F.when((then >= floor) | (F.col("y0") >= floor), arc_change(then / F.col(f"m{h}"), F.col("y0") / F.col("m0")))
        rows = rows.withColumn(f"g{h}", value)
    binned = qu.xtile(rows, ["yr", "agebin"], "residual", groups, "bin")
    long = binned.unpivot(["yr", "agebin", "bin"], [f"g{h}" for h in horizons], "_h", "g").filter("g is not null").withColumn("horizon", F.substring("_h", 2, 3).cast("long"))
    cell = ["horizon", "yr", "agebin", "bin"]
    g = F.col("g")
    stats = mo.raw(g) | {"min": F.min(g), "max": F.max(g)}
    by_year = qu.group_percentiles(long, cell, "g", percentiles, extra=[c.alias(k) for k, c in stats.items()])
    return by_year.groupBy("horizon", "agebin", "bin").agg(*[F.avg(k).alias(k) for k in [*stats, *map(qu.name_of, percentiles)]])


#: Last percentiles of the income groups, and of the shock groups after the mass point.
INCOME_EDGES = (5, 10, 30, 50, 70, 90, 95, 100)
SHOCK_EDGES = (2, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 98, 100)


def edge_group(fine: Column, edges: Sequence[float]) -> Column:
    """Place (from 1) of the first edge that a percentile does not exceed."""
    return reduce(lambda a, b: a + b, [F.coalesce((fine > e).cast("long"), F.lit(0)) for e in edges[:-1]], F.lit(1).cast("long"))


def impulse_statistics(panel: DataFrame, base_years: Sequence[int], floor: float, income_edges: Sequence[float] = INCOME_EDGES, shock_edges: Sequence[float] = SHOCK_EDGES, horizons: Sequence[int] = (1, 2, 3, 5, 10), mass: float = -1.99, young: int = 34, least: int = 3, centre: str = "mean", fine: int = 100) -> DataFrame:
    """agebin, inc, chg, n, impact, f<h>, min, max: shocks are arc changes from t - 1 to t, responses those from t - 1 to t + h, of
    incomes over their mean or median (centre) at the age. Income groups are percentile groups within year and age group of the
    log of recent income less the log of its age profile (mean incomes by age, over the same five ages); shock group 1 is the
    mass point, the others are percentile groups of the rest, over all base years."""
    profile = panel.groupBy("age").agg(F.avg("y").alias("m"))  # one row per age
    trailing = profile.select("age", F.ln(F.avg("m").over(Window.orderBy("age").rangeBetween(-4, 0))).alias("profile"))
    bins = F.when(F.col("age") <= young, 1).otherwise(2).cast("long")
    rows = base_rows(panel, base_years, horizons, floor, least, bins).filter("y > 0").join(trailing, "age").withColumn("residual", F.ln("re") - F.col("profile"))
    values = ["y", "y0", *[f"y{h}" for h in horizons]]
    ages = ["yr", "age"]
    if centre == "mean":
        centres = rows.groupBy(*ages).agg(*[F.avg(v).alias(f"m_{v}") for v in values])
    else:
        long = rows.unpivot(ages, values, "_v", "_x").filter("_x is not null")
        middle = qu.group_percentiles(long, [*ages, "_v"], "_x", (50,))
        centres = middle.groupBy(*ages).agg(*[F.max(F.when(F.col("_v") == v, F.col("p50"))).alias(f"m_{v}") for v in values])
    over = lambda v: F.col(v) / F.col(f"m_{v}")
    rows = qu.null_safe(rows, centres, ages).withColumns({"shock": arc_change(over("y0"), over("y"))} | {f"f{h}": arc_change(over(f"y{h}"), over("y")) for h in horizons})
    rows = qu.xtile(rows, ["yr", "agebin"], "residual", fine, "_fine").withColumn("inc", edge_group(F.col("_fine") * 100 / fine, income_edges)).filter("shock is not null")
    rows = rows.withColumn("_left", F.when(F.col("shock") > mass, F.col("shock")))
    rows = qu.xtile(rows, ["agebin", "inc"], "_left", fine, "_fine").withColumn("chg", F.when(F.col("shock") <= mass, F.lit(1)).otherwise(1 + edge_group(F.col("_fine") * 100 / fine, shock_edges)).cast("long"))
    return rows.groupBy("agebin", "inc", "chg").agg(F.count(F.lit(1)).alias("n"), F.avg("shock").alias("impact"), *[F.avg(f"f{h}").alias(f"f{h}") for h in horizons], F.min("shock").alias("min"), F.max("shock").alias("max"))


def representative_changes(panel: DataFrame, keys: Sequence[str], k: int, value: str = "y") -> DataFrame:
    """keys, n, rep: log of the mean at t + k less log of the mean at t, over persons seen at both."""
    seen = pn.calendar_shift(panel, [value], k, "_next").filter(F.col(f"{value}_next").isNotNull())
    return seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.ln(F.avg(f"{value}_next")) - F.ln(F.avg(value))).alias("rep"))


def toolbox(panel: DataFrame, cohorts: Sequence[int], ages: Sequence[int], sexes: Sequence[int]) -> DataFrame:
    """cohort, age, sex, n and level and log statistics, with inverted-CDF percentiles."""
    rows = panel.filter(F.col("COHORT").isin(list(cohorts)) & F.col("AGE").isin(list(ages)) & F.col("SEX").isin(list(sexes)))
    keys = ["COHORT", "AGE", "SEX"]
    x, l = F.col("REAL_WAGE"), F.col("LOG_WAGE")
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(l).alias("mean_log"), F.stddev_samp(l).alias("sd_log"), mo.skew_unbiased_safe(l).alias("skew_log"), mo.kurt_unbiased_safe(l).alias("kurt_log"))
    cuts = qu.group_percentiles(rows, keys, "REAL_WAGE", (10, 25, 50, 75, 90, 98), "inverted")
    return stats.join(cuts, keys)


def toolbox_changes(panel: DataFrame, horizons: Sequence[int] = (1, 5)) -> DataFrame:
    """COHORT, AGE, SEX, h, sd, skew, kurt of positional arc changes (x 200)."""
    w = Window.partitionBy("ID").orderBy("YEAR")
    lagged = panel.select("COHORT", "AGE", "SEX", *[arc_change(F.col("REAL_WAGE"), F.lag("REAL_WAGE", h).over(w), 200.0).alias(f"arc{h}") for h in horizons])
    long = lagged.select("COHORT", "AGE", "SEX", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"arc{h}").alias("arc")) for h in horizons])).alias("r")).select("COHORT", "AGE", "SEX", "r.*")
    return long.groupBy("COHORT", "AGE", "SEX", "h").agg(F.count("arc").alias("n"), *[c.alias(k) for k, c in mo.arc(F.col("arc")).items()])


def age_changes(panel: DataFrame, horizons: Sequence[int] = (1, 5), least: int = 3) -> DataFrame:
    """h, age, n, sd, skew, kurt: population moments of arc changes over h calendar years of income over its mean at the age, for ages
    with at least `least` changes."""
    v = pn.normalised(panel, "y", ["age"], "v")
    for h in horizons:
        v = pn.calendar_shift(v, ["v"], h, f"_{h}").withColumn(f"g{h}", arc_change(F.col(f"v_{h}"), F.col("v")))
    long = v.unpivot(["age"], [f"g{h}" for h in horizons], "_h", "g").filter("g is not null").withColumn("h", F.substring("_h", 2, 3).cast("long"))
    stats = [F.count("g").alias("n"), *[c.alias(k) for k, c in mo.population(F.col("g")).items()]]
    return long.groupBy("h", "age").agg(*stats).filter(F.col("n") >= least)


def lifecycle_profile(panel: DataFrame, edges: Sequence[float], ages: Sequence[int], floor: float, least: int = 1) -> DataFrame:
    """le_group, age, n, mean: persons in groups of lifetime income by the rank's share of 100, and mean income at chosen ages."""
    life = pn.lifetime_income(panel, floor, least).filter("lt is not null")
    grouped = qu.rank_bins(life, [], ["lt", "id"], edges, "le_group").select("id", "le_group")
    return panel.filter(F.col("age").isin(list(ages))).join(grouped, "id").groupBy("le_group", "age").agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(F.col("y"), F.lit(floor))).alias("mean"))


def toolbox_impulse(panel: DataFrame, horizons: Sequence[int] = (1, 2, 3, 5, 10), floor: float = 0.0, young: int = 34, income_groups: int = 8, shock_groups: int = 23) -> DataFrame:
    """age_group, inc, chg, h, n, response: positional past change sets the shock group, changes over the next h rows respond. The past
    change and the responses have names of their own. panel: ID, YEAR, AGE, REAL_WAGE."""
    w = Window.partitionBy("ID").orderBy("YEAR")
    x = F.col("REAL_WAGE")
    recent = F.avg(F.greatest(x, F.lit(floor))).over(w.rowsBetween(-4, 0))
    rows = panel.withColumn("re", recent).withColumn("past", arc_change(x, F.lag(x, 1).over(w), 200.0))
    rows = rows.withColumns({f"next{h}": arc_change(F.lead(x, h).over(w), x, 200.0) for h in horizons})
    # the panel's other columns are neither shuffled nor staged
    rows = rows.filter("past is not null").select(F.when(F.col("AGE") <= young, 1).otherwise(2).cast("long").alias("age_group"), "re", "past", *[f"next{h}" for h in horizons])
    binned = qu.xtile(qu.xtile(rows, ["age_group"], "re", income_groups, "inc", "linear"), ["age_group", "inc"], "past", shock_groups, "chg", "linear")
    long = binned.unpivot(["age_group", "inc", "chg"], [f"next{h}" for h in horizons], "_h", "g").withColumn("h", F.substring("_h", 5, 3).cast("long"))
    return long.groupBy("age_group", "inc", "chg", "h").agg(F.count("g").alias("n"), F.avg("g").alias("response"))
