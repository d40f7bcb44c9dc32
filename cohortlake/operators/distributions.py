"""Distributions: histograms, densities, distribution functions, shares and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.quantiles import group_percentiles, selected


def histogram(df: DataFrame, value: str, bins: int, cutoff: float = 0.01) -> DataFrame:
    """bin, n, share: bin 1 up to the cutoff percentile, bin `bins` + 1 above the opposite one, equal widths between. Only the two
    order statistics are selected; the counting is one aggregate."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    rank = lambda n, p: F.floor(F.round(n * p / 100, 9)) + 1
    ends = selected(rows, [], "v", lambda n: F.array(rank(n, cutoff), rank(n, 100 - cutoff))).select(F.get("_at", F.lit(0)).alias("lo"), F.get("_at", F.lit(1)).alias("hi"), F.col("_n").alias("total"))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    inner = F.least(F.greatest(1 + F.ceil(F.round((v - lo) / ((hi - lo) / (bins - 1)), 9)), F.lit(2)), F.lit(bins))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(v <= lo, 1).when(v > hi, bins + 1).otherwise(inner).cast("bigint"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).select("bin", "n", (F.col("n") / F.col("total")).alias("share"))


def kernel_density(df: DataFrame, value: str, points: int = 500, merge_digits: int | None = None) -> DataFrame:
    """i, at, density on an even grid from min - h to max + h: kernel 3/4 (1 - z^2 / 5) / sqrt(5) within sqrt(5) bandwidths,
    h = 0.9 min(sd, IQR / 1.349) n^(-1/5), with quartiles by the averaged rule. Equal values (after rounding to merge_digits, if
    given) are merged with their counts, and each meets only the grid points within its reach."""
    x = F.col(value).cast("double")
    x = x if merge_digits is None else F.round(x, merge_digits)
    merged = df.filter(F.col(value).isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    raw = df.select(F.col(value).cast("double").alias("x")).filter("x is not null")
    s = raw.agg(F.stddev_samp("x").alias("sd"), F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    s = s.crossJoin(F.broadcast(group_percentiles(raw, [], "x", (25, 75)))).withColumn("h", 0.9 * F.least("sd", (F.col("p75") - F.col("p25")) / 1.349) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    s = s.select("h", "n", (F.col("lo") - F.col("h")).alias("start"), ((F.col("hi") - F.col("lo") + 2 * F.col("h")) / (points - 1)).alias("step"))  # one row
    at = lambda i: F.col("start") + i * F.col("step")
    reach, root = F.sqrt(F.lit(5.0)) * F.col("h"), F.sqrt(F.lit(5.0))
    near = lambda edge, f, end: F.least(F.greatest(f((edge - F.col("start")) / F.col("step")), F.lit(0)), F.lit(end)).cast("int")
    first, last = near(F.col("x") - reach, F.floor, points - 1), near(F.col("x") + reach, F.ceil, points - 1)
    met = merged.crossJoin(F.broadcast(s)).withColumn("i", F.explode(F.sequence(first, last)))
    z = (F.col("x") - at(F.col("i"))) / F.col("h")
    kernel = F.when(F.abs(z) < root, 0.75 * (1 - z * z / 5) / root).otherwise(0.0)
    sums = met.groupBy("i").agg((F.sum(F.col("c") * kernel) / (F.max("n") * F.max("h"))).alias("density"))
    grid = s.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "start", "step").select("i", at(F.col("i")).alias("at"))
    return grid.join(F.broadcast(sums), "i", "left").select(F.col("i").cast("bigint").alias("i"), "at", F.coalesce("density", F.lit(0.0)).alias("density"))


def tail_fits(grid: DataFrame, x: str = "at", f: str = "density", inner: float = 1.0, outer: float = 4.0) -> DataFrame:
    """side (left, right), n, slope, intercept: lines through the log of a gridded density between -outer and -inner, and between
    inner and outer. Points without density have no log and are left out; a side with fewer than two points has null lines."""
    at, log = F.col(x), F.when(F.col(f) > 0, F.ln(f))
    side = F.when(at.between(-outer, -inner), "left").when(at.between(inner, outer), "right")
    rows = grid.select(side.alias("side"), at.alias("_x"), log.alias("_l")).filter("side is not null and _l is not null")
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_l", "_x").alias("slope"), F.regr_intercept("_l", "_x").alias("intercept"))


def density_moments(grid: DataFrame, x: str, f: str, tail: float) -> DataFrame:
    """Moments, median and mass above `tail` of a gridded density (a table of bounded size)."""
    from pyspark.sql import Window

    total = grid.agg(F.sum(f).alias("_s"), (F.sum(F.col(x) * F.col(f)) / F.sum(f)).alias("_m"))
    rows = grid.crossJoin(F.broadcast(total)).withColumn("p", F.col(f) / F.col("_s")).withColumn("cdf", F.sum(f).over(Window.orderBy(x)) / F.col("_s")).withColumn("e", F.col(x) - F.col("_m"))
    m = lambda k: F.sum(F.col("p") * F.pow("e", F.lit(float(k))))
    return rows.agg(F.max("_m").alias("mean"), F.sqrt(m(2)).alias("sd"), (m(3) / F.pow(m(2), F.lit(1.5))).alias("skew"), (m(4) / F.pow(m(2), F.lit(2.0))).alias("kurt"), F.min(F.when(F.col("cdf") >= 0.5, F.col(x))).alias("median"), F.sum(F.when(F.col(x) > tail, F.col("p")).otherwise(0.0)).alias("tail"))


def empirical_cdf(df: DataFrame, value: str, top: int) -> DataFrame:
    """i, pct: percent of rows with at most i, i = 0..top, whether or not a value occurs."""
    # values above the top count alike, so the table has top + 2 rows at most
    counts = df.groupBy(F.least(F.col(value), F.lit(top + 1)).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))
    grid = df.sparkSession.range(top + 1).withColumnRenamed("id", "i")
    below = grid.join(F.broadcast(counts), F.col("_v") <= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_b"))
    return below.crossJoin(F.broadcast(total)).select("i", (100.0 * F.col("_b") / F.col("_t")).alias("pct"))


def employment_by_age(rows: DataFrame, everyone: DataFrame, floor: float, id_: str = "id") -> DataFrame:
    """age, worked (years a person reaches the floor at all), n, share employed."""
    worked = everyone.groupBy(id_).agg(F.count(F.when(F.col("y") >= floor, 1)).alias("worked"))
    return rows.join(worked, id_).groupBy("age", "worked").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") >= floor).cast("int")).alias("employed"))


def distinct_counts(df: DataFrame, columns: Sequence[str], joint: str | None = None, missing: bool = False) -> DataFrame:
    """Distinct values of each column, and of all together; `missing` counts null as a value."""
    one = lambda c: F.count_distinct(F.col(c)) + (F.max(F.col(c).isNull().cast("int")) if missing else F.lit(0))
    out = [one(c).cast("bigint").alias(c) for c in columns]
    if joint:
        whole = F.struct(*columns)
        known = F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x), whole)
        out.append(F.count_distinct(whole if missing else known).alias(joint))
    return df.agg(*out)


def shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, share of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select(*keys, "n", (F.col("n") / F.col("_t")).alias("share"))
