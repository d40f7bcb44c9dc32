"""The household-survey pipeline: waves, individual heads, sentinel codes, annual amounts, cleaning, residual changes by size group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.moments import crow, kelley, moors
from cohortlake.functions.quantiles import group_percentiles
from cohortlake.functions.scalar import annual_factor
from cohortlake.operators.filters import without_bad, without_gaps
from cohortlake.operators.panel import anchored_age, calendar_shift, filled
from cohortlake.operators.regression import residuals_by_group

# Edges of the change groups.
CHANGE_EDGES = (-1.0, -0.25, 0.0, 0.25, 1.0)


def heads(individuals: DataFrame, years: Sequence[int]) -> DataFrame:
    """person, year, intid of those who are a head (sequence 1) in some year, from columns intid<year>, seq<year>."""
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("year"), F.col(f"intid{t}").alias("intid"), F.col(f"seq{t}").alias("seq")) for t in years])
    return individuals.select("person", F.explode(rows).alias("r")).select("person", "r.*").filter("seq = 1").select("person", "year", "intid")


def annual_amounts(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Amount times payments a year: (amount column, frequency code column, new name); missing counts as zero."""
    return df.withColumns({new: F.coalesce(F.col(amount) * annual_factor(F.col(code)), F.lit(0)) for amount, code, new in pairs})


def cleaned(panel: DataFrame, prices: DataFrame, floor: float = 1500.0) -> DataFrame:
    """Persons without long gaps or unknown income, ages recounted from the last wave, education carried over, real income."""
    steady = without_gaps(panel, 2, "person", "year")
    known = without_bad(steady, F.col("y").isNull(), "person")
    aged = anchored_age(known, "age", "age", "person", "year")
    schooled = filled(aged, "educ", "educ", "person", "year") if "educ" in panel.columns else aged
    real = schooled.join(F.broadcast(prices.withColumnRenamed("yr", "year")), "year").withColumn("real", F.col("y") * 100 / F.col("price"))
    return real.filter((F.col("real") >= floor) & F.col("age").between(25, 60))


def change_groups(panel: DataFrame, factors: Sequence[str], step: int = 2) -> DataFrame:
    """person, year, resid, change over `step` years, group 1..6 by size (an edge belongs to the higher group)."""
    logs = panel.withColumn("ly", F.ln("real"))
    resid = residuals_by_group(logs, "year", "ly", factors)
    moved = calendar_shift(resid, ["resid"], -step, "_before", "person", "year").withColumn("change", F.col("resid") - F.col("resid_before"))
    group = 1 + F.size(F.filter(F.array(*map(F.lit, CHANGE_EDGES)), lambda e: F.col("change") >= e))
    return moved.withColumn("grp", F.when(F.col("change").isNotNull(), group)).select("person", "year", "resid", "change", "grp")


def robust_statistics(changes: DataFrame, keys: Sequence[str], value: str = "change") -> DataFrame:
    """keys, n, kelley, moors, crow of a value."""
    rows = changes.filter(F.col(value).isNotNull())
    q = group_percentiles(rows, keys, value)
    c = F.col
    shapes = q.select(*keys, kelley(c("p10"), c("p50"), c("p90")).alias("kelley"), moors(c("p12_5"), c("p25"), c("p37_5"), c("p62_5"), c("p75"), c("p87_5")).alias("moors"), crow(c("p2_5"), c("p25"), c("p75"), c("p97_5")).alias("crow"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(shapes, list(keys))
