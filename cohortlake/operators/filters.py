"""Sample rules. Missing is null; a missing death year counts as later than any year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = 9999


def alive(year: Column, death: Column) -> Column:
    return F.coalesce(death, F.lit(NEVER)) > year


def eligible_cohort(birth: Column, first_year: int, last_year: int, low: int = 25, high: int = 60) -> Column:
    """Some year of the window falls at an age within [low, high] (age counts the birth year as 1)."""
    return (last_year - birth + 1 >= low) & (first_year - birth + 1 <= high)


def observable_years(birth: Column, death: Column, first_year: int, last_year: int, low: int = 25, high: int = 60) -> Column:
    """How many years of the window fall within the age range, before death."""
    start = F.greatest(F.lit(first_year), birth + low - 1)
    end = F.least(F.lit(last_year), birth + high - 1, F.coalesce(death, F.lit(NEVER)) - 1)
    return F.greatest(F.lit(0), end - start + 1)


def employed_at_least(panel: DataFrame, years: int, floor: float, value: str = "y", id_: str = "id") -> DataFrame:
    """Rows of persons with so many years at or above the floor: one aggregate, then a semi join on the same key."""
    enough = panel.groupBy(id_).agg(F.count(F.when(F.col(value) >= floor, 1)).alias("_years")).filter(F.col("_years") >= years).select(id_)
    return panel.join(enough, id_, "left_semi")


def recently_attached(panel: DataFrame, floor: float, years: int = 5, least: int = 3, value: str = "y", id_: str = "id", year: str = "yr") -> DataFrame:
    """Rows whose value reaches the floor and that have `least` such years among the last `years`. The count starts 5 below
    zero where the current year fails, which no window can make up for, so it is a plain condition."""
    w = Window.partitionBy(id_).orderBy(year).rangeBetween(-(years - 1), 0)
    return panel.withColumn("nv", F.count(F.when(F.col(value) >= floor, 1)).over(w)).filter((F.col(value) >= floor) & (F.col("nv") >= least))


def recently_attached_young(panel: DataFrame, floor: float, young: int = 26, value: str = "y", age: str = "age", id_: str = "id", year: str = "yr") -> DataFrame:
    """Up to age `young`, the year before is enough; later the usual rule of three in five."""
    w = Window.partitionBy(id_).orderBy(year)
    reached = F.when(F.col(value) >= floor, 1)
    out = panel.withColumn("_one", F.count(reached).over(w.rangeBetween(-1, -1))).withColumn("_five", F.count(reached).over(w.rangeBetween(-4, 0)))
    rule = F.when(F.col(age) <= young, F.col("_one") >= 1).otherwise(F.col("_five") >= 3)
    return out.filter((F.col(value) >= floor) & rule).drop("_one", "_five")


def attached_in_periods(panel: DataFrame, periods: Sequence[tuple[int, int]], floor: float, value: str = "y", id_: str = "id", year: str = "yr") -> DataFrame:
    """Rows of persons who reach the floor in each of the periods."""
    tests = [F.max(F.col(year).between(a, b) & (F.col(value) >= floor)).alias(f"_p{i}") for i, (a, b) in enumerate(periods)]
    ok = panel.groupBy(id_).agg(*tests)
    for i in range(len(periods)):
        ok = ok.filter(f"_p{i}")
    return panel.join(ok.select(id_), id_, "left_semi")


def without_gaps(panel: DataFrame, most: int = 2, id_: str = "id", year: str = "yr") -> DataFrame:
    """Rows of persons with several rows, none further than `most` years from the one before."""
    steps = panel.withColumn("_step", F.col(year) - F.lag(year).over(Window.partitionBy(id_).orderBy(year)))
    everyone = Window.partitionBy(id_)
    return steps.withColumn("_worst", F.max("_step").over(everyone)).filter(F.col("_worst") <= most).drop("_step", "_worst")


def without_bad(panel: DataFrame, bad: Column, id_: str = "id") -> DataFrame:
    """Rows of persons without any bad or unknown row."""
    return panel.withColumn("_bad", F.sum(F.when(~F.coalesce(~bad, F.lit(False)), 1).otherwise(0)).over(Window.partitionBy(id_))).filter("_bad = 0").drop("_bad")


def stable_households(panel: DataFrame, change: Column, id_: str = "id", year: str = "yr") -> DataFrame:
    """Rows of persons without a change after their first year."""
    everyone = Window.partitionBy(id_)
    late = F.max(F.when(F.col(year) > F.col("_first"), change).otherwise(F.lit(False))).over(everyone)
    return panel.withColumn("_first", F.min(year).over(everyone)).withColumn("_late", late).filter(~F.col("_late")).drop("_first", "_late")


def legitimate(f: Column, most: float = 1e8) -> Column:
    """A finite objective value below a bound."""
    return f.isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")) & (f < most)


def ever_true(columns: Sequence[str]) -> Column:
    """Any of the columns holds."""
    return F.exists(F.array(*[F.coalesce(F.col(c), F.lit(False)) for c in columns]), lambda x: x)
