"""Reshaping: wide and long panels, pivots, tensors and array panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_to_long(wide: DataFrame, keys: Sequence[str], stubs: Sequence[str], years: Sequence[int], year: str = "yr") -> DataFrame:
    """One row per key and year from columns stub + year; a missing column is null. Rows where every stub is null go."""
    have = set(wide.columns)
    cell = lambda s, t: F.col(f"{s}{t}").cast("double") if f"{s}{t}" in have else F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias(year), *[cell(s, t).alias(s) for s in stubs]) for t in years])
    out = wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in (year, *stubs)])
    return out.dropna(how="all", subset=list(stubs))


def long_to_wide(long: DataFrame, keys: Sequence[str], stub: str, years: Sequence[int], year: str = "yr") -> DataFrame:
    """Columns stub + year; the years are given, so no pass is needed to find them."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col(year) == t, F.col(stub))).alias(f"{stub}{t}") for t in years])


def dense_ages(panel: DataFrame, low: int, high: int, value: str = "y", age: str = "age") -> DataFrame:
    """One row per person with the ages' values as an array; 0 where there is none."""
    by_age = F.map_from_entries(F.collect_list(F.struct(F.col(age).cast("int"), F.col(value))))
    inside = panel.filter(F.col(age).between(low, high)).groupBy("id").agg(by_age.alias("_m"))
    return inside.select("id", F.transform(F.sequence(F.lit(low), F.lit(high)), lambda a: F.coalesce(F.try_element_at("_m", a), F.lit(0.0))).alias("y"))


def matrix_to_long(matrix: DataFrame, first_age: int = 25, id_: str = "id", y: str = "y") -> DataFrame:
    """(id, y array) as id, age, y."""
    return matrix.select(id_, F.posexplode(y).alias("_p", "y")).select(id_, (F.col("_p") + first_age).cast("long").alias("age"), "y")


def toolbox_panel(matrix: DataFrame, cohort: int, first_age: int = 25, floor: float = 1.885, sex: int = 1) -> DataFrame:
    """ID, REAL_WAGE, LOG_WAGE (null below the floor), YEAR, AGE, COHORT, SEX, Y_MIN."""
    long = matrix_to_long(matrix, first_age)
    return long.select(
        F.col("id").alias("ID"), F.col("y").alias("REAL_WAGE"), F.when(F.col("y") >= floor, F.ln("y")).alias("LOG_WAGE"), (F.col("age") + cohort).cast("int").alias("YEAR"),
        F.col("age").cast("int").alias("AGE"), F.lit(cohort).alias("COHORT"), F.lit(sex).alias("SEX"), F.lit(floor).alias("Y_MIN"),
    )


def extended(y: Column, left: int, right: int, low: float = 0.1, growth: float = 0.01) -> Column:
    """An income array with `left` earlier ages ramping linearly from `low` of the first value to it, and `right` later ages that
    grow by `growth` a year."""
    first, last = F.element_at(y, 1), F.element_at(y, -1)
    ramp = F.transform(F.sequence(F.lit(0), F.lit(left - 1)), lambda i: first * (low + (1 - low) * i / left)) if left else F.array().cast("array<double>")
    tail = F.transform(F.sequence(F.lit(1), F.lit(right)), lambda i: last * F.pow(F.lit(1 + growth), i)) if right else F.array().cast("array<double>")
    return F.concat(ramp, y, tail)


def tidy(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "stat") -> DataFrame:
    """One row per key and value column."""
    return df.unpivot(list(keys), list(values), name, "value")


def flattened(cells: DataFrame, index: Sequence[str] = ("grp", "i", "j", "k", "l"), order: Sequence[str] = ()) -> DataFrame:
    """The cells with their place in the flat vector, from 0. Groups come in the given order; the table is a moment vector, of
    bounded size, so one window over it is fine."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, order)), F.col(index[0])) if order else F.lit(0)
    return cells.withColumn("pos", (F.row_number().over(Window.orderBy(rank, *index)) - 1).cast("long"))


def slices(flat: DataFrame, group: str = "grp") -> DataFrame:
    """First and end places of each group."""
    return flat.groupBy(group).agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"))
