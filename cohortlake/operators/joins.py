"""Joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_merge(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """1:1 merge with the status columns' meaning in `merge`: 1 left only, 2 right only, 3 both."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(2))
    return a.join(b, list(on), "full").withColumn("merge", F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0))).drop("_l", "_r")


def merge_keep(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Sequence[int] = (1, 3)) -> DataFrame:
    """The rows of a merge with the statuses kept, planned as the join that gives just those."""
    kind = {(3,): "inner", (1, 3): "left", (2, 3): "right"}.get(tuple(sorted(keep)))
    if kind:
        status = F.lit(3) if kind == "inner" else F.when(F.col("_m").isNull(), F.lit(1 if kind == "left" else 2)).otherwise(3)
        a, b = (left, right.withColumn("_m", F.lit(1))) if kind != "right" else (left.withColumn("_m", F.lit(1)), right)
        return a.join(b, list(on), kind).withColumn("merge", status).drop("_m")
    return full_merge(left, right, on).filter(F.col("merge").isin(*keep))


def replaced(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Old rows without a new one of their key, and the new ones."""
    return old.join(new.select(*on), list(on), "left_anti").unionByName(new, allowMissingColumns=True)


def interpolated(df: DataFrame, x: str, knots: DataFrame, name: str, knot_x: str = "x", knot_y: str = "y") -> DataFrame:
    """Piecewise-linear lookup, clamped at the ends. The knots (bounded: a table of some hundred rows) become one sorted array,
    in which each row finds its bracket; no range join."""
    packed = knots.agg(F.array_sort(F.collect_list(F.struct(F.col(knot_x).cast("double").alias("x"), F.col(knot_y).cast("double").alias("y")))).alias("_knots"))
    out = df.crossJoin(F.broadcast(packed)).withColumn("_v", F.col(x).cast("double"))
    k = F.size(F.filter("_knots", lambda q: q["x"] <= F.col("_v")))
    low, high = F.element_at("_knots", F.greatest(k, F.lit(1))), F.element_at("_knots", F.least(k + 1, F.size("_knots")))
    inside = low["y"] + (F.col("_v") - low["x"]) * F.try_divide(high["y"] - low["y"], high["x"] - low["x"])
    first, last = F.element_at("_knots", 1), F.element_at("_knots", -1)
    value = F.when(F.col("_v") <= first["x"], first["y"]).when(F.col("_v") >= last["x"], last["y"]).otherwise(inside)
    return out.withColumn(name, F.when(F.col("_v").isNotNull(), value)).drop("_knots", "_v")


def distinct_knots(knots: DataFrame, x: str, y: str) -> DataFrame:
    """One knot for each value y, the one with the least x: a step function's first points, as an inverse lookup needs them."""
    return knots.groupBy(y).agg(F.min(x).alias(x)).select(x, y)


def bilinear(df: DataFrame, x: str, y: str, grid: DataFrame, name: str) -> DataFrame:
    """Interpolation on a full rectangular grid (gx, gy, gz), clamped at its edges. The grid is one bounded map of corners."""
    axes = grid.agg(F.array_sort(F.collect_set("gx")).alias("_xs"), F.array_sort(F.collect_set("gy")).alias("_ys"), F.map_from_entries(F.collect_list(F.struct(F.struct("gx", "gy"), "gz"))).alias("_z"))
    out = df.crossJoin(F.broadcast(axes))

    def bracket(v: Column, axis: str) -> tuple[Column, Column, Column]:
        inside = F.least(F.greatest(v, F.element_at(axis, 1)), F.element_at(axis, -1))
        k = F.least(F.greatest(F.size(F.filter(axis, lambda q: q <= inside)), F.lit(1)), F.size(axis) - 1)
        low, high = F.element_at(axis, k), F.element_at(axis, k + 1)
        return low, high, (inside - low) / (high - low)

    x0, x1, u = bracket(F.col(x), "_xs")
    y0, y1, v = bracket(F.col(y), "_ys")
    z = lambda a, b: F.element_at("_z", F.struct(a.alias("gx"), b.alias("gy")))
    value = z(x0, y0) * (1 - u) * (1 - v) + z(x1, y0) * u * (1 - v) + z(x0, y1) * (1 - u) * v + z(x1, y1) * u * v
    return out.withColumn(name, value).drop("_xs", "_ys", "_z")


def nearest(df: DataFrame, x: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """The key (of a bounded table) closest to x; the lesser of two as close."""
    packed = keys.agg(F.array_sort(F.collect_set(F.col(key).cast("double"))).alias("_keys"))
    out = df.crossJoin(F.broadcast(packed))
    best = F.array_min(F.transform("_keys", lambda q: F.struct(F.abs(q - F.col(x)).alias("d"), q.alias("k"))))
    return out.withColumn(name, best["k"]).drop("_keys")


def clamped(df: DataFrame, x: str, table: DataFrame, key: str, low, high) -> DataFrame:
    """Lookup in a small table with x pushed into [low, high] first: edge rows serve everything beyond them."""
    return df.withColumn("_k", F.least(F.greatest(F.col(x), F.lit(low)), F.lit(high)).cast("long")).join(F.broadcast(table.withColumnRenamed(key, "_k")), "_k", "left").drop("_k")


def range_joined(df: DataFrame, x: str, intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """low <= x < high over a large interval table: both sides meet in buckets of the given width, as an equi-join."""
    wide = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return df.withColumn("_bucket", F.floor(F.col(x) / width)).join(wide, "_bucket").filter((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("_bucket")


def bracketed_knots(knots: DataFrame, x: str, y: str) -> DataFrame:
    """Consecutive knots as intervals [x, x_next) with both values. The window is over the knots alone."""
    w = Window.orderBy(x)
    return knots.select(F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).filter("x1 is not null")
