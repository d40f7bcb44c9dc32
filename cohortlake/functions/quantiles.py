"""Order statistics under five percentile rules, by selection: no group is sorted by row, and none has to fit one task.

With k0 = n p for a probability p, and sorted values v_1..v_n:
averaged   v_k with k = ceil(k0), or the mean of v_k0 and v_(k0+1) where k0 is whole
floor      v_min(n, floor(k0) + 1)
linear     between neighbours at 1 + (n - 1) p
inverted   v_max(1, ceil(k0))
exclusive  between neighbours at (n + 1) p, clipped to the ends

Groups are compared null-safely: rows with null keys form groups like others. Null values have no rank; a group without values has null
percentiles. Rows are staged once, narrow, and the largest group is counted. Groups of at most `most` values become one sorted array
each. Otherwise equal values are first counted, in the map tasks as far as they meet there, so a mass point is one value with a count.
These are dealt by ranges of keys and value; the ranges' counts say which one holds each wanted rank, and only those are summed up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import staged

RULES = ("averaged", "floor", "linear", "inverted", "exclusive")
#: Percentiles of the robust statistics.
FIFTEEN = (1, 2.5, 5, 10, 12.5, 25, 37.5, 50, 62.5, 75, 87.5, 90, 95, 97.5, 99)
NINE = (1, 5, 10, 25, 50, 75, 90, 95, 99)

#: Rows of a group that one task sorts, or one array holds.
GROUP_ROWS = 1_000_000
#: Wanted number of distinct values in a range of larger groups.
RANGE_ROWS = 100_000
#: Numbers (8 bytes each) in tables of cut points or ranks that are sent to all executors; larger ones are shuffled.
SENT = 500_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, where null equals null; the keys appear once."""
    if not keys:
        # an aggregate without keys is one row
        return left.join(F.broadcast(right), how="left" if how == "left" else "inner")
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_same_{k}" for k in keys])


def sent(df: DataFrame, width: int) -> DataFrame:
    """A staged table of `width` numbers a row, marked for broadcast while it is small. A table with a row a group must not make a shuffle
    deal all rows of a few large groups to as many tasks."""
    return F.broadcast(df) if df.count() * max(width, 1) <= SENT else df


def largest(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows"), F.sum("_rows")).first()
    return found[0] or 0, found[1] or 0


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], most: int = GROUP_ROWS) -> DataFrame:
    """df with _k (from 1) and _n: the place in the group by `order` (nulls first, as Spark sorts them) and the group's size.

    Where no group has more than `most` rows each is ranked by one task. Otherwise rows are dealt by ranges of keys and order, ties
    by where they were read, and sorted in their range; places are counted on from the sizes of each group's earlier ranges."""
    keys = list(keys)
    rows = staged(df, "ranked")
    top, total = largest(rows, keys)
    if top <= most:
        by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return rows.withColumn("_k", F.row_number().over(by.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(by))
    place = [*keys, *order, "_row"]
    sorted_ = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(max(2, -(-total // most)), *place).sortWithinPartitions(*place)
    # within a task the id counts rows from 0 in its low 33 bits
    numbered = staged(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("_row"), "ranked")
    ranges = numbered.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = ranges.select(*keys, "_range", (F.sum("_size").over(over.orderBy("_range")) - F.col("_size") - F.col("_first")).alias("_shift"), F.sum("_size").over(over).alias("_n"))
    return null_safe(numbered, before, [*keys, "_range"]).withColumn("_k", F.col("_at") + F.col("_shift") + 1).drop("_at", "_shift", "_range")


def at(rank: Column, value: Column) -> Column:
    """The value at a rank, as an aggregate over ranked rows."""
    return F.max(F.when(F.col("_k") == rank, value))


def number(p: float | Column) -> Column:
    return p if isinstance(p, Column) else F.lit(float(p))


def share_of(n: Column, p: float | Column) -> Column:
    """n p / 100, cut to nine digits so that a whole product stays whole."""
    return F.round(n * number(p) / 100, 9)


def weighted_ranks(n: Column, p: float | Column, rule: str) -> list[tuple[Column, Column]]:
    """One or two (rank, weight) whose weighted values are the percentile."""
    one, place = F.lit(1.0), share_of(n, p)
    if rule == "averaged":
        low = F.greatest(F.ceil(place), F.lit(1))
        high = F.greatest(F.when(place == F.floor(place), F.least(F.floor(place) + 1, n)).otherwise(low), F.lit(1))
        return [(low, one / 2), (high, one / 2)]
    if rule == "floor":
        return [(F.least(n, F.floor(place) + 1), one)]
    if rule == "inverted":
        return [(F.greatest(F.ceil(place), F.lit(1)), one)]
    h = share_of(n - 1, p) + 1 if rule == "linear" else F.least(F.greatest(share_of(n + 1, p), one), n.cast("double"))
    return [(F.floor(h), 1 - (h - F.floor(h))), (F.least(F.floor(h) + 1, n), h - F.floor(h))]


def percentile(value: Column, p: float, rule: str) -> Column:
    """An aggregate over ranked rows; p in percent."""
    k = F.col("_k")
    parts = weighted_ranks(F.col("_n"), p, rule)
    if rule == "averaged":
        return F.avg(F.when((k == parts[0][0]) | (k == parts[1][0]), value))
    if len(parts) == 1:
        return F.max(F.when(k == parts[0][0], value))
    (low, a), (_, b) = parts
    return F.sum(F.when(k == low, value * a).when((k == low + 1) & (b > 0), value * b))


def name_of(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "_")


#: The wanted ranks, an array, as a function of the group's size.
Ranks = Callable[[Column], Column]


def selected(df: DataFrame, keys: Sequence[str], value: str, ranks: Ranks, most: int = GROUP_ROWS, extra: Sequence[Column] = (), held: bool = False) -> DataFrame:
    """keys, _n (values of the group) and _at: the values at the ranks (from 1; null beyond the ends), in their order. extra: further aggregates of the value, from the same pass. held: df is read from files, so it is not staged."""
    keys = list(keys)
    rows = df.select(*keys, value) if held else staged(df.select(*keys, value), "selected")
    top, _ = largest(rows, keys)
    grouped = rows.groupBy(*keys)
    v = F.col(value)
    wanted = ranks(F.col("_n")).cast("array<bigint>")
    if top <= most:
        held = grouped.agg(F.sort_array(F.collect_list(value)).alias("_sorted"), *extra).withColumn("_n", F.size("_sorted").cast("long"))
        # a rank before the first has no place, and neither has one beyond the last
        return held.withColumn("_at", F.transform(wanted, lambda r: F.get("_sorted", (r - 1).cast("int")))).drop("_sorted")
    summary = staged(grouped.agg(F.count(value).alias("_n"), *extra), "sizes")
    counted = staged(rows.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_times")), "counted")
    _, total = largest(counted, keys)
    parts = -(-total // min(RANGE_ROWS, most))
    ranged = counted.repartitionByRange(parts, *keys, "_v").withColumn("_range", F.spark_partition_id()) if parts > 1 else counted.withColumn("_range", F.lit(0))
    ranged = staged(ranged, "ranged")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_times").alias("_size"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.sum("_size").over(over.orderBy("_range")) - F.col("_size"))
    asked = summary.select(*keys, F.posexplode(wanted).alias("_place", "_rank"))
    spots = null_safe(asked, sizes, keys).filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_size")))
    # of each range the ranks that it holds
    needed = staged(spots.groupBy(*keys, "_range", "_before").agg(F.collect_list(F.struct("_place", "_rank")).alias("_ranks")), "needed")
    met = null_safe(ranged, sent(needed, 8), [*keys, "_range"])
    upto = met.withColumn("_upto", F.col("_before") + F.sum("_times").over(Window.partitionBy(*keys, "_range").orderBy("_v")))
    inside = F.filter("_ranks", lambda r: (r["_rank"] > F.col("_upto") - F.col("_times")) & (r["_rank"] <= F.col("_upto")))
    found = upto.select(*keys, F.col("_v").alias("_hit"), F.explode(inside["_place"]).alias("_place"))
    hits = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_hit"))).alias("_hits"))
    joined = null_safe(summary.drop("_cuts"), hits, keys, "left")
    return joined.withColumn("_at", F.transform(wanted, lambda _, i: F.col("_hits")[i])).drop("_hits")


def all_of(probs: Sequence[float], f: Callable[..., Column]) -> Column:
    """An array of f(p), or f(p, place), over the probabilities: one small expression however many they are."""
    return F.transform(F.lit([float(p) for p in probs]), f)


def combined(probs: Sequence[float], rule: str) -> tuple[Ranks, Column]:
    """The ranks that percentiles need, and the array of percentiles as an expression of _n and _at."""
    width = len(weighted_ranks(F.lit(1), 50, rule))

    def value(p: Column, i: Column) -> Column:
        spots = weighted_ranks(F.col("_n"), p, rule)
        x = [F.get("_at", i * width + j) for j in range(width)]
        if rule == "averaged":
            return F.when(spots[0][0] == spots[1][0], x[0]).otherwise((x[0] + x[1]) / 2)
        if width == 1:
            return x[0]
        return F.when(spots[1][1] > 0, x[0] * spots[0][1] + x[1] * spots[1][1]).otherwise(x[0] * spots[0][1])

    return lambda n: F.flatten(all_of(probs, lambda p: F.array(*[r.cast("bigint") for r, _ in weighted_ranks(n, p, rule)]))), all_of(probs, value)


def group_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = FIFTEEN, rule: str = "averaged", most: int = GROUP_ROWS, extra: Sequence[Column] = ()) -> DataFrame:
    """keys, any extra aggregates of the value, and percentile columns."""
    ranks, values = combined(probs, rule)
    names = selected_names(df, keys, extra)
    rows = selected(df, keys, value, ranks, most, extra).select(*keys, *names, values.alias("_values"))
    return rows.select(*keys, *names, *[F.get("_values", F.lit(i)).alias(name_of(p)) for i, p in enumerate(probs)])


def selected_names(df: DataFrame, keys: Sequence[str], extra: Sequence[Column]) -> list[str]:
    return df.groupBy(*keys).agg(F.lit(0).alias("_"), *extra).columns[len(keys) + 1 :] if extra else []


def floor_rank(n: Column, p: float | Column) -> Column:
    return F.least(n, F.floor(share_of(n, p)) + 1)


def smoothed_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], reach: int = 5, most: int = GROUP_ROWS) -> DataFrame:
    """Means of the order statistics within `reach` places of the floor-rule rank."""
    width = 2 * reach + 1
    around = F.sequence(F.lit(-reach), F.lit(reach))
    rows = selected(df, keys, value, lambda n: F.flatten(all_of(probs, lambda p: F.transform(around, lambda d: floor_rank(n, p) + d))), most)
    mean = lambda i: F.slice("_at", i * width + 1, width)
    held = lambda i: F.filter(mean(i), lambda x: x.isNotNull())
    total = lambda i: F.aggregate(held(i), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*keys, *[F.try_divide(total(i), F.size(held(i))).alias(name_of(p)) for i, p in enumerate(probs)])


def top_shares(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], most: int = GROUP_ROWS) -> DataFrame:
    """The share of the total from each percentile's rank on. Rows equal to the value at that rank count as far as they reach it."""
    found = selected(df, keys, value, lambda n: all_of(probs, lambda p: F.floor(share_of(n, p)) + 1), most, [F.sum(value).alias("_total")]).drop("_total")
    v = F.col(value)
    found = staged(found.withColumnRenamed("_at", "_cuts"), "cuts")
    rows = null_safe(df.select(*keys, value).filter(v.isNotNull()), sent(found, len(probs)), keys)
    cut = lambda i: F.get("_cuts", F.lit(i))
    # rows above the cut, and as many at the cut as complete the number of ranks
    above = [(F.sum(F.when(v > cut(i), v).otherwise(0.0)), F.count(F.when(v > cut(i), 1)), F.max(cut(i))) for i in range(len(probs))]
    n = F.max("_n")
    return rows.groupBy(*keys).agg(*[((s + F.when(c.isNotNull(), c * (n - F.floor(share_of(n, p)) - k)).otherwise(0.0)) / F.sum(v)).alias("top" + name_of(p)[1:]) for p, (s, k, c) in zip(probs, above, strict=True)])


def cut_points(df: DataFrame, keys: Sequence[str], value: str, groups: int, rule: str = "averaged", most: int = GROUP_ROWS, held: bool = False) -> DataFrame:
    """keys, cuts: the inner percentiles that part a value into so many groups."""
    ranks, values = combined([100 * i / groups for i in range(1, groups)], rule)
    return selected(df, keys, value, ranks, most, held=held).select(*keys, values.alias("cuts"))


def xtile(df: DataFrame, keys: Sequence[str], value: str, groups: int, name: str = "bin", rule: str = "averaged", most: int = GROUP_ROWS) -> DataFrame:
    """Quantile groups by cut point: equal values stay together. The cut table has one row per group and is sent to all executors unless it is large."""
    rows = staged(df, "xtile")
    # interpolated cut points of equal values may stand the wrong way round by their last digit
    cuts = staged(cut_points(rows, keys, value, groups, rule, most, held=True).withColumn("cuts", F.sort_array("cuts")), "cuts")
    joined = null_safe(rows, sent(cuts, groups), keys, "left")
    # a bisection: comparisons grow with the logarithm of the groups, and each step is a column, so that it is compiled
    joined = joined.withColumn("_above", F.lit(0))
    for k in reversed(range((groups - 1).bit_length())):
        far = F.col("_above") + (1 << k)
        joined = joined.withColumn("_above", F.when(F.get("cuts", far - 1) < F.col(value), far).otherwise(F.col("_above")))
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), F.col("_above") + 1).cast("long")).drop("cuts", "_above")


def rank_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], edges: Sequence[float], name: str = "bin", most: int = GROUP_ROWS, shared: bool = False) -> DataFrame:
    """Bins by rank: with 1-based percentile edges e, bin j holds the 0-based places in [floor(n (e_j - 1) / 100), floor(n (e_j+1 - 1) / 100)).
    Bins are disjoint, ties part by the order columns, and rows with a null first order column get no bin. With shared, a bin also has
    the place at its upper edge, so a row on an inner edge appears in both bins; a bin of that one row only is empty."""
    rows = ranked(df.filter(F.col(order[0]).isNotNull()), keys, order, most)
    place = F.col("_k") - 1
    edge = lambda e: F.floor(share_of(F.col("_n"), e - 1))
    last = len(edges) - 1
    if shared:
        upper = lambda e: F.least(edge(e), F.col("_n") - 1)
        inside = [F.when((place >= edge(a)) & (place <= upper(b)) & (upper(b) > edge(a)), F.lit(j).cast("long")) for j, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1)]
        bins = F.filter(F.array(*inside), lambda b: b.isNotNull())
        return rows.withColumn(name, F.explode(bins)).drop("_k", "_n")
    out = None
    for j, e in enumerate(edges[1:], 1):
        test = place < edge(e)
        out = F.when(test, F.lit(j)) if out is None else out.when(test, F.lit(j))
    return rows.withColumn(name, out.otherwise(F.lit(last)).cast("long")).drop("_k", "_n")


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "pct", most: int = GROUP_ROWS) -> DataFrame:
    """Average-tie ranks over the group's size; null values get none. Equal values are ranked by one row with their count."""
    held = staged(df, "percent-rank")
    ties = held.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    rows = ranked(ties, keys, [value], most).drop("_n")
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_k")
    if largest(rows, keys)[0] <= most:
        shares = rows.withColumn("_upto", F.sum("_times").over(w)).withColumn("_n", F.sum("_times").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))
        share = shares.select(*keys, value, ((F.col("_upto") - (F.col("_times") - 1) / 2) / F.col("_n")).alias(name))
    else:
        every = ranked(held.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value], most)
        share = every.groupBy(*keys, value).agg((F.avg("_k") / F.max("_n")).alias(name))
    return null_safe(held, share, [*keys, value], "left")
