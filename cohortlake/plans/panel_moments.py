"""Moments of an income panel (id, y array over ages 25..): the cross-section of arc changes by recent income, impulse responses,
lifetime growth, the variance of log income and the distribution of years employed.

As Spark plans, recent income and changes are array expressions inside each person's row, so the only shuffles are those of ranks and
group statistics. The numpy kernel computes the same for one small panel at a time. Bins are disjoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.moments import unbiased
from cohortlake.functions.quantiles import rank_bins
from cohortlake.session import staged

# 1-based percentile edges of the bins.
RECENT_EDGES = (1, 2, 11, 21, 31, 41, 51, 61, 71, 81, 91, 96, 100, 101)
IMPULSE_INCOME_EDGES = (1, 6, 11, 31, 51, 71, 91, 96, 101)
IMPULSE_SHOCK_EDGES = (1, 3, 6, 11, 31, 51, 71, 91, 96, 99, 101)
LIFETIME_EDGES = (1, 2, 6, 11, 21, 31, 41, 51, 61, 71, 81, 91, 96, 98, 100, 101)
# Fixed values: (base, future) steps after h of the changes g1, g5 and ir0..ir5.
PAIRS = ((1, 2), (1, 6), (0, 1), (0, 2), (0, 3), (0, 4), (0, 6), (0, 11))
CHANGES = ("g1", "g5", "ir0", "ir1", "ir2", "ir3", "ir4", "ir5")
FLOOR, LEAST_RECENT, LEAST_EMPLOYED = 1.5, 3, 15
#: Steps h of the six sub-bins, two to an age group, and of the two impulse ages.
SUB_BINS = ((2, 4), (5, 9), (10, 14), (15, 19), (20, 24), (25, 29))
IMPULSE_AGES = ((2, 9), (10, 24))
FIRST, LAST = 2, 29


def cells(panel: DataFrame) -> DataFrame:
    return panel.select("id", F.posexplode("y").alias("h", "v"))


def age_profile(panel: DataFrame) -> DataFrame:
    """h, n, var_lny, agedum: over incomes at or above the floor; the variance is 0 below two of them, agedum exp of the mean log."""
    x = F.when(F.col("v") >= FLOOR, F.ln("v"))
    out = cells(panel).groupBy("h").agg(F.count(x).alias("n"), F.var_samp(x).alias("s2"), F.avg(x).alias("m"))
    few = F.col("n") < 2
    return out.select("h", "n", F.when(few, 0.0).otherwise(F.col("s2")).alias("var_lny"), F.exp(F.when(few, 0.0).otherwise(F.col("m"))).alias("agedum"))


def _values(profile: DataFrame) -> list[float]:
    """The profile's dummies by age: one number per age reaches the driver."""
    return [r[0] for r in profile.orderBy("h").select("agedum").collect()]


def long_panel(panel: DataFrame, agedum: Sequence[float]) -> DataFrame:
    """id, h, re and the eight changes for h = 2..29; the impulse changes are demeaned by h."""
    steps = len(agedum)
    dummy = F.lit([float(x) for x in agedum])
    trailing = F.lit([float(np.mean(agedum[max(0, h - 4) : h + 1])) for h in range(steps)])
    h = F.col("h")
    y = lambda k: F.get("y", h + k)  # noqa: E731  null beyond either end
    back = [y(-k) for k in range(5)]
    # windows are shorter at the first ages, where y(-k) is null
    valid = reduce(lambda a, b: a + b, [F.coalesce((v >= FLOOR).cast("int"), F.lit(0)) for v in back])
    total = reduce(lambda a, b: a + b, [F.when(v.isNull(), 0.0).otherwise(F.greatest(v, F.lit(FLOOR))) for v in back])
    recent = F.when((y(0) >= FLOOR) & (valid >= LEAST_RECENT), total / (F.least(h + 1, F.lit(5)) * F.get(trailing, h)))

    def change(b: int, f: int) -> Column:
        base, future = y(b) / F.get(dummy, h + b), y(f) / F.get(dummy, h + f)
        return F.when((y(b) >= FLOOR) | (y(f) >= FLOOR), 2 * (future - base) / (future + base))

    last = min(LAST, steps - 1)
    spread = panel.select("id", "y", F.explode(F.sequence(F.lit(FIRST), F.lit(last))).alias("h"))
    rows = spread.select("id", "h", recent.alias("re"), *[change(b, f).alias(name) for name, (b, f) in zip(CHANGES, PAIRS, strict=True)])
    means = rows.groupBy("h").agg(*[F.avg(c).alias(f"_{c}") for c in CHANGES[2:]])
    joined = rows.join(F.broadcast(means), "h")
    return joined.select("id", "h", "re", "g1", "g5", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in CHANGES[2:]])


def banded(rows: DataFrame, bands: Sequence[tuple[int, int]], name: str) -> DataFrame:
    out = None
    for k, (a, b) in enumerate(bands):
        out = F.when(F.col("h").between(a, b), F.lit(k)) if out is None else out.when(F.col("h").between(a, b), F.lit(k))
    return rows.withColumn(name, out).filter(F.col(name).isNotNull())


def cross_section(rows: DataFrame, excess: bool = True, shared: bool = False) -> DataFrame:
    """grp (ssk_l1, ssk_l5), i age group, j recent-income bin, k (sd, skew, kurt), value: means of the two sub-bins."""
    binned = rank_bins(banded(rows, SUB_BINS, "sub"), ["sub"], ["re", "id", "h"], RECENT_EDGES, "bin", shared=shared)
    stats = []
    for g, grp in (("g1", "ssk_l1"), ("g5", "ssk_l5")):
        s = unbiased(F.col(g))
        stats += [F.coalesce(s["sd"], F.lit(0.0)).alias(f"{grp}|0"), F.coalesce(s["skew"], F.lit(0.0)).alias(f"{grp}|1"), F.coalesce(s["kurt"] + (0 if excess else 3), F.lit(0.0)).alias(f"{grp}|2")]
    names = [f"{g}|{k}" for g in ("ssk_l1", "ssk_l5") for k in range(3)]
    by_sub = binned.groupBy("sub", "bin").agg(*stats).unpivot(["sub", "bin"], names, "_n", "_v")
    by_age = by_sub.groupBy(F.floor(F.col("sub") / 2).cast("long").alias("i"), (F.col("bin") - 1).alias("j"), "_n").agg((F.sum("_v") / 2).alias("value"))
    return by_age.select(F.split("_n", r"\|")[0].alias("grp"), "i", "j", F.split("_n", r"\|")[1].cast("long").alias("k"), F.lit(0).cast("long").alias("l"), "value")


def impulses(rows: DataFrame, shared: bool = False) -> DataFrame:
    """grp ir, i age, j income bin, k shock bin, l horizon, value: means of the changes."""
    by_income = rank_bins(banded(rows, IMPULSE_AGES, "age"), ["age"], ["re", "id", "h"], IMPULSE_INCOME_EDGES, "inc", shared=shared)
    by_shock = rank_bins(by_income, ["age", "inc"], ["ir0", "re", "id", "h"], IMPULSE_SHOCK_EDGES, "chg", shared=shared)
    names = [f"{k}" for k in range(6)]
    means = by_shock.groupBy("age", "inc", "chg").agg(*[F.coalesce(F.avg(f"ir{k}"), F.lit(0.0)).alias(str(k)) for k in range(6)])
    return means.unpivot(["age", "inc", "chg"], names, "_l", "value").select(F.lit("ir").alias("grp"), F.col("age").cast("long").alias("i"), (F.col("inc") - 1).alias("j"), (F.col("chg") - 1).alias("k"), F.col("_l").cast("long").alias("l"), "value")


def lifetime(panel: DataFrame, shared: bool = False) -> tuple[DataFrame, DataFrame]:
    """(incgrowth cells, years-employed distribution in percent)."""
    floored = F.transform("y", lambda v: F.greatest(v, F.lit(FLOOR)))
    people = panel.select("id", F.size("y").alias("steps"), F.size(F.filter("y", lambda v: v >= FLOOR)).alias("emp"), floored.alias("f"))
    people = people.withColumn("lt", F.when(F.col("emp") >= LEAST_EMPLOYED, F.aggregate("f", F.lit(0.0), lambda a, v: a + v) / F.col("steps")))
    binned = rank_bins(people, [], ["lt", "id"], LIFETIME_EDGES, "bin", shared=shared)
    means = binned.groupBy("bin").agg(*[F.avg(F.get("f", F.lit(5 * k))).alias(str(k)) for k in range(8)])
    zero = F.lit(0).cast("long")
    growth = means.unpivot(["bin"], [str(k) for k in range(8)], "_j", "value").select(F.lit("incgrowth").alias("grp"), (F.col("bin") - 1).alias("i"), F.col("_j").cast("long").alias("j"), zero.alias("k"), zero.alias("l"), "value")
    return growth, years_employed(people)


def years_employed(people: DataFrame, steps: int = 36) -> DataFrame:
    """Percent of persons with at most i years employed, i = 0..steps: counts per year, then sums over that small table."""
    counts = people.groupBy("emp").agg(F.count(F.lit(1)).alias("c"))
    grid = people.sparkSession.range(steps + 1).select(F.col("id").alias("i"))
    total = counts.agg(F.sum("c").alias("t"))
    below = grid.join(F.broadcast(counts), F.col("emp") <= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("below"))
    zero = F.lit(0).cast("long")
    value = F.when(F.col("i") == steps, 100.0).otherwise(100.0 * F.col("below") / F.col("t"))
    return below.crossJoin(F.broadcast(total)).select(F.lit("emp_cdf").alias("grp"), "i", zero.alias("j"), zero.alias("k"), zero.alias("l"), value.alias("value"))


def all_moments(panel: DataFrame, excess: bool = True, shared: bool = False) -> DataFrame:
    """Tidy (grp, i, j, k, l, value) of every moment. shared: neighbouring rank bins share their edge row."""
    profile = age_profile(panel)
    zero = F.lit(0).cast("long")
    # 28 rows a person, which several rankings read
    rows = staged(long_panel(panel, _values(profile)), "panel-rows")
    variance = profile.select(F.lit("var_lny").alias("grp"), F.col("h").cast("long").alias("i"), zero.alias("j"), zero.alias("k"), zero.alias("l"), F.col("var_lny").alias("value"))
    growth, employed = lifetime(panel, shared)
    return reduce(DataFrame.unionByName, [cross_section(rows, excess, shared), impulses(rows, shared), growth, variance, employed])


# --- the same in numpy, for one panel of bounded size at a time -----------------------------------------------------------


def _bounds(n: int, edges: Sequence[float], shared: bool = False) -> list[tuple[int, int]]:
    at = [int(np.floor(round(n * (e - 1) / 100, 9))) for e in edges]
    at[-1] = n
    if shared:
        return [(a, min(b, n - 1) + 1) if min(b, n - 1) > a else (a, a) for a, b in zip(at, at[1:])]
    return list(zip(at, at[1:]))


def _shape(x: np.ndarray, excess: bool) -> tuple[float, float, float]:
    x = x[~np.isnan(x)]
    n = len(x)
    if n < 2:
        return 0.0, 0.0, 0.0
    d = x - x.mean()
    square = d * d
    m2, m3, m4 = square.mean(), (square @ d) / n, (square @ square) / n
    if m2 == 0:
        return 0.0, 0.0, 0.0 if excess else 3.0
    skew = m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else 0.0
    kurt = ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)) if n > 3 else 0.0
    return float(np.sqrt(m2 * n / (n - 1))), float(skew), float(kurt) + (0 if excess else 3)


def _shapes(order: np.ndarray, bounds: list[tuple[int, int]], changes: Sequence[np.ndarray], excess: bool) -> np.ndarray:
    """Shapes of each change in each bin of the order."""
    return np.array([[_shape(g[order[a:b]], excess) if b > a else (0.0, 0.0, 0.0) for a, b in bounds] for g in changes])


def _order(values: np.ndarray) -> np.ndarray:
    """Places of the values of a (steps, persons) block in ascending order without the missing ones; equal values by person and step."""
    flat = values.ravel()
    n = len(flat) - int(np.isnan(flat).sum())
    order = np.argsort(flat)[:n]
    found = flat[order]
    if (found[1:] == found[:-1]).any():
        order = np.argsort(values.T.ravel(), kind="stable")[:n]
        order = order % values.shape[0] * values.shape[1] + order // values.shape[0]
    return order


def moment_vector(y: np.ndarray, excess: bool = True, shared: bool = False) -> dict[str, np.ndarray]:
    """Tensors by group of an (n, steps) panel. Steps are rows inside, so that each is contiguous."""
    n, steps = y.shape
    z = np.ascontiguousarray(y.T)
    high = z >= FLOOR
    logs = np.log(z, where=high, out=np.zeros_like(z))
    count = high.sum(axis=1)
    few = count < 2
    mean = np.where(few, 0.0, logs.sum(axis=1) / np.maximum(count, 1))
    spread = np.where(high, logs - mean[:, None], 0.0)
    variance = np.where(few, 0.0, np.einsum("ij,ij->i", spread, spread) / np.maximum(count - 1, 1))
    dummy = np.exp(mean)
    floored = np.maximum(z, FLOOR)
    normal = z / dummy[:, None]
    last = min(LAST, steps - 1)
    hs = range(FIRST, last + 1)
    recent = np.full((len(hs), n), np.nan)
    changes = np.full((8, len(hs), n), np.nan)
    with np.errstate(all="ignore"):
        for r, h in enumerate(hs):
            window = slice(max(0, h - 4), h + 1)
            ok = high[h] & (high[window].sum(axis=0) >= LEAST_RECENT)
            np.copyto(recent[r], floored[window].sum(axis=0) / (dummy[window].mean() * (h + 1 - window.start)), where=ok)
            for c, (b, f) in enumerate(PAIRS):
                if h + f < steps:
                    own = high[h + b] | high[h + f]
                    g = 2 * (normal[h + f] - normal[h + b]) / (normal[h + f] + normal[h + b])
                    if c >= 2:
                        g -= np.sum(g, where=own) / max(1, np.count_nonzero(own))
                    np.copyto(changes[c, r], g, where=own)
    out = {"ssk_l1": np.zeros((3, 13, 3)), "ssk_l5": np.zeros((3, 13, 3)), "ir": np.zeros((2, 8, 10, 6)), "incgrowth": np.zeros((15, 8)), "var_lny": variance}
    for s, (a, b) in enumerate(SUB_BINS):
        own = slice(a - FIRST, min(b, last) + 1 - FIRST)
        order = _order(recent[own])
        found = _shapes(order, _bounds(len(order), RECENT_EDGES, shared), [changes[c, own].ravel() for c in (0, 1)], excess) / 2
        out["ssk_l1"][s // 2] += found[0]
        out["ssk_l5"][s // 2] += found[1]
    for i, (a, b) in enumerate(IMPULSE_AGES):
        own = slice(a - FIRST, min(b, last) + 1 - FIRST)
        ir, order = changes[2:, own].reshape(6, -1), _order(recent[own])
        for j, (low, top) in enumerate(_bounds(len(order), IMPULSE_INCOME_EDGES, shared)):
            rows = order[low:top]
            rows = rows[~np.isnan(ir[0, rows])]
            # rows are in the order of recent income, person and step already
            part = ir[:, rows[np.argsort(ir[0, rows], kind="stable")]]
            seen = ~np.isnan(part)
            part = np.where(seen, part, 0.0)
            for k, (x, w) in enumerate(_bounds(len(rows), IMPULSE_SHOCK_EDGES, shared)):
                if w > x:
                    out["ir"][i, j, k] = part[:, x:w].sum(axis=1) / np.maximum(1, seen[:, x:w].sum(axis=1))
    employed = high.sum(axis=0)
    life = np.where(employed >= LEAST_EMPLOYED, floored.mean(axis=0), np.nan)
    order = np.argsort(life, kind="stable")[: int((~np.isnan(life)).sum())]
    ages = floored[0 : min(40, steps) : 5][:8]
    for j, (low, top) in enumerate(_bounds(len(order), LIFETIME_EDGES, shared)):
        if top > low:
            out["incgrowth"][j] = ages[:, order[low:top]].mean(axis=1)
    cdf = 100 * np.searchsorted(np.sort(employed), np.arange(steps + 1), side="right") / n
    cdf[-1] = 100.0
    return out | {"emp_cdf": cdf}
