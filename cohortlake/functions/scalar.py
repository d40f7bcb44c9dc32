"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column, limit: float = 500.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -limit, limit)))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def arc_change(now: Column, base: Column, scale: float = 2.0) -> Column:
    """scale * (now - base) / (now + base); null where the sum is zero."""
    return F.try_divide(scale * (now - base), now + base)


def significant(x: Column, digits: int) -> Column:
    """x rounded to so many significant digits."""
    power = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)


def row_total(columns: Iterable[str]) -> Column:
    """A sum that counts missing as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def row_sum(columns: Iterable[str]) -> Column:
    """A sum that is missing where any part is."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def recode(x: Column, mapping: Mapping, default: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(x if default is None else default)


def recode_ranges(x: Column, ranges: Sequence[tuple[float, float, int]]) -> Column:
    """Inclusive ranges (low, high, code); later ones win where they overlap."""
    out = None
    for low, high, code in reversed(ranges):
        out = F.when(x.between(low, high), F.lit(code)) if out is None else out.when(x.between(low, high), F.lit(code))
    return out.otherwise(F.lit(None))


def sentinels(x: Column, missing: Sequence, zero: Sequence = ()) -> Column:
    """Codes for missing become null, codes for none become zero."""
    return F.when(x.isin(*missing), F.lit(None)).when(x.isin(*zero), F.lit(0)).otherwise(x) if zero else F.when(x.isin(*missing), F.lit(None)).otherwise(x)


def annual_factor(code: Column) -> Column:
    """Payments a year of a reporting-frequency code; other codes count as none."""
    return recode(code, {3: 52, 4: 26, 5: 12, 6: 1}, F.lit(0))


def uniform(seed: str, *keys: Column) -> Column:
    """A reproducible number in [0, 1) from keys: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def md5_uniform(seed: str, *keys: Column) -> Column:
    """As uniform, from a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])), 1, 12), 16, 10).cast("bigint") / float(1 << 48)


def md5_normal(seed: str, other: str, *keys: Column) -> Column:
    """A standard normal number from two such digests, by the polar transform."""
    return F.sqrt(-2 * F.ln(1 - md5_uniform(seed, *keys))) * F.cos(2 * F.pi() * md5_uniform(other, *keys))


def topcode_features(x: Column, cap: Column, floor: Column, name: str) -> dict[str, Column]:
    """Regressors for imputing capped incomes: top (at the cap), zero (below the floor), the log of income (zero below the floor, and
    of half the floor at least), and that log cut at the cap's."""
    zero = x < floor
    log = F.when(zero, F.lit(0.0)).otherwise(F.ln(F.greatest(x, 0.5 * floor)))
    return {"top": (x >= cap).cast("int"), "zero": zero.cast("int"), f"ln_{name}": log, "ln_top": F.least(log, F.ln(cap))}


def polynomial(columns: Sequence[str]) -> dict[str, Column]:
    """Linear, squared and cross terms of the columns."""
    out = {c: F.col(c) for c in columns}
    out |= {f"{c}_2": F.col(c) * F.col(c) for c in columns}
    return out | {f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(columns) for b in columns[i + 1 :]}


def bound_penalty(x: Column, low: float, high: float, weight: float) -> Column:
    over = F.greatest(F.lit(low) - x, F.lit(0.0)) + F.greatest(x - high, F.lit(0.0))
    return weight * over * over


def age_bin(age: Column, first: int = 25, width: int = 5, bins: int = 7) -> Column:
    """Bins of equal width from `first`; the last takes the rest."""
    return F.least(F.floor((age - first) / width) + 1, F.lit(bins)).cast("long")
