"""Moment and shape statistics. Several conventions of skewness and kurtosis are in use; each has its own name.

raw            population skewness m3/m2^1.5, raw kurtosis m4/m2^2
unbiased       bias-corrected skewness and excess kurtosis, zero below the numbers that define them
sampled        moments about the mean over powers of the sample standard deviation, raw kurtosis
population     as raw, beside the population standard deviation
arc            bias-corrected skewness and raw bias-corrected kurtosis, null below three values
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(x: Column) -> Column:
    return F.count(x)


def skew_unbiased(x: Column) -> Column:
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2)


def kurt_unbiased_excess(x: Column) -> Column:
    n = F.count(x)
    return ((n + 1.0) * F.kurtosis(x) + 6) * (n - 1.0) / ((n - 2.0) * (n - 3.0))


def raw(x: Column) -> dict[str, Column]:
    return {"n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x), "skew": F.skewness(x), "kurt": F.kurtosis(x) + 3}


def unbiased(x: Column) -> dict[str, Column]:
    n = F.count(x)
    return {
        "sd": F.when(n < 2, 0.0).otherwise(F.stddev_samp(x)),
        "skew": F.when((n < 3) | (F.max(x) == F.min(x)), 0.0).otherwise(F.when(n >= 3, skew_unbiased_safe(x))),
        "kurt": F.when((n < 4) | (F.max(x) == F.min(x)), 0.0).otherwise(kurt_unbiased_safe(x)),
    }


def skew_unbiased_safe(x: Column) -> Column:
    n = F.count(x)
    return F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1.0)), (n - 2.0))


def kurt_unbiased_safe(x: Column) -> Column:
    n = F.count(x)
    return F.try_divide(((n + 1.0) * F.kurtosis(x) + 6) * (n - 1.0), (n - 2.0) * (n - 3.0))


def sampled(x: Column) -> dict[str, Column]:
    n = F.count(x)
    shrink = F.try_divide(n - 1.0, n)
    return {"sd": F.stddev_samp(x), "skew": F.skewness(x) * F.pow(shrink, F.lit(1.5)), "kurt": (F.kurtosis(x) + 3) * shrink * shrink}


def population(x: Column) -> dict[str, Column]:
    return {"sd": F.stddev_pop(x), "skew": F.skewness(x), "kurt": F.kurtosis(x) + 3}


def arc(x: Column) -> dict[str, Column]:
    n = F.count(x)
    return {"sd": F.when(n >= 3, F.stddev_samp(x)), "skew": F.when(n >= 3, skew_unbiased_safe(x)), "kurt": F.when(n > 3, kurt_unbiased_safe(x) + 3)}


CONVENTIONS: Mapping[str, Callable[[Column], dict[str, Column]]] = {"raw": raw, "unbiased": unbiased, "sampled": sampled, "population": population, "arc": arc}

#: Names that callers may list instead of expressions.
REGISTRY: Mapping[str, Callable[[Column], Column]] = {
    "n": F.count, "mean": F.avg, "sd": F.stddev_samp, "sd_pop": F.stddev_pop, "var": F.var_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": lambda x: F.percentile(x, 0.5),
    "skew": F.skewness, "kurt": lambda x: F.kurtosis(x) + 3, "skew_unbiased": skew_unbiased_safe, "kurt_excess": kurt_unbiased_safe,
    "meanlog": lambda x: F.avg(F.ln(x)), "sdlog": lambda x: F.stddev_samp(F.ln(x)), "skewlog": lambda x: skew_unbiased_safe(F.ln(x)), "kurtlog": lambda x: kurt_unbiased_safe(F.ln(x)),
    # percentiles by the linear rule; functions.quantiles has the others
    "p10": lambda x: F.percentile(x, 0.10), "p25": lambda x: F.percentile(x, 0.25), "p50": lambda x: F.percentile(x, 0.50), "p75": lambda x: F.percentile(x, 0.75), "p90": lambda x: F.percentile(x, 0.90), "p98": lambda x: F.percentile(x, 0.98),
}


def group_stats(df: DataFrame, keys: list[str], value: str, convention: str = "raw", total: bool = False, extremes: bool = True) -> DataFrame:
    """Statistics of a value by group; `total` adds a row with null keys over all rows, in the same pass over the input."""
    x = F.col(value)
    stats = {"n": F.count(x), "mean": F.avg(x)} | CONVENTIONS[convention](x)
    if extremes:
        stats |= {"min": F.min(x), "max": F.max(x)}
    columns = [c.alias(k) for k, c in stats.items()]
    if not total:
        return df.groupBy(*keys).agg(*columns)
    return df.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*columns)


def aggregate(df: DataFrame, keys: list[str], value: str, names: list[str | tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Named statistics, or (name, function) pairs, by group."""
    pairs = [(x, REGISTRY[x]) if isinstance(x, str) else x for x in names]
    return df.groupBy(*keys).agg(*[f(F.col(value)).alias(k) for k, f in pairs])


def kelley(p10: Column, p50: Column, p90: Column) -> Column:
    return F.try_divide((p90 - p50) - (p50 - p10), p90 - p10)


def moors(p12: Column, p25: Column, p37: Column, p62: Column, p75: Column, p87: Column) -> Column:
    return F.try_divide((p87 - p62) + (p37 - p12), p75 - p25)


def crow(p2: Column, p25: Column, p75: Column, p97: Column) -> Column:
    return F.try_divide(p97 - p2, p75 - p25)
