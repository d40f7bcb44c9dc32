"""Column housekeeping: wildcards, renames per wave, order, labels, narrow types."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, *patterns: str) -> list[str]:
    """Columns that fit any wildcard pattern (* any run, ? one character), in the table's order."""
    tests = [re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)) for p in patterns]
    return [c for c in df.columns if any(t.fullmatch(c) for t in tests)]


def keep(df: DataFrame, *patterns: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in matching(df, *patterns)])


def drop(df: DataFrame, *patterns: str) -> DataFrame:
    return df.drop(*matching(df, *patterns))


def ordered(df: DataFrame, *first: str) -> DataFrame:
    """The named columns first, the others after them as they stand."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def labelled(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Column comments as metadata, which Parquet keeps."""
    return df.select(*[F.col(c).alias(c, metadata={"label": labels[c]}) if c in labels else F.col(c) for c in df.columns])


def compressed(df: DataFrame) -> DataFrame:
    """Whole-number columns in the narrowest type that holds their extremes (one pass, one row to the driver)."""
    whole = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("smallint", "int", "bigint")]
    if not whole:
        return df
    ends = df.agg(*[x for c in whole for x in (F.min(c), F.max(c))]).first()
    kinds = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}
    out = {}
    for k, c in enumerate(whole):
        low, high = ends[2 * k] or 0, ends[2 * k + 1] or 0
        out[c] = F.col(c).cast(next(name for name, bits in kinds.items() if -(1 << bits) <= low and high < 1 << bits))
    return df.withColumns(out)


def waves(frames: Mapping[int, DataFrame], names: Mapping[int, Mapping[str, str]], year: str = "year") -> DataFrame:
    """One table of several waves: each with its own codes renamed to common names, its year, and nulls for what it lacks."""
    out = None
    for t, df in frames.items():
        chosen = df.select(*[F.col(code).alias(name) for code, name in names[t].items()]).withColumn(year, F.lit(t))
        out = chosen if out is None else out.unionByName(chosen, allowMissingColumns=True)
    return out


def zero_filled(df: DataFrame, *patterns: str) -> DataFrame:
    """Missing numbers of matching columns become zero."""
    return df.na.fill(0, subset=matching(df, *patterns))


def recoded_sentinels(df: DataFrame, columns: Sequence[str], digits: int, flag: str | None = None) -> DataFrame:
    """Codes of repeated nines at a field's width: ...9 is missing, ...8 is missing, ...7 was cut at the top (kept and flagged)."""
    nines = 10**digits - 1
    out = df
    if flag:
        cut = F.greatest(*[F.coalesce((F.col(c) == nines - 2).cast("int"), F.lit(0)) for c in columns], F.lit(0))
        out = out.withColumn(flag, cut)
    return out.withColumns({c: F.when(F.col(c).isin(nines, nines - 1), None).otherwise(F.col(c)) for c in columns})
