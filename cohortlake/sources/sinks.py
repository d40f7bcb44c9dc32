"""Sinks: tables, delimited text, tensors, appended results and small metadata files."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_text(df: DataFrame, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None, sep: str = "\t", header: bool = True) -> None:
    """Delimited text of chosen rows and columns."""
    df = df if where is None else df.filter(where)
    (df.select(*columns) if columns else df).write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def append_result(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_tensor(cells: DataFrame, path: str, index: Sequence[str], value: str = "value") -> None:
    """A tensor of any rank in tidy form, in the order of its indices."""
    cells.select(*index, value).orderBy(*index).write.mode("overwrite").option("header", True).csv(path)


def write_json_atomically(record: dict, file: str) -> None:
    """A small driver-side record: readers see the old file or the new one."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(file) or ".")
    with os.fdopen(handle, "w") as f:
        json.dump(record, f)
    os.replace(temporary, file)


def export_excel(df: DataFrame, file: str) -> None:
    try:
        df.toPandas().to_excel(file, index=False)
    except ImportError as e:
        raise NotImplementedError("no Excel writer is installed") from e
