"""Sources: tables, delimited text, whitespace matrices and tensors, JSON records, arrays and inline rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.session import staged

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """A Parquet table; the columns and the filter reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df if where is None else df.filter(where)
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or tab-separated text with a given schema (no inference pass)."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, i (from 0), line of the lines that are not blank, in the files' order. A file is read in as many splits as Spark makes of it:
    lines are counted within each split, and start where the splits before it end. Lines are staged, so that both steps see the same."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    # ids count the rows of a task from its own start on, which the least id of a split takes away again
    held = staged(lines.filter(F.length("line") > 0).withColumn("_id", F.monotonically_increasing_id()), "lines")
    splits = held.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_lines"), F.min("_id").alias("_first"))
    before = F.sum("_lines").over(Window.partitionBy("file").orderBy("_block")) - F.col("_lines")  # a row a split
    places = splits.select("file", "_block", (before - F.col("_first")).alias("_shift"))
    return held.join(places, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("i"), "line")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, value (from 0) of a whitespace-separated matrix file of any size; numbers may lack a leading zero, the last line its end."""
    rows = numbered_lines(spark, path)
    return rows.select("i", F.posexplode(F.split("line", " ")).alias("j", "x")).select(F.col("i").cast("long"), F.col("j").cast("long"), F.expr("try_cast(x as double)").alias("value"))


def matrix_shape(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, least and most columns, and cells that are no numbers, for each file: what a reader checks before it reshapes."""
    cells = F.split("line", " ")
    bad = F.size(F.filter(cells, lambda x: x.try_cast("double").isNull()))
    return numbered_lines(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size(cells)).cast("long").alias("least"), F.max(F.size(cells)).cast("long").alias("most"), F.sum(bad).alias("bad"))


def tensor(cells: DataFrame, shape: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Matrix cells as the cells of a row-major tensor of the shape: the row index is cut into the leading indices."""
    out, rest = cells, F.col("i")
    columns = []
    for size, name in zip(reversed(shape[:-1]), reversed(names[:-1]), strict=True):
        columns.append((rest % size).cast("long").alias(name))
        rest = F.floor(rest / size)
    return out.select(*reversed(columns), F.col("j").alias(names[-1]), "value")


def moment_file(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(group, i, j, k, l, value) of a target-moment file: 39x3 -> (3, 13, 3), 368x6 -> (2, 8, 23, 6), 15x8, and vectors."""
    cells = matrix(spark, path)
    zero = F.lit(0).cast("long")
    if group.startswith("ssk"):
        cells = tensor(cells, (3, 13, 3), ("i", "j", "k")).withColumn("l", zero)
    elif group == "ir":
        cells = tensor(cells, (2, 8, 23, 6), ("i", "j", "k", "l"))
    elif group == "incgrowth":
        cells = cells.withColumn("k", zero).withColumn("l", zero)
    else:
        cells = cells.withColumn("i", F.col("i") + F.col("j")).withColumn("j", zero).withColumn("k", zero).withColumn("l", zero)
    return cells.select(F.lit(group).alias("grp"), "i", "j", "k", "l", "value")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder of JSON files; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def npy_rows(spark: SparkSession, file: str) -> DataFrame:
    """i, y of a stored numpy matrix (driver-side file of bounded size)."""
    import numpy as np

    data = np.atleast_2d(np.load(file))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "i long, y array<double>")


def excel_sheet(spark: SparkSession, file: str, sheet: str | int = 0) -> DataFrame:
    """A worksheet through pandas, where an Excel reader is installed."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(file, sheet_name=sheet))
    except ImportError as e:
        raise NotImplementedError("no Excel reader is installed") from e


def arrow_table(spark: SparkSession, data) -> DataFrame:
    return spark.createDataFrame(data)


def inline(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def grid(spark: SparkSession, **axes: Iterable) -> DataFrame:
    """The product of small axes, one column each."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out
