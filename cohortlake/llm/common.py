"""Helpers shared by the text operators: staging tables, word splitting and Arrow access."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a local session names no shared folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/cohortlake"
#: Folders written by staged() in this process that still stand.
STAGED: list[str] = []

#: A key is hot if it has more than this share of all rows, and more rows than one task takes easily.
HOT_SHARE = 1 / 1000
HOT_ROWS = 10_000

_WORD = frozenset([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: Byte table of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: all else becomes a blank.
#: Every byte of a non-ASCII code point is at least 0x80, so UTF-8 bytes and code points give the same words.
WORD_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _WORD else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. A local session without one (tests) takes a local folder; on a cluster
    that would lose rows, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder, noted for removal."""
    STAGED.append(path := f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return path


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: the lineage ends in files that outlive executors."""
    path = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession, before: int = 0) -> None:
    """Delete the folders staged by this process after the first `before` ones. DataFrames that read them are of no use then, so
    call it when results have been written."""
    jvm = spark._jvm
    for path in STAGED[before:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del STAGED[before:]


@atexit.register
def _remove_at_exit() -> None:
    """Remove what still stands. A session that was stopped before leaves local folders only to remove; those of a shared store that
    outlive their session are the cluster's to clear."""
    spark = SparkSession.getActiveSession()
    if STAGED and spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            remove_staged(spark)
    for path in STAGED:
        if "://" not in path.removeprefix("file://"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def hot_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with a staged table of one row for each key, whose _rows tells how many rows have it (and is dropped). Keys with
    more than HOT_SHARE of the rows are at most 1 / HOT_SHARE by count: their part of the table is broadcast and their rows
    stay where they are; all other rows are shuffled on the key."""
    most, total = table.agg(F.max("_rows"), F.sum("_rows")).first()
    least = max(HOT_ROWS, (total or 0) * HOT_SHARE)
    if (most or 0) <= least:
        return rows.join(table.drop("_rows"), key)
    hot = F.broadcast(table.filter(F.col("_rows") > least).drop("_rows"))
    cold = rows.join(hot.select(key), key, "left_anti").join(table.filter(F.col("_rows") <= least).drop("_rows").hint("merge"), key)
    return rows.join(hot, key).unionByName(cold)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can clash with them."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_key() -> Column:
    """SHA-256 of the text as it is stored; null counts as empty. With the id it names a row up to its copies, null ids included."""
    return F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs with an id and text key of chosen (id, key, rows; distinct), one for each; columns are those of docs."""
    # the chosen rows grow with the data, so they are never broadcast
    rows = docs.select(whole_row(docs).alias("doc"), F.col("doc_id").cast("bigint").alias("own_id"), text_key().alias("own_key"))
    out = rows.join(chosen.select("id", "key").hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    return (out if chosen.filter("rows > 1").isEmpty() else out.dropDuplicates(["own_id", "own_key"])).select("doc.*")


def words(data: bytes) -> list[bytes]:
    """Lower-cased alphanumeric words of UTF-8 bytes."""
    return data.translate(WORD_TABLE).split()


def blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to `most`, or single larger items."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def id_remainder(divisor: int, column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor
