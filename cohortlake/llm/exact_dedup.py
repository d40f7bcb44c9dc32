"""Exact deduplication with a heavy-hitter split.

Texts are equal when they agree after lower-casing A-Z. Digests (SHA-256 of the lowered UTF-8 bytes) are computed in one pass over
the texts. Misra-Gries summaries of the partitions name the frequent digests; with k counters the summed counters of at most k + 1
digests can reach rows / (k + 1), and every digest with twice as many rows does, so the candidates are at most k + 1 by proof.
Their exact counts and winners are verified by a second pass over the digests and broadcast; rows with other digests, none of
which has more than 2 / (k + 1) of all rows, use an ordinary shuffle.

Defined cases: null text equals the empty text. Of rows with the winning id, all are marked kept (repeated rows of one id). A
null id loses against any other; a group of null ids has a null keep_id and all its rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import rows_of, staged, text_key, utf8


def text_digests(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id and the digest of each text; keyed adds text_key, which tells texts apart that differ in case."""
    carried, schema = (["doc_id", "text_key"], "doc_id long, text_key binary, ") if keyed else (["doc_id"], "doc_id long, ")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bytes.lower() changes A-Z only
            found = [hashlib.sha256(x.lower()).digest() for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(found, pa.binary())], names=[*carried, "digest"])

    own = [F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key")][: len(carried)]
    return docs.select(*own, "text").mapInArrow(digest, schema + "digest binary")


def misra_gries(counts: Counter, items: list[bytes], k: int) -> None:
    """Add items to the summary of at most k counters, in place: a batch is counted first, then the (k + 1)-th largest count
    is taken from all, which is the summary's merge rule."""
    counts.update(items)
    if len(counts) > k:
        least = sorted(counts.values(), reverse=True)[k]
        for key in list(counts):
            if counts[key] <= least:
                del counts[key]
            else:
                counts[key] -= least


def heavy_digests(digests: DataFrame, k: int) -> list[tuple[bytes, int, int]]:
    """(digest, rows, largest id) of the verified frequent digests: at most k + 1, with all that have 2 / (k + 1) of the rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            misra_gries(counts, batch.column("digest").to_pylist(), k)
        yield pa.RecordBatch.from_arrays([pa.array([b"", *counts], pa.binary()), pa.array([rows, *counts.values()], pa.int64())], names=["digest", "n"])

    summed = digests.select("digest").mapInArrow(summarise, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    summed = staged(summed, "dedup-summary")  # at most k rows a partition; the empty digest carries the row count
    total = (summed.filter(F.length("digest") == 0).agg(F.sum("n")).first() or [0])[0] or 0
    candidates = [r[0] for r in summed.filter((F.length("digest") > 0) & (F.col("n") > max(1, total / (k + 1)))).select("digest").collect()]
    if not candidates:
        return []
    few = F.broadcast(digests.sparkSession.createDataFrame([(bytes(x),) for x in candidates], "digest binary"))
    exact = digests.join(few, "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    return [(bytes(r[0]), r[1], r[2]) for r in exact.collect()]


def grouped(digests: DataFrame, counters: int) -> DataFrame:
    """The rows of staged digests with n and top, the rows and the largest id of their digest."""
    spark: SparkSession = digests.sparkSession
    winners = F.broadcast(spark.createDataFrame(heavy_digests(digests, counters), "digest binary, n long, top long"))
    heavy = digests.join(winners, "digest", "left").filter("n is not null").select(*digests.columns, "n", "top")
    rest = digests.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    return heavy.unionByName(rest.join(groups, "digest").select(*digests.columns, "n", "top"))


def exact_duplicates(docs: DataFrame, *, counters: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = grouped(staged(text_digests(docs), "dedup-digests"), counters)
    return rows.select("doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, *, counters: int = 1024) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts; columns are those of docs. Null and empty texts are equal. Ids may be
    null (a null id loses against any other) or repeat: of the group's rows with the winning id the one with the least text key
    stays. An empty table stays empty; columns may have any names."""
    rows = grouped(staged(text_digests(docs, keyed=True), "dedup-digests"), counters).filter(F.col("doc_id").eqNullSafe(F.col("top")))
    kept = rows.groupBy("digest").agg(F.min("top").alias("id"), F.min("text_key").alias("key"), F.count(F.lit(1)).alias("rows"))
    return rows_of(docs, staged(kept.drop("digest"), "dedup-kept"))
