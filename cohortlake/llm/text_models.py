"""Bounded training samples and deterministic choices shared by the text models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import staged

#: The hash threshold lets through so many times the rows that are wanted.
MARGIN = 4
HASHES = float(1 << 53)


def id_hash(column: str = "doc_id") -> Column:
    """A number in [0, 2**53) from the id: the same order in every plan."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 53))


def sampled_ids(rows: DataFrame, label: str | None, most: int) -> list[int]:
    """At most `most` distinct ids of each label (or of all rows), in the order of a hash of the id. Rows are counted first, so
    that a threshold on the hash leaves about MARGIN * most candidates to rank, however large the table."""
    keys = [label] if label else []
    ids = rows.select("doc_id", *keys).distinct().withColumn("_hash", id_hash())
    counts = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    near = ids.join(F.broadcast(counts), keys) if keys else ids.crossJoin(F.broadcast(counts))
    near = near.filter(F.col("_hash") <= F.greatest(F.lit(float(MARGIN * most)) / F.col("_rows"), F.lit(0.0)) * HASHES)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("_hash", "doc_id"))).filter(F.col("_rank") <= most)
    return [r[0] for r in ranked.select("doc_id").distinct().collect()]


def training_rows(docs: DataFrame, labelled: DataFrame | None, label: str, per_label: int) -> list:
    """At most per_label rows of docs (doc_id, text, ...) for each value of `label`, with their whole texts. The label is a column of
    docs, or of `labelled` by doc_id; rows without an id or a label do not serve. Ids are chosen on narrow rows; texts of the
    chosen ones alone move."""
    own = [label] if labelled is None else []
    narrow = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", *own)
    if labelled is not None:
        narrow = narrow.join(labelled.select("doc_id", label), "doc_id")
    narrow = staged(narrow.filter(F.col(label).isNotNull()), "training-ids")
    chosen = sampled_ids(narrow, label, per_label)  # labels x per_label at most
    few = F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in chosen], "doc_id long"))
    texts = docs.join(few, "doc_id")
    if labelled is not None:
        texts = texts.join(F.broadcast(labelled.join(few, "doc_id").select("doc_id", label).distinct()), "doc_id")
    rest = [c for c in texts.columns if c not in ("doc_id", label)]
    one = texts.filter(F.col(label).isNotNull()).groupBy("doc_id", label).agg(F.min(F.struct(*rest)).alias("_row"))  # of a repeated id the least text
    return one.select("doc_id", label, "_row.*").orderBy(id_hash(), "doc_id", label).collect()
