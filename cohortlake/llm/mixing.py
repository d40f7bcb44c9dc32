"""Mixing sources to target weights by hash-random keys, range order and distributed prefix sums (DataFrame functions only).

Every document gets a pseudo-random key from its id. Within a source, keys are cut into equal ranges of about `range_rows`
documents; each range is one sort group, and the offsets of the ranges are prefix sums over their totals. A source of any size is
thus sorted by many tasks. A source's budget takes whole epochs of all its documents and then the documents in key order up to
the exact word; the document that the budget ends in is taken in part.

Defined cases: a null text has size 0; null sources form one source, which comes last; equal keys (repeated ids) are ordered by
id, then size; rows that agree in all of them are taken one after another; an empty table gives no rows. Sources without words
have target 0. A null id is an id like another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import staged, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
KEY_RANGE = float(1 << 48)


def random_key(column: str = "doc_id", seed: str = "mix") -> Column:
    """A whole number below 2**48, from the md5 of seed and id: the same in every run, plan and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, rows, source_size, target. Targets above `most` times the source's size are cut there and the excess is shared
    out again by weight among the others. With the sources in order of size a unit of weight, the cut ones are a prefix: a
    source is cut when the budget left by its predecessors, spread over the weight from it on, exceeds what it can give."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").cast("double").alias("source_size"))
    # Windows over one row per source: the number of sources, not of documents.
    everything = Window.partitionBy()
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", F.col("source_size") * most).withColumn("budget", F.sum("source_size").over(everything) * share)
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.greatest(F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("unit", F.col("left") / F.col("open")).withColumn("cut", F.col("limit") <= F.col("unit") * F.col("weight"))
    unit = F.min(F.when(~F.col("cut"), F.struct(F.col("limit") / F.col("weight"), F.col("unit")))).over(everything)
    return ranked.select("source", "rows", "source_size", F.when(F.col("cut"), F.col("limit")).otherwise(F.col("weight") * unit["unit"]).alias("target"))


def taken_words(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, range_rows: int) -> DataFrame:
    """The rows of staged sizes (source, doc_id, size, key and others) with source_size, target and taken."""
    targets = staged(source_targets(sizes, weights, share, most), "mix-targets")
    parts = F.greatest(F.ceil(F.col("rows") / range_rows), F.lit(1))
    keyed = sizes.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn("part", F.floor(F.col("key") * parts / KEY_RANGE).cast("bigint"))
    offsets = keyed.groupBy("source", "part").agg(F.sum("size").alias("total"))
    offsets = offsets.select(F.col("source").alias("own"), F.col("part").alias("own_part"), (F.sum("total").over(Window.partitionBy("source").orderBy("part")) - F.col("total")).alias("offset"))
    in_part = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("within", F.sum("size").over(in_part) - F.col("size")).join(offsets, F.col("source").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")))
    budget = F.floor(F.col("target")).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size").cast("bigint")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("within"))).cast("bigint")
    return placed.select(*sizes.columns, F.col("source_size").cast("bigint").alias("source_size"), "target", (epochs * F.col("size") + part_taken).alias("taken"))


def size_columns(seed: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), random_key(seed=seed).alias("key")]


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, range_rows: int = 2048, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document. The floor of each target is taken exactly."""
    # One pass over the texts; all later steps read this narrow table.
    sizes = staged(docs.select(*size_columns(seed)), "mix-sizes")
    return taken_words(sizes, weights, share, most, range_rows).drop("key")


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, range_rows: int = 2048, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, the one that a budget ends in cut to the words taken of it (its
    words joined by blanks). Documents of which nothing is taken go, so those without words do; columns are those of docs, of any
    names. Ids may be null or repeat: rows are told apart by a number that is given once, when they are staged. An empty table
    stays empty."""
    row = F.monotonically_increasing_id().alias("row")
    rows = staged(docs.select(whole_row(docs).alias("doc"), F.struct(*size_columns(seed), row).alias("mix")), "mix-rows")
    taken = taken_words(rows.select("mix.*"), weights, share, most, range_rows).filter("taken > 0").select(F.col("row").alias("own"), "size", "taken")
    # the rows taken grow with the data, so they are never broadcast
    joined = rows.select("doc", F.col("mix.row").alias("row")).join(taken.hint("merge"), F.col("row") == F.col("own"))
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")))))
    kept = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    whole = F.col("doc")["text"]
    text = F.when(kept >= F.col("size"), whole).otherwise(F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), 1, kept.cast("int")), " "))
    return copies.select(*[text.alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
