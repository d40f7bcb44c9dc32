"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 have a common neighbour at distance 1 from both. So every distinct fingerprint emits all variants
within half the radius, rows shuffle on the variants, and all that meet in one variant are within 2 of each other: each is
linked to the least of them, a star instead of all pairs, and no link of the class is lost.

The radius 3 is odd. A pair at distance exactly 3 differs inside at least one of three blocks of the 64 bits; erasing such a block
leaves at most 2 differing bits, so the punctured fingerprints meet in a variant within 1 again. A punctured variant whose
fingerprints all are in one component already says nothing new. In nearly all others few fingerprints stand outside the group's
largest component: up to PAIRED of them are compared with the rest of the group, which never pairs a component with itself. Where
more stand outside, the group's fingerprints emit the full ball of radius 1 to one side and of radius 2 to the other; those that
meet are within 3, and a star per variant links them. Every link is verified by bit count.

Defined cases: null or empty text (no words) has fingerprint zero, which links like any other; under `shingle` words the whole
sequence is the one shingle; repeated rows share a fingerprint; null ids lose against any other for component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import hot_join, rows_of, staged, text_key, utf8

BITS = 64
SEED = 42
#: Bit ranges [from, to) that are erased in turn.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Groups with up to so many members outside their largest component are compared directly, others through balls; both ways find
#: every link.
PAIRED = 32


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of lowered UTF-8 text as a signed 64-bit number."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    hash_ = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):  # bounds the memory of very long texts
        own = tokens[at : min(at + 8192, n) + shingle - 1]
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        starts = ends[: max(1, len(own) - shingle + 1)] - np.fromiter(map(len, own[: max(1, len(own) - shingle + 1)]), np.int64) - 1
        stops = ends[min(shingle, len(own)) - 1 :] - 1
        hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keyed: bool = False) -> DataFrame:
    """doc_id, fp of each row; keyed adds text_key."""
    carried, schema = (["doc_id", "text_key"], "doc_id long, text_key binary, ") if keyed else (["doc_id"], "doc_id long, ")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle) for x in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, carried), pa.array(found, pa.int64())], names=[*carried, "fp"])

    own = [F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key")][: len(carried)]
    return docs.select(*own, "text").mapInArrow(compute, schema + "fp long")


def flips(radius: int, bits: list[int]) -> list[int]:
    """Masks of at most `radius` (1 or 2) of the bits, zero included."""
    one = [1 << b for b in bits]
    two = [x | y for i, x in enumerate(one) for y in one[i + 1 :]] if radius > 1 else []
    return [signed(x) for x in [0, *one, *two]]


def variants(fp: str, radius: int) -> Column:
    masks = F.array(*(F.lit(x).cast("bigint") for x in flips(radius, list(range(BITS)))))
    return F.transform(masks, lambda m: F.col(fp).bitwiseXOR(m))


def punctured(fp: str) -> Column:
    """A key for each erased block and each flip of at most one bit outside it; the erased bits hold the block's number."""

    def of_block(k: int, low: int, high: int) -> Column:
        keep = F.lit(signed(((1 << BITS) - 1) ^ (((1 << (high - low)) - 1) << low))).cast("bigint")
        masks = [signed((x & ((1 << BITS) - 1)) ^ (k << low)) for x in flips(1, [b for b in range(BITS) if not low <= b < high])]
        return F.transform(F.array(*(F.lit(x).cast("bigint") for x in masks)), lambda m: F.col(fp).bitwiseAND(keep).bitwiseXOR(m))

    return F.concat(*(of_block(k, *b) for k, b in enumerate(BLOCKS)))


def stars(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: links to the least of those that meet in a variant, which are within 1 + radius of it. At most 1 + 64 (radius 1) or
    2081 (radius 2) distinct fingerprints surround a variant, so a window over one is bounded whatever the data."""
    at = Window.partitionBy("variant")
    if radius == 1:
        met = nodes.select("fp", F.explode(variants("fp", 1)).alias("variant")).withColumn("a", F.min("fp").over(at))
    else:
        masks = F.array(*(F.lit(x).cast("bigint") for x in flips(2, list(range(BITS)))))
        wide = nodes.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("at", "variant"))
        # the first masks are those of at most one bit: these fingerprints may be a star's middle
        met = wide.withColumn("a", F.min(F.when(F.col("at") <= BITS, F.col("fp"))).over(at))
    pairs = met.filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1 + radius).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """fp, root: for every end of the undirected edges (a, b) the least one they reach.

    Each round every node takes its least neighbour, if that is below it, and then that one's choice; the edges are drawn between
    what was chosen, and those within go. So each round works on a smaller graph, and the choices of all rounds, one after the
    other, lead to the root. Narrow rows only; joins on what many share go through hot_join."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{label}-edges")
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        least = staged(both.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("degree")).select(F.col("a").alias("fp"), F.least("a", "b").alias("root"), "degree"), f"{label}-least")
        followers = least.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"))
        up = staged(followers.join(least.select(F.col("fp").alias("root"), F.col("root").alias("top")), "root"), f"{label}-up")
        chosen = staged(hot_join(least, up, "root").select("fp", F.col("top").alias("root"), "degree"), f"{label}-chosen")
        rounds.append(chosen.select("fp", "root"))
        for end in ("a", "b"):
            named = chosen.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}"), F.col("degree").alias("_rows"))
            both = hot_join(both, named, end)
        both = staged(both.filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), f"{label}-edges")
    if not rounds:
        return both.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    out = rounds[0]
    for later in rounds[1:]:
        out = followed(staged(out, f"{label}-out"), later, label)
    return out


def followed(rows: DataFrame, later: DataFrame, label: str) -> DataFrame:
    """rows (fp, root) with the root of each root in later (fp, root), which holds some of them; only those roots change."""
    counts = rows.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"))
    table = staged(counts.join(later.select(F.col("fp").alias("root"), F.col("root").alias("top")), "root", "left").select("root", F.coalesce("top", "root").alias("top"), "_rows"), f"{label}-tops")
    return hot_join(rows, table, "root").select("fp", F.col("top").alias("root"))


def everywhere(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    """fp, root of all nodes: those without a link are their own root."""
    return nodes.join(rooted, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def compared(placed: DataFrame) -> DataFrame:
    """a, b: links at distance 3 between components, of the members outside a key's largest component with all its members: at most
    PAIRED rows for each member."""
    one = placed.filter("root <> base").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    other = placed.select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    met = one.join(other, "key").filter((F.col("ra") != F.col("rb")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3))
    return met.select("a", "b", F.col("ra").alias("root_a"), F.col("rb").alias("root_b"))


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows that are about to become many, dealt over as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def near_links(nodes: DataFrame) -> DataFrame:
    """fp, root of the distinct fingerprints: components under distance 3. The wide links join components of the close ones, so only
    those components are solved again, not the fingerprints."""
    nodes = spread(nodes)
    close = staged(stars(nodes, 1), "simhash-close")
    rooted = staged(spread(everywhere(nodes, components(close, "simhash-near"))), "simhash-rooted")
    keys = punctured("fp")
    # variants are shuffled once: the window sees a key's roots and passes on the members of the doubtful keys
    at = Window.partitionBy("key")
    reached = rooted.select("fp", "root", F.explode(keys).alias("key")).withColumns({"low": F.min("root").over(at), "high": F.max("root").over(at)})
    members = staged(reached.filter("low < high").select("key", "fp", "root"), "simhash-members")
    sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("base"), (F.sum("n") - F.max("n")).alias("outside"))
    placed = staged(members.join(staged(sizes, "simhash-sizes"), "key"), "simhash-placed")
    few = F.col("outside") <= PAIRED
    crowded = placed.filter(~few).select("fp").distinct()
    direct = compared(placed.filter(few)).select("root_a", "root_b")
    # a root is a fingerprint, so the ends of a ball's links have theirs in rooted, once each
    balls = stars(spread(crowded), 2)
    for end in ("a", "b"):
        balls = balls.join(rooted.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}")), end)
    wide = staged(direct.unionByName(balls.select("root_a", "root_b")).filter("root_a <> root_b").distinct(), "simhash-wide")
    tops = components(wide.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "simhash-far")
    return followed(rooted, tops, "simhash-far")


def placed_prints(prints: DataFrame) -> DataFrame:
    """The rows of staged prints with root and component_id, the least fp and the least id of their component."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    rooted = staged(near_links(nodes.select("fp")).join(nodes, "fp"), "simhash-components")
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_rows")), "simhash-least")
    named = staged(hot_join(rooted, least, "root").select("fp", "root", "component_id", F.col("copies").alias("_rows")), "simhash-named")
    return hot_join(prints, named, "fp")


def near_duplicates(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs; linked at 3 or fewer differing bits."""
    placed = placed_prints(staged(fingerprints(docs, shingle), "simhash-prints"))
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """One row of each component; columns are those of docs. Null and empty texts have fingerprint zero. Ids may be null or repeat, so
    components are told apart by their root: of a component's rows with its least id (null if it has no other) the one with the
    least fingerprint and then text key stays. An empty table stays empty; columns may have any names."""
    rows = placed_prints(staged(fingerprints(docs, shingle, keyed=True), "simhash-prints")).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = rows.groupBy("root").agg(F.min("component_id").alias("id"), F.min(F.struct("fp", "text_key"))["text_key"].alias("key"), F.count(F.lit(1)).alias("rows"))
    return rows_of(docs, staged(kept.drop("root"), "simhash-kept"))
