"""Hard negatives of anchor vectors by bit-sliced integer products.

Components become integers and are stored as bit planes, most significant first (two's complement). The product of an anchor with
a row is summed plane by plane; what the planes still to come can add is known from the anchor's positive and negative components
alone, so after every plane each score has an interval. Rows whose interval cannot reach the k-th best lower bound, or any of the
anchor's windows, are dropped; once few are left the planes are added for them alone. The last plane leaves exact scores.

Every row is packed into one of the blocks of at most BLOCK rows. Blocks and groups of about GROUP anchors meet in a shuffled
cogroup, each block once for every group and each group once for every row group: a stated query set against all rows, in blocks.
A block returns at most k rows for each anchor and window, which are merged by rank. Nothing is broadcast or collected; labels
play no part in the dealing, so a frequent label is spread like others.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different
lengths are compared over their common components (the rest count as zero); an empty vector has only zero products. A null vec_id
is no anchor, may be chosen, and is last among ties. Rows repeated under one vec_id are rows of their own: another row with the
anchor's id may be its positive, and each such anchor row is answered. An empty table gives no rows. Components beyond 61 bits and scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import staged

BLOCK = 16_384
GROUP = 16_384
#: Anchors whose scores with a block are held at once.
STRIP = 128
#: Scores are added for the remaining pairs alone once at most this share of them is left.
SPARSE = 0.2
#: Float products of integers are exact below this.
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max

BLOCK_SCHEMA = "block long, anchors long, ids array<long>, labels array<int>, bits int, dims int, planes binary"
ANCHOR_SCHEMA = "block long, place int, id long, label int, vector array<long>"
FOUND = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SCHEMA = "block long, place int, slot int, vec_id long, score long"


def to_integers(vectors: list[list[float]], scale: float) -> np.ndarray:
    """floor(scale * x) of each component, short vectors padded with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() >= 2.0**61:
        raise OverflowError("a component is beyond 61 bits")
    return out.astype(np.int64)


def bit_planes(q: np.ndarray) -> tuple[int, bytes]:
    """Number of planes, and the planes packed, most significant (the sign) first."""
    bits = 1 + max((int(x).bit_length() for x in ((q.min(), q.max()) if q.size else (0,))), default=0)
    planes = [np.packbits(((q >> b) & 1).astype(np.uint8), axis=1) for b in range(bits - 1, -1, -1)]
    return bits, b"".join(p.tobytes() for p in planes)


def planes_of(data: bytes, bits: int, rows: int, dims: int) -> np.ndarray:
    """bits x rows x dims, most significant first."""
    if not dims:
        return np.zeros((bits, rows, 0), np.uint8)
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(bits, rows, -1), axis=2, count=dims)


def integers_of(planes: np.ndarray) -> np.ndarray:
    bits = len(planes)
    q = planes[0].astype(np.int64) * -(1 << (bits - 1))
    for k in range(1, bits):
        q += planes[k].astype(np.int64) << (bits - 1 - k)
    return q


def pack_rows(batches: Iterator[pa.RecordBatch], scale: float, every: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, embedding without nulls) to blocks."""
    from pyspark import TaskContext

    first, made = TaskContext.get().partitionId() << 33, 0

    def block(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal made
        ids, labels, vectors = zip(*rows, strict=True)
        q = to_integers(vectors, scale)
        bits, planes = bit_planes(q)
        anchors = sum(x is not None and math.fmod(x, every) == 0 for x in ids)
        values = [[first + made], [anchors], [list(ids)], [list(labels)], [bits], [q.shape[1]], [planes]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "anchors", "ids", "labels", "bits", "dims", "planes"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True)
        while len(held) >= BLOCK:
            yield block(held[:BLOCK])
            del held[:BLOCK]
    if held:
        yield block(held)


def packed(embeddings: DataFrame, label: Column, *, scale: float, every: int) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("int").alias("label"), x.alias("embedding")).filter(whole & F.col("label").isNotNull())
    return rows.mapInArrow(partial(pack_rows, scale=scale, every=every), BLOCK_SCHEMA)


def anchor_rows(blocks: DataFrame, every: int) -> DataFrame:
    """block, place, id, label, vector of the anchors in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = [i for i, x in enumerate(row["ids"]) if x is not None and math.fmod(x, every) == 0]
                q = integers_of(planes_of(row["planes"], row["bits"], len(row["ids"]), row["dims"])[:, at])
                own = [[row["block"]] * len(at), at, [row["ids"][i] for i in at], [row["labels"][i] for i in at], q.tolist()]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(own, kinds, strict=True)], names=["block", "place", "id", "label", "vector"])

    return blocks.filter("anchors > 0").select("block", "ids", "labels", "bits", "dims", "planes").mapInArrow(run, ANCHOR_SCHEMA)


def kth_largest(group: np.ndarray, values: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group, minus infinity where a group has fewer."""
    order = np.lexsort((-values, group))
    sorted_groups = group[order]
    first = np.searchsorted(sorted_groups, np.arange(groups))
    at = first + k - 1
    enough = at < np.searchsorted(sorted_groups, np.arange(groups), side="right")
    out = np.full(groups, -np.inf, values.dtype if values.dtype == object else float)
    out[enough] = values[order[at[enough]]]
    return out


class Search:
    """Interval-wise products of a strip of anchors with the rows of one block."""

    def __init__(self, anchors: np.ndarray, planes: np.ndarray):
        largest = int(np.abs(anchors).max()) if anchors.size else 0
        exact = (largest << len(planes)) * max(1, anchors.shape[1]) < EXACT
        self.kind = float if exact else object
        self.planes = planes
        self.anchors = anchors.astype(self.kind) if exact else np.array([[int(x) for x in row] for row in anchors], object).reshape(anchors.shape)
        self.above = np.where(self.anchors > 0, self.anchors, 0).sum(axis=1)
        self.below = np.where(self.anchors < 0, self.anchors, 0).sum(axis=1)

    def pairs(self, allowed: np.ndarray, keep_dense, keep_sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, exact score) of the allowed pairs that no plane ruled out. keep_dense(scores, low, high, alive) and
        keep_sparse(anchor, scores, low, high) say which intervals can still qualify; low and high are by anchor."""
        bits = len(self.planes)
        scores = np.zeros(allowed.shape, self.kind)
        alive, sparse = allowed, None
        for k in range(bits):
            weight = (1 << (bits - 1 - k)) * (-1 if k == 0 else 1)
            rest = (1 << (bits - 1 - k)) - 1
            high, low = rest * self.above, rest * self.below
            if sparse is None:
                scores += weight * (self.anchors @ self.planes[k].T.astype(self.kind))
                alive = alive & keep_dense(scores, low[:, None], high[:, None], alive)
                if np.count_nonzero(alive) <= SPARSE * alive.size:
                    a, r = np.nonzero(alive)
                    sparse = a, r, scores[a, r]
            else:
                a, r, s = sparse
                s = s + weight * self.added(k, a, r)
                stay = keep_sparse(a, s, low[a], high[a])
                sparse = a[stay], r[stay], s[stay]
        if sparse is None:
            a, r = np.nonzero(alive)
            sparse = a, r, scores[a, r]
        a, r, s = sparse
        return a, r, s.astype(np.int64) if self.kind is float else np.array([self.checked(x) for x in s], np.int64)

    def added(self, k: int, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), self.kind)
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            out[part] = (self.anchors[a[part]] * self.planes[k][r[part]]).sum(axis=1)
        return out

    @staticmethod
    def checked(x: int) -> int:
        if not -(1 << 63) <= x < 1 << 63:
            raise OverflowError("a score is beyond 64 bits")
        return int(x)


def best(a: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each anchor by descending score, then ascending id."""
    order = np.lexsort((ids, -scores, a))
    sorted_a = a[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_a, sorted_a)
    return order[rank < k]


def block_positives(block: int, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray, anchors: dict[str, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor number, slot, row, score) of the k best other rows of the anchor's label."""
    for label in np.unique(anchors["label"]).tolist():
        rows, own = np.flatnonzero(labels == label), np.flatnonzero(anchors["label"] == label)
        sub = planes[:, rows]
        for i in range(0, len(own) if len(rows) else 0, STRIP):
            strip = own[i : i + STRIP]
            search = Search(anchors["vector"][strip], sub)
            allowed = ~((anchors["block"][strip] == block)[:, None] & (anchors["place"][strip][:, None] == rows))

            def dense(s, low, high, alive):
                if s.shape[1] <= k:
                    return alive
                least = np.where(alive, s + low, -np.inf)
                return s + high >= np.partition(least, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]]

            def sparse(a, s, low, high, n=len(strip)):
                return s + high >= kth_largest(a, s + low, k, n)[a]

            a, r, s = search.pairs(allowed, dense, sparse)
            at = best(a, s, ids[rows][r], k)
            yield strip[a[at]], np.zeros(len(at), np.int32), rows[r[at]], s[at]


def block_negatives(block: int, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray, anchors: dict[str, np.ndarray], k: int, low_percent: int, high_percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor number, slot, row, score) of the k best rows of other labels in the window of each of the anchor's positive scores."""
    slots = max(map(len, anchors["scores"]))
    for i in range(0, len(anchors["label"]), STRIP):
        strip = np.arange(i, min(i + STRIP, len(anchors["label"])))
        search = Search(anchors["vector"][strip], planes)
        least, most = windows([anchors["scores"][j] for j in strip.tolist()], low_percent, high_percent, slots, search.kind)
        lowest, highest = least.min(axis=1)[:, None], most.max(axis=1)[:, None]
        allowed = anchors["label"][strip][:, None] != labels

        def dense(s, low, high, alive):
            return (s + high >= lowest) & (s + low <= highest)

        def sparse(a, s, low, high):
            stay = np.zeros(len(a), bool)
            for w in range(slots):
                inside = (s + low >= least[a, w]) & (s + high <= most[a, w])
                bar = kth_largest(a[inside], (s + low)[inside], k, len(strip))
                stay |= (s + high >= least[a, w]) & (s + low <= most[a, w]) & (s + high >= bar[a])
            return stay

        a, r, s = search.pairs(allowed, dense, sparse)
        for w in range(slots):
            inside = np.flatnonzero((s >= least[a, w]) & (s <= most[a, w]))
            at = inside[best(a[inside], s[inside], ids[r[inside]], k)]
            yield strip[a[at]], np.full(len(at), w, np.int32), r[at], s[at]


def windows(scores: list[list[int]], low: int, high: int, slots: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest qualifying scores of each positive score by anchor and slot; empty windows where there is none."""
    least = [[-((-low * p) // 100) for p in own] + [np.inf] * (slots - len(own)) for own in scores]
    most = [[(high * p) // 100 for p in own] + [-np.inf] * (slots - len(own)) for own in scores]
    return np.array(least, kind), np.array(most, kind)


def meet(blocks: DataFrame, anchors: DataFrame, find, groups: int, row_groups: int) -> DataFrame:
    """find over every block and every anchor, block by block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if right.num_rows:
            own = {c: np.array(right.column(c).to_pylist()) for c in ("block", "place", "label")}
            vectors = right.column("vector").to_pylist()
            own["scores"] = right.column("scores").to_pylist() if "scores" in right.column_names else None
            for row in left.to_pylist():
                n, dims = len(row["ids"]), max(row["dims"], max(map(len, vectors)))
                own["vector"] = np.zeros((len(vectors), dims), np.int64)
                for j, v in enumerate(vectors):
                    own["vector"][j, : len(v)] = v
                planes = np.zeros((row["bits"], n, dims), np.uint8)
                planes[:, :, : row["dims"]] = planes_of(row["planes"], row["bits"], n, row["dims"])
                ids = np.array([NO_ID if x is None else x for x in row["ids"]], np.int64)
                for a, slot, r, s in find(row["block"], ids, np.array(row["labels"]), planes, own):
                    if len(a):
                        found = [own["block"][a], own["place"][a], slot, [row["ids"][j] for j in r.tolist()], s]
                        out.append(pa.table([pa.array(x, f.type) for x, f in zip(found, FOUND, strict=True)], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(row_groups)).cast("int").alias("rows_at"), numbers(groups, "anchors_at"))
    right = anchors.select("*", F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int").alias("anchors_at"), numbers(row_groups, "rows_at"))
    # work is much larger than bytes here, so tasks are counted and not merged by size
    keys, tasks = ("rows_at", "anchors_at"), max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups * row_groups // 4)
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, FOUND_SCHEMA)


def first_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, label: Column | str = "label", *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor (vec_id divisible by `every`) and
    each of its best `positives` rows of the same label, the best `negatives` rows of other labels whose score lies between low and
    high percent of the positive's."""
    blocks = staged(packed(embeddings, F.col(label) if isinstance(label, str) else label, scale=scale, every=every), "vector-blocks")
    count, rows = blocks.agg(F.sum("anchors"), F.count(F.lit(1))).first()
    groups, row_groups = max(1, -(-(count or 0) // GROUP)), max(1, rows)
    anchors = staged(anchor_rows(blocks, every), "anchors")
    near = meet(blocks, anchors, lambda *x: block_positives(*x, k=positives), groups, row_groups)
    chosen = staged(first_of(near, positives), "positives")

    scores = chosen.groupBy("block", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    hard = first_of(meet(blocks, anchors.join(scores, ["block", "place"]), lambda *x: block_negatives(*x, k=negatives, low_percent=low, high_percent=high), groups, row_groups), negatives)
    own = chosen.select("block", "place", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(own, ["block", "place", "slot"]).join(anchors.select("block", "place", F.col("id").alias("anchor_id")), ["block", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
