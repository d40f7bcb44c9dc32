"""The trigram model and the hard negatives against brute force, with odd rows."""

import math
import mmap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import elias_fano, hard_negatives, ngram_model

SCHEMA = "doc_id long, text string, block long, ids string, training int, kind int, data binary"


def test_sequences_find_successors():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1, 10**12), (7, 8), (5000, 6000), (5000, 10**15), (3000, 3)):
        values = np.sort(rng.integers(0, top, n))
        s = elias_fano.Sequence(elias_fano.parts_of(values))
        asked = np.concatenate([values, values + 1, rng.integers(0, top + 5, 500)])
        assert (s.successor(asked) == np.searchsorted(values, asked)).all()
        assert (s.at(np.arange(n)) == values).all()
        assert ((s.find(asked) >= 0) == np.isin(asked, values)).all()


def test_packing_round_trip():
    arrays = [np.array([], int), np.array([0, 255]), np.array([256, 1, 70000]), np.array([1 << 40, 0])]
    assert [x.tolist() for x in elias_fano.unpack(elias_fano.pack(*arrays))] == [x.tolist() for x in arrays]


def test_sibling_lists():
    lists = {0: [3, 5, 9], 2: [0], 3: [1, 2, 3, 4], 5: [7]}
    owner = np.array([o for o, x in lists.items() for _ in x])
    keys = np.array([k for x in lists.values() for k in x])
    r = elias_fano.Ranges({f"x.{k}": v for k, v in elias_fano.ranges_of(owner, keys, 6).items()}, "x")
    place = {(o, k): i for i, (o, k) in enumerate(zip(owner.tolist(), keys.tolist(), strict=True))}
    for o in range(-1, 6):
        asked = np.arange(-1, 12)
        assert r.find(np.full(len(asked), o), asked).tolist() == [place.get((o, k), -1) for k in asked.tolist()]


def words(text):
    return [*(text or "").encode().lower().split(), None]


def step(p):
    return min(round(math.log10(p) / -ngram_model.STEP), 255)


def brute_scores(rows, class_tokens):
    """(base, score, tokens, known) of each (id, text), by dictionaries."""
    train = [words(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    one = Counter(w for x in train for w in x)
    total, known, d = sum(one.values()), len(one), ngram_model.DISCOUNT

    def context(before, middle):
        classes = 1 + one[middle] // class_tokens
        h = 0 if before not in one and before != "none" else zlib.crc32({None: b"\n", "none": b"\t"}.get(before, before))
        return middle, int(ngram_model.mixed(np.array([h]), 7)[0]) % classes

    def trigrams(x):
        return [("none" if k == 1 else x[k - 2], x[k - 1], x[k]) for k in range(1, len(x))]

    two, three, pairs, contexts = Counter(), Counter(), Counter(), Counter()
    after_pair, after_context = defaultdict(set), defaultdict(set)
    for x in train:
        for a, b, c in trigrams(x):
            k = context(a, b)
            two[k, c] += 1
            three[a, b, c] += 1
            pairs[a, b] += 1
            contexts[k] += 1
            after_pair[a, b].add(c)
            after_context[k].add(c)

    def one_step(w):
        rest = d * known if total else 1.0
        return step((max(one[w] - d, 0) + rest / (known + 1)) / max(total, 1))

    def two_exact(k, c):
        left = d * len(after_context[k]) / contexts[k]
        return (two[k, c] - d) / contexts[k] + left * 10 ** (-ngram_model.STEP * one_step(c))

    def steps_of(a, b, c):
        k = context(a, b)
        if not contexts[k]:
            low = one_step(c)
        elif two[k, c]:
            low = step(two_exact(k, c))
        else:
            low = step(d * len(after_context[k]) / contexts[k]) + one_step(c)
        if not pairs[a, b]:
            return low
        left = d * len(after_pair[a, b]) / pairs[a, b]
        return step((three[a, b, c] - d) / pairs[a, b] + left * two_exact(k, c)) if three[a, b, c] else step(left) + low

    out = []
    for _, t in rows:
        x = words(t)
        base = sum(math.log10((one[w] + 1) / (total + known + 1)) for w in x)
        out.append((base, -ngram_model.STEP * (one_step(x[0]) + sum(steps_of(*g) for g in trigrams(x))), len(x), sum(one[w] > 0 for w in x), total))
    return out


ROWS = [(k, t) for k, t in enumerate([
    "the cat sat on the mat the cat sat", "The Cat ran off the mat", None, "", "  \n", "a", "a b a b a b a b c", "unseen words only here", "the the the the",
    "on the mat the dog sat\tand\x0bslept", "é à ü été", "the cat sat on the mat the cat sat", "x" * 5000, " ".join(f"w{i % 97} v{i % 31}" for i in range(6000)),
])] + [(None, "the cat sat on a dog"), (5, "a"), (3, "b c a"), (16, "the dog ran on the cat"), (23, "zebra the cat quagga sat")] + [(100 + k, f"the cat sat on mat {k % 9} the dog") for k in range(60)]


@pytest.mark.parametrize("class_tokens", [1 << 20, 20])
def test_scores_equal_brute_force(spark, class_tokens):
    docs = spark.createDataFrame([(i, t, 1, "x", 0, 0, None) for i, t in ROWS], SCHEMA).repartition(3)
    found = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6), r["n_known"], r["train_tokens"]) for r in ngram_model.score_texts(docs, class_tokens=class_tokens).collect())
    want = sorted((i is None, i, n, round(base, 6), round(s, 6) + 0.0, k, total) for (i, _), (base, s, n, k, total) in zip(ROWS, brute_scores(ROWS, class_tokens), strict=True))
    assert found == want


def test_scores_do_not_depend_on_shards(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", 0, 0, None) for i, t in ROWS], SCHEMA)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"])
    one = sorted(map(tuple, ngram_model.score_texts(docs.coalesce(1), class_tokens=20).collect()), key=str)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = sorted(map(tuple, ngram_model.score_texts(docs.repartition(5), class_tokens=20).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(one) == len(many) == len(ROWS) and key
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_model.score_texts(empty).count() == 0
    docs = spark.createDataFrame([(i, t, 1, "x", 0, 0, None) for i, t in ROWS[:4]], SCHEMA)
    for r in ngram_model.score_texts(docs, F.lit(False)).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["held_out"]) == (0, 0, 0.0, 0.0, True)


def test_tries_open_from_mapped_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1, "x", 0, 0, None) for i, t in ROWS], SCHEMA)
    tries = ngram_model.language_model(docs).collect()
    triples = 0
    for r in tries:
        path = tmp_path / f"{r['shard']}.trie"
        path.write_bytes(r["trie"])
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as view:
            trie = ngram_model.Trie(view)
            triples += trie.triples.keys.n
            del trie
    train = [words(t) for i, t in ROWS if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    assert triples == len({("none" if k == 1 else x[k - 2], x[k - 1], x[k]) for x in train for k in range(1, len(x))})


def test_held_out_texts_score_above_the_base(spark, data):
    found = ngram_model.score_texts(spark.read.parquet(f"{data}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, block long, place int, score long, slot int"


def brute_negatives(rows):
    live = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for n, (i, v, label) in enumerate(rows) if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, i, v, label in live:
        if i is None or i % 50:
            continue
        scored = [(product(v, w), j, other) for m, j, w, other in live if m != n]
        for p in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            near = sorted((s for s in scored if s[2] != label and 50 * p[0] <= 100 * s[0] <= 95 * p[0]), key=order)[:3]
            out += [(i, p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(near)]
    return sorted(out, key=str)


def vectors(kind):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=8) * 0.2).astype(np.float32).tolist(), int(rng.integers(0, 3))) for k in range(260)]
    if kind == "ties":
        rows = [(k, v if k % 3 else rows[1][1], label) for k, v, label in rows]
    if kind == "odd":
        rows += [(None, rows[0][1], 1), (7, None, 1), (50, [float("nan")] * 8, 1), (100, [0.1, None], 1), (150, [float("inf")] * 8, 1), (200, [], 0), (201, [], 1), (250, [0.5, -0.25], 1), (0, rows[0][1], rows[0][2]), (-50, rows[3][1], 2), (51, rows[4][1], None)]
        rows += [rows[50], rows[50]]
    if kind == "large":
        rows = [(k, [x * 1e6 for x in v], label) for k, v, label in rows]
    return rows


@pytest.mark.parametrize("kind", ["plain", "ties", "odd", "large"])
def test_negatives_equal_brute_force(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], VECTOR_SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, label).collect()), key=str)
    assert found == brute_negatives(rows)
    assert found


def test_no_vectors(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [0.5], 1, 1, 1, 1, 1)], VECTOR_SCHEMA)).count() == 0
