"""Language-model scores of texts by a trigram model kept in Elias-Fano tries.

Model: interpolated absolute discounting over words and an end token. Words without a count in the training texts are unknown and
share the unigram's last part. Log probabilities are stored as whole steps of STEP (base 10), so sums are exact in any order and
results do not depend on the number of tasks. The first token of a text has no context.

A context word seen at least CLASS_TOKENS times has classes: its bigrams are counted apart for each class, which is a hash of the
word before it. So the order of back-off is (two words), (class, word), none, and the tries of one frequent word may lie in many tasks.

Plan, with one shuffle of n-grams and no vocabulary or model on the driver or in a broadcast:
 1. texts become blocks of word places, staged once; every distinct word of a block goes to the shard of its hash,
 2. shards count words and number them by descending count; the block gets back a number and a count for each word, so base scores
    need nothing else,
 3. each distinct trigram of a block goes, with the places of its documents, to the shard of its middle word and class,
 4. a shard builds its trie from the training texts' counts, looks up what all its blocks asked and returns a sum of steps for every
    document, which the last shuffle adds up.
Repeats within a block are sent once, so a line that half of all texts share costs a shard one entry for each block.

Trie of a shard: contexts (word, class); their successors and the words before them as sibling lists with monotone pointers; the
successors of a pair of words as places among the successors of its last word, which is the only range they can lie in. Lookups
are successor searches in the compact form; a trie is one flat buffer of levels and opens as a view of it.

Defined cases: a null text is empty and has one token, the end. A null id counts as the empty text in the choice of training rows.
Repeated rows are texts of their own and count as often as they occur. Without training texts all counts are 0 and every score is 0.
An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import ctypes
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import blocks, id_remainder, staged, utf8
from cohortlake.llm.elias_fano import Ranges, Sequence, from_buffer, named, pack, parts_of, ranges_of, to_buffer, unpack

BLOCK = 4 << 20
#: Tokens of all texts for each shard; at least one shard for each shuffle partition.
SHARD_TOKENS = 500_000
CLASS_TOKENS = 1 << 20
DISCOUNT = 0.75
STEP = 0.05
#: Numbers of no word, the end of a text, the place before a text.
UNKNOWN, END, NONE, FIRST = 0, 1, 2, 3
CLASS_BITS = 20

BLOCK_SCHEMA = "block long, ids array<long>, training int, tokens long, places binary, words binary"
WORD_SCHEMA = "block long, shard int, words binary, counts binary"
NUMBER_SCHEMA = "block long, shard int, numbers binary, known long, tokens long"
ROUTED_SCHEMA = "block long, shard int, kind int, ids array<long>, training int, data binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BASE, ENTRIES, SUMS, TRIE = 0, 1, 2, 3


def give_back() -> None:
    """Return freed memory to the system. Workers are reused, and what one stage has freed would otherwise stay theirs in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def mixed(x: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """A spread of 32-bit hashes."""
    y = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, training to blocks: training texts first, the places of their words in the block's list of words."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts, ids, training = utf8(batch, "text"), batch.column("doc_id").to_pylist(), batch.column("training").to_pylist()
        for a, b in blocks([len(x) for x in texts], BLOCK):
            order = sorted(range(a, b), key=lambda i: not training[i])
            split = [texts[i].lower().split() for i in order]  # bytes: A-Z, and blanks 0x20, 0x09-0x0D
            coded = pa.array([w for x in split for w in x], pa.binary()).dictionary_encode()
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            places = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.zeros(0, np.int64)
            words = b"\n".join(coded.dictionary.to_pylist())
            yield record(BLOCK_SCHEMA, [(number, [ids[i] for i in order], sum(training[a:b]), int(sizes.sum()) + len(split), pack(sizes, places), pack(np.frombuffer(words, np.uint8)))])
            number += 1
            del split, coded, places, words
        give_back()


def words_of(blob: bytes) -> list[bytes]:
    (data,) = unpack(blob)
    return data.astype(np.uint8).tobytes().split(b"\n") if len(data) else []


def by_shard(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, their order by shard, and where each shard begins in it."""
    h = hashes(words)
    shard = mixed(h) % shards
    order = np.argsort(shard, kind="stable")
    return h, order, np.searchsorted(shard[order], np.arange(shards + 1))


def block_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words, (sizes, places) = words_of(row["words"]), unpack(row["places"])
            counts = np.bincount(places[: sizes[: row["training"]].sum()], minlength=len(words))
            _, order, begin = by_shard(words, shards)
            out = []
            for s in np.flatnonzero(begin[1:] > begin[:-1]).tolist():
                own = order[begin[s] : begin[s + 1]]
                out.append((row["block"], s, pack(np.frombuffer(b"\n".join([words[i] for i in own.tolist()]), np.uint8)), pack(counts[own])))
            yield record(WORD_SCHEMA, out)


def number_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Counts and numbers of the words that each block asked for; the first row of a shard tells its known words and tokens."""
    asked = defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            asked[row["shard"]].append((row["block"], words_of(row["words"]), unpack(row["counts"])[0]))
    for shard, rows in asked.items():
        coded = pa.array([w for _, words, _ in rows for w in words], pa.binary()).dictionary_encode()
        places = coded.indices.to_numpy()
        totals = np.bincount(places, weights=np.concatenate([c for *_, c in rows])).astype(np.int64)
        alphabet = np.empty(len(totals), np.int64)
        alphabet[pa.compute.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(totals))
        numbers = np.zeros(len(totals), np.int64)
        order = np.lexsort((alphabet, -totals))
        numbers[order] = FIRST + np.arange(len(totals)) * shards + shard
        numbers[totals == 0] = UNKNOWN
        known, tokens, at = int((totals > 0).sum()), int(totals.sum()), 0
        for block, words, _ in rows:
            own = places[at : at + len(words)]
            at += len(words)
            yield record(NUMBER_SCHEMA, [(block, shard, pack(numbers[own], totals[own]), known, tokens)])
            known = tokens = 0
    del asked
    give_back()


def unigram(counts: np.ndarray, total: int, known: int) -> np.ndarray:
    rest = DISCOUNT * known if total else 1.0
    return (np.maximum(counts - DISCOUNT, 0.0) + rest / (known + 1)) / max(total, 1)


def steps(p: np.ndarray) -> np.ndarray:
    """-log10 p in whole steps, at most 255: less likely than 10 ** -12.75 is stored as that."""
    return np.minimum(np.rint(np.log10(p) / -STEP), 255).astype(np.int64)


def starts(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(flags)


def rises(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """x as differences to the entry before, or as it is where new is set."""
    return np.where(new, x, np.diff(x, prepend=0))


def risen(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    at = starts(new)
    return total - np.repeat(total[at] - d[at], np.diff(np.append(at, len(d))))


def flags(*columns: np.ndarray) -> np.ndarray:
    """Where any column differs from the entry before; the first entry always does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def encode_entries(middle: np.ndarray, kind: np.ndarray, before: np.ndarray, last: np.ndarray, last_steps: np.ndarray, occurrences: np.ndarray, docs: np.ndarray) -> bytes:
    """Entries sorted by (middle, kind, before, last)."""
    a, b = flags(middle, kind), flags(middle, kind, before)
    return pack(np.diff(middle, prepend=0), kind, rises(before, a), rises(last, b), last_steps, occurrences, docs)


def decode_entries(blob: bytes) -> tuple[np.ndarray, ...]:
    middle, kind, before, last, last_steps, occurrences, docs = unpack(blob)
    middle = np.cumsum(middle)
    before = risen(before, flags(middle, kind))
    return middle, kind, before, risen(last, flags(middle, kind, before)), last_steps, occurrences, docs


def route_block(row: dict, answers: list[dict], shards: int, totals: dict[str, int]) -> list[tuple]:
    """The base row of a block, and its entries for each shard."""
    words, (sizes, places), n = words_of(row["words"]), unpack(row["places"]), len(row["ids"])
    h, order, begin = by_shard(words, shards)
    numbers, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    for x in answers:
        own = order[begin[x["shard"]] : begin[x["shard"] + 1]]
        numbers[own], counts[own] = unpack(x["numbers"])
    if len(numbers) and numbers.min() < 0:
        raise RuntimeError("a block's words were not all counted")
    numbers, counts = np.append(numbers, [END, NONE]), np.append(counts, [totals["training"], 0])
    h = np.append(h, hashes([b"\n", b"\t"]))
    ends = np.cumsum(sizes + 1) - 1
    first = ends - sizes
    tokens = np.full(ends[-1] + 1 if n else 0, len(words), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = places
    doc = np.repeat(np.arange(n), sizes + 1)
    base = np.add.reduceat(np.log10((counts + 1) / (totals["tokens"] + totals["known"] + 1))[tokens], first)
    known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), first)
    one = steps(unigram(counts, totals["tokens"], totals["known"]))
    # words by number; all unknown ones are one
    names, rank = np.unique(numbers, return_inverse=True)
    lead = np.zeros(len(names), np.int64)
    lead[rank] = np.arange(len(numbers))
    word_hash, word_count, word_steps = h[lead], counts[lead], one[lead]
    word_hash[names == UNKNOWN] = 0
    seq = rank[tokens]
    at = np.ones(len(tokens), bool)
    at[first] = False
    at = np.flatnonzero(at)
    last, middle = seq[at], seq[at - 1]
    before = np.where(at - 1 == first[doc[at]], rank[-1], seq[np.maximum(at - 2, 0)])
    own = word_steps[seq[first]]
    # after an unknown word there is no context
    blank = names[middle] == UNKNOWN
    own += np.bincount(doc[at[blank]], weights=word_steps[last[blank]], minlength=n).astype(np.int64)
    at, last, middle, before = at[~blank], last[~blank], middle[~blank], before[~blank]
    out = [(row["block"], int(row["block"] % shards), BASE, row["ids"], row["training"], pack(sizes + 1, known, own) + base.tobytes())]
    if not len(at):
        return out
    pairs, pair = np.unique(middle * len(names) + before, return_inverse=True)
    p_middle, p_before = pairs // len(names), pairs % len(names)
    classes = 1 + word_count[p_middle] // totals["class_tokens"]
    kind = np.where(classes > 1, mixed(word_hash[p_before], 7) % classes, 0)
    shard = mixed(word_hash[p_middle], 1 + kind) % shards
    by = np.lexsort((p_before, kind, p_middle, shard))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    key = place[pair] * len(names) + last
    order = np.argsort(key, kind="stable")
    key, docs = key[order], doc[at][order]
    begin = starts(flags(key))
    occurrences = np.diff(np.append(begin, len(key)))
    entry_pair, entry_last = by[key[begin] // len(names)], key[begin] % len(names)
    shard = shard[entry_pair]
    cuts = np.append(starts(flags(shard)), len(shard))
    doc_cuts = np.append(begin, len(key))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        e, x = entry_pair[a:b], entry_last[a:b]
        data = encode_entries(names[p_middle[e]], kind[e], names[p_before[e]], names[x], word_steps[x], occurrences[a:b], docs[doc_cuts[a] : doc_cuts[b]])
        out.append((row["block"], int(shard[a]), ENTRIES, None, row["training"], data))
    return out


class Entries:
    """The entries of a shard, with places of their distinct contexts, bigrams, pairs of words and trigrams."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], training: list[int]):
        middle, kind, before, last, last_steps, occurrences, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.occurrences, self.docs, self.sizes = occurrences, docs, [len(p[0]) for p in parts]
        trained = docs < np.repeat(np.array(training), [len(p[6]) for p in parts])
        counts = np.add.reduceat(trained.astype(np.int64), np.cumsum(occurrences) - occurrences)
        self.words, places = np.unique(np.concatenate([before, last]), return_inverse=True)
        before, last = places[: len(before)], places[len(before) :]
        n = len(self.words)
        self.contexts, c = np.unique((middle << CLASS_BITS) + kind, return_inverse=True)
        self.pairs, p = np.unique(c * n + before, return_inverse=True)
        self.bigrams, b = np.unique(c * n + last, return_inverse=True)
        self.trigrams, self.trigram = np.unique(p * n + last, return_inverse=True)
        self.pair_of, self.last_of = self.trigrams // n, self.trigrams % n
        self.bigram_of = np.zeros(len(self.trigrams), np.int64)
        self.bigram_of[self.trigram] = b
        self.word_steps = np.zeros(n, np.int64)
        self.word_steps[last] = last_steps
        count = lambda x, k: np.bincount(x, weights=counts, minlength=len(k)).astype(np.int64)
        self.context_counts, self.pair_counts, self.bigram_counts, self.trigram_counts = count(c, self.contexts), count(p, self.pairs), count(b, self.bigrams), count(self.trigram, self.trigrams)


def shares(counts: np.ndarray, owner: np.ndarray, owner_counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted probabilities of sorted successors mixed with those of the shorter context, and the weight each owner leaves to it."""
    left = DISCOUNT * np.bincount(owner, minlength=len(owner_counts)) / owner_counts
    return (counts - DISCOUNT) / owner_counts[owner] + left[owner] * lower, left


def build_trie(x: Entries) -> bytes:
    """The levels of all n-grams with a training count."""
    n = len(x.words)
    keep = lambda counts: (np.flatnonzero(counts > 0), np.cumsum(counts > 0) - 1)
    (c, c_place), (p, p_place), (b, b_place), (t, _) = map(keep, (x.context_counts, x.pair_counts, x.bigram_counts, x.trigram_counts))
    used = np.zeros(n, bool)
    used[x.pairs[p] % n] = used[x.bigrams[b] % n] = True
    word_place = np.cumsum(used) - 1
    b_owner, p_owner, t_owner = c_place[x.bigrams[b] // n], c_place[x.pairs[p] // n], p_place[x.pair_of[t]]
    two, two_left = shares(x.bigram_counts[b], b_owner, x.context_counts[c], 10.0 ** (-STEP * x.word_steps[x.bigrams[b] % n]))
    t_bigram = b_place[x.bigram_of[t]]
    three, three_left = shares(x.trigram_counts[t], t_owner, x.pair_counts[p], two[t_bigram])
    begin = np.searchsorted(b_owner, np.arange(len(c)))
    parts = named("words", parts_of(x.words[used])) | named("contexts", parts_of(x.contexts[c]))
    parts |= named("successors", ranges_of(b_owner, word_place[x.bigrams[b] % n], len(c)))
    parts |= named("before", ranges_of(p_owner, word_place[x.pairs[p] % n], len(c)))
    # the successors of a pair are places among those of its last word
    parts |= named("triples", ranges_of(t_owner, t_bigram - begin[p_owner[t_owner]], len(p)))
    code = lambda q: steps(q).astype(np.uint8)
    return to_buffer(parts | {"two": code(two), "two_left": code(two_left), "three": code(three), "three_left": code(three_left)})


class Trie:
    """A view of a trie's buffer."""

    def __init__(self, buffer):
        parts = from_buffer(buffer)
        self.words, self.contexts = Sequence(parts, "words."), Sequence(parts, "contexts.")
        self.successors, self.before, self.triples = (Ranges(parts, x) for x in ("successors", "before", "triples"))
        self.two, self.two_left, self.three, self.three_left = (parts[x] for x in ("two", "two_left", "three", "three_left"))

    def steps(self, x: Entries) -> np.ndarray:
        """-log10 probability of each distinct trigram, in steps."""
        n = len(x.words)
        word, context = self.words.find(x.words), self.contexts.find(x.contexts)
        owner = context[x.bigrams // n]
        bigram = self.successors.find(owner, word[x.bigrams % n])
        two = np.where(bigram >= 0, self.coded(self.two, bigram), self.coded(self.two_left, owner) + x.word_steps[x.bigrams % n])
        pair_context = context[x.pairs // n]
        pair = self.before.find(pair_context, word[x.pairs % n])
        begin = np.where(pair_context >= 0, self.successors.begin(np.maximum(pair_context, 0)), 0) if self.contexts.n else np.zeros(len(pair), np.int64)
        owner, place = pair[x.pair_of], bigram[x.bigram_of]
        triple = self.triples.find(owner, np.where(place >= 0, place - begin[x.pair_of], -1))
        return np.where(triple >= 0, self.coded(self.three, triple), self.coded(self.three_left, owner) + two[x.bigram_of])

    @staticmethod
    def coded(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Codes of places, 0 for absent ones."""
        return np.where(place >= 0, codes[np.maximum(place, 0)].astype(np.int64), 0) if len(codes) else np.zeros(len(place), np.int64)


def shard_scores(batches: Iterator[pa.RecordBatch], keep_tries: bool) -> Iterator[pa.RecordBatch]:
    """Base rows as they are; sums of steps by document for each block; with keep_tries, the trie."""
    asked, shard = [], -1
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == BASE:
                yield record(ROUTED_SCHEMA, [tuple(row.values())])
            else:
                asked.append((row["block"], row["training"], row["data"]))
                shard = row["shard"]
    if not asked:
        return
    entries = Entries([decode_entries(data) for *_, data in asked], [n for _, n, _ in asked])
    trie = build_trie(entries)
    if keep_tries:
        yield record(ROUTED_SCHEMA, [(None, shard, TRIE, None, None, trie)])
    found = Trie(memoryview(trie)).steps(entries)[entries.trigram]
    del trie
    give_back()
    at = doc_at = 0
    for (block, *_), size in zip(asked, entries.sizes, strict=True):
        occurrences = entries.occurrences[at : at + size]
        total = int(occurrences.sum())
        sums = np.bincount(entries.docs[doc_at : doc_at + total], weights=np.repeat(found[at : at + size], occurrences)).astype(np.int64)
        docs = np.flatnonzero(sums)
        at, doc_at = at + size, doc_at + total
        yield record(ROUTED_SCHEMA, [(block, None, SUMS, None, None, pack(docs, sums[docs]))])
    del entries, found, asked
    give_back()


def block_scores(table: pa.Table, train_tokens: int) -> pa.Table:
    rows = table.to_pylist()
    (base,) = (r for r in rows if r["kind"] == BASE)
    n = len(base["ids"])
    data = base["data"]
    sizes, known, total = unpack(data[: len(data) - 8 * n])
    for r in rows:
        if r["kind"] == SUMS:
            docs, sums = unpack(r["data"])
            total[docs] += sums
    values = [pa.array(base["ids"], pa.int64()), pa.array(np.arange(n) >= base["training"]), sizes, known, np.full(n, train_tokens), np.frombuffer(data, "<f8", n, len(data) - 8 * n), total * -STEP + 0.0]
    return pa.table([pa.array(v) for v in values], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def routed(docs: DataFrame, training: Column, keep_tries: bool, class_tokens: int) -> tuple[DataFrame, int]:
    """What the shards return, and the number of training tokens."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("training"))
    made = staged(rows.mapInArrow(text_blocks, BLOCK_SCHEMA), "text-blocks")
    tokens, trained = made.agg(F.sum("tokens"), F.sum("training")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(tokens or 0) // SHARD_TOKENS))
    asked = made.select("block", "training", "places", "words").mapInArrow(lambda x: block_words(x, shards), WORD_SCHEMA)
    numbers = staged(asked.repartitionById(shards, F.col("shard")).mapInArrow(lambda x: number_words(x, shards), NUMBER_SCHEMA), "word-numbers")
    known, counted = numbers.agg(F.sum("known"), F.sum("tokens")).first()
    trained = trained or 0
    totals = {"training": trained, "tokens": (counted or 0) + trained, "known": (known or 0) + (trained > 0), "class_tokens": class_tokens}

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.to_pylist()
        out = pa.Table.from_batches([record(ROUTED_SCHEMA, route_block(row, answers, shards, totals)) for row in left.to_pylist()])
        give_back()
        return out

    sent = made.groupBy("block").cogroup(numbers.select("block", "shard", "numbers").groupBy("block")).applyInArrow(route, ROUTED_SCHEMA)
    return sent.repartitionById(shards, F.col("shard")).mapInArrow(lambda x: shard_scores(x, keep_tries), ROUTED_SCHEMA), totals["tokens"]


def score_texts(docs: DataFrame, training: Column | None = None, class_tokens: int = CLASS_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row. training says which rows are learnt from;
    by default those whose crc32 of the id modulo 7 is not 2. base_score adds the log10 of (count + 1) / (tokens + known + 1)."""
    found, train_tokens = routed(docs, id_remainder(7) != 2 if training is None else training, False, class_tokens)
    return found.select("block", "kind", "ids", "training", "data").groupBy("block").applyInArrow(lambda table: block_scores(table, train_tokens), SCORE_SCHEMA)


def language_model(docs: DataFrame, training: Column | None = None, class_tokens: int = CLASS_TOKENS) -> DataFrame:
    """shard and trie (a flat buffer for Trie) of the model that score_texts uses; write it to keep it."""
    found, _ = routed(docs, id_remainder(7) != 2 if training is None else training, True, class_tokens)
    return found.filter(F.col("kind") == TRIE).select("shard", F.col("data").alias("trie"))
