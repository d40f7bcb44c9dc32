"""Token ids in Parquet list columns, and reading them back.

Documents are parted into id ranges before they are encoded (so only texts travel), sorted within the partitions and written by
Spark's Parquet writer: one list column of ids with dictionary pages, the narrow columns beside it delta-encoded (format v2), row
groups and pages of bounded size, and page indexes, so that a reader of few documents or of the metadata alone skips the rest.
The writer's commit protocol makes lost tasks harmless. Document starts are distributed prefix sums over the files' shards.

Each row carries its place in its shard, written beside its ids, so that readers follow the order of the files also where ids repeat.

Defined cases: null or empty text is the end id alone; repeated ids are kept, in an order fixed by their texts' checksums; null ids
come first; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import blocks, new_folder, staged, utf8

#: Pieces that a worker keeps at most in each of two generations, and the longest one kept, in bytes.
CACHE = 250_000
KEPT_BYTES = 48
#: Bytes of text that are taken apart at once.
BLOCK = 4 << 20
FILE_SCHEMA = "doc_id long, shard int, place long, n_tokens int, ids array<int>"

#: Kinds of bytes: blanks part words, runs of letters and of marks are pieces, every digit is one, and a word with any other byte is
#: one piece as a whole.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
KINDS = np.array([BLANK if 9 <= b <= 13 or b == 32 else DIGIT if 48 <= b <= 57 else LETTER if 65 <= b <= 90 or 97 <= b <= 122 else MARK if 33 <= b <= 126 else ODD for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    return "".join(chr(b) if p else chr(256 + b - sum(prints[:b])) for b, p in enumerate(prints))


def pieces(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after another, and where each text's pieces end. Letters of ASCII and of the first accented
    block (lead byte 0xC3) are lowered. A word that holds anything else than them, digits and ASCII marks, an apostrophe before
    a letter, or the start of a special token is left as it is, in one piece."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind, low = KINDS[raw], LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    second = raw[lead + 1]
    lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]  # all but the signs of multiplication and division
    kind[lead] = kind[lead + 1] = LETTER
    capital = lead[raw[lead + 1] < 0x9F] + 1
    low[capital] += 32
    quote = np.flatnonzero(raw == 39)
    kind[quote[(kind[quote + 1] == LETTER) | (kind[quote + 1] == ODD)]] = ODD
    angle = np.flatnonzero(raw == 60)
    kind[angle[raw[angle + 1] == 124]] = ODD
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        blanks = np.flatnonzero(kind == BLANK)
        word = np.unique(np.searchsorted(blanks, odd))
        turns = np.zeros(len(raw) + 1, np.int8)
        turns[np.where(word > 0, blanks[word - 1] + 1, 0)] += 1
        turns[blanks[word]] -= 1
        whole = np.cumsum(turns[:-1], dtype=np.int8).astype(bool)
        kind[whole] = ODD
        low[whole] = raw[whole]
    filled = kind != BLANK
    starts = filled.copy()
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    data = low[filled]
    offsets = np.append(np.flatnonzero(starts[filled]), len(data)).astype(np.int32)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(np.flatnonzero(starts), ends)


class WordEncoder:
    """Ids of the tokenizers library, piece by piece.

    The tokenizer drops white space and encodes runs of letters, single digits and runs of marks apart, so a text's ids are those
    of its pieces laid end to end. A block of texts is taken apart in numpy and its distinct pieces are named by Arrow's
    dictionary encoding; only they are looked up, and only new ones reach the library. A piece of Latin letters is one
    pre-token that normalisation leaves alone once it is lowered, and its last id alone ends a word: many go through the library's
    model as one text, already in byte characters, and are cut there. All others pass the file's whole pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.table = byte_characters()
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 1000):
            out += [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _letters(self, texts: list[str]) -> list[bytes]:
        """texts are in byte characters."""
        out: list[bytes] = []
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a word of letters ended within")
            data, bounds = ids.tobytes(), [0, *(ends * 4).tolist()]
            out += [data[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def learn(self, fresh: list[bytes]) -> list[bytes]:
        """Ids of pieces by the library."""
        plain = [x.isalpha() for x in fresh]  # ASCII letters only
        table = self.table
        latin = [x.decode() if p else t.lower().encode().decode("latin-1").translate(table) if (t := x.decode()).isalpha() and max(t) <= "\xff" else "" for x, p in zip(fresh, plain)]
        letters = iter(self._letters([x for x in latin if x]))
        others = iter(self._each([x.decode() for x, t in zip(fresh, latin) if not t]))
        return [next(letters) if t else next(others) for t in latin]

    def known(self, names: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces: from the young generation of the cache, from the old one, or new."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, names))
        gaps = [i for i, x in enumerate(found) if x is None]
        for i in gaps:
            found[i] = self.old.get(names[i])
        fresh = [i for i in gaps if found[i] is None]
        for i, ids in zip(fresh, self.learn([names[i] for i in fresh]), strict=True):
            found[i] = ids
        self.young.update((names[i], found[i]) for i in gaps if len(names[i]) <= KEPT_BYTES)
        return found

    def encode_block(self, texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, with `end` (ids too) after each, and the bounds of each text's ids."""
        split, ends = pieces(texts)
        coded = split.dictionary_encode()
        found = [*self.known(coded.dictionary.to_pylist()), end]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        at = np.insert(coded.indices.to_numpy(), ends, len(found) - 1)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
        laid = lists.take(pa.array(at))
        last = ends + np.arange(1, len(texts) + 1)
        return laid.values.to_numpy(), np.concatenate([[0], laid.offsets.to_numpy()[last]])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, bounds = self.encode_block(texts)
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id, place (in the partition, from 0), n_tokens, ids of each row, in the partitions and order of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, place = encoder(tokenizer_file), np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            texts = utf8(batch, "text")
            for a, b in blocks([len(x) for x in texts], BLOCK):
                values, bounds = own.encode_block(texts[a:b], end)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
                places = pa.array(np.arange(place, place + b - a))
                place += b - a
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), places, pa.array(np.diff(bounds).astype(np.int32)), ids], names=["doc_id", "place", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, place long, n_tokens int, ids array<int>")


def range_of(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below x, null as none; found in two steps of about the root of their number each."""
    if not cuts:
        return F.lit(0)
    size = int(len(cuts) ** 0.5) + 1
    blocks = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    below = lambda values: F.size(F.filter(values, lambda c: c < x))
    block = F.least(below(F.lit([b[-1] for b in blocks])), F.lit(len(blocks) - 1))
    place = block * size + below(F.get(F.array(*map(F.lit, blocks)), block))
    return F.when(x.isNull(), 0).otherwise(place).cast("int")


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int, shards: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Write the ids of docs in ascending order of doc_id. The shard column is the file's place in that order."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    # cuts from the ids alone: n - 1 numbers, where a range partitioner would read the texts once more
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n)).alias("cuts")).first()["cuts"] if n > 1 else None
    ordered = rows.repartitionById(n, range_of(F.col("doc_id"), sorted(set(cuts or [])))).sortWithinPartitions("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    encoded = encode_documents(ordered, tokenizer_file, end_id).select("doc_id", F.spark_partition_id().alias("shard"), "place", "n_tokens", "ids")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#place": "false", "parquet.enable.dictionary#n_tokens": "false", "compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
    encoded.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the given other columns: ids before each document. Sums per shard, a running sum over the
    few shards, and running sums within each."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return files.withColumn("within", within).join(before, "shard").withColumn("start", (F.col("before") + F.col("within") - F.col("n_tokens")).cast("bigint"))


def stored_documents(files: DataFrame) -> DataFrame:
    """doc_id, shard, place, n_tokens, ids_crc32, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, bounds = ids.values.to_numpy(), ids.offsets.to_numpy()
            values = np.ascontiguousarray(values, "<i4")  # the same bytes as unsigned ids
            found = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "shard", "place")), pa.array(np.diff(bounds), pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "shard", "place", "ids").mapInArrow(run, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_file: str, *, end_id: int = 2, **options) -> DataFrame:
    """Write docs to token files in the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_file, end_id=end_id, **options)
    stored = staged(stored_documents(read_token_files(docs.sparkSession, path)), "token-rows")
    return document_starts(stored).select("doc_id", "start", "n_tokens", "ids_crc32")
