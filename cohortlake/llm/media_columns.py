"""Media columns: payloads in a lossless container, content-defined chunks, and reconstruction from a deduplicated chunk store.

A payload is a text's UTF-8 bytes, padded with blanks to a positive multiple of the frame size, stored as 8-bit mono samples after a
fixed header (RIFF/WAVE). A rolling gear hash over 32 bytes cuts the stored form into chunks; a candidate cut depends on nothing but
the bytes around it, and the least and greatest chunk sizes on the cut before, so copies give equal chunks and shared passages do
from the first common cut on. Media keep ordered lists of chunk digests.
The store has one row per digest; a join of the lists with the store and a group per medium rebuild every stored form, whose
SHA-256 is verified before its samples are read.

A digest in more than 1/10,000 of all list entries is hot; there are at most 10,000 of them, so their table is bounded by proof and
travels with the tasks. The entries of a hot digest are salted by medium, with as many salts as it has shares of that size.

Defined cases: null text is the empty text, whose payload is one frame of blanks. Equal texts share one medium. Repeated rows
give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import hot_join, staged, utf8

FRAME = 192
RATE = 8000
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
CUT_MASK = (1 << 13) - 1
LEAST, MOST = 2048, 65536
#: A hot digest has more than this share of all list entries.
HOT_SHARE = 1 / 10_000
#: Sample texts that serve as the chunks' common compression dictionary (for size alone): rows, and characters of each.
DICTIONARY_ROWS, DICTIONARY_TEXT = 400, 1024
LEVEL = 6


def payload(data: bytes) -> bytes:
    return data + b" " * (-len(data) % FRAME or (0 if data else FRAME))


def to_media(samples: bytes) -> bytes:
    """8-bit mono PCM in a RIFF/WAVE container. An even number of samples needs no padding."""
    return HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_media(media: bytes) -> bytes:
    fields = HEADER.unpack_from(media)
    if fields[0] != b"RIFF" or fields[2] != b"WAVE" or fields[10] != 8 or fields[12] != len(media) - HEADER.size:
        raise ValueError("not a stored medium")
    return media[HEADER.size :]


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """256 fixed pseudo-random numbers."""
    return np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:4], "little") for i in range(256)], np.uint32)


def chunk_bounds(data: bytes) -> list[int]:
    """0, the cuts, and the length. The gear hash h = 2h + G[byte] of 32-bit numbers forgets bytes after 32 steps, so it is a sum
    over a window, built by doubling: sums over 1, 2, 4, 8, 16 and 32 bytes."""
    n = len(data)
    if n <= LEAST:
        return [0, n]
    h = gear()[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        shifted = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += shifted
    bounds, at = [0], 0
    # the top bits depend on the whole window
    for cut in (np.flatnonzero(h >> np.uint32(19) == CUT_MASK) + 1).tolist():
        while cut - at > MOST:
            at += MOST
            bounds.append(at)
        if cut - at >= LEAST and cut < n:
            bounds.append(cut)
            at = cut
    while n - at > MOST:
        at += MOST
        bounds.append(at)
    return [*bounds, n]


def chunks(data: bytes) -> list[bytes]:
    b = chunk_bounds(data)
    return [data[x:y] for x, y in zip(b, b[1:])]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def key_of(data: bytes) -> bytes:
    """The first 128 bits of the digest, which name chunks and media in joins; what is rebuilt is checked against them."""
    return digest(data)[:16]


def feature(samples: bytes) -> str:
    """Signal features of the samples: mean and root mean square around the middle, zero crossings, peak."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.sum() / x.size:.4f};rms={np.sqrt((x * x).sum(dtype=np.int64) / x.size):.4f};zc={crossings};peak={int(np.abs(x).max())}"


def media_lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, medium (key of the stored form), digests (ordered list of chunk keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, lists = [], [], []
            for text in utf8(batch, "text"):
                stored = to_media(payload(text))
                sizes.append(len(text))
                media.append(key_of(stored))
                lists.append([key_of(c) for c in chunks(stored)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "medium", "digests"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, medium binary, digests array<binary>")


def salt_of(medium: bytes, n: int) -> int:
    return zlib.crc32(medium) % n


def chunk_rows(docs: DataFrame, hot: dict[bytes, int], dictionary: bytes) -> DataFrame:
    """digest, salt, z: the chunks of each text, compressed; once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if prefix := shared_prefix(dictionary):
            prefix.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=prefix)
        for batch in batches:
            seen: set[bytes] = set()
            for at in range(0, batch.num_rows, 256):
                rows: dict[tuple[bytes, int], bytes] = {}
                for text in utf8(batch.slice(at, 256), "text"):
                    stored = to_media(payload(text))
                    medium = key_of(stored)
                    if medium in seen:
                        continue
                    seen.add(medium)
                    for c in chunks(stored):
                        d = key_of(c)
                        key = (d, salt_of(medium, hot.get(d, 1)))
                        if key not in rows:
                            rows[key] = pack.compress(c)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.binary()), pa.array([k[1] for k in rows], pa.int32()), pa.array(list(rows.values()), pa.binary())], names=["digest", "salt", "z"])

    return docs.select("text").mapInArrow(run, "digest binary, salt int, z binary")


def rebuild(lists: DataFrame, dictionary: bytes) -> DataFrame:
    """Per medium, from its ordered chunks: the verified figures of what was read back. _rows, the number of rows that have the medium,
    is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=shared_prefix(dictionary))
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                medium, parts = batch.column("medium")[i].as_py(), batch.column("parts")[i].as_py()
                stored = b"".join(unpack.decompress(p["z"]) for p in sorted(parts, key=lambda p: p["pos"]))
                if (whole := digest(stored))[:16] != medium:
                    raise ValueError(f"medium {medium.hex()} differs from its chunks")
                samples = from_media(stored)
                rows.append((medium, len(samples), digest(samples), zlib.crc32(samples[-16:]), len(stored), whole, feature(samples), len(parts), batch.column("_rows")[i].as_py()))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 9
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["medium", "payload_bytes", "payload", "tail_crc32", "media_bytes", "media", "feature", "n_chunks", "_rows"])

    return lists.mapInArrow(run, "medium binary, payload_bytes long, payload binary, tail_crc32 long, media_bytes long, media binary, feature string, n_chunks long, _rows long")


def compression_dictionary(docs: DataFrame) -> bytes:
    sample = docs.filter("length(text) > 512").select(F.substring("text", 1, DICTIONARY_TEXT)).limit(DICTIONARY_ROWS).collect()
    return "".join(r[0] for r in sample).encode()


def shared_prefix(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None


def hot_digests(media: DataFrame) -> dict[bytes, int]:
    """The number of salts of each hot digest; at most 1 / HOT_SHARE of them."""
    entries = media.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = media.agg(F.sum(F.size("digests"))).first()[0] or 0
    share = max(200.0, total * HOT_SHARE)
    return {bytes(r[0]): int(r[1] / share) + 1 for r in entries.filter(F.col("n") > share).collect()}


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks."""
    listed = staged(media_lists(docs), "media-lists", compression="zstd")
    media = listed.groupBy("medium").agg(F.first("digests").alias("digests"), F.count(F.lit(1)).alias("_rows"))
    media = staged(media, "media-distinct", compression="zstd")
    hot = hot_digests(media)
    dictionary = compression_dictionary(docs)
    store = chunk_rows(docs, hot, dictionary).groupBy("digest", "salt").agg(F.first("z").alias("z"))

    salts = F.broadcast(docs.sparkSession.createDataFrame([(k, n) for k, n in hot.items()], "digest binary, salts int"))
    entries = media.select("medium", "_rows", F.posexplode("digests").alias("pos", "digest")).join(salts, "digest", "left")
    entries = entries.select("medium", "_rows", "pos", "digest", (F.crc32("medium") % F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    parts = entries.join(store, ["digest", "salt"]).groupBy("medium").agg(F.first("_rows").alias("_rows"), F.collect_list(F.struct("pos", "z")).alias("parts"))
    read = staged(rebuild(parts, dictionary), "media-read", compression="zstd")
    # many rows may share one medium
    hexed = lambda c: F.lower(F.hex(c))
    return hot_join(listed.select("doc_id", "n_bytes", "medium"), read, "medium").select("doc_id", "n_bytes", "payload_bytes", hexed("payload").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("media").alias("media_sha256"), "feature", "n_chunks")
