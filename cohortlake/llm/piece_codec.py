"""Piece encoding with source offsets, and decoding, exact to the sentencepiece library.

Normalisation takes, at every place, the longest prefix that the model's compiled character map rewrites (a double-array trie of
UTF-8 keys over null-ended replacements; an empty map rewrites nothing) and records for every normalised byte the source byte it
came from. The piece boundaries then project to spans of original bytes.

The library itself encodes and decodes whole texts; its pieces, laid end to end over the normalised text, carry the alignment.

Defined cases: null or empty text has no ids, no spans and decodes to the empty text; blanks, blank marks and control
characters are ordinary input. Repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"


class CharacterMap:
    """The compiled character map: a byte count, a double-array trie, and the replacements."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return self.units.size > 0

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest key that data has at this place."""
        found, node = None, 0
        node ^= self._offset(int(self.units[0]))
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(self.units[node]) if node < self.units.size else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                start = int(self.units[node]) & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[start : self.texts.index(0, start)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def normalize(text: str, charmap: CharacterMap) -> tuple[str, np.ndarray | None]:
    """The rewritten text and the source byte of each of its bytes, with one more for the end; None means they are the same."""
    if not charmap:
        return text, None
    data, out, source, at = text.encode(), bytearray(), [], 0
    while at < len(data):
        size, new = charmap.longest(data, at) or (0, b"")
        if not size:
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            new = data[at : at + size]
            source += range(at, at + size)
        else:
            source += [at] * len(new)
        out += new
        at += size
    return out.decode(), np.array([*source, len(data)], np.int64)


class PieceCodec:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        self.charmap = CharacterMap(model.normalizer_spec.precompiled_charsmap)
        pieces = [p.piece for p in model.pieces]
        #: Bytes that a piece stands for in the escaped text: one for a byte piece.
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.marks = np.array([p.count(MARK) for p in pieces], np.int64)
        self.names = [str(i) for i in range(len(pieces))]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text) if text else []

    def written(self, ids: list[int]) -> str:
        """The decimal ids joined by commas."""
        names = self.names
        return ",".join([names[i] for i in ids])

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(n, 2) source bytes [start, end) of each piece. The prefix mark stands for no source byte."""
        normal, source = normalize(text, self.charmap)
        if not ids:
            return np.zeros((0, 2), np.int64)
        data = normal.encode()
        own = np.array(ids)
        if MARK not in normal:
            # a mark is three bytes in a piece and one blank in the text
            ends = np.cumsum(self.sizes[own] - 2 * self.marks[own]) - 1
        else:
            escaped = (" " + normal).replace(" ", MARK)
            width = np.fromiter((1 if c == " " else len(c.encode()) for c in " " + normal), np.int64)
            at = np.concatenate([[0], np.cumsum(np.fromiter((len(c.encode()) for c in escaped), np.int64))])
            plain = np.concatenate([[0], np.cumsum(width)]) - 1
            ends = plain[np.searchsorted(at, np.cumsum(self.sizes[own]), side="right") - 1]
        ends = np.minimum(ends, len(data))
        bounds = np.concatenate([[0], ends]).clip(0)
        if source is not None:
            bounds = source[bounds]
        return np.stack([bounds[:-1], bounds[1:]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    """One codec for each worker process and model."""
    return PieceCodec(model_file)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_source_bytes long, spans_sha256 string"


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, starts, ends (source bytes of each piece), decoded: the operator's real output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids = [own.encode(x) for x in texts]
                spans = [own.spans(x, i) for x, i in zip(texts, ids, strict=True)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, ints), pa.array([s[:, 0].tolist() for s in spans], ints), pa.array([s[:, 1].tolist() for s in spans], ints), pa.array([own.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "starts", "ends", "decoded"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def encoding_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """The same encoding and spans, reduced to digests where it runs: n_source_bytes is the length of the union of the spans,
    which are consecutive; spans_sha256 that of all spans' bounds as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                ids = own.encode(text)
                spans = own.spans(text, ids)
                rows.append((len(ids), sha(own.written(ids)), sha(own.decode(ids)), int(spans[-1, 1]) if len(ids) else 0, hashlib.sha256(spans.astype("<u4").tobytes()).hexdigest()))
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_source_bytes", "spans_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, DIGESTS)
