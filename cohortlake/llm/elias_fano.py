"""Compact monotone sequences, and arrays packed to bytes.

A sequence of n non-decreasing numbers below u keeps about log2(u / n) low bits of each as they are and the high bits in unary, as
Elias and Fano proposed: 2 + log2(u / n) bits a number. Its arrays are views of one flat buffer, which may be a memory-mapped file.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa

#: Place of the r-th set bit of each byte, 8 where there are fewer.
SELECT_IN_BYTE = np.array([[([k for k in range(8) if b >> k & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)
CODEC = pa.Codec("zstd", 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays in as few bytes as their largest value needs, bytes of equal weight together, compressed."""
    heads, bodies = [], []
    for x in arrays:
        x = np.asarray(x)
        width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
        heads.append(struct.pack("<qB", len(x), width))
        bodies.append(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(len(x), width).T).tobytes())
    data = b"".join(bodies)
    return struct.pack("<iq", len(arrays), len(data)) + b"".join(heads) + CODEC.compress(data, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    count, size = struct.unpack_from("<iq", blob)
    heads = [struct.unpack_from("<qB", blob, 12 + 9 * k) for k in range(count)]
    data, at, out = np.frombuffer(CODEC.decompress(memoryview(blob)[12 + 9 * count :], size), np.uint8), 0, []
    for n, width in heads:
        out.append(np.ascontiguousarray(data[at : at + n * width].reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += n * width
    return out


def to_buffer(parts: dict[str, np.ndarray | int]) -> bytes:
    """Arrays and numbers by name as one flat buffer, arrays at multiples of 8 bytes."""
    head, at, bodies = {}, 0, []
    for name, x in parts.items():
        if isinstance(x, np.ndarray):
            head[name] = [x.dtype.str, len(x), at]
            bodies.append(x.tobytes() + b"\0" * (-x.nbytes % 8))
            at += len(bodies[-1])
        else:
            head[name] = int(x)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<q", len(text)) + text + b"".join(bodies)


def from_buffer(buffer) -> dict[str, np.ndarray | int]:
    """The parts as views of the buffer; nothing is copied."""
    (size,) = struct.unpack_from("<q", buffer)
    head = json.loads(bytes(buffer[8 : 8 + size]))
    return {name: x if isinstance(x, int) else np.frombuffer(buffer, x[0], x[1], 8 + size + x[2]) for name, x in head.items()}


def parts_of(values: np.ndarray) -> dict[str, np.ndarray | int]:
    """The parts of a non-decreasing sequence of non-negative numbers."""
    n = len(values)
    values = values.astype(np.int64)
    top = int(values[-1]) + 1 if n else 1
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = np.empty((n, low_bits), np.uint8)
    for b in range(low_bits):
        bits[:, b] = (values >> b) & 1
    bits = bits.reshape(-1)
    low = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, np.uint8)]), bitorder="little").view("<u8")
    buckets = (values >> low_bits) + np.arange(n)
    unary = np.zeros(-(-(n + (top >> low_bits) + 2) // 64) * 64, np.uint8)
    unary[buckets] = 1
    high = np.packbits(unary, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
    return {"n": n, "top": top, "low_bits": low_bits, "low": low, "high": high, "ones": ones}


class Sequence:
    """A view of such parts."""

    def __init__(self, parts: dict, name: str = ""):
        self.n, self.top, self.low_bits = (parts[name + x] for x in ("n", "top", "low_bits"))
        self.low, self.high, self.ones = (parts[name + x] for x in ("low", "high", "ones"))
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # a shift by 64 is undefined, so the next word moves up in two steps
        x = (self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        return (x & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    @staticmethod
    def bit_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of each word, by halves and then by a table."""
        at = np.zeros(len(words), np.int64)
        for half in (32, 16, 8):
            part = words & np.uint64((1 << half) - 1)
            below = np.bitwise_count(part).astype(np.int64)
            beyond = r >= below
            r = r - np.where(beyond, below, 0)
            at += np.where(beyond, half, 0)
            words = np.where(beyond, words >> np.uint64(half), part)
        return at + SELECT_IN_BYTE[(words & np.uint64(255)).astype(np.int64), r]

    def select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Place of the k-th zero or one of the unary part."""
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        bits = self.high[word]
        return 64 * word + self.bit_in_word(~bits if zero else bits, k - before[word])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        return ((self.select(i, False) - i) << self.low_bits) | self.low_part(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number that is at least x; n where there is none. The high bits name a bucket, the low bits are
        searched in it."""
        x = np.asarray(x, np.int64)
        out = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(x < self.top) if self.n else np.zeros(0, np.int64)
        if not len(inside):
            return out
        y = np.maximum(x[inside], 0)
        bucket = y >> self.low_bits
        start = np.where(bucket > 0, self.select(np.maximum(bucket - 1, 0), True) + 1 - bucket, 0)
        end = self.select(bucket, True) - bucket
        want = y & ((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(start < end)
        while len(open_):
            a, b = start[open_], end[open_]
            middle = (a + b) >> 1
            less = self.low_part(middle) < want[open_]
            start[open_] = np.where(less, middle + 1, a)
            end[open_] = np.where(less, b, middle)
            open_ = open_[start[open_] < end[open_]]
        out[inside] = start
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of x, -1 where it is absent."""
        place = self.successor(x)
        here = np.flatnonzero(place < self.n)
        hit = self.at(place[here]) == np.asarray(x, np.int64)[here]
        out = np.full(len(place), -1, np.int64)
        out[here[hit]] = place[here[hit]]
        return out


def ranges_of(owner: np.ndarray, keys: np.ndarray, owners: int) -> dict[str, np.ndarray | int]:
    """Sorted sibling lists, one for each owner: monotone pointers to where each list begins, and the keys made monotone by adding
    the last number of the list before. owner is sorted, and keys within an owner."""
    pointers = np.searchsorted(owner, np.arange(owners + 1))
    last = pointers[1:] - 1
    rise = np.where(pointers[1:] > pointers[:-1], keys[last] + 1 if len(keys) else 0, 0)
    base = np.concatenate([[0], np.cumsum(rise)])[:-1]
    return named("pointers", parts_of(pointers)) | named("keys", parts_of(keys + 1 + base[owner] if len(keys) else keys))


def named(name: str, parts: dict) -> dict:
    return {f"{name}.{k}": v for k, v in parts.items()}


class Ranges:
    """A view of sibling lists."""

    def __init__(self, parts: dict, name: str):
        self.pointers, self.keys = Sequence(parts, f"{name}.pointers."), Sequence(parts, f"{name}.keys.")

    def begin(self, owner: np.ndarray) -> np.ndarray:
        return self.pointers.at(owner)

    def find(self, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Place of the key among the owner's siblings, counted from the first of all; -1 where it is absent, or owner or key is
        negative."""
        out = np.full(len(owner), -1, np.int64)
        asked = np.flatnonzero((owner >= 0) & (key >= 0))
        if not len(asked) or not self.keys.n:
            return out
        begin, end = self.pointers.at(owner[asked]), self.pointers.at(owner[asked] + 1)
        base = np.where(begin > 0, self.keys.at(np.maximum(begin - 1, 0)), 0)
        place = self.keys.find(base + key[asked] + 1)
        hit = (place >= begin) & (place < end)
        out[asked[hit]] = place[hit]
        return out
