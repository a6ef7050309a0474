"""Wavelet matrices of token ids, and the file of a shard that holds one.

A wavelet matrix has a plane of bits for each bit of the ids, the highest first. Each plane has that bit of all ids in the order that
the planes above leave: those with a 0 come first, either kind in the order it had. With ranks (ones before a place) and selects (the
place of the k-th one) on the planes, an id is read, occurrences in a stretch are counted, and the k-th is found, in as many steps as
there are planes.

The file: planes in chunks of ``CHUNK`` bytes, each compressed by itself, then a table of documents (ids and lengths), then a footer
that has where each chunk is and how many ones stand before it, and the footer's length. So a lookup inflates a chunk a plane.
"""

from __future__ import annotations

import functools
import json
import struct
from typing import BinaryIO

import numpy as np
import zstandard

MAGIC = b"WAVELET1"
#: Bytes, and bits, of a plane that are compressed together.
CHUNK = 1 << 15
BITS = 8 * CHUNK
TAIL = struct.Struct("<Q8s")


def _kind(levels: int) -> type:
    """The narrowest type for ids of so many bits."""
    return np.uint16 if levels <= 16 else np.uint32


def planes(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The planes of ``ids``, as bytes of packed bits, and how many zeros each has."""
    out, zeros = [], []
    levels = int(ids.max()).bit_length() if len(ids) else 0
    ids = ids.astype(_kind(levels), copy=False)
    for bit in reversed(range(levels)):
        ones = (ids >> ids.dtype.type(bit) & ids.dtype.type(1)).astype(bool)
        out.append(np.packbits(ones, bitorder="little"))
        ids = np.concatenate((ids[~ones], ids[ones]))
        zeros.append(len(ids) - int(np.count_nonzero(ones)))
    return out, zeros


def write(out: BinaryIO, ids: np.ndarray, docs: list[int | None], lengths: list[int]) -> int:
    """Write a shard of documents' ``ids``, one document after the other; returns the bytes written."""
    at, compress = out.write(MAGIC), zstandard.ZstdCompressor(3).compress

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        start, packed = at, compress(data)
        at += out.write(packed)
        return start, len(packed)

    bits, zeros = planes(ids)
    spec: dict = {"n": len(ids), "zeros": zeros, "planes": []}
    for plane in bits:
        chunks, ones = [], 0
        for c in range(0, len(plane), CHUNK):
            part = plane[c : c + CHUNK]
            chunks.append((*put(part.tobytes()), ones))
            ones += int(np.bitwise_count(part).sum())
        spec["planes"].append(chunks)
    known = np.array([d is not None for d in docs], np.uint8)
    spec["docs"] = [put(x.tobytes()) for x in (np.array([d or 0 for d in docs], "<i8"), known, np.array(lengths, "<i8"))]
    _, size = put(json.dumps(spec).encode())
    out.write(TAIL.pack(size, MAGIC))
    return at + TAIL.size


class Shard:
    """A shard's file, open for reading at any place."""

    def __init__(self, file: BinaryIO):
        self.file = file
        end = file.seek(0, 2)
        size, magic = TAIL.unpack(self._read(end - TAIL.size, TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        spec = json.loads(self._inflated(end - TAIL.size - size, size))
        self.n, self.zeros, self.planes = spec["n"], spec["zeros"], spec["planes"]
        self.levels = len(self.planes)
        ids, known, lengths = (self._inflated(*x) for x in spec["docs"])
        self.lengths = np.frombuffer(lengths, "<i8")
        self.docs = [d if k else None for d, k in zip(np.frombuffer(ids, "<i8").tolist(), known, strict=True)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = [np.array([c[2] for c in chunks] + [self.n - z], np.int64) for chunks, z in zip(self.planes, self.zeros, strict=True)]
        self.chunk = functools.lru_cache(2 * self.levels + 2)(self._chunk)

    def _read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def _inflated(self, start: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._read(start, size))

    def _raw(self, level: int, chunk: int) -> np.ndarray:
        start, size, _ = self.planes[level][chunk]
        return np.frombuffer(self._inflated(start, size), np.uint8)

    def _chunk(self, level: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of 64 bits of a chunk, one more than it has, and the ones before each."""
        raw = self._raw(level, chunk)
        words = np.frombuffer(raw.tobytes() + bytes(-len(raw) % 8 + 8), "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return words, np.cumsum(counts) - counts

    def rank(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each of ``places`` in a plane, and whether there is a one at it; the place past the end counts too."""
        chunks = places // BITS
        ranks, here = self.before[level][np.minimum(chunks, len(self.planes[level]))].copy(), np.zeros(len(places), bool)
        for c in np.unique(chunks[chunks < len(self.planes[level])]).tolist():
            of = np.flatnonzero(chunks == c)
            words, before = self.chunk(level, c)
            word, bit = places[of] % BITS // 64, (places[of] % 64).astype(np.uint64)
            found = words[word]
            ranks[of] += before[word] + np.bitwise_count(found & ((np.uint64(1) << bit) - np.uint64(1)))
            here[of] = found >> bit & np.uint64(1)
        return ranks, here

    def select(self, level: int, numbers: np.ndarray, one: bool) -> np.ndarray:
        """The places of the ones, or zeros, with these numbers (from 0) in a plane."""
        before = self.before[level][:-1]
        if not one:
            before = np.arange(len(before)) * BITS - before
        chunks, out = np.searchsorted(before, numbers, side="right") - 1, np.zeros(len(numbers), np.int64)
        for c in np.unique(chunks).tolist():
            of = np.flatnonzero(chunks == c)
            places = np.flatnonzero(np.unpackbits(self._raw(level, c), bitorder="little") == one)
            out[of] = c * BITS + places[numbers[of] - before[c]]
        return out

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``."""
        places, ids = np.asarray(places, np.int64), np.zeros(len(places), np.uint32)
        for level, zeros in enumerate(self.zeros):
            ranks, one = self.rank(level, places)
            ids = ids << np.uint32(1) | one
            places = np.where(one, zeros + ranks, places - ranks)
        return ids

    def _narrowed(self, token: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of ``token`` in the stretches are below the last plane."""
        start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
        if token >> self.levels:
            return start, start
        for level, zeros in enumerate(self.zeros):
            one = token >> (self.levels - 1 - level) & 1
            a, b = self.rank(level, start)[0], self.rank(level, end)[0]
            start, end = (zeros + a, zeros + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``token`` occurs in each of the stretches."""
        a, b = self._narrowed(token, start, end)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """All places of ``token``, in order."""
        (a,), (b,) = self._narrowed(token, np.array([0]), np.array([self.n]))
        places = np.arange(a, b)
        if not len(places):
            return places
        for level in reversed(range(self.levels)):
            one = bool(token >> (self.levels - 1 - level) & 1)
            places = self.select(level, places - self.zeros[level] if one else places, one)
        return places

    def ids(self) -> np.ndarray:
        """All ids: what the last plane has in its order is dealt back to the order of the plane above, again and again."""
        kind = _kind(self.levels)
        ids = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            raw = np.concatenate([self._raw(level, c) for c in range(len(self.planes[level]))])
            ones = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            above, bit = np.empty_like(ids), kind(1 << (self.levels - 1 - level))
            above[~ones] = ids[: self.zeros[level]]
            above[ones] = ids[self.zeros[level] :] | bit
            ids = above
        return ids.astype(np.uint32, copy=False)
