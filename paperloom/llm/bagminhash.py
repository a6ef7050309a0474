"""Weighted-Jaccard signatures by BagMinHash, computed for many bags at once with numpy.

A bag is a set of hashed elements with whole-number weights. Weights are laid out on dyadic levels [0,1), [1,2), [2,4), [4,8) ...;
each element has, on each level that its weight reaches into, a Poisson process of points in time. A point falls into a random one
of ``REGISTERS`` registers and at a random height of its level, and counts if the height is below the weight. A register keeps
its first point; two bags keep the same one with the probability of their weighted Jaccard similarity. A process is followed only
until its time is past the latest register of its bag.
"""

from __future__ import annotations

import numpy as np

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
SHINGLE = 5
SEGMENT = 1 << 15
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of ``BASE`` and of its inverse, grown as texts need them."""

    size = 0
    up = down = np.ones(1, _U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(1 << 16, 1 << n.bit_length())
            one = lambda b: np.cumprod(np.concatenate((np.ones(1, _U), np.full(cls.size, b, _U))))
            cls.up, cls.down = one(BASE), one(_INVERSE)
        return cls.up, cls.down


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; words are single-spaced. A shorter text is one run, an empty one has none."""
    if not text:
        return np.empty(0, _U)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(raw)]))
    size = min(size, len(starts))
    starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    out = np.empty(len(starts), _U)
    for at in range(0, len(starts), SEGMENT):
        a, b = starts[at : at + SEGMENT], ends[at : at + SEGMENT]
        up, down = _Powers.to(int(b[-1] - a[0]) + 1)
        sums = np.concatenate((np.zeros(1, _U), np.cumsum((raw[a[0] : b[-1]].astype(_U) + _U(1)) * up[: b[-1] - a[0]])))
        out[at : at + SEGMENT] = (sums[b - a[0]] - sums[a - a[0]]) * down[a - a[0]]
    return mix(out)


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """For each bag, given as hashes with repeats and not empty, the points its registers keep."""
    docs, seeds, lows, weights = [], [], [], []
    for d, bag in enumerate(bags):
        elements, counts = np.unique(bag, return_counts=True)
        level, low = 0, 0
        while len(elements):
            docs.append(np.full(len(elements), d))
            seeds.append(mix(elements + _U(level * 0xD6E8FEB86659FD93 & (2**64 - 1))))
            lows.append(np.full(len(elements), low))
            weights.append(counts)
            level, low = level + 1, max(1, low * 2)
            elements, counts = elements[counts > low], counts[counts > low]
    doc, seed, low, weight = map(np.concatenate, (docs, seeds, lows, weights))
    first, kept = np.full(len(bags) * REGISTERS, np.inf), np.zeros(len(bags) * REGISTERS, _U)
    height = np.maximum(low, 1)
    time, step = np.zeros(len(doc)), 1
    while len(doc):
        many = int(np.clip((1 << 15) // len(doc), 1, 64))
        points = mix(seed[:, None] + np.arange(step, step + many, dtype=_U) * _U(BASE))
        waits = -np.log(((points >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (REGISTERS * height[:, None])
        times = time[:, None] + np.cumsum(waits, axis=1)
        where = mix(points ^ _U(0xA0761D6478BD642F))
        at = (doc * REGISTERS)[:, None] + (where >> _U(57)).astype(np.int64)
        inside = (low[:, None] + (where & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * height[:, None] < weight[:, None]) & (times < first[at])
        at, new, point = at[inside], times[inside], points[inside]
        np.minimum.at(first, at, new)
        won = first[at] == new
        kept[at[won]] = point[won]
        time, step = times[:, -1], step + many
        alive = time <= first.reshape(-1, REGISTERS).max(axis=1)[doc]
        doc, seed, low, weight, height, time = (x[alive] for x in (doc, seed, low, weight, height, time))
    return kept.reshape(-1, REGISTERS)


def bands(kept: np.ndarray) -> np.ndarray:
    """A hash for each band of registers."""
    parts = kept.reshape(len(kept), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=_U)), parts.shape[:2])
    for i in range(ROWS):
        out = mix(out ^ parts[:, :, i]) + _U(i)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of hashes."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(m[i], n[j]).sum())
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 1.0
