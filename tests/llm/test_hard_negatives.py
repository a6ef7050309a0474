"""Hard negatives against a plain version over all pairs."""

import collections
import math
import random

import numpy as np
import pytest

from paperloom.llm import hard_negatives as hn

EMBEDDINGS = "vec_id long, label int, embedding array<double>, anchor long, score long, row string, vector string, windows int"


def plain(rows, every=100, positives=5, negatives=5, low=80):
    """``rows``: vec_id, label, vector."""
    alive = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        alive.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = collections.Counter()
    for i, (anchor, own, v) in enumerate(alive):
        if anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), vec_id, label) for j, (vec_id, label, w) in enumerate(alive) if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for score, positive, _ in [x for x in scored if x[2] == own][:positives]:
            near = [x for x in scored if x[2] != own and low * score <= 100 * x[0] <= 100 * score][:negatives]
            out.update((anchor, positive, rank, x[1], score, x[0]) for rank, x in enumerate(near, 1))
    return out


def made(rng, n, dim, labels, values):
    return [(i, rng.randrange(labels), [rng.choice(values) if values else rng.gauss(0, 0.2) for _ in range(dim)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "r", "v", 3) for r in rows], EMBEDDINGS)


@pytest.mark.parametrize("dim, labels, values", [(8, 3, None), (2, 2, [0.0, 0.25, 0.5]), (3, 10, [-0.5, 0.5]), (4, 1, None)])
def test_same_as_plain(spark, monkeypatch, dim, labels, values):
    """Small blocks; many ties where vectors have few values; without other labels there are no negatives."""
    monkeypatch.setattr(hn, "BLOCK", 3)
    monkeypatch.setattr(hn, "HELD", 100)
    rows = made(random.Random(dim), 400, dim, labels, values)
    rows += [rows[100], rows[100], (200, 1, [0.1] * dim), rows[7], rows[7]]
    rows += [(None, 1, [0.1] * dim), (900, None, [0.1] * dim), (901, 1, None), (902, 1, [None] * dim), (903, 1, [math.nan] * dim), (904, 1, [math.inf] * dim), (1_000, 1, []), (-100, 1, [0.3] * dim), (800, 0, [0.2] * (dim + 1)), (801, 0, [0.2] * (dim + 1)), (802, 1, [0.2] * (dim + 1))]
    got = collections.Counter(map(tuple, hn.hard_negatives(frame(spark, rows)).collect()))
    assert got == plain(rows)
    assert bool(got) == (labels > 1 or dim == 4)


def test_other_parameters(spark):
    rows = made(random.Random(5), 120, 4, 3, None)
    got = collections.Counter(map(tuple, hn.hard_negatives(frame(spark, rows), every=10, positives=2, negatives=50, low=10).collect()))
    assert got == plain(rows, 10, 2, 50, 10) and got


def test_large_components(spark):
    """Sums beyond 2^53, and beyond what can be packed with a place."""
    rng = random.Random(6)
    rows = [(i, rng.randrange(2), [rng.choice((2.0e5, 2.0e5 + 0.5, 1.9e5)), rng.choice((1.0e6, 4.0e6))]) for i in range(150)]
    assert collections.Counter(map(tuple, hn.hard_negatives(frame(spark, rows)).collect())) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        hn.hard_negatives(frame(spark, [(i, 0, [1.0e9] * 3) for i in range(101)]))


def test_ordered():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 61):
        scores = rng.integers(-most, most, (20, 50))
        scores[:, ::3] = scores[:, :1]
        values, columns = hn.ordered(scores)
        for row, v, at in zip(scores, values, columns, strict=True):
            assert list(zip(v.tolist(), at.tolist(), strict=True)) == sorted(((s, c) for c, s in enumerate(row.tolist())), key=lambda x: (x[0], -x[1]))


def test_keys_sort_as_their_parts():
    parts = [(a, n, v, s) for a in (0, 5, 1 << 62) for n in (False, True) for v in (-(1 << 63), -1, 0, 3, (1 << 63) - 1) for s in (-(1 << 63) + 1, -1, 0, 7, (1 << 63) - 1)]
    keys = sorted(hn.packed(*p) for p in parts)
    assert [hn.unpacked(k) for k in keys] == sorted(parts, key=lambda p: (p[0], -p[3], p[1], p[2]))


def test_no_rows(spark):
    assert hn.hard_negatives(frame(spark, [])).isEmpty()
    assert hn.hard_negatives(frame(spark, [(1, 1, [0.5])])).isEmpty()
