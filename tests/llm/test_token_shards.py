"""Wavelet matrices against arrays, and shards against the tokenizers library."""

import collections
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from paperloom.llm import token_shards, wavelet

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def written(ids, docs=(1,), lengths=None):
    file = io.BytesIO()
    ids = np.array(ids, np.uint32)
    assert wavelet.write(file, ids, list(docs), lengths or [len(ids)]) == len(file.getvalue())
    return wavelet.Shard(file)


@pytest.mark.parametrize("chunk", [8, 64, 1 << 15])
@pytest.mark.parametrize("most", [0, 1, 5, 300, 70_000, 2**32 - 1])
def test_wavelet_matrix(monkeypatch, chunk, most):
    monkeypatch.setattr(wavelet, "CHUNK", chunk)
    monkeypatch.setattr(wavelet, "BITS", 8 * chunk)
    rng = random.Random(most)
    for n in (1, 63, 64, 512, 1_337):
        ids = np.array([rng.choice((0, most, rng.randint(0, most))) for _ in range(n)], np.uint32)
        shard = written(ids)
        assert shard.ids().tolist() == ids.tolist()
        places = np.array([rng.randrange(n) for _ in range(50)])
        assert shard.access(places).tolist() == ids[places].tolist()
        for token in {0, most, most // 2, int(ids[0]), 2**32}:
            cuts = np.array([sorted((rng.randint(0, n), rng.randint(0, n))) for _ in range(20)])
            assert shard.count(token, cuts[:, 0], cuts[:, 1]).tolist() == [int((ids[a:b] == token).sum()) for a, b in cuts]
            assert shard.locate(token).tolist() == np.flatnonzero(ids == token).tolist()


def test_broken_files_are_refused():
    with pytest.raises(ValueError, match="not a shard"):
        wavelet.Shard(io.BytesIO(b"x" * 100))


def test_a_lookup_reads_a_chunk_a_plane():
    shard = written(np.random.default_rng(1).integers(0, 1 << 10, 1 << 20))
    read = []
    shard._read = lambda start, size, before=shard._read: read.append(size) or before(start, size)
    shard.access(np.array([777_777]))
    assert len(read) == shard.levels == 10


@pytest.fixture(scope="module")
def corpus():
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    odd = [(None, "nobody's"), (None, None), (-3, ""), (5_000, "twice"), (5_000, "twice"), (5_001, "long " * 4_000), (2**62, "<|endoftext|> inside")]
    return [*zip(table["doc_id"], table["text"], strict=True), *odd]


def test_shards(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = spark.createDataFrame([(t, "en", d, 1, "p", 2) for d, t in corpus], "text string, lang string, doc_id long, row long, part string, start long")
    token_shards.write_shards(rows.repartition(3), path, TOKENIZER, shard_tokens=3_000)
    library = Tokenizer.from_file(TOKENIZER)
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    got = sorted(map(tuple, token_shards.documents(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert collections.Counter((r[0], tuple(r[5])) for r in got) == collections.Counter((d, tuple(ids(t))) for d, t in corpus)
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    whole = [i for r in got for i in r[5]]
    at = 0
    for doc_id, start, n, crc, ends, own in got:
        assert (start, n, crc, ends) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own.count(0))
        at += n
    assert token_shards.manifest(spark, path).count() > 20  # documents of over 3,000 ids have shards of their own
    tokens = [0, whole[0], whole[1_000], 50_256, 99_999]
    assert dict(map(tuple, token_shards.counts(spark, path, tokens).collect())) == {t: whole.count(t) for t in tokens}
    found = token_shards.occurrences(spark, path, whole[1_000]).collect()
    starts = {r[1]: r[0] for r in got}
    assert sorted(r["position"] for r in found) == [i for i, t in enumerate(whole) if t == whole[1_000]]
    assert all(starts[r["position"] - r["place"]] == r["doc_id"] for r in found)
    places = [0, 1, at - 1, at, -1, *range(0, at, 997)]
    asked = spark.createDataFrame([(p,) for p in places], "position long")
    assert sorted(map(tuple, token_shards.tokens_at(asked, path).collect())) == sorted((p, whole[p]) for p in places if 0 <= p < at)


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_shards.round_trip(none, f"file://{tmp_path}/none", TOKENIZER).isEmpty()
