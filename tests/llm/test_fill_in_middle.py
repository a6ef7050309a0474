"""Fill-in-middle against the rule on code points, and rotations against slices."""

import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest

from paperloom.llm import fill_in_middle as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, output string, form string, restored string"
ODD = [None, "", " ", "\n\t  ", "one", " one", "one ", "a<P>b", "<S>", "< P>", "<<S", "\x1c x\x85y z", "ünï 😀  çödé\r\n", "a" * 200_000, " " * 200_000, "word " * 40_000, "x\x0b" * 70_000, "<" * 50 + " " + "P>" * 50]


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_transform_and_restore(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    docs = [*zip(table["doc_id"], table["text"], strict=True), *((1_000 + 40 * i + k, t) for i, t in enumerate(ODD) for k in range(8)), (None, "no id here"), (None, None), (7, "again and again"), (7, "again and again")]
    rows = spark.createDataFrame([(d, t, "o", "f", "r") for d, t in docs], DOCS)
    found = fim.transform(rows)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted((plain(d, t) for d, t in docs), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    back = fim.restore(found).select("doc_id", "restored").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t in docs), key=str)
    short = {tuple(r) for r in fim.digests(rows).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert short == {(*p[:5], sha(p[5]), sha(t)) for d, t in docs for p in [plain(d, t)]}


def test_no_rows_null_forms_and_names_that_clash(spark):
    assert fim.digests(spark.createDataFrame([], DOCS)).isEmpty()
    rows = spark.createDataFrame([(1, "<S>c<P>a<M>b", "spm", "x", "y"), (2, None, "spm", "x", "y"), (3, "t", None, "x", "y"), (4, "t", "plain", "x", "y")], "id long, output string, form string, row string, restored string")
    out = fim.restore(rows)
    assert out.columns == ["id", "output", "form", "row", "restored"]
    assert [(r["id"], r["row"], r["restored"]) for r in out.orderBy("id").collect()] == [(1, "x", "abc"), (2, "x", None), (3, "x", None), (4, "x", "t")]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_small_chunks(monkeypatch, chunk):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(0, 40)))
        a, b, c = sorted(rng.randint(0, len(data)) for _ in range(3))
        buffer = bytearray(data)
        fim.rotate(buffer, a, b, c)
        assert bytes(buffer) == data[:a] + data[b:c] + data[a:b] + data[c:]
        text = "".join(rng.choice("ab \t\né😀") for _ in range(rng.randint(0, 30)))
        units, found = fim.Units(text.encode()), UNITS.findall(text)
        assert units.total == len(found)
        assert [units.end(k) for k in range(len(found) + 1)] == [len("".join(found[:k]).encode()) for k in range(len(found) + 1)]
        first, second = sorted((units.end(rng.randint(0, len(found))), units.end(rng.randint(0, len(found)))))
        for form in ("psm", "spm"):
            assert fim.joined(bytes(fim.split(text.encode(), form, first, second)), form) == text.encode()
