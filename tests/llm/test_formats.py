"""Chat formatting and WARC archives."""

import collections
import gzip
import hashlib
import random
import zlib

import duckdb
import pytest

from paperloom.llm import chat, queries, warc
from paperloom.llm.common import new_path

DATA = "/root/testdata/sf0.001"
TURNS = "pair_id long, turn long, role string, text string, prompt string"


def test_preferences(spark):
    same = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "Hello 😀", "x"), (1, 2, "user", "more", "x")]
    chosen = [*same, (1, 3, "assistant", "good", "x"), (2, 0, "user", "only", "x"), (3, 0, None, None, "x"), (None, 0, "user", "lost", "x"), (4, 0, "assistant", "a", "x")]
    rejected = [*same, (1, 3, "assistant", "bad", "x"), (1, 4, "user", "why", "x"), (1, 5, "assistant", "so", "x"), (3, 0, "", "", "x"), (4, 0, "user", "a", "x"), (5, 0, "user", "q", "x")]
    rows = {r["pair_id"]: r for r in chat.preferences(spark.createDataFrame(chosen, TURNS), spark.createDataFrame(rejected, TURNS)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    one = rows[1]
    assert one["prompt_turns"] == 3
    assert one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nHello 😀<|end|>\n<|user|>\nmore<|end|>\n"
    cut = lambda text, spans: [text[int(a) : int(b)] for a, b in (s.split(":") for s in spans.split(",") if s)]
    assert cut(one["chosen"], one["chosen_spans"]) == ["good<|end|>\n"]
    assert cut(one["rejected"], one["rejected_spans"]) == ["bad<|end|>\n", "so<|end|>\n"]
    assert (rows[2]["prompt_turns"], rows[2]["chosen"], rows[2]["rejected"]) == (0, "<|user|>\nonly<|end|>\n", "")
    assert (rows[3]["prompt_turns"], rows[3]["chosen"], rows[3]["rejected"]) == (1, "", "")
    assert (rows[4]["chosen_spans"], rows[4]["rejected_spans"]) == ("14:23", "")
    assert chat.preferences(spark.createDataFrame([], TURNS), spark.createDataFrame([], TURNS)).isEmpty()


def test_long_conversation(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"t{k}", "x") for k in range(600)]
    row = chat.preferences(spark.createDataFrame(turns, TURNS), spark.createDataFrame(turns[:300], TURNS)).first()
    assert row["prompt_turns"] == 300 and row["rejected"] == "" and row["chosen_spans"].count(",") == 149


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert collections.Counter(tuple(r[c] for c in cols) for r in df.collect()) == collections.Counter(want.fetchall())


PAGES = [(1, "http://a/ b", "x" * 120), (2, None, "x" * 120), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", "x" * 120), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: response\r\n" * 9), (8, "u", "é😀" * 50), (9, "u", "é😀" * 50), (9, "u", "é😀" * 50)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives(spark, compression, monkeypatch):
    write = warc.write_warc
    monkeypatch.setattr(warc, "write_warc", lambda pages, path: write(pages, path, compression=compression))
    pages = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, bytes int, digest string").repartition(3)
    path = new_path(spark, "warc")
    rows = warc.round_trip(pages, path).collect()
    want = collections.Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        least = min((p for p, _, h in PAGES if h == html and p is not None), default=None)
        again = len(data) >= 100 and least != page
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None] += 1
    assert collections.Counter(map(tuple, rows)) == want
    assert warc.round_trip(pages.limit(0), new_path(spark, "warc")).isEmpty()
    found = warc.read_warc(spark, path).where("record_type in ('response', 'revisit') and record_id = '<urn:page:2>'").collect()
    assert [(r["record_type"], r["refers_to"], r["payload"]) for r in found] == [("revisit", "<urn:page:1>", None)]
    assert warc.read_warc(spark, path).where("record_id = '<urn:page:1>'").first()["target_uri"] == "http://a/%20b"


def test_filters_reach_the_reader(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    plan = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "= revisit" not in plan and "BatchScan warc" in plan
    reader = warc.WarcReader({"path": path})
    left = [*reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)])]
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    assert {r[0] for part in reader.partitions() for batch in reader.read(part) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)} == {"revisit"}


def test_members_are_records_and_unwanted_ones_are_not_inflated(spark, monkeypatch):
    path = new_path(spark, "warc")
    rng = random.Random(1)
    pages = [(k, "u\x01 v", "".join(chr(rng.randrange(33, 1_000)) for _ in range(60_000))) for k in range(4)] + [(9, "u", "q" * 3_000_000)]
    warc.write_warc(spark.createDataFrame([*pages, (5, "u", pages[0][2])], "page_id long, url string, html string").coalesce(1), path)
    system, names = warc.files_of(path)
    assert len(names) == 1 and names[0].endswith(".warc.gz")
    data, members = system.open_input_file(names[0]).read(), 0
    while data:
        inflate = zlib.decompressobj(zlib.MAX_WBITS | 16)
        record = inflate.decompress(data) + inflate.flush()
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and inflate.eof
        data, members = inflate.unused_data, members + 1
    assert members == 6
    inflated = []
    readinto = warc.Member.readinto
    monkeypatch.setattr(warc.Member, "readinto", lambda self, buffer: inflated.append(n := readinto(self, buffer)) or n)
    reader = warc.WarcReader({"path": path})
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    found = [r for part in reader.partitions() for batch in reader.read(part) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert len(found) == 1 and found[0][2] == "u" and sum(inflated) <= 6 * warc.CHUNK
    whole = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert whole["<urn:page:2>"]["payload"].decode() == pages[2][2] and whole["<urn:page:2>"]["target_uri"] == "u%01%20v"
    assert len(whole["<urn:page:9>"]["payload"]) == 3_000_000


def test_only_listed_files_are_read(spark):
    path = new_path(spark, "warc")
    for k in (1, 2):
        warc.write_warc(spark.createDataFrame([(k, "u", "x")], "page_id long, url string, html string"), path)
    system, names = warc.files_of(path)
    with system.open_output_stream(names[0].rpartition("/")[0] + "/part-lost.warc", compression=None) as out:
        out.write(b"what a lost task left")
    assert {r["record_id"] for r in warc.read_warc(spark, path).collect()} == {"<urn:page:1>", "<urn:page:2>"}


def test_foreign_archive(spark, tmp_path):
    """Members of their own, other record types, no HTTP head."""
    record = lambda kind, block: b"WARC/1.0\r\nWARC-Type: %s\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(block), block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"warcinfo", b"software: x\r\n\r\nmore")) + gzip.compress(record(b"resource", b"\x00\xffbytes")))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("record_type").collect()
    assert [(r["record_type"], bytes(r["payload"])) for r in rows] == [("resource", b"\x00\xffbytes"), ("warcinfo", b"software: x\r\n\r\nmore")]


def test_the_round_trip_pushes_filters(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", "y"), (4, "u", "y"), (5, None, None)], "page_id long, url string, html string")
    rows = warc.round_trip(pages, f"file://{tmp_path}/archive")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "filter" not in [line.split("(")[0].strip(" *+-:").lower() for line in plan.splitlines()]
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows.collect()) == [(1, 200, "response", None), (2, 200, "revisit", 1), (3, 1, "response", None), (4, 1, "response", None), (5, 0, "response", None)]


def test_hadoop_names_of_s3():
    """As far as a box without network can tell: the scheme is known."""
    from unittest import mock

    from paperloom.llm import common

    with mock.patch("pyarrow.fs.FileSystem") as fs:
        common.filesystem("s3a://bucket/a")
        common.filesystem("/a")
        assert [c.args[0] for c in fs.from_uri.call_args_list] == ["s3://bucket/a", "file:///a"]
