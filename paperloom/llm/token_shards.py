"""Token ids of a corpus in shards, each a wavelet matrix in one compressed file, in ascending order of doc_id.

Texts are dealt out to ranges of doc_id and sorted there; a task encodes its documents as they come and writes a shard whenever the
next document would take it past ``shard_tokens``, so it holds one shard's ids, or one document's. The files it wrote are rows of a
manifest that Spark writes, so what a failed attempt has left is in no manifest and never read. Where a shard begins among all ids
follows from the manifest: sums of ranges, then of a range's shards.

Readers open the files where they are: whole documents by planes, and single ids, counts and places of a token by rank and select.

Defined results: a null text is an empty one (only the end id); a null doc_id comes first and stays null; repeated rows are documents
of their own; of rows with one doc_id the order is that of a hash of their texts, then of the texts; other columns are ignored; an
empty table has no shards and gives no rows. ``docs`` should be a table that is read alike each time (a file, a written table), as
its rows are dealt out by it.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wavelet
from .bpe import load
from .common import filesystem, partitions, text_or_empty

SHARD_TOKENS = 1 << 22
MANIFEST = "part int, shard int, file string, n_docs long, n_tokens long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, n_ends long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, split_chars: int = 1 << 15) -> None:
    """Encode ``docs`` into shards below ``path``, with ``end_id`` behind each document, and write the manifest beside them."""
    spark = docs.sparkSession

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe, number = TaskContext.get().partitionId(), load(tokenizer), 0
        system, root = filesystem(path)
        system.create_dir(root)
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            name = f"{part:06}-{number:06}-{uuid.uuid4().hex}.wm"
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                n_bytes = wavelet.write(out, np.concatenate(held), ids, [len(x) for x in held])
            row = (part, number, name, len(ids), size, n_bytes)
            held.clear()
            ids.clear()
            number, size = number + 1, 0
            return _batch([row], MANIFEST)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.append(bpe.encode_long(text, split_chars), end_id).astype(np.uint32)
                if held and size + len(own) > shard_tokens:
                    yield flush()
                held.append(own)
                ids.append(doc_id)
                size += len(own)
        if held:
            yield flush()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})  # so that ranges can split equal rows
    ranges = rows.repartitionByRange(partitions(spark), "doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    ranges.mapInArrow(shards, MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the number of ids before each."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("of_part", Window.orderBy("part")).alias("base"))  # one small row for each range
    return rows.join(parts, "part").withColumn("start", F.col("base") + before("n_tokens", Window.partitionBy("part").orderBy("shard"))).drop("base")


def _by_shard(spark: SparkSession, path: str, rows: DataFrame, use: Callable[[wavelet.Shard, list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``use(shard, its rows)`` makes of the shards named in ``rows`` (file and others); a shard's rows come together, at most a
    batch of them at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(path)
        name, file, shard = None, None, None
        for batch in batches:
            for found, of in itertools.groupby(batch.to_pylist(), lambda row: row["file"]):
                if found != name:
                    if file:
                        file.close()
                    name, file = found, system.open_input_file(f"{root}/{found}")
                    shard = wavelet.Shard(file)
                yield from use(shard, list(of))
        if file:
            file.close()

    return rows.mapInArrow(read, schema)


def documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32, n_ends`` (end ids in it, counted by rank) of each
    document; with ``ids`` if asked for."""
    schema = DOCUMENTS + ", ids array<long>" * with_ids

    def every(shard: wavelet.Shard, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        start = rows[0]["start"]
        ids, ends = shard.ids().astype("<u4", copy=False), shard.starts + shard.lengths
        counts = shard.count(0, shard.starts, ends).tolist()
        own = [ids[a:b] for a, b in zip(shard.starts.tolist(), ends.tolist(), strict=True)]
        columns = [shard.docs, (start + shard.starts).tolist(), shard.lengths.tolist(), [zlib.crc32(x) for x in own], counts]
        yield _batch(list(zip(*columns, *([[x.astype(np.int64) for x in own]] if with_ids else []), strict=True)), schema)

    rows = manifest(spark, path).select("file", "start").repartition(partitions(spark))
    return _by_shard(spark, path, rows, every, schema)


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of ``tokens`` occurs in the corpus; shards are counted by rank, not read."""

    def some(shard: wavelet.Shard, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        yield _batch([(t, int(shard.count(t, np.array([0]), np.array([shard.n]))[0])) for t in dict.fromkeys(tokens)], "token long, n long")

    rows = manifest(spark, path).select("file", "start").repartition(partitions(spark))
    return _by_shard(spark, path, rows, some, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``doc_id, position`` (among all ids), ``place`` (in the document) of each occurrence of ``token``, found by select."""

    def some(shard: wavelet.Shard, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        places, start = shard.locate(token), rows[0]["start"]
        of = np.searchsorted(shard.starts, places, side="right") - 1
        if len(places):
            yield _batch(list(zip([shard.docs[d] for d in of.tolist()], (start + places).tolist(), (places - shard.starts[of]).tolist(), strict=True)), "doc_id long, position long, place long")

    rows = manifest(spark, path).select("file", "start").repartition(partitions(spark))
    return _by_shard(spark, path, rows, some, "doc_id long, position long, place long")


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """``position, token`` for rows of ``position`` (among all ids); places that there are not are left out. Positions and shards meet
    on stretches of ``SHARD_TOKENS``, and a shard's positions are dealt out to several tasks."""
    spark = positions.sparkSession
    stretch = lambda c: F.floor(c / SHARD_TOKENS)
    shards = manifest(spark, path).withColumn("end", F.col("start") + F.col("n_tokens"))
    shards = shards.select("file", "start", "end", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end") - 1))).alias("stretch"))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("stretch", stretch(F.col("position")))
    met = asked.join(shards, "stretch").where("position >= start and position < end").select("file", "start", "position")
    met = met.repartition(partitions(spark), "file", F.pmod(F.xxhash64("position"), F.lit(16))).sortWithinPartitions("file", "position")

    def one(shard: wavelet.Shard, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        at = np.array([r["position"] for r in rows])
        yield _batch(list(zip(at.tolist(), shard.access(at - rows[0]["start"]).tolist(), strict=True)), "position long, token long")

    return _by_shard(spark, path, met, one, "position long, token long")


def round_trip(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` to shards below ``path`` and read them back: the rows of ``documents``."""
    write_shards(docs, path, tokenizer)
    return documents(docs.sparkSession, path)
