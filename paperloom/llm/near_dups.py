"""Near-duplicate classes: BagMinHash signatures, banding, verification of the multiset overlap, components.

Documents are bags of five-word runs (a shorter text is one run) of lower-cased, single-spaced words. Two are linked if the
weighted Jaccard similarity of their bags is ``threshold`` or more; a class is a connected component.

1. Equal texts are one node; a node has a number of its own, so doc_ids decide nothing.
2. ``REGISTERS`` registers in bands of four: a pair at the threshold shares a bucket with a probability of 1 - 5e-8.
3. Each bucket has one hub, the member whose buckets are fullest in all; all members are verified against it. A bucket of any size
   costs as many pairs as it has members, and a family of copies of one text is joined by that text.
4. Members of buckets that still hold several components are compared further, as far as prefix filtering, which is exact, leaves
   them: those that meet on a run are first verified against one hub of that run and of like sizes, as many pairs as rows, and
   their components are joined; pair by pair meet only those that are still in different components.

Prefix filtering is exact under any fixed order of runs and cheap if rare runs come first. The order is by a count filter with four
counters for each run of those members, ``MOST_SLOTS`` at most: a counter is never too low, so a run counted once is in one bag
alone, and where counters are too high only more pairs are verified.

So no verified link is left out, and no bucket is taken whole into a task.

Defined results: a null text is an empty one; empty texts equal each other; rows are judged by their text, so rows of one doc_id
with different texts may be in different classes, and a row without a doc_id is in that of its text; class_id is the least doc_id
of a class, null if none of it has one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bagminhash as bag
from .common import discard, text_or_empty, written
from .components import components

THRESHOLD = 0.8
#: Counters of the filter that orders runs by how many bags hold them: four bytes each, sent to every executor.
LEAST_SLOTS, MOST_SLOTS = 1 << 12, 1 << 20
#: Bags, or runs in all, that are sketched at once, and prefix rows that are handed on at once.
GROUP, GROUP_RUNS, PLACED = 256, 1 << 18, 1 << 18
#: Ratio of neighbouring bins of sizes.
BIN = 1.1


def _words() -> Column:
    return F.trim(F.regexp_replace(F.lower(text_or_empty()), r"(?U)\s+", " "))


def _banded(bags: dict[bytes, np.ndarray]) -> dict[bytes, list[int]]:
    return dict(zip(bags, bag.bands(bag.signatures([*bags.values()])).astype(np.int64).tolist(), strict=True)) if bags else {}


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, digest`` (of the words), ``bands``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words().alias("words")).select("doc_id", F.unhex(F.sha2("words", 256)).alias("digest"), "words")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found: dict[bytes, list[int]] = {}
            held: dict[bytes, np.ndarray] = {}
            runs = 0
            for digest, text in {d: t for d, t in zip(digests, texts, strict=True) if t}.items():
                held[digest] = bag.shingles(text)
                runs += len(held[digest])
                if len(held) >= GROUP or runs > GROUP_RUNS:
                    found |= _banded(held)
                    held, runs = {}, 0
            found |= _banded(held)
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([found.get(d, []) for d in digests], kinds)], ["doc_id", "digest", "bands"])

    return rows.mapInArrow(sketch, "doc_id long, digest binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (u, v), v being the hub, those that are linked."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_bag = None, None
        for batch in batches:
            u, v, one, other = (c.to_pylist() for c in batch.columns)
            keep = []
            for a, b in zip(one, other, strict=True):
                if b != hub:
                    hub, hub_bag = b, bag.shingles(b)
                own = bag.shingles(a)
                low, high = sorted((len(own), len(hub_bag)))
                keep.append(low >= threshold * high and bag.overlap(own, hub_bag) >= threshold)
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns[:2], ["u", "v"])

    ours = texts.select(F.col("node").alias("u"), F.col("words").alias("one"))
    hubs = texts.select(F.col("node").alias("v"), F.col("words").alias("other"))
    return pairs.join(ours, "u").join(hubs, "v").select("u", "v", "one", "other").mapInArrow(verify, "u long, v long")


def _runs(text: str) -> np.ndarray:
    """A bag as a set: its runs, those that repeat numbered by their repeats."""
    ids, counts = np.unique(bag.shingles(text), return_counts=True)
    again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return bag.mix(np.repeat(ids, counts) + again.astype(np.uint64) * np.uint64(bag.BASE))


def _slots(runs: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each run, one in either half of the filter."""
    half = np.uint64(slots // 2)
    return (runs % half).astype(np.int64), ((runs >> np.uint64(32)) % half + half).astype(np.int64)


def _filter_counts(rows: DataFrame, slots: int) -> np.ndarray:
    """How many bags of ``rows`` (node, component, words) hold runs that fall on each counter; ``slots`` numbers at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.int64)
        for batch in batches:
            for text in batch.column(2).to_pylist():
                for at in _slots(_runs(text), slots):
                    np.add.at(held, at, 1)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held[used])], ["slot", "n"])

    most = F.least(F.sum("n"), F.lit(np.iinfo(np.int32).max)).cast("int").alias("n")  # that a run is so frequent is all that counts
    sums = rows.mapInArrow(count, "slot int, n long").groupBy("slot").agg(most).toArrow()
    whole = np.zeros(slots, np.int64)
    whole[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return whole.astype(np.uint32)


def _slots_for(runs: int) -> int:
    """Four counters a run, a power of two within the limits."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (4 * runs - 1).bit_length()))


def _prefixes(members: DataFrame, texts: DataFrame, threshold: float, slots: int | None = None) -> DataFrame:
    """The rows ``node, component, run, own, other`` on which ``members`` (node, component) that can be linked at all meet, by prefix
    filtering.

    Two bags of n and m runs are linked if they share a = (n + m) * t / (1 + t) of them, so with all runs in one order, rarest
    first, they share one of the first n - a + 1 of one and m - a + 1 of the other. Rows meet on such a run and on both bags' bins
    of sizes, for which a is computed. Runs of one bag alone only take places."""
    spark = members.sparkSession
    rows = written(members.join(texts, "node").select("node", "component", "words"), "members")
    slots = slots or _slots_for(rows.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0)  # one number
    counts = spark.sparkContext.broadcast(_filter_counts(rows, slots))  # 4 * slots bytes, 4 MB at most
    bin_of = lambda n: np.floor(np.log(np.maximum(n, 1.0)) / math.log(BIN)).astype(int)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["node", "component", "run", "own", "other"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        parts: list[list[np.ndarray]] = [[] for _ in names]
        size = 0
        for batch in batches:
            for node, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = _runs(text)
                n = len(runs)
                if not n:
                    continue
                one, two = _slots(runs, slots)
                often = np.minimum(counts.value[one], counts.value[two])
                order = np.lexsort((runs, often))
                runs, often = runs[order], often[order]
                others = np.arange(bin_of(n * threshold) - 1, bin_of(n / threshold) + 2)
                least = np.ceil((n + BIN**others.astype(float)) * threshold / (1 + threshold) - 1e-6)
                first = np.clip(n - least + 1, 0, n).astype(int)
                at = np.concatenate([np.arange(k) for k in first])
                other = np.repeat(others, first)
                several = often[at] > 1
                at, other = at[several], other[several]
                for c, x in zip(parts, (np.full(len(at), node), np.full(len(at), component), runs[at].astype(np.int64), np.full(len(at), bin_of(n)), other), strict=True):
                    c.append(x)
                size += len(at)
                if size > PLACED:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(parts, kinds, strict=True)], names)
                    parts, size = [[] for _ in names], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(parts, kinds, strict=True)], names)

    found = written(rows.mapInArrow(placed, "node long, component long, run long, own int, other int"), "prefixes")
    discard(rows)
    return found


def _hub_pairs(found: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``_prefixes``, each once: rows meet on a run and on both bags' bins of sizes, and of those that a row meets it is
    paired with one hub, the least of the least component, if that is not its own. No more pairs than rows."""
    least = F.min(F.struct("component", "node")).alias("hub")
    hubs = written(found.groupBy("run", F.col("own").alias("other"), F.col("other").alias("own")).agg(least), "run_hubs")  # written: a join of two exchanges can split a hot run
    met = found.join(hubs, ["run", "own", "other"]).where("component <> hub.component").select(F.col("node").alias("u"), F.col("hub.node").alias("v"))
    pairs = written(met.groupBy(F.greatest("u", "v").alias("high"), F.least("u", "v").alias("low")).agg(F.min(F.struct("u", "v")).alias("pair")).select("pair.*"), "hub_pairs")
    discard(hubs)
    return pairs


def _apart_pairs(found: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (u, v) of ``_prefixes`` that meet and are of different components, but those ``known`` (u, v)."""
    a, b = found.alias("a"), found.alias("b")
    meet = (F.col("a.run") == F.col("b.run")) & (F.col("a.own") == F.col("b.other")) & (F.col("a.other") == F.col("b.own"))
    apart = (F.col("a.node") > F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    pairs = a.join(b, meet & apart).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    return pairs.join(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")


def _rejoined(links: DataFrame, joined: DataFrame) -> DataFrame:
    """``node, component`` of components ``joined`` that ``links`` (u, v) link further."""
    return components(links.unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))


def labelled(docs: DataFrame, threshold: float = THRESHOLD, slots: int | None = None) -> DataFrame:
    """``doc_id, digest, component, class_id, linked_to, links`` of each row: the digest of its words, the number of its class, the
    least doc_id of the class, the least doc_id of its text's equals and verified links, itself left out if it is the only one; and
    the least doc_ids of its equals and of the texts that it was compared with and is linked to, comma-joined. A link between two
    texts is listed with one of them, so rows and their links, taken together, connect each class."""
    sketch = written(sketches(docs), "sketches")
    nodes = sketch.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written: numbers stay, and a join of two exchanges can split a hot key
    first = (sketch["digest"] == nodes["digest"]) & sketch["doc_id"].eqNullSafe(nodes["least"])
    distinct = sketch.join(nodes, first).select("node", "bands").dropDuplicates(["node"])
    rows = distinct.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node")
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    buckets = written(rows.join(sizes, "bucket"), "buckets")

    wanted = nodes.join(buckets.select("node").distinct(), "node").select("node", F.col("digest").alias("of"), "least")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words().alias("words")).withColumn("digest", F.unhex(F.sha2("words", 256)))
    texts = own.join(wanted, (own["digest"] == wanted["of"]) & own["doc_id"].eqNullSafe(wanted["least"])).select("node", "words")
    texts = written(texts.dropDuplicates(["node"]), "texts")

    central = buckets.groupBy("node").agg(F.sum("size").alias("rank"))
    ranked = written(buckets.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("rank", -F.col("node"))).alias("v")), "hubs")
    stars = buckets.join(ranked, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    stars = written(stars, "stars")
    links = written(_verified(stars, texts, threshold), "links")
    joined = components(links)

    own_or = F.coalesce("component", "node").alias("component")
    marked = buckets.join(joined, "node", "left").select("bucket", "node", own_or)
    still = marked.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    members = written(marked.join(still, "bucket").select("node", "component").distinct(), "open")
    prefixes = _prefixes(members, texts, threshold, slots)
    tried = _hub_pairs(prefixes)
    hubs = written(_verified(tried, texts, threshold), "hub_links")
    joined = _rejoined(hubs, joined)
    now = prefixes.drop("component").join(joined, "node", "left").withColumn("component", own_or)
    several = now.groupBy("run").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("run")
    apart = written(now.join(several, "run", "left_semi"), "apart")
    more = written(_verified(_apart_pairs(apart, tried), texts, threshold), "more")
    discard(sizes, buckets, texts, ranked, stars, members, prefixes, tried, apart)
    whole = _rejoined(more, joined)

    every = links.unionByName(hubs).unionByName(more).distinct()
    ends = every.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(every.select(F.col("v").alias("node"), F.col("u").alias("to")))
    linked = ends.join(nodes.select(F.col("node").alias("to"), F.col("least").alias("to_id")), "to").groupBy("node").agg(F.min("to_id").alias("to_id"))
    own = every.select(F.col("u").alias("node"), F.col("v").alias("to")).join(nodes.select(F.col("node").alias("to"), F.col("least").alias("to_id")), "to")
    linked = linked.join(own.groupBy("node").agg(F.collect_set("to_id").alias("own")), "node", "left")
    named = written(nodes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    ids = written(named.groupBy("component").agg(F.min("least").alias("class_id")), "ids")
    labels = named.join(ids, "component").join(linked, "node", "left")
    listed = F.concat(F.array_compact(F.array(F.when(F.col("copies") > 1, F.col("least")))), F.coalesce("own", F.array().cast("array<long>")))
    labels = labels.select("digest", "component", "class_id", F.when(F.col("copies") > 1, F.least("least", "to_id")).otherwise(F.col("to_id")).alias("linked_to"), F.array_join(F.array_sort(listed), ",").alias("links"))
    labels = written(labels, "labels")
    discard(nodes, links, hubs, more, named, ids)
    return sketch.select("doc_id", "digest").join(labels, "digest")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, linked_to, links`` of each row."""
    return labelled(docs, threshold).select("doc_id", "class_id", "linked_to", "links")


def without_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that with the least doc_id (rows without one come last), then the least digest of its words; of rows
    with equal doc_id and words, any one. Columns of ``docs`` are kept whatever their names."""
    rows = labelled(docs, threshold).groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n"))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")).alias("best"))
    best = written(best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.digest").alias("kept_digest"), "best.n"), "kept")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.unhex(F.sha2(_words(), 256)).alias("digest"))
    same = held["key"].eqNullSafe(best["kept_id"]) & (held["digest"] == best["kept_digest"])
    single = held.join(best.where("n = 1"), same, "left_semi")
    several = held.join(best.where("n > 1"), same, "left_semi").dropDuplicates(["key", "digest"])
    return single.unionByName(several).select("row.*")
