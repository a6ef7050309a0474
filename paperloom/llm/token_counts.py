"""Token counts: encode Arrow batches, return lengths only.

Arrow batches are cut into groups of about ``group_bytes`` of text, and a text of over ``split_chars`` is encoded in pieces that
end at safe boundaries, so neither one long text nor many texts in a batch decide how much memory an encoding call takes. The
operator has no shuffle: each task counts the rows it reads.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; a null doc_id stays null; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import load
from .common import text_or_empty

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _groups(texts: list[str], sizes: list[int], most: int) -> Iterator[range]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield range(start, len(texts))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, group_bytes: int = 1 << 20, split_chars: int = 1 << 15) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row; ``tokenizer`` is the path of a byte-level BPE .json on every worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            tokens: list[int] = []
            for rows in _groups(texts, sizes, group_bytes):
                pieces = [bpe.pieces(texts[i], split_chars) for i in rows]
                lengths = iter(bpe.lengths([p for of in pieces for p in of]))
                tokens += [sum(next(lengths) for _ in of) for of in pieces]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(count, SCHEMA)
