"""Packing: hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.llm.shared import arrow_batches, steps, table
from graphloom.llm.tokens import chunk_tokenizer, tokenizer_path

#: Context sizes, longest first. A sequence of a tier holds exactly its tokens, so only a partition's last is padded.
TIERS = (2048, 1024, 512, 256)
#: The id after each document.
END_ID = 1
#: Tokens of a step group: so many full windows of the longest tier.
STEP_WINDOWS = 8

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class TierPool:
    """Pieces that wait for a window, by length, so that the longest that fits a gap is found at once."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.pieces: list[tuple[int, int, int]] = []

    def add(self, doc: int, start: int, length: int) -> None:
        at = bisect.bisect_right(self.lengths, length)
        self.lengths.insert(at, length)
        self.pieces.insert(at, (doc, start, length))

    def take(self, most: int | None = None) -> tuple[int, int, int] | None:
        """The longest piece, of ``most`` tokens at most if given."""
        at = (len(self.lengths) if most is None else bisect.bisect_right(self.lengths, most)) - 1
        if at < 0:
            return None
        self.lengths.pop(at)
        return self.pieces.pop(at)


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces) for each sequence; a piece is (document's place in ``lengths``, start, length).

    Whole windows of the longest tier are cut off long documents. What remains is routed to the smallest tier that
    holds it and opens a window there; the gap is filled from this and the shorter tiers, longest fitting piece first,
    and closed exactly with the head of one more piece, whose rest is routed anew. When the shorter tiers are empty,
    the tiers below take the window's content; only what is less than the shortest tier is left for a padded one.
    """
    pools = [TierPool() for _ in tiers]

    def route(doc: int, start: int, length: int) -> None:
        k = max((k for k, size in enumerate(tiers) if length <= size), default=0)
        pools[k].add(doc, start, length)

    for doc, n in enumerate(lengths):
        whole = n // tiers[0] * tiers[0]
        for start in range(0, whole, tiers[0]):
            yield tiers[0], [(doc, start, tiers[0])]
        if n > whole:
            route(doc, whole, n - whole)
    for k, size in enumerate(tiers):
        while (piece := pools[k].take()) is not None:
            pieces, gap = [piece], size - piece[2]
            for pool in pools[k:]:
                while gap and (more := pool.take(gap)) is not None:
                    pieces.append(more)
                    gap -= more[2]
            if gap:  # every piece left is longer than the gap: the last tier's first, to keep long pieces whole
                for pool in reversed(pools[k:]):
                    if (more := pool.take()) is not None:
                        doc, start, length = more
                        pieces.append((doc, start, gap))
                        route(doc, start + gap, length - gap)
                        gap = 0
                        break
            if gap and k + 1 < len(tiers):  # nothing else is left: the shorter windows take it
                for doc, start, length in pieces:
                    for at in range(0, length, tiers[k + 1]):
                        route(doc, start + at, min(tiers[k + 1], length - at))
                continue
            yield size, pieces


def _pack(batches: Iterator[pa.RecordBatch], path: str, tiers: tuple[int, ...], step_windows: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    tokenizer, first = chunk_tokenizer(path), TaskContext.get().partitionId() << 36
    sequence, step, step_tokens = 0, 0, 0
    docs: list[tuple[int | None, np.ndarray]] = []
    held = 0

    def flush(last: bool) -> Iterator[pd.DataFrame]:
        nonlocal sequence, step, step_tokens, docs, held
        out: list[tuple] = []
        rest: list[tuple[int, int, int]] = []
        groups = sorted(plan([len(d[1]) for d in docs], tiers), key=lambda g: -g[0])
        for size, pieces in groups:
            if sum(p[2] for p in pieces) < size and not last:
                rest = pieces  # the one window that isn't full waits for the next documents
                continue
            # Longest windows first: a group closes when it holds its tokens, so groups differ by less than a window.
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids, skipped, total = docs[doc]
                out.append((doc_id, start + skipped, length, zlib.crc32(ids[start : start + length].tobytes()), total, first + sequence, offset, size, first + step))
                offset += length
            sequence, step_tokens = sequence + 1, step_tokens + offset
            if step_tokens >= step_windows * tiers[0]:
                step, step_tokens = step + 1, 0
        docs = [(docs[d][0], docs[d][1][s : s + n], docs[d][2] + s, docs[d][3]) for d, s, n in rest]
        held = sum(len(d[1]) for d in docs)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]).astype({"doc_id": "Int64"})

    for batch in steps(batches):
        found = tokenizer.ids([t or "" for t in batch.column("text").to_pylist()])
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found):
            ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
            docs.append((doc_id, ids, 0, len(ids)))
            held += len(ids)
        if held >= 1 << 19:
            yield from flush(False)
    yield from flush(True)


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, step_windows: int = STEP_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in token windows of the context sizes ``tiers``; a map over partitions, without a shuffle.

    Every window but the last of a partition is full. A null or empty text is the end id alone. Repeated rows are
    packed each for itself; a null id stays null. A long document is cut into whole windows. An empty table gives no
    rows. Extra columns of ``docs`` are ignored. ``sequence_id`` and ``step_group`` are unique across partitions and
    the same when a lost partition is computed again.
    """
    arrow_batches(docs.sparkSession)
    path = path or tokenizer_path()
    kind = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _pack(batches, path, tiers, step_windows):
            yield pa.RecordBatch.from_pandas(pdf, schema=kind, preserve_index=False)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
