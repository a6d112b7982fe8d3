"""Many phrases in many texts: what has a phrase's length in a text is hashed there, and what a filter lets through is joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.written import scope, stash

#: Bytes of texts that are hashed at once (a longer text alone).
STEP = 512 << 10
#: Bits of the filter for a phrase, and of the whole filter at most (8 MB); beyond that more is let through, and none less.
SPARSE, BITS = 64, 1 << 26
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(42).integers(1, 1 << 64, 256, dtype=np.uint64)

#: (row, start, end) of a text's runs of a size.
Runs = Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]]


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' borders in them."""
    whole = pa.array([], pa.large_binary()) if not len(column) else column.cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    off = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _hashes(raw: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that hashes ranges of ``raw``, each by two sums: equal bytes have equal hashes wherever they stand."""
    size = 1 << max(len(raw), 1).bit_length()
    forth, back = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * forth[: len(raw)])])

    def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * back[starts]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    return hashed


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a filter of ``bits`` (a power of two)."""
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _token_runs(raw: np.ndarray, off: np.ndarray) -> Runs:
    """All runs of as many tokens, which single spaces part."""
    gaps = np.flatnonzero(raw == 32)
    starts, ends = (np.sort(np.concatenate(x), kind="stable") for x in ([off[:-1], gaps + 1], [off[1:], gaps]))
    row = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(gaps, off)) + 1)

    def runs(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = max(len(row) - size + 1, 0)
        own = np.flatnonzero(row[:n] == row[len(row) - n :])
        return row[own], starts[own], ends[own + size - 1]

    return runs


def _byte_runs(raw: np.ndarray, off: np.ndarray) -> Runs:
    """All runs of as many bytes that begin with a character."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))

    def runs(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = max(len(raw) - size + 1, 0)
        own = np.flatnonzero((row[:n] == row[len(row) - n :]) & ((raw[:n] & 0xC0) != 0x80))
        return row[own], own, own + size

    return runs


def _bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = _buffer(batch.column("p"))
        at = np.concatenate(_places(_hashes(raw)(off[:-1], off[1:]), bits)) if batch.num_rows else np.zeros(0, np.uint64)
        word, bit = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit)], ["word", "bit"])


def _let_through(batches: Iterator[pa.RecordBatch], runs: Callable[[np.ndarray, np.ndarray], Runs], sizes: list[int], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, phrase) of what the filter ``words`` lets through, once for each text."""
    is_in = lambda at: (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    for whole in batches:
        _, borders = _buffer(whole.column("text"))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(borders, borders[at] + STEP, "right")) - 1)
            batch = whole.slice(at, to - at)
            at = to
            raw, off = _buffer(batch.column("text"))
            hashed, data, of_size = _hashes(raw), raw.tobytes(), runs(raw, off)
            known = batch.column("text").is_valid().to_numpy(zero_copy_only=False)  # a null text has no runs, an empty one an empty token
            found: dict[tuple[int, bytes], None] = {}
            for size in sizes:
                row, starts, ends = of_size(size)
                one, two = _places(hashed(starts, ends), len(words) * 64)
                left = np.flatnonzero(is_in(one))
                left = left[is_in(two[left])]
                left = left[known[row[left]]]
                found.update(((r, data[a:b]), None) for r, a, b in zip(row[left].tolist(), starts[left].tolist(), ends[left].tolist(), strict=True))
            keys = batch.column("key").take(pa.array([r for r, _ in found], pa.int64()))
            # Without a check of UTF-8: what is no phrase may begin or end within a character.
            yield pa.RecordBatch.from_arrays([keys, pa.array([p for _, p in found], pa.binary()).view(pa.string())], ["key", "phrase"])


def _held(texts: DataFrame, phrases: DataFrame, runs: Callable[[np.ndarray, np.ndarray], Runs], size: Column) -> DataFrame:
    """(key, phrase): texts (``key``, ``text``) with the phrases (``p``, which are distinct) that are among their ``runs`` of
    the phrases' sizes.

    Each text is read once and not shuffled. Runs meet a filter of the phrases' hashes, two bits each, of bounded size, which
    tasks make of their shares; what passes is few more than what stands there, and a join on the phrase itself decides.
    So the work is that of the texts times the different sizes, and no text meets a phrase that it only shares a part with.
    """
    spark = texts.sparkSession
    sizes = sorted(r[0] for r in phrases.select(size).distinct().collect())  # as many as the longest phrase's size at most
    bits = min(BITS, max(1 << 12, 1 << (SPARSE * phrases.count()).bit_length()))
    words = np.zeros(bits // 64, np.uint64)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    marks = phrases.select("p").mapInArrow(lambda it: _bits(it, bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words[marks.column("word").to_numpy()] = marks.column("bit").to_numpy().view(np.uint64)
    kind = texts.schema["key"].dataType.simpleString()
    passed = texts.mapInArrow(lambda it: _let_through(it, runs, sizes, words), f"key {kind}, phrase string")
    return passed.join(phrases.withColumnRenamed("p", "phrase"), "phrase", "left_semi").select("key", "phrase")


def phrases_in_tokens(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase): texts (``key``, ``tokens``) with the phrases (one column of space-joined tokens, of any number) that stand
    in them as consecutive tokens. Keys are unique; empty and null phrases stand nowhere; repeated ones count once."""
    with scope(texts.sparkSession) as keep:
        listed = keep(stash(phrases.select(F.col(phrases.columns[0]).alias("p")).distinct(), "phrases")).where("p <> ''")
        return _held(texts.select("key", F.array_join("tokens", " ").alias("text")), listed, _token_runs, F.size(F.split("p", " ")))


def phrases_in_text(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, phrase): texts (``key``, ``text``) with the phrases (one column) that they hold anywhere, whatever the case.

    Keys are unique; null texts and phrases match nothing, nor does the empty phrase; repeated phrases count once.
    """
    with scope(texts.sparkSession) as keep:
        listed = keep(stash(phrases.select(F.lower(phrases.columns[0]).alias("p")).distinct(), "phrases")).where("p <> ''")
        return _held(texts.select("key", F.lower("text").alias("text")), listed, _byte_runs, F.octet_length("p"))
