"""Where the texts repeat themselves: every window of a fixed length that also starts elsewhere.

A window's anchor is the smallest hash among its short parts. Equal windows have equal anchors at equal places, so a
window can only repeat if its anchor does. Consecutive windows with one anchor form a span, the text under it its
context. Of anchors that repeat, equal contexts repeat whole; only where contexts differ must windows be compared.
A context is known by 64 bits of its BLAKE2b digest beside its anchor; the quick rolling hashes only choose anchors, where
an accident costs time and no result. That leaves a few rows for each hundred units of text to shuffle, however often a passage is copied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, list_column, scope, stash, steps, text_buffer
from graphloom.llm.words import FIRST, U, Words, mix
from graphloom.operators.skew import join_by_size

#: From texts and the places of contexts that must be compared to (a, x, ranges).
Resolver = Callable[[DataFrame, DataFrame], DataFrame]
SCAN_SCHEMA = "doc_id long, rk long, a array<long>, x array<long>, s0 array<int>, n array<int>"


class Units:
    """A column's texts as sequences of bytes or words: their boundaries, prefix hashes, and the bytes of any range (words
    with one space between them)."""

    def __init__(self, column: pa.Array, words: bool):
        if words:
            w = self.words = Words(column)
            self.off, values = w.word_off.astype(np.int64), w.hash
            raw = np.full(int(w.solid.sum()) + len(w.starts), 32, np.uint8)
            raw[np.arange(int(w.solid.sum())) + np.repeat(np.arange(len(w.starts)), w.ends - w.starts)] = w.buf[w.solid]
            self.begin = np.concatenate([[0], np.cumsum(w.ends - w.starts + 1)])
            self.gap = 1
        else:
            raw, self.off = text_buffer(column)
            values, self.begin, self.gap = raw, None, 0
        self.raw = memoryview(raw.tobytes())
        self.first = FIRST.prefix(values)
        self.n = len(values)

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64 bits of BLAKE2b of each range of units."""
        if self.begin is not None:
            starts, ends = self.begin[starts], self.begin[ends] - self.gap
        raw = self.raw
        return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist())]), U)


def spans(u: Units, length: int, part: int) -> tuple[np.ndarray, ...]:
    """(text, first window's start, number of windows, anchor's place, anchor hash, context hash) of every span."""
    none = np.zeros(0, np.int64)
    per_text = np.maximum(np.diff(u.off) - length + 1, 0)
    total = int(per_text.sum())
    if not total:
        return none, none, none, none, none.astype(U), none.astype(U)
    at = np.arange(u.n - part + 1)
    grams = FIRST.ranges(u.first, at, at + part)
    place = U((1 << int(u.n).bit_length()) - 1)  # the low bits hold the place: of equal hashes the leftmost wins
    low = (grams & ~place) | at.astype(U)
    reach, width = 1, length - part + 1
    while reach < width:  # minimum over ``width`` places, doubling
        by = min(reach, width - reach)
        low = np.minimum(low[:-by], low[by:])
        reach += by
    text = np.repeat(np.arange(len(per_text)), per_text)
    starts = np.repeat(u.off[:-1] - np.cumsum(per_text) + per_text, per_text) + np.arange(total)
    anchor = (low[starts] & place).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(begin, total))
    s0, p = starts[begin], anchor[begin]
    context = mix(u.digests(s0, s0 + count + length - 1) ^ mix((p - s0).astype(U)))
    return text[begin], s0, count, p, grams[p], context


def _scan(batches: Iterator[pa.RecordBatch], words: bool, length: int, part: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        u = Units(batch.column("text"), words)
        text, s0, count, _, a, x = spans(u, length, part)
        per_text = np.bincount(text, minlength=batch.num_rows)
        own = (a.view(np.int64), pa.int64()), (x.view(np.int64), pa.int64()), ((s0 - u.off[text]).astype(np.int32), pa.int32()), (count.astype(np.int32), pa.int32())
        lists = [list_column(v, per_text, kind) for v, kind in own]
        out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rk"), *lists], names=["doc_id", "rk", "a", "x", "s0", "n"])
        yield out.filter(pa.array(per_text > 0))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rk, text, row): ``rk`` hashes the text, so that rows with one id and different texts stay apart; ``row``
    holds all columns as they came, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("row")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("rk"), text.alias("text"), row)


def scan(source: DataFrame, words: bool, length: int, part: int) -> DataFrame:
    """Each text's spans (texts without a window have no row), written."""
    arrow_batches(source.sparkSession)
    return stash(source.select("doc_id", "rk", "text").mapInArrow(lambda it: _scan(it, words, length, part), SCAN_SCHEMA), "spans")


def anchor_counts(scans: DataFrame) -> DataFrame:
    return scans.select(F.explode("a").alias("a")).groupBy("a").agg(F.count("*").alias("times"))


def repeated_spans(scans: DataFrame, repeating: DataFrame) -> DataFrame:
    """The spans whose anchor is in ``repeating`` (a, times), written."""
    one = scans.select("doc_id", "rk", F.explode(F.arrays_zip("a", "x", "s0", "n")).alias("s")).select("doc_id", "rk", "s.*")
    return stash(join_by_size(one, stash(repeating.select("a", "times"), "anchors"), ["a"], "times").drop("times"), "repeating")


def contexts(found: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """(all contexts with their number of places; one place of each context of ``every`` anchor, or else of those anchors
    that have several contexts, some of them with one place)."""
    by = stash(found.groupBy("a", "x").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "rk", "s0", "n")).alias("at")), "contexts")
    anchors = by.groupBy("a").agg(F.count("*").alias("variants"), F.count_if(F.expr("times = 1")).alias("single"))
    asked = stash((anchors if every else anchors.where("variants > 1 and single > 0")).select("a", "variants"), "asked")
    return by, join_by_size(by, asked, ["a"], "variants").select("a", "x", "times", "variants", "at.*")


def with_text(source: DataFrame, places: DataFrame, columns: str) -> DataFrame:
    """(text, places): the texts that hold one of ``places``, each with the structs of its own (their number is bounded
    by the text's length)."""
    asked = places.groupBy(F.col("doc_id").alias("id"), F.col("rk").alias("key")).agg(F.collect_list(F.struct(*columns.split())).alias("places"))
    return source.join(asked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("rk") == F.col("key"))).select("text", "places")


def marks(texts: DataFrame, scans: DataFrame, repeating: DataFrame, resolve: Resolver, every: bool = False) -> DataFrame:
    """(id, key, spans), written: of each text with repeated windows those as (s0, ranges of windows from there).

    Equal rows (one id, or none, and one text) share one set of spans, however many they are. What is written on the way
    is removed again.
    """
    with scope(texts.sparkSession) as keep:
        found = repeated_spans(scans, repeating)
        decided = join_by_size(found, verdicts(texts, found, resolve, every), ["a", "x"], "times")
        spans_ = F.collect_set(F.struct("s0", "ranges")).alias("spans")
        return keep(stash(decided.groupBy(F.col("doc_id").alias("id"), F.col("rk").alias("key")).agg(spans_), "marks"))


def marked(source: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, spans, row): every row of ``source`` with its marks."""
    return source.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("rk") == F.col("key")), "left").select("doc_id", "text", "spans", "row")


def cover(spans_: list | None, length: int, n: int) -> np.ndarray:
    """Which of a text's ``n`` units lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans_ or ():
        r = np.array(s["ranges"], np.int64) + s["s0"]
        np.add.at(edge, r[0::2], 1)
        np.add.at(edge, np.minimum(r[1::2] - 1 + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def whole_ranges() -> F.Column:
    return F.array(F.lit(0), F.col("at.n"))


def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[dict]]]]:
    """Text columns in small steps with each row's places as dictionaries."""
    for batch in steps(batches):
        yield batch.column("text"), batch.column("places").to_pylist()


def verdicts(texts: DataFrame, found: DataFrame, resolve: Resolver, every: bool) -> DataFrame:
    """(a, x, times, ranges), written: the contexts with repeated windows, from ``resolve``, which gets the texts and a
    place of each context to be compared. Unless it decides on ``every`` one, those with several places repeat whole."""
    by, compare = contexts(found, every)
    compare = stash(compare, "compare")
    out = resolve(texts, compare).select("a", "x", "ranges").join(compare.select("a", "x", "times"), ["a", "x"])
    if every:
        return stash(out.select("a", "x", "times", "ranges"), "verdicts")
    whole = by.where("times > 1").select("a", "x", "times", whole_ranges().alias("ranges"))
    return stash(whole.unionByName(out.where("times = 1").select("a", "x", "times", "ranges")), "verdicts")
