"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.repeats import anchor_counts, cover, keyed, marked, marks, place_rows, scan, with_text
from graphloom.llm.shared import give_back, scope, stash, steps, table, text_buffer

LENGTH = 400
#: Bytes of the anchors: the smallest hash of so many bytes in each window.
PART = 128
#: The same where passages of fifty words or more are to go: in the corpora at hand these have 227 bytes at the least, and 300
#: as a rule; fifty words of four letters have 250.
PASSAGE, PASSAGE_PART = 250, 96
#: Bytes of contexts that make one transform, about; and contexts of one anchor beyond which they make several.
BLOCK_BYTES = 512 << 10
GROUP = 512


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of small numbers in order of their first ``depth`` symbols at least, by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):  # seven symbols of nine bits
        key = (key << 9) | padded[i : i + n]
    reach = 7
    while True:
        order = np.argsort(key)
        new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if reach >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - reach, 0)] = rank[reach:] + 1
        key = (rank << 32) | after
        reach *= 2


def long_common_prefixes(order: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order: does it share ``length`` symbols or more with the one before?

    Breadth-first over the intervals of the transform: each step puts one symbol before every string of the last step.
    The first string to end an interval at a border has the border's common prefix less one symbol, so borders are
    settled in increasing order of the value, and strings that settle none are not followed. After ``length`` steps
    the borders that are open share ``length`` symbols or more; larger values are never derived.
    """
    n = len(order)
    transform = text[order - 1]  # the symbol before each suffix; the whole text's is its last
    step = np.empty(n, np.int64)
    step[np.argsort(transform, kind="stable")] = np.arange(n)
    run_start = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
    run_end = np.append(run_start[1:], n) - 1
    run = np.repeat(np.arange(len(run_start)), run_end - run_start + 1)
    symbol = transform[run_start].astype(np.int64)
    settled = np.zeros(n + 1, bool)
    settled[[0, n]] = True
    low, high = np.array([0]), np.array([n - 1])
    for level in range(length):
        if not len(low):
            break
        if level == 0:  # the empty string: an interval for each symbol
            sizes = np.bincount(text)
            high = np.cumsum(sizes)[sizes > 0] - 1
            low = high - sizes[sizes > 0] + 1
        else:
            runs = run[high] - run[low] + 1
            one = runs == 1
            more = np.flatnonzero(~one)
            new_low, new_high = step[low[one]], step[high[one]]
            if len(more):
                # An interval's runs of equal symbols: the first and last of a symbol give the new interval.
                r, m = runs[more], np.repeat(more, runs[more])
                each = run[low[m]] + np.arange(len(m)) - np.repeat(np.cumsum(r) - r, r)
                first, last = step[np.maximum(run_start[each], low[m])], step[np.minimum(run_end[each], high[m])]
                key = m * 512 + symbol[each]
                by = np.argsort(key, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
                new_low = np.concatenate([new_low, first[by][edge]])
                new_high = np.concatenate([new_high, last[by][np.append(edge[1:], len(by)) - 1]])
            low, high = new_low, new_high
        open_ = ~settled[high + 1]
        low, high = low[open_], high[open_]
        settled[high + 1] = True
    return ~settled[:n]


def repeats_in(contexts: list[bytes], length: int, times: list[int] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context: which of its windows stand at another place too, and which are the first of their kind.

    Equal contexts are one with the number of their ``times``: a suffix of it is so many places of its interval.
    """
    text = np.concatenate([np.append(np.frombuffer(c, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16) for c in contexts])
    order = suffix_order(text, length)
    same = long_common_prefixes(order, text, length)
    at = np.cumsum([0, *(len(c) + 1 for c in contexts)])
    places = np.repeat(times if times is not None else np.ones(len(contexts), int), np.diff(at))[order]
    twice = same | (places > 1)  # an interval of two places or more
    twice[:-1] |= same[1:]
    flag, first = np.zeros(len(text), bool), np.zeros(len(text), bool)
    flag[order], first[order] = twice, ~same
    n = [len(c) - length + 1 for c in contexts]
    return [flag[a : a + k] for a, k in zip(at, n)], [first[a : a + k] for a, k in zip(at, n)]


def as_ranges(flags: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def _context_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for column, places in place_rows(batches):
        buf, off = text_buffer(column)
        rows = [(p["a"], p["x"], p["times"], p["variants"], buf[off[i] + p["s0"] : off[i] + p["s0"] + p["n"] + length - 1].tobytes()) for i, ps in enumerate(places) for p in ps]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["a", "x", "times", "variants", "context"])


def _transform_block(group: pa.Table, length: int) -> pa.Table:
    """One block's verdicts. Contexts of an anchor that is in several blocks also give the hashes of their windows, one
    of a kind, so that those which are single here can be sought in the other blocks."""
    group = group.combine_chunks()
    a, x, times, variants, contexts = (group.column(c).to_pylist() for c in ("a", "x", "times", "variants", "context"))
    twice, first = repeats_in(contexts, length, times)
    ranges, hashes = [as_ranges(t) for t in twice], []
    for v, context, t, f in zip(variants, contexts, twice, first):
        if v <= GROUP:
            hashes.append([])
            continue
        j = np.flatnonzero(f | ~t)
        w = np.frombuffer(b"".join([blake2b(context[k : k + length], digest_size=8).digest() for k in j.tolist()]), np.int64)
        hashes.append([{"j": int(k), "w": int(h), "single": not t[k]} for k, h in zip(j, w)])
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("j", pa.int32()), ("w", pa.int64()), ("single", pa.bool_())])))
    out = pa.Table.from_arrays([pa.array(v, k) for v, k in zip((a, x, ranges, hashes), kinds)], names=["a", "x", "ranges", "hashes"])
    del twice, first, contexts, group
    give_back()
    return out


def _resolve(source: DataFrame, compare: DataFrame, length: int) -> DataFrame:
    """The repeated windows of all contexts, block by block with a transform each; an anchor's contexts share a block
    unless they are many, in which case what is single in one block is sought in the others."""
    texts = with_text(source, compare, "a x times variants s0 n")
    rows = texts.mapInArrow(lambda it: _context_bytes(it, length), "a long, x long, times long, variants long, context binary").dropDuplicates(["a", "x"])
    rows = stash(rows, "context_bytes")
    blocks = 1 + int((rows.agg(F.sum(F.length("context"))).first()[0] or 0) // BLOCK_BYTES)
    part = F.when(F.col("variants") > GROUP, F.pmod(F.xxhash64("x"), F.ceil(F.col("variants") / GROUP))).otherwise(F.lit(0))
    block = F.pmod(F.xxhash64("a", part), F.lit(blocks)).alias("block")
    done = stash(rows.select(block, "a", "x", "times", "variants", "context").groupBy("block").applyInArrow(lambda t: _transform_block(t, length), "a long, x long, ranges array<int>, hashes array<struct<j:int,w:long,single:boolean>>"), "blocks")
    one = done.select("a", "x", F.explode("hashes").alias("h")).select("a", "x", "h.*")
    across = one.groupBy("a", "w").count().where("count > 1").select("a", "w")
    late = one.where("single").join(across, ["a", "w"], "left_semi").groupBy("a", "x").agg(F.flatten(F.collect_list(F.array("j", F.col("j") + 1))).alias("ranges"))
    return done.select("a", "x", "ranges").where("size(ranges) > 0").unionByName(late)


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        buf, off = text_buffer(batch.column("text"))
        rows = []
        for i, marked in enumerate(batch.column("spans").to_pylist()):
            own = buf[off[i] : off[i + 1]]
            gone = cover(marked, length, len(own))
            kept = own[~gone].tobytes()
            rows.append((len(own), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, batch.column("row")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "row"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, row): each text without the bytes that a string of
    ``length`` bytes covers which also starts elsewhere; ``kept`` holds the rest, ``row`` the other columns.

    Null texts are empty; a text shorter than ``length`` keeps all. Rows may repeat: they are copies of each other. A
    cut can fall within a character, so ``kept`` is binary. An empty table gives no rows.
    """
    source = keyed(docs, id_col, text_col)
    with scope(docs.sparkSession) as keep:
        scans = scan(source, False, length, part)
        found = keep(marks(source, scans, anchor_counts(scans).where("times > 1"), lambda t, compare: _resolve(t, compare, length), every=True))
    cut = marked(source, found)
    row = cut.schema["row"].dataType.simpleString()
    return cut.mapInArrow(lambda it: _cut(it, length), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, row {row}")


def without_repeats(docs: DataFrame, length: int = PASSAGE, part: int = PASSAGE_PART) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut, and ``n_chars`` (if there) counted anew; a broken character's bytes go.

    Every row stays, with all its columns, also one whose text is null (it becomes empty) or cut whole. Repeated rows are
    copies of each other. An empty table stays empty.
    """
    cut = suffix_dedup(docs, length, part)
    kept = F.col("kept").cast("string")
    columns = {"text": F.when(F.is_valid_utf8(kept), kept).otherwise(F.translate(F.make_valid_utf8(kept), "\ufffd", ""))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*((columns[c] if c in columns else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept", "row")
