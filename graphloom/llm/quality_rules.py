"""Quality rules: boosted trees over document statistics, in flat numpy arrays, with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, steps, table
from graphloom.llm.words import Words, covered, range_hashes, repeated

#: Most labelled rows that the trees are fitted on; they are those with the smallest hash of their id.
TRAIN_ROWS = 4_000
MIN_WORDS = 50
#: A document is kept by the trees if their probability of good quality is at least this.
KEEP_AT = 0.5

# The symbols that the base counts.
SYMBOLS = "#*$%&|<>"

#: The trees' features; -1: more of it can only lower the score, 0: free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "digits": 0, "punctuation": 0, "exclaims": -1, "pipes": -1, "beyond_ascii": 0, "line_words": 0, "distinct_words": 0, "dots": 0}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the trees' features (a row for each text). Null and empty texts have zeros."""
    w = Words(column)
    flag = lambda chars: w.per_text(np.isin(w.buf, np.frombuffer(chars.encode(), np.uint8)))
    chars = w.per_text(w.solid & ((w.buf & 0xC0) != 0x80))
    # Lines: from a text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(w.buf == 10)
    starts = np.unique(np.concatenate([w.off[:-1], feeds + 1]))
    starts = starts[starts < len(w.buf)]  # what starts at the end is an empty line
    line_doc = np.searchsorted(w.off[1:], starts, "right")
    ends = np.minimum(np.append(feeds, len(w.buf))[np.searchsorted(feeds, starts)], w.off[line_doc + 1])
    solid = np.concatenate([[0], np.cumsum(w.solid)])
    real = (ends > starts) & (solid[ends] > solid[starts])
    starts, ends, line_doc = starts[real], ends[real], line_doc[real]
    _, later = repeated(line_doc, range_hashes(w.rolling, w.buf, w.prefix, starts, ends))
    dup_lines = np.bincount(line_doc[later], minlength=w.n)
    lines = np.bincount(line_doc, minlength=w.n)
    at, grams = w.windows(3)
    again, _ = repeated(w.doc[at], grams)
    repeat_words = np.bincount(w.doc[covered(at[again], 3, len(w.hash))], minlength=w.n)
    _, seen = repeated(w.doc, w.hash)
    base = {"n_words": w.counts, "word_chars": chars, "n_symbols": flag(SYMBOLS), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}
    words, letters = np.maximum(w.counts, 1), np.maximum(chars, 1)
    features = [
        np.log1p(w.counts),
        chars / words,
        base["n_symbols"] / letters,
        dup_lines / np.maximum(lines, 1),
        repeat_words / words,
        flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / letters,
        flag("0123456789") / letters,
        flag(".,;:?") / letters,
        flag("!") / letters,
        flag("|") / words,
        w.per_text(w.buf >= 0xC0) / letters,
        w.counts / np.maximum(lines, 1),
        1 - np.bincount(w.doc[seen], minlength=w.n) / words,
        flag(".") / words,
    ]
    return base, np.stack(features, axis=1)


@dataclass
class Trees:
    """Every tree's nodes in one set of arrays; a leaf points to itself, so that all rows take the same steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality for each row of features."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32, least: float = 2.0) -> Trees:
    """Gradient boosting with logistic loss on binned features.

    A split on a constrained feature must order its two values as the constraint says, and the middle between them
    bounds all values below: so the sum of the trees is monotonic in that feature.
    """
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            nodes[k].append(v)
        return at

    rate0 = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(rate0 / (1 - rate0)))
    if not len(y):
        return Trees(*(np.array([v]) for v in (0, np.inf, 0, 0, 0.0)), np.array([0]), start, 1)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin, roots = np.full(len(y), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        value = lambda a, b: np.clip(-a / (b + ridge), low, high)
        gain_of = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = value(total_g, total_h)
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, c in enumerate(cuts if level < depth else []):
            if not len(c):
                continue
            gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
            vl, vr = value(gl, hl), value(total_g - gl, total_h - hl)
            gain = gain_of(gl, hl, vl) + gain_of(total_g - gl, total_h - hl, vr) - gain_of(total_g, total_h, own)
            gain[(hl < least / 4) | (total_h - hl < least / 4) | (signs[j] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k, vl[k], vr[k])
        at = leaf(rate * own)
        if best[1] >= 0:
            _, j, k, vl, vr = best
            under, middle = binned[rows, j] <= k, (vl + vr) / 2
            bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
            left, right = grow(rows[under], g, h, level + 1, *bound[0]), grow(rows[~under], g, h, level + 1, *bound[1])
            for name, v in (("feature", j), ("threshold", cuts[j][k]), ("left", left), ("right", right)):
                nodes[name][at] = v
        return at

    everything = np.arange(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(everything, p - y, p * (1 - p), 0, -4.0, 4.0))
        one = Trees(*(np.array(nodes[k]) for k in nodes), np.array(roots[-1:]), 0.0, depth)
        margin += np.log((q := np.clip(one.score(x), 1e-12, 1 - 1e-12)) / (1 - q))
    return Trees(*(np.array(nodes[k]) for k in nodes), np.array(roots), start, depth)


def _base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        _, x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label_col: str = "quality") -> Trees:
    """Trees fitted on at most ``rows`` labelled documents: a classifier's bounded sample, spread by a hash of the id.

    Ids may repeat, in documents and labels: the sample is cut to ``rows`` after the join as well. Null labels and ids are
    left out; without labelled documents the trees return the prior.
    """
    some = labels.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "label").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "label", F.xxhash64("text")).limit(rows)
    got = sample.select("label", "text").mapInArrow(_features, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    order = np.lexsort(x.T) if len(got) else np.zeros(0, int)  # the same trees for any order of arrival
    y = np.array([r["label"] for r in got], float)
    return fit(x[order], y[order], list(FEATURES.values()))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _judge(batches: Iterator[pa.RecordBatch], trees: Trees, keep_at: float, rest: bool) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        base, x = statistics(batch.column("text"))
        failed, score = _base_failed(base), trees.score(x)
        kept = ~failed & (score >= keep_at)
        if rest:
            yield batch.filter(pa.array(kept))
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(kept), pa.array(score)], names=SCHEMA_NAMES)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def quality_rules(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the base's verdict and the trees' for every whole text; a map over the rows, without a shuffle.

    A null or empty text has no words and so fails. Repeated rows give repeated results. An empty table gives no rows;
    without labelled rows the trees return the prior for all. Extra columns of ``docs`` are ignored.
    """
    arrow_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _judge(it, trees, keep_at, False), SCHEMA)


def keep_good(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` (with all their columns, ``text`` among them) that base and trees keep.

    Null and empty texts go, since they have no words; repeated rows stay or go together; an empty table stays empty.
    """
    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _judge(it, trees, keep_at, True), docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))
