"""Quality classifier: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.quality_rules import FEATURES, statistics
from graphloom.llm.shared import arrow_batches, list_column, steps, table
from graphloom.llm.words import Words, mix

#: Most documents that the scorer is fitted on, and most labelled ones that the word list is learnt from.
TRAIN_ROWS = 4_000
#: Most words of the learnt list of insults.
LEXICON = 200
#: Hashed weights: 2 to this power.
BITS = 18
KEEP_AT = 0.5

#: Labellers that overlap in what they see: a statistic, the side of its bound that is suspicious, and the bound.
RULES = [("symbols", ">", 0.08), ("symbols", ">", 0.02), ("upper", ">", 0.5), ("exclaims", ">", 0.05), ("pipes", ">", 0.05), ("repeat_words", ">", 0.5), ("distinct_words", "<", 0.3), ("dup_lines", ">", 0.3), ("line_words", "<", 2.5), ("log_words", "<", float(np.log1p(20)))]
LABELLERS = len(RULES) + 2  # one and two words of the learnt list


def votes(x: np.ndarray, insults: np.ndarray) -> np.ndarray:
    """Which labellers call each text bad."""
    names = list(FEATURES)
    own = [x[:, names.index(f)] > bound if side == ">" else x[:, names.index(f)] < bound for f, side, bound in RULES]
    return np.stack([*own, insults >= 1, insults >= 2], axis=1)


@dataclass
class Labellers:
    """P(bad) and for each labeller the chance of its vote on a bad and on a good text."""

    bad: float
    on_bad: np.ndarray
    on_good: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.log(self.bad / (1 - self.bad)) + v @ np.log(self.on_bad / self.on_good) + (1 - v) @ np.log((1 - self.on_bad) / (1 - self.on_good))
        return 1 / (1 + np.exp(-log))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, weight: float = 0.02) -> Labellers:
    """Accuracies of conditionally independent labellers from the counts of their vote patterns.

    The prior of ``weight`` of all texts says that a labeller sees a fifth of the bad texts and errs on one good text
    in a thousand; it keeps the two classes from changing names and rates off 0 and 1.
    """
    total = max(float(counts.sum()), 1.0)
    pseudo = max(weight * total, 5.0)
    found = Labellers(0.2, np.full(patterns.shape[1], 0.2), np.full(patterns.shape[1], 0.001))
    for _ in range(rounds):
        q = found.posterior(patterns) * counts
        g = counts - q
        new = Labellers(float(np.clip((q.sum() + 0.2 * pseudo) / (total + pseudo), 1e-3, 0.9)), (q @ patterns + 0.2 * pseudo) / (q.sum() + pseudo), np.clip((g @ patterns + 0.001 * pseudo) / (g.sum() + pseudo), 1e-6, 0.05))
        new.on_bad = np.clip(new.on_bad, 0.05, 0.95)
        done = np.abs(new.on_bad - found.on_bad).max() + np.abs(new.on_good - found.on_good).max() < 1e-9
        found = new
        if done:
            break
    return found


def _lexicon_hits(w: Words, lexicon: np.ndarray) -> np.ndarray:
    """Words of each text that are in the list (sorted hashes), punctuation at their ends aside."""
    if not len(lexicon) or not len(w.hash):
        return np.zeros(w.n, np.int64)
    letter = (w.buf >= 97) & (w.buf <= 122) | (w.buf >= 128)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(w.n, np.int64)
    starts = at[np.minimum(np.searchsorted(at, w.starts), len(at) - 1)]
    ends = at[np.maximum(np.searchsorted(at, w.ends) - 1, 0)] + 1
    ok = (starts >= w.starts) & (starts < w.ends) & (ends <= w.ends) & (ends > starts)
    hashes = w.rolling.ranges(w.prefix, starts[ok], ends[ok])
    found = lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes
    return np.bincount(w.doc[ok][found], minlength=w.n)


def _pattern_batches(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        _, x = statistics(batch.column("text"))
        v = votes(x, _lexicon_hits(Words(batch.column("text"), lower=True), lexicon))
        codes, n = np.unique(v @ (1 << np.arange(LABELLERS)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(n.astype(np.int64))], names=["pattern", "n"])


def hashed_features(column: pa.Array, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, number for each text, votes): each distinct lower-case word, and each labeller's vote, as one index."""
    w = Words(column, lower=True)
    _, x = statistics(column)
    v = votes(x, _lexicon_hits(w, lexicon))
    index = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    texts, own = np.nonzero(v)
    marks = (mix(own.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(np.concatenate([(w.doc.astype(np.int64) << BITS) | index, (texts.astype(np.int64) << BITS) | marks]))
    return both & ((1 << BITS) - 1), np.bincount(both >> BITS, minlength=w.n), v


def linear_scores(weights: np.ndarray, bias: float, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(counts)), counts)
    return 1 / (1 + np.exp(-(bias + np.bincount(text, weights[index], minlength=len(counts)))))


def fit_linear(index: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on the posterior probabilities, by gradient steps scaled for each weight (Adagrad)."""
    weights, bias = np.zeros(1 << BITS), 0.0
    squares, bias_square = np.full(1 << BITS, 1e-8), 1e-8
    text = np.repeat(np.arange(len(counts)), counts)
    for _ in range(rounds if len(counts) else 0):
        wrong = (linear_scores(weights, bias, index, counts) - good) / len(counts)
        slope = np.bincount(index, wrong[text], minlength=1 << BITS) + ridge * weights / len(counts)
        squares += slope**2
        bias_square += wrong.sum() ** 2
        weights -= rate * slope / np.sqrt(squares) * 0.1
        bias -= rate * wrong.sum() / np.sqrt(bias_square) * 0.1
    return weights.astype(np.float32), bias


def _sample_batches(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        index, counts, v = hashed_features(batch.column("text"), lexicon)
        yield pa.RecordBatch.from_arrays([list_column(index.astype(np.int32), counts, pa.int32()), pa.array((v @ (1 << np.arange(LABELLERS))).astype(np.int32))], names=["index", "pattern"])


@dataclass
class Scorer:
    lexicon: np.ndarray
    labellers: Labellers
    weights: np.ndarray
    bias: float


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = LEXICON) -> np.ndarray:
    """Hashes of words that stand in a share of the labelled toxic texts and in none of the other labelled ones."""
    some = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded by ``rows``
    word = F.explode(F.array_distinct(F.split(F.translate(F.lower("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z\x{80}-\x{10ffff}]+"))).alias("word")
    seen = sample.select("toxic", word).where("word <> ''").groupBy("word").agg(F.count_if(F.expr("toxic = 1")).alias("toxic"), F.count_if(F.expr("toxic <> 1")).alias("other"))
    n = some.agg(F.count_if(F.expr("toxic = 1"))).first()[0]
    found = [r["word"] for r in seen.where((F.col("other") == 0) & (F.col("toxic") >= max(3, n // 20))).orderBy(F.desc("toxic"), "word").limit(most).collect()]
    return np.sort(Words(pa.array([" ".join(found)])).hash)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    """Labellers estimated from all documents' vote patterns; the scorer fitted on a bounded sample of ``rows``."""
    lexicon = learn_lexicon(docs, labels, rows)
    got = docs.select("text").mapInArrow(lambda it: _pattern_batches(it, lexicon), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # a row a pattern: 4,096 at most
    bits = lambda codes: (np.array(codes, np.int64).reshape(-1, 1) >> np.arange(LABELLERS) & 1).astype(float)
    labellers = estimate(bits([r["pattern"] for r in got]), np.array([r["n"] for r in got], float))
    some = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(rows)
    table_ = sample.select("text").mapInArrow(lambda it: _sample_batches(it, lexicon), "index array<int>, pattern int").collect()
    good = 1 - labellers.posterior(bits([r["pattern"] for r in table_])) if table_ else np.zeros(0)
    index = np.concatenate([np.zeros(0, np.int64), *(np.array(r["index"], np.int64) for r in table_)])
    weights, bias = fit_linear(index, np.array([len(r["index"]) for r in table_], int), good)
    return Scorer(lexicon, labellers, weights, bias)


def _score_batches(batches: Iterator[pa.RecordBatch], scorer: Scorer, keep_at: float) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        index, counts, v = hashed_features(batch.column("text"), scorer.lexicon)
        score, good = linear_scores(scorer.weights, scorer.bias, index, counts), 1 - scorer.labellers.posterior(v.astype(float))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(good), pa.array(v.sum(axis=1).astype(np.int32)), pa.array(score >= keep_at)], names=["doc_id", "score", "weak_label", "n_votes", "kept"])


def classify(docs: DataFrame, scorer: Scorer, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, weak_label, n_votes, kept) for every whole text; a map over the rows, without a shuffle.

    A null or empty text gets the score of the labellers that call it short. Repeated rows give repeated results. An
    empty table gives no rows. Extra columns of ``docs`` are ignored.
    """
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda it: _score_batches(it, scorer, keep_at), "doc_id long, score double, weak_label double, n_votes int, kept boolean")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
