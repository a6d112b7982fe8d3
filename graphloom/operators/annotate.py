"""Annotated pairs: agreement, splits, folds and active-learning batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import pseudo_random, uncertainty
from graphloom.sources.written import stash


def unanimous_labels(annotations: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """One row for each key whose answers all agree; a blank answer fails."""
    checked = F.when(F.coalesce(F.trim(answer), F.lit("")) == "", F.raise_error(F.lit("blank answer")).cast("string")).otherwise(F.col(answer))
    agreed = annotations.groupBy(*keys).agg(F.min(checked).alias("lo"), F.max(checked).alias("hi"))
    return agreed.where("lo = hi").select(*keys, F.col("lo").alias(answer))


def drop_skipped(annotations: DataFrame, answer: str = "answer") -> DataFrame:
    return annotations.where(F.col(answer) != "Skip")


def one_per_hypothesis(rows: DataFrame, hypothesis: str, keys: list[str], seed: str = "42") -> DataFrame:
    """One pseudo-randomly chosen row for each hypothesis."""
    rest = [c for c in rows.columns if c != hypothesis]
    chosen = rows.groupBy(hypothesis).agg(F.min_by(F.struct(*rest), F.struct(pseudo_random(*map(F.col, keys), seed=seed), *keys)).alias("r"))
    return chosen.select(hypothesis, "r.*").select(*rows.columns)


#: Bits of ``monotonically_increasing_id`` that hold a row's place in its partition.
_PLACE_BITS = 33


def ranged(df: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): the rows, written in a global order, and a row for each of their partitions.

    ``rows`` has the columns of ``df``, the partition ``__p`` and the place ``__at`` in it, from 0; equal keys may be
    in any order. ``parts`` has ``__p`` and the number of its rows ``__n``. One shuffle, no window.
    """
    keys = [F.expr(o) if isinstance(o, str) else o for o in order]
    names = [f"__o{i}" for i in range(len(keys))]
    placed = df.select("*", *(k.alias(n) for k, n in zip(keys, names))).repartitionByRange(*names).sortWithinPartitions(*names)
    number = placed.withColumn("__id", F.monotonically_increasing_id()).drop(*names)
    rows = stash(number.withColumn("__p", F.shiftright("__id", _PLACE_BITS)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))).drop("__id"), "ranged")
    return rows, rows.groupBy("__p").agg(F.count("*").alias("__n"))


def running_offsets(parts: DataFrame, column: str, name: str = "__before") -> DataFrame:
    """``parts`` (a row for each partition) with the sum of ``column`` over the partitions before it."""
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(name, F.coalesce(F.sum(column).over(before), F.lit(0)))


def numbered(df: DataFrame, order: list, name: str = "position", start: int = 0) -> DataFrame:
    """Rows numbered in a global order without a global window: range partitions, their counts, then local places."""
    rows, parts = ranged(df, order)
    offsets = running_offsets(parts, "__n").select("__p", "__before")
    return rows.join(F.broadcast(offsets), "__p").select(*df.columns, (F.col("__before") + F.col("__at") + start).cast("long").alias(name))  # a row for each partition


def split_by_premise(pairs: DataFrame, n_val: int, n_test: int, n_train: int, premise: str = "premise", hypothesis: str = "hypothesis", seed: str = "42") -> DataFrame:
    """``pairs`` with ``split``: val and test by whole premises; train without their hypotheses, val without test's.

    Training takes ``n_train`` rows in pseudo-random order; what is in no split is ``to_predict``.
    """
    order = numbered(pairs.select(premise).distinct(), [pseudo_random(F.col(premise), seed=seed), F.col(premise)], "premise_at")
    placed = pairs.join(order, premise).withColumn("part", F.when(F.col("premise_at") < n_val, "val").when(F.col("premise_at") < n_val + n_test, "test").otherwise("train"))
    flags = placed.groupBy(hypothesis).agg(F.max((F.col("part") == "test").cast("int")).alias("in_test"), F.max((F.col("part") == "val").cast("int")).alias("in_val"))
    joined = placed.join(flags, hypothesis)
    fits = F.when(F.col("part") == "test", F.lit(True)).when(F.col("part") == "val", F.col("in_test") == 0).otherwise((F.col("in_test") == 0) & (F.col("in_val") == 0))
    good = joined.withColumn("fits", fits)
    train = numbered(good.where("part = 'train' and fits"), [pseudo_random(F.col(premise), F.col(hypothesis), seed=seed), F.col(premise), F.col(hypothesis)], "train_at")
    rest = good.where("not (part = 'train' and fits)").withColumn("train_at", F.lit(None).cast("long"))
    split = F.when(~F.col("fits"), "to_predict").when(F.col("part") != "train", F.col("part")).when(F.col("train_at") < n_train, "train").otherwise("to_predict")
    return train.unionByName(rest).withColumn("split", split).select(*pairs.columns, "split")


def kfold_by_premise(pairs: DataFrame, k: int, premise: str = "premise", seed: str = "42") -> DataFrame:
    """``pairs`` with ``fold``: a premise is in one fold; folds differ by one premise at most."""
    order = numbered(pairs.select(premise).distinct(), [pseudo_random(F.col(premise), seed=seed), F.col(premise)], "at")
    return pairs.join(order.select(premise, F.pmod("at", F.lit(k)).cast("int").alias("fold")), premise).select(*pairs.columns, "fold")


def rows_to_predict(pairs: DataFrame, *splits: DataFrame) -> DataFrame:
    """Pairs that stand once among all pairs and splits together."""
    both = reduce(DataFrame.unionByName, (s.select(*pairs.columns) for s in splits), pairs)
    return both.groupBy(*pairs.columns).count().where("count = 1").drop("count")


def take_every_nth(rows: DataFrame, index: str, n: int, least: int = 0, most: int = 0) -> DataFrame:
    return rows.where(F.pmod(F.col(index), F.lit(n)).between(least, most))


def sample_fraction(rows: DataFrame, keys: list[str], fraction: float, seed: str = "42") -> DataFrame:
    """A share of the rows, chosen by a hash of their key: no shuffle, the same for any partitioning."""
    number = F.conv(F.substring(pseudo_random(*map(F.col, keys), seed=seed), 1, 12), 16, 10).cast("long")
    return rows.where(F.pmod(number, F.lit(1_000_000)) < int(fraction * 1_000_000))


def _bin(prob, bins: int):
    """Right-closed bins from 0 to 1, the first closed on both sides, from 1."""
    return F.greatest(F.ceil(F.round(prob * bins, 9)), F.lit(1)).cast("int")


def stratified_bins(pool: DataFrame, size: int, prob: str = "prob", most: int = 10) -> int:
    """The largest number of bins, ``most`` or fewer, whose last bin's quota fits the smallest bin."""
    tried = pool.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("b"), F.col(prob).alias("p"))
    counts = tried.groupBy("b", _bin(F.col("p"), F.col("b")).alias("bin")).count()
    smallest = {r["b"]: (r["bins"], r["least"]) for r in counts.groupBy("b").agg(F.count("*").alias("bins"), F.min("count").alias("least")).collect()}  # a row for each number of bins
    for b in range(most, 0, -1):
        bins, least = smallest.get(b, (0, 0))
        if size - size // b * (b - 1) <= (least if bins == b else 0):
            return b
    return 1


def al_batch(pool: DataFrame, size: int, strategy: str, keys: list[str], prob: str = "prob", seed: str = "42") -> DataFrame:
    """``pool`` with ``chosen``: the next training batch by ``random``, ``certain_pos``, ``uncertain`` or ``stratified``."""
    shuffle = pseudo_random(*map(F.col, keys), seed=seed)
    key_columns = [F.col(k) for k in keys]
    if strategy == "stratified":
        b = stratified_bins(pool, size, prob)
        quota = F.when(F.col("bin") < b, size // b).otherwise(size - size // b * (b - 1))
        binned = pool.withColumn("bin", _bin(F.col(prob), F.lit(b)))
        placed = numbered(binned, [F.col("bin"), shuffle, *key_columns], "at")
        first = placed.groupBy("bin").agg(F.min("at").alias("first"))  # a row for each of at most ten bins
        return placed.join(F.broadcast(first), "bin").withColumn("chosen", F.col("at") - F.col("first") < quota).select(*pool.columns, "chosen")
    first = {"random": shuffle, "certain_pos": -F.col(prob), "uncertain": -uncertainty(F.col(prob))}[strategy]
    return numbered(pool, [first, shuffle, *key_columns], "at").withColumn("chosen", F.col("at") < size).drop("at")


def stratified_sample(rows: DataFrame, n: int, bins: int, keys: list[str], prob: str = "prob", seed: str = "42") -> DataFrame:
    """``n`` rows of each left-closed probability bin (the last closed)."""
    binned = rows.withColumn("bin", F.least(F.floor(F.round(F.col(prob) * bins, 9)), F.lit(bins - 1)).cast("int"))
    placed = numbered(binned, [F.col("bin"), pseudo_random(*map(F.col, keys), seed=seed), *map(F.col, keys)], "at")
    first = placed.groupBy(F.col("bin").alias("own")).agg(F.min("at").alias("first"))  # a row for each of ``bins`` and for a null
    kept = placed.join(F.broadcast(first), F.col("bin").eqNullSafe(F.col("own"))).where(F.col("at") - F.col("first") < n)
    return kept.select(*rows.columns, "bin")


def ends_by(rows: DataFrame, order: list, n: int, first: bool = True) -> DataFrame:
    """The first or last ``n`` rows of an order."""
    keys = [F.expr(o) if isinstance(o, str) else o for o in order]
    return rows.orderBy(*(k.asc() if first else k.desc() for k in keys)).limit(n)
