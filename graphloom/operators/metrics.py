"""Scores and labels: metrics, curves, calibration, tests and summaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.operators.annotate import numbered, ranged
from graphloom.operators.skew import join_by_size
from graphloom.sources.written import scope, stash, tidy

T = ["head", "relation", "tail"]


def confusion_metrics(rows: DataFrame, by: list[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts and rates of predictions by group; a rate without a denominator is null."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    c = rows.groupBy(*by).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    d = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    c = c.withColumns({"accuracy": d("tp + tn", "tn + fp + fn + tp"), "precision": d("tp", "tp + fp"), "recall": d("tp", "tp + fn"), "f1": d("2 * tp", "2 * tp + fp + fn"), "specificity": d("tn", "tn + fp"), "npv": d("tn", "tn + fn"), "pp": F.expr("tp + fp"), "pn": F.expr("tn + fn")})
    return c.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def cumulative_counts(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """(by, score, dtp, dfp, tp, fp): positives and negatives at and above each distinct score.

    Equal scores are one row before anything is ordered. A group's distinct scores are range-partitioned and summed
    with the partitions' offsets, so that no group needs one task.
    """
    y = F.col(label) == 1
    points = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(y).alias("dtp"), F.count_if(~y).alias("dfp"))
    order = [*by, F.col("score").desc()]
    placed = stash(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "points")
    sums = placed.groupBy("__p", *by).agg(F.sum("dtp").alias("a"), F.sum("dfp").alias("b"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__p", *by, F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    local = Window.partitionBy("__p", *by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("a", F.sum("dtp").over(local)).withColumn("b", F.sum("dfp").over(local))
    return running.join(offsets, ["__p", *by]).select(*by, "score", "dtp", "dfp", (F.col("a") + F.col("a0")).alias("tp"), (F.col("b") + F.col("b0")).alias("fp"))


def roc_auc_ap(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC (a tie counts half) and average precision of each group."""
    c = cumulative_counts(rows, by, label, score)
    t = c.groupBy(*by).agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    own = c.join(t, by) if by else c.crossJoin(t)
    area = F.sum(F.col("dfp") * (F.col("tp") - F.col("dtp") / 2))
    ap = F.sum(F.col("dtp") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return own.groupBy(*by).agg(F.try_divide(area, F.first(F.col("P") * F.col("N"))).alias("roc_auc"), F.try_divide(ap, F.first("P")).alias("average_precision"))


def curve_points(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Points of the ROC and precision-recall curves at each distinct score."""
    c = cumulative_counts(rows, by, label, score)
    t = c.groupBy(*by).agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    return c.join(t, by).select(*by, "score", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def best_f1_threshold(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """The score that maximises F1 for ``>=``; the lowest on ties."""
    c = cumulative_counts(rows, by, label, score)
    total = c.groupBy(*by).agg(F.max("tp").alias("P"))
    f1 = c.join(total, by).withColumn("f1", F.round(2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P")), 12))
    return f1.groupBy(*by).agg(F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def ensemble_mean_std(runs: DataFrame, keys: list[str], prob: str = "prob", population: bool = False) -> DataFrame:
    """Mean and deviation over the runs alone; one missing number makes the mean missing."""
    p = F.when(~F.isnan(prob), F.col(prob))
    whole = F.count(p) == F.count("*")
    return runs.groupBy(*keys).agg(F.when(whole, F.avg(p)).alias("prob_mean"), F.when(whole, (F.stddev_pop if population else F.stddev_samp)(p)).alias("prob_std"), F.count("*").alias("runs"))


def bin_of(prob: Column, bins: int, left_closed: bool = True) -> Column:
    scaled = F.round(prob * bins, 9)
    return (F.least(F.floor(scaled), F.lit(bins - 1)) if left_closed else F.greatest(F.ceil(scaled) - 1, F.lit(0))).cast("int")


def calibration_bins(rows: DataFrame, bins: int, label: str = "label", prob: str = "prob", left_closed: bool = True) -> DataFrame:
    """(bin, middle, n, positives, fraction) of every bin, empty ones too."""
    counts = rows.groupBy(bin_of(F.col(prob), bins, left_closed).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left")
    return out.select("bin", ((F.col("bin") + 0.5) / bins).alias("middle"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), F.try_divide(F.col("positives").cast("double"), "n").alias("fraction"))


def r2_score(rows: DataFrame, truth: str, guess: str, by: list[str] = ()) -> DataFrame:
    own = F.col(truth), F.col(guess)
    return rows.where(own[0].isNotNull() & own[1].isNotNull()).groupBy(*by).agg((1 - F.try_divide(F.sum((own[0] - own[1]) ** 2), F.var_pop(own[0]) * F.count("*"))).alias("r2"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the regularised incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")


def two_sample_t(rows: DataFrame, by: list[str], group: str, a: str, b: str, value: str, equal_var: bool = True) -> DataFrame:
    """(by, t, df, p_value) between two groups: Student's or Welch's test."""
    m = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.groupBy(*by).agg(*(m(g, f).alias(f"{n}{k}") for k, g in (("1", a), ("2", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    if equal_var:
        pooled = "((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)"
        s = s.withColumn("df", F.expr("cast(n1 + n2 - 2 as double)")).withColumn("t", F.expr(f"try_divide(m1 - m2, sqrt({pooled} * (1 / n1 + 1 / n2)))"))
    else:
        s = s.withColumn("df", F.expr("try_divide(power(v1 / n1 + v2 / n2, 2), power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1))")).withColumn("t", F.expr("try_divide(m1 - m2, sqrt(v1 / n1 + v2 / n2))"))
    return s.select(*by, "t", "df", F.pandas_udf(_t_p, DoubleType())("t", "df").alias("p_value"))


def fdr_adjust(rows: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family of tests, however large a family is.

    Range partitions hold the tests in order. What a partition must know of a family's other partitions is told by a row
    for each family in each partition that it shares: two for each partition at most, so that broadcasting it is bounded.
    """
    others = [c for c in rows.columns if c != p and c not in by]
    order = [*by, p, *others]
    placed = stash(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "families")
    families = Window.partitionBy(*by)
    parts = placed.groupBy(*by, "__p").agg(F.count("*").alias("__k")).withColumn("__parts", F.count("*").over(families)).where("__parts > 1")
    before = F.coalesce(F.sum("__k").over(families.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = stash(parts.select(*by, "__p", before.alias("__before"), F.sum("__k").over(families).alias("__all")), "split")
    here = Window.partitionBy("__p", *by)
    same = lambda left, right: reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in (*by, "__p")))
    own = placed.withColumn("__r", F.row_number().over(here.orderBy(p, *others))).withColumn("__n", F.count("*").over(here))
    known = own.join(F.broadcast(split), same(own, split), "left")
    rank, n = F.col("__r") + F.coalesce("__before", F.lit(0)), F.coalesce("__all", "__n")
    raw = stash(known.select(*(own[c] for c in (*rows.columns, "__p", "__r")), (F.col(p) * n / rank).alias("__q"), F.col("__all").isNotNull().alias("__split")), "raw")
    least = raw.where("__split").groupBy(*by, "__p").agg(F.min("__q").alias("__least"))
    after = least.select(*by, "__p", F.min("__least").over(families.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)).alias("__after"))
    back = raw.withColumn("__q", F.min("__q").over(here.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)))
    full = back.join(F.broadcast(after), same(back, after), "left")
    return full.select(*(back[c] for c in rows.columns), F.least("__q", "__after", F.lit(1.0)).alias("p_adjusted"))


def _hypergeom(N: pd.Series, K: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return pd.Series([math.exp(log(c, d) + log(a - c, b - d) - log(a, b)) if 0 <= d <= min(b, c) and b - d <= a - c else 0.0 for a, b, c, d in zip(N, K, n, k)])


def overlap_hypergeom(rows: DataFrame, bins: int, prob: str, seen: str) -> DataFrame:
    """(bin, n, k, p): of N rows K are seen; the chance of exactly the k seen among the n of a probability bin."""
    counts = rows.groupBy(bin_of(F.col(prob), bins).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(seen)).alias("k"))
    total = counts.agg(F.sum("n").alias("all_rows"), F.sum("k").alias("all_seen"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", "k", F.pandas_udf(_hypergeom, DoubleType())("all_rows", "all_seen", "n", "k").alias("p"))  # one row


def class_balance(rows: DataFrame, by: list[str], run: str, positive: Column) -> DataFrame:
    """Mean and deviation over runs of the share of positives."""
    share = rows.groupBy(*by, run).agg(F.avg(positive.cast("double")).alias("share"))
    return share.groupBy(*by).agg(F.avg("share").alias("mean"), F.stddev_samp("share").alias("std"), F.count("*").alias("runs"))


def discovery_curve(rows: DataFrame, positive: Column, base: str = "random") -> DataFrame:
    """(strategy, round, mean, difference, ratio): positives in the training sets, against the base strategy."""
    per = rows.groupBy("strategy", "run", "round").agg(F.count_if(positive).alias("n")).groupBy("strategy", "round").agg(F.avg("n").alias("mean"))
    own = per.where(F.col("strategy") == base).select("round", F.col("mean").alias("base"))
    return per.join(own, "round", "left").select("strategy", "round", "mean", (F.col("mean") - F.col("base")).alias("difference"), F.try_divide("mean", "base").alias("ratio"))


def grid_search_summary(rows: DataFrame, params: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*params).agg(*(F.avg(m).alias(m) for m in metrics))


def best_model(rows: DataFrame, dataset: str, model: str, metric: str) -> DataFrame:
    """The model with the best mean of each dataset; the first by name on ties."""
    # One pass: a mean that is computed twice may differ in its last digit, and be found nowhere.
    means = rows.groupBy(dataset, model).agg(F.avg(metric).alias("mean")).where("mean is not null")
    best = means.groupBy(dataset).agg(F.min_by(F.struct(model, "mean"), F.struct(-F.round("mean", 12), model)).alias("r"))
    return best.select(dataset, f"r.{model}", "r.mean")


def metric_report(rows: DataFrame, by: list[str], metrics: list[str], scale: float = 100.0) -> DataFrame:
    """"mean±deviation" of each metric, with the population's deviation."""
    text = lambda m: F.format_string("%.2f±%.2f", F.avg(m) * scale, F.stddev_pop(m) * scale)
    return rows.groupBy(*by).agg(*(text(m).alias(m) for m in metrics))


def filtered_rank(candidates: DataFrame, truth: DataFrame, known: DataFrame, query: list[str], score: str = "score") -> DataFrame:
    """(query, rank): 1 and the number of unknown candidates that score more than the query's true triple."""
    fair = candidates.join(known.select(*T), T, "left_anti")
    joined = fair.join(truth.select(*query, F.col(score).alias("own")), query)
    beaten = joined.groupBy(*query).agg(F.count_if(F.col(score) > F.col("own")).alias("n"))
    return truth.select(*query).join(beaten, query, "left").select(*query, (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


#: Test triples of one list, about, and lists of one cell.
RANK_GROUP = 2_000
#: Entities of one group for each test triple of a list, about.
RANK_WIDTH = 16
#: Triples that are scored at a time, about, and tests of a list beyond which its scores are sorted.
SCORED, SORTED = 1 << 19, 32


def _scores(scorer: Callable[[pd.DataFrame], np.ndarray], end: str, other: str, entities: pd.CategoricalDtype, lists: list[dict]) -> np.ndarray:
    """The scores of all entities of a group (columns) for each list's relation and other end (rows)."""
    n, k = len(entities.categories), len(lists)
    dealt = lambda c: pd.Categorical([r[c] for r in lists]).repeat(n)
    frame = pd.DataFrame({end: pd.Categorical.from_codes(np.tile(np.arange(n, dtype=np.int32), k), dtype=entities), "relation": dealt("relation"), other: dealt(other)})
    scores = np.array(scorer(frame[T]), float).reshape(k, n)
    scores[np.isnan(scores)] = np.inf  # as Spark orders them
    return scores


def _better(batches: Iterator[pa.RecordBatch], scorer: Callable[[pd.DataFrame], np.ndarray], end: str, other: str) -> Iterator[pa.RecordBatch]:
    """For each test of a list how many unknown entities of a group score more. Rows come sorted by cell: that with the
    group's entities first, then its lists."""
    entities = None
    for batch in batches:
        out, waiting = {c: [] for c in (*T, "better")}, []

        def settle() -> None:
            for r, own in zip(waiting, _scores(scorer, end, other, entities, waiting) if waiting else ()):
                tests = np.array([t["own"] for t in r["tests"]], float)
                tests[np.isnan(tests)] = np.inf
                at = entities.categories.get_indexer(pd.Index(r["known"] or [], dtype=object))
                taken = np.sort(own[at[at >= 0]])
                if len(tests) > SORTED:
                    more = len(own) - np.searchsorted(np.sort(own), tests, "right")
                else:
                    more = np.array([np.count_nonzero(own > t) for t in tests], np.int64)
                out[end] += [t[end] for t in r["tests"]]
                out["relation"] += [r["relation"]] * len(tests)
                out[other] += [r[other]] * len(tests)
                out["better"] += (more - (len(taken) - np.searchsorted(taken, tests, "right"))).tolist()
            waiting.clear()

        for r in batch.to_pylist():
            if r["entities"] is not None:
                settle()
                entities = pd.CategoricalDtype(pd.Index(r["entities"], dtype=object))
                continue
            waiting.append(r)
            if len(waiting) * len(entities.categories) >= SCORED:
                settle()
        settle()
        yield pa.RecordBatch.from_pydict({**{c: pa.array(out[c], pa.string()) for c in T}, "better": pa.array(out["better"], pa.int64())})


@tidy("ranks")
def entity_ranks(test: DataFrame, entities: DataFrame, known: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray], sides: tuple[str, ...] = ("head", "tail"), group: int = RANK_GROUP) -> DataFrame:
    """(head, relation, tail, side, rank): 1 and the number of entities that score more in the place of a test triple's head
    (or tail) and do not make a known triple there.

    ``entities`` has one column; ``scorer`` gives the scores of a frame of triples, whose columns may be categorical. All
    test triples of one relation and other end have the same rivals, so that these are scored once for a list of about
    ``group`` of them. A cell is a group of about ``group * RANK_WIDTH`` entities and about ``group`` lists, each of which
    travels to it once; its task holds the entities' names and goes through the lists, some ``SCORED`` triples at a time.
    So what is shuffled is the number of lists times that of groups, and the product is never rows of Spark's.
    """
    spark = test.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # a row holds a list's tests and known ends
    own = stash(score_pairs(test.select(*T).distinct(), scorer).withColumnRenamed("prob", "own"), "own")
    stored = stash(known.select(*T).unionByName(test.select(*T)).distinct(), "stored")
    pool = stash(entities.select(F.col(entities.columns[0]).alias("e")).where("e is not null").distinct(), "pool")
    n_groups = max(1, -(-pool.count() // (group * RANK_WIDTH)))
    grouped = stash(pool.groupBy(F.pmod(F.xxhash64("e"), F.lit(n_groups)).alias("g")).agg(F.collect_list("e").alias("entities")), "grouped")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    out = None
    for end in sides:
        other = "tail" if end == "head" else "head"
        key = ["relation", other]
        sizes = stash(own.groupBy(*key).agg(F.count("*").alias("size")), "sizes")
        dealt = join_by_size(own, sizes, key, "size").withColumn("list", F.pmod(F.xxhash64(end), F.ceil(F.col("size") / group)))
        tests = stash(dealt.groupBy(*key, "list").agg(F.collect_list(F.struct(end, "own")).alias("tests")), "tests")
        met = stored.join(sizes.select(*key), key, "left_semi")
        taken = met.groupBy(*key, F.pmod(F.xxhash64(end), F.lit(n_groups)).alias("g")).agg(F.collect_list(end).alias("known"))
        n_cells = max(1, -(-tests.count() // group))
        asking = tests.select("*", F.pmod(F.xxhash64(*key, "list"), F.lit(n_cells)).alias("c"), every(n_groups).alias("g")).join(taken, [*key, "g"], "left")
        lists = asking.select("c", "g", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("entities"), "relation", other, "tests", "known")
        cells = grouped.select(every(n_cells).alias("c"), "g", F.lit(0).alias("kind"), "entities").unionByName(lists, allowMissingColumns=True)
        placed = cells.repartition(tasks, "c", "g").sortWithinPartitions("c", "g", "kind").select("entities", "relation", other, "tests", "known")
        better = placed.mapInArrow(lambda it, end=end, other=other: _better(it, scorer, end, other), "head string, relation string, tail string, better long")
        ranked = better.groupBy(*T).agg((F.sum("better") + 1).alias("rank")).select(*T, F.lit(end).alias("side"), "rank")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def rank_metrics(ranks: DataFrame, by: list[str], ks: list[int] = (1, 3, 5, 10)) -> DataFrame:
    """Mean rank, mean reciprocal rank and hits at ``ks`` of each group."""
    hits = (F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in ks)
    return ranks.groupBy(*by).agg(F.avg("rank").alias("mean_rank"), F.avg(1 / F.col("rank")).alias("mrr"), *hits)


def rank_report(ranks: DataFrame, side: str = "side", run: str = "run", ks: list[int] = (1, 3, 5, 10)) -> DataFrame:
    """(side, metric…, metric_std…): rank metrics of each side and of both together, averaged over replicates, with the
    population's deviation."""
    sides = ranks.withColumn(side, F.explode(F.array(side, F.lit("both"))))
    each = rank_metrics(sides, [side, run], ks)
    names = [c for c in each.columns if c not in (side, run)]
    return each.groupBy(side).agg(*(F.avg(c).alias(c) for c in names), *(F.stddev_pop(c).alias(f"{c}_std") for c in names))


def model_rank(means: DataFrame, by: list[str], metric: str) -> DataFrame:
    """``means`` with ``rank`` by falling metric; tied models share the middle of their places."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc())
    tied = F.count("*").over(Window.partitionBy(*by, metric))
    return means.withColumn("rank", F.rank().over(w) + (tied - 1) / 2)


def label_scores(scores: DataFrame, gold: DataFrame, unseen: str = "null", label: str = "label") -> DataFrame:
    """Gold triples with their score: null and false if there is none, or the lowest of all (``unseen='min'``)."""
    out = gold.join(scores.select(*T, "prob"), T, "left")
    if unseen == "min":
        low = scores.agg(F.min("prob").alias("low"))
        out = out.crossJoin(F.broadcast(low)).withColumn("prob", F.coalesce("prob", "low")).drop("low")  # one row
    return out.select(*T, label, "prob")


def holdout_overlap(test: DataFrame, train: DataFrame, key: str, prob: str = "prob") -> DataFrame:
    """(seen, n, mean_prob) of test rows whose hypothesis is or is not in train."""
    seen = train.select(key).distinct().withColumn("seen", F.lit(True))
    return test.join(seen, key, "left").groupBy(F.coalesce("seen", F.lit(False)).alias("seen")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"))


def mode_answer(rows: DataFrame, keys: list[str], answer: Column) -> DataFrame:
    """The most frequent of several answers (0 on ties)."""
    return rows.groupBy(*keys).agg((F.sum(answer) * 2 > F.count("*")).cast("int").alias("answer"))


def minmax_scale(fit: DataFrame, apply: DataFrame, score: str = "score") -> DataFrame:
    """``apply`` with ``scaled``: 0 and 1 at the least and most of ``fit``."""
    bounds = fit.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return apply.crossJoin(F.broadcast(bounds)).withColumn("scaled", F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo"))).drop("lo", "hi")  # one row


#: Blocks that one task pools at a time.
POOLED = 1 << 18


def pool_adjacent(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring blocks (ranges of scores with their sums of labels and weights) pooled until their means do not fall."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), y.tolist(), w.tolist()):
        now = list(block)
        while out and out[-1][2] * now[3] >= now[2] * out[-1][3]:
            last = out.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        out.append(now)
    return tuple(np.array(c, float) for c in zip(*out)) if out else (lo, hi, y, w)


_BLOCK = "lo double, hi double, y double, w double"


def isotonic_blocks(fit: DataFrame, label: str = "label", score: str = "score", most: int = POOLED) -> DataFrame:
    """(lo, hi, y, w): ranges of scores with their sums of labels and weights, whose means do not fall; written.

    Equal scores are one point first. Consecutive points, ``most`` to a task, are pooled; then the blocks that are left
    are dealt anew, ``most`` to a task, from half a task on in every other round, until none of them is at or over its
    right neighbour. Pooling may be done in any order, so that the result is that of one stack over all points. Where
    many become few, so do the tasks; where they do not, there is nothing more to pool, or at the tasks' borders alone.
    """
    points = fit.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(F.max(F.col(score).cast("double")).alias("hi"), F.sum(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    blocks, half = points, 0
    while True:
        with scope(fit.sparkSession) as keep:
            placed = numbered(blocks, [F.col("lo")], "at")
            dealt = placed.withColumn("task", F.floor((F.col("at") + half) / most)).repartition("task").drop("at")
            pooled = keep(stash(dealt.groupBy("task").applyInArrow(_pool_task, f"task long, {_BLOCK}"), "blocks"))
        ends = pooled.groupBy("task").agg(F.min_by(F.struct("y", "w"), "lo").alias("first"), F.max_by(F.struct("y", "w"), "lo").alias("last"))
        # A row for each task: a bounded window.
        before = ends.select("first", F.lag("last").over(Window.orderBy("task")).alias("before")).where("before is not null and before.y * first.w >= first.y * before.w")
        blocks, half = pooled.select("lo", "hi", "y", "w"), most // 2 - half
        if before.isEmpty():
            return blocks


def _pool_task(table: pa.Table) -> pa.Table:
    task = table.column("task")[0].as_py()
    sorted_ = table.sort_by("lo")
    pooled = pool_adjacent(*(sorted_.column(c).to_numpy() for c in ("lo", "hi", "y", "w")))
    return pa.table({"task": pa.array(np.full(len(pooled[0]), task, np.int64)), **dict(zip(("lo", "hi", "y", "w"), map(pa.array, pooled)))})


@tidy("calibrated")
def isotonic_calibrate(fit: DataFrame, apply: DataFrame, label: str = "label", score: str = "score", most: int = POOLED) -> DataFrame:
    """``apply`` with ``prob``: isotonic regression of label on score, clipped to the fitted range, in a line between ranges.

    Blocks and rows are ordered together, by range, and each row takes the block before it and the next one, of its own
    partition or, by way of a row for each partition, of another. A null score has a null probability.
    """
    blocks = isotonic_blocks(fit, label, score, most)
    block = F.struct("lo", "hi", (F.col("y") / F.col("w")).alias("v")).alias("block")
    row = F.struct(*apply.columns).alias("row")
    events = blocks.select(F.col("lo").alias("x"), F.lit(0).alias("kind"), block).unionByName(apply.select(F.col(score).cast("double").alias("x"), F.lit(1).alias("kind"), row), allowMissingColumns=True)
    placed, _ = ranged(events.where("x is not null"), [F.col("x"), F.col("kind")])
    held = placed.where("kind = 0").groupBy("__p").agg(F.max_by("block", "__at").alias("last"), F.min_by("block", "__at").alias("first"))
    parts = placed.select("__p").distinct().join(held, "__p", "left")
    # A row for each partition: bounded windows, and broadcast.
    across = parts.select("__p", F.last("last", True).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("left"), F.first("first", True).over(Window.orderBy("__p").rowsBetween(1, Window.unboundedFollowing)).alias("right"))
    local = Window.partitionBy("__p").orderBy("__at")
    # Both frames grow: one that shrinks from the front would be read anew for each row.
    back = Window.partitionBy("__p").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.withColumn("below", F.last("block", True).over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.last("block", True).over(back))
    both = near.where("kind = 1").join(F.broadcast(across), "__p").select("row", "x", F.coalesce("below", "left").alias("a"), F.coalesce("above", "right").alias("b"))
    line = F.expr("a.v + (b.v - a.v) * (x - a.hi) / (b.lo - a.hi)")
    prob = F.when(F.col("a").isNull(), F.col("b.v")).when((F.col("x") <= F.col("a.hi")) | F.col("b").isNull(), F.col("a.v")).otherwise(line)
    found = both.select(*(F.col("row").getField(c).alias(c) for c in apply.columns), prob.alias("prob"))
    return found.unionByName(apply.where(F.col(score).isNull()).withColumn("prob", F.lit(None).cast("double")))


def platt_fit(fit: DataFrame, label: str = "label", score: str = "score", steps: int = 30, tol: float = 1e-10) -> tuple[float, float]:
    """(slope, offset) of the sigmoid of the score with the largest likelihood of smoothed labels, by Newton's method.

    A positive label counts as (n + 1) / (n + 2) of the n positive ones, a negative one as 1 / (n + 2) of its kind, so that
    labels which a score parts entirely have a sigmoid, too. Equal scores are one point first; a step is one sum over the
    points, halved where it would not gain.
    """
    positive, x = F.col(label).cast("double") > 0, F.col(score).cast("double")
    points = fit.where(positive.isNotNull() & x.isNotNull()).groupBy(x.alias("x")).agg(F.count_if(positive).cast("double").alias("p"), F.count("*").cast("double").alias("w"))
    with scope(fit.sparkSession):
        points = stash(points, "points")
        sizes = points.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
        yes, no = (sizes["p"] + 1) / (sizes["p"] + 2), 1 / (sizes["w"] - sizes["p"] + 2)
        points = points.select("x", (F.col("p") * yes + (F.col("w") - F.col("p")) * no).alias("y"), "w")

        def at(a: float, b: float) -> dict[str, float]:
            z = F.lit(a) * F.col("x") + F.lit(b)
            p, soft = 1 / (1 + F.exp(-z)), F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))
            g, h = F.col("y") - F.col("w") * p, F.col("w") * p * (1 - p)
            sums = {"gain": F.col("y") * z - F.col("w") * soft, "ga": g * F.col("x"), "gb": g, "haa": h * F.col("x") * F.col("x"), "hab": h * F.col("x"), "hbb": h}
            return points.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in sums.items())).first().asDict()

        a = b = 0.0
        now = at(a, b)
        for _ in range(steps):
            det = now["haa"] * now["hbb"] - now["hab"] ** 2
            if det <= 1e-12 * max(now["haa"] * now["hbb"], 1e-300):  # one score only, or all is certain
                if now["hbb"] <= 0:
                    break
                da, db = 0.0, now["gb"] / now["hbb"]
            else:
                da, db = (now["hbb"] * now["ga"] - now["hab"] * now["gb"]) / det, (now["haa"] * now["gb"] - now["hab"] * now["ga"]) / det
            part = 1.0
            while part > 1e-6 and (new := at(a + part * da, b + part * db))["gain"] < now["gain"]:
                part /= 2
            if part <= 1e-6 or abs(new["gain"] - now["gain"]) <= tol:
                if part > 1e-6:
                    a, b = a + part * da, b + part * db
                break
            a, b, now = a + part * da, b + part * db, new
        return a, b


def platt_calibrate(fit: DataFrame, apply: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """``apply`` with ``prob``: a sigmoid of the score."""
    a, b = platt_fit(fit, label, score)
    return apply.withColumn("prob", 1 / (1 + F.exp(-(F.lit(a) * F.col(score).cast("double") + F.lit(b)))))


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``pairs`` with ``prob`` from a model of the caller's, called on batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(prob=np.asarray(scorer(pdf), float))

    schema = StructType([*pairs.schema, StructField("prob", DoubleType())])
    return pairs.mapInPandas(run, schema)


def production_hypotheses(runs: DataFrame) -> DataFrame:
    """(triple, prob_mean, prob_std, every): over replicates, with the population's deviation; best first."""
    return runs.groupBy(*T).agg(F.avg("prob").alias("prob_mean"), F.stddev_pop("prob").alias("prob_std"), F.bool_and("pred").alias("every")).orderBy(F.desc("prob_mean"), *T)
