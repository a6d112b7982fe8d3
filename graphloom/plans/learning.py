"""Queries of link-prediction data sets, scores, metrics and tests."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from graphloom.operators import kgc, metrics, stores
from graphloom.plans.demo import view
from graphloom.sources.written import shared_folder

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def r(c, digits=6):
    return F.round(c, digits).alias(c)


_ORDER = "row_number() OVER (ORDER BY md5('42|' || head || '|' || relation || '|' || tail), head, relation, tail) - 1"
SPLIT = f"SELECT head, relation, tail, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_ORDER} AS place, COUNT(*) OVER () AS n FROM kg WHERE relation = 'r0')"


def split(spark, sf):
    return kgc.split_triples(view(spark, sf, "kg").where("relation = 'r0'"))


@query("split_triples", SPLIT)
def _(spark, sf):
    return split(spark, sf)


# The graph in two states: what half of the heads have, then all. Parts are the heads, so that some are in no hold-out.
_TURNED = "SELECT tail AS head, relation, head AS tail FROM kg WHERE relation = '{relation}'"


def _dealt_sql(condition: str) -> str:
    rows = f"({_TURNED.format(relation='r0')}) AS t"
    return f"SELECT head, relation, tail, CASE WHEN place < floor(n * 0.7) THEN 'train' WHEN place < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_ORDER} AS place, COUNT(*) OVER () AS n FROM {rows} WHERE {condition})"


_EVEN = "CAST(substr(tail, 2) AS BIGINT) % 2 = 0"
_DEALT = f"{_dealt_sql(_EVEN)} UNION ALL {_dealt_sql(f'NOT ({_EVEN})')}"


def _ledger(spark, sf):
    turned = view(spark, sf, "kg").where("relation = 'r0'").select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"))
    ledger = stores.SplitLedger(spark, f"{shared_folder(spark)}/graphloom/splits-{uuid.uuid4().hex}")
    ledger.deal("first", turned.where("cast(substring(tail, 2) as bigint) % 2 = 0"))
    ledger.deal("grown", turned)
    return ledger


@query("split_ledger", _DEALT)
def _(spark, sf):
    return _ledger(spark, sf).splits()


@query("training_set", f"SELECT head, relation, tail FROM ({_DEALT}) WHERE split = 'train' UNION SELECT * FROM ({_TURNED.format(relation='r1')}) WHERE head NOT IN (SELECT head FROM ({_DEALT}) WHERE split <> 'train') UNION SELECT * FROM kg WHERE relation = 'r1'")
def _(spark, sf):
    """Every part is a taxon of its own; the other relation is there both ways, part-level and not."""
    other = view(spark, sf, "kg").where("relation = 'r1'")
    taxa = view(spark, sf, "ent").where("type = 'chemical'").select("entity_id", F.concat(F.lit("x"), "entity_id").alias("tax_id"))
    return _ledger(spark, sf).training_set(other.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail")), other, taxa)


@query("train_minus_holdout", f"SELECT head, relation, tail FROM ({SPLIT}) WHERE split = 'train'")
def _(spark, sf):
    s = split(spark, sf)
    kgc.assert_disjoint(s.where("split = 'train'"), s.where("split = 'test'"))
    return kgc.train_minus_holdout(s, s.where("split = 'val'"), s.where("split = 'test'"))


@query("exclude_taxa", f"SELECT k.tail AS head, k.relation, k.head AS tail FROM kg AS k LEFT JOIN (SELECT DISTINCT tail FROM ({SPLIT}) WHERE split = 'test') AS g ON k.tail = g.tail WHERE k.relation = 'r1' AND g.tail IS NULL")
def _(spark, sf):
    """The graph seen from its parts, each of which is a taxon of its own (every supplier has a held-out triple)."""
    turned = lambda df: df.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"))
    taxa = view(spark, sf, "ent").where("type = 'chemical'").select("entity_id", F.concat(F.lit("x"), "entity_id").alias("tax_id"))
    return kgc.exclude_taxa(turned(view(spark, sf, "kg").where("relation = 'r1'")), turned(split(spark, sf).where("split = 'test'")), taxa)


@query("prob_cutoff", "SELECT c.cutoff, COUNT(*) AS n FROM ev CROSS JOIN (VALUES (0.6e0), (0.7e0), (0.8e0), (0.9e0)) AS c(cutoff) WHERE coalesce(prob_mean, 1.0) >= c.cutoff GROUP BY c.cutoff")
def _(spark, sf):
    return kgc.prob_cutoffs(view(spark, sf, "ev"), [0.6, 0.7, 0.8, 0.9]).groupBy("cutoff").agg(F.count("*").alias("n"))


@query("train_above_cutoff", "SELECT k.* FROM kg AS k WHERE EXISTS (SELECT 1 FROM ev AS e WHERE e.head = k.head AND e.relation = k.relation AND e.tail = k.tail AND coalesce(e.prob_mean, 1.0) >= 0.8)")
def _(spark, sf):
    return kgc.train_above_cutoff(view(spark, sf, "kg"), view(spark, sf, "ev"), 0.8)


@query("holdout_by_source", "SELECT k.* FROM kg AS k WHERE NOT EXISTS (SELECT 1 FROM ev AS e WHERE e.head = k.head AND e.relation = k.relation AND e.tail = k.tail AND e.source = 'external:db')")
def _(spark, sf):
    return kgc.holdout_by_source(view(spark, sf, "kg"), view(spark, sf, "ev"), ["external:db"])[0]


@query("holdout_by_source_test", "SELECT DISTINCT head, relation, tail FROM ev WHERE source = 'external:db'")
def _(spark, sf):
    return kgc.holdout_by_source(view(spark, sf, "kg"), view(spark, sf, "ev"), ["external:db"])[1]


@query("candidate_hypotheses", "SELECT h.head, 'r0' AS relation, t.tail FROM (SELECT DISTINCT head FROM kg WHERE relation = 'r0') AS h CROSS JOIN (SELECT DISTINCT tail FROM kg WHERE relation = 'r0') AS t LEFT JOIN (SELECT * FROM kg WHERE relation = 'r0') AS k ON h.head = k.head AND t.tail = k.tail WHERE k.head IS NULL")
def _(spark, sf):
    return kgc.candidate_hypotheses(view(spark, sf, "kg"), "r0")


# Customers and the parts they buy: sparse enough that every triple has an unknown corruption, as the operator demands (a
# supplier of the smallest tables is known with nearly all parts).
def _drawn(end: str, pool: str, draws: int, rows: str = "buys") -> str:
    """Draws by their place among the free entities: as many known ones stand before it as have no more free ones before them."""
    other = "tail" if end == "head" else "head"
    new = {"head": "p.new AS head, d.relation, d.tail", "tail": "d.head, d.relation, p.new AS tail"}[end]
    number = f"CAST('0x' || substr(md5('42{end}|' || b.head || '|' || b.relation || '|' || b.tail || '|' || k.draw), 1, 15) AS BIGINT)"
    placed = f"(SELECT new, row_number() OVER (ORDER BY new) - 1 AS pos FROM ({pool}))"
    gaps = f"(SELECT b.relation, b.{other}, p.pos - row_number() OVER (PARTITION BY b.relation, b.{other} ORDER BY p.pos) + 1 AS gap FROM buys AS b JOIN {placed} AS p ON b.{end} = p.new)"
    sizes = f"(SELECT relation, {other}, COUNT(*) AS taken FROM buys GROUP BY relation, {other})"
    asked = f"(SELECT b.head, b.relation, b.tail, k.draw, {number} % ((SELECT COUNT(*) FROM ({pool})) - s.taken) AS r FROM {rows} AS b JOIN {sizes} AS s ON s.relation = b.relation AND s.{other} = b.{other} CROSS JOIN (SELECT unnest(range({draws})) AS draw) AS k)"
    skipped = f"(SELECT a.head, a.relation, a.tail, a.draw, a.r + COUNT(*) FILTER (g.gap <= a.r) AS pos FROM {asked} AS a JOIN {gaps} AS g ON g.relation = a.relation AND g.{other} = a.{other} GROUP BY a.head, a.relation, a.tail, a.draw, a.r)"
    return f"SELECT {new}, 0 AS label FROM {skipped} AS d JOIN {placed} AS p ON p.pos = d.pos"


@query("negative_samples", f"SELECT *, 1 AS label FROM buys UNION ALL {_drawn('head', 'SELECT DISTINCT head AS new FROM buys', 1)} UNION ALL {_drawn('tail', 'SELECT DISTINCT tail AS new FROM buys', 1)}")
def _(spark, sf):
    buys = view(spark, sf, "buys")
    return kgc.negative_samples(buys, buys)


@query("negative_sample_counts", "SELECT label, COUNT(*) AS n, 0 AS known FROM (SELECT unnest([1, 0, 0]) AS label FROM buys) GROUP BY label")
def _(spark, sf):
    buys = view(spark, sf, "buys")
    out = kgc.negative_samples(buys, buys)
    marked = out.join(buys.withColumn("k", F.lit(1)), ["head", "relation", "tail"], "left")
    return marked.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when((F.col("label") == 0) & F.col("k").isNotNull(), 1).otherwise(0)).alias("known"))


# Five corruptions of the end that a coin chooses, by any customer or part.
_ANY = "SELECT head AS new FROM buys UNION SELECT tail FROM buys"
_COIN = "substr(md5('42coin|' || head || '|' || relation || '|' || tail), 1, 1) < '8'"


@query("coin_negatives", f"SELECT *, 1 AS label FROM buys UNION ALL {_drawn('head', _ANY, 5, f'(SELECT * FROM buys WHERE {_COIN})')} UNION ALL {_drawn('tail', _ANY, 5, f'(SELECT * FROM buys WHERE NOT ({_COIN}))')}")
def _(spark, sf):
    buys = view(spark, sf, "buys")
    return kgc.coin_negatives(buys, buys, buys.select("head").union(buys.select("tail")), 5)


@query("split_coverage", f"SELECT COUNT(*) AS n, COUNT(*) FILTER (h AND t) AS covered, round(AVG(CASE WHEN h AND t THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT head IN (SELECT head FROM ({SPLIT}) WHERE split = 'train') AS h, tail IN (SELECT tail FROM ({SPLIT}) WHERE split = 'train') AS t FROM ({SPLIT}) WHERE split = 'test')")
def _(spark, sf):
    s = split(spark, sf)
    return kgc.split_coverage(s.where("split = 'test'"), s.where("split = 'train'")).withColumn("share", F.round("share", 6))


@query("consensus_positive", "SELECT head, relation, tail, 'prediction:lp' AS source, 'low' AS quality FROM lp GROUP BY head, relation, tail HAVING bool_and(pred)")
def _(spark, sf):
    return kgc.consensus_positive(view(spark, sf, "lp"))


@query("negatives_for_taxa", "SELECT l.head, l.tail, l.prob FROM lp AS l JOIN ent AS e ON l.head = e.entity_id WHERE l.prob < 0.5 AND e.tax_id IN ('1', '2', '3')")
def _(spark, sf):
    lp = view(spark, sf, "lp")
    taxa = view(spark, sf, "nodes").where("tax_id in ('1', '2', '3')")
    heads = view(spark, sf, "ent").where("tax_id is not null").select(F.col("entity_id").alias("head"), "tax_id")
    return kgc.negatives_for_taxa([lp.where("run < 4"), lp.where("run >= 4")], taxa, heads).select("head", "tail", "prob")


# Metrics.

_CM = "COUNT(*) FILTER (label = 0 AND pred = 0) AS tn, COUNT(*) FILTER (label = 0 AND pred = 1) AS fp, COUNT(*) FILTER (label = 1 AND pred = 0) AS fn, COUNT(*) FILTER (label = 1 AND pred = 1) AS tp"
_RATES = "round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tn / nullif(tn + fn, 0), 6) AS npv, tp + fp AS pp, tn + fn AS pn, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy"
_RATED = ("accuracy", "precision", "recall", "f1", "specificity", "npv", "balanced_accuracy")


def _confusion(rows, by):
    out = metrics.confusion_metrics(rows, by)
    return out.withColumns({c: F.round(c, 6) for c in _RATED})


@query("confusion_metrics", f"SELECT run, tn, fp, fn, tp, {_RATES} FROM (SELECT run, {_CM} FROM scored GROUP BY run)")
def _(spark, sf):
    return _confusion(view(spark, sf, "scored"), ["run"])


@query("metrics_by_section", f"SELECT section, tn, fp, fn, tp, {_RATES} FROM (SELECT CASE WHEN lang = 'en' THEN 'Others' ELSE lang END AS section, {_CM} FROM scored GROUP BY ALL)")
def _(spark, sf):
    return _confusion(view(spark, sf, "scored").withColumn("section", F.coalesce(F.nullif("lang", F.lit("en")), F.lit("Others"))), ["section"])


_CUM = "SELECT run, score, p, q, SUM(p) OVER w AS tp, SUM(q) OVER w AS fp, SUM(p) OVER (PARTITION BY run) AS np, SUM(q) OVER (PARTITION BY run) AS nn FROM (SELECT run, score, COUNT(*) FILTER (label = 1) AS p, COUNT(*) FILTER (label = 0) AS q FROM scored GROUP BY run, score) WINDOW w AS (PARTITION BY run ORDER BY score DESC)"


@query("cumulative_counts", f"SELECT run, score, p AS dtp, q AS dfp, tp, fp FROM ({_CUM})")
def _(spark, sf):
    return metrics.cumulative_counts(view(spark, sf, "scored"), ["run"])


@query("roc_auc_ap", f"SELECT run, round(SUM(q * (tp - p / 2)) / (MAX(np) * MAX(nn)), 6) AS roc_auc, round(SUM(p * tp / (tp + fp)) / MAX(np), 6) AS average_precision FROM ({_CUM}) GROUP BY run")
def _(spark, sf):
    return metrics.roc_auc_ap(view(spark, sf, "scored"), ["run"]).select("run", r("roc_auc"), r("average_precision"))


@query("curve_points", f"SELECT run, score, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM ({_CUM})")
def _(spark, sf):
    return metrics.curve_points(view(spark, sf, "scored"), ["run"]).select("run", "score", r("fpr"), r("tpr"), r("precision"))


@query("best_f1_threshold", f"SELECT run, score AS threshold, f1 FROM (SELECT run, score, round(2.0 * tp / (tp + fp + np), 12) AS f1 FROM ({_CUM})) QUALIFY row_number() OVER (PARTITION BY run ORDER BY f1 DESC, score) = 1")
def _(spark, sf):
    return metrics.best_f1_threshold(view(spark, sf, "scored"), ["run"])


@query("ensemble_mean_std", "SELECT doc_id, round(AVG(prob), 6) AS prob_mean, round(stddev_samp(prob), 6) AS prob_std, COUNT(*) AS runs FROM runs GROUP BY doc_id")
def _(spark, sf):
    return metrics.ensemble_mean_std(view(spark, sf, "runs"), ["doc_id"]).select("doc_id", r("prob_mean"), r("prob_std"), "runs")


_BINS = "SELECT i.bin, round((i.bin + 0.5) / {n}, 6) AS middle, coalesce(n, 0) AS n, coalesce(p, 0) AS positives, round(p / n, 6) AS fraction FROM (SELECT CAST(unnest(range({n})) AS INT) AS bin) AS i LEFT JOIN (SELECT {bin} AS bin, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS p FROM scored GROUP BY ALL) AS c ON i.bin = c.bin"


@query("calibration_bins", _BINS.format(n=10, bin="CAST(least(floor(round(prob * 10, 9)), 9) AS INT)"))
def _(spark, sf):
    return metrics.calibration_bins(view(spark, sf, "scored"), 10).withColumns({"fraction": F.round("fraction", 6), "middle": F.round("middle", 6)})


@query("calibration_bins_right", _BINS.format(n=5, bin="CAST(greatest(ceil(round(prob * 5, 9)) - 1, 0) AS INT)"))
def _(spark, sf):
    return metrics.calibration_bins(view(spark, sf, "scored"), 5, left_closed=False).withColumns({"fraction": F.round("fraction", 6), "middle": F.round("middle", 6)})


@query("bin_filter", "SELECT CAST(least(floor(round(prob * 5, 9)), 4) AS INT) AS bin, COUNT(*) AS n FROM pool GROUP BY ALL")
def _(spark, sf):
    return view(spark, sf, "pool").groupBy(metrics.bin_of(F.col("prob"), 5).alias("bin")).agg(F.count("*").alias("n"))


@query("r2_score", "SELECT run, round(1 - SUM((label - prob) * (label - prob)) / (var_pop(label) * COUNT(*)), 6) AS r2 FROM scored GROUP BY run")
def _(spark, sf):
    return metrics.r2_score(view(spark, sf, "scored"), "label", "prob", ["run"]).select("run", r("r2"))


_T = "SELECT round, AVG(f1) FILTER (strategy = 'random') AS a, AVG(f1) FILTER (strategy = 'uncertain') AS b, var_samp(f1) FILTER (strategy = 'random') AS va, var_samp(f1) FILTER (strategy = 'uncertain') AS vb, COUNT(f1) FILTER (strategy = 'random') AS na, COUNT(f1) FILTER (strategy = 'uncertain') AS nb FROM rounds GROUP BY round"


def _p_sql(inner: str) -> str:
    """``inner`` (round, t, df) with the two-sided p-value: one less Simpson's sum of Student's density from -t to t."""
    density = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * power(1 + power(abs(t) * i / 2000, 2) / df, -(df + 1) / 2)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"SELECT round, t, df, CASE WHEN t IS NULL OR df IS NULL THEN NULL ELSE greatest(1 - 2 * SUM({weight} * {density}) * abs(t) / 2000 / 3, 0) END AS p_value FROM ({inner}) CROSS JOIN (SELECT unnest(range(2001)) AS i) GROUP BY round, t, df"


_STUDENT = f"SELECT round, (a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) AS t, CAST(na + nb - 2 AS DOUBLE) AS df FROM ({_T})"
_WELCH = f"SELECT round, (a - b) / sqrt(va / na + vb / nb) AS t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS df FROM ({_T})"


@query("two_sample_t", f"SELECT round, round(t, 6) AS t, df, round(p_value, 6) AS p_value FROM ({_p_sql(_STUDENT)})")
def _(spark, sf):
    return metrics.two_sample_t(view(spark, sf, "rounds"), ["round"], "strategy", "random", "uncertain", "f1").select("round", r("t"), "df", r("p_value"))


@query("welch_t", f"SELECT round, round(t, 6) AS t, round(df, 4) AS df, round(p_value, 6) AS p_value FROM ({_p_sql(_WELCH)})")
def _(spark, sf):
    return metrics.two_sample_t(view(spark, sf, "rounds"), ["round"], "strategy", "random", "uncertain", "f1", equal_var=False).select("round", r("t"), r("df", 4), r("p_value"))


@query("fdr_adjust", "SELECT g, k, p_value, round(least(MIN(p_value * n / i) OVER (PARTITION BY g ORDER BY i DESC), 1.0), 9) AS p_adjusted FROM (SELECT k % 50 AS g, k, prob AS p_value, row_number() OVER (PARTITION BY k % 50 ORDER BY prob, k) AS i, COUNT(*) OVER (PARTITION BY k % 50) AS n FROM pool)")
def _(spark, sf):
    p = view(spark, sf, "pool").select((F.col("k") % 50).alias("g"), "k", F.col("prob").alias("p_value"))
    return metrics.fdr_adjust(p, ["g"]).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query("overlap_hypergeom", "SELECT CAST(least(floor(round(prob * 10, 9)), 9) AS INT) AS bin, COUNT(*) AS n, COUNT(*) FILTER (k % 3 = 0) AS k FROM pool GROUP BY ALL")
def _(spark, sf):
    return metrics.overlap_hypergeom(view(spark, sf, "pool").withColumn("seen", F.col("k") % 3 == 0), 10, "prob", "seen").where("p >= 0").select("bin", "n", "k")


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"


@query("overlap_hypergeom_p", f"""SELECT bin, n, k, round(exp({_CHOOSE.format('kk', 'k')} + {_CHOOSE.format('(nn - kk)', '(n - k)')} - ({_CHOOSE.format('nn', 'n')})), 6) AS p FROM (SELECT CAST(least(floor(round(prob * 10, 9)), 9) AS INT) AS bin, COUNT(*) AS n, COUNT(*) FILTER (k % 3 = 0) AS k FROM pool GROUP BY ALL)
    CROSS JOIN (SELECT COUNT(*) AS nn, COUNT(*) FILTER (k % 3 = 0) AS kk FROM pool)""")
def _(spark, sf):
    return metrics.overlap_hypergeom(view(spark, sf, "pool").withColumn("seen", F.col("k") % 3 == 0), 10, "prob", "seen").select("bin", "n", "k", r("p"))


@query("class_balance", "SELECT strategy, round, round(AVG(s), 6) AS mean, round(stddev_samp(s), 6) AS std, COUNT(*) AS runs FROM (SELECT strategy, round, run, AVG(CASE WHEN answer = 'Entails' THEN 1.0 ELSE 0.0 END) AS s FROM rounds GROUP BY ALL) GROUP BY strategy, round")
def _(spark, sf):
    return metrics.class_balance(view(spark, sf, "rounds"), ["strategy", "round"], "run", F.col("answer") == "Entails").select("strategy", "round", r("mean"), r("std"), "runs")


_DISC = "SELECT strategy, round, AVG(n) AS m FROM (SELECT strategy, run, round, COUNT(*) FILTER (answer = 'Entails') AS n FROM rounds GROUP BY ALL) GROUP BY strategy, round"


@query("discovery_curve", f"SELECT a.strategy, a.round, round(a.m, 6) AS mean, round(a.m - b.m, 6) AS difference, round(a.m / b.m, 6) AS ratio FROM ({_DISC}) AS a LEFT JOIN ({_DISC}) AS b ON a.round = b.round AND b.strategy = 'random'")
def _(spark, sf):
    return metrics.discovery_curve(view(spark, sf, "rounds"), F.col("answer") == "Entails").select("strategy", "round", r("mean"), r("difference"), r("ratio"))


@query("grid_search_summary", "SELECT strategy, run, round(AVG(f1), 6) AS f1 FROM rounds GROUP BY strategy, run")
def _(spark, sf):
    return metrics.grid_search_summary(view(spark, sf, "rounds"), ["strategy", "run"], ["f1"]).select("strategy", "run", r("f1"))


@query("best_model", "SELECT round AS dataset, run AS model, round(m, 6) AS mean FROM (SELECT round, run, AVG(f1) AS m FROM rounds GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY round ORDER BY m DESC, run) = 1")
def _(spark, sf):
    return metrics.best_model(view(spark, sf, "rounds").select(F.col("round").alias("dataset"), F.col("run").alias("model"), "f1"), "dataset", "model", "f1").withColumn("mean", F.round("mean", 6))


@query("metric_report", "SELECT strategy, round, printf('%.2f', AVG(f1) * 100) || '±' || printf('%.2f', stddev_pop(f1) * 100) AS f1 FROM rounds GROUP BY strategy, round")
def _(spark, sf):
    return metrics.metric_report(view(spark, sf, "rounds"), ["strategy", "round"], ["f1"])


_RANKS = """SELECT q.doc_id, CAST(1 + COUNT(*) FILTER (c.prob > q.prob) AS BIGINT) AS rank FROM (SELECT doc_id, prob, lang FROM runs WHERE run = 1) AS q JOIN (SELECT doc_id, prob FROM runs WHERE run > 1 AND doc_id % 4 <> 0) AS c ON c.doc_id = q.doc_id GROUP BY q.doc_id"""


def _ranks(spark, sf):
    runs = view(spark, sf, "runs").select(F.col("doc_id").cast("string").alias("head"), F.lit("r").alias("relation"), F.col("run").cast("string").alias("tail"), F.col("prob").alias("score"), "doc_id")
    known = runs.where("doc_id % 4 = 0").select("head", "relation", "tail")
    return metrics.filtered_rank(runs.where("tail <> '1'"), runs.where("tail = '1'"), known, ["head", "relation"])


@query("filtered_rank", f"SELECT CAST(d.doc_id AS STRING) AS head, coalesce(k.rank, 1) AS rank FROM documents AS d LEFT JOIN ({_RANKS}) AS k ON d.doc_id = k.doc_id")
def _(spark, sf):
    return _ranks(spark, sf).select("head", "rank")


@query("rank_metrics", f"SELECT 'all' AS side, round(AVG(r), 6) AS mean_rank, round(AVG(1 / r), 6) AS mrr, round(AVG(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hits_1, round(AVG(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits_3 FROM (SELECT coalesce(k.rank, 1) AS r FROM documents AS d LEFT JOIN ({_RANKS}) AS k ON d.doc_id = k.doc_id)")
def _(spark, sf):
    return metrics.rank_metrics(_ranks(spark, sf).withColumn("side", F.lit("all")), ["side"], [1, 3]).select("side", *(r(c) for c in ("mean_rank", "mrr", "hits_1", "hits_3")))


# Scores that two models might give, by arithmetic on the entities' numbers; ranks of the test split among all entities.
def _numbers(names):
    """The numbers of a column's names, each of which is read once, and the places of the rows among them."""
    names = names.astype("category").cat
    return pc.cast(pc.utf8_slice_codeunits(pa.array(names.categories, pa.string()), 1), pa.int64()).to_numpy(), names.codes.to_numpy().astype(np.intp)


def _modulo(x, n: int):
    return x - x // n * n  # numpy divides by a number many times faster than it takes remainders


def _scorer(run: int):
    def score(frame):
        (head, at), (tail, to) = (_numbers(frame[c]) for c in ("head", "tail"))
        # (head * 37 * run + tail * 131 + head % 11 * tail % 1_009) % 10_007, with remainders taken of the names first.
        small = lambda x: x.astype(np.int32)
        both = small(head * 37 * run % 10_007)[at] + small(tail * 131 % 10_007)[to]
        return _modulo(both + _modulo(small(head % 11)[at] * small(tail % 1_009)[to], 1_009), 10_007) / 10_007

    return score


def _entity_ranks(spark, sf, run: int):
    test = split(spark, sf).where("split = 'test'").select("head", "relation", "tail")
    return metrics.entity_ranks(test, view(spark, sf, "ent").select("entity_id"), view(spark, sf, "kg"), _scorer(run))


def _score_sql(head: str, tail: str, run: int) -> str:
    h, t = (f"CAST(substr({x}, 2) AS BIGINT)" for x in (head, tail))
    return f"({h} * 37 * {run} + {t} * 131 + {h} % 11 * {t} % 1009) % 10007"


def _ranked_sql(run: int) -> str:
    test = f"(SELECT head, relation, tail, {_score_sql('head', 'tail', run)} AS own FROM ({SPLIT}) WHERE split = 'test')"
    side = lambda end, other: f"""SELECT t.head, t.relation, t.tail, '{end}' AS side, CAST(1 + COUNT(*) FILTER (k.head IS NULL AND {_score_sql(*(('e.entity_id', 't.tail') if end == 'head' else ('t.head', 'e.entity_id')), run)} > t.own) AS BIGINT) AS rank
        FROM {test} AS t CROSS JOIN ent AS e LEFT JOIN kg AS k ON k.relation = t.relation AND k.{other} = t.{other} AND k.{end} = e.entity_id GROUP BY ALL"""  # noqa: E731
    return f"{side('head', 'tail')} UNION ALL {side('tail', 'head')}"


@query("entity_ranks", _ranked_sql(1))
def _(spark, sf):
    return _entity_ranks(spark, sf, 1)


_SIDED = " UNION ALL ".join(f"SELECT {run} AS run, side, rank FROM ({_ranked_sql(run)})" for run in (1, 2))


@query("rank_report", f"""SELECT side, round(AVG(mr), 6) AS mean_rank, round(AVG(rr), 6) AS mrr, round(AVG(h), 6) AS hits_3, round(stddev_pop(mr), 6) AS mean_rank_std, round(stddev_pop(rr), 6) AS mrr_std, round(stddev_pop(h), 6) AS hits_3_std
    FROM (SELECT coalesce(side, 'both') AS side, run, AVG(rank) AS mr, AVG(1 / rank) AS rr, AVG(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS h FROM ({_SIDED}) GROUP BY GROUPING SETS ((side, run), (run))) GROUP BY side""")
def _(spark, sf):
    ranks = _entity_ranks(spark, sf, 1).withColumn("run", F.lit(1)).unionByName(_entity_ranks(spark, sf, 2).withColumn("run", F.lit(2)))
    out = metrics.rank_report(ranks.select("side", "run", "rank"), ks=[3])
    return out.select("side", *(r(c) for c in out.columns if c != "side"))


@query("model_rank", "SELECT round, run, m AS f1, rank() OVER (PARTITION BY round ORDER BY m DESC) + (COUNT(*) OVER (PARTITION BY round, m) - 1) / 2 AS rank FROM (SELECT round, run, round(AVG(f1), 3) AS m FROM rounds GROUP BY ALL)")
def _(spark, sf):
    means = view(spark, sf, "rounds").groupBy("round", "run").agg(F.round(F.avg("f1"), 3).alias("f1"))
    return metrics.model_rank(means, ["round"], "f1")


@query("label_scores", "SELECT k.head, k.relation, k.tail, 1 AS label, coalesce(p.prob, (SELECT MIN(prob) FROM lp WHERE run = 1)) AS prob FROM kg AS k LEFT JOIN (SELECT head, relation, tail, MIN(prob) AS prob FROM lp WHERE run = 1 GROUP BY ALL) AS p ON k.head = p.head AND k.relation = p.relation AND k.tail = p.tail")
def _(spark, sf):
    scores = view(spark, sf, "lp").where("run = 1").groupBy("head", "relation", "tail").agg(F.min("prob").alias("prob"))
    return metrics.label_scores(scores, view(spark, sf, "kg").withColumn("label", F.lit(1)), "min")


@query("holdout_overlap", "SELECT hypothesis IN (SELECT hypothesis FROM ev WHERE line = 1 AND premise < 'p2') AS seen, COUNT(*) AS n, round(AVG(prob_mean), 6) AS mean_prob FROM ev WHERE line > 4 GROUP BY ALL")
def _(spark, sf):
    ev = view(spark, sf, "ev")
    return metrics.holdout_overlap(ev.where("line > 4"), ev.where("line = 1 and premise < 'p2'"), "hypothesis", "prob_mean").withColumn("mean_prob", F.round("mean_prob", 6))


@query("minmax_scale", "SELECT doc_id, run, round((prob - lo) / (hi - lo), 6) AS scaled FROM runs CROSS JOIN (SELECT MIN(prob) AS lo, MAX(prob) AS hi FROM scored WHERE run = 1)")
def _(spark, sf):
    return metrics.minmax_scale(view(spark, sf, "scored").where("run = 1"), view(spark, sf, "runs"), "prob").select("doc_id", "run", r("scaled"))


# Pool adjacent violators in SQL: the fitted value of a score is the largest, over starts at or before it, of the smallest
# mean of labels up to an end at or after it.
_FIT = "SELECT score, SUM(label) AS y, COUNT(*) AS w FROM scored WHERE run = 1 GROUP BY score"
_MEANS = f"SELECT a.score AS lo, b.score AS hi, SUM(c.y) / SUM(c.w) AS m FROM ({_FIT}) AS a JOIN ({_FIT}) AS b ON a.score <= b.score JOIN ({_FIT}) AS c ON c.score BETWEEN a.score AND b.score GROUP BY a.score, b.score"
_FITTED = f"SELECT s.score, MAX(l.m) AS prob FROM ({_FIT}) AS s JOIN (SELECT s.score, m.lo, MIN(m.m) AS m FROM ({_FIT}) AS s JOIN ({_MEANS}) AS m ON m.lo <= s.score AND m.hi >= s.score GROUP BY s.score, m.lo) AS l ON l.score = s.score GROUP BY s.score"


@query("isotonic_calibrate", f"SELECT a.doc_id, a.score, round(f.prob, 6) AS prob FROM (SELECT doc_id, score FROM scored WHERE run = 2) AS a JOIN ({_FITTED}) AS f ON f.score = least(greatest(a.score, (SELECT MIN(score) FROM ({_FIT}))), (SELECT MAX(score) FROM ({_FIT})))")
def _(spark, sf):
    s = view(spark, sf, "scored")
    return metrics.isotonic_calibrate(s.where("run = 1").select("label", "score"), s.where("run = 2").select("doc_id", "score")).select("doc_id", "score", r("prob"))


# Newton's method in SQL: twelve full steps from zero, which is more than enough on overlapping scores.
_NEWTON = """SELECT step, a, b FROM (WITH RECURSIVE pts AS (SELECT CAST(score AS DOUBLE) AS x, SUM(CASE WHEN label = 1 THEN (n1 + 1.0) / (n1 + 2.0) ELSE 1.0 / (n0 + 2.0) END)::DOUBLE AS y, CAST(COUNT(*) AS DOUBLE) AS w FROM scored CROSS JOIN (SELECT COUNT(*) FILTER (label = 1)::DOUBLE AS n1, COUNT(*) FILTER (label <> 1)::DOUBLE AS n0 FROM scored WHERE run = 1) WHERE run = 1 GROUP BY score), lists AS (SELECT list(x) AS xs, list(y) AS ys, list(w) AS ws FROM pts),
    newton AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
        SELECT step + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
            SELECT step, a, b, list_sum(list_transform(t, lambda r: r.g * r.x)) AS ga, list_sum(list_transform(t, lambda r: r.g)) AS gb, list_sum(list_transform(t, lambda r: r.h * r.x * r.x)) AS haa, list_sum(list_transform(t, lambda r: r.h * r.x)) AS hab, list_sum(list_transform(t, lambda r: r.h)) AS hbb FROM (
                SELECT step, a, b, list_transform(list_zip(xs, ys, ws), lambda q: {'x': q[1], 'g': q[2] - q[3] / (1 + exp(-(a * q[1] + b))), 'h': q[3] / (1 + exp(-(a * q[1] + b))) * (1 - 1 / (1 + exp(-(a * q[1] + b))))}) AS t FROM newton CROSS JOIN lists WHERE step < 12))) SELECT * FROM newton) WHERE step = 12"""


@query("platt_calibrate", f"SELECT s.doc_id, s.score, round(1 / (1 + exp(-(n.a * s.score + n.b))), 4) AS prob FROM scored AS s CROSS JOIN ({_NEWTON}) AS n WHERE s.run = 2")
def _(spark, sf):
    s = view(spark, sf, "scored")
    return metrics.platt_calibrate(s.where("run = 1").select("label", "score"), s.where("run = 2").select("doc_id", "score")).select("doc_id", "score", r("prob", 4))


@query("score_pairs", "SELECT doc_id, round(length(text) % 100 / 100, 6) AS prob FROM documents")
def _(spark, sf):
    docs = view(spark, sf, "documents").select("doc_id", "text")
    return metrics.score_pairs(docs, lambda pdf: np.array([len(t) % 100 / 100 for t in pdf["text"]])).select("doc_id", r("prob"))


@query("production_hypotheses", 'SELECT head, relation, tail, round(AVG(prob), 6) AS prob_mean, round(stddev_pop(prob), 6) AS prob_std, bool_and(pred) AS "every" FROM lp GROUP BY ALL')
def _(spark, sf):
    return metrics.production_hypotheses(view(spark, sf, "lp")).select("head", "relation", "tail", r("prob_mean"), r("prob_std"), "every")


@query("rank_hypotheses", "SELECT head, tail, round(AVG(prob), 6) AS m FROM lp GROUP BY head, relation, tail ORDER BY round(AVG(prob), 9) DESC, head, tail, relation LIMIT 50")
def _(spark, sf):
    p = metrics.production_hypotheses(view(spark, sf, "lp"))
    return p.orderBy(F.desc(F.round("prob_mean", 9)), "head", "tail", "relation").limit(50).select("head", "tail", F.round("prob_mean", 6).alias("m"))
