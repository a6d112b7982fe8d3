"""Data sets of the graph for link prediction: splits, cut-offs, hypotheses and negatives."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import pseudo_random
from graphloom.operators.annotate import numbered, ranged, running_offsets
from graphloom.operators.skew import join_by_size
from graphloom.sources.written import stash, tidy

T = ["head", "relation", "tail"]


def split_triples(triples: DataFrame, train: float = 0.7, val: float = 0.15, seed: str = "42") -> DataFrame:
    """``triples`` with ``split``, in pseudo-random order: whole parts of the count for train and val, the rest test."""
    n = triples.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    placed = numbered(triples, [pseudo_random(*map(F.col, T), seed=seed), *map(F.col, T)], "__at")
    return placed.withColumn("split", F.when(F.col("__at") < a, "train").when(F.col("__at") < b, "val").otherwise("test")).drop("__at")


def train_minus_holdout(train: DataFrame, *holdouts: DataFrame) -> DataFrame:
    """Triples that stand once among train and hold-outs together."""
    both = train.select(*T)
    for h in holdouts:
        both = both.unionByName(h.select(*T))
    return both.groupBy(*T).count().where("count = 1").select(*T)


def assert_disjoint(a: DataFrame, b: DataFrame) -> None:
    if not a.select(*T).intersect(b.select(*T)).isEmpty():
        raise ValueError("splits share a triple")


def exclude_taxa(parts: DataFrame, held: DataFrame, taxa: DataFrame) -> DataFrame:
    """Part-level triples whose head's taxon is no taxon of a held-out head. ``taxa`` has (entity_id, tax_id)."""
    gone = held.select(F.col("head").alias("entity_id")).distinct().join(taxa, "entity_id").select("tax_id").distinct()
    heads = taxa.join(gone, "tax_id", "left_semi").select(F.col("entity_id").alias("head")).distinct()
    return parts.join(heads, "head", "left_anti").select(*parts.columns)


def prob_cutoffs(evidence: DataFrame, cutoffs: list[float]) -> DataFrame:
    """(cutoff, triple…): evidence at or above each cut-off, in one pass; a missing probability counts as 1."""
    levels = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    return evidence.select("*", levels).where(F.coalesce("prob_mean", F.lit(1.0)) >= F.col("cutoff"))


def train_above_cutoff(train: DataFrame, evidence: DataFrame, cutoff: float) -> DataFrame:
    strong = evidence.where(F.coalesce("prob_mean", F.lit(1.0)) >= cutoff)
    return train.join(strong, T, "left_semi").select(*train.columns)


def holdout_by_source(train: DataFrame, evidence: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """(train without, test): the distinct triples of evidence from the sources become the test set."""
    test = evidence.where(F.col("source").isin(sources)).select(*T).distinct()
    return train.join(test, T, "left_anti").select(*train.columns), test


#: Tails of one group, and heads of one, in the product of both: a task's key is a pair of groups.
GROUP = 2_000
#: Known tails of a head in one group that are compared one by one.
FEW = 32


def candidate_hypotheses(kg: DataFrame, relation: str, head_filter: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """All unknown (head, relation, tail) of the relation's heads and tails.

    The asked-for result is their product, and it is made where it stays: heads and tails are dealt to groups of about
    ``group``, a head meets the array of a whole group of tails, without those that it is known with in that group, and
    only then becomes rows. So what is shuffled is the product's size divided by ``group``.
    """
    own = stash(kg.where(F.col("relation") == relation).select("head", "tail").distinct(), "own")
    heads, tails = own.select("head").distinct(), own.select("tail").distinct()
    if head_filter is not None:
        heads = heads.join(head_filter.select("head"), "head", "left_semi")
    n_heads, n_tails = (max(1, -(-int(n) // group)) for n in own.agg(F.count_distinct("head"), F.count_distinct("tail")).first())
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    known = own.groupBy("head", deal("tail", n_tails).alias("h")).agg(F.collect_list("tail").alias("known"))
    asking = heads.select("head", deal("head", n_heads).alias("g"), each(n_tails).alias("h")).join(known, ["head", "h"], "left")
    grouped = tails.groupBy(deal("tail", n_tails).alias("h")).agg(F.collect_list("tail").alias("tails")).select("h", "tails", each(n_heads).alias("g"))
    # A few known tails are compared with each row as it is made; only longer lists are worth a hash set.
    few = F.size(F.coalesce("known", F.array().cast("array<string>"))) <= FEW
    unknown = F.when(few, F.col("tails")).otherwise(F.array_except("tails", "known"))
    met = asking.join(grouped, ["g", "h"]).select("head", F.when(few, F.col("known")).alias("known"), F.explode(unknown).alias("tail"))
    return met.where(F.col("known").isNull() | ~F.array_contains("known", F.col("tail"))).select("head", F.lit(relation).alias("relation"), "tail")


@tidy("unknown")
def unknown_ends(rows: DataFrame, known: DataFrame, end: str, pool: DataFrame, draws: int = 1, seed: str = "42", again: bool = True) -> DataFrame:
    """``rows`` (triples) ``draws`` times each, numbered in ``draw`` from 0, with ``new``: an entity of ``pool`` (one column) that
    makes the triple unknown in the place of its ``end``.

    A draw is a place among the entities that are free for the row's relation and other end, by hash, and every free
    entity is as likely as any other. With the known ones' positions q_0 < q_1 < ... in the sorted pool, the r-th free
    position is r + j, where j of the q_i - i are r at most: positions and draws are ordered together once, by range,
    and j is a running count. So nothing is tried in vain, and no group of a hot end has to be in one task. With
    ``again`` false a row's draws differ: they follow one another from the first, around the end of the free ones. A row
    with no (or, if they are to differ, too few) free entities fails.
    """
    return _drawn_ends(_marked(rows, known), end, pool, draws, seed, again).drop("times")


#: Known triples of one relation and other end that are held as a list; more are sorted with the draws.
LISTED = 1 << 9


def _marked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(triple, times): rows and known triples, each once, written, with how often it is among the rows."""
    own = rows.select(*T, F.lit(1).cast("long").alias("times"))
    both = own if known is rows else own.unionByName(known.select(*T, F.lit(0).cast("long").alias("times")))
    return stash(both.groupBy(*T).agg(F.sum("times").alias("times")), "marked")


def _drawn_ends(marked: DataFrame, end: str, pool: DataFrame, draws: int, seed: str, again: bool = True) -> DataFrame:
    """The rows of ``unknown_ends`` with ``times``, how often their triple is repeated; triples with a null are left out.

    The known positions of a relation and other end meet its rows as a list; only where there are over ``LISTED`` of them are
    positions and draws sorted together.
    """
    other = "tail" if end == "head" else "head"
    key = ["relation", other]
    indexed = stash(numbered(pool.select(F.col(pool.columns[0]).alias("new")).distinct(), [F.col("new")], "pos"), "pool")
    size = indexed.count()
    whole = marked.where(" and ".join(f"{c} is not null" for c in T))
    hot = stash(whole.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > LISTED).select(*key), "hot")
    none_hot = hot.isEmpty()
    cold = whole if none_hot else whole.join(hot, key, "left_anti")
    number = lambda *more: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}{end}"), *T, *more)), 1, 15), 16, 10).cast("long")
    placed = cold.join(indexed.select(F.col("new").alias(end), "pos"), end, "left").where("times > 0 or pos is not null")
    held = F.sort_array(F.filter(F.transform("own", lambda o: o["pos"]), lambda p: p.isNotNull()))
    lists = placed.groupBy(*key).agg(F.collect_list(F.struct("pos", "times", end)).alias("own"))
    # As many known positions stand before the r-th free one as have r free ones before them, or fewer.
    gaps = lists.select(*key, F.filter("own", lambda o: o["times"] > 0).alias("own"), F.transform(held, lambda p, i: p - i).alias("gaps"))
    each = gaps.select(*key, "gaps", F.explode("own").alias("o")).select(*key, "gaps", f"o.{end}", "o.times")
    left = F.lit(size) - F.size("gaps")
    free = F.when(left < (1 if again else draws), F.raise_error(F.lit("no unknown corruption")).cast("long")).otherwise(left)
    rank = F.pmod(number(F.col("draw").cast("string")), free) if again else F.pmod(F.pmod(number(F.lit("0")), free) + F.col("draw"), free)
    drawn = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    # By way of an array, so that a draw's number is made once and not for each of the gaps that it is compared with.
    drawn = drawn.select(*T, "draw", "times", "gaps", F.explode(F.array(rank)).alias("r"))
    at = drawn.select(*T, "draw", "times", (F.col("r") + F.size(F.filter("gaps", lambda g: g <= F.col("r")))).alias("pos"))
    if not none_hot:
        at = at.unionByName(_sorted_ends(stash(whole.join(hot, key, "left_semi"), "whole"), end, indexed, size, draws, number, again))
    return at.join(indexed, "pos").select(*T, "draw", "new", "times")


def _sorted_ends(marked: DataFrame, end: str, indexed: DataFrame, size: int, draws: int, number: Callable[..., Column], again: bool) -> DataFrame:
    """(triple, draw, times, pos): positions of draws by a sort with the known ones, where these are many."""
    other = "tail" if end == "head" else "head"
    key = ["relation", other]
    met = stash(marked.select(F.col(end).alias("new"), *key).join(indexed, "new").select(*key, "pos"), "met")
    placed = stash(numbered(met, [*map(F.col, key), F.col("pos")], "at"), "placed")
    first = stash(placed.groupBy(*key).agg(F.min("at").alias("first"), F.count("*").alias("taken")), "first")
    asking = marked.where("times > 0")
    sizes = asking.groupBy(*key).agg(F.count("*").alias("asked")).join(first, key, "left").select(*key, "asked", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("taken", F.lit(0)).alias("taken"))
    sized = join_by_size(asking, stash(sizes, "sizes"), key, "asked").withColumn("free", F.lit(size) - F.col("taken"))
    enough = F.when(F.col("free") < (1 if again else draws), F.raise_error(F.lit("no unknown corruption")).cast("long")).otherwise(F.col("free"))
    each = sized.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("free", enough)
    rank = F.pmod(number(F.col("draw").cast("string")), F.col("free")) if again else F.pmod(F.pmod(number(F.lit("0")), F.col("free")) + F.col("draw"), F.col("free"))
    # Known positions come before draws of the same place, and are counted over all keys; those of the keys before go off.
    gaps = join_by_size(placed, first, key, "taken").select(*key, (F.col("pos") - (F.col("at") - F.col("first"))).alias("place"), F.lit(1).alias("is_known"))
    asked = each.select(*key, rank.alias("place"), F.lit(0).alias("is_known"), end, "draw", "times", F.when(F.col("taken") > 0, F.col("first")).alias("first"))
    events, parts = ranged(gaps.unionByName(asked, allowMissingColumns=True), [*map(F.col, key), F.col("place"), -F.col("is_known")])
    offsets = running_offsets(events.groupBy("__p").agg(F.sum("is_known").alias("known")), "known").select("__p", "__before")
    local = F.sum("is_known").over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    running = events.withColumn("before", local).where("is_known = 0").join(F.broadcast(offsets), "__p")  # a row for each partition
    skipped = F.when(F.col("first").isNull(), 0).otherwise(F.col("before") + F.col("__before") - F.col("first"))
    return running.select(*T, "draw", "times", (F.col("place") + skipped).alias("pos"))


@tidy("negatives")
def negative_samples(positives: DataFrame, known: DataFrame, draws: int = 1, seed: str = "42") -> DataFrame:
    """(head, relation, tail, label): each positive, ``draws`` unknown triples with another head, and as many with another tail.

    New ends come from the positives' own. A positive that has no unknown corruption of an end fails. Repeated positives
    have their corruptions repeated.
    """
    marked = _marked(positives, known)
    own = marked.where("times > 0")
    out = _repeated(own).select(*T, F.lit(1).alias("label"))
    for end in ("head", "tail"):
        out = out.unionByName(_corrupted(_drawn_ends(marked, end, own.select(end), draws, seed), end))
    return out


@tidy("negatives")
def coin_negatives(positives: DataFrame, known: DataFrame, entities: DataFrame, draws: int = 5, seed: str = "42") -> DataFrame:
    """(head, relation, tail, label): each positive, and ``draws`` unknown triples with another head, or with another tail, as a
    hashed coin falls for the positive. New ends are any of ``entities`` (one column)."""
    marked = _marked(positives, known)
    entities = stash(entities.select(F.col(entities.columns[0]).alias("new")).distinct(), "entities")
    coin = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}coin"), *T)), 1, 1) < "8"
    out = _repeated(marked.where("times > 0")).select(*T, F.lit(1).alias("label"))
    for end, own in (("head", coin), ("tail", ~coin)):
        some = marked.withColumn("times", F.when(own, F.col("times")).otherwise(0))
        out = out.unionByName(_corrupted(_drawn_ends(some, end, entities, draws, seed), end))
    return out


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))


def _corrupted(made: DataFrame, end: str) -> DataFrame:
    return _repeated(made).select(*((F.col("new") if c == end else F.col(c)).alias(c) for c in T), F.lit(0).alias("label"))


def split_coverage(test: DataFrame, train: DataFrame) -> DataFrame:
    """(n, covered, share): test triples with both ends in training entities."""
    known = train.select(F.explode(F.array("head", "tail")).alias("e")).distinct()
    joined = test.join(known.select(F.col("e").alias("head"), F.lit(1).alias("h")), "head", "left").join(known.select(F.col("e").alias("tail"), F.lit(1).alias("t")), "tail", "left")
    both = F.col("h").isNotNull() & F.col("t").isNotNull()
    return joined.agg(F.count("*").alias("n"), F.count_if(both).alias("covered"), F.avg(both.cast("double")).alias("share"))


def consensus_positive(runs: DataFrame) -> DataFrame:
    """Triples that all runs call true, as low-quality evidence."""
    agreed = runs.groupBy(*T).agg(F.bool_and("pred").alias("every")).where("every")
    return agreed.select(*T, F.lit("prediction:lp").alias("source"), F.lit("low").alias("quality"))


def negatives_for_taxa(files: list[DataFrame], taxa: DataFrame, head_taxa: DataFrame, below: float = 0.5) -> DataFrame:
    """Rows of several prediction tables about given taxa with a probability under the bound."""
    rows = reduce(DataFrame.unionByName, files)
    heads = head_taxa.join(taxa.select("tax_id"), "tax_id", "left_semi").select("head").distinct()
    return rows.where(F.col("prob") < below).join(heads, "head", "left_semi")
