"""Reports on the graph: qualities, sources, intersections, top entities and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.phrases import phrases_in_text

T = ["head", "relation", "tail"]
QUALITIES = ["high", "medium", "low"]


def _rank() -> Column:
    r = F.lit(None).cast("int")
    for i, q in enumerate(QUALITIES):
        r = F.when(F.col("quality") == q, i).otherwise(r)
    return r


def evidence_slice(evidence: DataFrame, relation: str | None = None, sources: list[str] | None = None, with_pmid: bool = True) -> DataFrame:
    out = evidence.where("pmid is not null") if with_pmid else evidence
    out = out.where(F.col("relation") == relation) if relation else out
    return out.where(F.col("source").isin(sources)) if sources else out


def best_quality(evidence: DataFrame, keys: list[str] = T) -> DataFrame:
    """The best quality of each triple."""
    best = evidence.groupBy(*keys).agg(F.min(_rank()).alias("r"))
    return best.select(*keys, F.get(F.array(*map(F.lit, QUALITIES)), F.col("r")).alias("quality"))


def relation_quality_counts(evidence: DataFrame) -> DataFrame:
    """Unique triples by relation and best quality, with totals (null: all)."""
    return best_quality(evidence).rollup("relation", "quality").agg(F.count("*").alias("n"))


def source_quality_counts(evidence: DataFrame) -> DataFrame:
    """Distinct triples by family of source and quality, with totals of both.

    A triple meets the pairs that it has once; what the totals multiply is the distinct sets of pairs, which are few.
    """
    own = F.array_sort(F.collect_set(F.struct(F.split_part("source", F.lit(":"), F.lit(1)).alias("family"), "quality")))
    whole = F.count_if(F.concat(*T).isNotNull())  # a triple with a null is not counted
    sets = evidence.groupBy(*T).agg(own.alias("own")).groupBy("own").agg(whole.alias("n"))
    none = F.lit(None).cast("string")
    cell = lambda kind, family, quality: F.struct(F.lit(kind).alias("kind"), family.alias("family"), quality.alias("quality"))
    cells = F.flatten(F.transform("own", lambda p: F.array(cell(0, p["family"], p["quality"]), cell(1, p["family"], none), cell(2, none, p["quality"]), cell(3, none, none))))
    return sets.select("n", F.explode(F.array_distinct(cells)).alias("c")).groupBy("c").agg(F.sum("n").alias("n")).select("c.family", "c.quality", "n")


def source_sets(evidence: DataFrame, label: Column, by: list[str] = ()) -> DataFrame:
    """Triples by their exact set of sources."""
    sets = evidence.groupBy(*T).agg(F.array_join(F.array_sort(F.collect_set(label)), "|").alias("sources"))
    return sets.groupBy(*by, "sources").agg(F.count("*").alias("n"))


def venn_regions(members: DataFrame, key: list[str], set_no: str, sets: int) -> DataFrame:
    """(mask, n): keys by the exact sets that hold them; bit i is set i."""
    mask = members.groupBy(*key).agg(F.bit_or(F.expr(f"shiftleft(1, {set_no})")).alias("mask"))
    return mask.groupBy("mask").agg(F.count("*").alias("n"))


def overlap_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = a.select(F.col(key).alias("k"), F.lit(1).alias("m")).unionByName(b.select(F.col(key).alias("k"), F.lit(2).alias("m"))).groupBy("k").agg(F.bit_or("m").alias("m"))
    return both.agg(F.count_if(F.col("m").isin(1, 3)).alias("in_a"), F.count_if(F.col("m").isin(2, 3)).alias("in_b"), F.count_if(F.col("m") == 3).alias("in_both"))


def entity_provenance(entities: DataFrame, evidence: DataFrame, own: Column, external: Column) -> DataFrame:
    """Entities by kind and where their triples come from: ours, external, both or neither."""
    ends = evidence.select(F.explode(F.array("head", "tail")).alias("entity_id"), own.alias("o"), external.alias("x")).groupBy("entity_id").agg(F.bool_or("o").alias("o"), F.bool_or("x").alias("x"))
    o, x = F.coalesce("o", F.lit(False)), F.coalesce("x", F.lit(False))
    where = F.when(o & x, "both").when(o, "ours").when(x, "external").otherwise("ontology")
    return entities.join(ends, "entity_id", "left").groupBy(F.split_part("type", F.lit(":"), F.lit(1)).alias("kind"), where.alias("provenance")).agg(F.count("*").alias("n"))


def sources_per_triple(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mean, std, share with one) of evidence rows a triple, and their histogram."""
    per = evidence.groupBy(*T).agg(F.count("*").alias("rows"))
    summary = per.agg(F.avg("rows").alias("mean"), F.stddev_pop("rows").alias("std"), F.avg((F.col("rows") == 1).cast("double")).alias("share_one"))
    return summary, per.groupBy("rows").agg(F.count("*").alias("n"))


def flow_links(evidence: DataFrame) -> DataFrame:
    """(from, to, n, log2n): quality to source, and source to which article ids there are."""
    ids = F.when(F.col("pmid").isNotNull() & F.col("pmcid").isNotNull(), "pmid&pmcid").when(F.col("pmid").isNotNull(), "pmid").when(F.col("pmcid").isNotNull(), "pmcid").otherwise("none")
    one = evidence.select(F.explode(F.array(F.struct(F.col("quality").alias("from"), F.col("source").alias("to")), F.struct(F.col("source").alias("from"), ids.alias("to")))).alias("l")).select("l.*")
    return one.groupBy("from", "to").agg(F.count("*").alias("n")).withColumn("log2n", F.log2("n"))


def group_hierarchy(rows: DataFrame, group: str = "group", subgroup: str = "subgroup") -> DataFrame:
    named = rows.select(F.coalesce(F.nullif(group, F.lit("")), F.lit("Unknown")).alias("group"), F.coalesce(F.nullif(subgroup, F.lit("")), F.lit("Unknown")).alias("subgroup"))
    return named.rollup("group", "subgroup").agg(F.count("*").alias("n"))


def food_group_profile(triples: DataFrame, foods: DataFrame, groups: DataFrame, top: int = 5) -> DataFrame:
    """(food, group, n, total): distinct chemicals of each food by group, of the foods with most."""
    named = triples.join(foods.select(F.col("entity_id").alias("head"), F.split_part("name", F.lit(" - "), F.lit(1)).alias("food")), "head").join(groups.select(F.col("entity_id").alias("tail"), "group"), "tail").select("food", "tail", "group").distinct()
    best = named.groupBy("food").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "food").limit(top)
    return named.join(best, "food").groupBy("food", "group", "total").agg(F.count("*").alias("n"))


def known_unknown(hypotheses: DataFrame, kg: DataFrame, relation: str, end: str = "head") -> DataFrame:
    """(entity, unknown, known): for each entity of an end, its unknown pairs and the rest of the other end's entities."""
    other = "tail" if end == "head" else "head"
    total = kg.where(F.col("relation") == relation).agg(F.count_distinct(other).alias("all"))
    per = hypotheses.groupBy(F.col(end).alias("entity")).agg(F.count("*").alias("unknown"))
    return per.crossJoin(F.broadcast(total)).select("entity", "unknown", (F.col("all") - F.col("unknown")).alias("known"))  # one row


def known_unknown_counts(kg: DataFrame, relation: str, end: str = "head") -> DataFrame:
    """The rows of ``known_unknown`` over all unknown pairs of the relation, which are counted without being made: an entity's
    are the other end's entities less those that it is known with."""
    other = "tail" if end == "head" else "head"
    own = kg.where(F.col("relation") == relation).select(end, other).where(f"{end} is not null and {other} is not null").distinct()
    total = own.agg(F.count_distinct(other).alias("all"))
    per = own.groupBy(F.col(end).alias("entity")).agg(F.count("*").alias("known"))
    return per.crossJoin(F.broadcast(total)).select("entity", (F.col("all") - F.col("known")).alias("unknown"), "known").where("unknown > 0")  # one row


def mean_prob_entities(rows: DataFrame, end: str, prob: str = "prob", top: int = 5) -> DataFrame:
    return rows.groupBy(F.col(end).alias("entity")).agg(F.avg(prob).alias("mean_prob")).orderBy(F.desc(F.round("mean_prob", 9)), "entity").limit(top)


def weighted_triples(evidence: DataFrame) -> DataFrame:
    """(triples, weight, articles, per_article): triples weighed by their best probability, high quality as 1."""
    per = evidence.groupBy(*T).agg(F.max(F.when(F.col("quality") == "high", 1.0).otherwise(F.col("prob_mean"))).alias("w"))
    articles = evidence.agg(F.count_distinct("pmid").alias("articles"))
    return per.agg(F.count("*").alias("triples"), F.sum("w").alias("weight")).crossJoin(articles).withColumn("per_article", F.try_divide("weight", "articles"))


def scaled_estimates(evidence: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, articles, estimate): how many true triples a collection of so many articles would hold at the rate of the
    evidence's own articles. ``collections`` has (collection, articles)."""
    rate = weighted_triples(evidence).select("per_article")
    return collections.crossJoin(F.broadcast(rate)).select("collection", "articles", (F.col("per_article") * F.col("articles")).alias("estimate"))  # one row


def literature_counts(evidence: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return evidence.groupBy("source").agg(distinct(F.col("pmid")).alias("pmids"), distinct(F.struct(*T)).alias("triples"))


def citation_mix(rows: DataFrame, citation: str, kind: str, real: Column) -> tuple[DataFrame, DataFrame]:
    """Counts by citation and type, and the share that is literature."""
    return rows.groupBy(citation, kind).agg(F.count("*").alias("n")), rows.agg(F.avg(real.cast("double")).alias("share"))


def kg_statistics(kg: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(what, name, n): entities by kind, triples by relation, triples of heads with a part."""
    kinds = entities.groupBy(F.split_part("type", F.lit(":"), F.lit(1)).alias("name")).agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), "name", "n")
    by = kg.join(F.broadcast(relations.select(F.col("relation_id").alias("relation"), "name")), "relation").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("triples").alias("what"), "name", "n")
    parts = entities.where("type like 'organism_with_part%'").select(F.col("entity_id").alias("head"))
    part_level = kg.join(parts, "head", "left_semi").agg(F.count("*").alias("n")).select(F.lit("part_level").alias("what"), F.lit("triples").alias("name"), "n")
    return kinds.unionByName(by).unionByName(part_level)


def label_per_key(items: DataFrame, labels: DataFrame, key: str, absent: int = -2) -> DataFrame:
    """``items`` with the largest label of their key, ``absent`` if it has none."""
    return items.join(labels.groupBy(key).agg(F.max("label").alias("label")), key, "left").withColumn("label", F.coalesce("label", F.lit(absent)))


def papers_of_sets(rows: DataFrame, a: DataFrame, key: str = "key") -> DataFrame:
    """(only_b, in_both, shared): distinct papers behind keys only here, behind keys also in ``a``, and behind both."""
    flagged = rows.join(a.select(key).distinct().withColumn("in_a", F.lit(True)), key, "left").select(F.explode("papers").alias("p"), F.coalesce("in_a", F.lit(False)).alias("in_a"))
    per = flagged.groupBy("p").agg(F.bool_or("in_a").alias("x"), F.bool_or(~F.col("in_a")).alias("y"))
    return per.agg(F.count_if(F.col("y")).alias("only_b"), F.count_if(F.col("x")).alias("in_both"), F.count_if(F.col("x") & F.col("y")).alias("shared"))


def degree_centrality(kg: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, name, kind, degree): distinct neighbours in and out over the number of other nodes."""
    edges = kg.select("head", "tail").distinct()
    counts = edges.select(F.explode(F.array("head", "tail")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("c"))
    n = counts.agg((F.count("*") - 1).alias("others"))
    return counts.crossJoin(F.broadcast(n)).join(entities.select("entity_id", "name", F.split_part("type", F.lit(":"), F.lit(1)).alias("kind")), "entity_id").select("entity_id", "name", "kind", F.try_divide("c", "others").alias("degree"))


def decorate_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples with name, type, external ids and part of both ends and the relation's name."""
    out = triples
    for end in ("head", "tail"):
        out = out.join(entities.select(F.col("entity_id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("name", "type", "other_db_ids", "part_id"))), end, "left")
    return out.join(F.broadcast(relations.select(F.col("relation_id").alias("relation"), F.col("name").alias("relation_name"))), "relation", "left")


def food_subgraph(kg: DataFrame, entities: DataFrame, taxon: str, with_parts: bool = True) -> tuple[DataFrame, DataFrame]:
    """(triples, nodes) of the entities of one taxon, whole or with parts."""
    own = entities.where(F.array_contains(F.col("other_db_ids")["NCBI_taxonomy"], taxon))
    own = own if with_parts else own.where("part_id is null or part_id = 'p0'")
    triples = kg.join(own.select(F.col("entity_id").alias("head")), "head", "left_semi")
    return triples.select(*T), triples.select(F.explode(F.array("head", "tail")).alias("entity_id")).distinct()


def top_entities(triples: DataFrame, end: str, k: int) -> DataFrame:
    return triples.groupBy(F.col(end).alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(k)


def top_entity_subgraph(triples: DataFrame, heads: int = 5, tails: int = 3, floor: float = 0.01) -> DataFrame:
    """Edges that touch a most frequent head or tail; weights have a floor."""
    h, t = top_entities(triples, "head", heads), top_entities(triples, "tail", tails)
    joined = triples.join(h.select(F.col("entity").alias("head"), F.lit(1).alias("h")), "head", "left").join(t.select(F.col("entity").alias("tail"), F.lit(1).alias("t")), "tail", "left")
    return joined.where("h is not null or t is not null").select(*triples.columns).withColumn("prob", F.greatest("prob", F.lit(floor)))


def match_either_key(rows: DataFrame, cids: DataFrame, codes: DataFrame) -> DataFrame:
    """``rows`` (cid, code) with ``found``: the compound or its structure code is known."""
    a = cids.select("cid", F.lit(True).alias("__a")).distinct()
    b = codes.select("code", F.lit(True).alias("__b")).distinct()
    return rows.join(a, "cid", "left").join(b, "code", "left").select(*rows.columns, F.coalesce("__a", "__b", F.lit(False)).alias("found"))


def pairs_not_in(pairs: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.join(other.select(*keys).distinct(), keys, "left_anti").groupBy("quality").agg(F.count("*").alias("n"))


def evidence_order(rows: DataFrame) -> DataFrame:
    """Evidence once for each premise, hypothesis and MeSH id (rows without one all stay), best first."""
    keyed = rows.where("mesh_id is not null")
    rest = [c for c in rows.columns if c not in ("premise", "hypothesis", "mesh_id")]
    first = keyed.groupBy("premise", "hypothesis", "mesh_id").agg(F.min_by(F.struct(*rest), F.struct(_rank(), -F.coalesce("prob_mean", F.lit(0.0)), *T)).alias("r")).select("premise", "hypothesis", "mesh_id", "r.*").select(*rows.columns)
    return first.unionByName(rows.where("mesh_id is null")).orderBy(F.substring("tail", 2, 20).try_cast("bigint"), _rank(), F.desc("prob_mean"), *T)


def drop_phrases(rows: DataFrame, phrases: list[str], column: str = "hypothesis") -> DataFrame:
    bad = F.lit(False)
    for p in phrases:
        bad = bad | F.lower(column).contains(p.lower())
    return rows.where(~bad)


def without_phrases(rows: DataFrame, phrases: DataFrame, column: str = "hypothesis") -> DataFrame:
    """``rows`` without those whose text holds one of a table of phrases (its one column), whatever the case; nulls stay."""
    key = F.md5(F.lower(column))
    found = phrases_in_text(rows.where(F.col(column).isNotNull()).select(key.alias("key"), F.col(column).alias("text")).dropDuplicates(["key"]), phrases)
    marked = rows.withColumn("__key", key)
    return marked.join(found.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").select(*rows.columns)


def keep_last_by_prob(rows: DataFrame) -> DataFrame:
    """For each triple its row with the lowest probability."""
    rest = [c for c in rows.columns if c not in T]
    return rows.groupBy(*T).agg(F.min_by(F.struct(*rest), F.struct("prob", *[c for c in rest if c != "prob"])).alias("r")).select(*T, "r.*").select(*rows.columns)


def validated_hypotheses(rows: DataFrame) -> DataFrame:
    return rows.where("not coalesce(is_class, false) and validation = 'Yes'")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, with all columns; aggregated before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*rows.columns)
