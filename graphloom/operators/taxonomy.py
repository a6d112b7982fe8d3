"""Taxonomy: names by class, entities of taxa and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names_by_class(names: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(tax_id, name_class, names): sorted; of the given classes only."""
    some = names.where(F.col("name_class").isin(classes)) if classes else names
    return some.groupBy("tax_id", "name_class").agg(F.array_sort(F.collect_set("name_txt")).alias("names"))


def taxonomy_entities(taxa: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(tax_id, rank, name, synonyms) of the given taxa: one scientific name each, all other names as synonyms."""
    own = names.join(taxa.select("tax_id").distinct(), "tax_id", "left_semi")
    scientific = F.col("name_class") == "scientific name"
    per = own.groupBy("tax_id").agg(F.count_if(scientific).alias("n"), F.min(F.when(scientific, F.col("name_txt"))).alias("name"), F.array_sort(F.collect_set(F.when(~scientific, F.col("name_txt")))).alias("synonyms"))
    checked = F.when(F.col("n") == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not one scientific name: "), "tax_id")).cast("string"))
    return taxa.select("tax_id").distinct().join(nodes.select("tax_id", "rank"), "tax_id", "left").join(per, "tax_id").select("tax_id", "rank", checked.alias("name"), "synonyms")


def typed_by_rank(entities: DataFrame, ranks: DataFrame) -> DataFrame:
    """Organisms get the rank of their taxon after their kind; a second run changes nothing."""
    kind = F.split_part("type", F.lit(":"), F.lit(1))
    joined = entities.withColumn("tax_id", F.get(F.col("other_db_ids")["NCBI_taxonomy"], F.lit(0))).join(ranks.select("tax_id", "rank"), "tax_id", "left")
    return joined.withColumn("type", F.when(kind.startswith("organism") & F.col("rank").isNotNull(), F.concat(kind, F.lit(":"), "rank")).otherwise(F.col("type"))).select(*entities.columns)


def lineage_pairs(lineages: DataFrame) -> DataFrame:
    """Distinct (parent, child) along lineages (tax_id, lineage: ancestors from the root)."""
    path = F.concat("lineage", F.array("tax_id"))
    n = F.size(path)
    pairs = F.arrays_zip(F.slice(path, F.lit(1), n - 1).alias("parent"), F.slice(path, F.lit(2), n - 1).alias("child"))
    return lineages.where(n > 1).select(F.explode(pairs).alias("p")).select("p.parent", "p.child").distinct()


def haschild_triples(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("parent").alias("head"), F.lit("hasChild").alias("relation"), F.col("child").alias("tail"), F.lit("NCBI_taxonomy").alias("source"), F.lit("medium").alias("quality"))
