"""The published tables: names, synonyms, groups and flags of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import kind


def _none():
    return F.array().cast("array<string>")


def with_keys(entities: DataFrame) -> DataFrame:
    """Entities with their kind, first taxon, compound and MeSH id."""
    first = lambda key: F.get(F.col("other_db_ids")[key], F.lit(0))
    return entities.withColumns({"kind": kind(F.col("type")), "tax_id": first("NCBI_taxonomy"), "cid": first("PubChem"), "mesh_id": first("MESH")})


def all_synonyms(entities: DataFrame, mesh_terms: DataFrame, compound_synonyms: DataFrame, tax_names: DataFrame, part_names: DataFrame) -> DataFrame:
    """(entity_id, synonyms): terms of ontology, compounds and taxonomy; a part's name follows each of its food's."""
    base = with_keys(entities)
    joined = base.join(mesh_terms.select(F.col("id").alias("mesh_id"), "terms"), "mesh_id", "left").join(compound_synonyms.select("cid", F.col("synonyms").alias("given")), "cid", "left")
    joined = joined.join(tax_names.select("tax_id", "names"), "tax_id", "left").join(part_names.select("part_id", "food_part"), "part_id", "left")
    food = F.when(F.col("kind") == "organism_with_part", F.transform(F.coalesce("names", _none()), lambda x: F.concat(x, F.lit(" - "), "food_part"))).otherwise(F.coalesce("names", _none()))
    found = F.when(F.col("kind") == "chemical", F.concat(F.coalesce("given", _none()), F.coalesce("terms", _none()))).otherwise(food)
    return joined.select("entity_id", F.array_sort(F.array_distinct(found)).alias("synonyms"))


def final_names(entities: DataFrame, compound_names: DataFrame, mesh_names: DataFrame, scientific: DataFrame, part_names: DataFrame) -> DataFrame:
    """(entity_id, name): the compound's or else the MeSH name; the scientific name, with the part; else the name it has."""
    joined = with_keys(entities).join(compound_names.select("cid", F.col("name").alias("compound_name")), "cid", "left").join(mesh_names.select(F.col("id").alias("mesh_id"), F.col("name").alias("mesh_name")), "mesh_id", "left")
    joined = joined.join(scientific.select("tax_id", F.col("name_txt").alias("taxon")), "tax_id", "left").join(part_names.select("part_id", "food_part"), "part_id", "left")
    organism = F.when(F.col("kind") == "organism_with_part", F.concat("taxon", F.lit(" - "), "food_part")).otherwise(F.col("taxon"))
    new = F.when(F.col("kind") == "chemical", F.when(F.col("cid").isNotNull(), F.col("compound_name")).otherwise(F.col("mesh_name"))).otherwise(organism)
    return joined.select("entity_id", F.coalesce(new, "name").alias("name"))


def attach_groups(entities: DataFrame, tree: DataFrame, taxon_groups: DataFrame) -> DataFrame:
    """(entity_id, group, subgroup): names of the first one and two levels of MeSH trees, or a taxon's; else Unknown."""
    base = with_keys(entities)
    numbers = base.select("entity_id", F.explode_outer(F.coalesce(F.col("other_db_ids")["MESH_tree"], _none())).alias("t"))
    levels = numbers.select("entity_id", F.split_part("t", F.lit("."), F.lit(1)).alias("root"), F.array_join(F.slice(F.split("t", r"\."), 1, 2), ".").alias("two"))
    names = tree.select("tree_number", "name")
    named = levels.join(names.select(F.col("tree_number").alias("root"), F.col("name").alias("g")), "root", "left").join(names.select(F.col("tree_number").alias("two"), F.col("name").alias("s")), "two", "left")
    chemical = named.groupBy("entity_id").agg(F.min("g").alias("cg"), F.min("s").alias("cs"))
    joined = base.join(chemical, "entity_id", "left").join(taxon_groups.select("tax_id", F.col("group").alias("tg"), F.col("subgroup").alias("ts")), "tax_id", "left")
    is_chemical = F.col("kind") == "chemical"
    return joined.select("entity_id", F.coalesce(F.when(is_chemical, F.col("cg")).otherwise(F.col("tg")), F.lit("Unknown")).alias("group"), F.coalesce(F.when(is_chemical, F.col("cs")).otherwise(F.col("ts")), F.lit("Unknown")).alias("subgroup"))


def membership_flags(entities: DataFrame, kg: DataFrame, contains: str) -> DataFrame:
    """(entity_id, is_food, is_contains): does it stand at the head or the tail of a contains triple?"""
    own = kg.where(F.col("relation") == contains)
    heads = own.select(F.col("head").alias("entity_id"), F.lit(True).alias("h")).distinct()
    tails = own.select(F.col("tail").alias("entity_id"), F.lit(True).alias("t")).distinct()
    return entities.select("entity_id").join(heads, "entity_id", "left").join(tails, "entity_id", "left").select("entity_id", F.col("h").isNotNull().alias("is_food"), F.col("t").isNotNull().alias("is_contains"))


def name_text(entities: DataFrame, names: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(entity_id, short_name, long_name): common names joined, the part after each; a doubled short name is replaced
    by the long one, which has the first description after it. ``names`` has (entity_id, names)."""
    joined = entities.join(names, "entity_id", "left").join(descriptions, "entity_id", "left")
    part = F.get(F.split("name", " - "), F.lit(1))
    listed = F.when(part.isNotNull(), F.transform("names", lambda n: F.concat(n, F.lit(" "), part))).otherwise(F.col("names"))
    short = F.coalesce(F.when(F.size("names") > 0, F.array_join(listed, " ")), F.regexp_replace("name", " - ", " "))
    base = joined.select("entity_id", short.alias("short_name"), F.get("descriptions", F.lit(0)).alias("d")).withColumn("long_name", F.concat_ws(" ", "short_name", "d"))
    twice = base.groupBy("short_name").agg(F.count("*").alias("n"))
    return base.join(twice, "short_name").select("entity_id", F.when(F.col("n") > 1, F.col("long_name")).otherwise(F.col("short_name")).alias("short_name"), "long_name")
