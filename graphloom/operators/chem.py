"""Chemical identifiers: MeSH names and trees, compounds and registry numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions.text import compound_fields, merge_id_maps
from graphloom.operators.skew import product_by_key, spread
from graphloom.sources.written import stash


def mesh_id_to_name(ids: DataFrame, descriptors: DataFrame, supplements: DataFrame, column: str = "mesh_id") -> DataFrame:
    """``ids`` with ``mesh_name``; unknown ids get null, ids of another family than C or D fail."""
    family = F.substring(column, 1, 1)
    checked = F.when(family.isin("C", "D"), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("not a MeSH id: "), F.col(column))).cast("string"))
    names = descriptors.select(F.col("id").alias("__id"), F.col("name").alias("mesh_name")).unionByName(supplements.select(F.col("id").alias("__id"), F.col("name").alias("mesh_name")))
    return ids.withColumn("__id", F.when(F.col(column).isNotNull(), checked)).join(names, "__id", "left").drop("__id")


def mesh_to_compound(named: DataFrame, cid_names: DataFrame, how: str = "left") -> DataFrame:
    """``named`` (with ``mesh_name``) with each ``pubchem_id`` that has the very same name."""
    return named.join(cid_names.select("pubchem_id", "mesh_name").distinct(), "mesh_name", how)


def enrich_chemical(rows: DataFrame, compounds: DataFrame, predicted: bool = False) -> DataFrame:
    """Rows (``mesh_id``, ``mesh_name``, ``pubchem_id``, ``tail_names``) with the compound's ids.

    ``compounds`` has (pubchem_id, cas, mesh, synonyms). Without a MeSH name a row goes; without a compound it stays as
    it is. A compound that lists MeSH ids but not ours is passed over; predicted rows need a name in common.
    """
    known = rows.where("mesh_name is not null")
    joined = known.join(compounds, "pubchem_id", "left")
    other = (F.size(F.coalesce("mesh", F.array().cast("array<string>"))) > 0) & ~F.array_contains("mesh", F.col("mesh_id"))
    shared = F.arrays_overlap("tail_names", F.transform("synonyms", F.lower)) if predicted else F.lit(True)
    return joined.where(F.col("pubchem_id").isNull() | (~F.coalesce(other, F.lit(False)) & F.coalesce(shared, F.lit(False))))


def cas_to_compound(rows: DataFrame, compounds: DataFrame) -> DataFrame:
    """Rows (``tail_pubchem``, ``tail_cas``) with ``compound``: the PubChem id if known, else each of the CAS number's."""
    return _with_compounds(rows, cas_marked(rows, compounds), compounds)


def cas_marked(rows: DataFrame, compounds: DataFrame, counts: Observation | None = None) -> DataFrame:
    """``rows``, each once, with ``own`` (its PubChem id if known) and ``has_cas`` (true if its CAS number is known, else null).

    ``counts`` has, once they are computed, how many came, how many found a compound by id or by CAS number, and how many
    are to be dropped: those without either number, and those whose numbers nobody has.
    """
    known = compounds.select(F.col("pubchem_id").alias("tail_pubchem"), F.col("pubchem_id").alias("own")).distinct()
    listed = compounds.select(F.explode("cas").alias("tail_cas")).distinct().withColumn("has_cas", F.lit(True))
    marked = rows.join(known, "tail_pubchem", "left").join(listed, "tail_cas", "left").select(*rows.columns, "own", "has_cas")
    if counts is None:
        return marked
    named = F.col("tail_pubchem").isNotNull() | F.col("tail_cas").isNotNull()
    lost = F.col("own").isNull() & F.col("has_cas").isNull()
    return marked.observe(
        counts,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("own").isNotNull()).alias("by_id"),
        F.count_if(F.col("own").isNull() & F.col("has_cas").isNotNull()).alias("by_cas"),
        F.count_if(lost & ~named).alias("without_number"),
        F.count_if(lost & named).alias("unknown_number"),
    )


def _with_compounds(rows: DataFrame, marked: DataFrame, compounds: DataFrame) -> DataFrame:
    """Marked rows with each ``compound`` of theirs. A CAS number may have many rows and many compounds."""
    marked = stash(marked, "marked")
    by_cas = compounds.select(F.explode("cas").alias("tail_cas"), F.col("pubchem_id").alias("compound")).distinct()
    direct = marked.where("own is not null").select(*rows.columns, F.col("own").alias("compound"))
    return direct.unionByName(product_by_key(marked.where("own is null and has_cas").select(*rows.columns), by_cas, "tail_cas", "compound"))


def cas_to_compound_counted(rows: DataFrame, compounds: DataFrame, counts: Observation) -> DataFrame:
    """The rows of ``cas_to_compound``; ``counts`` has, once they are computed, how many came, how many found a compound by id or
    by CAS number, and how many were dropped: those without either number, and those whose numbers nobody has.

    The counts are taken where rows are marked, before they meet compounds; a dropped row is one that no compound was
    found for.
    """
    return _with_compounds(rows, cas_marked(rows, compounds, counts), compounds)


def tree_lineage_pairs(ids: DataFrame, descriptors: DataFrame, supplements: DataFrame) -> DataFrame:
    """Distinct (child, parent) ids along every tree number of the given ids; supplements first step to their headings."""
    hops = ids.join(supplements.select(F.col("id").alias("mesh_id"), F.explode("heading_ids").alias("heading")), "mesh_id")
    start = ids.select("mesh_id").unionByName(hops.select(F.col("heading").alias("mesh_id"))).distinct()
    numbers = descriptors.select(F.explode("tree_numbers").alias("tree_number"), F.col("id"))
    own = start.join(numbers, F.col("mesh_id") == F.col("id")).select("tree_number")
    parts = F.split("tree_number", r"\.")
    steps = own.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("child"), F.array_join(F.slice(parts, 1, k - 1), ".").alias("parent")))).alias("s")).select("s.*").distinct()
    child = numbers.select(F.col("tree_number").alias("child"), F.col("id").alias("child_id"))
    parent = numbers.select(F.col("tree_number").alias("parent"), F.col("id").alias("parent_id"))
    return steps.join(child, "child").join(parent, "parent").select("child_id", "parent_id").unionByName(hops.select(F.col("mesh_id").alias("child_id"), F.col("heading").alias("parent_id"))).distinct()


def ontology_triples(pairs: DataFrame, id_compounds: DataFrame) -> DataFrame:
    """isA triples between the compounds of both ends; ``id_compounds`` has (mesh_id, pubchem_id).

    Heads with the same set of parents have the same tails. These are made distinct once for each set, and heads meet them
    by lists, so that triples are distinct as they are made and never shuffled.
    """
    ids = id_compounds.distinct()
    child = ids.select(F.col("mesh_id").alias("child_id"), F.coalesce("pubchem_id", "mesh_id").alias("head"))
    parent = ids.select(F.col("mesh_id").alias("parent_id"), F.coalesce("pubchem_id", "mesh_id").alias("tail"))
    above = pairs.join(parent.select("parent_id").distinct(), "parent_id", "left_semi").join(child, "child_id")
    sets = stash(above.groupBy("head").agg(F.array_sort(F.collect_set("parent_id")).alias("parents")).withColumn("set", F.sha2(F.to_json("parents"), 256)), "parents")
    tails = sets.dropDuplicates(["set"]).select("set", F.explode("parents").alias("parent_id")).join(parent, "parent_id").select("set", "tail").distinct()
    joined = product_by_key(sets.select("head", "set"), stash(tails, "tails"), "set", "tail")
    return joined.select("head", F.lit("isA").alias("relation"), "tail", F.lit("MeSH").alias("source"), F.lit("medium").alias("quality"))


def mesh_tree_backfill(entities: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Chemicals with a D-id get the tree numbers of all their ids under ``MESH_tree``."""
    ids = entities.select("entity_id", F.explode(F.col("other_db_ids")["MESH"]).alias("id")).where("id like 'D%'")
    trees = ids.join(descriptors.select("id", "tree_numbers"), "id").groupBy("entity_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tree_numbers")))).alias("trees"))
    merged = merge_id_maps(F.col("other_db_ids"), F.create_map(F.lit("MESH_tree"), F.col("trees")))
    return entities.join(trees, "entity_id", "left").withColumn("other_db_ids", F.when(F.size("trees") > 0, merged).otherwise(F.col("other_db_ids"))).select(*entities.columns)


def chemical_identifiers(entities: DataFrame, compound_json: DataFrame) -> DataFrame:
    """(entity_id, InChI, InChIKey, SMILES) of chemicals; one row each, nulls without a compound."""
    fields = compound_fields(F.col("json"))
    compounds = spread(compound_json).select("cid", *(fields[k].alias(k) for k in ("inchi", "inchikey", "smiles")))
    ids = entities.where(F.split_part("type", F.lit(":"), F.lit(1)) == "chemical").select("entity_id", F.explode_outer(F.col("other_db_ids")["PubChem"]).alias("cid"))
    joined = ids.join(compounds, "cid", "left")
    all_ = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return joined.groupBy("entity_id").agg(all_("inchi"), all_("inchikey"), all_("smiles"))
