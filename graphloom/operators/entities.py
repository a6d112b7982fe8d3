"""Entities and triples of the graph: duplicates, merging, stable ids, resolution and appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import numeric_id, triple_key
from graphloom.operators.annotate import numbered
from graphloom.operators.components import connected_components
from graphloom.sources.written import stash


def entity_keys(kind: Column, ids: Column, part: Column) -> Column:
    """The keys that make entities the same: organisms by taxon and part; chemicals by compound, or else by MeSH id."""
    none = F.array().cast("array<string>")
    taxa = F.transform(F.coalesce(ids["NCBI_taxonomy"], none), lambda t: F.concat(F.lit("O:"), t, F.lit("-"), F.coalesce(part, F.lit("p0"))))
    compounds = F.transform(F.coalesce(ids["PubChem"], none), lambda c: F.concat(F.lit("P:"), c))
    mesh = F.transform(F.coalesce(ids["MESH"], none), lambda m: F.concat(F.lit("M:"), m))
    return F.when(kind.startswith("organism"), taxa).when(F.size(compounds) > 0, compounds).otherwise(mesh)


def duplicate_components(rows: DataFrame, row_id: str = "row_id", keys: str = "keys") -> DataFrame:
    """(row_id, component): rows that share a key, directly or through others; the component is its smallest row id.

    Keys are the nodes, and only rows with several keys are edges, so that rows with one key need a grouping alone.
    """
    listed = rows.select(F.col(row_id).alias("row_id"), F.array_sort(F.array_distinct(keys)).alias("keys"))
    edges = listed.where("size(keys) > 1").select(F.explode(F.slice("keys", 2, F.size("keys") - 1)).alias("a"), F.get("keys", F.lit(0)).alias("b"))
    linked = connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("chief"))
    # A row's keys are all in one group: its first stands for them.
    placed = listed.select("row_id", F.get("keys", F.lit(0)).alias("key")).join(linked, "key", "left").select("row_id", F.coalesce("chief", "key").alias("group"))
    least = placed.where("group is not null").groupBy("group").agg(F.min("row_id").alias("component"))
    return placed.join(least, "group", "left").select("row_id", F.coalesce("component", "row_id").alias("component"))


def merge_entities(stored: DataFrame, candidates: DataFrame, retired_max: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, retired, mapping) after candidates and stored entities with a common key became one.

    The smallest stored id survives; the name is the surviving row's, else the first by name and synonyms; synonyms are
    unique but for case, in the smallest spelling; ids are united. Other stored ids retire as merged. New rows get ids
    after all that were ever used (``retired_max``: the largest retired number), untouched ones first.
    """
    shape = ["type", "name", "synonyms", "other_db_ids", "part_id"]
    named = candidates.select(*shape).withColumn("synonyms", F.array_union("synonyms", F.array("name"))).withColumn("entity_id", F.lit(None).cast("string"))
    named = named.withColumn("other_db_ids", F.map_from_entries(F.array_sort(F.map_entries("other_db_ids"))))
    text = F.to_json(F.struct("type", "name", F.array_sort("synonyms").alias("synonyms"), "other_db_ids", "part_id"))
    rows = stored.select("entity_id", *shape).unionByName(named.select("entity_id", *shape)).withColumn("row_id", F.coalesce("entity_id", F.concat(F.lit("new:"), F.md5(text))))
    rows = stash(rows.withColumn("keys", entity_keys(F.col("type"), F.col("other_db_ids"), F.col("part_id"))).dropDuplicates(["row_id"]), "rows")
    grouped = stash(rows.join(duplicate_components(rows), "row_id"), "grouped")
    number = numeric_id(F.col("entity_id"))
    order = F.struct(number.isNull(), number, F.col("name"), F.array_sort("synonyms"))
    core = grouped.groupBy("component").agg(F.min_by("entity_id", F.struct(number.isNull(), number)).alias("entity_id"), F.min_by("type", order).alias("type"), F.min_by("name", order).alias("name"), F.min("part_id").alias("part_id"), F.count("*").alias("members"), F.min(order).alias("order"))
    spelled = grouped.select("component", F.explode("synonyms").alias("s")).groupBy("component", F.lower("s").alias("low")).agg(F.min("s").alias("s"))
    names = spelled.groupBy("component").agg(F.array_sort(F.collect_list("s")).alias("synonyms"))
    listed = grouped.select("component", F.explode("other_db_ids").alias("k", "v")).select("component", "k", F.explode("v").alias("v"))
    united = listed.groupBy("component", "k").agg(F.array_sort(F.collect_set("v")).alias("v"))
    ids = united.groupBy("component").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("other_db_ids"))
    merged = stash(core.join(names, "component", "left").join(ids, "component", "left"), "merged")
    top = stored.agg(F.max(numeric_id(F.col("entity_id")))).first()[0] or 0
    fresh = assign_ids(merged.where("entity_id is null").drop("entity_id"), ["members > 1", "order.name", "component"], max(top, retired_max) + 1)
    entities = merged.where("entity_id is not null").select("component", "entity_id", *shape).unionByName(fresh.select("component", "entity_id", *shape))
    mapping = grouped.where("entity_id is not null").select(F.col("entity_id").alias("old_id"), "component").join(entities.select("component", F.col("entity_id").alias("new_id")), "component").where("old_id <> new_id").select("old_id", "new_id")
    retired = stored.join(mapping.withColumnRenamed("old_id", "entity_id"), "entity_id").select("entity_id", *shape, F.concat(F.lit("Merged to "), "new_id").alias("reason"))
    return entities.drop("component"), retired, mapping


def assign_ids(rows: DataFrame, order: list, first: int, prefix: str = "e", name: str = "entity_id") -> DataFrame:
    """Consecutive ids from ``first`` in a deterministic order, without one global window."""
    return numbered(rows, order, "__n", first).withColumn(name, F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")


def survivor_id(rows: DataFrame, group: str, entity_id: str = "entity_id") -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(entity_id, numeric_id(F.col(entity_id))).alias(entity_id))


def rewire_triples(rows: DataFrame, mapping: DataFrame, distinct: bool = True) -> DataFrame:
    """Triples or evidence with merged ids replaced and the triple's text made anew."""
    out = rows
    for end in ("head", "tail"):
        out = out.join(mapping.select(F.col("old_id").alias(end), F.col("new_id").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    if "triple" in rows.columns:
        out = out.withColumn("triple", triple_key(F.col("head"), F.col("relation"), F.col("tail")))
    out = out.select(*rows.columns)
    return out.distinct() if distinct else out


def resolve_candidates(candidates: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidate triples (``head_key``, ``relation_name``, ``tail_key``) with stored ids; each must match exactly one."""
    keyed = entities.select("entity_id", F.explode(entity_keys(F.col("type"), F.col("other_db_ids"), F.col("part_id"))).alias("key")).distinct()
    unique = keyed.groupBy("key").agg(F.min("entity_id").alias("id"), F.count("*").alias("n"))
    out = candidates
    for end in ("head", "tail"):
        out = out.join(unique.select(F.col("key").alias(f"{end}_key"), F.col("id").alias(end), F.col("n").alias(f"{end}_n")), f"{end}_key", "left")
        bad = F.coalesce(F.col(f"{end}_n"), F.lit(0)) != 1
        out = out.withColumn(end, F.when(bad, F.raise_error(F.concat(F.lit("not one match: "), F.col(f"{end}_key"))).cast("string")).otherwise(F.col(end))).drop(f"{end}_n")
    return out.join(relations.select(F.col("relation_id").alias("relation"), F.col("name").alias("relation_name")), "relation_name")


def row_mark(columns: list[str]) -> Column:
    """A digest of a row's cells, nulls among them: rows are equal if their marks are."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def new_rows(kg: DataFrame, evidence: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, evidence) of ``new`` that the tables lack, the evidence with its mark in ``row_mark``.

    Stored evidence that holds a column ``row_mark`` is not hashed again: that column alone is read of it. Missing
    columns of ``new`` are null.
    """
    columns = [c for c in evidence.columns if c != "row_mark"]
    full = new.withColumn("triple", triple_key(F.col("head"), F.col("relation"), F.col("tail")))
    full = evidence.select(*columns).limit(0).unionByName(full.select(*(c for c in full.columns if c in columns)), allowMissingColumns=True)
    # Rows are dealt by their marks once, and made distinct and compared there; the key, which the ends tell, is left behind.
    whole = full.withColumns({c: F.col(c) + F.lit(0.0) for c, t in full.dtypes if t == "double"})  # as equal rows, -0.0 is 0.0
    dealt = whole.withColumn("__mark", F.unhex(row_mark(columns))).drop("triple").repartition("__mark").distinct()
    marks = evidence.select(F.unhex(F.col("row_mark") if "row_mark" in evidence.columns else row_mark(columns)).alias("__mark"))
    keyed = dealt.join(marks, "__mark", "left_anti").withColumn("triple", triple_key(F.col("head"), F.col("relation"), F.col("tail")))
    fresh = keyed.select(*columns, F.lower(F.hex("__mark")).alias("row_mark"))
    known = kg.select(*(F.col(c).alias(f"own_{c}") for c in ("head", "relation", "tail")))
    same = F.col("head").eqNullSafe(F.col("own_head")) & F.col("relation").eqNullSafe(F.col("own_relation")) & F.col("tail").eqNullSafe(F.col("own_tail"))
    triples = full.select("head", "relation", "tail").distinct().join(known, same, "left_anti")
    return triples, fresh


def append_triples(kg: DataFrame, evidence: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kg, evidence) with new evidence rows: triples unique, evidence unique over all its columns (nulls are equal).

    Only a digest of each row is compared, so that long premises travel once.
    """
    triples, fresh = new_rows(kg, evidence, new)
    return kg.unionByName(triples), evidence.unionByName(fresh.select(*evidence.columns))


def add_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """``relations`` and the new ones of ``names`` (name, translation), with the next ids; translations must agree."""
    clash = names.join(relations.select("name", F.col("translation").alias("old")), "name").where("not (translation <=> old)")
    if not clash.isEmpty():
        raise ValueError("a relation's translation differs")
    top = relations.agg(F.max(numeric_id(F.col("relation_id")))).first()[0]
    fresh = names.dropDuplicates(["name"]).join(relations, "name", "left_anti")
    return relations.unionByName(assign_ids(fresh, ["name"], 0 if top is None else top + 1, "r", "relation_id").select(*relations.columns))


def overwrite_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities with the non-null fields of ``changes`` (entity_id, type, name, synonyms, other_db_ids).

    A replaced name stays as a synonym; an entity with a part gets it after the new name.
    """
    new = changes.select("entity_id", *(F.col(c).alias(f"new_{c}") for c in ("type", "name", "synonyms", "other_db_ids")))
    joined = entities.join(new, "entity_id", "left")
    part = F.get(F.split("name", " - "), F.lit(1))
    name = F.when(F.col("new_name").isNull(), F.col("name")).when(F.col("type").startswith("organism_with_part") & part.isNotNull() & ~F.col("new_name").contains(" - "), F.concat("new_name", F.lit(" - "), part)).otherwise(F.col("new_name"))
    synonyms = F.array_sort(F.array_union(F.coalesce("new_synonyms", "synonyms"), F.when(F.col("new_name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))))
    return joined.select("entity_id", F.coalesce("new_type", "type").alias("type"), name.alias("name"), synonyms.alias("synonyms"), F.coalesce("new_other_db_ids", "other_db_ids").alias("other_db_ids"), "part_id")


def triples_by_relation(kg: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    ids = relations.where(F.col("name") == name).select(F.col("relation_id").alias("relation"))
    return kg.join(ids, "relation", "left_semi").select(*kg.columns)


def entities_by_type(entities: DataFrame, exact: str | None = None, prefix: str | None = None) -> DataFrame:
    test = F.lit(False)
    if exact is not None:
        test = test | (F.col("type") == exact)
    if prefix is not None:
        test = test | F.col("type").startswith(prefix)
    return entities.where(test)


def exactly_one(rows: DataFrame, column: str, value: str):
    """The one row with a value; none or several are an error."""
    found = rows.where(F.col(column) == value).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{len(found)} rows with {column} = {value}")
    return found[0]


def entities_by_external_id(entities: DataFrame, ids: dict[str, list[str]], member: bool = False) -> DataFrame:
    """Entities whose id map holds all given items: equal lists, or lists that contain each id (``member``)."""
    test = F.lit(True)
    for key, values in ids.items():
        own = F.col("other_db_ids")[key]
        if member:
            for v in values:
                test = test & F.coalesce(F.array_contains(own, v), F.lit(False))
        else:
            test = test & F.coalesce(own == F.array(*map(F.lit, values)), F.lit(False))
    return entities.where(test)


def admit_annotated(rows: DataFrame) -> DataFrame:
    return rows.where("answer = 'Entails'").withColumns({"source": F.lit("annotation"), "quality": F.lit("high"), "title": F.lit(None).cast("string")})


def admit_predicted(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return rows.where(F.col("prob_mean") > threshold).withColumns({"source": F.lit("prediction:entailment"), "quality": F.lit("medium"), "title": F.lit(None).cast("string")})


def haspart_triples(rows: DataFrame) -> DataFrame:
    """Rows (``head_type``, ``head_name``, ``tax_id``, ``part_id``…) and, for heads with a part, "whole hasPart part"."""
    parts = rows.where("head_type = 'organism_with_part'")
    derived = parts.withColumns({"tail_name": F.col("head_name"), "tail_part": F.col("part_id"), "head_name": F.split_part("head_name", F.lit(" - "), F.lit(1)), "head_type": F.lit("organism"), "part_id": F.lit("p0"), "relation": F.lit("hasPart")})
    return rows.withColumns({"relation": F.lit("contains"), "tail_part": F.lit(None).cast("string")}).unionByName(derived)
