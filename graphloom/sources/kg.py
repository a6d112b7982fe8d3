"""Readers and writers of the knowledge graph's tables and of the inputs it is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import numeric_id
from graphloom.operators.annotate import sample_fraction

TRIPLE = "head string, relation string, tail string"
EVIDENCE = f"{TRIPLE}, triple string, pmid string, pmcid string, title string, section string, premise string, hypothesis string, source string, quality string, prob_mean double, prob_std double"
ENTITIES = "entity_id string, type string, name string, synonyms array<string>, other_db_ids map<string,array<string>>, part_id string"
RELATIONS = "relation_id string, name string, translation string"
RETIRED = f"{ENTITIES}, reason string"
TABLES = {"kg": TRIPLE, "evidence": EVIDENCE, "entities": ENTITIES, "relations": RELATIONS, "retired_entities": RETIRED}
#: Each table's id column, by whose number it is written.
ORDER = {"entities": "entity_id", "relations": "relation_id", "retired_entities": "entity_id"}
ID_KEYS = ["NCBI_taxonomy", "PubChem", "MESH", "CAS", "InChI", "InChIKey", "canonical_SMILES", "MESH_tree"]


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def check_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    if set(df.columns) != set(expected):
        raise ValueError(f"columns {sorted(df.columns)} are not {sorted(expected)}")
    return df.select(*expected)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_kg(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the graph's five tables in Parquet; a missing one is empty, wrong columns are an error."""
    path, schema = f"{folder}/{name}", TABLES[name]
    empty = spark.createDataFrame([], schema)
    return check_columns(spark.read.parquet(path), empty.columns) if exists(spark, path) else empty


def write_kg(folder: str, **tables: DataFrame) -> None:
    """Write tables; those with ids in the order of the ids' numbers."""
    for name, df in tables.items():
        key = ORDER.get(name)
        (df.orderBy(numeric_id(F.col(key))) if key else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_legacy_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV of the older text form: all cells are text, blanks are null."""
    return blank_to_null(spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(path))


#: What the JSON reader must allow to read Python's texts: single quotes, and a backslash before any character.
_LITERAL = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _escapes(cell: Column) -> Column:
    """A literal with its two-digit escapes as JSON has them; blank cells are null."""
    return F.nullif(F.regexp_replace(cell, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2"), F.lit(""))


def decode_list(cell: Column, legacy: bool = False) -> Column:
    """A list of texts from JSON, or (``legacy``) from a Python literal of texts; nothing is evaluated."""
    return F.from_json(_escapes(cell), "array<string>", _LITERAL) if legacy else F.from_json(cell, "array<string>")


def decode_ids(cell: Column, legacy: bool = False) -> Column:
    """A map of lists of texts, likewise."""
    return F.from_json(_escapes(cell), "map<string,array<string>>", _LITERAL) if legacy else F.from_json(cell, "map<string,array<string>>")


def literal_text(column: Column) -> Column:
    """A list or map of lists of texts in the older text form: a Python literal with single quotes, escaped where needed."""
    quoted = lambda x: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(column, quoted), ", "), F.lit("]"))


def literal_map(column: Column) -> Column:
    entry = lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), literal_text(e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(column), entry), ", "), F.lit("}"))


def read_legacy_kg(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the five tables of an older text folder (``kg.txt``, ``evidence.txt``, …) in today's types.

    Lists and maps of the text form are decoded, blanks become null, probabilities become numbers. The id column may have
    another name, and an organism's part may stand in its map of ids under a key that ends in ``part_id``. A missing file
    is an empty table; wrong columns are an error.
    """
    path, schema = f"{folder}/{name}.txt", TABLES[name]
    columns = spark.createDataFrame([], schema).columns
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = read_legacy_tsv(spark, path)
    others = [c for c in raw.columns if c not in columns]
    if ORDER.get(name) and ORDER[name] not in raw.columns and len(others) == 1:
        raw = raw.withColumnRenamed(others[0], ORDER[name])
    if "other_db_ids" in raw.columns:
        scalar = F.regexp_replace("other_db_ids", r"('[^']*'): ('[^']*')", "$1: [$2]")  # a single id may stand without a list
        raw = raw.withColumns({"other_db_ids": decode_ids(scalar, True), "synonyms": decode_list(F.col("synonyms"), True)})
        own = F.map_filter("other_db_ids", lambda k, _: k.endswith("part_id"))
        part = F.get(F.get(F.map_values(own), F.lit(0)), F.lit(0))
        raw = raw.withColumn("part_id", F.coalesce("part_id", part) if "part_id" in raw.columns else part)
        raw = raw.withColumn("other_db_ids", F.map_filter("other_db_ids", lambda k, _: ~k.endswith("part_id")))
    checked = check_columns(raw, columns)
    return checked.select(*(F.col(c).try_cast("double").alias(c) if c in ("prob_mean", "prob_std") else F.col(c) for c in columns))


def write_legacy_kg(folder: str, id_name: str = "entity_id", part_key: str = "part_id", **tables: DataFrame) -> None:
    """Tables in the older text form: TSV named like the table, ids in the order of their numbers under ``id_name``, an
    organism's part in its map of ids under ``part_key``."""
    for name, df in tables.items():
        out, key = df, ORDER.get(name)
        if "other_db_ids" in df.columns:
            own = F.map_concat("other_db_ids", F.create_map(F.lit(part_key), F.array("part_id")))
            ids = F.when(F.col("part_id").isNull(), F.col("other_db_ids")).otherwise(own)
            texts = {"synonyms": literal_text(F.col("synonyms")), "other_db_ids": literal_map(ids)}
            out = out.select(*(texts[c].alias(c) if c in texts else F.col(c) for c in df.columns if c != "part_id"))
        if key:
            out = out.orderBy(numeric_id(F.col(key))).withColumnRenamed(key, id_name)
        writer = out.write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"')
        writer.option("emptyValue", "").option("nullValue", "").csv(f"{folder}/{name}.txt")


def read_taxdump(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``nodes``, ``names`` or ``lineage`` of a taxonomy dump, whose fields stand between ``\\t|\\t``."""
    return parse_taxdump(spark.read.text(path), kind)


def parse_taxdump(lines: DataFrame, kind: str) -> DataFrame:
    fields = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    columns = {"nodes": ["tax_id", "parent_tax_id", "rank"], "names": ["tax_id", "name_txt", "unique_name", "name_class"], "lineage": ["tax_id", "lineage"]}[kind]
    out = lines.select(*(F.trim(F.get(fields, F.lit(i))).alias(c) for i, c in enumerate(columns)))
    return out.withColumn("lineage", F.filter(F.split("lineage", " "), lambda x: x != "")) if kind == "lineage" else out


HITS = "array<struct<pmid:string,pmcid:string,section:string,text:string,annotations:array<string>,score:double>>"


def read_search_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_search_json(spark.read.text(path, wholetext=True))


def parse_search_json(files: DataFrame) -> DataFrame:
    """One row a hit of files that hold a query line and a line with a JSON array."""
    lines = files.select(F.split_part("value", F.lit("\n"), F.lit(1)).alias("search_term"), F.split_part("value", F.lit("\n"), F.lit(2)).alias("hits"))
    # The query line is cut off once a file: beside the hits, it would be cut from the whole text for each of them.
    return lines.select("search_term", F.explode(F.from_json("hits", HITS)).alias("h")).select("search_term", "h.*")


def parse_cid_names(lines: DataFrame) -> DataFrame:
    """(pubchem_id, mesh_name) of ragged lines: an id, then any number of names."""
    parts = F.split("value", "\t")
    return lines.select(F.get(parts, F.lit(0)).alias("pubchem_id"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("mesh_name")).where("mesh_name <> ''")


def read_mesh_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, tree_numbers, terms) of an XML file of descriptor records."""
    schema = "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(schema).load(path)
    terms = F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    return raw.select(F.col("DescriptorUI").alias("id"), F.col("DescriptorName.String").alias("name"), F.coalesce("TreeNumberList.TreeNumber", F.array().cast("array<string>")).alias("tree_numbers"), terms.alias("terms"))


def read_mesh_supplements(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, heading_ids, terms) of supplementary records; headings lose their star."""
    schema = "SupplementalRecordUI string, SupplementalRecordName struct<String:string>, HeadingMappedToList struct<HeadingMappedTo:array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>>, ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
    raw = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(schema).load(path)
    heads = F.transform("HeadingMappedToList.HeadingMappedTo", lambda h: F.ltrim(h["DescriptorReferredTo"]["DescriptorUI"], F.lit("*")))
    terms = F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    return raw.select(F.col("SupplementalRecordUI").alias("id"), F.col("SupplementalRecordName.String").alias("name"), F.coalesce(heads, F.array().cast("array<string>")).alias("heading_ids"), terms.alias("terms"))


def mesh_tree(descriptors: DataFrame) -> DataFrame:
    return descriptors.select(F.explode("tree_numbers").alias("tree_number"), "id", "name")


def read_food_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)


def read_external_triples(spark: SparkSession, path: str) -> DataFrame:
    return read_legacy_tsv(spark, path)


def read_triples(spark: SparkSession, path: str, label: bool = False) -> DataFrame:
    """A headerless TSV of triples, with a label if asked."""
    return spark.read.schema(TRIPLE + (", label int" if label else "")).option("sep", "\t").csv(path)


def write_triples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def read_prediction_shards(spark: SparkSession, pattern: str, run: str = r"run_(\d+)") -> DataFrame:
    """(row_key, run, prob) of all shards that are there; the run stands in the file's path."""
    raw = spark.read.schema("row_key string, prob double").option("sep", "\t").option("header", True).csv(pattern)
    return raw.select("row_key", F.regexp_extract(F.input_file_name(), run, 1).try_cast("int").alias("run"), "prob")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return blank_to_null(spark.read.schema("pmcid string, pmid string").option("header", True).csv(path))


def read_compound_json(spark: SparkSession, path: str) -> DataFrame:
    """(cid, json) of a store of JSON documents, one for each compound, each a file of its own or a line."""
    number = F.coalesce(F.get_json_object("value", "$.Record.RecordNumber"), F.get_json_object("value", "$.cid"))
    return spark.read.text(path).select(number.alias("cid"), F.col("value").alias("json")).where("cid is not null")


def sampled_graph(triples: DataFrame, share: float, seed: str = "42") -> DataFrame:
    """A share of the triples, chosen by a hash of each: what a partial export shows."""
    return sample_fraction(triples, ["head", "relation", "tail"], share, seed)


def graph_edges(triples: DataFrame, entities: DataFrame, relations: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges for a graph viewer: Source, Target, Label, Weight, Type."""
    names = F.broadcast(relations.select(F.col("relation_id").alias("relation"), F.col("name").alias("Label")))
    ends = entities.select("entity_id")
    known = triples.join(ends.withColumnRenamed("entity_id", "head"), "head", "left_semi").join(ends.withColumnRenamed("entity_id", "tail"), "tail", "left_semi")
    return known.join(names, "relation").select(F.col("head").alias("Source"), F.col("tail").alias("Target"), "Label", (F.col(weight) if weight else F.lit(1.0)).alias("Weight"), F.lit("Directed").alias("Type"))


def graph_nodes(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes that stand in an edge: Id, Label, Type."""
    used = triples.select(F.explode(F.array("head", "tail")).alias("entity_id")).distinct()
    return entities.join(used, "entity_id", "left_semi").select(F.col("entity_id").alias("Id"), F.col("name").alias("Label"), F.split_part("type", F.lit(":"), F.lit(1)).alias("Type"))


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The body of a GML text: a line for each node and edge (put between ``graph [`` and ``]``)."""
    node = F.format_string('  node [ id "%s" label "%s" type "%s" ]', "Id", F.translate("Label", '"', "'"), "Type")
    edge = F.format_string('  edge [ source "%s" target "%s" label "%s" ]', "Source", "Target", "Label")
    return nodes.select(node.alias("value")).unionByName(edges.select(edge.alias("value")))
