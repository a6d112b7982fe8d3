"""Queries of readers and writers: tables written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import annotate, entities, external, kgc, metrics, report
from graphloom.functions.text import numeric_id, pseudo_random
from graphloom.plans.demo import view
from graphloom.plans.learning import SPLIT, split
from graphloom.plans.tables import ents
from graphloom.sources import kg as S
from graphloom.sources.written import shared_folder

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


@query("read_taxdump", "SELECT CAST(c_custkey AS STRING) AS tax_id, c_name AS name_txt, 'scientific name' AS name_class FROM customer")
def _(spark, sf):
    path = place(spark, "names")
    view(spark, sf, "customer").select(F.format_string("%d\t|\t%s\t|\t\t|\tscientific name\t|", "c_custkey", "c_name").alias("value")).write.text(path)
    return S.read_taxdump(spark, path, "names").select("tax_id", "name_txt", "name_class")


#: Rows of a file that holds many records: a key has as many files as it takes.
FILE_ROWS = 10_000


def filed(rows, key: str, spread):
    """``rows`` with ``file``: the number of a file of its key, so that no file grows with the table."""
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / FILE_ROWS).alias("files"))
    return rows.join(n, key).withColumn("file", F.pmod(F.xxhash64(spread), F.col("files"))).drop("files")


@query("read_search_json", "SELECT event_type || '-' || CAST(user_id % 16 AS STRING) AS search_term, CAST(event_id AS STRING) AS pmid, 'INTRO' AS section FROM events")
def _(spark, sf):
    path = place(spark, "hits")
    term = F.concat("event_type", F.lit("-"), (F.col("user_id") % 16).cast("string"))
    hits = filed(view(spark, sf, "events").select("event_id", term.alias("term"), F.struct(F.col("event_id").cast("string").alias("pmid"), F.lit("INTRO").alias("section")).alias("h")), "term", "event_id")
    files = hits.groupBy("term", "file").agg(F.to_json(F.collect_list("h")).alias("j"))  # the format has a JSON array a file
    files.select("term", "file", F.concat("term", F.lit("\n"), "j").alias("value")).repartition("term", "file").write.partitionBy("term", "file").text(path)
    return S.read_search_json(spark, f"{path}/*/*/*").select("search_term", "pmid", "section")


@query("read_cid_names", "SELECT CAST(p_partkey AS STRING) AS pubchem_id, unnest([p_brand, p_type]) AS mesh_name FROM part")
def _(spark, sf):
    path = place(spark, "names")
    view(spark, sf, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("value")).write.text(path)
    return S.parse_cid_names(spark.read.text(path))


_TERMS = "<ConceptList><Concept><TermList><Term><String>%s</String></Term></TermList></Concept></ConceptList>"
_DESCRIPTOR = f"<DescriptorRecord><DescriptorUI>D%d</DescriptorUI><DescriptorName><String>%s</String></DescriptorName><TreeNumberList><TreeNumber>A1</TreeNumber><TreeNumber>A1.%d</TreeNumber></TreeNumberList>{_TERMS}</DescriptorRecord>"
_HEADING = "<HeadingMappedTo><DescriptorReferredTo><DescriptorUI>%s</DescriptorUI></DescriptorReferredTo></HeadingMappedTo>"
_SUPPLEMENT = f"<SupplementalRecord><SupplementalRecordUI>C%d</SupplementalRecordUI><SupplementalRecordName><String>%s</String></SupplementalRecordName><HeadingMappedToList>{_HEADING % '*D%d'}{_HEADING % 'D0'}</HeadingMappedToList>{_TERMS}</SupplementalRecord>"


def _xml(spark, sf, record):
    """Parts as records of XML files of bounded size; a file has one root."""
    path = place(spark, "xml")
    rows = filed(view(spark, sf, "part").select("p_partkey", "p_size", F.format_string(record, "p_partkey", "p_name", "p_size", "p_brand").alias("r")), "p_size", "p_partkey")
    files = rows.groupBy("p_size", "file").agg(F.concat(F.lit("<Set>"), F.array_join(F.collect_list("r"), ""), F.lit("</Set>")).alias("value"))
    files.repartition("p_size", "file").write.partitionBy("p_size", "file").text(path)
    return f"{path}/*/*"


@query("read_ontology_xml", "SELECT 'D' || CAST(p_partkey AS STRING) AS id, p_name AS name, 'A1|A1.' || CAST(p_size AS STRING) AS tree_numbers, p_brand AS terms FROM part")
def _(spark, sf):
    read = S.read_mesh_descriptors(spark, _xml(spark, sf, _DESCRIPTOR))
    return read.select("id", "name", F.array_join("tree_numbers", "|").alias("tree_numbers"), F.array_join("terms", "|").alias("terms"))


@query("read_supplementary_xml", "SELECT 'C' || CAST(p_partkey AS STRING) AS id, p_name AS name, 'D' || CAST(p_size AS STRING) || '|D0' AS heading_ids, p_brand AS terms FROM part")
def _(spark, sf):
    read = S.read_mesh_supplements(spark, _xml(spark, sf, _SUPPLEMENT))
    return read.select("id", "name", F.array_join("heading_ids", "|").alias("heading_ids"), F.array_join("terms", "|").alias("terms"))


@query("read_compound_json", "SELECT CAST(p_partkey AS STRING) AS cid, p_name AS title FROM part")
def _(spark, sf):
    path = place(spark, "json")
    record = F.struct(F.col("p_partkey").alias("RecordNumber"), F.col("p_name").alias("RecordTitle")).alias("Record")
    view(spark, sf, "part").select(F.to_json(F.struct(record)).alias("value")).write.text(path)
    return S.read_compound_json(spark, path).select("cid", F.get_json_object("json", "$.Record.RecordTitle").alias("title"))


@query("read_food_csv", "SELECT CAST(p_partkey AS STRING) AS id, p_name || ' é' AS name FROM part")
def _(spark, sf):
    path = place(spark, "foods")
    view(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return S.read_food_csv(spark, path)


@query("read_kg", "SELECT entity_id, type, name, part_id, tax_id, cid, mesh_id FROM ent")
def _(spark, sf):
    """The older text form: lists and maps as literals, the part among the ids."""
    folder = place(spark, "legacy")
    S.write_legacy_kg(folder, id_name="number", part_key="own_part_id", entities=ents(spark, sf))
    one = lambda key: F.get(F.col("other_db_ids")[key], F.lit(0))
    read = S.read_legacy_kg(spark, folder, "entities")
    return read.select("entity_id", "type", "name", "part_id", one("NCBI_taxonomy").alias("tax_id"), one("PubChem").alias("cid"), one("MESH").alias("mesh_id"))


@query("read_kg_evidence", "SELECT head, relation, tail, pmid, premise, source, quality, prob_mean, prob_std FROM ev")
def _(spark, sf):
    folder = place(spark, "legacy")
    columns = spark.createDataFrame([], S.EVIDENCE).columns
    ev = view(spark, sf, "ev")
    S.write_legacy_kg(folder, evidence=ev.select(*(ev[c] if c in ev.columns else F.lit(None).cast("string").alias(c) for c in columns)))
    return S.read_legacy_kg(spark, folder, "evidence").select("head", "relation", "tail", "pmid", "premise", "source", "quality", "prob_mean", "prob_std")


@query("write_kg", "SELECT entity_id, name, TRUE AS in_order FROM ent")
def _(spark, sf):
    """Entities as written: in order if no file begins before the one with the number below ends."""
    folder = place(spark, "kg")
    S.write_kg(folder, entities=ents(spark, sf))
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = spark.read.parquet(f"{folder}/entities").select("entity_id", "name", part.alias("file"), numeric_id(F.col("entity_id")).alias("number"))
    files = rows.groupBy("file").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    order = Window.orderBy("file")  # a row for each file
    ordered = files.select("file", (F.col("low") > F.coalesce(F.lag("high").over(order), F.lit(-1))).alias("in_order"))
    return rows.join(F.broadcast(ordered), "file").select("entity_id", "name", "in_order")


@query("read_triples", "SELECT head, relation, tail FROM kg")
def _(spark, sf):
    path = place(spark, "triples")
    view(spark, sf, "kg").write.option("sep", "\t").csv(path)
    return S.read_triples(spark, path)


@query("write_triples", f"SELECT split, head, relation, tail FROM ({SPLIT})")
def _(spark, sf):
    """Train, validation and test files, read back with the part that each file stands for."""
    path, parts = place(spark, "splits"), split(spark, sf)
    for name in ("train", "val", "test"):
        S.write_triples(parts.where(F.col("split") == name).select("head", "relation", "tail"), f"{path}/{name}")
    read = S.read_triples(spark, f"{path}/*")
    return read.select(F.regexp_extract(F.input_file_name(), "/(train|val|test)/", 1).alias("split"), "head", "relation", "tail")


_KNOWN = "k.head IN (SELECT entity_id FROM ent) AND k.tail IN (SELECT entity_id FROM ent)"
_EDGES = """SELECT k.head AS "Source", k.tail AS "Target", r.name AS "Label", CAST(1.0 AS DOUBLE) AS "Weight", 'Directed' AS "Type" FROM kg AS k JOIN rel AS r ON k.relation = r.relation_id WHERE """
_SAMPLED = "CAST('0x' || substr(md5('42|' || k.head || '|' || k.relation || '|' || k.tail), 1, 12) AS BIGINT) % 1000000 < 100000"


@query("export_graph", f"{_EDGES} {_KNOWN} AND {_SAMPLED}")
def _(spark, sf):
    """A partial export: a tenth of the graph by a hash of each triple (the sample is the operator's own)."""
    return S.graph_edges(S.sampled_graph(view(spark, sf, "kg"), 0.1), view(spark, sf, "ent"), view(spark, sf, "rel"))


@query("export_graph_nodes", f"""SELECT e.entity_id AS "Id", e.name AS "Label", split_part(e.type, ':', 1) AS "Type" FROM ent AS e WHERE e.entity_id IN (SELECT k.head FROM kg AS k WHERE {_SAMPLED} UNION SELECT k.tail FROM kg AS k WHERE {_SAMPLED})""")
def _(spark, sf):
    return S.graph_nodes(S.sampled_graph(view(spark, sf, "kg"), 0.1), view(spark, sf, "ent"))


@query("export_graph_filtered", f"{_EDGES} {_KNOWN} AND r.name = 'hasPart'")
def _(spark, sf):
    own = entities.triples_by_relation(view(spark, sf, "kg"), view(spark, sf, "rel"), "hasPart")
    return S.graph_edges(own, view(spark, sf, "ent"), view(spark, sf, "rel"))


@query("food_db_association_stats", """SELECT c.chemical_id, COUNT(*) AS associations, COUNT(*) FILTER (f) AS with_reference FROM (SELECT c.association_id, c.chemical_id, bool_or(r.reference_id IS NOT NULL) AS f
    FROM (SELECT *, trim(unnest(string_split(reference_ids, ','))) AS x FROM comp) AS c LEFT JOIN refs AS r ON c.x = CAST(r.reference_id AS STRING) GROUP BY c.association_id, c.chemical_id) AS c GROUP BY c.chemical_id""")
def _(spark, sf):
    return external.associations_by(view(spark, sf, "comp"), view(spark, sf, "refs"), ["chemical_id"])


@query("first_per_key", "SELECT head, tail, source, quality FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY k1, k2) AS i FROM ev) WHERE i = 1")
def _(spark, sf):
    return report.first_per_key(view(spark, sf, "ev"), ["head", "tail"], ["k1", "k2"]).select("head", "tail", "source", "quality")


@query("attach_rank", "SELECT k, prob, row_number() OVER (ORDER BY prob, k) AS rank, MIN(prob * n / i) OVER (ORDER BY i DESC) AS running_least FROM (SELECT *, row_number() OVER (ORDER BY prob, k) AS i, COUNT(*) OVER () AS n FROM pool)")
def _(spark, sf):
    """One family of all tests: its reverse running minimum crosses every partition."""
    pool = view(spark, sf, "pool").withColumn("family", F.lit(1))
    ranked = annotate.numbered(pool, [F.col("prob"), F.col("k")], "rank", 1)
    least = metrics.fdr_adjust(pool, ["family"], "prob").select("k", F.col("p_adjusted").alias("running_least"))
    return ranked.join(least, "k").select("k", "prob", "rank", "running_least")


@query("al_round", "SELECT k, prob, CASE WHEN row_number() OVER (ORDER BY prob DESC, md5('42|' || k), k) <= ceil(n / 10) THEN 'train' ELSE 'to_predict' END AS part FROM (SELECT *, COUNT(*) OVER () AS n FROM pool)")
def _(spark, sf):
    """A round of ten: a tenth of the pool, rounded up, joins the training rows, and the rest is to be predicted."""
    pool = view(spark, sf, "pool")
    size = -(-pool.count() // 10)
    part = F.when(F.col("chosen"), "train").otherwise("to_predict").alias("part")
    return annotate.al_batch(pool, size, "certain_pos", ["k"]).select("k", "prob", part)


@query("read_external_triples", "SELECT head, tail, pmid FROM ev")
def _(spark, sf):
    path = place(spark, "external")
    view(spark, sf, "ev").select("head", "tail", "pmid").write.option("header", True).option("sep", "\t").csv(path)
    return S.read_external_triples(spark, path)


@query("read_prediction_shards", "SELECT CAST(doc_id AS STRING) AS row_key, CAST(run AS INT) AS run, prob FROM runs")
def _(spark, sf):
    path = place(spark, "shards")
    view(spark, sf, "runs").select(F.col("doc_id").alias("row_key"), "prob", "run").write.partitionBy("run").option("header", True).option("sep", "\t").csv(path)
    return S.read_prediction_shards(spark, f"{path}/*", r"run=(\d+)")


@query("read_id_map", "SELECT pmcid, pmid FROM idmap")
def _(spark, sf):
    path = place(spark, "ids")
    view(spark, sf, "idmap").select("pmcid", "pmid").write.option("header", True).csv(path)
    return S.read_id_map(spark, path)


@query("relation_by_id", "SELECT r.name, COUNT(*) AS n FROM kg AS k JOIN rel AS r ON k.relation = r.relation_id WHERE r.relation_id = 'r1' GROUP BY r.name")
def _(spark, sf):
    one = entities.exactly_one(view(spark, sf, "rel"), "relation_id", "r1")
    return view(spark, sf, "kg").where(F.col("relation") == one["relation_id"]).groupBy(F.lit(one["name"]).alias("name")).agg(F.count("*").alias("n"))


@query("topn_bottomn", "SELECT * FROM (SELECT k, 'first' AS part FROM pool ORDER BY md5('42|' || k) LIMIT 100) UNION ALL SELECT * FROM (SELECT k, 'last' FROM pool ORDER BY prob, k LIMIT 180)")
def _(spark, sf):
    pool = view(spark, sf, "pool")
    first = annotate.ends_by(pool, [pseudo_random(F.col("k"))], 100).select("k", F.lit("first").alias("part"))
    return first.unionByName(annotate.ends_by(pool, [-F.col("prob"), -F.col("k")], 180, first=False).select("k", F.lit("last").alias("part")))


@query("assert_disjoint", "SELECT relation, COUNT(*) AS n FROM kg GROUP BY relation")
def _(spark, sf):
    kg = view(spark, sf, "kg")
    kgc.assert_disjoint(kg.where("relation = 'r0'"), kg.where("relation <> 'r0'"))
    return kg.groupBy("relation").agg(F.count("*").alias("n"))


@query("distinct_pairs", "SELECT DISTINCT head, tail FROM ev")
def _(spark, sf):
    return view(spark, sf, "ev").select("head", "tail").distinct()


@query("explode_reference_quality", "SELECT quality, COUNT(*) AS n FROM (SELECT CASE WHEN r.pmid IS NOT NULL THEN 'high' ELSE 'low' END AS quality FROM (SELECT try_cast(trim(x) AS INT) AS rid FROM (SELECT unnest(string_split(reference_ids, ',')) AS x FROM comp)) AS c JOIN refs AS r ON c.rid = r.reference_id) GROUP BY quality")
def _(spark, sf):
    return external.explode_references(view(spark, sf, "comp"), view(spark, sf, "refs")).groupBy("quality").agg(F.count("*").alias("n"))


@query("calibration_counts", "SELECT CAST(least(floor(round(prob * 10, 9)), 9) AS INT) AS bin, COUNT(*) AS n FROM runs GROUP BY ALL")
def _(spark, sf):
    return view(spark, sf, "runs").groupBy(metrics.bin_of(F.col("prob"), 10).alias("bin")).agg(F.count("*").alias("n"))
