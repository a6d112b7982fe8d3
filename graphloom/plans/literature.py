"""Queries of literature, annotation, sampling, set operations, sources and text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import annotate, literature, report
from graphloom.operators import phrases as phrase
from graphloom.operators.skew import spread
from graphloom.plans.demo import view
from graphloom.sources import kg as S
from graphloom.sources.written import shared_folder

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def _hits(spark, sf):
    """Sentences with annotations on their first and fourth character; species by language, chemicals by source."""
    d = view(spark, sf, "documents")
    species = F.when(F.col("doc_id") % 5 == 0, F.lit("0|3|species|None")).otherwise(F.concat(F.lit("0|3|species|"), (F.col("doc_id") % 7).cast("string")))
    chemical = F.when(F.col("doc_id") % 11 == 0, F.lit("-1|4|chemical|MESH:D1")).otherwise(F.concat(F.lit("3|4|chemical|MESH:"), "source"))
    notes = F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.array(species, chemical, F.lit("bad|one|two")))
    return d.select(F.col("doc_id").cast("string").alias("pmid"), F.lit(None).cast("string").alias("pmcid"), F.col("lang").alias("section"), "text", notes.alias("annotations"))


_PARSED = """SELECT CAST(doc_id AS STRING) AS pmid, lang AS section, text, CASE WHEN doc_id % 5 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 < 5 THEN substr(text, 1, 3) || '/' || CAST(doc_id % 7 AS STRING) ELSE '' END AS organisms,
    CASE WHEN doc_id % 11 <> 0 AND doc_id % 17 <> 0 THEN substr(text, 4, 4) || '/' || source ELSE '' END AS chemicals FROM documents"""


def _parsed(spark, sf):
    allowed = view(spark, sf, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("tax_id"))
    return literature.parse_annotations(_hits(spark, sf), allowed)


def _flat(c):
    return F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit("/"), e["id"])), ";").alias(c)


@query("parse_annotations", f"SELECT pmid, organisms, chemicals FROM ({_PARSED})")
def _(spark, sf):
    return _parsed(spark, sf).select("pmid", _flat("organisms"), _flat("chemicals"))


@query("premises_with_both", f"SELECT pmid FROM ({_PARSED}) WHERE organisms <> '' AND chemicals <> ''")
def _(spark, sf):
    return literature.premises_with_both(_parsed(spark, sf)).select("pmid")


@query("names_both", "SELECT doc_id % 17 <> 0 AS both, COUNT(*) AS n FROM documents WHERE doc_id % 17 <> 0 GROUP BY ALL")
def _(spark, sf):
    return _hits(spark, sf).where(literature.names_both(F.col("annotations"))).groupBy(F.lit(True).alias("both")).agg(F.count("*").alias("n"))


@query("allowed_taxa", "SELECT doc_id FROM documents WHERE doc_id % 7 < 5")
def _(spark, sf):
    allowed = view(spark, sf, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("tax_id"))
    return view(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).cast("string").alias("tax_id")).join(allowed, "tax_id", "left_semi").select("doc_id")


def _parts(spark):
    return spark.sql("SELECT * FROM VALUES ('p1', 'thon', 'ering, the'), ('p2', 'of', ''), ('p3', 'la de', NULL) AS v(part_id, food_part, food_part_synonyms)")


_TOKENS = "regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9 ]+', '', 'g'), '\\s+')"


@query("food_parts_in_text", f"SELECT doc_id, concat_ws('|', CASE WHEN list_has_any(t, ['thon', 'ering', 'the']) THEN 'p1' END, CASE WHEN list_contains(t, 'of') THEN 'p2' END) AS food_parts FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def _(spark, sf):
    docs = view(spark, sf, "documents").select("doc_id", F.col("text").alias("premise"))
    return literature.food_parts_in_text(docs, _parts(spark)).select("doc_id", F.array_join("food_parts", "|").alias("food_parts"))


# A phrase of one to seven words from each document, sought in all of them.
_WORDS = f"list_filter({_TOKENS}, lambda x: x <> '')"
_PHRASES = f"SELECT DISTINCT array_to_string(t[3 : 3 + doc_id % 7], ' ') AS phrase FROM (SELECT doc_id, {_WORDS} AS t FROM documents) WHERE len(t) > 2"


@query("phrases_in_tokens", f"SELECT d.doc_id, COUNT(*) AS phrases, MIN(p.phrase) AS first FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents) AS d JOIN ({_PHRASES}) AS p ON contains(d.t, ' ' || p.phrase || ' ') GROUP BY d.doc_id")
def _(spark, sf):
    docs = view(spark, sf, "documents").select(F.col("doc_id").alias("key"), X.tokens(F.col("text")).alias("tokens"))
    # Texts of one or two words give an empty phrase, which stands nowhere.
    phrases = docs.select(F.array_join(F.slice("tokens", F.lit(3), (F.col("key") % 7 + 1).cast("int")), " "))
    found = phrase.phrases_in_tokens(docs, phrases)
    return found.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("phrases"), F.min("phrase").alias("first"))


@query("without_phrases", "SELECT head, tail, hypothesis FROM ev AS e WHERE NOT EXISTS (SELECT 1 FROM part AS p WHERE p.p_partkey % 3 = 0 AND contains(lower(e.hypothesis), 'h' || CAST(10 + p.p_partkey % 29 AS STRING)))")
def _(spark, sf):
    phrases = view(spark, sf, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("H"), (F.col("p_partkey") % 29 + 10).cast("string")))
    return report.without_phrases(view(spark, sf, "ev"), phrases).select("head", "tail", "hypothesis")


@query("dedupe_hits", "SELECT event_type, user_id, MIN(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def _(spark, sf):
    return literature.dedupe_hits(view(spark, sf, "events").select("event_type", "user_id", "event_id"), ["event_type", "user_id"], ["event_id"])


@query("make_ph_pairs", f"""SELECT DISTINCT pmid, hypothesis, part_id FROM (SELECT pmid, substr(text, 1, 3) || ' contains ' || substr(text, 4, 4) AS hypothesis, 'p0' AS part_id FROM ({_PARSED}) WHERE organisms <> '' AND chemicals <> ''
    UNION ALL SELECT pmid, substr(text, 1, 3) || ' - of contains ' || substr(text, 4, 4), 'p2' FROM ({_PARSED}) WHERE organisms <> '' AND chemicals <> '' AND section = 'en' AND contains(lower(text), 'of'))""")
def _(spark, sf):
    parsed = literature.premises_with_both(_parsed(spark, sf)).withColumn("premise", F.col("text"))
    parsed = parsed.withColumn("food_parts", F.when(F.col("section") == "en", F.array(F.lit("p2"))).otherwise(F.array().cast("array<string>")))
    names = _parts(spark).select("part_id", "food_part", F.array("food_part").alias("names"))
    return literature.make_pairs(parsed, names).select("pmid", "hypothesis", "part_id").distinct()


@query("search_strings", "SELECT DISTINCT lower(s.s_name || ' ' || p.p_brand) AS query FROM lineitem AS l JOIN supplier AS s ON l.l_suppkey = s.s_suppkey JOIN part AS p ON l.l_partkey = p.p_partkey")
def _(spark, sf):
    pairs = view(spark, sf, "lineitem").select(F.col("l_suppkey").alias("head"), F.col("l_partkey").alias("tail")).distinct()
    heads = view(spark, sf, "supplier").select(F.col("s_suppkey").alias("head"), F.array("s_name").alias("head_names"))
    tails = view(spark, sf, "part").select(F.col("p_partkey").alias("tail"), F.array("p_brand").alias("tail_names"))
    return literature.search_strings(pairs, heads, tails)


@query("article_queries", """SELECT pmid, pmcid, array_to_string(list_sort(list(DISTINCT query)), '|') AS queries FROM (SELECT coalesce(f.pmid, b.pmid) AS pmid, coalesce(f.pmcid, a.pmcid) AS pmcid, f.query
    FROM found AS f LEFT JOIN idmap AS a ON f.pmid = a.pmid LEFT JOIN idmap AS b ON f.pmcid = b.pmcid) GROUP BY pmid, pmcid""")
def _(spark, sf):
    return literature.article_queries(view(spark, sf, "found"), view(spark, sf, "idmap")).withColumn("queries", F.array_join("queries", "|"))


@query("question_text", "SELECT k.head, k.tail, 'Does ' || h.name || ' contain ' || t.name || '? Answer Yes or No.' AS question FROM kg AS k JOIN ent AS h ON k.head = h.entity_id JOIN ent AS t ON k.tail = t.entity_id WHERE k.relation = 'r0'")
def _(spark, sf):
    from graphloom.operators.report import decorate_triples
    from graphloom.plans.reports import _with_ids

    out = decorate_triples(view(spark, sf, "kg").where("relation = 'r0'"), _with_ids(view(spark, sf, "ent")), view(spark, sf, "rel"))
    return out.select("head", "tail", literature.question_text(F.col("head_name"), F.col("tail_name")).alias("question"))


# Annotation.


@query("unanimous_labels", "SELECT hypothesis, premise, MIN(answer) AS answer FROM ann GROUP BY hypothesis, premise HAVING MIN(answer) = MAX(answer)")
def _(spark, sf):
    return annotate.unanimous_labels(view(spark, sf, "ann"), ["hypothesis", "premise"])


@query("drop_skipped", "SELECT doc_id, who FROM ann WHERE answer <> 'Skip'")
def _(spark, sf):
    return annotate.drop_skipped(view(spark, sf, "ann")).select("doc_id", "who")


@query("one_per_hypothesis", "SELECT hypothesis, doc_id, who FROM ann QUALIFY row_number() OVER (PARTITION BY hypothesis ORDER BY md5('42|' || doc_id || '|' || who), doc_id, who) = 1")
def _(spark, sf):
    return annotate.one_per_hypothesis(view(spark, sf, "ann").select("hypothesis", "doc_id", "who"), "hypothesis", ["doc_id", "who"])


_PREMISES = "SELECT premise, row_number() OVER (ORDER BY md5('42|' || premise), premise) - 1 AS at FROM (SELECT DISTINCT premise FROM pairs)"
_PLACED = f"SELECT p.*, CASE WHEN o.at < 30 THEN 'val' WHEN o.at < 60 THEN 'test' ELSE 'train' END AS part FROM pairs AS p JOIN ({_PREMISES}) AS o ON p.premise = o.premise"


@query("split_by_premise", f"""SELECT premise, hypothesis, CASE WHEN NOT fits THEN 'to_predict' WHEN part <> 'train' THEN part WHEN row_number() OVER (PARTITION BY part, fits ORDER BY md5('42|' || premise || '|' || hypothesis), premise, hypothesis) <= 200 THEN 'train' ELSE 'to_predict' END AS split
    FROM (SELECT p.*, CASE part WHEN 'test' THEN TRUE WHEN 'val' THEN NOT t ELSE NOT t AND NOT v END AS fits FROM ({_PLACED}) AS p JOIN (SELECT hypothesis, bool_or(part = 'test') AS t, bool_or(part = 'val') AS v FROM ({_PLACED}) GROUP BY hypothesis) USING (hypothesis))""")
def _(spark, sf):
    return annotate.split_by_premise(view(spark, sf, "pairs"), 30, 30, 200)


@query("kfold_by_premise", f"SELECT p.premise, p.hypothesis, CAST(o.at % 10 AS INT) AS fold FROM pairs AS p JOIN ({_PREMISES}) AS o ON p.premise = o.premise")
def _(spark, sf):
    return annotate.kfold_by_premise(view(spark, sf, "pairs"), 10)


@query("rows_to_predict", "SELECT * FROM pairs WHERE CAST(substr(hypothesis, 2) AS INT) % 3 <> 0")
def _(spark, sf):
    pairs = view(spark, sf, "pairs")
    return annotate.rows_to_predict(pairs, pairs.where("cast(substr(hypothesis, 2) as int) % 3 = 0"))


@query("take_every_nth", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 <= 5")
def _(spark, sf):
    return annotate.take_every_nth(view(spark, sf, "orders"), "o_orderkey", 11, 0, 5).select("o_orderkey")


@query("sample_fraction", "SELECT k FROM pool WHERE CAST('0x' || substr(md5('42|' || k), 1, 12) AS BIGINT) % 1000000 < 400000")
def _(spark, sf):
    return annotate.sample_fraction(view(spark, sf, "pool"), ["k"], 0.4).select("k")


@query("al_round_random", "SELECT k, row_number() OVER (ORDER BY md5('42|' || k), k) <= 100 AS chosen FROM pool")
def _(spark, sf):
    return annotate.al_batch(view(spark, sf, "pool"), 100, "random", ["k"]).select("k", "chosen")


@query("al_round_certain_pos", "SELECT k, row_number() OVER (ORDER BY prob DESC, md5('42|' || k), k) <= 100 AS chosen FROM pool")
def _(spark, sf):
    return annotate.al_batch(view(spark, sf, "pool"), 100, "certain_pos", ["k"]).select("k", "chosen")


@query("al_round_uncertain", "SELECT k, row_number() OVER (ORDER BY least(prob, 1 - prob) DESC, md5('42|' || k), k) <= 100 AS chosen FROM pool")
def _(spark, sf):
    return annotate.al_batch(view(spark, sf, "pool"), 100, "uncertain", ["k"]).select("k", "chosen")


@query("al_round_stratified", "SELECT k, row_number() OVER (PARTITION BY greatest(ceil(round(prob * 10, 9)), 1) ORDER BY md5('42|' || k), k) <= 10 AS chosen FROM pool")
def _(spark, sf):
    return annotate.al_batch(view(spark, sf, "pool"), 100, "stratified", ["k"]).select("k", "chosen")


@query("stratified_sample", "SELECT k, CAST(least(floor(round(prob * 5, 9)), 4) AS INT) AS bin FROM pool QUALIFY row_number() OVER (PARTITION BY least(floor(round(prob * 5, 9)), 4) ORDER BY md5('42|' || k), k) <= 10")
def _(spark, sf):
    return annotate.stratified_sample(view(spark, sf, "pool"), 10, 5, ["k"]).select("k", "bin")


@query("topn", "SELECT k FROM pool ORDER BY md5('42|' || k) LIMIT 100")
def _(spark, sf):
    return annotate.ends_by(view(spark, sf, "pool"), [X.pseudo_random(F.col("k"))], 100).select("k")


@query("bottomn", "SELECT k FROM pool ORDER BY prob, k LIMIT 180")
def _(spark, sf):
    return annotate.ends_by(view(spark, sf, "pool"), [-F.col("prob"), -F.col("k")], 180, first=False).select("k")


@query("union_rounds", "SELECT k FROM pool WHERE prob < 0.3 UNION ALL SELECT k FROM pool WHERE prob > 0.6")
def _(spark, sf):
    pool = view(spark, sf, "pool")
    return pool.where("prob < 0.3").unionByName(pool.where("prob > 0.6")).select("k")


# Text, maps and nested values.


@query("clean_text", f"SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda x: x <> ''), ' ') AS clean FROM documents")
def _(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("clean"))


@query("text_slice", "SELECT doc_id, substr(text, CAST(doc_id % 5 AS INT) + 1, 7) AS cut FROM documents")
def _(spark, sf):
    return view(spark, sf, "documents").select("doc_id", X.text_slice(F.col("text"), (F.col("doc_id") % 5).cast("int"), F.lit(7)).alias("cut"))


@query("clean_title", "SELECT item_id, regexp_replace(lower(text), '[!-/:-@\\[-`{-~ –—]', '', 'g') AS clean FROM benchmark")
def _(spark, sf):
    return view(spark, sf, "benchmark").select("item_id", X.clean_title(F.col("text")).alias("clean"))


_STOP = "[" + ", ".join(f"'{w}'" for w in X.TITLE_STOP_WORDS) + "]"


@query("title_query", f"SELECT item_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: NOT list_contains({_STOP}, w)), lambda w: w || '[Title]'), ' AND ') AS query FROM benchmark")
def _(spark, sf):
    return view(spark, sf, "benchmark").select("item_id", X.title_query(F.col("text")).alias("query"))


@query("scientific_name_query", "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Genus n' || s_nationkey WHEN 1 THEN 'INVALID_SCIENTIFIC_NAME' WHEN 2 THEN 'CROSS_BREED' WHEN 3 THEN 'Genus n' || s_nationkey || ' subsp. alba' WHEN 4 THEN 'INVALID_SCIENTIFIC_NAME' ELSE 'Genus n' || s_nationkey END AS query FROM supplier")
def _(spark, sf):
    n = F.concat(F.lit("Genus n"), F.col("s_nationkey").cast("string"))
    m = F.col("s_suppkey") % 6
    name = F.when(m == 0, n).when(m == 1, F.lit("Genus")).when(m == 2, F.concat(n, F.lit(" x other"))).when(m == 3, F.concat(n, F.lit(" L. ssp. alba"))).when(m == 4, F.concat(n, F.lit(" alba rubra"))).otherwise(F.concat(n, F.lit(" L.")))
    return view(spark, sf, "supplier").select("s_suppkey", X.scientific_name_query(name).alias("query"))


@query("singularize", "SELECT c_custkey, lower(c_name) || ' leaf and ' || lower(c_mktsegment) || ' berry' AS one FROM customer")
def _(spark, sf):
    many = F.concat(F.lower("c_name"), F.lit("s leaves and "), F.lower("c_mktsegment"), F.lit("s berries"))
    return view(spark, sf, "customer").select("c_custkey", X.singularize(many).alias("one"))


@query("unique_names", "SELECT c_nationkey, array_to_string(list_sort(list(s)), '|') AS names FROM (SELECT c_nationkey, MIN(s) AS s FROM (SELECT c_nationkey, unnest([c_mktsegment, lower(c_mktsegment)]) AS s FROM customer) GROUP BY c_nationkey, lower(s)) GROUP BY c_nationkey")
def _(spark, sf):
    g = view(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_union(F.collect_set("c_mktsegment"), F.collect_set(F.lower("c_mktsegment"))).alias("n"))
    return g.select("c_nationkey", F.array_join(X.unique_names(F.col("n")), "|").alias("names"))


@query("merge_id_maps", "SELECT p_partkey, 'A=' || array_to_string(list_sort(list_distinct([p_brand, p_type])), ',') || ';B=' || p_type AS ids FROM part")
def _(spark, sf):
    a = F.create_map(F.lit("A"), F.array("p_brand"), F.lit("Z"), F.array(F.lit("z")))
    b = F.create_map(F.lit("A"), F.array("p_type"), F.lit("B"), F.array("p_type"))
    merged = X.keep_id_keys(X.merge_id_maps(a, b), ["A", "B"])
    return view(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("ids"))


@query("triple_key", "SELECT head, tail, '(' || head || ',' || relation || ',' || tail || ')' AS triple, relation, CAST(substr(tail, 2) AS BIGINT) AS n FROM kg")
def _(spark, sf):
    kg = view(spark, sf, "kg").withColumn("triple", X.triple_key(F.col("head"), F.col("relation"), F.col("tail")))
    return kg.select("head", "tail", "triple", X.triple_relation(F.col("triple")).alias("relation"), X.numeric_id(F.col("tail")).alias("n"))


@query("name_parts", "SELECT entity_id, split_part(name, ' - ', 1) AS whole, split_part(type, ':', 1) AS kind, nullif(split_part(type, ':', 2), '') AS rank, split_part('ABC-DEF-' || entity_id, '-', 1) AS code FROM ent")
def _(spark, sf):
    return view(spark, sf, "ent").select("entity_id", X.whole_name(F.col("name")).alias("whole"), X.kind(F.col("type")).alias("kind"), X.rank(F.col("type")).alias("rank"), X.structure_code(F.concat(F.lit("ABC-DEF-"), "entity_id")).alias("code"))


@query("prob_functions", "SELECT k, round(least(prob, 1 - prob), 9) AS u, greatest(prob, 0.01) AS w FROM pool")
def _(spark, sf):
    return view(spark, sf, "pool").select("k", F.round(X.uncertainty(F.col("prob")), 9).alias("u"), X.weight(F.col("prob")).alias("w"))


@query("parse_answer", "SELECT hypothesis, CAST(SUM(CASE WHEN answer = 'Entails' THEN 1 ELSE 0 END) * 2 > COUNT(*) AS INT) AS answer FROM ann GROUP BY hypothesis")
def _(spark, sf):
    from graphloom.operators.metrics import mode_answer

    a = view(spark, sf, "ann").withColumn("said", F.when(F.col("answer") == "Entails", "Yes, it does.").otherwise("NO"))
    return mode_answer(a, ["hypothesis"], X.parse_answer(F.col("said")))


@query("pmid_of_report", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS STRING) END AS pmid, o_orderpriority || ' (' || CAST(o_orderkey AS STRING) || ') [ISSN:' || o_orderstatus || ']' AS caption FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Report: 7; PubMedID: "), k)).otherwise(F.concat(F.lit("Report: "), k))
    return view(spark, sf, "orders").select("o_orderkey", X.pmid_of_report(text).alias("pmid"), X.reference_caption({"title": F.col("o_orderpriority"), "year": F.col("o_orderkey"), "ISSN": F.col("o_orderstatus")}).alias("caption"))


@query("compound_fields", "SELECT p_partkey, p_name AS name, p_brand AS cas, 's' || p_size || '|' || p_type AS synonyms, 'http://mesh/' || p_size AS mesh_urls FROM part")
def _(spark, sf):
    value = lambda x: '{"StringWithMarkup":[{"String":"%s"}]}' % x
    section = lambda heading, body, n=1: '{"TOCHeading":"%s","Information":[{"ReferenceNumber":%d,"Value":%s}]}' % (heading, n, body)
    json = ('{"Record":{"RecordTitle":"%s","Section":[{"TOCHeading":"Names and Identifiers","Section":[{"TOCHeading":"Other Identifiers","Section":[' + section("CAS", value("%s")) + ']},{"TOCHeading":"Synonyms","Section":['
        + section("Depositor-Supplied Synonyms", value("s%s")) + "," + section("MeSH Entry Terms", '{"StringWithMarkup":[{"String":"S%s"},{"String":"%s"}]}', 4) + ']}]}],"Reference":[{"ReferenceNumber":4,"SourceName":"Medical Subject Headings (MeSH)","URL":"http://mesh/%s"},{"ReferenceNumber":5,"SourceName":"Medical Subject Headings (MeSH)","URL":"no"}]}}')
    size = F.col("p_size").cast("string")
    fields = X.compound_fields(F.format_string(json, "p_name", "p_brand", size, size, "p_type", size))
    return spread(view(spark, sf, "part")).select("p_partkey", fields["name"].alias("name"), *(F.array_join(fields[k], "|").alias(k) for k in ("cas", "synonyms", "mesh_urls")))


# Sources that parse text.


@query("parse_taxdump", "SELECT CAST(c_custkey AS STRING) AS tax_id, 'r' || CAST(c_nationkey AS STRING) AS parent_tax_id, 'species' AS rank FROM customer")
def _(spark, sf):
    lines = view(spark, sf, "customer").select(F.format_string("%d\t|\tr%d\t|\tspecies\t|", "c_custkey", "c_nationkey").alias("value"))
    return S.parse_taxdump(lines, "nodes")


@query("parse_search_json", "SELECT event_type AS search_term, CAST(event_id AS STRING) AS pmid, 'INTRO' AS section, CAST(0.5 AS DOUBLE) AS score FROM events")
def _(spark, sf):
    text = F.format_string('%s\n[{"pmid":"%d","section":"INTRO","text":"t","annotations":["0|1|species|9"],"score":0.5}]', "event_type", "event_id")
    return S.parse_search_json(view(spark, sf, "events").select(text.alias("value"))).select("search_term", "pmid", "section", "score")


@query("parse_event_props", "SELECT event_id, try_cast(props ->> '$.k' AS BIGINT) AS k FROM events")
def _(spark, sf):
    return view(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("parse_cid_names", "SELECT CAST(p_partkey AS STRING) AS pubchem_id, unnest([p_brand, p_type]) AS mesh_name FROM part")
def _(spark, sf):
    return S.parse_cid_names(view(spark, sf, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("value")))


@query("decode_nested", "SELECT p_partkey, p_brand || '|x' AS names, p_type AS id FROM part")
def _(spark, sf):
    rows = view(spark, sf, "part").select("p_partkey", F.format_string("['%s', 'x']", "p_brand").alias("l"), F.format_string("{'MESH': ['%s']}", "p_type").alias("m"))
    return rows.select("p_partkey", F.array_join(S.decode_list(F.col("l"), True), "|").alias("names"), F.array_join(S.decode_ids(F.col("m"), True)["MESH"], "|").alias("id"))


def _round_trip(spark, sf, name, df):
    folder = f"{shared_folder(spark)}/graphloom/kg-{uuid.uuid4().hex}"
    S.write_kg(folder, **{name: df})
    return S.read_kg(spark, folder, name)


@query("write_read_kg", "SELECT head, relation, tail FROM kg")
def _(spark, sf):
    return _round_trip(spark, sf, "kg", view(spark, sf, "kg"))


@query("write_read_relations", "SELECT 'r' || CAST(p_partkey AS STRING) AS relation_id, p_name AS name, p_type AS translation FROM part")
def _(spark, sf):
    rel = view(spark, sf, "part").select(F.format_string("r%d", "p_partkey").alias("relation_id"), F.col("p_name").alias("name"), F.col("p_type").alias("translation"))
    return _round_trip(spark, sf, "relations", rel)


@query("write_read_triples", "SELECT head, relation, tail, CAST(1 AS INT) AS label FROM kg")
def _(spark, sf):
    path = f"{shared_folder(spark)}/graphloom/triples-{uuid.uuid4().hex}"
    S.write_triples(view(spark, sf, "kg").withColumn("label", F.lit(1)), path)
    return S.read_triples(spark, path, label=True)
