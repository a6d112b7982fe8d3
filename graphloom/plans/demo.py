"""The driver's tables as inputs of the jobs. Each view is SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "ev": """SELECT 'e' || CAST(l_suppkey AS STRING) AS head, CASE WHEN l_linestatus = 'O' THEN 'r0' ELSE 'r1' END AS relation,
        'e' || CAST(1000000 + l_partkey AS STRING) AS tail, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS pmid,
        CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'PMC' || CAST(l_orderkey AS STRING) END AS pmcid,
        CASE WHEN l_linenumber % 3 = 0 THEN 'abstract' WHEN l_linenumber % 3 = 1 THEN 'methods' END AS section,
        'p' || CAST(CAST(l_quantity AS INT) AS STRING) AS premise, 'h' || CAST(l_partkey % 50 AS STRING) AS hypothesis,
        CASE WHEN l_returnflag = 'A' THEN 'annotation' WHEN l_returnflag = 'N' THEN 'prediction:entailment' ELSE 'external:db' END AS source,
        CASE WHEN l_linenumber <= 2 THEN 'high' WHEN l_linenumber <= 4 THEN 'medium' ELSE 'low' END AS quality,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE round(l_discount * 10, 1) END AS prob_mean, round(l_tax, 2) AS prob_std,
        l_orderkey AS k1, l_linenumber AS k2, l_linenumber AS line FROM lineitem""",
    "kg": "SELECT DISTINCT head, relation, tail FROM ev",
    "buys": "SELECT DISTINCT 'c' || CAST(o.o_custkey AS STRING) AS head, 'r0' AS relation, 'e' || CAST(1000000 + l.l_partkey AS STRING) AS tail FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey",
    "ent": """SELECT 'e' || CAST(s_suppkey AS STRING) AS entity_id, CASE WHEN s_suppkey % 4 = 0 THEN 'organism_with_part' ELSE 'organism:species' END AS type,
        CASE WHEN s_suppkey % 4 = 0 THEN s_name || ' - leaf' ELSE s_name END AS name, CAST(s_nationkey AS STRING) AS tax_id, CAST(NULL AS STRING) AS cid, CAST(NULL AS STRING) AS mesh_id,
        CASE WHEN s_suppkey % 4 = 0 THEN 'p1' ELSE 'p0' END AS part_id FROM supplier
        UNION ALL SELECT 'e' || CAST(1000000 + p_partkey AS STRING), 'chemical', p_name, NULL, CASE WHEN p_size > 25 THEN CAST(p_partkey AS STRING) END, 'D' || CAST(p_size AS STRING), NULL FROM part""",
    "rel": "SELECT * FROM (VALUES ('r0', 'contains', 'c'), ('r1', 'hasPart', 'h'), ('r2', 'isA', 'i'), ('r3', 'hasChild', 'x')) AS v(relation_id, name, translation)",
    "runs": """SELECT d.doc_id, r.run, ((d.doc_id * 37 + r.run * 131) % 1000) / 1e3 AS prob, d.lang, d.source
        FROM documents AS d CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS r(run)""",
    "scored": "SELECT r.doc_id, r.run, r.prob, r.lang, l.quality AS label, CASE WHEN r.prob >= 0.5 THEN 1 ELSE 0 END AS pred, round(r.prob, 1) AS score FROM runs AS r JOIN labels AS l ON r.doc_id = l.doc_id",
    "lp": "SELECT head, relation, tail, k2 AS run, prob_mean AS prob, prob_mean >= 0.5 AS pred FROM ev WHERE prob_mean IS NOT NULL",
    "ann": """SELECT 'h' || CAST(d.doc_id % 97 AS STRING) AS hypothesis, 'p' || CAST(d.doc_id % 61 AS STRING) AS premise, d.doc_id, a.who,
        CASE WHEN d.doc_id % 13 = 0 THEN 'Skip' WHEN (CASE WHEN a.who = 1 THEN l.quality ELSE 1 - l.toxic END) = 1 THEN 'Entails' ELSE 'Does not entail' END AS answer
        FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id CROSS JOIN (VALUES (1), (2)) AS a(who)""",
    "pairs": "SELECT DISTINCT 'p' || CAST(o_custkey % 300 AS STRING) AS premise, 'h' || CAST(o_orderkey % 700 AS STRING) AS hypothesis FROM orders",
    "pool": "SELECT o_orderkey AS k, ((o_orderkey * 37) % 1001) / 1e3 AS prob FROM orders",
    "names": "SELECT CAST(n_nationkey AS STRING) AS tax_id, n_name AS name_txt, 'scientific name' AS name_class FROM nation UNION ALL SELECT CAST(c_nationkey AS STRING), c_mktsegment, 'common name' FROM customer",
    "nodes": "SELECT CAST(n_nationkey AS STRING) AS tax_id, 'r' || CAST(n_regionkey AS STRING) AS parent_tax_id, CASE WHEN n_nationkey % 2 = 0 THEN 'species' ELSE 'genus' END AS rank FROM nation",
    "refs": "SELECT DISTINCT CAST(o_orderkey % 1000 AS INT) AS reference_id, CASE WHEN o_orderkey % 1000 % 3 = 0 THEN NULL ELSE 'pm' || CAST(o_orderkey % 1000 AS STRING) END AS pmid, 'ref' || CAST(o_orderkey % 1000 AS STRING) AS reference_name FROM orders",
    "comp": """SELECT l_orderkey * 10 + l_linenumber AS association_id, 'f' || CAST(l_suppkey AS STRING) AS food_id, 'c' || CAST(l_partkey AS STRING) AS chemical_id,
        round(l_discount * 10, 1) AS amount, CAST(l_orderkey % 1500 AS STRING) || ', x,' || CAST(l_partkey % 1000 AS STRING) AS reference_ids FROM lineitem""",
    "attrs": "SELECT 'i' || CAST(l_orderkey % 500 AS STRING) AS item_id, CASE WHEN l_linenumber % 3 = 0 THEN 'color' WHEN l_linenumber % 3 = 1 THEN 'group' ELSE 'code' END AS name, CAST(l_suppkey AS STRING) AS value FROM lineitem",
    "trees": "SELECT 'D' || CAST(p_size AS STRING) AS id, 'n' || CAST(p_size AS STRING) AS name, 'A' || CAST(p_size % 7 AS STRING) AS t1, p_size % 5 AS d FROM (SELECT DISTINCT p_size FROM part) AS s",
    "compounds": "SELECT CAST(p_partkey AS STRING) AS pubchem_id, 'n' || CAST(p_size AS STRING) AS mesh_name, CAST(p_size AS STRING) || '-' || p_brand AS cas FROM part",
    "found": "SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS pmid, CASE WHEN user_id % 3 = 1 THEN NULL ELSE 'PMC' || CAST(user_id AS STRING) END AS pmcid, event_type AS query FROM events",
    "idmap": "SELECT DISTINCT CAST(user_id AS STRING) AS pmid, 'PMC' || CAST(user_id AS STRING) AS pmcid FROM events WHERE user_id % 2 = 0",
    "rounds": "SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'random' WHEN l_suppkey % 3 = 1 THEN 'uncertain' ELSE 'stratified' END AS strategy, l_partkey % 5 AS run, l_linenumber AS round, CASE WHEN l_discount >= 0.05 THEN 'Entails' ELSE 'Does not entail' END AS answer, round(l_tax, 2) AS f1 FROM lineitem",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Bytes of a file that one task reads, and of a shuffle, at most. The tables are packed so well that Spark's 128 and 64 MB
#: would be some ten and five million rows, all of which a task may hold where it joins them or makes them distinct.
SPLIT, SHUFFLED = 8 << 20, 16 << 20


def _small_tasks(spark: SparkSession) -> None:
    """Smaller shares of files and shuffles for a task in this session, unless it has as small ones."""
    for name, most in (("spark.sql.files.maxPartitionBytes", SPLIT), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED)):
        number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get(name).strip().lower()).groups()
        if int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] > most:
            spark.conf.set(name, str(most))


def needed(name: str) -> list[str]:
    """The views that a view or a query's text needs, inner ones first."""
    text, out = VIEWS.get(name, name), []
    for other in VIEWS:
        if other != name and re.search(rf"(?:FROM|JOIN)\s+{other}\b", text):
            out += [x for x in [*needed(other), other] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables, as a DataFrame."""
    _small_tasks(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = [*needed(name), name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(re.search(rf"\b{t}\b", VIEWS[v]) for v in own)}
    parts = [f"{v} AS ({VIEWS[v]})" for v in own[:-1]]
    text = (f"WITH {', '.join(parts)} " if parts else "") + VIEWS[name]
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(tables)})\b", r"\1 {\2}", text) if tables else text
    return spark.sql(text, **tables)


def oracle(text: str) -> str:
    """A query's SQL with the views that it reads before it."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in needed(text)]
    return f"WITH {', '.join(parts)} {text}" if parts else text
