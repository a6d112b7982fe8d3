"""Edge rows and intended meanings of the jobs."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import annotate, chem, components, entities, external, graph, kgc, literature, metrics, publish, report, taxonomy
from graphloom.sources import kg as S


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


ENT = "entity_id string, type string, name string, synonyms array<string>, other_db_ids map<string,array<string>>, part_id string"


def test_components_any_partitioning(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), (5, 4), (None, 7)]
    for parts in (1, 5):
        df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
        found = dict(rows(components.connected_components(df)))
        assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10, 20: 20}
    assert rows(components.connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_merge_entities(spark):
    stored = spark.createDataFrame(
        [
            ("e1", "chemical", "A", ["A", "alpha"], {"PubChem": ["1"]}, None),
            ("e2", "chemical", "B", ["B"], {"PubChem": ["2"]}, None),
            ("e3", "chemical", "M", ["M"], {"MESH": ["D1"]}, None),
            ("e4", "organism", "o", ["o"], {"NCBI_taxonomy": ["9"]}, "p0"),
        ],
        ENT,
    )
    new = spark.createDataFrame(
        [
            (None, "chemical", "join", ["ALPHA"], {"PubChem": ["1", "2"], "MESH": ["D1"]}, None),
            (None, "organism", "o leaf", [], {"NCBI_taxonomy": ["9"]}, "p1"),
            (None, "organism", "o leaf", [], {"NCBI_taxonomy": ["9"]}, "p1"),
        ],
        ENT,
    )
    merged, retired, mapping = entities.merge_entities(stored, new, retired_max=10)
    by = {r["entity_id"]: r for r in merged.collect()}
    assert set(by) == {"e1", "e3", "e4", "e11"}  # ids of retired entities are never used again
    assert by["e1"]["name"] == "A" and by["e1"]["synonyms"] == ["A", "ALPHA", "B", "join"]
    assert by["e1"]["other_db_ids"]["PubChem"] == ["1", "2"]
    assert by["e3"]["other_db_ids"] == {"MESH": ["D1"]}  # a MeSH-only chemical stays apart
    assert rows(retired, "entity_id", "reason") == [("e2", "Merged to e1")]
    kg = spark.createDataFrame([("e4", "r0", "e1"), ("e4", "r0", "e2")], S.TRIPLE)
    assert rows(entities.rewire_triples(kg, mapping)) == [("e4", "r0", "e1")]


def test_resolve_candidates_fails_without_one_match(spark):
    ents = spark.createDataFrame([("e1", "chemical", "A", [], {"PubChem": ["1"]}, None), ("e2", "chemical", "B", [], {"PubChem": ["1"]}, None)], ENT)
    rel = spark.createDataFrame([("r0", "contains", "c")], S.RELATIONS)
    for key in ("P:1", "P:9"):
        with pytest.raises(Exception, match="not one match"):
            entities.resolve_candidates(spark.createDataFrame([(key, "contains", key)], "head_key string, relation_name string, tail_key string"), ents, rel).collect()


def test_append_is_idempotent(spark):
    new = spark.createDataFrame([("e1", "r0", "e2", None, "t"), ("e1", "r0", "e2", None, "t"), ("e1", "r0", "e2", "7", "t")], S.TRIPLE + ", pmid string, source string")
    kg, ev = entities.append_triples(spark.createDataFrame([], S.TRIPLE), spark.createDataFrame([], S.EVIDENCE), new)
    assert kg.count() == 1 and ev.count() == 2
    kg2, ev2 = entities.append_triples(kg, ev, new)
    assert kg2.count() == 1 and ev2.count() == 2


def test_add_relations(spark):
    rel = spark.createDataFrame([("r0", "contains", "c")], S.RELATIONS)
    more = spark.createDataFrame([("contains", "c"), ("isA", "i")], "name string, translation string")
    assert rows(entities.add_relations(rel, more), "relation_id", "name") == [("r0", "contains"), ("r1", "isA")]
    with pytest.raises(ValueError):
        entities.add_relations(rel, spark.createDataFrame([("contains", "x")], "name string, translation string"))


def test_annotation_rules(spark):
    hits = spark.createDataFrame(
        [("1", "Äpfel have zinc", ["0|5|species|3750", "11|4|chemical|MESH:D9", "0|5|species|x1", "-1|3|chemical|MESH:D1", "0|0|chemical|MESH:D1", "1|2|3", "0|5|species|99", "11|4|chemical|None"]), ("2", "none", None)],
        "pmid string, text string, annotations array<string>",
    )
    allowed = spark.createDataFrame([("3750",)], "tax_id string")
    out = {r["pmid"]: r for r in literature.parse_annotations(hits, allowed).collect()}
    assert [tuple(o) for o in out["1"]["organisms"]] == [("Äpfel", "3750")] and [tuple(c) for c in out["1"]["chemicals"]] == [("zinc", "D9")]
    assert out["2"]["organisms"] == [] and literature.premises_with_both(literature.parse_annotations(hits, allowed)).count() == 1


def test_food_parts_and_phrases(spark):
    parts = spark.createDataFrame([("p1", "leaf", "leaves, foliage"), ("p2", "flower bud", None)], "part_id string, food_part string, food_part_synonyms string")
    text = spark.createDataFrame([("The flower bud and its foliage.",), ("Nothing",)], "premise string")
    assert rows(literature.food_parts_in_text(text, parts), "food_parts") == [([],), (["p1"],)]
    assert (["p1", "p2"],) in rows(literature.food_parts_in_text(text, parts, phrases=True), "food_parts")


def test_unanimous_labels_blank_fails(spark):
    good = spark.createDataFrame([("k", "Entails"), ("k", "Entails"), ("j", "Entails"), ("j", "Skip")], "key string, answer string")
    assert rows(annotate.unanimous_labels(good, ["key"])) == [("k", "Entails")]
    with pytest.raises(Exception, match="blank answer"):
        annotate.unanimous_labels(spark.createDataFrame([("k", " ")], "key string, answer string"), ["key"]).collect()


def test_split_and_folds_leak_nothing(spark):
    pairs = spark.range(600).select(F.format_string("p%d", F.col("id") % 50).alias("premise"), F.format_string("h%d", F.col("id") % 130).alias("hypothesis")).distinct()
    out = annotate.split_by_premise(pairs, 10, 10, 50).cache()
    hyp = {s: {r[0] for r in out.where(F.col("split") == s).select("hypothesis").collect()} for s in ("train", "val", "test")}
    assert not hyp["train"] & (hyp["val"] | hyp["test"]) and not hyp["val"] & hyp["test"]
    folds = annotate.kfold_by_premise(pairs, 7)
    assert folds.groupBy("premise").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r[0] for r in folds.select("premise", "fold").distinct().groupBy("fold").count().select("count").collect()]
    assert max(sizes) - min(sizes) <= 1


def test_stratified_bins_shrink(spark):
    pool = spark.createDataFrame([(i, i / 1000) for i in range(1000)] + [(5000, 1.0)], "k long, prob double").where("prob < 0.31 or prob > 0.9")
    assert annotate.stratified_bins(pool, 100) < 10
    out = annotate.al_batch(pool, 90, "stratified", ["k"])
    assert out.where("chosen").count() == 90


def test_numbered_is_consecutive(spark):
    df = spark.range(1000).repartition(7)
    assert [r[0] for r in annotate.numbered(df, [F.col("id")], "n").orderBy("id").select("n").collect()] == list(range(1000))


def test_enrich_and_cas(spark):
    compounds = spark.createDataFrame([("1", ["9-1"], ["D1"], ["Zinc"]), ("2", ["9-1"], [], ["Iron"])], "pubchem_id string, cas array<string>, mesh array<string>, synonyms array<string>")
    base = spark.createDataFrame([("D1", "n", "1", ["zinc"]), ("D2", "n", "1", ["zinc"]), ("D3", None, "1", ["zinc"]), ("D4", "n", None, ["zinc"]), ("D5", "n", "2", ["zinc"])], "mesh_id string, mesh_name string, pubchem_id string, tail_names array<string>")
    assert {r["mesh_id"] for r in chem.enrich_chemical(base, compounds).collect()} == {"D1", "D4", "D5"}
    assert {r["mesh_id"] for r in chem.enrich_chemical(base, compounds, predicted=True).collect()} == {"D1", "D4"}
    ext = spark.createDataFrame([("1", None), ("77", "9-1"), ("78", "0-0")], "tail_pubchem string, tail_cas string")
    assert sorted(r["compound"] for r in chem.cas_to_compound(ext, compounds).collect()) == ["1", "1", "2"]


def test_mesh_tree_backfill_matches_lists(spark):
    ents = spark.createDataFrame([("e1", "chemical", "A", [], {"MESH": ["D1", "D2"]}, None)], ENT)
    desc = spark.createDataFrame([("D1", "a", ["A1", "A2.3"], []), ("D2", "b", ["A1"], [])], "id string, name string, tree_numbers array<string>, terms array<string>")
    assert chem.mesh_tree_backfill(ents, desc).first()["other_db_ids"]["MESH_tree"] == ["A1", "A2.3"]


def test_names_groups_and_unknown(spark):
    ents = spark.createDataFrame([("e1", "organism", "own name", [], {"NCBI_taxonomy": ["1"]}, "p0"), ("e2", "organism", "kept", [], {"NCBI_taxonomy": ["2"]}, "p0"), ("e3", "chemical", "c", [], {"MESH": ["D1"]}, None)], ENT)
    sci = spark.createDataFrame([("1", "Malus")], "tax_id string, name_txt string")
    none = spark.createDataFrame([], "cid string, name string")
    mesh = spark.createDataFrame([], "id string, name string")
    parts = spark.createDataFrame([("p1", "leaf")], "part_id string, food_part string")
    assert dict(rows(publish.final_names(ents, none, mesh, sci, parts))) == {"e1": "Malus", "e2": "kept", "e3": "c"}
    tree = spark.createDataFrame([], "tree_number string, id string, name string")
    groups = spark.createDataFrame([], "tax_id string, group string, subgroup string")
    assert {r["group"] for r in publish.attach_groups(ents, tree, groups).collect()} == {"Unknown"}


def test_typed_by_rank_twice(spark):
    ents = spark.createDataFrame([("e1", "organism", "a", [], {"NCBI_taxonomy": ["1"]}, "p0")], ENT)
    ranks = spark.createDataFrame([("1", "species")], "tax_id string, rank string")
    once = taxonomy.typed_by_rank(ents, ranks)
    assert rows(taxonomy.typed_by_rank(once, ranks), "type") == [("organism:species",)]


def test_taxonomy_needs_one_scientific_name(spark):
    names = spark.createDataFrame([("1", "a", "common name")], "tax_id string, name_txt string, name_class string")
    with pytest.raises(Exception, match="scientific"):
        taxonomy.taxonomy_entities(spark.createDataFrame([("1",)], "tax_id string"), spark.createDataFrame([("1", "species")], "tax_id string, rank string"), names).collect()


def test_external_rules(spark):
    ext = spark.createDataFrame([("h", "t", None, "1", None, "1.0"), ("h", "t", "9", None, None, "1"), ("h", "t", "9", None, "c", "123.0")], "head string, tail string, head_ncbi_taxid string, tail_pubchem string, tail_cas string, reference_pmid string")
    assert rows(external.valid_external_rows(ext), "reference_pmid") == [("123",)]
    refs = spark.createDataFrame([(12, None, "r"), (99, "5", "s")], "reference_id int, pmid string, reference_name string")
    comp = spark.createDataFrame([("f", "12, x, 99, 7")], "food_id string, reference_ids string")
    assert rows(external.explode_references(comp, refs), "reference_id", "quality") == [(12, "low"), (99, "high")]
    with pytest.raises(Exception, match="no taxon"):
        spark.createDataFrame([("abc",)], "link string").select(external.taxon_of_link(F.col("link"))).collect()


@pytest.mark.parametrize(
    ("name", "query"),
    [("Malus domestica", "Malus domestica"), ("Malus", "INVALID_SCIENTIFIC_NAME"), ("M. domestica", "INVALID_SCIENTIFIC_NAME"), ("Malus x domestica", "CROSS_BREED"), ("Brassica oleracea L. var. italica", "Brassica oleracea var. italica"), ("Brassica rapa ssp chinensis (L.)", "Brassica rapa subsp. chinensis"), ("Malus domestica alba", "INVALID_SCIENTIFIC_NAME"), ("Beta vulgaris a.b L.", "INVALID_SCIENTIFIC_NAME"), ("Beta vulgaris L.", "Beta vulgaris"), ("Beta vulgaris convar. x.", "INVALID_SCIENTIFIC_NAME")],
)
def test_scientific_names(spark, name, query):
    assert spark.createDataFrame([(name,)], "n string").select(X.scientific_name_query(F.col("n"))).first()[0] == query


@pytest.mark.parametrize(("word", "one"), [("berries", "berry"), ("leaves", "leaf"), ("tomatoes", "tomato"), ("glass", "glass"), ("nuts", "nut"), ("citrus", "citrus"), ("boxes", "box")])
def test_singular(word, one):
    assert X.singular_word(word) == one


def test_compound_sections(spark):
    double = '{"Record":{"RecordTitle":"t","Section":[{"TOCHeading":"Names and Identifiers"},{"TOCHeading":"Names and Identifiers"}]}}'
    bare = '{"Record":{"RecordTitle":"t","Section":[]}}'
    fields = X.compound_fields(F.col("j"))
    out = spark.createDataFrame([(bare,)], "j string").select(*(v.alias(k) for k, v in fields.items())).first()
    assert out["name"] == "t" and out["cas"] == [] and out["synonyms"] == []
    with pytest.raises(Exception, match="several sections"):
        spark.createDataFrame([(double,)], "j string").select(fields["cas"]).collect()


def test_ensemble_without_its_mean(spark):
    runs = spark.createDataFrame([("a", 0.1), ("a", 0.5), ("a", 0.9), ("b", 0.2), ("b", None)], "k string, prob double")
    out = {r["k"]: r for r in metrics.ensemble_mean_std(runs, ["k"]).collect()}
    assert math.isclose(out["a"]["prob_std"], 0.4) and out["b"]["prob_mean"] is None


def test_curves_against_pairs(spark):
    data = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.9, 0), (0.9, 1), (0.95, 1)]
    auc = sum((p > n) + (p == n) / 2 for p, y in data if y for n, z in data if not z) / 12
    df = spark.createDataFrame([("g", *d) for d in data], "g string, score double, label int")
    assert math.isclose(metrics.roc_auc_ap(df, ["g"]).first()["roc_auc"], auc)
    best = max(sorted({s for s, _ in data}), key=lambda s: (2 * sum(y for p, y in data if p >= s) / (sum(p >= s for p, _ in data) + 4)))
    assert metrics.best_f1_threshold(df, ["g"]).first()["threshold"] == best


def test_t_distribution():
    assert math.isclose(metrics.t_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(metrics.t_two_sided(0.5, 3), 0.65145, rel_tol=1e-4)
    assert metrics.t_two_sided(0.0, 5) == 1.0


def test_metric_report_of_known_values(spark):
    values = spark.createDataFrame([("d", v) for v in (0.731, 0.735, 0.748, 0.719, 0.741)], "d string, f1 double")
    mean, std = 0.7348 * 100, 100 * math.sqrt(sum((v - 0.7348) ** 2 for v in (0.731, 0.735, 0.748, 0.719, 0.741)) / 5)
    assert metrics.metric_report(values, ["d"], ["f1"]).first()["f1"] == f"{mean:.2f}±{std:.2f}"


def test_negatives(spark):
    pos = spark.createDataFrame([(f"h{i % 7}", "r", f"t{i % 11}") for i in range(40)], S.TRIPLE).distinct()
    out = kgc.negative_samples(pos, pos)
    assert out.where("label = 0").count() == 2 * pos.count()
    assert out.where("label = 0").join(pos, ["head", "relation", "tail"], "left_semi").count() == 0
    full = spark.createDataFrame([("h0", "r", "t0")], S.TRIPLE)
    with pytest.raises(Exception, match="no unknown corruption"):
        kgc.negative_samples(full, full).collect()


def test_draws_from_the_complement(spark):
    """A hot key, keys without known ones, an end that is known with all but one, and draws that are to differ."""
    known = [(f"h{a:02}", "r", "hot") for a in range(40) if a != 7] + [(f"h{a:02}", "r", f"t{a % 5}") for a in range(40)]
    pool = spark.createDataFrame([(f"h{a:02}",) for a in range(40)], "e string")
    asked = spark.createDataFrame([("h03", "r", "hot"), ("h20", "r", "hot"), ("h01", "r", "t1"), ("h09", "q", "x")], S.TRIPLE)
    stored = spark.createDataFrame(known, S.TRIPLE)
    found = kgc.unknown_ends(asked, stored, "head", pool, draws=30).collect()
    assert len(found) == 120
    taken = {(h, r, t) for h, r, t in known}
    for row in found:
        assert (row["new"], row["relation"], row["tail"]) not in taken and row["new"] != row["head"]
    assert {r["new"] for r in found if r["tail"] == "hot"} == {"h07"}
    assert len({r["new"] for r in found if r["tail"] == "x"}) > 10  # spread over the free ones
    apart = kgc.unknown_ends(asked.where("tail <> 'hot'"), stored, "head", pool, draws=32, again=False).collect()
    for t, head in (("t1", "h01"), ("x", "h09")):
        new = [r["new"] for r in apart if r["tail"] == t]
        assert len(new) == len(set(new)) == 32 and all((n, "r", t) not in taken for n in new) and head not in new
    with pytest.raises(Exception, match="no unknown corruption"):
        kgc.unknown_ends(asked, stored, "head", pool, draws=2, again=False).collect()
    coin = kgc.coin_negatives(stored, stored, pool, draws=1).where("label = 0")
    assert coin.count() == stored.count() and coin.join(stored, ["head", "relation", "tail"], "left_semi").count() == 0


def test_ranks_among_all_entities(spark):
    """Many test triples of one relation and other end, small groups, ties, entities that only stand in one place."""
    known = {(f"e{a}", "r", "e0") for a in range(1, 30, 2)} | {(f"e{a}", "q", f"e{a * a % 13}") for a in range(20)}
    test = [x for x in sorted(known) if x[1] == "r"][:9] + [x for x in sorted(known) if x[1] == "q"][:5]
    number = lambda h, r, t: (int(h[1:]) * 7 + int(t[1:]) * 3 + len(r)) % 11 / 11
    scorer = lambda f: [number(*x) for x in f.itertuples(index=False)]
    names = [f"e{a}" for a in range(40)]
    want = set()
    for h, r, t in test:
        own = number(h, r, t)
        want.add((h, r, t, "head", 1 + sum(number(e, r, t) > own for e in names if (e, r, t) not in known)))
        want.add((h, r, t, "tail", 1 + sum(number(h, r, e) > own for e in names if (h, r, e) not in known)))
    frames = spark.createDataFrame(test, S.TRIPLE), spark.createDataFrame([(e,) for e in [*names, names[0], None]], "e string"), spark.createDataFrame(sorted(known), S.TRIPLE)
    for group in (3, 2_000):
        assert set(rows(metrics.entity_ranks(*frames, scorer, group=group), "head", "relation", "tail", "side", "rank")) == want


def test_phrases_of_any_length(spark):
    from graphloom.operators import phrases

    texts = [(1, "the young leaves of the old olive tree are bitter"), (2, "olive leaves"), (3, ""), (4, None), (5, "leaves of the old olive tree of the"), (6, "a a a b")]
    asked = ["leaves", "leaves of the old olive tree", "young leaves of the old olive tree are", "old olive", "olive old", "the", "a a b", "a b a", "", None, "leaves"]
    t = spark.createDataFrame(texts, "key long, text string")
    p = spark.createDataFrame([(x,) for x in asked], "p string")
    spaced = lambda x: f" {x} "
    want = {(k, x) for k, s in texts for x in asked if s and x and spaced(x) in spaced(s)}
    tokens = t.select("key", F.coalesce(F.filter(F.split("text", " "), lambda x: x != ""), F.array().cast("array<string>")).alias("tokens"))
    assert set(rows(phrases.phrases_in_tokens(tokens, p), "key", "phrase")) == want
    parts = ["OLIVE T", "ea", "s", "xyz", "a a ", "leaves of the old olive tree of the", "", None, "bitter!"]
    got = set(rows(phrases.phrases_in_text(t, spark.createDataFrame([(x,) for x in parts], "p string")), "key", "phrase"))
    assert got == {(k, x.lower()) for k, s in texts for x in parts if s and x and x.lower() in s}
    kept = report.without_phrases(t.withColumn("n", F.lit(1)), spark.createDataFrame([("TREE",), ("a b",)], "p string"), "text")
    assert sorted(r["key"] for r in kept.collect()) == [2, 3, 4]
    premises = spark.createDataFrame([("eat the young leaves of the tree now",)], "premise string")
    names = spark.createDataFrame([("p1", "young leaves of the tree", ""), ("p2", "old leaves", None)], "part_id string, food_part string, food_part_synonyms string")
    assert literature.food_parts_in_text(premises, names, phrases=True).first()["food_parts"] == ["p1"]


def test_closeness_by_sketches(spark):
    """Chains, a hub, two parts that do not meet, a loop: near the search, and exact where the graph is small."""
    data = [(f"a{k}", f"a{k + 1}") for k in range(8)] + [(f"h{k}", "a0") for k in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), ("a3", "a1")]
    kg = spark.createDataFrame(data, "head string, tail string")
    exact, near = (dict(rows(f(kg))) for f in (graph.closeness_centrality, graph.closeness_sketched))
    assert exact.keys() == near.keys()
    for node, value in exact.items():
        assert near[node] == pytest.approx(value, rel=0.05, abs=1e-9), node
    with pytest.raises(ValueError):
        graph.closeness_sketched(kg, max_rounds=3)


@pytest.mark.parametrize("most", [4, 1 << 18])
def test_isotonic_blocks_over_tasks(spark, most):
    """Rising, falling and noisy labels, ties, scores between and beyond the fitted ones, nulls."""
    import random

    import numpy as np

    rng = random.Random(most)
    for shape in ("rising", "falling", "noisy"):
        points = [(round(rng.random(), 2), {"rising": lambda s: s, "falling": lambda s: 1 - s, "noisy": lambda s: float(rng.random() < s)}[shape]) for _ in range(60)]
        points = [(s, f(s)) for s, f in points]
        fit = spark.createDataFrame([(y, s) for s, y in points] + [(None, 0.5), (1.0, None)], "label double, score double")
        blocks = sorted(tuple(r) for r in metrics.isotonic_blocks(fit, most=most).select("lo", "hi", "y", "w").collect())
        xs = sorted({s for s, _ in points})
        y, w = (np.array([f([v for s, v in points if s == x]) for x in xs], float) for f in (sum, len))
        want = [tuple(map(float, b)) for b in zip(*metrics.pool_adjacent(np.array(xs), np.array(xs), y, w))]
        assert [b[:2] for b in blocks] == [b[:2] for b in want] and [b[2] / b[3] for b in blocks] == pytest.approx([b[2] / b[3] for b in want])
        means = [b[2] / b[3] for b in blocks]
        asked = [-1.0, 2.0, None, *xs, *(x + 0.003 for x in xs)]
        got = {r["k"]: r["prob"] for r in metrics.isotonic_calibrate(fit, spark.createDataFrame(list(enumerate(asked)), "k long, score double"), most=most).collect()}
        ends = [e for b in blocks for e in b[:2]]
        for k, x in enumerate(asked):
            assert got[k] is None if x is None else got[k] == pytest.approx(float(np.interp(x, ends, np.repeat(means, 2))), abs=1e-9), (shape, x)
    none = metrics.isotonic_calibrate(fit.limit(0), spark.createDataFrame([(1, 0.5)], "k long, score double"))
    assert none.first()["prob"] is None


def test_splits_that_outlive_a_run(spark, tmp_path):
    from graphloom.operators.stores import SplitLedger

    t = spark.createDataFrame([(f"h{i}", "r", f"t{i % 9}") for i in range(100)], S.TRIPLE)
    more = t.unionByName(spark.createDataFrame([(f"h{i}", "r", "new") for i in range(41)], S.TRIPLE))
    ledger = SplitLedger(spark, str(tmp_path / "splits"), buckets=2)
    assert ledger.deal("a", t) and not ledger.deal("a", more)
    first = set(rows(ledger.splits(), "head", "relation", "tail", "split"))
    assert len(first) == 100 and sum(x[3] == "train" for x in first) == 70
    again = SplitLedger(spark, str(tmp_path / "splits"))
    assert again.deal("b", more)
    second = set(rows(again.splits(), "head", "relation", "tail", "split"))
    assert first <= second and len(second) == 141 and sum(x[3] == "val" for x in second - first) == 6
    held = {x[0] for x in second if x[3] != "train"}
    taxa = spark.createDataFrame([(f"h{i}", str(i)) for i in range(100)] + [(f"p{i}", str(i)) for i in range(100)], "entity_id string, tax_id string")
    parts = spark.createDataFrame([(f"p{i}", "r", "t0") for i in range(100)], S.TRIPLE)
    others = spark.createDataFrame([("a", "isA", "b")], S.TRIPLE)
    train = set(rows(again.training_set(parts, others, taxa)))
    assert {x[0] for x in train if x[0][0] == "p"} == {f"p{i}" for i in range(100) if f"h{i}" not in held}
    assert ("a", "isA", "b") in train and not train & {x[:3] for x in second if x[3] != "train"}
    with pytest.raises(ValueError):
        again.training_set(parts, spark.createDataFrame([x[:3] for x in second if x[3] == "test"][:1], S.TRIPLE), taxa)


def test_source_sketches(spark, tmp_path):
    from graphloom.operators.stores import SourceSketches

    sets = {"a": set(range(3000)), "b": set(range(2000, 6000)), "c": set(range(2500, 2600)) | set(range(9000, 9100))}
    ev = spark.createDataFrame([(s, str(k)) for s, ks in sets.items() for k in ks] + [("a", None), (None, "1")], "source string, pmid string")
    want = {m: len({k for k in range(9100) if all((k in sets[n]) == bool(m >> i & 1) for i, n in enumerate("abc"))}) for m in range(1, 8)}
    for log_entries, error in ((14, 0.0), (9, 3 / 2**4.5)):
        store = SourceSketches(spark, str(tmp_path / f"s{log_entries}"), log_entries, buckets=2)
        for name, part in (("x", "cast(pmid as int) % 2 = 0 or pmid is null"), ("y", "cast(pmid as int) % 3 < 2"), ("z", "true"), ("z", "true")):
            store.update(name, ev.where(part), key=["pmid"])
        got = dict(rows(store.regions(["a", "b", "c"])))
        assert got.keys() == want.keys() and all(abs(got[m] - want[m]) <= error * 6200 for m in want)
        assert all(abs(n - len(sets[s])) <= error * len(sets[s]) for s, n in rows(store.counts()))
        assert dict(rows(store.regions(["a", "none"]))) == {1: dict(rows(store.counts()))["a"], 2: 0, 3: 0}


def test_gml_file(spark, tmp_path):
    from graphloom.sources import gml

    nodes = spark.createDataFrame([("e1", 'a "b"\nc', "chemical"), ("e20", None, "organism")], "Id string, Label string, Type string")
    edges = spark.createDataFrame([("e1", "e20", "contains"), ("e20", "e1", "isA")], "Source string, Target string, Label string")
    path = tmp_path / "graph.gml"
    for _ in range(2):  # the second takes the first one's place
        gml.write_gml(nodes.repartition(3), edges.repartition(2), str(path))
    text = path.read_text()
    assert text.startswith("graph [\n  directed 1\n  node [") and text.endswith("]\n") and text.index("edge [") > text.rindex("node [")
    assert text.count("[") == text.count("]") and not [p for p in tmp_path.iterdir() if p.name not in ("graph.gml", ".graph.gml.crc")]
    got = gml.read_gml(spark, str(path))
    assert rows(got[0]) == [(1, "a 'b' c", "chemical"), (20, "", "organism")] and rows(got[1]) == [(1, 20, "contains"), (20, 1, "isA")]


def test_dropped_rows_are_counted(spark):
    from pyspark.sql import Observation

    compounds = spark.createDataFrame([("1", ["x"]), ("2", ["x", "y"]), ("3", [])], "pubchem_id string, cas array<string>")
    data = [("1", "y"), ("9", "x"), (None, "y"), ("9", "z"), (None, None), ("9", None), ("1", "y")]
    asked = spark.createDataFrame(data, "tail_pubchem string, tail_cas string")
    counts = Observation("c")
    got = chem.cas_to_compound_counted(asked, compounds, counts)
    assert rows(got.fillna("")) == rows(chem.cas_to_compound(asked, compounds).fillna(""))
    assert counts.get == {"rows": 7, "by_id": 2, "by_cas": 2, "without_number": 1, "unknown_number": 2}


def test_scopes_of_threads(spark):
    """A scope that ends removes its own tables, not those that another thread writes meanwhile."""
    import threading

    from graphloom.sources.written import scope, stash

    held, inside, done = [], threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        held.append(stash(spark.range(3), "other"))
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scope(spark) as keep:
        gone, kept = stash(spark.range(5), "gone"), keep(stash(spark.range(4), "kept"))
        inside.set()
        done.wait(60)
    thread.join()
    assert held[0].count() == 3 and kept.count() == 4
    with pytest.raises(Exception):
        gone.count()


def test_literals_of_the_older_text_form(spark):
    lists = [[], ["a"], ["it's", 'say "x"', "back\\slash", "a\xa0b", "\\x41", "tab\t", "é, [b]", "{'k': 1}"], ["'"], ['"', "'\""]]
    cells = spark.createDataFrame([(i, repr(x), repr({"k": x, "it's": ["1"]})) for i, x in enumerate(lists)] + [(9, "", None)], "i int, l string, m string")
    got = {r["i"]: r for r in cells.select("i", S.decode_list(F.col("l"), True).alias("l"), S.decode_ids(F.col("m"), True).alias("m")).collect()}
    assert [got[i]["l"] for i in range(len(lists))] == lists and got[9]["l"] is None and got[9]["m"] is None
    assert [got[i]["m"] for i in range(len(lists))] == [{"k": x, "it's": ["1"]} for x in lists]


def test_splits_disjoint(spark):
    t = spark.createDataFrame([(f"h{i}", "r", "t") for i in range(101)], S.TRIPLE)
    s = kgc.split_triples(t).cache()
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 16}
    with pytest.raises(ValueError):
        kgc.assert_disjoint(s, s)


def test_centralities(spark):
    star = spark.createDataFrame([("b", "r", "a"), ("c", "r", "a"), ("d", "r", "c")], S.TRIPLE)
    close = dict(rows(graph.closeness_centrality(star)))
    assert math.isclose(close["a"], 3 / 4) and close["b"] == 0 and math.isclose(close["c"], 1 / 3)
    ring = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a")], S.TRIPLE)
    assert all(math.isclose(v, 1 / math.sqrt(3), abs_tol=1e-6) for v in dict(rows(graph.eigenvector_centrality(ring))).values())


def test_platt_and_isotonic(spark):
    data = spark.createDataFrame([(i / 100, int(i > 50)) for i in range(100)], "score double, label int")
    iso = [r["prob"] for r in metrics.isotonic_calibrate(data, data).orderBy("score").collect()]
    assert iso == sorted(iso) and iso[0] == 0 and iso[-1] == 1
    platt = [r["prob"] for r in metrics.platt_calibrate(data, data).orderBy("score").collect()]
    assert platt == sorted(platt)


def test_sources(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Zinc</String></DescriptorName><TreeNumberList><TreeNumber>A1</TreeNumber><TreeNumber>A2.1</TreeNumber></TreeNumberList><ConceptList><Concept><TermList><Term><String>Zn</String></Term></TermList></Concept></ConceptList></DescriptorRecord></Set>")
    (tmp_path / "s.xml").write_text("<Set><SupplementalRecord><SupplementalRecordUI>C1</SupplementalRecordUI><SupplementalRecordName><String>zincate</String></SupplementalRecordName><HeadingMappedToList><HeadingMappedTo><DescriptorReferredTo><DescriptorUI>*D1</DescriptorUI></DescriptorReferredTo></HeadingMappedTo></HeadingMappedToList><ConceptList><Concept><TermList><Term><String>x</String></Term></TermList></Concept></ConceptList></SupplementalRecord></Set>")
    d = S.read_mesh_descriptors(spark, str(tmp_path / "d.xml")).first()
    assert (d["id"], d["name"], d["tree_numbers"], d["terms"]) == ("D1", "Zinc", ["A1", "A2.1"], ["Zn"])
    assert S.read_mesh_supplements(spark, str(tmp_path / "s.xml")).first()["heading_ids"] == ["D1"]
    for run in (1, 2):
        folder = tmp_path / f"shards/run_{run}"
        folder.mkdir(parents=True)
        (folder / "p.tsv").write_text("row_key\tprob\nk1\t0.5\n")
    assert rows(S.read_prediction_shards(spark, str(tmp_path / "shards/*/p.tsv"))) == [("k1", 1, 0.5), ("k1", 2, 0.5)]
    (tmp_path / "ids.csv").write_text("pmcid,pmid\nPMC1,7\nPMC2,\n")
    assert rows(S.read_id_map(spark, str(tmp_path / "ids.csv")).na.fill("-")) == [("PMC1", "7"), ("PMC2", "-")]
    (tmp_path / "latin.csv").write_bytes("name,g\nA\xe7a\xed,1\n".encode("latin-1"))
    assert S.read_food_csv(spark, str(tmp_path / "latin.csv")).first()["name"] == "Açaí"
    (tmp_path / "x.tsv").write_text("head\ttail\na\t\n")
    assert S.read_external_triples(spark, str(tmp_path / "x.tsv")).first()["tail"] is None
    (tmp_path / "l.dmp").write_text("9\t|\t1 2 3 \t|\n")
    assert S.read_taxdump(spark, str(tmp_path / "l.dmp"), "lineage").first()["lineage"] == ["1", "2", "3"]
    assert S.read_kg(spark, str(tmp_path / "none"), "kg").count() == 0
    with pytest.raises(ValueError):
        S.check_columns(spark.range(1), ["a"])


def test_stream_appends_once(spark, tmp_path):
    from graphloom.operators.stores import TripleStore
    from graphloom.streaming.appending import append_stream

    data = [("e1", "r0", "e2", "7"), ("e1", "r0", "e2", "7"), ("e1", "r0", "e3", "8")]
    folder, source = str(tmp_path / "kg"), str(tmp_path / "in")
    for more in ([], [("e1", "r0", "e3", "8"), ("e1", "r0", "e3", "9")]):
        spark.createDataFrame(more or data, S.TRIPLE + ", pmid string").write.mode("append").parquet(source)
        arriving = spark.readStream.schema(S.TRIPLE + ", pmid string").parquet(source)
        append_stream(arriving, folder, str(tmp_path / "check")).awaitTermination(60)
    store = TripleStore(spark, folder)
    assert rows(store.evidence(), "tail", "pmid") == [("e2", "7"), ("e3", "8"), ("e3", "9")]
    assert store.kg().count() == 2
    assert sorted(r.count() for r in store.store.runs("evidence")) == [1, 2]  # a batch wrote its own rows and no others


def test_triple_store(spark, tmp_path):
    """Two appends, a replay, one that fails after its first run, a store that is opened again, compaction, odd rows."""
    from graphloom.operators.stores import TripleStore

    schema = S.TRIPLE + ", pmid string, premise string, extra int"
    first = spark.createDataFrame([("e1", "r0", "e2", None, "t", 1), ("e1", "r0", "e2", None, "t", 2), ("e1", "r0", "e2", "7", "t", 3), (None, "r0", None, None, None, 4)], schema)
    second = spark.createDataFrame([("e1", "r0", "e2", "7", "t", 1), ("e3", "r0", "e2", "7", "t", 1), ("e1", "r0", "e2", "8", "t", 1), (None, "r0", None, None, None, 4)], schema)
    store = TripleStore(spark, str(tmp_path / "kg"), buckets=3)
    assert store.append("a", first) and not store.append("a", second)
    write = store.store._publish
    store.store._publish = lambda listing: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.append("b", second)
    assert store.evidence().count() == 3 and len(store.store._children("runs")) == 4
    store.store._publish = write
    assert store.append("b", second)
    again = TripleStore(spark, str(tmp_path / "kg"))
    again.store.sweep()
    assert len(again.store._children("runs")) == 4 and not again.append("b", first)
    whole = entities.append_triples(*entities.append_triples(spark.createDataFrame([], S.TRIPLE), spark.createDataFrame([], S.EVIDENCE), first), second)
    as_text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert as_text(again.kg()) == as_text(whole[0]) and as_text(again.evidence()) == as_text(whole[1])
    again.append("c", second.limit(0))
    for table in ("kg", "evidence"):
        again.store.compact(table)
        assert len(again.store.runs(table)) == 1
    assert as_text(TripleStore(spark, str(tmp_path / "kg")).evidence()) == as_text(whole[1])


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    from graphloom.operators.stores import TripleStore

    store = TripleStore(spark, str(tmp_path / "kg"), buckets=4)
    for k in range(2):
        store.append(str(k), spark.createDataFrame([(f"e{i}", "r0", f"e{i * k}") for i in range(50)], S.TRIPLE))
    batch = spark.createDataFrame([("e1", "r0", "e9")], S.TRIPLE).withColumn("row_mark", F.md5("tail"))
    for asked in (store.store.absent("evidence", batch), store.store.held("evidence", batch.select("row_mark"))):
        asked.collect()
        plan = asked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        stored = [line for line in plan.split("\n") if "Scan parquet" in line and "run_" in line]
        assert len(stored) == 2 and all("SelectedBucketsCount: 4" in line or "Bucketed: true" in line for line in stored)
        # The batch is hashed to the buckets; nothing but what a null mark needs stands between a stored scan and its join.
        assert plan.count("Exchange hashpartitioning") == plan.count("hashpartitioning(row_mark") <= 2
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


CANDIDATES = "type string, name string, synonyms array<string>, other_db_ids map<string,array<string>>, part_id string"


def test_entities_merged_batch_by_batch(spark, tmp_path):
    """Each batch gives what a merge with the whole stored table gives, and only writes what its keys meet."""
    import random

    from graphloom.operators.stores import EntityStore

    rng = random.Random(4)
    store, stored, last = EntityStore(spark, str(tmp_path / "entities"), buckets=3), spark.createDataFrame([], ENT), 0
    as_text = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for k in range(3):
        data = [("chemical", f"c{k}-{i}", [f"s{rng.randrange(9)}"], {"PubChem": [str(rng.randrange(40)) for _ in range(rng.choice([1, 1, 2, 3]))], "MESH": [f"D{i}"]}, None) for i in range(12)]
        data += [("chemical", f"m{i}", [], {"MESH": [f"D{rng.randrange(30)}"]}, None) for i in range(3)] + [("organism", f"o{k}", ["O"], {"NCBI_taxonomy": ["9"]}, "p0")] * 2
        batch = spark.createDataFrame(data, CANDIDATES)
        before = {r["entity_id"]: str(r) for r in store.entities().collect()}
        assert store.append(str(k), batch) and not store.append(str(k), batch)
        whole, retired, _ = entities.merge_entities(stored, batch, last)
        assert as_text(store.entities()) == as_text(whole)
        last = max([last, *(int(r[0][1:]) for r in whole.select("entity_id").collect())])
        stored = spark.createDataFrame(whole.collect(), ENT)
        written = {r["entity_id"] for r in store.store.runs("entities")[-1].collect()}
        keys = {f"P:{c}" for x in data for c in x[3].get("PubChem", [])} | {f"M:{c}" for x in data if "PubChem" not in x[3] for c in x[3].get("MESH", [])} | {"O:9-p0"}
        for r in store.entities().collect():
            own = {f"P:{c}" for c in r["other_db_ids"].get("PubChem", [])} or {f"M:{c}" for c in r["other_db_ids"].get("MESH", [])} or {"O:9-p0"}
            assert own & keys if r["entity_id"] in written else before[r["entity_id"]] == str(r)
        assert {r["entity_id"] for r in retired.collect()} <= {r["entity_id"] for r in store.retired().collect()}
    assert len(written) < store.entities().count()  # the last batch left some alone
    again = EntityStore(spark, str(tmp_path / "entities"))
    for table in ("keys", "entities"):
        again.store.compact(table)
    assert as_text(again.entities()) == as_text(stored)


def test_equal_hits_stay_apart(spark):
    hit = ("7", "apple has sugar", ["0|5|species|1", "10|5|chemical|MESH:D1"])
    hits = spark.createDataFrame([hit, hit, ("8", "apple has sugar", ["0|5|species|2"]), ("9", "none", None)], "pmid string, text string, annotations array<string>")
    out = literature.parse_annotations(hits, spark.createDataFrame([("1",)], "tax_id string"))
    got = [(r["pmid"], [tuple(x) for x in r["organisms"]], [tuple(x) for x in r["chemicals"]]) for r in out.collect()]
    assert sorted(got) == [("7", [("apple", "1")], [("sugar", "D1")])] * 2 + [("8", [], []), ("9", [], [])]
    premises = spark.createDataFrame([("a leaf here",), ("a leaf here",), ("nothing",), (None,)], "premise string")
    parts = spark.createDataFrame([("p1", "leaf", "leaves, blade")], "part_id string, food_part string, food_part_synonyms string")
    got = sorted((r["premise"] or "", r["food_parts"]) for r in literature.food_parts_in_text(premises, parts).collect())
    assert got == [("", []), ("a leaf here", ["p1"]), ("a leaf here", ["p1"]), ("nothing", [])]


def test_centralities_that_do_not_end(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(12)], "head int, tail int")
    with pytest.raises(ValueError):
        graph.closeness_centrality(path, max_rounds=5).collect()
    whole = dict(rows(graph.closeness_centrality(path, max_rounds=12)))
    assert whole[12] == pytest.approx(12 / sum(range(1, 13)))
    with pytest.raises(ValueError):
        graph.eigenvector_centrality(path, max_rounds=2)


@pytest.mark.parametrize("parts", [1, 6])
def test_fdr_of_large_and_small_families(spark, parts):
    import random

    rng = random.Random(3)
    data = [("big", k, rng.random()) for k in range(300)] + [(f"f{k % 7}", 1000 + k, round(rng.random(), 1)) for k in range(60)] + [(None, 2000, 0.5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(data, "g string, k long, p_value double").repartition(parts)
    got = {(r["g"], r["k"]): r["p_adjusted"] for r in metrics.fdr_adjust(df, ["g"]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data)
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: (d[2], d[1]))
        least = 1.0
        for i in range(len(own), 0, -1):
            least = min(least, own[i - 1][2] * len(own) / i)
            assert got[g, own[i - 1][1]] == pytest.approx(least)


def test_unknown_pairs_by_groups(spark):
    kg = spark.createDataFrame([(f"h{k % 9}", "r", f"t{(k * k) % 11}") for k in range(40)] + [("h1", "q", "t99")], "head string, relation string, tail string")
    heads, tails = {f"h{k % 9}" for k in range(40)}, {f"t{(k * k) % 11}" for k in range(40)}
    known = {(f"h{k % 9}", f"t{(k * k) % 11}") for k in range(40)}
    for group in (2, 2_000):
        out = rows(kgc.candidate_hypotheses(kg, "r", group=group), "head", "tail")
        assert out == sorted((h, t) for h in heads for t in tails if (h, t) not in known)


def test_negatives_of_a_dense_relation(spark):
    known = [(f"h{a}", "r", f"t{b}") for a in range(6) for b in range(6) if (a, b) not in ((0, 5), (5, 0))]
    positives = spark.createDataFrame([("h0", "r", "t0")] + [(f"h{a}", "q", f"t{a}") for a in range(6)], "head string, relation string, tail string")
    out = kgc.negative_samples(positives, spark.createDataFrame(known, "head string, relation string, tail string"), draws=1)
    labels = rows(out, "relation", "head", "tail", "label")
    assert len(labels) == 3 * 7
    assert {x[:3] for x in labels if x[0] == "r" and x[3] == 0} == {("r", "h5", "t0"), ("r", "h0", "t5")}


def test_legacy_folder(spark, tmp_path):
    (tmp_path / "entities.txt").write_text(
        "old_id\ttype\tname\tsynonyms\tother_db_ids\n"
        "e1\torganism_with_part\to - leaf\t['a', \"b's\"]\t{'NCBI_taxonomy': '9', 'own_part_id': 'p1'}\n"
        "e2\tchemical\tc\t[]\t{'PubChem': ['1', '2']}\n"
    )
    read = S.read_legacy_kg(spark, str(tmp_path), "entities")
    got = {r["entity_id"]: (r["synonyms"], r["other_db_ids"], r["part_id"]) for r in read.collect()}
    assert got == {"e1": (["a", "b's"], {"NCBI_taxonomy": ["9"]}, "p1"), "e2": ([], {"PubChem": ["1", "2"]}, None)}
    S.write_legacy_kg(str(tmp_path / "again"), part_key="part_id", entities=read)
    again = S.read_legacy_kg(spark, str(tmp_path / "again"), "entities")
    assert {r["entity_id"]: (r["synonyms"], r["other_db_ids"], r["part_id"]) for r in again.collect()} == got
    assert S.read_legacy_kg(spark, str(tmp_path), "kg").count() == 0
    (tmp_path / "relations.txt").write_text("wrong\tcolumns\nx\ty\n")
    with pytest.raises(ValueError):
        S.read_legacy_kg(spark, str(tmp_path), "relations")


def test_components_of_rows_with_several_keys(spark):
    listed = [("a", ["k1", "k2"]), ("b", ["k2", "k3"]), ("c", ["k3"]), ("d", ["k9"]), ("e", []), ("f", ["k8", "k7"]), ("g", ["k7"])]
    found = entities.duplicate_components(spark.createDataFrame(listed, "row_id string, keys array<string>"))
    assert dict(rows(found)) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "f"}


def test_scope_removes_what_was_written(spark):
    from pathlib import Path

    from graphloom.sources.written import scope, shared_folder, stash

    folder = Path(shared_folder(spark).removeprefix("file:")) / "graphloom"
    with scope(spark):
        with scope(spark) as keep:
            stash(spark.range(3), "scoped")
            held = keep(stash(spark.range(4), "scoped"))
            assert len(list(folder.glob("scoped-*"))) == 2
        assert len(list(folder.glob("scoped-*"))) == 1 and held.count() == 4
    assert not list(folder.glob("scoped-*"))


def test_evidence_order_and_regions(spark):
    ev = spark.createDataFrame([("e1", "r", "e10", "p", "h", "D1", "low", 0.4), ("e1", "r", "e2", "p", "h", "D1", "high", None), ("e1", "r", "e9", "p", "h", None, "low", 0.4), ("e1", "r", "e9", "p", "h", None, "low", 0.4)], "head string, relation string, tail string, premise string, hypothesis string, mesh_id string, quality string, prob_mean double")
    assert [r["tail"] for r in report.evidence_order(ev).collect()] == ["e2", "e9", "e9"]
    sets = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1)], "k string, s int")
    assert rows(report.venn_regions(sets, ["k"], "s", 2)) == [(2, 1), (3, 1)]
