"""Jaccard join, whitening and cross-tokenizer alignment against brute force, with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import alignment, decontamination, jaccard, simhash, whitening, windows
from graphloom.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, id long, key string, n long, group string, row long, pairs string"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, size=4):
    w = WORD.findall(lowered(t))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(texts, percent=85):
    """(doc_id, set size, component) of each row, by comparing all."""
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return collections.Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(texts, sets)))


def near_texts(rng, groups=12, copies=8):
    """Chains of edited copies, some within the threshold and some just beyond it; a passage that many share; odd rows."""
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for g in range(groups):
        words = rng.choices(vocabulary, k=rng.choice([6, 20, 60, 200]))
        for _ in range(copies):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(words) // 40)])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    out += [f"{' '.join(rng.choices(vocabulary, k=30))} {passage} {' '.join(rng.choices(vocabulary, k=30))}" for _ in range(20)]
    out += ["", None, " \t\n", "one", "ONE", "two words", "Two  Words", "a b c d", "a b c d", "a b c d a b c d", "é ü ñ ö", "x" * 500, "x" * 500 + " y", None]
    texts = [(i, t) for i, t in enumerate(out)]
    return [*texts, texts[3], (None, out[0]), (None, "only here and nowhere else"), (None, "")]


@pytest.mark.parametrize("cell", [3, jaccard.CELL_SETS])
def test_jaccard_components(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL_SETS", cell)
    monkeypatch.setattr(jaccard, "STEP_PAIRS", 50 if cell == 3 else jaccard.STEP_PAIRS)
    texts = near_texts(random.Random(11))
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in texts], DOCS).repartition(3)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect())
    assert got == components(texts)
    assert sum(a != c for a, _, c in got) > 30


def test_jaccard_without_documents(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard.jaccard_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_filters_lose_no_link():
    """Sizes, places, sketches and hash orders let every pair through that links, and stop most that share little."""
    rng = random.Random(3)
    passed = []
    for share in (0.1, 0.5, 0.8, 0.85, 0.9, 0.97, 1.0):
        for _ in range(40):
            n = rng.choice([1, 2, 7, 30, 150, 600])
            common = {rng.getrandbits(64) for _ in range(max(1, round(n * share)))}
            a, b = (np.array(sorted(common | {rng.getrandbits(64) for _ in range(n - len(common))}), np.uint64) for _ in range(2))
            both = len(set(a.tolist()) & set(b.tolist()))
            links = 100 * both >= 85 * (len(a) + len(b) - both)
            grams, counts = np.concatenate([a, b]), np.array([len(a), len(b)])
            prefixes, sketch = jaccard.hash_prefixes(grams, counts, 85), jaccard.parity_sketches(grams, counts)
            sizes = counts[:1], counts[1:]
            orders = bool(jaccard.pass_orders(*sizes, prefixes[:1], prefixes[1:], 85)[0])
            near = bool(jaccard.near_sketches(*sizes, sketch[:1], sketch[1:], 85)[0])
            assert not links or orders and near and both >= jaccard.least_overlap(*sizes, 85)[0]
            passed.append((share, n, links, orders, near))
    few = [x for x in passed if x[0] <= 0.1 and x[1] >= 150]
    assert few and not any(x[3] for x in few) and not any(x[4] for x in few)


def whitened_plainly(vectors):
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return x, n, s, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("size", [5, 24])
def test_whitening(spark, size):
    rng = np.random.default_rng(size)
    vectors = (rng.standard_normal((300, size)) * np.logspace(0, -1, size)).astype(np.float32)
    vectors[50:60] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[3].tolist()), (7, vectors[4].tolist())]
    odd = [(900, None), (901, [None] * size), (902, [float("nan")] * size), (903, [float("inf")] + [0.0] * (size - 1)), (904, [0.0] * (size + 1)), (905, []), (906, [1e30] + [0.0] * (size - 1))]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, x string").repartition(4)
    out = whitening.whiten(df).toPandas()
    x, n, s, e, v = whitened_plainly(vectors)
    count = min(size, 16)
    assert len(out) == len(rows) * count and out.identity_error.max() < 1e-9 and set(out.n) == {n}
    own = {i: np.array(w) for i, w in rows if i is not None and i != 7}
    for c in range(1, count + 1):
        part = out[(out.component == c) & out.vec_id.isin(list(own))].set_index("vec_id")
        assert part.explained.iloc[0] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        want = ((n * x - s) / n) @ v[:, c - 1] / np.sqrt(e[c - 1])
        got = part.whitened.loc[sorted(own)].to_numpy()
        want = want[sorted(own)]
        assert np.abs(got - want * np.sign(got @ want)).max() < 1e-7
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)) for i in own}
    assert all(exact[r.vec_id] == r.deviation for r in out[out.vec_id.isin(list(own))].itertuples())


def test_whitening_of_few_and_equal_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)).toPandas()
    assert set(line.component) == {1} and line.explained.iloc[0] == pytest.approx(1) and line.identity_error.max() < 1e-9
    # One-hot vectors: all eigenvalues but one are equal, so that every chain ends after a few steps.
    hot = whitening.whiten(spark.createDataFrame([(i, [float(i == k) for k in range(9)]) for i in range(9)], schema)).toPandas()
    assert len(hot) == 9 * 8 and hot.identity_error.max() < 1e-9 and hot.explained.max() == pytest.approx(1 / 8)


def test_bidiagonalisation_settles_with_fewer_steps():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 40)) * np.concatenate([[50, 30, 20], np.full(37, 0.01)])
    product = lambda p: ((u := x @ p) @ x, float(u @ u))
    values, right = whitening.bidiagonalise(product, 40, float((x**2).sum()), 3, steps=12)
    want = np.linalg.svd(x, compute_uv=False)
    assert values[:3] == pytest.approx(want[:3], rel=1e-10) and np.abs(right.T @ right - np.eye(right.shape[1])).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.bidiagonalise(lambda p: ((u := x[:, :30] @ p) @ x[:, :30], float(u @ u)), 30, float((x[:, :30] ** 2).sum()), 20, steps=4)


@pytest.fixture(scope="module")
def both():
    return alignment.TwoTokenizers(tokenizer_path(alignment.TOKENIZER_A), tokenizer_path(alignment.TOKENIZER_B), chunks=60)


ODD = ["a  b", "a\nb", " a", "a ", "\n\n x", "ﬁ Å x́", "a\t b", "<s> <unk> <0x41>", "日本 語 text", "x▁y", "<|endoftext|> a<|endoftext|>", "a\r\nb c\r", "", " ", "\t", "q" * 500 + " x", "a\x00b", "é ü ñ", "مرحبا بالعالم", "😀😀 x😀", "don't  'll 12 34", "a b", "x" * 30 + "é" * 30, None]


def plainly_aligned(both, text):
    """Ids and groups by a merge of the tokens' ends."""
    a, b = both.encode(text) if text else ([], [])
    ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((both.bytes_a, a), (both.bytes_b, b))]
    cuts, at, groups = sorted(set(ends[0]) & set(ends[1])), [0, 0], []
    for c in cuts:
        group = []
        for side, ids in enumerate((a, b)):
            n = at[side]
            while at[side] < len(ids) and ends[side][at[side]] <= c:
                at[side] += 1
            group.append([int(i) for i in ids[n : at[side]]])
        groups.append(group)
    return a, b, groups


def test_chunks_are_encoded_like_texts(both):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab1.'é\n\t <|") for _ in range(60)) for _ in range(100)]
    for k in range(0, len(texts), 7):
        batch = texts[k : k + 7]
        (ids_a, n_a), (ids_b, n_b) = both.ids([t or "" for t in batch])
        for t, x, y in zip(batch, np.split(ids_a, np.cumsum(n_a)[:-1]), np.split(ids_b, np.cumsum(n_b)[:-1])):
            a, b = both.encode(t) if t else ([], [])
            assert x.tolist() == list(a) and y.tolist() == list(b), t
    raw = "naïve 日本\x00"
    a, b = both.encode(raw)
    assert b"".join(both.bytes_a[i] for i in a) == b"".join(both.bytes_b[i] for i in b) == (" " + raw).encode()


def test_shared_cuts_equal_a_merge():
    rng = random.Random(5)
    ends, counts, want = [[], []], [[], []], [[], []]
    base = 0
    for _ in range(60):
        size = rng.choice([0, 1, 2, 5, 40, 300])
        inner = [sorted(rng.sample(range(1, size), rng.randrange(size))) + [size] if size else [] for _ in range(2)]
        for side in (0, 1):
            ends[side] += [base + e for e in inner[side]]
            counts[side].append(len(inner[side]))
            want[side] += [e in inner[1 - side] for e in inner[side]]
        base += size
    got = alignment.shared_cuts(*(np.array(x, np.int64) for side in (0, 1) for x in (ends[side], counts[side])))
    assert got[0].tolist() == want[0] and got[1].tolist() == want[1]


def test_links_of_large_groups():
    rng = np.random.default_rng(0)
    n_a, n_b = np.array([1, 3, 40, 2]), np.array([2, 1, 30, 2])
    a, b = rng.integers(0, 9, n_a.sum()), rng.integers(0, 9, n_b.sum())
    count = lambda most: collections.Counter({k: v for k, v in _totals(alignment.linked_ids(a, n_a, b, n_b, most)).items()})
    assert count(0) == count(10) == count(10**6) and sum(count(10).values()) == (n_a * n_b).sum()


def _totals(links):
    out = collections.Counter()
    for g, x, y, times in zip(*(v.tolist() for v in links)):
        out[g, x, y] += times
    return out


@pytest.mark.parametrize("frequent", [0, 40, 1 << 20])
def test_alignment(spark, both, frequent):
    rng = random.Random(9)
    words = [f"{rng.choice(['un', 're', ''])}{rng.choice(['token', 'align', 'naïve', 'straße'])}{rng.choice(['ing', 'ed', 's,', ''])}" for _ in range(40)]
    texts = [(i, t) for i, t in enumerate([*ODD, *(" ".join(rng.choices(words, k=30)) for _ in range(25)), "z" * 3000, " ".join(words) * 40])]
    texts += [texts[30], (None, texts[30][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in texts], DOCS).repartition(3)
    got, pairs = alignment.align(docs, frequent=frequent)
    plain = [plainly_aligned(both, t) for _, t in texts]
    held = [{(x, y) for g in groups for x in g[0] for y in g[1]} for _, _, groups in plain]
    counts = collections.Counter(p for s in held for p in s)
    top = collections.defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    want = collections.Counter()
    for (i, _), (a, b, groups) in zip(texts, plain):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        spelt = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        want[i, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(spelt.encode()).hexdigest() if groups else ""] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(tuple(r[c] for c in names) for r in got.collect()) == want
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in counts.items()}
    assert alignment.align(docs.limit(0))[0].count() == 0


def test_queries_return_the_contracts_columns(spark):
    from graphloom.llm import queries

    data = "/root/testdata/sf0.001"
    for name, columns in {
        "op11_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
        "op12_embedding_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
        "op13_cross_tokenizer_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    }.items():
        assert columns <= set(queries.QUERIES[name](spark, data).columns)


def test_step_rows_of_arrow(both):
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", None])], names=["doc_id", "text"])
    out = list(alignment._aligned(iter([batch]), tokenizer_path(alignment.TOKENIZER_A), tokenizer_path(alignment.TOKENIZER_B)))
    assert sum(b.num_rows for b in out) == 2 and out[-1].column("groups_sha256")[-1].as_py() == ""


def test_extra_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "k", 1, "g", 2, "p")], DOCS)
    assert jaccard.jaccard_components(docs.withColumn("token", F.lit(1))).first()["component_id"] == 1


def test_one_text_beside_many_near_copies(spark):
    """The rows that are dealt for a shingle grow with its texts, not with their square."""
    n, most = 20_000, 100
    made = spark.range(n + 1).select(F.lit(7).cast("long").alias("token"), F.col("id"), F.lit(0).alias("place"), F.lit(50).alias("n"), F.when(F.col("id") == n, 2).otherwise(1).cast("long").alias("group"))
    meeting = made.withColumns({"texts": F.lit(n + 1).cast("long"), "main": F.lit(1).cast("long"), "most": F.lit(n).cast("long")})
    dealt = simhash.deal_cells(meeting, most)
    assert dealt.count() == n + n // most + 1
    # Each of the many meets the one, in one cell.
    one = dealt.where("id = 20000 and cell > 0").select("cell", F.col("block").alias("other"))
    assert dealt.where("id < 20000").join(one, "cell").where("block <> other").select("id").distinct().count() == n


def test_blocks_of_items_are_one_benchmark(spark, monkeypatch):
    """Items of one block or of several, equal ones and those without an id or text: the same findings."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([20, 40, 60])))) for i in range(25)]
    items += [(3, items[3][1]), (None, items[4][1]), (None, None), (30, ""), (31, None)]
    docs = [(150 if i is None else 100 + i, f"{' '.join(rng.choices(words, k=80))} {t} {' '.join(rng.choices(words, k=50))}") for i, t in items if t]
    docs += [(200 + k, " ".join(rng.choices(words, k=150))) for k in range(40)] + [(300, None), (301, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    found = []
    for size in (4_096, 7):
        monkeypatch.setattr(decontamination, "BLOCK_ITEMS", size)
        found.append({(r["doc_id"], r["item_id"], round(r["lcs_share"], 6)) for r in decontamination.contaminated(frame, benchmark, exact=True).collect()})
        gated = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame, benchmark).collect()}
        assert gated == {x[:2] for x in found[-1]}
        kept = {r["doc_id"] for r in decontamination.without_contaminated(frame, benchmark).collect()}
        assert kept == {i for i, _ in docs} - {x[0] for x in gated}
    assert found[0] == found[1] and {(100 + i, i) for i, t in items if t and i is not None} <= {x[:2] for x in found[0]}


def without_windows(batch, history, size):
    """(doc_id, words, removed, digest) of a batch, by looking at every window of it and of all before it."""
    words = [(i, WORD.findall(t or "")) for i, t in batch]
    seen = collections.Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    old = {tuple(w[k : k + size]) for _, t in history for w in [WORD.findall(t or "")] for k in range(len(w) - size + 1)}
    out = collections.Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if seen[window] > 1 or window in old:
                gone |= set(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    return out


def test_batches_against_an_index_without_their_history(spark, tmp_path):
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choices([f"w{k}" for k in range(500)], k=n))
    passage, first = make(20), make(80)
    batches = [
        [(1, first), (2, f"{make(30)} {passage} {make(9)}"), (3, None), (4, ""), (5, make(11)), (6, "a b " * 40)],
        [(11, first), (12, f"{make(5)}\n{passage}\t{make(50)}"), (13, make(12)), (13, make(40)), (None, first), (14, "x " * 12), (15, "a b " * 9)],
        [(21, f"{passage} {make(3)}"), (22, make(60))],
        [],
    ]
    index, history = windows.WindowIndex(spark, str(tmp_path / "index"), window=12, buckets=3), []
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    seen = lambda df: collections.Counter(tuple(r[c] for c in names) for r in df.collect())
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame([(i, t, 1, 2) for i, t in batch], "doc_id long, text string, key int, w int")
        want = without_windows(batch, history, 12)
        assert seen(index.add(f"b{k}", frame)) == want
        rows = index.store.read("windows").count()
        again = windows.WindowIndex(spark, str(tmp_path / "index"), window=12)  # a later session; and a replay
        assert seen(again.add(f"b{k}", frame)) == want and again.store.read("windows").count() == rows
        history += batch
        index = again
    assert len(index.store.runs("windows")) == 4
    index.store.compact("windows")
    replay = spark.createDataFrame(batches[1], "doc_id long, text string")
    assert seen(index.add("b1", replay)) == without_windows(batches[1], batches[0], 12)
    late = index.add("b9", spark.createDataFrame([(99, first)], "doc_id long, text string")).first()
    assert late["n_words"] == late["n_removed"] == 80
