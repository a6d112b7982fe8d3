"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answer checks.

The cosine search decides which passages are verified. A search by words (``exact``) is an option beside it: an item's words
in a region are the most that a common subsequence can hold, so that regions with less than is asked, and no others, are
left out. The recall of the one is measured against the other.

A passage is ``CELLS`` cells of ``CELL`` words. The latent space is that of a randomised singular value decomposition
of the TF-IDF passages of benchmark and corpus, over the benchmark's terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, scope, stash, steps, table
from graphloom.llm.words import Words

CELL = 16
CELLS = 2
#: Dimensions of the latent space: this share of the benchmark's passages, within the bounds.
RANK_SHARE, LEAST_RANK, MOST_RANK = 0.6, 64, 512
#: The corpus passages' weight in the space; the benchmark's is 1.
CORPUS = 0.1
#: Cosine in the latent space from which a passage is a candidate, and the least share of its length in the space.
COSINE = 0.5
INSIDE = 0.35
#: Shares of a benchmark item in its longest common subsequence with a text, words weighed by their inverse document
#: frequency (1 for those that are no terms of the space): one alone is proof, or a lower one with that of the answer.
PROOF = 0.7
PARAPHRASE = 0.55
ANSWER = 0.75
#: Share of an item's weight that its lightest words, which the search by words leaves out of its index, may have.
LIGHT = 0.35
#: The answer: an item's last words.
ANSWER_WORDS = 8
#: Terms in over this share of the items (but at least in three) are no terms of the space, except an item's rarest.
COMMON = 0.01
RAREST = 6
#: Tasks that make a sketch, for each partition of a shuffle or core.
SKETCHES = 2
#: Items that are searched at once; more are searched in blocks.
BLOCK_ITEMS = 4_096

SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"


@dataclass
class Items:
    """A block of benchmark items: their words, the terms of the space, and each item's masks for the subsequence."""

    ids: list[int]
    words: list[list[int]]
    terms: np.ndarray
    passages: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    owner: np.ndarray
    masks: list[dict[int, int]] = field(default_factory=list)


def passages(w: Words, terms: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """((passage, term, count, words outside the space) of a block of texts, each passage's text, its first word)."""
    cells = -(-w.counts // CELL)
    n_passages = np.where(w.counts > 0, np.maximum(cells - CELLS + 1, 1), 0)
    off = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(off[-1])
    owner = np.repeat(np.arange(w.n), n_passages)
    first = (np.arange(total) - off[owner]) * CELL
    cell = (np.arange(len(w.hash)) - w.word_off[w.doc]) // CELL
    at = np.minimum(np.searchsorted(terms, w.hash), max(len(terms) - 1, 0))
    inside = terms[at] == w.hash if len(terms) else np.zeros(len(w.hash), bool)
    pairs, outside = [], np.zeros(total, np.int64)
    for back in range(CELLS):
        p = cell - back
        ok = (p >= 0) & (p < n_passages[w.doc])
        p = off[w.doc] + p
        pairs.append(p[ok & inside] * max(len(terms), 1) + at[ok & inside])
        outside += np.bincount(p[ok & ~inside], minlength=total)
    key, count = np.unique(np.concatenate(pairs), return_counts=True)
    return (key // max(len(terms), 1), key % max(len(terms), 1), count.astype(np.float32), outside), owner, first


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows over sorted groups: the first row of every group, then the second, and so on."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(groups):
        edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        size = np.diff(np.append(edge, len(groups)))
        own = groups[edge]
        for k in range(min(int(size.max()), 32)):
            some = size > k
            out[own[some]] += values[edge[some] + k]
        for g in np.flatnonzero(size > 32).tolist():
            out[own[g]] += values[edge[g] + 32 : edge[g] + size[g]].sum(axis=0)
    return out


def _product(rows: np.ndarray, values: np.ndarray, columns: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """A sparse matrix of ``n`` rows, given by its sorted rows, times a dense one; a bounded part of it at a time."""
    out = np.zeros((n, dense.shape[1]))
    step = max(1, (8 << 20) // max(dense.shape[1], 1))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        own = rows[part]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[edge]] += np.add.reduceat(dense[columns[part]] * values[part][:, None], edge, axis=0)
    return out


def read_items(rows: list[tuple[int, str | None]], often: dict[int, int] | None = None, n_items: int | None = None) -> Items:
    """A block of items. ``often``: in how many of all ``n_items`` items each of its words stands (those of the block by default)."""
    column = pa.array([t or "" for _, t in rows], pa.string())
    w = Words(column, lower=True, plain=True)
    words = [w.hash[a:b].tolist() for a, b in zip(w.word_off, w.word_off[1:])]
    terms, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(np.array(x, np.uint64)) for x in words)]), return_counts=True)
    if often is not None:
        seen = np.array([often[h] for h in terms.tolist()], np.int64)
    often = dict(zip(terms.tolist(), seen.tolist()))
    rarest = {h for x in words for h in sorted(set(x), key=lambda h: (often[h], h))[:RAREST]}
    terms = terms[(seen <= max(2, COMMON * (n_items or len(rows)))) | np.isin(terms, np.array(sorted(rarest), np.uint64))]
    inside, owner, _ = passages(w, terms)
    items = Items([i for i, _ in rows], words, terms, inside, owner)
    for x in words:
        mask: dict[int, int] = {}
        for k, h in enumerate(x):
            mask[h] = mask.get(h, 0) | 1 << k
        items.masks.append(mask)
    return items


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item."""
    for batch in steps(batches):
        w = Words(batch.column("text"), lower=True, plain=True)
        each = np.unique(np.stack([w.doc.astype(np.uint64), w.hash]), axis=1)[1]
        yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64))], names=["word"])


def common_subsequence(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Which of an item's ``n`` words a longest common subsequence with ``other`` uses, as bits (bit-parallel)."""
    full = (1 << n) - 1
    v = full
    for h in other:
        u = v & masks.get(h, 0)
        v = ((v + u) | (v - u)) & full
    return ~v & full


def _sketch(batches: Iterator[pa.RecordBatch], terms: np.ndarray, rank: int) -> Iterator[pa.RecordBatch]:
    """A partition's passages, texts by term, squares and sketch C'CW: one row."""
    random = np.random.default_rng(7).standard_normal((len(terms), rank)).astype(np.float32)
    df, squares, sketch, n = np.zeros(len(terms)), np.zeros(len(terms)), np.zeros((len(terms), rank), np.float32), 0
    for batch in steps(batches):
        (p, t, c, outside), owner, _ = passages(Words(batch.column("text"), lower=True, plain=True), terms)
        n += batch.num_rows
        if not len(p):
            continue
        y = _sums(random[t] * c[:, None], p, len(outside))
        by = np.argsort(t, kind="stable")
        sketch += _sums(y[p[by]] * c[by][:, None], t[by], len(terms))
        squares += np.bincount(t, c * c, len(terms))
        df += np.bincount(np.unique(owner[p] * len(terms) + t) % len(terms), minlength=len(terms))
    yield _row(n, df, squares, sketch)


def _row(n: int, df: np.ndarray, squares: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (df, squares, sketch))], names=["n", "df", "squares", "sketch"])


def _add(batches: Iterator[pa.RecordBatch], terms: int, rank: int) -> Iterator[pa.RecordBatch]:
    """The sum of a partition's rows, held one at a time."""
    n, df, squares, sketch = 0, np.zeros(terms), np.zeros(terms), np.zeros((terms, rank), np.float32)
    for batch in batches:
        for r in batch.to_pylist():
            n += r["n"]
            df += np.frombuffer(r["df"])
            squares += np.frombuffer(r["squares"])
            sketch += np.frombuffer(r["sketch"], np.float32).reshape(terms, rank)
    yield _row(n, df, squares, sketch)


@dataclass
class Space:
    idf: np.ndarray
    basis: np.ndarray
    items: np.ndarray
    singular: np.ndarray


def latent_space(docs: DataFrame, items: Items, rank: int | None = None) -> Space:
    """Inverse document frequencies from all documents, and the space's basis over the terms.

    With counts C and frequencies D, A = CD; for a random W the product A'AX of X = W / D is DC'CW, so that one pass
    over the documents gives both D and the sketch. The partitions' sketches (terms by rank, whatever the number of
    documents) are added level by level. The eigenvalues come from the same sketch (single-pass, symmetric).
    """
    n_terms = len(items.terms)
    rank = min(max(n_terms, 1), rank or int(np.clip(RANK_SHARE * len(items.passages[3]), LEAST_RANK, MOST_RANK)))
    schema = "n long, df binary, squares binary, sketch binary"
    terms = items.terms
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A sketch for each of as many tasks as run at once, about, whatever the number of files.
    tasks = SKETCHES * max(width, docs.sparkSession.sparkContext.defaultParallelism)
    parts = docs.select("text").coalesce(tasks).mapInArrow(lambda it: _sketch(it, terms, rank), schema)
    summed = parts
    while width:  # levels of sixteen to one: no task adds up more than that
        summed = summed.repartition(width).mapInArrow(lambda it: _add(it, n_terms, rank), schema)
        width = -(-width // 16) if width > 1 else 0
    got = summed.collect()
    n = got[0]["n"] if got else 0
    df, squares = (np.frombuffer(got[0][k]) if got else np.zeros(n_terms) for k in ("df", "squares"))
    sketch = np.frombuffer(got[0]["sketch"], np.float32).reshape(n_terms, rank).astype(float) if got else np.zeros((n_terms, rank))
    idf = np.log((n + 1) / (df + 1)) + 1
    random = np.random.default_rng(7).standard_normal((n_terms, rank)).astype(np.float32) / idf[:, None]
    p, t, c, outside = items.passages
    v = c * idf[t]
    v = v / np.maximum(np.sqrt(np.bincount(p, v**2, len(outside))), 1e-9)[p]  # short items count like long ones
    by = np.argsort(t, kind="stable")
    weight = lambda x: 1 / max(x, 1e-12)
    own, corpus = weight((v**2).sum()), CORPUS * weight((squares * idf**2).sum())
    product = own * _product(t[by], v[by], p[by], _product(p, v, t, random, len(outside)), n_terms) + corpus * (idf[:, None] * sketch)
    q, _ = np.linalg.qr(product) if n_terms else (product, None)
    small = (q.T @ product) @ np.linalg.pinv(q.T @ random)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    basis = (q @ vectors[:, ::-1]).astype(np.float32)
    return Space(idf, basis, _unit(_product(p, v, t, basis, len(outside)).astype(np.float32)), np.sqrt(np.maximum(values[::-1], 0)))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]


@dataclass
class WordIndex:
    """The heavy words of each item: word ``keys[k]`` has the entries ``off[k]`` to ``off[k + 1]`` of items and weights."""

    keys: np.ndarray
    off: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    least: np.ndarray
    reach: int


def word_index(bags: list[dict[int, float]], totals: list[float], longest: int) -> WordIndex:
    """An item's heaviest words, all but ``LIGHT`` of its weight, and the weight of them that a match needs at least."""
    entries, least = [], np.full(len(bags), np.inf)
    for i, (bag, total) in enumerate(zip(bags, totals)):
        left = total
        for h, v in sorted(bag.items(), key=lambda x: (-x[1], x[0])):
            if left <= LIGHT * total:
                break
            entries.append((h, i, v))
            left -= v
        if bag:
            least[i] = PARAPHRASE * total - left - 1e-6 * total
    entries.sort()
    keys, off = np.unique(np.array([e[0] for e in entries], np.uint64), return_index=True)
    return WordIndex(keys, np.append(off, len(entries)), np.array([e[1] for e in entries], np.int64), np.array([e[2] for e in entries]), least, CELL * CELLS + longest)


def word_candidates(w: Words, index: WordIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, segment, item): where an item's heavy words may suffice. Segment s is the words s * reach to (s + 2) * reach."""
    none = np.zeros(0, np.int64)
    if not len(index.keys) or not len(w.hash):
        return none, none, none
    at = np.minimum(np.searchsorted(index.keys, w.hash), len(index.keys) - 1)
    hit = np.flatnonzero(index.keys[at] == w.hash)
    word, doc = at[hit], w.doc[hit]
    segment = (hit - w.word_off[doc]) // index.reach
    off = np.concatenate([[0], np.cumsum(w.counts // index.reach + 1)])
    place = off[doc] + segment
    both = np.concatenate([place, place[segment > 0] - 1]) * len(index.keys) + np.concatenate([word, word[segment > 0]])
    both = np.unique(both)
    place, word = both // len(index.keys), both % len(index.keys)
    size = index.off[word + 1] - index.off[word]
    entry = np.repeat(index.off[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
    key, where = np.unique(np.repeat(place, size) * len(index.least) + index.items[entry], return_inverse=True)
    held = np.bincount(where, index.weights[entry], minlength=len(key))
    key = key[held >= index.least[key % len(index.least)]]
    place, item = key // len(index.least), key % len(index.least)
    text = np.searchsorted(off, place, "right") - 1
    return text, place - off[text], item


def _found(batches: Iterator[pa.RecordBatch], items: Items, space: Space, cosine: float, exact: bool) -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], tuple]]]:
    """Batches, each with the best match of every (row, item) that is contaminated."""
    mean_idf = float(space.idf.mean()) if len(space.idf) else 1.0
    idf = dict(zip(items.terms.tolist(), space.idf.tolist()))
    weights_of = [np.array([idf.get(h, 1.0) for h in x]) for x in items.words]
    bags: list[dict[int, float]] = [{} for _ in items.words]
    for bag, x, v in zip(bags, items.words, weights_of):
        for h, weight in zip(x, v.tolist()):
            bag[h] = bag.get(h, 0.0) + weight
    totals, longest = [float(v.sum()) for v in weights_of], max(map(len, items.words), default=0)
    index = word_index(bags, totals, longest)
    items_of = lambda item: space.items[items.owner == item]
    for batch in steps(batches):
        w = Words(batch.column("text"), lower=True, plain=True)
        (p, t, c, outside), owner, first = passages(w, items.terms)
        weights = (c * space.idf[t]).astype(np.float32)
        inside = np.bincount(p, weights.astype(float) ** 2, minlength=len(outside))
        # Words outside the space count as one rare word for each four of them: common words are among them.
        norm = np.sqrt(inside + outside / 4 * mean_idf**2)
        may = (inside >= (INSIDE * norm) ** 2) & (inside > 0)
        ok = may[p]
        compact = np.cumsum(may) - 1
        latent = _unit(_sums(space.basis[t[ok]] * weights[ok][:, None], compact[p[ok]], int(may.sum())))
        places = np.flatnonzero(may)
        n_places = np.bincount(owner, minlength=w.n)
        place_off = np.concatenate([[0], np.cumsum(n_places)])
        found: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int]] = set()
        around: dict[int, set[int]] = {}

        def cosine_of(place: int, item: int) -> float:
            rows = slice(*np.searchsorted(p, [place, place + 1]))
            return float((items_of(item) @ _unit((space.basis[t[rows]] * weights[rows][:, None]).sum(axis=0)[None])[0]).max())

        def verify(place: int, item: int, cos: float | None) -> None:
            text, n = int(owner[place]), len(items.words[item])
            best = found.get((text, item), (0.0, 0.0))[1]
            if best >= 0.999999 or (place, item) in tried:
                return
            tried.add((place, item))
            low, end = int(w.word_off[text]), int(w.word_off[text + 1])
            if place not in around:  # all that any item's region can hold
                around.clear()
                around[place] = set(w.hash[low + max(int(first[place]) - longest // 2, 0) : min(low + int(first[place]) + CELL * CELLS + longest // 2, end)].tolist())
            bag, own, total = bags[item], weights_of[item], totals[item]
            if sum([bag[h] for h in bag.keys() & around[place]]) < PARAPHRASE * total:
                return  # no subsequence can hold as much as is asked
            start = max(int(first[place]) - n // 2, 0)
            bits = common_subsequence(items.masks[item], n, w.hash[low + start : min(low + int(first[place]) + CELL * CELLS + n // 2, end)].tolist())
            held = own * np.array([bits >> k & 1 for k in range(n)])
            share = float(held.sum() / total)
            answer = float(held[-ANSWER_WORDS:].sum() / own[-ANSWER_WORDS:].sum())
            if (share >= PROOF or share >= PARAPHRASE and answer >= ANSWER) and share > best:
                found[text, item] = (cosine_of(place, item) if cos is None else cos, share, answer, start)

        for at in range(0, len(places), 4096):
            similar = latent[at : at + 4096] @ space.items.T
            a, b = np.nonzero(similar >= cosine)
            for a_, b_, cos in zip(a.tolist(), b.tolist(), similar[a, b].tolist()):
                verify(int(places[at + a_]), int(items.owner[b_]), cos)
        for text, segment, item in zip(*(x.tolist() for x in word_candidates(w, index))) if exact else ():
            n, cells = len(items.words[item]), int(n_places[text])
            # The places whose region begins in the first half of the segment.
            low = -(-(segment * index.reach + n // 2) // CELL) if segment else 0
            for k in range(low, min(-(-((segment + 1) * index.reach + n // 2) // CELL), cells)):
                verify(int(place_off[text]) + k, item, None)
        yield batch, found


def _search(batches: Iterator[pa.RecordBatch], items: Items, space: Space, cosine: float, exact: bool) -> Iterator[pa.RecordBatch]:
    for batch, found in _found(batches, items, space, cosine, exact):
        rows = [(batch.column("doc_id")[text].as_py(), items.ids[item], *v) for (text, item), v in sorted(found.items())]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])


def _clean(batches: Iterator[pa.RecordBatch], items: Items, space: Space, cosine: float, exact: bool) -> Iterator[pa.RecordBatch]:
    for batch, found in _found(batches, items, space, cosine, exact):
        keep = np.ones(batch.num_rows, bool)
        keep[[text for text, _ in found]] = False
        yield batch.filter(pa.array(keep))


def _blocks(benchmark: DataFrame) -> list[Items]:
    """The benchmark's items in blocks, by id and text; one empty block if there are none.

    Which words are common is a matter of all items, whatever the block.
    """
    found = []
    number, text = F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))
    key = F.struct(number.isNull().alias("none"), F.coalesce(number, F.lit(0).cast("long")).alias("id"), text.alias("text"))
    with scope(benchmark.sparkSession):
        items = stash(benchmark.select(key.alias("key")).distinct(), "items")
        words = stash(items.select("key.text").mapInArrow(_item_words, "word long").groupBy("word").agg(F.count("*").alias("n")), "item_words")
        n_items, after, more = items.count(), None, True
        while more:
            last = None if after is None else F.struct(F.lit(after[0]).alias("none"), F.lit(after[1]).cast("long").alias("id"), F.lit(after[2]).alias("text"))
            block = (items if last is None else items.where(F.col("key") > last)).orderBy("key").limit(BLOCK_ITEMS)
            rows = [(None if r["none"] else r["id"], r["text"]) for r in block.select("key.*").collect()]
            more = len(rows) == BLOCK_ITEMS
            if rows or after is None:
                own = block.select("key.text").mapInArrow(_item_words, "word long").distinct()
                counts = words.join(own, "word").toArrow()
                often = dict(zip(counts.column("word").to_numpy().view(np.uint64).tolist(), counts.column("n").to_pylist()))
                found.append(read_items(rows, often, n_items))
            after = (rows[-1][0] is None, rows[-1][0] or 0, rows[-1][1]) if rows else after
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int | None = None, cosine: float = COSINE, exact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word): the benchmark items that texts hold or paraphrase.

    The benchmark is the stated query set; it is searched for in blocks of ``BLOCK_ITEMS``, each with a space of its own, so
    that what tasks are sent is bounded; words weigh the same in all. All documents are searched, by two maps over them for
    each block. With ``exact`` the regions that an item's words suffice for are verified, too, and nothing that is accepted
    is missed; the latent search alone found 0.99 of that or more, with up to 35 % of words replaced, among 2,000 items. Null and
    empty texts and items have no words and match nothing; an item with a null id is searched like any other and
    reported under null; repeated items count once, repeated documents give repeated results; without documents or
    items there are no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark):
        space = latent_space(source, block, rank)
        hits = source.mapInArrow(lambda it, block=block, space=space: _search(it, block, space, cosine, exact), SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int | None = None, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds or paraphrases no benchmark item.

    Null and empty texts stay; repeated rows stay or go together; without items all rows stay; an empty table stays empty.
    """
    arrow_batches(docs.sparkSession)
    out = docs
    for block in _blocks(benchmark):
        space = latent_space(docs, block, rank)
        out = out.mapInArrow(lambda it, block=block, space=space: _clean(it, block, space, cosine, exact), docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
