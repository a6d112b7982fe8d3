"""N-gram Jaccard join: candidates must pass the prefix filters of several global token orders before they are verified.

A set of n shingles that links to another has one of the first n - ceil(t n) + 1 of them, in any one order of all
shingles, in common with it. The first order is by rarity, and its prefixes are joined; what they pair must also agree in
the parities of the sets' shingles (a short sketch that travels along). The other orders are by hash: a pair's prefixes in
each must have so much in common that the shingles behind them can make up the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, scope, stash, steps, table, text_buffer
from graphloom.llm.words import Words, mix
from graphloom.operators.components import connected_components
from graphloom.operators.skew import join_by_size

SHINGLE = 4
PERCENT = 85
#: Orders by hash beside that by rarity.
ORDERS = 2
#: Shingles whose texts are counted at once; of those in so many texts or more, the most frequent ones, so many at most,
#: come last in the order by rarity. Any order gives the same links, it only decides on their cost.
COUNTED = 1 << 22
OFTEN, OFTEN_MOST = 16, 1 << 17
#: Sets of one shingle beyond which its pairs are dealt to several cells, and pairs made in one step.
CELL_SETS = 2_000
STEP_PAIRS = 1 << 16
#: Rows of keys up to which a list is broadcast, so that texts need not be shuffled to meet it.
SMALL_ROWS = 500_000

#: Bits of a set's sketch: the parities of its shingles' numbers by hash. Sketches differ in no more bits than sets in shingles.
SKETCH = 1024

U = np.uint64


def distinct_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles (fewer words: the whole text is one), sorted, and how many."""
    w = Words(column, lower=True)
    counts = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(w.n), counts)
    first = np.repeat(w.word_off[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    grams = w.rolling.ranges(w.rolling.prefix(w.hash), first, np.minimum(first + size, w.word_off[1:][doc]))
    order = np.argsort(grams)
    order = order[np.argsort(doc[order].astype(np.uint16 if w.n < 1 << 16 else np.int64), kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(doc[new], minlength=w.n)


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(t n) + 1; none of an empty set."""
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link: 100 x >= percent (n + m - x)."""
    return -(-percent * (n + m) // (100 + percent))


def set_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two numbers: sums of its shingles, mixed in two ways. The first is its id."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = [np.concatenate([np.zeros(1, U), np.cumsum(mix(grams ^ U(s)), dtype=U)]) for s in (0x51ED27, 0xA0761D)]
    return np.stack([mix(t[ends[1:]] - t[ends[:-1]] + counts.astype(U)) for t in total], axis=1)


def _ranked(grams: np.ndarray, doc: np.ndarray, n_texts: int, late: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Texts' shingles in the order of ``seed``, those with a ``late`` number behind the others."""
    order = np.argsort(mix(grams ^ mix(np.array([seed], U))))
    if late is not None:
        order = order[np.argsort(late[order], kind="stable")]
    return order[np.argsort(doc[order].astype(np.uint16 if n_texts < 1 << 16 else np.int64), kind="stable")]


def hash_prefixes(grams: np.ndarray, counts: np.ndarray, percent: int, orders: int = ORDERS) -> list[bytes]:
    """Each set's prefixes in the orders by hash, one after the other, folded to 16 bits."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = place < prefix_sizes(counts, percent)[doc]
    folded = [(grams[_ranked(grams, doc, len(counts), seed=k + 1)][keep] >> U(48)).astype(np.uint16) for k in range(orders)]
    ends = np.concatenate([[0], np.cumsum(prefix_sizes(counts, percent))]).tolist()
    raw = [x.tobytes() for x in folded]
    return [b"".join(x[2 * a : 2 * b] for x in raw) for a, b in zip(ends, ends[1:])]


def parity_sketches(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits of each set, as rows of 64-bit numbers."""
    at = np.repeat(np.arange(len(counts)), counts) * SKETCH + (mix(grams) % U(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(counts) * SKETCH) & 1).astype(bool)
    return np.packbits(odd.reshape(-1, SKETCH), axis=1).view(U)


def near_sketches(n: np.ndarray, m: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets of these sizes have sketches that differ in no more shingles than linked ones do."""
    return np.bitwise_count(first ^ second).sum(axis=1, dtype=np.int64) <= n + m - 2 * least_overlap(n, m, percent)


def _sets(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each text with its set's size, key, id, sketch and hash prefixes; and (token, n) of shingles that several of a
    partition's sets hold."""
    held, n, done = [], 0, set()
    names = ["doc_id", "n", "key", "id", "sketch", "prefixes", "token", "times"]

    def counted() -> pa.RecordBatch:
        token, times = np.unique(np.concatenate([np.zeros(0, U), *held]), return_counts=True)
        some = times > 1
        none = pa.nulls(int(some.sum()))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(token[some].view(np.int64)), pa.array(times[some])], names=names)

    for batch in steps(batches):
        grams, counts = distinct_shingles(batch.column("text"), size)
        keys = set_keys(grams, counts)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(keys[:, 0].view(np.int64)), pa.array([x.tobytes() for x in parity_sketches(grams, counts)], pa.binary()), pa.array(hash_prefixes(grams, counts, percent), pa.binary()), none, none], names=names)
        new = _fresh(keys[:, 0], done)
        held.append(grams[np.repeat(new, counts)])
        n += len(held[-1])
        if n >= COUNTED:
            yield counted()
            held, n = [], 0
    yield counted()


def _fresh(ids: np.ndarray, done: set[int]) -> np.ndarray:
    """Which of a partition's sets have not been met in it."""
    new = np.zeros(len(ids), bool)
    for k, i in enumerate(ids.tolist()):
        if i not in done:
            done.add(i)
            new[k] = True
    return new


def _rare(batches: Iterator[pa.RecordBatch], size: int, percent: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, id, place, n): each set's prefix in the order by rarity. ``often``: the frequent shingles, the most frequent first."""
    by = np.argsort(often)
    known, done = often[by], set()
    for batch in steps(batches):
        grams, counts = distinct_shingles(batch.column("text"), size)
        ids = set_keys(grams, counts)[:, 0]
        new = _fresh(ids, done)
        grams, counts, ids = grams[np.repeat(new, counts)], counts[new], ids[new]
        doc = np.repeat(np.arange(len(ids)), counts)
        late = np.zeros(len(grams), np.int32)
        if len(known):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hit = known[at] == grams
            late[hit] = len(often) - by[at[hit]]
        order = _ranked(grams, doc, len(ids), late)
        place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = place < prefix_sizes(counts, percent)[doc]
        yield pa.RecordBatch.from_arrays([pa.array(grams[order][keep].view(np.int64)), pa.array(ids[doc[keep]].view(np.int64)), pa.array(place[keep].astype(np.int32)), pa.array(counts[doc[keep]].astype(np.int32))], names=["token", "id", "place", "n"])


def common_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """For each pair of lists of 16-bit numbers, how many of the one are in the other, repeats and all."""
    size = [np.array(list(map(len, x)), np.int64) for x in (first, second)]
    key = [np.repeat(np.arange(len(s)), s) << 16 | np.concatenate([np.zeros(0, np.uint16), *x]).astype(np.int64) for s, x in zip(size, (first, second))]
    there = np.unique(key[1])
    at = np.minimum(np.searchsorted(there, key[0]), max(len(there) - 1, 0))
    return np.bincount(key[0][there[at] == key[0]] >> 16, minlength=len(first)) if len(there) else np.zeros(len(first), np.int64)


def pass_orders(n: np.ndarray, m: np.ndarray, first: list[bytes], second: list[bytes], percent: int, orders: int = ORDERS) -> np.ndarray:
    """Which pairs of sets of these sizes and hash prefixes can link by every order.

    Where the prefix of the one ends no later than that of the other, all that is common up to there is in both
    prefixes, and the rest is at most what stands behind it.
    """
    p, q = prefix_sizes(n, percent), prefix_sizes(m, percent)
    least = least_overlap(n, m, percent) - np.maximum(n - p, m - q)
    ok = np.arange(len(n))
    for k in range(orders):
        a = [np.frombuffer(first[i], np.uint16)[k * p[i] : (k + 1) * p[i]] for i in ok]
        b = [np.frombuffer(second[i], np.uint16)[k * q[i] : (k + 1) * q[i]] for i in ok]
        # Folding may make different shingles equal, so that either count is the true one or more.
        ok = ok[np.minimum(common_counts(a, b), common_counts(b, a)) >= least[ok]]
    out = np.zeros(len(n), bool)
    out[ok] = True
    return out


def cross_pairs(token: np.ndarray, cell: np.ndarray, side: np.ndarray, group: np.ndarray, ids: np.ndarray, place: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids of one token and cell, of different groups, that can link by sizes, places and sketches.

    Cells below zero pair all their rows, others those of different sides. Steps hold about ``STEP_PAIRS`` pairs.
    """
    order = np.lexsort((group, cell, token))
    token, cell, side, group, ids, place, sketch = (x[order] for x in (token, cell, side, group, ids, place, sketch))
    n = n[order].astype(np.int64)
    if not len(token):
        return
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])
    own = new | np.concatenate([[True], group[1:] != group[:-1]])
    at = np.arange(len(token))
    start, mine = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(own, at, 0))
    todo = mine - start  # each row with those of its cell that stand before its group
    ends, low = np.cumsum(todo), 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - todo[low] + STEP_PAIRS, "right")))
        some = todo[low:high]
        a = np.repeat(at[low:high], some)
        b = np.repeat(start[low:high] - np.cumsum(some) + some, some) + np.arange(len(a))
        low = high
        ok = (ids[a] != ids[b]) & ((side[a] != side[b]) | (cell[a] < 0)) & may_link(n[a], n[b], place[a], place[b], percent)
        a, b = a[ok], b[ok]
        ok = near_sketches(n[a], n[b], sketch[a], sketch[b], percent)
        x, y = np.minimum(ids[a[ok]], ids[b[ok]]), np.maximum(ids[a[ok]], ids[b[ok]])
        if len(x):
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            yield x[first], y[first]


def may_link(n: np.ndarray, m: np.ndarray, place: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Sizes near enough, and common shingles at these places of the two that leave enough behind them.

    The shorter set's place is within its part that has to hold the pair's first common shingle.
    """
    short, long = np.minimum(n, m), np.maximum(n, m)
    least = least_overlap(n, m, percent)
    early = np.where(n <= m, place, other) <= short - least_overlap(short, short, percent)
    return (100 * short >= percent * long) & early & (1 + np.minimum(n - place, m - other) - 1 + np.minimum(place, other) >= least)


def _cross(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    numbers = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in ("token", "cell", "side", "group", "id", "place", "n"))
    sketch = np.concatenate([np.frombuffer(b"".join(r.column("sketch").to_pylist()), U).reshape(r.num_rows, -1) for r in rows])
    for a, b in cross_pairs(*numbers, sketch, percent):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch that pass all orders, and whose sketches are near."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        ok = pass_orders(n, m, batch.column("p_a").to_pylist(), batch.column("p_b").to_pylist(), percent)
        if batch.num_rows:
            first, second = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
            ok &= near_sketches(n, m, first, second, percent)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _intersected(pairs: DataFrame, nodes: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs of ids that pass the filters of all orders, written."""
    first, second = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefixes").alias(f"p_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("a", "b"))
    both = pairs.join(first, "a").join(second, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return stash(both.select("a", "b", "n_a", "n_b", "p_a", "p_b", "s_a", "s_b").mapInArrow(lambda it: _near(it, percent), "a long, b long"), name)


def _grams(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        grams, counts = distinct_shingles(batch.column("text"), size)
        ends, raw = np.concatenate([[0], np.cumsum(counts)]).tolist(), grams.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in set_keys(grams, counts)], pa.binary()), pa.array([raw[8 * a : 8 * b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["key", "grams"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(steps(batches, "g_a", 4 << 20), "g_b", 4 << 20):
        gram, row, sizes = [], [], []
        for c in ("g_a", "g_b"):
            raw, off = text_buffer(batch.column(c))
            gram.append(np.frombuffer(raw.tobytes(), U))
            sizes.append(np.diff(off) // 8)
            row.append(np.repeat(np.arange(batch.num_rows), sizes[-1]))
        gram, row = np.concatenate(gram), np.concatenate(row)
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        both = np.bincount(row[1:][(gram[1:] == gram[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(100 * both >= percent * (sizes[0] + sizes[1] - both)))


def _small(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if its rows, which are counted, are few; else the join shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def _linked(pairs: DataFrame, source: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b), keys, written: those of the pairs of ids that link."""
    keys = nodes.select("id", "key", "least_id")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(keys, "id")
    needed = _small(stash(needed.select("key", "least_id"), "needed"))
    own = source.join(needed, source["doc_id"].eqNullSafe(needed["least_id"]), "left_semi")
    sets = own.select("text").mapInArrow(lambda it: _grams(it, size), "key binary, grams binary")
    sets = stash(sets.join(needed, "key", "left_semi").dropDuplicates(["key"]), "grams")
    first, second = (keys.select(F.col("id").alias(c), F.col("key").alias(f"k_{c}")) for c in ("a", "b"))
    both = pairs.join(first, "a").join(second, "b").select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))
    first, second = (sets.select(F.col("key").alias(c), F.col("grams").alias(f"g_{c}")) for c in ("a", "b"))
    compared = both.join(first, "a").join(second, "b").select("a", "b", "g_a", "g_b")
    return stash(compared.mapInArrow(lambda it: _verified(it, percent), "a binary, b binary"), "links")


def _stars(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the one that stands for most of its shared shingles, where they pass all filters.

    A shingle's chief is the set that shares the largest part of its prefix: an original shares more than its copies.
    """
    size = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    share = shared.groupBy("id").agg((F.count("*") / F.first(size)).alias("share"))
    ranked = stash(shared.select("token", "id").join(share, "id"), "ranked")
    chiefs = stash(ranked.groupBy("token").agg(F.max_by("id", F.struct("share", "id")).alias("b"), F.count("*").alias("sets")), "chiefs")
    votes = join_by_size(ranked.select("token", F.col("id").alias("a")), chiefs, ["token"], "sets").where("a <> b").groupBy("a", "b").count()
    chosen = votes.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    return _intersected(chosen, nodes, percent, "stars")


def _across(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of different groups that pass all filters, those of the other orders last.

    Most of a large shingle's sets are of one group as a rule: each of those stands in one cell, with all sets of other
    groups, and these are paired among themselves in blocks. Pairs within a group need no cell.
    """
    placed = stash(shared.join(nodes.select("id", "group"), "id"), "placed")
    per_group = placed.groupBy("token", "group").count()
    several = per_group.groupBy("token").agg(F.sum("count").alias("sets"), F.max_by("group", "count").alias("main"), F.max("count").alias("most")).where("most < sets")
    meeting = stash(join_by_size(placed, stash(several, "several"), ["token"], "sets"), "meeting")
    blocks = lambda c: F.ceil(c / CELL_SETS).cast("long")
    hashed = F.xxhash64("id")
    main, other = blocks(F.col("most")), blocks(F.col("sets") - F.col("most"))
    block = F.pmod(hashed, other)
    in_main = F.transform(F.sequence(F.lit(0).cast("long"), main - 1), lambda k: 2 * k + 1)
    pair = lambda k: F.when(k == block, -2 - k).otherwise(2 * (F.least(k, block) * other + F.greatest(k, block)))
    among = F.transform(F.sequence(F.lit(0).cast("long"), other - 1), pair)
    one = F.array(F.lit(-1).cast("long"))
    is_main = F.col("group") == F.col("main")
    cells = F.when(F.col("sets") <= CELL_SETS, one).when(is_main, F.array(2 * F.pmod(hashed, main) + 1)).otherwise(F.concat(in_main, among))
    dealt = meeting.select("token", "id", "place", "n", "group", is_main.alias("is_main"), block.alias("block"), F.explode(cells).alias("cell"))
    side = F.when(F.pmod("cell", F.lit(2)) == 1, F.col("is_main").cast("long")).otherwise(F.col("block"))
    rows = dealt.withColumn("side", side).drop("is_main", "block").join(nodes.select("id", "sketch"), "id")
    spread = rows.select("token", "cell", "side", "group", "id", "place", "n", "sketch").repartition("token", "cell")
    pairs = stash(spread.mapInArrow(lambda it: _cross(it, percent), "a long, b long").distinct(), "pairs")
    return _intersected(pairs, nodes, percent, "apart")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): each document and the smallest id that links of ``percent`` or more reach.

    Equal sets are one node, whatever their number. Each node is first compared with one other; what that leaves in
    different groups, and nothing else, is then joined whole, so that a group of near copies is not paired with itself.
    Null, empty and blank texts have no shingles and link with nothing, repeated ones neither: their ids are their own
    components. Ids may repeat; rows of a null id get the smallest other id of their component, null if there is none.
    Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n long, key binary, id long, sketch binary, prefixes binary, token long, times long"
    sets = stash(source.mapInArrow(lambda it: _sets(it, size, percent), schema), "sets")
    rows = sets.where("key is not null and n > 0")
    with scope(spark) as keep:
        one = F.min("doc_id").alias("least_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("id").alias("id"), F.first("sketch").alias("sketch"), F.first("prefixes").alias("prefixes")
        nodes = stash(rows.groupBy("key").agg(*one), "nodes")
        frequent = sets.where("token is not null").groupBy("token").agg(F.sum("times").alias("n")).where(F.col("n") >= OFTEN)
        often = np.array([r["token"] for r in frequent.orderBy(F.desc("n"), "token").limit(OFTEN_MOST).select("token").collect()], np.int64).view(U)
        found = stash(source.select("text").mapInArrow(lambda it: _rare(it, size, percent, often), "token long, id long, place int, n int"), "tokens")
        several = found.groupBy("token").agg(F.count("*").alias("sets"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
        shared = stash(join_by_size(found, stash(several.select("token", "sets"), "several"), ["token"], "sets").select("token", "id", "place", "n").distinct(), "shared")
        near = _linked(_stars(shared, nodes, percent), source, nodes, size, percent)
        groups = stash(connected_components(near), "groups")
        grouped = nodes.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.xxhash64(F.coalesce("component", "key")))
        grouped = stash(grouped.select("id", "key", "least_id", "n", "group", "sketch", "prefixes"), "grouped")
        far = _linked(_across(shared, grouped, percent), source, nodes, size, percent)
        links = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(far)
        rooted = nodes.select("key", "least_id", "rows").join(connected_components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        rooted = stash(rooted, "rooted")
        least = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = keep(stash(rooted.join(least, "component").select("key", "component_id", "rows"), "named"))
    linked = join_by_size(rows.select("doc_id", "n", "key"), named, ["key"], "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("key is not null and n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by four-word shingles and a similarity of 0.85; texts without words are alone."""
    return jaccard_components(table(spark, sf_dir, "documents"))
