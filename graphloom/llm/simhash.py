"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, list_column, scope, stash, steps, table
from graphloom.llm.words import Words, mix
from graphloom.operators.components import connected_components
from graphloom.operators.skew import join_by_size

SHINGLE = 3
BUDGET = 2
SEED = 42
#: Fingerprints of one key beyond which the key is split again by the bits that it leaves free.
BUCKET = 50_000


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the lower-cased texts, repeats included, and each text's number of them."""
    from xxhash import xxh64_intdigest

    w = Words(column, lower=True)
    # The words of a text with one space between them: each word's bytes and, but for the last, the byte after it.
    inner = np.ones(len(w.starts), bool)
    inner[w.word_off[1:][w.counts > 0] - 1] = False
    keep = w.solid.copy()
    keep[w.ends[inner]] = True
    buf = w.buf.copy()
    buf[w.ends[inner]] = 32
    moved = np.concatenate([[0], np.cumsum(keep)])
    raw, starts, ends = buf[keep].tobytes(), moved[w.starts], moved[w.ends]
    counts = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    first = np.repeat(w.word_off[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    last = np.minimum(first + size - 1, w.word_off[1:][np.repeat(np.arange(w.n), counts)] - 1)
    return np.array([xxh64_intdigest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())], np.uint64), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes; no hashes, no bits."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        fp = majority_bits(*shingle_hashes(batch.column("text"), size))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def trie_pairs(fps: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal group whose fingerprints differ in at most ``budget`` bits.

    ``fps`` is sorted within the sorted ``groups``, so that a trie node is a range of rows. All pairs of nodes of one
    depth are one step: a node with itself, or two nodes that have differed in ``wrong`` bits so far. A pair of
    children on different sides costs one bit more; pairs over the budget are cut with all that is below them.
    """
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
    ends = np.append(starts[1:], len(groups))
    some = ends - starts > 1
    a0, a1 = starts[some], ends[some]
    b0, b1, wrong = a0.copy(), a1.copy(), np.zeros(len(a0), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = [(a0, am, b0, bm, wrong, None), (am, a1, bm, b1, wrong, None), (a0, am, bm, b1, wrong + 1, None), (am, a1, b0, bm, wrong + 1, ~own)]
        kept = []
        for p0, p1, q0, q1, w, only in parts:
            ok = (p1 > p0) & (q1 > q0) & (w <= budget) & ~((p0 == q0) & (p1 - p0 == 1))
            ok = ok if only is None else ok & only
            kept.append([x[ok] for x in (p0, p1, q0, q1, w)])
        a0, a1, b0, b1, wrong = (np.concatenate(x) for x in zip(*kept))
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        near = np.bitwise_count(fps[a0[single]] ^ fps[b0[single]]) <= budget
        left.append(a0[single][near])
        right.append(b0[single][near])
        a0, a1, b0, b1, wrong = (x[~single] for x in (a0, a1, b0, b1, wrong))
    return (np.concatenate(left), np.concatenate(right)) if left else (starts[:0], starts[:0])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the given links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _trie_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition's fingerprints as stars: each to the first that it reaches; rows out are at most rows in."""
    rows = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
    if not rows:
        return
    keys, fps = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).view(np.uint64)
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    root = local_roots(len(fps), *trie_pairs(fps, keys, budget))
    linked = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[root[linked]].view(np.int64))], names=["a", "b"])


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``budget`` + 1 blocks: within the budget at least one block agrees whole."""
    cuts = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block_value(fp: F.Column, low: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def link_fingerprints(fps: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """(node, component) of the distinct fingerprints ``fp`` that link to another at ``budget`` or fewer bits.

    Each fingerprint goes to one key for each block of its bits. The few keys with over ``bucket`` fingerprints are
    split, once, by the same argument on the bits outside the block, so no link is lost: what is left in one key then
    agrees in half of all bits. A partition's keys are one forest of tries, joined with itself.
    """
    fp, blocks = F.col("fp"), _blocks(budget)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block_value(fp, low, width).alias("value")) for i, (low, width) in enumerate(blocks)))).alias("k")).select("fp", "k.block", "k.value")
    large = keyed.groupBy("block", "value").count().where(F.col("count") > bucket).select("block", "value", F.lit(True).alias("large"))
    # Below a large key: the bits above and below its block, as one number, cut into blocks once more.
    rest = F.lit(None).cast("long")
    for i, (low, width) in enumerate(blocks):
        above = F.lit(0).cast("long") if low + width >= 64 else F.shiftleft(F.shiftrightunsigned(fp, low + width), low)
        rest = F.when(F.col("block") == i, above.bitwiseOR(fp.bitwiseAND(F.lit((1 << low) - 1)))).otherwise(rest)
    free = 64 - max(width for _, width in blocks)
    cuts = [free * i // (budget + 1) for i in range(budget + 1)] + [64]
    parts = F.array(*(F.struct(F.lit(j).alias("part"), F.shiftrightunsigned(F.col("rest"), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b < 64 else -1)).alias("bits")) for j, (a, b) in enumerate(zip(cuts, cuts[1:]))))
    one = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("bits")))
    spread = keyed.join(large, ["block", "value"], "left").withColumn("rest", rest).select("fp", "block", "value", F.explode(F.when(F.col("large"), parts).otherwise(one)).alias("s"))
    # The hash only groups rows: should two keys share one, their fingerprints are compared as well.
    hashed = spread.select("fp", F.xxhash64("block", "value", "s.part", "s.bits").alias("key")).repartition("key")
    return connected_components(hashed.mapInArrow(lambda it: _trie_links(it, budget), "a long, b long"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): each document and the smallest id that links of fingerprints reach.

    Copies of a text share a fingerprint and are joined before anything else, so a group of copies costs one row. A
    null, empty or blank text has fingerprint zero and links like any other; ids may repeat; rows of a null id get the
    smallest other id of their group, null if there is none. An empty table gives no rows. Extra columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stash(source.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long"), "fingerprints")
    with scope(docs.sparkSession) as keep:
        counted = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows"))
        distinct = stash(counted, "distinct")
        linked = link_fingerprints(distinct.select("fp"), budget)
        rooted = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = rooted.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = keep(stash(rooted.join(least, "component").select("fp", "component_id", "rows"), "named"))
    return join_by_size(prints, named, ["fp"], "rows").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


#: Near duplicates by shared passages: the words of a passage on average, and the passages of a text that stand for it.
PASSAGE = 16
PASSAGES = 8
SIMILARITY = 0.8
NEAR_SHINGLE = 5


def passage_prints(column: pa.Array, most: int = PASSAGES) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of each text's passages (the ``most`` with the smallest mixed values, longer ones first), and how many.

    A passage ends after a word whose hash says so, so that an edit moves no border but its own.
    """
    w = Words(column, lower=True)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(w.n, np.int64)
    stop = w.hash % np.uint64(PASSAGE) == 0
    begin = np.concatenate([[True], stop[:-1] | (w.doc[1:] != w.doc[:-1])])
    starts = np.flatnonzero(begin)
    size = np.diff(np.append(starts, n))
    last = w.word_off[1:][w.doc] - 1
    at = np.arange(n)
    grams = w.rolling.ranges(w.rolling.prefix(w.hash), at, np.minimum(at + SHINGLE - 1, last) + 1)
    fp, doc = majority_bits(grams, size), w.doc[starts]
    order = np.lexsort((mix(fp), size < PASSAGE // 2, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    chosen = order[rank < most]
    return fp[chosen], np.bincount(doc[chosen], minlength=w.n)


def _passage_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        fp, counts = passage_prints(batch.column("text"))
        sketch = parity_sketches(*shingle_sets(batch.column("text"), size))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), list_column(fp.view(np.int64), counts, pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "key", "prints", "sketch"])


def _verified(batches: Iterator[pa.RecordBatch], least: float, size: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(steps(batches, "text_a"), "text_b"):
        (x, n), (y, m) = (shingle_sets(batch.column(c), size) for c in ("text_a", "text_b"))
        gram, row = np.concatenate([x, y]), np.repeat(np.tile(np.arange(batch.num_rows), 2), np.concatenate([n, m]))
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        both = np.bincount(row[1:][(gram[1:] == gram[:-1]) & (row[1:] == row[:-1])], minlength=batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(both / np.maximum(n + m - both, 1) >= least))


#: The exact route: shingles that stand in several texts of so many are counted; of those in this many texts or more, the
#: most frequent ones come last in the order of rarity. Any order gives the same links, it only decides on their cost.
COUNTED = 1 << 22
OFTEN = 16
OFTEN_MOST = 1 << 17
#: Texts of one shingle beyond which its pairs are dealt to several cells, and pairs made in one step.
CELL_TEXTS = 2_000
STEP_PAIRS = 1 << 17
#: Bits of a text's sketch: the parities of its shingles' numbers by hash. Sketches differ in no more bits than sets in shingles.
SKETCH = 1024


def shingle_sets(column: pa.Array, size: int = NEAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles (fewer words: the whole text is one), and how many."""
    w = Words(column, lower=True)
    counts = np.where(w.counts >= size, w.counts - size + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(w.n), counts)
    first = np.repeat(w.word_off[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    grams = w.rolling.ranges(w.rolling.prefix(w.hash), first, np.minimum(first + size, w.word_off[1:][doc]))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])]) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(doc[new], minlength=w.n)


def parity_sketches(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits of each text's distinct shingles, as rows of 64-bit numbers."""
    at = np.repeat(np.arange(len(counts)), counts) * SKETCH + (mix(grams) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(counts) * SKETCH) & 1).astype(bool)
    return np.packbits(odd.reshape(-1, SKETCH), axis=1).view(np.uint64)


def _often(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(token, n): a partition's shingles that stand in more than one of its texts."""
    held, n = [], 0

    def counted() -> pa.RecordBatch:
        token, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        some = times > 1
        return pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(times[some])], names=["token", "n"])

    for batch in steps(batches):
        held.append(shingle_sets(batch.column("text"), size)[0])
        n += len(held[-1])
        if n >= COUNTED:
            yield counted()
            held, n = [], 0
    yield counted()


def _rare(batches: Iterator[pa.RecordBatch], size: int, least: float, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, id, place, n): the rarest shingles of each text, one of which any text of ``least`` similarity shares.

    ``often`` are the frequent shingles, the most frequent first. Texts of equal ids are equal and count once.
    """
    by = np.argsort(often)
    known = often[by]
    done: set[int] = set()
    for batch in steps(batches):
        grams, counts = shingle_sets(batch.column("text"), size)
        ids = batch.column("id").to_numpy()
        fresh = np.zeros(len(ids), bool)
        for k, i in enumerate(ids.tolist()):
            fresh[k] = i not in done
            done.add(i)
        doc = np.repeat(np.arange(len(ids)), counts)
        late = np.zeros(len(grams), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hit = known[at] == grams
            late[hit] = len(often) - by[at[hit]]
        order = np.lexsort((mix(grams), late, doc))
        place = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts)
        asked = counts - np.ceil(least * counts - 1e-6).astype(np.int64) + 1
        keep = (place < asked[doc]) & fresh[doc]
        yield pa.RecordBatch.from_arrays([pa.array(grams[order][keep].view(np.int64)), pa.array(ids[doc[keep]]), pa.array(place[keep].astype(np.int32)), pa.array(counts[doc[keep]].astype(np.int32))], names=["token", "id", "place", "n"])


def cross_pairs(token: np.ndarray, cell: np.ndarray, block: np.ndarray, group: np.ndarray, ids: np.ndarray, place: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids of one token and cell and of different groups that can reach ``least`` by length, places and sketches.

    A cell with two blocks pairs only what lies in different ones. Steps hold about ``STEP_PAIRS`` pairs.
    """
    order = np.lexsort((group, cell, token))
    token, cell, block, group, ids, place, n, sketch = (x[order] for x in (token, cell, block, group, ids, place, n, sketch))
    if not len(token):
        return
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])
    own = new | np.concatenate([[True], group[1:] != group[:-1]])
    at = np.arange(len(token))
    start, mine = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(own, at, 0))
    # Each row with those of its token and cell that stand before its group.
    todo = mine - start
    ends = np.cumsum(todo)
    low, n = 0, n.astype(np.int64)
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - todo[low] + STEP_PAIRS, "right")))
        some = todo[low:high]
        a = np.repeat(at[low:high], some)
        b = np.repeat(start[low:high] - np.cumsum(some) + some, some) + np.arange(len(a))
        low = high
        short, long = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        least_both = np.ceil(least / (1 + least) * (short + long) - 1e-6)
        least_short = np.ceil(2 * least / (1 + least) * short - 1e-6)
        reach = np.minimum(place[a], place[b]) + 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1
        ok = (short >= least * long - 1e-6) & (np.where(n[a] <= n[b], place[a], place[b]) <= short - least_short) & (reach >= least_both) & (ids[a] != ids[b])
        ok &= (block[a] != block[b]) | (cell[a] < 0)
        a, b, most = a[ok], b[ok], (short + long - 2 * least_both)[ok]  # shingles of one text only
        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= most
        x, y = np.minimum(ids[a[near]], ids[b[near]]), np.maximum(ids[a[near]], ids[b[near]])
        if len(x):
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            yield x[first], y[first]


def _cross(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    numbers = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in ("token", "cell", "block", "group", "id", "place", "n"))
    sketch = np.concatenate([np.frombuffer(b"".join(r.column("sketch").to_pylist()), np.uint64).reshape(r.num_rows, -1) for r in rows])
    for a, b in cross_pairs(*numbers, sketch, least):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def rest_pairs(texts: DataFrame, nodes: DataFrame, least: float, size: int) -> DataFrame:
    """(a, b): ids of texts in different groups that may have a similarity of ``least`` or more; none such is left out.

    A prefix-filtered join: two texts so alike share one of their rarest shingles. ``texts`` has (id, text), equal ids
    for equal texts; ``nodes`` has (id, group, sketch) of each id: the pairs of a group are linked already. Rarity is that of the shingles that a
    partition holds more than once, added up over all. A shingle of many texts of several groups is dealt to cells.
    """
    spark = texts.sparkSession
    counted = texts.select("text").mapInArrow(lambda it: _often(it, size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(OFTEN_MOST).select("token").collect()
    often = np.array([r["token"] for r in found], np.int64).view(np.uint64)
    schema = "token long, id long, place int, n int"
    tokens = stash(texts.select("id", "text").mapInArrow(lambda it: _rare(it, size, least, often), schema), "tokens")
    # Counted before anything is dealt by a token, so that a hot one's rows stay spread.
    met = tokens.groupBy("token").agg(F.count("*").alias("texts"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = join_by_size(tokens, stash(met.select("token", "texts"), "met"), ["token"], "texts").select("token", "id", "place", "n").distinct()
    placed = stash(shared.join(nodes.select("id", "group"), "id"), "placed")
    per_group = placed.groupBy("token", "group").count()
    several = per_group.groupBy("token").agg(F.sum("count").alias("texts"), F.max_by("group", "count").alias("main"), F.max("count").alias("most")).where("most < texts")
    meeting = stash(join_by_size(placed, stash(several, "several"), ["token"], "texts"), "meeting")
    dealt = deal_cells(meeting, CELL_TEXTS)
    # Only what is in tokens of several groups takes its sketch along.
    cells = dealt.join(nodes.select("id", "sketch"), "id").select("token", "cell", "block", "group", "id", "place", "n", "sketch").repartition("token", "cell")
    return stash(cells.mapInArrow(lambda it: _cross(it, least), "a long, b long").distinct(), "apart")


def deal_cells(meeting: DataFrame, most: int) -> DataFrame:
    """Rows (token, id, group, texts, main, most...) with the cells, and the block in each, in which their pairs are made.

    A token of up to ``most`` texts is one cell (-1). Of a larger one, most texts are of one group as a rule: each of
    those is in one cell, with all texts of other groups; and these are paired among themselves, in blocks. So pairs of the
    main group's own need no cell, and one text beside a million near copies costs a row for each ``most`` of them.
    """
    blocks = lambda c: F.ceil(c / most).cast("long")
    hashed = F.xxhash64("id")
    main, other = blocks(F.col("most")), blocks(F.col("texts") - F.col("most"))
    own, is_main = F.pmod(hashed, other), F.col("group") == F.col("main")
    in_main = F.transform(F.sequence(F.lit(0).cast("long"), main - 1), lambda k: 2 * k + 1)
    among = F.transform(F.sequence(F.lit(0).cast("long"), other - 1), lambda k: F.when(k == own, -2 - k).otherwise(2 * (F.least(k, own) * other + F.greatest(k, own))))
    cell = F.when(F.col("texts") <= most, F.array(F.lit(-1).cast("long"))).when(is_main, F.array(2 * F.pmod(hashed, main) + 1)).otherwise(F.concat(in_main, among))
    dealt = meeting.select("token", "id", "place", "n", "group", is_main.cast("long").alias("is_main"), own.alias("own"), F.explode(cell).alias("cell"))
    return dealt.withColumn("block", F.when(F.pmod("cell", F.lit(2)) == 1, F.col("is_main")).otherwise(F.col("own"))).drop("is_main", "own")


def _similar(pairs: DataFrame, source: DataFrame, nodes: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs of keys (a, b) whose texts have a similarity of ``least`` or more."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes.select("key", "least_id"), "key")
    needed = small(stash(needed.select("key", F.col("least_id").alias("id")), "needed"))
    # Both are the join's keys, so that the copies of a text are spread by their ids.
    own = source.join(needed, (source["key"] == needed["key"]) & source["doc_id"].eqNullSafe(needed["id"]), "left_semi")
    texts = stash(own.select("key", "text").dropDuplicates(["key"]), "texts")
    first, second = (texts.select(F.col("key").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    compared = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    return compared.mapInArrow(lambda it: _verified(it, least, size), "a string, b string")


#: Rows of keys up to which a list is broadcast, so that texts need not be shuffled to meet it: some 50 MB.
SMALL_ROWS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast if its rows, which are counted, are few; else the join shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def _passage_links(source: DataFrame, nodes: DataFrame, least: float, size: int, budget: int) -> DataFrame:
    """(node, component) of the texts that are alike and share a class of passages, written.

    In each class the text that shares the largest part of its passages (an original shares more than its edited copies)
    stands for the class, and each other text of it is compared with that one whole.
    """
    one = stash(nodes.select("key", F.explode(F.array_distinct("prints")).alias("fp")), "prints")
    linked = link_fingerprints(one.select("fp").distinct(), budget)
    classed = one.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("component", "fp").alias("class")).distinct()
    shared = classed.groupBy("class").count().where("count > 1").select("class")
    common = stash(classed.join(shared, "class"), "classes")
    rank = common.groupBy("key").agg(F.count("*").alias("n")).join(nodes.select("key", "least_id", F.size("prints").alias("all")), "key")
    own = F.struct((F.col("n") / F.col("all")).alias("share"), (-F.coalesce("least_id", F.lit(0))).alias("first"), "key").alias("rank")
    ranked = common.join(rank.select("key", own), "key")
    chief = ranked.groupBy("class").agg(F.max("rank").alias("rank"), F.count("*").alias("texts"))
    chief = stash(chief.select("class", F.col("rank.key").alias("b"), "texts"), "chiefs")
    pairs = stash(join_by_size(common, chief, ["class"], "texts").where("key <> b").select(F.col("key").alias("a"), "b").distinct(), "pairs")
    links = stash(_similar(pairs, source, nodes, least, size), "links")
    return stash(connected_components(links), "groups")


def _rest_links(source: DataFrame, nodes: DataFrame, groups: DataFrame, least: float, size: int) -> DataFrame:
    """(a, b): links between texts of different groups, written; none of ``least`` similarity is left out."""
    number = F.xxhash64("key")  # should two keys share one, both are compared
    grouped = nodes.join(groups.withColumnRenamed("node", "key"), "key", "left").select(number.alias("id"), F.xxhash64(F.coalesce("component", "key")).alias("group"), "sketch")
    apart = rest_pairs(source.select(number.alias("id"), "text"), grouped, least, size)
    keys = nodes.select(number.alias("id"), "key")
    first, second = (keys.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}")) for c in ("a", "b"))
    rest = stash(apart.join(first, "a").join(second, "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b")), "rest")
    return stash(_similar(rest, source, nodes, least, size), "links")


def distinct_near(docs: DataFrame, least: float = SIMILARITY, size: int = NEAR_SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` (all columns) with one of each group of equal or near-equal texts: that of the smallest id.

    SimHashes of passages are linked by the trie join, and texts that share a class of linked passages are compared whole
    with the text that stands for it: similarity of word shingles of ``least`` or more links them. Equal texts are one
    node from the start, so that neither classes nor comparisons grow with a text's copies, and each text has at most
    ``PASSAGES`` of these comparisons. What they leave apart goes through ``rest_pairs``, which leaves out no pair of
    ``least`` similarity. Repeated rows leave one; null texts are empty ones; rows of a null id give way to others with
    the same text. An empty table stays empty. What is written on the way is removed, but for the list
    of texts that go or have copies; texts are shuffled to meet it only if it is long.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("").cast("binary"))  # texts without words are equal
    source = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    with scope(spark) as keep:
        with scope(spark) as hand:
            prints = stash(source.select("doc_id", "key", "text").mapInArrow(lambda it: _passage_batches(it, size), "doc_id long, key string, prints array<long>, sketch binary"), "passages")
            one = F.min("doc_id").alias("least_id"), F.count("*").alias("rows"), F.first("prints").alias("prints"), F.first("sketch").alias("sketch")
            nodes = hand(stash(prints.groupBy("key").agg(*one), "nodes"))
        with scope(spark) as hand:
            groups = hand(_passage_links(source, nodes, least, size, budget))
        with scope(spark) as hand:
            more = hand(_rest_links(source, nodes, groups, least, size))
        linked = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        grouped = nodes.select("key", "least_id", "rows").join(connected_components(linked).withColumnRenamed("node", "key"), "key", "left")
        grouped = stash(grouped.withColumn("g", F.coalesce("component", "key")), "grouped")
        first = F.min(F.struct(F.col("least_id").isNull(), "least_id", "key")).alias("m")
        stays = grouped.groupBy("g").agg(first).select("g", F.col("m.key").alias("first"))
        # All that is not as it came: texts that go, and those with copies.
        changed = grouped.join(stays, "g").withColumn("stays", F.col("key") == F.col("first")).where("rows > 1 or not stays")
        changed = keep(stash(changed.select("key", F.col("least_id").alias("id"), "stays"), "changed"))
    listed = small(changed)
    alone = source.join(listed, "key", "left_anti")
    chosen = small(changed.where("stays"))
    copied = source.join(chosen, (source["key"] == chosen["key"]) & source["doc_id"].eqNullSafe(chosen["id"]), "left_semi").dropDuplicates(["key"])
    return alone.unionByName(copied).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
