"""Cross-tokenizer alignment: two tokenizers' tokens of each text, grouped at the byte offsets where tokens of both end.

The shared offsets are found by divide and conquer: an interval of a text is cut at a common end near its middle, both
halves go the same way, and an interval without one is a group. The intervals of a batch of texts go down together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, list_column, scope, stash, steps, table
from graphloom.llm.tokens import tokenizer_path

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
#: Chunks, and ids of them, that one Python worker keeps before its cache starts anew.
CACHE_CHUNKS, CACHE_IDS = 1_000_000, 8_000_000
#: Characters from which a chunk is encoded by itself, by the tokenizer's own library.
LONG_CHUNK = 200
#: Pairs of ids whose counts tasks are sent (17 bytes each): the most frequent ones. The others are looked up by a join.
FREQUENT_PAIRS = 1 << 20
#: Links of a group that are made one by one; in a larger one equal ids are counted first.
PLAIN_LINKS = 256

#: White space and what a tokenizer may take for it, but for the three that are sure to be it in both.
_OTHER = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]")
_CHUNKS = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_GUARD = " x"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _ranked(path: str):
    """The vocabulary in the library for ranked tokens, several times as fast; None unless its ids are its merges' order."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    vocabulary, merges, alphabet = read["model"]["vocab"], read["model"]["merges"], byte_alphabet()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
    if read["normalizer"] or any(vocabulary["".join(m)] != len(alphabet) + i for i, m in enumerate(pairs)):
        return None
    special = {t["content"] for t in read["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in entry): i for entry, i in vocabulary.items() if entry not in special}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Slots(dict):
    """Chunks' places in the cache; a new chunk gets the next one and waits in ``new`` for its ids."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = slot = len(self)
        self.new.append(chunk)
        return slot


class TwoTokenizers:
    """Both tokenizers' ids of texts, by cached chunks: white space and what follows it up to the next.

    Neither vocabulary has a token in which such white space follows another character, so that a text's ids are its
    chunks' ids one after the other. Texts with ``_OTHER`` characters are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str, chunks: int = CACHE_CHUNKS, ids: int = CACHE_IDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.ranked = _ranked(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.spelt = [spelling(len(self.bytes_a), ",|"), spelling(len(self.bytes_b), ",;")]
        self.most_chunks, self.most_ids = chunks, ids
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.places = np.zeros((1 << 16, 4), np.int64)  # where a slot's ids of A begin, how many, and the same of B
        self.flat = [np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)]
        self.used = [0, 0]

    def _store(self, side: int, ids: np.ndarray) -> int:
        at = self.used[side]
        while at + len(ids) > len(self.flat[side]):
            self.flat[side] = np.resize(self.flat[side], 2 * len(self.flat[side]))
        self.flat[side][at : at + len(ids)] = ids
        self.used[side] = at + len(ids)
        return at

    def encode(self, text: str, ranked: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids of a space and ``text``; none where the tokens' bytes are not those."""
        spaced = " " + text
        a = np.array(self.ranked.encode_ordinary(spaced) if ranked and self.ranked else self.a.encode(spaced, add_special_tokens=False).ids, np.int32)
        b = np.array(self.b.encode(text), np.int32)
        raw = spaced.encode()
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return a[:0], b[:0]
        return a, b

    def _learn(self, slots: list[int], chunks: list[str], ranked: bool) -> None:
        """Encode new chunks as one text: each begins with white space after another character."""
        a, b = self.encode(_GUARD[1:] + "".join(chunks), ranked)
        cuts = len(_GUARD) + np.cumsum([len(c.encode()) for c in chunks])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        from_a, from_b = (int(np.searchsorted(e, len(_GUARD), "right")) for e in (ends_a, ends_b))
        to_a, to_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        if not (len(a) and (ends_a[to_a - 1] == cuts).all() and (ends_b[to_b - 1] == cuts).all()):
            raise ValueError("a token of the vocabularies crosses white space")
        n_a, n_b = np.diff(to_a, prepend=from_a), np.diff(to_b, prepend=from_b)
        start_a, start_b = self._store(0, a[from_a:]), self._store(1, b[from_b:])
        while max(slots) >= len(self.places):
            self.places = np.resize(self.places, (2 * len(self.places), 4))
        self.places[slots] = np.stack([start_a + np.cumsum(n_a) - n_a, n_a, start_b + np.cumsum(n_b) - n_b, n_b], axis=1)

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: the ids of all texts, one after the other, and each text's number of them."""
        if len(self.slots) > self.most_chunks or max(self.used) > self.most_ids:
            self._clear()
        find, slots, whole = self.slots.__getitem__, [], []
        for t in texts:
            if not t or _OTHER.search(t):
                whole.append(len(slots))
                slots.append(np.zeros(0, np.int64))
            else:
                chunks = _CHUNKS.findall(" " + t)
                slots.append(np.fromiter(map(find, chunks), np.int64, len(chunks)))
        new, self.slots.new = self.slots.new, []
        first = len(self.slots) - len(new)
        short = [k for k, c in enumerate(new) if len(c) < LONG_CHUNK and not c.isspace()]
        for at in range(0, len(short), 2_000):
            some = short[at : at + 2_000]
            self._learn([first + k for k in some], [new[k] for k in some], True)
        for k in sorted({*range(len(new))} - {*short}):
            self._learn([first + k], [new[k]], False)
        counts = np.array(list(map(len, slots)), np.int64)
        places = self.places[np.concatenate(slots)] if slots else self.places[:0]
        alone = {k: self.encode(texts[k]) for k in whole if texts[k]}
        out = []
        for side in (0, 1):
            start, n = places[:, 2 * side], places[:, 2 * side + 1]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[side][np.repeat(start - total[:-1], n) + np.arange(total[-1])]
            per_text = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
            if alone:
                parts = np.split(ids, np.cumsum(per_text)[:-1])
                for k, found in alone.items():
                    parts[k] = found[side]
                ids, per_text = np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
            out.append((ids, per_text))
        return out


@lru_cache(maxsize=1)
def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    """One pair for each Python worker, kept between tasks."""
    return TwoTokenizers(path_a, path_b)


def shared_cuts(ends_a: np.ndarray, counts_a: np.ndarray, ends_b: np.ndarray, counts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A, and of B, end a group.

    ``ends`` are the tokens' ends in the bytes of all texts one after the other, ``counts`` each text's tokens; both
    sides of a text end together. All intervals of one depth are one step: around the middle token of A an end is sought
    that a bisection finds among those of B, first there, then one token to either side, and so on.
    """
    off_a, off_b = (np.concatenate([[0], np.cumsum(c)]) for c in (counts_a, counts_b))
    some = counts_a > 0
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    cut_a[off_a[1:][some] - 1] = True
    cut_b[off_b[1:][some] - 1] = True
    low_a, high_a, low_b, high_b = off_a[:-1][some], off_a[1:][some], off_b[:-1][some], off_b[1:][some]
    while len(low_a):
        wide = (high_a - low_a > 1) & (high_b - low_b > 1)  # one token of a side is a group
        low_a, high_a, low_b, high_b = (x[wide] for x in (low_a, high_a, low_b, high_b))
        middle = (low_a + high_a - 2) // 2
        at_a, at_b = np.full(len(middle), -1), np.zeros(len(middle), np.int64)
        left, away = np.arange(len(middle)), 0
        while len(left):
            # Tokens whose last one is left out: its end is the interval's.
            reach = np.maximum(middle[left] - low_a[left], high_a[left] - 2 - middle[left])
            left = left[away <= reach]
            for k in (middle[left] - away, middle[left] + away)[: 2 if away else 1]:
                inside = (at_a[left] < 0) & (k >= low_a[left]) & (k < high_a[left] - 1)
                probe, own = left[inside], k[inside]
                found = np.searchsorted(ends_b, ends_a[own])
                hit = ends_b[found] == ends_a[own]
                at_a[probe[hit]], at_b[probe[hit]] = own[hit], found[hit]
            left, away = left[at_a[left] < 0], away + 1
        cut = at_a >= 0
        a, b = at_a[cut], at_b[cut]
        cut_a[a], cut_b[b] = True, True
        low_a, high_a, low_b, high_b = (np.concatenate(x) for x in ((low_a[cut], a + 1), (a + 1, high_a[cut]), (low_b[cut], b + 1), (b + 1, high_b[cut])))
    return cut_a, cut_b


def linked_ids(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, most: int = PLAIN_LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, id of A, id of B, times): all links of groups with ``n_a`` and ``n_b`` tokens; larger groups' equal ones together."""
    first_a, first_b, both = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    plain = np.flatnonzero(both <= most)
    size = both[plain]
    group = np.repeat(plain, size)
    k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    parts = [(group, ids_a[first_a[group] + k // n_b[group]], ids_b[first_b[group] + k % n_b[group]], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(both > most).tolist():
        (a, times_a), (b, times_b) = (np.unique(ids[f[g] : f[g] + n[g]], return_counts=True) for ids, f, n in ((ids_a, first_a, n_a), (ids_b, first_b, n_b)))
        parts.append((np.full(len(a) * len(b), g), np.repeat(a, len(b)), np.tile(b, len(a)), np.repeat(times_a, len(b)) * np.tile(times_b, len(a))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def spelling(n: int, marks: str) -> tuple[np.ndarray, np.ndarray]:
    """Row 2 i + k: the decimal digits of id i, then the mark k, in a row of bytes; and how many bytes that is."""
    words = [f"{i}{m}".encode() for i in range(n) for m in marks]
    width = max(map(len, words))
    return np.frombuffer(b"".join(w.ljust(width) for w in words), np.uint8).reshape(-1, width), np.array(list(map(len, words)), np.int64)


def group_texts(ids: list[np.ndarray], cuts: list[np.ndarray], spelt: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The groups as bytes, ``a1,a2|b1;`` one after the other, and where each group ends in them."""
    before = [np.cumsum(c) - c for c in cuts]  # the group of each token
    sizes = [np.bincount(g, minlength=int(c.sum())) for g, c in zip(before, cuts)]
    offset = [np.cumsum(s) - s for s in sizes]
    # A group's tokens of A stand after those of B of the groups before it, its tokens of B after its own of A too.
    place = [np.arange(len(ids[0])) + offset[1][before[0]], np.arange(len(ids[1])) + (offset[0] + sizes[0])[before[1]]]
    width = max(t.shape[1] for t, _ in spelt)
    rows, length = np.zeros((sum(map(len, ids)), width), np.uint8), np.zeros(sum(map(len, ids)), np.int64)
    for i, cut, at, (text, n) in zip(ids, cuts, place, spelt):
        code = 2 * i.astype(np.int64) + cut
        rows[at, : text.shape[1]] = text[code]
        length[at] = n[code]
    ends = np.cumsum(length)
    return rows[np.arange(width) < length[:, None]], ends[place[1][cuts[1]]]


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    both = two_tokenizers(path_a, path_b)
    for batch in steps(batches):
        (ids_a, counts_a), (ids_b, counts_b) = both.ids([t or "" for t in batch.column("text").to_pylist()])
        ends_a, ends_b = np.cumsum(both.size_a[ids_a]), np.cumsum(both.size_b[ids_b])
        cut_a, cut_b = shared_cuts(ends_a, counts_a, ends_b, counts_b)
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        doc = np.repeat(np.arange(batch.num_rows), counts_a)[last_a]
        groups = np.bincount(doc, minlength=batch.num_rows)
        n_links = np.zeros(batch.num_rows, np.int64)
        np.add.at(n_links, doc, n_a * n_b)
        group, a, b, times = linked_ids(ids_a, n_a, ids_b, n_b)
        wide = np.int64(len(both.bytes_b))
        key = (doc[group] * np.int64(len(both.bytes_a)) + a) * wide + b
        if len(times) and times.max() > 1:
            key, where = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, where, times)
        else:
            key, total = np.unique(key, return_counts=True)
        per_doc = wide * len(both.bytes_a)
        raw, ends = group_texts([ids_a, ids_b], [cut_a, cut_b], both.spelt)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(groups)])].tolist()
        text = [sha256(raw[low : high - 1]).hexdigest() if high > low else "" for low, high in zip(ends, ends[1:])]
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (counts_a, counts_b, groups, n_links)), pa.array(text, pa.string())]
        size = np.bincount(key // per_doc, minlength=batch.num_rows)
        columns += [list_column(key % per_doc, size, pa.int64()), list_column(total.astype(np.int32), size, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _pair_counts(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many of a partition's documents; some ``most`` pairs at a time."""
    held, n = [], 0

    def counted() -> pa.RecordBatch:
        pair, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times, pa.int64())], names=["pair", "n"])

    for batch in batches:
        held.append(batch.column("pairs").flatten().to_numpy())
        n += len(held[-1])
        if n >= most:
            yield counted()
            held, n = [], 0
    yield counted()


_LOOKED = "row long, n_best long, count_sum long, pair long, times long"


def _looked_up(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) of the links whose pairs are given, and (row, pair, times) of the others."""
    for batch in batches:
        own, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
        size = batch.column("pairs").value_lengths().to_numpy()
        doc, row = np.repeat(np.arange(batch.num_rows), size), batch.column("row").to_numpy()
        at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
        known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
        sums = np.zeros((2, batch.num_rows), np.int64)
        np.add.at(sums[0], doc[known], times[known] * best[at[known]])
        np.add.at(sums[1], doc[known], times[known] * counts[at[known]])
        n, rest = batch.num_rows, ~known
        none = int(rest.sum())
        columns = [np.concatenate([row, row[doc[rest]]]), *(np.concatenate([s, np.zeros(none, np.int64)]) for s in sums)]
        nulls = np.repeat([True, False], [n, none])
        columns = [pa.array(c, pa.int64()) for c in columns] + [pa.array(np.concatenate([np.zeros(n, np.int64), x[rest]]), pa.int64(), mask=nulls) for x in (own, times)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_best", "count_sum", "pair", "times"])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): each document's alignment, and every id pair of the corpus with its count.

    ``documents`` has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and the lists ``pairs`` and
    ``times``: its distinct linked pairs and how often each is linked. ``pairs`` has ``pair``, ``a`` and ``b``, the ids,
    ``n``, the documents that link them, and ``best``, whether no pair of its A id stands in more.

    Counts of the ``frequent`` most frequent pairs at most (those of ties at the edge left out) are sent to the tasks;
    all others are joined. Null and empty texts, and those whose tokens' bytes are not a space and the text, have no
    tokens: zeros and an empty string. Repeated rows are documents of their own, null ids stay, extra columns are
    ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path_a, path_b = path_a or tokenizer_path(TOKENIZER_A), path_b or tokenizer_path(TOKENIZER_B)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wide = _vocabulary_b(path_b)
    found = source.mapInArrow(lambda it: _aligned(it, path_a, path_b), _ALIGNED).withColumn("row", F.monotonically_increasing_id())
    aligned = stash(found, "aligned")
    counted = aligned.select("pairs").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    with scope(spark) as keep:
        counts = stash(counted.withColumn("a", F.expr(f"pair div {wide}").cast("int")).withColumn("b", (F.col("pair") % wide).cast("int")), "counts")
        top = counts.groupBy("a").agg(F.max("n").alias("top"))
        pairs = keep(stash(counts.join(top, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("top")).alias("best")), "pairs"))
        # The least count of which no more than ``frequent`` pairs have as much.
        least, held = None, 0
        for r in pairs.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n")).toLocalIterator():
            held += r["pairs"]
            if held > frequent:
                break
            least = r["n"]
        chosen = pairs.where(F.lit(False) if least is None else F.col("n") >= least).select("pair", "n", "best").toArrow()
        pair, n, best = (chosen.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        sent = spark.sparkContext.broadcast((pair[order], n[order], best[order].astype(np.int64)))
        looked = stash(aligned.select("row", "pairs", "times").mapInArrow(lambda it: _looked_up(it, *sent.value), _LOOKED), "looked")
        rest = looked.where("pair is not null").select("row", "pair", "times").join(pairs, "pair")
        rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        summed = keep(stash(looked.where("pair is null").select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "summed"))
    joined = aligned.join(summed, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times")
    return joined, pairs


def _vocabulary_b(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's numbers of tokens, groups and links, and the digest of its groups; null and empty texts have zeros."""
    return align(table(spark, sf_dir, "documents"))[0].drop("pairs", "times")
