"""License scans: exact pigeonhole seeds find candidate places, bounded-error matching verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.llm.shared import arrow_batches, steps, table

# The base phrases and their labels; the short notices that the fuzzy search knows, each with its label and
# the words that tell it from the notices of other licenses and versions.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "released under the mit license": ("mit", ["mit"]),
    "licensed under the mit license": ("mit", ["mit"]),
    "licensed under the apache license version 2 0": ("apache-2", ["apache", "2"]),
    "licensed under the bsd 3 clause license": ("bsd-3-clause", ["bsd", "3"]),
    "gnu general public license version 3": ("gpl-3", ["general", "3"]),
    "gnu lesser general public license": ("lgpl", ["lesser"]),
    "mozilla public license version 2 0": ("mpl-2", ["mozilla", "2"]),
    "creative commons attribution sharealike": ("cc-by-sa", ["sharealike"]),
    "creative commons attribution noncommercial": ("cc-by-nc", ["noncommercial"]),
    "permission is hereby granted free of charge to any person": ("mit", ["granted"]),
    "redistribution and use in source and binary forms": ("bsd-3-clause", ["redistribution"]),
}
#: Edits (insertions, deletions, substitutions of characters) for each 10 characters of a notice.
EDITS_PER_10 = 1

#: Bytes of a word: digits, lower-case letters and all beyond ASCII; any other byte parts words.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The borders of a word: a space or the text's end.
_EDGE = rb"(?<![^ ])", rb"(?![^ ])"

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"


def normal(text: str | None) -> bytes:
    """The words of a text (A-Z lower-cased), each between single spaces."""
    return b" ".join((text or "").encode().lower().translate(_WORD_BYTES).split())


def pigeonhole(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 pieces with their starts: a text within that many edits holds at least one unchanged."""
    raw, n = notice.encode(), edits + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _automaton(per_10: int):
    """Every seed in one automaton, with the notices and offsets it comes from, and a fuzzy pattern for each notice."""
    import ahocorasick

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, notice in enumerate(NOTICES):
        edits = max(1, len(notice) * per_10 // 10)
        patterns.append((notice, edits, regex.compile(_EDGE[0] + rb"(?:%s){e<=%d}" % (notice.encode(), edits) + _EDGE[1], regex.BESTMATCH)))
        for start, seed in pigeonhole(notice, edits):
            seeds.setdefault(seed.decode(), []).append((i, start))
    found = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        found.add_word(seed, (len(seed), uses))
    found.make_automaton()
    return found, patterns


@lru_cache(maxsize=64)
def _key_pattern(key: str) -> regex.Pattern:
    """Where a telling word stands: a number unchanged, a short word with one edit at most, a long one with one edit and
    perhaps in a word with others."""
    if len(key) < 3:
        return regex.compile(_EDGE[0] + key.encode() + _EDGE[1])
    before, after = _EDGE if len(key) < 6 else (b"", b"")
    return regex.compile(before + rb"(?:%s){e<=1}" % key.encode() + after)


def _base_places(padded: bytes) -> Iterator[tuple[int, str]]:
    for phrase, label in BASE.items():
        sought = b" " + phrase.encode() + b" "
        at = padded.find(sought)
        while at >= 0:
            yield at, label
            at = padded.find(sought, at + 1)


def _fuzzy_places(words: bytes, per_10: int) -> set[tuple[str, int, int, int, int]]:
    """(label, first byte, end, edits, notice's length) of the notices: seeds give places, the bounded-error match
    around each decides, and the notice's telling words must be in it."""
    automaton, patterns = _automaton(per_10)
    starts: dict[int, set[int]] = {}
    for end, (length, uses) in automaton.iter(words.decode("latin-1")):  # one character for each byte
        for i, start in uses:
            starts.setdefault(i, set()).add(end + 1 - length - start)
    found = set()
    for i, own in starts.items():
        notice, edits, pattern = patterns[i]
        label, keys = NOTICES[notice]
        ordered = sorted(own)
        at = 0
        while at < len(ordered):  # places within ``edits`` of the first share a search
            to = at
            while to + 1 < len(ordered) and ordered[to + 1] <= ordered[at] + edits:
                to += 1
            low, high = max(0, ordered[at] - edits), min(len(words), ordered[to] + len(notice) + 2 * edits)
            for m in pattern.finditer(words, low, high):
                whole = words[m.end() : m.end() + 1] in (b"", b" ")  # the search may have been cut within a word
                if whole and all(_key_pattern(k).search(m.group()) for k in keys):
                    found.add((label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
            at = to + 1
    return found


def scan(text: str | None, per_10: int = EDITS_PER_10) -> dict:
    """One text's digest and the spans of its notices.

    Base places are exact runs of a phrase's words, overlapping ones included. Further notices may differ by edits in
    proportion to their length; the best match around each seed counts. ``score`` is 1 for a base place, else the share of
    characters that agree in the best fuzzy match, 0 if nothing was found.
    """
    words = normal(text)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    base = list(_base_places(b" " + words + b" "))
    places = np.searchsorted(gaps, np.array([at for at, _ in base], np.int64))  # a place in the padded words is one in the words
    fuzzy = _fuzzy_places(words, per_10)
    spans = {(label, *(int(k) for k in np.searchsorted(gaps, [low, high])), wrong) for label, low, high, wrong, _ in fuzzy}
    base_labels = {x for _, x in base}
    return {
        "n_words": len(gaps) + 1 if words else 0,
        "n_base": len(base),
        "first_word": int(places.min()) if base else None,
        "last_word": int(places.max()) if base else None,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | {f[0] for f in fuzzy})),
        "score": max([1.0 if base else 0.0, *(1 - wrong / n for *_, wrong, n in fuzzy)]),
        "spans": [dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in sorted(spans)],
    }


def _scan_batches(batches: Iterator[pa.RecordBatch], per_10: int, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        rows = [scan(t, per_10) for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in list(kind)[1:])]
        yield pa.RecordBatch.from_arrays(columns, schema=kind)


def license_scan(docs: DataFrame, per_10: int = EDITS_PER_10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels, places and spans of license notices in every whole text; a map over the rows, without a shuffle.

    A null or empty text has no words, labels or places. Repeated rows give repeated results. Very long texts are
    handled one by one. An empty table gives no rows. Extra columns of ``docs`` are ignored.
    """
    arrow_batches(docs.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _scan_batches(it, per_10, kind), SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
