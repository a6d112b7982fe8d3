"""Column functions on text, names, identifiers and nested values."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that title searches leave out.
TITLE_STOP_WORDS = (
    "a", "about", "again", "all", "almost", "also", "although", "always", "among", "an", "and", "another", "any",
    "are", "as", "at", "be", "because", "been", "before", "being", "between", "both", "but", "by", "can", "could",
    "did", "do", "does", "done", "due", "during", "each", "either", "enough", "especially", "etc", "for", "found",
    "from", "further", "had", "has", "have", "having", "here", "how", "however", "i", "if", "in", "into", "is", "it",
    "its", "itself", "just", "kg", "km", "made", "mainly", "make", "may", "mg", "might", "ml", "mm", "most", "mostly",
    "must", "nearly", "neither", "no", "nor", "obtained", "of", "often", "on", "our", "overall", "perhaps", "pmid",
    "quite", "rather", "really", "regarding", "seem", "seen", "several", "should", "show", "showed", "shown", "shows",
    "significantly", "since", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "then", "there",
    "therefore", "these", "they", "this", "those", "through", "thus", "to", "upon", "various", "very", "was", "we",
    "were", "what", "when", "which", "while", "with", "within", "without", "would",
)
# Terms of scientific names.
VARIANT_TERMS = ["sp.", "ssp.", "subsp.", "var.", "sp", "ssp", "subsp", "var"]
CROSS_TERMS = ["x", "×"]
UNCLEAR_TERMS = ["convar.", "convar"]


def tokens(text: Column) -> Column:
    """Lower-cased words without other characters than letters, digits and blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^A-Za-z0-9 ]+", ""), r"\s+"), lambda x: x != "")


def text_slice(text: Column, start: Column, length: Column) -> Column:
    """Characters by 0-based offset and length, in code points."""
    return F.substring(text, start + 1, length)


def clean_title(title: Column) -> Column:
    """Lower-cased title without punctuation, blanks and dashes, for comparison."""
    return F.regexp_replace(F.lower(title), r"[!-/:-@\[-`{-~ –—]", "")


def title_query(title: Column, stop_words: Sequence[str] = TITLE_STOP_WORDS) -> Column:
    kept = F.filter(F.split(title, " "), lambda w: ~w.isin(list(stop_words)))
    return F.array_join(F.transform(kept, lambda w: F.concat(w, F.lit("[Title]"))), " AND ")


def scientific_name_query(name: Column) -> Column:
    """A scientific name as genus, species and the first variant; or why there is none.

    Names with fewer than two terms, abbreviated first terms, terms that need a look, over two terms without any
    abbreviation, or a dot inside a term are invalid; names with a cross sign are crosses. A variant term without a
    word after it is kept alone.
    """
    bare = F.regexp_replace(name, r"[()]", "")
    terms = F.filter(F.split(bare, " "), lambda t: t != "")
    n = F.size(terms)
    cross = F.lit(False)
    for term in CROSS_TERMS:
        cross = cross | bare.contains(f" {term} ")
    dotted = lambda t: t.contains(".")
    invalid = (n < 2) | F.coalesce(dotted(F.get(terms, F.lit(0))) | dotted(F.get(terms, F.lit(1))), F.lit(False))
    invalid = invalid | F.exists(terms, lambda t: t.isin(UNCLEAR_TERMS)) | ((n > 2) & ~dotted(bare))
    invalid = invalid | F.exists(terms, lambda t: dotted(t) & ~t.endswith("."))
    rest = F.slice(terms, 3, F.greatest(n - 2, F.lit(0)))
    # The place of the first variant term among the rest, from 1; 0 if there is none.
    place = F.coalesce(F.array_min(F.filter(F.transform(rest, lambda t, i: F.when(t.isin(VARIANT_TERMS), i + 1)), lambda i: i.isNotNull())), F.lit(0))
    raw = F.get(rest, place - 1)
    full = F.when(raw.endswith("."), raw).otherwise(F.concat(raw, F.lit(".")))
    variant = F.when(full.isin("sp.", "ssp."), F.lit("subsp.")).otherwise(full)
    parts = F.array(F.get(terms, F.lit(0)), F.get(terms, F.lit(1)), F.when(place > 0, variant), F.when(place > 0, F.get(rest, place)))
    return F.when(name.isNull(), F.lit(None)).when(cross, F.lit("CROSS_BREED")).when(invalid, F.lit("INVALID_SCIENTIFIC_NAME")).otherwise(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " "))


#: Endings of plurals and what they become, tried in order; words in ``_SAME`` stay.
_ENDINGS = [("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("oes", "o"), ("ves", "f")]
_IRREGULAR = {"leaves": "leaf", "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot", "children": "child", "olives": "olive", "chives": "chive", "endives": "endive"}
_SAME = ("ss", "us", "is", "as", "os")


def singular_word(word: str) -> str:
    """One English noun in the singular, by a small table of endings (a documented subset of English)."""
    low = word.lower()
    if low in _IRREGULAR:
        return _IRREGULAR[low]
    for ending, to in _ENDINGS:
        if low.endswith(ending) and len(low) > len(ending) + 1:
            return word[: -len(ending)] + to
    return word[:-1] if low.endswith("s") and not low.endswith(_SAME) and len(low) > 3 else word


def _singular_texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: None if t is None else " ".join(map(singular_word, t.split())))


def singularize(text: Column) -> Column:
    """Each word of a text in the singular."""
    return F.pandas_udf(_singular_texts, StringType())(text)


def unique_names(names: Column) -> Column:
    """Names that differ by more than case, each in its smallest spelling, sorted."""
    lows = F.array_distinct(F.transform(names, F.lower))
    return F.array_sort(F.transform(lows, lambda k: F.array_min(F.filter(names, lambda x: F.lower(x) == k))))


def merge_id_maps(a: Column, b: Column) -> Column:
    """Union of two maps of id lists: the lists of a key together, sorted, each id once."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,array<string>>")), F.coalesce(b, F.create_map().cast("map<string,array<string>>")), lambda k, x, y: F.array_sort(F.array_union(F.coalesce(x, empty), F.coalesce(y, empty))))


def keep_id_keys(ids: Column, keys: list[str]) -> Column:
    return F.map_filter(ids, lambda k, v: k.isin(keys) & (F.size(v) > 0))


def triple_key(head: Column, relation: Column, tail: Column, sep: str = ",") -> Column:
    return F.concat(F.lit("("), head, F.lit(sep), relation, F.lit(sep), tail, F.lit(")"))


def triple_relation(key: Column) -> Column:
    return F.trim(F.split_part(key, F.lit(","), F.lit(2)))


def numeric_id(entity_id: Column) -> Column:
    return F.substring(entity_id, 2, 20).try_cast("bigint")


def structure_code(inchikey: Column) -> Column:
    return F.split_part(inchikey, F.lit("-"), F.lit(1))


def whole_name(name: Column) -> Column:
    """An entity's name without its part."""
    return F.split_part(name, F.lit(" - "), F.lit(1))


def kind(entity_type: Column) -> Column:
    return F.split_part(entity_type, F.lit(":"), F.lit(1))


def rank(entity_type: Column) -> Column:
    return F.nullif(F.split_part(entity_type, F.lit(":"), F.lit(2)), F.lit(""))


def uncertainty(prob: Column) -> Column:
    return F.least(prob, 1 - prob)


def weight(prob: Column, least: float = 0.01) -> Column:
    return F.greatest(prob, F.lit(least))


def parse_answer(answer: Column) -> Column:
    """1 for an answer with yes, 0 for one with no; anything else fails."""
    low = F.lower(answer)
    return F.when(low.contains("yes"), 1).when(low.contains("no"), 0).otherwise(F.raise_error(F.concat(F.lit("neither yes nor no: "), F.coalesce(answer, F.lit("null")))).cast("int"))


def pmid_of_report(text: Column) -> Column:
    """The number after the last colon of a report number that names PubMed."""
    last = F.element_at(F.split(F.element_at(F.split(text, "; "), -1), ": "), -1)
    return F.when(text.contains("PubMedID"), last)


def reference_caption(columns: dict[str, Column]) -> Column:
    """A reference as one line: title and year, then the labelled fields that are given."""
    fields = [F.concat(F.lit(f"{k}:"), F.coalesce(v.cast("string"), F.lit(""))) for k, v in columns.items() if k not in ("title", "year")]
    return F.concat(columns["title"], F.lit(" ("), columns["year"].cast("string"), F.lit(") ["), F.concat_ws(",", *fields), F.lit("]"))


_VALUE = "struct<StringWithMarkup:array<struct<String:string>>>"
_INFO = f"struct<ReferenceNumber:int,Value:{_VALUE}>"
_LEAF = f"struct<TOCHeading:string,Information:array<{_INFO}>>"
_MIDDLE = f"struct<TOCHeading:string,Information:array<{_INFO}>,Section:array<{_LEAF}>>"
_TOP = f"struct<TOCHeading:string,Section:array<{_MIDDLE}>>"
COMPOUND = f"struct<Record:struct<RecordTitle:string,Section:array<{_TOP}>,Reference:array<struct<ReferenceNumber:int,SourceName:string,URL:string>>>>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _only(sections: Column, heading: str) -> Column:
    """The section of a heading; null if there is none, an error if there are several."""

    def checked(found: Column) -> Column:
        single = F.when(F.size(found) > 1, F.raise_error(F.lit(f"several sections: {heading}")).cast("boolean")).otherwise(F.lit(True))
        return F.when(single, F.get(found, F.lit(0)))

    return _let(F.filter(sections, lambda s: s.getField("TOCHeading") == heading), checked)


def _strings(section: Column) -> Column:
    """All strings of a section's values, each once."""
    values = F.transform(section.getField("Information"), lambda i: F.transform(i.getField("Value").getField("StringWithMarkup"), lambda s: s.getField("String")))
    return F.array_distinct(F.coalesce(F.flatten(values), F.array().cast("array<string>")))


def compound_fields(json: Column, top_n: int | None = None) -> dict[str, Column]:
    """Name, registry numbers, structure strings, MeSH pages, synonyms and descriptions of a compound's JSON record.

    A heading that stands twice where one is expected fails. Synonyms are the first ``top_n`` that depositors gave, then
    the MeSH terms that differ from them by more than case.
    """
    none = F.array().cast("array<string>")

    def pages(record: Column, own: Column) -> Column:
        numbers = F.coalesce(F.transform(own.getField("Information"), lambda i: i.getField("ReferenceNumber")), F.array().cast("array<int>"))
        cited = lambda known: F.filter(record.getField("Reference"), lambda r: (r.getField("SourceName") == "Medical Subject Headings (MeSH)") & F.array_contains(known, r.getField("ReferenceNumber")))
        return F.coalesce(F.transform(_let(numbers, cited), lambda r: r.getField("URL")), none)

    def synonyms(section: Column) -> Column:
        given = _strings(_only(section.getField("Section"), "Depositor-Supplied Synonyms"))
        own = _strings(_only(section.getField("Section"), "MeSH Entry Terms"))
        new = lambda g: _let(F.transform(g, F.lower), lambda lows: F.filter(own, lambda t: ~F.array_contains(lows, F.lower(t))))
        return _let(F.slice(given, 1, top_n) if top_n else given, lambda g: F.concat(g, new(g)))

    # Each field parses the record once, and each step within is bound before the next reads it.
    record = lambda f: _let(F.from_json(json, COMPOUND).getField("Record"), f)
    sub = lambda r, heading: _only(_only(r.getField("Section"), "Names and Identifiers").getField("Section"), heading)
    leaf = lambda r, middle, heading: _only(sub(r, middle).getField("Section"), heading)
    strings = lambda middle, heading: record(lambda r: _strings(leaf(r, middle, heading)))
    return {
        "name": F.from_json(json, COMPOUND).getField("Record").getField("RecordTitle"),
        "cas": strings("Other Identifiers", "CAS"),
        "inchi": strings("Computed Descriptors", "InChI"),
        "inchikey": strings("Computed Descriptors", "InChIKey"),
        "smiles": strings("Computed Descriptors", "Canonical SMILES"),
        "mesh_urls": record(lambda r: pages(r, leaf(r, "Synonyms", "MeSH Entry Terms"))),
        "synonyms": record(lambda r: _let(sub(r, "Synonyms"), synonyms)),
        "descriptions": record(lambda r: _strings(sub(r, "Record Description"))),
    }


def pseudo_random(*keys: Column, seed: str = "42") -> Column:
    """A shuffle key that is the same for any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))
