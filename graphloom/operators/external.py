"""Composition databases: filters, references, pivots and candidate triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import clean_title, keep_id_keys, merge_id_maps, scientific_name_query
from graphloom.sources.kg import ID_KEYS
from graphloom.sources.written import stash

#: References that are sent to the citing rows, at most; more are joined by a shuffle.
SENT = 1 << 18


def valid_external_rows(rows: DataFrame) -> DataFrame:
    """Rows with a taxon and a compound or registry number; article ids lose what follows a dot."""
    kept = rows.where("head_ncbi_taxid is not null and (tail_pubchem is not null or tail_cas is not null)")
    return kept.withColumn("reference_pmid", F.split_part("reference_pmid", F.lit("."), F.lit(1)))


def positive_amounts(rows: DataFrame, amount: str = "amount") -> DataFrame:
    return rows.where(F.col(amount) > 0)


def raw_foods(foods: DataFrame, ignored_groups: list[str], ignored_subgroups: list[str], name: str = "name", always: list[str] = ()) -> DataFrame:
    """Foods with a scientific name outside the ignored groups whose name says raw, and named exceptions."""
    group = ~F.coalesce(F.col("food_group").isin(ignored_groups) if ignored_groups else F.lit(False), F.lit(False))
    sub = ~F.coalesce(F.col("food_subgroup").isin(ignored_subgroups) if ignored_subgroups else F.lit(False), F.lit(False))
    raw = F.lower(name).contains("raw") | (F.col(name).isin(list(always)) if always else F.lit(False))
    return foods.where(F.col("scientific_name").isNotNull() & group & sub & raw)


def taxon_of_link(link: Column) -> Column:
    """The taxon in a link's last number; anything else fails."""
    found = F.regexp_extract(link, r"^(?:.*(?:NCBITaxon_|conceptid=|[?&]id=|/))?([0-9]+)$", 1)
    return F.when(link.isNull(), F.lit(None).cast("string")).when(found == "", F.raise_error(F.concat(F.lit("no taxon: "), link)).cast("string")).otherwise(found)


def validated_foods(foods: DataFrame) -> DataFrame:
    """Foods not marked to skip, with ``ncbi_taxid`` of their checked link."""
    return foods.where("not coalesce(skip, false) and link is not null").withColumn("ncbi_taxid", taxon_of_link(F.col("link")))


def explode_references(rows: DataFrame, references: DataFrame, ids: str = "reference_ids") -> DataFrame:
    """One row for each cited reference that is known; quality is high if it has an article id, else low."""
    cited = rows.withColumn("reference_id", F.explode(F.split(ids, ","))).withColumn("reference_id", F.trim("reference_id").try_cast("int"))
    return cited.join(references.select("reference_id", "pmid", "reference_name"), "reference_id").withColumn("quality", F.when(F.col("pmid").isNotNull(), "high").otherwise("low"))


def lookup_composition(rows: DataFrame, foods: DataFrame, chemicals: DataFrame) -> DataFrame:
    """Composition rows of known foods and chemicals, with their names and ids."""
    return rows.join(foods, "food_id").join(chemicals, "chemical_id")


def external_to_candidates(rows: DataFrame, source: str) -> DataFrame:
    """Candidate triples of external rows: whole food "contains" chemical, with the ids that are known."""
    one = lambda key, column: F.when(F.col(column).isNotNull(), F.create_map(F.lit(key), F.array(column)))
    tail = keep_id_keys(merge_id_maps(one("PubChem", "tail_pubchem"), one("CAS", "tail_cas")), ID_KEYS)
    head = F.struct(F.lit("organism").alias("type"), F.col("head").alias("name"), F.create_map(F.lit("NCBI_taxonomy"), F.array("head_ncbi_taxid")).alias("other_db_ids"), F.lit("p0").alias("part_id"))
    return rows.select(head.alias("head"), F.lit("contains").alias("relation"), F.struct(F.lit("chemical").alias("type"), F.col("tail").alias("name"), tail.alias("other_db_ids"), F.lit(None).cast("string").alias("part_id")).alias("tail"), F.lit(source).alias("source"), "quality", F.col("reference_pmid").alias("pmid"), F.col("reference_title").alias("title"))


def pivot_attributes(rows: DataFrame, item: str, names: list[str], join_all: bool = False) -> DataFrame:
    """One row an item: for each named attribute its smallest value, or all values joined by ';'."""
    value = (lambda n: F.array_join(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.col("value")))), ";")) if join_all else (lambda n: F.min(F.when(F.col("name") == n, F.col("value"))))
    return rows.groupBy(item).agg(*(value(n).alias(n) for n in names))


def is_indexed(references: DataFrame, journals: DataFrame) -> DataFrame:
    """``references`` with ``indexed``: the ISSN or the lower-cased journal is in a list.

    ``journals`` has (issn, title); ISSNs compare without dashes, cells with a mark after the number are cut to it.
    """
    number = lambda c: F.translate(F.when(F.col(c).contains("("), F.substring(c, 1, 9)).otherwise(F.col(c)), "-", "")
    issns = journals.select(number("issn").alias("__i")).where("__i <> ''").distinct().withColumn("by_issn", F.lit(True))
    titles = journals.select(F.lower("title").alias("__t")).where("__t <> ''").distinct().withColumn("by_title", F.lit(True))
    keyed = references.withColumn("__i", number("issn")).withColumn("__t", F.lower("journal_title"))
    return keyed.join(issns, "__i", "left").join(titles, "__t", "left").select(*references.columns, F.coalesce("by_issn", "by_title", F.lit(False)).alias("indexed"))


def _known(references: DataFrame, most: int = SENT) -> DataFrame:
    """Distinct references, broadcast where a count shows them to be few: a row's citations are then put together again in the
    task that has parted them, and one row an association is shuffled."""
    refs = stash(references.distinct(), "references")
    return F.broadcast(refs) if refs.count() <= most else refs


def association_funnel(rows: DataFrame, references: DataFrame, known_foods: DataFrame, known_chemicals: DataFrame) -> DataFrame:
    """Counts: associations, with a reference, with an indexed one, and of these with known food and chemical."""
    cited = rows.select("association_id", "food_id", "chemical_id", F.explode_outer(F.split("reference_ids", ",")).alias("ref"))
    refs = _known(references.select(F.col("reference_id").cast("string").alias("ref"), F.col("indexed"), F.lit(True).alias("found")))
    joined = cited.withColumn("ref", F.trim("ref")).join(refs, "ref", "left").groupBy("association_id", "food_id", "chemical_id").agg(F.max(F.coalesce("found", F.lit(False))).alias("found"), F.max(F.coalesce("indexed", F.lit(False))).alias("indexed"))
    known = joined.join(known_foods.select("food_id", F.lit(True).alias("f")).distinct(), "food_id", "left").join(known_chemicals.select("chemical_id", F.lit(True).alias("c")).distinct(), "chemical_id", "left")
    return known.agg(F.count("*").alias("associations"), F.count_if("found").alias("with_reference"), F.count_if("indexed").alias("with_indexed"), F.count_if(F.col("indexed") & F.col("f").isNotNull() & F.col("c").isNotNull()).alias("with_indexed_known"))


def associations_by(rows: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """(by, associations, with_reference): a composition table's associations by food or compound, and those with a
    reference that is known."""
    cited = rows.select("association_id", *by, F.explode_outer(F.split("reference_ids", ",")).alias("ref"))
    refs = _known(references.select(F.col("reference_id").cast("string").alias("ref"), F.lit(True).alias("found")))
    one = cited.withColumn("ref", F.trim("ref")).join(refs, "ref", "left").groupBy("association_id", *by).agg(F.max(F.coalesce("found", F.lit(False))).alias("found"))
    return one.groupBy(*by).agg(F.count("*").alias("associations"), F.count_if("found").alias("with_reference"))


def food_db_pairs(contents: DataFrame, foods: DataFrame, compounds: DataFrame) -> DataFrame:
    """Distinct (tax_id, cid) of another database's compound rows; compounds join by structure code."""
    rows = contents.where("source_type = 'Compound'").join(foods.select("food_id", "tax_id"), "food_id").join(compounds.select("compound_id", "cid"), "compound_id")
    return rows.where("tax_id is not null and cid is not null").select("tax_id", "cid").distinct()


def title_to_pmid(titles: DataFrame, candidates: DataFrame) -> DataFrame:
    """``titles`` (title) with the first candidate's ``pmid`` (by ``position``) whose clean title is the same, or null."""
    wanted = titles.select("title", clean_title(F.col("title")).alias("__c")).distinct()
    found = candidates.select(F.col("query_title").alias("title"), "pmid", "position", clean_title(F.col("found_title")).alias("__c"))
    first = wanted.join(found, ["title", "__c"]).groupBy("title").agg(F.min_by("pmid", "position").alias("pmid"))
    return titles.join(first, "title", "left")


def name_to_taxid(names: DataFrame, tax_names: DataFrame) -> DataFrame:
    """``names`` (scientific_name) with the ids of their clean form, joined by ';'."""
    wanted = names.withColumn("query", scientific_name_query(F.col("scientific_name")))
    ids = tax_names.groupBy(F.col("name_txt").alias("query")).agg(F.array_join(F.array_sort(F.collect_set("tax_id")), ";").alias("tax_ids"))
    return wanted.join(ids, "query", "left")


def validation_sheet(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each name, to be checked by hand."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
