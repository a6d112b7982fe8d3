"""A corpus made ready for training: quality rules, near-dedup, suffix-array dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and gets all rows that the one before it kept; all but the last return the
columns of ``documents``, whatever those are. Repeated rows are documents of their own until near-dedup, which leaves one.
An empty table stays empty through every stage. Texts of any length are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import graphloom
from graphloom.llm import decontamination, packing, quality_rules, simhash, suffix_array
from graphloom.llm.shared import stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go, null and empty texts among them.

    The trees learn from the labelled rows of ``labels`` that are in ``docs``; without any they pass what the base passes.
    """
    graphloom.ship(spark)
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity of 0.8 or more), that of the
    smallest id.

    Null texts are empty ones, and texts without words are equal; rows of a null id give way to others of their text.
    """
    graphloom.ship(spark)
    return simhash.distinct_near(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 250 bytes or more that stand elsewhere too are cut out of the texts; every row stays.

    Null texts become empty; a text that is shorter stays as it is.
    """
    graphloom.ship(spark)
    return suffix_array.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold or paraphrase benchmark items go; null and empty texts stay."""
    graphloom.ship(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left; a null or empty text is a lone end of document."""
    graphloom.ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the trees nor the fingerprints, the latent space nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the whole of ``documents``, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
