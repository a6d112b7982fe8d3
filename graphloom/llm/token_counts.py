"""Token counts: rollups kept up by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, shared_folder, stash, steps, table
from graphloom.llm.tokens import TOKENIZER, chunk_tokenizer, tokenizer_path

KEYS = ["source", "lang", "version"]
#: White-space words; and the public tokenizer, with the revision of our counts.
WORDS, BPE = "words-1", f"{TOKENIZER.removesuffix('.json')}-1"
_LEDGER = "source string, lang string, version string, docs long, tokens long"
#: Written last into a batch's folder; Spark's readers pass over such names.
_MARKER = "_COMMITTED"


def signed(changes: DataFrame, sign: str = "sign", tokens: str = "tokens") -> DataFrame:
    """Additive deltas by source, language and version of changes (+1 an insert, -1 a delete).

    A revised count is a delete of the old and an insert of the new one. Null keys are groups of their own; a null
    count adds a document without tokens. Rows are summed before the shuffle, so a hot source is a row a task.
    """
    return changes.groupBy(*KEYS).agg(F.sum(F.col(sign)).cast("long").alias("docs"), F.coalesce(F.sum(F.col(sign) * F.col(tokens)), F.lit(0)).cast("long").alias("tokens"))


class Ledger:
    """Deltas in one folder, a sub-folder for each batch, and compacted ones with the names of what they hold.

    A batch counts once its folder holds the marker that is written after the data: what a failed job leaves has none,
    is never read, and is replaced by the next try.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, part: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, schema: str, *parts: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def _compacted(self, part: str, schema: str) -> DataFrame:
        path, files = self._path(part)
        return self._read(schema, *([part] if files.exists(path) else []))

    def _batches(self) -> dict[str, str]:
        """Committed batches that are not compacted, and their folders."""
        path, files = self._path("deltas")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        marked = [n for n in names if files.exists(self._path(f"deltas/{n}/{_MARKER}")[0])]
        return {unquote(n.removeprefix("batch-")): f"deltas/{n}" for n in marked}

    def committed(self) -> set[str]:
        """Names of all batches that count: a name each, not rows of data."""
        return {*self._batches(), *(r[0] for r in self._compacted("held", "batch string").collect())}

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch once; a replay, also of a batch that was compacted, changes nothing and returns False."""
        if batch in self.committed():
            return False
        folder = f"deltas/batch-{quote(batch, safe='')}"
        delta.select(*KEYS, "docs", "tokens").write.mode("overwrite").parquet(f"{self.folder}/{folder}")
        path, files = self._path(f"{folder}/{_MARKER}")
        files.create(path, True).close()
        return True

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents and tokens have all been taken back are gone."""
        both = self._read(_LEDGER, *self._batches().values()).unionByName(self._compacted("base", _LEDGER))
        return both.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self) -> Ledger:
        """A ledger in a new folder that holds one base instead of all deltas, and every batch's name.

        The old one stays as it is until its owner drops it, so that a failed compaction loses nothing.
        """
        new = Ledger(self.spark, f"{self.folder}-{uuid.uuid4().hex[:8]}")
        self.totals().write.parquet(f"{new.folder}/base")
        self.spark.createDataFrame([(b,) for b in sorted(self.committed())], "batch string").write.parquet(f"{new.folder}/held")
        return new

    def drop(self) -> None:
        """Remove the ledger's folder."""
        path, files = self._path("")
        files.delete(path, True)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = chunk_tokenizer(path)
    for batch in steps(batches):
        exact = tokenizer.counts([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("source", "lang", "words", "guess")] + [pa.array(exact, pa.int64())], names=["source", "lang", "words", "guess", "exact"])


def document_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(source, lang, words, guess, exact) for every document: white-space words, a quarter of the bytes, and tokens.

    A null or empty text has none of them. Rows may repeat. Extra columns of ``docs`` are ignored.
    """
    arrow_batches(docs.sparkSession)
    path = path or tokenizer_path()
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long")
    source = docs.select("source", "lang", "text", words.alias("words"), F.expr("cast(octet_length(coalesce(text, '')) div 4 as long)").alias("guess"))
    return source.mapInArrow(lambda it: _counted(it, path), "source string, lang string, words long, guess long, exact long")


def rollup(docs: DataFrame, folder: str) -> Ledger:
    """A ledger of all ``docs``: a load with words and guessed tokens, the tokenizer's revision of the guesses, compaction."""
    counts = stash(document_counts(docs), "counts")
    ledger = Ledger(docs.sparkSession, folder)

    def row(version: str, sign: int, tokens: str) -> Column:
        return F.struct(F.lit(version).alias("version"), F.lit(sign).alias("sign"), F.col(tokens).alias("tokens"))

    def changes(*rows: Column) -> DataFrame:
        return signed(counts.select("source", "lang", F.explode(F.array(*rows)).alias("c")).select("source", "lang", "c.*"))

    ledger.commit("load", changes(row(WORDS, 1, "words"), row(BPE, 1, "guess")))
    revision = changes(row(BPE, -1, "guess"), row(BPE, 1, "exact"))
    ledger.commit("revision", revision)
    compacted = ledger.compact()
    ledger.drop()
    compacted.commit("revision", revision)  # a replay: nothing changes
    return compacted


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, lang, version, docs, tokens) of all documents, by way of three batches, a compaction and a replay.

    Null and empty texts count as documents without tokens, repeated rows each time, null sources and languages as groups
    of their own; without documents there are no rows.
    """
    return rollup(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/graphloom/ledger-{uuid.uuid4().hex}").totals()
