"""Substring dedup: a log-structured index of window fingerprints, merge-joined with each new batch."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.repeats import Units, anchor_counts, cover, keyed, marked, marks, place_rows, scan, with_text
from graphloom.llm.shared import list_column, scope, shared_folder, stash, steps, table
from graphloom.operators.skew import join_by_size

WINDOW = 35
#: Words of the parts of a window whose smallest hash is its fingerprint.
PART = 8
#: Batches that the query takes in one after the other.
BATCHES = 3
#: Runs beyond which the index is compacted.
RUNS = 2


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, times), hashed to the same buckets, so that runs join without a shuffle.

    A window's fingerprint is the smallest hash of ``PART`` consecutive words in it: equal windows have equal ones, and
    neighbours share one, so that a run has a few rows for each hundred words. The index lives in ``folder``; a later
    session that names it goes on with its runs.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/graphloom/index-{uuid.uuid4().hex}").rstrip("/")
        self.runs: list[DataFrame] = []
        self._names: list[str] = []
        found = self._listed()
        if found:
            self.buckets, self._names = found
            self.runs = [self._opened(n) for n in self._names]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> tuple[int, list[str]] | None:
        """The buckets and runs of the latest list: a list is written whole under a new number once its runs are there."""
        path, files = self._path("lists")
        if not files.exists(path):
            return None
        numbers = sorted(int(f.getPath().getName()) for f in files.listStatus(path) if files.exists(self._path(f"lists/{f.getPath().getName()}/_SUCCESS")[0]))
        if not numbers:
            return None
        row = self.spark.read.json(f"{self.folder}/lists/{numbers[-1]}", schema="buckets int, runs array<string>").first()
        return row["buckets"], row["runs"]

    def _list(self) -> None:
        path, files = self._path("lists")
        numbers = [int(f.getPath().getName()) for f in files.listStatus(path)] if files.exists(path) else []
        listed = self.spark.createDataFrame([(self.buckets, self._names)], "buckets int, runs array<string>")
        listed.coalesce(1).write.json(f"{self.folder}/lists/{max(numbers, default=0) + 1}")

    def _opened(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (a BIGINT, times BIGINT) USING parquet CLUSTERED BY (a) SORTED BY (a) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        sorted_ = rows.select("a", "times").repartition(self.buckets, "a").write.bucketBy(self.buckets, "a").sortBy("a")
        sorted_.option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self._names.append(name)
        self.runs.append(self._opened(name))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of (a, times) with unique ``a``: a run that is merge-joined with the runs before it.

        Returns (a, times) of its fingerprints that now stand at two places or more, written, with the number of places.
        """
        before = self.runs.copy()
        self._write(batch)
        merged = self.runs[-1].select("a", "times")
        for old in before:
            held = old.select("a", F.col("times").alias("held")).hint("merge")
            merged = merged.join(held, "a", "left").select("a", (F.col("times") + F.coalesce("held", F.lit(0))).alias("times"))
        hits = stash(merged.where("times > 1"), "hits")
        if len(self.runs) > RUNS:
            self.compact()
        else:
            self._list()
        return hits

    def compact(self) -> None:
        """Merge all runs to one, which replaces them; the old ones are dropped once the new one is listed."""
        old, runs = self._names, self.runs
        if len(runs) < 2:
            return
        merged = runs[0].select("a", "times")
        for run in runs[1:]:
            more = run.select("a", F.col("times").alias("more")).hint("merge")
            merged = merged.join(more, "a", "full").select("a", (F.coalesce("times", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("times"))
        self._names, self.runs = [], []
        self._write(merged)
        self._list()
        for name in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path, files = self._path(name)
            files.delete(path, True)

    def close(self) -> None:
        """Forget the runs' names in the session's catalog; the index stays in its folder."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        """Remove the index with its folder."""
        self.close()
        path, files = self._path("")
        files.delete(path, True)


def _window_digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each context, a digest of the words of every window, with the context's anchor beside them."""
    for column, places in place_rows(batches):
        u = Units(column, True)
        rows = [(u.off[i] + p["s0"], p["n"], p["a"], p["x"]) for i, ps in enumerate(places) for p in ps]
        if not rows:
            continue
        s0, n, a, x = (np.array(v, np.int64) for v in zip(*rows))
        at = np.repeat(s0, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = u.digests(at, at + length).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(x), list_column(w, n, pa.int64())], names=["a", "x", "w"])


def _resolve(source: DataFrame, compare: DataFrame, length: int) -> DataFrame:
    """Verify candidates: the words of the windows of different contexts of one fingerprint, compared by digests.

    Rows are spread by the digest; a context counts once, however many places it has.
    """
    texts = with_text(source, compare, "a x s0 n")
    hashed = stash(texts.mapInArrow(lambda it: _window_digests(it, length), "a long, x long, w array<long>").dropDuplicates(["a", "x"]), "windows")
    one = hashed.select("a", "x", F.posexplode("w").alias("j", "w"))
    twice = stash(one.groupBy("a", "w").agg(F.count("*").alias("times")).where("times > 1"), "twice")
    return join_by_size(one, twice, ["a", "w"], "times").groupBy("a", "x").agg(F.flatten(F.collect_list(F.array("j", F.col("j") + 1))).alias("ranges"))


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        u = Units(batch.column("text"), True)
        w, marked = u.words, batch.column("spans").to_pylist()
        raw, removed, digests = w.buf.tobytes(), np.zeros(w.n, np.int64), []
        starts, ends = w.starts.tolist(), w.ends.tolist()
        for i in range(w.n):
            lo, hi = int(u.off[i]), int(u.off[i + 1])
            gone = cover(marked[i], length, hi - lo)
            removed[i] = gone.sum()
            digests.append(hashlib.sha256(b" ".join([raw[starts[k]: ends[k]] for k in (np.flatnonzero(~gone) + lo).tolist()])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(removed), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, part: int = PART, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): each text without the words of windows that also start elsewhere.

    The documents reach the index in ``batches`` by a hash of their id, each of which is merge-joined with the runs of
    those before it. The fingerprints that these joins hit are the only ones whose windows are looked at: candidates are
    verified word by word, and what repeats over all batches decides for every document, early or late. An ``index`` that
    holds earlier documents goes on from there, and stays; without one, an index of these documents alone is made and
    dropped. ``history`` are the earlier documents, against whose texts hits are verified (they get no rows). Null and empty texts have no words; a text shorter than the window keeps all. Rows may repeat:
    they are copies of each other. An empty table gives no rows. Extra columns of ``docs`` are ignored.
    """
    source = keyed(docs, id_col, text_col)
    with scope(docs.sparkSession) as keep:
        scans = scan(source, True, window, part)
        own = index or FingerprintIndex(docs.sparkSession)
        hits = [own.add(anchor_counts(scans.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))) for b in range(batches)]
        hit = reduce(DataFrame.unionByName, hits).groupBy("a").agg(F.max("times").alias("times"))
        if index is None:
            own.drop()
        texts = source
        if history is not None:
            before = keyed(history, id_col, text_col)
            scans = scans.unionByName(scan(before, True, window, part))
            texts = source.drop("row").unionByName(before.drop("row"))
        found = keep(marks(texts, scans, hit, lambda t, compare: _resolve(t, compare, window)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return marked(source, found).drop("row").mapInArrow(lambda it: _cut(it, window), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
