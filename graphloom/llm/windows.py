"""Incremental substring dedup: a log-structured index of window hashes that a later batch needs no earlier text for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, scope, stash, steps
from graphloom.llm.substrings import WINDOW, _cut
from graphloom.llm.words import FIRST, Rolling, Words
from graphloom.operators.skew import join_by_size
from graphloom.sources.runs import RunStore, Table

#: A second hash of a window, by another base and from its words' hashes, too: both must agree.
SECOND = Rolling(29)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, j, w, v): every window of each text by its first word, with two hashes."""
    for batch in steps(batches):
        words = Words(batch.column("text"))
        at, w = words.windows(size)
        v = SECOND.ranges(SECOND.prefix(words.hash), at, at + size)
        doc = words.doc[at]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(at - words.word_off[doc], pa.int32()), pa.array(w.view("int64")), pa.array(v.view("int64"))], names=["key", "j", "w", "v"])


class WindowIndex:
    """Runs of the windows of all batches so far, sorted by hash: each distinct window once, with the batch that brought it.

    A batch is named. Its windows are counted, shuffled to the runs' buckets and merge-joined with them; a window is one
    that was met before if both its hashes are, 128 bits, so that no earlier text is read again. What is new of it becomes a
    run of its own; the store merges runs beyond eight. A batch that comes again, after a failure or twice, is compared
    with the batches before it only, and adds nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, buckets: int | None = None):
        self.spark, self.window = spark, window
        self.store = RunStore(spark, folder, {"windows": Table("w bigint, v bigint, batch bigint", "w")}, buckets)

    def add(self, batch: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of a batch: its texts without the words of windows that also start
        elsewhere in it, or that an earlier batch had.

        Earlier batches' texts stay as they were given out. Null and empty texts have no words; a text shorter than the
        window keeps all. Repeated rows are copies of each other; ids may repeat or be null; extra columns are ignored; an
        empty batch gives no rows, and counts as a batch.
        """
        arrow_batches(self.spark)
        batches = self.store.listing.batches
        order = batches.index(batch) if batch in batches else len(batches)
        text = F.coalesce(F.col(text_col), F.lit(""))
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
        window = self.window
        with scope(self.spark) as keep:
            found = stash(source.select("key", "text").mapInArrow(lambda it: _windows(it, window), "key string, j int, w long, v long"), "windows")
            counts = stash(found.groupBy("w", "v").agg(F.count("*").alias("times")), "counts")
            old = stash(self.store.held("windows", counts.select("w")).where(F.col("batch") < order).select("w", "v", F.lit(True).alias("old")), "old")
            both = counts.join(old, ["w", "v"], "left")
            hit = stash(both.where("times > 1 or old").select("w", "v", "times"), "hit")
            places = join_by_size(found, hit, ["w", "v"], "times").select("key", "j").distinct()
            spans = keep(stash(places.groupBy("key").agg(F.flatten(F.collect_list(F.array("j", F.col("j") + 1))).alias("ranges")), "places"))
            self.store.commit(batch, {"windows": both.where("old is null").select("w", "v", F.lit(order).cast("long").alias("batch"))})
        marked = source.join(spans, "key", "left").select("doc_id", "text", F.when(F.col("ranges").isNotNull(), F.array(F.struct("ranges", F.lit(0).alias("s0")))).alias("spans"))
        return marked.mapInArrow(lambda it: _cut(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
