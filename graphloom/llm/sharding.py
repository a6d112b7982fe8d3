"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import stash, table

SHARDS = 8


def _running(batches):
    """Bytes and rows before each row within its partition, which is sorted."""
    from pyspark import TaskContext

    part, done, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, ends = batch.num_rows, np.cumsum(batch.column("size").to_numpy()) + done
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(ends - batch.column("size").to_numpy()), pa.array(np.arange(rows, rows + n))], names=[*batch.schema.names, "part", "before", "row"])
        if n:
            done, rows = int(ends[-1]), rows + n


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards of nearly equal bytes, in the order of ``id_col`` (null ids first).

    Only (id, size, checksum) is shuffled, once, by range. Each sorted partition adds up its own bytes; the partitions'
    totals (a row a partition) give every partition its global offset. A document belongs to the shard in whose
    equal-sized byte target its middle byte lies, so a shard differs from its target by less than one document.
    A null text counts as empty (1 byte); repeated ids and texts are separate rows, ordered by checksum and size.
    An empty table gives no rows. Extra columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = ["doc_id", "text_crc32", "size"]
    schema = "doc_id long, size long, text_crc32 long, part int, before long, row long"
    ranged = stash(meta.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_running, schema), "shards")
    # A row for each partition of the shuffle: bounded by its partition count, whatever the number of documents.
    totals = ranged.groupBy("part").agg((F.max(F.col("before") + F.col("size"))).alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row0"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * (before + byte0) + size) * {shards}) div (2 * all_bytes)) as int)"))
    placed = placed.withColumn("at", F.col("row") + F.col("row0"))
    first = placed.groupBy("shard").agg(F.min("at").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))
