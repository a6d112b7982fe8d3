"""Joins whose keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.written import stash

#: Keys of over one in so many rows, of which there can only be so many, are joined where their rows are.
MOST_HOT = 2_048


def join_by_size(rows: DataFrame, keys: DataFrame, on: list[str], times: str) -> DataFrame:
    """``rows`` joined with ``keys``, which holds each key once and its number of rows (about) as ``times``.

    Keys of over 1 / ``MOST_HOT`` of the rows, of which there are fewer than ``MOST_HOT``, are broadcast, so that no task
    gets such a key's rows; the others are shuffled. Both tables are read twice: written ones are meant.
    """
    total = keys.agg(F.sum(times)).first()[0] or 0
    hot = keys.where(F.col(times) > total / MOST_HOT)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keys.where(F.col(times) <= total / MOST_HOT), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def spread(rows: DataFrame, times: int = 3) -> DataFrame:
    """``rows`` dealt evenly to ``times`` tasks a core: for costly steps on rows of a small file, which one task would read."""
    return rows.repartition(times * rows.sparkSession.sparkContext.defaultParallelism)


#: Rows, and values, of one key that meet in one cell of ``product_by_key``, about.
CELL = 2_000


def product_by_key(rows: DataFrame, values: DataFrame, on: str, value: str, group: int = CELL) -> DataFrame:
    """``rows`` joined with ``values`` (columns ``on`` and ``value``, distinct), where many of both have the same key.

    A key's values are dealt to lists of about ``group`` and its rows to slices of as many; a row meets a whole list, and
    becomes rows with a value only there. So what is shuffled is the result's size divided by ``group``, and a hot key is
    dealt to as many tasks as it has cells.
    """
    columns, number = rows.columns, lambda: F.ceil(F.count("*") / group)
    sizes = rows.groupBy(on).agg(number().alias("__slices")).join(values.groupBy(on).agg(number().alias("__lists")), on)
    sizes = stash(sizes, "sizes")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    marks = [c for c, t in rows.dtypes if "map<" not in t]
    asking = rows.join(sizes, on).select(*columns, F.pmod(F.xxhash64(*marks), "__slices").alias("__slice"), each("__lists").alias("__list"))
    lists = values.join(sizes, on).withColumn("__list", F.pmod(F.xxhash64(value), "__lists"))
    lists = lists.groupBy(on, "__list", "__slices").agg(F.collect_list(value).alias("__values")).select(on, "__list", "__values", each("__slices").alias("__slice"))
    key = [on, "__slice", "__list"]
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 3 * session.sparkContext.defaultParallelism)
    met = asking.repartition(tasks, *key).join(lists.repartition(tasks, *key).hint("merge"), key)
    return met.select(*columns, F.explode("__values").alias(value))
