"""Tables written to the folder that driver and executors share, to end lineage between steps."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables written in each open ``scope``, and their folders; a thread has scopes of its own.
_scopes: ContextVar[tuple[list[tuple[DataFrame, str]], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a temporary one, but only in local mode: on a
    cluster each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and every executor sees it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scopes.get():
        _scopes.get()[-1].append((out, path))
    return out


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove at its end the tables that were written within, but for those handed to the function that it gives.

    What is read from them lazily must be written, and handed on, before the end.
    """
    own: list[tuple[DataFrame, str]] = []
    outer = _scopes.set((*_scopes.get(), own))
    handed: list[tuple[DataFrame, str]] = []

    def keep(table: DataFrame) -> DataFrame:
        handed.extend(entry for entry in own if entry[0] is table)
        return table

    try:
        yield keep
    finally:
        _scopes.reset(outer)
        for table, path in own:
            if not any(table is t for t, _ in handed):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if _scopes.get():
            _scopes.get()[-1].extend(handed)


def tidy(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For functions of DataFrames: the result is written, and what they wrote on the way is removed."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(f)
        def run(*args, **kwargs) -> DataFrame:
            spark = next(a.sparkSession for a in (*args, *kwargs.values()) if isinstance(a, DataFrame))
            with scope(spark) as keep:
                return keep(stash(f(*args, **kwargs), name))

        return run

    return wrap
