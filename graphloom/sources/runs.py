"""Tables that grow by named batches: immutable runs in the shared folder, joined with a batch without being shuffled."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a table beyond which they are merged to one.
RUNS = 8
#: Rows of a bucket, about, where the first batch settles how many there are.
BUCKET = 1 << 19


@dataclass(frozen=True)
class Table:
    """A table's columns (DDL), the one it is hashed and sorted by, and, where later rows of a key replace earlier ones, the
    column that tells which is later."""

    schema: str
    key: str
    latest: str | None = None


@dataclass
class Listing:
    """What counts: the store's buckets, its batches, each table's runs, and numbers that the owner keeps."""

    buckets: int
    batches: list[str] = field(default_factory=list)
    runs: list[tuple[str, str]] = field(default_factory=list)
    numbers: dict[str, int] = field(default_factory=dict)


_LISTING = "buckets int, batches array<string>, runs array<struct<name: string, run: string>>, numbers map<string, bigint>"


class RunStore:
    """Tables of sorted immutable runs, hashed to the same buckets: only a batch is shuffled to meet them.

    A batch counts once a listing that names its runs is there, written whole under the next number after the runs. What
    a failed batch leaves is never read, and a batch that is committed again changes nothing. One writer at a time: a
    second one fails on the listing's number. A later session that names the folder goes on from there.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table], buckets: int | None = None, most_runs: int = RUNS):
        self.spark, self.folder, self.tables, self.most_runs = spark, folder.rstrip("/"), tables, most_runs
        self.fixed = buckets is not None
        self.listing = self._latest() or Listing(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def fit(self, rows: int) -> None:
        """More buckets for a large first batch, unless their number was given: a task sorts and merges a bucket. Once there
        is a batch, they stay."""
        if not self.listing.batches and not self.fixed:
            self.listing.buckets = max(self.listing.buckets, -(-rows // BUCKET))

    def _path(self, part: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, part: str) -> list[str]:
        path, files = self._path(part)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _numbers(self) -> list[int]:
        _, files = self._path("lists")
        return sorted(int(n) for n in self._children("lists") if files.exists(self._path(f"lists/{n}/_SUCCESS")[0]))

    def _latest(self) -> Listing | None:
        numbers = self._numbers()
        if not numbers:
            return None
        row = self.spark.read.json(f"{self.folder}/lists/{numbers[-1]}", schema=_LISTING).first()
        return Listing(row["buckets"], list(row["batches"]), [(r["name"], r["run"]) for r in row["runs"]], dict(row["numbers"]))

    def _publish(self, listing: Listing) -> None:
        row = [(listing.buckets, listing.batches, listing.runs, listing.numbers)]
        number = max(self._numbers(), default=0) + 1
        path, files = self._path(f"lists/{number}")
        if files.exists(path):  # without its marker: a writer died on it
            files.delete(path, True)
        self.spark.createDataFrame(row, _LISTING).coalesce(1).write.json(f"{self.folder}/lists/{number}")
        self.listing = listing

    def _opened(self, name: str, run: str) -> DataFrame:
        table = self.tables[name]
        if not self.spark.catalog.tableExists(run):
            self.spark.sql(f"CREATE TABLE {run} ({table.schema}) USING parquet CLUSTERED BY ({table.key}) SORTED BY ({table.key}) INTO {self.listing.buckets} BUCKETS LOCATION '{self.folder}/runs/{run}'")
        return self.spark.table(run)

    def _write(self, name: str, rows: DataFrame) -> str:
        table, run = self.tables[name], f"run_{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], table.schema).columns
        placed = rows.select(*columns).repartition(self.listing.buckets, table.key)
        placed.write.bucketBy(self.listing.buckets, table.key).sortBy(table.key).option("compression", "zstd").option("path", f"{self.folder}/runs/{run}").saveAsTable(run)
        return run

    def runs(self, name: str) -> list[DataFrame]:
        return [self._opened(n, run) for n, run in self.listing.runs if n == name]

    def _newest(self, name: str, rows: DataFrame) -> DataFrame:
        """Of rows that replace each other the latest. They are dealt by their key here: a union of runs has each key in
        several partitions."""
        table = self.tables[name]
        if table.latest is None:
            return rows
        dealt = rows.repartition(self.listing.buckets, table.key)
        return dealt.groupBy(table.key).agg(F.max_by(F.struct(*rows.columns), table.latest).alias("r")).select("r.*")

    def read(self, name: str) -> DataFrame:
        """The whole table, by one scan of its runs' files; of rows that replace each other the latest."""
        runs = [run for n, run in self.listing.runs if n == name]
        if not runs:
            return self.spark.createDataFrame([], self.tables[name].schema)
        return self._newest(name, self.spark.read.schema(self.tables[name].schema).parquet(*(f"{self.folder}/runs/{run}" for run in runs)))

    def absent(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` whose key is in no run of a table, one row for each key. Only ``rows`` are shuffled, once."""
        key = self.tables[name].key
        out = rows.repartition(self.listing.buckets, key).dropDuplicates([key])
        for run in self.runs(name):
            out = out.join(run.select(key).hint("merge"), key, "left_anti")
        return out

    def held(self, name: str, keys: DataFrame) -> DataFrame:
        """The table's rows with the given ``keys`` (a column named like its key), the latest ones. Only ``keys`` are shuffled."""
        key = self.tables[name].key
        asked = keys.select(key).where(F.col(key).isNotNull()).repartition(self.listing.buckets, key)
        parts = [run.join(asked.hint("merge"), key, "left_semi") for run in self.runs(name)]
        return self._newest(name, reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], self.tables[name].schema)

    def commit(self, batch: str, rows: dict[str, DataFrame], numbers: dict[str, int] | None = None) -> bool:
        """Add a batch's rows, once: a batch that counts already changes nothing and returns False."""
        if batch in self.listing.batches:
            return False
        old = self.listing
        added = [(name, self._write(name, df)) for name, df in rows.items()]
        self._publish(Listing(old.buckets, [*old.batches, batch], [*old.runs, *added], {**old.numbers, **(numbers or {})}))
        for name in rows:
            if sum(n == name for n, _ in self.listing.runs) > self.most_runs:
                self.compact(name)
        return True

    def compact(self, name: str) -> None:
        """Merge a table's runs to one, which takes their place in the listing before they go."""
        old = self.listing
        gone = [run for n, run in old.runs if n == name]
        merged = self._write(name, self.read(name))
        self._publish(Listing(old.buckets, old.batches, [*((n, r) for n, r in old.runs if n != name), (name, merged)], old.numbers))
        self._remove(gone)

    def sweep(self) -> None:
        """Remove what failed batches have left: runs that the listing does not name."""
        named = {run for _, run in self.listing.runs}
        self._remove([run for run in self._children("runs") if run not in named])

    def _remove(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
            path, files = self._path(f"runs/{run}")
            files.delete(path, True)

    def close(self) -> None:
        """Forget the runs in the session's catalog; they stay in the folder."""
        for _, run in self.listing.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def drop(self) -> None:
        """Remove the store with its folder."""
        self.close()
        path, files = self._path("")
        files.delete(path, True)
