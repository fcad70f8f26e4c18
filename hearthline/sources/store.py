"""A versioned store of keyed tables in hash buckets on plain Parquet.

A commit is one row: for every table and bucket it names the version that holds the bucket's rows now, and it carries what
a writer must remember. A writer hands in the buckets that it has touched, whole; all others stay as they are, files and
all. Readers take the newest commit and see all of a version or nothing of it. Buckets that only forgotten commits name
are deleted; the last `keep` commits stay readable for those that have begun on them. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "hash_bucket"
COMMIT = "version int, buckets int, tables array<struct<name:string,bucket:int,at:int>>, notes string"


def files(spark: SparkSession, path: str):
    """The path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Versions that are committed, in order. A commit is there once its file is: one file, renamed into place."""
    path, fs = files(spark, f"{folder}/_commits")
    if not fs.exists(path):
        return []
    found = []
    for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_commits/version=*/part-*")) or []:
        found.append(int(f.getPath().getParent().getName().removeprefix("version=")))
    return sorted(set(found))


@dataclass
class Commit:
    version: int = 0
    buckets: int = 0
    tables: dict[str, dict[int, int]] = field(default_factory=dict)  # name -> bucket -> version
    notes: str | None = None


def read_commit(spark: SparkSession, folder: str, version: int) -> Commit:
    row = spark.read.schema(COMMIT).parquet(f"{folder}/_commits/version={version}").first()
    out = Commit(version, row.buckets or 0, {}, row.notes)
    for t in row.tables or []:
        out.tables.setdefault(t.name, {})[t.bucket] = t.at
    return out


def newest(spark: SparkSession, folder: str) -> Commit | None:
    versions = committed(spark, folder)
    return read_commit(spark, folder, versions[-1]) if versions else None


def write_commit(spark: SparkSession, folder: str, commit: Commit) -> None:
    tables = [(name, b, at) for name, of in sorted(commit.tables.items()) for b, at in sorted(of.items())]
    spark.createDataFrame([(commit.version, commit.buckets, tables, commit.notes)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/_commits/version={commit.version}")


@dataclass
class Store:
    """keys: the column whose hash puts a table's rows into buckets. More buckets make smaller rewrites and more files."""

    spark: SparkSession
    folder: str
    keys: dict[str, str]
    schemas: dict[str, str]
    buckets: int = 64
    keep: int = 3

    def head(self) -> Commit:
        """The newest commit, or an empty one of version 0. Its number of buckets goes before this store's."""
        found = newest(self.spark, self.folder) or Commit(buckets=self.buckets)
        self.buckets = found.buckets or self.buckets
        return found

    def bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(self.buckets)).cast("int")

    def touched(self, *keys: DataFrame) -> list[int]:
        """Buckets of the keys in the first columns: as many as there are buckets, at most."""
        found = None
        for k in keys:
            b = k.select(self.bucket(F.col(k.columns[0])).alias(BUCKET))
            found = b if found is None else found.unionByName(b)
        return sorted(r[0] for r in found.distinct().collect())

    def read(self, commit: Commit, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A table as of a commit; only: the buckets to read, no other file of it is opened."""
        of = commit.tables.get(name, {})
        wanted = of if only is None else {b: of[b] for b in only if b in of}
        paths = [f"{self.folder}/{name}/version={at}/{BUCKET}={b}" for b, at in sorted(wanted.items())]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def write(self, before: Commit, rows: dict[str, DataFrame], touched: dict[str, list[int]], added: dict[str, DataFrame] | None = None, notes: str | None = None) -> Commit:
        """The next version. rows: all rows of each table's touched buckets; added: what the version adds to tables that
        only grow (read_deltas)."""
        after = Commit(before.version + 1, self.buckets, {n: dict(of) for n, of in before.tables.items()}, notes)
        for name, df in rows.items():
            path = f"{self.folder}/{name}/version={after.version}"
            # A bucket's rows meet, but a large bucket may be split over tasks and files.
            df.select(*df.columns, self.bucket(self.keys[name]).alias(BUCKET)).hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
            of = after.tables.setdefault(name, {})
            for b in touched[name]:
                of.pop(b, None)
            of.update({b: after.version for b in self._buckets_at(path)})
        for name, df in (added or {}).items():
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={after.version}")
        write_commit(self.spark, self.folder, after)
        self.expire()
        return after

    def _buckets_at(self, path: str) -> list[int]:
        p, fs = files(self.spark, path)
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{BUCKET}=")]

    def expire(self) -> None:
        """Deletes commits before the last `keep`, and the buckets that none of those names."""
        versions = committed(self.spark, self.folder)
        old = versions[: -self.keep]
        if not old:
            return
        named = lambda v: {(name, b, at) for name, of in read_commit(self.spark, self.folder, v).tables.items() for b, at in of.items()}
        held = set().union(*(named(v) for v in versions[-self.keep :]))
        for v in old:
            for name, b, at in named(v) - held:
                path, fs = files(self.spark, f"{self.folder}/{name}/version={at}/{BUCKET}={b}")
                fs.delete(path, True)
            path, fs = files(self.spark, f"{self.folder}/_commits/version={v}")
            fs.delete(path, True)
