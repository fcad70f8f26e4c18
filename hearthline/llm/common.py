"""Helpers that several of these operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.archive import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: list[DataFrame] = []  # written and not yet deleted


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: cuts lineage and survives lost executors. What nobody deletes before
    is deleted when the application ends."""
    spark = df.sparkSession
    out_path = f"{shared_folder(spark)}/hearthline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out_path)
    out = spark.read.schema(df.schema).parquet(out_path)
    out.written_to = out_path
    path, files = files_of(out)
    files.deleteOnExit(path)
    _tables.append(out)
    return out


def files_of(df: DataFrame) -> tuple:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def delete(df: DataFrame) -> None:
    """Deletes the files of a table made by `written` that nothing reads any more."""
    path, files = files_of(df)
    files.delete(path, True)
    files.cancelDeleteOnExit(path)
    _tables[:] = [t for t in _tables if t.written_to != df.written_to]


def tables_made() -> list[DataFrame]:
    """The tables that are written and not yet deleted."""
    return list(_tables)


REST = "__rest"


def set_aside(df: DataFrame, *keep: str) -> DataFrame:
    """df's `keep` columns, and all others in one struct, so that their names cannot clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in keep]
    return df.select(*keep, F.struct(*others, F.lit(True).alias("__row")).alias(REST))


def brought_back(df: DataFrame, columns: list[str], made: list[str]) -> DataFrame:
    """The columns in their first order and then the made ones, which replace any of the same name."""
    old = [F.col(f"`{c}`") if c in df.columns else F.col(REST)[c].alias(c) for c in columns if c not in made]
    return df.select(*old, *made)


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """df's rows whose id is not among gone's `_gone`."""
    return set_aside(df, id_col).join(gone, F.col(id_col) == F.col("_gone"), "left_anti").transform(lambda out: brought_back(out, df.columns, []))


def ranked(df: DataFrame, key: str, order: str, rows: int, to: str, per_bucket: int = 20_000) -> DataFrame:
    """Adds `to`: a gapless rank from 0 among the rows of each key.

    Rows are dealt over hash buckets of `order`; a row's rank is its place in its (key, bucket)
    plus the rows of the key's earlier buckets. So no task holds more than a bucket of a key,
    however many rows the key has. df is read twice: give a written table."""
    n = max(64, -(-rows // per_bucket))
    # Seeded by `to`: a key that came out of another ranking must not follow this one's buckets.
    df = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(to), order), F.lit(n)).cast("int"))
    sizes = df.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    local = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    joined = df.withColumn("_r", local).join(sizes, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    return joined.withColumn(to, (F.col("_r") + F.col("_at")).cast("long")).drop("_b", "_n", "_k", "_c", "_at", "_r")


def two_hashes(*cols: Column | str) -> tuple[Column, Column]:
    """128 bits of hash as two longs."""
    return F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)
