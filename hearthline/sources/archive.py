"""Archives, manifests and versioned tables on plain Parquet."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.histories import first_per_key
from . import store


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session. Only a session that runs on one machine
    may lack it, and gets a temporary folder then."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-hearthline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


MOST_REJECTIONS, MOST_ERROR_CHARS = 100, 1000


#: Fixed names of archive formats, and the address that a detail was read from.
CANONICAL, DIAGNOSTIC, DETAIL_URL = "canonical-v2", "diagnostic-v2", "https://olx.ba/api/listings/"


def archived_responses(responses: DataFrame) -> DataFrame:
    """Rows as they are archived: detail bodies in payload and search bodies in source_payload; diagnostics (rows with a
    diagnostic text) keep neither."""
    is_diagnostic = F.col("diagnostic").isNotNull()
    body = lambda kind: F.when((F.col("kind") == kind) & ~is_diagnostic, F.col("body"))
    return responses.withColumns({"payload": body("detail"), "source_payload": body("search"), "archive_format": F.when(is_diagnostic, DIAGNOSTIC).otherwise(CANONICAL)}).drop("body")


def archived_details(details: DataFrame) -> DataFrame:
    """Details (entity_id, fetched_at, body) as archive rows; rows without an id go."""
    url = F.concat(F.lit(DETAIL_URL), F.col("entity_id").cast("string"))
    rows = details.where("entity_id is not null").select("entity_id", url.alias("url"), "fetched_at", F.lit("detail").alias("kind"), F.lit(None).cast("string").alias("diagnostic"), "body")
    return archived_responses(rows)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def page_manifest(pages: DataFrame) -> DataFrame:
    """The last row of each (run, page, attempt), with bounded rejections and error text."""
    short = pages.withColumns({"rejections": F.coalesce(F.slice("rejections", 1, MOST_REJECTIONS), F.array().cast(pages.schema["rejections"].dataType)), "error": F.left("error", F.lit(MOST_ERROR_CHARS))})
    return first_per_key(short.withColumn("rejection_count", F.size("rejections")), ["run_id", "page", "attempt"], [F.desc("recorded_at")])


def page_diagnostics(manifest: DataFrame) -> DataFrame:
    """Archive rows without a body for the pages that are not authoritative or have rejections: what the manifest says."""
    doubtful = manifest.where(~F.coalesce("is_authoritative", F.lit(False)) | (F.size("rejections") > 0))
    told = F.to_json(F.struct(F.lit("page_manifest").alias("kind"), "page", "attempt", "response_state", "rejections", "error"))
    return archived_responses(doubtful.select("run_id", F.col("url"), F.col("recorded_at").alias("fetched_at"), F.lit("search").alias("kind"), told.alias("diagnostic"), F.lit(None).cast("string").alias("body")))


def retain_latest(archive: DataFrame) -> DataFrame:
    """The newest row of each kind, url and format: the newest payload and the newest diagnostic."""
    return first_per_key(archive, ["kind", "url", "archive_format"], [F.desc("fetched_at"), F.desc("id")])


def publish(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Writes every table whole under its version, and then one commit row: readers see all of it or nothing."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/version={version}")
    store.write_commit(spark, folder, store.Commit(version))


def latest_version(spark: SparkSession, folder: str) -> int | None:
    versions = store.committed(spark, folder)
    return versions[-1] if versions else None


def read_latest(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as of the newest commit, whole or in buckets; later files without a commit are not looked at."""
    commit = store.newest(spark, folder)
    of = commit.tables.get(name)
    if of is None:
        return spark.read.parquet(f"{folder}/{name}/version={commit.version}")
    return spark.read.parquet(*(f"{folder}/{name}/version={at}/{store.BUCKET}={b}" for b, at in sorted(of.items())))


def read_deltas(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All committed versions' rows of a table that is published as what each version adds, with their version."""
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows.where(F.col("version") <= latest_version(spark, folder))


def read_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Published prices: of an item, day and source the last write."""
    return read_latest(spark, folder, "prices")
