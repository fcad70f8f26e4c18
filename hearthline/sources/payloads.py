"""Payloads of result pages and item details. Items are read as variants: one odd field or entry spoils nothing else, unknown
attributes survive, and a number can be told from a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "data variant, items variant, meta struct<total:string,last_page:string,per_page:string,current_page:string>"
OBJECT = "map<string,variant>"


def field(item: Column, path: str, kind: str = "string") -> Column:
    """What lies under the path, or null; a text of whatever is there unless another kind is asked for."""
    return F.try_variant_get(item, f"$.{path}", kind)


def text_field(item: Column, path: str) -> Column:
    """The text under the path, null if something else is there."""
    return F.when(is_text(field(item, path, "variant")), field(item, path))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def any_text(value: Column) -> Column:
    """A variant as a text, whatever it is."""
    return F.try_variant_get(value, "$", "string")


def text_of(value: Column) -> Column:
    """The text that a variant is, null if it is something else."""
    return F.when(is_text(value), any_text(value))


def read_once(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """rows with a variant column read as `_s`, null where it is no such thing, in place of the column. As an array of one
    that is exploded: a filter on what is read would else be put before it and read (and parse) every row again."""
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.explode(F.array(F.try_variant_get(column, "$", kind))).alias("_s"))


def is_object(item: Column) -> Column:
    return F.try_variant_get(item, "$", OBJECT).isNotNull()


def objects(item: Column, path: str) -> Column:
    """The objects of an array, in order; null if there is no array."""
    return F.filter(field(item, path, "array<variant>"), is_object)


def usable(page: Column) -> Column:
    """A page counts if its data is an array and its total a number."""
    return F.coalesce(F.try_variant_get(page["data"], "$", "array<variant>").isNotNull() & page["meta"]["total"].try_cast("double").isNotNull(), F.lit(False))


def parse_pages(df: DataFrame, payload: str) -> DataFrame:
    """Adds data (array of variants), meta and usable to a column of payload texts."""
    p = F.col("_p")
    return df.withColumn("_p", F.from_json(payload, PAGE)).withColumns({"data": F.try_variant_get(p["data"], "$", "array<variant>"), "meta": p["meta"], "usable": usable(p)}).drop("_p")


def read_search_pages(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """One row per page with its file; `usable` is false without a data array or a numeric total. Files hold one
    payload each, or one per line."""
    pages = spark.read.text(path, wholetext=not one_per_line)
    return parse_pages(pages.withColumn("file", F.input_file_name()), "value").drop("value")


def parse_details(df: DataFrame, payload: str) -> DataFrame:
    """Adds the payload as a variant named detail; null where it is no JSON."""
    return df.withColumn("detail", F.try_parse_json(payload))


def read_details(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    details = spark.read.text(path, wholetext=not one_per_line)
    return parse_details(details.withColumn("file", F.input_file_name()), "value").drop("value")


def items_of(pages: DataFrame) -> DataFrame:
    """Items of usable pages, one per row, with their place; an empty page has one row without a place. What is usable is
    asked in what is exploded: a filter would be put before the reading of the pages and read them again."""
    keep = [c for c in pages.columns if c not in ("data", "meta", "usable")]
    none = F.array(F.lit(None).cast("variant"))
    items = pages.select(*keep, F.col("meta.current_page").try_cast("int").alias("page"), F.posexplode(F.when(F.col("usable"), F.when(F.size("data") > 0, F.col("data")).otherwise(none))).alias("place", "item"))
    return items.withColumn("place", F.when(F.col("item").isNotNull(), F.col("place")))


def records_from_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A batch of records that came as one JSON array, as rows."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.inline(F.from_json(column, f"array<struct<{schema}>>")))
