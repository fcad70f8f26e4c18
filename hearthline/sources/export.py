"""Exports for people: CSV that spreadsheets do not take for formulas, and groups as JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import files


def safe_cell(c: Column) -> Column:
    """Texts that start like a formula get an apostrophe."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(*(safe_cell(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes))


def export_csv(df: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled, lines ended with CRLF: each row is one text line, so any size streams out."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = csv_rows(df)
    line = F.concat_ws(",", *(cell(F.col(c)) for c in rows.columns))
    rows.select(F.concat(line, F.lit("\r")).alias("value")).write.text(path)


def groups_to_json(groups: dict[str, DataFrame], path: str) -> None:
    """One JSON object with an array of rows for each group, written as text parts: read in the order of their names they
    are the document. Every row is a line of its own, so nothing is gathered and any size streams out.

    A group's rows are written first, with their places; the least place tells the row that no comma goes before. Rows
    keep their order."""
    document = None
    for k, (name, df) in enumerate(groups.items()):
        spark = df.sparkSession
        line = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)  # noqa: B023, E731
        staged = f"{path}-rows/{k}"
        df.select(F.monotonically_increasing_id().alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).write.parquet(staged)
        rows = spark.read.schema("place bigint, row string").parquet(staged)
        first = rows.agg(F.min("place")).first()[0]
        lines = rows.orderBy("place").select(F.concat(F.when(F.col("place") == F.lit(first), "").otherwise(","), "row").alias("value"))
        part = line(("{" if k == 0 else "],") + json.dumps(name, ensure_ascii=False) + ":[").unionByName(lines)
        document = part if document is None else document.unionByName(part)
    if document is None:
        raise ValueError("a document of no groups")
    document.unionByName(line("]}")).write.text(path)
    folder, fs = files(spark, f"{path}-rows")
    fs.delete(folder, True)


def collect_rows(df: DataFrame, most: int = 1000) -> DataFrame:
    """One JSON array of a small result: a report's rows. More than `most` are an error, never a part of them."""
    rows = df.limit(most + 1).agg(F.collect_list(F.struct("*")).alias("rows"))
    text = F.lit(f"a report of more than {most} rows")
    return rows.select(F.when(F.size("rows") > most, F.raise_error(text)).otherwise(F.to_json("rows")).alias("rows"))
