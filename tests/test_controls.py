"""Counts of the controls: every range, every number, whole keys."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from hearthline.operators import filters
from hearthline.plans import operator_queries
from hearthline.sources import facts

SF = "/root/testdata/sf0.001"


def test_every_range_is_counted_for_every_item(spark):
    counts = operator_queries.QUERIES["control_ranges"](spark, SF)
    items = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {r.control: r.n for r in counts.groupBy("control").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(filters.RANGES, items)
    assert all(f"'{c}' AS control" in operator_queries.SQL["control_ranges"] for c in filters.RANGES)


def test_numbers_of_any_length_have_a_value(spark):
    """Long numbers are values too; texts are rounded and written as the comparison's: 16715.8775 * 1000 is below its tie."""
    views = ["1500000", "10000000", "999999999999999", "123456789012345", "1234567890123456.8", "20000000000000000", "999999999999999999999", "16715.8775", "-0.0005", "4117.5", "7\n", "1e5", "x"]
    schema = "currency string, price double, sqm double, extra map<string,string>, characteristics map<string,string>"
    rows = spark.createDataFrame([("BAM", 1337270.2, 80.0, {"views": v}, {}) for v in views], schema)
    assert [r.v for r in rows.select(filters.control("views").alias("v")).collect()][:4] == [1500000.0, 10000000.0, 999999999999999.0, 123456789012345.0]
    got = sorted(map(tuple, filters.control_counts(rows, ["price_bam", "ppm2_bam", "views"], lambda v: F.coalesce(operator_queries.number_text(v), F.lit("-"))).collect()))
    theirs = duckdb.execute(f"SELECT 'views', {operator_queries.valued('views')} AS value, count(*) FROM (SELECT unnest(?) AS views) GROUP BY 2", [views]).fetchall()
    assert got == sorted([("price_bam", "1337270.2", len(views)), ("ppm2_bam", "16715.877", len(views)), *theirs])
    assert ("views", "-", 3) in got and ("views", "999999999999999.0", 1) in got


def test_the_whole_key_tells_a_retired_search(spark):
    """Digits beyond the twentieth count as well."""
    keys = ["u7", "u20", "u-9223372036854775800", "u" + "0" * 18 + "110", "u" + "0" * 18 + "101"]
    found = {r.search_key: r.retired_at for r in facts.searches(spark.createDataFrame([(k,) for k in keys], "search_key string")).collect()}
    assert found == {k: datetime(2001, 7, 17) if k.endswith("0") else None for k in keys}
