"""Aggregations of a market."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .percentiles import value_counts, values_at

SPREAD = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def spread(df: DataFrame, keys: Sequence[str | Column], x: str, digits: int = 0, names: dict[str, float] = SPREAD, count: str = "listings") -> DataFrame:
    """Rows and percentiles of x per group, from one pass over the group's values."""
    at = F.percentile(F.col(x).cast("double"), F.array(*(F.lit(v) for v in names.values()))).alias("_p")
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), at)
    return out.select(*[c for c in out.columns if c != "_p"], *(X.rounded(F.col("_p")[k], digits).alias(n) for k, n in enumerate(names)))


def having_min_n(df: DataFrame, n: int, count: str = "listings") -> DataFrame:
    return df.where(F.col(count) >= n)


def months_of_inventory(active: Column, exits: Column, days: Column) -> Column:
    return X.rounded(active / F.nullif(exits * 30.0 / days, F.lit(0)), 1)


def gross_yield(rent: Column, price: Column) -> Column:
    """Twelve rents as a percentage of the price."""
    return X.rounded(1200 * rent / F.nullif(price, F.lit(0)), 1)


def bands(x: Column, rules: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Names by ordered upper bounds (exclusive)."""
    out = F
    for bound, name in rules:
        out = out.when(x < bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def day_bins(x: Column, width: int = 20, last: int = 180) -> Column:
    low = F.floor(x / width) * width
    return F.when(x >= last, f"{last}+ d").otherwise(F.concat(low.cast("string"), F.lit("–"), (low + (width - 1)).cast("string"), F.lit(" d")))


def exit_share(exits: DataFrame, actives: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exits, actives and exits' share of both, per group of the two populations together."""
    both = exits.select(*keys, F.lit(1).alias("_x")).unionByName(actives.select(*keys, F.lit(0).alias("_x")))
    out = both.groupBy(*keys).agg(F.sum("_x").alias("exits"), (F.count(F.lit(1)) - F.sum("_x")).alias("active"))
    return out.withColumn("exit_ratio", X.rounded(100.0 * F.col("exits") / (F.col("exits") + F.col("active")), 1))


def unpivot(df: DataFrame, keep: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """One row per label: (keep..., label, value)."""
    rows = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in flags.items()))
    return df.select(*keep, F.explode(rows).alias("f")).select(*keep, "f.label", "f.value")


def premium_by_flag(df: DataFrame, flags: dict[str, Column], x: str = "price") -> DataFrame:
    """Per flag: rows and median with Yes and with No, and the difference in percent."""
    long = unpivot(df, [x], {k: X.boolean_value(v) for k, v in flags.items()})
    yes, no = F.col("value") == "Yes", F.col("value") == "No"
    g = long.groupBy("label").agg(X.count_if(yes).alias("with_n"), X.median(x, yes).alias("w"), X.count_if(no).alias("without_n"), X.median(x, no).alias("o"))
    return g.select(F.col("label").alias("amenity"), "with_n", X.rounded("w", 0).alias("median_with"), "without_n", X.rounded("o", 0).alias("median_without"), X.rounded(100.0 * (F.col("w") / F.nullif("o", F.lit(0)) - 1), 1).alias("difference_pct"))


def error_patterns(runs: DataFrame) -> DataFrame:
    pattern = F.left(F.regexp_replace(F.coalesce("error", F.lit("(no message)")), "[0-9]+", "#"), F.lit(120))
    return runs.where("status = 'error'").groupBy(pattern.alias("failure_pattern")).agg(F.count(F.lit(1)).alias("runs"), F.max("started_at").alias("last_seen"))


def coverage_pct(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Percentage of rows for which each condition holds."""
    return df.agg(*(X.rounded(100.0 * X.count_if(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), 0).alias(n) for n, c in parts.items()))


def int_median(x: str | Column) -> Column:
    return X.rounded(X.median(x), 0).cast("long")


def period_change(now: Column, before: Column) -> Column:
    """Change in percent; null without a base."""
    return X.rounded(100.0 * (now - before) / F.nullif(before, F.lit(0)), 1)


def trend(change: Column) -> Column:
    return F.when(change > 0.5, "up").when(change < -0.5, "down").when(change.isNotNull(), "flat")


def fold_tail(df: DataFrame, label: str, value: str, k: int = 6) -> DataFrame:
    """At most k slices: of more, the k - 1 largest stay and the rest add up to Other."""
    largest = df.orderBy(F.desc(value), F.asc_nulls_last(label)).limit(k + 1)
    rank = F.row_number().over(Window.orderBy(F.desc(value), F.asc_nulls_last(label)))  # over k + 1 rows
    top = largest.withColumn("_r", rank).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    kept = top.where((F.col("_n") <= k) | (F.col("_r") < k)).select(F.col(label).alias("_l"), F.lit(True).alias("_k"))
    named = df.join(F.broadcast(kept), F.col(label).eqNullSafe(F.col("_l")), "left")
    return named.groupBy(F.when(F.col("_k"), X.known(label)).otherwise("Other").alias(label)).agg(F.sum(value).alias(value))


def quantile_breaks(df: DataFrame, x: str, at: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Distinct lower-rank quantiles of the positive values (one row per break)."""
    counts = value_counts(df, [F.when(F.col(x) > 0, F.col(x))])
    ranks = lambda _, total: F.array(*(F.floor(F.lit(q) * total) for q in at))
    return values_at(counts, ranks).select(F.col("v").alias("break")).distinct()
