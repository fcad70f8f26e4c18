"""Exact percentiles and counts over a whole population, for many conditions in one pass.

Rows become (measure, value) pairs and are counted per distinct value, with partial sums before the shuffle. Counts are
added up in ranges of values that are equally wide relative to the value, so a far outlier widens none of the others; the
values of those few ranges that hold a wanted rank are then looked at one by one. Both looks read the same shuffle. No task
holds a population's values, and what is sent around is one row per measure and rank."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges are a share of 1 / WIDTH of a value wide; OFFSET keeps those of positive values positive.
WIDTH, OFFSET, BEYOND = 1024, 1_000_000, 1 << 40


def value_range(v: Column) -> Column:
    """A whole number that never falls as v rises; infinite values and NaN, which is above all, have ranges of their own."""
    plain = ~F.isnan(v) & (F.abs(v) < float("inf"))
    size = (F.floor(F.ln(F.when(plain & (v != 0), F.abs(v))) * WIDTH) + OFFSET).cast("long")
    found = F.when(v == 0, F.lit(0).cast("long")).when(plain & (v > 0), size).when(plain, -size).when(v < 0, F.lit(-BEYOND).cast("long"))
    return F.coalesce(found, F.lit(BEYOND).cast("long"))


def value_counts(df: DataFrame, measures: Sequence[Column]) -> DataFrame:
    """(m, v, n): how often each value of each measure (by its place) occurs; nulls do not count.

    m is never null, nor is a range: a join on them adds no filter of its own below the counts, so that whatever reads the
    counts shares their shuffle."""
    pairs = F.array(*(F.struct(F.lit(m).alias("m"), c.cast("double").alias("v")) for m, c in enumerate(measures)))
    each = df.select(F.explode(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("x")).select(F.coalesce("x.m", F.lit(-1)).alias("m"), F.col("x.v").alias("v"))
    return each.groupBy("m", "v").agg(F.count(F.lit(1)).alias("n"))


def ranges_of(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts with their range b, how many rows each range of each measure has: m, b, k)."""
    placed = counts.withColumn("b", value_range(F.col("v")))
    return placed, placed.groupBy("m", "b").agg(F.sum("n").alias("k"))


def values_at(counts: DataFrame, ranks: Callable[[Column, Column], Column]) -> DataFrame:
    """(m, total, r, v) for the ranks (from 0) that ranks(m, total) lists."""
    placed, sizes = ranges_of(counts)
    below = F.sum("k").over(Window.partitionBy("m").orderBy("b")) - F.col("k")
    sizes = sizes.select("m", "b", "k", below.alias("before"), F.sum("k").over(Window.partitionBy("m")).alias("total"))
    held = sizes.withColumn("r", F.explode(F.array_distinct(ranks(F.col("m"), F.col("total"))))).where("r >= before and r < before + k").select("m", "b", "before", "total", "r")
    wanted = held.groupBy("m", "b", "before", "total").agg(F.collect_set("r").alias("rs"))  # as many rows as ranks, at most
    near = placed.join(F.broadcast(wanted), ["m", "b"])
    low = F.col("before") + F.sum("n").over(Window.partitionBy("m", "b").orderBy("v")) - F.col("n")
    return near.withColumn("low", low).select("m", "total", "v", F.explode(F.filter("rs", lambda r: (r >= F.col("low")) & (r < F.col("low") + F.col("n")))).alias("r")).select("m", "total", "r", "v")


def whole(df: DataFrame, counts: Mapping[str, Column], values: Mapping[str, Column | tuple[Column, float]]) -> DataFrame:
    """One row: how many rows meet each condition of counts, and the continuous percentile of each of values (the median, or
    of (value, fraction)); nulls are left out, and a percentile of nothing is null."""
    named = {n: v if isinstance(v, tuple) else (v, 0.5) for n, v in values.items()}
    measures = [F.when(c, F.lit(0.0)) for c in counts.values()] + [v for v, _ in named.values()]
    each = value_counts(df, measures)
    first = len(counts)
    at = F.array(*(F.lit(None).cast("double") for _ in counts), *(F.lit(float(p)) for _, p in named.values()))
    place = lambda m, total: F.get(at, m) * (total - 1)
    ranks = lambda m, total: F.filter(F.array(F.floor(place(m, total)), F.ceil(place(m, total))), lambda r: r.isNotNull())
    found = values_at(each, ranks) if named else None
    out = ranges_of(each)[1].agg(*(F.coalesce(F.sum(F.when(F.col("m") == k, F.col("k"))), F.lit(0)).alias(n) for k, n in enumerate(counts)), F.lit(1).alias("_one"))
    if named:
        def ends(k: int) -> list[Column]:
            here = F.col("m") == k
            p = place(F.lit(k), F.col("total"))
            pick = lambda r: F.max(F.when(here & (F.col("r") == r), F.col("v")))
            return [pick(F.floor(p)).alias(f"_lo{k}"), pick(F.ceil(p)).alias(f"_hi{k}"), F.max(F.when(here, p)).alias(f"_p{k}")]

        got = found.agg(*(c for k in range(first, first + len(named)) for c in ends(k)))
        between = lambda lo, hi, p: F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)
        got = got.select(*(between(F.col(f"_lo{k}"), F.col(f"_hi{k}"), F.col(f"_p{k}")).alias(n) for k, n in enumerate(named, first)))
        out = out.crossJoin(F.broadcast(got))  # one row each
    return out.drop("_one")
