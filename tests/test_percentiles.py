"""Percentiles over a whole population against plain Python."""

import math
import random

from pyspark.sql import functions as F

from hearthline.operators import aggregates, percentiles


def continuous(xs, p):
    xs = sorted(xs)
    at = p * (len(xs) - 1)
    lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
    return lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi


def test_percentiles_of_many_conditions(spark):
    rng = random.Random(8)
    xs = [rng.choice([rng.gauss(0, 50), float(rng.randint(-3, 3)), 0.0, -0.0, 1e300, 1e-300, -1e-300, 1e9 + rng.random(), None]) for _ in range(3000)] + [7.0] * 900
    df = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k long, x double").repartition(7)
    for p in (0.0, 0.1, 0.5, 0.77, 1.0):
        got = percentiles.whole(df, {"n": F.lit(True), "even": F.col("k") % 2 == 0, "none": F.lit(False)}, {"all": (F.col("x"), p), "up": (F.when(F.col("x") > 0, F.col("x")), p), "one": (F.when(F.col("k") == 5, F.lit(4.5)), p), "nothing": (F.lit(None).cast("double"), p)}).first()
        known = [x for x in xs if x is not None]
        assert (got.n, got.even, got.none) == (len(xs), (len(xs) + 1) // 2, 0)
        assert (got["all"], got.up, got.one, got.nothing) == (continuous(known, p), continuous([x for x in known if x > 0], p), 4.5, None), p


def test_percentiles_of_nothing_and_of_counts_alone(spark):
    empty = spark.createDataFrame([], "x double")
    assert percentiles.whole(empty, {"n": F.lit(True)}, {"m": F.col("x")}).collect() == [(0, None)]
    assert percentiles.whole(spark.range(4), {"n": F.col("id") > 1}, {}).collect() == [(2,)]


def test_ranges_rise_with_values(spark):
    xs = sorted([s * m * 10.0**e for s in (-1, 1) for e in range(-300, 300, 7) for m in (1, 1.0001, 1.001, 2, 9.99)] + [0.0, 5e-324, -5e-324, math.inf, -math.inf])
    rows = spark.createDataFrame([(x,) for x in [*xs, math.nan]], "x double").select("x", percentiles.value_range(F.col("x")).alias("b")).collect()
    by = {repr(r.x): r.b for r in rows}
    bs = [by[repr(x)] for x in [*xs, math.nan]]
    assert bs == sorted(bs)


def test_one_far_price_leaves_the_breaks(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 1001)] + [(1e15,), (-4.0,), (None,)], "x double")
    assert sorted(r[0] for r in aggregates.quantile_breaks(df, "x").collect()) == [201.0, 401.0, 601.0, 801.0]
