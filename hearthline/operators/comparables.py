"""Comparable items of a subject, and the fair price range that they give."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

#: Fixed least prices of candidates.
LEAST_SALE, LEAST_OTHER = 3000, 50


@dataclass(frozen=True)
class Manual:
    """What the reader types in; each field goes before the linked item's own."""

    entity_id: int | None = None
    deal: str | None = None
    kind: str | None = None
    area_key: str | None = None
    sqm: float | None = None
    rooms: str | None = None


def subject_row(entities: DataFrame, given: Manual, default_deal: str = "sale") -> DataFrame:
    """One row. A typed area also drops the linked item's pin."""
    spark = entities.sparkSession
    one = spark.range(1).select(F.lit(given.entity_id).cast("long").alias("s_id"))
    linked = entities.where(F.col("entity_id") == F.lit(given.entity_id)).select(*(F.col(c).alias(f"l_{c}") for c in ("entity_id", "deal", "kind", "area_key", "sqm", "rooms", "price", "latitude", "longitude")))
    both = one.join(linked, F.col("s_id") == F.col("l_entity_id"), "left")
    pick = lambda typed, name: F.coalesce(F.lit(typed), F.col(f"l_{name}"))
    pinned = (lambda c: F.lit(None).cast("double")) if given.area_key else F.col
    return both.select(
        F.col("l_entity_id").alias("s_id"),
        F.coalesce(F.col("l_deal"), F.lit(given.deal or default_deal)).alias("s_deal"),
        F.coalesce(F.col("l_kind"), F.lit(given.kind)).alias("s_kind"),
        pick(given.area_key, "area_key").alias("s_area"),
        pick(given.sqm, "sqm").cast("double").alias("s_sqm"),
        pick(given.rooms, "rooms").alias("s_rooms"),
        F.col("l_price").alias("s_price"),
        pinned("l_latitude").alias("s_lat"),
        pinned("l_longitude").alias("s_lon"),
    )


def pool(entities: DataFrame, exits: DataFrame, as_of) -> DataFrame:
    """Active items and exits, one row per item, the active one first."""
    keep = ["entity_id", "title", "url", "deal", "kind", "area_key", "rooms", "sqm", "price", "latitude", "longitude"]
    now = entities.where("closed_at is null").select(*keep, F.lit("active").alias("status"), F.datediff(F.lit(as_of), "first_seen").alias("days_listed"), F.lit(None).cast("date").alias("_on"))
    gone = exits.select(*keep, F.lit("exited").alias("status"), "days_listed", F.col("occurred_on").alias("_on"))
    order = Window.partitionBy("entity_id").orderBy("status", F.desc("_on"))
    return now.unionByName(gone).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_on")


def scored(candidates: DataFrame, subjects: DataFrame) -> DataFrame:
    """Candidates of each subject with their distance score. Subjects meet candidates of the same deal, by size
    bucket: one subject is broadcast by Spark, many are joined on the keys."""
    bucket = lambda x: F.floor(F.log2(x))
    wide = subjects.where("s_sqm > 0").withColumn("_b", F.explode(F.sequence(bucket(F.greatest(F.lit(5.0), F.col("s_sqm") * 0.75)), bucket(F.col("s_sqm") * 1.25))))
    near = candidates.where("sqm > 0").withColumn("_b", bucket("sqm"))
    fits = (
        near["sqm"].between(F.greatest(F.lit(5.0), F.col("s_sqm") * 0.75), F.col("s_sqm") * 1.25)
        & (F.col("price") >= F.when(F.col("deal") == "sale", LEAST_SALE).otherwise(LEAST_OTHER))
        & (F.col("s_kind").isNull() | (F.col("kind") == F.col("s_kind")))
        & ~F.col("entity_id").eqNullSafe(F.col("s_id"))
    )
    met = near.join(wide, (near["_b"] == wide["_b"]) & (F.col("deal") == F.col("s_deal")) & fits).drop("_b")
    km = X.rounded(111.32 * F.sqrt(F.pow(F.col("latitude") - F.col("s_lat"), 2) + F.pow((F.col("longitude") - F.col("s_lon")) * F.cos(F.radians("s_lat")), 2)), 2)
    by_area = F.when(F.col("s_area").isNull(), 2).when(F.col("area_key") == F.col("s_area"), 1).otherwise(5)
    other_rooms = F.when(F.col("s_rooms").isNull() | (F.col("rooms") == F.col("s_rooms")), 0).otherwise(1)
    met = met.withColumns({"distance_km": km, "ppm2": F.when(F.col("deal") == "sale", X.rounded(F.col("price") / F.col("sqm"), 0)).otherwise(X.rounded(F.col("price") / F.col("sqm"), 1))})
    return met.withColumn("score", X.rounded(F.coalesce("distance_km", by_area) + other_rooms + 4 * F.abs(F.col("sqm") - F.col("s_sqm")) / F.col("s_sqm"), 6))


def comparables(candidates: DataFrame, subjects: DataFrame, k: int = 20) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("s_id", "s_sqm", "s_area", "s_rooms").orderBy("score", "entity_id"))
    return scored(candidates, subjects).withColumn("rank", rank).where(F.col("rank") <= k)


def fair_price(comps: DataFrame, subjects: DataFrame) -> DataFrame:
    """comps, fair_low, fair_price, fair_high, ask_vs_fair_change_pct and exit_days of each subject."""
    keys = ["s_id", "s_sqm", "s_deal", "s_price"]
    quartiles = F.percentile("ppm2", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    g = comps.groupBy(*keys).agg(F.count(F.lit(1)).alias("comps"), quartiles, X.median("days_listed", F.col("status") == "exited").alias("d"))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in keys]
    out = subjects.select(*keys).alias("s").join(g.alias("g"), on, "left").select("s.*", "g.comps", "g.q", "g.d")
    value = lambda i: F.col("q")[i] * F.col("s_sqm")
    coarse = lambda x: F.when(F.col("s_deal") == "sale", X.rounded(x, -3)).otherwise(X.rounded(x, -1))
    return out.select(
        F.coalesce("comps", F.lit(0)).cast("long").alias("comps"),
        *(coarse(value(i)).alias(n) for i, n in enumerate(("fair_low", "fair_price", "fair_high"))),
        X.rounded(100.0 * (F.col("s_price") / F.nullif(value(1), F.lit(0)) - 1), 1).alias("ask_vs_fair_change_pct"),
        X.rounded("d", 0).alias("exit_days"),
    )
