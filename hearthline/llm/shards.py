"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that share a link key (here: equal texts, by 128 bits of hash) are linked through that key's
hub, so a key with a third of all rows needs no pairs. Every linked document starts in a hashed shard.
In each round one join gives each key's count of members by shard, and members move towards the shard
that holds most of their neighbours and still has room; admission ranks the movers of each shard and lets in
as many as its quota leaves free. Documents without links then fill each shard exactly up to its quota, so the
counts differ by one at most (law `rows`).

Defined cases: null text is of no bytes, has crc32 0 and no links; empty texts are equal texts;
repeated rows are placed as rows of their own; fewer rows than shards leave shards empty; an empty table
gives an empty result; other columns pass through, but for such as are named like the results, which these replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import brought_back, delete, ranked, set_aside, two_hashes, written


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def free_table(spark, free: list[int]) -> DataFrame:
    """One row per shard: bounded by the number of shards."""
    return spark.createDataFrame([(s, int(f)) for s, f in enumerate(free)], "to int, free long")


def propagate(linked: DataFrame, quota: list[int], rounds: int = 12) -> DataFrame:
    """linked (_row, _link, shard): moves rows towards their neighbours' shards within the quotas."""
    spark, shards = linked.sparkSession, len(quota)
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded: one row per shard
        free = [q - held.get(s, 0) for s, q in enumerate(quota)]
        by_hub = linked.groupBy("_link", "shard").agg(F.count(F.lit(1)).alias("n"))
        room = free_table(spark, free).where("free > 0")
        best = by_hub.join(F.broadcast(room), F.col("shard") == F.col("to")).groupBy("_link").agg(F.max_by("to", F.struct("n", -F.col("to"))).alias("to"), F.max("n").alias("n_to"))
        now = by_hub.select("_link", "shard", F.col("n").alias("n_now"))
        wish = now.join(best, "_link").where("to != shard and (n_to > n_now or (n_to = n_now and to < shard))").select("_link", "shard", "to")
        movers = written(linked.join(wish, ["_link", "shard"]), "movers")
        n = movers.count()
        if not n:
            delete(movers)
            break
        admitted = ranked(movers, "to", "_row", n, "place").join(F.broadcast(room.select(F.col("to").alias("t"), "free")), F.col("to") == F.col("t")).where("place < free")
        moved = linked.join(admitted.select("_row", "to"), "_row", "left").select("_row", "_link", F.coalesce("to", "shard").alias("shard"))
        after = written(moved, "labels")
        delete(movers)
        delete(linked)
        linked = after
    return linked


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 12, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    text = F.col(text_col)
    a, b = two_hashes(text)
    made = ["size", "text_crc32", "shard", "slot"]
    base = set_aside(docs, text_col).withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
        "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        "_link": F.when(text.isNotNull(), F.struct(a.alias("a"), b.alias("b"))),
    }).drop(text_col)
    base = written(base.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    rows = base.count()
    quota = quotas(rows, shards)
    # Written, so that both sides of the join below come out of shuffles that Spark may split at a hot key.
    hubs = written(base.where("_link is not null").groupBy("_link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_link"), "hubs")
    start = base.join(hubs, "_link").select("_row", "_link", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("shard"))
    linked = propagate(within_quota(written(start, "labels"), quota), quota, rounds)
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded: one row per shard
    free = [q - held.get(s, 0) for s, q in enumerate(quota)]
    singles = written(base.join(linked, "_row", "left_anti").select("_row", F.lit(0).alias("_all")), "singles")
    fill = ranked(singles, "_all", "_row", rows, "_place")
    ends, at = [], 0
    for s, f in enumerate(free):
        at += f
        ends.append((at, s))
    target = F.lit(shards - 1)
    for end, s in reversed(ends[:-1]):
        target = F.when(F.col("_place") < end, F.lit(s)).otherwise(target)
    labels = linked.select("_row", "shard").unionByName(fill.select("_row", target.cast("int").alias("shard")))
    placed = written(base.drop("_link").join(labels, "_row"), "placed")
    for used in (base, hubs, linked, singles):
        delete(used)
    return brought_back(ranked(placed, "shard", "_row", rows, "slot"), [c for c in docs.columns if c != text_col], made)


def within_quota(linked: DataFrame, quota: list[int]) -> DataFrame:
    """The start may overfill a shard where most rows are linked: the surplus goes to shards with room."""
    rows = linked.count()
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded: one row per shard
    if all(held.get(s, 0) <= q for s, q in enumerate(quota)):
        return linked
    limit = F.element_at(F.array(*(F.lit(q) for q in quota)), F.col("shard") + 1)
    placed = written(ranked(linked, "shard", "_row", rows, "place").withColumn("over", F.col("place") >= limit), "starts")
    surplus = written(placed.where("over").select("_row", "_link", F.lit(0).alias("_all")), "surplus")
    n = surplus.count()
    target, at = F.lit(len(quota) - 1), sum(max(0, q - held.get(s, 0)) for s, q in enumerate(quota))
    for s in range(len(quota) - 1, -1, -1):
        target = F.when(F.col("_place") < at, F.lit(s)).otherwise(target)
        at -= max(0, quota[s] - held.get(s, 0))
    moved = ranked(surplus, "_all", "_row", n, "_place").select("_row", "_link", target.cast("int").alias("shard"))
    out = written(placed.where("not over").select("_row", "_link", "shard").unionByName(moved), "labels")
    for used in (linked, placed, surplus):
        delete(used)
    return out
