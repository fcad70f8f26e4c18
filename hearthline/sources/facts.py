"""Fact tables of a market, and an adapter that derives them from the driver's star schema.

entities: current state of each listed item; history: reported prices; lifecycle: closings and reopenings;
runs and searches: collection. The adapter is plain DataFrame code, so column pruning and filters reach the scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import rounded
from . import archive

MOVED_DAYS = 8218
REPORTED, MARKER = "reported", "search"


@dataclass
class Facts:
    entities: DataFrame
    history: DataFrame
    lifecycle: DataFrame
    runs: DataFrame
    searches: DataFrame

    @property
    def reports(self) -> DataFrame:
        """Prices that the items' own histories report. Boards read these; markers of searches are for the queue of details."""
        return self.history.where(F.col("source") == REPORTED)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate(price, sqm, deal):
    """Price per square metre of sales of 5 square metres at least, kept from 1 to 15000."""
    r = F.when((deal == "sale") & (sqm >= 5), rounded(price / sqm, 0))
    return F.when(r.between(1, 15_000), r)


def currency(entity_id):
    return F.when(entity_id % 12 == 0, "EUR").when(entity_id % 12 == 6, "unknown").otherwise("BAM")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    both = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    i, first = F.col("o_orderkey"), F.to_date("o_orderdate")
    deal = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "rent").when(F.col("o_orderpriority") == "5-LOW", "daily_rent").otherwise("sale")
    sqm, price = (20 + i % 180).cast("double"), F.col("o_totalprice")
    closed = F.when(F.col("o_orderstatus") == "F", F.date_add(first, (1 + i % 200).cast("int")))
    words = lambda m, *vs: F.element_at(F.array(*(F.lit(v).cast("string") for v in vs)), (i % m + 1).cast("int"))
    extra = F.create_map(
        F.lit("views"), F.when(i % 17 == 0, "n/a").when(i % 7 != 0, (i % 500).cast("string")),
        F.lit("favorites"), F.when(i % 4 != 0, (i % 90).cast("string")),
        F.lit("furnished"), words(3, "true", "false", None),
        F.lit("heating"), words(6, "Drugo", "Plin", None, "z", None, None),
        F.lit("garage"), words(4, "true", "false", None, None),
        F.lit("bathrooms"), words(5, "1", "2", None, None, "x"),
        F.lit("latest_price_state"), words(9, "valid", "valid", "invalid", "valid", "conflict", "valid", None, "valid", "valid"),
    )
    characteristics = F.create_map(
        F.lit("lift"), words(4, "true", "false", "", None), F.lit("parking"), words(5, "da", "ne", "1", None, "x"), F.lit("balkon"), words(6, "Yes", "no", "maybe", "TRUE", "", None),
        F.lit("opremljenost"), words(7, "Namješten", "", None, "true", "Polunamješten", None, "false"), F.lit("namjestena"), words(5, "Da", None, None, "ne", None), F.lit("grijanje"), words(3, "Drugo", "Struja", None),
        F.lit("stanje"), words(4, "Renovirana", "Novogradnja", None, "A"), F.lit("sprat"), words(13, "7", *[None] * 12), F.lit("gara-a"), words(3, "Da", "0", None), F.lit("broj-kupatil"), words(3, "3", None, "1.5"),
        F.lit("ukupno-spratova"), (i % 12).cast("string"), F.lit("broj-etaza"), words(3, "1", "2", "tri"), F.lit("okucnica-kvadratura"), (i % 900).cast("string"), F.lit("primarna-orjentacija"), words(4, "Jug", "Sjever", "", None),
        F.lit("vrsta-poda"), words(3, "Parket", "Laminat", "k"), F.lit("kvadratura-balkona"), words(4, "4", "5.5", "5,5", None), F.lit("uknjizeno-zk"), words(3, "Da", "ne", None), F.lit("ostava-spajz"), words(4, "1", "0", "", None),
        F.lit("telefonski-priklju-ak"), words(5, "da", None, "ne", None, "?"), F.lit("klima"), words(4, "true", "false", None, "da"), F.lit("adresa"), F.concat(F.lit("Šetalište Đure "), F.col("c_name")),
        F.lit("ime-i-broj-licence-agenta"), F.concat(F.lit("Džemal "), (i % 50).cast("string")), F.lit("broj-posrednickog-ugovora"), F.concat((i % 70).cast("string"), F.lit("_%")),
    )
    return both.select(
        i.alias("entity_id"),
        F.concat(F.lit("item "), i.cast("string")).alias("title"),
        F.concat(F.lit("https://olx.ba/artikal/"), i.cast("string")).alias("url"),
        deal.alias("deal"),
        F.lower("c_mktsegment").alias("kind"),
        F.when(i % 23 != 0, F.col("n_name")).alias("area_key"),
        F.when(i % 11 != 0, (i % 5).cast("string")).alias("rooms"),
        F.when(i % 29 != 0, sqm).alias("sqm"),
        price.alias("price"),
        rate(price, F.when(i % 29 != 0, sqm), deal).alias("rate"),
        F.when(i % 19 != 0, 44.70 + (i % 97) / 1000).alias("latitude"),
        F.when(i % 19 != 0, 17.10 + (7 * i % 101) / 1000).alias("longitude"),
        F.when(F.col("o_custkey") % 3 == 0, "shop").when(F.col("o_custkey") % 3 == 1, "private").alias("seller"),
        F.when(i % 13 != 0, (i % 9 - 1).cast("int")).alias("floor_num"),
        currency(i).alias("currency"),
        F.when(i % 8 == 0, True).when(i % 8 == 1, False).alias("elevator"),
        F.when(i % 9 == 0, True).when(i % 9 == 1, False).alias("parking"),
        words(10, "Renovirana", "Novogradnja", *[None] * 8).alias("condition"),
        F.when(i % 5 > 0, (1950 + i % 75).cast("int")).alias("year_built"),
        extra.alias("extra"),
        characteristics.alias("characteristics"),
        first.alias("first_seen"),
        closed.alias("closed_at"),
        F.when(closed.isNotNull(), price).alias("closing_price"),
        F.when(i % 3 != 0, F.date_add(first, (i % 40).cast("int"))).alias("details_on"),
        F.when(i % 3 != 0, (F.date_add(first, (i % 40).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12)))).alias("details_at"),
        F.when(i % 5 == 0, F.lit("2001-08-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(mins=(i % 1500).cast("int"))).alias("attempted_at"),
        F.when(closed.isNotNull(), F.date_sub(closed, 1)).otherwise(F.date_add(first, (i % 300).cast("int"))).alias("last_seen"),
        F.when(i % 8 != 0, words(2, "active", "finished")).alias("source_status"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("search_key"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reported price per entity and day, with its currency; of a third of the items also markers of a search, on days
    that have a report and dearer than it."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.to_date("l_shipdate").alias("on_date"), "l_extendedprice")
    reports = lines.groupBy("entity_id", "on_date").agg(F.max("l_extendedprice").alias("price")).withColumns({"currency": currency(F.col("entity_id")), "source": F.lit(REPORTED)})
    marked = reports.where((F.col("entity_id") % 3 == 0) & (F.dayofmonth("on_date") % 2 == 0))
    return reports.unionByName(marked.withColumns({"price": F.col("price") * 1.25, "source": F.lit(MARKER)}))


def lifecycle(entities: DataFrame) -> DataFrame:
    """The final close of closed entities; a seventh of them also has an earlier cycle."""
    snapshot = ["entity_id", "title", "url", "deal", "kind", "area_key", "rooms", "sqm", "price", "latitude", "longitude"]
    closed = entities.where("closed_at is not null")
    twice = (F.col("entity_id") % 7 == 0) & (F.col("entity_id") % 200 > 5)
    back = F.date_add("first_seen", 5)
    event = lambda kind, on, opened: F.struct(F.lit(kind).alias("event"), on.alias("occurred_on"), opened.alias("opened_on"))
    last = event("closed", F.col("closed_at"), F.when(twice, back).otherwise(F.col("first_seen")))
    early = F.array(event("closed", F.date_add("first_seen", 3), F.col("first_seen")), event("reopened", back, F.lit(None).cast("date")), last)
    each = F.explode(F.when(twice, early).otherwise(F.array(last)))
    return closed.select(*snapshot, each.alias("e")).select(*snapshot, "e.*")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The log is moved to end where the orders end; a thousandth of it starts earlier, so that a window before is covered.
    moved = F.expr(f"cast(ts as timestamp_ntz) - make_dt_interval({MOVED_DAYS} + if(event_id % 1000 = 0, 300, 0))")
    e = read(spark, sf_dir, "events").withColumn("ts", moved)
    took = (30 + F.col("event_id") % 600).cast("int")
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("search_key"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_type") != "signup", F.date_trunc("second", "ts").cast("timestamp_ntz") + F.make_dt_interval(secs=took.cast("decimal(18,6)"))).alias("finished_at"),
        F.when(failed, "error").when(F.col("event_type") == "signup", "running").otherwise("ok").alias("status"),
        (~failed & (F.col("event_id") % 10 != 0)).alias("is_complete"),
        F.floor("value").cast("int").alias("cards"),
        (1 + F.col("event_id") % 30).cast("int").alias("pages"),
        F.when(failed, F.concat(F.lit("HTTP "), (500 + F.col("event_id") % 4).cast("string"), F.lit(" after "), F.col("props"))).alias("error"),
    )


def searches(runs: DataFrame) -> DataFrame:
    n = F.substr("search_key", F.lit(2)).cast("long")
    keys = runs.select("search_key").distinct()
    url = F.concat(F.lit("https://olx.ba/pretraga?s="), "search_key")
    return keys.select("search_key", F.concat(F.lit("search "), "search_key").alias("name"), url.alias("url"), F.when(n % 10 == 0, F.lit("2001-07-17 00:00:00").cast("timestamp_ntz")).alias("retired_at"))


def market(spark: SparkSession, sf_dir: str) -> Facts:
    items, logged = entities(spark, sf_dir), runs(spark, sf_dir)
    return Facts(items, history(spark, sf_dir), lifecycle(items), logged, searches(logged))


#: What boards may ask of an item, an event, a run and a search; a store that lacks a column has nulls there.
ENTITY = "entity_id bigint, title string, url string, deal string, kind string, area_key string, rooms string, sqm double, price double, rate double, latitude double, longitude double, seller string, floor_num int, currency string, elevator boolean, parking boolean, condition string, year_built int, extra map<string,string>, characteristics map<string,string>, first_seen date, last_seen date, published_on date, closed_at date, closing_price double, details_at timestamp_ntz, attempted_at timestamp_ntz, source_status string, search_keys array<string>"
EVENT = "entity_id bigint, event string, occurred_on date, opened_on date, title string, url string, deal string, kind string, area_key string, rooms string, sqm double, price double, latitude double, longitude double"
RUN = "run_id bigint, search_key string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, is_complete boolean, pages int, cards int, error string"
SEARCH = "search_key string, name string, url string, retired_at timestamp_ntz"


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns of df, with nulls for those it lacks."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def published(spark: SparkSession, folder: str, runs: DataFrame, searches: DataFrame) -> Facts:
    """The tables of a store of snapshots as facts, as of its newest commit; runs and searches are the collector's own."""
    items = shaped(archive.read_latest(spark, folder, "state"), ENTITY).withColumn("details_on", F.to_date("details_at"))
    prices = archive.read_prices(spark, folder)
    return Facts(items, prices, shaped(archive.read_deltas(spark, folder, "lifecycle"), EVENT), shaped(runs, RUN), shaped(searches, SEARCH))
