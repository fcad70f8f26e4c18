"""Queries of the jobs: normalisation, state transitions, areas, alerts and archives, each with DuckDB SQL."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geo
from ..sources import archive, export, payloads
from ..sources.facts import market, read
from . import alerts, normalize, state
from .board_sql import AS_OF, NOW, NOW_SQL, med, r
from .market_sql import reading, sql

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, more: str = "", adapter: bool = True):
    def put(f):
        QUERIES[name] = f
        if body:
            SQL[name] = sql(body, more) if adapter else body
        return f

    return put


# -- a state and a snapshot of one search, from the adapter's market ------------------------------------------------

KEY, DAY = "s7", AS_OF


def state_table(s: SparkSession, d: str) -> DataFrame:
    e = market(s, d).entities
    i = F.col("entity_id")
    keys = F.when(F.col("closed_at").isNotNull(), F.array().cast("array<string>")).when(i % 10 == 0, F.array(F.col("search_key"), F.lit("extra"))).otherwise(F.array("search_key"))
    noon = (F.col("details_on").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))).alias("details_at")
    return e.select(
        "entity_id", "title", "deal", "kind", "area_key", "rooms", "sqm", "price", "currency", "rate", "latitude", "longitude", "first_seen", F.when(i % 3 != 0, F.col("first_seen")).alias("published_on"),
        F.col("first_seen").alias("last_seen"), "closed_at", "closing_price", noon, F.when(i % 5 == 0, F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(mins=(i % 1500).cast("int"))).alias("attempted_at"), keys.alias("search_keys"), "search_key",
        F.create_map(F.lit("views"), (i % 500).cast("string")).alias("extra"), F.when(i % 6 == 0, F.create_map(F.lit(state.DECLARED_CODE), F.lit("x"))).otherwise(F.create_map(F.lit("lift"), F.lit("da"))).alias("characteristics"),
    )


def cards(s: SparkSession, d: str) -> DataFrame:
    """Most of a search's items with new facts, some twice (the earlier one is wrong), and some new ones."""
    i, price = F.col("entity_id"), F.col("price")
    seen = state_table(s, d).where(F.col("search_key") == KEY).where(i % 4 != 0)
    asked = F.when(i % 11 == 0, None).when(i % 5 == 0, price * 0.5).otherwise(price)
    known = seen.select(
        "entity_id", F.concat("title", F.lit("!")).alias("title"), pick(i % 5, ("rent", "sale", None, "daily_rent", "unknown")).alias("deal"), F.when(i % 2 == 1, F.col("kind")).alias("kind"), F.when(i % 2 == 0, F.col("rooms")).alias("rooms"),
        F.when(i % 3 != 0, F.col("sqm") + 1).alias("sqm"), asked.alias("price"), F.when(i % 7 == 0, "invalid").when(i % 11 == 0, "unpriced").otherwise("valid").alias("price_state"), F.when(i % 2 == 0, "BAM").alias("currency"), F.lit(1).alias("place"),
    )
    wrong = known.where(i % 13 == 0).withColumns({"title": F.lit("old"), "price": F.lit(1.0), "deal": F.lit("rent"), "place": F.lit(0)})
    fresh = seen.where(i % 9 == 0).select((i + 1_000_000_000).alias("entity_id"), "title", F.lit("sale").alias("deal"), "kind", "rooms", "sqm", "price", F.lit("valid").alias("price_state"), F.lit("EUR").alias("currency"), F.lit(1).alias("place"))
    return wrong.unionByName(known).unionByName(fresh)


def ingested(s: SparkSession, d: str) -> state.Ingested:
    return state.ingest_snapshot(state_table(s, d).drop("search_key"), cards(s, d), KEY, DAY)


STATE_SQL = f"""
st AS (SELECT * EXCLUDE (last_seen, details_at, attempted_at), first_seen AS last_seen, CASE WHEN closed_at IS NOT NULL THEN [] WHEN entity_id % 10 = 0 THEN [search_key, 'extra'] ELSE [search_key] END AS search_keys, details_on::TIMESTAMP + INTERVAL 12 HOUR AS details_at,
   CASE WHEN entity_id % 5 = 0 THEN TIMESTAMP '2001-08-01' - to_minutes(entity_id % 1500) END AS attempted_at, entity_id % 6 = 0 AS declared FROM entities),
seen AS (SELECT * FROM st WHERE search_key = 's7' AND entity_id % 4 <> 0),
cd AS (SELECT entity_id, title || '!' AS title, (['rent', 'sale', NULL, 'daily_rent', 'unknown'])[entity_id % 5 + 1] AS cdeal, kind, rooms, CASE WHEN entity_id % 3 <> 0 THEN sqm + 1 END AS csqm, CASE WHEN entity_id % 11 <> 0 THEN CASE WHEN entity_id % 5 = 0 THEN price * 0.5 ELSE price END END AS cprice,
    CASE WHEN entity_id % 7 = 0 THEN 'invalid' WHEN entity_id % 11 = 0 THEN 'unpriced' ELSE 'valid' END AS price_state, CASE WHEN entity_id % 2 = 0 THEN 'BAM' ELSE 'unknown' END AS currency, deal AS was_deal, price AS was, rate AS rate_was, sqm AS was_sqm, declared, closed_at AS was_closed, first_seen, false AS is_new, search_keys AS keys FROM seen
  UNION ALL SELECT entity_id + 1000000000, title, 'sale', kind, rooms, sqm, price, 'valid', 'EUR', NULL, NULL, NULL, NULL, false, NULL, DATE '2001-08-01', true, [] FROM seen WHERE entity_id % 9 = 0),
dl AS (SELECT *, CASE WHEN cdeal = 'daily_rent' THEN 'daily_rent' WHEN declared AND was_deal <> 'daily_rent' THEN was_deal WHEN cdeal IN ('rent', 'sale') THEN cdeal ELSE 'unknown' END AS deal, cprice IS NOT NULL AND price_state = 'valid' AS valid FROM cd),
pr AS (SELECT *, CASE WHEN valid THEN cprice WHEN was_deal = deal THEN was END AS price, coalesce(csqm, was_sqm) AS sqm FROM dl),
obs AS (SELECT *, CASE WHEN rr BETWEEN 1 AND 15000 THEN rr END AS rate FROM (SELECT *, CASE WHEN deal = 'sale' AND sqm >= 5 AND price > 0 THEN {r("price / sqm")} END AS rr FROM pr))
"""
REMOVED = "search_key = 's7' AND entity_id % 4 = 0 AND closed_at IS NULL"


@query("upsert_state", """SELECT entity_id, title, deal, kind, rooms, sqm, price, currency, rate, array_to_string(CASE WHEN list_contains(keys, 's7') THEN keys ELSE list_append(keys, 's7') END, ',') AS search_keys, first_seen, DATE '2001-08-01' AS last_seen, NULL::DATE AS closed_at,
   price_state AS latest, CASE WHEN NOT is_new THEN (entity_id % 500)::VARCHAR END AS views FROM obs""", STATE_SQL)
def _(s, d):
    rows = ingested(s, d).state.where(F.element_at("extra", "latest_price_state").isNotNull())
    return rows.select("entity_id", "title", "deal", "kind", "rooms", "sqm", "price", "currency", "rate", F.array_join("search_keys", ",").alias("search_keys"), "first_seen", "last_seen", "closed_at", F.element_at("extra", "latest_price_state").alias("latest"), F.element_at("extra", "views").alias("views"))


@query("unseen_state", f"SELECT count(*) AS n, sum(price::DECIMAL(20,2))::DOUBLE AS price, count(closed_at) AS closed, sum(len(search_keys) - CASE WHEN {REMOVED} THEN 1 ELSE 0 END)::BIGINT AS keys FROM st WHERE NOT (search_key = 's7' AND entity_id % 4 <> 0)".replace("count(closed_at)", f"count(*) FILTER (WHERE closed_at IS NOT NULL OR ({REMOVED} AND entity_id % 10 <> 0))"), STATE_SQL)
def _(s, d):
    rows = ingested(s, d).state.where(F.element_at("extra", "latest_price_state").isNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("price"), F.count("closed_at").alias("closed"), F.sum(F.size("search_keys")).alias("keys"))


@query("closures", f"SELECT entity_id, DATE '2001-08-01' AS closed_at, price AS closing_price FROM st WHERE {REMOVED} AND entity_id % 10 <> 0", STATE_SQL)
def _(s, d):
    rows = state.snapshot_rows(state_table(s, d).drop("search_key"), cards(s, d), KEY, DAY)
    return rows.where("closing").select("entity_id", "closed_at", "closing_price")


@query("membership_removed", "SELECT entity_id, array_to_string(list_filter(search_keys, lambda k: k <> 's7'), ',') AS search_keys FROM st WHERE list_contains(search_keys, 's7') AND entity_id % 4 = 0", STATE_SQL)
def _(s, d):
    st = state_table(s, d)
    out = state.drop_membership(st.select("entity_id", "search_keys"), KEY, cards(s, d).select("entity_id"))
    return out.join(st.where(F.array_contains("search_keys", KEY) & (F.col("entity_id") % 4 == 0)).select("entity_id"), "entity_id", "left_semi").select("entity_id", F.array_join("search_keys", ",").alias("search_keys"))


@query("lifecycle_events", f"""SELECT entity_id, 'reopened' AS event, NULL::DATE AS opened_on, price FROM obs WHERE was_closed IS NOT NULL
   UNION ALL SELECT entity_id, 'closed', first_seen, price FROM st WHERE {REMOVED} AND entity_id % 10 <> 0""", STATE_SQL)
def _(s, d):
    return ingested(s, d).lifecycle.select("entity_id", "event", "opened_on", "price")


@query("price_markers", "SELECT entity_id, DATE '2001-08-01' AS on_date, price, currency, 'search' AS source FROM obs WHERE valid AND (is_new OR was_deal <> deal OR price IS DISTINCT FROM was)", STATE_SQL)
def _(s, d):
    return ingested(s, d).markers


@query("upsert_prices", "SELECT entity_id, on_date, CASE WHEN entity_id % 3 = 0 THEN 7.0 ELSE price END AS price FROM history UNION ALL SELECT DISTINCT entity_id, DATE '2030-01-01', 7.0 FROM history WHERE entity_id % 3 = 0")
def _(s, d):
    h = market(s, d).reports
    third = h.where("entity_id % 3 = 0")
    again = third.withColumn("price", F.lit(7.0)).unionByName(third.select("entity_id", F.lit(date(2030, 1, 1)).alias("on_date"), F.lit(7.0).alias("price"), "currency", "source").distinct())
    return state.upsert_prices(h, again).select("entity_id", "on_date", "price")


@query("snapshot_summary", f"SELECT count(*) AS listing_count, {med('rate', 0, 'valid AND rate > 0')} AS median_rate, count(*) FILTER (WHERE is_new) AS new_count, count(*) FILTER (WHERE valid AND rate < rate_was) AS drop_count FROM obs", STATE_SQL)
def _(s, d):
    return ingested(s, d).summary


@query("carry_price", "SELECT entity_id, deal, price FROM obs WHERE NOT valid", STATE_SQL)
def _(s, d):
    return state.snapshot_rows(state_table(s, d).drop("search_key"), cards(s, d), KEY, DAY).where("_seen and not _valid").select("entity_id", "deal", "price")


@query("seen_minus_snapshot", "SELECT entity_id FROM st WHERE search_key = 's7' AND closed_at IS NULL AND entity_id % 4 = 0", STATE_SQL)
def _(s, d):
    return state_table(s, d).where(F.array_contains("search_keys", KEY)).join(cards(s, d), "entity_id", "left_anti").select("entity_id")


@query("sweep", "SELECT entity_id, array_to_string(CASE WHEN len(list_filter(search_keys, lambda k: k NOT IN ('s1', 's2', 'extra'))) > 0 THEN list_sort(list_filter(search_keys, lambda k: k IN ('s1', 's2', 'extra'))) ELSE search_keys END, ',') AS search_keys, CASE WHEN closed_at IS NULL AND len(list_filter(search_keys, lambda k: k IN ('s1', 's2', 'extra'))) = 0 THEN DATE '2001-08-01' ELSE closed_at END AS closed_at FROM st", STATE_SQL)
def _(s, d):
    return state.sweep(state_table(s, d), ["s1", "s2", "extra"], DAY).select("entity_id", F.array_join("search_keys", ",").alias("search_keys"), "closed_at")


@query("retire_searches", f"SELECT search_key, coalesce(retired_at, CASE WHEN search_key NOT IN ('u1', 'u2', 'u10') THEN {NOW_SQL} END) AS retired_at FROM searches")
def _(s, d):
    return state.retire_searches(market(s, d).searches, ["u1", "u2", "u10"], NOW).select("search_key", "retired_at")


@query("sweep_allowed", """SELECT cycle, c > 0 OR (ok = (SELECT count(*) FROM searches) AND bad = 0) AS allowed FROM (SELECT cycle, coalesce(sum(cards), 0) AS c, count(DISTINCT search_key) FILTER (WHERE status = 'ok' AND is_complete) AS ok,
   count(*) FILTER (WHERE NOT coalesce(status = 'ok' AND is_complete, false)) AS bad FROM (SELECT *, CASE WHEN cycle % 3 > 0 THEN 0 ELSE card_n END AS cards FROM (SELECT search_key, status, is_complete, cards AS card_n, run_id // 20 AS cycle FROM runs WHERE run_id // 20 % 7 <> 1 OR status = 'ok' AND is_complete)
   UNION ALL SELECT search_key, 'ok', true, 0, -1, 0 FROM searches) GROUP BY 1)""")
def _(s, d):
    """Cycles of twenty runs, most without a card, and one in which every search ran and saw nothing."""
    m, cycle = market(s, d), F.floor(F.col("run_id") / 20)
    runs = m.runs.withColumn("cycle", cycle).where("cycle % 7 <> 1 or (status = 'ok' and is_complete)").withColumn("cards", F.when(F.col("cycle") % 3 > 0, 0).otherwise(F.col("cards")))
    every = m.searches.select(F.lit(-1).cast("long").alias("cycle"), "search_key", F.lit("ok").alias("status"), F.lit(True).alias("is_complete"), F.lit(0).alias("cards"))
    return state.sweep_allowed(runs.select(*every.columns).unionByName(every), m.searches)


@query("enrich_merge", f"""SELECT entity_id, title, sqm, rooms, deal, price, CASE WHEN rr BETWEEN 1 AND 15000 THEN rr END AS rate, coalesce(published, DATE '1999-01-01') AS first_seen, published_on, details_at, CASE WHEN entity_id % 3 = 0 THEN 'EUR' ELSE 'unknown' END AS currency, CASE WHEN entity_id % 7 = 0 THEN 'invalid' ELSE 'valid' END AS latest, (entity_id % 500)::VARCHAR AS views, (entity_id % 4 + 1)::VARCHAR AS bathrooms FROM (
  SELECT *, CASE WHEN deal = 'sale' AND sqm >= 5 AND price > 0 THEN {r('price / sqm')} END AS rr FROM (
    SELECT *, CASE WHEN entity_id % 7 <> 0 THEN was + 1 WHEN deal = was_deal THEN was END AS price FROM (
      SELECT entity_id, CASE WHEN entity_id % 2 = 0 THEN 'detailed' ELSE title END AS title, coalesce(sqm, 33.0) AS sqm, coalesce(rooms, '9') AS rooms, (['sale', 'rent', 'unknown', 'daily_rent', 'unknown'])[entity_id % 5 + 1] AS deal, deal AS was_deal, price AS was, CASE WHEN entity_id % 3 <> 0 THEN first_seen END AS published,
        CASE WHEN entity_id % 3 <> 0 THEN first_seen ELSE DATE '1999-01-01' END AS published_on, {NOW_SQL} AS details_at FROM st WHERE entity_id % 4 = 0)))""", STATE_SQL)
def _(s, d):
    st, i = state_table(s, d), F.col("entity_id")
    details = st.where("entity_id % 4 = 0").select("entity_id", F.lit(33.0).alias("sqm"), F.when(i % 2 == 0, "detailed").alias("title"), F.lit(date(1999, 1, 1)).alias("published_on"), F.lit("9").alias("rooms"), pick(i % 5, ("sale", "rent", None, "daily_rent", "unknown")).alias("deal"), (F.col("price") + 1).alias("price"), F.when(i % 7 == 0, "invalid").otherwise("valid").alias("price_state"), F.when(i % 3 == 0, "EUR").alias("currency"), (i % 4 + 1).alias("bathrooms"))
    told = lambda k: F.element_at("extra", k)
    return state.enrich(st, details, NOW).where("entity_id % 4 = 0").select("entity_id", "title", "sqm", "rooms", "deal", "price", "rate", "first_seen", "published_on", "details_at", "currency", told("latest_price_state").alias("latest"), told("views").alias("views"), told("bathrooms").alias("bathrooms"))


@query("merge_card_and_detail", "SELECT entity_id, CASE WHEN entity_id % 2 = 0 AND entity_id % 5 <> 0 THEN 'detailed' ELSE title END AS title, CASE WHEN entity_id % 5 = 0 THEN deal WHEN entity_id % 3 = 0 THEN 'unknown' END AS deal FROM entities")
def _(s, d):
    e, i = market(s, d).entities, F.col("entity_id")
    details = e.where(i % 5 != 0).select("entity_id", F.when(i % 2 == 0, "detailed").otherwise("").alias("title"), F.when(i % 3 == 0, "unknown").alias("deal"))
    return state.merge_card_and_detail(e.select("entity_id", "title", "deal"), details)


@query("daily_reported_prices", """SELECT entity_id, on_date, arg_max(price, (reported_at, place)) AS price, arg_max(CASE WHEN entity_id % 2 = 0 THEN 'EUR' ELSE 'unknown' END, (reported_at, place)) AS currency, 'reported' AS source FROM (
   SELECT l_orderkey AS entity_id, (l_shipdate + INTERVAL 2 HOUR)::DATE AS on_date, l_extendedprice AS price, l_shipdate AS reported_at, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS place FROM lineitem WHERE l_extendedprice > 0) GROUP BY 1, 2""", adapter=False)
def _(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.struct("l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_shipdate").cast("timestamp").alias("reported_at"), F.when(F.col("l_orderkey") % 2 == 0, " EUR ").when(F.col("l_orderkey") % 3 == 0, "").alias("currency")).alias("r"))
    details = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list("r")).alias("reports"))
    return state.daily_reported_prices(details)


def prices(s: SparkSession, d: str) -> DataFrame:
    """Reported prices, and those of every third item as markers of a search."""
    return market(s, d).reports.withColumn("source", F.when(F.col("entity_id") % 3 == 0, state.SEARCH_SOURCE).otherwise(F.col("source")))


@query("enrichment_queue", f"""SELECT entity_id, unpinned, missing_sqm, never_detailed, stale, price_changed, pool_total FROM (SELECT *, count(*) OVER () AS pool_total FROM (
   SELECT *, latitude IS NULL OR longitude IS NULL AS unpinned, sqm IS NULL AND price IS NOT NULL AND deal = 'sale' AS missing_sqm, details_at IS NULL AS never_detailed, coalesce(details_at <= {NOW_SQL} - INTERVAL 7 DAY, false) AS stale, coalesce(m >= coalesce(details_on, DATE '1900-01-01'), false) AS price_changed
   FROM st LEFT JOIN (SELECT entity_id, max(on_date) AS m FROM history WHERE entity_id % 3 = 0 GROUP BY 1) USING (entity_id) WHERE closed_at IS NULL AND entity_id % 2 = 0 AND (attempted_at IS NULL OR attempted_at <= {NOW_SQL} - INTERVAL 720 MINUTE))
   WHERE unpinned OR missing_sqm OR never_detailed OR stale OR price_changed) ORDER BY never_detailed DESC, attempted_at NULLS FIRST, entity_id LIMIT 75""", STATE_SQL)
def _(s, d):
    st = state_table(s, d)
    return state.enrichment_queue(st, prices(s, d), NOW, 75, st.where("entity_id % 2 = 0").select("entity_id"))


@query("mark_attempts", f"SELECT entity_id, CASE WHEN entity_id % 7 = 0 THEN {NOW_SQL} ELSE attempted_at END AS attempted_at FROM st", STATE_SQL)
def _(s, d):
    st = state_table(s, d)
    return state.mark_attempts(st, st.where("entity_id % 7 = 0").select("entity_id"), NOW).select("entity_id", "attempted_at")


@query("clear_markers", "SELECT entity_id, count(*) AS n FROM history WHERE entity_id % 3 <> 0 OR entity_id NOT IN (SELECT entity_id FROM entities WHERE details_on IS NOT NULL) GROUP BY 1")
def _(s, d):
    return state.clear_markers(prices(s, d), market(s, d).entities.where("details_on is not null")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("abandoned_runs", """SELECT run_id, CASE WHEN gone THEN 'error' ELSE status END AS status, CASE WHEN gone THEN TIMESTAMP '2001-07-20 00:30:00' ELSE finished_at END AS finished_at, CASE WHEN gone THEN 'scraper process stopped before run completion' ELSE error END AS error
   FROM (SELECT *, status = 'running' AND finished_at IS NULL AND started_at < TIMESTAMP '2001-07-20 00:00:00' AS gone FROM runs)""")
def _(s, d):
    return state.recover_abandoned_runs(market(s, d).runs, datetime(2001, 7, 20, 0, 30), 30).select("run_id", "status", "finished_at", "error")


@query("has_recent_run", "SELECT DISTINCT search_key FROM runs WHERE status = 'ok' AND is_complete AND finished_at > TIMESTAMP '2001-07-31 00:00:00'")
def _(s, d):
    return state.has_recent_run(market(s, d).runs, NOW, 24 * 60)


PAGES_SQL = """
raw AS (SELECT event_id // 3 AS run_id, event_id % 3 + 1 AS page, CASE event_id % 41 WHEN 0 THEN 403 WHEN 1 THEN 500 ELSE 200 END AS http_status, event_id % 37 <> 0 AS has_data,
   CASE WHEN event_id // 3 % 8 = 0 THEN 0 ELSE 30 + CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END END AS total, CASE WHEN event_id // 3 % 16 = 0 THEN 1 WHEN event_id // 3 % 13 = 0 THEN 4 WHEN event_id // 3 % 47 = 0 THEN 31 ELSE 3 END AS last_page, event_id % 3 + 1 AS current_page,
   CASE WHEN event_id // 3 % 8 = 0 THEN 0 ELSE 10 END AS items, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS rejected FROM events WHERE event_id // 3 % 16 <> 0 OR event_id % 3 = 0 OR event_id // 3 % 32 = 0),
counted AS (SELECT *, CASE WHEN items = 0 OR run_id % 43 = 5 AND page = 2 THEN 0 ELSE items - rejected END AS cards, max(CASE WHEN page = 1 AND has_data AND http_status < 400 THEN total END) OVER w AS total_1, max(CASE WHEN page = 1 AND has_data AND http_status < 400 THEN last_page END) OVER w AS last_1 FROM raw WINDOW w AS (PARTITION BY run_id)),
pg AS (SELECT *, CASE WHEN http_status IN (403, 429) THEN 'blocked' WHEN http_status >= 400 THEN 'error' WHEN NOT has_data THEN 'malformed' WHEN ok AND items = 0 AND rejected = 0 AND total = 0 AND page = 1 AND last_page = 1 THEN 'verified_empty'
    WHEN rejected > 0 OR NOT ok OR items = 0 AND total <> 0 OR items > 0 AND cards = 0 THEN 'malformed' ELSE 'ok' END AS response_state
  FROM (SELECT *, coalesce(total = total_1 AND last_page = last_1 AND current_page = page AND current_page <= last_page, false) AS ok FROM counted))
"""


def pages(s: SparkSession, d: str) -> DataFrame:
    """Runs of three pages, with all that goes wrong: refused, without data, other totals, rejected items, no cards."""
    i = F.col("event_id")
    run, page = F.floor(i / 3), i % 3 + 1
    rejected, items = F.when(i % 29 == 0, 1).otherwise(0), F.when(run % 8 == 0, 0).otherwise(10)
    return state.classify_pages(read(s, d, "events").where((run % 16 != 0) | (i % 3 == 0) | (run % 32 == 0)).select(
        run.alias("run_id"), page.alias("page"), F.when(i % 41 == 0, 403).when(i % 41 == 1, 500).otherwise(200).alias("http_status"), (i % 37 != 0).alias("has_data"),
        F.when(run % 8 == 0, 0).otherwise(30 + F.when(i % 53 == 0, 1).otherwise(0)).alias("total"), F.when(run % 16 == 0, 1).when(run % 13 == 0, 4).when(run % 47 == 0, 31).otherwise(3).alias("last_page"), page.alias("current_page"), items.alias("items"),
        rejected.alias("rejected"), F.when((items == 0) | ((run % 43 == 5) & (page == 2)), 0).otherwise(items - rejected).alias("cards"),
    ))


@query("classify_pages", f"WITH {PAGES_SQL} SELECT run_id, page, response_state FROM pg", adapter=False)
def _(s, d):
    return pages(s, d).select("run_id", "page", "response_state")


@query("page_verdict", f"""WITH {PAGES_SQL}, cd AS (SELECT run_id, count(DISTINCT CASE WHEN run_id % 6 = 1 AND page = 3 THEN k + 100 ELSE page * 100 + k END) AS u FROM (SELECT run_id, page, unnest(range(0, cards)) AS k FROM pg) GROUP BY 1)
   SELECT run_id, CASE WHEN m THEN 'malformed' WHEN f THEN 'failed' WHEN last > 30 THEN 'capped' WHEN empty OR n < last THEN 'truncated' WHEN coalesce(u, 0) IS DISTINCT FROM total THEN 'count_mismatch' ELSE 'complete' END AS verdict
   FROM (SELECT run_id, bool_or(response_state = 'malformed') AS m, bool_or(response_state IN ('error', 'blocked')) AS f, min(last_page) AS last, count(*) AS n, max(CASE WHEN page = 1 THEN total END) AS total, bool_or(cards = 0 AND response_state = 'ok') AS empty FROM pg GROUP BY 1) LEFT JOIN cd USING (run_id)""", adapter=False)
def _(s, d):
    """Some runs show cards of their first page again on the third."""
    pg = pages(s, d)
    k, page = F.col("k"), F.col("page")
    cards = pg.where("cards > 0").select("run_id", "page", F.explode(F.sequence(F.lit(0), F.col("cards") - 1)).alias("k")).select("run_id", F.when((F.col("run_id") % 6 == 1) & (page == 3), k + 100).otherwise(page * 100 + k).alias("entity_id"))
    return state.completeness_verdict(pg, cards)


@query("dedupe_cards", "SELECT user_id AS run_id, k AS entity_id, min(event_id) AS place, count(*) - 1 AS repeats FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1, 2", adapter=False)
def _(s, d):
    rows = read(s, d, "events").select(F.col("user_id").alias("run_id"), F.get_json_object("props", "$.k").cast("long").alias("entity_id"), F.floor(F.col("event_id") / 20).alias("page"), F.col("event_id").alias("place"))
    return state.dedupe_cards(rows).select("run_id", "entity_id", "place", "repeats")


@query("run_log", "SELECT run_id, CASE WHEN finished_at IS NULL THEN 'running' ELSE status END AS status, started_at, finished_at FROM runs")
def _(s, d):
    runs = market(s, d).runs
    return state.run_log(runs.select("run_id", "started_at"), runs.where("finished_at is not null").select("run_id", "status", "finished_at")).select("run_id", "status", "started_at", "finished_at")


@query("revived_searches", "SELECT search_key, name, url, CASE WHEN search_key NOT IN (SELECT search_key FROM runs WHERE run_id % 3 = 0) THEN retired_at END AS retired_at FROM searches")
def _(s, d):
    m = market(s, d)
    ran = m.runs.where("run_id % 3 = 0").select("search_key").distinct().withColumn("name", F.lit(None).cast("string"))
    return state.revive_searches(m.searches, ran)


# -- normalisation ------------------------------------------------------------------------------------------------------


CATEGORIES = (23, 2668, 24, 29, 25, 26, 30, 1193, 2672, 28, 270, 9999)


def pick(k, words):
    return F.get(F.array(*(F.lit(w).cast("string") for w in words)), k.cast("int"))


def json_object(**fields) -> Column:
    """A JSON object of fields that are JSON already; those that are null are left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), F.lit("}"))


def quoted(c) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def spread_orders(s: SparkSession, d: str, key: str) -> DataFrame:
    """Orders dealt by a key, into all of the session's partitions: a file of few row groups is few tasks, narrow rows would be
    put together into few again, and each row here makes a kilobyte of JSON that is read."""
    return read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), key)


def item_json() -> Column:
    """An order as an item of a result page, with all that pages get wrong."""
    i, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    label = lambda name, v: F.concat(F.lit('{"label":"' + name + '","value":'), v, F.lit("}"))
    title = F.when(i % 50 == 2, "ab").when(i % 7 == 0, F.concat(F.lit(" Garsonjera "), i.cast("string"))).when(i % 3 == 0, F.concat(F.lit("Prodaja stana "), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("Najam kuce "), i.cast("string"))).otherwise(F.concat(F.lit("Oglas "), i.cast("string")))
    price = F.when(i % 10 == 0, '"po dogovoru"').when(i % 10 != 1, F.when(i % 2 == 0, quoted(p)).otherwise((i % 4000).cast("string")))
    point = F.concat(F.lit('{"lat":'), F.when(i % 2 == 0, (44 + i % 5).cast("string")).otherwise(quoted((44 + i % 5).cast("string"))), F.lit(',"lon":17.5}'))
    item = json_object(
        id=F.when(i % 50 == 1, '"x1"').when(i % 2 == 0, i.cast("string")).otherwise(quoted(i.cast("string"))), title=quoted(title), price=price,
        display_price=quoted(F.when(i % 9 == 0, "Na upit").otherwise(F.concat(p, F.lit(" KM")))), listing_type=quoted(pick(i % 5, ("sell", "rent", "prodaja", "x", None))), category_id=pick(i % 12, CATEGORIES),
        special_labels=F.concat(F.lit("["), F.concat_ws(",", F.lit("7"), F.when(i % 13 == 0, label(normalize.SQM_LABEL, F.lit('"7.500"'))).when(i % 13 != 1, label(normalize.SQM_LABEL, (40 + i % 60).cast("string"))), label(normalize.ROOMS_LABEL, quoted(pick(i % 3, ("Trosoban (3)", "2", "x"))))), F.lit("]")),
        location=F.when(i % 3 == 0, F.concat(F.lit('{"location":'), point, F.lit("}"))).otherwise(point), user_type=quoted(pick(i % 3, ("shop", "robot", "private"))), date=F.when(i % 4 == 0, "1752875036000").otherwise((1752875036 + i).cast("string")),
    )
    return F.when(i % 50 == 3, F.lit("7")).otherwise(item)


def item_payloads(s: SparkSession, d: str) -> DataFrame:
    """A result page per customer, as the archive holds it: JSON texts with the customer's orders as items."""
    c = F.col("o_custkey")
    g = spread_orders(s, d, "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item_json().alias("j")))).alias("x"))
    data = F.concat(F.lit('{"data":['), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit('],"meta":{"total":'), F.size("x").cast("string"), F.lit(',"current_page":1}}'))
    return g.select(c.alias("id"), F.lit("search").alias("kind"), (c % 33 == 0).alias("diagnostic"), F.when(c % 20 == 0, F.lit('{"error": true}')).otherwise(data).alias("source_payload"), F.lit(None).cast("string").alias("payload"))


def items(s, d):
    return payloads.items_of(payloads.parse_pages(item_payloads(s, d), "source_payload")).select("id", "item").where("place is not null")


#: The same items for DuckDB, as the rules' inputs.
GIVEN = """it AS (SELECT o_custkey AS c, o_orderkey AS i, floor(o_totalprice) AS p, o_orderkey > 0 AND o_orderkey % 50 NOT IN (1, 2, 3) AS ok,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Garsonjera ' WHEN o_orderkey % 3 = 0 THEN 'Prodaja stana ' WHEN o_orderkey % 3 = 1 THEN 'Najam kuce ' ELSE 'Oglas ' END || o_orderkey AS title,
    ([23, 2668, 24, 29, 25, 26, 30, 1193, 2672, 28, 270, 9999])[o_orderkey % 12 + 1] AS category_id,
    (['apartments', 'daily_rent', 'houses', 'land', 'commercial', 'vacation_homes', 'garages', 'prefab', 'warehouses', 'rooms', 'other', 'other'])[o_orderkey % 12 + 1] AS kind,
    CASE WHEN o_orderkey % 13 = 0 THEN 7500 WHEN o_orderkey % 13 <> 1 THEN 40 + o_orderkey % 60 END::DOUBLE AS sqm,
    CASE WHEN o_orderkey % 12 = 1 THEN 'daily_rent' ELSE (['sale', 'rent', 'sale', NULL, NULL])[o_orderkey % 5 + 1] END AS deal FROM orders WHERE o_custkey % 20 <> 0)"""
CARDS_READ = reading("""SELECT i AS id, CASE WHEN i % 10 > 1 THEN CASE WHEN i % 2 = 0 THEN p ELSE i % 4000 END END::DOUBLE AS v, CASE WHEN i % 10 = 1 THEN 'missing' WHEN i % 2 = 1 AND i % 4000 = 0 THEN 'zero' WHEN i % 10 = 0 OR i % 9 = 0 THEN 'not_priced' END AS m,
    kind, deal, false AS declared, title, sqm AS area FROM it WHERE ok""")


@query("normalize_items", f"""WITH {GIVEN}, {CARDS_READ} SELECT i AS entity_id, title, 'https://olx.ba/artikal/' || i AS url, kind, sqm, CASE WHEN i % 7 = 0 THEN '0' ELSE (['3', '2', NULL])[i % 3 + 1] END AS rooms, r.deal, r.price, r.state AS price_state, r.reason AS price_reason, r.basis AS price_basis,
   'BAM' AS currency, CASE WHEN i % 5 < 3 THEN 44 + i % 5 END::DOUBLE AS latitude, (['shop', NULL, 'private'])[i % 3 + 1] AS seller, CASE WHEN i % 4 <> 0 THEN make_timestamp((1752875036 + i) * 1000000) END AS renewed_at FROM it JOIN reading r ON r.id = i WHERE i % 9 <> 0
   UNION ALL SELECT i, title, 'https://olx.ba/artikal/' || i, kind, sqm, CASE WHEN i % 7 = 0 THEN '0' ELSE (['3', '2', NULL])[i % 3 + 1] END, r.deal, r.price, r.state, r.reason, r.basis, NULL, CASE WHEN i % 5 < 3 THEN 44 + i % 5 END::DOUBLE, (['shop', NULL, 'private'])[i % 3 + 1], CASE WHEN i % 4 <> 0 THEN make_timestamp((1752875036 + i) * 1000000) END FROM it JOIN reading r ON r.id = i WHERE i % 9 = 0""", adapter=False)
def _(s, d):
    accepted, _ = normalize.normalize_search_items(items(s, d))
    return accepted.select("entity_id", "title", "url", "kind", "sqm", "rooms", "deal", "price", "price_state", "price_reason", "price_basis", "currency", "latitude", "seller", F.col("renewed_at").cast("timestamp_ntz").alias("renewed_at"))


@query("rejection_reasons", f"WITH {GIVEN} SELECT CASE WHEN i % 50 = 3 THEN 'not_an_object' WHEN i % 50 = 2 AND i > 0 THEN 'invalid_title' ELSE 'invalid_id' END AS reason, count(*) AS n FROM it WHERE NOT ok GROUP BY 1", adapter=False)
def _(s, d):
    return normalize.normalize_search_items(items(s, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("search_pages", "SELECT o_custkey AS id, o_custkey % 20 <> 0 AS usable, CASE WHEN o_custkey % 20 <> 0 THEN count(*) END AS items FROM orders GROUP BY 1", adapter=False)
def _(s, d):
    pages = payloads.parse_pages(item_payloads(s, d), "source_payload")
    return pages.select("id", "usable", F.when(F.col("usable"), F.size("data")).cast("long").alias("items"))


def detail_json() -> Column:
    """An order as an item's details."""
    i, p = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    a = lambda code, v: F.concat(F.lit('{"attr_code":"' + code + '","value":'), v, F.lit("}"))
    attributes = F.concat(F.lit("["), F.concat_ws(
        ",", F.when(i % 4 == 0, a("vrsta-oglasa", quoted(pick(i % 3, ("Iznajmljivanje", "Prodaja", "Potraga"))))), F.when(i % 2 == 0, a("kvadratura", (30 + i % 50).cast("string"))), a("kvadrata", F.lit('" "')), F.when(i % 2 == 1, a("kvadrata", quoted(F.concat((20 + i % 70).cast("string"), F.lit(",5"))))),
        a("kvadrata", F.lit("1")), a("broj-soba", quoted(pick(i % 4, ("Trosoban (3)", "Garsonjera", "4+", "tri")))), a("sprat", quoted((i % 230 - 10).cast("string"))), a("grijanje", F.lit('"Plin"')), F.when(i % 3 == 0, a("vrsta-grijanja", F.lit('"Centralno"'))),
        F.when(i % 5 == 0, a("namjestena", F.lit('"Da"'))), F.when(i % 5 == 1, a("opremljenost", F.lit('"Polunamješten"'))), F.when(i % 5 < 3, a("namjesten", F.lit('"ne"'))), a("gara-a", quoted(pick(i % 3, ("da", "ne", "?")))), a("lift", F.when(i % 2 == 0, F.lit("true")).otherwise(F.lit('"0"'))),
        a("godina-izgradnje", (1790 + i % 400).cast("string")), a("novi-kod", quoted(F.concat((i % 9).cast("string"), F.lit(",50")))), a("novi-kod", F.lit('"x"')), F.lit("5"),
    ), F.lit("]"))
    detail = json_object(
        id=i.cast("string"), title=quoted(F.when(i % 3 == 0, "Prodaja").otherwise("Stan")), price=F.when(i % 2 == 0, quoted(p)).otherwise((i % 4000).cast("string")), listing_type=quoted(pick(i % 5, ("sell", "rent", "prodaja", "x", None))), category_id=pick(i % 12, CATEGORIES), attributes=attributes,
        location=F.lit('{"lat":"44.77","lon":17.19}'), user=F.concat(F.lit('{"type":'), quoted(pick(i % 2, ("shop", "x"))), F.lit("}")), views=(i % 50).cast("string"), created_at=F.lit("1752875036"), date=F.when(i % 2 == 0, '"1752875036"').otherwise("null"), status=F.lit('"active"'),
    )
    return F.when(i % 60 == 7, F.lit("[1]")).when(i % 60 == 8, F.lit('{"title":"x"}')).when(i % 60 == 9, F.lit("{")).otherwise(detail)


DETAILS = """dt AS (SELECT o_orderkey AS i, floor(o_totalprice) AS p, CASE WHEN o_orderkey % 3 = 0 THEN 'Prodaja' ELSE 'Stan' END AS title, (['apartments', 'daily_rent', 'houses', 'land', 'commercial', 'vacation_homes', 'garages', 'prefab', 'warehouses', 'rooms', 'other', 'other'])[o_orderkey % 12 + 1] AS kind,
    CASE WHEN o_orderkey % 2 = 0 THEN 30 + o_orderkey % 50 ELSE 20.5 + o_orderkey % 70 END::DOUBLE AS sqm, CASE WHEN o_orderkey % 4 = 0 THEN (['rent', 'sale', NULL])[o_orderkey % 3 + 1] END AS declared,
    (['sale', 'rent', 'sale', NULL, NULL])[o_orderkey % 5 + 1] AS listed FROM orders WHERE o_orderkey > 0 AND o_orderkey % 60 NOT IN (7, 8, 9))"""
DETAILS_READ = reading("""SELECT i AS id, CASE WHEN i % 2 = 0 THEN p ELSE i % 4000 END::DOUBLE AS v, CASE WHEN i % 2 = 1 AND i % 4000 = 0 THEN 'zero' END AS m, kind, CASE WHEN kind = 'daily_rent' THEN 'daily_rent' ELSE coalesce(declared, listed) END AS deal, declared IS NOT NULL AS declared, title, sqm AS area FROM dt""")


@query("map_detail", f"""WITH {DETAILS}, {DETAILS_READ} SELECT i AS entity_id, kind, r.deal, declared, r.price, r.state AS price_state, r.reason AS price_reason, r.basis AS price_basis, sqm, (['3', '0', '4+', NULL])[i % 4 + 1] AS rooms, (['Trosoban (3)', 'Garsonjera', '4+', 'tri'])[i % 4 + 1] AS rooms_detail,
   CASE WHEN i % 230 - 10 BETWEEN -5 AND 200 THEN i % 230 - 10 END::INTEGER AS floor_num, CASE WHEN i % 3 = 0 THEN 'Centralno' ELSE 'Plin' END AS heating, CASE i % 5 WHEN 0 THEN true WHEN 2 THEN false END AS furnished, CASE i % 3 WHEN 0 THEN true WHEN 1 THEN false END AS garage, i % 2 = 0 AS elevator,
   CASE WHEN 1790 + i % 400 BETWEEN 1800 AND 2100 THEN 1790 + i % 400 END::INTEGER AS year_built, (i % 9) || '.5' AS unknown_code, 44.77::DOUBLE AS latitude, CASE WHEN i % 2 = 0 THEN 'shop' END AS seller, (i % 50)::INTEGER AS views, TIMESTAMP '2025-07-18 21:43:56' AS published_at, CASE WHEN i % 2 = 0 THEN TIMESTAMP '2025-07-18 21:43:56' END AS renewed_at
   FROM dt JOIN reading r ON r.id = i""", adapter=False)
def _(s, d):
    details = payloads.parse_details(spread_orders(s, d, "o_orderkey").select(detail_json().alias("body")), "body").drop("body")
    time_of = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return normalize.map_details(details).select(
        "entity_id", "kind", "deal", "declared", "price", "price_state", "price_reason", "price_basis", "sqm", "rooms", "rooms_detail", "floor_num", "heating", "furnished", "garage", "elevator", "year_built",
        F.element_at("characteristics", "novi-kod").alias("unknown_code"), "latitude", "seller", "views", time_of("published_at"), time_of("renewed_at"),
    )


@query("attributes_pivot", """SELECT o_orderkey AS entity_id, 'Plin' AS heating, 3 AS bathrooms, (o_orderkey % 70)::INTEGER AS unit_levels FROM orders WHERE o_orderkey % 70 BETWEEN 1 AND 50
   UNION ALL SELECT o_orderkey, 'Plin', 3, NULL FROM orders WHERE o_orderkey % 70 NOT BETWEEN 1 AND 50""", adapter=False)
def _(s, d):
    a = lambda code, v: F.concat(F.lit('{"attr_code":"' + code + '","value":'), v, F.lit("}"))
    text = F.concat(F.lit("["), F.concat_ws(",", a("vrsta-grijanja", F.lit('"Drva"')), a("broj-kupatila", F.lit("2")), a("broj-etaza", (F.col("o_orderkey") % 70).cast("string")), a("broj-kupatil", F.lit('"3"')), a("grijanje", F.lit('"Plin"')), a("grijanje", F.lit('"Struja"'))), F.lit("]"))
    entries = normalize.attribute_entries(F.try_variant_get(F.parse_json(text), "$", "array<variant>"))
    return normalize.attributes_to_columns(read(s, d, "orders").select(F.col("o_orderkey").alias("entity_id"), entries.alias("entries"))).select("entity_id", "heating", "bathrooms", "unit_levels")


@query("replay_summary", f"""WITH {GIVEN}, {CARDS_READ}, pages AS (SELECT o_custkey AS id, count(*) FILTER (WHERE o_orderkey > 0 AND o_orderkey % 50 NOT IN (1, 2, 3)) AS good, count(*) FILTER (WHERE o_orderkey % 50 = 3) AS n3, count(*) FILTER (WHERE o_orderkey % 50 = 2) AS n2, count(*) FILTER (WHERE o_orderkey % 50 = 1 OR o_orderkey = 0) AS n1 FROM orders GROUP BY 1),
   {DETAILS}, d2 AS (SELECT * FROM dt)
   SELECT id, 'search' AS kind, id % 33 = 0 AS diagnostic, CASE WHEN id % 33 = 0 THEN NULL WHEN id % 20 = 0 THEN 0 ELSE good END AS parsed_items, CASE WHEN id % 33 = 0 THEN NULL WHEN id % 20 = 0 THEN 0 ELSE n1 + n2 + n3 END AS rejected_items,
     CASE WHEN id % 33 = 0 THEN NULL WHEN id % 20 = 0 THEN 'data_not_array:1' ELSE concat_ws(',', CASE WHEN n1 > 0 THEN 'invalid_id:' || n1 END, CASE WHEN n2 > 0 THEN 'invalid_title:' || n2 END, CASE WHEN n3 > 0 THEN 'not_an_object:' || n3 END) END AS rejections,
     NULL::BIGINT AS entity_id, NULL AS property_type, NULL AS rooms_known, CASE WHEN id % 33 = 0 THEN 'no_source' ELSE 'replayed' END AS outcome FROM pages
   UNION ALL SELECT 1000000000 + o_orderkey, 'detail', o_orderkey % 33 = 0, NULL, NULL, NULL, CASE WHEN o_orderkey % 33 <> 0 THEN dt.i END, CASE WHEN o_orderkey % 33 <> 0 THEN dt.kind END, CASE WHEN o_orderkey % 33 <> 0 AND dt.i IS NOT NULL THEN 'pinned' END, CASE WHEN o_orderkey % 33 = 0 THEN 'no_source' ELSE 'replayed' END FROM orders LEFT JOIN dt ON dt.i = o_orderkey""", adapter=False)
def _(s, d):
    i = F.col("o_orderkey")
    details = spread_orders(s, d, "o_orderkey").select((i + 1_000_000_000).alias("id"), F.lit("detail").alias("kind"), (i % 33 == 0).alias("diagnostic"), F.lit(None).cast("string").alias("source_payload"), detail_json().alias("payload"))
    out = normalize.replay(item_payloads(s, d).unionByName(details))
    return out.select("id", "kind", "diagnostic", "parsed_items", "rejected_items", F.when(F.col("kind") == "search", F.coalesce("rejections", F.when(~F.col("diagnostic"), F.lit("")))).alias("rejections"), "entity_id", "property_type", F.when(F.col("has_pin"), "pinned").alias("rooms_known"), "outcome")


def reports(s, d):
    i, at = F.col("l_linenumber"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")
    report = F.struct(F.when(i == 3, F.lit("soon")).otherwise(at).alias("at"), F.floor("l_extendedprice").cast("string").alias("price"), F.lit(True).alias("is_text"), F.when(i % 2 == 0, "EUR").alias("currency"))
    g = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(report).alias("reports"))
    per_sqm = F.col("l_orderkey") % 3 == 0
    return g.select(F.col("l_orderkey").alias("entity_id"), F.when(F.col("l_orderkey") % 2 == 0, "sale").otherwise("rent").alias("deal"), F.lit("apartments").alias("kind"), F.when(per_sqm, "per_sqm").otherwise("total").alias("price_basis"), F.when(F.col("l_orderkey") % 5 > 0, 60.0).alias("sqm"), "reports")


REPORTS = """rp AS (SELECT l_orderkey AS e, l_shipdate AS told, floor(l_extendedprice) AS v, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'EUR' END AS currency, l_orderkey % 3 = 0 AS per_sqm, CASE WHEN l_orderkey % 2 = 0 THEN 'sale' ELSE 'rent' END AS deal, l_orderkey % 5 > 0 AS area FROM lineitem),
why AS (SELECT *, CASE WHEN n = 3 THEN 'invalid_timestamp' WHEN told > TIMESTAMP '2001-08-01' THEN 'future_timestamp' WHEN per_sqm THEN CASE WHEN v <= 0 THEN 'not_numeric' WHEN NOT area THEN 'per_sqm_without_area' END WHEN v = 0 THEN 'zero' WHEN v < 50 THEN 'below_' || deal || '_minimum' WHEN v < 3000 AND deal = 'sale' THEN 'below_sale_minimum' END AS reason,
  CASE WHEN per_sqm THEN v * 60 ELSE v END AS price FROM rp)"""


@query("history_accepted", f"WITH {REPORTS} SELECT entity_id, reported_at, price, currency, row_number() OVER (PARTITION BY entity_id ORDER BY reported_at, price, currency NULLS FIRST) AS place FROM (SELECT DISTINCT e AS entity_id, told AS reported_at, price::DOUBLE AS price, currency FROM why WHERE reason IS NULL) QUALIFY count(*) OVER (PARTITION BY entity_id, reported_at, price) = 1", adapter=False)
def _(s, d):
    good = normalize.normalize_history(reports(s, d), NOW)[0].withColumn("reported_at", F.col("reported_at").cast("timestamp_ntz"))
    return good.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("entity_id", "reported_at", "price"))).where("_n = 1").drop("_n")  # places of ties follow the list, which this table does not fix


@query("history_rejected", f"WITH {REPORTS} SELECT reason, count(*) AS n FROM (SELECT reason FROM why WHERE reason IS NOT NULL UNION ALL SELECT 'duplicate' FROM why WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY e, told, price, currency ORDER BY n) > 1) GROUP BY 1", adapter=False)
def _(s, d):
    return normalize.normalize_history(reports(s, d), NOW)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("records_from_json", "SELECT user_id, event_id, json_extract(props, '$.k')::BIGINT AS k FROM events", adapter=False)
def _(s, d):
    e = read(s, d, "events").select("user_id", F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).alias("x"))
    batches = e.groupBy("user_id").agg(F.to_json(F.collect_list("x")).alias("batch"))
    return payloads.records_from_json(batches, "batch", "event_id: long, k: long")


# -- archives and exports ------------------------------------------------------------------------------------------------


@query("retain_latest", "SELECT max(event_id) AS id FROM (SELECT *, event_id % 5 = 0 AS dg FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, dg ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type, user_id, dg", adapter=False)
def _(s, d):
    rows = read(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("url"), F.when(F.col("event_id") % 5 == 0, archive.DIAGNOSTIC).otherwise(archive.CANONICAL).alias("archive_format"), F.col("ts").alias("fetched_at"))
    return archive.retain_latest(rows).select("id")


@query("archived_responses", "SELECT event_id AS id, CASE WHEN event_id % 2 = 1 AND event_id % 5 <> 0 THEN props END AS payload, CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 THEN props END AS source_payload, CASE WHEN event_id % 5 = 0 THEN 'diagnostic-v2' ELSE 'canonical-v2' END AS archive_format FROM events", adapter=False)
def _(s, d):
    i = F.col("event_id")
    rows = read(s, d, "events").select(i.alias("id"), F.when(i % 2 == 0, "search").otherwise("detail").alias("kind"), F.when(i % 5 == 0, "HTTP 500").alias("diagnostic"), F.col("props").alias("body"))
    return archive.archived_responses(rows).select("id", "payload", "source_payload", "archive_format")


@query("archived_details", "SELECT event_id AS entity_id, 'https://olx.ba/api/listings/' || event_id AS url, 'detail' AS kind, props AS payload, 'canonical-v2' AS archive_format FROM events WHERE event_id % 7 <> 0", adapter=False)
def _(s, d):
    rows = read(s, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("entity_id"), F.col("ts").alias("fetched_at"), F.col("props").alias("body"))
    return archive.archived_details(rows).select("entity_id", "url", "kind", "payload", "archive_format")


def manifest_rows(s, d):
    i = F.col("event_id")
    return read(s, d, "events").select(
        F.col("user_id").alias("run_id"), (i % 3).cast("int").alias("page"), F.lit(1).alias("attempt"), F.when(i % 4 == 0, F.array(F.lit("invalid_id"))).alias("rejections"), F.when(i % 5 == 0, F.repeat("props", 100)).alias("error"), i.alias("recorded_at"),
        (i % 6 != 0).alias("is_authoritative"), F.when(i % 6 != 0, "ok").otherwise("error").alias("response_state"), F.concat(F.lit("https://market.example/?page="), (i % 3).cast("string")).alias("url"),
    )


@query("page_manifest", "SELECT user_id AS run_id, event_id % 3 AS page, max(event_id) AS recorded_at, CASE WHEN max(event_id) % 4 = 0 THEN 1 ELSE 0 END AS rejection_count, CASE WHEN max(event_id) % 5 = 0 THEN least(1000, 100 * length(arg_max(props, event_id))) END AS error_chars FROM events GROUP BY 1, 2", adapter=False)
def _(s, d):
    return archive.page_manifest(manifest_rows(s, d)).select("run_id", "page", "recorded_at", "rejection_count", F.char_length("error").alias("error_chars"))


@query("page_diagnostics", "SELECT user_id AS run_id, 'diagnostic-v2' AS archive_format, 'https://market.example/?page=' || event_id % 3 AS url, max(event_id) AS fetched_at FROM events GROUP BY user_id, event_id % 3 HAVING max(event_id) % 4 = 0 OR max(event_id) % 6 = 0", adapter=False)
def _(s, d):
    return archive.page_diagnostics(archive.page_manifest(manifest_rows(s, d))).where("payload is null and source_payload is null").select("run_id", "archive_format", "url", "fetched_at")


@query("csv_rows", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '''=' || event_type ELSE event_type END AS cell FROM events", adapter=False)
def _(s, d):
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type"))
    return export.csv_rows(read(s, d, "events").select("event_id", cell.alias("cell")))


@query("groups_to_json", """SELECT 'customers' AS "group", c_custkey AS key, c_name AS name, c_acctbal AS balance, false AS bare FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)
   UNION ALL SELECT 'customers', c_custkey, c_name, c_acctbal, true FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)
   UNION ALL SELECT 'suppliers', s_suppkey, s_name, s_acctbal, s_suppkey = (SELECT min(s_suppkey) FROM supplier) FROM supplier""", adapter=False)
def _(s, d):
    """The document's lines, read back: every row of both groups, and which have no comma before them."""
    path = f"{archive.shared_folder(s)}/documents/{uuid.uuid4().hex}"
    export.groups_to_json({"customers": read(s, d, "customer").orderBy("c_custkey"), "suppliers": read(s, d, "supplier").orderBy("s_suppkey")}, path)
    line = s.read.text(path).where("value rlike '^,?[{]\"._'").select(F.from_json(F.ltrim(F.col("value"), F.lit(",")), "c_custkey bigint, c_name string, c_acctbal double, s_suppkey bigint, s_name string, s_acctbal double").alias("x"), ~F.col("value").startswith(",")).toDF("x", "bare")
    return line.select(F.when(F.col("x.c_custkey").isNotNull(), "customers").otherwise("suppliers").alias("group"), *(F.coalesce(f"x.c_{a}", f"x.s_{b}").alias(n) for a, b, n in (("custkey", "suppkey", "key"), ("name", "name", "name"), ("acctbal", "acctbal", "balance"))), "bare")


@query("collect_rows", """SELECT '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","nations":' || n || '}', ',' ORDER BY r_regionkey) || ']' AS rows FROM (SELECT r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)""", adapter=False)
def _(s, d):
    n = read(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("nations"))
    few = read(s, d, "region").join(n, "r_regionkey").select("r_regionkey", "r_name", "nations").orderBy("r_regionkey")
    return export.collect_rows(few)


@query("price_currencies", "SELECT CASE entity_id % 12 WHEN 0 THEN 'EUR' WHEN 6 THEN 'unknown' ELSE 'BAM' END AS currency, count(*) AS n FROM history GROUP BY 1")
def _(s, d):
    return market(s, d).reports.groupBy("currency").agg(F.count(F.lit(1)).alias("n"))


@query("versioned_publish", "SELECT 2 AS version, count(*) AS n FROM customer", adapter=False)
def _(s, d):
    folder, customers = f"{archive.shared_folder(s)}/published-{uuid.uuid4().hex}", read(s, d, "customer")
    archive.publish({"customer": customers.where("c_custkey % 2 = 0")}, folder, 1)
    archive.publish({"customer": customers}, folder, 2)
    customers.where("c_custkey % 3 = 0").write.mode("overwrite").parquet(f"{folder}/customer/version=3")  # written, never committed
    return archive.read_latest(s, folder, "customer").agg(F.lit(archive.latest_version(s, folder)).alias("version"), F.count(F.lit(1)).alias("n"))


# -- areas ---------------------------------------------------------------------------------------------------------------

#: Coordinates are multiples of 1 / 1024, so that both engines have them exactly and pins on borders can be compared.
AREAS_SQL = """boxes AS (SELECT 'Čaršija ' || n_name AS name, 'Carsija ' || n_name AS plain, 17.125 + n_nationkey % 5 * 24 / 1024.0 AS w, 44.6875 + n_nationkey // 5 * 24 / 1024.0 AS s FROM nation),
pins AS (SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 19 <> 0 THEN 17.0::DOUBLE + 7 * o_orderkey % 401 / 1024.0::DOUBLE END AS x, CASE WHEN o_orderkey % 19 <> 0 THEN 44.625::DOUBLE + o_orderkey % 397 / 1024.0::DOUBLE END AS y FROM orders),
inside AS (SELECT entity_id, name FROM pins JOIN boxes ON x >= w AND x <= w + 16 / 1024.0 AND y >= s AND y <= s + 16 / 1024.0),
gaps AS (SELECT entity_id, name, x, y, w - x AS a, x - w - 16 / 1024.0 AS b, s - y AS c, y - s - 16 / 1024.0 AS d, cos(radians(y)) AS k FROM pins JOIN boxes ON abs(x - w) < 0.2 AND abs(y - s) < 0.2),
far AS (SELECT entity_id, name, round(111320.0 * CASE WHEN a <= 0 AND b <= 0 AND c <= 0 AND d <= 0 THEN least(-a * k, -b * k, -c, -d) ELSE sqrt(pow(greatest(a, b, 0) * k, 2) + pow(greatest(c, d, 0), 2)) END, 3) AS metres FROM gaps),
near AS (SELECT entity_id, name, metres FROM far WHERE metres <= 5000 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY metres, name) = 1)"""


def areas(s: SparkSession, d: str) -> DataFrame:
    """A square of 16 / 1024 degrees per nation on a grid with gaps."""
    k = F.col("n_nationkey")
    w, t, size = 17.125 + (k % 5) * 24 / 1024, 44.6875 + F.floor(k / 5) * 24 / 1024, 16 / 1024
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(w, t), p(w + size, t), p(w + size, t + size), p(w, t + size), p(w, t))
    return read(s, d, "nation").select(F.concat(F.lit("Čaršija "), "n_name").alias("name"), F.array(F.array(ring)).alias("polygons"))


def pins(s: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    at = lambda start, n: F.when(i % 19 != 0, F.lit(start) + n / 1024)
    return read(s, d, "orders").select(i.alias("entity_id"), at(17.0, 7 * i % 401).alias("longitude"), at(44.625, i % 397).alias("latitude"))


@query("area_containment", f"WITH {AREAS_SQL} SELECT entity_id, name FROM inside", adapter=False)
def _(s, d):
    return geo.covering(pins(s, d), areas(s, d))


@query("area_nearest", f"WITH {AREAS_SQL} SELECT * FROM near", adapter=False)
def _(s, d):
    return geo.nearest(pins(s, d), areas(s, d))


@query("area_assign", f"""WITH {AREAS_SQL}, n AS (SELECT entity_id, CASE WHEN entity_id % 31 < 2 THEN 'Čaršija NATION_' || entity_id % 25 END AS named FROM pins)
   SELECT entity_id, coalesce(named, i.name, near.name, 'old') AS area_key, CASE WHEN named IS NOT NULL THEN 'name' WHEN i.name IS NOT NULL THEN 'inside' WHEN near.name IS NOT NULL THEN 'near' ELSE 'kept' END AS how
   FROM n LEFT JOIN (SELECT entity_id, min(name) AS name FROM inside GROUP BY 1) i USING (entity_id) LEFT JOIN near USING (entity_id)""", adapter=False)
def _(s, d):
    i = F.col("entity_id")
    nation = F.concat(F.lit("NATION_"), (i % 25).cast("string"))
    source = F.when(i % 31 == 0, F.concat(F.lit(" Carsija "), nation)).when(i % 31 == 1, F.concat(F.lit("Čaršija "), nation, F.lit(" "))).when(i % 31 == 2, F.concat(F.lit("čaršija "), nation)).when(i % 31 == 3, " ")
    return geo.assign_area(pins(s, d).withColumns({"source_area": source, "area_key": F.lit("old")}), areas(s, d)).select("entity_id", "area_key", "how")


@query("outline_join", "SELECT 'Čaršija ' || n_name AS name, n AS listings FROM nation LEFT JOIN (SELECT area_key, count(*) AS n FROM entities WHERE deal = 'rent' AND entity_id % 3 = 0 AND area_key < 'NATION_2' GROUP BY 1) ON n_name = area_key")
def _(s, d):
    m = market(s, d).entities.where("deal = 'rent' and entity_id % 3 = 0 and area_key < 'NATION_2'").groupBy(F.concat(F.lit("Čaršija "), "area_key").alias("area_key")).agg(F.count(F.lit(1)).alias("listings"))
    return geo.outline_join(areas(s, d).select("name"), m).select("name", "listings")


@query("outline_features", f"""WITH {AREAS_SQL}, c AS (SELECT name, round(w, 4)::DOUBLE AS w, round(s, 4)::DOUBLE AS s, round(w + 16 / 1024.0, 4)::DOUBLE AS e, round(s + 16 / 1024.0, 4)::DOUBLE AS n FROM boxes WHERE name IN (SELECT name FROM inside))
   SELECT name, '{{"type":"Feature","properties":{{"name":"' || name || '"}},"geometry":{{"type":"MultiPolygon","coordinates":[[[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]]]}}}}' AS feature FROM c""", adapter=False)
def _(s, d):
    """Outlines of the areas that hold pins."""
    held = geo.covering(pins(s, d), areas(s, d)).select("name").distinct()
    return geo.features(areas(s, d).join(held, "name"))


# -- alerts ---------------------------------------------------------------------------------------------------------------


GOOD_RUN = f"status = 'ok' AND started_at > {NOW_SQL} - INTERVAL 26 HOUR"


@query("no_recent_success", f"SELECT 'no_successful_scrape_26h' AS name, count(*) FILTER (WHERE {GOOD_RUN}) = 0 AS failing, count(*) FILTER (WHERE {GOOD_RUN}) AS good_runs FROM runs")
def _(s, d):
    return alerts.no_recent_success(market(s, d).runs, NOW)


@query("alert_conditions", f"""SELECT 'no_successful_scrape_26h' AS name, count(*) FILTER (WHERE {GOOD_RUN}) = 0 AS failing FROM runs
   UNION ALL SELECT 'stale_or_failing_saved_search', count(*) > 0 FROM searches LEFT JOIN (SELECT search_key, max(finished_at) AS l FROM runs WHERE status = 'ok' AND is_complete GROUP BY 1) USING (search_key) WHERE retired_at IS NULL AND (l IS NULL OR l < {NOW_SQL} - INTERVAL 26 HOUR)""")
def _(s, d):
    m = market(s, d)
    return alerts.alert_conditions(m.searches, m.runs, NOW)


@query("stale_searches", f"SELECT search_key, l AS last_success FROM searches LEFT JOIN (SELECT search_key, max(finished_at) AS l FROM runs WHERE status = 'ok' AND is_complete GROUP BY 1) USING (search_key) WHERE retired_at IS NULL AND (l IS NULL OR l < {NOW_SQL} - INTERVAL 48 HOUR)")
def _(s, d):
    m = market(s, d)
    return alerts.stale_searches(m.searches, m.runs, NOW, 48)


@query("alert_transitions", f"""SELECT name, CASE WHEN failing THEN coalesce(first_seen, {NOW_SQL}) END AS first_seen, failing AND (fired OR coalesce(first_seen <= {NOW_SQL} - INTERVAL 10 MINUTE, false)) AS fired,
   CASE WHEN failing AND NOT fired AND coalesce(first_seen <= {NOW_SQL} - INTERVAL 10 MINUTE, false) THEN 'fired' WHEN NOT failing AND fired THEN 'resolved' END AS notice
   FROM (SELECT search_key AS name, substr(search_key, 2)::BIGINT % 3 = 0 AS failing, CASE WHEN substr(search_key, 2)::BIGINT % 2 = 0 THEN TIMESTAMP '2001-07-31 00:00:00' END AS first_seen, substr(search_key, 2)::BIGINT % 4 = 0 AS fired FROM searches)""")
def _(s, d):
    n = F.substring("search_key", 2, 20).cast("long")
    rows = market(s, d).searches
    conditions = rows.select(F.col("search_key").alias("name"), (n % 3 == 0).alias("failing"))
    prior = rows.select(F.col("search_key").alias("name"), F.when(n % 2 == 0, F.lit("2001-07-31 00:00:00").cast("timestamp_ntz")).alias("first_seen"), (n % 4 == 0).alias("fired"))
    return alerts.alert_transitions(conditions, prior, NOW)


@query("health_streak", """SELECT search_key AS stream, run_id AS cycle, streak, streak >= 3 AS unhealthy FROM (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY search_key, bad, g ORDER BY run_id) ELSE 0 END AS streak
   FROM (SELECT *, status = 'error' AS bad, count(*) FILTER (WHERE status <> 'error') OVER (PARTITION BY search_key ORDER BY run_id) AS g FROM runs WHERE status <> 'running'))""")
def _(s, d):
    c = market(s, d).runs.select(F.col("search_key").alias("stream"), F.col("run_id").alias("cycle"), F.when(F.col("status") == "running", 0).otherwise(1).alias("ran"), F.when(F.col("status") == "error", 1).otherwise(0).alias("failed"))
    return alerts.cycle_health(c)


# -- streams: the same figures as in batch, over the same rows -----------------------------------------------------------


def drained(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there into a written table, with its state and offsets beside it in the shared folder."""
    spark = df.sparkSession
    folder = f"{archive.shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out = df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = out.format("parquet").option("path", f"{folder}/rows").start()
    else:  # every batch brings the whole result
        q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


@query("stream_hourly_runs", "SELECT date_trunc('hour', ts) AS hour, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2", adapter=False)
def _(s, d):
    from ..streaming.streams import hourly_runs

    e = read(s, d, "events")
    source = s.readStream.schema(e.schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    out = drained(hourly_runs(source.select(F.col("ts").alias("started_at"), F.col("event_type").alias("status"))), "hourly_runs_out", "complete")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


#: Three snapshots of two searches, as files: (id, search, day), and the items that each holds.
SNAPSHOTS = ((1, "a", date(2001, 7, 30), "entity_id % 2 = 0"), (2, "b", date(2001, 7, 30), "entity_id % 3 = 0"), (3, "a", date(2001, 7, 31), "entity_id % 2 = 0 and entity_id % 10 <> 0"))


@query("stream_snapshots", """WITH e AS (SELECT o_orderkey AS entity_id, o_totalprice AS price, o_orderkey % 2 = 0 AS in_1, o_orderkey % 3 = 0 AS in_2, o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 AS in_3, o_orderkey % 4 = 0 AS cut FROM orders WHERE o_orderkey > 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0))
   SELECT entity_id, concat_ws(',', CASE WHEN in_3 THEN 'a' END, CASE WHEN in_2 THEN 'b' END) AS search_keys, CASE WHEN in_3 AND cut THEN price * 0.5 ELSE price END AS price, CASE WHEN NOT in_3 AND NOT in_2 THEN DATE '2001-07-31' END AS closed_at,
     CASE WHEN in_3 AND cut THEN 2 ELSE 1 END AS markers, CASE WHEN NOT in_3 AND NOT in_2 THEN 1 ELSE 0 END AS events FROM e""", adapter=False)
def _(s, d):
    from ..streaming.streams import CARDS, stream_snapshots

    folder = f"{archive.shared_folder(s)}/snapshots-{uuid.uuid4().hex}"
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_totalprice").alias("price"))
    for n, key, day, which in SNAPSHOTS:
        price = F.when(F.lit(n == 3) & (F.col("entity_id") % 4 == 0), F.col("price") * 0.5).otherwise(F.col("price"))
        rows = o.where(which).withColumns({"snapshot_id": F.lit(n).cast("long"), "search_key": F.lit(key), "day": F.lit(day), "price": price, "deal": F.lit("sale"), "price_state": F.lit("valid"), "sqm": F.lit(50.0)})
        rows = rows.withColumn("snapshot_rows", F.lit(o.where(which).count()).cast("long"))  # its files may come in several batches
        missing = [(c.split()[0], c.split()[1]) for c in CARDS.split(", ") if c.split()[0] not in rows.columns]
        rows.withColumns({c: F.lit(None).cast(t) for c, t in missing}).write.mode("append").parquet(f"{folder}/landing")
    empty = s.createDataFrame([], "entity_id long, title string, deal string, kind string, rooms string, sqm double, price double, rate double, first_seen date, last_seen date, closed_at date, closing_price double, search_keys array<string>")
    stream_snapshots(s, f"{folder}/landing", f"{folder}/store", f"{folder}/checkpoint", empty, buckets=8).awaitTermination()
    count = lambda df, name: df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(name))
    out = archive.read_latest(s, f"{folder}/store", "state")
    out = out.join(count(archive.read_prices(s, f"{folder}/store"), "markers"), "entity_id", "left").join(count(archive.read_deltas(s, f"{folder}/store", "lifecycle"), "events"), "entity_id", "left").na.fill(0, ["markers", "events"])
    return out.select("entity_id", F.array_join("search_keys", ",").alias("search_keys"), "price", "closed_at", "markers", "events")


@query("stream_alerts", """WITH rows_ AS (SELECT 'u' || user_id AS name, ts AS at_, event_type IN ('error', 'click') AS failing FROM events),
   g AS (SELECT *, count(*) FILTER (WHERE NOT failing) OVER (PARTITION BY name ORDER BY at_, failing) AS g FROM rows_),
   runs_ AS (SELECT name, g, min(at_) AS since FROM g WHERE failing GROUP BY 1, 2),
   ends AS (SELECT r.name, since, (SELECT min(at_) FROM g WHERE g.name = r.name AND NOT failing AND g.g = r.g + 1) AS over FROM runs_ r),
   held AS (SELECT *, since + INTERVAL 60 MINUTE AS due FROM ends)
   SELECT name, date_trunc('millisecond', due) AS at, 'fired' AS notice FROM held WHERE due < coalesce(over, (SELECT date_trunc('millisecond', max(at_)) FROM rows_) + INTERVAL 1 MILLISECOND)
   UNION ALL SELECT name, over, 'resolved' FROM held WHERE due < over""", adapter=False)
def _(s, d):
    from ..streaming.streams import stream_alerts

    e = read(s, d, "events")
    source = s.readStream.schema(e.schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    conditions = source.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_type").isin("error", "click").alias("failing"), F.col("ts").cast("timestamp").alias("at"))
    return drained(stream_alerts(conditions, 60), "alerts_drained", "append").withColumn("at", F.col("at").cast("timestamp_ntz"))
