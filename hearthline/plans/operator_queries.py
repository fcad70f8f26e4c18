"""One query per operator that no board shows on its own, over the adapter's market, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregates as A
from ..operators import filters as B
from ..operators import histories as H
from ..sources.facts import market, read
from .board_sql import AREA, FROM, OPENING, TO, WINDOW, allx, board, cnt, prev, r, win
from .market_sql import CONTROLS, reading
from .market_sql import sql as with_market

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, more: str = ""):
    def put(f):
        QUERIES[name] = f
        if body:
            SQL[name] = with_market(body, more) if "entities" in body + more or "history" in body + more or "lifecycle" in body + more or "runs" in body + more or "base" in body else body
        return f

    return put


# -- filters --------------------------------------------------------------------------------------------------------


@query("filter_multi", f"SELECT kind, count(*) AS n FROM entities WHERE kind IN ('building', 'furniture') GROUP BY 1")
def _(s, d):
    return B.where_multi(market(s, d).entities, "kind", ["building", "furniture"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("filter_category_unknown", "SELECT coalesce(rooms, 'unknown') AS rooms, count(*) AS n FROM entities WHERE coalesce(rooms, 'unknown') IN ('unknown', '2') GROUP BY 1")
def _(s, d):
    return B.where_category(market(s, d).entities, "rooms", ["unknown", "2"]).groupBy(X.known("rooms").alias("rooms")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_bounds", "SELECT count(*) AS n, min(sqm) AS least, max(sqm) AS most FROM entities WHERE sqm >= 40 AND sqm <= 90.5")
def _(s, d):
    return B.where_bounds(market(s, d).entities, "sqm", 40, 90.5).agg(F.count(F.lit(1)).alias("n"), F.min("sqm").alias("least"), F.max("sqm").alias("most"))


@query("filter_deal", "SELECT 'All' AS choice, count(*) AS n FROM entities WHERE deal <> 'daily_rent' UNION ALL SELECT 'sell', count(*) FROM entities WHERE deal = 'sale'")
def _(s, d):
    e = market(s, d).entities
    of = lambda c: B.where_deal(e, c).agg(F.lit(c).alias("choice"), F.count(F.lit(1)).alias("n"))
    return of("All").unionByName(of("sell"))


@query("filter_property_select", f"SELECT deal, count(*) AS n FROM entities WHERE {CONTROLS['elevator']} = 'Yes' AND {CONTROLS['parking']} IN ('No', 'Unknown') AND {CONTROLS['furnished']} IN ('Namješten', 'Unknown') GROUP BY 1")
def _(s, d):
    chosen = {"elevator": ["Yes"], "parking": ["No", "Unknown"], "heating": "All", "furnished": ["Namješten", "Unknown"], "rooms": []}
    return B.property_filters(market(s, d).entities, chosen).groupBy("deal").agg(F.count(F.lit(1)).alias("n"))


@query("filter_property_range", f"SELECT count(*) AS n, min(price) AS least FROM entities WHERE year_built >= 1960 AND year_built <= 2010 AND {CONTROLS['views']} >= 100 AND {CONTROLS['price_bam']} <= 200000 AND {CONTROLS['ppm2_bam']} >= 500 AND {CONTROLS['unit_levels']} <= 1")
def _(s, d):
    chosen = {"year_built_min": 1960, "year_built_max": 2010, "views_min": "100", "price_bam_max": 200000, "ppm2_bam_min": 500, "unit_levels_max": 1, "sqm_min": ""}
    return B.property_filters(market(s, d).entities, chosen).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("least"))


@query("filter_folded_search", "SELECT count(*) AS n FROM entities WHERE contains(lower(ch['adresa']), 'customer#00000001') OR (contains(ch['ime-i-broj-licence-agenta'], '4') AND contains(ch['broj-posrednickog-ugovora'], '4_%'))")
def _(s, d):
    e = market(s, d).entities
    a, b = {"address": " SETALISTE dJure customer#00000001"}, {"agent_license": "dzemal", "agency_contract": "4_%"}
    both = B.property_filters(e, a).select("entity_id").unionByName(B.property_filters(B.property_filters(e, b), {"agent_license": "4"}).select("entity_id"))
    return both.distinct().agg(F.count(F.lit(1)).alias("n"))


def valued(name: str) -> str:
    """A control's value as the text that the comparison counts."""
    return f"coalesce(round(({CONTROLS[name]})::DOUBLE, 3)::VARCHAR, '-')" if name in B.RANGES else f"coalesce({CONTROLS[name]}, '-')"


def number_text(value):
    """A number's text to three places, rounded and written as the comparison does: by a product, and with an exponent from
    1e16 only."""
    v = F.round(value.cast("double") * 1000) / 1000
    long = F.regexp_replace(v.cast("decimal(20,3)").cast("string"), "0{1,2}$", "")
    return F.when(F.abs(v) < 1e7, v.cast("string")).when(F.abs(v) < 1e16, long).otherwise(F.regexp_replace(v.cast("string"), r"(\.0)?E", "e+"))


for kind, names in {"selects": tuple(B.SELECTS), "ranges": tuple(B.RANGES), "amenities": tuple(B.AMENITIES), "searches": ("agent_license", "agency_contract")}.items():

    @query(f"control_{kind}", "SELECT control, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS control, {valued(c)} AS value FROM entities" for c in names) + ") GROUP BY 1, 2")
    def _(s, d, names=names, of=number_text if kind == "ranges" else lambda value: value):
        return B.control_counts(market(s, d).entities, names, lambda value: F.coalesce(of(value), F.lit("-")))


@query("control_money", f"SELECT entity_id, {CONTROLS['price_bam']} AS price_bam, round({CONTROLS['ppm2_bam']}, 3) AS ppm2_bam, {CONTROLS['address']} AS address FROM entities")
def _(s, d):
    return market(s, d).entities.select("entity_id", B.control("price_bam").alias("price_bam"), F.round(B.control("ppm2_bam"), 3).alias("ppm2_bam"), B.control("address").alias("address"))


@query("cross_filter_null_aware", "SELECT coalesce(seller, '-') AS seller, count(*) AS n FROM entities WHERE (seller IN ('shop') OR seller IS NULL) AND price >= 50000 AND NOT (coalesce(rooms IN ('1'), false)) AND title LIKE 'item 1%' GROUP BY 1")
def _(s, d):
    tests = [("seller", "IN", ["shop", None]), ("price", ">=", 50000), ("rooms", "NOT IN", ["1", "none"]), ("title", "LIKE", "item 1%")]
    e = market(s, d).entities.withColumn("rooms", X.known("rooms"))
    return B.cross_filter(e, tests).groupBy(F.coalesce("seller", F.lit("-")).alias("seller")).agg(F.count(F.lit(1)).alias("n"))


@query("consistent_population", "SELECT 'entities' AS population, count(*) AS n FROM entities WHERE area_key = 'NATION_3' UNION ALL SELECT 'exits', count(*) FROM lifecycle WHERE event = 'closed' AND area_key = 'NATION_3'")
def _(s, d):
    m = market(s, d)
    both = B.filter_populations({"entities": m.entities, "exits": B.exits(m.lifecycle)}, [("area_key", "=", "NATION_3"), ("floor_num", ">", 3)])
    of = lambda k: both[k].agg(F.lit(k).alias("population"), F.count(F.lit(1)).alias("n"))
    return of("entities").unionByName(of("exits"))


@query("event_property_join", f"SELECT event, count(*) AS n FROM lifecycle WHERE {CONTROLS['elevator']} = 'Yes' AND rooms IN ('1', '2') AND price >= 60000 AND price / sqm <= 5000 GROUP BY 1")
def _(s, d):
    m = market(s, d)
    chosen = {"elevator": ["Yes"], "rooms": ["1", "2"], "price_bam_min": 60000, "ppm2_bam_max": 5000, "heating": "All"}
    return B.event_property(m.lifecycle, m.entities, chosen).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("option_lists", "SELECT DISTINCT control, value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS control, {CONTROLS[c]} AS value FROM entities" for c in (*B.SELECTS, *B.AMENITIES)) + ")")
def _(s, d):
    return B.option_lists(market(s, d).entities)


@query("option_natural_order", "SELECT v AS value, row_number() OVER (ORDER BY v = 'unknown', try_cast(regexp_extract(v, '^(\\d+)', 1) AS BIGINT) NULLS LAST, v) AS place FROM (SELECT DISTINCT coalesce(floor_num::VARCHAR, 'unknown') AS v FROM entities)")
def _(s, d):
    from pyspark.sql import Window

    v = market(s, d).entities.select(F.coalesce(F.col("floor_num").cast("string"), F.lit("unknown")).alias("value")).distinct()
    return v.withColumn("place", F.row_number().over(Window.orderBy(*B.option_order())))  # as many rows as options


@query("listing_reference", "SELECT entity_id, entity_id AS from_link, entity_id AS from_number, NULL::BIGINT AS other_host, CASE WHEN entity_id % 2 = 0 THEN entity_id END AS strict FROM entities")
def _(s, d):
    e, i = market(s, d).entities, F.col("entity_id").cast("string")
    on_site = F.concat(F.lit("HTTPS://www.olx.ba/artikal/"), i, F.lit("/stan-centar?x=1"))
    other = F.element_at(F.array(F.concat(F.lit("https://evil.example/artikal/"), i), F.concat(F.lit("olx.ba/artikal/"), i), F.concat(i, F.lit(" OR 1=1"))), (F.col("entity_id") % 3 + 1).cast("int"))
    strict = B.listing_reference(F.when(F.col("entity_id") % 2 == 0, on_site).otherwise(" "), strict=True)
    return e.select("entity_id", B.listing_reference("url").alias("from_link"), B.listing_reference(F.concat(F.lit(" "), i)).alias("from_number"), B.listing_reference(other).alias("other_host"), strict.alias("strict"))


@query("search_rows", "SELECT count(*) AS n FROM (SELECT entity_id, title, area_key FROM entities) WHERE contains(lower(title), 'nation_1') OR contains(lower(area_key), 'nation_1')")
def _(s, d):
    return B.search_rows(market(s, d).entities.select("entity_id", "title", "area_key"), "Nation_1").agg(F.count(F.lit(1)).alias("n"))


@query("sorted_rows", "SELECT floor_num, row_number() OVER (ORDER BY floor_num DESC NULLS LAST) AS place FROM (SELECT DISTINCT floor_num FROM entities)")
def _(s, d):
    from pyspark.sql import Window

    rows = B.sort_rows(market(s, d).entities.select("floor_num").distinct(), "floor_num", True)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("floor_num"))))


URLS = """u AS (SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'cities=' || page_id % 7 || '&page=3&category_id=' || page_id % 5 || '&b=2&a=1&b=1' || CASE WHEN page_id % 3 = 0 THEN '#x?y=1' ELSE '' END AS url FROM pages),
cut AS (SELECT page_id, split_part(regexp_replace(url, '#.*$', ''), '?', 1) AS front, regexp_extract(regexp_replace(url, '#.*$', ''), '[?](.*)$', 1) AS query FROM u),
ps AS (SELECT page_id, i, split_part(x, '=', 1) AS n, x FROM (SELECT page_id, unnest(string_split(query, '&')) AS x, generate_subscripts(string_split(query, '&'), 1) AS i FROM cut)),
keys AS (SELECT cut.page_id, coalesce(nullif(regexp_replace(front, '^[a-z]+://[^/]*', ''), ''), '/') || '?' || k AS url_key FROM cut JOIN (SELECT page_id,
  string_agg(x, '&' ORDER BY CASE n WHEN 'category_id' THEN 0 WHEN 'canton' THEN 1 WHEN 'cities' THEN 2 ELSE 10 END, n, i) AS k FROM ps WHERE n NOT IN ('page', 'olx_scrape') GROUP BY 1) USING (page_id))"""


def urls(s, d):
    i, url = F.col("page_id"), F.regexp_replace("url", "#.*$", "")
    more = F.concat(F.lit("cities="), (i % 7).cast("string"), F.lit("&page=3&category_id="), (i % 5).cast("string"), F.lit("&b=2&a=1&b=1"), F.when(i % 3 == 0, "#x?y=1").otherwise(""))
    return read(s, d, "pages").select("page_id", F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), more).alias("url"))


@query("canonical_url_key", f"WITH {URLS} SELECT page_id, url_key FROM keys")
def _(s, d):
    return urls(s, d).select("page_id", X.canonical_url("url").alias("url_key"))


@query("first_per_url", f"WITH {URLS} SELECT url_key, min(page_id) AS page_id FROM keys GROUP BY 1")
def _(s, d):
    keyed = urls(s, d).withColumn("url_key", X.canonical_url("url"))
    return H.first_per_key(keyed, ["url_key"], [F.col("page_id")]).select("url_key", "page_id")


@query("window_vs_previous", f"SELECT {cnt(win('first_seen'))} AS new_n, {cnt(prev('first_seen'))} AS new_prev, {r('100.0 * (' + cnt(win('first_seen')) + ' - ' + cnt(prev('first_seen')) + ') / nullif(' + cnt(prev('first_seen')) + ', 0)', 1)} AS change_pct FROM entities")
def _(s, d):
    n = market(s, d).entities.agg(X.count_if(WINDOW.holds("first_seen")).alias("new_n"), X.count_if(WINDOW.previous.holds("first_seen")).alias("new_prev"))
    return n.withColumn("change_pct", A.period_change(F.col("new_n"), F.col("new_prev")))


# -- histories --------------------------------------------------------------------------------------------------------


@query("price_changes", "SELECT entity_id, on_date, price, lag(price) OVER (PARTITION BY entity_id ORDER BY on_date) AS was FROM history")
def _(s, d):
    return H.price_changes(market(s, d).reports).select("entity_id", "on_date", "price", "was")


@query("price_spans", "SELECT entity_id, on_date, price, lead(on_date) OVER (PARTITION BY entity_id ORDER BY on_date) AS next_date FROM history")
def _(s, d):
    return H.price_spans(market(s, d).reports).select("entity_id", "on_date", "price", "next_date")


@query("peak_and_cuts", "SELECT e.entity_id, max(h.price) AS peak, CASE WHEN count(h.price) > 0 THEN count(*) FILTER (WHERE h.price < was) END AS cuts FROM entities e LEFT JOIN (SELECT *, lag(price) OVER (PARTITION BY entity_id ORDER BY on_date) AS was FROM history) h USING (entity_id) GROUP BY 1")
def _(s, d):
    m = market(s, d)
    return H.mark_peak(m.entities, m.reports).select("entity_id", "peak", "cuts")


for how in ("inner", "left"):

    @query(f"opening_ask_{how}", f"SELECT g.entity_id, g.occurred_on, o.opening_price FROM gone g {'JOIN' if how == 'inner' else 'LEFT JOIN'} opening o ON g.entity_id = o.entity_id AND g.occurred_on = o.occurred_on AND g.opened_on = o.opened_on", f"{allx()}, {OPENING}")
    def _(s, d, how=how):
        b = board(s, d)
        return H.opening_ask(b.exits(), b.facts.reports, how).select("entity_id", "occurred_on", "opening_price")


@query("last_before_window", f"SELECT entity_id, arg_max(price, on_date) AS price, max(on_date) AS on_date FROM history WHERE price > 0 AND on_date < {FROM} GROUP BY 1")
def _(s, d):
    return H.last_before(market(s, d).reports, WINDOW.start)


@query("next_close", "SELECT entity_id, o AS opened_on, (SELECT min(occurred_on) FROM lifecycle l WHERE l.entity_id = x.entity_id AND event = 'closed' AND occurred_on > o) AS closed_on FROM (SELECT entity_id, first_seen AS o FROM entities UNION ALL SELECT entity_id, occurred_on FROM lifecycle WHERE event = 'reopened') x")
def _(s, d):
    m = market(s, d)
    opened = m.entities.select("entity_id", F.col("first_seen").alias("opened_on")).unionByName(m.lifecycle.where("event = 'reopened'").select("entity_id", F.col("occurred_on").alias("opened_on")))
    return H.next_close(opened, m.lifecycle.where("event = 'closed'"))


@query("spans_to_days", f"SELECT day, count(*) AS n FROM (SELECT unnest(generate_series(greatest(on_date, {FROM})::TIMESTAMP, least(coalesce(nxt - 1, {TO}), {TO})::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM (SELECT *, lead(on_date) OVER (PARTITION BY entity_id ORDER BY on_date) AS nxt FROM history)) GROUP BY 1")
def _(s, d):
    days = H.spans_to_days(H.price_spans(market(s, d).reports), WINDOW.start, WINDOW.end)
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("days_in_cycle", f"""SELECT day, count(*) AS n, sum(price::DECIMAL(20,2))::DOUBLE AS price FROM (SELECT entity_id, price, unnest(generate_series(greatest(on_date, {FROM})::TIMESTAMP, least(coalesce(nxt - 1, {TO}), {TO})::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM (SELECT *, lead(on_date) OVER (PARTITION BY entity_id ORDER BY on_date) AS nxt FROM history))
   JOIN (SELECT entity_id, o, (SELECT min(occurred_on) FROM lifecycle l WHERE l.entity_id = x.entity_id AND event = 'closed' AND occurred_on > o) AS c FROM (SELECT entity_id, first_seen AS o FROM entities UNION ALL SELECT entity_id, occurred_on FROM lifecycle WHERE event = 'reopened') x) USING (entity_id)
   WHERE o < day + 1 AND (c IS NULL OR c >= day + 1) GROUP BY 1""")
def _(s, d):
    m = market(s, d)
    opened = m.entities.select("entity_id", F.col("first_seen").alias("opened_on")).unionByName(m.lifecycle.where("event = 'reopened'").select("entity_id", F.col("occurred_on").alias("opened_on")))
    days = H.days_in_cycle(H.price_spans(m.reports.select("entity_id", "on_date", "price")), H.next_close(opened, m.lifecycle.where("event = 'closed'")), WINDOW.start, WINDOW.end)
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(20,2)")).cast("double").alias("price"))


@query("without_history", "SELECT entity_id FROM entities ANTI JOIN history USING (entity_id)")
def _(s, d):
    m = market(s, d)
    return H.without_history(m.entities.select("entity_id"), m.reports)


@query("has_marker", "SELECT entity_id, coalesce((SELECT max(on_date) FROM history h WHERE h.entity_id = e.entity_id) > details_on, false) AS has_marker FROM entities e")
def _(s, d):
    m = market(s, d)
    return H.has_marker(m.entities.select("entity_id", "details_on"), m.reports, "details_on").select("entity_id", "has_marker")


@query("first_per_key", "SELECT area_key, arg_min(entity_id, (first_seen, entity_id)) AS entity_id FROM entities WHERE area_key IS NOT NULL GROUP BY 1")
def _(s, d):
    rows = market(s, d).entities.where("area_key is not null")
    return H.first_per_key(rows, ["area_key"], [F.col("first_seen"), F.col("entity_id")]).select("area_key", "entity_id")


@query("dedupe_last_wins", "SELECT l_orderkey AS entity_id, arg_max(l_extendedprice, p) AS price, min(p) AS place FROM (SELECT l_orderkey, l_extendedprice, l_linenumber * 1000000.0 + l_extendedprice AS p FROM lineitem) GROUP BY 1")
def _(s, d):
    rows = read(s, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_extendedprice").alias("price"), (F.col("l_linenumber") * 1000000.0 + F.col("l_extendedprice")).alias("place"))
    return H.last_wins(rows, ["entity_id"], "place").select("entity_id", "price", "place")


@query("latest_run_per_search", "SELECT s.search_key, x.run_id, x.status FROM searches s LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY search_key ORDER BY run_id DESC) = 1) x ON s.search_key = x.search_key")
def _(s, d):
    m = market(s, d)
    return H.latest_per_key(m.searches, m.runs, "search_key", "run_id").select("search_key", "run_id", "status")


@query("rank_groups_top10", "SELECT area_key, row_number() OVER (ORDER BY count(*) DESC, area_key) AS rank FROM entities WHERE area_key IS NOT NULL GROUP BY 1 QUALIFY rank <= 10")
def _(s, d):
    return H.rank_groups(market(s, d).entities.where("area_key is not null"), "area_key")


@query("fold_tail", "SELECT CASE WHEN k <= 5 THEN area_key ELSE 'Other' END AS area_key, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, area_key) AS k FROM (SELECT coalesce(area_key, 'unknown') AS area_key, count(*) AS n FROM entities GROUP BY 1)) GROUP BY 1")
def _(s, d):
    g = market(s, d).entities.groupBy(X.known("area_key").alias("area_key")).agg(F.count(F.lit(1)).alias("n"))
    return A.fold_tail(g, "area_key", "n")


@query("quantile_breaks", "SELECT DISTINCT v AS break FROM (SELECT price AS v, row_number() OVER (ORDER BY price) - 1 AS i, count(*) OVER () AS n FROM entities WHERE price > 0) WHERE i IN (floor(0.2 * n), floor(0.4 * n), floor(0.6 * n), floor(0.8 * n))")
def _(s, d):
    return A.quantile_breaks(market(s, d).entities, "price")


@query("unpivot_flags", "SELECT label, coalesce(value, '-') AS value, count(*) AS n FROM (SELECT unnest(['lift', 'parking']) AS label, unnest([ch['lift'], ch['parking']]) AS value FROM entities) GROUP BY ALL")
def _(s, d):
    e = market(s, d).entities
    long = A.unpivot(e, ["entity_id"], {k: F.element_at("characteristics", k) for k in ("lift", "parking")})
    return long.groupBy("label", F.coalesce("value", F.lit("-")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("thin_groups_removed", f"SELECT {AREA}, coalesce(rooms, 'unknown') AS rooms, count(*) AS listings FROM entities WHERE kind = 'building' AND deal = 'rent' GROUP BY 1, 2 HAVING count(*) >= 5")
def _(s, d):
    g = market(s, d).entities.where("kind = 'building' and deal = 'rent'").groupBy(X.known("area_key").alias("area_key"), X.known("rooms").alias("rooms")).agg(F.count(F.lit(1)).alias("listings"))
    return A.having_min_n(g, 5)


@query("int_median", "SELECT area_key, round(CAST(quantile_cont(rate, 0.5) AS DECIMAL(20,6)))::BIGINT AS median_rate FROM entities WHERE rate IS NOT NULL AND area_key IS NOT NULL GROUP BY 1")
def _(s, d):
    return market(s, d).entities.where("rate is not null and area_key is not null").groupBy("area_key").agg(A.int_median("rate").alias("median_rate"))


@query("nulls_ordering", "SELECT entity_id, floor_num, row_number() OVER (ORDER BY floor_num NULLS LAST, entity_id) AS place FROM (SELECT * FROM entities WHERE closed_at IS NULL ORDER BY first_seen, entity_id LIMIT 40)")
def _(s, d):
    from pyspark.sql import Window

    few = B.active(market(s, d).entities).orderBy("first_seen", "entity_id").limit(40)
    return few.select("entity_id", "floor_num", F.row_number().over(Window.orderBy(F.asc_nulls_last("floor_num"), "entity_id")).alias("place"))


# -- texts to values ----------------------------------------------------------------------------------------------------

#: The adapter's prices as the texts that pages show, in both conventions.
TEXTS = """texts AS (SELECT o_orderkey AS entity_id, c AS cents, b AS whole, CASE o_orderkey % 6
    WHEN 0 THEN replace(replace(replace(format('{:,}', b), ',', '.') || ',' || lpad(c::VARCHAR, 2, '0'), ' ', ''), 'x', '') || ' KM'
    WHEN 1 THEN format('{:,}', b) || '.' || lpad(c::VARCHAR, 2, '0') WHEN 2 THEN replace(format('{:,}', b), ',', '.') || ' KM'
    WHEN 3 THEN b::VARCHAR WHEN 4 THEN 'po dogovoru' ELSE 'x' || b END AS shown
  FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS b, (o_orderkey % 100)::BIGINT AS c FROM orders))"""


def texts(s, d):
    o = read(s, d, "orders")
    b, c = F.floor("o_totalprice"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    grouped, i = F.format_number(b, 0), F.col("o_orderkey") % 6
    dots = F.replace(grouped, F.lit(","), F.lit("."))
    shown = F.when(i == 0, F.concat(dots, F.lit(","), c, F.lit(" KM"))).when(i == 1, F.concat(grouped, F.lit("."), c)).when(i == 2, F.concat(dots, F.lit(" KM"))).when(i == 3, b.cast("string")).when(i == 4, "po dogovoru").otherwise(F.concat(F.lit("x"), b.cast("string")))
    return o.select(F.col("o_orderkey").alias("entity_id"), shown.alias("shown"), "o_orderpriority", b.alias("whole"))


#: What the texts say.
VALUE = "CASE entity_id % 6 WHEN 0 THEN whole + cents / 100.0 WHEN 1 THEN whole + cents / 100.0 WHEN 2 THEN whole WHEN 3 THEN whole END::DOUBLE"


@query("norm_number", f"WITH {TEXTS} SELECT entity_id, shown, {VALUE} AS value FROM texts")
def _(s, d):
    return texts(s, d).select("entity_id", "shown", X.locale_number("shown", integer_like=True).alias("value"))


@query("norm_price", """SELECT entity_id, CASE WHEN reason IS NULL THEN 'valid' WHEN reason IN ('zero', 'not_priced', 'missing') THEN 'unpriced' ELSE 'invalid' END AS state, reason, CASE WHEN reason IS NULL THEN v END AS price FROM (
  SELECT *, CASE WHEN t = '' OR t IS NULL THEN 'missing' WHEN t = 'Na upit' THEN 'not_priced' WHEN v IS NULL THEN 'not_numeric' WHEN v = 0 THEN 'zero' WHEN v < 0 THEN 'negative'
    WHEN v < CASE WHEN deal = 'rent' THEN 50 WHEN deal = 'daily_rent' THEN 10 WHEN kind = 'garages' THEN 1000 WHEN kind = 'prefab' THEN 500 ELSE 3000 END THEN 'below_' || CASE WHEN deal IN ('rent', 'daily_rent') THEN deal ELSE 'sale' END || '_minimum' END AS reason
  FROM (SELECT o_orderkey AS entity_id, (['sale', 'rent', 'daily_rent', NULL])[o_orderkey % 4 + 1] AS deal, (['garages', 'prefab', 'land', NULL])[o_orderkey // 4 % 4 + 1] AS kind,
    CASE o_orderkey % 13 WHEN 0 THEN 'Na upit' WHEN 1 THEN 'x' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE (o_orderkey % 4001 - 20)::VARCHAR END AS t, CASE WHEN o_orderkey % 13 > 3 THEN o_orderkey % 4001 - 20 END::DOUBLE AS v FROM orders))""")
def _(s, d):
    i = F.col("o_orderkey")
    pick = lambda k, *names: F.get(F.array(*(F.lit(n).cast("string") for n in names)), k.cast("int"))
    t = F.when(i % 13 == 0, "Na upit").when(i % 13 == 1, "x").when(i % 13 == 2, "").when(i % 13 > 3, (i % 4001 - 20).cast("string"))
    p = X.norm_price(t, pick(i % 4, "sale", "rent", "daily_rent", None), pick(F.floor(i / 4) % 4, "garages", "prefab", "land", None))
    return read(s, d, "orders").select(i.alias("entity_id"), p.alias("p")).select("entity_id", "p.state", "p.reason", "p.price")


@query("norm_area", "SELECT o_orderkey AS entity_id, CASE WHEN v BETWEEN 5 AND 999999 THEN v END AS area FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 900 * 1000 + 500 WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderkey % 1000 / 10.0 END::DOUBLE AS v FROM orders)")
def _(s, d):
    i = F.col("o_orderkey")
    text = F.when(i % 7 == 0, F.concat((i % 900).cast("string"), F.lit(".500"))).when(i % 7 == 1, F.concat(i.cast("string"), F.lit(" m²"))).otherwise(F.format_string("%d,%d", F.floor(i % 1000 / 10), i % 10))
    return read(s, d, "orders").select(i.alias("entity_id"), X.norm_area(text).alias("area"))


@query("norm_id", "SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey > 0 THEN o_orderkey END AS id FROM orders")
def _(s, d):
    i = F.col("o_orderkey")
    text = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(F.lit("-"), i.cast("string"))).when(i % 4 == 2, F.concat(i.cast("string"), F.lit(".5"))).otherwise("99999999999999999")
    return read(s, d, "orders").select(i.alias("entity_id"), X.norm_id(text).alias("id"))


WORDS = ("Izdavanje, prodaja", "Prodaja stana", "sell", "Potražnja", "Kupovina", "Iznajmljivanje", "")


@query("deal_type", """SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 31 = 0 THEN 'daily_rent' WHEN regexp_matches(w, '(rent|iznajm|najam|izdavanje)') THEN 'rent' WHEN regexp_matches(w, '(sell|sale|prodaj|kup)') THEN 'sale' END AS deal
  FROM (SELECT o_orderkey, lower((['Izdavanje, prodaja', 'Prodaja stana', 'sell', 'Potražnja', 'Kupovina', 'Iznajmljivanje', ''])[o_orderkey % 7 + 1]) AS w FROM orders)""")
def _(s, d):
    i = F.col("o_orderkey")
    word = F.get(F.array(*(F.lit(x) for x in WORDS)), (i % 7).cast("int"))
    return read(s, d, "orders").select(i.alias("entity_id"), X.deal_for(F.when(i % 31 == 0, "2668").otherwise("23"), X.deal_type(word)).alias("deal"))


@query("property_type", "SELECT c_custkey, CASE c_custkey WHEN 23 THEN 'apartments' WHEN 2668 THEN 'daily_rent' WHEN 24 THEN 'houses' WHEN 29 THEN 'land' WHEN 25 THEN 'commercial' WHEN 26 THEN 'vacation_homes' WHEN 30 THEN 'garages' WHEN 1193 THEN 'prefab' WHEN 2672 THEN 'warehouses' WHEN 28 THEN 'rooms' WHEN 0 THEN NULL ELSE 'other' END AS kind FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", X.property_type(F.col("c_custkey").cast("string")).alias("kind"))


PRICES, SHOWN, CODES = ("600", "600 €", "600 BAM", "na upit"), (None, "600 KM", "1.200 km", "600 $", "KMX"), (None, "EUR", "km", "RSD", "12", "", "€")


def listed(words) -> str:
    return "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in words) + "]"


@query("currency_of", f"""WITH c AS (SELECT o_orderkey AS entity_id, ({listed(PRICES)})[o_orderkey % 4 + 1] AS p, ({listed(SHOWN)})[o_orderkey // 4 % 5 + 1] AS s, ({listed(CODES)})[o_orderkey // 20 % 7 + 1] AS f FROM orders),
m AS (SELECT entity_id, f, list_transform(list_filter([upper(trim(f))], lambda x: f IS NOT NULL AND f <> ''), lambda x: CASE x WHEN 'KM' THEN 'BAM' WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' ELSE x END) AS g,
  list_transform(list_concat(regexp_extract_all(upper(p), '\\b(KM|BAM|EUR|USD)\\b|[€$]', 0), coalesce(regexp_extract_all(upper(s), '\\b(KM|BAM|EUR|USD)\\b|[€$]', 0), [])), lambda x: CASE x WHEN 'KM' THEN 'BAM' WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' ELSE x END) AS t FROM c)
SELECT entity_id, CASE WHEN len(list_filter(g, lambda x: NOT regexp_full_match(x, '[A-Z]{{3}}'))) > 0 THEN 'unknown' WHEN len(list_distinct(list_concat(g, t))) > 1 THEN 'conflict' ELSE list_concat(g, t)[1] END AS currency FROM m""")
def _(s, d):
    i = F.col("o_orderkey")
    pick = lambda k, words: F.get(F.array(*(F.lit(w).cast("string") for w in words)), k.cast("int"))
    return read(s, d, "orders").select(i.alias("entity_id"), X.currency_of(pick(i % 4, PRICES), pick(F.floor(i / 4) % 5, SHOWN), pick(F.floor(i / 20) % 7, CODES)).alias("currency"))


KIND_LIST = ("apartments", "houses", "land", "commercial", "vacation_homes", "garages", "prefab", "warehouses", "rooms", "other", None)
TITLES = ("", "Prodaja stana", "Najam kuce", "Poslovni prostor za izdavanje")


@query("read_price", f"""WITH {reading(f"SELECT o_orderkey AS id, (o_orderkey % 4000 - 3)::DOUBLE AS v, NULL AS m, ({listed(KIND_LIST)})[o_orderkey % 11 + 1] AS kind, (['sale', 'rent', 'daily_rent', NULL, 'sale'])[o_orderkey // 11 % 5 + 1] AS deal, o_orderkey // 55 % 2 = 1 AS declared, ({listed(TITLES)})[o_orderkey // 7 % 4 + 1] AS title, CASE o_orderkey // 3 % 3 WHEN 1 THEN 4.0 WHEN 2 THEN 60.0 END AS area FROM orders")}
  SELECT id AS entity_id, price, state, reason, deal, basis FROM reading""")
def _(s, d):
    i = F.col("o_orderkey")
    pick = lambda k, words: F.get(F.array(*(F.lit(w).cast("string") for w in words)), k.cast("int"))
    over = lambda n: F.floor(i / n)
    area = F.when(over(3) % 3 == 1, 4.0).when(over(3) % 3 == 2, 60.0)
    p = X.read_price((i % 4000 - 3).cast("double"), pick(over(11) % 5, ("sale", "rent", "daily_rent", None, "sale")), pick(i % 11, KIND_LIST), area, pick(over(7) % 4, TITLES), over(55) % 2 == 1, is_text=F.lit(False))
    return read(s, d, "orders").select(i.alias("entity_id"), p.alias("p")).select("entity_id", "p.price", "p.state", "p.reason", "p.deal", "p.basis")


@query("rooms_from", "SELECT o_orderkey AS entity_id, CASE o_orderkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '3' WHEN 2 THEN '4+' WHEN 5 THEN '12' END AS rooms FROM orders")
def _(s, d):
    words = F.get(F.array(*(F.lit(x) for x in ("Lijepa Garsonjera", "Trosoban (3)", "4+", "nepoznato", "3 sobe", " 12 "))), (F.col("o_orderkey") % 6).cast("int"))
    return read(s, d, "orders").select(F.col("o_orderkey").alias("entity_id"), X.rooms_from(words).alias("rooms"))


@query("small_values", "SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 230 - 10 BETWEEN -5 AND 200 THEN (o_orderkey % 230 - 10)::INTEGER END AS floor_num, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS furnished, CASE o_orderkey % 3 WHEN 0 THEN 'abc' END AS heating, CASE o_orderkey % 4 WHEN 0 THEN TIMESTAMP '2025-07-18 21:43:56' END AS at FROM orders")
def _(s, d):
    i = F.col("o_orderkey")
    pick = lambda k, *words: F.get(F.array(*(F.lit(w) for w in words)), k.cast("int"))
    at = X.norm_unix_seconds(pick(i % 4, "1752875036", "1752875036000", "1752875036.5", "soon")).cast("timestamp_ntz")
    return read(s, d, "orders").select(i.alias("entity_id"), X.small_int((i % 230 - 10).cast("string"), -5, 200).alias("floor_num"), X.furnished_text(pick(i % 5, "Namješten", "nenamjesten", "da", "polunamješten", "?")).alias("furnished"), X.text_max(pick(i % 3, " abc ", " ", "x" * 61), 60).alias("heating"), at.alias("at"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
