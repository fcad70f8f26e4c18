"""DuckDB SQL of every board group, over the adapter's tables, for the driver's comparison."""

from __future__ import annotations

from datetime import date, datetime

from ..operators.comparables import Manual
from ..operators.filters import Window
from ..sources.facts import market
from .boards import GROUPS, Board
from .market_sql import FURNISHED, LIFT, PARKED, filled, med, q, r, sql

AS_OF, NOW, WINDOW = date(2001, 8, 1), datetime(2001, 8, 1), Window(date(2001, 5, 3), date(2001, 8, 1))
SUBJECT = Manual(sqm=75.0, rooms="2", area_key="NATION_3", kind="building")

TODAY, FROM, TO, PREV = "DATE '2001-08-01'", "DATE '2001-05-03'", "DATE '2001-08-01'", "DATE '2001-02-02'"
#: The zone is two hours ahead on the first covered day.
COVERED = "(SELECT (min(started_at) + INTERVAL 2 HOUR)::DATE FROM runs)"


def board(spark, sf_dir: str) -> Board:
    return Board(market(spark, sf_dir), WINDOW, AS_OF, NOW, subject=SUBJECT)


def win(c: str) -> str:
    return f"({c} > {FROM} AND {c} <= {TO})"


def prev(c: str) -> str:
    return f"({c} > {PREV} AND {c} <= {FROM})"


def cov(x: str) -> str:
    return f"CASE WHEN {PREV} >= {COVERED} THEN {x} END"


def months(a: str, x: str) -> str:
    return r(f"{a} / nullif({x} * 30.0 / nullif({TO} - greatest({FROM}, {COVERED}), 0), 0)", 1)


def pct(n: str, d: str = "count(*)", digits: int = 1) -> str:
    return r(f"100.0 * {n} / nullif({d}, 0)", digits)


def cnt(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def spread_cols(x: str, names=(("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)), digits: int = 0, where: str = "") -> str:
    return ", ".join(f"{med(x, digits, where, at)} AS {n}" for n, at in names)


QUARTILES = (("p25", 0.25), ("median", 0.5), ("p75", 0.75))
LISTED = f"({TODAY} - first_seen)"
MARKED = """peaks AS (SELECT entity_id, max(price) AS peak, count(*) FILTER (WHERE price < was) AS cuts
  FROM (SELECT *, lag(price) OVER (PARTITION BY entity_id ORDER BY on_date) AS was FROM history WHERE price > 0) GROUP BY 1),
marked AS (SELECT e.*, peak, cuts FROM base e LEFT JOIN peaks USING (entity_id))"""
CUTS = """cuts AS (SELECT *, 100.0 * (1 - price / was) AS cut FROM (SELECT *, lag(price) OVER (PARTITION BY entity_id ORDER BY on_date) AS was FROM history) WHERE was > price)"""
OPENING = """opening AS (SELECT x.*, coalesce(arg_min(h.price, h.on_date) FILTER (WHERE h.on_date >= x.opened_on), arg_max(h.price, h.on_date) FILTER (WHERE h.on_date < x.opened_on)) AS opening_price
  FROM gone x JOIN history h ON h.entity_id = x.entity_id AND h.on_date <= x.occurred_on AND h.price > 0 GROUP BY ALL),
paired AS (SELECT *, 100.0 * (price / opening_price - 1) AS change FROM opening WHERE price BETWEEN 0.5 * opening_price AND 2 * opening_price)"""
ITEM = "entity_id, title, url, area_key, rooms, sqm, price"
VIEWS = "CASE WHEN regexp_full_match(views, '[0-9]+') THEN views::DOUBLE END"
RENT_RATE = "CASE WHEN sqm >= 5 AND price >= 50 THEN price / sqm END"
DAY_BIN = "CASE WHEN days_listed >= 180 THEN '180+ d' ELSE (days_listed // 20 * 20) || '–' || (days_listed // 20 * 20 + 19) || ' d' END"


def deal_test(deal: str | None) -> str:
    return "deal <> 'daily_rent'" if deal is None else "deal IN (" + ", ".join(f"'{d}'" for d in deal.split()) + ")"


def base(deal: str | None = None) -> str:
    return f"base AS (SELECT * FROM entities WHERE closed_at IS NULL AND {deal_test(deal)})"


def allx(deal: str | None = None) -> str:
    return f"""allx AS (SELECT entity_id, title, url, deal, kind, area_key, rooms, sqm, price, latitude, longitude, occurred_on, opened_on, occurred_on - opened_on AS days_listed,
      CASE WHEN sqm > 0 AND deal = 'sale' THEN price / sqm END AS final_rate FROM lifecycle WHERE event = 'closed' AND {deal_test(deal)}), gone AS (SELECT * FROM allx WHERE {win('occurred_on')})"""


def new_prev(deal: str | None = None) -> str:
    return f"(SELECT {cov(cnt(prev('first_seen')))} FROM entities WHERE {deal_test(deal)})"


def cut_rows(deal: str | None) -> tuple[str, str]:
    return f"""SELECT entity_id, title, url, area_key, rooms, c.was, c.price AS now, {r('c.cut', 1)} AS cut_pct, c.on_date, {LISTED} AS days_listed
      FROM cuts c JOIN base USING (entity_id) WHERE {win('c.on_date')} ORDER BY c.on_date DESC, cut_pct DESC, entity_id LIMIT 25""", f"{base(deal)}, {CUTS}"


def newest(rows: str, more: str = "") -> str:
    return f"SELECT {ITEM}, {more} first_seen FROM {rows} WHERE {win('first_seen')} ORDER BY first_seen DESC, entity_id DESC LIMIT 50"


def segment(x: str, keys: str, on: str, deal: str) -> tuple[str, str]:
    return f"""SELECT {ITEM}, {r('x', 1)} AS {x}, {r('100.0 * (x / m - 1)', 1)} AS vs_median_pct, first_seen FROM rows JOIN med_ ON {on}
      WHERE n >= 5 AND x <= 0.85 * m ORDER BY vs_median_pct, entity_id LIMIT 25""", f"""{base(deal)},
      rows AS (SELECT *, {'rate' if x == 'rate' else RENT_RATE} AS x FROM base), med_ AS (SELECT {keys}, {q('x')} AS m, count(x) AS n FROM rows WHERE x > 0 GROUP BY ALL)"""


def series(value: str, deal: str, more: str = "") -> tuple[str, str]:
    return f"""SELECT day, {', '.join(f'{med("x", 2, "", at)} AS {n}' for n, at in QUARTILES)}, count(*) AS listings FROM daily GROUP BY day""", f"""
      items AS (SELECT * FROM entities WHERE deal = '{deal}' {more}),
      opened AS (SELECT entity_id, first_seen AS o FROM items UNION ALL SELECT entity_id, occurred_on FROM lifecycle WHERE event = 'reopened' AND deal = '{deal}' {more}),
      cycles AS (SELECT entity_id, o, (SELECT min(occurred_on) FROM lifecycle l WHERE l.entity_id = opened.entity_id AND l.event = 'closed' AND l.occurred_on > o) AS c FROM opened),
      reports AS (SELECT h.* FROM history h SEMI JOIN items USING (entity_id) WHERE price > 0),
      used AS (SELECT entity_id, arg_max(price, on_date) AS price, max(on_date) AS on_date FROM reports WHERE on_date < {FROM} GROUP BY 1
        UNION ALL SELECT entity_id, price, on_date FROM reports WHERE on_date BETWEEN {FROM} AND {TO}
        UNION ALL SELECT entity_id, price, first_seen FROM items WHERE price > 0 AND entity_id NOT IN (SELECT entity_id FROM reports)),
      spans AS (SELECT *, coalesce(lead(on_date) OVER (PARTITION BY entity_id ORDER BY on_date) - 1, {TO}) AS upto FROM used),
      days AS (SELECT entity_id, price, unnest(generate_series(greatest(on_date, {FROM})::TIMESTAMP, least(upto, {TO})::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM spans),
      daily AS (SELECT day, {value} AS x FROM days JOIN items i USING (entity_id) JOIN cycles USING (entity_id) WHERE o <= day AND (c IS NULL OR c > day))"""


def comps(deal: str) -> str:
    digits = "0" if deal == "sale" else "1"
    return f"""pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY status, occurred_on DESC) AS k FROM (
        SELECT entity_id, title, url, 'active' AS status, deal, kind, area_key, rooms, sqm, price, latitude, longitude, {LISTED} AS days_listed, NULL::DATE AS occurred_on FROM entities WHERE closed_at IS NULL
        UNION ALL SELECT entity_id, title, url, 'exited', deal, kind, area_key, rooms, sqm, price, latitude, longitude, occurred_on - opened_on, occurred_on FROM lifecycle WHERE event = 'closed' AND {win('occurred_on')})) WHERE k = 1),
      c AS (SELECT *, {r('price / sqm', int(digits))} AS ppm2, {r("CASE WHEN area_key = 'NATION_3' THEN 1 ELSE 5 END + CASE WHEN rooms = '2' THEN 0 ELSE 1 END + 4 * abs(sqm - 75.0) / 75.0", 6)} AS score
        FROM pool WHERE deal = '{deal}' AND kind = 'building' AND sqm BETWEEN 56.25 AND 93.75 AND price >= {3000 if deal == 'sale' else 50}),
      comps AS (SELECT *, row_number() OVER (ORDER BY score, entity_id) AS rank FROM c QUALIFY rank <= 20)"""


def fair(deal: str) -> tuple[str, str]:
    d = -3 if deal == "sale" else -1
    return f"""SELECT count(*) AS comps, {r(q('ppm2', 0.25) + ' * 75', d)} AS fair_low, {r(q('ppm2') + ' * 75', d)} AS fair_price, {r(q('ppm2', 0.75) + ' * 75', d)} AS fair_high,
      NULL::DOUBLE AS ask_vs_fair_change_pct, {med('days_listed', 0, "status = 'exited'")} AS exit_days FROM comps""", comps(deal)


def comp_rows(deal: str) -> tuple[str, str]:
    return "SELECT title, url, status, area_key, rooms, sqm, price, ppm2, days_listed, NULL::DOUBLE AS distance_km, rank FROM comps", comps(deal)


K = "coalesce({0}, 'unknown') AS {0}"
AREA, ROOMS = K.format("area_key"), K.format("rooms")
BELOW, CUT = "price < peak", "100 * (1 - price / peak)"
SALES = "base WHERE deal = 'sale' AND rate > 0"
RECENT = f"started_at > {FROM}"
IN_TIME = f"started_at BETWEEN {FROM} AND {TO}"
TOOK = "epoch(finished_at - started_at)"
GOOD = "status = 'ok' AND is_complete"
NOW_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
AGE = f"epoch({NOW_SQL} - finished_at)"
SHARE = "{keys}, sum(x)::BIGINT AS exits, (count(*) - sum(x))::BIGINT AS active, " + pct("sum(x)") + " AS exit_ratio"
WEEK = "date_trunc('week', {0})::DATE AS week"


def weekly(a: str, b: str, fill: str = "coalesce({0}, 0) AS {0}") -> str:
    (an, asql), (bn, bsql) = (a, b)
    return f"SELECT week, {fill.format(an)}, {fill.format(bn)} FROM ({asql}) a FULL JOIN ({bsql}) b USING (week)"


BODIES: dict[str, tuple[str, str]] = {
    "buyer_1": fair("sale"), "pro_60": fair("sale"), "renter_1": fair("rent"),
    "buyer_7": comp_rows("sale"), "pro_66": comp_rows("sale"), "renter_7": comp_rows("rent"),
    "buyer_10": (f"SELECT count(*) AS active, {med('price', -2, 'price > 0')} AS median_price, {med('rate', 0, 'rate > 0')} AS median_ppm2, {cnt(win('first_seen'))} AS new_n, {new_prev('sale')} AS new_prev, {pct(cnt(BELOW))} AS cut_share_pct, {med(CUT, 1, BELOW)} AS median_cut_pct FROM marked", f"{base('sale')}, {MARKED}"),
    "buyer_20": (weekly(("new_listings", f"SELECT {WEEK.format('first_seen')}, {med('rate')} AS new_listings FROM entities WHERE deal = 'sale' AND rate > 0 AND first_seen BETWEEN {FROM} AND {TO} GROUP BY 1"), ("final_asks", f"SELECT {WEEK.format('occurred_on')}, {med('price / sqm')} AS final_asks FROM allx WHERE sqm >= 5 AND price >= 3000 AND occurred_on BETWEEN {FROM} AND {TO} GROUP BY 1"), "{0}"), allx("sale")),
    "buyer_21": (weekly(("new_n", f"SELECT {WEEK.format('first_seen')}, count(*) AS new_n FROM entities WHERE deal = 'sale' AND first_seen BETWEEN {FROM} AND {TO} GROUP BY 1"), ("exits", f"SELECT {WEEK.format('occurred_on')}, count(*) AS exits FROM allx WHERE occurred_on BETWEEN {FROM} AND {TO} GROUP BY 1")), allx("sale")),
    "buyer_31": (f"SELECT count(*) AS exits_paired, {pct(cnt('change < 0'))} AS below_first_pct, {med('change', 1)} AS median_final_change_pct FROM paired", f"{allx('sale')}, {OPENING}"),
    "buyer_33": ("SELECT CASE WHEN change <= -15 THEN 'cut 15% or more' WHEN change <= -5 THEN 'cut 5–15%' WHEN change < 0 THEN 'cut under 5%' WHEN change = 0 THEN 'unchanged' ELSE 'raised' END AS change_band, count(*) AS exits FROM paired GROUP BY 1", f"{allx('sale')}, {OPENING}"),
    "buyer_34": (f"SELECT {DAY_BIN} AS days_bracket, count(*) AS listings, min(days_listed) AS starts_at FROM gone WHERE days_listed >= 0 GROUP BY 1", allx("sale")),
    "buyer_40": (f"SELECT area_key, {med('rate')} AS median_ppm2, count(*) AS listings FROM base WHERE rate > 0 AND area_key IS NOT NULL GROUP BY 1", base("sale")),
    "buyer_41": (f"SELECT {AREA}, {cnt("deal = 'sale'")} AS listings, {med('rate', 0, "deal = 'sale' AND rate > 0")} AS median_ppm2, {med('price', -2, "deal = 'sale' AND price > 0")} AS median_price, {med(LISTED, 0, "deal = 'sale'")} AS median_days_listed, {pct(cnt("deal = 'sale' AND " + BELOW), cnt("deal = 'sale'"))} AS cut_share_pct, {r('1200 * ' + q('price', 0.5, "deal = 'rent' AND price > 0") + ' / nullif(' + q('price', 0.5, "deal = 'sale' AND price > 0") + ', 0)', 1)} AS gross_yield_pct FROM marked GROUP BY 1 HAVING {cnt("deal = 'sale'")} > 0", f"{base('sale rent')}, {MARKED}"),
    "buyer_50": segment("rate", "area_key AS ma, rooms AS mr, kind AS mk", "area_key = ma AND rooms IS NOT DISTINCT FROM mr AND kind IS NOT DISTINCT FROM mk", "sale"),
    "buyer_51": cut_rows("sale"),
    "buyer_52": (f"SELECT {ITEM}, rate, {LISTED} AS days_listed, cuts, {r(CUT, 1)} AS cut_pct FROM marked WHERE {LISTED} >= 90 AND {BELOW} ORDER BY days_listed DESC, entity_id LIMIT 25", f"{base('sale')}, {MARKED}"),
    "daily_10": (f"SELECT count(*) AS active, {med('price', 0, 'price > 0')} AS median_night, {cnt(win('first_seen'))} AS new_n, {new_prev('daily_rent')} AS new_prev, {pct(cnt("seller = 'shop'"), 'count(seller)')} AS agency_share_pct, {pct(f'(SELECT count(DISTINCT entity_id) FROM steps WHERE {win("on_date")})')} AS repriced_pct, {pct(f'(SELECT count(DISTINCT entity_id) FROM steps WHERE {prev("on_date")})')} AS repriced_pct_prev FROM base", f"{base('daily_rent')}, steps AS (SELECT entity_id, on_date FROM (SELECT *, lag(price) OVER (PARTITION BY entity_id ORDER BY on_date) AS was FROM history WHERE price > 0) SEMI JOIN base USING (entity_id) WHERE price <> was)"),
    "daily_20": (f"SELECT area_key, {med('price', 0, 'price > 0')} AS median_night, count(*) AS listings FROM base WHERE area_key IS NOT NULL GROUP BY 1", base("daily_rent")),
    "daily_21": (f"SELECT {ROOMS}, {med('price', 0, 'price > 0')} AS median_night, count(*) AS listings FROM base GROUP BY 1", base("daily_rent")),
    "daily_22": (f"SELECT {AREA}, count(*) AS listings, {med('price', 0, 'price > 0', 0.25)} AS p25, {med('price', 0, 'price > 0')} AS median_night, {med('price', 0, 'price > 0', 0.75)} AS p75, {cnt(win('first_seen'))} AS new_n FROM base GROUP BY 1", base("daily_rent")),
    "daily_30": ("SELECT CASE WHEN price < 50 THEN 'under 50 KM' WHEN price < 80 THEN '50–79 KM' WHEN price < 120 THEN '80–119 KM' WHEN price < 200 THEN '120–199 KM' ELSE '200+ KM' END AS price_band, count(*) AS listings, min(price) AS starts_at FROM base WHERE price > 0 GROUP BY 1", base("daily_rent")),
    "daily_31": series("days.price", "daily_rent"),
    "daily_40": (newest("base", "seller,"), base("daily_rent")),
    "daily_41": cut_rows("daily_rent"),
    "exits_1": (f"SELECT {cnt(win('occurred_on'))} AS exits, {cov(cnt(prev('occurred_on')))} AS exits_prev, {med('final_rate', 0, win('occurred_on') + ' AND final_rate > 0')} AS median_exit_ppm2, {cov(med('final_rate', 0, prev('occurred_on') + ' AND final_rate > 0'))} AS median_exit_ppm2_prev, {med('days_listed', 1, win('occurred_on'))} AS median_days_on_market, {cov(med('days_listed', 1, prev('occurred_on')))} AS median_days_on_market_prev, {months('(SELECT count(*) FROM base)', cnt(win('occurred_on')))} AS months_of_inventory FROM allx", f"{base()}, {allx()}"),
    "exits_6": (f"SELECT {WEEK.format('occurred_on')}, count(*) AS listings, {spread_cols('final_rate', QUARTILES)} FROM gone WHERE final_rate > 0 GROUP BY 1", allx()),
    "exits_15": ("SELECT d AS direction, count(*) AS listings, list_position(['lower', 'same', 'higher'], d)::BIGINT AS place FROM (SELECT CASE WHEN price < opening_price THEN 'lower' WHEN price > opening_price THEN 'higher' ELSE 'same' END AS d FROM opening WHERE price IS NOT NULL) GROUP BY 1", f"{allx()}, {OPENING}"),
    "exits_19": (f"SELECT CASE WHEN k < 2 THEN 'under 2k' WHEN k >= 6 THEN '6k+' ELSE k || '–' || (k + 1) || 'k' END AS ppm2_band, {pct('sum(x)')} AS exit_ratio, sum(x)::BIGINT AS exits, (count(*) - sum(x))::BIGINT AS active FROM (SELECT floor(final_rate / 1000)::BIGINT AS k, 1 AS x FROM gone WHERE final_rate > 0 UNION ALL SELECT floor(rate / 1000)::BIGINT, 0 FROM {SALES}) GROUP BY 1", f"{base()}, {allx()}"),
    "exits_18": (f"SELECT days_listed::DOUBLE AS days_listed, {r('change', 4)} AS final_change_pct, title, url, entity_id FROM paired WHERE price IS NOT NULL", f"{allx()}, {OPENING}"),
    "exits_7": (f"SELECT {DAY_BIN} AS days_bracket, count(*) AS listings, min(days_listed) AS starts_at FROM gone WHERE days_listed >= 0 GROUP BY 1", allx()),
    "exits_10": (f"SELECT {ROOMS}, count(*) AS exits, {spread_cols('days_listed')} FROM gone WHERE days_listed >= 0 GROUP BY 1", allx()),
    "exits_12": (f"SELECT latitude, longitude, title, url, price AS closing_price, {r('final_rate', 2)} AS closing_ppm2, days_listed FROM gone WHERE latitude IS NOT NULL AND longitude IS NOT NULL", allx()),
    "exits_20": (f"SELECT {SHARE.format(keys='area_key')} FROM (SELECT area_key, 1 AS x FROM gone UNION ALL SELECT area_key, 0 FROM base) WHERE area_key IS NOT NULL GROUP BY 1", f"{base()}, {allx()}"),
    "exits_9": (f"SELECT l.entity_id, l.title, l.url, l.area_key, l.rooms, l.sqm, opening_price, l.price AS final_asking_price, {r('100.0 * (l.price / opening_price - 1)', 1)} AS final_change_pct, {r('l.final_rate')} AS closing_ppm2, l.opened_on, l.occurred_on, l.days_listed FROM last50 l LEFT JOIN opening o ON l.entity_id = o.entity_id AND l.occurred_on = o.occurred_on AND l.opened_on = o.opened_on", f"{allx()}, last50 AS (SELECT * FROM gone ORDER BY occurred_on DESC, entity_id DESC, opened_on DESC LIMIT 50), {OPENING}"),
    "exits_21": (f"SELECT p.area_key, rooms, sum(x)::BIGINT AS exits, (count(*) - sum(x))::BIGINT AS active, {pct('sum(x)')} AS exit_ratio, rank FROM p JOIN top_ ON p.area_key = top_.area_key GROUP BY p.area_key, rooms, rank HAVING count(*) >= 5", f"{base()}, {allx()}, p AS (SELECT area_key, {ROOMS}, 1 AS x FROM gone WHERE area_key IS NOT NULL UNION ALL SELECT area_key, {ROOMS}, 0 FROM base WHERE area_key IS NOT NULL), top_ AS (SELECT area_key, row_number() OVER (ORDER BY count(*) DESC, area_key) AS rank FROM p GROUP BY 1 QUALIFY rank <= 10)"),
    "health_2": (f"SELECT {cnt("status = 'error' AND " + RECENT)} AS failed_runs, {pct(cnt("status = 'ok' AND " + RECENT), cnt("status IN ('ok', 'error') AND " + RECENT), 0)} AS success_rate, {r(f'epoch({NOW_SQL} - max(finished_at) FILTER (WHERE {GOOD}))')} AS seconds_since_success, coalesce(sum(cards) FILTER (WHERE status = 'ok' AND {RECENT}), 0)::BIGINT AS cards, {cnt("NOT is_complete AND status IN ('ok', 'error') AND finished_at IS NOT NULL AND " + RECENT)} AS incomplete FROM runs", ""),
    "health_1": ("SELECT count(*) AS searches FROM searches WHERE retired_at IS NULL", ""),
    "health_25": (f"SELECT count(*) AS backlog FROM entities WHERE closed_at IS NULL AND (details_at IS NULL OR details_at < {TODAY} - INTERVAL 7 DAY) AND (attempted_at IS NULL OR attempted_at < {TODAY} - INTERVAL 12 HOUR)", ""),
    "health_26": (f"SELECT count(*) AS invalid_latest FROM entities WHERE price_state IN ('invalid', 'conflict') AND last_seen > {FROM}", ""),
    "health_7": (f"SELECT date_trunc('hour', started_at) AS hour, {', '.join(cnt(f"status = '{s}'") + f' AS {s}' for s in ('ok', 'error', 'running'))} FROM runs WHERE {IN_TIME} GROUP BY 1", ""),
    "health_8": (f"SELECT date_trunc('hour', started_at) AS hour, {r('avg(cards)')} AS avg_cards FROM runs WHERE {IN_TIME} GROUP BY 1", ""),
    "health_22": (f"SELECT date_trunc('hour', started_at) AS hour, {r(f'avg({TOOK}) / 60', 1)} AS avg_min, {r(f'max({TOOK}) / 60', 1)} AS max_min FROM runs WHERE finished_at IS NOT NULL AND {IN_TIME} GROUP BY 1", ""),
    "health_14": (f"SELECT {pct(cnt('latitude IS NOT NULL AND longitude IS NOT NULL'), digits=0)} AS pinned_pct, {pct('count(details_on)', digits=0)} AS details_pct, {pct(cnt('rate > 0'), digits=0)} AS priced_pct, {pct('count(source_status)', digits=0)} AS api_status_pct FROM entities WHERE closed_at IS NULL", ""),
    "health_18": (f"SELECT coalesce(source_status, '(not exposed)') AS source_says, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'closed' END AS we_say, count(*) AS listings FROM entities WHERE last_seen > {FROM} GROUP BY 1, 2", ""),
    "health_28": (f"SELECT s.name, s.search_key, CASE WHEN status = 'error' THEN 'failed' WHEN status = 'running' THEN 'running' WHEN {AGE} > 93600 THEN 'stale' ELSE coalesce(status, 'never') END AS phase, {r(f'{AGE} / 60')} AS age_min, started_at, finished_at, error, url FROM searches s LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY search_key ORDER BY run_id DESC) = 1) x ON s.search_key = x.search_key WHERE retired_at IS NULL", ""),
    "health_19": (f"SELECT name, count(*) AS runs, {r(f'avg({TOOK})')} AS avg_s, {r(f'max({TOOK})')} AS max_s FROM runs JOIN searches USING (search_key) WHERE finished_at IS NOT NULL AND {IN_TIME} GROUP BY 1", ""),
    "health_21": (f"SELECT left(regexp_replace(coalesce(error, '(no message)'), '[0-9]+', '#', 'g'), 120) AS failure_pattern, count(*) AS runs, max(started_at) AS last_seen FROM runs WHERE status = 'error' AND {RECENT} GROUP BY 1", ""),
    "health_12": ("SELECT run_id, search_key, status, pages, cards, started_at, finished_at, error FROM runs ORDER BY run_id DESC LIMIT 50", ""),
    "home_2": (f"SELECT a AS active, {r('s')} AS median_sale_ppm2, {r('m')} AS median_rent, {r('1200 * m / nullif(p, 0)', 1)} AS gross_yield_pct, {months('a', 'x')} AS months_of_inventory, {r('nw')} AS new_sale_ppm2, {cov(r('np'))} AS new_sale_ppm2_prev FROM (SELECT {cnt('closed_at IS NULL')} AS a, {q('rate', 0.5, "closed_at IS NULL AND deal = 'sale' AND rate > 0")} AS s, {q('price', 0.5, "closed_at IS NULL AND deal = 'rent' AND price > 0")} AS m, {q('price', 0.5, "closed_at IS NULL AND deal = 'sale' AND price > 0")} AS p, {cnt(win('closed_at'))} AS x, {q('rate', 0.5, "deal = 'sale' AND rate > 0 AND " + win('first_seen'))} AS nw, {q('rate', 0.5, "deal = 'sale' AND rate > 0 AND " + prev('first_seen'))} AS np FROM entities)", ""),
    "home_13": (f"SELECT day, coalesce(sum(n), 0)::BIGINT AS new_n, coalesce(sum(c), 0)::BIGINT AS closed_n FROM (SELECT unnest(generate_series({FROM}::TIMESTAMP, {TO}::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) LEFT JOIN (SELECT first_seen AS day, 1 AS n, 0 AS c FROM entities UNION ALL SELECT closed_at, 0, 1 FROM entities WHERE closed_at IS NOT NULL) USING (day) GROUP BY 1", ""),
    "home_9": (f"SELECT {r(f'epoch({NOW_SQL} - max(finished_at) FILTER (WHERE {GOOD})) / 60')} AS minutes_since_success FROM runs", ""),
    "overview_1": (f"SELECT count(*) AS active, (SELECT {cnt(win('first_seen'))} FROM entities WHERE {deal_test(None)}) AS new_n, {new_prev()} AS new_prev, {med('rate', 0, "deal = 'sale' AND rate > 0")} AS median_sale_ppm2, {med('price', 0, "deal = 'rent' AND price > 0")} AS median_rent, {months('count(*)', '(SELECT count(*) FROM gone)')} AS months_of_inventory FROM base", f"{base()}, {allx()}"),
    "overview_3": (f"SELECT count(DISTINCT entity_id) FILTER (WHERE {win('on_date')}) AS drops, {cov(f'count(DISTINCT entity_id) FILTER (WHERE {prev("on_date")})')} AS drops_prev, {pct('count(DISTINCT entity_id)', '(SELECT count(*) FROM base)', 0)} AS cut_share_pct, {med('100.0 * (was - price) / was', 1, win('on_date'))} AS median_cut_pct FROM cuts SEMI JOIN base USING (entity_id)", f"{base()}, {CUTS}"),
    "overview_7": series("days.price / i.sqm", "sale", "AND sqm > 0"),
    "overview_21": (f"SELECT {ROOMS}, count(*) AS listings, {spread_cols('rate')} FROM {SALES} GROUP BY 1", base()),
    "overview_29": (f"SELECT CASE WHEN floor_num IS NULL THEN 'unknown' WHEN floor_num < 0 THEN 'basement' WHEN floor_num = 0 THEN 'ground' WHEN floor_num <= 2 THEN '1–2' WHEN floor_num <= 5 THEN '3–5' ELSE '6+' END AS floor_band, count(*) AS listings, {spread_cols('rate')} FROM {SALES} GROUP BY 1", base()),
    "overview_26": (f"SELECT sqm AS area, rate AS ppm2, area_key, title, url FROM {SALES} AND sqm > 0", base()),
    "overview_33": (f"SELECT area_key, {ROOMS}, rank, count(*) AS listings, {med('rate')} AS median_ppm2 FROM base JOIN (SELECT area_key, row_number() OVER (ORDER BY count(*) DESC, area_key) AS rank FROM {SALES} AND area_key IS NOT NULL GROUP BY 1 QUALIFY rank <= 10) USING (area_key) WHERE deal = 'sale' AND rate > 0 GROUP BY ALL HAVING count(*) >= 3", base()),
    "overview_35": (weekly(("new_n", f"SELECT {WEEK.format('first_seen')}, count(*) AS new_n FROM entities WHERE {deal_test(None)} AND {win('first_seen')} GROUP BY 1"), ("closed_n", f"SELECT {WEEK.format('occurred_on')}, count(*) AS closed_n FROM gone GROUP BY 1")), allx()),
    "overview_8": (f"SELECT {ROOMS}, count(*) AS listings FROM base WHERE deal = 'sale' GROUP BY 1", base()),
    "overview_32": (f"SELECT {AREA}, count(*) AS listings, {spread_cols('rate')} FROM {SALES} GROUP BY 1 ORDER BY listings DESC, 1 LIMIT 15", base()),
    "overview_22": (f"SELECT kind AS segment, count(*) AS listings, {med('rate', 0, 'rate > 0')} AS median_ppm2 FROM base WHERE deal = 'sale' AND kind IS NOT NULL GROUP BY 1", base()),
    "overview_30": (f"SELECT {K.format('seller')}, count(*) AS listings, {med('rate', 0, 'rate > 0')} AS median_ppm2 FROM base WHERE deal = 'sale' GROUP BY 1", base()),
    "overview_13": ("SELECT latitude, longitude, title, url, area_key, rooms, sqm, price, CASE WHEN deal = 'sale' THEN rate END AS ppm2, last_seen FROM base WHERE latitude IS NOT NULL AND longitude IS NOT NULL", base()),
    "overview_16": (f"SELECT {ITEM}, rate, {r('100 * (rate / m - 1)')} AS vs_median_pct FROM base JOIN (SELECT area_key, {q('rate')} AS m FROM {SALES} AND area_key IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) USING (area_key) WHERE deal = 'sale' AND rate > 0 AND sqm >= 20 ORDER BY {r('rate / m', 6)}, entity_id LIMIT 25", base()),
    "overview_17": cut_rows(None),
    "overview_11": (f"SELECT {ITEM}, rate, {LISTED} AS days_listed, last_seen FROM base ORDER BY first_seen, entity_id LIMIT 25", base()),
    "overview_23": (f"SELECT {ITEM}, v AS views, {r(f'v / greatest({LISTED}, 1)', 1)} AS views_per_day FROM (SELECT *, {VIEWS} AS v FROM base) WHERE v IS NOT NULL ORDER BY views_per_day DESC, v DESC, entity_id LIMIT 25", base()),
    "pro_1": (f"SELECT count(*) AS active, {cnt(win('first_seen'))} AS new_n, {new_prev()} AS new_prev, (SELECT count(*) FROM gone) AS exits, (SELECT {cov(cnt(prev('occurred_on')))} FROM allx) AS exits_prev, {months('count(*)', '(SELECT count(*) FROM gone)')} AS months_of_inventory, (SELECT {med('days_listed')} FROM gone) AS median_days_on_market, {pct(cnt(BELOW))} AS cut_share_pct, {med(CUT, 1, BELOW)} AS median_cut_pct, {med(VIEWS)} AS median_views FROM marked", f"{base()}, {MARKED}, {allx()}"),
    "pro_10": (f"SELECT area_key, {months('active', 'x')} AS months_of_inventory, active, coalesce(x, 0) AS exits FROM (SELECT area_key, count(*) AS active FROM base WHERE area_key IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT area_key, count(*) AS x FROM gone GROUP BY 1) USING (area_key)", f"{base()}, {allx()}"),
    "pro_11": (f"SELECT area_key, active, new_n, coalesce(x, 0) AS exits, {months('active', 'x')} AS months_of_inventory, median_ppm2, median_rent, d AS median_days_on_market, median_views, cut_share_pct FROM (SELECT {AREA}, count(*) AS active, {cnt(win('first_seen'))} AS new_n, {med('rate', 0, "deal = 'sale' AND rate > 0")} AS median_ppm2, {med('price', 0, "deal = 'rent' AND price >= 50")} AS median_rent, {med(VIEWS)} AS median_views, {pct(cnt(BELOW))} AS cut_share_pct FROM marked GROUP BY 1) LEFT JOIN (SELECT {AREA}, count(*) AS x, {med('days_listed')} AS d FROM gone GROUP BY 1) USING (area_key)", f"{base()}, {MARKED}, {allx()}"),
    "pro_20": (f"SELECT CASE WHEN gap < -5 THEN 'below segment' WHEN gap <= 5 THEN 'within ±5%' WHEN gap <= 15 THEN '5–15% above' ELSE 'over 15% above' END AS pricing_band, {med('days_listed')} AS median_days, count(*) AS exits, {pct(cnt('change < 0'))} AS cut_first_pct FROM (SELECT *, 100.0 * (opening_price / sqm / m - 1) AS gap FROM paired JOIN (SELECT area_key AS ma, rooms AS mr, deal AS md, {q('price / sqm')} AS m, count(*) AS n FROM base WHERE sqm >= 5 AND price > 0 GROUP BY ALL) ON area_key = ma AND rooms IS NOT DISTINCT FROM mr AND deal = md WHERE n >= 5 AND sqm >= 5) GROUP BY 1", f"{base()}, {allx()}, {OPENING}"),
    "pro_21": (f"SELECT days_listed::DOUBLE AS days_listed, {r('change', 4)} AS final_change_pct, title, url, area_key FROM paired", f"{allx()}, {OPENING}"),
    "pro_30": (f"SELECT {K.format('seller')}, count(*) AS listings FROM base GROUP BY 1", base()),
    "pro_31": (f"SELECT area_key, active, agency_share_pct, private_share_pct, agency_median_days, private_median_days FROM (SELECT {AREA}, count(*) AS active, {pct(cnt("seller = 'shop'"))} AS agency_share_pct, {pct(cnt("seller = 'private'"))} AS private_share_pct FROM base GROUP BY 1) LEFT JOIN (SELECT coalesce(g.area_key, 'unknown') AS area_key, {med('days_listed', 0, "seller = 'shop'")} AS agency_median_days, {med('days_listed', 0, "seller = 'private'")} AS private_median_days FROM gone g JOIN entities e USING (entity_id) GROUP BY 1) USING (area_key)", f"{base()}, {allx()}"),
    "pro_40": (f"SELECT {ITEM}, rate, {LISTED} AS days_listed, cuts, {r(CUT, 1)} AS cut_pct, {VIEWS} AS views FROM marked WHERE seller = 'private' AND ({LISTED} >= 60 OR cuts >= 2) ORDER BY cuts DESC NULLS FIRST, days_listed DESC, entity_id LIMIT 50", f"{base()}, {MARKED}"),
    "pro_41": (newest("(SELECT * FROM base WHERE seller = 'private')", "rate,"), base()),
    "pro_50": (f"SELECT {AREA}, {ROOMS}, {cnt("deal = 'sale'")} AS sale_listings, {cnt("deal = 'rent' AND price >= 50")} AS rent_listings, {med('price', -2, "deal = 'sale' AND price >= 3000")} AS median_sale_price, {med('price', 0, "deal = 'rent' AND price >= 50")} AS median_rent, {r('1200 * ' + q('price', 0.5, "deal = 'rent' AND price >= 50") + ' / nullif(' + q('price', 0.5, "deal = 'sale' AND price >= 3000") + ', 0)', 1)} AS gross_yield_pct FROM base WHERE price > 0 GROUP BY 1, 2 HAVING {cnt("deal = 'sale'")} >= 3 AND {cnt("deal = 'rent' AND price >= 50")} >= 3", base("sale rent")),
    "renter_10": (f"SELECT count(*) AS active, {med('price', 0, 'price >= 50')} AS median_rent, {med(RENT_RATE, 1)} AS median_rent_ppm2, {cnt(win('first_seen'))} AS new_n, {new_prev('rent')} AS new_prev, (SELECT {med('days_listed')} FROM gone) AS median_days_to_exit FROM base", f"{base('rent')}, {allx('rent')}"),
    "renter_20": (f"SELECT area_key, {med('price')} AS median_rent, count(*) AS listings FROM base WHERE price >= 50 AND area_key IS NOT NULL GROUP BY 1", base("rent")),
    "renter_21": (f"SELECT {ROOMS}, {med('price')} AS median_rent, count(*) AS listings FROM base WHERE price >= 50 GROUP BY 1", base("rent")),
    "renter_22": (f"SELECT area_key, listings, median_rent, median_rent_ppm2, new_n, d AS median_days_to_exit FROM (SELECT {AREA}, count(*) AS listings, {med('price', 0, 'price >= 50')} AS median_rent, {med(RENT_RATE, 1)} AS median_rent_ppm2, {cnt(win('first_seen'))} AS new_n FROM base GROUP BY 1) LEFT JOIN (SELECT {AREA}, {med('days_listed')} AS d FROM gone GROUP BY 1) USING (area_key)", f"{base('rent')}, {allx('rent')}"),
    "renter_30": (f"SELECT amenity, {cnt('y')} AS with_n, {med('price', 0, 'y')} AS median_with, {cnt('n')} AS without_n, {med('price', 0, 'n')} AS median_without, {r('100.0 * (' + q('price', 0.5, 'y') + ' / nullif(' + q('price', 0.5, 'n') + ', 0) - 1)', 1)} AS difference_pct FROM (SELECT amenity, price, coalesce(lower(v) IN ('true', '1', 'da', 'yes'), false) AS y, coalesce(lower(v) IN ('false', '0', 'ne', 'no'), false) AS n FROM (SELECT price, unnest(['Furnished', 'Pets allowed', 'Bills included', 'Parking', 'Air conditioning', 'Lift', 'Balcony', 'Suitable for students']) AS amenity, unnest([{FURNISHED}, NULL, NULL, {PARKED}, {filled('klima')}, {LIFT}, {filled('balkon')}, NULL]) AS v FROM base WHERE price >= 50)) GROUP BY 1", base("rent")),
    "renter_40": (f"SELECT {DAY_BIN} AS days_bracket, count(*) AS listings, min(days_listed) AS starts_at FROM gone WHERE days_listed >= 0 GROUP BY 1", allx("rent")),
    "renter_41": (f"SELECT {ROOMS}, {pct('sum(x)')} AS exit_ratio FROM (SELECT rooms, 1 AS x FROM gone UNION ALL SELECT rooms, 0 FROM base) GROUP BY 1", f"{base('rent')}, {allx('rent')}"),
    "renter_50": (newest("base", f"{r(RENT_RATE, 1)} AS rent_ppm2,"), base("rent")),
    "renter_51": segment("rent_ppm2", "area_key AS ma, rooms AS mr", "area_key = ma AND rooms IS NOT DISTINCT FROM mr", "rent"),
    "renter_52": cut_rows("rent"),
}

QUERIES = {f"board_{name}": (lambda s, d, g=g: g(board(s, d))) for name, g in GROUPS.items()}
SQL = {f"board_{name}": sql(body, more) for name, (body, more) in BODIES.items()}
