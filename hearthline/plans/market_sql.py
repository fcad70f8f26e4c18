"""The adapter of sources.facts once more, as a DuckDB prefix for the comparison SQL."""

from __future__ import annotations

ENTITIES = """
entities AS (
  SELECT i AS entity_id, 'item ' || i AS title, 'https://olx.ba/artikal/' || i AS url, deal, kind, area_key, rooms, sqm, price,
         CASE WHEN rr BETWEEN 1 AND 15000 THEN rr END AS rate, latitude, longitude, seller, floor_num, views, favorites, flat_furnished, flat_heating, flat_garage, flat_bathrooms, currency, elevator, parking, condition, year_built, ch,
         price_state, first_seen, closed_at, CASE WHEN closed_at IS NOT NULL THEN price END AS closing_price, details_on, details_on::TIMESTAMP + INTERVAL 12 HOUR AS details_at, CASE WHEN i % 5 = 0 THEN TIMESTAMP '2001-08-01' - to_minutes(i % 1500) END AS attempted_at,
         CASE WHEN closed_at IS NOT NULL THEN closed_at - 1 ELSE first_seen + (i % 300)::INTEGER END AS last_seen, source_status, search_key
  FROM (SELECT *, CASE WHEN deal = 'sale' AND sqm >= 5 THEN round(CAST(price / sqm AS DECIMAL(20,6)), 0)::DOUBLE END AS rr FROM (
    SELECT o_orderkey AS i, lower(c_mktsegment) AS kind, o_totalprice AS price, o_orderdate::DATE AS first_seen,
      CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'rent' WHEN o_orderpriority = '5-LOW' THEN 'daily_rent' ELSE 'sale' END AS deal,
      CASE WHEN o_orderkey % 23 <> 0 THEN n_name END AS area_key, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 5)::VARCHAR END AS rooms,
      CASE WHEN o_orderkey % 29 <> 0 THEN (20 + o_orderkey % 180)::DOUBLE END AS sqm,
      CASE WHEN o_orderkey % 19 <> 0 THEN 44.70::DOUBLE + (o_orderkey % 97) / 1000 END AS latitude,
      CASE WHEN o_orderkey % 19 <> 0 THEN 17.10::DOUBLE + (7 * o_orderkey % 101) / 1000 END AS longitude,
      CASE o_custkey % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'private' END AS seller,
      CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 9 - 1)::INTEGER END AS floor_num,
      CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 500)::VARCHAR END AS views,
      CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 90)::VARCHAR END AS favorites, (['true','false',NULL])[o_orderkey % 3 + 1] AS flat_furnished, (['Drugo','Plin',NULL,'z',NULL,NULL])[o_orderkey % 6 + 1] AS flat_heating,
      (['true','false',NULL,NULL])[o_orderkey % 4 + 1] AS flat_garage, (['1','2',NULL,NULL,'x'])[o_orderkey % 5 + 1] AS flat_bathrooms,
      CASE o_orderkey % 12 WHEN 0 THEN 'EUR' WHEN 6 THEN 'unknown' ELSE 'BAM' END AS currency, CASE o_orderkey % 8 WHEN 0 THEN true WHEN 1 THEN false END AS elevator, CASE o_orderkey % 9 WHEN 0 THEN true WHEN 1 THEN false END AS parking,
      CASE o_orderkey % 10 WHEN 0 THEN 'Renovirana' WHEN 1 THEN 'Novogradnja' END AS condition, CASE WHEN o_orderkey % 5 > 0 THEN (1950 + o_orderkey % 75)::INTEGER END AS year_built,
      {'lift': (['true','false','',NULL])[o_orderkey % 4 + 1], 'parking': (['da','ne','1',NULL,'x'])[o_orderkey % 5 + 1], 'balkon': (['Yes','no','maybe','TRUE','',NULL])[o_orderkey % 6 + 1],
       'opremljenost': (['Namješten','',NULL,'true','Polunamješten',NULL,'false'])[o_orderkey % 7 + 1], 'namjestena': (['Da',NULL,NULL,'ne',NULL])[o_orderkey % 5 + 1], 'grijanje': (['Drugo','Struja',NULL])[o_orderkey % 3 + 1],
       'stanje': (['Renovirana','Novogradnja',NULL,'A'])[o_orderkey % 4 + 1], 'sprat': CASE WHEN o_orderkey % 13 = 0 THEN '7' END, 'gara-a': (['Da','0',NULL])[o_orderkey % 3 + 1], 'broj-kupatil': (['3',NULL,'1.5'])[o_orderkey % 3 + 1],
       'ukupno-spratova': (o_orderkey % 12)::VARCHAR, 'broj-etaza': (['1','2','tri'])[o_orderkey % 3 + 1], 'okucnica-kvadratura': (o_orderkey % 900)::VARCHAR, 'primarna-orjentacija': (['Jug','Sjever','',NULL])[o_orderkey % 4 + 1],
       'vrsta-poda': (['Parket','Laminat','k'])[o_orderkey % 3 + 1], 'kvadratura-balkona': (['4','5.5','5,5',NULL])[o_orderkey % 4 + 1], 'uknjizeno-zk': (['Da','ne',NULL])[o_orderkey % 3 + 1], 'ostava-spajz': (['1','0','',NULL])[o_orderkey % 4 + 1],
       'telefonski-priklju-ak': (['da',NULL,'ne',NULL,'?'])[o_orderkey % 5 + 1], 'klima': (['true','false',NULL,'da'])[o_orderkey % 4 + 1], 'adresa': 'Šetalište Đure ' || c_name,
       'ime-i-broj-licence-agenta': 'Džemal ' || o_orderkey % 50, 'broj-posrednickog-ugovora': (o_orderkey % 70) || '_%'} AS ch,
      (['valid','valid','invalid','valid','conflict','valid',NULL,'valid','valid'])[o_orderkey % 9 + 1] AS price_state,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + (1 + o_orderkey % 200)::INTEGER END AS closed_at,
      CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE + (o_orderkey % 40)::INTEGER END AS details_on,
      CASE WHEN o_orderkey % 8 <> 0 THEN (['active','finished'])[o_orderkey % 2 + 1] END AS source_status,
      's' || (o_custkey % 50) AS search_key
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)))
"""

HISTORY = """
history AS (SELECT l_orderkey AS entity_id, l_shipdate::DATE AS on_date, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
"""

LIFECYCLE = """
closed_ones AS (SELECT *, entity_id % 7 = 0 AND entity_id % 200 > 5 AS twice FROM entities WHERE closed_at IS NOT NULL),
lifecycle AS (
  SELECT *, 'closed' AS event, closed_at AS occurred_on, CASE WHEN twice THEN first_seen + 5 ELSE first_seen END AS opened_on FROM closed_ones
  UNION ALL SELECT *, 'closed', first_seen + 3, first_seen FROM closed_ones WHERE twice
  UNION ALL SELECT *, 'reopened', first_seen + 5, NULL FROM closed_ones WHERE twice)
"""

RUNS = """
runs AS (
  SELECT event_id AS run_id, 'u' || user_id AS search_key, ts - to_days((8218 + CASE WHEN event_id % 1000 = 0 THEN 300 ELSE 0 END)::INTEGER) AS started_at,
    CASE WHEN event_type <> 'signup' THEN date_trunc('second', ts - to_days((8218 + CASE WHEN event_id % 1000 = 0 THEN 300 ELSE 0 END)::INTEGER)) + to_seconds((30 + event_id % 600)::INTEGER) END AS finished_at,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'running' ELSE 'ok' END AS status,
    event_type <> 'error' AND event_id % 10 <> 0 AS is_complete, floor(value)::INTEGER AS cards, (1 + event_id % 30)::INTEGER AS pages,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || (500 + event_id % 4) || ' after ' || props END AS error
  FROM events),
searches AS (
  SELECT search_key, 'search ' || search_key AS name, 'https://olx.ba/pretraga?s=' || search_key AS url, CASE WHEN substr(search_key, 2)::BIGINT % 10 = 0 THEN TIMESTAMP '2001-07-17 00:00:00' END AS retired_at
  FROM (SELECT DISTINCT search_key FROM runs))
"""



def filled(*codes: str) -> str:
    """The first attribute of these codes that is not empty; codes that the adapter lacks are null anyway."""
    have = [f"nullif(ch['{c}'], '')" for c in codes if f"'{c}':" in ENTITIES]
    return f"coalesce({', '.join([*have, 'NULL'])})"


def flag(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('true', '1', 'da', 'yes') THEN 'Yes' WHEN lower({x}) IN ('false', '0', 'ne', 'no') THEN 'No' ELSE 'Unknown' END"


def texted(x: str) -> str:
    return f"coalesce(CASE WHEN NOT regexp_full_match({x}, '[A-Za-z]|') THEN {x} END, 'Unknown')"


def numbered(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '-?[0-9]+([.][0-9]+)?') THEN ({x})::DOUBLE END"


def respelled(x: str, **pairs: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {x} END"


LIFT, FURNISHED = f"coalesce(elevator::VARCHAR, {filled('lift')})", f"coalesce({filled('opremljenost', 'namjesten', 'namjestena')}, flat_furnished)"
PARKED = f"coalesce(parking::VARCHAR, {filled('parking')})"
#: Every control of the source's filters, as it is defined there.
CONTROLS = {
    "deal": texted("deal"), "property_type": texted("kind"), "neighborhood": texted("area_key"), "rooms": texted("rooms"), "seller_type": texted("seller"),
    "price_bam": "CASE WHEN currency = 'BAM' THEN price END", "ppm2_bam": "CASE WHEN currency = 'BAM' THEN price / nullif(sqm, 0) END", "sqm": "sqm",
    "floor_num": texted(f"coalesce(floor_num::VARCHAR, {filled('sprat')})"), "year_built": "year_built", "elevator": flag(LIFT),
    "heating": texted(respelled(f"coalesce(flat_heating, {filled('vrsta-grijanja', 'grijanje')})", Drugo="Ostalo")), "condition": texted(respelled(f"coalesce(condition, {filled('stanje')})", Renovirana="Renoviran")),
    "parking": flag(PARKED), "furnished": texted(respelled(FURNISHED, true="Namješten", false="Nenamješten")), "garage": flag(f"coalesce(flat_garage, {filled('gara-a', 'garaza')})"),
    "bathrooms": numbered(f"coalesce(flat_bathrooms, {filled('broj-kupatila', 'broj-kupatil')})"), "floors_total": numbered(filled("broj-spratova", "ukupno-spratova")), "unit_levels": numbered(filled("broj-etaza")),
    "plot_sqm": numbered(filled("okucnica-kvadratura")), "orientation": texted(filled("primarna-orjentacija")), "flooring": texted(filled("vrsta-poda")), "balcony_sqm": numbered(filled("kvadratura-balkona")),
    "views": numbered("views"), "favorites": numbered("favorites"), "balcony": flag(filled("balkon")), "air_conditioning": flag(filled("klima")), "registered": flag(filled("uknjizeno-zk")),
    "telephone": flag(filled("telefonski-priklju-ak", "telefonski-prikljucak")), "storage": flag(filled("ostava-pajz", "ostava-spajz")),
    **{name: "'Unknown'" for name in ("electricity", "water", "sewerage", "gas", "internet", "cable_tv", "security_door", "video_surveillance", "basement_attic", "alarm", "students", "bills_included", "pets", "pool", "new_build", "recently_renovated")},
    "address": f"replace(replace(replace(replace(replace(lower({filled('adresa')}), 'đ', 'dj'), 'č', 'c'), 'ć', 'c'), 'ž', 'z'), 'š', 's')",
    "agent_license": f"replace(lower({filled('ime-i-broj-licence-agenta')}), 'ž', 'z')", "agency_contract": f"lower({filled('broj-posrednickog-ugovora')})",
}

ALL = ",".join((ENTITIES, HISTORY, LIFECYCLE, RUNS))


def sql(body: str, more: str = "") -> str:
    """A query over the adapter's tables; `more` holds further common tables."""
    return f"WITH {ALL}{', ' + more if more else ''} {body}"


def r(x: str, digits: int = 0) -> str:
    return f"round(CAST({x} AS DECIMAL(20,6)), {digits})::DOUBLE"


def q(x: str, at: float = 0.5, where: str = "") -> str:
    return f"quantile_cont(({x})::DOUBLE, {at})" + (f" FILTER (WHERE {where})" if where else "")


def med(x: str, digits: int = 0, where: str = "", at: float = 0.5) -> str:
    return r(q(x, at, where), digits)


def reading(given: str) -> str:
    """Common tables that end in `reading`: what a price means, as the source's rules have it. given: SQL of rows (id, v:
    the number, m: a reason why there is no price, kind, deal, declared, title, area)."""
    least = "CASE {0} WHEN 'rent' THEN 50 WHEN 'daily_rent' THEN 10 ELSE CASE kind WHEN 'garages' THEN 1000 WHEN 'prefab' THEN 500 ELSE 3000 END END"
    why = "CASE WHEN m IS NOT NULL THEN m WHEN v IS NULL THEN 'not_numeric' WHEN v = 0 THEN 'zero' WHEN v < 0 THEN 'negative' WHEN v < " + least + " THEN 'below_' || {0} || '_minimum' END"
    return f"""given AS ({given}), judged AS (SELECT *, CASE WHEN deal IN ('rent', 'daily_rent') THEN deal ELSE 'sale' END AS j FROM given),
paths AS (SELECT *, CASE WHEN kind = 'vacation_homes' AND v > 0 AND v < 300 AND NOT (declared AND j = 'sale') THEN 'night'
    WHEN coalesce({why.format('j')}, '') <> 'below_sale_minimum' OR kind IS NULL OR kind NOT IN ('land', 'apartments', 'houses', 'commercial', 'garages', 'rooms', 'vacation_homes', 'warehouses') THEN 'posted'
    WHEN NOT declared AND regexp_matches(title, '(iznajm|izmajm|izdaj|izdavanj|\\bnajam|\\bzakup|podstanar)', 'i') THEN 'rent'
    WHEN kind = 'land' AND v <= 500 OR kind IN ('apartments', 'houses') AND v >= CASE WHEN declared OR title ILIKE '%prodaj%' THEN 300 ELSE 1000 END THEN 'per_sqm'
    WHEN declared THEN 'posted' ELSE 'rent' END AS path FROM judged),
read_as AS (SELECT *, CASE path WHEN 'night' THEN 'daily_rent' WHEN 'rent' THEN 'rent' ELSE j END AS as_deal FROM paths),
reasons AS (SELECT *, CASE WHEN path <> 'per_sqm' THEN {why.format('as_deal')} WHEN v <= 0 THEN 'not_numeric' WHEN area IS NULL OR area < 5 THEN 'per_sqm_without_area' END AS reason FROM read_as),
reading AS (SELECT id, CASE WHEN reason IS NULL THEN CASE WHEN path = 'per_sqm' THEN floor(v * area + 0.5) ELSE v END END::DOUBLE AS price, CASE WHEN reason IS NULL THEN 'valid' WHEN reason IN ('missing', 'zero', 'not_priced') THEN 'unpriced' ELSE 'invalid' END AS state,
  reason, CASE path WHEN 'night' THEN 'daily_rent' WHEN 'rent' THEN 'rent' WHEN 'per_sqm' THEN 'sale' ELSE deal END AS deal, CASE path WHEN 'per_sqm' THEN 'per_sqm' ELSE 'total' END AS basis FROM reasons)"""
