"""Case tables of the normalisation rules."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from hearthline.functions import expr as X
from hearthline.operators import filters
from hearthline.plans import normalize
from hearthline.sources import payloads


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_numbers(spark):
    cases = [
        ("1.234,50", True, 1234.5), ("1,234.50", True, 1234.5), ("12.345,67", True, 12345.67), ("26.000", True, 26000.0), ("26.000", False, 26.0), ("1.234.567", False, 1234567.0), ("72,5", True, 72.5),
        ("600 KM", True, 600.0), ("12.34.56", True, None), ("1.23.456", False, None), ("1.234,5.6", False, None), ("abc", True, None), (None, True, None), ("", True, None), ("+5", True, 5.0), (".5", True, 0.5),
        ("-3", True, -3.0), (",", True, None), ("72,5 m²", False, None), ("1 234,5", False, 1234.5), ("5.", False, 5.0), ("1,234", True, 1234.0), ("1,234", False, 1.234), ("1,234,567", True, 1234567.0),
    ]
    for flag in (True, False):
        some = [c for c in cases if c[1] == flag]
        assert values(spark, [(c[0],) for c in some], "x string", X.locale_number("x", flag)) == [c[2] for c in some]


def test_areas_ids_and_times(spark):
    areas = {"72,5": 72.5, "4": None, "7.500": 7500.0, "2000000": None, "32000": 32000.0, "1.036": 1036.0, "1,5": None, "7,5": 7.5}
    assert values(spark, [(k,) for k in areas], "x string", X.norm_area("x")) == list(areas.values())
    ids = {"12": 12, " 69441462 ": 69441462, "0": None, "-3": None, "1.5": None, "9007199254740993": None, "999999999999999999999": None, "2a": None}
    assert values(spark, [(k,) for k in ids], "x string", X.norm_id("x")) == list(ids.values())
    assert values(spark, [("1752875036",), ("1752875036.5",), ("1752875036000",), (None,)], "x string", F.unix_seconds(X.norm_unix_seconds("x"))) == [1752875036, None, None, None]


@pytest.mark.parametrize(
    ("price", "deal", "state", "amount", "reason"),
    [
        ("2999", "sale", "invalid", None, "below_sale_minimum"), ("3.000", "sale", "valid", 3000, None), ("49", "rent", "invalid", None, "below_rent_minimum"), ("50", "rent", "valid", 50, None),
        ("9", "daily_rent", "invalid", None, "below_daily_rent_minimum"), ("10", "daily_rent", "valid", 10, None), ("0", "sale", "unpriced", None, "zero"), (None, "sale", "unpriced", None, "missing"),
        ("  ", "sale", "unpriced", None, "missing"), ("not a number", "sale", "invalid", None, "not_numeric"), ("-5", "rent", "invalid", None, "negative"), ("Po dogovoru", "sale", "unpriced", None, "not_priced"),
        ("26.000", "sale", "valid", 26000, None), ("2999", None, "invalid", None, "below_sale_minimum"),
    ],
)
def test_price_minimums(spark, price, deal, state, amount, reason):
    r = spark.createDataFrame([(price, deal)], "p string, d string").select(X.norm_price("p", "d", F.lit("apartments")).alias("r")).first().r
    assert (r.state, r.price, r.reason) == (state, amount, reason)


READINGS = [  # price, deal, declared, kind, area, title -> price, deal, basis, reason
    *[((150, "sale", False, k, None, ""), (150, "rent", "total", None)) for k in ("garages", "commercial", "rooms", "houses", "warehouses")],
    ((2700, "sale", False, "garages", None, ""), (2700, "sale", "total", None)),
    ((1000, "sale", False, "prefab", None, ""), (1000, "sale", "total", None)),
    ((40, "sale", False, "land", 3607.0, ""), (144280, "sale", "per_sqm", None)),
    ((40, "sale", False, "land", None, ""), (None, "sale", "per_sqm", "per_sqm_without_area")),
    ((1500, "sale", False, "land", 624.0, ""), (1500, "rent", "total", None)),
    ((50, "sale", False, "vacation_homes", None, ""), (50, "daily_rent", "total", None)),
    ((50, "sale", False, "vacation_homes", None, "Iznajmljivanje"), (50, "daily_rent", "total", None)),
    ((80, "rent", True, "vacation_homes", None, ""), (80, "daily_rent", "total", None)),
    ((500, "sale", False, "vacation_homes", None, ""), (500, "rent", "total", None)),
    ((95000, "sale", False, "vacation_homes", None, ""), (95000, "sale", "total", None)),
    ((700, "sale", False, "apartments", 60.0, ""), (700, "rent", "total", None)),
    ((1800, "sale", False, "apartments", 60.0, ""), (108000, "sale", "per_sqm", None)),
    ((700, "sale", False, "apartments", 60.0, "Prodaja stana"), (42000, "sale", "per_sqm", None)),
    ((1800, "sale", False, "apartments", 60.0, "Najam stana"), (1800, "rent", "total", None)),
    ((150, "sale", True, "garages", None, ""), (None, "sale", "total", "below_sale_minimum")),
    ((150000, "sale", False, "apartments", 60.0, ""), (150000, "sale", "total", None)),
    ((600, "rent", False, "apartments", 60.0, ""), (600, "rent", "total", None)),
    ((150000, None, False, "apartments", 60.0, ""), (150000, None, "total", None)),
    ((700, None, False, None, None, ""), (None, None, "total", "below_sale_minimum")),
]


def test_sale_posted_rents_and_rates(spark):
    df = spark.createDataFrame([(k, float(p), d, s, t, a, w) for k, ((p, d, s, t, a, w), _) in enumerate(READINGS)], "k int, p double, d string, s boolean, t string, a double, w string")
    got = {r.k: r.r for r in df.select("k", X.read_price("p", "d", "t", "a", "w", "s", is_text=F.lit(False)).alias("r")).collect()}
    for k, (case, want) in enumerate(READINGS):
        assert (got[k].price, got[k].deal, got[k].basis, got[k].reason) == want, case


def test_currency(spark):
    cases = [(("600", None, None), None), (("600", "600 KM", None), "BAM"), (("600 BAM", None, "KM"), "BAM"), (("600 €", None, None), "EUR"), (("600", None, "RSD"), "RSD"), (("600", "600 KM", "EUR"), "conflict"), (("600", "600 KM", "{}"), "unknown"), (("KMA 5", None, ""), None)]
    assert values(spark, [c for c, _ in cases], "p string, d string, c string", X.currency_of("p", "d", "c")) == [w for _, w in cases]


def test_values(spark):
    assert values(spark, [("Da",), ("0",), ("x",), (None,)], "x string", X.boolean_value("x")) == ["Yes", "No", "Unknown", "Unknown"]
    assert values(spark, [("Drugo",), ("x",), (None,), ("Plin",)], "x string", X.text_value(X.renamed("x", {"Drugo": "Ostalo"}))) == ["Ostalo", "Unknown", "Unknown", "Plin"]
    assert values(spark, [("Đure Šćepan 5%_",)], "x string", X.contains_folded("x", " djure SCEPAN 5%_ ")) == [True]
    assert values(spark, [("https://a.b/c/?q=1&page=2&category_id=3#x",), ("https://a.b?z=%C4%8D+a&a&z=1",), ("https://a.b/p",)], "x string", X.canonical_url("x")) == ["/c/?category_id=3&q=1", "/?a=&z=%C4%8D+a&z=1", "/p"]
    assert values(spark, [("Garsonjera",), ("Trosoban (3)",), ("4+",), ("?",), ("3 sobe",), ("do 3",)], "x string", X.rooms_from("x")) == ["0", "3", "4+", None, None, None]
    assert values(spark, [("23",), ("2668",), ("25",), ("2672",), ("9999",), (None,), ("2a",)], "x string", X.property_type("x")) == ["apartments", "daily_rent", "commercial", "warehouses", "other", None, None]
    assert values(spark, [("Izdavanje, prodaja",), ("sell",), ("kupovina",), ("x",), (None,)], "x string", X.deal_type("x")) == ["rent", "sale", "sale", None, None]
    assert values(spark, [("Polunamješten",), ("Namješten",), ("nenamjesten",), ("Da",), ("ne",), ("?",)], "x string", X.furnished_text("x")) == [None, True, False, True, False, None]
    assert values(spark, [("1,5",), ("-0,5",), ("201",), ("x",)], "x string", X.small_int("x", -5, 200)) == [2, 0, None, None]


def cards(spark, data):
    pages = payloads.parse_pages(spark.createDataFrame([(json.dumps({"data": data, "meta": {"total": len(data), "current_page": "1"}}),)], "p string"), "p")
    good, bad = normalize.normalize_search_items(payloads.items_of(pages).select("place", "item"))
    return {r.place: r for r in good.collect()}, {r.place: r.reason for r in bad.collect()}


def test_search_items(spark):
    label = lambda k, v: {"label": k, "value": v}
    good, bad = cards(spark, [
        {"id": 13, "title": "ab"}, {"id": 14, "title": "Valid listing"}, None, 5, {"title": "no id at all"}, {"id": "15", "title": 777},
        {"id": " 16 ", "title": " Garsonjera centar ", "listing_type": "sell", "category_id": 23, "price": 400000, "special_labels": [label("Kvadrata", 20), 3], "location": {"lat": 51.5, "lon": -0.1}, "user_type": "shop", "date": 1752875036},
        {"id": 17, "title": "Stan na dan", "category_id": "2668", "listing_type": "sell", "price": "40", "display_price": "40 KM", "special_labels": [label("Broj Soba", "Trosoban (3)")], "location": {"location": {"lat": "44.77", "lon": "17.19"}}, "user_type": "robot"},
        {"id": 18, "title": "Unknown deal apartment", "price": 150000, "display_price": "150.000 KM"}, {"id": 19, "title": "Garaza", "category_id": 30, "listing_type": "sell", "price": 26.123, "labels": {"a": 1}, "location": "Centar"},
    ])
    assert bad == {0: "invalid_title", 2: "not_an_object", 3: "not_an_object", 4: "invalid_id", 5: "invalid_title"} and set(good) == {1, 6, 7, 8, 9}
    assert (good[6].entity_id, good[6].title, good[6].rooms, good[6].sqm, good[6].price, good[6].latitude, good[6].seller, good[6].url) == (16, "Garsonjera centar", "0", 20.0, 400000.0, None, "shop", "https://olx.ba/artikal/16")
    assert (good[7].deal, good[7].kind, good[7].price, good[7].currency, good[7].rooms, good[7].latitude, good[7].seller) == ("daily_rent", "daily_rent", 40.0, "BAM", "3", 44.77, None)
    assert (good[8].deal, good[8].price, good[8].currency, good[8].price_text, good[8].kind) == (None, 150000.0, "BAM", "150.000 KM", None)
    assert (good[9].deal, good[9].price, good[9].price_reason) == ("rent", None, "below_rent_minimum")  # a number, not 26 thousand
    assert (good[1].price_state, good[1].price_reason, good[1].price_text) == ("unpriced", "missing", "Na upit")


def detail(spark, payload):
    return normalize.map_details(payloads.parse_details(spark.createDataFrame([(json.dumps(payload),)], "p string"), "p").drop("p")).collect()


def test_details(spark):
    a = lambda **kw: [{"attr_code": k.replace("_", "-"), "value": v} for k, v in kw.items()]
    d = detail(spark, {"id": 69441462, "created_at": 1752875036, "date": 1787527805, "status": "active", "views": 37194, "favorites": 41, "user": {"type": "shop"}, "location": {"lat": 44.76995369956578, "lon": 17.189762566017492}, "attributes": a(stanje="Novogradnja", kvadrata=38, sprat="1", parking="Da", exotic_unknown_code="kept-raw")})[0]
    assert (d.condition, d.sqm, d.floor_num, d.parking, d.views, d.favorites, d.seller, d.source_status) == ("Novogradnja", 38.0, 1, True, 37194, 41, "shop", "active")
    assert d.published_at.replace(tzinfo=UTC) == datetime.fromtimestamp(1752875036, UTC) and d.characteristics["exotic-unknown-code"] == "kept-raw" and d.characteristics["kvadrata"] == "38"
    rental = detail(spark, {"id": "79447263", "price": 120, "listing_type": "sell", "attributes": a(vrsta_oglasa="Iznajmljivanje")})[0]
    assert (rental.deal, rental.price) == ("rent", 120.0)
    garage = detail(spark, {"id": "104", "price": 900, "category_id": 30, "listing_type": "rent", "attributes": a(vrsta_oglasa="Prodaja")})[0]
    assert (garage.deal, garage.price) == ("sale", None)
    nightly = detail(spark, {"id": "109", "price": 40, "category_id": 2668, "attributes": a(kvadratura="36", broj_soba="Jednosoban (1)", vrsta_grijanja="Centralno")})[0]
    assert (nightly.sqm, nightly.rooms, nightly.heating, nightly.deal) == (36.0, "1", "Centralno", "daily_rent")
    house = detail(spark, {"id": "111", "category_id": 24, "attributes": a(broj_soba="3", namjestena="Da", gara_a="Da", broj_kupatil="2", broj_spratova="2")})[0]
    assert (house.rooms, house.furnished, house.garage, house.bathrooms, house.floors_total) == ("3", True, True, 2, 2)
    for attributes in (a(opremljenost="Polunamješten", namjesten="Da"), a(namjesten="Da", opremljenost="Polunamješten")):
        assert detail(spark, {"id": 123, "attributes": attributes})[0].furnished is None
    bare = detail(spark, {"id": 42})[0]
    assert bare.sqm is None and bare.characteristics in ({}, None) and bare.reports is None
    assert detail(spark, None) == [] and detail(spark, [1]) == [] and detail(spark, {"title": "x"}) == []


NOW = datetime(2026, 9, 5, 12, tzinfo=UTC)
BEFORE = int(NOW.timestamp()) - 100


def reports(spark, entries, deal="sale", kind=None, basis="total", sqm=None):
    v = spark.createDataFrame([(json.dumps({"price_history": entries}),)], "p string").select(F.parse_json("p").alias("v"))
    rows = v.select(F.lit(1).alias("entity_id"), F.lit(deal).alias("deal"), F.lit(kind).cast("string").alias("kind"), F.lit(basis).alias("price_basis"), F.lit(sqm).cast("double").alias("sqm"), normalize.reports_of(F.col("v")).alias("reports"))
    good, bad = normalize.normalize_history(rows, NOW.replace(tzinfo=None))
    return [(r.price, int(r.reported_at.replace(tzinfo=UTC).timestamp()), r.currency) for r in good.orderBy("place").collect()], [r.reason for r in bad.orderBy("place").collect()]


def test_history(spark):
    dup = [{"price": "3.000", "date": BEFORE}, {"price": 4000, "created_at": BEFORE - 20}, {"price": 4000, "created_at": BEFORE - 20}]
    assert reports(spark, dup) == ([(4000.0, BEFORE - 20, None), (3000.0, BEFORE, None)], ["duplicate"])
    assert reports(spark, json.dumps([{"price": "50", "date": BEFORE}]), "rent")[0] == [(50.0, BEFORE, None)]
    assert [p for p, *_ in reports(spark, [{"price": 45, "created_at": BEFORE - 10}, {"price": 40, "created_at": BEFORE}], "sale", "land", "per_sqm", 1000.0)[0]] == [45000.0, 40000.0]
    bad = [{"price": 3000, "created_at": BEFORE}, {"price": 4000, "created_at": BEFORE + 1000}, {"price": 5000, "created_at": "bad"}, {"price": 6000}, 7]
    assert reports(spark, bad) == ([(3000.0, BEFORE, None)], ["future_timestamp", "invalid_timestamp", "invalid_timestamp", "invalid_timestamp"])
    own = [{"price": 700, "date": 1700000000}, {"price": 700, "date": 1700000000, "currency": "EUR"}, {"price": 750, "date": 1700000001, "display_price": "750 KM"}]
    assert sorted(c or "" for *_, c in reports(spark, own, "rent")[0]) == ["", "BAM", "EUR"]


def test_unusable_pages(spark, tmp_path):
    for k, text in enumerate(('{"data":[],"meta":{"total":0}}', '{"data":{"a":1},"meta":{"total":3}}', '{"data":[1]}', "[1", '{"data":[{"id":1,"title":"abc"}],"meta":{"total":"1"}}')):
        (tmp_path / f"{k}.json").write_text(text)
    pages = payloads.read_search_pages(spark, str(tmp_path))
    assert [r.usable for r in pages.orderBy("file").collect()] == [True, False, False, False, True]
    assert payloads.items_of(pages).where("place is not null").count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text('{"id": 7}\n{"id": "8", "price": 5}\nnot json\n')
    details = payloads.read_details(spark, str(tmp_path / "d"), one_per_line=True)
    assert sorted(r.entity_id for r in normalize.map_details(details).collect()) == [7, 8]


def test_a_search_in_an_attribute_makes_no_map(spark):
    """A filter over items whose attributes a projection makes looks at the one attribute alone."""
    made = spark.range(5).select("id", F.create_map(F.lit("adresa"), F.concat(F.lit("Šetalište "), F.col("id").cast("string")), F.lit("lift"), F.lit("da")).alias("characteristics"))
    found = filters.property_filters(made, {"address": "SETALISTE 3"}).select("id")
    assert [r.id for r in found.collect()] == [3] and "map(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_options_are_valued_after_they_are_counted(spark):
    """Values of controls are made of the different texts, not of every row; different texts of one value are one option."""
    rows = spark.createDataFrame([({"heating": "Drugo"}, {"balkon": "Da"}), ({}, {"grijanje": "Ostalo", "balkon": "true"}), ({"heating": "z"}, {"balkon": ""})], "extra map<string,string>, characteristics map<string,string>")
    options = filters.option_lists(rows, ["heating", "balcony"])
    assert sorted(map(tuple, options.collect())) == [("balcony", "Unknown"), ("balcony", "Yes"), ("heating", "Ostalo"), ("heating", "Unknown")]
    plan = options._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" in plan and "rlike" not in plan[plan.index("generate"):]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_details_are_parsed_once(spark):
    """No filter is put before the reading of a payload, and of a column's codes the last (or first) in the list still counts."""
    a = lambda *pairs: [{"attr_code": k, "value": v} for k, v in pairs]
    given = [
        {"id": 1, "attributes": [*a(("garaza", "ne"), ("gara-a", "da"), ("kvadratura", 60), ("kvadrata", "50,5"), ("namjestena", "?"), ("namjesten", "Da"), ("x", " "), ("x", "1.234,50"), ("x", "2")), 7, {"value": "y"}]},
        {"id": 2, "attributes": a(("gara-a", "da"), ("garaza", "ne"), ("kvadrata", 40), ("kvadratura", 60), ("x", "007 KM"), ("y", "Trosoban (3)"), ("z", "-0,50"))}, {"title": "no id"}, [1],
    ]
    texts = spark.createDataFrame([(k, json.dumps(g)) for k, g in enumerate(given)], "k int, p string").repartition(2).select("k", F.concat("p", F.lit(" ")).alias("p"))
    rows = normalize.map_details(payloads.parse_details(texts, "p").drop("p"))
    got = {r.k: r for r in rows.collect()}
    assert set(got) == {0, 1}
    assert (got[0].garage, got[0].sqm, got[0].furnished, got[0].characteristics["x"]) == (True, 60.0, True, "1234.5")
    assert (got[1].garage, got[1].sqm, got[1].characteristics["x"], got[1].characteristics["y"], got[1].characteristics["z"]) == (False, 40.0, "7", "Trosoban (3)", "-0.5")
    assert plan_of(rows.drop("reports")).count("parseJson") == 1


def pages_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, p string").repartition(2).select("id", F.concat("p", F.lit(" ")).alias("p"))


def test_pages_are_parsed_once(spark):
    pages = pages_of(spark, '{"data":[{"id":1,"title":"abc","price":"40"},null,7],"meta":{"total":3}}', '{"data":[],"meta":{"total":0}}', '{"data":[1]}', '{"data":{"a":1},"meta":{"total":3}}')
    items = payloads.items_of(payloads.parse_pages(pages, "p")).select("id", "place", "item")
    assert sorted((r.id, r.place) for r in items.where("place is not null").collect()) == [(0, 0), (0, 1), (0, 2)]
    assert items.where("place is null").select("id").collect()[0].id == 1 and items.count() == 4
    good, bad = normalize.normalize_search_items(items.where("place is not null"))
    assert [r.place for r in good.collect()] == [0] and sorted(r.place for r in bad.collect()) == [1, 2]
    assert plan_of(good).count("from_json") == 1


def test_replay_reads_and_joins_once(spark):
    """Every archived response is one row of its own reading: no join, no page read again for what it rejects."""
    page, none = '{"data":[{"id":1,"title":"abc"},{"id":2,"title":"abd"},null,7,{"id":"x"}]}', '{"error":true}'
    s, d = [page, '{"items":[{"id":1,"title":"abc"}]}', '{"data":[]}', none, "not json", page], ['{"id":9,"category_id":23,"location":{"lat":44.5,"lon":17.5}}', "[1]", "{", '{"id":8}']
    rows = [(k, "search", k == 5, t, None) for k, t in enumerate(s)] + [(k + 10, "detail", k == 3, None, t) for k, t in enumerate(d)]
    archive = spark.createDataFrame(rows, "id long, kind string, diagnostic boolean, source_payload string, payload string").repartition(2)
    out = normalize.replay(archive)
    got = {r.id: (r.parsed_items, r.rejected_items, r.rejections, r.entity_id, r.property_type, r.has_pin, r.outcome) for r in out.collect()}
    assert got == {
        0: (2, 3, "invalid_id:1,not_an_object:2", None, None, None, "replayed"), 1: (1, 0, "", None, None, None, "replayed"), 2: (0, 0, None, None, None, None, "replayed"),
        3: (0, 0, "data_not_array:1", None, None, None, "replayed"), 4: (0, 0, "data_not_array:1", None, None, None, "replayed"), 5: (None, None, None, None, None, None, "no_source"),
        10: (None, None, None, 9, "apartments", True, "replayed"), 11: (None, None, None, None, None, None, "replayed"), 12: (None, None, None, None, None, None, "replayed"), 13: (None, None, None, None, None, None, "no_source"),
    }
    plan = plan_of(out)
    assert "Join" not in plan and plan.count("from_json") == 1 and plan.count("parseJson") == 1
