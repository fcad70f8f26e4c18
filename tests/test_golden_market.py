"""A small market with answers worked out by hand."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import histories as H
from hearthline.operators.comparables import Manual
from hearthline.operators.filters import Selection, Window
from hearthline.plans.boards import GROUPS, Board, run_board
from hearthline.sources.facts import Facts

D0 = date(2024, 6, 30)
NOW = datetime(2024, 6, 30, 12)


def day(n):
    return D0 + timedelta(days=n)


@pytest.fixture(scope="module")
def board(spark):
    rows = [  # id, deal, price, area, rate, rooms, kind, first seen, closed, lift
        (1, "sale", 100000.0, 50.0, 2000.0, "2", "apartments", -20, None, "true"),
        (2, "sale", 240000.0, 60.0, 4000.0, "3", "apartments", -15, None, "false"),
        (3, "rent", 600.0, 50.0, None, "2", "apartments", -10, None, "true"),
        (4, "sale", 120000.0, 60.0, 2000.0, "2", "apartments", -30, None, "true"),
        (5, "sale", 180000.0, 60.0, 3000.0, "3", "apartments", -20, -2, "false"),
        (6, "sale", 50000.0, 400.0, 125.0, None, "land", -12, None, None),
        (7, "daily_rent", 40.0, 35.0, None, "1", "daily_rent", -3, None, None),
    ]
    e = spark.createDataFrame(
        [(i, f"t{i}", f"u{i}", d, k, "Centre" if i < 6 else None, r, a, p, q, None, None, "private", None, "BAM", None, None, None, None, {}, {"lift": lift} if lift else {}, day(f), day(c) if c else None, p if c else None, None, None, "a") for i, d, p, a, q, r, k, f, c, lift in rows],
        "entity_id long, title string, url string, deal string, kind string, area_key string, rooms string, sqm double, price double, rate double, latitude double, longitude double, seller string, floor_num int, currency string, elevator boolean, parking boolean, condition string, year_built int, extra map<string,string>, characteristics map<string,string>, first_seen date, closed_at date, closing_price double, details_on date, source_status string, search_key string",
    )
    kept = ["title", "url", "deal", "kind", "area_key", "rooms", "sqm", "latitude", "longitude"]
    ev = spark.createDataFrame([(4, "closed", day(-8), day(-30), 150000.0), (4, "reopened", day(-7), None, 140000.0), (4, "closed", day(-5), day(-7), 130000.0), (5, "closed", day(-2), day(-20), 180000.0)], "entity_id long, event string, occurred_on date, opened_on date, price double")
    h = spark.createDataFrame([(1, day(-6), 120000.0), (1, day(-4), 110000.0), (1, day(-2), 100000.0), (4, day(-30), 160000.0), (4, day(-8), 150000.0), (4, day(-7), 140000.0), (4, day(-5), 130000.0)], "entity_id long, on_date date, price double").withColumn("source", F.lit("reported"))
    ago = lambda **k: NOW - timedelta(**k)
    r = spark.createDataFrame([(1, "a", ago(days=100), ago(days=100), "ok", True, 4, None), (2, "a", ago(hours=1), ago(hours=1), "ok", True, 4, None), (3, "b", ago(minutes=30), ago(minutes=29), "error", False, 0, "HTTP 503")], "run_id long, search_key string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, is_complete boolean, cards int, error string")
    s = spark.createDataFrame([("a", "A", "ua", None), ("b", "B", "ub", None)], "search_key string, name string, url string, retired_at timestamp_ntz")
    r = r.withColumn("pages", F.lit(2))
    return Board(Facts(e.withColumns({"last_seen": F.coalesce("closed_at", F.lit(D0)), "details_at": F.lit(None).cast("timestamp_ntz"), "attempted_at": F.when(F.col("entity_id") == 1, F.lit(NOW)).cast("timestamp_ntz")}), h, ev.join(e.select("entity_id", *kept), "entity_id"), r, s), Window(day(-90), D0), D0, NOW)


def days(b, n):
    return replace(b, window=Window(day(-n), D0))


def one(b, group):
    return GROUPS[group](b).first().asDict()


def chosen(b, **k):
    return replace(b, selection=replace(b.selection, **k))


def test_home(board):
    r = one(board, "home_2")
    assert r["active"] == 6 and r["median_rent"] == 600
    flats = one(chosen(board, category=("apartments",)), "home_2")
    assert flats["median_sale_ppm2"] == 2000 and flats["gross_yield_pct"] == 6


def test_overview(board):
    flats = chosen(board, category=("apartments",))
    assert one(flats, "overview_1")["active"] == 4
    assert one(flats, "overview_3")["drops"] == 2
    week = days(flats, 7)
    assert (one(week, "overview_1")["new_n"], one(week, "overview_1")["new_prev"]) == (0, 1)
    r = one(week, "overview_3")
    assert (r["drops"], r["drops_prev"], r["cut_share_pct"]) == (2, 1, 50)
    spread = {x.rooms: x for x in GROUPS["overview_21"](flats).collect()}
    assert (spread["2"].listings, spread["2"].p25, spread["2"].median, spread["3"].median) == (2, 2000, 2000, 4000)


def test_exits(board):
    flats = chosen(board, category=("apartments",))
    r = one(days(flats, 7), "exits_1")
    assert (r["exits"], r["exits_prev"], r["median_days_on_market"]) == (2, 1, 10)
    assert one(flats, "exits_1")["exits_prev"] is None
    assert [(x.direction, x.listings) for x in GROUPS["exits_15"](flats).collect()] == [("lower", 2)]
    spread = {x.rooms: x for x in GROUPS["exits_10"](flats).collect()}
    assert (spread["2"].exits, spread["2"].p25, spread["2"].median, spread["2"].p75, spread["3"].median) == (2, 7, 12, 17, 18)
    r = one(flats, "exits_1")
    assert (r["exits"], r["months_of_inventory"], r["median_days_on_market"]) == (3, 4, 18)
    two = one(chosen(flats, rooms=("2",)), "exits_1")
    assert (two["exits"], two["months_of_inventory"]) == (2, 4.5)


def test_categories_and_amenities(board):
    assert one(board, "overview_1")["active"] == 5
    assert one(chosen(board, category=("land",)), "overview_1")["active"] == 1
    assert one(chosen(board, properties={"elevator": ["Yes"]}), "overview_1")["active"] == 3


def test_null_area_and_bounds(board):
    only = replace(board, facts=replace(board.facts, entities=board.facts.entities.where("entity_id = 1").withColumn("sqm", F.lit(None).cast("double"))))
    assert one(chosen(only, min_sqm=10), "overview_1")["active"] == 0
    assert one(only, "overview_1")["active"] == 1


def test_comparables(board):
    b = replace(board, subject=Manual(sqm=55.0, kind="apartments"))
    r = one(b, "buyer_1")
    assert (r["comps"], r["fair_low"], r["fair_price"], r["fair_high"]) == (4, 110000, 138000, 179000)
    r = one(replace(board, subject=Manual(entity_id=1)), "buyer_1")
    assert (r["comps"], r["fair_price"], r["ask_vs_fair_change_pct"]) == (3, 150000, -33.3)
    r = one(replace(board, subject=Manual(sqm=50.0, kind="apartments", deal="rent")), "renter_1")
    assert (r["comps"], r["fair_price"]) == (1, 600)


def test_buy(board):
    flats = chosen(board, category=("apartments",))
    assert one(flats, "buyer_10")["cut_share_pct"] == 66.7
    r = one(flats, "buyer_31")
    assert (r["below_first_pct"], r["median_final_change_pct"]) == (100, -6.7)


def test_amenity_premium(board):
    lift = {x.amenity: x for x in GROUPS["renter_30"](board).collect()}["Lift"]
    assert (lift.with_n, lift.median_with) == (1, 600)


def test_nightly_series(board, spark):
    more = spark.createDataFrame([(7, day(-3), 45.0), (7, day(-1), 40.0)], "entity_id long, on_date date, price double").withColumn("source", F.lit("reported"))
    b = days(replace(board, facts=replace(board.facts, history=board.facts.history.unionByName(more))), 7)
    r = one(b, "daily_10")
    assert (r["repriced_pct"], r["repriced_pct_prev"]) == (100, 0)
    series = [x.median for x in GROUPS["daily_31"](b).orderBy("day").collect()]
    assert set(series) == {45, 40} and series[-1] == 40


def test_series_from_kept_counts(spark):
    """Three snapshots: counts changed by what each touches give the same days as the whole history."""
    rng = random.Random(12)
    item = "entity_id long, sqm double, price double, first_seen date"
    reports, events, items = [], [], {}
    kept = spark.createDataFrame([], "x double, lo date, hi date, n long")
    facts_of = lambda ids: (spark.createDataFrame([items[i] for i in ids], item), spark.createDataFrame([r for r in reports if r[0] in ids], "entity_id long, on_date date, price double"), spark.createDataFrame([e for e in events if e[0] in ids], "entity_id long, event string, occurred_on date"))
    counts = lambda ids: H.span_counts(H.value_spans(*facts_of(ids), day(-40), D0)) if ids else kept.where("false")
    for n in range(3):
        at = day(-30 + 10 * n)
        touched = {i for i in range(40) if rng.random() < 0.5}
        was = spark.createDataFrame(counts([i for i in touched if i in items]).collect(), kept.schema)
        for i in touched:
            items.setdefault(i, (i, 50.0, float(rng.randint(1, 30)), at))
            reports.append((i, at, float(rng.randint(1, 30))))
            if n and rng.random() < 0.3:
                events.append((i, "closed", at))
        kept = spark.createDataFrame(H.changed_counts(kept, counts(sorted(touched)), was).collect(), kept.schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = H.daily_state_series(*facts_of(sorted(items)), day(-40), D0)
    assert rows(H.series_of_counts(kept, day(-40), D0)) == rows(whole) and whole.count() == 31
    assert rows(H.series_of_counts(kept, day(-15), day(-3))) == rows(H.daily_state_series(*facts_of(sorted(items)), day(-15), day(-3)))


def test_health(board):
    b = days(board, 2)
    r = one(b, "health_2")
    assert (r["failed_runs"], r["success_rate"], r["cards"], r["incomplete"]) == (1, 50, 4, 1)
    assert one(b, "health_1")["searches"] == 2


def test_health_of_items(board):
    """Details are due of items that were not tried in twelve hours; last_seen, not first_seen, tells what is recent."""
    assert one(board, "health_25")["backlog"] == 5  # six are open, one was tried just now
    odd = board.facts.entities.withColumns({"extra": F.when(F.col("entity_id").isin(4, 5), F.create_map(F.lit("latest_price_state"), F.lit("invalid"))).otherwise(F.col("extra")), "last_seen": F.when(F.col("entity_id") == 5, F.lit(day(-5))).otherwise(F.col("last_seen"))})
    b = days(replace(board, facts=replace(board.facts, entities=odd)), 3)
    assert one(b, "health_26")["invalid_latest"] == 1
    assert {(r.we_say, r.listings) for r in GROUPS["health_18"](b).collect()} == {("open", 6)}
    assert {r.url for r in GROUPS["health_28"](b).collect()} == {"ua", "ub"} and {r.pages for r in GROUPS["health_12"](b).collect()} == {2}


def test_markers_of_searches_are_no_reports(board):
    """Markers on the days of reports, dearer and cheaper, change no group that reads prices."""
    h = board.facts.history
    both = h.unionByName(h.withColumns({"price": F.col("price") * 3, "source": F.lit("search")})).unionByName(h.withColumns({"on_date": F.date_add("on_date", 1), "price": F.col("price") / 3, "source": F.lit("search")}))
    marked = replace(board, facts=replace(board.facts, history=both))
    for group in ("buyer_10", "buyer_31", "buyer_33", "buyer_41", "buyer_51", "buyer_52", "daily_10", "daily_31", "daily_41", "exits_15", "exits_18", "exits_9", "overview_3", "overview_7", "overview_17", "pro_1", "pro_11", "pro_20", "pro_21", "pro_40", "renter_52"):
        key = lambda rows: sorted(map(str, rows.collect()))
        assert key(GROUPS[group](marked)) == key(GROUPS[group](board)), group


def test_subject_of_the_filter(board):
    """Where nothing is linked, the filter tells the kind of offer and one chosen category the type."""
    typed = replace(board, subject=Manual(sqm=50.0, rooms="2"))
    assert one(chosen(typed, deal="rent"), "pro_60")["fair_price"] == 600 and one(typed, "pro_60")["fair_price"] > 10_000
    assert one(chosen(typed, category=("apartments",)), "buyer_1")["comps"] == one(typed, "buyer_1")["comps"] > 0
    assert one(chosen(typed, category=("houses",)), "buyer_1")["comps"] == 0
    assert one(chosen(typed, category=("houses", "apartments")), "buyer_1")["comps"] > 0


def test_every_group_on_full_and_empty_market(board):
    f = board.facts
    empty = replace(board, facts=Facts(*(x.where("false") for x in (f.entities, f.history, f.lifecycle, f.runs, f.searches))))
    for name, group in GROUPS.items():
        assert group(board).columns and group(empty).columns, name
    for group in ("home_2", "exits_1", "overview_7", "buyer_1", "pro_31", "health_28", "home_13"):
        GROUPS[group](empty).collect()


def test_board_with_cross_filter(board):
    out = run_board(board, "overview", ["overview_26"], [("area_key", "IN", [None])])
    assert [r.ppm2 for r in out["overview_26"].collect()] == [125.0]
    shared = replace(board, selection=Selection(cross=(("area_key", "=", "Centre"), ("floor_num", ">", 1))))
    assert one(shared, "overview_1")["active"] == 4  # floor_num is no column of exits, so it is left out for both
