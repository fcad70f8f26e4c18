"""State transitions, alerts, areas, archives and streams."""

import json
import math
import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import geo
from hearthline.operators.filters import Window
from hearthline.plans import alerts, boards, job_queries, state
from hearthline.sources import archive, export, facts
from hearthline.streaming import streams

STATE = "entity_id long, title string, url string, deal string, kind string, area_key string, rooms string, sqm double, price double, rate double, seller string, first_seen date, last_seen date, closed_at date, closing_price double, search_keys array<string>"
CARD = "entity_id long, title string, url string, deal string, kind string, rooms string, sqm double, price double, price_state string, area_key string, seller string"
D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)
D1_NOON = datetime(2024, 1, 1, 12)


def card(i, price=100000.0, deal="sale", price_state="valid"):
    return (i, f"t{i}", f"u{i}", deal, "apartments", "2", 50.0, price, price_state, None, "shop")


def cards(spark, *rows):
    return spark.createDataFrame(list(rows), CARD)


def by_id(df):
    return {r.entity_id: r for r in df.collect()}


def test_membership_closing_and_reappearance(spark):
    empty = spark.createDataFrame([], STATE)
    a = state.ingest_snapshot(empty, cards(spark, card(1), card(2)), "a", D1)
    assert a.summary.first().new_count == 2 and a.markers.count() == 2 and a.lifecycle.count() == 0
    b = state.ingest_snapshot(a.state, cards(spark, card(1)), "b", D1)
    assert by_id(b.state)[1].search_keys == ["a", "b"]
    c = state.ingest_snapshot(b.state, cards(spark, card(3)), "a", D2)
    rows = by_id(c.state)
    assert rows[1].closed_at is None and rows[1].search_keys == ["b"]
    assert rows[2].closed_at == D2 and rows[2].closing_price == 100000.0
    assert [(r.entity_id, r.event, r.opened_on) for r in c.lifecycle.collect()] == [(2, "closed", D1)]
    d = state.ingest_snapshot(c.state, cards(spark, card(2), card(3)), "a", D3)
    assert by_id(d.state)[2].closed_at is None
    assert [(r.entity_id, r.event) for r in d.lifecycle.collect()] == [(2, "reopened")]
    past = d.lifecycle.where("event = 'reopened'")
    e = state.ingest_snapshot(d.state, cards(spark, card(3)), "a", D3 + timedelta(1), past)
    assert [(r.event, r.opened_on) for r in e.lifecycle.collect()] == [("closed", D3)]


def test_second_ingest_of_the_same_snapshot_changes_nothing(spark):
    first = state.ingest_snapshot(spark.createDataFrame([], STATE), cards(spark, card(1), card(2)), "a", D1)
    again = state.ingest_snapshot(first.state, cards(spark, card(1), card(2)), "a", D1)
    assert by_id(again.state) == by_id(first.state)
    assert again.lifecycle.count() == 0 and again.markers.count() == 0


def test_invalid_price_is_carried_and_drop_counted(spark):
    first = state.ingest_snapshot(spark.createDataFrame([], STATE), cards(spark, card(1), card(2)), "a", D1)
    nxt = state.ingest_snapshot(first.state, cards(spark, card(1, 5.0, price_state="invalid"), card(2, 90000.0)), "a", D2)
    rows = by_id(nxt.state)
    assert rows[1].price == 100000.0 and rows[2].price == 90000.0
    assert nxt.summary.first().drop_count == 1


def test_sweep_cuts_memberships_once(spark):
    first = state.ingest_snapshot(spark.createDataFrame([], STATE), cards(spark, card(1)), "a", D1)
    swept = state.sweep(first.state, ["b"], D2)
    assert by_id(swept)[1].closed_at == D2
    assert by_id(state.sweep(swept.drop("closing"), ["b"], D3))[1].closed_at == D2
    assert by_id(state.sweep(first.state, [], D2))[1].closed_at is None
    searches = spark.createDataFrame([("a", None), ("b", None), ("c", datetime(2023, 1, 1))], "search_key string, retired_at timestamp_ntz")
    assert {r.search_key: r.retired_at for r in state.retire_searches(searches, ["b"], datetime(2024, 1, 1)).collect()} == {"a": datetime(2024, 1, 1), "b": None, "c": datetime(2023, 1, 1)}


def test_last_card_of_an_id_wins(spark):
    twice = cards(spark, card(1, 100000.0), card(2), card(1, 90000.0), card(0), card(-3)).coalesce(1)
    first = state.ingest_snapshot(spark.createDataFrame([], STATE), twice, "a", D1)
    assert {i: r.price for i, r in by_id(first.state).items()} == {1: 90000.0, 2: 100000.0} and first.state.count() == 2
    assert first.summary.first().listing_count == 2 and first.markers.count() == 2


def test_deals_of_cards_and_details(spark):
    """Nightly categories win, then what details declared; an item may turn from a sale into a rent."""
    s = STATE + ", characteristics map<string,string>"
    old = [(i, "t", "u", deal, "apartments", None, "2", 50.0, 3000.0, None, "shop", D1, D1, None, None, ["a"], {state.DECLARED_CODE: "x"} if declared else {}) for i, deal, declared in ((1, "sale", False), (2, "rent", True), (3, "daily_rent", True), (4, "sale", True), (5, "sale", False))]
    got = state.ingest_snapshot(spark.createDataFrame(old, s), cards(spark, card(1, 600.0, "rent"), card(2, 3000.0, "sale"), card(3, 3000.0, "sale"), card(4, 40.0, "daily_rent"), card(5, None, None, "unpriced")), "a", D2)
    rows = by_id(got.state)
    assert {i: (r.deal, r.price) for i, r in rows.items()} == {1: ("rent", 600.0), 2: ("rent", 3000.0), 3: ("sale", 3000.0), 4: ("daily_rent", 40.0), 5: ("unknown", None)}
    assert sorted(r.entity_id for r in got.markers.collect()) == [1, 3, 4]


def test_unpriced_cards_keep_the_price(spark):
    first = state.ingest_snapshot(spark.createDataFrame([], STATE), cards(spark, card(1)), "a", D1)
    kept = state.ingest_snapshot(first.state, cards(spark, card(1, None, "sale", "unpriced")), "a", D2)
    assert by_id(kept.state)[1].price == 100000.0 and kept.markers.count() == 0 and kept.summary.first().median_rate is None


def test_one_marker_a_day(spark):
    one = state.ingest_snapshot(spark.createDataFrame([], STATE), cards(spark, card(1)), "a", D1)
    two = state.ingest_snapshot(one.state, cards(spark, card(1, 90000.0)), "a", D1)
    assert [r.price for r in state.upsert_prices(one.markers, two.markers).collect()] == [90000.0]


def test_enrichment_queue(spark):
    now = datetime(2024, 1, 20, 12)
    fresh, tried = datetime(2024, 1, 19), datetime(2024, 1, 10)
    rows = [[i, 44.0, 17.0, 50.0, 100000.0, "sale", None, fresh, tried] for i in range(1, 10)]
    rows[0][7] = rows[5][7] = rows[6][7] = None
    rows[1][7] = datetime(2024, 1, 12)
    rows[2][1], rows[3][3], rows[5][8], rows[6][6], rows[8][3], rows[8][5] = None, None, now, D1, None, "rent"
    s = spark.createDataFrame(rows, "entity_id long, latitude double, longitude double, sqm double, price double, deal string, closed_at date, details_at timestamp_ntz, attempted_at timestamp_ntz")
    prices = spark.createDataFrame([(8, date(2024, 1, 19), "search"), (9, date(2024, 1, 20), "reported")], "entity_id long, on_date date, source string")
    first = state.enrichment_queue(s, prices, now, 2, retry_minutes=60).collect()
    assert [r.entity_id for r in first] == [1, 2] and {r.pool_total for r in first} == {5} and first[0].never_detailed and first[1].stale
    s = state.mark_attempts(s, spark.createDataFrame([(1,), (2,)], "entity_id long"), now)
    nxt = state.enrichment_queue(s, prices, now, 10, retry_minutes=60).collect()
    assert [r.entity_id for r in nxt] == [3, 4, 8] and nxt[0].unpinned and nxt[1].missing_sqm and nxt[2].price_changed


def test_sweep_allowed(spark):
    """Without a card, only if every configured search was authoritative: one of two that ran and saw nothing is not enough."""
    rows = [(1, "a", 0, "ok", True), (1, "b", 0, "ok", True), (2, "a", 0, "error", False), (2, "b", 0, "ok", True), (3, "a", 5, "error", False), (4, "a", 0, "ok", True), (5, "a", 0, "ok", True), (5, "b", 0, "ok", False)]
    runs = spark.createDataFrame(rows, "cycle int, search_key string, cards int, status string, is_complete boolean")
    configured = spark.createDataFrame([("a",), ("b",)], "search_key string")
    assert {r.cycle: r.allowed for r in state.sweep_allowed(runs, configured).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_verdicts(spark):
    rows = [(1, 1, 200, True, 2, 1, 1, 2), (2, 1, 200, True, 9, 3, 1, 3), (3, 1, 403, False, None, None, None, 0), (4, 1, 200, True, 5, 1, 1, 4), (5, 1, 200, True, 0, 1, 1, 0), (6, 1, 200, True, 3, 1, 2, 3)]
    pages = state.classify_pages(spark.createDataFrame(rows, "run_id int, page int, http_status int, has_data boolean, total int, last_page int, current_page int, items int"))
    assert [r.response_state for r in pages.orderBy("run_id").collect()] == ["ok", "ok", "blocked", "ok", "verified_empty", "malformed"]
    assert {r.run_id: r.verdict for r in state.completeness_verdict(pages).collect()} == {1: "complete", 2: "truncated", 3: "failed", 4: "count_mismatch", 5: "complete", 6: "malformed"}


def test_pages_must_agree_with_the_first(spark):
    """(run, page, total, last, current, items, cards, rejected) and what becomes of them."""
    rows = [
        (1, 1, 30, 2, 1, 15, 15, 0, "ok"), (1, 2, 31, 2, 2, 15, 15, 0, "malformed"),  # another total
        (2, 1, 0, 3, 1, 0, 0, 0, "ok"), (2, 3, 0, 3, 3, 0, 0, 0, "ok"),  # empty, but not as page 1 of 1
        (3, 1, 15, 1, 1, 15, 0, 0, "malformed"), (4, 1, 15, 1, 1, 15, 14, 1, "malformed"),  # no card; one rejected
        (5, 1, 30, 2, 1, 15, 15, 0, "ok"), (5, 2, 30, 3, 2, 15, 15, 0, "malformed"), (6, 1, 0, 1, 1, 0, 0, 0, "verified_empty"),  # another last page
        (7, 1, 9, 1, 2, 9, 9, 0, "malformed"), (8, 2, 9, 2, 2, 4, 4, 0, "malformed"),  # not the page asked for; no page 1
        (9, 1, 4, 2, 1, 2, 2, 0, "ok"), (9, 2, 4, 2, 2, 2, 2, 0, "ok"),
    ]
    pages = spark.createDataFrame(rows, "run_id int, page int, total int, last_page int, current_page int, items int, cards int, rejected int, want string").withColumns({"http_status": F.lit(200), "has_data": F.lit(True)})
    got = state.classify_pages(pages)
    assert got.where("want <> response_state").collect() == []
    cards = spark.createDataFrame([(9, 1), (9, 2), (9, 2), (9, 3)], "run_id int, entity_id int")  # a card on both pages hides a missing one
    verdict = {r.run_id: r.verdict for r in state.completeness_verdict(got, cards).collect()}
    assert verdict == {1: "malformed", 2: "truncated", 3: "malformed", 4: "malformed", 5: "malformed", 6: "complete", 7: "malformed", 8: "malformed", 9: "count_mismatch"}
    assert state.completeness_verdict(got.where("run_id = 9")).first().verdict == "complete"


def test_details_and_currency_state_and_deal(spark):
    """Details without a currency leave it unknown, an invalid price is told by its state and keeps the one before, and a deal
    that they leave open is open."""
    s = STATE + ", currency string, extra map<string,string>"
    old = [(i, "t", "u", "rent", "apartments", None, "2", 50.0, 600.0, None, "shop", D1, D1, None, None, ["a"], "BAM", {"views": "1", "latest_price_state": "valid"}) for i in (1, 2)]
    details = spark.createDataFrame([(1, "rent", 5.0, "invalid", None, 7, 3), (2, None, 700.0, "valid", "EUR", None, None)], "entity_id long, deal string, price double, price_state string, currency string, views int, bathrooms int")
    rows = by_id(state.enrich(spark.createDataFrame(old, s), details))
    assert (rows[1].price, rows[1].currency, rows[1].extra) == (600.0, "unknown", {"views": "7", "bathrooms": "3", "latest_price_state": "invalid"})
    assert (rows[2].deal, rows[2].price, rows[2].currency, rows[2].extra) == ("unknown", 700.0, "EUR", {"views": "1", "latest_price_state": "valid"})
    card_rows = spark.createDataFrame([(1, "rent", "a"), (2, "rent", "b"), (3, "rent", "c")], "entity_id long, deal string, title string")
    told = spark.createDataFrame([(1, None, "x"), (2, "sale", None)], "entity_id long, deal string, title string")
    assert {r.entity_id: (r.deal, r.title) for r in state.merge_card_and_detail(card_rows, told).collect()} == {1: (None, "x"), 2: ("sale", "b"), 3: ("rent", "c")}
    at = lambda h: datetime(2024, 1, 1, h)
    reports = spark.createDataFrame([(1, [(5.0, at(8), " EUR "), (6.0, at(9), ""), (0.0, at(10), "EUR")])], "entity_id long, reports array<struct<price:double,reported_at:timestamp,currency:string>>")
    assert [tuple(r) for r in state.daily_reported_prices(reports).collect()] == [(1, D1, 6.0, "unknown", "reported")]


def test_alert_timeline(spark):
    prior = spark.createDataFrame([], "name string, first_seen timestamp_ntz, fired boolean")
    t0, told = datetime(2024, 1, 1), []
    for minute, failing in ((0, True), (10, True), (30, True), (31, False)):
        conditions = spark.createDataFrame([("x", failing)], "name string, failing boolean")
        row = alerts.alert_transitions(conditions, prior, t0 + timedelta(minutes=minute)).collect()[0]
        told.append(row.notice)
        prior = spark.createDataFrame([(row.name, row.first_seen, row.fired)], prior.schema)
    assert told == [None, "fired", None, "resolved"]


def test_streak(spark):
    rows = [("a", k, 1 if k != 4 else 0, 1) for k in range(1, 6)] + [("a", 6, 2, 1), ("a", 7, 1, 1)]
    out = {r.cycle: (r.streak, r.unhealthy) for r in alerts.cycle_health(spark.createDataFrame(rows, "stream string, cycle int, ran int, failed int")).collect()}
    assert out[3] == (3, True) and 4 not in out and out[5] == (4, True) and out[6] == (0, False) and out[7] == (1, False)


def square(w, s, size):
    return [{"x": x, "y": y} for x, y in ((w, s), (w + size, s), (w + size, s + size), (w, s + size), (w, s))]


def test_areas(spark):
    areas = spark.createDataFrame([("B", [[square(17.0, 44.0, 0.1), square(17.04, 44.04, 0.02)]]), ("A", [[square(17.05, 44.0, 0.1)]])], f"name string, polygons array<{geo.RING}>")
    pins = [(1, 44.01, 17.01, None, "old"), (2, 44.05, 17.05 - 0.005, None, "old"), (3, 44.01, 17.06, None, "old"), (4, 44.0, 16.99, None, "old"), (5, 45.0, 17.0, None, "old"), (6, None, None, "b", "old"), (7, 44.05, 17.0, None, "old"), (8, 44.01, 17.01, " A ", "old"), (9, None, None, "", "old")]
    out = {r.entity_id: (r.area_key, r.how) for r in geo.assign_area(spark.createDataFrame(pins, "entity_id long, latitude double, longitude double, source_area string, area_key string"), areas).collect()}
    assert out[1] == ("B", "inside") and out[3] == ("A", "inside") and out[4] == ("B", "near")
    assert out[2][1] == "near" and out[5] == ("old", "kept") and out[6] == ("old", "kept") and out[7] == ("B", "inside")
    assert out[8] == ("A", "name") and out[9] == ("old", "kept")


def test_cells_agree_with_plain_rays(spark):
    """Random rings with a hole: cells, corners and crossings say the same as a ray over all edges."""
    rng = random.Random(3)
    ring = lambda x, y, r, n: (lambda ps: [*ps, ps[0]])([{"x": x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), "y": y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)} for k in range(n)])
    shapes = {f"A{k}": [[ring(17 + 0.03 * k, 44 + 0.02 * (k % 3), 0.03, rng.randint(3, 14)), ring(17 + 0.03 * k, 44 + 0.02 * (k % 3), 0.008, 5)], [ring(17.3 + 0.02 * k, 44.1, 0.011, 6)]] for k in range(6)}
    areas = spark.createDataFrame(list(shapes.items()), f"name string, polygons array<{geo.RING}>")
    pins = [(i, 43.96 + rng.random() * 0.18, 16.95 + rng.random() * 0.5) for i in range(1500)]

    def covered(y, x, rings):
        n = 0
        for r in rings:
            for p, q in zip(r, r[1:]):
                if (p["y"] > y) != (q["y"] > y) and x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]):
                    n += 1
        return n % 2 == 1

    want = {(i, name) for i, y, x in pins for name, polygons in shapes.items() if any(covered(y, x, rings) for rings in polygons)}
    got = {tuple(r) for r in geo.covering(spark.createDataFrame(pins, "entity_id long, latitude double, longitude double"), areas).collect()}
    assert got == want and len(got) > 100


def test_geojson_round_trip(spark):
    text = '{"type": "Polygon", "coordinates": [[[17.00004, 44.0], [17.1, 44.0], [17.1, 44.1], [17.00004, 44.0]]]}'
    df = spark.createDataFrame([("A", text)], "name string, g string").select("name", geo.to_multipolygon(F.col("g")).alias("polygons"))
    assert "[17.0,44.0]" in geo.features(df).first().feature


def test_publish_is_all_or_nothing(spark, tmp_path):
    df = spark.range(3)
    archive.publish({"t": df}, str(tmp_path), 1)
    spark.range(9).write.parquet(f"{tmp_path}/t/version=2")  # a commit that never came
    assert archive.read_latest(spark, str(tmp_path), "t").count() == 3


def test_csv(spark, tmp_path):
    export.export_csv(spark.createDataFrame([("=1", 'a"b', 2)], "x string, y string, z int"), str(tmp_path / "out"))
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part*")))
    assert parts == b'"\'=1","a""b","2"\r\n'


def test_stream_of_snapshots(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    snap = lambda n, key, day, *rows: spark.createDataFrame([(n, key, day, *r) for r in rows], "snapshot_id long, search_key string, day date, " + CARD).coalesce(1).write.mode("append").parquet(landing)
    empty = spark.createDataFrame([], STATE)
    snap(1, "a", D1, card(1), card(2))
    streams.stream_snapshots(spark, landing, store, str(tmp_path / "cp"), empty).awaitTermination()
    snap(2, "a", D2, card(1))
    streams.stream_snapshots(spark, landing, store, str(tmp_path / "cp"), empty).awaitTermination()
    rows = by_id(archive.read_latest(spark, store, "state"))
    assert rows[1].closed_at is None and rows[2].closed_at == D2
    snap(1, "a", D1, card(9))  # older than the store: skipped
    streams.stream_snapshots(spark, landing, store, str(tmp_path / "cp"), empty).awaitTermination()
    assert set(by_id(archive.read_latest(spark, store, "state"))) == {1, 2}


def test_stream_of_several_searches_and_files(spark, tmp_path):
    """A search's first snapshot counts although another search has a later id; a snapshot waits for all its files."""
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")

    def snap(n, key, day, whole, *rows):
        df = spark.createDataFrame([(n, key, day, *r, whole) for r in rows], "snapshot_id long, search_key string, day date, " + CARD + ", snapshot_rows long")
        df.coalesce(1).write.mode("append").parquet(landing)
        streams.stream_snapshots(spark, landing, store, str(tmp_path / "cp"), spark.createDataFrame([], STATE), 1).awaitTermination()
        return by_id(archive.read_latest(spark, store, "state"))

    snap(5, "a", D1, 2, card(1), card(2))
    rows = snap(4, "b", D1, 1, card(3))
    assert set(rows) == {1, 2, 3}
    rows = snap(6, "a", D2, 2, card(1))  # the file with the other card is still to come
    assert rows[2].closed_at is None and rows[2].last_seen == D1
    rows = snap(6, "a", D2, 2, card(2))
    assert rows[1].last_seen == rows[2].last_seen == D2 and all(r.closed_at is None for r in rows.values())
    rows = snap(5, "b", D2, 1, card(4))
    assert rows[3].closed_at == D2 and rows[4].closed_at is None
    assert sorted((r.entity_id, r.on_date) for r in archive.read_prices(spark, store).collect()) == [(1, D1), (2, D1), (3, D1), (4, D2)]


def test_snapshots_of_more_files_than_a_batch_takes(spark, tmp_path):
    """Each snapshot of the registered query lands in more than 16 files, which come in several batches: no row is lost."""
    spark.range(1, 301).selectExpr("id o_orderkey", "cast(1000 + id as double) o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 4)
    try:
        rows = by_id(job_queries.QUERIES["stream_snapshots"](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert set(rows) == {i for i in range(1, 301) if i % 2 == 0 or i % 3 == 0}
    for i, r in rows.items():
        a, b = i % 2 == 0 and i % 10 != 0, i % 3 == 0
        cheaper = a and i % 4 == 0
        assert r.search_keys == ",".join(k for k, held in (("a", a), ("b", b)) if held) and r.price == (1000 + i) * (0.5 if cheaper else 1)
        assert r.closed_at == (None if a or b else date(2001, 7, 31)) and (r.markers, r.events) == (1 + cheaper, int(not a and not b))


def versions_of(folder, table):
    """The version directory of every bucket of a table, and when its files were written."""
    return {str(p.parent.parent.name) + "/" + p.parent.name: p.stat().st_mtime_ns for p in folder.glob(f"{table}/version=*/*/part-*")}


def test_a_small_snapshot_leaves_most_buckets_alone(spark, tmp_path):
    initial = spark.range(1, 2001).selectExpr("id as entity_id", "'t' title", "'u' url", "'sale' deal", "'flats' kind", "null area_key", "'2' rooms", "50D sqm", "1000D price", "20D rate", "'shop' seller", "date'2024-01-01' first_seen", "date'2024-01-01' last_seen", "cast(null as date) closed_at", "cast(null as double) closing_price", "array(if(id % 100 = 0, 'small', 'big')) search_keys")
    initial = spark.createDataFrame(initial.collect(), STATE)
    folder = streams.SnapshotFolder(spark, str(tmp_path), initial, buckets=128, keep=2)
    first = folder.begin()
    before = versions_of(tmp_path, "state")
    got = folder.fold_one(first, cards(spark, *(card(100 * k) for k in range(1, 20)), card(5000)), "small", D2)
    changed = [b for b, at in got.tables["state"].items() if at == got.version]
    assert len(changed) <= 21 and set(before.items()) <= set(versions_of(tmp_path, "state").items())
    rows = by_id(archive.read_latest(spark, str(tmp_path), "state"))
    assert len(rows) == 2001 and rows[2000].closed_at == D2 and rows[1900].last_seen == D2 and rows[1].last_seen == D1
    assert {r.entity_id for r in folder.store.read(got, "members").where("search_key = 'small'").collect()} == {100 * k for k in range(1, 20)} | {5000}
    # A third commit forgets the first: its replaced buckets go, readers of the second still find theirs.
    after = folder.fold_one(got, cards(spark, *(card(100 * k) for k in range(1, 21))), "small", D3)
    assert folder.store.read(got, "state").count() == 2001 and by_id(folder.store.read(after, "state"))[2000].closed_at is None
    gone = {f"version={first.version}/hash_bucket={b}" for b in changed}
    assert not gone & set(versions_of(tmp_path, "state")) and [(r.entity_id, r.event) for r in archive.read_deltas(spark, str(tmp_path), "lifecycle").where("version = 3").orderBy("entity_id").collect()] == [(2000, "reopened"), (5000, "closed")]
    # A version that was written and not committed is not seen.
    spark.range(3).write.parquet(f"{tmp_path}/state/version={after.version + 1}/hash_bucket=0")
    assert archive.read_latest(spark, str(tmp_path), "state").count() == 2001


def test_files_of_waiting_snapshots_are_read_twice_at_most(spark, tmp_path):
    """Twelve files of two snapshots, one a batch: each is read when it lands and when its snapshot is whole."""
    landing, schema = str(tmp_path / "landing"), "snapshot_id long, search_key string, day date, " + CARD + ", snapshot_rows long"
    for k in range(12):
        spark.createDataFrame([(1, "ab"[k % 2], D1, *card(k + 1), 6)], schema).coalesce(1).write.mode("append").parquet(landing)
    folder = streams.SnapshotFolder(spark, str(tmp_path / "store"), spark.createDataFrame([], STATE), 4)
    paths = sorted((tmp_path / "landing").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
    for n, p in enumerate(paths):
        batch = spark.read.schema(streams.CARDS).parquet(str(p)).select("*", F.col("_metadata.file_path").alias("file"))
        folder.fold(batch, n)
        if n == 7:
            folder.fold(batch, n)  # a batch that runs again
            assert [(r.search_key, r.rows_landed, r.snapshot_rows, len(r.files)) for r in streams.pending_snapshots(spark, str(tmp_path / "store")).orderBy("search_key").collect()] == [("a", 4, 6, 4), ("b", 4, 6, 4)]
    assert folder.files_read <= 2 * 12 + 1 and streams.pending_snapshots(spark, str(tmp_path / "store")).count() == 0
    assert set(by_id(archive.read_latest(spark, str(tmp_path / "store"), "state"))) == set(range(1, 13))


def test_boards_over_a_streamed_store(spark, tmp_path):
    """Snapshots in, a board's figures out: the published tables serve as facts."""
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")
    snap = lambda n, day, *rows: spark.createDataFrame([(n, "a", day, *r) for r in rows], "snapshot_id long, search_key string, day date, " + CARD).coalesce(1).write.mode("append").parquet(landing)
    empty = spark.createDataFrame([], facts.ENTITY)
    for n, day, rows in ((1, D1, [card(1), card(2), card(3, 60000.0)]), (2, D2, [card(1, 90000.0), card(3, 60000.0)]), (3, D3, [card(1, 90000.0), card(3, 60000.0), card(4, 600.0, "rent")])):
        snap(n, day, *rows)
        streams.stream_snapshots(spark, landing, store, str(tmp_path / "cp"), empty, buckets=4).awaitTermination()
    runs = spark.createDataFrame([(n, "a", datetime(2023, 1, n), datetime(2024, 1, n), "ok", True, 3) for n in (1, 2, 3)], "run_id long, search_key string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, is_complete boolean, cards int")
    f = facts.published(spark, store, runs, spark.createDataFrame([("a", "A")], "search_key string, name string"))
    board = boards.Board(f, Window(D1 - timedelta(30), D3), D3, datetime(2024, 1, 3, 12))
    one = lambda name: boards.GROUPS[name](board).first()
    assert (one("overview_1").active, one("overview_1").median_sale_ppm2, one("overview_1").median_rent) == (3, 1500, 600)
    assert (one("exits_1").exits, one("exits_1").median_days_on_market) == (1, 1)
    assert one("overview_3").drops == 0 and f.history.count() == 5  # five markers, and no report: details were never read
    assert one("health_25").backlog == 3
    for name, group in boards.GROUPS.items():
        assert group(board).columns, name


def test_one_document_of_all_groups(spark, tmp_path):
    groups = {"many": spark.range(500, numPartitions=7).withColumn("t", F.lit('a"ž\n')), "none": spark.range(0), 'od"d': spark.createDataFrame([(None, 1.5)], "a string, b double"), "sparse": spark.range(90, numPartitions=9).where("id >= 70")}
    export.groups_to_json(groups, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(text) == {"many": [{"id": k, "t": 'a"ž\n'} for k in range(500)], "none": [], 'od"d': [{"a": None, "b": 1.5}], "sparse": [{"id": k} for k in range(70, 90)]}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_reports_are_never_cut(spark):
    assert export.collect_rows(spark.range(1000)).count() == 1
    with pytest.raises(Exception, match="more than 1000 rows"):
        export.collect_rows(spark.range(1001)).collect()


def test_live_alerts_fire_in_silence(spark, tmp_path):
    """One failing row and then nothing: the hold ends by the clock. A good row within the hold takes the alert away."""
    s = streams.live_session(spark)
    schema = "name string, failing boolean, at timestamp"
    s.createDataFrame([("x", True, D1_NOON), ("y", True, D1_NOON), ("y", False, D1_NOON + timedelta(seconds=1)), ("slow", True, D1_NOON)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = s.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.live_alerts(source, {"x": 0.02, "y": 0.02, "slow": 60}).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    told = lambda: sorted((r.name, r.notice) for r in s.read.schema("name string, at timestamp, notice string").parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out" / "_spark_metadata").exists() else []
    try:
        until = time.time() + 60
        while time.time() < until and told() != [("x", "fired")]:
            time.sleep(1)
        assert told() == [("x", "fired")] and q.exception() is None
        s.createDataFrame([("x", False, D1_NOON + timedelta(hours=1))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        until = time.time() + 60
        while time.time() < until and len(told()) < 2:
            time.sleep(1)
        assert told() == [("x", "fired"), ("x", "resolved")]
    finally:
        q.stop()


def test_holds_by_condition(spark):
    """The batch holds each condition for its own minutes, as the streams do."""
    t0 = datetime(2024, 1, 1)
    conditions = spark.createDataFrame([(n, True) for n in (alerts.NO_SUCCESS, alerts.STALE_SEARCH, "z")], "name string, failing boolean")
    prior = conditions.select("name", F.lit(t0).cast("timestamp_ntz").alias("first_seen"), F.lit(False).alias("fired"))
    fired = lambda minutes: {r.name for r in alerts.alert_transitions(conditions, prior, t0 + timedelta(minutes=minutes)).collect() if r.fired}
    assert fired(9) == set() and fired(10) == {alerts.NO_SUCCESS, "z"} and fired(15) == {alerts.NO_SUCCESS, alerts.STALE_SEARCH, "z"}


def test_stream_of_alerts(spark, tmp_path):
    """A hold ends by a timer, also where no further row of the condition comes; holds may differ."""
    t = datetime(2024, 1, 1)
    name = "stale_or_failing_saved_search"
    rows = [("x", f, t + timedelta(minutes=m)) for m, f in ((0, True), (10, True), (30, True), (31, False))] + [("y", True, t), (name, True, t), ("z", True, t + timedelta(minutes=25)), ("w", True, t), ("w", False, t + timedelta(minutes=10)), ("last", False, t + timedelta(minutes=40))]
    spark.createDataFrame(rows, "name string, failing boolean, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("name string, failing boolean, at timestamp").parquet(str(tmp_path / "in"))
    q = streams.stream_alerts(source).writeStream.format("memory").queryName("alerts_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.name, r.at.minute, r.notice) for r in spark.table("alerts_out").collect()) == sorted([("x", 10, "fired"), ("x", 31, "resolved"), ("y", 10, "fired"), (name, 15, "fired"), ("z", 35, "fired")])
