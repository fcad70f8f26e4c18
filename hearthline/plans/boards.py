"""Boards: named result groups over the facts, under one selection and one reporting window.

A group is a function of a Board; run_board gives a board's groups as lazy DataFrames, so only what is read is
computed. Filters go onto the facts first and reach the scans. Names of result fields are fixed by what readers use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregates as A
from ..operators import comparables as C
from ..operators import histories as H
from ..operators import percentiles as P
from ..operators.filters import Selection, Window, active, attribute, covered_days, cross_filter, either, event_property, exits, filter_populations, furnishing, property_filters, when_covered, where_deal
from ..sources.facts import Facts

GROUPS: dict[str, Callable[[Board], DataFrame]] = {}


@dataclass
class Board:
    facts: Facts
    window: Window
    as_of: date
    now: datetime
    selection: Selection = field(default_factory=Selection)
    subject: C.Manual = field(default_factory=C.Manual)

    @cached_property
    def _filtered(self) -> dict[str, DataFrame]:
        e = property_filters(self.selection.apply(self.facts.entities), self.selection.properties)
        x = event_property(self.selection.apply(exits(self.facts.lifecycle)), self.facts.entities, self.selection.properties)
        return filter_populations({"entities": e, "exits": x}, list(self.selection.cross))

    def all(self, deal: str | None = None) -> DataFrame:
        e = self._filtered["entities"]
        return where_deal(e, self.selection.deal) if deal is None else e.where(F.col("deal").isin(*deal.split()))

    def base(self, deal: str | None = None) -> DataFrame:
        return active(self.all(deal))

    def every_exit(self, deal: str | None = None) -> DataFrame:
        x = self._filtered["exits"]
        x = where_deal(x, self.selection.deal) if deal is None else x.where(F.col("deal").isin(*deal.split()))
        return x.withColumn("final_rate", F.when((F.col("sqm") > 0) & (F.col("deal") == "sale"), F.col("price") / F.col("sqm")))

    def exits(self, deal: str | None = None) -> DataFrame:
        return self.every_exit(deal).where(self.window.holds("occurred_on"))

    def marked(self, deal: str | None = None) -> DataFrame:
        return H.mark_peak(self.base(deal), self.facts.reports)

    @cached_property
    def coverage(self) -> DataFrame:
        """One row: the first covered day."""
        return self.facts.runs.agg(F.min(X.local_date("started_at")).alias("covered_from"))

    def covered(self, one_row: DataFrame) -> DataFrame:
        return one_row.crossJoin(F.broadcast(self.coverage))

    @property
    def days_listed(self) -> Column:
        return F.datediff(F.lit(self.as_of), "first_seen")

    def prev(self, value: Column) -> Column:
        return when_covered(self.window, F.col("covered_from"), value)

    @property
    def days(self) -> Column:
        return covered_days(self.window, F.col("covered_from"))

    def new_counts(self, deal: str | None = None) -> DataFrame:
        w = self.window
        return self.all(deal).agg(X.count_if(w.holds("first_seen")).alias("new_n"), X.count_if(w.previous.holds("first_seen")).alias("_new_prev"))


def group(name: str):
    def put(f: Callable[[Board], DataFrame]):
        GROUPS[name] = f
        return f

    return put


def med(x: str | Column, digits: int = 0, condition: Column | None = None) -> Column:
    return X.rounded(X.median(x, condition), digits)


def positive(x: str) -> Column:
    return F.col(x) > 0


def if_positive(x: str) -> Column:
    return F.when(positive(x), F.col(x))


def share(part: str, base: str, digits: int = 1) -> Column:
    return X.rounded(100.0 * F.col(part) / F.nullif(base, F.lit(0)), digits)


def rows_n() -> Column:
    return F.count(F.lit(1))


def below_peak() -> Column:
    return F.col("price") < F.col("peak")


def cut_size() -> Column:
    return 100 * (1 - F.col("price") / F.col("peak"))


def views() -> Column:
    return X.numeric_value(F.when(F.element_at("extra", "views").rlike("^[0-9]+$"), F.element_at("extra", "views")))


def rent_rate() -> Column:
    return F.when((F.col("sqm") >= 5) & (F.col("price") >= 50), F.col("price") / F.col("sqm"))


def good() -> Column:
    return (F.col("status") == "ok") & F.col("is_complete")


ITEM = ["title", "url", "area_key", "rooms", "sqm", "price"]


# -- comparables (four boards share these) -------------------------------------------------------------------


def subject(b: Board, deal: str | None) -> DataFrame:
    """The reader's subject: its kind of offer where nothing is linked is the board's own, or with None that of the filter;
    its type the single chosen category."""
    chosen = [c for c in b.selection.category if c != "All"] if len(b.selection.category) == 1 else []
    given = b.subject if b.subject.kind or not chosen else replace(b.subject, kind=chosen[0])
    return C.subject_row(b.facts.entities, given, deal or ("rent" if b.selection.deal == "rent" else "sale"))


def comparables(b: Board, deal: str | None) -> DataFrame:
    window = exits(b.facts.lifecycle).where(b.window.holds("occurred_on"))
    return C.comparables(C.pool(b.facts.entities, window, b.as_of), subject(b, deal))


def fair(deal: str | None):
    return lambda b: C.fair_price(comparables(b, deal), subject(b, deal))


def comparable_rows(deal: str | None):
    return lambda b: comparables(b, deal).select("title", "url", "status", "area_key", "rooms", "sqm", "price", "ppm2", "days_listed", "distance_km", "rank")


for prefix, first, table, deal in (("buyer", "1", "7", "sale"), ("pro", "60", "66", None), ("renter", "1", "7", "rent")):
    GROUPS[f"{prefix}_{first}"], GROUPS[f"{prefix}_{table}"] = fair(deal), comparable_rows(deal)


# -- parts that several boards use ------------------------------------------------------------------------------


def recent_cuts(b: Board, deal: str | None, order: list[Column] | None = None) -> DataFrame:
    c = H.cuts(b.facts.reports).where(b.window.holds("on_date")).select("entity_id", "on_date", "was", F.col("price").alias("now"), "cut_pct")
    rows = c.join(b.base(deal), "entity_id").withColumn("days_listed", b.days_listed)
    top = rows.orderBy(F.desc("on_date"), F.desc("cut_pct"), "entity_id").limit(25)
    return top.select("entity_id", "title", "url", "area_key", "rooms", "was", "now", "cut_pct", "on_date", "days_listed")


def newest(b: Board, rows: DataFrame, n: int = 50, *more: str) -> DataFrame:
    return rows.where(b.window.holds("first_seen")).orderBy(F.desc("first_seen"), F.desc("entity_id")).limit(n).select("entity_id", *ITEM, *more, "first_seen")


def by_day_bins(x: DataFrame) -> DataFrame:
    return x.where("days_listed >= 0").groupBy(A.day_bins(F.col("days_listed")).alias("days_bracket")).agg(rows_n().alias("listings"), F.min("days_listed").alias("starts_at"))


def weekly(df: DataFrame, day: str, *values: Column) -> DataFrame:
    return df.groupBy(F.to_date(F.date_trunc("week", day)).alias("week")).agg(*values)


def state_series(b: Board, deal: str, value: Column | None = None) -> DataFrame:
    items = b.all(deal) if value is None else b.all(deal).where("sqm > 0")
    return H.daily_state_series(items, b.facts.reports, b.facts.lifecycle, b.window.start, min(b.window.end, b.as_of), value)


# -- Buy -----------------------------------------------------------------------------------------------------------


@group("buyer_10")
def _(b):
    w = b.window
    now = P.whole(b.marked("sale"), {"active": F.lit(True), "_below": below_peak(), "new_n": w.holds("first_seen")}, {"_price": if_positive("price"), "_rate": if_positive("rate"), "_cut": F.when(below_peak(), cut_size())})
    out = b.covered(now.crossJoin(F.broadcast(b.new_counts("sale").drop("new_n"))))
    return out.select("active", X.rounded("_price", -2).alias("median_price"), X.rounded("_rate", 0).alias("median_ppm2"), share("_below", "active").alias("cut_share_pct"), X.rounded("_cut", 1).alias("median_cut_pct"), "new_n", b.prev(F.col("_new_prev")).alias("new_prev"))


@group("buyer_20")
def _(b):
    fresh = weekly(b.all("sale").where(positive("rate") & b.window.holds_time("first_seen")), "first_seen", med("rate").alias("new_listings"))
    final = b.every_exit("sale").where("sqm >= 5 and price >= 3000").where(b.window.holds_time("occurred_on"))
    return H.align_series(fresh, weekly(final, "occurred_on", med(F.col("price") / F.col("sqm")).alias("final_asks")), "week")


@group("buyer_21")
def _(b):
    fresh = weekly(b.all("sale").where(b.window.holds_time("first_seen")), "first_seen", rows_n().alias("new_n"))
    gone = weekly(b.every_exit("sale").where(b.window.holds_time("occurred_on")), "occurred_on", rows_n().alias("exits"))
    return H.align_series(fresh, gone, "week", 0)


@group("buyer_31")
def _(b):
    p = H.paired(b.exits("sale"), b.facts.reports)
    return p.agg(rows_n().alias("exits_paired"), X.share_pct(F.col("change_pct") < 0).alias("below_first_pct"), med("change_pct", 1).alias("median_final_change_pct"))


@group("buyer_33")
def _(b):
    c = F.col("change_pct")
    band = F.when(c <= -15, "cut 15% or more").when(c <= -5, "cut 5–15%").when(c < 0, "cut under 5%").when(c == 0, "unchanged").otherwise("raised")
    return H.paired(b.exits("sale"), b.facts.reports).groupBy(band.alias("change_band")).agg(rows_n().alias("exits"))


@group("buyer_34")
def _(b):
    return by_day_bins(b.exits("sale"))


@group("buyer_40")
def _(b):
    return b.base("sale").where("rate > 0 and area_key is not null").groupBy("area_key").agg(med("rate").alias("median_ppm2"), rows_n().alias("listings"))


@group("buyer_41")
def _(b):
    sale, rent = F.col("deal") == "sale", (F.col("deal") == "rent") & positive("price")
    m = b.marked("sale rent").withColumn("days_listed", b.days_listed)
    price = sale & positive("price")
    g = m.groupBy(X.known("area_key").alias("area_key")).agg(
        X.count_if(sale).alias("listings"), med("rate", 0, sale & positive("rate")).alias("median_ppm2"), med("price", -2, price).alias("median_price"),
        med("days_listed", 0, sale).alias("median_days_listed"), X.share_pct(sale & below_peak(), sale).alias("cut_share_pct"),
        A.gross_yield(X.median("price", rent), X.median("price", price)).alias("gross_yield_pct"),
    )
    return g.where("listings > 0")


def segment_medians(df: DataFrame, keys: list[str], x: Column | str, n: int) -> DataFrame:
    g = df.groupBy(*keys).agg(X.median(x).alias("segment_median"), F.count(X.col(x)).alias("segment_n"))
    return g.where(F.col("segment_n") >= n)


def below_segment(b: Board, rows: DataFrame, x: str, medians: DataFrame, null_safe: list[str]) -> DataFrame:
    out = H.vs_segment(rows, medians, null_safe, ["area_key"]).where(F.col(x) <= 0.85 * F.col("segment_median"))
    out = out.withColumn("vs_median_pct", X.rounded(100.0 * (F.col(x) / F.col("segment_median") - 1), 1))
    return out.orderBy("vs_median_pct", "entity_id").limit(25).select("entity_id", *ITEM, X.rounded(x, 1).alias(x), "vs_median_pct", "first_seen")


@group("buyer_50")
def _(b):
    base = b.base("sale").where(positive("rate"))
    return below_segment(b, base, "rate", segment_medians(base, ["area_key", "rooms", "kind"], "rate", 5), ["rooms", "kind"])


@group("buyer_51")
def _(b):
    return recent_cuts(b, "sale")


@group("buyer_52")
def _(b):
    rows = b.marked("sale").withColumn("days_listed", b.days_listed).where(below_peak() & (F.col("days_listed") >= 90))
    return rows.orderBy(F.desc("days_listed"), "entity_id").limit(25).select("entity_id", *ITEM, "rate", "days_listed", "cuts", X.rounded(cut_size(), 1).alias("cut_pct"))


# -- Daily rent --------------------------------------------------------------------------------------------------


@group("daily_10")
def _(b):
    w, base = b.window, b.base("daily_rent")
    steps = H.price_changes(b.facts.reports.where("price > 0")).where("price <> was").join(base.select("entity_id"), "entity_id", "left_semi")
    repriced = steps.agg(F.count_distinct(F.when(w.holds("on_date"), F.col("entity_id"))).alias("r"), F.count_distinct(F.when(w.previous.holds("on_date"), F.col("entity_id"))).alias("rp"))
    now = base.agg(rows_n().alias("active"), med("price", 0, positive("price")).alias("median_night"), X.count_if(w.holds("first_seen")).alias("new_n"), X.share_pct(F.col("seller") == "shop", F.col("seller").isNotNull()).alias("agency_share_pct"))
    out = b.covered(now.crossJoin(F.broadcast(repriced)).crossJoin(F.broadcast(b.new_counts("daily_rent").drop("new_n"))))
    of = lambda c: X.rounded(100.0 * F.col(c) / F.nullif("active", F.lit(0)), 1)
    return out.select("active", "median_night", "new_n", b.prev(F.col("_new_prev")).alias("new_prev"), "agency_share_pct", of("r").alias("repriced_pct"), of("rp").alias("repriced_pct_prev"))


@group("daily_20")
def _(b):
    return b.base("daily_rent").where("area_key is not null").groupBy("area_key").agg(med("price", 0, positive("price")).alias("median_night"), rows_n().alias("listings"))


@group("daily_21")
def _(b):
    return b.base("daily_rent").groupBy(X.known("rooms").alias("rooms")).agg(med("price", 0, positive("price")).alias("median_night"), rows_n().alias("listings"))


@group("daily_22")
def _(b):
    p = b.base("daily_rent").withColumn("_night", F.when(positive("price"), F.col("price"))).withColumn("_new", F.when(b.window.holds("first_seen"), 1).otherwise(0))
    at = F.percentile("_night", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p")
    g = p.groupBy(X.known("area_key").alias("area_key")).agg(rows_n().alias("listings"), at, F.sum("_new").alias("new_n"))
    return g.select("area_key", "listings", *(X.rounded(F.col("_p")[k], 0).alias(n) for k, n in enumerate(("p25", "median_night", "p75"))), "new_n")


@group("daily_30")
def _(b):
    band = A.bands(F.col("price"), [(50, "under 50 KM"), (80, "50–79 KM"), (120, "80–119 KM"), (200, "120–199 KM")], "200+ KM")
    return b.base("daily_rent").where(positive("price")).groupBy(band.alias("price_band")).agg(rows_n().alias("listings"), F.min("price").alias("starts_at"))


@group("daily_31")
def _(b):
    return state_series(b, "daily_rent")


@group("daily_40")
def _(b):
    return newest(b, b.base("daily_rent"), 50, "seller")


@group("daily_41")
def _(b):
    return recent_cuts(b, "daily_rent")


# -- Exits ---------------------------------------------------------------------------------------------------------


@group("exits_1")
def _(b):
    w, p = b.window.holds("occurred_on"), b.window.previous.holds("occurred_on")
    rate, days = if_positive("final_rate"), F.col("days_listed")
    x = P.whole(b.every_exit(), {"exits": w, "_xp": p}, {"_r": F.when(w, rate), "_rp": F.when(p, rate), "_d": F.when(w, days), "_dp": F.when(p, days)})
    x = x.select("exits", "_xp", X.rounded("_r", 0).alias("median_exit_ppm2"), X.rounded("_rp", 0).alias("_rp"), X.rounded("_d", 1).alias("median_days_on_market"), X.rounded("_dp", 1).alias("_dp"))
    out = b.covered(x.crossJoin(F.broadcast(b.base().agg(rows_n().alias("_active")))))
    return out.select("exits", b.prev(F.col("_xp")).alias("exits_prev"), "median_exit_ppm2", b.prev(F.col("_rp")).alias("median_exit_ppm2_prev"), "median_days_on_market", b.prev(F.col("_dp")).alias("median_days_on_market_prev"), A.months_of_inventory(F.col("_active"), F.col("exits"), b.days).alias("months_of_inventory"))


@group("exits_6")
def _(b):
    rows = b.exits().where(positive("final_rate")).withColumn("week", F.to_date(F.date_trunc("week", "occurred_on")))
    return A.spread(rows, ["week"], "final_rate", 0, {"p25": 0.25, "median": 0.5, "p75": 0.75})


@group("exits_15")
def _(b):
    rows = H.opening_ask(b.exits().where("price is not null"), b.facts.reports)
    way = F.when(F.col("price") < F.col("opening_price"), "lower").when(F.col("price") > F.col("opening_price"), "higher").otherwise("same")
    g = rows.groupBy(way.alias("direction")).agg(rows_n().alias("listings"))
    return g.withColumn("place", F.array_position(F.array(F.lit("lower"), F.lit("same"), F.lit("higher")), F.col("direction")))


@group("exits_19")
def _(b):
    thousand = lambda x: F.floor(F.col(x) / 1000).cast("long").alias("k")
    share = A.exit_share(b.exits().where(positive("final_rate")).select(thousand("final_rate")), b.base("sale").where(positive("rate")).select(thousand("rate")), ["k"]) if b.selection.deal in ("All", "sale", "sell") else A.exit_share(b.exits().where("false").select(thousand("final_rate")), b.base().where("false").select(thousand("rate")), ["k"])
    k = F.col("k")
    band = F.when(k < 2, "under 2k").when(k >= 6, "6k+").otherwise(F.concat(k.cast("string"), F.lit("–"), (k + 1).cast("string"), F.lit("k")))
    g = share.groupBy(band.alias("ppm2_band")).agg(F.sum("exits").alias("exits"), F.sum("active").alias("active"))
    return g.withColumn("exit_ratio", X.rounded(100.0 * F.col("exits") / F.nullif(F.col("exits") + F.col("active"), F.lit(0)), 1))


@group("exits_18")
def _(b):
    return H.paired(b.exits().where("price is not null"), b.facts.reports).select(F.col("days_listed").cast("double").alias("days_listed"), X.rounded("change_pct", 4).alias("final_change_pct"), "title", "url", "entity_id")


@group("exits_7")
def _(b):
    return by_day_bins(b.exits())


@group("exits_10")
def _(b):
    return A.spread(b.exits().where("days_listed >= 0").withColumn("rooms", X.known("rooms")), ["rooms"], "days_listed", count="exits")


@group("exits_12")
def _(b):
    return b.exits().where("latitude is not null and longitude is not null").select("latitude", "longitude", "title", "url", F.col("price").alias("closing_price"), X.rounded("final_rate", 2).alias("closing_ppm2"), "days_listed")


@group("exits_20")
def _(b):
    return A.exit_share(b.exits().where("area_key is not null"), b.base().where("area_key is not null"), ["area_key"])


@group("exits_9")
def _(b):
    last = b.exits().orderBy(F.desc("occurred_on"), F.desc("entity_id"), F.desc("opened_on")).limit(50)  # before the as-of join
    rows = H.opening_ask(last, b.facts.reports, "left")
    return rows.select("entity_id", *ITEM[:5], "opening_price", F.col("price").alias("final_asking_price"), X.rounded(100.0 * (F.col("price") / F.col("opening_price") - 1), 1).alias("final_change_pct"), X.rounded("final_rate", 0).alias("closing_ppm2"), "opened_on", "occurred_on", "days_listed")


@group("exits_21")
def _(b):
    gone, here = (df.where("area_key is not null").select("area_key", X.known("rooms").alias("rooms")) for df in (b.exits(), b.base()))
    top = H.rank_groups(gone.unionByName(here), "area_key")
    share = A.exit_share(gone, here, ["area_key", "rooms"]).where("exits + active >= 5")
    return share.join(F.broadcast(top), "area_key")


# -- Health --------------------------------------------------------------------------------------------------------


def since(b: Board) -> Column:
    return F.col("started_at") > F.lit(b.window.start).cast("timestamp_ntz")


def in_time(b: Board) -> Column:
    return b.window.holds_time("started_at")


def seconds_between(a: Column | str, z: Column | str) -> Column:
    micros = lambda c: F.unix_micros(X.col(c).cast("timestamp"))
    return (micros(z) - micros(a)) / 1e6


def instant(b: Board) -> Column:
    return F.lit(b.now).cast("timestamp_ntz")


@group("health_2")
def _(b):
    ok, error, recent = F.col("status") == "ok", F.col("status") == "error", since(b)
    g = b.facts.runs.agg(
        X.count_if(error & recent).alias("failed_runs"), X.count_if(ok & recent).alias("_ok"), X.count_if((ok | error) & recent).alias("_finished"), F.max(F.when(good(), F.col("finished_at"))).alias("_last"),
        F.coalesce(F.sum(F.when(ok & recent, F.col("cards"))), F.lit(0)).alias("cards"), X.count_if(~F.col("is_complete") & (ok | error) & F.col("finished_at").isNotNull() & recent).alias("incomplete"),
    )
    return g.select("failed_runs", X.rounded(100.0 * F.col("_ok") / F.nullif("_finished", F.lit(0)), 0).alias("success_rate"), X.rounded(seconds_between("_last", instant(b)), 0).alias("seconds_since_success"), "cards", "incomplete")


@group("health_1")
def _(b):
    return b.facts.searches.where("retired_at is null").agg(rows_n().alias("searches"))


@group("health_25")
def _(b):
    due = lambda c, rest: F.col(c).isNull() | (F.col(c) < instant(b) - rest)
    rows = active(b.facts.entities).where(due("details_at", F.make_dt_interval(days=F.lit(7))) & due("attempted_at", F.make_dt_interval(hours=F.lit(12))))
    return rows.agg(rows_n().alias("backlog"))


@group("health_26")
def _(b):
    bad = F.element_at("extra", "latest_price_state").isin("invalid", "conflict")
    return b.facts.entities.where(bad & (F.col("last_seen") > F.lit(b.window.start))).agg(rows_n().alias("invalid_latest"))


def hourly(b: Board, *values: Column) -> DataFrame:
    return b.facts.runs.where(in_time(b)).groupBy(F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("hour")).agg(*values)


@group("health_7")
def _(b):
    return hourly(b, *(X.count_if(F.col("status") == s).alias(s) for s in ("ok", "error", "running")))


@group("health_8")
def _(b):
    return hourly(b, X.rounded(F.avg("cards"), 0).alias("avg_cards"))


@group("health_22")
def _(b):
    took = seconds_between("started_at", "finished_at")
    return hourly(replace(b, facts=replace(b.facts, runs=b.facts.runs.where("finished_at is not null"))), X.rounded(F.avg(took) / 60.0, 1).alias("avg_min"), X.rounded(F.max(took) / 60.0, 1).alias("max_min"))


@group("health_14")
def _(b):
    known = lambda c: F.col(c).isNotNull()
    return A.coverage_pct(active(b.facts.entities), {"pinned_pct": known("latitude") & known("longitude"), "details_pct": known("details_on"), "priced_pct": positive("rate"), "api_status_pct": known("source_status")})


@group("health_18")
def _(b):
    rows = b.facts.entities.where(F.col("last_seen") > F.lit(b.window.start))
    return rows.groupBy(F.coalesce("source_status", F.lit("(not exposed)")).alias("source_says"), F.when(F.col("closed_at").isNotNull(), "closed").otherwise("open").alias("we_say")).agg(rows_n().alias("listings"))


@group("health_28")
def _(b):
    rows = H.latest_per_key(b.facts.searches.where("retired_at is null"), b.facts.runs, "search_key", "run_id")
    age = seconds_between("finished_at", instant(b))
    phase = F.when(F.col("status") == "error", "failed").when(F.col("status") == "running", "running").when(age > 26 * 3600, "stale").otherwise(F.coalesce("status", F.lit("never")))
    return rows.select("name", "search_key", phase.alias("phase"), X.rounded(age / 60, 0).alias("age_min"), "started_at", "finished_at", "error", "url")


@group("health_19")
def _(b):
    took = seconds_between("started_at", "finished_at")
    rows = b.facts.runs.where(F.col("finished_at").isNotNull() & in_time(b)).join(b.facts.searches.select("search_key", "name"), "search_key")
    return rows.groupBy("name").agg(rows_n().alias("runs"), X.rounded(F.avg(took), 0).alias("avg_s"), X.rounded(F.max(took), 0).alias("max_s"))


@group("health_21")
def _(b):
    return A.error_patterns(b.facts.runs.where(since(b)))


@group("health_12")
def _(b):
    return b.facts.runs.orderBy(F.desc("run_id")).limit(50).select("run_id", "search_key", "status", "pages", "cards", "started_at", "finished_at", "error")


# -- Home ----------------------------------------------------------------------------------------------------------


@group("home_2")
def _(b):
    e, open_ = b.facts.entities, F.col("closed_at").isNull()
    flat = F.lit(True) if "All" in b.selection.category else F.coalesce(F.col("kind").isin(*b.selection.category), F.lit(False))
    w, sale = b.window, (F.col("deal") == "sale")
    rate, price, rent = if_positive("rate"), if_positive("price"), F.col("deal") == "rent"
    medians = {"_r": F.when(open_ & flat & sale, rate), "_m": F.when(open_ & flat & rent, price), "_p": F.when(open_ & flat & sale, price), "_n": F.when(flat & sale & w.holds("first_seen"), rate), "_np": F.when(flat & sale & w.previous.holds("first_seen"), rate)}
    g = P.whole(e, {"active": open_, "_x": w.holds("closed_at")}, medians)
    return b.covered(g).select("active", X.rounded("_r", 0).alias("median_sale_ppm2"), X.rounded("_m", 0).alias("median_rent"), A.gross_yield(F.col("_m"), F.col("_p")).alias("gross_yield_pct"), A.months_of_inventory(F.col("active"), F.col("_x"), b.days).alias("months_of_inventory"), X.rounded("_n", 0).alias("new_sale_ppm2"), b.prev(X.rounded("_np", 0)).alias("new_sale_ppm2_prev"))


@group("home_13")
def _(b):
    e = b.facts.entities
    moves = e.select(F.col("first_seen").alias("day"), F.lit(1).alias("new_n"), F.lit(0).alias("closed_n")).unionByName(e.where("closed_at is not null").select(F.col("closed_at").alias("day"), F.lit(0).alias("new_n"), F.lit(1).alias("closed_n")))
    return H.dense_calendar(moves, b.window.start, b.window.end, ["new_n", "closed_n"])


@group("home_9")
def _(b):
    return b.facts.runs.agg(X.rounded(seconds_between(F.max(F.when(good(), F.col("finished_at"))), instant(b)) / 60, 0).alias("minutes_since_success"))


# -- Market overview ------------------------------------------------------------------------------------------------


def sales(b: Board) -> DataFrame:
    return b.base().where((F.col("deal") == "sale") & positive("rate"))


@group("overview_1")
def _(b):
    now = P.whole(b.base(), {"active": F.lit(True)}, {"_r": F.when(F.col("deal") == "sale", if_positive("rate")), "_m": F.when(F.col("deal") == "rent", if_positive("price"))})
    now = now.select("active", X.rounded("_r", 0).alias("median_sale_ppm2"), X.rounded("_m", 0).alias("median_rent"))
    out = b.covered(now.crossJoin(F.broadcast(b.new_counts())).crossJoin(F.broadcast(b.exits().agg(rows_n().alias("_x")))))
    return out.select("active", "new_n", b.prev(F.col("_new_prev")).alias("new_prev"), "median_sale_ppm2", "median_rent", A.months_of_inventory(F.col("active"), F.col("_x"), b.days).alias("months_of_inventory"))


@group("overview_3")
def _(b):
    base, w = b.base(), b.window
    c = H.cuts(b.facts.reports).withColumn("_raw", 100.0 * (F.col("was") - F.col("price")) / F.col("was")).join(base.select("entity_id"), "entity_id", "left_semi")
    g = c.agg(F.count_distinct(F.when(w.holds("on_date"), F.col("entity_id"))).alias("drops"), F.count_distinct(F.when(w.previous.holds("on_date"), F.col("entity_id"))).alias("_dp"), F.count_distinct("entity_id").alias("_all"), med("_raw", 1, w.holds("on_date")).alias("median_cut_pct"))
    out = b.covered(g.crossJoin(F.broadcast(base.agg(rows_n().alias("_n")))))
    return out.select("drops", b.prev(F.col("_dp")).alias("drops_prev"), X.rounded(100.0 * F.col("_all") / F.nullif("_n", F.lit(0)), 0).alias("cut_share_pct"), "median_cut_pct")


@group("overview_7")
def _(b):
    return state_series(b, "sale", F.col("price") / F.col("sqm"))


@group("overview_21")
def _(b):
    return A.spread(sales(b).withColumn("rooms", X.known("rooms")), ["rooms"], "rate")


@group("overview_29")
def _(b):
    f = F.col("floor_num")
    band = F.when(f.isNull(), "unknown").when(f < 0, "basement").when(f == 0, "ground").when(f <= 2, "1–2").when(f <= 5, "3–5").otherwise("6+")
    return A.spread(sales(b).withColumn("floor_band", band), ["floor_band"], "rate")


@group("overview_26")
def _(b):
    return sales(b).where("sqm > 0").select(F.col("sqm").alias("area"), F.col("rate").alias("ppm2"), "area_key", "title", "url")


@group("overview_33")
def _(b):
    rows = sales(b).where("area_key is not null")
    g = rows.join(F.broadcast(H.rank_groups(rows, "area_key")), "area_key").groupBy("area_key", X.known("rooms").alias("rooms"), "rank").agg(rows_n().alias("listings"), med("rate").alias("median_ppm2"))
    return A.having_min_n(g, 3)


@group("overview_35")
def _(b):
    fresh = weekly(b.all().where(b.window.holds("first_seen")), "first_seen", rows_n().alias("new_n"))
    return H.align_series(fresh, weekly(b.exits(), "occurred_on", rows_n().alias("closed_n")), "week", 0)


@group("overview_8")
def _(b):
    return b.base().where("deal = 'sale'").groupBy(X.known("rooms").alias("rooms")).agg(rows_n().alias("listings"))


@group("overview_32")
def _(b):
    g = A.spread(sales(b).withColumn("area_key", X.known("area_key")), ["area_key"], "rate")
    return g.orderBy(F.desc("listings"), "area_key").limit(15).orderBy(F.desc("median"), "area_key")


@group("overview_22")
def _(b):
    return b.base().where("deal = 'sale' and kind is not null").groupBy(F.col("kind").alias("segment")).agg(rows_n().alias("listings"), med("rate", 0, positive("rate")).alias("median_ppm2"))


@group("overview_30")
def _(b):
    return b.base().where("deal = 'sale'").groupBy(X.known("seller").alias("seller")).agg(rows_n().alias("listings"), med("rate", 0, positive("rate")).alias("median_ppm2"))


@group("overview_13")
def _(b):
    return b.base().where("latitude is not null and longitude is not null").select("latitude", "longitude", *ITEM, F.when(F.col("deal") == "sale", F.col("rate")).alias("ppm2"), "last_seen")


@group("overview_16")
def _(b):
    medians = segment_medians(sales(b).where("area_key is not null"), ["area_key"], "rate", 5)
    rows = H.vs_segment(sales(b).where("sqm >= 20"), medians, [], ["area_key"]).withColumn("_v", X.rounded(F.col("rate") / F.col("segment_median"), 6))
    return rows.orderBy("_v", "entity_id").limit(25).select("entity_id", *ITEM, "rate", X.rounded(100 * (F.col("rate") / F.col("segment_median") - 1), 0).alias("vs_median_pct"))


@group("overview_17")
def _(b):
    return recent_cuts(b, None)


@group("overview_11")
def _(b):
    return b.base().orderBy("first_seen", "entity_id").limit(25).select("entity_id", *ITEM, "rate", b.days_listed.alias("days_listed"), "last_seen")


@group("overview_23")
def _(b):
    rows = b.base().withColumn("views", views()).where("views is not null")
    rows = rows.withColumn("views_per_day", X.rounded(F.col("views") / F.greatest(b.days_listed, F.lit(1)), 1))
    return rows.orderBy(F.desc("views_per_day"), F.desc("views"), "entity_id").limit(25).select("entity_id", *ITEM, "views", "views_per_day")


# -- Market intelligence ----------------------------------------------------------------------------------------------


@group("pro_1")
def _(b):
    m = P.whole(b.marked(), {"active": F.lit(True), "_below": below_peak(), "new_n": b.window.holds("first_seen")}, {"_cut": F.when(below_peak(), cut_size()), "_views": views()})
    m = m.select("active", share("_below", "active").alias("cut_share_pct"), X.rounded("_cut", 1).alias("median_cut_pct"), X.rounded("_views", 0).alias("median_views"), "new_n")
    w, p = b.window.holds("occurred_on"), b.window.previous.holds("occurred_on")
    x = P.whole(b.every_exit(), {"exits": w, "_xp": p}, {"_d": F.when(w, F.col("days_listed"))}).select("exits", "_xp", X.rounded("_d", 0).alias("median_days_on_market"))
    out = b.covered(m.crossJoin(F.broadcast(x)).crossJoin(F.broadcast(b.new_counts().drop("new_n"))))
    return out.select("active", "new_n", b.prev(F.col("_new_prev")).alias("new_prev"), "exits", b.prev(F.col("_xp")).alias("exits_prev"), A.months_of_inventory(F.col("active"), F.col("exits"), b.days).alias("months_of_inventory"), "median_days_on_market", "cut_share_pct", "median_cut_pct", "median_views")


@group("pro_10")
def _(b):
    here = b.base().where("area_key is not null").groupBy("area_key").agg(rows_n().alias("active"))
    gone = b.exits().groupBy("area_key").agg(rows_n().alias("_x"))
    out = b.covered(here.join(gone, "area_key", "left"))
    return out.select("area_key", A.months_of_inventory(F.col("active"), F.col("_x"), b.days).alias("months_of_inventory"), "active", F.coalesce("_x", F.lit(0)).alias("exits"))


@group("pro_11")
def _(b):
    area = X.known("area_key").alias("area_key")
    gone = b.exits().groupBy(area).agg(rows_n().alias("_x"), med("days_listed").alias("median_days_on_market"))
    here = b.marked().groupBy(area).agg(
        rows_n().alias("active"), X.count_if(b.window.holds("first_seen")).alias("new_n"), med("rate", 0, (F.col("deal") == "sale") & positive("rate")).alias("median_ppm2"),
        med("price", 0, (F.col("deal") == "rent") & (F.col("price") >= 50)).alias("median_rent"), med(views()).alias("median_views"), X.share_pct(below_peak()).alias("cut_share_pct"),
    )
    out = b.covered(here.join(gone, "area_key", "left"))
    return out.select("area_key", "active", "new_n", F.coalesce("_x", F.lit(0)).alias("exits"), A.months_of_inventory(F.col("active"), F.col("_x"), b.days).alias("months_of_inventory"), "median_ppm2", "median_rent", "median_days_on_market", "median_views", "cut_share_pct")


@group("pro_20")
def _(b):
    keys = ["area_key", "rooms", "deal"]
    rate = F.when((F.col("sqm") >= 5) & positive("price"), F.col("price") / F.col("sqm"))
    medians = segment_medians(b.base().withColumn("_r", rate).where("_r is not null"), keys, "_r", 5)
    rows = H.vs_segment(H.paired(b.exits(), b.facts.reports).where("sqm >= 5"), medians, ["rooms"], ["area_key", "deal"])
    rows = rows.withColumn("gap", 100.0 * (F.col("opening_price") / F.col("sqm") / F.col("segment_median") - 1))
    band = F.when(F.col("gap") < -5, "below segment").when(F.col("gap") <= 5, "within ±5%").when(F.col("gap") <= 15, "5–15% above").otherwise("over 15% above")
    return rows.groupBy(band.alias("pricing_band")).agg(med("days_listed").alias("median_days"), rows_n().alias("exits"), X.share_pct(F.col("change_pct") < 0).alias("cut_first_pct"))


@group("pro_21")
def _(b):
    return H.paired(b.exits(), b.facts.reports).select(F.col("days_listed").cast("double").alias("days_listed"), X.rounded("change_pct", 4).alias("final_change_pct"), "title", "url", "area_key")


@group("pro_30")
def _(b):
    return b.base().groupBy(X.known("seller").alias("seller")).agg(rows_n().alias("listings"))


@group("pro_31")
def _(b):
    area = X.known("area_key").alias("area_key")
    sellers = b.facts.entities.select("entity_id", "seller")
    gone = b.exits().join(sellers, "entity_id").groupBy(area).agg(*(med("days_listed", 0, F.col("seller") == s).alias(n) for n, s in (("agency_median_days", "shop"), ("private_median_days", "private"))))
    here = b.base().groupBy(area).agg(rows_n().alias("active"), *(X.share_pct(F.col("seller") == s).alias(n) for n, s in (("agency_share_pct", "shop"), ("private_share_pct", "private"))))
    return here.join(gone, "area_key", "left")


@group("pro_40")
def _(b):
    rows = b.marked().where("seller = 'private'").withColumn("days_listed", b.days_listed).where("days_listed >= 60 or cuts >= 2")
    top = rows.orderBy(F.desc_nulls_first("cuts"), F.desc("days_listed"), "entity_id").limit(50)
    return top.select("entity_id", *ITEM, "rate", "days_listed", "cuts", X.rounded(cut_size(), 1).alias("cut_pct"), views().alias("views"))


@group("pro_41")
def _(b):
    return newest(b, b.base().where("seller = 'private'"), 50, "rate")


@group("pro_50")
def _(b):
    sale, rent = (F.col("deal") == "sale"), (F.col("deal") == "rent") & (F.col("price") >= 50)
    sale_price, rent_price = X.median("price", sale & (F.col("price") >= 3000)), X.median("price", rent)
    g = b.base("sale rent").where("price > 0").groupBy(X.known("area_key").alias("area_key"), X.known("rooms").alias("rooms")).agg(X.count_if(sale).alias("sale_listings"), X.count_if(rent).alias("rent_listings"), X.rounded(sale_price, -2).alias("median_sale_price"), X.rounded(rent_price, 0).alias("median_rent"), A.gross_yield(rent_price, sale_price).alias("gross_yield_pct"))
    return g.where("sale_listings >= 3 and rent_listings >= 3")


# -- Rent ------------------------------------------------------------------------------------------------------------


@group("renter_10")
def _(b):
    now = b.base("rent").agg(rows_n().alias("active"), med("price", 0, F.col("price") >= 50).alias("median_rent"), med(rent_rate(), 1).alias("median_rent_ppm2"), X.count_if(b.window.holds("first_seen")).alias("new_n"))
    x = b.exits("rent").agg(med("days_listed").alias("median_days_to_exit"))
    out = b.covered(now.crossJoin(F.broadcast(x)).crossJoin(F.broadcast(b.new_counts("rent").drop("new_n"))))
    return out.withColumn("new_prev", b.prev(F.col("_new_prev"))).drop("_new_prev", "covered_from")


@group("renter_20")
def _(b):
    return b.base("rent").where("price >= 50 and area_key is not null").groupBy("area_key").agg(med("price").alias("median_rent"), rows_n().alias("listings"))


@group("renter_21")
def _(b):
    return b.base("rent").where("price >= 50").groupBy(X.known("rooms").alias("rooms")).agg(med("price").alias("median_rent"), rows_n().alias("listings"))


@group("renter_22")
def _(b):
    area = X.known("area_key").alias("area_key")
    gone = b.exits("rent").groupBy(area).agg(med("days_listed").alias("median_days_to_exit"))
    here = b.base("rent").groupBy(area).agg(rows_n().alias("listings"), med("price", 0, F.col("price") >= 50).alias("median_rent"), med(rent_rate(), 1).alias("median_rent_ppm2"), X.count_if(b.window.holds("first_seen")).alias("new_n"))
    return here.join(gone, "area_key", "left")


@group("renter_30")
def _(b):
    flags = {
        "Furnished": furnishing(), "Pets allowed": attribute("kucni-ljubimci"), "Bills included": attribute("ukljucen-trosak-rezija"), "Parking": either("parking", "parking"), "Air conditioning": attribute("klima"),
        "Lift": either("elevator", "lift"), "Balcony": attribute("balkon"), "Suitable for students": attribute("za-studente"),
    }
    return A.premium_by_flag(b.base("rent").where("price >= 50"), flags)


@group("renter_40")
def _(b):
    return by_day_bins(b.exits("rent"))


@group("renter_41")
def _(b):
    gone, here = (df.select(X.known("rooms").alias("rooms")) for df in (b.exits("rent"), b.base("rent")))
    return A.exit_share(gone, here, ["rooms"]).select("rooms", "exit_ratio")


@group("renter_50")
def _(b):
    return newest(b, b.base("rent").withColumn("rent_ppm2", X.rounded(rent_rate(), 1)), 50, "rent_ppm2")


@group("renter_51")
def _(b):
    rows = b.base("rent").withColumn("rent_ppm2", rent_rate())
    return below_segment(b, rows, "rent_ppm2", segment_medians(rows, ["area_key", "rooms"], "rent_ppm2", 5), ["rooms"])


@group("renter_52")
def _(b):
    return recent_cuts(b, "rent")


BOARDS = {name: [g for g in GROUPS if g.startswith(name + "_")] for name in ("home", "overview", "exits", "buyer", "renter", "daily", "pro", "health")}


def run_board(board: Board, name: str, only: list[str] | None = None, cross: list[tuple] = ()) -> dict[str, DataFrame]:
    """The board's groups, each as a lazy DataFrame; cross predicates go onto a group's rows where it has the column."""
    out = {g: GROUPS[g](board) for g in BOARDS[name] if only is None or g in only}
    return {g: cross_filter(df, [p for p in cross if p[0] in df.columns]) for g, df in out.items()}
