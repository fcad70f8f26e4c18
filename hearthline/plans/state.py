"""State transitions: complete snapshots of searches folded into current state, prices and lifecycle events.

Every function maps DataFrames to DataFrames; nothing is written here. ingest_snapshot returns the new tables
and their deltas together, for sources.archive.publish to make visible at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..operators.histories import first_per_key, last_wins

# -- column policies -------------------------------------------------------------------------------------------------

Policy = Callable[[Column, Column], Column]


def replace(new: Column, old: Column) -> Column:
    return new


def new_first(new: Column, old: Column) -> Column:
    """A null in the batch keeps what is known."""
    return F.coalesce(new, old)


def old_first(new: Column, old: Column) -> Column:
    return F.coalesce(old, new)


def later(new: Column, old: Column) -> Column:
    return F.greatest(new, old)


def add_member(new: Column, old: Column) -> Column:
    """Union of two arrays, in the old one's order."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def merge_map(new: Column, old: Column) -> Column:
    """The new map's entries win; keys are unique, whatever the session says about duplicates."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))


def upsert(target: DataFrame, batch: DataFrame, key: str, rules: dict[str, Policy], default: Policy = replace) -> DataFrame:
    """One full outer join; each column by its policy from the old values alone. Columns that the batch
    lacks stay. Rows of only one side stay as they are."""
    t, b = target.alias("t"), batch.alias("b")
    both = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full")
    out = [F.coalesce(f"b.{key}", f"t.{key}").alias(key)]
    for c in target.columns:
        if c == key:
            continue
        if c not in batch.columns:
            out.append(F.col(f"t.{c}").alias(c))
            continue
        new, old = F.col(f"b.{c}"), F.col(f"t.{c}")
        value = F.when(F.col(f"b.{key}").isNull(), old).when(F.col(f"t.{key}").isNull(), new).otherwise(rules.get(c, default)(new, old))
        out.append(value.alias(c))
    return both.select(*out)


# -- one snapshot ------------------------------------------------------------------------------------------------------

#: Fixed: the attribute by which an item's details declare its kind of offer, and where markers come from.
DECLARED_CODE, SEARCH_SOURCE, REPORTED = "vrsta-oglasa", "search", "reported"


def has_valid_price(price: Column, state: Column) -> Column:
    return price.isNotNull() & ~F.coalesce(state.isin("invalid", "unpriced"), F.lit(False))


def resolve_deal(card: Column, prior: Column, declared: Column) -> Column:
    """A nightly card, then the deal that details derived from the declared kind of offer, then the card; else unknown."""
    kept = F.when(F.coalesce(declared, F.lit(False)) & (prior != "daily_rent"), prior)
    return F.when(card == "daily_rent", card).otherwise(F.coalesce(kept, F.when(card.isin("rent", "sale"), card), F.lit("unknown")))


def carry_price(valid: Column, new: Column, old: Column, same_deal: Column) -> Column:
    """A price that is missing or invalid keeps the one before, unless the deal changed."""
    return F.when(valid, new).when(F.coalesce(same_deal, F.lit(False)), old)


def rate_of(price: Column, sqm: Column, deal: Column) -> Column:
    rate = F.when((deal == "sale") & (price > 0) & (sqm >= 5), X.rounded(price / sqm, 0))
    return F.when(rate.between(1, 15_000), rate)


@dataclass
class Ingested:
    state: DataFrame
    lifecycle: DataFrame  # new events
    markers: DataFrame  # new price markers
    summary: DataFrame  # one row


#: How columns of known items take what a card says; all others are replaced by it.
STATE_RULES: dict[str, Policy] = {
    **{c: new_first for c in ("kind", "rooms", "sqm", "price_text", "latitude", "longitude", "seller", "source_status", "area_key")},
    "renewed_on": later, "extra": merge_map, "search_keys": add_member,
}


def unique_cards(cards: DataFrame) -> DataFrame:
    """Cards of positive ids, one of each: the last by `place`, or as they come where there is no such column."""
    known = cards.where(F.col("entity_id") > 0)
    ordered = known if "place" in cards.columns else known.withColumn("place", F.monotonically_increasing_id())
    return last_wins(ordered, ["entity_id"], "place").drop("place")


def snapshot_rows(state: DataFrame, cards: DataFrame, search_key: str, day: date) -> DataFrame:
    """The state after a complete snapshot of one search, with marks of what changed: _seen, _new, _reopened, _removed,
    _valid, and _deal, _price, _rate as they were.

    Cards come to the state by one full join. A store hands in only the buckets that the snapshot can change."""
    got = unique_cards(cards)
    tagged = got.select("entity_id", *(F.col(c).alias(f"_c_{c}") for c in got.columns if c != "entity_id"), F.lit(True).alias("_seen"))
    both = state.withColumn("_known", F.lit(True)).join(tagged, "entity_id", "full")
    seen, new = F.coalesce("_seen", F.lit(False)), F.col("_known").isNull()
    card = lambda c: F.col(f"_c_{c}") if c in got.columns else F.lit(None)
    declared = F.map_contains_key("characteristics", DECLARED_CODE) if "characteristics" in state.columns else F.lit(False)
    both = both.withColumns({"_deal": F.col("deal"), "_price": F.col("price"), "_rate": F.col("rate"), "_reopened": seen & ~new & F.col("closed_at").isNotNull(), "_new": new, "_valid": seen & has_valid_price(card("price"), card("price_state"))})
    both = both.withColumn("_now", resolve_deal(card("deal").cast("string"), F.col("_deal"), declared))
    both = both.withColumn("_paid", carry_price(F.col("_valid"), card("price").cast(state.schema["price"].dataType), F.col("_price"), F.col("_deal") == F.col("_now")))
    area = F.coalesce(card("sqm").cast("double"), F.col("sqm"))
    facts = {"latest_price_state": F.coalesce(card("price_state"), F.when(F.col("_valid"), "valid").otherwise("unpriced")), "price_basis": card("price_basis"), "category_id": card("category_id")}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items())), lambda e: e["value"].isNotNull())
    said = {"deal": F.col("_now"), "price": F.col("_paid"), "rate": rate_of(F.col("_paid"), area, F.col("_now")), "currency": F.coalesce(card("currency").cast("string"), F.lit("unknown")), "search_keys": F.array(F.lit(search_key)),
            "last_seen": F.lit(day), "closed_at": F.lit(None).cast("date"), "closing_price": F.lit(None).cast("double"), "extra": F.map_from_entries(entries)}
    removed = ~seen & F.coalesce(F.array_contains("search_keys", search_key), F.lit(False))
    out = {"_removed": removed}
    for c, t in state.dtypes:
        value = said[c] if c in said else F.col(f"_c_{c}") if c in got.columns else None
        if c == "first_seen":
            out[c] = F.when(new, F.lit(day)).otherwise(F.col(c))
        elif c != "entity_id" and value is not None:
            value = value.cast(t)
            rest = F.when(removed, F.array_remove(c, search_key)).otherwise(F.col(c)) if c == "search_keys" else F.col(c)
            out[c] = F.when(seen & new, value).when(seen, STATE_RULES.get(c, replace)(value, F.col(c))).otherwise(rest)
    both = both.withColumns(out).withColumn("_seen", seen)
    gone = F.col("_removed") & (F.size("search_keys") == 0) & F.col("closed_at").isNull()
    both = close_where(both, gone, day)
    return both.select(*state.columns, "closing", "_seen", "_new", "_reopened", "_valid", "_deal", "_price", "_rate")


EVENT_COLUMNS = ("entity_id", "event", "occurred_on", "opened_on", "deal", "kind", "area_key", "rooms", "sqm", "price", "title", "url", "latitude", "longitude")


def lifecycle_events(rows: DataFrame, event: str, day: date, reopenings: DataFrame | None = None) -> DataFrame:
    """Snapshot rows of an event. A close opened at the latest reopening up to its day, else when first seen, and its
    price is the closing price."""
    out = rows.withColumns({"event": F.lit(event), "occurred_on": F.lit(day)})
    if event != "closed":
        out = out.withColumn("opened_on", F.lit(None).cast("date"))
    else:
        out = out.withColumn("price", F.col("closing_price"))
        if reopenings is None:
            out = out.withColumn("opened_on", F.col("first_seen"))
        else:
            last = reopenings.where(F.col("occurred_on") <= F.lit(day)).groupBy("entity_id").agg(F.max("occurred_on").alias("_o"))
            out = out.join(last, "entity_id", "left").withColumn("opened_on", F.coalesce("_o", "first_seen"))
    return out.select(*[c for c in EVENT_COLUMNS if c in out.columns])


def price_markers(rows: DataFrame, day: date) -> DataFrame:
    """One row per seen item with a valid price that is new, or whose deal or price changed."""
    changed = F.col("_new") | ~F.col("_deal").eqNullSafe(F.col("deal")) | ~F.col("_price").eqNullSafe(F.col("price"))
    currency = F.col("currency") if "currency" in rows.columns else F.lit("unknown")
    return rows.where(F.col("_valid") & changed).select("entity_id", F.lit(day).alias("on_date"), "price", currency.alias("currency"), F.lit(SEARCH_SOURCE).alias("source"))


def upsert_prices(prices: DataFrame, batch: DataFrame) -> DataFrame:
    """Prices (entity_id, on_date, source, ...) after a batch: of one item, day and source the last write stays."""
    key = ["entity_id", "on_date", "source"]
    return prices.join(batch.select(*key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def drop_membership(state: DataFrame, search_key: str, seen: DataFrame) -> DataFrame:
    """Takes the search's key from members that its new snapshot lacks."""
    ids = seen.select("entity_id", F.lit(True).alias("_seen")).distinct()
    gone = F.array_contains("search_keys", search_key) & F.col("_seen").isNull()
    return state.join(ids, "entity_id", "left").withColumn("search_keys", F.when(gone, F.array_remove("search_keys", search_key)).otherwise(F.col("search_keys"))).drop("_seen")


def close_where(state: DataFrame, gone: Column, day: date) -> DataFrame:
    """Closes rows at their price; `closing` marks them."""
    return state.withColumn("closing", F.coalesce(gone, F.lit(False))).withColumns({"closed_at": F.when(F.col("closing"), F.lit(day)).otherwise(F.col("closed_at")), "closing_price": F.when(F.col("closing"), F.col("price")).otherwise(F.col("closing_price"))})


def close_orphans(state: DataFrame, day: date) -> DataFrame:
    """Closes open items that no search holds any more."""
    return close_where(state, F.col("closed_at").isNull() & (F.size("search_keys") == 0), day)


def outputs(rows: DataFrame, columns: list[str], day: date, reopenings: DataFrame | None = None) -> Ingested:
    """What a snapshot changes, from its snapshot_rows. The median is over the valid prices' rates, after the update."""
    back = lifecycle_events(rows.where("_reopened"), "reopened", day)
    gone = lifecycle_events(rows.where("closing"), "closed", day, reopenings)
    valid = F.col("_valid")
    summary = rows.where("_seen").agg(
        F.count(F.lit(1)).alias("listing_count"), X.rounded(X.median("rate", valid & (F.col("rate") > 0)), 0).alias("median_rate"),
        X.count_if(F.col("_new")).alias("new_count"), X.count_if(valid & (F.col("rate") < F.col("_rate"))).alias("drop_count"),
    )
    return Ingested(rows.select(*columns), back.unionByName(gone), price_markers(rows.where("_seen"), day), summary)


def ingest_snapshot(state: DataFrame, cards: DataFrame, search_key: str, day: date, reopenings: DataFrame | None = None) -> Ingested:
    """A complete snapshot of one search: upsert, reopenings, markers, membership, closings and summary, in this order.

    cards: entity_id, title, url, deal, kind, rooms, sqm, price, price_state and more columns of the state; of cards with
    one id the last by `place` wins. A caller that writes several outputs keeps snapshot_rows and calls outputs."""
    return outputs(snapshot_rows(state, cards, search_key, day), state.columns, day, reopenings)


def sweep(state: DataFrame, active_keys: list[str], day: date) -> DataFrame:
    """Memberships cut down to configured searches, in order; orphans close. Without any configured search nothing changes."""
    if not active_keys:
        return state.withColumn("closing", F.lit(False))
    keys = F.array(*(F.lit(k) for k in active_keys)).cast("array<string>")
    left = F.array_intersect("search_keys", keys)
    cut = F.when(F.size(F.array_except("search_keys", keys)) > 0, F.array_sort(left)).otherwise(F.col("search_keys"))
    return close_orphans(state.withColumn("search_keys", cut), day)


def retire_searches(searches: DataFrame, active_keys: list[str], now) -> DataFrame:
    """Searches that are no longer configured are retired; such as are already keep their time."""
    if not active_keys:
        return searches
    retired = F.when(~F.col("search_key").isin(active_keys), F.lit(now).cast("timestamp_ntz"))
    return searches.withColumn("retired_at", F.coalesce("retired_at", retired))


def sweep_allowed(cycle_runs: DataFrame, configured: DataFrame) -> DataFrame:
    """Per cycle of cycle_runs (cycle, search_key, status, is_complete, cards): not if no card was seen, unless every
    configured search (search_key) ran to an authoritative end and none failed."""
    good = (F.col("status") == "ok") & F.coalesce("is_complete", F.lit(False))
    runs = cycle_runs.join(configured.select("search_key", F.lit(True).alias("_wanted")).distinct(), "search_key", "left")
    g = runs.groupBy("cycle").agg(F.coalesce(F.sum("cards"), F.lit(0)).alias("c"), F.count_distinct(F.when(good & F.col("_wanted"), F.col("search_key"))).alias("ok"), X.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
    wanted = configured.agg(F.count_distinct("search_key").alias("n"))  # one row
    return g.crossJoin(F.broadcast(wanted)).select("cycle", ((F.col("c") > 0) | ((F.col("ok") == F.col("n")) & (F.col("bad") == 0))).alias("allowed"))


# -- details ------------------------------------------------------------------------------------------------------------

#: How columns of known items take what details say; for others a null keeps what is known.
DETAIL_RULES: dict[str, Policy] = {
    **{c: old_first for c in ("sqm", "latitude", "longitude", "rooms", "published_on")}, **{c: replace for c in ("deal", "price", "rate", "first_seen")},
    "renewed_on": later, "extra": merge_map, "currency": replace,
}
#: Fixed: what details tell beyond the columns of an item, and the names that it is kept by.
DETAIL_EXTRA = {
    **{c: c for c in ("rooms_detail", "bathrooms", "floors_total", "unit_levels", "heating", "furnished", "garage", "plot_sqm", "orientation", "views", "favorites")},
    "category_id": "olx_category_id", "price_basis": "price_basis",
}


def enrich(state: DataFrame, details: DataFrame, now=None) -> DataFrame:
    """Details fill what is missing of place, size and rooms, and go first for everything else. A deal that they do not
    know is unknown; a price that is missing or invalid keeps the one before unless the deal changed; the day of
    publication is the first day. now: the time of the fetch, for details_at and attempted_at."""
    prior = state.select("entity_id", *(F.col(c).alias(f"_{c}") for c in ("deal", "price", "sqm", "published_on", "first_seen") if c in state.columns))
    d = details.withColumn("extra", detail_extra(details)) if "extra" in state.columns else details
    d = d.join(prior, "entity_id")
    if "deal" in details.columns:
        d = d.withColumn("deal", F.when(F.col("deal").isin("daily_rent", "rent", "sale"), F.col("deal")).otherwise("unknown"))
        if "price" in details.columns:
            state_of = F.col("price_state") if "price_state" in details.columns else F.lit(None).cast("string")
            d = d.withColumn("price", carry_price(has_valid_price(F.col("price"), state_of), F.col("price"), F.col("_price"), F.col("_deal") == F.col("deal")))
            area = F.coalesce("_sqm", "sqm") if "sqm" in details.columns else F.col("_sqm")
            d = d.withColumn("rate", rate_of(F.col("price"), area, F.col("deal")))
    if "currency" in details.columns:  # without evidence it is unknown, not what a card said
        d = d.withColumn("currency", F.coalesce(F.nullif(F.trim("currency"), F.lit("")), F.lit("unknown")))
    if "published_on" in details.columns and "_published_on" in prior.columns:
        d = d.withColumn("first_seen", F.coalesce("_published_on", "published_on", "_first_seen"))
    if now is not None:
        d = d.withColumns({c: F.lit(now).cast("timestamp_ntz") for c in ("details_at", "attempted_at")})
    return upsert(state, d.select(*[c for c in d.columns if c in state.columns]), "entity_id", DETAIL_RULES, new_first)


def detail_extra(details: DataFrame) -> Column:
    """What details add to an item's further facts: those that they know, as texts, and the state of the latest price."""
    facts = {key: F.col(c) for c, key in DETAIL_EXTRA.items() if c in details.columns}
    told = F.col("price_state") if "price_state" in details.columns else F.lit(None).cast("string")
    paid = F.col("price") if "price" in details.columns else F.lit(None).cast("double")
    facts["latest_price_state"] = F.coalesce(told, F.when(has_valid_price(paid, told), "valid").otherwise("unpriced"))
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items())), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def daily_reported_prices(details: DataFrame, zone: str = "Europe/Sarajevo") -> DataFrame:
    """(entity_id, on_date, price, currency, source): details (entity_id, reports array of price, time and perhaps
    currency); of a local day the last report by time, then by place in the list."""
    each = details.select("entity_id", F.posexplode("reports").alias("place", "r"))
    has_currency = "currency" in details.schema["reports"].dataType.elementType.names
    currency = F.coalesce(F.nullif(F.trim("r.currency"), F.lit("")), F.lit("unknown")) if has_currency else F.lit("unknown")
    each = each.select("entity_id", "place", "r.price", "r.reported_at", currency.alias("currency")).where("price > 0 and reported_at is not null")
    dated = each.withColumn("on_date", X.local_date("reported_at", zone))
    return first_per_key(dated, ["entity_id", "on_date"], [F.desc("reported_at"), F.desc("place")]).select("entity_id", "on_date", "price", "currency", F.lit(REPORTED).alias("source"))


def clear_markers(prices: DataFrame, enriched: DataFrame) -> DataFrame:
    """Prices without the search markers of the enriched items; reported prices stay."""
    ids = enriched.select("entity_id").distinct()
    return prices.where(F.col("source") != SEARCH_SOURCE).unionByName(prices.where(F.col("source") == SEARCH_SOURCE).join(ids, "entity_id", "left_anti"))


def enrichment_queue(state: DataFrame, prices: DataFrame, now, n: int, ids: DataFrame | None = None, refresh_days: int = 7, retry_minutes: int = 720, zone: str = "Europe/Sarajevo") -> DataFrame:
    """The n items whose details are due, with all reasons and the size of the pool: never detailed first, then the
    oldest attempt. Only search markers tell of a changed price, and only priced sales need an area. Items that were
    tried within retry_minutes wait."""
    at = F.lit(now).cast("timestamp_ntz")
    last = prices.where(F.col("source") == SEARCH_SOURCE).groupBy("entity_id").agg(F.max("on_date").alias("_m"))
    s = state.where("closed_at is null")
    s = (s if ids is None else s.join(ids.select("entity_id"), "entity_id", "left_semi")).join(last, "entity_id", "left")
    fetched = F.to_date(F.from_utc_timestamp(F.col("details_at").cast("timestamp"), zone))
    reasons = {
        "unpinned": F.col("latitude").isNull() | F.col("longitude").isNull(), "missing_sqm": F.col("sqm").isNull() & F.col("price").isNotNull() & (F.col("deal") == "sale"),
        "never_detailed": F.col("details_at").isNull(), "stale": F.col("details_at") <= at - F.make_dt_interval(F.lit(refresh_days)), "price_changed": F.col("_m").isNotNull() & (fetched.isNull() | (F.col("_m") >= fetched)),
    }
    s = s.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in reasons.items()})
    rested = F.col("attempted_at").isNull() | (F.col("attempted_at") <= at - F.make_dt_interval(mins=F.lit(retry_minutes)))
    due = s.where(rested & (F.col("unpinned") | F.col("missing_sqm") | F.col("never_detailed") | F.col("stale") | (F.col("price_changed"))))
    top = due.orderBy(F.desc("never_detailed"), F.asc_nulls_first("attempted_at"), "entity_id").limit(n)
    return top.select("entity_id", *reasons).crossJoin(F.broadcast(due.agg(F.count(F.lit(1)).alias("pool_total"))))


def mark_attempts(state: DataFrame, queue: DataFrame, now) -> DataFrame:
    hit = queue.select("entity_id", F.lit(True).alias("_hit"))
    return state.join(hit, "entity_id", "left").withColumn("attempted_at", F.when(F.col("_hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("attempted_at"))).drop("_hit")


def merge_card_and_detail(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Empty details never clear what a card says, but for the deal: one that details leave open is open."""
    d = details.select("entity_id", F.lit(True).alias("_detailed"), *(F.col(c).alias(f"_{c}") for c in details.columns if c != "entity_id"))
    both = cards.join(d, "entity_id", "left")

    def merged(c: str) -> Column:
        if c == "deal":
            return F.when(F.col("_detailed"), F.col("_deal")).otherwise(F.col("deal"))
        kind = cards.schema[c].dataType
        if isinstance(kind, (T.MapType, T.ArrayType)):
            return F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.col(c))
        return F.coalesce(F.nullif(F.col(f"_{c}").cast("string"), F.lit("")).cast(kind), F.col(c))

    return both.withColumns({c: merged(c) for c in cards.columns if c != "entity_id" and c in details.columns}).select(*cards.columns)


# -- runs and pages ---------------------------------------------------------------------------------------------------


#: Fixed texts of a run that was given up.
ABANDONED_ERROR, ABANDONED_REASON = "scraper process stopped before run completion", "abandoned run recovered at startup"


def recover_abandoned_runs(runs: DataFrame, now, minutes: int) -> DataFrame:
    """Running for longer than `minutes` is an error that ended now."""
    at = F.lit(now).cast("timestamp_ntz")
    old = (F.col("status") == "running") & F.col("finished_at").isNull() & (F.col("started_at") < at - F.make_dt_interval(mins=F.lit(minutes)))
    reason = F.col("failure_reason") if "failure_reason" in runs.columns else F.lit(None).cast("string")
    made = {"status": F.lit("error"), "error": F.lit(ABANDONED_ERROR), "finished_at": at, "is_complete": F.lit(False), "failure_reason": F.lit(ABANDONED_REASON)}
    return runs.withColumns({c: F.when(old, v).otherwise(reason if c == "failure_reason" else F.col(c)) for c, v in made.items()})


def has_recent_run(runs: DataFrame, now, minutes: int) -> DataFrame:
    """Searches with a complete success in the last minutes."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    return runs.where((F.col("status") == "ok") & F.col("is_complete") & (F.col("finished_at") > since)).select("search_key").distinct()


def classify_pages(pages: DataFrame) -> DataFrame:
    """Adds response_state. pages: run_id, page, http_status, has_data, total, last_page, current_page, items, and perhaps
    cards (items that are cards; else all), rejected (items that are none) and attempt.

    A page counts only beside the first answer to its run's page 1: with the same total and last page, as the page that was
    asked for, with no item rejected, and with cards unless the whole search is empty."""
    given = lambda c, other: F.coalesce(F.col(c), other) if c in pages.columns else other
    cards, rejected, page, last = given("cards", F.col("items")), given("rejected", F.lit(0)), F.col("page"), F.col("last_page")
    http = F.coalesce("http_status", F.lit(200))
    answered = F.coalesce("has_data", F.lit(False)) & (http < 400)
    first = F.min_by(F.struct("total", "last_page"), F.when(answered & (page == 1), given("attempt", F.lit(1)))).over(Window.partitionBy("run_id"))
    rows = pages.withColumn("_first", first)
    same = (F.col("total") >= 0) & (F.col("total") == F.col("_first.total")) & (last == F.col("_first.last_page"))
    coherent = F.coalesce(same & (last > 0) & (F.col("current_page") == page) & (F.col("current_page") <= last), F.lit(False))
    nothing = (F.col("items") == 0) & (cards == 0) & (rejected == 0)
    odd = (rejected > 0) | ~coherent | ((F.col("items") == 0) & (F.col("total") != 0)) | ((F.col("items") > 0) & (cards == 0))
    state = (
        F.when(http.isin(403, 429), "blocked").when(http >= 400, "error").when(~answered, "malformed")
        .when(coherent & nothing & (F.col("total") == 0) & (page == 1) & (last == 1), "verified_empty").when(odd, "malformed").otherwise("ok")
    )
    return rows.withColumn("response_state", state).drop("_first")


def dedupe_cards(cards: DataFrame) -> DataFrame:
    """The first card of an id by page and place; `repeats` counts the others."""
    order = Window.partitionBy("run_id", "entity_id").orderBy("page", "place")
    every = Window.partitionBy("run_id", "entity_id")
    return cards.withColumns({"_n": F.row_number().over(order), "repeats": F.count(F.lit(1)).over(every) - 1}).where("_n = 1").drop("_n")


def completeness_verdict(pages: DataFrame, cards: DataFrame | None = None, most_pages: int = 30) -> DataFrame:
    """(run_id, verdict): the first reason that holds, or complete. pages: as classified; cards (run_id, entity_id): what
    they hold, so that a card on two pages counts once. Without cards the pages' own numbers are taken."""
    n_cards = F.col("cards") if "cards" in pages.columns else F.col("items")
    g = pages.groupBy("run_id").agg(
        F.bool_or(F.col("response_state") == "malformed").alias("m"), F.bool_or(F.col("response_state").isin("error", "blocked")).alias("f"), F.min(F.when(F.col("last_page") > 0, F.col("last_page"))).alias("last"),
        F.count_distinct("page").alias("n"), F.max(F.when(F.col("page") == 1, F.col("total"))).alias("total"), F.sum(n_cards).alias("unique"), F.bool_or((n_cards == 0) & (F.col("response_state") == "ok")).alias("empty"),
    )
    if cards is not None:
        found = cards.groupBy("run_id").agg(F.count_distinct("entity_id").alias("_unique"))
        g = g.join(found, "run_id", "left").withColumn("unique", F.coalesce("_unique", F.lit(0)))
    short = F.col("empty") | (F.col("n") < F.col("last"))
    verdict = F.when(F.col("m"), "malformed").when(F.col("f"), "failed").when(F.col("last") > most_pages, "capped").when(short, "truncated").when(~F.col("unique").eqNullSafe(F.col("total")), "count_mismatch").otherwise("complete")
    return g.select("run_id", verdict.alias("verdict"))


def run_log(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Start and finish facts of each run in one row; runs without a finish are running."""
    out = started.join(finished, "run_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("running")))


def revive_searches(searches: DataFrame, seen: DataFrame) -> DataFrame:
    """Searches that ran are registered and no longer retired."""
    return upsert(searches, seen.select("search_key", "name", F.lit(None).cast("timestamp_ntz").alias("retired_at")), "search_key", {"name": new_first})
