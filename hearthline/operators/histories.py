"""Price histories and lifecycles: window functions, as-of joins and the daily series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from .percentiles import value_range


def by_time():
    return Window.partitionBy("entity_id").orderBy("on_date")


def price_changes(history: DataFrame) -> DataFrame:
    """Each report with the price before it."""
    return history.where("price is not null").withColumn("was", F.lag("price").over(by_time()))


def cuts(history: DataFrame) -> DataFrame:
    return price_changes(history).where("was > price").withColumn("cut_pct", X.rounded(100.0 * (1 - F.col("price") / F.col("was")), 1))


def price_spans(history: DataFrame) -> DataFrame:
    """Each report with the day of the next one."""
    return history.withColumn("next_date", F.lead("on_date").over(by_time()))


def mark_peak(entities: DataFrame, history: DataFrame) -> DataFrame:
    """entities with their highest reported price and the number of steps down."""
    steps = price_changes(history.where("price > 0"))
    peaks = steps.groupBy("entity_id").agg(F.max("price").alias("peak"), X.count_if(F.col("price") < F.col("was")).alias("cuts"))
    return entities.join(peaks, "entity_id", "left")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; Spark limits the rows of a key before the shuffle as well."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of repeated keys in a batch the last row, at the place of the first."""
    rest = [c for c in df.columns if c not in (*keys, ordinal)]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("_r"), F.min(ordinal).alias(ordinal))
    return g.select(*keys, "_r.*", ordinal)


def latest_per_key(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """left with the row of right that comes last for its key, or nulls."""
    rest = [c for c in right.columns if c != key]
    top = right.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return left.join(top, key, "left").select(*left.columns, *(F.col("_r")[c].alias(c) for c in rest if c not in left.columns))


def rank_groups(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(key, rank) of the n largest groups; a limit, not a window over all groups."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).orderBy(F.desc("_c"), key).limit(n)
    return top.select(key, F.row_number().over(Window.orderBy(F.desc("_c"), key)).alias("rank"))


def opening_ask(exits: DataFrame, history: DataFrame, how: str = "inner") -> DataFrame:
    """exits with the price that the cycle opened with: the first report on or after the opening and up to the
    close, else the last one before the opening. Two aggregates over one join, so no ranking of reports."""
    reports = history.where("price > 0").select(F.col("entity_id").alias("_e"), "on_date", F.col("price").alias("_p"))
    slim = exits.select("entity_id", "opened_on", "occurred_on").distinct()
    met = slim.join(reports, (F.col("entity_id") == F.col("_e")) & (F.col("on_date") <= F.col("occurred_on")))
    later = F.col("on_date") >= F.col("opened_on")
    found = met.groupBy("entity_id", "opened_on", "occurred_on").agg(
        F.coalesce(F.min_by("_p", F.when(later, F.col("on_date"))), F.max_by("_p", F.when(~later, F.col("on_date")))).alias("opening_price")
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("entity_id", "opened_on", "occurred_on")]
    out = exits.alias("a").join(found.alias("b"), same, how)
    return out.select("a.*", "b.opening_price")


def paired(exits: DataFrame, history: DataFrame) -> DataFrame:
    """Exits with their opening price and the change to the final one, without implausible pairs."""
    out = opening_ask(exits, history).where("price between 0.5 * opening_price and 2 * opening_price")
    return out.withColumn("change_pct", 100.0 * (F.col("price") / F.col("opening_price") - 1))


def last_before(history: DataFrame, day: date) -> DataFrame:
    """The last positive price of each entity strictly before a day."""
    return history.where((F.col("price") > 0) & (F.col("on_date") < F.lit(day))).groupBy("entity_id").agg(F.max_by("price", "on_date").alias("price"), F.max("on_date").alias("on_date"))


def next_close(openings: DataFrame, closes: DataFrame) -> DataFrame:
    """(entity_id, opened_on, closed_on): the earliest close strictly after each opening. One pass over the union
    in order of time from the end: no join of every opening with every close."""
    o = openings.select("entity_id", F.col("opened_on").alias("day"), F.lit(0).alias("is_close"))
    c = closes.select("entity_id", F.col("occurred_on").alias("day"), F.lit(1).alias("is_close"))
    after = Window.partitionBy("entity_id").orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    days = F.datediff("day", F.lit(date(1970, 1, 1)))
    both = o.unionByName(c).withColumn("day", days)
    closed = both.withColumn("closed", F.min(F.when(F.col("is_close") == 1, F.col("day"))).over(after)).where("is_close = 0")
    as_date = lambda n: F.date_add(F.lit(date(1970, 1, 1)), F.col(n))
    return closed.select("entity_id", as_date("day").alias("opened_on"), as_date("closed").alias("closed_on"))


def spans_to_days(spans: DataFrame, start: date, end: date) -> DataFrame:
    """One row per day from each report to the day before the next, within the bounds."""
    lo = F.greatest("on_date", F.lit(start))
    hi = F.least(F.coalesce(F.date_sub("next_date", 1), F.lit(end)), F.lit(end))
    return spans.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("day", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def days_in_cycle(spans: DataFrame, cycles: DataFrame, start: date, end: date) -> DataFrame:
    """The days of each span (price_spans) on which a cycle (next_close) is open at the end of the day, within the
    bounds; a day counts once per covering cycle. Spans and cycles meet as intervals, so only then rows are spread."""
    c = cycles.select(F.col("entity_id").alias("_e"), "opened_on", "closed_on")
    met = spans.join(c, F.col("entity_id") == F.col("_e"))
    lo = F.greatest("on_date", "opened_on", F.lit(start))
    hi = F.least(F.date_sub("next_date", 1), F.date_sub("closed_on", 1), F.lit(end))
    days = met.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("day", F.explode(F.sequence("_lo", "_hi")))
    return days.drop("_e", "opened_on", "closed_on", "_lo", "_hi")


def value_spans(entities: DataFrame, history: DataFrame, lifecycle: DataFrame, start: date, end: date) -> DataFrame:
    """(price, sqm, lo, hi): in which days of the window a price was in force while a cycle of its entity was open.

    Reports and events are gathered per entity (they are few: one report a day at most), and spans meet cycles as
    intervals, before anything is spread over days. Entities without any report stand with their present price."""
    day = F.col("on_date")
    reports = history.where("price > 0").groupBy("entity_id").agg(
        F.max_by(F.struct(day.alias("d"), F.col("price").alias("p")), F.when(day < F.lit(start), day)).alias("before"),
        F.array_sort(F.collect_list(F.when(day.between(F.lit(start), F.lit(end)), F.struct(day.alias("d"), F.col("price").alias("p"))))).alias("inside"),
    )
    on = lambda event: F.collect_list(F.when(F.col("event") == event, F.col("occurred_on")))
    life = lifecycle.where("event in ('closed', 'reopened')").groupBy("entity_id").agg(on("closed").alias("closes"), on("reopened").alias("opens"))
    rows = entities.select("entity_id", "sqm", F.col("price").alias("_now"), "first_seen").join(reports, "entity_id", "left").join(life, "entity_id", "left")
    none = F.array().cast("array<date>")
    shut = lambda o: F.array_min(F.filter(F.coalesce("closes", none), lambda c: c > o))
    cycles = F.transform(F.concat(F.array("first_seen"), F.coalesce("opens", none)), lambda o: F.struct(o.alias("o"), shut(o).alias("c")))
    first = F.array(F.struct(F.col("first_seen").alias("d"), F.col("_now").alias("p")))
    held = F.filter(F.array("before"), lambda b: b["d"] < F.lit(start))  # without an earlier report there is none
    told = F.when(F.col("inside").isNotNull(), F.concat(held, "inside")).when(F.col("_now") > 0, first)
    rows = rows.select("sqm", cycles.alias("cycles"), told.alias("told")).where("told is not null")
    last = lambda i: F.least(F.coalesce(F.date_sub(F.get("told", i + 1)["d"], 1), F.lit(end)), F.lit(end))
    spans = F.transform("told", lambda t, i: F.struct(F.greatest(t["d"], F.lit(start)).alias("lo"), last(i).alias("hi"), t["p"].alias("p")))
    spans = F.filter(spans, lambda s: s["lo"] <= s["hi"])
    met = lambda s: F.transform(F.col("cycles"), lambda c: F.struct(F.greatest(s["lo"], c["o"]).alias("lo"), F.least(s["hi"], F.date_sub(c["c"], 1)).alias("hi"), s["p"].alias("p")))
    parts = F.filter(F.flatten(F.transform(spans, met)), lambda x: x["lo"] <= x["hi"])
    return rows.select("sqm", F.explode(parts).alias("x")).select(F.col("x.p").alias("price"), "sqm", "x.lo", "x.hi")


def span_counts(spans: DataFrame, value: Column | None = None) -> DataFrame:
    """(x, lo, hi, n): how many items hold a value from lo to hi; items without a value do not count."""
    x = (F.col("price") if value is None else value).cast("double")
    return spans.select(x.alias("x"), "lo", "hi").where("x is not null").groupBy("x", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def changed_counts(kept: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Kept counts after some items changed: those of their spans as they are now are added, as they were taken away. So
    a snapshot costs what it changes, and the history is not read again."""
    signed = kept.unionByName(added).unionByName(removed.withColumn("n", -F.col("n")))
    return signed.groupBy("x", "lo", "hi").agg(F.sum("n").alias("n")).where("n <> 0")


#: The quartiles of a day.
QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def series_of_counts(counts: DataFrame, start: date, end: date) -> DataFrame:
    """Quartiles and count of every day from counts (x, lo, hi, n), without a row for every item and day.

    In each range of values (percentiles.value_range) the items of a day are the sum of what has come and gone until then.
    These sums, ranges times days, tell which ranges hold a day's quartiles; only spans of such a range are laid over
    the days that it matters for."""
    inside = counts.select("x", F.greatest("lo", F.lit(start)).alias("lo"), F.least("hi", F.lit(end)).alias("hi"), "n").where("lo <= hi")
    cells = inside.withColumn("b", value_range(F.col("x")))
    move = F.explode(F.array(F.struct(F.col("lo").alias("day"), F.col("n").alias("d")), F.struct(F.date_add("hi", 1).alias("day"), (-F.col("n")).alias("d")))).alias("e")
    moves = cells.select("b", move).groupBy("b", "e.day").agg(F.sum("e.d").alias("d"))
    in_range = Window.partitionBy("b").orderBy("day")
    steps = moves.select("b", "day", F.sum("d").over(in_range).alias("k"), F.date_sub(F.lead("day").over(in_range), 1).alias("upto")).where("k > 0 and day <= upto")
    held = steps.select("b", "k", F.explode(F.sequence("day", "upto")).alias("day"))
    below = F.sum("k").over(Window.partitionBy("day").orderBy("b")) - F.col("k")
    held = held.select("b", "day", "k", below.alias("before"), F.sum("k").over(Window.partitionBy("day")).alias("total"))
    place = lambda p: F.lit(p) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*(f(place(p)) for p in QUARTILES.values() for f in (F.floor, F.ceil))))
    wanted = held.withColumn("rs", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("k")))).where(F.size("rs") > 0)
    wanted = wanted.select("b", F.col("day"), "before", "total", "rs")  # as many rows as ranks of the days, at most
    near = cells.join(F.broadcast(wanted), "b").where("day between lo and hi").groupBy("day", "b", "x", "before", "total", "rs").agg(F.sum("n").alias("n"))
    low = F.col("before") + F.sum("n").over(Window.partitionBy("day", "b").orderBy("x")) - F.col("n")
    hit = near.withColumn("low", low).select("day", "total", "x", F.explode(F.filter("rs", lambda r: (r >= F.col("low")) & (r < F.col("low") + F.col("n")))).alias("r"))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("x")))
    ends = [c for n, p in QUARTILES.items() for c in (at(F.floor(place(p))).alias(f"_lo_{n}"), at(F.ceil(place(p))).alias(f"_hi_{n}"))]
    days = hit.groupBy("day").agg(F.max("total").alias("listings"), *ends)

    def between(n: str, p: float) -> Column:
        lo, hi, at = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.lit(p) * (F.col("listings") - 1)
        return X.rounded(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi), 2).alias(n)

    return days.select("day", *(between(n, p) for n, p in QUARTILES.items()), "listings")


def daily_state_series(entities: DataFrame, history: DataFrame, lifecycle: DataFrame, start: date, end: date, value: Column | None = None) -> DataFrame:
    """Quartiles and count of the value in force on every day, rebuilt from reports and cycles; a price on a day counts
    once per covering cycle, and a close on the day does not count."""
    return series_of_counts(span_counts(value_spans(entities, history, lifecycle, start, end), value), start, end)


def dense_calendar(movements: DataFrame, start: date, end: date, sums: Sequence[str]) -> DataFrame:
    """One row per day of the range, with zeros where nothing moved."""
    spark = movements.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    g = movements.where(F.col("day").between(F.lit(start), F.lit(end))).groupBy("day").agg(*(F.sum(c).alias(c) for c in sums))
    return days.join(g, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in sums))


def align_series(a: DataFrame, b: DataFrame, on: str, fill: int | None = None) -> DataFrame:
    """Full outer join of two series; gaps become `fill`."""
    out = a.join(b, on, "full")
    return out if fill is None else out.na.fill(fill)


def vs_segment(df: DataFrame, medians: DataFrame, null_safe: Sequence[str], plain: Sequence[str]) -> DataFrame:
    """Rows with their segment's figures: plain keys must be known, null is a segment of its own for the others."""
    on = [F.col(f"a.{k}") == F.col(f"m.{k}") for k in plain] + [F.col(f"a.{k}").eqNullSafe(F.col(f"m.{k}")) for k in null_safe]
    figures = [c for c in medians.columns if c not in (*null_safe, *plain)]
    return df.alias("a").join(medians.alias("m"), on).select("a.*", *(f"m.{c}" for c in figures))


def without_history(df: DataFrame, history: DataFrame) -> DataFrame:
    return df.join(history.select("entity_id").distinct(), "entity_id", "left_anti")


def has_marker(df: DataFrame, markers: DataFrame, after: str) -> DataFrame:
    """Adds has_marker: some marker of the entity lies after the row's date."""
    last = markers.groupBy("entity_id").agg(F.max("on_date").alias("_last"))
    return df.join(last, "entity_id", "left").withColumn("has_marker", F.coalesce(F.col("_last") > F.col(after), F.lit(False))).drop("_last")
