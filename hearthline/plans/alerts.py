"""Alert conditions and the state machine that turns them into notices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_if
from ..operators.histories import latest_per_key


#: Fixed names of the two conditions, and the minutes that each is held before it fires.
NO_SUCCESS, STALE_SEARCH = "no_successful_scrape_26h", "stale_or_failing_saved_search"
HOLD_MINUTES = {NO_SUCCESS: 10, STALE_SEARCH: 15}
OTHER_MINUTES = 10
Holds = float | dict[str, float]


def hold_of(name: str, holds: Holds) -> float:
    """The minutes of one condition: the batch and the streams share this table."""
    return holds.get(name, OTHER_MINUTES) if isinstance(holds, dict) else holds


def ago(now: datetime, hours: int):
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))


def no_recent_success(runs: DataFrame, now: datetime, hours: int = 26) -> DataFrame:
    """One row: failing if no good run started in the window."""
    good = (F.col("status") == "ok") & (F.col("started_at") > ago(now, hours))
    return runs.agg(F.lit(NO_SUCCESS).alias("name"), (count_if(good) == 0).alias("failing"), count_if(good).alias("good_runs"))


def stale_searches(searches: DataFrame, runs: DataFrame, now: datetime, hours: int = 26) -> DataFrame:
    """Live searches whose last complete success is missing or too old."""
    good = runs.where("status = 'ok' and is_complete").select("search_key", F.col("finished_at").alias("last_success"))
    rows = latest_per_key(searches.where("retired_at is null"), good, "search_key", "last_success")
    return rows.where(F.col("last_success").isNull() | (F.col("last_success") < ago(now, hours))).select("search_key", "last_success")


def alert_conditions(searches: DataFrame, runs: DataFrame, now: datetime, hours: int = 26) -> DataFrame:
    """(name, failing) of the two conditions, one row each."""
    stale = stale_searches(searches, runs, now, hours).agg(F.lit(STALE_SEARCH).alias("name"), (F.count(F.lit(1)) > 0).alias("failing"))
    return no_recent_success(runs, now).select("name", "failing").unionByName(stale)


def alert_transitions(conditions: DataFrame, prior: DataFrame, now: datetime, hold_minutes: Holds = HOLD_MINUTES) -> DataFrame:
    """conditions (name, failing), prior (name, first_seen, fired) -> new state and notice (fired, resolved or null).

    A condition fires once it has failed for the hold; it is told once, and once more when it is over."""
    t = F.lit(now).cast("timestamp_ntz")
    both = conditions.join(prior, "name", "full").withColumns({"failing": F.coalesce("failing", F.lit(False)), "was": F.coalesce("fired", F.lit(False))})
    since = F.when(F.col("failing"), F.coalesce("first_seen", t))
    hold = F.lit(hold_of("", hold_minutes))
    for name, minutes in hold_minutes.items() if isinstance(hold_minutes, dict) else ():
        hold = F.when(F.col("name") == name, F.lit(minutes)).otherwise(hold)
    due = F.col("failing") & (since <= t - F.make_dt_interval(secs=(60 * hold).cast("decimal(18,6)")))
    fired = F.col("failing") & (F.col("was") | due)
    notice = F.when(fired & ~F.col("was"), "fired").when(~F.col("failing") & F.col("was"), "resolved")
    return both.select("name", since.alias("first_seen"), fired.alias("fired"), notice.alias("notice"))


def cycle_health(cycles: DataFrame, threshold: int = 3) -> DataFrame:
    """cycles (stream, cycle, ran, failed): unhealthy after `threshold` cycles in a row in which all that ran failed;
    a cycle in which nothing ran leaves the streak as it is."""
    counted = cycles.where("ran > 0").withColumn("bad", F.col("failed") == F.col("ran"))
    order = Window.partitionBy("stream").orderBy("cycle")
    island = counted.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(order))
    streak = F.sum(F.when(F.col("bad"), 1).otherwise(0)).over(Window.partitionBy("stream", "island").orderBy("cycle"))
    return island.withColumn("streak", F.when(F.col("bad"), streak).otherwise(0)).select("stream", "cycle", F.col("streak").cast("long").alias("streak"), (F.col("streak") >= threshold).alias("unhealthy"))
