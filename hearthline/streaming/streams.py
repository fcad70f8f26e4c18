"""Structured Streaming: snapshots as they land, and alerts that hold before they fire."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..plans.alerts import HOLD_MINUTES, Holds, hold_of
from ..plans.state import outputs, snapshot_rows, upsert_prices
from ..sources.store import Commit, Store, newest

CARDS = "snapshot_id bigint, search_key string, day date, entity_id bigint, title string, url string, deal string, kind string, rooms string, sqm double, price double, price_state string, area_key string, seller string, snapshot_rows bigint"


MEMBERS = "search_key string, entity_id bigint"
PRICES = "entity_id bigint, on_date date, price double, currency string, source string"


class SnapshotFolder:
    """Folds complete snapshots into a store of state, prices and members (which items a search holds), in hash buckets.

    A snapshot's cards and its search's members tell which buckets it can change; only those are read and written, so the
    work of a fold follows the snapshot. The commit also remembers the last snapshot of every search and the files of those
    that are not complete yet: a batch reads the files it was given and, of the others, such as now make a snapshot whole."""

    def __init__(self, spark: SparkSession, store: str, initial: DataFrame, buckets: int = 64, keep: int = 3):
        self.initial = initial.withColumn("reopened_on", F.lit(None).cast("date"))
        schemas = {"state": self.initial.schema, "prices": PRICES, "members": MEMBERS}
        self.store = Store(spark, store, {"state": "entity_id", "prices": "entity_id", "members": "search_key"}, schemas, buckets, keep)
        self.files_read = 0

    def begin(self) -> Commit:
        head = self.store.head()
        if head.version or not self.initial.head(1):
            return head
        members = self.initial.select(F.explode("search_keys").alias("search_key"), "entity_id")
        rows = {"state": self.initial, "prices": self.store.read(head, "prices"), "members": members}
        return self.store.write(head, rows, {"state": [], "prices": [], "members": []})

    def fold(self, batch: DataFrame, _: int) -> None:
        """One batch of cards with the file that each came from. A batch that runs again finds its snapshots not newer than
        the last ones, or its files remembered, and changes nothing."""
        spark, commit = self.store.spark, self.begin()
        batch = batch.where("search_key is not null and snapshot_id is not null").persist()
        last, waiting = told(commit)
        heads = batch.groupBy("search_key", "snapshot_id", "file").agg(F.count(F.lit(1)).alias("n"), F.max("snapshot_rows").alias("whole"), F.min("day").cast("string").alias("day")).collect()
        given = {h.file for h in heads}  # a row per snapshot and file of the batch
        self.files_read += len(given)
        seen = {(w["search_key"], w["snapshot_id"], w["file"]) for w in waiting}
        waiting += [h.asDict() for h in heads if (h.search_key, h.snapshot_id, h.file) not in seen]
        parts: dict[tuple, list[dict]] = {}
        for w in waiting:
            if w["snapshot_id"] > last.get(w["search_key"], w["snapshot_id"] - 1):
                parts.setdefault((w["snapshot_id"], w["search_key"]), []).append(w)
        ready = sorted(k for k, of in parts.items() if whole_rows(of) in (None, sum(w["n"] for w in of)))
        more = sorted({w["file"] for k in ready for w in parts[k]} - given)
        landed = batch.drop("file")
        if more:
            self.files_read += len(more)
            landed = landed.unionByName(spark.read.schema(CARDS).parquet(*more)).persist()
        for k in ready:
            of = parts.pop(k)
            if k[0] > last.get(k[1], k[0] - 1):
                last[k[1]] = k[0]
                cards = landed.where((F.col("snapshot_id") == k[0]) & (F.col("search_key") == k[1])).drop("snapshot_id", "search_key", "day", "snapshot_rows")
                left = [w for key, ws in parts.items() for w in ws if w["snapshot_id"] > last.get(w["search_key"], w["snapshot_id"] - 1)]
                commit = self.fold_one(commit, cards, k[1], date.fromisoformat(min(w["day"] for w in of)), json.dumps({"last": last, "waiting": left}))
        left = [w for ws in parts.values() for w in ws if w["snapshot_id"] > last.get(w["search_key"], w["snapshot_id"] - 1)]
        if json.dumps({"last": last, "waiting": left}) != (commit.notes or json.dumps({"last": {}, "waiting": []})):
            self.store.write(commit, {}, {}, notes=json.dumps({"last": last, "waiting": left}))
        landed.unpersist()
        batch.unpersist()

    def fold_one(self, commit: Commit, cards: DataFrame, search_key: str, day: date, notes: str | None = None) -> Commit:
        store = self.store
        own = store.spark.range(1).select(store.bucket(F.lit(search_key))).first()[0]
        members = store.read(commit, "members", [own])
        mine = members.where(F.col("search_key") == search_key)
        ids = store.touched(cards.select("entity_id"), mine.select("entity_id"))
        rows = snapshot_rows(store.read(commit, "state", ids), cards, search_key, day)
        rows = rows.withColumn("reopened_on", F.when(F.col("_reopened"), F.lit(day)).otherwise(F.col("reopened_on"))).persist()
        back = rows.where("closing and reopened_on is not null").select("entity_id", F.col("reopened_on").alias("occurred_on"))
        out = outputs(rows, self.initial.columns, day, back)
        priced = store.touched(out.markers)
        tables = {
            "state": out.state, "prices": upsert_prices(store.read(commit, "prices", priced), out.markers),
            "members": members.where(F.col("search_key") != search_key).unionByName(rows.where("_seen").select(F.lit(search_key).alias("search_key"), "entity_id")),
        }
        summary = out.summary.select(F.lit(search_key).alias("search_key"), F.lit(day).alias("day"), "*")
        commit = store.write(commit, tables, {"state": ids, "prices": priced, "members": [own]}, {"lifecycle": out.lifecycle, "summary": summary}, notes)
        rows.unpersist()
        return commit


def told(commit: Commit) -> tuple[dict[str, int], list[dict]]:
    """What a commit remembers: the last snapshot of each search, and (search_key, snapshot_id, file, n, whole, day) of what
    waits for the rest of its snapshot."""
    notes = json.loads(commit.notes) if commit.notes else {"last": {}, "waiting": []}
    return notes["last"], notes["waiting"]


def whole_rows(parts: list[dict]) -> int | None:
    return max((w["whole"] for w in parts if w["whole"] is not None), default=None)


def pending_snapshots(spark: SparkSession, store: str) -> DataFrame:
    """Snapshots that wait for more rows: search_key, snapshot_id, rows_landed, snapshot_rows, files."""
    commit = newest(spark, store)
    waiting: dict[tuple, list[dict]] = {}
    for w in told(commit)[1] if commit else []:
        waiting.setdefault((w["search_key"], w["snapshot_id"]), []).append(w)
    rows = [(*k, sum(w["n"] for w in of), whole_rows(of), sorted(w["file"] for w in of)) for k, of in waiting.items()]
    return spark.createDataFrame(rows, "search_key string, snapshot_id bigint, rows_landed bigint, snapshot_rows bigint, files array<string>")


def stream_snapshots(spark: SparkSession, landing: str, store: str, checkpoint: str, empty_state: DataFrame, files_per_batch: int = 16, buckets: int = 64) -> StreamingQuery:
    """Complete snapshots (Parquet files of CARDS) are folded into the store, each search's in order of their id. A snapshot
    not newer than the last one of its search is skipped, so a batch that runs again changes nothing.

    A snapshot's files may come in several batches: it is folded when snapshot_rows rows of it have landed. Without
    snapshot_rows (null or no such column) what a batch brings counts as the whole.

    state, prices and members are published in buckets (archive.read_latest, archive.read_prices), lifecycle and summary
    as what each version adds (archive.read_deltas)."""
    folder = SnapshotFolder(spark, store, empty_state, buckets)
    source = spark.readStream.schema(CARDS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return source.select("*", F.col("_metadata.file_path").alias("file")).writeStream.foreachBatch(folder.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_runs(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Runs per hour and status with a watermark: the same numbers as in batch for runs that are not later."""
    timed = runs.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    return timed.groupBy(F.window("started_at", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "status", "n")


def alert_step(hold_ms: Callable[[str], int]) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fired = state.get if state.exists else (None, False)
        hold, out = hold_ms(key[0]), []

        def until(now: int) -> bool:
            """Whether the condition fires by now; it does so when its hold is over, not when the next row comes."""
            due = since is not None and not fired and now >= since + hold
            if due:
                out.append((key[0], pd.Timestamp(since + hold, unit="ms"), "fired"))
            return fired or due

        rows = [] if state.hasTimedOut else pd.concat(batches).sort_values(["at", "failing"], ignore_index=True).itertuples()
        for r in rows:
            now = int(r.at.value // 1_000_000)
            if r.failing:
                since = now if since is None else since
                fired = until(now)
            else:
                fired = until(now - 1)  # a recovery at the end of the hold is in time
                if fired:
                    out.append((key[0], r.at, "resolved"))
                since, fired = None, False
        fired = until(state.getCurrentWatermarkMs())
        if since is None:
            state.remove()
        else:
            state.update((since, fired))
            if not fired:
                state.setTimeoutTimestamp(since + hold)
        if out:
            yield pd.DataFrame(out, columns=["name", "at", "notice"])

    return step


def stream_alerts(conditions: DataFrame, hold_minutes: Holds = HOLD_MINUTES, late: str = "0 seconds") -> DataFrame:
    """conditions (name, failing, at): a notice when a condition has failed for its hold, and one when it is over; for logs
    that are read again, as all times are the rows'.

    A timer on event time fires a condition whose hold ends without a further row of its own: once the watermark, which
    follows the latest row of any condition, has passed. Where rows may stop coming use live_alerts."""
    step = alert_step(lambda name: 60_000 * hold_of(name, hold_minutes))
    keyed = conditions.withWatermark("at", late).groupBy("name")
    return keyed.applyInPandasWithState(step, "name string, at timestamp, notice string", "since long, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


class HeldAlert(StatefulProcessor):
    """One condition by the clock: the first failing row sets a timer to the end of the hold, a good row takes it away."""

    def __init__(self, hold_minutes: Holds):
        self.hold_minutes = hold_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failing = handle.getValueState("failing", "since long, fired boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for r in pd.concat(list(rows)).sort_values(["at", "failing"]).itertuples():
            since, fired = self.failing.get() if self.failing.exists() else (None, False)
            if r.failing and since is None:
                self.failing.update((now, False))
                self.handle.registerTimer(now + self.hold_ms(key))
            elif not r.failing and since is not None:
                if fired:
                    out.append((key[0], pd.Timestamp(now, unit="ms"), "resolved"))
                else:
                    self.handle.deleteTimer(since + self.hold_ms(key))
                self.failing.clear()
        yield pd.DataFrame(out, columns=["name", "at", "notice"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.failing.exists():
            since, fired = self.failing.get()
            if not fired and expiredTimerInfo.getExpiryTimeInMs() >= since + self.hold_ms(key):
                self.failing.update((since, True))
                out.append((key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), "fired"))
        yield pd.DataFrame(out, columns=["name", "at", "notice"])

    def hold_ms(self, key: tuple) -> int:
        return int(60_000 * hold_of(key[0], self.hold_minutes))

    def close(self) -> None:
        pass


def live_alerts(conditions: DataFrame, hold_minutes: Holds = HOLD_MINUTES) -> DataFrame:
    """conditions (name, failing, at) as they come: holds run by the clock of the batches, so a condition that failed once
    fires after its hold although nothing is sent any more. Needs the session's RocksDB state store (live_session)."""
    keyed = conditions.select("name", "failing", "at").groupBy("name")
    return keyed.transformWithStateInPandas(HeldAlert(hold_minutes), "name string, at timestamp, notice string", "Append", "ProcessingTime")


def live_session(spark: SparkSession) -> SparkSession:
    """A session of its own over the same tables, whose streams keep state where timers can be kept."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return s
