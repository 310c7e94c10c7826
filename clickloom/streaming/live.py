"""Streaming jobs: parsing, deduplication, session state, closed sessions, rates, recommendations."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from clickloom.operators import messages as M
from clickloom.operators import telemetry as TM
from clickloom.operators.sessions import CART_EVENT, MAX_RECENT_VIEWS, TTL_SECONDS
from clickloom.session import new_path

TRIGGER = "5 seconds"


def start(stream, checkpoint: str, drain: bool = False, every: str = TRIGGER) -> StreamingQuery:
    """Start a writer: every 5 seconds in production, or over what is there and stop (`drain`)."""
    writer = stream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    query = writer.start()
    if drain:
        query.awaitTermination()
    return query


def to_table(df: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Append-only file sink; each batch is written exactly once."""
    return start(df.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, drain)


def to_batches(df: DataFrame, path: str, checkpoint: str, drain: bool = False, mode: str = "update",
               shape: Callable[[DataFrame, int], DataFrame] | None = None, every: str = TRIGGER,
               after: Callable[[SparkSession, str, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a replayed batch does not count twice.

    `after` (session, path, batch id) runs when the folder is complete.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = shape(batch, batch_id) if shape else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if after:
            after(batch.sparkSession, path, batch_id)

    return start(df.writeStream.outputMode(mode).foreachBatch(write), checkpoint, drain, every)


# ---------------------------------------------------------------- events


def parse(messages: DataFrame) -> DataFrame:
    """Parsed messages with `ok`; bad ones stay in the stream for the dead-letter table."""
    return M.parse_columns(messages)


def event_time(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", delay)


def dedupe(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """First copy of every event; its key is forgotten once the watermark has passed.

    User and item belong to the key, since ids of feedback hold no more than the second.
    """
    return event_time(events, delay).dropDuplicatesWithinWatermark(["event_id", "user_id", "item_id"])


def batch_stats(batch: DataFrame, batch_id: int) -> DataFrame:
    """Events and users of one micro-batch."""
    users = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count(F.lit(1)).alias("users"))


def closed_sessions(events: DataFrame, ttl: float = TTL_SECONDS, delay: str = "30 minutes", cart_event: str = CART_EVENT) -> DataFrame:
    """One row per session once the watermark has passed its end.

    Session windows merge inside the partition before the shuffle, so a busy user is reduced early.
    """
    rows = event_time(events, delay)
    gap = F.session_window("event_time", f"{int(ttl)} seconds")
    out = rows.groupBy("user_id", gap.alias("w")).agg(
        F.count(F.lit(1)).alias("session_length"),
        F.max((F.col("event_type") == cart_event).cast("int")).alias("cart"),
        F.max("timestamp").alias("last_seen"),
        F.min("timestamp").alias("session_start"),
    )
    return out.select("user_id", "session_start", "last_seen", "session_length", (F.col("cart") == 1).alias("has_cart_item"))


# ---------------------------------------------------------------- keyed session state

SUMMARY = (
    "user_id string, event_time timestamp, "
    "pieces array<struct<a:double,b:double,n:bigint,cart:boolean>>, "
    "chains array<struct<a:double,b:double>>, "
    "views array<struct<t:double,id:string,item:string>>"
)
STATE = """users array<struct<user_id:string,pieces:array<struct<a:double,b:double,n:bigint,cart:boolean>>,
    chains:array<struct<a:double,b:double>>,views:array<struct<t:double,id:string,item:string>>>>"""
SESSION_OUT = (
    "user_id string, session_start double, last_seen double, session_length bigint, has_cart_item boolean, "
    "recent_views array<string>"
)
SESSION_COLUMNS = [f.split()[0] for f in SESSION_OUT.split(", ")]


def _merge_spans(spans: list[tuple], ttl: float) -> list[list]:
    """Join spans (start, end, n, cart) that lie within ttl of each other."""
    out: list[list] = []
    for a, b, n, cart in sorted(spans, key=lambda s: s[0]):
        if out and a - out[-1][1] <= ttl:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], b), last[2] + n, last[3] or cart
        else:
            out.append([a, b, n, cart])
    return out


def _lists(user: np.ndarray, users: int, **fields) -> pa.ListArray:
    """One list of structs per user; `user` is the owner of every entry, in order."""
    ends = np.r_[0, np.cumsum(np.bincount(user, minlength=users))].astype(np.int32)
    columns = [pa.array(v) if isinstance(v, np.ndarray) else v for v in fields.values()]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, list(fields)))


def _summaries(rows: pa.RecordBatch, ttl: float, cap: int, cart_event: str) -> pa.RecordBatch:
    """Summaries of events in the order of user, time and id, all users of the batch at once."""
    user = rows["user_id"].dictionary_encode().indices.to_numpy()  # numbered in order of appearance
    ts = rows["timestamp"].to_numpy()
    last = np.flatnonzero(np.r_[np.diff(user) != 0, True])
    users = len(last)

    def spans(user: np.ndarray, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index of every run of one user without a gap above ttl."""
        if not len(ts):
            return np.zeros(0, int), np.zeros(0, int)
        breaks = (np.diff(user) != 0) | (np.diff(ts) > ttl)
        return np.flatnonzero(np.r_[True, breaks]), np.flatnonzero(np.r_[breaks, True])

    a, b = spans(user, ts)
    cart = pc.fill_null(pc.equal(rows["event_type"], cart_event), False).to_numpy(zero_copy_only=False)
    pieces = _lists(user[a], users, a=ts[a], b=ts[b], n=(b - a + 1).astype(np.int64), cart=np.logical_or.reduceat(cart, a))
    viewed = np.flatnonzero(pc.fill_null(pc.not_equal(rows["item_id"], ""), False).to_numpy(zero_copy_only=False))
    vu, vt = user[viewed], ts[viewed]
    a, b = spans(vu, vt)
    chains = _lists(vu[a], users, a=vt[a], b=vt[b])
    newest = viewed[np.searchsorted(vu, vu, "right") - np.arange(len(vu)) <= cap]
    at = pa.array(newest)
    views = _lists(user[newest], users, t=ts[newest], id=rows["event_id"].take(at), item=rows["item_id"].take(at))
    seen = pa.array((ts[last] * 1e6).astype(np.int64)).cast(pa.timestamp("us", tz="UTC"))
    return pa.RecordBatch.from_arrays(
        [rows["user_id"].take(pa.array(last)), seen, pieces, chains, views], ["user_id", "event_time", "pieces", "chains", "views"]
    )


def compact(events: DataFrame, ttl: float = TTL_SECONDS, cap: int = MAX_RECENT_VIEWS, cart_event: str = CART_EVENT) -> DataFrame:
    """Reduce events to one mergeable summary per user and Arrow batch, before the shuffle.

    A summary holds session spans, spans of the views chain, and the newest `cap` viewed items, so
    a user who sends a third of a micro-batch costs a few rows per input task.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = [(c, "ascending") for c in ("user_id", "timestamp", "event_id")]
                yield _summaries(batch.take(pc.sort_indices(batch, sort_keys=order)), ttl, cap, cart_event)

    # events without user or time have no place in keyed state: `parse` gives them to the dead letters
    needed = events.select("user_id", "event_id", "item_id", "event_type", "timestamp").filter(
        "user_id IS NOT NULL AND timestamp IS NOT NULL AND NOT isnan(timestamp)"
    )
    return needed.mapInArrow(reduce, SUMMARY)


BUCKETS = 512  # part of the keyed state's layout: a checkpoint goes on with the number it began with


def bucketed(rows: DataFrame) -> DataFrame:
    """Rows with the bucket of their user, the key of the state.

    A call into the state store, a timer and a data frame cost milliseconds each. Per bucket they are paid once for all
    its users; a task holds one bucket at a time.
    """
    return rows.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int"))


def only_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """Leave one timer for the current key, or none."""
    old = list(handle.listTimers())
    for t in old:
        if t != at:
            handle.deleteTimer(t)
    if at is not None and at not in old:
        handle.registerTimer(at)


class SessionState(StatefulProcessor):
    """Merges summaries into the states of the users of a bucket, in event time.

    Spans stay in the state for as long as a late event could still join them; the state of a user
    is dropped when the watermark has passed the last event by the TTL.
    """

    def __init__(self, ttl: float, cap: int):
        self._ttl, self._cap = ttl, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("sessions", STATE)

    def _users(self) -> dict[str, tuple]:
        held = self._state.get()
        # plain tuples, since the store takes no rows back
        return {u[0]: tuple([tuple(x) for x in part] for part in u[1:]) for u in held[0]} if held else {}

    def _keep(self, users: dict[str, tuple]) -> None:
        if users:
            self._state.update(([(name, *value) for name, value in users.items()],))
            only_timer(self._handle, min(self._end(v) for v in users.values()))
        else:
            self._state.clear()
            only_timer(self._handle, None)

    def _end(self, value: tuple) -> int:
        """When the timer of a user is due, in milliseconds."""
        return int((value[0][-1][1] + self._ttl) * 1000) + 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        users, new = self._users(), {}
        for pdf in rows:
            for name, pieces, more_chains, more_views in zip(pdf["user_id"], pdf["pieces"], pdf["chains"], pdf["views"]):
                spans, chains, views = new.setdefault(name, ([], [], []))
                spans += [(p["a"], p["b"], p["n"], p["cart"]) for p in pieces]
                chains += [(c["a"], c["b"], 0, False) for c in more_chains]
                views += [(v["t"], v["id"], v["item"]) for v in more_views]
        horizon = timerValues.getCurrentWatermarkInMs() / 1000.0 - self._ttl
        out = []
        for name, (spans, chains, views) in new.items():
            if name in users:
                pieces, kept_chains, kept_views = users[name]
                spans = pieces + spans
                chains = [(a, b, 0, False) for a, b in kept_chains] + chains
                views = kept_views + views
            spans, chains = _merge_spans(spans, self._ttl), _merge_spans(chains, self._ttl)
            views = sorted(views)[-self._cap :]
            spans = [s for s in spans[:-1] if s[1] >= horizon] + spans[-1:]
            chains = [c for c in chains[:-1] if c[1] >= horizon] + chains[-1:]
            users[name] = (
                [(float(a), float(b), int(n), bool(c)) for a, b, n, c in spans],
                [(float(a), float(b)) for a, b, _, _ in chains],
                [(float(t), i, it) for t, i, it in views],
            )
            start, last, n, cart = spans[-1]
            shown = [it for t, _, it in reversed(views) if chains and t >= chains[-1][0]]
            out.append((name, float(start), float(last), int(n), bool(cart), shown))
        self._keep(users)
        yield pd.DataFrame(out, columns=SESSION_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self._keep({name: value for name, value in self._users().items() if self._end(value) > watermark})
        return iter([])

    def close(self) -> None:
        pass


class ArrivalState(StatefulProcessor):
    """Session by arrival time, with the state store's own life time: every update refreshes it.

    The session and the views list have separate life times; the views list is one value, so it
    lives and dies as a whole.
    """

    def __init__(self, ttl: float, cap: int):
        self._ttl, self._cap = ttl, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        ms = int(self._ttl * 1000)
        self._session = handle.getValueState("session", "start double, n bigint, cart boolean", ttlDurationMs=ms)
        self._views = handle.getValueState("views", "items array<string>", ttlDurationMs=ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() / 1000.0
        start, n, cart = self._session.get() if self._session.exists() else (now, 0, False)
        kept = list(self._views.get()[0]) if self._views.exists() else []
        fresh = []
        for pdf in rows:
            for pieces, views in zip(pdf["pieces"], pdf["views"]):
                n += sum(p["n"] for p in pieces)
                cart = cart or any(p["cart"] for p in pieces)
                fresh += [(v["t"], v["id"], v["item"]) for v in views]
        self._session.update((float(start), int(n), bool(cart)))
        if fresh:
            kept = ([it for _, _, it in sorted(fresh, reverse=True)] + kept)[: self._cap]
            self._views.update((kept,))
        yield pd.DataFrame(
            {
                "user_id": [key[0]],
                "session_start": [float(start)],
                "last_seen": [now],
                "session_length": [int(n)],
                "has_cart_item": [bool(cart)],
                "recent_views": [kept],
            }
        )

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def session_state(
    events: DataFrame,
    ttl: float = TTL_SECONDS,
    cap: int = MAX_RECENT_VIEWS,
    delay: str = "30 minutes",
    cart_event: str = CART_EVENT,
    arrival: bool = False,
) -> DataFrame:
    """State of every user touched by a micro-batch (update mode).

    With `arrival` the life times run on the clock, so the query needs a processing-time trigger:
    it always has another batch to look at and does not drain.
    """
    use_rocksdb(events.sparkSession)
    small = compact(events, ttl, cap, cart_event)
    if arrival:
        return small.groupBy("user_id").transformWithStateInPandas(
            statefulProcessor=ArrivalState(ttl, cap), outputStructType=SESSION_OUT, outputMode="Update", timeMode="ProcessingTime"
        )
    return (
        bucketed(small.withWatermark("event_time", delay))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=SessionState(ttl, cap), outputStructType=SESSION_OUT, outputMode="Update", timeMode="EventTime"
        )
    )


def latest_state(published: DataFrame) -> DataFrame:
    """Current row per user of a published state table (the newest batch wins)."""
    cols = [c for c in published.columns if c not in ("user_id", "batch_id")]
    best = published.groupBy("user_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return best.select("user_id", *[F.col(f"s.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------- metrics and recommendations


def request_rate(log: DataFrame, window: str = "1 minute", slide: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests per sliding window and series, emitted when the window is complete."""
    out = log.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), "status", "device").agg(
        F.count(F.lit(1)).alias("n")
    )
    return out.select(F.unix_micros("w.end").alias("window_end_us"), "status", "device", "n")


def latency_quantiles(log: DataFrame, window: str = "2 minutes", slide: str = "15 seconds", delay: str = "1 minute") -> DataFrame:
    """Quantiles per stage and sliding window from histograms, emitted when the window is complete."""
    return TM.latency_quantiles(log.withWatermark("ts", delay), window, slide)


def status_ratio(
    log: DataFrame, status: str, levels: tuple[float, float], window: str = "5 minutes", slide: str = "15 seconds", delay: str = "1 minute"
) -> DataFrame:
    """Share of one status per sliding window, emitted when the window is complete."""
    return TM.status_ratio(log.withWatermark("ts", delay), status, levels, window, slide)


# ---------------------------------------------------------------- observed figures


def observed(events: DataFrame, name: str = "events") -> DataFrame:
    """Count figures of every micro-batch along the way: rows, users, first and last time.

    They come with the batch's own job. Distinct users need a shuffle of their own (`batch_stats`); here they are a sketch.
    """
    return events.observe(
        name,
        F.count(F.lit(1)).alias("events"),
        F.approx_count_distinct("user_id", 0.02).alias("users"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


class BatchFigures(StreamingQueryListener):
    """Keeps the observed figures of the newest `keep` batches of one observation, and the rate of each."""

    def __init__(self, name: str = "events", keep: int = 10_000):
        self._name = name
        self._ended: dict[str, threading.Event] = {}
        self.batches: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self._name)
        if found is not None and p.numInputRows:
            seconds = p.durationMs.get("triggerExecution", 0) / 1000
            figures = found.asDict() | {"batch_id": p.batchId, "seconds": seconds}
            self.batches.append(figures | {"per_second": figures["events"] / seconds if seconds > 0 else 0.0})

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait until all figures of an ended query have arrived."""
        if not self._ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError("the figures of the stream did not arrive")


def scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """(table path, checkpoint path) of a run."""
    base = new_path(spark, name)
    return f"{base}/table", f"{base}/checkpoint"
