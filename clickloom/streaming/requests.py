"""Requests answered from live state: events, feedback and requests share one keyed stream.

A user's events and requests wait in the state (one entry per bucket of users) until the watermark has passed them; then they are applied
in the order of their times, so a request reads the state as of its own time, whatever order the
messages came in. Events at the time of a request count; ties among events go by event id. The
answers carry the same session features as the batch operator `sessions.state_at`.

What waits is bounded by the allowed delay: each user holds the rows of that span, and one small state
besides (session, cart flag, at most `cap` views). The state goes when the watermark has passed its life
time. Messages later than the watermark are dropped by the engine; messages without user or time are
dead letters (`waiting` counts them out). Streams are joined by a union, so the slowest of them holds
the watermark; a feed without traffic sends heartbeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clickloom.functions.schemas import FEEDBACK, REQUEST
from clickloom.operators import messages as M
from clickloom.operators.sessions import CART_EVENT, MAX_RECENT_VIEWS, TTL_SECONDS
from clickloom.streaming.live import bucketed, only_timer, use_rocksdb

ROW = "ts double, kind int, id string, item_id string, cart boolean, n_recommendations int, context string"
FIELDS = [f.split()[0] for f in ROW.split(", ")]
SESSION = "start double, last double, n bigint, cart boolean, view_last double, views array<string>"
STATE = ", ".join(f"{name} array<struct<user_id:string,{of.replace(', ', ',').replace(' ', ':')}>>" for name, of in (("rows", ROW), ("sessions", SESSION)))
ANSWER = """request_id string, user_id string, request_ts double, n_recommendations int, context string, session_length bigint,
    session_age_seconds double, last_seen_timestamp double, has_cart_item boolean, recent_views array<string>"""
ANSWER_COLUMNS = [f.split()[0] for f in ANSWER.replace("\n", " ").split(",")]


def parse_requests(messages: DataFrame) -> DataFrame:
    """Requests out of JSON messages; a message without id, user or time is no request."""
    r = messages.select(F.from_json("value", REQUEST).alias("r")).select("r.*")
    return r.where("request_id is not null and user_id is not null and request_ts is not null")


def parse_feedback(messages: DataFrame) -> DataFrame:
    """Feedback messages as events."""
    f = messages.select(F.from_json("value", FEEDBACK).alias("f")).select("f.*")
    return M.feedback_events(f.where("user_id is not null and received_ts is not null"))


def encode(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows as JSON messages keyed by user."""
    return rows.select(F.coalesce(key, F.lit("")).alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("event_time", delay)


def waiting(events: list[DataFrame], requests: DataFrame, delay: str, cart_event: str = CART_EVENT) -> DataFrame:
    """All streams in one shape; rows without user or time are left out."""
    none = F.lit(None)
    parts = [
        e.where("user_id is not null and timestamp is not null").select(
            "user_id", F.col("timestamp").alias("ts"), F.lit(0).alias("kind"), F.col("event_id").alias("id"), "item_id",
            F.coalesce(F.col("event_type") == cart_event, F.lit(False)).alias("cart"), none.cast("int").alias("n_recommendations"),
            none.cast("string").alias("context"),
        )
        for e in events
    ]
    parts.append(
        requests.where("user_id is not null and request_ts is not null").select(
            "user_id", F.col("request_ts").alias("ts"), F.lit(1).alias("kind"), F.col("request_id").alias("id"),
            none.cast("string").alias("item_id"), F.lit(False).alias("cart"), "n_recommendations", F.to_json("context").alias("context"),
        )
    )
    out = None
    for p in parts:
        timed = _timed(p, delay)
        out = timed if out is None else out.unionByName(timed)
    return out


class Session:
    """State of one user; `apply` takes rows in the order of their times."""

    def __init__(self, ttl: float, cap: int, start=None, last=None, n=0, cart=False, view_last=None, views=()):
        self.ttl, self.cap = ttl, cap
        self.start, self.last, self.n, self.cart, self.view_last, self.views = start, last, n, cart, view_last, list(views)

    def apply(self, ts: float, item: str | None, cart: bool) -> None:
        if self.last is None or ts - self.last > self.ttl:
            self.start, self.n, self.cart = ts, 0, False
        self.last, self.n, self.cart = ts, self.n + 1, self.cart or cart
        if item:
            if self.view_last is None or ts - self.view_last > self.ttl:
                self.views = []
            self.views = [item, *self.views][: self.cap]
            self.view_last = ts

    def at(self, ts: float) -> tuple:
        """session_length, session_age_seconds, last_seen_timestamp, has_cart_item, recent_views."""
        alive = self.last is not None and ts - self.last <= self.ttl
        seen = self.view_last is not None and ts - self.view_last <= self.ttl
        views = list(self.views) if seen else []
        return (self.n, ts - self.start, self.last, self.cart, views) if alive else (0, 0.0, ts, False, views)

    def value(self) -> tuple:
        return (self.start, self.last, self.n, self.cart, self.view_last, self.views)

    def ends(self) -> float:
        return max(t for t in (self.last, self.view_last) if t is not None) + self.ttl


class LiveRequests(StatefulProcessor):
    """Waiting rows and sessions of the users of a bucket."""

    def __init__(self, ttl: float, cap: int):
        self._ttl, self._cap = ttl, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("users", STATE)

    def _advance(self, new: dict[str, list[tuple]], watermark: float) -> Iterator[pd.DataFrame]:
        held = self._state.get() or ([], [])
        waiting, sessions = new, {s[0]: tuple(s[1:]) for s in held[1]}
        for r in held[0]:
            waiting.setdefault(r[0], []).append(tuple(r[1:]))
        out, kept_rows, kept_sessions, due = [], [], [], []
        for user in dict.fromkeys([*waiting, *sessions]):
            rows = sorted(waiting.get(user, ()), key=lambda r: (r[0], r[1], r[2] or ""))
            at = next((i for i, r in enumerate(rows) if r[0] > watermark), len(rows))
            ready, rest = rows[:at], rows[at:]
            session = Session(self._ttl, self._cap, *sessions.get(user, ()))
            for ts, kind, name, item, cart, n, context in ready:
                if kind:
                    out.append((name, user, ts, n, context, *session.at(ts)))
                else:
                    session.apply(ts, item, cart)
            kept_rows += [(user, *r) for r in rest]
            alive = session.last is not None and (rest or session.ends() >= watermark)
            if alive:
                kept_sessions.append((user, *session.value()))
            if rest:
                due.append(int(rest[0][0] * 1000) + 1)
            elif alive:
                due.append(int(session.ends() * 1000) + 1000)
        if due:
            self._state.update((kept_rows, kept_sessions))
        else:
            self._state.clear()
        only_timer(self._handle, min(due, default=None))
        if out:
            frame = pd.DataFrame(out, columns=ANSWER_COLUMNS)
            frame["n_recommendations"] = frame["n_recommendations"].astype("Int32")
            yield frame

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list[tuple]] = {}
        for pdf in rows:
            for user, *row in zip(pdf["user_id"], *(pdf[f].tolist() for f in FIELDS)):
                ts, kind, name, item, cart, n, context = (None if v is None or v != v else v for v in row)
                new.setdefault(user, []).append((float(ts), int(kind), name, item, bool(cart), None if n is None else int(n), context))
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs() / 1000.0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance({}, timerValues.getCurrentWatermarkInMs() / 1000.0)

    def close(self) -> None:
        pass


def answers(
    events: list[DataFrame], requests: DataFrame, ttl: float = TTL_SECONDS, cap: int = MAX_RECENT_VIEWS,
    delay: str = "30 minutes", cart_event: str = CART_EVENT,
) -> DataFrame:
    """Every request with the session features as of its own time, once the watermark has passed it.

    `events` are streams in the shape of events (clicks, feedback); `requests` has request_id, user_id,
    n_recommendations, request_ts, context.
    """
    use_rocksdb(requests.sparkSession)
    rows = waiting(events, requests, delay, cart_event)
    out = bucketed(rows).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=LiveRequests(ttl, cap), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime"
    )
    return out.withColumn("context", F.from_json("context", "map<string,string>"))
