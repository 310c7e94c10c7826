"""Session state in batch: the state a key-value session store would hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.timeline import latest_before, session_runs
from clickloom.session import cut, stage

TTL_SECONDS = 1800
MAX_RECENT_VIEWS = 20
CART_EVENT = "add_to_cart"


def has_item() -> Column:
    return F.coalesce(F.col("item_id"), F.lit("")) != ""


def runs(events: DataFrame, ttl: float = TTL_SECONDS, cart_event: str = CART_EVENT, **kw) -> DataFrame:
    return session_runs(events, ttl, flag=F.col("event_type") == cart_event, **kw)


def view_runs(events: DataFrame, ttl: float = TTL_SECONDS, **kw) -> DataFrame:
    """The views list has its own life time, refreshed by events with an item only."""
    return session_runs(events.filter(has_item()), ttl, **kw)


def session_table(run: DataFrame) -> DataFrame:
    """One row per session: start, events, last seen, cart."""
    return run.groupBy("user_id", "session_no").agg(
        F.min("timestamp").alias("session_start"),
        F.max("timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("session_length"),
        F.bool_or(F.col("flag_so_far")).alias("has_cart_item"),
    )


def current_sessions(run: DataFrame) -> DataFrame:
    """State after the last event of each user. `max_by` reduces a hot user before the shuffle."""
    state = F.max_by(F.struct("session_start", F.col("timestamp").alias("last_seen"), "n_so_far", "flag_so_far"), "pos")
    return run.groupBy("user_id").agg(state.alias("s")).select(
        "user_id",
        F.col("s.session_start").alias("session_start"),
        F.col("s.last_seen").alias("last_seen"),
        F.col("s.n_so_far").alias("session_length"),
        F.col("s.flag_so_far").alias("has_cart_item"),
    )


def recent_views(run: DataFrame, cap: int = MAX_RECENT_VIEWS) -> DataFrame:
    """Items of the last view chain, newest first, at most `cap` per user, repeats kept.

    The rank filter becomes a group limit before the shuffle: at most `cap` rows per user and task
    travel, however many events a user has.
    """
    newest = Window.partitionBy("user_id").orderBy(F.desc("pos"))
    top = run.withColumn("view_rank", F.row_number().over(newest)).filter(F.col("view_rank") <= cap)
    chain = F.max("session_no").over(Window.partitionBy("user_id"))
    return (
        top.withColumn("_last", chain)
        .filter(F.col("session_no") == F.col("_last"))
        .select("user_id", F.col("view_rank").cast("bigint").alias("view_rank"), "item_id", "timestamp")
    )


def view_lists(views: DataFrame) -> DataFrame:
    """Views as one list per user (its length is bounded by the cap)."""
    packed = F.array_sort(F.collect_list(F.struct("view_rank", "item_id")))
    return views.groupBy("user_id").agg(F.transform(packed, lambda x: x["item_id"]).alias("recent_views"))


def state_at(
    requests: DataFrame,
    events: DataFrame,
    ttl: float = TTL_SECONDS,
    cart_event: str = CART_EVENT,
    cap: int = MAX_RECENT_VIEWS,
) -> DataFrame:
    """Session features of every request as of its own time (request_id, user_id, request_ts).

    The state is the last event's running session, if that event is not older than the TTL. The
    views are found by position: a request knows the place of its last view in the user's
    timeline, so its at most `cap` views are fetched by equality on (user, position).
    """
    asked = requests.select("request_id", "user_id", "request_ts")
    session = stage(
        runs(events, ttl, cart_event).select("user_id", "timestamp", "pos", "session_start", "n_so_far", "flag_so_far"),
        "session-runs",
    )
    views = stage(view_runs(events, ttl).select("user_id", "timestamp", "pos", "start_pos", "item_id"), "view-runs")
    found = latest_before(
        asked,
        {"s": session, "v": views.drop("item_id")},
        key="user_id",
        left_ts="request_ts",
        right_ts="timestamp",
        right_order="pos",
    )
    alive = {n: F.coalesce(F.col("request_ts") - F.col(f"{n}.timestamp") <= ttl, F.lit(False)) for n in ("s", "v")}
    last, first = F.col("v.pos"), F.col("v.start_pos")
    places = F.when(alive["v"], F.sequence(F.greatest(first, last - cap + 1), last))
    state = cut(
        found.select(
            "request_id",
            "user_id",
            "request_ts",
            F.when(alive["s"], F.col("s.n_so_far")).otherwise(0).cast("bigint").alias("session_length"),
            F.when(alive["s"], F.col("request_ts") - F.col("s.session_start")).otherwise(0.0).alias("session_age_seconds"),
            F.when(alive["s"], F.col("s.timestamp")).otherwise(F.col("request_ts")).alias("last_seen_timestamp"),
            F.when(alive["s"], F.col("s.flag_so_far")).otherwise(False).alias("has_cart_item"),
            places.alias("places"),
        )
    )
    lists = (
        state.select("request_id", "user_id", F.explode("places").alias("pos"))
        .join(views.select("user_id", "pos", "item_id"), ["user_id", "pos"])
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("k"), "item_id"))).alias("l"))
        .select("request_id", F.transform("l", lambda x: x["item_id"]).alias("recent_views"))
    )
    return state.drop("places").join(lists, "request_id", "left").withColumn(
        "recent_views", F.coalesce("recent_views", F.array().cast("array<string>"))
    )


def transitions(events: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """Share of each next state per state, from `start` over the event types to `end`."""
    run = session_runs(events, ttl, previous=("event_type",))
    moves = (
        run.groupBy(
            F.when(F.col("is_start"), "start").otherwise(F.col("prev_event_type")).alias("state"),
            F.col("event_type").alias("next_state"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = (
        run.groupBy("user_id", "session_no")
        .agg(F.max_by("event_type", "pos").alias("state"))
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("state", F.lit("end").alias("next_state"), "n")
    )
    whole = Window.partitionBy("state")  # a handful of rows: pairs of event types
    return moves.unionByName(ends).select("state", "next_state", "n", (F.col("n") / F.sum("n").over(whole)).alias("share"))


def session_integrity(events: DataFrame) -> DataFrame:
    """Session ids used by more than one user (a sound feed has none)."""
    return (
        events.filter(F.col("session_id") != "")
        .groupBy("session_id")
        .agg(F.count_distinct("user_id").alias("users"))
        .filter(F.col("users") > 1)
    )


def event_mix(events: DataFrame) -> DataFrame:
    """Share of every event type."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select("event_type", "n", (F.col("n") / total).alias("share"))
