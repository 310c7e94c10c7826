"""Metrics of the request log, and streams that must equal their batch twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators import messages as M
from clickloom.operators import ranking as R
from clickloom.operators import telemetry as TM
from clickloom.plans import recommend as REC
from clickloom.registry.batch_queries import DAY, r6
from clickloom.registry.model_queries import WEIGHTS, serving_tables
from clickloom.session import cut, new_path
from clickloom.sources import feeds
from clickloom.sources import tables as T
from clickloom.streaming import live as L
from clickloom.streaming import requests as LR
from clickloom.streaming import snapshots as SN

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ request log


@query
def request_counts(spark, d):
    return TM.request_counts(T.request_log(spark, d))


@query
def request_summary(spark, d):
    return TM.request_summary(T.request_log(spark, d)).withColumn("cold_start_percent", r6("cold_start_percent"))


@query
def request_rate(spark, d):
    return TM.request_rate(T.request_log(spark, d))


@query
def latency_histogram(spark, d):
    return TM.latency_histogram(T.request_log(spark, d)).withColumn("sum", F.round("sum", 4))


@query
def candidate_histogram(spark, d):
    return TM.candidate_histogram(T.request_log(spark, d))


@query
def latency_quantiles(spark, d):
    out = TM.latency_quantiles(T.request_log(spark, d), "1 day", "6 hours")
    return out.select("window_end_us", "stage", *[r6(c).alias(c) for c in ("p50", "p95", "p99")])


@query
def latency_exact(spark, d):
    out = TM.latency_exact(T.request_log(spark, d))
    return out.select(r6("p50_ms").alias("p50_ms"), r6("p99_ms").alias("p99_ms"))


@query
def cold_start_rate(spark, d):
    out = TM.status_ratio(T.request_log(spark, d), "cold_start", TM.COLD_START_LEVELS, "1 day", "6 hours")
    return out.withColumn("ratio", r6("ratio"))


@query
def error_rate(spark, d):
    out = TM.status_ratio(T.request_log(spark, d), "error", TM.ERROR_LEVELS, "1 day", "6 hours")
    return out.withColumn("ratio", r6("ratio"))


@query
def metrics_snapshot(spark, d):
    out = TM.snapshot(T.request_log(spark, d), {"cf_model_version": "1", "ranker_model_version": "1"})
    pairs = F.array_sort(F.map_entries("labels"))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("metric", text.alias("labels"), F.round("value", 4).alias("value"))


# ------------------------------------------------------------------ streams


def write_slices(rows: DataFrame, seconds: Column, path: str, write: Callable[[DataFrame], object] | None = None) -> int:
    """Write rows below `path` as three slices of ten days, oldest first, and return the files of a slice, all alike.

    A micro-batch of so many files is one slice, so there are as many batches however large the input is, and no row is
    late for a row of its own slice. What a slice has too few of is made up by empty files; there are no more than cores.
    """
    spark = rows.sparkSession
    write = write or (lambda part: part.write.mode("append").parquet(path))
    files = max(1, min(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    day = F.greatest(F.lit(0), F.coalesce(F.floor((seconds - 1704067200.0) / 864000), F.lit(0)))
    for i in range(3):
        write(rows.filter(F.least(F.lit(2), day) == i).coalesce(files))
        there = spark.read.parquet(path)
        for _ in range((i + 1) * files - len(there.inputFiles())):
            spark.createDataFrame([], there.schema).coalesce(1).write.mode("append").parquet(path)
    return files


def landed(spark: SparkSession, events: DataFrame, name: str, damage: bool = False) -> tuple[str, int]:
    """Events as messages in a landing folder, and the files of a slice."""
    path = new_path(spark, name)
    shape = lambda part: M.damaged(M.encode_events(part)) if damage else M.encode_events(part)
    return path, write_slices(events, F.col("timestamp"), path, lambda part: feeds.publish(shape(part), "parquet", path=path))


def event_stream(spark: SparkSession, path: str, files: int) -> DataFrame:
    return L.parse(feeds.folder_stream(spark, path, files)).filter("ok")


@query
def stream_event_parse(spark, d):
    path, files = landed(spark, T.events(spark, d), "landing-parse", damage=True)
    table, checkpoint = L.scratch(spark, "stream-parse")
    L.to_table(L.parse(feeds.folder_stream(spark, path, files)), table, checkpoint, drain=True)
    out = spark.read.parquet(table)
    good = out.filter("ok").select(
        "event_id", "user_id", "item_id", "event_type", "session_id", "timestamp",
        S.map_get("metadata", "device").alias("device"), S.map_get("metadata", "page").alias("page"), F.lit("ok").alias("route"),
    )
    dead = out.filter("NOT ok").groupBy(F.col("key").alias("user_id")).agg(F.count(F.lit(1)).cast("double").alias("timestamp"))
    return good.unionByName(dead.withColumn("route", F.lit("dead")), allowMissingColumns=True)


@query
def stream_dedupe(spark, d):
    """Every tenth event is sent twice; the second copies must go."""
    events = T.events(spark, d)
    twice = events.unionByName(events.filter(F.col("event_id").cast("bigint") % 10 == 0))
    table, checkpoint = L.scratch(spark, "stream-dedupe")
    stream = L.dedupe(event_stream(spark, *landed(spark, twice, "landing-dedupe")))
    L.to_table(stream.select("event_id", "user_id", "item_id", "event_type", "timestamp"), table, checkpoint, drain=True)
    return spark.read.parquet(table)


@query
def stream_batch_stats(spark, d):
    """Events and users of every micro-batch."""
    at = landed(spark, T.events(spark, d), "landing-stats")
    table, checkpoint = L.scratch(spark, "stream-stats")
    L.to_batches(event_stream(spark, *at), table, checkpoint, drain=True, mode="append", shape=L.batch_stats)
    return spark.read.parquet(table).select("events", "users")


@query
def stream_session_state(spark, d):
    at = landed(spark, T.events(spark, d), "landing-state")
    table, checkpoint = L.scratch(spark, "stream-state")
    state = L.session_state(event_stream(spark, *at), DAY, cart_event=T.CART_EVENT)
    L.to_batches(state, table, checkpoint, drain=True)
    out = L.latest_state(spark.read.parquet(table))
    return out.withColumn("recent_views", F.array_join("recent_views", ","))


@query
def stream_state_snapshot(spark, d):
    """Session state out of the newest snapshot and the batches after it; every second batch is followed by a compaction."""
    at = landed(spark, T.events(spark, d), "landing-snapshot")
    table, checkpoint = L.scratch(spark, "stream-snapshot")
    state = L.session_state(event_stream(spark, *at), DAY, cart_event=T.CART_EVENT)
    fold = lambda session, at, batch: SN.compact_state(session, at) if batch % 2 else None
    L.to_batches(state, table, checkpoint, drain=True, after=fold)
    out = SN.current_state(spark, table)
    return out.withColumn("recent_views", F.array_join("recent_views", ","))


@query
def stream_session_window(spark, d):
    at = landed(spark, T.events(spark, d), "landing-window")
    table, checkpoint = L.scratch(spark, "stream-window")
    L.to_table(L.closed_sessions(event_stream(spark, *at), DAY, cart_event=T.CART_EVENT), table, checkpoint, drain=True)
    return spark.read.parquet(table)


@query
def stream_request_rate(spark, d):
    log = T.request_log(spark, d).select("ts", "status", "device")
    table, checkpoint = L.scratch(spark, "stream-rate")
    path = new_path(spark, "landing-log")
    files = log_slices(spark, log, path)
    stream = feeds.folder_stream(spark, path, files, "ts timestamp, status string, device string")
    L.to_table(L.request_rate(stream, "1 hour", "15 minutes"), table, checkpoint, drain=True)
    return spark.read.parquet(table)


def log_slices(spark: SparkSession, log: DataFrame, path: str) -> int:
    """Write the request log as three slices and return the files of a slice."""
    return write_slices(log, F.unix_micros("ts") / 1e6, path)


def log_stream(spark: SparkSession, log: DataFrame, name: str) -> DataFrame:
    """The request log as a stream of three slices, oldest first, and an empty row 11 days behind the last.

    With a delay of ten days no row of a slice is late, and the empty row closes all windows of the others; its own
    windows stay open.
    """
    path = new_path(spark, name)
    files = log_slices(spark, log, path)
    last = log.agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select((F.col("ts") + F.expr("INTERVAL 11 DAYS")).alias("ts"))
    log.limit(0).unionByName(last, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(path)


@query
def stream_latency_quantiles(spark, d):
    """Quantiles out of streamed histograms; the rows of the batch job."""
    log = T.request_log(spark, d).select("ts", *[f"{s}_ms" for s in TM.STAGES])
    table, checkpoint = L.scratch(spark, "stream-quantiles")
    out = L.latency_quantiles(log_stream(spark, log, "landing-latency"), "1 day", "6 hours", delay="10 days")
    L.to_table(out, table, checkpoint, drain=True)
    out = spark.read.parquet(table)
    return out.select("window_end_us", "stage", *[r6(c).alias(c) for c in ("p50", "p95", "p99")])


def _stream_ratio(spark, d, status, levels):
    stream = log_stream(spark, T.request_log(spark, d).select("ts", "status"), f"landing-{status}")
    table, checkpoint = L.scratch(spark, f"stream-{status}")
    L.to_table(L.status_ratio(stream, status, levels, "1 day", "6 hours", delay="10 days"), table, checkpoint, drain=True)
    return spark.read.parquet(table).withColumn("ratio", r6("ratio"))


@query
def stream_error_rate(spark, d):
    return _stream_ratio(spark, d, "error", TM.ERROR_LEVELS)


@query
def stream_cold_start_rate(spark, d):
    return _stream_ratio(spark, d, "cold_start", TM.COLD_START_LEVELS)


@query
def stream_observed_stats(spark, d):
    """Published and observed figures of three batches, each published and drained before the next."""
    path = new_path(spark, "landing-observed")
    table, checkpoint = L.scratch(spark, "stream-observed")
    events = T.events(spark, d)
    day = F.greatest(F.lit(0), F.coalesce(F.floor((F.col("timestamp") - 1704067200.0) / 864000), F.lit(0)))
    figures, sent = L.BatchFigures(), []
    spark.streams.addListener(figures)
    try:
        for i in range(3):
            sent.append(feeds.publish(M.encode_events(events.filter(F.least(F.lit(2), day) == i)), "parquet", path=path))
            stream = L.observed(L.parse(feeds.folder_stream(spark, path)).filter("ok"))
            figures.wait(L.to_table(stream.select("event_id", "user_id", "timestamp"), table, checkpoint, drain=True))
    finally:
        spark.streams.removeListener(figures)
    rows = [
        (b["batch_id"], sent[b["batch_id"]].messages, b["events"], b["first_seen"], b["last_seen"],
         sent[b["batch_id"]].per_second > 0, b["per_second"] > 0)
        for b in figures.batches
    ]
    return spark.createDataFrame(
        rows, "batch long, published long, events long, first_seen double, last_seen double, publish_rate_known boolean, rate_known boolean"
    )


def slices(spark: SparkSession, rows: DataFrame, ts: str, name: str, heartbeat: dict) -> tuple[str, int]:
    """Rows as JSON messages in a landing folder, in three slices and a heartbeat after them, and the files of a slice."""
    path = new_path(spark, name)
    files = write_slices(rows, F.col(ts), path, lambda part: feeds.publish(LR.encode(part), "parquet", path=path))
    last = rows.agg(F.max(ts)).first()[0] or 0.0
    beat = spark.createDataFrame([heartbeat | {"user_id": "~heartbeat", ts: last + 11 * 86400.0}], rows.select("user_id", ts, *heartbeat).schema)
    feeds.publish(LR.encode(beat).coalesce(1), "parquet", path=path)
    return path, files


def live_answers(spark: SparkSession, d: str, requests: DataFrame, feedback: bool) -> DataFrame:
    """Answers to the requests as a stream over event, feedback and request messages, up to ten days late."""
    fields = ["event_id", "user_id", "item_id", "event_type", "session_id", "timestamp", "metadata"]
    events = [event_stream(spark, *slices(spark, T.events(spark, d).select(*fields), "timestamp", "live-events", {"event_id": "~"}))]
    if feedback:
        posts = slices(spark, T.raw_feedback(spark, d), "received_ts", "live-feedback", {"event_type": "~"})
        events.append(LR.parse_feedback(feeds.folder_stream(spark, *posts)))
    asked = LR.parse_requests(feeds.folder_stream(spark, *slices(spark, requests, "request_ts", "live-requests", {"request_id": "~"})))
    return LR.answers(events, asked, DAY, delay="10 days", cart_event=T.CART_EVENT).where("user_id <> '~heartbeat'")


@query
def stream_feedback_state(spark, d):
    """Session features of every request, read from live state over click events and feedback."""
    requests = T.requests(spark, d)
    table, checkpoint = L.scratch(spark, "stream-feedback")
    L.to_table(live_answers(spark, d, requests, feedback=True), table, checkpoint, drain=True)
    return spark.read.parquet(table).select(
        "request_id", "user_id", "n_recommendations", "session_length", r6("session_age_seconds").alias("session_age_seconds"),
        r6("last_seen_timestamp").alias("last_seen_timestamp"), "has_cart_item", F.array_join("recent_views", ",").alias("recent_views"),
    )


@query
def stream_recommend(spark, d):
    """Requests out of a topic, joined with live state and answered in several micro-batches."""
    static = serving_tables(spark, d)
    table, checkpoint = L.scratch(spark, "stream-recommend")

    def answer(batch: DataFrame, batch_id: int) -> DataFrame:
        asked = cut(batch)  # the state is advanced once
        return REC.respond(asked, REC.recommend(asked, static, R.linear_scorer(WEIGHTS), exact=True))

    L.to_batches(live_answers(spark, d, T.requests(spark, d), feedback=False), table, checkpoint, drain=True, mode="append", shape=answer)
    out = spark.read.parquet(table)
    return out.select(
        "request_id", "user_id", "status", F.size("recommendations").alias("n"),
        F.array_join(F.transform("recommendations", lambda x: x["item_id"]), ",").alias("item_ids"),
        r6("diversity").alias("diversity"), "model_version",
    )
