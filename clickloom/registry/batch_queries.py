"""Queries over the whole given tables: cleaning, profile, sessions, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.functions import text as X
from clickloom.functions import vectors as V
from clickloom.operators import catalogue as C
from clickloom.operators import messages as M
from clickloom.operators import profile as P
from clickloom.operators import sessions as E
from clickloom.session import new_path
from clickloom.sources import datasets as D
from clickloom.sources import tables as T

# The default 5/10 thresholds remove almost nothing from the given tables; these shrink at every step.
MIN_USER, MIN_ITEM = 25, 24
# With gaps of hours between events, a day is the life time that fills and overflows the views list.
DAY = 86400.0

Q = {}


def query(fn):
    Q[fn.__name__] = fn
    return fn


def r6(col):
    return F.round(col, 6)


# ------------------------------------------------------------------ cleaning


@query
def scan_interactions(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_reviews(T.raw_reviews(spark, d))


@query
def scan_reviews_json(spark, d):
    """Reviews written as JSON lines and read back with the declared schema, which drops the field that it does not name."""
    path = new_path(spark, "reviews-json")
    T.raw_reviews(spark, d).withColumn("helpful_vote", F.lit(1)).write.json(path)
    return C.clean_reviews(D.scan_reviews(spark, path, "json"))


@query
def scan_item_meta_json(spark, d):
    """Catalogue rows written as JSON lines and read back with the declared schema."""
    path = new_path(spark, "meta-json")
    T.raw_item_meta(spark, d).write.json(path)
    return D.scan_item_meta(spark, path, "json").select(
        "parent_asin", "title", F.array_join("categories", "|").alias("categories"), "price", "average_rating", "rating_number",
        F.array_join("description", "|", "-").alias("description"),
    )


@query
def scan_items(spark, d):
    meta = T.raw_item_meta(spark, d)
    return meta.select(
        "asin",
        "parent_asin",
        "title",
        F.array_join("categories", "|").alias("categories"),
        "price",
        "average_rating",
        "rating_number",
        F.array_join("description", "|", "-").alias("description"),
        "row_order",
    )


@query
def price_parse(spark, d):
    meta = T.raw_item_meta(spark, d)
    return meta.select("row_order", F.col("price").alias("raw"), S.parse_price("price").alias("price"))


@query
def items_build(spark, d):
    return C.clean_items(T.raw_item_meta(spark, d), T.interactions(spark, d))


@query
def dataset_roundtrip(spark, d):
    """Build both tables once, find them again on the second call, and read them back."""
    base = new_path(spark, "dataset")
    for _ in range(2):
        inter, items = D.build_or_reuse(
            spark, base, lambda: T.interactions(spark, d), lambda valid: C.clean_items(T.raw_item_meta(spark, d), valid),
            min_user=MIN_USER, min_item=MIN_ITEM,
        )
    return inter.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum")).join(
        items.select("item_id", "title", "price"), "item_id"
    )


@query
def ts_normalize(spark, d):
    """Event times in milliseconds as text; error events carry text that is not a number."""
    raw = T.events(spark, d).select(
        "event_id",
        F.when(F.col("event_type") == "error", "abc")
        .otherwise(F.floor(F.col("timestamp") * 1000).cast("string"))
        .alias("timestamp"),
    )
    out = C.normalise_epochs(raw)
    return out.select("event_id", r6("epoch").alias("epoch"), F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query
def kcore_two_pass(spark, d):
    return C.activity_filter(T.interactions(spark, d), MIN_USER, MIN_ITEM)


@query
def user_history(spark, d):
    """Users' items after a reload of the users with verified purchases."""
    rows = T.interactions(spark, d)
    fresh = C.history(rows.filter("verified_purchase"))
    return C.upsert_history(C.history(rows), fresh)


@query
def confidence_matrix(spark, d):
    from clickloom.operators import factors as A

    cells = C.confidence_cells(T.interactions(spark, d))
    encoded, _, _ = A.encode(cells)
    return encoded.select("user_id", "item_id", "user_idx", "item_idx", "confidence")


@query
def text_corpus(spark, d):
    return T.items(spark, d).select("item_id", X.item_text().alias("text"))


# ------------------------------------------------------------------ profile


@query
def eda_sparsity(spark, d):
    return P.sparsity(T.interactions(spark, d)).withColumn("sparsity", r6("sparsity"))


@query
def eda_rating_hist(spark, d):
    return P.rating_histogram(T.interactions(spark, d))


@query
def eda_user_activity(spark, d):
    return P.user_activity(T.interactions(spark, d)).withColumn("mean_rows", r6("mean_rows"))


@query
def eda_activity_hist(spark, d):
    return P.activity_bins(T.interactions(spark, d)).withColumn("lower", r6("lower"))


@query
def eda_top_share(spark, d):
    return P.top_share(T.interactions(spark, d)).withColumn("top_share", r6("top_share"))


@query
def eda_item_popularity(spark, d):
    return P.item_popularity(T.interactions(spark, d))


@query
def eda_monthly(spark, d):
    return P.monthly(C.normalise_epochs(T.interactions(spark, d)))


@query
def eda_dow(spark, d):
    return P.weekdays(C.normalise_epochs(T.interactions(spark, d)))


# ------------------------------------------------------------------ events and sessions


@query
def event_encode(spark, d):
    return M.encode_events(T.events(spark, d)).select("key", "value")


@query
def event_parse(spark, d):
    """JSON messages back to columns; every 50th message is damaged and goes to the dead letters."""
    raw = M.damaged(M.encode_events(T.events(spark, d)))
    good, bad = M.parse_events(raw)
    flat = good.select(
        "event_id", "user_id", "item_id", "event_type", "session_id", "timestamp",
        S.map_get("metadata", "device").alias("device"), S.map_get("metadata", "page").alias("page"),
        F.lit("ok").alias("route"),
    )
    dead = bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("string").alias("event_id"), "user_id", F.lit(None).cast("string").alias("item_id"),
        F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("session_id"),
        F.col("n").cast("double").alias("timestamp"), F.lit(None).cast("string").alias("device"),
        F.lit(None).cast("string").alias("page"), F.lit("dead").alias("route"),
    )
    return flat.unionByName(dead)


@query
def event_enrich_page(spark, d):
    return T.events(spark, d).select("event_id", "event_type", S.page_for("event_type").alias("page"))


@query
def feedback_to_events(spark, d):
    both = T.events(spark, d).unionByName(M.feedback_events(T.raw_feedback(spark, d)))
    return both.select(
        "event_id", "user_id", "item_id", "event_type", "session_id", "timestamp",
        S.map_get("metadata", "device", "none").alias("device"),
    )


@query
def request_validate(spark, d):
    return M.validate_requests(T.raw_requests(spark, d)).select(
        "request_id", "user_id", "n_recommendations", "reason", S.map_get("context", "device", "desktop").alias("device")
    )


@query
def event_mix(spark, d):
    return E.event_mix(T.events(spark, d)).withColumn("share", r6("share"))


@query
def session_integrity(spark, d):
    """Checked against a feed in which days, not users, name the sessions."""
    day = F.substring("session_id", -8, 8)
    return E.session_integrity(T.events(spark, d).withColumn("session_id", day))


@query
def sessionize(spark, d):
    run = E.runs(T.events(spark, d), E.TTL_SECONDS, T.CART_EVENT)
    return E.session_table(run)


@query
def session_state(spark, d):
    return E.current_sessions(E.runs(T.events(spark, d), DAY, T.CART_EVENT))


@query
def session_running(spark, d):
    run = E.runs(T.events(spark, d), DAY, T.CART_EVENT)
    return run.select(
        "event_id", "user_id", "session_no", "session_start",
        F.col("n_so_far").alias("events_so_far"), F.col("flag_so_far").alias("cart_so_far"),
    )


@query
def recent_views(spark, d):
    return E.recent_views(E.view_runs(T.events(spark, d), DAY))


@query
def session_asof(spark, d):
    at = E.state_at(T.point_requests(spark, d), T.events(spark, d), DAY, T.CART_EVENT)
    return at.select(
        "request_id", "user_id", "session_length", r6("session_age_seconds").alias("session_age_seconds"),
        r6("last_seen_timestamp").alias("last_seen_timestamp"), "has_cart_item",
        F.array_join("recent_views", ",").alias("recent_views"),
    )


@query
def session_flow(spark, d):
    return E.transitions(T.events(spark, d), DAY).withColumn("share", r6("share"))


# ------------------------------------------------------------------ vectors


@query
def vector_normalize(spark, d):
    out = T.item_embeddings(spark, d).select("item_id", F.posexplode(V.unit("embedding")).alias("axis", "x"))
    return out.select("item_id", "axis", r6("x").alias("x"))


@query
def user_vector_projection(spark, d):
    out = T.user_factors(spark, d).select(
        "user_id", F.posexplode(V.project_user("features", T.TOTAL_DIM)).alias("axis", "x")
    )
    return out.select("user_id", "axis", r6("x").alias("x"))
