"""Cleaning of reviews and catalogue rows, and the activity filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.functions import vectors as V
from clickloom.session import cut

MIN_USER_ROWS = 5
MIN_ITEM_ROWS = 10


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Rename the key, read the time leniently, and drop rows with a missing key field."""
    return reviews.select(
        "user_id",
        F.col("asin").alias("item_id"),
        S.lenient_double("rating").alias("rating"),
        S.lenient_double("timestamp").alias("timestamp"),
        "verified_purchase",
    ).na.drop(subset=["user_id", "item_id", "rating", "timestamp"])


def activity_filter(
    rows: DataFrame, min_user: int = MIN_USER_ROWS, min_item: int = MIN_ITEM_ROWS, passes: int = 2
) -> DataFrame:
    """Keep active users, then popular items, exactly `passes` times (not a fixpoint).

    The counting runs on (user, item, count) cells, so a hot key is reduced before it is shuffled.
    Each surviving key set is fixed on shared storage; the rows themselves are semi-joined only
    with the last two sets, as every set is a subset of the one before it.
    """
    cells = cut(rows.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")))
    users = items = None
    for _ in range(passes):
        left = cells if items is None else cells.join(items, "item_id", "left_semi")
        if users is not None:
            left = left.join(users, "user_id", "left_semi")
        users = cut(left.groupBy("user_id").agg(F.sum("n").alias("c")).filter(F.col("c") >= min_user).select("user_id"))
        left = cells.join(users, "user_id", "left_semi")
        if items is not None:
            left = left.join(items, "item_id", "left_semi")
        items = cut(left.groupBy("item_id").agg(F.sum("n").alias("c")).filter(F.col("c") >= min_item).select("item_id"))
    return rows.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi").select(*rows.columns)


def clean_items(meta: DataFrame, valid_items: DataFrame | None = None, order: str = "row_order") -> DataFrame:
    """Seven catalogue fields per key, the first row of a repeated key winning.

    `min_by` keeps one row per key with partial aggregation, so a key repeated very often is
    reduced before the shuffle.
    """
    shaped = meta.select(
        S.key_or("parent_asin", "asin").alias("item_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        S.first_or("categories").alias("category"),
        S.parse_price("price").alias("price"),
        S.safe_float("average_rating").alias("avg_rating"),
        F.coalesce("rating_number", F.lit(0)).cast("bigint").alias("review_count"),
        S.snippet("description").alias("description_snippet"),
        F.col(order).alias("_order"),
    )
    if valid_items is not None:
        shaped = shaped.join(valid_items.select("item_id").distinct(), "item_id", "left_semi")
    fields = ["title", "category", "price", "avg_rating", "review_count", "description_snippet"]
    first = shaped.groupBy("item_id").agg(F.min_by(F.struct(*fields), "_order").alias("r"))
    return first.select("item_id", *[F.col(f"r.{f}").alias(f) for f in fields])


def history(interactions: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs: the items a user has had. Long form, so no list grows per user."""
    return interactions.select("user_id", "item_id").distinct()


def upsert_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the whole history of every user in `new`; the others keep theirs."""
    return old.join(new.select("user_id").distinct(), "user_id", "left_anti").unionByName(new.select(*old.columns))


def normalise_epochs(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Milliseconds to seconds when the global median is above 1e12, then a timestamp; bad rows go.

    The median is compared without sorting: it is above the line when more than half of the
    values are, and at exactly half it is the mean of the two values next to the line.
    """
    line = 1e12
    v = S.lenient_double(ts)
    stats = rows.select(v.alias("v")).agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v") > line).alias("above"),
        F.max(F.when(F.col("v") <= line, F.col("v"))).alias("lo"),
        F.min(F.when(F.col("v") > line, F.col("v"))).alias("hi"),
    )
    in_ms = stats.select(
        F.coalesce(
            (F.col("above") * 2 > F.col("n"))
            | ((F.col("above") * 2 == F.col("n")) & ((F.col("lo") + F.col("hi")) / 2 > line)),
            F.lit(False),
        )
    ).scalar()
    seconds = F.when(F.col("_ms"), F.col("_v") / 1000).otherwise(F.col("_v"))
    return (
        rows.withColumn("_v", v)
        .withColumn("_ms", in_ms)
        .withColumn("epoch", seconds)
        .filter(F.col("epoch").isNotNull())
        .withColumn("date", F.timestamp_seconds("epoch"))
        .drop("_v", "_ms")
    )


def confidence_cells(interactions: DataFrame, alpha: float = 40.0) -> DataFrame:
    """Confidence 1 + alpha * rating, summed over repeated (user, item) cells."""
    return interactions.groupBy("user_id", "item_id").agg(
        F.sum(F.lit(1.0) + F.lit(alpha) * F.col("rating")).alias("confidence")
    )


def index_rows(items: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Index documents: items that have a (non-zero) vector, with safe numbers."""
    return items.join(embeddings.filter(~V.is_zero("embedding")), "item_id").select(
        "item_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        S.safe_float("price").alias("price"),
        S.safe_float("avg_rating").alias("avg_rating"),
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )


def popular(items: DataFrame, n: int) -> DataFrame:
    """Top n by review count. The limit is the operator: a top-n plan, no full sort."""
    top = items.orderBy(F.desc("review_count"), "item_id").limit(n)
    return top.select(
        "item_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"),
        F.lit(0.0).alias("score"),
    )
