"""Model tables derived from a folder of star-schema parquet tables.

Every query reads its inputs through this module, so it is the one place that knows how orders
stand in for reviews and parts for the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalars as S

# How the 64 embedding axes are split into a collaborative and a text part, and which users own
# a factor vector (the user whose number is vec_id plus this offset).
CF_DIM = 40
TOTAL_DIM = 64
FACTOR_USER_OFFSET = 100

CART_EVENT = "click"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _id(col: str) -> Column:
    return F.col(col).cast("string")


# ---------------------------------------------------------------- interactions and catalogue


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as reviews. The time is text; a few lines carry text that is not a number."""
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    seconds = F.floor(S.epoch_seconds("o_orderdate")).cast("string")
    broken = (F.col("l_linenumber") == 7) & (F.col("o_orderstatus") == "P")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _id("o_custkey").alias("user_id"),
        _id("l_partkey").alias("asin"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.when(broken, F.lit("abc")).otherwise(seconds).alias("timestamp"),
        (F.col("o_orderstatus") == "F").alias("verified_purchase"),
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _id("o_custkey").alias("user_id"),
        _id("l_partkey").alias("item_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
        F.floor(S.epoch_seconds("o_orderdate")).cast("double").alias("timestamp"),
        (F.col("o_orderstatus") == "F").alias("verified_purchase"),
    )


def item_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rating and number of reviews per item; needs the order lines only."""
    return (
        read(spark, folder, "lineitem")
        .groupBy(_id("l_partkey").alias("item_id"))
        .agg(
            F.avg(F.ceil(F.col("l_quantity") / 10).cast("double")).alias("avg_rating"),
            F.count(F.lit(1)).alias("review_count"),
        )
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    part = read(spark, folder, "part").select(
        _id("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string")).alias("description_snippet"),
    )
    return part.join(item_ratings(spark, folder), "item_id", "left").select(
        "item_id",
        "title",
        "category",
        "price",
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count"),
        "description_snippet",
    )


def price_text(price: str = "p_retailprice", size: str = "p_size") -> Column:
    """Prices the way shops write them: thousands marks, currency sign, blanks, and no price at all."""
    cents = F.round(F.col(price) * 100).cast("bigint")
    whole = F.expr(f"cast(round({price} * 100) as bigint) div 100")
    fraction = F.lpad((cents % 100).cast("string"), 2, "0")
    big = F.concat(
        F.lit(" $"),
        F.floor(whole / 1000).cast("string"),
        F.lit(","),
        F.lpad((whole % 1000).cast("string"), 3, "0"),
        F.lit("."),
        fraction,
    )
    small = F.concat(F.lit("$"), whole.cast("string"), F.lit("."), fraction, F.lit(" "))
    return (
        F.when(F.col(size) % 11 == 0, F.lit(None).cast("string"))
        .when(F.col(size) % 7 == 0, F.lit("n/a"))
        .when(F.col(size) % 5 == 0, F.col(price).cast("decimal(12,2)").cast("string"))
        .when(cents >= 100000, big)
        .otherwise(small)
    )


def raw_item_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue rows before cleaning, with gaps, list columns and repeated keys.

    `row_order` is the order of the feed; small parts appear a second time with a changed title.
    """
    size = F.col("p_size")
    part = read(spark, folder, "part")
    first = part.select(
        F.when(size % 9 == 0, F.lit("")).otherwise(_id("p_partkey")).alias("parent_asin"),
        _id("p_partkey").alias("asin"),
        F.when(size % 13 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("title"),
        F.when(size % 10 == 1, F.lit(None).cast("array<string>"))
        .when(size % 10 == 2, F.array().cast("array<string>"))
        .otherwise(F.array("p_type", "p_brand"))
        .alias("categories"),
        price_text().alias("price"),
        F.when(size % 8 == 0, F.lit(None)).otherwise(size / 10.0).alias("average_rating"),
        F.when(size % 6 == 0, F.lit(None)).otherwise(F.col("p_partkey") % 97).cast("bigint").alias("rating_number"),
        F.when(size % 12 == 5, F.lit(None).cast("array<string>"))
        .otherwise(
            F.array(
                "p_brand",
                F.when(size % 3 == 0, F.lit(None)).otherwise(F.col("p_name")),
                F.repeat(F.concat(F.col("p_type"), F.lit(" ")), (size % 40).cast("int")),
            )
        )
        .alias("description"),
        F.col("p_partkey").alias("row_order"),
        size.alias("p_size"),
    )
    again = (
        first.filter(F.col("p_size") < 5)
        .withColumn("title", F.upper("title"))
        .withColumn("row_order", F.col("row_order") + F.lit(10_000_000_000))
    )
    return first.unionByName(again).drop("p_size")


# ---------------------------------------------------------------- events and requests


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Click events. Error events carry no item."""
    item = F.get_json_object("props", "$.k")
    n = F.col("event_id")
    device = F.element_at(F.array(F.lit("mobile"), F.lit("desktop"), F.lit("tablet")), (n % 3 + 1).cast("int"))
    referrer = F.element_at(
        F.array(*[F.lit(x) for x in ("search", "newsletter", "partner", "app", "bookmark")]), (n % 5 + 1).cast("int")
    )
    meta = F.create_map(
        F.lit("page"), S.page_for("event_type"), F.lit("referrer"), referrer, F.lit("device"), device
    )
    return read(spark, folder, "events").select(
        _id("event_id").alias("event_id"),
        _id("user_id").alias("user_id"),
        F.when(F.col("event_type") != "error", item).alias("item_id"),
        "event_type",
        F.concat(_id("user_id"), F.lit("-"), F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")).alias(
            "session_id"
        ),
        S.epoch_seconds("ts").alias("timestamp"),
        F.when(n % 17 != 0, meta).alias("metadata"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One recommendation request per customer, spread over the month of the events."""
    key = F.col("c_custkey")
    device = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "mobile")
        .when(F.col("c_mktsegment") == "FURNITURE", "tablet")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "desktop")
    )
    return read(spark, folder, "customer").select(
        F.concat(F.lit("r"), _id("c_custkey")).alias("request_id"),
        _id("c_custkey").alias("user_id"),
        (key % 10 + 5).cast("int").alias("n_recommendations"),
        (F.lit(1704067200.0) + (key * 7919) % 2592000).alias("request_ts"),
        F.when(device.isNotNull(), F.create_map(F.lit("device"), device)).alias("context"),
    )


def point_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Many requests per user: one per order, spread over the month of the events."""
    return read(spark, folder, "orders").select(
        _id("o_orderkey").alias("request_id"),
        _id("o_custkey").alias("user_id"),
        (F.lit(1704067200.0) + (F.col("o_orderkey") * 7919) % 2592000).alias("request_ts"),
    )


def raw_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as they arrive: the list length may be missing or out of bounds, a user may be missing."""
    key = F.col("o_orderkey")
    return read(spark, folder, "orders").select(
        _id("o_orderkey").alias("request_id"),
        F.when(key % 29 != 0, _id("o_custkey")).alias("user_id"),
        F.when(key % 7 != 0, key % 60).cast("int").alias("n_recommendations"),
        (F.lit(1704067200.0) + (key * 7919) % 2592000).alias("request_ts"),
        F.when(key % 2 == 0, F.create_map(F.lit("device"), F.lit("mobile"))).alias("context"),
    )


def raw_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback posts: every purchase event, sent back by the shop."""
    e = events(spark, folder).filter(F.col("event_type") == "purchase")
    return e.select(
        "user_id",
        "item_id",
        "event_type",
        F.when(F.col("event_id").cast("bigint") % 2 == 0, F.col("session_id")).alias("session_id"),
        F.col("timestamp").alias("received_ts"),
        F.col("metadata").alias("context"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Served requests with status, device and stage times."""
    n = F.col("event_id")
    device = F.element_at(F.array(F.lit("mobile"), F.lit("desktop"), F.lit("tablet")), (n % 3 + 1).cast("int"))
    return read(spark, folder, "events").select(
        _id("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "signup", "cold_start")
        .otherwise("success")
        .alias("status"),
        device.alias("device"),
        (F.col("value") * 0.75).alias("retrieval_ms"),
        (F.col("value") * 0.25).alias("ranking_ms"),
        F.col("value").alias("total_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("n_candidates"),
        (F.pmod(n, F.lit(10)) / 10.0).alias("diversity"),
    )


# ---------------------------------------------------------------- vectors, text, labels


def item_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(_id("vec_id").alias("item_id"), "embedding")


def user_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Collaborative vectors of known users (the first CF_DIM axes of the item space)."""
    return read(spark, folder, "embeddings").select(
        (F.col("vec_id") + FACTOR_USER_OFFSET).cast("string").alias("user_id"),
        F.slice("embedding", 1, CF_DIM).alias("features"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(_id("doc_id").alias("doc_id"), "text")


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Binary labels with a score: document length as a predictor of quality."""
    labels = read(spark, folder, "labels").select("doc_id", "quality")
    docs = read(spark, folder, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        _id("doc_id").alias("row_id"), F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score")
    )
