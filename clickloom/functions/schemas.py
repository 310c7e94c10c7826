"""Declared schemas of the model tables and messages."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEWS = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)

ITEM_META = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("price", T.StringType()),
        T.StructField("average_rating", T.DoubleType()),
        T.StructField("rating_number", T.LongType()),
        T.StructField("description", T.ArrayType(T.StringType())),
    ]
)

# Event time is a double: a 32-bit float has a step of 128 s at today's epoch.
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("n_recommendations", T.IntegerType()),
        T.StructField("request_ts", T.DoubleType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("received_ts", T.DoubleType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    ]
)

ITEM_INDEX = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("avg_rating", T.DoubleType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("cluster_id", T.IntegerType()),
    ]
)
