"""Event messages: JSON on the wire, columns in the tables, feedback and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.functions.schemas import EVENT

MIN_N, MAX_N, DEFAULT_N = 1, 50, 10


def encode_events(events: DataFrame) -> DataFrame:
    """Key and JSON value of each event (absent fields are left out), ready for a message sink."""
    fields = [f.name for f in EVENT.fields]
    return events.select(
        F.coalesce("user_id", F.lit("")).alias("key"), F.to_json(F.struct(*fields)).alias("value"), "event_id"
    )


def damaged(messages: DataFrame, every: int = 50) -> DataFrame:
    """Cut messages short, to exercise the dead-letter route."""
    n = F.col("event_id").cast("bigint")
    cut_short = F.substring("value", 1, 20)
    return messages.withColumn("value", F.when(n % every == 0, cut_short).otherwise(F.col("value")))


def parsed(value: Column | str = "value") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.from_json(value.cast("string"), EVENT, {"mode": "PERMISSIVE"})


def parse_columns(messages: DataFrame) -> DataFrame:
    """Every message with its parsed fields; a message that is not an event has `ok` = false.

    A cut message may still parse in part, so all of the key fields must be there.
    """
    out = messages.withColumn("_e", parsed())
    good = F.col("_e.event_id").isNotNull() & F.col("_e.user_id").isNotNull() & F.col("_e.timestamp").isNotNull()
    good = good & ~F.isnan("_e.timestamp")
    return out.select(
        F.coalesce(good, F.lit(False)).alias("ok"),
        "key",
        "value",
        *[F.col(f"_e.{f.name}").alias(f.name) for f in EVENT.fields if f.name != "metadata"],
        S.map_or_empty("_e.metadata").alias("metadata"),
    )


def parse_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = parse_columns(messages)
    good = both.filter("ok").drop("ok", "key", "value")
    dead = both.filter("NOT ok").select(F.col("key").alias("user_id"), "value")
    return good, dead


def feedback_events(feedback: DataFrame) -> DataFrame:
    """Feedback posts in the shape of events (id `fb-<second>`, no session when none is given)."""
    return feedback.select(
        F.concat(F.lit("fb-"), F.floor("received_ts").cast("string")).alias("event_id"),
        "user_id",
        "item_id",
        "event_type",
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.col("received_ts").alias("timestamp"),
        S.map_or_empty("context").alias("metadata"),
    )


def rejected(n: str) -> Column:
    """Whether the asked length of a list is out of bounds (no length is not)."""
    return F.coalesce(~F.col(n).between(MIN_N, MAX_N), F.lit(False))


def accepted(requests: DataFrame) -> DataFrame:
    """Requests whose list length is in bounds, with the default where none is given."""
    return requests.filter(~rejected("n_recommendations")).withColumn(
        "n_recommendations", F.coalesce("n_recommendations", F.lit(DEFAULT_N))
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Fill the default list length and name the reason of a rejection (NULL when accepted)."""
    n = F.coalesce("n_recommendations", F.lit(DEFAULT_N))
    reason = (
        F.when(F.col("user_id").isNull(), "user_id missing")
        .when(n < MIN_N, "n_recommendations below 1")
        .when(n > MAX_N, "n_recommendations above 50")
    )
    return requests.select(
        "request_id",
        "user_id",
        n.cast("int").alias("n_recommendations"),
        *[c for c in requests.columns if c not in ("request_id", "user_id", "n_recommendations", "context")],
        S.map_or_empty("context").alias("context"),
        reason.alias("reason"),
    )
