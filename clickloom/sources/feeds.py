"""Message feeds: Kafka topics in production, landing folders elsewhere; both give key and value."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Topics of the click events and of the recommendation requests.
EVENT_TOPIC = "clickstream-events"
REQUEST_TOPIC = "recommendation-requests"

LANDING = "key string, value string, event_id string"


def kafka_stream(spark: SparkSession, servers: str, topic: str = EVENT_TOPIC, offsets: str = "latest") -> DataFrame:
    """Topic as a stream of text keys and values. Needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", offsets)
        .load()
    )
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def folder_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: str = LANDING) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@dataclass
class Published:
    messages: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.messages / self.seconds if self.seconds > 0 else 0.0


def publish(messages: DataFrame, fmt: str, **options: str) -> Published:
    """Write a batch of (key, value) messages; count and rate come from the write itself."""
    seen = Observation()
    started = time.monotonic()
    counted = messages.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = counted.write.format(fmt).options(**options)
    (writer if fmt == "kafka" else writer.mode("append")).save()
    return Published(seen.get["n"], time.monotonic() - started)


def kafka_publish(messages: DataFrame, servers: str, topic: str = EVENT_TOPIC) -> Published:
    out = messages.select("key", "value")
    return publish(out, "kafka", **{"kafka.bootstrap.servers": servers, "topic": topic})
