"""Processed tables on storage: build once, reuse afterwards; the item index; the run log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import catalogue as C


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished table (one with a success marker) is at the path, on any file system."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def scan_reviews(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw reviews with the declared schema: only its five columns are read."""
    from clickloom.functions.schemas import REVIEWS

    return spark.read.format(fmt).schema(REVIEWS).load(path)


def scan_item_meta(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    from clickloom.functions.schemas import ITEM_META

    return spark.read.format(fmt).schema(ITEM_META).load(path)


def build_or_reuse(
    spark: SparkSession,
    base: str,
    interactions: Callable[[], DataFrame],
    items: Callable[[DataFrame], DataFrame],
    *,
    force: bool = False,
    min_user: int = C.MIN_USER_ROWS,
    min_item: int = C.MIN_ITEM_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Filtered interactions and the catalogue of their items; skipped when both are on storage."""
    ip, cp = f"{base}/interactions", f"{base}/items"
    if force or not (exists(spark, ip) and exists(spark, cp)):
        C.activity_filter(interactions(), min_user, min_item).write.mode("overwrite").parquet(ip)
        items(spark.read.parquet(ip)).write.mode("overwrite").parquet(cp)
    return spark.read.parquet(ip), spark.read.parquet(cp)


def write_history(history: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the history of exactly the given users (dynamic overwrite of hash partitions).

    `history` must hold all users of the partitions it touches, which `upsert_history` gives.
    """
    rows = history.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))
    rows = rows.repartition("part")  # one file per part and task that holds it
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_index(spark: SparkSession, rows: DataFrame, path: str, recreate: bool = False) -> bool:
    """Write the item index, or leave an existing one alone. Returns whether it was written."""
    if exists(spark, path) and not recreate:
        return False
    salt = F.pmod(F.xxhash64("item_id"), F.lit(4))  # a large cluster is written by four tasks
    rows.repartition("cluster_id", salt).write.mode("overwrite").partitionBy("cluster_id").parquet(path)
    return True


def log_run(spark: SparkSession, path: str, run_id: str, stage: str, values: dict[str, float | int], params: dict | None = None) -> None:
    """Append named numbers of one stage, and the parameters it ran with, to the run log."""
    number = lambda v: float(v) if isinstance(v, (int, float)) else None
    rows = [(run_id, stage, "metric", k, float(v), None) for k, v in values.items()]
    rows += [(run_id, stage, "param", k, number(v), str(v)) for k, v in (params or {}).items()]
    log = spark.createDataFrame(rows, "run_id string, stage string, kind string, name string, value double, text string")
    log.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
