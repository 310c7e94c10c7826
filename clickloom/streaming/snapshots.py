"""Published state as a log: micro-batch folders, folded from time to time into one snapshot.

`to_batches` writes one folder per micro-batch. A snapshot `upto=N` holds the newest row of every user over
the batches 0..N, without users whose session has expired, and takes their place: a reader needs the newest
snapshot and the batches after it. An expired user needs no tombstone, since no batch below N is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.streaming.live import latest_state

BATCH, SNAPSHOT = "batch_id=", "upto="
KEPT_SNAPSHOTS = 2  # the one before the newest stays for readers that have begun with it


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders, in order; half-written ones have no success marker."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory()]
    numbers = sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())
    return [n for n in numbers if fs.exists(_folder(spark, f"{path}/{prefix}{n}/_SUCCESS")[1])]


def _newest(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(newest snapshot or -1, finished batches after it)."""
    upto = max(_finished(spark, f"{path}/snapshots", SNAPSHOT), default=-1)
    return upto, [b for b in _finished(spark, path, BATCH) if b > upto]


def current_state(spark: SparkSession, path: str, ttl: float | None = None, now: float | None = None) -> DataFrame | None:
    """Newest row of every user: the newest snapshot plus the batches after it. None before the first batch.

    With `ttl`, users last seen before `now` - `ttl` are left out; `now` is the newest time in the state if not given.
    A session that is exactly `ttl` old is still alive.
    """
    upto, batches = _newest(spark, path)
    parts = [spark.read.parquet(f"{path}/snapshots/{SNAPSHOT}{upto}").withColumn("batch_id", F.lit(upto))] if upto >= 0 else []
    if batches:
        folders = [f"{path}/{BATCH}{b}" for b in batches]
        parts.append(spark.read.option("basePath", path).parquet(*folders))
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    state = latest_state(rows)
    if ttl is None:
        return state
    end = F.lit(now) if now is not None else rows.agg(F.max("last_seen")).scalar()
    return state.filter(F.col("last_seen") >= end - ttl)


def compact_state(spark: SparkSession, path: str, ttl: float | None = None, now: float | None = None) -> int | None:
    """Fold all finished batches into a snapshot, then remove what it covers. Returns its number.

    One writer at a time. The covered batches of the snapshot before go at the next call only, so that a reader
    which has begun with that snapshot finds its files; a batch replayed below the snapshot is not read again.
    Nothing new gives None.
    """
    upto, batches = _newest(spark, path)
    if not batches:
        return None
    newest = batches[-1]
    current_state(spark, path, ttl, now).write.mode("overwrite").parquet(f"{path}/snapshots/{SNAPSHOT}{newest}")
    for b in _finished(spark, path, BATCH):
        if b <= upto:
            _remove(spark, f"{path}/{BATCH}{b}")
    for old in _finished(spark, f"{path}/snapshots", SNAPSHOT)[:-KEPT_SNAPSHOTS]:
        _remove(spark, f"{path}/snapshots/{SNAPSHOT}{old}")
    return newest


def _remove(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)
