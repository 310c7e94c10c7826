"""Shared pieces of the corpus operators: table access, task-side text batches, sizing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clickloom.session import configure

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a batch of whole texts stays within a few MB."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, rows: int = 0, per_task: int = 2_000_000) -> int:
    """Number of shuffle owners: the session's setting, or more where the rows ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_task))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def text_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, texts) in groups of about `limit` bytes; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for rb in batches:
        for i, t in zip(rb.column(0).to_pylist(), as_bytes(rb.column(1))):
            if texts and size + len(t) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
