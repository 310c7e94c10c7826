"""Exact dedup: Golomb-coded fingerprint exchange, duplicate bitmaps, byte check of the suspects only.

Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row
with the largest doc_id stays (a null id is smaller than any; of repeated rows with one id and text
exactly one stays). An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import golomb
from clickloom.llm.common import ASCII_LOWER, as_bytes, rows, tasks
from clickloom.session import stage

SENT = pa.schema([
    ("part", pa.int64()), ("owner", pa.int32()), ("blob", pa.binary()), ("rid", pa.int64()), ("doc_id", pa.int64()),
    ("sha", pa.binary()), ("pos", pa.int32()), ("twice", pa.bool_()),
])
SENT_DDL = "part long, owner int, blob binary, rid long, doc_id long, sha binary, pos int, twice boolean"


SALTS = 32
MARK_BITS = 1 << 26  # of the bitmap that marks the ids of suspects: 8 MB


def normalised(text):
    """Column expression: A-Z lowered, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _send(owners: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        ids, shas = [], []
        for rb in batches:
            ids += rb.column(0).to_pylist()
            shas += [hashlib.sha256(t.translate(ASCII_LOWER)).digest() for t in as_bytes(rb.column(1))]
        if not ids:
            return
        prints = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
        own, back, n = np.unique(prints, return_inverse=True, return_counts=True)
        sent = golomb.runs(own, owners)
        start = np.zeros(owners, np.int64)
        for o, a, _ in sent:
            start[o] = a
        k = len(sent)
        none = [None] * k
        yield rows(SENT, [part] * k, [o for o, _, _ in sent], [golomb.encode(own[a:b]) for _, a, b in sent],
                   none, none, none, none, none)
        owner = golomb.owner_of(prints, owners)
        pos, twice = back - start[owner], n[back] > 1
        for a in range(0, len(ids), 4096):
            s = slice(a, a + 4096)
            m = len(ids[s])
            rid = (part << 33) + a + np.arange(m)
            yield rows(SENT, [part] * m, owner[s], [None] * m, rid, ids[s], shas[s], pos[s], twice[s])

    return run


def _marked(source: DataFrame, suspects: DataFrame) -> DataFrame:
    """Rows of `source` that may have a suspect's doc_id: all that have, and a few others.

    The ids of the suspects set bits of one bitmap, which is sent to the texts. So a text is filtered where it is read,
    however many suspects there are, and the texts of other rows are not shuffled.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    bitmap = (
        suspects.select(place.alias("place")).distinct().groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    )
    asked = source.withColumn("at", F.bitmap_bit_position(place)).withColumn("of", F.bitmap_bucket_number(place))
    byte = F.conv(F.hex(F.expr("substring(bits, int(at div 8) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("1 << int(at % 8)").bitwiseAND(byte) > 0
    return asked.join(F.broadcast(bitmap), (F.col("of") == F.col("bucket")) & bit, "left_semi").drop("at", "of")


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    owners = tasks(spark, source.count())
    sent = stage(source.mapInArrow(_send(owners), SENT_DDL), "prints")
    members = sent.where("blob is null").drop("blob")
    marks = golomb.bitmaps(sent.where("blob is not null"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, pos div 8 + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("1 << (7 - pos % 8)").bitwiseAND(byte) > 0
    flagged = stage(
        members.join(marks, ["part", "owner"]).select("rid", "doc_id", "sha", (F.col("twice") | bit).alias("suspect")),
        "suspects",
    )
    suspects = flagged.where("suspect")
    texts = _marked(source, suspects).select(normalised(F.col("text")).alias("norm"))
    checked = (
        texts.groupBy("norm").count().select(F.unhex(F.sha2("norm", 256)).alias("sha"))
        .groupBy("sha").agg(F.count("*").alias("texts"))
    )
    groups = suspects.groupBy("sha").agg(
        F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")
    )
    # two texts under one SHA-256 would be a collision: stop rather than drop a text
    verified = groups.join(checked, "sha").select(
        "sha", "group_size", F.when(F.col("texts") == 1, F.col("keep")).otherwise(F.raise_error(F.lit("SHA-256 collision"))).alias("keep")
    )
    out = [F.col("doc_id"), F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"),
           F.lower(F.hex("sha")).alias("text_sha256")]
    single = flagged.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    # members of one text are spread over several tasks, its answer is sent to each of them
    members = suspects.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
    answers = verified.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.join(answers, ["sha", "salt"]).select(*out).unionByName(single)


def dedup(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that stay, with all their columns.

    The texts are shuffled once, whatever the size: by the key of id and text, of which one row is left before the
    shuffle, and by which the rows then meet the keys that go.
    """
    key = lambda sha: F.concat(sha, F.lit(":"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    found = stage(classes(docs).select(key(F.col("text_sha256")).alias("__own"), "kept"), "classes")
    gone = found.groupBy("__own").agg(F.max("kept").alias("stays")).where("not stays").select("__own")
    keyed = docs.withColumn("__own", key(F.sha2(normalised(F.col("text")), 256)))
    one = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__own").orderBy("__own"))).where("__n = 1")
    return one.join(gone, "__own", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
