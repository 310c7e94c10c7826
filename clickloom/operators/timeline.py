"""Per-key timelines that do not put a whole key into one task.

Windows over (key, time bucket, piece) do the row work. Each piece is then reduced to one summary row,
a window over the summaries of a key carries the state from piece to piece, and an equi-join brings the
carried state back to the rows. Buckets with more than `HEAVY_ROWS` rows are found by a count and cut
at equal-count splitters of their own order, so a key that holds a third of all events, be it inside
one hour or without any time, is spread over as many tasks as its rows ask for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import cut

BUCKET_SECONDS = 6 * 3600
HEAVY_ROWS = 200_000
BROADCAST_ROWS = 100_000  # heavy buckets up to this number are sent to all tasks


def spread(rows: DataFrame, key: str, order: list[str], heavy_rows: int | None = None) -> DataFrame:
    """Add `_p`, the piece of each row's bucket (`key`, `_b`): 0 in a light bucket, and growing in `order` in a heavy one."""
    heavy_rows = heavy_rows or HEAVY_ROWS
    counts = rows.groupBy(F.col(key).alias("_hk"), F.col("_b").alias("_hb")).agg(F.count(F.lit(1)).alias("_hn"))
    heavy = cut(counts.where(F.col("_hn") > heavy_rows))
    found = heavy.agg(F.count(F.lit(1)).alias("buckets"), F.sum("_hn").alias("rows")).first()
    if not found.buckets:
        return rows.withColumn("_p", F.lit(0))
    heavy = heavy.drop("_hn")
    if found.buckets <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    same = rows[key].eqNullSafe(heavy["_hk"]) & rows["_b"].eqNullSafe(heavy["_hb"])
    light = rows.join(heavy, same, "left_anti").withColumn("_p", F.lit(0))
    # the last column parts rows that are equal in all others
    many = rows.join(heavy, same, "left_semi").withColumn("_u", F.monotonically_increasing_id())
    dealt = many.repartitionByRange(math.ceil(found.rows / heavy_rows), key, "_b", *order, "_u")
    return light.unionByName(cut(dealt.withColumn("_p", F.spark_partition_id()).drop("_u")))


def session_runs(
    events: DataFrame,
    ttl_seconds: float,
    *,
    key: str = "user_id",
    ts: str = "timestamp",
    tie: str = "event_id",
    flag: Column | None = None,
    previous: tuple[str, ...] = (),
    bucket_seconds: int = BUCKET_SECONDS,
    heavy_rows: int | None = None,
) -> DataFrame:
    """Inactivity sessions with a running view of each.

    A gap above `ttl_seconds` opens a session; a gap equal to it does not. Adds, per event:
    pos (1-based place in the key's timeline), session_no (from 1), session_start, start_pos,
    n_so_far, flag_so_far, prev_ts, is_start, and prev_<column> for every name in `previous`
    (the value on the previous event of the key, also across sessions).
    """
    hit = F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False)
    base = events.withColumn("_b", F.floor(F.col(ts) / bucket_seconds)).withColumn("_hit", hit)
    base = spread(base, key, [ts, tie], heavy_rows)
    part = [key, "_b", "_p"]
    order = Window.partitionBy(*part).orderBy(ts, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        base.withColumn("_rn", F.row_number().over(order).cast("bigint"))
        .withColumn("_lag_ts", F.lag(ts).over(order))
        .withColumns({f"_lag_{c}": F.lag(c).over(order) for c in previous})
        .withColumn("_brk", F.coalesce(F.col(ts) - F.col("_lag_ts") > ttl_seconds, F.lit(False)))
        .withColumns(
            {
                "_nbrk": F.sum(F.col("_brk").cast("bigint")).over(upto),
                "_start_rn": F.max(F.when(F.col("_brk"), F.col("_rn"))).over(upto),
                "_start_ts": F.max(F.when(F.col("_brk"), F.col(ts))).over(upto),
                "_hit_rn": F.max(F.when(F.col("_hit"), F.col("_rn"))).over(upto),
            }
        )
    )
    last_of = F.max_by(F.struct(*[F.col(c).alias(c) for c in previous]), "_rn") if previous else F.lit(None)
    summary = local.groupBy(*part).agg(
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        F.max("_rn").alias("_n"),
        F.max("_nbrk").alias("_breaks"),
        F.max("_start_rn").alias("_b_start_rn"),
        F.max("_start_ts").alias("_b_start_ts"),
        F.max("_hit_rn").alias("_b_hit_rn"),
        *([last_of.alias("_b_last")] if previous else []),
    )
    line = Window.partitionBy(key).orderBy("_b", "_p")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summary.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_prev_last", F.lag("_last").over(line))
        .withColumns({"_prev_struct": F.lag("_b_last").over(line)} if previous else {})
        .withColumn("_head", F.coalesce(F.col("_first") - F.col("_prev_last") > ttl_seconds, F.lit(True)))
        .withColumn(
            "_end_start_pos",
            F.greatest(F.when(F.col("_head"), F.col("_base") + 1), F.col("_base") + F.col("_b_start_rn")),
        )
        .withColumn("_end_start_ts", F.coalesce("_b_start_ts", F.when(F.col("_head"), F.col("_first"))))
        .withColumns(
            {
                "_in_start_pos": F.when(F.col("_head"), F.col("_base") + 1).otherwise(
                    F.max("_end_start_pos").over(before)
                ),
                "_in_start_ts": F.when(F.col("_head"), F.col("_first")).otherwise(F.max("_end_start_ts").over(before)),
                "_in_hit_pos": F.max(F.col("_base") + F.col("_b_hit_rn")).over(before),
                "_in_sessions": F.coalesce(F.sum(F.col("_breaks") + F.col("_head").cast("bigint")).over(before), F.lit(0))
                + F.col("_head").cast("bigint"),
            }
        )
        .select(
            *part,
            "_base",
            "_prev_last",
            "_head",
            "_in_start_pos",
            "_in_start_ts",
            "_in_hit_pos",
            "_in_sessions",
            *(["_prev_struct"] if previous else []),
        )
    )
    pos = F.col("_base") + F.col("_rn")
    first_in_bucket = F.col("_rn") == 1
    start_pos = F.coalesce(F.col("_base") + F.col("_start_rn"), F.col("_in_start_pos"))
    hit_pos = F.greatest(F.col("_base") + F.col("_hit_rn"), F.col("_in_hit_pos"))
    # null-safe: events without key or time form a timeline of their own instead of going missing
    carried = carried.withColumnsRenamed({c: f"_c{c}" for c in part})
    same = local[key].eqNullSafe(carried[f"_c{key}"]) & local["_b"].eqNullSafe(carried["_c_b"]) & (local["_p"] == carried["_c_p"])
    return local.join(carried, same).select(
        *events.columns,
        pos.alias("pos"),
        (F.col("_in_sessions") + F.col("_nbrk")).alias("session_no"),
        F.coalesce("_start_ts", "_in_start_ts").alias("session_start"),
        start_pos.alias("start_pos"),
        (pos - start_pos + 1).alias("n_so_far"),
        F.coalesce(hit_pos >= start_pos, F.lit(False)).alias("flag_so_far"),
        F.coalesce("_lag_ts", "_prev_last").alias("prev_ts"),
        (F.col("_brk") | (first_in_bucket & F.col("_head"))).alias("is_start"),
        *[
            F.when(first_in_bucket, F.col(f"_prev_struct.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}")
            for c in previous
        ],
    )


def latest_before(
    left: DataFrame,
    rights: dict[str, DataFrame],
    *,
    key: str,
    left_ts: str,
    right_ts: str,
    right_order: str,
    bucket_seconds: int = BUCKET_SECONDS,
    heavy_rows: int | None = None,
) -> DataFrame:
    """As-of join: for every left row the last row of each right table of the key at or before its time.

    Left rows keep their columns and get one struct column per right table (NULL when there is
    none). All sides share one timeline and one pass, so there is no range join and no pair is
    ever built. All tables are read more than once: give them as stage tables.
    """

    def bucketed(df: DataFrame, ts: str) -> DataFrame:
        return df.withColumn("_t", F.col(ts)).withColumn("_b", F.floor(F.col(ts) / bucket_seconds))

    seen = None
    for name, right in rights.items():
        rows = bucketed(right, right_ts).select(
            key, "_b", "_t", F.col(right_order).alias("_o"), F.struct(*[c for c in right.columns if c != key]).alias(name)
        )
        seen = rows if seen is None else seen.unionByName(rows, allowMissingColumns=True)
    asked = bucketed(left, left_ts).select(key, "_b", "_t", F.struct(*left.columns).alias("_left"))
    both = seen.unionByName(asked, allowMissingColumns=True).withColumn("_kind", F.col("_left").isNotNull())
    both = spread(both, key, ["_t", "_kind", "_o"], heavy_rows)
    part = [key, "_b", "_p"]

    # The last right row of each busy piece, carried to the later pieces of the key.
    at = F.struct("_t", "_o")
    ends = both.filter(~F.col("_kind")).groupBy(*part).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in rights])
    buckets = ends.unionByName(both.filter("_kind").select(*part).distinct(), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("_b", "_p", "_q").rowsBetween(Window.unboundedPreceding, -1)
    # A piece with both kinds of rows has two entries; the question (_q = 0) comes first.
    is_question = F.lit(True)
    for n in rights:
        is_question = is_question & F.col(n).isNull()
    carried = (
        buckets.withColumn("_q", F.when(is_question, 0).otherwise(1))
        .select(*part, "_q", *[F.last(n, ignorenulls=True).over(before).alias(f"_c_{n}") for n in rights])
        .filter(F.col("_q") == 0)
        .drop("_q")
    )

    upto = Window.partitionBy(*part).orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.select(
        *part, "_left", *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in rights]
    ).filter(F.col("_left").isNotNull())
    return placed.join(carried, part, "left").select(
        *[F.col(f"_left.{c}").alias(c) for c in left.columns], *[F.coalesce(n, f"_c_{n}").alias(n) for n in rights]
    )
