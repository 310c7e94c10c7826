"""Positions and running totals over a total order of all rows.

A window without PARTITION BY runs in one task. Here the rows are range-sorted into many
partitions, fixed on shared storage, numbered inside each partition, and shifted by the totals of
the partitions before. Only one row per partition meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import cut

# Layout of monotonically_increasing_id: partition number above, row number in the low 33 bits.
_ROW_BITS = 33


def _tagged(df: DataFrame, order: list[Column]) -> DataFrame:
    tagged = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    return tagged.select(
        *df.columns,
        F.shiftright("_mid", _ROW_BITS).alias("_pid"),
        F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_seq"),
    )


def global_index(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 1-based position of every row in the given total order."""
    tagged = _tagged(df, list(order))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = (
        tagged.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return tagged.join(starts, "_pid").select(*df.columns, (F.col("_start") + F.col("_seq") + 1).alias(name))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Add, per entry, the sum over all rows up to and including this one in the total order."""
    valued = df.select("*", *[c.alias(f"_v_{n}") for n, c in totals.items()])
    tagged = _tagged(valued, order)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = (
        tagged.groupBy("_pid")
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
        .select("_pid", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in totals])
    )
    inside = Window.partitionBy("_pid").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select(*df.columns, "_pid", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in totals])
    return local.join(starts, "_pid").select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_s_{n}")).alias(n) for n in totals]
    )


def rows_at(df: DataFrame, order: Column, weight: Column, positions: dict[str, Column]) -> DataFrame:
    """Exact order statistics: for each name, the value whose weighted position range holds it.

    `positions` are 1-based positions as expressions over the column `total` (all weights).
    Returns one row (name, value) per entry.
    """
    ranked = running_totals(df.select(order.alias("value"), weight.alias("w")), [F.col("value")], {"upto": F.col("w")})
    total = ranked.agg(F.max("upto").alias("total"))
    wanted = total.select(F.explode(F.create_map(*[x for n, p in positions.items() for x in (F.lit(n), p.cast("bigint"))])).alias("name", "pos"))
    # One row per wanted position: its size is the number of entries, whatever the data.
    return ranked.join(
        F.broadcast(wanted), (F.col("pos") > F.col("upto") - F.col("w")) & (F.col("pos") <= F.col("upto"))
    ).select("name", "value")
