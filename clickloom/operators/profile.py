"""Exploratory statistics of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.ordering import global_index

# Weekdays in report order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _per(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _histogram_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """(count value, keys with it). Has at most sqrt(2 * rows) rows, as the counts add up to the rows."""
    return _per(rows, key).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def sparsity(rows: DataFrame) -> DataFrame:
    """Exact distinct counts from two partial aggregations (no expand of the rows)."""
    users = rows.select("user_id").distinct().agg(F.count(F.lit(1)).alias("users")).scalar()
    items = _per(rows, "item_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("rows"))
    return items.select(
        users.alias("n_users"), F.col("items").alias("n_items"), F.col("rows").alias("n_interactions")
    ).withColumn("sparsity", 1 - F.col("n_interactions") / (F.col("n_users").cast("double") * F.col("n_items")))


def rating_histogram(rows: DataFrame) -> DataFrame:
    return _per(rows, "rating")


def user_activity(rows: DataFrame) -> DataFrame:
    hist = _histogram_of_counts(rows, "user_id")
    return hist.agg(
        F.percentile("n", F.lit(0.5), F.col("keys")).alias("median_rows"),
        (F.sum(F.col("n") * F.col("keys")) / F.sum("keys")).alias("mean_rows"),
        F.max("n").alias("max_rows"),
        F.sum(F.when(F.col("n") >= 50, F.col("keys")).otherwise(0)).alias("users_50"),
        F.sum(F.when(F.col("n") >= 100, F.col("keys")).otherwise(0)).alias("users_100"),
    )


def activity_bins(rows: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of the rows per user; the top edge belongs to the last bin."""
    hist = _histogram_of_counts(rows, "user_id")
    edge = hist.agg(F.struct(F.min("n").cast("double").alias("lo"), F.max("n").cast("double").alias("hi")).alias("e"))
    e = hist.withColumn("e", edge.scalar())
    flat = F.col("e.lo") == F.col("e.hi")
    lo = F.when(flat, F.col("e.lo") - 0.5).otherwise(F.col("e.lo"))
    hi = F.when(flat, F.col("e.hi") + 0.5).otherwise(F.col("e.hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor((F.col("n") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        e.select("n", "keys", lo.alias("lo"), hi.alias("hi"))
        .withColumn("bin", slot)
        .groupBy("bin")
        .agg(F.sum("keys").alias("users"))
    )
    domain = edge.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "e")
    return domain.join(counted, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * ((hi - lo) / bins)).alias("lower"),
        F.coalesce("users", F.lit(0)).cast("bigint").alias("users"),
    )


def top_share(rows: DataFrame, share: float = 0.1) -> DataFrame:
    """Part of all rows that belongs to the most popular `share` of the items.

    Equal counts are interchangeable, so the ranking runs on the histogram of counts, which is
    small by construction, and the boundary group is cut exactly.
    """
    hist = _histogram_of_counts(rows, "item_id")
    desc = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = hist.withColumn("above", F.coalesce(F.sum("keys").over(desc), F.lit(0)))
    keep = hist.agg(F.floor(F.sum("keys") * share).alias("k")).scalar()
    taken = F.greatest(F.lit(0), F.least(F.col("keys"), keep - F.col("above")))
    return ranked.agg(
        F.sum("keys").alias("n_items"),
        F.sum(taken).cast("bigint").alias("top_items"),
        (F.sum(taken * F.col("n")) / F.sum(F.col("keys") * F.col("n"))).alias("top_share"),
    )


def item_popularity(rows: DataFrame) -> DataFrame:
    """Items with their count and popularity rank (1 = most popular)."""
    return global_index(_per(rows, "item_id"), F.desc("n"), F.col("item_id"), name="rank")


def monthly(rows: DataFrame, date: str = "date") -> DataFrame:
    """Rows per calendar month, empty months included, labelled by the last day."""
    month = F.trunc(F.col(date).cast("date"), "month")
    counts = rows.groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    domain = span.filter(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")
    )
    return domain.join(counts, "m", "left").select(
        F.date_format(F.last_day("m"), "yyyy-MM-dd").alias("month_end"), F.coalesce("n", F.lit(0)).alias("n")
    )


def weekdays(rows: DataFrame, date: str = "date") -> DataFrame:
    """Rows per weekday in fixed order; a weekday without rows stays NULL."""
    counts = rows.groupBy(F.date_format(date, "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    domain = rows.sparkSession.range(1).select(F.posexplode(names).alias("i", "weekday"))
    return domain.join(counts, "weekday", "left").select(F.col("i").cast("int").alias("day_order"), "weekday", "n")
