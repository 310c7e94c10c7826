"""Metrics of served requests: counters, histograms, quantiles, rates and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.ordering import rows_at

# Upper bounds of the latency (seconds) and candidate histograms; +Inf comes on top.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0]
CANDIDATE_BOUNDS = [10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0]
STAGES = ["retrieval", "ranking", "total"]
# Where a ratio turns from green to yellow and from yellow to red.
COLD_START_LEVELS = (0.3, 0.6)
ERROR_LEVELS = (0.01, 0.05)


def _seconds(stage: str) -> Column:
    return F.col(f"{stage}_ms") / 1000


def _cumulative(value: Column, bounds: list[float]) -> Column:
    """Counts at or below each bound and overall, as one array; a single partial aggregation."""
    return F.array(*[F.count_if(value <= b) for b in bounds], F.count(value))


def _label(bound: float | None) -> str:
    return "+Inf" if bound is None else repr(float(bound))


def _as_rows(counts: DataFrame, bounds: list[float], *keep: str) -> DataFrame:
    names = F.array(*[F.lit(_label(b)) for b in [*bounds, None]])
    rows = counts.select(*keep, F.explode(F.arrays_zip(names.alias("le"), F.col("counts").alias("n"))).alias("e"), "sum", "count")
    return rows.select(*keep, F.col("e.le").alias("le"), F.col("e.n").alias("n"), "sum", "count")


def _by_stage(log: DataFrame, *keys: Column) -> DataFrame:
    """Histogram per stage (and key): aggregated side by side first, then turned into rows."""
    wide = log.groupBy(*keys).agg(
        *[
            F.struct(
                F.lit(s).alias("stage"),
                _cumulative(_seconds(s), LATENCY_BOUNDS).alias("counts"),
                F.sum(_seconds(s)).alias("sum"),
                F.count(_seconds(s)).alias("count"),
            ).alias(s)
            for s in STAGES
        ]
    )
    others = [c for c in wide.columns if c not in STAGES]
    return wide.select(*others, F.explode(F.array(*STAGES)).alias("h")).select(*others, "h.*")


def latency_histogram(log: DataFrame) -> DataFrame:
    return _as_rows(_by_stage(log), LATENCY_BOUNDS, "stage")


def candidate_histogram(log: DataFrame) -> DataFrame:
    v = F.col("n_candidates").cast("double")
    counts = log.agg(_cumulative(v, CANDIDATE_BOUNDS).alias("counts"), F.sum(v).alias("sum"), F.count(v).alias("count"))
    return _as_rows(counts, CANDIDATE_BOUNDS)


def quantile_of(counts: Column, bounds: list[float], q: float) -> Column:
    """Quantile from cumulative counts, linear inside the bucket; the open bucket gives the last bound."""
    rank = F.element_at(counts, -1) * q
    at = F.array_position(F.transform(counts, lambda n: n >= rank), True).cast("int")
    edges = F.array(*[F.lit(float(b)) for b in [0.0, *bounds]])
    below = F.concat(F.array(F.lit(0).cast("bigint")), counts)
    lo, hi = F.try_element_at(edges, at), F.try_element_at(edges, at + 1)
    before, upto = F.try_element_at(below, at), F.try_element_at(below, at + 1)
    inside = lo + (hi - lo) * ((rank - before) / F.nullif((upto - before).cast("double"), F.lit(0.0)))
    return F.when(at > len(bounds), F.lit(float(bounds[-1]))).otherwise(inside)


def _latency_panes(log: DataFrame, slide: str) -> DataFrame:
    """Cumulative counts of every stage per step of the sliding windows, one column each."""
    counts = []
    for s in STAGES:
        counts += [F.count_if(_seconds(s) <= b).alias(f"{s}_{i}") for i, b in enumerate(LATENCY_BOUNDS)]
        counts.append(F.count(_seconds(s)).alias(f"{s}_{len(LATENCY_BOUNDS)}"))
    return log.groupBy(F.window("ts", slide).alias("pane")).agg(*counts)


def latency_quantiles(log: DataFrame, window: str = "2 minutes", slide: str = "15 seconds") -> DataFrame:
    """p50, p95 and p99 per stage in sliding windows.

    A row is counted once, in its pane; windows add up panes. Over a stream with a watermark on `ts` these are two
    chained aggregations in append mode.
    """
    sums = [F.array(*[F.sum(f"{s}_{i}") for i in range(len(LATENCY_BOUNDS) + 1)]).alias(s) for s in STAGES]
    wide = _latency_panes(log, slide).groupBy(F.window("pane", window, slide).alias("w")).agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("counts")) for s in STAGES]))
    return wide.select("w", each.alias("h")).select(
        F.unix_micros("w.end").alias("window_end_us"),
        "h.stage",
        *[quantile_of(F.col("h.counts"), LATENCY_BOUNDS, q).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
    )


def request_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status", "device").agg(F.count(F.lit(1)).alias("n"))


def _panes(log: DataFrame, slide: str, *by: str) -> DataFrame:
    """Counts per step of the sliding windows: a row is counted once and only the counts are repeated."""
    return log.groupBy(F.window("ts", slide).alias("pane"), *by).agg(F.count(F.lit(1)).alias("n"))


def request_rate(log: DataFrame, window: str = "1 minute", slide: str = "15 seconds") -> DataFrame:
    """Requests per minute by series in sliding windows (plain counts, no extrapolation)."""
    return (
        _panes(log, slide, "status", "device")
        .groupBy(F.window("pane", window, slide).alias("w"), "status", "device")
        .agg(F.sum("n").alias("n"))
        .select(F.unix_micros("w.end").alias("window_end_us"), "status", "device", "n")
    )


def status_ratio(log: DataFrame, status: str, levels: tuple[float, float], window: str = "5 minutes", slide: str = "15 seconds") -> DataFrame:
    """Share of one status per sliding window, and its level."""
    ratio = F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)) / F.sum("n")
    out = _panes(log, slide, "status").groupBy(F.window("pane", window, slide).alias("w")).agg(ratio.alias("ratio"))
    level = F.when(F.col("ratio") >= levels[1], "red").when(F.col("ratio") >= levels[0], "yellow").otherwise("green")
    return out.select(F.unix_micros("w.end").alias("window_end_us"), "ratio", level.alias("level"))


def latency_exact(log: DataFrame, value: str = "total_ms") -> DataFrame:
    """Exact median and p99 (the value at sorted position floor(0.99 n)) from a distributed sort."""
    by_value = log.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("w"))
    n = F.col("total")
    at = rows_at(
        by_value, F.col("value"), F.col("w"),
        {"lo": F.floor((n + 1) / 2), "hi": F.floor(n / 2) + 1, "p99": F.least(F.floor(n * 0.99) + 1, n)},
    )
    pick = lambda k: F.max(F.when(F.col("name") == k, F.col("value")))
    return at.agg(((pick("lo") + pick("hi")) / 2).alias("p50_ms"), pick("p99").alias("p99_ms"))


def request_summary(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != "error").alias("success"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.count_if(F.col("status") == "cold_start").alias("cold_start"),
        (100.0 * F.count_if(F.col("status") == "cold_start") / F.count(F.lit(1))).alias("cold_start_percent"),
    )


def snapshot(log: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Everything a scrape would expose, as (metric, labels, value)."""

    def labels(**pairs) -> Column:
        flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
        return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")

    def rows(df: DataFrame, metric: str, tags: Column, value: Column | str) -> DataFrame:
        value = F.col(value) if isinstance(value, str) else value
        return df.select(F.lit(metric).alias("metric"), tags.alias("labels"), value.cast("double").alias("value"))

    lat = latency_histogram(log)
    cand = candidate_histogram(log)
    top = F.col("le") == "+Inf"
    out = rows(request_counts(log), "recommendation_requests_total", labels(status=F.col("status"), device=F.col("device")), "n")
    last = log.agg(F.max_by("diversity", F.struct("ts", "request_id")).alias("v"))
    for more in (
        rows(lat, "recommendation_latency_seconds_bucket", labels(stage=F.col("stage"), le=F.col("le")), "n"),
        rows(lat.filter(top), "recommendation_latency_seconds_sum", labels(stage=F.col("stage")), "sum"),
        rows(lat.filter(top), "recommendation_latency_seconds_count", labels(stage=F.col("stage")), "count"),
        rows(cand, "retrieved_candidates_total_bucket", labels(le=F.col("le")), "n"),
        rows(cand.filter(top), "retrieved_candidates_total_sum", labels(), "sum"),
        rows(cand.filter(top), "retrieved_candidates_total_count", labels(), "count"),
        rows(last, "recommendation_diversity_score", labels(), "v"),
        rows(last, "recsys_model_info", labels(**{k: F.lit(v) for k, v in versions.items()}), F.lit(1.0)),
    ):
        out = out.unionByName(more)
    return out
