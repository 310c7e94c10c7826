"""Missing keys, early times, list lengths and number texts."""

from pyspark.sql import functions as F

from clickloom.functions import scalars as S
from clickloom.operators import messages as M
from clickloom.operators import telemetry as TM
from clickloom.operators import timeline as TL


def test_only_decimal_text_is_a_number(spark):
    rows = [("12d",), ("3F",), ("0x1p3",), ("$5d",), ("$1,234.50",), (" 7 ",), (".5",), ("1e3",), ("NaN",), (None,), ("",)]
    df = spark.createDataFrame(rows, "raw string")
    got = [r.p for r in df.select(S.parse_price("raw").alias("p")).collect()]
    assert got == [None, None, None, None, 1234.5, 7.0, 0.5, 1000.0, None, None, None]


def test_events_without_user_or_time_stay(spark):
    rows = [("a", "u", 10.0), ("b", None, 10.0), ("c", "u", None), ("d", "u", 20.0), ("e", None, 12.0)]
    df = spark.createDataFrame(rows, "event_id string, user_id string, timestamp double")
    got = {r.event_id: r for r in TL.session_runs(df, 100.0).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert got["d"].session_no == got["a"].session_no and got["e"].n_so_far == 2


def test_list_length_default_and_bounds(spark):
    df = spark.createDataFrame([("a", None), ("b", 0), ("c", 50), ("d", 51)], "request_id string, n_recommendations int")
    assert {(r.request_id, r.n_recommendations) for r in M.accepted(df).collect()} == {("a", 10), ("c", 50)}
    assert {r.request_id for r in df.filter(M.rejected("n_recommendations")).collect()} == {"b", "d"}


def test_panes_equal_sliding_windows(spark):
    df = spark.range(500).select(
        F.timestamp_seconds(F.col("id") * 7 + 1.5e9).alias("ts"), F.element_at(F.array(F.lit("ok"), F.lit("error")), (F.col("id") % 2 + 1).cast("int")).alias("status"),
        F.lit("mobile").alias("device"),
    )
    want = df.groupBy(F.window("ts", "1 minute", "15 seconds").alias("w"), "status", "device").count()
    want = {(r.w.end.timestamp(), r.status): r["count"] for r in want.collect()}
    got = {(r.window_end_us / 1e6, r.status): r.n for r in TM.request_rate(df).collect()}
    assert got == want
