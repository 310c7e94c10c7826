import pytest
from compare import compare, duck

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "kcore_two_pass", "items_build", "session_asof", "recent_views", "session_flow", "retrieve_knn", "recommend_batch",
    "training_features", "tfidf", "search_fuzzy", "auc", "latency_quantiles", "metrics_snapshot", "stream_session_state",
    "stream_latency_quantiles", "stream_error_rate", "stream_observed_stats", "als_unseen_check", "als_recommend_recall",
    "stream_state_snapshot", "recommend_trained", "scan_reviews_json", "scan_item_meta_json",
]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
