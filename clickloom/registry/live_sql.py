"""DuckDB SQL for the request metrics and the streams."""

from clickloom.registry import batch_sql, model_sql
from clickloom.registry.batch_sql import DAY, EV, runs

SQL = {}

LOG = """
log AS (SELECT CAST(event_id AS VARCHAR) AS request_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cold_start' ELSE 'success' END AS status,
  ['mobile', 'desktop', 'tablet'][event_id % 3 + 1] AS device, value * 0.75::DOUBLE / 1000 AS retrieval, value * 0.25::DOUBLE / 1000 AS ranking,
  value / 1000 AS total, value AS total_ms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n_candidates, (event_id % 10) / 10.0::DOUBLE AS diversity, epoch_us(ts) AS us FROM events)"""

STAGED = """
staged AS (SELECT 'retrieval' AS stage, retrieval AS s, us FROM log UNION ALL SELECT 'ranking', ranking, us FROM log UNION ALL SELECT 'total', total, us FROM log)"""

LE = """
le AS (SELECT * FROM (VALUES (0.005::DOUBLE, '0.005'), (0.01, '0.01'), (0.025, '0.025'), (0.05, '0.05'), (0.1, '0.1'), (0.25, '0.25'), (0.5, '0.5'), (1.0, '1.0'), ('Infinity'::DOUBLE, '+Inf')) AS t(b, le))"""

CLE = """
cle AS (SELECT * FROM (VALUES (10.0::DOUBLE, '10.0'), (25.0, '25.0'), (50.0, '50.0'), (75.0, '75.0'), (100.0, '100.0'), (150.0, '150.0'), (200.0, '200.0'), ('Infinity'::DOUBLE, '+Inf')) AS t(b, le))"""


def sliding(width_s, slide_s, src="log", cols="status, device"):
    """Every sliding window a row falls in: ends are multiples of the slide in (t, t + width]."""
    w, s = width_s * 1000000, slide_s * 1000000
    return f"""
slid AS (SELECT {cols}, (us // {s}) * {s} - k * {s} + {w} AS window_end_us FROM {src} CROSS JOIN range({width_s // slide_s}) AS g(k))"""


SQL["request_counts"] = f"WITH {LOG} SELECT status, device, count(*) AS n FROM log GROUP BY 1, 2"

SQL["request_summary"] = f"""WITH {LOG} SELECT count(*) AS total, count(*) FILTER (status <> 'error') AS success, count(*) FILTER (status = 'error') AS error,
 count(*) FILTER (status = 'cold_start') AS cold_start, round(100.0::DOUBLE * count(*) FILTER (status = 'cold_start') / count(*), 6) AS cold_start_percent FROM log"""

SQL["request_rate"] = f"WITH {LOG}, {sliding(60, 15)} SELECT window_end_us, status, device, count(*) AS n FROM slid GROUP BY 1, 2, 3"

_LAT = f"""{LOG}, {STAGED}, {LE},
lat AS (SELECT stage, le, (SELECT count(*) FROM staged x WHERE x.stage = t.stage AND x.s <= le.b) AS n, t.sum, t."count"
  FROM (SELECT stage, sum(s) AS sum, count(*) AS "count" FROM staged GROUP BY 1) t CROSS JOIN le)"""
_CAND = f"""{CLE}, cand AS (SELECT le, (SELECT count(*) FROM log WHERE n_candidates <= cle.b) AS n,
 (SELECT sum(n_candidates) FROM log) AS sum, (SELECT count(*) FROM log) AS "count" FROM cle)"""

SQL["latency_histogram"] = f"""WITH {_LAT} SELECT stage, le, n, round(sum, 4) AS sum, "count" FROM lat"""
SQL["candidate_histogram"] = f"""WITH {LOG}, {_CAND} SELECT le, n, sum, "count" FROM cand"""


def _quantile(q):
    return f"""max(CASE WHEN cum >= total * {q}::DOUBLE AND coalesce(prev, -1) < total * {q}::DOUBLE THEN
      CASE WHEN isinf(b) THEN 1.0::DOUBLE ELSE lo + (b - lo) * (total * {q}::DOUBLE - coalesce(prev, 0)) / (cum - coalesce(prev, 0)) END END)"""


SQL["latency_quantiles"] = f"""WITH {LOG}, {STAGED}, {LE},
slid AS (SELECT stage, s, (us // 21600000000) * 21600000000 - k * 21600000000 + 86400000000 AS window_end_us FROM staged CROSS JOIN range(4) AS g(k)),
c AS (SELECT window_end_us, stage, b, count(*) FILTER (s <= b) AS cum, count(*) AS total FROM slid CROSS JOIN le GROUP BY 1, 2, 3),
o AS (SELECT *, lag(cum) OVER w AS prev, coalesce(lag(b) OVER w, 0) AS lo FROM c WINDOW w AS (PARTITION BY window_end_us, stage ORDER BY b))
SELECT window_end_us, stage, round({_quantile(0.5)}, 6) AS p50, round({_quantile(0.95)}, 6) AS p95, round({_quantile(0.99)}, 6) AS p99
FROM o GROUP BY 1, 2"""

SQL["latency_exact"] = f"""WITH {LOG}, s AS (SELECT total_ms, row_number() OVER (ORDER BY total_ms) AS i, count(*) OVER () AS n FROM log)
SELECT round((SELECT median(total_ms) FROM log), 6) AS p50_ms, round((SELECT total_ms FROM s WHERE i = floor(0.99 * n) + 1), 6) AS p99_ms"""


def _ratio(status, yellow, red):
    return f"""WITH {LOG}, {sliding(86400, 21600)},
r AS (SELECT window_end_us, count(*) FILTER (status = '{status}') / count(*) AS ratio FROM slid GROUP BY 1)
SELECT window_end_us, round(ratio, 6) AS ratio, CASE WHEN ratio >= {red} THEN 'red' WHEN ratio >= {yellow} THEN 'yellow' ELSE 'green' END AS level FROM r"""


SQL["cold_start_rate"] = _ratio("cold_start", 0.3, 0.6)
SQL["error_rate"] = _ratio("error", 0.01, 0.05)

SQL["metrics_snapshot"] = f"""WITH {_LAT}, {_CAND}
SELECT 'recommendation_requests_total' AS metric, 'device=' || device || ',status=' || status AS labels, CAST(count(*) AS DOUBLE) AS value FROM log GROUP BY status, device
UNION ALL SELECT 'recommendation_latency_seconds_bucket', 'le=' || le || ',stage=' || stage, CAST(n AS DOUBLE) FROM lat
UNION ALL SELECT 'recommendation_latency_seconds_sum', 'stage=' || stage, round(sum, 4) FROM lat WHERE le = '+Inf'
UNION ALL SELECT 'recommendation_latency_seconds_count', 'stage=' || stage, CAST("count" AS DOUBLE) FROM lat WHERE le = '+Inf'
UNION ALL SELECT 'retrieved_candidates_total_bucket', 'le=' || le, CAST(n AS DOUBLE) FROM cand
UNION ALL SELECT 'retrieved_candidates_total_sum', '', sum FROM cand WHERE le = '+Inf'
UNION ALL SELECT 'retrieved_candidates_total_count', '', CAST("count" AS DOUBLE) FROM cand WHERE le = '+Inf'
UNION ALL SELECT 'recommendation_diversity_score', '', (SELECT diversity FROM log ORDER BY ts DESC, request_id DESC LIMIT 1)
UNION ALL SELECT 'recsys_model_info', 'cf_model_version=1,ranker_model_version=1', 1.0::DOUBLE"""

SQL["stream_event_parse"] = batch_sql.SQL["event_parse"]
SQL["stream_dedupe"] = f"""WITH {EV} SELECT event_id, user_id, item_id, event_type, "timestamp" FROM ev"""
SQL["stream_batch_stats"] = f"""WITH {EV}
SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM ev
GROUP BY least(2, greatest(0, floor(("timestamp" - 1704067200.0) / 864000)))"""

SQL["stream_session_state"] = f"""WITH {EV}, {runs(DAY)}, {runs(DAY, "vrun", where="item_id IS NOT NULL AND item_id <> ''")},
last_s AS (SELECT user_id, min("timestamp") AS session_start, max("timestamp") AS last_seen, count(*) AS session_length, bool_or(event_type = 'click') AS has_cart_item
  FROM run GROUP BY user_id, session_no QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session_no DESC) = 1),
lc AS (SELECT *, max(session_no) OVER (PARTITION BY user_id) AS m FROM vrun),
vw AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS k FROM lc WHERE session_no = m QUALIFY k <= 20),
vl AS (SELECT user_id, string_agg(item_id, ',' ORDER BY k) AS recent_views FROM vw GROUP BY 1)
SELECT s.*, coalesce(recent_views, '') AS recent_views FROM last_s s LEFT JOIN vl ON vl.user_id = s.user_id"""

SQL["stream_state_snapshot"] = SQL["stream_session_state"]

SQL["stream_session_window"] = f"""WITH {EV}, {runs(DAY)}
SELECT user_id, min("timestamp") AS session_start, max("timestamp") AS last_seen, count(*) AS session_length, bool_or(event_type = 'click') AS has_cart_item
FROM run GROUP BY user_id, session_no HAVING max("timestamp") + {DAY} <= (SELECT max("timestamp") FROM ev) - 1800"""

SQL["stream_request_rate"] = f"""WITH {LOG}, {sliding(3600, 900)}
SELECT window_end_us, status, device, count(*) AS n FROM slid WHERE window_end_us <= (SELECT max(us) FROM log) - 60000000 GROUP BY 1, 2, 3"""

# once all windows are closed a stream has the rows of its batch twin
SQL["stream_latency_quantiles"] = SQL["latency_quantiles"]
SQL["stream_error_rate"] = SQL["error_rate"]
SQL["stream_cold_start_rate"] = SQL["cold_start_rate"]

SQL["stream_observed_stats"] = f"""WITH {EV}
SELECT CAST(least(2, greatest(0, floor(("timestamp" - 1704067200.0) / 864000))) AS BIGINT) AS batch, count(*) AS published, count(*) AS events,
 min("timestamp") AS first_seen, max("timestamp") AS last_seen, true AS publish_rate_known, true AS rate_known
FROM ev GROUP BY 1"""

SQL["stream_recommend"] = model_sql.SQL["recommend_response"]

SQL["stream_feedback_state"] = f"""WITH {batch_sql.EV.replace("ev AS (", "clicks AS (", 1)},
ev AS (SELECT * FROM clicks UNION ALL
  SELECT 'fb-' || CAST(CAST(floor("timestamp") AS BIGINT) AS VARCHAR), user_id, item_id, event_type, session_id, "timestamp", device, page, referrer
  FROM clicks WHERE event_type = 'purchase'),
{model_sql.REQ}, {batch_sql.asof("req")}
SELECT st.request_id, st.user_id, n_recommendations, session_length, round(session_age_seconds, 6) AS session_age_seconds,
 round(last_seen_timestamp, 6) AS last_seen_timestamp, has_cart_item, array_to_string(views, ',') AS recent_views
FROM st JOIN req ON req.request_id = st.request_id"""
