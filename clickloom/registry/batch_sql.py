"""DuckDB SQL for the batch queries, written from the semantics and not from the Spark plans."""

SQL = {}

INTER = """
inter AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
         CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         CAST(epoch(o_orderdate) AS DOUBLE) AS "timestamp", o_orderstatus = 'F' AS verified_purchase
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

RAW_REVIEWS = """
raw_reviews AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS asin,
         CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         CASE WHEN l_linenumber = 7 AND o_orderstatus = 'P' THEN 'abc'
              ELSE CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) END AS ts,
         o_orderstatus = 'F' AS verified_purchase
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""

META_BASE = """
priced AS (
  SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
meta1 AS (
  SELECT CASE WHEN p_size % 9 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS parent_asin,
         CAST(p_partkey AS VARCHAR) AS asin,
         CASE WHEN p_size % 13 = 0 THEN NULL ELSE p_name END AS title,
         CASE WHEN p_size % 10 = 1 THEN NULL WHEN p_size % 10 = 2 THEN [] ELSE [p_type, p_brand] END AS categories,
         CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'n/a'
              WHEN p_size % 5 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
              WHEN cents >= 100000 THEN ' $' || CAST(cents // 100000 AS VARCHAR) || ','
                   || lpad(CAST((cents // 100) % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
              ELSE '$' || CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' ' END AS price,
         CASE WHEN p_size % 8 = 0 THEN NULL ELSE p_size / 10.0 END AS average_rating,
         CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_partkey % 97 END AS rating_number,
         CASE WHEN p_size % 12 = 5 THEN NULL
              ELSE [p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END, repeat(p_type || ' ', p_size % 40)] END AS description,
         p_partkey AS row_order, p_size
  FROM priced),
meta AS (
  SELECT parent_asin, asin, title, categories, price, average_rating, rating_number, description, row_order FROM meta1
  UNION ALL
  SELECT parent_asin, asin, upper(title), categories, price, average_rating, rating_number, description,
         row_order + 10000000000 FROM meta1 WHERE p_size < 5)
"""

ITEMS_CLEAN = """
shaped AS (
  SELECT coalesce(nullif(parent_asin, ''), asin) AS item_id, coalesce(title, '') AS title,
         coalesce(categories[1], 'Unknown') AS category,
         TRY_CAST(trim(replace(replace(price, '$', ''), ',', '')) AS DOUBLE) AS price,
         CAST(coalesce(average_rating, 0) AS DOUBLE) AS avg_rating,
         CAST(coalesce(rating_number, 0) AS BIGINT) AS review_count,
         coalesce(substr(array_to_string(list_filter(description, lambda x: x IS NOT NULL), ' '), 1, 200), '') AS description_snippet,
         row_order
  FROM meta),
clean_items AS (
  SELECT item_id, title, category, price, avg_rating, review_count, description_snippet
  FROM shaped WHERE item_id IN (SELECT item_id FROM inter)
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY row_order) = 1)
"""


def core(min_user, min_item, src="inter"):
    return f"""
u1 AS (SELECT * FROM {src} WHERE user_id IN (SELECT user_id FROM {src} GROUP BY 1 HAVING count(*) >= {min_user})),
i1 AS (SELECT * FROM u1 WHERE item_id IN (SELECT item_id FROM u1 GROUP BY 1 HAVING count(*) >= {min_item})),
u2 AS (SELECT * FROM i1 WHERE user_id IN (SELECT user_id FROM i1 GROUP BY 1 HAVING count(*) >= {min_user})),
core AS (SELECT * FROM u2 WHERE item_id IN (SELECT item_id FROM u2 GROUP BY 1 HAVING count(*) >= {min_item}))
"""


PAGE = """CASE event_type WHEN 'view' THEN 'product' WHEN 'add_to_cart' THEN 'cart' WHEN 'purchase' THEN 'cart'
 WHEN 'search' THEN 'search' ELSE 'home' END"""

EV = f"""
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS item_id, event_type,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
         epoch_us(ts) / 1e6 AS "timestamp",
         CASE WHEN event_id % 17 <> 0 THEN ['mobile', 'desktop', 'tablet'][event_id % 3 + 1] END AS device,
         CASE WHEN event_id % 17 <> 0 THEN {PAGE} END AS page,
         CASE WHEN event_id % 17 <> 0 THEN ['search', 'newsletter', 'partner', 'app', 'bookmark'][event_id % 5 + 1] END AS referrer
  FROM events)
"""


def runs(ttl, name="run", src="ev", where="true"):
    """Sessions by inactivity, as window functions over the whole user."""
    return f"""
{name}_gap AS (
  SELECT *, lag("timestamp") OVER w AS prev_ts, lag(event_type) OVER w AS prev_type, row_number() OVER w AS pos
  FROM {src} WHERE {where} WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp", event_id)),
{name}_no AS (
  SELECT *, prev_ts IS NULL OR "timestamp" - prev_ts > {ttl} AS is_start,
         CAST(sum(CASE WHEN prev_ts IS NULL OR "timestamp" - prev_ts > {ttl} THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS BIGINT) AS session_no
  FROM {name}_gap),
{name} AS (
  SELECT *, min("timestamp") OVER (PARTITION BY user_id, session_no) AS session_start,
         row_number() OVER s AS n_so_far,
         coalesce(bool_or(event_type = 'click') OVER s, false) AS cart_so_far
  FROM {name}_no WINDOW s AS (PARTITION BY user_id, session_no ORDER BY "timestamp", event_id))
"""


DAY = 86400

SQL["scan_interactions"] = f"""WITH {RAW_REVIEWS}
SELECT user_id, asin AS item_id, rating, TRY_CAST(ts AS DOUBLE) AS "timestamp", verified_purchase
FROM raw_reviews WHERE TRY_CAST(ts AS DOUBLE) IS NOT NULL"""

SQL["scan_reviews_json"] = SQL["scan_interactions"]

SQL["scan_item_meta_json"] = f"""WITH {META_BASE}
SELECT parent_asin, title, array_to_string(categories, '|') AS categories, price,
       CAST(average_rating AS DOUBLE) AS average_rating, CAST(rating_number AS BIGINT) AS rating_number,
       array_to_string(list_transform(description, lambda x: coalesce(x, '-')), '|') AS description FROM meta"""

SQL["scan_items"] = f"""WITH {META_BASE}
SELECT asin, parent_asin, title, array_to_string(categories, '|') AS categories, price,
       CAST(average_rating AS DOUBLE) AS average_rating, CAST(rating_number AS BIGINT) AS rating_number,
       array_to_string(list_transform(description, lambda x: coalesce(x, '-')), '|') AS description, row_order FROM meta"""

SQL["price_parse"] = f"""WITH {META_BASE}
SELECT row_order, price AS raw, TRY_CAST(trim(replace(replace(price, '$', ''), ',', '')) AS DOUBLE) AS price FROM meta"""

SQL["items_build"] = f"WITH {INTER}, {META_BASE}, {ITEMS_CLEAN} SELECT * FROM clean_items"

SQL["dataset_roundtrip"] = f"""WITH {INTER}, {core(25, 24)}, {META_BASE}, {ITEMS_CLEAN}
SELECT item_id, count(*) AS n, sum(rating) AS rating_sum, any_value(title) AS title, any_value(price) AS price
FROM core JOIN clean_items USING (item_id) GROUP BY item_id"""

SQL["ts_normalize"] = f"""WITH {EV},
ms AS (SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN 'abc' ELSE CAST(CAST(floor("timestamp" * 1000) AS BIGINT) AS VARCHAR) END AS DOUBLE) AS v FROM ev),
sec AS (SELECT event_id, CASE WHEN (SELECT median(v) FROM ms) > 1e12 THEN v / 1000 ELSE v END AS epoch FROM ms)
SELECT event_id, round(epoch, 6) AS epoch, strftime(make_timestamp(CAST(epoch * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS date
FROM sec WHERE epoch IS NOT NULL"""

SQL["kcore_two_pass"] = f"""WITH {INTER}, {core(25, 24)}
SELECT user_id, item_id, rating, "timestamp", verified_purchase FROM core"""

SQL["user_history"] = f"""WITH {INTER},
fresh AS (SELECT DISTINCT user_id, item_id FROM inter WHERE verified_purchase)
SELECT user_id, item_id FROM fresh UNION ALL
SELECT DISTINCT user_id, item_id FROM inter WHERE user_id NOT IN (SELECT user_id FROM fresh)"""

SQL["confidence_matrix"] = f"""WITH {INTER},
u AS (SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS user_idx FROM (SELECT DISTINCT user_id FROM inter)),
i AS (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_idx FROM (SELECT DISTINCT item_id FROM inter))
SELECT user_id, item_id, any_value(user_idx) AS user_idx, any_value(item_idx) AS item_idx, sum(1.0::DOUBLE + 40.0::DOUBLE * rating) AS confidence
FROM inter JOIN u USING (user_id) JOIN i USING (item_id) GROUP BY user_id, item_id"""

SQL["text_corpus"] = """SELECT CAST(p_partkey AS VARCHAR) AS item_id,
 p_name || ' ' || p_brand || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS text FROM part"""

SQL["eda_sparsity"] = f"""WITH {INTER}
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_interactions,
 round(1 - count(*) / (count(DISTINCT user_id)::DOUBLE * count(DISTINCT item_id)), 6) AS sparsity FROM inter"""

SQL["eda_rating_hist"] = f"WITH {INTER} SELECT rating, count(*) AS n FROM inter GROUP BY rating"

SQL["eda_user_activity"] = f"""WITH {INTER}, c AS (SELECT count(*) AS n FROM inter GROUP BY user_id)
SELECT median(n) AS median_rows, round(avg(n), 6) AS mean_rows, max(n) AS max_rows,
 count(*) FILTER (n >= 50) AS users_50, count(*) FILTER (n >= 100) AS users_100 FROM c"""

SQL["eda_activity_hist"] = f"""WITH {INTER}, c AS (SELECT count(*) AS n FROM inter GROUP BY user_id),
e0 AS (SELECT min(n)::DOUBLE AS a, max(n)::DOUBLE AS b FROM c),
e AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM e0),
h AS (SELECT least(CAST(floor((n - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin, count(*) AS users FROM c, e GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS lower, coalesce(users, 0) AS users
FROM range(50) AS g(bin) CROSS JOIN e LEFT JOIN h ON h.bin = g.bin"""

SQL["eda_top_share"] = f"""WITH {INTER}, c AS (SELECT item_id, count(*) AS n FROM inter GROUP BY item_id),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, item_id) AS rk, count(*) OVER () AS items FROM c)
SELECT max(items) AS n_items, count(*) FILTER (rk <= floor(items * 0.1)) AS top_items,
 round(coalesce(sum(n) FILTER (rk <= floor(items * 0.1)), 0) / sum(n), 6) AS top_share FROM r"""

SQL["eda_item_popularity"] = f"""WITH {INTER}, c AS (SELECT item_id, count(*) AS n FROM inter GROUP BY item_id)
SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS "rank" FROM c"""

SQL["eda_monthly"] = f"""WITH {INTER}, m AS (SELECT date_trunc('month', make_timestamp(CAST("timestamp" * 1000000 AS BIGINT)))::DATE AS m, count(*) AS n FROM inter GROUP BY 1),
d AS (SELECT unnest(generate_series((SELECT min(m) FROM m)::TIMESTAMP, (SELECT max(m) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m)
SELECT strftime(last_day(d.m), '%Y-%m-%d') AS month_end, coalesce(n, 0) AS n FROM d LEFT JOIN m ON d.m = m.m"""

SQL["eda_dow"] = f"""WITH {INTER}, c AS (SELECT dayname(make_timestamp(CAST("timestamp" * 1000000 AS BIGINT))) AS weekday, count(*) AS n FROM inter GROUP BY 1),
d AS (SELECT * FROM (VALUES (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) AS t(day_order, weekday))
SELECT d.day_order, d.weekday, c.n FROM d LEFT JOIN c ON c.weekday = d.weekday"""

_MSG = f"""{EV},
msg AS (SELECT user_id AS key, event_id,
  '{{"event_id":"' || event_id || '","user_id":"' || user_id || '"' || coalesce(',"item_id":"' || item_id || '"', '')
  || ',"event_type":"' || event_type || '","session_id":"' || session_id || '","timestamp":' || ts_text
  || coalesce(',"metadata":{{"page":"' || page || '","referrer":"' || referrer || '","device":"' || device || '"}}', '') || '}}' AS value
  FROM (SELECT *, regexp_replace(rtrim(printf('%.15f', "timestamp" / 1e9), '0'), '\\.$', '.0') || 'E9' AS ts_text FROM ev))"""

SQL["event_encode"] = f"WITH {_MSG} SELECT key, value FROM msg"

SQL["event_parse"] = f"""WITH {EV}
SELECT event_id, user_id, item_id, event_type, session_id, "timestamp", device, page, 'ok' AS route FROM ev
WHERE CAST(event_id AS BIGINT) % 50 <> 0
UNION ALL
SELECT NULL, user_id, NULL, NULL, NULL, CAST(count(*) AS DOUBLE), NULL, NULL, 'dead' FROM ev
WHERE CAST(event_id AS BIGINT) % 50 = 0 GROUP BY user_id"""

SQL["event_enrich_page"] = f"""SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, {PAGE} AS page FROM events"""

SQL["feedback_to_events"] = f"""WITH {EV}
SELECT event_id, user_id, item_id, event_type, session_id, "timestamp", coalesce(device, 'none') AS device FROM ev
UNION ALL
SELECT 'fb-' || CAST(CAST(floor("timestamp") AS BIGINT) AS VARCHAR), user_id, item_id, event_type,
 CASE WHEN CAST(event_id AS BIGINT) % 2 = 0 THEN session_id ELSE '' END, "timestamp", coalesce(device, 'none') FROM ev WHERE event_type = 'purchase'"""

SQL["request_validate"] = """WITH r AS (
 SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderkey % 29 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS user_id,
  CAST(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 60 ELSE 10 END AS INTEGER) AS n_recommendations,
  CASE WHEN o_orderkey % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device FROM orders)
SELECT request_id, user_id, n_recommendations, CASE WHEN user_id IS NULL THEN 'user_id missing'
 WHEN n_recommendations < 1 THEN 'n_recommendations below 1' WHEN n_recommendations > 50 THEN 'n_recommendations above 50' END AS reason, device FROM r"""

SQL["event_mix"] = """SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1"""

SQL["session_integrity"] = """SELECT strftime(ts, '%Y%m%d') AS session_id, count(DISTINCT user_id) AS users FROM events
GROUP BY 1 HAVING count(DISTINCT user_id) > 1"""

SQL["sessionize"] = f"""WITH {EV}, {runs(1800)}
SELECT user_id, session_no, min("timestamp") AS session_start, max("timestamp") AS last_seen, count(*) AS session_length,
 bool_or(event_type = 'click') AS has_cart_item FROM run GROUP BY 1, 2"""

SQL["session_state"] = f"""WITH {EV}, {runs(DAY)}
SELECT user_id, min("timestamp") AS session_start, max("timestamp") AS last_seen, count(*) AS session_length,
 bool_or(event_type = 'click') AS has_cart_item FROM run GROUP BY user_id, session_no
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session_no DESC) = 1"""

SQL["session_running"] = f"""WITH {EV}, {runs(DAY)}
SELECT event_id, user_id, session_no, session_start, n_so_far AS events_so_far, cart_so_far FROM run"""

SQL["recent_views"] = f"""WITH {EV}, {runs(DAY, where="item_id IS NOT NULL AND item_id <> ''")},
lastchain AS (SELECT *, max(session_no) OVER (PARTITION BY user_id) AS m FROM run)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS view_rank, item_id, "timestamp"
FROM lastchain WHERE session_no = m
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) <= 20"""


def asof(req, ttl=DAY):
    """Session features per request by a plain range join (fine at this size)."""
    return f"""
{runs(ttl, "run")}, {runs(ttl, "vrun", where="item_id IS NOT NULL AND item_id <> ''")},
hst AS (
  SELECT r.request_id, r.user_id, r.request_ts, e."timestamp" AS t, e.session_start, e.n_so_far, e.cart_so_far
  FROM {req} r LEFT JOIN run e ON e.user_id = r.user_id AND e."timestamp" <= r.request_ts AND r.request_ts - e."timestamp" <= {ttl}
  QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY e.pos DESC NULLS LAST) = 1),
vall AS (
  SELECT r.request_id, r.request_ts, e.item_id, e."timestamp" AS t, e.pos, e.session_no,
         max(e.session_no) OVER (PARTITION BY r.request_id) AS lastno,
         max(e."timestamp") OVER (PARTITION BY r.request_id) AS lastt,
         row_number() OVER (PARTITION BY r.request_id ORDER BY e.pos DESC) AS rk
  FROM {req} r JOIN vrun e ON e.user_id = r.user_id AND e."timestamp" <= r.request_ts),
vlist AS (
  SELECT request_id, list(item_id ORDER BY rk) AS views FROM vall
  WHERE session_no = lastno AND rk <= 20 AND request_ts - lastt <= {ttl} GROUP BY request_id),
st AS (
  SELECT h.request_id, h.user_id, h.request_ts, coalesce(n_so_far, 0) AS session_length,
         coalesce(request_ts - session_start, 0) AS session_age_seconds, coalesce(t, request_ts) AS last_seen_timestamp,
         coalesce(cart_so_far, false) AS has_cart_item, coalesce(v.views, CAST([] AS VARCHAR[])) AS views
  FROM hst h LEFT JOIN vlist v ON v.request_id = h.request_id)
"""


SQL["session_asof"] = f"""WITH {EV},
req AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS user_id,
  1704067200.0::DOUBLE + (o_orderkey * 7919) % 2592000 AS request_ts FROM orders),
{asof("req")}
SELECT request_id, user_id, session_length, round(session_age_seconds, 6) AS session_age_seconds,
 round(last_seen_timestamp, 6) AS last_seen_timestamp, has_cart_item, array_to_string(views, ',') AS recent_views FROM st"""

SQL["session_flow"] = f"""WITH {EV}, {runs(DAY)},
moves AS (
 SELECT CASE WHEN is_start THEN 'start' ELSE prev_type END AS state, event_type AS next_state FROM run
 UNION ALL
 SELECT event_type, 'end' FROM run QUALIFY row_number() OVER (PARTITION BY user_id, session_no ORDER BY pos DESC) = 1)
SELECT state, next_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6) AS share FROM moves GROUP BY 1, 2"""

_UNIT = """SELECT {key}, CAST(unnest(range(len({v}))) AS INTEGER) AS axis,
 round(unnest(list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))), 6) + 0.0 AS x FROM {src}"""

SQL["vector_normalize"] = "WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) " + _UNIT.format(
    key="item_id", v="v", src="e")
SQL["user_vector_projection"] = """WITH e AS (SELECT CAST(vec_id + 100 AS VARCHAR) AS user_id,
 list_concat(CAST(embedding AS DOUBLE[])[1:40], list_transform(range(24), lambda z: 0.0::DOUBLE)) AS v FROM embeddings) """ + _UNIT.format(
    key="user_id", v="v", src="e")
