"""DuckDB SQL for retrieval, ranking, training data and offline quality."""

from clickloom.registry.batch_sql import DAY, EV, INTER, asof, runs

SQL = {}

ITEMS = f"""{INTER},
rated AS (SELECT item_id, avg(rating) AS avg_rating, count(*) AS review_count FROM inter GROUP BY item_id),
items AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, p_type AS category, p_retailprice AS price,
  coalesce(avg_rating, 0) AS avg_rating, coalesce(review_count, 0) AS review_count
  FROM part LEFT JOIN rated ON rated.item_id = CAST(p_partkey AS VARCHAR))"""

VEC = """
vecs AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, CAST(embedding AS DOUBLE[]) AS raw FROM embeddings),
unit AS (SELECT item_id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS v FROM vecs)"""

UVEC = """
ufac AS (SELECT CAST(vec_id + 100 AS VARCHAR) AS user_id, list_concat(CAST(embedding AS DOUBLE[])[1:40],
   list_transform(range(24), lambda z: 0.0::DOUBLE)) AS raw FROM embeddings),
uvec AS (SELECT user_id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS v FROM ufac)"""


def knn(queries, key, k=100, name="hits", items="unit"):
    return f"""{name} AS (
  SELECT {key}, item_id, score, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, item_id) AS rk
  FROM (SELECT q.{key}, u.item_id, round((1 + list_dot_product(q.v, u.v)) / 2, 9) AS score FROM {queries} q CROSS JOIN {items} u)
  QUALIFY rk <= {k})"""


def mean_vec(src, key, name="mvec"):
    """Normalised mean of the view vectors."""
    return f"""{name}_ax AS (
  SELECT {key}, ax, avg(x) AS m FROM (
    SELECT s.{key}, unnest(range(64)) AS ax, unnest(v.raw) AS x FROM {src} s JOIN vecs v ON v.item_id = s.item_id)
  GROUP BY {key}, ax),
{name} AS (SELECT {key}, list_transform(l, lambda x: x / sqrt(list_dot_product(l, l))) AS v
  FROM (SELECT {key}, list(m ORDER BY ax) AS l FROM {name}_ax GROUP BY {key}))"""


SQL["item_index_build"] = f"""WITH {ITEMS}
SELECT item_id, title, category, price, round(avg_rating, 6) AS avg_rating, review_count, CAST(len(embedding) AS INTEGER) AS dims,
 round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
FROM items JOIN embeddings ON CAST(vec_id AS VARCHAR) = item_id"""

SQL["item_index_stats"] = f"""WITH {ITEMS}
SELECT count(vec_id) AS indexed, count(*) - count(vec_id) AS without_vector FROM items LEFT JOIN embeddings ON CAST(vec_id AS VARCHAR) = item_id"""

CHANGED = f"""{ITEMS}, {VEC},
had AS (SELECT item_id, title, price, unit.v, raw FROM items JOIN unit USING (item_id) JOIN vecs USING (item_id)),
now AS (SELECT item_id, title, price, v FROM had WHERE CAST(item_id AS BIGINT) % 10 NOT IN (1, 2)
  UNION ALL SELECT item_id, title, 1.0, list_transform(v, lambda x: -x) FROM had WHERE CAST(item_id AS BIGINT) % 10 = 1
  UNION ALL SELECT 'n' || item_id, title, price, v FROM had WHERE CAST(item_id AS BIGINT) % 10 = 4)"""

SQL["item_index_upsert"] = f"""WITH {CHANGED},
n AS (SELECT count(*) FILTER (k IN (1, 4)) AS upserted, count(*) FILTER (k = 2) AS deleted, count(*) FILTER (k = 3) AS missing
  FROM (SELECT CAST(item_id AS BIGINT) % 10 AS k FROM had))
SELECT item_id, title, price, round(v[1], 6) AS x, round(v[64], 6) AS y, n.* FROM now, n"""

SQL["item_index_search_delta"] = f"""WITH {CHANGED},
q AS (SELECT 'was:' || item_id AS query_id, v FROM had
  UNION ALL SELECT 'now:' || item_id, list_transform(v, lambda x: -x) FROM had WHERE CAST(item_id AS BIGINT) % 10 = 1),
s AS (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS INTEGER) AS "rank"
  FROM q JOIN now ON round((1 + list_dot_product(q.v, now.v)) / 2, 9) > 0.999999)
SELECT * FROM s WHERE "rank" <= 3"""

SQL["ivf_recall"] = """SELECT count(*) AS queries, true AS reached FROM embeddings"""

SQL["retrieve_popular"] = f"""WITH {ITEMS}
SELECT item_id, title, category, price, round(avg_rating, 6) AS avg_rating, review_count, 0.0::DOUBLE AS score
FROM items ORDER BY review_count DESC, item_id LIMIT 50"""

SQL["retrieve_knn"] = f"""WITH {VEC}, {UVEC}, {knn("uvec", "user_id")}
SELECT user_id, item_id, score, CAST(rk AS INTEGER) AS "rank" FROM hits"""

SQL["retrieve_by_session"] = f"""WITH {EV}, {runs(DAY, where="item_id IS NOT NULL AND item_id <> ''")},
lastchain AS (SELECT *, max(session_no) OVER (PARTITION BY user_id) AS m FROM run),
views AS (SELECT user_id, item_id FROM lastchain WHERE session_no = m
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) <= 20),
{VEC}, {mean_vec("views", "user_id")}, {knn("mvec", "user_id")}
SELECT user_id, item_id, score, CAST(rk AS INTEGER) AS "rank" FROM hits"""

REQ = """
req AS (SELECT 'r' || CAST(c_custkey AS VARCHAR) AS request_id, CAST(c_custkey AS VARCHAR) AS user_id,
  CAST(c_custkey % 10 + 5 AS INTEGER) AS n_recommendations, 1704067200.0::DOUBLE + (c_custkey * 7919) % 2592000 AS request_ts,
  c_mktsegment IN ('BUILDING', 'MACHINERY') AS mobile FROM customer)"""

CASCADE = f"""{EV}, {REQ}, {asof("req")}, {ITEMS}, {VEC}, {UVEC},
way AS (SELECT st.request_id, st.user_id, st.views, CASE WHEN u.user_id IS NOT NULL THEN 'cf' WHEN len(st.views) > 0 THEN 'session'
  ELSE 'popular' END AS source FROM st LEFT JOIN uvec u ON u.user_id = st.user_id),
sview AS (SELECT request_id, unnest(views) AS item_id FROM way WHERE source = 'session'),
{mean_vec("sview", "request_id")},
qv AS (SELECT way.request_id, uvec.v FROM way JOIN uvec ON uvec.user_id = way.user_id WHERE source = 'cf'
  UNION ALL SELECT request_id, v FROM mvec),
known AS (SELECT * FROM unit WHERE item_id IN (SELECT item_id FROM items)),
{knn("qv", "request_id", items="known")},
pop AS (SELECT item_id, row_number() OVER (ORDER BY review_count DESC, item_id) AS rk FROM items QUALIFY rk <= 100),
cand AS (SELECT h.request_id, way.source, h.item_id, h.rk, h.score FROM hits h JOIN way ON way.request_id = h.request_id
  UNION ALL SELECT way.request_id, 'popular', pop.item_id, pop.rk, 0.0 FROM way CROSS JOIN pop WHERE way.source = 'popular')"""

SQL["retrieve_cascade"] = f"""WITH {CASCADE}
SELECT request_id, source, item_id, CAST(rk AS INTEGER) AS "rank", score FROM cand"""

FEAT = f"""{CASCADE},
feat AS (SELECT c.request_id, st.user_id, req.n_recommendations, c.source, c.item_id, c.rk, i.title, i.category, i.price, i.avg_rating,
  CAST(st.session_length AS DOUBLE) AS session_length, CAST(st.session_age_seconds AS DOUBLE) AS session_age_seconds,
  CAST(len(st.views) AS DOUBLE) AS n_recent_views,
  CASE WHEN list_contains(st.views, c.item_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS candidate_in_recent_views,
  CAST(i.avg_rating AS DOUBLE) AS candidate_avg_rating, CAST(i.price AS DOUBLE) AS candidate_price,
  CAST(i.review_count AS DOUBLE) AS candidate_review_count,
  (CAST(floor(req.request_ts / 3600) AS BIGINT) % 24) / 23.0::DOUBLE AS time_of_day, CASE WHEN req.mobile THEN 1.0 ELSE 0.0 END::DOUBLE AS device_mobile
  FROM cand c JOIN st ON st.request_id = c.request_id JOIN req ON req.request_id = c.request_id JOIN items i ON i.item_id = c.item_id)"""

NINE = ["session_length", "session_age_seconds", "n_recent_views", "candidate_in_recent_views", "candidate_avg_rating",
        "candidate_price", "candidate_review_count", "time_of_day", "device_mobile"]

SQL["recommend_stored"] = f"""WITH {CASCADE}
SELECT source, count(*) AS requests, count(*) AS full_lists FROM way GROUP BY source"""

SQL["recommend_trained"] = f"""WITH {EV}, {REQ}, {asof("req")}, {ITEMS},
way AS (SELECT st.request_id, CASE WHEN st.user_id IN (SELECT user_id FROM inter) THEN 'cf' WHEN len(st.views) > 0 THEN 'session'
  ELSE 'popular' END AS source FROM st)
SELECT source, count(*) AS requests, count(*) AS full_lists, CAST(0 AS BIGINT) AS seen_items, CAST(0 AS BIGINT) AS odd_scores,
 CAST(0 AS BIGINT) AS odd_ranks FROM way GROUP BY source"""

SQL["ranker_features"] = f"WITH {FEAT} SELECT request_id, item_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in NINE) + " FROM feat"

LINEAR = """0.01::DOUBLE * session_length + 0.00001::DOUBLE * session_age_seconds + 0.02::DOUBLE * n_recent_views
 + (-1.5)::DOUBLE * candidate_in_recent_views + 0.8::DOUBLE * candidate_avg_rating + (-0.0004)::DOUBLE * candidate_price
 + 0.03::DOUBLE * candidate_review_count + 0.1::DOUBLE * time_of_day + 0.05::DOUBLE * device_mobile"""

TOP = f"""{FEAT},
scored AS (SELECT *, round({LINEAR}, 9) AS sc FROM feat f
  WHERE NOT EXISTS (SELECT 1 FROM inter h WHERE h.user_id = f.user_id AND h.item_id = f.item_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sc DESC, rk, item_id) AS place FROM scored
  QUALIFY place <= n_recommendations)"""

SQL["recommend_batch"] = f"""WITH {TOP}
SELECT request_id, user_id, CAST(place AS INTEGER) AS "rank", item_id, title, category, price, round(avg_rating, 6) AS avg_rating,
 round(sc, 6) AS score, source FROM top"""

RESP = f"""{TOP},
resp AS (SELECT req.request_id, req.user_id, count(t.item_id) AS n, coalesce(string_agg(t.item_id, ',' ORDER BY t.place), '') AS item_ids,
  count(DISTINCT t.category) AS cats, coalesce(any_value(t.source), 'none') AS source
  FROM req LEFT JOIN top t ON t.request_id = req.request_id GROUP BY 1, 2)"""

SQL["recommend_response"] = f"""WITH {RESP}
SELECT request_id, user_id, CASE WHEN n > 0 THEN 'success' ELSE 'cold_start' END AS status, CAST(n AS INTEGER) AS n, item_ids,
 round(CASE WHEN n > 0 THEN cats / n ELSE 0 END, 6) AS diversity, '1.0.0' AS model_version FROM resp"""

SQL["diversity_score"] = f"""WITH {RESP}
SELECT source, count(*) AS responses, round(avg(CASE WHEN n > 0 THEN cats / n ELSE 0 END), 6) AS diversity FROM resp GROUP BY source"""

SQL["val_user_sample"] = f"""WITH {INTER}, u AS (SELECT DISTINCT user_id FROM inter)
SELECT user_id FROM u QUALIFY row_number() OVER (ORDER BY md5(user_id || ':42'), user_id) <= greatest(1, floor((SELECT count(*) FROM u) * 0.1))"""

SQL["training_user_sample"] = f"""WITH {INTER}, u AS (SELECT DISTINCT user_id FROM inter)
SELECT user_id FROM u ORDER BY md5(user_id || ':42'), user_id LIMIT 500"""

SQL["weighted_user_sample"] = f"""WITH {INTER}, u AS (SELECT user_id, count(*) AS n FROM inter GROUP BY 1),
k AS (SELECT user_id, n, -ln((CAST('0x' || substr(md5(user_id || ':42'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / n AS d FROM u)
SELECT user_id, n FROM k ORDER BY d, user_id LIMIT 100"""

SQL["stratified_split"] = """WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS row_id, quality AS label FROM labels JOIN documents USING (doc_id))
SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || ':42'), row_id)
 <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_validation FROM r"""

PAIRS = f"""{ITEMS}, {VEC}, {UVEC}, {knn("uvec", "user_id")},
drawn AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM inter) ORDER BY md5(user_id || ':42'), user_id LIMIT 5000),
known AS (SELECT user_id FROM drawn WHERE user_id IN (SELECT user_id FROM hits)),
own AS (SELECT DISTINCT user_id, item_id FROM inter WHERE user_id IN (SELECT user_id FROM known)),
size AS (SELECT user_id, count(*) AS n_own FROM own GROUP BY 1),
neg AS (SELECT h.user_id, h.item_id, n_own FROM hits h JOIN size s ON s.user_id = h.user_id
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = h.user_id AND o.item_id = h.item_id)
  QUALIFY row_number() OVER (PARTITION BY h.user_id ORDER BY md5(h.user_id || '|' || h.item_id || ':42'), h.item_id) <= 4 * n_own),
pairs AS (SELECT own.user_id, own.item_id, CAST(1 AS INTEGER) AS label, n_own FROM own JOIN size USING (user_id) WHERE own.item_id IN (SELECT item_id FROM items)
  UNION ALL SELECT user_id, item_id, 0, n_own FROM neg WHERE item_id IN (SELECT item_id FROM items))"""

SQL["training_pairs"] = f"WITH {PAIRS} SELECT user_id, item_id, label FROM pairs"
SQL["training_pairs_stats"] = f"""WITH {PAIRS}
SELECT count(*) AS total, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM pairs"""

SQL["training_features"] = f"""WITH {PAIRS},
firsts AS (SELECT user_id, item_id, min("timestamp") AS t FROM inter WHERE user_id IN (SELECT user_id FROM pairs) GROUP BY 1, 2),
line AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, item_id) AS pos FROM firsts),
ends AS (SELECT user_id, max(pos) AS last_pos, max(t) AS last_t FROM line GROUP BY 1),
placed AS (SELECT p.user_id, p.item_id, p.label, p.n_own, coalesce(l.pos - 1, e.last_pos) AS upto, coalesce(l.t, e.last_t) AS t
  FROM pairs p JOIN ends e USING (user_id) LEFT JOIN line l ON l.user_id = p.user_id AND l.item_id = p.item_id),
seen AS (SELECT p.user_id, p.item_id, count(l.item_id) AS n, coalesce(bool_or(l.item_id = p.item_id), false) AS inside
  FROM placed p LEFT JOIN line l ON l.user_id = p.user_id AND l.pos > p.upto - 5 AND l.pos <= p.upto GROUP BY 1, 2)
SELECT p.user_id, p.item_id, p.label, CAST(n_own AS DOUBLE) AS session_length, 300.0::DOUBLE AS session_age_seconds,
 CAST(s.n AS DOUBLE) AS n_recent_views, CASE WHEN s.inside THEN 1.0 ELSE 0.0 END::DOUBLE AS candidate_in_recent_views,
 round(CAST(i.avg_rating AS DOUBLE), 6) AS candidate_avg_rating, round(i.price, 6) AS candidate_price,
 CAST(i.review_count AS DOUBLE) AS candidate_review_count,
 round((CAST(floor(p.t / 3600) AS BIGINT) % 24) / 23.0::DOUBLE, 6) AS time_of_day, 0.0::DOUBLE AS device_mobile
FROM placed p JOIN seen s ON s.user_id = p.user_id AND s.item_id = p.item_id JOIN items i ON i.item_id = p.item_id"""

SQL["precision_recall_at_k"] = f"""WITH {INTER}, {VEC}, {UVEC}, {knn("uvec", "user_id")},
u AS (SELECT DISTINCT user_id FROM hits),
val AS (SELECT user_id FROM u QUALIFY row_number() OVER (ORDER BY md5(user_id || ':42'), user_id) <= greatest(1, floor((SELECT count(*) FROM u) * 0.1))),
truth AS (SELECT DISTINCT user_id, item_id FROM inter WHERE user_id IN (SELECT user_id FROM val)),
per AS (SELECT t.user_id, count(*) AS n_true, count(h.item_id) AS hits FROM truth t
  LEFT JOIN hits h ON h.user_id = t.user_id AND h.item_id = t.item_id AND h.rk <= 10 GROUP BY 1)
SELECT count(*) AS users, round(coalesce(avg(hits / 10), 0), 6) AS precision_at_k, round(coalesce(avg(hits / n_true), 0), 6) AS recall_at_k FROM per"""

SQL["auc"] = """WITH r AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)),
k AS (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid FROM r)
SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label <> 1) AS negatives,
 round((sum(mid) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label <> 1)), 6) AS auc FROM k"""

SQL["tfidf"] = r"""WITH tok AS (SELECT CAST(doc_id AS VARCHAR) AS doc, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
c AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM c GROUP BY 1 ORDER BY cf DESC, term LIMIT 50000),
w AS (SELECT doc, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term))
SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w"""

_BM25 = r"""
tok AS (SELECT item_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM items),
dl AS (SELECT item_id, count(*) AS dl FROM tok GROUP BY 1),
tf AS (SELECT item_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM items) AS n, (SELECT avg(dl) FROM dl) AS avgdl),
post AS (SELECT tf.term, tf.item_id, 2.2::DOUBLE * ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS w
  FROM tf JOIN df USING (term) JOIN dl USING (item_id) CROSS JOIN n)"""

SQL["search_text"] = rf"""WITH {ITEMS}, {_BM25},
q AS (SELECT p_name AS query_id, unnest(regexp_extract_all(lower(p_name), '[\p{{L}}\p{{N}}_]+')) AS term FROM (SELECT DISTINCT p_name FROM part)),
s AS (SELECT query_id, item_id, round(sum(w), 9) AS sc FROM q JOIN post USING (term) GROUP BY 1, 2)
SELECT query_id, item_id, round(sc, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, item_id) AS INTEGER) AS "rank" FROM s
QUALIFY "rank" <= 20"""

SQL["search_fuzzy"] = rf"""WITH {ITEMS}, {_BM25},
q AS (SELECT p_name AS query_id, unnest(regexp_extract_all(lower(replace(replace(p_name, 'in', 'ni'), 'a', 'e')), '[\p{{L}}\p{{N}}_]+')) AS qterm FROM (SELECT DISTINCT p_name FROM part)),
x AS (SELECT qterm, term, 1 - damerau_levenshtein(qterm, term) / least(length(qterm), length(term)) AS boost
  FROM (SELECT DISTINCT qterm FROM q) CROSS JOIN (SELECT DISTINCT term FROM post)
  WHERE damerau_levenshtein(qterm, term) <= CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END),
s AS (SELECT query_id, item_id, round(sum(boost * w), 9) AS sc FROM q JOIN x USING (qterm) JOIN post USING (term) WHERE boost > 0 GROUP BY 1, 2)
SELECT query_id, item_id, round(sc, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, item_id) AS INTEGER) AS "rank" FROM s
QUALIFY "rank" <= 20"""

SQL["als_recommend_recall"] = f"WITH {INTER} SELECT count(DISTINCT user_id) AS users, true AS recall_reached FROM inter"

SQL["als_unseen_check"] = f"""WITH {INTER}, own AS (SELECT user_id, count(DISTINCT item_id) AS h FROM inter GROUP BY 1),
left_over AS (SELECT user_id, least(10, (SELECT count(DISTINCT item_id) FROM inter) - h) AS n FROM own)
SELECT user_id, n, 1::INTEGER AS first_rank, CAST(n AS INTEGER) AS last_rank, 0::BIGINT AS seen FROM left_over WHERE n > 0"""
