"""DuckDB SQL for the queries that SQL can express."""

SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        f AS (SELECT page_id, n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS m FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
        FROM f
    """,
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                   FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
    "op11_ranked_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
        t AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        c AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        k AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM f, s),
        i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)) AS impact FROM c, s),
        r AS (SELECT item_id, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score
              FROM k JOIN w USING (term) JOIN i USING (term) GROUP BY item_id, doc_id),
        o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
    """,
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        g AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM p WHERE same),
        h AS (SELECT g.anchor_id, g.other_id AS positive_id, p.other_id AS negative_id, g.score AS positive_score, p.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY g.anchor_id, g.other_id ORDER BY p.score DESC, p.other_id) AS INT) AS rank
              FROM g JOIN p ON g.anchor_id = p.anchor_id AND NOT p.same AND 80 * g.score <= 100 * p.score AND p.score <= g.score
              WHERE g.k <= 5)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
    """,
}
