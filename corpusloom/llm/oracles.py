"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.quality_rules import Limits

TOPK = """
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hx FROM pages),
d AS (
    SELECT *, array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hx, CAST(1 + 5 * g AS INT), 5) AS BIGINT) >> s) & 31) + 1 AS INT), 1)), '')), '') AS digest,
        max(page_id) OVER (PARTITION BY hx) AS largest FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN largest IS NULL OR page_id = largest THEN NULL ELSE largest END AS refers_to FROM d
"""

LEAKS = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), p AS (
    SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i : i + 9], ' ') AS phrase FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)
), g AS (
    SELECT rid, i, n, array_to_string(words[i : i + n - 1], ' ') AS phrase FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM p))
), o AS (
    SELECT rid, i, g.n, item FROM g JOIN p USING (phrase)
), h AS (
    SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rid, i, n FROM o)) GROUP BY rid
), f AS (
    SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN f USING (rid)
"""

INTEGER = "list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def lloyd(rounds: int = 10) -> str:
    """The rounds one by one, as each reads the centroids of the one before."""
    steps = [f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, {INTEGER.format(scale=1024)} AS q FROM embeddings WHERE {FINITE} AND len(embedding) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY name, q) - 1 AS cluster, q FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS name, q FROM v ORDER BY name, q LIMIT 8)
)"""]
    for i in range(rounds + 1):
        steps.append(f""", a{i} AS MATERIALIZED (
    SELECT rid, vec_id, v.q, cluster, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS BIGINT) AS distance FROM v CROSS JOIN c{i} c
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)""")
        if i < rounds:
            steps.append(f""", m{i} AS (
    SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY cluster, d
), c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(n.q, c.q) AS q FROM c{i} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS q FROM m{i} GROUP BY cluster) n USING (cluster)
)""")
    return "".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)
"""


NEGATIVES = f"""
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {INTEGER.format(scale=256)} AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}
), s AS MATERIALIZED (
    SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
    SELECT rid, other, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY rid, p.other ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s USING (rid) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT * FROM n WHERE rank <= 3
"""

SPACES = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"


def quality(limits: Limits = Limits()) -> str:
    return f"""
WITH r AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{A_WORD}')) AS lines FROM r
), e AS (
    SELECT rid, i, array_to_string(words[i : i + 7], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)
), f AS (
    SELECT rid, i FROM e QUALIFY count(*) OVER (PARTITION BY rid, s) > 1
), c AS (
    SELECT rid, sum(covered)::BIGINT AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS covered FROM f) GROUP BY rid
), l AS (
    SELECT rid, host, text, trim(regexp_replace(lower(line), '{SPACES}', ' ', 'g')) AS line, len(list_filter(regexp_split_to_array(line, '{SPACES}'), lambda x: x <> '')) AS words FROM (SELECT rid, host, text, unnest(lines) AS line FROM w)
), h AS (
    SELECT host, count(DISTINCT text) AS texts FROM r GROUP BY host
), o AS (
    SELECT host, line FROM l JOIN h USING (host) GROUP BY host, line, texts HAVING count(DISTINCT text) > {limits.least_docs} OR (count(DISTINCT text) > {limits.few_docs} AND count(DISTINCT text) > {limits.share} * texts)
), g AS (
    SELECT rid, sum(words)::BIGINT AS gone FROM l JOIN o USING (host, line) GROUP BY rid
), m AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(g.gone, 0) AS removed_words
    FROM w LEFT JOIN c USING (rid) LEFT JOIN g USING (rid)
), b AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {limits.least_words} OR removed_words > {limits.most_removed} * n_words)) AS kept FROM b
"""


def all_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality(), "op7_topk": TOPK, "op9_warc": WARC, "op11_centroid_clustering": lloyd(), "op12_hard_negatives": NEGATIVES, "op13_decontamination": LEAKS}
