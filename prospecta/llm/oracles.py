"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Lines of ten characters or more; equal ones once; near ones by a shared half, confirmed by deleting one character.
LINES = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents
), occurrences AS (
    SELECT doc_id, pos, trim(line, ' ') AS line, length(trim(line, ' ')) AS n FROM split WHERE length(trim(line, ' ')) >= 10
), firsts AS (
    SELECT line, n, min(doc_id * 1000000 + pos) AS first FROM occurrences GROUP BY ALL
), pairs AS (
    SELECT a.line AS a, a.first AS fa, b.line AS b, b.first AS fb FROM firsts a JOIN firsts b
        ON a.n = b.n AND left(a.line, a.n // 2) = left(b.line, b.n // 2) AND a.line < b.line
    UNION ALL SELECT a.line, a.first, b.line, b.first FROM firsts a JOIN firsts b
        ON a.n = b.n AND substr(a.line, a.n // 2 + 1) = substr(b.line, b.n // 2 + 1) AND a.line < b.line
    UNION ALL SELECT a.line, a.first, b.line, b.first FROM firsts a JOIN firsts b
        ON a.n = b.n + 1 AND left(a.line, b.n // 2) = left(b.line, b.n // 2)
    UNION ALL SELECT a.line, a.first, b.line, b.first FROM firsts a JOIN firsts b
        ON a.n = b.n + 1 AND substr(a.line, b.n // 2 + 2) = substr(b.line, b.n // 2 + 1)
), near AS (
    SELECT DISTINCT CASE WHEN fa < fb THEN b ELSE a END AS line FROM pairs
    WHERE len(list_filter(range(1, length(a) + 1), lambda i: left(a, i - 1) || substr(a, i + 1)
        = CASE WHEN length(a) = length(b) THEN left(b, i - 1) || substr(b, i + 1) ELSE b END)) > 0
), kept AS (
    SELECT s.doc_id, s.pos, s.line,
        length(trim(s.line, ' ')) < 10 OR (f.first = s.doc_id * 1000000 + s.pos AND n.line IS NULL) AS stays
    FROM split s LEFT JOIN firsts f ON f.line = trim(s.line, ' ') LEFT JOIN near n ON n.line = trim(s.line, ' ')
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
    CAST(coalesce(k.removed, 0) AS INT) AS lines_removed
FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays) AS text,
        count(*) FILTER (WHERE NOT stays) AS removed FROM kept GROUP BY doc_id
) k ON k.doc_id = d.doc_id
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), classes AS (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM (
        SELECT doc_id, list(s ORDER BY s) AS h FROM sets GROUP BY doc_id)
), reps AS (
    SELECT s.doc_id, s.s FROM sets s JOIN classes c ON c.doc_id = s.doc_id AND c.rep = c.doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), edges AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
    SELECT rep, rep FROM classes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), components AS (
    SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(k.component, d.doc_id) AS component_id,
    coalesce(k.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN classes c USING (doc_id) LEFT JOIN components k ON k.doc_id = c.rep
"""

#: Sources reach their limit in the order of weight per word; the share of the others follows from those that have.
MIX = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w
    FROM sized GROUP BY source
), ranked AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS words,
        coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
        sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
        row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS place
    FROM sources
), unit AS (
    -- the first source, in this order, that stays under its limit sets the unit of all after it
    SELECT arg_min((words - 2.0 * full_size) / open_weight, place)
        FILTER (WHERE w * (words - 2.0 * full_size) / open_weight <= 2.0 * source_size) AS unit FROM ranked
), targets AS (
    SELECT source, source_size, CASE WHEN w * unit > 2.0 * source_size OR unit IS NULL THEN 2.0 * source_size ELSE w * unit END::DOUBLE AS target
    FROM ranked CROSS JOIN unit
)
SELECT s.doc_id, s.size, t.source_size, round(t.target, 4) AS target,
    s.size * CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target / t.source_size) AS BIGINT)
        + CASE WHEN CAST('0x' || substr(md5('0:' || CAST(s.doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0
            < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END END AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
"""

COSINES = """
WITH RECURSIVE valid AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), components AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM embeddings v JOIN components c USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a) n USING (vec_id)
"""

URLS = r"""
WITH parts AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

NEGATIVES = """
WITH valid AS (
    SELECT vec_id, min(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, arg_min(
        CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]),
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
        CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id, score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (
        PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
"""
