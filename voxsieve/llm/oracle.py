"""Independent DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: crc32 of bytes, one table look-up per byte; the table comes from the polynomial.
_CRC = """
steps AS (
  SELECT list(c ORDER BY b) AS step FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) AS c
    FROM (SELECT unnest(range(256)) AS b)))"""


def _crc(codes: str) -> str:
    """Unsigned crc32 of a non-empty list of bytes."""
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}), "
            "lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])))")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS n,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS impacts
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS other,
    CAST(list_sum(list_transform(list_zip(q.impacts, c.impacts), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.n <> c.n AND q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, other) AS place FROM met)
WHERE place <= 5
"""

#: The empty row keeps texts without a word; buckets are computed once per distinct feature.
TARGET_RESAMPLING = f"""
WITH {_CRC},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS n, doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, {_LOWER.format("coalesce(text, '')")} FROM benchmark),
words AS (
  SELECT kind, n, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (
  SELECT kind, n, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM words),
buckets AS (
  SELECT f, {_crc("codes")} % 10000 AS bucket FROM (
    SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS codes
    FROM (SELECT DISTINCT f FROM runs)), steps),
placed AS (SELECT kind, n, bucket FROM runs JOIN buckets USING (f)),
counts AS (
  SELECT b AS bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t
  FROM (SELECT unnest(range(10000)) AS b) LEFT JOIN placed ON b = bucket GROUP BY b),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT n, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY n),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (n) WHERE kind = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * eligible // 100 THEN place END AS rank FROM ranked
"""

#: The trees level by level, all groups at once; group -1 is the tree over the groups' roots.
MANIFEST = f"""
WITH RECURSIVE {_CRC},
given AS (
  SELECT *, coalesce({_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)")} % 2 = 0, false) AS bad
  FROM documents, steps),
head AS (
  SELECT *, list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
    lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b) AS fields,
    CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM given),
leaves AS (
  SELECT doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(fields || coalesce(strlen(changed) || ':' || changed, '-')) AS start
  FROM head),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
levels AS (
  SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM levels WHERE n > 1 GROUP BY g, level, i // 3),
subroots AS (SELECT g, h, level AS depth FROM levels WHERE n = 1),
tops AS (
  SELECT -1::BIGINT AS g, 0 AS level, g AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM tops WHERE n > 1 GROUP BY g, level, i // 3),
every AS (SELECT * FROM levels UNION ALL SELECT * FROM tops),
runs AS (SELECT g, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM every WHERE n > 1 GROUP BY ALL),
climb AS (
  SELECT p.g, p.i AS leaf_no, doc_id, leaf, s.h AS subroot, s.depth, 0 AS step, p.g AS tree, 0 AS level, p.i AS spot, start AS h, '' AS proof
  FROM placed p JOIN subroots s USING (g)
  UNION ALL
  SELECT c.g, leaf_no, doc_id, leaf, subroot, depth, step + 1,
    CASE WHEN c.level + 1 = depth AND tree >= 0 THEN -1 ELSE tree END,
    CASE WHEN c.level + 1 = depth AND tree >= 0 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.level + 1 = depth AND tree >= 0 THEN c.g ELSE spot // 3 END,
    sha256(array_to_string(hs[:spot % 3], '') || c.h || array_to_string(hs[spot % 3 + 2:], '')),
    proof || array_to_string(hs[:spot % 3], '') || array_to_string(hs[spot % 3 + 2:], '')
  FROM (SELECT * REPLACE (CASE WHEN depth = 0 AND tree >= 0 THEN -1 ELSE tree END AS tree,
                          CASE WHEN depth = 0 AND tree >= 0 THEN g ELSE spot END AS spot) FROM climb) c
  JOIN runs r ON r.g = c.tree AND r.level = c.level AND r.run = c.spot // 3)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM (SELECT DISTINCT ON (g, leaf_no) * FROM climb ORDER BY g, leaf_no, step DESC), (SELECT h AS root FROM tops WHERE n = 1)
"""

_COMPONENTS = """
reach AS (
  SELECT id AS node, id AS component FROM nodes
  UNION
  SELECT v, component FROM reach JOIN links ON u = node AND component < v),
least AS (SELECT node, min(component) AS component FROM reach GROUP BY node)"""

#: A link's larger end is reached from the smaller components on its other end.
JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
nodes AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
members AS (SELECT id, len(s) AS n, unnest(s) AS m FROM nodes),
shared AS (SELECT a.id AS u, b.id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM members a JOIN members b ON a.m = b.m AND a.id < b.id
  WHERE a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
pairs AS (SELECT u, v FROM shared WHERE 100 * k >= 90 * (nu + nv - k)),
links AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
{_COMPONENTS}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component AS component_id FROM nodes JOIN least ON node = id
"""

#: Every pair is compared; the operator finds all of them where they are at least its recall apart from the cut.
NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
unit AS (SELECT id, list_transform(x, lambda c: c / sqrt(list_dot_product(x, x))) AS x FROM nodes
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT a.id AS u, b.id AS v FROM unit a JOIN unit b ON a.id <> b.id AND list_dot_product(a.x, b.x) >= 0.95),
{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE u = id) AS n_links, component AS component_id, component = id AS kept
FROM nodes JOIN least ON node = id
"""
