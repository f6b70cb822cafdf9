"""The queries that SQL can express, in SQL for DuckDB. Written apart from the operators: windows are rows here."""

from __future__ import annotations

_GONE = """hit AS (SELECT doc_id, i FROM win JOIN (SELECT h, {first} FROM win GROUP BY h) f USING (h) WHERE {later}),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range({n}) r(k))"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _codes(rounds: int = 6) -> str:
    """Product codes by exact distances to all entries; every round is two tables."""
    nearest = """SELECT p.vec_id, p.part, min({{'d': CAST(list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': c.e}}) AS m
  FROM p JOIN c{k} c USING (part) GROUP BY p.vec_id, p.part"""
    entries = """SELECT c.part, c.e, coalesce(n.s, c.s) AS s FROM c{k} c LEFT JOIN (
    SELECT part, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS s
    FROM (SELECT part, m.e AS e, i, sum(s[i]) AS total, count(*) AS n FROM a{k} JOIN p USING (vec_id, part), (SELECT unnest(range(1, width + 1)) AS i FROM size) GROUP BY 1, 2, 3)
    GROUP BY part, e) n USING (part, e)"""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(4096 * x) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false))""",
        "size AS (SELECT max(len(x)) // 8 AS width FROM v)",
        "p AS MATERIALIZED (SELECT vec_id, part, x[part * width + 1:part * width + width] AS s FROM v, size, range(8) r(part))",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, s FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for k in range(rounds):
        steps += [f"a{k} AS MATERIALIZED ({nearest.format(k=k)})", f"c{k + 1} AS MATERIALIZED ({entries.format(k=k)})"]
    steps.append(f"a AS MATERIALIZED ({nearest.format(k=rounds)})")
    steps.append("coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a GROUP BY vec_id)")
    return f"""WITH {",\n".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)"""


SQL = {
    # A byte is two hexadecimal digits here; hits no more than 100 bytes apart are one removed run.
    "op1_suffix_array_dedup": r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
piece AS (
  SELECT doc_id, 512 * p AS low, substring(x, CAST(1024 * p + 1 AS BIGINT), 1222) AS x
  FROM (SELECT doc_id, x, unnest(range(CAST(length(x) // 1024 + 1 AS BIGINT))) AS p FROM t)),
win AS (
  SELECT doc_id, low + j AS i, md5_number(substring(x, CAST(2 * j + 1 AS BIGINT), 200)) AS h
  FROM (SELECT doc_id, low, x, unnest(range(CAST(least(512, length(x) // 2 - 99) AS BIGINT))) AS j FROM piece)),
hit AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS begins
  FROM win JOIN (SELECT h, min({'d': doc_id, 'i': i}) AS m FROM win GROUP BY h) f USING (h) WHERE m.d < doc_id OR (m.d = doc_id AND m.i < i)),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e
  FROM (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, r),
edges AS (
  SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS after
  FROM (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, length(x) // 2, NULL FROM t)),
kept AS (
  SELECT doc_id, string_agg(substring(x, CAST(2 * after + 1 AS BIGINT), CAST(2 * (s - after) AS BIGINT)), '' ORDER BY s) AS k
  FROM edges JOIN t USING (doc_id) WHERE s > after GROUP BY 1),
gone AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_tiled_embedding_dedup": """WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE e IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: coalesce(isfinite(x), false)), false)),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id, vec_id AS least FROM embeddings UNION SELECT l.b, r.least FROM reach r JOIN link l ON l.a = r.vec_id WHERE r.least < l.b)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id) AS n_links, c.least AS component_id, c.least = e.vec_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(least) AS least FROM reach GROUP BY 1) c USING (vec_id)""",
    "op7_anchored_substring_dedup": rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM t)),
{_GONE.format(first="min(doc_id) AS m", later="m < doc_id", n=13)},
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL) AS x
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)""",
    "op9_winnowing_decontamination": rf"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
span AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
win AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM t, (SELECT DISTINCT n FROM span))),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN span USING (s, n)),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(13) r(k) WHERE k < n GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM t LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_segment_mean_codes": _codes(),
}
