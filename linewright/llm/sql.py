"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _shingles(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT {key}, array_to_string(w[p:p + 4], ' ') AS shingle
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p
          FROM (SELECT {key}, {_WORDS} AS w FROM {table}
                WHERE {key} IS NOT NULL AND text IS NOT NULL)
          WHERE len(w) > 0)"""


# What the chat template breaks up inside texts: each takes one more character.
_MARKS = [
    first + rest
    for first in "<["
    for rest in ("s>", "/s>", "inst]", "inst:", "/inst]", "/inst:", "sys>", "/sys>",
                 "<sys>", "</sys>")
]


def _escaped_chars(column: str) -> str:
    marks = " + ".join(
        f"(length({column}) - length(replace(lower({column}), '{m}', ''))) // {len(m)}"
        for m in _MARKS
    )
    return f"(length(replace({column}, chr(92), chr(92) || chr(92))) + {marks})"


def _centroid_rounds(rounds: int) -> str:
    """Lloyd's rounds over ``parts`` (row, component, whole number), one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
    SELECT r, c, d FROM (
        SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
            SELECT p.r, k.c, sum((p.x - k.x) * (p.x - k.x)) AS d
            FROM parts p JOIN centre{r} k USING (j) GROUP BY p.r, k.c))
    WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
    SELECT c, j, sum(x) AS s, count(*) AS n FROM near{r} JOIN parts USING (r) GROUP BY c, j),
centre{r + 1} AS MATERIALIZED (
    SELECT k.c, k.j, CASE WHEN n IS NULL THEN k.x ELSE (s - ((s % n) + n) % n) // n END AS x
    FROM centre{r} k LEFT JOIN mean{r} USING (c, j))""")
    return ",".join(steps)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ORDER = "ORDER BY turn NULLS FIRST, role, text"

ORACLE = {
    "op1_rlz_dedup": r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
windows AS (
    SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p
          FROM words WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, p + o AS i
    FROM windows JOIN firsts USING (h), range(50) AS r(o)
    WHERE first < doc_id),
lost AS (SELECT doc_id, list(i) AS ps FROM gone GROUP BY doc_id),
kept AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
           CASE WHEN ps IS NULL THEN w ELSE
             list_transform(
               list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])),
               lambda z: z[1]) END AS k
    FROM words LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept""",
    "op10_contain_minhash": f"""
WITH items AS ({_shingles("benchmark", "item_id")}),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
docs AS ({_shingles("documents", "doc_id")})
SELECT doc_id, item_id, count(*) AS n_shared, n AS n_item, count(*) / n AS containment
FROM docs JOIN items USING (shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n
HAVING count(*) * 5 >= n * 4""",
    "op6_ball_tree": """
WITH vectors AS (
    SELECT DISTINCT vec_id,
        list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT)
               AS score
    FROM vectors q, vectors c
    WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op9_prefix_chat": f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, {_escaped_chars("text")} + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15
        WHEN 'assistant' THEN 6 ELSE 16 + {_escaped_chars("role")}
        + length(role) - length(replace(role, ']', '')) END AS chars
    FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op11_centroid_matrix": f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: 1024 * CAST(x AS DOUBLE)) AS v
    FROM embeddings
    WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT r, j, CAST(floor(v[j]) AS HUGEINT) AS x
    FROM (SELECT r, v, unnest(range(1, 65)) AS j FROM kept)),
first AS (
    SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c
    FROM kept),
centre0 AS MATERIALIZED (SELECT c, j, x FROM first JOIN parts USING (r) WHERE c < 8),
{_centroid_rounds(10)},
digests AS (
    SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h
    FROM centre10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM near10 JOIN kept USING (r) JOIN digests USING (c)""",
    "op12_mask_ranking": f"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS ts
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
totals AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM docs WHERE len(ts) > 0),
found AS MATERIALIZED (
    SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY r, t),
weights AS (
    SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT)
        AS w
    FROM found, totals GROUP BY t, n_docs),
items AS (
    SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS ts
    FROM (SELECT DISTINCT item_id, text FROM benchmark
          WHERE item_id IS NOT NULL AND text IS NOT NULL)),
asked AS (
    SELECT q, t, count(*) * w AS gain
    FROM (SELECT q, unnest(ts) AS t FROM items) JOIN weights USING (t) GROUP BY q, t, w),
parts AS (
    SELECT r, t, CAST((1000000000 * tf)
        // (1000 * tf + 12 * (75 + (25 * len(ts) * n_docs) // n_terms)) AS BIGINT) AS part
    FROM found JOIN docs USING (r), totals),
scored AS (
    SELECT q, r, CAST(sum(gain * part) AS BIGINT) AS score
    FROM asked JOIN parts USING (t) GROUP BY q, r),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
    FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM ranked JOIN items USING (q) WHERE rank <= 20""",
}
