"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from .secret_ownership import ACCESS, ASSIGN, ASSIGN_VALUE, GENERIC, HEX

LINE_WINDOWS = r"""
WITH lines AS (
  SELECT doc_id, text, i, ls[i + 1] AS raw, trim(ls[i + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT *, unnest(range(len(ls))) AS i FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), numbered AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM lines WHERE line <> ''
), windows AS (
  SELECT doc_id, k, line AS a, lead(line, 1) OVER p AS b, lead(line, 2) OVER p AS c FROM numbered WINDOW p AS (PARTITION BY doc_id ORDER BY k)
), placed AS (
  SELECT doc_id, k, first_value(doc_id) OVER q AS d0, first_value(k) OVER q AS k0 FROM windows WHERE c IS NOT NULL
  WINDOW q AS (PARTITION BY a, b, c ORDER BY doc_id, k)
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k FROM placed, range(3) AS o(j) WHERE (doc_id <> d0 OR k <> k0) AND (doc_id <> d0 OR k + j >= k0 + 3)
), marked AS (
  SELECT l.doc_id, l.i, l.raw, n.k, g.k AS gk FROM lines l LEFT JOIN numbered n USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.k = n.k
)
SELECT doc_id, count(k) AS n_lines, count(gk) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE gk IS NULL), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_VALUE = ASSIGN_VALUE.replace("'", "''")
_PATTERNS = [p.replace("'", "''") for p in (ASSIGN, ACCESS, HEX, GENERIC)]

SECRETS = (
    "WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents), k AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, source, {i} AS kind, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g "
        f"FROM t WHERE regexp_matches(text, '{p}')"
        for i, p in enumerate(_PATTERNS)
    )
    + f"""), placed AS (
  SELECT doc_id, source, kind, m[i] AS match,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k)
), valued AS (
  SELECT doc_id, source, kind, s, s + length(match) AS e, CASE kind WHEN 0 THEN regexp_extract(match, '{_VALUE}', 1) ELSE match END AS v FROM placed
), base AS (
  SELECT * FROM valued WHERE kind < 3 AND (kind > 0 OR length(v) >= 12)
), found AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM valued g WHERE kind = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.s < g.e AND g.s < b.e)
), owners AS (
  SELECT v, count(DISTINCT coalesce('=' || source, '')) AS n_owners FROM found GROUP BY v
), spans AS (
  SELECT f.doc_id, f.kind, f.s, o.n_owners <= 1 AS live,
         CASE f.kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || f.s || ':' || f.e AS span
  FROM found f JOIN owners o USING (v) WHERE f.kind < 3 OR o.n_owners <= 1
)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, kind), '') AS spans, count(*) FILTER (WHERE live) AS n_live
FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
"""
)

#: CRC-32 by a table of 256 steps; words one edit apart by what is left when a letter is taken out.
SPELLING = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS steps FROM range(256) AS t(i)
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(said, ''), lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)] ELSE [195, ord(s) - 64] END))),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM counted, crc
), words AS MATERIALIZED (
  SELECT word, sum(n) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gaps AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] AS head, word[i + 1:] AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.head || g.tail = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE form IS NOT NULL
)
SELECT f.word, f.form, r.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL) r ON r.word = f.word
"""


def lloyd(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2") -> str:
    """Every round spelt out: all distances, the nearest centroid, the floors of the means."""
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS g "
        f"FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "x AS MATERIALIZED (SELECT r, unnest(range(1, len(g) + 1)) AS j, unnest(g) AS v FROM kept)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), g) - 1 AS c, g FROM kept QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(kept.g, c{i}.g), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d "
            f"FROM kept, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )
        if i < rounds:
            ctes.append(
                f"u{i} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS g "
                f"FROM (SELECT c, j, sum(v) AS s, count(*) AS n FROM x JOIN a{i} USING (r) GROUP BY c, j) GROUP BY c)"
            )
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(u{i}.g, c{i}.g) AS g FROM c{i} LEFT JOIN u{i} USING (c))")
    n = rounds
    return "WITH " + ",\n".join(ctes) + (
        f"\nSELECT vec_id, CAST(a{n}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{n}.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{n}.g, ',')) AS centroid_sha256 FROM a{n} JOIN kept USING (r) JOIN c{n} ON c{n}.c = a{n}.c"
    )
