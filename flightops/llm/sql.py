"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# windows of 13 words that also start in a document with a smaller id; touching windows of a
# document form one removed span
OP1 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 12, 0))) AS i FROM d)),
hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM win)
  WHERE f < doc_id),
cut AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) > 13 AS new
  FROM hit),
span AS (
  SELECT doc_id, min(i) AS a, max(i) + 13 AS b
  FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut)
  GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b
  FROM span
  UNION ALL
  SELECT d.doc_id, coalesce(max(b), 0), len(any_value(w))
  FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (
  SELECT doc_id, flatten(list(list_slice(w, a + 1, b) ORDER BY a)) AS k
  FROM gap JOIN d USING (doc_id) WHERE b > a GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(len(k), 0))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# the source targets: a source is filled up to twice its size if the level lies above
OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(doc_id::VARCHAR) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
v AS (
  SELECT *, ((sum(source_size) OVER () * 3.0::DOUBLE / 2)
    - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight::DOUBLE,
        source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight::DOUBLE,
        source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
e AS (
  SELECT first(level ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST)
    FILTER (level <= 2 * source_size / weight::DOUBLE) AS level
  FROM v),
t AS (
  SELECT source, source_size, least(
    (2 * source_size)::DOUBLE, coalesce(e.level * weight, (2 * source_size)::DOUBLE)) AS target
  FROM v, e),
q AS (
  SELECT d.doc_id, size, source_size, target, coalesce(sum(size) OVER (
    PARTITION BY d.source ORDER BY place, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (
  greatest(0, least(size, floor(target)::BIGINT - start))
  + greatest(0, least(size, floor(target)::BIGINT - start - source_size)))::BIGINT AS taken
FROM q
"""

OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM d)),
hit AS (
  SELECT doc_id, i
  FROM win JOIN (SELECT s, min(doc_id) AS f FROM win GROUP BY s) USING (s) WHERE f < doc_id),
cut AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) > 50 AS new
  FROM hit),
span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut)
  GROUP BY doc_id, g),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b, 1 AS n
  FROM span
  UNION ALL
  SELECT d.doc_id, coalesce(max(b), 0), len(any_value(h)) // 2, 0
  FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (
  SELECT doc_id, sum(n) AS n_spans,
    string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, ((len(h) - len(k)) // 2)::BIGINT AS n_removed,
  n_spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
"""


def _placed(kind: str, rank: int, pattern: str, value: str) -> str:
    """Spans of a pattern: the lengths of the texts between matches give the positions."""
    return rf"""
  SELECT doc_id, owner, repository, '{kind}' AS kind, {rank} AS rank, m AS span, {value} AS v,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
     + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
  FROM (
    SELECT *, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS i
    FROM (SELECT *, regexp_extract_all(t, '{pattern}') AS found,
            string_split_regex(t, '{pattern}') AS gaps FROM d))"""


_ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
           r"([A-Za-z0-9+/_.=-]+)")

OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner,
    concat(coalesce(source, chr(0)), chr(1), coalesce(lang, chr(0))) AS repository
  FROM documents),
base AS (
  SELECT * FROM ({_placed('assign', 0, _ASSIGN, f"regexp_extract(m, '{_ASSIGN}', 1)")})
  WHERE length(v) >= 12
  UNION ALL {_placed('access', 1, 'AKIA[A-Z0-9]{14,}', 'm')}
  UNION ALL {_placed('hex', 2, '[0-9a-f]{16,}', 'm')}),
more AS (
  SELECT * FROM ({_placed('token', 3, '[A-Za-z0-9+/_-]{24,}', 'm')}) x
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id
      AND b.a < x.a + length(x.span) AND x.a < b.a + length(b.span))),
c AS (SELECT * FROM base UNION ALL SELECT * FROM more),
o AS (SELECT v, count(DISTINCT owner) <= 2 AS live FROM c GROUP BY v),
j AS (SELECT c.*, live, concat(kind, ':', a, ':', a + length(span)) AS said
      FROM c JOIN o USING (v)),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY a, rank) FILTER (kind <> 'token') AS base_said,
    string_agg(said, ',' ORDER BY a, rank) FILTER (kind <> 'token' OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_said, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (doc_id)
"""


_CRC32 = """xor(list_reduce([4294967295::UBIGINT] || list_transform(
    string_split({text}, ''), lambda x: ascii(x)::UBIGINT), lambda c, b: list_reduce(
      [xor(c, b)] || range(8)::UBIGINT[], lambda a, i:
        xor(a >> 1, (a & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(concat(" + ", ".join(
        f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + "))"


# a path lists the siblings from the leaf to the root, with the side on which they stand
OP11 = rf"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf('n_chars')} AS h,
    CASE WHEN {_CRC32.format(text='doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')}
      ELSE {_leaf('n_chars')} END AS given
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos
  FROM leaf),
lv AS (
  SELECT tree, 0 AS lvl, pos, count(*) OVER (PARTITION BY tree) AS n, h FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM lv WHERE n > 1 GROUP BY tree, lvl, n, pos // 2),
sub AS (
  SELECT tree, h, max(lvl) OVER (PARTITION BY tree) AS height,
    row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM lv WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, count(*) OVER () AS n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lvl, n, pos // 2),
root AS (SELECT h FROM top WHERE n = 1),
upper AS (
  SELECT tree, coalesce(list(CASE WHEN s.h IS NULL THEN '=' WHEN (sub.pos >> l.lvl) % 2 = 1
      THEN '<' || s.h ELSE '>' || s.h END ORDER BY l.lvl) FILTER (l.lvl IS NOT NULL), []) AS path
  FROM sub LEFT JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) l ON true
  LEFT JOIN top s ON s.lvl = l.lvl AND s.pos = xor(sub.pos >> l.lvl, 1)
  GROUP BY tree),
lower AS (
  SELECT p.tree, p.pos, coalesce(list(CASE WHEN s.h IS NULL THEN '=' WHEN (p.pos >> l.lvl) % 2 = 1
      THEN '<' || s.h ELSE '>' || s.h END ORDER BY l.lvl) FILTER (l.lvl IS NOT NULL), []) AS path
  FROM placed p LEFT JOIN (SELECT DISTINCT tree, lvl FROM lv WHERE n > 1) l ON l.tree = p.tree
  LEFT JOIN lv s ON s.tree = p.tree AND s.lvl = l.lvl AND s.pos = xor(p.pos >> l.lvl, 1)
  GROUP BY p.tree, p.pos),
joined AS (
  SELECT doc_id, placed.h AS leaf, sub.h AS subroot, given, lower.path || upper.path AS path
  FROM placed JOIN lower USING (tree, pos) JOIN upper USING (tree) JOIN sub USING (tree)),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) AS proof_sha256,
    list_reduce([given] || path, lambda a, s: sha256(
      CASE WHEN s[1] = '<' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM joined)
SELECT doc_id, leaf, subroot, root.h AS root, proof_sha256, folded_root,
  folded_root = root.h AS verified
FROM folded, root
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1,
        "op2_mix_sources": OP2,
        "op3_secret_scan": OP3,
        "op10_suffix_dedup": OP10,
        "op11_merkle_manifest": OP11,
    }
