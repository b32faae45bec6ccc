"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, text: str, pattern: str) -> str:
    """Numbered rows (r) and their words (x) with places from 1 (k)."""
    return f"""{table}_rows AS MATERIALIZED (SELECT row_number() OVER () AS r, {key}, {text} AS text FROM {table}),
{table}_words AS MATERIALIZED (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY o) AS k FROM (
  SELECT r, unnest(l) AS x, generate_subscripts(l, 1) AS o FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS l FROM {table}_rows)))"""


def _windows(table: str, n: int) -> str:
    """Runs of n words that fit, as text."""
    return f"""SELECT r, k, s FROM (SELECT r, k, string_agg(x, ' ') OVER w AS s, count(*) OVER w AS many FROM {table}_words
  WINDOW w AS (PARTITION BY r ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE many = {n}"""


SUBSTRINGS = f"""WITH {_words("documents", "doc_id", "coalesce(text, '')", _WORD)},
win AS MATERIALIZED ({_windows("documents", 35)}),
often AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, k + d AS k FROM win JOIN often USING (s), (SELECT unnest(range(35)) AS d)),
kept AS (SELECT w.r, count(*) AS n, count(g.k) AS lost, string_agg(x, ' ' ORDER BY w.k) FILTER (WHERE g.k IS NULL) AS t
  FROM documents_words w LEFT JOIN gone g ON g.r = w.r AND g.k = w.k GROUP BY w.r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents_rows LEFT JOIN kept USING (r)"""

DECONTAMINATION = f"""WITH {_words("documents", "doc_id", _LOWER, _ALNUM)},
{_words("benchmark", "item_id", _LOWER, _ALNUM)},
length AS (SELECT r, count(*) AS n FROM benchmark_words GROUP BY r),
item_win AS MATERIALIZED ({_windows("benchmark", 10)}
  UNION ALL SELECT r, 1, string_agg(x, ' ' ORDER BY k) FROM benchmark_words JOIN length USING (r) WHERE n < 10 GROUP BY r),
doc_win AS MATERIALIZED ({" UNION ALL ".join(f"SELECT *, {n} AS n FROM ({_windows('documents', n)})" for n in range(1, 11))}),
met AS MATERIALIZED (SELECT d.r, d.k, d.n, i.r AS item FROM doc_win d JOIN item_win i ON i.s = d.s),
hit AS (SELECT r, count(DISTINCT k + d) AS n_hit FROM (SELECT DISTINCT r, k, n FROM met), (SELECT unnest(range(10)) AS d) WHERE d < n GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT met.r, CAST(item_id AS VARCHAR) AS id FROM met JOIN benchmark_rows b ON b.r = item) GROUP BY r),
total AS (SELECT r, count(*) AS n FROM documents_words GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents_rows LEFT JOIN total USING (r) LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

JACCARD = f"""WITH RECURSIVE {_words("documents", "doc_id", _LOWER, _WORD)},
length AS (SELECT r, count(*) AS n FROM documents_words GROUP BY r),
shingle AS MATERIALIZED (SELECT DISTINCT r, s FROM ({_windows("documents", 5)})
  UNION ALL SELECT r, string_agg(x, ' ' ORDER BY k) FROM documents_words JOIN length USING (r) WHERE n < 5 GROUP BY r),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM shingle GROUP BY r),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM shingle x JOIN shingle y ON x.s = y.s AND x.r < y.r GROUP BY ALL)
  JOIN size p ON p.r = a JOIN size q ON q.r = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM documents_rows UNION SELECT reach.a, way.b FROM reach JOIN way ON way.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(e.doc_id) AS component_id
FROM documents_rows d JOIN reach ON reach.a = d.r JOIN documents_rows e ON e.r = reach.b LEFT JOIN size ON size.r = d.r
GROUP BY d.r, d.doc_id, n"""

COLLOCATIONS = f"""WITH piece AS (SELECT row_number() OVER () AS r, lang, x FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
word AS (SELECT r, lang, unnest(l) AS x, generate_subscripts(l, 1) AS o
  FROM (SELECT r, lang, regexp_extract_all(x, '[^\x20\x09]+') AS l FROM piece)),
lead_by AS MATERIALIZED (SELECT lang, x AS a, lead(x) OVER p AS b, lead(x, 2) OVER p AS c FROM word WINDOW p AS (PARTITION BY r ORDER BY o)),
f AS MATERIALIZED (SELECT lang, [a] AS w, count(*) AS f FROM lead_by GROUP BY lang, a
  UNION ALL SELECT lang, [a, b], count(*) FROM lead_by WHERE b IS NOT NULL GROUP BY lang, a, b
  UNION ALL SELECT lang, [a, b, c], count(*) FROM lead_by WHERE c IS NOT NULL GROUP BY lang, a, b, c),
often AS (SELECT lang, w, f AS a FROM f WHERE len(w) > 1 AND f >= 10),
longer AS (SELECT lang, w, max(a) AS m FROM (SELECT lang, w[1:2] AS w, a FROM often WHERE len(w) = 3
  UNION ALL SELECT lang, w[2:3], a FROM often WHERE len(w) = 3) GROUP BY lang, w),
own AS (SELECT lang, w, a FROM often LEFT JOIN longer USING (lang, w) WHERE m IS NULL OR 100 * m < 50 * a),
cut AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM own),
scored AS (SELECT c.lang, c.w, a, k, p.f AS l, q.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(p.f AS HUGEINT) * q.f) AS score
  FROM cut c JOIN f p ON p.lang = c.lang AND p.w = c.w[1:k] JOIN f q ON q.lang = c.lang AND q.w = c.w[k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank,
  array_to_string(w, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000"""


def _rounds(n: int) -> str:
    """Assignments a0, a1, .. to the codebooks b0, b1, .. and the codebooks after them."""
    out = []
    for k in range(n + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT r, part, entry, d FROM (
  SELECT v.r, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM x v JOIN b{k} b ON b.part = v.part AND b.pos = v.pos GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)""")
        if k < n:
            out.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CAST(CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x
  FROM b{k} b LEFT JOIN (SELECT v.part, a.entry, v.pos, sum(v.x) AS s, count(*) AS n FROM x v JOIN a{k} a ON a.r = v.r AND a.part = v.part GROUP BY ALL) m
  ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return ",\n".join(out)


VECTOR_CODES = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding AS e, len(embedding) // 8 AS wide
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // wide AS part, (i - 1) % wide AS pos, CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, wide, unnest(e) AS c, generate_subscripts(e, 1) AS i FROM v)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM x WHERE r <= 16),
{_rounds(6)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  sha256((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos) FROM b6)) AS codebooks_sha256
FROM coded JOIN v USING (r)"""
