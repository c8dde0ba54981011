"""SQL beside the query of spelling variants: checksums, words, one-edit pairs and chains."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

SPELLING_VARIANTS = f"""
WITH RECURSIVE steps AS MATERIALIZED (
  -- fixed value: the reversed polynomial of crc32
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), CAST(range(8) AS UBIGINT[])),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), runs AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                                 '{ascii_uppercase}', '{ascii_lowercase}') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), hexed AS MATERIALIZED (
  SELECT *, hex(encode(doc || ':' || run)) AS h FROM runs
), hashed AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
      list_transform(range(length(h) // 2),
                     lambda i: CAST(CAST('0x' || substr(h, 1 + 2 * i, 2) AS INTEGER) AS UBIGINT))),
      lambda c, b: xor(c >> 8, t[CAST(1 + xor(c & 255, b) AS INTEGER)])),
      CAST(4294967295 AS UBIGINT)) AS crc
  FROM hexed, steps
), slipped AS (
  SELECT CASE WHEN crc % 199 = 0 THEN left(run, CAST(crc % length(run) AS INTEGER))
                || substr(run, CAST(crc % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM hashed
), w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6
  GROUP BY word HAVING sum(n) >= 5
), cuts AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM w)
), longer AS MATERIALIZED (
  SELECT DISTINCT c.word AS a, c.n AS a_n, w.word AS b, w.n AS b_n FROM cuts c JOIN w ON w.word = c.rest
), near AS MATERIALIZED (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n
  FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, a_n, b, b_n FROM longer UNION ALL SELECT b, b_n, a, a_n FROM longer
), best AS MATERIALIZED (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS best_n,
         arg_min(other, (-other_n, other)) AS best
  FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, best AS form, best_n AS form_n FROM best WHERE best_n >= 5 * n
), chain AS (
  SELECT word, form AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root
), roots AS (
  SELECT c.word, c.root FROM chain c ANTI JOIN forms f ON f.word = c.root
)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n,
       coalesce(b.n_near, 0) AS n_near, f.form_n
FROM w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""
