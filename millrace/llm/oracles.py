"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_LM = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
p AS (SELECT r, w, i, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM w),
c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
o1 AS (SELECT r, w, count(*) AS c FROM w GROUP BY r, w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
n AS (SELECT count(*) AS n FROM w),
t AS (
  SELECT p.r, p.v, c1.c - o1.c AS cw, u1.c - uo.c AS cv, coalesce(c2.c - o2.c, 0) AS cvw, greatest(n.n - len(d.ws), 1) AS rest
  FROM p JOIN d ON d.r = p.r CROSS JOIN n
  JOIN c1 ON c1.w = p.w JOIN o1 ON o1.r = p.r AND o1.w = p.w
  LEFT JOIN c1 u1 ON u1.w = p.v LEFT JOIN o1 uo ON uo.r = p.r AND uo.w = p.v
  LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN o2 ON o2.r = p.r AND o2.v = p.v AND o2.w = p.w),
s AS (
  SELECT r, CASE WHEN v IS NOT NULL AND cvw > 0 THEN 0 WHEN v IS NULL THEN 0 ELSE 1 END AS b,
    CASE WHEN v IS NOT NULL AND cvw > 0 THEN ln(cvw::DOUBLE / cv)
         ELSE CASE WHEN v IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END + ln(CASE WHEN cw > 0 THEN cw::DOUBLE ELSE 0.4::DOUBLE END / rest) END AS term
  FROM t),
g AS (SELECT r, count(*) AS n_words, sum(b)::BIGINT AS n_backoff, sum(round_even(term * 1e6, 0)::BIGINT)::BIGINT AS score_micro FROM s GROUP BY r)
SELECT d.doc_id, coalesce(g.n_words, 0)::BIGINT AS n_words, coalesce(g.n_backoff, 0)::BIGINT AS n_backoff, coalesce(g.score_micro, 0)::BIGINT AS score_micro,
  round(g.score_micro / 1e6 / g.n_words, 6) AS score
FROM d LEFT JOIN g ON g.r = d.r
"""

ORACLES: dict[str, str] = {"op10_lm_scores": _LM}
