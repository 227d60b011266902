"""Registered queries of the text operators: QUERIES and, where SQL can say it, ORACLE."""

from __future__ import annotations

import public_tokenizers

from cardwatch.llm import (
    bpe,
    collocations,
    exact_dedup,
    lines,
    near_dedup,
    packing,
    quality,
    rules,
    runs,
    secrets,
    substrings,
    warc,
    wavelet,
)
from cardwatch.llm.common import documents

#: Vocabulary files of the registered queries.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = sql


_add("op5_exact_dedup", lambda spark, d: exact_dedup.exact_dedup(documents(spark, d)), r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""")

_add("op4_secret_scan", lambda spark, d: secrets.secret_report(documents(spark, d)), r"""
WITH r(kind, name, p, g, least) AS (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]{16,}', 0, 20), (2, 'hex', '[0-9a-f]{24,}', 0, 24)),
m AS (SELECT doc_id, kind, name, least, string_split_regex(coalesce(text, ''), p) AS gap,
  regexp_extract_all(coalesce(text, ''), p, 0) AS hit,
  CASE WHEN g = 2 THEN regexp_extract_all(coalesce(text, ''), p, 2) ELSE regexp_extract_all(coalesce(text, ''), p, 0) END
    AS part FROM documents, r),
e AS (SELECT doc_id, kind, name, least, i, length(hit[i]) AS n, length(part[i]) AS size,
  sum(length(gap[i])) OVER w + sum(length(hit[i])) OVER w AS stop
  FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m)
  WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
  count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, kind) AS spans
  FROM e WHERE size >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")

_add("op2_wavelet_shards", lambda spark, d: wavelet.token_files(
    documents(spark, d), public_tokenizers.path(WORD_BPE), end_id=2))

_add("op7_forced_boundary_bpe", lambda spark, d: bpe.round_trip(
    documents(spark, d), public_tokenizers.path(BYTE_BPE)))

_add("op10_retrieval_packing", lambda spark, d: packing.pack_report(
    documents(spark, d), public_tokenizers.path(BYTE_BPE), end_id=1))

_add("op9_robust_outliers", lambda spark, d: rules.judge(documents(spark, d)))

_add("op1_quality_nbsvm", lambda spark, d: quality.quality_report(
    documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")))

_add("op6_weighted_minhash", lambda spark, d: near_dedup.near_dedup(documents(spark, d)))

_add("op8_prefix_doubling", lambda spark, d: substrings.repeated_report(documents(spark, d)))

_add("op3_line_runs", lambda spark, d: lines.line_report(documents(spark, d)), r"""
WITH l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i, len(parts) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
w AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS place, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, w >= 50 AND min(place) OVER (PARTITION BY line) + 1 <= place AS c1,
  i + 2 <= n AND w + w1 >= 50 AND min(place) OVER (PARTITION BY line, l1, i + 2 <= n) + 2 <= place AS c2,
  i + 3 <= n AND w + w1 + w2 > 0 AND min(place) OVER (PARTITION BY line, l1, l2, i + 3 <= n) + 3 <= place AS c3
  FROM v),
g AS (SELECT *, c1 OR c2 OR c3 OR coalesce(lag(c2 OR c3, 1) OVER o, FALSE) OR coalesce(lag(c3, 2) OVER o, FALSE) AS gone
  FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS fresh FROM g)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (fresh) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM h GROUP BY doc_id""")

_add("op11_warc_source", lambda spark, d: warc.archive_report(spark.read.parquet(f"{d}/pages.parquet")), """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT *, strlen(h) >= 1000 AND page_id <> max(page_id) OVER w AS again, max(page_id) OVER w AS top
  FROM p WINDOW w AS (PARTITION BY h))
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM t""")

_add("op12_periodic_runs", lambda spark, d: runs.run_report(documents(spark, d)))

_add("op13_phrase_streams", lambda spark, d: collocations.top_collocations(documents(spark, d)), """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS u,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
    'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS x FROM documents),
p AS (SELECT lang, u, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
  FROM (SELECT lang, u, string_split(x, chr(10)) AS parts FROM t)),
w AS (SELECT lang, u, i, unnest(ws) AS a, generate_subscripts(ws, 1) AS j
  FROM (SELECT lang, u, i, list_filter(string_split(piece, ' '), lambda s: s <> '') AS ws FROM p)),
g AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY u, i ORDER BY j)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, a, count(*) AS f FROM g GROUP BY ALL HAVING f >= 10),
f2 AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING f >= 10),
longer AS (SELECT lang, a, b, max(f) AS f FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3)
  GROUP BY ALL),
cut AS (SELECT x.lang, x.a || ' ' || x.b AS phrase, x.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 x
  JOIN f1 l ON l.lang = x.lang AND l.a = x.a JOIN f1 r ON r.lang = x.lang AND r.a = x.b
  LEFT JOIN longer y ON y.lang = x.lang AND y.a = x.a AND y.b = x.b
  WHERE NOT coalesce(100 * y.f >= 50 * x.f, FALSE)
  UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 1, l.f, r.f FROM f3 x
  JOIN f1 l ON l.lang = x.lang AND l.a = x.a JOIN f2 r ON r.lang = x.lang AND r.a = x.b AND r.b = x.c
  UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 2, l.f, r.f FROM f3 x
  JOIN f2 l ON l.lang = x.lang AND l.a = x.a AND l.b = x.b JOIN f1 r ON r.lang = x.lang AND r.a = x.c),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT m.lang, phrase, a, l, r, n.n, score,
  row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m JOIN n ON n.lang = m.lang)
WHERE rank <= 2000""")
