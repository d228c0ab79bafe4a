"""The same queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .licenses import TEMPLATES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
b AS (
  SELECT page_id, n, h, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS digest
  FROM d
), l AS (SELECT h, n, min(page_id) AS lead FROM d GROUP BY h, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM b JOIN l USING (h, n)
"""

OP2 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS toks FROM docs
), tokens AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS t FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached(u, v) AS (
  SELECT u, v FROM both_ways UNION SELECT reached.u, both_ways.v FROM reached JOIN both_ways ON reached.v = both_ways.u
), least AS (SELECT u, min(v) AS low FROM reached GROUP BY u)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN least ON doc_id = u
"""

_WORDS = f"""
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents
"""

OP4 = f"""
WITH docs AS ({_WORDS}),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM docs),
items AS ({_WORDS.replace("doc_id", "item_id").replace("documents", "benchmark")}),
windows AS (
  SELECT item_id, least(len(ws), 13) AS n, unnest(range(len(ws) - least(len(ws), 13) + 1)) AS s, ws FROM items WHERE len(ws) > 0
), wanted AS (
  SELECT item_id, n, ws[s + 1 : s + n] AS win FROM windows
), lengths AS (SELECT DISTINCT n FROM wanted),
places AS (
  SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS s FROM docs, lengths WHERE len(ws) >= n
), hits AS (
  SELECT doc_id, s, wanted.n, item_id FROM places JOIN wanted ON wanted.n = places.n AND wanted.win = places.ws[s + 1 : s + places.n]
), hit_words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, s + unnest(range(n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_TEMPLATE_WORDS = ", ".join(f"({k}, {i}, '{w}', {str(t.key[0] <= i < t.key[1]).lower()})" for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
_TEMPLATES = ", ".join(f"({k}, '{t.label}', {len(t.words)}, {t.key[1] - t.key[0]}, {t.least}, {str(t.base).lower()})" for k, t in enumerate(TEMPLATES))

OP7 = f"""
WITH docs AS ({_WORDS}),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM docs),
tw(k, o, w, is_key) AS (VALUES {_TEMPLATE_WORDS}),
t(k, label, n, n_key, least, base) AS (VALUES {_TEMPLATES}),
votes AS (
  SELECT doc_id, k, p - o AS start, count(*) AS m, count(*) FILTER (is_key) AS m_key FROM words JOIN tw USING (w) GROUP BY doc_id, k, p - o
), matches AS (
  SELECT doc_id, label, base, start, m / CAST(n AS DOUBLE) AS share FROM votes JOIN t USING (k) WHERE m_key = n_key AND m >= least * n
), summed AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM matches GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs LEFT JOIN summed USING (doc_id)
"""


OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         map {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS fails
  FROM w JOIN firsts USING (text) LEFT JOIN l USING (doc_id)
),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
counted AS (SELECT part, good, toxic, fails, count(*) AS n FROM docs GROUP BY ALL),
steps AS (
  SELECT part, good, toxic, n, filter_order, step, substr(filter_order, step, 1) AS letter, fails[substr(filter_order, step, 1)] AS failed,
         len(list_filter(range(1, step), lambda k: fails[substr(filter_order, k, 1)])) AS earlier,
         len(list_filter(range(1, 6), lambda k: fails[substr(filter_order, k, 1)])) AS failures
  FROM counted, orders, (SELECT unnest(range(1, 6)) AS step)
),
summed AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT failed AND earlier = 0) AS kept, sum(n) FILTER (failed AND earlier = 0) AS removed,
         sum(n) FILTER (failed AND earlier > 0) AS redundant, sum(n) FILTER (failed AND failures = 1) AS unique_fails,
         sum(n) FILTER (failed AND earlier = 0 AND good) AS good_lost, sum(n) FILTER (failed AND earlier = 0 AND toxic) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_ngram_join": OP2, "op4_decontaminate": OP4, "op5_topk": OP5, "op7_license_scan": OP7, "op8_line_dedup": OP8, "op12_filter_audit": OP12}
