"""The operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakegraph.llm import chat, decontam, divergence, langid, mixing, pii, prefixtrie, quality, sharding, simhash, tokencount, tokenfiles, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_sharding": lambda s, d: sharding.shard_documents(_table(s, d, "documents")),
        "op2_decontamination": lambda s, d: decontam.document_hits(_table(s, d, "documents"), _table(s, d, "benchmark")),
        "op3_url_filter": lambda s, d: urlfilter.page_verdicts(_table(s, d, "pages")),
        "op4_token_counts": lambda s, d: tokencount.document_tokens(_table(s, d, "documents")),
        "op5_pii": lambda s, d: pii.document_spans(_table(s, d, "documents")),
        "op6_chat_format": lambda s, d: chat.conversation_digests(_table(s, d, "conversations")),
        "op7_language_id": lambda s, d: langid.document_languages(_table(s, d, "documents")),
        "op8_simhash": lambda s, d: simhash.document_components(_table(s, d, "documents")),
        "op9_quality": lambda s, d: quality.document_quality(_table(s, d, "documents"), _table(s, d, "labels")),
        "op10_mixing": lambda s, d: mixing.mix_documents(_table(s, d, "documents")),
        "op11_source_divergence": lambda s, d: divergence.source_divergence(_table(s, d, "documents")),
        "op12_prefix_trie": lambda s, d: prefixtrie.conversation_trie(_table(s, d, "conversations")),
        "op13_token_files": lambda s, d: tokenfiles.document_files(_table(s, d, "documents")),
    }


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)
), dg AS (
  SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), hit AS (SELECT DISTINCT dg.r, dg.p, dg.m, win.item FROM dg JOIN win USING (m, g)
), words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + m - 1)) AS q FROM hit) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN path <> '' AND host || path IN (SELECT host || path FROM p WHERE host <> '' AND contains(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), 'utm_source=')) THEN 'block'
    WHEN ('.' || host) LIKE '%.casino-win.example.com' OR ('.' || host) LIKE '%.cheap-pills.example.com' OR ('.' || host) LIKE '%.free-bets.example.com' THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (
  SELECT lang, source, t, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM (
    SELECT lang, source, unnest(w) AS t, 1 AS n, 0 AS docs FROM d UNION ALL SELECT lang, source, unnest(list_distinct(w)), 0, 1 FROM d) GROUP BY ALL
), voc AS (SELECT lang, t, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3
), v AS (SELECT lang, count(*) AS v, sum(n) AS nl FROM voc GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(nl, 0) AS nl, coalesce((SELECT sum(c.n) FROM c JOIN voc USING (lang, t) WHERE c.lang = x.lang AND c.source = x.source), 0) AS ng
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)
), full_ AS (
  SELECT g.lang, g.source, voc.t, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.ng + g.v)::HUGEINT)::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (voc.n + 1)) // (g.nl + g.v)::HUGEINT)::BIGINT AS pl
  FROM g JOIN voc USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = voc.t
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN full_ x ON x.lang = a.lang AND x.source = a.source LEFT JOIN full_ y ON y.lang = b.lang AND y.source = b.source AND y.t = x.t GROUP BY ALL
), terms AS (SELECT lang, source, t AS item, ((p - pl) * (p - pl) // pl)::BIGINT AS value FROM full_ WHERE n > 0 AND p > pl)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms) WHERE rank <= 200
"""

OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
  UNION ALL SELECT conv_id, k, role, text FROM c JOIN t USING (conv_id) WHERE k > h
), s AS (
  SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY k) FILTER (WHERE k IS NOT NULL), []) AS q FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id
), n AS (
  SELECT q[1:d] AS key, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(q) = d), '') AS ends,
         coalesce((count(*) - 1) * length(q[1:d][d].text), 0) AS saved
  FROM (SELECT conv_id, q, unnest(generate_series(0, len(q))) AS d FROM s) GROUP BY q[1:d], d
), kids AS (SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2
), sub AS (
  SELECT key[1:a] AS key, a AS d, sum(saved) AS saved, sum(leaf) AS leaves
  FROM (SELECT n.key, n.saved, (kids.n IS NULL)::BIGINT AS leaf, unnest(generate_series(0, n.d)) AS a FROM n LEFT JOIN kids ON kids.key = n.key AND kids.d = n.d) GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sub ON sub.key = n.key AND sub.d = n.d LEFT JOIN kids ON kids.key = n.key AND kids.d = n.d LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op2_decontamination": OP2_SQL, "op3_url_filter": OP3_SQL}
