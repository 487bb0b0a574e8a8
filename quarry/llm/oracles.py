"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force, round trips and held-out labels."""

SQL: dict[str, str] = {
    "op5_host_quality": r"""
WITH d AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS t, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY 1),
m AS (
  SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dups FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR symbols OR dups)::DOUBLE AS f FROM f GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS m, sum(n * n) AS n2, sum(f * f / n) AS f2 FROM h),
b AS (SELECT m, CASE WHEN n * n > n2 THEN (f2 - m * m * n - (k - 1) * m * (1 - m)) / (n - n2 / n) ELSE 0 END AS v FROM a),
p AS (SELECT m, CASE WHEN v > 0 THEN greatest(2.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM b),
q AS (SELECT source, least(greatest((f + m * k) / (n + k), 1e-6), 1 - 1e-6) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ln(rate / (1 - rate)) + CASE WHEN symbols THEN 4.0 ELSE -1.0 END + CASE WHEN dups THEN 0.5 ELSE -0.1 END <= 0 AS kept
FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source""",
    "op7_zip_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM s""",
    "op9_block_anchors": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j,
  unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i + 34 <= len(w) THEN sha256(array_to_string(w[i:i + 34], ' ')) END)) AS k FROM d),
c AS (SELECT doc_id, word, j, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS starts FROM p),
g AS (SELECT doc_id, word, j, max(starts::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM c),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)""",
    "op10_chat_format": r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id, alone ORDER BY turn) AS new,
    length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) AS r
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN new THEN 9 + r + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone""",
}
