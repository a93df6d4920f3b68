"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op7_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2') AS body,
         replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ': ', '\3') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op4_sharding": r"""
WITH entry AS (
  SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value
  FROM range(256) t(i)
), crc AS (SELECT list(value ORDER BY i) AS entries FROM entry),
docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hexed, strlen(coalesce(text, '')) + 1 AS size,
         CAST('0x' || substr(md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents
), checked AS (
  SELECT doc_id, source, size, key,
         xor(list_reduce([4294967295::BIGINT] || list_transform(range(size - 1), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT),
             lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, crc
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS frac
  FROM checked
), placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, source, doc_id, text_crc32, size) - 1 AS position, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST((position * 16) // n AS INTEGER) AS shard,
       CAST(position - (((position * 16) // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
""",
    "op12_filter_audit": r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)
), steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, CAST(s AS INTEGER), 1) AS f, substr(filter_order, 1, CAST(s AS INTEGER) - 1) AS earlier FROM orders, range(1, 6) r(s)),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM docs LEFT JOIN known USING (doc_id)
), masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM failing GROUP BY part, fails),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT contains(fails, f) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, f) AND translate(fails, earlier, '') = fails THEN bad ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
""",
    "op13_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), keyed AS (
  SELECT *, CAST('0x' || substr(md5('mixture-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest), 1, 15) AS BIGINT) AS key FROM docs
), queues AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM keyed
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM totals),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), levels AS (SELECT level FROM filled WHERE cap > weight * level ORDER BY cap / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, rank, CASE WHEN cap <= weight * f.level THEN cap::DOUBLE ELSE weight * (SELECT level FROM levels) END AS target FROM filled f
), placed AS (
  SELECT q.doc_id, q.size, q.key, q.digest, q.upto, t.source_size, t.rank, t.target, row_number() OVER () AS row FROM queues q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, turn * source_size + upto AS stop FROM placed, range(3) r(turn) WHERE size > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY stop / target, rank, stop ROWS UNBOUNDED PRECEDING) AS served FROM copies
), spent AS (
  SELECT row, CAST(sum(greatest(0, least(size, (SELECT sum(size) FROM docs) - served + size))) AS BIGINT) AS taken FROM served GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN spent USING (row)
""",
    "op11_phrases": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), spots AS (SELECT piece, lang, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM pieces),
grams AS (SELECT lang, w1, lead(w1) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM spots),
one AS (SELECT lang, w1, count(*) AS a FROM grams GROUP BY lang, w1),
two AS (SELECT lang, w1, w2, count(*) AS a FROM grams WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS a FROM grams WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
totals AS (SELECT lang, sum(a) AS n FROM one GROUP BY lang),
cuts AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, 1 AS cut, t.a, x.a AS l, y.a AS r FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
  WHERE NOT EXISTS (SELECT 1 FROM three o WHERE o.lang = t.lang AND o.w1 = t.w1 AND o.w2 = t.w2 AND 100 * o.a >= 50 * t.a)
    AND NOT EXISTS (SELECT 1 FROM three o WHERE o.lang = t.lang AND o.w2 = t.w1 AND o.w3 = t.w2 AND 100 * o.a >= 50 * t.a)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.a, x.a, y.a FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.a, x.a, y.a FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3
), scored AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
