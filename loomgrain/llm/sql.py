"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

#: Lower-cases A-Z only.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, g.text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM d GROUP BY source
), s1 AS (
  SELECT *, list_extract([3.0::DOUBLE, 1.0, 2.0], (sid % 3 + 1)::INT) AS weight, source_size * 2.0::DOUBLE AS cap FROM s0
), s2 AS (  -- sources in the order in which a rising level reaches their caps
  SELECT *, coalesce(sum(cap) OVER below, 0) AS caps, sum(weight) OVER above AS free,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s1
  WINDOW below AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         above AS (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), lv AS (
  SELECT min_by((total - caps) / free, cap / weight) AS level FROM s2 WHERE cap >= (total - caps) / free * weight
), s3 AS (
  SELECT sid, source, source_size, n, CASE WHEN cap < level * weight THEN cap ELSE level * weight END AS target FROM s1, lv
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM s3
), s5 AS (
  SELECT *, target - passes * source_size AS votes,
         floor(sum(target - passes * source_size) OVER () / 16 + 0.5)::BIGINT AS total FROM s4
), q AS (  -- all quotients that can win
  SELECT sid, votes / (2 * k + 1) AS quotient, k, total
  FROM s5, range(0, (votes / 16)::BIGINT + (SELECT count(*) FROM s5)::BIGINT + 2) r(k) WHERE votes > 0
), won AS (
  SELECT sid, count(*) AS quota FROM (
    SELECT * FROM q QUALIFY row_number() OVER (ORDER BY quotient DESC, sid, k) <= total
  ) GROUP BY sid
), s6 AS (SELECT s5.* EXCLUDE (total), coalesce(quota, 0) AS quota FROM s5 LEFT JOIN won USING (sid)
), e AS (
  SELECT doc_id, size, md5(concat('42|', coalesce(doc_id::VARCHAR, 'null'), '|', text)) AS key, s6.*
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
), p AS (
  SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % greatest(1, ceil((SELECT count(*) FROM d) / 5000.0)::BIGINT) AS shard FROM e
), c AS (
  SELECT sid, shard, sum(size)::DOUBLE AS votes, any_value(quota) AS total FROM p GROUP BY sid, shard
), cq AS (
  SELECT c.sid, shard, total, votes / (2 * k + 1) AS quotient, k
  FROM (SELECT *, sum(votes) OVER (PARTITION BY sid) AS v, count(*) OVER (PARTITION BY sid) AS s FROM c) c,
       range(0, (votes * total / v)::BIGINT + s::BIGINT + 2) r(k) WHERE votes > 0
), cw AS (
  SELECT sid, shard, count(*) AS blocks FROM (
    SELECT * FROM cq QUALIFY row_number() OVER (PARTITION BY sid ORDER BY quotient DESC, shard, k) <= total
  ) GROUP BY sid, shard
), l AS (
  SELECT p.*, c.votes::BIGINT AS length, coalesce(blocks, 0) * 16 AS quota_words,
         (sum(size) OVER (PARTITION BY p.sid, p.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM p JOIN c ON p.sid = c.sid AND p.shard = c.shard LEFT JOIN cw ON p.sid = cw.sid AND p.shard = cw.shard
), t AS (
  SELECT *, CASE WHEN length > 0 THEN quota_words // length ELSE 0 END AS again FROM l
), u AS (
  SELECT *, least(2 * size, (passes + again) * size + least(greatest(quota_words - again * length - start, 0), size))::BIGINT AS taken FROM t
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 THEN taken // size ELSE 0 END AS repeats,
       taken - CASE WHEN size > 0 THEN taken // size ELSE 0 END * size AS extra_words
FROM u
"""

#: Each five hex digits are four base-32 digits.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({0}, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1)), '')), '')"""

OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32.format("sha")} AS payload_digest,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM h
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
         lead(role) OVER w AS after,
         CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE
           coalesce('~' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'), '-') END AS label,
         replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS escaped
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(label) + 2 + length(escaped) + 8)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN role = 'system' THEN before IS NULL AND k = 1
                     WHEN role = 'user' THEN k = 1 OR before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN before = 'user' ELSE false END)
         AND coalesce(max_by(role, k), '') = 'assistant' AS valid
FROM n GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2,
    "op3_warc": OP3,
    "op4_chat_formatting": OP4,
    "op8_exact_dedup": OP8,
}
