"""Queries of the operators on conversations and on statistics of the whole corpus, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.shared import table
from quadrille.llm.conversation_repair import damage, repair
from quadrille.llm.divergence import audit_sources
from quadrille.llm.lm_score import score_texts


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op11_repair": op11_repair, "op12_divergence": op12_divergence, "op13_lm_score": op13_lm_score}

#: The checksum goes bit by bit; cost to go, then the walk, are recursive over the rows of all conversations at once.
_REPAIR_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295], [(ord(key[i // 8 + 1]) >> (i % 8)) & 1 FOR i IN range(8 * len(key))]), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 20 AS c FROM k),
d AS (
  SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(CASE c WHEN 3 THEN 2 ELSE 1 END) WHERE c <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM o),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN copy > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM y),
z AS (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id),
v AS (
  SELECT conv_id, n AS i, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3 FROM z
  UNION ALL
  SELECT conv_id, i, least(s0, 5 + u), least(s1, 5 + u), u, a FROM (
    SELECT *, least(s2, 5 + s3) AS u, least(s3, 5 + s2) AS a FROM (
      SELECT v.conv_id, v.i - 1 AS i,
        least(2 + v0, k + v2 + CASE r WHEN 'u' THEN 0 ELSE 1 END, CASE r WHEN 's' THEN k + v1 ELSE 1000000000 END) AS s0,
        least(2 + v1, k + v2 + CASE r WHEN 'u' THEN 0 ELSE 1 END) AS s1,
        least(2 + v2, k + v3 + CASE r WHEN 'a' THEN 0 ELSE 1 END) AS s2,
        least(2 + v3, k + v2 + CASE r WHEN 'u' THEN 0 ELSE 1 END) AS s3
      FROM v JOIN (SELECT conv_id, i, r, CASE fault WHEN '-' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS k FROM f) f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i))),
w AS (
  SELECT conv_id, n, 0 AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said, FALSE AS done FROM z
  UNION ALL
  SELECT conv_id, n, CASE WHEN l IN ('I', 'E') THEN i ELSE i + 1 END,
    CASE WHEN l IN ('D', 'E') THEN s WHEN l = 'K' AND r = 's' THEN 1 ELSE t END, audit || CASE l WHEN 'E' THEN '' ELSE l END,
    CASE WHEN l IN ('D', 'E') THEN said ELSE list_append(said, CASE WHEN l = 'K' THEN role WHEN t = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE l WHEN 'I' THEN '' ELSE text END) END, l = 'E'
  FROM (
    SELECT w.*, f.r, f.role, f.text, CASE s WHEN 2 THEN 3 ELSE 2 END AS t,
      CASE WHEN w.i = n AND now[s + 1] = 0 THEN 'E' WHEN w.i < n AND 2 + nxt[s + 1] = now[s + 1] THEN 'D'
        WHEN 5 + now[CASE s WHEN 2 THEN 4 ELSE 3 END] = now[s + 1] THEN 'I'
        WHEN f.r = CASE s WHEN 2 THEN 'a' ELSE 'u' END AND f.k + nxt[CASE s WHEN 2 THEN 4 ELSE 3 END] = now[s + 1] THEN 'K'
        WHEN s = 0 AND f.r = 's' AND f.k + nxt[2] = now[1] THEN 'K' ELSE 'R' END AS l
    FROM w JOIN (SELECT conv_id, i, [v0, v1, v2, v3] AS now FROM v) v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = w.i
    LEFT JOIN (SELECT conv_id, i - 1 AS i, r, role, text, CASE fault WHEN '-' THEN 0 WHEN 't' THEN 5 ELSE 1000000000 END AS k FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
    LEFT JOIN (SELECT conv_id, i - 1 AS i, [v0, v1, v2, v3] AS nxt FROM v) x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i
    WHERE NOT done)),
q AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (SELECT w.conv_id, audit, said, v0 FROM w JOIN v ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.i = 0 WHERE done)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLE_SQL = {
    "op11_repair": _REPAIR_SQL,
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
m AS (SELECT g.lang, g.source, coalesce(sum(c), 0) + any_value(v.v) AS m FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT m.lang, m.source, term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // m.m AS p,
    1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
  FROM m JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
t AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM t)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
}
