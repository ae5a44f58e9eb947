"""Queries op1, op3 and op10 with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import table
from quadrille.llm.chat_format import format_turns, read_back, text_part
from quadrille.llm.exact_dedup import exact_dedup
from quadrille.llm.mixing import mix

PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{PROBE}'), (-7L, 1L, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("content"))
    back = read_back(format_turns(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_chat_format": op1_chat_format, "op3_exact_dedup": op3_exact_dedup, "op10_mix": op10_mix}

ORACLE_SQL = {
    "op1_chat_format": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, len(role || text)
    + len(regexp_extract_all(role, '[<\[]\\*(\|(turn|text|end|image|audio|document)\|>|/?s>|</?SYS>>|/?INST\])'))
    + len(regexp_extract_all(text, '[<\[]\\*(\|(turn|text|end|image|audio|document)\|>|/?s>|</?SYS>>|/?INST\])')) + 23 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, len(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER w = 1 AS kept, h AS text_sha256
FROM k WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)""",
}
