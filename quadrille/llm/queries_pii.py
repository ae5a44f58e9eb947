"""Query of the PII operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.shared import table
from quadrille.llm.pii import replace_pii


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return out.select("row.doc_id", "text", "n_entities", "spans")


QUERIES = {"op7_pii": op7_pii}
