"""The corpus pipeline: stages over ``documents``, each reading what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.shared import materialise, table
from quadrille.llm.exact_dedup import drop_copies
from quadrille.llm.mixing import take_copies
from quadrille.llm.packing import pack
from quadrille.llm.queries_python import tokenizer_path
from quadrille.llm.simhash import drop_near_copies
from quadrille.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the labels are those outside the held-out fold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts whose five-word shingles are similar to 0.8 or more stays."""
    return drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return take_copies(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("simhash near-dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]
#: Learned scores, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds every stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
