"""Queries of the operators that run Python kernels; SQL cannot express most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import table
from quadrille.llm.ann import search
from quadrille.llm.html_extract import extract_pages
from quadrille.llm.packing import pack
from quadrille.llm.secrets import scan_documents
from quadrille.llm.simhash import near_dedup
from quadrille.llm.toxicity import score_documents


def tokenizer_path() -> str:
    """The public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), tokenizer_path())


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_toxicity": op2_toxicity, "op4_secrets": op4_secrets, "op5_pack": op5_pack, "op6_html_extract": op6_html_extract, "op8_ann": op8_ann, "op9_simhash": op9_simhash}
