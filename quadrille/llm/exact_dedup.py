"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every text to two bits of one 32768-bit block and keeps the bits
that at least two rows set: a blocked Bloom filter of *repeated* hashes, two
bytes a row. What it shuffles are the numbers of those bits, no rows and no texts.
Pass 2 tests every row against the filter. Rows that miss are certainly
unique and pass straight through with no shuffle; only the possibly repeated
ones are written to the shared folder, grouped by the SHA-256 of their
normalised text, and given their group's keeper.

A filter of over ``max_filter_bytes`` is cut into shards of blocks. Rows are then
written once into a folder per shard, which moves nothing between tasks, and
each folder meets its own broadcast shard, so the method is the same at every
size and no broadcast exceeds the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.functions.skew import join_facts
from quadrille.llm.text import filled, without_whitespace

BLOCK_BITS = 32768
ROWS_PER_BLOCK = 2048
MAX_FILTER_BYTES = 64 << 20


def _positions(h: Column) -> tuple[Column, Column]:
    """The two bits that a hash has within its block."""
    return h.bitwiseAND(F.lit(BLOCK_BITS - 1)), F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks))


def _shard(block: Column, shards: int) -> Column:
    return F.pmod(block, F.lit(shards)).cast("int")


def repeated_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """Pass 1: (block, bits) of the bits that two or more rows of ``hashes(_h)`` set."""
    one, two = _positions(F.col("_h"))
    hits = hashes.select(_block(F.col("_h"), blocks).alias("_block"), F.explode(F.array_distinct(F.array(one, two))).alias("_bit"))
    twice = hits.groupBy("_block", "_bit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.expr("1") == F.call_function("shiftright", byte, position.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical without white space; null counts as empty.
    Of equal texts the row with the most code points stays, then the smallest
    id (null ids last); of rows equal in all that exactly one stays. An empty
    table gives an empty result; extra columns travel inside ``row``.
    """
    norm = without_whitespace(F.col(text_col))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), filled(F.col(text_col)).alias("_text"), norm.alias("_norm"))
    keyed = source.select("row", "doc_id", F.char_length("_text").alias("_len"), F.xxhash64("_norm").alias("_h"), F.sha2("_norm", 256).alias("text_sha256"))
    rows = docs.count()
    blocks = max(1, -(-rows // ROWS_PER_BLOCK))
    shards = max(1, -(-(blocks * BLOCK_BITS // 8) // max_filter_bytes))
    found = materialise(repeated_filter(docs.select(F.xxhash64(norm).alias("_h")), blocks).withColumn("_shard", _shard(F.col("_block"), shards)))
    keyed = keyed.withColumn("_block", _block(F.col("_h"), blocks))
    if shards > 1:
        keyed = materialise(keyed.withColumn("_shard", _shard(F.col("_block"), shards)), partition_by="_shard")
    one, two = _positions(F.col("_h"))
    flagged = None
    for i in range(shards):
        mine = keyed.where(F.col("_shard") == i).drop("_shard") if shards > 1 else keyed
        bits = found.where(F.col("_shard") == i).drop("_shard") if shards > 1 else found.drop("_shard")
        tested = mine.join(F.broadcast(bits), "_block", "left").withColumn("_maybe", F.coalesce(_is_set(F.col("_bits"), one) & _is_set(F.col("_bits"), two), F.lit(False))).drop("_bits")
        flagged = tested if flagged is None else flagged.unionByName(tested)
    straight = flagged.where(~F.col("_maybe")).select("row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.where("_maybe")
    maybe = materialise(maybe.select("row", "doc_id", "_len", "text_sha256", F.monotonically_increasing_id().alias("_rid")))
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("_rid").alias("r")))
    groups = maybe.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
    settled = join_facts(maybe, materialise(groups), "text_sha256", "group_size", rows)
    settled = settled.select("row", "doc_id", F.col("_best.d").alias("keep_id"), "group_size", (F.col("_best.r") == F.col("_rid")).alias("kept"), "text_sha256")
    return straight.unionByName(settled)


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the copies: the same columns, one row of each group of equal texts."""
    return exact_dedup(docs, **options).where("kept").select("row.*")
