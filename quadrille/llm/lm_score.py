"""Scores of texts under a bigram model by deleted interpolation.

P(w | v) mixes the maximum-likelihood estimates of the word pair and of the
word with a uniform share, by weights of the bucket that the frequency of the
context v falls into (powers of two). The weights are learned by
expectation-maximisation: one part of the training texts (the deleted part) is
predicted from counts of the others, and its counts, gathered into cells of equal
estimates, are what each round sums over on the cluster. The final estimates
count all training texts.

Counting is exact for words. Tasks turn texts into blocks; a block asks for its
different words, and for its different pairs by a 64-bit key, once each, from
buckets that sum over all blocks, and the answers come back in its own order. So
the tables grow with the corpus, a hot word or pair crosses once per block, and
nothing but the sums of a few dozen context buckets ever reaches the driver.
(Two pairs share a key, and then a count, with a chance of 1 in 2^64.)
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.llm.blocks import by_bucket, byte_table, cut, pack, pack_words, unpack, unpack_words, words_of
from quadrille.llm.text import filled

#: Texts whose checksum leaves HELD_OUT teach nothing; those that leave DELETED are predicted while the weights are learned.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text in a block: smaller ones hold less memory, but ask more often for the same pairs.
BLOCK_BYTES = 5 << 20
#: Words that blocks ask a bucket for, and tokens whose pairs meet in one.
BUCKET_WORDS, BUCKET_TOKENS = 500_000, 1_500_000
EM_ROUNDS, EM_GAIN = 40, 1e-6
BLOCK = "block long, deleted boolean, n_words long, n_tokens long, n_train long, doc_ids binary, no_ids binary, folds binary, lengths binary, tokens binary, words binary"
ASKED = "bucket long, block long, deleted boolean, keys binary, counts binary"
FOUND = "block long, bucket long, counts binary, deleted_counts binary, n_known long"
SCORED = "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: No word is empty: the end of a text is.
END = ""
_BYTES = byte_table([*range(0x09, 0x0E)])


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(filled(doc_id.cast("string"))), F.lit(folds)).cast("int")


def _pair_keys(hashes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """64-bit key of every token with the one before it; the end of the last text stands before the first."""
    h = hashes[tokens]
    before = np.empty_like(h)
    before[1:], before[:1] = h[:-1], hashes[-1]
    key = before * np.uint64(0x9E3779B97F4A7C15) + (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False)


def _pair_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _encode(deleted_fold: int, held_out: int, size: int):
    def row(number: int, ids: pa.Array, folds: np.ndarray, texts: pa.Array) -> dict:
        words, n = words_of(texts, _BYTES)
        coded = words.dictionary_encode()
        known = coded.dictionary.to_pylist()
        tokens = np.insert(coded.indices.to_numpy().astype(np.uint32), np.cumsum(n), len(known))
        lengths = n + 1
        known.append(END)
        return {
            "block": TaskContext.get().partitionId() << 32 | number, "deleted": bool(folds[0] == deleted_fold), "n_words": len(known), "n_tokens": len(tokens), "n_train": int(lengths[folds != held_out].sum()),
            "doc_ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "no_ids": pack(ids.is_null().to_numpy(zero_copy_only=False)), "folds": pack(folds), "lengths": pack(lengths), "tokens": pack(tokens), "words": pack_words(known),
        }

    def run(batches):
        made = 0
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for mine in (folds == deleted_fold, folds != deleted_fold):
                part = batch.filter(pa.array(mine))
                for start, stop in cut(part.column("text"), size):
                    one = part.slice(start, stop - start)
                    yield pa.RecordBatch.from_pylist([row(made, one.column("doc_id"), one.column("fold").to_numpy(zero_copy_only=False), one.column("text"))], schema=_ENCODED)
                    made += 1
                    pa.default_memory_pool().release_unused()

    return run


_ENCODED = pa.schema([("block", pa.int64()), ("deleted", pa.bool_()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "no_ids", "folds", "lengths", "tokens", "words"))])


def _training(r, held_out: int) -> np.ndarray:
    """Which tokens of a block teach."""
    return np.repeat(unpack(r.folds) != held_out, unpack(r.lengths).astype(np.int64))


def _ask(buckets: int, pairs: bool, held_out: int):
    """Rows of a block's different words, or pairs, for the buckets, with their training counts in it."""

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                words, tokens = unpack_words(r.words), unpack(r.tokens).astype(np.int64)
                train = _training(r, held_out)
                hashes, out = _hashes(words), []
                if pairs:
                    keys, at = np.unique(_pair_keys(hashes, tokens), return_inverse=True)
                    bucket = _pair_bucket(keys, buckets)
                else:
                    at, bucket = tokens, (hashes % np.uint64(buckets)).astype(np.int64)
                counts = np.bincount(at[train], minlength=len(bucket))
                order, runs = by_bucket(bucket)
                for b, start, stop in runs:
                    some = order[start:stop]
                    out.append((b, r.block, r.deleted, pack(keys[some]) if pairs else pack_words([words[i] for i in some]), pack(counts[some])))
                yield pd.DataFrame(out, columns=["bucket", "block", "deleted", "keys", "counts"])

    return run


def _answer(pairs: bool):
    """Sums over all blocks, sent back to each in its order; deleted blocks also get those of the deleted part."""

    def run(asked: pd.DataFrame) -> pd.DataFrame:
        counts = [unpack(c).astype(np.int64) for c in asked["counts"]]
        if pairs:
            _, at = np.unique(np.concatenate([unpack(k) for k in asked["keys"]]), return_inverse=True)
        else:
            at = pa.chunked_array([pa.array(unpack_words(k), pa.large_string()) for k in asked["keys"]]).combine_chunks().dictionary_encode().indices.to_numpy()
        sizes = [len(c) for c in counts]
        whole = np.zeros(int(at.max()) + 1, np.int64)
        gone = np.zeros_like(whole)
        parts = np.split(at, np.cumsum(sizes)[:-1])
        for part, c, deleted in zip(parts, counts, asked["deleted"], strict=True):
            whole[part] += c  # a block names a key once
            if deleted:
                gone[part] += c
        rows = [(b, k, pack(whole[part]), pack(gone[part]) if deleted else None, 0) for part, b, k, deleted in zip(parts, asked["block"], asked["bucket"], asked["deleted"], strict=True)]
        rows[0] = (*rows[0][:4], int((whole > 0).sum()))
        return pd.DataFrame(rows, columns=["block", "bucket", "counts", "deleted_counts", "n_known"])

    return run


def _resolved(block, found: pd.DataFrame, buckets: tuple[int, int], deleted: bool) -> tuple:
    """Tokens of a block; word counts by word; keys' inverse and pair counts. Kept counts alone if ``deleted``."""
    words, tokens = unpack_words(block.words), unpack(block.tokens).astype(np.int64)
    hashes = _hashes(words)
    keys, at = np.unique(_pair_keys(hashes, tokens), return_inverse=True)
    out = []
    for kind, bucket in ((0, (hashes % np.uint64(buckets[0])).astype(np.int64)), (1, _pair_bucket(keys, buckets[1]))):
        order, _ = by_bucket(bucket)
        mine = found[found["kind"] == kind].sort_values("bucket")
        got = np.concatenate([unpack(c) for c in mine["counts"]]).astype(np.int64)
        if deleted:
            got = got - np.concatenate([unpack(c) for c in mine["deleted_counts"]]).astype(np.int64)
        counts = np.empty(len(bucket), np.int64)
        counts[order] = got
        out.append(counts)
    return tokens, out[0], at, out[1]


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the logarithm of its frequency to base two."""
    return np.frexp(counts.astype(float))[1] * (counts > 0)


def _cells(buckets: tuple[int, int]):
    """Cells of equal estimates of a deleted block: (bucket, pair count, context count, word count, tokens)."""

    def run(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        tokens, words, at, pairs = _resolved(next(blocks.itertuples()), found, buckets, True)
        n = np.bincount(at, minlength=len(pairs))
        first = np.empty(len(pairs), np.int64)
        first[at[::-1]] = np.arange(len(tokens))[::-1]
        context = np.concatenate([[words[-1]], words[tokens[:-1]]])[first]
        out = pd.DataFrame({"b": context_bucket(context), "c2": pairs, "cv": np.where(pairs > 0, context, 0), "c1": words[tokens[first]], "n": n})
        return out.groupby(["b", "c2", "cv", "c1"], as_index=False)["n"].sum()

    return run


def learn_weights(cells: DataFrame, kept_tokens: int, known: int, rounds: int = EM_ROUNDS) -> list[tuple[float, float, float]]:
    """Weights (pair, word, uniform) of every context bucket, by expectation-maximisation over ``cells(b, c2, cv, c1, n)``.

    Each round is one aggregation on the cluster; its sums get one observation of
    each kind added, so no weight reaches zero. A bucket without cells keeps the
    first weights; the bucket of unseen contexts gives pairs none. Ends where a
    round gains under 1e-6 a token.
    """
    weights = np.array([(0.0, 0.5, 0.5)] + [(0.4, 0.4, 0.2)] * 64)
    if not kept_tokens:
        weights[:] = (0.0, 0.0, 1.0)
    p2 = F.when(F.col("c2") > 0, F.col("c2") / F.col("cv")).otherwise(F.lit(0.0))
    base = cells.select("b", "n", p2.alias("p2"), (F.col("c1") / F.lit(max(1, kept_tokens))).alias("p1"), F.lit(1.0 / (known + 1)).alias("p0"))
    before = -math.inf
    for _ in range(rounds):
        shares = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("b") + 1) * F.col(f"p{2 - k}") for k in range(3)]
        parts = base.select("b", "n", *[s.alias(f"s{k}") for k, s in enumerate(shares)]).withColumn("p", F.col("s0") + F.col("s1") + F.col("s2"))
        rows = parts.groupBy("b").agg(*[F.sum(F.col("n") * F.col(f"s{k}") / F.col("p")).alias(f"r{k}") for k in range(3)], F.sum(F.col("n") * F.log("p")).alias("ll"), F.sum("n").alias("n")).collect()
        for r in rows:
            seen = np.array([r["r0"], r["r1"], r["r2"]]) + ((1, 1, 1) if r["b"] else (0, 1, 1))
            weights[r["b"]] = seen / seen.sum()
        total = sum(r["ll"] for r in rows)
        if not rows or total - before < EM_GAIN * sum(r["n"] for r in rows):
            break
        before = total
    return [tuple(map(float, w)) for w in weights]


def _scores(buckets: tuple[int, int], weights: list, total: int, known: int, held_out: int):
    mix = np.array(weights)

    def run(blocks: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        block = next(blocks.itertuples())
        tokens, words, at, pairs = _resolved(block, found, buckets, False)
        lengths = unpack(block.lengths).astype(np.int64)
        context = np.concatenate([[words[-1]], words[tokens[:-1]]])
        count, w = words[tokens], mix[context_bucket(context)]
        p = w[:, 0] * pairs[at] / np.maximum(context, 1) + w[:, 1] * count / max(total, 1) + w[:, 2] / (known + 1)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        each = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has its end at least
        return pd.DataFrame({
            "doc_id": np.frombuffer(block.doc_ids, "<i8"), "no_id": unpack(block.no_ids).astype(bool), "held_out": unpack(block.folds) == held_out, "n_tokens": lengths, "n_known": each((count > 0).astype(np.int64)),
            "base_score": each(np.log10((count + 1) / (total + known + 1))), "score": each(np.log10(p)),
        })

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT, deleted: int = DELETED, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words in lower case (A-Z only) and one end, so null and empty texts
    have one token. ``base_score`` is the add-one unigram score, ``score`` that of
    the interpolated model, both as log10 probabilities of the text. Null ids count
    as the empty text for the folds; repeated rows teach and are scored each;
    without training texts every token has probability 1. An empty table gives an
    empty result; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold_of(F.col(id_col)).alias("fold"), filled(F.col(text_col).cast("string")).alias("text"))
    blocks = materialise(src.mapInArrow(_encode(deleted, held_out, block_bytes), BLOCK))
    n_words, n_tokens, total, gone = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n_words"), F.col("n_tokens"), F.col("n_train"), F.when(F.col("deleted"), F.col("n_train")))]).first()
    buckets = (1 + n_words // bucket_words, 1 + n_tokens // bucket_tokens)
    told, found = blocks.select("block", "deleted", "folds", "lengths", "tokens", "words"), None
    for kind in (0, 1):
        asked = told.mapInPandas(_ask(buckets[kind], bool(kind), held_out), ASKED)
        got = materialise(asked.groupBy("bucket").applyInPandas(_answer(bool(kind)), FOUND).withColumn("kind", F.lit(kind)))
        if not kind:
            known = got.agg(F.coalesce(F.sum("n_known"), F.lit(0))).first()[0]
        found = got if found is None else found.unionByName(got)
    part = blocks.where("deleted")
    answers = found.where(F.col("deleted_counts").isNotNull())
    cells = part.select("block", "tokens", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_cells(buckets), "b int, c2 long, cv long, c1 long, n long")
    weights = learn_weights(materialise(cells.groupBy("b", "c2", "cv", "c1").agg(F.sum("n").alias("n"))), total - gone, known)
    all_blocks = blocks.select("block", "doc_ids", "no_ids", "folds", "lengths", "tokens", "words")
    out = all_blocks.groupBy("block").cogroup(found.drop("deleted_counts").groupBy("block")).applyInPandas(_scores(buckets, weights, total, known, held_out), SCORED)
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
