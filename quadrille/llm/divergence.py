"""Divergence of every source of a language from each other source, and the terms that set it apart.

Terms are counted in blocks of text and gathered, packed, by hash buckets, so a
frequent term crosses once per block and group. A bucket then holds all groups
of its terms, which are split by how many groups have them:

* heavy terms, present in many groups, fill dense numpy tiles of terms by groups
  in which every pair of columns is compared;
* light terms are lists of few groups. A pair of sources is first given what it
  would have if a term were in neither, then corrected for each source's own
  terms (equal counts of a source are one correction), and at last for each pair
  within a term's short list.

Both are partial sums in exact integers, added up by Spark over all buckets.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.llm.blocks import BLOCK_BYTES, by_bucket, byte_table, cut, pack, pack_words, unpack, unpack_words, words_of
from quadrille.llm.text import filled

MIN_DOCS, SCALE, TERM_RANKS = 3, 10**9, 200
#: Text in a hash bucket. A tile has TILE terms by GROUPS groups. A term is light in at most LIGHT groups and a quarter of its language's.
BUCKET_BYTES, TILE, GROUPS, LIGHT = 24 << 20, 1024, 256, 256
COUNTED = "bucket long, lang string, sources array<string>, words binary, docs binary, lengths binary, members binary, counts binary"
KEPT = "bucket long, lang string, sources array<string>, totals array<long>, n_terms long, words binary, lengths binary, members binary, counts binary"
PARTIAL = "lang string, source string, part string, item string, value long"
_LETTERS_ONLY = byte_table([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _postings(term: np.ndarray, group: np.ndarray, count: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``count`` by term and group: terms in order, their groups in order, the sums."""
    key, at = np.unique(term * groups + group, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, count)
    return key // groups, key % groups, total


def _count(buckets: int, size: int):
    """Packed counts of a block's terms, a row for each bucket and language; one of a language without terms is empty."""

    def block(texts: pa.Array, langs: list[str], sources: list[str]) -> list[tuple]:
        words, n = words_of(texts, _LETTERS_ONLY)
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        of_bucket = (pd.util.hash_array(np.array(names, object), categorize=False) % np.uint64(buckets)).astype(np.int64)
        key, count = np.unique(coded.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), n), return_counts=True)
        term, doc = key // len(texts), key % len(texts)
        lang_of, lang_names = pd.factorize(np.array(langs, object))
        out = []
        for k, lang in enumerate(lang_names):
            in_lang = np.flatnonzero(lang_of == k)
            source_of, source_names = pd.factorize(np.array([sources[i] for i in in_lang], object))
            own = np.zeros(len(texts), np.int64)
            own[in_lang] = source_of
            mine = lang_of[doc] == k
            t, g, c = _postings(term[mine], own[doc[mine]], count[mine], len(source_names))
            docs = np.bincount(term[mine], minlength=len(names))
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
            ids, lengths = t[first], np.diff(np.append(first, len(t)))
            order, runs = by_bucket(of_bucket[ids])
            for b, start, stop in runs or [(0, 0, 0)]:
                some = order[start:stop]
                rows = _spans(first[some], lengths[some])
                out.append((b, lang, list(source_names), pack_words([names[i] for i in ids[some]]), pack(docs[ids[some]]), pack(lengths[some]), pack(g[rows]), pack(c[rows])))
        return out

    def run(batches):
        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for start, stop in cut(batch.column("text"), size):
                rows = block(batch.column("text").slice(start, stop - start), langs[start:stop], sources[start:stop])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTED, strict=True)], schema=_COUNTED)

    return run


_COUNTED = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("sources", pa.list_(pa.string())), *((c, pa.binary()) for c in ("words", "docs", "lengths", "members", "counts"))])


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first``, in order."""
    return np.arange(int(lengths.sum())) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def _merge(min_docs: int):
    """One row of a bucket and language: counts over all blocks of the terms in ``min_docs`` documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, int] = {}
        words, terms, groups, counts = [], [], [], []
        for r in rows.itertuples():
            local = np.array([names.setdefault(s, len(names)) for s in r.sources], np.int64)
            lengths = unpack(r.lengths).astype(np.int64)
            words.append(pa.array(unpack_words(r.words) if len(lengths) else [], pa.large_string()))
            terms.append(np.repeat(np.arange(len(lengths)), lengths))
            groups.append(local[unpack(r.members).astype(np.int64)])
            counts.append(unpack(r.counts).astype(np.int64))
        coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        starts = accumulate([len(w) for w in words[:-1]], initial=0)
        docs = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(docs, ids, np.concatenate([unpack(d).astype(np.int64) for d in rows["docs"]]))
        term = ids[np.concatenate([t + s for t, s in zip(terms, starts, strict=True)])] if len(ids) else ids
        group, count = np.concatenate(groups), np.concatenate(counts)
        keep = docs[term] >= min_docs
        t, g, c = _postings(term[keep], group[keep], count[keep], max(1, len(names)))
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, g, c)
        ids, lengths = np.unique(t, return_counts=True)
        kept = coded.dictionary.take(pa.array(ids)).to_pylist()
        row = (rows["bucket"].iloc[0], rows["lang"].iloc[0], list(names), totals.tolist(), len(ids), pack_words(kept), pack(lengths), pack(g), pack(c))
        return pd.DataFrame([row], columns=["bucket", "lang", "sources", "totals", "n_terms", "words", "lengths", "members", "counts"])

    return run


def rate(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 (count + 1) / size), exact: three decimals at a time, as the product may not fit."""
    whole, rest = np.divmod(count + 1, size)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // size, rest % size
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); rates are at most 1e9 + 1, so squares fit into 64 bits."""
    d = p - q
    return d * d // q


def _heavy(rates: np.ndarray, term: np.ndarray, group: np.ndarray, base: np.ndarray, n_terms: int, a: slice, tile: int) -> np.ndarray:
    """Sums of the groups ``a`` against all groups over ``n_terms`` terms, by dense tiles."""
    out = np.zeros((len(base[a]), len(base)), np.int64)
    for start in range(0, n_terms, tile):
        some = slice(*np.searchsorted(term, [start, start + tile]))
        height = min(tile, n_terms - start)
        for low in range(0, len(base), GROUPS):
            cols = np.broadcast_to(base[low : low + GROUPS], (height, len(base[low : low + GROUPS]))).copy()
            rows = np.broadcast_to(base[a], (height, len(base[a]))).copy()
            for into, first in ((cols, low), (rows, a.start)):
                mine = (group[some] >= first) & (group[some] < first + into.shape[1])
                into[term[some][mine] - start, group[some][mine] - first] = rates[some][mine]
            for i in range(rows.shape[1]):
                out[i, low : low + cols.shape[1]] += divergence(rows[:, i : i + 1], cols).sum(0)
    return out


def _light_pairs(term: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Both orders of the places of every two groups of one term."""
    left = [np.flatnonzero(term[k:] == term[:-k]) for k in range(1, longest)]
    one = np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64)
    two = np.concatenate([*(x + k for k, x in enumerate(left, 1)), np.zeros(0, np.int64)]).astype(np.int64)
    return np.concatenate([one, two]), np.concatenate([two, one])


def _light(rates: np.ndarray, count: np.ndarray, group: np.ndarray, pairs: tuple, base: np.ndarray, n_terms: int, a: slice) -> np.ndarray:
    """Sums of the groups ``a`` against all groups over light terms: the sum for absent terms, then both corrections."""
    absent = divergence(base[a][:, None], base[None, :])
    out = n_terms * absent
    # A source's own terms, as if the other lacked them: equal counts once.
    key, at, times = np.unique(np.stack([group, count]), axis=1, return_index=True, return_counts=True)
    for g, p, n in zip(key[0], rates[at], times, strict=True):
        if a.start <= g < a.stop:
            out[g - a.start] += n * (divergence(p, base) - absent[g - a.start])
        out[:, g] += n * (divergence(base[a], p) - absent[:, g])
    i, j = pairs
    mine = (group[i] >= a.start) & (group[i] < a.stop)
    i, j = i[mine], j[mine]
    p, q, p0, q0 = rates[i], rates[j], base[group[i]], base[group[j]]
    np.add.at(out, (group[i] - a.start, group[j]), divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0))
    return out


def _tops(values: np.ndarray, group: np.ndarray, ranks: int) -> np.ndarray:
    """Places of values not below the ``ranks``-th of their group, ties included."""
    order = np.lexsort((-values, group))
    g, v = group[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(g)))
    least = v[first + np.minimum(sizes, ranks) - 1]
    return order[v >= np.repeat(least, sizes)]


def _sums(ranks: int, tile: int, light: int):
    """Partial sums of pairs, and candidates of the term part, of a bucket's terms of one language."""

    def one(r):
        names = [g["source"] for g in r.groups]
        place = {s: i for i, s in enumerate(names)}
        sizes = np.array([g["n"] for g in r.groups], np.int64)
        lengths = unpack(r.lengths).astype(np.int64)
        if not len(lengths):
            for i, s in enumerate(names) if not r.v else ():
                yield pd.DataFrame({"lang": r.lang, "source": s, "part": "pair", "item": names[:i] + names[i + 1 :], "value": 0})
            return
        words = unpack_words(r.words)
        group = np.array([place[s] for s in r.sources], np.int64)[unpack(r.members).astype(np.int64)]
        count, term = unpack(r.counts).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((group, term))
        group, count, term = group[order], count[order], term[order]
        base, rates = rate(np.zeros_like(sizes), sizes + r.v), rate(count, (sizes + r.v)[group])
        in_lang = np.zeros(len(lengths), np.int64)
        np.add.at(in_lang, term, count)
        against = rate(in_lang, np.int64(sizes.sum() + r.v))[term]
        up = np.flatnonzero(rates > against)
        told = up[_tops(divergence(rates[up], against[up]), group[up], ranks)]
        yield pd.DataFrame({"lang": r.lang, "source": [names[g] for g in group[told]], "part": "term", "item": [words[t] for t in term[told]], "value": divergence(rates[told], against[told])})
        is_light = (lengths <= light) & (4 * lengths <= len(names))
        few, many = is_light[term], ~is_light[term]
        dense = (np.cumsum(~is_light) - 1)[term[many]]
        pairs = _light_pairs(term[few], int(lengths[is_light].max(initial=0)))
        for start in range(0, len(names), GROUPS):
            a = slice(start, min(start + GROUPS, len(names)))
            total = _heavy(rates[many], dense, group[many], base, int((~is_light).sum()), a, tile) + _light(rates[few], count[few], group[few], pairs, base, int(is_light.sum()), a)
            for i in range(a.start, a.stop):
                keep = np.arange(len(names)) != i
                yield pd.DataFrame({"lang": r.lang, "source": names[i], "part": "pair", "item": names[:i] + names[i + 1 :], "value": total[i - a.start][keep]})

    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                yield from one(r)

    return run


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES, tile: int = TILE, light: int = LIGHT) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other.

    Part ``pair`` has each other source and the summed divergence, part ``term`` the
    ``term_ranks`` terms that are more frequent in the source than in its language.
    Terms are runs of letters (and of all that is not ASCII), A-Z lower-cased, in
    at least ``min_docs`` documents of the language. Nulls in any column count as
    empty; a source without terms still has its pairs, of value 0 where the
    language keeps no term. Repeated rows count each; an empty table gives an
    empty result; other columns are not read. The groups of a language stand
    in one list, the root of its part of the result.
    """
    src = docs.select(*[filled(F.col(c).cast("string")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    counted = src.mapInArrow(_count(1 + size // bucket_bytes, block_bytes), COUNTED)
    kept = materialise(counted.groupBy("bucket", "lang").applyInPandas(_merge(min_docs), KEPT))
    sizes = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("g")).groupBy("lang", F.col("g.sources").alias("source")).agg(F.sum("g.totals").alias("n"))
    langs = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(kept.groupBy("lang").agg(F.sum("n_terms").alias("v")), "lang")
    partial = kept.drop("totals", "n_terms").join(materialise(langs), "lang").mapInPandas(_sums(term_ranks, tile, light), PARTIAL)
    total = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= term_ranks))
