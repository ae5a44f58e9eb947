"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fitting reads labelled rows only, at most ``max_toxic`` and ``max_clean`` of
them in hash order (documented bounds; the class totals over all labels
reweight the sample). Terms are words and word beginnings. Every term of the
examples counts whose relation to the label passes a likelihood-ratio test at
the ten-per-cent level, toxic and clean ones alike; there is no cap on them. Only stop
words (``COMMON``, ``TELLING``) are left out, which fill most postings. A term weighs (1 + log tf) times its inverse document frequency times the log of
its ratio, so the long tail of the vocabulary takes part without drowning the
terms that tell. Examples, clean ones included, are unit vectors in an inverted
index whose postings stand in blocks of ``BLOCK`` examples with the largest
weight of each term per block.

Scoring takes a text's terms, bounds every block by the sum of its block
maxima, reads the blocks of the largest bounds, and then all others whose bound
reaches the k-th neighbour so far: the neighbours are exactly those of a full
search. Votes are weighted by distance and mapped to probabilities by an
isotonic fit on leave-one-out votes, which the executors cast. A score depends
on the text alone, and no text reaches the driver.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise

NEIGHBOURS, BLOCK, FIRST_BLOCKS, THRESHOLD = 15, 256, 1, 0.3
MAX_TOXIC, MAX_CLEAN, MIN_EXAMPLES = 1024, 3072, 3
SIGNIFICANT = 2.706  # of the likelihood ratio: the ten-per-cent point of chi-squared
COMMON, TELLING = 0.2, 4.0  # stop words: terms in more than this share of examples whose odds differ by less than this factor
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
SKETCH, CACHED_WORDS = 4, 300_000
EVIDENCE = "struct<score:double,evidence:array<struct<doc_id:long,label:int,cosine:double,term:string>>>"
VECTOR = "_id long, toxic int, terms binary, counts binary"  # little-endian 32-bit numbers


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def _count_terms(batches):
    """(term, toxic, clean): in how many examples of either label a term stands, per batch."""
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, y in zip(batch["text"], batch["toxic"], strict=True):
            seen[int(y)].update({t for w in set(words_of(text)) for t in terms_of(w)})
        names = list(seen[0] | seen[1])
        if names:
            yield pd.DataFrame({"term": names, "toxic": [seen[1][t] for t in names], "clean": [seen[0][t] for t in names]})


def sketch(text: str | None) -> str:
    """What near copies mostly share and other texts do not: the smallest checksums of adjacent words.

    Texts of fewer than ``SKETCH`` pairs are told apart by their whole sequence of words.
    """
    words = words_of(text)
    pairs = {zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)}
    if len(pairs) < SKETCH:
        return "=" + hashlib.md5(" ".join(words).encode()).hexdigest()
    return ",".join(map(str, sorted(pairs)[:SKETCH]))


def _likelihood_ratio(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """G-squared of the two-by-two table of term and label."""
    n, row = float(n1 + n0), toxic + clean
    cell = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(F.lit(0.0))
    out = cell(toxic, row * (n1 / n)) + cell(clean, row * (n0 / n))
    return 2 * (out + cell(n1 - toxic, (n - row) * (n1 / n)) + cell(n0 - clean, (n - row) * (n0 / n)))


@dataclass
class Lexicon:
    """The vocabulary with the weight of every term."""

    place: dict[str, int]
    weight: np.ndarray
    digest: str

    def counts(self, text: str | None, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the known terms in a text, by place."""
        places = list(itertools.chain.from_iterable(map(known.__getitem__, (text or "").split())))
        return np.unique(np.array(places, np.int64), return_counts=True)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF weights of the terms; empty if there are none."""
        v = (1 + np.log(counts)) * self.weight[terms]
        norm = math.sqrt(float(v @ v))
        return v / norm if norm else v


class Known(dict):
    """The places of the terms in a stretch without white space; once full, results stay and the table too."""

    def __init__(self, words: Lexicon):
        self.place = words.place

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        out = tuple(self.place[t] for w in words_of(stretch) for t in terms_of(w) if t in self.place)
        if len(self) < CACHED_WORDS and len(stretch) < 64:
            self[stretch] = out
        return out


def lexicon(terms: list[str], df: list[int], ratio: list[float], n: int) -> Lexicon:
    weight = np.log((1 + n) / (1 + np.array(df, np.float64))) * np.log1p(np.array(ratio, np.float64))
    keep = np.nonzero(weight > 0)[0]
    names = [terms[i] for i in keep.tolist()]
    digest = hashlib.md5(("\n".join(names) + str(weight.sum())).encode()).hexdigest()
    return Lexicon({t: i for i, t in enumerate(names)}, weight[keep], digest)


@dataclass
class Index:
    """Block-max inverted index of the labelled examples."""

    lexicon: Lexicon
    ids: np.ndarray  # of the examples, in index order
    labels: np.ndarray
    places: np.ndarray  # postings, term by term and in rising place
    weights: np.ndarray
    starts: np.ndarray  # term x (blocks + 1): where a term's postings of a block begin
    maxima: np.ndarray  # term x block
    priors: np.ndarray  # weight of a vote by label
    steps: tuple[np.ndarray, np.ndarray]  # isotonic: raw vote from -> probability
    blank: float  # probability without any neighbour

    def _read(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, contribution, index of the term) of the postings in some blocks."""
        a, b = self.starts[terms[:, None], blocks].ravel(), self.starts[terms[:, None], blocks + 1].ravel()
        n = b - a
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        which //= len(blocks)
        return self.places[at], self.weights[at] * weights[which], which

    def _read_all(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, contribution) of the postings in all blocks: a term's stand side by side."""
        spans = list(zip(self.starts[terms, 0].tolist(), self.starts[terms, -1].tolist(), strict=True))
        n = [b - a for a, b in spans]
        return np.concatenate([self.places[a:b] for a, b in spans]), np.concatenate([self.weights[a:b] for a, b in spans]) * np.repeat(weights, n)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1, explain: bool = False) -> list[tuple[float, int, int]]:
        """(cosine, place, strongest shared term or -1) of the k nearest above zero, ties to the earlier one."""
        if not len(terms) or not len(self.ids):
            return []
        bound = weights @ self.maxima[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        place, part, _ = self._read(terms, weights, order[:FIRST_BLOCKS])
        total = np.bincount(place, part, len(self.ids))
        rest = order[FIRST_BLOCKS:]
        if len(rest):
            if 0 <= without < len(total):
                total[without] = 0
            kth = np.partition(total, len(total) - k)[len(total) - k] if len(total) > k else 0.0
            rest = rest[bound[rest] >= kth - 1e-9]
            if 2 * len(rest) > len(self.maxima[0]):  # few blocks left out: reading everything in a row is quicker
                total = np.bincount(*self._read_all(terms, weights), len(self.ids))
            elif len(rest):
                place, part, _ = self._read(terms, weights, rest)
                total += np.bincount(place, part, len(total))
        if 0 <= without < len(total):
            total[without] = 0
        kth = np.partition(total, len(total) - k)[len(total) - k] if len(total) > k else 0.0
        some = np.nonzero(total >= max(kth - 1e-11, 1e-300))[0]
        cosines = np.round(total[some], 12)
        order = np.lexsort((some, -cosines))[:k]
        best, cosines = some[order][cosines[order] > 0], cosines[order][cosines[order] > 0]
        why = dict.fromkeys(best.tolist(), -1)
        if explain and len(best):
            place, part, which = self._read(terms, weights, np.unique(best[:3] // BLOCK))
            for i in best[:3].tolist():
                why[i] = max((float(w), int(terms[t])) for w, t in zip(part[place == i], which[place == i], strict=True))[1]
        return [(c, i, why[i]) for c, i in zip(cosines.tolist(), best.tolist(), strict=True)]

    def vote(self, near: list[tuple[float, int, int]]) -> float:
        """Share of the toxic label among the neighbours, weighted by one over distance."""
        total = toxic = 0.0
        for cosine, i, _ in near:
            w = self.priors[self.labels[i]] * cosine / (1.05 - min(1.0, cosine))
            total += w
            toxic += w * self.labels[i]
        return toxic / total

    def probability(self, near: list[tuple[float, int, int]]) -> float:
        if not near:
            return self.blank
        at = np.searchsorted(self.steps[0], self.vote(near), side="right") - 1
        return float(self.steps[1][max(0, at)])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (start of step, value), smoothed by half a row of either label."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # start, sum of labels, weight
    for i in order.tolist():
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += w[i] * y[i]
            pools[-1][2] += w[i]
        else:
            pools.append([x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1.0) for p in pools])


def build_index(examples: list[tuple[int, int, np.ndarray, np.ndarray]], words: Lexicon, totals: tuple[int, int]) -> Index:
    """The uncalibrated index of (id, label, terms, counts); ``totals`` are the rows of either label they stand for.

    Examples stand in the order of label and heaviest term, which keeps like ones in one block and its maxima tight.
    """
    vectors = [(i, y, t, words.vector(t, c)) for i, y, t, c in examples]
    sampled = [sum(y == c for _, y, _, _ in vectors) for c in (0, 1)]
    priors = np.array([totals[c] / max(1, sampled[c]) for c in (0, 1)])
    empty = [sum(y == c and not len(t) for _, y, t, _ in vectors) * priors[c] for c in (0, 1)]
    blank = (empty[1] + 0.5) / (empty[0] + empty[1] + 5.0) if vectors else 0.05
    held = sorted((x for x in vectors if len(x[2])), key=lambda x: (x[1], int(x[2][x[3].argmax()]), x[0]))
    terms = np.concatenate([x[2] for x in held] or [np.zeros(0, np.int64)])
    weights = np.concatenate([x[3] for x in held] or [np.zeros(0)])
    places = np.repeat(np.arange(len(held)), [len(x[2]) for x in held])
    order = np.lexsort((places, terms))
    terms, weights, places = terms[order], weights[order], places[order].astype(np.int32)
    blocks = -(-len(held) // BLOCK)
    cell = terms * max(1, blocks) + places // BLOCK
    ends = np.cumsum(np.bincount(cell, minlength=len(words.place) * blocks), dtype=np.int32).reshape(len(words.place), blocks)
    starts = np.zeros((len(words.place), blocks + 1), np.int32)
    starts[:, 1:], starts[1:, 0] = ends, ends[:-1, -1] if blocks else 0
    maxima = np.zeros(ends.size, np.float32)
    np.maximum.at(maxima, cell, (weights * (1 + 1e-6)).astype(np.float32))  # no bound is below its weights
    ids, labels = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
    return Index(words, ids, labels, places, weights, starts, maxima.reshape(ends.shape), priors, (np.zeros(1), np.full(1, blank)), blank)


_KNOWN: dict[str, Known] = {}


def known_words(words: Lexicon) -> Known:
    """Of one lexicon at a time; outlives the task in a reused worker."""
    if words.digest not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[words.digest] = Known(words)
    return _KNOWN[words.digest]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Index:
    """Learn from ``labels(doc_id, toxic)`` rows outside the held-out fold.

    Labels that are null are left out, conflicting ones count as toxic. Near
    copies of one example (equal sketches) are one observation. Without any
    labelled text the index is empty and every score the same low value.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = first(1, max_toxic).unionByName(first(0, max_clean)).select("_id", "toxic")
    # At most max_toxic + max_clean rows, so the broadcast is bounded.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    texts = materialise(texts.withColumn("key", F.pandas_udf(lambda ts: ts.map(sketch, na_action=None), "string")("text")))
    alone = texts.groupBy("key", "toxic").agg(F.min("_id").alias("_id")).select("_id")
    texts = materialise(texts.join(F.broadcast(alone.distinct()), "_id").dropDuplicates(["_id"]).select("_id", "text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counted = texts.select("text", "toxic").mapInPandas(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.where(F.col("toxic") + F.col("clean") >= MIN_EXAMPLES).withColumn("g", _likelihood_ratio(F.col("toxic"), F.col("clean"), max(1, n1), max(1, n0)))
    odds = F.abs(F.log((F.col("toxic") + 0.5) * (n0 - F.col("clean") + 0.5) / ((F.col("clean") + 0.5) * (n1 - F.col("toxic") + 0.5))))
    plain = (F.col("toxic") + F.col("clean") > COMMON * (n1 + n0)) & (odds < math.log(TELLING))
    told = counted.where((F.col("g") > SIGNIFICANT) & ~plain).select("term", (F.col("toxic") + F.col("clean")).alias("df"), "g").toPandas().sort_values("term")
    words = lexicon(told["term"].tolist(), told["df"].tolist(), told["g"].tolist(), n1 + n0)
    shared = spark.sparkContext.broadcast(words)
    number = lambda raw: np.frombuffer(raw, "<i4").astype(np.int64)
    rows = [(r["_id"], r["toxic"], number(r["terms"]), number(r["counts"])) for r in texts.mapInPandas(_vectors(shared), VECTOR).toLocalIterator()]
    index = build_index(sorted(rows, key=lambda r: r[0]), words, (totals.get(0, 0), totals.get(1, 0)))
    return calibrate(texts, index)


def _vectors(words):
    """Examples as places and numbers of their terms: what reaches the driver has no text."""

    def run(batches):
        held = words.value
        for batch in batches:
            got = [held.counts(t, known_words(held)) for t in batch["text"]]
            yield pd.DataFrame({"_id": batch["_id"], "toxic": batch["toxic"], "terms": [t.astype("<i4").tobytes() for t, _ in got], "counts": [c.astype("<i4").tobytes() for _, c in got]})

    return run


def _votes(index):
    """(vote, label) of every example among the others; nothing for one without neighbours."""

    def run(batches):
        held = index.value
        order = np.argsort(held.ids)
        for batch in batches:
            rows = []
            for i, text in zip(batch["_id"], batch["text"], strict=True):
                terms, counts = held.lexicon.counts(text, known_words(held.lexicon))
                if len(terms):
                    at = int(order[np.searchsorted(held.ids, i, sorter=order)])
                    near = held.nearest(terms, held.lexicon.vector(terms, counts), without=at)
                    rows += [(held.vote(near), int(held.labels[at]))] if near else []
            yield pd.DataFrame(rows, columns=["vote", "label"]).astype({"vote": "float64", "label": "int32"})

    return run


def calibrate(texts: DataFrame, index: Index) -> Index:
    """The index with its isotonic steps; the executors cast the leave-one-out votes of ``texts(_id, text)``."""
    votes = texts.select("_id", "text").mapInPandas(_votes(texts.sparkSession.sparkContext.broadcast(index)), "vote double, label int").toPandas().sort_values(["vote", "label"])
    if len(votes):
        y = votes["label"].to_numpy()
        index.steps = isotonic(votes["vote"].to_numpy(), y, index.priors[y])
    return index


def scorer(spark: SparkSession, index: Index, explain: bool = True):
    """Pandas UDF: text -> struct of score and evidence: the nearest examples, with the strongest shared term where the text is rejected."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(EVIDENCE)
    def score(batches: pd.Series) -> pd.DataFrame:
        held = shared.value
        known, names = known_words(held.lexicon), list(held.lexicon.place)
        out = []
        for text in batches:
            terms, counts = held.lexicon.counts(text, known)
            weights = held.lexicon.vector(terms, counts)
            near = held.nearest(terms, weights)
            probability = held.probability(near)
            if explain and probability >= THRESHOLD:
                near = held.nearest(terms, weights, explain=True)
            told = [{"doc_id": int(held.ids[i]), "label": int(held.labels[i]), "cosine": cosine, "term": names[t] if t >= 0 else None} for cosine, i, t in near[:3]] if explain else []
            out.append((probability, told))
        return pd.DataFrame(out, columns=["score", "evidence"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``.

    Null and empty texts have no term and take the blank probability; repeated
    rows stay; other columns are not read; an empty table gives no rows.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, id_col, text_col, **limits))
    out = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("s"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"), (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows predicted toxic; the same columns."""
    score = scorer(docs.sparkSession, fit(docs, labels, text_col=text_col, **options), explain=False)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(F.col(text_col))["score"].alias("score"))
    return held.where(F.col("score") < THRESHOLD).select("row.*")
