"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut in two halves, each half quantised by its own k-means
(fitted on at most ``FIT_ROWS`` rows in hash order, with a codebook that grows
with the root of the table up to ``MAX_CENTRES``); a cell is a pair of
centroids. A query walks the centroid pairs by rising summed distance with a
heap until the cells it has met hold a certain share of all entries, and the
entries of those cells are reranked by their exact cosine in double precision.

The share is measured, not set: for ``PROBES`` rows of the fitted sample the true
neighbours within it are found by brute force, and the share is what the walk
needs to meet ``TARGET`` of them. Vectors that cluster need little of the table;
vectors without any structure need much, as every index does.

Equal vectors are one entry with their ``k + 1`` smallest ids, which is all
that a top-k with ties to the smaller id can use. First-half centroids are put
together into groups of bounded size, a larger one is split into several blocks;
a task meets one block of entries and one of queries, so a query's vector
travels once a block it has cells in.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise

FIT_ROWS, ROUNDS, K, MAX_CENTRES = 20_000, 12, 5, 512
PROBES, TARGET = 200, 0.96
MIN_BLOCK, MAX_BLOCK, BLOCKS, QUERY_BLOCK = 2048, 32_768, 16, 4096
OUT = "query_id long, rank int, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids from a seeded spread start; at most one per distinct row."""
    x = np.unique(x, axis=0)
    k, rng = min(k, len(x)), np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(x, centres).argmin(1)


def walk(near: np.ndarray, far: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Filled cells by rising ``near[i] + far[j]`` until they hold ``wanted`` entries.

    The heap holds one cell of each first centroid met so far, its next one by
    the second distance; a first centroid comes in once the one before it was popped.
    """
    a, b = np.argsort(near, kind="stable").tolist(), np.argsort(far, kind="stable").tolist()
    first, second = near[a].tolist(), far[b].tolist()
    rows = {0: counts[a[0]].tolist()}
    heap, out, held = [(first[0] + second[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = rows[i][b[j]]
        if n:
            out.append((a[i], b[j]))
            held += n
        if j == 0 and i + 1 < len(a):
            rows[i + 1] = counts[a[i + 1]].tolist()
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
    return out


def scaled(vectors: pd.Series) -> np.ndarray:
    """The vectors in double precision, each times a power of two that brings its largest component near one."""
    x = np.array(vectors.tolist(), np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(vectors: pd.Series) -> np.ndarray:
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cells(centres: tuple[np.ndarray, np.ndarray]):
    def run(batches):
        for batch in batches:
            if len(batch):
                u = _unit(batch["v"])
                h = u.shape[1] // 2
                yield batch.assign(i=nearest_centre(u[:, :h], centres[0]).astype(np.int32), j=nearest_centre(u[:, h:], centres[1]).astype(np.int32))

    return run


def needed_share(unit: np.ndarray, centres: tuple[np.ndarray, np.ndarray], k: int = K, probes: int = PROBES, target: float = TARGET) -> float:
    """The share of the entries that the walk must meet to find ``target`` of the probes' true neighbours."""
    h = unit.shape[1] // 2
    i, j = nearest_centre(unit[:, :h], centres[0]), nearest_centre(unit[:, h:], centres[1])
    counts = np.zeros((len(centres[0]), len(centres[1])), np.int64)
    np.add.at(counts, (i, j), 1)
    needed = []
    for p in np.unique(np.linspace(0, len(unit) - 1, probes).astype(int)).tolist():
        cosine = unit @ unit[p]
        cosine[p] = -np.inf
        near = np.argpartition(-cosine, min(k, len(unit) - 1) - 1)[:k] if len(unit) > 1 else []
        cells = (squared(unit[p : p + 1, :h], centres[0])[0][:, None] + squared(unit[p : p + 1, h:], centres[1])[0]).ravel()
        order = np.argsort(cells, kind="stable")
        met = np.empty(len(order))
        met[order] = counts.ravel()[order].cumsum()
        needed += [met[i[x] * len(centres[1]) + j[x]] / len(unit) for x in near if x != p]
    return float(np.quantile(needed, target)) if needed else 1.0


def _walks(centres: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: int, group: np.ndarray):
    """(query_id, v, g, cells): the cells to visit in each group of first centroids."""

    def run(batches):
        for batch in batches:
            rows = []
            if len(batch):
                u = _unit(batch["v"])
                h, width = u.shape[1] // 2, len(centres[1])
                near, far = squared(u[:, :h], centres[0]), squared(u[:, h:], centres[1])
                for q, v, a, b in zip(batch["query_id"], batch["v"], near, far, strict=True):
                    under: dict[int, list[int]] = {}
                    for i, j in walk(a, b, counts, wanted):
                        under.setdefault(int(group[i]), []).append(i * width + j)
                    rows += [(q, v, g, cells) for g, cells in under.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["query_id", "v", "g", "cells"])

    return run


def _rerank(k: int, cells: int, width: int):
    """The k best entries of a block for each query of a block, by exact cosine on the original vectors."""

    def run(_, entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(entries) and len(queries):
            x = scaled(entries["v"])
            u = x / np.sqrt((x * x).sum(1))[:, None]
            cell, ids = entries["i"].to_numpy() * width + entries["j"].to_numpy(), entries["ids"].tolist()
            asked, y, met = queries["query_id"].tolist(), scaled(queries["v"]), queries["cells"].tolist()
            for at in range(0, len(asked), 128):
                part = y[at : at + 128]
                rough = part @ u.T
                for q, v, visit, score in zip(asked[at : at + 128], part, met[at : at + 128], rough, strict=True):
                    open_ = np.zeros(cells, bool)
                    open_[visit] = True
                    some = np.nonzero(open_[cell])[0]
                    if len(some) > k + 1:
                        s = score[some]
                        cut = np.partition(s, len(some) - k - 1)[len(some) - k - 1]
                        some = some[s >= cut - 1e-9 * np.sqrt(v @ v)]
                    exact = [float(x[e] @ v / (np.sqrt(x[e] @ x[e]) * np.sqrt(v @ v))) for e in some.tolist()]
                    near = sorted((-s, int(i)) for s, e in zip(exact, some.tolist(), strict=True) for i in ids[e] if i != q)
                    rows += [(q, i, -s) for s, i in near[:k]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) in doubles, without null ids and vectors that are null, empty, zero or not finite."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).where(F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first.

    Queries are the rows whose id is divisible by ``every``; all usable rows are
    indexed. Ties go to the smaller id. Rows that repeat an id count once each;
    no usable rows give no result. Vectors have a cosine with those of their own
    length only, so every length is a table of its own, with its own index.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    out = spark.createDataFrame([], OUT)
    for d in lengths:
        mine = rows.where(F.size("v") == d) if len(lengths) > 1 else rows
        out = _search(mine, every, k) if d == lengths[0] else out.unionByName(_search(mine, every, k))
    return out


def _search(rows: DataFrame, every: int, k: int) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("_r", first).where(F.col("_r") <= k + 1)  # limited before the shuffle, so a common vector costs no more
    entries = materialise(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("v"), F.element_at("ids", 1)).limit(FIT_ROWS).select("v").toPandas()
    unit = _unit(sample["v"])
    half = unit.shape[1] // 2
    size = int(min(MAX_CENTRES, max(4, round(n**0.5 / 2))))
    centres = (kmeans(unit[:, :half], size) if half else np.zeros((1, 0)), kmeans(unit[:, half:], size))
    wanted = int(np.ceil(needed_share(unit, centres, k) * n))
    celled = materialise(entries.mapInPandas(_cells(centres), "v array<double>, ids array<long>, i int, j int"))
    counts = np.zeros((len(centres[0]), len(centres[1])), np.int64)
    for r in celled.groupBy("i", "j").count().toLocalIterator():  # at most MAX_CENTRES squared rows
        counts[r["i"], r["j"]] = r["count"]
    block = min(MAX_BLOCK, max(MIN_BLOCK, n // BLOCKS))
    group, blocks, held = np.zeros(len(centres[0]), np.int64), [], 0
    for i, m in enumerate(counts.sum(1).tolist()):
        if not blocks or held + m > block:
            blocks, held = [*blocks, 1], 0
        held += m
        group[i], blocks[-1] = len(blocks) - 1, max(1, -(-held // block))

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v")
    walks = materialise(asked.mapInPandas(_walks(centres, counts, wanted, group), "query_id long, v array<double>, g int, cells array<int>"))
    parts = walks.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb"))
    places = rows.sparkSession.createDataFrame([(g, b) for g, b in enumerate(blocks)], "g int, eb int")
    grid = F.broadcast(materialise(places.join(parts, "g")))  # at most a row per first centroid
    group_of = F.element_at(F.array(*[F.lit(int(g)) for g in group]), F.col("i") + 1)
    e = celled.withColumn("g", group_of).join(grid, "g").select("g", F.pmod(F.xxhash64("v"), F.col("eb")).cast("int").alias("e"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "v", "ids", "i", "j")
    w = walks.join(grid, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("eb") - 1)).alias("e"), F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("q"), "query_id", "v", "cells")
    found = e.groupBy("g", "e", "q").cogroup(w.groupBy("g", "e", "q")).applyInPandas(_rerank(k, counts.size, len(centres[1])), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, x: np.ndarray, every: int = 50, k: int = K) -> dict[int, list[int]]:
    """Exact neighbours, for recall."""
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for a in np.nonzero(ids % every == 0)[0]:
        s = np.round(u @ u[a], 12)
        order = np.lexsort((ids, -s))
        out[int(ids[a])] = [int(ids[o]) for o in order if o != a][:k]
    return out
