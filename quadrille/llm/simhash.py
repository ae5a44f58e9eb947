"""SimHash near-dedup by tiled exact comparison.

``near_dedup`` links fingerprints that differ in at most ``radius`` bits.
Fingerprints that are equal are one node. A node's *signature* is the vector
of population counts of its sixteen-bit quarters; two words that differ in at
most ``radius`` bits have signatures at most ``radius`` apart in the sum of
absolute differences. Nodes of one signature are cut into tiles of bounded
size, tile pairs whose population counts differ beyond the radius are never
formed, and the remaining pairs are compared exactly with numpy exclusive-or
and bit counts. Of the links in a tile pair only a spanning forest leaves the
task: components stay whole and the output stays linear in the tile.

``similar_dedup`` links texts by the Jaccard similarity of their word shingles.
Texts of that similarity differ by no more than its inverse in their number of
distinct shingles, so tiles are cut by that number and only neighbouring ones
meet. Within a pair, rows stand by population count and stretches whose counts
differ beyond the radius are skipped; the rest is compared exactly, with a
radius wide enough for the similarity, and every hit is confirmed by a sketch of
``SLOTS`` one-byte minima, which keeps unlike texts apart that a wide radius lets
through.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.components import connected_components
from quadrille.functions.local_components import label
from quadrille.functions.shared import materialise
from quadrille.functions.skew import join_facts

SEED, SHINGLE, RADIUS, TILE, CHUNK = 42, 3, 2, 16_384, 256
# Of similar_dedup: words a shingle, the similarity, the radius that 99 % of the pairs of that similarity keep,
# and the share of equal minima that confirms a pair (one deviation under the similarity).
SIMILAR_SHINGLE, SIMILARITY, SIMILAR_RADIUS, SLOTS, CONFIRMED = 5, 0.8, 16, 64, 0.75
SIMILAR_TILE, BUCKETS = 32_768, 4
PROFILE = "fp long, n long, sketch binary"


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle in order; no words give none.

    ``bytes.lower`` and ``bytes.split`` know just A-Z and the six white-space
    bytes, which is what the definition asks for.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The 64-bit fingerprint of hashes as a signed integer: bits set in over half of them; of none zero."""
    n, votes = len(h), np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):  # bounded scratch for very long texts
        votes += np.unpackbits(h[part : part + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def minima(h: np.ndarray) -> np.ndarray:
    """One byte per slot of the hashes: that of the slot's smallest hash, never 0; 0 for an empty slot."""
    keys = np.sort((h & np.uint64(SLOTS - 1)) << np.uint64(58) | h >> np.uint64(6))
    at = np.searchsorted(keys, np.arange(SLOTS, dtype=np.uint64) << np.uint64(58))
    out, filled = np.zeros(SLOTS, np.uint8), np.diff(np.append(at, len(keys))) > 0
    out[filled] = keys[at[filled]] % np.uint64(255) + np.uint64(1)
    return out


def profiles(shingle: int):
    """Pandas UDF: fingerprint, number and sketch of a text's distinct shingles."""

    @F.pandas_udf(PROFILE)
    def run(texts: pd.Series) -> pd.DataFrame:
        hs = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        return pd.DataFrame({"fp": [majority(h) for h in hs], "n": [len(h) for h in hs], "sketch": [minima(h).tobytes() for h in hs]})

    return run


def signature(fp: Column) -> Column:
    """Population counts of the four quarters, packed in base 32."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)))
    return sum((quarter(i) * F.lit(32**i) for i in range(1, 4)), quarter(0)).cast("int")


def neighbour_offsets(radius: int = RADIUS) -> list[int]:
    """Packed signature differences within the radius, one of each opposite pair.

    Packing keeps quarters of at most 16 apart in base 32, so an offset that
    leaves the range reaches no signature.
    """
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return sorted({sum(x * 32**i for i, x in enumerate(d)) for d in steps if d >= (0, 0, 0, 0)})


def forest_of_links(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two arrays of fingerprints, compared exactly."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept, left, right = [], a.view(np.uint64), b.view(np.uint64)
    for at, to in itertools.product(range(0, len(left), CHUNK), range(0, len(right), 16 * CHUNK)):  # scratch that fits a cache
        near = np.bitwise_count(left[at : at + CHUNK, None] ^ right[None, to : to + 16 * CHUNK]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = int(a[at + i]), int(b[to + j])
            if x != y and (p := root(x)) != (q := root(y)):
                parent[p] = q
                kept.append((x, y))
    return kept


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sig": rows["sig"].iloc[:1], "part": rows["part"].iloc[:1], "packed": [rows["fp"].to_numpy(np.int64).tobytes()]})


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            for p, q in zip(batch["packed"], batch["other"], strict=True):
                links = forest_of_links(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64), radius)
                if links:
                    yield pd.DataFrame(links, columns=["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the distinct values of ``fps(fp)`` into their components."""
    nodes = materialise(fps.distinct().withColumn("sig", signature(F.col("fp"))))
    counts = nodes.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"))  # 17^4 rows at most
    dealt = nodes.join(F.broadcast(counts), "sig").select("sig", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), "fp")
    tiles = materialise(dealt.groupBy("sig", "part").applyInPandas(_pack, "sig int, part int, packed binary"))
    steps = F.explode(F.array(*[F.lit(x) for x in neighbour_offsets(radius)]))
    left = tiles.select("sig", "part", "packed", steps.alias("step")).withColumn("at", F.col("sig") + F.col("step"))
    right = tiles.select(F.col("sig").alias("at"), F.col("part").alias("other_part"), F.col("packed").alias("other"))
    pairs = left.join(right, "at").where("step <> 0 OR part <= other_part")
    spread = pairs.select("packed", "other").repartition(max(8, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInPandas(_compare(radius), "a long, b long")


def near_dedup(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most
    ``radius`` differing bits, itself included; null ids count as largest. Null
    and empty texts have fingerprint zero, which links like any other. Repeated
    rows stay; an empty table gives an empty result; other columns are not read.
    """
    mark = F.pandas_udf(lambda texts: pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64"), "long")
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), mark(F.col(text_col)).alias("fp")))
    links = near_links(rows.select("fp"), radius)
    placed = _placed(rows, "fp", links)
    return join_facts(rows, placed.select("fp", "n_rows", "component_id"), "fp", "n_rows", rows.count()).drop("n_rows")


def _placed(rows: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """(node, n_rows, component, component_id): every node's component, and the smallest id in it."""
    smallest = rows.groupBy(node).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_rows"))
    labels = connected_components(links, "a", "b")  # linked nodes only
    placed = smallest.join(labels.select(F.col("node").alias(node), "component"), node, "left").withColumn("component", F.coalesce("component", node))
    placed = materialise(placed)
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    return materialise(join_facts(placed, lows, "component", "n_nodes", placed.count()).drop("low", "n_nodes"))


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """A tile in the order of population counts: ids, fingerprints and sketches as bytes."""
    fp = rows["fp"].to_numpy(np.int64)
    order = np.argsort(np.bitwise_count(fp.view(np.uint64)), kind="stable")
    packed = rows["node"].to_numpy(np.int64)[order].tobytes() + fp[order].tobytes() + b"".join(rows["sketch"].iloc[i] for i in order.tolist())
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "part": rows["part"].iloc[:1], "packed": [packed]})


def _opened(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(packed) // (16 + SLOTS)
    return np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.uint64, n, 8 * n), np.frombuffer(packed, np.uint8, SLOTS * n, 16 * n).reshape(n, SLOTS)


def similar_links(a: bytes, b: bytes, radius: int, confirmed: float) -> np.ndarray:
    """Links (node, node) that join the similar rows of two tiles into their components, a star for each."""
    (ids, x, left), (other, y, right) = _opened(a), _opened(b)
    nodes, place = np.unique(np.concatenate([ids, other]), return_inverse=True)
    root, place = np.arange(len(nodes)), place.reshape(-1)
    counts = np.bitwise_count(y)
    for at in range(0, len(x), CHUNK):
        mine = np.bitwise_count(x[at : at + CHUNK])
        first, last = np.searchsorted(counts, int(mine[0]) - radius), np.searchsorted(counts, int(mine[-1]) + radius, "right")
        for to in range(first, last, 16 * CHUNK):
            i, j = np.nonzero(np.bitwise_count(x[at : at + CHUNK, None] ^ y[None, to : min(last, to + 16 * CHUNK)]) <= radius)
            i, j = i + at, j + to
            apart = root[place[i]] != root[place[len(ids) + j]]
            i, j = i[apart], j[apart]
            for part in range(0, len(i), 1 << 16):
                p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                u, v = left[p], right[q]
                same, some = ((u == v) & (u > 0)).sum(1), ((u > 0) | (v > 0)).sum(1)
                good = same >= confirmed * np.maximum(some, 1)
                if good.any():
                    root = label(root[place[p[good]]], root[place[len(ids) + q[good]]], len(nodes))[root]
    moved = np.nonzero(root != np.arange(len(nodes)))[0]
    return np.stack([nodes[moved], nodes[root[moved]]], 1)


def _compare_similar(radius: int, confirmed: float):
    def run(batches):
        for batch in batches:
            for p, q in zip(batch["packed"], batch["other"], strict=True):
                links = similar_links(p, q, radius, confirmed)
                if len(links):
                    yield pd.DataFrame(links, columns=["a", "b"])

    return run


def similar_pairs(nodes: DataFrame, similarity: float, radius: int, tile: int = SIMILAR_TILE) -> DataFrame:
    """Links (a, b) that join the rows of ``nodes(node, fp, n, sketch)`` into their components."""
    width = math.log(1 / similarity) / BUCKETS
    nodes = nodes.withColumn("bucket", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(width)).cast("int"))
    counts = nodes.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("parts"))  # some hundred rows: n is a logarithm here
    dealt = nodes.join(F.broadcast(counts), "bucket").select("bucket", F.pmod(F.col("node"), F.col("parts")).cast("int").alias("part"), "node", "fp", "sketch")
    tiles = materialise(dealt.groupBy("bucket", "part").applyInPandas(_tile, "bucket int, part int, packed binary"))
    left = tiles.select("bucket", "part", "packed", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS))).alias("step")).withColumn("at", F.col("bucket") + F.col("step"))
    right = tiles.select(F.col("bucket").alias("at"), F.col("part").alias("other_part"), F.col("packed").alias("other"))
    pairs = left.join(right, "at").where("step > 0 OR part <= other_part")
    spread = pairs.select("packed", "other").repartition(max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInPandas(_compare_similar(radius, CONFIRMED * similarity / SIMILARITY), "a long, b long")


def similar_dedup(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component, component_id) of every row of ``docs``, for ``similarity`` of shingles and up.

    Texts of fewer words than a shingle are one shingle; null and empty texts
    have none and are alike. Of pairs at the similarity itself the sketch confirms
    about 87 %, from 0.05 above it 98 %; ``component`` is a number of the group,
    the rest is as in ``near_dedup``.
    """
    seen = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), profiles(shingle)(F.col(text_col)).alias("p"))
    rows = materialise(seen.select("doc_id", "text_hash", "p.*").withColumn("node", F.xxhash64("fp", "n", "sketch")))
    nodes = materialise(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    placed = _placed(rows, "node", similar_pairs(nodes, similarity, radius))
    return join_facts(rows, placed, "node", "n_rows", rows.count()).select("doc_id", "text_hash", "component", "component_id")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar texts, that of its smallest id; the same columns.

    A row goes by its id and text. Losers are found in narrow columns; the full
    rows meet them in one anti join, which Spark broadcasts only when their
    table is small. Of rows alike in id and text one stays.
    """
    found = similar_dedup(docs, similarity, shingle, radius, id_col, text_col)
    keys = materialise(found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    me = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("text_hash"))
    best = keys.groupBy("component").agg(F.min(me).alias("best"), F.count(F.lit(1)).alias("n_keys"))
    judged = join_facts(keys, materialise(best), "component", "n_keys", keys.count())
    judged = materialise(judged.select("doc_id", "text_hash", "n", me.eqNullSafe(F.col("best")).alias("stays")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"))
    match = lambda other: row["_id"].eqNullSafe(other["doc_id"]) & (row["_hash"] == other["text_hash"])
    losers = judged.where("NOT stays OR n > 1")
    out = row.join(losers, match(losers), "left_anti").select("row.*")
    again = judged.where("stays AND n > 1")
    if not again.isEmpty():
        out = out.unionByName(row.join(again, match(again), "left_semi").dropDuplicates(["_id", "_hash"]).select("row.*"))
    return out
