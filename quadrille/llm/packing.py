"""Packing by mixture-controlled deficit round-robin.

Documents are tokenised once (ids kept as two bytes each in the shared
folder). Every source is a queue in hash order, and its target is its share of all
tokens, the only mix that uses every token once. A window gives each queue its
target as credit; a queue serves the whole tokens of its deficit counter, cutting
documents where the credit ends, and what is left over, under one token, is carried into
the next window. So every window of every partition holds the target mix to a token.

Partitions take equal stretches of windows. Where a queue stands when a partition
begins follows from its target alone (the whole tokens of all credit so far), so a
partition starts with the deficits that the one before it ends with and needs to know
nothing else of it. Documents find their partitions by the place of their hash
bucket in their queue: buckets are sums over sources and stretches of the hash, and one
that lies over a border goes to both sides, which each cut out their own part. Sources of under
LEAST tokens a window share one queue, so their pieces stay readable. The tail is cut into sequences of
powers of two.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise

WINDOW, LEAST, END_ID, TOKENS_PER_PARTITION, CACHED_CHUNKS = 2048, 16, 1, 3_000_000, 800_000
#: Hash buckets a partition; tokens of a document that travel as one row; rows of the bucket table that may be broadcast.
BUCKETS, ROW_TOKENS, BROADCAST_ROWS = 8, 65_536, 100_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LATIN_END = 0x250


class ChunkIds(dict):
    """Little-endian 16-bit ids of white-space-free chunks, made by the tokenizer itself.

    The tokenizer's pattern never joins across a space or line feed, so a text's ids
    are those of its chunks in order. A closing comma or full stop after letters is
    a token group of its own there, which lets most chunks share entries. Once
    full the table stays as it is; results never depend on it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.size = Tokenizer.from_file(path), 0
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.merges = self.tokenizer.model.tokenize
        self.letters = {c: spelt(chr(c))[0][0] for c in range(LATIN_END) if chr(c).isalpha()}

    def __missing__(self, chunk: str) -> bytes:
        # Lower-casing may leave a mark behind a letter, which joins what follows: such chunks go as a whole.
        word = chunk[:-1] if len(chunk) > 1 and chunk[-1] in ",." else chunk
        low = word.lower()
        if word.isalpha() and (word.isascii() or ord(max(word)) < LATIN_END and low.isalpha() and ord(max(low)) < LATIN_END):
            # Letter groups that NFC leaves alone: straight to the merges.
            if word != chunk:
                out = self[low] + self[chunk[-1]]
            elif low != chunk:
                return self[low]
            else:
                out = array("H", [t.id for t in self.merges(low.translate(self.letters))]).tobytes()
        else:
            out = array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if self.size < CACHED_CHUNKS and len(chunk) < 64:
            self.size += 1
            self[chunk] = out
        return out

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


_TABLES: dict[str, ChunkIds] = {}


def _table(path: str) -> ChunkIds:
    """Of one vocabulary at a time; outlives the task in a reused worker."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = ChunkIds(path)
    return _TABLES[path]


def _tokenise(path: str):
    def run(batches):
        ids = _table(path).ids
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            packed = [ids(t) + end for t in batch.column("text").to_pylist()]
            made = [pa.array([len(p) // 2 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *made], ["doc_id", "source", "n", "ids"])

    return run


def _sequences(total: int, window: int) -> tuple[int, list[tuple[int, int]]]:
    """Start of the tail and its (start, length) sequences: the powers of two in what is left over."""
    at = total - total % window
    tail, start = [], at
    for bit in reversed(range(window.bit_length())):
        if (total - at) >> bit & 1:
            tail.append((start, 1 << bit))
            start += 1 << bit
    return at, tail


def round_robin(sizes: np.ndarray, steps: np.ndarray, deficit: np.ndarray) -> np.ndarray:
    """Tokens that every queue has served behind each of ``steps``, a row per step.

    ``steps`` are the lengths of windows in turn, together all tokens of the queues,
    ``sizes`` those of each, ``deficit`` what each brings along. A window's credit is
    divided by size; queues serve the whole tokens of their counters, and what that leaves
    of the window goes one by one to the largest rests.
    """
    share, served, have = sizes / max(1, sizes.sum()), [], np.zeros(len(sizes), np.int64)
    owed = deficit.astype(float)
    for step in steps:
        owed = owed + step * share
        give = np.minimum(np.maximum(np.floor(owed + 1e-9), 0).astype(np.int64), sizes - have)
        short = int(step - give.sum())
        while short:
            rest = np.where(sizes - have - give > 0, owed - give, -np.inf) if short > 0 else np.where(give > 0, give - owed, -np.inf)
            some = np.argsort(-rest, kind="stable")[: min(abs(short), int((rest > -np.inf).sum()))]
            give[some] += 1 if short > 0 else -1
            short = int(step - give.sum())
        owed, have = owed - give, have + give
        served.append(have)
    return np.array(served, np.int64).reshape(len(steps), len(sizes))


def _queues(docs: pd.DataFrame, known: pd.DataFrame, window: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The parts of documents that lie in a partition, by queue and in its order, and the deficits of the queues."""
    docs = docs.sort_values(["source", "bucket", "u", "no_id", "doc_id", "first", "n"], na_position="last", kind="stable").reset_index(drop=True)
    known = known.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
    name = lambda c: c.where(c.notna(), None)
    place = {s: i for i, s in enumerate(name(known["source"]))}
    # A bucket of a small queue may lie around a partition that serves none of it.
    docs = docs[[s in place for s in name(docs["source"])]].reset_index(drop=True)
    own = np.array([place[s] for s in name(docs["source"])], np.int64)
    n, key = docs["n"].to_numpy(), list(zip(own, docs["bucket"]))
    head = np.array([i == 0 or key[i] != key[i - 1] for i in range(len(key))])
    run = np.cumsum(n) - n
    at = docs["begin"].to_numpy() + run - np.repeat(run[head], np.diff(np.append(np.flatnonzero(head), len(n))))
    low, high = known["low"].to_numpy()[own], known["high"].to_numpy()[own]
    docs["cut"], docs["take"] = np.maximum(low - at, 0), np.minimum(high, at + n) - np.maximum(low, at)
    docs["queue"] = own
    docs = docs[docs["take"] > 0]
    size = (known["high"] - known["low"]).to_numpy()
    rare = size * window < LEAST * size.sum()
    if rare.any() and not rare.all() and size[rare].sum() * window < size.sum():
        rare[np.flatnonzero(~rare)[size[~rare].argmin()]] = True
    queue = np.where(rare, len(size), np.arange(len(size)))
    docs["queue"] = queue[docs["queue"].to_numpy()]
    order = ["queue", "u", "no_id", "doc_id", "first", "n"]
    docs = docs[docs["queue"] < len(size)]._append(docs[docs["queue"] == len(size)].sort_values(order, kind="stable")) if rare.any() else docs
    names = np.unique(docs["queue"])
    docs["queue"] = np.searchsorted(names, docs["queue"])
    deficit = known["deficit"].to_numpy()
    return docs.reset_index(drop=True), np.array([deficit[queue == q].sum() for q in names])


def _pack(window: int):
    def run(key, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        base, total = int(known["base"].iloc[0]), int(known["total"].iloc[0])
        docs, deficit = _queues(docs, known, window)
        take, cut = docs["take"].to_numpy(), docs["cut"].to_numpy()
        sizes = np.bincount(docs["queue"], take, len(deficit)).astype(np.int64)
        mine = int(sizes.sum())
        tail_at, tail = _sequences(total, window)
        starts = np.concatenate([np.arange(base - base % window, min(tail_at, base + mine), window), np.array([a for a, m in tail if a < base + mine and a + m > base], np.int64)]).astype(np.int64)
        starts = starts[starts + window > base]
        names = np.where(starts < tail_at, starts // window, tail_at // window + np.searchsorted(np.array([a for a, _ in tail] or [0]), starts))
        ends = np.append(starts[1:], base + mine)
        first = np.maximum(starts, base)
        served = round_robin(sizes, ends - first, deficit)
        # Pieces end where documents do and where a window's credit is used up; everything below is in the order of the queues.
        queue_at = np.cumsum(sizes) - sizes
        doc_at = np.cumsum(take) - take
        cuts = np.unique(np.concatenate([doc_at, (served + queue_at).ravel()]))
        begin, stop = cuts[:-1], cuts[1:]
        if not len(doc_at):
            begin = stop = np.zeros(0, np.int64)
        doc = np.searchsorted(doc_at, begin, "right") - 1
        queue = docs["queue"].to_numpy()[doc]
        at_window = np.concatenate([np.searchsorted(served[:, q] + queue_at[q], begin[queue == q], "right") for q in range(len(sizes))] or [np.zeros(0, int)])
        before = np.concatenate([np.zeros((1, len(sizes)), np.int64), served])
        given = np.diff(before, axis=0)
        offset = (np.cumsum(given, axis=1) - given)[at_window, queue] + begin - queue_at[queue] - before[at_window, queue] + (first - starts)[at_window]
        packed = [memoryview(x)[2 * c : 2 * (c + t)] for x, c, t in zip(docs["ids"], cut, take, strict=True)]
        wide = memoryview(np.frombuffer(b"".join(packed), "<u2").astype("<u4").tobytes())
        sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        start = docs["first"].to_numpy()[doc] + cut[doc] + begin - doc_at[doc]
        return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy()[doc], "start": start, "length": stop - begin, "ids_crc32": np.array(sums, np.int64), "doc_tokens": docs["size"].to_numpy()[doc], "sequence_id": names[at_window], "offset": offset, "no_id": docs["no_id"].to_numpy()[doc]})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, partition_tokens: int = TOKENS_PER_PARTITION) -> DataFrame:
    """Pieces of all documents, laid gapless into sequences of ``window`` tokens.

    Every document is its ids and then id 1, so null and empty texts are one
    id. A null source is a queue of its own; repeated rows each keep their own
    pieces, and so do null ids, which are spread by their place in the input, so
    reruns may lay them otherwise; very long texts span windows. An empty table gives
    no pieces; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    tokens = materialise(src.mapInArrow(_tokenise(tokenizer_path), "doc_id long, source string, n long, ids binary"))
    # Pandas has no null integers, so a null id travels as a flag. Rows are at most ROW_TOKENS long.
    part = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - 1).cast("long"), F.lit(ROW_TOKENS).cast("long"))).alias("first")
    rows = tokens.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", F.col("n").alias("size"), "ids", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("place"), part)
    u = F.xxhash64("doc_id", F.xxhash64("ids"), "first", "place")
    rows = rows.select("doc_id", "no_id", "source", "size", "first", F.least(F.col("size") - F.col("first"), F.lit(ROW_TOKENS)).alias("n"), u.alias("u"), F.when(F.col("size") <= ROW_TOKENS, F.col("ids")).otherwise(F.substring("ids", (2 * F.col("first") + 1).cast("int"), F.lit(2 * ROW_TOKENS))).alias("ids"))
    sizes = materialise(tokens.groupBy("source").agg(F.sum("n").alias("queue")))
    total = sizes.agg(F.coalesce(F.sum("queue"), F.lit(0))).first()[0]
    stretch = window * max(1, -(-partition_tokens // window))
    parts = max(1, -(-total // stretch))
    # A bucket is a stretch of the hash, so buckets in order are documents in order.
    cells = BUCKETS * parts
    bucket = F.expr(f"CAST((CAST(shiftrightunsigned(u, 16) AS DECIMAL(20,0)) * {cells}) div {1 << 48} AS LONG)")
    rows = rows.withColumn("bucket", bucket)
    spots = _spots(rows, sizes, total, stretch, parts)
    held = spots.count()
    spots = F.broadcast(spots) if held <= BROADCAST_ROWS else spots
    dealt = rows.withColumn("s", _name(F.col("source"))).join(spots, ["s", "bucket"]).withColumn("p", F.explode(F.sequence("from", "to"))).drop("s", "from", "to")
    known = _begins(sizes, total, stretch, parts)
    pieces = dealt.groupBy("p").cogroup(known.groupBy("p")).applyInPandas(_pack(window), PIECES + ", no_id boolean")
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def _name(source: Column) -> Column:
    """A source as a key that is not null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def _spots(rows: DataFrame, sizes: DataFrame, total: int, stretch: int, parts: int) -> DataFrame:
    """(s, bucket, begin, from, to): where every bucket begins in its queue, and the partitions it lies in. One row a source and bucket."""
    cells = rows.groupBy("source", "bucket").agg(F.sum("n").alias("n")).join(sizes.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other"))).drop("other")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    cells = cells.withColumn("stop", upto).withColumn("begin", F.col("stop") - F.col("n"))
    # The first partition whose credit reaches beyond a place.
    over = lambda x: F.least(F.lit(parts - 1).cast("long"), F.expr(f"((CAST({x} + 1 AS DECIMAL(19,0)) * {total}BD - 1) div (CAST(queue AS DECIMAL(19,0)) * {stretch}BD))"))
    return materialise(cells.select(_name(F.col("source")).alias("s"), "bucket", "begin", over("begin").alias("from"), over("(stop - 1)").alias("to")))


def _begins(sizes: DataFrame, total: int, stretch: int, parts: int) -> DataFrame:
    """(p, source, low, high, deficit, base, total): the stretch of every queue that a partition serves, what it is owed at the start, and where the partition begins."""
    credit = lambda p: f"CAST({p} AS DECIMAL(19,0)) * {stretch}BD * CAST(queue AS DECIMAL(19,0))"
    whole = lambda p: F.least(F.col("queue"), F.expr(f"({credit(p)}) div {max(1, total)}BD"))
    rows = sizes.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    rows = rows.select("p", "source", whole("p").alias("low"), whole("(p + 1)").alias("high"), F.expr(f"CAST(({credit('p')}) % {max(1, total)}BD AS DOUBLE) / {max(1, total)}").alias("deficit"))
    base = rows.groupBy("p").agg(F.sum("low").alias("base")).withColumn("total", F.lit(total).cast("long"))
    return rows.where("low < high").join(base, "p")
