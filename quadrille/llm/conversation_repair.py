"""Repair of conversation structure: the cheapest edits that make turns alternate.

A conversation is right when its roles read ``(s?(ua)+)?``. Rows may be kept,
given another role, deleted or joined by inserted ones; a backward dynamic
programme over (row, state of that grammar) gives the cost to go, and a greedy
walk forward takes, of the edits that are tight in cost, the ASCII-least. The
next role follows from the state, so an edit's letter fixes the next state and
the greedy walk gives the least of all cheapest audits.

Rows are put in order by range, so a conversation of any length is spread over
tasks, and cut into chunks. Most conversations are one chunk and solved where
they stand. For the others a chunk is a 4 x 4 matrix of least costs between
states; those matrices, chained backward, give every chunk the cost to go at
its end, and the chunks' state maps, chained forward, give its first state, so
all chunks are solved at the same time. The audit of a conversation is one string,
which bounds the chunks that are chained together (2^31 / CHUNK_ROWS); its
digest reads the repaired chunks as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.functions.skew import HOT_KEYS, HOT_ROWS
from quadrille.llm.text import WHITESPACE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FOLLOWING = (USER, USER, ASSISTANT, USER)
KEPT_AS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
CHUNK_ROWS, CHUNK_CHARS = 4096, 4 << 20
_PAIRS = {"su", "ua", "au"}


# Damage.

def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies) after planted faults, equal rows together.

    The checksum of ``conv_id:turn`` modulo 20 says what happens to a row: 0 drops
    it (copies 0), 1 empties its text, 2 removes full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role user. Nulls count as one blank,
    but a null id or turn stays null in its column.
    """
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    told = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(told(conv), F.lit(":"), told(turn))), F.lit(20))
    text, role = told(F.col(text_col)), told(F.col(role_col))
    out = rows.select(
        conv.alias("conv_id"), F.when(case != 0, turn).alias("turn"), F.when(case == 0, "").when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case.isin(0, 1), "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(case == 0, 0).when(case == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    return out.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _seen_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` with ``earlier``: role and text stand at an earlier turn of the conversation. Frequent ones meet by a broadcast."""
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = rows.withColumn("k", key).withColumn("at", F.struct(F.col("turn").isNotNull().alias("told"), "turn"))
    facts = materialise(keyed.where("copies > 0").groupBy("k").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # At most HOT_KEYS keys are that frequent, at every size.
    often = max(HOT_ROWS, facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col("n") > often).select("k", F.col("first").alias("hot")))
    rare = facts.where(F.col("n") <= often).select(F.col("k").alias("k2"), F.col("first").alias("rare"))
    # Rows of hot keys stay apart in the second join: their key there has the turn behind it.
    met = keyed.join(hot, "k", "left").withColumn("k2", F.when(F.col("hot").isNull(), F.col("k")).otherwise(F.concat("k", F.lit("#"), F.coalesce(F.col("turn").cast("string"), F.lit("")))))
    first = F.coalesce("hot", "rare")
    return met.join(rare, "k2", "left").withColumn("earlier", first.isNotNull() & (F.col("at") > first)).drop("k", "k2", "at", "hot", "rare")


def _fault() -> Column:
    """First fault of a row: b(lank), d(uplicate), t(runcated), or - for none."""
    bare = F.btrim("text", F.lit(WHITESPACE))
    return F.when(bare == "", "b").when(F.col("earlier"), "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")


# The dynamic programme.

def _with_inserts(v: list[int]) -> list[int]:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant]


#: Cost to go behind the last row.
ENDED = _with_inserts([0, NEVER, NEVER, 0])


def _before(code: str, v: list[int]) -> list[int]:
    """Cost to go before a row, from that behind it. Codes: s, u, a, o(ther); upper case if truncated; x if it must go."""
    out = [DELETE + c for c in v]
    if code != "x":
        low = code.lower()
        more = TRUNCATED if low != code else 0
        for s in STATES:
            if low in KEPT_AS[s]:
                out[s] = min(out[s], KEEP + more + v[KEPT_AS[s][low]])
            out[s] = min(out[s], REROLE + more + v[FOLLOWING[s]])
    return _with_inserts(out)


def costs_to_go(codes: str, end: list[int]) -> list[list[int]]:
    """Cost to go by state before each row, and behind the last."""
    out = [end]
    for code in reversed(codes):
        out.append(_before(code, out[-1]))
    return out[::-1]


def walk(codes: str, togo: list[list[int]], state: int, last: bool) -> tuple[str, list, int, int]:
    """(letters, (row or None, state) of every repaired row, final state, cost) of the greedy walk; ends with inserts if ``last``."""
    letters, out, at, cost = [], [], 0, 0
    while True:
        have = togo[at][state]
        if at == len(codes):
            if not last or have == 0:
                return "".join(letters), out, state, cost
        else:
            rest, code = togo[at + 1], codes[at]
            if DELETE + rest[state] == have:
                letters.append("D")
                cost += DELETE
                at += 1
                continue
        if INSERT + togo[at][FOLLOWING[state]] == have:
            letters.append("I")
            cost += INSERT
            state = FOLLOWING[state]
            out.append((None, state))
            continue
        low = code.lower()
        more = TRUNCATED if low != code else 0
        then = KEPT_AS[state].get(low)
        if then is not None and KEEP + more + rest[then] == have:
            letters.append("K")
            cost += KEEP + more
            state = then
            out.append((at, None))
        else:
            letters.append("R")
            cost += REROLE + more
            state = FOLLOWING[state]
            out.append((at, state))
        at += 1


# Chunks.

_CHUNK = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("cid", pa.int64()), ("alone", pa.bool_()), ("initials", pa.string()), ("faults", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())])
CHUNK = "key string, conv_id long, cid long, alone boolean, initials string, faults string, roles array<string>, texts array<string>, first_turn long, last_turn long, turns long"
_PART = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("cid", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), *((c, pa.string()) for c in ("first", "last")), *((c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated", "cost")), ("audit", pa.string()), ("body", pa.string()), ("n_repaired", pa.int64())])
PART = "key string, conv_id long, cid long, first_turn long, last_turn long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, cost long, audit string, body string, n_repaired long"
_REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Chunk:
    def __init__(self, conv: int | None, cid: int):
        self.conv, self.cid, self.initials, self.faults = conv, cid, [], []
        self.roles, self.texts, self.chars = [], [], 0
        self.first_turn = self.last_turn = None
        self.turns = 0

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1

    def add(self, initial: str, fault: str, n: int = 1) -> None:
        self.initials.append(initial * n)
        self.faults.append(fault * n)

    def rows(self) -> int:
        return sum(map(len, self.faults))

    def told(self, alone: bool) -> dict:
        key = "" if self.conv is None else str(self.conv)
        return {"key": key, "conv_id": self.conv, "cid": self.cid, "alone": alone, "initials": "".join(self.initials), "faults": "".join(self.faults), "roles": self.roles, "texts": self.texts, "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns}


def _chunks(chunk_rows: int):
    """Chunks of the rows of a partition in order. ``alone``: the conversation is surely one chunk."""

    def told(rows) -> Iterator[dict]:
        part, made, now, held, first, whole = TaskContext.get().partitionId(), 0, None, 0, True, True

        def fresh(conv) -> _Chunk:
            nonlocal made
            made += 1
            return _Chunk(conv, part << 32 | made)

        for conv, turn, role, text, fault, copies in rows:
            if now is None or conv != now.conv:
                if now is not None:
                    yield now.told(whole and not first)
                    first = False
                now, held, whole = fresh(conv), 0, True
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            again = fault if fault in "bd" else "d"
            for n, mark in (min(copies, 1), fault), (max(0, copies - 1), again):
                while n:
                    if held >= chunk_rows or now.chars >= CHUNK_CHARS:
                        yield now.told(False)
                        now, held, whole = fresh(conv), 0, False
                    now.turn(turn)
                    take = min(n, chunk_rows - held)
                    now.add(initial, mark, take)
                    if mark in "t-":
                        now.roles.append(role)
                        now.texts.append(text)
                        now.chars += len(text)
                    n, held = n - take, held + take
        if now is not None:
            yield now.told(False)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "copies")), strict=True)

        yield from _batches(told(rows()), _CHUNK, lambda r: len(r["faults"]) + sum(map(len, r["texts"])))

    return run


def _batches(rows: Iterator[dict], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of bounded weight."""
    now, have = [], 0
    for r in rows:
        now.append(r)
        have += weight(r)
        if have >= 2 * CHUNK_CHARS or len(now) >= 10_000:
            yield pa.RecordBatch.from_pylist(now, schema=schema)
            now, have = [], 0
    if now:
        yield pa.RecordBatch.from_pylist(now, schema=schema)


def codes_of(initials: str, faults: str) -> str:
    return "".join("x" if f in "bd" else i.upper() if f == "t" else i for i, f in zip(initials, faults, strict=True))


def _solve(r: dict, begin: int, end: list[int], last: bool) -> dict:
    """A chunk's part of the result."""
    codes, roles = codes_of(r["initials"], r["faults"]), r["initials"]
    letters, out, _, cost = walk(codes, costs_to_go(codes, end), begin, last)
    kept, place = [], 0
    for i, c in enumerate(codes):
        kept.append(place)
        place += c != "x"
    body = [f"{ROLE[state]}:" if i is None else f"{r['roles'][kept[i]] if state is None else ROLE[state]}:{r['texts'][kept[i]]}" for i, state in out]
    return {
        **{c: r[c] for c in ("key", "conv_id", "cid", "first_turn", "last_turn", "turns")}, "first": roles[:1], "last": roles[-1:], "illegal": sum(roles[i : i + 2] not in _PAIRS for i in range(len(roles) - 1)),
        **{name: r["faults"].count(name[0]) for name in ("blank", "duplicate", "truncated")}, "cost": cost, "audit": letters, "body": "\n".join(body), "n_repaired": len(body),
    }


def _joined(parts: Iterator[dict]) -> Iterator[dict]:
    """Conversations from their parts in order, one part in memory at a time."""
    now = None
    for p in parts:
        if now is None or p["key"] != now["key"]:
            if now is not None:
                yield _finished(now)
            now = {"key": p["key"], "conv_id": p["conv_id"], "low": None, "last_turn": None, "turns": 0, "last": "", "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "begun": False}
        if p["first_turn"] is not None:
            now["turns"] += p["turns"] - (p["first_turn"] == now["last_turn"])
            now["low"] = p["first_turn"] if now["low"] is None else now["low"]
            now["last_turn"] = p["last_turn"]
        now["illegal"] += p["illegal"] + bool(now["last"] and p["first"] and now["last"] + p["first"] not in _PAIRS)
        now["last"] = p["last"] or now["last"]
        for c in ("blank", "duplicate", "truncated", "cost"):
            now[c] += p[c]
        now["audit"].append(p["audit"])
        if p["n_repaired"]:
            now["sha"].update((("\n" if now["begun"] else "") + p["body"]).encode())
            now["begun"] = True
    if now is not None:
        yield _finished(now)


def _finished(now: dict) -> dict:
    gaps = 0 if now["low"] is None else now["last_turn"] - now["low"] + 1 - now["turns"]
    return {"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}


def _solve_alone(batches):
    rows = (r for b in batches for r in b.to_pylist())
    parts = ({**_solve(r, START, ENDED, True), "key": str(i)} for i, r in enumerate(rows))
    yield from _batches(_joined(parts), _REPAIRED, lambda r: len(r["audit"]))


def _solve_open(batches):
    rows = (r for b in batches for r in b.to_pylist())
    yield from _batches((_solve(r, r["begin"], r["end"], r["is_last"]) for r in rows), _PART, lambda r: len(r["body"]))


def _join_open(batches):
    yield from _batches(_joined(r for b in batches for r in b.to_pylist()), _REPAIRED, lambda r: len(r["audit"]))


def _matrices(frames):
    """Least cost from each state before a chunk to each state behind it."""
    for frame in frames:
        rows = []
        for key, cid, initials, faults in zip(frame["key"], frame["cid"], frame["initials"], frame["faults"], strict=True):
            codes = codes_of(initials, faults)
            rows.append((key, cid, [c for e in STATES for c in _first(codes, [0 if s == e else NEVER for s in STATES])]))
        yield pd.DataFrame(rows, columns=["key", "cid", "costs"])


def _first(codes: str, v: list[int]) -> list[int]:
    if not codes:
        return v
    for code in reversed(codes):
        v = [min(c, NEVER) for c in _before(code, v)]
    return v


def _chain_back(chunks: pd.DataFrame) -> pd.DataFrame:
    """Cost to go at the end of every chunk of a conversation."""
    v, out = ENDED, []
    chunks = chunks.sort_values("cid", ascending=False)
    for i, (cid, costs) in enumerate(zip(chunks["cid"], chunks["costs"], strict=True)):
        out.append((cid, v, i == 0))
        v = [min(int(costs[4 * e + s]) + v[e] for e in STATES) for s in STATES]
    return pd.DataFrame(out, columns=["cid", "end", "is_last"])


def _state_maps(frames):
    """State behind a chunk for each state before it."""
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            codes, end = codes_of(r.initials, r.faults), [int(c) for c in r.end]
            togo = costs_to_go(codes, end)
            rows.append((r.key, r.cid, [walk(codes, togo, s, False)[2] for s in STATES]))
        yield pd.DataFrame(rows, columns=["key", "cid", "then"])


def _chain_forward(chunks: pd.DataFrame) -> pd.DataFrame:
    """State before every chunk of a conversation."""
    state, out = START, []
    for cid, then in zip(*chunks.sort_values("cid")[["cid", "then"]].values.T, strict=True):
        out.append((cid, state))
        state = int(then[state])
    return pd.DataFrame(out, columns=["cid", "begin"])


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every conversation.

    ``rows(conv_id, turn, role, text, copies)`` are distinct, as ``damage`` gives them;
    rows with copies 0 only name their conversation. Rows stand by turn (nulls
    first), then role and text. A null conv_id is a conversation; roles that begin
    otherwise than s, u or a can only be reroled or deleted; repeated rows are
    duplicates; a conversation without rows has zeros and the digest of nothing. An
    empty table gives an empty result.
    """
    marked = _seen_earlier(rows).withColumn("fault", _fault())
    order = ["conv_id", "turn", "role"]
    ordered = marked.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    chunks = materialise(ordered.select(*order, "text", "fault", "copies").mapInArrow(_chunks(chunk_rows), CHUNK))
    alone = chunks.where("alone").mapInArrow(_solve_alone, REPAIRED)
    shared = chunks.where("NOT alone")
    slim = shared.select("key", "cid", "initials", "faults")
    ends = materialise(slim.mapInPandas(_matrices, "key string, cid long, costs array<long>").groupBy("key").applyInPandas(_chain_back, "cid long, end array<long>, is_last boolean"))
    maps = slim.join(ends, "cid").mapInPandas(_state_maps, "key string, cid long, then array<int>")
    begins = materialise(maps.groupBy("key").applyInPandas(_chain_forward, "cid long, begin int"))
    parts = shared.join(ends, "cid").join(begins, "cid").mapInArrow(_solve_open, PART)
    return alone.unionByName(parts.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_join_open, REPAIRED))
