"""Chat formatting, exact dedup and mixing against brute force, with odd rows."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest

from quadrille.functions import skew
from quadrille.llm import exact_dedup as exact
from quadrille.llm.chat_format import PARTS, format_turns, read_back, text_part
from quadrille.llm.exact_dedup import drop_copies, exact_dedup
from quadrille.llm.mixing import RIDGE, balance, mix, take_copies

WS = "[\x20\x09-\x0d]"
DOCS = "doc_id long, text string, source string, row string, kept string"
ROWS = [
    (1, "a b\tc", "s", "x", "y"), (2, "abc", "s", "x", "y"), (3, " a b c ", None, None, None), (4, None, "s", "x", "y"), (5, "", "t", "x", "y"),
    (6, " \n\x0b\x0c\r", None, "x", "y"), (None, "abc", "t", "x", "y"), (7, "same", "s", "x", "y"), (7, "same", "s", "x", "y"), (8, "word " * 5000, "t", "x", "y"),
    (9, "a bc", "é", "x", "y"), (10, "\U0001f600 ok", "s", "x", "y"), (None, None, None, None, None),
]


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for at, r in enumerate(rows):
        t = r[1] or ""
        groups[re.sub(WS, "", t)].append((-len(t), r[0] is None, r[0] or 0, at))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit, per_block, hot", [(64 << 20, 2048, 10_000), (4096, 1, 10_000), (8192, 2, 1)])
def test_exact_dedup(spark, monkeypatch, limit, per_block, hot):
    monkeypatch.setattr(exact, "ROWS_PER_BLOCK", per_block)
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    got = exact_dedup(spark.createDataFrame(ROWS, DOCS), max_filter_bytes=limit).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == dedup_by_hand(ROWS)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert drop_copies(spark.createDataFrame(ROWS, DOCS)).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup(none).count() == mix(none).count() == take_copies(none).count() == 0


def targets_by_hand(sizes):
    """Shares with the excess over three times a source's size reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, sf):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = mix(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += count(r["text"])
    want, taken = targets_by_hand(dict(sizes)), defaultdict(int)
    text = {r["doc_id"]: (count(r["text"]), r["source"]) for r in rows}
    for r in got:
        size, source = text[r["doc_id"]]
        assert r["size"] == size and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source], rel=1e-9)
        assert r["taken"] % max(size, 1) == 0 and r["taken"] <= 3 * size
        taken[source] += r["taken"]
    largest = defaultdict(int)
    for size, source in text.values():
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in want)
    again = {(r["doc_id"], r["taken"]) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert take_copies(docs).count() == sum(r["copies"] for r in got)


def test_balance_meets_all_constraints(spark):
    rng = np.random.default_rng(4)
    cells = [(f"s{i}" if i else None, c, int(rng.integers(1, 9000)) * (2 if c < i else 1)) for i in range(6) for c in range(-1 if i == 3 else 0, 12)]
    cells = [(s, c, 0 if c < 0 else w) for s, c, w in cells]
    size = defaultdict(int)
    for s, _, w in cells:
        size[s] += w
    target = dict(zip(size, [0.4, 1.9, 2.6, 0.7, 3.0, 0.0], strict=True))
    target = {s: f * size[s] for s, f in target.items()}
    df = spark.createDataFrame([(s, c, w, target[s], size[s]) for s, c, w in cells], "source string, class int, words long, target double, source_size long")
    rated, facts = balance(df)
    got = {(r["source"], r["class"]): r["rate"] for r in rated.collect()}
    total, mean = sum(size.values()), sum(c * w for _, c, w in cells) / sum(size.values())
    for s in size:
        assert sum(w * got[t, c] for t, c, w in cells if t == s) == pytest.approx(target[s], rel=1e-5, abs=1e-5)
    assert 1 < facts["rounds"] < 30 and abs(facts["tilt"]) > 1e-3 and max(got.values()) <= 3
    # The slope of the length constraint vanishes, and the rates are exponential tilts below the cap.
    assert sum(w * got[s, c] * (c - mean) for s, c, w in cells) + RIDGE * total * facts["tilt"] == pytest.approx(0, abs=1e-4 * total)
    for s in size:
        logs = [(c, math.log(got[s, c])) for t, c, _ in cells if t == s and 0 < got[s, c] < 3 - 1e-9]
        for (c, a), (d, b) in zip(logs, logs[1:], strict=False):
            assert (b - a) / (d - c) == pytest.approx(facts["tilt"], abs=1e-4)


def test_mix_odd_rows(spark):
    got = mix(spark.createDataFrame(ROWS, DOCS)).collect()
    assert len(got) == len(ROWS)
    assert all(r["taken"] <= 3 * r["size"] and r["size"] >= 0 for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (4, 5, 6)} == {0}


def test_chat_round_trip(spark):
    odd = ["", "</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|turn|>x", "<<s>", "<<SYS>>[/INST]<|te", "a\\<|text|>", "\n<|image|>\n", "\U0001f600" * 3, "x" * 50_000, None]
    rows = [(c, t, ("user", "assistant", "system", "<|end|>", None)[(c + t) % 5], odd[(c * 3 + t) % len(odd)]) for c in range(12) for t in range(5)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (99, None, "assistant", "z"), (99, 1, "assistant", "dup"), (99, 1, "assistant", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_back(format_turns(df.select("conv_id", "turn", "role", text_part(df["text"]).alias("content")))).collect()
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        turns = sorted(want[r["conv_id"]])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(a, b) for _, a, b in turns]
        assert r["loss_text"] == "".join(b for _, a, b in turns if a == "assistant")
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>") == len(turns)
        assert "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]
        for m in r["loss_mask"]:
            assert m["start"] <= m["end"]


def test_chat_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="i.png", width=56, height=30), part("audio", ref="a.wav", seconds=2.5), part("text", text="<|image|>"), part("document", ref="d.pdf", pages=3), part("video", ref="v")]), (1, 1, "assistant", None)]
    got = format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {PARTS}")).first()
    assert got["formatted"] == "<|turn|>user<|text|>see <|image|><|audio|><\\|image|><|document|><|end|><|turn|>assistant<|text|><|end|>"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in got["attachments"]] == [(0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 63), (0, 4, "document", "d.pdf", 1536)]


def test_chat_parts_of_few_fields(spark):
    rows = [(1, 0, "user", [("text", "a"), ("image", "b"), ("video", "c"), (None, "d"), ("text", None)])]
    got = format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, content array<struct<type:string,text:string>>")).first()
    assert got["formatted"] == "<|turn|>user<|text|>a<|image|><|end|>"
    assert [(a["type"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "", 0)]
    assert format_turns(spark.createDataFrame([(1, 0, "user", [("x",)])], "conv_id long, turn long, role string, content array<struct<text:string>>")).first()["formatted"] == "<|turn|>user<|text|><|end|>"
