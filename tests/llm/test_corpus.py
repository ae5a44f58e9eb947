"""Conversation repair, source divergence and language-model scores against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quadrille.llm import conversation_repair, divergence, lm_score
from quadrille.llm.conversation_repair import damage, repair
from quadrille.llm.divergence import audit_sources
from quadrille.llm.lm_score import score_texts

WS = "[\x20\x09-\x0d]"
TURNS = "conv_id long, turn long, role string, text string, key string, `a.b` string"


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        conv_rows = out[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        conv_rows += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def repaired_by_hand(rows):
    """Cheapest edits by forward search over whole audits."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(f"^{WS}+|{WS}+$", "", text)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, said) in list(best.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 5, audit + "I", [*said, {"u": "user:", "a": "assistant:"}[to]])
                best[to] = min(best.get(to, (math.inf,)), new)
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        then = {}
        for state, (cost, audit, said) in insert(best).items():
            moves = [(cost + 2, audit + "D", said, state)]
            if fault in "t-":
                more = 5 if fault == "t" else 0
                if role[:1] and role[:1] in grammar[state]:
                    moves.append((cost + more, audit + "K", [*said, f"{role}:{text}"], role[0]))
                to = "a" if state == "u" else "u"
                moves.append((cost + more + 1, audit + "R", [*said, {"u": "user:", "a": "assistant:"}[to] + text], to))
            for *new, to in moves:
                then[to] = min(then.get(to, (math.inf,)), tuple(new))
        best = then
    cost, audit, said = min(v for s, v in insert(best).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "cut", "", None, " \t", "Why?\n", f"{rng.random()}.", "é"])
            rows.append((conv, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, text, "x", "y"))
    return rows


@pytest.mark.parametrize("chunk_rows, hot, longest", [(4096, 10_000, 9), (2, 1, 30), (3, 10_000, 60)])
def test_repair(spark, monkeypatch, chunk_rows, hot, longest):
    monkeypatch.setattr(conversation_repair, "HOT_ROWS", hot)
    rows = conversations(chunk_rows, 25, longest)
    got = repair(damage(spark.createDataFrame(rows, TURNS)), chunk_rows).collect()
    assert {r["conv_id"]: tuple(r[1:]) for r in got} == {c: repaired_by_hand(r) for c, r in damaged_by_hand(rows).items()}
    assert len(got) == len({r[0] for r in rows})


def test_repair_of_nothing_and_of_one_long_conversation(spark):
    assert repair(damage(spark.createDataFrame([], TURNS))).count() == 0
    rows = [(5, i % 700, ("user", "assistant")[i % 2], f"Line {i % 350}." if i % 9 else "again", "x", "y") for i in range(1500)] + [(5, 3, "user", "x" * 300_000 + ".", "x", "y")]
    got = repair(damage(spark.createDataFrame(rows, TURNS).repartition(5)), 64).collect()
    assert [tuple(r) for r in got] == [(5, *repaired_by_hand(damaged_by_hand(rows)[5]))]


DOCS = "doc_id long, lang string, source string, text string, value string, rank string"


def audited_by_hand(docs):
    terms, groups, seen = defaultdict(Counter), set(), defaultdict(Counter)
    for _, lang, source, text, *_ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        terms[lang, source].update(found)
        seen[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= 3]
        sources = sorted(s for k, s in groups if k == lang)
        size = {s: sum(terms[lang, s][t] for t in kept) for s in sources}
        p = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        rate = {s: {t: p(terms[lang, s][t], size[s]) for t in kept} for s in sources}
        whole = {t: p(sum(terms[lang, s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            pairs = [(-sum((rate[s][t] - rate[o][t]) ** 2 // rate[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            own = [(-((rate[s][t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if terms[lang, s][t] and rate[s][t] > whole[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:5])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def corpus(seed, n, sources, words):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["en", "en", "de", None]), rng.choice([*(f"s{k}" for k in range(sources)), None]), " ".join(rng.choice(["Word", "über", "ß", "İ", "日本"]) + "abcdefghij"[int(rng.paretovariate(1)) % 10] * rng.randint(1, words) for _ in range(rng.randint(0, 30))), "x", "y") for i in range(n)]
    return [*rows, (None, "xx", "alone", "once only", None, None), (1, "xx", "", None, None, None), (2, "", "", "1 2 3 \x00", None, None), (3, "en", "s0", "a_b " * 5000, "", "")] + rows[:3]


@pytest.mark.parametrize("sources, tile, light, groups", [(3, 1024, 256, 256), (12, 2, 2, 4), (12, 7, 3, 5)])
def test_divergence(spark, monkeypatch, sources, tile, light, groups):
    monkeypatch.setattr(divergence, "GROUPS", groups)
    docs = corpus(sources + tile, 150, sources, 6)
    got = audit_sources(spark.createDataFrame(docs, DOCS), term_ranks=5, tile=tile, light=light, bucket_bytes=3000, block_bytes=500)
    assert sorted(map(tuple, got.collect())) == audited_by_hand(docs)
    assert audit_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_rates_are_exact_where_products_overflow():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 9 * 10**15)
        c = rng.randint(0, size - 1)
        assert int(divergence.rate(np.array([c]), np.int64(size))[0]) == 1 + 10**9 * (c + 1) // size


def scored_by_hand(docs):
    """The same model over dictionaries."""
    texts = []
    for doc_id, _, _, text, *_ in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        texts.append((doc_id, zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7, [*(w for w in re.split(WS + "+", low) if w), ""]))

    def counted(folds):
        one, two = Counter(), Counter()
        for _, fold, tokens in texts:
            if fold in folds:
                one.update(tokens)
                two.update(zip(["", *tokens], tokens))
        return one, two

    bucket = lambda c: c.bit_length()
    one, two = counted({0, 1, 3, 4, 5, 6})
    kept, kept2 = counted({0, 1, 4, 5, 6})
    total, known, kept_total = sum(one.values()), len(one), sum(kept.values())
    weights = defaultdict(lambda: (0.4, 0.4, 0.2) if kept_total else (0, 0, 1))
    weights[0] = (0, 0.5, 0.5) if kept_total else (0, 0, 1)
    before = -math.inf
    for _ in range(lm_score.EM_ROUNDS):
        sums, gain, n = defaultdict(lambda: [0.0] * 3), 0.0, 0
        for _, fold, tokens in texts:
            for v, w in zip(["", *tokens], tokens) if fold == 3 else ():
                b = bucket(kept[v])
                parts = [x * y for x, y in zip(weights[b], (kept2[v, w] / kept[v] if kept[v] else 0, kept[w] / max(1, kept_total), 1 / (known + 1)))]
                gain, n = gain + math.log(sum(parts)), n + 1
                for k in range(3):
                    sums[b][k] += parts[k] / sum(parts)
        for b, s in sums.items():
            s = [x + (1 if b or k else 0) for k, x in enumerate(s)]
            weights[b] = tuple(x / sum(s) for x in s)
        if not n or gain - before < lm_score.EM_GAIN * n:
            break
        before = gain
    out = []
    for doc_id, fold, tokens in texts:
        base = sum(math.log10((one[t] + 1) / (total + known + 1)) for t in tokens)
        score = 0.0
        for v, w in zip(["", *tokens], tokens):
            parts = (two[v, w] / one[v] if one[v] else 0, one[w] / max(1, total), 1 / (known + 1))
            score += math.log10(sum(x * y for x, y in zip(weights[bucket(one[v])], parts)))
        out.append((doc_id, fold == 2, len(tokens), sum(one[t] > 0 for t in tokens), total, base, score))
    return out


@pytest.mark.parametrize("size, per_bucket", [(8 << 20, 500_000), (300, 40)])
def test_lm_score(spark, size, per_bucket):
    docs = corpus(7, 160, 2, 3)
    got = score_texts(spark.createDataFrame(docs, DOCS), block_bytes=size, bucket_words=per_bucket, bucket_tokens=per_bucket).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(scored_by_hand(docs), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)


@pytest.mark.parametrize("ids", [[], [7], [1, 2, 3]])
def test_lm_score_of_few(spark, ids):
    docs = [(i, "en", "s", t, "", "") for i in ids for t in ("a b", None)]
    got = sorted(map(tuple, score_texts(spark.createDataFrame(docs, DOCS)).collect()), key=str)
    want = sorted(scored_by_hand(docs), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-12) for g, w in zip(got, want))


def test_held_out_texts_are_likelier_under_the_model(spark, sf):
    rows = score_texts(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
