"""The corpus pipeline: every stage on what its predecessor kept, and run(), against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quadrille.llm import toxicity
from quadrille.llm.queries_python import tokenizer_path


@pytest.fixture(scope="module")
def sf_dir(spark, sf, tmp_path_factory):
    """The tables of sf0.01 with planted rows: odd, repeated, nearly repeated and toxic ones, and more columns."""
    out, path = str(tmp_path_factory.mktemp("data")), sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    long = next(r["text"] for r in docs.where("n_chars BETWEEN 2000 AND 4000 AND lang = 'fr'").orderBy("doc_id").collect())
    words = long.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [(10**6, None, "en", None, 0), (10**6 + 1, "", None, "src1", 0), (10**6 + 2, long, "fr", "src1", 1), (10**6 + 2, long, "fr", "src1", 1), (10**6 + 3, near, "fr", "src2", 1), (10**6 + 4, f" {long} ", "fr", None, 1), (None, "a text without an id of its own", "en", "src0", 9), (10**6 + 5, "you stupid worthless moron and idiot, pathetic trash", "en", "src0", 9), (10**6 + 6, "x", "en", "src0", 1), (10**6 + 7, "word " * 30_000, "en", "src3", 1)]
    docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").select(docs.columns)).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input rows, output rows) of every stage by its name."""
    from quadrille.functions.shared import materialise

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = materialise(stage(spark, docs, sf_dir))
        if name != "packing":
            assert got.columns == docs.columns
        out[name] = (docs.collect(), got.collect())
        docs = got
    return out


def by_key(rows):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in rows)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "packing"]


def test_toxicity_stage(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    index = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    dense = np.zeros((len(index.ids), len(index.lexicon.place)))
    for t in range(len(index.starts)):
        a, b = index.starts[t, 0], index.starts[t, -1]
        dense[index.places[a:b], t] = index.weights[a:b]
    kept = []
    for r in before:
        terms, counts = index.lexicon.counts(r["text"], toxicity.Known(index.lexicon))
        q = np.zeros(dense.shape[1])
        q[terms] = index.lexicon.vector(terms, counts)
        s = np.round(dense @ q, 12)
        near = [(float(s[i]), int(i), -1) for i in np.lexsort((np.arange(len(s)), -s))[: toxicity.NEIGHBOURS] if s[i] > 0]
        if index.probability(near) < 0.3:
            kept.append(r)
    assert by_key(after) == by_key(kept) and not any(r["doc_id"] == 10**6 + 5 for r in after)


def test_exact_stage(stages):
    before, after = stages["exact dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[re.sub("[\x20\x09-\x0d]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == Counter(min(g)[1:] for g in groups.values())


def test_near_stage(stages):
    before, after = stages["simhash near-dedup"]
    grams = {}
    for r in before:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").split()
        grams[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(list)
    for i, g in grams.items():
        for x in g:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    similar = {p: n / (len(grams[p[0]]) + len(grams[p[1]]) - n) for p, n in shared.items()}
    left = {r["doc_id"] for r in after}
    assert by_key(after) <= by_key(before)
    near = [p for p, s in similar.items() if s >= 0.85]
    assert near and sum(not (a in left and b in left) for a, b in near) >= 0.95 * len(near)
    close = {i for p, s in similar.items() if s >= 0.6 for i in p}
    assert all(i in left for i in grams if i not in close)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    times, words = by_key(after), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert max(times.values()) <= 3 and set(times) <= set(by_key(before))
    size, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        size[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    for r in after:
        taken[r["source"]] += words(r["text"])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = sum(size.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3 * size[s] for s in rest if share[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    for s, want in (fixed | share).items():
        assert abs(taken[s] - want) <= largest[s] / 2 + 1e-6


def test_packing_stage_and_run(spark, sf_dir, stages):
    before, after = stages["packing"]
    tok = Tokenizer.from_file(tokenizer_path())
    ids = defaultdict(list)
    for r in before:
        ids[r["doc_id"]].append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    assert sum(r["length"] for r in after) == sum(len(x) for g in ids.values() for x in g)
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in after)
    for (doc, start, length, crc, tokens), n in pieces.items():
        same = [x for x in ids[doc] if len(x) == tokens and zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc]
        assert 1 <= n <= len(same)
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(map(tuple, run)) == Counter(map(tuple, after))


def test_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
