"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

The balanced rates minimise ``sum size * (r log r - r)`` over documents with
rates in [0, cap], under overlapping token constraints: one per source
(``sum size * r = target``, exact) and one over all sources, that the mix keeps
the mean length class of the corpus, so that reweighting sources does not drift
towards short or long documents (held softly by ``RIDGE``, since no rates may
reach it). The dual is convex; its minimum gives every document the exponential
tilt ``min(cap, exp(l[source] + m * x))`` by source and length class x.

Newton iterations run on the cluster: documents are summed up once into cells
of one source and one length class, which hold all that gradient and Hessian
need; each round aggregates both over the cells per source, takes one row of
totals to the driver for the step of m (the Schur complement of the sources),
and updates every source's l in the same table. The number of sources has no bound.

Rates become whole copies: everyone gets ``floor(rate)`` copies, and one more
goes to documents in the order of hash over remaining fraction (sequential
Poisson sampling: chances follow the fractions) until the source's remaining
words are used up. The cumulative sum behind that is two-level: sums per
(source, bin of that order), a running sum over bins, and a running sum over
rows in the one bin of each source where the words run out, so a source with a
third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.llm.text import word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
NEWTON_ROUNDS, SETTLED, RIDGE, LONGEST_STEP = 40, 1e-7, 0.02, 1.0
ROWS_PER_BIN, LAST_BIN = 4096, 4  # bins cover the order up to LAST_BIN times the expected end
BROADCAST_ROWS = 100_000


def length_class(size: Column) -> Column:
    """Doublings of the number of words; -1 without words."""
    return F.when(size > 0, F.floor(F.log2(size.cast("double") + 0.5))).otherwise(F.lit(-1)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn and share all
    words; a target stops at ``cap`` times its source's size and the excess is
    reshared by weight. That water level is found by one pass over the sources
    in order of ``cap * size / weight``, which are one row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_theta", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    # The level is that of the first source its own share does not fill.
    level = F.min(F.when(F.col("_theta") <= F.col("_level"), F.struct("_level", F.col("_theta").alias("t")))).over(everyone)["t"]
    target = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return per.select("source", "source_size", "source_rows", F.coalesce(target, F.lit(0.0)).alias("target"))


def balance(cells: DataFrame, cap: float = CAP, rounds: int = NEWTON_ROUNDS) -> tuple[DataFrame, dict]:
    """``cells(source, class, words, target, source_size)`` with ``rate``, and the facts of the run.

    A source whose target is all it can give has the rate ``cap`` throughout, one
    without words or target the rate 0; both are constants of the dual.
    """
    same = F.col("c.source").eqNullSafe(F.col("s.source"))
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-9)))
    total, mean = cells.agg(F.coalesce(F.sum("words"), F.lit(0)), F.sum(F.col("words") * F.col("class")) / F.sum("words")).first()
    cells = cells.withColumn("x", F.col("class") - F.lit(float(mean or 0.0))).withColumn("free", free)
    state = cells.select("source", F.when(F.col("free"), F.log(F.col("target") / F.col("source_size"))).alias("l")).distinct()
    m, facts = 0.0, {"rounds": 0, "tilt": 0.0, "error": 0.0}
    z = lambda tilt: F.col("s.l") + F.lit(tilt) * F.col("x")
    rate = lambda tilt: F.when(F.col("free"), F.least(F.lit(cap), F.exp(F.least(z(tilt), F.lit(50.0))))).when(F.col("target") > 0, F.lit(cap)).otherwise(F.lit(0.0))
    for facts["rounds"] in range(1, rounds + 1) if total else ():
        mass = F.col("words") * rate(m)
        # A rate at the cap has no slope; its mass is kept as curvature, which only shortens steps.
        slope = F.when(F.col("free"), mass).otherwise(F.lit(0.0))
        per = cells.alias("c").join(state.alias("s"), same).groupBy("c.source").agg(
            F.first("l").alias("l"), F.first("free").alias("free"), F.first("target").alias("target"),
            (F.sum(mass) - F.first("target")).alias("g"), F.sum(slope).alias("h"), F.sum(slope * F.col("x")).alias("b"), F.sum(slope * F.col("x") * F.col("x")).alias("q"), F.sum(mass * F.col("x")).alias("gm"))
        per = materialise(per)
        t = per.agg(F.sum("gm").alias("gm"), F.sum("q").alias("q"), F.sum(F.when(F.col("free"), F.col("b") * F.col("b") / F.col("h"))).alias("bb"), F.sum(F.when(F.col("free"), F.col("b") * F.col("g") / F.col("h"))).alias("bg"), F.max(F.when(F.col("free"), F.abs("g") / F.col("target"))).alias("error")).first()
        curve, pull = (t["q"] or 0.0) + RIDGE * total - (t["bb"] or 0.0), (t["gm"] or 0.0) + RIDGE * total * m - (t["bg"] or 0.0)
        step = max(-LONGEST_STEP, min(LONGEST_STEP, -pull / curve))
        facts["error"], facts["tilt"] = t["error"] or 0.0, m
        if facts["error"] < SETTLED and abs(step) < SETTLED:
            break
        move = -(F.col("g") + F.col("b") * F.lit(step)) / F.col("h")
        state = per.select("source", F.when(F.col("free"), F.col("l") + F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), move))).alias("l"))
        m = m + step
    return cells.alias("c").join(state.alias("s"), same).select("c.*", rate(m).alias("rate")).drop("x", "free"), facts


def mix(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per document: ``row`` (struct of ``carry``), ``doc_id``, ``size``,
    ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    ``taken = copies * size`` with ``copies`` at most ``cap`` (a whole number). Size
    counts words; null text has size 0, a null source is a source of its own.
    Documents of size 0 get ``floor(rate)`` copies. Reruns agree: the order
    within a source is a hash of id and size, never a row's place. An empty
    table gives an empty result; extra columns travel inside ``row``.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit("mix"), F.col(id_col), F.char_length(text_col)).alias("_u"))
    base = base.withColumn("class", length_class(F.col("size")))
    narrow = materialise(base.select("doc_id", "source", "size", "class", "_u"))
    cells = materialise(narrow.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    rows = cells.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    targets = materialise(source_targets(cells.select("source", F.col("words").alias("size")), weights, cap))
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    aimed = materialise(cells.alias("s").join(targets.alias("t"), same).select("s.*", "source_size", "target"))
    rated, _ = balance(aimed, cap)
    whole = F.least(F.floor(F.col("rate") + 1e-9), F.lit(int(cap)).cast("long"))
    rated = rated.withColumn("_whole", whole).withColumn("_part", F.when(F.col("_whole") >= F.lit(int(cap)), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("rate") - F.col("_whole"))))
    rated = materialise(rated.withColumn("_part", F.when(F.col("_part") > 1e-9, F.col("_part")).otherwise(F.lit(0.0))))
    left = rated.groupBy("source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("words"))).alias("_left"), F.sum(F.when(F.col("_part") > 0, F.col("words")).otherwise(F.lit(0))).alias("_open"))
    left = materialise(left)

    # The order within a source, and the bin of it; documents without a fraction stand in none.
    bins = max(64, -(-rows // ROWS_PER_BIN))
    order = F.when(F.col("_part") > 0, (F.shiftrightunsigned("_u", 11) / F.lit(float(1 << 53))) / F.col("_part"))
    bin_of = F.floor(F.least(F.col("_at"), F.lit(float(LAST_BIN))) * F.lit(bins))
    cell = F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.class") == F.col("t.class"))
    small = rated.count() <= BROADCAST_ROWS  # a checked bound; else the join shuffles
    hint = F.broadcast if small else (lambda df: df)
    placed = narrow.alias("s").join(hint(rated).alias("t"), cell).select("s.source", "s.doc_id", "s.size", order.alias("_at")).where("_at IS NOT NULL").withColumn("_bin", bin_of)
    sums = placed.groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
    w = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(w), F.lit(0)))
    cut = sums.alias("s").join(left.alias("t"), same).where("_left > 0 AND _left < _open AND _before <= _left AND _left < _before + _words").select("s.source", "_bin", (F.col("_left") - F.col("_before")).alias("_room"))
    cut = materialise(cut)

    # Inside the bin where a source's words run out, rows are taken in order.
    tail = placed.alias("s").join(cut.alias("t"), same & (F.col("s._bin") == F.col("t._bin"))).select("s.source", "s.doc_id", "s.size", "s._at", "t._room")
    w = Window.partitionBy("source").orderBy("_at", "doc_id", "size")
    tail = tail.withColumn("_run", F.sum("size").over(w))  # equal rows share one frame, so they are taken together
    edge = tail.where(F.col("_run") - F.col("size") / 2 <= F.col("_room")).groupBy("source").agg(F.max(F.struct("_at", "doc_id", "size")).alias("_edge"))
    ends = left.alias("s").join(cut.alias("t"), same, "left").select("s.*", F.col("t._bin").alias("_cut"))
    ends = ends.alias("s").join(edge.alias("t"), same, "left").select("s.*", "t._edge")
    plan = materialise(rated.alias("s").join(ends.alias("t"), same).select("s.*", "_left", "_open", "_cut", "_edge"))

    wide = base.alias("s").join(hint(plan).alias("t"), cell, "left").withColumn("_at", order).withColumn("_bin", bin_of)
    upto = F.struct(F.col("_at"), F.col("s.doc_id").alias("doc_id"), F.col("s.size").alias("size")) <= F.col("_edge")
    extra = (F.col("_left") >= F.col("_open")) | (F.col("_bin") < F.col("_cut")) | ((F.col("_bin") == F.col("_cut")) & F.coalesce(upto, F.lit(False)))
    more = (F.col("_part") > 0) & (F.col("size") > 0) & (F.col("_left") > 0) & extra
    copies = F.coalesce(F.col("_whole"), F.lit(0)) + F.when(more, F.lit(1)).otherwise(F.lit(0)).cast("long")
    out = wide.select("row", "s.doc_id", "size", "source_size", "target", "rate", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed: every row as often as the mix takes it, the same columns."""
    mixed = mix(docs, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
