"""Mixing sources to target token weights by entropy balancing, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import WORD, running_totals, stage, text_of

EXACT = "decimal(38,6)"  # sums of decimals do not depend on their order, so reruns agree


def size_in_words(name: str = "text") -> Column:
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``cap`` times its source's size and the
    excess goes to the others by weight. Sorted by the level at which each is full, the
    common level is the first that leaves its own source and all later ones below the cap.
    Turns and the sums of all earlier sources are running totals over a range partitioning,
    so sources may be as many as documents.
    """
    first = F.asc_nulls_last("source")
    turn = running_totals(sources.withColumn("_one", F.lit(1)), [first], {"_turn": "_one"}, "mix-turns").drop("_one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    full = turn.withColumn("weight", weight.cast(EXACT)).withColumn("most", (cap * F.col("source_size")).cast(EXACT)).drop("_turn")
    full = stage(full.withColumn("full_at", F.col("most").cast("double") / F.col("weight").cast("double")), "mix-levels")
    every = full.agg(F.sum("source_size").alias("size"), F.sum("weight").cast("double").alias("weight")).first()  # one row
    placed = running_totals(full, [F.asc("full_at"), first], {"_most": "most", "_weight": "weight"}, "mix-filling")
    left = F.lit(float(share * (every["size"] or 0))) - F.col("_most").cast("double")
    level = left / (F.lit(float(every["weight"] or 0)) - F.col("_weight").cast("double"))
    fits = placed.withColumn("level", level).filter(F.col("level") <= F.col("full_at"))
    common = fits.agg(F.max("level")).first()[0]  # from the first source that fits on, levels only fall; null where all are full
    goal = F.col("most").cast("double")
    goal = goal if common is None else F.least(goal, F.lit(common) * F.col("weight").cast("double"))
    return full.select("source", "source_size", goal.alias("target"))


def _rate(cap: float) -> Column:
    """Copies of a document: exponentially tilted odds around one copy, below the cap."""
    tilted = cap / (1 + F.exp(-F.col("dual") * F.col("size") / F.col("mean_size")))
    return F.when(F.col("target") >= F.col("most"), F.lit(cap)).when(F.col("size") == 0, F.lit(cap / 2)).otherwise(tilted)


def solve_dual(bins: DataFrame, sources: DataFrame, cap: float, tolerance: float = 1e-7, rounds: int = 100) -> DataFrame:
    """One multiplier per source, by Newton's method on the convex dual.

    Each round is one pass over the (source, size, n) bins: the tokens a multiplier gives
    and their derivative. A step that leaves the bracket known so far is halved, and so is
    the bracket in every fourth round, so the rounds always close in. A source is done when
    its tokens are near the target, or its multiplier can change no more. An error where
    ``rounds`` do not suffice. Each round is written to the shared folder.
    """
    state = stage(
        sources.withColumns({
            "most": cap * F.col("source_size"), "dual": F.lit(0.0), "low": F.lit(-1e4), "high": F.lit(1e4),
            "mean_size": F.greatest(F.lit(1.0), F.col("source_size") / F.col("n_docs")),
        }), "mix-dual")
    for turn in range(1, rounds + 1):
        known = bins.join(state, bins["source"].eqNullSafe(state["source"])).drop(bins["source"])
        rate = _rate(cap)
        slope = F.col("size") / F.col("mean_size") * rate * (1 - rate / cap)
        given = known.groupBy("source").agg(
            F.sum((F.col("n") * F.col("size") * rate).cast(EXACT)).cast("double").alias("given"),
            F.sum((F.col("n") * F.col("size") * slope).cast(EXACT)).cast("double").alias("slope"),
        ).withColumnRenamed("source", "given_source")
        both = state.join(given, state["source"].eqNullSafe(F.col("given_source")))
        off = F.col("given") - F.col("target")
        low = F.when(off < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high) & F.lit(turn % 4 > 0)
        done = (
            (F.col("target") >= F.col("most")) | (F.abs(off) <= tolerance * F.greatest(F.lit(1.0), F.col("target")))
            | (high - low <= 1e-12 * (1 + F.abs("dual")))
        )
        state = stage(both.select(
            "source", "source_size", "n_docs", "target", "most", "mean_size",
            F.when(done, F.col("dual")).when(inside, newton).otherwise((low + high) / 2).alias("dual"),
            low.alias("low"), high.alias("high"), done.alias("done"),
        ), "mix-dual")
        if state.filter("not done").isEmpty():
            break
        state = state.drop("done")
    else:
        raise ValueError(f"the multipliers of some sources are not found in {rounds} rounds")
    return state.select("source", "source_size", "target", "most", "mean_size", "dual")


def _nearer(bins: DataFrame, cap: float) -> DataFrame:
    """Moves one document per source by one copy where that brings its tokens nearer to the target."""
    taken = bins.groupBy("source").agg(
        F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).alias("taken"), F.first("target").alias("goal")
    ).select(F.col("source").alias("taken_source"), (F.col("goal") - F.col("taken")).alias("gap"))
    held = bins.join(taken, bins["source"].eqNullSafe(F.col("taken_source")))
    free = F.when(F.col("gap") > 0, (F.col("extra") < F.col("n")) & (F.col("base") + 1 <= cap)).otherwise(F.col("extra") > 0)
    useful = held.filter(free & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")))
    chosen = useful.groupBy("source").agg(
        F.min_by("size", F.struct(F.abs(F.col("size") - F.abs("gap")), F.col("size"))).alias("chosen"),
        F.first(F.signum("gap")).cast("long").alias("step"),
    ).select(F.col("source").alias("chosen_source"), "chosen", "step")
    both = bins.join(chosen, bins["source"].eqNullSafe(F.col("chosen_source")) & (bins["size"] == F.col("chosen")), "left")
    return both.withColumn("extra", F.col("extra") + F.coalesce("step", F.lit(0))).drop("chosen_source", "chosen", "step")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, carry: list[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and copies in columns ``mix_*``.

    ``carry`` names the columns of ``docs`` to pass through, all by default; doc_id and
    source always do. Without the text, rows are small when they are put in order.

    The rates of the documents minimise the entropy distance to one copy each, between
    none and ``cap``, under one constraint per source: its tokens meet its target. The
    solution is an exponential tilt of the odds by document size with one multiplier per
    source. As a rate depends on source and size only, the dual is solved on the counts
    per (source, size).

    Rates become copies by systematic rounding along (source, size): the running sum of
    the fractional parts decides how many documents of a (source, size) get one more copy,
    so a source is off by about half a document; two last steps move single documents where
    that comes nearer. Which documents get it follows a hash of doc_id.

    Null texts and texts without a word have size 0, rate 1 and add nothing. A null source
    is a source of its own. Repeated rows are documents of their own. An empty table gives
    an empty table. Columns named ``mix_*`` are replaced; others pass through.
    """
    own = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    plain = [c for c in docs.columns if c not in own and (carry is None or c in carry or c in ("doc_id", "source"))]
    sized = docs.drop("mix_size").withColumn("mix_size", size_in_words()).select(*plain, "mix_size")
    bins = stage(sized.groupBy("source", F.col("mix_size").alias("size")).agg(F.count("*").alias("n")), "mix-bins")
    sources = bins.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    goal = source_targets(sources.select("source", "source_size"), weights, share, cap)
    goal = goal.withColumnRenamed("source", "goal_source").drop("source_size")
    sources = sources.join(goal, sources["source"].eqNullSafe(goal["goal_source"])).drop("goal_source")
    dual = solve_dual(bins, sources, cap)
    rated = bins.join(dual, bins["source"].eqNullSafe(dual["source"])).drop(dual["source"]).withColumn("rate", _rate(cap))
    rated = rated.withColumn("base", F.floor("rate")).withColumn(
        "fraction", (F.col("n") * (F.col("rate") - F.col("base"))).cast(EXACT)
    )
    placed = running_totals(
        rated, [F.asc_nulls_last("source"), F.asc("size")], {"before": "fraction", "first": "n"}, "mix-rates"
    )
    extra = F.floor(F.col("before") + F.col("fraction") + 0.5) - F.floor(F.col("before") + 0.5)
    counts = placed.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), extra)).cast("long"))
    for _ in range(2):
        counts = stage(_nearer(counts, cap), "mix-counts")
    plan = counts.select(
        F.col("source").alias("plan_source"), F.col("size").alias("plan_size"), F.col("first").alias("plan_first"),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.col("base").alias("plan_base"), F.col("extra").alias("plan_extra"),
    )
    draw = F.xxhash64(F.col("doc_id"))
    ranked = running_totals(
        sized.withColumn("mix_one", F.lit(1)),
        [F.asc_nulls_last("source"), F.asc("mix_size"), draw, F.col("doc_id")], {"mix_rank": "mix_one"}, "mix-rows",
    )
    joined = ranked.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("mix_size") == F.col("plan_size")))
    more = (F.col("mix_rank") - F.col("plan_first") < F.col("plan_extra")).cast("long")
    return joined.select(
        *plain, "mix_size", "mix_source_size", "mix_target", (F.col("plan_base").cast("long") + more).alias("mix_copies")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it."""
    taken = mix(docs, **settings).filter("mix_copies > 0")
    repeated = taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return repeated.select(*docs.columns)
