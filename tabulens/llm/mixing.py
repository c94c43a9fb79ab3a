"""Mixing sources to target weights by entropy balancing.

Document rates minimise relative entropy to 1 under one token constraint per source, with rates of at most CAP:
rate = min(CAP, exp(lambda * size / mean size)). Each source's multiplier solves the convex dual by Newton steps on the
logarithm, kept inside a bracket; a step is one grouped pass over the counts of (source, size). The rates are rounded into
whole copies by sequential Poisson sampling, so that a source misses its target by at most half of one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import WORD, uniform, with_groups
from tabulens.plans.workspace import Scratch, written

CAP = 3.0
STEPS = 80
#: Sources, or names of repeated rows, that are broadcast at most.
SENT = 200_000
TOLERANCE = 1e-9
BINS = 1024


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources(source, source_size, ...) with `target`: weights repeat over the sources in code-point order, null last.

    A target stops at cap times the source's size and the excess is shared again by weight, which is one common level
    found by sorting sources by the level at which they fill up. The windows hold one narrow row per source.
    """
    at = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(cap)
    s = sources.withColumn("w", w).withColumn("fills", full / F.col("w"))
    order = Window.orderBy("fills", F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(every) * F.lit(share)
    left = wanted - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    weight_left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", left / weight_left)
    # The level that holds is that of the first source which does not fill up; if all do, everyone takes all.
    s = s.withColumn("holds", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(every)["level"])
    target = F.when(F.col("holds").isNull(), full).otherwise(F.least(full, F.col("holds") * F.col("w")))
    return s.withColumn("target", target).drop("w", "fills", "level", "holds")


def multipliers(counts: DataFrame, wanted: DataFrame, cap: float) -> DataFrame:
    """lambda for each source: counts(source_key, size, n), wanted(source_key, ratio, mean, least) with 0 < ratio <= cap."""
    log_cap = math.log(cap)
    start = (F.col("mean") / F.col("least"))
    state = written(wanted.select("source_key", "ratio", "mean", (F.least(F.lit(0.0), F.log("ratio")) * start).alias("lo"),
                                  (F.lit(log_cap) * start).alias("hi"), F.lit(0.0).alias("lam"), F.lit(False).alias("done")), "mix-dual")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.lit(log_cap), F.col("lam") * x))
        sums = (counts.join(state.select("source_key", "mean", "lam"), "source_key").groupBy("source_key").agg(
            F.sum(F.col("n") * x).alias("all"), F.sum(F.col("n") * x * rate).alias("got"),
            F.sum(F.when(F.col("lam") * x < log_cap, F.col("n") * x * x * rate).otherwise(0.0)).alias("slope")))
        s = state.join(sums, "source_key").withColumn("share", F.col("got") / F.col("all"))
        over = F.col("share") > F.col("ratio")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + F.log(F.col("ratio") / F.col("share")) * F.col("got") / F.nullif(F.col("slope"), F.lit(0.0))
        done = F.col("done") | (F.abs(F.col("share") / F.col("ratio") - 1) <= TOLERANCE) | (hi - lo <= F.abs(hi) * 1e-15)
        step = F.when(done, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        state = written(s.select("source_key", "ratio", "mean", lo.alias("lo"), hi.alias("hi"), step.alias("lam"), done.alias("done")), "mix-dual")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source_key", "lam")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What decides a row's copies: key, source, a source key that is never null, words, and a name for rows that tie in all."""
    text, source = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{source_col}`").cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return [F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), key.alias("source_key"), size.alias("size"),
            F.xxhash64(F.col(f"`{id_col}`"), key, text).alias("tie")]


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """`rows`, a written table, with `nth`: 0 for a row of its own, 0, 1, 2 ... for rows that share a `tie`, in any order.

    Ties of any size are numbered in pieces, those of one stored partition, whose starts come from their counts.
    """
    ties = written(rows.groupBy("tie").agg(F.count(F.lit(1)).alias("n_tie")).filter("n_tie > 1"), "mix-tie")
    if ties.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    marked = with_groups(rows.withColumns({"piece": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), ties, "tie", "n_tie", total)
    marked = written(marked, "mix-marked")
    alone, tied = marked.filter("n_tie IS NULL").withColumn("nth", F.lit(0).cast("long")), marked.filter("n_tie IS NOT NULL")
    pieces = tied.groupBy("tie", "piece").agg(F.count(F.lit(1)).alias("k"))
    starts = pieces.select(F.col("tie").alias("t"), F.col("piece").alias("p"), (F.sum("k").over(Window.partitionBy("tie").orderBy("piece")) - F.col("k")).alias("start"))
    place = F.row_number().over(Window.partitionBy("tie", "piece").orderBy("row")) - 1
    tied = tied.withColumn("place", place).join(starts, (F.col("tie") == F.col("t")) & (F.col("piece") == F.col("p")))
    return alone.drop("piece", "row", "n_tie").unionByName(tied.withColumn("nth", (F.col("start") + F.col("place")).cast("long")).select(*rows.columns, "nth"))


def _rated(rows: DataFrame, cap: float, seed: int) -> DataFrame:
    """Rows with their source's facts: rate, whole copies and the draw for one more."""
    rate = F.when(F.col("lam").isNull() | (F.col("size") == 0), F.lit(0.0)).otherwise(
        F.exp(F.least(F.lit(math.log(cap)), F.col("lam") * F.col("size") / F.col("mean"))))
    # exp(log(cap)) may fall a hair short of a whole number
    rate = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    r = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    draw = uniform(F.col("doc_id"), F.col("size"), F.col("tie"), F.col("nth"), F.lit(seed)) / F.nullif(F.col("rate") - F.col("whole"), F.lit(0.0))
    return r.withColumn("draw", draw)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0),
             share: float = 1.0, cap: float = CAP, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows with their rates and copies, and the facts of every source (source_key, ..., cut) from which they follow."""
    with Scratch(docs.sparkSession) as scratch:
        sizes = written(docs.select(*_narrow(docs, id_col, text_col, source_col)), "mix-size")
        total = sizes.count()
        counts = written(sizes.groupBy("source_key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-count")
        sources = counts.groupBy("source_key", "source").agg(
            F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"),
            F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
        aim = written(targets(sources, weights, share, cap), "mix-target")
        wanted = aim.filter("source_size > 0 AND target > 0").select(
            "source_key", (F.col("target") / F.col("source_size")).alias("ratio"), (F.col("source_size") / F.col("filled")).alias("mean"), "least")
        lam = multipliers(counts.filter("size > 0").select("source_key", "size", "n"), wanted, cap)
        plan = written(aim.join(wanted.select("source_key", "mean"), "source_key", "left").join(lam, "source_key", "left")
                       .select("source_key", "source_size", "rows", "target", "mean", "lam"), "mix-plan")
        r = _rated(with_groups(_numbered(sizes, total), plan, "source_key", "rows", total), cap, seed)
        r = written(r.withColumn("place", F.col("draw") / (1 + F.col("draw"))), "mix-rate")
        cuts = _cuts(r, plan, total)
        facts = scratch.keep(written(plan.join(cuts.drop("rows_cut"), "source_key"), "mix-facts"))
        out = with_groups(r, cuts, "source_key", "rows_cut", total)
        copies = F.col("whole") + F.when(F.col("draw") <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
        rows = scratch.keep(written(out.select("doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"),
                                               (copies * F.col("size")).cast("long").alias("taken")), "mix-rows"))
    return rows, facts


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0),
                share: float = 1.0, cap: float = CAP, seed: int = 0) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, rate, copies, taken (= copies * size).

    `size` is the number of words. `weights` repeat over the sources in code-point order, null last, and share `share` of
    all words. A document's rate is at most `cap`, its copies at most ceil(cap). Reruns agree: the rounding draws on a
    hash of the key and the text.

    Null text has size 0, is taken 0 times, and a source of such rows has target 0. Null is a source of its own. Rows that
    repeat id, source and text are numbered, and each number draws for itself, so a source of many such rows meets its target
    too; which of them gets which number is open, as they are alike. Texts of any length are counted whole. Other columns
    are not read; an empty table gives no rows.
    """
    return mix_plan(docs, id_col, text_col, source_col, weights, share, cap, seed)[0]


def _cuts(r: DataFrame, plan: DataFrame, total: int) -> DataFrame:
    """For each source the draw up to which documents get one more copy: the words so added come nearest to what is missing.

    Draws are cut into BINS by their place in (0, 1), then the bin where the sum crosses again, and only documents of that
    cell, about one in BINS * BINS of a source, are put in order.
    """
    base = r.groupBy("source_key").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    need = plan.join(base, "source_key").select("source_key", "rows", F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)).alias("need"))
    asks = written(need, "mix-need")
    bins = [F.floor(F.col("place") * BINS), F.floor(F.col("place") * BINS * BINS) % BINS]
    open_rows = r.filter(F.col("draw").isNotNull()).select("source_key", "size", "draw", bins[0].alias("b0"), bins[1].alias("b1"))
    for at in ("b0", "b1"):
        sums = open_rows.groupBy("source_key", at).agg(F.sum("size").alias("words")).join(asks, "source_key")
        run = Window.partitionBy("source_key").orderBy(at)
        sums = sums.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
        crossing = sums.filter("before < need AND upto >= need").select("source_key", F.col(at).alias("at"), (F.col("need") - F.col("before")).alias("need_in"))
        asks = written(asks.join(crossing, "source_key", "left").select(
            "source_key", "rows", F.coalesce("need_in", F.lit(0.0)).alias("need"), F.col("at").alias(f"x{at}"), *[c for c in asks.columns if c.startswith("x")]), "mix-need")
        open_rows = with_groups(open_rows, asks.select("source_key", "rows", f"x{at}"), "source_key", "rows", total).filter(F.col(at) == F.col(f"x{at}")).drop("rows", f"x{at}")
    cell = open_rows.join(asks.select("source_key", "need"), "source_key")
    run = Window.partitionBy("source_key").orderBy("draw")
    cell = cell.withColumn("upto", F.sum("size").over(run)).withColumn("words", F.sum("size").over(Window.partitionBy("source_key", "draw")))
    last = cell.filter(F.col("upto") - F.col("words") / 2 <= F.col("need")).groupBy("source_key").agg(F.max("draw").alias("last"))
    # Without an accepted draw in the cell, everything before the cell is taken; without a crossing, nothing or all is.
    edge = (F.col("xb0") + (F.col("xb1") / F.lit(float(BINS)))) / F.lit(float(BINS))
    none = F.when(F.col("xb0").isNull(), F.lit(0.0)).otherwise(edge / (1 - edge) * (1 - 1e-15))
    full = r.filter(F.col("draw").isNotNull()).groupBy("source_key").agg(F.sum("size").alias("open"), F.max("draw").alias("top"))
    need0 = need.select("source_key", F.col("need").alias("need0"))
    out = asks.join(last, "source_key", "left").join(full, "source_key", "left").join(need0, "source_key")
    cut = F.when(F.col("need0") > F.col("open"), F.col("top")).otherwise(F.coalesce("last", none))
    return written(out.select("source_key", F.col("rows").alias("rows_cut"), F.coalesce(cut, F.lit(0.0)).alias("cut")), "mix-cut")


def repeat_copies(docs: DataFrame, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, seed: int = 0) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; `facts` are those of `mix_plan(docs)`.

    A row's copies follow from itself and the facts of its source, so texts stay where they are while there are at most
    SENT sources. Only rows that repeat id, source and text are written once more, to be numbered.
    """
    named = {f"__{name}": c for name, c in zip(("doc_id", "source", "source_key", "size", "tie"), _narrow(docs, id_col, text_col, source_col))}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[c.alias(n.removeprefix("__")) for n, c in named.items()])
    ties = written(rows.groupBy("tie").agg(F.count(F.lit(1)).alias("n_tie")).filter("n_tie > 1"), "mix-tie")
    n_ties = ties.count()
    single = rows.withColumn("nth", F.lit(0).cast("long"))
    if n_ties:
        few = F.broadcast(ties) if n_ties <= SENT else ties
        total = ties.agg(F.sum("n_tie")).first()[0]
        single = rows.join(few, "tie", "left_anti").withColumn("nth", F.lit(0).cast("long"))
        tied = _numbered(written(rows.join(few, "tie", "left_semi"), "mix-tied"), total)
        single = single.unionByName(tied.select(*single.columns))
    n_sources = facts.count()
    known = single.join(F.broadcast(facts), "source_key") if n_sources <= SENT else with_groups(single, facts, "source_key", "rows", facts.agg(F.sum("rows")).first()[0])
    copies = F.col("whole") + F.when(F.col("draw") <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    taken = _rated(known, cap, seed).withColumn("copies", copies).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
