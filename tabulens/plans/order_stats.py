"""Exact quantiles and k-th smallest values without sorting or moving the rows.

Up to `SMALL_VALUES` values Spark's exact `percentile` is used; its state is bounded by that check. Beyond it,
`percentile_approx` brackets every wanted rank, one counting pass proves the bracket, and the few values left inside
it are ranked. Every pass is an aggregate with map-side combining, so hot values and skewed inputs cost nothing extra.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

SMALL_VALUES = 400_000
BRACKET_VALUES = 200_000
ACCURACY = 10_000
COARSE = 1_000
TARGETS_PER_JOB = 60


def value_counts_of(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Non-null count of each expression, one aggregate."""
    if not values:
        return {}
    row = df.agg(*[F.count(v).alias(f"c{i}") for i, v in enumerate(values.values())]).first()
    return {name: row[i] for i, name in enumerate(values)}


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    small_values: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each double expression."""
    if not values:
        return {}
    small_values = SMALL_VALUES if small_values is None else small_values
    counts = counts or value_counts_of(df, values)
    if sum(counts.values()) <= small_values:
        wanted = F.array(*[F.lit(p) for p in probabilities])
        row = df.agg(*[F.percentile(v, wanted).alias(f"q{i}") for i, v in enumerate(values.values())]).first()
        return {name: list(row[i] or [None] * len(probabilities)) for i, name in enumerate(values)}
    targets, places = {}, {}
    for name, v in values.items():
        for p in probabilities:
            if counts[name] == 0:
                continue
            place = p * (counts[name] - 1)
            low = math.floor(place)
            high = min(low + 1, counts[name] - 1) if place > low else low
            places[name, p] = (low, high, place - low)
            targets[name, low] = (v, low + 1, counts[name])
            targets[name, high] = (v, high + 1, counts[name])
    found = kth_values(df, targets)
    out = {}
    for name in values:
        out[name] = []
        for p in probabilities:
            if (name, p) not in places:
                out[name].append(None)
                continue
            low, high, part = places[name, p]
            a, b = found[name, low][0], found[name, high][0]
            out[name].append(float(a + (b - a) * part))
    return out


def kth_values(df: DataFrame, targets: dict, bracket_values: int | None = None) -> dict:
    """`{key: (expression, k, non-null count)}` -> `{key: (k-th smallest value, rows strictly below it)}`, exact."""
    limit = BRACKET_VALUES if bracket_values is None else bracket_values
    keys, done = list(targets), {}
    for start in range(0, len(keys), TARGETS_PER_JOB):
        batch = {key: targets[key] for key in keys[start : start + TARGETS_PER_JOB]}
        done.update(_kth_batch(df, batch, limit))
    return done


def _kth_batch(df, targets, limit):
    # Open bracket (low, high) per target; None means unbounded. `below` counts the rows at or under `low`.
    state = {key: [None, None, 0, n] for key, (_, _, n) in targets.items()}
    done = {}
    while True:
        wide = [key for key in state if key not in done and state[key][3] > limit]
        if not wide:
            break
        guess = _guess_ends(df, targets, state, wide)
        tally = _count_around(df, targets, guess)
        for key in wide:
            a, b = guess[key]
            under, at_a, between, at_b = tally[id(targets[key][0]), a, b]
            if a == b:
                at_b = 0
            k, old = targets[key][1], state[key]
            if k <= under:
                state[key] = [old[0], a, old[2], under - old[2]]
            elif k <= under + at_a:
                done[key] = (a, under)
            elif k <= under + at_a + between:
                state[key] = [a, b, under + at_a, between]
            elif k <= under + at_a + between + at_b:
                done[key] = (b, under + at_a + between)
            else:
                upto = under + at_a + between + at_b
                state[key] = [b, old[1], upto, old[2] + old[3] - upto]
    rest = [key for key in state if key not in done]
    if rest:
        done.update(_rank_inside(df, {key: (targets[key], state[key]) for key in rest}))
    return done


def _inside(value, low, high):
    keep = value.isNotNull()
    if low is not None:
        keep = keep & (value > F.lit(low))
    if high is not None:
        keep = keep & (value < F.lit(high))
    return keep


def _same_bracket(targets, state, keys):
    """Targets of one expression and one bracket share their aggregates: {(expression id, low, high): [key]}."""
    groups = {}
    for key in keys:
        groups.setdefault((id(targets[key][0]), state[key][0], state[key][1]), []).append(key)
    return groups


def _guess_ends(df, targets, state, wide):
    """A value a little under and one a little over every wanted rank, from one sketch per bracket."""
    groups, sketches = _same_bracket(targets, state, wide), []
    for i, keys in enumerate(groups.values()):
        value, (low, high, _, _) = targets[keys[0]][0], state[keys[0]]
        ends = []
        accuracy = _accuracy(state[keys[0]][3])
        for key in keys:
            middle, margin = (targets[key][1] - state[key][2] - 0.5) / state[key][3], 3.0 / accuracy
            ends += [F.lit(max(0.0, middle - margin)), F.lit(min(1.0, middle + margin))]
        sketches.append(F.percentile_approx(F.when(_inside(value, low, high), value), F.array(*ends), accuracy).alias(f"g{i}"))
    row = df.agg(*sketches).first()
    return {key: tuple(row[i][2 * j : 2 * j + 2]) for i, keys in enumerate(groups.values()) for j, key in enumerate(keys)}


def _accuracy(rows):
    """A coarse sketch where one round is enough, the fine one where it saves a pass over the data."""
    return COARSE if COARSE < ACCURACY and rows * 6 / COARSE <= BRACKET_VALUES else ACCURACY


def _count_around(df, targets, guess):
    """{(expression id, a, b): rows under a, at a, strictly between, at b}."""
    spots = {(id(targets[key][0]), *ends): targets[key][0] for key, ends in guess.items()}
    counters = []
    for (_, a, b), value in spots.items():
        counters += [F.count_if(value < F.lit(a)), F.count_if(value == F.lit(a)),
                     F.count_if((value > F.lit(a)) & (value < F.lit(b))), F.count_if(value == F.lit(b))]
    row = df.agg(*[c.alias(f"t{i}") for i, c in enumerate(counters)]).first()
    return {spot: tuple(row[4 * i : 4 * i + 4]) for i, spot in enumerate(spots)}


def _rank_inside(df, open_targets):
    """Count the distinct values left in each bracket and read off the wanted ranks."""
    targets, state = {k: t for k, (t, _) in open_targets.items()}, {k: s for k, (_, s) in open_targets.items()}
    groups = _same_bracket(targets, state, list(open_targets))
    conditions = [(targets[keys[0]][0], _inside(targets[keys[0]][0], *state[keys[0]][:2])) for keys in groups.values()]
    pairs = [F.when(c, F.struct(F.lit(i).alias("t"), v.alias("v"))) for i, (v, c) in enumerate(conditions)]
    held = df.filter(reduce(lambda a, b: a | b, [c for _, c in conditions]))
    counted = held.select(F.explode(F.array(*pairs)).alias("p")).filter(F.col("p").isNotNull()).groupBy(
        F.col("p.t").alias("t"), F.col("p.v").alias("v")).count()
    placed = counted.withColumn("upto", F.sum("count").over(Window.partitionBy("t").orderBy("v")))
    need = [F.array(*[F.lit(targets[k][1] - state[k][2]) for k in keys]) for keys in groups.values()]
    wanted = F.element_at(F.array(*need), F.col("t") + 1)
    hits = F.filter(wanted, lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("count") < k))
    rows = placed.withColumn("hits", hits).filter(F.size("hits") > 0).collect()
    out, order = {}, list(groups.values())
    for r in rows:
        for key in order[r["t"]]:
            if targets[key][1] - state[key][2] in r["hits"]:
                out[key] = (r["v"], state[key][2] + r["upto"] - r["count"])
    return out
