"""Random forests on a table that is binned once: MLlib's estimators and models, grown with few passes.

Every tree draws its rows by a hash of row and tree (Poisson counts of mean one) and, in each node, its features by a hash of tree
and node. Nodes of more than TASK_ROWS drawn rows are split in step: tasks add up the sums of all trees' open nodes, one pass a level.
The rows of any smaller node travel once to one task, which grows the rest of the tree below it. Thresholds, impurities,
stopping rules and pruning are MLlib's, and so is the model: the nodes are written in its saved form and loaded.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from math import ceil, exp, factorial, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.plans.workspace import Scratch, new_path, rows_frame, written

#: Rows of a packed block; drawn rows of a node up to which one task grows what lies below it; bytes of rows sent to such tasks at
#: once; cells of sums that a task holds at once.
BLOCK_ROWS, TASK_ROWS, SENT_BYTES, CELLS = 1 << 16, 1_000_000, 8 << 30, 1 << 22
#: How often a row is drawn, by 16 bits of its hash.
DRAWN = np.searchsorted(np.cumsum([exp(-1) / factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
NODES = "tree int, node long, feature int, cut int, gain double, raw long, stats array<double>"


@dataclass(frozen=True)
class Growth:
    """What the tasks know of a forest: `classes` is 0 where numbers are learned, `chosen` counts the features a node looks at."""

    trees: int
    depth: int
    width: int
    bins: int
    classes: int
    chosen: int
    seed: int

    @property
    def kind(self) -> np.dtype:
        return np.min_scalar_type(self.bins)

    @property
    def label(self) -> np.dtype:
        return np.dtype(np.int32 if self.classes else np.float64)

    def features(self, tree: int, nodes: np.ndarray) -> np.ndarray:
        """The features each node looks at, in order: (nodes, chosen)."""
        x = _mixed(nodes.astype(np.uint64) + _mixed(np.array([self.seed % 2**32 * 2**20 + tree], np.uint64)))
        marks = _mixed(x[:, None] + np.arange(1, self.width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        return np.sort(np.argsort(marks, axis=1, kind="stable")[:, :self.chosen], axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(first: int, rows: int, trees: list[int], seed: int):
    """(tree, how often each row is in it) for rows numbered from `first`; one hash serves four trees."""
    ids, at, words = np.arange(first, first + rows, dtype=np.uint64), None, None
    for tree in trees:
        if tree // 4 != at:
            at = tree // 4
            words = _mixed(ids + _mixed(np.array([seed % 2**32 * 2**20 + at], np.uint64)))
        yield tree, DRAWN[((words >> np.uint64(16 * (tree % 4))) & np.uint64(0xFFFF)).astype(np.int64)]


# Binned rows ----------------------------------------------------------------------------------------------------

def thresholds(df: DataFrame, width: int, most_bins: int, rows: int, seed: int) -> list[np.ndarray]:
    """MLlib's candidate thresholds of columns v (values) and w (weight): midpoints of a sample's distinct values, or of its quantiles."""
    need = max(most_bins**2, 10_000)
    sample = df if rows <= need else df.sample(fraction=need / rows, seed=seed)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        value, n = pdf["value"].to_numpy(), pdf["n"].to_numpy()
        middle = value[:-1] / 2 + value[1:] / 2
        if len(middle) >= most_bins:
            stride = n.sum() / most_bins
            sums, target, found = n.cumsum(), stride, []
            for i in range(1, len(value)):
                if abs(sums[i - 1] - target) < abs(sums[i] - target):
                    found.append(i - 1)
                    target += stride
            middle = middle[found]
        return pd.DataFrame({"feature": [int(pdf["feature"].iloc[0])], "cuts": [middle[:most_bins - 1].tolist()]})

    cells = sample.select(F.posexplode("v").alias("feature", "value"), "w").groupBy("feature", "value").agg(F.sum("w").alias("n"))
    found = {r["feature"]: r["cuts"] for r in cells.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()}  # fewer than max_bins a feature
    return [np.array(found.get(j, []), float) for j in range(width)]


def packed(df: DataFrame, g: Growth, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of rows: number of the first, bins (rows x features), labels, weights. A value lies in the bin of the first edge that is not below it."""
    def block(batches):
        b = pa.Table.from_batches(batches)
        x = np.asarray(b["v"].combine_chunks().flatten()).reshape(b.num_rows, g.width)
        bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(g.kind)
        y = np.asarray(b["y"]).astype(g.label)
        return pa.RecordBatch.from_arrays([pa.array([b["id"][0].as_py()], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in (bins, y, np.asarray(b["w"], float))]],
                                          names=["first", "bins", "y", "w"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(a, BLOCK_ROWS)
                if n + piece.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
                if piece.num_rows:
                    held.append(piece)
                    n += piece.num_rows
        if held:
            yield block(held)

    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return written(df.withColumn("id", F.monotonically_increasing_id()).mapInArrow(run, "first long, bins binary, y binary, w binary"), "packed")


def _blocks(batches, g: Growth):
    for pdf in batches:
        for first, bins, y, w in zip(pdf["first"], pdf["bins"], pdf["y"], pdf["w"]):
            yield first, np.frombuffer(bins, g.kind).reshape(-1, g.width), np.frombuffer(y, g.label), np.frombuffer(w)


# Sums and splits ------------------------------------------------------------------------------------------------

def _totals(g: Growth, node: np.ndarray, nodes: int, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """MLlib's statistics of each node: weight a class, or weight with first and second moment."""
    if g.classes:
        return np.bincount(node * g.classes + y, w, nodes * g.classes).reshape(nodes, g.classes)
    return np.stack([np.bincount(node, w * y**k, nodes) for k in range(3)], axis=1)


def _sums(g: Growth, node: np.ndarray, looks: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """Weight a class (or weight and first moment), and `extra`, by (node, look, bin)."""
    nodes, parts, flat, first = len(looks), [], bins.ravel(), np.arange(len(node)) * bins.shape[1]
    base = node * g.bins
    classed = base * g.classes + y if g.classes else base
    for s in range(g.chosen):
        own = flat[first + looks[:, s].copy()[node]].astype(np.int64)
        key = base + own if extra is not None or not g.classes else None
        if g.classes:
            out = [np.bincount(classed + own * g.classes, w, nodes * g.bins * g.classes).reshape(nodes, g.bins, g.classes)]
        else:
            out = [np.bincount(key, v, nodes * g.bins).reshape(nodes, g.bins, 1) for v in (w, w * y)]
        if extra is not None:
            out.append(np.bincount(key, extra, nodes * g.bins).reshape(nodes, g.bins, 1))
        parts.append(np.concatenate(out, axis=2))
    return np.stack(parts, axis=1)


def impurity(g: Growth, totals: np.ndarray) -> np.ndarray:
    if g.classes:
        return 1 - ((totals / totals.sum(axis=1, keepdims=True)) ** 2).sum(axis=1)
    return np.maximum(totals[:, 2] / totals[:, 0] - (totals[:, 1] / totals[:, 0]) ** 2, 0.0)


def best_splits(g: Growth, sums: np.ndarray, looks: np.ndarray, totals: np.ndarray):
    """Feature (-1: none), bin up to which rows go left, gain, and the place in `sums`; ties go to the first feature and bin."""
    sums = sums[..., :g.classes or 2]
    left = sums.cumsum(axis=2)[:, :, :-1]
    right = sums.sum(axis=2)[:, :, None] - left
    weigh = lambda s: s.sum(axis=3) if g.classes else s[..., 0]
    a, b = weigh(left), weigh(right)
    score = lambda s, n: ((s**2).sum(axis=3) if g.classes else s[..., 1] ** 2) / np.maximum(n, 1e-300)
    gain = score(left, a) + score(right, b)
    least = totals.sum(axis=1) if g.classes else totals[:, 0]
    gain[(a <= 1e-9 * least[:, None, None]) | (b <= 1e-9 * least[:, None, None])] = -np.inf
    flat = gain.reshape(len(looks), -1)
    best = flat.argmax(axis=1)
    nodes, look, cut = np.arange(len(looks)), best // gain.shape[2], best % gain.shape[2]
    whole = (totals**2).sum(axis=1) if g.classes else totals[:, 1] ** 2
    found = (flat[nodes, best] - whole / least) / least
    mixed = impurity(g, totals)
    use = (found > 1e-9 * mixed) & (mixed > 1e-15)
    return np.where(use, looks[nodes, look], -1), cut, np.where(use, found, -1.0), look


def finish(g: Growth, tree: int, root: int, bins: np.ndarray, y: np.ndarray, count: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    """Everything below a node whose rows are all here."""
    ids, node, w, out = np.array([root], np.int64), np.zeros(len(y), np.int64), w * count, []
    for level in range(int(root + 1).bit_length() - 1, g.depth + 1):
        totals, raw = _totals(g, node, len(ids), y, w), np.bincount(node, count, len(ids)).astype(np.int64)
        feature, cut, gain = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.full(len(ids), -1.0)
        if level < g.depth:
            at_once = max(1, CELLS // (g.chosen * g.bins * (g.classes or 2)))
            for a in range(0, len(ids), at_once):  # rows come in the order of their nodes
                part = slice(*np.searchsorted(node, [a, a + at_once]))
                looks = g.features(tree, ids[a:a + at_once])
                sums = _sums(g, node[part] - a, looks, bins[part], y[part], w[part])
                feature[a:a + at_once], cut[a:a + at_once], gain[a:a + at_once], _ = best_splits(g, sums, looks, totals[a:a + at_once])
        out.append(pd.DataFrame({"tree": tree, "node": ids, "feature": feature, "cut": cut, "gain": gain, "raw": raw, "stats": list(totals)}))
        use = feature >= 0
        if not use.any():
            break
        rows = use[node].nonzero()[0]
        own = node[rows]
        below = 2 * (use.cumsum() - 1)[own] + (bins.ravel()[rows * g.width + feature[own]] > cut[own])
        ids = np.stack([2 * ids[use] + 1, 2 * ids[use] + 2], axis=1).ravel()
        order = np.argsort(below.astype(np.min_scalar_type(len(ids))), kind="stable")
        rows, node = rows[order], below[order]
        bins, y, count, w = bins.take(rows, axis=0), y[rows], count[rows], w[rows]
    return pd.concat(out)


# The forest -----------------------------------------------------------------------------------------------------

class Tops:
    """The parts of all trees that grow in step. Rows end in an open node, in one that waits for its task, or in a leaf."""

    def __init__(self, g: Growth, rows: int):
        self.level, self.records = 0, []
        self.feature, self.cut = [[np.full(1, v, np.int64) for _ in range(g.trees)] for v in (-1, 0)]
        large = rows > TASK_ROWS
        self.open = {t: [0] for t in range(g.trees)} if large else {}
        self.waiting = {t: [] if large else [0] for t in range(g.trees)}

    def split(self, found: list) -> None:
        """Take one level's splits of the open nodes, as rows of NODES with the drawn rows on the left."""
        self.level, self.open = self.level + 1, {}
        for t in range(len(self.feature)):
            grown = 2 ** (self.level + 1) - 1 - len(self.feature[t])
            self.feature[t], self.cut[t] = np.append(self.feature[t], np.full(grown, -1)), np.append(self.cut[t], np.zeros(grown, np.int64))
        for r in found:
            self.records.append((r["tree"], r["node"], r["feature"], r["cut"], r["gain"], r["raw"], list(r["stats"])))
            if r["feature"] >= 0:
                self.feature[r["tree"]][r["node"]], self.cut[r["tree"]][r["node"]] = r["feature"], r["cut"]
                for side, n in enumerate((r["left"], r["raw"] - r["left"])):
                    (self.open if n > TASK_ROWS else self.waiting).setdefault(r["tree"], []).append(2 * r["node"] + 1 + side)

    def ends(self, tree: int, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node in which each of the rows ends."""
        feature, cut, at = self.feature[tree], self.cut[tree], np.zeros(len(rows), np.int64)
        for _ in range(self.level):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > cut[at]))
        return at


def _placed(nodes: list[int], ends: np.ndarray) -> np.ndarray:
    """For each end its place in the sorted nodes, or -1."""
    nodes = np.array(nodes, np.int64)
    place = np.minimum(np.searchsorted(nodes, ends), len(nodes) - 1)
    return np.where(nodes[place] == ends, place, -1)


def _split_level(g: Growth, tops: Tops, blocks: DataFrame) -> list:
    """One pass (more where the sums of all trees pass CELLS): the split of every open node, found in tasks."""
    stats, found = (g.classes or 2) + 1, []
    wanted, last = sorted(tops.open), tops.level == g.depth
    while wanted:
        trees, cells = [], 0
        while wanted and (not trees or cells + len(tops.open[wanted[0]]) * g.chosen * g.bins * stats <= 4 * CELLS):
            trees.append(wanted.pop(0))
            cells += len(tops.open[trees[-1]]) * g.chosen * g.bins * stats

        def add(batches, trees=trees):
            sums = {}
            for first, bins, y, w in _blocks(batches, g):
                for t, count in drawn(first, len(y), trees, g.seed):
                    rows = count.nonzero()[0]
                    nodes = sorted(tops.open[t])
                    place = _placed(nodes, tops.ends(t, bins, rows))
                    rows, place = rows[place >= 0], place[place >= 0]
                    n, own = count[rows].astype(float), y[rows]
                    new = [_totals(g, place, len(nodes), own, w[rows] * n), np.bincount(place, n, len(nodes))]
                    new.append(np.zeros((len(nodes), 0)) if last else _sums(g, place, g.features(t, np.array(nodes)), bins[rows], own, w[rows] * n, n))
                    sums[t] = [a + b for a, b in zip(sums[t], new)] if t in sums else new
            for t, (totals, raw, cells) in sums.items():
                yield pd.DataFrame({"tree": t, "node": sorted(tops.open[t]), "totals": [a.tobytes() for a in totals], "raw": raw, "sums": [a.tobytes() for a in cells]})

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            totals = sum(np.frombuffer(a) for a in pdf["totals"])[None]
            raw, feature, cut, gain, left = int(pdf["raw"].sum()), -1, 0, -1.0, 0
            if not last:
                sums, looks = sum(np.frombuffer(a) for a in pdf["sums"]).reshape(1, g.chosen, g.bins, stats), g.features(tree, np.array([node]))
                (feature,), (cut,), (gain,), (look,) = best_splits(g, sums, looks, totals)
                left = int(sums[0, look, :cut + 1, -1].sum())
            return pd.DataFrame([(tree, node, feature, cut, gain, raw, totals[0], left)], columns=["tree", "node", "feature", "cut", "gain", "raw", "stats", "left"])

        sums = blocks.mapInPandas(add, "tree int, node long, totals binary, raw double, sums binary")
        found += sums.groupBy("tree", "node").applyInPandas(choose, f"{NODES}, left long").collect()  # open nodes
    return found


def _finished(g: Growth, tops: Tops, blocks: DataFrame, trees: list[int]) -> DataFrame:
    """The nodes below all that waits in some of the trees."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    waiting = {t: sorted(tops.waiting.get(t, [])) for t in trees}

    def send(batches):
        for first, bins, y, w in _blocks(batches, g):
            out = []
            for t, count in drawn(first, len(y), [t for t in trees if waiting[t]], g.seed):
                rows = count.nonzero()[0]
                place = _placed(waiting[t], tops.ends(t, bins, rows))
                if len(waiting[t]) > 1 or tops.level:
                    order = np.argsort(place.astype(np.int16 if len(waiting[t]) < 2**15 else np.int64), kind="stable")
                    rows, place = rows[order], place[order]
                ends = np.searchsorted(place, np.arange(len(waiting[t]) + 1))
                out += [(t, waiting[t][k], first, bins[own].tobytes(), y[own].tobytes(), count[own].tobytes(), w[own].tobytes())
                        for k in range(len(waiting[t])) if len(own := rows[ends[k]:ends[k + 1]])]
            yield pd.DataFrame(out, columns=["tree", "node", "first", "bins", "y", "n", "w"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        whole = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        return finish(g, int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0]), whole("bins", g.kind).reshape(-1, g.width), whole("y", g.label), whole("n", np.uint8), whole("w", float))

    sent = blocks.mapInPandas(send, "tree int, node long, first long, bins binary, y binary, n binary, w binary")
    groups = max(1, sum(map(len, waiting.values())))
    return written(sent.repartition(min(groups, 16 * cores), "tree", "node").groupBy("tree", "node").applyInPandas(grow, NODES), "grown")


def _saved_form(g: Growth, edges: list[np.ndarray]):
    """A tree's nodes numbered depth first, siblings that predict alike merged as MLlib does."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = np.array(pdf["stats"].tolist())
        predicted = stats.argmax(axis=1).astype(float) if g.classes else stats[:, 1] / stats[:, 0]
        mixed = impurity(g, stats)
        at = {n: i for i, n in enumerate(pdf["node"].tolist())}
        feature, cut, gain, raw = (pdf[c].tolist() for c in ("feature", "cut", "gain", "raw"))
        for n in sorted(at, reverse=True):
            i = at[n]
            if feature[i] >= 0:
                a, b = at[2 * n + 1], at[2 * n + 2]
                if feature[a] < 0 and feature[b] < 0 and predicted[a] == predicted[b]:
                    feature[i], gain[i] = -1, -1.0
        rows, stack, parents = [], [(0, None, 0)], []
        while stack:
            n, parent, side = stack.pop()
            i, k = at[n], len(rows)
            if parent is not None:
                rows[parent][6 + side] = k
            f = feature[i]
            rows.append([k, predicted[i], mixed[i], stats[i], raw[i], gain[i], -1, -1, f, [float(edges[f][cut[i]])] if f >= 0 else []])
            if f >= 0:
                stack += [(2 * n + 2, k, 1), (2 * n + 1, k, 0)]
        out = pd.DataFrame(rows, columns=["id", "prediction", "impurity", "stats", "raw", "gain", "left", "right", "feature", "threshold"])
        out.insert(0, "tree", int(pdf["tree"].iloc[0]))
        return out
    return run


SAVED = "tree int, id int, prediction double, impurity double, stats array<double>, raw long, gain double, left int, right int, feature int, threshold array<double>"


def forest(estimator, df: DataFrame):
    """The model that MLlib's random forest estimator `estimator` describes, fitted to `df`."""
    return forests([estimator], df)[0]


def forests(estimators: list, df: DataFrame) -> list:
    """The models of estimators that differ in depth and number of trees only, cut from one forest of the most and deepest trees.

    Draws are hashes of row, tree and node, so a smaller forest is the upper part of the first trees of a larger one. A single
    tree looks at all features and shares with no forest of more.
    """
    with Scratch(df.sparkSession):
        nodes, g, edges = _grown(estimators, df)
        return [_model(e, _upper(nodes, e.getNumTrees(), e.getMaxDepth()), replace(g, trees=e.getNumTrees(), depth=e.getMaxDepth()), edges, df.sparkSession) for e in estimators]


def _grown(estimators: list, df: DataFrame) -> tuple[DataFrame, Growth, list[np.ndarray]]:
    """The nodes of the largest forest, in scratch tables of the caller."""
    estimator, classify = estimators[0], isinstance(estimators[0], RandomForestClassifier)
    spark = df.sparkSession
    weight = estimator.getWeightCol() if estimator.isDefined("weightCol") else None
    rows = df.select(vector_to_array(estimator.getFeaturesCol()).alias("v"), F.col(estimator.getLabelCol()).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    n, top, width = rows.agg(F.count(F.lit(1)), F.max("y"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no rows to learn from")
    trees, depth, seed = max(e.getNumTrees() for e in estimators), max(e.getMaxDepth() for e in estimators), estimator.getSeed()
    chosen = width if trees == 1 else ceil(sqrt(width)) if classify else ceil(width / 3)
    edges = thresholds(rows, width, min(estimator.getMaxBins(), n), n, seed)
    g = Growth(trees, depth, width, max(2, *[len(e) + 1 for e in edges]), int(top) + 1 if classify else 0, chosen, seed)
    blocks = packed(rows, g, edges)
    tops = Tops(g, n)
    while tops.open:
        tops.split(_split_level(g, tops, blocks))
    at_once = max(1, int(SENT_BYTES // (0.64 * n * (width * g.kind.itemsize + g.label.itemsize + 9))))
    grown = [_finished(g, tops, blocks, list(range(a, min(trees, a + at_once)))) for a in range(0, trees, at_once)]
    nodes = rows_frame(spark, tops.records, NODES)
    for part in grown:
        nodes = nodes.unionByName(part)
    return nodes, g, edges


def held_cells(estimators: list, df: DataFrame, held: DataFrame) -> list[dict]:
    """{(label, prediction): n} on `held` for each of the classifiers `forests` would give, without making models of them."""
    with Scratch(df.sparkSession):
        nodes, g, edges = _grown(estimators, df)
        label, features, out = estimators[0].getLabelCol(), estimators[0].getFeaturesCol(), {}
        for depth in sorted({e.getMaxDepth() for e in estimators}):
            own = {i: e.getNumTrees() for i, e in enumerate(estimators) if e.getMaxDepth() == depth}
            counts = sorted(set(own.values()))
            most = replace(g, trees=counts[-1], depth=depth)
            saved = _upper(nodes, most.trees, depth).groupBy("tree").applyInPandas(_as_arrays(_saved_form(most, edges)), "tree int, feature binary, threshold binary, child binary, votes binary")
            trees = [tuple(np.frombuffer(bytes(r[c]), t) for c, t in (("feature", "<i4"), ("threshold", "<f8"), ("child", "<i4"), ("votes", "<f8")))
                     for r in sorted(saved.collect(), key=lambda r: r["tree"])]  # a model, as large as MLlib's
            judged = held.select(vector_to_array(features).alias("v"), F.col(label).cast("double").alias("y")).mapInArrow(_judged(trees, most, counts), "trees int, y double, p double, n long")
            found = judged.groupBy("trees", "y", "p").agg(F.sum("n").alias("n")).collect()  # a row per number of trees and pair of classes
            for i, count in own.items():
                out[i] = {(r["y"], r["p"]): r["n"] for r in found if r["trees"] == count}
    return [out[i] for i in range(len(estimators))]


def _as_arrays(saved):
    """A tree in its saved form as one row: feature, threshold, both children (a leaf is its own) and the shares of the classes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = saved(pdf)
        leaf, own = tree["feature"].to_numpy() < 0, tree["id"].to_numpy()
        child = np.stack([np.where(leaf, own, tree[c]) for c in ("left", "right")], axis=1)
        stats = np.array(tree["stats"].tolist())
        total = stats.sum(axis=1, keepdims=True)
        votes = np.where(total != 0, stats / np.where(total != 0, total, 1.0), 0.0)
        threshold = [t[0] if len(t) else np.inf for t in tree["threshold"]]
        cells = [np.where(leaf, 0, tree["feature"]).astype("<i4"), np.array(threshold, "<f8"), child.astype("<i4"), votes.astype("<f8")]
        return pd.DataFrame([(int(tree["tree"].iloc[0]), *[c.tobytes() for c in cells])], columns=["tree", "feature", "threshold", "child", "votes"])
    return run


def _judged(trees: list, g: Growth, counts: list[int]):
    """Votes of the first trees as MLlib adds them up; the first of equal classes is predicted."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = np.asarray(batch["v"].flatten()), np.asarray(batch["y"])
            first, votes = np.arange(batch.num_rows) * g.width, np.zeros((batch.num_rows, g.classes))
            for t, (feature, threshold, child, share) in enumerate(trees):
                at = np.zeros(batch.num_rows, np.int64)
                for _ in range(g.depth):
                    at = child[2 * at + ~(x[first + feature[at]] <= threshold[at])]
                votes += share.reshape(-1, g.classes)[at]
                if t + 1 in counts:
                    found, n = np.unique(np.stack([y, votes.argmax(axis=1)], axis=1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t + 1, np.int32)), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n.astype(np.int64))], names=["trees", "y", "p", "n"])
    return run


def _upper(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """What the first trees hold down to a depth, where every node is a leaf."""
    last = F.col("node") >= 2**depth - 1
    ends = {"feature": F.lit(-1), "cut": F.lit(0), "gain": F.lit(-1.0)}
    return nodes.filter((F.col("tree") < trees) & (F.col("node") < 2 ** (depth + 1) - 1)).withColumns({c: F.when(last, v).otherwise(F.col(c)) for c, v in ends.items()})


def _model(estimator, nodes: DataFrame, g: Growth, edges: list[np.ndarray], spark):
    path = new_path(spark, "forest")
    with Scratch(spark) as scratch:
        scratch.paths.append(path)
        _write(estimator, nodes.groupBy("tree").applyInPandas(_saved_form(g, edges), SAVED), g, path)
        model = (RandomForestClassificationModel if g.classes else RandomForestRegressionModel).load(path)
    return estimator._copyValues(model)


def _write(estimator, nodes: DataFrame, g: Growth, path: str) -> None:
    """A forest as MLlib's models are saved."""
    spark, package = nodes.sparkSession, "org.apache.spark.ml." + ("classification." if g.classes else "regression.")
    suffix = "ClassificationModel" if g.classes else "RegressionModel"
    given, default = ({p.name: v for p, v in m.items()} for m in (estimator._paramMap, estimator._defaultParamMap))
    facts = {"timestamp": 0, "sparkVersion": spark.version, "numFeatures": g.width} | ({"numClasses": g.classes} if g.classes else {})
    one = {"numTrees", "subsamplingRate", "bootstrap", "featureSubsetStrategy"}
    line = {"class": f"{package}RandomForest{suffix}", "uid": estimator.uid, "paramMap": given, "defaultParamMap": default, "numTrees": g.trees} | facts
    of_tree = lambda t: {"class": f"{package}DecisionTree{suffix}", "uid": f"tree_{uuid.uuid4().hex[:12]}_{t}", "paramMap": {k: v for k, v in given.items() if k not in one},
                         "defaultParamMap": {k: v for k, v in default.items() if k not in one}} | facts
    rows_frame(spark, [(json.dumps(line),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    rows_frame(spark, [(t, json.dumps(of_tree(t)), 1.0) for t in range(g.trees)], "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    split = F.struct(F.col("feature").alias("featureIndex"), F.col("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    nodes.select(F.col("tree").alias("treeID"), F.struct("id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
                                                        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split")).alias("nodeData")).write.parquet(f"{path}/data")


class ForestClassifier(RandomForestClassifier):
    """MLlib's estimator, grown by `forest`."""

    def _fit(self, dataset: DataFrame):
        return forest(self, dataset)


class ForestRegressor(RandomForestRegressor):
    """MLlib's estimator, grown by `forest`."""

    def _fit(self, dataset: DataFrame):
        return forest(self, dataset)
