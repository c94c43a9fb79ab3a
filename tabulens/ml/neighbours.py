"""Nearest neighbours without a cross join, and what is built on them: kNN votes and minority oversampling.

Points within `BROADCAST_BYTES` are sent to the tasks that hold the queries. Otherwise the points are cut into blocks of
bounded size by halving a sample of them; a query visits one block near it to bound its k-th distance, then only the blocks
whose box can still beat that bound. Inside a task the same halving rules out most points of a block. A popular block is
copied to several tasks, each with a share of its queries, so neither a dense cluster nor a heap of identical rows ends in one task.

On wide vectors distance ranges rule out little, and the exact form visits most blocks. `knn_lists` is the form with a bounded
number of visits: points lie in the lists of their two nearest centroids, a query looks into the lists of its `probes` nearest ones.
Its recall is measured by `recall_of` against the exact form for a set of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens import fixed_values as fv
from tabulens.functions.columns import col, row_hash, unit_hash
from tabulens.ml.split import bounded_sample, class_counts
from tabulens.plans.ordered import row_numbers
from tabulens.plans.workspace import written

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 20_000
MAX_BLOCKS = 10_000
#: Points that the cells are cut on; rows of a leaf inside a task; queries that are measured together; pairs held before the best are chosen,
#: and measured at once.
CELL_SAMPLE, LEAF_ROWS, QUERY_ROWS, HELD_PAIRS, EXACT_ROWS = 40_000, 512, 1024, 1_000_000, 50_000
PAIR_ROWS = "qid long, nid long, dist double, nvec array<double>"


def kd_splits(x: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(axis, cut) by heap node, halving the widest axis of each part of more than `size` rows, and the rows of each leaf.

    Rows up to the cut go left. Smaller parts, and heaps of equal rows, go left whole, so that all leaves lie on one level.
    """
    parts, splits = [np.arange(len(x))], []
    while max(len(p) for p in parts) > size:
        here, further = [], []
        for p in parts:
            axis, cut, left = 0, np.inf, np.ones(len(p), bool)
            if len(p) > size:
                spread = x[p].max(0) - x[p].min(0)
                axis = int(spread.argmax())
                if spread[axis] > 0:
                    v = x[p, axis]
                    cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
                    cut = cut if cut < v.max() else v[v < cut].max()  # neither side is empty
                    left = v <= cut
            here.append((axis, cut))
            further += [p[left], p[~left]]
        if not any(len(p) for p in further[1::2]):
            break  # heaps of equal rows only
        parts, splits = further, splits + here
    return np.array(splits).reshape(-1, 2), parts


def kd_leaf(x: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """The leaf of each row, numbered from 0."""
    at, rows, levels = np.zeros(len(x), np.int64), np.arange(len(x)), int(len(splits) + 1).bit_length() - 1
    for _ in range(levels):
        axis, cut = splits[at, 0].astype(np.int64), splits[at, 1]
        at = 2 * at + 1 + (x[rows, axis] > cut)
    return at - len(splits)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each query to each box, which no point of the box is nearer than."""
    total = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        v = q[:, j, None]
        gap = np.maximum(np.maximum(low[None, :, j] - v, v - high[None, :, j]), 0)
        total += gap * gap
    return np.sqrt(total)


class Points:
    """Points in leaves of about LEAF_ROWS rows at most, each with its box."""

    def __init__(self, p: np.ndarray, pid: np.ndarray):
        leaves = [rows for rows in kd_splits(p, LEAF_ROWS)[1] if len(rows)] if len(p) else []
        order = np.concatenate(leaves) if leaves else np.arange(0)
        self.p, self.pid, self.half = p[order], pid[order], (p[order] * p[order]).sum(1)
        self.sizes = np.array([len(rows) for rows in leaves], int)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low = np.array([p[rows].min(0) for rows in leaves])
        self.high = np.array([p[rows].max(0) for rows in leaves])


def nearest(q: np.ndarray, qid: np.ndarray, points: Points, k: int, skip_self: bool):
    """Per query the k nearest points as (query row, point rows, distances); equal distances go to the smaller id.

    The two leaves next to a query bound its k-th distance; only leaves whose box lies within that bound are measured.
    """
    for start in range(0, len(q) if len(points.pid) else 0, QUERY_ROWS):
        part, ids = q[start : start + QUERY_ROWS], qid[start : start + QUERY_ROWS]
        far = box_distances(part, points.low, points.high)
        home, near = np.zeros(far.shape, bool), min(2, far.shape[1])
        home[np.arange(len(part))[:, None], np.argpartition(far, near - 1, axis=1)[:, :near]] = True
        open_bound = np.full(len(part), np.inf)
        bound = _kth(_measured(part, ids, points, home, open_bound, k, skip_self), len(part), k)
        found = _measured(part, ids, points, far <= bound[:, None] * (1 + 1e-9) + 1e-12, bound, k, skip_self)
        i, rows, dist = found
        ends = np.flatnonzero(np.diff(np.append(i, -1)))
        for a, b in zip(np.r_[0, ends[:-1] + 1], ends + 1):
            yield start + int(i[a]), rows[a:b], dist[a:b]


def _kth(found, n: int, k: int) -> np.ndarray:
    """The k-th distance of each of n queries, infinite where fewer are found."""
    i, _, dist = found
    bound = np.full(n, np.inf)
    last = np.cumsum(np.bincount(i, minlength=n)) - 1
    whole = np.bincount(i, minlength=n) >= k
    bound[whole] = dist[last[whole]]
    return bound


def _measured(q, qid, points, seen, bound, k, skip_self):
    """(query row, point row, distance) of each query's k nearest among the points of the leaves it sees, in order."""
    norm, bound, kept, waiting, held = (q * q).sum(1), bound.copy(), None, [], 0
    for leaf in np.flatnonzero(seen.any(0)):
        own, a, b = np.flatnonzero(seen[:, leaf]), points.starts[leaf], points.starts[leaf] + points.sizes[leaf]
        for c in range(a, b, HELD_PAIRS // QUERY_ROWS):  # a heap of equal points is one leaf
            d = min(b, c + HELD_PAIRS // QUERY_ROWS)
            rough = points.half[c:d] - 2 * q[own] @ points.p[c:d].T + norm[own, None]
            edge = bound[own, None]
            if skip_self:
                rough[points.pid[None, c:d] == qid[own, None]] = np.inf
            if d - c > k:  # what lies behind the leaf's own k-th need not be kept
                edge = np.minimum(edge, np.sqrt(np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1 : k], 0)))
            # Rounding of the fast form is far below this margin; what is inside it is measured exactly.
            i, j = np.nonzero((rough <= edge * edge + 1e-9 * (1 + norm[own, None] + edge * edge)) & (rough < np.inf))
            i, j = own[i], j + c
            exact = [np.sqrt(((points.p[j[e : e + EXACT_ROWS]] - q[i[e : e + EXACT_ROWS]]) ** 2).sum(1)) for e in range(0, len(i), EXACT_ROWS)]
            waiting.append((i, j, np.concatenate(exact) if exact else np.zeros(0)))
            held += len(i)
            if held > HELD_PAIRS:
                kept = _best(waiting, points, k)
                bound, waiting, held = np.minimum(bound, _kth(kept, len(q), k)), [kept], 0
    return _best(waiting, points, k)


def _best(parts, points, k):
    """Each query's first k by distance, then id."""
    i, j, dist = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in enumerate((int, int, float)))
    order = np.lexsort((points.pid[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], dist[keep]


def _pairs(q, qid, points: Points, k, skip_self, with_vectors) -> pd.DataFrame:
    out = {"qid": [], "nid": [], "dist": [], "nvec": []}
    for i, rows, dist in nearest(q, qid, points, k, skip_self):
        out["qid"] += [int(qid[i])] * len(rows)
        out["nid"] += points.pid[rows].tolist()
        out["dist"] += dist.tolist()
        out["nvec"] += [v.tolist() for v in points.p[rows]] if with_vectors else [None] * len(rows)
    return pd.DataFrame(out)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def knn(queries: DataFrame, points: DataFrame, k: int, skip_self: bool = False, with_vectors: bool = False,
        broadcast_bytes: int | None = None, block_rows: int | None = None) -> DataFrame:
    """Both frames hold (id long, vec array<double>) -> (qid, nid, dist, rank[, nvec]); exact, ties by id."""
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    first = points.select(F.size("vec").alias("d")).first()
    width = first["d"] if first else 0
    n = points.count()
    if n * (width + 1) * 8 <= limit:
        pairs = _knn_broadcast(queries, points, k, skip_self, with_vectors)
    else:
        pairs = _knn_blocks(queries, points, n, k, skip_self, with_vectors, block_rows or BLOCK_ROWS)
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked if with_vectors else ranked.drop("nvec")


def _knn_broadcast(queries, points, k, skip_self, with_vectors):
    local = points.select("id", "vec").toArrow()  # no object a row: the driver holds the numbers alone
    if not local.num_rows:
        return queries.sparkSession.createDataFrame([], PAIR_ROWS)
    cells = local["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(local.num_rows, -1)
    shared = queries.sparkSession.sparkContext.broadcast(Points(cells, local["id"].to_numpy()))
    del local, cells

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield _pairs(_matrix(b["vec"]), b["id"].to_numpy(), shared.value, k, skip_self, with_vectors)

    return queries.select("id", "vec").mapInPandas(scan, PAIR_ROWS)


def _knn_blocks(queries, points, n, k, skip_self, with_vectors, block_rows):
    spark = queries.sparkSession
    # At most about 2 * MAX_BLOCKS blocks, so that their boxes fit the driver and a broadcast.
    block_rows = max(block_rows, n // MAX_BLOCKS)
    wanted = max(1, math.ceil(n / block_rows))
    sample = _matrix(bounded_sample(points.select("id", "vec"), "id", CELL_SAMPLE).toPandas()["vec"])
    splits = kd_splits(sample, max(1, math.ceil(len(sample) / wanted)))[0]
    width = sample.shape[1]

    @F.pandas_udf("int")
    def own_cell(vec: pd.Series) -> pd.Series:
        return pd.Series(kd_leaf(_matrix(vec), splits).astype("int32"))

    celled = written(points.select("id", "vec", own_cell("vec").alias("cell")), "cells")
    parts = {r["cell"]: math.ceil(r["count"] / block_rows) for r in celled.groupBy("cell").count().collect()}  # a row per cell
    offset, at = {}, 0
    for c in sorted(parts):
        offset[c], at = at, at + parts[c]
    places = spark.createDataFrame([(c, parts[c], offset[c]) for c in parts], "cell int, parts int, start int")
    blocked = celled.join(F.broadcast(places), "cell").select(
        "id", "vec", "cell", (F.col("start") + F.pmod(row_hash(F.col("id"), 5), F.col("parts"))).cast("int").alias("block"))
    blocked = written(blocked, "blocks")
    ends = [f(F.get("vec", F.lit(i))) for f in (F.min, F.max) for i in range(width)]
    facts = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.array(*ends[:width]).alias("low"), F.array(*ends[width:]).alias("high")).orderBy("block").toPandas()
    blocks, full = facts["block"].to_numpy(), facts["n"].to_numpy() > k
    low, high = _matrix(facts["low"]), _matrix(facts["high"])

    @F.pandas_udf("int")
    def home_block(vec: pd.Series) -> pd.Series:
        x, out = _matrix(vec), []
        for a in range(0, len(x), QUERY_ROWS):  # the distances to all blocks are held for a few queries at a time
            d = box_distances(x[a : a + QUERY_ROWS], low, high)
            d[:, ~full] += 1e300 if full.any() else 0
            out.append(blocks[d.argmin(1)])
        return pd.Series(np.concatenate(out).astype("int32") if out else np.zeros(0, "int32"))

    homed = written(queries.select("id", "vec").withColumn("block", home_block("vec")), "queries")
    own = written(_scan_blocks(homed, blocked, k, skip_self, with_vectors, block_rows), "own")
    bound = own.groupBy("qid").agg(F.count(F.lit(1)).alias("m"), F.max("dist").alias("far"))
    bounds = bound.select("qid", F.when(F.col("m") >= k, F.col("far")).alias("bound"))
    visits = homed.join(bounds, homed["id"] == bounds["qid"], "left").select("id", "vec", "block", "bound")
    visits = visits.mapInPandas(lambda batches: _reached(batches, blocks, low, high), "id long, vec array<double>, blocks array<int>").select("id", "vec", F.explode("blocks").alias("block"))
    return own.unionByName(_scan_blocks(written(visits, "visits"), blocked, k, skip_self, with_vectors, block_rows))


def _reached(batches: Iterator[pd.DataFrame], blocks: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each query with the blocks besides its own whose box lies within its bound; lists of a few queries at a time."""
    for b in batches:
        for a in range(0, len(b), QUERY_ROWS):
            part = b.iloc[a : a + QUERY_ROWS]
            reach = part["bound"].astype(float).fillna(np.inf).to_numpy()[:, None]
            near = box_distances(_matrix(part["vec"]), low, high) <= reach * (1 + 1e-9) + 1e-12
            near &= blocks[None, :] != part["block"].to_numpy()[:, None]
            yield pd.DataFrame({"id": part["id"], "vec": part["vec"], "blocks": [blocks[row].astype("int32") for row in near]})


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (centre * centre).sum(1)[None, :] - 2 * x @ centre.T
    return np.sqrt(np.maximum(d, 0))


def _scan_blocks(visits, blocked, k, skip_self, with_vectors, block_rows):
    """Join queries to their blocks; a block with many queries is copied once per share of `block_rows` queries."""
    shares = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("shares"))
    left = visits.join(F.broadcast(shares), "block").select(
        "id", "vec", "block", F.pmod(row_hash(F.col("id"), 9), F.col("shares")).cast("int").alias("share"))
    right = blocked.join(F.broadcast(shares), "block").select(
        "id", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def scan(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"qid": [], "nid": [], "dist": [], "nvec": []})
        return _pairs(_matrix(q["vec"]), q["id"].to_numpy(), Points(_matrix(p["vec"]), p["id"].to_numpy()), k, skip_self, with_vectors)

    return left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInPandas(scan, PAIR_ROWS)


#: Points of a list, lists, points the centroids are found on (smallest hashes first), rounds of finding, lists of a query, at most.
LIST_ROWS, MAX_LISTS, CENTROID_SAMPLE, CENTROID_ROUNDS, PROBES = 1_000, 16_384, 40_000, 6, 12


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of the sample by rounds of assigning and averaging, from evenly spread rows of it; empty ones stay where they are."""
    centre = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(CENTROID_ROUNDS):
        at = np.concatenate([_distances(sample[a:a + 2048], centre).argmin(1) for a in range(0, len(sample), 2048)])
        n = np.bincount(at, minlength=len(centre))
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(sample[order], np.r_[0, np.cumsum(n)[:-1]][n > 0], axis=0)
        centre[n > 0] = sums / n[n > 0][:, None]
    return centre


def knn_lists(queries: DataFrame, points: DataFrame, k: int, skip_self: bool = False, probes: int = PROBES, with_vectors: bool = False, list_rows: int | None = None) -> DataFrame:
    """(qid, nid, dist, rank[, nvec]) of the k nearest points among the lists that a query visits: at most `probes` of them.

    Every point is in the lists of its two nearest centroids, so visits grow as rows of queries and lists as rows of points;
    long lists are cut and popular ones copied for shares of their queries. Fewer than k points are found only
    where the visited lists hold fewer. Ids are unique; ties go to the smaller id; empty frames give no rows.
    """
    size = list_rows or LIST_ROWS
    n = points.count()
    sample = bounded_sample(points.select("id", "vec"), "id", CENTROID_SAMPLE).toPandas()
    if sample.empty:
        return queries.sparkSession.createDataFrame([], PAIR_ROWS + ", rank int")
    centre = centroids(_matrix(sample["vec"]), max(1, min(MAX_LISTS, math.ceil(n / size))))

    def nearest_lists(many: int):
        @F.pandas_udf("array<int>")
        def run(vec: pd.Series) -> pd.Series:
            d = _distances(_matrix(vec), centre)
            m = min(many, d.shape[1])
            return pd.Series(list(np.argpartition(d, m - 1, axis=1)[:, :m].astype("int32")))
        return run

    listed = written(points.select("id", "vec", F.explode(nearest_lists(2)("vec")).alias("list")), "lists")
    parts = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(8 * size)).cast("int").alias("parts"))  # a row per list
    # A list of more than eight times its share is cut into parts; a query visits all of them.
    cut = F.col("list") + MAX_LISTS * F.pmod(row_hash(F.col("id"), 5), F.col("parts")).cast("int")
    blocked = written(listed.join(F.broadcast(parts), "list").select("id", "vec", cut.alias("block")), "blocks")
    visits = queries.select("id", "vec", F.explode(nearest_lists(probes)("vec")).alias("list")).join(F.broadcast(parts), "list")
    visits = visits.select("id", "vec", F.explode(F.sequence(F.col("list"), F.col("list") + MAX_LISTS * (F.col("parts") - 1), F.lit(MAX_LISTS))).alias("block"))
    pairs = _scan_blocks(written(visits, "visits"), blocked, k, skip_self, with_vectors, 8 * size)
    once = pairs.dropDuplicates(["qid", "nid"])
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    ranked = once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked if with_vectors else ranked.drop("nvec")


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(qid, n, n_found): exact neighbours of each query, and how many of them were found."""
    hit = found.select("qid", "nid", F.lit(1).alias("hit"))
    return exact.select("qid", "nid").join(hit, ["qid", "nid"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found"))


def knn_classify(queries: DataFrame, points: DataFrame, labels: DataFrame, k: int = fv.NEIGHBOURS, skip_self: bool = False, **sizes) -> DataFrame:
    """Majority vote of the k nearest: (id, prediction, votes); equal votes go to the smaller label. `labels` is (id, label)."""
    named = knn(queries, points, k, skip_self, **sizes).join(labels.select(F.col("id").alias("nid"), "label"), "nid")
    votes = named.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy(F.col("qid").alias("id")).agg(
        F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("prediction"), F.max("votes").alias("votes"))


def smote(df: DataFrame, label: str, key: str = "id", vec: str = "vec", k: int = fv.NEIGHBOURS, seed: int = fv.SEED, **sizes) -> DataFrame:
    """Synthetic rows (label, new_id, base_id, neighbour_id, u, vec) that lift every class to the size of the largest.

    Classes of one row are left alone. The new rows come from a distributed range, not from copies of a base row.
    """
    counts = class_counts(df, label)
    largest, made_before, todo = max(counts.values()), 0, []
    for c, m in counts.items():
        if c is not None and 1 < m < largest:
            todo.append((c, m, made_before))
            made_before += largest - m

    def one(task):
        c, m, before = task
        own = df.filter(col(label) == F.lit(c)).select(col(key).cast("long").alias("id"), col(vec).cast("array<double>").alias("vec"))
        made = _smote_class(own, m, largest - m, min(k, m - 1), seed, sizes)
        return made.select(F.lit(c).cast(df.schema[label].dataType).alias(label), (F.col("id") + before).alias("new_id"),
                           "base_id", "neighbour_id", "u", "vec")

    # What the classes send to all tasks stays within the limit together.
    sizes = {"broadcast_bytes": BROADCAST_BYTES // max(1, len(todo))} | sizes
    with ThreadPoolExecutor(4) as threads:
        parts = list(threads.map(one, todo))
    if not parts:
        return df.sparkSession.createDataFrame([], f"{label} {df.schema[label].dataType.simpleString()}, new_id long, base_id long, neighbour_id long, u double, vec array<double>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _smote_class(own, m, need, k, seed, sizes):
    pairs = knn(own, own, k, skip_self=True, with_vectors=True, **sizes)
    around = pairs.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "nid", "nvec"))).alias("around"))
    placed = row_numbers(own, [F.col("id")], "place")
    bases = written(placed.join(around, placed["id"] == around["qid"]).select(
        (F.col("place") - 1).alias("place"), F.col("id").alias("base_id"), F.col("vec").alias("base"), "around"), "bases")
    new = own.sparkSession.range(need).withColumn("place", F.col("id") % F.lit(m))
    width = bases.select(F.size("base")).first()[0]
    small = m * (k + 1) * (width + 2) * 8 <= sizes["broadcast_bytes"]
    joined = new.join(F.broadcast(bases) if small else bases, "place")
    pick = F.element_at("around", (F.floor(unit_hash(F.col("id"), seed) * F.lit(k)) + 1).cast("int"))
    chosen = joined.select(new["id"].alias("id"), "base_id", "base", pick.alias("to"), unit_hash(F.col("id"), seed + 1).alias("u"))
    mixed = F.zip_with("base", F.col("to.nvec"), lambda a, b: a + F.col("u") * (b - a))
    return chosen.select("id", "base_id", F.col("to.nid").alias("neighbour_id"), "u", mixed.alias("vec"))
