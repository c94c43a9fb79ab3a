"""Near-duplicates on word shingles: MinHash bands find candidates, odd sketches check them, full sets confirm links.

A document's set holds its distinct shingles. BANDS x ROWS MinHash samples are banded, and the same samples are folded into
a parity bitmap: two bitmaps' XOR population count estimates the similarity of the sets. Documents with equal sets are one
node. Nodes that share a band are gathered into chunks of bounded size by the star of each band; full sets decide inside a
chunk, all at once. Only nodes that are not yet connected are then compared across chunks, in rounds: each part asks for exact
tests of its most promising nodes against chunks, first for one, then for more, and parts that turn out linked merge before the
next round. A part stops when every candidate, a pair in a band whose bitmaps agree well enough, is tested or merged. Pairs inside
connected groups are never written out.

At similarity 0.75 a pair shares none of the 32 bands of 4 rows with probability 5e-6, and MIN_ESTIMATE is five standard
deviations of the estimate below.
"""

from __future__ import annotations

import heapq
import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import text_batches, with_groups
from tabulens.llm.interpolation import mix
from tabulens.plans.workspace import Scratch, written

SHINGLE, BANDS, ROWS = 5, 32, 4
SKETCH_WORDS = 8
MIN_ESTIMATE, CLUSTER_ESTIMATE = 0.54, 0.7
#: Nodes of a chunk, nodes of a band compared in one group, queries of a chunk tested in one group, words a task remembers.
CHUNK, BLOCK, QUERIES, REMEMBERED = 512, 1000, 500, 80_000
#: Each round a part may ask for so many times the tests of the round before.
WIDER = 8
#: Narrow rows of one partition of a written step; hot bands that are broadcast, at most; bits of the filter of candidate ids.
NARROW_ROWS, HOT_BANDS, FILTER_BITS = 500_000, 30_000, 1 << 22
#: Narrow rows (a few longs) that are broadcast at most, by their count.
SENT = 150_000
_seed = np.random.default_rng(20240229)
FACTORS = _seed.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _seed.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
SAMPLES = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)


class Shingles:
    """Text to the sorted array of its distinct shingle hashes; remembers word hashes up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(SHINGLE, len(h))
        out = h[:len(h) - k + 1]
        for i in range(1, k):
            out = mix(out, h[i:len(h) - k + 1 + i])
        return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and the odd sketch of a set that is not empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a:a + 2048]
        np.minimum(low, (part[None, :] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=low)
    bands = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        bands = mix(bands, low.reshape(BANDS, ROWS)[:, r])
    bits = mix(low, SAMPLES) % np.uint64(64 * SKETCH_WORDS)
    sketch = np.zeros(SKETCH_WORDS, np.uint64)
    np.bitwise_xor.at(sketch, (bits >> np.uint64(6)).astype(int), np.uint64(1) << (bits & np.uint64(63)))
    return mix(bands, np.arange(BANDS, dtype=np.uint64)).view(np.int64), sketch.tobytes()


def estimated(xor_count: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits: a sample that differs flips two bits at random."""
    n, m = 64.0 * SKETCH_WORDS, float(BANDS * ROWS)
    return 1 + n / (4 * m) * np.log(np.maximum(1 - 2 * xor_count / n, 1e-6))


def _signatures(batches):
    shingle = Shingles()
    for batch in batches:
        rows = []
        for text in batch["text"]:
            s = shingle(text.as_py())
            rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), *signature(s)) if len(s) else (0, None, None, None))
        n, keys, bands, sketches = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tk"], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                                          pa.array(sketches, pa.binary())], names=["doc_id", "tk", "n", "set_key", "bands", "sketch"])


def _sets(bits):
    """Sets of the documents whose id may be a candidate's; the bits spare the others the way through the shuffle. Rows
    without an id share one bit; a task gives each of their sets once, as far as it remembers."""
    def run(batches):
        shingle, seen = Shingles(), set()
        for batch in batches:
            at = batch["bit"].to_numpy()
            batch = batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            rows = [shingle(t.as_py()).tobytes() for t in batch["text"]]
            digests = [xxhash.xxh3_128_digest(r) for r in rows]
            if batch["doc_id"].null_count:
                fresh = []
                for named, digest in zip(batch["doc_id"].is_valid().to_pylist(), digests):
                    fresh.append(named or digest not in seen)
                    if not named:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                batch = batch.filter(pa.array(fresh))
                rows, digests = list(itertools.compress(rows, fresh)), list(itertools.compress(digests, fresh))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], names=["doc_id", "digest", "shingles"])
    return run


def _runs(batches, keys: list[str]):
    """Groups of consecutive equal keys as tables; the rows come sorted by them."""
    held = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        change = np.zeros(len(t), bool)
        for k in keys:
            v = t[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        if held:
            last = held[-1]
            change[0] = any(last[k][len(last) - 1].as_py() != t[k][0].as_py() for k in keys)
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(t)
            continue
        if held or cuts[0] > 0:
            yield pa.concat_tables([*held, t.slice(0, cuts[0])])
        for a, b in itertools.pairwise(cuts.tolist()):
            yield t.slice(a, b - a)
        held = [t.slice(cuts[-1])]
    if held:
        yield pa.concat_tables(held)


class Index:
    """The members of a chunk by shingle, to count the shingles that a set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.keys, self.owner = every[order], owner[order]

    def linked(self, s: np.ndarray) -> np.ndarray:
        """Members whose similarity to `s` is 0.75 or more."""
        a, b = np.searchsorted(self.keys, s, "left"), np.searchsorted(self.keys, s, "right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * shared >= 75 * (len(s) + self.sizes - shared))


def _chunk_parts(batches):
    """Connected parts of each chunk, by full sets: node, part (smallest node)."""
    for t in _runs(batches, ["chunk"]):
        nodes = t["node"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["shingles"]]
        root = np.arange(len(nodes))

        def find(i, root=root):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        if len(nodes) > 1:
            index = Index(sets)
            for i, s in enumerate(sets):
                for j in index.linked(s):
                    x, y = find(i), find(j)
                    if x != y:
                        if nodes[x] > nodes[y]:
                            x, y = y, x
                        root[y] = x
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[find(i) for i in range(len(nodes))]])], names=["node", "part"])


def _asks(width: int):
    """Tests that could connect parts: node, chunk. In each band the smaller of two parts asks, at most `width` tests a part, the
    most promising first; a node asks a chunk once for all of its members, and never again for a chunk it has been tested with."""
    def run(batches):
        for t in _runs(batches, ["key", "p", "q"]):
            part, size, side = t["part"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy()
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
            node, chunk, same = t["node"].to_numpy(), t["chunk"].to_numpy(), t["p"][0].as_py() == t["q"][0].as_py()
            done = t["tested"].to_pylist()
            order = np.lexsort((part, t["part_size"].to_numpy()))
            rank = np.empty(len(node), np.int64)
            rank[order] = np.cumsum(np.r_[0, part[order][1:] != part[order][:-1]])
            asked = {}
            for i in np.flatnonzero(rank < rank.max()):
                ok = rank > rank[i]
                if not same:
                    ok &= side != side[i]
                ok &= (100 * np.minimum(size, size[i]) >= 75 * np.maximum(size, size[i]))
                j = np.flatnonzero(ok)
                if len(j) and done[i]:
                    j = j[~np.isin(chunk[j], done[i])]
                if len(j):
                    e = estimated(np.bitwise_count(sketch[j] ^ sketch[i]).sum(1).astype(float))
                    j, e = j[e >= MIN_ESTIMATE], e[e >= MIN_ESTIMATE]
                    by = np.lexsort((-e, chunk[j]))
                    j, e = j[by], e[by]
                    first = np.flatnonzero(np.r_[True, chunk[j][1:] != chunk[j][:-1]]) if len(j) else j
                    asked.setdefault(part[i], []).extend(zip((-e[first]).tolist(), [int(node[i])] * len(first), chunk[j][first].tolist()))
            found = [x[1:] for tests in asked.values() for x in heapq.nsmallest(width, tests)]
            if found:
                nodes, chunks = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(chunks, pa.int64())], names=["node", "chunk"])
    return run


def _answers(batches):
    """Exact tests of queries against a chunk: part of the query, part it is linked with. Sets and parts are rows of their own."""
    for t in _runs(batches, ["chunk", "salt"]):
        asked, node = t["asks"].to_numpy(zero_copy_only=False).astype(bool), t["node"].to_numpy()
        has_set = t["shingles"].is_valid().to_numpy(zero_copy_only=False)
        part_of = {(a, n): p for a, n, p in zip(asked[~has_set].tolist(), node[~has_set].tolist(), t["part"].filter(pa.array(~has_set)).to_pylist())}
        members = np.flatnonzero(~asked & has_set)
        if not len(members):
            continue
        index = Index([np.frombuffer(t["shingles"][i].as_py(), np.uint64) for i in members.tolist()])
        part = np.array([part_of[False, n] for n in node[members].tolist()])
        out = set()
        for i in np.flatnonzero(asked & has_set).tolist():
            mine = part_of[True, int(node[i])]
            out.update((mine, int(p)) for p in np.unique(part[index.linked(np.frombuffer(t["shingles"][i].as_py(), np.uint64))]) if p != mine)
        if out:
            a, b = zip(*sorted(out))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def narrow(df: DataFrame, rows: int, name: str) -> DataFrame:
    """`written` for narrow rows, about `rows` of them: in as many partitions as they fill, so that many small steps stay cheap."""
    return written(df.coalesce(1 + rows // NARROW_ROWS), name)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for every node of edges(a, b). Labels spread along edges and by pointer
    jumping; every round is written, so that lineage stays short."""
    with Scratch(edges.sparkSession) as scratch:
        both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "near-edge")
        rows = both.count()
        labels = narrow(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), rows, "near-label")
        while True:
            spread = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("x")).agg(F.min("label").alias("seen"))
            step = labels.join(spread, labels["node"] == spread["x"]).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("to"))
            ends = labels.select(F.col("node").alias("e_node"), F.col("label").alias("e_label"))
            after = narrow(step.join(ends, step["to"] == ends["e_node"], "left").select("node", "old", F.coalesce("e_label", "to").alias("label")), rows, "near-label")
            labels = after.select("node", "label")
            if after.filter("label <> old").isEmpty():
                return scratch.keep(after).select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs between ASCII white space with A-Z lower-cased; a set holds the distinct SHINGLE-word shingles, or the
    whole sequence if there are fewer words. Documents are linked when their sets' similarity is 0.75 or more, confirmed on
    full sets. `component_id` is the smallest doc_id reachable over links, and the document that carries it is kept.

    Null and empty texts have an empty set, are linked with nothing and kept. A row with a null doc_id has a null
    component_id, is linked with nothing and kept. Repeated rows get equal results. Rows that share a doc_id but not their
    words are linked each by its own set. Other columns are not read; an empty table gives no rows.
    """
    found = linked_rows(docs, id_col, text_col)
    alone = F.col("part").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nameless: bool = False) -> DataFrame:
    """One row per input row: doc_id, tk (xxhash64 of the text), n, part, component (smallest doc_id of the part).

    A node is a distinct set, named by a hash of its key; its ids play no role in the links. `part` is null for an empty set
    and, unless `nameless`, for a row with a null doc_id; with it such rows are linked like others.
    """
    linkable = F.lit(True) if nameless else F.col("doc_id").isNotNull()
    with Scratch(docs.sparkSession) as scratch:
        sig, ends = (scratch.keep(t) for t in _labelled(docs, id_col, text_col, linkable))
    out = with_groups(sig.select("doc_id", "tk", "n", F.when(linkable, F.col("set_key")).alias("set_key")), ends, "set_key", "copies", sig.count())
    return out.select("doc_id", "tk", "n", "part", "component")


def _labelled(docs: DataFrame, id_col: str, text_col: str, linkable: Column) -> tuple[DataFrame, DataFrame]:
    """The signatures (doc_id, tk, n, set_key and more) of all rows, and for every distinct set: set_key, copies, part, component."""
    text_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), F.coalesce(text, F.lit("")).alias("text"))
    sig = written(d.mapInArrow(_signatures, "doc_id long, tk long, n long, set_key binary, bands array<long>, sketch binary"), "near-sig")
    sets = sig.filter("n > 0").filter(linkable).groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
                                                                       F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(sets.select(F.xxhash64("set_key").alias("node"), "set_key", "first_id", "copies", "n", "bands", "sketch"), "near-node")
    n_nodes = nodes.count()

    # Bands that more than one node has; the star of each band's first node (node names are hashes).
    banded = nodes.select("node", F.explode("bands").alias("key"))
    keys = narrow(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("lead")).filter("members > 1"), n_nodes * BANDS, "near-key")
    # Bands of one node meet nothing: both joins keep members only, so that what they give follows the shared bands.
    hot = F.col("members") > n_nodes * BANDS / HOT_BANDS
    found = banded.join(F.broadcast(keys.filter(hot)), "key").unionByName(banded.join(keys.filter(~hot), "key"))
    members = narrow(found, n_nodes * BANDS, "near-member")
    info = nodes.select("node", "n", "sketch")
    star = members.filter("node <> lead").select("node", "lead").distinct()
    differ = sum(F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(SKETCH_WORDS))
    words = lambda c: F.array(*[F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(SKETCH_WORDS)])
    star = star.join(info.select("node", words(F.col("sketch")).alias("x")), "node").join(info.select(F.col("node").alias("lead"), words(F.col("sketch")).alias("y")), "lead")
    steps = np.arange(32.0 * SKETCH_WORDS)
    most = float(steps[estimated(steps) >= CLUSTER_ESTIMATE].max())
    # A node joins the first of its stars' leads, and with it the lead's own first; what lands apart is tested across chunks.
    first = F.min(F.struct(F.xxhash64("lead").alias("h"), "lead"))["lead"]
    led = narrow(star.filter(differ <= most).groupBy("node").agg(first.alias("lead")), n_nodes, "near-lead")
    above = led.select(F.col("node").alias("lead"), F.col("lead").alias("top"))
    placed = members.select("node").distinct().join(led.join(above, "lead", "left"), "node", "left")
    placed = narrow(placed.select("node", F.coalesce("top", "lead", "node").alias("cluster")), n_nodes, "near-cluster")
    sizes = narrow(placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), n_nodes, "near-size")
    placed = with_groups(placed, sizes, "cluster", "size", placed.count())
    chunk = F.xxhash64("cluster", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("size") / CHUNK)))
    chunks = narrow(placed.select("node", chunk.alias("chunk")), n_nodes, "near-chunk")
    # Copies share a node's set, so the row with the node's smallest id gives it; rows with that id but other words give another digest.
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(4)), F.lit(FILTER_BITS))
    wanted = narrow(chunks.join(nodes.select("node", "set_key", "first_id"), "node"), n_nodes, "near-wanted")
    octets = wanted.select(bit("first_id").alias("bit"))
    octets = octets.groupBy(F.shiftright("bit", 5).alias("at")).agg(
        F.expr("bit_or(shiftleft(CAST(1 AS BIGINT), CAST(bit % 32 AS INT)))").alias("v")).collect()  # FILTER_BITS / 32 rows at most
    bits = np.zeros(FILTER_BITS // 32, "<u4")
    bits[[r["at"] for r in octets]] = [r["v"] for r in octets]
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint8))  # FILTER_BITS / 8 bytes
    made = d.filter(linkable).select("doc_id", "text", bit("doc_id").alias("bit")).mapInArrow(_sets(shared), "doc_id long, digest binary, shingles binary")
    full = made.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("set_key"))).select("node", "chunk", "shingles")
    full = written(full, "near-set")
    if full.count() > wanted.count():  # rows that repeat both an id and its words
        full = written(full.dropDuplicates(["node"]), "near-set")
    parts = full.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_chunk_parts, "node long, part long")
    parts = written(parts.repartition(1 + n_nodes // NARROW_ROWS), "near-part")

    # Parts ask for their best tests, answers merge parts, and what is left asks for more, until no test is left that could tell.
    width, tested = 1, None
    while True:
        asks, members = _cross(members, chunks, parts, info, n_nodes, width, tested)
        if asks.isEmpty():
            break
        merged = components(_tested(asks, full, parts.join(chunks, "node")))
        parts = narrow(parts.join(merged.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("label", "part").alias("part")), n_nodes, "near-part")
        tested = asks if tested is None else narrow(tested.unionByName(asks), n_nodes, "near-tested")
        width *= WIDER

    ends = narrow(nodes.join(parts, "node", "left").select("set_key", "copies", "first_id", F.coalesce("part", "node").alias("part")), n_nodes, "near-end")
    ids = ends.groupBy("part").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    ends = with_groups(ends, narrow(ids, n_nodes, "near-id"), "part", "size", n_nodes)
    return sig, narrow(ends.select("set_key", "copies", "part", F.coalesce("smallest", "first_id").alias("component")), n_nodes, "near-end")


def _cross(members: DataFrame, chunks: DataFrame, parts: DataFrame, info: DataFrame, n_nodes: int, width: int, tested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """node, chunk: the next exact tests that could connect parts; and the members of the bands that still hold several parts."""
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("part_size"))
    sized = narrow(with_groups(parts, narrow(sizes, n_nodes, "near-part-size"), "part", "part_size", n_nodes), n_nodes, "near-sized")
    rows = members.select("key", "node").join(sized, "node")
    open_keys = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members")).filter("low <> high")
    open_keys = narrow(open_keys.select("key", "members"), n_nodes, "near-open")
    still = narrow(with_groups(members.drop("members"), open_keys, "key", "members", members.count()).filter("members IS NOT NULL"), n_nodes * 4, "near-member")
    rows = still.join(sized, "node").join(info, "node").join(chunks, "node")
    if tested is None:
        rows = rows.withColumn("tested", F.array().cast("array<long>"))
    else:
        rows = rows.join(tested.groupBy("node").agg(F.collect_set("chunk").alias("tested")), "node", "left")
    # A large band is cut into blocks, and each pair of blocks is a group of its own.
    blocks = F.ceil(F.col("members") / BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), blocks)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("key", F.least("block", "to").alias("p"), F.greatest("block", "to").alias("q"), F.when(F.col("block") <= F.col("to"), 0).otherwise(1).alias("side"),
                       "node", "part", "part_size", "n", "sketch", "chunk", "tested")
    asks = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_asks(width), "node long, chunk long")
    return narrow(asks.distinct(), n_nodes, "near-ask"), still


def _tested(asks: DataFrame, full: DataFrame, placed: DataFrame) -> DataFrame:
    """a, b: parts that an exact test connects. A chunk with many queries is tested in several groups.

    Sets travel once, straight to the group that compares them; the parts of their nodes come there on rows of their own.
    """
    n_asks = asks.count()
    counts = asks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / QUERIES)).alias("salt")
    asked = written(with_groups(asks, counts, "chunk", "n", n_asks).select("node", "chunk", salt), "near-asked")
    few = F.broadcast if n_asks <= SENT else lambda df: df
    groups = few(asked.select("chunk", "salt").distinct())
    of_asked = few(asked.select("node", F.col("chunk").alias("to"), "salt"))
    here = lambda df, asks, part, shingles: df.select("chunk", "salt", F.lit(asks).alias("asks"), "node", part, shingles)
    no_part, no_set = F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("shingles")
    there = lambda df: df.join(of_asked, "node").withColumn("chunk", F.col("to"))
    rows = [here(placed.join(groups, "chunk"), False, F.col("part"), no_set), here(there(placed), True, F.col("part"), no_set),
            here(full.join(groups, "chunk"), False, no_part, F.col("shingles")), here(there(full), True, no_part, F.col("shingles"))]
    every = reduce(DataFrame.unionByName, rows)
    return every.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt", "asks").mapInArrow(_answers, "a long, b long").distinct()
