"""SimHash near-duplicates: covering masks put every pair of fingerprints within the radius into a common bucket.

A fingerprint has 64 bits. Every bit position gets a code of RADIUS + 1 bits, not zero; a table belongs to each vector v that
is not zero, and its mask keeps the positions whose code has an odd inner product with v. Two fingerprints that differ in at
most RADIUS positions span at most RADIUS codes, so some v is orthogonal to all of them: in that table no differing position is
kept and both fall into one bucket. Nothing is left to chance.

Nodes are distinct fingerprints. A bucket with more than BUCKET nodes is refined by the same construction over the positions that
its mask leaves free; after two masks at most FREE positions are left, so a group never has more than 2 ** FREE nodes. A group
gives the links of a spanning forest, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import with_groups
from tabulens.llm.near import components, narrow
from tabulens.plans.workspace import written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Nodes of a bucket that one task compares before the bucket is refined; shingles of a text counted at once.
BUCKET, STEP = 2048, 1 << 16
TABLES = 2 ** (RADIUS + 1) - 1


def covering(positions: list[int]) -> list[int]:
    """One mask per table over the given positions; codes are dealt in turn, so masks keep about equally many positions."""
    codes = {p: 1 + i % TABLES for i, p in enumerate(positions)}
    return [sum(1 << p for p, c in codes.items() if (c & v).bit_count() % 2) for v in range(1, TABLES + 1)]


MASKS = covering(list(range(64)))
FINER = [covering([p for p in range(64) if not mask >> p & 1]) for mask in MASKS]
FREE = max(64 - (mask | sub).bit_count() for mask, subs in zip(MASKS, FINER) for sub in subs)


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(text: bytes) -> int:
    """The 64 majority bits of the XXH64 hashes of all shingles; zero without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, k = b" ".join(words), min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total, n, digest = np.zeros(64, np.int64), len(words) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        upto = min(n, at + STEP)
        spans = zip(starts[at:upto].tolist(), ends[at + k - 1:upto + k - 1].tolist())
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", upto - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _forests(batches):
    """Groups of consecutive equal buckets to the links of a spanning forest: a (the smallest of its tree), b.

    One group is held at a time; it has at most BUCKET nodes, or 2 ** FREE where it is part of a refined bucket.
    """
    held = np.empty((2, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.array([batch["bucket"].to_numpy(), batch["fp"].to_numpy()])], axis=1)
        cuts = np.flatnonzero(np.diff(held[0])) + 1
        if len(cuts):
            yield from _links(np.split(held[1, :cuts[-1]], cuts[:-1]))
            held = held[:, cuts[-1]:]
    yield from _links([held[1]])


def _links(groups: list[np.ndarray]):
    found = [f for g in groups if len(g) > 1 and (f := forest(g)).size]
    if found:
        a, b = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def forest(prints: np.ndarray) -> np.ndarray:
    """Two rows: the smallest node of a tree and each other node of it. Nodes leave `rest` when they are reached."""
    rest, a, b = np.sort(prints), [], []
    while len(rest) > 1:
        first, reached, rest = rest[0], [rest[0]], rest[1:]
        while reached and len(rest):
            close = np.bitwise_count((rest ^ reached.pop()).view(np.uint64)) <= RADIUS
            if close.any():
                new = rest[close].tolist()
                reached += new
                a += [first] * len(new)
                b += new
                rest = rest[~close]
    return np.array([a, b], np.int64).reshape(2, -1)


def fingerprint_links(nodes: DataFrame, total: int) -> DataFrame:
    """a, b: links that connect exactly the nodes (`fp`, unique) that are connected by steps of RADIUS bits or fewer."""
    masks = F.array(*[F.lit(_long(m)) for m in MASKS])
    tables = F.transform(masks, lambda m, t: F.struct(t.alias("t"), F.xxhash64(t, m.bitwiseAND(F.col("fp"))).alias("bucket")))
    dealt = nodes.select("fp", F.inline(tables))
    sizes = narrow(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), total * TABLES, "sim-bucket")
    members = written(with_groups(dealt, sizes, "bucket", "size", total * TABLES).filter("size > 1"), "sim-member")
    finer = F.array(*[F.array(*[F.lit(_long(s)) for s in subs]) for subs in FINER])
    subs = F.transform(F.get(finer, F.col("t")), lambda m, w: F.xxhash64(F.lit("finer"), "bucket", w, m.bitwiseAND(F.col("fp"))))
    small = members.filter(F.col("size") <= BUCKET).select("bucket", "fp")
    large = members.filter(F.col("size") > BUCKET).select(F.explode(subs).alias("bucket"), "fp")
    return small.unionByName(large).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_forests, "a long, b long")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lower-case hex digits), component_id, kept.

    Words are runs between ASCII white space with A-Z lower-cased; shingles are 3 words joined by a space, repeats included, or
    the whole sequence if there are fewer words. A bit is set where over half of the shingles' XXH64 hashes (UTF-8, seed 42)
    have it. Fingerprints that differ in at most 3 bits are linked; `component_id` is the smallest doc_id reachable and the
    document that carries it is kept.

    Null and empty texts have the fingerprint zero and are linked like any other. A row with a null doc_id is linked too, but
    names no component: its component_id is null only where no row with an id is reachable, and then it is kept. Repeated
    rows get equal results. Texts of any length are read whole. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    prints = written(d.mapInArrow(_fingerprints, "doc_id long, fp long"), "sim-print")
    total = prints.count()
    nodes = narrow(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), total, "sim-node")
    labels = components(fingerprint_links(nodes.select("fp"), total))
    parts = narrow(nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first_id", "copies", F.coalesce("label", "fp").alias("part")), total, "sim-part")
    ids = parts.groupBy("part").agg(F.min("first_id").alias("smallest"), F.count(F.lit(1)).alias("size"))
    ids = narrow(ids.filter("size > 1"), total, "sim-id")
    ends = with_groups(parts, ids, "part", "size", total).select("fp", "copies", F.coalesce("smallest", "first_id").alias("component_id"))
    out = with_groups(prints, narrow(ends, total, "sim-end"), "fp", "copies", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
