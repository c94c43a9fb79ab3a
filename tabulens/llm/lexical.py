"""Ranked lexical search: documents are grouped by the set of an item's terms they hold, and the sets judged best first.

The items are the queries. A first pass turns every document into its length and the numbers and frequencies of the terms that some
item has; lengths and document frequencies are counted from that. In the second pass a task takes its documents in blocks. For an
item, each term has a bitmap over the block's documents; together the bitmaps give every document its presence mask. A mask's
documents can score no more than the sum of the largest contributions that its terms make in the block, so the distinct masks
are judged from the highest such bound down, and the rest are left alone as soon as the item's tenth score lies above the
next bound. A task keeps ten documents an item; the best of these over all tasks are the result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulens.plans.workspace import rows_frame, written

TOP = 10
#: Items and code points of item texts in one block of queries, on average; cells of the matrix of contributions, documents of a block.
ITEMS, ITEM_CHARS, CELLS, DOCS = 4096, 32_000_000, 1 << 21, 1 << 14
#: Masks judged at once.
JUDGED = 64
#: Bytes of terms: ASCII letters (A-Z made a-z), digits and all of other characters; every other byte is a space.
_TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Items:
    """A block of items: the number of each term, and per item its terms with how often it has them."""

    def __init__(self, texts: list[bytes]):
        self.numbers: dict[bytes, int] = {}
        self.terms, self.times = [], []
        for text in texts:
            own = Counter(self.numbers.setdefault(t, len(self.numbers)) for t in terms(text))
            self.terms.append(np.array(list(own), np.int64))
            self.times.append(np.array(list(own.values()), np.int64))


def _postings(items):
    """Documents to n (all terms) and the item terms they hold: numbers and frequencies."""
    def run(batches):
        numbers = items.value.numbers
        for batch in batches:
            size, held, often = [], [], []
            for text in batch["text"]:
                own = terms(text.as_py())
                size.append(len(own))
                found = Counter(own)
                hits = [(numbers[t], found[t]) for t in found.keys() & numbers.keys()]
                hits.sort()
                held.append([t for t, _ in hits])
                often.append([f for _, f in hits])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tf"])
    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def _frequencies(n_terms: int):
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch["terms"])[0], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])
    return run


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)


class Best:
    """An item's TOP documents so far: score and id, highest first, equal scores by id (a missing id last)."""

    def __init__(self):
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0)

    def least(self) -> int:
        """A document with a lower score isn't among the best."""
        return max(1, int(self.scores[-1])) if len(self.scores) == TOP else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = scores >= self.least()
        if ok.any():
            scores, ids = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]]) if len(self.ids) else ids[ok]
            first = np.lexsort((np.where(ids == MISSING, np.iinfo(np.int64).max, ids), ids == MISSING, -scores))[:TOP]
            self.scores, self.ids = scores[first], ids[first]


MISSING = np.iinfo(np.int64).min


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """present[term, document] to the distinct masks, as rows of booleans, and the number of each document's mask."""
    packed = np.packbits(present, axis=0)
    lanes = np.zeros((-(-len(packed) // 8) * 8, packed.shape[1]), np.uint8)
    lanes[:len(packed)] = packed
    lanes = np.ascontiguousarray(lanes.T).view(np.uint64)
    order = np.lexsort(lanes.T)
    new = np.r_[True, (lanes[order[1:]] != lanes[order[:-1]]).any(axis=1)]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return present[:, order[new]].T, of


def judge(gains: np.ndarray, worth: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Adds the documents of a block to an item's best: gains[term, document] is 0 where the term is missing, `worth` the term's weight
    times its repeats in the item. Returns the number of documents scored."""
    at = np.flatnonzero(gains.any(axis=0))
    if not len(at):
        return 0
    gains = gains[:, at]
    masks, of = masks_of(gains > 0)
    bounds = masks @ (worth * gains.max(axis=1))
    rank = np.argsort(-bounds, kind="stable")
    by_mask = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by_mask], np.arange(len(masks) + 1))
    scored = 0
    for a in range(0, len(rank), JUDGED):
        group = rank[a:a + JUDGED]
        group = group[bounds[group] >= best.least()]  # an equal bound may win by its id
        if not len(group):
            break
        docs = np.concatenate([by_mask[starts[g]:starts[g + 1]] for g in group])
        best.add(worth @ gains[:, docs], ids[at[docs]])
        scored += len(docs)
    return scored


def _ranked(items, stats):
    """The TOP documents an item among those of the task: item, doc_id, score."""
    def run(batches):
        block, (n_docs, length, df) = items.value, stats.value
        weight = weights(n_docs, df)
        best = [Best() for _ in block.terms]
        worth = [weight[t] * k for t, k in zip(block.terms, block.times)]
        most = max([len(t) for t in block.terms], default=1)
        step = max(16, min(DOCS, CELLS // max(1, most)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids = part["doc_id"].fill_null(MISSING).to_numpy()
                m = 25 + 75 * part["n"].to_numpy() * n_docs // max(1, length)
                held, doc = _flat(part["terms"])
                tf, _ = _flat(part["tf"])
                gain = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                order = np.argsort(held, kind="stable")
                held, doc, gain = held[order], doc[order], gain[order]
                starts = np.searchsorted(held, np.arange(len(df) + 1))
                for mine, of_item, top in zip(block.terms, worth, best):
                    gains = np.zeros((len(mine), part.num_rows), np.int64)
                    for j, t in enumerate(mine.tolist()):
                        here = slice(starts[t], starts[t + 1])
                        gains[j, doc[here]] = gain[here]
                    judge(gains, of_item, ids, top)
        number = np.repeat(np.arange(len(best)), [len(b.scores) for b in best])
        ids = np.concatenate([np.zeros(0, np.int64), *[b.ids.astype(np.int64) for b in best]])
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, pa.int64(), mask=ids == MISSING),
                                          pa.array(np.concatenate([np.zeros(0, np.int64), *[b.scores for b in best]]), pa.int64())], names=["item", "doc_id", "score"])
    return run


def _block(spark: SparkSession, docs: DataFrame, items: list[tuple]) -> DataFrame | None:
    """item_id, rank, doc_id, score for one block of items (item_id, text)."""
    block = Items([text for _, text in items])
    if not block.numbers:
        return None
    shared = spark.sparkContext.broadcast(block)
    postings = written(docs.mapInArrow(_postings(shared), "doc_id long, n long, terms array<int>, tf array<int>"), "lexical-postings")
    n_docs, length = postings.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.numbers), np.int64)
    found = postings.select("terms").mapInArrow(_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df[[r["term"] for r in found]] = [r["df"] for r in found]  # one row for each term of the block of items
    stats = spark.sparkContext.broadcast((n_docs, length, df))
    top = postings.mapInArrow(_ranked(shared, stats), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = top.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    names = rows_frame(spark, [(i, item_id) for i, (item_id, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The 10 highest-scoring documents of every item with score above 0: item_id, rank (from 1), doc_id, score.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII in whole texts; weights, lengths and scores
    are whole numbers as in the contract. Equal scores rank by ascending doc_id, rows without an id last; of rows equal in both
    any order is the same result.

    Null and empty texts have no terms: such documents don't count and are never found, such items give no rows. Rows that repeat an
    id are documents of their own; item rows equal in id and text are one item, items that share an id are ranked apart. Texts
    of any length are read whole. Other columns are not read. Without documents or items there are no rows.

    Items go in blocks of about ITEMS items and ITEM_CHARS characters, which is what a task holds of them; every block
    is one search over all documents.
    """
    spark = docs.sparkSession
    body = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body(text_col).cast("binary").alias("text"))
    q = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), body(item_text).alias("text")).distinct()
    n, chars = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil(chars / ITEM_CHARS))
    q = written(q.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "lexical-items")
    out = rows_frame(spark, [], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = q.filter(F.col("block") == b).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        found = _block(spark, d, [(r["item_id"], bytes(r["text"])) for r in rows])
        out = out if found is None else out.unionByName(found if blocks == 1 else written(found, "lexical-found"))
    return out
