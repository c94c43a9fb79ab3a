"""Language-model scoring by deleted interpolation.

Texts become blocks of token ids, one row each. For every order a block asks for the training counts of its distinct
n-grams; requests are dealt by the range of the n-gram's hash and answered there, so that counting and look-up share one
shuffle, no n-gram leaves its block more than once and nothing is broadcast. Hashes have 64 bits.

The probability of a token mixes maximum-likelihood estimates of order ORDER, ..., 1 and a uniform one. The weights depend on
the frequency bucket of the longest context and maximise, by expectation-maximisation, the likelihood of a held-out fold
of the training documents whose own occurrence is deleted from every count.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.plans.workspace import written

ORDER = 2
#: Text bytes of a block, n-grams of one answering task, steps per octave of the ratios that EM sees, EM rounds.
BLOCK_BYTES = 8_000_000
GRAMS_PER_TASK = 400_000
STEPS_PER_OCTAVE = 8
ROUNDS = 40
BUCKETS = 66
PRIOR_EVENTS = 5.0
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
BLOCK = "block long, fold boolean, tokens long, ids array<long>, nulls array<boolean>, train array<boolean>, sizes array<int>, at binary, vocab binary"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair; unsigned arithmetic wraps."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed: small values and small steps take little room."""
    v = np.ascontiguousarray(values, dtype="<u8")
    return zlib.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class _Builder:
    """Documents of one fold until they fill a block."""

    def __init__(self, fold: bool):
        self.fold = fold
        self.clear()

    def clear(self):
        count = itertools.count(1)
        self.vocab = {}
        self.number = count.__next__
        self.ids, self.train, self.sizes, self.at, self.bytes = [], [], [], [], 0

    def add(self, doc_id, raw: bytes, train: bool):
        vocab, number = self.vocab, self.number
        words = raw.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
        for w in set(words):
            if w not in vocab:
                vocab[w] = number()
        at = np.fromiter(itertools.chain(map(vocab.__getitem__, words), (0,)), np.uint32, len(words) + 1)
        self.at.append(at)
        self.ids.append(doc_id)
        self.train.append(train)
        self.sizes.append(len(at))
        self.bytes += len(raw) + 64

    def row(self, block: int) -> dict:
        hashes = np.fromiter(itertools.chain((int(END),), map(xxhash.xxh3_64_intdigest, self.vocab)), np.uint64, len(self.vocab) + 1)
        at = np.concatenate(self.at)
        return {"block": block, "fold": self.fold, "tokens": len(at), "ids": [x or 0 for x in self.ids], "nulls": [x is None for x in self.ids],
                "train": self.train, "sizes": self.sizes, "at": zlib.compress(at.view(np.uint8).reshape(-1, 4).T.tobytes(), 1), "vocab": hashes.tobytes()}


def to_blocks(batches):
    """doc_id, text, train, fold -> blocks; at most BLOCK_BYTES of text, or one longer document, are held."""
    from pyspark import TaskContext

    numbers = itertools.count(TaskContext.get().partitionId() << 32)
    schema = pa.schema([("block", pa.int64()), ("fold", pa.bool_()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())),
                        ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("vocab", pa.binary())])
    builders = {f: _Builder(f) for f in (False, True)}
    give = lambda b: pa.RecordBatch.from_pylist([b.row(next(numbers))], schema)
    for batch in batches:
        for doc_id, text, train, fold in zip(batch["doc_id"].to_pylist(), batch["text"], batch["train"].to_pylist(), batch["fold"].to_pylist()):
            b = builders[fold]
            b.add(doc_id, text.as_py().encode(), train)
            if b.bytes >= BLOCK_BYTES:
                yield give(b)
                b.clear()
    for b in builders.values():
        if b.ids:
            yield give(b)


def tokens_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, the place of each token in its document, and whether its document is trained on."""
    raw = np.frombuffer(zlib.decompress(row["at"]), np.uint8)
    at = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()
    sizes = np.asarray(row["sizes"], np.int64)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.frombuffer(row["vocab"], "<u8")[at], place, np.repeat(np.asarray(row["train"], bool), sizes)


def grams_of(tokens: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of order 1 .. `order` that end at each token; documents begin with START tokens."""
    out = [tokens]
    for k in range(2, order + 1):
        back = np.empty_like(tokens)
        back[k - 1:] = tokens[:len(tokens) - k + 1]
        back = np.where(place >= k - 1, back, START)
        # key(w1 .. wk) = mix(w1, key(w2 .. wk)), so that the last k-1 words are shared work
        out.append(mix(back, out[-1]))
    return out


def asks(order: int, parts: int):
    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("seen", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                tokens, place, train = tokens_of(row)
                for k, grams in enumerate(grams_of(tokens, place, order), 1):
                    keys, inverse = np.unique(grams, return_inverse=True)
                    seen = np.bincount(inverse[train], minlength=len(keys))
                    cuts = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
                    out = [(p, k, row["block"], pack_sorted(keys[a:b]), pack(seen[a:b])) for p, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    return run


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Training counts over all blocks for each block's keys, in the order asked; every block asks once for a key."""
    keys = [unpack_sorted(x) for x in pdf["keys"]]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, inverse, np.concatenate([unpack(x) for x in pdf["seen"]]).astype(np.int64))
    ends = np.cumsum([len(x) for x in keys])
    counts = [pack(total[inverse[e - len(x):e]]) for x, e in zip(keys, ends)]
    first = np.arange(len(keys)) == 0
    return pd.DataFrame({"block": pdf["block"], "k": pdf["k"], "part": pdf["part"], "counts": counts,
                         "total": np.where(first, total.sum(), 0), "kinds": np.where(first, (total > 0).sum(), 0)})


def looked_up(row: dict, found: pd.DataFrame, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Training counts of the n-gram of each order at every token; places; and hashes are not needed any more."""
    tokens, place, _ = tokens_of(row)
    out = []
    for k, grams in enumerate(grams_of(tokens, place, order), 1):
        _, inverse = np.unique(grams, return_inverse=True)
        mine = found[found["k"] == k].sort_values("part")
        out.append(np.concatenate([unpack(x) for x in mine["counts"]]).astype(np.int64)[inverse])
    return out, place


def estimates(counts: list[np.ndarray], place: np.ndarray, total: int, kinds: int, documents: int, less: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities (components x tokens: order, ..., 1, uniform), whether a component has a context, bucket of the longest one.

    `less` (0 or 1) occurrences of the token itself are deleted from every count.
    """
    n = len(place)
    probs, open_ = [], []
    context = None
    for k in range(len(counts), 0, -1):
        if k == 1:
            under = np.full(n, total, np.int64)
        else:
            # The context is the (k-1)-gram that ends one token earlier; at the start it is START alone.
            under = np.empty(n, np.int64)
            under[1:] = counts[k - 2][:-1]
            under = np.where(place == 0, documents, under)
        under = under - less
        if context is None:
            context = under
        has = under > 0
        probs.append(np.where(has, (counts[k - 1] - less) / np.where(has, under, 1), 0.0))
        open_.append(has)
    probs.append(np.full(n, 1.0 / (kinds + 1)))
    open_.append(np.ones(n, bool))
    bucket = np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)
    return np.array(probs), np.array(open_), bucket


def fit_weights(events: pd.DataFrame, parts: int) -> np.ndarray:
    """BUCKETS x components. `events`: bucket, r0.. (steps of log2(p / uniform), null where p = 0), n: a bounded table."""
    pooled = np.full(parts, 1.0 / parts)
    weights = np.tile(pooled, (BUCKETS, 1))
    if not len(events):
        return weights
    n, bucket = events["n"].to_numpy(float), events["bucket"].to_numpy(int)
    steps = events[[f"r{i}" for i in range(parts - 1)]].to_numpy(float)
    p = np.concatenate([np.where(np.isnan(steps), 0.0, np.exp2(np.nan_to_num(steps) / STEPS_PER_OCTAVE)), np.ones((len(n), 1))], axis=1)
    for _ in range(ROUNDS):
        q = p * pooled
        pooled = (n[:, None] * q / q.sum(1, keepdims=True)).sum(0)
        pooled /= pooled.sum()
    weights[:] = pooled
    for _ in range(ROUNDS):
        q = p * weights[bucket]
        share = n[:, None] * q / q.sum(1, keepdims=True)
        sums = np.zeros((BUCKETS, parts))
        np.add.at(sums, bucket, share)
        sums += PRIOR_EVENTS * pooled
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def interpolated_scores(docs: DataFrame, train: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between ASCII white space with A-Z lower-cased, and one end. `train` picks the documents learned from
    (null: not learned from), `fold` those of them whose tokens, deleted from the counts, fit the weights. `base_score` is
    the add-one unigram score, `score` the model's; both are sums of log10.

    Null and empty texts have the end token alone. Rows with a null key are not learned from and are scored. Repeated rows
    count as often as they occur. With nothing to learn from every probability is uniform. Other columns are not read; an
    empty table gives no rows. The longest document has to fit into one task.
    """
    trained = F.coalesce(train, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                    trained.alias("train"), (trained & F.coalesce(fold, F.lit(False))).alias("fold"))
    blocks = written(d.mapInArrow(to_blocks, BLOCK), "lm-block")
    size = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum(F.size(F.filter("train", lambda x: x))), F.lit(0)).alias("documents")).first()
    parts = 1 + order * int(size.n) // GRAMS_PER_TASK
    asked = blocks.mapInArrow(asks(order, parts), "part int, k int, block long, keys binary, seen binary")
    found = written(asked.groupBy("part", "k").applyInPandas(answers, "block long, k int, part int, counts binary, total long, kinds long"), "lm-count")
    sums = found.filter("k = 1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    total, kinds, documents = int(sums.total), int(sums.kinds), int(size.documents)
    found = found.select("block", "k", "part", "counts")
    names = [f"r{i}" for i in range(order)]

    def events(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for row in left.to_dict("records"):
            counts, place = looked_up(row, right, order)
            probs, _, bucket = estimates(counts, place, total, kinds, documents, 1)
            with np.errstate(divide="ignore"):
                steps = np.rint(np.log2(probs[:-1] / probs[-1]) * STEPS_PER_OCTAVE)
            frame = pd.DataFrame(np.where(np.isfinite(steps), steps, -10**6).astype(np.int64).T, columns=names)
            frames.append(frame.assign(bucket=bucket).groupby(["bucket", *names]).size().rename("n").reset_index())
        return pd.concat(frames)[["bucket", *names, "n"]] if frames else pd.DataFrame({c: pd.Series(dtype="int64") for c in ["bucket", *names, "n"]})

    held = blocks.filter("fold").groupBy("block").cogroup(found.join(blocks.filter("fold").select("block"), "block", "left_semi").groupBy("block"))
    seen = held.applyInPandas(events, f"bucket long, {', '.join(f'{c} long' for c in names)}, n long").groupBy("bucket", *names).agg(F.sum("n").alias("n"))
    rows = seen.collect()  # bounded by buckets and steps, not by the data
    table = pd.DataFrame([r.asDict() for r in rows], columns=["bucket", *names, "n"]).astype(float)
    table[names] = table[names].where(table[names] > -10**6)
    weights = fit_weights(table, order + 1)

    def scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for row in left.to_dict("records"):
            counts, place = looked_up(row, right, order)
            probs, has, bucket = estimates(counts, place, total, kinds, documents, 0)
            w = weights[bucket].T * has
            p = (w * probs).sum(0) / w.sum(0)
            sizes = np.asarray(row["sizes"], np.int64)
            starts = np.cumsum(sizes) - sizes
            base = np.log10((counts[0] + 1) / (total + kinds + 1))
            frames.append(pd.DataFrame({
                "doc_id": pd.array([None if z else i for i, z in zip(row["ids"], row["nulls"])], "Int64"), "trained": np.asarray(row["train"], bool), "n_tokens": sizes,
                "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), starts), "train_tokens": total,
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)}))
        cols = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return pd.concat(frames)[cols] if frames else pd.DataFrame({c: [] for c in cols})

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        scores, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
