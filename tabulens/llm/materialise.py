"""Token ids in training order, as fixed-stride shards.

Documents are tokenized once and cut into sequences of a fixed number of ids. A sequence's global number is its place in
the tokenized table; a keyed Feistel network over the next even number of bits, walked until it lands below the number
of sequences, permutes numbers to slots. Slots are dealt by range, a shard per partition, and sorted, so that a reader finds
slot s in shard s // shard_rows at byte (s % shard_rows) * stride and can resume anywhere.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulens.plans.workspace import written

LENGTH = 512
SHARD_ROWS = 16_384
ROUNDS = 6
#: What ends a record in a shard file: the text sink's separator. A record is LENGTH little-endian 4-byte ids and this.
RECORD_END = "\n\n\n\n"
GPT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as GPT_PATTERN sees it; the pattern's matcher keeps a place on its stack for every character of such a run.
LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}")


def encoded(enc, text: str) -> list[int]:
    """The ids of a text under a pattern that takes a run of white space as one piece, but for the last character of a run
    that is not at the end of the text. Long runs are cut out by that rule and encoded without the pattern."""
    out, at = [], 0
    for m in LONG_BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at:m.start()])
        out += enc._core_bpe.encode_single_piece(text[m.start():end].encode())
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and their ids from a rank file, read on the driver."""
    with open(os.fspath(path), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def feistel(numbers: np.ndarray, total: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. total-1, for the given numbers of that range, in bounded memory and any order."""
    if total <= 1:
        return np.zeros_like(numbers)
    half = np.uint64((max(2, int(total - 1).bit_length()) + 1) // 2)
    low = np.uint64((1 << int(half)) - 1)

    def once(x):
        left, right = x >> half, x & low
        for r in range(rounds):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0xD1342543DE82EF95 + r * 0x2545F4914F6CDD1D) % 2**64)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, (left ^ f) & low
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    walk = np.flatnonzero(out >= np.uint64(total))
    while len(walk):
        out[walk] = once(out[walk])
        walk = walk[out[walk] >= np.uint64(total)]
    return out.astype(np.int64)


def tokenized(docs: DataFrame, ranks: dict[bytes, int], end_id: int, length: int, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """task, first (sequences of the task before this row), doc_id, n_seq, ids (4-byte, ended by `end_id`); written once."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a tokenizer's vocabulary

    def run(batches):
        import tiktoken
        from pyspark import TaskContext

        task, first = TaskContext.get().partitionId(), 0
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            firsts, counts, ids = [], [], []
            for text in batch["text"]:
                found = encoded(enc, text.as_py())
                found.append(end_id)
                n = -(-len(found) // length)
                firsts.append(first)
                counts.append(n)
                ids.append(np.array(found, "<u2" if end_id < 65536 else "<u4").tobytes())
                first += n
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int64()), pa.array(firsts, pa.int64()), batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                                             names=["task", "first", "doc_id", "n_seq", "ids"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return written(d.mapInArrow(run, "task long, first long, doc_id long, n_seq long, ids binary"), "token-ids")


def training_order(docs: DataFrame, ranks: dict[bytes, int], end_id: int, key: int = 0, length: int = LENGTH, shard_rows: int = SHARD_ROWS,
                   pattern: str = GPT_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: shard, slot, place (row in its shard), doc_id, part (number within the document), n_tokens, record.

    `record` has `length` little-endian ids (4 bytes each), filled with `end_id` after the `n_tokens` used; every document ends with one `end_id`.
    Partition k of the result is shard k in slot order. The slots are 0 .. number of sequences - 1, each used once.

    Null and empty texts are a document of the end id alone; a null doc_id stays null; repeated rows are sequences of their
    own. Numbers follow the order in which the input is read: equal files and split sizes give equal slots. Texts of any
    length are one document, runs of white space of any length included; a task holds one text at a time. Other columns are
    not read; an empty table gives no rows.
    """
    t = tokenized(docs, ranks, end_id, length, pattern, id_col, text_col)
    totals = t.groupBy("task").agg(F.sum("n_seq").alias("n"))
    bases = totals.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))  # a row per task
    total = t.agg(F.coalesce(F.sum("n_seq"), F.lit(0))).first()[0]
    width = np.dtype("<u2" if end_id < 65536 else "<u4")

    def cut(batches):
        for batch in batches:
            n = batch["n_seq"].to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            slot = feistel(batch["start"].to_numpy()[row] + part, total, key)
            used, records = [], []
            raw = batch["ids"]
            last, ids = -1, None
            for r, p in zip(row.tolist(), part.tolist()):
                if r != last:
                    last, ids = r, np.frombuffer(raw[r].as_py(), width)
                mine = ids[p * length:(p + 1) * length]
                used.append(len(mine))
                records.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot // shard_rows), pa.array(slot), pa.array(slot % shard_rows), batch["doc_id"].take(pa.array(row)), pa.array(part.astype(np.int64)),
                 pa.array(used, pa.int64()), pa.array(records, pa.binary())], names=["shard", "slot", "place", "doc_id", "part", "n_tokens", "record"])

    def filled(batches):
        """The ids as they travelled, without filling, to whole records."""
        for batch in batches:
            records = np.full((batch.num_rows, length), end_id, "<u4")
            for row, raw in zip(records, batch["record"]):
                ids = np.frombuffer(raw.as_py(), width)
                row[:len(ids)] = ids
            yield batch.set_column(batch.schema.names.index("record"), "record", pa.array([r.tobytes() for r in records], pa.binary()))

    rows = t.join(F.broadcast(bases), "task").select("doc_id", "n_seq", "ids", (F.col("base") + F.col("first")).alias("start")).mapInArrow(
        cut, "shard long, slot long, place long, doc_id long, part long, n_tokens long, record binary")
    shards = max(1, -(-total // shard_rows))
    return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot").mapInArrow(filled, rows.schema)


def write_shards(ordered: DataFrame, path: str) -> None:
    """Shard files of raw records under path/shard=k/, by the text sink: any Hadoop file system, committed per task.

    The sink writes the bytes of a record as they are and RECORD_END after it, so the stride is that of the record plus
    len(RECORD_END). Each shard is one partition of `ordered`, hence one file.
    """
    raw = ordered.select("shard", F.expr("CAST(record AS STRING)").alias("value"))
    raw.write.partitionBy("shard").option("lineSep", RECORD_END).text(path)


def read_record(data: bytes, place: int, length: int = LENGTH) -> np.ndarray:
    """The ids of one record of a shard file's bytes."""
    stride = 4 * length + len(RECORD_END)
    return np.frombuffer(data, "<u4", length, place * stride)
