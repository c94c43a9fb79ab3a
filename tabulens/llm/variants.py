"""Spelling variants: words at one inserted, deleted or replaced code point, by pairs of trie nodes.

Words are put in order and the nodes of their trie numbered in one pass along it; the same is done with the reversed words. A word
of L code points then is a few integers: at each place i the node of its prefix and the node of its suffix. The pair that skips the
code point at i meets the pairs of words that have another code point there (a replacement), and the pair that skips nothing of
a word one shorter (a deletion seen from one side, an insertion from the other). Nothing else shares a pair of nodes, so links
are exact without comparing words, and a word costs integers in proportion to its length, however long it is.

A pair of nodes has at most one word per code point of the alphabet and one without, so groups are bounded by construction. A word
that can lose any of several equal neighbours to the same result offers only the first of them: each link is met once.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.near import narrow
from tabulens.plans.workspace import written

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, DROPPED = 5, 3, 97
#: Distinct words a task counts before it gives its counts away, code points of the words of one part of the order.
COUNTED, PART = 400_000, 4_000_000
#: Words of one part follow each other by number below this.
STRIDE = 1 << 32


def _written_word(doc_id: int | None, run: str) -> str:
    """The run as this document spells it: one in DROPPED loses a code point. A row without an id drops none."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % DROPPED else run[:h % len(run)] + run[h % len(run) + 1:]


def _counts(batches):
    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    found: dict[str, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            own: dict[str, int] = {}
            for run in RUN.findall(text.as_py().lower().decode(errors="replace")):  # bytes: only A-Z is lower-cased
                own[run] = own.get(run, 0) + 1
            for run, n in own.items():
                word = _written_word(doc_id, run)
                if len(word) >= LEAST_LENGTH:
                    found[word] = found.get(word, 0) + n
            if len(found) > COUNTED:
                yield rows()
                found.clear()
    yield rows()


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more over all texts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    return d.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = (np.frombuffer(s[:n].encode("utf-32-le"), np.uint32) for s in (a, b))
    return int(np.argmax(x != y))


def _crossing(ends: list[tuple[int, str, str]]) -> dict[int, tuple[str, list[int], list[int]]]:
    """For each part (number, first word, last word; in order): its last word, and the numbers of the nodes that it shares with
    the part before and with the part after, by depth. A node that spans several parts keeps the number of its first border."""
    borders: list[list[int]] = [[]]
    for k in range(1, len(ends)):
        _, first, last = ends[k - 1]
        through = min(len(borders[-1]), _common(first, last))
        shared = _common(last, ends[k][1])
        borders.append(borders[-1][:min(through, shared)] + [-(k * STRIDE + i) for i in range(min(through, shared), shared)])
    borders.append([])
    return {part: (last, borders[k], borders[k + 1]) for k, (part, _, last) in enumerate(ends)}


def _numbered(crossing):
    """Numbers the trie nodes of the words of each part, which come in order: word, n, rank, nodes (by depth, from 1)."""
    def run(batches):
        part, path, word, rank, fresh = None, [], "", 0, 0
        for batch in batches:
            ranks, nodes = [], []
            for p, w in zip(batch["part"].to_pylist(), batch["key"].to_pylist()):
                if p != part:
                    last, before, after = crossing.value[p]
                    part, path, word, rank, fresh = p, before[:], w[:len(before)], p * STRIDE, p * STRIDE
                keep = min(len(path), _common(word, w))
                shared = min(len(after), _common(w, last)) if after else 0
                path = path[:keep] + after[keep:shared]
                opened = len(w) - len(path)
                path += range(fresh + 1, fresh + opened + 1)
                fresh, rank, word = fresh + opened, rank + 1, w
                ranks.append(rank)
                nodes.append(path)
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(ranks, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["word", "n", "rank", "nodes"])
    return run


def trie_nodes(words: DataFrame, key, size: int) -> DataFrame:
    """word, n, rank (ascending in the order of `key`), nodes: the numbers of the trie nodes of the prefixes of `key`, by length.

    `size` is the code points of all words. Parts of the order are written first; the driver sees the two border words of
    each part of PART code points, and no more.
    """
    spark = words.sparkSession
    keyed = words.select("word", "n", key.alias("key"))
    parts = 1 + size // PART
    order = written(keyed.repartitionByRange(parts, "key").select(F.spark_partition_id().cast("long").alias("part"), "key", "word", "n"), "trie-order")
    ends = order.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    crossing = spark.sparkContext.broadcast(_crossing(sorted((r["part"], r["first"], r["last"]) for r in ends)))
    dealt = order.repartition(parts, "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_numbered(crossing), "word string, n long, rank long, nodes array<long>")


def neighbours(words: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The words (word, n, rank) and, for those that have any, rank, n_near and best (n, minus rank): the near word of largest n,
    of equal ones the first in code-point order."""
    forward = written(trie_nodes(words, F.col("word"), size), "trie-forward")
    backward = trie_nodes(words, F.reverse("word"), size).select("word", F.col("nodes").alias("back"))
    both = forward.join(backward, "word")
    at = lambda nodes, depth: F.when(depth > 0, F.get(nodes, depth - 1)).otherwise(F.lit(0).cast("long"))
    length = F.size("nodes")
    # A skipped code point that repeats the one before it gives a word that its neighbour has offered already.
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        at(F.col("nodes"), i).alias("prefix"), at(F.col("back"), length - 1 - i).alias("suffix"),
        F.when((i > 0) & (F.get("letters", i) == F.get("letters", i - 1)), 1).otherwise(0).alias("kind")))
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(at(F.col("nodes"), i).alias("prefix"), at(F.col("back"), length - i).alias("suffix"), F.lit(2).alias("kind")))
    pairs = both.withColumn("letters", F.split("word", "")).select("n", "rank", F.inline(F.concat(skips, whole)))
    groups = pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", "rank", "kind")).alias("m")).filter(F.size("m") > 1)
    # Kinds: 0 skips a code point, 1 skips a repeated one, 2 skips none. Replacements link 0 and 1 among themselves, deletions 0 and 2.
    linked = lambda a, b: (a["rank"] != b["rank"]) & ((a["kind"] < 2) & (b["kind"] < 2) | (a["kind"] + b["kind"] == 2) & (a["kind"] != b["kind"]))
    found = F.transform("m", lambda a: F.struct(a["rank"].alias("rank"), F.transform(F.filter("m", lambda b: linked(a, b)), lambda b: F.struct(b["n"].alias("n"), (-b["rank"]).alias("at"))).alias("near")))
    seen = groups.select(F.inline(found)).filter(F.size("near") > 0)
    near = seen.groupBy("rank").agg(F.sum(F.size("near")).alias("n_near"), F.max(F.array_max("near")).alias("best"))
    return forward.select("word", "n", "rank"), near


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased and one in 97, by crc32 of
    `<doc_id>:<run>`, loses a code point; those of 5 code points or more that occur 3 times or more. Near are two words that differ by
    exactly one inserted, deleted or replaced code point. `form` is the near word of largest n (of equal ones the first in
    code-point order) if that is at least twice the word's own n; `root` is where forms lead to, the word itself if it has none.

    Null and empty texts have no words. Rows without an id count, and lose no code point. Repeated rows count as often as they
    stand there. Texts and words of any length are taken whole. Other columns are not read; an empty table gives no rows.
    """
    words = written(counted_words(docs, id_col, text_col), "word-count")
    facts = words.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("size")).first()
    rows = facts["rows"]
    known, near = neighbours(words, facts["size"] or 0)
    best = F.col("best")
    formed = F.when(best["n"] >= 2 * F.col("n"), -best["at"])
    linked = narrow(known.join(near, "rank", "left").select("word", "n", "rank", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), formed.alias("to")), rows, "word-form")
    # Each step at least doubles n, so a chain has fewer steps than bits in a count, and jumping over jumps ends sooner.
    ends = narrow(linked.filter("to IS NOT NULL").select("rank", "to"), rows, "word-root")
    while True:
        beyond = ends.select(F.col("rank").alias("mid"), F.col("to").alias("beyond"))
        jumped = narrow(ends.join(beyond, ends["to"] == beyond["mid"], "left").select("rank", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), rows, "word-root")
        ends = jumped.select("rank", "to")
        if jumped.filter("moved").isEmpty():
            break
    name = lambda c, *more: known.select(F.col("rank").alias(f"{c}_rank"), F.col("word").alias(c), *more)
    forms = linked.join(ends.select("rank", F.col("to").alias("last")), "rank", "left")
    forms = forms.join(name("form", F.col("n").alias("form_n")), F.col("to") == F.col("form_rank"), "left")
    forms = forms.join(name("end"), F.col("last") == F.col("end_rank"), "left")
    return forms.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
