"""Token counts of a unigram tokenizer by dynamic programming over a trie of distinct pre-tokens.

A task sorts the distinct pre-tokens of a stretch of text, which is their trie in depth-first order. The walk keeps the
open path only: for each prefix on it the best forward score and its number of pieces. A prefix shared with the pre-token
before is not scored again, so every trie node is scored once, and the memory is one path plus the terminal counts.
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text characters whose pre-tokens are walked together, and terminal counts a task remembers.
STRETCH_CHARS = 8_000_000
REMEMBERED = 400_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and log-probabilities from a vocabulary file (.model), read on the driver.

    Files of merges carry ranks instead of probabilities; those become log-probabilities by Zipf's law over the rank.
    Control pieces and byte pieces are left out: a character without a piece falls back to its UTF-8 bytes.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
    return {name: -math.log(r + 2.7) - norm for r, name in enumerate(names)}


def walk(words: list[str], pieces: dict[str, float], longest: int, unknown: float):
    """(word, tokens, log-probability) of the best segmentation of every word; `words` sorted and distinct.

    Of equally probable segmentations the one with fewest tokens counts.
    """
    score, count, path = [0.0], [0], ""
    for word in words:
        full = MARK + word
        same, limit = 0, min(len(path), len(full))
        while same < limit and path[same] == full[same]:
            same += 1
        del score[same + 1:], count[same + 1:]
        for end in range(same + 1, len(full) + 1):
            best, fewest = -math.inf, 0
            for start in range(max(0, end - longest), end):
                p = pieces.get(full[start:end])
                if p is not None:
                    s = score[start] + p
                    if s > best or (s == best and count[start] + 1 < fewest):
                        best, fewest = s, count[start] + 1
            if full[end - 1] not in pieces:  # byte pieces
                s = score[end - 1] + unknown
                if s > best:
                    best, fewest = s, count[end - 1] + len(full[end - 1].encode())
            score.append(best)
            count.append(fewest)
        path = full
        yield word, count[-1], score[-1]


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_pretokens, n_tokens, log_prob (natural, of the best segmentation).

    Pre-tokens are split at Unicode white space and start with a mark. Null and empty texts have no tokens and log_prob 0;
    a null doc_id stays null; repeated rows give equal results. Other columns are not read; an empty table gives no rows.
    Nothing is shuffled.
    """
    longest, unknown = max(map(len, pieces), default=1), min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a tokenizer's vocabulary

    def run(batches):
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            n_pre, n_tok, logs = [], [], []
            at = 0
            while at < len(texts):
                chars, to = 0, at
                fresh: set[str] = set()
                stretch = []
                while to < len(texts) and (to == at or chars + len(texts[to]) <= STRETCH_CHARS):
                    words = texts[to].split()
                    fresh.update(words)
                    stretch.append(words)
                    chars += len(texts[to])
                    to += 1
                if len(known) + len(fresh) > REMEMBERED:
                    known = {}
                for word, count, score in walk(sorted(fresh.difference(known)), shared.value, longest, unknown):
                    known[word] = (count, score)
                for words in stretch:
                    found = [known[w] for w in words]
                    n_pre.append(len(found))
                    n_tok.append(sum(f[0] for f in found))
                    logs.append(math.fsum(f[1] for f in found))
                at = to
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64()), pa.array(logs, pa.float64())],
                                             names=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, log_prob double")
