"""Language identification of mixed-language text.

A model of character n-grams is counted from labelled documents. The scripts of a word narrow the languages it can have;
among those, words are scored per language, and a Viterbi pass with a penalty for every switch labels spans. A document
gets the language with most letters.
"""

import bisect
import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulens.llm.common import text_batches

#: First code points of script ranges and the script from there on (fixed values, Unicode blocks).
SCRIPTS = [(0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
           (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "other"), (0xE00, "thai"), (0xE80, "other"),
           (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
           (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
           (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x323B0, "other")]
STARTS = [a for a, _ in SCRIPTS]
#: Rows of the fit for each language, at most: those with the smallest hashes. The bound of the broadcast table: slots x languages.
FIT_ROWS = 4000
SLOTS = 1 << 16
GRAMS = (1, 2, 3)
SMOOTHING = 0.5
#: Log-probability a switch of language costs; a script that fewer than this share of a language's letters have is not its own.
SWITCH = 8.0
SCRIPT_SHARE = 0.01
#: Words remembered by a task, and characters of text whose words are labelled together.
CACHE_WORDS = 150_000
SLICE_CHARS = 3_000_000
BLANK = 32
OUT = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def script_of(ch: str) -> str:
    return SCRIPTS[bisect.bisect_right(STARTS, ord(ch)) - 1][1]


@functools.cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter; made once per process."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-cased runs of letters, and where they start and end in the text (code points)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = letter_table()[codes]
    edges = np.flatnonzero(np.diff(letters, prepend=False, append=False))
    if not len(edges):
        return [], edges, edges
    low = text.lower()
    if len(low) != len(text):  # a few letters become two when lower-cased
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.where(letters, np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4"), BLANK)
    return list(filter(None, codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(" "))), edges[::2], edges[1::2]


def slots_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the n-grams of all words, one word after the other, and where each word's begin. Ends are marked."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(begin, sizes)
    left = np.repeat(sizes, sizes) - place
    slots, owners = [], []
    owner = np.repeat(np.arange(len(words)), sizes)
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.zeros_like(codes)
        shifted[:len(codes) - n + 1] = codes[n - 1:]
        key = (key ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
        if n in GRAMS:
            whole = left >= n
            slots.append((key[whole] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(SLOTS))
            owners.append(owner[whole])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(slots)[order].astype(np.int64), np.searchsorted(owners[order], np.arange(len(words)))


def labelled(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """The rows the model is fitted on: per language those with the smallest hashes of the key, `rows` of them at most.

    The hash cut takes what is needed in expectation before the rank is taken, so no task ranks a whole language.
    """
    d = docs.filter(F.coalesce(learn, F.lit(False)) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 30)).alias("draw"))
    sizes = d.groupBy("lang").count()
    near = d.join(F.broadcast(sizes), "lang").filter(F.col("draw") < F.lit(2.0 * rows * (1 << 30)) / F.col("count"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))))
    return ranked.filter(F.col("rank") <= rows).select("lang", "text")


def count_grams(batches):
    """Per partition: language, slot, occurrences, and letters by script under negative slots."""
    names = sorted({s for _, s in SCRIPTS})
    number = {s: i for i, s in enumerate(names)}
    counts = {}
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            into = counts.setdefault(lang, (np.zeros(SLOTS, np.int64), np.zeros(len(names), np.int64)))
            for text in texts:
                seen = Counter(words_of(text)[0])
                if not seen:
                    continue
                times = np.fromiter(seen.values(), np.int64, len(seen))
                slots, begin = slots_of(list(seen))
                np.add.at(into[0], slots, np.repeat(times, np.diff(begin, append=len(slots))))
                for ch, n in Counter("".join(w[0] * (c * len(w)) for w, c in seen.items())).items():
                    into[1][number[script_of(ch)]] += n
    for lang, (slots, scripts) in counts.items():
        used, seen = np.flatnonzero(slots), np.flatnonzero(scripts)
        yield pd.DataFrame({"lang": lang, "slot": np.concatenate([used, -1 - seen]), "n": np.concatenate([slots[used], scripts[seen]])})


class Model:
    """Log-odds of n-gram slots by language (bounded: SLOTS x languages) and the languages of each script."""

    def __init__(self, rows: pd.DataFrame):
        names = sorted({s for _, s in SCRIPTS})
        self.langs = sorted(rows["lang"].unique())
        counts = np.zeros((SLOTS, len(self.langs)))
        letters = np.zeros((len(names), len(self.langs)))
        at = rows["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(int)
        slot, n = rows["slot"].to_numpy(int), rows["n"].to_numpy(float)
        counts[slot[slot >= 0], at[slot >= 0]] = n[slot >= 0]
        letters[-1 - slot[slot < 0], at[slot < 0]] = n[slot < 0]
        p = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * SLOTS)
        self.table = (np.log(p) - np.log(p).mean(1, keepdims=True)).astype(np.float32) if self.langs else counts.astype(np.float32)
        self.scripts = {s: letters[i] >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1) for i, s in enumerate(names)}
        self.scripts = {s: (x if x.any() else np.ones(len(self.langs), bool)) for s, x in self.scripts.items()}

    def words(self, words: list[str]) -> np.ndarray:
        """Scores, word x language: mean log-odds of the n-grams times the root of their number; languages of other scripts are out.

        The first letter decides a word's script.
        """
        slots, begin = slots_of(words)
        sums = np.add.reduceat(self.table[slots], begin, axis=0) / np.sqrt(np.diff(begin, append=len(slots)))[:, None]
        allowed = np.array([self.scripts[script_of(w[0])] for w in words])
        return np.where(allowed, sums, -1e4).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of many sequences at once. scores: all words one sequence after the other; longest sequence first."""
    starts = np.cumsum(lengths) - lengths
    steps, k = int(lengths[0]), scores.shape[1]
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    back = np.zeros((len(scores), k), np.int8 if k < 128 else np.int16)
    ends = np.zeros(len(lengths), np.int64)
    best = scores[starts].copy()
    own = np.arange(k)
    for t in range(1, steps + 1):
        n = active[t] if t < steps else 0
        done = slice(n, active[t - 1])
        ends[done] = best[done].argmax(1)
        if not n:
            break
        b = best[:n]
        top = b.argmax(1)
        jump = b[np.arange(n), top] - switch
        stay = b >= jump[:, None]
        back[starts[:n] + t] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, b, jump[:, None]) + scores[starts[:n] + t]
    labels = np.zeros(len(scores), np.int64)
    state = ends.copy()
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = back[at, state[:n]] if t else state[:n]
    return labels


def identify(model: Model, texts: list, cache: dict[str, int], table: list[np.ndarray], switch: float) -> list[tuple]:
    """(language, confidence, spans) of each text; `und` without letters. `cache` numbers the words whose scores `table` has."""
    found, sizes, numbers, new = [], [], [], []
    for text in texts:
        words, starts, ends = words_of(text or "")
        ids = list(map(cache.get, words))
        if None in ids:
            fresh = list(set(words).difference(cache))
            cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh))))
            new += fresh
            ids = list(map(cache.__getitem__, words))
        numbers.append(np.array(ids, np.int64))
        found.append((starts, ends))
        sizes.append(len(words))
    sizes = np.array(sizes, np.int64)
    out = [("und", 0.0, [])] * len(texts)
    if not model.langs or not sizes.any():
        return out
    if new:
        table += [model.words(new[a:a + 20_000]) for a in range(0, len(new), 20_000)]
        table[:] = [np.concatenate(table)]
    scores = table[0][np.concatenate(numbers)]
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    take = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in order])
    labels = np.empty(len(scores), np.int64)
    labels[take] = viterbi(scores[take], sizes[order], switch)
    for i in order:
        mine = labels[starts[i]:starts[i] + sizes[i]]
        first, end = found[i]
        letters = end - first
        weight = np.bincount(mine, letters, minlength=len(model.langs))
        top = int(weight.argmax())
        total = scores[starts[i]:starts[i] + sizes[i]].astype(np.float64).sum(0)
        soft = np.exp(np.clip(total - total.max(), -700, 0))
        sure = weight[top] / weight.sum() * soft[top] / soft.sum() if weight[top] < weight.sum() else soft[top] / soft.sum()
        cuts = np.flatnonzero(np.diff(mine)) + 1
        edges = [0, *cuts.tolist(), len(mine)]
        spans = [(int(first[a]), int(end[b - 1]), model.langs[mine[a]]) for a, b in zip(edges, edges[1:])]
        out[i] = (model.langs[top], float(min(1.0, max(0.0, sure))), spans)
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Fitted on at most `rows` labelled documents a language; its counts are bounded by SLOTS and languages."""
    counted = labelled(docs, learn, id_col, text_col, lang_col, rows).mapInPandas(count_grams, "lang string, slot long, n long")
    return Model(counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())


def identify_languages(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and spans (start, end, lang; code points) appended; only the text is looked at.

    A null text, or one without a letter, is `und` with score 0 and no spans; so is every text when nothing was learned.
    Ties go to the language first by name. Words of a script that no learned language uses are scored by all languages.
    Columns of `docs` with one of the three names are replaced. Row order and repeats are kept, an empty table stays empty.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages floats

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, table = {}, []
        for texts in batches:
            out = []
            values = texts.tolist()
            a = 0
            while a < len(values):
                b, chars = a, 0
                while b < len(values) and (b == a or chars < SLICE_CHARS):
                    chars += len(values[b] or "")
                    b += 1
                if len(cache) > CACHE_WORDS:
                    cache, table = {}, []
                out += identify(shared.value, values[a:b], cache, table, switch)
                a = b
            yield pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out],
                                "spans": [[{"start": s, "end": e, "lang": g} for s, e, g in x[2]] for x in out]})

    found = F.pandas_udf(each, OUT)(F.col(f"`{text_col}`"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans", "__found")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], found.alias("__found")).select(*[F.col(f"`{c}`") for c in kept], "__found.*")
