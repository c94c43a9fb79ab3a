"""Benchmark decontamination by winnowing.

Of every window of WINDOW words the smallest hash of GRAM consecutive words is kept, in documents and in benchmark items.
Two texts that share WINDOW words keep the same fingerprint of that span, so that the join of fingerprints misses no
shared span; hits are extended to the windows that have the fingerprint and compared word by word. An item of fewer words
is one window of its own, found by the hash of the whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import ascii_lower, may_hold
from tabulens.plans.workspace import written

WINDOW = 10
GRAM = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def minima(h: Column, window: int, gram: int) -> Column:
    """For every window of word hashes `h` the smallest hash of its grams: the window's fingerprint. Empty for fewer words.

    `h` has to be a column, not an expression, as it is read many times.
    """
    def each(length, value):
        at = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, value)

    grams = each(F.size(h) - (gram - 1), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(gram)]))
    if window == gram:
        return grams
    width = window - gram + 1
    # The one-element array makes the gram hashes a variable of their own, so that they are not made again for each window.
    return F.flatten(F.transform(F.array(grams), lambda g: each(F.size(g) - (width - 1), lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))))


def _tagged(n: int):
    """A fingerprint with the length of its window."""
    return lambda m: F.struct(F.lit(n).alias("n"), m.alias("g"))


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of the benchmark: item, win (words), n (their number)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("w")).filter("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    each = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("p"))
    return each.select("item", F.slice("w", F.col("p"), F.col("n")).alias("win"), "n").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (ids as sorted strings), spans (array of first word, end word).

    A word is hit inside any occurrence of a benchmark window. Spans are merged runs of hit words, counted from 0, end
    exclusive.

    Null texts have no words and no hits, on either side; an item without words has no window, a null item id is left
    out of `items` but its windows count. Repeated rows get equal results. Rows are told apart by doc_id (null is a value)
    and a hash of the text. Other columns are not read; an empty benchmark gives no hits, an empty table no rows.
    """
    return contaminated_rows(docs, benchmark, window, gram, id_col, text_col, item_col, item_text).drop("tk")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`contamination` with `tk`, the xxhash64 of the text, which with doc_id tells rows apart."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("tk", F.xxhash64("text"))
    wins = written(item_windows(benchmark, window, item_col, item_text), "wins")
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    lengths = [(row.n, row.n if row.n < window else gram) for row in wins.select("n").distinct().collect()]  # `window` of them at most
    prints = lambda h: F.flatten(F.array(*[F.transform(F.array_distinct(minima(h, n, k)), _tagged(n)) for n, k in lengths]))
    none = F.array().cast("array<struct<n:int,g:bigint>>")
    of_items = wins.select(hashes(F.col("win")).alias("h"), "n")
    marks = written(of_items.select(F.explode(prints(F.col("h")) if lengths else none).alias("f"), "n").filter("f.n = n").select("f").distinct(), "marks")
    hashed = d.select("doc_id", "tk", hashes(words_of(F.col("text"))).alias("h"))
    marked = written(hashed.select("doc_id", "tk", F.size("h").cast("long").alias("n_words"), (prints(F.col("h")) if lengths else none).alias("fs")), "prints")
    found = marked.select("doc_id", "tk", F.explode("fs").alias("f")).join(marks, "f", "left_semi")
    places = written(found.groupBy(F.col("doc_id").alias("at_doc"), F.col("tk").alias("at_tk")).agg(F.collect_set("f").alias("found")), "places")

    # Extension: the windows of a document that have a found fingerprint are compared word by word with the benchmark's.
    same = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("tk") == F.col("at_tk"))
    row = lambda doc, tk: F.xxhash64(F.lit("row"), doc, tk)
    near = may_hold(d, row("doc_id", "tk"), places, row("at_doc", "at_tk"), places.count()).filter("__may")
    held = near.join(places, same).select("doc_id", "tk", words_of(F.col("text")).alias("w"), "found").withColumn("h", hashes(F.col("w")))
    starts = lambda n, k: F.filter(F.transform(minima(F.col("h"), n, k), lambda m, i: F.when(
        F.array_contains("found", F.struct(F.lit(n).alias("n"), m.alias("g"))), F.struct(i.alias("p"), F.lit(n).alias("n")))), lambda x: x.isNotNull())
    tries = held.select("doc_id", "tk", "w", F.explode(F.flatten(F.array(*[starts(n, k) for n, k in lengths])) if lengths else F.array().cast("array<struct<p:int,n:int>>")).alias("at"))
    tries = tries.select("doc_id", "tk", F.col("at.p").alias("p"), F.col("at.n").alias("n"), F.slice("w", F.col("at.p") + 1, F.col("at.n")).alias("win"))
    hits = tries.join(wins, ["n", "win"]).groupBy(F.col("doc_id").alias("at_doc"), F.col("tk").alias("at_tk")).agg(
        F.sort_array(F.collect_set(F.struct("p", (F.col("p") + F.col("n")).alias("e")))).alias("at"), F.sort_array(F.collect_set("item")).alias("items"))
    merged = F.aggregate("at", F.array().cast("array<struct<p:int,e:int>>"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["p"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["p"].alias("p"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
    ).otherwise(F.concat(acc, F.array(x))))
    hits = written(hits.select("at_doc", "at_tk", "items", merged.alias("spans")), "hits")
    covered = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<p:int,e:int>>")), F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["p"]))
    return marked.join(hits, same, "left").select(
        "doc_id", "tk", "n_words", covered.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<p:int,e:int>>")).alias("spans"))
