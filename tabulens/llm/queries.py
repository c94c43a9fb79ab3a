"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import credentials, exact, interpolation, language, lexical, materialise, mixing, near, personal, simhash, tokencounts, variants, winnowing

Q, S = {}, {}


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)


def query(fn):
    Q[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lower_sql(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op4_decontaminate(spark, sf):
    out = winnowing.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op5_secrets(spark, sf):
    out = credentials.scan_secrets(table(spark, sf, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == credentials.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in credentials.BASE], F.sha2(credentials.written_spans(F.col("base")), 256).alias("base_sha256"),
                      credentials.written_spans(F.concat("base", "linked")).alias("spans"))


@query
def op6_exact_dedup(spark, sf):
    return exact.exact_dedup(table(spark, sf, "documents"), digest_all=True)


S["op6_exact_dedup"] = f"""WITH d AS (SELECT doc_id, {lower_sql("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""


@query
def op9_mix(spark, sf):
    return mixing.entropy_mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def remainder(by: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % by


@query
def op7_lm_score(spark, sf):
    """The fold that fits the weights is remainder 0; remainder 2 is never learned from."""
    out = interpolation.interpolated_scores(table(spark, sf, "documents"), remainder(7) != 2, remainder(7) == 0)
    return out.select("doc_id", (F.coalesce(remainder(7) == 2, F.lit(True))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs, remainder(3) != 1)
    out = language.identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score",
                      F.size("spans").cast("long").alias("n_spans"))


#: Where the public tokenizer files are; a parameter of the deployment.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


@query
def op2_token_counts(spark, sf):
    return tokencounts.token_counts(table(spark, sf, "documents"), tokencounts.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model"))


@query
def op3_training_order(spark, sf):
    ranks = materialise.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return materialise.training_order(table(spark, sf, "documents"), ranks, end_id=50256, key=20)


@query
def op8_personal_data(spark, sf):
    docs = table(spark, sf, "documents")
    out = personal.find_personal_data(docs, personal.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == personal.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in personal.KINDS], F.sha2(personal.written_spans(F.col("base")), 256).alias("base_sha256"),
                      personal.written_spans(F.concat("base", "found")).alias("spans"))


@query
def op1_near_dedup(spark, sf):
    return near.near_duplicates(table(spark, sf, "documents"))


S["op1_near_dedup"] = f"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array({lower_sql("coalesce(text, '')")}, '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""


@query
def op11_simhash(spark, sf):
    return simhash.simhash_duplicates(table(spark, sf, "documents"))


@query
def op12_spelling_variants(spark, sf):
    return variants.spelling_variants(table(spark, sf, "documents"))


@query
def op13_ranked_search(spark, sf):
    return lexical.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _terms_sql(name: str, key: str) -> str:
    return f"SELECT {key}, unnest(regexp_extract_all({lower_sql('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {name}"


S["op13_ranked_search"] = f"""WITH b AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql("documents", "doc_id")}) GROUP BY doc_id, term),
s AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM b GROUP BY doc_id), g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // total AS m FROM s, g),
i AS (SELECT item_id, term, count(*) AS times FROM ({_terms_sql("benchmark", "item_id")}) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM b, g GROUP BY term),
x AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN b USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
