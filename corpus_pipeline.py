"""The corpus pipeline: language, near-duplicates, benchmark passages, source weights, training order.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The stages are judged apart: each one's
result is written and read again as the next one's documents. All but the last return the columns of `documents`.
A decision names its rows by doc_id (null is a value) and a hash of the text, so rows that share a doc_id, or have none, are
judged each by its own text.

For all stages: an empty table stays empty. Null and empty texts leave with the first stage, which finds no language in them; a later
stage that is given such rows keeps them, but for the mix, which takes them 0 times. Repeated rows are rows of their own until the
near-duplicate stage keeps one. Texts of any length are read whole, a row at a time. Further columns pass through whatever their
names, those that a model's output is named like too, up to the last stage, which has columns of its own. Ties are settled by
the rules of the operators.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.llm import language, materialise, mixing, near, winnowing
from tabulens.plans.workspace import Scratch, written

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _rows(docs: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` that `named` (doc_id, tk) holds (`left_semi`) or does not hold (`left_anti`)."""
    keys = named.select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct()
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tk")), how)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (`und`: null text or no letter) go. The model learns from the labelled documents."""
    model = language.fit(docs, F.lit(True))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("__text"))
    return language.identify_languages(whole, model, text_col="__text").filter(F.col("lang_pred") != "und").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id, one without a doc_id only where the group has no other.

    Of rows with the same doc_id in one group that with the smallest hash of the text stays, of rows equal in both, one.
    Empty texts are in no group; of those that repeat a doc_id one stays.
    """
    with Scratch(spark) as scratch:
        found = near.linked_rows(docs, nameless=True)
        found = written(found.groupBy("doc_id", "tk").agg(F.count(F.lit(1)).alias("n"), F.first("part").alias("part")), "stage-near")
        grouped = found.filter("part IS NOT NULL")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tk")).alias("x")
        stays = grouped.groupBy("part").agg(first).select(F.col("x.doc_id").alias("s_doc"), F.col("x.tk").alias("s_tk"))
        gone = scratch.keep(written(grouped.join(stays, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("tk") == F.col("s_tk")), "left_anti").select("doc_id", "tk"), "stage-gone"))
        again = scratch.keep(written(found.filter("n > 1 AND (part IS NOT NULL OR doc_id IS NOT NULL)").select("doc_id", "tk"), "stage-again"))
    left = _rows(docs, gone, "left_anti")
    if again.isEmpty():
        return left
    twice = _rows(left, again, "left_semi").withColumn("__text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_hash"])
    return _rows(left, again, "left_anti").unionByName(twice.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    with Scratch(spark) as scratch:
        found = winnowing.contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        gone = scratch.keep(written(found.filter("n_hit > 0").select("doc_id", "tk"), "stage-leak"))
    return _rows(docs, gone, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out so that sources reach their target weights."""
    return mixing.repeat_copies(docs, mixing.mix_plan(docs)[1])


def order_for_training(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id records with their shard and slot."""
    ranks = materialise.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return materialise.training_order(docs, ranks, end_id=50256, key=20)


STAGES = [("language_id", keep_known_language), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated),
          ("mix_sources", mix_sources), ("training_order", order_for_training)]
#: Fitted models and token ids are beyond SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL}
