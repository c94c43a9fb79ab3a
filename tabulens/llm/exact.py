"""Exact duplicates by progressive refinement: length, then hash of the first characters, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import ascii_lower, documents, may_hold, with_groups
from tabulens.plans.workspace import Scratch, written

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Groups of one length are refined by a hash of the first
    PREFIX_CHARS characters, and only rows whose (length, prefix hash) is shared have their whole text hashed; other rows
    get a null text_sha256 unless `digest_all`. The largest doc_id of a group stays.

    Null text counts as empty, and empty texts are equal to each other. A null doc_id is smaller than any other; it stays
    only in a group without other ids. Repeated rows are rows of the group like others, and those that carry the id that
    stays are all marked kept. Other columns are not read. An empty table gives no rows.
    """
    d = documents(docs, id_col, text_col).withColumn("len", F.length("text"))
    d = d.withColumn("at", F.xxhash64("len", F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX_CHARS)))))
    whole = F.unhex(F.sha2(ascii_lower(F.col("text")), 256))
    with Scratch(docs.sparkSession) as scratch:
        # No text goes through a join: rows are read into lengths and hashes, and only these meet.
        if digest_all:
            rows = narrow = written(d.select("doc_id", "len", "at", whole.alias("digest")), "dedup-row")
        else:
            narrow = written(d.select("len", "at"), "dedup-row")
        lengths = narrow.groupBy("len").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("len")
        heads = narrow.groupBy("len", "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(lengths, "len", "left_semi")
        shared = written(heads.groupBy("at").agg(F.sum("n").alias("sharing")), "dedup-head")
        if not digest_all:
            marked = may_hold(d, F.col("at"), shared, F.col("at"), shared.count())
            rows = written(marked.select("doc_id", "len", "at", F.when(F.col("__may"), whole).alias("digest")), "dedup-hash")
        total = rows.count()
        hashed = with_groups(rows, shared, "at", "sharing", total).select("doc_id", F.when(F.col("sharing").isNotNull(), F.col("digest")).alias("key"), "digest")
        hashed = scratch.keep(written(hashed, "dedup-key"))
        groups = scratch.keep(written(hashed.filter(F.col("key").isNotNull()).groupBy("key")
                                      .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "dedup-group"))
    out = with_groups(hashed, groups, "key", "group_size", total)
    size = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"),
                      F.lower(F.hex("digest" if digest_all else "key")).alias("text_sha256"))
