"""Secret scans with multipart linking.

Plain finds are taken by pattern. Weak parts, which alone are too common to report, are reported only where a complementary
part stands in the same scope: a credential needs an access identifier and a secret, or an endpoint and a secret. Scopes
are character intervals around parts; the interval join cuts them into bins, joins on (row, bin) and then compares ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.plans.workspace import written

#: Characters between two parts of one credential.
SCOPE = 200
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
#: Weak parts: pattern and role. A role is reported as a kind of its own, after the plain ones.
WEAK = {
    "weak_secret": (r"""(?i)\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|credential)["']?\x20*[:=]\x20*["']?[^\s"',;&]{4,}|\b[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])""", "secret"),
    "identifier": (r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "identifier"),
    "endpoint": (r"""(?i)\b(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>?]{4,}|(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:-]{4,})""", "endpoint"),
}
KINDS = [*BASE, *WEAK]
ROLE_OF_BASE = {"assign": "secret", "access": "identifier", "hex": "secret"}
SPAN = "array<struct<start:int,rank:int,end:int>>"


def spans_of(text: Column, pattern: str, kind: str, measured: int = 0, least: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, rank of kind, end), whose group `measured` has `least` characters or more.

    The pieces between matches and the matches themselves alternate, so their lengths add up to places. Positions are
    code points, end exclusive.
    """
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    sized = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), F.regexp_extract_all(text, p, F.lit(measured)).alias("part")),
                        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("m"), F.length(x["part"]).alias("part")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    walked = F.aggregate(F.filter(sized, lambda x: x["m"].isNotNull()), empty, lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["m"]).alias("at"),
        F.when(x["part"] >= least, F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (acc["at"] + x["gap"] + x["m"]).alias("end"))))).otherwise(acc["out"]).alias("out")))["out"]
    # Most texts have no match; one search decides that.
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPAN))


def written_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, then end, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (keys, start, rank, end, role, weak) that have a complement within `scope` characters.

    A secret complements identifiers and endpoints, and they complement a secret. Each interval is cut into bins of
    `scope` characters; a bin holds a bounded number of parts, so a row meets a bounded number of others. A part inside
    another (a value and its assignment) is not its complement.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    side = F.col("role") == "secret"
    weak = parts.filter("weak").select("doc_id", "tk", "start", "rank", "end", side.alias("is_secret"),
                                       bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bin"))
    other = parts.select(F.col("doc_id").alias("o_doc"), F.col("tk").alias("o_tk"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), side.alias("o_secret"),
                         bins(F.col("start"), F.col("end")).alias("o_bin"))
    near = ((F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
            & ((F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end"))))
    meet = (F.col("doc_id").eqNullSafe(F.col("o_doc")) & (F.col("tk") == F.col("o_tk")) & (F.col("bin") == F.col("o_bin"))
            & (F.col("is_secret") != F.col("o_secret")) & near)
    return weak.join(other, meet, "left_semi").select("doc_id", "tk", "start", "rank", "end").distinct()


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base (plain finds), linked (weak parts reported), each an array of (start, rank, end).

    `rank` indexes KINDS. Null text counts as empty. Rows are told apart by doc_id (null is a value) and a hash of the
    text, so repeated rows get equal results. Matches of one kind don't overlap, those of several kinds may; spans that start
    together come in the order of KINDS. An endpoint ends before its query, a weak secret before an ampersand, so that the
    parameters of an address are parts of their own. Texts of any length are read whole. Other columns are not read; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    base = F.concat(*[spans_of(F.col("text"), *_pattern(kind)) for kind in BASE])
    weak = F.concat(*[spans_of(F.col("text"), p, kind) for kind, (p, _) in WEAK.items()])
    found = written(d.select("doc_id", F.xxhash64("text").alias("tk"), base.alias("base"), weak.alias("weak")), "secret-part")
    one = found.filter("size(weak) > 0").select("doc_id", "tk", F.explode(F.concat(
        F.transform("base", lambda x: F.struct(x.alias("x"), F.lit(False).alias("weak"))), F.transform("weak", lambda x: F.struct(x.alias("x"), F.lit(True).alias("weak"))))).alias("p"))
    roles = F.array(*[F.lit(ROLE_OF_BASE[k] if k in BASE else WEAK[k][1]) for k in KINDS])
    parts = one.select("doc_id", "tk", "p.x.start", "p.x.rank", "p.x.end", F.element_at(roles, F.col("p.x.rank") + 1).alias("role"), "p.weak")
    links = linked(parts, scope).groupBy(F.col("doc_id").alias("l_doc"), F.col("tk").alias("l_tk")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("linked"))
    same = F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("tk") == F.col("l_tk"))
    return found.join(links, same, "left").select("doc_id", F.sort_array("base").alias("base"), F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def _pattern(kind: str) -> tuple[str, str, int, int]:
    pattern, group, least = BASE[kind]
    return pattern, kind, group, least
