"""CSV records of large files: byte ranges read by many tasks, with line breaks inside quotes.

The text reader cuts a file at line breaks, which need not be record ends. So a first pass notes for every range whether it
ends inside quotes, for either case of its start; these notes, a few bytes a range, are chained along each file, and tell how
every range really starts. The second pass joins lines to records. What is cut by a range's border is given out in
pieces and put together by the file's order of ranges; all else never leaves its task.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulens.plans.workspace import written


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside of a quoted cell, given how it starts. A quote opens a cell only as its first character, two
    quotes inside of a quoted cell are one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] != '"':
                break
            at += 2
        inside = False
        at = line.find(",", at) + 1
        if not at:
            return False


def _ranges(batches):
    """(path, block, out, inn): the state a range ends in when it starts outside and when it starts inside of quotes."""
    key, state = None, (False, True)
    for batch in batches:
        for path, block, line in zip(*(batch[c].to_pylist() for c in ("path", "block", "line"))):
            if (path, block) != key:
                if key:
                    yield _batch([(*key, *state)], "path string, block long, out boolean, inn boolean")
                key, state = (path, block), (False, True)
            if '"' in line:
                state = tuple(ends_inside(line, s) for s in state)
    if key:
        yield _batch([(*key, *state)], "path string, block long, out boolean, inn boolean")


TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


RECORDS = "path string, block long, place long, kind string, record string"


def _records(inside_at):
    """Lines to records. Kinds: `first` of a file, `whole`, and pieces of a record that a range's border cuts: `head`, `mid`, `tail`."""
    def run(batches):
        key, held, out, place, opened = None, [], [], 0, False

        def give(kind):
            nonlocal place, held
            if kind == "whole" and place == 0 and key[1] == 0:
                kind = "first"
            out.append((*key, place, kind, "\n".join(held)))
            place, held = place + 1, []

        def close():
            if key and held:
                give("mid" if opened else "head")

        for batch in batches:
            for path, block, line in zip(*(batch[c].to_pylist() for c in ("path", "block", "line"))):
                if (path, block) != key:
                    close()
                    key, place = (path, block), 0
                    opened = inside = key in inside_at.value  # opened: what is held began in an earlier range
                if not held and not inside and line.strip("\r") == "":
                    continue
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    give("tail" if opened else "whole")
                    opened = False
            if out:
                yield _batch(out, RECORDS)
                out.clear()
        close()
        if out:
            yield _batch(out, RECORDS)
    return run


def csv_records(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """path, record: the records of CSV files without their headers, each as it is written. Blank lines are no records."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    line: Column = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"))
    ranges = lines.mapInArrow(_ranges, "path string, block long, out boolean, inn boolean")

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:  # one file's ranges, a row each
        inside, found = False, []
        for r in pdf.sort_values("block").itertuples():
            found.append(inside)
            inside = r.inn if inside else r.out
        return pd.DataFrame({"path": pdf["path"].iloc[0], "block": pdf["block"].sort_values(), "inside": found})

    starts = ranges.groupBy("path").applyInPandas(chained, "path string, block long, inside boolean").filter("inside")
    cut = {(r["path"], r["block"]) for r in starts.collect()}  # ranges that begin within a quoted cell
    found = written(lines.mapInArrow(_records(spark.sparkContext.broadcast(cut)), RECORDS), "csv-records")
    whole = found.filter("kind = 'whole'").select("path", "record")
    pieces = found.filter("kind IN ('head', 'mid', 'tail')")
    if not cut and pieces.isEmpty():
        return whole
    order = Window.partitionBy("path").orderBy("block", "place")
    numbered = pieces.withColumn("n", F.count_if(F.col("kind") == "head").over(order))
    joined = numbered.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("block", "place", "record"))).alias("p"))
    # A head in the first range with nothing before it is a header that a border cuts.
    joined = joined.filter(~((F.col("p")[0]["block"] == 0) & (F.col("p")[0]["place"] == 0)))
    return whole.unionByName(joined.select("path", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
