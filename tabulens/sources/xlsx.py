"""Excel workbooks read in parallel: one file per input row, cells out as rows of text with a kind per cell.

A sheet holds at most 1,048,576 rows, so a single workbook is a bounded piece of work for a task. Sheets and shared texts are
read as events and rows given out PIECE at a time: a task holds the compressed file, the bytes of the distinct texts and one
piece, however many rows the sheet has.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from array import array
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.plans.workspace import written

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
# Built-in number formats that show a date or time.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = datetime(1899, 12, 30)
#: Rows that a task gives out at once.
PIECE = 2_000
CELL_SCHEMA = "path string, row_no long, cells array<string>, kinds string"


def column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")) for f in root.iter(NS + "numFmt")
              if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    formats = root.find(NS + "cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, f in enumerate(ids) if f in DATE_FORMAT_IDS or f in custom}


def _events(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """The elements of one tag, each forgotten once it has been looked at, with its empty shell in its parent."""
    with book.open(name) as source:
        open_elements = []
        for event, element in ElementTree.iterparse(source, events=("start", "end")):
            if event == "start":
                open_elements.append(element)
                continue
            open_elements.pop()
            if element.tag == NS + tag:
                yield element
                if open_elements:
                    open_elements[-1].clear()


class SharedTexts:
    """The distinct texts of a workbook as one run of bytes and where each ends."""

    def __init__(self, book: zipfile.ZipFile):
        self.ends, data = array("Q", [0]), bytearray()
        if "xl/sharedStrings.xml" in book.namelist():
            for si in _events(book, "xl/sharedStrings.xml", "si"):
                data += "".join(t.text or "" for t in si.iter(NS + "t")).encode()
                self.ends.append(len(data))
        self.data = bytes(data)

    def __getitem__(self, i: int) -> str:
        return self.data[self.ends[i]:self.ends[i + 1]].decode()


def sheet_rows(content: bytes) -> Iterator[tuple[list[str | None], str]]:
    """Rows of the first sheet: cell texts and one kind letter each (n number, d date, b boolean, s text, - empty)."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared, dates = SharedTexts(book), _date_styles(book)
    sheet = sorted(n for n in book.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]
    for row in _events(book, sheet, "row"):
        cells, kinds = [], []
        for i, c in enumerate(row.iter(NS + "c")):
            at = column_index(c.get("r")) if c.get("r") else i
            cells += [None] * (at + 1 - len(cells))
            kinds += ["-"] * (at + 1 - len(kinds))
            cells[at], kinds[at] = _cell(c, shared, dates)
        yield cells, "".join(kinds)


def _cell(c, shared: SharedTexts, dates: set[int]) -> tuple[str | None, str]:
    kind, value = c.get("t", "n"), c.find(NS + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(NS + "t")), "s"
    if value is None or value.text is None:
        return None, "-"
    if kind == "s":
        return shared[int(value.text)], "s"
    if kind == "b":
        return ("true" if value.text == "1" else "false"), "b"
    if kind == "n" and int(c.get("s", 0)) in dates:
        return (EPOCH + timedelta(days=float(value.text))).isoformat(sep=" "), "d"
    return value.text, ("n" if kind == "n" else "s")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = ((path, i, cells, kinds) for i, (cells, kinds) in enumerate(sheet_rows(content)))
            while piece := list(itertools.islice(rows, PIECE)):
                yield pd.DataFrame(piece, columns=["path", "row_no", "cells", "kinds"])


def load_xlsx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First sheet of every workbook; the first row names the columns, cell kinds decide the types.

    Cells belong to columns by the names of their own workbook; a column that a workbook lacks is NULL in its rows.
    """
    raw = written(spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_parse, CELL_SCHEMA), "cells")
    heads = raw.filter(F.col("row_no") == 0).select("path", F.col("cells").alias("names"))
    # One row per column name, in the order of first appearance.
    named = heads.select("path", F.posexplode("names").alias("place", "name")).groupBy("name").agg(F.min(F.struct("path", "place")).alias("at")).orderBy("at")
    names = [r["name"] for r in named.collect() if r["name"] is not None]
    body = raw.filter(F.col("row_no") > 0).join(heads, "path")
    place = [F.array_position("names", F.lit(n)).cast("int") for n in names]
    kind = [F.when(p > 0, F.substring(F.col("kinds"), p, F.lit(1))) for p in place]
    cell = [F.when(p > 0, F.get("cells", p - 1)) for p in place]
    aggs = []
    for i in range(len(names)):
        aggs += [F.count_if(kind[i] == k).alias(f"{k}{i}") for k in "ndbs"]
        whole = cell[i].try_cast("double") == F.floor(cell[i].try_cast("double"))
        aggs.append(F.count_if((kind[i] == "n") & whole).alias(f"w{i}"))
        aggs.append(F.count_if(cell[i].isNull()).alias(f"e{i}"))
    row = body.agg(*aggs).first()
    out = []
    for i, name in enumerate(names):
        n, d, b, s = (row[f"{k}{i}"] for k in "ndbs")
        if n and not (d or b or s):
            whole = row[f"w{i}"] == n and not row[f"e{i}"]
            out.append(cell[i].cast("double").cast("long") if whole else cell[i].cast("double"))
        elif d and not (n or b or s):
            out.append(cell[i].cast("timestamp_ntz"))
        elif b and not (n or d or s):
            out.append(cell[i].cast("boolean"))
        else:
            out.append(cell[i])
    return body.select(*[c.alias(name) for c, name in zip(out, names)])
