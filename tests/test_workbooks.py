"""Workbooks read as events: contents, and memory that does not follow the number of rows."""

import io
import tracemalloc
import zipfile

import pandas as pd

from tabulens.sources import xlsx

HEAD = '<?xml version="1.0"?><{0} xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'


def workbook(rows: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        texts = "".join(f"<si><t>text {i}</t></si>" for i in range(50)) + "<si><r><t>two </t></r><r><t>runs</t></r></si>"
        book.writestr("xl/sharedStrings.xml", HEAD.format("sst") + texts + "</sst>")
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write((HEAD.format("worksheet") + "<sheetData>").encode())
            for i in range(rows):
                sheet.write(f'<row r="{i + 1}"><c r="A{i + 1}" t="s"><v>{i % 51}</v></c><c r="C{i + 1}"><v>{i}</v></c><c r="D{i + 1}" t="b"><v>1</v></c></row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def peak(rows: int) -> tuple[int, int]:
    content = workbook(rows)
    batch = pd.DataFrame({"path": ["x"], "content": [content]})
    tracemalloc.start()
    n = sum(len(p) for p in xlsx._parse(iter([batch])))
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return n, top


def test_rows_of_a_sheet():
    rows = list(xlsx.sheet_rows(workbook(120)))
    assert len(rows) == 120 and rows[50] == (["two runs", None, "50", "true"], "s-nb") and rows[119] == (["text 17", None, "119", "true"], "s-nb")


def test_memory_does_not_follow_the_rows():
    (few, small), (many, large) = peak(4_000), peak(60_000)
    assert (few, many) == (4_000, 60_000) and large < 1.5 * small + 2_000_000
