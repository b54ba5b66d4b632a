"""A sheet is parsed by ranges of rows."""

import zipfile

import pytest

from evimine.sources import tables

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, rows):
    cells = lambda r, i: "".join(f'<c r="{"ABC"[k]}{i}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' for k, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{i}" x14ac:dyDescent="0.2">{cells(r, i)}</row>' if r else f'<row r="{i}"/>' for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="1_All" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}" xmlns:x14ac="x"><rowBreaks count="0"/><sheetData>{body}</sheetData></worksheet>')


@pytest.mark.parametrize("each", ["7", "50000"])
def test_ranges_of_rows_make_the_sheet(spark, tmp_path, each):
    rows = [["a", "b", "c"], *([f"x{i}", None, f"长 {i}"] if i % 11 else [] for i in range(300))]
    book(tmp_path / "b.xlsx", rows)
    tables.register(spark)
    df = spark.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).option("sheet", "1_All").option("rows", each).load()
    assert df.columns == ["a", "b", "c"] and df.rdd.getNumPartitions() == (43 if each == "7" else 1)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r) if r else (None, None, None) for r in rows[1:])))


def test_a_header_alone(spark, tmp_path):
    book(tmp_path / "b.xlsx", [["a", "b", "c"]])
    tables.register(spark)
    assert spark.read.format("xlsx").option("path", str(tmp_path / "b.xlsx")).option("sheet", "1_All").load().count() == 0


def test_rows_over_the_edges_of_what_is_read(tmp_path):
    """Rows of more than a megabyte, and many small ones."""
    rows = [["h"], ["y" * 3_000_000], *([str(i)] for i in range(20_000)), ["z" * 1_500_000]]
    book(tmp_path / "b.xlsx", rows)
    found = list(tables.Workbook((tmp_path / "b.xlsx").read_bytes()).rows("1_All"))
    assert found == rows
