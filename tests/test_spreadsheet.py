from datetime import datetime
from xml.sax.saxutils import escape
from zipfile import ZipFile

import pytest

from fathom.sources import readers
from fathom.sources.spreadsheet import read_spreadsheet, sheets

EPOCH = datetime(1899, 12, 30)
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(k):
    return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def write(path, books, shared=True):
    """A workbook of sheets {name: rows}; None leaves a cell out."""
    strings = []

    def cell(value, ref):
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, datetime):
            return f'<c r="{ref}" s="1"><v>{(value - EPOCH).total_seconds() / 86400!r}</v></c>'
        if isinstance(value, int | float):
            return f'<c r="{ref}"><v>{value!r}</v></c>'
        if value == "#N/A":
            return f'<c r="{ref}" t="e"><v>#N/A</v></c>'
        if not shared:
            return f'<c r="{ref}" t="inlineStr"><is><r><t>{escape(value)}</t></r></is></c>'
        strings.append(value)
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    with ZipFile(path, "w") as z:
        for k, rows in enumerate(books.values()):
            body = "".join(f'<row r="{i + 1}">{"".join(cell(v, f"{letters(j)}{i + 1}") for j, v in enumerate(row) if v is not None)}</row>' for i, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(books)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(books))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_round_trip_of_sheets(spark, tmp_path, shared):
    t = datetime(2024, 1, 2, 9, 30)
    many = [["date", "x_a", "name", "ok"], *([t, float(i), f"ñ <{i}>", i % 2 == 0] for i in range(300))]
    write(tmp_path / "one.xlsx", {"first": many, "second & last": [["name", "x_b", "x_a"], ["p", 1.5, None], [None, "#N/A", 2], ["q", "text", 3.0]]}, shared)
    path = str(tmp_path / "one.xlsx")
    assert [s.name for s in sheets(path)] == ["first", "second & last"]
    df = read_spreadsheet(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("date", "timestamp_ntz"), ("x_a", "double"), ("name", "string"), ("ok", "boolean"), ("x_b", "string"), ("_sheet", "string")]
    assert df.rdd.getNumPartitions() == 2 and df.count() == 303
    assert sorted(map(tuple, df.where("_sheet = 'first'").select("date", "x_a", "name", "ok").collect())) == sorted(map(tuple, many[1:]))
    assert sorted(map(tuple, df.where("_sheet <> 'first'").select("name", "x_b", "x_a").collect()), key=str) == sorted([("p", "1.5", None), (None, None, 2.0), ("q", "text", 3.0)], key=str)
    typed = read_spreadsheet(spark, path, "second & last", "name string, x_b double, none double")
    assert sorted(map(tuple, typed.collect()), key=str) == sorted([("p", 1.5, None), (None, None, None), ("q", None, None)], key=str)


def test_several_files_and_wide_rows(spark, tmp_path):
    wide = [[f"x_{k}" for k in range(30)], [float(k) for k in range(30)]]
    write(tmp_path / "a.xlsx", {"s": wide})
    write(tmp_path / "b.xlsx", {"s": [["x_29"], [7.0]], "empty": []})
    df = read_spreadsheet(spark, str(tmp_path / "*.xlsx"))
    assert sorted(r.x_29 for r in df.collect()) == [7.0, 29.0] and df.rdd.getNumPartitions() == 3
    indexed = readers.with_index(read_spreadsheet(spark, str(tmp_path / "a.xlsx")).withColumnRenamed("x_0", "date").withColumn("date", readers.F.lit("2024-01-01")))
    assert indexed.first().ts == datetime(2024, 1, 1)
