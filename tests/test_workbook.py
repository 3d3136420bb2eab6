"""Spreadsheets as a data source: what other programs write, row ranges, the rows of the CSV export."""

import csv
import datetime as dt
import os
import zipfile

import pytest

from receivables.operators import ingest
from receivables.sources import tables, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
STYLES = f"""<styleSheet {MAIN}><numFmts count="3"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/>
<numFmt numFmtId="166" formatCode="[Red]#,##0"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>
<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="22"/></cellXfs></styleSheet>"""


def book(path, rows, shared=(), dimension="", sheets=("Online Retail",), epoch="", styles=STYLES):
    """A workbook as a spreadsheet program writes it; ``rows`` is the last sheet's XML."""
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><workbookPr {epoch}/><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        z.writestr("xl/styles.xml", styles)
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        for k in range(1, len(sheets) + 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {MAIN}>{dimension}<sheetData>{rows if k == len(sheets) else ''}</sheetData></worksheet>")


HEADER = "".join(f'<c r="{c}1" t="s"><v>{k}</v></c>' for k, c in enumerate("ABCDEFGH"))
SHARED = [f"<t>{n}</t>" for n in ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")]


def retail_rows():
    """Lines of a sheet and of its CSV export: shared and rich texts, dates, blank and left-out cells, a blank row."""
    xml = [f'<row r="1">{HEADER}</row>']
    rows = []
    for k in range(2, 40):
        if k == 7:
            xml.append('<row r="7"><c r="A7" s="1"/></row>')
            continue
        cancelled, known = k % 9 == 0, k % 5 != 0
        number = f'<c r="A{k}" t="str"><v>C{536000 + k}</v></c>' if cancelled else f'<c r="A{k}"><v>{536000 + k}</v></c>'
        customer = f'<c r="G{k}"><v>{17850 + k % 3}</v></c>' if known else f'<c r="G{k}"/>' if k % 2 else ""
        xml.append(f'<row r="{k}">{number}<c r="B{k}" t="s"><v>8</v></c><c r="C{k}" t="s"><v>9</v></c><c r="D{k}"><v>{k - 3}</v></c>'
                   f'<c r="E{k}" s="4"><v>{40513.5 + k}</v></c><c r="F{k}"><v>2.5499999999999998</v></c>{customer}<c r="H{k}" t="s"><v>10</v></c></row>')
        day = dt.datetime(2010, 12, 1, 12) + dt.timedelta(days=k)
        rows.append([f"{'C' if cancelled else ''}{536000 + k}", "85123A", "WHITE & HEART", k - 3, day.isoformat(sep=" "), 2.55, 17850.0 + k % 3 if known else "", "France"])
    return "".join(xml), rows


def test_rows_of_the_csv_export(spark, scratch):
    xml, rows = retail_rows()
    shared = [*SHARED, "<t>85123A</t>", "<r><t>WHITE </t></r><r><rPr/><t>&amp; HEART</t></r><rPh><t>kana</t></rPh>", "<t>France</t>"]
    book(f"{scratch}/retail.xlsx", xml, shared, '<dimension ref="A1:H20"/>', sheets=("Notes", "Online Retail"))
    with open(f"{scratch}/retail.csv", "w", newline="") as f:
        csv.writer(f).writerows([["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"], *rows])
    assert workbook.read(spark, f"{scratch}/retail.xlsx", "Online Retail").count() == len(rows)
    with pytest.raises(Exception, match="no sheet 'Other'"):
        workbook.read(spark, f"{scratch}/retail.xlsx", "Other").count()
    book(f"{scratch}/first.xlsx", xml, shared)
    got, want = (tables.read_transactions(spark, f"{scratch}/{p}") for p in ("first.xlsx", "retail.csv"))
    assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    clean = ingest.clean_transactions(got)
    assert 0 < clean.count() < got.count() and clean.select("invoice_date").first()[0].hour == 12


@pytest.mark.parametrize("step", [1, 7, 10, 100])
def test_row_ranges_hold_every_row_once(spark, scratch, step):
    """The stated dimension ends before, at or after the last row."""
    xml = '<row r="1"><c t="inlineStr"><is><t>n</t></is></c></row>' + "".join(f"<row><c><v>{k}</v></c></row>" for k in range(30))
    for name, end in (("short", 12), ("right", 31), ("long", 90)):
        book(f"{scratch}/{name}.xlsx", xml, dimension=f'<dimension ref="A1:A{end}"/>')
        df = workbook.read(spark, f"{scratch}/{name}.xlsx", rows_per_partition=step)
        assert df.rdd.getNumPartitions() == -(-end // step)
        assert sorted(int(r.n) for r in df.collect()) == list(range(30))


def test_kinds_of_cells(spark, scratch):
    cells = [('s="1"', "0.25", "06:00:00"), ('s="1"', "59", "1900-02-28 00:00:00"), ('s="1"', "61", "1900-03-01 00:00:00"), ('s="4"', "40513.351388888892", "2010-12-01 08:26:00"),
             ('s="2"', "3.0", "3"), ('s="3"', "1E-3", "0.001"), ('t="b"', "1", "true"), ('t="e"', "#N/A", None), ('t="str"', "", None), ('t="d"', "2010-12-01", "2010-12-01"), ('s="1"', "1e9", "1000000000"), ("", "1e300", "1e+300")]
    xml = '<row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="C3" t="inlineStr"><is><t>x</t></is></c></row>'
    xml += "".join(f'<row><c r="C{k}" {a}><v>{v}</v></c><c r="AA{k}"><v>5</v></c></row>' for k, (a, v, _) in enumerate(cells, 4))
    book(f"{scratch}/kinds.xlsx", xml)
    df = workbook.read(spark, f"{scratch}/kinds.xlsx")
    assert df.columns == ["column_1", "x", "x_3"]
    got = [r[2] for r in df.collect()]
    assert sorted(x for x in got if x) == sorted(w for *_, w in cells if w) and len(got) == len(cells)
    book(f"{scratch}/mac.xlsx", '<row><c t="inlineStr"><is><t>x</t></is></c></row><row><c s="1"><v>0</v></c><c/></row><row><c s="1"><v>366</v></c></row>', epoch='date1904="1"')
    assert [r.x for r in workbook.read(spark, f"{scratch}/mac.xlsx").collect()] == ["00:00:00", "1905-01-01 00:00:00"]


def test_written_workbooks(spark, scratch, monkeypatch):
    rows = [(k, f"<&> \"{k}\" é \x01" if k % 3 else None, k / 7, dt.datetime(2020, 1, 1, 3, 4, 5) + dt.timedelta(days=k), k % 2 == 0) for k in range(50)]
    df = spark.createDataFrame(rows, "id int, said string, x double, at timestamp_ntz, ok boolean").repartition(3)
    workbook.save(df, f"{scratch}/out")
    workbook.save(df, f"{scratch}/out")  # again: the same files
    back = workbook.read(spark, f"{scratch}/out", rows_per_partition=5).collect()
    assert sorted((int(r.id), r.said, float(r.x), r.at, r.ok) for r in back) == [
        (k, s and s.replace("\x01", ""), x, at.isoformat(sep=" "), str(ok).lower()) for k, s, x, at, ok in rows
    ]
    assert all(name.endswith(".xlsx") and not name.startswith("_") for name in os.listdir(f"{scratch}/out"))
    book(f"{scratch}/out/zz.xlsx", '<row><c t="inlineStr"><is><t>other</t></is></c></row>')
    with pytest.raises(Exception, match="has the columns"):
        workbook.read(spark, f"{scratch}/out").collect()
    with pytest.raises(Exception, match="no workbook"):
        workbook.read(spark, os.path.dirname(workbook.__file__)).collect()


def test_a_sheet_is_read_without_objects_for_its_elements(scratch, monkeypatch):
    """Prefixed names, reading aids, nested runs, formulas, repeated parts of a cell, cells without a reference."""
    xml = """<x:row r="2"><x:c t="inlineStr"><x:is><x:r><x:t>a </x:t></x:r><x:r><x:rPr/><x:r><x:t>b&amp;</x:t></x:r></x:r><x:rPh><x:t>no</x:t></x:rPh><x:t>c</x:t></x:is><x:v>9</x:v></x:c>
<x:c r="D2"><x:f>1+1</x:f><x:v>2</x:v></x:c><x:c><x:v/></x:c><x:c t="inlineStr"><x:v>9</x:v></x:c><x:c><x:is><x:t>9</x:t></x:is></x:c></x:row><x:row/><x:row><x:c t="str"><x:v>é&lt;</x:v></x:c></x:row>"""
    book(f"{scratch}/odd.xlsx", xml.replace("<x:", '<').replace("</x:", "</"))
    book(f"{scratch}/prefixed.xlsx", f'</sheetData><x:sheetData xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{xml}</x:sheetData><sheetData>')
    opened = [workbook.Book(*workbook.opened(f"{scratch}/{name}.xlsx"), None) for name in ("odd", "prefixed")]
    assert all(b.dated == {1, 4} for b in opened)  # styles are read once
    monkeypatch.setattr(workbook, "iterparse", None)
    for b in opened:
        assert list(b.rows()) == [(2, {0: "a b&c", 3: "2"}), (4, {0: "é<"})]
