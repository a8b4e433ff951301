"""Office files and KPI tables, from files made here."""

from __future__ import annotations

import zipfile

from ledgershift.operators import ingest
from ledgershift.sources import office, pages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def para(text, extra=""):
    return f"<w:p>{extra}<w:r><w:t>{text}</w:t></w:r></w:p>"


def write_xlsx(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {S}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            cells = ""
            for r, row in enumerate(rows, 1):
                for c, v in enumerate(row):
                    ref, style = f"{chr(65 + c)}{r}", ""
                    if isinstance(v, tuple):
                        v, style = v[0], ' s="1"'
                    if isinstance(v, bool):
                        cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, str):
                        cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                    elif v is not None:
                        cells += f'<c r="{ref}"{style}><v>{v}</v></c>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {S}><sheetData><row>{cells}</row></sheetData></worksheet>")


def test_documents(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + para("a") + "</w:tc><w:tc>" + para("b") + "</w:tc></w:tr></w:tbl>"
    write_docx(tmp_path / "one.docx", para("First") + table + para("Last", "<w:pPr><w:numPr/></w:pPr>"))
    write_xlsx(tmp_path / "two.xlsx", {"S": [["x", 0, False]]})
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    rows = office.read_documents(spark, f"file://{tmp_path}", "before").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r.line_no or 0)):
        by.setdefault(r.file, []).append(r)
    assert [(r.locator, r.text) for r in by["one.docx"]] == [("paragraph 1", "First"), ("table 1, row 1", "a | b"), ("paragraph 2", "Last")]
    assert "numbering" in by["one.docx"][0].warning and by["two.xlsx"][0].text == "x | 0 | FALSE" and by["bad.docx"][0].error
    assert len({r.frag_id for r in rows}) == len(rows)


KNOWN = [("delay", "Report delay", "days"), ("share", "Share done", "%"), ("twin_a", "Twin", "n"), ("twin_b", "Twin", "n")]


def test_layouts_and_rules(spark, tmp_path):
    write_xlsx(tmp_path / "SYNTH_r.xlsx", {
        "A": [["Report delay, days", "Q1 2023", "Q2 2023"], ["Report delay", 0, 7]],
        "B": [["period", "Report delay", "Share done"], ["янв.23", 5, (0.8,)]],
        "C": [["Metric", "Value", "Period", "Unit"], ["Report delay", 3, "2022", "C"], ["Twin", 3, "2022", "C"], ["Nobody", 3, "2022", "C"], ["Share done", 8, "2022", "C"], ["Report delay", "1,234", "2021", "C"], ["Report delay", 4, "2022", "C"]],
        "D": [["is_synthetic", True]],
    })
    cells = office.read_cells(spark, f"file://{tmp_path}")
    assert office.marker_errors(cells).count() == 0
    known = spark.createDataFrame(KNOWN, "code string, label string, unit string")
    values, queue = ingest.accept(ingest.records(cells, known), known)
    got = {(r.code, r.scope, str(r.start)): r.value for r in values.collect()}
    assert got == {("delay", "A", "2023-01-01"): 0.0, ("delay", "A", "2023-04-01"): 7.0, ("delay", "B", "2023-01-01"): 5.0, ("share", "B", "2023-01-01"): 80.0}
    reasons = sorted(r.reason for r in queue.collect())
    assert reasons == ["ambiguous_metric", "bare_percent", "conflict", "conflict", "number", "unknown_metric"]
    first = next(r for r in queue.collect() if r.reason == "conflict" and r.value == 3.0)
    kept, left = ingest.confirm(queue, spark.createDataFrame([(first.id, 3.0)], "id string, value double"))
    assert kept.count() == 1 and sorted(r.reason for r in left.collect()).count("conflict") == 0
    assert ingest.confirm(queue, spark.createDataFrame([(first.id, 99.0)], "id string, value double"))[0].count() == 0


def test_word_tables_become_values(spark, tmp_path):
    def row(*texts):
        return "<w:tr>" + "".join(f"<w:tc>{para(t)}</w:tc>" for t in texts) + "</w:tr>"

    merged = "<w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + para("wide") + "</w:tc><w:tc><w:tcPr><w:vMerge w:val='restart'/></w:tcPr>" + para("tall") + "</w:tc></w:tr>"
    below = "<w:tr><w:tc>" + para("x") + "</w:tc><w:tc>" + para("") + "</w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + para("") + "</w:tc></w:tr>"
    body = para("Text") + "<w:tbl>" + row("Metric", "Value", "Period", "Scope") + row("Report delay", "3", "2022", "C") + row("Report delay", "5", "2023", "") + "</w:tbl><w:tbl>" + merged + below + "</w:tbl>"
    write_docx(tmp_path / "report.docx", body)
    cells = office.read_cells(spark, f"file://{tmp_path}")
    second = sorted((r.r, r.c, r.raw) for r in cells.where("table_no = 2").collect())
    assert second == [(1, 1, "wide"), (1, 2, "wide"), (1, 3, "tall"), (2, 1, "x"), (2, 3, "tall")]
    known = spark.createDataFrame(KNOWN, "code string, label string, unit string")
    found = ingest.records(cells, known)
    assert sorted((r.cell, r.scope) for r in found.where("table_no = 1").collect()) == [("R2C2", "C"), ("R3C2", None)]
    values, queue = ingest.accept(found, known)
    assert [(r.code, r.scope, r.value) for r in values.collect()] == [("delay", "C", 3.0)] and queue.count() == 1


def test_name_and_marker_must_agree(spark):
    rows = [("SYNTH_a", 1, 1, "Тестовые данные"), ("SYNTH_b", 1, 1, "synthetic"), ("c", 1, 1, "is_synthetic"), ("c", 1, 2, "TRUE"), ("d", 1, 1, "is_synthetic"), ("d", 2, 1, "TRUE"), ("synth_e", 1, 1, None)]
    cells = spark.createDataFrame([(f, "S", 1, r, c, raw) for f, r, c, raw in rows], "file string, sheet string, table_no int, r int, c int, raw string")
    assert sorted(tuple(r) for r in office.marker_errors(cells).collect()) == [("SYNTH_b", False, True), ("c", True, False)]
    assert [r.file for r in ingest.namespace_errors(cells, False).orderBy("file").collect()] == ["SYNTH_a", "c"]


def test_workbooks_are_read_back(spark, tmp_path):
    long = "я" * 15_000
    rows = [("a.xlsx", 2, "Second & <last>", 1, 28, "'=1+1"), ("a.xlsx", 1, "First", 1, 1, "  x <&> \"y\"\nz"), ("a.xlsx", 1, "First", 3, 2, long), ("b.xlsx", 1, "Only", 1, 1, None)]
    made = office.workbooks(spark.createDataFrame(rows, "file string, sheet_no int, sheet string, r int, c int, value string")).collect()
    assert sorted(x.file for x in made) == ["a.xlsx", "b.xlsx"]
    for x in made:
        (tmp_path / x.file).write_bytes(bytes(x.content))
    got = sorted((r.file, r.sheet, r.r, r.c, r.raw) for r in office.read_cells(spark, f"file://{tmp_path}").where("error is null").collect())
    assert got == sorted((f, s, r, c, v) for f, _, s, r, c, v in rows if v)


def test_pages(spark):
    broken, narrow = "\n".join(["word"] * 21), "\n".join(["word"] * 20)
    rows = [
        ("a", 1, "One\ntwo\n \n\nthree\n5.1. four\nб. five\n5. six", None), ("a", 2, " \n ", "unused"), ("a", 3, None, None),
        ("b", 1, broken, "as it stands"), ("b", 2, narrow, "as it stands"), ("b", 3, broken, " "), ("c", 1, "x", None), ("c", 2, "y", None), ("c", 3, "", None), ("c", 4, "", None),
    ]
    table = spark.createDataFrame(rows, "document string, page_no int, text string, layout string")
    got = [(r.document, r.locator, r.text) for r in pages.page_blocks(table, 3).orderBy("document", "page_no", "block").collect()]
    assert got == [
        ("a", "page 1, block 1", "One two"), ("a", "page 1, block 2", "three"), ("a", "page 1, block 3", "5.1. four"), ("a", "page 1, block 4", "б. five 5. six"),
        ("b", "page 1, block 1", "as it stands"), ("b", "page 2, block 1", " ".join(["word"] * 20)), ("b", "page 3, block 1", " ".join(["word"] * 21)),
    ]
    assert [tuple(r) for r in pages.page_warnings(table, 3).collect()] == [("a", 2, "2, 3")]
    assert [tuple(r) for r in pages.page_errors(table, 3).collect()] == [("c", 4)]
    empty = spark.range(1, 22).selectExpr("'d' document", "cast(id as int) page_no", "'' text", "'' layout")
    assert [tuple(r) for r in pages.page_warnings(empty).collect()] == [("d", 21, ", ".join(map(str, range(1, 21))) + "…")]
