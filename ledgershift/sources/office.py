"""DOCX and XLSX files as fragments and cells, and workbooks from tables: Spark's binaryFile source, and the standard library's zip and XML.

A file is one row and one task's work; limits on size, entries, sheets, rows and columns fail the file instead of
cutting it, as an `error` in its row.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import synthetic_files

# Capacity limits of one file.
MOST_BYTES, MOST_EXPANDED, MOST_ENTRIES = 25 << 20, 100 << 20, 10_000
MOST_SHEETS, MOST_ROWS, MOST_COLUMNS = 50, 10_000, 200

# XML names of the two formats.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

CELLS = "file string, sheet string, table_no int, r int, c int, raw string, num double, fmt string, warning string, error string"
FRAGMENTS = "file string, line_no int, locator string, text string, frag_id string, warning string, error string"


def _open(data: bytes) -> zipfile.ZipFile:
    if len(data) > MOST_BYTES:
        raise ValueError("file is too large")
    archive = zipfile.ZipFile(io.BytesIO(data))
    items = archive.infolist()
    if len(items) > MOST_ENTRIES or sum(x.file_size for x in items) > MOST_EXPANDED:
        raise ValueError("archive expands too far")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


def _said(node: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(x.text or "" if x.tag == f"{_W}t" else " " for x in node.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))).strip()


def docx_blocks(data: bytes) -> tuple[list[tuple[str, str]], list[str]]:
    """(locator, text) of paragraphs and table rows in the body's order, and warnings. A merged cell counts once."""
    body = _xml(_open(data), "word/document.xml").find(f"{_W}body")
    out, warnings, paragraphs, tables = [], [], 0, 0
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            paragraphs += 1
            if node.find(f"{_W}pPr/{_W}numPr") is not None:
                warnings.append("automatic numbering is not part of the text")
            if text := _said(node):
                out.append((f"paragraph {paragraphs}", text))
        elif node.tag == f"{_W}tbl":
            tables += 1
            for k, row in enumerate(node.iter(f"{_W}tr"), 1):
                cells = [_said(c) for c in row.findall(f"{_W}tc") if (m := c.find(f"{_W}tcPr/{_W}vMerge")) is None or m.get(f"{_W}val") == "restart"]
                if any(cells):
                    out.append((f"table {tables}, row {k}", " | ".join(c for c in cells if c)))
        if any(True for x in node.iter() if x.tag in (f"{_W}ins", f"{_W}del")):
            warnings.append("tracked changes are present")
    return out, sorted(set(warnings))


def docx_cells(data: bytes) -> list[tuple[int, int, int, str]]:
    """(table, row, column, text) of the body's tables, all counted from 1; a merged cell's text stands in each place it covers."""
    body, out = _xml(_open(data), "word/document.xml").find(f"{_W}body"), []
    for t, rows in enumerate(body.findall(f"{_W}tbl") if body is not None else (), 1):
        above: dict[int, str] = {}
        for r, row in enumerate(rows.findall(f"{_W}tr"), 1):
            c = 1
            for cell in row.findall(f"{_W}tc"):
                span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
                text = " ".join(x for x in map(_said, cell.findall(f"{_W}p")) if x)
                if merge is not None and merge.get(f"{_W}val") != "restart":
                    text = above.get(c, "")
                wide = 1 if span is None else int(span.get(f"{_W}val"))
                if r > MOST_ROWS or c + wide - 1 > MOST_COLUMNS:
                    raise ValueError("table is too large")
                for k in range(c, c + wide):
                    above[k] = text
                    if text:
                        out.append((t, r, k, text))
                c += wide
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_cells(data: bytes) -> tuple[list[tuple[str, int, int, str, float | None, str]], list[str]]:
    """(sheet, row, column, raw, number, format) of filled cells, 0 and FALSE among them, and warnings."""
    archive = _open(data)
    names = set(archive.namelist())
    shared = ["".join(t.text or "" for t in x.iter(f"{_S}t")) for x in _xml(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    formats: list[str] = []
    if "xl/styles.xml" in names:
        styles = _xml(archive, "xl/styles.xml")
        own = {x.get("numFmtId"): x.get("formatCode", "") for x in styles.iter(f"{_S}numFmt")}
        percent = {"9": "0%", "10": "0.00%"}
        formats = [own.get(x.get("numFmtId"), percent.get(x.get("numFmtId", ""), "General")) for x in (styles.find(f"{_S}cellXfs") if styles.find(f"{_S}cellXfs") is not None else [])]
    target = {x.get("Id"): x.get("Target", "").lstrip("/") for x in _xml(archive, "xl/_rels/workbook.xml.rels")}
    sheets = list(_xml(archive, "xl/workbook.xml").iter(f"{_S}sheet"))
    if len(sheets) > MOST_SHEETS:
        raise ValueError("too many sheets")
    out, warnings = [], set()
    for sheet in sheets:
        path = target[sheet.get(f"{_R}id")]
        for c in _xml(archive, path if path.startswith("xl/") else f"xl/{path}").iter(f"{_S}c"):
            r, k = int(re.search(r"\d+", c.get("r"))[0]), _column(c.get("r"))
            if r > MOST_ROWS or k > MOST_COLUMNS:
                raise ValueError("sheet is too large")
            if c.find(f"{_S}f") is not None:
                warnings.add("formulas are present")
            value, kind = c.findtext(f"{_S}v"), c.get("t", "n")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
            if value is None or value == "":
                continue
            style = int(c.get("s", 0))
            fmt = formats[style] if style < len(formats) else "General"
            if kind == "s":
                value = shared[int(value)]
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            out.append((sheet.get("name"), r, k, value, float(value) if kind == "n" else None, fmt))
    return out, sorted(warnings)


def _fragments(frames: Iterator[pd.DataFrame], period: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"], strict=True):
            data = bytes(data)
            name, rows = path.rsplit("/", 1)[-1], []
            try:
                if name.lower().endswith(".docx"):
                    blocks, warnings = docx_blocks(data)
                else:
                    cells, warnings = xlsx_cells(data)
                    by_row: dict[tuple[str, int], list[str]] = {}
                    for sheet, r, _, raw, _, _ in sorted(cells, key=lambda x: (x[0], x[1], x[2])):
                        by_row.setdefault((sheet, r), []).append(raw)
                    blocks = [(f"{sheet}, row {r}", " | ".join(xs)) for (sheet, r), xs in by_row.items()]
                stamp = f"{period}:{hashlib.sha256(name.encode()).hexdigest()[:10]}:{hashlib.sha256(data).hexdigest()[:20]}"
                note = "; ".join(warnings) or None
                rows = [(name, k, at, text, f"{stamp}:{k}", note, None) for k, (at, text) in enumerate(blocks, 1)]
                if not rows:
                    raise ValueError("no text")
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                rows = [(name, None, None, None, None, None, str(e))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FRAGMENTS.split(", ")])
            yield out.astype({"line_no": "Int32"})


def _cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"], strict=True):
            name = path.rsplit("/", 1)[-1]
            try:
                if name.lower().endswith(".docx"):
                    rows = [(name, "", t, r, c, raw, None, "General", None, None) for t, r, c, raw in docx_cells(bytes(data))]
                else:
                    cells, warnings = xlsx_cells(bytes(data))
                    rows = [(name, s, 1, r, c, raw, num, fmt, "; ".join(warnings) or None, None) for s, r, c, raw, num, fmt in cells]
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                rows = [(name, None, None, None, None, None, None, None, None, str(e))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])
            yield out.astype({"table_no": "Int32", "r": "Int32", "c": "Int32"})


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def read_documents(spark: SparkSession, folder: str, period: str) -> DataFrame:
    """Fragments of every .docx and .xlsx in a folder; a file that can't be read is one row with its error."""
    return _files(spark, folder, "*.{docx,xlsx,xlsm}").mapInPandas(lambda frames: _fragments(frames, period), FRAGMENTS)


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of every workbook in a folder, and of the tables of every Word report: their sheet is empty, and they count by table_no."""
    return cells_of(_files(spark, folder, "*.{xlsx,xlsm,docx}"))


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of files(path, content)."""
    return files.mapInPandas(lambda frames: _cells(frames), CELLS)


def marker_errors(cells: DataFrame) -> DataFrame:
    """Files whose name and content disagree on being synthetic: file, by_name, by_content."""
    by = synthetic_files(cells).withColumnRenamed("synthetic", "by_content")
    return by.withColumn("by_name", F.col("file").startswith("SYNTH_")).where("by_name <> by_content")


def _letters(n: int) -> str:
    return (_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)


def workbook_bytes(sheets: dict[str, list[tuple[int, int, str]]]) -> bytes:
    """A workbook of sheets with texts at (row, column), both counted from 1."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, text: str) -> None:
            z.writestr(zipfile.ZipInfo(name), head + text, zipfile.ZIP_DEFLATED)

        numbers = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in numbers)
        put("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{_R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_R[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        put("xl/workbook.xml", f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
        for i, cells in zip(numbers, sheets.values(), strict=True):
            rows: dict[int, list[str]] = {}
            for r, c, text in sorted(cells):
                rows.setdefault(r, []).append(f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_S[1:-1]}"><sheetData>' + "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in rows.items()) + "</sheetData></worksheet>")
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """(file, content) of cells(file, sheet_no, sheet, r, c, value): one workbook a file, sheets in order, repeated cells in the first place only.

    A report's cells are one task's work, as a workbook is one archive; more than a sheet of the format holds fails it.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.fillna({"value": ""})
        if rows["r"].max() > 1 << 20 or rows["c"].max() > 1 << 14 or rows["value"].str.len().max() > 32_767:
            raise ValueError("a sheet is too large for a workbook")
        rows = rows.sort_values(["sheet_no", "r", "c", "value"]).drop_duplicates(["sheet", "r", "c"])
        sheets = {name: list(part[["r", "c", "value"]].itertuples(index=False, name=None)) for name, part in rows.groupby("sheet", sort=False)}
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "content": [workbook_bytes(sheets)]})

    wanted = cells.select("file", F.col("sheet_no").cast("int"), F.substring("sheet", 1, 31).alias("sheet"), F.col("r").cast("int"), F.col("c").cast("int"), F.col("value").cast("string"))
    return wanted.groupBy("file").applyInPandas(build, "file string, content binary")
