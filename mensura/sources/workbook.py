"""Workbooks (xlsx): sheets as rows, tables below a preamble, and a writer with a styled header."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Mapping
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.sources.files import binary_documents, parsed

# Fixed values of the file format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows and columns that a sheet can have.
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
_NAME_LENGTH = 31


def _column(reference: str) -> int:
    """Number, from 0, of the column of a cell reference such as 'AB12'."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        column, rest = divmod(column, 26)
        out, column = chr(65 + rest) + out, column - 1
    return out


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(content: bytes) -> list[dict]:
    """A row for each row with something in it of each sheet of a workbook: sheet, row_no (from 0, empty rows counted), cells as text.

    Cells that are empty are null; formulas give the value that was saved with them; numbers are as they are saved.
    """
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            number = -1
            for _, row in ElementTree.iterparse(io.BytesIO(z.read(path))):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r")) - 1 if row.get("r") else number + 1
                cells: dict[int, str] = {}
                at = -1
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    value = c.find(f"{_MAIN}v")
                    text = _text(c) if c.get("t") == "inlineStr" else None if value is None else value.text
                    if text is not None:
                        cells[at] = shared[int(text)] if c.get("t") == "s" else text
                if cells:
                    out.append({"sheet": sheet.get("name"), "row_no": number, "cells": [cells.get(i) for i in range(max(cells) + 1)]})
                row.clear()
    return out


def sheets(spark: SparkSession, folder: str, header_row: int = 0, pattern: str = "*.xlsx") -> DataFrame:
    """(paper, sheet, row_no, fields): the rows below the header row of every sheet of every workbook of a folder.

    paper is the file's name without its ending, fields a map from the header's names to the cells' text; columns without
    a name are called column_<number>, of several with one name the first counts. A sheet without the header row has no rows. A file
    that can't be read gives a row of nulls with the error's text in `error`.
    """
    cells = parsed(binary_documents(spark, folder, pattern), sheet_rows, "sheet string, row_no bigint, cells array<string>")
    names = F.transform("cells", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("column_"), i)))
    heads = cells.where(F.col("row_no") == header_row).select("paper", "sheet", names.alias("_names"))
    below = cells.where((F.col("row_no") > header_row) & F.col("error").isNull())
    pairs = F.filter(F.arrays_zip(F.col("_names").alias("name"), F.col("cells").alias("cell")), lambda p: p["name"].isNotNull())
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(F.col("_names"), F.lit(1), i), lambda n: n == p["name"]))
    rows = below.join(heads, ["paper", "sheet"]).select("paper", "sheet", "row_no", F.map_from_arrays(F.transform(first, lambda p: p["name"]), F.transform(first, lambda p: p["cell"])).alias("fields"), "error")
    failed = cells.where("error is not null").select("paper", "sheet", "row_no", F.lit(None).cast("map<string,string>").alias("fields"), "error")
    return rows.unionByName(failed)


def _cell(value: object, at: str, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{at}"{s}><v>{value!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook_bytes(tables: Mapping[str, DataFrame], subheads: Mapping[str, Mapping[str, str]] | None = None) -> bytes:
    """A workbook with a sheet for each table (name -> rows), its header bold on a fill, frozen, with filters; a second
    header row, in italics, where subheads has (sheet -> column -> text, such as units) one.

    A sheet holds at most MOST_ROWS rows, which bounds what comes to the driver; more are an error. Sheet names are cut to 31 characters.
    """
    parts: dict[str, str] = {}
    names = [n[:_NAME_LENGTH] for n in tables]
    if len(set(names)) < len(names):
        raise ValueError("two sheets have one name")
    for k, (name, df) in enumerate(tables.items(), 1):
        under = (subheads or {}).get(name)
        if len(df.columns) > MOST_COLUMNS:
            raise ValueError(f"more columns than a sheet can have: {name}")
        rows = df.limit(MOST_ROWS).collect()
        if len(rows) + 1 + bool(under) > MOST_ROWS:
            raise ValueError(f"more rows than a sheet can have: {name}")
        lines = [[(c, 1) for c in df.columns], *([[(under.get(c), 2) for c in df.columns]] if under else []), *[[(v, 0) for v in r] for r in rows]]
        body = "".join(f'<row r="{i}">{"".join(_cell(v, f"{_letters(j)}{i}", s) for j, (v, s) in enumerate(line))}</row>' for i, line in enumerate(lines, 1))
        area = f"A1:{_letters(max(len(df.columns), 1) - 1)}{len(lines)}"
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="{1 + bool(under)}" topLeftCell="A{2 + bool(under)}" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData><autoFilter ref="{area}"/></worksheet>'
    count = range(1, len(names) + 1)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{"".join(f"<sheet name={quoteattr(n)} sheetId={quoteattr(str(k))} r:id={quoteattr(f'r{k}')}/>" for k, n in zip(count, names))}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"<Relationship Id={quoteattr(f'r{k}')} Type={quoteattr(_REL[1:-1] + "/worksheet")} Target={quoteattr(f'worksheets/sheet{k}.xml')}/>" for k in count)}<Relationship Id="styles" Type="{_REL[1:-1]}/styles" Target="styles.xml"/></Relationships>'
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="3"><font/><font><b/></font><font><i/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E2F0"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>'
    parts["_rels/.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{"".join(f"<Override PartName={quoteattr(f'/xl/worksheets/sheet{k}.xml')} ContentType={quoteattr(kind + ".worksheet+xml")}/>" for k in count)}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def write_workbook(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, subheads: Mapping[str, Mapping[str, str]] | None = None) -> None:
    """Writes workbook_bytes to a path of any file system that the session knows; a file that is there is replaced."""
    content = workbook_bytes(tables, subheads)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
