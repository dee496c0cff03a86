"""Small plug-in for ``.xlsx`` files: sheets to rows for :func:`tabloom.sources.files.scan_documents`, rows to a sheet.

A workbook is one archive that only a whole reader can open, so reading is one file to a call on the executors, and a
written sheet holds at most the format's own million rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MAX_ROWS = 1_048_576


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_sheets(content: bytes) -> Iterator[tuple[int, int, list[str]]]:
    """(sheet number, row number from 0, cells) of every row with a cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for page, name in enumerate(sheets, 1):
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_NS}row"):
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r", "A1"))
                    value = c.findtext(f"{_NS}v") or "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
                if cells:
                    yield page, int(row.get("r", "1")) - 1, cells


def sheet_names(content: bytes) -> list[str]:
    """The names of the sheets of a workbook, in the order of ``read_sheets``."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        named = [(targets.get(s.get(rel), ""), s.get("name", "")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    numbered = [(re.search(r"sheet(\d+)\.xml$", target), name) for target, name in named]
    return [name for _, name in sorted((int(m[1]), name) for m, name in numbered if m)]


def read_named_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet name, row and column number from 1, value) of every filled cell."""
    names = sheet_names(content)
    for page, row, cells in read_sheets(content):
        for col, value in enumerate(cells, 1):
            if value != "":
                yield names[page - 1] if page <= len(names) else f"Sheet{page}", row + 1, col, value


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_bytes(header: list[str], rows: Iterable[Iterable[object]], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet; numbers stay numbers."""
    def cell(r: int, c: int, v: object) -> str:
        ref = f"{_letters(c)}{r}"
        if v is None or v == "":
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(
        f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([header, *rows], 1)
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_workbook(df: DataFrame, path: str, order: list[str], name: str = "Sheet1") -> None:
    """A result of at most a sheet's rows as a workbook, in order; more raise before anything is fetched."""
    if df.limit(MAX_ROWS).count() >= MAX_ROWS:
        raise ValueError("more rows than a sheet holds; write Parquet or CSV")
    rows = (tuple(r) for r in df.orderBy(*order).toLocalIterator())
    with open(path, "wb") as f:
        f.write(sheet_bytes(df.columns, rows, name))
