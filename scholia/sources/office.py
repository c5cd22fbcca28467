"""Workbooks and slides by their own parts: ZIP archives whose parts are XML, put in order by their relations. Standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: A part beyond this size, or an archive of more together, is refused, as a small archive may unpack to any size.
MOST_BYTES = 256 << 20
MOST_ROWS = 500
#: Numbers of the built-in formats of dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, EOFError, ValueError, IndexError)


class _Archive:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > MOST_BYTES:
            raise ValueError("too large unpacked")

    def part(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name.lstrip("/")))

    def targets(self, name: str) -> dict[str, str]:
        """Parts that ``name`` relates to, by the relation's id."""
        folder, base = posixpath.split(name)
        try:
            found = self.part(f"{folder}/_rels/{base}.rels")
        except KeyError:
            return {}
        return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in found}


def markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    rows = [[*r, *[""] * (width - len(r))] for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * width, *rows[1:]])


def _strings(element: ElementTree.Element) -> str:
    """Runs of a string; its phonetic guides have a parent of their own and stay out."""
    return "".join(t.text or "" for e in element for t in ([e] if e.tag == f"{S}t" else e.findall(f"{S}t") if e.tag == f"{S}r" else []))


def _is_date(code: str) -> bool:
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I))


def _date_styles(archive: _Archive) -> set[int]:
    """Cell styles that show dates or times."""
    try:
        styles = archive.part("xl/styles.xml")
    except KeyError:
        return set()
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{S}numFmt") if _is_date(f.get("formatCode", ""))}
    cells = styles.find(f"{S}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in own | DATE_FORMATS}


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _number(text: str, date: bool, from_1904: bool) -> str:
    """A number as it would be printed; a date where the style says so: a time alone, or day and time."""
    v = float(text)
    if date and v >= 0:
        day = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if v >= 60 else datetime(1899, 12, 31)
        at = day + timedelta(seconds=round(v * 86400))
        return str(at.time()) if v < 1 else str(at)
    return str(int(v)) if re.fullmatch(r"[+-]?\d+", text) else str(v)


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int], from_1904: bool) -> str:
    kind, v = cell.get("t", "n"), cell.find(f"{S}v")
    if kind == "inlineStr":
        inline = cell.find(f"{S}is")
        return _strings(inline) if inline is not None else ""
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text.strip() == "1" else "False"
    return v.text if kind in ("str", "e", "d") else _number(v.text.strip(), int(cell.get("s", 0)) in dates, from_1904)


def _grid(sheet: ElementTree.Element, *told) -> Iterator[list[str]]:
    """Rows with a cell that says something; places that the sheet leaves out are empty."""
    for row in sheet.iter(f"{S}row"):
        cells: list[str] = []
        for c in row.findall(f"{S}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            cells.append(_value(c, *told).strip())
        if any(cells):
            yield cells


def sheets(data: bytes, most_rows: int = MOST_ROWS) -> list[tuple[int, str, str]]:
    """(number from 1, title, Markdown) of each sheet that holds something: its title as a heading, then its first ``most_rows`` rows that hold something as a table. Data that is no workbook has none."""
    try:
        archive = _Archive(data)
        book, to, out = archive.part("xl/workbook.xml"), archive.targets("xl/workbook.xml"), []
        try:
            shared = [_strings(s) for s in archive.part("xl/sharedStrings.xml").findall(f"{S}si")]
        except KeyError:
            shared = []
        setting = book.find(f"{S}workbookPr")
        told = shared, _date_styles(archive), setting is not None and setting.get("date1904") in ("1", "true")
        for n, s in enumerate(book.iter(f"{S}sheet"), 1):
            rows = [r for r, _ in zip(_grid(archive.part(to[s.get(f"{R}id")]), *told), range(most_rows))]
            if rows:
                title = s.get("name") or f"Sheet{n}"
                out.append((n, title, f"# {title}\n\n{markdown(rows)}"))
        return out
    except BROKEN:
        return []


def _paragraphs(body: ElementTree.Element) -> str:
    lines = []
    for p in body.findall(f"{A}p"):
        runs = ["\n" if e.tag == f"{A}br" else "".join(t.text or "" for t in e.findall(f"{A}t")) for e in p if e.tag in (f"{A}r", f"{A}br", f"{A}fld")]
        lines.append("".join(runs))
    return "\n".join(lines).strip()


def slides(data: bytes) -> list[tuple[int, str, str]]:
    """(number from 1, title, text) of each slide that says something, in the order of the show: text boxes and tables in their order, a blank line between them. Data that is no presentation has none."""
    try:
        archive = _Archive(data)
        show, to, out = archive.part("ppt/presentation.xml"), archive.targets("ppt/presentation.xml"), []
        for n, s in enumerate(show.iter(f"{P}sldId"), 1):
            tree, parts, title = archive.part(to[s.get(f"{R}id")]).find(f"{P}cSld/{P}spTree"), [], ""
            for shape in tree if tree is not None else ():
                if shape.tag == f"{P}sp" and shape.find(f"{P}txBody") is not None:
                    parts.append(_paragraphs(shape.find(f"{P}txBody")))
                    kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                    if kind is not None and kind.get("type") in ("title", "ctrTitle"):
                        title = title or parts[-1]
                elif shape.tag == f"{P}graphicFrame" and (table := next(shape.iter(f"{A}tbl"), None)) is not None:
                    rows = [[" ".join(_paragraphs(b).split()) for c in r.findall(f"{A}tc") for b in c.findall(f"{A}txBody")] for r in table.findall(f"{A}tr")]
                    rows = [r for r in rows if any(r)]
                    parts += [markdown(rows)] if rows else []
            text = "\n\n".join(p for p in parts if p)
            if text:
                out.append((n, title.split("\n")[0], text))
        return out
    except BROKEN:
        return []


def workbook_text(data: bytes) -> str:
    """All sheets, each under its heading."""
    return "\n\n".join(t for _, _, t in sheets(data))


def show_text(data: bytes) -> str:
    """All slides, each under its title (or number) as a heading."""
    return "\n\n".join(f"# {title or f'Slide {n}'}\n\n{t}" for n, title, t in slides(data))
