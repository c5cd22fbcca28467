"""Word documents by their own parts: a ZIP archive whose document part is XML. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The names of heading styles, English and Chinese.
HEADING_STYLE = re.compile(r"^(?:heading|标题)\s*(\d+)$", re.I)
#: A document part beyond this size is refused, as a small archive may unpack to any size.
MOST_BYTES = 256 << 20


def _text(element: ElementTree.Element) -> str:
    """Runs in order; tabs and breaks as themselves; deleted text and instructions of fields have other tags and stay out."""
    out = []
    for e in element.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _levels(archive: zipfile.ZipFile) -> dict[str, int]:
    """Heading level by id of the style."""
    try:
        styles = ElementTree.fromstring(archive.read("word/styles.xml"))
    except KeyError:
        return {}
    found = {}
    for s in styles.iter(f"{W}style"):
        name = s.find(f"{W}name")
        m = HEADING_STYLE.match((name.get(f"{W}val") or "").strip()) if name is not None else None
        if m:
            found[s.get(f"{W}styleId")] = int(m[1])
    return found


def blocks(data: bytes) -> list[tuple[int | None, str]]:
    """(heading level or None, text) of paragraphs and tables in their order; a table is Markdown. Data that is no Word document has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if archive.getinfo("word/document.xml").file_size > MOST_BYTES:
                return []
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
            levels = _levels(archive)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, EOFError):
        return []
    out: list[tuple[int | None, str]] = []
    for child in body if body is not None else ():
        if child.tag == f"{W}p":
            style = child.find(f"{W}pPr/{W}pStyle")
            text = _text(child).strip()
            if text:
                out.append((levels.get(style.get(f"{W}val")) if style is not None else None, text))
        elif child.tag == f"{W}tbl":
            rows = [[" ".join(_text(c).split()) for c in r.findall(f"{W}tc")] for r in child.findall(f"{W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                out.append((None, "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * width, *rows[1:]])))
    return out


def text(data: bytes) -> str:
    return "\n".join(t for _, t in blocks(data))


def marked_text(data: bytes) -> str:
    """The same with # before headings, to be cut into sections as Markdown is."""
    return "\n".join(f"{'#' * min(level, 6)} {t}" if level else t for level, t in blocks(data))
