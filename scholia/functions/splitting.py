"""Chunking and sectioning of single texts. What a chunk holds depends on the one before it, so these are Arrow functions over whole texts, one text at a time."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ENDS = "。！？；.!?"
#: How headings of Markdown and of numbered Chinese chapters look.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
CHINESE_HEADING = re.compile(r"^(?:[一二三四五六七八九十]+[、，,．.]|（[一二三四五六七八九十]+）|\([一二三四五六七八九十]+\))")
#: Separators by priority.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", ". ", " ", "")


def sentences(paragraph: str) -> list[str]:
    held = re.sub(r"(?<=\d)\.(?=\d)", "\0", paragraph.strip()).replace("\n", " ")
    return [x for x in (s.replace("\0", ".").strip() for s in re.findall(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+", held)) if x]


def tail_of(text: str, most: int) -> str:
    """The last whole sentences within ``most`` characters, or else the last ``most`` of the last sentence."""
    parts = [p for p in re.split(r"(?<=[。！？!?；;])", text) if p]
    size, first = 0, len(parts)
    while first and size + len(parts[first - 1]) <= most:
        first -= 1
        size += len(parts[first])
    return "".join(parts[first:]) or (parts[-1][-most:] if parts and most > 0 else "")


def _join_while(items: list[str], joins) -> list[str]:
    """Neighbours joined by line feeds while ``joins(held, item)`` says so."""
    out: list[str] = []
    for item in items:
        if out and joins(out[-1], item):
            out[-1] += "\n" + item
        else:
            out.append(item)
    return out


def _overlapped(chunks: list[str], size: int, overlap: int, tail) -> list[str]:
    out = chunks[:1]
    for c in chunks[1:]:
        room = min(overlap, size + overlap - len(c) - 1)
        lead = tail(out[-1], overlap) if len(tail(out[-1], overlap)) <= room else tail(out[-1], room) if room > 0 else ""
        out.append(f"{lead}\n{c}" if lead else c)
    return out


def sentence_chunks(text: str | None, size: int = 400, overlap: int = 50, least: int = 32) -> list[str]:
    """Headings stand alone; paragraphs, the short ones joined, are cut to sentences, which are packed up to ``size``; short chunks join the one
    before; each chunk opens with the last whole sentences of the one before, up to ``overlap``."""
    chunks: list[str] = []
    for section in (s.strip() for s in re.split(r"(?m)^(#{1,6}[^\S\n]+.+)$", (text or "").strip())):
        paragraphs = [p.strip() for p in re.split(r"\n{2,}", section) if p.strip()]
        for p in _join_while(paragraphs, lambda a, b: len(a) < least):
            short: list[str] = []
            for s in sentences(p):
                if len(s) > size:
                    chunks += _join_while(short, lambda a, b: len(a) + len(b) + 1 <= size)
                    short = []
                    chunks += [s[i : i + size] for i in range(0, len(s), size - overlap)]
                else:
                    short.append(s)
            chunks += _join_while(short, lambda a, b: len(a) + len(b) + 1 <= size)
    if least > 0:
        chunks = _join_while(chunks, lambda a, b: len(b) < least and len(a) + len(b) + 1 <= size + overlap)
    return _overlapped(chunks, size, overlap, tail_of) if overlap > 0 else chunks


def recursive_chunks(text: str | None, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator the text has, what is still too long at the next, at last by characters; packed up to ``size``, with characters of the one before in front."""

    def cut(t: str, seps: tuple[str, ...]) -> list[str]:
        while seps and (not seps[0] or seps[0] not in t):
            seps = seps[1:]
        if not seps:
            return [t[i : i + size] for i in range(0, len(t), size)]
        keep = seps[0] if seps[0] != " " else ""
        parts = [p for p in (x.strip() for x in t.split(seps[0])) if p]
        return [y for p in parts for y in ([p + keep] if len(p) <= size else cut(p, seps[1:]))]

    packed = _join_while([p for p in cut(text or "", separators) if p], lambda a, b: len(a) + len(b) + 1 <= size)
    return _overlapped(packed, size, overlap, lambda t, n: t[-n:]) if overlap > 0 else packed


def sections(text: str | None, title: str = "") -> list[tuple[list[str], str, str]]:
    """(heading path, title, text) of each section under a Markdown heading; without any, of each under a Chinese number; else the whole."""
    lines = (text or "").splitlines()
    found = [HEADING.match(x.strip()) for x in lines]
    marks = [(len(m[1]), m[2].strip()) if m else None for m in found]
    if not any(marks):
        marks = [(1, x.strip()) if CHINESE_HEADING.match(x.strip()) else None for x in lines]
    out: list[tuple[list[str], str, str]] = []
    stack: list[tuple[int, str]] = []
    held: list[str] = []

    def close() -> None:
        body = "\n".join(held).strip("\n")
        if body.strip():
            path = [t for _, t in stack]
            out.append((path, path[-1] if path else title, body))
        held.clear()

    for line, mark in zip(lines, marks):
        if mark:
            close()
            stack = [s for s in stack if s[0] < mark[0]] if not stack or stack[-1][0] >= mark[0] else stack
            stack.append(mark)
        held.append(line)
    close()
    return out or [([], title, (text or "").strip())]


def chunk_column(text: Column | str, method: str = "sentences", **options) -> Column:
    """An array of chunks."""
    split = {"sentences": sentence_chunks, "recursive": recursive_chunks}[method]

    @F.arrow_udf("array<string>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([split(t, **options) for t in texts.to_pylist()], pa.list_(pa.string()))

    return udf(text)


def section_column(text: Column | str) -> Column:
    """An array of (path, title, text)."""
    kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("title", pa.string()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<path:array<string>,title:string,text:string>>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([[{"path": p, "title": t, "text": b} for p, t, b in sections(x)] for x in texts.to_pylist()], kind)

    return udf(text)
