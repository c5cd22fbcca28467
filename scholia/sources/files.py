"""Files as documents: text of unknown encoding, Markdown, CSV, local HTML and Word, by their extension. Other formats need libraries that may be plugged in."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as T

from . import docx, office

#: Encodings in the order they are tried, elements of a page that are left out, and elements that make a line.
ENCODINGS = ("utf-8-sig", "gb18030", "big5")
SKIPPED = frozenset("script style nav footer header aside".split())
LINES = frozenset("h1 h2 h3 h4 p li td th pre".split())


def decoded(data: bytes) -> tuple[str, str]:
    """Text and encoding: the first that fits strictly, else UTF-8 with marks for what doesn't."""
    for e in ENCODINGS:
        try:
            return data.decode(e), e
        except ValueError:
            continue
    return data.decode("utf-8", "replace"), "utf-8(replace)"


def table_text(text: str, rows: int = 2000, columns: int = 20) -> str:
    """Delimited text as a Markdown table; the delimiter is guessed from its beginning."""
    try:
        delimiter = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    cells = [[c.strip() for c in r[:columns]] for r in csv.reader(io.StringIO(text), delimiter=delimiter)]
    cells = [r for r in cells if any(r)][:rows]
    if not cells:
        return ""
    width = max(map(len, cells))
    cells = [r + [""] * (width - len(r)) for r in cells]
    return "\n".join(f"| {' | '.join(r)} |" for r in [cells[0], ["---"] * width, *cells[1:]])


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.lines, self.stack = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        if tag in LINES:
            self.stack.append((tag, []))

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED and self.skip > 0
        if tag in LINES and any(t == tag for t, _ in self.stack):
            while self.stack:
                name, parts = self.stack.pop()
                text = " ".join(" ".join(parts).split())
                if text:
                    self.lines.append("#" * int(name[1]) + " " + text if name[0] == "h" else text)
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.skip and self.stack and data.strip():
            for _, parts in self.stack:
                parts.append(data.strip())


def html_text(text: str) -> str:
    """Headings (with #), paragraphs, items and cells of a page, a line each."""
    p = _Lines()
    p.feed(text)
    p.close()
    for name, parts in p.stack:
        if parts:
            p.lines.append(" ".join(" ".join(parts).split()))
    return "\n".join(p.lines)


PARSERS: dict[str, Callable[[str], str]] = {"txt": str, "md": str, "markdown": str, "csv": table_text, "tsv": table_text, "html": html_text, "htm": html_text}

#: Formats that aren't text, from the bytes of a file.
BINARY_PARSERS: dict[str, Callable[[bytes], str]] = {"docx": docx.text, "xlsx": office.workbook_text, "pptx": office.show_text}

#: Formats of several pages, each a document: (number, title, text) from the bytes of a file.
PAGED: dict[str, Callable[[bytes], list[tuple[int, str, str]]]] = {"xlsx": office.sheets, "pptx": office.slides}


def _parsed(parsers: dict[str, Callable[[str], str]], binary: dict[str, Callable[[bytes], str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, encodings = [], []
            for ext, data in zip(b.column(1).to_pylist(), b.column(2)):
                if ext in binary:
                    text, e = binary[ext](data.as_py()), None
                else:
                    text, e = decoded(data.as_py())
                    text = parsers[ext](text)
                texts.append(text)
                encodings.append(e)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(encodings, pa.string())], ["path", "ext", "content", "encoding"])

    return run


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parsed_files(files: DataFrame, parsers: dict[str, Callable[[str], str]] | None = None, binary_parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, ext, content, encoding) of files (path, content) whose format is known, as the parser of their format gives them."""
    known, binary = PARSERS | (parsers or {}), BINARY_PARSERS | (binary_parsers or {})
    told = files.select("path", extension(F.col("path")).alias("ext"), "content").where(F.col("ext").isin([*known, *binary]))
    return told.mapInArrow(_parsed(known, binary), "path string, ext string, content string, encoding string")


def read_documents(spark: SparkSession, folder: str, recursive: bool = True, parsers: dict[str, Callable[[str], str]] | None = None, binary_parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(source, path, ext, title, content, encoding) of the files that can be read; others, and empty ones, are left out. ``parsers`` and ``binary_parsers`` add formats by
    extension, from text and from bytes."""
    docs = parsed_files(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder), parsers, binary_parsers)
    docs = docs.withColumn("source", F.element_at(F.split("path", "/"), -1))
    heading = F.regexp_extract("content", r"(?m)^#{1,6}\s*(.+?)\s*$", 1)
    content = F.when(F.col("ext").isin("md", "markdown"), T.markdown_to_text(F.col("content"))).otherwise(T.clean(F.col("content")))
    title = F.when(F.col("ext").isin("md", "markdown", "html", "htm") & (heading != ""), heading).otherwise(F.regexp_replace("source", r"\.[^.]+$", ""))
    return docs.withColumns({"title": title, "content": content}).where("content <> ''").select("source", "path", "ext", "title", "content", "encoding")


def _paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, ext, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            pages = PAGED[ext](data.as_py())
            n, titles, texts = zip(*pages) if pages else ((), (), ())
            yield pa.record_batch([pa.array([path] * len(pages), pa.string()), pa.array([ext] * len(pages), pa.string()), pa.array(n, pa.int32()), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array([len(pages)] * len(pages), pa.int32())], ["path", "ext", "page", "title", "content", "pages"])


def read_pages(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(source, path, ext, page, title, content, pages) of workbooks and presentations: a document for each sheet or slide that says something, numbered as it stands there, and how many there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", extension(F.col("path")).alias("ext"), "content")
    pages = files.where(F.col("ext").isin(list(PAGED))).mapInArrow(_paged, "path string, ext string, page int, title string, content string, pages int")
    pages = pages.withColumns({"source": F.element_at(F.split("path", "/"), -1), "content": T.clean(F.col("content"))}).where("content <> ''")
    return pages.select("source", "path", "ext", "page", "title", "content", "pages")


def fingerprint(content: Column) -> Column:
    return F.md5(content)

