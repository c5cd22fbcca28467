"""Workbooks and presentations made here, part by part."""

import io
import zipfile

import pytest

from scholia.sources import files, office

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHOW = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def relations(**targets):
    return f'<Relationships xmlns="{RELS}">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def workbook(*sheets, strings="", styles="", setting=""):
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1))
    parts = {"xl/workbook.xml": f"<workbook {MAIN}>{setting}<sheets>{names}</sheets></workbook>"}
    # the order of the file names isn't that of the sheets
    parts["xl/_rels/workbook.xml.rels"] = relations(**{f"r{i}": f"worksheets/sheet{len(sheets) - i}.xml" for i in range(1, len(sheets) + 1)})
    for i, (_, rows) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{len(sheets) - i}.xml"] = f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>"
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>{strings}</sst>"
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {MAIN}>{styles}</styleSheet>"
    return archive(**parts)


CELLS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"/><row r="4"><c r="A4"><v>5</v></c><c r="B4"><v>2.50</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" t="e"><v>#N/A</v></c></row>'
    '<row r="5"><c r="A5" s="1"><v>45292</v></c><c r="B5" s="2"><v>0.75</v></c><c r="C5" t="str"><f>A1</f><v>told</v></c><c r="AB5" t="inlineStr"><is><t>far</t></is></c></row>'
)
STRINGS = "<si><t>Name</t></si><si><r><t>Rich </t></r><r><t>text</t></r><rPh><t>guide</t></rPh></si>"
STYLES = '<numFmts><numFmt numFmtId="164" formatCode="hh:mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'


def test_cells_of_every_kind_and_sheets_in_order():
    data = workbook(("First", CELLS), ("Empty", ""), ("Last", '<row r="1"><c t="inlineStr"><is><t>x</t></is></c><c><v>1</v></c></row>'), strings=STRINGS, styles=STYLES)
    got = office.sheets(data)
    assert [(n, t) for n, t, _ in got] == [(1, "First"), (3, "Last")]
    lines = got[0][2].split("\n")
    assert lines[0] == "# First" and [c.strip() for c in lines[2].split("|")[1:5]] == ["Name", "", "Rich text", ""]
    assert [c.strip() for c in lines[4].split("|")[1:5]] == ["5", "2.5", "True", "#N/A"]
    assert [c.strip() for c in lines[5].split("|")[1:29]] == ["2024-01-01 00:00:00", "18:00:00", "told", *[""] * 24, "far"]
    assert got[1][2] == "# Last\n\n| x | 1 |\n| --- | --- |"
    old = workbook(("S", '<row r="1"><c r="A1" s="1"><v>1</v></c></row>'), styles=STYLES, setting='<workbookPr date1904="1"/>')
    assert "1904-01-02" in office.sheets(old)[0][2]


def test_rows_beyond_the_first_are_left_out():
    data = workbook(("S", "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 700))))
    assert office.sheets(data)[0][2].count("\n") == 2 + 500 and "| 500 |" in office.sheets(data)[0][2] and "| 501 |" not in office.sheets(data)[0][2]


def presentation():
    box = lambda text, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{text}</p:txBody></p:sp>'
    line = lambda *runs: "<a:p>" + "".join("<a:br/>" if r == "\n" else f"<a:r><a:t>{r}</a:t></a:r>" for r in runs) + "</a:p>"
    cell = lambda t: f"<a:tc><a:txBody>{line(t)}</a:txBody></a:tc>"
    table = f'<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell("k")}{cell("v")}</a:tr><a:tr>{cell("a")}{cell("1")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    slide = lambda *shapes: f"<p:sld {SHOW}><p:cSld><p:spTree><p:nvGrpSpPr/>{''.join(shapes)}</p:spTree></p:cSld></p:sld>"
    return {
        "ppt/presentation.xml": f'<p:presentation {SHOW}><p:sldIdLst><p:sldId id="9" r:id="rB"/><p:sldId id="2" r:id="rA"/><p:sldId id="3" r:id="rC"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(rA="slides/slide1.xml", rB="/ppt/slides/slide2.xml", rC="slides/slide3.xml"),
        "ppt/slides/slide1.xml": slide(box(line("Two ", "runs") + line("next", "\n", "line")), table),
        "ppt/slides/slide2.xml": slide(box(line("Opening"), '<p:ph type="ctrTitle"/>'), box(line("Body"))),
        "ppt/slides/slide3.xml": slide(box(line(" "))),
    }


def test_slides_in_the_order_of_the_show():
    data = archive(**presentation())
    assert office.slides(data) == [(1, "Opening", "Opening\n\nBody"), (2, "", "Two runs\nnext\nline\n\n| k | v |\n| --- | --- |\n| a | 1 |")]
    assert office.show_text(data).startswith("# Opening\n\nOpening") and "# Slide 2\n\n" in office.show_text(data)


@pytest.mark.parametrize("data", [b"", b"no archive", archive(x="y"), archive(**{"xl/workbook.xml": "<broken"}), archive(**{"ppt/presentation.xml": f'<p:presentation {SHOW}><p:sldIdLst><p:sldId r:id="none"/></p:sldIdLst></p:presentation>'})])
def test_what_is_no_office_file_says_nothing(data):
    assert office.sheets(data) == office.slides(data) == []


def test_archives_that_unpack_to_any_size_are_refused(monkeypatch):
    data = workbook(("S", '<row r="1"><c r="A1"><v>1</v></c></row>'), strings="<si><t>" + "a" * 3_000_000 + "</t></si>")
    assert len(data) < 20_000 and office.sheets(data)
    monkeypatch.setattr(office, "MOST_BYTES", 1_000_000)
    assert office.sheets(data) == []


def test_pages_of_a_folder(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook(("First", CELLS), ("Last", '<row r="1"><c r="A1"><v>7</v></c></row>'), strings=STRINGS, styles=STYLES))
    (tmp_path / "show.pptx").write_bytes(archive(**presentation()))
    (tmp_path / "odd.xlsx").write_bytes(b"odd")
    got = {(r.source, r.page): (r.title, r.pages, r.content) for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {("book.xlsx", 1): ("First", 2), ("book.xlsx", 2): ("Last", 2), ("show.pptx", 1): ("Opening", 2), ("show.pptx", 2): ("", 2)}
    whole = {r.source: r.content for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(whole) == {"book.xlsx", "show.pptx"} and "# Last" in whole["book.xlsx"]
