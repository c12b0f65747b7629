"""Workbooks are read from the text of plain parts, or from their trees, with the same result; packages are read and written quickly."""

import io
import time
import xml.etree.ElementTree as ET
import zipfile

import pytest

from veilspark.operators import documents
from veilspark.plans import samples
from veilspark.sources import ooxml


def changed(content, parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in {**ooxml.Package(content).parts, **parts}.items():
            z.writestr(n, b)
    return out.getvalue()


SHEET = '<worksheet xmlns="urn:x" xmlns:a="urn:a"><cols><col min="2" max="2" hidden="1"/></cols><sheetData>{}</sheetData><pageSetup/></worksheet>'
BOOK = samples.xlsx("one two three")
CELLS = [
    '<row r="1" a:dyDescent="0.25"><c r="A1" s="3" t="s"><v>1</v></c><c r="B1"/><c r="C1"><v>4.5</v></c></row><row r="2" hidden="1"/>',
    '<row r="3" a:hidden="true"><c r="A3" t="inlineStr"><is><t xml:space="preserve"> R&amp;D &#x41;&#66; </t></is></c><c r="B3" t="b"><v>1</v></c><c r="C3"><f>A1&lt;[1]S!B2</f><v>x&gt;y > z</v></c></row>',
    '<row r="4"><c r="A4" t="s"><v>99</v></c><c r="B4" t="str"><v></v></c><c r="AB12" t="inlineStr"><v>n</v></c><c r="D4" t="s"><f>B1</f></c></row><row/>',
    '<row r="5"><c t="s" r="A5"><v>0</v></c></row>',
    '<row r="6"><c r="A6" t="inlineStr"><is><r><t>ri</t></r><r><t>ch</t></r></is></c></row>',
    '<row r="7"><!-- <c r="A7"><v>hidden</v></c> --><c r="B7"><v><![CDATA[<c r="C7"/>]]></v></c></row>',
    '<row r="8">\n <c r="A8"><v>1</v></c>\n</row>',
    '<row r="9"><c a:r="A9" r="B9"><v>1</v></c><c r="x1"><v>2</v></c></row>',
]


@pytest.mark.parametrize("cells", [*CELLS, "".join(CELLS[:3]), ""])
def test_plain_sheets_are_read_as_their_trees(cells, monkeypatch):
    strings = '<sst xmlns="urn:x" count="2"><si><t>a &amp; b</t></si><si><t xml:space="preserve"> x </t></si><si><t/></si></sst>'
    content = changed(BOOK, {"xl/worksheets/sheet1.xml": SHEET.format(cells), "xl/sharedStrings.xml": strings})
    quick = documents.extract("xlsx", content)
    spans = [(0, 3), (len(quick.text) - 5, len(quick.text))]
    copy = documents.redact("xlsx", content, spans, {h.id for h in quick.hidden})
    monkeypatch.setattr(ooxml.Package, "block", lambda *_: None)
    slow = documents.extract("xlsx", content)
    assert (quick.text, quick.items, quick.segments, quick.hidden) == (slow.text, slow.items, slow.segments, slow.hidden)
    assert copy == documents.redact("xlsx", content, spans, {h.id for h in slow.hidden})


@pytest.mark.parametrize("cells", ['<row r="1" r="2"><c r="A1"><v>1</v></c></row>', '<row b:x="1"><c r="A1"/></row>', '<row><c r="A1"><v>&nope;</v></c></row>', '<row><c r="A1"><v>\x0b</v></c></row>', "<row>"])
def test_sheets_that_are_not_well_formed_cannot_be_read(cells):
    with pytest.raises(ValueError, match=ooxml.UNREADABLE):
        documents.extract("xlsx", changed(BOOK, {"xl/worksheets/sheet1.xml": SHEET.format(cells)}))


def quickest(f):
    took = []
    for _ in range(3):
        start = time.process_time()
        f()
        took.append(time.process_time() - start)
    return min(took)


def test_cells_take_little_more_than_their_parsing():
    content = samples.xlsx(" ".join(f"w{i}" for i in range(40_000)))
    parts = ooxml.Package(content).parts
    parse = quickest(lambda: [ET.fromstring(parts[n]) for n in ("xl/worksheets/sheet1.xml", "xl/sharedStrings.xml")])
    assert quickest(lambda: documents.extract("xlsx", content)) < 2.5 * parse


def test_many_hidden_rows_are_removed_in_one_pass():
    root = ET.fromstring("<d>" + "<row/><x/>" * 30_000 + "</d>")
    start = time.process_time()
    documents._remove(root, list(root.iter("row")))
    assert time.process_time() - start < 3 and len(root) == 30_000 and {e.tag for e in root} == {"x"}


def test_a_formula_is_read_once_for_all_cells():
    places = [("Main", f"A{i}") for i in range(50_000)]
    start = time.process_time()
    assert not documents.reads_any("SUM(" + ",".join(f"B{i}" for i in range(200)) + ")", "Main", places)
    assert time.process_time() - start < 10 and documents.reads_any("Other!A1+$A$3:B9", "Main", [("Main", "A5")])
    assert not documents.reads_any('"A5"&[1]Main!A5', "Main", [("Main", "A5")])


def test_trees_are_written_as_by_the_library():
    xml = '<a:r xmlns:a="urn:a" xmlns="urn:d" x="&lt;&quot;&#10;&#9;&amp;&gt;" a:y="é"> t &amp; <b/>tail &gt;<c xml:lang="de">ü &lt;</c><a:n xmlns:z="urn:z" z:k=""/> </a:r>'
    root = ET.fromstring(xml)
    assert ooxml.written(root, dict(ooxml.WELL_KNOWN)) == ET.tostring(root, encoding="utf-8")
    assert ooxml.written(root, ooxml.WELL_KNOWN | {"urn:a": "a", "urn:d": "", "urn:z": "z"}).startswith(b'<a:r xmlns="urn:d" xmlns:a="urn:a" xmlns:z="urn:z" x=')


def test_a_copy_leaves_no_prefixes_to_the_next():
    p = ooxml.Package(changed(BOOK, {"a.xml": '<left:a xmlns:left="urn:left-over"/>'}))
    p.xml("a.xml")
    p.touch("a.xml")
    assert b"<left:a" in ooxml.Package(p.save()).parts["a.xml"]
    assert ET.tostring(ET.fromstring('<q:a xmlns:q="urn:left-over"/>')) == b'<ns0:a xmlns:ns0="urn:left-over" />'


def test_entries_are_read_as_by_the_library():
    b = changed(BOOK, {"ä/ü.bin": b"x" * 5000, "empty": b"", "xl/media/ö.png": bytes(range(256)) * 9})
    z = zipfile.ZipFile(io.BytesIO(b))
    assert ooxml.Package(b).parts == {n: z.read(n) for n in z.namelist()} == ooxml.Package(b"junk" + b).parts
    at = b.index(b"x" * 20) if b"x" * 20 in b else z.getinfo("ä/ü.bin").header_offset + 40
    with pytest.raises(ValueError, match=ooxml.UNREADABLE):
        ooxml.Package(b[:at] + b"\xff\xff" + b[at + 2 :])
