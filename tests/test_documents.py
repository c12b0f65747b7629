import io
import re
import zipfile

import numpy as np
import pytest

from veilspark.operators import documents, images
from veilspark.plans import samples
from veilspark.sources import ooxml, uploads

TEXT = "First line with ann@example.com inside\nSecond line about Project Juniper\n" + " ".join(f"w{i}" for i in range(30))


def part(content, name):
    return zipfile.ZipFile(io.BytesIO(content)).read(name).decode()


def test_docx_text_and_hidden_items():
    m = documents.extract("docx", samples.docx(TEXT))
    assert "First line with ann@example.com inside\nSecond line" in m.text
    assert {i.label for i in m.items} >= {"Body paragraph 1", "Table 1 R1C1", "Table 1 R1C2", "Comments paragraph 1", "Body field 1"}
    kinds = {h.id.split("-")[0]: h.kind for h in m.hidden}
    assert kinds == {"vanish": "hidden-text", "ins": "revision", "del": "revision", "field": "external-link", "comment": "comment", "metadata": "metadata", "link": "external-link"}
    assert m.images == ["word/media/image1.png"] and m.not_analysed == [("Image: word/media/image2.emf", "Image format not analysed")]
    for s in m.segments:
        assert s.node >= 0 and 0 <= s.start < s.end <= len(m.text)


@pytest.mark.parametrize("fmt", ["docx", "xlsx", "pptx"])
def test_redaction_leaves_nothing_behind(fmt):
    content = samples.MAKERS[fmt](TEXT)
    m = documents.extract(fmt, content)
    word = {"docx": "ann@example.com", "xlsx": "Second", "pptx": "Project Juniper"}[fmt]
    at = m.text.index(word)
    out, notes = documents.redact(fmt, content, [(at, at + len(word))], {h.id for h in m.hidden})
    again = documents.extract(fmt, out)
    assert documents.PLACEHOLDER in again.text and word not in again.text
    assert again.hidden == []
    assert documents.residue(fmt, out, [word, samples.SECRET, "Ann Writer", "ok"]) == []
    if fmt == "docx":  # in the others, texts run together once the tags are gone
        assert documents.residue(fmt, content, [word, "ok"]) == [word]
    p = ooxml.Package(out)
    assert p.reachable() == set(p.parts)
    if fmt == "docx":
        assert "deleted words" not in part(out, "word/document.xml") and "inserted" in again.text and "our site" in again.text
    if fmt == "xlsx":
        assert any("C9" in n for n in notes) and "Back" not in part(out, "xl/workbook.xml")


def test_span_over_two_runs_gets_one_placeholder():
    content = samples.docx("abcdefghij")
    m = documents.extract("docx", content)
    out, _ = documents.redact("docx", content, [(3, 8)], set())
    assert documents.extract("docx", out).text.startswith("abc[REDACTED]ij\n") and m.text.startswith("abcdefghij\n")


def test_shared_strings_are_pruned_and_renumbered():
    content = samples.xlsx("one two three four five")
    m = documents.extract("xlsx", content)
    at = m.text.index("two")
    out, _ = documents.redact("xlsx", content, [(at, at + 3)], set())
    again = documents.extract("xlsx", out)
    assert "two" not in part(out, "xl/sharedStrings.xml")
    assert [i.label for i in again.items][:4] == [i.label for i in m.items][:4]
    assert again.text.startswith("one\n[REDACTED]\nthree\nfour\nfive")


def test_formula_dependence():
    r = documents.reads
    assert r("SUM(A1:B3)", "S", "S", "B2") and not r("SUM(A1:B3)", "S", "T", "B2")
    assert r("'My Sheet'!$C$4+1", "S", "My Sheet", "C4") and r("t!A1", "S", "T", "A1")
    assert not r('"A1"&B2', "S", "S", "A1") and not r("[1]S!A1", "S", "S", "A1")
    assert documents.column_name(703) == "AAA" and documents.column_number("aaa") == 703


def test_fields_and_entities():
    assert documents.field_target('HYPERLINK \\l "place" "http://x.org"') == "http://x.org"
    assert documents.field_target("PAGE") is None and documents.field_target('HYPERLINK \\l "place"') is None
    assert documents.decode_entities("&lt;&#65;&#x42;&AMP;&nope;") == "<AB&&nope;"
    assert documents.contains_word("a cat.", "cat") and not documents.contains_word("concat", "cat") and documents.contains_word("c++x", "c++")


def test_pdf_strings():
    assert documents.pdf_strings(r"(a\(b\)c) (x(y)z) (\101\n) <41 4> (open") == ["a(b)c", "x(y)z", "A\n", "A@"]
    b = samples.pdf("plain words here")
    assert documents.residue("pdf", b, ["plain words", samples.SECRET, "elsewhere"]) == ["plain words", samples.SECRET]


def test_pdf_strings_of_any_length_and_stray_parentheses():
    long = "x" * 100_000 + " Hidden Falcon"
    assert documents.pdf_strings(f"({long}) Tj") == [long]
    assert documents.pdf_strings("(" * 50_000 + "(shown)") == ["shown"]
    assert documents.pdf_strings("a) (b) ) <4> (<4142>)") == ["b", "<4142>", "AB"]
    noise = b"stream\n\x01( ( \xff )\nendstream"
    b = b"%PDF-1.4 [(Hid) -20 (den)] TJ " + noise + b" (tail)"
    assert "hidden" in documents.pdf_views(b)[1] and documents.pdf_views(b)[0].endswith("tail")
    packet = b"<x:xmpmeta xmlns:x='adobe:ns:meta/'><d a='Ann &amp; Co'>by <i>Bea</i></d></x:xmpmeta>"
    assert documents.pdf_views(packet)[2:] == ["by bea", "adobe:ns:meta/ ann & co"]


def test_xml_is_searched_whether_well_formed_or_not():
    assert documents.xml_views(b"<a b='x &lt; y'>One <c>t</c>wo<!-- no --><![CDATA[ <three>]]></a>") == ["one two <three>", "x < y"]
    text, values = documents.xml_views(b"<a b='Ann &amp; Co'>One <c>t</c>wo &amp; three")
    assert text == "one two & three" and values == "ann & co"


def test_nested_and_broken_fields():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    mark = lambda k: f'<w:fldChar w:fldCharType="{k}"/>'
    code = lambda t: f"<w:instrText>{t}</w:instrText>"
    body = mark("begin") + code("IF ") + mark("begin") + code("PAGE") + mark("separate") + mark("end") + code("x") + mark("separate") + mark("begin") + code("inner") + mark("end") + code("stray") + mark("end") + '<w:fldSimple w:instr="DATE"/>' + mark("begin") + code("open")
    root = documents.ET.fromstring(f'<w:p xmlns:w="{w}">{body}</w:p>')
    assert [t for _, t in documents.docx_fields(root)] == ["PAGE", "inner", "stray", "IF x", "DATE", "open"]
    assert documents.field_target('includetext "C:\\\\a b.docx" \\c "X"') == "C:\\\\a b.docx"
    assert documents.field_target('HYPERLINK \\h \\t "_blank" http://y.org') == "http://y.org" and documents.field_target("HYPERLINK") is None


def test_unreadable_documents(spark):
    df = spark.createDataFrame([(1, "docx", bytearray(b"no zip")), (2, "docx", bytearray(samples.docx("x y")))], "file_id long, format string, content binary")
    got = {r.file_id: r.error for r in documents.extract_documents(df).collect()}
    assert got == {1: ooxml.UNREADABLE, 2: None}
    assert {r.file_id: r.error for r in ooxml.part_table(df).where("name is null").collect()} == {1: ooxml.UNREADABLE}


def test_relationship_paths_and_content_types():
    assert ooxml.resolve("word", "../docProps/core.xml") == "docProps/core.xml" and ooxml.resolve("word", "/a/./b.xml") == "a/b.xml"
    assert sorted(["header10.xml", "header2.xml"], key=ooxml.natural) == ["header2.xml", "header10.xml"]
    p = ooxml.Package(samples.docx("x"))
    assert p.content_type("word/document.xml") == "application/x-document.xml" and p.content_type("_rels/.rels").endswith("relationships+xml")
    assert "word/unused.xml" not in p.reachable()


def test_png_scan_and_redaction():
    b = samples.png("hello", trailing=b"tail")
    end = len(b) - 4
    assert images.scan_png(b) == (end, 4, True) and images.scan_png(b[: end - 3])[:2] == (None, 0)
    assert images.scan_png(b"plain") == (None, 0, False)
    before = images.decode_png(b)
    out = images.redact_png(b, [{"x": 5.2, "y": 4.0, "w": 1.0, "h": 1.0}])
    assert images.scan_png(out) == (None, 0, False)
    after = images.decode_png(out)
    assert (after[1:8, 2:10] == 0).all()
    mask = np.ones(after.shape[:2], bool)
    mask[1:8, 2:10] = False
    assert (after[mask] == before[mask]).all()


def test_png_filters_round_trip():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (5, 6, 3)).astype(np.int32)
    raw = bytearray()
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        raw.append(kind)
        for x in range(6):
            for c in range(3):
                left = pixels[y, x - 1, c] if x else 0
                up = pixels[y - 1, x, c] if y else 0
                corner = pixels[y - 1, x - 1, c] if x and y else 0
                p = left + up - corner
                d = [abs(p - left), abs(p - up), abs(p - corner)]
                guess = (0, left, up, (left + up) // 2, (left, up, corner)[d.index(min(d))])[kind]
                raw.append(int(pixels[y, x, c] - guess) & 255)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    b = images.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")
    assert (images.decode_png(b) == pixels).all()


def test_jpeg_scan():
    b = samples.jpeg("note", b"after\xff\xd9")
    end, size, metadata = images.scan_jpeg(b)
    assert b[end:] == b"after\xff\xd9" and size == 7 and metadata
    assert images.scan_jpeg(samples.jpeg(""))[1:] == (0, True)
    assert images.scan_jpeg(b"\xff\xd8\xff") == (None, 0, False) and images.scan_jpeg(b"x") == (None, 0, False)


def test_office_kinds():
    good = samples.docx("x")
    assert uploads.ooxml_kind("docx", good)[0] == "document"
    assert uploads.ooxml_kind("xlsx", good)[2] == uploads.OOXML["xlsx"][1]
    cfb = bytes.fromhex(uploads.CFB)
    assert uploads.ooxml_kind("docx", cfb + "EncryptionInfo".encode("utf-16-le"))[2] == "Encrypted document"
    assert uploads.ooxml_kind("docx", cfb)[2] == uploads.OOXML["docx"][1]
    out = io.BytesIO(good)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/vbaProject.bin", b"")
    assert uploads.ooxml_kind("docx", out.getvalue())[2] == uploads.MACROS


def test_metadata_and_links_are_named():
    m = documents.extract("xlsx", samples.xlsx("a b"))
    notes = " | ".join(h.note for h in m.hidden)
    for want in ("Hidden sheet 'Back'", "Hidden columns in sheet 'Main': D-E", "Comments in sheet 'Main' by Eve", "External link to other book.xlsx", "Defined name 'Rate' = Back!$A$1"):
        assert want in notes, notes
    assert re.search("author 'Ann Writer'", notes)


def test_made_files_hold_the_whole_text():
    text = "\n".join(f"line{i} " + " ".join(f"w{i}x{j}" for j in range(12)) for i in range(1200)) + "\nlast ann@example.com"
    for fmt in ("docx", "xlsx", "pptx"):
        m = documents.extract(fmt, samples.MAKERS[fmt](text))
        assert set(text.split()) <= set(m.text.split()), fmt
    labels = [i.label for i in documents.extract("xlsx", samples.xlsx(text)).items if i.kind == "grid"]
    assert len(labels) == len(set(labels)) and "Main!A9" in labels and "Main!A10" in labels
    content = samples.xlsx(text)
    m = documents.extract("xlsx", content)
    at = m.text.index("ann@example.com")
    out, _ = documents.redact("xlsx", content, [(at, at + 15)], set())
    assert "ann@example.com" not in documents.extract("xlsx", out).text
    assert documents.residue("pdf", samples.pdf(text), ["last ann@example.com"]) == ["last ann@example.com"]
    assert text.encode() in samples.png(text)
    notes, b, at = b"", samples.jpeg(text), 2
    assert len(text.encode()) > 65533 and images.scan_jpeg(b)[1:] == (0, True)
    while b[at + 1] != 0xDA:
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        notes += b[at + 4 : at + 2 + size] if b[at + 1] == 0xFE else b""
        at += 2 + size
    assert notes == text.encode()


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, b in parts.items():
            z.writestr(name, b)
    return out.getvalue()


def test_made_packages_are_whole_archives():
    z = zipfile.ZipFile(io.BytesIO(samples.docx("äöü one\ntwo")))
    assert z.testzip() is None and z.namelist()[0] == "[Content_Types].xml" and len(z.namelist()) == 9
    assert "äöü" in z.read("word/document.xml").decode() and z.read("word/media/image2.emf") == b"EMF"


def test_an_outline_is_of_what_can_be_read():
    whole = ooxml.Package(samples.docx("a b")).parts
    rels, foreign = whole["word/_rels/document.xml.rels"], b'<w:hdr xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><x xmlns="u"><instrText>c</instrText></x></w:hdr>'
    entity = b'<!DOCTYPE a [<!ENTITY x SYSTEM "f">]><a>&x;</a>'
    cases = [
        ({}, True), ({"_xmlsignatures/s.xml": b"<"}, True), ({"word/vbaProject.bin": b"m", "word/charts/chart1.xml": b"<", "word/embeddings/o.bin": b""}, True),
        ({"word/unused.xml": b"<"}, True), ({"word/header2.xml": foreign}, True), ({"word/header2.xml": b"<"}, False), ({"word/comments.xml": b"<w:a/>"}, False), ({"docProps/app.xml": b"<a>\x0b</a>"}, False),
        ({"docProps/core.xml": entity}, False), ({"docProps/core.xml": entity.replace(b"&x;", b"")}, True), ({"word/_rels/document.xml.rels": rels[:-1]}, False), ({"word/document.xml": None}, False), ({"word/document.xml": b""}, False),
    ]
    for change, readable in cases:
        content = packed({n: b for n, b in {**whole, **change}.items() if b is not None})
        if not readable:
            for read in (documents.extract, documents.outline):
                with pytest.raises(ValueError, match=ooxml.UNREADABLE):
                    read("docx", content)
            continue
        m, o = documents.extract("docx", content), documents.outline("docx", content)
        assert (m.images, m.not_analysed, m.signed) == (o.images, o.not_analysed, o.signed) and m.text and not o.text, change
    for fmt in ("xlsx", "pptx"):
        content = samples.MAKERS[fmt]("a b")
        assert documents.outline(fmt, content).hidden == documents.extract(fmt, content).hidden != []


def test_copies_are_written_with_the_prefixes_of_their_parts():
    p = ooxml.Package(packed({"a.xml": b'<q:a xmlns:q="urn:a"/>', "b.xml": b'<b xmlns="urn:b" xmlns:ns7="urn:c"><ns7:c/></b>'}))
    for n in p.names:
        p.xml(n)
        p.touch(n)
    other = ooxml.Package(packed({"a.xml": b'<r:a xmlns:r="urn:a"/>'}))
    assert other.xml("a.xml") is not None
    out = p.save()
    assert '<q:a xmlns:q="urn:a"' in part(out, "a.xml") and '<b xmlns="urn:b"' in part(out, "b.xml")


def test_notes_come_of_one_reading(spark):
    made = {1: samples.docx("x"), 2: b"no zip", 3: packed({**ooxml.Package(samples.docx("y")).parts, "_xmlsignatures/s.xml": b"<s/>"}), 4: packed({n: b for n, b in ooxml.Package(samples.docx("z")).parts.items() if not n.endswith("emf")})}
    files = spark.createDataFrame([(i, "docx", bytearray(c)) for i, c in made.items()], "file_id long, format string, content binary")
    dropped = ("signature-dropped", "The signature is dropped in the reviewed copy.")
    image = ("not-analysed", "Image: word/media/image2.emf: Image format not analysed")
    for fields in ((), ("file_id", "not_analysed", "signed")):
        notes = documents.document_notes(documents.extract_documents(files, fields=fields))
        assert sorted(map(tuple, notes.collect())) == [(1, *image), (3, *image), (3, *dropped)]
        assert notes.columns == ["file_id", "kind", "note"]
        assert notes._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
