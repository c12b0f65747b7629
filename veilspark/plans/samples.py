"""Office, image and PDF files made of a text, for queries and tests."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veilspark.operators.batches import frames, small_batches
from veilspark.operators.images import encode_png

_O = "http://schemas.openxmlformats.org"
W = f'xmlns:w="{_O}/wordprocessingml/2006/main" xmlns:r="{_O}/officeDocument/2006/relationships"'
X = f'xmlns="{_O}/spreadsheetml/2006/main" xmlns:r="{_O}/officeDocument/2006/relationships"'
P = f'xmlns:p="{_O}/presentationml/2006/main" xmlns:a="{_O}/drawingml/2006/main" xmlns:r="{_O}/officeDocument/2006/relationships"'
SECRET = "Hidden Falcon"


@lru_cache(64)
def _rels(*rows: tuple[str, str, str]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{_O}/officeDocument/2006/relationships/{t}" Target={quoteattr(u)}{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in u else ""}/>' for i, t, u in rows)
    return f'<Relationships xmlns="{_O}/package/2006/relationships">{body}</Relationships>'


def _zip(parts: dict[str, str | bytes]) -> bytes:
    types = f'<Types xmlns="{_O}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="application/x-{n.rpartition("/")[2]}"/>' for n in parts if n.endswith(".xml")) + "</Types>"
    files, directory, at = [], [], 0
    for n, part in {"[Content_Types].xml": types, **parts}.items():
        name, b = n.encode(), part.encode() if isinstance(part, str) else part
        # Version 2.0, no flags, stored, 1 January 1980; zipfile takes several times as long for parts so small.
        about = struct.pack("<5H3L2H", 20, 0, 0, 0, 33, zlib.crc32(b), len(b), len(b), len(name), 0)
        files += [b"PK\3\4", about, name, b]
        directory += [b"PK\1\2\x14\0", about, struct.pack("<3H2L", 0, 0, 0, 0, at), name]
        at += 30 + len(name) + len(b)
    listed, count = b"".join(directory), len(parts) + 1
    return b"".join([*files, listed, b"PK\5\6", struct.pack("<4H2LH", 0, 0, count, count, len(listed), at, 0)])


_CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Ann Writer</dc:creator></cp:coreProperties>'


def docx(text: str) -> bytes:
    lines = [x for x in text.split("\n") if x.strip()]
    run = lambda t, pr="": f"<w:r>{pr}<w:t xml:space=\"preserve\">{escape(t)}</w:t></w:r>"
    para = "".join(f"<w:p>{run(x[: len(x) // 2])}{run(x[len(x) // 2 :])}</w:p>" for x in lines)
    extra = (
        f"<w:p>{run('Visible ')}{run(SECRET, '<w:rPr><w:vanish/></w:rPr>')}{run(' tail')}</w:p>"
        '<w:p><w:ins w:id="1" w:author="Bea"><w:r><w:t>inserted</w:t></w:r></w:ins><w:del w:id="2" w:author="Cal"><w:r><w:delText>deleted words</w:delText></w:r></w:del></w:p>'
        '<w:p><w:commentRangeStart w:id="0"/><w:r><w:t>noted</w:t></w:r><w:commentRangeEnd w:id="0"/><w:r><w:commentReference w:id="0"/></w:r></w:p>'
        '<w:p><w:hyperlink r:id="rId9"><w:r><w:t>our site</w:t></w:r></w:hyperlink></w:p>'
        '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>HYPERLINK "https://field.example.org/x"</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>field text</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell one</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>cell two</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    )
    return _zip({
        "_rels/.rels": _rels(("rId1", "officeDocument", "word/document.xml"), ("rId2", "core-properties", "docProps/core.xml")),
        "word/document.xml": f"<w:document {W}><w:body>{para}{extra}</w:body></w:document>",
        "word/_rels/document.xml.rels": _rels(("rId9", "hyperlink", "https://www.example.com/a"), ("rId3", "comments", "comments.xml"), ("rId4", "image", "media/image1.png"), ("rId5", "image", "media/image2.emf")),
        "word/comments.xml": f'<w:comments {W}><w:comment w:id="0" w:author="Dee"><w:p><w:r><w:t>please check</w:t></w:r></w:p></w:comment></w:comments>',
        "word/media/image1.png": png(text),
        "word/media/image2.emf": b"EMF",
        "word/unused.xml": "<x/>",
        "docProps/core.xml": _CORE,
    })


def xlsx(text: str) -> bytes:
    words = text.split() or [""]
    number = lambda r: r + 1 + (r >= 8)  # noqa: E731  (row 9 holds the formulas)
    strings = "".join(f"<si><t>{escape(w)}</t></si>" for w in words)
    cells = lambda r: "".join(f'<c r="{chr(65 + c)}{number(r)}" t="s"><v>{r * 4 + c}</v></c>' for c in range(4) if r * 4 + c < len(words))
    rows = [f'<row r="{number(r)}"{" hidden=" + chr(34) + "1" + chr(34) if r == 2 else ""}>{cells(r)}</row>' for r in range(-(-len(words) // 4))]
    return _zip({
        "_rels/.rels": _rels(("rId1", "officeDocument", "xl/workbook.xml"), ("rId2", "core-properties", "docProps/core.xml")),
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="Main" sheetId="1" r:id="rId1"/><sheet name="Back" sheetId="2" state="hidden" r:id="rId2"/></sheets><externalReferences><externalReference r:id="rId4"/></externalReferences><definedNames><definedName name="Rate">Back!$A$1</definedName><definedName name="Far">[1]S!$A$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": _rels(("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "worksheet", "worksheets/sheet2.xml"), ("rId3", "sharedStrings", "sharedStrings.xml"), ("rId4", "externalLink", "externalLinks/externalLink1.xml")),
        "xl/sharedStrings.xml": f'<sst {X} count="{len(words)}">{strings}</sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet {X}><cols><col min="4" max="5" hidden="1"/></cols><sheetData>{"".join(rows[:8])}<row r="9"><c r="A9"><f>SUM(A1:B1)</f><v>3</v></c><c r="B9" t="inlineStr"><is><t>inline</t></is></c><c r="C9"><f>Back!A1</f><v>7</v></c></row>{"".join(rows[8:])}</sheetData></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": _rels(("rId1", "comments", "../comments1.xml")),
        "xl/comments1.xml": f'<comments {X}><authors><author>Eve</author></authors><commentList><comment ref="A1" authorId="0"><text><t>check this</t></text></comment></commentList></comments>',
        "xl/worksheets/sheet2.xml": f'<worksheet {X}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{SECRET}</t></is></c></row></sheetData></worksheet>',
        "xl/externalLinks/externalLink1.xml": f"<externalLink {X}/>",
        "xl/externalLinks/_rels/externalLink1.xml.rels": _rels(("rId1", "externalLinkPath", "file:///c/other%20book.xlsx")).replace('Target="file', 'TargetMode="External" Target="file').replace('" TargetMode="External"/>', '"/>'),
        "docProps/core.xml": _CORE,
    })


def pptx(text: str) -> bytes:
    lines = [x for x in text.split("\n") if x.strip()] or ["empty"]
    slide = lambda ts, show="": f'<p:sld {P}{show}><p:cSld><p:spTree><p:sp><p:txBody>{"".join(f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>" for t in ts)}</p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    return _zip({
        "_rels/.rels": _rels(("rId1", "officeDocument", "ppt/presentation.xml"), ("rId2", "core-properties", "docProps/core.xml")),
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="rId1"/><p:sldId id="257" r:id="rId2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": _rels(("rId1", "slide", "slides/slide1.xml"), ("rId2", "slide", "slides/slide2.xml"), ("rId3", "commentAuthors", "commentAuthors.xml")),
        "ppt/slides/slide1.xml": slide(lines),
        "ppt/slides/slide2.xml": slide([SECRET], ' show="0"'),
        "ppt/slides/_rels/slide1.xml.rels": _rels(("rId1", "notesSlide", "../notesSlides/notesSlide1.xml"), ("rId2", "comments", "../comments/comment1.xml")),
        "ppt/notesSlides/notesSlide1.xml": slide(["speak slowly"]),
        "ppt/commentAuthors.xml": f'<p:cmAuthorLst {P}><p:cmAuthor id="0" name="Flo"/></p:cmAuthorLst>',
        "ppt/comments/comment1.xml": f'<p:cmLst {P}><p:cm authorId="0"><p:text>too long</p:text></p:cm></p:cmLst>',
        "docProps/core.xml": _CORE,
    })


def png(text: str, metadata: bool = True, trailing: bytes = b"") -> bytes:
    seed = zlib.crc32(text.encode())
    pixels = np.random.default_rng(seed).integers(0, 255, (12, 20, 3), dtype=np.uint8)
    b = encode_png(pixels)
    if metadata:
        data = b"Comment\0" + text.encode()
        b = b[:33] + struct.pack(">I", len(data)) + b"tEXt" + data + struct.pack(">I", zlib.crc32(b"tEXt" + data)) + b[33:]
    return b + trailing


def jpeg(text: str, trailing: bytes = b"") -> bytes:
    note = text.encode()
    segment = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    thumb = b"Exif\0\0\xff\xd8 thumb \xff\xd9"
    return b"\xff\xd8" + segment(0xE1, thumb) + b"".join(segment(0xFE, note[i : i + 65533]) for i in range(0, len(note), 65533)) + segment(0xDA, b"\1\2\3") + b"data\xff\0more\xff\xd0end" + b"\xff\xd9" + trailing


def pdf(text: str) -> bytes:
    words = text.split()
    show = " ".join(f"({w.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj" for w in words).encode("latin-1", "replace")
    return b"%PDF-1.4\n1 0 obj\n<< /Title <FEFF" + SECRET.encode("utf-16-be").hex().encode() + b"> >>\nstream\n" + zlib.compress(show) + b"\nendstream\nendobj\n%%EOF"


MAKERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "png": png, "jpeg": jpeg, "pdf": pdf}


def make(files: DataFrame, fmt: str) -> DataFrame:
    """(file_id, format, content): a file of the given format for each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            more = [{"trailing": b"extra" * int(i % 3)} if fmt in ("png", "jpeg") else {} for i in b["file_id"]]
            made = ((i, fmt, MAKERS[fmt](t, **m)) for i, t, m in zip(b["file_id"], b["text"], more))
            yield from frames(((len(r[2]), [r]) for r in made), ["file_id", "format", "content"])

    return small_batches(files).select("file_id", "text").mapInPandas(run, "file_id long, format string, content binary")
