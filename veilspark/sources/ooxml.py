"""Office packages: parts, relationships, content types, reachability; as a class and as DataFrames."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.batches import frames, small_batches

UNREADABLE = "The document cannot be read."
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


@lru_cache(4096)
def natural(name: str) -> tuple:
    """Sorts header2 before header10."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name) if x)


@lru_cache(4096)
def _base(name: object) -> str:
    """A tag or attribute name without its namespace; what isn't an element has none."""
    return name.rpartition("}")[2] if isinstance(name, str) else ""


def local(e: ET.Element) -> str:
    return _base(e.tag)


def attr(e: ET.Element, name: str) -> str | None:
    """An attribute by local name, whatever its namespace."""
    for k, v in e.items():
        if k == name or k[0] == "{" and _base(k) == name:
            return v
    return None


def each(root: ET.Element | None, *names: str) -> list[ET.Element]:
    """Elements of some local names, in order; a tree has few tags, so those are compared, and the elements found by them."""
    if root is None:
        return []
    tags = [t for t in {e.tag for e in root.iter()} if _base(t) in names]
    return list(root.iter(tags[0])) if len(tags) == 1 else [e for e in root.iter() if e.tag in tags] if tags else []


def children(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if not names or _base(c.tag) in names]


def text_of(e: ET.Element) -> str:
    return "".join(e.itertext())


def host_of(target: str) -> str:
    try:
        return urlsplit(target).netloc.rpartition("@")[2]
    except ValueError:
        return ""


#: A part that begins with its root, or with a declaration of UTF-8 or of no encoding.
_UTF8 = re.compile(rb"""(?:<\?xml version=["']1\.0["'](?: encoding=["']utf-8["'])?(?: standalone=["']\w+["'])? ?\?>)?\s*<[^?!]""", re.I)


def _parser() -> expat.XMLParserType:
    return expat.ParserCreate(None, "}")


def _undefined(name: str, is_parameter: bool) -> None:
    if not is_parameter:
        raise ValueError(f"undefined entity {name}")


#: Prefixes of namespaces that no part needs to declare (fixed values of ElementTree).
WELL_KNOWN = {"http://www.w3.org/XML/1998/namespace": "xml", "http://www.w3.org/1999/xhtml": "html", "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf", "http://schemas.xmlsoap.org/wsdl/": "wsdl", "http://www.w3.org/2001/XMLSchema": "xs", "http://www.w3.org/2001/XMLSchema-instance": "xsi", "http://purl.org/dc/elements/1.1/": "dc"}
_TEXT = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}
_VALUE = {**_TEXT, '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"}


def _escaped(text: str, marks: dict[str, str]) -> str:
    for mark, code in marks.items():
        if mark in text:
            text = text.replace(mark, code)
    return text


class _Names(dict):
    """Names as they are written, each given a prefix when it is first met; ``used`` are the namespaces to declare."""

    def __init__(self, prefixes: dict[str, str]) -> None:
        super().__init__()
        self.prefixes, self.used = prefixes, {}

    def __missing__(self, name: str) -> str:
        uri, _, base = name[1:].rpartition("}") if name[0] == "{" else ("", "", name)
        prefix = ""
        if name[0] == "{":
            prefix = self.used.get(uri)
            if prefix is None:
                prefix = self.prefixes.get(uri)
                prefix = f"ns{len(self.used)}" if prefix is None else prefix
                if prefix != "xml":
                    self.used[uri] = prefix
        self[name] = out = f"{prefix}:{base}" if prefix else base
        return out


def written(root: ET.Element, prefixes: dict[str, str]) -> bytes:
    """A tree as ``ET.tostring`` writes it, in one pass and with prefixes of its own."""
    names, out = _Names(prefixes), []
    add = out.append

    def put(elements: Iterable[ET.Element]) -> None:
        for e in elements:
            name, text, tail = names[e.tag], e.text, e.tail
            add(f"<{name}")
            for k, v in e.items():
                add(f' {names[k]}="{v if v.isalnum() else _escaped(v, _VALUE)}"')
            if len(e):
                add(f">{_escaped(text, _TEXT)}" if text else ">")
                put(e)
                add(f"</{name}>")
            elif text:
                add(f">{text if text.isalnum() else _escaped(text, _TEXT)}</{name}>")
            else:
                add(" />")
            if tail and e is not root:
                add(_escaped(tail, _TEXT))

    put([root])
    declared = "".join(f' xmlns{p and ":" + p}="{_escaped(u, _VALUE)}"' for u, p in sorted(names.used.items(), key=lambda x: x[1]))
    out[0] += declared
    return "".join(out).encode("utf-8", "xmlcharrefreplace")


@dataclass
class Relationship:
    id: str
    type: str
    target: str
    external: bool


def _entry(content: bytes, i: zipfile.ZipInfo) -> bytes | None:
    """An entry of an archive in memory, cut out of it; None where something is unusual, which ``ZipFile.read`` looks into."""
    if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or i.flag_bits & ~0x80E:
        return None
    head = content[i.header_offset : i.header_offset + 30]
    if len(head) < 30 or head[:4] != b"PK\3\4":
        return None
    flags, name, extra = struct.unpack("<2xH", head[4:8])[0], *struct.unpack("<2H", head[26:30])
    at = i.header_offset + 30 + name
    if content[at - name : at] != i.orig_filename.encode("utf-8" if flags & 0x800 else "cp437", "replace"):
        return None
    data = content[at + extra : at + extra + i.compress_size]
    if i.compress_type == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompressobj(-15).decompress(data, i.file_size + 1)
        except zlib.error:
            return None
    return data if len(data) == i.file_size and zlib.crc32(data) == i.CRC else None


class Package:
    def __init__(self, content: bytes) -> None:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            self.parts = {i.filename: _entry(content, i) or z.read(i) for i in z.infolist() if not i.is_dir()}
        except (zipfile.BadZipFile, ValueError, OSError, RuntimeError, EOFError, zlib.error) as e:
            raise ValueError(UNREADABLE) from e
        self._trees: dict[str, ET.Element] = {}
        self._read: dict[str, bytes] = {}
        self._touched: set[str] = set()

    @property
    def names(self) -> list[str]:
        return sorted(self.parts, key=natural)

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.parts:
            return None
        if name not in self._trees:
            try:
                self._trees[name] = ET.fromstring(self.parts[name])
            except (ET.ParseError, ValueError) as e:
                raise ValueError(UNREADABLE) from e
            self._read.setdefault(name, self.parts[name])
        return self._trees[name]

    def check(self, name: str) -> None:
        """Raises what ``xml`` raises for a part, if there is one; makes no tree of it."""
        if name in self._trees or name not in self.parts:
            return
        parser = _parser()
        # Expat passes over entities of other files, of which no tree can be made.
        parser.SkippedEntityHandler = _undefined
        parser.ExternalEntityRefHandler = lambda *_: 0
        try:
            parser.Parse(self.parts[name], True)
        except (expat.ExpatError, ValueError) as e:
            raise ValueError(UNREADABLE) from e

    def block(self, name: str, grammar: re.Pattern) -> tuple[ET.Element, str] | None:
        """A part as the tree of all but the first place where ``grammar`` matches, and that place's text.

        Long lists of elements are read quicker from their text.  None where the place isn't found, the part isn't UTF-8,
        or something in it (comments, CDATA, a document type) could look like elements; then the part's tree is to be read.
        """
        part = self.parts.get(name, b"")
        if name in self._trees or b"<!" in part or not _UTF8.match(part):
            return None
        try:
            text = part.decode()
        except UnicodeDecodeError:
            return None
        found = grammar.search(text)
        if found is None:
            return None
        self.check(name)
        self._read.setdefault(name, part)
        return ET.fromstring(text[: found.start()] + text[found.end() :]), found[0]

    def required(self, name: str) -> ET.Element:
        root = self.xml(name)
        if root is None:
            raise ValueError(UNREADABLE)
        return root

    def touch(self, name: str) -> None:
        """Marks a part as changed, so that its tree is written."""
        self._touched.add(name)

    def drop(self, name: str) -> None:
        self.parts.pop(name, None)
        self._trees.pop(name, None)
        self._touched.discard(name)

    def rels_part(self, owner: str) -> str:
        folder, slash, base = owner.rpartition("/")
        return f"{folder}{slash}_rels/{base}.rels"

    def rels(self, owner: str) -> list[Relationship]:
        """Relationships of a part; of the package itself for the empty name."""
        root = self.xml(self.rels_part(owner))
        out = []
        for e in each(root, "Relationship"):
            kind, target = e.get("Type", ""), e.get("Target", "")
            external = e.get("TargetMode") == "External" or kind.endswith("/attachedTemplate")
            out.append(Relationship(e.get("Id", ""), kind, target if external else resolve(owner.rpartition("/")[0], target), external))
        return out

    def owners(self) -> list[str]:
        found = [re.fullmatch(r"(.*)_rels/(.*)\.rels", n) for n in self.names]
        return [m[1] + m[2] for m in found if m]

    def drop_rel(self, owner: str, rel_id: str) -> None:
        root = self.xml(self.rels_part(owner))
        for e in each(root, "Relationship"):
            if e.get("Id") == rel_id:
                root.remove(e)
                self.touch(self.rels_part(owner))

    def reachable(self) -> set[str]:
        """Parts that relationships reach from the package, each with its own relationships part."""
        seen, todo = {"[Content_Types].xml", "_rels/.rels"}, [""]
        while todo:
            owner = todo.pop()
            for r in self.rels(owner):
                if not r.external and r.target in self.parts and r.target not in seen:
                    seen |= {r.target, self.rels_part(r.target)}
                    todo.append(r.target)
        return {n for n in seen if n in self.parts}

    def sweep(self) -> None:
        """Drops relationships to missing parts, unreachable parts, and content types of neither."""
        for owner in self.owners():
            for r in self.rels(owner):
                if not r.external and r.target not in self.parts:
                    self.drop_rel(owner, r.id)
        keep = self.reachable()
        for name in set(self.parts) - keep:
            self.drop(name)
        types = self.xml("[Content_Types].xml")
        for e in [x for x in each(types, "Override") if x.get("PartName", "").lstrip("/") not in self.parts]:
            types.remove(e)
            self.touch("[Content_Types].xml")

    def content_type(self, name: str) -> str | None:
        root = self.xml("[Content_Types].xml")
        for e in each(root, "Override"):
            if e.get("PartName") == f"/{name}":
                return e.get("ContentType")
        extension = name.rpartition(".")[2].lower()
        return next((e.get("ContentType") for e in each(root, "Default") if e.get("Extension", "").lower() == extension), None)

    def _prefixes(self) -> dict[str, str]:
        """Namespaces with the prefixes of the parts that were read; of two for one name, the later."""
        known = dict(WELL_KNOWN)

        def keep(prefix: str | None, uri: str | None) -> None:
            prefix, uri = prefix or "", uri or ""
            if not re.fullmatch(r"ns\d+", prefix):
                for other in [u for u, p in known.items() if u == uri or p == prefix]:
                    del known[other]
                known[uri] = prefix

        for part in self._read.values():
            parser = _parser()
            parser.StartNamespaceDeclHandler = keep
            last = part.rfind(b"xmlns")
            # Behind the tag of the last declaration there is none to read, unless it is one of a document type or not in ASCII.
            end = part.find(b"<", last) if last >= 0 and b"<!DOCTYPE" not in part else -1
            if end < 0:
                parser.Parse(part, True)
            else:
                parser.Parse(part[:end], False)
        return known

    def save(self) -> bytes:
        prefixes = self._prefixes()
        for name in self._touched & set(self._trees):
            self.parts[name] = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + written(self._trees[name], prefixes)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(self.parts, key=lambda n: (n != "[Content_Types].xml", natural(n))):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), self.parts[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def resolve(folder: str, target: str) -> str:
    parts = [] if target.startswith("/") else [p for p in folder.split("/") if p]
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in (".", ""):
            parts.append(p)
    return "/".join(parts)


def part_table(files: DataFrame) -> DataFrame:
    """(file_id, name, content_type, size, content, error) of every part; a broken file gives one row with the error."""

    def parts(i: int, c: bytes) -> list[tuple]:
        try:
            p = Package(bytes(c))
            return [(i, n, p.content_type(n), len(p.parts[n]), p.parts[n], None) for n in p.names]
        except ValueError as e:
            return [(i, None, None, 0, None, str(e))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (parts(i, c) for i, c in zip(batch["file_id"], batch["content"]))
            # What is packed can be larger than its file.
            yield from frames(((sum(r[3] for r in of_file), of_file) for of_file in rows), ["file_id", "name", "content_type", "size", "content", "error"])

    return small_batches(files).select("file_id", "content").mapInPandas(run, "file_id long, name string, content_type string, size long, content binary, error string")


def relationship_table(files: DataFrame) -> DataFrame:
    """(file_id, owner, id, type, target, external): the edges between parts."""

    def edges(i: int, c: bytes) -> list[tuple]:
        try:
            p = Package(bytes(c))
            return [(i, o, r.id, r.type.rpartition("/")[2], r.target, r.external) for o in p.owners() for r in p.rels(o)]
        except ValueError:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((len(c), edges(i, c)) for i, c in zip(batch["file_id"], batch["content"]))
            yield from frames(rows, ["file_id", "owner", "id", "type", "target", "external"])

    return small_batches(files).select("file_id", "content").mapInPandas(run, "file_id long, owner string, id string, type string, target string, external boolean")


def reachable_parts(edges: DataFrame) -> DataFrame:
    """(file_id, part) reached from each file's package by internal edges (file_id, owner, target), breadth first.

    A round is a join on the new parts only; it ends when a round finds none.
    """
    inner = edges.where("not external").select("file_id", "owner", "target").distinct()
    seen = inner.where("owner = ''").select("file_id", F.col("target").alias("part")).distinct()
    new = seen
    while True:
        found = new.join(inner, (new.file_id == inner.file_id) & (new.part == inner.owner)).select(new.file_id, F.col("target").alias("part")).distinct()
        new = found.join(seen, ["file_id", "part"], "left_anti").cache()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen
