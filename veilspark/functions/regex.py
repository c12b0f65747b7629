"""One pattern syntax for two regex engines.

Rule patterns are written in ECMAScript unicode-mode syntax: ASCII word boundaries and digits,
Unicode white space.  ``java`` and ``re2`` give the equivalent for Spark and for the SQL twin.
"""

from __future__ import annotations

#: White space of ECMAScript, as ranges of code points.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
_JAVA_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _space_class() -> str:
    point = lambda c: f"\\x{{{c:x}}}"
    return "".join(point(a) if a == b else f"{point(a)}-{point(b)}" for a, b in SPACES)


SPACE_CLASS = _space_class()


def _translate(source: str, boundary: str) -> str:
    out, inside, i = [], False, 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            two = source[i : i + 2]
            out.append(boundary if two == "\\b" and not inside else (SPACE_CLASS if inside else f"[{SPACE_CLASS}]") if two == "\\s" else two)
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


def java(source: str, insensitive: bool = False, multiline: bool = False) -> str:
    flags = ("iu" if insensitive else "") + ("dm" if multiline else "")
    return (f"(?{flags})" if flags else "") + _translate(source, _JAVA_BOUNDARY)


def re2(source: str, insensitive: bool = False, multiline: bool = False) -> str:
    flags = ("i" if insensitive else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + _translate(source, "\\b")


def literal(text: str) -> str:
    """``text`` as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c.isspace() or ord(c) > 127 or c in "_-/:,;@'\"&%#!~`<>=" else "\\" + c for c in text)
