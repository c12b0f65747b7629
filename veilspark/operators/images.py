"""Image bytes: structure of PNG and JPEG files, findings from it, and redaction of PNG pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.batches import frames, small_batches

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_METADATA = (b"tEXt", b"zTXt", b"iTXt", b"eXIf")
SCAN = "file_id long, format string, end_offset long, trailing_size long, has_metadata boolean"


def png_chunks(b: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of data, end of chunk) of each complete chunk."""
    at = len(PNG_SIGNATURE)
    while b.startswith(PNG_SIGNATURE) and at + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + size > len(b):
            return
        yield kind, at + 8, at + 12 + size
        at += 12 + size


def scan_png(b: bytes) -> tuple[int | None, int, bool]:
    """Where bytes after the image begin (null if none), how many, and whether there is metadata."""
    metadata = False
    for kind, _, end in png_chunks(b):
        metadata |= kind in PNG_METADATA
        if kind == b"IEND":
            return (end, len(b) - end, metadata) if len(b) > end else (None, 0, metadata)
    return None, 0, metadata


def _scan_end(b: bytes, at: int) -> tuple[int, bool]:
    """From entropy-coded data: where it stops, and whether at an end marker (then behind it)."""
    while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b):
        code = b[at + 1]
        if code == 0xD9:
            return at + 2, True
        if code and not 0xD0 <= code <= 0xD7:
            return at, False
        at += 2
    return len(b), False


def scan_jpeg(b: bytes) -> tuple[int | None, int, bool]:
    """End of the image (null if it has none), bytes after it, and whether there is metadata."""
    if not b.startswith(b"\xff\xd8"):
        return None, 0, False
    at, end, metadata = 2, None, False
    while at + 1 < len(b) and b[at] == 0xFF:
        marker, at = b[at + 1], at + 2
        if marker == 0xD9:
            end = at
            break
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            continue
        size = int.from_bytes(b[at : at + 2], "big") if at + 2 <= len(b) else 0
        if size < 2 or at + size > len(b):
            break
        body = b[at + 2 : at + size]
        metadata |= marker == 0xE1 and (body.startswith(b"Exif\0\0") or b"http://ns.adobe.com/xap/1.0/" in body[:29])
        metadata |= marker == 0xED and b"Photoshop 3.0" in body[:14]
        metadata |= marker == 0xFE and bool(body)
        at += size
        if marker == 0xDA:
            at, done = _scan_end(b, at)
            if done:
                end = at
                break
    return end, 0 if end is None else len(b) - end, metadata


def scan_images(files: DataFrame) -> DataFrame:
    """Structure of image files (file_id, content); others give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, c in zip(batch["file_id"], batch["content"]):
                b = bytes(c)
                kind = "png" if b.startswith(PNG_SIGNATURE) else "jpeg" if b.startswith(b"\xff\xd8") else None
                rows.append((i, kind, *(scan_png(b) if kind == "png" else scan_jpeg(b))))
            out = pd.DataFrame(rows, columns=["file_id", "format", "end_offset", "trailing_size", "has_metadata"])
            yield out.astype({"end_offset": "Int64"})

    return small_batches(files).select("file_id", "content").mapInPandas(run, SCAN)


def image_findings(scans: DataFrame) -> DataFrame:
    """Findings of image structure: bytes after the image, and metadata."""
    one = lambda rule, category, title, at: F.struct(F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(title).alias("title"), at.cast("bigint").alias("byte_offset"))
    none = F.lit(None)
    found = F.array_compact(F.array(
        F.when((F.col("format") == "png") & (F.col("trailing_size") > 0), one("png-trailing-data", "hidden-data", "Data after the end of the image", F.col("end_offset"))),
        F.when((F.col("format") == "jpeg") & (F.col("trailing_size") > 0), one("jpeg-trailing-data", "hidden-data", "Data after the end of the image", F.col("end_offset"))),
        F.when(F.col("has_metadata"), one("image-metadata", "metadata", "Image metadata", none)),
    ))
    return scans.select("file_id", F.inline(found))


# -- pixels


def decode_png(b: bytes) -> np.ndarray:
    """Rows x columns x channels of an 8-bit, non-interlaced PNG; palettes become colours."""
    head, body, palette, alpha = None, [], None, None
    for kind, start, end in png_chunks(b):
        data = b[start : end - 4]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = data
        elif kind == b"IDAT":
            body.append(data)
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("The image data cannot be read.")
    width, height, _, color, *_ = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: height * (width * channels + 1)].reshape(height, -1)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int32), above, channels)
        above = out[y].astype(np.int32)
    pixels = out.reshape(height, width, channels)
    if color == 3:
        table = np.concatenate((palette, np.full((len(palette), 1), 255, np.uint8)), axis=1)
        if alpha:
            table[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        pixels = table[pixels[..., 0]]
    return pixels


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
    got = line.copy()
    for i in range(len(got)):
        left = int(got[i - step]) if i >= step else 0
        up = int(above[i])
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = int(above[i - step]) if i >= step else 0
            by = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
            guess = (left, up, corner)[by.index(min(by))]
        got[i] = (got[i] + guess) & 255
    return got


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of these pixels and nothing else."""
    height, width, channels = pixels.shape
    raw = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def padded(box: dict, width: int, height: int, by: int = 3) -> tuple[int, int, int, int] | None:
    left, top = max(0, int(np.floor(box["x"])) - by), max(0, int(np.floor(box["y"])) - by)
    right, bottom = min(width, int(np.ceil(box["x"] + box["w"])) + by), min(height, int(np.ceil(box["y"] + box["h"])) + by)
    return (left, top, right, bottom) if right > left and bottom > top else None


def redact_png(b: bytes, boxes: list[dict]) -> bytes:
    """The image with padded boxes painted black (alpha stays), encoded anew without metadata."""
    pixels = decode_png(b).copy()
    height, width, channels = pixels.shape
    colors = channels if channels < 3 else 3
    colors -= channels == 2
    for box in boxes:
        p = padded(box, width, height)
        if p:
            pixels[p[1] : p[3], p[0] : p[2], :colors] = 0
    return encode_png(pixels)


def redact_images(files: DataFrame) -> DataFrame:
    """``files`` (file_id, content, boxes) as (file_id, redacted, error); formats that cannot be written give an error."""

    def copy(i: int, c: bytes, boxes: list) -> tuple:
        try:
            if not bytes(c).startswith(PNG_SIGNATURE):
                raise ValueError("Redaction does not support this image format.")
            return i, redact_png(bytes(c), [dict(x) for x in boxes]), None
        except (ValueError, KeyError, zlib.error, struct.error) as e:
            return i, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = zip(batch["file_id"], batch["content"], batch["boxes"])
            yield from frames(((len(f[1]), [copy(*f)]) for f in each), ["file_id", "redacted", "error"])

    return small_batches(files).select("file_id", "content", "boxes").mapInPandas(run, "file_id long, redacted binary, error string")
