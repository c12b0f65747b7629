"""Matroska: a writer for raw 8-bit audio and a parser to packet tables.

The parser walks EBML elements with variable-length ids and sizes, clusters (SimpleBlock and
BlockGroup), all four lacings (none, Xiph, fixed, EBML) and cues, and gives one packet per
laced frame: track, timestamp, byte range, keyframe and whether a cue points at its cluster.
Files are independent rows, so the work is one map without a shuffle, and memory follows one
file.

The frames of a laced block follow each other by the track's default duration; a block of a group
is a keyframe if the group refers to no other block.

Defined cases: null or empty text is stored as one frame of padding; bytes that are no
Matroska raise ``ValueError`` in ``parse``, and in ``packet_table`` give one row with packet -1 and
the ``error``; a null file gives no row; elements of unknown kind are skipped; a block that is cut
off or whose lacing doesn't fit gives no packets; equal texts give equal files; repeated rows each
get a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .spill import small_batches

#: Fixed values of the Matroska format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOCTYPE, TIMESTAMP_SCALE = 0x4282, 0x2AD7B1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
DEFAULT_DURATION = 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CLUSTER_CHILDREN = {CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, 0xA7, 0xAB, 0xAF, 0x5854}

BLOCKS = {SIMPLE_BLOCK, BLOCK}

#: What ends an element of unknown size: ids that stand beside it or higher.
_TOP = {EBML, SEGMENT}
_LEVEL1 = _TOP | {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
ENDS = {SEGMENT: _TOP, BLOCK_GROUP: _LEVEL1 | CLUSTER_CHILDREN} | dict.fromkeys(_LEVEL1 - _TOP, _LEVEL1)

FRAME = 576
RATE = 48_000
FRAME_MS = FRAME * 1000 // RATE
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """An EBML size of the least width (all ones means unknown, so that value takes a wider form)."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return _id(kind) + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Flag bits and bytes of a block's frames: fixed lacing for equal sizes, else EBML lacing."""
    if len(frames) == 1:
        return 0, frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1]):
        d = b - a
        w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
        head += vint(d + (1 << 7 * w - 1) - 1, w)
    return 0x06, head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file that holds the payload as frames of 8-bit samples on track 1."""
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, b"\x47\x3b\x80\x00") + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))
    parts = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000)), tracks]
    at, cues = sum(map(len, parts)), []
    step = frame * FRAMES_A_BLOCK
    for c in range(0, max(1, len(payload)), step * BLOCKS_A_CLUSTER):
        time = c // frame * FRAME_MS
        body = [uint(CLUSTER_TIME, time)]
        for b in range(c, min(len(payload), c + step * BLOCKS_A_CLUSTER), step):
            end = min(len(payload), b + step)
            flags, data = lace([payload[i : min(i + frame, end)] for i in range(b, end, frame)])
            body.append(element(SIMPLE_BLOCK, b"\x81" + ((b // frame) * FRAME_MS - time).to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + data))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOCTYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


@dataclass
class Packet:
    track: int
    timestamp: int
    start: int
    length: int
    keyframe: bool
    lacing: int
    frame: int
    cluster: int
    timestamp_ns: int = 0


@dataclass
class Parsed:
    packets: list[Packet] = field(default_factory=list)
    tracks: dict[int, str] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, place of the cluster
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    durations: dict[int, int] = field(default_factory=dict)  # of a frame, by track, in ns


def _vint(b: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None for an unknown size."""
    first = b[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(b):
        raise ValueError("broken EBML number")
    n = int.from_bytes(b[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, end of its body)."""
    while at < end:
        try:
            kind, p = _vint(b, at, True)
            size, p = _vint(b, p, False)
        except (ValueError, IndexError):
            return
        if size is None:
            ends = ENDS.get(kind, ())
            stop = next((s for k, s, _, _ in elements(b, p, end) if k in ends), end) if ends else end
        else:
            stop = p + size
            if stop > end:  # cut off: what its children hold whole is still of use
                if kind in BLOCKS:
                    return
                stop = end
        yield kind, at, p, stop
        at = stop


def frame_sizes(b: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins."""
    if lacing == 0:
        return [end - at], at
    n, at = b[at] + 1, at + 1
    if lacing == 2:  # fixed
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:  # Xiph: a run of 255s and a rest
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + b[at], at + 1
        else:  # EBML: a size, then signed differences
            start = at
            raw, at = _vint(b, at, False)
            raw = (1 << 7 * (at - start)) - 1 if raw is None else raw
            size = raw if i == 0 else sizes[-1] + raw - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def parse(b: bytes) -> Parsed:
    out = Parsed()
    number = lambda p, q: int.from_bytes(b[p:q], "big")
    top = list(elements(b, 0, len(b)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for kind, _, p, q in top:
        if kind != SEGMENT:
            continue
        base = p
        for k, s, p1, q1 in elements(b, p, q):
            if k == INFO:
                for k2, _, p2, q2 in elements(b, p1, q1):
                    if k2 == TIMESTAMP_SCALE:
                        out.scale = number(p2, q2)
            elif k == TRACKS:
                for k2, _, p2, q2 in elements(b, p1, q1):
                    if k2 == TRACK_ENTRY:
                        entry = {k3: b[p3:q3] for k3, _, p3, q3 in elements(b, p2, q2)}
                        track = int.from_bytes(entry.get(TRACK_NUMBER, b"\0"), "big")
                        out.tracks[track] = entry.get(CODEC_ID, b"").decode("ascii", "replace")
                        out.durations[track] = int.from_bytes(entry.get(DEFAULT_DURATION, b"\0"), "big")
            elif k == CUES:
                for k2, _, p2, q2 in elements(b, p1, q1):
                    time, found = 0, []
                    for k3, _, p3, q3 in elements(b, p2, q2):
                        if k3 == CUE_TIME:
                            time = number(p3, q3)
                        elif k3 == CUE_POSITIONS:
                            v = {k4: number(p4, q4) for k4, _, p4, q4 in elements(b, p3, q3)}
                            found.append((v.get(CUE_TRACK, 0), v.get(CUE_CLUSTER, 0)))
                    out.cues += [(time, t, c) for t, c in found]
            elif k == CLUSTER:
                _cluster(b, p1, q1, s - base, out)
    for x in out.packets:
        x.timestamp_ns = x.timestamp * out.scale + x.frame * out.durations.get(x.track, 0)
    return out


def _cluster(b: bytes, p: int, q: int, place: int, out: Parsed) -> None:
    out.clusters.append(place)
    time = 0
    for k, _, p1, q1 in elements(b, p, q):
        if k == CLUSTER_TIME:
            time = int.from_bytes(b[p1:q1], "big")
        if k == SIMPLE_BLOCK:
            _block(b, p1, q1, None, time, place, out)
        elif k == BLOCK_GROUP:
            parts = list(elements(b, p1, q1))
            alone = all(x[0] != REFERENCE_BLOCK for x in parts)
            for k2, _, p2, q2 in parts:
                if k2 == BLOCK:
                    _block(b, p2, q2, alone, time, place, out)


def _block(b: bytes, p: int, q: int, keyframe: bool | None, time: int, place: int, out: Parsed) -> None:
    """Adds a block's packets; ``keyframe`` None: its own flag tells."""
    try:
        track, at = _vint(b, p, False)
        delta = int.from_bytes(b[at : at + 2], "big", signed=True)
        flags = b[at + 2]
        lacing = flags >> 1 & 3
        sizes, at = frame_sizes(b, at + 3, q, lacing)
    except (ValueError, IndexError):
        return
    if at > q or min(sizes) < 0 or at + sum(sizes) > q:
        return
    for i, n in enumerate(sizes):
        out.packets.append(Packet(track or 0, time + delta, at, n, flags >= 0x80 if keyframe is None else keyframe, lacing, i, place))
        at += n


def packet_table(files: DataFrame, id_column: str, content: str) -> DataFrame:
    """One row per packet of each file in a binary column, and one with ``error`` per file that can't be read."""
    schema = f"{id_column} long, packet long, track long, codec string, timestamp_ns long, start long, length long, keyframe boolean, lacing int, frame int, cued boolean, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if data is None:
                    continue
                try:
                    x = parse(data)
                except ValueError as e:
                    rows.append((key, -1, *[None] * 9, str(e)))
                    continue
                cued = {c for _, _, c in x.cues}
                rows += [(key, i, p.track, x.tracks.get(p.track), p.timestamp_ns, p.start, p.length, p.keyframe, p.lacing, p.frame, p.cluster in cued, None) for i, p in enumerate(x.packets)]
            cols = list(zip(*rows)) or [()] * 12
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return files.selectExpr(f"cast({id_column} as long) {id_column}", f"cast({content} as binary) {content}").mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text in a Matroska file, reads it back by its packet table and digests both."""

    def one(text: bytes) -> tuple:
        stored = write(text + b"\xff" * ((-len(text)) % FRAME or (FRAME if not text else 0)))
        x = parse(stored)
        payload = b"".join([stored[p.start : p.start + p.length] for p in x.packets])
        laced = sum(p.lacing != 0 for p in x.packets)
        cued = len({c for _, _, c in x.cues} & set(x.clusters))
        silent = sum(1 for p in x.packets if stored[p.start] == 255 and stored.count(b"\xff", p.start, p.start + p.length) == p.length)
        feature = f"packets={len(x.packets)};clusters={len(x.clusters)};cued={cued};laced={laced};pad_only={silent};last_ns={x.packets[-1].timestamp_ns};codec={x.tracks.get(1, '')}"
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = [(i, *one(t.as_py() or b"")) for i, t in zip(part.column(0).to_pylist(), part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, DIGEST)
