"""Baseline JPEG media columns: a codec in numpy that decodes many images at once.

Decoding parses the markers, Huffman-decodes the scan into quantised coefficients, and rebuilds a
luminance thumbnail from the DC coefficients alone.  Restart intervals are independent, so all the
intervals of a batch of images with equal tables are decoded in step: one numpy operation advances
every interval by one symbol.

Text payloads are stored losslessly in the coefficients, three 8 x 8 blocks (Y, Cb, Cr; 192 bytes) to
a unit: byte b is coefficient b - 255 for b < 128 and b for the others, the values of category 8, whose
eight extra bits then are b itself.  One Huffman code of one bit stands for that category, and every
unit is a restart interval of its own.  Any baseline decoder shows the file as a noisy picture.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_or_empty

UNIT = 192
#: Side of the square to which thumbnails are pooled for the average hash.
HASH_SIDE = 8
#: Units that are decoded together.
_TOGETHER = 1 << 15


class BadJpeg(ValueError):
    """Not a baseline JPEG of the kind that this codec reads."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(units: int) -> tuple[int, int]:
    wide = math.isqrt(max(0, units - 1)) + 1
    return wide, -(-units // wide)


def encode(payload: bytes) -> bytes:
    """A JPEG of 4:4:4 with the payload, of a multiple of 192 bytes, in its coefficients.  Its length
    stands in a comment, since the last row of units may be filled up."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    wide, high = _shape(units)
    if max(wide, high) * 8 > 65_535:
        raise ValueError("the payload is too long for one image")
    one_code = bytes([1] + [0] * 15 + [8])
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xFE, b"payload %d" % len(payload))
    head += _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + b"\1\x11\0\2\x11\0\3\x11\0")
    head += _segment(0xC4, b"\0" + one_code + b"\x10" + one_code) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")
    return b"".join([head, *_scan(payload, wide * high), b"\xff\xd9"])


def _scan(payload: bytes, units: int):
    """Entropy-coded units, a few thousand at a time: each byte becomes a 0 bit and its eight bits."""
    have = len(payload) // UNIT
    for lo in range(0, units, _TOGETHER):
        n = min(_TOGETHER, units - lo)
        b = np.full(n * UNIT, 32, np.uint8)
        part = np.frombuffer(payload, np.uint8, max(0, min(n, have - lo)) * UNIT, min(lo, have) * UNIT)
        b[: len(part)] = part
        b = b.reshape(-1, 8)
        nine = np.zeros((len(b), 9), np.uint8)
        for j in range(9):
            if j < 8:
                nine[:, j] = b[:, j] >> (j + 1)
            if j:
                nine[:, j] |= b[:, j - 1] << (8 - j) if j < 8 else b[:, 7]
        rows = np.empty((n, 218), np.uint8)
        rows[:, :216] = nine.reshape(n, 216)
        rows[:, 216] = 0xFF
        rows[:, 217] = 0xD0 + (lo + np.arange(n)) % 8
        flat = rows.ravel()
        stuff = rows == 0xFF
        stuff[:, 216:] = False
        if stuff.any():
            flat = np.insert(flat, np.flatnonzero(stuff.ravel()) + 1, 0)
        out = flat.tobytes()
        yield out[:-2] if lo + n == units else out  # no restart marker after the last


@dataclass
class Header:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)  # (component, h, v, quant table)
    tables: list = field(default_factory=list)  # (DC, AC) of each component in the scan
    scan: int = 0  # offset of the entropy-coded data


def parse(data: bytes) -> Header:
    """The markers up to the scan."""
    h, at = Header(), 2
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BadJpeg("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                h.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                h.huffman[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise BadJpeg("samples are not of 8 bits")
            h.height, h.width = struct.unpack(">HH", body[1:5])
            h.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise BadJpeg("not a baseline image")
        elif marker == 0xDD:
            h.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            h.comment = body
        elif marker == 0xDA:
            by = {body[i]: (body[i + 1] >> 4, 0x10 | body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
            if not h.parts or set(by) != {p[0] for p in h.parts}:
                raise BadJpeg("the scan has other components than the frame")
            h.tables = [by[p[0]] for p in h.parts]
            h.scan = at
            return h


def _lookup(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that may come next; length 0 where there is no code."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            symbol[lo:hi], length[lo:hi] = spec[16 + at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, length


def _intervals(data: bytes, h: Header) -> list[bytes]:
    """The restart intervals without their markers and stuffed zeros."""
    scan = np.frombuffer(data, np.uint8, len(data) - h.scan, h.scan)
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    if not len(ends):
        raise BadJpeg("no end of image")
    end = int(ends[0])
    ff, after = ff[ff < end], after[ff < end]
    stuffed = ff[after == 0] + 1
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    raw = scan[:end].tobytes()
    cuts = [0, *(marks + 2).tolist()]
    stops = [*marks.tolist(), end]
    parts = [raw[a:b] for a, b in zip(cuts, stops, strict=True)]
    return [p.replace(b"\xff\0", b"\xff") for p in parts] if len(stuffed) else parts


def _plan(h: Header) -> tuple[list[tuple[int, int, int]], int]:
    """For each block of a unit: component and its tables; and the number of units."""
    hmax, vmax = max(p[1] for p in h.parts), max(p[2] for p in h.parts)
    if len(h.parts) == 1:
        return [(0, *h.tables[0])], -(-h.width // 8) * -(-h.height // 8)
    units = -(-h.width // (8 * hmax)) * -(-h.height // (8 * vmax))
    return [(c, *h.tables[c]) for c, p in enumerate(h.parts) for _ in range(p[1] * p[2])], units


def coefficients(images: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """For each image its header and its quantised coefficients: (units, blocks of a unit, 64),
    in zigzag order, DC with prediction undone."""
    heads = [parse(d) for d in images]
    groups: dict = defaultdict(list)
    for i, h in enumerate(heads):
        blocks, units = _plan(h)
        step = h.restart or units
        groups[(tuple(blocks), tuple(sorted(h.huffman.items())), step)].append((i, units))
    out: list = [None] * len(images)
    for (blocks, huffman, step), members in groups.items():
        tables = {k: _lookup(v) for k, v in huffman}
        pieces, sizes, owners = [], [], []
        for i, units in members:
            found = _intervals(images[i], heads[i])
            if len(found) != -(-units // step):
                raise BadJpeg("restart intervals are missing")
            pieces += found
            sizes += [min(step, units - k * step) for k in range(len(found))]
            owners.append((i, len(found), units))
        each = max(1, _TOGETHER // max(1, step))
        done = [_decoded(pieces[lo : lo + each], np.array(sizes[lo : lo + each]), blocks, tables) for lo in range(0, len(pieces), each)]
        whole = np.concatenate([d[np.arange(d.shape[1])[None, :] < np.array(sizes[k * each : k * each + len(d)])[:, None]] for k, d in enumerate(done)])
        at = 0
        for i, _, units in owners:
            out[i] = (heads[i], whole[at : at + units])
            at += units
    return out


def _decoded(pieces: list[bytes], units: np.ndarray, blocks, tables) -> np.ndarray:
    """Huffman-decodes intervals in step: (intervals, units, blocks, 64)."""
    n, most = len(pieces), int(units.max())
    size = np.array([len(p) for p in pieces])
    first = np.cumsum(size + 8) - size - 8
    buf = np.frombuffer(b"".join(p + b"\0" * 8 for p in pieces), np.uint8)
    bits, limit = first * 8, (first + size) * 8
    out = np.zeros((n, most, len(blocks), 64), np.int16)

    def peek(pos: np.ndarray) -> np.ndarray:
        at = np.minimum(pos >> 3, len(buf) - 4)
        word = (buf[at].astype(np.int64) << 24) | (buf[at + 1].astype(np.int64) << 16) | (buf[at + 2].astype(np.int64) << 8) | buf[at + 3]
        return word >> (16 - (pos & 7)) & 0xFFFF

    def symbols(rows: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of each row, and the value of its extra bits."""
        symbol, length = table
        nxt = peek(bits[rows])
        n_code = length[nxt]
        if not n_code.all():
            raise BadJpeg("a code is not in the table")
        sym = symbol[nxt]
        pos = bits[rows] + n_code
        size = sym & 15
        extra = peek(pos) >> (16 - size)
        bits[rows] = pos + size
        return sym, np.where(size > 0, np.where(extra < 1 << np.maximum(size - 1, 0), extra - (1 << size) + 1, extra), 0)

    before = np.zeros((n, 1 + max(b[0] for b in blocks)), np.int64)
    for u in range(most):
        rows = np.flatnonzero(units > u)
        for b, (part, dc, ac) in enumerate(blocks):
            _, value = symbols(rows, tables[dc])
            before[rows, part] += value
            out[rows, u, b, 0] = before[rows, part]
            k = np.zeros(n, np.int64)
            live = rows
            while len(live):
                sym, value = symbols(live, tables[ac])
                run, size = sym >> 4, sym & 15
                k[live] += run + 1
                on = (size > 0) & (k[live] < 64)
                if ((size > 0) & (k[live] > 63)).any():
                    raise BadJpeg("a block has too many coefficients")
                out[live[on], u, b, k[live[on]]] = value[on]
                live = live[((size > 0) | (run == 15)) & (k[live] < 63)]
    if (bits > limit).any():
        raise BadJpeg("the data ends too early")
    return out


def payload(h: Header, c: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    word, _, n = h.comment.partition(b" ")
    if word != b"payload" or not n.isdigit():
        raise BadJpeg("no payload")
    flat = c.reshape(-1)[: int(n)]
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()


def thumbnail(h: Header, c: np.ndarray) -> np.ndarray:
    """Luminance, one pixel for each 8 x 8 block, from the DC coefficients alone."""
    _, hy, vy, q = h.parts[0]
    if len(h.parts) == 1:
        hy = vy = 1
    hmax = max(p[1] for p in h.parts) if len(h.parts) > 1 else 1
    wide = -(-h.width // (8 * hmax))
    dc = c[:, : hy * vy, 0].astype(np.int64) * h.quant[q][0]
    pixels = np.clip((dc + 1028) >> 3, 0, 255).astype(np.uint8)  # dc / 8 + 128, rounded
    return pixels.reshape(-1, wide, vy, hy).transpose(0, 2, 1, 3).reshape(-1, wide * hy)[: -(-h.height // 8), : -(-h.width // 8)]


def average_hash(thumb: np.ndarray, side: int = HASH_SIDE) -> str:
    """side * side bits in hex: whether a cell of the pooled thumbnail, in whole levels, is over the mean
    of all cells."""
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    edges = [(np.arange(side) * n // side, np.maximum(np.arange(1, side + 1) * n // side, np.arange(side) * n // side + 1)) for n in thumb.shape]
    (a, b), (x, y) = edges
    cells = (total[b][:, y] - total[a][:, y] - total[b][:, x] + total[a][:, x]) // ((b - a)[:, None] * (y - x)[None, :])
    return np.packbits((cells * side * side > cells.sum()).ravel()).tobytes().hex()


def _stored(keep_media: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                media = [encode(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b" ")) for t in part]
                rows = defaultdict(list)
                for t, m, (h, c) in zip(part, media, coefficients(media), strict=True):
                    back, thumb = payload(h, c), thumbnail(h, c)
                    for k, v in (("n_bytes", len(t)), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-16:])),
                                 ("media_bytes", len(m)), ("media_sha256", hashlib.sha256(m).hexdigest()), ("width", h.width), ("height", h.height),
                                 ("thumbnail_sha256", hashlib.sha256(thumb.tobytes()).hexdigest()), ("average_hash", average_hash(thumb))):
                        rows[k].append(v)
                ids = batch.column(0).slice(lo, len(part))
                arrays = [ids, *map(pa.array, rows.values())] + ([pa.array(media, pa.binary())] if keep_media else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *rows] + ["media"] * keep_media)

    return run


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row for each input row: the sizes and digests of its text as an image, read back from the
    stored bytes, its dimensions and its thumbnail's hashes; keep_media adds the image itself.

    Null and empty texts are one unit of blanks.  Repeated rows get equal values.  An empty table gives
    an empty result; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    kind = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
            "width long, height long, thumbnail_sha256 string, average_hash string") + ", media binary" * keep_media
    return rows.mapInArrow(bounded(_stored(keep_media)), kind)
