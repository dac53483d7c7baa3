import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyframe.llm import jpeg

# The luminance code lengths and symbols that Annex K of the JPEG standard suggests.
DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])


def huffman_codes(spec):
    codes, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            codes[spec[16 + at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def plain_jpeg(blocks, wide, high, restart):
    """A grey image written bit by bit, with codes of many lengths."""
    ac = bytes([0, 2, 1, 3, 3, 2, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + bytes([1, 2, 3, 0, 4, 0x11, 5, 0x12, 0x21, 0xF0, 6, 7, 0x13, 0x22, 0x31])
    d, a = huffman_codes(DC), huffman_codes(ac)
    out, bits, before = b"", "", 0

    def number(v):
        n = abs(int(v)).bit_length()
        return n, format(int(v) if v > 0 else int(v) + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        nonlocal out, bits
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    for u, block in enumerate(blocks):
        if restart and u and u % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            before = 0
        n, extra = number(block[0] - before)
        before = block[0]
        bits += format(d[n][0], f"0{d[n][1]}b") + extra
        run = 0
        last = max((i for i in range(64) if block[i]), default=0)
        for v in block[1 : last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits += format(a[0xF0][0], f"0{a[0xF0][1]}b")
                run -= 16
            n, extra = number(v)
            if run << 4 | n not in a:
                raise KeyError
            bits += format(a[run << 4 | n][0], f"0{a[run << 4 | n][1]}b") + extra
            run = 0
        if last < 63:
            bits += format(a[0][0], f"0{a[0][1]}b")
    flush()
    s = jpeg._segment
    return (b"\xff\xd8" + s(0xDB, b"\0" + bytes([2] * 64)) + s(0xC0, struct.pack(">BHHB", 8, high, wide, 1) + b"\1\x11\0") + s(0xC4, b"\0" + DC) + s(0xC4, b"\x10" + ac)
            + (s(0xDD, struct.pack(">H", restart)) if restart else b"") + s(0xDA, b"\1\1\0\0\x3f\0") + out + b"\xff\xd9")


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decodes_other_baseline_images(restart):
    rng = np.random.default_rng(restart)
    blocks = np.zeros((12, 64), int)
    blocks[:, 0] = rng.integers(-300, 300, 12)
    blocks[:, 1] = rng.integers(-50, 50, 12)
    blocks[::2, 2] = 3
    blocks[1, 40] = 1
    blocks[1, 39] = 1
    blocks[1, 2:39] = 1
    blocks[3, 19] = -1  # after a run of 16 zeros
    blocks[3, 1], blocks[3, 2] = 5, 5
    data = plain_jpeg(blocks, 31, 20, restart)
    (h, c), (h2, c2) = jpeg.coefficients([data, data])
    assert (h.width, h.height) == (31, 20) and (c.reshape(-1, 64) == blocks).all() and (c2 == c).all()
    assert (jpeg.thumbnail(h, c) == np.clip((blocks[:, 0] * 2 + 1028) // 8, 0, 255).reshape(3, 4)).all()


def test_round_trip_of_all_bytes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 200):
        data = bytes(rng.integers(0, 256, n * 192, np.uint8)) if n > 1 else b"\xff" * 192
        (h, c), = jpeg.coefficients([jpeg.encode(data)])
        assert jpeg.payload(h, c) == data


def test_damage_is_an_error():
    good = jpeg.encode(b" " * 192 * 9)
    for bad in (b"", good[:50], good[:-30], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-2]):
        with pytest.raises((jpeg.BadJpeg, IndexError, struct.error)):
            jpeg.coefficients([bad])


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "long ÿ\x7f " * 20_000, "x" * 193]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "a", 3), (2, "a", 3)], "doc_id long, text string, width int")
    got = jpeg.media_columns(docs, keep_media=True).collect()
    assert len(got) == 9
    for r in got:
        raw = (texts[r.doc_id] or "").encode() if r.doc_id is not None else b"a"
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    same = [r for r in got if r.doc_id in (4, 6)]
    assert len({tuple(r)[1:] for r in same}) == 1
    assert jpeg.media_columns(docs.limit(0)).collect() == []
