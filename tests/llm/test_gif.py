import hashlib
import random
import struct
from zlib import crc32

import numpy as np
import pytest

from phasorlake.llm import gif

SCHEMA = "doc_id long, text string, media string, feature int"


def literal_stream(samples, bits, every=5):
    """A plain encoder that clears its dictionary often."""
    out = have = n = 0
    size = bits + 1

    def put(code):
        nonlocal out, have
        out |= code << have
        have += size

    put(1 << bits)
    for s in samples:
        if n == every:
            put(1 << bits)
            n = 0
        put(int(s))
        n += 1
    put((1 << bits) + 1)
    return out.to_bytes(have // 8 + 1, "little")


def blocks(s):
    return b"".join(bytes([len(s[i : i + 255])]) + s[i : i + 255] for i in range(0, len(s), 255)) + b"\0"


def image(index, left=0, top=0, bits=2, palette=None, flags=0, gce=None):
    h, w = index.shape
    g = b"" if gce is None else b"\x21\xf9\x04" + struct.pack("<BHBB", *gce, 0)
    p = b"" if palette is None else palette
    return g + b"\x2c" + struct.pack("<4HB", left, top, w, h, flags | (0x81 if palette else 0)) + p + bytes([bits]) + blocks(literal_stream(index.ravel(), bits, 2))


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def animation(*images):
    return b"GIF89a" + struct.pack("<HHBBB", 4, 3, 0x81, 0, 0) + PALETTE + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" + b"".join(images) + b"\x3b"


def test_streams():
    r = np.random.default_rng(1)
    rows = np.array([r.integers(0, k, 576) for k in (1, 2, 3, 16, 256, 256)] + [np.arange(576) % 7, [255] * 576], np.uint8)
    packed = gif.pack_many(rows)
    assert (gif.unpack_many(packed, 8, 576) == rows).all()
    for s, row in zip(packed, rows):
        assert (gif.unpack(s, 8, 576) == row).all()
    mixed = [packed[0], literal_stream(rows[4], 8), packed[5], b"", packed[3][:40]]
    got = gif.unpack_many(mixed, 8, 576)
    assert all((g == gif.unpack(s, 8, 576)).all() for g, s in zip(got, mixed))
    assert (got[1] == rows[4]).all()
    long = r.integers(0, 256, 2900).astype(np.uint8)[None]
    assert (gif.unpack_many(gif.pack_many(long), 8, 2900) == long).all()


def test_long_streams_stop_growing():
    r = random.Random(3)
    samples = np.array([r.choice((0, 1, 2, 3)) for _ in range(30000)], np.uint8)
    # an encoder by the book, with a dictionary that fills up and stays
    table, codes, before = {(i,): i for i in range(4)}, [], ()
    out = have = 0
    size, nxt = 3, 6
    out, have = 4, 3
    for s in samples.tolist():
        if (*before, s) in table:
            before = (*before, s)
            continue
        out |= table[before] << have
        have += size
        if nxt < 4096:
            table[(*before, s)] = nxt
            nxt += 1
            if nxt - 1 == 1 << size and size < 12:
                size += 1
        before = (s,)
    out |= table[before] << have
    have += size
    out |= 5 << have
    assert (gif.unpack(out.to_bytes(have // 8 + 3, "little"), 2, 30000) == samples).all()


def test_disposal_transparency_and_palettes():
    one, two = np.ones((3, 4), np.uint8), np.array([[2, 3], [3, 2]], np.uint8)
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    shown = list(gif.decode(animation(image(one, gce=(1 << 2, 5, 0)), image(two, 1, 1, gce=(3 << 2 | 1, 7, 3)), image(two, 2, 1, gce=(2 << 2, 1, 0)), image(two[:1], 0, 0, palette=own), image(two, 3, 2))))
    assert [(f.start, f.delay) for f in shown] == [(0, 5), (5, 7), (12, 1), (13, 0), (13, 0)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert (shown[0].canvas == red).all()
    assert shown[1].canvas[1:3, 1:3].tolist() == [[green, red], [red, green]]
    assert shown[2].canvas[1].tolist() == [red, red, green, blue]
    assert shown[3].canvas[1].tolist() == [red, red, [0] * 4, [0] * 4] and shown[3].canvas[0, :2].tolist() == [[7, 7, 7, 255], [6, 6, 6, 255]]
    assert shown[4].canvas[2, 3].tolist() == green
    assert gif.histogram(shown[0].canvas)[48] == 12 and sum(gif.histogram(shown[3].canvas)) == 8


def test_interlace_and_bad_files():
    rows = np.arange(12, dtype=np.uint8).reshape(12, 1) % 4
    order = [*range(0, 12, 8), *range(4, 12, 8), *range(2, 12, 4), *range(1, 12, 2)]
    data = b"GIF87a" + struct.pack("<HHBBB", 1, 12, 0x81, 0, 0) + PALETTE + image(rows[order], flags=64)
    assert gif.indices(gif.parse(data)[3])[0].tolist() == rows.tolist()
    with pytest.raises(ValueError):
        gif.parse(b"PNG")
    whole = animation(image(np.ones((3, 4), np.uint8)))
    for n in range(13, len(whole)):
        list(gif.decode(whole[:n]))


def texts():
    return [None, "", "a", "x" * 575, "x" * 576, "é" * 400, "The and of " * 3000, "\U0001f600" * 200 + "\0\x1f", "a"]


def test_round_trip(spark):
    data = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "null id", None, None)]
    got = {r.doc_id: r for r in gif.text_media(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(got) == len(data)
    for d, t, *_ in data:
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), crc32(want[-32:]))
        file = gif._store_all([t])[0][1]
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert b"".join(f.canvas[..., 0].tobytes() for f in gif.decode(file)) == want
    assert got[2].feature == got[8].feature and got[0].media_sha256 == got[1].media_sha256


def test_frames_table(spark):
    a = animation(image(np.ones((3, 4), np.uint8), gce=(0, 5, 0)), image(np.zeros((3, 4), np.uint8)))
    df = spark.createDataFrame([(1, bytearray(a), "x"), (2, None, "x"), (3, bytearray(b"junk"), "x")], "id long, media binary, frame string")
    got = gif.frames(df).orderBy("frame").collect()
    assert [(r.id, r.frame, r.start_cs, r.delay_cs, r.width, r.height) for r in got] == [(1, 0, 0, 5, 4, 3), (1, 1, 5, 0, 4, 3)]
    assert got[0].histogram[48] == 12 and got[1].histogram[0] == 12 and len(got[0].rgba) == 48


def test_empty_table(spark):
    assert gif.text_media(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frames_need_one_canvas(spark):
    import tracemalloc

    dot = np.zeros((1, 1), np.uint8)
    head = b"GIF89a" + struct.pack("<HHBBB", 2000, 2000, 0x80, 0, 0) + bytes(6)
    data = head + b"".join(image(dot) for _ in range(30)) + b";"
    tracemalloc.start()
    assert sum(f.canvas.shape == (2000, 2000, 4) for f in gif.decode(data)) == 30
    assert tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()
    huge = b"GIF89a" + struct.pack("<HHBBB", 65000, 65000, 0x80, 0, 0) + bytes(6) + image(dot) + b";"
    with pytest.raises(ValueError, match="65000"):
        gif.decode(huge)
    df = spark.createDataFrame([(1, data), (2, huge), (3, None)], "id long, media binary")
    got = gif.frames(df).select("id", "frame", "start_cs").collect()
    assert sorted((r.id, r.frame) for r in got) == [(1, i) for i in range(30)]
