"""GIF media columns.

``decode`` reads any GIF: it unpacks LZW code streams, applies palettes, disposal and
transparency, undoes interlacing, and gives timed frames of the whole canvas. Streams
of one dictionary, with a clear code first and the end code last, are unpacked
together: the width of each code follows from its number, string lengths and places
from sums, and samples by following references backwards in doubling steps, all in
numpy. Any other stream goes through the plain loop of ``unpack``.

``store`` writes bytes as 8-bit samples of frames of 24 x 24, compressed by LZW for
many frames at once; grey palette, no transparency, so the samples come back whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasorlake.llm import common

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 10  # hundredths of a second
#: Samples of a canvas or image beyond which a GIF isn't read.
MOST_AREA = 1 << 26
CHUNK = 1_000_000
BINS = 4  # of each colour channel
_GREY = bytes(v for i in range(256) for v in (i, i, i))


class Image(NamedTuple):
    """An image block and what stands before it."""

    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: bytes | None
    bits: int
    stream: bytes
    delay: int
    disposal: int
    transparent: int | None


class Frame(NamedTuple):
    """A shown frame: its start and length in hundredths of a second, and the canvas as RGBA."""

    start: int
    delay: int
    canvas: np.ndarray


def parse(data: bytes) -> tuple[int, int, bytes | None, list[Image]]:
    """Width, height, global palette and images. A cut file gives what it holds whole."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at = 13
    palette = None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        palette, at = data[at : at + n], at + n
    images: list[Image] = []
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label, at = data[at + 1 : at + 2], at + 2
            body, at = _blocks(data, at)
            if label == b"\xf9" and len(body) >= 4:
                packed, delay = body[0], body[1] | body[2] << 8
                disposal, transparent = packed >> 2 & 7, body[3] if packed & 1 else None
        elif data[at] == 0x2C:
            if at + 11 > len(data):
                break
            left, top, w, h, flags = struct.unpack("<4HB", data[at + 1 : at + 10])
            at += 10
            own = None
            if flags & 128:
                n = 3 << (flags & 7) + 1
                own, at = data[at : at + n], at + n
            if at >= len(data):
                break
            bits = data[at]
            body, at = _blocks(data, at + 1)
            images.append(Image(left, top, w, h, bool(flags & 64), own, bits, body, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            break  # neither block nor trailer: what follows can't be read
    return width, height, palette, images


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return parts[0] if len(parts) == 1 else b"".join(parts), at + 1


def unpack(stream: bytes, bits: int, n: int) -> np.ndarray:
    """The n samples of any LZW stream; missing ones are 0."""
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out: list[bytes] = []
    size, made, before = bits + 1, 0, b""
    held = have = 0
    fresh = True
    for byte in stream:
        held |= byte << have
        have += 8
        while have >= size:
            code, held, have = held & (1 << size) - 1, held >> size, have - size
            if code == clear or fresh and not table:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                size, before, fresh = bits + 1, b"", False
                if code == clear:
                    continue
            if code == end:
                return _whole(out, n)
            if code < len(table):
                text = table[code]
            elif code == len(table) and before:
                text = before + before[:1]
            else:
                return _whole(out, n)  # a broken stream ends here
            out.append(text)
            made += len(text)
            if before and len(table) < 4096:
                table.append(before + text[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            before = text
            if made >= n:
                return _whole(out, n)
    return _whole(out, n)


def _whole(parts: list[bytes], n: int) -> np.ndarray:
    got = np.frombuffer(b"".join(parts), np.uint8)[:n]
    return np.concatenate([got, np.zeros(n - len(got), np.uint8)])


def _sizes(bits: int, n: int) -> np.ndarray:
    """Bits of the i-th code after the first clear code, for a decoder that has just cleared."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))


def unpack_many(streams: list[bytes], bits: int, n: int) -> np.ndarray:
    """The n samples of each stream, at most 3,000: together where they have one dictionary, else one by one."""
    k = len(streams)
    first, clear, end = bits + 1, 1 << bits, (1 << bits) + 1
    sizes = _sizes(bits, n + 1)
    starts = first + np.r_[0, np.cumsum(sizes)[:-1]]
    wide = -(-(int(starts[-1]) + 12) // 8) + 4
    raw = np.zeros((k, wide), np.uint8)
    for i, s in enumerate(streams):
        s = s[:wide]
        raw[i, : len(s)] = np.frombuffer(s, np.uint8)
    at = starts >> 3
    word = raw[:, at].astype(np.uint32) | raw[:, at + 1].astype(np.uint32) << 8 | raw[:, at + 2].astype(np.uint32) << 16
    codes = ((word >> (starts & 7).astype(np.uint32)) & ((1 << sizes) - 1).astype(np.uint32)).astype(np.int32)
    head = (raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8) & (1 << first) - 1
    ends = codes == end
    count = np.where(ends.any(1), ends.argmax(1), 0)
    step = np.arange(n + 1)
    live = step < count[:, None]
    entry = codes - clear - 2  # entry e is the string of code e and one sample more
    good = (head == clear) & (count > 0) & ~((codes == clear) & live).any(1) & ~((entry >= step) & live).any(1)
    length = np.ones((k, n + 1), np.int32)
    rows = np.arange(k)
    top = int(count[good].max(initial=0))
    for t in range(1, top):
        e = entry[:, t]
        length[:, t] = np.where((e >= 0) & (e < t), length[rows, np.clip(e, 0, t - 1)] + 1, 1)
    length = np.where(live, length, 0)
    place = np.cumsum(length, axis=1) - length
    good &= length.sum(1) == n
    out = np.zeros((k, n), np.uint8)
    ok = np.flatnonzero(good)
    if len(ok):
        codes, entry, length, place, live = codes[ok], entry[ok], length[ok], place[ok], live[ok]
        m = len(ok)
        base = (np.arange(m) * n)[:, None]
        lit = live & (codes < clear)
        copy = live & ~lit
        # where each sample comes from: itself for a literal, else an earlier one
        owner = np.repeat(np.arange(m * (n + 1)), length.ravel())
        inside = np.arange(m * n) - np.repeat((base + place).ravel(), length.ravel())
        source = np.arange(m * n, dtype=np.int64)
        is_copy = copy.ravel()[owner]
        from_ = (base + np.take_along_axis(place, np.clip(entry, 0, n), 1)).ravel()[owner] + inside
        source[is_copy] = from_[is_copy]
        value = np.zeros(m * n, np.uint8)
        value[(base + place)[lit]] = codes[lit]
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
        out[ok] = value[source].reshape(m, n)
    for i in np.flatnonzero(~good):
        out[i] = unpack(streams[i], bits, n)
    return out


def pack_many(samples: np.ndarray) -> list[bytes]:
    """LZW streams (8 bits a sample) of rows of samples, at most 3,000 long, made side by side.

    The dictionary of each row is a hash table over (prefix code, sample); all rows
    take a step at a time.
    """
    k, n = samples.shape
    cells = 1 << (2 * n - 1).bit_length()
    keys = np.full((k, cells), -1, np.int32)
    values = np.zeros((k, cells), np.int16)
    rows = np.arange(k)
    codes = np.zeros((k, n + 1), np.int16)
    count = np.zeros(k, np.int64)
    prefix = samples[:, 0].astype(np.int32)
    for t in range(1, n):
        key = prefix << 8 | samples[:, t]
        slot = (key * 40503 >> 4) & cells - 1
        found = keys[rows, slot]
        probe = np.flatnonzero((found != key) & (found != -1))
        while len(probe):
            slot[probe] = slot[probe] + 1 & cells - 1
            found[probe] = keys[probe, slot[probe]]
            probe = probe[(found[probe] != key[probe]) & (found[probe] != -1)]
        new = np.flatnonzero(found == -1)
        keys[new, slot[new]] = key[new]
        values[new, slot[new]] = 258 + count[new]
        codes[new, count[new]] = prefix[new]
        count[new] += 1
        prefix = values[rows, slot].astype(np.int32)
        prefix[new] = samples[new, t]
    codes[rows, count] = prefix
    count += 1
    sizes = _sizes(8, n + 2)
    ends = np.r_[0, np.cumsum(sizes)]
    wide = -(-(9 + int(ends[-1])) // 8) + 4
    out = np.zeros((k, wide), np.uint32)
    stream = np.concatenate([codes, np.zeros((k, 1), np.int16)], axis=1).astype(np.uint32)
    stream[rows, count] = 257
    stream[np.arange(n + 2) > count[:, None]] = 0
    starts = 9 + ends[: n + 2]
    out[:, 0], out[:, 1] = 256 & 255, 256 >> 8
    shifted = stream << (starts & 7).astype(np.uint32)
    for b in range(3):  # codes have over 8 bits, so no two begin in one byte
        out[:, (starts >> 3) + b] |= shifted >> (8 * b) & 255
    size = (starts[count] + sizes[count] + 7) // 8
    flat = out.astype(np.uint8)
    return [flat[i, : size[i]].tobytes() for i in range(k)]


def store(samples: np.ndarray, streams: list[bytes]) -> bytes:
    """A GIF of square frames of 8-bit grey samples, one for each stream."""
    out = [b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _GREY]
    head = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0) + b"\x2c" + struct.pack("<4HB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    for s in streams:
        out.append(head)
        out += [bytes([len(s[i : i + 255])]) + s[i : i + 255] for i in range(0, len(s), 255)]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def indices(images: list[Image]) -> list[np.ndarray]:
    """Palette indices of each image, rows in order; images of one shape are unpacked together."""
    out: list = [None] * len(images)
    groups: dict = {}
    for i, m in enumerate(images):
        groups.setdefault((m.bits, m.width * m.height), []).append(i)
    for (bits, n), own in groups.items():
        streams = [images[i].stream for i in own]
        if 0 < n <= 3000 and 2 <= bits <= 8:
            got = np.concatenate([unpack_many(streams[a : a + 2000], bits, n) for a in range(0, len(own), 2000)])
        else:
            got = [unpack(s, bits, n) for s in streams]
        for i, g in zip(own, got):
            out[i] = g.reshape(images[i].height, images[i].width)
    for i, m in enumerate(images):
        if m.interlaced:
            order = [*range(0, m.height, 8), *range(4, m.height, 8), *range(2, m.height, 4), *range(1, m.height, 2)]
            rows = np.empty_like(out[i])
            rows[order] = out[i]
            out[i] = rows
    return out


def render(width: int, height: int, palette: bytes | None, images: list[Image], pixels: Iterable[np.ndarray]) -> Iterator[Frame]:
    """The canvas at each image, after the disposal of the one before.

    Disposal 2 clears the image's area to transparent, 3 puts back what was there
    before; others leave the image. Indices beyond the palette are black.
    """
    canvas = np.zeros((height, width, 4), np.uint8)
    start = 0
    for m, index in zip(images, pixels):
        raw = m.palette if m.palette is not None else palette or b""
        colours = np.zeros((256, 4), np.uint8)
        colours[:, 3] = 255
        rgb = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
        colours[: len(rgb), :3] = rgb
        area = np.s_[m.top : min(m.top + m.height, height), m.left : min(m.left + m.width, width)]
        index = index[: max(0, height - m.top), : max(0, width - m.left)]
        before = canvas[area].copy()
        shown = colours[index]
        if m.transparent is not None:
            shown = np.where((index == m.transparent)[..., None], before, shown)
        canvas[area] = shown
        yield Frame(start, m.delay, canvas.copy())
        start += m.delay
        if m.disposal == 2:
            canvas[area] = 0
        elif m.disposal == 3:
            canvas[area] = before


def canvases(width: int, height: int, palette: bytes | None, images: list[Image], pixels: list[np.ndarray]) -> np.ndarray:
    """The canvases of ``render`` as one array. Opaque images of the whole canvas with
    the global palette, of which each hides the one before, are coloured together."""
    whole = palette is not None and all((m.left, m.top, m.width, m.height, m.palette, m.transparent) == (0, 0, width, height, None, None) for m in images)
    if not whole or not images:
        return np.array([f.canvas for f in render(width, height, palette, images, pixels)], np.uint8).reshape(-1, height, width, 4)
    colours = np.zeros((256, 4), np.uint8)
    colours[:, 3] = 255
    rgb = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
    colours[: len(rgb), :3] = rgb
    return colours[np.array(pixels)]


def decode(data: bytes) -> Iterator[Frame]:
    """The shown frames one after the other: a canvas and an image's samples at a time.

    A canvas or image of over MOST_AREA samples isn't readable: ValueError, before any is made.
    """
    width, height, palette, images = parse(data)
    if max([width * height, *(m.width * m.height for m in images)]) > MOST_AREA:
        raise ValueError(f"a canvas of {width} x {height} has over {MOST_AREA} samples")
    return render(width, height, palette, images, (indices([m])[0] for m in images))


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque samples of a canvas by the upper bits of red, green and blue, BINS each."""
    rgb = canvas[canvas[..., 3] > 0][:, :3] // (256 // BINS)
    return np.bincount(rgb[:, 0].astype(int) * BINS * BINS + rgb[:, 1] * BINS + rgb[:, 2], minlength=BINS**3).tolist()


_FRAMES = "frame int, start_cs long, delay_cs int, width int, height int, rgba binary, histogram array<int>"


def frames(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each shown frame of the GIFs in ``column``: the other columns, and
    frame (from 0), start_cs and delay_cs, width, height, rgba (rows in order) and
    histogram. A null or unreadable value gives no rows, as does a GIF without images,
    or one of over MOST_AREA samples; one that breaks off within an image gives the
    frames before. Repeated rows give theirs each, an empty table none. Frames are
    passed on one after the other, so a long GIF needs no more room than a short one.
    Columns of these names are replaced, others stay.
    """
    names = [x.split()[0] for x in _FRAMES.split(", ")]
    rest = media.drop(*names)
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]

    def shown(data: bytes | None) -> Iterator[tuple]:
        try:
            for i, f in enumerate(decode(data) if data is not None else ()):
                yield i, f.start, f.delay, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas)
        except ValueError:
            return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                rows: list[tuple] = []
                for row in chain(shown(batch.column(column)[r].as_py()), [None]):
                    if rows and (row is None or sum(len(x[5]) for x in rows) > 4 * CHUNK):
                        same = batch.slice(r, 1).take(pa.array([0] * len(rows)))
                        yield pa.RecordBatch.from_arrays([*same.columns, *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], [*batch.schema.names, *names])
                        rows = []
                    rows.append(row)

    schema = rest.selectExpr("*", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in _FRAMES.split(", ")]).schema
    return rest.mapInArrow(run, schema)


def _store_all(texts: list[str | None]) -> list[tuple[bytes, bytes]]:
    """(UTF-8 with its padding, GIF) of each text; frames of all texts are compressed together."""
    padded = []
    for t in texts:
        raw = (t or "").encode()
        padded.append(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME)))
    flat = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, FRAME)
    streams = [s for a in range(0, len(flat), 2000) for s in pack_many(flat[a : a + 2000])]
    out, at = [], 0
    for p in padded:
        n = len(p) // FRAME
        out.append((p, store(flat[at : at + n], streams[at : at + n])))
        at += n
    return out


def text_media(docs: DataFrame) -> DataFrame:
    """Texts stored as GIFs, read back, and their features.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the
    payload read back: UTF-8 and bytes 255 up to a positive multiple of 576),
    media_bytes, media_sha256 and ``feature``: frames, hundredths of a second, and the
    grey histogram of 16 bins over all frames, joined by commas. A null text is empty.
    Equal texts have equal values. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, 1, CHUNK):
                texts = part.column(1).to_pylist()
                media = [g for _, g in _store_all(texts)]
                parsed = [parse(g) for g in media]
                images = [m for *_, own in parsed for m in own]
                pixels = indices(images)
                at, rows = 0, []
                for d, t, g, (width, height, palette, own) in zip(part.column(0).to_pylist(), texts, media, parsed):
                    grey = canvases(width, height, palette, own, pixels[at : at + len(own)])[..., 0]
                    at += len(own)
                    payload = grey.tobytes()
                    bins = np.bincount(grey.ravel() >> 4, minlength=16)
                    feature = ",".join(map(str, (len(own), sum(m.delay for m in own), *bins.tolist())))
                    rows.append((d, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(g), hashlib.sha256(g).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
