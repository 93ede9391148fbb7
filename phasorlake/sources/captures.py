"""Splat captures: .splat, .spz (gzipped, versions 2 and 3) and .ply files as tables, and back.

Files are read by Spark's ``binaryFile`` source, so any store that Spark reads will do;
each file is decoded in one task into a row for each splat. Scenes are y-up: layouts
that store y down are turned by half a turn about x.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["x", "y", "z", "sx", "sy", "sz", "r", "g", "b", "a", "qw", "qx", "qy", "qz"]
SCHEMA = "path string, id long, " + ", ".join(f"{c} double" for c in COLUMNS)
#: Splats in a batch that is passed on.
ROWS = 100_000
# fixed values of the formats
SPZ_MAGIC = 0x5053474E
SH_C0 = 0.28209479177387814
COLOR_SCALE = 0.15
SH_COUNTS = {0: 0, 1: 3, 2: 8, 3: 15}
_TYPES = {"float": "<f4", "float32": "<f4", "double": "<f8", "uchar": "u1", "uint8": "u1", "int": "<i4", "short": "<i2", "ushort": "<u2", "char": "i1", "uint": "<u4"}


class Splats:
    """Arrays of a capture: pos, scale (n, 3), rgba, quat wxyz (n, 4), and coefficients (n, 3, k) or none."""

    def __init__(self, pos, scale, rgba, quat, sh=None):
        self.pos, self.scale, self.rgba, self.quat, self.sh = (np.asarray(a, float) if a is not None else None for a in (pos, scale, rgba, quat, sh))

    def half_turn(self) -> Splats:
        """By 180 degrees about x: its own inverse, up to the quaternions' sign."""
        w, x, y, z = self.quat.T
        sh = self.sh * sh_half_turn(3)[: self.sh.shape[2]] if self.sh is not None else None
        return Splats(self.pos * [1, -1, -1], self.scale, self.rgba, np.column_stack([-x, w, -z, y]), sh)

    def table(self) -> np.ndarray:
        return np.column_stack([self.pos, self.scale, self.rgba, self.quat])


def _unit(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)


def decode_splat(data: bytes) -> Splats:
    if len(data) % 32:
        raise ValueError("records have 32 bytes")
    rec = np.frombuffer(data, np.dtype([("pos", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("quat", "u1", 4)]))
    return Splats(rec["pos"], rec["scale"], rec["rgba"] / 255.0, _unit((rec["quat"].astype(float) - 128) / 128)).half_turn()


def spz_header(data: bytes) -> dict:
    """Header fields; a gzipped file is unpacked only as far as needed."""
    if data[:2] == b"\x1f\x8b":
        import io

        data = gzip.GzipFile(fileobj=io.BytesIO(data)).read(16)
    magic, version, n, degree, bits, flags, _ = struct.unpack_from("<3I4B", data)
    if magic != SPZ_MAGIC:
        raise ValueError("not an SPZ file")
    return {"version": version, "points": n, "sh_degree": degree, "fraction_bits": bits, "flags": flags}


def _smallest_three(raw: np.ndarray) -> np.ndarray:
    """wxyz of packed rotations: the place (xyzw) of the largest part in the top two bits, then sign and nine bits for each other part."""
    word = raw.astype(np.uint32) @ np.array([1, 1 << 8, 1 << 16, 1 << 24], np.uint32)
    largest = (word >> 30).astype(int)
    out = np.zeros((len(word), 4))
    for top in range(4):
        own = largest == top
        for k, part in enumerate([p for p in range(4) if p != top]):
            field = word[own] >> np.uint32(10 * (2 - k))
            out[own, part] = np.where(field >> 9 & 1, -1.0, 1.0) * (field & 511) / 511 * np.sqrt(0.5)
        out[own, top] = np.sqrt(np.clip(1 - (out[own] ** 2).sum(1), 0, None))
    return out[:, [3, 0, 1, 2]]


def decode_spz(data: bytes) -> Splats:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    h = spz_header(data)
    n, version, k = h["points"], h["version"], SH_COUNTS[h["sh_degree"]]
    if version not in (2, 3):
        raise ValueError(f"version {version} is not read")
    widths = [9, 1, 3, 3, 3 if version == 2 else 4, 3 * k]
    if len(data) != 16 + n * sum(widths):
        raise ValueError("the size doesn't fit the header")
    at, parts = 16, []
    for w in widths:
        parts.append(np.frombuffer(data, np.uint8, n * w, at).reshape(n, w))
        at += n * w
    p, alpha, color, scale, rot, sh = parts
    fixed = p.reshape(n, 3, 3).astype(np.int32) @ np.array([1, 1 << 8, 1 << 16], np.int32)
    pos = ((fixed ^ 0x800000) - 0x800000) / float(1 << h["fraction_bits"])
    rgb = np.clip(0.5 + SH_C0 * (color / 255.0 - 0.5) / COLOR_SCALE, 0, 1)
    if version == 2:
        xyz = rot / 127.5 - 1
        quat = np.column_stack([np.sqrt(np.clip(1 - (xyz**2).sum(1), 0, None)), xyz])
    else:
        quat = _smallest_three(rot)
    coeff = ((sh.astype(float) - 128) / 128).reshape(n, k, 3).transpose(0, 2, 1) if k else None
    return Splats(pos, np.exp(scale / 16.0 - 10), np.column_stack([rgb, alpha / 255.0]), quat, coeff)


def encode_spz(s: Splats, fraction_bits: int = 12, version: int = 3) -> bytes:
    n = len(s.pos)
    fixed = np.rint(s.pos * (1 << fraction_bits)).astype(np.int64)
    if n and np.abs(fixed).max() >= 1 << 23:
        raise ValueError("a position is out of the format's range")
    p = (fixed[..., None] >> np.array([0, 8, 16]) & 255).astype(np.uint8)
    byte = lambda v: np.clip(np.rint(v), 0, 255).astype(np.uint8)
    color = byte(((s.rgba[:, :3] - 0.5) / SH_C0 * COLOR_SCALE + 0.5) * 255)
    quat = _unit(s.quat)
    if version == 2:
        quat = np.where(quat[:, :1] < 0, -quat, quat)
        rot = byte((quat[:, 1:] + 1) * 127.5).tobytes()
    else:
        q = quat[:, [1, 2, 3, 0]]
        largest = np.abs(q).argmax(1)
        q = q * np.where(q[np.arange(n), largest] < 0, -1, 1)[:, None]
        word = largest.astype(np.uint32) << np.uint32(30)
        for top in range(4):
            own = largest == top
            for k, part in enumerate([x for x in range(4) if x != top]):
                v = q[own, part]
                field = (v < 0).astype(np.uint32) << np.uint32(9) | np.clip(np.rint(np.abs(v) * np.sqrt(2) * 511), 0, 511).astype(np.uint32)
                word[own] |= field << np.uint32(10 * (2 - k))
        rot = word.astype("<u4").tobytes()
    body = struct.pack("<3I4B", SPZ_MAGIC, version, n, 0, fraction_bits, 0, 0)
    body += p.tobytes() + byte(s.rgba[:, 3] * 255).tobytes() + color.tobytes() + byte((np.log(s.scale) + 10) * 16).tobytes() + rot
    return gzip.compress(body, mtime=0)


def decode_ply(data: bytes, sigma_scale: float = 0.75) -> Splats:
    """Full captures (opacity, log scales, rotations), or plain clouds, binary or ascii, whose
    deviation is ``sigma_scale`` times the median distance to the nearest of a sample of 2,000 points."""
    end = data.index(b"end_header") + data[data.index(b"end_header") :].index(b"\n") + 1
    form, n, props, vertex = "", 0, [], False
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            vertex = w[1] == "vertex"
            n = int(w[2]) if vertex else n
        elif w[:1] == ["property"] and vertex and w[1] != "list":
            props.append((w[2], _TYPES[w[1]]))
    names = [p for p, _ in props]
    if names[:3] != ["x", "y", "z"]:
        raise ValueError("a vertex begins with x, y, z")
    if form == "ascii":
        rows = [line.split()[: len(props)] for line in data[end:].decode("ascii").splitlines()[:n]]
        table = np.array(rows, float).reshape(-1, len(props))
        get = lambda *c: table[:, [names.index(x) for x in c]]
    elif form == "binary_little_endian":
        rec = np.frombuffer(data, np.dtype(props), n, end)
        get = lambda *c: np.column_stack([rec[x].astype(float) for x in c])
    else:
        raise ValueError(f"format {form} is not read")
    pos = get("x", "y", "z")
    if {"f_dc_0", "opacity", "scale_0", "rot_0"} <= set(names):
        rgb = np.clip(0.5 + SH_C0 * get("f_dc_0", "f_dc_1", "f_dc_2"), 0, 1)
        alpha = 1 / (1 + np.exp(-get("opacity")))
        rest = sum(x.startswith("f_rest_") for x in names)
        sh = get(*[f"f_rest_{i}" for i in range(rest)]).reshape(len(pos), 3, rest // 3) if rest else None
        return Splats(pos, np.exp(get("scale_0", "scale_1", "scale_2")), np.column_stack([rgb, alpha]), _unit(get("rot_0", "rot_1", "rot_2", "rot_3")), sh).half_turn()
    rgb = np.clip(get("red", "green", "blue"), 0, 255) / 255 if names[3:6] == ["red", "green", "blue"] else np.ones((len(pos), 3))
    some = pos[np.random.default_rng(0).permutation(len(pos))[:2000]]
    d = np.full(len(some), np.inf)
    for i in range(len(some)):
        e = ((some - some[i]) ** 2).sum(1)
        e[i] = np.inf
        d[i] = e.min()
    sigma = sigma_scale * float(np.median(np.sqrt(d))) if len(some) > 1 else sigma_scale
    return Splats(pos, np.full((len(pos), 3), sigma), np.column_stack([rgb, np.ones(len(pos))]), np.tile([1.0, 0, 0, 0], (len(pos), 1)))


def encode_ply(s: Splats) -> bytes:
    """The full binary layout, y down."""
    t = s.half_turn()
    a = np.clip(t.rgba[:, 3], 1e-6, 1 - 1e-6)
    cols = np.column_stack([t.pos, (t.rgba[:, :3] - 0.5) / SH_C0, np.log(a / (1 - a)), np.log(t.scale), t.quat]).astype("<f4")
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {len(cols)}", *[f"property float {x}" for x in names], "end_header", ""])
    return head.encode() + cols.tobytes()


DECODERS = {"splat": decode_splat, "spz": decode_spz, "ply": decode_ply}
ENCODERS = {"spz": encode_spz, "ply": encode_ply}


def decode_files(files: DataFrame, coefficients: bool = False) -> DataFrame:
    """Rows of splats from (path, content), by the suffix of the path; with their colour
    coefficients ``sh`` (red, then green, then blue; null where a file has none) if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path = path.as_py()
                kind = path.rsplit(".", 1)[-1].lower()
                if kind not in DECODERS:
                    raise ValueError(f"{path}: no such format")
                got = DECODERS[kind](content.as_py())
                t = got.table()
                for a in range(0, len(t), ROWS):  # a large file in batches
                    part = t[a : a + ROWS]
                    columns = [pa.array([path] * len(part)), pa.array(np.arange(a, a + len(part))), *(pa.array(np.ascontiguousarray(c)) for c in part.T)]
                    if coefficients:
                        sh = [None] * len(part) if got.sh is None else list(got.sh[a : a + ROWS].reshape(len(part), -1))
                        columns.append(pa.array(sh, pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(columns, ["path", "id", *COLUMNS, *(["sh"] if coefficients else [])])

    return files.select("path", "content").mapInArrow(run, SCHEMA + (", sh array<double>" if coefficients else ""))


def read(spark: SparkSession, path: str, coefficients: bool = False) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").load(path), coefficients)


def sh_half_turn(degree: int) -> np.ndarray:
    """Signs of a channel's coefficients (without the constant) under the half turn about x:
    of that of band l, order m, minus one to the l + m, and once more where m is below 0."""
    return np.array([(-1.0) ** (l + m) * (-1.0 if m < 0 else 1.0) for l in range(1, degree + 1) for m in range(-l, l + 1)])  # noqa: E741


def rotations(df: DataFrame, quat: tuple[str, str, str, str] = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """Rows with the nine entries r00 .. r22 of their unit quaternions' rotation."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in quat), F.lit(0.0)))
    w, x, y, z = (F.col(c) / F.greatest(n, F.lit(1e-9)) for c in quat)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return df.withColumns({f"r{i}{j}": rows[i][j] for i in range(3) for j in range(3)})


def covariances(df: DataFrame, floor: float, cap: float, scale: tuple[str, str, str] = ("sx", "sy", "sz")) -> DataFrame:
    """Rows with scales held in [floor, cap] and the upper triangle c00, c01, c02, c11, c12, c22 of their covariance."""
    df = rotations(df).withColumns({c: F.greatest(F.lit(floor), F.least(F.lit(cap), F.col(c))) for c in scale})
    entry = lambda i, j: sum((F.col(f"r{i}{k}") * F.col(f"r{j}{k}") * F.col(c) * F.col(c) for k, c in enumerate(scale)), F.lit(0.0))
    return df.withColumns({f"c{i}{j}": entry(i, j) for i in range(3) for j in range(i, 3)}).drop(*[f"r{i}{j}" for i in range(3) for j in range(3)])


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, version, points, sh_degree, fraction_bits) of .spz files; bodies aren't decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.spz").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [spz_header(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in h], pa.int64()) for k in ("version", "points", "sh_degree", "fraction_bits"))], ["path", "version", "points", "sh_degree", "fraction_bits"])

    return files.select("path", "content").mapInArrow(run, "path string, version long, points long, sh_degree long, fraction_bits long")


def encode_files(splats: DataFrame, kind: str) -> DataFrame:
    """(path, content): each path's splats, in order of id, as one file; a file is made in one task."""

    def run(pdf):
        import pandas as pd

        t = pdf.sort_values("id")[COLUMNS].to_numpy(float)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [ENCODERS[kind](Splats(t[:, :3], t[:, 3:6], t[:, 6:10], t[:, 10:]))]})

    return splats.groupBy("path").applyInPandas(run, "path string, content binary")


def crop(splats: DataFrame, low: list[float], extent: list[float], alpha_min: float = 0.0) -> DataFrame:
    """Splats whose centres are in a box, its faces included; an empty result is an error."""
    out = splats.filter(F.col("a") >= alpha_min)
    for c, lo, e in zip("xyz", low, extent):
        out = out.filter(F.col(c).between(lo, lo + e))
    some = out.agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") > 0, F.lit("no splat is in the box")).alias("_ok"))
    return out.crossJoin(F.broadcast(some)).filter("_ok IS NULL").drop("_ok")


def bounds(splats: DataFrame, alpha_min: float = 0.0) -> DataFrame:
    rows = splats.filter(F.col("a") >= alpha_min)
    return rows.groupBy("path").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
