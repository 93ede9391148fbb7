import gzip
import struct

import numpy as np
import pytest

from phasorlake.sources import blobs, captures, records


def scene(n=20, seed=0):
    r = np.random.default_rng(seed)
    q = r.normal(size=(n, 4))
    return captures.Splats(r.uniform(-3, 3, (n, 3)), np.exp(r.uniform(-5, 0, (n, 3))), r.uniform(0.1, 0.9, (n, 4)), q / np.linalg.norm(q, axis=1, keepdims=True))


def same_rotation(a, b, tolerance):
    assert (np.abs((a * b).sum(1)) > 1 - tolerance).all()


@pytest.mark.parametrize("version", [2, 3])
def test_spz_round_trip(version):
    s = scene()
    back = captures.decode_spz(captures.encode_spz(s, version=version))
    assert np.abs(back.pos - s.pos).max() < 1 / 4096
    assert np.abs(np.log(back.scale / s.scale)).max() <= 1 / 32 + 1e-9
    assert np.abs(back.rgba - s.rgba).max() < 0.01
    same_rotation(back.quat, s.quat, 0.01 if version == 2 else 1e-4)


def test_spz_by_hand():
    head = struct.pack("<3I4B", captures.SPZ_MAGIC, 2, 1, 0, 12, 0, 0)
    data = head + bytes([0, 16, 0, 0, 240, 255, 1, 0, 0, 255, 128, 128, 128, 160, 160, 160, 255, 127, 127])
    s = captures.decode_spz(gzip.compress(data))
    assert s.pos.tolist() == [[1.0, -1.0, 1 / 4096]] and s.rgba[0, 3] == 1 and np.allclose(s.scale, 1)
    assert s.quat[0, 1] == 1
    with pytest.raises(ValueError):
        captures.decode_spz(data[:-1])
    with pytest.raises(ValueError):
        captures.decode_spz(b"\0" * 16)
    with pytest.raises(ValueError):
        captures.encode_spz(captures.Splats([[4000.0, 0, 0]], [[1, 1, 1]], [[0.5] * 4], [[1, 0, 0, 0]]))


def test_ply_round_trip_and_ascii():
    s = scene()
    back = captures.decode_ply(captures.encode_ply(s))
    assert np.abs(back.table()[:, :10] - s.table()[:, :10]).max() < 1e-4
    same_rotation(back.quat, s.quat, 1e-6)
    text = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n0 0 0 300 -4 255\n1 0 0 0 0 0\n3 0 0 0 0 0\n"
    p = captures.decode_ply(text)
    assert p.rgba[0].tolist() == [1, 0, 1, 1] and p.scale[0, 0] == 0.75


def test_tables(spark, tmp_path):
    s = scene()
    (tmp_path / "a.spz").write_bytes(captures.encode_spz(s))
    (tmp_path / "b.ply").write_bytes(captures.encode_ply(s))
    raw = np.zeros(2, np.dtype([("p", "<f4", 6), ("c", "u1", 8)]))
    raw["p"][0, :3], raw["c"][:, 4] = (1, 2, 3), 255
    (tmp_path / "c.splat").write_bytes(raw.tobytes())
    df = captures.read(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["count"] for r in df.groupBy("path").count().collect()} == {"a.spz": 20, "b.ply": 20, "c.splat": 2}
    first = df.filter("path like '%splat' and id = 0").first()
    assert (first.x, first.y, first.z) == (1, -2, -3)
    assert captures.headers(spark, str(tmp_path)).first().points == 20
    spz = df.filter("path like '%spz'")
    again = captures.decode_files(captures.encode_files(spz, "spz"))
    assert again.count() == 20
    box = captures.bounds(spz).first()
    assert captures.crop(spz, [box.min_x, box.min_y, box.min_z], [6, 6, 6]).count() == 20
    with pytest.raises(Exception, match="no splat"):
        captures.crop(spz, [50, 50, 50], [1, 1, 1]).count()


@pytest.mark.parametrize("kind,least", [("phase", 1), ("parts", 2), ("polar", 3)])
def test_blobs(kind, least):
    r = np.random.default_rng(1)
    v = r.normal(size=33) + 1j * r.normal(size=33)
    if kind == "phase":
        v /= np.abs(v)
    before = np.inf
    for bits in (least, 4, 8, 12, 16):
        back = blobs.unpack(blobs.pack(v, bits, kind))
        e = np.abs(back - v).max()
        assert e <= before + 1e-9
        before = e
    assert before < 1e-3
    for bad in (b"", b"XX" + b"\0" * 20, blobs.pack(v, 8, kind)[:-1]):
        with pytest.raises(ValueError):
            blobs.unpack(bad)
    with pytest.raises(ValueError):
        blobs.pack(v, 17, kind)


def test_blob_columns(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "re array<double>, im array<double>")
    got = df.select(blobs.unpacker()(blobs.packer(8)("re", "im")).alias("v")).first().v
    assert np.allclose(got.re, [1, 0], atol=1e-6) and np.allclose(got.im, [0, 1], atol=1e-6)


def test_json_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('# head\n{"id": "a", "statement": "s", "odd": 1}\n\n{"id": "b", "supersedes": "a"}\n{"id": "c", "stat')
    assert [r.id for r in records.registry(spark, str(tmp_path / "r.jsonl")).orderBy("id").collect()] == ["a", "b"]
    box = '{"data": [{"label": "chair", "segments": {"obbAligned": {"centroid": [1, 2, 3], "axesLengths": [2, 4, 6], "normalizedAxes": [1, 0, 0, 0, 1, 0, 0, 0, 1]}}}]}'
    b = records.boxes(spark.createDataFrame([(box,)], "json string")).first()
    assert (b.label, b.x, b.ex, b.ey, b.ez) == ("chair", 1, 1, 2, 3)
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(4)], "i int, x double, y double, z double")
    seg = spark.createDataFrame([([5, 5, 7, 9],)], "segIndices array<int>")
    grp = spark.createDataFrame([([(1, "cup", [5]), (2, "mat", [7])],)], "segGroups array<struct<id:int,label:string,segments:array<int>>>")
    rows = records.instances(points, seg, grp)
    assert sorted((r.i, r.instance) for r in rows.collect()) == [(0, 1), (1, 1), (2, 2), (3, -1)]
    objects = records.instance_objects(rows)
    mapping = spark.createDataFrame([("cup", "vessel"), ("mat", None)], "label string, target string")
    assert [(r.target, r.number, r.x, r.ex) for r in records.with_vocabulary(objects, mapping).collect()] == [("vessel", 0, 0.5, 0.5)]
    lint = spark.createDataFrame([('[{"filename": "a", "code": "E1"}, {"filename": "a", "code": "E1"}]',)], "json string")
    assert [tuple(r) for r in records.lint_counts(lint).collect()] == [("a", "E1", 2)]
