import struct

import numpy as np
import pytest

from spanloom.sources import captures, rasters
from spanloom.sources.ply import PlyDataSource
from spanloom.streaming import captures as arrivals


def test_ply_text_and_binary(spark, tmp_path):
    spark.dataSource.register(PlyDataSource)
    head = "ply\nformat {} 1.0\ncomment TextureFile t.png\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "0 0 0 1\n1 0 0 2\n0 1 0 255\n3 0 1 2\n")
    body = b"".join(struct.pack("<fffB", *v) for v in ((0, 0, 0, 1), (1, 0, 0, 2), (0, 1, 0, 255))) + struct.pack("<Biii", 3, 0, 1, 2)
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + body)
    for name in ("a.ply", "b.ply"):
        v = spark.read.format("ply").load(str(tmp_path / name)).orderBy("row").collect()
        assert [(r.x, r.y, r.red) for r in v] == [(0, 0, 1), (1, 0, 2), (0, 1, 255)]
        f = spark.read.format("ply").option("element", "face").load(str(tmp_path / name)).first()
        assert f.vertex_indices == [0, 1, 2]
    (tmp_path / "c.ply").write_bytes(head.format("binary_little_endian").encode() + body[:20])
    with pytest.raises(Exception, match="too short"):
        spark.read.format("ply").load(str(tmp_path / "c.ply")).collect()


def test_float_map(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"2&3&1&" + np.arange(6, dtype="<f4").tobytes())
    r = rasters.read_float_maps(spark, str(tmp_path)).first()
    assert (r.height, r.width, r.channels) == (3, 2, 1) and r["values"] == [0, 1, 2, 3, 4, 5]
    assert rasters.map_pixels(rasters.read_float_maps(spark, str(tmp_path))).where("y = 2 and x = 1").first().value == 5
    with pytest.raises(ValueError, match="wrong size"):
        rasters.decode_float_map(b"2&3&1&" + b"0" * 8)


def test_tile_config(spark, tmp_path):
    (tmp_path / "t.cfg").write_text("# tile\na.jpg\nb.jpg, c.jpg\nb.jpg\na.jpg\n")
    got = captures.read_tile_config(spark, str(tmp_path / "t.cfg")).orderBy("ref", "pos").collect()
    assert [(r.ref, r.source) for r in got] == [("a.jpg", "b.jpg"), ("a.jpg", "c.jpg"), ("b.jpg", "a.jpg")]
    (tmp_path / "u.cfg").write_text("a.jpg\na.jpg\n")
    with pytest.raises(Exception, match="its reference"):
        captures.read_tile_config(spark, str(tmp_path / "u.cfg")).collect()


def test_rings_last_row_counts(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"records": [{"relative_path": "x/a.jpg", "logical_ring_id": "g1"}, {"relative_path": "a.jpg", "logical_ring_id": "g2"}]}')
    assert [(r.name, r.ring) for r in captures.read_rings(spark, str(tmp_path / "r.json")).collect()] == [("a.jpg", "g2")]


def test_stream_takes_only_what_is_new(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = lambda *ids: spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in ids], "k int, t string").selectExpr("k", "to_timestamp(t) as t")
    rows(1, 2, 2).coalesce(1).write.parquet(src)
    stream = lambda: arrivals.first_arrivals(spark.readStream.schema("k int, t timestamp").parquet(src), "k", "t")
    arrivals.append_table(stream(), out, ck).awaitTermination()
    rows(2, 3).coalesce(1).write.mode("append").parquet(src)
    arrivals.append_table(stream(), out, ck).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2, 3]
