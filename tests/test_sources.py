"""File formats, generators and the stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import files, synthetic
from cairn.streaming.voxels import voxel_stream


def test_lidar_records(spark, tmp_path):
    m = np.arange(40, dtype="<f4").reshape(10, 4)
    (tmp_path / "a.bin").write_bytes(m.tobytes())
    rows = files.read_lidar_bin(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [[r["x"], r["y"], r["z"]] for r in rows] == m[:, :3].tolist()
    assert "intensity" in files.read_lidar_bin(spark, str(tmp_path), intensity=True).columns
    (tmp_path / "a.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="16-byte"):
        files.read_lidar_bin(spark, str(tmp_path)).collect()


def test_text_clouds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k},{k + 1},{k + 2},0,0,1\n" for k in range(50)))
    rows = files.read_xyzn(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r["point_id"], r["x"], r["nz"]) for r in rows] == [(k, float(k), 1.0) for k in range(50)]
    assert files.read_xyz(spark, str(tmp_path)).columns == ["cloud_id", "point_id", "x", "y", "z"]


OFF = "{}4 2 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n3 0 1 2\n4 0 1 2 3\n"


@pytest.mark.parametrize("head", ["OFF\n", "OFF"])
def test_meshes(spark, tmp_path, head):
    (tmp_path / "chair" / "train").mkdir(parents=True)
    (tmp_path / "chair" / "train" / "chair_1.off").write_text(OFF.format(head))
    src = str(tmp_path)
    assert files.read_off(spark, src).count() == 4
    faces = [r["face"] for r in files.read_off(spark, src, "faces").orderBy("face_id").collect()]
    assert faces == [[3, 0, 1, 2], [4, 0, 1, 2, 3]]
    out = files.convert_off_tree(spark, src, str(tmp_path / "ply"), with_faces=True).collect()
    assert [(r["class"], r["split"], r["n_points"], r["n_faces"]) for r in out] == [("chair", "train", 4, 2)]
    raw = (tmp_path / "ply" / "chair" / "train" / "chair_1.ply").read_bytes()
    body = raw.split(b"end_header\n", 1)[1]
    assert len(body) == 4 * 12 + 2 * 13 and struct.unpack("<Biii", body[-13:]) == (3, 0, 1, 2)
    files.write_ply(files.read_off(spark, src), str(tmp_path / "one.ply"))
    assert b"element vertex 4" in (tmp_path / "one.ply").read_bytes()


def test_ids_and_descriptors(spark, tmp_path):
    files.write_ids(spark.createDataFrame([(3,), (1,)], "point_id long"), str(tmp_path / "ids"))
    assert sorted(r[0] for r in files.read_ids(spark, str(tmp_path / "ids")).collect()) == [1, 3]
    rows = spark.createDataFrame([(7, 0, 0.5), (7, 1, 0.25)], "key_idx long, index int, feature double")
    files.write_descriptors(rows, str(tmp_path / "d"))
    assert sorted(map(tuple, files.read_descriptors(spark, str(tmp_path / "d")).collect())) == [(7, 0, 0.5), (7, 1, 0.25)]


def test_file_list(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1234")
    assert [r["length"] for r in files.list_files(spark, str(tmp_path)).collect()] == [4]


def test_generators_do_not_depend_on_partitions(spark):
    a = synthetic.cube(spark, 500).orderBy("point_id").collect()
    b = synthetic.cube(spark, 500).repartition(7).orderBy("point_id").collect()
    assert a == b and all(0 < r["x"] < 1 for r in a)
    g = synthetic.gaussians(spark).groupBy("component").agg(F.count("*").alias("n"), F.avg("x").alias("m")).orderBy("component").collect()
    assert [r["n"] for r in g] == [400, 600, 1000] and [r["m"] for r in g] == pytest.approx([0.5, 5.5, 1.0], abs=0.4)
    for kind in ("circles", "moons", "blobs", "uniform", "sheared", "varied"):
        assert synthetic.shapes(spark, kind).count() == 1500
    assert synthetic.sample_rows(spark.range(10).withColumnRenamed("id", "point_id"), 100).count() == 100


def test_stream(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("point_id"), (F.col("id") % 10 / 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = voxel_stream(stream, 0.5).writeStream.outputMode("complete").format("memory").queryName("voxels").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("voxels").agg(F.sum("n_points")).first()[0] == 100
