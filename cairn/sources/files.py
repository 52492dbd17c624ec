"""Point-cloud file formats. Files are dealt to tasks as they are; rows carry their file and their ordinal in it.

Readers use Spark's own file sources, so any store that Spark reads will do. Writers of formats that Spark has no
writer for open their targets through Arrow's file systems, one task a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = "x double, y double, z double"
XYZN = XYZ + ", nx double, ny double, nz double"
#: Rows of one Arrow batch that a reader gives out.
STEP = 200_000


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and modification time of the files below ``path``, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_lidar_bin(spark: SparkSession, path: str, glob: str = "*.bin", intensity: bool = False) -> DataFrame:
    """cloud_id (the file), point_id, x, y, z[, intensity] from records of four little-endian floats.

    A file whose size isn't a whole number of records is an error.
    """
    names = ("x", "y", "z", "intensity") if intensity else ("x", "y", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_py()
                if len(raw) % 16:
                    raise ValueError(f"{file}: {len(raw)} bytes are no whole number of 16-byte records")
                m = np.frombuffer(raw, "<f4").reshape(-1, 4).astype(np.float64)
                for k in range(0, len(m), STEP):
                    part = m[k : k + STEP]
                    yield pa.record_batch([pa.array([file] * len(part), pa.string()), pa.array(np.arange(k, k + len(part))), *[pa.array(np.ascontiguousarray(part[:, j])) for j in range(len(names))]], ["cloud_id", "point_id", *names])

    return _binary(spark, path, glob).mapInArrow(run, "cloud_id string, point_id long, " + ", ".join(f"{n} double" for n in names))


def _text_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).csv(path).withColumn("cloud_id", F.col("_metadata.file_path"))
    return rows.withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_at", F.monotonically_increasing_id())


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Dense ordinals in each file: the rank in its block, which one task reads in order, plus the sizes of the blocks before."""
    from pyspark.sql import Window

    in_block = Window.partitionBy("cloud_id", "_block").orderBy("_at")
    sizes = rows.groupBy("cloud_id", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("cloud_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("cloud_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(in_block)).join(sizes, ["cloud_id", "_block"])
    return ranked.select("cloud_id", (F.col("_rank") + F.col("_before") - 1).cast("long").alias("point_id"), *columns)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """cloud_id, point_id, x, y, z from comma-separated lines (further columns are ignored)."""
    return _numbered(_text_rows(spark, path, XYZN), ["x", "y", "z"])


def read_xyzn(spark: SparkSession, path: str) -> DataFrame:
    """cloud_id, point_id, x, y, z, nx, ny, nz from comma-separated lines."""
    return _numbered(_text_rows(spark, path, XYZN), ["x", "y", "z", "nx", "ny", "nz"])


# --- meshes ---------------------------------------------------------------


def parse_off(raw: bytes) -> tuple[np.ndarray, list[list[int]]]:
    """Points, and faces as listed (their vertex count first). The counts may follow the word OFF on its own line."""
    tokens = raw.split()
    if not tokens or not tokens[0].startswith(b"OFF"):
        raise ValueError("not an OFF file")
    head = tokens[0][3:]
    tokens = ([head] if head else []) + tokens[1:]
    n, m = int(tokens[0]), int(tokens[1])
    at = 3 + 3 * n
    points = np.array(tokens[3:at], dtype=np.float64).reshape(n, 3)
    faces = []
    for _ in range(m):
        k = int(tokens[at])
        faces.append([k, *map(int, tokens[at + 1 : at + 1 + k])])
        at += 1 + k
    return points, faces


def read_off(spark: SparkSession, path: str, kind: str = "points", glob: str = "*.off") -> DataFrame:
    """``points``: cloud_id, point_id, x, y, z; ``faces``: cloud_id, face_id, face (vertex count, then vertices)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, raw in zip(f["path"], f["content"], strict=True):
                points, faces = parse_off(bytes(raw))
                if kind == "points":
                    yield pd.DataFrame(points, columns=["x", "y", "z"]).assign(cloud_id=file, point_id=np.arange(len(points)))[["cloud_id", "point_id", "x", "y", "z"]]
                else:
                    yield pd.DataFrame({"cloud_id": file, "face_id": np.arange(len(faces)), "face": faces})

    schema = "cloud_id string, point_id long, " + XYZ if kind == "points" else "cloud_id string, face_id long, face array<int>"
    return _binary(spark, path, glob).mapInPandas(run, schema)


def ply_bytes(points: np.ndarray, faces: list[list[int]] | None = None) -> bytes:
    """A binary PLY file: float coordinates and, with ``faces``, triangles of the first three vertices of each."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *[f"property float {c}" for c in "xyz"]]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    body = np.asarray(points, "<f4").reshape(-1, 3).tobytes()
    tail = b"".join(struct.pack("<Biii", 3, *f[1:4]) for f in faces or ())
    return "\n".join([*head, "end_header", ""]).encode() + body + tail


def _put(target: str, data: bytes) -> None:
    fs, path = pa.fs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def write_ply(points: DataFrame, target: str, faces: DataFrame | None = None) -> None:
    """One PLY file of a cloud (vertices in order of point_id), written by one task."""
    one = points.select(F.lit(target).alias("target"), "point_id", "x", "y", "z")
    flat = faces.select(F.lit(target).alias("target"), "face_id", "face") if faces is not None else None
    _write_each(one, flat).count()


def _write_each(points: DataFrame, faces: DataFrame | None) -> DataFrame:
    def put(target: str, p: pd.DataFrame, f: list | None) -> pd.DataFrame:
        _put(target, ply_bytes(p.sort_values("point_id")[["x", "y", "z"]].to_numpy(), f))
        return pd.DataFrame({"target": [target], "n_points": [len(p)]})

    schema = "target string, n_points long"
    if faces is None:
        return points.groupBy("target").applyInPandas(lambda key, p: put(key[0], p, None), schema)
    rows = lambda f: [list(map(int, x)) for x in f.sort_values("face_id")["face"]]
    return points.groupBy("target").cogroup(faces.groupBy("target")).applyInPandas(lambda key, p, f: put(key[0], p, rows(f)), schema)


def convert_off_tree(spark: SparkSession, source: str, target: str, with_faces: bool = False) -> DataFrame:
    """Every <class>/<train or test>/<name>.off below ``source`` as <name>.ply at the same place below ``target``; one row a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, raw in zip(f["path"], f["content"], strict=True):
                kind, split, name = path.rsplit("/", 3)[1:]
                if split not in ("train", "test"):
                    continue
                points, faces = parse_off(bytes(raw))
                out = f"{target.rstrip('/')}/{kind}/{split}/{name[:-4]}.ply"
                _put(out, ply_bytes(points, faces if with_faces else None))
                yield pd.DataFrame({"class": [kind], "split": [split], "target": [out], "n_points": [len(points)], "n_faces": [len(faces)]})

    return _binary(spark, source, "*.off").mapInPandas(run, "class string, split string, target string, n_points long, n_faces long")


# --- ids and descriptors --------------------------------------------------


def write_ids(df: DataFrame, path: str, column: str = "point_id") -> None:
    """One integer a line, ascending."""
    df.select(F.col(column)).orderBy(column).select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("point_id long").csv(path)


def write_descriptors(rows: DataFrame, path: str) -> None:
    """CSV with a header: an unnamed index that starts again for each key point, index, feature, key_idx."""
    out = rows.select(F.col("index").alias("_c0"), "index", "feature", "key_idx").orderBy("key_idx", "index")
    out.toDF("", "index", "feature", "key_idx").write.mode("overwrite").option("header", True).csv(path)


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).schema("_c0 int, index int, feature double, key_idx long").csv(path)
    return rows.select("key_idx", "index", "feature")
