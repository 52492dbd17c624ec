"""Clustering methods side by side on the synthetic shapes."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cloud, clustering
from ..operators.session import cut
from ..sources import synthetic

#: Shape and number of clusters to ask for.
SHAPES = {"circles": 2, "moons": 2, "varied": 3, "sheared": 3, "blobs": 3, "uniform": 3}


def compare(spark: SparkSession, methods: Sequence[str] = ("spectral", "kmeans"), n: int = 1500, shapes: Sequence[str] = tuple(SHAPES)) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    """shape, method, point_id, x, y, part, cluster, colour of every run, and (shape, method, seconds)."""
    rows, seconds = [], []
    for shape in shapes:
        flat = synthetic.shapes(spark, shape, n).withColumn("z", F.lit(0.0))
        points = cut(cloud.standardize(flat, ("x", "y")))
        for method in methods:
            began = time.time()
            options = {"r": 0.3, "min_sample": 5} if method == "dbscan" else {"k": SHAPES[shape]}
            found = cut(clustering.cluster(points, method, **options))
            seconds.append((shape, method, time.time() - began))
            label = F.col("cluster").cast("long")
            rows.append(points.join(found, "point_id").select(F.lit(shape).alias("shape"), F.lit(method).alias("method"), "point_id", "x", "y", "part", label.alias("cluster"), clustering.g.palette(label).alias("colour")))
    return cloud.stack(*rows), seconds
