"""Streaming down-sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def voxel_stream(points: DataFrame, leaf: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Centroid and size of every voxel in every time window of a stream with an event time.

    A stream has no bounds of its own, so voxels count from a given origin. Watermarked state holds one running sum a voxel
    and window, never points; windows are given out once late data can't reach them.
    """
    cells = {f"h{c}": F.floor((F.col(c) - F.lit(o)) / leaf) for c, o in zip(AXES, origin, strict=True)}
    grouped = points.withColumns(cells).withWatermark(time, late).groupBy(F.window(time, window), "hx", "hy", "hz")
    return grouped.agg(*[F.avg(c).alias(c) for c in AXES], F.count("*").alias("n_points"))
