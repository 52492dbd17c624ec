"""Point tables derived from Parquet tables of vectors, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three vector components as coordinates, the next three, normalised, as normals."""
    e = F.col("embedding")
    raw = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), *[e[k].cast("double").alias(n) for k, n in enumerate(("x", "y", "z", "a", "b", "c"))], "label")
    length = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return raw.select("point_id", "x", "y", "z", *[(F.col(s) / length).alias(n) for s, n in (("a", "nx"), ("b", "ny"), ("c", "nz"))], "label")


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates without an identity, for operators that need none."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_discount") * 100.0).alias("z"))


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points: customer, price and day."""
    o = read(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") / 100.0).alias("x"), (F.col("o_totalprice") / 10000.0).alias("y"), (day / 10.0).alias("z"))
