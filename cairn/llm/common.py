"""Shared plumbing: tables kept on shared storage, free column names, sizing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words in every text operator (space, tab to carriage return).
SPACE = r"\x20\x09-\x0D"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``. Where that is unset a temporary one serves, but only if all runs in this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame, label: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: cuts lineage, survives lost executors.

    Meanwhile, Python gets Arrow batches of ``rows`` rows at most, if given: a batch of whole texts is in memory several times on either side.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    if rows:
        spark.conf.set(BATCH_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if rows:
            spark.conf.set(BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned, once all that reads them is itself kept."""
    for df in tables:
        _delete(df.sparkSession, df.kept_at)


def discard(spark: SparkSession) -> None:
    """Delete every table that ``keep`` wrote in this application and that hasn't been dropped: those that results still read."""
    _delete(spark, f"{shared_dir(spark)}/cairn/{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch, size: int = 2**22) -> Iterator:
    """An Arrow batch (or array) in pieces of about ``size`` bytes, of a row at least: what Python makes of a piece is gone before the next."""
    rows = max(1, len(batch) * size // max(1, batch.nbytes))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
