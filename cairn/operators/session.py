"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and its lineage cut by a reliable checkpoint on shared storage.

    The folder is the session's checkpoint folder; a temporary one is set only where there is none and all runs in this one process.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-"))
    return _sized(df.checkpoint())


def _sized(df: DataFrame) -> DataFrame:
    """A checkpoint with the size of its files as its statistics.

    Spark gives it those of the plan it came from, where every join multiplies sizes: in a loop they gain digits with each round, until planning
    takes all time and memory.
    """
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    plan = df._jdf.queryExecution().logical()
    path = jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    stats = spark.range(max(1, size // 8)).select(-F.col("id"))._jdf.queryExecution().optimizedPlan().stats()  # of 8 bytes a row: Python can't make a BigInt
    none = jvm.scala.Option.empty()
    logical = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, df._jdf.sparkSession(), jvm.scala.Option.apply(stats), none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), logical), spark)


def clouds(df: DataFrame, by: Sequence[str] | None = None) -> list[str]:
    """The columns that hold clouds apart: those named, else ``cloud_id`` if there is one."""
    if by is not None:
        return list(by)
    return ["cloud_id"] if "cloud_id" in df.columns else []
