"""A shared folder for what a query writes and reads again, and rows dealt to all cores where a table is small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in `spark.checkpoint.dir`, which goes when the driver ends; in a local session without that setting,
    in a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="gossamer-")
    path = f"{root.rstrip('/')}/gossamer/{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: A table of fewer bytes may lie in a single row group, which one core would read and work on alone.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt to all cores; larger ones come in splits enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df
