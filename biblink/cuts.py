"""Cuts of lineage: intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import DataFrame, SparkSession

_number = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where none is set and all
    run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cuts-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read from there: branches that share ``df`` don't recompute it, lost
    executors take nothing with them, and the planner knows its size.  The files go
    when the application ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/tables-{sc.applicationId}/{next(_number)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)
