"""Tables in the folder that all executors see: lineage ends there and lost executors cost nothing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _local[app] = _local.get(app) or tempfile.mkdtemp(prefix="shared-")
    return folder


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table in the shared folder; dropped() deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles nobody holds any more: it deletes their files once the driver's garbage is
    collected, which may otherwise be long after the jobs."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes shared tables whose last reader has ended, and the shuffles of ended jobs."""
    released(tables[0].sparkSession)
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.shared_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
