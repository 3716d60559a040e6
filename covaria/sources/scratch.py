"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this process has written and not cleared.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves local mode (tests); a cluster has no such folder of its own, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="covaria-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage and survives lost executors.

    The table stays until clear(), since whatever is derived from it may be computed later. Options are the Parquet writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/covaria-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process has written so far, and tell how many; call it when results are written down."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = 0
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        done += path.getFileSystem(conf).delete(path, True)
    return done
