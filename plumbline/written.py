"""Tables that a job writes on its way, in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under this application's folder in the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local, as in tests, a temporary folder is chosen and set; a
    cluster without the setting is refused, as its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{label}"


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written elsewhere."""
    drop(spark, scratch(spark, "x").rsplit("/", 2)[0])


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its plan runs once, whoever reads it and however often, and
    lost executors never force it to run again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
