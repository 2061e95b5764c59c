"""Shared helpers: the scratch folder, written intermediate tables, remote files and batch output."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "x")).getParent().getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors never force its lineage to run again."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession, batch: int) -> Iterator[None]:
    """Files of the exchanges of a table that is written in here are deleted once it is; Arrow batches end at about
    ``batch`` bytes, a row at least."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(batch)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def give_back() -> None:
    """Memory that is free goes back to the system, since a worker is kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable) -> Callable:
    """``f`` for ``applyInArrow``; each group's memory goes back once its result is made."""

    def one(key, table):
        out = f(key, table)
        give_back()
        return out

    def two(key, table, back):
        out = f(key, table, back)
        give_back()
        return out

    return one if f.__code__.co_argcount == 2 else two


def open_store(uri: str):
    """(pyarrow file system, path) of a URI that executors and driver share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def rows_frame(rows: list[tuple], columns: list[str], kinds: dict[str, str] | None = None) -> pd.DataFrame:
    out = pd.DataFrame.from_records(rows, columns=columns)
    for name, kind in (kinds or {}).items():
        out[name] = out[name].astype(kind)
    return out
