"""Work tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/lodestone-{os.getuid()}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below this application's own."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete this application's work tables, archives and id files. Call it when the results that read them are written."""
    _delete(spark, _own(spark))


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Paths of the work tables that saved wrote and that are still there, in order.
_tables: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_alone(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """saved(build(), name), after which the work tables that build() saved are deleted: nothing reads them any more."""
    first = len(_tables)
    out = saved(build(), name)
    for path in _tables[first:-1]:
        _delete(spark, path)
    del _tables[first:-1]
    return out
