"""Tables that cut lineage: written once to the folder that all executors share, then read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one machine gets a temporary folder of its own; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='folioscope-')}")
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is the cluster's to clear then
        pass


def kept(df: DataFrame, name: str, made: list[DataFrame] | None = None) -> DataFrame:
    """df, written and read again, and put on the list ``made``; the files go by ``forget``, at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["path"] = path
    if made is not None:
        made.append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``kept`` wrote, once nothing reads it any more."""
    for df in tables:
        drop(df.sparkSession, df.__dict__["path"])
