"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees; below /tmp where a single-machine session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/tilth-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tilth-{uuid.uuid4().hex}"


#: Folders of written frames that may be deleted.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the folders of materialized frames that nothing will read again; what was made of them must be written."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(frame))
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
