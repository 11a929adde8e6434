"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Where this process wrote tables that are not discarded yet.
_WRITTEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is empty, a session of one machine (master local[...]) gets a folder of its own; on a cluster that is an
    error, as other machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gaugeworks.shared.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("gaugeworks.shared.dir", folder)
    return folder.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here, and no executor has to survive."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)  # when the driver ends
    _WRITTEN.add(path)
    out = spark.read.schema(schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of save() that nothing reads any more."""
    path = getattr(df, "_saved_at", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)
    _WRITTEN.discard(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that save() wrote and nothing discarded, between the queries of a long session: results that were not
    yet read are lost with them. How many there were."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)
