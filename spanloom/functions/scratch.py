"""Intermediate tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Intermediate tables of this session.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset and the
    master is local (tests), a new temporary folder is made and recorded; on a
    cluster a missing setting is an error, since a machine-local folder would
    lose rows there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    found = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, noted for ``drop_stored``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new table in the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(table: DataFrame, most: int = 50_000) -> DataFrame:
    """A stored table to be broadcast if it was found to have few rows; larger ones are joined by a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def written(since: int = 0) -> list[str]:
    """The intermediate tables of this session, from the ``since``-th on."""
    return _written[since:]


def drop_stored(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Delete these intermediate tables, or all that this session has written; results read from them end with that."""
    for name in list(_written if tables is None else tables):
        if name in _written:
            _written.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
