"""Tables that cut the lineage, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made inside each open ``scratch_tables``.
_made: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error else."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("seqtrend.scratch.dir", None)
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("seqtrend.scratch.dir", where)
    return where


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of ``scratch_tables``, else when the driver ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, hadoop_path = _hadoop(spark, path)
    files.deleteOnExit(hadoop_path)
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables stored inside, so that a long session keeps its disk. Results must have been written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            files, hadoop_path = _hadoop(spark, path)
            files.delete(hadoop_path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
