"""Tables in the folder that driver and executors share, and scans of few files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set, as the cluster names it. With a local master else a temporary folder, and on
    a cluster the warehouse, unless that is a folder of one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        app = spark.sparkContext.applicationId
        return _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="inkfold-"))
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if _system(spark, warehouse).getScheme() == "file":
        raise ValueError(f"executors may not share {warehouse}: set spark.checkpoint.dir to a folder that all of them see")
    return warehouse


def _own(spark: SparkSession) -> str:
    return f"{root(spark)}/_inkfold-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the application ends."""
    own, shared = _own(spark), root(spark)
    gone = shared if shared in _local.values() else own
    _system(spark, gone).deleteOnExit(_path(spark, gone))
    return f"{own}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    _system(spark, path).delete(_path(spark, path), True)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application has put in the shared folder; results that still read them are lost."""
    remove(spark, _own(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, for plans that read it several times; survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than cores, dealt to all cores; any other scan as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Rows of postings, or the like, that one task sorts and writes.
ROWS = 1 << 22


def files_for(rows: int, least: int) -> int:
    """How many files a table of so many rows is dealt to: at least ``least``, and as many more as keep a task at ``ROWS``."""
    return max(least, -(-rows // ROWS))
