"""Working tables in the folder that all machines of the cluster share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a
single machine) a temporary folder of this machine takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder with its scheme, without a trailing slash."""
    if shared := spark.conf.get(_SETTING, None):
        folder = spark._jvm.org.apache.hadoop.fs.Path(shared)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return system.makeQualified(folder).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all machines share")
    return _own.setdefault(_SETTING, f"file://{tempfile.mkdtemp(prefix='vicinal-')}")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/vicinal/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete the working tables of this application; what was read from them must have been used or written elsewhere.

    Nothing is deleted earlier, as results are lazy and read their working tables whenever they are used. True if there was anything.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
