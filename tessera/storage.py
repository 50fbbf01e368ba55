"""Lineage cuts that survive the loss of executors.

Intermediate tables are written as Parquet under the folder that the cluster names in ``spark.checkpoint.dir``; every
executor and the driver see that folder.  Only where the setting is absent and the master is local (tests), a temporary folder
is made; on a cluster that is an error.  :func:`release` deletes what a session has written, when its results are read.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``, else one temporary folder a process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _LOCAL["dir"].removeprefix("file://"), ignore_errors=True)
    return _LOCAL["dir"]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessera/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this application has written; results that were not read yet are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut with the same rows, columns and types."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
