"""Cutting lineage where executors can be lost: tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset and one process runs
    everything, a temporary folder takes its place; on a cluster that is an error."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[sc.applicationId]


def checkpointed(df: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """df written to the shared folder and read back from there. previous: the
    table of the round before, which df was made from and which goes now.

    Unlike DataFrame.checkpoint() this forgets the estimates of sizes too, which
    joins in a loop would multiply without end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    if previous is not None and previous in _written:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop(previous))
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return out
