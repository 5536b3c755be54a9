"""What the operators of this package share: tables, shared storage, ASCII helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and are stripped from line ends.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs in one process (``local[n]``,
    as in tests) a temporary folder takes its place; on a cluster a missing
    setting is an error, since a local folder would be seen by one machine.
    """
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir", None):
        return base
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dir[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a
    lost executor costs a re-read instead of a recomputation. paths gets the
    folder, for a caller that removes it when its result no longer needs it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Texts can be long: Arrow batches of fewer rows than Spark's default, and of
    bounded bytes, hold a Python worker's memory down. Session settings, as plans
    read them when they run; they are only ever lowered."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders and empties the list."""
    while paths:
        remove_path(spark, paths.pop())


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does so
    when the driver collects garbage, which by itself may be half an hour away."""
    spark.sparkContext._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
