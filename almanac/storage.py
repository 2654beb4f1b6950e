"""Tables in the folder that driver and executors share, and files by way of Spark's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session in one process gets a temporary folder; on a cluster that would
    be another folder on every machine, so there it is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="almanac-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; clean() deletes it."""
    _WRITTEN.append(f"{shared_dir(spark)}/almanac-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> int:
    """How many paths of this process clean() has not deleted: a mark to clean from."""
    return len(_WRITTEN)


def clean(spark: SparkSession, since: int = 0, but_last: bool = False) -> int:
    """Deletes the paths that fresh() has given in this process (``since`` a mark of written(); ``but_last``: the last one stays), once no result needs them any more; returns how many."""
    gone = _WRITTEN[since : len(_WRITTEN) - but_last]
    del _WRITTEN[since : len(_WRITTEN) - but_last]
    for name in gone:
        remove(spark, name)
    return len(gone)


def staged(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, so that all later readings are alike, whatever becomes of its source."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- files of any file system that Spark reads


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def make_private(spark: SparkSession, path: str) -> None:
    """Makes a folder that only its owner may enter, where the file system knows owners."""
    fs, where = _at(spark, path)
    fs.mkdirs(where)
    fs.setPermission(where, spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, in order of name; nothing if there is none."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file; one that is there already is an error."""
    fs, where = _at(spark, path)
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())
