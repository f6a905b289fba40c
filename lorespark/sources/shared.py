"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a temporary folder if all tasks run in the driver, else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lorespark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses; deleted when the driver's Python ends."""
    return temporary(spark, f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}")


def temporary(spark: SparkSession, path: str) -> str:
    """The path, to be deleted when the driver's Python ends."""
    _MADE[path] = spark
    return path


def state_of(df: DataFrame) -> str:
    """The files that a DataFrame reads, with their lengths and times of change."""
    out = []
    for name in sorted(df.inputFiles()):
        fs, at = file_system(df.sparkSession, name)
        status = fs.getFileStatus(at)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(out)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, which cuts its lineage and is computed once. Packed by zstd, which takes a third less disk for terms."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what :func:`stored` wrote, once nothing reads it any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        delete(df.sparkSession, path)


def move(df: DataFrame, path: str) -> None:
    """Moves what :func:`stored` wrote to ``path``, in place of what is there."""
    spark = df.sparkSession
    [own] = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    fs, at = file_system(spark, path)
    fs.delete(at, True)
    fs.mkdirs(at.getParent())
    if not fs.rename(file_system(spark, own)[1], at):
        raise OSError(f"{own} can't be moved to {path}")


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _MADE.items():
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            return
