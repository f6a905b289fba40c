"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}


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


def named(column: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The row as one struct, so that no name of the input can clash with a name that an operator adds."""
    return F.struct(*([named(c).alias(c) for c in df.columns if c not in without] or [F.lit(0).alias("none")]))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The files outlive any executor. They go by :func:`discard`, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorespark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside it send ``most`` rows to a Python worker at a time, or fewer if the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written() -> set[str]:
    """Folders of tables that are still there."""
    return set(_WRITTEN)


def discard(paths: set[str] | list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        if spark := _WRITTEN.pop(path, None):
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def least_hashed(df: DataFrame, by: str, n: int, total: int, tie: str) -> DataFrame:
    """The ``n`` rows of least 64-bit hash ``by`` among about ``total``; fewer if ``by`` takes few values.

    Only rows in the lowest part of the hashes, where 4 ``n`` rows are expected, are sorted, so that all
    tasks together hand on that many rather than ``n`` each.
    """
    bound = -(1 << 63) + min((1 << 64) - 1, 4 * n * (1 << 64) // max(total, 1))
    return df.filter(F.col(by) <= F.lit(bound)).orderBy(by, tie).limit(n)


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            return
