"""Snapshots of tables in numbered folders; the newest whole one can be restored."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def backup(spark: SparkSession, tables: dict[str, DataFrame], root: str, keep: int = 3) -> int:
    """Writes all tables as the next version, their row counts last, and drops all but the newest ``keep``."""
    found = versions(spark, root)
    version = (found[-1] if found else 0) + 1
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/v={version}/{name}")
        counts[name] = spark.read.parquet(f"{root}/v={version}/{name}").count()
    spark.createDataFrame([(json.dumps(counts),)], "value string").coalesce(1).write.text(f"{root}/v={version}/_counts")
    for old in [*found, version][:-keep]:
        fs, at = _fs(spark, f"{root}/v={old}")
        fs.delete(at, True)
    return version


def intact(spark: SparkSession, root: str, version: int) -> bool:
    """Whether the version was finished and every table has its rows."""
    fs, at = _fs(spark, f"{root}/v={version}/_counts/_SUCCESS")
    if not fs.exists(at):
        return False
    counts = json.loads(spark.read.text(f"{root}/v={version}/_counts").first()["value"])
    for name, n in counts.items():
        fs, at = _fs(spark, f"{root}/v={version}/{name}")
        if not fs.exists(at) or spark.read.parquet(f"{root}/v={version}/{name}").count() != n:
            return False
    return True


def restore(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest intact version; none if there is none."""
    for version in reversed(versions(spark, root)):
        if intact(spark, root, version):
            counts = json.loads(spark.read.text(f"{root}/v={version}/_counts").first()["value"])
            return {name: spark.read.parquet(f"{root}/v={version}/{name}") for name in counts}
    return {}
