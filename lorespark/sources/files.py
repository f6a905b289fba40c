"""Files as sources: uploads that are accepted, and folders of Markdown read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import FORMATS, file_format
from lorespark.operators.store import natural_key

EXTENSIONS = sorted(e for exts in FORMATS.values() for e in exts.split())


def listed(spark: SparkSession, path: str) -> DataFrame:
    """File names and sizes below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("path").alias("original_path"), "length")


def accept(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Pending sources for files of a known extension whose name no source has; of files of one name the least path."""
    known = F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1)).isin(EXTENSIONS)
    one = files.filter(known).groupBy("file_name").agg(F.min("original_path").alias("original_path"))
    new = one.join(sources.select("file_name"), "file_name", "left_anti")
    return new.select(natural_key(F.col("file_name")).alias("source_id"), "file_name", "original_path", file_format(F.col("file_name")).alias("format"), F.lit("pending").alias("status"))


def seed(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """Texts of the ``*.md`` files of a folder that aren't sources yet, one row per file."""
    texts = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    return texts.join(sources.select("file_name"), "file_name", "left_anti").select(natural_key(F.col("file_name")).alias("source_id"), "file_name", "text")
