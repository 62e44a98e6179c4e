"""Readers and writers: JSON lines, sidecars, images, and the engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, an invalid line fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        return lines.select(F.parse_json("value").alias("entry"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of the files under root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", F.col("modificationTime").alias("modified"), "length")


def hash_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, modified, hash)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.md5("content").alias("hash"))


def read_sidecars(spark: SparkSession, root: str, scored_only: bool = False) -> DataFrame:
    """(path, entry): the JSON text of each sidecar, unwrapped."""
    from ..operators.etl import unwrap

    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    out = files.select(F.col("_metadata.file_path").alias("path"), unwrap(F.col("value")).alias("entry"))
    return out.where(F.get_json_object("entry", "$.score").isNotNull()) if scored_only else out


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the engine's tables with its fixed schema; columns that an older table lacks are null."""
    return spark.read.schema(getattr(schemas, name.upper())).parquet(path)


def write_rules(df: DataFrame, path: str, threshold: int) -> None:
    """Feature or comparison rules under their threshold, which is a partition and is replaced alone."""
    df.withColumn("threshold", F.lit(threshold)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("threshold").parquet(path)


def write_split(split: DataFrame, path: str, widths: dict[str, int] | None = None) -> None:
    """The tall table of vectors, by slot. With the slots' widths, a vector of another length is an error, and nothing is written."""
    for name, width in (widths or {}).items():
        wrong = (F.col("vector_name") == name) & (F.size("vector") != width)
        split = split.withColumn("vector", F.when(wrong, F.raise_error(F.concat(F.lit(f"{name}: length "), F.size("vector").cast("string"), F.lit(f", not {width}"))).cast(split.schema["vector"].dataType)).otherwise(F.col("vector")))
    split.write.mode("overwrite").partitionBy("vector_name").parquet(path)
