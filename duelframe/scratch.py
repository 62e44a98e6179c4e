"""Tables for intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, as in tests, a folder of this process, which only local runs can share."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or "local-cluster" in spark.conf.get("spark.master", "local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="duelframe-"))
    return f"file://{_OWN[0]}"


def scratch(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read back: evaluated once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that scratch has returned; for when nothing reads them any more."""
    for t in tables:
        names = {f.rsplit("/", 2)[1] for f in t.inputFiles()}
        for path in [p for p in _WRITTEN if p.rsplit("/", 1)[1] in names]:
            _WRITTEN.remove(path)
            _delete(t.sparkSession, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries made within go when these have ended, not when the driver's heap is next cleaned.

    For results that are written or collected; a DataFrame made within and evaluated twice would shuffle twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that this process has written; for when no result that reads them is needed any more."""
    n = 0
    while _WRITTEN:
        n += _delete(spark, _WRITTEN.pop())
    return n
