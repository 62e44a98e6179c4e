"""How stored tables lie: buckets in place of indices, columns added later, files of a fitting size.

A table is bucketed and sorted by the key it is looked up and joined by: a lookup reads one bucket, joins and groups by the key need
no exchange. It is partitioned by columns with few values. Changes of layout are changes of the catalog: a new column is a default that
old files answer with, and a compacted partition is written anew beside the old one, to which its readers keep.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import RANKING, RATING

#: Defaults of the columns of stored tables.
DEFAULTS = {
    "images": {"score": RANKING.default_score, "rating_mu": RATING.mean, "rating_sigma": RATING.deviation, "comparison_count": 0, "ranking_generation": 0},
    "comparisons": {"weight": 1.0, "transitive_depth": 0},
}


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, schema: StructType | str | None = None) -> DataFrame:
    """df as the table `name` at path, one sorted file for each bucket of keys; with a schema, its columns only.

    Null keys are a bucket's rows like others. Rows of one key lie in one file: a key that holds a large part of
    all rows is no key to bucket by (leave that table unbucketed, so that adaptive execution can split the key in joins).
    """
    rows = df if schema is None else df.select(*df.sparkSession.createDataFrame([], schema).columns)
    spread = rows.repartition(buckets, *keys)  # as the buckets hash, so each task writes one
    spread.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def partitioned(df: DataFrame, name: str, path: str, by: list[str]) -> DataFrame:
    """df as the table `name` at path, partitioned by columns of few values."""
    df.write.format("parquet").mode("overwrite").option("path", path).partitionBy(*by).saveAsTable(name)
    return df.sparkSession.table(name)


def append(df: DataFrame, name: str) -> None:
    """Adds rows by column name; columns that df lacks take the table's defaults, or null."""
    columns = [c for c in df.sparkSession.table(name).columns if c in df.columns]
    df.createOrReplaceTempView(view := f"_rows_{uuid.uuid4().hex}")
    listed = ", ".join(map(_quoted, columns))
    try:
        df.sparkSession.sql(f"INSERT INTO {name} ({listed}) SELECT {listed} FROM {view}")
    finally:
        df.sparkSession.catalog.dropTempView(view)


def migrate(spark: SparkSession, name: str, schema: StructType | str, defaults: dict[str, object] | None = None) -> list[str]:
    """Adds the schema's columns that the table lacks, with their defaults, and gives their names; no file is written.

    Rows stored before answer with the default (null where there is none). Columns that the schema lacks stay; a column of the
    same name and another type is an error. A second call adds nothing.
    """
    held = {f.name.lower(): f.dataType for f in spark.table(name).schema}
    added = []
    for f in spark.createDataFrame([], schema).schema:
        if (kind := held.get(f.name.lower())) is None:
            value = (defaults or {}).get(f.name)
            tail = "" if value is None else f" DEFAULT {value!r}"
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({_quoted(f.name)} {f.dataType.simpleString()}{tail})")
            added.append(f.name)
        elif kind != f.dataType:
            raise ValueError(f"{name}.{f.name} is {kind.simpleString()}, not {f.dataType.simpleString()}")
    return added


def file_sizes(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., files, bytes) from the files' metadata; no data column is read. Files without rows do not count."""
    each = table.groupBy(*by, F.col("_metadata.file_path").alias("_file")).agg(F.first("_metadata.file_size").alias("_size"))
    return each.groupBy(*by).agg(F.count("*").alias("files"), F.sum("_size").alias("bytes"))


def files_needed(target: int) -> Column:
    """How many files of `target` bytes a row of file_sizes needs."""
    return F.greatest(F.ceil(F.col("bytes") / target), F.lit(1)).cast("int")


def compact(spark: SparkSession, name: str, path: str, by: str, target: int = 256 << 20) -> int:
    """Rewrites the partitions of `name` that hold more files than their bytes need at `target` each; gives how many.

    Rows that are dealt anew take more or fewer bytes than before, so what was written is measured, and a partition that needs another number of files is
    written again, until it has as many as its own bytes need; where two numbers each ask for the other, it takes the larger one.
    The new files go under path, a folder of their own for each writing; then each partition is pointed to its new folder. Untouched partitions
    keep their files. The old files stay for readers that have begun. The list of crowded partitions is what a catalog holds of them.
    """
    table = spark.table(name)
    sizes = file_sizes(table, [by]).select(by, "files", files_needed(target).alias("_parts")).where("files > _parts").select(by, "_parts")
    wanted, written = {r[0]: r[1] for r in sizes.collect()}, {}
    while wanted:
        folder = f"{path}/compact-{uuid.uuid4().hex}"
        # a partition's rows go to as many files as its bytes need, by a hash of the row; each file is a task of its own, as two in one task would be one file
        starts = accumulate(wanted.values(), initial=0)
        keyed = spark.createDataFrame([(v, n, k) for (v, n), k in zip(wanted.items(), starts)], StructType([*sizes.schema, StructField("_start", IntegerType())])).withColumnRenamed(by, "_by")
        sized = table.join(F.broadcast(keyed), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
        part = (F.col("_start") + F.pmod(F.xxhash64(*table.columns), F.col("_parts"))).cast("int")
        sized.repartitionById(sum(wanted.values()), part).drop("_parts", "_start").write.partitionBy(by).parquet(folder)
        found = file_sizes(spark.read.schema(table.schema).parquet(folder), [by]).select(by, files_needed(target))
        again = {}
        for value, needs in found.collect():
            tried = written.setdefault(value, {})
            tried[wanted[value]] = folder
            if needs not in tried:
                again[value] = needs
            else:
                written[value] = {max(needs, wanted[value]): tried[max(needs, wanted[value])]}
        wanted = again
    for value, folders in written.items():
        (folder,) = folders.values()
        place = "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)
        spec = "null" if value is None else f"'{place}'"
        spark.sql(f"ALTER TABLE {name} PARTITION ({_quoted(by)} = {spec}) SET LOCATION '{folder}/{by}={place}'")
    if written:
        spark.catalog.refreshTable(name)
    return len(written)
