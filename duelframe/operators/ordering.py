"""Dense numbers for the rows of a table in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch


def dense_order(df: DataFrame, *order: str | Column, name: str = "nth") -> DataFrame:
    """df, written, with a long from 0 that follows the order given; rows that the order leaves equal come in any order.

    One range exchange and a sort within its partitions; each row's place is written with it, one count per partition goes to the
    driver and comes back as a broadcast table of where partitions start.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = scratch(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_mid", 33)
    starts, total = [], 0
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += n
    table = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    return placed.join(table, part == F.col("_part")).withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_start")
