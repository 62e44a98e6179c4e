"""Components and extremes of a graph that grows batch by batch, kept as deltas.

A node keeps the label that it got with its first link. Where a batch joins components, one row for each label that ends says what it is now; so what a batch
writes follows the batch, not the graph. Tops and bottoms come from counts of wins and losses, a row for each node that a batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch
from .graph import components, universe

_TABLES = {"nodes": "node string, label string", "aliases": "old string, new string", "counts": "node string, wins long, losses long"}


class GrowingGraph:
    """The tables of one graph in a shared folder, each with a partition for every batch.

    A batch is applied by its number and reads only earlier ones; applied again, as after a failure, it replaces itself. So apply() can be what a stream
    calls for each of its micro-batches. Labels are the smallest node of a component. Nulls and links of a node to itself are left out.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, before: int | None) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], _TABLES[name])
        df = self.spark.read.schema(f"{_TABLES[name]}, batch int").parquet(f"{self.folder}/{name}")
        return (df if before is None else df.where(F.col("batch") < before)).drop("batch")

    def _write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _aliases(self, before: int | None) -> DataFrame:
        """(old, new): each label that has ended and what it is now, chains of them followed by doubling."""
        now = scratch(self._read("aliases", before), "aliases")
        while True:
            ahead = now.select(F.col("old").alias("new"), F.col("new").alias("further"))
            next_ = scratch(now.join(ahead, "new", "left").select("old", F.coalesce("further", "new").alias("new"), F.col("further").isNotNull().alias("moved")), "aliases")
            now = next_.select("old", "new")
            if next_.where("moved").isEmpty():
                return now

    def apply(self, batch: DataFrame, number: int) -> None:
        """Adds links (winner, loser)."""
        links = scratch(batch.select("winner", "loser").where("winner <> loser").distinct(), "batch")
        old = universe(links).join(self._read("nodes", number), "node", "left")
        at = old.join(self._aliases(number), F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label", "node").alias("root"), F.col("label").isNull().alias("fresh"))
        at = scratch(at, "touched")
        w, lo = at.select(F.col("node").alias("winner"), F.col("root").alias("w")), at.select(F.col("node").alias("loser"), F.col("root").alias("l"))
        bridges = scratch(links.join(w, "winner").join(lo, "loser").where("w <> l").select(F.col("w").alias("winner"), F.col("l").alias("loser")).distinct(), "bridges")
        moved = scratch(components(None, bridges).where("node <> component").select(F.col("node").alias("root"), "component"), "moved")
        self._write("nodes", number, at.where("fresh").join(moved, "root", "left").select("node", F.coalesce("component", "root").alias("label")))
        self._write("aliases", number, moved.join(at.where("not fresh").select("root"), "root", "left_semi").select(F.col("root").alias("old"), F.col("component").alias("new")))
        sides = links.select(F.col("winner").alias("node"), F.lit(1).cast("long").alias("wins"), F.lit(0).cast("long").alias("losses")).union(links.select("loser", F.lit(0).cast("long"), F.lit(1).cast("long")))
        self._write("counts", number, sides.groupBy("node").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses")))

    def labels(self) -> DataFrame:
        """(node, component)."""
        return self._read("nodes", None).join(self._aliases(None), F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("component"))

    def extremes(self) -> DataFrame:
        """(node, is_top, is_bottom): never lost, never won."""
        return self._read("counts", None).groupBy("node").agg((F.sum("losses") == 0).alias("is_top"), (F.sum("wins") == 0).alias("is_bottom"))
