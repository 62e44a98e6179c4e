"""State by key: ratings and recent names that live in map state, and tables that streams write.

A key's state is a map of which a micro-batch reads and writes only the names that it holds; ratings are keyed by a component of the graph, names
by group and a salt, so that no key stands for a whole stream. Results go to a table in the shared folder, batch by batch, and never through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import RANKING, RATING
from ..functions.rating_math import update
from ..operators import rating
from ..scratch import scratch, shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Ratings(StatefulProcessor):
    """Ratings of one component: a map from name to mean, deviation and count."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("ratings", "name string", "mu double, sigma double, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["id", "winner", "loser"])
        known: dict[str, tuple] = {}
        for name in set(batch["winner"]) | set(batch["loser"]):
            known[name] = self.held.getValue((name,)) if self.held.containsKey((name,)) else (RATING.mean, RATING.deviation, 0)
        for w, lo in zip(batch["winner"], batch["loser"], strict=True):
            a, b = known[w], known[lo]
            new_a, new_b = update((a[0], a[1]), (b[0], b[1]))
            known[w], known[lo] = (*new_a, a[2] + 1), (*new_b, b[2] + 1)
        for name, value in known.items():
            self.held.updateValue((name,), (float(value[0]), float(value[1]), int(value[2])))
        yield pd.DataFrame([(str(key[0]), n, v[0], v[1], int(v[2])) for n, v in known.items()], columns=["component", "filename", "mu", "sigma", "n"])

    def close(self) -> None:
        pass


class Recent(StatefulProcessor):
    """The latest names of one key by an order; beyond `most`, all but the newest `kept` go."""

    def __init__(self, most: int, kept: int):
        self.most, self.kept = most, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "name string", "place long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.names.iterator()}
        before = dict(held)
        for pdf in rows:
            for name, place in pdf.groupby("name")["place"].max().items():
                held[name] = max(int(place), held.get(name, int(place)))
        if len(held) > self.most:
            held = dict(sorted(held.items(), key=lambda x: (-x[1], x[0]))[: self.kept])
        for name in before.keys() - held.keys():
            self.names.removeKey((name,))
        for name, place in held.items():
            if before.get(name) != place:
                self.names.updateValue((name,), (place,))
        order = sorted(held.items(), key=lambda x: (-x[1], x[0]))
        yield pd.DataFrame({"pool": [key[0]], "salt": [int(key[1])], "names": [[n for n, _ in order]], "places": [[p for _, p in order]]})

    def close(self) -> None:
        pass


def keyed_ratings(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """(component, filename, mu, sigma, n) of the images that a micro-batch changes, for a stream (id, winner, loser).

    labels (node, component) is a static table that covers the stream's images; components are rated apart from each other. Within a
    micro-batch comparisons apply by id. Rows of images without a label are left out.
    """
    own = labels.select(F.col("node").alias("winner"), "component")
    rows = stream.select("id", "winner", "loser").where("winner <> loser").join(own, "winner").select("component", "id", "winner", "loser")
    return rows.groupBy("component").transformWithStateInPandas(Ratings(), "component string, filename string, mu double, sigma double, n long", "Update", "None")


def rate_to_table(stream: DataFrame, labels: DataFrame, checkpoint: str, path: str | None = None) -> DataFrame:
    """The table (filename, mu, sigma, n, batch) of the images that each micro-batch has changed, for a stream and labels as in keyed_ratings.

    For streams over very many components, where a call for each would cost more than its work: the state is the table itself. A micro-batch joins its
    names with what earlier batches have left of them, and components are folded one after another in each task. A batch that is repeated
    reads only earlier ones and replaces itself; started again with the same checkpoint and path, it goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-ratings-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = "filename string, mu double, sigma double, n long, batch long"
    own = labels.select("node", "component")

    def put(batch: DataFrame, k: int) -> None:
        rows = batch.select(F.col("id").alias("nth"), "winner", "loser").where("winner <> loser").join(own, F.col("winner") == F.col("node")).select("component", "nth", "winner", "loser")
        rows, known = scratch(rows, "duels"), None
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            at = rows.select(F.explode(F.array("winner", "loser")).alias("filename"), "component").groupBy("filename").agg(F.min("component").alias("component"))
            before = spark.read.schema(schema).parquet(path).where(F.col("batch") < k).join(at.select("filename"), "filename", "left_semi")
            known = latest(before, "filename").join(at, "filename").select("component", "filename", "mu", "sigma", "n")
        rating._folded(rows, known).write.mode("overwrite").parquet(f"{path}/batch={k}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path)


def keyed_recent(stream: DataFrame, pool: str, name: str, place: str, most: int = RANKING.recent_items, trim: float = 0.75, salts: int = 16) -> DataFrame:
    """(pool, salt, names, places): of each pool and share of names, the latest by `place`, the newest first, after each micro-batch.

    A key that has more than `most` names keeps the newest `trim` of them. Names fall to one of `salts` keys by their hash, so a hot pool is many keys;
    recent_names puts a pool's keys together.
    """
    rows = stream.select(F.col(pool).cast("string").alias("pool"), F.pmod(F.xxhash64(name), F.lit(salts)).cast("int").alias("salt"), F.col(name).cast("string").alias("name"), F.col(place).cast("long").alias("place")).where("name is not null and pool is not null")
    state = Recent(most, max(1, int(most * trim)))
    return rows.groupBy("pool", "salt").transformWithStateInPandas(state, "pool string, salt int, names array<string>, places array<long>", "Update", "None")


def recent_names(table: DataFrame, most: int) -> DataFrame:
    """(pool, recent): the latest `most` names of each pool, from what keyed_recent has written (with its batch)."""
    last = table.groupBy("pool", "salt").agg(F.max_by(F.arrays_zip("names", "places"), "batch").alias("rows"))
    rows = last.select("pool", F.explode("rows").alias("r")).select("pool", F.struct((-F.col("r.places")).alias("place"), F.col("r.names").alias("name")).alias("x"))
    return rows.groupBy("pool").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("x")).select("pool", F.transform("x", lambda x: x["name"]).alias("recent"))  # at most `most` names a salt


def stream_to_table(stream: DataFrame, checkpoint: str, path: str | None = None, mode: str = "update") -> DataFrame:
    """The table (with a column batch) that a stream over what is there now has written; a batch that is repeated after a failure replaces itself.

    Nothing but batch numbers reaches the driver. Started again with the same checkpoint and path, it goes on where it stopped.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-table-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def latest(table: DataFrame, *keys: str) -> DataFrame:
    """Each key's row of the last batch that has one."""
    rest = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
