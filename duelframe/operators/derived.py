"""Derived tables and models that are rebuilt only when something they are made of has changed.

A store is a shared folder with the tables, the models, and a record for each build: name, fingerprint, path, rows and metrics. The fingerprint of a build is a
digest of its inputs' contents, its parameters and its version; a build whose latest record has the same one is read, not made.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = "name string, fingerprint string, path string, content string, rows long, metrics string, at double"


def content(df: DataFrame) -> tuple[str, int]:
    """(a digest of names, types and rows, whatever their order; their number): one pass that sums two hashes of each row."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if f.dataType.simpleString().startswith(("map", "variant")) else F.col(f"`{f.name}`") for f in df.schema]
    hashes = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")) for k in range(2)]
    r = df.agg(F.count("*"), *hashes).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest(), int(r[0])


@dataclass
class Store:
    """Derived tables in a shared folder. built: the names that this object has made, in order, not those it has read."""

    spark: SparkSession
    folder: str
    built: list[str] = field(default_factory=list)

    def _records(self) -> DataFrame | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/records")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema(_RECORD).parquet(f"{self.folder}/records")

    def latest(self, name: str):
        """The last record of a name, or None."""
        found = self._records()
        return None if found is None else found.where(F.col("name") == name).orderBy(F.desc("at")).first()

    def fingerprint(self, inputs: dict[str, DataFrame | str], params: dict, version: str = "1") -> str:
        """A digest; an input is a table, whose content counts, or the name of a derived table, whose last content does."""
        parts = {}
        for name, given in sorted(inputs.items()):
            if isinstance(given, str):
                record = self.latest(given)
                if record is None:
                    raise ValueError(f"nothing is derived under {given}")
                parts[name] = record.content
            else:
                parts[name] = content(given)[0]
        return hashlib.sha256(json.dumps([parts, params, version], sort_keys=True, default=str).encode()).hexdigest()

    def _note(self, name: str, fingerprint: str, path: str, digest: str, rows: int, metrics: dict) -> None:
        row = [(name, fingerprint, path, digest, rows, json.dumps(metrics, sort_keys=True), time.time())]
        self.spark.createDataFrame(row, _RECORD).coalesce(1).write.mode("append").parquet(f"{self.folder}/records")
        self.built.append(name)

    def table(self, name: str, inputs: dict[str, DataFrame | str], make: Callable[..., DataFrame], params: dict | None = None, version: str = "1") -> DataFrame:
        """make(**inputs, **params) as a table of the store; derived inputs are given as their tables.

        It is written under a new path before its record, so a build that fails leaves what was there. A rebuild that gives the same rows
        keeps the content's digest, and so what depends on it stays.
        """
        params = params or {}
        wanted = self.fingerprint(inputs, params, version)
        known = self.latest(name)
        if known is not None and known.fingerprint == wanted:
            return self.spark.read.parquet(known.path)
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        make(**{k: self.read(v) if isinstance(v, str) else v for k, v in inputs.items()}, **params).write.parquet(path)
        out = self.spark.read.parquet(path)
        self._note(name, wanted, path, *content(out), {})
        return out

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.latest(name).path)

    def model(self, name: str, inputs: dict[str, DataFrame | str], fit: Callable, kind: type, params: dict | None = None, version: str = "1"):
        """(the model, its metrics): fit(**inputs, **params) gives both; kept under the store, and loaded by kind.load while nothing has changed."""
        params = params or {}
        wanted = self.fingerprint(inputs, params, version)
        known = self.latest(name)
        if known is not None and known.fingerprint == wanted:
            return kind.load(known.path), json.loads(known.metrics)
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        model, metrics = fit(**{k: self.read(v) if isinstance(v, str) else v for k, v in inputs.items()}, **params)
        model.save(path)
        self._note(name, wanted, path, hashlib.sha256(path.encode()).hexdigest(), 0, metrics)
        return kind.load(path), metrics
