"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import ctes, dag_rows, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The fixture views and test tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, made at most once for this query."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name == "dag_rows":
            return dag_rows(self.spark, self.dir)
        if name in ("comparisons", "cyclic", "dag", "images", "prompts", "records", "slots", "tiers"):
            return view(self.spark, self.dir, name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Registers f(Tables) under its name; sql may use the named fixture views."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if views:
                word = "WITH RECURSIVE" if recursive else "WITH"
                body = f"{word} {ctes(*views)}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")
            SQL[f.__name__] = body
        return f

    return register
