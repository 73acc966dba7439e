"""Named queries: each an operator run over the driver tables, with its DuckDB counterpart where one is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from figtrail.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables and adapters under one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        if name in fixtures.DRIVER_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        where = {t: f"parquet.`{self.folder}/{t}.parquet`" for t in fixtures.DRIVER_TABLES}
        return self.spark.sql(fixtures.with_adapters(body, "spark", where))


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[name] = fixtures.with_adapters(oracle, "duckdb")
        return fn
    return add
