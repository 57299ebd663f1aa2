"""One place for queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.operators.sequences import ROWS_A_TASK
from proofline.sources.files import bucketed_table, scratch_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str, kept: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.folder, self.kept = spark, folder, kept

    def shared(self) -> Tables:
        """The same tables for several queries that are run as one: what they derive alike is written once."""
        return self if self.kept is not None else Tables(self.spark, self.folder, {})

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """make(), and for shared tables what it gave the first time, from the shared folder."""
        if self.kept is None:
            return make()
        if name not in self.kept:
            self.kept[name] = scratch_table(make(), name)
        return self.kept[name]

    def once_by(self, name: str, source: Callable[[], DataFrame], column: str, make: Callable[[DataFrame], DataFrame], key: str, rows: Callable[[], int]) -> DataFrame:
        """make(source()), where make gives key to column; for shared tables as once, in buckets of key.

        There is a bucket for each ROWS_A_TASK of the rows, and one for each core at least, so that queries by key need no
        shuffle and what their tasks hold does not grow with the table.
        """
        if self.kept is None:
            return make(source())
        if name not in self.kept:
            buckets = max(self.spark.sparkContext.defaultParallelism, -(-rows() // ROWS_A_TASK))
            self.kept[name] = bucketed_table(make(source().repartition(buckets, column)), name, key, buckets)
        return self.kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers f(tables) under its name; sql is the twin."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[key] = sql
        return f

    return put
