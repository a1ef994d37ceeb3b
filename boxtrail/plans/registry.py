"""Registers queries: a name, a function of the fixture tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxtrail.sources.fixtures import duck, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables(dict):
    """The fixture tables of one scale, with the session and its folder: plans over the given tables, nothing is written.

    Detections and clips lie by video, like a camera's rows in one file: steps by video, track or frame need no exchange.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # rows that lie by video are joined by frame where they lie
        super().__init__(tables(spark, sf_dir))
        self.spark, self.sf_dir = spark, sf_dir
        self.replayed = 0  # rows of the streams of a query


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return register
