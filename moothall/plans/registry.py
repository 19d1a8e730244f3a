"""The catalogue of runnable queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL where one exists."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One of few files and at most SPREAD_BYTES is dealt to all cores, as text work on it would run in one task."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run portable SQL over the given tables of one scale."""
    tables = ("documents", "labels", "conversations", "events", "embeddings", "benchmark",
              "part", "orders", "lineitem", "pages", "supplier", "customer")
    for name in tables:
        if name in sql and (not sf_dir.startswith("/") or Path(f"{sf_dir}/{name}.parquet").exists()):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
