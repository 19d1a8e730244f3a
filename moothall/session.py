"""Session helpers: durable cuts of lineage and shared scratch paths."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "moothall", **conf) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, under the folder the cluster names.

    Only a local session without any setting falls back to a folder of this machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="moothall-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_scopes: list[list[str]] = []  # paths given out inside each open scope


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written intermediate, unique per call."""
    path = f"{shared_folder(spark)}/written/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the intermediates written inside it at its end.

    What it yields writes a result and reads it from a table that outlives the scope. A result
    that was not kept so must not be used afterwards.
    """
    _scopes.append([])
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "kept")
        _scopes[-1].remove(path)
        kept.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if _scopes:
            _scopes[-1].extend(kept)


def let_go(spark: SparkSession) -> None:
    """Free what finished jobs left in the driver: plans, metrics, broadcasts and their shuffle files."""
    gc.collect()  # the handles of this process
    spark._jvm.System.gc()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it from there.

    Later steps then neither recompute it nor lose it with an executor, and the planner knows
    its size and can read single columns of it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
