"""Sinks, idempotent shards, cached intermediates, resume and quarantine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.functions.text import readable_json
from moothall.session import durable

SEPARATOR = "-" * 20


def finished(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to `path` was committed."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split: str = "split", mini: DataFrame | None = None) -> None:
    """All splits in one pass, a folder per split; `mini` holds a small slice of its own, without the split column."""
    if mini is not None:
        df = df.unionByName(mini.withColumn(split, F.lit("mini")))
    writer = df.write.partitionBy(split).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def write_pairs(df: DataFrame, path: str, original: str = "original", result: str = "result") -> None:
    """Append original and changed text, with separators; unsuccessful rows are left out."""
    lines = F.concat_ws("\n", original, F.lit(SEPARATOR), result, F.lit(SEPARATOR), F.lit(SEPARATOR))
    df.filter(F.col(result).isNotNull()).select(lines.alias("value")).write.mode("append").text(path)


MANIFEST = "run string, shard bigint, first bigint, last bigint"


def _finished_ranges(spark: SparkSession, out: str) -> DataFrame:
    """Row ranges (run, shard, first, last) whose output is committed."""
    if finished(spark, f"{out}/manifest"):
        return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return spark.createDataFrame([], MANIFEST)


def run_shards(df: DataFrame, shard_size: int, fn: Callable[[DataFrame], DataFrame], out: str,
               row_no: str = "row_no", start: int = 0) -> None:
    """Run `fn` over the rows not yet done, in row ranges of `shard_size`.

    The manifest names the row ranges of each shard that are done, after their output is
    committed. Rows that come later for a shard, or lie before the `start` of an earlier run,
    are run then; output of a broken attempt is in no manifest and never read.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(row_no) >= start)
    if rows.isEmpty():
        raise ValueError(f"start {start} is beyond the last row")
    sharded = rows.withColumn("shard", F.floor(F.col(row_no) / shard_size))
    done = _finished_ranges(spark, out).withColumnRenamed("shard", "_shard")
    pending = sharded.join(done, (F.col("shard") == F.col("_shard")) & F.col(row_no).between(F.col("first"), F.col("last")), "left_anti")
    in_order = W.partitionBy("shard").orderBy(row_no)  # at most shard_size rows
    stretches = pending.select("shard", F.col(row_no).alias("_row"), (F.col(row_no) - F.row_number().over(in_order)).alias("_stretch"))
    ranges = durable(stretches.groupBy("shard", "_stretch").agg(F.min("_row").alias("first"), F.max("_row").alias("last")))
    if ranges.isEmpty():
        return
    run = uuid.uuid4().hex
    fn(pending).write.partitionBy("shard").parquet(f"{out}/data/shard_run={run}")
    ranges.select(F.lit(run).alias("run"), "shard", "first", "last").write.mode("append").parquet(f"{out}/manifest")


def read_shards(spark: SparkSession, out: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the finished ranges of shards in [first, last), and the shards without any."""
    done = _finished_ranges(spark, out)
    wanted = spark.range(first, last).select(F.col("id").alias("shard"))
    data = spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data").withColumn("shard", F.col("shard").cast("long"))
    rows = data.filter(F.col("shard").between(first, last - 1)).join(
        done.select(F.col("run").alias("shard_run")).distinct(), "shard_run", "left_semi")
    return rows.drop("shard_run"), wanted.join(done, "shard", "left_anti")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Compute and write once, read afterwards; an unfinished write is done again."""
    spark = df.sparkSession
    if not finished(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume_after(df: DataFrame, done: DataFrame, counter: str = "post_id", name: str = "name") -> DataFrame:
    """Rows numbered above every finished name; names without a number are passed over."""
    mark = done.agg(F.max(F.split(name, "_")[0].try_cast("long")).alias("mark"))
    return df.filter(F.col(counter) > F.coalesce(mark.scalar(), F.lit(-1)))


def split_valid(df: DataFrame, json: str = "trees", link: str = "link") -> tuple[DataFrame, DataFrame]:
    """Rows with at least one readable comment, and each unreadable link once."""
    readable = readable_json(F.col(json))
    n_comments = F.coalesce(F.json_array_length(json), F.lit(0))
    good = df.filter(readable & (n_comments > 0))
    bad = df.filter(~readable).select(link).distinct()
    return good, bad
