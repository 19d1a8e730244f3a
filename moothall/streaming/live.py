"""Verdict tallies kept current while comments arrive."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moothall.operators import tally


def live_tally(comments: DataFrame, watermark: str = "1 day", comment: Sequence[str] = ("post_id", "idx"), ts: str = "ts") -> DataFrame:
    """The comments of a stream (post_id, idx, ts, verdict) that count for A1, each once.

    `comment` names the columns that identify a comment; idx is its place within the post. One
    delivered twice within the watermark counts once; one later than the watermark is
    dropped. The only state is the key of each comment, until the watermark has passed it:
    the counts of a post live in the written tables, where `latest` adds them up.
    """
    timed = comments.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return timed.dropDuplicatesWithinWatermark(list(comment))


def run_available(counted: DataFrame, out: str, checkpoint: str) -> int:
    """Process all that has arrived and return the number of rows of state that are held afterwards.

    Each batch's own counts per post form one folder, written again on a retry. A silent post
    costs nothing, and one that wakes up after any time goes on from what was written.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        tally.tally(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (counted.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    progress = query.lastProgress
    return sum(held["numRowsTotal"] for held in progress["stateOperators"]) if progress else 0


def _folders(spark: SparkSession, out: str) -> dict[str, list[int]]:
    """Numbers of the finished folders, `batch` and `upto`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "upto": []}
    for status in system.listStatus(root):
        name = re.fullmatch(r"(batch|upto)=(\d+)", status.getPath().getName())
        if name and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[name[1]].append(int(name[2]))
    return found


def compact(spark: SparkSession, out: str) -> None:
    """Write the current tally as one table; later reads take it and the batches after it."""
    batches = _folders(spark, out)["batch"]
    if batches:
        latest(spark, out).write.mode("overwrite").parquet(f"{out}/upto={max(batches)}")


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The current tally: counts of the last compacted table and of the batches after it, added up per post."""
    found = _folders(spark, out)
    done = max(found["upto"], default=-1)
    paths = [f"{out}/batch={n}" for n in sorted(found["batch"]) if n > done]
    if done >= 0:
        paths.append(f"{out}/upto={done}")
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(path) for path in paths])
    return rows.groupBy("post_id").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "post_id"])
