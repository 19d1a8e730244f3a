"""Scans (S1-S7) over post files, delimited text, JSON lines and archived submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moothall.functions.text import map_label, readable_json, safe_key, strip
from moothall.operators.skew import number_rows
from moothall.session import durable

# ---- fixed values: class counts of the labelled corpora ----
CLASS_COUNTS = {"dbpedia14": 14, "ag_news": 4, "imdb": 2, "yelp": 2, "mnli": 3}
LABELLED_SCHEMA = "label int, title string, sentence string"
FIRST_DAY, LAST_DAY = "2012-01-01", "2021-12-31"
# ---- end of fixed values ----


def read_post_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per post file: title, author, body, trees, link.

    Sections are lines: title, author, the body's lines, the JSON trees, the link. Body
    lines are joined by a newline and a blank. Files with under four lines or without a
    readable tree are dropped.
    """
    files = (spark.read.text(path, wholetext=True, recursiveFileLookup=True)
             .select(F.col("_metadata.file_path").alias("file"), "value"))
    text = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\z", "")
    lines = files.select("file", F.split(text, "\n").alias("lines")).filter(F.size("lines") >= 4)
    last = F.size("lines")
    posts = lines.select(
        "file",
        strip(F.get("lines", F.lit(0))).alias("title"),
        F.get("lines", F.lit(1)).alias("author"),
        strip(F.array_join(F.slice("lines", F.lit(3), last - 4), "\n ")).alias("body"),
        strip(F.get("lines", last - 2)).alias("trees"),
        F.get("lines", last - 1).alias("link"),
    )
    return posts.filter(readable_json(F.col("trees")))


def write_post_files(posts: DataFrame, path: str) -> None:
    """The inverse of S1: one file per post, in a folder named by its safe key.

    Tasks move their files into place themselves; the driver would do it one after another at the end.
    """
    lines = F.concat_ws("\n", "title", "author", "body", "trees", "link")
    key = safe_key(F.col("post_id"), F.col("title"))
    posts.select(key.alias("post"), lines.alias("value")).write.option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("post").text(path)


def read_corpus_csv(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",",
                    header: bool = True) -> DataFrame:
    """Delimited text whose quoted fields may hold line breaks and doubled quotes."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, multiLine=True, quote='"', escape='"')


def read_tsv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """S3."""
    return read_corpus_csv(spark, path, schema, sep="\t")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with nested columns; an explicit schema avoids a pass over the data."""
    return spark.read.schema(schema).json(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Headerless label, title, sentence; labels that count from 1 are shifted to 0."""
    rows = read_corpus_csv(spark, path, LABELLED_SCHEMA, header=False)
    return rows.withColumn("label", map_label(F.col("label"), "offset"))


def class_counts(spark: SparkSession) -> DataFrame:
    """Number of classes per labelled corpus."""
    return spark.createDataFrame(list(CLASS_COUNTS.items()), "corpus string, n_classes int")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their zero-based number in the file (line_no) and over all files in path order (row_no).

    A task reads a block of a file front to back, so the order inside a block is known; the
    blocks of a file are then put in order. No line is shuffled. The scan is written once, as
    a second one might cut the files into other blocks.
    """
    lines = durable(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per block of a file: the only table that is summed in one place.
    overall = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", "first", before.alias("before"), overall.alias("overall"))
    inside = F.col("at") - F.col("first")
    return lines.join(starts, ["file", "block"]).select(
        "file", (F.col("before") + inside).alias("line_no"), (F.col("overall") + inside).alias("row_no"), "value")


def zip_by_line(rows: DataFrame, side: DataFrame, on: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """Row i gets line i of the side file; both may be cut into any files."""
    return rows.join(side, list(on))


def select_submissions(df: DataFrame, after: str = FIRST_DAY, before: str = LAST_DAY) -> DataFrame:
    """Submissions of the period by authors still there, numbered from 0 in time order."""
    kept = df.filter(
        (F.col("created_at") >= F.lit(after).cast("timestamp"))
        & (F.col("created_at") <= F.lit(before).cast("timestamp"))
        & (F.col("author") != "[deleted]"))
    columns = ["title", "author", "body", "link"]
    numbered = number_rows(kept.select("created_at", *columns), ["created_at", "link"], "post_id")
    return numbered.select("post_id", *columns)
