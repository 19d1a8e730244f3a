"""A corpus pipeline: quality rules, line dedup, near-duplicate groups, decontamination, mixing.

Each stage gets all rows its predecessor kept and returns the columns of `documents`; the last
one returns how many words of each document the mix takes. Each begins by letting go what the
jobs before it left in the driver. Empty tables pass through all stages; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moothall.llm import decontaminate, jaccard, line_runs, mixing, outliers
from moothall.session import durable, let_go, scratch_scope

NEAR_WIDTH, NEAR_PERCENT = 5, 80  # words of a shingle, least similarity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the outlier rule rejects go.

    A null or wordless text fails the base rule; null languages and sources are values like others; repeated rows
    are judged alike.
    """
    let_go(spark)
    return outliers.drop_outliers(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted; a document that had words and has none left goes.

    Rows with a null id or text stay as they are; repeated rows are one place and stay alike.
    """
    let_go(spark)
    cut = line_runs.drop_copies(docs.withColumn("__worded", F.col("text").rlike(line_runs.WORD)))
    kept = cut.filter(~F.coalesce("__worded", F.lit(False)) | F.col("text").rlike(line_runs.WORD))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays, and of rows with the same id and text one.

    Null or wordless texts are similar to nothing. A row without an id is in no group, but of such rows with equal texts
    one stays, too.
    """
    let_go(spark)
    groups = jaccard.group_similar(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT)
    others = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__other")).distinct()
    return _once(docs.join(others, F.col("doc_id") == F.col("__other"), "left_anti"))


def _once(docs: DataFrame) -> DataFrame:
    """One of each set of rows with the same id and text. Only texts of repeated rows meet, as ids and hashes tell them."""
    keyed = docs.withColumn("__body", F.xxhash64("text"))
    repeated = durable(keyed.groupBy("doc_id", "__body").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(
        F.col("doc_id").alias("__doc"), F.col("__body").alias("__same")))
    if repeated.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__body") == F.col("__same"))
    single = keyed.join(repeated, same, "left_anti").select(*docs.columns)
    return single.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; a null text has none, repeated rows go together."""
    let_go(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document that the mix takes.

    A null source is a source, last in order; a null text has no words and is not taken; repeated rows count each.
    """
    let_go(spark)
    return mixing.mixed_sizes(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing_weights)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch_scope(spark) as keep:  # a stage's intermediates go when its result is written
            docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
