"""Per-post verdict tally, agreement, majority and best supporting comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.functions.rules import VERDICTS, extract_verdict

SIDES = {"AUTHOR": 1, "OTHER": 0}


def label_comments(comments: DataFrame, body: str = "body") -> DataFrame:
    """Add the verdict of each comment, null where there is none.

    The rules are costly. Generating the column, instead of projecting it, keeps later
    filters and aggregates from being rewritten to run them again for every use.
    """
    return comments.select("*", F.explode_outer(F.array(extract_verdict(F.col(body)))).alias("verdict"))


def tally(comments: DataFrame, post: str = "post_id") -> DataFrame:
    """A1: labelled comments per post and verdict; counts are combined before the shuffle."""
    labelled = comments.filter(F.col("verdict").isNotNull())
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in VERDICTS]
    return labelled.groupBy(post).agg(F.count(F.lit(1)).alias("n_valid"), *counts)


def agreement(min_comments: int = 10) -> Column:
    """A2: share of the stronger side among all labelled comments, 0 below the minimum."""
    share = F.greatest("n_author", "n_other") / F.col("n_valid")
    return F.when(F.col("n_valid") < min_comments, F.lit(0.0)).otherwise(share)


def majority() -> Column:
    """A3: 1 when strictly more comments blame the author."""
    return F.when(F.col("n_author") > F.col("n_other"), 1).otherwise(0)


def admit(tallied: DataFrame, min_comments: int = 10, least_agreement: float = 0.9) -> DataFrame:
    """Posts with enough labelled comments that agree."""
    scored = tallied.withColumn("agreement", agreement(min_comments)).withColumn("author_wrong", majority())
    return scored.filter((F.col("n_valid") >= min_comments) & (F.col("agreement") >= least_agreement))


def tally_with_support(comments: DataFrame, post: str = "post_id") -> DataFrame:
    """A1 with the best comment of either side, in two aggregations and no join.

    Equal texts of a side count once: the first position and the last score. The better
    comment has the higher score, then the later first position. The text takes part in the
    first grouping key, so a post with very many comments is spread over many tasks.
    """
    labelled = comments.filter(F.col("verdict").isNotNull())
    supporter = F.col("verdict").isin(*SIDES)
    by_text = labelled.groupBy(post, "verdict", F.when(supporter, F.col("body")).alias("body")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("ups", "idx").alias("ups"),
        F.min("idx").alias("pos"),
    )
    columns = [F.sum("n").alias("n_valid")]
    for verdict in VERDICTS:
        of_verdict = F.col("verdict") == verdict
        columns.append(F.sum(F.when(of_verdict, F.col("n")).otherwise(0)).alias(f"n_{verdict.lower()}"))
        if verdict in SIDES:
            # a null order is ignored, so the other side never wins
            order = F.when(of_verdict, F.struct("ups", "pos"))
            columns.append(F.max_by("body", order).alias(f"best_{verdict.lower()}"))
    return by_text.groupBy(post).agg(*columns)


def best_comment(comments: DataFrame, min_comments: int = 10, least_agreement: float = 0.9,
                 post: str = "post_id") -> DataFrame:
    """A4 on admitted posts; posts whose winning side has no supporter are dropped."""
    admitted = admit(tally_with_support(comments, post), min_comments, least_agreement)
    best = F.when(F.col("author_wrong") == 1, F.col("best_author")).otherwise(F.col("best_other"))
    return (admitted.withColumn("best_comment", best)
            .filter(F.col("best_comment").isNotNull())
            .drop("best_author", "best_other"))
