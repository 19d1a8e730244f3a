"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.functions.text import GONE, scrub_spoilers


def drop_gone(df: DataFrame, body: str = "body", gone: Sequence[str] = GONE) -> DataFrame:
    """P1 after T1: scrub the body, then drop removed, deleted and empty ones; nulls stay.

    The scrubbed body is generated, not projected, so the filter does not run the scrub again.
    """
    present = df.filter(F.coalesce(F.col(body) != "[removed]", F.lit(True)))
    others = [c for c in df.columns if c != body]
    scrubbed = present.select(*others, F.explode_outer(F.array(scrub_spoilers(F.col(body)))).alias(body))
    scrubbed = scrubbed.select(*df.columns)
    return scrubbed.filter(F.coalesce(~F.col(body).isin(*gone), F.lit(True)))


def keep_agreed(df: DataFrame, scores: str, min_votes: int = 10, least: float = 0.9) -> DataFrame:
    """Keep rows whose struct of RIGHT and WRONG votes is large and one-sided."""
    right, wrong = F.col(f"{scores}.RIGHT"), F.col(f"{scores}.WRONG")
    votes = right + wrong
    return df.filter((votes >= min_votes) & (F.greatest(right, wrong) / votes >= least))


def usable_rows(df: DataFrame, split: str, required: Sequence[str], nonzero: str,
                tags: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """Rows of a known split with all required values and a non-zero judgement, in one scan."""
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in required])
    return df.filter(F.col(split).isin(*tags) & present & (F.col(nonzero) != 0))


def drop_blank(df: DataFrame, column: str) -> DataFrame:
    """P5."""
    return df.filter(F.col(column).isNotNull())


def where_equal(df: DataFrame, column: str, value) -> DataFrame:
    """P6, equality."""
    return df.filter(F.col(column) == value)


def where_contains(df: DataFrame, column: str, value: str) -> DataFrame:
    """P6, containment."""
    return df.filter(F.col(column).contains(value))


def select_named(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project and rename columns by name."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def labelled_only(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """D3."""
    return df.filter(F.col(label).isin(*classes))


def keep_members(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is in the set."""
    return df.join(ids.select(on).distinct(), on, "left_semi")


def drop_members(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose id is not in the set."""
    return df.join(ids.select(on).distinct(), on, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union."""
    return a.union(b).distinct()


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set difference."""
    return a.distinct().join(b.distinct(), list(a.columns), "left_anti")


def stage_counts(**stages: DataFrame) -> DataFrame:
    """A5: one audit row per named stage."""
    rows = [df.groupBy().count().select(F.lit(name).alias("stage"), F.col("count").alias("n_rows"))
            for name, df in stages.items()]
    return reduce(DataFrame.unionByName, rows)
