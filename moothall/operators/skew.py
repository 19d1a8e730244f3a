"""Keyed joins and numbering that hold up when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.session import durable

ROWS_PER_SALT = 1_000_000
MOST_COMMON = 50_000


def skew_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
              how: str = "inner", counts: DataFrame | None = None, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Join `big` to `small`, which has one row per key, with hot keys split into salts.

    `counts` holds roughly the rows of `big` per key (columns `on` and `n_rows`), as known from
    building `small`. A key above `rows_per_salt` is cut into as many salts as it needs by a
    hash of the `spread` columns, and its row in `small` is repeated per salt. The table of hot
    keys has at most |big| / rows_per_salt rows, so broadcasting it is safe. Without counts the
    join is left to the adaptive splitting of skewed partitions; counting alone would mean
    computing `big` twice.
    """
    on = list(on)
    if counts is None:
        return big.join(small, on, how)
    salts = F.ceil(F.col("n_rows") / rows_per_salt).cast("long").alias("_salts")
    hot = F.broadcast(counts.filter(F.col("n_rows") > rows_per_salt).select(*on, salts))
    salted_big = big.join(hot, on, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0).cast("long"))).drop("_salts")
    salted_small = small.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")


def common_parts(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], counts: DataFrame,
                 how: str = "left") -> tuple[DataFrame, DataFrame]:
    """The two parts of `common_join`: rows of common keys, which did not move, and all others."""
    on = list(on)
    least = counts.agg(F.coalesce(F.sum("n_rows") / MOST_COMMON, F.lit(0.0))).first()[0]
    near = durable(small.join(F.broadcast(counts.filter(F.col("n_rows") > least).select(*on)), on, "left_semi"))
    rest = big.join(F.broadcast(near.select(*on)), on, "left_anti")
    return big.join(F.broadcast(near), on), skew_join(rest, small, on, spread, how, counts=counts.filter(F.col("n_rows") <= least))


def common_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], counts: DataFrame,
                how: str = "left") -> DataFrame:
    """`skew_join` of a stored `big` in which the rows of common keys do not move.

    Keys with more than a MOST_COMMON-th of all rows are fewer than MOST_COMMON; their rows of `small` are broadcast
    and only the rows of the other keys are shuffled. `big` is read twice, so it should be a table.
    """
    near, rest = common_parts(big, small, on, spread, counts, how)
    return near.unionByName(rest)


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Add a dense row number in global `order`, without a global window.

    The order must be total. The sorted rows are written once; each part of the sort knows
    its own positions, and only the table of part sizes is summed in one place.
    """
    width = 1 << 33  # the room a part has in monotonically_increasing_id
    ordered = durable(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return _dense(ordered, F.floor(F.col("_at") / width), F.col("_at") % width, name, start)


def _dense(df: DataFrame, part: Column, inside: Column, name: str, start: int) -> DataFrame:
    numbered = df.withColumn("_part", part).withColumn("_inside", inside)
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    numbered = numbered.join(F.broadcast(running_total(sizes, "_part", "_size", "_before")), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_inside") + start).drop(
        "_at", "_part", "_inside", "_before")


def running_total(sizes: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """Rows before each key, for a table small by construction (parts or hash buckets).

    One task sums it, as at most one row per part or 65,536 buckets arrive there.
    """
    earlier = W.partitionBy(F.lit(0)).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(key, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(name))
