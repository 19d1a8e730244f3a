"""Deterministic sampling, balancing and exact splits.

Every draw orders rows by md5(seed:id), so a result depends on the ids and the seed alone.
An exact size needs the key at a given rank. A histogram of the keys tells which bucket it lies
in and only that bucket is ranked; then each row is placed by comparing its own key, so full
rows are neither sorted nor shuffled. The id must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.operators.skew import running_total
from moothall.session import durable

BUCKET_DIGITS = 4  # hexadecimal digits, 65,536 buckets
LAST_KEY = "~"  # after every hexadecimal key
SPLITS = ("test", "dev", "train")


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _bucketed(df: DataFrame, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their key and bucket, and the rows before each of the 65,536 buckets at most."""
    keyed = df.withColumn("_key", order_key(id_col, seed)).withColumn(
        "_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sizes = durable(keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")))
    return keyed, running_total(sizes, "_bucket", "_size", "_before").join(sizes, "_bucket")


def cut_by_hash(df: DataFrame, id_col: str, seed: int, cuts_of: Callable[[int], Sequence[int]],
                name: str = "part") -> DataFrame:
    """Add the number of cuts before a row's rank in hash order.

    `cuts_of` turns the number of rows into ascending cuts: part 0 holds exactly the first
    cuts[0] rows, part 1 the next cuts[1] - cuts[0], and so on. Only the keys at the cuts reach
    the driver.
    """
    keyed, buckets = _bucketed(df, id_col, seed)
    n = buckets.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    cuts = list(cuts_of(n))
    inner = sorted({c for c in cuts if 0 < c < n})
    key_at = {}
    if inner:
        spots = buckets.withColumn("_cut", F.explode(F.array(*[F.lit(c) for c in inner]))).filter(
            (F.col("_before") < F.col("_cut")) & (F.col("_cut") <= F.col("_before") + F.col("_size")))
        ranked = keyed.select("_key", "_bucket").join(F.broadcast(spots), "_bucket").withColumn(
            "_rank", F.col("_before") + F.row_number().over(W.partitionBy("_bucket", "_cut").orderBy("_key")))
        key_at = {r["_cut"]: r["_key"] for r in ranked.filter("_rank = _cut").collect()}
    bounds = [key_at.get(c, "" if c <= 0 else LAST_KEY) for c in cuts]
    place = sum((F.when(order_key(id_col, seed) > bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    return df.withColumn(name, place)


def _first_rows(df: DataFrame, id_col: str, seed: int, size_of: Callable[[int], int]) -> DataFrame:
    return cut_by_hash(df, id_col, seed, lambda n: [size_of(n)], "_part").filter("_part = 0").drop("_part")


def sample_exact(df: DataFrame, id_col: str, like: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows, without replacement, as `like` has; an error if there are too few."""
    wanted = like.count()

    def size_of(n: int) -> int:
        if wanted > n:
            raise ValueError("the sample is larger than the table")
        return wanted

    return _first_rows(df, id_col, seed, size_of)


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """floor(fraction * n) rows without replacement."""
    return _first_rows(df, id_col, seed, lambda n: floor(n * fraction))


def balance(df: DataFrame, id_col: str, label: str, seed: int = 42, mode: str = "exact",
            positive=1, negative=0) -> DataFrame:
    """All positives and a draw of negatives; rows of neither class are left out (D3).

    `exact` draws as many negatives as there are positives. `parity` draws once per positive
    with replacement and keeps the distinct rows, so fewer negatives remain.
    """
    positives, negatives = df.filter(F.col(label) == positive), df.filter(F.col(label) == negative)
    if mode == "exact":
        n_positive = positives.count()
        kept = _first_rows(negatives, id_col, seed, lambda n: n_positive)
    elif mode == "parity":
        numbered = hash_position(negatives, id_col, seed, "_no")
        n = negatives.groupBy().agg(F.count(F.lit(1)).alias("_n"))
        draw = F.conv(F.substring(order_key(id_col, seed + 1), 1, 15), 16, 10).cast("long")
        drawn = positives.select(F.pmod(draw, n.scalar()).alias("_no")).distinct()
        kept = numbered.join(drawn, "_no", "left_semi").drop("_no")
    else:
        raise ValueError(f"unknown mode {mode}")
    return positives.unionByName(kept)


def hash_position(df: DataFrame, id_col: str, seed: int, name: str) -> DataFrame:
    """The zero-based place of each row in the shuffled order."""
    keyed, buckets = _bucketed(df, id_col, seed)
    within = F.row_number().over(W.partitionBy("_bucket").orderBy("_key"))
    joined = keyed.join(F.broadcast(buckets.drop("_size")), "_bucket")
    return joined.withColumn(name, F.col("_before") + within - 1).select(*df.columns, name)


def shuffle(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Rows in hash order."""
    return df.orderBy(order_key(id_col, seed))


def split_exact(df: DataFrame, id_col: str, test: float = 0.1, dev: float = 0.1, seed: int = 42,
                name: str = "split") -> DataFrame:
    """Test takes ceil(test * n) rows, dev ceil(dev * rest), train what is left."""

    def cuts_of(n: int) -> list[int]:
        n_test = ceil(n * test)
        return [n_test, n_test + ceil((n - n_test) * dev)]

    names = F.array(*[F.lit(s) for s in SPLITS])
    parted = cut_by_hash(df, id_col, seed, cuts_of, "_part")
    return parted.withColumn(name, F.get(names, F.col("_part"))).drop("_part")


def split_by_tag(df: DataFrame, column: str, tags=("train", "dev", "test")) -> dict[str, DataFrame]:
    """One frame per tag."""
    return {tag: df.filter(F.col(column) == tag) for tag in tags}


def first_n(df: DataFrame, key: Column | str, n: int) -> DataFrame:
    """The first rows in the order of `key`."""
    return df.orderBy(key).limit(n)
