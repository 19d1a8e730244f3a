"""Draws, splits, numbering and salted joins."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from moothall.operators import sampling
from moothall.operators.skew import number_rows, skew_join


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 101, 5000])
def test_split_is_exact_and_ordered_by_hash(spark, n):
    rows = sampling.split_exact(spark.range(n), "id").collect()
    n_test = math.ceil(0.1 * n)
    n_dev = math.ceil(0.1 * (n - n_test))
    ranked = sorted(range(n), key=key)
    expected = {i: "test" if r < n_test else "dev" if r < n_test + n_dev else "train" for r, i in enumerate(ranked)}
    assert {r.id: r.split for r in rows} == expected and len(rows) == n


def test_split_sizes_of_one_hundred_and_one(spark):
    sizes = sampling.split_exact(spark.range(101), "id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sizes} == {"test": 11, "dev": 9, "train": 81}


def test_sample_exact(spark):
    drawn = sampling.sample_exact(spark.range(3000), "id", spark.range(700)).collect()
    assert {r.id for r in drawn} == set(sorted(range(3000), key=key)[:700]) and len(drawn) == 700
    with pytest.raises(Exception, match="larger than the table"):
        sampling.sample_exact(spark.range(5), "id", spark.range(6)).collect()


@pytest.mark.parametrize("mode", ["exact", "parity"])
def test_balance_keeps_all_positives(spark, mode):
    df = spark.range(2000).withColumn("y", F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 7 == 1, None).otherwise(0))
    kept = sampling.balance(df, "id", "y", mode=mode).collect()
    positives = [r.id for r in kept if r.y == 1]
    negatives = [r.id for r in kept if r.y == 0]
    assert sorted(positives) == list(range(0, 2000, 7)) and len(positives) + len(negatives) == len(kept)
    assert len(set(negatives)) == len(negatives)
    assert len(negatives) == len(positives) if mode == "exact" else 0 < len(negatives) < len(positives)


def test_shuffle_positions(spark):
    placed = sampling.hash_position(spark.range(500), "id", 0, "place").collect()
    assert {r.id: r.place for r in placed} == {i: p for p, i in enumerate(sorted(range(500), key=lambda i: key(i, 0)))}


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    rows = number_rows(df, ["k"], "n", start=5).orderBy("k").collect()
    assert [r.n for r in rows] == list(range(5, 1005))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    """A third of the rows share one key, far above the salt size."""
    big = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 200).alias("k"))
    small = spark.range(-1, 150).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
    salted = skew_join(big, small, ["k"], ["id"], how, counts=counts, rows_per_salt=100)
    assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=repr) == sorted(
        map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=repr)
