"""Distances of id sequences, word importance by any scorer, and the first flip."""

import random

import pytest
from pyspark.sql import functions as F

from moothall.operators import audit


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_id_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice([1, 2, 3, "x", None]) for _ in range(rng.randrange(90))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.9]
        assert audit.id_distance(a, b) == plain_distance(a, b)


def test_long_id_sequences_take_seconds():
    rng = random.Random(2)
    a = [rng.randrange(5000) for _ in range(20_000)]
    b = list(a)
    for k in range(0, 20_000, 100):
        b[k] = -1
    assert audit.id_distance(a, b) == 200


def test_token_error_of_odd_rows(spark):
    rows = [(1, [1, 2, 3], [1, 3]), (2, [], [1]), (3, None, [1]), (4, [1], None), (5, [1, None], [1, None]), (6, [7], [])]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    found = {r.i: r.e for r in df.select("i", audit.token_error(F.col("a"), F.col("b")).alias("e")).collect()}
    assert found == {1: pytest.approx(1 / 3), 2: None, 3: None, 4: None, 5: 0.0, 6: 1.0}


@pytest.mark.parametrize("how", ["delete", "unknown"])
def test_importance_in_the_task_equals_the_table_of_variants(spark, monkeypatch, how):
    monkeypatch.setattr(audit, "VARIANT_BYTES", 40)
    texts = spark.createDataFrame([(1, "a bb  ccc bb"), (2, ""), (3, None), (4, "one"), (5, "e " * 50)], "i long, t string")
    wrapped = audit.batch_scorer(lambda batch: [[3.0, len(t) - t.count("b") * 2.5] for t in batch])

    def plain(df, keys, text):
        return wrapped(df.filter(F.col(text).isNotNull()), keys, text)

    in_task = audit.word_importance(texts, wrapped, "i", "t", how)
    by_table = audit.word_importance(texts, plain, "i", "t", how)
    assert sorted(map(tuple, in_task.collect())) == sorted(map(tuple, by_table.select(*in_task.columns).collect()))
    assert in_task.count() == 5 + 1 + 1 + 51


def test_first_flip_tries_few_candidates(spark):
    texts = spark.createDataFrame([(k, f"the x{k} day") for k in range(20)] + [(99, "no target")], "i long, t string")
    masked = spark.createDataFrame([(k, f"x{k}", "the <mask> day") for k in range(20)], "i long, phrase string, masked string")
    cands = spark.createDataFrame([(k, f"x{k}", r + 1, f"w{r}") for k in range(20) for r in range(40)], "i long, phrase string, rank int, word string")
    scored = []
    wrapped = audit.batch_scorer(lambda batch: [[0.5, 1.0 if any(t.split(" ")[1] == f"w{r}" for r in (2, 9, 30)) else 0.0] for t in batch])

    def scorer(df, keys, text):
        scored.append(df.count())
        return wrapped(df, keys, text)

    found = {r.i: (r.clean, r.phrase, r.word, r.changed) for r in audit.first_flip(texts, masked, cands, scorer, "i", "t").collect()}
    assert found == {k: (0, f"x{k}", "w2", "the w2 day") for k in range(20)} | {99: (0, None, None, None)}
    assert sum(scored[1:]) == 20 * audit.FIRST_ROUND
    none = audit.first_flip(texts, masked, cands.limit(0), scorer, "i", "t").collect()
    assert len(none) == 21 and all(r.word is None for r in none)
