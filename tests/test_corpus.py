"""Truth rows for text functions, the tally and the filters."""

import pytest
from pyspark.sql import functions as F

from moothall.functions import text as tx
from moothall.functions import vectors as vec
from moothall.operators import audit, filters, metrics, tally


def value(spark, expr, **columns):
    fields = ", ".join(f"{n} {'string' if isinstance(v, str) else 'array<int>'}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], fields).select(expr.alias("x")).first().x


def test_scrub_and_drop(spark):
    assert value(spark, tx.scrub_spoilers(F.col("t")), t="story\nEDIT: ok YTA fine\nend") == "story\n\nend"
    posts = spark.createDataFrame([(1, "edit: I am the ass"), (2, "[removed]"), (3, None), (4, "kept")], "id int, body string")
    assert sorted(r.id for r in filters.drop_gone(posts).collect()) == [3, 4]


def test_titles_and_replacements(spark):
    assert value(spark, tx.normalise_title(F.col("t")), t="WIBTA if AITA for x") == "wibta if  x"
    assert value(spark, tx.mask_phrase(F.col("t"), "w"), t=" w w ") == " <mask> w "
    assert value(spark, tx.replace_kth(F.col("t"), "aa", "b", 2), t="aaa") == "ab"
    assert value(spark, tx.replace_kth(F.col("t"), "aa", "b", 3), t="aaa") == "aaa"
    assert value(spark, tx.replace_kth(F.col("t"), "aa", "b", 1), t="a") == "a"
    with pytest.raises(ValueError):
        tx.replace_kth(F.col("t"), "a", "b", 0)
    with pytest.raises(ValueError):
        tx.remove_phrase(F.col("t"), "")
    key = value(spark, tx.safe_key(F.lit(7), F.col("t")), t='a b<c>:"/\\|?* ж' + "x" * 300)
    assert key.startswith("7_a_b[less]c[greater][colon][quote][forward_slash][backslash][pipe][qmark][asterisk]_?x")
    assert len(key) == 150


def test_shift_right(spark):
    assert value(spark, tx.shift_right(F.col("a"), pad=1, start=2), a=[5, -100, 6]) == [2, 5, 1]
    assert value(spark, tx.shift_right(F.col("a"), pad=1, start=2), a=[5]) == [2]


def comments(spark, rows):
    return spark.createDataFrame(rows, "post_id int, idx int, verdict string, body string, ups int")


def test_best_comment_ties(spark):
    rows = [(1, i, "AUTHOR", "z", 0) for i in range(20, 30)]
    rows += [(1, 0, "AUTHOR", "x", 9), (1, 1, "AUTHOR", "y", 5), (1, 2, "AUTHOR", "x", 1)]
    rows += [(2, i, "OTHER", "z", 0) for i in range(20, 30)] + [(2, 0, "OTHER", "p", 5), (2, 1, "OTHER", "q", 5)]
    best = {r.post_id: (r.best_comment, r.author_wrong) for r in tally.best_comment(comments(spark, rows)).collect()}
    assert best == {1: ("y", 1), 2: ("q", 0)}


def test_admission(spark):
    rows = [(1, i, "AUTHOR", "c", 0) for i in range(9)] + [(1, 9, "INFO", "c", 0)]
    rows += [(2, i, "AUTHOR", "c", 0) for i in range(9)]
    rows += [(3, i, "AUTHOR" if i % 2 else "OTHER", "c", 0) for i in range(10)]
    tallied = tally.tally(comments(spark, rows))
    assert [(r.post_id, r.agreement) for r in tally.admit(tallied).collect()] == [(1, 0.9)]
    assert {r.post_id: r.w for r in tallied.select("post_id", tally.majority().alias("w")).collect()}[3] == 0


def test_one_post_with_most_comments(spark):
    """A hot post gives the same result as counting it directly."""
    big = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 1000 + 2).cast("int").alias("post_id"),
        F.col("id").cast("int").alias("idx"), F.lit("AUTHOR").alias("verdict"),
        F.concat(F.lit("c"), F.col("id") % 7).alias("body"), (F.col("id") % 50).cast("int").alias("ups"))
    best = tally.best_comment(big).filter("post_id = 1").first()
    assert best.n_valid == 66_667 and best.author_wrong == 1


def test_metrics(spark):
    none = spark.createDataFrame([(0, 1), (0, 0)], "p int, t int")
    row = metrics.binary_metrics(none, "p", "t").first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 0.5)
    lengths = spark.createDataFrame([(n,) for n in (1, 2, 3, 10)], "n int")
    assert tuple(metrics.length_stats(lengths, F.col("n")).first()) == (4.0, 2.5)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_token_error(spark):
    pairs = [([1, 2, 3], [1, 3]), ([], [1]), ([1, 2], [1, 2]), ([5, 5, 6, 7], [7, 6, 5]), ([3], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>")
    found = {r.i: r.e for r in df.select("i", audit.token_error(F.col("a"), F.col("b")).alias("e")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert found[i] == (edit_distance(a, b) / len(a) if a else None)


def test_token_error_with_very_many_ids(spark):
    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(60_000)).alias("a"))
    shifted = row.select("a", F.slice("a", 59_990, 11).alias("t"), F.concat(F.array(F.lit(0)), F.slice("a", 59_991, 10)).alias("u"))
    wide = shifted.select(F.concat("t", F.slice("a", 55_290, 20)).alias("a"), F.concat("u", F.slice("a", 55_290, 20)).alias("b"))
    assert wide.select(audit.token_error(F.col("a"), F.col("b")).alias("e")).first().e == pytest.approx(1 / 31)


def test_role_spans(spark):
    rows = [(1, "[ARG0: I] [V: told] [ARG1: her]"), (2, "So [ARG0: my sister] [V: told]"), (3, "So [V:x] went [ARG0: a b]")]
    df = spark.createDataFrame(rows, "id int, d string")
    assert [tuple(r) for r in audit.role_spans(df, "id", "d", "ARG0").orderBy("id").collect()] == [(2, "my sister"), (3, "a b")]
    strict = audit.role_spans(df, "id", "d", "ARG0", mode="strict").orderBy("id").collect()
    assert [tuple(r) for r in strict] == [(1, "I"), (2, "my sister"), (3, "a b")]


def test_losses(spark):
    df = spark.createDataFrame([([2.0, 0.5, 1.0], 1)], "z array<double>, y int")
    row = df.select(vec.margin_loss(F.col("z"), F.col("y"), 5.0).alias("m"), vec.argmax(F.col("z")).alias("a"),
                    F.aggregate(vec.log_softmax(F.col("z")), F.lit(0.0), lambda s, x: s + F.exp(x)).alias("one")).first()
    assert row.m == pytest.approx(3.5) and row.a == 0 and row.one == pytest.approx(1.0)
