"""Files, shards, trees and streams."""

import json

import pytest
from pyspark.sql import functions as F

from moothall.operators import tally, threads
from moothall.sources import files, sinks
from moothall.streaming import live


def test_post_files(spark, tmp_path):
    tree = [{"body": "NTA", "author": "a", "ups": 3, "replies": [{"body": "why", "author": "None", "ups": 1}]}]
    folder = tmp_path / "posts"
    folder.mkdir()
    (folder / "0_good").write_text(f"A title \nme\nfirst line\nsecond line\n{json.dumps(tree)}\nhttp://x\n")
    (folder / "1_broken").write_text("A title\nme\nbody\n[{\nhttp://x\n")
    (folder / "skipped_posts.txt").write_text("http://y\n")
    rows = files.read_post_files(spark, str(folder)).collect()
    assert [(r.title, r.body) for r in rows] == [("A title", "first line\n second line")]
    posts = files.read_post_files(spark, str(folder)).withColumn("post_id", F.lit(1))
    flat = threads.flatten_threads(posts).orderBy("path").collect()
    assert [(list(r.path), r.body, r.ups) for r in flat] == [([0], "NTA", 3), ([0, 0], "why", 1)]
    assert [r.body for r in threads.top_level(posts).collect()] == ["NTA"]


def test_build_then_flatten_is_identity(spark):
    rows = [(1, [0], "a", "x", 1), (1, [1], "b", "y", 2), (1, [0, 0], 'q"\n', "x", 3), (1, [0, 1], "d", "x", 4),
            (1, [0, 1, 0], "e", "z", 5), (2, [0], "f", "x", 6)]
    comments = spark.createDataFrame(rows, "post_id int, path array<int>, body string, author string, ups long")
    built = threads.build_threads(comments)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", "tree"))), lambda t: t["tree"])
    posts = built.groupBy("post_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("trees"))
    flat = threads.flatten_threads(posts).select("post_id", "path", "body", "author", "ups")
    assert sorted(map(tuple, flat.collect())) == sorted(rows)


def test_line_numbers_over_many_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name in ("a", "b"):
            (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(3000)))
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 6000
    assert all(r.value == f"{r.file[-1]}{r.line_no}" for r in rows)
    assert sorted(r.row_no for r in rows) == list(range(6000))
    assert all(r.row_no == r.line_no + 3000 * (r.file[-1] == "b") for r in rows)


def test_shards_run_once_and_missing_ones_are_reported(spark, tmp_path):
    out, runs = str(tmp_path / "shards"), []

    def mark(df):
        runs.append(df.select("shard").distinct().count())
        return df.withColumn("run", F.lit(len(runs)))

    rows = spark.range(100).withColumnRenamed("id", "row_no")
    sinks.run_shards(rows.filter("row_no < 40"), 20, mark, out)
    sinks.run_shards(rows, 20, mark, out)
    assert runs == [2, 3]
    found, missing = sinks.read_shards(spark, out, 0, 7)
    assert found.count() == 100 and sorted(r.shard for r in missing.collect()) == [5, 6]
    with pytest.raises(ValueError):
        sinks.run_shards(rows, 20, mark, out, start=100)


def test_resume_and_quarantine(spark):
    posts = spark.range(10).withColumnRenamed("id", "post_id")
    done = spark.createDataFrame([("3_x",), ("7_y_1",), ("skipped_posts.txt",)], "name string")
    assert sorted(r.post_id for r in sinks.resume_after(posts, done).collect()) == [8, 9]
    assert sinks.resume_after(posts, done.limit(0)).count() == 10
    df = spark.createDataFrame([('[{"body":"a"}]', "l1"), ("[]", "l2"), ("[{", "l3"), ("[{", "l3")], "trees string, link string")
    good, bad = sinks.split_valid(df)
    assert [r.link for r in good.collect()] == ["l1"] and [r.link for r in bad.collect()] == ["l3"]


def test_materialize_repeats_an_unfinished_write(spark, tmp_path):
    path = tmp_path / "cache"
    path.mkdir()
    (path / "part-0.parquet").write_text("broken")
    assert sinks.materialize(spark.range(3), str(path)).count() == 3
    assert sinks.materialize(spark.range(9), str(path)).count() == 3


def test_live_tally_over_batches_with_repeats_and_late_rows(spark, tmp_path):
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "post_id int, idx int, ts timestamp, verdict string"

    def arrive(*rows):
        df = spark.createDataFrame([(p, i, t, v) for p, i, t, v in rows], "post_id int, idx int, ts string, verdict string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(arriving)
        live.run_available(live.live_tally(spark.readStream.schema(schema).parquet(arriving), "1 hour"), out, state)
        return {r.post_id: (r.n_valid, r.n_author, r.n_other) for r in live.latest(spark, out).collect()}

    first = arrive((1, 1, "2024-01-01 10:00:00", "AUTHOR"), (1, 2, "2024-01-01 10:01:00", "OTHER"),
                   (2, 3, "2024-01-01 10:02:00", "OTHER"))
    assert first == {1: (2, 1, 1), 2: (1, 0, 1)}
    second = arrive((1, 1, "2024-01-01 10:00:00", "AUTHOR"), (1, 4, "2024-01-01 15:00:00", "AUTHOR"))
    assert second == {1: (3, 2, 1), 2: (1, 0, 1)}
    third = arrive((2, 5, "2024-01-01 09:00:00", "AUTHOR"), (2, 6, "2024-01-01 15:30:00", "OTHER"))
    assert third == {1: (3, 2, 1), 2: (2, 0, 2)}


def test_live_tally_counts_equal_places_of_different_posts(spark, tmp_path):
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "post_id int, idx int, ts timestamp, verdict string"
    for hour in (10, 11):
        rows = [(2, hour, f"2024-01-01 {hour}:00:00", "AUTHOR"), (2, hour + 10, f"2024-01-01 {hour}:01:00", "OTHER"),
                (1, hour, f"2024-01-01 {hour}:02:00", "OTHER")]
        df = spark.createDataFrame(rows + rows[:1], "post_id int, idx int, ts string, verdict string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(arriving)
        live.run_available(live.live_tally(spark.readStream.schema(schema).parquet(arriving), "1 hour"), out, state)
        live.compact(spark, out)
        live.compact(spark, out)
    assert {r.post_id: (r.n_valid, r.n_author, r.n_other) for r in live.latest(spark, out).collect()} == {2: (4, 2, 2), 1: (2, 0, 2)}


def test_live_state_stays_bounded_and_silent_posts_wake_up(spark, tmp_path):
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, verdicts, held = "post_id int, idx int, ts timestamp, verdict string", ("AUTHOR", "OTHER", "INFO", None), []
    everything = []
    for day in range(4):
        rows = [(post, 100 * day + i, f"2024-01-{1 + 5 * day:02d} 10:{i:02d}:00", verdicts[(post + i) % 4])
                for post in [0, *range(100 * day, 100 * day + 40)] for i in range(3)]
        everything += rows
        df = spark.createDataFrame(rows + rows[::5], "post_id int, idx int, ts string, verdict string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(arriving)
        held.append(live.run_available(live.live_tally(spark.readStream.schema(schema).parquet(arriving), "1 hour"), out, state))
        if day == 1:
            live.compact(spark, out)
    batch = spark.createDataFrame(everything, "post_id int, idx int, ts string, verdict string").dropDuplicates(["post_id", "idx"])
    columns = ["post_id", "n_valid", "n_author", "n_other", "n_everybody", "n_nobody", "n_info"]
    assert sorted(live.latest(spark, out).select(columns).collect()) == sorted(tally.tally(batch).select(columns).collect())
    assert max(held) <= 2 * 41 * 3 and held[-1] <= 41 * 3  # 160 posts have come, 123 comments a day


def test_shards_take_rows_that_come_later(spark, tmp_path):
    out, rows = str(tmp_path / "shards"), spark.range(10).withColumnRenamed("id", "row_no")
    keep = lambda df: df.select("shard", "row_no")
    sinks.run_shards(rows.filter("row_no <> 4"), 4, keep, out, start=2)
    sinks.run_shards(rows.filter("row_no < 6"), 4, keep, out)
    sinks.run_shards(rows, 4, keep, out)
    sinks.run_shards(rows, 4, keep, out)
    found, missing = sinks.read_shards(spark, out, 0, 3)
    assert sorted(r.row_no for r in found.collect()) == list(range(10)) and missing.count() == 0
