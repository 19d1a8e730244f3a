"""Comment trees: flatten, build, top level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.session import durable, scratch_path

DEPTH_PER_PASS = 8


def _schema(levels: int) -> str:
    """Reply lists of some levels; what lies deeper stays JSON text, so that any depth can be read."""
    return f"array<struct<body:string,author:string,ups:bigint,replies:{_schema(levels - 1) if levels else 'string'}>>"


LEVEL = _schema(0)


def top_level(posts: DataFrame, post: str = "post_id", trees: str = "trees") -> DataFrame:
    """The first level of each post's trees, in order."""
    return posts.select(post, F.posexplode(F.from_json(trees, LEVEL)).alias("idx", "c")).select(
        post, "idx", "c.body", "c.author", "c.ups")


def _levels_of(level: DataFrame, post: str, levels: int) -> DataFrame:
    """All comments of some levels of (post, path, replies), with the JSON text of deeper replies."""
    empty = F.array()
    df = level.select(post, "path", F.from_json("replies", _schema(levels - 1)).alias("_0")).withColumn("_0", F.transform(
        F.coalesce("_0", empty), lambda c, i: F.struct(F.concat("path", F.array(i)).alias("path"), c["body"], c["author"], c["ups"], c["replies"])))
    for k in range(1, levels):  # columns, so that each level is built once
        children = F.transform(f"_{k - 1}", lambda p: F.transform(F.coalesce(p["replies"], empty), lambda c, i: F.struct(
            F.concat(p["path"], F.array(i)).alias("path"), c["body"], c["author"], c["ups"], c["replies"])))
        df = df.withColumn(f"_{k}", F.flatten(children))
    no_text = F.lit(None).cast("string")

    def inner(p: Column) -> Column:
        return F.struct(p["path"], p["body"], p["author"], p["ups"], no_text.alias("replies"))

    def deepest(p: Column) -> Column:
        return F.struct(p["path"], p["body"], p["author"], p["ups"], p["replies"])

    listed = [F.transform(f"_{k}", inner) for k in range(levels - 1)] + [F.transform(f"_{levels - 1}", deepest)]
    return df.select(post, F.explode(F.concat(*listed).cast(
        "array<struct<path:array<int>,body:string,author:string,ups:bigint,replies:string>>")).alias("c")).select(post, "c.*")


def flatten_threads(posts: DataFrame, post: str = "post_id", trees: str = "trees", levels: int = DEPTH_PER_PASS) -> DataFrame:
    """One row per comment with its path of positions; any depth, one job per `levels` levels."""
    level = posts.select(post, F.array().cast("array<int>").alias("path"), F.col(trees).alias("replies"))
    passes = []
    while True:
        nodes = durable(_levels_of(level, post, levels))
        passes.append(nodes.drop("replies"))
        level = nodes.filter(F.col("replies").isNotNull())
        if level.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, passes)
    depth = F.size("path")
    return rows.select(
        post, "path", F.slice("path", F.lit(1), depth - 1).alias("parent_path"), (depth - 1).alias("depth"),
        F.element_at("path", -1).alias("idx"), "body", "author", "ups")


def build_threads(comments: DataFrame, post: str = "post_id") -> DataFrame:
    """One JSON tree per top-level comment, built from the deepest level upwards.

    Only the direct replies of one comment meet in a row, which the tree holds anyway; a
    post with very many comments stays spread over its top-level comments. Comments below an
    absent one are in no tree; `orphans` lists where they begin.
    """
    spark, folder = comments.sparkSession, scratch_path(comments.sparkSession, "levels")
    nodes = comments.select(post, "path", F.to_json(F.struct("body", "author", "ups")).alias("_own"), F.size("path").alias("_depth"))
    nodes.write.partitionBy("_depth").parquet(folder)  # each level is then read alone
    nodes = spark.read.schema(nodes.schema).parquet(folder)
    deepest = nodes.agg(F.max("_depth")).first()[0] or 0
    # one row of one number; the loop below runs once per level
    below = None
    for depth in range(deepest, 0, -1):
        level = nodes.filter(F.col("_depth") == depth)
        if below is None:
            tree = level.select(post, "path", F.col("_own").alias("tree"))
        else:
            replies = below.groupBy(post, F.slice("path", 1, depth).alias("path")).agg(
                F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("at"), "tree"))).alias("_replies"))
            own = F.col("_own").substr(F.lit(1), F.length("_own") - 1)
            texts = F.array_join(F.transform("_replies", lambda r: r["tree"]), ",")
            tree = level.join(replies, [post, "path"], "left").select(
                post, "path",
                F.when(F.col("_replies").isNull(), F.col("_own"))
                .otherwise(F.concat(own, F.lit(',"replies":['), texts, F.lit("]}"))).alias("tree"))
        below = durable(tree)
    if below is None:
        below = nodes.select(post, "path", F.col("_own").alias("tree"))
    return below.select(post, F.element_at("path", 1).alias("idx"), "tree")


def orphans(comments: DataFrame, post: str = "post_id") -> DataFrame:
    """Replies whose parent is not among the comments; their own replies hang below them."""
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    parents = comments.select(F.col(post).alias("_post"), F.col("path").alias("_path"))
    replies = comments.filter(F.size("path") > 1)
    return replies.join(parents, (F.col(post) == F.col("_post")) & (parent == F.col("_path")), "left_anti")
