"""Queries: filters, draws, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.functions import text as tx
from moothall.operators import filters, sampling
from moothall.plans.fixtures import LABELLED, ordered_key
from moothall.plans.registry import query, table, view

VOTES = """
SELECT user_id,
       CAST(sum(CASE WHEN event_id % 20 < user_id % 21 THEN 1 ELSE 0 END) AS BIGINT) AS n_right,
       CAST(sum(CASE WHEN event_id % 20 < user_id % 21 THEN 0 ELSE 1 END) AS BIGINT) AS n_wrong
FROM events GROUP BY user_id
"""
TAGGED = """
SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' WHEN 2 THEN 'other' ELSE 'train' END AS split,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE lang END AS action,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 - 2 END AS judgment
FROM documents
"""
USABLE_SQL = f"""
SELECT doc_id, split, action, judgment FROM ({TAGGED}) t
WHERE split IN ('train', 'dev', 'test') AND action IS NOT NULL AND judgment IS NOT NULL AND judgment <> 0
"""


def labelled(spark, sf_dir):
    return view(spark, sf_dir, LABELLED)


@query("p3_keep_agreed", f"""
SELECT user_id, n_right, n_wrong FROM ({VOTES}) v
WHERE n_right + n_wrong >= 10 AND CAST(greatest(n_right, n_wrong) AS DOUBLE) / (n_right + n_wrong) >= CAST(0.9 AS DOUBLE)
""")
def keep_agreed(spark, sf_dir):
    votes = view(spark, sf_dir, VOTES).select(
        "user_id", F.struct(F.col("n_right").alias("RIGHT"), F.col("n_wrong").alias("WRONG")).alias("scores"))
    return filters.keep_agreed(votes, "scores").select(
        "user_id", F.col("scores.RIGHT").alias("n_right"), F.col("scores.WRONG").alias("n_wrong"))


@query("p4_usable_rows", USABLE_SQL)
def usable_rows(spark, sf_dir):
    return filters.usable_rows(view(spark, sf_dir, TAGGED), "split", ["action", "judgment"], "judgment")


@query("p6_equal_and_contains", """
SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END AS holds FROM documents WHERE lang = 'en'
""")
def equal_and_contains(spark, sf_dir):
    english = filters.where_equal(table(spark, sf_dir, "documents"), "lang", "en")
    holding = filters.where_contains(english, "text", "tion").select("doc_id", F.lit(1).alias("holds"))
    rest = filters.drop_members(english, holding, "doc_id").select("doc_id", F.lit(0).alias("holds"))
    return holding.unionByName(rest)


@query("p7_select_named", "SELECT doc_id AS id, lang AS area, n_chars AS length FROM documents")
def select_named(spark, sf_dir):
    return filters.select_named(table(spark, sf_dir, "documents"), {"doc_id": "id", "lang": "area", "n_chars": "length"})


@query("p9_map_label", f"""
SELECT doc_id, CASE WHEN judgment < 0 THEN 0 WHEN judgment > 0 THEN 1 END AS by_sign,
       CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS by_verdict, doc_id % 3 AS by_offset
FROM (SELECT t.doc_id, t.judgment, d.lang FROM ({TAGGED}) t JOIN documents d ON t.doc_id = d.doc_id) j
""")
def map_label(spark, sf_dir):
    tagged = view(spark, sf_dir, TAGGED).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    verdict = F.when(F.col("lang") == "en", "WRONG").otherwise("RIGHT")
    return tagged.select(
        "doc_id", tx.map_label(F.col("judgment"), "sign").alias("by_sign"),
        tx.map_label(verdict, "verdict").alias("by_verdict"),
        tx.map_label(F.col("doc_id") % 3 + 1, "offset").alias("by_offset"))


ORDERED_SQL = f"""
SELECT doc_id, author_wrong, row_number() OVER (ORDER BY {ordered_key(42, 'doc_id')}) AS rn,
       count(*) OVER () AS n FROM ({LABELLED}) l
"""


@query("d1_sample_exact", f"""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {ordered_key(42, 'doc_id')}) AS rn FROM documents) r
WHERE rn <= (SELECT count(*) FROM labels)
""")
def sample_exact(spark, sf_dir):
    """As many documents as there are labels."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.sample_exact(documents, "doc_id", table(spark, sf_dir, "labels"))


@query("d2_balance", f"""
SELECT doc_id, author_wrong FROM (
  SELECT doc_id, author_wrong, row_number() OVER (PARTITION BY author_wrong ORDER BY {ordered_key(42, 'doc_id')}) AS rn
  FROM ({LABELLED}) l) r
WHERE author_wrong = 1 OR rn <= (SELECT sum(author_wrong) FROM ({LABELLED}) l)
""")
def balance(spark, sf_dir):
    return sampling.balance(labelled(spark, sf_dir).select("doc_id", "author_wrong"), "doc_id", "author_wrong")


@query("d2_balance_parity", f"""
WITH l AS (SELECT doc_id, author_wrong FROM ({LABELLED}) x),
neg AS (SELECT doc_id, row_number() OVER (ORDER BY {ordered_key(42, 'doc_id')}) - 1 AS no FROM l WHERE author_wrong = 0),
drawn AS (SELECT DISTINCT CAST(concat('0x', substr({ordered_key(43, 'doc_id')}, 1, 15)) AS BIGINT)
                 % (SELECT count(*) FROM neg) AS no FROM l WHERE author_wrong = 1)
SELECT doc_id, 1 AS author_wrong FROM l WHERE author_wrong = 1
UNION ALL SELECT doc_id, 0 FROM neg WHERE no IN (SELECT no FROM drawn)
""")
def balance_parity(spark, sf_dir):
    return sampling.balance(
        labelled(spark, sf_dir).select("doc_id", "author_wrong"), "doc_id", "author_wrong", mode="parity")


@query("d3_labelled_only", """
SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr')
""")
def labelled_only(spark, sf_dir):
    return filters.labelled_only(table(spark, sf_dir, "documents"), "lang", ["en", "fr"]).select("doc_id", "source")


@query("d4_sample_fraction", f"SELECT doc_id FROM ({ORDERED_SQL}) r WHERE rn <= n // 10")
def sample_fraction(spark, sf_dir):
    return sampling.sample_fraction(labelled(spark, sf_dir), "doc_id", 0.1).select("doc_id")


SPLIT_SQL = f"""
SELECT doc_id, author_wrong, CASE WHEN rn <= ceil(n * 0.1) THEN 'test'
  WHEN rn <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.1) THEN 'dev' ELSE 'train' END AS split
FROM ({ORDERED_SQL}) r
"""


@query("d5_split_exact", SPLIT_SQL)
def split_exact(spark, sf_dir):
    return sampling.split_exact(labelled(spark, sf_dir).select("doc_id", "author_wrong"), "doc_id")


@query("d6_split_by_tag", f"SELECT split, count(*) AS n_rows, sum(CAST(doc_id AS BIGINT))::BIGINT AS ids FROM ({USABLE_SQL}) u GROUP BY split")
def split_by_tag(spark, sf_dir):
    parts = sampling.split_by_tag(view(spark, sf_dir, USABLE_SQL), "split")
    sums = [part.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("ids"))
            for part in parts.values()]
    return filters.union_all(*sums)


@query("d7_mini_slice", f"""
SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {ordered_key(42, 'doc_id')}) AS rn
FROM ({SPLIT_SQL}) s) r WHERE split = 'train' AND rn <= 16
""")
def mini_slice(spark, sf_dir):
    """The first sixteen training rows, the feature's own size."""
    train = split_exact(spark, sf_dir).filter("split = 'train'")
    return sampling.first_n(train, sampling.order_key("doc_id", 42), 16).select("doc_id", "split")


@query("d8_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {ordered_key(0, 'doc_id')}) - 1 AS place FROM documents")
def shuffle(spark, sf_dir):
    return sampling.hash_position(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0, "place")


@query("j6_members", """
SELECT doc_id, true AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def members(spark, sf_dir):
    documents, ids = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return (filters.keep_members(documents, ids, "doc_id").withColumn("labelled", F.lit(True))
            .unionByName(filters.drop_members(documents, ids, "doc_id").withColumn("labelled", F.lit(False))))


@query("u1_union_all", """
SELECT 'document' AS kind, doc_id AS id, text FROM documents
UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations
""")
def union_all(spark, sf_dir):
    return filters.union_all(
        table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"),
        table(spark, sf_dir, "benchmark").select("text", F.lit("benchmark").alias("kind"), F.col("item_id").alias("id")),
        table(spark, sf_dir, "conversations").select(
            F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


@query("u2_set_operations", """
SELECT 'union' AS op, id FROM (SELECT doc_id AS id FROM labels UNION SELECT user_id FROM events) u
UNION ALL SELECT 'minus', id FROM (SELECT doc_id AS id FROM labels EXCEPT SELECT user_id FROM events) m
""")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    return (filters.union_ids(a, b).select(F.lit("union").alias("op"), "id")
            .unionByName(filters.minus_ids(a, b).select(F.lit("minus").alias("op"), "id")))
