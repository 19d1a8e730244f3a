"""Queries: scans, sinks, shards and comment trees, on files Spark writes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.functions.text import safe_key
from moothall.operators import threads
from moothall.operators.sampling import hash_position
from moothall.operators.skew import number_rows
from moothall.plans.draws import SPLIT_SQL, split_exact
from moothall.plans.fixtures import LABELLED, ordered_key
from moothall.plans.registry import query, table, view
from moothall.session import scratch_path
from moothall.sources import files, sinks

TURNS = """
SELECT conv_id AS post_id, turn, role AS author, text AS body, length(text) AS ups FROM conversations
"""


def thread_comments(spark, sf_dir):
    """Turn t is the only reply to turn t - 1."""
    return view(spark, sf_dir, TURNS).withColumn(
        "path", F.array_repeat(F.lit(0), (F.col("turn") + 1).cast("int"))).withColumn("ups", F.col("ups").cast("long"))


def branched_comments(spark, sf_dir):
    """Turn t replies to turn (t - 1) div 2: the path holds the binary digits of t + 1 behind the first."""
    digits = F.split(F.substring(F.bin(F.col("turn") + 1), 2, 64), "")
    turns = F.transform(F.filter(digits, lambda d: d != ""), lambda d: d.cast("int"))
    return thread_comments(spark, sf_dir).withColumn("path", F.concat(F.array(F.lit(0)), turns))


def thread_posts(spark, sf_dir):
    """Post rows in the shape of a scraped post: the first turn as the body, all turns as the tree."""
    trees = threads.build_threads(branched_comments(spark, sf_dir))
    first = view(spark, sf_dir, TURNS).filter("turn = 0")
    return first.join(trees, "post_id").select(
        "post_id", F.concat(F.lit("AITA for post? "), F.col("post_id")).alias("title"), "author", "body",
        F.concat(F.lit("["), F.col("tree"), F.lit("]")).alias("trees"),
        F.concat(F.lit("https://forum.example/"), F.col("post_id")).alias("link"))


@query("n1_flatten_threads", """
SELECT conv_id AS post_id, CAST(floor(log2(turn + 1)) AS INTEGER) AS depth, role AS author, md5(text) AS body_md5, length(text) AS ups,
       CASE WHEN turn = 0 THEN 0 ELSE (turn - 1) % 2 END AS idx FROM conversations
""")
def flatten_threads(spark, sf_dir):
    flat = threads.flatten_threads(thread_posts(spark, sf_dir))
    return flat.select("post_id", "depth", "author", F.md5("body").alias("body_md5"), "ups", "idx")


@query("n2_build_threads", """
SELECT conv_id AS post_id, 0 AS idx,
       md5(concat(string_agg(concat('{"body":', CAST(to_json(text) AS VARCHAR), ',"author":"', role, '","ups":', length(text)),
                             ',"replies":[' ORDER BY turn), '}', repeat(']}', count(*)::INT - 1))) AS tree_md5
FROM conversations GROUP BY conv_id
""")
def build_threads(spark, sf_dir):
    return threads.build_threads(thread_comments(spark, sf_dir)).select("post_id", "idx", F.md5("tree").alias("tree_md5"))


@query("n2_orphans", """
SELECT c.conv_id AS post_id, c.turn FROM conversations c WHERE c.turn > 0 AND c.turn % 5 <> 1
AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = (c.turn - 1) // 2 AND p.turn % 5 <> 1)
""")
def orphans(spark, sf_dir):
    """Replies left without a parent when some turns are taken away."""
    return threads.orphans(branched_comments(spark, sf_dir).filter("turn % 5 <> 1")).select("post_id", "turn")


@query("n3_top_level", """
SELECT l_orderkey AS post_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag, l_partkey) - 1 AS idx,
       l_returnflag AS author, concat('line ', l_linestatus) AS body, l_partkey AS ups
FROM lineitem
""")
def top_level(spark, sf_dir):
    """Orders as posts and their lines, a handful each, as comments."""
    comment = F.struct(F.col("l_linenumber").alias("no"), F.concat(F.lit("line "), F.col("l_linestatus")).alias("body"),
                       F.col("l_returnflag").alias("author"), F.col("l_partkey").alias("ups"))
    posts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(
        F.to_json(F.array_sort(F.collect_list(comment))).alias("trees"))
    return threads.top_level(posts)


@query("s1_post_files", r"""
SELECT concat('AITA for post? ', CAST(conv_id AS VARCHAR)) AS title,
       md5(regexp_replace(replace(text, chr(10), concat(chr(10), ' ')), '^\s+|\s+$', '', 'g')) AS body_md5,
       (SELECT count(*) FROM conversations c WHERE c.conv_id = conversations.conv_id) AS n_comments
FROM conversations WHERE turn = 0
""")
def post_files(spark, sf_dir):
    path = scratch_path(spark, "posts")
    files.write_post_files(thread_posts(spark, sf_dir), path)
    posts = files.read_post_files(spark, path)
    flat = threads.flatten_threads(posts, "title").groupBy("title").agg(F.count(F.lit(1)).alias("n_comments"))
    return posts.select("title", F.md5("body").alias("body_md5")).join(flat, "title")


@query("s2_corpus_csv", "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents")
def corpus_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = files.read_corpus_csv(spark, path, "doc_id bigint, lang string, text string, n_chars bigint")
    return rows.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


@query("s3_tsv", "SELECT page_id, url, md5(html) AS html_md5 FROM pages")
def tsv(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    table(spark, sf_dir, "pages").write.csv(
        path, header=True, sep="\t", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = files.read_tsv(spark, path, "page_id bigint, url string, html string")
    return rows.select("page_id", "url", F.md5("html").alias("html_md5"))


@query("s4_jsonl", """
SELECT d.doc_id, md5(d.text) AS text_md5, l.quality AS right_votes, l.toxic AS wrong_votes
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def jsonl(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    votes = F.struct(F.col("quality").alias("RIGHT"), F.col("toxic").alias("WRONG"))
    table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        "doc_id", "text", votes.alias("votes")).write.json(path)
    rows = files.read_jsonl(spark, path, "doc_id bigint, text string, votes struct<RIGHT:int,WRONG:int>")
    return rows.select("doc_id", F.md5("text").alias("text_md5"), F.col("votes.RIGHT").alias("right_votes"),
                       F.col("votes.WRONG").alias("wrong_votes"))


@query("s5_labelled_csv", f"""
SELECT l.title, l.label, c.n_classes FROM (
  SELECT concat('doc ', CAST(doc_id AS VARCHAR)) AS title, author_wrong AS label FROM ({LABELLED}) x) l, (
  SELECT * FROM (VALUES (2)) v(n_classes)) c
""")
def labelled_csv(spark, sf_dir):
    path = scratch_path(spark, "labelled")
    view(spark, sf_dir, LABELLED).select(
        (F.col("author_wrong") + 1).alias("label"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        F.col("text").alias("sentence")).write.csv(path, escape='"')
    classes = files.class_counts(spark).filter("corpus = 'imdb'").select("n_classes")
    return files.read_labelled(spark, path).select("title", "label").withColumn("n_classes", classes.scalar())


@query("s6_zip_by_line", """
SELECT doc_id, md5(text) AS text_md5, length(text) % 3 + 1 AS label FROM documents
""")
def zip_by_line(spark, sf_dir):
    """JSON lines and labels in one order, each cut into many files at places of its own, joined by line number."""
    rows, side = scratch_path(spark, "rows"), scratch_path(spark, "side")
    documents = table(spark, sf_dir, "documents")
    cut = [documents.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id") for n in (8, 11)]
    cut[0].select("doc_id", "text").write.json(rows)
    cut[1].select((F.length("text") % 3 + 1).cast("string").alias("value")).write.text(side)
    left = files.numbered_lines(spark, rows).select(
        "row_no", F.from_json("value", "doc_id bigint, text string").alias("r")).select("row_no", "r.*")
    right = files.numbered_lines(spark, side).select("row_no", F.col("value").cast("int").alias("label"))
    return files.zip_by_line(left, right).select("doc_id", F.md5("text").alias("text_md5"), "label")


SUBMISSIONS = """
SELECT concat('order ', CAST(o_orderkey AS VARCHAR(20))) AS title,
       CASE WHEN o_orderpriority = '5-LOW' THEN '[deleted]' ELSE o_orderstatus END AS author,
       o_orderpriority AS body, concat('https://forum.example/', CAST(o_orderkey AS VARCHAR(20))) AS link,
       o_orderdate AS created_at FROM orders
"""


@query("s7_select_submissions", f"""
SELECT row_number() OVER (ORDER BY created_at, link) - 1 AS post_id, title, author, body, link FROM ({SUBMISSIONS}) s
WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-12-31' AND author <> '[deleted]'
""")
def select_submissions(spark, sf_dir):
    return files.select_submissions(view(spark, sf_dir, SUBMISSIONS), "1996-01-01", "1999-12-31")


@query("s8_write_splits", f"""
WITH s AS (SELECT doc_id, author_wrong, split FROM ({SPLIT_SQL}) p)
SELECT fmt, doc_id, author_wrong, split FROM (
  SELECT * FROM s UNION ALL SELECT doc_id, author_wrong, 'mini' FROM s WHERE split = 'dev' AND doc_id % 7 = 0) a,
  (VALUES ('parquet'), ('csv'), ('json')) f(fmt)
""")
def write_splits(spark, sf_dir):
    parts = split_exact(spark, sf_dir)
    read = []
    for fmt in ("parquet", "csv", "json"):
        path = scratch_path(spark, f"splits-{fmt}")
        sinks.write_splits(parts, path, fmt, mini=parts.filter("split = 'dev' AND doc_id % 7 = 0").drop("split"))
        back = spark.read.format(fmt).schema("doc_id bigint, author_wrong int, split string")
        read.append(back.option("header", True).load(path).withColumn("fmt", F.lit(fmt)))
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("s9_write_pairs", """
SELECT md5(text) AS original_md5, md5(replace(text, 'the', 'a')) AS result_md5 FROM conversations WHERE contains(text, 'the')
""")
def write_pairs(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    changed = F.replace("text", F.lit("the"), F.lit("a"))
    sinks.write_pairs(table(spark, sf_dir, "conversations").select(
        F.col("text").alias("original"), F.when(F.contains("text", F.lit("the")), changed).alias("result")), path)
    rule = sinks.SEPARATOR
    log = spark.read.text(path, lineSep=f"\n{rule}\n{rule}\n")
    parts = F.split("value", f"\n{rule}\n")
    return log.select(F.md5(parts[0]).alias("original_md5"), F.md5(parts[1]).alias("result_md5"))


def run_over_shards(spark, sf_dir):
    out = scratch_path(spark, "shards")
    rows = number_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "row_no")

    def score(df):
        return df.select("shard", "row_no", "doc_id", F.length("text").alias("score"))

    half = rows.filter(F.col("row_no") < rows.agg(F.floor(F.count(F.lit(1)) / 2).alias("n")).scalar())
    sinks.run_shards(half, 64, score, out, start=5)
    sinks.run_shards(rows, 64, score, out)
    return out


SHARD_SQL = """
SELECT row_no // 64 AS shard, row_no, doc_id, score FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id, length(text) AS score FROM documents) r
"""


@query("s10_run_shards", SHARD_SQL)
def run_shards(spark, sf_dir):
    """A run over half the rows from the fifth on, then over all: what is finished is not run again, and no row is lost."""
    rows, _ = sinks.read_shards(spark, run_over_shards(spark, sf_dir), 0, 1 << 31)
    return rows


@query("s11_read_shards", """
SELECT 'missing' AS kind, (count(*) + 63) // 64 AS shard FROM documents
UNION ALL SELECT 'present', shard FROM (SELECT DISTINCT (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard FROM documents) s
""")
def read_shards(spark, sf_dir):
    """All finished shards, and the one behind the last reported as missing."""
    n = (table(spark, sf_dir, "documents").count() + 63) // 64
    rows, missing = sinks.read_shards(spark, run_over_shards(spark, sf_dir), 0, n + 1)
    return (rows.select(F.lit("present").alias("kind"), "shard").distinct()
            .unionByName(missing.select(F.lit("missing").alias("kind"), "shard")))


@query("s11_pair_shards", """
SELECT conv_id // 16 AS shard, conv_id AS row_no, md5(p) AS premise_md5, md5(h) AS hypothesis_md5, length(p) - length(h) AS score
FROM (SELECT a.conv_id, a.text AS p, b.text AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn = 1) t
""")
def pair_shards(spark, sf_dir):
    """Shards of text pairs: the first two turns as premise and hypothesis."""
    out, turns = scratch_path(spark, "pair-shards"), table(spark, sf_dir, "conversations")
    first, second = (turns.filter(F.col("turn") == n).select(F.col("conv_id").alias("row_no"), F.col("text").alias(name))
                     for n, name in enumerate(("premise", "hypothesis")))
    sinks.run_shards(first.join(second, "row_no"), 16, lambda df: df.select(
        "shard", "row_no", "premise", "hypothesis", (F.length("premise") - F.length("hypothesis")).alias("score")), out)
    rows, _ = sinks.read_shards(spark, out, 0, 1 << 31)
    return rows.select("shard", "row_no", F.md5("premise").alias("premise_md5"), F.md5("hypothesis").alias("hypothesis_md5"), "score")


@query("s12_materialize", "SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang")
def materialize(spark, sf_dir):
    path = scratch_path(spark, "cache")
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    sinks.materialize(counts, path)
    return sinks.materialize(counts.limit(0), path)  # the second call reads what the first wrote


@query("s13_resume_after", "SELECT conv_id, turn FROM conversations WHERE conv_id > (SELECT max(item_id) FROM benchmark)")
def resume_after(spark, sf_dir):
    names = table(spark, sf_dir, "benchmark").select(safe_key(F.col("item_id"), F.lit("any title")).alias("name"))
    noted = names.unionByName(names.select(F.lit("skipped_posts.txt").alias("name")).distinct())
    return sinks.resume_after(table(spark, sf_dir, "conversations"), noted, "conv_id").select("conv_id", "turn")


@query("s14_quarantine", """
SELECT 'kept' AS kind, concat('doc/', CAST(doc_id AS VARCHAR)) AS link FROM documents WHERE doc_id % 5 > 1
UNION ALL SELECT DISTINCT 'bad', concat('lang/', lang) FROM documents WHERE doc_id % 5 = 0
""")
def quarantine(spark, sf_dir):
    """Broken trees share a link per language; empty tree lists are dropped without a note."""
    kind = F.col("doc_id") % 5
    posts = table(spark, sf_dir, "documents").select(
        F.when(kind == 0, F.lit('[{"body":')).when(kind == 1, F.lit("[]"))
        .otherwise(F.to_json(F.array(F.struct(F.col("text").alias("body"))))).alias("trees"),
        F.when(kind == 0, F.concat(F.lit("lang/"), F.col("lang"))).otherwise(F.concat(F.lit("doc/"), F.col("doc_id"))).alias("link"))
    good, bad = sinks.split_valid(posts)
    return (good.select(F.lit("kept").alias("kind"), "link")
            .unionByName(bad.select(F.lit("bad").alias("kind"), "link")))


@query("j5_positional_zip", f"""
SELECT a.doc_id, b.doc_id AS shuffled_id FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) a JOIN (
  SELECT doc_id, row_number() OVER (ORDER BY {ordered_key(0, 'doc_id')}) AS n FROM documents) b ON a.n = b.n
""")
def positional_zip(spark, sf_dir):
    """Two orders of the documents side by side."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    left = number_rows(ids, ["doc_id"], "row_no")
    right = hash_position(ids.withColumnRenamed("doc_id", "shuffled_id"), "shuffled_id", 0, "row_no")
    return files.zip_by_line(left, right).select("doc_id", "shuffled_id")
