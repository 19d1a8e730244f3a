"""Line dedup (4): repeated runs of lines by a suffix array over line ids, built by prefix doubling.

Documents in id order form one sequence of lines. Lines without a word are not part of it. A run
of consecutive lines of one document is a later copy if the same lines stand earlier in the sequence.
Every later copy with at least `min_words` words is deleted, whatever its length; the first
stays.

The rank of a suffix at depth 2^k is the first position whose suffix has the same 2^k lines:
depth 1 ranks lines, and the ranks at s and s + 2^k give those of depth 2^(k+1). So ranks are
exact (no digest of digests), and the suffixes of one rank are an interval of the suffix array whose longest
common prefix is at least 2^k. Only suffixes whose prefix occurs twice go on to the next depth.

A run of enough words is the union of its shortest windows with enough words, taken from each of its
lines forward and backward, and each window inside a later copy is one too. So the maximal runs are
found by asking, for these windows alone, whether they stand earlier: two ranks of depth 2^k that overlap
identify a window of up to 2^(k+1) lines. As each line has a word, log2(min_words) doublings are
enough for runs of any length.

All steps are aggregates and equality joins on narrow rows: positions and ranks. A line or a run
with a third of all rows is combined before the shuffle. Rows of a line with more than a 4096th of all repeated
ones are salted to meet its rank (so the table of such lines, which is broadcast, has at most 4096 rows); joins on
longer runs are split by adaptive execution. Texts move once, to meet the numbers of their deleted lines.

Defined cases: rows with a null id or text stay as they are; a repeated row (same id and text)
is one place of the sequence, so both rows get the same result; two texts under one id
are ordered by a hash; lines without words directly after a deleted line go with it; a text whose
lines are all deleted becomes empty. Only the named columns are read; all others are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.operators.skew import skew_join
from moothall.session import durable

MIN_WORDS = 50
HOT_LINES = 4096  # a line with more than one in so many of the repeated lines is dealt to several tasks
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("doc", "body")  # the id and a hash of the text
PLACE = (*KEY, "at")


def line_table(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, body, at, first, after, words, id, check): lines with words, numbered in their document.

    Original lines `first` to `after` - 1 are the line and the wordless lines behind it; `id` and
    `check` are two hashes of the line.
    """
    lines = F.split(F.col(text), "\n")
    worded = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("line"))), lambda s: s["line"].rlike(WORD))
    read = docs.filter(F.col(doc).isNotNull()).select(
        F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("body"), lines.alias("lines")).select(
        *KEY, F.size("lines").alias("n"), worded.alias("worded"))
    spans = F.transform("worded", lambda s, k: F.struct(
        s["i"].alias("first"), F.coalesce(F.get("worded", k + 1)["i"], F.col("n")).alias("after"), s["line"].alias("line")))
    line = F.col("span.line")
    return read.select(*KEY, F.posexplode(spans).alias("at", "span")).select(
        *PLACE, "span.first", "span.after", F.regexp_count(line, F.lit(WORD)).cast("long").alias("words"),
        F.xxhash64(line).alias("id"), F.xxhash64(F.lit("check"), line).alias("check"))


def place() -> Column:
    return F.struct(*PLACE)


def name_groups(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose `keys` occur at two places or more, with the first such place as `name`."""
    seen = rows.groupBy(*keys).agg(F.min(place()).alias(name), F.count(F.lit(1)).alias("_held")).filter("_held > 1").drop("_held")
    return rows.join(seen, keys)


def shortest_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, body, at, n): from each line on, and up to each line, the fewest lines with enough words.

    Windows stay within stretches of consecutive rows. The lists hold one stretch of one document.
    """
    ordered = W.partitionBy(*KEY).orderBy("at")
    stretches = lines.select(*PLACE, "words", (F.col("at") - F.row_number().over(ordered)).alias("stretch"))
    listed = stretches.groupBy(*KEY, "stretch").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("lines"))

    def reach(taken: Column) -> Column:
        """How many of the taken lines, in order, have `min_words` words; null if all together have fewer."""
        zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("n"))
        step = F.aggregate(taken, zero, lambda s, x: F.when(s["words"] >= min_words, s).otherwise(
            F.struct((s["words"] + x["words"]).alias("words"), (s["n"] + 1).alias("n"))))
        return F.when(step["words"] >= min_words, step["n"])

    rows = listed.select(*KEY, "lines", F.reverse("lines").alias("backward"), F.size("lines").alias("size"))
    found = F.concat(
        F.transform("lines", lambda x, k: F.struct(x["at"].alias("at"), reach(F.slice("lines", k + 1, min_words)).alias("n"))),
        F.transform("lines", lambda x, k: F.struct(x["at"].alias("end"), reach(
            F.slice("backward", F.col("size") - k, min_words)).alias("n"))).cast("array<struct<at:int,n:int>>"))
    size = F.size("lines")
    windows = rows.select(*KEY, F.posexplode(found).alias("k", "w"), size.alias("size")).filter("w.n IS NOT NULL")
    start = F.when(F.col("k") < F.col("size"), F.col("w.at")).otherwise(F.col("w.at") - F.col("w.n") + 1)
    return windows.select(*KEY, start.alias("at"), F.col("w.n").alias("n")).distinct()


def find_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, body, removed): the numbers of the original lines to delete, per document that has any."""
    lines = line_table(docs, doc, text)
    seen = lines.groupBy("id", "check").agg(
        F.min(place()).alias("rank"), F.max(place()).alias("last"), F.count(F.lit(1)).alias("n_rows"))
    held = durable(seen.filter(F.col("rank") < F.col("last")).drop("last"))
    per_salt = max(1, (held.agg(F.sum("n_rows")).first()[0] or 0) // HOT_LINES)
    repeated = durable(skew_join(lines, held.select("id", "check", "rank"), ["id", "check"], PLACE, counts=held,
                                 rows_per_salt=per_salt).drop("id", "check").dropDuplicates(list(PLACE)))
    ranks = repeated.select(*PLACE, "rank")
    windows = durable(shortest_windows(repeated, min_words))
    longest = windows.agg(F.max("n")).first()[0] or 0

    copies, depth = [], 1
    while depth <= longest:
        asked = windows.filter((F.col("n") >= depth) & (F.col("n") < 2 * depth))
        copies.append(_later(asked, ranks, depth))
        if 2 * depth <= longest:
            ranks = durable(_double(ranks, depth))
        depth *= 2
    if not copies:
        copies = [windows]
    windows = copies[0]
    for more in copies[1:]:
        windows = windows.unionByName(more)
    deleted = windows.select(*KEY, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    spans = repeated.select(*PLACE, F.sequence(F.col("first"), F.col("after") - 1).alias("span")).join(deleted, list(PLACE), "left_semi")
    return spans.groupBy(*KEY).agg(F.flatten(F.collect_list("span")).alias("removed"))


def _double(ranks: DataFrame, depth: int) -> DataFrame:
    """Ranks of depth 2 * depth, of suffixes whose prefix of that length occurs twice."""
    behind = ranks.select(*KEY, (F.col("at") - depth).alias("at"), F.col("rank").alias("next"))
    return name_groups(ranks.join(behind, list(PLACE)), ["rank", "next"], "named").select(*PLACE, F.col("named").alias("rank"))


def _later(windows: DataFrame, ranks: DataFrame, depth: int) -> DataFrame:
    """The windows of depth to 2 * depth - 1 lines that stand earlier too."""
    if depth == 1:
        return windows.join(ranks, list(PLACE)).filter(F.col("rank") < place()).select(*PLACE, "n")
    headed = windows.join(ranks.withColumnRenamed("rank", "head"), list(PLACE))
    tails = ranks.select(*KEY, F.col("at").alias("tail_at"), F.col("rank").alias("tail"))
    full = headed.withColumn("tail_at", F.col("at") + F.col("n") - depth).join(tails, [*KEY, "tail_at"])
    return name_groups(full.select(*PLACE, "n", "head", "tail"), ["n", "head", "tail"], "earliest").filter(
        F.col("earliest") < place()).select(*PLACE, "n")


def drop_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                counted: tuple[str, str] | None = None) -> DataFrame:
    """The documents, all columns kept, with later copies of line runs deleted from `text`.

    `counted` names two more columns: lines before, and lines deleted.
    """
    copies = find_copies(docs, doc, text, min_words).select(
        F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("removed").alias("__removed"))
    joined = docs.join(copies, (F.col(doc) == F.col("__doc")) & (F.xxhash64(F.col(text)) == F.col("__body")), "left")
    joined = joined.withColumn("__lines", F.split(F.col(text), "\n"))  # a column, so that it is split once per text
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__removed"))
    kept = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    # Generated, not projected: a filter on the new text must not repeat the work.
    columns = [F.explode(F.array(kept)).alias(c) if c == text else F.col(c) for c in docs.columns]
    if counted:
        columns += [F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias(counted[0]),
                    F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias(counted[1])]
    return joined.select(*columns)


def op4_line_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_copies(docs, counted=("n_lines", "n_removed"))


#: Every window as its lines' text, without ranks.
OP4_SQL = """
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
ex AS (SELECT doc_id, len(l) AS n_lines, unnest(l) AS line, unnest(range(0, len(l))) AS i FROM raw),
ln AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j,
              coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n_lines) AS after,
              len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w
       FROM ex WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM ln),
fw AS (SELECT a.doc_id, a.j AS s, min(b.j) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + 50
       AND b.upto - a.upto + a.w >= 50 GROUP BY a.doc_id, a.j),
bw AS (SELECT b.doc_id, max(a.j) AS s, b.j AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + 50
       AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.j),
win AS (SELECT * FROM fw UNION SELECT * FROM bw),
txt AS (SELECT win.doc_id, s, e, string_agg(line, chr(10) ORDER BY j) AS t
        FROM win JOIN ln ON win.doc_id = ln.doc_id AND j BETWEEN s AND e GROUP BY win.doc_id, s, e),
copies AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM txt) WHERE k > 1),
gone AS (SELECT DISTINCT ln.doc_id, i, after FROM ln JOIN copies ON ln.doc_id = copies.doc_id AND j BETWEEN s AND e),
idx AS (SELECT DISTINCT doc_id, unnest(range(i, after)) AS i FROM gone),
kept AS (SELECT ex.doc_id, string_agg(line, chr(10) ORDER BY ex.i) AS text, count(*) AS n
         FROM ex LEFT JOIN idx ON ex.doc_id = idx.doc_id AND ex.i = idx.i WHERE idx.i IS NULL GROUP BY ex.doc_id)
SELECT raw.doc_id, coalesce(kept.text, '') AS text, CAST(len(l) AS BIGINT) AS n_lines,
       CAST(len(l) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM raw LEFT JOIN kept ON raw.doc_id = kept.doc_id
"""

QUERIES = {"op4_line_runs": op4_line_runs}
ORACLES = {"op4_line_runs": OP4_SQL}
