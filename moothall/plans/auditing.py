"""Queries: robustness audits and the live tally."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.functions import vectors as vec
from moothall.operators import audit, metrics, tally
from moothall.plans.corpus import TALLY_SQL, labelled_comments
from moothall.plans.fixtures import COMMENTS, DUCK_SCORES, LABELLED
from moothall.plans.learning import rounded, score_table
from moothall.plans.registry import query, table, view
from moothall.session import durable, scratch_path
from moothall.sources import sinks
from moothall.streaming import live

CUT = "string_split(regexp_replace(lower({t}), '[^\\pL\\pN\\pM''<>]+', ' ', 'g'), ' ')"


def cut(text: str) -> str:
    return f"list_filter({CUT.format(t=text)}, lambda w: w <> '')"


TAGGED = """
SELECT p_partkey, concat(CASE p_size % 4 WHEN 0 THEN '[ARG0: the first] ' WHEN 1 THEN 'Then [V:x] ' ELSE 'So ' END,
       '[ARG0: the ', p_name, '] [V: broke it] [ARG1: ', p_type, ' kind] [ARG0: ', p_brand, '] [ARG0: all of ', lower(p_type), ']') AS described
FROM part
"""


@query("t7_role_spans", """
SELECT p_partkey, concat('the ', p_name) AS phrase FROM part
UNION SELECT p_partkey, p_brand FROM part
UNION SELECT p_partkey, concat('all of ', lower(p_type)) FROM part
""")
def role_spans(spark, sf_dir):
    return audit.role_spans(view(spark, sf_dir, TAGGED), "p_partkey", "described", "ARG0")


@query("t7_role_spans_strict", """
SELECT p_partkey, concat('the ', p_name) AS phrase FROM part
UNION SELECT p_partkey, p_brand FROM part
UNION SELECT p_partkey, concat('all of ', lower(p_type)) FROM part
UNION SELECT p_partkey, 'the first' FROM part WHERE p_size % 4 = 0
""")
def role_spans_strict(spark, sf_dir):
    return audit.role_spans(view(spark, sf_dir, TAGGED), "p_partkey", "described", "ARG0", mode="strict")


# Each turn is described with two of its own words as the actor.
DESCRIBED = """
SELECT remark_id, text, described FROM (
  SELECT conv_id * 1000 + turn AS remark_id, text,
         concat('Then [ARG0: ', {third}, '] [V: did so] [ARG0: ', {second}, ']') AS described
  FROM conversations) d
"""
SPARK_DESCRIBED = DESCRIBED.format(second="coalesce(get(split(text, ' '), 1), '-')", third="coalesce(get(split(text, ' '), 2), '-')")
# A target ends at a colon, and white space in it becomes one blank.
DUCK_TARGETS = r"""
SELECT DISTINCT remark_id, text, trim(string_split(regexp_replace(raw, '\s+', ' ', 'g'), ':')[1]) AS phrase FROM (
  SELECT conv_id * 1000 + turn AS remark_id, text, unnest([coalesce(string_split(text, ' ')[2], '-'), coalesce(string_split(text, ' ')[3], '-')]) AS raw
  FROM conversations) t
"""


def described(spark, sf_dir):
    return view(spark, sf_dir, SPARK_DESCRIBED)


def masked_targets(spark, sf_dir):
    remarks = described(spark, sf_dir)
    targets = audit.role_spans(remarks, "remark_id", "described", "ARG0")
    return audit.mask_targets(remarks, targets, "remark_id", "text")


@query("r1_targets", f"SELECT remark_id, phrase FROM ({DUCK_TARGETS}) t")
def targets(spark, sf_dir):
    return audit.role_spans(described(spark, sf_dir), "remark_id", "described", "ARG0")


NEIGHBOURS = f"""
SELECT before, word, after, count(*) AS n FROM (
  SELECT ws[i - 1] AS before, ws[i] AS word, ws[i + 1] AS after FROM (
    SELECT ws, unnest(range(2, len(ws))) AS i FROM (SELECT {cut('text')} AS ws FROM documents) a) b) c
GROUP BY ALL
"""
MASKED = f"""
SELECT remark_id, phrase, replace(replace(text, concat(' ', phrase, ' '), '<mask>'), '<mask>', ' <mask> ') AS masked
FROM ({DUCK_TARGETS}) t WHERE contains(text, concat(' ', phrase, ' '))
"""
FILLERS = f"""
SELECT remark_id, phrase, word, n, rank FROM (
  SELECT remark_id, phrase, word, n, row_number() OVER (PARTITION BY remark_id, phrase ORDER BY n DESC, word) AS rank FROM (
    SELECT s.remark_id, s.phrase, k.word, max(k.n) AS n FROM (
      SELECT remark_id, phrase, ws[i - 1] AS before, ws[i + 1] AS after FROM (
        SELECT remark_id, phrase, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
          SELECT remark_id, phrase, {cut('masked')} AS ws FROM ({MASKED}) m) a) b WHERE ws[i] = '<mask>') s
    JOIN (SELECT *, row_number() OVER (PARTITION BY before, after ORDER BY n DESC, word) AS place FROM ({NEIGHBOURS}) x) k
      ON s.before = k.before AND s.after = k.after AND k.place <= 30
    GROUP BY ALL) f) r
WHERE rank <= 100
"""


def candidates(spark, sf_dir):
    masked = durable(masked_targets(spark, sf_dir))
    contexts = audit.mask_slots(masked, ["remark_id", "phrase"])
    neighbours = audit.neighbour_counts(table(spark, sf_dir, "documents"), "text", contexts)
    return masked, audit.fillers(masked, neighbours, ["remark_id", "phrase"])


@query("r2_fillers", FILLERS)
def fillers(spark, sf_dir):
    return candidates(spark, sf_dir)[1]


WEIGHTS = f"""
SELECT word, round(ln((wrong + 1) / (rights + 1)::DOUBLE) + 0.9, 6) AS weight FROM (
  SELECT word, count(*) FILTER (author_wrong = 1) * 6 AS wrong, count(*) FILTER (author_wrong = 0) AS rights FROM (
    SELECT DISTINCT doc_id, author_wrong, unnest({cut('text')}) AS word FROM ({LABELLED}) l) w
  GROUP BY word) c
"""


def weights(spark, sf_dir):
    """Word weights from the labelled documents: log ratio of smoothed document counts."""
    words = view(spark, sf_dir, LABELLED).select(
        "doc_id", "author_wrong", F.explode(audit.words_of(F.col("text"))).alias("word")).distinct()
    counts = words.groupBy("word").agg(
        (F.count_if(F.col("author_wrong") == 1) * 6).alias("wrong"), F.count_if(F.col("author_wrong") == 0).alias("rights"),
        F.count(F.lit(1)).alias("n_rows"))
    weight = F.round(F.ln((F.col("wrong") + 1) / (F.col("rights") + 1)) + 0.9, 6)
    return durable(counts.select("word", weight.alias("weight"), "n_rows"))


def score_sql(source: str, keys: str, text: str) -> str:
    return f"""
SELECT {keys}, coalesce(sum(weight), 0) AS score FROM (
  SELECT {keys}, unnest({cut(text)}) AS word FROM ({source}) s) u LEFT JOIN w ON u.word = w.word GROUP BY {keys}
"""


@query("r3_first_flip", f"""
WITH w AS ({WEIGHTS}),
clean AS (SELECT remark_id, CASE WHEN round(score, 9) > 0 THEN 1 ELSE 0 END AS clean FROM ({score_sql(
    "SELECT conv_id * 1000 + turn AS remark_id, text FROM conversations", "remark_id", "text")}) c),
tried AS (SELECT f.remark_id, f.phrase, f.rank, f.word, replace(m.masked, '<mask>', f.word) AS changed
          FROM ({FILLERS}) f JOIN ({MASKED}) m ON f.remark_id = m.remark_id AND f.phrase = m.phrase),
scored AS ({score_sql("SELECT * FROM tried", "remark_id, phrase, rank", "changed")}),
flipped AS (SELECT s.remark_id, s.phrase, s.rank, row_number() OVER (PARTITION BY s.remark_id ORDER BY s.phrase, s.rank) AS rn
            FROM scored s JOIN clean c ON s.remark_id = c.remark_id
            WHERE CASE WHEN round(s.score, 9) > 0 THEN 1 ELSE 0 END <> c.clean)
SELECT c.remark_id, c.clean, t.phrase, t.word, md5(t.changed) AS changed_md5
FROM clean c LEFT JOIN flipped f ON f.remark_id = c.remark_id AND f.rn = 1
LEFT JOIN tried t ON t.remark_id = f.remark_id AND t.phrase = f.phrase AND t.rank = f.rank
""")
def first_flip(spark, sf_dir):
    masked, found = candidates(spark, sf_dir)
    scorer = audit.linear_scorer(weights(spark, sf_dir), places=9)
    result = audit.first_flip(described(spark, sf_dir), masked, durable(found), scorer, "remark_id", "text")
    return result.select("remark_id", "clean", "phrase", "word", F.md5("changed").alias("changed_md5"))


PART_WORDS = "SELECT p_partkey, string_split(concat(p_name, ' ', p_type, ' ', p_brand, ' ', p_size), ' ') AS ids FROM part"
TOKEN_ERRORS = f"""
SELECT a.p_partkey, levenshtein(
         list_reduce(list_transform(a.ids, lambda x: chr(64 + list_position(list_concat(a.ids, b.ids), x)::INT)), lambda x, y: concat(x, y)),
         list_reduce(list_transform(b.ids, lambda x: chr(64 + list_position(list_concat(a.ids, b.ids), x)::INT)), lambda x, y: concat(x, y)))
       / len(a.ids)::DOUBLE AS token_error
FROM ({PART_WORDS}) a JOIN ({PART_WORDS}) b ON b.p_partkey = a.p_partkey + 1
"""


def token_errors(spark, sf_dir):
    """The words of each part against those of the next one."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_size"), " ").alias("ids"))
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("ids").alias("other"))
    return parts.join(following, "p_partkey").select(
        "p_partkey", audit.token_error(F.col("ids"), F.col("other")).alias("token_error"))


@query("r4_token_error", f"SELECT p_partkey, round(token_error, 6) AS token_error FROM ({TOKEN_ERRORS}) t")
def token_error(spark, sf_dir):
    return rounded(token_errors(spark, sf_dir))


@query("a11_mean_error", f"SELECT round(avg(token_error), 6) AS mean_error, count(*) AS n FROM ({TOKEN_ERRORS}) t")
def mean_error(spark, sf_dir):
    return rounded(metrics.mean_error(token_errors(spark, sf_dir), "token_error"))


@query("r5_chosen_draws", f"""
SELECT sample, coalesce(min(CASE WHEN flipped THEN draw END), max(draw)) AS draw, bool_or(flipped) AS flipped FROM (
  SELECT vec_id // 10 AS sample, vec_id % 10 AS draw, (CASE WHEN z1 > z0 THEN 1 ELSE 0 END) <> 1 AND z0 > 0.1 AS flipped
  FROM ({DUCK_SCORES}) s) d GROUP BY sample
""")
def chosen_draws(spark, sf_dir):
    """Ten draws per sample; class 0 has to lead clearly for a flip."""
    draws = score_table(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 10).alias("sample"), (F.col("vec_id") % 10).alias("draw"),
        F.array(F.when(F.col("z0") > 0.1, F.col("z0")).otherwise(F.lit(-1e9)), "z1").alias("logits"), F.lit(1).alias("label"))
    return audit.chosen_draws(draws, "sample", "draw", "logits", "label")


@query("r5_flip_rate", f"""
SELECT count(*) AS n_samples, count(*) FILTER (flipped) AS n_flipped, round(avg(flipped::INT), 6) AS rate FROM (
  SELECT vec_id // 10 AS sample, bool_or((CASE WHEN z1 > z0 THEN 1 ELSE 0 END) <> label) AS flipped
  FROM ({DUCK_SCORES}) s GROUP BY 1) d
""")
def flip_rate(spark, sf_dir):
    draws = score_table(spark, sf_dir).withColumn("sample", F.floor(F.col("vec_id") / 10))
    return rounded(audit.flip_rate(audit.chosen_draws(draws, "sample", "vec_id", "logits", "label")))


@query("r6_margin_loss", """
SELECT vec_id, round(greatest(e[label + 1] - list_max(list_concat(e[1:label], e[label + 2:10])) + 0.05, 0), 6) AS loss
FROM (SELECT vec_id, label, embedding[1:10]::DOUBLE[] AS e FROM embeddings) x
""")
def margin_loss(spark, sf_dir):
    logits = F.slice("embedding", 1, 10).cast("array<double>")
    return rounded(table(spark, sf_dir, "embeddings").select(
        "vec_id", vec.margin_loss(logits, F.col("label"), 0.05).alias("loss")))


@query("r7_entropy", """
WITH p AS (SELECT vec_id // 8 AS text_id, vec_id, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
z AS (SELECT text_id, vec_id, x, ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS z FROM p)
SELECT text_id, round(sum((z - x) * exp(x - z)), 6) AS entropy FROM z GROUP BY text_id
""")
def entropy(spark, sf_dir):
    """Entropy over the positions of a text, eight vectors each."""
    per_position = vec.entropy(F.col("embedding").cast("array<double>"))
    return rounded(table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("text_id")).agg(
        F.sum(per_position).alias("entropy")))


BIGRAMS = f"""
SELECT {{keys}} ws[i - 1] AS before, ws[i] AS word FROM (
  SELECT {{keys}} ws, unnest(range(2, len(ws) + 1)) AS i FROM (SELECT {{keys}} {cut('text')} AS ws FROM documents) a) b
"""


@query("r8_log_perplexity", f"""
WITH b AS (SELECT before, word, count(*) AS n FROM ({BIGRAMS.format(keys='doc_id,')}) x WHERE doc_id % 10 <> 3 GROUP BY 1, 2),
f AS (SELECT before, sum(n) AS total FROM b GROUP BY before),
v AS (SELECT count(DISTINCT word) + 1 AS words FROM b),
t AS (SELECT t.doc_id, ln((coalesce(n, 0) + 1) / CAST(coalesce(total, 0) + words AS DOUBLE)) AS log_p FROM ({BIGRAMS.format(keys='doc_id,')}) t
      LEFT JOIN b ON t.before = b.before AND t.word = b.word LEFT JOIN f ON t.before = f.before, v)
SELECT d.doc_id, round(-avg(log_p), 6) AS log_perplexity FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
""")
def log_perplexity(spark, sf_dir):
    """Counted on nine tenths of the documents, applied to all; texts of fewer than two words have no position."""
    documents = table(spark, sf_dir, "documents")
    return rounded(audit.log_perplexity(documents, F.expr("doc_id % 10 <> 3"), "doc_id", "text"))


@query("r9_linear_importance", f"""
WITH w AS ({WEIGHTS}),
t AS (SELECT remark_id, pos - 1 AS pos, ws[pos] AS word FROM (
        SELECT remark_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (
          SELECT conv_id * 1000 + turn AS remark_id, {cut('text')} AS ws FROM conversations) a) b),
d AS (SELECT remark_id, pos, t.word, coalesce(weight, 0) AS weight,
             round(sum(coalesce(weight, 0)) OVER (PARTITION BY remark_id), 9) AS total FROM t LEFT JOIN w ON t.word = w.word)
SELECT remark_id, pos, word, CASE WHEN total > 0 THEN weight ELSE 0 END AS "drop",
       row_number() OVER (PARTITION BY remark_id ORDER BY CASE WHEN total > 0 THEN weight ELSE 0 END DESC, pos) AS rank FROM d
""")
def linear_importance(spark, sf_dir):
    remarks = described(spark, sf_dir).select("remark_id", "text")
    return audit.linear_importance(remarks, weights(spark, sf_dir), "remark_id", "text")


@query("r9_word_importance", """
SELECT item_id, pos - 1 AS pos, ws[pos] AS word, (len(ws[pos]) + 1)::DOUBLE AS "drop",
       row_number() OVER (PARTITION BY item_id ORDER BY len(ws[pos]) DESC, pos) AS rank
FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (
  SELECT item_id, string_split(text, ' ') AS ws FROM benchmark) a) b
""")
def word_importance(spark, sf_dir):
    """A wrapped model whose score is the text's length: each word weighs its letters and a blank."""
    scorer = audit.batch_scorer(lambda texts: [[0.0, float(len(t))] for t in texts])
    return audit.word_importance(table(spark, sf_dir, "benchmark"), scorer, "item_id", "text")


@query("r9_unknown_importance", """
SELECT item_id, pos - 1 AS pos, ws[pos] AS word, (len(ws[pos]) - 5)::DOUBLE AS "drop",
       row_number() OVER (PARTITION BY item_id ORDER BY len(ws[pos]) DESC, pos) AS rank
FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (
  SELECT item_id, string_split(text, ' ') AS ws FROM benchmark) a) b
""")
def unknown_importance(spark, sf_dir):
    """The same model, words replaced by the unknown word and not deleted."""
    scorer = audit.batch_scorer(lambda texts: [[0.0, float(len(t))] for t in texts])
    return audit.word_importance(table(spark, sf_dir, "benchmark"), scorer, "item_id", "text", how="unknown")


CANDIDATES = """
SELECT a.vec_id, a.vec_id % 40 + 1 AS n_words, a.label AS n_changed, CASE a.label WHEN 3 THEN 'the' ELSE 'ring' END AS word,
       a.vec_id % 11 = 0 AS edited, a.embedding AS va, b.embedding AS vb
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""


def constrained_sql(name: str, close: str) -> str:
    return f"""
SELECT vec_id, '{name}' AS recipe FROM (
  SELECT *, list_cosine_similarity(va::DOUBLE[], vb::DOUBLE[]) AS sim FROM ({CANDIDATES}) c) s
WHERE n_changed <= 0.4 * n_words AND NOT edited AND word <> 'the' AND {close}
"""


@query("r10_constraints", constrained_sql("loose", "sim >= 0.2") + " UNION ALL "
       + constrained_sql("windowed", "(sim >= 0.936338023 OR n_words < 15)"))
def constraints(spark, sf_dir):
    cands = view(spark, sf_dir, CANDIDATES).withColumn("sim", vec.cosine(F.col("va"), F.col("vb")))
    columns = ("n_words", "n_changed", "word", "edited", "sim")
    loose = audit.constrain(cands, *columns).select("vec_id", F.lit("loose").alias("recipe"))
    windowed = audit.constrain(cands, *columns, min_cosine=audit.MIN_COSINE_WINDOWED, window=audit.WINDOW)
    return loose.unionByName(windowed.select("vec_id", F.lit("windowed").alias("recipe")))


@query("r11_goals", """
SELECT vec_id, p <> label AS untargeted, p = 2 AS targeted FROM (
  SELECT vec_id, label, list_position(e, list_max(e)) - 1 AS p FROM (SELECT vec_id, label, embedding[1:10] AS e FROM embeddings) x) y
""")
def goals(spark, sf_dir):
    logits = F.slice("embedding", 1, 10)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", audit.goal(logits, F.col("label")).alias("untargeted"),
        audit.goal(logits, F.col("label"), 2).alias("targeted"))


@query("r13_audit_report", f"""
SELECT label AS run, count(*) AS n_samples, count(*) FILTER (adv <> t) AS n_flipped, round(avg((adv <> t)::INT), 6) AS rate,
       count(*) FILTER (clean = t) AS n_clean_right, round(avg(err), 6) AS mean_token_error, round(avg(secs), 6) AS mean_seconds
FROM (SELECT label, label % 2 AS t, CASE WHEN embedding[2] > embedding[1] THEN 1 ELSE 0 END AS clean,
             CASE WHEN embedding[4] > embedding[3] THEN 1 ELSE 0 END AS adv, embedding[5]::DOUBLE AS err, vec_id % 7 AS secs
      FROM embeddings) s GROUP BY label
""")
def audit_report(spark, sf_dir):
    """Samples go through the shard sink; each label is a run."""
    e = F.col("embedding")
    samples = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("run"), (F.col("label") % 2).alias("label"),
        vec.argmax(F.array(e[0], e[1])).alias("clean_pred"), vec.argmax(F.array(e[2], e[3])).alias("adv_pred"),
        e[4].cast("double").alias("token_error"), (F.col("vec_id") % 7).alias("seconds"))
    out = scratch_path(spark, "audit")
    sinks.run_shards(samples, 100, lambda df: df, out, row_no="vec_id")
    rows, _ = sinks.read_shards(spark, out, 0, 1 << 31)
    return rounded(audit.audit_report(rows, "run"))


@query("x1_score_batches", """
SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n_e, CASE WHEN length(replace(text, 'e', '')) * 10 < length(text) * 9 THEN 1 ELSE 0 END AS pred
FROM documents
""")
def score_batches(spark, sf_dir):
    """A wrapped model over whole documents: is more than a tenth of a text the letter e?"""
    scorer = audit.batch_scorer(lambda texts: [[len(t) / 10, float(t.count("e"))] for t in texts])
    return scorer(table(spark, sf_dir, "documents"), ["doc_id"], "text").select(
        "doc_id", F.col("logits")[1].cast("long").alias("n_e"), vec.argmax(F.col("logits")).alias("pred"))


@query("w1_live_tally", TALLY_SQL)
def live_tally(spark, sf_dir):
    """Comments numbered within their post, as three deliveries of files that repeat rows of their own and of the one before."""
    arriving, out, state = (scratch_path(spark, n) for n in ("arriving", "live", "state"))
    in_post = W.partitionBy("post_id").orderBy("idx")
    comments = durable(view(spark, sf_dir, COMMENTS).withColumn("ts", F.col("ts").cast("timestamp")).drop("tag").withColumn(
        "idx", F.row_number().over(in_post) - 1))
    seconds = F.col("ts").cast("double")
    first, last = comments.agg(F.min(seconds), F.max(seconds)).first()
    third = F.least(F.floor((seconds - first) / ((last - first) / 3 + 1)), F.lit(2))
    for delivery in range(3):
        fresh = comments.filter(third == delivery)
        again = fresh.filter("idx % 10 = 0").unionByName(comments.filter((third == delivery - 1) & (F.col("idx") % 7 == 0)))
        fresh.unionByName(again).write.mode("append").parquet(arriving)
        stream = tally.label_comments(spark.readStream.schema(comments.schema).parquet(arriving))
        live.run_available(live.live_tally(stream), out, state)
        if delivery == 1:
            live.compact(spark, out)
    return live.latest(spark, out)
