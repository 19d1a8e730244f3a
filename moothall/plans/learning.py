"""Queries: words, features, the linear model, training tables and metrics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from moothall.functions import text as tx
from moothall.functions import vectors as vec
from moothall.operators import features, metrics, prep, projection
from moothall.plans.draws import SPLIT_SQL, split_exact
from moothall.plans.fixtures import DUCK_SCORES, LABELLED, SPARK_SCORES
from moothall.plans.registry import query, table, view
from moothall.session import durable

STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in features.STOP_WORDS) + "]"


def words_sql(source: str, doc: str = "doc_id", text: str = "text") -> str:
    return f"""
SELECT {doc}, CAST(i - 1 AS INTEGER) AS pos, lower(ws[i]) AS word FROM (
  SELECT {doc}, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
    SELECT {doc}, list_filter(regexp_extract_all({text}, '{features.TOKEN}'),
                              lambda w: NOT list_contains({STOP_LIST}, w) AND NOT contains(w, '/')) AS ws
    FROM ({source}) src) l) u
"""


DOCUMENTS = "SELECT doc_id, text FROM documents"
WORDS = words_sql(DOCUMENTS)
VOCAB = f"""
SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT DISTINCT word FROM ({WORDS}) w) d
UNION ALL SELECT '[UNK]', count(DISTINCT word) FROM ({WORDS}) w
"""
PARTED = f"SELECT l.doc_id, l.text, l.author_wrong, s.split FROM ({LABELLED}) l JOIN ({SPLIT_SQL}) s ON l.doc_id = s.doc_id"


def document_words(spark, sf_dir):
    return features.extract_words(table(spark, sf_dir, "documents"), "doc_id", "text", stemmer=None)


def parted(spark, sf_dir):
    """Labelled documents as train and dev parts."""
    parts = split_exact(spark, sf_dir).select("doc_id", "split")
    joined = durable(view(spark, sf_dir, LABELLED).join(parts, "doc_id"))
    return joined.filter("split = 'train'"), joined.filter("split = 'dev'")


@query("f1_extract_words", f"SELECT doc_id, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY pos)) AS words_md5 FROM ({WORDS}) w GROUP BY doc_id")
def extract_words(spark, sf_dir):
    """Words without stemming, in order; the list of a document is bounded by its text."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return document_words(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.md5(F.array_join(F.transform(listed, lambda e: e["word"]), " ")).alias("words_md5"))


@query("f1_stemmed_words")
def stemmed_words(spark, sf_dir):
    words = features.extract_words(table(spark, sf_dir, "documents"), "doc_id", "text")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("f2_build_vocab", VOCAB)
def build_vocab(spark, sf_dir):
    return features.build_vocab(document_words(spark, sf_dir)).select("word", "idx")


TRAIN_VOCAB = f"""
SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (
  SELECT DISTINCT word FROM ({words_sql(f"SELECT doc_id, text FROM ({PARTED}) p WHERE split = 'train'")}) w) d
"""
COUNTS = f"""
WITH v AS ({TRAIN_VOCAB})
SELECT w.doc_id, coalesce(v.idx, (SELECT count(*) FROM v)) AS idx, count(*) AS n
FROM ({WORDS}) w LEFT JOIN v ON w.word = v.word GROUP BY 1, 2
"""


@query("f3_count_terms", COUNTS)
def count_terms(spark, sf_dir):
    """All documents counted over the vocabulary of the training part."""
    return counted_terms(spark, sf_dir, parted(spark, sf_dir)[0])


def counted_terms(spark, sf_dir, train):
    vocab = features.build_vocab(features.extract_words(train, "doc_id", "text", stemmer=None))
    return features.count_terms(document_words(spark, sf_dir), vocab, "doc_id")


@query("f4_tfidf", f"""
WITH c AS (SELECT * FROM ({COUNTS}) x), p AS (SELECT doc_id, split FROM ({SPLIT_SQL}) s),
df AS (SELECT idx, count(*) AS df FROM c JOIN p ON c.doc_id = p.doc_id WHERE split = 'train' GROUP BY idx),
raw AS (SELECT c.doc_id, c.idx, c.n * (ln((1 + (SELECT count(*) FROM p WHERE split = 'train'))
               / (1.0::DOUBLE + coalesce(df, 0))) + 1) AS v FROM c LEFT JOIN df ON c.idx = df.idx)
SELECT doc_id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM raw
""")
def tfidf(spark, sf_dir):
    train, _ = parted(spark, sf_dir)
    counts = durable(counted_terms(spark, sf_dir, train))
    fit_on = counts.join(train.select("doc_id"), "doc_id", "left_semi")
    weighted = features.tfidf(fit_on, counts, "doc_id", train.agg(F.count(F.lit(1))))
    return weighted.withColumn("value", F.round("value", 6))


@query("f5_project")
def project(spark, sf_dir):
    train, dev = parted(spark, sf_dir)
    words = features.combined(features.extract_words(train, "doc_id", "text", stemmer=None), "doc_id")
    vocab = features.build_vocab(words, "n")
    x = durable(features.count_combined(words, vocab, "doc_id").withColumnRenamed("n", "value"))
    y = features.count_terms(features.extract_words(dev, "doc_id", "text", stemmer=None), vocab, "doc_id")
    axes = projection.fit(x, train, "doc_id", features.COMPONENTS, features.RESIDUAL, projection.PASSES, features.BROADCAST_BYTES)
    scores = projection.coordinates(axes, y.withColumnRenamed("n", "value"), dev, "doc_id", features.BROADCAST_BYTES)
    return scores.select("doc_id", F.size("vec").alias("n_components"), F.round(vec.norm(F.col("vec")), 3).alias("length"),
                         F.lit(axes.passes).alias("passes"), F.lit(float(axes.residuals.max())).alias("residual"))


PULLS = ", ".join(f"sum(miss * v[{k}])" for k in range(1, 65))
OPTIMUM = f"""
WITH RECURSIVE given AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, (label % 2)::DOUBLE AS y FROM embeddings),
size AS (SELECT count(*) AS n, sum(list_dot_product(v, v)) AS r FROM given),
fit AS (
  SELECT 0 AS i, list_transform(range(64), lambda k: 0::DOUBLE) AS w, 0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, list_transform(w, lambda e, k: e - 0.5 * (e + {features.C} * pulls[k]) / (1 + {features.C} * r / 4)), b - 2 * misses / n
  FROM (SELECT any_value(i) AS i, any_value(w) AS w, any_value(b) AS b, any_value(n) AS n, any_value(r) AS r, sum(miss) AS misses, [{PULLS}] AS pulls
        FROM (SELECT f.*, v, 1 / (1 + exp(-list_dot_product(w, v) - b)) - y AS miss FROM fit f, given) z, size) s WHERE i < 120),
best AS (SELECT w, b FROM fit WHERE i = 120)
"""


def fitted(spark, sf_dir, **settings):
    """A linear model on the given vectors, and these."""
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector("embedding").alias("features"), (F.col("label") % 2).cast("double").alias("label"))
    return features.fit_logistic(rows, **settings), rows


@query("f6_fit_logistic", OPTIMUM + """
SELECT vec_id, CASE WHEN list_dot_product(w, v) + b > 0 THEN 1 ELSE 0 END AS prediction FROM given, best
""")
def fit_logistic(spark, sf_dir):
    """The model applied to its rows; fitted closely enough to predict as the optimum does, which the SQL descends to."""
    model, rows = fitted(spark, sf_dir, tol=1e-12)
    return model.transform(rows).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("f6_optimum", OPTIMUM + f"""
SELECT count(*) AS n, round(any_value(list_dot_product(w, w)) / 2
         + {features.C} * sum(ln(1 + exp(list_dot_product(w, v) + b)) - y * (list_dot_product(w, v) + b)), 6) AS loss, true AS settled
FROM given, best
""")
def optimum(spark, sf_dir):
    """The loss at the fit of the set tolerance, and whether no entry of its gradient is above that tolerance."""
    state = features.logistic_optimum(*fitted(spark, sf_dir))
    return state.select("n", F.round("loss", 6).alias("loss"), (F.col("steepest") <= features.TOLERANCE).alias("settled"))


@query("f7_bow_model")
def bow_model(spark, sf_dir):
    train, dev = parted(spark, sf_dir)
    return features.evaluate_bow(train, dev, "doc_id", "text", "author_wrong", use_tfidf=True)


@query("j4_lookup_vocab", f"""
WITH v AS ({TRAIN_VOCAB})
SELECT w.doc_id, w.pos, coalesce(v.idx, (SELECT count(*) FROM v)) AS idx FROM ({WORDS}) w LEFT JOIN v ON w.word = v.word
""")
def lookup_vocab(spark, sf_dir):
    train, _ = parted(spark, sf_dir)
    vocab = features.build_vocab(features.extract_words(train, "doc_id", "text", stemmer=None))
    return features.lookup_vocab(document_words(spark, sf_dir), vocab, ["doc_id", "pos"]).select("doc_id", "pos", "idx")


@query("a6_length_stats", f"""
SELECT avg(n) AS mean, median(n) AS median FROM (
  SELECT len(regexp_extract_all(text, '{features.TOKEN}')) AS n FROM documents) t
""")
def length_stats(spark, sf_dir):
    return metrics.length_stats(table(spark, sf_dir, "documents"), F.size(features.tokens(F.col("text"))))


METRICS_SQL = """
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1,
       tp + fp AS n_predicted
FROM (SELECT count(*) FILTER (p = 1 AND label = 1) AS tp, count(*) FILTER (p = 1 AND label <> 1) AS fp,
             count(*) FILTER (p <> 1 AND label = 1) AS fn, count(*) FILTER (p <> 1 AND label <> 1) AS tn
      FROM (SELECT label, CASE WHEN z1 > z0 THEN 1 ELSE 0 END AS p FROM ({scores}) s) x) c
""".replace("{scores}", DUCK_SCORES)


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def score_table(spark, sf_dir):
    return view(spark, sf_dir, SPARK_SCORES).withColumn("logits", F.array("z0", "z1"))


@query("a7_binary_metrics", METRICS_SQL)
def binary_metrics(spark, sf_dir):
    predicted = score_table(spark, sf_dir).withColumn("pred", vec.argmax(F.col("logits")))
    return rounded(metrics.binary_metrics(predicted, "pred", "label"))


@query("a8_micro_metrics", """
SELECT round(avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END), 6) AS precision,
       round(avg(CASE WHEN p = label THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n_rows
FROM (SELECT label, list_position(e, list_max(e)) - 1 AS p FROM (SELECT label, embedding[1:10] AS e FROM embeddings) x) y
""")
def micro_metrics(spark, sf_dir):
    """Ten classes, scored by ten coordinates."""
    rows = table(spark, sf_dir, "embeddings").select("label", vec.argmax(F.slice("embedding", 1, 10)).alias("pred"))
    return rounded(metrics.micro_metrics(rows, "pred", "label"))


@query("a9_merge_metrics", METRICS_SQL)
def merge_metrics(spark, sf_dir):
    """Counts per batch of sixteen rows, added up."""
    batched = score_table(spark, sf_dir).withColumn("pred", vec.argmax(F.col("logits"))).withColumn(
        "batch", F.floor(F.col("vec_id") / 16))
    return rounded(metrics.merge_metrics(metrics.confusion(batched, "pred", "label", "batch")))


IDF_SQL = f"""
SELECT word, df, ln((n + 1) / (df + 1)::DOUBLE) AS idf
FROM (SELECT word, count(DISTINCT doc_id) AS df FROM ({WORDS}) w GROUP BY word) d, (SELECT count(*) AS n FROM documents) c
"""


@query("a10_idf", f"SELECT word, df, round(idf, 6) AS idf FROM ({IDF_SQL}) i")
def idf(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return rounded(features.idf(document_words(spark, sf_dir), "doc_id", documents.agg(F.count(F.lit(1)))))


TRAIN_IDF_SQL = f"""
SELECT word, count(DISTINCT doc_id) AS df FROM ({WORDS}) w WHERE doc_id % 10 <> 3 GROUP BY word
"""


@query("a10_idf_weights", f"""
WITH n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 <> 3),
i AS (SELECT w.doc_id, w.pos, ln((n + 1) / CAST(coalesce(df, 0) + 1 AS DOUBLE)) AS idf FROM ({WORDS}) w
      LEFT JOIN ({TRAIN_IDF_SQL}) t ON w.word = t.word, n)
SELECT doc_id, pos, round(CASE WHEN s > 0 THEN idf / s ELSE 0 END, 6) AS weight
FROM (SELECT *, sum(idf) OVER (PARTITION BY doc_id) AS s FROM i) x
""")
def idf_weights(spark, sf_dir):
    """Fitted on nine tenths of the documents, applied to all."""
    words = durable(document_words(spark, sf_dir))
    n_docs = table(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").agg(F.count(F.lit(1)))
    idfs = durable(features.idf(words.filter("doc_id % 10 <> 3"), "doc_id", n_docs))
    return rounded(features.idf_weights(words, idfs, "doc_id", n_docs))


@query("a12_loss_totals", """
SELECT user_id AS run, event_type AS epoch, round(sum(value), 4) AS total_loss, count(*) AS n_steps,
       sum(length(props)) AS total_seconds
FROM events GROUP BY 1, 2
""")
def loss_totals(spark, sf_dir):
    """Events as logged steps: users are runs, event types epochs, values losses."""
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("epoch"), F.col("value").alias("loss"),
        F.length("props").alias("seconds"))
    return metrics.loss_totals(log, ["run", "epoch"], seconds="seconds").withColumn(
        "total_loss", F.round("total_loss", 4))


ENCODED = f"""
SELECT d.doc_id, coalesce(ids, '') AS ids, coalesce(n, 0) AS n FROM documents d LEFT JOIN (
  SELECT w.doc_id, string_agg(CAST(v.idx AS VARCHAR), ',' ORDER BY w.pos) AS ids, count(*) AS n
  FROM ({WORDS}) w JOIN ({VOCAB}) v ON w.word = v.word WHERE w.pos < 512 GROUP BY w.doc_id) e ON d.doc_id = e.doc_id
"""


def encoded(spark, sf_dir):
    words = durable(document_words(spark, sf_dir))
    return prep.encode(table(spark, sf_dir, "documents"), words, features.build_vocab(words), "doc_id", stored=True)


@query("g1_encode", f"SELECT doc_id, md5(ids) AS ids_md5, n FROM ({ENCODED}) e")
def encode(spark, sf_dir):
    """Ids cut to 512, the model's input length."""
    return encoded(spark, sf_dir).select(
        "doc_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.size("attention_mask").alias("n"))


@query("g2_pad_fixed", f"""
SELECT doc_id, md5(concat(ids, repeat(',0', 512 - n::INT))) AS ids_md5, n AS n_real, 512 AS length
FROM ({ENCODED}) e WHERE n > 0
UNION ALL SELECT doc_id, md5(concat('0', repeat(',0', 511))), 0, 512 FROM ({ENCODED}) e WHERE n = 0
""")
def pad_fixed(spark, sf_dir):
    padded = prep.pad_fixed(encoded(spark, sf_dir), 512)
    return padded.select("doc_id", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                         F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"),
                         F.size("attention_mask").alias("length"))


@query("g3_pad_batch", f"""
SELECT doc_id, batch, n AS n_real, max(n) OVER (PARTITION BY batch) AS length FROM (
  SELECT doc_id, n, (row_number() OVER (ORDER BY doc_id) - 1) // 6 AS batch FROM ({ENCODED}) e) b
""")
def pad_batch(spark, sf_dir):
    padded = prep.pad_batch(encoded(spark, sf_dir), "doc_id", 6)
    return padded.select("doc_id", "batch",
                         F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"),
                         F.size("input_ids").alias("length"))


TURNS = "SELECT conv_id * 1000 + turn AS remark_id, text FROM conversations"
TURN_IDS = f"""
SELECT t.remark_id, t.text, coalesce(i.ids, '') AS ids FROM ({TURNS}) t LEFT JOIN (
  SELECT w.remark_id, string_agg(CAST(v.idx AS VARCHAR), ',' ORDER BY w.pos) AS ids
  FROM ({words_sql(TURNS, "remark_id")}) w JOIN v ON w.word = v.word WHERE w.pos < 512 GROUP BY w.remark_id) i
ON t.remark_id = i.remark_id
"""


@query("g4_dual_targets", f"""
WITH v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx
           FROM (SELECT DISTINCT word FROM ({words_sql(TURNS, "remark_id")}) w) d),
t AS ({TURN_IDS})
SELECT a.remark_id, md5(a.ids) AS input_md5, md5(b.ids) AS labels_md5, length(a.text) % 2 AS target
FROM t a JOIN t b ON b.remark_id = a.remark_id + 1
""")
def dual_targets(spark, sf_dir):
    """Every turn that is answered as the input, its answer as the comment to generate."""
    turns = view(spark, sf_dir, TURNS).withColumn("target", F.length("text") % 2)
    words = durable(features.extract_words(turns, "remark_id", "text", stemmer=None))
    answers = turns.select((F.col("remark_id") - 1).alias("remark_id"))
    answer_words = words.withColumn("remark_id", F.col("remark_id") - 1)
    docs = turns.join(answers, "remark_id", "left_semi")
    rows = prep.dual_targets(docs, words, answer_words, features.build_vocab(words), "remark_id", "target")
    return rows.select("remark_id", F.md5(F.array_join("input_ids", ",")).alias("input_md5"),
                       F.md5(F.array_join("labels", ",")).alias("labels_md5"), F.col("classification_target").alias("target"))


QUESTIONS = """
SELECT a.item_id, a.text AS context, 'What then?' AS question, a.text AS "answerA", b.text AS "answerB", c.text AS "answerC",
       a.item_id % 3 + 1 AS label
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 JOIN benchmark c ON c.item_id = a.item_id + 2
"""


@query("g5_expand_choices", f"""
SELECT item_id, md5(concat(context, '[UNUSED]', question)) AS prompt_md5, label - 1 AS label, choice, md5(answer) AS answer_md5
FROM (SELECT *, 0 AS choice, "answerA" AS answer FROM ({QUESTIONS}) a UNION ALL SELECT *, 1, "answerB" FROM ({QUESTIONS}) b
      UNION ALL SELECT *, 2, "answerC" FROM ({QUESTIONS}) c) x
""")
def expand_choices(spark, sf_dir):
    rows = prep.expand_choices(view(spark, sf_dir, QUESTIONS.replace('"', "`")), "item_id")
    return rows.select("item_id", F.md5("prompt").alias("prompt_md5"), "label", "choice", F.md5("answer").alias("answer_md5"))


@query("g6_argmax", """
SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS widest,
       list_position(embedding[1:3], list_max(embedding[1:3])) - 1 AS choice
FROM embeddings
""")
def argmax(spark, sf_dir):
    """The largest coordinate of an array, and of three candidate rows."""
    vectors = table(spark, sf_dir, "embeddings")
    long = vectors.select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("choice", "score"))
    return vectors.select("vec_id", vec.argmax(F.col("embedding")).alias("widest")).join(
        prep.best_choice(long, "vec_id").withColumnRenamed("prediction", "choice"), "vec_id")


@query("g7_joint_loss", f"""
WITH t AS (SELECT avg(ln(list_sum(list_transform(embedding::DOUBLE[], lambda x: exp(x)))) - embedding[(vec_id % 64 + 1)::INT]::DOUBLE) AS l
           FROM embeddings WHERE vec_id % 9 <> 0),
c AS (SELECT avg(ln(exp(z0) + exp(z1)) - CASE WHEN label = 1 THEN z1 ELSE z0 END) AS l FROM ({DUCK_SCORES}) s)
SELECT round(t.l, 6) AS text_loss, round(c.l, 6) AS class_loss, round(0.3 * t.l + 0.7 * c.l, 6) AS loss FROM t, c
""")
def joint_loss(spark, sf_dir):
    tokens = table(spark, sf_dir, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("logits"),
        F.when(F.col("vec_id") % 9 == 0, tx.IGNORED_ID).otherwise(F.col("vec_id") % 64).alias("label"))
    return rounded(prep.joint_loss(tokens, score_table(spark, sf_dir)))


@query("g8_evaluate", METRICS_SQL)
def evaluate(spark, sf_dir):
    return rounded(metrics.evaluate(score_table(spark, sf_dir)))


@query("t8_shift_right", """
SELECT vec_id, array_to_string(list_transform(list_concat([2], list_transform(embedding[1:63], lambda x: CASE WHEN x < 0 THEN -100 ELSE 7 END)),
       lambda i: CASE WHEN i = -100 THEN 1 ELSE i END), ',') AS shifted
FROM embeddings
""")
def shift_right(spark, sf_dir):
    """Signs of coordinates as ids, the negative ones ignored."""
    ids = F.transform("embedding", lambda x: F.when(x < 0, tx.IGNORED_ID).otherwise(7))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(tx.shift_right(ids, pad=1, start=2), ",").alias("shifted"))
