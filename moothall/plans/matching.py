"""Queries: corpora compared by edit distance and by vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from moothall.operators import similarity as sim
from moothall.plans.corpus import NORMAL_TITLE_SQL
from moothall.plans.registry import query, table, view

PART_TITLES = "SELECT p_partkey, p_size, concat(p_name, ' ', p_brand) AS title FROM part"


@query("j1_nearest_by_edit", f"""
SELECT a AS p_partkey, pos AS nearest_right_id, distance FROM (
  SELECT l.p_partkey AS a, r.p_partkey AS pos, levenshtein(lower(l.title), lower(r.title)) AS distance,
         row_number() OVER (PARTITION BY l.p_partkey
                            ORDER BY levenshtein(lower(l.title), lower(r.title)), r.p_partkey) AS rn
  FROM ({PART_TITLES}) l, ({PART_TITLES}) r WHERE l.p_size < 25 AND r.p_size >= 25) m
WHERE rn = 1
""")
def nearest_by_edit(spark, sf_dir):
    """Small parts against large ones; together they are the whole table."""
    parts = view(spark, sf_dir, PART_TITLES)
    right = parts.filter("p_size >= 25").withColumnRenamed("p_partkey", "right_id")
    return sim.nearest_by_edit(parts.filter("p_size < 25"), right, "p_partkey", "right_id", "title")


FAR_TITLE = "translate(lower(title), 'eoi', '301')"


@query("j1_far_by_edit", f"""
SELECT a AS p_partkey, pos AS nearest_right_id, distance FROM (
  SELECT l.p_partkey AS a, r.p_partkey AS pos, levenshtein({FAR_TITLE.replace('title', 'l.title')}, lower(r.title)) AS distance,
         row_number() OVER (PARTITION BY l.p_partkey
                            ORDER BY levenshtein({FAR_TITLE.replace('title', 'l.title')}, lower(r.title)), r.p_partkey) AS rn
  FROM ({PART_TITLES}) l, ({PART_TITLES}) r WHERE l.p_size < 25 AND r.p_size >= 25) m
WHERE rn = 1
""")
def far_by_edit(spark, sf_dir):
    """The same with digits for three vowels, so that the nearest titles are several edits away."""
    parts = view(spark, sf_dir, PART_TITLES)
    right = parts.filter("p_size >= 25").withColumnRenamed("p_partkey", "right_id")
    left = parts.filter("p_size < 25").withColumn("title", F.expr(FAR_TITLE))
    return sim.nearest_by_edit(left, right, "p_partkey", "right_id", "title")


COSINES = """
SELECT q.vec_id AS vec_id, k.vec_id AS key_id,
       list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS sim, q.label AS label
FROM embeddings q, embeddings k WHERE q.label < 5 AND k.label >= 5 {more}
"""
NEAREST = """
SELECT vec_id, arg_max(key_id, {{'sim': sim, 'low': -key_id}}) AS nearest_key_id, round(max(sim), 4) AS sim, any_value(label) AS label
FROM ({cosines}) c GROUP BY vec_id
"""


@query("j2_nearest_by_cosine", f"SELECT vec_id, nearest_key_id, sim FROM ({NEAREST.format(cosines=COSINES.format(more=''))}) n")
def nearest_by_cosine(spark, sf_dir):
    """Vectors of the lower labels against those of the higher ones; together the whole table."""
    vectors = table(spark, sf_dir, "embeddings")
    keys = vectors.filter("label >= 5").withColumnRenamed("vec_id", "key_id")
    nearest = sim.nearest_by_cosine(vectors.filter("label < 5"), keys, "vec_id", "key_id", "embedding")
    return nearest.withColumn("sim", F.round("sim", 4))


@query("j2_grouped", f"SELECT vec_id, nearest_key_id, sim FROM ({NEAREST.format(cosines=COSINES.format(more=''))}) n")
def nearest_in_groups(spark, sf_dir):
    """The same search over groups of keys, as for many keys."""
    vectors = table(spark, sf_dir, "embeddings")
    keys = vectors.filter("label >= 5").withColumnRenamed("vec_id", "key_id")
    nearest = sim.nearest_by_cosine(vectors.filter("label < 5"), keys, "vec_id", "key_id", "embedding", few_blocks=0)
    return nearest.withColumn("sim", F.round("sim", 4))


LEFT_TITLE = """CASE label WHEN 0 THEN 'AITA for it' WHEN 1 THEN 'WIBTA if so' WHEN 2 THEN 'AITA if AITA for' ELSE 'Why' END"""


@query("j3_match_corpora", f"""
SELECT vec_id, nearest_key_id, sim, {NORMAL_TITLE_SQL.format(t='title')} AS title FROM (
  SELECT vec_id, nearest_key_id, sim, {LEFT_TITLE} AS title
  FROM ({NEAREST.format(cosines=COSINES.format(more='AND k.label <> 9'))}) n) t
""")
def match_corpora(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    left = vectors.filter("label < 5").withColumn("title", F.expr(LEFT_TITLE))
    right = vectors.filter("label >= 5").select(
        F.col("vec_id").alias("key_id"), "embedding",
        F.when(F.col("label") == 9, "elsewhere").otherwise("amitheasshole").alias("area"))
    return sim.match_corpora(left, right, "vec_id", "key_id", "embedding").withColumn("sim", F.round("sim", 4))


@query("j7_pair_similarity", """
SELECT round(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity, count(*) AS n_pairs
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def pair_similarity(spark, sf_dir):
    """Each vector paired with its successor."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = vectors.withColumn("vec_id", F.col("vec_id") - 1)
    return sim.pair_similarity(vectors, after, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


def token_pairs(spark, sf_dir):
    """Eight vectors in a row are a text; each text is aligned with the next one."""
    tokens = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("pair_id"), (F.col("vec_id") % 8).alias("pos"), F.col("embedding").alias("vec"))
    return tokens, tokens.withColumn("pair_id", F.col("pair_id") - 1)


@query("j8_soft_align", """
WITH t AS (SELECT vec_id // 8 AS pair_id, vec_id % 8 AS pos, embedding::DOUBLE[] AS v,
                  max(vec_id % 8) OVER (PARTITION BY vec_id // 8) AS last, count(*) OVER (PARTITION BY vec_id // 8) AS size
           FROM embeddings),
best AS (SELECT r.pair_id, r.pos, any_value(r.size) AS size, max(list_cosine_similarity(r.v, c.v)) AS sim
         FROM t r JOIN t c ON c.pair_id = r.pair_id + 1
         WHERE r.pos > 0 AND r.pos < r.last AND c.pos > 0 AND c.pos < c.last GROUP BY r.pair_id, r.pos)
SELECT pair_id, round(sum(sim / size), 6) AS score FROM best GROUP BY pair_id
""")
def soft_align(spark, sf_dir):
    refs, cands = token_pairs(spark, sf_dir)
    return sim.soft_align(refs, cands).withColumn("score", F.round("score", 6))


POOLED = """
SELECT vec_id // 8 AS pair_id, j, avg(embedding[j]::DOUBLE) AS x FROM embeddings, range(1, 65) r(j) GROUP BY 1, 2
"""


@query("r12_changed_similarity", f"""
WITH p AS ({POOLED})
SELECT a.pair_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS similarity
FROM p a JOIN p b ON b.pair_id = a.pair_id + 1 AND a.j = b.j GROUP BY a.pair_id
""")
def changed_similarity(spark, sf_dir):
    old, new = token_pairs(spark, sf_dir)
    return sim.changed_similarity(old, new, "pair_id", "pos", "vec").withColumn("similarity", F.round("similarity", 6))


@query("r12_last_vector_similarity", """
WITH p AS (SELECT vec_id // 8 AS pair_id, arg_max(embedding::DOUBLE[], vec_id) AS v FROM embeddings GROUP BY 1)
SELECT a.pair_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM p a JOIN p b ON b.pair_id = a.pair_id + 1
""")
def last_vector_similarity(spark, sf_dir):
    old, new = token_pairs(spark, sf_dir)
    return sim.changed_similarity(old, new, "pair_id", "pos", "vec", "last").withColumn("similarity", F.round("similarity", 6))
