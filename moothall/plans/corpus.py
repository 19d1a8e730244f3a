"""Queries: verdict extraction, tally and the constructed corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moothall.functions import rules
from moothall.functions import text as tx
from moothall.operators import filters, tally
from moothall.plans.fixtures import COMMENTS, POSTS, REMARKS, REMOVED
from moothall.plans.registry import query, table, view

def labelled_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tally.label_comments(view(spark, sf_dir, COMMENTS))


def construct(posts: DataFrame, comments: DataFrame, min_comments: int = 10,
              least_agreement: float = 0.9) -> DataFrame:
    """Posts with an agreed verdict: title, scrubbed body, best comment and binary label."""
    verdicts = tally.best_comment(comments, min_comments, least_agreement)
    joined = posts.join(verdicts, "post_id")
    return filters.drop_gone(joined).select(
        "post_id", "title", "body", F.col("best_comment").alias("comment"), "author_wrong")


TALLY_SQL = f"""
SELECT post_id, count(*) AS n_valid,
       CAST(sum(CASE WHEN tag = 'AUTHOR' THEN 1 ELSE 0 END) AS BIGINT) AS n_author,
       CAST(sum(CASE WHEN tag = 'OTHER' THEN 1 ELSE 0 END) AS BIGINT) AS n_other,
       CAST(sum(CASE WHEN tag = 'EVERYBODY' THEN 1 ELSE 0 END) AS BIGINT) AS n_everybody,
       CAST(sum(CASE WHEN tag = 'NOBODY' THEN 1 ELSE 0 END) AS BIGINT) AS n_nobody,
       CAST(sum(CASE WHEN tag = 'INFO' THEN 1 ELSE 0 END) AS BIGINT) AS n_info
FROM ({COMMENTS}) c WHERE tag <> 'none' GROUP BY post_id
"""

ADMITTED_SQL = f"""
SELECT post_id, n_valid, CASE WHEN n_author > n_other THEN 1 ELSE 0 END AS author_wrong,
       CAST(greatest(n_author, n_other) AS DOUBLE) / n_valid AS agreement
FROM ({TALLY_SQL}) t
WHERE n_valid >= 10 AND CAST(greatest(n_author, n_other) AS DOUBLE) / n_valid >= CAST(0.9 AS DOUBLE)
"""

BEST_SQL = f"""
SELECT post_id, author_wrong, n_valid, body AS comment FROM (
  SELECT w.post_id, w.author_wrong, w.n_valid, d.body,
         row_number() OVER (PARTITION BY w.post_id ORDER BY d.ups DESC, d.pos DESC) AS rn
  FROM ({ADMITTED_SQL}) w JOIN (
    SELECT post_id, tag, body, max_by(ups, idx) AS ups, min(idx) AS pos
    FROM ({COMMENTS}) c GROUP BY post_id, tag, body) d
  ON d.post_id = w.post_id AND d.tag = CASE WHEN w.author_wrong = 1 THEN 'AUTHOR' ELSE 'OTHER' END
) ranked WHERE rn = 1
"""

SCRUB_SQL = r"regexp_replace(body, '(edit|update).*?(YTA|a-|ass|\sta\s)(.*)', '', 'gi')"

CLEAN_SQL = f"""
SELECT post_id, title, clean_body FROM (
  SELECT post_id, title, {SCRUB_SQL} AS clean_body FROM ({POSTS}) p
  WHERE body IS NULL OR body <> '[removed]') s
WHERE clean_body IS NULL OR clean_body NOT IN {REMOVED}
"""


@query("construct_corpus", f"""
SELECT b.post_id, c.title, md5(c.clean_body) AS body_md5, b.comment, b.author_wrong
FROM ({BEST_SQL}) b JOIN ({CLEAN_SQL}) c ON b.post_id = c.post_id
""")
def construct_corpus(spark, sf_dir):
    corpus = construct(view(spark, sf_dir, POSTS), labelled_comments(spark, sf_dir))
    return corpus.select("post_id", "title", F.md5("body").alias("body_md5"), "comment", "author_wrong")


@query("a1_verdict_tally", TALLY_SQL)
def verdict_tally(spark, sf_dir):
    return tally.tally(labelled_comments(spark, sf_dir))


@query("a2_agreement", f"""
SELECT post_id, round(CASE WHEN n_valid < 10 THEN CAST(0 AS DOUBLE)
       ELSE CAST(greatest(n_author, n_other) AS DOUBLE) / n_valid END, 6) AS agreement
FROM ({TALLY_SQL}) t
""")
def agreement(spark, sf_dir):
    return tally.tally(labelled_comments(spark, sf_dir)).select(
        "post_id", F.round(tally.agreement(), 6).alias("agreement"))


@query("a3_majority", f"""
SELECT post_id, CASE WHEN n_author > n_other THEN 1 ELSE 0 END AS author_wrong FROM ({TALLY_SQL}) t
""")
def majority(spark, sf_dir):
    return tally.tally(labelled_comments(spark, sf_dir)).select(
        "post_id", tally.majority().alias("author_wrong"))


@query("a4_best_comment", BEST_SQL)
def best_comment(spark, sf_dir):
    return tally.best_comment(labelled_comments(spark, sf_dir)).select(
        "post_id", "author_wrong", "n_valid", F.col("best_comment").alias("comment"))


@query("p2_admitted_posts", f"""
SELECT post_id, n_valid, author_wrong, round(agreement, 6) AS agreement FROM ({ADMITTED_SQL}) a
""")
def admitted_posts(spark, sf_dir):
    return tally.admit(tally.tally(labelled_comments(spark, sf_dir))).select(
        "post_id", "n_valid", "author_wrong", F.round("agreement", 6).alias("agreement"))


@query("a5_stage_counts", f"""
SELECT 'scraped' AS stage, count(*) AS n_rows FROM ({POSTS}) p
UNION ALL SELECT 'cleaned', count(*) FROM ({CLEAN_SQL}) c
UNION ALL SELECT 'admitted', count(*) FROM ({ADMITTED_SQL}) a
UNION ALL SELECT 'constructed', count(*) FROM ({BEST_SQL}) b JOIN ({CLEAN_SQL}) c ON b.post_id = c.post_id
""")
def stage_counts(spark, sf_dir):
    posts, comments = view(spark, sf_dir, POSTS), labelled_comments(spark, sf_dir)
    return filters.stage_counts(
        scraped=posts, cleaned=filters.drop_gone(posts),
        admitted=tally.admit(tally.tally(comments)), constructed=construct(posts, comments))


def word_regex(acronym: str, before: str = "") -> str:
    """Whole-word match for an engine whose word boundaries know ASCII letters only."""
    edge = r"[^\pL\pN\pM_]"
    return f"(?is){before}(^|{edge})(?:{acronym})($|{edge})"


@query("l1_exact_acronyms", " UNION ALL ".join(
    f"SELECT remark_id, '{r.name}' AS verdict FROM ({REMARKS}) t "
    f"WHERE regexp_matches(text, '{word_regex(r.acronym)}')" for r in rules.VERDICT_RULES))
def exact_acronyms(spark, sf_dir):
    """Remarks that hold a verdict acronym as a whole word, one row per verdict."""
    hits = [F.when(F.col("text").rlike(rules.exact_rule(r.acronym)), F.lit(r.name)) for r in rules.VERDICT_RULES]
    return view(spark, sf_dir, REMARKS).select(
        "remark_id", F.explode(F.array_compact(F.array(*hits))).alias("verdict"))


@query("l2_fuzzy_phrases", f"""
SELECT idx, CASE WHEN tag = 'AUTHOR' THEN 'AUTHOR' WHEN tag = 'OTHER' THEN 'OTHER'
                 WHEN tag = 'INFO' THEN 'INFO' ELSE 'EVERYBODY' END AS verdict
FROM ({COMMENTS}) c
WHERE (tag IN ('AUTHOR', 'OTHER') AND idx % 4 = 1) OR (tag = 'EVERYBODY' AND idx % 2 = 1) OR tag = 'INFO'
""")
def fuzzy_phrases(spark, sf_dir):
    """Comments that state a verdict in words, with up to one typing error."""
    folded = rules.fold_case(F.col("body"))
    hits = []
    for rule in rules.VERDICT_RULES:
        for p in rule.phrases:
            gate = folded.contains(p.needles[0]) | folded.contains(p.needles[1])
            hits.append(F.when(gate & F.col("body").rlike(rules.phrase_regex(p)), F.lit(rule.name)))
    return view(spark, sf_dir, COMMENTS).select(
        "idx", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("verdict"))


@query("l3_first_spans", " UNION ALL ".join(f"""
SELECT remark_id, '{r.name}' AS verdict,
       length(regexp_extract(text, '{word_regex(r.acronym, "^(.*?)")}', 1))
       + length(regexp_extract(text, '{word_regex(r.acronym, "^(.*?)")}', 2)) AS start
FROM ({REMARKS}) t WHERE regexp_matches(text, '{word_regex(r.acronym)}')""" for r in rules.VERDICT_RULES))
def first_spans(spark, sf_dir):
    """Where each verdict is first stated, counted in characters."""
    spans = [F.struct(F.lit(r.name).alias("verdict"), rules.first_span(F.col("text"), r)["start"].alias("start"))
             for r in rules.VERDICT_RULES]
    return (view(spark, sf_dir, REMARKS)
            .select("remark_id", F.explode(F.array(*spans)).alias("s"))
            .select("remark_id", "s.verdict", "s.start").filter("start IS NOT NULL"))


VERDICT_SQL = f"SELECT idx, CASE WHEN tag = 'none' THEN NULL ELSE tag END AS verdict FROM ({COMMENTS}) c"


@query("l4_extract_verdict", VERDICT_SQL)
def extract_verdict(spark, sf_dir):
    return labelled_comments(spark, sf_dir).select("idx", "verdict")


@query("l5_contradictions", f"""
SELECT idx FROM ({COMMENTS}) c WHERE tag IN ('AUTHOR', 'OTHER') AND idx % 4 = 2
""")
def contradictions(spark, sf_dir):
    """Comments with a word of contradiction."""
    return view(spark, sf_dir, COMMENTS).filter(rules.has_contradiction(F.col("body"))).select("idx")


@query("t10_binarise", f"""
SELECT idx, CASE WHEN tag IN ('OTHER', 'NOBODY') THEN 0 WHEN tag IN ('AUTHOR', 'EVERYBODY') THEN 1 END AS author_wrong
FROM ({COMMENTS}) c
""")
def binarise(spark, sf_dir):
    return labelled_comments(spark, sf_dir).select("idx", rules.binarise(F.col("verdict")).alias("author_wrong"))


@query("t1_scrub_spoilers", f"SELECT post_id, md5({SCRUB_SQL}) AS scrubbed FROM ({POSTS}) p")
def scrub_spoilers(spark, sf_dir):
    return view(spark, sf_dir, POSTS).select("post_id", F.md5(tx.scrub_spoilers(F.col("body"))).alias("scrubbed"))


@query("p1_drop_gone", f"SELECT post_id, title, md5(clean_body) AS body_md5 FROM ({CLEAN_SQL}) c")
def drop_gone(spark, sf_dir):
    return filters.drop_gone(view(spark, sf_dir, POSTS)).select("post_id", "title", F.md5("body").alias("body_md5"))


@query("p5_drop_blank", f"SELECT post_id, length(body) AS n_chars FROM ({POSTS}) p WHERE body IS NOT NULL")
def drop_blank(spark, sf_dir):
    return filters.drop_blank(view(spark, sf_dir, POSTS), "body").select("post_id", F.length("body").alias("n_chars"))


@query("p8_compose_input", f"""
SELECT post_id, md5(title) AS title_only, md5(body) AS body_only, md5(title || ' ' || body) AS both_columns,
       md5(title || body) AS glued
FROM ({POSTS}) p WHERE body IS NOT NULL
""")
def compose_input(spark, sf_dir):
    return filters.drop_blank(view(spark, sf_dir, POSTS), "body").select(
        "post_id", F.md5(tx.compose_input("title")).alias("title_only"),
        F.md5(tx.compose_input("body")).alias("body_only"), F.md5(tx.compose_input()).alias("both_columns"),
        F.md5(tx.compose_input("both", sep="")).alias("glued"))


@query("t2_safe_key", r"""
SELECT page_id, regexp_replace(substr(concat(CAST(page_id AS VARCHAR), '_', replace(replace(replace(replace(replace(
  replace(replace(replace(replace(replace(url, ' ', '_'), '<', '[less]'), '>', '[greater]'), ':', '[colon]'),
  '"', '[quote]'), '/', '[forward_slash]'), '\', '[backslash]'), '|', '[pipe]'), '?', '[qmark]'),
  '*', '[asterisk]')), 1, 150), '[^\x{0}-\x{FF}]', '?', 'g') AS post_key
FROM pages
""")
def safe_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_key(F.col("page_id"), F.col("url")).alias("post_key"))


@query("t3_remove_phrase", "SELECT doc_id, md5(replace(text, 'the ', '')) AS rest FROM documents")
def remove_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.remove_phrase(F.col("text"), "the ")).alias("rest"))


NORMAL_TITLE_SQL = """
CASE WHEN contains(lower({t}), 'aita for') THEN replace(lower({t}), 'aita for', '')
     WHEN contains(lower({t}), 'wibta if') THEN replace(lower({t}), 'wibta if', '')
     WHEN contains(lower({t}), 'aita if') THEN replace(lower({t}), 'aita if', '')
     WHEN contains(lower({t}), 'wibta for') THEN replace(lower({t}), 'wibta for', '') ELSE lower({t}) END
"""
TITLES = """
SELECT p_partkey, concat(CASE p_size % 6 WHEN 0 THEN 'AITA for ' WHEN 1 THEN 'WIBTA if ' WHEN 2 THEN 'Aita if '
       WHEN 3 THEN 'WIBTA for ' WHEN 4 THEN 'WIBTA if AITA for ' ELSE 'So ' END, p_name, ' ', p_type) AS title
FROM part
"""


@query("t4_normalise_title", f"SELECT p_partkey, {NORMAL_TITLE_SQL.format(t='title')} AS title FROM ({TITLES}) t")
def normalise_title(spark, sf_dir):
    return view(spark, sf_dir, TITLES).select("p_partkey", tx.normalise_title(F.col("title")).alias("title"))


@query("t5_fold_strip_split", """
SELECT conv_id, turn, md5(lower(regexp_replace(text, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g'))) AS folded,
       array_to_string(string_split(text, ' '), '_') = replace(text, ' ', '_') AS rejoined
FROM conversations
""".replace("\\\\", "\\"))
def fold_strip_split(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.md5(F.lower(tx.strip(F.col("text")))).alias("folded"),
        (F.array_join(F.split("text", " "), "_") == F.replace("text", F.lit(" "), F.lit("_"))).alias("rejoined"))


@query("t6_replace_kth", """
WITH parts AS (SELECT p_partkey, p_name, strpos(p_name, 'e') AS first FROM part),
     second AS (SELECT *, CASE WHEN first > 0 AND strpos(substr(p_name, first + 1), 'e') > 0
                               THEN first + strpos(substr(p_name, first + 1), 'e') END AS place FROM parts)
SELECT p_partkey, CASE WHEN place IS NULL THEN p_name
       ELSE concat(substr(p_name, 1, place - 1), '#', substr(p_name, place + 1)) END AS name
FROM second
""")
def replace_kth(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.replace_kth(F.col("p_name"), "e", "#", 2).alias("name"))


@query("t9_mask_phrase", """
SELECT doc_id, md5(replace(replace(text, ' the ', '<mask>'), '<mask>', ' <mask> ')) AS masked FROM documents
""")
def mask_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.mask_phrase(F.col("text"), "the")).alias("masked"))
