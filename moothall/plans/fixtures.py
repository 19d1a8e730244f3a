"""Forum-shaped views of the given tables, in SQL that Spark and DuckDB both run."""

# Comments of a post: users stand for posts, their events for comments. `tag` is the verdict
# the text states; only the checking SQL reads it.
COMMENTS = """
SELECT post_id, idx, ups, ts, tag,
       concat(CASE
         WHEN tag = 'OTHER' THEN CASE idx % 4
           WHEN 0 THEN 'NTA, plainly' WHEN 1 THEN 'You are right, not the ashole'
           WHEN 2 THEN 'YTA at first, but then NTA' ELSE 'nta. Leave it' END
         WHEN tag = 'AUTHOR' THEN CASE idx % 4
           WHEN 0 THEN 'YTA, plainly' WHEN 1 THEN 'Honestly you are the asshole'
           WHEN 2 THEN 'NTA for asking, yet YTA' ELSE 'YTA and not ESH' END
         WHEN tag = 'EVERYBODY' THEN CASE idx % 2 WHEN 0 THEN 'ESH' ELSE 'everyone suck here' END
         WHEN tag = 'NOBODY' THEN 'NAH, a hard case'
         WHEN tag = 'INFO' THEN 'needs mor info'
         ELSE 'what happened then' END, ' c', CAST(idx % 5 AS VARCHAR(20))) AS body
FROM (SELECT user_id AS post_id, event_id AS idx, CAST(round(value * 100) AS BIGINT) AS ups, ts,
             CASE WHEN event_id % 11 = 0 THEN 'none'
                  WHEN event_id % 29 = 0 THEN 'INFO'
                  WHEN event_id % 31 = 0 THEN 'NOBODY'
                  WHEN event_id % 20 < CASE user_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 0 ELSE user_id % 21 END THEN 'OTHER'
                  WHEN event_id % 7 = 0 AND user_id % 3 = 0 THEN 'EVERYBODY'
                  ELSE 'AUTHOR' END AS tag
      FROM events) tagged
"""

# Posts: documents with the removed, empty and edited bodies of a scraped forum.
POSTS = """
SELECT doc_id AS post_id,
       concat('AITA for keeping item ', CAST(doc_id AS VARCHAR(20)), ' from ', source) AS title,
       CASE doc_id % 20 WHEN 0 THEN '[removed]' WHEN 1 THEN '[deleted]' WHEN 2 THEN ''
            WHEN 3 THEN NULL WHEN 4 THEN 'edit: I am the ass'
            WHEN 5 THEN concat(text, chr(10), 'EDIT: ok YTA it is', chr(10), 'thanks')
            ELSE text END AS body
FROM documents
"""

# Long remarks that state a verdict after, and sometimes inside, other text.
REMARKS = """
SELECT conv_id * 1000 + turn AS remark_id, role,
       concat(text, CASE (conv_id + turn) % 7 WHEN 0 THEN ' So NTA. ' WHEN 1 THEN ' YTAH! ' WHEN 2 THEN ' Esh, no? '
              WHEN 3 THEN ' nah or NAHH ' WHEN 4 THEN ' INFO and YNTA ' WHEN 5 THEN ' YTAS, ntah ' ELSE ' none ' END,
              text) AS text
FROM conversations
"""

# Labelled documents; the rarer class 0 is the positive one.
LABELLED = """
SELECT d.doc_id, d.text, d.lang, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS author_wrong
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# Score tables: the first two coordinates of a vector as logits.
SCORES = """
SELECT vec_id, label % 2 AS label, CAST(embedding[{at0}] AS DOUBLE) AS z0,
       CAST(embedding[{at1}] AS DOUBLE) AS z1
FROM embeddings
"""
SPARK_SCORES = SCORES.format(at0=0, at1=1)
DUCK_SCORES = SCORES.format(at0=1, at1=2)

REMOVED = "('[deleted]', '[removed]', '')"


def ordered_key(seed: int, column: str) -> str:
    """The SQL form of the sampling order."""
    return f"md5(concat('{seed}:', CAST({column} AS VARCHAR(20))))"
