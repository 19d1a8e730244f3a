"""WARC fixity (3): hash trees over record ranges, compared between replicas.

A replica is an index of records (file, offset, length, digest, record). The offsets of a file
are cut into ranges of fixed size. The hash of a range covers its records in offset order, and
the hash of a parent covers its `FANOUT` children in order, up to one root per file. An audit
compares the roots of two replicas, then only the children of nodes that differ, and at last
the records of differing ranges.

A range holds at most RANGE_BYTES / (smallest record) records and a node FANOUT children, so no
group grows with a file; a file with a third of all records is many ranges. Each level is a
table of the shared folder, so a descent reads levels and never hashes again.

Defined cases: an index row listed twice counts once; a record that one replica lacks is
`missing` (in the copy) or `extra`; records that share an offset are told apart by length and digest; empty replicas
are equal; null urls and bodies hash as empty strings; records without an id go to files by
their digest. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.session import durable

RANGE_BYTES, FANOUT = 1 << 16, 16
PAGES_PER_FILE = 512
INDEX = ("file", "offset", "length", "digest", "record")


def record_bytes(page: Column, url: Column, body: Column) -> Column:
    """A response record of the public WARC 1.0 format."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def index_pages(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html",
                per_file: int = PAGES_PER_FILE) -> DataFrame:
    """The index of the archive that stores pages by id, `per_file` ids in a file, in id order."""
    written = record_bytes(F.col(page), F.col(url), F.col(body))
    rows = pages.select(F.col(page).alias("record"), F.octet_length(written).cast("long").alias("length"),
                        F.sha2(written, 256).alias("digest"))
    spill = F.concat(F.lit("other-"), F.substring("digest", 1, 3))
    by_id = F.format_string("part-%08d", F.floor(F.col("record") / per_file))
    rows = rows.withColumn("file", F.when(F.col("record").isNull(), spill).otherwise(by_id))
    before = W.partitionBy("file").orderBy("record", "digest").rowsBetween(W.unboundedPreceding, -1)  # at most the ids of a file
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*INDEX)


def build_tree(replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (file, node, hash) from the ranges up to one root per file, each a written table."""
    records = replica.select("file", "offset", "length", "digest").distinct()
    entry = F.transform(F.sort_array(F.collect_list(F.struct("offset", "length", "digest"))),
                        lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"]))
    level = durable(records.groupBy("file", F.floor(F.col("offset") / range_bytes).alias("node")).agg(
        F.sha2(F.array_join(entry, ","), 256).alias("hash")))
    levels, top = [level], level.agg(F.max("node")).first()[0] or 0
    while top:
        children = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))),
                               lambda c: F.concat_ws(":", c["node"], c["hash"]))
        level = durable(level.groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(
            F.sha2(F.array_join(children, ","), 256).alias("hash")).withColumnRenamed("parent", "node"))
        levels.append(level)
        top //= fanout
    return levels


def audit(original: DataFrame, copy: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, record, problem) of each record that the replicas do not share."""
    trees = [build_tree(r, range_bytes, fanout) for r in (original, copy)]
    for tree, other in (trees, trees[::-1]):  # a shorter replica gets further roots, which then differ
        while len(tree) < len(other):
            tree.append(tree[-1])
    suspects = None
    for mine, theirs in zip(*(t[::-1] for t in trees)):
        sides = []
        for level in (mine, theirs):
            if suspects is not None:
                level = level.withColumn("up", F.floor(F.col("node") / fanout)).join(
                    suspects.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up")
            sides.append(level)
        joined = sides[0].join(sides[1].withColumnRenamed("hash", "other"), ["file", "node"], "full")
        suspects = durable(joined.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"))
        if suspects.isEmpty():
            break
    in_range = F.floor(F.col("offset") / range_bytes)
    sides = [r.select(*INDEX).distinct().withColumn("node", in_range).join(suspects, ["file", "node"], "left_semi").drop("node")
             for r in (original, copy)]
    identity = ["file", "offset", "length", "digest"]
    alone = [x.join(y, identity, "left_anti") for x, y in (sides, sides[::-1])]
    a, b = (x.select("file", "offset", F.col("record").alias(f"record_{name}"), F.lit(True).alias(name))
            for x, name in zip(alone, "ab"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return a.join(b, ["file", "offset"], "full").select(
        "file", "offset", F.coalesce("record_a", "record_b").alias("record"), problem.alias("problem"))


def op3_merkle_fixity(spark, sf_dir):
    """Pages against a copy with damage at given page numbers: changed bodies, lost and foreign records."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    original = index_pages(pages)
    page = F.col("page_id")
    damaged = index_pages(pages.withColumn("html", F.when(
        (F.pmod(page, F.lit(97)) == 7) & F.col("html").rlike(r"^[\x00-\x7f]"), F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))))
    # Offsets stay those of the original, as in a copy made block by block.
    kept = damaged.filter(F.col("record").isNull() | (F.pmod("record", F.lit(211)) != 5))
    foreign = original.filter(F.pmod("record", F.lit(307)) == 11).select(
        "file", (F.col("offset") + 1).alias("offset"), "length", F.reverse("digest").alias("digest"), "record")
    return audit(durable(original), durable(kept.unionByName(foreign)))


OP3_SQL = """
WITH r AS (SELECT page_id, CAST(floor(page_id / CAST(512 AS DOUBLE)) AS BIGINT) AS f,
  strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) + 8 AS length, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY f ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT printf('part-%08d', f) AS file, "offset", page_id AS record,
       CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS problem FROM o
WHERE page_id % 211 = 5 OR (page_id % 97 = 7 AND regexp_matches(html, '^[\\x00-\\x7f]') AND html[1] <> '?')
UNION ALL SELECT printf('part-%08d', f), "offset" + 1, page_id, 'extra' FROM o WHERE page_id % 307 = 11
"""

QUERIES = {"op3_merkle_fixity": op3_merkle_fixity}
ORACLES = {"op3_merkle_fixity": OP3_SQL}
