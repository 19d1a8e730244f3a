"""URL filters (1): explicit rules first, then the reputation of the host.

Labelled page outcomes (1 for a bad page) are added up per host, registered domain and public
suffix. Each level has a beta-binomial prior around its parent's posterior mean, whose strength
comes from the spread of that level's rates (method of moments); so a host with few labels is
shrunk to its domain, a domain to its suffix and a suffix to all pages. A host is blocked if the
lower posterior bound of its bad rate, mean - z * sd, is above a limit that follows the data: TIMES_BASE times the
bad rate of all labelled pages, MOST_BAD at most. Where hosts do not differ beyond chance, priors are strong and none is blocked.
Public suffixes of two labels are a parameter, with a short list as default.

Everything is expressions, aggregates and equality joins. Rows are narrow; the counts of a host
with a third of all pages are combined before the shuffle, and verdicts come back by a join that
adaptive execution can split. Only three prior strengths and one rate reach the driver.

Defined cases: a null url or one without "://" has an empty host and path, which is a host like
any other; outcomes without a page, or with null in id or outcome, are ignored; several outcomes
of one id count as one, bad if any is; without any outcome nothing is blocked; repeated pages
give repeated rows. Ports, user names and a trailing dot stay in `host` but not in the name
that has the reputation. An address of digits is its own domain under the suffix "ip". Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, MOST_BAD, TIMES_BASE = 1.645, 0.5, 2.0
WEAKEST, STRONGEST = 1.0, 1000.0  # of a prior, in labels
#: Public suffixes of two labels; every other suffix is the last label.
TWO_LABELS = tuple("""
ac.uk co.uk gov.uk org.uk ac.jp co.jp or.jp com.au net.au org.au com.br com.cn com.mx com.tr com.tw co.in co.kr co.nz co.za
""".split())


class Rule(NamedTuple):
    """`place` is a host and a path prefix, as in "example.org/en/"; it fits subdomains too."""

    verdict: str
    place: str


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
         Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (place, verdict), or null. Rules are literals of the plan."""
    def fits(place: str) -> Column:
        name, slash, rest = place.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    longest_first = sorted(rules, key=lambda r: (-len(r.place), r.place, r.verdict))
    return F.coalesce(*[F.when(fits(r.place), F.struct(F.lit(r.place).alias("place"), F.lit(r.verdict).alias("verdict")))
                        for r in longest_first], F.lit(None).cast("struct<place:string,verdict:string>"))


def name_levels(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> tuple[Column, Column, Column]:
    """(name, registered domain, public suffix) of a host."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")
    labels = F.split(name, r"\.")
    is_address = name.rlike(r"^[0-9.]+$|^\[|:")
    last_two = F.substring_index(name, ".", -2)
    long_suffix = last_two.isin(*two_labels)
    suffix = F.when(is_address, "ip").when(long_suffix, last_two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(is_address | (F.size(labels) <= 2), name).when(long_suffix, F.substring_index(name, ".", -3)).otherwise(last_two)
    return name, domain, suffix


def _strength(nodes: DataFrame) -> float:
    """Prior strength of one level: nodes have n labels, x bad ones and the parent's `mean`.

    With one intra-class correlation r, the sum of n (x/n - mean)^2 / (mean (1 - mean)) is
    expected to be k + r (N - k) over k nodes with N labels; the strength is 1/r - 1.
    """
    m = F.col("mean")
    spread = F.col("n") * F.pow(F.col("x") / F.col("n") - m, 2) / (m * (1 - m))
    row = nodes.filter("n > 0").agg(F.sum(spread).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if not row.k or row.n <= row.k:
        return STRONGEST
    r = min(max((row.s - row.k) / (row.n - row.k), 1 / (STRONGEST + 1)), 1 / (WEAKEST + 1))
    return 1 / r - 1


def reputation(pages: DataFrame, outcomes: DataFrame, page: str, url: str, outcome_page: str, bad: str,
               two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """(name, n, x, alpha, beta, base): every host name of `pages` with its labels and posterior, and the rate of all pages."""
    host, _ = host_and_path(F.col(url))
    named = pages.select(F.col(page).alias("page"), *[c.alias(a) for c, a in zip(name_levels(host, two_labels), ("name", "domain", "suffix"))])
    labelled = outcomes.select(F.col(outcome_page).alias("page"), F.col(bad).cast("long").alias("bad")).dropna().groupBy(
        "page").agg(F.max("bad").alias("bad"))
    hosts = durable(named.join(labelled, "page", "left").groupBy("name", "domain", "suffix").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    mean = base = F.lit(((total.x or 0) + 0.5) / ((total.n or 0) + 1.0))
    means = None
    for key in ("suffix", "domain"):
        parent = ["suffix"] if key == "domain" else []
        nodes = hosts.groupBy(*parent, key).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        nodes = nodes.withColumn("mean", mean) if means is None else nodes.join(means, parent)
        nodes = durable(nodes)
        strength = _strength(nodes)
        posterior = (F.col("x") + strength * F.col("mean")) / (F.col("n") + strength)
        means = nodes.select(*parent, key, posterior.alias("mean"))
    level = durable(hosts.join(means, ["suffix", "domain"]))
    strength = _strength(level)
    return level.select("name", "n", "x", (F.col("x") + strength * F.col("mean")).alias("alpha"),
                        (F.col("n") - F.col("x") + strength * (1 - F.col("mean"))).alias("beta"), base.alias("base"))


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """Lower bound of a beta-distributed rate, by its mean and standard deviation."""
    total = alpha + beta
    return alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, page: str = "page_id", url: str = "url", outcome_page: str = "page_id",
          bad: str = "bad", rules: Sequence[Rule] = RULES, z: float = Z, most_bad: float = MOST_BAD,
          times_base: float = TIMES_BASE, two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labels, n_bad) per row of `pages`."""
    limit = F.least(F.lit(most_bad), times_base * F.col("base"))
    known = reputation(pages, outcomes, page, url, outcome_page, bad, two_labels).select(
        "name", "n", "x", F.when(lower_bound(F.col("alpha"), F.col("beta"), z) > limit, "block").otherwise("allow").alias("by_host"))
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("name", name_levels(F.col("host"))[0]).withColumn(
        "fit", first_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(known, "name", "left").select(
        "page_id", "host", "path", F.col("fit.place").alias("rule"),
        F.coalesce("fit.verdict", "by_host").alias("verdict"), F.col("n").alias("n_labels"), F.col("x").alias("n_bad"))


def op1_url_reputation(spark, sf_dir):
    """The labelled outcome of a page is the label row of its number: bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when(
        (F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return judge(pages, outcomes)


def _sql() -> str:
    def fits(place):
        name, _, rest = place.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}'))"

    ordered = sorted(RULES, key=lambda r: -len(r.place))
    rule = "CASE " + " ".join(f"WHEN {fits(r.place)} THEN '{r.place}'" for r in ordered) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r.place}' THEN '{r.verdict}'" for r in ordered) + " END"
    two = ", ".join(f"'{s}'" for s in TWO_LABELS)

    def strength(table):
        r = f"(sum(n * pow(x / CAST(n AS DOUBLE) - mean, 2) / (mean * (1 - mean))) - count(*)) / CAST(sum(n) - count(*) AS DOUBLE)"
        return (f"(SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN CAST({STRONGEST} AS DOUBLE) ELSE "
                f"1 / least(greatest({r}, 1 / CAST({STRONGEST + 1} AS DOUBLE)), 1 / CAST({WEAKEST + 1} AS DOUBLE)) - 1 END AS k "
                f"FROM {table} WHERE n > 0)")

    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
nm AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\\.$', '') AS name FROM s),
sp AS (SELECT *, string_split(name, '.') AS labels, regexp_matches(name, '^[0-9.]+$|^\\[|:') AS addr FROM nm),
lt AS (SELECT *, array_to_string(labels[greatest(len(labels) - 1, 1):], '.') AS two FROM sp),
p AS (SELECT page_id, host, path, name,
             CASE WHEN addr THEN 'ip' WHEN two IN ({two}) THEN two ELSE labels[len(labels)] END AS suffix,
             CASE WHEN addr OR len(labels) <= 2 THEN name
                  WHEN two IN ({two}) THEN array_to_string(labels[len(labels) - 2:], '.') ELSE two END AS domain FROM lt),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT name, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM p LEFT JOIN o ON p.page_id = o.page_id GROUP BY ALL),
m0 AS (SELECT (sum(x) + CAST(0.5 AS DOUBLE)) / (sum(n) + CAST(1 AS DOUBLE)) AS mean FROM h),
su AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT mean FROM m0) AS mean FROM h GROUP BY suffix),
ks AS {strength('su')},
sm AS (SELECT suffix, (x + k * mean) / (n + k) AS mean FROM su, ks),
dm AS (SELECT g.suffix, domain, n, x, mean FROM (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h GROUP BY suffix, domain) g
       JOIN sm ON g.suffix = sm.suffix),
kd AS {strength('dm')},
dd AS (SELECT suffix, domain, (x + k * mean) / (n + k) AS mean FROM dm, kd),
hm AS (SELECT name, n, x, mean FROM h JOIN dd ON h.suffix = dd.suffix AND h.domain = dd.domain),
kh AS {strength('hm')},
ab AS (SELECT name, n, x, x + k * mean AS al, n - x + k * (1 - mean) AS be FROM hm, kh),
v AS (SELECT name, n, x, CASE WHEN al / (al + be) - CAST({Z} AS DOUBLE) * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1)))
                                > least(CAST({MOST_BAD} AS DOUBLE), CAST({TIMES_BASE} AS DOUBLE) * m0.mean)
                   THEN 'block' ELSE 'allow' END AS by_host FROM ab, m0),
r AS (SELECT p.page_id, host, path, {rule} AS rule, by_host, n, x FROM p JOIN v ON p.name = v.name)
SELECT page_id, host, path, rule, coalesce({verdict}, by_host) AS verdict, CAST(n AS BIGINT) AS n_labels, CAST(x AS BIGINT) AS n_bad FROM r
"""


QUERIES = {"op1_url_reputation": op1_url_reputation}
ORACLES = {"op1_url_reputation": _sql()}
