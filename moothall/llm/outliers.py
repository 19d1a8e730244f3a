"""Quality rules (6): outliers of robust multivariate statistics, per language and source.

Each text gets counts over all its words, and from them a vector of transformed statistics: the
logarithm of the mean word length and the arcsine roots of the shares of symbols, capitals and
punctuation. For each (language, source) the mean and covariance of the `CORE` share of vectors with the
smallest determinant are estimated: starting from medians and absolute deviations,
concentration steps keep the share of vectors nearest by Mahalanobis distance and estimate
again. A vector is rejected if its distance, with the covariance scaled so that the median distance is that of a
normal sample, is beyond the quantile `LIMIT_Z`. The core is the usual (n + p + 1) / 2 of n vectors in p
dimensions, so that up to almost half of a group may be bad; as half of the vectors estimate a shape coarsely, the
vectors within the normal quantile `REWEIGHT_Z` of it estimate once more. Shares of short texts vary more,
so below `FULL_WORDS` words the covariance grows in inverse proportion to the words.

Texts are read once, by built-in functions, into narrow rows. A group is never gathered: medians and
the cut at the core share come from histograms of fixed size, moments are sums. The
estimates of groups are broadcast while there are at most `BROADCAST_GROUPS`; beyond it rows meet
them in a join on group and salt, with the same result.

Groups with fewer than `LEAST` vectors are estimated together by language, and languages with fewer are taken
together; if even these are fewer, nothing is rejected. Defined cases: a null text has no words; null
language or source is a value of its own; texts without words are not estimated and count as failed by the
base rule; repeated rows count each; an empty table gives no rows. Statistics travel in one struct
column, so other columns may have any name but `__stat`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rule: words, and percent of repeated words
CORE, STEPS = 0.5, 5
REWEIGHT_Z = 1.96
FLOOR = 0.02  # least deviation of a statistic
FULL_WORDS = 200
LIMIT_Z = 6.0
LEAST = 50
GRID, MOST_BUCKET = 256, 4096  # of a statistic's histogram
DISTANCE_GRID = 50  # of a logarithmic distance histogram
BROADCAST_GROUPS = 100_000
SALTS = 64
DIMS = 4
STAT = "__stat"


def chi_square(z: float, dims: int = DIMS) -> float:
    """Quantile of the chi-square distribution at the normal quantile z (Wilson and Hilferty)."""
    return dims * (1 - 2 / (9 * dims) + z * (2 / (9 * dims)) ** 0.5) ** 3


def placed_windows(hashes: str) -> Column:
    """(hash, place) of all windows in hash order, for texts where one occurs twice; else null.

    `hashes` names an array column with one hash per window.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed)


def repeated_words(placed: str) -> Column:
    """Words inside windows of WINDOW words that occur twice or more; `placed` names the column of `placed_windows`."""
    twice = F.filter(F.transform(placed, lambda x, k: F.when(
        (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
    covered = F.aggregate(
        F.sort_array(twice), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n")))["n"]
    return F.when(F.col(placed).isNotNull(), covered).otherwise(0).cast("long")


def with_statistics(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`docs` with the struct `__stat`: group, counts, base verdict and statistic vector."""
    names = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))

    def pairs(name: str, step: int) -> Column:
        """Hash of each element with the one `step` behind."""
        n = F.size(name)
        return F.zip_with(F.slice(name, 1, F.greatest(n - step, F.lit(0))), F.slice(name, step + 1, F.greatest(n - step, F.lit(0))),
                          lambda a, b: F.xxhash64(a, b))

    df = docs.withColumn("__words", F.transform(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    df = df.withColumn("__h2", pairs("__words", 1)).withColumn("__h4", pairs("__h2", 2)).withColumn("__h8", pairs("__h4", 4))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    df = df.withColumn("__lines", lines).withColumn("__placed", placed_windows("__h8")).select(
        *names, F.size("__words").cast("long").alias("__n"), repeated_words("__placed").alias("__rep"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup"),
        F.char_length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long").alias("__chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("__sym"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).alias("__upper"), F.regexp_count(body, F.lit(r"[.,!?;:]")).alias("__punct"))
    n, chars = F.col("__n"), F.col("__chars")
    share = [F.asin(F.sqrt(F.least(F.lit(1.0), F.col(c) / chars))) for c in ("__sym", "__upper", "__punct")]
    vector = F.when(n > 0, F.array(F.ln(chars / n), *share))
    failed = (n < LEAST_WORDS) | (100 * F.col("__rep") > MOST_REPEATED * n)
    # Generated, not projected: filters and joins on it must not repeat the work on the text.
    return df.select(*names, F.explode(F.array(F.struct(
        F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
        n.alias("n_words"), chars.alias("word_chars"), F.col("__sym").alias("n_symbols"), F.col("__dup").alias("n_dup_lines"),
        F.col("__rep").alias("n_repeat_words"), failed.alias("base_failed"), vector.alias("x")))).alias(STAT))


def _bucket(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value * GRID), F.lit(0)), F.lit(MOST_BUCKET)).cast("int")


def _median(histogram: DataFrame, keys: Sequence[str], bucket: str, name: str, share: float = 0.5, more: float = 0.0) -> DataFrame:
    """The first bucket up to which `share` of each key's rows and `more` rows lie; a key has a bounded number of buckets."""
    order = W.partitionBy(*keys).orderBy(bucket)
    upto = histogram.select(*keys, bucket, F.sum("n").over(order).alias("upto"), F.sum("n").over(W.partitionBy(*keys)).alias("all"))
    return upto.filter(F.col("upto") >= F.least(share * F.col("all") + more, F.col("all"))).groupBy(*keys).agg(F.min(bucket).alias(name))


def _units(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, unit): what each group is estimated with; null if there are too few vectors."""
    sizes = durable(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    small = sizes.filter(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("small"))
    joined = sizes.join(small, "lang", "left")
    rest = joined.filter((F.col("n") < least) & (F.col("small") < least)).agg(F.sum("n").alias("n")).first()[0] or 0
    unit = F.when(F.col("n") >= least, F.concat_ws("\n", "lang", "source")).when(
        F.col("small") >= least, F.concat("lang", F.lit("\n\n")))
    if rest >= least:
        unit = F.coalesce(unit, F.lit("\n\n\n"))
    return durable(joined.select("lang", "source", unit.alias("unit")))


def _meet(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, few: bool) -> DataFrame:
    """Join rows to a table of groups: broadcast if there are few, else on group and salt."""
    if few:
        return rows.join(F.broadcast(table), list(keys), "left")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(
        salted, [*keys, "__salt"], "left").drop("__salt")


def _distance(x: Column, mean: Column, factor: Column) -> Column:
    """Squared Mahalanobis distance, by forward substitution in the Cholesky factor (row by row)."""
    z: list[Column] = []
    for i in range(DIMS):
        at = i * (i + 1) // 2
        rest = F.get(x, F.lit(i)) - F.get(mean, F.lit(i))
        for k in range(i):
            rest = rest - F.get(factor, F.lit(at + k)) * z[k]
        z.append(rest / F.get(factor, F.lit(at + i)))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factor(moments: DataFrame) -> DataFrame:
    """(unit, mean, factor) from sums; the factor is the Cholesky root of the covariance with its floor."""
    df = moments
    for i in range(DIMS):
        df = df.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(DIMS):
        for j in range(i + 1):
            value = F.col(f"s{j}_{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            value = F.greatest(value, F.lit(0.0)) + FLOOR * FLOOR if i == j else value
            for k in range(j):
                value = value - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            # A rounding error must not make a variance negative.
            df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(value, F.lit(FLOOR * FLOOR * 1e-3))) if i == j else value / F.col(f"l{j}_{j}"))
    return df.select("unit", F.array(*[f"m{i}" for i in range(DIMS)]).alias("mean"),
                     F.array(*[f"l{i}_{j}" for i in range(DIMS) for j in range(i + 1)]).alias("factor"))


def fit(rows: DataFrame, least: int = LEAST, core: float = CORE, steps: int = STEPS,
        broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(lang, source, mean, factor, scale) per group, from rows with `__stat` that pass the base rule."""
    good = rows.select(f"{STAT}.*").filter(~F.col("base_failed") & F.col("x").isNotNull()).select("lang", "source", "n_words", "x")
    good = durable(good)
    units = _units(good, least)
    few = units.count() <= broadcast_groups
    spread = F.col("x")
    member = durable(_meet(good, units, ["lang", "source"], spread, few).filter("unit IS NOT NULL").select("unit", "n_words", "x"))

    marks = member.select("unit", F.posexplode("x").alias("dim", "v")).groupBy("unit", "dim", _bucket(F.col("v")).alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    marks = durable(marks)
    middle = _median(marks, ["unit", "dim"], "b", "middle")
    away = marks.join(middle, ["unit", "dim"]).groupBy("unit", "dim", F.abs(F.col("b") - F.col("middle")).alias("b")).agg(F.sum("n").alias("n"))
    start = _median(away, ["unit", "dim"], "b", "off").join(middle, ["unit", "dim"]).groupBy("unit").agg(
        F.sort_array(F.collect_list(F.struct("dim", "middle", "off"))).alias("d"))
    zero = F.lit(0.0)
    diagonal = [1.4826 * F.get("d", F.lit(i))["off"] / GRID + FLOOR if i == j else zero for i in range(DIMS) for j in range(i + 1)]
    estimate = durable(start.select("unit", F.array(*[(F.get("d", F.lit(i))["middle"] + 0.5) / GRID for i in range(DIMS)]).alias("mean"),
                                    F.array(*diagonal).alias("factor")))

    # Distances shrink for short texts in the same way as in the verdict.
    def distances(estimate: DataFrame) -> DataFrame:
        met = _meet(member, estimate, ["unit"], spread, few)
        square = _distance(F.col("x"), F.col("mean"), F.col("factor")) * _trust(F.col("n_words"))
        return met.select("unit", "x", F.floor(F.log1p(square) * DISTANCE_GRID).cast("int").alias("b"))

    def histogram(estimate: DataFrame) -> DataFrame:
        return durable(distances(estimate).groupBy("unit", "b").agg(F.count(F.lit(1)).alias("n")))

    def scaled(estimate: DataFrame) -> DataFrame:
        middle = _median(histogram(estimate), ["unit"], "b", "middle")
        return middle.select("unit", (F.expm1((F.col("middle") + 0.5) / DISTANCE_GRID) / chi_square(0.0)).alias("scale"))

    for step in range(steps + 1):
        if step < steps:
            cut = _median(histogram(estimate), ["unit"], "b", "cut", core, (DIMS + 1) / 2)
        else:
            cut = scaled(estimate).select("unit", F.floor(F.log1p(F.col("scale") * chi_square(REWEIGHT_Z)) * DISTANCE_GRID).alias("cut"))
        kept = _meet(distances(estimate), durable(cut), ["unit"], spread, few).filter(F.col("b") <= F.col("cut"))
        v = [F.get("x", F.lit(i)) for i in range(DIMS)]
        sums = [F.sum(v[i]).alias(f"s{i}") for i in range(DIMS)]
        sums += [F.sum(v[j] * v[i]).alias(f"s{j}_{i}") for i in range(DIMS) for j in range(i + 1)]
        estimate = durable(_factor(kept.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *sums)))
    return durable(units.join(estimate.join(scaled(estimate), "unit"), "unit", "left").select("lang", "source", "mean", "factor", "scale"))


def _trust(n_words: Column) -> Column:
    return F.least(F.lit(1.0), n_words / FULL_WORDS)


def judge(rows: DataFrame, fitted: DataFrame, limit_z: float = LIMIT_Z, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """`rows` (with `__stat`) and the column `__kept`."""
    table = fitted.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("mean").alias("__mean"),
                          F.col("factor").alias("__factor"), F.col("scale").alias("__scale"))
    few = fitted.count() <= broadcast_groups
    met = _meet(rows.withColumns({"__lang": F.col(f"{STAT}.lang"), "__source": F.col(f"{STAT}.source")}), table,
                ["__lang", "__source"], F.col(f"{STAT}.x"), few)
    square = _distance(F.col(f"{STAT}.x"), F.col("__mean"), F.col("__factor")) * _trust(F.col(f"{STAT}.n_words")) / F.col("__scale")
    kept = ~F.col(f"{STAT}.base_failed") & F.coalesce(square <= chi_square(limit_z), F.lit(True))
    return met.withColumn("__kept", kept).drop("__lang", "__source", "__mean", "__factor", "__scale")


def drop_outliers(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **settings) -> DataFrame:
    """The documents that pass, all columns kept.

    Texts are read twice, to estimate and to judge, and never shuffled.
    """
    fitted = fit(with_statistics(docs, text, lang, source), **settings)
    return judge(with_statistics(docs, text, lang, source), fitted).filter("__kept").select(*docs.columns)


def op6_quality_outliers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = durable(with_statistics(docs).select("doc_id", STAT))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judge(rows, fit(rows)).select("doc_id", *[f"{STAT}.{c}" for c in counts], F.col("__kept").alias("kept"))


QUERIES = {"op6_quality_outliers": op6_quality_outliers}
ORACLES: dict[str, str] = {}
