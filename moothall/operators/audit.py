"""Robustness audit of classifiers by word substitution, as batch jobs.

A scorer is a function (texts, keys, text) -> (keys, logits); any row model can be wrapped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from moothall.functions import vectors as vec
from moothall.functions.text import mask_phrase, strip
from moothall.operators.features import STOP_WORDS
from moothall.operators.skew import common_join, skew_join
from moothall.session import durable, let_go, scratch_path, scratch_scope

Scorer = Callable[[DataFrame, Sequence[str], str], DataFrame]

# ---- fixed values: settings of the audited attack recipes ----
TOP_K = 30
MAX_CANDIDATES = 100
MAX_CHANGED = 0.4
MIN_COSINE_WINDOWED, WINDOW = 0.936338023, 15
MIN_COSINE = 0.2
KAPPA = 5.0
# ---- end of fixed values ----

VARIANT_BYTES = 4 << 20  # of changed texts, in one call of a scorer
ROUND_CHARS = 1 << 29  # of text whose word pairs are looked up at a time
FIRST_ROUND, GROWTH = 4, 4  # candidates of a text that are tried at first, and how fast rounds grow


# ---- scorers ----

def batch_scorer(fn: Callable[[pd.Series], list]) -> Scorer:
    """Wrap a function from a batch of texts to a list of logit rows."""

    def score(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[list(keys)].assign(logits=list(fn(batch[text])))

        selected = df.select(*keys, text)
        fields = ", ".join(f"`{c}` {t}" for c, t in selected.select(*keys).dtypes)
        return selected.mapInPandas(run, f"{fields}, logits array<double>")

    score.batch = fn  # for jobs that build their texts where they are scored
    return score


def words_of(text: Column) -> Column:
    """Lower-case words between blanks, without the marks around them."""
    cut = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}'<>]+", " "), " ")
    return F.filter(cut, lambda w: w != "")


def linear_scorer(weights: DataFrame, bias: float = 0.0, places: int | None = None) -> Scorer:
    """Logits [0, bias + sum of word weights]; (word, weight, n_rows) with n_rows the word's uses.

    With `places` the sum is rounded, as floating sums depend on their order.
    """

    def score(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
        used = df.select(*keys, F.explode(words_of(F.col(text))).alias("word")).groupBy(*keys, "word").agg(
            F.count(F.lit(1)).alias("_n"))
        weighed = skew_join(used, weights.select("word", "weight"), ["word"], list(keys), counts=weights)
        sums = weighed.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("weight")).alias("_sum"))
        return df.select(*keys).join(sums, list(keys), "left").select(*keys, logits(F.coalesce(F.col("_sum"), F.lit(0.0))).alias("logits"))

    def logits(total: Column) -> Column:
        total = total + F.lit(bias)
        return F.array(F.lit(0.0), total if places is None else F.round(total, places))

    score.weights, score.logits = weights, logits  # for jobs that add up the words of a text by themselves
    return score


# ---- target selection ----

def role_spans(df: DataFrame, text_id: str, description: str, role: str, mode: str = "parity") -> DataFrame:
    """Distinct (text_id, phrase) of one role in tagged sentences `… [ROLE: words] …`.

    `parity` reads blank-separated tokens from the second one on: one with `[` opens a span
    anew, one with `]` closes an open span, so a span of one token does not close on itself.
    `strict` reads every bracket.
    """
    if mode == "strict":
        found = F.regexp_extract_all(F.col(description), F.lit(rf"\[{role}\s*:([^\]:]*)"), F.lit(1))
        phrases = F.transform(found, strip)
    elif mode == "parity":
        parts = F.slice(F.split(strip(F.col(description)), r"(?U)\s+"), 2, 1 << 30)
        state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

        def step(acc: Column, part: Column) -> Column:
            grown = F.concat(acc["open"], F.lit(" "), part)
            opens, closes, idle = part.contains("["), part.contains("]"), acc["open"] == ""
            return F.struct(
                F.when(opens, part).when(idle | closes, F.lit("")).otherwise(grown).alias("open"),
                F.when(~opens & ~idle & closes, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"))

        spans = F.transform(F.aggregate(parts, state, step)["done"], lambda s: F.split(F.substr(s, F.lit(2), F.length(s) - 2), ":"))
        wanted = F.filter(spans, lambda s: strip(s[0]) == role)
        phrases = F.transform(wanted, lambda s: strip(F.get(s, F.lit(1))))
    else:
        raise ValueError(f"unknown mode {mode}")
    return df.select(text_id, F.explode(phrases).alias("phrase")).filter("phrase IS NOT NULL").distinct()


# ---- candidates ----

CONTEXT_BITS = 1 << 26


def context_bits(contexts: DataFrame) -> DataFrame:
    """A bitmap of the hashes of (before, after) rows, 64 bits a row and at most a million rows."""
    at = F.pmod(F.xxhash64("before", "after"), F.lit(CONTEXT_BITS))
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    return contexts.select(at.alias("_at")).select(F.floor(F.col("_at") / 64).alias("_line"), bit.alias("_bit")).groupBy("_line").agg(
        F.bit_or("_bit").alias("_bits"))


def mask_slots(masked: DataFrame, keys: Sequence[str], text: str = "masked", mask: str = "<mask>") -> DataFrame:
    """(keys, before, after) of every mask."""
    words = words_of(F.col(text))
    spots = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) == mask)
    return (masked.select(*keys, words.alias("w")).filter(F.size("w") > 0)
            .select(*keys, F.explode(F.transform(spots, lambda i: F.struct(
                F.get("w", i - 1).alias("before"), F.get("w", i + 1).alias("after")))).alias("s"))
            .select(*keys, "s.before", "s.after"))


def neighbour_counts(texts: DataFrame, text: str, contexts: DataFrame | None = None) -> DataFrame:
    """(before, word, after, n) over all texts; words come from each row's own array, unshuffled.

    With `contexts` (before, after) most triples of other contexts are left out before anything moves, by a bitmap of
    hashes; all triples of the given contexts are counted.
    """
    words = words_of(F.col(text))
    inner = F.when(F.size("w") > 2, F.sequence(F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<int>"))
    triples = F.transform(inner, lambda i: F.struct(
        F.get("w", i - 1).alias("before"), F.get("w", i).alias("word"), F.get("w", i + 1).alias("after")))
    found = texts.select(words.alias("w")).select(F.explode(triples).alias("t")).select("t.*")
    if contexts is not None:
        at = F.pmod(F.xxhash64("before", "after"), F.lit(CONTEXT_BITS))
        marked = found.withColumn("_at", at).withColumn("_line", F.floor(F.col("_at") / 64))
        bit = F.expr("shiftright(_bits, cast(_at % 64 as int)) & 1L")
        found = marked.join(F.broadcast(durable(context_bits(contexts))), "_line").filter(bit == 1).select("before", "word", "after")
    return found.groupBy("before", "word", "after").agg(F.count(F.lit(1)).alias("n"))


def fillers(masked: DataFrame, neighbours: DataFrame, keys: Sequence[str], text: str = "masked", mask: str = "<mask>",
            top_k: int = TOP_K, cap: int = MAX_CANDIDATES) -> DataFrame:
    """R2: (keys, word, n, rank): the best fillers of every mask slot, best `cap` per row.

    The k best words of a context are chosen once per context, before any text meets them.
    """
    slots = mask_slots(masked, keys, text, mask)
    counts = slots.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n_rows"))
    best = W.partitionBy("before", "after").orderBy(F.desc("n"), "word")
    asked = neighbours.join(counts, ["before", "after"], "left_semi")
    ranked = asked.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= top_k)
    lists = ranked.groupBy("before", "after").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    filled = skew_join(slots, lists, ["before", "after"], list(keys), counts=counts).select(*keys, F.explode("words").alias("c"))
    merged = filled.groupBy(*keys, F.col("c.word").alias("word")).agg(F.max("c.n").alias("n"))
    order = W.partitionBy(*keys).orderBy(F.desc("n"), "word")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def mask_targets(texts: DataFrame, targets: DataFrame, text_id: str, text: str) -> DataFrame:
    """(text_id, phrase, masked) for targets found in their text; each starts from the original."""
    masked = mask_phrase(F.col(text), F.col("phrase"))
    joined = texts.select(text_id, text).join(targets, text_id)
    return joined.select(text_id, "phrase", masked.alias("masked")).filter(F.col("masked").contains("<mask>"))


def first_flip(texts: DataFrame, masked: DataFrame, candidates: DataFrame, scorer: Scorer, text_id: str,
               text: str, target: int = -1) -> DataFrame:
    """Per text the first candidate that changes the prediction, or nulls.

    A candidate fills every slot of its target; candidates are tried in the order (phrase, rank). With `target`
    the prediction must become that class. Rounds try FIRST_ROUND candidates of each text, then GROWTH times as many as
    before; a text whose prediction changed leaves, so few candidates behind the first flip are scored, in about
    log(candidates) batches. The candidates of one text are ordered together (at most targets x cap). A linear scorer
    builds no changed texts: a masked text is scored once, and each of its candidates adds its own words.
    """
    clean = durable(scorer(texts, [text_id], text).select(text_id, vec.argmax(F.col("logits")).alias("clean")))
    if hasattr(scorer, "weights") and masked.filter(~_apart(F.col("masked"))).isEmpty():
        return _first_flip_by_words(clean, masked, candidates, scorer, text_id, target)
    order = W.partitionBy(text_id).orderBy("phrase", "rank")
    numbered = masked.join(candidates.select(text_id, "phrase", "rank", "word"), [text_id, "phrase"])
    tried = durable(numbered.withColumn("_try", F.row_number().over(order)))
    last = tried.agg(F.max("_try")).first()[0] or 0
    changed = F.replace("masked", F.lit("<mask>"), F.col("word"))
    left, won, low, width = clean.select(text_id), [], 1, FIRST_ROUND
    while low <= last:
        asked = tried.filter(F.col("_try").between(low, low + width - 1)).join(left, text_id, "left_semi")
        texts_asked = asked.select(text_id, "_try", changed.alias("changed"))
        scored = scorer(texts_asked, [text_id, "_try"], "changed").join(clean, text_id)
        flipped = scored.filter(goal(F.col("logits"), F.col("clean"), target))
        won.append(durable(flipped.groupBy(text_id).agg(F.min("_try").alias("_try"))))
        left = durable(left.join(won[-1], text_id, "left_anti"))
        low, width = low + width, GROWTH * width
    if not won:
        return clean.select(text_id, "clean", *(F.lit(None).cast("string").alias(c) for c in ("phrase", "word", "changed")))
    firsts = won[0]
    for more in won[1:]:
        firsts = firsts.unionByName(more)
    found = tried.join(firsts, [text_id, "_try"]).select(text_id, "phrase", "word", changed.alias("changed"))
    return clean.join(found, text_id, "left")


def _apart(masked: Column) -> Column:
    """Whether every mask is a word of its own, so that what fills it leaves the other words as they are."""
    return words_of(masked) == words_of(F.replace(masked, F.lit("<mask>"), F.lit(" <mask> ")))


def _first_flip_by_words(clean: DataFrame, masked: DataFrame, candidates: DataFrame, scorer: Scorer, text_id: str, target: int) -> DataFrame:
    """R3 for a linear scorer: the words around the masks and those of the candidates are weighed once each."""
    def weighed(df: DataFrame, key: str, text: Column) -> DataFrame:
        used = df.select(key, F.explode(words_of(text)).alias("_word")).groupBy(key, "_word").agg(F.count(F.lit(1)).alias("_n"))
        met = skew_join(used.withColumnRenamed("_word", "_w"), scorer.weights.select(F.col("word").alias("_w"), "weight"), ["_w"], [key],
                        counts=scorer.weights.select(F.col("word").alias("_w"), "n_rows"))
        return met.groupBy(key).agg(F.sum(F.col("_n") * F.col("weight")).alias("_sum"))

    rows = durable(masked.withColumn("_m", F.monotonically_increasing_id()))
    around = weighed(rows, "_m", F.replace("masked", F.lit("<mask>"), F.lit(" "))).withColumnRenamed("_sum", "_around")
    holes = (F.size(F.split("masked", "<mask>", -1)) - 1).alias("_holes")
    bases = rows.select("_m", text_id, "phrase", holes).join(around, "_m", "left").join(clean.select(text_id, "clean").distinct(), text_id)
    uses = durable(candidates.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows")))
    own = uses.join(weighed(uses, "word", F.col("word")), "word", "left").select("word", F.coalesce("_sum", F.lit(0.0)).alias("_own"))
    tried = common_join(candidates.select(text_id, "phrase", "rank", "word"), own, ["word"], [text_id, "phrase"], uses, "inner").join(
        bases, [text_id, "phrase"])
    logits = scorer.logits(F.coalesce("_around", F.lit(0.0)) + F.col("_holes") * F.col("_own"))
    flipped = tried.filter(goal(logits, F.col("clean"), target))
    firsts = flipped.groupBy(text_id).agg(F.min(F.struct("phrase", "rank", "word", "_m")).alias("f")).select(text_id, "f.*")
    changed = F.replace("masked", F.lit("<mask>"), F.col("word"))
    found = firsts.join(rows.select("_m", "masked"), "_m").select(text_id, "phrase", "word", changed.alias("changed"))
    return clean.join(found, text_id, "left")


def goal(logits: Column, label: Column, target: int = -1) -> Column:
    """Any other class, or the target class."""
    found = vec.argmax(logits)
    return found != label if target == -1 else found == target


def constrain(cands: DataFrame, n_words: str, n_changed: str, word: str, edited_before: str, cosine: str,
              max_changed: float = MAX_CHANGED, min_cosine: float = MIN_COSINE, window: int | None = None) -> DataFrame:
    """Few words changed, none twice, no stop words, and close in meaning.

    With a window, texts shorter than it are not compared.
    """
    close = F.col(cosine) >= min_cosine
    if window is not None:
        close = close | (F.col(n_words) < window)
    return cands.filter(
        (F.col(n_changed) <= max_changed * F.col(n_words)) & ~F.col(edited_before)
        & ~F.col(word).isin(*STOP_WORDS) & close)


# ---- word importance ----

def leave_one_out(texts: DataFrame, text_id: str, text: str, how: str = "delete", unknown: str = "[UNK]") -> DataFrame:
    """Every text without one of its words, or with that word unknown."""
    words = F.split(F.col(text), " ")
    rows = texts.select(text_id, words.alias("w")).select(text_id, "w", F.posexplode("w").alias("pos", "word"))
    swapped = F.transform("w", lambda x, i: F.when(i == F.col("pos"), F.lit(unknown)).otherwise(x))
    left = F.filter("w", lambda x, i: i != F.col("pos")) if how == "delete" else swapped
    return rows.select(text_id, "pos", "word", F.array_join(left, " ").alias("changed"))


def word_importance(texts: DataFrame, scorer: Scorer, text_id: str, text: str, how: str = "delete", unknown: str = "[UNK]") -> DataFrame:
    """(text_id, pos, word, drop, rank) by the fall of the predicted class's score.

    With a wrapped batch function the changed texts are built and scored inside the task, a bounded number of
    bytes at a time: one text moves, not one per word. Other scorers get a table of all changed texts.
    A null text has no words; an empty one has one empty word.
    """
    if hasattr(scorer, "batch"):
        return _ranked(_drops_in_task(texts, scorer.batch, text_id, text, how, unknown), text_id)
    clean = scorer(texts, [text_id], text).select(text_id, "logits", vec.argmax(F.col("logits")).alias("pred"))
    variants = leave_one_out(texts, text_id, text, how, unknown)
    scored = scorer(variants, [text_id, "pos"], "changed").withColumnRenamed("logits", "after").join(clean, text_id)
    drop = F.round(F.get("logits", F.col("pred")) - F.get("after", F.col("pred")), 9)
    drops = scored.select(text_id, "pos", drop.alias("drop"))
    return _ranked(variants.select(text_id, "pos", "word").join(drops, [text_id, "pos"]), text_id)


def _drops_in_task(texts: DataFrame, fn: Callable[[pd.Series], list], text_id: str, text: str, how: str, unknown: str) -> DataFrame:
    """(text_id, pos, word, drop) of every word, changed texts held VARIANT_BYTES at a time."""
    def changed(words: list[str], pos: int) -> str:
        return " ".join(words[:pos] + ([] if how == "delete" else [unknown]) + words[pos + 1:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, value in zip(batch[text_id], batch[text]):
                if value is None:
                    continue
                words = value.split(" ")
                logits = list(list(fn(pd.Series([value])))[0])
                best = logits.index(max(logits))
                step = max(1, VARIANT_BYTES // (len(value) + 1))
                for at in range(0, len(words), step):
                    places = range(at, min(at + step, len(words)))
                    after = fn(pd.Series([changed(words, p) for p in places]))
                    yield pd.DataFrame({text_id: [key] * len(places), "pos": places, "word": [words[p] for p in places],
                                        "drop": [float(logits[best]) - float(x[best]) for x in after]})

    read = texts.select(text_id, text)
    out = read.mapInPandas(run, f"`{text_id}` {read.schema[text_id].dataType.simpleString()}, pos int, word string, drop double")
    return out.withColumn("drop", F.round("drop", 9))


def linear_importance(texts: DataFrame, weights: DataFrame, text_id: str, text: str, bias: float = 0.0) -> DataFrame:
    """R9 for a linear scorer: a word's drop is its own weight, so no changed text is built.

    The score of class 1 rises with weights, that of class 0 is constant.
    """
    rows = texts.select(text_id, F.posexplode(words_of(F.col(text))).alias("pos", "word"))
    weighed = skew_join(rows, weights.select("word", "weight"), ["word"], [text_id, "pos"], "left", counts=weights)
    weight = F.coalesce("weight", F.lit(0.0))
    # floating sums depend on their order, so they are compared at nine places
    total = F.round(F.sum(weight).over(W.partitionBy(text_id)) + bias, 9)
    drop = F.when(total > 0, weight).otherwise(F.lit(0.0))
    return _ranked(weighed.select(text_id, "pos", "word", F.round(drop, 9).alias("drop")), text_id)


def _ranked(drops: DataFrame, text_id: str) -> DataFrame:
    return drops.withColumn("rank", F.row_number().over(W.partitionBy(text_id).orderBy(F.desc("drop"), "pos")))


# ---- results ----

def id_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences: one bit per place of `a`, one step per place of `b`."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    often = {x: sum(1 << k for k in found) for x, found in places.items() if len(found) > OFTEN}
    full = (1 << len(a)) - 1
    top, up, down, distance = 1 << (len(a) - 1), full, 0, len(a)
    for x in b:  # `up` and `down`: where a column of the table rises and falls
        equal = often[x] if x in often else sum(1 << k for k in places.get(x, ()))
        across = (((equal & up) + up) ^ up) | equal
        rises, falls = (down | ~(across | up)) & full, up & across
        distance += bool(rises & top) - bool(falls & top)
        rises, falls, sides = ((rises << 1) | 1) & full, (falls << 1) & full, equal | down
        up, down = (falls | ~(sides | rises)) & full, rises & sides
    return distance


OFTEN = 8  # places from which the bits of an id are kept ready


@F.arrow_udf(LongType())  # an object, as this module is read before there is a session
def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a, b)
    return pa.array([id_distance(x.as_py(), y.as_py()) if x.is_valid and y.is_valid else None for x, y in pairs], pa.int64())


def token_error(a: Column, b: Column) -> Column:
    """Word-level edit distance of id arrays over the length of the reference `a`.

    Ids are of any kind; a pair of n and m ids takes m steps on n bits. An empty or null reference, or a null
    `b`, gives null; null ids are equal to each other.
    """
    return F.when(F.size(a) > 0, _distances(a, b) / F.size(a))


def chosen_draws(draws: DataFrame, sample: str, draw: str, logits: str, label: str) -> DataFrame:
    """Per sample the first draw that flips, or the last draw if none does."""
    flipped = goal(F.col(logits), F.col(label))
    return draws.groupBy(sample).agg(
        F.coalesce(F.min(F.when(flipped, F.col(draw))), F.max(draw)).alias(draw), F.bool_or(flipped).alias("flipped"))


def flip_rate(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("flipped").alias("n_flipped"),
                      F.avg(F.col("flipped").cast("int")).alias("rate"))


def bigram_counts(texts: DataFrame, text: str | None) -> DataFrame:
    """(before, word, n) over neighbouring words; without `text` the rows are pairs (before, word) already."""
    pairs = texts if text is None else _bigrams(texts, text)
    return pairs.groupBy("before", "word").agg(F.count(F.lit(1)).alias("n"))


def _bigrams(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    places = F.when(F.size("w") > 1, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda i: F.struct(F.get("w", i - 1).alias("before"), F.get("w", i).alias("word")))
    return texts.select(*keys, words_of(F.col(text)).alias("w")).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def log_perplexity(texts: DataFrame, bigrams: DataFrame | Column, text_id: str, text: str) -> DataFrame:
    """Mean of -ln p(word | word before) over all positions of a text; null if it has none.

    p = (n + 1) / (total of the word before + words), where words counts the corpus's second
    words and one for all others, so pairs the corpus lacks have a chance too.
    The logarithm is a difference, so the counts of pairs and the totals are joined and summed apart; a pair the corpus
    lacks adds ln 1 = 0. Equal places are not combined before, as that would move them all.

    `bigrams` are counts (before, word, n), or a condition on `text_id`: the pairs of such texts are counted then. Texts are cut once.
    Places are counted and looked up in rounds by a hash of the word before, one for each ROUND_CHARS of text, and what a round
    counts and shuffles goes with its end: the disk holds all places once, and the rest of one round.
    """
    spark, given = texts.sparkSession, isinstance(bigrams, DataFrame)
    rounds = 1 + (texts.agg(F.sum(F.length(text))).first()[0] or 0) // ROUND_CHARS
    with scratch_scope(spark) as keep:
        used = _by_round(_bigrams(texts, text, text_id), "before", rounds)
        words = (bigrams if given else used.filter(bigrams)).agg(F.count_distinct("word") + 1).first()[0]
        counts = _by_round(bigrams.select("before", "word", "n"), "before", rounds) if given and rounds > 1 else bigrams
        sums = []
        for k in range(rounds):
            with scratch_scope(spark) as keep_sums:
                asked = _round(used, k, rounds)
                known = _round(counts, k, rounds) if given else durable(bigram_counts(asked.filter(bigrams), None))
                let_go(spark)  # what counting shuffled
                sums.append(keep_sums(_summed_logs(asked, known, words, text_id)))
            let_go(spark)
        every = sums[0]
        for more in sums[1:]:
            every = every.unionByName(more)
        scored = keep(every.groupBy(text_id).agg((-F.sum("log_p") / F.sum("uses")).alias("log_perplexity")))
    return texts.select(text_id).join(scored, text_id, "left")


def _by_round(df: DataFrame, key: str, rounds: int) -> DataFrame:
    """`df` written, in one part per round if there are several (_round, by a hash of `key`)."""
    if rounds == 1:
        return durable(df)
    parted = df.withColumn("_round", F.pmod(F.xxhash64(key), F.lit(rounds)).cast("int"))
    path = scratch_path(df.sparkSession, "rounds")
    parted.write.partitionBy("_round").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(parted.schema).parquet(path)


def _round(df: DataFrame, k: int, rounds: int) -> DataFrame:
    return df if rounds == 1 else df.filter(F.col("_round") == k).drop("_round")


def _summed_logs(used: DataFrame, bigrams: DataFrame, words: int, text_id: str) -> DataFrame:
    """(text_id, log_p, uses): the sum of logarithms and the number of the places `used`."""
    firsts = durable(bigrams.groupBy("before").agg(F.sum("n").alias("total")))
    pairs = common_join(used, bigrams, ["before", "word"], [text_id], bigrams.select("before", "word", F.col("n").alias("n_rows")), "inner")
    totals = common_join(used.select(text_id, "before"), firsts, ["before"], [text_id], firsts.withColumnRenamed("total", "n_rows"))
    parts = pairs.select(text_id, F.ln(F.col("n") + 1).alias("log_p"), F.lit(0).alias("uses")).unionByName(
        totals.select(text_id, (-F.ln(F.coalesce("total", F.lit(0)) + F.lit(words))).alias("log_p"), F.lit(1).alias("uses")))
    return parts.groupBy(text_id).agg(F.sum("log_p").alias("log_p"), F.sum("uses").alias("uses"))


def audit_report(samples: DataFrame, run: str) -> DataFrame:
    """Per run the number of samples, the success rate, and mean token error and time."""
    flipped = F.col("adv_pred") != F.col("label")
    return samples.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(flipped).alias("n_flipped"),
        F.avg(flipped.cast("int")).alias("rate"),
        F.count_if(F.col("clean_pred") == F.col("label")).alias("n_clean_right"),
        F.avg("token_error").alias("mean_token_error"), F.avg("seconds").alias("mean_seconds"))
