"""Words that are cut once and joins in which common words do not move."""

import math
import re

from pyspark.sql import functions as F

from moothall.functions import stem as stems
from moothall.operators import audit, features, skew


def test_common_keys_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_COMMON", 4)
    rows = [(i, "ab"[i % 2]) for i in range(60)] + [(60, "c"), (61, None), (62, "lost")]
    big = spark.createDataFrame(rows, "i long, word string")
    small = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, x int")
    counts = spark.createDataFrame([("a", 30), ("b", 30), ("c", 1)], "word string, n_rows long")
    near, rest = skew.common_parts(big, small, ["word"], ["i"], counts)
    assert near.count() == 60 and rest.count() == 3
    found = {r.i: r.x for r in skew.common_join(big, small, ["word"], ["i"], counts).collect()}
    assert found == {i: {"a": 1, "b": 2, "c": 3}.get(w) for i, w in rows}


def test_stems_take_no_join(spark, monkeypatch):
    def fails(*_, **__):
        raise AssertionError("words moved for their stems")

    monkeypatch.setattr(features, "skew_join", fails)
    texts = spark.createDataFrame([(1, "Running dogs ran and running/fast Żółwie, 12 dogs"), (2, None)], "d long, t string")
    found = [(r.pos, r.word) for r in features.extract_words(texts, "d", "t").orderBy("pos").collect()]
    kept = [w.lower() for w in re.findall(r"\w+(?:[/\-]\w+)*|[^\w \t\n\r]", "Running dogs ran and running/fast Żółwie, 12 dogs")
            if w not in features.STOP_WORDS and "/" not in w]
    assert found == list(enumerate(stems.stem_word(w, extended=True) for w in kept))


def test_contexts_asked_for_are_counted_whole(spark):
    texts = spark.createDataFrame([("a x b a y b",), ("a x b c d",), (None,)], "t string")
    asked = spark.createDataFrame([("a", "b")], "before string, after string")
    found = {tuple(r) for r in audit.neighbour_counts(texts, "t", asked).collect()}
    assert found == {("a", "x", "b", 2), ("a", "y", "b", 1)}


def test_linear_scorer_flips_without_changed_texts(spark):
    texts = spark.createDataFrame([(1, "good good bad end"), (2, "bad bad end")], "i long, t string")
    masked = spark.createDataFrame([(1, "bad", "good good <mask> end"), (1, "good", " <mask>   <mask>  bad end"), (2, "end", "bad bad <mask>")],
                                   "i long, phrase string, masked string")
    cands = spark.createDataFrame([(1, "bad", 1, "new"), (1, "good", 1, "bad"), (1, "good", 2, "end"), (2, "end", 1, "good"), (2, "end", 2, "great")],
                                  "i long, phrase string, rank int, word string")
    weights = spark.createDataFrame([("good", 1.0, 9), ("bad", -1.0, 9), ("great", 5.0, 1)], "word string, weight double, n_rows long")
    scored, linear = [], audit.linear_scorer(weights, places=9)

    def spied(df, keys, text):
        scored.append(text)
        return linear(df, keys, text)

    spied.weights, spied.logits = linear.weights, linear.logits
    by_words = {tuple(r) for r in audit.first_flip(texts, masked, cands, spied, "i", "t").collect()}
    assert by_words == {(1, 1, "good", "bad", " bad   bad  bad end"), (2, 0, "end", "great", "bad bad great")}
    assert scored == ["t"]  # no changed text was scored
    general = {tuple(r) for r in audit.first_flip(texts, masked, cands, lambda *a: linear(*a), "i", "t").collect()}
    assert by_words == general


def test_perplexity_of_pairs_the_corpus_lacks(spark):
    corpus = spark.createDataFrame([("a b a b",)], "t string")
    texts = spark.createDataFrame([(1, "a b"), (2, "b z"), (3, "z q"), (4, "a")], "i long, t string")
    bigrams = audit.bigram_counts(corpus, "t")  # a b: 2, b a: 1; three words
    found = {r.i: r.log_perplexity for r in audit.log_perplexity(texts, bigrams, "i", "t").collect()}
    assert found[4] is None
    assert all(math.isclose(found[i], v) for i, v in {1: -math.log(3 / 5), 2: -math.log(1 / 4), 3: -math.log(1 / 3)}.items())


def test_perplexity_looks_pairs_up_in_rounds(spark, monkeypatch):
    rows = [(i, " ".join("abcdefgh"[(i * k + k // 3) % 8] for k in range(1, 30))) for i in range(12)] + [(12, None), (12, "a b z"), (None, "a b")]
    texts = spark.createDataFrame(rows, "i long, t string")
    bigrams = audit.bigram_counts(texts.filter("i % 3 <> 1"), "t")
    whole = {r.i: r.log_perplexity for r in audit.log_perplexity(texts, bigrams, "i", "t").collect()}
    places, joined = sum(max(0, len((t or "").split()) - 1) for _, t in rows), []

    def spied(big, small, on, *args):
        if len(on) == 2:
            joined.append(big.count())
        return skew.common_join(big, small, on, *args)

    monkeypatch.setattr(audit, "common_join", spied)
    monkeypatch.setattr(audit, "ROUND_CHARS", 150)
    parted = {r.i: r.log_perplexity for r in audit.log_perplexity(texts, bigrams, "i", "t").collect()}
    assert sum(joined) == places and max(joined) < places and len(joined) == 5
    counted = {r.i: r.log_perplexity for r in audit.log_perplexity(texts, F.expr("i % 3 <> 1"), "i", "t").collect()}
    assert parted.keys() == whole.keys() and parted[None] is None and len(joined) == 10 and sum(joined) == 2 * places
    assert all(math.isclose(parted[i], v) and math.isclose(counted[i], v) for i, v in whole.items() if v is not None)
