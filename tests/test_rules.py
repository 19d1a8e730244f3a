"""Verdict rules: truth rows, and one-edit phrases against the public fuzzy regex library."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from moothall.functions import rules

ALPHABET = "abcdefghijklmnopqrstuvwxyz  -'\né"


def sample(phrase, rng):
    out = ""
    for part in phrase.parts:
        if isinstance(part, str):
            out += part
        elif not part.optional or rng.random() < 0.4:
            out += rng.choice(part.words)
    return out


def mutate(text, edits, rng):
    for _ in range(edits):
        at, kind = rng.randrange(len(text) + 1), rng.choice("sid")
        tail = text[at:] if kind == "i" else text[at + 1:]
        text = text[:at] + ("" if kind == "d" else rng.choice(ALPHABET)) + tail
    return text


def fuzzy(phrase):
    body = "".join(rules._intact(p) for p in phrase.parts) + (r"\M" if phrase.whole_end else "")
    return regex.compile(f"(?e)(?i:{body}){{e<=1}}")


def acronym(rule):
    return regex.compile(rf"\m(?i:{rule.acronym})\M")


CONTRADICTION = regex.compile(r"\m(?i:but|however|although|yet){e<=1}\M")


def expected_verdict(text):
    """What the rules mean, stated with the fuzzy library."""
    spans = []
    for index, rule in enumerate(rules.VERDICT_RULES):
        found = [m.span() for m in (p.search(text) for p in [acronym(rule), *map(fuzzy, rule.phrases)]) if m]
        if found:
            spans.append((min(found, key=lambda s: s[0])[0], index, min(found, key=lambda s: s[0])[1]))
    spans.sort(key=lambda s: s[:2])
    if not spans:
        return None
    if len(spans) > 1:
        (_, one, end), (start, two, _) = spans[:2]
        if end <= start and CONTRADICTION.search(text[end:start]):
            return rules.VERDICTS[two]
    return rules.VERDICTS[spans[0][1]]


def verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", rules.extract_verdict(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_match_fuzzy_library_in_spark(spark, seed):
    rng = random.Random(seed)
    phrases = [p for rule in rules.VERDICT_RULES for p in rule.phrases]
    for phrase in phrases:
        texts = []
        for _ in range(300):
            text = mutate(sample(phrase, rng), rng.choice([0, 1, 1, 1, 2]), rng)
            text = rng.choice(["", "I think ", "y", "n ", "ee", "you ", "😀 ", "not "]) + text
            text += rng.choice(["", " here", "s", " you are", " " + sample(phrase, rng)])
            texts.append(rng.choice([text, text, text.upper(), text.title()]))
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        gate = rules.fold_case(F.col("t")).contains(phrase.needles[0]) | rules.fold_case(F.col("t")).contains(phrase.needles[1])
        span = rules._span(F.col("t"), rules.phrase_regex(phrase), 0, gate)
        found = {r.i: r.s and (r.s.start, r.s.end) for r in df.select("i", span.alias("s")).collect()}
        for i, text in enumerate(texts):
            match = fuzzy(phrase).search(text)
            assert found[i] == (match and match.span()), text


def test_contradiction_matches_fuzzy_library(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", "a ", "x"]) + mutate(rng.choice(rules.CONTRADICTION_WORDS), rng.choice([0, 1, 1, 2]), rng)
             + rng.choice(["", " b", "z", "."]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.c for r in df.select("i", rules.has_contradiction(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts):
        assert found[i] == bool(CONTRADICTION.search(text)), text


def test_whole_verdict_on_mixed_texts(spark):
    rng = random.Random(4)
    pieces = ["NTA", "YTA", "esh", "NAH", "INFO", "but", "yet", "and", "yes", "you are the asshole", "not the ashole",
              "everyone sucks here", "no one is the a-hole", "needs more info", "however", "fine 😀", "you both suk"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(500)]
    assert verdicts(spark, texts) == [expected_verdict(t) for t in texts]


def test_truth_rows(spark):
    rows = {"NTA but YTA": "AUTHOR", "NTA and YTA": "OTHER", "NTA, yes YTA": "AUTHOR", "NA": None, "NAHH": "NOBODY",
            "YNTA": "OTHER", "nothing at all": None, "😀😀 NTA but YTA": "AUTHOR"}
    assert verdicts(spark, list(rows)) == list(rows.values())


def test_binarise(spark):
    df = spark.createDataFrame([(v,) for v in [*rules.VERDICTS, None]], "v string")
    assert [r.b for r in df.select(rules.binarise(F.col("v")).alias("b")).collect()] == [1, 0, 1, 0, None, None]
    with pytest.raises(Exception, match="Unrecognized verdict"):
        spark.createDataFrame([("MAYBE",)], "v string").select(rules.binarise(F.col("v"))).collect()
