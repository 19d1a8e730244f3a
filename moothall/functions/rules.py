"""Verdict rules over comment text, as Column expressions.

Spark's regular expressions have no tolerance for typing errors. A phrase rule is therefore
expanded, once and on the driver, into an ordinary expression that lists the exact phrase
and every phrase one edit away. A cheap substring test runs first: one edit can damage only
one of two disjoint literals, so a text holding neither cannot match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?isuU)"
WORD_START, WORD_END = r"\b(?=\w)", r"\b(?<=\w)"


@dataclass(frozen=True)
class Choice:
    """One of several literals; `optional` allows none of them."""

    words: tuple[str, ...]
    optional: bool = False


@dataclass(frozen=True)
class Phrase:
    """A phrase rule: literals and choices in order, matched with at most one edit.

    `needles` are two disjoint literals every exact match contains; `whole_end` asks for a
    word end after the match.
    """

    parts: tuple[str | Choice, ...]
    needles: tuple[str, str]
    whole_end: bool = False


@dataclass(frozen=True)
class VerdictRule:
    name: str
    acronym: str
    phrases: tuple[Phrase, ...] = field(default=())


# ---- fixed values: the verdict names, acronyms and phrases users write ----
DEGREE = Choice(("kind of ", "sort of ", "really ", "indeed ", "just "), optional=True)
ARTICLE = Choice(("an ", "a ", "the "), optional=True)
SIZE = Choice(("huge ", "big ", "giant "), optional=True)
INSULT = Choice(("asshole", "a-hole", "ahole"))
INSULTS = Choice(("assholes", "a-holes", "aholes"))

VERDICT_RULES = (
    VerdictRule("AUTHOR", r"YTAH?", (
        Phrase(("you", Choice(("'re", "r", " are"), optional=True), " ", DEGREE, ARTICLE, SIZE, INSULT),
               ("you", "hole")),
        Phrase(("you ", DEGREE, "are ", ARTICLE, SIZE, INSULT), ("you", "hole")),
    )),
    VerdictRule("OTHER", r"Y?NTAH?", (
        Phrase(("not ", Choice(("really ",), optional=True), ARTICLE, INSULT), ("not", "hole"), whole_end=True),
    )),
    VerdictRule("EVERYBODY", r"ESH", (
        Phrase(("every", Choice(("one", "body")), " sucks here"), ("every", "sucks")),
        Phrase(("you both suck",), ("both", "suck")),
    )),
    VerdictRule("NOBODY", r"NAH?H", (
        Phrase(("no ", INSULTS, " here"), ("holes", "here")),
        Phrase(("no one is the ", INSULT), ("no one", "hole")),
    )),
    VerdictRule("INFO", r"INFO", (
        Phrase(("not enough info",), ("enough", "info")),
        Phrase(("need", Choice(("s",), optional=True), " more info"), ("need", "info")),
        Phrase(("more info", Choice(("'s", " is"), optional=True), " required"), ("info", "required")),
    )),
)
CONTRADICTION_WORDS = ("but", "however", "although", "yet")
RIGHT, WRONG = 0, 1
BINARY_OF = {"AUTHOR": WRONG, "EVERYBODY": WRONG, "OTHER": RIGHT, "NOBODY": RIGHT, "INFO": None}
# ---- end of fixed values ----

VERDICTS = tuple(rule.name for rule in VERDICT_RULES)


def exact_rule(acronym: str) -> str:
    """L1: a whole-word, case-insensitive acronym."""
    return rf"{FLAGS}\b(?:{acronym})\b"


def _literal(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _either(options: list[str]) -> str:
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def _intact(part: str | Choice) -> str:
    if isinstance(part, str):
        return _literal(part)
    body = "(?:" + "|".join(_literal(w) for w in part.words) + ")"
    return body + "?" if part.optional else body


def _damaged(text: str, kind: str, opening: bool) -> list[str]:
    """Expressions for `text` with one edit; `opening` marks the start of the whole phrase."""
    found = []
    for at, char in enumerate(text):
        before, after = _literal(text[:at]), _literal(text[at + 1:])
        if kind == "substitute":
            found.append(before + (f"[^{_literal(char)}]" if opening and at == 0 else ".") + after)
        elif kind == "delete":
            found.append(before + after)
        elif not (opening and at == 0):
            # a doubled first letter must not start the match one character early
            extra = f"[^{_literal(text[0])}]" if opening and at == 1 else "."
            found.append(before + extra + _literal(text[at:]))
    return found


def compile_one_edit(parts: tuple[str | Choice, ...], whole_end: bool = False) -> str:
    """L2: an ordinary expression for `parts` with at most one insert, delete or substitution.

    At one start the order is exact, substitutions, inserts, deletes: the fit with the
    fewest errors wins and ties go to the longer reading. Spellings whose first letter is
    damaged come last, so that a position whose letter fits nothing fails at once.
    """
    intact = [_intact(p) for p in parts]
    keep_first, lose_first = ["".join(intact)], []
    for kind in ("substitute", "insert", "delete"):
        for at, part in enumerate(parts):
            before, after = "".join(intact[:at]), "".join(intact[at + 1:])
            words = (part,) if isinstance(part, str) else part.words
            options = []
            for word in words:
                spellings = _damaged(word, kind, opening=at == 0)
                if at == 0 and kind != "insert":
                    lose_first.append(spellings[0] + after)
                    spellings = spellings[1:]
                options += spellings
            if options:
                keep_first.append(before + _either(options) + after)
        if kind == "insert" and whole_end:
            keep_first.append("".join(intact) + ".")
    body = "(?:" + "|".join(keep_first + lose_first) + ")"
    return body + (WORD_END if whole_end else "")


def phrase_regex(phrase: Phrase) -> str:
    return FLAGS + compile_one_edit(phrase.parts, phrase.whole_end)


def contradiction_regex() -> str:
    """A whole contradiction word with at most one edit.

    A letter before the word counts as an insert; at the very start of the text only a
    doubled first letter does.
    """
    words = [compile_one_edit((w,), whole_end=True) for w in CONTRADICTION_WORDS]
    words += [rf"(?:{w[0]}|(?!\A).){w}{WORD_END}" for w in CONTRADICTION_WORDS]
    return rf"{FLAGS}{WORD_START}(?:{'|'.join(words)})"


def fold_case(text: Column) -> Column:
    """Lower case that also folds the letters case-blind matching equates with i and s."""
    return F.lower(F.translate(text, "İıſ", "iis"))


def _span(text: Column, regex: str, priority: int, gate: Column | None) -> Column:
    """First match of `regex` as struct(start, priority, end), else null; code-point units."""
    match = F.regexp_extract(text, regex, 0)
    body = regex.removeprefix(FLAGS)
    start = F.length(F.regexp_extract(text, rf"{FLAGS}^(.*?){body}", 1))
    hit = F.length(match) > 0
    return F.when(hit if gate is None else gate & hit, F.struct(
        start.alias("start"),
        F.lit(priority).alias("priority"),
        (start + F.length(match)).alias("end"),
    ))


def first_span(text: Column, rule: VerdictRule) -> Column:
    """L3: earliest span of one verdict; at equal starts the first pattern wins."""
    folded = fold_case(text)
    spans = [_span(text, exact_rule(rule.acronym), 0, None)]
    for at, phrase in enumerate(rule.phrases, start=1):
        gate = folded.contains(phrase.needles[0]) | folded.contains(phrase.needles[1])
        spans.append(_span(text, phrase_regex(phrase), at, gate))
    return F.array_min(F.filter(F.array(*spans), lambda s: s.isNotNull()))


def has_contradiction(text: Column) -> Column:
    return text.rlike(contradiction_regex())


def resolve(text: Column, spans: Column) -> Column:
    """L4: the verdict of two earliest spans, struct(start, label, end) sorted ascending."""
    first, second = spans[0], spans[1]
    between = F.substring(text, first["end"] + 1, second["start"] - first["end"])
    later = (first["end"] <= second["start"]) & has_contradiction(between)
    return (
        F.when(F.size(spans) == 0, F.lit(None).cast("int"))
        .when(F.size(spans) == 1, F.get(spans, F.lit(0))["label"])
        .otherwise(F.when(later, second["label"]).otherwise(first["label"]))
    )


def verdict_spans(text: Column) -> Column:
    """All verdicts found in `text`, earliest first; equal starts keep the rule order."""
    def labelled(index: int, span: Column) -> Column:
        # the span is bound once by the lambda instead of being computed for every field
        return F.transform(F.array(span), lambda s: F.when(s.isNotNull(), F.struct(
            s["start"].alias("start"), F.lit(index).alias("label"), s["end"].alias("end"))))[0]

    found = [labelled(index, first_span(text, rule)) for index, rule in enumerate(VERDICT_RULES)]
    return F.array_sort(F.filter(F.array(*found), lambda s: s.isNotNull()))


def extract_verdict(text: Column) -> Column:
    """L1-L5 together: one of the five verdict names, or null."""
    label = F.transform(F.array(verdict_spans(text)), lambda spans: resolve(text, spans))[0]
    names = F.array(*[F.lit(name) for name in VERDICTS])
    return F.get(names, label)


def binarise(verdict: Column) -> Column:
    """0 when the author is right, 1 when wrong, null for INFO; other names raise."""
    expr = F.when(verdict.isNull(), F.lit(None).cast("int"))
    for name, value in BINARY_OF.items():
        expr = expr.when(verdict == name, F.lit(value).cast("int"))
    return expr.otherwise(F.raise_error(F.concat(F.lit("Unrecognized verdict: "), verdict)).cast("int"))
