"""Scalar text, label and token-array functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
SPOILER = r"(edit|update).*?(YTA|a-|ass|\sta\s)(.*)"
GONE = ("[deleted]", "[removed]", "")
TITLE_PHRASES = ("aita for", "wibta if", "aita if", "wibta for")
KEY_WORDS = (
    (" ", "_"),
    ("<", "[less]"),
    (">", "[greater]"),
    (":", "[colon]"),
    ('"', "[quote]"),
    ("/", "[forward_slash]"),
    ("\\", "[backslash]"),
    ("|", "[pipe]"),
    ("?", "[qmark]"),
    ("*", "[asterisk]"),
)
KEY_LENGTH = 150
FORUM_AREA = "amitheasshole"
IGNORED_ID = -100
# ---- end of fixed values ----


def scrub_spoilers(text: Column) -> Column:
    """Delete line tails that follow an edit note and give the verdict away."""
    return F.regexp_replace(text, "(?iudU)" + SPOILER, "")


def strip(text: Column) -> Column:
    """T5: trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def safe_key(index: Column, title: Column) -> Column:
    """A file-name-safe key `index_title`, at most 150 characters, Latin-1 only."""
    key = title
    for char, word in KEY_WORDS:
        key = F.replace(key, F.lit(char), F.lit(word))
    key = F.substring(F.concat(index.cast("string"), F.lit("_"), key), 1, KEY_LENGTH)
    return F.regexp_replace(key, r"[^\x{0}-\x{FF}]", "?")


def remove_phrase(text: Column, phrase: str) -> Column:
    """Remove every occurrence, left to right, without overlaps."""
    if not phrase:
        raise ValueError("the phrase must not be empty")
    return F.replace(text, F.lit(phrase), F.lit(""))


def normalise_title(title: Column, phrases: Sequence[str] = TITLE_PHRASES) -> Column:
    """T4: lower case without the first listed phrase the title contains."""
    low = F.lower(title)
    chain = None
    for phrase in phrases:
        held, rest = low.contains(phrase), remove_phrase(low, phrase)
        chain = F.when(held, rest) if chain is None else chain.when(held, rest)
    return chain.otherwise(low)


def replace_kth(text: Column, old: str, new: str, k: int) -> Column:
    """Replace the k-th occurrence, counting overlapping ones; unchanged if there are fewer."""
    if k < 1 or not old:
        raise ValueError("k counts from 1 and the old text must not be empty")
    last = F.length(text) - len(old) + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda at: F.substr(text, at, F.lit(len(old))) == old)
    at = F.get(hits, F.lit(k - 1))
    replaced = F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(old)))
    return F.when(at.isNull(), text).otherwise(replaced)


def mask_phrase(text: Column, phrase: Column | str, mask: str = "<mask>") -> Column:
    """Blank-delimited occurrences become masks, in two steps as neighbours share a blank."""
    phrase = F.lit(phrase) if isinstance(phrase, str) else phrase
    glued = F.replace(text, F.concat(F.lit(" "), phrase, F.lit(" ")), F.lit(mask))
    return F.replace(glued, F.lit(mask), F.lit(f" {mask} "))


def shift_right(ids: Column, pad: int, start: int) -> Column:
    """Prepend the start id, drop the last id, replace ignored ids by the pad id."""
    if pad is None:
        raise ValueError("the pad id must be defined")
    shifted = F.concat(F.array(F.lit(start)), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))))
    return F.when(F.size(ids) == 0, ids).otherwise(
        F.transform(shifted, lambda i: F.when(i == IGNORED_ID, F.lit(pad)).otherwise(i)))


def compose_input(mode: str = "", sep: str = " ", title: str = "title", body: str = "body",
                  strict: bool = False) -> Column:
    """The input text; no mode means both columns, or an error when `strict`."""
    if mode == "title":
        return F.col(title)
    if mode == "body":
        return F.col(body)
    if mode != "both" and strict:
        raise ValueError("select at least one of title and body")
    return F.concat(F.col(title), F.lit(sep), F.col(body))


def map_label(value: Column, kind: str) -> Column:
    """`verdict` WRONG -> 1 else 0; `sign` of a judgement, 0 -> null; `offset` from 1 to 0."""
    if kind == "verdict":
        return F.when(value == "WRONG", 1).otherwise(0)
    if kind == "sign":
        return F.when(value < 0, 0).when(value > 0, 1)
    if kind == "offset":
        return value - 1
    raise ValueError(f"unknown label kind {kind}")


def readable_json(value: Column) -> Column:
    """Whether a text is one JSON value, of any size."""
    is_list = F.json_array_length(value).isNotNull()
    return is_list | F.coalesce(F.json_object_keys(value).isNotNull(), F.lit(False))
