"""Language identification (5): unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, in lower case. Each language has a probability
per piece, fitted by expectation-maximisation: the expected uses of a piece over all
segmentations of the training words (forward-backward), then normalised. A text is scored by the
forward algorithm: a word's probability is the sum over all its segmentations, a text's the
product over its words, and the answer is the language with the largest one, with its
posterior under equal priors.

Words are runs of letters and the marks on them, of any length; the forward pass is rescaled as it goes and needs only the
last columns, as many as the longest piece has characters. A word's score does not depend on its text, so a task scores each
distinct word of a batch once, whole groups of equal length at a time, and keeps a table of words met, of bounded size.

The model is fitted on at most about `docs_per_lang` labelled documents of each language, drawn by hash
of the id; prediction reads every text whole. Any number of languages is fitted and scored, `LANGUAGES_AT_ONCE` to a task:
the driver holds pieces x languages numbers, a task those of one part of the languages, and each row carries its best
language so far from part to part.

Defined cases: a null text or one without a letter is `und` with score 0; so is everything if
there are no labelled documents; a character outside the vocabulary costs every language the
same; ties go to the first language by code point; repeated rows give repeated rows. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.session import durable

DOCS_PER_LANG = 2000
LANGUAGES_AT_ONCE = 64
ROUNDS = 3
UNKNOWN = 1e-7  # probability of a character outside the vocabulary
SMOOTHING = 0.1  # uses added to every piece
KEPT_SCORES = 1_600_000  # a task's table of scored words is emptied beyond this many scores
KEPT_LETTERS = 16_000_000  # or this many letters
BATCH_WORDS = 20_000
RESCALED = 8  # columns after which the forward pass is rescaled, so that words of any length stay in range
BATCH_SCORES = 160_000  # words x languages of one array step
BATCH_LETTERS = 2_000_000  # of the words of one group, if these are more than one
UNDETERMINED = "und"
START = "▁"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
PLAIN_LETTERS = re.compile("[a-z]+")


def load_pieces(path: str) -> list[str]:
    """Lower-cased pieces of letters, with or without the word start, sorted."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not any(f(i) for f in special)}
    return sorted(p for p in pieces if p == START or LETTERS.fullmatch(p.removeprefix(START)))


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    if not text:
        return []
    return (PLAIN_LETTERS if text.isascii() else LETTERS).findall(text.lower())


class Lattice:
    """All segmentations of many words at once; words of one length share each array step."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.ids = {piece: i for i, piece in enumerate(pieces)}
        self.widest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)  # one more row, for characters outside the vocabulary
        self.none = len(pieces) + 1  # and one of zeros
        languages = probabilities.shape[1]
        self.p = np.vstack([probabilities, np.full((1, languages), UNKNOWN), np.zeros((1, languages))])
        with np.errstate(divide="ignore"):
            self.log_p = np.log(self.p)

    def _ending_at(self, words: list[str], end: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start, piece numbers) of the pieces that end there in words of one length, where some word has one."""
        return self._edges(words, end, range(max(0, end - self.widest), end), lambda at: (at, end))

    def _starting_at(self, words: list[str], start: int) -> Iterator[tuple[int, np.ndarray]]:
        return self._edges(words, start, range(start + 1, min(len(words[0]), start + self.widest) + 1), lambda at: (start, at))

    def _edges(self, words, place, others, ends) -> Iterator[tuple[int, np.ndarray]]:
        get, none = self.ids.get, self.none
        for other in others:
            i, j = ends(other)
            fallback = self.unknown if j == i + 1 else none
            ids = [get(w[i:j], fallback) for w in words]
            if ids.count(none) < len(ids):
                yield other, np.array(ids)

    def _groups(self, words: list[str], languages: int) -> Iterator[tuple[list[int], list[str]]]:
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by_length.setdefault(len(word), []).append(k)
        size = max(1, BATCH_SCORES // max(1, languages))
        for length, places in by_length.items():
            step = max(1, min(size, BATCH_LETTERS // (length + 1)))
            for at in range(0, len(places), step):
                part = places[at:at + step]
                yield part, [START + words[k] for k in part]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """The forward algorithm: ln of the summed probability of each word (rows) in each language."""
        out = np.zeros((len(words), self.log_p.shape[1]))
        for places, group in self._groups(words, self.log_p.shape[1]):
            columns, scale = {0: np.ones((len(group), self.log_p.shape[1]))}, 0.0
            for end in range(1, len(group[0]) + 1):
                total = np.zeros(columns[end - 1].shape)
                for start, ids in self._ending_at(group, end):
                    total += columns[start] * self.p[ids]
                columns[end] = total
                columns.pop(end - self.widest, None)
                if end % RESCALED == 0:  # the last column becomes 1
                    columns = {at: column / total for at, column in columns.items()}
                    scale = scale + np.log(total)
            out[places] = np.log(columns[len(group[0])]) + scale
        return out

    def expected_uses(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Uses of each piece over all segmentations, weighed by probability and count."""
        log_p = self.log_p[:, language]
        uses = np.zeros(len(log_p))
        for places, group in self._groups(words, 1):
            n, weight = len(group[0]), counts[places]
            forward = np.full((n + 1, len(group)), -np.inf)
            forward[0] = 0.0
            for end in range(1, n + 1):
                for start, ids in self._ending_at(group, end):
                    np.logaddexp(forward[end], forward[start] + log_p[ids], out=forward[end])
            columns = {n: np.zeros(len(group))}  # backward, from the last character
            for start in range(n - 1, -1, -1):
                total = np.full(len(group), -np.inf)
                for end, ids in self._starting_at(group, start):
                    behind = log_p[ids] + columns[end]
                    np.logaddexp(total, behind, out=total)
                    uses += np.bincount(ids, np.exp(forward[start] + behind - forward[n]) * weight, minlength=len(log_p))
                columns[start] = total
                columns.pop(start + self.widest, None)
        return uses[:-2]


def fit(labelled: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", key: str = "doc_id",
        docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities of pieces x languages) from labelled rows."""
    rows = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not sizes:
        return [], np.zeros((len(pieces), 0))
    languages = sorted(r.lang for r in sizes)
    shares = rows.sparkSession.createDataFrame([(r.lang, min(1.0, docs_per_lang / r.n)) for r in sizes], "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang")  # one row per language, as collected
    drawn = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(1 << 30)) < F.col("share") * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
                counts.setdefault(name, Counter()).update(words_of(value.as_py()))
            flat = [(name, word, n) for name, found in counts.items() for word, n in found.items()]
            names, words, n = zip(*flat) if flat else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())],
                                             names=["lang", "word", "n"])

    words = durable(rows.filter(drawn).select("text", "lang").mapInArrow(count, "lang string, word string, n bigint").groupBy(
        "lang", "word").agg(F.sum("n").alias("n")))
    fitted = []
    for part in _parts(languages):  # languages do not depend on each other
        probabilities = np.full((len(pieces), len(part)), 1.0 / max(1, len(pieces)))
        for _ in range(rounds):
            probabilities = _maximise(words.filter(F.col("lang").between(part[0], part[-1])), pieces, part, probabilities)
        fitted.append(probabilities)
    return languages, np.hstack(fitted)


def _parts(languages: list[str]) -> list[list[str]]:
    return [languages[at:at + LANGUAGES_AT_ONCE] for at in range(0, len(languages), LANGUAGES_AT_ONCE)]


def _maximise(words: DataFrame, pieces: list[str], languages: list[str], probabilities: np.ndarray) -> np.ndarray:
    model = words.sparkSession.sparkContext.broadcast((pieces, languages, probabilities))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value[1]
        lattice = Lattice(model.value[0], model.value[2])
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, word = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            n = batch.column(2).to_numpy()
            for name in set(lang.tolist()):
                places = np.flatnonzero(lang == name)
                found = lattice.expected_uses([word[k] for k in places], n[places], names.index(name))
                totals[name] = totals.get(name, 0) + found
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], names=["lang", "uses"])

    def total(table: pa.Table) -> pa.Table:
        uses = np.sum([np.frombuffer(u) for u in table.column("uses").to_pylist()], axis=0)
        return pa.table({"lang": table.column("lang")[:1], "uses": pa.array([uses.tobytes()], pa.binary())})

    kind = "lang string, uses binary"
    uses = np.zeros(probabilities.shape)
    for row in words.mapInArrow(expect, kind).groupBy("lang").applyInArrow(total, kind).collect():  # one row per language
        uses[:, languages.index(row.lang)] = np.frombuffer(row.uses)
    uses += SMOOTHING
    return uses / uses.sum(axis=0)


def predict(docs: DataFrame, pieces: list[str], languages: list[str], probabilities: np.ndarray, doc: str = "doc_id",
            text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row."""
    best = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.lit(UNDETERMINED).alias("lang_pred"),
                       F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("rest"))
    parts, at = _parts(languages), 0
    for k, part in enumerate(parts):
        best = _best_of(best, pieces, part, probabilities[:, at:at + len(part)], last=k == len(parts) - 1)
        at += len(part)
    return best.select("doc_id", "lang_pred", F.when(F.col("rest") > 0, 1 / F.col("rest")).otherwise(0.0).alias("score"))


def _best_of(rows: DataFrame, pieces: list[str], languages: list[str], probabilities: np.ndarray, last: bool) -> DataFrame:
    """The best language so far, its log-probability and the sum of all probabilities over its own, with these languages."""
    model = rows.sparkSession.sparkContext.broadcast((pieces, languages, probabilities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, languages, probabilities = model.value
        lattice = Lattice(pieces, probabilities)
        place: dict[str, int] = {}
        known, letters = np.zeros((0, len(languages))), 0

        def best_of_some(counts: list[Counter]) -> Iterator[tuple[str, float, float] | None]:
            nonlocal known, letters
            if known.size > KEPT_SCORES or letters > KEPT_LETTERS:
                place.clear()
                known, letters = np.zeros((0, len(languages))), 0
            new = sorted({word for found in counts for word in found if word not in place})
            if new:
                place.update(zip(new, range(len(known), len(known) + len(new))))
                known = np.vstack([known, lattice.log_probabilities(new)])
                letters += sum(map(len, new))
            for found in counts:
                if not found:
                    yield None
                    continue
                places = np.fromiter((place[w] for w in found), np.int64, len(found))
                total = np.fromiter(found.values(), np.float64, len(found)) @ known[places]
                best = int(total.argmax())
                yield languages[best], float(total[best]), float(np.exp(total - total[best]).sum())

        for batch in batches:
            answers, held, size = [], [], 0
            for value in batch.column(1):
                held.append(Counter(words_of(value.as_py())))
                size += len(held[-1])
                if size >= BATCH_WORDS:
                    answers += best_of_some(held)
                    held, size = [], 0
            answers += best_of_some(held)
            before = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
            names, tops, rests = zip(*map(_merged, before, answers)) if answers else ((), (), ())
            texts = pa.nulls(batch.num_rows, batch.column(1).type) if last else batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(rests, pa.float64())],
                names=["doc_id", "text", "lang_pred", "top", "rest"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def _merged(before: tuple[str, float, float], found: tuple[str, float, float] | None) -> tuple[str, float, float]:
    """The better of two (language, log-probability, sum over it), the sums added; the first one if they are equal."""
    if found is None:
        return before
    (_, top, rest), (_, other, more) = before, found
    if other > top:
        return found[0], other, more + rest * math.exp(top - other)
    return before[0], top, rest + more * math.exp(other - top)


def is_held_out(doc: Column) -> Column:
    """A quarter of all ids, kept from the fit; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc.cast("string")), F.lit(4)) == 2, F.lit(False))


def op5_language_id(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = fit(docs.filter(~is_held_out(F.col("doc_id"))), pieces)
    return predict(docs, pieces, *model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
