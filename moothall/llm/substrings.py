"""Substring dedup (13): repeated windows of words by anchors on a difference cover.

A window is `length` consecutive words of one text. A word is removed if it lies in a window whose words
also start earlier: in a text before it in (id, text hash) order, or in the same text further up.

A difference cover of a period m is a set of residues such that any two positions can be shifted by one amount
below m so that both fall on the set. So two equal windows always hold an anchor, a shorter window of
length - m + 1 words that starts on a residue of the set, at the same place in both. Only anchors are
hashed and dealt out first (3 of 7 positions for 20 words). A window with an anchor that occurs twice is a candidate.
Candidates are then extended to the whole window, by a hash of all its words, and the first place of each is found.

1. Tasks hash anchors of whole texts. Equal hashes of a task are combined: only the first place asks its bucket,
   all are known to be repeated, so an anchor that a third of all texts hold is one question per task and flush.
2. Each bucket of hashes tells which of its places are repeated; places go back to their texts.
3. Texts with candidates meet them by a join; their windows are hashed, combined (only the first place of a
   task's equal windows is sent on, the others are later copies already) and dealt to buckets in the same way.
4. Each bucket tells which places are not the first; texts meet these and lose the words.

Texts without an answer are told apart by a Bloom filter of fixed size and never shuffle; it hides no
text, it only lets a few others through. Buckets grow in number with the data, not in size. Anchor hashes
have 32 bits beside their bucket, and an accident only adds a candidate; windows have 64 bits beside
theirs. Every step is a written table or a shuffle that Spark can repeat.

Defined cases: a null text has no words and stays null; a text of fewer than `length` words has no window; null ids come
after all others; two texts under one id are ordered by a hash; repeated rows (same id and text) are
one place, so they get the same result; ids of any type that sorts will do, if they are not whole numbers
they are numbered first; an empty table gives no rows. Only the named columns are read; all others are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from moothall.llm.jaccard import _bloom_of, _bloom_slots
from moothall.llm.rolling import WordHasher, chunks
from moothall.operators.skew import number_rows
from moothall.session import durable

LENGTH = 20
# ---- fixed values: perfect difference sets by their period ----
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
# ---- end of fixed values ----
FLUSH = 1_000_000  # places a task combines at a time
BUCKET_PLACES = 750_000
WORD_BYTES = 6  # of a common text, to size buckets
LAST = (1 << 63) - 1
ANSWER = "rank bigint, body bigint, places array<int>"
PACKED = "target bigint, rank binary, body binary, at binary"
SENT = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("keys", "doc", "at", "rank", "body"))])


def period(length: int) -> int:
    """The longest period that leaves anchors of two thirds of the window or more."""
    return max(m for m in COVERS if 3 * (m - 1) <= length)


def identified(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The documents with __rank, in the order of their ids, and __body, a hash of the text."""
    body = F.xxhash64(F.col(text)).alias("__body")
    if isinstance(docs.schema[doc].dataType, IntegralType):
        return docs.select("*", F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("__rank"), body)
    ids = number_rows(docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("__id")).distinct(), ["__id"], "__rank")
    named = docs.join(ids, F.col(doc) == F.col("__id"), "left").drop("__id")
    return named.select(*docs.columns, F.coalesce("__rank", F.lit(LAST)).alias("__rank"), body)


class Places:
    """Keys and their places, combined and cut up by bucket."""

    def __init__(self, buckets: int, later: bool):
        self.buckets, self.later = buckets, later
        self.rank, self.body, self.seen = [], [], set()
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, rank: int, body: int, bucket: np.ndarray, key: np.ndarray, at: np.ndarray) -> None:
        if len(at) and (rank, body) not in self.seen:  # repeated rows are one place
            self.seen.add((rank, body))
            self.parts.append((bucket, key, np.full(len(at), len(self.rank), np.uint32), at.astype(np.uint32)))
            self.rank.append(rank)
            self.body.append(body)
            self.size += len(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        bucket, key, doc, at = (np.concatenate(c) for c in zip(*self.parts))
        rank, body = np.array(self.rank, np.int64), np.array(self.body, np.int64)
        by_place = np.lexsort((body, rank))  # documents in order
        rank, body = rank[by_place], body[by_place]
        doc = np.argsort(by_place).astype(np.uint32)[doc]
        order = np.lexsort(((doc.astype(np.uint64) << np.uint64(32)) | at, key, bucket))
        bucket, key, doc, at = bucket[order], key[order], doc[order], at[order]
        first = np.append(True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1]))
        known = ~first if self.later else ~(first & np.append(first[1:], True))  # later ones, or all met more than once
        yield from self._cut(bucket[first], key[first], doc[first], at[first], rank, body, False)
        if known.any():  # answers of this task; they pass through some bucket on their way
            spread = (doc[known] % np.uint32(self.buckets)).astype(np.uint32)
            order = np.argsort(spread, kind="stable")
            yield from self._cut(spread[order], key[known][order], doc[known][order], at[known][order], rank, body, True)
        self.rank, self.body, self.seen, self.parts, self.size = [], [], set(), [], 0

    def _cut(self, bucket, key, doc, at, rank, body, known: bool) -> Iterator[pa.RecordBatch]:
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            used, local = np.unique(doc[a:b], return_inverse=True)
            values = (key[a:b], _narrow(local), _narrow(at[a:b]), rank[used], body[used])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a])], pa.int64()), pa.array([known]), *(pa.array([v.tobytes()], pa.binary()) for v in values)], schema=SENT)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold the greatest."""
    return values.astype(np.min_scalar_type(int(values.max())))


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.uint32)


def _answers(table: pa.Table, key_kind: type, later: bool, targets: int) -> pa.Table:
    """The repeated places of one bucket, or those that are not the first, packed by the target that collects their text."""
    parts: dict[bool, list[tuple]] = {True: [], False: []}
    for row in table.select(SENT.names[1:]).to_pylist():
        key = np.frombuffer(row["keys"], key_kind)
        doc = _wide(row["doc"], len(key))
        parts[row["known"]].append((key, np.frombuffer(row["rank"], np.int64)[doc], np.frombuffer(row["body"], np.int64)[doc],
                                    _wide(row["at"], len(key))))
    told = [p[1:] for p in parts[True]]
    if parts[False]:
        key, rank, body, at = (np.concatenate(c) for c in zip(*parts[False]))
        order = np.argsort(key, kind="stable")
        key = key[order]
        alike = np.append(False, key[1:] == key[:-1])
        shared = alike | np.append(alike[1:], False)
        order, key = order[shared], key[shared]  # of keys met once nothing is left to find out
        if later and len(order):
            order = order[np.lexsort((at[order], body[order], rank[order], key))]
            first = np.append(True, key[1:] != key[:-1])
            lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            order = order[(rank[order] != rank[lead]) | (body[order] != body[lead]) | (at[order] != at[lead])]
        told.append((rank[order], body[order], at[order]))
    rank, body, at = (np.concatenate(c) for c in zip(*told))
    target = ((body ^ rank).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(targets)
    order = np.argsort(target, kind="stable")
    target, rank, body, at = target[order].astype(np.int64), rank[order], body[order], at[order]
    edges = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
    cuts = list(zip(edges.tolist(), [*edges.tolist()[1:], len(target)]))
    return pa.table([pa.array(target[edges], pa.int64()), *(pa.array([v[a:b].tobytes() for a, b in cuts], pa.binary()) for v in (rank, body, at))],
                    names=["target", "rank", "body", "at"])


def _collected(table: pa.Table, reach: int) -> pa.Table:
    """(rank, body, places) of the texts of one target; with a reach, the starts from which a place is less than that away."""
    rank, body, at = (np.concatenate([np.frombuffer(v, kind) for v in table.column(name).to_pylist()])
                      for name, kind in (("rank", np.int64), ("body", np.int64), ("at", np.uint32)))
    order = np.lexsort((at, body, rank))
    rank, body, at = rank[order], body[order], at[order].astype(np.int64)
    edges = np.flatnonzero(np.append(True, (rank[1:] != rank[:-1]) | (body[1:] != body[:-1])))
    places = []
    for a, b in zip(edges.tolist(), [*edges.tolist()[1:], len(at)]):
        found = at[a:b]
        if reach:
            found = (found[:, None] - np.arange(reach)).ravel()
        places.append(np.unique(found[found >= 0]).astype(np.int32))
    return pa.table({"rank": pa.array(rank[edges]), "body": pa.array(body[edges]), "places": pa.array(places, pa.list_(pa.int32()))})


def answered(sent: DataFrame, key_kind: type, later: bool, buckets: int, reach: int = 0) -> DataFrame:
    """(rank, body, places): what the buckets answer, by text. Buckets and targets hold about as much, however large the data."""
    told = sent.groupBy("bucket").applyInArrow(lambda t: _answers(t, key_kind, later, buckets), PACKED)
    return told.groupBy("target").applyInArrow(lambda t: _collected(t, reach), ANSWER)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)


def _hasher() -> WordHasher:
    code = np.arange(256)
    hasher = WordHasher(~((code == 32) | ((code >= 9) & (code <= 13))))
    hasher.lower = np.arange(256, dtype=np.uint8)  # words as they are
    return hasher


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Batches of (rank, body, text, ...) with row numbers and the word hashes of their texts."""
    hasher = _hasher()
    for batch in batches:
        for at, texts in chunks(batch.column(2)):
            low, start, end, _, first = hasher.split(texts, b"\n")
            words = hasher.hashes(low, start, end)
            for k in range(len(texts)):
                yield batch, at + k, words[first[k]:first[k + 1]]


def candidate_windows(read: DataFrame, length: int, buckets: int) -> DataFrame:
    """(rank, body, places): starts of windows with a repeated anchor, of texts (rank, body, text)."""
    m = period(length)
    cover, width = COVERS[m], length - m + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Places(buckets, False)
        for batch, k, words in _hashed(batches):
            if len(words) < length:
                continue
            hashes = WordHasher.window_hashes(words, width)
            at = np.flatnonzero(np.isin(np.arange(m), cover)[np.arange(len(hashes)) % m])
            found = hashes[at]
            sent.add(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), _bucket(found, buckets), found.astype(np.uint32), at)
            if sent.size > FLUSH:
                yield from sent.flush()
        yield from sent.flush()

    return answered(read.mapInArrow(run, _sent_schema()), np.uint32, False, buckets, reach=m)


def later_windows(met: DataFrame, length: int, buckets: int) -> DataFrame:
    """(rank, body, places): starts of windows that also start earlier, of (rank, body, text, places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Places(buckets, True)
        for batch, k, words in _hashed(batches):
            at = batch.column(3)[k].values.to_numpy()
            at = at[at <= len(words) - length]
            mixed = (words ^ (words >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            sent.add(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(),
                     _bucket(WordHasher.window_hashes(mixed, length)[at], buckets), WordHasher.window_hashes(words, length)[at], at)
            if sent.size > FLUSH:
                yield from sent.flush()
        yield from sent.flush()

    return answered(met.mapInArrow(run, _sent_schema()), np.uint64, True, buckets)


def _sent_schema() -> str:
    return "bucket bigint, known boolean, " + ", ".join(f"`{c}` binary" for c in SENT.names[2:])


def _told_apart(read: DataFrame, answers: DataFrame, inside: bool) -> DataFrame:
    """The rows of `read` that may have an answer, or those that have none; __rank and __body are its last columns."""
    node = F.xxhash64("rank", "body").alias("node")
    bloom = read.sparkSession.sparkContext.broadcast(_bloom_of(answers.select(node)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = bloom.value
        for batch in batches:
            nodes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            held = np.ones(len(nodes), bool)
            for slots in _bloom_slots(nodes):
                held &= (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
            yield batch.filter(pa.array(held == inside))

    named = read.withColumn("__node", F.xxhash64("__rank", "__body"))
    return named.mapInArrow(run, named.schema).drop("__node")


def find_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(rank, body, places): starts of later windows, per text of `identified` documents that has any."""
    spark = docs.sparkSession
    read = docs.select(F.col("__rank").alias("rank"), F.col("__body").alias("body"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    density = len(COVERS[period(length)]) / period(length)
    parallel = spark.sparkContext.defaultParallelism
    windows = durable(candidate_windows(read, length, max(parallel, int(n_bytes / WORD_BYTES * density / BUCKET_PLACES))))
    places = windows.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    asked = _told_apart(read.withColumnsRenamed({"rank": "__rank", "body": "__body"}), windows, True)
    met = asked.join(windows, (F.col("__rank") == F.col("rank")) & (F.col("__body") == F.col("body"))).select("rank", "body", "text", "places")
    return durable(later_windows(met, length, max(parallel, places // BUCKET_PLACES)))


def drop_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH,
                 one_space: bool = False, counted: tuple[str, str] | None = None) -> DataFrame:
    """The documents, all columns kept, without the words of later windows.

    A removed run takes the white space behind it along; with `one_space` the words that stay are joined by
    one space in every text. `counted` names two more columns: words before, and words removed.
    """
    named = identified(docs, doc, text)
    later = find_repeats(named, doc, text, length)
    at, own = docs.columns.index(text), len(docs.columns)
    counts = counted or ("__words", "__removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for value, places in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                new, n, gone = _cut(value.as_py(), places.values.to_numpy() if places.is_valid else None, length, one_space)
                texts.append(new)
                n_words.append(n)
                n_removed.append(gone)
            columns = list(batch.columns[:own])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*batch.schema.names[:own], *counts])

    schema = docs.select("*", F.lit(0).cast("long").alias(counts[0]), F.lit(0).cast("long").alias(counts[1])).schema
    answer = later.select(F.col("rank").alias("__r"), F.col("body").alias("__b"), F.col("places").alias("__places"))
    some = _told_apart(named, later, True).join(answer, (F.col("__rank") == F.col("__r")) & (F.col("__body") == F.col("__b")), "left")
    none = _told_apart(named, later, False).withColumn("__places", F.lit(None).cast("array<int>"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = some.select(*columns, "__places").mapInArrow(run, schema).unionByName(none.select(*columns, "__places").mapInArrow(run, schema))
    return out if counted else out.drop(*counts)


def _cut(text: str | None, places: np.ndarray | None, length: int, one_space: bool) -> tuple[str | None, int, int]:
    """(text, words, removed words) after the windows at `places` went."""
    if text is None:
        return None, 0, 0
    data = text.encode()
    words = data.split()  # bytes split at space and 09-0D alone
    if places is None or not len(places):
        return (b" ".join(words).decode() if one_space else text), len(words), 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    removed = int(len(words) - kept.sum())
    if one_space:
        return b" ".join(compress(words, kept.tolist())).decode(), len(words), removed
    _, start, _ = _hasher().words(np.frombuffer(data, np.uint8))
    bounds = np.append(start, len(data)).tolist()
    parts = [data[:bounds[0]]] + [data[bounds[k]:bounds[k + 1]] for k in np.flatnonzero(kept).tolist()]
    return b"".join(parts).decode(), len(words), removed


def op13_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = drop_repeats(docs, one_space=True, counted=("n_words", "n_removed"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) AS h, md5(array_to_string(w[i:i + 19], ' ')) AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h, t ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLES = {"op13_substring_dedup": OP13_SQL}
