"""Benchmark decontamination (9): exact test passages found in training texts.

Words are runs of digits, a-z (A-Z lower-cased first) and non-ASCII characters. A window is
`width` consecutive words of one test item, or the whole item if it has fewer, but not none. A
training word inside any occurrence of a window is hit.

The windows of the test set are hashed into a bitmap of fixed size that every task gets, and a
training text is scanned once, all windows at a time. Positions that pass the bitmap are
verified by comparing the words themselves: in the task, against a broadcast table, if the
windows have at most `broadcast_bytes`; otherwise by a join on the window text. Both ways give the same
rows.

Defined cases: a null or wordless text has no words and is clean; an item without words has no
window; a null item id is listed as the empty string; an item listed twice counts once; repeated
documents give repeated rows; an empty test set leaves all documents clean. Only the named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.llm.rolling import WordHasher, chunks
from moothall.session import durable

WIDTH = 10
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 23
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (window, item) pairs; a window is its words joined by single spaces."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    n = F.size("_words")
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("_words", i + 1, width), " "))
    listed = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words.alias("_words"))
    return listed.filter(n > 0).select(F.explode(windows).alias("window"), "item").distinct()


class Scanner(WordHasher):
    """Finds, in many texts at once, the windows whose hash is in the bitmap."""

    def __init__(self, lengths: list[int], bitmap: np.ndarray):
        code = np.arange(256)
        super().__init__(((code >= 48) & (code <= 57)) | ((code >= 97) & (code <= 122)) | (code >= 128))
        self.lengths, self.bitmap = lengths, bitmap

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)

    def scan(self, texts: list[bytes]):
        """Per text: its words as a function of a range, their number and candidate (start, length)."""
        low, start, end, ends, first = self.split(texts, b"\x00")
        hashes = self.hashes(low, start, end)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        for length in self.lengths:
            passed = np.flatnonzero(self.bitmap[self.slots(self.window_hashes(hashes, length))])
            passed = passed[owner[passed] == owner[passed + length - 1]]
            for at in passed.tolist():
                found[owner[at]].append((at - first[owner[at]], length))
        raw = low.tobytes()

        def window(k: int, at: int, length: int) -> str:
            a = first[k] + at
            return b" ".join(raw[s:e] for s, e in zip(start[a:a + length].tolist(), end[a:a + length].tolist())).decode()

        spans = (start, end, ends)
        return np.diff(first), found, window, first, spans


def _table(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """Window lengths in use (at most `width`) and the bitmap of all window hashes."""
    lengths = sorted(r[0] for r in windows.select(F.size(F.split("window", " ")).alias("n")).distinct().collect())
    everything = Scanner([], np.zeros(0, bool))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                low, start, end = everything.words(np.frombuffer(text.encode(), np.uint8))
                bits[everything.slots(everything.window_hashes(everything.hashes(low, start, end), len(start)))] = True
        packed = np.packbits(bits).reshape(1 << 10, -1)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["part", "bits"])

    packed = np.zeros((1 << 10, (1 << BITMAP_BITS) >> 13), np.uint8)
    parts = windows.select("window").mapInArrow(slots, "part int, bits binary")
    merged = parts.groupBy("part").applyInArrow(_any_bits, "part int, bits binary")
    for row in merged.collect():  # the bitmap: a fixed size
        packed[row.part] |= np.frombuffer(row.bits, np.uint8)
    return lengths, np.unpackbits(packed.reshape(-1)).astype(bool)


def _any_bits(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _covered(n: int, hits: list[tuple[int, int]]) -> np.ndarray:
    edges = np.zeros(n + 1, np.int32)
    for at, length in hits:
        edges[at] += 1
        edges[at + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def find_hits(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
              item_text: str = "text", width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items): hit words and the sorted ids of the items found, per document."""
    windows = durable(benchmark_windows(items, item, item_text, width))
    if windows.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()[0] > broadcast_bytes:
        return _hits_by_join(docs, windows, doc, text).drop(*KEY, "words")
    lookup = docs.sparkSession.sparkContext.broadcast((*_table(windows), _by_window(windows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bitmap, known = lookup.value
        scanner = Scanner(lengths, bitmap)
        for batch in batches:
            n_words, n_hit, found_items = [], [], []
            for _, texts in chunks(batch.column(1)):
                sizes, found, window, _, _ = scanner.scan(texts)
                for k, size in enumerate(sizes.tolist()):
                    hits, ids = _verified(found[k], lambda at, length, k=k: window(k, at, length), known)
                    n_words.append(size)
                    n_hit.append(int(_covered(size, hits).sum()) if hits else 0)
                    found_items.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(found_items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    read = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>")


def _by_window(windows: DataFrame) -> dict[str, list[str]]:
    known: dict[str, list[str]] = {}
    for row in windows.collect():  # under the byte bound checked by the caller
        known.setdefault(row.window, []).append(row.item)
    return known


def _verified(candidates, window, known) -> tuple[list[tuple[int, int]], list[str]]:
    hits, ids = [], set()
    for at, length in candidates:
        items = known.get(window(at, length))
        if items:
            hits.append((at, length))
            ids.update(items)
    return hits, sorted(ids)


def _row_key(doc: str, text: str) -> list[Column]:
    """What tells rows apart in a join: the id as text, whether there is one, and a digest of the text."""
    return [F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("_id"), F.col(doc).isNull().alias("_missing"),
            F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_digest")]


KEY = ["_id", "_missing", "_digest"]


def _hits_by_join(docs: DataFrame, windows: DataFrame, doc: str, text: str) -> DataFrame:
    """The same rows for a test set of any size, and the places of hit words: candidates meet the windows in a join."""
    lookup = docs.sparkSession.sparkContext.broadcast(_table(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*lookup.value)
        for batch in batches:
            ids, keys = batch.column(0), batch.columns[2:]
            for at, texts in chunks(batch.column(1)):
                sizes, found, window, _, _ = scanner.scan(texts)
                rows = [(at + k, int(sizes[k]), None, None, None) for k in range(len(texts))]
                rows += [(at + k, None, start, length, window(k, start, length))
                         for k, hits in enumerate(found) for start, length in hits]
                place, n, start, length, key = zip(*rows)
                taken = pa.array(place)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(taken), *(k.take(taken) for k in keys), pa.array(n, pa.int64()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(key, pa.string())],
                    names=["doc_id", *KEY, "n_words", "at", "length", "window"])

    read = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), *_row_key(doc, text))
    kind = read.schema["doc_id"].dataType.simpleString()
    scanned = durable(read.mapInArrow(
        run, f"doc_id {kind}, _id string, _missing boolean, _digest string, n_words bigint, at bigint, length bigint, window string"))
    candidates = scanned.filter("window IS NOT NULL").select(*KEY, "at", "length", "window").distinct()
    # Places are combined one by one, so that a row with many windows is spread; the words of one text come together.
    found = durable(candidates.join(windows, "window"))
    words = found.select(*KEY, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("word")).groupBy(*KEY).agg(
        F.collect_set("word").alias("words"))
    items = found.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = scanned.filter("window IS NULL").select("doc_id", "n_words", *KEY)
    return rows.join(words.join(items, KEY), KEY, "left").select(
        "doc_id", "n_words", F.coalesce(F.size("words").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), *KEY, "words")


def decontaminate(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", width: int = WIDTH, action: str = "drop", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, all columns kept, without contaminated ones (`drop`) or without hit words (`cut`).

    A cut takes the bytes from the first to the last word of each run of hit words. If the windows
    have more than `broadcast_bytes`, rows meet what is known of their id and text in a join, with the same result.
    """
    windows = durable(benchmark_windows(items, item, item_text, width))
    size = windows.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _without_hits(docs, _hits_by_join(docs, windows, doc, text).filter("n_hit > 0"), doc, text, action)
    lookup = docs.sparkSession.sparkContext.broadcast((*_table(windows), _by_window(windows)))
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, bitmap, known = lookup.value
        scanner = Scanner(lengths, bitmap)
        for batch in batches:
            kept, changed = np.ones(batch.num_rows, bool), {}
            for at, texts in chunks(batch.column(column)):
                sizes, found, window, first, (start, end, ends) = scanner.scan(texts)
                for k in range(len(texts)):
                    if not found[k]:
                        continue
                    hits, _ = _verified(found[k], lambda a, length, k=k: window(k, a, length), known)
                    if hits and action == "drop":
                        kept[at + k] = False
                    elif hits:
                        hit = _covered(int(sizes[k]), hits)
                        offset = int(ends[k]) - len(texts[k]) - 1
                        changed[at + k] = _cut(texts[k], hit, start[first[k]:first[k + 1]] - offset, end[first[k]:first[k + 1]] - offset)
            arrays = list(batch.columns)
            if changed:
                arrays[column] = pa.array([changed.get(k, v) for k, v in enumerate(batch.column(column).to_pylist())], pa.string())
            out = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
            yield out.filter(pa.array(kept)) if not kept.all() else out

    return docs.mapInArrow(run, docs.schema)


def _without_hits(docs: DataFrame, dirty: DataFrame, doc: str, text: str, action: str) -> DataFrame:
    """`decontaminate` from the hits of a join."""
    hits = dirty.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("words").alias("__words")).dropDuplicates([f"_{c}" for c in KEY])
    same = [k == F.col(f"_{c}") for c, k in zip(KEY, _row_key(doc, text))]
    same = same[0] & same[1] & same[2]
    if action == "drop":
        return docs.join(hits, same, "left_anti")
    column, own, schema = docs.columns.index(text), len(docs.columns), docs.schema
    joined = docs.join(hits, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner([], np.zeros(0, bool))
        for batch in batches:
            arrays, texts = list(batch.columns[:own]), batch.column(column).to_pylist()
            for k, words in enumerate(batch.column(own)):
                if words.is_valid:
                    data = texts[k].encode()
                    _, start, end = scanner.words(np.frombuffer(data, np.uint8))
                    hit = np.zeros(len(start), bool)
                    hit[words.values.to_numpy()] = True
                    texts[k] = _cut(data, hit, start, end)
            arrays[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:own])

    return joined.mapInArrow(run, schema)


def _cut(text: bytes, hit: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        out.append(text[at:start[a]])
        at = end[b - 1]
    return b"".join([*out, text[at:]]).decode()


def items_digest(items: list[str]) -> str:
    """Lowercase hex SHA-256 of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op9_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_hits(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN w IS NULL THEN CAST([] AS VARCHAR[]) ELSE w END AS w FROM words),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[i:i + 9], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
       FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
             FROM d, (SELECT DISTINCT width FROM bw) WHERE len(w) >= width)),
hits AS (SELECT doc_id, i, dw.width AS width, item FROM dw JOIN bw ON dw.win = bw.win AND dw.width = bw.width),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": OP9_SQL}
