"""N-gram Jaccard join (10): documents whose shingle sets are similar, and their groups.

A document's set holds its distinct shingles of `width` words (`[^\\x20\\x09-\\x0D]+` after A-Z are
lower-cased), or the whole sequence if it has fewer words. Two documents link if
100 * intersection >= percent * union. Shingles are compared by 64-bit hashes.

1. All shingles are counted in a table of fixed size by the high bits of their hash. Its
   logarithms, one byte each, give one order for all sets: rare shingles first, then by hash.
   The order decides speed only, never the result.
2. One pass makes each document's set size, set digest, rare-first prefix and histogram. Equal
   sets become one class; copies are combined before the shuffle.
3. Prefix shingles that classes share are the candidates. First, every class is compared with the
   smallest class it shares most of them with, and links are closed to groups. Then only classes
   in different groups are paired, on the shared shingle, those outside its largest group against all
   others: a large group of near copies costs its size, not its square.
   Pairs pass the length filter, the prefix filter, the positional filter and a suffix filter (both sets cut
   into 64 fixed parts: the part sizes bound their difference), and each pair is verified once.
4. Sets are made again from the text, only for classes of some candidate pair, by a pass over
   the documents with a Bloom filter of fixed size; it never hides a class, it only lets a few others through.
5. Links are closed to components, and classes carry them back to all documents.

Groups hold every link between different texts: a pair that is not compared is in one group
already or cannot reach the limit.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing;
ids that are no whole numbers are compared in their own order (texts by code point); a repeated row is a copy, and of two texts under one id the smaller one is verified; rows without an id have no component and take no part; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from moothall.llm.components import components
from moothall.llm.rolling import WordHasher, chunks
from moothall.operators.skew import number_rows
from moothall.session import durable

WIDTH, PERCENT = 3, 90
COUNT_BITS, COUNT_PARTS = 20, 64
BLOOM_BITS, BLOOM_HASHES = 26, 4
PARTS = 64
HEADS = 8


class Shingler(WordHasher):
    def __init__(self, width: int):
        code = np.arange(256)
        super().__init__((code != 32) & ((code < 9) | (code > 13)))
        self.width = width

    def windows(self, texts: list[bytes]):
        """Hashes of all windows that lie inside one text, and where each text's begin; short texts apart."""
        low, start, end, _, first = self.split(texts, b" ")
        words = self.hashes(low, start, end)
        return self.window_hashes(words, self.width), words, first

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Sorted distinct hashes per text."""
        windows, words, first = self.windows(texts)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= self.width:
                yield np.unique(windows[a:b - self.width + 1])
            elif n:
                yield self.window_hashes(words[a:b], n)
            else:
                yield np.zeros(0, np.uint64)


def shingle_classes(texts: DataFrame, width: int, bits: int = COUNT_BITS) -> np.ndarray:
    """One byte per value of the high `bits` of a hash: the logarithm of how often they occur."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, totals = Shingler(width), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, held in chunks(batch.column(0)):
                windows, words, first = shingler.windows(held)
                inside = np.ones(len(windows), bool)
                for k in range(1, width):  # windows that would cross into the next text
                    cross = first[1:-1] - k
                    inside[cross[(cross >= 0) & (cross < len(windows))]] = False
                totals += np.bincount((windows[inside] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = totals.reshape(COUNT_PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([_packed(parts[i]) for i in used], pa.binary())], names=["part", "counts"])

    size = (1 << bits) // COUNT_PARTS

    def total(table: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.int64)
        for held in table.column("counts").to_pylist():
            counts += np.frombuffer(held, np.int64 if len(held) == 8 * size else np.uint32).astype(np.int64)
        classes = np.ceil(np.log2(counts + 1) * 4).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([classes.tobytes()], pa.binary())})

    found = np.zeros((COUNT_PARTS, size), np.uint8)
    kind = "part int, counts binary"
    for row in texts.mapInArrow(count, kind).groupBy("part").applyInArrow(total, kind).collect():  # 2^bits bytes together
        found[row.part] = np.frombuffer(row.counts, np.uint8)
    return found.reshape(-1)


def _packed(counts: np.ndarray) -> bytes:
    return (counts.astype(np.uint32) if counts.max() < 1 << 32 else counts).tobytes()


def describe_sets(docs: DataFrame, classes, width: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, prefix, parts): set size, set digest, rare-first prefix, sizes of 64 parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rarity = Shingler(width), classes.value
        bits = len(rarity).bit_length() - 1
        for batch in batches:
            n, digests, prefixes, parts = [], [], [], []
            for _, texts in chunks(batch.column(1)):
                for tokens in shingler.sets(texts):
                    n.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                    order = np.lexsort((tokens, rarity[(tokens >> np.uint64(64 - bits)).astype(np.int64)]))
                    prefixes.append(tokens[order[: len(tokens) - -(-percent * len(tokens) // 100) + 1]].view(np.int64))
                    parts.append(np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=PARTS).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "n", "digest", "prefix", "parts"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, digest binary, prefix array<bigint>, parts array<int>")


def _bloom_of(ids: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter over the column `node`, of fixed size."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            for slots in _bloom_slots(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, slots >> 3, (128 >> (slots & 7)).astype(np.uint8))
        packed = bits.reshape(1 << 12, -1)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[i].tobytes() for i in used], pa.binary())], names=["part", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    packed = np.zeros((1 << 12, 1 << (BLOOM_BITS - 15)), np.uint8)
    for row in ids.mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        packed[row.part] = np.frombuffer(row.bits, np.uint8)
    return packed.reshape(-1)


def _bloom_slots(ids: np.ndarray) -> Iterator[np.ndarray]:
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for _ in range(BLOOM_HASHES):
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        yield (mixed >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens) with the sorted hashes, as bytes, of at least the documents in `wanted` (node)."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, packed = Shingler(width), bloom.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keep = np.ones(len(ids), bool)
            for slots in _bloom_slots(ids):
                keep &= (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
            places = pa.array(np.flatnonzero(keep))
            tokens = [t.tobytes() for _, held in chunks(batch.column(1).take(places)) for t in shingler.sets(held)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return docs.mapInArrow(run, "node bigint, tokens binary")


def _least_overlap(nx: Column, ny: Column, percent: int) -> Column:
    """Smallest whole intersection of linked sets of these sizes."""
    return F.ceil(percent * (nx + ny) / F.lit(100 + percent))


def _similar_size(nx: Column, ny: Column, percent: int) -> Column:
    return 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)


def _apart(x: str, y: str) -> Column:
    """Sum of the differences of part sizes: no more than the sets differ by."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, d: s + d)


def _most_apart(nx: Column, ny: Column, percent: int) -> Column:
    """Members of one of two linked sets alone, at most."""
    return nx + ny - 2 * _least_overlap(nx, ny, percent)


def _coarse(parts: str) -> Column:
    """Four parts added up; a size beyond 30,000 counts as that, which only narrows differences."""
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS // 4 - 1)), lambda k: F.least(
        F.lit(30_000), sum((F.get(parts, 4 * k + i) for i in range(1, 4)), F.get(parts, 4 * k)))).cast("array<smallint>")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the length and the suffix filter."""
    sides = [classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("parts").alias(f"parts_{k}")) for k in "ab"]
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return pairs.join(sides[0], "a").join(sides[1], "b").filter(
        _similar_size(n_a, n_b, percent) & (_apart("parts_a", "parts_b") <= _most_apart(n_a, n_b, percent))).select("a", "b")


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link; `docs` has an id once."""
    pairs = durable(pairs)
    wanted = durable(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = durable(_sets_of(docs, wanted, width))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return durable(both.mapInArrow(run, "a bigint, b bigint"))


def link_classes(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links between classes (node, n, prefix, parts)."""
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    common = entries.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("leader")).filter("holders > 1")
    shared = durable(entries.join(common.select("token", "leader"), "token"))

    # Each class against the class it shares most with, if that is a good part of its prefix.
    prefix_length = F.col("n") - F.ceil(percent * F.col("n") / F.lit(100)) + 1
    counted = shared.filter(F.col("node") != F.col("leader")).groupBy("node", "leader").agg(
        F.count(F.lit(1)).alias("common"), F.first("n").alias("n"))
    best = counted.filter(2 * F.col("common") >= prefix_length).groupBy("node").agg(
        F.max(F.struct("common", (-F.col("leader")).alias("leader"))).alias("best"))
    firsts = best.select(F.col("node").alias("a"), (-F.col("best.leader")).alias("b"))
    links = _verify(_possible(firsts, classes, percent), docs, width, percent)
    groups = components(links)

    # Then pairs over different groups. A shingle whose holders are all in one group is done.
    held = shared.select("token", "node", "n", "pos").join(groups, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    sizes = held.groupBy("token", "component").agg(F.count(F.lit(1)).alias("holders")).groupBy("token").agg(
        F.max(F.struct("holders", "component")).alias("main"), F.count(F.lit(1)).alias("groups"))
    held = held.join(sizes.filter("groups > 1").select("token", F.col("main.component").alias("main")), "token")
    heads = held.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, HEADS).alias("h"))
    heads = heads.select("node", F.transform("h", lambda e: e["token"]).alias("heads"))
    held = durable(held.join(classes.select("node", _coarse("parts").alias("coarse")), "node").join(heads, "node"))
    short = F.col("pos") < F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100 + percent)) + 1
    held = held.withColumn("short", short)
    fields = ("node", "n", "pos", "component", "short", "coarse", "heads")
    x = held.filter(F.col("component") != F.col("main")).select(
        F.col("token").alias("token_x"), *[F.col(c).alias(f"{c}_x") for c in fields])
    y = held.select("token", (F.col("component") == F.col("main")).alias("in_main_y"), *[F.col(c).alias(f"{c}_y") for c in fields])
    smaller_x = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    rest = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    # A pair with a common shingle among the first of both is met at that one only; others may be met more than once.
    first_common = F.get(F.array_intersect("heads_x", "heads_y"), F.lit(0))
    pairs = x.join(y, (F.col("token_x") == F.col("token")) & (F.col("component_x") != F.col("component_y"))
                   & (F.col("in_main_y") | (F.col("node_x") < F.col("node_y")))
                   & _similar_size(F.col("n_x"), F.col("n_y"), percent)
                   & F.when(smaller_x, F.col("short_x")).otherwise(F.col("short_y"))
                   & (rest >= _least_overlap(F.col("n_x"), F.col("n_y"), percent))
                   & F.coalesce(first_common == F.col("token"), F.lit(True))
                   & (_apart("coarse_x", "coarse_y") <= _most_apart(F.col("n_x"), F.col("n_y"), percent)))
    pairs = pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    return links.union(_verify(_possible(pairs, classes, percent), docs, width, percent))


def group_similar(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH,
                  percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row; the component is the smallest id reachable by links."""
    if not isinstance(docs.schema[doc].dataType, IntegralType):
        return _by_numbers(docs, doc, text, width, percent)
    read = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_classes(read.select("text"), width))
    described = durable(describe_sets(read, counts, width, percent))
    known = described.filter("doc_id IS NOT NULL AND n > 0")
    classes = durable(known.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parts").alias("parts")))
    once = read.filter("doc_id IS NOT NULL")
    if not known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        once = durable(once.groupBy("doc_id").agg(F.min("text").alias("text")))
    links = link_classes(once, classes, width, percent)
    found = classes.select("digest", "node").join(components(links), "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"))
    return described.select("doc_id", "n", "digest").join(found, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _by_numbers(docs: DataFrame, doc: str, text: str, width: int, percent: int) -> DataFrame:
    """The same for ids of another type, which are numbered in their order and named again at the end."""
    read = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    numbers = durable(number_rows(read.select("id").filter("id IS NOT NULL").distinct(), ["id"], "number"))
    found = group_similar(read.join(numbers, "id", "left").withColumn("number", F.col("number").cast("long")), "number", "text", width, percent)
    names = [numbers.select(F.col("number").alias(c), F.col("id").alias(f"{c}_name")) for c in ("doc_id", "component_id")]
    return found.join(names[0], "doc_id", "left").join(names[1], "component_id", "left").select(
        F.col("doc_id_name").alias("doc_id"), "n_shingles", F.col("component_id_name").alias("component_id"))


def op10_jaccard_join(spark, sf_dir):
    return group_similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES: dict[str, str] = {}
