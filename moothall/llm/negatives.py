"""Hard-negative mining (11): slots between the positives' upper limits.

Anchors are a stated query set. An anchor's positives are its best rows of the same label, and each
positive opens a window of scores for negatives, from 30 % to 90 % of its own score. The upper limits of an
anchor's windows, in falling order, split scores into disjoint slots: slot j holds the scores that
exactly j limits reach. Each task keeps the best rows per anchor and slot of what it scans, and
these short lists are combined. A window is then answered by merging the slots from its own downward, until
it is full, so overlapping windows share one scan. Finding positives is the same scan with one slot.

The scan meets rows and anchors in blocks: anchors are dealt to chunks of ANCHORS_PER_CHUNK, rows
to slices of ROWS_PER_SLICE by a hash of their id, and each (chunk, slice) is one stretch of a sorted partition that a
task reads as a stream. A task holds one chunk, one block of rows and the lists; nothing is broadcast,
and no pair leaves it unless it is among the best of its slice. Labels play no part in the dealing, so a
label with a third of all rows is spread like any other. The work is rows x anchors, as asked.

Components are floor(256 x), x as double, held to 64-bit integers; inner products are exact (64-bit
integers, that wrap beyond). Among equal scores the smaller id is first.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part;
equal rows count once, and of different rows under one id the one with the smallest label and
vector counts; a shorter vector's missing components are 0; an anchor without positives, a positive below zero, or
one without negatives in its window gives no rows; an empty table gives none. Labels and ids are
integers. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.session import durable

POSITIVES, NEGATIVES = 5, 10
LOWER_TENTHS, UPPER_TENTHS = 3, 9  # of a positive's score
ANCHORS_PER_CHUNK = 32_768
ROWS_PER_SLICE = 200_000
CELLS = 2_000_000  # scores held at once
EXACT = float(1 << 53)
FOUND = "anchor_id bigint, slot int, score bigint, vec_id bigint"


def usable(vectors: DataFrame, vec: str, label: Column, embedding: str) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, one per id."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    read = vectors.filter(F.col(vec).isNotNull() & F.col(embedding).isNotNull()).filter(~bad).select(
        F.col(vec).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).alias("vec"))
    return read.filter("label IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select(
        "vec_id", "r.label", "r.vec")


def quantised(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of a list column as doubles that are whole numbers, padded to `width`."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and lengths.min() == lengths.max() == width:
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of whole-number vectors, as 64-bit integers."""
    high = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if high < EXACT:
        return (a @ b.T).astype(np.int64)
    limit = float((1 << 63) - 1024)
    with np.errstate(over="ignore"):
        return np.clip(a, -limit, limit).astype(np.int64) @ np.clip(b, -limit, limit).astype(np.int64).T


class SlotLists:
    """The best `k` rows per anchor and slot among the rows of one label relation."""

    def __init__(self, ids, labels, vectors, limits, floors, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.k, self.same = ids, labels, vectors, k, same
        self.limits = limits  # anchors x slots, falling; a slot is met from its limit down
        self.least = np.repeat(floors[:, None], limits.shape[1], axis=1)  # per slot, what is no use any more is below this
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # anchor, slot, score, id
        self.waiting: list[list[np.ndarray]] = []

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            scores = products(self.vectors, vectors[part])
            # The lowest slot holds what all windows share, so nothing below its list is of use.
            wanted = (scores <= self.limits[:, :1]) & (scores >= self.least[:, -1:])
            wanted &= (self.labels[:, None] == labels[part]) == self.same
            if self.same:
                wanted &= self.ids[:, None] != ids[part]
            anchor, row = np.nonzero(wanted)
            score = scores[anchor, row]
            slot = (self.limits[anchor] >= score[:, None]).sum(axis=1) - 1
            good = score >= self.least[anchor, slot]
            self.waiting.append([anchor[good], slot[good], score[good], ids[part][row[good]]])
            if sum(len(w[0]) for w in self.waiting) > CELLS // 4:
                self.settle()

    def settle(self) -> None:
        """Keep the best of what is held and waiting."""
        anchor, slot, score, ids = (np.concatenate(c) for c in zip(self.held, *self.waiting))
        order = np.lexsort((ids, -score, slot, anchor))
        anchor, slot, score, ids = (c[order] for c in (anchor, slot, score, ids))
        lists = anchor * self.limits.shape[1] + slot
        first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])) if len(lists) else np.zeros(0, np.int64)
        place = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        full = place == self.k - 1
        self.least[anchor[full], slot[full]] = np.maximum(self.least[anchor[full], slot[full]], score[full])
        kept = place < self.k
        self.held, self.waiting = [c[kept] for c in (anchor, slot, score, ids)], []

    def batch(self) -> pa.RecordBatch:
        self.settle()
        anchor, slot, score, ids = self.held
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[anchor]), pa.array(slot, pa.int32()), pa.array(score), pa.array(ids)],
            names=["anchor_id", "slot", "score", "vec_id"])


def scan(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, width: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, score, vec_id, rank): the best k rows per anchor and slot.

    `anchors` has vec_id, label, vec, `limits` (falling scores, at least one) and `least`, the lowest
    score of any use. `same` asks for other rows of the anchor's label, else for rows of other labels.
    """
    chunks = max(1, -(-n_anchors // ANCHORS_PER_CHUNK))
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(1, -(-n_rows // ROWS_PER_SLICE), -(-parallel // chunks))

    def dealt(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    asked = anchors.select("vec_id", "label", "vec", "limits", "least", dealt("chunk", chunks).alias("chunk")).withColumn(
        "slice", each(slices)).withColumn("kind", F.lit(0))
    read = rows.select("vec_id", "label", "vec", F.lit(None).cast("array<bigint>").alias("limits"), F.lit(None).cast("bigint").alias("least"),
                       dealt("slice", slices).alias("slice")).withColumn("chunk", each(chunks)).withColumn("kind", F.lit(1))
    met = asked.unionByName(read).repartition(chunks * slices, "chunk", "slice").sortWithinPartitions("chunk", "slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, queries, lists = None, [], None
        for batch in batches:
            cell = batch.column("chunk").to_numpy() * slices + batch.column("slice").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cell[a] != at:
                    if lists is not None:
                        yield lists.batch()
                    at, queries, lists = cell[a], [], None
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                vectors = quantised(part.column("vec"), width)
                if kind[a] == 0:
                    limits = part.column("limits").flatten().to_numpy().reshape(len(ids), -1)
                    queries.append((ids, labels, vectors, limits, part.column("least").to_numpy()))
                    continue
                if lists is None and queries:
                    lists, queries = SlotLists(*(np.concatenate(c) for c in zip(*queries)), k, same), []
                if lists is not None:
                    lists.add(ids, labels, vectors)
        if lists is not None:
            yield lists.batch()

    best = W.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")  # k rows per slice
    return met.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def tenths(score: Column, n: int, up: bool = False) -> Column:
    """n tenths of a score that is not negative, rounded down or up, without overflow."""
    ten = F.lit(10).cast("long")
    rest = F.pmod(score, ten) * n + (9 if up else 0)
    return F.call_function("div", score, ten) * n + F.call_function("div", rest, ten)


def mine(vectors: DataFrame, anchor: Column, vec: str = "vec_id", label: Column | str = "label", embedding: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` tells, from the column vec_id, which rows are anchors.
    """
    rows = durable(usable(vectors, vec, F.col(label) if isinstance(label, str) else label, embedding))
    anchors = rows.filter(anchor)
    n_rows, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n_anchors = anchors.count()
    high, low = (1 << 63) - 1, -(1 << 63)

    open_slot = anchors.withColumn("limits", F.array(F.lit(high))).withColumn("least", F.lit(low))
    found = durable(scan(rows, open_slot, n_rows, n_anchors, width, positives, True).filter("score >= 0").select(
        "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # Windows of an anchor in falling order; fewer than `positives` are filled up with limits that nothing reaches.
    score = F.col("positive_score")
    windows = durable(found.withColumn("upper", tenths(score, UPPER_TENTHS)).withColumn("lower", tenths(score, LOWER_TENTHS, up=True)))
    listed = windows.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "upper"))).alias("w"), F.min("lower").alias("least"))
    limits = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.get("w", k)["upper"], F.lit(low)))
    asked = anchors.join(listed.select("anchor_id", limits.alias("limits"), "least"), F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    slots = scan(rows, asked, n_rows, n_anchors, width, negatives, False)

    # Descending suffix merge: a window takes its own slot and those below, in order, until it is full.
    lists = slots.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("held"))
    met = windows.join(lists, "anchor_id")
    suffix = F.filter("held", lambda e: e["slot"] >= F.col("place") - 1)
    kept = F.filter(F.slice(suffix, 1, negatives), lambda e: e["negative_score"] >= F.col("lower"))
    return met.select("anchor_id", "positive_id", "positive_score", F.posexplode(kept).alias("rank", "e")).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), "e.negative_id", "positive_score", "e.negative_score")


def op11_hard_negatives(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(table, F.col("vec_id") % 100 == 0, label=moved)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                            row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id AS anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
      WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": OP11_SQL}
