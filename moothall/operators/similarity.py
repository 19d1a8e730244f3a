"""Nearest neighbours by edit distance and by cosine.

Neither search pairs rows. The searched side is cut into blocks or tiles of bounded size, a hot
group of copies into many of them; a searching row meets whole blocks and keeps its best
match per block. Bounds decide which blocks it has to meet, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moothall.functions import vectors as vec
from moothall.functions.text import FORUM_AREA, normalise_title
from moothall.operators.sampling import order_key
from moothall.operators.skew import skew_join
from moothall.session import durable

TEXTS_PER_BLOCK = 256
KEYS_PER_BLOCK = 1024
QUERIES_PER_BLOCK = 512
KEY_BLOCKS_PER_TILE, QUERY_BLOCKS_PER_TILE = 16, 32
TILES_PER_CELL = 1 << 32  # the room a cell has in the numbers of tiles
PRODUCT = 1 << 22  # similarities that are held at a time
FARTHEST = 10_000
REACHES = (2, 4)  # edits found through an index of one segment more
FEW_BLOCKS = 16
MOST_PIVOTS = 1024
RING_WIDTH = 0.05
SLACK = 1e-7


def _blocks(rows: DataFrame, on: list[str], spread: str, packed: Column, per_block: int) -> tuple[DataFrame, DataFrame]:
    """Pack rows into blocks of about `per_block` rows per key; also the blocks per key."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = counts.select(*on, F.ceil(F.col("n_rows") / per_block).cast("long").alias("n_blocks"))
    placed = skew_join(rows, sizes, on, [spread], counts=counts)
    blocks = placed.groupBy(*on, F.pmod(F.xxhash64(spread), "n_blocks").alias("block")).agg(
        F.collect_list(packed).alias("rows"))
    return blocks, sizes


# ---- edit distance ----

def _segment(length: Column, index: int, segments: int) -> tuple[Column, Column]:
    """Zero-based start and size of one of the equal segments of a text of that length."""
    base = F.floor(length / segments).cast("int")
    size = base if index < segments - 1 else length - base * (segments - 1)
    return base * index, size


def _segment_keys(text: Column, reach: int, shortest: int, longest: int) -> Column:
    """(length, index, segment) keys a text of up to `reach` edits away may share, for lengths that exist."""
    own = F.length(text)
    lengths = _lengths(own, reach, shortest, longest)

    def keys_at(index: int) -> Column:
        def keys_of(length: Column) -> Column:
            start, size = _segment(length, index, reach + 1)
            # Of the edits, at most `index` lie before this segment and the rest must make up the lengths.
            starts = F.filter(
                F.sequence(F.greatest(start - reach, F.lit(0)), start + reach), lambda at: (at + size <= own)
                & (F.abs(at - start) + F.abs(own - length - (at - start)) <= reach))
            return F.transform(starts, lambda at: F.struct(
                length.alias("length"), F.lit(index).alias("index"), F.substr(text, at + 1, size).alias("segment")))

        return F.flatten(F.transform(lengths, keys_of))

    return F.array_distinct(F.flatten(F.array(*[keys_at(index) for index in range(reach + 1)])))


def _lengths(own: Column, reach: int, shortest: int, longest: int) -> Column:
    first, last = F.greatest(own - reach, F.lit(shortest)), F.least(own + reach, F.lit(longest))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _closest(probes: DataFrame, blocks: DataFrame, sizes: DataFrame, on: list[str], reach: int) -> DataFrame:
    """Best (distance, pos) per probing text among the blocks of its keys, within `reach`."""
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    counts = probes.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
    met = skew_join(probes, sizes, on, ["q"], counts=counts).withColumn("block", every_block).drop("n_blocks")
    block_counts = counts.join(sizes, on).withColumn("block", every_block).drop("n_blocks")
    met = skew_join(met, blocks, [*on, "block"], ["q"], counts=block_counts)
    near = F.transform("rows", lambda r: F.struct(
        F.levenshtein(F.col("q"), r["t"], reach).alias("distance"), r["pos"].alias("pos")))
    best = F.array_min(F.filter(near, lambda r: r["distance"] >= 0))
    return met.select("q", best.alias("best")).groupBy("q").agg(F.min("best").alias("best")).filter("best IS NOT NULL")


def nearest_by_edit(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str) -> DataFrame:
    """For each left text the closest right text, case folded; ties go to the lowest id.

    Equal texts are matched first. Texts up to r edits apart share one of r + 1 segments, found by
    key, first for two edits and then for four. What is left is compared within a band of the
    lengths that exist, which doubles until the best match found lies within it: a text outside the
    band differs by more. Left rows without text, or with nothing below `FARTHEST` edits, get nulls.
    """
    low = F.lower(F.col(text))
    asked = durable(left.select(low.alias("q")).filter("q IS NOT NULL").groupBy("q").agg(
        F.count(F.lit(1)).alias("n_rows")))
    keys = durable(right.filter(F.col(text).isNotNull()).groupBy(low.alias("t")).agg(F.min(right_id).alias("pos")))
    equal = asked.join(keys, asked.q == keys.t).select(
        "q", F.struct(F.lit(0).alias("distance"), "pos").alias("best"))
    found = [equal]
    open_texts = durable(asked.select("q").join(equal, "q", "left_anti"))
    packed = F.struct("t", "pos")
    shortest, longest = keys.agg(F.min(F.length("t")), F.max(F.length("t"))).first()

    for reach in REACHES if shortest is not None else ():
        if open_texts.isEmpty():
            break
        on = ["length", "index", "segment"]
        segments = []
        for index in range(reach + 1):
            start, size = _segment(F.length("t"), index, reach + 1)
            segments.append(F.struct(F.length("t").alias("length"), F.lit(index).alias("index"),
                                     F.substr("t", start + 1, size).alias("segment")))
        indexed = keys.select("t", "pos", F.explode(F.array(*segments)).alias("k")).select("t", "pos", "k.*")
        blocks, sizes = _blocks(indexed, on, "t", packed, TEXTS_PER_BLOCK)
        probes = open_texts.select("q", F.explode(_segment_keys(F.col("q"), reach, shortest, longest)).alias("k")).select("q", "k.*")
        close = durable(_closest(durable(probes), blocks, sizes, on, reach))
        found.append(close)
        open_texts = durable(open_texts.join(close, "q", "left_anti"))

    if shortest is not None and not open_texts.isEmpty():
        blocks, sizes = _blocks(keys.withColumn("length", F.length("t")), ["length"], "t", packed, TEXTS_PER_BLOCK)
        blocks, sizes = durable(blocks), durable(sizes)
        reach = 2 * REACHES[-1]
        while not open_texts.isEmpty() and reach < 2 * FARTHEST:
            band = _lengths(F.length("q"), reach, shortest, longest)
            probes = open_texts.select("q", F.explode(band).alias("length"))
            close = durable(_closest(probes, blocks, sizes, ["length"], min(reach, FARTHEST - 1)))
            found.append(close)
            open_texts = durable(open_texts.join(close, "q", "left_anti"))
            reach *= 2

    best = reduce(DataFrame.unionByName, found).select("q", "best.distance", F.col("best.pos").alias(f"nearest_{right_id}"))
    asking = left.select(left_id, low.alias("q"))
    return skew_join(asking, best, ["q"], [left_id], "left", counts=asked).drop("q")


# ---- cosine ----

def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best_per_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best key per query of each pair of blocks, by one matrix product."""
    for batch in batches:
        ids, keys, sims, units = [], [], [], []
        for at in range(batch.num_rows):
            asked, held = batch.column("asked")[at].values, batch.column("rows")[at].values
            key_ids = held.field("id").to_numpy(zero_copy_only=False)
            order = np.argsort(key_ids, kind="stable")  # the first maximum is then the lowest id
            product = _matrix(asked.field("vec")) @ _matrix(held.field("vec"))[order].T
            best = product.argmax(axis=1)
            ids.append(asked.field("id").to_numpy(zero_copy_only=False))
            keys.append(key_ids[order][best])
            sims.append(product[np.arange(len(best)), best])
            units.append(np.full(len(best), batch.column("unit")[at].as_py(), dtype="int64"))
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(part)) for part in (units, ids, keys, sims)],
                names=["unit", "id", "key", "sim"])


def best_in_blocks(visits: DataFrame, blocks: DataFrame, on: list[str], unit: str | None = None) -> DataFrame:
    """Best key (unit, id, key, sim) over all blocks each query row (id, vec, keys `on`) visits.

    `unit` is the key column within which ids are unique, if they are not so by themselves.
    """
    counts = visits.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = counts.select(*on, F.ceil(F.col("n_rows") / QUERIES_PER_BLOCK).cast("long").alias("n_asked"))
    asked = skew_join(visits, sizes, on, ["id"], counts=counts).groupBy(
        *on, F.pmod(F.xxhash64("id"), "n_asked").alias("ask")).agg(F.collect_list(F.struct("id", "vec")).alias("asked"))
    pairs = skew_join(asked, blocks, on, ["ask"], counts=sizes.withColumnRenamed("n_asked", "n_rows"),
                      rows_per_salt=QUERIES_PER_BLOCK).select(
        "asked", "rows", (F.col(unit) if unit else F.lit(0)).cast("long").alias("unit"))
    best = pairs.mapInArrow(_best_per_block, "unit bigint, id bigint, key bigint, sim double")
    winner = F.max(F.struct("sim", (-F.col("key")).alias("low"), "key")).alias("w")
    return best.groupBy("unit", "id").agg(winner).select(
        "unit", "id", F.col("w.key").alias("key"), F.col("w.sim").alias("sim"))


def _best_in_tile(table: pa.Table) -> pa.Table:
    """Best key per query of one pair of tiles, PRODUCT similarities at a time."""
    held, asked = (table.filter(side).combine_chunks() for side in (table.column("is_key"), pc.invert(table.column("is_key"))))
    if not held.num_rows or not asked.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    key_ids = held.column("id").to_numpy()
    order = np.argsort(key_ids, kind="stable")  # the first maximum is then the lowest id
    key_ids, keys = key_ids[order], _matrix(held.column("vec").combine_chunks())[order].T
    queries = _matrix(asked.column("vec").combine_chunks())
    step, best, sims = max(1, PRODUCT // len(key_ids)), [], []
    for at in range(0, len(queries), step):
        product = queries[at:at + step] @ keys
        best.append(product.argmax(axis=1))
        sims.append(product[np.arange(len(product)), best[-1]])
    return pa.table({"id": asked.column("id"), "key": pa.array(key_ids[np.concatenate(best)], pa.int64()), "sim": pa.array(np.concatenate(sims))})


def _best_in_tiles(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """Best key (id, key, sim) of query rows (ask, id, vec, tiles) among the keys (tile, id, vec) of their tiles.

    A pair of a query tile `ask` and a key tile meets in one task, once for all of its rows, so rows move once per tile
    of the other side and a task holds two tiles. There is one row in `pairs` for so many rows of both sides.
    """
    pairs = asked.select("ask", F.explode("tiles").alias("tile")).distinct()
    sent = asked.select("ask", F.explode("tiles").alias("tile"), "id", "vec", F.lit(False).alias("is_key"))
    held = keys.join(F.broadcast(pairs), "tile").select("ask", "tile", "id", "vec", F.lit(True).alias("is_key"))
    best = sent.unionByName(held).groupBy("ask", "tile").applyInArrow(_best_in_tile, "id bigint, key bigint, sim double")
    winner = F.max(F.struct("sim", (-F.col("key")).alias("low"), "key")).alias("w")
    return best.groupBy("id").agg(winner).select("id", F.col("w.key").alias("key"), F.col("w.sim").alias("sim"))


def _assign(pivots: np.ndarray):
    """Nearest pivot and the ring of distances around it, per unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            distance = _distances(_matrix(batch.column("vec")), pivots)
            cell = distance.argmin(axis=1)
            ring = np.floor(distance[np.arange(len(cell)), cell] / RING_WIDTH).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), pa.array(cell.astype("int64")), pa.array(ring)],
                names=["id", "vec", "cell", "ring"])

    return run


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (vectors @ pivots.T), 0.0))


def _bounds(vectors: np.ndarray, pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots, and the least distance a key between a cell's rings can have."""
    distance = _distances(vectors, pivots)
    return distance, np.maximum(np.maximum(inner * RING_WIDTH - distance, distance - (outer + 1) * RING_WIDTH), 0.0)


def _likeliest(pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray):
    """The cell in which a query is searched first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            distance, bound = _bounds(_matrix(batch.column("vec")), pivots, inner, outer)
            cell = (bound + 1e-3 * distance).argmin(axis=1).astype("int64")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell)], names=["id", "vec", "cell"])

    return run


def _open_tiles(pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray, tiles: list[np.ndarray]):
    """The tiles of all cells that a query with a match of similarity `sim` cannot exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sim = batch.column("sim").to_numpy(zero_copy_only=False)
            reach = np.sqrt(np.maximum(2.0 - 2.0 * sim, 0.0)) + SLACK
            _, bound = _bounds(_matrix(batch.column("vec")), pivots, inner, outer)
            wanted = [np.concatenate([tiles[c] for c in np.flatnonzero(near)] or [np.zeros(0, "int64")]) for near in bound <= reach[:, None]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ask"), batch.column("id"), batch.column("vec"), pa.array(wanted, pa.list_(pa.int64()))],
                names=["ask", "id", "vec", "tiles"])

    return run


def _tiles(n_rows: int, blocks: int, per_block: int) -> int:
    return max(1, -(-n_rows // (blocks * per_block)))


def _search_few(asking: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Every query against every key, a pair of tiles at a time."""
    n_tiles, n_asks = _tiles(n_keys, KEY_BLOCKS_PER_TILE, KEYS_PER_BLOCK), _tiles(asking.count(), QUERY_BLOCKS_PER_TILE, QUERIES_PER_BLOCK)
    tiles = F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))
    asked = asking.select(F.pmod(F.xxhash64("id", "vec"), F.lit(n_asks)).alias("ask"), "id", "vec", tiles.alias("tiles"))
    return _best_in_tiles(asked, keys.select(F.pmod(F.xxhash64("id"), F.lit(n_tiles)).alias("tile"), "id", "vec"))


def _tiled(rows: DataFrame, per_tile: int, name: str, *spread: str) -> DataFrame:
    """Rows of cells with the number of their tile; the table of cells has at most MOST_PIVOTS rows."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per_tile).cast("long").alias("_n"))
    at = F.col("cell") * TILES_PER_CELL + F.pmod(F.xxhash64(*spread), "_n")
    return rows.join(F.broadcast(sizes), "cell").withColumn(name, at).drop("_n")


def _search_groups(asking: DataFrame, keys: DataFrame, n_keys: int, approx: bool) -> DataFrame:
    """Queries against the cells of keys that the triangle inequality does not exclude."""
    # at most MOST_PIVOTS vectors and cells, and a row per tile of keys reach the driver
    n_pivots = min(MOST_PIVOTS, n_keys // (KEY_BLOCKS_PER_TILE * KEYS_PER_BLOCK) + 1)
    pivots = np.array([r.vec for r in keys.orderBy(order_key("id", 0)).limit(n_pivots).collect()])
    placed = durable(keys.mapInArrow(_assign(pivots), "id bigint, vec array<double>, cell bigint, ring bigint"))
    held = durable(_tiled(placed, KEY_BLOCKS_PER_TILE * KEYS_PER_BLOCK, "tile", "id"))
    found = held.groupBy("cell", "tile").agg(F.min("ring").alias("inner"), F.max("ring").alias("outer")).orderBy("tile").collect()
    cells = sorted({r.cell for r in found})
    tiles = [np.array([r.tile for r in found if r.cell == c], dtype="int64") for c in cells]
    inner = np.array([min(r.inner for r in found if r.cell == c) for c in cells])
    outer = np.array([max(r.outer for r in found if r.cell == c) for c in cells])
    pivots = pivots[cells]
    likely = durable(asking.mapInArrow(_likeliest(pivots, inner, outer), "id bigint, vec array<double>, cell bigint"))
    asked = durable(_tiled(likely, QUERY_BLOCKS_PER_TILE * QUERIES_PER_BLOCK, "ask", "id", "vec"))
    first = F.array(*[F.lit(int(t[0])) for t in tiles])[F.col("cell").cast("int")]
    best = durable(_best_in_tiles(asked.select("ask", "id", "vec", F.array(first.cast("long")).alias("tiles")), held))
    if approx:
        return best
    wide = asked.join(best.select("id", "sim"), "id").select("ask", "id", "vec", "sim")
    visits = wide.mapInArrow(_open_tiles(pivots, inner, outer, tiles), "ask bigint, id bigint, vec array<double>, tiles array<bigint>")
    return _best_in_tiles(durable(visits), held)


def nearest_by_cosine(query: DataFrame, key: DataFrame, query_id: str, key_id: str, vector: str,
                      approx: bool = False, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """The key of highest cosine per query row; ties go to the lowest key id.

    A few blocks of keys are searched as they are. More keys are grouped into cells by their nearest
    pivot: a query first searches one tile of its likeliest cell; the triangle inequality then
    excludes every cell between whose rings no closer key can lie, and all tiles of the others are
    searched. Both ways give the same, exact result, whatever `few_blocks` says. `approx` always
    stops after one tile of the likeliest cell: it may miss the nearest key, but reports a true
    similarity. Equal vectors are searched once. Queries and keys meet as tiles: where nothing can
    be excluded, the products stay quadratic, but a row moves once per 16,384 rows of the other side.
    """
    spark = query.sparkSession
    output = f"nearest_{key_id}"

    def units(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).cast("long").alias("id"), vec.unit(F.col(vector)).alias("vec"))

    is_zero = vec.norm(F.col("vec")) == 0
    all_keys = durable(units(key, key_id).groupBy("vec").agg(F.min("id").alias("id")))
    keys, queries = all_keys.filter(~is_zero), durable(units(query, query_id))
    zero_key = all_keys.filter(is_zero).agg(F.min("id")).scalar()
    lowest = all_keys.agg(F.min("id")).scalar()
    n_keys = keys.count()
    best = spark.createDataFrame([], "id bigint, key bigint, sim double")
    if n_keys:
        asking = queries.filter(~is_zero)
        found_by_few = not approx and n_keys <= few_blocks * KEYS_PER_BLOCK
        best = (_search_few(asking, keys.select("id", "vec"), n_keys) if found_by_few
                else _search_groups(asking, keys.select("id", "vec"), n_keys, approx))
    zero_wins = zero_key.isNotNull() & ((F.col("sim") < 0) | ((F.col("sim") == 0) & (zero_key < F.col("key"))))
    found = best.select(
        F.col("id").alias(query_id), F.when(zero_wins, zero_key).otherwise(F.col("key")).alias(output),
        F.when(zero_wins, F.lit(0.0)).otherwise(F.col("sim")).alias("sim"))
    blank = queries.filter(is_zero | F.lit(n_keys == 0)).select(
        F.col("id").alias(query_id), lowest.alias(output), F.lit(0.0).alias("sim"))
    return found.unionByName(blank.filter(F.col(output).isNotNull()))


def match_corpora(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str,
                  title: str = "title", area: str = "area", wanted: str = FORUM_AREA) -> DataFrame:
    """Normalised left titles and the nearest right row of the wanted area."""
    nearest = nearest_by_cosine(left, right.filter(F.col(area) == wanted), left_id, right_id, vector)
    return left.select(left_id, normalise_title(F.col(title)).alias(title)).join(nearest, left_id)


def pair_similarity(a: DataFrame, b: DataFrame, on: str, vector: str) -> DataFrame:
    """Mean dot product of paired vectors."""
    paired = a.select(on, F.col(vector).alias("_a")).join(b.select(on, F.col(vector).alias("_b")), on)
    return paired.agg(F.avg(vec.dot(F.col("_a"), F.col("_b"))).alias("similarity"), F.count(F.lit(1)).alias("n_pairs"))


def soft_align(refs: DataFrame, cands: DataFrame, weights: DataFrame | None = None,
               pair: str = "pair_id", pos: str = "pos", vector: str = "vec") -> DataFrame:
    """Sum over reference tokens of weight times the best cosine among candidate tokens.

    The first and the last position of either side take no part. Weights are shares per
    (pair, pos), or 1/T for a reference of T tokens.
    """

    def inner(df: DataFrame) -> DataFrame:
        ends = df.groupBy(pair).agg(F.max(pos).alias("_last"), F.count(F.lit(1)).alias("_size"))
        tokens = skew_join(df, ends, [pair], [pos], counts=ends.withColumnRenamed("_size", "n_rows"))
        return tokens.filter((F.col(pos) > 0) & (F.col(pos) < F.col("_last"))).select(
            F.col(pair).alias("pair"), F.col(pos).cast("long").alias("pos"), "_size",
            vec.unit(F.col(vector)).alias("vec"))

    held = inner(cands).select("pair", F.col("pos").alias("id"), "vec")
    blocks, sizes = _blocks(held, ["pair"], "id", F.struct("id", "vec"), KEYS_PER_BLOCK)
    asked = inner(refs)
    if weights is None:
        asked = asked.withColumn("weight", 1 / F.col("_size"))
    else:
        shares = weights.select(F.col(pair).alias("pair"), F.col(pos).cast("long").alias("pos"), "weight")
        asked = asked.join(shares, ["pair", "pos"])
    counts = asked.groupBy("pair").agg(F.count(F.lit(1)).alias("n_rows"))
    visits = skew_join(asked, sizes, ["pair"], ["pos"], counts=counts).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    named = visits.select("pair", "block", F.col("pos").alias("id"), "vec")
    best = best_in_blocks(named, blocks, ["pair", "block"], unit="pair")
    best = best.select(F.col("unit").alias("pair"), F.col("id").alias("pos"), "sim")
    scored = asked.join(best, ["pair", "pos"])
    return scored.groupBy(F.col("pair").alias(pair)).agg(F.sum(F.col("weight") * F.col("sim")).alias("score"))


def pool(tokens: DataFrame, text: str, pos: str, vector: str, how: str = "mean") -> DataFrame:
    """One vector per text, the mean or the last of its token vectors."""
    if how == "last":
        return tokens.groupBy(text).agg(F.max_by(vector, pos).cast("array<double>").alias("vec"))
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return tokens.groupBy(text).agg(mean.alias("_v")).select(text, vector_to_array("_v").alias("vec"))


def changed_similarity(a: DataFrame, b: DataFrame, text: str, pos: str, vector: str, how: str = "mean") -> DataFrame:
    """Cosine of the original and the changed text."""
    old, new = pool(a, text, pos, vector, how), pool(b, text, pos, vector, how)
    joined = old.join(new.withColumnRenamed("vec", "_new"), text)
    return joined.select(text, vec.cosine(F.col("vec"), F.col("_new")).alias("similarity"))
