"""Mixing sources to target weights (7): packed blocks, multinomial shards, permuted slots.

The documents of a source, in id order, form one stream of words that is cut into blocks of
fixed length. Sources in code point order weigh 1, 2, 3, repeating, and share out all words of the
corpus; a source's target stops at MOST_REPEATS times its size, and the excess is shared
again by weight until no target is above. A source's target is a number of slots, each one block.

Every slot of an output shard draws its source by a hash of the slot's number, in proportion to the
targets: the source counts of a shard are multinomial. Sources take slots in shard order, and a
source that has its number of slots gets no more; what others lack then follows in a last shard,
so the mix meets its targets while shards vary as drawn. Slot t of a source is block p(t mod n) of its n blocks,
where p is a pseudorandom permutation of 0..n-1 (swap-or-not rounds) that differs by source and
epoch, t div n. So no block is used again before all others were, and none more often than
MOST_REPEATS times. Slots meet the pieces of documents by block number.

Only (id, source, size) rows move, never texts. The places of documents in their streams come from
a range sort and the sums of its parts, not from a window over a source; a source with a third of all rows is spread over
parts, and blocks are spread by their number. The table of sources is summed in one task.

Defined cases: a null source is a source, last in order; a null text has size 0 and is not
taken; a null id sorts last; repeated rows are packed each; an empty table gives no rows; sizes of 0 give targets of 0. Reruns
agree, as all draws are hashes of numbers. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.operators.skew import running_total
from moothall.session import durable

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
ROUNDS = 12
SLOTS_PER_TASK = 200_000
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, place, source_size, before, target) from (source, size); one row per source, in one task.

    In order of the level at which a source is full, all before some source are full and the rest share
    what is left by weight; the level of that source is the common one.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    listed = sources.select("source", "source_size", place.cast("long").alias("place"),
                            (F.sum("source_size").over(by_name) - F.col("source_size")).alias("before"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    full = listed.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "place")
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("most").over(by_level) - F.col("most"))
    share = left / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    levels = full.withColumn("share", share).withColumn(
        "level", F.max(F.when(F.col("share") * F.col("weight") <= F.col("most"), F.col("share"))).over(everything))
    return levels.select("source", "place", "source_size", "before",
                         F.least("most", F.coalesce("level", "share") * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Where a pseudorandom permutation of 0..n-1 puts x: each round swaps x with k - x, or not, by a hash of the pair."""
    def step(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("key"), *key, i), n) - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit("swap"), *key, i, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def packed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(row, doc_id, source, place, size, start): where each document begins in its source's stream."""
    width = 1 << 33  # the room a part has in monotonically_increasing_id
    ordered = durable(rows.orderBy(F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "size").withColumn(
        "row", F.monotonically_increasing_id()))
    parted = ordered.withColumn("part", F.floor(F.col("row") / width))
    totals = parted.groupBy("part").agg(F.sum("size").alias("total"))
    inside = F.sum("size").over(W.partitionBy("part").orderBy("row")) - F.col("size")  # a part of the sort
    summed = parted.withColumn("inside", inside).join(F.broadcast(running_total(totals, "part", "total", "earlier")), "part")
    named = summed.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    return named.select("row", "doc_id", "source", "place", "size", (F.col("earlier") + F.col("inside") - F.col("before")).alias("start"))


def plan_slots(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, place, slot, block): every slot of the mix, its source and its block."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    asked = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    counted = sources.select("place", blocks.alias("blocks"), asked.alias("slots"))
    upto = F.sum("slots").over(W.orderBy("place"))
    counted = durable(counted.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("slots")))
    total, names = counted.agg(F.coalesce(F.max("upto"), F.lit(0)), F.count(F.lit(1))).first()
    cell = max(1, total // max(1, names))  # sources are found by the cell of a drawn number
    cells = counted.filter("slots > 0").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("upto") - 1) / cell))))
    drawn = F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(max(1, total)))
    slots = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // 4_000_000)).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), drawn.alias("drawn")).withColumn("cell", F.floor(F.col("drawn") / cell))
    chosen = slots.join(cells.select("cell", "place", "from", "upto"), "cell").filter("drawn >= from AND drawn < upto")
    draws = chosen.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n"))

    drawn_upto = F.sum("n").over(W.partitionBy("place").orderBy("shard"))  # one row per shard
    taken = durable(draws.withColumn("drawn_upto", drawn_upto)).join(counted, "place").select(
        "shard", "place", "blocks", F.least(F.col("drawn_upto") - F.col("n"), "slots").alias("first"), F.least("drawn_upto", "slots").alias("next"))
    got = draws.groupBy("place").agg(F.sum("n").alias("got"))
    last = F.lit(-(-total // shard_slots)).cast("long")
    lacking = counted.join(got, "place", "left").select(
        last.alias("shard"), "place", "blocks", F.least(F.coalesce("got", F.lit(0)), "slots").alias("first"), F.col("slots").alias("next"))
    # A run is a short row that stands for many slots, so runs are dealt out before they are listed.
    dealt = max(spark.sparkContext.defaultParallelism, total // SLOTS_PER_TASK + 1)
    runs = taken.unionByName(lacking).filter("first < next").repartition(dealt, "shard", "place")
    each = runs.select("shard", "place", "blocks", F.explode(F.sequence(F.col("first"), F.col("next") - 1)).alias("slot"))
    block = permuted(F.pmod("slot", F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("place"), F.floor(F.col("slot") / F.col("blocks")))
    return each.select("shard", "place", "slot", block.alias("block"))


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, pieces). Documents have a `row`; a piece is (shard, place, slot, row, first_word, n_words)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = durable(docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), size.alias("size")))
    sources = durable(source_targets(rows.select("source", "size")))
    streams = durable(packed(rows, sources))
    end = F.col("start") + F.col("size")
    cut = streams.filter("size > 0").select("row", "place", "start", end.alias("end"), F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    held = cut.select("row", "place", "block", (begin - F.col("start")).alias("first_word"),
                      (F.least(F.col("end"), (F.col("block") + 1) * block_words) - begin).alias("n_words"))
    # Both sides are lists taken out of short rows, which the planner takes for small tables: they must not be broadcast.
    slots = plan_slots(sources, block_words, shard_slots, seed).hint("shuffle_merge")
    pieces = slots.join(held.hint("shuffle_merge"), ["place", "block"])
    return streams, sources, pieces.select("shard", "place", "slot", "row", "first_word", "n_words")


def mixed_sizes(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of `docs`: words the mix takes, repeats counted."""
    streams, sources, pieces = mix(docs, **settings)
    taken = pieces.groupBy("row").agg(F.sum("n_words").alias("taken"))
    named = streams.join(sources.select("place", "source_size", "target"), "place")
    return named.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op7_mix_sources(spark, sf_dir):
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_mix_sources": op7_mix_sources}
ORACLES: dict[str, str] = {}
