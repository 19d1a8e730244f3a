"""Token counts (2): a cache of counts keyed by digests of content and tokenizer.

The digest of a text's normalised content and the digest of the tokenizer (its file, the
library's version and the call) are joined to stored counts. Only texts whose digest has no
count are encoded, each distinct one once, and the new counts are appended to the cache, a
parquet table that later runs read.

The texts of the misses move through one shuffle, grouped by digest; copies are combined in the
task that reads them, so a text with a third of all rows moves once per task. Counts come back
through a narrow join on the digest.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens) and a null id stays
null; repeated rows give repeated rows; an empty table gives no rows. A cache that got the same
digest twice (two writers) is read as one entry. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moothall.session import scratch_path

LIMIT = 512
BATCH_BYTES = 1 << 20
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"


def normalised(text: Column) -> Column:
    """What is digested and encoded. Byte-level counts depend on every byte, so only null changes."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary file's content, the library's version and the way it is called."""
    import tokenizers

    content = hashlib.sha256(Path(path).read_bytes()).hexdigest()  # a file of the installed package, on every machine
    return hashlib.sha256(f"{content} tokenizers {tokenizers.__version__} plain".encode()).hexdigest()


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text), without added special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = load_tokenizer(path)
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column(1):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    counts += [len(e.ids) for e in tokenizer.encode_batch(held, add_special_tokens=False)]
                    held, size = [], 0
            counts += [len(e.ids) for e in tokenizer.encode_batch(held, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) stored for this tokenizer; empty if nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache) if exists else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row; `cache` is a folder that all executors share."""
    spark, tokenizer = docs.sparkSession, tokenizer_digest(path)
    content = normalised(F.col(text))
    digest = F.unhex(F.sha2(content, 256))
    # Copies are combined before the shuffle; the cache then meets texts that lie by digest already.
    distinct = docs.select(digest.alias("content"), content.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    missing = distinct.join(read_cache(spark, cache, tokenizer), "content", "left_anti")
    encode_counts(missing, path).select(
        "content", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    rows = docs.select(F.col(doc).alias("doc_id"), digest.alias("content"), F.octet_length(content).cast("long").alias("n_bytes"))
    return rows.join(read_cache(spark, cache, tokenizer), "content", "left").select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
