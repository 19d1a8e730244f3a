"""Training tables: encoded, padded, paired and expanded rows; losses of score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moothall.functions import vectors as vec
from moothall.functions.text import IGNORED_ID, map_label
from moothall.operators.features import lookup_vocab
from moothall.operators.skew import number_rows

# ---- fixed values ----
MAX_LENGTH = 512
PROMPT_MARK = "[UNUSED]"
ALPHA = 0.3
# ---- end of fixed values ----


def encode(docs: DataFrame, words: DataFrame, vocab: DataFrame, doc: str, max_len: int = MAX_LENGTH,
           stored: bool = False) -> DataFrame:
    """G1: input ids in word order with their mask, cut to the model's length; `stored` words are a table."""
    fitting = words.filter(F.col("pos") < max_len)  # at most max_len words of a text meet in a row
    found = lookup_vocab(fitting, vocab, [doc, "pos"], stored)
    listed = F.array_sort(F.collect_list(F.struct("pos", "idx")))
    ids = found.groupBy(doc).agg(F.transform(listed, lambda e: e["idx"]).alias("input_ids"))
    empty = F.array().cast("array<bigint>")
    return (docs.select(doc).join(ids, doc, "left")
            .select(doc, F.coalesce("input_ids", empty).alias("input_ids"))
            .withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))))


def _padded(values: Column, length: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(length - F.size(values), F.lit(0))))


def pad_fixed(encoded: DataFrame, length: int, pad: int = 0) -> DataFrame:
    """Ids and mask filled up to a fixed length."""
    return encoded.withColumn("input_ids", _padded(F.col("input_ids"), F.lit(length), pad)).withColumn(
        "attention_mask", _padded(F.col("attention_mask").cast("array<bigint>"), F.lit(length), 0))


def pad_batch(encoded: DataFrame, order: str, batch_size: int, pad: int = 0) -> DataFrame:
    """Consecutive rows form batches, each filled up to its longest row."""
    batched = number_rows(encoded, [order], "_row").withColumn("batch", F.floor(F.col("_row") / batch_size))
    longest = F.max(F.size("input_ids")).over(W.partitionBy("batch"))  # batch_size rows at most
    return (batched.withColumn("_longest", longest)
            .withColumn("attention_mask", _padded(F.col("attention_mask").cast("array<bigint>"), F.col("_longest"), 0))
            .withColumn("input_ids", _padded(F.col("input_ids"), F.col("_longest"), pad))
            .drop("_row", "_longest"))


def dual_targets(docs: DataFrame, input_words: DataFrame, target_words: DataFrame, vocab: DataFrame, doc: str,
                 label: str, max_len: int = MAX_LENGTH) -> DataFrame:
    """Input ids, ids of the comment to generate, and the class to predict."""
    inputs = encode(docs, input_words, vocab, doc, max_len)
    targets = encode(docs, target_words, vocab, doc, max_len).select(doc, F.col("input_ids").alias("labels"))
    classes = docs.select(doc, F.col(label).alias("classification_target"))
    return inputs.join(targets, doc).join(classes, doc)


def expand_choices(df: DataFrame, item: str, label: str = "label") -> DataFrame:
    """Three candidate rows per question, the label counted from 0."""
    answers = F.array(*[F.struct(F.lit(i).alias("choice"), F.col(c).alias("answer"))
                        for i, c in enumerate(("answerA", "answerB", "answerC"))])
    prompt = F.concat("context", F.lit(PROMPT_MARK), "question")
    return df.select(item, prompt.alias("prompt"), map_label(F.col(label), "offset").alias("label"),
                     F.explode(answers).alias("a")).select(item, "prompt", "label", "a.choice", "a.answer")


def best_choice(scored: DataFrame, item: str, choice: str = "choice", score: str = "score") -> DataFrame:
    """G6 in long form: the choice of highest score, the lowest one on ties."""
    return scored.groupBy(item).agg(
        F.max_by(choice, F.struct(F.col(score), (-F.col(choice)).alias("low"))).alias("prediction"))


def joint_loss(tokens: DataFrame, classes: DataFrame, alpha: float = ALPHA, logits: str = "logits",
               label: str = "label") -> DataFrame:
    """Mean cross entropy of generated tokens and of classes, weighted by alpha; ignored ids are left out."""
    counted = tokens.filter(F.col(label) != IGNORED_ID)
    means = [t.agg(F.avg(vec.cross_entropy(F.col(logits), F.col(label)))) for t in (counted, classes)]
    both = means[0].toDF("text_loss").withColumn("class_loss", means[1].scalar())
    return both.withColumn("loss", alpha * F.col("text_loss") + (1 - alpha) * F.col("class_loss"))
