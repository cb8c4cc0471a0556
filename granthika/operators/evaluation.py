"""Aggregates over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = (1, -1, 0)


def fertility(df: DataFrame, tokenizer: str = "tokenizer", tokens: str = "n_tokens", words: str = "n_words") -> DataFrame:
    """Tokens a word: the ratio of the sums, per tokenizer."""
    ratio = F.sum(tokens) / F.greatest(F.lit(1), F.sum(words))
    return df.groupBy(tokenizer).agg(F.sum(tokens).alias("tokens"), F.sum(words).alias("words"), F.round(ratio, 3).alias("fertility"))


def perplexity(df: DataFrame, split: str = "split", loss: str = "loss", n: str = "n", splits: list[str] | None = None) -> DataFrame:
    """Token-weighted mean loss and its exponential, per split."""
    df = df if splits is None else df.where(F.col(split).isin(splits))
    mean = F.sum(F.col(loss) * F.col(n)) / F.sum(n)
    return df.groupBy(split).agg(mean.alias("loss"), F.exp(mean).alias("perplexity"), F.sum(n).alias("tokens"))


def mean_loss(df: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    """Unweighted mean of batch losses."""
    return df.groupBy(*by).agg(F.avg(loss).alias("mean_loss"))


def exemplars(df: DataFrame, per_label: int, label: str = "label", key: str = "tweet_id", seed: str = "shots") -> DataFrame:
    """``per_label`` rows of each label, or all if fewer, drawn by hash."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    # A group's first rows are found by a bounded per-partition heap, not by collecting the group.
    w = Window.partitionBy(label).orderBy(h, key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_label).drop("_rn")


def few_shot_prompt(shots: DataFrame, line: Column, key: str = "tweet_id", seed: str = "order") -> DataFrame:
    """One row: the exemplars as text in a seeded order, parted by blank lines."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    return shots.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(h.alias("h"), line.alias("t")))), lambda x: x.t), "\n\n").alias("prompt"))


def label_argmax(scores: DataFrame, context: str = "ctx", label: str = "label", logp: str = "logp", labels: tuple[int, ...] = LABELS) -> DataFrame:
    """Per context the label with the greatest sum of log chances; ties go to the first in ``labels``."""
    rank = F.lit(len(labels))
    for i, x in enumerate(labels):
        rank = F.when(F.col(label) == x, F.lit(i)).otherwise(rank)
    sums = scores.groupBy(context, label).agg(F.sum(logp).alias("score"))
    return sums.groupBy(context).agg(F.max_by(label, F.struct("score", -rank)).alias("predicted"), F.max("score").alias("score"))


def accuracy(df: DataFrame, predicted: str = "predicted", gold: str = "label") -> DataFrame:
    """Correct, all, their ratio, and the chance level of the labels seen; both are null without rows."""
    right = F.count_if(F.col(predicted) == F.col(gold))
    return df.where(F.col(gold).isNotNull()).agg(right.alias("correct"), F.count("*").alias("n"), (right / F.nullif(F.count("*"), F.lit(0))).alias("accuracy"), (F.lit(1.0) / F.nullif(F.count_distinct(gold), F.lit(0))).alias("baseline"))


def seeded_head(df: DataFrame, n: int, key: str, seed: str = "test") -> DataFrame:
    """``n`` rows of a seeded shuffle."""
    return df.orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key).limit(n)
