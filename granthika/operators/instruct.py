"""Instruction data: flattening, splits, chat template, loss masks and padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.hashing import bucket

USER, ASSISTANT, END = "<|user|>", "<|assistant|>", "<|endoftext|>"
IGNORED = -1


def flatten_turns(df: DataFrame, turns: str = "mar_deva", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per turn of exactly two strings, both stripped and not empty; null or empty lists give none."""
    t = df.select(*keep, F.posexplode(turns).alias("turn", "_t")).where(F.size("_t") == 2)
    pair = t.select(*keep, "turn", T.strip(T.not_null(F.get("_t", 0))).alias("instruction"), T.strip(T.not_null(F.get("_t", 1))).alias("response"))
    return pair.where("instruction <> '' and response <> ''")


def limit_after_row(df: DataFrame, n: int | None, order: str, turns: str = "mar_deva") -> DataFrame:
    """Rows in order until the turns before a row are ``n`` or more; a row is never cut."""
    if n is None:
        return df
    size = F.size(F.filter(F.coalesce(turns, F.array().cast("array<array<string>>")), lambda t: F.size(t) == 2))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # The limit bounds what is kept: at most n rows with turns precede it, so a first cut bounds the window.
    with_turns = df.withColumn("_n", size).where("_n > 0").orderBy(order).limit(max(1, n))
    kept = with_turns.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).where((F.col("_before") < n) | (F.col("_before") == 0))
    return kept.drop("_n", "_before")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All pairs with the name of their source."""
    out = None
    for name, df in frames.items():
        one = df.select("instruction", "response").withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def instruction_split(source: Column, instruction: Column, permille: int = 5, always_train: tuple[str, ...] = ("manual",), how: str = "xxh64") -> Column:
    held = bucket(F.concat(source, F.lit(":"), instruction), 1000, how) < permille
    return F.when(held & ~source.isin(list(always_train)), "val").otherwise("train")


def example_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "split").agg(F.count("*").alias("examples"))


def prompt_of(instruction: Column) -> Column:
    return F.concat(F.lit(USER + "\n"), instruction, F.lit("\n" + ASSISTANT + "\n"))


def chat_text(instruction: Column, response: Column) -> Column:
    return F.concat(prompt_of(instruction), response, F.lit(END))


def masked_examples(df: DataFrame, block_size: int, prompt_ids: str = "prompt_ids", response_ids: str = "response_ids", end: int = 1) -> DataFrame:
    """``ids`` and ``mask`` (0 on the prompt, 1 on the response and its end); longer than a block is dropped."""
    ids = F.concat(F.col(prompt_ids), F.col(response_ids), F.array(F.lit(end)))
    mask = F.concat(F.array_repeat(F.lit(0), F.size(prompt_ids)), F.array_repeat(F.lit(1), F.size(response_ids) + 1))
    return df.withColumns({"ids": ids, "mask": mask}).where(F.size("ids") <= block_size)


def skipped(df: DataFrame, block_size: int, prompt_ids: str = "prompt_ids", response_ids: str = "response_ids") -> DataFrame:
    return df.agg(F.count_if(F.size(prompt_ids) + F.size(response_ids) + 1 > block_size).alias("skipped"), F.count("*").alias("examples"))


def epoch_batches(df: DataFrame, batch: int, epoch: int = 0, seed: int = 1, key: str = "example") -> DataFrame:
    """``df`` with ``batch_id``: a seeded shuffle of the epoch cut into batches, the last one partial."""
    from .dedup import dense_rank_of

    h = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")))
    shuffled = dense_rank_of(df.withColumn("_h", h), ["_h", key])
    return shuffled.withColumn("batch_id", (F.col("rank") / batch).cast("bigint")).drop("_h", "rank")


def padded(df: DataFrame, batch: str = "batch_id", pad: int = 1) -> DataFrame:
    """``x`` and ``y`` of equal length in a batch: x padded with ``pad``; y is the next id where it counts, else -1."""
    longest = df.groupBy(batch).agg(F.max(F.size("ids")).alias("_longest"))
    j = df.join(longest, batch)
    gap = F.col("_longest") - F.size("ids")
    x = F.concat(F.slice("ids", F.lit(1), F.size("ids") - 1), F.array_repeat(F.lit(pad), gap))
    y = F.concat(
        F.zip_with(F.slice("ids", F.lit(2), F.size("ids") - 1), F.slice("mask", F.lit(2), F.size("mask") - 1), lambda i, m: F.when(m == 1, i).otherwise(IGNORED)),
        F.array_repeat(F.lit(IGNORED), gap),
    )
    return j.withColumns({"x": x, "y": y}).drop("_longest")
