"""Sampling filters over logits in long form ``(ctx, token, logit)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def temperature(logit: Column, t: float) -> Column:
    return logit / F.lit(max(t, 1e-6))


def top_k(df: DataFrame, k: int, ctx: str = "ctx", logit: str = "logit") -> DataFrame:
    """Tokens with at least the k-th largest logit; all that tie with it stay."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(ctx).orderBy(F.desc(logit)))).where(F.col("_r") <= k).drop("_r")


def softmax(df: DataFrame, ctx: str = "ctx", logit: str = "logit") -> DataFrame:
    w = Window.partitionBy(ctx)
    e = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(df: DataFrame, p: float, ctx: str = "ctx", token: str = "token", logit: str = "logit") -> DataFrame:
    """Tokens whose more likely ones sum to at most ``p``; the likeliest always stays.  Equal logits go by token."""
    w = Window.partitionBy(ctx).orderBy(F.desc(logit), token).rowsBetween(Window.unboundedPreceding, -1)
    s = softmax(df, ctx, logit).withColumn("_before", F.coalesce(F.sum("p").over(w), F.lit(0.0)))
    return s.where(F.col("_before") <= p).drop("_before")


def draw(df: DataFrame, seed: int, ctx: str = "ctx", token: str = "token", logit: str = "logit") -> DataFrame:
    """One token a context by its chance: the first whose running sum passes a uniform number, 48 bits of the MD5 of seed and context."""
    w = Window.partitionBy(ctx).orderBy(F.desc(logit), token)
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ctx).cast("string"))), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    run = softmax(df, ctx, logit).withColumns({"_sum": F.sum("p").over(w), "_u": u, "_n": F.row_number().over(w)})
    return run.groupBy(ctx).agg(F.coalesce(F.min_by(token, F.when(F.col("_sum") > F.col("_u"), F.col("_n"))), F.max_by(token, "_n")).alias(token))


def last_tokens(ids: Column, n: int) -> Column:
    """The last ``n`` of a context."""
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - n + 1), F.lit(n))


def until_end(text: Column, end: str = "<|endoftext|>") -> Column:
    """What stands before the first end mark, stripped."""
    from ..functions.text import strip

    return strip(F.substring_index(text, end, 1))
