"""Hold-outs, splits, samples, limits and up-weighting, all deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import bucket, document_key


def is_holdout(source: Column, id: Column, permille: float = 10.0, how: str = "xxh64") -> Column:
    return bucket(document_key(source, id), 1000, how) < F.lit(float(permille))


def split_of(source: Column, id: Column, val: float = 0.005, extra: float = 0.02, extra_source: str = "wikipedia", extra_split: str = "wiki_val", how: str = "xxh64") -> Column:
    """train, val, or for one source a larger validation split of its own."""
    share = bucket(document_key(source, id), 1_000_000, how) / F.lit(1e6)
    return F.when(share < val, "val").when((source == extra_source) & (share < val + extra), extra_split).otherwise("train")


def upweight(df: DataFrame, times: dict[str, int], split: str = "split", source: str = "source") -> DataFrame:
    """Rows of the train split repeated per source, with ``copy`` from 0."""
    k = F.lit(1)
    for name, n in times.items():
        k = F.when((F.col(source) == name) & (F.col(split) == "train"), F.lit(n)).otherwise(k)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), k - 1)))


def sample_share(df: DataFrame, target_bytes: float, text: str = "text") -> float:
    """min(1, target / bytes of all text)."""
    total = df.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    return min(1.0, target_bytes / total) if total else 1.0


def hash_sample(df: DataFrame, share: float, source: str = "source", id: str = "id", how: str = "xxh64", seed: str = "sample") -> DataFrame:
    """A Bernoulli sample by hash: the same rows whatever the partitions."""
    return df.where(bucket(F.concat(F.lit(seed + ":"), document_key(F.col(source), F.col(id))), 1_000_000, how) < int(share * 1_000_000))


def first_per_source(df: DataFrame, n: int | None, order: list[str], source: str = "source") -> DataFrame:
    """The first ``n`` rows of each source in order; None for all, 0 for none."""
    if n is None:
        return df
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sources_of(df: DataFrame, source: str = "source", most: int = 1_000_000) -> list[str]:
    """The names of the sources, sorted; more than ``most`` raise an error."""
    found = df.select(source).where(F.col(source).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} sources")
    return sorted(r[0] for r in found)
