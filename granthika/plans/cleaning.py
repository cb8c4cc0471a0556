"""The cleaning pipeline as one lazy plan: language, filters, exact and near de-duplication, redaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction
from ..functions import text as T
from ..operators import dedup, language, quality


@dataclass(frozen=True)
class CleanConfig:
    rules: quality.QualityRules = field(default_factory=quality.QualityRules)
    languages: tuple[str, ...] | None = None
    target: str = "mr"
    least_prob: float = language.LEAST_PROB
    order: tuple[str, ...] = ("source", "doc_id")
    similarity: float = 0.8
    shingle: int = 5
    permutations: int = 128
    fuzzy: str | None = "exact"
    cap: int | None = None
    normalize_output: bool = False
    unicode_phone: bool = False


def clean(df: DataFrame, config: CleanConfig = CleanConfig(), language_model: DataFrame | None = None) -> DataFrame:
    """The clean documents: same columns, ``text`` cleaned and redacted, ``redactions`` by kind added.

    With a model of ``language.train`` the first stage keeps documents identified as ``target``;
    ``languages`` compares labels only."""
    if language_model is not None:
        df = language.passes(df, language.identify(df, language_model), config.target, config.least_prob)
    if config.languages is not None:
        df = df.where(F.col("lang").isin(list(config.languages)))
    # What follows reads the survivors several times; the filters run once.
    survivors = dedup.cut(quality.quality_filter(df, config.rules))
    kept = dedup.exact_dedup(survivors, list(config.order))
    if config.fuzzy:
        kept = dedup.fuzzy_dedup(kept, list(config.order), threshold=config.similarity, n=config.shingle, how=config.fuzzy, permutations=config.permutations, cap=config.cap)
    text, counts = redaction.redact(F.col("text"), config.unicode_phone)
    out = kept.withColumns({"redactions": F.struct(*[c.alias(k) for k, c in counts.items()]), "text": text})
    return out.withColumn("text", T.nfc(F.col("text"))) if config.normalize_output else out


def statistics(df: DataFrame, final: DataFrame, config: CleanConfig = CleanConfig(), passes_language: Column | None = None) -> DataFrame:
    """The funnel of ``df`` per source with the documents that remain and what was redacted in them, and a row of totals (``total``)."""
    language = passes_language if passes_language is not None else F.lit(True) if config.languages is None else F.col("lang").isin(list(config.languages))
    left = final.groupBy("source").agg(F.count("*").alias("final"), *[F.sum(f"redactions.{k}").alias(k) for k in redaction.PLACEHOLDERS])
    rows = quality.funnel(df, language, config.rules).join(left.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    counts = [c for c in rows.columns if c != "source"]
    filled = rows.fillna(0, counts).withColumn("total", F.lit(False))
    # A row a source: few.
    total = filled.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).select(F.lit(None).cast("string").alias("source"), *counts, F.lit(True).alias("total"))
    return filled.select("source", *counts, "total").unionByName(total)


def statistics_json(stats: DataFrame) -> DataFrame:
    """One row, ``json``: the totals and, per source in order of the names, the counts of ``statistics``."""
    counts = [c for c in stats.columns if c not in ("source", "total")]
    row = F.struct(*[F.col(c) for c in counts])
    per_source = F.array_sort(F.collect_list(F.when(~F.col("total"), F.struct(F.coalesce("source", F.lit("")).alias("source"), row.alias("counts")))))
    total = F.first(F.when(F.col("total"), row), ignorenulls=True)
    return stats.agg(per_source.alias("s"), total.alias("totals")).select(F.to_json(F.struct(F.map_from_entries("s").alias("per_source"), "totals")).alias("json"))
