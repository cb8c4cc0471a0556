"""Per-document filters and the survivor funnel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; a document on a threshold is kept."""

    min_script_ratio: float = 0.70
    script: tuple[int, int] = T.DEVANAGARI
    min_words: int = 20
    max_words: int = 100_000
    max_symbol_ratio: float = 0.10
    max_repeated_lines: float = 0.30
    max_frame_lines: float = 0.50
    frame_phrases: tuple[str, ...] = tuple(T.FRAME_PHRASES)


def with_quality(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """``df`` with the cleaned text, the measures and the first reason to reject, null if none.

    The script ratio sees the raw text; the other rules see it without frame lines, stripped."""
    raw = T.not_null(F.col(text))
    # Generated columns: a filter on what follows can't be pushed below them, which would measure again.
    outer = F.struct(T.script_ratio(raw, *rules.script).alias("script_ratio"), T.framed(raw, list(rules.frame_phrases)).alias("framed"))
    step = df.withColumn("_outer", F.explode(F.array(outer)))
    clean = T.strip(F.col("_outer.framed.rest"))
    step = step.withColumns({"script_ratio": F.col("_outer.script_ratio"), "frame_ratio": F.col("_outer.framed.ratio"), "clean_text": clean}).drop("_outer")
    clean = F.col("clean_text")
    inner = F.struct(T.word_count(clean).alias("words"), T.symbol_count(clean).alias("symbols"), T.repeated_line_ratio(clean).alias("repeated"))
    step = step.withColumn("_inner", F.explode(F.array(inner)))
    step = step.withColumns({"n_words": F.col("_inner.words"), "symbol_ratio": F.col("_inner.symbols") / F.greatest(F.lit(1), F.col("_inner.words")), "repeated_ratio": F.col("_inner.repeated")}).drop("_inner")
    reason = (
        F.when(F.col("script_ratio") < rules.min_script_ratio, "script")
        .when(F.col("frame_ratio") > rules.max_frame_lines, "frame")
        .when((F.col("n_words") < rules.min_words) | (F.col("n_words") > rules.max_words), "words")
        .when(F.col("symbol_ratio") > rules.max_symbol_ratio, "symbols")
        .when(F.col("repeated_ratio") > rules.max_repeated_lines, "repeats")
    )
    return step.withColumn("reject_reason", reason)


def quality_filter(df: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The documents no rule rejects, with their cleaned text in place of the text."""
    extra = ["script_ratio", "frame_ratio", "n_words", "symbol_ratio", "repeated_ratio", "reject_reason"]
    return with_quality(df, rules, text).where("reject_reason is null").withColumn(text, F.col("clean_text")).drop("clean_text", *extra)


def funnel(df: DataFrame, passes_language: Column, rules: QualityRules = QualityRules(), text: str = "text", by: str = "source") -> DataFrame:
    """Documents and words at each stage per source, in one pass; ``with_quality`` has been applied if its columns are there."""
    q = df if "reject_reason" in df.columns else with_quality(df, rules, text)
    reason = F.col("reject_reason")
    lang = F.coalesce(passes_language, F.lit(False))
    script = lang & (F.coalesce(reason, F.lit("")) != "script")
    kept = lang & reason.isNull()
    return q.groupBy(by).agg(
        F.count("*").alias("docs_input"),
        F.count_if(lang).alias("docs_after_language"),
        F.count_if(script).alias("docs_after_script"),
        F.count_if(kept).alias("docs_after_quality"),
        F.sum(T.word_count(T.not_null(F.col(text)))).alias("words_input"),
        F.coalesce(F.sum(F.when(kept, F.col("n_words"))), F.lit(0)).alias("words_after_quality"),
    )


def corpus_size(df: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Documents, UTF-8 bytes and words per source, and in total (null source)."""
    t = T.not_null(F.col(text))
    return df.rollup(by).agg(F.count("*").alias("docs"), F.sum(F.octet_length(t)).alias("bytes"), F.sum(T.word_count(t)).alias("words"))


def ingest_summary(log: DataFrame, by: tuple[str, ...] = ("source", "stage"), key: str = "doc_id") -> DataFrame:
    """Records, different documents, bytes and words of an ingest log per source and stage; null sizes count nothing."""
    return log.groupBy(*by).agg(F.count("*").alias("records"), F.count_distinct(key).alias("docs"), F.sum("n_bytes").alias("bytes"), F.sum("proxy_tokens").alias("proxy_tokens"))
