"""Queries of problems 1 to 9 over the whole tables, and SQL where it can express them."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, leakage, lookalike, mixture, pairs, pii, prose, shared_lines, tokens
from .common import docs, rows_bound


def _word_model(spark: SparkSession, sf_dir: str) -> language.WordModel:
    return language.fit_word_model(docs(spark, sf_dir, "lang_samples"), docs(spark, sf_dir, "common_words"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir)
    return shared_lines.shared_lines(df, pii.fit_gazetteer(df))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's shared lines."""
    df = docs(spark, sf_dir)
    names = pii.fit_gazetteer(df)
    return shared_lines.without_shared_lines(df.select("doc_id", "source", "text"), shared_lines.shared_forms(df, names)[1], names).drop("text")


def _common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The common words of all languages; more than 100,000 are no list of common words, and raise an error."""
    rows = rows_bound(docs(spark, sf_dir, "common_words").where("word is not null").select("word").distinct(), 100_000)
    if rows is None:
        raise ValueError("more than 100,000 common words")
    return sorted(r[0] for r in rows)


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every document."""
    words = _common_words(spark, sf_dir)
    samples = docs(spark, sf_dir, "lang_samples").select("text").unionByName(docs(spark, sf_dir, "eval_items").select("text"))
    rules, names = prose.learn_rules(spark, samples, words)
    df = docs(spark, sf_dir).select("doc_id", "text")
    return prose.label_kinds(df, rules, names, words).drop("text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir, "instruct_pairs")
    return pairs.pair_defects(df, _word_model(spark, sf_dir), pairs.last_words(df))


def p4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, estimated."""
    pieces = tokens.read_pieces(docs(spark, sf_dir, "tok_pieces"))
    return tokens.estimate_tokens(docs(spark, sf_dir), pieces, _word_model(spark, sf_dir))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by source, language and domain, with subtotals."""
    return tokens.token_totals(p4_tokens(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_cases(docs(spark, sf_dir), _word_model(spark, sf_dir))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document, and of its lines in another language."""
    return language.label_languages(docs(spark, sf_dir), _word_model(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = docs(spark, sf_dir)
    return pii.pii_lines(df, pii.fit_gazetteer(df))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders, and the number of values by kind.

    The key of the surrogates is the setting ``spark.granthika.redaction.key``; without it a key of
    this call only is drawn, so that marks can't be traced, nor compared with another call's."""
    df = docs(spark, sf_dir)
    secret = spark.conf.get("spark.granthika.redaction.key", None) or secrets.token_hex(32)
    out = pii.redact_documents(df.select("doc_id", "text"), pii.fit_gazetteer(df), secret).drop("text")
    return out.withColumn("pii_counts", F.to_json("pii_counts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(docs(spark, sf_dir), docs(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks, and what tells an item in other words with its answers."""
    return leakage.leak_report(docs(spark, sf_dir), docs(spark, sf_dir, "eval_items"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, a row per part of a document in a slot."""
    pieces = tokens.read_pieces(docs(spark, sf_dir, "tok_pieces"))
    counted = tokens.with_token_counts(docs(spark, sf_dir).select("doc_id", "source", "text"), pieces)
    return mixture.mix(counted, docs(spark, sf_dir, "source_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wished and reached shares of every source."""
    return mixture.shares(p8_mixture(spark, sf_dir), docs(spark, sf_dir, "source_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_alike_pairs(docs(spark, sf_dir))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal looking texts, and its links to different strings in it."""
    return lookalike.look_alike_classes(docs(spark, sf_dir))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    df = docs(spark, sf_dir)
    out = lookalike.with_canonical(df.select("doc_id", "text"), lookalike.learn_rewriting(df))
    return out.select("doc_id", "canonical", (~F.col("text").eqNullSafe(F.col("canonical"))).alias("changed"))


def queries() -> dict:
    found = globals()
    return {name: found[name] for name in sorted(found) if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
