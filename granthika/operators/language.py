"""Language filter: multinomial naive Bayes on character trigrams, trained and applied by Spark SQL.

Its probabilities are not comparable with those of another identifier, so thresholds must be
chosen for it.  A fastText model file is used instead where that library is installed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Entries of a model that may go to the workers (grams times languages, some 100 bytes each).
MOST_ENTRIES = 2_000_000
#: Least chance of the likeliest language in the pipeline: chosen for this model, whose chances for sound Marathi lie near 0.6.
LEAST_PROB = 0.4


def _plain(text: Column) -> Column:
    """Lower-case text, white space as single spaces, one space at either end."""
    return F.concat(F.lit(" "), F.regexp_replace(T.strip(F.lower(T.not_null(text))), T.JVM_SPACE + "+", " "), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Trigrams of the plain text; of fewer than three characters the text itself."""
    # Substrings at a place count from the start of UTF-8 text: over characters that is linear.
    chars = F.filter(F.split(_plain(text), ""), lambda c: c != "")
    return T.let(chars, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - 2)), lambda i: F.array_join(F.slice(c, i, F.lit(3)), "")))


def train(samples: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(gram, lang, logp)``: log chances of the trigrams of labelled rows with add-one smoothing."""
    grams = samples.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(trigrams(F.col(text))).alias("gram"))
    counts = grams.groupBy("gram", "lang").agg(F.count("*").alias("n"))
    kept = counts.select("gram").distinct()
    # A language a row: few.
    full = kept.join(counts.agg(F.sort_array(F.collect_set("lang")).alias("langs"))).select("gram", F.explode("langs").alias("lang")).join(counts, ["gram", "lang"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    totals = full.groupBy("lang").agg(F.sum("n").alias("total"))
    return full.join(totals, "lang").select("gram", "lang", F.log(F.col("n") / F.col("total")).alias("logp"))


def identify(df: DataFrame, model: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_ENTRIES) -> DataFrame:
    """``(key, lang, prob)`` of every document that holds a known trigram: the likeliest language (ties: the first by name) and its share of the chances, evened by length.

    A model of up to ``most`` entries goes to the workers, and texts are scored where they are;
    a bigger one is joined by trigram."""
    entries = model.select("gram", "lang", "logp").limit(most + 1).collect()
    if len(entries) > most:
        return _identify_by_join(df, model, key, text)
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in entries])
    made: dict = {}

    @F.pandas_udf("struct<lang string, prob double>")
    def score(texts):
        import math

        import numpy as np
        import pandas as pd

        if not made:
            langs = sorted({x for _, x, _ in shared.value})
            place = {x: i for i, x in enumerate(langs)}
            grams: dict[str, int] = {}
            for g, _, _ in shared.value:
                grams.setdefault(g, len(grams))
            table = np.zeros((len(grams), len(langs)))
            for g, x, p in shared.value:
                table[grams[g], place[x]] = p
            made.update(langs=langs, get=grams.get, table=table)
        langs, get, table = made["langs"], made["get"], made["table"]
        out: list[tuple[str | None, float | None]] = []
        for plain in texts:
            own = map("".join, zip(plain, plain[1:], plain[2:])) if len(plain) > 2 else [plain]
            at = [i for i in map(get, own) if i is not None]
            if not at:
                out.append((None, None))
                continue
            ids, n = np.unique(np.array(at), return_counts=True)
            cost = -(n[:, None] * table[ids]).sum(0) / len(at)
            top = int(cost.argmin())
            out.append((langs[top], 1 / math.fsum(np.exp(cost[top] - cost))))
        return pd.DataFrame(out, columns=["lang", "prob"])

    scored = df.select(key, score(_plain(F.col(text))).alias("_s")).where("_s.lang is not null")
    return scored.select(key, F.col("_s.lang").alias("lang"), F.col("_s.prob").alias("prob"))


def _identify_by_join(df: DataFrame, model: DataFrame, key: str, text: str) -> DataFrame:
    grams = df.select(key, F.explode(trigrams(F.col(text))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))
    scores = grams.join(model, "gram").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("logp")).alias("score"), F.sum("n").alias("size"))
    best = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score") / F.col("size")).alias("cost"), "lang"))).alias("all"))
    top = F.element_at("all", 1)
    chances = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(top.cost - x.cost))
    return best.select(key, top.lang.alias("lang"), (1.0 / chances).alias("prob"))


def passes(df: DataFrame, scored: DataFrame, target: str, threshold: float = 0.65, key: str = "doc_id") -> DataFrame:
    """The documents whose likeliest language is ``target`` with at least ``threshold``; others and blank ones are dropped."""
    return df.join(scored.where((F.col("lang") == target) & (F.col("prob") >= threshold)).select(key), key, "left_semi")


def fasttext_scores(path: str):
    """A column function giving ``struct<lang, prob>`` from a fastText model file, loaded once a worker."""
    import importlib.util

    if importlib.util.find_spec("fasttext") is None:
        raise ModuleNotFoundError("fasttext is not installed; use train() and identify()")
    loaded = {}

    @F.pandas_udf("struct<lang string, prob double>")
    def score(s):
        import fasttext
        import pandas as pd

        model = loaded.get("m") or loaded.setdefault("m", fasttext.load_model(path))
        got = [model.predict((x or "").replace("\n", " ").strip(), k=1) for x in s]
        return pd.DataFrame({"lang": [g[0][0].removeprefix("__label__") if g[0] else None for g in got], "prob": [float(g[1][0]) if len(g[1]) else 0.0 for g in got]})

    return score
