"""Token budget per source and language (problem 4), and exact counts under a piece tokenizer.

Per language, a regression predicts a document's tokens from its bytes, words, digits, signs and
letters by script.  It is fitted on a bounded sample tokenised exactly, applied to all documents
by built-in expressions, and its bias is corrected with a second, held-out tokenised sample.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, rows_bound
from .language import Decoder, WordModel

#: Documents tokenised to fit, and as many held out to correct the bias, at most.
FIT_DOCS = 4_000
#: Tokenised documents that a language needs for a fit of its own, and the weight of a source's own bias.
LEAST_DOCS, OWN_BIAS = 60, 60
BYTE_SCORE = -20.0


class PieceTokenizer:
    """Cuts words into listed pieces with the highest sum of scores.

    A word is what stands between white space, with ``▁`` before it.  A character that is no
    piece is its UTF-8 bytes.  Of cuts with equal sums the one with fewer tokens counts."""

    CACHE = 500_000

    def __init__(self, pieces: list[tuple[str, str, float]]):
        self.score = {p: s for p, kind, s in pieces if kind == "piece"}
        self.byte = min((s for _, kind, s in pieces if kind == "byte"), default=BYTE_SCORE)
        self.longest = max(map(len, self.score), default=1)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        text, score = "▁" + word, self.score
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * n
        for i in range(n):
            s, k = best[i]
            c = text[i]
            if c not in score:
                b = len(c.encode("utf-8", "surrogatepass"))
                new = (s + b * self.byte, k - b)
                if new > best[i + 1]:
                    best[i + 1] = new
            for j in range(i + 1, min(n, i + self.longest) + 1):
                p = score.get(text[i:j])
                if p is not None and (s + p, k - 1) > best[j]:
                    best[j] = (s + p, k - 1)
        return -best[n][1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > self.CACHE:
            self.known.clear()
        known, total = self.known, 0
        for w in text.split():
            n = known.get(w)
            if n is None:
                n = known[w] = self.word(w)
            total += n
        return total


def read_pieces(df: DataFrame, most: int = 2_000_000) -> list[tuple[str, str, float]]:
    """The tokenizer's table ``(piece, kind, score)``; a table of more than ``most`` rows is no vocabulary and raises an error."""
    rows = rows_bound(df.where("piece is not null").select("piece", "kind", "score", "token_id"), most)
    if rows is None:
        raise ValueError(f"more than {most} pieces")
    return [tuple(r)[:3] for r in sorted(rows, key=lambda r: r["token_id"])]


def with_token_counts(df: DataFrame, pieces: list[tuple[str, str, float]], text: str = "text", out: str = "tokens") -> DataFrame:
    """``df`` with the exact number of tokens; 0 for null or blank text."""
    made = {}

    @F.pandas_udf("bigint")
    def count(s):
        t = made.get("t") or made.setdefault("t", PieceTokenizer(pieces))
        return s.map(t.count)

    return df.withColumn(out, count(F.col(text)))


#: What the regression sees: name and expression over the text.
FEATURES = {
    "bytes": lambda t: F.octet_length(t).cast("double"),
    "characters": lambda t: F.length(t).cast("double"),
    "words": lambda t: F.size(F.filter(F.split(t, "\\s+"), lambda w: w != "")).cast("double"),
    "digits": lambda t: F.regexp_count(t, F.lit("[0-9\\u0966-\\u096f\\u0ae6-\\u0aef]")).cast("double"),
    "signs": lambda t: F.regexp_count(t, F.lit("[\\u0021-\\u002f\\u003a-\\u0040\\u005b-\\u0060\\u007b-\\u007e\\u0964\\u2010-\\u2027]")).cast("double"),
    "latin": lambda t: F.regexp_count(t, F.lit("[A-Za-z]")).cast("double"),
    "latin_words": lambda t: F.regexp_count(t, F.lit("[A-Za-z]++")).cast("double"),
    "devanagari": lambda t: F.regexp_count(t, F.lit("[\\u0900-\\u0965\\u0970-\\u097f]")).cast("double"),
    "gujarati": lambda t: F.regexp_count(t, F.lit("[\\u0a80-\\u0ae5\\u0af0-\\u0aff]")).cast("double"),
    "other_letters": lambda t: F.regexp_count(t, F.lit("[^\\u0000-\\u007f\\u0900-\\u097f\\u0a80-\\u0aff]")).cast("double"),
}


def features(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({f"_f_{k}": f(t) for k, f in FEATURES.items()})


def _with_language(df: DataFrame, model: WordModel, keep: list[str], pieces: list[tuple[str, str, float]] | None) -> DataFrame:
    """The kept columns, the features, the language and, with pieces, the exact count of every row."""
    made = {}
    cols = [*keep, *[f"_f_{k}" for k in FEATURES]]
    chosen = features(df).select(*cols, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "text"]
    schema_names = [*cols, "lang", *(["exact"] if pieces else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = made.get("d") or made.setdefault("d", Decoder(model))
        texts = batch.column(len(cols)).to_pylist()
        arrays = [*batch.columns[: len(cols)], pa.array([x[0] for x in d.label([t or "" for t in texts])], pa.string())]
        if pieces:
            t = made.get("t") or made.setdefault("t", PieceTokenizer(pieces))
            arrays.append(pa.array([t.count(x) for x in texts], pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=schema_names)

    return by_batch(chosen, run, ", ".join([*fields, "lang string", *(["exact bigint"] if pieces else [])]))


def fit(rows: list[tuple[str, list[float], int]], ridge: float = 1e-3) -> dict[str, list[float]]:
    """Per language the coefficients (intercept first); under the empty name those of all together."""
    import numpy as np

    out = {}
    groups: dict[str, list[tuple[list[float], int]]] = {"": [(x, y) for _, x, y in rows]}
    for lang, x, y in rows:
        groups.setdefault(lang, []).append((x, y))
    for lang, of in groups.items():
        if not of or lang and len(of) < LEAST_DOCS:
            continue
        x = np.array([[1.0, *v] for v, _ in of])
        y = np.array([v for _, v in of], dtype=float)
        # Long documents vary more: weighing by the inverse root of length evens that out.
        w = 1 / np.sqrt(np.maximum(1.0, x[:, 2]))
        scale = np.maximum(np.abs(x).max(0), 1e-9)
        a = (x / scale) * w[:, None]
        beta = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ (y * w)) / scale
        out[lang] = beta.tolist()
    return out


def _predicted(coefficients: dict[str, list[float]]) -> F.Column:
    def linear(beta: list[float]) -> F.Column:
        total = F.lit(beta[0])
        for k, b in zip(FEATURES, beta[1:]):
            total = total + F.col(f"_f_{k}") * F.lit(b)
        return total

    chosen = linear(coefficients.get("", [0.0] * (len(FEATURES) + 1)))
    for lang, beta in coefficients.items():
        if lang:
            chosen = F.when(F.col("lang") == lang, linear(beta)).otherwise(chosen)
    # No word is less than one token.
    return F.when(F.col("_f_words") == 0, F.lit(0.0)).otherwise(F.greatest(F.col("_f_words"), chosen))


def estimate_tokens(df: DataFrame, pieces: list[tuple[str, str, float]], model: WordModel, key: str = "doc_id", keep: tuple[str, ...] = ("source", "subject_domain"), docs: int = FIT_DOCS) -> DataFrame:
    """``(doc_id, source, subject_domain, lang, est_tokens)`` of every document.

    ``lang`` is the language found in the text.  Null or blank text has 0 tokens.  Bias: the
    ratio of exact to predicted tokens on the holdout, per language, drawn towards a source's
    own ratio as its holdout grows."""
    n = max(1, df.count())
    share = min(1.0, 2 * docs / n)
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("tokens")), F.lit(1_000_000))
    sampled = df.where((bucket < int(1_000_000 * share)) & F.col("text").rlike("\\S")).select(key, "text", "source", (F.pmod(bucket, F.lit(2)) == 0).alias("_fit"))
    rows = _with_language(sampled, model, ["source", "_fit"], pieces).collect()
    names = [f"_f_{k}" for k in FEATURES]
    coefficients = fit([(r["lang"], [r[c] for c in names], r["exact"]) for r in rows if r["_fit"]])
    by_lang, by_source = _bias([r for r in rows if not r["_fit"]], coefficients, names)
    all_rows = _with_language(df, model, [key, *keep], None).withColumn("_raw", _predicted(coefficients))
    factor = F.lit(by_lang.get("", 1.0))
    for lang, f in by_lang.items():
        if lang:
            factor = F.when(F.col("lang") == lang, F.lit(f)).otherwise(factor)
    if by_source:  # at most a row a tokenised holdout document
        table = df.sparkSession.createDataFrame(list(by_source.items()), "_source string, _own double")
        all_rows = all_rows.join(F.broadcast(table), F.coalesce("source", F.lit("")) == F.col("_source"), "left")
        factor = factor * F.coalesce("_own", F.lit(1.0))
    return all_rows.select(key, *keep, "lang", F.round(F.col("_raw") * factor).cast("bigint").alias("est_tokens"))


def _bias(held: list, coefficients: dict[str, list[float]], names: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    def predict(r) -> float:
        beta = coefficients.get(r["lang"]) or coefficients.get("") or [0.0] * (len(names) + 1)
        return max(r["_f_words"], beta[0] + sum(b * r[c] for b, c in zip(beta[1:], names)))

    sums: dict[str, list[float]] = {}
    for r in held:
        for k in ("", r["lang"]):
            s = sums.setdefault(k, [0.0, 0.0, 0])
            s[0] += r["exact"]
            s[1] += predict(r)
            s[2] += 1
    by_lang = {k: a / p for k, (a, p, n) in sums.items() if p > 0 and (not k or n >= LEAST_DOCS)}
    own: dict[str, list[float]] = {}
    for r in held:
        s = own.setdefault(r["source"] or "", [0.0, 0.0, 0])
        s[0] += r["exact"]
        s[1] += predict(r) * by_lang.get(r["lang"], by_lang.get("", 1.0))
        s[2] += 1
    # At most one entry a tokenised holdout document: a bounded map.
    return by_lang, {k: 1 + (a / p - 1) * n / (n + OWN_BIAS) for k, (a, p, n) in own.items() if p > 0}


def token_totals(estimates: DataFrame) -> DataFrame:
    """Documents and tokens by source, language and domain, with all subtotals.

    ``level`` names the columns a row is grouped by, joined by ``+`` (``all`` for the total)."""
    cols = ["source", "lang", "subject_domain"]
    cube = estimates.cube(*cols)
    got = cube.agg(F.count("*").alias("docs"), F.sum("est_tokens").alias("est_tokens"), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    level = F.concat_ws("+", *[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in cols])
    return got.select(F.when(level == "", "all").otherwise(level).alias("level"), *cols, "docs", "est_tokens")
