"""Text columns against Python's own notions of words and lines."""

import random

from pyspark.sql import functions as F

from granthika.functions import hashing, redaction
from granthika.functions import text as T
from granthika.operators.quality import QualityRules, quality_filter, with_quality

ODD = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0      　"


def col(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", *columns).orderBy("i")
    return [tuple(r)[1:] for r in df.collect()]


def test_words_lines_and_strip_agree_with_python(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abअ१👍 " + ODD) for _ in range(r.randint(0, 25))) for _ in range(300)] + ["", " ", "a\r\nb\r", "\r\n"]
    got = col(spark, texts, T.word_count(F.col("text")), T.words(F.col("text")), T.lines(F.col("text")), T.strip(F.col("text")))
    own = col(spark, texts, T.stripped_lines(F.col("text")), T.without_frame_lines(F.col("text")))
    for t, (n, words, lines, stripped), (kept, rest) in zip(texts, got, own):
        assert (n, words, lines, stripped) == (len(t.split()), t.split(), t.splitlines(), t.strip()), repr(t)
        assert kept == [x.strip() for x in t.splitlines() if x.strip()] and rest == "\n".join(t.splitlines()), repr(t)


def test_script_ratio(spark):
    got = col(spark, ["", "   ", "नमस्ते", "hello", "कखगघचछजabc"], T.script_ratio(F.col("text")))
    assert [round(x[0], 9) for x in got] == [0.0, 0.0, 1.0, 0.0, 0.7]


def test_frame_lines(spark):
    texts = ["keep\nREAD MORE now", "read more\nsubscribe\nkeep", "a\r\nb\n", "", "x\n\n\nsign up"]
    got = col(spark, texts, T.frame_line_ratio(F.col("text")), T.without_frame_lines(F.col("text")))
    assert got[0] == (0.5, "keep") and got[2] == (0.0, "a\nb") and got[3] == (0.0, "") and got[4][0] == 0.25
    assert round(got[1][0], 3) == 0.667


def test_repeated_lines(spark):
    texts = ["a\nb\nc\nd\ne\nf\ng\nx\nx\nx", "a\na\nb\nc", "one", "", " a \na"]
    assert [round(x[0], 9) for x in col(spark, texts, T.repeated_line_ratio(F.col("text")))] == [0.3, 0.5, 0.0, 0.0, 1.0]


def test_quality_thresholds_keep_what_is_on_them(spark):
    w = ["शब्द"] * 20
    rows = [("19", " ".join(w[:19])), ("20", " ".join(w)), ("sym2", " ".join(w[:18] + ["#शब्द", "#शब्द"])), ("sym3", " ".join(w[:17] + ["#शब्द"] * 3)), ("null", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: r["reject_reason"] for r in with_quality(df).collect()}
    assert got == {"19": "words", "20": None, "sym2": None, "sym3": "symbols", "null": "script"}
    assert {r["id"] for r in quality_filter(df, QualityRules(min_words=19)).collect()} == {"19", "20", "sym2"}


def test_redaction(spark):
    texts = ["1234 5678 9012", "१२३४५६७८९०१२", "+91 98765 43210", "98765-43210", "1234567890123", "5876543210", "a.b+c@x.co.in", "919876543210"]
    text, counts = redaction.redact(F.col("text"))
    got = col(spark, texts, text, *counts.values())
    assert [g[0] for g in got] == ["[AADHAAR]", "[AADHAAR]", "[PHONE]", "[PHONE]", "1234567890123", "5876543210", "[EMAIL]", "[AADHAAR]"]
    assert got[2][1:] == (0, 1, 0)


def test_hashes_agree_with_the_library(spark):
    import xxhash

    keys = ["", "abc", "wikipedia:1", "नमस्ते", "x" * 100]
    got = col(spark, keys, hashing.bucket(F.col("text"), 1000), hashing.bucket(F.col("text"), 1_000_000), hashing.unsigned_mod(hashing.xxh64_by_arrow(F.col("text")), 1000))
    for k, (a, b, c) in zip(keys, got):
        h = xxhash.xxh64_intdigest(k)
        assert (a, b, c) == (h % 1000, h % 1_000_000, h % 1000)


def test_shingles_and_nfc(spark):
    got = col(spark, ["a b c d e f", "a b", "", "a a a a a a a"], T.shingles(F.col("text")))
    assert [sorted(g[0]) for g in got] == [["a b c d e", "b c d e f"], ["a b"], [""], ["a a a a a"]]
    assert col(spark, ["é", "abc", None], T.nfc(F.col("text"))) == [("é",), ("abc",), (None,)]
