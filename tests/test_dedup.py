"""De-duplication against sequential passes in plain Python."""

import random

import pytest

from granthika.functions import text as T  # noqa: F401
from granthika.operators import dedup


def shingle_set(t, n=5):
    w = t.split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def greedy(rows, threshold):
    kept = []
    for key, t in sorted(rows):
        s = shingle_set(t)
        if all(len(s & k) / len(s | k) < threshold for _, k in kept):
            kept.append((key, s))
    return {k for k, _ in kept}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    base = [[r.choice("abcdefghij") * r.randint(1, 3) for _ in range(40)] for _ in range(8)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 50)}"
        out.append((i, " ".join(w)))
    return out


def test_exact_keeps_the_first_in_order(spark):
    rows = [("b", 1, "x"), ("a", 2, "x"), ("a", 1, "y"), ("a", 3, "y"), ("b", 2, "x "), ("c", 1, "é"), ("c", 2, "é"), ("d", 1, None), ("d", 2, "")]
    df = spark.createDataFrame(rows, "source string, doc_id int, text string")
    got = {(r.source, r.doc_id) for r in dedup.exact_dedup(df, ["source", "doc_id"]).collect()}
    assert got == {("a", 2), ("a", 1), ("b", 2), ("c", 1), ("d", 1)}
    nulls = spark.createDataFrame([(None, 1, "x"), ("a", 2, "x"), ("a", 3, "y"), (None, 4, None)], "source string, doc_id int, text string")
    assert {r.doc_id for r in dedup.exact_dedup(nulls, ["source", "doc_id"]).collect()} == {1, 3, 4}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_fuzzy_equals_a_sequential_pass(spark, threshold):
    rows = list({t: (i, t) for i, t in reversed(corpus())}.values())
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id for r in dedup.fuzzy_dedup(df, ["doc_id"], threshold=threshold).collect()}
    assert got == greedy(rows, threshold)


def test_similar_pairs_are_exact(spark):
    rows = list({t: (i, t) for i, t in reversed(corpus(2))}.values())
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.a, r.b) for r in dedup.similar_pairs(df, threshold=0.6).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


def test_a_chain_keeps_its_ends_and_the_cap_lets_the_rest_pass(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "rank bigint")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    assert {r.rank for r in dedup.keep_first(nodes, pairs).collect()} == {0, 2, 3}
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d e")], "doc_id int, text string")
    assert {r.doc_id for r in dedup.fuzzy_dedup(df, ["doc_id"], cap=1).collect()} == {1, 2, 3}
    assert {r.doc_id for r in dedup.fuzzy_dedup(df, ["doc_id"]).collect()} == {1}


@pytest.mark.parametrize("rounds, rest", [(100, 0), (0, 1_000), (2, 1_000)])
def test_long_chains_and_random_graphs_are_decided_in_order(spark, rounds, rest):
    r = random.Random(7)
    n = 40
    pairs = {(i, i + 1) for i in range(n - 1)} if rounds == 2 else {tuple(sorted(r.sample(range(n), 2))) for _ in range(50)}
    kept = []
    for i in range(n):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(n)], "rank bigint")
    got = dedup.keep_first(nodes, spark.createDataFrame(sorted(pairs), "a bigint, b bigint"), rounds=rounds, rest=rest)
    assert {x.rank for x in got.collect()} == set(kept)


def test_texts_of_equal_shingles(spark):
    """Texts that differ in white space only are compared once; the result is as if each were compared."""
    base = [" ".join(f"w{i}" for i in range(a, a + 30)) for a in (0, 1, 100)]
    rows = [(i, base[i % 3].replace(" ", " " * (1 + i // 3))) for i in range(12)] + [(20, "a b"), (21, "a  b"), (22, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(x.a, x.b) for x in dedup.similar_pairs(df).collect()} == want
    assert {x.doc_id for x in dedup.fuzzy_dedup(df, ["doc_id"]).collect()} == greedy(rows, 0.8)


def test_bands_meet_near_copies(spark):
    assert dedup.band_plan(0.8, 128) == (9, 13) and dedup.sure_plan(0.8, 128) == (21, 6)
    rows = [(1, " ".join(f"w{i}" for i in range(200))), (2, " ".join(f"w{i}" for i in range(199)) + " other"), (3, "quite another text of a few words")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r.a, r.b) for r in dedup.candidate_pairs(dedup.minhash_bands(df)).collect()}
    assert got == {(1, 2)}


def test_every_pair_of_a_bucket_is_compared(spark):
    """Of four in one bucket only the second and the last are near; big buckets give the same."""
    texts = {1: "p q r s t", 2: "a b c d e f g h i j k l m n o", 3: "u v w x y", 4: "a b c d e f g h i j k l m n z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bands = spark.createDataFrame([(i, 0, 7) for i in texts], "doc_id bigint, band int, hash bigint")
    every = {(a, b) for a in texts for b in texts if a < b}
    for block in (1, 2, 100):
        assert {tuple(x) for x in dedup.candidate_pairs(bands, block=block).collect()} == every
    for big in (3, 100):
        assert {(r.a, r.b) for r in dedup.verified_pairs(bands, df, "doc_id", "text", 0.8, 5, big).collect()} == {(2, 4)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert dedup.fuzzy_dedup(df, ["doc_id"]).count() == 0
