"""Splits, packing, instruction data, evaluation, decoding, sources, streaming and plans."""

import math

import pytest
from pyspark.sql import functions as F

from granthika.operators import decoding, evaluation, instruct, language, packing, sampling, schedule, vocabulary
from granthika.plans import cleaning
from granthika.sources import shards
from granthika.streaming import ingest


def test_splits_are_disjoint_and_whole(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "wikipedia").otherwise("web").alias("source"), F.col("id").cast("string").alias("id"))
    s = df.withColumn("split", sampling.split_of(F.col("source"), F.col("id")))
    n = {(r.source, r.split): r["count"] for r in s.groupBy("source", "split").count().collect()}
    assert sum(n.values()) == 4000 and ("web", "wiki_val") not in n and 15 < n["wikipedia", "wiki_val"] < 80
    up = sampling.upweight(s, {"wikipedia": 2})
    assert up.count() == 4000 + n["wikipedia", "train"]
    for limit, want in ((None, 4000), (0, 0), (3, 6)):
        assert sampling.first_per_source(df, limit, ["id"]).count() == want


def test_offsets_blocks_and_the_flat_files(spark, tmp_path):
    rows = [("train", 1, [10, 20, 30, 3]), ("train", 2, [40, 50, 60, 70, 80, 3]), ("train", 3, [5, 3])]
    df = packing.with_offsets(spark.createDataFrame(rows, "split string, doc_id int, ids array<int>"), ["doc_id"])
    assert [(r.start, r.end) for r in df.orderBy("doc_id").collect()] == [(0, 4), (4, 10), (10, 12)]
    assert packing.write_flat(df, str(tmp_path), "train") == (3, 12)
    assert (tmp_path / "train.bin").stat().st_size == 24 and (tmp_path / "train.idx").stat().st_size == 32
    assert packing.read_flat(str(tmp_path), "train") == [r[2] for r in rows]
    got = packing.blocks(df, 5).orderBy("block").collect()
    stream = [i for r in rows for i in r[2]]
    assert [(r.x, r.y) for r in got] == [(stream[a : a + 5], stream[a + 1 : a + 6]) for a in (0, 5)]
    for n, want in ((8, 1), (9, 2), (1, 0)):
        one = packing.with_offsets(spark.createDataFrame([("t", 1, list(range(n)))], "split string, doc_id int, ids array<int>"), ["doc_id"])
        assert packing.blocks(one, 4).count() == want


def test_streams_of_many_partitions(spark):
    """Offsets, blocks and windows equal a sequential pass, over rows of 20 partitions and splits of uneven size, in every run."""
    import random

    r = random.Random(11)
    rows = [(r.choice(["train"] * 9 + ["val"]) if i else None, i, [r.randrange(60_000) for _ in range(r.choice([0, 1, 3, 40, 200]))]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "split string, doc_id int, ids array<int>").repartition(20)
    streams, starts = {}, {}
    for s, i, ids in rows:
        starts[i] = len(streams.setdefault(s, []))
        streams[s] += ids
    for _ in range(3):
        placed = packing.with_offsets(df, ["doc_id"])
        assert {x.doc_id: x.start for x in placed.collect()} == starts
    got = {(x.split, x.block): (x.x, x.y) for x in packing.blocks(placed, 64).where("split is not null").collect()}
    assert got == {(s, b): (t[b * 64 : b * 64 + 64], t[b * 64 + 1 : b * 64 + 65]) for s, t in streams.items() if s for b in range((len(t) - 1) // 64)}
    seen = packing.random_windows(placed, "val", 50, 33).collect()
    val = streams["val"]
    assert len(seen) == 50 and len({x.start % 33 for x in seen}) > 5
    assert all((x.x, x.y) == (val[x.start : x.start + 33], val[x.start + 1 : x.start + 34]) for x in seen)
    assert packing.random_windows(placed, "none", 5, 33).count() == 0


def test_instruction_data(spark):
    rows = [(1, [["a", "b"], ["only"], ["x", "y", "z"], ["  q ", " r "], ["", "s"]]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "row_id int, mar_deva array<array<string>>")
    got = [(r.instruction, r.response) for r in instruct.flatten_turns(df).orderBy("turn").collect()]
    assert got == [("a", "b"), ("q", "r")]
    pairs = spark.createDataFrame([(1, 0, [7, 8], [9]), (2, 0, [7], [1, 2, 4])], "example int, batch_id int, prompt_ids array<int>, response_ids array<int>")
    e = instruct.masked_examples(pairs, 5)
    assert [(r.ids, r["mask"]) for r in e.orderBy("example").collect()] == [([7, 8, 9, 1], [0, 0, 1, 1]), ([7, 1, 2, 4, 1], [0, 1, 1, 1, 1])]
    assert instruct.masked_examples(pairs, 4).count() == 1
    b = instruct.padded(e, pad=3).orderBy("example").collect()
    assert [(r.x, r.y) for r in b] == [([7, 8, 9, 3], [-1, 9, 1, -1]), ([7, 1, 2, 4], [1, 2, 4, 1])]
    batches = instruct.epoch_batches(spark.range(10).withColumnRenamed("id", "example"), 4)
    assert sorted(r["count"] for r in batches.groupBy("batch_id").count().collect()) == [2, 4, 4]


def test_evaluation(spark):
    s = spark.createDataFrame([(1, 1, -2.0), (1, -1, -2.0), (1, 0, -3.0), (2, 0, -1.0), (2, 1, -4.0)], "ctx int, label int, logp double")
    assert {r.ctx: r.predicted for r in evaluation.label_argmax(s).collect()} == {1: 1, 2: 0}
    p = evaluation.perplexity(spark.createDataFrame([("v", 1.0, 1), ("v", 3.0, 3)], "split string, loss double, n int")).collect()[0]
    assert math.isclose(p.loss, 2.5) and math.isclose(p.perplexity, math.exp(2.5))


def test_decoding(spark):
    df = spark.createDataFrame([(0, t, x) for t, x in enumerate([2.0, 1.0, 1.0, 0.0])], "ctx int, token int, logit double")
    assert {r.token for r in decoding.top_k(df, 2).collect()} == {0, 1, 2}
    assert {r.token for r in decoding.top_p(df, 0.01).collect()} == {0}
    assert decoding.draw(df, 1).count() == 1
    one = spark.createDataFrame([([1, 2, 3, 4], "a b<|endoftext|>c")], "ids array<int>, t string").select(decoding.last_tokens(F.col("ids"), 3).alias("i"), decoding.until_end(F.col("t")).alias("t")).collect()[0]
    assert one.i == [2, 3, 4] and one.t == "a b"


def test_schedule(spark):
    lr = [r.lr for r in schedule.schedule(spark, 100, 0.1, 1.0, 0.1).orderBy("step").collect()]
    assert math.isclose(lr[0], 0.1) and math.isclose(lr[9], 1.0) and math.isclose(lr[100], 0.1) and lr[10:] == sorted(lr[10:], reverse=True)


def test_recovered_documents(spark):
    texts = [("two", "p1\nx\n\np2"), ("one", "\n".join(f"l{i}" for i in range(101))), ("none", " \n ")]
    got = shards.recover_documents(spark.createDataFrame(texts, "stem string, text string")).collect()
    n = {s: [len(r.text.split("\n")) for r in got if r.stem == s] for s, _ in texts}
    assert n == {"two": [2, 1], "one": [50, 50, 1], "none": []}
    assert {r.id for r in got} == {"one-0", "one-1", "one-2", "two-3", "two-4"}


def test_shards_keep_their_order(spark, tmp_path):
    """Rolling zstd shards, line numbers within files and rows over all files, blank lines counted, ids of text and Parquet rows."""
    import zstandard

    rows = [(i, f"id{i}", "s", None, "x" * (i % 50) + "अ") for i in range(3000)]
    df = spark.createDataFrame(rows, "n int, id string, source string, title string, text string").repartition(7)
    files = shards.write_rolling(df, str(tmp_path / "z"), ["n"], target_mb=0.05)
    assert len(files) > 3 and sum(f[1] for f in files) == 3000 and all(abs(f[2] - 0.05 * 2**20) < 200 for f in files[:-1])
    lines = []
    for name, n, size in files:
        raw = zstandard.ZstdDecompressor().stream_reader((tmp_path / "z" / name).open("rb")).read()
        assert len(raw) == size and raw.count(b"\n") == n
        lines += raw.decode().splitlines()
    got = shards.read_shards(spark, str(tmp_path / "z")).orderBy("_row").collect()
    assert [r.id for r in got] == [f"id{i}" for i in range(3000)] and [r._row for r in got] == list(range(3000))
    assert got[0]._line == 0 and got[files[0][1]]._line == 0 and got[files[0][1] + 5]._line == 5
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "t" / "b.txt").write_text(" \nfive")
    docs = {r.id: r.text for r in shards.read_text_documents(spark, str(tmp_path / "t"), "s").collect()}
    assert docs == {"0": "one", "2": " two ", "4": "five"}
    assert sorted(r.line for r in shards.read_lines(spark, str(tmp_path / "t"), 4).collect()) == ["one", "two"]
    assert shards.write_shards(df, str(tmp_path / "j"), target_mb=0.02, order=["n"]) > 2
    assert [r.id for r in shards.read_shards(spark, str(tmp_path / "j")).orderBy("_row").collect()] == [f"id{i}" for i in range(3000)]
    df.orderBy("n").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert {r.id: r.text for r in shards.read_parquet_documents(spark, str(tmp_path / "p"), "s").collect()}["77"] == rows[77][4]
    good, bad = shards.isolated({"a": lambda: df, "b": lambda: spark.read.parquet(str(tmp_path / "no")), "c": lambda: df.select(F.raise_error(F.lit("broken")))}, lambda _, x: x.write.format("noop").mode("overwrite").save())
    assert set(good) == {"a"} and set(bad) == {"b", "c"}


def test_shards_round_trip_and_incremental_ingest(spark, tmp_path):
    rows = [(str(i), "s", None, f"text {i}") for i in range(20)]
    df = spark.createDataFrame(rows, shards.DOCUMENT)
    assert shards.write_shards(df, str(tmp_path / "a"), target_mb=1) == 1
    back = shards.read_shards(spark, str(tmp_path / "a"))
    assert {(r.id, r.text) for r in back.collect()} == {(r[0], r[3]) for r in rows}
    run = lambda: ingest.ingest(ingest.document_stream(spark, str(tmp_path / "a")), str(tmp_path / "out"), str(tmp_path / "ck"), ingest.streaming_exact_dedup)
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert shards.read_manual_pairs(spark, str(tmp_path / "missing")).count() == 0
    with pytest.raises(ValueError):
        shards.require_column(df, "mar_Deva")


def test_pipeline_keeps_the_target_language_only(spark):
    mr = "हे काम कठीण आहे आणि ते चांगले आहे कारण लोक रोज शेतात जातात"
    hi = "यह काम कठिन है और वह अच्छा है क्योंकि लोग रोज खेत में जाते हैं"
    model = language.train(spark.createDataFrame([("mr", mr), ("hi", hi)], "lang string, text string"))
    long = lambda t: " ".join(" ".join(t.split()[i % 5 :]) for i in range(30))
    docs = spark.createDataFrame([("s", 1, "hi", long(mr)), ("s", 2, "mr", long(hi)), ("s", 3, "mr", None)], "source string, doc_id bigint, lang string, text string")
    assert {r.doc_id for r in cleaning.clean(docs).collect()} == {1, 2}
    assert {r.doc_id for r in cleaning.clean(docs, language_model=model).collect()} == {1}


def test_language_filter(spark):
    samples = spark.createDataFrame([("en", "the cat sat on the mat and the dog"), ("mr", "हे काम कठीण आहे आणि ते चांगले आहे")], "lang string, text string")
    docs = spark.createDataFrame([(1, "the dog and the cat"), (2, "काम चांगले आहे"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.lang for r in language.identify(docs, language.train(samples)).collect()}
    assert got[1] == "en" and got[2] == "mr"
    model = language.train(samples)
    here, joined = ({r.doc_id: (r.lang, round(r.prob, 9)) for r in language.identify(docs, model, most=m).collect()} for m in (1_000_000, 0))
    assert here == joined


def test_merges_go_on_to_the_last_pair(spark, tmp_path):
    """The query's merges equal those of a scan of all pairs, and do not stop at 200."""
    import random

    from granthika import registry

    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)) * 2 for _ in range(20)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(x["left"], x["right"]) for x in registry.byte_pair_merges(spark, str(tmp_path)).orderBy("place").collect()]
    words = [[["▁", *x["word"]], x["n"]] for x in packing.word_vocabulary(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()]
    want = []
    while True:
        pairs = {}
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] = pairs.get(p, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] <= 1:
            break
        want.append(best)
        for x in words:
            new, k = [], 0
            while k < len(x[0]):
                two = tuple(x[0][k : k + 2]) == best
                new.append("".join(best) if two else x[0][k])
                k += 1 + two
            x[0] = new
    assert got == want and len(got) > 200


def test_byte_pair_encoding_comes_back(spark):
    """Ids give every text back, characters outside the alphabet by their bytes; special symbols are one id each."""
    from granthika.operators.pieces import BytePairs

    df = spark.createDataFrame([("मातीची भांडी मातीची भांडी करतात करतात low low lower newest",)] * 20 + [("🙂",)], "text string")
    alphabet = vocabulary.character_coverage(df, coverage=0.999)
    assert "🙂" not in alphabet
    merges = vocabulary.byte_pair_merges(df, 60, alphabet=alphabet)
    coder = BytePairs(alphabet, merges, vocabulary.SPECIAL)
    for text in ("मातीची भांडी", " low  newest ", "🙂 नवीन 漢字", "", "\n", "<|user|>low<|endoftext|>"):
        assert coder.decode(coder.encode(text)) == text
    assert coder.encode("<|endoftext|>") == [0] and len(coder.encode("मातीची")) < len("मातीची")
    assert len(coder.encode("🙂")) == 4


def test_unigram_ids_equal_brute_force():
    from granthika.operators.pieces import Unigram

    table = [(5, "▁", "piece", -3.0), (6, "a", "piece", -4.0), (7, "b", "piece", -4.0), (8, "ab", "piece", -5.0), (9, "▁a", "piece", -4.5), (10, "bab", "piece", -9.5), *((100 + b, f"<0x{b:02X}>", "byte", -20.0) for b in range(256))]
    u = Unigram(table)
    score = {p: (i, s) for i, p, k, s in table if k == "piece"}

    def best(text):
        if not text:
            return (0.0, 0, [])
        options = []
        for p, (i, s) in score.items():
            if text.startswith(p):
                t = best(text[len(p) :])
                options.append((t[0] + s, t[1] - 1, [i, *t[2]]))
        if text[0] not in score:
            b, t = text[0].encode(), best(text[1:])
            options.append((t[0] - 20.0 * len(b), t[1] - len(b), [100 + x for x in b] + t[2]))
        return max(options, key=lambda x: x[:2])

    for w in ("a", "ab", "abab", "bbb", "aé", "क", "xabx"):
        got = u.word(w)
        want = best("▁" + w)
        assert len(got) == -want[1] and got == want[2], w
    assert u.encode(" ab\n a ") == u.word("ab") + u.word("a") and u.encode("") == []


def test_byte_pair_merges(spark):
    df = spark.createDataFrame([("low low low lower newest newest",)], "text string")
    merges = vocabulary.byte_pair_merges(df, 3)
    assert len(merges) == 3 and all(isinstance(a, str) for a, _ in merges)


def test_merges_of_many_words_take_little_memory(spark):
    """The driver keeps words in files: 60,000 long words take under 100 MB (as lists and sets they took 200)."""
    import random
    import tracemalloc

    r = random.Random(5)
    df = spark.createDataFrame([(" ".join("".join(chr(r.randrange(0x905, 0x939)) for _ in range(20)) for _ in range(1_000)),) for _ in range(60)], "text string")
    tracemalloc.start()
    try:
        merges = vocabulary.byte_pair_merges(df, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(merges) == 5 and peak < 100e6, peak


def test_merges_do_not_depend_on_what_is_indexed():
    """Few pairs, places, symbols and words at a time give the merges of one index of all."""
    import random

    from granthika.operators import merging

    r = random.Random(7)
    words = {"".join(r.choice("aab▁c\0") for _ in range(r.randint(1, 9))): r.randint(1, 5) for _ in range(80)}
    want = merging.learned(words.items(), 1_000)
    assert len(want) > 20
    for pairs, places in ((1, 1), (3, 10)):
        assert merging.learned(words.items(), 1_000, pairs=pairs, places=places) == want
    assert merging.learned([], 10) == []


def test_clean_plan(spark):
    w = " ".join(f"शब्द{i}" for i in range(30))
    rows = [("a", 1, "mr", w), ("a", 2, "mr", w), ("b", 3, "mr", w + " आणखी"), ("b", 4, "en", "english text only"), ("b", 5, "mr", None), ("c", 6, "mr", " ".join(f"वेगळे{i}" for i in range(25)) + " x@y.in")]
    out = cleaning.clean(spark.createDataFrame(rows, "source string, doc_id int, lang string, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {1, 6} and got[6].endswith("[EMAIL]")
    import json

    stats = cleaning.statistics(spark.createDataFrame(rows, "source string, doc_id int, lang string, text string"), out)
    told = json.loads(cleaning.statistics_json(stats).collect()[0]["json"])
    assert told["totals"]["docs_input"] == 6 and told["totals"]["final"] == 2 and told["totals"]["email"] == 1
    assert told["per_source"]["a"]["docs_input"] == 2 and told["per_source"]["b"]["final"] == 0
