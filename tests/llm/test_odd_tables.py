"""Every query of this package over odd and over empty tables: nulls in any column, empty, blank and very long texts, repeated rows, extra columns of clashing names."""

import datetime

import pytest

from granthika.llm import registry

LONG = "या भागात मातीची भांडी तयार करतात आणि हे काम कठीण आहे. " * 400
TEXTS = [None, "", " \n\t ", "x", LONG, "अ" * 20_000, "या भागात मातीची भांडी तयार करतात.\nContact | Home\n" * 3, "हे काम कठीण आहे.\r\nवार्ताहर: कैवल्या मोरवंडे, ९००२७८१८३२", "\0﻿​", "𝒳 😀 \U000e0101", "12 34", "a|b|c\n1|2|3\nd|e|f"]
CLASH = "_salt int, lines string, key string, kind string, n bigint, chunk int, word string, block int, `_counted` string, copy string, exact string, lang_x string"


def rows(kind):
    if kind == "empty":
        return []
    now = datetime.datetime(2024, 1, 1)
    out = []
    for k in range(2):
        for i, t in enumerate(TEXTS):
            out.append((k * 100 + i, f"id{i}", ["a", None, "b"][i % 3], ["d", None][i % 2], None, ["mr", None, "", "und", "Hindi"][i % 5], t, None if t is None else len(t), now))
    return [*out, (None, None, None, None, None, None, None, None, None), (3, "id3", "a", "d", None, "mr", "x", 1, now)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    kind, folder = request.param, str(tmp_path_factory.mktemp(request.param))
    extra = [None] * 12
    save = lambda name, data, schema: spark.createDataFrame(data if kind == "odd" else [], schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    save("documents", [(*r, *extra) for r in rows(kind)], "doc_id bigint, id string, source string, subject_domain string, title string, lang string, text string, n_chars bigint, fetched_at timestamp, " + CLASH)
    save("instruct_pairs", [(i, "s", TEXTS[i % 12], TEXTS[(i * 5 + 1) % 12], None, 7) for i in range(24)] + [(None, None, None, None, None, None)], "pair_id bigint, source string, instruction string, response string, created_at timestamp, word int")
    save("eval_items", [(i, "quiz", "mr", t) for i, t in enumerate(TEXTS)] + [(None, None, None, None)], "item_id bigint, suite string, lang string, text string")
    save("lang_samples", [(0, "mr", TEXTS[6]), (1, "mr", TEXTS[7]), (2, "en", "In this area the potters make clay pots."), (3, None, "x"), (4, "hi", None), (None, None, None)], "sample_id bigint, lang string, text string")
    save("common_words", [("mr", "आहे", 1), ("en", "the", None), (None, None, None)], "lang string, word string, freq_rank int")
    save("source_targets", [("a", 0.6, 2), ("b", 0.3, None), ("c", 0.1, 1), (None, None, None)], "source string, target_share double, max_repeats int")
    save("tok_pieces", [(0, "<s>", "special", 0.0), (1, "<0x00>", "byte", -20.0), (2, "▁", "piece", -3.0), (3, "या", "piece", -4.0), (4, None, None, None)], "token_id int, piece string, kind string, score double")
    return kind, folder


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    kind, folder = tables
    got = registry.queries()[name](spark, folder).collect()
    if kind == "empty":
        assert got == [] or name in ("p4_totals",)
    elif name == "p2_statistics":  # a row a document, of whatever text
        assert len(got) == 26
