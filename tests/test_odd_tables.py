"""The core's queries over odd and over empty tables: nulls in any column, empty, blank and long texts, repeated rows, extra columns of clashing names."""

import datetime

import pytest

from granthika import registry

NOW = datetime.datetime(2024, 1, 1)
LONG = "या भागात मातीची भांडी तयार करतात आणि हे काम कठीण आहे. " * 300
TEXTS = [None, "", " \n\t ", "x", LONG, "अ" * 5_000, "एक दोन तीन\nread more\nएक दोन तीन\n" * 9, "a\r\nb c\x85d", "\0﻿", "𝒳 😀", "12 34", "a|b|c\n1|2|3"]
CLASH = "_len int, _part string, rank string, split string, copy string, n string, first string, start int, k int, rep int, redactions string, prob string, total string"
SCHEMAS = {
    "documents": "doc_id bigint, id string, source string, subject_domain string, title string, lang string, text string, n_chars bigint, fetched_at timestamp",
    "shard_log": "log_id bigint, source string, shard_no int, line_no int, id string, doc_id bigint, stage string, n_bytes bigint, proxy_tokens bigint, fetched_at timestamp, ingested_at timestamp",
    "instruct_pairs": "pair_id bigint, source string, instruction string, response string, created_at timestamp",
    "indic_turns": "row_id bigint, dataset string, mar_deva array<array<string>>",
    "tweets": "tweet_id bigint, tweet string, label int, split_name string, posted_at timestamp, received_at timestamp",
    "lang_samples": "sample_id bigint, lang string, text string",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "tok_pieces": "token_id int, piece string, kind string, score double",
}
ROWS = {
    "documents": [(k * 100 + i, f"id{i}", ["a", None, "wikipedia"][i % 3], None, None, ["mr", None, ""][i % 3], t, None, NOW) for k in range(2) for i, t in enumerate(TEXTS)] + [(900, None, None, None, None, None, None, None, None)],
    "shard_log": [(1, "a", 0, 0, "x", 3, "prepare", None, None, NOW, None), (2, None, None, None, None, None, None, None, None, None, None)],
    "instruct_pairs": [(i, "s", t, TEXTS[-i], None) for i, t in enumerate(TEXTS)],
    "indic_turns": [(1, "d", [["a", "b"], None, ["c"], [None, "x"], [" ", "y"]]), (2, None, None), (3, "d", []), (4, "manual", [["q" * 300, "r"]])],
    "tweets": [(i, t, [1, 0, -1, None][i % 4], ["train", "test", None][i % 3], None, None) for i, t in enumerate(TEXTS)],
    "lang_samples": [(1, "mr", LONG), (2, "en", "the dog and the cat"), (3, None, "x"), (4, "hi", None)],
    "events": [(1, NOW, 1, "a", 2.0, None), (2, None, None, None, None, None), (3, NOW, 1, "a", 2.0, None)],
    "embeddings": [(1, [1.0, 1.0, 0.5], 0), (2, [], None), (3, None, None), (4, [None, 2.0], 1)],
    "tok_pieces": [(0, "▁", "piece", -3.0), (1, "<0x00>", "byte", -20.0), (2, None, None, None)],
}


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(request.param))
    for name, schema in SCHEMAS.items():
        more = CLASH if name == "documents" else ""
        data = [(*r, *([None] * (13 if more else 0))) for r in ROWS[name]] if request.param == "odd" else []
        spark.createDataFrame(data, schema + (", " + more if more else "")).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return request.param, folder


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    registry.queries()[name](spark, tables[1]).collect()
