"""The core's queries over whole tables, and the SQL each is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, redaction
from .functions import text as T
from .operators import decoding, dedup, evaluation, instruct, language, packing, pieces, quality, sampling, schedule, vocabulary
from .plans import cleaning
from .sources import shards
from .streaming import ingest

ORDER = ["source", "doc_id"]
#: Near duplicates from this similarity on.
NEAR = 0.8
#: Logits are the embeddings' entries: the first of each vector is its token 0.
TOP_K, TOP_P, STEPS = 10, 0.5, 500
BLOCK = 256
#: Merges learned: the size of the reference's vocabulary.
MERGES = 32_000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents")


def _text() -> F.Column:
    return T.not_null(F.col("text"))


# ------------------------------------------------------------------ documents


def corpus_size(spark, d):
    return quality.corpus_size(_docs(spark, d))


def text_measures(spark, d):
    t = _text()
    return _docs(spark, d).select("doc_id", T.word_count(t).alias("n_words"), F.round(T.symbol_ratio(t), 9).alias("symbol_ratio"), F.round(T.script_ratio(t), 9).alias("script_ratio"), F.size(T.lines(t)).alias("n_lines"))


def repeated_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.repeated_line_ratio(_text()), 9).alias("repeated_ratio"))


def frame_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.frame_line_ratio(_text()), 9).alias("frame_ratio"), T.without_frame_lines(_text()).alias("clean_text"))


def quality_reasons(spark, d):
    return quality.with_quality(_docs(spark, d)).select("doc_id", "n_words", F.coalesce("reject_reason", F.lit("kept")).alias("reason"))


def clean_funnel(spark, d):
    return quality.funnel(_docs(spark, d), F.col("lang") == "mr")


def identified_funnel(spark, d):
    """The funnel with the language stage by identification."""
    df = _docs(spark, d)
    found = language.identify(df, language.train(_t(spark, d, "lang_samples"))).select("doc_id", F.col("lang").alias("_lang"), F.col("prob").alias("_prob"))
    passes = (F.col("_lang") == "mr") & (F.col("_prob") >= language.LEAST_PROB)
    return quality.funnel(df.join(found, "doc_id", "left"), passes)


def exact_dedup(spark, d):
    return dedup.exact_dedup(_docs(spark, d).select("source", "doc_id", "text"), ORDER).select("doc_id")


def shingle_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.shingles(_text())).alias("n_shingles"))


def similar_pairs(spark, d):
    df = _docs(spark, d).select("source", "doc_id", "text")
    return dedup.similar_pairs(dedup.exact_dedup(df, ["doc_id"]), threshold=NEAR).select("a", "b", F.round("similarity", 9).alias("similarity"))


def fuzzy_dedup(spark, d):
    df = dedup.exact_dedup(_docs(spark, d).select("source", "doc_id", "text"), ORDER)
    return dedup.fuzzy_dedup(df, ORDER, threshold=NEAR).select("doc_id")


def fuzzy_dedup_lsh(spark, d):
    df = dedup.exact_dedup(_docs(spark, d).select("source", "doc_id", "text"), ORDER)
    return dedup.fuzzy_dedup(df, ORDER, threshold=NEAR, how="lsh").select("doc_id")


def dedup_counters(spark, d):
    df = _docs(spark, d).select("source", "doc_id", "text")
    exact = dedup.exact_dedup(df, ORDER)
    return dedup.dedup_counters(df, exact, dedup.fuzzy_dedup(exact, ORDER, threshold=NEAR))


def redacted(spark, d):
    text, counts = redaction.redact(_text())
    return _docs(spark, d).select("doc_id", text.alias("redacted"), *[c.alias(f"n_{k}") for k, c in counts.items()])


def nfc_text(spark, d):
    return _docs(spark, d).select("doc_id", T.nfc(_text()).alias("nfc_text"))


def clean_pipeline(spark, d):
    return cleaning.clean(_docs(spark, d), language_model=language.train(_t(spark, d, "lang_samples"))).select("source", "doc_id", "text")


def languages(spark, d):
    model = language.train(_t(spark, d, "lang_samples"))
    return language.identify(_docs(spark, d), model).select("doc_id", "lang", F.round("prob", 6).alias("prob"))


def recovered_documents(spark, d):
    return shards.recover_documents(_docs(spark, d).select(F.col("doc_id").cast("string").alias("stem"), _text().alias("text")))


def first_per_source(spark, d):
    return sampling.first_per_source(_docs(spark, d).select("source", "doc_id"), 10, ["doc_id"])


def ingest_summary(spark, d):
    return quality.ingest_summary(_t(spark, d, "shard_log"))


# ------------------------------------------------------------ splits, packing


def holdout(spark, d):
    return _docs(spark, d).where(sampling.is_holdout(F.col("source"), F.col("id"), how="md5")).select("doc_id")


def _split(df: DataFrame, how: str) -> DataFrame:
    return df.withColumn("split", sampling.split_of(F.col("source"), F.col("id"), how=how))


def splits(spark, d):
    return _split(_docs(spark, d), "md5").select("doc_id", "split")


def splits_xxh64(spark, d):
    return _split(_docs(spark, d), "xxh64").select("doc_id", "split")


def holdout_xxh64(spark, d):
    return _docs(spark, d).where(sampling.is_holdout(F.col("source"), F.col("id"))).select("doc_id")


def upweighted(spark, d):
    return sampling.upweight(_split(_docs(spark, d), "md5"), {"wikipedia": 2}).groupBy("source", "split").agg(F.count("*").alias("docs"), F.sum(T.word_count(_text())).alias("words"))


def hash_sample(spark, d):
    return sampling.hash_sample(_docs(spark, d), 0.3, how="md5").select("doc_id")


def _streams(spark, d) -> DataFrame:
    """Word tokens and an end per document that is not blank, wikipedia's train documents twice."""
    df = _split(_docs(spark, d), "md5").where(~T.is_blank(F.col("text")))
    copies = sampling.upweight(df, {"wikipedia": 2})
    # A word's id is a hash that other engines can compute too.
    ids = F.concat(F.transform(T.words(_text()), lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % 60_000) + 2), F.array(F.lit(1)))
    return packing.with_offsets(copies.select("source", "doc_id", "copy", "split", ids.alias("ids")), ["source", "doc_id", "copy"])


def document_offsets(spark, d):
    return _streams(spark, d).select("split", "doc_id", "copy", "start", "end")


def _joined(ids: str | F.Column) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def token_blocks(spark, d):
    """Every block, its inputs and targets as hashes."""
    return packing.blocks(_streams(spark, d), BLOCK).select("split", "block", F.md5(_joined("x")).alias("x_md5"), F.md5(_joined("y")).alias("y_md5"))


def split_counts(spark, d):
    return packing.split_counts(_streams(spark, d))


def vocabulary_counts(spark, d):
    return packing.word_vocabulary(_docs(spark, d))


def byte_pair_merges(spark, d):
    merges = vocabulary.byte_pair_merges(_docs(spark, d), MERGES)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "place int, left string, right string")


# ------------------------------------------------------------ instruction data


def _pairs(spark, d) -> DataFrame:
    flat = instruct.flatten_turns(_t(spark, d, "indic_turns"), keep=("row_id", "dataset"))
    return flat.select(F.concat_ws("-", "row_id", "turn").alias("example"), F.col("dataset").alias("source"), "instruction", "response")


def flat_turns(spark, d):
    return _pairs(spark, d)


def instruction_splits(spark, d):
    return _pairs(spark, d).withColumn("split", instruct.instruction_split(F.col("source"), F.col("instruction"), how="md5")).transform(instruct.example_counts)


def instruction_splits_xxh64(spark, d):
    return _pairs(spark, d).select("example", instruct.instruction_split(F.col("source"), F.col("instruction")).alias("split"))


def chat_texts(spark, d):
    return _pairs(spark, d).select("example", instruct.chat_text(F.col("instruction"), F.col("response")).alias("chat"))


def _token_pairs(spark, d) -> DataFrame:
    ids = lambda c: F.transform(T.words(c), lambda w: F.length(w) + 1)
    return _pairs(spark, d).withColumns({"prompt_ids": ids(instruct.prompt_of(F.col("instruction"))), "response_ids": ids(F.col("response"))})


def _examples(spark, d) -> DataFrame:
    return instruct.masked_examples(_token_pairs(spark, d), 64)


def masked_examples(spark, d):
    return _examples(spark, d).select("example", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.array_join(F.transform("mask", lambda i: i.cast("string")), ",").alias("mask"))


def padded_batches(spark, d):
    e = _examples(spark, d).withColumn("batch_id", F.conv(F.substring(F.md5("example"), 1, 4), 16, 10).cast("bigint") % 25)
    return instruct.padded(e).select("example", "batch_id", _joined("x").alias("x"), _joined("y").alias("y"))


# ------------------------------------------------------------------ evaluation


def fertility(spark, d):
    t = _text()
    # Sums first, one row; then a row a tokenizer.
    sums = _docs(spark, d).agg(F.sum(F.length(t)).alias("characters"), F.sum(F.octet_length(t)).alias("bytes"), F.sum(T.word_count(t)).alias("words"))
    return evaluation.fertility(sums.select(F.col("words").alias("n_words"), F.explode(F.create_map(*[x for c in ("characters", "bytes", "words") for x in (F.lit(c), F.col(c))])).alias("tokenizer", "n_tokens")))


def perplexity(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("split"), (F.col("value") / 100).alias("loss"), (F.col("user_id") % 7 + 1).alias("n"))
    return evaluation.perplexity(e).select("split", F.round("loss", 6).alias("loss"), F.round("perplexity", 5).alias("perplexity"), "tokens")


def mean_losses(spark, d):
    return evaluation.mean_loss(_t(spark, d, "events"), ["event_type"], "value").select("event_type", F.round("mean_loss", 6).alias("mean_loss"))


def _tweets(spark, d) -> DataFrame:
    return shards.clean_tweets(_t(spark, d, "tweets").where("label is not null"))


def clean_tweets(spark, d):
    return _tweets(spark, d).select("tweet_id", "tweet", "label")


def exemplars(spark, d):
    return evaluation.exemplars(_tweets(spark, d).where("split_name = 'train'"), 3).select("tweet_id", "label")


def few_shot_prompt(spark, d):
    shots = evaluation.exemplars(_tweets(spark, d).where("split_name = 'train'"), 3)
    return evaluation.few_shot_prompt(shots, F.concat(F.col("tweet"), F.lit("\n"), F.col("label").cast("string")))


def _predictions(spark, d) -> DataFrame:
    labels = spark.createDataFrame([(1,), (-1,), (0,)], "label_of int")
    # Stand-in scores: how far a hash of tweet and label is from nought, in steps that tie at times.
    scores = _tweets(spark, d).crossJoin(F.broadcast(labels)).select("tweet_id", F.col("label_of"), (F.lit(0.0) - hashing.bucket(F.concat_ws(":", F.col("tweet_id").cast("string"), F.col("label_of").cast("string")), 8, "md5")).alias("logp"))
    return evaluation.label_argmax(scores, "tweet_id", "label_of")


def label_argmax(spark, d):
    return _predictions(spark, d)


def accuracy(spark, d):
    got = evaluation.accuracy(_predictions(spark, d).join(_tweets(spark, d).select("tweet_id", "label"), "tweet_id"))
    return got.select("correct", "n", F.round("accuracy", 9).alias("accuracy"), F.round("baseline", 9).alias("baseline"))


def _logits(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("ctx"), F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


def top_k(spark, d):
    return decoding.top_k(_logits(spark, d), TOP_K).select("ctx", "token")


def softmax(spark, d):
    return decoding.softmax(_logits(spark, d)).select("ctx", "token", F.round("p", 9).alias("p"))


def top_p(spark, d):
    return decoding.top_p(decoding.top_k(_logits(spark, d), TOP_K), TOP_P).select("ctx", "token")


def drawn_tokens(spark, d):
    return decoding.draw(_logits(spark, d), seed=1)


def learning_rates(spark, d):
    return schedule.schedule(spark, STEPS, 0.03, 6e-4, 6e-5).select("step", F.round("lr", 12).alias("lr"))


def checkpoints(spark, d):
    """The newest three events of each user stand for a run's checkpoints, the least value for its loss."""
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("step"))
    return schedule.newest(e, 3, "step", run="user_id")


CORE = [
    corpus_size, text_measures, repeated_lines, frame_lines, quality_reasons, clean_funnel, exact_dedup, shingle_counts, similar_pairs, fuzzy_dedup, fuzzy_dedup_lsh,
    dedup_counters, redacted, nfc_text, clean_pipeline, languages, recovered_documents, first_per_source, ingest_summary, holdout, splits, splits_xxh64, upweighted,
    hash_sample, document_offsets, token_blocks, split_counts, vocabulary_counts, byte_pair_merges, flat_turns, instruction_splits, chat_texts, masked_examples,
    padded_batches, fertility, perplexity, mean_losses, clean_tweets, exemplars, few_shot_prompt, label_argmax, accuracy, top_k, softmax, top_p, drawn_tokens,
    learning_rates, checkpoints,
]


# ----------------------------------------------- sources, sinks and the rest


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads back, in the shared checkpoint folder."""
    return f"{dedup.shared_folder(spark)}/granthika-{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def shard_round_trip(spark, d):
    """Documents written as rolling zstd shards and read back in order."""
    folder = _scratch(spark, "shards")
    df = _docs(spark, d).where("source is not null and id is not null").select("source", "doc_id", "id", "title", "text")
    shards.write_rolling(df, _local(folder), ["source", "doc_id"], target_mb=8)
    schema = "source string, doc_id bigint, id string, title string, text string"
    return shards.read_shards(spark, folder, schema).select(F.col("_row").alias("place"), "doc_id", "id", "title", F.md5("text").alias("text_md5"))


def ordered_shards(spark, d):
    """Gzip shards by source and document, line numbers checked against the order."""
    folder = _scratch(spark, "gzip")
    shards.write_shards(_docs(spark, d).select("source", "id", "title", "text", "doc_id"), folder, target_mb=1, order=ORDER)
    return shards.read_shards(spark, folder, "source string, doc_id bigint, id string").select(F.col("_row").alias("place"), "doc_id")


def by_source(spark, d):
    """Documents written by source; the sources found are the folders."""
    folder = _scratch(spark, "sources")
    shards.write_by_source(_docs(spark, d).select("source", "doc_id"), folder)
    back = spark.read.schema("doc_id bigint, source string").parquet(folder)
    return back.groupBy("source").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least_id"))


def sources_found(spark, d):
    found = sampling.sources_of(_docs(spark, d))
    return spark.createDataFrame(list(enumerate(found)), "place int, source string")


def parquet_documents(spark, d):
    """A Parquet source in the common form: id and title of the rows."""
    return shards.read_parquet_documents(spark, f"{d}/documents.parquet", "sangraha", id="doc_id", title="title").select("id", "source", "title", F.length("text").alias("n_chars"))


def numbered_documents(spark, d):
    """A Parquet source without ids: rows numbered in order."""
    return shards.read_parquet_documents(spark, f"{d}/documents.parquet", "indiccorp").select("id", "source", F.md5("text").alias("text_md5"))


def text_documents(spark, d):
    """One document a line of a text file."""
    folder = _scratch(spark, "lines")
    _t(spark, d, "tweets").orderBy("tweet_id").select(F.regexp_replace(F.coalesce("tweet", F.lit("")), "[\\r\\n]", " ").alias("value")).coalesce(1).write.text(folder)
    return shards.read_text_documents(spark, folder, "tweets").select("id", "source", "text")


def text_lines(spark, d):
    """The first 50 lines of a file, those that are not blank."""
    folder = _scratch(spark, "prompts")
    _t(spark, d, "tweets").orderBy("tweet_id").select(F.regexp_replace(F.coalesce("tweet", F.lit("")), "[\\r\\n]", " ").alias("value")).coalesce(1).write.text(folder)
    return shards.read_lines(spark, folder, 50)


def tweet_csv(spark, d):
    """Tweets through a CSV file with a header."""
    folder = _scratch(spark, "csv")
    _t(spark, d, "tweets").where("label is not null").select("tweet", "label").write.option("header", True).option("escape", '"').csv(folder)
    return shards.read_tweets(spark, folder).groupBy("tweet", "label").agg(F.count("*").alias("n"))


def manual_pairs(spark, d):
    """Pairs through a JSON-lines file, and a missing file, which reads as none."""
    folder = _scratch(spark, "pairs")
    _t(spark, d, "instruct_pairs").select("instruction", "response").write.json(folder)
    return shards.read_manual_pairs(spark, folder).unionByName(shards.read_manual_pairs(spark, folder + "-missing"))


def isolated_sources(spark, d):
    """Rows of each source that can be read; two can't."""
    make = {name: (lambda n=name: shards.require_column(_t(spark, d, n), "source")) for name in ("documents", "instruct_pairs", "tweets", "missing")}
    good, bad = shards.isolated(make)
    rows = None
    for name, df in good.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(True).alias("read"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(spark.createDataFrame([(name, False, None) for name in bad], "table string, read boolean, n bigint"))


def pending_documents(spark, d):
    """Documents that the log does not yet list as prepared: what a resumed run goes on with."""
    done = _t(spark, d, "shard_log").where("stage = 'prepare' and doc_id is not null").select("doc_id").distinct()
    return ingest.pending(_docs(spark, d).select("doc_id"), done, ["doc_id"])


def streamed_documents(spark, d):
    """Documents ingested as a stream, twice: the second run finds nothing new, copies are dropped on arrival."""
    folder = _scratch(spark, "stream")
    source = _docs(spark, d).select("doc_id", "source", "text")
    source.write.parquet(f"{folder}/in")
    for _ in range(2):
        ingest.ingest(ingest.document_stream(spark, f"{folder}/in", source.schema, "parquet"), f"{folder}/out", f"{folder}/state", ingest.streaming_exact_dedup)
    return spark.read.parquet(f"{folder}/out").select(F.md5(T.nfc(_text())).alias("text_md5"))


def flat_files(spark, d):
    """Token files written by executors and read back: each document's place, and its ids' sum."""
    import numpy as np

    folder = _local(_scratch(spark, "flat"))
    streams = dedup.cut(_streams(spark, d))
    rows = []
    for split in ("train", "val", "wiki_val"):
        docs, total = packing.write_flat(streams, folder, split)
        ids, at = np.fromfile(f"{folder}/{split}.bin", dtype="<u2"), np.fromfile(f"{folder}/{split}.idx", dtype="<i8")
        rows.append((split, docs, total, int(ids.astype("int64").sum()), int((ids == 1).sum()), int(at[:-1].sum())))
    return spark.createDataFrame(rows, "split string, docs bigint, tokens bigint, sum_ids bigint, ends bigint, sum_starts bigint")


def corpus_meta(spark, d):
    """The description of the token files."""
    meta = packing.corpus_meta(dedup.cut(_streams(spark, d)), 60_002, 1, {"wikipedia": 2})
    return spark.createDataFrame([(meta,)], "json string").select(F.explode(F.from_json(F.get_json_object("json", "$.splits"), "map<string, struct<docs: bigint, tokens: bigint>>")).alias("split", "v")).select("split", "v.docs", "v.tokens")


def random_windows(spark, d):
    """Training windows that begin anywhere in a split."""
    w = packing.random_windows(_streams(spark, d), "train", 200, BLOCK)
    return w.select("window", "start", F.md5(_joined("x")).alias("x_md5"), F.md5(_joined("y")).alias("y_md5"))


def piece_tokens(spark, d):
    """Ids of every document under the piece table, an end after each; counted, and the least and greatest."""
    table = [tuple(r) for r in _t(spark, d, "tok_pieces").where("piece is not null").select("token_id", "piece", "kind", "score").collect()]
    ids = packing.encode_with(_docs(spark, d).where(~T.is_blank(F.col("text"))), pieces.piece_encoder(table), end=3)
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.array_min("ids").alias("least_id"), F.element_at("ids", -1).alias("last_id"))


def vocabulary_warning(spark, d):
    """Whether samples of a tenth of the text are too small for vocabularies of some sizes."""
    total = _docs(spark, d).agg(F.coalesce(F.sum(F.octet_length(_text())), F.lit(0))).collect()[0][0]
    return spark.createDataFrame([(v, vocabulary.too_little(total // 10, v)) for v in (100, 1_000, 32_000, 1_000_000)], "vocabulary int, too_little boolean")


def covered_characters(spark, d):
    """The alphabet: the most frequent characters that make up 99.95 % of the text."""
    return spark.createDataFrame([(c,) for c in vocabulary.character_coverage(_docs(spark, d))], "character string")


def sized_sample(spark, d):
    """A sample by hash of about 100,000 bytes."""
    df = _docs(spark, d)
    return sampling.hash_sample(df, sampling.sample_share(df, 100_000), how="md5").select("doc_id")


def capped_fuzzy_dedup(spark, d):
    """Near copies dropped until 100 documents are kept; later ones stay."""
    df = dedup.exact_dedup(_docs(spark, d).select("source", "doc_id", "text"), ORDER)
    return dedup.fuzzy_dedup(df, ORDER, threshold=NEAR, cap=100).select("doc_id")


def unfuzzy_pipeline(spark, d):
    """The cleaning pipeline without near de-duplication or language stage."""
    out = cleaning.clean(_docs(spark, d), cleaning.CleanConfig(fuzzy=None))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "redactions.*")


def clean_statistics(spark, d):
    """Funnel, remaining documents and redactions per source and in total."""
    df = _docs(spark, d)
    return cleaning.statistics(df, cleaning.clean(df, cleaning.CleanConfig(fuzzy=None)))


def turn_limit(spark, d):
    """Rows until 50 turns are read; a row is never cut."""
    return instruct.limit_after_row(_t(spark, d, "indic_turns"), 50, "row_id").select("row_id")


def united_sources(spark, d):
    pairs = instruct.flatten_turns(_t(spark, d, "indic_turns"))
    manual = _t(spark, d, "instruct_pairs").select("instruction", "response")
    return instruct.union_sources({"turns": pairs, "manual": manual}).groupBy("source").agg(F.count("*").alias("pairs"), F.count("response").alias("answered"))


def skipped_examples(spark, d):
    return instruct.skipped(_token_pairs(spark, d), 64)


def epoch_batches(spark, d):
    return instruct.epoch_batches(_examples(spark, d).select("example"), 32).select("example", "batch_id")


def warm_softmax(spark, d):
    """Chances at temperature 0.8, and at 0, where the greatest logit takes all."""
    hot = decoding.softmax(_logits(spark, d).withColumn("logit", decoding.temperature(F.col("logit"), 0.8))).select("ctx", "token", F.lit(0.8).alias("t"), F.round("p", 9).alias("p"))
    cold = decoding.softmax(_logits(spark, d).withColumn("logit", decoding.temperature(F.col("logit"), 0.0))).select("ctx", "token", F.lit(0.0).alias("t"), F.round("p", 9).alias("p"))
    return hot.unionByName(cold)


def last_tokens(spark, d):
    ids = F.transform(T.words(_text()), lambda w: F.length(w))
    return _docs(spark, d).select("doc_id", _joined(decoding.last_tokens(ids, 16)).alias("ids"))


def stopped_texts(spark, d):
    """What stands before the end mark."""
    chat = instruct.chat_text(F.col("instruction"), F.col("response"))
    return _pairs(spark, d).select("example", decoding.until_end(F.concat(F.lit("  "), chat, F.lit(" more"))).alias("text"))


def utilisation(spark, d):
    e = _t(spark, d, "events").where("value is not null")
    return e.select("event_id", F.round(schedule.utilisation(F.col("value") * 1000, 22_900_000, 8, 6, 64, 1024, 61.73e12), 9).alias("mfu"))


def best_checkpoints(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("val_loss"))
    return schedule.best(e, run="user_id").select("user_id", "step", F.round("val_loss", 6).alias("val_loss"))


def seeded_head(spark, d):
    return evaluation.seeded_head(_tweets(spark, d).where("split_name = 'test'"), 300, "tweet_id").select("tweet_id", "label")


EXTRA = [
    identified_funnel,
    holdout_xxh64, instruction_splits_xxh64,
    shard_round_trip, ordered_shards, by_source, sources_found, parquet_documents, numbered_documents, text_documents, text_lines, tweet_csv, manual_pairs, isolated_sources, pending_documents, streamed_documents,
    flat_files, corpus_meta, random_windows, piece_tokens, vocabulary_warning, covered_characters, sized_sample, capped_fuzzy_dedup, unfuzzy_pipeline, clean_statistics, turn_limit, united_sources, skipped_examples,
    epoch_batches, warm_softmax, last_tokens, stopped_texts, utilisation, best_checkpoints, seeded_head,
]


def queries() -> dict:
    return {q.__name__: q for q in [*CORE, *EXTRA]}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
