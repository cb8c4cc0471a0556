"""Readers and writers of corpus files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from ..functions import text as T

DOCUMENT = S.StructType([S.StructField("id", S.StringType()), S.StructField("source", S.StringType()), S.StructField("title", S.StringType()), S.StructField("text", S.StringType())])
PAIR = S.StructType([S.StructField("instruction", S.StringType()), S.StructField("response", S.StringType())])
TWEET = S.StructType([S.StructField("tweet", S.StringType()), S.StructField("label", S.IntegerType())])


def _in_file_order(df: DataFrame, within: Column | None = None) -> DataFrame:
    """``df``, read from files with ``_file``, with ``_line``, a row's number within its file, and ``_row``, its number over all files by name.

    Rows of one part of a file follow each other in the scan; parts are counted, and their counts added up before each.
    The counts are a row a part of a file."""
    part = df.withColumns({"_at": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()})
    counts = part.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    by_file, by_row = Window.partitionBy("_file").orderBy("_at"), Window.orderBy("_file", "_at")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("_file", "_at", "_first", before(by_file).alias("_in_file"), before(by_row).alias("_in_all"))
    inside = F.col("_id") - F.col("_first")
    joined = part.join(F.broadcast(placed), ["_file", "_at"])
    return joined.withColumns({"_line": F.col("_in_file") + inside, "_row": F.col("_in_all") + inside}).drop("_at", "_id", "_first", "_in_file", "_in_all")


def read_shards(spark: SparkSession, path: str, schema: S.StructType = DOCUMENT) -> DataFrame:
    """JSON-lines shards, plain, gzip or zstd, in order: ``_file``, ``_line`` within it and ``_row`` over all files by name.

    Null text reads as empty; blank lines are skipped but counted."""
    lines = spark.read.text(path).select("value", "_metadata", F.col("_metadata.file_path").alias("_file"))
    named = _in_file_order(lines).where(~T.is_blank(F.col("value"))).withColumn("_r", F.from_json("value", schema))
    flat = named.select("_r.*", "_file", "_line", "_row")
    return flat.withColumn("text", T.not_null(F.col("text"))) if "text" in flat.columns else flat


def write_shards(df: DataFrame, path: str, target_mb: float = 500, text: str = "text", compression: str = "gzip", fmt: str = "json", order: list[str] | None = None) -> int:
    """Shards of about ``target_mb`` of text each; returns their number.  JSON lines are gzip, Parquet zstd.

    With ``order`` the shards' names follow it, and so do the rows in each."""
    size = df.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    n = max(1, -(-int(size) // int(target_mb * (1 << 20))))
    shards = df.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else df.repartition(n)
    writer = shards.write.mode("overwrite")
    writer.option("compression", compression).json(path) if fmt == "json" else writer.option("compression", "zstd").parquet(path)
    return n


def write_rolling(df: DataFrame, folder: str, order: list[str], target_mb: float = 500, level: int = 9) -> list[tuple[str, int, int]]:
    """``(file, rows, bytes)`` of ``shard_0000.jsonl.zst`` and on, in order: JSON lines, a new shard once the target of uncompressed bytes is reached.

    Bytes before each row are summed over range partitions, so a row's shard is known without
    passing the rows through one task; a shard is one task's.  A row belongs to the shard in which
    it begins.  ``folder`` is one that all executors share."""
    from ..operators.packing import with_offsets

    target = int(target_mb * (1 << 20))
    Path(folder).mkdir(parents=True, exist_ok=True)
    line = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    lines = df.select(F.lit("").alias("_all"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], line.alias("_json"))
    placed = with_offsets(lines, [f"_o{i}" for i in range(len(order))], "_all", F.octet_length("_json") + 1).withColumn("shard", F.floor(F.col("start") / target).cast("bigint"))

    def write(batches):
        import os

        import zstandard

        now: dict = {}

        def close() -> pa.RecordBatch:
            now["out"].close()
            now["raw"].close()
            os.replace(now["made"], f"{folder}/{now['name']}")
            return pa.RecordBatch.from_pydict({"file": [now["name"]], "rows": [now["rows"]], "bytes": [now["bytes"]]}, schema=pa.schema([("file", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now.get("shard") != k:
                    if now:
                        yield close()
                    name = f"shard_{k:04d}.jsonl.zst"
                    made = f"{folder}/.{name}-{uuid.uuid4().hex}"
                    raw = open(made, "wb")  # noqa: SIM115 - closed with the shard
                    now.update(shard=k, name=name, made=made, raw=raw, out=zstandard.ZstdCompressor(level=level).stream_writer(raw, closefd=False), rows=0, bytes=0)
                line = x.encode("utf-8", "surrogatepass") + b"\n"
                now["out"].write(line)
                now["rows"], now["bytes"] = now["rows"] + 1, now["bytes"] + len(line)
        if now:
            yield close()

    ordered = placed.select("shard", "_json", "start").repartition("shard").sortWithinPartitions("shard", "start").select("shard", "_json")
    return sorted(tuple(r) for r in ordered.mapInArrow(write, "file string, rows bigint, bytes bigint").collect())


def write_by_source(df: DataFrame, path: str, source: str = "source") -> None:
    df.write.mode("overwrite").partitionBy(source).option("compression", "zstd").parquet(path)


def read_parquet_documents(spark: SparkSession, path: str, source: str, text: str = "text", id: str | None = None, title: str | None = None) -> DataFrame:
    """Parquet documents as ``(id, source, title, text)``; without an id column rows are numbered over all files by name."""
    df = spark.read.parquet(path)
    if text not in df.columns:
        raise ValueError(f"no column {text}")
    if not id:
        cols = [F.col(text), *([F.col(title)] if title else [])]
        df = _in_file_order(df.select(*cols, "_metadata", F.col("_metadata.file_path").alias("_file")))
    key = (F.col(id) if id else F.col("_row")).cast("string")
    name = F.coalesce(F.col(title), F.lit("")) if title else F.lit(None).cast("string")
    return df.select(key.alias("id"), F.lit(source).alias("source"), name.alias("title"), T.not_null(F.col(text)).alias("text"))


def read_text_documents(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One document a line, numbered over all files by name; blank lines are counted, but are no documents."""
    named = _in_file_order(spark.read.text(path).select("value", "_metadata", F.col("_metadata.file_path").alias("_file")))
    lines = named.where(~T.is_blank(F.col("value")))
    return lines.select(F.col("_row").cast("string").alias("id"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("title"), F.col("value").alias("text"))


def recover_documents(texts: DataFrame, stem: str = "stem", text: str = "text", lines_per_doc: int = 50) -> DataFrame:
    """``(id, stem, text)``: the paragraphs of whole files, or of a file of one paragraph its lines by fifties.

    Paragraphs are parted by empty lines.  Ids are the stem and a number that runs on over all files."""
    paragraphs = F.filter(F.transform(F.split(F.col(text), "\n\n", -1), T.strip), lambda p: p != "")
    own = F.filter(F.transform(T.lines(F.col(text)), T.strip), lambda x: x != "")

    def chunks(ls):
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(ls) - 1), F.lit(lines_per_doc))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(ls, i + 1, F.lit(lines_per_doc)), "\n"))
        return F.when(F.size(ls) > 0, cut).otherwise(F.array().cast("array<string>"))

    docs = T.let(paragraphs, lambda ps: F.when(F.size(ps) >= 2, ps).otherwise(T.let(own, chunks)))
    # Documents are numbered over all files in order of their stems.
    from ..operators.packing import with_offsets

    found = with_offsets(texts.select(F.lit("").alias("_all"), stem, docs.alias("_docs")), [stem], "_all", F.size("_docs"))
    return found.select(stem, "start", F.posexplode("_docs").alias("_i", "text")).select(F.concat_ws("-", stem, F.col("start") + F.col("_i")).alias("id"), stem, "text")


def read_recovered(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Plain-text files as documents; bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.regexp_replace(F.col("content").cast("string"), "�", "").alias("text"))
    return recover_documents(files).select("id", F.lit(source).alias("source"), F.lit(None).cast("string").alias("title"), "text")


def require_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")
    return df


def read_manual_pairs(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines pairs, both parts stripped; a missing file reads as none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], PAIR)
    return spark.read.schema(PAIR).json(path).select(*[T.strip(T.not_null(F.col(c))).alias(c) for c in ("instruction", "response")])


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``tweet,label`` with a header; blank tweets are dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(TWEET).csv(path)
    return clean_tweets(df)


def clean_tweets(df: DataFrame, tweet: str = "tweet") -> DataFrame:
    return df.withColumn(tweet, T.strip(T.not_null(F.col(tweet)))).where(F.col(tweet) != "")


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stripped lines that are not blank; ``limit`` counts all lines, in order."""
    df = spark.read.text(path)
    if limit is not None:
        df = _in_file_order(df.select("value", "_metadata", F.col("_metadata.file_path").alias("_file"))).where(F.col("_row") < limit)
    return df.select(T.strip(F.col("value")).alias("line")).where("line <> ''")


def isolated(sources: dict[str, Callable[[], DataFrame]], act: Callable[[str, DataFrame], None] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each source's frame, and the error of each that fails; one failure doesn't stop the others.

    ``act`` is what is done with a source, such as writing it: what fails only when data are read is caught there."""
    good: dict[str, DataFrame] = {}
    bad: dict[str, str] = {}
    for name, make in sources.items():
        try:
            df = make()
            df.schema  # noqa: B018 - resolves the plan
            if act is not None:
                act(name, df)
            good[name] = df
        except Exception as e:  # a source's own failure, whatever it is
            bad[name] = str(e).split("\n")[0]
    return good, bad
