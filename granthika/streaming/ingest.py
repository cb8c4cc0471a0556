"""Incremental ingest: files are read once, resumed from a checkpoint, and written atomically."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..sources.shards import DOCUMENT


def document_stream(spark: SparkSession, path: str, schema: S.StructType = DOCUMENT, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Run what is new through ``transform`` into Parquet, then stop; a rerun goes on after the last commit."""
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).option("compression", "zstd").trigger(availableNow=True).start()
    query.awaitTermination()


def streaming_exact_dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """First-arrived texts only.  The state grows with the distinct texts, as keep-first demands."""
    return stream.withColumn("_key", F.md5(T.nfc(T.not_null(F.col(text))))).dropDuplicates(["_key"]).drop("_key")


def pending(df: DataFrame, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a manifest of done keys does not list."""
    return df.join(manifest.select(*key), key, "left_anti")
