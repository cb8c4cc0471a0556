"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FALLBACK_CHECKPOINT = "/tmp/granthika-checkpoint"


def docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from here on.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master local, as in tests, a local one is set.  On a cluster it must be set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or FALLBACK_CHECKPOINT)
    return df.checkpoint()


def rows_bound(df: DataFrame, most: int) -> list | None:
    """All rows if there are at most ``most``, else None; never more than ``most + 1`` reach the driver."""
    got = df.limit(most + 1).collect()
    return got if len(got) <= most else None


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, which may give several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b)
            if isinstance(got, pa.RecordBatch):
                yield got
            elif got is not None:
                yield from got

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, size: int = 400_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of some ``size`` bytes of a text column, so that what is made of a part stays small."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def usable(text: str | None) -> bool:
    return bool(text) and not text.isspace()
