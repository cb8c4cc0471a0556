"""Token streams: ids per document, offsets within a split, fixed blocks, and a binary sink."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .dedup import cut

MOST_IDS = 65_536
END_OF_TEXT = "<|endoftext|>"


def word_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all documents."""
    return df.select(F.explode(T.words(T.not_null(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def encode_words(df: DataFrame, vocabulary: list[str], text: str = "text", unknown: int = 0, end: int | None = 1, first: int = 2) -> DataFrame:
    """``df`` with ``ids``: words as places in a bounded vocabulary plus ``first``, closed by ``end``."""
    if len(vocabulary) + first > MOST_IDS:
        raise ValueError(f"{len(vocabulary) + first} ids do not fit 16 bits")
    lookup = {w: i + first for i, w in enumerate(vocabulary)}

    @F.pandas_udf("array<int>")
    def ids(words):
        tail = [] if end is None else [end]
        return words.map(lambda ws: [lookup.get(w, unknown) for w in ws] + tail)

    return df.withColumn("ids", ids(T.words(T.not_null(F.col(text)))))


def encode_with(df: DataFrame, make_encoder, text: str = "text", end: int | None = None, escape: bool = False) -> DataFrame:
    """``df`` with ``ids`` by an encoder that ``make_encoder()`` loads once a worker.

    With ``escape`` the end-of-text mark inside a document is broken up, so that it cannot end it."""
    loaded = {}

    @F.pandas_udf("array<int>")
    def ids(s):
        encode = loaded.get("e") or loaded.setdefault("e", make_encoder())
        tail = [] if end is None else [end]
        return s.map(lambda x: [int(i) for i in encode((x or "").replace(END_OF_TEXT, "<| endoftext |>") if escape else x or "")] + tail)

    return df.withColumn("ids", ids(F.col(text)))


def with_offsets(df: DataFrame, order: list[str], split: str = "split", length: Column | None = None) -> DataFrame:
    """``df`` with ``start`` and ``end`` of each row within its split's stream.

    Rows are range-partitioned along the order and written once, with the number of their
    partition, to the shared folder: what range a partition holds is settled there.  Sums run
    within the sorted partitions and over the partitions' totals, so no task holds a split and
    rows move once.  A length that is null counts as 0."""
    length = F.size("ids").cast("bigint") if length is None else length.cast("bigint")
    ranged = df.withColumn("_len", F.coalesce(length, F.lit(0).cast("bigint"))).repartitionByRange(F.col(split), *[F.col(c) for c in order]).sortWithinPartitions(split, *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy(split, "_part").agg(F.sum("_len").alias("_sum"))
    over = Window.partitionBy(split).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(split).alias("_split"), F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    at_split, at_len = placed.columns.index(split), placed.columns.index("_len")

    def run(batches):
        import numpy as np

        now: dict = {}
        for batch in batches:
            lengths = batch.column(at_len).to_numpy()
            within = np.zeros(len(lengths), dtype=np.int64)
            names = batch.column(at_split).dictionary_encode()
            for i, name in enumerate(names.dictionary.to_pylist() + [None]):
                own = names.indices.is_null().to_numpy(zero_copy_only=False) if name is None else names.indices.fill_null(-1).to_numpy() == i
                if own.any():
                    sums = now.get(name, 0) + np.cumsum(lengths[own])
                    within[own] = sums - lengths[own]
                    now[name] = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], names=[*batch.schema.names, "_within"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    summed = placed.mapInArrow(run, f"{fields}, _within bigint")
    # A row a partition and split: as many as there are partitions, and bounded so.
    joined = summed.join(F.broadcast(before), F.col(split).eqNullSafe(F.col("_split")) & (F.col("_part") == F.col("_of")))
    start = F.col("_before") + F.col("_within")
    return joined.withColumns({"start": start, "end": start + F.col("_len")}).drop("_len", "_part", "_of", "_split", "_before", "_within")


def _pieces(streams: DataFrame, size: int, split: str) -> DataFrame:
    """``(split, block, pos, piece)``: each document's ids cut at blocks of ``size``, a block reaching one token into the next."""
    n = F.size("ids")
    s = streams.where(n > 0).select(split, "start", "ids", (F.col("start") + n).alias("_end"))
    first = F.greatest(F.lit(0), F.floor((F.col("start") - 1) / size)).cast("bigint")
    s = s.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("_end") - 1) / size).cast("bigint"))))
    lo, hi = F.greatest(F.col("start"), F.col("block") * size), F.least(F.col("_end"), (F.col("block") + 1) * size + 1)
    return s.select(split, "block", lo.alias("pos"), F.slice("ids", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


def blocks(streams: DataFrame, size: int, split: str = "split") -> DataFrame:
    """``(split, block, x, y)``: the stream's whole blocks, y one token ahead of x; the tail is left out.

    ``streams`` holds ``ids`` and ``start``; a stream of n tokens has (n - 1) div size blocks.
    What moves is a piece a document and block, not a row a token."""
    grouped = _pieces(streams, size, split).groupBy(split, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("_p"))
    full = grouped.withColumn("_ids", F.flatten("_p.piece")).where(F.size("_ids") == size + 1)
    return full.select(split, "block", F.slice("_ids", 1, size).alias("x"), F.slice("_ids", 2, size).alias("y"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("docs"), F.sum(F.size("ids")).cast("bigint").alias("tokens"))


def corpus_meta(df: DataFrame, vocabulary_size: int, end_id: int, upweighted: dict[str, int], split: str = "split") -> str:
    """The description of a token corpus as JSON; splits are few."""
    got = {r[0]: {"docs": r[1], "tokens": r[2]} for r in split_counts(df, split).collect()}
    return json.dumps({"vocab_size": vocabulary_size, "dtype": "uint16", "eos_token_id": end_id, "upweight": upweighted, "splits": dict(sorted(got.items()))}, ensure_ascii=False, sort_keys=True)


def write_flat(streams: DataFrame, folder: str, split: str) -> tuple[int, int]:
    """Write one split as ``{split}.bin`` (unsigned 16-bit ids) and ``{split}.idx`` (64-bit starts and the total).

    Executors write a part each, a range of the stream, under a name of the attempt that wrote it,
    into the folder, which all share; the driver joins the files of the attempts that counted.
    Returns documents and tokens."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    job = f".{split}-{uuid.uuid4().hex}"
    rows = streams.where(F.col("split") == split).select("start", "ids").repartitionByRange("start").sortWithinPartitions("start")

    def run(batches):
        import numpy as np

        name, docs, total, first = f"{folder}/{job}-{uuid.uuid4().hex}", 0, 0, None
        with open(f"{name}.bin", "wb") as data, open(f"{name}.idx", "wb") as index:
            for batch in batches:
                starts, ids = batch.column(0), batch.column(1)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= MOST_IDS):
                    raise ValueError("an id does not fit 16 bits")
                flat.astype("<u2").tofile(data)
                starts.to_numpy().astype("<i8").tofile(index)
                first = starts[0].as_py() if first is None and len(starts) else first
                docs, total = docs + len(starts), total + len(flat)
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "docs": [docs], "tokens": [total]}, schema=pa.schema([("name", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    try:
        parts = sorted((r for r in rows.mapInArrow(run, "name string, first bigint, docs bigint, tokens bigint").collect() if r["docs"]), key=lambda r: r["first"])
        total = sum(r["tokens"] for r in parts)
        for kind in ("bin", "idx"):
            with open(f"{folder}/{split}.{kind}", "wb") as out:
                for r in parts:
                    with open(f"{r['name']}.{kind}", "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 24)
                if kind == "idx":
                    out.write(total.to_bytes(8, "little"))
    finally:
        for left in Path(folder).glob(f"{job}-*"):
            os.unlink(left)
    return sum(r["docs"] for r in parts), total


def read_flat(folder: str, split: str) -> list[list[int]]:
    """The documents of a small flat split, for checks."""
    import numpy as np

    ids, at = np.fromfile(f"{folder}/{split}.bin", dtype="<u2"), np.fromfile(f"{folder}/{split}.idx", dtype="<i8")
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def random_windows(streams: DataFrame, split: str, n: int, size: int, seed: int = 1) -> DataFrame:
    """``(window, start, x, y)``: ``n`` windows of ``size`` tokens that begin anywhere in a split, y one token ahead of x.

    Starts are drawn by hash from ``[0, tokens - size - 1)``, with repeats; a split too short for
    one has no windows.  Windows meet the documents' pieces by block."""
    spark = streams.sparkSession
    own = streams.where(F.col("split") == split)
    total = own.agg(F.max(F.col("start") + F.size("ids"))).collect()[0][0] or 0
    room = total - size - 1
    if room <= 0:
        return spark.createDataFrame([], "window bigint, start bigint, x array<int>, y array<int>")
    drawn = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("bigint"), F.lit(room))
    windows = spark.range(n).select(F.col("id").alias("window"), drawn.alias("_from"))
    met = windows.withColumn("block", F.explode(F.array(F.floor(F.col("_from") / size).cast("bigint"), F.floor(F.col("_from") / size).cast("bigint") + 1)))
    pieces = _pieces(own, size, "split").drop("split")
    # The token a block reaches into the next one stands there as well.
    inside = F.least(F.col("pos") + F.size("piece"), (F.col("block") + 1) * size)
    lo, hi = F.greatest("pos", "_from"), F.least(inside, F.col("_from") + size + 1)
    cut_out = met.join(pieces, "block").where(lo < hi).select("window", "_from", lo.alias("pos"), F.slice("piece", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    ids = cut_out.groupBy("window", "_from").agg(F.flatten(F.array_sort(F.collect_list(F.struct("pos", "piece"))).getField("piece")).alias("_ids"))
    return ids.select("window", F.col("_from").alias("start"), F.slice("_ids", 1, size).alias("x"), F.slice("_ids", 2, size).alias("y"))
