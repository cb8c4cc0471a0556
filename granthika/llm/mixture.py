"""Mixing sources to target weights (problem 8).

The mixture is a sequence of slots of equal tokens.  Golden-ratio points, mapped through the
cumulative weights, give every slot its source, so that any stretch of the sequence holds each
source close to its share.  Slots are ranked per source; a source's documents, in shuffled
order and repeated as often as allowed, make a stream that is cut into blocks of exactly a slot's
tokens, and blocks are joined to the slots by rank.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_batch, cut, rows_bound

#: The golden ratio's fraction in units of 2**-64, odd, so that products run through all of them.
GOLDEN = 0x9E3779B97F4A7C15
#: Tokens of a slot.
SLOT_TOKENS = 256
#: Parts a source's documents are ordered in, and slots ranked together.
BUCKETS, STRETCH = 512, 1 << 20
#: Sources that the targets may hold.
MOST_SOURCES = 100_000
COLUMNS = "slot bigint, source string, doc_id bigint, copy int, first_token bigint, tokens bigint"


def _prefix(df: DataFrame, parts: list[str], bucket: str, amount: str) -> DataFrame:
    """``df`` with ``before``: the amount of all earlier buckets of its part (buckets are few)."""
    w = Window.partitionBy(*parts).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(amount).over(w), F.lit(0)))


def documents_in_order(docs: DataFrame, seed: int) -> DataFrame:
    """``(source, doc_id, tokens, start)``: a seeded shuffle per source and the tokens before each document.

    Prefix sums are taken within hash buckets and over the buckets' totals, so no task holds a
    whole source."""
    shuffled = docs.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_bucket", F.pmod(F.shiftright("_h", 8), F.lit(BUCKETS)))
    totals = _prefix(shuffled.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum")), ["source"], "_bucket", "_sum")
    w = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = shuffled.withColumn("_within", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return within.join(totals.select("source", "_bucket", "before"), ["source", "_bucket"]).select("source", "doc_id", "tokens", (F.col("before") + F.col("_within")).alias("start"))


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int]], total_tokens: int | None = None) -> tuple[int, list[tuple[str, float, int, int]]]:
    """(tokens of the mixture, [(source, weight, max_repeats, tokens at hand)]).

    Without ``total_tokens`` the mixture is the largest in which every source that has documents
    reaches its share.  A source without documents, or with share or repeats of none, stays out
    and the others keep their proportions."""
    have = dict(totals)
    used = [(s, w, r, have[s]) for s, w, r in targets if s is not None and (w or 0) > 0 and (r or 0) > 0 and have.get(s, 0) > 0]
    weight = sum(w for _, w, _, _ in used)
    if not used:
        return 0, []
    most = min(n * r / (w / weight) for _, w, r, n in used)
    size = int(most if total_tokens is None else min(total_tokens, most))
    return size, [(s, w / weight, r, n) for s, w, r, n in used]


def source_of_slots(ids, edges, seed: int):
    """The place of the source of each slot: its golden-ratio point, in exact integers, looked up among the cumulative weights."""
    import numpy as np

    with np.errstate(over="ignore"):
        points = ids.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
    return np.searchsorted(edges, points, side="right")


def slot_counts(spark: SparkSession, weights: list[float], slots: int, seed: int) -> list[int]:
    """How many of the first ``slots`` slots each source has."""
    edges = _edges(weights)
    schema = pa.schema([("place", pa.int32()), ("n", pa.int64())])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        places, n = np.unique(source_of_slots(batch.column(0).to_numpy(), edges, seed), return_counts=True)
        return pa.RecordBatch.from_pydict({"place": places.astype(np.int32), "n": n}, schema=schema)

    got = {r[0]: r[1] for r in by_batch(spark.range(slots), count, "place int, n bigint").groupBy("place").agg(F.sum("n")).collect()}
    return [got.get(i, 0) for i in range(len(weights))]


def _edges(weights: list[float]):
    """Upper ends of all sources' intervals but the last, in units of 2**-64."""
    import numpy as np

    sums = np.cumsum(weights)
    return np.array([min(int(x / sums[-1] * 2**64), 2**64 - 1) for x in sums[:-1].tolist()], dtype=np.uint64)


def schedule(spark: SparkSession, used: list[tuple[str, float, int, int]], slots: int, seed: int) -> DataFrame:
    """``(slot, source, rank)``: a source per slot by golden-ratio points, and its rank among the source's slots.

    Points are looked up by binary search in Arrow batches.  Slots are counted within stretches, and ranks add the counts of the stretches before."""
    edges = _edges([w for _, w, _, _ in used])
    schema = pa.schema([("slot", pa.int64()), ("place", pa.int32())])

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0)
        return pa.RecordBatch.from_arrays([ids, pa.array(source_of_slots(ids.to_numpy(), edges, seed).astype("int32"))], schema=schema)

    placed = by_batch(spark.range(slots), place, "slot bigint, place int").withColumn("_stretch", (F.col("slot") / STRETCH).cast("bigint"))
    counts = _prefix(placed.groupBy("place", "_stretch").agg(F.count("*").alias("_n")), ["place"], "_stretch", "_n")
    w = Window.partitionBy("place", "_stretch").orderBy("slot")
    names = F.broadcast(spark.createDataFrame([(i, s) for i, (s, _, _, _) in enumerate(used)], "place int, source string"))
    ranked = placed.withColumn("_r", F.row_number().over(w) - 1).join(F.broadcast(counts.select("place", "_stretch", "before")) if slots <= STRETCH else counts.select("place", "_stretch", "before"), ["place", "_stretch"])
    return ranked.join(names, "place").select("slot", "source", (F.col("before") + F.col("_r")).alias("rank"))


def fitting_slots(spark: SparkSession, used: list[tuple[str, float, int, int]], slots: int, slot_tokens: int, seed: int) -> tuple[int, list[int]]:
    """The most slots, up to ``slots``, that every source can fill, and how many of them each has.

    A source's count strays from its share by a few slots at most, so one or two steps do."""
    while slots > 0:
        counts = slot_counts(spark, [w for _, w, _, _ in used], slots, seed)
        over = [(have * r // slot_tokens) / n for n, (_, _, r, have) in zip(counts, used) if n > have * r // slot_tokens]
        if not over:
            return slots, counts
        slots = min(slots - 1, math.floor(slots * min(over)))
    return 0, [0] * len(used)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, slot_tokens: int = SLOT_TOKENS, seed: int = 1) -> DataFrame:
    """``(slot, source, doc_id, copy, first_token, tokens)``: the mixture, a row per part of a document in a slot.

    Every slot holds exactly ``slot_tokens`` tokens of one source.  ``docs`` holds ``(doc_id,
    source, tokens)``; documents of no tokens are not used.  ``targets`` holds ``(source,
    target_share, max_repeats)``; more than ``MOST_SOURCES`` of them raise an error."""
    spark = docs.sparkSession
    docs = cut(docs.where("tokens > 0 and source is not null and doc_id is not null").select("doc_id", "source", "tokens"))
    wished = rows_bound(targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")), MOST_SOURCES)
    if wished is None:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    wished = [tuple(r) for r in wished]
    names = spark.createDataFrame([(s,) for s, _, _ in wished if s is not None] or [("",)], "source string").distinct()
    totals = [tuple(r) for r in docs.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("tokens")).collect()]
    size, used = plan(totals, wished, total_tokens)
    slots, counts = fitting_slots(spark, used, size // slot_tokens, slot_tokens, seed) if used else (0, [])
    if not slots:
        return spark.createDataFrame([], COLUMNS)
    # Only the copies that slots use are made; the last one ends where the source's slots do.
    needs = [(s, n, have, n * slot_tokens) for n, (s, _, _, have) in zip(counts, used) if n]
    sources = F.broadcast(spark.createDataFrame(needs, "source string, slots bigint, at_hand bigint, needed bigint"))
    ordered = documents_in_order(docs, seed).join(sources, "source")
    copies = F.ceil((F.col("needed") - F.col("start")) / F.col("at_hand")).cast("int")
    uses = ordered.where("start < needed").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    begin = F.col("copy") * F.col("at_hand") + F.col("start")
    spans = uses.select("source", "doc_id", "copy", begin.alias("_from"), F.least(begin + F.col("tokens"), F.col("needed")).alias("_to"))
    first, last = (F.col("_from") / slot_tokens).cast("bigint"), ((F.col("_to") - 1) / slot_tokens).cast("bigint")
    parts = spans.withColumn("rank", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest(F.col("_from"), F.col("rank") * slot_tokens), F.least(F.col("_to"), (F.col("rank") + 1) * slot_tokens)
    cut_parts = parts.select("source", "rank", "doc_id", "copy", (lo - F.col("_from")).alias("first_token"), (hi - lo).alias("tokens"))
    return cut_parts.join(schedule(spark, used, slots, seed), ["source", "rank"]).select("slot", "source", "doc_id", "copy", "first_token", "tokens")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, uses, docs, most_uses, tokens, actual_share)`` of every wished source.

    A use is a copy of a document, whole or in part."""
    per_copy = mixture.groupBy("source", "doc_id", "copy").agg(F.sum("tokens").alias("t"))
    per_doc = per_copy.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    got = cut(per_doc.groupBy("source").agg(F.sum("n").alias("uses"), F.count("*").alias("docs"), F.max("n").alias("most_uses"), F.sum("t").alias("tokens")))
    total = got.agg(F.sum("tokens")).collect()[0][0] or 0
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("uses", "docs", "most_uses", "tokens")}
    joined = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").withColumns(zero)
    return joined.withColumn("actual_share", F.col("tokens") / F.lit(float(max(total, 1))))
