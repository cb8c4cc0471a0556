"""Exact and near de-duplication, keeping the first document in a total order.

The order is explicit: ``(source, key)`` by default.  Near duplicates are resolved greedily as
a sequential pass would: a document is dropped if it is near a kept earlier one.  That is the
lexicographically first maximal independent set of the similarity graph, found in rounds.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

LOCAL_CHECKPOINT = "/tmp/granthika-checkpoint"
#: Members from which a bucket of MinHash bands is big.
BIG_BUCKET = 200
#: Rounds of decisions before the pairs left may go to one task, and how many they may be then (17 bytes each).
ROUNDS, REST = 8, 1_000_000
#: The name of a document's place in order while near copies are dropped.
RANK = "_granthika_rank"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there.

    The folder is ``spark.checkpoint.dir``; a local one serves where that is unset and the master local, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or LOCAL_CHECKPOINT


def _firsts(df: DataFrame, order: list[str], text: str) -> tuple[DataFrame, Column]:
    """The places of the rows that come first with their NFC text, and the condition, safe for nulls, that joins them."""
    t = T.nfc(T.not_null(F.col(text)))
    place = F.struct(*[F.col(c) for c in order])
    hashed = df.select(*order, F.xxhash64(t).alias("_h"), F.md5(t).alias("_m"))
    firsts = hashed.groupBy("_h", "_m").agg(F.min(place).alias("_p")).select(*[F.col(f"_p.{c}").alias(f"_first_{i}") for i, c in enumerate(order)])
    return firsts, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_first_{i}")) for i, c in enumerate(order)])


def with_copies_marked(df: DataFrame, order: list[str], text: str = "text", out: str = "first") -> DataFrame:
    """``df`` with ``out``: whether the row is the first in order with its NFC text; a column of that name is replaced.

    The text travels as two hashes, and rows of one text are merged map-side, so a text that
    is a third of all rows makes no hot task.  Null text counts as empty."""
    df = df.drop(out)
    firsts, same = _firsts(df, order, text)
    marked = df.join(firsts.withColumn(out, F.lit(True)), same, "left").withColumn(out, F.coalesce(out, F.lit(False)))
    return marked.drop(*[f"_first_{i}" for i in range(len(order))])


def exact_dedup(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The rows that come first with their text; ``order`` must be a key; nulls in it come first.  All columns stay."""
    firsts, same = _firsts(df, order, text)
    return df.join(firsts, same, "left_semi")


def band_plan(threshold: float, permutations: int = 128) -> tuple[int, int]:
    """(bands, rows) with the least sum of wrongly missed and wrongly met similarity, weighed alike."""

    def area(f, a: float, b: float) -> float:
        n = 400
        return sum(f(a + (b - a) * (i + 0.5) / n) for i in range(n)) * (b - a) / n

    best = (math.inf, 1, 1)
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            met = area(lambda s: 1 - (1 - s**r) ** b, 0.0, threshold)
            missed = area(lambda s: (1 - s**r) ** b, threshold, 1.0)
            best = min(best, (0.5 * met + 0.5 * missed, b, r))
    return best[1], best[2]


def sure_plan(threshold: float, permutations: int = 128, least: float = 0.99) -> tuple[int, int]:
    """(bands, rows): the longest bands in which pairs at the threshold still meet with a chance of ``least``; for pairs that are verified."""
    rows = next((r for r in range(permutations, 0, -1) if 1 - (1 - threshold**r) ** (permutations // r) >= least), 1)
    return permutations // rows, rows


def minhash_bands(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, permutations: int = 128, n: int = 5, seed: int = 1, plan: tuple[int, int] | None = None) -> DataFrame:
    """``(key, band, hash)``: hashes of the bands of a document's MinHash signature over word shingles; by ``band_plan`` if no plan is given."""
    import numpy as np

    bands, rows = plan or band_plan(threshold, permutations)
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 61, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 61, bands * rows, dtype=np.uint64)

    @F.pandas_udf("array<bigint>")
    def signature(hashes):
        import numpy as np
        import pandas as pd

        out = []
        for h in hashes:
            x = np.asarray(h).astype(np.int64).view(np.uint64)
            low = np.full(len(a), np.uint64((1 << 64) - 1))
            for i in range(0, len(x), 4096):  # very long documents pass in pieces
                v = x[i : i + 4096, None] * a[None, :] + b[None, :]
                low = np.minimum(low, (v ^ (v >> np.uint64(32))).min(0))
            mixed = (low * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, rows)
            out.append(np.bitwise_xor.reduce(mixed * np.arange(1, 2 * rows, 2, dtype=np.uint64), axis=1).view(np.int64))
        return pd.Series(out)

    hashed = df.select(key, F.transform(T.shingles(T.not_null(F.col(text)), n), lambda s: F.xxhash64(s)).alias("_s"))
    return hashed.select(key, F.posexplode(signature("_s")).alias("band", "hash"))


def candidate_pairs(bands: DataFrame, key: str = "doc_id", block: int = BIG_BUCKET) -> DataFrame:
    """``(a, b)``, a < b, of all members of a bucket; big buckets are joined in blocks of about ``block`` members against all, so that none makes one task."""
    sizes = bands.groupBy("band", "hash").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    sized = bands.join(sizes, ["band", "hash"])
    l = sized.select("band", "hash", F.col(key).alias("a"), F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("block"))
    r = sized.select("band", "hash", F.col(key).alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return l.join(r, ["band", "hash", "block"]).where("a < b").select("a", "b").distinct()


def verified_pairs(bands: DataFrame, df: DataFrame, key: str, text: str, threshold: float, n: int, big: int = BIG_BUCKET) -> DataFrame:
    """``(a, b, similarity)`` of the pairs at the threshold that share a bucket.

    Members of buckets of more than ``big`` go through the exact prefix filter, not through all their pairs."""
    bands = cut(bands)
    sizes = bands.groupBy("band", "hash").agg(F.count("*").alias("n"))
    small = bands.join(sizes.where(F.col("n") <= big), ["band", "hash"]).drop("n")
    hot = cut(bands.join(sizes.where(F.col("n") > big), ["band", "hash"]).select(key).distinct())
    sets = df.select(F.col(key).alias("k"), F.transform(T.shingles(T.not_null(F.col(text)), n), lambda s: F.xxhash64(s)).alias("s"))
    pairs = _verified(candidate_pairs(small, key, big), sets, threshold)
    if hot.isEmpty():
        return pairs
    return pairs.unionByName(similar_pairs(df.join(hot, key, "left_semi"), key, text, threshold, n)).distinct()


def _sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``(k, s, id)``: the hashed shingles of a text and a 128-bit hash of the whole set."""
    hashed = df.select(F.col(key).alias("k"), F.array_sort(F.transform(T.shingles(T.not_null(F.col(text)), n), lambda s: F.xxhash64(s))).alias("s")).where(F.size("s") > 0)
    return hashed.withColumn("id", F.struct(F.xxhash64("s").alias("x"), F.xxhash64("s", F.lit(1)).alias("y")))


def _pairs_of_sets(sets: DataFrame, threshold: float, block: int = BIG_BUCKET) -> DataFrame:
    """``(a, b, similarity)``, a < b, of all different sets ``(k, s)`` with a Jaccard similarity of ``threshold`` or more."""
    freq = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    ranked = sets.select("k", F.size("s").alias("size"), F.explode("s").alias("h")).join(freq, "h")
    w = Window.partitionBy("k").orderBy("n", "h")
    prefix = ranked.withColumn("i", F.row_number().over(w)).where(F.col("i") <= F.col("size") - F.ceil(F.col("size") * threshold - F.lit(1e-9)) + 1).where("n > 1").select("h", "k", "size")
    # A shingle that many prefixes hold is met in blocks, so none makes one task.
    counts = prefix.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    met = prefix.join(counts, "h")
    l = met.select("h", F.col("k").alias("a"), F.col("size").alias("sa"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    r = met.select("h", F.col("k").alias("b"), F.col("size").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = l.join(r, ["h", "block"]).where((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - 1e-9)).select("a", "b").distinct()
    return _verified(pairs, sets, threshold)


def similar_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, n: int = 5) -> DataFrame:
    """``(a, b, similarity)``, a < b, of all documents with shingle Jaccard of ``threshold`` or more: exact, by prefix filtering.

    Documents' shingles are ordered by rarity; two similar documents share one among the rarest
    ``size - ceil(threshold * size) + 1`` of both, so only those are joined.  Texts of equal
    shingles are compared once, for all of them, and listed for each.  Equal texts should have
    been removed before: copies are all similar to each other."""
    sets = cut(_sets(df, key, text, n))
    least = sets.groupBy("id").agg(F.min("k").alias("rep"), F.count("*").alias("n"))
    reps = sets.join(least, (F.col("k") == F.col("rep")) & (sets["id"] == least["id"])).select("k", "s")
    between = _pairs_of_sets(reps, threshold)
    several = least.where("n > 1").select("id")
    if several.isEmpty():
        return between
    members = sets.join(least, "id").select("rep", "k")
    spread = between.join(members.select(F.col("rep").alias("a"), F.col("k").alias("ka")), "a").join(members.select(F.col("rep").alias("b"), F.col("k").alias("kb")), "b")
    same = members.join(members.select("rep", F.col("k").alias("kb")), "rep").where("k < kb").select(F.col("k").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("similarity"))
    return spread.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "similarity").unionByName(same)


def pairs_of_firsts(ranked: DataFrame, rank: str, text: str, threshold: float, n: int) -> DataFrame:
    """``(a, b)`` of ranks, enough for a greedy pass: of texts with equal shingles only the first is compared, the others are linked to it.

    What drops the first drops them too, and if it is kept it drops them itself."""
    sets = cut(_sets(ranked, rank, text, n))
    least = sets.groupBy("id").agg(F.min("k").alias("rep"))
    linked = sets.select("k", "id").join(least, "id").where("k > rep")
    reps = sets.join(linked.select("k"), "k", "left_anti").select("k", "s")
    chained = linked.select(F.col("rep").alias("a"), F.col("k").alias("b"))
    # A follower stands beside its first's earlier neighbours as well, so that it goes when they drop the first.
    pairs = cut(_pairs_of_sets(reps, threshold).select("a", "b"))
    followed = pairs.join(chained.select(F.col("a").alias("rep"), F.col("b").alias("k")), pairs["b"] == F.col("rep")).select(pairs["a"], F.col("k").alias("b"))
    return pairs.unionByName(chained).unionByName(followed)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    scored = both.withColumn("similarity", common / (F.size("x") + F.size("y") - common))
    return scored.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity")


def keep_first(nodes: DataFrame, pairs: DataFrame, rank: str = "rank", rounds: int = ROUNDS, rest: int = REST) -> DataFrame:
    """``(rank)`` of the documents a greedy pass in rank order keeps, given near pairs ``(a, b)`` of ranks, a < b.

    Each round keeps what has no undecided or kept earlier neighbour and drops the later
    neighbours of what is kept.  The number of rounds is the longest chain of decisions; after
    ``rounds`` of them, pairs between undecided documents are decided in order by one task if they
    are ``rest`` or fewer, and by further rounds until they are."""
    edges = cut(pairs.select("a", "b").where("a < b").distinct())
    state = cut(edges.select(F.col("b").alias("v")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    roots = edges.select(F.col("a").alias("v")).distinct().join(state, "v", "left_anti").withColumn("kept", F.lit(True))
    state = cut(state.unionByName(roots))
    done = 0
    while not state.where("kept is null").isEmpty():
        if done >= rounds:
            open_ = state.where("kept is null").select("v")
            left = edges.join(open_.withColumnRenamed("v", "b"), "b").join(state.select(F.col("v").alias("a"), F.col("kept").alias("ka")), "a").where("ka is null or ka").select("a", "b", "ka")
            if left.limit(rest + 1).count() <= rest:
                decided = left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_in_order, "v bigint, kept boolean")
                state = cut(state.where("kept is not null").unionByName(decided))
                break
        seen = edges.join(state.select(F.col("v").alias("a"), F.col("kept").alias("ka")), "a").groupBy("b").agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("near_kept"), F.bool_and(F.col("ka").eqNullSafe(False)).alias("all_dropped"))
        state = cut(state.join(seen.withColumnRenamed("b", "v"), "v", "left").select("v", F.coalesce("kept", F.when(F.col("near_kept"), False).when(F.col("all_dropped"), True)).alias("kept")))
        done += 1
    return nodes.select(rank).join(state.where("not kept").select(F.col("v").alias(rank)), rank, "left_anti")


def _in_order(pairs):
    """The greedy pass itself over the pairs left."""
    import pandas as pd

    kept = {int(a): True for a, k in zip(pairs["a"], pairs["ka"]) if k is not None and k == True}  # noqa: E712 - may be numpy's
    before: dict[int, list[int]] = {}
    for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
        before.setdefault(b, []).append(a)
    for b in sorted(before):
        kept[b] = not any(kept.get(a, False) for a in before[b])
    return pd.DataFrame({"v": list(before), "kept": [kept[b] for b in before]})


def dense_rank_of(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """``df`` with ``out``, its place in the order from 0, without a window over all rows.

    Range partitions are counted, and their counts added up before each."""
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(before, "_part").withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def fuzzy_dedup(df: DataFrame, order: list[str], text: str = "text", threshold: float = 0.8, n: int = 5, how: str = "exact", permutations: int = 128, cap: int | None = None) -> DataFrame:
    """The documents a greedy keep-first pass keeps.

    ``how``: ``exact`` finds every pair at the threshold; ``lsh`` those that MinHash bands meet,
    verified; ``lsh_only`` without verifying.  With ``cap``, documents after the cap-th kept one
    are kept as they are."""
    ranked = dense_rank_of(df, order, RANK)
    if how == "exact":
        pairs = pairs_of_firsts(ranked, RANK, text, threshold, n)
    else:
        bands = minhash_bands(ranked, RANK, text, threshold, permutations, n, plan=sure_plan(threshold, permutations) if how == "lsh" else None)
        pairs = verified_pairs(bands, ranked, RANK, text, threshold, n) if how == "lsh" else candidate_pairs(cut(bands), RANK)
    kept = keep_first(ranked, pairs, RANK)
    if cap is not None:
        last = kept.orderBy(RANK).limit(cap).agg(F.max(RANK), F.count("*")).collect()[0]
        if last[1] == cap:
            kept = kept.where(F.col(RANK) <= (last[0] if cap else -1)).unionByName(ranked.select(RANK).where(F.col(RANK) > (last[0] if cap else -1)))
    return ranked.join(kept, RANK, "left_semi").drop(RANK)


def dedup_counters(df: DataFrame, exact: DataFrame, final: DataFrame, by: str = "source") -> DataFrame:
    """Per source and in total (``total``): documents in, exact copies dropped, left, near copies dropped, final."""
    counts = [x.groupBy(by).agg(F.count("*").alias(c)) for x, c in ((df, "docs_input"), (exact, "after_exact"), (final, "final"))]
    joined = counts[0]
    for c in counts[1:]:
        joined = joined.join(c.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    joined = joined.fillna(0, ["after_exact", "final"]).withColumn("total", F.lit(False))
    # A row a source: few.
    total = joined.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs_input", "after_exact", "final")]).select(F.lit(None).cast("string").alias(by), "docs_input", "after_exact", "final", F.lit(True).alias("total"))
    both = joined.select(by, "docs_input", "after_exact", "final", "total").unionByName(total)
    return both.select(by, "total", "docs_input", (F.col("docs_input") - F.col("after_exact")).alias("dropped_exact"), "after_exact", (F.col("after_exact") - F.col("final")).alias("dropped_fuzzy"), "final")
