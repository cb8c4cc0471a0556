"""Visually identical text with different characters (problem 9).

Look-alike classes are the transitive closure (union-find) of equalities over code points and
strings; each class is represented by its member most frequent in the corpus; texts are
rewritten leftmost-longest by a multi-pattern automaton.  Two texts compare equal after the
rewriting when they read the same character for character.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import Rewriter, equalities, rewriting
from .common import by_batch, cut

#: Members of a class that meet the whole class in one task.
BLOCK = 2_000


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(piece string, n bigint)``: how often each member of a look-alike class occurs, over all rows.

    Null texts count nothing.  The result has at most one row per member of a class, a number
    fixed by the character database, not by the corpus."""
    members = {s for pair in equalities() for s in pair if s}
    single = "".join(sorted(s for s in members if len(s) == 1))
    longer = [s for s in members if len(s) > 1]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        keep = np.array(sorted(map(ord, single)), dtype=np.uint32)
        joined = "\n".join(x for x in batch.column(0).to_pylist() if x)
        codes, n = np.unique(np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), return_counts=True)
        got = Counter({chr(c): int(k) for c, k in zip(codes, n) if keep[min(np.searchsorted(keep, c), len(keep) - 1)] == c})
        for s in longer:
            if k := joined.count(s):
                got[s] = k
        return pa.RecordBatch.from_pydict({"piece": list(got), "n": list(got.values())}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    return by_batch(df.select(text), count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def learn_rewriting(df: DataFrame, text: str = "text") -> dict[str, str]:
    """Member to representative, by the frequencies in ``df``."""
    return rewriting({r["piece"]: r["n"] for r in character_counts(df, text).collect()})


def with_canonical(df: DataFrame, mapping: dict[str, str], text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with ``out``, the one form of ``text``; null stays null, other columns stay."""
    made = {}

    @F.pandas_udf("string")
    def canonical(s):
        r = made.get("r") or made.setdefault("r", Rewriter(mapping))
        return s.map(r, na_action="ignore")

    return df.withColumn(out, canonical(F.col(text)))


def look_alike_keys(df: DataFrame, mapping: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, same binary, raw binary)``: 128-bit hashes of the canonical and of the raw text.

    Null and blank texts give no row."""
    made = {}
    schema = pa.schema([("key", pa.int64()), ("same", pa.binary()), ("raw", pa.binary())])

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = made.get("r") or made.setdefault("r", Rewriter(mapping))
        ids, same, raw = [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t and not t.isspace():
                ids.append(i)
                raw.append(xxhash.xxh3_128_digest(t.encode()))
                c = r(t)
                same.append(raw[-1] if c == t else xxhash.xxh3_128_digest(c.encode()))
        return pa.RecordBatch.from_pydict({"key": ids, "same": same, "raw": raw}, schema=schema)

    return by_batch(df.select(F.col(key).cast("bigint"), text), hashes, "key bigint, same binary, raw binary")


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", mapping: dict[str, str] | None = None) -> DataFrame:
    """``(doc_id, class_id, forms, links)``: a row per document with text, its class of equal looking texts, how many different strings the class has, and with how many documents of another string it shares it.

    ``class_id`` is the class's least document.  Strings are merged map-side before they are
    counted, so a class that is a third of all rows costs one row a string."""
    mapping = learn_rewriting(df, text) if mapping is None else mapping
    keys = cut(look_alike_keys(df, mapping, key, text))
    forms = keys.groupBy("same", "raw").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    classes = forms.groupBy("same").agg(F.min("least").alias("class_id"), F.count("*").alias("forms"), F.sum("n").alias("docs"))
    sized = forms.join(classes, "same").select("same", "raw", "class_id", "forms", (F.col("docs") - F.col("n")).alias("links"))
    return keys.join(sized, ["same", "raw"]).select(F.col("key").alias("doc_id"), "class_id", "forms", "links")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", mapping: dict[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: texts that read the same but are different strings.

    Equal strings give no pair.  Only classes with two or more different strings are paired, and
    only across those strings, so a hot group of exact copies costs nothing by itself.  Members
    of a class are met in blocks of about ``block`` against all, so no class makes one task."""
    mapping = learn_rewriting(df, text) if mapping is None else mapping
    keys = cut(look_alike_keys(df, mapping, key, text))
    forms = keys.groupBy("same", "raw").agg(F.count("*").alias("n"))
    several = forms.groupBy("same").agg(F.count("*").alias("forms"), F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("blocks")).where("forms > 1").select("same", "blocks")
    rows = keys.join(several, "same")
    a = rows.select("same", F.col("raw").alias("raw_a"), F.col("key").alias("doc_id_a"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    b = rows.select("same", F.col("raw").alias("raw_b"), F.col("key").alias("doc_id_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = a.join(b, ["same", "block"]).where("raw_a <> raw_b and doc_id_a < doc_id_b")
    return pairs.select("doc_id_a", "doc_id_b").distinct()
