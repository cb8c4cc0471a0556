"""Stable hashes for splits and samples.

``bucket(key, m)`` is the unsigned 64-bit xxHash (seed 0) of the UTF-8 text modulo ``m``;
``bucket(key, m, "md5")`` takes the first 32 bits of MD5, which other engines can compute too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xxh64(text: Column) -> Column:
    """xxHash64 with seed 0 as a signed bigint, in the JVM where a classic session allows, else by Arrow."""
    try:
        from pyspark import SparkContext

        jvm = SparkContext._active_spark_context._jvm
        utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
        seq = jvm.PythonUtils.toSeq([utils.expression(text._jc)])
        return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)))
    except Exception:  # a Connect session, or another version's internals
        return xxh64_by_arrow(text)


def xxh64_by_arrow(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def digest(s):
        import numpy as np
        import pandas as pd
        import xxhash

        return pd.Series(np.array([xxhash.xxh64_intdigest(x or "") for x in s], dtype=np.uint64).view(np.int64), index=s.index)

    return digest(text)


def unsigned_mod(h: Column, m: int) -> Column:
    """A signed bigint read as unsigned, modulo ``m``."""
    return F.pmod(F.pmod(h, F.lit(m)) + F.when(h < 0, F.lit((1 << 64) % m)).otherwise(F.lit(0)), F.lit(m))


def bucket(key: Column, m: int, how: str = "xxh64") -> Column:
    if how == "md5":
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % m
    return unsigned_mod(xxh64(key), m)


def document_key(source: Column, id: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("")), F.lit(":"), F.coalesce(id.cast("string"), F.lit("")))
