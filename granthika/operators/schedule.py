"""Learning-rate schedule, throughput, and which checkpoints to keep."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def warmup_steps(ratio: float, steps: int) -> int:
    return max(1, int(ratio * steps))


def learning_rate(step: Column, warmup: int, steps: int, top: float, low: float) -> Column:
    """A linear rise over ``warmup`` steps, then a cosine down to ``low``, which holds after the end."""
    done = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    cosine = F.lit(low) + F.lit(0.5 * (top - low)) * (1 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, F.lit(top) * (step + 1) / warmup).when(step >= steps, F.lit(low)).otherwise(cosine)


def schedule(spark: SparkSession, steps: int, ratio: float, top: float, low: float) -> DataFrame:
    return spark.range(steps + 1).select(F.col("id").alias("step"), learning_rate(F.col("id"), warmup_steps(ratio, steps), steps, top, low).alias("lr"))


def utilisation(tokens_per_second: Column, params: int, layers: int, heads: int, head_dim: int, length: int, peak: float) -> Column:
    """Share of the peak rate that (6 parameters + 12 layers heads head_dim length) operations a token make up."""
    return F.lit(float(6 * params + 12 * layers * heads * head_dim * length)) * tokens_per_second / F.lit(peak)


def best(df: DataFrame, loss: str = "val_loss", step: str = "step", run: str | None = None) -> DataFrame:
    """The checkpoint of least loss, the earliest of equals; of each run if there are several."""
    scored = df.where(F.col(loss).isNotNull())
    return (scored.groupBy(run) if run else scored.groupBy()).agg(F.min_by(step, F.struct(loss, step)).alias(step), F.min(loss).alias(loss))


def newest(df: DataFrame, keep: int = 3, step: str = "step", run: str | None = None) -> DataFrame:
    """The ``keep`` newest checkpoints; without a run a limit finds them, no window over all rows."""
    if run is None:
        return df.orderBy(F.desc(step)).limit(keep)
    w = Window.partitionBy(run).orderBy(F.desc(step))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")
