"""A feed without a device: clicks under a swinging tempo, over changing chords."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Roots of the four chords, four seconds each.
ROOTS = (261.63, 349.23, 392.00, 261.63)


def samples(spark: SparkSession, seconds: float, rate: int = 22_050, block_s: float = 0.25) -> DataFrame:
    """block, i, at_s, sample; made where it is used, from a range."""
    size = int(rate * block_s)
    x = spark.range(int(seconds / block_s) * size).select((F.col("id") / size).cast("long").alias("block"), F.col("id").alias("i"), (F.col("id") / rate).alias("at_s"))
    t = F.col("at_s")
    beat = F.pmod(t * (108 + 3.8 * F.sin(2 * math.pi * t / 18)) / 60, F.lit(1.0))
    click = 0.72 * F.exp(-55 * beat) * F.sin(2 * math.pi * 1100 * t)
    root = F.element_at(F.array(*[F.lit(r) for r in ROOTS]), (F.floor(t / 4) % 4 + 1).cast("int"))
    tones = sum(F.sin(2 * math.pi * k * root * t) for k in (1.0, 1.25, 1.5))
    return x.withColumn("sample", click + 0.12 * tones)


def blocks(found: DataFrame) -> DataFrame:
    """block, at_s, samples in order; a block is a quarter of a second."""
    g = found.groupBy("block").agg(F.min("at_s").alias("at_s"), F.array_sort(F.collect_list(F.struct("i", "sample"))).alias("a"))
    return g.select("block", "at_s", F.col("a.sample").alias("samples"))
