"""Chord sheets: start_time,end_time,chord_name,key with three decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions.music import thousandths


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, start_s, end_s, chord, key; a file with any bad row is empty."""
    raw = spark.read.option("encoding", "UTF-8").text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    raw = raw.where("value not like 'start_time,%' and value <> ''")
    p = F.split("value", ",", 4)
    rows = raw.select("path", p[0].try_cast("double").alias("start_s"), p[1].try_cast("double").alias("end_s"), p[2].alias("chord"), p[3].alias("key"))
    bad = F.max((F.col("start_s").isNull() | F.col("end_s").isNull() | F.col("key").isNull()).cast("int")).over(Window.partitionBy("path"))
    return rows.withColumn("bad", bad).where("bad = 0").drop("bad")


def keys(chords: DataFrame) -> DataFrame:
    """path, start_s, end_s, key: runs of contiguous equal keys (gaps to 10 ms)."""
    w = Window.partitionBy("path").orderBy("start_s")
    fresh = (F.col("key") != F.lag("key").over(w)) | (F.col("start_s") - F.lag("end_s").over(w) > 0.01)
    x = chords.withColumn("run", F.sum(F.coalesce(fresh.cast("int"), F.lit(0))).over(w))
    return x.groupBy("path", "run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("key").alias("key")).drop("run").withColumn("confidence", F.lit(0.7))


def lines(chords: DataFrame) -> DataFrame:
    """The sheet's lines in order, as text."""
    return chords.select("start_s", F.concat(thousandths(F.col("start_s")), F.lit(","), thousandths(F.col("end_s")), F.format_string(",%s,%s", "chord", "key")).alias("value")).orderBy("start_s").select("value")
