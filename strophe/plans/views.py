"""Event streams as musical sessions: notes, tempo points and beats.

All tables are keyed by session_id; times are seconds (double) from the
session's origin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN_US = 1_704_067_200_000_000
SCALE = 5e10


def _time():
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ORIGIN_US)) / F.lit(SCALE)


def notes(events: DataFrame) -> DataFrame:
    """session_id, event_id, start_s, end_s, midi_note, confidence."""
    t = _time()
    return events.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        t.alias("start_s"),
        (t + F.lit(0.05) + F.col("value") / F.lit(100.0)).alias("end_s"),
        (F.lit(36) + F.col("event_id") % 72).cast("int").alias("midi_note"),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("confidence"),
    )


def tempo(events: DataFrame) -> DataFrame:
    """session_id, event_id, time_s, bpm, confidence."""
    return events.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        _time().alias("time_s"),
        (F.lit(100.0) + F.col("value") / F.lit(10.0)).alias("bpm"),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("confidence"),
    )


def beats(events: DataFrame, last: int = 104) -> DataFrame:
    """A grid of half seconds for each session."""
    return events.select(F.col("user_id").alias("session_id")).distinct().select("session_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i")).select("session_id", (F.col("i") * F.lit(0.5)).alias("time_s"))


def read(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The same views in DuckDB.
SQL = """
with notes as (
  select user_id as session_id, event_id, (epoch_us(ts) - 1704067200000000) / 5e10::double as start_s,
    (epoch_us(ts) - 1704067200000000) / 5e10::double + 0.05::double + value / 100::double as end_s,
    cast(36 + event_id % 72 as int) as midi_note, cast(json_extract_string(props, '$.k') as int) / 100::double as confidence from events),
tempo as (
  select user_id as session_id, event_id, (epoch_us(ts) - 1704067200000000) / 5e10::double as time_s, 100::double + value / 10::double as bpm,
    cast(json_extract_string(props, '$.k') as int) / 100::double as confidence from events),
beats as (select session_id, i * 0.5::double as time_s from (select distinct user_id as session_id from events), range(105) as g(i))
"""
