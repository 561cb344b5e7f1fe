"""Session archives: the catalog of files and their retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = {"midi": r"_(?:transcription|tempo)\.mid$", "chords": r"_chords\.csv$", "audio": r"_audio\.wav$"}


def files(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, part, path, modified of the archive's files; other names
    are left out.  Contents are not read."""
    f = spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"))
    part = F.lit(None).cast("string")
    for name, pattern in PARTS.items():
        part = F.when(F.col("path").rlike(pattern), name).otherwise(part)
    return f.withColumn("part", part).where("part is not null").withColumn("session_id", F.regexp_extract("path", r"([^/]+)_(?:transcription|tempo|chords|audio)\.\w+$", 1))


def catalog(found: DataFrame) -> DataFrame:
    """session_id, midi_path, chords_path, audio_path, modified: sessions with
    a MIDI file, newest first."""
    one = lambda p: F.max(F.when(F.col("part") == p, F.col("path")))
    g = found.groupBy("session_id").agg(one("midi").alias("midi_path"), one("chords").alias("chords_path"), one("audio").alias("audio_path"), F.max(F.when(F.col("part") == "midi", F.col("modified"))).alias("modified"))
    return g.where("midi_path is not null").orderBy(F.desc("modified"))


def expired(found: DataFrame, keep: int = 10) -> DataFrame:
    """session_id, newest, files, expired: all but the ``keep`` sessions of the
    newest files (then the larger id).  The rank is over one row a session,
    after a partial top-k."""
    if keep < 0:
        raise ValueError("keep is negative")
    s = found.groupBy("session_id").agg(F.max("modified").alias("newest"), F.count("*").alias("files"))
    top = s.orderBy(F.desc("newest"), F.desc("session_id")).limit(keep).select("session_id", F.lit(True).alias("kept"))
    return s.join(F.broadcast(top), "session_id", "left").select("session_id", "newest", "files", F.col("kept").isNull().alias("expired"))
