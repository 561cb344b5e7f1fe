"""Settings as JSON text: known keys only, defaults for what can't be read."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, types and defaults of the settings.
DEFAULTS = {"device_name": ("string", ""), "output_directory": ("string", ""), "sample_rate": ("int", 22_050), "block_duration": ("double", 0.25), "signal_threshold_db": ("double", -48.0), "trigger_seconds": ("double", 0.6), "end_silence_seconds": ("double", 3.0), "keep_running_in_tray": ("boolean", True), "recording_mode": ("string", "auto"), "cpu_warning_shown": ("boolean", False)}


def parsed(text: Column) -> Column:
    """A struct of all settings; each that is missing or of a wrong type has
    its default, as has everything in text that isn't JSON or is null."""
    got = F.from_json(text, ", ".join(f"{k} {t}" for k, (t, _) in DEFAULTS.items()), {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(got[k], F.lit(v).cast(t)).alias(k) for k, (t, v) in DEFAULTS.items()])


def written(settings: Column) -> Column:
    return F.to_json(settings)


def load(spark, path: str) -> dict:
    """The settings of a JSON file; defaults for a missing or damaged one."""
    names = list(DEFAULTS)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return {k: v for k, (_, v) in DEFAULTS.items()}
    row = spark.read.text(path, wholetext=True).select(parsed(F.col("value")).alias("s")).select("s.*").first()
    return row.asDict() if row else {k: DEFAULTS[k][1] for k in names}


def save(spark, values: dict, path: str) -> None:
    """Write a JSON file beside its place, then move it there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = place.getFileSystem(conf)
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps({k: values.get(k, v) for k, (_, v) in DEFAULTS.items()}, ensure_ascii=False, indent=2).encode()))
    out.close()
    fs.delete(place, False)
    fs.rename(temp, place)
