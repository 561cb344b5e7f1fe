"""Cutting lineage into the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    A session of one machine (local master) without that setting gets a folder
    of its own; on a cluster a machine's own folder would be lost with it, so
    an unset folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/strophe-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once, its rows in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark, folder: str) -> None:
    """Delete a folder, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
