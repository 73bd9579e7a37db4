"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df in spark.checkpoint.dir: computed once, safe from lost executors. Set here only where unset,
    to a temporary folder only on one machine; on a cluster an unset folder is an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        known = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not known and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="verdigris-"))
    return df.checkpoint(eager=True)
