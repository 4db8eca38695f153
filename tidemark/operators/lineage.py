"""Lineage cuts, and how rows are dealt to tasks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in spark.checkpoint.dir, which all executors share, so that a lost executor loses nothing. Where all runs in one process (tests) and that is unset, a folder of our own."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir().isDefined()):
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, parts: int | None, *key: str) -> DataFrame:
    """df dealt to so many tasks by the key; as it is without a number, so that Spark's own holds. Windows, groups and joins by the key, or by more columns than a window's or group's, follow it."""
    return df if parts is None else df.repartition(parts, *key)


def parts_of(df: DataFrame) -> int | None:
    """The tasks of a table that was cut, None where they are no more than Spark's own number."""
    n = df._jdf.rdd().getNumPartitions()
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
