"""Whole files as rows, those that can't be opened too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content, error of text files, folders or patterns of names. What isn't there is a row with an error and no content."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there, missing = [], []
    for p in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        (there if at.getFileSystem(conf).globStatus(at) else missing).append(p)
    gone = spark.createDataFrame([(p, None, f"cannot open {p}") for p in missing], "path string, content string, error string")
    if not there:
        return gone
    rows = spark.read.text(there, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(gone) if missing else rows
