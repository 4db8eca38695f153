"""Subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources.files import whole_texts

NO_CUES = "no cues found"


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, content, error of whole files; a path that isn't there is a row with an error."""
    return whole_texts(spark, paths)


def _body(lines: Column) -> Column:
    return T.collapse(F.regexp_replace(F.array_join(lines, " "), r"<[^>]*>|\{\\[^}]*\}", ""))


def parse(files: DataFrame, key: str = "path") -> DataFrame:
    """key, cue_idx, start_ms, end_ms, text of each cue of files (key, content), in the file's order.

    Blocks are separated by blank lines; the first line with an arrow times a block, what is before it is ignored, what
    follows is the text, without tags. Blocks without two timestamps, or without text, are dropped."""
    flat = F.regexp_replace(F.regexp_replace(F.col("content"), "^﻿", ""), "\r\n|\r", "\n")
    blocks = files.select(key, F.posexplode(F.filter(F.split(flat, "\n[ \t]*\n"), lambda b: b != "")).alias("block", "b"))
    lines = F.split("b", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains("-->")), True)
    rows = blocks.withColumn("at", at).where("at > 0").withColumn("timing", F.get(lines, F.col("at").cast("int") - 1)).withColumn("text", _body(F.slice(lines, F.col("at").cast("int") + 1, F.greatest(F.size(lines), F.lit(0)))))
    start, end = T.stamp_ms(F.split("timing", "-->", 2)[0]), T.stamp_ms(F.split("timing", "-->", 2)[1])
    rows = rows.select(key, "block", start.alias("start_ms"), end.alias("end_ms"), "text").where("start_ms is not null and end_ms is not null and text <> ''")
    order = Window.partitionBy(key).orderBy("block")
    return rows.select(key, (F.row_number().over(order) - 1).alias("cue_idx"), "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), "text")


def problems(files: DataFrame, cues: DataFrame, key: str = "path") -> DataFrame:
    """key, error of the files without a cue: what read() says of them, or that there is none in them."""
    said = F.coalesce("error", F.lit(NO_CUES)) if "error" in files.columns else F.lit(NO_CUES)
    return files.select(key, said.alias("error")).join(cues.select(key).distinct(), key, "left_anti")


def results(files: DataFrame, key: str = "path") -> DataFrame:
    """key, n_cues, error: one row a file; the error is empty where there are cues."""
    cues = parse(files, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_cues"))
    said = F.coalesce("error", F.lit(NO_CUES)) if "error" in files.columns else F.lit(NO_CUES)
    return files.select(key, said.alias("__e")).join(cues, key, "left").select(key, F.coalesce("n_cues", F.lit(0)).alias("n_cues"), F.when(F.col("n_cues") > 0, "").otherwise(F.col("__e")).alias("error"))


def render(cues: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: cues as subtitle text."""
    block = F.concat((F.col("cue_idx") + 1).cast("string"), F.lit("\n"), T.format_stamp(F.col("start_ms")), F.lit(" --> "), T.format_stamp(F.col("end_ms")), F.lit("\n"), F.col("text"))
    return cues.select(key, F.struct("cue_idx", block.alias("b")).alias("c")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.b), "\n\n").alias("content"))
