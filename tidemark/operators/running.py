"""Running sums over a whole table, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def before(rows: DataFrame, place: str, value: Column, key: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """rows with `before`: the sum of value over the rows of the key at smaller places (whole numbers, each once).

    Sums within blocks of places, and of whole blocks: only as many rows as there are blocks are in one window."""
    key = key or []
    rows = rows.withColumn("__b", F.floor(F.col(place) / block)).withColumn("__v", value.cast("bigint"))
    inner = Window.partitionBy(*key, "__b").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "__b").agg(F.sum("__v").alias("__s"))
    sums = sums.select(*key, "__b", F.coalesce(F.sum("__s").over(Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    rows = rows.withColumn("__i", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    return rows.join(sums, [*key, "__b"]).withColumn("before", F.col("__o") + F.col("__i")).drop("__b", "__v", "__i", "__o")
