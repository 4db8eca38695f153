"""What the corpus operators share: table loading, the shared folder, lineage cuts, word caches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own if all runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="tidemark-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes what fresh_dir named, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names as they may be (with dots, say) can't go through mapInArrow."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class BoundedCache(dict):
    """make(key), remembered for at most `limit` keys; then it starts afresh, so memory is bounded and results are not affected."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """[from, to) ranges of consecutive rows, each of about `budget` units of length, or of one row."""
    start, held = 0, 0
    for at, n in enumerate(lengths):
        if held and held + n > budget:
            yield start, at
            start, held = at, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)
