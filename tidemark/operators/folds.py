"""Ordered folds: rules that are sequential within a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(df: DataFrame, key: str, order: list[str], rule: Callable[[list[dict]], list[dict]], schema: str | StructType, parts: int | None = None) -> DataFrame:
    """rule over each key's rows, in order. One shuffle (to so many tasks, if parts are given) and sort by key; keys stream through, so a task holds one at a time beside a batch."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        out: list[dict] = []
        for _, own in groupby(rows, key=lambda r: r[key]):
            out += rule(list(own))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return (df.repartition(parts, key) if parts else df.repartition(key)).sortWithinPartitions(key, *order).mapInArrow(run, kind)
