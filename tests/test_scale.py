"""Work is dealt to as many tasks as it needs, and dealing changes no result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import frames, intervals, vectors
from tidemark.operators.lineage import cut, parts_of
from tidemark.plans import fixtures, timelines

SF = "/root/testdata/sf0.001"


def whole(df):  # noqa: ANN001, ANN201
    return sorted(map(tuple, df.collect()), key=repr)


def test_tasks_follow_the_characters(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "CHARS", 3_000)
    chars = spark.read.parquet(f"{SF}/conversations.parquet").agg(F.sum(F.length("text"))).first()[0]
    rows = cut(fixtures.segments(spark, SF))
    assert parts_of(rows) == -(-chars // 3_000) > 4
    assert timelines.points(rows).rdd.getNumPartitions() == parts_of(rows)


@pytest.mark.parametrize("name", ["segment_votes", "assign_speakers", "frame_states", "active_segments", "scene_at", "segment_at", "draw_plan", "durations", "split_on_change"])
def test_dealing_changes_no_result(spark, monkeypatch, name):
    few = whole(queries.QUERIES[name](spark, SF))
    monkeypatch.setattr(fixtures, "CHARS", 3_000)
    dealt = queries.QUERIES[name](spark, SF)
    assert whole(dealt) == few and few
    plan = dealt._jdf.queryExecution().toString()
    assert name == "durations" or "REPARTITION_BY_NUM" in plan


def test_points_keep_their_columns_and_copies(spark):
    points = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 70_000, "b"), (2, 5, None)], "doc_id bigint, ms bigint, x string")
    scenes = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 0, 80_000), (1, 2, 80_000, 70_000)], "doc_id bigint, scene_idx int, start_ms bigint, end_ms bigint")
    want = [(1, 5, "a", 1), (1, 5, "a", 1), (1, 70_000, "b", 1), (2, 5, None, -1)]
    for parts in (None, 7):
        assert whole(intervals.scene_at(points, scenes, parts)) == want


def test_open_overlays_last_to_the_last_point(spark):
    points = spark.createDataFrame([(1, t) for t in (0, 59_999, 60_000, 200_000)], "doc_id bigint, ms bigint")
    kind = "doc_id bigint, overlay_idx int, on_top boolean, enabled boolean, start_ms bigint, end_ms bigint"
    overlays = spark.createDataFrame([(1, 0, False, True, 0, 0), (1, 1, False, True, 60_000, 0), (1, 2, False, False, 0, 0), (1, 3, False, True, 0, 1000), (1, 4, False, True, 0, None)], kind)
    got = frames.visible_overlays(points, overlays, parts=5).select("ms", "overlay_idx", F.round("alpha", 2))
    assert whole(got) == [(0, 0, 1.0), (0, 3, 0.5), (200_000, 0, 1.0), (200_000, 1, 1.0), (59_999, 0, 1.0), (59_999, 1, 0.49), (60_000, 0, 1.0), (60_000, 1, 0.5)]


def test_vectors_block_by_block_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 3, i, [float(np.float32(x)) for x in rng.normal(size=5)]) for i in range(90)]
    rows += [(0, 100 + i, rows[0][2]) for i in range(9)] + [(1, 200, None), (1, 201, [1.0, None, 0.0, 0.0, 0.0]), (1, 202, [1.0, 2.0]), (5, 300, [1.0]), (None, 301, [1.0]), (6, 302, [1.0, 0.0]), (6, 303, [1.0])]
    table = spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<float>")

    def distance(x, y):  # noqa: ANN001, ANN202
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return None
        total = 0.0
        for a, b in zip(x, y):
            total += a * b
        return 1 - total

    want = {(k, a, b): distance(x, y) for k, a, x in rows for m, b, y in rows if k is not None and k == m and a < b}
    near = {}
    for (_, a, b), d in want.items():
        for own, other in ((a, b), (b, a)):
            near[own] = min(near.get(own, (True, math.inf, math.inf)), (d is None, 0.0 if d is None else round(d, 6), other))
    for size in (7, 1024):
        got = vectors.cosine_pairs(table, "label", size)
        assert {(r.label, r.a, r.b): r.distance for r in got.collect()} == want and got.count() == len(want)
        found = {r.vec_id: (r.distance is None, r.distance or 0.0, r.other) for r in vectors.nearest(table, "label", size=size).collect()}
        assert found == near


def test_blocks_of_one_key_go_to_many_tasks(spark):
    table = spark.range(400).selectExpr("1 AS label", "id AS vec_id", "array(cast(id AS float)) AS embedding")
    sizes = vectors.cosine_pairs(table, "label", 20).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 400 * 399 // 2
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 400 * 399 // 4


def test_double_vectors_keep_their_digits(spark):
    table = spark.createDataFrame([(1, 1, [0.1, 0.7]), (1, 2, [0.3, 0.9])], "label int, vec_id bigint, embedding array<double>")
    assert vectors.cosine_pairs(table, "label").first().distance == 1 - (0.0 + 0.1 * 0.3 + 0.7 * 0.9)
