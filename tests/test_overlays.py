"""Overlay, speaker and highlight rows."""

from pyspark.sql import functions as F

from tidemark.functions import timing as M
from tidemark.operators import overlays as O


def test_edits_touch_only_their_rows(spark):
    docs = spark.createDataFrame([(1, "/x/logo.png")], "doc_id bigint, image_path string")
    rows = O.image_overlays(docs, "Logo").unionByName(O.image_overlays(docs))
    assert [r.name for r in rows.collect()] == ["Logo", "logo"]
    got = O.edit(rows, F.col("name") == "Logo", start_s=F.lit(2), end_s=F.lit(5), opacity=F.lit(1.7), on_top=F.lit(True)).collect()
    assert [(r.start_ms, r.end_ms, r.opacity, r.on_top) for r in got] == [(2000, 5000, 1.0, True), (0, 0, 1.0, False)]
    assert O.whole_video(O.edit(rows, F.lit(True), start_s=F.lit(2)), F.lit(True)).where("start_ms <> 0").count() == 0
    assert O.style_problems(rows).where("size(problems) > 0").count() == 0
    wide = rows.withColumn("style", F.col("style").withField("font_weight", F.lit(20)))
    assert O.style_problems(wide).first().problems == ["font_weight"]


def test_titles(spark):
    got = O.title_overlays(spark.createDataFrame([(1, "  Hello "), (2, " ")], "doc_id bigint, text string"), upright=True).collect()
    assert [(r.text, r.style.box.h, r.style.font_weight, r.style.auto_height) for r in got] == [("Hello", 0.06, 700, False)]


def test_visibility_and_fades(spark):
    df = spark.createDataFrame([(0,), (930,), (1000,), (1070,), (5000,)], "ms bigint")
    rows = df.select(
        M.overlay_visible(F.col("ms"), F.lit(True), F.lit(1000), F.lit(0)).alias("v"), M.overlay_opacity(F.col("ms"), F.lit(True), F.lit(1000), F.lit(0), 140).alias("open"),
        M.overlay_opacity(F.col("ms"), F.lit(True), F.lit(0), F.lit(0), 140).alias("whole"), M.overlay_opacity(F.col("ms"), F.lit(False), F.lit(0), F.lit(0), 140).alias("off"),
        M.overlay_opacity(F.col("ms"), F.lit(True), F.lit(1000), F.lit(5000), 0).alias("hard"),
    ).collect()
    assert [r.v for r in rows] == [False, False, True, True, True]
    assert [r.open for r in rows] == [0.0, 0.0, 0.5, 1.0, 1.0] and {r.whole for r in rows} == {1.0} and {r.off for r in rows} == {0.0}
    assert [r.hard for r in rows] == [0.0, 0.0, 1.0, 1.0, 0.0]


def test_highlights_and_providers(spark):
    have = spark.createDataFrame([(1, "wohl", "#ff000000", True)], "doc_id bigint, word string, color string, bold boolean")
    got = O.ensure_highlight(have, spark.createDataFrame([(1, "Wohl?"), (1, "neu"), (1, "--")], "doc_id bigint, word string"))
    assert sorted((r.word, r.bold) for r in got.collect()) == [("neu", False), ("wohl", True)]
    known = spark.createDataFrame([("free", False), ("keyed", True)], "id string, needs_key boolean")
    rows = O.provider(spark.createDataFrame([("KEYED",), ("other",)], "provider_id string"), known, "free")
    assert {r.provider_id: r.id for r in rows.collect()} == {"KEYED": "keyed", "other": "free"}


def test_parts(spark, tmp_path):
    parts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "part_idx int, path string")
    assert [r.path for r in O.move_part(parts, 1, 1).orderBy("part_idx").collect()] == ["a", "c", "b"]
    assert [r.path for r in O.move_part(parts, 2, 1).orderBy("part_idx").collect()] == ["a", "b", "c"]
    (tmp_path / "x").write_text("")
    assert O.part_problems(spark, [f"{tmp_path}/x", f"{tmp_path}/y"], "") == ["there is no output", f"missing: {tmp_path}/y"]
    assert O.part_problems(spark, [], "o") == ["there are no parts"]


def test_replies_and_prompts(spark):
    df = spark.createDataFrame([('[[["Hal","x"],["lo ","y"]],null]', '{"responseData":{"translatedText":" hi "}}'), ("no", "{}")], "a string, b string")
    assert [tuple(r) for r in df.select(O.nested_reply(F.col("a")), O.object_reply(F.col("b"))).collect()] == [("Hallo", "hi"), (None, None)]
    text = spark.range(1).select(O.prompt(F.array(F.lit("a"), F.lit('"b"')), F.lit("de")).alias("p")).first().p
    assert text.startswith("Translate these 2 subtitle lines to German.") and text.endswith('["a","\\"b\\""]')
