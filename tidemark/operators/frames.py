"""What is visible at a time: active captions, frame states, draw plans, line wrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import timing as M
from tidemark.operators.intervals import bucketed, covering, meet, scene_at, spread
from tidemark.operators.lineage import dealt

TRANSITION = 140
VISIBLE = 0.002


def with_gaps(segments: DataFrame) -> DataFrame:
    """segments with the gaps to their neighbours; null at the ends."""
    w = Window.partitionBy("doc_id").orderBy("seg_idx")
    return segments.withColumn("gap_before", F.col("start_ms") - F.lag("end_ms").over(w)).withColumn("gap_after", F.lead("start_ms").over(w) - F.col("end_ms"))


def _times(points: DataFrame) -> DataFrame:
    """doc_id and ms of points, with their bucket if they have it."""
    return points.select(*[c for c in points.columns if c in ("doc_id", "ms", "__b")])


def active_segments(points: DataFrame, segments: DataFrame, transition: int = TRANSITION, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ms, seg_idx, alpha (and the columns of segments to keep) of every caption that can be seen at each point."""
    half = max(0, transition // 2)
    rows = with_gaps(segments).select("doc_id", "seg_idx", "start_ms", "end_ms", "gap_before", "gap_after", *keep)
    hit = covering(_times(points), rows, F.lit(half), F.lit(half), parts=parts)
    return hit.select("doc_id", "ms", "seg_idx", _caption_alpha(transition).alias("alpha"), *keep).where(F.col("alpha") > VISIBLE)


def _caption_alpha(transition: int) -> Column:
    return M.segment_opacity(F.col("ms"), F.col("start_ms"), F.col("end_ms"), F.col("gap_before"), F.col("gap_after"), transition)


def _overlay_rows(points: DataFrame, overlays: DataFrame, transition: int) -> tuple[DataFrame, Column, Column]:
    """Enabled overlays, and from when to when they may be seen; within the document's points; those without an end up to the last."""
    half = max(0, transition + 1) // 2
    ends = points.groupBy("doc_id").agg(F.min("ms").alias("first_ms"), (F.max("ms") + 1).alias("after_ms"))
    rows = overlays.where("enabled and start_ms is not null and end_ms is not null").select("doc_id", "overlay_idx", "on_top", "enabled", "start_ms", "end_ms").join(ends, "doc_id")
    return rows, F.greatest(F.col("start_ms") - half, F.col("first_ms")), F.when(F.col("end_ms") > 0, F.least(F.col("end_ms") + half, F.col("after_ms"))).otherwise(F.col("after_ms"))


def visible_overlays(points: DataFrame, overlays: DataFrame, transition: int = TRANSITION, parts: int | None = None) -> DataFrame:
    """doc_id, ms, overlay_idx, on_top, alpha. Overlays meet the points near them in time; those without an end are seen at all points from their start on."""
    points = _times(points)
    rows, lo, hi = _overlay_rows(points, overlays, transition)
    hit = meet(bucketed(points, parts), spread(rows, lo, hi, parts))
    alpha = M.overlay_opacity(F.col("ms"), F.col("enabled"), F.col("start_ms"), F.col("end_ms"), transition)
    return hit.select("doc_id", "ms", "overlay_idx", "on_top", alpha.alias("alpha")).where(F.col("alpha") > VISIBLE)


def frame_clock(durations: DataFrame, fps: int) -> DataFrame:
    """doc_id, frame, ms of every frame."""
    n = F.expr(f"(duration_ms * {fps} + 999) div 1000")
    return durations.where("duration_ms > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("frame")).withColumn("ms", F.expr(f"frame * 1000 div {fps}"))


def frame_states(points: DataFrame, segments: DataFrame, scenes: DataFrame, overlays: DataFrame, transition: int = TRANSITION, parts: int | None = None) -> DataFrame:
    """points (each once) with the state key: scene, captions with their opacity in 8 bits, overlays with theirs.

    All that may be seen is one table of items, which points meet once; the groups of a point lie where its bucket does."""
    at, half = _times(points), max(0, transition // 2)
    over, since, until = _overlay_rows(at, overlays, transition)
    fields = {"start_ms": "bigint", "end_ms": "bigint", "gap_before": "bigint", "gap_after": "bigint", "enabled": "boolean"}
    item = lambda rows, kind, i, lo, hi: rows.select("doc_id", F.lit(kind).alias("kind"), F.col(i).cast("int").alias("i"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])
    start, end = F.col("start_ms"), F.col("end_ms")
    items = item(scenes, 0, "scene_idx", start, end).unionAll(item(with_gaps(segments), 1, "seg_idx", start - half, end + half)).unionAll(item(over, 2, "overlay_idx", since, until))
    hit = meet(bucketed(at, parts), spread(items, F.col("lo"), F.col("hi"), parts).drop("lo", "hi"), "left")
    overlay = M.overlay_opacity(F.col("ms"), F.col("enabled"), start, end, transition)
    alpha = F.when(F.col("kind") == 1, _caption_alpha(transition)).when(F.col("kind") == 2, overlay)
    hit = hit.select("doc_id", "__b", "ms", "kind", "i", alpha.alias("alpha"))
    shown = lambda kind: F.when((F.col("kind") == kind) & (F.col("alpha") > VISIBLE), F.struct("i", M.alpha_byte(F.col("alpha")).alias("a")))
    text = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(shown(kind))), lambda x: F.concat_ws(":", x.i.cast("string"), x.a.cast("string"))), ",")
    scene = F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("i"))), F.lit(-1))
    states = hit.groupBy("doc_id", "__b", "ms").agg(F.concat_ws("|", scene.cast("string"), text(1), text(2)).alias("state")).drop("__b")
    return states if set(points.columns) <= {"doc_id", "ms"} else points.join(states, ["doc_id", "ms"]).select(*points.columns, "state")


def changed_frames(states: DataFrame, parts: int | None = None) -> DataFrame:
    """The frames that have to be drawn: those whose state isn't the one before's."""
    w = Window.partitionBy("doc_id").orderBy("ms")
    return dealt(states, parts, "doc_id").withColumn("__p", F.lag("state").over(w)).where("__p is null or __p <> state").drop("__p")


def draw_plan(points: DataFrame, segments: DataFrame, scenes: DataFrame, overlays: DataFrame, transition: int = TRANSITION, parts: int | None = None) -> DataFrame:
    """doc_id, ms, layer, item, alpha: what is drawn at each point, from the back: 0 scene, 1 overlays below, 2 caption, 3 its translation, 4 overlays on top."""
    scene = scene_at(_times(points), scenes, parts).where("scene_idx >= 0").select("doc_id", "ms", F.lit(0).alias("layer"), F.col("scene_idx").alias("item"), F.lit(1.0).alias("alpha"))
    over = visible_overlays(points, overlays, transition, parts).select("doc_id", "ms", F.when(F.col("on_top"), 4).otherwise(1).alias("layer"), F.col("overlay_idx").alias("item"), "alpha")
    seg = active_segments(points, segments.withColumn("told", F.col("translation") != ""), transition, parts, keep=("told",))
    seg = seg.select("doc_id", "ms", F.explode(F.when(F.col("told"), F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))).alias("layer"), F.col("seg_idx").alias("item"), "alpha")
    return scene.unionByName(over).unionByName(seg)


def highlight_tokens(segments: DataFrame, highlights: DataFrame) -> DataFrame:
    """doc_id, seg_idx, pos, prefix, core, suffix, color (null: none), bold: every token with the first highlight of its word. Highlights (highlight_idx, word, color, bold) hold for all documents."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("highlight_idx"))
    marks = highlights.select("highlight_idx", T.normal_word(F.col("word")).alias("key"), "color", "bold").where("key <> ''").withColumn("r", first).where("r = 1").drop("r", "highlight_idx")
    rows = segments.select("doc_id", "seg_idx", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    rows = rows.withColumn("key", T.normal_word(F.col("token"))).join(marks, "key", "left")
    return rows.withColumn("p", T.token_parts(F.col("token"))).select("doc_id", "seg_idx", "pos", "p.prefix", "p.core", "p.suffix", "color", F.coalesce("bold", F.lit(False)).alias("bold"))


def wrap(rows: DataFrame, width: int, key: list[str], text: str = "text") -> DataFrame:
    """key columns, line_idx, line: words laid out greedily in lines of `width` characters; line feeds break, a longer word has a line of its own.

    The fold runs over each text's own words, inside the expression."""

    def put(lines, word):  # noqa: ANN001, ANN202
        last = F.get(lines, F.size(lines) - 1)
        fits = F.length(last) + 1 + F.length(word) <= width
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    lines = F.flatten(F.transform(F.split(F.col(text), "\n"), lambda part: F.aggregate(T.tokens(part), F.array().cast("array<string>"), put)))
    return rows.select(*key, F.posexplode(lines).alias("line_idx", "line"))


def box_height(lines, font: float, spacing: float, padding: float):  # noqa: ANN001, ANN201
    """Height of an auto-height box, in canvas fractions."""
    return lines * font * spacing + 2 * padding
