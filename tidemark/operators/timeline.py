"""Keeping the timeline: order, overlaps, layouts, edits, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.running import before


def normalise(rows: DataFrame, idx: str = "seg_idx", trim: bool = True) -> DataFrame:
    """Rows in order of start (the old place on a tie), renumbered; with trim, each ends where the next begins at the latest."""
    order = Window.partitionBy("doc_id").orderBy("start_ms", F.col(idx).alias("o"))
    out = rows.withColumn("__n", F.row_number().over(order) - 1)
    if trim:
        out = out.withColumn("end_ms", F.greatest("start_ms", F.least("end_ms", F.lead("start_ms").over(order))))
    return out.withColumn(idx, F.col("__n")).drop("__n")


def auto_layout(scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """The scenes of each document share its duration evenly; unchanged where the duration is 0 or less."""
    doc = Window.partitionBy("doc_id")
    rows = scenes.join(durations.select("doc_id", F.col("duration_ms").alias("__d")), "doc_id", "left")
    rows = rows.withColumn("__i", F.row_number().over(doc.orderBy("scene_idx")) - 1).withColumn("__n", F.count(F.lit(1)).over(doc))
    rows = rows.withColumn("start_ms", F.expr("if(__d > 0, __d * __i div __n, start_ms)")).withColumn("end_ms", F.expr("if(__d > 0, __d * (__i + 1) div __n, end_ms)"))
    return rows.select(*scenes.columns)


def drop_scenes(paths: DataFrame, at: int, duration: int, each: int = 3000) -> DataFrame:
    """doc_id, scene_idx, image_path, start_ms, end_ms of images (doc_id, paths) dropped at a time, `each` ms long, within the duration."""
    rows = paths.select("doc_id", F.posexplode("paths").alias("scene_idx", "image_path"))
    start = F.least(F.lit(at) + each * F.col("scene_idx"), F.lit(duration)).cast("bigint")
    return rows.where(F.lit(at) + each * F.col("scene_idx") <= duration).select("doc_id", "scene_idx", "image_path", start.alias("start_ms"), F.least(start + each, F.lit(duration)).cast("bigint").alias("end_ms"))


def move_edge(scenes: DataFrame, edge: str, which: F.Column, to: int, duration: int, least: int = 200) -> DataFrame:
    """Drags the start or end edge, or (edge 'both') the whole scene, of the rows `which`; at least `least` ms stay, all within the duration."""
    s, e = F.col("start_ms"), F.col("end_ms")
    if edge == "start":
        return scenes.withColumn("start_ms", F.when(which, F.least(F.greatest(F.lit(to), F.lit(0)), e - least)).otherwise(s).cast("bigint"))
    if edge == "end":
        return scenes.withColumn("end_ms", F.when(which, F.least(F.greatest(F.lit(to), s + least), F.lit(duration))).otherwise(e).cast("bigint"))
    start = F.greatest(F.least(F.lit(to), F.lit(duration) - (e - s)), F.lit(0))
    return scenes.withColumn("__s", F.when(which, start).otherwise(s)).withColumn("end_ms", (e - s + F.col("__s")).cast("bigint")).withColumn("start_ms", F.col("__s").cast("bigint")).drop("__s")


def stretch(scenes: DataFrame, which: F.Column, duration: int) -> DataFrame:
    return scenes.withColumn("start_ms", F.when(which, 0).otherwise(F.col("start_ms")).cast("bigint")).withColumn("end_ms", F.when(which, duration).otherwise(F.col("end_ms")).cast("bigint"))


def without_rows(rows: DataFrame, which: F.Column, idx: str = "scene_idx") -> DataFrame:
    """The rows of each document but those `which`, renumbered in order."""
    left = rows.where(~F.coalesce(which, F.lit(False)))
    return left.withColumn(idx, (F.row_number().over(Window.partitionBy("doc_id").orderBy(idx)) - 1).cast(dict(rows.dtypes)[idx]))


def assign_speaker(segments: DataFrame, rows: DataFrame, speaker_id: int) -> DataFrame:
    """The listed rows (doc_id, seg_idx) get the speaker, without doubt."""
    marked = segments.join(rows.select("doc_id", "seg_idx", F.lit(True).alias("__hit")).distinct(), ["doc_id", "seg_idx"], "left")
    return settled(marked, F.col("__hit").isNotNull(), F.lit(speaker_id)).select(*segments.columns)


def settled(segments: DataFrame, which: F.Column, speaker) -> DataFrame:  # noqa: ANN001
    out = segments.withColumn("__w", which)
    for name, value in (("speaker_id", speaker.cast("int")), ("confidence", F.lit(1.0).cast("float")), ("needs_review", F.lit(False)), ("review_reason", F.lit(""))):
        out = out.withColumn(name, F.when(F.col("__w"), value).otherwise(F.col(name)))
    return out.drop("__w")


def edit_cells(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (doc_id, seg_idx, start, end, speaker_id, text, translation; null where a cell isn't edited). Times are what a user types; one that can't be read changes nothing. A speaker settles the review."""
    e = edits.select("doc_id", "seg_idx", T.edited_stamp(F.col("start")).alias("__s"), T.edited_stamp(F.col("end")).alias("__e"), F.col("speaker_id").alias("__p"), F.col("text").alias("__t"), F.col("translation").alias("__x"))
    out = settled(segments.join(e, ["doc_id", "seg_idx"], "left"), F.col("__p").isNotNull(), F.col("__p"))
    for name, new in (("start_ms", "__s"), ("end_ms", "__e"), ("text", "__t"), ("translation", "__x")):
        out = out.withColumn(name, F.coalesce(new, name))
    return out.select(*segments.columns)


def extend_speakers(speakers: DataFrame, counts: DataFrame) -> DataFrame:
    """Speakers up to each document's count (doc_id, n): clones of its last one under new names."""
    last = speakers.groupBy("doc_id").agg(F.max_by(F.struct(*speakers.columns), "speaker_id").alias("s"))
    missing = last.join(counts, "doc_id").where("n > s.speaker_id + 1").select("s", F.explode(F.sequence(F.col("s.speaker_id") + 1, F.col("n").cast("int") - 1)).alias("k"))
    columns = [F.col("k").cast("int").alias(c) if c == "speaker_id" else F.concat(F.lit("Speaker "), (F.col("k") + 1).cast("string")).alias(c) if c == "name" else F.col(f"s.{c}") for c in speakers.columns]
    return speakers.unionByName(missing.select(*columns))


def stitch(parts: DataFrame) -> DataFrame:
    """Rows of parts (part_idx, duration_ms and row columns) on one timeline: each part begins where the one before ended."""
    spans = before(parts.groupBy("part_idx").agg(F.max("duration_ms").alias("__d")), "part_idx", F.col("__d")).select("part_idx", F.col("before").alias("offset_ms"))
    rows = parts.join(spans, "part_idx")
    return rows.withColumn("start_ms", F.col("start_ms") + F.col("offset_ms")).withColumn("end_ms", F.col("end_ms") + F.col("offset_ms"))


def upsert_highlights(highlights: DataFrame, changes: DataFrame) -> DataFrame:
    """highlights with changes (doc_id, word, color, bold) put in under their normalised words; the change wins, blanks are ignored."""
    both = highlights.withColumn("__o", F.lit(1)).unionByName(changes.withColumn("__o", F.lit(0))).withColumn("__k", T.normal_word(F.col("word"))).where("__k <> ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "__k").orderBy("__o", "word"))
    return both.withColumn("__r", first).where("__r = 1").withColumn("word", F.col("__k")).drop("__o", "__k", "__r")


def remove_highlights(highlights: DataFrame, words: DataFrame) -> DataFrame:
    gone = words.select("doc_id", T.normal_word(F.col("word")).alias("__k")).distinct()
    return highlights.withColumn("__k", T.normal_word(F.col("word"))).join(gone, ["doc_id", "__k"], "left_anti").drop("__k")


def clamp_box(box, least: float = 0.05):  # noqa: ANN001, ANN201
    """A dragged box with at least `least` of it on the canvas."""
    x = F.least(F.greatest(box["x"], least - box["w"]), F.lit(1 - least))
    y = F.least(F.greatest(box["y"], least - box["h"]), F.lit(1 - least))
    return F.struct(x.alias("x"), y.alias("y"), box["w"].alias("w"), box["h"].alias("h"))


def resize_box(box, left: float = 0.0, top: float = 0.0, right: float = 0.0, bottom: float = 0.0, least: float = 0.02):  # noqa: ANN001, ANN201
    """Moves edges by canvas fractions; width and height stay `least` or more."""
    dx, dy = F.least(F.lit(left), box["w"] - least), F.least(F.lit(top), box["h"] - least)
    return clamp_box({"x": box["x"] + dx, "y": box["y"] + dy, "w": F.greatest(box["w"] - dx + right, F.lit(least)), "h": F.greatest(box["h"] - dy + bottom, F.lit(least))})


def duration(segments: DataFrame, scenes: DataFrame, audio: DataFrame | None = None, least: int = 1) -> DataFrame:
    """doc_id, duration_ms: the latest end of segments, scenes and audio (doc_id, audio_ms)."""
    ends = segments.select("doc_id", F.col("end_ms").alias("t")).unionByName(scenes.select("doc_id", F.col("end_ms").alias("t")))
    if audio is not None:
        ends = ends.unionByName(audio.select("doc_id", F.col("audio_ms").alias("t")))
    return ends.groupBy("doc_id").agg(F.greatest(F.max("t"), F.lit(least)).cast("bigint").alias("duration_ms"))


def export_duration(segments: DataFrame, scenes: DataFrame, audio: DataFrame, width: F.Column | int = 2, height: F.Column | int = 2) -> DataFrame:
    """doc_id, duration_ms, error: what an export would last; documents of audio (doc_id, audio_ms) without a length, or with a canvas under 2 pixels (even sides), have an error."""
    found = duration(segments, scenes, audio, least=0)
    small = (F.lit(width) < 2) | (F.lit(height) < 2)
    return found.withColumn("error", F.when(small, "the canvas is too small").when(F.col("duration_ms") <= 0, "there is nothing to render").otherwise(""))
