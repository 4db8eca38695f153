"""Overlays, speakers and highlights as rows: presets, default layouts, edits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.running import before
from tidemark.schema import OVERLAY_DEFAULTS, STYLE_DEFAULTS

#: Boxes (x, y, w, h) of the presets on a wide and on an upright canvas.
BOXES = {
    "Logo": ((0.02, 0.86, 0.20, 0.12), (0.03, 0.88, 0.28, 0.09)),
    "Subscribe": ((0.66, 0.88, 0.32, 0.08), (0.55, 0.89, 0.42, 0.06)),
    "Title": ((0.0, 0.0, 1.0, 0.085), (0.0, 0.0, 1.0, 0.06)),
    "": ((0.35, 0.40, 0.30, 0.20), (0.35, 0.40, 0.30, 0.20)),
}
TRANSLATION_BOXES = {"upright": (0.05, 0.71, 0.90, 0.09), "wide": (0.06, 0.78, 0.88, 0.11)}
SPEAKER_BOXES = {"upright": (0.05, 0.56, 0.90, 0.13), "even": (0.41, 0.44, 0.46, 0.22), "odd": (0.04, 0.50, 0.50, 0.16)}
#: Least and greatest value of each numeric style field.
DOMAINS = {
    "box.x": (-1, 2), "box.y": (-1, 2), "box.w": (0.02, 2), "box.h": (0.02, 2), "box_opacity": (0, 1), "corner_radius": (0, 0.20), "padding_x": (0, 0.20), "padding_y": (0, 0.20),
    "font_size": (0.005, 0.40), "font_weight": (100, 900), "line_spacing": (0.7, 2.5), "shadow_offset": (0, 0.05), "outline_width": (0, 0.03),
}


def box(x: float, y: float, w: float, h: float) -> Column:
    return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h"))


def style(**fields: Column) -> Column:
    """A style at its defaults but for the given fields."""
    return F.struct(*[fields[n].alias(n) if n in fields else F.expr(d).alias(n) for n, d in STYLE_DEFAULTS.items()])


def _columns(known: dict[str, Column], own: Column) -> list[Column]:
    return [known[n].alias(n) if n in known else F.expr(d).alias(n) for n, d in OVERLAY_DEFAULTS.items()] + [own.alias("style")]


def image_overlays(paths: DataFrame, preset: str = "", upright: bool = False) -> DataFrame:
    """Overlay rows of pictures (doc_id, image_path): the Logo or Subscribe preset, else named by the file."""
    name = F.lit(preset) if preset else F.regexp_extract("image_path", r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    return paths.select("doc_id", *_columns({"name": name, "image_path": F.col("image_path")}, style(box=box(*BOXES[preset][upright]))))


def title_overlays(titles: DataFrame, upright: bool = False) -> DataFrame:
    """Banner rows of texts (doc_id, text) across the top; blank ones have none."""
    own = style(
        box=box(*BOXES["Title"][upright]), auto_height=F.lit(False), box_color=F.lit("#ff8e1c22"), text_color=F.lit("#ffffffff"), corner_radius=F.lit(0.0), font_size=F.lit(0.048), font_weight=F.lit(700),
    )
    return titles.where(T.collapse(F.col("text")) != "").select("doc_id", *_columns({"name": F.lit("Title"), "is_image": F.lit(False), "text": F.regexp_replace("text", r"^\s+|\s+$", "")}, own))


def default_layout(rows: DataFrame, upright: Column) -> DataFrame:
    """Overlay rows (name, style, ...) with the presets' boxes for the canvas; other overlays keep theirs."""
    own = F.col("style.box")
    for name in ("Logo", "Subscribe", "Title"):
        wide, tall = BOXES[name]
        own = F.when(F.col("name") == name, F.when(upright, box(*tall)).otherwise(box(*wide))).otherwise(own)
    return rows.withColumn("style", F.col("style").withField("box", own))


def speaker_layout(rows: DataFrame, upright: Column) -> DataFrame:
    """Speaker rows with their default boxes: one band on an upright canvas, opposite corners else."""
    corner = F.when(F.col("speaker_id") % 2 == 0, box(*SPEAKER_BOXES["even"])).otherwise(box(*SPEAKER_BOXES["odd"]))
    return rows.withColumn("style", F.col("style").withField("box", F.when(upright, box(*SPEAKER_BOXES["upright"])).otherwise(corner)))


def translation_layout(settings: DataFrame, upright: Column) -> DataFrame:
    """Settings rows with the default box of the translation."""
    own = F.when(upright, box(*TRANSLATION_BOXES["upright"])).otherwise(box(*TRANSLATION_BOXES["wide"]))
    return settings.withColumn("translation_style", F.col("translation_style").withField("box", own))


def default_speakers(docs: DataFrame) -> DataFrame:
    """Two speakers a document."""
    rows = []
    for k, (tint, color, where, radius) in enumerate((("#ff7cb342", "#ffcbe86b", (0.41, 0.47, 0.46, 0.24), 0.0), ("#ffe8c11c", "#ffffe01b", (0.03, 0.53, 0.52, 0.16), 0.012))):
        rows.append(F.struct(F.lit(k).alias("speaker_id"), F.lit(f"Speaker {k + 1}").alias("name"), F.lit(tint).alias("tint"), style(box=box(*where), box_color=F.lit(color), corner_radius=F.lit(radius)).alias("style")))
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("s")).select("doc_id", "s.*")


def add_speaker(speakers: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """One more speaker a document: its last one's look, a little lower. Those of docs that have none get the first default one like that."""
    last = speakers.groupBy("doc_id").agg(F.max_by(F.struct("tint", "style"), "speaker_id").alias("l"), F.count(F.lit(1)).cast("int").alias("n"))
    lower = F.col("l.style").withField("box", F.col("l.style.box").withField("y", F.least(F.lit(0.90), F.col("l.style.box.y") + 0.06)))
    out = speakers.unionByName(last.select("doc_id", F.col("n").alias("speaker_id"), F.concat(F.lit("Speaker "), (F.col("n") + 1).cast("string")).alias("name"), F.col("l.tint").alias("tint"), lower.alias("style")))
    if docs is None:
        return out
    first = default_speakers(docs.select("doc_id").distinct().join(speakers.select("doc_id").distinct(), "doc_id", "left_anti")).where("speaker_id = 0")
    return out.unionByName(first.withColumn("style", F.col("style").withField("box", F.col("style.box").withField("y", F.least(F.lit(0.90), F.col("style.box.y") + 0.06)))))


def whole_video(overlays: DataFrame, which: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return overlays.withColumn("start_ms", F.when(which, zero).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(which, zero).otherwise(F.col("end_ms")))


def edit(overlays: DataFrame, which: Column, **fields: Column) -> DataFrame:
    """Sets fields of the rows `which`; start_s and end_s are whole seconds, opacity stays within 0..1. Other fields aren't touched."""
    for seconds, ms in (("start_s", "start_ms"), ("end_s", "end_ms")):
        if seconds in fields:
            fields[ms] = (fields.pop(seconds).cast("bigint") * 1000).cast("bigint")
    if "opacity" in fields:
        fields["opacity"] = F.least(F.greatest(fields["opacity"], F.lit(0.0)), F.lit(1.0))
    marked = overlays.withColumn("__w", which)
    for name, value in fields.items():
        marked = marked.withColumn(name, F.when(F.col("__w"), value).otherwise(F.col(name)))
    return marked.drop("__w")


def style_problems(rows: DataFrame) -> DataFrame:
    """rows with the names of style fields that are out of their domain."""
    bad = [F.when(~F.col(f"style.{n}").between(lo, hi), F.lit(n)) for n, (lo, hi) in DOMAINS.items()]  # bounds belong to the domain
    return rows.withColumn("problems", F.filter(F.array(*bad), lambda x: x.isNotNull()))


def ensure_highlight(highlights: DataFrame, words: DataFrame, color: str = "#ff1e6fe8") -> DataFrame:
    """highlights (doc_id, word, color, bold) and default ones for the words (doc_id, word) that have none."""
    new = words.select("doc_id", T.normal_word(F.col("word")).alias("word")).where("word <> ''").distinct()
    have = highlights.select("doc_id", T.normal_word(F.col("word")).alias("word"))
    return highlights.unionByName(new.join(have, ["doc_id", "word"], "left_anti").select("doc_id", "word", F.lit(color).alias("color"), F.lit(False).alias("bold")))


def part_list(parts: DataFrame, extension: str = "tmproj") -> DataFrame:
    """part_idx, label of parts (part_idx, path), numbered in order."""
    kind = F.when(T.is_project(F.col("path"), extension), "project").otherwise("video")
    return before(parts, "part_idx", F.lit(1)).select("part_idx", F.concat((F.col("before") + 1).cast("string"), F.lit(". "), F.regexp_extract("path", r"[^/\\]*$", 0), F.lit(" ["), kind, F.lit("]")).alias("label"))


def move_part(parts: DataFrame, at: int, delta: int) -> DataFrame:
    """The part at a place swapped with the one delta places on; unchanged where there is none."""
    to = at + delta
    there = F.broadcast(parts.agg((F.count_if(F.col("part_idx").isin([at, to])) == 2).alias("__both")))  # one row
    both = F.col("__both")
    return parts.crossJoin(there).withColumn("part_idx", F.when(both & (F.col("part_idx") == at), to).when(both & (F.col("part_idx") == to), at).otherwise(F.col("part_idx"))).drop("__both")


def without_parts(parts: DataFrame, which: Column) -> DataFrame:
    """The parts but those `which`, renumbered in order from 0."""
    left = before(parts.where(~F.coalesce(which, F.lit(False))), "part_idx", F.lit(1))
    return left.withColumn("part_idx", F.col("before").cast(dict(parts.dtypes)["part_idx"])).select(*parts.columns)


def part_problems(spark: SparkSession, paths: list[str], output: str) -> list[str]:
    """What keeps the parts from being joined, found before any work."""
    found = [] if paths else ["there are no parts"]
    found += [] if output else ["there is no output"]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(conf).exists(path):
            found.append(f"missing: {p}")
    return found


def tooltip(needs_review: Column, reason: Column, confidence: Column, echo: Column) -> Column:
    first = F.when(needs_review & (reason != ""), F.concat(reason, F.lit("\nPlay the line and choose its speaker."))).otherwise(F.concat(F.lit("Confidence "), F.format_number(confidence.cast("double"), 2)))
    return F.concat_ws("\n", first, F.when(echo, F.lit("Holds the pair while its translation is spoken.")))


def dump_lines(segments: DataFrame) -> DataFrame:
    """doc_id, seg_idx, line_no, line: the segment table as text, a translation on a line of its own."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, " ")
    head = F.concat_ws("  ", pad(F.col("seg_idx") + 1, 3), T.format_stamp(F.col("start_ms")), T.format_stamp(F.col("end_ms")), pad(F.col("speaker_id"), 3), F.format_number(F.col("confidence").cast("double"), 2), F.concat(F.when(F.col("needs_review"), "[review] ").otherwise(""), F.col("text")))
    lines = F.when(F.col("translation") != "", F.array(head, F.concat(F.lit("    -> "), F.col("translation")))).otherwise(F.array(head))
    return segments.select("doc_id", "seg_idx", F.posexplode(lines).alias("line_no", "line"))


def provider(rows: DataFrame, providers: DataFrame, default: str) -> DataFrame:
    """rows (provider_id) with the provider's columns; ids compare without case, an unknown one is the default."""
    known = providers.withColumn("__k", F.lower("id"))
    keyed = rows.withColumn("__k", F.lower("provider_id")).join(known.select("__k", F.lit(True).alias("__hit")), "__k", "left")
    return keyed.withColumn("__k", F.when(F.col("__hit"), F.col("__k")).otherwise(F.lit(default.lower()))).drop("__hit").join(known, "__k", "left").drop("__k")


def nested_reply(reply: Column) -> Column:
    """[[["translated", ...], ...], ...]: the first strings of the first list's chunks, joined; null when it isn't that."""
    first = F.get_json_object(reply, "$[0]")
    return F.trim(F.array_join(F.transform(F.from_json(first, "array<string>"), lambda c: F.coalesce(F.get_json_object(c, "$[0]"), F.lit(""))), ""))


def object_reply(reply: Column) -> Column:
    return F.trim(F.get_json_object(reply, "$.responseData.translatedText"))


def prompt(lines: Column, target: Column) -> Column:
    """A batch as a request for as many strings."""
    n = F.size(lines).cast("string")
    return F.concat(F.lit("Translate these "), n, F.lit(" subtitle lines to "), T.language_name(target), F.lit('. Answer with a JSON object {"translations": [...]} of '), n, F.lit(" strings in order.\n"), F.to_json(lines))


def any_assigned(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.bool_or(F.col("speaker_id") >= 0).alias("assigned"))
