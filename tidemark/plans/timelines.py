"""Queries on the timeline, interval joins, frames, speakers, pairs, vectors, samples and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import frames as V
from tidemark.operators import intervals as J
from tidemark.operators import segments as S
from tidemark.operators import signal as A
from tidemark.operators import speakers as P
from tidemark.operators import timeline as L
from tidemark.operators import translations as R
from tidemark.operators import vectors as E
from tidemark.operators.lineage import cut, parts_of
from tidemark.plans import fixtures as X
from tidemark.plans.captions import MERGED_SQL
from tidemark.sources import project, subtitles

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(*parts: str, recursive: bool = True):  # noqa: ANN201
    """Registers a query; the last part is the oracle's SELECT, those before are its CTEs."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if parts:
            ORACLE_SQL[f.__name__] = (X.with_sql(*parts[:-1], recursive=recursive) if parts[:-1] else "") + parts[-1]
        return f

    return add


# ---- inputs ----
LENGTHS = "lengths AS (SELECT doc_id, max(end_ms) AS d FROM segs GROUP BY doc_id)"
POINTS = "points AS (SELECT DISTINCT doc_id, ms::BIGINT AS ms FROM (SELECT doc_id, unnest(range(0, d + 1, 500)) AS ms FROM lengths UNION ALL SELECT doc_id, start_ms + o FROM segs, (VALUES (-71), (-70), (0), (70), (71)) AS v(o)) WHERE ms >= 0)"
SCENES = "scenes AS (SELECT doc_id, i::INTEGER AS scene_idx, d * i // 7 AS start_ms, d * (i + 1) // 7 AS end_ms FROM lengths, range(7) AS r(i) UNION ALL SELECT doc_id, 7, d // 3, d * 2 // 3 FROM lengths)"
OVERLAYS = "overlays AS (SELECT doc_id, i::INTEGER AS overlay_idx, i = 1 OR i = 2 AS on_top, i < 3 AS enabled, CASE WHEN i = 2 THEN d // 2 ELSE 0 END AS start_ms, CASE WHEN i = 1 THEN 5000 ELSE 0 END AS end_ms FROM lengths, range(4) AS r(i))"
ACTIVE = """
gaps AS (SELECT *, start_ms - lag(end_ms) OVER w AS gb, lead(start_ms) OVER w - end_ms AS ga FROM segs WINDOW w AS (PARTITION BY doc_id ORDER BY seg_idx)),
edges AS (SELECT *, CASE WHEN gb IS NULL OR gb >= 70 THEN start_ms - 70.0::DOUBLE ELSE start_ms::DOUBLE END AS a, start_ms + 70.0::DOUBLE AS b, end_ms - 70.0::DOUBLE AS c, CASE WHEN ga IS NULL OR ga >= 70 THEN end_ms + 70.0::DOUBLE ELSE end_ms::DOUBLE END AS d FROM gaps),
ramps AS (SELECT p.doc_id, ms, seg_idx, least(greatest((ms - a) / greatest(b - a, 1.0), 0.0), 1.0) AS x, least(greatest((d - ms) / greatest(d - c, 1.0), 0.0), 1.0) AS y FROM points p JOIN edges e ON p.doc_id = e.doc_id AND e.start_ms - 70 <= ms AND ms < e.end_ms + 70),
active AS (SELECT doc_id, ms, seg_idx, least(x * x * (3 - 2 * x), y * y * (3 - 2 * y)) AS alpha FROM ramps WHERE least(x * x * (3 - 2 * x), y * y * (3 - 2 * y)) > 0.002)"""
SHOWN = """
oramps AS (SELECT p.doc_id, ms, overlay_idx, on_top, enabled, start_ms, end_ms, least(greatest((ms - start_ms + 70.0::DOUBLE) / 140.0::DOUBLE, 0.0), 1.0) AS x, least(greatest((end_ms + 70.0::DOUBLE - ms) / 140.0::DOUBLE, 0.0), 1.0) AS y FROM points p JOIN overlays o ON p.doc_id = o.doc_id),
oalpha AS (SELECT *, CASE WHEN NOT enabled THEN 0.0 WHEN start_ms <= 0 AND end_ms <= 0 THEN 1.0 ELSE least(x * x * (3 - 2 * x), CASE WHEN end_ms > 0 THEN y * y * (3 - 2 * y) ELSE 1.0 END) END AS alpha FROM oramps),
shown AS (SELECT * FROM oalpha WHERE alpha > 0.002)"""
WINDOWS = "windows AS (SELECT doc_id, 750 + 250 * k AS center_ms, ((750 + 250 * k) // 4000 % 2)::INTEGER AS label FROM (SELECT doc_id, unnest(range(0, (d - 1500) // 250 + 1)) AS k FROM lengths WHERE d >= 1500))"
SEGS = (*X.TO_SEGMENTS, LENGTHS)


def lengths(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.max("end_ms").alias("duration_ms"))


def points(segments: DataFrame) -> DataFrame:
    grid = lengths(segments).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("duration_ms"), F.lit(500).cast("bigint"))).alias("ms"))
    near = segments.select("doc_id", F.explode(F.transform(F.array(*map(F.lit, (-71, -70, 0, 70, 71))), lambda o: F.col("start_ms") + o)).alias("ms"))
    return J.bucketed(grid.unionByName(near).where("ms >= 0"), parts_of(segments)).distinct()


def scenes(segments: DataFrame) -> DataFrame:
    d = lengths(segments)
    blank = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("scene_idx"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"))
    return L.auto_layout(blank, d).unionByName(d.selectExpr("doc_id", "7 AS scene_idx", "duration_ms div 3 AS start_ms", "duration_ms * 2 div 3 AS end_ms"))


def overlays(segments: DataFrame) -> DataFrame:
    rows = lengths(segments).select("doc_id", "duration_ms", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("overlay_idx"))
    return rows.selectExpr("doc_id", "overlay_idx", "overlay_idx in (1, 2) AS on_top", "overlay_idx < 3 AS enabled", "if(overlay_idx = 2, duration_ms div 2, 0L) AS start_ms", "if(overlay_idx = 1, 5000L, 0L) AS end_ms")


def windows(segments: DataFrame) -> DataFrame:
    rows = lengths(segments).where("duration_ms >= 1500").select("doc_id", F.explode(F.expr("sequence(0L, (duration_ms - 1500) div 250)")).alias("k"))
    return rows.selectExpr("doc_id", "750 + 250 * k AS center_ms", "cast((750 + 250 * k) div 4000 % 2 AS int) AS label")


# ---- sources ----
@query(*X.TO_WORDS[:1], "SELECT doc_id, cue_idx, start_ms, end_ms, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cue_idx) AS r FROM cues) WHERE text <> ''")
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.parse(subtitles.render(X.cues(spark, sf_dir)), "doc_id")


@query(*X.TO_SEGMENTS, MERGED_SQL, "SELECT * FROM merged")
def project_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = project.from_json(project.to_json(S.merge_runs(X.segments(spark, sf_dir))))
    return rows.select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_id", F.size("merged_from").alias("pieces"))


@query(*X.TO_SEGMENTS, "stamps AS (SELECT *, [start_ms, end_ms] AS t FROM segs)", """SELECT doc_id, seg_idx + 1 AS row, list_transform(t, lambda g: lpad((g // 3600000)::VARCHAR, 2, '0') || ':' || lpad((g // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((g // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((g % 1000)::VARCHAR, 3, '0')) AS times,
  CASE speaker_id WHEN 0 THEN 'Speaker 1' WHEN 1 THEN 'Speaker 2' ELSE '(unassigned)' END AS speaker, text, '' AS translation FROM stamps""")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.with_speaker(X.segments(spark, sf_dir), speakers(spark, sf_dir))
    return rows.select("doc_id", (F.col("seg_idx") + 1).alias("row"), F.array(T.format_stamp(F.col("start_ms")), T.format_stamp(F.col("end_ms"))).alias("times"), F.coalesce("speaker", F.lit("(unassigned)")).alias("speaker"), "text", "translation")


# ---- timeline ----
@query("e AS (SELECT user_id AS doc_id, event_id, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + floor(value * 60000)::BIGINT AS end_ms, event_type AS text FROM events)", "SELECT doc_id, row_number() OVER w - 1 AS idx, start_ms, greatest(start_ms, least(end_ms, coalesce(lead(start_ms) OVER w, end_ms))) AS end_ms, text FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY start_ms, event_id)")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.normalise(X.intervals(spark, sf_dir), "idx").withColumn("idx", F.col("idx").cast("bigint"))


@query(*SEGS, SCENES, "SELECT * FROM scenes")
def scene_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes(cut(X.segments(spark, sf_dir)))


@query(*SEGS, "SELECT s.doc_id, seg_idx, start_ms + o AS start_ms, end_ms + o AS end_ms FROM segs s JOIN (SELECT doc_id, coalesce(sum(d) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM lengths) p ON s.doc_id = p.doc_id")
def stitch_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    parts = rows.join(lengths(rows), "doc_id").withColumn("part_idx", F.col("doc_id"))
    return L.stitch(parts).select("doc_id", "seg_idx", "start_ms", "end_ms")


@query(*SEGS, "SELECT doc_id, seg_idx, CASE WHEN seg_idx % 5 = 0 THEN 1 ELSE speaker_id END::INTEGER AS speaker_id, CASE WHEN seg_idx % 5 = 0 THEN 1.0 ELSE 0.0 END::FLOAT AS confidence FROM segs")
def bulk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    return L.assign_speaker(rows, rows.where("seg_idx % 5 = 0"), 1).select("doc_id", "seg_idx", "speaker_id", "confidence")


@query(*SEGS, "SELECT doc_id, seg_idx, CASE WHEN seg_idx % 4 = 1 THEN 1500 ELSE start_ms END AS start_ms, CASE WHEN seg_idx % 4 = 1 THEN -5 ELSE end_ms END AS end_ms, CASE WHEN seg_idx % 4 = 1 THEN 'new ' || seg_idx ELSE text END AS text, CASE WHEN seg_idx % 8 = 1 THEN 0 ELSE speaker_id END::INTEGER AS speaker_id, CASE WHEN seg_idx % 8 = 1 THEN 1.0 ELSE 0.0 END::FLOAT AS confidence FROM segs")
def edit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    edits = rows.where("seg_idx % 4 = 1").select("doc_id", "seg_idx", F.lit("00:00:01,5").alias("start"), F.lit(" -5 ").alias("end"), F.expr("if(seg_idx % 8 = 1, 0, null)").alias("speaker_id"), F.concat(F.lit("new "), F.col("seg_idx").cast("string")).alias("text"), F.lit(None).cast("string").alias("translation"))
    return L.edit_cells(rows, edits).select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_id", "confidence")


# ---- interval joins and frames ----
@query(*SEGS, POINTS, "SELECT p.doc_id, ms, coalesce(max(seg_idx), -1)::INTEGER AS seg_idx FROM points p LEFT JOIN segs s ON s.doc_id = p.doc_id AND s.start_ms <= ms AND ms < s.end_ms GROUP BY p.doc_id, ms")
def segment_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    return J.segment_at(points(rows), rows, parts_of(rows))


@query(*SEGS, POINTS, SCENES, "SELECT p.doc_id, ms, coalesce(max(scene_idx), -1)::INTEGER AS scene_idx FROM points p LEFT JOIN scenes s ON s.doc_id = p.doc_id AND s.start_ms <= ms AND ms < s.end_ms GROUP BY p.doc_id, ms")
def scene_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    return J.scene_at(points(rows), scenes(rows), parts_of(rows))


@query(*SEGS, POINTS, ACTIVE, "SELECT doc_id, ms, seg_idx, round(alpha, 9) AS alpha FROM active")
def active_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    return V.active_segments(points(rows), rows, parts=parts_of(rows)).withColumn("alpha", F.round("alpha", 9))


STATES = """
captions AS (SELECT doc_id, ms, string_agg(seg_idx || ':' || floor(alpha * 255 + 0.5)::INTEGER, ',' ORDER BY seg_idx) AS c FROM active GROUP BY doc_id, ms),
pinned AS (SELECT doc_id, ms, string_agg(overlay_idx || ':' || floor(alpha * 255 + 0.5)::INTEGER, ',' ORDER BY overlay_idx) AS o FROM shown GROUP BY doc_id, ms),
picked AS (SELECT p.doc_id, ms, coalesce(max(scene_idx), -1) AS scene FROM points p LEFT JOIN scenes s ON s.doc_id = p.doc_id AND s.start_ms <= ms AND ms < s.end_ms GROUP BY p.doc_id, ms),
states AS (SELECT doc_id, ms, scene || '|' || coalesce(c, '') || '|' || coalesce(o, '') AS state FROM picked LEFT JOIN captions USING (doc_id, ms) LEFT JOIN pinned USING (doc_id, ms))"""
FRAMES = "points AS (SELECT doc_id, f * 1000 // 5 AS ms FROM (SELECT doc_id, unnest(range(0, (d * 5 + 999) // 1000)) AS f FROM lengths))"


@query(*SEGS, FRAMES, SCENES, OVERLAYS, ACTIVE, SHOWN, STATES, "SELECT doc_id, ms, state FROM (SELECT *, lag(state) OVER (PARTITION BY doc_id ORDER BY ms) AS p FROM states) WHERE p IS NULL OR p <> state")
def frame_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    clock = V.frame_clock(lengths(rows), 5).select("doc_id", "ms")
    parts = parts_of(rows)
    return V.changed_frames(V.frame_states(clock, rows, scenes(rows), overlays(rows), parts=parts), parts)


@query(*SEGS, POINTS, SCENES, OVERLAYS, ACTIVE, SHOWN, "SELECT doc_id, ms, layer, seg_idx AS item, round(alpha, 9) AS alpha FROM active, (VALUES (2), (3)) AS v(layer) WHERE layer = 2 OR seg_idx % 3 = 0 UNION ALL SELECT doc_id, ms, CASE WHEN on_top THEN 4 ELSE 1 END, overlay_idx, round(alpha, 9) FROM shown UNION ALL SELECT p.doc_id, ms, 0, max(scene_idx), 1.0 FROM points p JOIN scenes s ON s.doc_id = p.doc_id AND s.start_ms <= ms AND ms < s.end_ms GROUP BY p.doc_id, ms")
def draw_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    told = rows.withColumn("translation", F.expr("if(seg_idx % 3 = 0, lower(text), '')"))
    return V.draw_plan(points(rows), told, scenes(rows), overlays(rows), parts=parts_of(rows)).withColumn("alpha", F.round("alpha", 9))


def marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "The", "#ff1e6fe8", False), (1, "and,", "#ff00aa00", True), (2, "the", "#ffaa0000", True), (3, "--", "#ff000000", False), (4, "die", "#ff0000aa", False), (5, "la", "#ff0000aa", True)], "highlight_idx int, word string, color string, bold boolean")


MARKS = "marks AS (SELECT * FROM (VALUES ('the', '#ff1e6fe8', false), ('and', '#ff00aa00', true), ('die', '#ff0000aa', false), ('la', '#ff0000aa', true)) AS m(key, color, bold))"


@query(MARKS, r"tok AS (SELECT conv_id AS doc_id, turn::INTEGER AS seg_idx, unnest(w) AS t, (generate_subscripts(w, 1) - 1)::INTEGER AS pos FROM (SELECT *, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda t: t <> '') AS w FROM conversations))",
       r"cut AS (SELECT *, regexp_extract(t, '^[^\p{L}\p{N}]*') AS prefix FROM tok)", r"ends AS (SELECT *, t[length(prefix) + 1:] AS rest, regexp_extract(t[length(prefix) + 1:], '[^\p{L}\p{N}]*$') AS suffix FROM cut)",
       r"SELECT doc_id, seg_idx, pos, prefix, rest[:length(rest) - length(suffix)] AS core, suffix, color, coalesce(bold, false) AS bold FROM ends LEFT JOIN marks ON key = lower(rest[:length(rest) - length(suffix)])")
def highlight_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seg_idx"), "text")
    return V.highlight_tokens(rows, marks(spark))


@query(r"""SELECT * FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations), (VALUES ('the', '#ff1e6fe8', false), ('and', '#ff111111', false), ('neu', '#ff222222', true)) AS v(word, color, bold)""")
def highlight_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    have = docs.crossJoin(F.broadcast(spark.createDataFrame([("the", "#ff1e6fe8", False), ("and", "#ff00aa00", True), ("gone", "#ff000000", True)], "word string, color string, bold boolean")))
    new = docs.crossJoin(F.broadcast(spark.createDataFrame([("(And)", "#ff111111", False), ("Neu!", "#ff222222", True), ("--", "#ff333333", True)], "word string, color string, bold boolean")))
    return L.remove_highlights(L.upsert_highlights(have, new), docs.withColumn("word", F.lit("Gone?")))


@query(r"parts AS (SELECT conv_id AS doc_id, turn AS seg_idx, unnest(p) AS part, generate_subscripts(p, 1) AS pi FROM (SELECT *, string_split(text, chr(10)) AS p FROM conversations))",
       r"tok AS (SELECT doc_id, seg_idx, pi, list_filter(string_split_regex(part, '[\s\p{Z}]+'), lambda t: t <> '') AS w FROM parts)",
       "walk AS (SELECT doc_id, seg_idx, pi, w, 1 AS i, w[1] AS line, 1 AS n, w[1] AS done, false AS closed FROM tok WHERE len(w) > 0 UNION ALL SELECT doc_id, seg_idx, pi, w, i + 1, CASE WHEN length(line) + 1 + length(w[i + 1]) <= 40 THEN line || ' ' || w[i + 1] ELSE w[i + 1] END, CASE WHEN length(line) + 1 + length(w[i + 1]) <= 40 THEN n ELSE n + 1 END, '', false FROM walk WHERE i < len(w))",
       "SELECT doc_id, seg_idx::INTEGER AS seg_idx, (row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY pi, n) - 1)::INTEGER AS line_idx, line FROM (SELECT doc_id, seg_idx, pi, n, arg_max(line, i) AS line FROM walk GROUP BY doc_id, seg_idx, pi, n)")
def line_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("seg_idx"), "text")
    return V.wrap(rows, 40, ["doc_id", "seg_idx"])


# ---- speakers ----
def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("speaker_id")).withColumn("name", F.concat(F.lit("Speaker "), (F.col("speaker_id") + 1).cast("string")))


@query(*SEGS, "SELECT doc_id, seg_idx, CASE speaker_id WHEN 1 THEN 'Speaker 2' ELSE 'Speaker 1' END AS speaker FROM segs")
def speaker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.with_speaker(X.segments(spark, sf_dir), speakers(spark, sf_dir), fallback=True).select("doc_id", "seg_idx", "speaker")


@query("SELECT DISTINCT conv_id AS doc_id, i::INTEGER AS speaker_id, 'Speaker ' || (i + 1) AS name FROM conversations, range(5) AS r(i) WHERE i < 2 OR i < 2 + conv_id % 4")
def extend_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = speakers(spark, sf_dir)
    return L.extend_speakers(have, have.select("doc_id", (F.col("doc_id") % 4 + 2).alias("n")).distinct())


VOTES = """
inside AS (SELECT s.doc_id, seg_idx, label, count(*) AS n FROM segs s JOIN windows w ON s.doc_id = w.doc_id AND s.start_ms <= center_ms AND center_ms < s.end_ms GROUP BY s.doc_id, seg_idx, label),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY doc_id, seg_idx) AS total, coalesce(lead(n) OVER (PARTITION BY doc_id, seg_idx ORDER BY n DESC, label), 0) AS second FROM inside),
near AS (SELECT s.doc_id, seg_idx, arg_min(label, abs(center_ms - (start_ms + end_ms) // 2) * 10000000 + center_ms) AS label FROM segs s JOIN windows w ON s.doc_id = w.doc_id GROUP BY s.doc_id, seg_idx),
votes AS (SELECT n.doc_id, n.seg_idx, coalesce(r.label, n.label)::INTEGER AS label, coalesce((r.n - r.second) / r.total, 0.0)::DOUBLE AS confidence FROM near n LEFT JOIN ranked r ON r.doc_id = n.doc_id AND r.seg_idx = n.seg_idx AND r.r = 1)"""


@query(*SEGS, WINDOWS, VOTES, "SELECT doc_id, seg_idx, label, round(confidence, 9) AS confidence FROM votes")
def segment_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    return P.segment_votes(rows, windows(rows), parts_of(rows)).withColumn("confidence", F.round("confidence", 9))


SEG_SCORES = ("scored_input AS (SELECT * FROM segs)", X.SCORES_SQL)
ASSIGNED = """
joined AS (SELECT s.*, coalesce(v.label, 0) AS label, coalesce(v.confidence, 0.0) AS confidence FROM scores s LEFT JOIN votes v USING (doc_id, seg_idx)),
sums AS (SELECT doc_id, round(sum(CASE WHEN label = 0 THEN score ELSE 0.0 END), 9) AS s0, round(sum(CASE WHEN label = 1 THEN score ELSE 0.0 END), 9) AS s1, sum(abs(score)) >= 0.5 * count(*) AND count(DISTINCT label) = 2 AS enough FROM joined GROUP BY doc_id),
known AS (SELECT doc_id, enough AND s0 * s1 < 0 AS known, enough AND s0 * s1 < 0 AND s0 < s1 AS swap FROM sums),
named AS (SELECT j.doc_id, seg_idx, (CASE WHEN swap THEN 1 - label ELSE label END)::INTEGER AS speaker_id, confidence, score, known FROM joined j JOIN known k ON j.doc_id = k.doc_id)"""
ASSIGNMENT = f"""SELECT doc_id, seg_idx, speaker_id, CASE WHEN known AND abs(score) >= 0.5 AND (CASE WHEN score > 0 THEN 0 ELSE 1 END) <> speaker_id THEN '{P.OTHER_LANGUAGE.replace("'", "''")}' WHEN confidence::FLOAT < 0.6::FLOAT THEN '{P.UNSURE}' ELSE '' END AS review_reason FROM named"""


@query(*SEGS, WINDOWS, VOTES, *SEG_SCORES, ASSIGNED, ASSIGNMENT)
def assign_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    return P.assign(rows, P.segment_votes(rows, windows(rows), parts_of(rows))).select("doc_id", "seg_idx", "speaker_id", "review_reason")


@query()
def text_only_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.text_only(X.language_rows(spark, sf_dir)).select("doc_id", "seg_idx", "speaker_id", F.round(F.col("confidence").cast("double"), 5).alias("confidence"), "needs_review")


ORACLE_SQL["text_only_speakers"] = X.with_sql(X.LANGUAGE_ROWS_SQL, "scored_input AS (SELECT * FROM lrows)", X.SCORES_SQL) + "SELECT doc_id, seg_idx, CASE WHEN score >= 0 THEN 0 ELSE 1 END::INTEGER AS speaker_id, round(least(abs(score), 1.0)::FLOAT::DOUBLE, 5) AS confidence, abs(score) < 0.34 AS needs_review FROM scores"

SPLIT = """
mids AS (SELECT w.doc_id, seg_idx, word_idx, w.start_ms AS ws, w.end_ms AS we, w.text AS word, (w.start_ms + w.end_ms) // 2 AS m FROM words w JOIN segs s ON s.doc_id = w.doc_id AND s.start_ms <= (w.start_ms + w.end_ms) // 2 AND (w.start_ms + w.end_ms) // 2 < s.end_ms),
labelled AS (SELECT m.doc_id, seg_idx, word_idx, ws, we, word, arg_min(label, abs(center_ms - m) * 10000000 + center_ms) AS label FROM mids m JOIN windows w ON w.doc_id = m.doc_id GROUP BY ALL),
marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg_idx ORDER BY word_idx) AS i, count(*) OVER (PARTITION BY doc_id, seg_idx) AS n, coalesce((lag(label) OVER (PARTITION BY doc_id, seg_idx ORDER BY word_idx) <> label)::INTEGER, 0) AS c FROM labelled),
single AS (SELECT doc_id, seg_idx, max(CASE WHEN c = 1 THEN i END) AS cutat FROM marked GROUP BY doc_id, seg_idx HAVING sum(c) = 1 AND max(n) >= 4 AND max(CASE WHEN c = 1 THEN i END) - 1 >= 2 AND max(n) - max(CASE WHEN c = 1 THEN i END) + 1 >= 2),
halves AS (SELECT m.doc_id, m.seg_idx, (i >= cutat)::INTEGER AS k, min(ws) AS ws, max(we) AS we, string_agg(word, ' ' ORDER BY word_idx) AS text, min(label)::INTEGER AS speaker_id FROM marked m JOIN single s ON s.doc_id = m.doc_id AND s.seg_idx = m.seg_idx GROUP BY ALL),
both_ AS (SELECT s.doc_id, s.seg_idx, 0 AS k, start_ms, end_ms, text, speaker_id FROM segs s WHERE NOT EXISTS (SELECT 1 FROM single x WHERE x.doc_id = s.doc_id AND x.seg_idx = s.seg_idx)
  UNION ALL SELECT h.doc_id, h.seg_idx, k, CASE WHEN k = 0 THEN s.start_ms ELSE ws END, CASE WHEN k = 0 THEN we ELSE s.end_ms END, h.text, h.speaker_id FROM halves h JOIN segs s ON s.doc_id = h.doc_id AND s.seg_idx = h.seg_idx)"""


@query(*SEGS, WINDOWS, SPLIT, "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, k) - 1)::INTEGER AS seg_idx, start_ms, end_ms, text, speaker_id FROM both_")
def split_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(X.segments(spark, sf_dir))
    return P.split_on_change(rows, S.words_from_cues(X.cues(spark, sf_dir, parts_of(rows))), windows(rows), parts_of(rows)).select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_id")


# ---- translations ----
PAIRED = rf"""
scored_input AS (SELECT * FROM lrows),{X.SCORES_SQL},
lang AS (SELECT *, start_ms + 2000 AS end_ms, CASE WHEN score >= 0.34 THEN 'de' WHEN score <= -0.34 THEN 'en' ELSE '' END AS l FROM scores),
chg AS (SELECT *, coalesce((lag(l) OVER (PARTITION BY doc_id ORDER BY seg_idx) <> l)::INTEGER, 0) AS c FROM lang),
runs AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY seg_idx) AS run FROM chg),
pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY seg_idx) - 1 AS k FROM runs),
agg AS (SELECT doc_id, run, any_value(l) AS l, arg_max(end_ms, seg_idx) AS e, arg_min(start_ms, seg_idx) AS f FROM pos GROUP BY doc_id, run),
nx AS (SELECT *, l = 'de' AND lead(l) OVER w = 'en' AND lead(f) OVER w - e BETWEEN 0 AND 4000 AS ok FROM agg WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
pr AS (SELECT a.doc_id, a.seg_idx AS g, b.seg_idx AS e FROM pos a JOIN nx ON nx.doc_id = a.doc_id AND nx.run = a.run AND nx.ok JOIN pos b ON b.doc_id = a.doc_id AND b.run = a.run + 1 AND b.k = a.k),
emit AS (SELECT s.doc_id, s.seg_idx * 2 AS o, s.start_ms, s.end_ms, s.text, coalesce(t.text, '') AS translation, coalesce(t.start_ms, 0) AS tstart, false AS echo, CASE WHEN t.text IS NOT NULL THEN 'paired' WHEN s.l = 'de' THEN 'unpaired' ELSE '' END AS outcome
    FROM pos s LEFT JOIN pr ON pr.doc_id = s.doc_id AND pr.g = s.seg_idx LEFT JOIN pos t ON t.doc_id = s.doc_id AND t.seg_idx = pr.e WHERE NOT EXISTS (SELECT 1 FROM pr x WHERE x.doc_id = s.doc_id AND x.e = s.seg_idx)
  UNION ALL SELECT s.doc_id, s.seg_idx * 2 + 1, t.start_ms, t.end_ms, s.text, t.text, t.start_ms, true, 'echo' FROM pr JOIN pos s ON s.doc_id = pr.doc_id AND s.seg_idx = pr.g JOIN pos t ON t.doc_id = pr.doc_id AND t.seg_idx = pr.e),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, o) AS i FROM emit),
fold AS (SELECT doc_id, i, o, start_ms, end_ms, text, translation, tstart, echo, outcome, i AS head, echo AS head_echo, end_ms AS head_end FROM ordered WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.o, n.start_ms, n.end_ms, n.text, n.translation, n.tstart, n.echo, n.outcome,
    CASE WHEN n.echo AND NOT f.head_echo AND n.text = f.text AND n.translation = f.translation AND n.start_ms <= f.head_end + 250 THEN f.head ELSE n.i END,
    CASE WHEN n.echo AND NOT f.head_echo AND n.text = f.text AND n.translation = f.translation AND n.start_ms <= f.head_end + 250 THEN false ELSE n.echo END, n.end_ms
  FROM fold f JOIN ordered n ON n.doc_id = f.doc_id AND n.i = f.i + 1),
paired AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1)::INTEGER AS seg_idx, arg_min(start_ms, i) AS start_ms, arg_max(end_ms, i) AS end_ms, arg_min(text, i) AS text, arg_min(translation, i) AS translation, arg_min(tstart, i)::BIGINT AS translation_start_ms, arg_min(echo, i) AS translation_echo, arg_min(outcome, i) AS outcome FROM fold GROUP BY doc_id, head)"""


@query(X.LANGUAGE_ROWS_SQL, PAIRED, "SELECT * FROM paired")
def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair(X.language_rows(spark, sf_dir)).select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "translation", "translation_start_ms", "translation_echo", "outcome")


@query(X.LANGUAGE_ROWS_SQL, PAIRED, "SELECT doc_id, sum((outcome = 'paired')::INTEGER)::BIGINT AS paired, sum((outcome = 'unpaired')::INTEGER)::BIGINT AS unpaired FROM paired GROUP BY doc_id")
def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair_report(R.pair(X.language_rows(spark, sf_dir)))


UNPAIRED = """
back AS (SELECT doc_id, seg_idx, 0 AS k, start_ms, CASE WHEN translation <> '' AND NOT translation_echo AND translation_start_ms > start_ms AND translation_start_ms < end_ms THEN translation_start_ms ELSE end_ms END AS end_ms, CASE WHEN translation_echo AND translation <> '' THEN translation ELSE text END AS text FROM paired
  UNION ALL SELECT doc_id, seg_idx, 1, translation_start_ms, end_ms, translation FROM paired WHERE translation <> '' AND NOT translation_echo AND translation_start_ms > start_ms AND translation_start_ms < end_ms)"""


@query(X.LANGUAGE_ROWS_SQL, PAIRED, UNPAIRED, "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx, k) - 1)::INTEGER AS seg_idx, start_ms, end_ms, text FROM back")
def unpair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unpair(R.pair(X.language_rows(spark, sf_dir)).drop("outcome")).select("doc_id", "seg_idx", "start_ms", "end_ms", "text")


@query(*SEGS, "SELECT doc_id, seg_idx, ((row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) - 1) // 20)::INTEGER AS batch_no FROM segs WHERE seg_idx % 3 <> 0")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir).withColumn("translation", F.expr("if(seg_idx % 3 = 0, 'done', '')"))
    return R.pending(rows).select("doc_id", "seg_idx", "batch_no")


def offline(lines: list[str]) -> list[str]:
    """A stand-in for a service: it refuses long lines."""
    if any(len(x) > 150 for x in lines):
        raise ValueError("too long")
    return [f"«{x}»" for x in lines]


@query(*SEGS, "SELECT doc_id, seg_idx, CASE WHEN length(text) <= 150 THEN '«' || text || '»' ELSE '' END AS translation FROM segs")
def translate_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.translate(X.segments(spark, sf_dir), offline).select("doc_id", "seg_idx", "translation")


# ---- vectors and samples ----
@query("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cosine_pairs(X.table(spark, sf_dir, "embeddings"), "label").withColumn("distance", F.round("distance", 6))


@query("d AS (SELECT a.vec_id, b.vec_id AS other, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)", "SELECT vec_id, other, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) = 1")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.nearest(X.table(spark, sf_dir, "embeddings"), "label")


@query()
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clusters(X.table(spark, sf_dir, "embeddings").withColumn("part", F.expr("cast(label * 100 + vec_id div 1000 as int)")), "part", most=4, limit=0.9)


SAMPLES = "samples AS (SELECT d AS doc_id, i, CASE WHEN i // 8000 % 3 = 2 THEN 0.0 ELSE ((i * 7919 * d) % 2001 - 1000) / 1000.0 END::DOUBLE AS v FROM range(1, 5) AS a(d), range(64000) AS b(i))"


def samples(spark: SparkSession) -> DataFrame:
    return spark.range(256_000).selectExpr("id div 64000 + 1 AS doc_id", "id % 64000 AS i").selectExpr("doc_id", "i", "if(i div 8000 % 3 = 2, 0D, ((i * 7919 * doc_id) % 2001 - 1000) / 1000) AS v")


@query(SAMPLES, "bounds AS (SELECT d AS doc_id, b::INTEGER AS bucket, 64000 * b // 1999 AS lo, greatest(64000 * (b + 1) // 1999, 64000 * b // 1999 + 1) AS hi FROM range(1, 5) AS x(d), range(1999) AS y(b))", "SELECT s.doc_id, bucket, min(v) AS low, max(v) AS high FROM bounds b JOIN samples s ON s.doc_id = b.doc_id AND lo <= i AND i < hi GROUP BY s.doc_id, bucket")
def waveform_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.peaks(samples(spark), 1999)


@query(SAMPLES, "fr AS (SELECT doc_id, i // 160 AS frame, sqrt(avg(v * v)) AS rms FROM samples GROUP BY ALL)", "sp AS (SELECT doc_id, frame, rms > 0.01 * max(rms) OVER (PARTITION BY doc_id) AS speech FROM fr)",
       "SELECT doc_id, w AS window_idx, w * 250 + 750 AS center_ms, count(*) AS frames, sum(speech::INTEGER)::BIGINT AS speech FROM sp, range((64000 - 24000) // 4000 + 1) AS r(w) WHERE frame >= w * 25 AND frame < w * 25 + 150 GROUP BY doc_id, w HAVING sum(speech::INTEGER) * 2 >= count(*)")
def vad_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark)
    return A.candidate_windows(A.voice_activity(A.energy(rows)), rows.groupBy("doc_id").agg((F.max("i") + 1).alias("total")))
