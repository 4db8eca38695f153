"""Queries on what is shown: dumps, tooltips, layouts, replies, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import overlays as O
from tidemark.operators import segments as S
from tidemark.operators import timeline as L
from tidemark.plans import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_STAMP = "lpad(({0} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({0} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({0} % 1000)::VARCHAR, 3, '0')"
_WIDE = "seg_idx % 4 = 0"


@query(X.with_sql(*X.TO_SEGMENTS, recursive=True) + f"""SELECT doc_id, seg_idx, 0 AS line_no, lpad((seg_idx + 1)::VARCHAR, 3, ' ') || '  ' || {_STAMP.format("start_ms")} || '  ' || {_STAMP.format("end_ms")} || '  ' || lpad(speaker_id::VARCHAR, 3, ' ') || '  ' || CASE WHEN {_WIDE} THEN '1.00' ELSE '0.00' END || '  ' || CASE WHEN {_WIDE} THEN '' ELSE '[review] ' END || text AS line FROM segs
UNION ALL SELECT doc_id, seg_idx, 1, '    -> ' || lower(text) FROM segs WHERE seg_idx % 3 = 0""")  # fmt: skip
def dump_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir).withColumn("needs_review", ~F.expr(_WIDE)).withColumn("confidence", F.expr(f"cast(if({_WIDE}, 1, 0) as float)"))
    return O.dump_lines(rows.withColumn("translation", F.expr("if(seg_idx % 3 = 0, lower(text), '')")))


@query(X.with_sql(*X.TO_SEGMENTS, recursive=True) + "SELECT doc_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN 'why' || chr(10) || 'Play the line and choose its speaker.' ELSE 'Confidence 0.00' END || CASE WHEN seg_idx % 3 = 0 THEN chr(10) || 'Holds the pair while its translation is spoken.' ELSE '' END AS note FROM segs")
def tooltips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    return rows.select("doc_id", "seg_idx", O.tooltip(F.expr("seg_idx % 2 = 0"), F.lit("why"), F.col("confidence"), F.expr("seg_idx % 3 = 0")).alias("note"))


@query("SELECT doc_id, name, (CASE WHEN doc_id % 2 = 0 THEN wide ELSE tall END)::DOUBLE AS y FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations), (VALUES ('Logo', 0.86, 0.88), ('Subscribe', 0.88, 0.89), ('Title', 0.0, 0.0), ('pic', 0.4, 0.4)) AS v(name, wide, tall)")
def default_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    path = docs.withColumn("image_path", F.lit("/a/b/pic.v1.png"))
    rows = O.image_overlays(path, "Logo").unionByName(O.image_overlays(path, "Subscribe")).unionByName(O.title_overlays(docs.withColumn("text", F.lit(" T ")))).unionByName(O.image_overlays(path).withColumn("name", F.lit("pic")))
    return O.default_layout(rows, F.col("doc_id") % 2 == 1).select("doc_id", "name", F.col("style.box.y").alias("y"))


@query("SELECT DISTINCT conv_id AS doc_id, i::INTEGER AS speaker_id, 'Speaker ' || (i + 1) AS name, round(CASE i WHEN 0 THEN 0.44 WHEN 1 THEN 0.5 ELSE 0.56 END, 6)::DOUBLE AS y FROM conversations, range(3) AS r(i)")
def added_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    rows = O.add_speaker(O.speaker_layout(O.default_speakers(docs), F.lit(False)))
    return rows.select("doc_id", "speaker_id", "name", F.round("style.box.y", 6).alias("y"))


@query("SELECT doc_id, turn, text FROM (SELECT conv_id AS doc_id, turn, trim(text, ' ') AS text FROM conversations)")
def decoded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.expr("length(text) div 2")
    chunks = F.array(F.array(F.substr("text", F.lit(1), half), F.lit("x")), F.array(F.substr("text", half + 1, F.length("text")), F.lit("y")))
    rows = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.to_json(F.array(chunks)).alias("a"), F.to_json(F.struct(F.struct(F.col("text").alias("translatedText")).alias("responseData"))).alias("b"))
    return rows.select("doc_id", "turn", F.when(F.col("turn") % 2 == 0, O.nested_reply(F.col("a"))).otherwise(O.object_reply(F.col("b"))).alias("text"))


@query("SELECT part_idx, row_number() OVER (ORDER BY part_idx) || '. ' || CASE WHEN part_idx % 3 = 0 THEN 'p' || part_idx || '.TmProj [project]' ELSE 'p' || part_idx || '.mp4 [video]' END AS label FROM (SELECT DISTINCT conv_id AS part_idx FROM conversations)")
def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("part_idx")).distinct()
    return O.part_list(parts.withColumn("path", F.concat(F.lit("/x/y\\p"), F.col("part_idx").cast("string"), F.expr("if(part_idx % 3 = 0, '.TmProj', '.mp4')"))))


@query("SELECT conv_id AS doc_id, turn::INTEGER AS cue_idx, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '[\\s\\p{Z}]+'), lambda t: lower(regexp_replace(t, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'))), lambda w: w <> ''))), ' ') AS words FROM conversations")
def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("cue_idx"), F.array_join(F.array_sort(S.distinct_words(F.col("text"))), " ").alias("words"))


@query(X.with_sql(*X.TO_SEGMENTS, recursive=True) + "SELECT doc_id, greatest(max(end_ms), (doc_id % 5) * 100000, 1)::BIGINT AS duration_ms FROM segs GROUP BY doc_id")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir)
    scenes = rows.select("doc_id", F.lit(10).cast("bigint").alias("end_ms"))
    return L.duration(rows, scenes, rows.select("doc_id", (F.col("doc_id") % 5 * 100_000).alias("audio_ms")).distinct())
