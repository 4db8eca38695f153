"""Caption tables derived from the test tables, in Spark and, as CTEs, in SQL. Integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import segments as S
from tidemark.operators.lineage import dealt
from tidemark.operators.running import before

#: Characters of text (60 ms each) of one task, whatever the table's size.
CHARS = 2_000_000


def pieces(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that the conversations' rows are dealt to, by their characters; None where Spark's own number is enough."""
    chars = table(spark, sf_dir, "conversations").agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = -(-chars // CHARS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One cue a turn, 60 ms a character."""
    turns = Window.partitionBy("doc_id").orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("cue_idx"), T.collapse(F.col("text")).alias("text"), F.length("text").cast("bigint").alias("n"), "role")
    rows = dealt(rows, parts, "doc_id").withColumn("end_ms", 60 * F.sum("n").over(turns)).withColumn("start_ms", F.col("end_ms") - 60 * F.col("n"))
    return rows.select("doc_id", "cue_idx", "start_ms", "end_ms", "text", "role")


def speaker_of(role) -> F.Column:  # noqa: ANN001
    return F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the cues; the speaker is the role of the turn of the first word."""
    parts = pieces(spark, sf_dir)
    c = cues(spark, sf_dir, parts)
    rows = S.segments_from_cues(c, parts).join(c.select("doc_id", "cue_idx", speaker_of(F.col("role")).alias("speaker_id")), ["doc_id", "cue_idx"])
    return dealt(S.with_defaults(rows.drop("cue_idx")), parts, "doc_id")


def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of German and English lines: groups of two documents of each, 2 s a line."""
    docs = table(spark, sf_dir, "documents").where("lang in ('de', 'en')")
    rows = docs.select("lang", F.substr("text", F.lit(1), F.lit(200)).alias("text"), "doc_id")
    rows = before(rows, "doc_id", F.lit(1), ["lang"]).withColumn("r", F.col("before")).select("lang", "text", F.expr("cast(r div 2 as bigint)").alias("doc_id"), (F.col("r") % 2).alias("k"))
    full = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("doc_id")
    de = F.col("lang") == "de"
    seg = F.when(F.col("doc_id") % 2 == 0, 2 * F.col("k") + F.when(de, 0).otherwise(1)).otherwise(F.col("k") + F.when(de, 0).otherwise(2)).cast("int")
    rows = rows.join(full, "doc_id").withColumn("seg_idx", seg)
    late = F.when((F.col("doc_id") % 5 == 4) & (F.col("seg_idx") >= F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2)), 5000).otherwise(0)
    rows = rows.withColumn("start_ms", (F.col("seg_idx") * 2000 + late).cast("bigint")).withColumn("end_ms", F.col("start_ms") + 2000)
    return S.with_defaults(rows.withColumn("speaker_id", F.when(de, 0).otherwise(1)).select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_id"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping intervals of users' events."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), start.alias("start_ms"), (start + F.floor(F.col("value") * 60000)).alias("end_ms"), F.col("event_type").alias("text"))


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


SCORE_SQL = rf"""
list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda t: t <> '')"""
SCORES_SQL = rf"""
tok AS (SELECT *, {SCORE_SQL} AS toks FROM scored_input),
ev AS (SELECT *, coalesce(list_sum(list_transform(toks, lambda t: (CASE WHEN t IN ({_in(T.GERMAN)}) THEN 1.0 ELSE 0.0 END) + (CASE WHEN regexp_matches(t, '(ung|keit|heit|chen)$') THEN 0.5 ELSE 0.0 END) + (CASE WHEN regexp_matches(t, '[äöüß]') THEN 2.0 ELSE 0.0 END))), 0)::DOUBLE AS de,
  coalesce(list_sum(list_transform(toks, lambda t: (CASE WHEN t IN ({_in(T.ENGLISH)}) THEN 1.0 ELSE 0.0 END) + (CASE WHEN regexp_matches(t, '(ing|tion)$') THEN 0.5 ELSE 0.0 END))), 0)::DOUBLE AS en FROM tok),
scores AS (SELECT * EXCLUDE (toks, de, en), CASE WHEN de + en < 1 THEN 0.0 ELSE (de - en) / (de + en) END AS score FROM ev)"""
CUES_SQL = r"""
cues AS (SELECT doc_id, cue_idx, (e - 60 * n)::BIGINT AS start_ms, e::BIGINT AS end_ms, text, role FROM (
  SELECT conv_id AS doc_id, turn::INTEGER AS cue_idx, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS text, length(text) AS n, role, 60 * sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations))"""
WORDS_SQL = r"""
tokens AS (SELECT doc_id, cue_idx, start_ms, greatest(end_ms - start_ms, 1) AS span, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT *, list_filter(string_split_regex(text, '[\s\p{Z}]+'), lambda t: t <> '') AS w FROM cues)),
weights AS (SELECT *, length(token) + 1 AS w, sum(length(token) + 1) OVER (PARTITION BY doc_id, cue_idx) AS total, sum(length(token) + 1) OVER (PARTITION BY doc_id, cue_idx ORDER BY pos) AS upto FROM tokens),
raw AS (SELECT *, start_ms + (span * (upto - w) // total)::BIGINT AS s, start_ms + (span * upto // total)::BIGINT AS e FROM weights),
words AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY cue_idx, pos) - 1)::INTEGER AS word_idx, cue_idx,
  greatest(s, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY cue_idx, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS start_ms,
  max(e) OVER (PARTITION BY doc_id ORDER BY cue_idx, pos) AS end_ms, token AS text FROM raw)"""
SENTENCES_SQL = rf"""
nexts AS (SELECT *, regexp_replace(text, '["''”’»)\]}}]+$', '') AS bare, regexp_replace(lead(text) OVER (PARTITION BY doc_id ORDER BY word_idx), '["''”’»)\]}}]+$', '') AS follow FROM words),
flags AS (SELECT *, (regexp_matches(bare, '[.!?…]$') AND NOT (bare LIKE '%.' AND (lower(bare) IN ({_in(T.ABBREVIATIONS)}) OR length(bare) <= 2 OR (regexp_matches(bare, '^[+-]?\d+\.$') AND TRY_CAST(bare[:-2] AS BIGINT) IS NOT NULL)))
  AND NOT coalesce(regexp_matches(follow, '^\p{{Ll}}'), false))::INTEGER AS ends FROM nexts),
numbered AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS seg_idx FROM flags),
sentences AS (SELECT doc_id, seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY word_idx) AS text, min(cue_idx) AS cue_idx FROM numbered GROUP BY doc_id, seg_idx)"""
FOLDED_SQL = r"""
lasts AS (SELECT doc_id, max(seg_idx) AS last FROM sentences GROUP BY doc_id),
walk AS (SELECT s.doc_id, s.seg_idx, s.start_ms, s.end_ms, s.text, s.cue_idx, false AS gone FROM sentences s JOIN lasts l ON s.doc_id = l.doc_id AND s.seg_idx = l.last
  UNION ALL SELECT s.doc_id, s.seg_idx, s.start_ms, CASE WHEN w.end_ms - w.start_ms < 350 AND len(list_filter(string_split(w.text, ' '), lambda t: t <> '')) < 3 THEN w.end_ms ELSE s.end_ms END,
    CASE WHEN w.end_ms - w.start_ms < 350 AND len(list_filter(string_split(w.text, ' '), lambda t: t <> '')) < 3 THEN s.text || ' ' || w.text ELSE s.text END, s.cue_idx, true
  FROM walk w JOIN sentences s ON s.doc_id = w.doc_id AND s.seg_idx = w.seg_idx - 1),
kept AS (SELECT * FROM walk WHERE seg_idx = 0 OR NOT (end_ms - start_ms < 350 AND len(list_filter(string_split(text, ' '), lambda t: t <> '')) < 3)),
folded AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) - 1)::INTEGER AS seg_idx, start_ms, end_ms, text, cue_idx FROM kept)"""
SEGMENTS_SQL = r"""
segs AS (SELECT f.doc_id, f.seg_idx, f.start_ms, f.end_ms, f.text, (CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END)::INTEGER AS speaker_id FROM folded f JOIN cues c ON f.doc_id = c.doc_id AND f.cue_idx = c.cue_idx)"""
LANGUAGE_ROWS_SQL = r"""
ranked AS (SELECT lang, text[1:200] AS text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents WHERE lang IN ('de', 'en')),
grouped AS (SELECT lang, text, r // 2 AS doc_id, r % 2 AS k, count(*) OVER (PARTITION BY r // 2) AS n FROM ranked),
placed AS (SELECT *, (CASE WHEN doc_id % 2 = 0 THEN 2 * k + (CASE WHEN lang = 'de' THEN 0 ELSE 1 END) ELSE k + (CASE WHEN lang = 'de' THEN 0 ELSE 2 END) END)::INTEGER AS seg_idx FROM grouped WHERE n = 4),
lrows AS (SELECT doc_id::BIGINT AS doc_id, seg_idx, (seg_idx * 2000 + CASE WHEN doc_id % 5 = 4 AND seg_idx >= (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END) THEN 5000 ELSE 0 END)::BIGINT AS start_ms, text, (CASE WHEN lang = 'de' THEN 0 ELSE 1 END)::INTEGER AS speaker_id FROM placed)"""


def with_sql(*parts: str, recursive: bool = False) -> str:
    """A WITH clause of the parts."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(p.strip("\n") for p in parts) + "\n"


TO_WORDS = (CUES_SQL, WORDS_SQL)
TO_SENTENCES = (*TO_WORDS, SENTENCES_SQL)
TO_SEGMENTS = (*TO_SENTENCES, FOLDED_SQL, SEGMENTS_SQL)
