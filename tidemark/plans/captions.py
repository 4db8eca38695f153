"""Queries on text, words, sentences and merged captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import segments as S
from tidemark.plans import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(X.with_sql("scored_input AS (SELECT doc_id, text FROM documents)", X.SCORES_SQL) + "SELECT doc_id, score, score >= 0.34 AS german, score <= -0.34 AS english FROM scores")
def language_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "documents").select("doc_id", T.language_score(F.col("text")).alias("score"))
    return rows.select("doc_id", "score", T.is_german(F.col("score")).alias("german"), T.is_english(F.col("score")).alias("english"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT lower(regexp_replace(unnest(string_split_regex(text, '[\s\p{Z}]+')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS word FROM documents) WHERE length(word) >= 3 GROUP BY word""")
def word_norm_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = X.table(spark, sf_dir, "documents").select(F.explode(F.split("text", T.SPACE)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    words = tokens.select(T.normal_word(F.col("t")).alias("word"), "n")  # each token is normalised once
    return words.where(F.length("word") >= 3).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")


_STAMPS = r"""
WITH t AS (SELECT event_id, ((epoch_us(ts) // 1000) % 86400000)::BIGINT * (CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END) + (CASE WHEN event_id % 11 = 0 THEN 3600000000 ELSE 0 END) AS ms FROM events),
p AS (SELECT event_id, ms, greatest(ms, 0) AS g FROM t)
SELECT event_id, ms, CASE WHEN g // 3600000 < 10 THEN '0' ELSE '' END || (g // 3600000) || ':' || lpad((g // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((g // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((g % 1000)::VARCHAR, 3, '0') AS stamp,
  g AS parsed, ms AS edited, CASE WHEN g // 60000 < 10 THEN '0' ELSE '' END || (g // 60000) || ':' || lpad((g // 1000 % 60)::VARCHAR, 2, '0') || '.' || (g // 100 % 10) AS clock FROM p"""


@query(_STAMPS)
def timestamp_format_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000) * F.when(F.col("event_id") % 7 == 0, -1).otherwise(1) + F.when(F.col("event_id") % 11 == 0, 3_600_000_000).otherwise(0)
    rows = X.table(spark, sf_dir, "events").select("event_id", ms.cast("bigint").alias("ms")).withColumn("stamp", T.format_stamp(F.col("ms")))
    return rows.select("event_id", "ms", "stamp", T.stamp_ms(F.col("stamp")).alias("parsed"), T.edited_stamp(F.concat(F.lit(" "), F.col("ms").cast("string"))).alias("edited"), T.clock(F.col("ms")).alias("clock"))


@query(X.with_sql(*X.TO_WORDS) + "SELECT * FROM words")
def cue_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.words_from_cues(X.cues(spark, sf_dir))


@query(X.with_sql(*X.TO_SENTENCES) + "SELECT *, len(string_split(text, ' ')) AS n_words FROM sentences")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentences_from_words(S.words_from_cues(X.cues(spark, sf_dir))).withColumn("n_words", T.word_count(F.col("text")).cast("bigint"))


@query(X.with_sql(*X.TO_SENTENCES) + "SELECT doc_id, count(*) AS sentences, sum(len(string_split(text, ' ')))::BIGINT AS words, max(end_ms) AS end_ms FROM sentences GROUP BY doc_id")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum("n_words").alias("words"), F.max("end_ms").alias("end_ms"))


@query(X.with_sql(*X.TO_SEGMENTS, recursive=True) + "SELECT * FROM folded")
def sentences_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments_from_cues(X.cues(spark, sf_dir))


MERGED_SQL = r"""
grow AS (SELECT doc_id, seg_idx, 0 AS head, start_ms AS hstart, speaker_id AS hspeaker, end_ms AS lend, length(text) AS chars, speaker_id, start_ms, end_ms, text FROM segs WHERE seg_idx = 0
  UNION ALL SELECT s.doc_id, s.seg_idx, CASE WHEN ok THEN head ELSE s.seg_idx END, CASE WHEN ok THEN hstart ELSE s.start_ms END, CASE WHEN ok THEN hspeaker ELSE s.speaker_id END, s.end_ms, CASE WHEN ok THEN chars + 1 ELSE 0 END + length(s.text), s.speaker_id, s.start_ms, s.end_ms, s.text
  FROM (SELECT g.*, n.start_ms AS ns, n.end_ms AS ne, n.speaker_id AS nsp, length(n.text) AS nl, n.seg_idx AS ni,
      n.speaker_id = g.hspeaker AND n.start_ms - g.lend <= 900 AND n.end_ms - g.hstart <= 9000 AND g.chars + 1 + length(n.text) <= 180 AS ok FROM grow g JOIN segs n ON n.doc_id = g.doc_id AND n.seg_idx = g.seg_idx + 1) x
  JOIN segs s ON s.doc_id = x.doc_id AND s.seg_idx = x.ni),
runs AS (SELECT doc_id, head, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY seg_idx) AS text, min(speaker_id) AS speaker_id, count(*) AS n FROM grow GROUP BY doc_id, head),
merged AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1)::INTEGER AS seg_idx, start_ms, end_ms, text, speaker_id, CASE WHEN n > 1 THEN n ELSE 0 END::INTEGER AS pieces FROM runs)"""


@query(X.with_sql(*X.TO_SEGMENTS, MERGED_SQL, recursive=True) + "SELECT * FROM merged")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_runs(X.segments(spark, sf_dir)).select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_id", F.size("merged_from").alias("pieces"))


_DETAILS = """
told AS (SELECT *, CASE WHEN seg_idx % 3 = 0 THEN lower(text) END AS tr, seg_idx % 10 AS conf, seg_idx % 4 = 1 AS flag FROM grow),
whole AS (SELECT doc_id, head, string_agg(tr, ' ' ORDER BY seg_idx) AS tr, min(conf) AS conf, bool_or(flag) AS flag, 'r' || coalesce(min(CASE WHEN flag THEN seg_idx END), head) AS reason, count(*) AS n, string_agg(text || '/' || start_ms || '/' || end_ms || '/' || coalesce(tr, ''), '|' ORDER BY seg_idx) AS pieces FROM told GROUP BY doc_id, head)"""


@query(X.with_sql(*X.TO_SEGMENTS, MERGED_SQL, _DETAILS, recursive=True) + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY head) - 1)::INTEGER AS seg_idx, coalesce(tr, '') AS translation, conf / 10.0::DOUBLE AS confidence, flag AS needs_review, reason AS review_reason, CASE WHEN n > 1 THEN pieces ELSE '' END AS pieces FROM whole")
def merge_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merged caption keeps of its pieces' translations, confidence and reviews, and the pieces themselves."""
    rows = X.segments(spark, sf_dir).withColumn("translation", F.expr("if(seg_idx % 3 = 0, lower(text), '')")).withColumn("confidence", (F.col("seg_idx") % 10 / 10).cast("float"))
    rows = S.merge_runs(rows.withColumn("needs_review", F.expr("seg_idx % 4 = 1")).withColumn("review_reason", F.concat(F.lit("r"), F.col("seg_idx").cast("string"))))
    pieces = F.array_join(F.transform("merged_from", lambda p: F.concat_ws("/", p.text, p.start_ms.cast("string"), p.end_ms.cast("string"), p.translation)), "|")
    return rows.select("doc_id", "seg_idx", "translation", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "needs_review", "review_reason", pieces.alias("pieces"))


@query(X.with_sql(*X.TO_SEGMENTS, MERGED_SQL, recursive=True) + "SELECT doc_id, sum((pieces > 0)::INTEGER)::BIGINT AS merged, sum(greatest(pieces - 1, 0))::BIGINT AS absorbed, sum(greatest(pieces, 1))::BIGINT AS before, count(*) AS after FROM merged GROUP BY doc_id")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_report(S.merge_runs(X.segments(spark, sf_dir)))


@query(X.with_sql(*X.TO_SEGMENTS, recursive=True) + "SELECT doc_id, seg_idx, start_ms, end_ms, text, speaker_id FROM segs")
def unmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unmerge(S.merge_runs(X.segments(spark, sf_dir))).select("doc_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_id")
