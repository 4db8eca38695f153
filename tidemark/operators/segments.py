"""Cues to words, words to sentences, merging and unmerging of captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.folds import fold
from tidemark.schema import SEGMENT, SEGMENT_DEFAULTS

MERGE = {"max_gap": 900, "max_duration": 9000, "max_chars": 180}
FOLD = {"shorter_than": 350, "fewer_words": 3}
_PIECE = ("start_ms", "end_ms", "text", "translation", "translation_start_ms", "translation_echo")


def words_from_cues(cues: DataFrame) -> DataFrame:
    """doc_id, word_idx, cue_idx, start_ms, end_ms, text. A cue's time is shared out by token length + 1, then times are made monotonic."""
    cue = Window.partitionBy("doc_id", "cue_idx")
    before = cue.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    doc = Window.partitionBy("doc_id").orderBy("cue_idx", "pos")
    rows = cues.select("doc_id", "cue_idx", "start_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)).alias("span"), F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    weight = (F.length("token") + 1).cast("bigint")
    rows = rows.withColumn("w", weight).withColumn("total", F.sum("w").over(cue)).withColumn("done", F.coalesce(F.sum("w").over(before), F.lit(0)))
    rows = rows.withColumn("s", F.expr("start_ms + span * done div total")).withColumn("e", F.expr("start_ms + span * (done + w) div total"))
    start = F.greatest("s", F.coalesce(F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.col("s")))
    return rows.select("doc_id", (F.row_number().over(doc) - 1).alias("word_idx"), "cue_idx", start.alias("start_ms"), F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, 0)).alias("end_ms"), F.col("token").alias("text"))


def sentences_from_words(words: DataFrame) -> DataFrame:
    """doc_id, seg_idx, start_ms, end_ms, text, cue_idx (of the first word): words cut after each end of a sentence."""
    doc = Window.partitionBy("doc_id").orderBy("word_idx")
    rows = words.withColumn("ends", T.ends_sentence(F.col("text"), F.lead("text").over(doc)).cast("int"))
    rows = rows.withColumn("seg_idx", F.coalesce(F.sum("ends").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    return rows.groupBy("doc_id", "seg_idx").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w.text), " ").alias("text"), F.min("cue_idx").alias("cue_idx"),
    )


def fold_short(sentences: DataFrame, shorter_than: int = FOLD["shorter_than"], fewer_words: int = FOLD["fewer_words"], parts: int | None = None) -> DataFrame:
    """Sentences too short to read go into the one before, from the last on; a row is judged with all it has taken in."""

    def rule(rows: list[dict]) -> list[dict]:
        for i in range(len(rows) - 1, 0, -1):
            own, into = rows[i], rows[i - 1]
            if own["end_ms"] - own["start_ms"] < shorter_than and len(own["text"].split()) < fewer_words:
                into["end_ms"], into["text"] = own["end_ms"], f"{into['text']} {own['text']}"
                del rows[i]
        for i, row in enumerate(rows):
            row["seg_idx"] = i
        return rows

    return fold(sentences, "doc_id", ["seg_idx"], rule, sentences.schema, parts)


def segments_from_cues(cues: DataFrame, parts: int | None = None) -> DataFrame:
    return fold_short(sentences_from_words(words_from_cues(cues)), parts=parts)


def with_defaults(rows: DataFrame) -> DataFrame:
    """The segment table, missing columns at their defaults."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    return rows.select(*[F.col(n) if n in rows.columns else F.expr(SEGMENT_DEFAULTS[n]).alias(n) for n in names])


def merge_runs(segments: DataFrame, max_gap: int = MERGE["max_gap"], max_duration: int = MERGE["max_duration"], max_chars: int = MERGE["max_chars"]) -> DataFrame:
    """Runs of one speaker become one caption while gap, duration and length allow, from each head on; pieces are kept in merged_from."""

    def fits(head: dict, last: dict, row: dict, chars: int) -> bool:
        return (
            row["speaker_id"] >= 0 and row["speaker_id"] == head["speaker_id"] and row["translation_echo"] == head["translation_echo"]
            and row["start_ms"] - last["end_ms"] <= max_gap and row["end_ms"] - head["start_ms"] <= max_duration and chars + 1 + len(row["text"]) <= max_chars
        )

    def joined(run: list[dict]) -> dict:
        flagged = next((r for r in run if r["needs_review"]), None)
        return run[0] | {
            "end_ms": run[-1]["end_ms"], "text": " ".join(r["text"] for r in run), "translation": " ".join(r["translation"] for r in run if r["translation"]),
            "translation_start_ms": 0, "confidence": min(r["confidence"] for r in run), "needs_review": flagged is not None,
            "review_reason": flagged["review_reason"] if flagged else run[0]["review_reason"], "merged_from": [{k: r[k] for k in _PIECE} for r in run],
        }

    def rule(rows: list[dict]) -> list[dict]:
        out, run = [], rows[:1]
        chars = len(rows[0]["text"])
        for row in rows[1:]:
            if run[0]["speaker_id"] >= 0 and fits(run[0], run[-1], row, chars):
                run.append(row)
                chars += 1 + len(row["text"])
            else:
                out.append(joined(run) if len(run) > 1 else run[0])
                run, chars = [row], len(row["text"])
        out.append(joined(run) if len(run) > 1 else run[0])
        return [r | {"seg_idx": i} for i, r in enumerate(out)]

    return fold(segments, "doc_id", ["seg_idx"], rule, segments.schema)


def merge_report(merged: DataFrame) -> DataFrame:
    """doc_id, merged, absorbed, before, after, from merge_runs' result on rows that weren't merged yet."""
    pieces = F.size("merged_from")
    return merged.groupBy("doc_id").agg(
        F.count_if(pieces > 0).alias("merged"), F.sum(F.greatest(pieces - 1, F.lit(0))).cast("bigint").alias("absorbed"),
        F.sum(F.greatest(pieces, F.lit(1))).cast("bigint").alias("before"), F.count(F.lit(1)).alias("after"),
    )


def unmerge(segments: DataFrame) -> DataFrame:
    """Merged captions back to their pieces; what pieces don't store is the merged caption's."""
    rows = segments.select("*", F.posexplode_outer("merged_from").alias("piece_idx", "piece"))
    order = Window.partitionBy("doc_id").orderBy("old_idx", "piece_idx")
    columns = [F.coalesce(F.col(f"piece.{c}"), F.col(c)).alias(c) if c in _PIECE else F.expr(SEGMENT_DEFAULTS[c]).alias(c) if c == "merged_from" else F.col(c) for c in segments.columns]
    rows = rows.select(*columns, F.col("seg_idx").alias("old_idx"), "piece_idx")
    return rows.withColumn("seg_idx", F.row_number().over(order) - 1).select(*segments.columns)


def distinct_words(text):  # noqa: ANN001, ANN201
    """The text's normalised words, each once, in order."""
    return F.array_distinct(F.filter(F.transform(T.tokens(text), T.normal_word), lambda w: w != ""))
