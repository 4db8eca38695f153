"""Pairing source lines with their translations, undoing it, and batch translation by a given callable."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

MAX_GAP = 4000
COLLAPSE_GAP = 250
FAILED = "some lines could not be translated"
NONE_LEFT = "every line has a translation"
MIXED = "A line and its translation have different speakers."


def label_runs(segments: DataFrame) -> DataFrame:
    """segments with lang ('de', 'en' or '' for other lines and those that have a translation) and run (numbered by change) and k (place in the run)."""
    doc = Window.partitionBy("doc_id").orderBy("seg_idx")
    score = T.language_score(F.col("text"))
    rows = segments.withColumn("__s", score).withColumn("lang", F.when(F.col("translation") != "", "").when(T.is_german(F.col("__s")), "de").when(T.is_english(F.col("__s")), "en").otherwise("")).drop("__s")
    rows = rows.withColumn("__c", F.coalesce((F.lag("lang").over(doc) != F.col("lang")).cast("int"), F.lit(0)))
    rows = rows.withColumn("run", F.sum("__c").over(doc)).drop("__c")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("seg_idx")) - 1)


def pair(segments: DataFrame) -> DataFrame:
    """A run of German lines directly followed by a run of English ones, within MAX_GAP, are paired line by line; echoes right after their line join it.

    The result has `outcome`: paired, echo, unpaired (a German line without partner) or ''."""
    doc = Window.partitionBy("doc_id").orderBy("seg_idx")
    rows = label_runs(segments)
    runs = rows.groupBy("doc_id", "run", "lang").agg(F.min("start_ms").alias("s"), F.max_by("end_ms", "seg_idx").alias("e"), F.min_by("start_ms", "seg_idx").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc_id").orderBy("run")
    gap = F.lead("first").over(order) - F.col("e")
    ok = (F.col("lang") == "de") & (F.lead("lang").over(order) == "en") & (gap >= 0) & (gap <= MAX_GAP)
    runs = runs.withColumn("source", F.coalesce(ok, F.lit(False))).withColumn("pairs", F.least("n", F.lead("n").over(order)))
    runs = runs.withColumn("target", F.coalesce(F.lag("source").over(order), F.lit(False))).withColumn("taken", F.lag("pairs").over(order))
    rows = rows.join(runs.select("doc_id", "run", "source", "target", "pairs", "taken"), ["doc_id", "run"])
    is_source, is_target = F.col("source") & (F.col("k") < F.col("pairs")), F.col("target") & (F.col("k") < F.col("taken"))
    partner = rows.where(is_target).select("doc_id", (F.col("run") - 1).alias("run"), "k", F.struct("seg_idx", "start_ms", "end_ms", "text", "speaker_id").alias("p"))
    joined = rows.where(~is_target).join(partner, ["doc_id", "run", "k"], "left")
    paired = F.col("p").isNotNull() & is_source
    mixed = paired & (F.col("p.speaker_id") != F.col("speaker_id"))
    joined = joined.withColumn("outcome", F.when(paired, "paired").when((F.col("lang") == "de"), "unpaired").otherwise(""))
    joined = joined.withColumn("translation", F.when(paired, F.col("p.text")).otherwise(F.col("translation"))).withColumn("translation_start_ms", F.when(paired, F.col("p.start_ms")).otherwise(F.col("translation_start_ms")))
    joined = joined.withColumn("needs_review", F.col("needs_review") | mixed).withColumn("review_reason", F.when(mixed, MIXED).otherwise(F.col("review_reason")))
    # a run's pairs are emitted as line, echo, line, echo, ..., then the leftovers of both runs
    joined = joined.withColumn("__e", F.when(paired, F.col("seg_idx") * 2).otherwise(F.col("seg_idx") * 2))
    echo = joined.where(paired).withColumn("start_ms", F.col("p.start_ms")).withColumn("end_ms", F.col("p.end_ms")).withColumn("translation_echo", F.lit(True)).withColumn("outcome", F.lit("echo")).withColumn("__e", F.col("__e") + 1)
    out = joined.unionByName(echo).select(*segments.columns, "outcome", "__e")
    return collapse_echoes(out)


def collapse_echoes(rows: DataFrame) -> DataFrame:
    """rows (with their emission order __e) sorted by start; an echo that follows its line at once, or echoes of it that did, lengthens it."""
    order = Window.partitionBy("doc_id").orderBy("start_ms", "__e")
    same = (F.lag("text").over(order) == F.col("text")) & (F.lag("translation").over(order) == F.col("translation")) & (F.col("start_ms") <= F.lag("end_ms").over(order) + COLLAPSE_GAP)
    rows = rows.withColumn("__t", F.coalesce(F.col("translation_echo") & same, F.lit(False)).cast("int")).withColumn("__h", F.sum((~F.col("translation_echo")).cast("int")).over(order))
    chain = Window.partitionBy("doc_id", "__h").orderBy("start_ms", "__e")
    since = F.min(F.when(F.col("translation_echo"), F.col("__t"))).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__in", F.col("translation_echo") & (F.col("__h") > 0) & (since == 1))
    last = F.max_by(F.when(F.col("__in"), F.col("end_ms")), F.when(F.col("__in"), F.struct("start_ms", "__e"))).over(Window.partitionBy("doc_id", "__h"))
    rows = rows.withColumn("end_ms", F.when(F.col("translation_echo"), F.col("end_ms")).otherwise(F.coalesce(last, "end_ms"))).where(~F.col("__in"))
    return rows.withColumn("seg_idx", F.row_number().over(order) - 1).drop("__e", "__t", "__h", "__in")


def pair_report(paired: DataFrame) -> DataFrame:
    return paired.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "paired").alias("paired"), F.count_if(F.col("outcome") == "unpaired").alias("unpaired"))


def unpair(segments: DataFrame, keep_unpaired: bool = False) -> DataFrame:
    """Echoes become plain lines, joined pairs are cut where the translation began, other translations are cleared (kept with keep_unpaired)."""
    c = {n: F.col(n) for n in segments.columns}
    inside = (F.col("translation_start_ms") > F.col("start_ms")) & (F.col("translation_start_ms") < F.col("end_ms"))
    row = lambda **new: F.struct(*[(new.get(n, c[n])).alias(n) for n in segments.columns])
    none = {"translation": F.lit(""), "translation_start_ms": F.lit(0).cast("bigint")}
    out = (
        F.when(F.col("translation") == "", F.array(row()))
        .when(F.col("translation_echo"), F.array(row(text=F.col("translation"), translation_echo=F.lit(False), **none)))
        .when(inside, F.array(row(end_ms=F.col("translation_start_ms"), **none), row(start_ms=F.col("translation_start_ms"), text=F.col("translation"), **none)))
        .otherwise(F.array(row() if keep_unpaired else row(**none)))
    )
    rows = segments.select(F.col("seg_idx").alias("__i"), F.posexplode(out).alias("__k", "r")).select("__i", "__k", "r.*")
    return rows.withColumn("seg_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("__i", "__k")) - 1).drop("__i", "__k")


def pending(segments: DataFrame, batch: int = 20, overwrite: bool = False) -> DataFrame:
    """The lines to translate, with batch_no: `batch` lines a call."""
    open_ = (F.trim(T.collapse(F.col("text"))) != "") & ((F.col("translation") == "") | F.lit(overwrite))
    return segments.where(open_).withColumn("batch_no", F.expr(f"cast((row_number() over (partition by doc_id order by seg_idx) - 1) div {batch} as int)"))


def parse_reply(reply, n):  # noqa: ANN001, ANN201
    """The n trimmed strings of a model's reply, an array or an object's `translations`, perhaps between other text as an object; null when there aren't n."""
    body = F.coalesce(F.from_json(reply, "array<string>"), F.from_json(reply, "struct<translations:array<string>>")["translations"], F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "struct<translations:array<string>>")["translations"])
    return F.when((F.size(body) == n) & (n > 0), F.transform(body, lambda s: F.trim(F.coalesce(s, F.lit("")))))


def reply_lines(reply: str, n: int) -> list[str]:
    """What parse_reply finds, outside of Spark; an error where that is null."""
    try:
        found = json.loads(reply)
    except ValueError:
        try:
            found = json.loads(reply[reply.index("{") : reply.rindex("}") + 1])
        except ValueError:
            found = None
    found = found.get("translations") if isinstance(found, dict) else found
    if not isinstance(found, list) or not found:
        raise ValueError("the reply has no list of translations")
    if len(found) != n:
        raise ValueError(f"the reply has {len(found)} translations for {n} lines")
    return [x.strip() if isinstance(x, str) else "" for x in found]


def batch_call(ask: Callable[[str], str], request: Callable[[list[str]], str] = json.dumps) -> Callable[[list[str]], list[str]]:
    """A call for translate() from a service: ask(request(lines)) gives a reply in text, which has to hold as many strings."""
    return lambda lines: reply_lines(ask(request(lines)), len(lines))


def translate(segments: DataFrame, call: Callable[[list[str]], list[str]], batch: int = 20, overwrite: bool = False) -> DataFrame:
    """segments with translations by call(lines), `batch` lines a call; a batch that fails, or returns another number, is tried line by line; lines that fail stay as they are."""
    return translated(segments, call, batch, overwrite).select(*segments.columns)


def translation_report(rows: DataFrame) -> DataFrame:
    """doc_id, pending, translated, skipped, failed, warning, error of what translated() gives."""
    n = lambda *what: F.count_if(F.col("outcome").isin(*what))
    found = rows.groupBy("doc_id").agg(n("translated", "failed").alias("pending"), n("translated").alias("translated"), n("skipped").alias("skipped"), n("failed").alias("failed"))
    failed = F.col("failed") > 0
    return found.withColumn("warning", F.when(F.col("pending") == 0, NONE_LEFT).when(failed & (F.col("translated") > 0), FAILED).otherwise("")).withColumn("error", F.when(failed & (F.col("translated") == 0), "no line could be translated").otherwise(""))


def translated(segments: DataFrame, call: Callable[[list[str]], list[str]], batch: int = 20, overwrite: bool = False) -> DataFrame:
    """What translate() gives, with `outcome`: translated, failed (no answer, or an empty one), skipped (has a translation) or '' (nothing to translate)."""
    kind = "doc_id bigint, seg_idx int, new string"
    todo = pending(segments, batch, overwrite).groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("lines"))

    def one(line: str) -> str | None:
        try:
            return call([line])[0]
        except Exception:  # noqa: BLE001
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, lines in zip(b.column("doc_id").to_pylist(), b.column("lines").to_pylist()):
                texts = [x["text"] for x in lines]
                try:
                    got = call(texts)
                except Exception:  # noqa: BLE001
                    got = []
                if len(got) != len(texts):
                    got = [one(t) for t in texts]
                out += [(doc, x["seg_idx"], g) for x, g in zip(lines, got)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int32(), pa.string()))], ["doc_id", "seg_idx", "new"])

    new = todo.select("doc_id", "lines").mapInArrow(run, kind)
    new = new.select("doc_id", "seg_idx", F.struct(F.when(F.col("new") != "", F.col("new")).alias("t")).alias("asked"))
    out = segments.join(new, ["doc_id", "seg_idx"], "left")
    outcome = F.when(F.col("asked.t").isNotNull(), "translated").when(F.col("asked").isNotNull(), "failed").when((F.trim(T.collapse(F.col("text"))) != "") & (F.col("translation") != ""), "skipped").otherwise("")
    return out.withColumn("outcome", outcome).withColumn("translation", F.coalesce("asked.t", "translation")).select(*segments.columns, "outcome")
