"""Host-level quality rules.

Every document is tested by text rules; failures are counted by host, each host's failure rate is
shrunk by a beta prior fitted to all hosts (method of moments), and the host's verdict is joined back
to its documents. A document is kept when it passes every rule and its host is not rejected.

Defined cases: a null or blank text fails the rule `blank`; a null source counts as the host ''; a null
doc_id is carried as null; repeated rows are judged, and counted, row by row; a host whose rate is exactly `host_rate` is not
rejected; an empty table gives an empty result; columns other than doc_id, text and source are ignored by `judge` and
returned untouched by `keep_good`, whatever their names. With one host, or hosts that do not differ, the prior falls back to
`flat_strength` pseudo-documents at the overall rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh_dir, numbered

SYMBOLS = r"[#$%&*|!~^<>{}=+@\\]"
#: symbols: most symbols a word, from 5 symbols on; upper: most capitals a character, from 40 capitals on; repeats: most words equal to
#: the word before, from 4 on; word_length: most characters a word; repeated_lines: most lines that were there
#: already, from 4 on; host_rate: a host of more than this shrunk failure rate is rejected.
PARAMETERS = {"symbols": 0.3, "upper": 0.3, "repeats": 0.2, "word_length": 40.0, "repeated_lines": 0.3, "host_rate": 0.5, "flat_strength": 10.0, "broadcast_hosts": 100_000}


def features(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    return {
        "n_chars": F.length(text).cast("long"),
        "n_words": F.when(F.get(words, F.lit(0)) == "", 0).otherwise(F.size(words)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_lines_again": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_repeats": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).cast("long"),
    }


def failures(p: dict = PARAMETERS) -> dict[str, Column]:
    """Rule name to failed?, over the columns of `features`."""
    c = F.col
    n, w = F.greatest(c("n_chars"), F.lit(1)), F.greatest(c("n_words"), F.lit(1))
    return {
        "blank": c("n_words") == 0,
        "symbols": (c("n_symbols") / w > p["symbols"]) & (c("n_symbols") >= 5),
        "upper": (c("n_upper") / n > p["upper"]) & (c("n_upper") >= 40),
        "repeats": (c("n_repeats") / w > p["repeats"]) & (c("n_repeats") >= 4),
        "word_length": c("n_chars") / w > p["word_length"],
        "repeated_lines": (c("n_lines_again") / F.greatest(c("n_lines"), F.lit(1)) > p["repeated_lines"]) & (c("n_lines_again") >= 4),
    }


def _host() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def _features(docs: DataFrame, kept: list[Column | str]) -> DataFrame:
    """The kept columns (of other names than t and w) and the features of each row; a text's words are made once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    rows = docs.select(*kept, text.alias("t"), words.alias("w"))
    return rows.select(*rows.columns[:-2], *[c.alias(k) for k, c in features(F.col("t"), F.col("w")).items()])


def _failed(p: dict = PARAMETERS) -> Column:
    return F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in failures(p).items()]).alias("rules_failed")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words and rules_failed of every row."""
    return _features(docs, ["doc_id", _host().alias("host")]).select("doc_id", "host", "n_words", _failed())


def host_verdicts(rows: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """One row per host: counts, shrunk failure rate, rejected?"""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum((F.col("rules_failed") != "").cast("long")).alias("host_failed"))
    r = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(r).alias("m"), F.var_pop(r).alias("v"))  # one row, whatever the input
    strength = F.when((F.col("v") > 1e-9) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(p["flat_strength"]))
    rate = (F.col("host_failed") + F.col("m") * strength) / (F.col("host_docs") + strength)
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_failed", F.round(rate, 6).alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > p["host_rate"])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, rules_failed, host_docs, host_failed, host_rate, host_rejected, keep; one row per input row."""
    rows = cut(measured(docs))  # narrow; the text is read once
    return rows.join(host_verdicts(rows), "host").withColumn("keep", (F.col("rules_failed") == "") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """The kept rows of docs, all columns as they were. The rules are evaluated once: rows are written with their outcome, of which the hosts' counts read two narrow columns."""
    spark, names = docs.sparkSession, docs.columns
    plain = numbered(docs)
    own = {c: plain.columns[names.index(c)] for c in ("text", "source")}
    tested = _features(plain.select("*", *[F.col(n).alias(c) for c, n in own.items()]), [*plain.columns, _host().alias("host")])
    tested.select(*plain.columns, "host", _failed(p)).write.parquet(out := fresh_dir(spark, "rules"))
    rows = spark.read.schema(plain.withColumns({"host": F.lit(""), "rules_failed": F.lit("")}).schema).parquet(out)
    hosts = cut(host_verdicts(rows.select("host", "rules_failed"), p).where("host_rejected").select("host"))
    rejected = hosts.count()
    passed = rows.where("rules_failed = ''")
    if rejected:  # up to broadcast_hosts of them are sent to the documents, more are joined by a shuffle
        passed = passed.join(F.broadcast(hosts) if rejected <= p["broadcast_hosts"] else hosts, "host", "left_anti")
    return passed.select(*plain.columns).toDF(*names)


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS flat FROM documents),
split AS (SELECT *, string_split(flat, ' ') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM base),
feats AS (
  SELECT doc_id, host, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_lines_again, length(t) AS n_chars, CASE WHEN length(flat) = 0 THEN 0 ELSE len(w) END AS n_words,
    length(t) - length(regexp_replace(t, '[#$%&*|!~^<>{}=+@\\]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = x[2])) AS n_repeats FROM split),
rules AS (
  SELECT doc_id, host, n_words, concat_ws(',', CASE WHEN n_words = 0 THEN 'blank' END,
    CASE WHEN n_symbols / greatest(n_words, 1) > 0.3 AND n_symbols >= 5 THEN 'symbols' END,
    CASE WHEN n_upper / greatest(n_chars, 1) > 0.3 AND n_upper >= 40 THEN 'upper' END,
    CASE WHEN n_repeats / greatest(n_words, 1) > 0.2 AND n_repeats >= 4 THEN 'repeats' END,
    CASE WHEN n_chars / greatest(n_words, 1) > 40.0 THEN 'word_length' END,
    CASE WHEN n_lines_again / greatest(n_lines, 1) > 0.3 AND n_lines_again >= 4 THEN 'repeated_lines' END) AS rules_failed FROM feats),
hosts AS (SELECT host, count(*) AS host_docs, sum((rules_failed <> '')::BIGINT)::BIGINT AS host_failed FROM rules GROUP BY host),
prior AS (SELECT avg(host_failed / host_docs) AS m, var_pop(host_failed / host_docs) AS v FROM hosts),
k AS (SELECT m, CASE WHEN v > 1e-9 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10.0 END AS s FROM prior),
verdict AS (SELECT host, host_docs, host_failed, round((host_failed + m * s) / (host_docs + s), 6) AS host_rate FROM hosts, k)
SELECT doc_id, host, n_words::BIGINT AS n_words, rules_failed, host_docs, host_failed, host_rate, host_rate > 0.5 AS host_rejected,
       rules_failed = '' AND NOT (host_rate > 0.5) AS keep
FROM rules JOIN verdict USING (host)
"""
