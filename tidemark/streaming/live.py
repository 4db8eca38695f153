"""Streaming forms: sentences of a growing word stream, and counts of events in sliding windows.

The reference of these is the batch operator: a stream that has ended gives what the batch gives, but for the last, unfinished
sentence of each document, which waits for its next word."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text as T

SENTENCE = "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string"
_STATE = "seg_idx int, start_ms bigint, end_ms bigint, text string, last string"


def _ends(token: str, following: str) -> bool:
    """T.ends_sentence of two tokens, for a state machine that has them one by one."""
    import re

    bare = re.sub(T.CLOSERS, "", token)
    if not re.search("[.!?…]$", bare):
        return False
    if bare.endswith("."):
        stem = bare[:-1]
        if bare.lower() in T.ABBREVIATIONS or len(stem) <= 1 or (re.fullmatch(r"[+-]?\d+", stem) and -(1 << 63) <= int(stem) < 1 << 63):
            return False
    following = re.sub(T.CLOSERS, "", following)
    return not (following[:1].isalpha() and following[:1].islower())


def sentences(words: DataFrame) -> DataFrame:
    """Finished sentences of a stream of words (doc_id, word_idx, start_ms, end_ms, text) that come in order within each document."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seg, start, end, text, last = state.get if state.exists else (0, None, None, "", "")
        out = []
        for w in pd.concat(list(parts)).sort_values("word_idx").itertuples():
            if last and _ends(last, w.text):
                out.append((key[0], seg, start, end, text))
                seg, start, text = seg + 1, None, ""
            start, end, text, last = w.start_ms if start is None else start, w.end_ms, f"{text} {w.text}" if text else w.text, w.text
        state.update((int(seg), int(start), int(end), text, last))
        yield pd.DataFrame(out, columns=["doc_id", "seg_idx", "start_ms", "end_ms", "text"])

    return words.groupBy("doc_id").applyInPandasWithState(run, SENTENCE, _STATE, "append", GroupStateTimeout.NoTimeout)


def sliding_counts(events: DataFrame, window: str = "1500 milliseconds", hop: str = "250 milliseconds", late: str = "10 seconds") -> DataFrame:
    """start, end, event_type, n, value of events (ts, event_type, value) in sliding windows; events later than `late` are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window, hop), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return rows.select("window.start", "window.end", "event_type", "n", "value")
