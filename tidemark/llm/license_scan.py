"""License scan: ordered signature rules behind a keyword prefilter.

One pass of an Aho-Corasick automaton over the lower-cased text, each gap between words as one space, finds which keywords occur; only rules with a keyword
there are run, over the whole text. Of overlapping detections, one inside the interval of another is suppressed
when the other has a higher priority, or the same priority and a longer interval, or the same interval and an earlier
rule. Detections that only partly overlap all stay.

Defined cases: null and empty texts have no detections; equal rows give equal detections; a null doc_id is carried; an
empty table gives an empty result; columns other than doc_id and text are ignored. Offsets are characters, the end
is exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_rules import GAP, Rule, rules

#: Gaps that aren't one space already.
_GAP = re.compile(rf"(?! [^\s*#/;]){GAP}")
SCHEMA = "doc_id long, rule string, license string, priority int, start_char int, end_char int"


class Scanner:
    def __init__(self, own: list[Rule] | None = None):
        self.rules = own if own is not None else rules()
        self.compiled = [re.compile(pattern, re.IGNORECASE) for *_, pattern in self.rules]
        by_keyword: dict[str, set[int]] = {}
        for k, (_, _, _, keywords, _) in enumerate(self.rules):
            for word in keywords:
                by_keyword.setdefault(word, set()).add(k)
        self.gates = list(by_keyword.values())
        self.automaton = ahocorasick.Automaton()
        for k, word in enumerate(by_keyword):
            self.automaton.add_word(word, k)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        """The rules that have a keyword in the text."""
        low = text.lower()
        if not low.isascii():  # letters that patterns take for i and s when case doesn't matter
            low = low.replace("i\u0307", "i").replace("\u0131", "i").replace("\u017f", "s")
        low = _GAP.sub(" ", low)
        hit = {k for _, k in self.automaton.iter(low)}
        return sorted(set().union(*(self.gates[k] for k in hit))) if hit else []

    def detections(self, text: str, which: list[int] | range) -> list[tuple[int, int, int, int]]:
        """(start, end, priority, rule) of all matches of the rules."""
        return [(m.start(), m.end(), self.rules[k][2], k) for k in which for m in self.compiled[k].finditer(text)]

    def scan(self, text: str | None) -> list[tuple[int, int, int, int]]:
        return suppressed(self.detections(text, self.candidates(text))) if text else []


def suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The detections that no stronger one contains, by place.

    From the strongest on, `reach` (a Fenwick tree over the starts) tells how far those that begin no later go: n log n."""
    starts = sorted({d[0] for d in found})
    reach = [-1] * (len(starts) + 1)
    kept: list[tuple[int, int, int, int]] = []
    for d in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[3], d[0])):
        at = i = bisect_left(starts, d[0]) + 1
        far = -1
        while i:
            far = max(far, reach[i])
            i &= i - 1
        if far < d[1]:
            kept.append(d)
            while at < len(reach):
                reach[at] = max(reach[at], d[1])
                at += at & -at
    return sorted(kept)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, rule, license, priority, start_char, end_char: one row per detection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for b in batches:
            rows = [
                (i, scanner.rules[k][0], scanner.rules[k][1], priority, start, end)
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                for start, end, priority, k in scanner.scan(text)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
