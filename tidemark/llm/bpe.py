"""BPE encoding and decoding with a lexicon automaton.

Texts are cut into words by the vocabulary's pattern. The words' counts over all documents choose the lexicon: the
`lexicon` most frequent ones are merged once and compiled into a minimal acyclic transducer. Its states are shared
between words with equal suffixes; its transitions carry numbers that add up to a word's rank, and the rank's
ids are in a table. The arrays are one file, sent to all executors and memory-mapped there, so that a machine's workers
share its pages. Words that aren't in it are merged exactly, by rank, on the spot; so the ids are always
those of plain BPE.

The pattern never goes across white space, but for one blank before a word. So for the counts, texts are first cut into pieces, from a blank to the next
white space, by a far simpler pattern; the words of a piece are then found once for all its places in a task.

Defined cases: a null text has null ids, n_tokens null and round_trip null; an empty text has no ids and round-trips; lone
surrogates can't occur in Spark strings; strings of special tokens are ordinary text; equal rows give equal results; a null
doc_id is carried; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh_dir, slices

#: lexicon: words in the automaton; vocabulary: ranks file of a public tokenizer; remembered: words a task keeps.
PARAMETERS = {"lexicon": 400_000, "vocabulary": "/opt/tokenizers/byte_bpe_50k.tiktoken", "remembered": 300_000}
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what \s means in PATTERN
#: PATTERN splits a text as it splits these pieces of it, one by one.
PIECES = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by plain BPE: the pair of lowest rank, the leftmost on a tie, is merged until there is none."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < 1 << 60:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """merge() with a heap over a linked list: n log n, for words of any length."""
    import heapq

    n = len(parts)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] is not a or parts[j] is not b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, ok in zip(parts, alive) if ok]


class Lexicon:
    """A minimal acyclic transducer from words (bytes) to their ids, as plain arrays.

    `keys` are the transitions, state * 256 + byte, in order; `target` and `add` belong to them; `final` marks states;
    `ids[start[rank] : start[rank + 1]]` are a word's ids."""

    FIELDS = (("keys", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.uint8), ("start", np.int64), ("ids", np.int32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Lexicon:
        """words: distinct and sorted. Suffixes are shared as soon as they are complete (incremental minimisation)."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # the open states of the last word: final, finished transitions
        last = b""

        def close(down: int) -> None:
            while len(path) > down + 1:
                final, edges = path.pop()
                state = (final, tuple(edges))
                if (number := register.get(state)) is None:
                    number = register[state] = len(states)
                    states.append(state)
                path[-1][1].append((last[len(path) - 1], number))

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0] = True
            last = word
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        below = [0] * len(states)  # words from a state on; targets have smaller numbers
        keys, target, add = [], [], []
        for s, (final, edges) in enumerate(states):
            n = int(final)
            for byte, t in edges:
                keys.append(s * 256 + byte)
                target.append(t)
                add.append(n)
                n += below[t]
            below[s] = n
        return cls(
            keys=np.array(keys, np.int64), target=np.array(target, np.int32), add=np.array(add, np.int32), final=np.array([f for f, _ in states], np.uint8),
            start=np.array([0, *accumulate(map(len, ids))], np.int64), ids=np.array(list(chain.from_iterable(ids)), np.int32),
        )

    def dump(self) -> bytes:
        head = np.array([len(getattr(self, n)) for n, _ in self.FIELDS], np.int64).tobytes()
        return head + b"".join((b := np.ascontiguousarray(getattr(self, n), t).tobytes()) + bytes(-len(b) % 8) for n, t in self.FIELDS)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        data, arrays = np.asarray(np.memmap(path, np.uint8, "r")), {}  # still mapped, without the subclass's overhead
        at = 8 * len(cls.FIELDS)
        for n, (name, kind) in zip(data[:at].view(np.int64).tolist(), cls.FIELDS):
            size = n * np.dtype(kind).itemsize
            arrays[name] = data[at : at + size].view(kind)
            at += size + -size % 8
        return cls(**arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank, -1 for words that aren't here; all words step through the automaton side by side."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(n) - n
        state = np.full(len(words), len(self.final) - 1, np.int64)
        total = np.zeros(len(words), np.int64)
        going = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        if not len(self.keys):
            state[n > 0] = -1
        depth = 0
        while len(going := going[n[going] > depth]):
            key = state[going] * 256 + flat[begin[going] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[going[~ok]] = -1
            going, at = going[ok], at[ok]
            total[going] += self.add[at]
            state[going] = self.target[at]
            depth += 1
        return np.where((state >= 0) & (self.final[state] > 0), total, -1)

    def ids_of(self, rank: int) -> np.ndarray:
        return self.ids[self.start[rank] : self.start[rank + 1]]


class Encoder:
    """Texts to ids (int32 bytes) and back."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon, remembered: int = PARAMETERS["remembered"]):
        self.ranks, self.lexicon, self.limit = ranks, lexicon, remembered
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        ranks, start, ids = self.lexicon.ranks(raw), self.lexicon.start, self.lexicon.ids.data.cast("B")
        a = np.where(ranks >= 0, start[ranks], -1)
        for w, r, x, y in zip(words, raw, a.tolist(), start[np.minimum(ranks, len(start) - 2) + 1].tolist()):
            self.known[w] = bytes(ids[4 * x : 4 * y]) if x >= 0 else array("i", merge(r, self.ranks)).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        out: list[bytes | None] = []
        for a, b in slices([len(t or "") for t in texts], 1_000_000):
            words = [None if t is None else self.split(t) for t in texts[a:b]]
            every = set().union(*(w for w in words if w))
            new = every - self.known.keys()
            if len(self.known) + len(new) > self.limit:
                self.known.clear()
                new = every
            self.learn(list(new))
            out += [None if w is None else b"".join(map(self.known.__getitem__, w)) for w in words]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: counts of all words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = regex.compile(PATTERN).findall, Counter()

        def flush() -> pa.RecordBatch:
            counts: dict[str, int] = {}
            for piece, n in pieces.items():
                for word in split(piece):
                    counts[word] = counts.get(word, 0) + n
            pieces.clear()
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            return out

        for b in batches:
            for text in b.column("text").to_pylist():
                if text:
                    pieces.update(PIECES.findall(text))
                    if len(pieces) > 400_000:
                        yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, size: int) -> list[str]:
    """The `size` words of the highest counts, the smaller word on a tie.

    How many words have each count gives the least count that still fits; only words of that very count are ordered."""
    counts = cut(word_counts(docs))
    left, least = size, None
    for n, words in sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True):
        if words > left:
            least = n
            break
        left -= words
    if least is None:
        return [r.word for r in counts.select("word").collect()]  # at most `size`
    ties = counts.where(F.col("n") == least).select("word").orderBy("word").limit(left)
    return [r.word for r in counts.where(F.col("n") > least).select("word").collect()] + [r.word for r in ties.collect()]


def publish(spark: SparkSession, docs: DataFrame, p: dict) -> str:
    """Builds the lexicon, writes it to the shared folder and sends it to all executors; its file name."""
    from pyarrow import fs as pafs

    ranks = load_ranks(p["vocabulary"])
    words = sorted(w.encode("utf-8") for w in frequent(docs, p["lexicon"]))
    lexicon = Lexicon.build(words, [merge(w, ranks) for w in words])
    uri = fresh_dir(spark, "lexicon") + ".bin"
    filesystem, path = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(path.rpartition("/")[0])
    with filesystem.open_output_stream(path) as out:
        out.write(lexicon.dump())
    spark.sparkContext.addFile(uri)
    return uri.rpartition("/")[2]


def encode(docs: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (do the ids decode to the text?); one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    name = publish(spark, docs, p)
    shared = spark.sparkContext.broadcast(load_ranks(p["vocabulary"]))  # the vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(shared.value, Lexicon.open(SparkFiles.get(name)), p["remembered"])
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 1000):
                part = texts[at : at + 1000]
                encoded = own.encode_all(part)
                ids = [None if e is None else np.frombuffer(e, np.int32) for e in encoded]
                sizes = [0 if e is None else len(e) // 4 for e in encoded]
                offsets = pa.array([None if e is None else o for e, o in zip(encoded, accumulate([0, *sizes]))] + [sum(sizes)], pa.int32())
                flat = pa.array(np.frombuffer(b"".join(e for e in encoded if e), np.int32))
                same = [None if t is None else own.decode(i) == t.encode("utf-8") for t, i in zip(part, ids)]
                n = [None if t is None else s for t, s in zip(part, sizes)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.ListArray.from_arrays(offsets, flat), pa.array(n, pa.int32()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode(rows: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); bytes that aren't UTF-8 become U+FFFD; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load_ranks(p["vocabulary"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(shared.value, Lexicon.build([], []))
        for b in batches:
            texts = [None if i is None else b"".join(map(own.bytes_of.__getitem__, i)).decode("utf-8", "replace") for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
