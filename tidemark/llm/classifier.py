"""Quality classifier on supervised subword embeddings.

Every word has hashed features: itself and its character n-grams. Each feature has a learned vector, a
document is the mean of the vectors of all its features, and a softmax layer gives class probabilities.
Vectors and layer are trained together by numpy stochastic gradient descent on `labels.quality`.

The mean and the layer are both linear, so scoring needs just the layer applied to each feature vector
once: a word's sums of class scores are cached, and a document is the sum over its words.

Training reads at most `max_per_class` labelled documents of each class, those of the smallest hashed
doc_id among the documents that are there; whole texts, both in training and in scoring. Everything else covers all rows.
Texts stay on the executors: they send each document's features, one partition at a time, to a file of the driver that the descent reads.

Defined cases: a null or blank text has no features and scores by the bias alone, and `keep_good`
rejects it; a null doc_id is scored, never used in training; a doc_id with several labels uses the
largest; repeated rows are scored row by row; without labelled documents, or with one class only, the
class priors decide; an empty table gives an empty result; other columns are ignored by `score` and
returned untouched by `keep_good`.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import cut, numbered, slices

CLASSES = 2  # 0 low quality, 1 good
#: buckets is a power of 2; a document is rejected when p_good is under threshold, which is low since clean documents are to stay.
PARAMETERS = {"buckets": 1 << 18, "dims": 8, "ngrams": (3, 4, 5), "epochs": 4, "rate": 0.4, "batch": 8, "max_per_class": 1500, "threshold": 0.2, "seed": 7}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) * _BASE


def word_features(words: list[str], buckets: int, ngrams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, and for each the index of its word: the word itself and the n-grams of <word>."""
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(flat)) - starts[owner]).astype(np.uint64)
    whole = np.add.reduceat(_mix(flat + place * _MIX), starts) if len(words) else np.zeros(0, np.uint64)
    found, of = [_mix(whole)], [np.arange(len(words))]
    h = flat.copy()
    for n in range(2, max(ngrams) + 1):
        if len(flat) < n:
            break
        h = h[:-1] * _BASE + flat[n - 1 :]
        if n in ngrams:
            inside = owner[: len(h)] == owner[n - 1 :]
            found.append(_mix(h[inside] + np.uint64(n)))
            of.append(owner[: len(h)][inside])
    return (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(of)


def document_features(text: str | None, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature buckets of a text and the share of each."""
    counts = Counter((text or "").split())  # np.unique would give every word the room of the longest
    words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
    weight = np.zeros(p["buckets"])
    for x, y in slices([len(w) for w in words], 1_000_000):
        f, of = word_features(words[x:y], p["buckets"], p["ngrams"])
        weight += np.bincount(f, n[x:y][of], p["buckets"])
    k = np.nonzero(weight)[0]
    return k.astype(np.int32), (weight[k] / max(weight.sum(), 1)).astype(np.float32)


class Stored(Sequence):
    """Features of documents in a file, in the order in which they were given; only their places are in memory."""

    def __init__(self, path: Path, parts: Iterator[tuple[int, bytes, bytes]]):
        self.at: dict[int, tuple[int, int]] = {}
        end = 0
        with path.open("wb") as file:
            for i, k, w in parts:
                self.at[i] = end, len(k) // 4
                end += file.write(k) + file.write(w)
        self.order = sorted(self.at)
        self.words = np.memmap(path, np.int32, "r") if end else np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        start, n = self.at[self.order[i]]
        return self.words[start // 4 : start // 4 + n], self.words[start // 4 + n : start // 4 + 2 * n].view(np.float32)


def train(texts: list[str], classes: list[int], p: dict = PARAMETERS) -> np.ndarray:
    """Class scores of each feature (buckets x classes), with the bias as the last row."""
    return descend([document_features(text, p) for text in texts], classes, p)


def descend(docs: Sequence[tuple[np.ndarray, np.ndarray]], classes: list[int], p: dict) -> np.ndarray:
    """The same, from document_features."""
    rng = np.random.default_rng(p["seed"])
    E = ((rng.random((p["buckets"], p["dims"])) - 0.5) / p["dims"]).astype(np.float32)
    W = np.zeros((p["dims"], CLASSES), np.float32)
    y = np.asarray(classes, np.int64)
    counts = np.bincount(y, minlength=CLASSES) + 1.0
    bias = np.log(counts / counts.sum()).astype(np.float32)
    if len(set(classes)) == CLASSES:
        steps, step = p["epochs"] * len(docs), 0
        for _ in range(p["epochs"]):
            order = rng.permutation(len(docs))
            for b in range(0, len(order), p["batch"]):
                rate = p["rate"] * (1 - step / steps)
                gW, gb = np.zeros_like(W), np.zeros_like(bias)
                for i in order[b : b + p["batch"]]:
                    step += 1
                    k, w = docs[i]
                    if not len(k):
                        continue
                    v = w @ E[k]
                    z = v @ W + bias
                    q = np.exp(z - z.max())
                    q /= q.sum()
                    q[y[i]] -= 1
                    q *= counts.sum() / (CLASSES * counts[y[i]])  # classes weigh alike
                    gW += np.outer(v, q)
                    gb += q
                    E[k] -= (rate * len(k) ** 0.5 * w)[:, None] * (W @ q)[None, :]  # the mean makes single features' gradients small
                    if not W.any():
                        W += (rng.random(W.shape) - 0.5).astype(np.float32) * 0.5
                W -= rate * gW
                bias -= 0.1 * rate * gb
    return np.vstack([E @ W, bias[None, :]]).astype(np.float32)


class Scorer:
    """Class probabilities of texts. Words' scores are cached, at most `limit` of them."""

    def __init__(self, model: np.ndarray, p: dict = PARAMETERS, limit: int = 250_000):
        self.model, self.p, self.limit = model, p, limit
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.sums = np.zeros((1024, CLASSES + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        base, need = len(self.ids), len(self.ids) + len(words)
        if need > len(self.sums):
            self.sums = np.vstack([self.sums, np.zeros((max(need, 2 * len(self.sums)) - len(self.sums), CLASSES + 1), np.float32)])
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            f, of = word_features(part, self.p["buckets"], self.p["ngrams"])
            for c in range(CLASSES):
                self.sums[base + at : base + at + len(part), c] = np.bincount(of, self.model[f, c], len(part))
            self.sums[base + at : base + at + len(part), CLASSES] = np.bincount(of, minlength=len(part))
        self.ids.update(zip(words, range(base, need)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), CLASSES))
        for a, b in slices([len(t or "") for t in texts], 1_000_000):
            words = [(t or "").split() for t in texts[a:b]]
            lengths = np.fromiter(map(len, words), np.int64, b - a)
            if len(self.ids) > self.limit:
                self.clear()
            if new := list(set().union(*words) - self.ids.keys()):
                self.learn(new)
            ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
            total = np.zeros((b - a, CLASSES + 1))
            if len(ids):
                has = lengths > 0
                total[has] = np.add.reduceat(self.sums[ids].astype(np.float64), (np.cumsum(lengths) - lengths)[has])
            z = total[:, :CLASSES] / np.maximum(total[:, CLASSES:], 1) + self.model[-1]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            out[a:b] = q / q.sum(axis=1, keepdims=True)
        return out


def fit(docs: DataFrame, labels: DataFrame, p: dict = PARAMETERS) -> np.ndarray:
    """The model, from at most max_per_class labelled documents of each class, the same ones whatever the partitioning."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__quality"))
    order = F.xxhash64(F.col("__id"), F.lit(p["seed"]))
    held = docs.where("text is not null").select(F.col("doc_id").alias("__doc"))
    there, chosen = known.join(held, F.col("__id") == F.col("__doc"), "left_semi"), None
    for c in range(CLASSES):
        part = there.where((F.col("__quality") >= 1) == F.lit(bool(c))).orderBy(order, "__id").limit(p["max_per_class"])
        chosen = part if chosen is None else chosen.unionByName(part)
    ranked = chosen.orderBy(F.col("__quality") >= 1, order, "__id").collect()  # at most max_per_class ids of each class
    numbers = docs.sparkSession.createDataFrame([(r["__id"], i) for i, r in enumerate(ranked)], StructType([chosen.schema["__id"], StructField("__at", LongType())]))
    rows = docs.select("doc_id", "text").join(F.broadcast(numbers), F.col("doc_id") == F.col("__id"))
    rows = rows.where("text is not null").groupBy("__at").agg(F.min("text").cast("string").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [document_features(text.as_py(), p) for text in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("__at"), pa.array([k.tobytes() for k, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], ["__at", "k", "w"])

    with tempfile.TemporaryDirectory(prefix="tidemark-") as folder:
        rows = cut(rows.mapInArrow(featured, "__at long, k binary, w binary"))  # side by side; the iterator would make one partition after the other
        stored = Stored(Path(folder, "features"), rows.toLocalIterator())
        return descend(stored, [int(ranked[i]["__quality"] >= 1) for i in stored.order], p)


def score(docs: DataFrame, labels: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """doc_id, p_good (6 digits), keep; one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, p)
        for b in batches:
            texts = b.column("text").to_pylist()
            q = np.round(scorer(texts)[:, 1], 6)
            keep = [t is not None and bool(t.strip()) and x >= p["threshold"] for t, x in zip(texts, q.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q), pa.array(keep, pa.bool_())], ["doc_id", "p_good", "keep"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, p_good double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, p: dict = PARAMETERS, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as they were. It is trained on the documents `labelled`, or on docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs if labelled is None else labelled, labels, p))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, p)
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = [t is not None and bool(t.strip()) and x >= p["threshold"] for t, x in zip(texts, np.round(scorer(texts)[:, 1], 6).tolist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    plain = numbered(docs)
    return plain.mapInArrow(kept, plain.schema).toDF(*docs.columns)
