"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint: 128 signs of the sum of word hashes weighted by log(1 + count); words are the lower-cased
white-space tokens of the whole text without the marks .,;:?" (so a shouted copy is an equal text). Other symbols are
part of their words, but one that stands alone counts once, however often: rows of rulers, bullets or
emphasis marks would else outweigh the words. Two documents are near duplicates when the first 64 bits differ in at
most `radius` places and all 128 in at most `radius_full`.

Search: the 64 bits are split into groups of bits that correlate; group i gets a threshold t_i with
sum(t_i + 1) = radius + 1, so that any pair within the radius is within t_i in some group. Thresholds
are unequal: dynamic programming picks those of least cost, from the number of candidate pairs at each
distance in each group, which the XOR-autocorrelation of the group's value counts over all documents
gives exactly; for a group of more than `EXACT_BITS` bits it is estimated from those of the group's parts, as if these were
independent. The wider the keys, the fewer pairs meet and the more values each side has to list, so the number of groups goes
down as documents grow in number, to two of 32 bits: the programme's costs decide. Half of t_i is enumerated on either side of an equi-join, pairs are verified in the join
condition. Whatever the grouping and thresholds, the result is the exact one.

Groups are connected components of the pairs; the smallest doc_id of each stays.

Defined cases: a null text, or one without words, is a group of its own; rows with one doc_id are one
document (its smallest fingerprint counts, its smallest text stays); rows with a null doc_id are absent
from `groups` and untouched by `keep_one`; equal texts are always in one group; an empty table gives an
empty result; other columns are ignored by `groups` and returned untouched by `keep_one`, whatever their names.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, cut, numbered

PARAMETERS = {"radius": 9, "radius_full": 24}
BITS = 64
EXACT_BITS = 20  # 2^20 counts at most go to the driver
_SYMBOLS = frozenset(string.punctuation)  # as words of their own they count once


def words_of(text: str) -> list[str]:
    text = text.lower()
    for mark in '.,;:?"':
        text = text.replace(mark, "")
    return text.split()


def fingerprints(texts: list[str | None], cache: BoundedCache | None = None) -> tuple[list[int | None], list[int | None]]:
    """The two 64-bit halves (as signed integers) of each text's fingerprint; None without words."""
    cache = cache if cache is not None else BoundedCache(lambda w: xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")), 200_000)
    hi: list[int | None] = []
    lo: list[int | None] = []
    weight = np.round(np.log1p(np.arange(4096)) * 1024)
    for text in texts:
        counts = Counter(words_of(text)) if text else None
        if not counts:
            hi.append(None)
            lo.append(None)
            continue
        for symbol in _SYMBOLS & counts.keys():
            counts[symbol] = 1
        n = np.fromiter(counts.values(), np.int64, len(counts))
        w = np.where(n < 4096, weight[np.minimum(n, 4095)], np.round(np.log1p(n) * 1024))
        total = np.zeros(128)
        digests = np.frombuffer(b"".join(map(cache.__getitem__, counts)), np.uint8).reshape(-1, 16)
        for at in range(0, len(w), 8192):
            total += w[at : at + 8192] @ np.unpackbits(digests[at : at + 8192], axis=1).astype(np.float64)
        a, b = np.packbits(total > w.sum() / 2).view(">i8")  # sums of whole numbers: exact in any order
        hi.append(int(a))
        lo.append(int(b))
    return hi, lo


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo: one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = BoundedCache(lambda w: xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")), 200_000)
        for b in batches:
            hi, lo = fingerprints(b.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["doc_id", "hi", "lo"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, hi long, lo long")


def bit_correlations(sigs: DataFrame) -> np.ndarray:
    """Absolute correlation of the bits of hi over all rows of sigs."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b.column("hi").to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for at in range(0, len(bits), 1 << 14):
                part = bits[at : at + (1 << 14)]
                total += part.T @ part
                rows += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()])], ["n", "moments"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for b in batches:
            rows += sum(b.column("n").to_pylist())
            for x in b.column("moments").to_pylist():
                total += np.frombuffer(x).reshape(BITS, BITS)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()])], ["n", "moments"])

    parts = sigs.select("hi").mapInArrow(moments, "n long, moments binary").repartition(8).mapInArrow(added, "n long, moments binary").collect()
    n = max(1, sum(r.n for r in parts))
    both = sum((np.frombuffer(r.moments).reshape(BITS, BITS) for r in parts), np.zeros((BITS, BITS))) / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd))


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near equal size; each grows from the most correlated free bit by the one most correlated with it."""
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        order = sorted(free)
        seed = max(order, key=lambda b: (correlation[b, order].sum(), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            nxt = max(sorted(free), key=lambda b: (correlation[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def pairs_by_distance(counts: np.ndarray) -> np.ndarray:
    """Ordered pairs of rows at each distance 0..b, from how many rows have each of the 2^b values: a Walsh-Hadamard transform."""
    b = int(log2(len(counts)))
    x = counts.astype(np.float64)
    for _ in range(2):
        h = 1
        while h < len(x):
            x = x.reshape(-1, 2, h)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).reshape(-1)
            h *= 2
        if _ == 0:
            x = x * x
    x /= len(counts)
    return np.bincount(np.bitwise_count(np.arange(len(counts), dtype=np.uint32)), np.maximum(x, 0), b + 1)


def ball(b: int, r: int) -> int:
    return sum(comb(b, i) for i in range(r + 1)) if r >= 0 else 0


def meetings(b: int, d: int, left: int, right: int) -> int:
    """How many values lie within `left` of one and within `right` of another value at distance d."""
    return sum(comb(d, i) * comb(b - d, j) for i in range(d + 1) for j in range(b - d + 1) if i + j <= left and d - i + j <= right)


def allocate(distances: list[np.ndarray], rows: int, radius: int, row_cost: float = 1.0, pair_cost: float = 0.03) -> list[int]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 of least estimated cost, by dynamic programming. -1: the group isn't probed."""

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        b, left, right = len(distances[i]) - 1, t // 2, t - t // 2
        pairs = sum(distances[i][d] * meetings(b, d, left, right) for d in range(min(b, t) + 1))
        return row_cost * rows * (ball(b, left) + ball(b, right)) + pair_cost * pairs

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(distances)):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, min(radius, len(distances[i]) - 1) + 1):
                u = used + t + 1
                if u <= radius + 1 and ((v := c + cost(i, t)) < nxt.get(u, (float("inf"), []))[0]):
                    nxt[u] = (v, [*ts, t])
        best = nxt
    return best[radius + 1][1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits: list[int]) -> int:
    return sum(1 << (63 - b) for b in bits)  # bit 0 is the most significant, as unpacked


def _flips(bits: list[int], r: int) -> list[int]:
    from itertools import combinations

    return [_mask(list(c)) for k in range(r + 1) for c in combinations(bits, k)]


def plan(sigs: DataFrame, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Bit groups and their thresholds for n distinct fingerprints."""
    m = max(2, ceil(BITS / min(32.0, max(8.0, log2(max(n, 2)) - 2))))
    groups = grouped_bits(bit_correlations(sigs), m)
    return list(zip(groups, allocate([_distances(sigs, bits, n) for bits in groups], n, radius)))


def _distances(sigs: DataFrame, bits: list[int], n: int) -> np.ndarray:
    """pairs_by_distance of the values of some bits."""
    if len(bits) > EXACT_BITS:
        half = len(bits) // 2
        return np.convolve(_distances(sigs, bits[:half], n), _distances(sigs, bits[half:], n)) / max(n, 1) ** 2
    value = sum((F.shiftleft(F.shiftrightunsigned("hi", 63 - b).bitwiseAND(F.lit(1).cast("long")), k) for k, b in enumerate(bits)), F.lit(0).cast("long"))
    found = sigs.groupBy(value.alias("v")).count().toPandas()
    counts = np.zeros(1 << len(bits))
    counts[found["v"].to_numpy(np.int64)] = found["count"].to_numpy()
    return pairs_by_distance(counts)


def near_pairs(sigs: DataFrame, radius: int = PARAMETERS["radius"], radius_full: int = PARAMETERS["radius_full"], how: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """a < b: all pairs of the rows (id, hi, lo; distinct fingerprints) within both radii."""
    spark: SparkSession = sigs.sparkSession
    how = how or plan(sigs, sigs.count(), radius)

    def side(right: bool) -> DataFrame:
        probes = [(i, _signed(_mask(bits)), _signed(f)) for i, (bits, t) in enumerate(how) if t >= 0 for f in _flips(bits, t - t // 2 if right else t // 2)]
        table = F.broadcast(spark.createDataFrame(probes, "part int, mask long, flip long"))  # as many rows as a threshold has flips, whatever the data
        s = "r" if right else "l"
        return sigs.crossJoin(table).select("part", F.col("hi").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key"), F.col("id").alias(f"{s}_id"), F.col("hi").alias(f"{s}_hi"), F.col("lo").alias(f"{s}_lo"))

    apart = F.bit_count(F.col("l_hi").bitwiseXOR(F.col("r_hi")))
    rest = F.bit_count(F.col("l_lo").bitwiseXOR(F.col("r_lo")))
    return (
        side(False).join(side(True), ["part", "key"])
        .where((F.col("l_id") < F.col("r_id")) & (apart <= radius) & (apart + rest <= radius_full))
        .select(F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """v, root of every vertex of edges (a, b) but the roots themselves: alternating large and small stars until nothing changes."""
    edges = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        w = Window.partitionBy("u")
        large = both.withColumn("m", F.least(F.min("v").over(w), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.withColumn("m", F.min("v").over(w))
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def groups(docs: DataFrame, radius: int = PARAMETERS["radius"], radius_full: int = PARAMETERS["radius_full"]) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of the group), keep; one row per doc_id."""
    sigs = sketch(docs.where("doc_id is not null")).groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("s")).select("doc_id", "s.hi", "s.lo")
    sigs = cut(sigs.withColumn("rep", F.when(F.col("hi").isNotNull(), F.min("doc_id").over(Window.partitionBy("hi", "lo"))).otherwise(F.col("doc_id"))))
    distinct = cut(sigs.where("hi is not null and rep = doc_id").select(F.col("doc_id").alias("id"), "hi", "lo"))
    roots = components(near_pairs(distinct, radius, radius_full))
    return sigs.join(roots, F.col("rep") == F.col("v"), "left").select("doc_id", F.coalesce("root", "rep").alias("group_id")).withColumn("keep", F.col("doc_id") == F.col("group_id"))


def keep_one(docs: DataFrame, **radii: int) -> DataFrame:
    """The rows of docs that stay, one of each group, all columns as they were."""
    names = docs.columns
    kept = groups(docs, **radii).where("keep").select(F.col("doc_id").alias("kept"))
    own = numbered(docs)
    key, text = own.columns[names.index("doc_id")], own.columns[names.index("text")]
    first = F.row_number().over(Window.partitionBy("kept").orderBy(F.col(text).asc_nulls_last()))
    rows = own.join(kept, F.col(key) == F.col("kept")).withColumn("at", first).where("at = 1").select(*own.columns)
    return rows.unionAll(own.where(F.col(key).isNull())).toDF(*names)
