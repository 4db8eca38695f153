"""Substring dedup by seed and extend: maximal repeats of at least `length` words across documents.

Words are white-space tokens, compared exactly. Seeds are winnowed anchors: of every `length` consecutive
words, the `seed`-word gram of the smallest hash (all of them on a tie), so that equal stretches of
`length` words have equal anchors. Documents are joined on anchors that two different texts have. From there
matches are extended both ways:

* Every frame of `length` words around such an anchor is joined, by hash, with the frames of all other documents.
* A frame's matches are extended to the left and right as one class while all its documents have the same word there;
  where they first differ, the class ends. So a passage in a hundred thousand documents is a hundred
  thousand rows, not pairs. What lies between two such places is a link; a document's run of shared frames is a chain of links.
* From each link of a chain, the match with other documents is extended to the right over 32, 64, 128, ... more links. Chains that
  begin with the same link are compared in sorted order, where the longest match is next to each other; only those that match
  to the end of what was compared go on to the next round.

A repeat is a stretch of a document that another one has too. A repeat is kept if no longer repeat of its document
contains it, so kept ones may overlap: with A B C in one document, A B in another and B C in a third, the first has the repeats
A B and B C. That is exact: all pairs of documents compared word by word give the same (tests, oracle SQL).
Equal texts are searched once.

`first_doc_id` is the smallest doc_id that has the whole stretch. `remove` cuts every stretch of `length` words or more that a
smaller doc_id has as well, so each passage stays in the document of the smallest doc_id.

Defined cases: null texts and null doc_ids have no repeats, `remove` leaves their rows alone; texts under
`length` words have none; a repeat within one doc_id isn't one across documents and stays; rows with
one doc_id are one document, equal rows are reported once, of differing texts under one doc_id each has its own places; a document of which nothing remains is
dropped by `remove`; an empty table gives an empty result; other columns are ignored by `repeats` and
returned by `remove` as they were, whatever their names, but for n_chars, which follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BoundedCache, cut, numbered, slices

PARAMETERS = {"length": 50, "seed": 16}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TOKEN = re.compile(r"\S+")


def word_cache() -> BoundedCache:
    return BoundedCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), 250_000)


def hashed(texts: list[str | None], cache: BoundedCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text starts (one more entry at the end)."""
    words = [(t or "").split() for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(texts)), out=bounds[1:])
    return np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, int(bounds[-1])), bounds


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of each n consecutive words, wherever they stand."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers = np.full(len(h), _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers, out=total[1:])
    back = np.full(len(h) - n + 1, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    g = (total[n:] - total[:-n]) * back
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return g


def sliding(x: np.ndarray, n: int, fold) -> np.ndarray:  # noqa: ANN001
    """fold (np.minimum or np.maximum) over each n consecutive values."""
    size = 1
    while size * 2 <= n:
        x = fold(x[:-size], x[size:])
        size *= 2
    return fold(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(h: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in hashed(): (text index, word place, hash) of each anchor."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, np.zeros(0, np.uint64)
    g = gram_hashes(h, seed)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    w = length - seed + 1
    least = sliding(g, w, np.minimum)
    whole = text[: len(least)] == text[length - 1 :]  # frames within one text
    least[~whole] = 0
    pad = np.zeros(w - 1, np.uint64)
    chosen = np.nonzero((sliding(np.concatenate([pad, least, pad]), w, np.maximum)[: len(g)] == g) & (g > 0))[0]
    return text[chosen], chosen - bounds[text[chosen]], g[chosen]


def find_anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """h, doc_id, fp, pos of each anchor, and of each text of `length` words or more a row whose h stands for all of it and whose pos is -1 - words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache()
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, fps = b.column("doc_id").to_numpy(), b.column("fp").to_numpy()
            for x, y in slices([len(t or "") for t in texts], 2_000_000):
                h, bounds = hashed(texts[x:y], cache)
                of, pos, g = anchors(h, bounds, length, seed)
                n = np.diff(bounds)
                whole = np.nonzero(n >= length)[0]
                of, pos, g = np.concatenate([of, whole]), np.concatenate([pos, -1 - n[whole]]), np.concatenate([g.view(np.int64), ~fps[x:y][whole]])
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(ids[x:y][of]), pa.array(fps[x:y][of]), pa.array(pos.astype(np.int32))], ["h", "doc_id", "fp", "pos"])

    return docs.mapInArrow(run, "h long, doc_id long, fp long, pos int")


def find_frames(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """h, doc_id, fp, multi, pos, before, after of each frame of `length` words around the anchors in `at` (an array of places); before and after are hashes of the words next to it, null at the ends of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache()
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, fps, at, multi = b.column("doc_id").to_numpy(), b.column("fp").to_numpy(), b.column("at"), b.column("multi").to_numpy(zero_copy_only=False)
            for x, y in slices([len(t or "") for t in texts], 2_000_000):
                h, bounds = hashed(texts[x:y], cache)
                g = gram_hashes(h, length)
                part = at.slice(x, y - x)
                places = part.flatten().to_numpy() + np.repeat(bounds[:-1], part.value_lengths().to_numpy())
                mark = np.zeros(len(h) + length + 1, np.int64)
                np.add.at(mark, np.maximum(places + seed - length, 0), 1)
                np.add.at(mark, places + 1, -1)
                text = np.repeat(np.arange(y - x), np.diff(bounds))
                start = np.nonzero((np.cumsum(mark)[: len(g)] > 0) & (text[: len(g)] == text[length - 1 :]))[0] if len(g) else np.zeros(0, np.int64)
                of = text[start]
                low = np.concatenate([h[:1], h, h[:1]]).astype(np.uint32).view(np.int32)  # one in front, one behind
                before = pa.array(low[start], mask=start == bounds[of])
                after = pa.array(low[start + length + 1], mask=start + length == bounds[of + 1])
                yield pa.RecordBatch.from_arrays([pa.array(g[start].view(np.int64)), pa.array(ids[x:y][of]), pa.array(fps[x:y][of]), pa.array(multi[x:y][of]), pa.array((start - bounds[of]).astype(np.int32)), before, after], ["h", "doc_id", "fp", "multi", "pos", "before", "after"])

    return docs.select("doc_id", "fp", "multi", "text", "at").mapInArrow(run, "h long, doc_id long, fp long, multi boolean, pos int, before int, after int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null").withColumn("fp", F.xxhash64("text"))


def shared_anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, fp, pos, multi: the anchors that two different texts have, each at the smallest doc_id of its text (multi: several documents have that text); and the rows of whole texts that several documents have.

    One shuffle, by h."""
    h, text = Window.partitionBy("h"), Window.partitionBy("h", "fp")
    rows = find_anchors(docs, length, seed).select(
        "*", F.min("doc_id").over(text).alias("own"), F.max("doc_id").over(text).alias("same"), F.min("doc_id").over(h).alias("first"), F.max("doc_id").over(h).alias("last"), F.min("fp").over(h).alias("x"), F.max("fp").over(h).alias("y")
    )
    return cut(rows.where("first < last and (pos < 0 or (x <> y and doc_id = own))").select("doc_id", "fp", "pos", (F.col("own") < F.col("same")).alias("multi")))


CHAINS = "doc_id long, fp long, multi boolean, at int, starts array<int>, ends array<int>, links array<long>, firsts array<long>, opens array<boolean>, cut_from array<int>, cut_to array<int>"


def find_chains(frames: DataFrame, length: int) -> DataFrame:
    """The runs of shared frames as chains of links, one row a run: places of the links, their names, the smallest doc_id that has each; and the places of the run that a smaller doc_id has too."""
    h = Window.partitionBy("h")
    several = lambda c: (F.min(c).over(h) < F.max(c).over(h)) | (F.count(c).over(h) < F.count(F.lit(1)).over(h))
    rows = frames.select("doc_id", "fp", "multi", "pos", "h", F.min("doc_id").over(h).alias("first"), F.max("doc_id").over(h).alias("last"), F.max("multi").over(h).alias("any"), F.min("fp").over(h).alias("x"), F.max("fp").over(h).alias("y"), several("before").alias("opens"), several("after").alias("closes"))
    rows = rows.where("x <> y and (first < last or any)").select("doc_id", "fp", "multi", "pos", "h", "first", "opens", "closes")

    def emit(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Of whole texts' frames in order."""
        text, pos, own = c["fp"], c["pos"], c["doc_id"]
        new_run = np.ones(len(pos), bool)
        new_run[1:] = (text[1:] != text[:-1]) | (own[1:] != own[:-1]) | (pos[1:] != pos[:-1] + 1)
        new_link = new_run | c["opens"]
        new_link[1:] |= c["closes"][:-1]
        run, link = np.nonzero(new_run)[0], np.nonzero(new_link)[0]
        offsets = pa.array(np.append(np.searchsorted(link, run), len(link)).astype(np.int32))
        ends = np.append(link[1:], len(pos)) - 1
        copied = c["first"] < own
        from_ = np.nonzero(copied & (new_run | ~np.append(False, copied[:-1])))[0]
        to = np.nonzero(copied & np.append(new_run[1:] | ~copied[1:], True))[0]
        cuts = pa.array(np.append(np.searchsorted(from_, run), len(from_)).astype(np.int32))
        arrays = [own[run], text[run], c["multi"][run], pos[run]]
        lists = [(offsets, pos[link]), (offsets, pos[ends] + length), (offsets, c["h"][link]), (offsets, c["first"][link]), (offsets, c["opens"][link]), (cuts, pos[from_]), (cuts, pos[to] + length)]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays] + [pa.ListArray.from_arrays(o, pa.array(v, t)) for (o, v), t in zip(lists, types)], [c.split()[0] for c in CHAINS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
            last = np.nonzero((c["fp"] != c["fp"][-1]) | (c["doc_id"] != c["doc_id"][-1]))[0]
            whole = last[-1] + 1 if len(last) else 0  # the last text may go on in the next batch
            if whole or (held and (held[-1]["fp"][-1], held[-1]["doc_id"][-1]) != (c["fp"][0], c["doc_id"][0])):
                held.append({n: v[:whole] for n, v in c.items()})
                yield emit({n: np.concatenate([x[n] for x in held]) for n in c})
                held = []
            held.append({n: v[whole:] for n, v in c.items()})
        if held:
            yield emit({n: np.concatenate([x[n] for x in held]) for n in held[0]})

    return rows.repartition("doc_id", "fp").sortWithinPartitions("doc_id", "fp", "pos").mapInArrow(run, CHAINS)


def longest_shared(ahead: list[list[int]], own: list[int], multi: list[bool], root: int | None = None) -> list[tuple[int, int]]:
    """For each of the sorted lists, how many of its first values another document's list has too, and the smallest document that has those."""
    same = [0] + [next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y))) for x, y in zip(ahead, ahead[1:])]
    return deepest(list(map(len, ahead)), same, own, multi, root)


def common_beginnings(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of lists of n values each, one after the other in flat, how many first values each has in common with the one before; 0 for the first."""
    out = np.zeros(len(n), np.int64)
    start, most = np.cumsum(n) - n, np.zeros(len(n), np.int64)
    most[1:] = np.minimum(n[1:], n[:-1])
    for at, to in slices(most.tolist(), 1 << 19):
        i = np.arange(max(at, 1), to)
        wide = int(most[i].max(initial=0))
        step = max(1, (1 << 20) // max(wide, 1))  # rows side by side
        for k in range(0, len(i) if wide else 0, step):
            j, place = i[k : k + step], np.arange(wide)
            inside = place < most[j][:, None]
            a, b = (np.where(inside, s[:, None] + place, 0) for s in (start[j - 1], start[j]))
            unlike = np.ones((len(j), wide + 1), bool)
            unlike[:, :wide] = ~inside | (flat[a] != flat[b])
            out[j] = unlike.argmax(axis=1)
    return out


def deepest(lengths: list[int], same: list[int], own: list[int], multi: list[bool], root: int | None = None) -> list[tuple[int, int]]:
    """longest_shared() of lists of these lengths, of which each has its first `same` values in common with the one before.

    The lists' common beginnings are a tree; a list's answer is at the nearest node above it that has two documents."""
    found = [(0, 0)] * len(lengths)
    open_: list[list] = [[0, 1 << 62, -(1 << 62), []]]  # nodes on the way down: depth, smallest and largest document, lists without an answer

    def close() -> list:
        depth, low, high, waiting = node = open_.pop()
        if low < high:
            for i in waiting:
                found[i] = (depth, low)
            node[3] = []
        return node

    def into(node: list, child: list) -> None:
        node[1], node[2] = min(node[1], child[1]), max(node[2], child[2])
        node[3] = node[3] + child[3] if len(node[3]) < len(child[3]) else node[3].__iadd__(child[3])

    for i, n in enumerate(lengths):
        while open_[-1][0] > same[i]:
            child = close()
            if open_[-1][0] < same[i]:
                open_.append([same[i], child[1], child[2], child[3]])
            else:
                into(open_[-1], child)
        leaf = [n, own[i], own[i] + multi[i], [i]]
        if open_[-1][0] == n:
            into(open_[-1], leaf)
        else:
            open_.append(leaf)
    while len(open_) > 1:
        child = close()
        into(open_[-1], child)
    depth, low, _, waiting = open_[0]
    for i in waiting:
        found[i] = (0, low if root is None else root)
    return found


def extended(chains: DataFrame, width: int = 32) -> DataFrame:
    """fp, at, j, n, first: from link j of a chain, over how many links another document goes along, and the smallest doc_id that goes along so far.

    Absent are chains of one link, which need no search, and links before which all documents have the same word: what matches from there, matches from further left."""
    long = chains.where(F.size("links") > 1).select("doc_id", "fp", "multi", "at", "links", "firsts", "opens")
    state = long.select("fp", "at", F.posexplode(F.arrays_zip("links", "opens")).alias("j", "x")).where("x.opens").select("fp", "at", "j", F.col("x.links").alias("c"), F.lit(1).alias("done"))
    out = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows: list[tuple] = []

        def settle() -> None:
            _, lengths, same, own, multi = zip(*(r[:5] for r in held))
            for (c, _, _, _, _, ahead, fp, at, j, done, first), (n, low) in zip(held, deepest(lengths, (0, *same[1:]), own, multi)):
                on = n == width
                name = xxhash.xxh3_64_intdigest(c.to_bytes(8, "little", signed=True) + ahead) - (1 << 63) if on else None
                rows.append((fp, at, j, name, done + n, first if done + n == 1 else low, on))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, types)], ["fp", "at", "j", "c", "n", "first", "on"])
            rows.clear()
            return out

        last = np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ahead = b.column("ahead")
            flat, n = ahead.flatten().to_numpy(), ahead.value_lengths().to_numpy().astype(np.int64)
            same = common_beginnings(np.concatenate([last, flat]), np.concatenate([[len(last)], n]))[1:]  # with what the batch before ended with
            ends = np.cumsum(n)
            last = flat[ends[-1] - n[-1] :].copy()
            whole = [flat[e - k : e].tobytes() if k == width else None for e, k in zip(ends.tolist(), n.tolist())]  # only those may go on
            for r in zip(b.column("c").to_pylist(), n.tolist(), same.tolist(), *[b.column(x).to_pylist() for x in ("doc_id", "multi")], whole, *[b.column(x).to_pylist() for x in ("fp", "at", "j", "done", "first")]):
                if held and held[0][0] != r[0]:
                    settle()
                    held.clear()
                held.append(r)
            yield flush()
        if held:
            settle()
        yield flush()

    while True:
        begin = F.col("j") + F.col("done") + 1
        left = F.greatest(F.least(F.size("links") - F.col("j") - F.col("done"), F.lit(width)), F.lit(0))
        rows = state.join(long, ["fp", "at"]).select("c", F.when(left > 0, F.slice("links", begin, left)).otherwise(F.array().cast("array<long>")).alias("ahead"), "doc_id", "multi", "fp", "at", "j", "done", F.get("firsts", F.col("j")).alias("first"))
        found = cut(rows.repartition("c").sortWithinPartitions("c", "ahead").mapInArrow(run, "fp long, at int, j int, c long, n int, first long, on boolean"))
        done = found.where("not on").select("fp", "at", "j", "n", "first")
        out = done if out is None else out.unionByName(done)
        on = found.where("on")
        if not on.head(1):
            return out
        state, width = on.select("fp", "at", "j", "c", F.col("n").alias("done")), 2 * width


def _kept(chains: DataFrame, matches: DataFrame) -> DataFrame:
    """fp, doc_id, multi, start_word, end_word, first: the matches that no other one of their chain contains."""
    lists = matches.groupBy("fp", "at").agg(F.collect_list(F.struct("j", "n", "first")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for fp, doc_id, multi, starts, ends, firsts, found in zip(*[b.column(n).to_pylist() for n in ("fp", "doc_id", "multi", "starts", "ends", "firsts", "found")]):
                reach = 0
                for j, n, first in sorted((r["j"], r["n"], r["first"]) for r in found) if found else [(0, 1, firsts[0])]:
                    if j + n > reach:
                        reach = j + n
                        out.append((fp, doc_id, multi, starts[j], ends[reach - 1], first))
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, types)], ["fp", "doc_id", "multi", "start_word", "end_word", "first"])

    rows = chains.select("fp", "at", "doc_id", "multi", "starts", "ends", "firsts").join(lists, ["fp", "at"], "left")
    return rows.select("fp", "doc_id", "multi", "starts", "ends", "firsts", "found").mapInArrow(run, "fp long, doc_id long, multi boolean, start_word int, end_word int, first long")


def searched(docs: DataFrame, length: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The chains of all texts, and doc_id, fp, n of the documents whose text others have too."""
    docs = _keyed(docs)
    found = shared_anchors(docs, length, seed)
    at = found.where("pos >= 0").groupBy("doc_id", "fp", "multi").agg(F.collect_set("pos").alias("at"))
    chains = cut(find_chains(find_frames(docs.join(at, ["doc_id", "fp"]), length, seed), length))
    return chains, found.where("pos < 0").select("doc_id", "fp", (-1 - F.col("pos")).alias("n")).distinct()


def repeats(docs: DataFrame, length: int = PARAMETERS["length"], seed: int = PARAMETERS["seed"]) -> DataFrame:
    """doc_id, start_word, end_word, n_words, first_doc_id, is_copy: each maximal repeat at each of its places; end_word is exclusive."""
    chains, copies = searched(docs, length, seed)
    kept = cut(_kept(chains, extended(chains)))
    own = kept.where("not multi").select("doc_id", "fp", "start_word", "end_word", "first")
    # a text that several documents have is one repeat, the whole of it; larger texts may have all of it as well
    whole = copies.withColumn("least", F.min("doc_id").over(Window.partitionBy("fp")))
    around = kept.where("multi and start_word = 0").select(F.col("fp").alias("f"), F.col("end_word").alias("e"), F.col("first").alias("around"))
    whole = whole.join(around, (F.col("fp") == F.col("f")) & (F.col("n") == F.col("e")), "left")
    whole = whole.select("doc_id", "fp", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.least("least", "around").alias("first"))
    spans = own.unionByName(whole)
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("first").alias("first_doc_id"), (F.col("first") < F.col("doc_id")).alias("is_copy"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in the spans and the white space after them."""
    places = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
    kept, at = [], 0
    for a, b in sorted(spans):
        if places[a] > at:
            kept.append(text[at : places[a]])
        at = max(at, places[b])
    return ("".join(kept) + text[at:]).strip()


def remove(docs: DataFrame, length: int = PARAMETERS["length"], seed: int = PARAMETERS["seed"]) -> DataFrame:
    """docs without the copies of repeats; a document that was nothing else is gone."""
    chains, copies = searched(docs, length, seed)
    pair = F.zip_with("cut_from", "cut_to", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    parts = chains.where(F.size("cut_from") > 0).select("doc_id", "fp", pair.alias("s"))
    wholes = copies.withColumn("least", F.min("doc_id").over(Window.partitionBy("fp"))).where("doc_id > least")
    wholes = wholes.select("doc_id", "fp", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("s"))
    cuts = parts.unionByName(wholes).groupBy("doc_id", "fp").agg(F.flatten(F.collect_list("s")).alias("s"))
    names = docs.columns
    own = numbered(docs)
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    c = [f"c{i}" for i in range(len(names))]
    cuts = cut(cuts.toDF("k_id", "k_fp", "k_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(names)).to_pylist()
            touched = [i for i, s in enumerate(spans) if s]
            columns = [b.column(i) for i in range(len(names))]
            if touched:
                texts = columns[text].to_pylist()
                for i in touched:
                    texts[i] = without(texts[i], [(s["a"], s["b"]) for s in spans[i]])
                columns[text] = pa.array(texts, columns[text].type)
                if chars is not None:
                    n = columns[chars].to_pylist()
                    for i in touched:
                        n[i] = len(texts[i])
                    columns[chars] = pa.array(n, columns[chars].type)
            out = pa.RecordBatch.from_arrays(columns, c)
            gone = {i for i in touched if not texts[i]} if touched else ()
            yield out.filter(pa.array([i not in gone for i in range(len(spans))], pa.bool_())) if gone else out

    joined = own.join(cuts, (F.col(c[names.index("doc_id")]) == F.col("k_id")) & (F.xxhash64(c[text]) == F.col("k_fp")), "left")
    return joined.select(*c, "k_s").mapInArrow(run, own.schema).toDF(*names)


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM d),
f AS (SELECT doc_id, text, w, unnest(range(0, len(w) - 49)) AS s FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, hash(text) AS fp, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM f),
p AS (SELECT x.doc_id, x.fp, x.s, y.doc_id AS other, y.fp AS other_fp, y.s - x.s AS apart FROM h x JOIN h y USING (h) WHERE x.doc_id <> y.doc_id),
i AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, fp, other, other_fp, apart ORDER BY s) AS island FROM p),
m AS (SELECT doc_id, fp, other, min(s) AS a, max(s) + 50 AS b FROM i GROUP BY doc_id, fp, other, other_fp, apart, island),
g AS (SELECT doc_id, fp, a, b, least(doc_id, min(other)) AS first_doc_id FROM m GROUP BY doc_id, fp, a, b),
k AS (SELECT *, max(b) OVER (PARTITION BY doc_id, fp ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)
SELECT DISTINCT doc_id, a::INTEGER AS start_word, b::INTEGER AS end_word, (b - a)::INTEGER AS n_words, first_doc_id, first_doc_id < doc_id AS is_copy FROM k WHERE reach IS NULL OR b > reach
"""
