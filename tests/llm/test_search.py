"""Neighbours by collision counting, packing, and the pipeline."""

import random
from collections import Counter

import numpy as np
import xxhash

from tests.llm.helpers import DOCS, awkward, clashing, prose, row
from tidemark.llm import ann, common, near_dedup, packing, quality_rules, substring_dedup


def brute(ids, v, k):  # noqa: ANN001, ANN201
    d = np.sqrt(((v[:, None].astype(np.float64) - v[None]) ** 2).sum(-1)).round(6)
    np.fill_diagonal(d, np.inf)
    return {int(i): [int(j) for j in ids[np.lexsort((ids, d[a]))[:k]]] for a, i in enumerate(ids)}


def recall(rows, want):  # noqa: ANN001, ANN201
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    return np.mean([len(set(w) & got.get(i, set())) / len(w) for i, w in want.items() if w])


def test_recall_over_all_queries(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 32))
    v = np.concatenate([centres[rng.integers(0, 8, 500)] + 0.6 * rng.standard_normal((500, 32)), rng.standard_normal((300, 32))]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(10_000)[: len(v)]
    df = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in zip(ids, v)], "vec_id long, embedding array<float>, label int")
    for block in (8192, 250):
        rows = ann.neighbours(clashing(df), ann.PARAMETERS | {"block": block}).collect()
        assert recall(rows, brute(ids, v, 10)) >= 0.9
        assert len(rows) == 10 * len(v) and all(r.vec_id != r.neighbour_id for r in rows)


def test_vectors_without_structure_and_far_cells():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = ann.PARAMETERS
    ids = np.arange(3000)
    whole, half = ann.Index(ids, v, p), ann.Index(ids[1500:], v[1500:], p)
    q, x, d = whole.search(ids[:200], v[:200])
    found = [set(x[q == i].tolist()) for i in range(200)]
    exact = np.sqrt(((v[:200, None] - v[None]) ** 2).sum(-1))
    exact[np.arange(200), np.arange(200)] = 9
    want = np.argsort(exact, axis=1)[:, :10]
    assert np.mean([len(f & set(w.tolist())) for f, w in zip(found, want)]) >= 9
    limit = np.sort(exact, axis=1)[:, 9] + 1e-6
    q, x, d = half.search(ids[:200], v[:200], limit)  # only what is within the limit
    near = {(i, j) for i, j in zip(*np.nonzero(exact <= limit[:, None])) if j >= 1500}
    got = set(zip(q.tolist(), (x + 1500).tolist()))
    assert got <= near and len(got) >= 0.9 * len(near) and (d <= limit[q] + 1e-5).all()


def test_collisions_are_counted_in_the_windows():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((200, 5)).astype(np.float32)
    p = ann.PARAMETERS | {"projections": 7, "slack": 0.0}
    own = ann.Index(np.arange(200), v, p)
    where = own.directions @ v[:9].T
    for half in (0.0, 0.3, 2.0, 100.0):
        plain = (np.abs((own.directions @ v.T)[:, None, :] - where[:, :, None]) <= half + 1e-6).sum(axis=0) >= ann.enough(p)
        assert (own.collided(where, np.full(9, half + 1e-6, np.float32)) == plain).mean() > 0.999


def test_neighbours_on_awkward_tables(spark):
    e = lambda *x: [float(y) for y in x]
    rows = [(1, e(0, 0)), (2, e(0, 0)), (3, e(1, 0)), (3, e(1, 0)), (4, None), (5, []), (6, [None, 1.0]), (7, e(1, 2, 3)), (8, [float("nan"), 0.0]), (None, e(1, 1)), (9, e(5, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour_id, r.distance))
    assert {i: [n for n, _ in x] for i, x in got.items()} == {1: [2, 3, 9], 2: [1, 3, 9], 3: [1, 2, 9], 9: [3, 1, 2]}
    assert got[1][0] == (2, 0.0)
    assert ann.neighbours(df.where("vec_id = 1")).count() == 0 and ann.neighbours(clashing(df).where("false")).count() == 0
    same = spark.createDataFrame([(i, e(1, 1, 1)) for i in range(60)], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in ann.neighbours(clashing(same), ann.PARAMETERS | {"block": 25}).where("vec_id = 5").select("neighbour_id", "distance").collect()} == {(i, 0.0) for i in range(11) if i != 5}


def plain_sketch(text: str, p: dict) -> list[int]:
    m, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    words = [xxhash.xxh3_64_intdigest(w.strip(".,;:!?\"'()").lower().encode()) for w in text.split()]
    found = set()
    for x, y in zip(words, words[1:]):
        g = (x * base + y) & m
        g ^= g >> 29
        found.add((g * base & m) >> 1)
    return sorted(found or {w >> 1 for w in words})[: max(p["sketch"], len(words) // p["words_a_pair"])]


def brute_links(docs: dict, p: dict) -> dict:
    sketch = {i: plain_sketch(t, p) for i, t in docs.items()}
    df = {}
    for s in sketch.values():
        for w in s:
            df[w] = df.get(w, 0) + 1
    terms = {i: sorted((df[w], w) for w in s if df[w] > 1)[: max(p["terms"], -(-len(s) // 3))] for i, s in sketch.items()}
    out = {}
    for a in terms:
        for b in terms:
            if a < b and terms[a] != terms[b] and (both := set(terms[a]) & set(terms[b])):
                out[(a, b)] = round(sum(1 / np.log2(1 + d) for d, _ in both), 6)
    return out, terms


def brute_windows(docs: dict, p: dict) -> tuple[list, list]:
    """The paths of documents, and (doc_id, path, window, from, to) when all are in one block: one link after the other, no Spark."""
    near, terms = brute_links(docs, p)
    node = {i: min(j for j in terms if terms[j] == t) if t else i for i, t in terms.items()}
    near = {(a, b): n for (a, b), n in near.items() if node[a] == a and node[b] == b}
    kept = set()
    for i in set(node.values()):
        kept |= set(sorted((x for x in near if i in x), key=lambda x: (-near[x], x))[: p["neighbours"]])
    degree = Counter(i for x in kept for i in x)
    path = {i: [i] for i in set(node.values())}
    for a, b in sorted(kept, key=lambda x: (min(degree[x[0]], degree[x[1]]), -near[x], x)):
        u, v = path[a], path[b]
        if u is not v and a in (u[0], u[-1]) and b in (v[0], v[-1]):
            joined = (u if u[-1] == a else u[::-1]) + (v if v[0] == b else v[::-1])
            for i in joined:
                path[i] = joined
    paths = {min(x): x if x[0] < x[-1] else x[::-1] for x in path.values()}
    # single nodes come first, then each path from its smaller end
    order = sorted(paths.values(), key=lambda x: (len(x) > 1, x[0]))
    members = {i: sorted(j for j in node if node[j] == i) for i in path}
    at, filled = 0, []
    for k, x in enumerate(order):
        for doc in [j for i in x for j in members[i]]:
            for word in range(len(docs[doc].split())):
                if word and at % p["window"]:
                    filled[-1][4] += 1
                else:
                    filled.append([doc, k, at // p["window"], word, word + 1])
                at += 1
    return sorted(tuple(j for i in x for j in members[i]) for x in order), [tuple(x) for x in filled]


def test_queries_are_searched_among_all_vectors_whatever_the_broadcasts(spark, monkeypatch):
    v = np.random.default_rng(8).standard_normal((3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    p, seen, stored = ann.PARAMETERS | {"block": 300, "step": 50}, [], ann.cut
    monkeypatch.setattr(ann, "cut", lambda rows: seen.append(stored(rows)) or seen[-1])
    found = [sorted(map(tuple, ann.neighbours(df, p | {"queries": queries}).collect())) for queries in (16384, 7)]
    assert sum(x.count() for x in seen if "v" in x.columns) <= 2 * (2 * 3000 + 60)  # vectors are not copied for each broadcast
    assert found[0] == found[1] and len(found[0]) == 600 and {r[0] for r in found[0]} == set(range(0, 3000, 50))
    hit = 0
    for i in range(0, 3000, 50):
        order = np.argsort(((v - v[i]) ** 2).sum(axis=1), kind="stable")
        hit += len({r[2] for r in found[0] if r[0] == i} & {int(j) for j in order[:11]})
    assert hit >= 0.9 * 600


def test_packing_is_that_of_brute_force(spark):
    rng = random.Random(12)
    docs = {i: " ".join(f"w{rng.randrange(12)}t{i % 3}" for _ in range(rng.randint(20, 90))) for i in range(50)}
    docs |= {100 + i: docs[i] for i in range(5)} | {200: " ".join(docs[i] for i in range(30)), 201: "lone words here", 202: "x"}
    docs = {i: t for i, t in rng.sample(sorted(docs.items()), len(docs))}
    df = spark.createDataFrame([row(i, t) for i, t in docs.items()], DOCS)
    for p in ({"window": 100}, {"window": 100, "local_links": 0}, {"window": 64, "sketch": 6, "words_a_pair": 5, "terms": 2}, {"neighbours": 1}):
        p = packing.PARAMETERS | {"block_windows": 1000} | p
        paths, want = brute_windows(docs, p)
        got = packing.pack(df, p).toPandas()
        assert got.block.nunique() == 1 and [tuple(x) for x in got.sort_values(["window", "position"])[["doc_id", "path", "window", "word_from", "word_to"]].to_numpy()] == want
        assert max(map(len, paths)) >= 4 < len(paths)
        spread = packing.pack(df, p | {"block_windows": 1, "window": 50}).toPandas()
        whole = spread[spread.word_from == 0].sort_values(["block", "window", "position"])
        assert spread.block.nunique() > 1 and sorted(tuple(x) for x in whole.groupby(["block", "path"]).doc_id.agg(list)) == paths


def related() -> dict:
    rng = random.Random(3)
    topics = [[prose(1000 * t + i, 1) for i in range(40)] for t in range(6)]
    return {i: " ".join(rng.choice(topics[i % 6]) for _ in range(60)) for i in range(60)}


def test_relatedness_is_rounded_without_decimals(spark):
    held = {1: [(3, 7), (5, 8)], 2: [(3, 7), (5, 8)], 3: [(3, 7), (2, 9)], 4: [(2, 9)]}
    found = packing.links(spark.createDataFrame([(i, t) for i, t in held.items()], "id long, t array<struct<df: long, word: long>>"))
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, b): round(sum(1 / np.log2(1 + df) for df, _ in {*held[a]} & {*held[b]}), 6) for a in held for b in held if a != b and {*held[a]} & {*held[b]}}
    assert {(r.a, r.b): r.near for r in found.collect()} == want


def test_graph_is_exact(spark):
    docs, p = related(), packing.PARAMETERS
    want, terms = brute_links(docs, p)
    nodes = spark.createDataFrame([(i, [{"df": d, "word": w} for d, w in t]) for i, t in terms.items() if t], "id long, t array<struct<df:long,word:long>>")
    got = {(r.a, r.b): r.near for r in packing.links(nodes).where("a < b").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want) and len(want) > 20
    sketched = packing.sketches(spark.createDataFrame([row(i, t) for i, t in docs.items()], DOCS), p)
    assert {r.doc_id: [(x.df, x.word) for x in r.t] for r in packing.terms_of(sketched, p["terms"]).collect()} == {i: t for i, t in terms.items() if t}


def test_trees_follow_nearest_links(spark):
    rng = random.Random(9)
    near = {i: rng.randrange(i) if i else 1 for i in range(200)}
    got = {r.id: r.root for r in packing.trees(spark.createDataFrame(list(near.items()), "a long, b long")).collect()}
    assert got == dict.fromkeys(range(200), 0)


def test_walk_starts_low_and_visits_all():
    near = {1: [2, 3], 2: [1, 3], 3: [2, 1], 4: [3]}
    assert packing.walk([1, 2, 3, 4, 5], near) == [[5], [4, 3, 2, 1]]


def test_windows_hold_every_word_once(spark):
    p = packing.PARAMETERS | {"window": 100, "block_windows": 8}
    docs = related() | {100 + i: related()[i] for i in range(5)}
    rows = [row(i, t) for i, t in docs.items()] + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward() if r[1] is None or len(r[1]) < 10**5]
    df = spark.createDataFrame(rows, DOCS)
    got = packing.pack(clashing(df), p).toPandas()
    n = {r.doc_id: len((r.text or "").split()) for r in df.collect() if r.doc_id is not None}
    assert (got.word_to - got.word_from).groupby(got.doc_id).sum().to_dict() == {i: k for i, k in n.items() if k}
    size = (got.word_to - got.word_from).groupby([got.block, got.window]).sum()
    last = size.groupby("block").cumcount(ascending=False) == 0
    assert (size[~last] == 100).all() and (size <= 100).all()
    whole = got[got.word_from == 0].sort_values(["block", "window", "position"])
    order = whole.doc_id.tolist()
    assert all(abs(order.index(i) - order.index(100 + i)) == 1 for i in range(5))
    follow = [(a, b) for a, b, x, y in zip(order, order[1:], whole.path, whole.path[1:]) if x == y and a < 60 and b < 60]
    assert np.mean([a % 6 == b % 6 for a, b in follow]) > 0.9
    assert packing.pack(df.where("false")).count() == 0


def test_paths_are_the_same_for_one_block_and_many(spark):
    docs = related() | {100 + i: related()[i] for i in range(5)}
    df = spark.createDataFrame([row(i, t) for i, t in docs.items()], DOCS)

    def paths(**other):  # noqa: ANN003, ANN202
        got = packing.pack(df, packing.PARAMETERS | other).toPandas()
        whole = got[got.word_from == 0].sort_values(["block", "window", "position"])
        return got.block.nunique(), sorted(tuple(x) for x in whole.groupby(["block", "path"]).doc_id.agg(list))

    (one, want), (many, spread), (_, rounds) = paths(), paths(window=50, block_windows=2), paths(window=50, block_windows=2, local_links=0)
    assert one == 1 < many and want == spread == rounds
    sketch = packing.sketches(df)
    nodes = packing.terms_of(sketch, packing.PARAMETERS["terms"]).where("doc_id < 100").withColumnRenamed("doc_id", "id")
    near = packing.nearest(nodes, packing.PARAMETERS["neighbours"]).toPandas()
    path_of = {i: k for k, x in enumerate(want) for i in x}
    inner = {i for x in want for i in [j for j in x if j < 100][1:-1]}
    assert all(path_of[a] == path_of[b] or a in inner or b in inner for a, b in zip(near.a, near.b))


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    passage = prose(77, 60)
    rows = [row(i, prose(i, 150)) for i in range(40)] + [row(50 + i, prose(i, 150)) for i in range(6)]
    rows += [row(60 + i, " ".join(w + "!!" for w in prose(200 + i, 60).upper().split())) for i in range(20)]
    rows += [row(90 + i, f"{prose(300 + i, 50)} {passage} {prose(400 + i, 50)}") for i in range(4)] + [row(99, None), row(98, "")]
    rows += [row(110 + i, " ".join(w + "&&" for w in prose(700 + i, 20).split()) + " " + prose(800 + i, 80)) for i in range(25)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 40)] + [(60 + i, 0, 0) for i in range(20)] + [(110 + i, 0, 0) for i in range(25)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = common.load(spark, str(tmp_path), "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.dtypes == before.dtypes
        seen[name] = docs
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    assert ids("quality rules") == {r[0] for r in rows if r[0] < 60 or 90 <= r[0] < 98 or r[0] >= 110} - ({98, 99} | {i for i in range(110, 135) if i not in ids("quality rules")})
    assert set(range(40)) <= ids("quality classifier") <= ids("quality rules")
    kept = near_dedup.groups(seen["quality classifier"]).where("keep")
    assert ids("SimHash near-dedup") == {r.doc_id for r in kept.collect()} and not ids("SimHash near-dedup") & set(range(50, 56))
    texts = {r.doc_id: r.text for r in seen["substring dedup"].collect()}
    assert sum(passage in t for t in texts.values()) == 1 and texts[0] == prose(0, 150)
    assert substring_dedup.repeats(seen["substring dedup"]).where("is_copy").count() == 0
    packed = seen["packing"].toPandas()
    assert (packed.word_to - packed.word_from).groupby(packed.doc_id).sum().to_dict() == {i: len(t.split()) for i, t in texts.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    assert rng and quality_rules
