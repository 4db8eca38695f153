"""SimHash near-dedup and substring dedup against brute force."""

import random

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, awkward, clashing, prose, row
from tidemark.llm import near_dedup, substring_dedup


def edited(text: str, seed: int, share: float) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1)
    return " ".join(words)


def test_pairs_are_exactly_those_within_the_radii(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    hi, lo = [], []
    for b in base:  # clusters, some bits always equal: correlated and skewed
        for _ in range(25):
            flip = np.uint64(0)
            for k in rng.integers(0, 64, rng.integers(0, 9)):
                flip ^= np.uint64(1) << np.uint64(k)
            hi.append((b | np.uint64(0xFFF)) ^ flip)
            lo.append(b ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))))
    hi, lo = np.array(hi), np.array(lo)
    sigs = spark.createDataFrame([(i, int(a.astype(np.int64)), int(b.astype(np.int64))) for i, (a, b) in enumerate(zip(hi, lo))], "id long, hi long, lo long").dropDuplicates(["hi", "lo"])
    ids = {r.id for r in sigs.select("id").collect()}
    for radius, full in ((0, 2), (3, 6), (8, 24)):
        x = np.bitwise_count(hi[:, None] ^ hi[None]).astype(int)
        y = x + np.bitwise_count(lo[:, None] ^ lo[None])
        want = {(i, j) for i, j in zip(*np.nonzero((x <= radius) & (y <= full))) if i < j and i in ids and j in ids}
        assert {tuple(r) for r in near_dedup.near_pairs(sigs, radius, full).collect()} == want


@given(st.integers(0, 10), st.lists(st.integers(1, 40), min_size=4, max_size=4))
@settings(max_examples=30, deadline=None)
def test_thresholds_hold_the_general_pigeonhole(radius, weights):
    distances = [near_dedup.pairs_by_distance(np.bincount(np.arange(w * 10) % 256, minlength=256)) for w in weights]
    ts = near_dedup.allocate(distances, 100, radius)
    assert sum(t + 1 for t in ts) == radius + 1 and all(t >= -1 for t in ts)


def test_pairs_by_distance_counts_all_pairs():
    v = np.random.default_rng(1).integers(0, 64, 200)
    d = np.bitwise_count(v[:, None] ^ v[None])
    assert np.allclose(near_dedup.pairs_by_distance(np.bincount(v, minlength=64)), np.bincount(d.ravel(), minlength=7))
    assert [near_dedup.meetings(6, d, 1, 1) for d in range(4)] == [7, 2, 2, 0]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    up = list(range(500))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.v: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}


def test_copies_are_found_and_clean_documents_stay(spark):
    base = [prose(i, 150) for i in range(20)]
    rows = [row(i, t) for i, t in enumerate(base)] + [row(100 + i, t) for i, t in enumerate(base[:5])] + [row(200 + i, edited(t, i, 0.04)) for i, t in enumerate(base[5:15])]
    docs = spark.createDataFrame(rows + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward()], DOCS)
    got = {r.doc_id: (r.group_id, r.keep) for r in near_dedup.groups(clashing(docs)).collect()}
    assert len(got) == 35 + 10
    assert all(got[100 + i] == (i, False) for i in range(5))
    assert sum(got[200 + i] == (5 + i, False) for i in range(10)) >= 9
    assert all(got[i][1] for i in range(20)) and got[1006] == (1001, False)
    assert all(got[i] == (i, True) for i in (1002, 1003, 1004))
    kept = near_dedup.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, (_, k) in got.items() if k)
    assert kept.where("doc_id is null").count() == 2
    assert near_dedup.groups(docs.where("false")).count() == 0 and near_dedup.keep_one(docs.where("false")).count() == 0


def documents():
    passage, other = prose(70, 60), prose(71, 55)
    rows = [row(i, prose(300 + i, 200)) for i in range(6)]
    rows += [row(10 + i, f"{prose(400 + i, 40)} {passage} {prose(500 + i, 30 + i)}") for i in range(5)]
    rows += [row(20, f"{prose(600, 10)} {other}\n{prose(601, 90)}\n{other}"), row(21, other), row(22, f"{other} {passage}"), row(23, prose(72, 49)), row(24, prose(72, 49)), row(25, prose(73, 50)), row(26, prose(73, 50))]
    rows += [row(30, prose(80, 300)), row(31, edited(prose(80, 300), 1, 0.01)), row(32, prose(80, 300)), row(33, prose(80, 300)), row(33, prose(80, 300)), row(34, "same " * 200), row(35, "same " * 120)]
    return rows


def test_repeats_are_those_of_brute_force(spark):
    docs = spark.createDataFrame(documents() + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward() if r[1] is None or len(r[1]) < 10**5], DOCS)
    got = substring_dedup.repeats(clashing(docs))
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({substring_dedup.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 15
    assert substring_dedup.repeats(docs.where("false")).count() == 0


def test_a_repeat_goes_on_where_its_smallest_document_ends(spark):
    passage = prose(90, 100).split()
    docs = spark.createDataFrame([row(1, " ".join(passage[:50]) + " " + prose(91, 30)), row(2, prose(92, 30) + " " + " ".join(passage)), row(3, " ".join(passage) + " " + prose(93, 7))], DOCS)
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in substring_dedup.repeats(docs).collect()}
    assert got == {(1, 0, 50, 1), (2, 30, 130, 2), (3, 0, 100, 2)}


def test_families_of_edited_copies_match_brute_force(spark):
    rows, rng = [], random.Random(8)
    for family in range(3):
        base = prose(800 + family, 260)
        rows += [row(100 * family + i, edited(base, 10 * family + i, rng.choice([0, 0.004, 0.01, 0.03]))) for i in range(14)]
    rows += [row(900, "a b c d e f g " * 60), row(901, "x " + "a b c d e f g " * 30 + "y"), row(902, "b c d e f g a " * 9)]
    docs = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = substring_dedup.repeats(docs)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({substring_dedup.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 50


@given(st.lists(st.tuples(st.lists(st.integers(0, 1), max_size=5), st.integers(1, 3), st.booleans()), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_longest_shared_beginnings_are_those_of_brute_force(rows):
    rows = sorted(rows)
    want = []
    for x, *_ in rows:
        for n in range(len(x), -1, -1):
            here = [(o, o + m) for y, o, m in rows if y[:n] == x[:n] and len(y) >= n]
            if n == 0 or min(o for o, _ in here) < max(o for _, o in here):
                want.append((n, min(o for o, _ in here)))
                break
    assert substring_dedup.longest_shared([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]) == want


@given(st.lists(st.lists(st.integers(0, 2), max_size=7), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_beginnings_are_those_of_a_loop(lists):
    lists.sort()
    want = [0] + [next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y))) for x, y in zip(lists, lists[1:])]
    flat = np.array([v for x in lists for v in x], np.int64)
    assert substring_dedup.common_beginnings(flat, np.array(list(map(len, lists)), np.int64)).tolist() == want[: len(lists)]


def test_remove_leaves_each_passage_once(spark):
    docs = spark.createDataFrame(documents() + [row(None, prose(70, 60)), row(40, None)], DOCS)
    left = {r.doc_id: r for r in substring_dedup.remove(clashing(docs)).collect()}
    assert [i for i in range(10, 15) if prose(70, 60) in left[i].text] == [10]
    assert 22 not in left
    assert 21 not in left and 26 not in left and 32 not in left and 33 not in left and {23, 24, 25, 30, 40, None} <= set(left)
    assert left[0].text == prose(300, 200) and left[11].n_chars == len(left[11].text)
    again = spark.createDataFrame([(r.doc_id, r.text, "en", "s", 0) for r in left.values() if r.doc_id is not None], DOCS)
    assert substring_dedup.repeats(again).where("is_copy").count() == 0


@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_every_frame_has_an_anchor_and_equal_frames_equal_ones(values, seed):
    length = 8
    cache = substring_dedup.word_cache()
    h, bounds = substring_dedup.hashed([" ".join(f"w{v}" for v in values)], cache)
    _, pos, g = substring_dedup.anchors(h, bounds, length, seed)
    where, seen = dict(zip(pos.tolist(), g.tolist())), {}
    for s in range(len(values) - length + 1):
        inside = tuple((p - s, where[p]) for p in range(s, s + length - seed + 1) if p in where)
        assert inside
        least = min(x for _, x in inside)
        assert seen.setdefault(tuple(values[s : s + length]), least) == least
