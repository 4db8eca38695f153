"""Caption operators against plain readings of the rules."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import timing as M
from tidemark.operators import frames, intervals, segments, signal, speakers, timeline, translations, vectors
from tidemark.schema import CUE, SEGMENT
from tidemark.sources import project


def seg(spark, rows, **more):  # noqa: ANN001, ANN201
    """(doc, start, end, text, speaker[, translation])"""
    full = [(d, i, s, e, t, p, 1.0, False, "", x[0] if x else "", 0, False, []) for i, (d, s, e, t, p, *x) in enumerate(rows)]
    return spark.createDataFrame(full, SEGMENT)


def plain(df, *columns):  # noqa: ANN001, ANN201
    return [tuple(r) for r in df.orderBy("doc_id", "seg_idx").select(*columns).collect()]


def test_words(spark):
    cues = spark.createDataFrame([(1, 0, 0, 1000, "ab cde f"), (2, 0, 500, 500, "Hi!"), (3, 0, 0, 1000, "a"), (3, 1, 800, 1200, "b"), (4, 0, 0, 10, " ")], CUE)
    words = segments.words_from_cues(cues)
    assert [tuple(r) for r in words.orderBy("doc_id", "word_idx").select("doc_id", "start_ms", "end_ms").collect()] == [(1, 0, 333), (1, 333, 777), (1, 777, 1000), (2, 500, 501), (3, 0, 1000), (3, 1000, 1200)]


def test_sentences_and_short_ones(spark):
    cues = spark.createDataFrame([(1, 0, 0, 60_000, "Das ist z.B. gut. Am 3. Januar kommt Dr. Meier. Wirklich? ja")], CUE)
    assert [r.text for r in segments.segments_from_cues(cues).orderBy("seg_idx").collect()] == ["Das ist z.B. gut.", "Am 3. Januar kommt Dr. Meier.", "Wirklich? ja"]
    kind = "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string, cue_idx int"
    rows = [(1, 0, 0, 1000, "a b c", 0), (1, 1, 1000, 1200, "d", 0), (1, 2, 1200, 1400, "e", 0), (2, 0, 0, 1000, "a b c", 0), (2, 1, 1000, 1100, "d", 0), (2, 2, 1100, 1200, "e", 0)]
    assert plain(segments.fold_short(spark.createDataFrame(rows, kind)), "doc_id", "start_ms", "end_ms", "text") == [(1, 0, 1000, "a b c"), (1, 1000, 1400, "d e"), (2, 0, 1200, "a b c d e")]


def test_merge_and_unmerge(spark):
    df = seg(spark, [(1, 0, 2000, "A.", 0), (1, 2500, 4000, "B.", 0), (1, 5000, 6000, "C.", 0), (1, 6000, 7000, "D.", -1), (1, 7000, 8000, "E.", -1)])
    merged = segments.merge_runs(df)
    assert plain(merged, "start_ms", "end_ms", "text") == [(0, 4000, "A. B."), (5000, 6000, "C."), (6000, 7000, "D."), (7000, 8000, "E.")]
    assert tuple(segments.merge_report(merged).first()) == (1, 1, 1, 5, 4)
    assert plain(segments.unmerge(merged), "start_ms", "end_ms", "text", "speaker_id") == plain(df, "start_ms", "end_ms", "text", "speaker_id")


G, E = "Bitte benutze diese Tür.", "Please use this door."


def test_pairs(spark):
    df = seg(spark, [(1, 0, 1000, G, 0), (1, 1000, 2000, E, 0), (2, 0, 1000, G, 0), (2, 1000, 2000, G + " und", 0), (2, 2000, 3000, E, 1), (2, 3000, 4000, E + " now", 0), (3, 0, 1000, G, 0), (3, 5001, 6000, E, 0), (4, 0, 1000, G, 0), (4, 1200, 2000, E, 0)])
    got = translations.pair(df)
    assert plain(got, "doc_id", "start_ms", "end_ms", "translation_echo", "outcome", "needs_review") == [
        (1, 0, 2000, False, "paired", False), (2, 0, 1000, False, "paired", True), (2, 1000, 2000, False, "paired", False), (2, 2000, 3000, True, "echo", True), (2, 3000, 4000, True, "echo", False),
        (3, 0, 1000, False, "unpaired", False), (3, 5001, 6000, False, "", False), (4, 0, 2000, False, "paired", False),
    ]
    back = plain(translations.unpair(got.drop("outcome")), "doc_id", "start_ms", "end_ms", "text")
    assert back == [(1, 0, 1000, G), (1, 1000, 2000, E), (2, 0, 1000, G), (2, 1000, 2000, G + " und"), (2, 2000, 3000, E), (2, 3000, 4000, E + " now"), (3, 0, 1000, G), (3, 5001, 6000, E), (4, 0, 1200, G), (4, 1200, 2000, E)]


def loop_pair(rows):  # noqa: ANN001, ANN201
    """The pairing of one document's (start, end, text, lang) rows as a loop."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][3] == "de":
            j += 1
        k = j
        while k < len(rows) and rows[k][3] == "en":
            k += 1
        if j == i:
            out.append([*rows[i][:3], "", False])
            i += 1
            continue
        gap = rows[j][0] - rows[j - 1][1] if k > j else -1
        if k == j or not 0 <= gap <= 4000:
            out += [[*r[:3], "", False] for r in rows[i:j]]
            i = j
            continue
        n = min(j - i, k - j)
        for a, b in zip(rows[i : i + n], rows[j : j + n]):
            out += [[*a[:3], b[2], False], [b[0], b[1], a[2], b[2], True]]
        out += [[*r[:3], "", False] for r in rows[i + n : j] + rows[j + n : k]]
        i = k
    out.sort(key=lambda r: r[0])
    done = []
    for r in out:
        if done and r[4] and not done[-1][4] and r[2:4] == done[-1][2:4] and r[0] <= done[-1][1] + 250:
            done[-1][1] = r[1]
        else:
            done.append(r)
    return [tuple(r) for r in done]


def test_pairing_equals_the_loop(spark):
    rng, docs, want = random.Random(6), [], []
    for d in range(150):
        t, rows = 0, []
        for _ in range(rng.randint(1, 9)):
            t += rng.choice([0, 0, 100, 250, 3000, 4001])
            lang = rng.choice(["de", "en", "en", "de", ""])
            rows.append((t, t + 1000, {"de": G, "en": E, "": "x"}[lang] + rng.choice(["", " ok"]), lang))
            t += 1000
        docs += [(d, s, e, x, 0) for s, e, x, _ in rows]
        want += [(d, *r) for r in loop_pair(rows)]
    assert plain(translations.pair(seg(spark, docs)), "doc_id", "start_ms", "end_ms", "text", "translation", "translation_echo") == want


def test_translation_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(lines):  # noqa: ANN001, ANN202
        calls.add(1)
        if "bad" in lines:
            raise ValueError
        return [x.upper() for x in lines]

    df = seg(spark, [(1, i, i + 1, t, 0, *x) for i, (t, *x) in enumerate([("a",), ("bad",), ("c",), ("d", "done"), (" ",)])])
    assert plain(translations.translate(df, call, batch=2), "translation") == [("A",), ("",), ("C",), ("done",), ("",)]
    replies = spark.createDataFrame([('["a ", "b"]',), ('{"translations":["a","b"]}',), ('```json\n{"translations":["a","b"]}\n```',), ('["a"]',), ("no",), ('```\n["a","b"]\n```',)], "r string")
    assert [r[0] for r in replies.select(translations.parse_reply(F.col("r"), F.lit(2))).collect()] == [["a", "b"]] * 3 + [None] * 3


def test_normalise_and_edges(spark):
    df = seg(spark, [(1, 0, 1500, "a", 0), (1, 3000, 2500, "c", 0), (1, 1000, 2000, "b", 0)])
    assert plain(timeline.normalise(df), "start_ms", "end_ms", "text") == [(0, 1000, "a"), (1000, 2000, "b"), (3000, 3000, "c")]
    paths = spark.createDataFrame([(1, ["x", "y", "z"])], "doc_id bigint, paths array<string>")
    assert [tuple(r)[3:] for r in timeline.drop_scenes(paths, 1000, 5000).orderBy("scene_idx").collect()] == [(1000, 4000), (4000, 5000)]
    scene = spark.createDataFrame([(1, 0, 1000, 2000)], "doc_id bigint, scene_idx int, start_ms bigint, end_ms bigint")
    yes = F.lit(True)
    assert tuple(timeline.move_edge(scene, "start", yes, 1900, 5000).first())[2:] == (1800, 2000)
    assert tuple(timeline.move_edge(scene, "end", yes, 9000, 5000).first())[2:] == (1000, 5000)
    assert tuple(timeline.move_edge(scene, "both", yes, 4700, 5000).first())[2:] == (4000, 5000)
    assert tuple(timeline.stretch(scene, yes, 5000).first())[2:] == (0, 5000)


def test_opacity(spark):
    df = spark.createDataFrame([(m,) for m in (930, 1000, 1070, 3000, 3070)], "ms bigint")
    none = F.lit(None).cast("bigint")
    alpha = M.segment_opacity(F.col("ms"), F.lit(1000), F.lit(3000), none, none, 140)
    assert [r[0] for r in df.select(alpha).collect()] == [0.0, 0.5, 1.0, 0.5, 0.0]
    assert [r[0] for r in df.select(M.segment_opacity(F.col("ms"), F.lit(1000), F.lit(3000), none, none, 0)).collect()] == [0.0, 1.0, 1.0, 0.0, 0.0]
    clock = frames.frame_clock(spark.createDataFrame([(1, 43_000)], "doc_id bigint, duration_ms bigint"), 30)
    assert clock.count() == 1290


def test_votes_and_nearest(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 0, 1), (2, 0, 0), (2, 0, 1)], "doc_id bigint, seg_idx int, label int")
    assert [(r.label, round(r.confidence, 4)) for r in speakers.majority(df, ["doc_id", "seg_idx"]).orderBy("doc_id").collect()] == [(1, 0.3333), (0, 0.0)]
    points = spark.createDataFrame([(1, 0), (1, 150), (1, 151), (1, 999), (2, 5)], "doc_id bigint, ms bigint")
    windows = spark.createDataFrame([(1, 100, 7), (1, 200, 8)], "doc_id bigint, center_ms bigint, label int")
    assert {(r.doc_id, r.ms): r.label for r in intervals.nearest_label(points, windows).collect()} == {(1, 0): 7, (1, 150): 7, (1, 151): 8, (1, 999): 8, (2, 5): None}


def test_long_intervals_cross_buckets(spark):
    rng = random.Random(1)
    rows = [(1, i, s := rng.randrange(10**6), s + rng.randrange(1, 200_000)) for i in range(60)]
    pts = [(1, rng.randrange(1_200_000)) for _ in range(200)]
    got = intervals.covering(spark.createDataFrame(sorted(set(pts)), "doc_id bigint, ms bigint"), spark.createDataFrame(rows, "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint"))
    assert sorted((r.ms, r.seg_idx) for r in got.collect()) == sorted((m, i) for _, m in set(pts) for _, i, s, e in rows if s <= m < e)


def test_peaks(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, -0.2), (1, 2, 0.3)], "doc_id bigint, i bigint, v double")
    assert [tuple(r)[2:] for r in signal.peaks(df, 2).orderBy("bucket").collect()] == [(0.1, 0.1), (-0.2, 0.3)]
    assert [tuple(r)[2:] for r in signal.peaks(df, 5).orderBy("bucket").collect()] == [(0.1, 0.1), (0.1, 0.1), (-0.2, -0.2), (-0.2, -0.2), (0.3, 0.3)]
    mel = signal.log_mel(np.sin(np.arange(16_000) * 2 * np.pi * 440 / 16_000))
    assert mel.shape == (98, 80) and np.allclose(mel.mean(axis=0), 0, atol=1e-3)


@given(st.integers(0, 9), st.integers(0, 4), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_clusters_equal_the_plain_rule(n, target, seed):
    v = np.random.default_rng(seed).standard_normal((n, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True) if n else 1
    d, groups = 1 - v @ v.T, [[i] for i in range(n)]
    while len(groups) > 1 and not (target and len(groups) <= target):
        best, i, j = min((np.mean([[d[a, b] for b in y] for a in x]).round(12), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if not target and len(groups) <= 4 and best > 0.45:
            break
        groups[i] += groups.pop(j)
    want = {frozenset(g) for g in groups}
    got = vectors.agglomerate(v, target, 4, 0.45)
    assert {frozenset(np.flatnonzero(got == c).tolist()) for c in set(got.tolist())} == want


def test_clustering_numbers_by_first_member(spark):
    rows = [(1, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "part int, vec_id bigint, embedding array<float>")
    assert [r.cluster for r in vectors.clusters(df, "part").orderBy("vec_id").collect()] == [0, 1, 0, 1, 0, 1]


def test_lenient_documents(spark):
    text = '{"version":1,"segments":[{"startMs":1000.0,"endMs":2000.0,"text":"b"},{"startMs":0,"endMs":1500,"text":"a","speakerId":1,"mergedFrom":[{"startMs":0,"text":"x"}]}]}'
    got = project.from_json(spark.createDataFrame([(1, text), (2, "{}"), (3, "broken")], "doc_id bigint, project string"))
    assert plain(got, "doc_id", "start_ms", "end_ms", "text", "speaker_id", "needs_review") == [(1, 0, 1000, "a", 1, False), (1, 1000, 2000, "b", -1, False)]
    assert [len(r[0]) for r in plain(got, "merged_from")] == [1, 0]


def test_boxes(spark):
    box = F.struct(F.lit(0.9).alias("x"), F.lit(-0.5).alias("y"), F.lit(0.2).alias("w"), F.lit(0.3).alias("h"))
    got = spark.range(1).select(timeline.clamp_box(box).alias("c"), timeline.resize_box(box, right=-0.5).alias("r"), M.pixel_rect(box, 100, 100).alias("p"), M.even(F.lit(7)).alias("e")).first()
    assert (round(got.c.x, 6), round(got.c.y, 6)) == (0.9, -0.25) and round(got.r.w, 6) == 0.02 and got.p.w == 20 and got.e == 6


def test_stream_of_words_gives_the_batch_sentences(spark, tmp_path):
    from tidemark.streaming import live

    cues = spark.createDataFrame([(d, 0, 0, 60_000, "Das ist z.B. gut. Am 3. Januar kommt Dr. Meier. Wirklich? ja. Ende da. x") for d in range(3)], CUE)
    words = segments.words_from_cues(cues).select("doc_id", "word_idx", "start_ms", "end_ms", "text")
    for k, part in enumerate(("word_idx < 5", "word_idx between 5 and 9", "word_idx > 9")):
        words.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(words.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.sentences(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.doc_id, r.seg_idx, r.start_ms, r.end_ms, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = segments.sentences_from_words(segments.words_from_cues(cues)).select("doc_id", "seg_idx", "start_ms", "end_ms", "text")
    assert got == sorted(tuple(r) for r in batch.collect() if r.seg_idx < 3) and len(got) == 9  # the last one isn't finished
