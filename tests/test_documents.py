"""Project documents, files that aren't there, edits, reports and the speaker driver."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, overlays, running, segments, signal, speakers, timeline, translations, vectors
from tidemark.operators.lineage import cut
from tidemark.sources import project, subtitles

SEG = "doc_id bigint, seg_idx int, start_ms bigint, end_ms bigint, text string"


def seg(spark, rows):  # noqa: ANN001, ANN201
    return segments.with_defaults(spark.createDataFrame(rows, SEG))


def test_documents_that_are_not_there_or_broken(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"speakers":[{"name":"Ann","tint":"teal","style":{"box":{"x":0.5},"fontWeight":600.5,"boxColor":7}}],"scenes":[{"startMs":900,"fit":"contain"},{"startMs":"x","endMs":5}],"fps":25,"canvasWidth":"wide","export":{"crf":20},"highlights":[{"word":"w"}],"translationStyle":{}}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[1]")
    docs = project.load(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json", f"{tmp_path}/c.json", f"{tmp_path}/none.json"])
    name = {r.doc_id: r.path[-6] for r in docs.collect()}
    t = {k: cut(v) for k, v in project.decode(docs).items()}
    assert {name[r.doc_id]: r.error[:12] for r in t["errors"].collect()} == {"b": "not a projec", "c": "not a projec", "e": "cannot open "}
    a = next(r for r in t["settings"].collect() if name[r.doc_id] == "a")
    assert (a.fps, a.canvas_width, a.export.crf, a.export.preset, a.translation_style.font_size, a.transition_ms) == (25, 1920, 20, "medium", 0.062, 140)
    assert {r.translation_style.font_size for r in t["settings"].collect() if name[r.doc_id] != "a"} == {0.042}
    who = {(name[r.doc_id], r.speaker_id): r for r in t["speakers"].collect()}
    assert len(who) == 7 and (who["a", 0].name, who["a", 0].tint) == ("Ann", "#ff008080")
    style = who["a", 0].style
    assert (style.box.x, style.box.w, style.font_weight, style.box_color) == (0.5, 0.84, 500, "#ffcbe86b")
    assert [(r.scene_idx, r.start_ms, r.end_ms, r.fit) for r in t["scenes"].orderBy("scene_idx").collect()] == [(0, 0, 5, "cover"), (1, 900, 0, "contain")]
    assert [(r.word, r.color, r.bold) for r in t["highlights"].collect()] == [("w", "#ff1e6fe8", False)]


def test_documents_round_trip_through_files(spark, tmp_path):
    docs = spark.createDataFrame([(7,)], "doc_id bigint")
    merged = seg(spark, [(7, 0, 0, 900, "a b")]).withColumn("merged_from", F.array(F.struct(F.lit(0).cast("bigint").alias("start_ms"), F.lit(400).cast("bigint").alias("end_ms"), F.lit("a").alias("text"), F.lit("x").alias("translation"), F.lit(3).cast("bigint").alias("translation_start_ms"), F.lit(True).alias("translation_echo"))))
    own = {"settings": project.default_settings(docs).withColumn("background_color", F.lit("#80ffffff")), "speakers": overlays.add_speaker(overlays.default_speakers(docs)), "segments": merged}
    project.save(project.encode(own), f"{tmp_path}/out")
    (text,) = spark.read.text(f"{tmp_path}/out").collect()
    back = project.decode(spark.createDataFrame([(7, text.value)], "doc_id bigint, project string"))
    for name in own:
        assert sorted(map(str, back[name].select(*own[name].columns).collect())) == sorted(map(str, own[name].collect()))
    assert back["errors"].count() == 0 and back["overlays"].count() == 0


def test_subtitles_that_are_not_there(spark, tmp_path):
    (tmp_path / "x.srt").write_text("1\n0.5 --> 1.5\nHallo\n")
    (tmp_path / "y.srt").write_text("nothing")
    files = subtitles.read(spark, [f"{tmp_path}/x.srt", f"{tmp_path}/y.srt", f"{tmp_path}/z.srt"])
    got = {r.path[-5:]: (r.n_cues, r.error) for r in subtitles.results(files).collect()}
    assert got == {"x.srt": (1, ""), "y.srt": (0, "no cues found"), "z.srt": (0, f"cannot open {tmp_path}/z.srt")}
    assert {r.path[-5:]: r.error for r in subtitles.problems(files, subtitles.parse(files)).collect()} == {k: e for k, (_, e) in got.items() if e}
    assert subtitles.read(spark, f"{tmp_path}/z.srt").count() == 1


def test_running_sums_over_blocks(spark):
    rows = [(k, i * 3 - 40, i % 5) for k in "ab" for i in range(40)]
    got = {(r.k, r.i): r.before for r in running.before(spark.createDataFrame(rows, "k string, i int, v int"), "i", F.col("v"), ["k"], block=16).collect()}
    assert got == {(k, i): sum(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}


def test_removals(spark):
    scenes = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "doc_id bigint, scene_idx int, p string")
    assert sorted((r.doc_id, r.scene_idx, r.p) for r in timeline.without_rows(scenes, F.col("p") == "b").collect()) == [(1, 0, "a"), (1, 1, "c"), (2, 0, "d")]
    parts = spark.createDataFrame([(i, x) for i, x in enumerate("abcd")], "part_idx int, path string")
    assert sorted(tuple(r) for r in overlays.without_parts(parts, F.col("part_idx").isin(0, 2)).collect()) == [(0, "b"), (1, "d")]


def test_many_points_of_one_document_take_linear_time(spark):
    points = spark.range(100_000).select(F.lit(1).cast("bigint").alias("doc_id"), (F.col("id") * 7).alias("ms"))
    windows = spark.range(2800).select(F.lit(1).cast("bigint").alias("doc_id"), (F.col("id") * 250).alias("center_ms"), (F.col("id") % 3).cast("int").alias("label"))
    got = intervals.nearest_label(points, windows).agg(F.count("label").alias("n"), F.sum(F.col("label") * F.col("ms")).alias("s")).first()
    want = [min(range(max(0, ms // 250 - 1), min(2800, ms // 250 + 2)), key=lambda w: (abs(w * 250 - ms), w)) % 3 * ms for ms in range(0, 700_000, 7)]
    assert (got.n, got.s) == (100_000, sum(want))


def test_replies_and_reports(spark):
    assert translations.reply_lines('x {"translations": [" a", 3]} y', 2) == ["a", ""]
    for bad in ("no", '["a"]', "[]", '{"translations": {}}', "{x}"):
        with pytest.raises(ValueError):
            translations.reply_lines(bad, 2)
    rows = segments.with_defaults(spark.createDataFrame([(1, 0, 0, 1, "a", ""), (1, 1, 1, 2, "b", "done"), (1, 2, 2, 3, "", ""), (1, 3, 3, 4, " ", "x"), (2, 0, 0, 1, "bad", ""), (3, 0, 0, 1, "q", "done")], SEG + ", translation string"))
    out = cut(translations.translated(rows, translations.batch_call(lambda r: r.replace("bad", ""), lambda lines: str(lines).replace("'", '"'))))
    assert {(r.doc_id, r.seg_idx): (r.outcome, r.translation) for r in out.collect()} == {(1, 0): ("translated", "a"), (1, 1): ("skipped", "done"), (1, 2): ("", ""), (1, 3): ("", "x"), (2, 0): ("failed", ""), (3, 0): ("skipped", "done")}
    got = {r.doc_id: tuple(r)[1:5] + (r.warning != "", r.error != "") for r in translations.translation_report(out).collect()}
    assert got == {1: (1, 1, 1, 0, False, False), 2: (1, 0, 0, 1, False, True), 3: (0, 0, 1, 0, True, False)}


def test_too_many_vectors_are_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(5)], "part int, vec_id bigint, embedding array<float>")
    monkeypatch.setattr(vectors, "MOST", 4)
    with pytest.raises(Exception, match="more than the 4"):
        vectors.clusters(rows, "part").collect()


def test_log_mel_is_that_of_a_plain_transform():
    rng = np.random.default_rng(3)
    x = rng.standard_normal(720) * 0.1
    frames = []
    for at in range(0, len(x) - 399, 160):
        f = x[at : at + 400] * 32768
        f = f - sum(f) / 400
        f = [f[0] * 0.03] + [f[i] - 0.97 * f[i - 1] for i in range(1, 400)]
        f = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / 399)) ** 0.85 for i, v in enumerate(f)]
        power = [abs(sum(v * np.exp(-2j * math.pi * k * i / 512) for i, v in enumerate(f))) ** 2 for k in range(257)]
        mel = lambda hz: 1127 * math.log(1 + hz / 700)
        low, high, row = mel(20), mel(8000), []
        for b in range(80):
            left, mid, right = (low + (high - low) * (b + d) / 81 for d in range(3))
            total = 0.0
            for k in range(257):
                m = mel(k * 16_000 / 512)
                if left < m < right:
                    total += power[k] * ((m - left) / (mid - left) if m <= mid else (right - m) / (right - mid))
            row.append(math.log(max(total, np.finfo(np.float32).eps)))
        frames.append(row)
    want = np.array(frames) - np.mean(frames, axis=0)
    got = signal.log_mel(x)
    assert got.shape == want.shape == (3, 80) and np.abs(got - want).max() < 1e-2


def voices():  # noqa: ANN201
    return lambda f: np.abs(np.fft.rfft(f.mean(axis=1)))[1:30]  # how fast loudness goes up and down


def broken():  # noqa: ANN201
    raise OSError("no such device")


def test_speakers_by_voice_or_by_language(spark):
    rate, i = 16_000, np.arange(16 * 16_000)
    part = i // (4 * rate)
    second = (part == 1) | ((part == 3) & (i >= 14 * rate))
    v = np.sin(2 * np.pi * 440 * i / rate) * (0.55 + 0.45 * np.sin(2 * np.pi * np.where(second, 8, 3) * i / rate))
    samples = spark.createDataFrame([(1, int(k), float(x)) for k, x in zip(i, v)], "doc_id bigint, i bigint, v double").repartition(4)
    en, de = "please use the door and this is good", "bitte und die das ist gut für mich"
    rows = seg(spark, [(1, 0, 0, 4000, en), (1, 1, 4000, 8000, de), (1, 2, 8000, 12_000, en), (1, 3, 12_000, 16_000, "a b c d x y z w"), (2, 0, 0, 1000, de), (2, 1, 1000, 2000, en)])
    words = spark.createDataFrame([(1, k, 12_000 + 500 * k, 12_500 + 500 * k, w) for k, w in enumerate("a b c d x y z w".split())], "doc_id bigint, word_idx int, start_ms bigint, end_ms bigint, text string")
    out, report = speakers.diarize(rows, words, samples, [("broken", broken), ("voices", voices)], target=2)
    got = {(r.doc_id, r.seg_idx): (r.start_ms, r.end_ms, r.text, r.speaker_id) for r in out.collect()}
    assert {k: x[3] for k, x in got.items() if k[1] < 3} == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (2, 0): 0, (2, 1): 1}
    (a, b, head, first), (c, d, tail, then) = got[1, 3], got[1, 4]  # cut at a word, half a second at most from the change
    assert (a, d, first, then, f"{head} {tail}") == (12_000, 16_000, 1, 0, "a b c d x y z w") and b == c and abs(b - 14_000) <= 500
    one, two = sorted(report.collect())
    assert (one.backend, one.warning, one.speakers, one.splits) == ("voices", "", 2, 1) and one.windows > 40
    assert (two.backend, two.windows, two.speakers, two.splits) == ("text only", 0, 2, 0) and "speech" in two.warning
    plain, report = speakers.diarize(rows, words, samples, [("broken", broken)])
    assert {r.backend for r in report.collect()} == {"text only"} and plain.count() == 6
    assert {r.warning for r in speakers.diarize(rows, words)[1].collect()} == {"there is no model of voices"}
