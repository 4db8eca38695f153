"""Text rules on hand-traced cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.sources import audio, subtitles


def values(spark, rows, kind, **columns):  # noqa: ANN001, ANN201
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], f"i int, {kind}")
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("i").select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_normal_words(spark):
    assert values(spark, ["wohl?", "(Wohl),", "--", "Über-all!", "3."], "t string", w=T.normal_word(F.col("t"))) == ["wohl", "wohl", "", "über-all", "3"]
    assert [tuple(r) for r in values(spark, ["(Wohl),", "--", "a", "»x.y«"], "t string", p=T.token_parts(F.col("t")))] == [("(", "Wohl", "),"), ("--", "", ""), ("", "a", ""), ("»", "x.y", "«")]


def test_language_scores(spark):
    texts = ["Bitte benutze diese Tür.", "Please use this door.", "was", "learning", "", "Die Zeitung", "x"]
    assert values(spark, texts, "t string", s=T.language_score(F.col("t")))[:5] == [1.0, -1.0, 0.0, 0.0, 0.0]
    assert len(T.GERMAN) == 69 and len(T.ENGLISH) == 57 and set(T.GERMAN) & set(T.ENGLISH) == {"was"} and len(T.ABBREVIATIONS) == 32


@pytest.mark.parametrize(("ms", "text"), [(3_723_004, "01:02:03,004"), (-5, "00:00:00,000"), (360_000_000, "100:00:00,000")])
def test_stamps_are_printed(spark, ms, text):
    assert values(spark, [ms], "m bigint", s=T.format_stamp(F.col("m"))) == [text]


def test_stamps_are_read(spark):
    texts = ["00:00:01,000", "1:02.5", "5.0", "00:00:09", "1:1:1.1239", "x 2.25 y", ""]
    assert values(spark, texts, "t string", m=T.stamp_ms(F.col("t"))) == [1000, 62_500, 5000, None, 3_661_123, 2250, None]
    assert values(spark, [" 12 ", "-7", "1.5", "no"], "t string", m=T.edited_stamp(F.col("t"))) == [12, -7, 1500, None]
    assert values(spark, [61_250, -3], "m bigint", c=T.clock(F.col("m"))) == ["01:01.2", "00:00.0"]


def test_sentence_ends(spark):
    pairs = [("gut.", "Am"), ("z.B.", "gut"), ("3.", "Januar"), ("Dr.", "Meier"), ("Meier.", "Wirklich"), ("Wirklich?", "ja"), ("Ende!”", "Und"), ("A.", "B"), ("so…", None), ("so.", "«ja"), ("no.", "X"), (".", None), ("so.", "”")]
    got = values(spark, pairs, "t string, n string", e=T.ends_sentence(F.col("t"), F.col("n")))
    assert got == [True, False, False, False, True, False, True, False, True, True, False, False, True]


def test_small_functions(spark):
    assert values(spark, ["#AABBCC", "#11223344", "Red", "#1aF", "no", None], "t string", c=T.color(F.col("t"), "#ff000000")) == ["#ffaabbcc", "#11223344", "#ffff0000", "#ff11aaff", "#ff000000", "#ff000000"]
    assert values(spark, ["DE-at", "xx", "en"], "t string", c=T.language_name(F.col("t"))) == ["German", "xx", "English"]
    got = values(spark, ["wohl=#00ff00:bold", "a=red", "bad", "=x", "a=blue:BOLD", "a=nocolor", "a=", "a=red:thin"], "t string", c=T.highlight_spec(F.col("t")))
    assert [tuple(g) if g else None for g in got] == [("wohl", "#00ff00", True), ("a", "red", False), None, None, ("a", "blue", True), None, None, None]
    assert values(spark, [0, 1, 3, 400, 512], "n int", p=T.next_power_of_two(F.col("n"))) == [1, 1, 4, 512, 512]
    assert values(spark, ["A.TMPROJ", "a.mp4", "a.xproj"], "t string", p=T.is_project(F.col("t"))) == [True, False, False]
    assert values(spark, ["A.TMPROJ", "a.xProj"], "t string", p=T.is_project(F.col("t"), "Xproj")) == [False, True]


def test_language_score_is_that_of_word_by_word(spark):
    import random
    import re

    rng = random.Random(2)
    parts = [*T.GERMAN, *T.ENGLISH, "zeitung", "learning", "nation", "freiheit", "tür", "größe", "x", "was", "ich2", "der's", "ungx", "Ölung", "İst"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "-", ", ", "3", "_", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "ist", "İst IN"]
    lows = values(spark, texts, "t string", t=F.lower(F.col("t")))
    want = []
    for low in lows:
        words = [w for w in re.split(r"[\W\d_]+", low) if w]
        de = sum((w in T.GERMAN) + 0.5 * bool(re.search("(ung|keit|heit|chen)$", w)) + 2 * bool(re.search("[äöüß]", w)) for w in words)
        en = sum((w in T.ENGLISH) + 0.5 * bool(re.search("(ing|tion)$", w)) for w in words)
        want.append((de - en) / (de + en) if de + en >= 1 else 0.0)
    assert values(spark, texts, "t string", s=T.language_score(F.col("t"))) == want


def test_subtitles(spark):
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Guten</i> Tag,\r\n\r\n2\n1:02.5 --> 1:04.25\n{\\an8}wie geht\nes Ihnen?\n \t\n5.0 --> 4.0\nHi!\n\n00:00:09 --> 00:00:10\nno fraction\n\nno arrow\n\n6.0 --> 7.0\n<b></b>\n\n8.0 --> 9.0\nx\n9.0 --> 9.5\ny"
    files = spark.createDataFrame([("a", text), ("b", "nothing"), ("c", "")], "path string, content string")
    cues = subtitles.parse(files)
    assert [tuple(r)[1:] for r in cues.where("path = 'a'").orderBy("cue_idx").collect()] == [(0, 1000, 2500, "Guten Tag,"), (1, 62_500, 64_250, "wie geht es Ihnen?"), (2, 5000, 5000, "Hi!"), (3, 8000, 9000, "x 9.0 --> 9.5 y")]
    assert {r.path for r in subtitles.problems(files, cues).collect()} == {"b", "c"}


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "x.srt").write_text("1\n0.5 --> 1.5\nHallo\n")
    assert subtitles.parse(subtitles.read(spark, str(tmp_path))).select("start_ms", "text").collect() == [(500, "Hallo")]


def test_wav(spark, tmp_path):
    import wave

    import numpy as np

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.repeat(np.array([0, 16384, -16384, 0], np.int16), 2).tobytes())
    rows = audio.read(spark, f"{tmp_path}/*.wav", chunk=5).orderBy("chunk_idx").collect()
    assert [len(r.samples) for r in rows] == [5, 3] and abs(rows[0].samples[2] - 0.5) < 1e-6
    with wave.open(str(tmp_path / "b.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(16_000)
        w.writeframes(b"".join(x.to_bytes(3, "little", signed=True) for x in (0, 1 << 22, -(1 << 22), -(1 << 23))))
    assert audio.decode_wav((tmp_path / "b.wav").read_bytes()).tolist() == [0.0, 0.5, -0.5, -1.0]
    assert spark.range(1).select(audio.duration_ms(F.lit(8), F.lit(16_000)).alias("d")).first().d == 0
