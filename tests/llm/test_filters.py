"""Quality rules, quality classifier, license scan, URL filter."""

import random
import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, clashing, prose, row
from tidemark.llm import classifier, license_phrases, license_rules, license_scan, quality_rules, url_filter


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_rules_match_sql_and_keep_whole_rows(spark):
    junk = [row(100 + i, "LOUD!! WORDS!! HERE!! " * 20, "bad") for i in range(30)]
    docs = spark.createDataFrame(awkward() + junk + [row(200, prose(3, 50), "bad"), row(201, "a a a a a a a a", "src1")], DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    judged = quality_rules.judge(clashing(docs))
    names = judged.columns
    want = con.sql(f"SELECT {', '.join(names)} FROM ({quality_rules.ORACLE})").fetchall()
    assert rows_of(judged) == sorted(want, key=repr)
    by_id = {r.doc_id: r for r in judged.collect() if r.doc_id is not None}
    assert by_id[2].rules_failed == by_id[3].rules_failed == by_id[4].rules_failed == "blank"
    assert by_id[200].host_rejected and not by_id[200].keep and by_id[200].rules_failed == ""
    assert by_id[201].rules_failed == "repeats" and by_id[1].keep
    kept = quality_rules.keep_good(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").where("doc_id is not null").collect()) == sorted(r.doc_id for r in judged.where("keep and doc_id is not null").collect())
    empty = docs.where("false")
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_repeated_lines_and_rates_on_the_limit(spark):
    lines = [prose(900 + i, 6) for i in range(10)]
    rows = [row(1, "\n".join(lines)), row(2, "\n".join(lines[:5] * 2)), row(3, "\n".join(lines + lines[:3])), row(4, "\n \n\n \n\n" + lines[0]), row(5, "\n".join(lines[:1] * 6))]
    df = spark.createDataFrame(rows, DOCS)
    failed = {r.doc_id: r.rules_failed for r in quality_rules.judge(df).collect()}
    assert failed == {1: "", 2: "repeated_lines", 3: "", 4: "", 5: "repeated_lines"}
    names = [f"c{i}" for i in range(8)] + ["__host", "__source", "__n_words", "rules_failed", "n_chars2"]
    marked = df
    for n in names:
        marked = marked.withColumn(n, F.lit("mine"))
    kept = quality_rules.keep_good(marked)
    assert kept.columns == marked.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4} and all(r[n] == "mine" for r in kept.collect() for n in names)
    half = spark.createDataFrame([("h", "" if i % 2 else "blank") for i in range(4)], "host string, rules_failed string")  # a rate of exactly the limit
    (host,) = quality_rules.host_verdicts(half).collect()
    assert host.host_rate == 0.5 and not host.host_rejected


def test_host_rates_shrink_to_the_prior(spark):
    rows = [row(i, prose(i, 20), f"h{i % 3}") for i in range(60)] + [row(90, "", "tiny")]
    rate = {r.host: r.host_rate for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert 0 < rate["tiny"] < 1 and rate["h0"] < rate["tiny"]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(5)
    good = [prose(1000 + i, rng.randint(20, 90)) for i in range(260)]
    bad = [" ".join(w + rng.choice(["***", "$$$", "!!"]) for w in prose(5000 + i, rng.randint(20, 90)).split()) for i in range(260)]
    return good, bad


def test_classifier_held_out_accuracy(labelled):
    good, bad = labelled
    model = classifier.train(bad[:160] + good[:160], [0] * 160 + [1] * 160)
    q = classifier.Scorer(model)(good[160:] + bad[160:])[:, 1]
    assert ((q >= 0.5) == np.array([True] * 100 + [False] * 100)).mean() > 0.97


def plain_features(text: str, p: dict) -> dict[int, float]:
    """Share of each feature of a text, word by word and character by character."""
    m, mix, base = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0x100000001B3

    def mixed(h: int) -> int:
        h = (h ^ (h >> 31)) * mix & m
        return (h ^ (h >> 29)) * base & m

    found = Counter()
    for word in text.split():
        c = [ord(x) + 1 for x in f"<{word}>"]
        found[mixed(sum(mixed((x + k * mix) & m) for k, x in enumerate(c)) & m) % p["buckets"]] += 1
        for n in p["ngrams"]:
            for k in range(len(c) - n + 1):
                h = 0
                for x in c[k : k + n]:
                    h = (h * base + x) & m
                found[mixed((h + n) & m) % p["buckets"]] += 1
    return {k: n / found.total() for k, n in found.items()}


def plain_sgd(texts: list[str], classes: list[int], p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same descent in plain loops: vectors, layer, bias."""
    rng = np.random.default_rng(p["seed"])
    E = (rng.random((p["buckets"], p["dims"])) - 0.5) / p["dims"]
    W, counts = np.zeros((p["dims"], 2)), [1 + classes.count(c) for c in (0, 1)]
    bias = np.log(np.array(counts) / sum(counts))
    docs, step = [plain_features(t, p) for t in texts], 0
    for _ in range(p["epochs"]):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), p["batch"]):
            rate = p["rate"] * (1 - step / (p["epochs"] * len(docs)))
            sums, sums_b = np.zeros_like(W), np.zeros(2)
            for i in order[b : b + p["batch"]]:
                step += 1
                v = sum((w * E[k] for k, w in docs[i].items()), np.zeros(p["dims"]))
                z = v @ W + bias
                q = np.exp(z) / np.exp(z).sum()
                loss = (q - np.eye(2)[classes[i]]) * sum(counts) / (2 * counts[classes[i]])
                for d in range(p["dims"]):
                    for c in range(2):
                        sums[d, c] += v[d] * loss[c]
                sums_b += loss
                back = W @ loss
                for k, w in docs[i].items():
                    E[k] -= rate * len(docs[i]) ** 0.5 * w * back
                if not W.any():
                    W += (rng.random(W.shape) - 0.5) * 0.5
            W -= rate * sums
            bias -= 0.1 * rate * sums_b
    return E, W, bias


def test_classifier_is_that_of_plain_loops(labelled):
    good, bad = labelled
    texts, classes = bad[:30] + good[:40], [0] * 30 + [1] * 40
    p = classifier.PARAMETERS | {"buckets": 1 << 12, "epochs": 2}
    E, W, bias = plain_sgd(texts, classes, p)
    model = classifier.train(texts, classes, p)
    assert np.abs(model - np.vstack([E @ W, bias[None]])).max() < 2e-3
    held = good[200:220] + bad[200:220] + ["", "one"]
    for text, q in zip(held, classifier.Scorer(model, p)(held)):
        z = sum((w * (E[k] @ W) for k, w in plain_features(text, p).items()), np.zeros(2)) + bias
        assert abs(q[1] - 1 / (1 + np.exp(z[0] - z[1]))) < 2e-3


def test_classifier_scores_do_not_depend_on_the_cache(labelled):
    good, bad = labelled
    model = classifier.train(bad[:50] + good[:50], [0] * 50 + [1] * 50)
    texts = good[:30] + bad[:30] + ["", None, "x" * 20_000]
    assert np.allclose(classifier.Scorer(model)(texts), classifier.Scorer(model, limit=10)(texts), atol=1e-5)
    words = ["wort", "é😀", "a"]
    f, of = classifier.word_features(words, 1 << 18, (3, 4, 5))
    assert np.bincount(of).tolist() == [1 + 4 + 3 + 2, 1 + 2 + 1, 1 + 1]


def test_classifier_on_awkward_tables(spark, labelled):
    good, bad = labelled
    rows = [row(1000 + i, t) for i, t in enumerate(good[:60] + bad[:60])]
    docs = spark.createDataFrame(awkward() + rows, DOCS)
    labels = spark.createDataFrame([(1000 + i, int(i < 60), 0) for i in range(120)] + [(None, 1, 0), (1000, 0, 1), (2, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int")
    got = classifier.score(clashing(docs), labels)
    assert got.count() == docs.count()
    keep = {r.doc_id: r.keep for r in got.collect()}
    assert not keep[2] and not keep[3] and not keep[4]
    kept = classifier.keep_good(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.where("doc_id between 1060 and 1119").count() <= 3 and kept.where("doc_id between 1000 and 1059").count() >= 57
    assert classifier.score(docs.where("false"), labels).count() == 0
    assert classifier.score(docs, labels.where("false")).count() == docs.count()
    assert classifier.keep_good(docs, labels.where("quality = 1")).where("doc_id = 1").count() == 1


def test_training_documents_are_taken_from_those_there(spark):
    docs = spark.createDataFrame([row(i, prose(i, 30)) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    p = classifier.PARAMETERS | {"buckets": 1 << 10, "max_per_class": 5}
    assert np.array_equal(classifier.fit(docs, labels, p), classifier.fit(docs, labels.where("doc_id < 40"), p))
    gone = docs.where("doc_id % 2 = 1")
    assert classifier.keep_good(gone, labels, p | {"threshold": 2.0}, labelled=docs).count() == 0
    q = classifier.Scorer(classifier.fit(docs, labels, p), p)([prose(1, 30)])[0, 1].round(6)
    kept = classifier.keep_good(gone, labels, p | {"threshold": float(q)}, labelled=docs)
    assert 1 in {r.doc_id for r in kept.collect()}


def test_a_long_word_takes_its_own_room_only():
    tracemalloc.start()
    k, w = classifier.document_features(f"{prose(1, 20_000)} {'x' * 20_000} {prose(1, 20)}", classifier.PARAMETERS)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and len(k) == len(w) and abs(w.sum() - 1) < 1e-3  # 20,000 words of that room would be 1.6 GB


def test_training_texts_do_not_go_to_the_driver(spark):
    texts = {i: prose(i, 30_000) for i in range(80)}
    docs = spark.createDataFrame([row(i, t) for i, t in texts.items()], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    p = classifier.PARAMETERS | {"epochs": 1}
    order = {r.doc_id: r.h for r in labels.selectExpr("doc_id", f"xxhash64(doc_id, {p['seed']}) AS h").collect()}
    first = sorted(texts, key=lambda i: (i % 2, order[i]))
    conf, own = spark.sparkContext._jsc.sc().conf(), {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, most = {k: spark.conf.get(k) for k in own}, conf.get("spark.driver.maxResultSize", "1g")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        conf.set("spark.driver.maxResultSize", "3m")  # the texts of a class have 9 MB
        got = classifier.fit(docs, labels, p)
    finally:
        conf.set("spark.driver.maxResultSize", most)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert np.array_equal(got, classifier.train([texts[i] for i in first], [i % 2 for i in first], p))


def test_license_scan_equals_all_rules_without_prefilter(spark):
    s = license_scan.Scanner()
    texts = [
        "Released under the MIT License.\nfoo", "SPDX-License-Identifier: GPL-3.0-or-later", "licensed under the Apache License, Version 2.0 (the \"License\")",
        "Licensed under CC BY-NC 4.0. See https://creativecommons.org/licenses/by-nc/4.0/ ", "Copyright (c) 2019-2021 X. All rights reserved.",
        'license = "BSD-3-Clause"', "GNU Lesser General Public License, version 2.1", "the Mıt Licenſe and MOZILLA PUBLIC LICENSE, V. 2.0", "", "no such thing", "redistribution and use in source and binary forms, with or without modification " * 3,
    ]
    for t in texts:
        assert s.scan(t) == license_scan.suppressed(s.detections(t, range(len(s.rules))))
    assert [s.rules[d[3]][1] for d in s.scan(texts[0])] == ["MIT"]
    assert [s.rules[d[3]][1] for d in s.scan(texts[1])] == ["GPL-3.0"]
    docs = spark.createDataFrame(awkward() + [row(50, texts[0]), row(50, texts[0]), row(None, texts[3])], DOCS)
    got = license_scan.scan(clashing(docs))
    assert got.where("doc_id = 50").count() == 2 and got.where("doc_id is null").count() == len(s.scan(texts[3]))
    assert license_scan.scan(docs.where("false")).count() == 0


def test_license_notices_match_across_line_breaks():
    s = license_scan.Scanner()
    for rule, text in {
        "bsd-redistribution": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "gpl-or-later": "either version 2 of the License, or\n(at your option) any later version.",
        "mpl-2.0-form": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee",
        "zlib-grant": "This software is provided 'as-is', without any express or implied\nwarranty.",
    }.items():
        for broken in (text, text.replace("\n", "\n * "), text.replace("\n", "\r\n# "), text.replace("\n", "\n//\n//  ")):
            assert rule in [s.rules[k][0] for *_, k in s.scan(broken)], broken
    assert [s.rules[k][0] for *_, k in s.scan("Apache License\n\n2. Grant of rights")] == ["apache-any"]


def test_license_prefilter_reads_any_gap():
    s = license_scan.Scanner()
    for text in ("GNU General Public License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Free Documentation License", "All rights reserved.", "released under the MIT License"):
        want = [k for *_, k in s.scan(text)]
        for gap in ("  ", "\t", " \t ", "\n", "\r\n", "\n * ", "\n# "):
            wide = text.replace(" ", gap)
            assert s.scan(wide) == license_scan.suppressed(s.detections(wide, range(len(s.rules)))) and want == [k for *_, k in s.scan(wide)] != [], wide


def test_license_rules_have_their_keywords():
    s = license_scan.Scanner()
    assert len({r[0] for r in s.rules}) == len(s.rules)
    assert len(license_rules.NOTICES) + len(license_rules.NAMES) + len(license_rules.phrases()) > 300  # hand-written, the rest are tags
    assert all(k == k.lower() for r in s.rules for k in r[3])


@pytest.mark.parametrize("line", license_phrases.PHRASES.strip().splitlines(), ids=lambda line: line.split(";")[0])
def test_license_phrases_pass_their_gate(line):
    name, _, _, _, pattern = line.split("; ", 4)
    s = license_scan.Scanner([r for r in license_rules.phrases() if r[0] == name])

    @given(st.from_regex(pattern, fullmatch=True).filter(str.isascii))
    @settings(max_examples=5, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    def holds(text):
        for gap in (" ", "\n * "):
            broken = text.replace(" ", gap)
            if s.detections(broken, [0]):
                assert s.candidates(broken) == [0], broken
        if re.fullmatch(pattern, text, re.IGNORECASE) and "\n" not in text:
            assert s.detections(text, [0]), text

    holds()


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), st.integers(1, 3), st.integers(0, 3)), max_size=14))
@settings(max_examples=200, deadline=None)
def test_suppression_is_that_of_all_pairs(found):
    found = [(a, a + n, p, k) for a, n, p, k in found]
    strength = lambda d: (-d[2], d[0] - d[1], d[3], d[0])
    want = sorted(d for d in set(found) if not any(e[0] <= d[0] and d[1] <= e[1] and strength(e) < strength(d) for e in set(found)))
    assert license_scan.suppressed(found) == want


def test_long_texts_of_repeats_take_linear_time():
    s, took = license_scan.Scanner(), []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert len(s.scan("copyright 2020 " * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


@pytest.mark.parametrize(
    ("found", "kept"),
    [
        ([(0, 10, 5, 0), (2, 8, 5, 1)], [(0, 10, 5, 0)]),
        ([(0, 10, 5, 0), (2, 8, 9, 1)], [(0, 10, 5, 0), (2, 8, 9, 1)]),
        ([(0, 10, 5, 3), (0, 10, 5, 1)], [(0, 10, 5, 1)]),
        ([(0, 10, 5, 0), (5, 15, 9, 1)], [(0, 10, 5, 0), (5, 15, 9, 1)]),
        ([(0, 10, 5, 0), (0, 10, 6, 1), (3, 4, 1, 2)], [(0, 10, 6, 1)]),
    ],
)
def test_suppression(found, kept):
    assert license_scan.suppressed(found) == kept


URLS = [
    "http://example.org/a/b", "https://www.example.org/a/b?x#y", "EXAMPLE.org.", "http://user:p@Example.ORG:8080//a//c", "ftp://a.b.example.org/a", "", None, " ", "http://", "notld", "http://x.test/private/x",
    "//example.org/a", "http://example.org/a", "http://example.org?a", "http://other.net/a/b/c",
]
ENTRIES = [("block", "example.org"), ("allow", "example.org/a"), ("block", "example.org/a/b"), ("allow", "b.example.org"), ("block", "test"), ("allow", "x.test"), ("block", "x.test"), ("block", ""), ("block", "x.test/private")]


def way_of(url):
    """Plain: reversed labels, '/', segments."""
    rest = re.split(r"[?#]", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", (url or "").strip(" ")), maxsplit=1)[0]
    host, _, path = rest.partition("/")
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".").lower()
    return [*host.split(".")[::-1], "/", *[s for s in path.split("/") if s]] if host else []


def brute(url, entries):
    hits = []
    for action, entry in entries:
        k, way = way_of(entry), way_of(url)
        k = k[:-1] if k and k[-1] == "/" else k
        if k and way[: len(k)] == k:
            host, path = ".".join(k[: k.index("/")] if "/" in k else k), k[k.index("/") + 1 :] if "/" in k else []
            hits.append((len(k), action == "block", action, "/".join([host, *path])))
    return max(hits)[2:] if hits else ("allow", "")


def test_url_filter_trie_join_and_brute_force_agree(spark):
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(1, URLS[0]), (None, URLS[0])], "page_id long, url string"))
    want = sorted(((i, u, *brute(u, ENTRIES)) for i, u in [*enumerate(URLS), (1, URLS[0]), (None, URLS[0])]), key=repr)
    assert rows_of(url_filter.judge(pages, ENTRIES)) == want
    assert rows_of(url_filter.judge(pages, spark.createDataFrame(ENTRIES, url_filter.ENTRIES))) == want
    assert rows_of(url_filter.judge(pages, ENTRIES, url_filter.PARAMETERS | {"max_broadcast": 0})) == want
    assert rows_of(url_filter.judge(pages, [])) == sorted(((r[0], r[1], "allow", "") for r in want), key=repr)
    assert url_filter.judge(pages.where("false"), ENTRIES).count() == 0
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    assert sorted(con.sql(f"SELECT page_id, url, action, entry FROM ({url_filter.oracle(ENTRIES)})").fetchall(), key=repr) == want


def test_a_blank_in_a_segment_is_not_the_end_of_it(spark):
    pages = spark.createDataFrame([(1, "http://example.com/a b"), (2, "http://example.com/a/b"), (3, "http://example.com/a.b/c")], "page_id long, url string")
    for p in (url_filter.PARAMETERS, url_filter.PARAMETERS | {"max_broadcast": 0}):
        got = url_filter.judge(pages, [("block", "example.com/a b"), ("block", "b.example.com"), ("block", "example.com/a.b")], p)
        assert {r.page_id: r.action for r in got.collect()} == {1: "block", 2: "allow", 3: "block"}


def test_the_rules_file():
    rules = url_filter.entries_of(url_filter.PARAMETERS["rules"])
    assert len(rules) > 200 and {a for a, _ in rules} == {"allow", "block"} and len(set(rules)) == len(rules)
