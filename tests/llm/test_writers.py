"""WARC writer and BPE: round trips and determinism."""

import base64
import gzip
import hashlib
import json
import os
import random
import re

import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import DOCS, awkward, clashing, prose, row
from tidemark.llm import bpe, warc

SMALL = warc.PARAMETERS | {"shard_bytes": 40_000, "file_bytes": 6_000}


def pages(spark, n=120):  # noqa: ANN001, ANN201
    rows = [(i, f"http://h{i % 7}.example.org/p/{i}", prose(i, 20 + i)) for i in range(n)]
    rows += [(500, None, "<p>x</p>"), (None, None, None), (501, "http://a b.example/\né", ""), (502, "", None), (3, *rows[3][1:]), (503, "http://z.example/", "long " * 20_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def digests(folder):  # noqa: ANN001, ANN201
    return {f: hashlib.sha256(open(f"{folder}/{f}", "rb").read()).hexdigest() for f in sorted(os.listdir(folder)) if f.endswith(".warc.gz")}


def test_archive_is_whole_ordered_and_deterministic(spark, tmp_path):
    df = pages(spark)
    index = warc.write(clashing(df), f"file://{tmp_path}/a", SMALL).collect()
    warc.write(df.repartition(7).orderBy("html"), f"file://{tmp_path}/b", SMALL)
    assert digests(tmp_path / "a") == digests(tmp_path / "b") and len(digests(tmp_path / "a")) > 3
    assert len(index) == df.count() and len({r.record_id for r in index}) == len(index)
    files = {f: open(tmp_path / "a" / f, "rb").read() for f in digests(tmp_path / "a")}
    assert len({f.split("-")[1] for f in files}) > 1
    manifest = {f["file"]: f for f in json.load(open(tmp_path / "a" / "manifest.json"))["files"]}
    assert set(manifest) == set(files) and not os.path.exists(tmp_path / "a" / "_temporary")
    records = {}
    for f, data in files.items():
        assert manifest[f]["bytes"] == len(data)
        for at, headers, block in warc.read(data):
            assert headers["WARC-Block-Digest"] == warc.sha1(block)
            if headers["WARC-Type"] == "response":
                payload = block.split(b"\r\n\r\n", 1)[1]
                assert headers["WARC-Payload-Digest"] == warc.sha1(payload) == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                records[(f, at)] = (headers["WARC-Target-URI"], payload.decode())
    assert len(records) == len(index) and all(records[(r.file, r.offset)][0] == r.url for r in index)
    want = sorted((r.html or "") for r in df.collect())
    assert sorted(p for _, p in records.values()) == want
    assert {"urn:page:500", "urn:page:"} <= {u for u, _ in records.values()} and any("%20" in u and "%0A" in u for u, _ in records.values())
    keys = [(r.file, r.offset) for r in sorted(index, key=lambda r: (r.file, r.offset))]
    surts = {(r.file, r.offset): k for r, k in zip(index, [x.k for x in spark.createDataFrame([(i, r.url) for i, r in enumerate(index)], "i int, u string").select("i", warc.surt(warc.F.col("u")).alias("k")).orderBy("i").collect()])}
    plain = [surts[k] for k in keys if "%" not in surts[k] and "urn:" not in surts[k]]
    assert plain == sorted(plain)


def plain_records(files: dict[str, bytes]) -> list[tuple[str, str]]:
    """url and payload of the responses, by the format's rules alone: whole files unzipped, headers by lines, lengths from the headers."""
    found = []
    for name in sorted(files):
        data, at = gzip.decompress(files[name]), 0
        kinds = []
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            first, *lines = data[at:end].decode().split("\r\n")
            h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
            block = data[end + 4 : end + 4 + int(h["content-length"])]
            at = end + 4 + len(block) + 4
            assert first == "WARC/1.1" and data[at - 4 : at] == b"\r\n\r\n" and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", h["warc-record-id"])
            assert h["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            kinds.append(h["warc-type"])
            if kinds[-1] == "response":
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 ") and f"Content-Length: {len(payload)}".encode() in http
                found.append((h["warc-target-uri"], payload.decode()))
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"}
    return found


def test_records_are_those_of_a_plain_sequential_writer(spark, tmp_path):
    df = pages(spark)
    warc.write(df, f"file://{tmp_path}/s", SMALL)
    files = {f: open(tmp_path / "s" / f, "rb").read() for f in digests(tmp_path / "s")}

    def key(r):  # noqa: ANN001, ANN202
        url = r.url if r.url is not None else f"urn:page:{'' if r.page_id is None else r.page_id}"
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url)
        surt = ",".join(reversed((m[1] if m else "").lower().split("."))) + ")" + (url[m.end() :] if m else url)
        return surt, url, -1 if r.page_id is None else r.page_id, r.html or ""

    want = [(re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u), html) for _, u, _, html in sorted(map(key, df.collect()))]
    assert plain_records(files) == want
    last = {f.split("-")[1]: f for f in sorted(files)}
    for f, data in files.items():  # a file ends with the record that takes it past file_bytes
        ends = [at for at, *_ in warc.read(data)]
        assert ends[-1] < SMALL["file_bytes"] and (len(data) >= SMALL["file_bytes"] or f in last.values())


def test_other_attempts_leave_nothing_and_commit_may_be_repeated(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    df = pages(spark, 30)
    os.makedirs(tmp_path / "c" / "_temporary")
    (tmp_path / "c" / "_temporary" / "9-9-shard-000000-00000.warc.gz").write_bytes(b"left by a lost attempt")
    warc.write(df, folder, SMALL)
    before = digests(tmp_path / "c")
    warc.commit(spark.read.schema(warc.INDEX).parquet(f"{folder}/_index"), folder)
    assert digests(tmp_path / "c") == before and not os.path.exists(tmp_path / "c" / "_temporary")


def test_empty_archive(spark, tmp_path):
    assert warc.write(pages(spark).where("false"), f"file://{tmp_path}/e").count() == 0
    assert json.load(open(tmp_path / "e" / "manifest.json")) == {"files": []}


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.load_ranks(bpe.PARAMETERS["vocabulary"])
    return ranks, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings():
    rng = random.Random(4)
    out = ["", " ", "a", "  \n\n x  ", "a" * 700, "é😀ß中文" * 60, "<|endoftext|> don't we'll I'm", "1234567 89", "x" * 70 + "the" * 90, "\t\r\n  "]
    return out + ["".join(rng.choice("ab cé😀\n\t'slld1!?— ") for _ in range(rng.randint(1, 400))) for _ in range(60)] + [prose(i, 100) for i in range(20)]


def test_ids_are_those_of_plain_bpe(plain):
    ranks, own = plain
    words = sorted({w.encode() for t in strings() for w in bpe.regex.findall(bpe.PATTERN, t)})
    for part in (words, words[::3], []):
        e = bpe.Encoder(ranks, bpe.Lexicon.build(part, [bpe.merge(w, ranks) for w in part]), remembered=50)
        for t, got in zip(strings(), e.encode_all(strings())):
            ids = np.frombuffer(got, np.int32)
            assert ids.tolist() == own.encode_ordinary(t) and e.decode(ids) == t.encode()


@given(st.text(st.sampled_from(" \n\t\x1c\x1f\x85\xa0\u2003\u200b\u3000aZé中'sdlm19²Ⅷ!.-_\u0301😀")), st.text(max_size=12))
@settings(max_examples=400, deadline=None)
def test_pieces_are_split_as_their_text(a, b):
    text = a + b
    split = regex.compile(bpe.PATTERN).findall
    pieces = bpe.PIECES.findall(text)
    assert "".join(pieces) == text and [w for p in pieces for w in split(p)] == split(text)


def test_white_space_is_that_of_the_pattern():
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    assert regex.findall(r"\s", every) == re.findall(f"[{bpe._SPACE}]", every)


def test_lexicon_is_minimal_and_maps(tmp_path):
    words = sorted(a + b for a in (b"un", b"re", b"") for b in (b"do", b"doing", b"making", b"made", b"ing"))
    lexicon = bpe.Lexicon.build(words, [[i, i + 1] for i in range(len(words))])
    (tmp_path / "l.bin").write_bytes(lexicon.dump())
    opened = bpe.Lexicon.open(str(tmp_path / "l.bin"))
    assert opened.ranks([*words, b"", b"und", b"undoingx", b"zz"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert [opened.ids_of(i).tolist() for i in range(len(words))] == [[i, i + 1] for i in range(len(words))]
    languages = {}
    states = list(range(len(lexicon.final)))
    for s in states:  # targets come first: each state's suffixes are known when it is reached
        edges = [(int(k) % 256, int(t)) for k, t in zip(lexicon.keys, lexicon.target) if k // 256 == s]
        languages[s] = frozenset(([b""] if lexicon.final[s] else []) + [bytes([b]) + x for b, t in edges for x in languages[t]])
    assert len(set(languages.values())) == len(states)


def test_encode_on_awkward_tables(spark, plain):
    docs = spark.createDataFrame(awkward() + [row(900 + i, t) for i, t in enumerate(strings())], DOCS)
    got = bpe.encode(clashing(docs), bpe.PARAMETERS | {"lexicon": 200})
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        if text[r.doc_id] is None:
            assert (r.ids, r.n_tokens, r.round_trip) == (None, None, None)
        else:
            assert r.ids == plain[1].encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    assert {r.doc_id: r.text for r in bpe.decode(got).collect() if r.doc_id is not None} == text
    assert bpe.encode(docs.where("false")).count() == 0
