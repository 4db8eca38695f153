"""Deterministic sharded WARC writer.

Records are ordered by SURT key (reversed host labels, then path), url, page_id and content, and cut into
shards at keys. The cuts are weighted quantiles of a sample that a hash of each row picks, so they depend on
the rows alone, not on partitions or attempts. One task writes a shard, in order, one gzip member a
record, and begins a new file when the compressed size passes `file_bytes`. Headers are
regenerated: record id, both SHA-1 digests, lengths, HTTP head; dates are a parameter.

Files are written under names of their task attempt. Only the attempts whose index rows Spark committed are
renamed to their final names, then the manifest is put in place the same way; what other attempts
left is deleted. A folder without manifest.json is not a finished archive.

Defined cases: null html is an empty payload; a null url is `urn:page:<page_id>` (of a null page_id: `urn:page:`);
white space and control characters in a url are percent-encoded; equal rows are separate records, told apart
by their number in the record id; an empty table gives a manifest without files; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_dir

#: shard_bytes: content bytes of a shard; file_bytes: compressed size after which a file ends; samples: rows a shard for its cuts.
PARAMETERS = {"shard_bytes": 128 << 20, "file_bytes": 32 << 20, "samples": 20, "level": 6, "date": "2000-01-01T00:00:00Z"}
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_id string, __temp string, __shard int"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def surt(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, url: str | None, record_id: str, date: str, block: bytes, payload: bytes | None, content_type: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {url}"] if url is not None else []
    head += [f"WARC-Payload-Digest: {sha1(payload)}"] if payload is not None else []
    head += [f"WARC-Block-Digest: {sha1(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(url: str, page_id: int | None, html: str, nth: int, date: str) -> tuple[bytes, str, str]:
    """The whole record, its payload digest and its id."""
    payload = html.encode("utf-8", "surrogatepass")
    digest = sha1(payload)
    name = hashlib.sha1(f"{url}\n{page_id}\n{digest}\n{nth}".encode()).digest()[:16]
    record_id = f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return record("response", url, record_id, date, block, payload, "application/http;msgtype=response"), digest, record_id


def gzipped(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without name and time
    return z.compress(data) + z.flush()


class Roller:
    """Writes one shard's records to one file after another."""

    def __init__(self, filesystem: pafs.FileSystem, folder: str, shard: int, attempt: str, p: dict):
        self.fs, self.folder, self.shard, self.attempt, self.p = filesystem, folder, shard, attempt, p
        self.number, self.out = -1, None

    def write(self, data: bytes) -> tuple[int, int]:
        if self.out is None or self.at >= self.p["file_bytes"]:
            self.close()
            self.number += 1
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temp = f"_temporary/{self.attempt}-{self.name}"
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.temp}", compression=None), 0
            info = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
            own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(info).digest()[:16], version=5)}>"
            self.put(record("warcinfo", None, own, self.p["date"], info, None, "application/warc-fields"))
        return self.put(data)

    def put(self, data: bytes) -> tuple[int, int]:
        member = gzipped(data, self.p["level"])
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def cuts(rows: DataFrame, p: dict) -> list[str]:
    """The least keys of all shards but the first."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum("__size")).first()
    shards = max(1, -(-(size or 0) // p["shard_bytes"]))
    if shards == 1:
        return []
    share = min(1.0, p["samples"] * shards / n)
    picked = rows.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = picked.groupBy("__key").agg(F.sum("__size").alias("size")).toPandas().sort_values("__key")
    total = sample["size"].cumsum().to_numpy()
    if not len(total):
        return []
    at = np.searchsorted(total, total[-1] * np.arange(1, shards) / shards)
    return sorted(set(sample["__key"].to_numpy()[at]))


def write(pages: DataFrame, folder: str, p: dict = PARAMETERS) -> DataFrame:
    """Writes pages (page_id, url, html) to the folder, which must be new, and returns its index: page_id, url, file, offset, length, payload_digest, record_id."""
    spark = pages.sparkSession
    url = F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", surt(F.col("url")).alias("__key"), (F.octet_length("html").cast("long") + 512).alias("__size"))
    bounds = cuts(rows, p)
    shared = spark.sparkContext.broadcast(np.array(bounds, object))  # one key a shard

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy(object), side="right"), dtype="int32")

    shard = shard_of("__key") if bounds else F.lit(0)
    rows = rows.drop("__size").withColumn("__shard", shard).repartitionById(len(bounds) + 1, F.col("__shard"))
    rows = rows.sortWithinPartitions("__shard", "__key", "url", "page_id", "html").drop("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(f"{path}/_temporary")
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}"
        roller, last, nth = None, None, 0
        for b in batches:
            found = []
            for page_id, url, html, k in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "html", "__shard")]):
                if roller is None or roller.shard != k:
                    if roller is not None:
                        roller.close()
                    roller = Roller(filesystem, path, k, attempt, p)
                nth = nth + 1 if (page_id, url, html) == last else 0
                last = (page_id, url, html)
                safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
                data, digest, record_id = response(safe, page_id, html, nth, p["date"])
                offset, length = roller.write(data)
                found.append((page_id, safe, roller.name, offset, length, digest, record_id, roller.temp, k))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()])], names)
        if roller is not None:
            roller.close()

    names = [c.split()[0] for c in INDEX.split(", ")]
    rows.select("page_id", "url", "html", "__shard").mapInArrow(run, INDEX).write.parquet(f"{folder}/_index")
    commit(spark.read.schema(INDEX).parquet(f"{folder}/_index"), folder)
    return spark.read.schema(INDEX).parquet(f"{folder}/_index").drop("__temp", "__shard")


def commit(index: DataFrame, folder: str) -> None:
    """Gives the files in the index their final names, many side by side, and writes the manifest. May be repeated, tasks of it too."""
    filesystem, path = pafs.FileSystem.from_uri(folder)

    def renamed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = pafs.FileSystem.from_uri(folder)
        for part in parts:
            for temp, file in zip(part["temp"], part["file"]):
                if filesystem.get_file_info(f"{path}/{file}").type == pafs.FileType.NotFound:
                    filesystem.move(f"{path}/{temp}", f"{path}/{file}")
            yield part

    rows = index.groupBy("file", F.col("__temp").alias("temp")).agg(F.count(F.lit(1)).alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes"))
    files = sorted(rows.mapInPandas(renamed, rows.schema).collect(), key=lambda f: f["file"])  # one row a file
    body = json.dumps({"files": [{"file": f["file"], "records": f["records"], "bytes": f["bytes"]} for f in files]}, indent=1)
    with filesystem.open_output_stream(f"{path}/manifest.json.tmp") as out:
        out.write(body.encode())
    filesystem.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    if filesystem.get_file_info(f"{path}/_temporary").type != pafs.FileType.NotFound:
        filesystem.delete_dir(f"{path}/_temporary")


def archive(pages: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """write() to a new folder in the shared folder."""
    return write(pages, fresh_dir(pages.sparkSession, "warc"), p)


def read(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of a file written here."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        raw = z.decompress(data[at:]) + z.flush()
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, headers, rest[: int(headers["Content-Length"])]
        at = len(data) - len(z.unused_data)
