"""URL allow and block lists by a trie over reversed host labels and path segments.

An entry is `host`, which covers the host, its subdomains and all their paths, or `host/segments`, which covers that
very host and paths that begin with those segments. In the trie, host labels come in reverse, then a mark
for the end of the host, then path segments. The deepest entry on a url's way decides; where one key has
both actions, block does. Without any, the default action holds.

A key is the way as one string, labels joined by '.', then '/' and segments joined by '/'; neither mark can be in what it
joins. Lists are a table (action, entry), a Python list, or the file `url_rules.txt`. While they have at most `max_broadcast`
keys, the compiled trie, a few plain arrays, is broadcast, and the urls of a batch step through it side by side. Beyond that the
same keys are matched by an equi-join on all prefixes of each url, with the same result.

Defined cases: scheme, credentials, port, query, fragment, letter case of the host, a trailing dot and empty segments
don't matter; a url without a scheme is read from its host on; a null or blank url has no key and gets the default
action; repeated rows are judged row by row; entries without a host are ignored; an empty table or list works; columns other
than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARAMETERS = {"max_broadcast": 1_000_000, "default": "allow", "rules": str(Path(__file__).with_name("url_rules.txt"))}
ENTRIES = "action string, entry string"


def entries_of(path: str) -> list[tuple[str, str]]:
    """(action, entry) of each line of a rules file that isn't a remark."""
    with open(path, encoding="utf-8") as f:
        return [tuple(line.split(maxsplit=1)) for line in map(str.strip, f) if line and line[0] != "#"]


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, reversed labels and path segments of a url or an entry."""
    rest = F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^?#]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/]*", 0), r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))
    return host, F.reverse(F.split(host, r"\.")), F.filter(F.split(F.regexp_replace(rest, r"^[^/]*", ""), "/"), lambda s: s != "")


def steps(url: Column) -> Column:
    """The trie steps of a url: reversed labels, '/', segments. Empty without a host."""
    host, labels, path = _parts(url)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(labels, F.array(F.lit("/")), path))


def prefixes(url: Column) -> Column:
    """depth and key of all keys on a url's way, the shortest first."""
    host, labels, path = _parts(url)
    whole, none = F.array_join(labels, "."), F.array().cast("array<struct<depth:int,key:string>>")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(labels, 1, n), ".").alias("key")))
    below = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.struct((F.size(labels) + 1 + n).alias("depth"), F.concat(whole, F.lit("/"), F.array_join(F.slice(path, 1, n), "/")).alias("key")))
    return F.when(host == "", none).otherwise(F.concat(hosts, F.when(F.size(path) > 0, below).otherwise(none)))


def keyed(entries: DataFrame) -> DataFrame:
    """key, action of the entries (action, entry): one row a key."""
    way = prefixes(F.col("entry"))
    rows = entries.select("action", F.get(way, F.size(way) - 1)["key"].alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.max("action").alias("action"))  # block after allow


class Trie:
    """Plain arrays: `edges` are node * words + word, in order, with their targets; `entry` is a node's key, -1 without."""

    def __init__(self, keys: Iterable[tuple[str, str]]):
        self.keys, self.actions = map(list, zip(*sorted(keys))) if keys else ([], [])
        words: dict[str, int] = {}
        children: dict[tuple[int, int], int] = {}
        entry = [-1]
        for k, key in enumerate(self.keys):
            host, mark, path = key.partition("/")
            node = 0
            for step in host.split(".") + (["/", *path.split("/")] if mark else []):
                edge = (node, words.setdefault(step, len(words)))
                node = children.setdefault(edge, len(entry))
                if node == len(entry):
                    entry.append(-1)
            entry[node] = k
        self.words = list(words)
        found = sorted((n * len(words) + w, t) for (n, w), t in children.items())
        self.edges, self.targets = np.array([e for e, _ in found], np.int64), np.array([t for _, t in found], np.int64)
        self.entry = np.array(entry, np.int64)

    def lookup(self, ways: pa.ListArray) -> np.ndarray:
        """Of each way the key of the deepest node that has one, -1 if none; all step down side by side."""
        n = len(ways)
        best, node = np.full(n, -1), np.zeros(n, np.int64)
        word = pc.index_in(ways.flatten(), value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = ways.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        going, depth = np.arange(n if len(self.edges) else 0), 0
        while len(going := going[size[going] > depth]):
            w = word[begin[going] + depth]
            edge = node[going] * len(self.words) + w
            at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            ok = (self.edges[at] == edge) & (w >= 0)
            going = going[ok]
            node[going] = self.targets[at[ok]]
            own = self.entry[node[going]]
            best[going] = np.where(own >= 0, own, best[going])
            depth += 1
        return best


def as_table(spark: SparkSession, entries: DataFrame | list[tuple[str, str]] | str) -> DataFrame:
    if isinstance(entries, DataFrame):
        return entries
    return spark.createDataFrame(entries_of(entries) if isinstance(entries, str) else list(entries), ENTRIES)


def judge(pages: DataFrame, entries: DataFrame | list[tuple[str, str]] | str = PARAMETERS["rules"], p: dict = PARAMETERS) -> DataFrame:
    """page_id, url, action, entry (the deciding entry's key, '' by default); one row per row of pages. entries: a table, a list, or the name of a file."""
    listed = keyed(as_table(pages.sparkSession, entries))
    held = listed.limit(p["max_broadcast"] + 1).collect()  # one more than may be broadcast tells that there are too many
    if len(held) > p["max_broadcast"]:
        return judge_joined(pages, listed, p)
    shared = pages.sparkSession.sparkContext.broadcast(Trie([(r.key, r.action) for r in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        actions, keys = pa.array([*trie.actions, p["default"]], pa.string()), pa.array([*trie.keys, ""], pa.string())
        for b in batches:
            best = trie.lookup(b.column("way"))
            at = pa.array(np.where(best < 0, len(trie.keys), best))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), actions.take(at), keys.take(at)], ["page_id", "url", "action", "entry"])

    rows = pages.select("page_id", "url", steps(F.col("url").cast("string")).alias("way"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("action", StringType()), StructField("entry", StringType())]))


def judge_joined(pages: DataFrame, listed: DataFrame, p: dict = PARAMETERS) -> DataFrame:
    """judge() with the keys (key, action; one row a key) as a table of any size."""
    urls = pages.select(F.col("url").cast("string").alias("u")).distinct()
    found = urls.select("u", F.explode(prefixes(F.col("u"))).alias("k")).select("u", "k.depth", "k.key").join(listed, "key")
    best = found.groupBy("u").agg(F.max(F.struct("depth", "action", "key")).alias("b"))
    rows = pages.select("page_id", "url").join(best, F.col("url").cast("string") == F.col("u"), "left")
    return rows.select("page_id", "url", F.coalesce("b.action", F.lit(p["default"])).alias("action"), F.coalesce("b.key", F.lit("")).alias("entry"))


def oracle(entries: list[tuple[str, str]] | None = None) -> str:
    values = ", ".join("('%s', '%s')" % (a, e.replace("'", "''")) for a, e in (entries_of(PARAMETERS["rules"]) if entries is None else entries))
    return rf"""
WITH given AS (SELECT 'entry' AS kind, action, entry AS url, NULL::BIGINT AS page_id, row_number() OVER () AS n FROM (VALUES {values}) AS e(action, entry)
  UNION ALL SELECT 'page', NULL, url, page_id, row_number() OVER () FROM pages),
rest AS (SELECT *, regexp_extract(regexp_replace(trim(coalesce(url, ''), ' '), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^?#]*') AS rest FROM given),
host AS (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/]*'), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')) AS host,
  list_filter(string_split(regexp_replace(rest, '^[^/]*', ''), '/'), lambda s: s <> '') AS path FROM rest),
ways AS (SELECT *, CASE WHEN host = '' THEN [] ELSE list_reverse(string_split(host, '.')) END AS labels FROM host),
keys AS (SELECT kind, n, action, k, CASE WHEN k <= len(labels) THEN array_to_string(labels[1:k], '.') ELSE array_to_string(labels, '.') || '/' || array_to_string(path[1:k - len(labels)], '/') END AS key,
  k = len(labels) + len(path) AS whole FROM (SELECT *, unnest(range(1, len(labels) + len(path) + 1)) AS k FROM ways WHERE len(labels) > 0)),
entries AS (SELECT key, max(action) AS action FROM keys WHERE kind = 'entry' AND whole GROUP BY key),
best AS (SELECT n, arg_max(struct_pack(action := e.action, key := key), k) AS b FROM keys JOIN entries e USING (key) WHERE kind = 'page' GROUP BY n)
SELECT page_id, url, coalesce(b.action, 'allow') AS action, coalesce(b.key, '') AS entry FROM ways LEFT JOIN best USING (n) WHERE kind = 'page'
"""
