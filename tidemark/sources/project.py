"""Project documents: nested JSON, version 1. Reading is lenient: a missing or mistyped field takes its default."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.lineage import cut
from tidemark.operators.overlays import default_speakers
from tidemark.operators.timeline import normalise
from tidemark.schema import EXPORT_DEFAULTS, LISTS, PLACES, SEGMENT, SEGMENT_DEFAULTS, SETTINGS, TRANSLATION_STYLE
from tidemark.sources.files import whole_texts

NO_PROJECT = "not a project document"
_PIECE = "struct<startMs:double,endMs:double,text:string,translation:string,translationStartMs:double,translationEcho:boolean>"
_SEGMENT = f"struct<startMs:double,endMs:double,text:string,speakerId:int,confidence:double,needsReview:boolean,reviewReason:string,translation:string,translationStartMs:double,translationEcho:boolean,mergedFrom:array<{_PIECE}>>"
DOCUMENT = f"version int, segments array<{_SEGMENT}>, speakers array<struct<name:string,tint:string>>, scenes array<struct<image:string,startMs:double,endMs:double,fit:string>>"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def to_json(segments: DataFrame) -> DataFrame:
    """doc_id, project: each document's segments as JSON, in order."""
    names = [c.split()[0] for c in SEGMENT.split(", ")][2:]
    number = lambda c, n: c.cast("double") if n.endswith("_ms") else c
    piece = lambda p: F.struct(*[number(p[n], n).alias(_camel(n)) for n in ("start_ms", "end_ms", "text", "translation", "translation_start_ms", "translation_echo")])
    own = F.struct("seg_idx", F.struct(*[F.transform("merged_from", piece).alias("mergedFrom") if n == "merged_from" else number(F.col(n), n).alias(_camel(n)) for n in names]).alias("s"))
    rows = segments.select("doc_id", own.alias("o")).groupBy("doc_id").agg(F.transform(F.sort_array(F.transform(F.collect_list("o"), lambda o: F.struct(o.seg_idx, F.to_json(o.s).alias("s")))), lambda o: o.s).alias("s"))
    return rows.select("doc_id", F.concat(F.lit('{"version":1,"segments":['), F.array_join("s", ","), F.lit("]}")).alias("project"))


def from_json(documents: DataFrame) -> DataFrame:
    """Segments of documents (doc_id, project), defaults filled in, in order of time without overlaps."""
    doc = F.from_json("project", DOCUMENT)
    rows = documents.select("doc_id", F.posexplode(doc["segments"]).alias("seg_idx", "s"))
    ms = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    piece = lambda p: F.struct(ms(p.startMs).alias("start_ms"), ms(p.endMs).alias("end_ms"), F.coalesce(p.text, F.lit("")).alias("text"), F.coalesce(p.translation, F.lit("")).alias("translation"), ms(p.translationStartMs).alias("translation_start_ms"), F.coalesce(p.translationEcho, F.lit(False)).alias("translation_echo"))
    columns = []
    for c in SEGMENT.split(", ")[2:]:
        name, kind = c.split(" ", 1)
        field = F.col(f"s.{_camel(name)}")
        value = F.transform(F.coalesce(field, F.array().cast(f"array<{_PIECE}>")), piece) if name == "merged_from" else ms(field) if name.endswith("_ms") else F.coalesce(field.cast(kind), F.expr(SEGMENT_DEFAULTS.get(name, "''")))
        columns.append(value.alias(name))
    return normalise(rows.select("doc_id", "seg_idx", *columns)).select(*[c.split()[0] for c in SEGMENT.split(", ")])


def _fields(spec: dict) -> str:
    kind = lambda d: f"struct<{_fields(d)}>" if isinstance(d, dict) else "boolean" if d in ("true", "false") else "string" if d[0] == "'" else "double"
    return ",".join(f"{_camel(n)}:{kind(d)}" for n, d in spec.items())


WHOLE = f"struct<{_fields(SETTINGS)},segments:array<{_SEGMENT}>,{','.join(f'{n}:array<struct<{_fields(spec)}>>' for n, spec in LISTS.items())}>"


def _read(o: Column, spec: dict) -> list[Column]:
    """The fields of a JSON object; what is missing, mistyped or no color takes its default."""
    out = []
    for name, default in spec.items():
        c = o[_camel(name)]
        if isinstance(default, dict):
            value = F.struct(*_read(c, default))
        elif name == "fit":
            value = F.when(c == "contain", "contain").otherwise("cover")
        elif default.startswith("'#"):
            value = T.color(c, default.strip("'"))
        elif default[0] == "'" or default in ("true", "false") or default[-1] == "D":
            value = F.coalesce(c, F.expr(default))
        elif default[-1] == "L":
            value = F.coalesce(c.cast("bigint"), F.expr(default))
        else:  # a number with a fraction is no whole number
            value = F.coalesce(F.when(c == F.floor(c), c.cast("int")), F.expr(default))
        out.append(value.alias(name))
    return out


def _written(row: Callable[[str], Column], spec: dict) -> Column:
    values = []
    for name, default in spec.items():
        c = row(name)
        value = _written(lambda n, c=c: c[n], default) if isinstance(default, dict) else c.cast("double") if default[-1] == "L" else c
        values.append(value.alias(_camel(name)))
    return F.struct(*values)


def default_settings(docs: DataFrame) -> DataFrame:
    """The settings of a new document for each doc_id."""
    own = {"translation_style": F.struct(*[F.expr(d).alias(n) for n, d in TRANSLATION_STYLE.items()]), "export": F.struct(*[F.expr(d).alias(n) for n, d in EXPORT_DEFAULTS.items()])}
    return docs.select("doc_id", *[own.get(n, F.expr(d) if isinstance(d, str) else None).alias(n) for n, d in SETTINGS.items()])


def decode(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of documents (doc_id, project, perhaps error): settings, segments, speakers, scenes, highlights, overlays, and errors (doc_id, error).

    A document that can't be opened, or isn't a JSON object, has an error and is a new document otherwise; one without speakers has the default two."""
    said = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("project")).startswith("OBJECT"), F.lit(False))
    rows = documents.select("doc_id", F.coalesce(said, F.when(~is_object, NO_PROJECT)).alias("error"), F.from_json(F.when(is_object, F.col("project")), WHOLE).alias("p"))
    rows = cut(rows)  # each text is parsed once for all tables
    good = rows.where("error is null")
    fresh = F.when(F.col("p.translationStyle").isNull(), F.struct(*[F.expr(d).alias(n) for n, d in TRANSLATION_STYLE.items()]))
    columns = [F.coalesce(fresh, c).alias("translation_style") if n == "translation_style" else c for n, c in zip(SETTINGS, _read(F.col("p"), SETTINGS))]
    tables = {"settings": good.select("doc_id", *columns).unionByName(default_settings(rows.where("error is not null"))), "segments": from_json(documents), "errors": rows.where("error is not null").select("doc_id", "error")}
    for name, spec in LISTS.items():
        place = PLACES[name]
        tables[name] = good.select("doc_id", F.posexplode(f"p.{name}").alias(place, "o")).select("doc_id", place, *_read(F.col("o"), spec))
    tables["scenes"] = normalise(tables["scenes"], "scene_idx", trim=False)
    bare = tables["settings"].select("doc_id").join(tables["speakers"].select("doc_id").distinct(), "doc_id", "left_anti")
    tables["speakers"] = tables["speakers"].unionByName(default_speakers(bare))
    return tables


def encode(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id, project of the tables that decode() gives; one document for each row of settings, with its lists in order. A table that isn't there is empty lists."""
    out = tables["settings"].select("doc_id", *[_written(F.col, {n: d}).getField(_camel(n)).alias(n) for n, d in SETTINGS.items()])
    piece = {n: "0L" if n.endswith("_ms") else "false" if n == "translation_echo" else "''" for n in ("start_ms", "end_ms", "text", "translation", "translation_start_ms", "translation_echo")}
    names = [c.split()[0] for c in SEGMENT.split(", ")][2:]
    specs = LISTS | {"segments": {n: "0L" if n.endswith("_ms") else "''" for n in names}}
    for name, spec in specs.items():
        if name not in tables:
            continue
        if name == "segments":
            own = F.struct(*[F.transform("merged_from", lambda p: _written(lambda n: p[n], piece)).alias("mergedFrom") if n == "merged_from" else _written(F.col, {n: d}).getField(_camel(n)).alias(_camel(n)) for n, d in spec.items()])
        else:
            own = _written(F.col, spec)
        rows = tables[name].select("doc_id", F.struct(F.col(PLACES[name]).alias("i"), own.alias("o")).alias("r"))
        out = out.join(rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.o).alias(f"__{name}")), "doc_id", "left")
    lists = [F.coalesce(f"__{name}", F.array()).alias(name) for name in specs if name in tables]
    return out.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), *[F.col(n).alias(_camel(n)) for n in SETTINGS], *lists)).alias("project"))


def load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id (from the file name), path, project, error: document files, one object each; what can't be opened is a row with an error."""
    rows = whole_texts(spark, paths)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("project"), "error")


def save(documents: DataFrame, folder: str) -> None:
    """One JSON line a document; the committer makes it appear all at once."""
    documents.select("project").write.mode("overwrite").text(folder)
