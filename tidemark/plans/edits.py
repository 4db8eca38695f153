"""Queries on documents, edits, checks, replies and small functions."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import timing as M
from tidemark.operators import frames as V
from tidemark.operators import overlays as O
from tidemark.operators import speakers as P
from tidemark.operators import timeline as L
from tidemark.operators import translations as R
from tidemark.operators import vectors as E
from tidemark.operators.lineage import cut
from tidemark.plans import fixtures as X
from tidemark.plans import timelines as Q
from tidemark.sources import audio, project, subtitles

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(*parts: str):  # noqa: ANN201
    """Registers a query; the last part is the oracle's SELECT, those before are its CTEs."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, (X.with_sql(*parts[:-1], recursive=True) if parts[:-1] else "") + parts[-1]
        return f

    return add


DOCS = "docs AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()


# ---- documents ----
def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ids, rows = docs(spark, sf_dir), cut(X.segments(spark, sf_dir))
    mark = lambda *x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("highlight_idx", "word", "color", "bold"))])
    marks = F.array(mark(0, "neu", "#ff00aa00", True), mark(1, "alt", "#801e6fe8", False))
    overlays = O.image_overlays(ids.withColumn("image_path", F.lit("/p/q.png")), "Logo").withColumn("overlay_idx", F.lit(0)).unionByName(O.title_overlays(ids.withColumn("text", F.lit("Hi"))).withColumn("overlay_idx", F.lit(1)))
    return {
        "settings": project.default_settings(ids).withColumn("fps", (24 + F.col("doc_id") % 3).cast("int")), "segments": rows, "speakers": O.add_speaker(O.default_speakers(ids)).where("doc_id % 4 <> 1"),
        "scenes": Q.scenes(rows).withColumn("image_path", F.concat(F.lit("s"), F.col("scene_idx").cast("string"))).withColumn("fit", F.when(F.col("scene_idx") == 7, "contain").otherwise("cover")),
        "highlights": ids.select("doc_id", F.explode(marks).alias("m")).select("doc_id", "m.*"), "overlays": O.edit(overlays, F.lit(True), start_s=F.lit(2), end_s=F.lit(9)),
    }


@query(*Q.SEGS, Q.SCENES, DOCS, "good AS (SELECT doc_id FROM docs WHERE doc_id % 7 <> 0)", """SELECT doc_id, 'settings' AS part, 0 AS idx, CASE WHEN doc_id % 7 = 0 THEN 'libx264 30 1920' ELSE 'libx264 ' || (24 + doc_id % 3) || ' 1920' END AS what, 0::BIGINT AS start_ms, 140::BIGINT AS end_ms, 0.78::DOUBLE AS x FROM docs
UNION ALL SELECT doc_id, 'errors', 0, 'not a project document', 0, 0, 0 FROM docs WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id, 'speakers', i, 'Speaker ' || (i + 1) || CASE i WHEN 0 THEN ' #ff7cb342' ELSE ' #ffe8c11c' END, 0, 0, CASE i WHEN 0 THEN 0.47 WHEN 1 THEN 0.53 ELSE 0.59 END FROM docs, range(3) AS r(i) WHERE i < 2 OR (doc_id % 7 <> 0 AND doc_id % 4 <> 1)
UNION ALL SELECT doc_id, 'scenes', row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, scene_idx) - 1, 's' || scene_idx || CASE scene_idx WHEN 7 THEN ' contain' ELSE ' cover' END, start_ms, end_ms, 0 FROM scenes WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 'highlights', i, CASE i WHEN 0 THEN 'neu #ff00aa00' ELSE 'alt #801e6fe8' END, 0, 0, 1 - i FROM good, range(2) AS r(i)
UNION ALL SELECT doc_id, 'overlays', i, CASE i WHEN 0 THEN 'Logo true #ffcbe86b' ELSE 'Title false #ff8e1c22' END, 2000, 9000, CASE i WHEN 0 THEN 0.02 ELSE 0 END FROM good, range(2) AS r(i)
UNION ALL SELECT doc_id, 'segments', seg_idx, text || ' ' || speaker_id, start_ms, end_ms, 0 FROM segs WHERE doc_id % 7 <> 0""")
def project_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read; of every seventh document the text is cut off."""
    texts = project.encode(_tables(spark, sf_dir)).withColumn("project", F.when(F.col("doc_id") % 7 == 0, F.lit('{"version":1,')).otherwise(F.col("project")))
    t = project.decode(cut(texts))
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    row = lambda part, idx, what, start=zero, end=zero, x=none: t[part].select("doc_id", F.lit(part).alias("part"), (F.col(idx).cast("bigint") if idx else zero).alias("idx"), F.concat_ws(" ", *what).alias("what"), F.lit(start).cast("bigint").alias("start_ms"), F.lit(end).cast("bigint").alias("end_ms"), x.cast("double").alias("x"))
    c = F.col
    rows = [
        row("settings", None, ["export.video_codec", c("fps").cast("string"), c("canvas_width").cast("string")], c("duration_ms"), c("transition_ms"), F.round("translation_style.box.y", 6)), row("errors", None, ["error"]),
        row("speakers", "speaker_id", ["name", "tint"], x=F.round("style.box.y", 6)), row("scenes", "scene_idx", ["image_path", "fit"], c("start_ms"), c("end_ms")), row("highlights", "highlight_idx", ["word", "color"], x=c("bold").cast("int")),
        row("overlays", "overlay_idx", ["name", c("is_image").cast("string"), "style.box_color"], c("start_ms"), c("end_ms"), F.round("style.box.x", 6)), row("segments", "seg_idx", ["text", c("speaker_id").cast("string")], c("start_ms"), c("end_ms")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(X.CUES_SQL, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE count(*) FILTER (WHERE text <> '') END::BIGINT AS n_cues, CASE WHEN doc_id % 10 = 5 THEN 'cannot open it' WHEN doc_id % 5 = 0 OR count(*) FILTER (WHERE text <> '') = 0 THEN 'no cues found' ELSE '' END AS error FROM cues GROUP BY doc_id")
def subtitle_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = subtitles.render(X.cues(spark, sf_dir)).withColumn("content", F.when(F.col("doc_id") % 10 == 0, "nothing").when(F.col("doc_id") % 5 != 0, F.col("content")))
    return subtitles.results(files.withColumn("error", F.when(F.col("doc_id") % 10 == 5, "cannot open it")), "doc_id")


def _wav(k: np.ndarray, width: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(16_000)
        both = np.repeat(k.astype(np.int64), 2)
        w.writeframes((both + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(x << 8 * (width - 1)).to_bytes(width, "little", signed=True) for x in both))
    return out.getvalue()


@query("SELECT (r_regionkey % 4 + 1)::INTEGER AS width, i AS at, ((i * 37 + r_regionkey) % 200 - 100) / 128.0::DOUBLE AS v, (50 * 1000 // 16000)::BIGINT AS duration_ms FROM region, range(50) AS r(i) WHERE r_regionkey < 4")
def wav_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each sample width, decoded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key in part["r_regionkey"]:
                x = audio.decode_wav(_wav((np.arange(50) * 37 + key) % 200 - 100, key + 1))
                yield pd.DataFrame({"width": int(key + 1), "at": np.arange(len(x)), "v": x.astype(float), "n": len(x)})

    rows = X.table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").cast("int")).mapInPandas(run, "width int, at bigint, v double, n bigint")
    return rows.select("width", "at", "v", audio.duration_ms(F.col("n"), F.lit(16_000)).cast("bigint").alias("duration_ms"))


# ---- small functions ----
@query(*Q.SEGS, "SELECT doc_id, seg_idx, end_ms - start_ms AS length, start_ms <= 30000 AND 30000 < end_ms AS held, seg_idx % 2 = 0 AND start_ms >= 5000 AND (seg_idx % 4 = 0 OR start_ms < 40000) AS shown FROM segs")
def interval_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms, at = F.lit(30_000), F.col("start_ms")
    shown = M.overlay_visible(at, F.expr("seg_idx % 2 = 0"), F.lit(5000), F.expr("if(seg_idx % 4 = 0, 0, 40000)"))
    return X.segments(spark, sf_dir).select("doc_id", "seg_idx", M.duration(at, F.col("end_ms")).alias("length"), M.contains(ms, at, F.col("end_ms")).alias("held"), shown.alias("shown"))


_SPECS = "CASE p_partkey % 9 WHEN 0 THEN 'w=#00FF00:bold' WHEN 1 THEN 'w=red' WHEN 2 THEN 'bad' WHEN 3 THEN '=red' WHEN 4 THEN 'a b=Navy:BOLD' WHEN 5 THEN 'w=nocolor' WHEN 6 THEN 'w=#1af' WHEN 7 THEN 'w=red=blue' ELSE 'w=#80112233' END"


@query("SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'w' WHEN 1 THEN 'w' WHEN 4 THEN 'a b' WHEN 6 THEN 'w' WHEN 8 THEN 'w' END AS word, CASE p_partkey % 9 WHEN 0 THEN '#ff00ff00' WHEN 1 THEN '#ffff0000' WHEN 4 THEN '#ff000080' WHEN 6 THEN '#ff11aaff' WHEN 8 THEN '#80112233' ELSE '#ff000000' END AS argb, CASE p_partkey % 9 WHEN 0 THEN true WHEN 4 THEN true WHEN 1 THEN false WHEN 6 THEN false WHEN 8 THEN false END AS bold FROM part")
def highlight_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.table(spark, sf_dir, "part").select("p_partkey", T.highlight_spec(F.expr(_SPECS)).alias("s"))
    return rows.select("p_partkey", "s.word", T.color(F.col("s.color"), "#ff000000").alias("argb"), "s.bold")


@query("names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in T.LANGUAGES.items()) + ") AS v(k, name))", "SELECT n_nationkey, coalesce(name, n_name) AS language FROM nation LEFT JOIN names ON k = lower(n_name[1:2])")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "nation").select("n_nationkey", T.language_name(F.col("n_name")).alias("language"))


@query("SELECT n_nationkey, r_name AS id FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN 0 ELSE n_regionkey END AS k FROM nation) JOIN region ON r_regionkey = k")
def provider_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = X.table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("key"))
    nations = X.table(spark, sf_dir, "nation").join(known.select(F.col("key").alias("n_regionkey"), F.lower("id").alias("own")), "n_regionkey")
    first = known.where("key = 0").select("id").first().id
    rows = nations.select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 3, "other").otherwise(F.col("own")).alias("provider_id"))
    return O.provider(rows, known, first.upper()).select("n_nationkey", "id")


@query("SELECT p_partkey, round(1127.0 * ln(1 + p_partkey / 700.0::DOUBLE), 6) AS mel, pow(2, ceil(log2(greatest(p_partkey, 1))))::BIGINT AS up, greatest(p_partkey - p_partkey % 2, 2)::BIGINT AS side, CASE WHEN p_partkey < 100 THEN NULL ELSE round(p_partkey * 0.01, 6)::DOUBLE END AS w, round(0.5 * (1 - (p_partkey % 100) / 100.0::DOUBLE), 6) AS lift, round((p_partkey % 9) * 0.062 * 1.12 + 2 * 0.016, 6)::DOUBLE AS height, floor(least(greatest((p_partkey - 50) / greatest(p_partkey % 300, 1)::DOUBLE, 0.0), 1.0) * 7777)::BIGINT AS at, round(p_partkey * (p_partkey % 300) / 7777.0::DOUBLE, 6) AS x FROM part")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("bigint")
    box = F.struct(F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), (k * 0.01 / 1000).alias("w"), F.lit(0.5).alias("h"))
    return X.table(spark, sf_dir, "part").select(
        "p_partkey", F.round(T.mel(k), 6).alias("mel"), T.next_power_of_two(k).cast("bigint").alias("up"), M.even(k).cast("bigint").alias("side"), F.round(M.pixel_rect(box, 1000, 100)["w"], 6).alias("w"),
        F.round(M.rise((k % 100) / 100.0, F.lit(0.5)), 6).alias("lift"), F.round(V.box_height(k % 9, 0.062, 1.12, 0.016), 6).alias("height"), M.x_to_time(k - 50, k % 300, F.lit(7777)).alias("at"), F.round(M.time_to_x(k, k % 300, F.lit(7777)), 6).alias("x"),
    )


@query("SELECT vec_id, round(embedding[1] / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 1e-12), 4) AS first FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    thrice = F.transform("embedding", lambda x: (x * 3).cast("float"))
    return X.table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(E.unit(thrice), F.lit(0)).cast("double"), 4).alias("first"))


@query("g AS (SELECT *, vec_id // 100 AS grp, vec_id * 7 % 5 AS k FROM embeddings)", "f AS (SELECT grp, k, min(vec_id) AS first FROM g GROUP BY ALL)", "SELECT grp, vec_id, (dense_rank() OVER (PARTITION BY grp ORDER BY first) - 1)::INTEGER AS cluster FROM g JOIN f USING (grp, k)")
def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in five directions, a little apart: clusters are the directions, numbered by their first vector."""
    k = F.col("vec_id") * 7 % 5
    v = F.array(*[F.when(k == i, 1.0).otherwise(0.0) + (F.col("vec_id") % 13) * 0.001 for i in range(5)]).cast("array<float>")
    rows = X.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 100").alias("grp"), "vec_id", E.unit(v).alias("embedding"))
    return E.clusters(rows, "grp", target=5)


# ---- scenes, boxes, parts ----
@query(DOCS, "SELECT doc_id, i::INTEGER AS scene_idx, 'p' || i AS image_path, (doc_id % 3 * 1000 + 3000 * i)::BIGINT AS start_ms, least(doc_id % 3 * 1000 + 3000 * i + 3000, 10000)::BIGINT AS end_ms FROM docs, range(6) AS r(i) WHERE doc_id % 3 * 1000 + 3000 * i <= 10000")
def dropped_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("paths", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("p"), i.cast("string"))))
    parts = [L.drop_scenes(rows.where(f"doc_id % 3 = {k}"), 1000 * k, 10_000) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "scene_idx", "image_path", "start_ms", "end_ms")


@query(*Q.SEGS, Q.SCENES, """moved AS (SELECT doc_id, scene_idx, CASE scene_idx WHEN 1 THEN least(5000, end_ms - 200) WHEN 3 THEN greatest(least(9000, 60000 - (end_ms - start_ms)), 0) WHEN 4 THEN 0 ELSE start_ms END AS start_ms,
  CASE scene_idx WHEN 2 THEN least(greatest(7000, start_ms + 200), 60000) WHEN 3 THEN greatest(least(9000, 60000 - (end_ms - start_ms)), 0) + end_ms - start_ms WHEN 4 THEN 60000 ELSE end_ms END AS end_ms FROM scenes WHERE scene_idx <> 5)""", "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY scene_idx) - 1)::INTEGER AS scene_idx, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms FROM moved")
def moved_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at = Q.scenes(X.segments(spark, sf_dir)), lambda k: F.col("scene_idx") == k
    rows = L.move_edge(L.move_edge(L.move_edge(rows, "start", at(1), 5000, 60_000), "end", at(2), 7000, 60_000), "both", at(3), 9000, 60_000)
    return L.without_rows(L.stretch(rows, at(4), 60_000), at(5)).select("doc_id", "scene_idx", "start_ms", "end_ms")


@query(DOCS, "b AS (SELECT doc_id, (doc_id % 30 - 15) / 10.0::DOUBLE AS x, (doc_id % 20 - 5) / 10.0::DOUBLE AS y, (doc_id % 9 + 1) / 20.0::DOUBLE AS w, 0.3::DOUBLE AS h FROM docs)",
       "r AS (SELECT doc_id, x + least(0.1, w - 0.02) AS rx, y AS ry, greatest(w - least(0.1, w - 0.02) - 0.05, 0.02) AS rw, h AS rh, * EXCLUDE (doc_id) FROM b)",
       "SELECT doc_id, round(least(greatest(x, 0.05 - w), 0.95), 6) AS x, round(least(greatest(y, 0.05 - h), 0.95), 6) AS y, round(least(greatest(rx, 0.05 - rw), 0.95), 6) AS rx, round(rw, 6) AS rw FROM r")
def dragged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = docs(spark, sf_dir).select("doc_id", F.struct(((k % 30 - 15) / 10.0).alias("x"), ((k % 20 - 5) / 10.0).alias("y"), ((k % 9 + 1) / 20.0).alias("w"), F.lit(0.3).alias("h")).alias("b"))
    rows = rows.select("doc_id", L.clamp_box(F.col("b")).alias("c"), L.resize_box(F.col("b"), left=0.1, right=-0.05).alias("r"))
    return rows.select("doc_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.round("r.x", 6).alias("rx"), F.round("r.w", 6).alias("rw"))


@query(DOCS, "n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM docs)", "m AS (SELECT doc_id, CASE i WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE i END AS i FROM n)", "SELECT (row_number() OVER (ORDER BY i) - 1)::BIGINT AS part_idx, 'p' || doc_id AS path FROM m WHERE i % 3 <> 0")
def edited_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.without_parts(docs(spark, sf_dir).select(F.col("doc_id").alias("part_idx"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")), F.lit(False))
    return O.without_parts(O.move_part(rows, 1, 1), F.col("part_idx") % 3 == 0)


_PRESETS = "(VALUES (0, 'Logo', 0.02, 0.86, 0.20, 0.12, 0.03, 0.88, 0.28, 0.09), (1, 'Subscribe', 0.66, 0.88, 0.32, 0.08, 0.55, 0.89, 0.42, 0.06), (2, 'Title', 0.0, 0.0, 1.0, 0.085, 0.0, 0.0, 1.0, 0.06), (3, 'pic', 0.35, 0.40, 0.30, 0.20, 0.35, 0.40, 0.30, 0.20)) AS v(i, name, x, y, w, h, tx, ty, tw, th)"


@query(DOCS, f"""SELECT doc_id, name, (CASE WHEN doc_id % 2 = 0 THEN x ELSE tx END)::DOUBLE AS x, (CASE WHEN doc_id % 2 = 0 THEN y ELSE ty END)::DOUBLE AS y, (CASE WHEN doc_id % 2 = 0 THEN w ELSE tw END)::DOUBLE AS w, (CASE WHEN doc_id % 2 = 0 THEN h ELSE th END)::DOUBLE AS h,
  i <> 2 AS is_image, CASE WHEN i = 2 THEN 'T' || doc_id ELSE '' END AS text, CASE WHEN i = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS opacity, i = 0 AS on_top, CASE WHEN i = 1 THEN 0 ELSE 3000 END::BIGINT AS start_ms, CASE WHEN i = 1 THEN 0 ELSE 8000 END::BIGINT AS end_ms FROM docs, {_PRESETS}""")
def overlay_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets on wide and upright canvases, edited."""
    parts = []
    for upright in (False, True):
        ids = docs(spark, sf_dir).where(f"doc_id % 2 = {int(upright)}")
        path = ids.withColumn("image_path", F.lit("/a/b/pic.png"))
        parts += [O.image_overlays(path, "Logo", upright), O.image_overlays(path, "Subscribe", upright), O.title_overlays(ids.withColumn("text", F.concat(F.lit(" T"), F.col("doc_id").cast("string"))), upright), O.image_overlays(path, upright=upright)]
    rows = parts[0]
    for r in parts[1:]:
        rows = rows.unionByName(r)
    rows = O.edit(rows, F.lit(True), start_s=F.lit(3), end_s=F.lit(8), opacity=F.lit(0.25))
    rows = O.whole_video(O.edit(rows, F.col("name") == "Logo", opacity=F.lit(1.5), on_top=F.lit(True)), F.col("name") == "Subscribe")
    return rows.select("doc_id", "name", "style.box.x", "style.box.y", "style.box.w", "style.box.h", "is_image", "text", "opacity", "on_top", "start_ms", "end_ms")


@query(DOCS, "SELECT doc_id, (CASE WHEN doc_id % 2 = 1 THEN 0.71 ELSE 0.78 END)::DOUBLE AS y, (CASE WHEN doc_id % 2 = 1 THEN 0.05 ELSE 0.06 END)::DOUBLE AS x, 0.042::DOUBLE AS font_size, 1920 AS canvas_width, 'medium' AS preset, CASE WHEN doc_id % 3 = 0 THEN 'Speaker 1' ELSE 'Speaker 3' END AS last, round(CASE WHEN doc_id % 3 = 0 THEN 0.53 ELSE 0.59 END, 6)::DOUBLE AS last_y FROM docs")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and speakers of new documents, a third of which had no speakers left."""
    ids = docs(spark, sf_dir)
    s = O.translation_layout(project.default_settings(ids), F.col("doc_id") % 2 == 1)
    last = O.add_speaker(O.default_speakers(ids).where("doc_id % 3 <> 0"), ids).groupBy("doc_id").agg(F.max_by(F.struct("name", "style"), "speaker_id").alias("l"))
    return s.join(last, "doc_id").select("doc_id", "translation_style.box.y", "translation_style.box.x", "translation_style.font_size", "canvas_width", "export.preset", F.col("l.name").alias("last"), F.round("l.style.box.y", 6).alias("last_y"))


@query(DOCS, "v AS (SELECT doc_id, (doc_id % 40 - 20) / 10.0::DOUBLE AS x, (doc_id % 50) / 100.0::DOUBLE AS s, doc_id % 1000 AS wt, (doc_id % 30) / 10.0::DOUBLE AS ls FROM docs)",
       "SELECT doc_id, concat_ws(',', CASE WHEN x NOT BETWEEN -1 AND 2 THEN 'box.x' END, CASE WHEN s NOT BETWEEN 0.02 AND 2 THEN 'box.h' END, CASE WHEN s > 0.2 THEN 'corner_radius' END, CASE WHEN s NOT BETWEEN 0.005 AND 0.4 THEN 'font_size' END, CASE WHEN wt NOT BETWEEN 100 AND 900 THEN 'font_weight' END, CASE WHEN ls NOT BETWEEN 0.7 AND 2.5 THEN 'line_spacing' END, CASE WHEN s > 0.05 THEN 'shadow_offset' END, CASE WHEN s > 0.03 THEN 'outline_width' END) AS problems FROM v")
def style_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    size = (k % 50) / 100.0
    box = F.struct(((k % 40 - 20) / 10.0).alias("x"), F.lit(0.5).alias("y"), F.lit(0.5).alias("w"), size.alias("h"))
    own = O.style(box=box, corner_radius=size, font_size=size, font_weight=k % 1000, line_spacing=(k % 30) / 10.0, shadow_offset=size, outline_width=size)
    return O.style_problems(docs(spark, sf_dir).select("doc_id", own.alias("style"))).select("doc_id", F.concat_ws(",", "problems").alias("problems"))


@query(DOCS, "SELECT doc_id, word, color FROM docs, (VALUES ('alt', '#ff000000'), ('neu', '#ff1e6fe8')) AS v(word, color)")
def ensured_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = docs(spark, sf_dir)
    have = ids.select("doc_id", F.lit("alt").alias("word"), F.lit("#ff000000").alias("color"), F.lit(True).alias("bold"))
    return O.ensure_highlight(have, ids.select("doc_id", F.explode(F.array(*map(F.lit, ("(Neu)", "Alt!", "--", "neu")))).alias("word"))).select("doc_id", "word", "color")


@query(*Q.SEGS, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE greatest(max(end_ms), 700) END::BIGINT AS duration_ms, CASE WHEN doc_id % 8 = 1 THEN 'the canvas is too small' WHEN doc_id % 3 = 0 THEN 'there is nothing to render' ELSE '' END AS error FROM segs GROUP BY doc_id")
def export_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ids = X.segments(spark, sf_dir).where("doc_id % 3 <> 0"), docs(spark, sf_dir)
    scenes = ids.where("doc_id % 3 <> 0").select("doc_id", F.lit(700).cast("bigint").alias("end_ms"))
    found = [L.export_duration(*[t.where(f"doc_id % 8 {'=' if small else '<>'} 1") for t in (rows, scenes, ids.withColumn("audio_ms", F.lit(0).cast("bigint")))], width=1 if small else 2) for small in (False, True)]
    return found[0].unionByName(found[1])


# ---- speakers and translations ----
LROWS = (X.LANGUAGE_ROWS_SQL, "scored_input AS (SELECT * FROM lrows)", X.SCORES_SQL)


@query(*LROWS, "SELECT doc_id, count(DISTINCT score >= 0) AS speakers, count(*) AS segments, count(*) FILTER (WHERE abs(score) < 0.34) AS reviews, true AS assigned FROM scores GROUP BY doc_id")
def speaker_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.text_only(X.language_rows(spark, sf_dir))
    return P.report(rows).join(O.any_assigned(rows), "doc_id")


@query(*LROWS, "SELECT doc_id, 'text only' AS backend, 'no model of voices runs here' AS warning, 0::BIGINT AS windows, 2::BIGINT AS speakers, 0::BIGINT AS splits, count(*) FILTER (WHERE abs(score) < 0.34) AS reviews FROM scores GROUP BY doc_id")
def diarize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models fail, so language decides."""

    def broken():  # noqa: ANN202
        raise OSError("no such device")

    rows = X.language_rows(spark, sf_dir)
    return P.diarize(rows, rows.select("doc_id", F.col("seg_idx").alias("word_idx"), "start_ms", "end_ms", "text"), Q.samples(spark), [("first", broken), ("second", broken)])[1]


@query(*Q.SEGS, """o AS (SELECT doc_id, CASE WHEN seg_idx % 3 = 0 THEN 'skipped' WHEN length(text) <= 150 THEN 'translated' ELSE 'failed' END AS o FROM segs)""",
       "c AS (SELECT doc_id, count(*) FILTER (WHERE o <> 'skipped') AS pending, count(*) FILTER (WHERE o = 'translated') AS translated, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed FROM o GROUP BY doc_id)",
       f"SELECT *, CASE WHEN pending = 0 THEN '{R.NONE_LEFT}' WHEN failed > 0 AND translated > 0 THEN '{R.FAILED}' ELSE '' END AS warning, CASE WHEN failed > 0 AND translated = 0 THEN 'no line could be translated' ELSE '' END AS error FROM c")
def translation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.segments(spark, sf_dir).withColumn("translation", F.expr("if(seg_idx % 3 = 0, 'done', '')"))
    return R.translation_report(R.translated(rows, Q.offline))


def _service(request: str) -> str:
    """A stand-in for a model: it answers with an object among other words, or, asked for long lines, with too few strings."""
    import json

    lines = json.loads(request)
    return "Sure:\n```json\n" + json.dumps({"translations": [f" <{x}> " for x in lines if len(x) <= 150]}) + "\n```"


@query(*Q.SEGS, "SELECT doc_id, seg_idx, CASE WHEN length(text) <= 150 THEN '<' || text || '>' ELSE '' END AS translation FROM segs")
def translate_by_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.translate(X.segments(spark, sf_dir), R.batch_call(_service)).select("doc_id", "seg_idx", "translation")


@query("SELECT conv_id AS doc_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE trim(text, ' ') || '|b' END AS lines FROM conversations")
def reply_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair, k = F.array(F.col("text"), F.lit(" b ")), F.col("turn") % 4
    whole = F.to_json(F.struct(pair.alias("translations")))
    reply = F.when(k == 0, F.to_json(pair)).when(k == 1, whole).when(k == 2, F.concat(F.lit("```\n"), whole, F.lit("\n```"))).otherwise(F.to_json(F.array(F.col("text"))))
    rows = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", R.parse_reply(reply, F.lit(2)).alias("l"))
    return rows.select("doc_id", "turn", F.when(F.col("l").isNotNull(), F.array_join("l", "|")).alias("lines"))


@query("""SELECT conv_id AS doc_id, turn, 'Translate these 2 subtitle lines to ' || CASE WHEN turn % 2 = 0 THEN 'German' ELSE 'xx' END || '. Answer with a JSON object {"translations": [...]} of 2 strings in order.' || chr(10) || to_json([length(text)::VARCHAR, role])::VARCHAR AS prompt FROM conversations""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.length("text").cast("string"), F.col("role"))
    return X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", O.prompt(lines, F.when(F.col("turn") % 2 == 0, "de-AT").otherwise("xx")).alias("prompt"))
