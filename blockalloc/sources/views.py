"""Input tables of the jobs, derived from the given tables, and the same views as SQL.

Videos are tables here: frames hold their pixels as one array a row, so that pixels are
never exploded; run metrics, manifests and file lists are plain rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.operators.numbering import numbered
from blockalloc.session import table


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with the number ``n`` of each row in the order of its label's ids: ids are numbered over range partitions, payloads follow by a join."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    place = numbered(e.select(F.col("label").alias("_label"), F.col("vec_id").alias("_id")), ["_label"], ["_id"], "n")
    same = e["vec_id"].eqNullSafe(place["_id"]) & e["label"].eqNullSafe(place["_label"])
    return e.join(place, same).select("label", "vec_id", "embedding", F.col("n").cast("int").alias("n"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, height, width, v): one row a frame, ``v`` its 64 values 0..255 in row order.

    Frames are numbered inside a video by ``placed``.
    """
    rows = placed(spark, sf_dir).withColumn("frame_idx", F.col("n").cast("int"))
    v = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(128 + 256 * x.cast("double")))).cast("int"))
    return rows.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), v.alias("v"))


def stored_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_idx, height, width, fps, rgb): frames as bytes, three a pixel in row order; some videos tell no usable rate."""
    f = frames(spark, sf_dir)
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    rgb = F.unhex(F.array_join(F.transform("v", lambda v: F.concat(two(v), two(v * 3 % 256), two(v * 7 % 256))), ""))
    kind = F.substring("video_id", 2, 9).cast("int") % 4
    fps = F.when(kind == 0, 29.97).when(kind == 1, 0.0).when(kind == 2, float("nan"))
    return f.select("video_id", "frame_idx", "height", "width", fps.alias("fps"), rgb.alias("rgb"))


def pixels(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, y, x, v): frames pixel by pixel, for per-pixel projections on small inputs."""
    p = frames.select("video_id", "frame_idx", "width", F.posexplode("v").alias("pos", "v"))
    return p.select("video_id", "frame_idx", F.expr("cast(pos div width as int)").alias("y"), (F.col("pos") % F.col("width")).alias("x"), "v")


def rgb(v: str | Column = "v") -> tuple[Column, Column, Column]:
    v = F.col(v) if isinstance(v, str) else v
    return v, v * 3 % 256, v * 7 % 256


PIXELS_SQL = """
f AS (SELECT 'v' || CAST(label AS VARCHAR) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_idx, embedding FROM embeddings),
pixels AS (
  SELECT video_id, frame_idx, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x,
         CAST(least(255, greatest(0, round(128 + 256 * CAST(val AS DOUBLE)))) AS INTEGER) AS v
  FROM (SELECT video_id, frame_idx, unnest(range(64)) AS pos, unnest(embedding) AS val FROM f))
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, policy, seed, top_k, cover, raw_errshare, inc_errshare): run metrics from ``lineitem``."""
    x = table(spark, sf_dir, "lineitem")
    keys = [
        F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("video_id"),
        F.concat("l_returnflag", "l_linestatus").alias("policy"),
        F.col("l_linenumber").cast("int").alias("seed"),
        (10 * (1 + F.col("l_partkey") % 4)).cast("int").alias("top_k"),
    ]
    # whole hundredths are added, so that no order of addition shows
    return x.groupBy(*keys).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100).alias("cover"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count("*") / 100).alias("raw_errshare"),
        (F.sum(F.round(F.col("l_quantity") * 100).cast("long")) / F.count("*") / 5000).alias("inc_errshare"),
    )


RUNS_SQL = """
runs AS (
  SELECT 'v' || CAST(l_suppkey AS VARCHAR) AS video_id, l_returnflag || l_linestatus AS policy, CAST(l_linenumber AS INTEGER) AS seed,
         CAST(10 * (1 + l_partkey % 4) AS INTEGER) AS top_k,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS cover,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS raw_errshare,
         CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / count(*) / 5000 AS inc_errshare
  FROM lineitem GROUP BY ALL)
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, class, path, frames) from ``part``."""
    p = table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*map(F.lit, ("avi", "MP4", "mov", "mkv", "txt"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    stem = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    name = F.regexp_replace("p_brand", "#", "_")
    return p.select(F.concat_ws("_", name, stem).alias("video_id"), name.alias("class"), F.concat(F.lit("data/"), name, F.lit("/"), stem, F.lit("."), suffix).alias("path"), (50 + F.col("p_size") * 7).cast("int").alias("frames"))


MANIFEST_SQL = """
manifest AS (
  SELECT replace(p_brand, '#', '_') || '_p' || CAST(p_partkey AS VARCHAR) AS video_id, replace(p_brand, '#', '_') AS class,
         'data/' || replace(p_brand, '#', '_') || '/p' || CAST(p_partkey AS VARCHAR) || '.' || ['avi','MP4','mov','mkv','txt'][p_partkey % 5 + 1] AS path,
         CAST(50 + p_size * 7 AS INTEGER) AS frames
  FROM part)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, doc_id) from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "doc_id")


FILES_SQL = """
files AS (SELECT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS content, doc_id FROM documents)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, clip_idx, flow_idx, b, dx, dy): mean flow of each block of a 4 x 4 grid over 8 x 8 images, 15 flows a clip."""
    e = placed(spark, sf_dir)
    at = lambda i: 16 * F.get("embedding", i).cast("double") + 16 * F.get("embedding", i + 32).cast("double")  # noqa: E731  all 64 numbers
    blocks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.struct(b.alias("b"), at(2 * b).alias("dx"), at(2 * b + 1).alias("dy")))
    return e.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), F.expr("cast(n div 15 as int)").alias("clip_idx"), (F.col("n") % 15).alias("flow_idx"), F.inline(blocks))


FLOWS_SQL = """
fl AS (SELECT 'v' || CAST(label AS VARCHAR) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS n, embedding FROM embeddings),
flows AS (SELECT video_id, CAST(n // 15 AS INTEGER) AS clip_idx, CAST(n % 15 AS INTEGER) AS flow_idx, CAST(b AS INTEGER) AS b,
                 16 * CAST(embedding[2 * b + 1] AS DOUBLE) + 16 * CAST(embedding[2 * b + 33] AS DOUBLE) AS dx, 16 * CAST(embedding[2 * b + 2] AS DOUBLE) + 16 * CAST(embedding[2 * b + 34] AS DOUBLE) AS dy
          FROM fl, (SELECT unnest(range(16)) AS b))
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, clip_idx, u, py, px, vec): 2 x 2 patch tokens of 64 numbers, 8 segments a clip."""
    e = placed(spark, sf_dir)
    return e.select(
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"),
        F.expr("cast(n div 32 as int)").alias("clip_idx"),
        F.expr("cast(n % 32 div 4 as int)").alias("u"),
        F.expr("cast(n % 4 div 2 as int)").alias("py"),
        (F.col("n") % 2).alias("px"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


TOKENS_SQL = """
tk AS (SELECT 'v' || CAST(label AS VARCHAR) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS n, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
tokens AS (SELECT video_id, CAST(n // 32 AS INTEGER) AS clip_idx, CAST(n % 32 // 4 AS INTEGER) AS u, CAST(n % 4 // 2 AS INTEGER) AS py, CAST(n % 2 AS INTEGER) AS px, vec FROM tk)
"""
