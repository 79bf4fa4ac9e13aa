"""Sources and sinks, digests, completeness, and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

VIDEO_SUFFIXES = ("avi", "mp4", "mov", "mkv")


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A headed CSV file with an explicit schema; a missing path gives no rows."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return spark.createDataFrame([], schema)
        raise


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Header and rows in the given column order."""
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Released frames by run: partitions video, seed, budget and policy."""
    frames.repartition("video_id", "seed", "top_k", "policy").write.mode("append").partitionBy("video_id", "seed", "top_k", "policy").parquet(path)


def report_json(**parts: Column) -> Column:
    """A nested report as JSON text."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))


def unfinished(planned: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned runs whose output does not exist yet."""
    return planned.join(finished.select(*keys), list(keys), "left_anti")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def checksum_list(files: DataFrame) -> DataFrame:
    """(digest, path) in order of path; contents are dropped before the sort."""
    return files.select(digest(F.col("content")).alias("digest"), "path").orderBy("path")


def verify_checksums(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): ok, mismatch or missing, for each listed file."""
    now = files.select("path", digest(F.col("content")).alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("digest"), "ok").otherwise("mismatch")
    return listed.join(now, "path", "left").select("path", status.alias("status"))


def unresolved(manifest: DataFrame, columns: Sequence[str], assets: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, reference, path) for references that no asset resolves."""
    refs = manifest.unpivot([key], list(columns), "reference", "path")
    return refs.join(assets.select("path"), "path", "left_anti").select(key, "reference", "path")


def reconcile(**counts: DataFrame) -> DataFrame:
    """Frame counts of several sources side by side, with a status: ok, mismatch, or the sources that miss a video.

    Each source is (video_id, n); sources are stacked and aggregated once, not joined.
    """
    stacked = None
    for name, c in counts.items():
        part = c.select("video_id", F.lit(name).alias("source"), F.col("n").cast("long").alias("n"))
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy("video_id").agg(*(F.max(F.when(F.col("source") == s, F.col("n"))).alias(s) for s in counts))
    gaps = F.array_compact(F.array(*(F.when(F.col(s).isNull(), F.lit(s)) for s in counts)))
    same = F.greatest(*counts) == F.least(*counts) if len(counts) > 1 else F.lit(True)
    return wide.withColumn("status", F.when(F.size(gaps) > 0, F.concat(F.lit("missing: "), F.array_join(gaps, ","))).when(same, "ok").otherwise("mismatch"))


def missing_runs(runs: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid points without a run."""
    return grid.join(runs.select(*keys).distinct(), list(keys), "left_anti")


def completeness(runs: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: expected, found, missing, unexpected and duplicate runs, and COMPLETE or INCOMPLETE."""
    e = grid.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f"))
    f = runs.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f"))
    both = e.union(f).groupBy(*keys).agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    s = both.agg(*(F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in (("expected", F.col("e") > 0), ("found", (F.col("e") > 0) & (F.col("f") > 0)), ("missing", (F.col("e") > 0) & (F.col("f") == 0)), ("unexpected", F.col("e") == 0), ("duplicates", F.col("f") > 1))))
    good = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("duplicates") == 0)
    return s.withColumn("status", F.when(good, "COMPLETE").otherwise("INCOMPLETE"))


def split_failures(units: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Valid units, and (video_id, error) of the others; one bad unit stops nothing."""
    rows = units.withColumn("error", error)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("video_id", "error")


def seed_sensitivity(scores: DataFrame) -> DataFrame:
    """(video_id, policy, seeds, digests, kind): whether a policy's maps differ for every seed (random), for none (deterministic) or for some.

    A frame's scores are digested first, then the frames' digests in order.
    """
    frame = scores.groupBy("video_id", "policy", "seed", "frame_idx").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bi", "bj", "score"))), lambda s: s["score"].cast("string")), ","), 256).alias("d"))
    run = frame.groupBy("video_id", "policy", "seed").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "d"))), lambda s: s["d"]), ","), 256).alias("d"))
    s = run.groupBy("video_id", "policy").agg(F.count("*").alias("seeds"), F.count_distinct("d").alias("digests"))
    return s.withColumn("kind", F.when(F.col("digests") == F.col("seeds"), "random").when(F.col("digests") == 1, "deterministic").otherwise("mixed"))


def forbidden(paths: DataFrame, parts: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Paths with a forbidden part or suffix."""
    part = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, parts)))
    return paths.where(part | F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))


def asset_manifest(scores: DataFrame) -> DataFrame:
    """(video_id, policy, seed, frames, block_grid, cells, total, digest) of each score map.

    The digest is a SHA-256 over the digests of the frames in order; a frame's is over its
    cells' scores in row order, as whole millionths.
    """
    run = ("video_id", "policy", "seed")
    cells = F.array_sort(F.collect_list(F.struct("bi", "bj", F.round(F.col("score") * 1e6).cast("long").alias("s"))))
    frame = scores.groupBy(*run, "frame_idx").agg(F.max("bi").alias("bi"), F.count("*").alias("n"), F.sum("score").alias("total"), F.sha2(F.array_join(F.transform(cells, lambda c: c["s"].cast("string")), ","), 256).alias("d"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "d"))), lambda s: s["d"])
    return frame.groupBy(*run).agg((F.max("frame_idx") + 1).alias("frames"), (F.max("bi") + 1).alias("block_grid"), F.sum("n").alias("cells"), F.round(F.sum("total"), 6).alias("total"), F.sha2(F.array_join(digests, ","), 256).alias("digest"))


def with_path_parts(paths: DataFrame) -> DataFrame:
    """Suffix in lower case, class (the folder), stem and video id; other suffixes go."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    folder, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    rows = paths.withColumns({"suffix": suffix, "class": folder, "stem": stem}).where(F.col("suffix").isin(*VIDEO_SUFFIXES))
    return rows.withColumn("video_id", F.concat_ws("_", "class", "stem"))


def balanced_subset(videos: DataFrame, classes: int, per_class: int) -> DataFrame:
    """The first ``per_class`` videos by path of the first ``classes`` classes that have as many.

    Class sizes are aggregated first and classes ranked among themselves, so only
    surviving classes are windowed. An error where fewer than ``classes`` qualify.
    """
    sizes = videos.groupBy("class").count().where(F.col("count") >= per_class).select("class")
    kept = sizes.orderBy("class").limit(classes)
    if (found := kept.count()) < classes:
        raise ValueError(f"{found} classes have {per_class} videos; {classes} are asked for")
    place = F.row_number().over(Window.partitionBy("class").orderBy("path"))
    return videos.join(kept, "class").withColumn("place", place).where(F.col("place") <= per_class)


def expand_manifest(videos: DataFrame, seeds: Sequence[int], methods: Sequence[str], root: str = "out") -> DataFrame:
    """Videos x seeds x methods with an output path each."""
    rows = videos.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).select("*", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    return rows.withColumn("output_dir", F.concat_ws("/", F.lit(root), "video_id", F.concat(F.lit("seed"), F.col("seed").cast("string")), "method"))


def first_of(manifest: DataFrame, method: str, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows of one method, in manifest order."""
    return manifest.where(F.col("method") == method).orderBy(*order).limit(n)


def config_grid(spark: SparkSession) -> DataFrame:
    """(experiment, seed, top_k): ten seeds at one budget, and one seed at four budgets."""
    rows = [("E1", s, 20) for s in (*range(9), 42)] + [("E2", 42, k) for k in (10, 20, 30, 40)]
    return spark.createDataFrame(rows, "experiment string, seed int, top_k int")


def by_method(rows: DataFrame, methods: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Values of each video by method, and failures of videos that miss one."""
    wide = rows.groupBy("video_id").agg(*(F.max(F.when(F.col("method") == m, F.col(value))).alias(m) for m in methods))
    gaps = F.array_compact(F.array(*(F.when(F.col(m).isNull(), F.lit(m)) for m in methods)))
    return split_failures(wide, F.when(F.size(gaps) > 0, F.concat(F.lit("missing method: "), F.array_join(gaps, ","))))


#: Frames a second of a source that tells none.
FPS = 25.0


def frame_table(raw: DataFrame, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames as stored and failures: ((video_id, frame_idx, height, width, fps, rgb), (video_id, error)).

    ``raw`` has a frame's bytes ``rgb`` (three a pixel, row by row) and its source's ``fps``,
    which is ``FPS`` where it is null, NaN or not positive. A video of ``videos(video_id)`` without frames
    is a failure, and so is one with a frame of another number of bytes than its size asks for; the frames of failed videos are left out.
    """
    fps = F.when((F.col("fps") > 0) & ~F.isnan("fps"), F.col("fps").cast("double")).otherwise(FPS)
    rows = raw.select("video_id", "frame_idx", "height", "width", fps.alias("fps"), "rgb")
    wrong = ~F.coalesce(F.length("rgb") == 3 * F.col("height") * F.col("width"), F.lit(False))
    held = rows.groupBy("video_id").agg(F.sum(wrong.cast("int")).alias("_wrong"))
    listed = videos.select("video_id").distinct().join(held, "video_id", "left")
    error = F.when(F.col("_wrong").isNull(), "no frames").when(F.col("_wrong") > 0, "frame size")
    failures = listed.select("video_id", error.alias("error")).where("error is not null")
    return rows.join(listed.where("_wrong = 0").select("video_id"), "video_id", "left_semi"), failures
