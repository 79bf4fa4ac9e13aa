"""Grids, motion scores, masks, alignment and region error, at the level of blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockalloc.operators.bootstrap import stable_seed
from blockalloc.operators.draws import random_frames
from blockalloc.operators.quantiles import alike, exact_quantiles

CELL = ("frame_idx", "bi", "bj")


def block_of(i: Column, length: Column | int, parts: int) -> Column:
    """The part that position i of ``length`` is in, when the first ``length % parts`` parts are one longer."""
    length = F.lit(length) if isinstance(length, int) else length
    q, r = F.floor(length / parts), length % parts
    long = r * (q + 1)
    return F.when(i < long, F.floor(i / (q + 1))).otherwise(r + F.floor((i - long) / F.when(q > 0, q))).cast("int")


def bounds(length: Column | int, parts: int) -> Column:
    """Array of (b, lo, hi) of all parts; parts beyond the length are empty."""
    length = F.lit(length) if isinstance(length, int) else length
    q, r = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    start = lambda b: b * q + F.least(b, r)
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda b: F.struct(b.alias("b"), start(b).alias("lo"), start(b + 1).alias("hi")))


def gray(r: Column, g: Column, b: Column) -> Column:
    """BT.601 luma as a whole number."""
    return F.round(F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b)


def edges(length: int, parts: int) -> np.ndarray:
    """Where the parts begin, and the end."""
    q, r = divmod(length, parts)
    b = np.arange(parts + 1)
    return b * q + np.minimum(b, r)


def block_sums(values: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over blocks of [n, H, W] values, [n, grid, grid], and pixels of each block."""
    ys, xs = edges(values.shape[1], grid), edges(values.shape[2], grid)
    total = np.zeros((values.shape[0], values.shape[1] + 1, values.shape[2] + 1))
    total[:, 1:, 1:] = values.cumsum(1).cumsum(2)
    at = total[:, ys][:, :, xs]
    return at[:, 1:, 1:] - at[:, :-1, 1:] - at[:, 1:, :-1] + at[:, :-1, :-1], np.outer(np.diff(ys), np.diff(xs))


def images(column, height: int, width: int) -> np.ndarray:
    """A list column of equal-sized frames as one array."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), height, width)


def by_size(t: pa.Table) -> Iterator[tuple[int, int, pa.Table]]:
    """Rows of a batch by frame size."""
    size = t["height"].to_numpy() * (1 << 20) + t["width"].to_numpy()
    for s in np.unique(size):
        yield int(s >> 20), int(s % (1 << 20)), t.filter(pa.array(size == s))


def exploded(video: pa.ChunkedArray, frame: np.ndarray, grid: int, **values: np.ndarray) -> pa.Table:
    n, cells = len(frame), grid * grid
    b = np.tile(np.arange(cells), n)
    video = video.combine_chunks().take(pa.array(np.repeat(np.arange(n), cells)))
    return pa.table({"video_id": video, "frame_idx": pa.array(np.repeat(frame, cells).astype(np.int32)), "bi": pa.array((b // grid).astype(np.int32)), "bj": pa.array((b % grid).astype(np.int32))} | {k: pa.array(v.reshape(-1)) for k, v in values.items()})


def motion_blocks(frames: DataFrame, grid: int, bucket: int = 256) -> DataFrame:
    """(video_id, frame_idx, bi, bj, score): mean absolute gray difference to the neighbouring frames, by block.

    ``frames`` has height, width and the gray values ``gray``; the first frame of a
    video looks forward, the last back, others both ways; one frame alone scores 0.
    A video is dealt out in buckets of frames, each with its neighbours at the edges,
    so a long video is no hot key and pixels stay in their row.
    """
    b = F.floor(F.col("frame_idx") / bucket)
    place = F.col("frame_idx") % bucket
    homes = F.concat(F.array(b), F.when(place == 0, F.array(b - 1)).otherwise(F.array().cast("array<bigint>")), F.when(place == bucket - 1, F.array(b + 1)).otherwise(F.array().cast("array<bigint>")))
    dealt = frames.select("video_id", "frame_idx", "height", "width", "gray", F.explode(homes).alias("bucket")).where("bucket >= 0")

    def run(t: pa.Table) -> pa.Table:
        home = t["bucket"][0].as_py()
        t = t.sort_by("frame_idx")
        h, w = t["height"][0].as_py(), t["width"][0].as_py()
        v = images(t["gray"], h, w).astype(float)
        frame = t["frame_idx"].to_numpy()
        step = np.abs(np.diff(v, axis=0))
        both = np.zeros_like(v)
        sides = np.zeros(len(v))
        both[1:] += step
        both[:-1] += step
        sides[1:] += 1
        sides[:-1] += 1
        both /= np.maximum(sides, 1)[:, None, None]
        mine = np.floor(frame / bucket) == home
        sums, n = block_sums(both[mine], grid)
        own = t.filter(pa.array(mine))
        return exploded(own["video_id"], frame[mine], grid, score=sums / np.maximum(n, 1))

    return dealt.groupBy("video_id", "bucket").applyInArrow(run, "video_id string, frame_idx int, bi int, bj int, score double")


def block_errors(pairs: DataFrame, grid: int) -> DataFrame:
    """(video_id, frame_idx, bi, bj, n_px, sse): squared error of ``a`` against ``b`` by block, frame by frame, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, t in by_size(pa.Table.from_batches([batch])):
                d = images(t["a"], h, w).astype(float) - images(t["b"], h, w)
                sums, n = block_sums(d * d, grid)
                yield from exploded(t["video_id"], t["frame_idx"].to_numpy(), grid, n_px=np.broadcast_to(n, sums.shape).astype(np.int64).copy(), sse=sums).to_batches()

    return pairs.select("video_id", "frame_idx", "height", "width", "a", "b").mapInArrow(run, "video_id string, frame_idx int, bi int, bj int, n_px long, sse double")


def quantile_clip(scores: DataFrame, keys: Sequence[str] = ("video_id",), low: float = 0.02, high: float = 0.98, clip_degenerate: bool = False, eps: float = 1e-8) -> DataFrame:
    """Scores between two exact quantiles of their group, clipped to 0..1.

    Where the quantiles coincide scores stay as they are, or with ``clip_degenerate``
    are clipped as they are.
    """
    scores = scores.checkpoint()  # read by the quantiles and again below
    q = exact_quantiles(scores, keys, "score", (low, high)).withColumnRenamed("q", "_q")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    wide = hi - lo >= eps if clip_degenerate else hi > lo + eps
    inside = unit((F.col("score") - lo) / F.when(hi > lo, hi - lo))
    return scores.join(q, list(keys)).withColumn("score", F.when(wide, inside).otherwise(unit(F.col("score")) if clip_degenerate else F.col("score"))).drop("_q")


def min_max(rows: DataFrame, keys: Sequence[str], column: str = "score", bounded: bool = False) -> DataFrame:
    """(x - min) / (max - min + 1e-8) over each group.

    The ends are aggregated and joined back, so a large group stays in many tasks; where
    groups are ``bounded`` (a clip) a window saves the join.
    """
    if bounded:
        w = Window.partitionBy(*keys)
        lo, hi = F.min(column).over(w), F.max(column).over(w)
        return rows.withColumn(column, (F.col(column) - lo) / (hi - lo + 1e-8))
    names = [f"_key_{i}" for i in range(len(keys))]
    ends = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    return rows.join(ends, alike(keys, names)).withColumn(column, scaled).drop(*names, "_lo", "_hi")


def random_maps(videos: DataFrame, grid: int, seed: int = 42, label: str = "random-mask", bucket: int = 256) -> DataFrame:
    """(video_id, frame_idx, bi, bj, score): the score maps that one generator a video draws for its ``frames`` frames in order, in single precision.

    A video's buckets of frames jump to their place in its stream, so they run side by side and give the same numbers as one pass.
    """
    counted = videos.select("video_id", F.col("frames").cast("long").alias("frames")).where("frames > 0")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(bucket).cast("long")))
    parts = counted.select("video_id", "frames", first.alias("first")).repartition("video_id", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, frames, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = min(bucket, frames - at)
                scores = random_frames(stable_seed(seed, video, label), at, n, grid * grid)
                yield from exploded(pa.chunked_array([pa.array([video] * n, pa.string())]), np.arange(at, at + n), grid, score=scores).to_batches()

    return parts.mapInArrow(run, "video_id string, frame_idx int, bi int, bj int, score float")


def shifted(scores: DataFrame, grid: int, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Each score map rolled around the grid, by a quarter of its rows and a third of its columns unless told."""
    dr, dc = max(1, grid // 4) if rows is None else rows, max(1, grid // 3) if cols is None else cols
    return scores.withColumns({"bi": ((F.col("bi") + dr) % grid + grid) % grid, "bj": ((F.col("bj") + dc) % grid + grid) % grid})


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of a SHA-256 over the parts: no generator state, no order, checkable in SQL."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def shape_failures(maps: DataFrame, frames: DataFrame, grid: int) -> DataFrame:
    """Videos whose maps can't be used: (video_id, n_maps, n_frames, n_bad, reason).

    ``maps(video_id, frame_idx, values)`` holds flat arrays of grid * grid values: one a
    frame, or a single one without frame_idx for the whole video. An array of another
    length, a null among a video's other frames, or maps for more or fewer frames than
    ``frames(video_id, frame_idx)`` has are failures; so is a video without frames. Videos
    without maps are none.
    """
    bad = F.col("values").isNull() | (F.size("values") != grid * grid)
    m = maps.groupBy("video_id").agg(F.count("*").alias("n_maps"), F.sum(F.when(bad, 1).otherwise(0)).alias("n_bad"), F.count_distinct("frame_idx").alias("_at"), F.sum(F.col("frame_idx").isNull().cast("int")).alias("_static"))
    n = frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    rows = m.join(n, "video_id", "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))
    static = (F.col("_static") == 1) & (F.col("n_maps") == 1) & (F.col("n_frames") > 0)
    moving = (F.col("_static") == 0) & (F.col("_at") == F.col("n_maps")) & (F.col("n_maps") == F.col("n_frames"))
    reason = F.when(F.col("n_bad") > 0, "map size").when(~(static | moving), "frame count")
    return rows.withColumn("reason", reason).where("reason is not null").select("video_id", "n_maps", "n_frames", "n_bad", "reason")


def map_cells(maps: DataFrame, frames: DataFrame, grid: int) -> DataFrame:
    """(video_id, frame_idx, bi, bj, score) of the maps without a failure; a single map of a video serves all its frames."""
    good = maps.join(shape_failures(maps, frames, grid).select("video_id"), "video_id", "left_anti")
    at = frames.select("video_id", "frame_idx")
    moving = good.where("frame_idx is not null").join(at, ["video_id", "frame_idx"], "left_semi").select("video_id", "frame_idx", "values")
    static = good.where("frame_idx is null").select("video_id", "values").join(at, "video_id").select("video_id", "frame_idx", "values")
    cells = moving.unionByName(static).select("video_id", "frame_idx", F.posexplode("values").alias("pos", "score"))
    return cells.select("video_id", "frame_idx", F.floor(F.col("pos") / grid).cast("int").alias("bi"), (F.col("pos") % grid).alias("bj"), "score")


def top_blocks(scores: DataFrame, k: int, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """The k highest blocks of each frame; ties go to the later block, NaN ranks highest. Fewer blocks than k: all."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(*keys, "frame_idx").orderBy(F.desc("score"), F.desc("bi"), F.desc("bj"))
    return scores.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r", "score")


def top_blocks_array(maps: DataFrame, k: int) -> DataFrame:
    """The same where a frame's scores are one array row ``scores``: no shuffle; ``blocks`` lists flat indices in ascending score order."""
    ranked = F.array_sort(F.zip_with("scores", F.sequence(F.lit(0), F.size("scores") - 1), lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
    n = F.size("scores")
    return maps.withColumn("blocks", F.transform(F.slice(ranked, F.greatest(n - k, F.lit(0)) + 1, F.least(F.lit(k), n)), lambda x: x["i"]))


def pixel_area(bi: Column, bj: Column, height: int, width: int, grid: int) -> Column:
    """Pixels of a block."""
    side = lambda b, length: F.lit(length // grid) + (b < length % grid).cast("int")
    return (side(bi, height) * side(bj, width)).cast("long")


def alignment(candidate: DataFrame, reference: DataFrame, cells: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Areas, coverage, precision, overlap and lift of candidate masks against reference masks, in pixels.

    ``cells`` lists every block with its ``n_px``; all three are clustered alike, so one
    shuffle serves both joins, and sums combine before the second.
    """
    on = [*keys, *CELL]
    rows = cells.join(candidate.select(*on, F.lit(1).alias("c")), on, "left").join(reference.select(*on, F.lit(1).alias("r")), on, "left")
    c, r, n = F.coalesce("c", F.lit(0)), F.coalesce("r", F.lit(0)), F.col("n_px")
    s = rows.groupBy(*keys).agg(F.sum(c * n).alias("cand"), F.sum(r * n).alias("ref"), F.sum(c * r * n).alias("inter"), F.sum(n).alias("total"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    union = F.greatest(F.col("cand") + F.col("ref") - F.col("inter"), F.lit(1))
    return s.select(
        *keys, ratio("cand", "total").alias("candidate_area"), ratio("ref", "total").alias("reference_area"), ratio("inter", "ref").alias("reference_coverage"),
        ratio("inter", "cand").alias("candidate_precision"), (F.col("inter") / union).alias("iou"),
        F.when(F.col("cand") > 0, ratio("inter", "ref") / F.when(F.col("cand") > 0, ratio("cand", "total"))).otherwise(float("nan")).alias("coverage_lift"),
    )


def psnr(mse: Column) -> Column:
    """Decibels of a mean squared error on 0..255; infinite up to 1e-12."""
    return F.when(mse <= 1e-12, float("inf")).otherwise(20 * F.log10(F.lit(255.0)) - 10 * F.log10(F.greatest(mse, F.lit(1e-300))))


def region_error(errors: DataFrame, mask: DataFrame, keys: Sequence[str] = ("video_id",), sse: str = "sse", channels: int = 3) -> DataFrame:
    """Where the squared error landed: area, PSNR overall, inside and outside the mask, share, lift and ratio."""
    on = [*keys, *CELL]
    rows = errors.join(mask.select(*on, F.lit(True).alias("m")), on, "left").withColumn("m", F.coalesce("m", F.lit(False)))
    part = lambda c, m: F.sum(F.when(m, F.col(c)).otherwise(0))
    s = rows.groupBy(*keys).agg(part(sse, F.col("m")).alias("hs"), part(sse, ~F.col("m")).alias("ls"), F.sum(sse).alias("ts"), *((part("n_px", m) * channels).alias(n) for n, m in (("hn", F.col("m")), ("ln", ~F.col("m")))), (F.sum("n_px") * channels).alias("tn"))
    mean = lambda a, n: F.col(a) / F.greatest(F.col(n), F.lit(1))
    nan = F.lit(float("nan"))
    s = s.withColumns({"area": mean("hn", "tn"), "high": mean("hs", "hn"), "low": mean("ls", "ln"), "distortion_share": F.when(F.col("ts") > 1e-12, F.col("hs") / F.when(F.col("ts") > 1e-12, F.col("ts"))).otherwise(nan)})
    return s.select(
        *keys, "area", psnr(mean("ts", "tn")).alias("total_mse_psnr"), psnr(F.col("high")).alias("high_psnr"), psnr(F.col("low")).alias("low_psnr"), "distortion_share",
        F.when(F.col("area") > 0, F.col("distortion_share") / F.when(F.col("area") > 0, F.col("area"))).otherwise(nan).alias("distortion_lift"),
        F.when(F.col("low") > 1e-12, F.col("high") / F.when(F.col("low") > 1e-12, F.col("low"))).otherwise(float("inf")).alias("high_low_mse_ratio"),
    )


def error_map(frames: DataFrame) -> DataFrame:
    """Mean absolute error over channels of ``a`` against ``b`` (arrays of arrays by channel), over its 0.98 quantile of the frame, clipped; as array ``e``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(i).flatten().flatten().to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            sizes = np.diff(b.column(2).flatten().offsets.to_numpy())
            out, at = [], 0
            channels = np.diff(b.column(2).offsets.to_numpy())
            k = 0
            for n in channels:
                px = int(sizes[k])
                e = np.abs(a[at : at + n * px] - c[at : at + n * px]).reshape(n, px).mean(0)
                q = np.quantile(e, 0.98)
                out.append(np.clip(e / (q if q > 1e-6 else 1.0), 0, 1))
                at, k = at + n * px, k + n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], ["video_id", "frame_idx", "e"])

    return frames.select("video_id", "frame_idx", "a", "b").mapInArrow(run, "video_id string, frame_idx int, e array<double>")


def peak_frame(scores: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """The frame with the largest total score, the first on ties."""
    total = scores.groupBy(*keys, "frame_idx").agg(F.round(F.sum("score"), 9).alias("total"))
    return total.groupBy(*keys).agg(F.max_by(F.struct("frame_idx", "total"), F.struct(F.col("total"), -F.col("frame_idx"))).alias("s")).select(*keys, "s.*")
