"""Clips, cues, fusion, trajectories and the way back to frames."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockalloc.operators.blocks import block_of, by_size, images, min_max
from blockalloc.session import dealt

CLIP = ("video_id", "clip_idx")


def unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def clips(videos: DataFrame, length: int = 16, stride: int = 8) -> DataFrame:
    """(video_id, clip_idx, start_idx, local_i, src_frame_idx) of ``videos(video_id, frames)``.

    Clips start every ``stride`` frames until one reaches the end; a short last clip
    repeats the last frame. A row becomes many, so the videos are dealt out first: their
    table may be a file of one partition.
    """
    videos = dealt(videos)
    last = F.greatest(F.lit(0), F.ceil((F.col("frames") - length) / stride)).cast("int")
    c = videos.where("frames > 0").select("video_id", "frames", F.explode(F.sequence(F.lit(0), last)).alias("clip_idx"))
    c = c.withColumn("start_idx", F.col("clip_idx") * stride)
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("local_i"))
    return c.select("video_id", "clip_idx", "start_idx", "local_i", F.least(F.col("start_idx") + F.col("local_i"), F.col("frames") - 1).alias("src_frame_idx"))


def padded_length(n: Column, tubelet: int) -> Column:
    """Frames after padding to a multiple of the tubelet; frames beyond the end repeat the last."""
    return (F.ceil(n / tubelet) * tubelet).cast("int")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def clip_vectors(rows: DataFrame, limit: float, column: str = "vec") -> DataFrame:
    """Vectors scaled to norm ``limit`` at most."""
    scale = F.least(F.lit(1.0), limit / F.greatest(norm(F.col(column)), F.lit(1e-12)))
    return rows.withColumn(column, F.transform(column, lambda x: x * scale))


def temporal_change(tokens: DataFrame) -> DataFrame:
    """Norm of each token's change since the segment before, 0 for the first, min-max normalised over the clip; 0 for one segment."""
    place = Window.partitionBy(*CLIP, "py", "px").orderBy("u")
    before = F.lag("vec").over(place)
    diff = F.when(before.isNull(), 0.0).otherwise(norm(F.zip_with("vec", before, lambda a, b: a - b)))
    rows = tokens.withColumn("score", diff).drop("vec")
    w = Window.partitionBy(*CLIP)
    return min_max(rows, CLIP, bounded=True).withColumn("score", F.when(F.max("u").over(w) > F.min("u").over(w), F.col("score")).otherwise(0.0))


def centrality(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean attention that a block's tokens pay each other, by a row softmax of their similarities, clamped.

    Rows of a softmax add up to 1, so the mean over a block of m tokens is 1 / m whatever
    their vectors and the temperature: a count gives it.
    """
    return tokens.groupBy(*keys).agg(F.count("*").cast("int").alias("n_tokens"), unit(1 / F.count("*")).alias("score"))


def flow_magnitude(flows: DataFrame, tubelet: int, scale: float) -> DataFrame:
    """(…, u, b, score): block flow magnitude over ``scale``, averaged over the flows u * tubelet to (u + 1) * tubelet - 1, clamped."""
    mag = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / scale
    rows = flows.withColumn("u", F.floor(F.col("flow_idx") / tubelet).cast("int"))
    return rows.groupBy(*CLIP, "u", "b").agg(unit(F.avg(mag)).alias("score"))


def mirrored(i: Column, n: int) -> Column:
    """An index reflected at the border without repeating the edge."""
    if n == 1:
        return i * 0
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def smooth_grid(maps: DataFrame, grid: int, keys: Sequence[str], clamp: bool = True) -> DataFrame:
    """Mean of each cell and its eight neighbours, mirrored at the border.

    Each cell is sent to the cells that see it; a mirrored cell is seen twice by its
    neighbour. Sums of nine combine before the shuffle.
    """
    # a cell is seen at i + d for each d whose mirrored index is the cell: precomputed, at most 4 per axis
    seen = {s: [i for i in range(grid) for d in (-1, 0, 1) if (0 if grid == 1 else (-(i + d) if i + d < 0 else 2 * (grid - 1) - (i + d) if i + d >= grid else i + d)) == s] for s in range(grid)}
    table = F.array(*(F.array(*map(F.lit, seen[s])) for s in range(grid)))
    rows = maps.select(*keys, F.col("score"), "bj", F.explode(F.get(table, F.col("bi"))).alias("_i"))
    rows = rows.select(*keys, "score", "_i", F.explode(F.get(table, F.col("bj"))).alias("_j"))
    out = rows.groupBy(*keys, F.col("_i").alias("bi"), F.col("_j").alias("bj")).agg((F.sum("score") / 9).alias("score"))
    return out.withColumn("score", unit(F.col("score"))) if clamp else out


WEIGHTS = {"attn": 0.85, "temp": 0.10, "tex": 0.03, "flow": 0.02}


def fuse(cues: DataFrame, grid: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Risk maps (video_id, clip_idx, u, bi, bj, score) from cue columns: each min-max normalised over its clip, weighted, normalised, smoothed and clamped."""
    for name in weights:
        cues = min_max(cues, CLIP, name, bounded=True)
    rows = cues.select(*CLIP, "u", "bi", "bj", sum((w * F.col(n) for n, w in weights.items()), F.lit(0.0)).alias("score"))
    rows = min_max(rows, CLIP, bounded=True).withColumn("score", unit(F.col("score")))
    return smooth_grid(rows, grid, [*CLIP, "u"])


def next_block(flows: DataFrame, image: int, grid: int, tubelet: int, frames: int = 16, tau: float = 12.0) -> DataFrame:
    """(video_id, clip_idx, u, b, dest, conf) for segments u >= 1: where each block's mean flow of the segment before takes its centre.

    Squared distances to all centres are compared to nine places, so that rounding noise of
    a mean flow decides no tie; the first wins ties. Segment u takes flows (u - 1) * tubelet to u * tubelet - 1; there
    are as many segments as ``frames`` fill, the first of which has no move.
    """
    q, r = divmod(image, grid)
    edge = [b * q + min(b, r) for b in range(grid + 1)]
    centres = F.array(*(F.lit((edge[b] + edge[b + 1] - 1) / 2) for b in range(grid)))
    rows = flows.withColumn("u", F.floor(F.col("flow_idx") / tubelet).cast("int") + 1).where(F.col("u") < -(-frames // tubelet))
    m = rows.groupBy(*CLIP, "u", "b").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    m = m.withColumns({"bi": F.floor(F.col("b") / grid).cast("int"), "bj": F.col("b") % grid})

    def off(index: Column, own: str, shift: str) -> Column:
        return F.pow(F.get(centres, index.cast("int")) - F.get(centres, F.col(own)) - F.col(shift), F.lit(2.0))

    far = lambda c: F.round((off(c % grid, "bj", "dx") + off(F.floor(c / grid), "bi", "dy")) * 1e9)
    nearest = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda c: F.struct(far(c).alias("d"), c.alias("c"))))["c"]
    mag = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return m.select(*CLIP, "u", "b", nearest.alias("dest"), unit(F.exp(-mag / max(tau, 1e-6))).alias("conf"))


def confidence(steps: DataFrame, base: float = 1.0) -> DataFrame:
    """(…, u, block, c): greatest confidence of the moves into a block, at least ``base`` (1, as published, makes it always 1)."""
    return steps.groupBy(*CLIP, "u", F.col("dest").alias("block")).agg(F.greatest(F.lit(base), F.max("conf")).alias("c"))


def paths(steps: DataFrame, grid: int) -> DataFrame:
    """(video_id, clip_idx, traj_id, path): from every block along the moves, as an array over segments.

    A clip's moves become one array of destination arrays, and a path is a fold over it:
    no join per segment.
    """
    per = steps.groupBy(*CLIP, "u").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "dest"))), lambda s: s["dest"]).alias("to"))
    maps = per.groupBy(*CLIP).agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "to"))), lambda s: s["to"]).alias("maps"))
    starts = maps.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("traj_id"))
    walk = F.aggregate("maps", F.array("traj_id"), lambda p, to: F.concat(p, F.array(F.get(to, F.element_at(p, -1)))))
    return starts.select(*CLIP, "traj_id", walk.alias("path"))


def along(paths: DataFrame) -> DataFrame:
    """Paths as rows (…, traj_id, u, block)."""
    return paths.select(*CLIP, "traj_id", F.posexplode("path").alias("u", "block"))


def path_scores(steps: DataFrame, risk: DataFrame, lam: float) -> DataFrame:
    """(…, traj_id, score): lam * mean + (1 - lam) * mean of the highest quarter of the risks along a path, clamped."""
    v = steps.join(risk, [*CLIP, "u", "block"]).groupBy(*CLIP, "traj_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    k = F.greatest(F.lit(1), F.ceil(0.25 * F.size("v")).cast("int"))
    return v.select(*CLIP, "traj_id", unit(lam * total(F.col("v")) / F.size("v") + (1 - lam) * total(F.slice("v", 1, k)) / k).alias("score"))


def keyed_normal(seed: int, *parts: str) -> Column:
    """A standard normal from hashes of the key, by the polar form: the same on any partition."""
    u = [(F.xxhash64(F.lit(seed), F.lit(i), *parts).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / float((1 << 52) + 1) for i in (0, 1)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.lit(3.141592653589793) * u[1])


def noisy(maps: DataFrame, sigma: float, seed: int, keys: Sequence[str]) -> DataFrame:
    """Scores plus keyed Gaussian noise, clamped."""
    return maps.withColumn("score", unit(F.col("score") + sigma * keyed_normal(seed, *keys)))


def softmax_weights(scores: DataFrame, beta: float, sigma: float = 0.0, seed: int = 42) -> DataFrame:
    """(…, traj_id, weight): softmax of the clamped, perhaps noisy scores over the clip's trajectories."""
    s = noisy(scores, sigma, seed, [*CLIP, "traj_id"]) if sigma > 0 else scores
    e = F.exp(beta * F.col("score"))
    return s.withColumn("weight", e / F.sum(e).over(Window.partitionBy(*CLIP)))


def scatter_mean(steps: DataFrame, weights: DataFrame, grid: int) -> DataFrame:
    """(…, u, bi, bj, score): mean weight of the trajectories through each block, 0 where none, clamped, smoothed."""
    sums = steps.join(weights.select(*CLIP, "traj_id", "weight"), [*CLIP, "traj_id"]).groupBy(*CLIP, "u", "block").agg(F.avg("weight").alias("score"))
    cells = steps.select(*CLIP, "u").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("block"))
    full = cells.join(sums, [*CLIP, "u", "block"], "left")
    full = full.select(*CLIP, "u", F.floor(F.col("block") / grid).cast("int").alias("bi"), (F.col("block") % grid).alias("bj"), unit(F.coalesce("score", F.lit(0.0))).alias("score"))
    return smooth_grid(full, grid, [*CLIP, "u"])


def path_smoothing(steps: DataFrame, raw: DataFrame, conf: DataFrame, eta: float, grid: int) -> DataFrame:
    """Weights carried along each path by confidence, averaged at each block; blocks on no path keep the raw weight; smoothed."""
    r = raw.select(*CLIP, "u", (F.col("bi") * grid + F.col("bj")).alias("block"), F.col("score").alias("w"))
    rows = steps.join(r, [*CLIP, "u", "block"]).join(conf, [*CLIP, "u", "block"], "left").withColumn("c", F.coalesce("c", F.lit(1.0)))
    p = rows.groupBy(*CLIP, "traj_id").agg(F.array_sort(F.collect_list(F.struct("u", "block", "w", "c"))).alias("p"))

    def step(done, x):
        bar = F.when(F.size(done) == 0, x["w"]).otherwise(eta * x["c"] * x["w"] + (1 - eta * x["c"]) * F.element_at(done, -1)["bar"])
        return F.concat(done, F.array(F.struct(x["u"].alias("u"), x["block"].alias("block"), bar.alias("bar"))))

    start = F.array().cast("array<struct<u:int,block:int,bar:double>>")
    bars = p.select(*CLIP, "traj_id", F.inline(F.aggregate("p", start, step)))
    mean = bars.groupBy(*CLIP, "u", "block").agg(F.avg("bar").alias("bar"))
    out = r.join(mean, [*CLIP, "u", "block"], "left").select(*CLIP, "u", F.floor(F.col("block") / grid).cast("int").alias("bi"), (F.col("block") % grid).alias("bj"), unit(F.coalesce("bar", "w")).alias("score"))
    return smooth_grid(out, grid, [*CLIP, "u"])


def to_frames(maps: DataFrame, tubelet: int, length: int) -> DataFrame:
    """(…, local_i, bi, bj, score): segment maps interpolated to the clip's frames.

    Each segment is sent to the frames that it weighs in, and the two parts are added:
    one aggregation instead of two joins.
    """
    last = F.max("u").over(Window.partitionBy(*CLIP))
    t = F.sequence(F.lit(0), F.lit(length - 1))
    share = lambda i, u, top: F.when(F.least(F.floor(i / tubelet), top) == u, 1 - (i / tubelet - F.floor(i / tubelet))).otherwise(0.0) + F.when(F.least(F.floor(i / tubelet) + 1, top) == u, i / tubelet - F.floor(i / tubelet)).otherwise(0.0)
    rows = maps.withColumn("top", last)
    parts = F.filter(F.transform(t, lambda i: F.struct(i.alias("local_i"), share(i, F.col("u"), F.col("top")).alias("a"))), lambda s: s["a"] > 0)
    rows = rows.select(*CLIP, "bi", "bj", "score", F.inline(parts))
    return rows.groupBy(*CLIP, "local_i", "bi", "bj").agg(F.sum(F.col("a") * F.col("score")).alias("score"))


def edge_weight(local: Column, length: int, power: float = 1.7) -> Column:
    centre = (length - 1) / 2
    return F.pow(unit(1 - F.abs(local - centre) / max(centre, 1e-6)), F.lit(power)) if length > 1 else F.lit(1.0)


def merge_overlaps(rows: DataFrame, length: int, stride: int, keys: Sequence[str] = ("bi", "bj"), fallback: str = "reference", value: str = "score", top: float = 1.0, whole: bool = False) -> DataFrame:
    """(video_id, frame_idx, keys, value): overlapping clips merged by weights that fall towards a clip's edges.

    Where all weights are zero, ``reference`` takes the frame before's weighted sum as
    it is (zeros for the first frame), ``nearest`` the plain mean. ``whole`` cuts the
    result to whole numbers, as merged frames are.
    """
    f = rows.withColumn("frame_idx", F.col("clip_idx") * stride + F.col("local_i")).withColumn("w", edge_weight(F.col("local_i"), length))
    s = f.groupBy("video_id", "frame_idx", *keys).agg(F.sum(F.col("w") * F.col(value)).alias("ws"), F.sum("w").alias("w"), F.avg(value).alias("plain"))
    if fallback == "reference":
        other = F.coalesce(F.lag("ws").over(Window.partitionBy("video_id", *keys).orderBy("frame_idx")), F.lit(0.0))
    else:
        other = F.col("plain")
    v = F.when(F.col("w") > 0, F.col("ws") / F.greatest(F.when(F.col("w") > 0, F.col("w")), F.lit(1e-6))).otherwise(other)
    v = F.least(F.lit(top), F.greatest(F.lit(0.0), v))
    return s.select("video_id", "frame_idx", *keys, (F.floor(v + 1e-9) if whole else v).alias(value))


def merge_mean(rows: DataFrame, stride: int, frames: DataFrame, grid: int) -> DataFrame:
    """Overlapping clips merged by their plain mean, zeros where a frame of ``frames(video_id, frames)`` is not covered."""
    f = rows.withColumn("frame_idx", F.col("clip_idx") * stride + F.col("local_i")).groupBy("video_id", "frame_idx", "bi", "bj").agg(F.avg("score").alias("score"))
    cells = frames.where("frames > 0").select("video_id", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame_idx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("b"))
    cells = cells.select("video_id", "frame_idx", F.floor(F.col("b") / grid).cast("int").alias("bi"), (F.col("b") % grid).alias("bj"))
    return cells.join(f, ["video_id", "frame_idx", "bi", "bj"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def smooth_sigmas(maps: DataFrame, grid: int, keep: float = 0.85, floor: float = 1e-6) -> DataFrame:
    """Noise scales box-smoothed in each segment, then mixed along a video: out = keep * current + (1 - keep) * before, from clip to clip too; at least ``floor``.

    What came before fades by (1 - keep) a step, so a window reaches back as far as a
    double can tell, and further segments add nothing to it.
    """
    s = smooth_grid(maps, grid, [*CLIP, "u"], clamp=False)
    fade = 1 - keep
    back = Window.unboundedPreceding if fade >= 1 else -math.ceil(math.log(1e-18) / math.log(fade)) if fade > 0 else 0
    near = Window.partitionBy("video_id", "bi", "bj").orderBy("clip_idx", "u").rowsBetween(back, Window.currentRow)
    mix = F.aggregate(F.collect_list("score").over(near), F.lit(None).cast("double"), lambda before, x: F.coalesce(keep * x + fade * before, x))
    return s.select("video_id", "bi", "bj", "clip_idx", "u", F.greatest(mix, F.lit(floor)).alias("score"))


def sobel_patches(frames: DataFrame, patch: int) -> DataFrame:
    """(video_id, frame_idx, py, px, score): mean 3 x 3 Sobel magnitude in each patch, min-max normalised a frame.

    ``frames`` has height, width and the values ``gray``; borders are mirrored without
    repeating the edge, rows and columns beyond the last whole patch are left out. All
    of it stays inside a frame's row: equal-sized frames of a batch are taken together
    and only patches come out, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, t in by_size(pa.Table.from_batches([batch])):
                rows, cols = h // patch, w // patch
                if not rows * cols:
                    continue
                g = np.pad(images(t["gray"], h, w).astype(float), ((0, 0), (1, 1), (1, 1)), "reflect" if min(h, w) > 1 else "edge")
                down = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
                across = g[:, :, :-2] + 2 * g[:, :, 1:-1] + g[:, :, 2:]
                size = np.hypot(down[:, :, 2:] - down[:, :, :-2], across[:, 2:] - across[:, :-2])
                mean = size[:, : rows * patch, : cols * patch].reshape(len(t), rows, patch, cols, patch).mean((2, 4)).reshape(len(t), -1)
                low, high = mean.min(1, keepdims=True), mean.max(1, keepdims=True)
                n, at = rows * cols, np.tile(np.arange(rows * cols), len(t))
                source = pa.array(np.repeat(np.arange(len(t)), n))
                columns = [t[c].combine_chunks().take(source) for c in ("video_id", "frame_idx")]
                columns += [pa.array((at // cols).astype(np.int32)), pa.array((at % cols).astype(np.int32)), pa.array(((mean - low) / (high - low + 1e-8)).ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["video_id", "frame_idx", "py", "px", "score"])

    return frames.select("video_id", "frame_idx", "height", "width", "gray").mapInArrow(run, "video_id string, frame_idx int, py int, px int, score double")


def texture_cue(frames: DataFrame, clips: DataFrame, patch: int, grid: int) -> DataFrame:
    """(video_id, clip_idx, bi, bj, score): the texture of each clip's first frame, by block.

    ``clips(video_id, clip_idx, start_idx)`` name the reference frames; their Sobel
    magnitudes are averaged over patches, min-max normalised over the frame, and
    averaged over the patches of each of grid x grid blocks. A frame that several clips begin with is read once.
    """
    starts = clips.select("video_id", "clip_idx", F.col("start_idx").cast("int").alias("frame_idx")).distinct()
    first = frames.join(starts.select("video_id", "frame_idx").distinct(), ["video_id", "frame_idx"], "left_semi")
    sides = first.select("video_id", "frame_idx", F.floor(F.col("height") / patch).cast("int").alias("_rows"), F.floor(F.col("width") / patch).cast("int").alias("_cols"))
    patches = sobel_patches(first, patch).join(sides, ["video_id", "frame_idx"])
    at = patches.withColumns({"bi": block_of(F.col("py"), F.col("_rows"), grid), "bj": block_of(F.col("px"), F.col("_cols"), grid)})
    blocks = at.groupBy("video_id", "frame_idx", "bi", "bj").agg(F.avg("score").alias("score"))
    return starts.join(blocks, ["video_id", "frame_idx"]).select("video_id", "clip_idx", "bi", "bj", "score")
