"""Low-frequency DCT queries, Gaussian release and other per-frame operators on whole frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockalloc.operators.accounting import seed_mix
from blockalloc.operators.blocks import by_size, edges, images
from blockalloc.operators.bootstrap import stable_seed
from blockalloc.operators.draws import CHUNK, named_keys, normals_from, stream_normals, stream_places
from blockalloc.operators.recurrence import BUCKET, WARM, affine_carries, replay, settled_carries

#: BT.601 full-range conversion, rows Y, Cb, Cr.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
#: Back: red from Cr, green from Cb and Cr, blue from Cb.
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 1.402, 0.344136, 0.714136, 1.772


def to_ycc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Y, Cb and Cr of red, green and blue in 0..1, clipped to 0..1 both before and after."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    r, g, b = unit(r), unit(g), unit(b)
    return tuple(unit(float(m[0]) * r + float(m[1]) * g + float(m[2]) * b + (0.5 if i else 0.0)) for i, m in enumerate(YCC))


def from_ycc(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return unit(y + RED_CR * (cr - 0.5)), unit(y - GREEN_CB * (cb - 0.5) - GREEN_CR * (cr - 0.5)), unit(y + BLUE_CB * (cb - 0.5))


@lru_cache(64)
def basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II basis of any length."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    b = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    b[0] = np.sqrt(1 / n)
    return b


NAMES = ("video_id", "frame_idx", "height", "width")
RUNS = "video_id string, frame_idx int, height int, width int"


@lru_cache(64)
def side_by_side(length: int, grid: int, most: int | None = None) -> np.ndarray:
    """The DCT bases of all parts of a side, along the diagonal: every part's own ``most`` first rows (zeros where it is shorter), or all."""
    cut = edges(length, grid)
    start = cut if most is None else most * np.arange(grid + 1)
    out = np.zeros((int(start[-1]), length))
    for p, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if hi > lo:
            rows = basis(int(hi - lo))[:most]
            out[start[p] : start[p] + len(rows), lo:hi] = rows
    return out


def queries_of(luma: np.ndarray, grid: int, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Clipped 2 x 2 queries [n, blocks, 2, 2] of all blocks of [n, H, W], and their scales."""
    n, h, w = luma.shape
    q = side_by_side(h, grid, 2) @ luma @ side_by_side(w, grid, 2).T
    q = q.reshape(n, grid, 2, grid, 2).swapaxes(2, 3).reshape(n, grid * grid, 2, 2)
    scale = np.minimum(1.0, clip / (np.sqrt((q**2).sum((2, 3))) + 1e-6))
    return q * scale[:, :, None, None], scale


def listed(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and flat index of each listed block, and how many each row lists; a null list is empty."""
    lists = [b or [] for b in t["blocks"].to_pylist()]
    sizes = np.array([len(b) for b in lists], np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.array([x for b in lists for x in b], np.int64), sizes


def colours(t: pa.Table, h: int, w: int) -> np.ndarray:
    """Equal-sized frames of three planes each as [n, 3, H, W]."""
    return images(t["rgb"], 3 * h, w).astype(float).reshape(len(t), 3, h, w)


def low_frequency_queries(frames: DataFrame, grid: int, clip: float) -> DataFrame:
    """(video_id, frame_idx, block, q00, q01, q10, q11, scale) for the blocks listed in ``blocks``.

    ``frames`` has height, width, rgb (array of 3 planes after each other, values 0..255
    or 0..1) and blocks (flat indices). One pass over each batch, all blocks of its
    equal-sized frames at once; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, t in by_size(pa.Table.from_batches([batch])):
                x = colours(t, h, w)
                x /= np.where(x.max((1, 2, 3), initial=0) > 1, 255, 1)[:, None, None, None]
                q, scale = queries_of(np.tensordot(x, YCC[0], (1, 0)), grid, clip)
                row, block, _ = listed(t)
                found = q[row, block].reshape(-1, 4)
                of = [t[c].combine_chunks().take(pa.array(row)) for c in ("video_id", "frame_idx")]
                yield pa.RecordBatch.from_arrays([*of, pa.array(block.astype(np.int32)), *(pa.array(found[:, i].copy()) for i in range(4)), pa.array(scale[row, block])], ["video_id", "frame_idx", "block", "q00", "q01", "q10", "q11", "scale"])

    cols = frames.select("video_id", "frame_idx", "height", "width", "rgb", "blocks")
    return cols.mapInArrow(run, "video_id string, frame_idx int, block int, q00 double, q01 double, q10 double, q11 double, scale double")


def released(t: pa.Table, h: int, w: int, grid: int, clip: float, neutral: float, noise: np.ndarray | None) -> pa.RecordBatch:
    """Equal-sized frames with their listed blocks replaced; ``noise`` has four numbers a listed block."""
    n = len(t)
    ycc = np.tensordot(YCC, colours(t, h, w) / 255, (1, 1))
    q, scale = queries_of(ycc[0], grid, clip)
    row, block, sizes = listed(t)
    if noise is not None:
        q[row, block] += noise.reshape(-1, 2, 2)
    chosen = np.zeros((n, grid * grid), bool)
    chosen[row, block] = True
    wide = q.reshape(n, grid, grid, 2, 2).swapaxes(2, 3).reshape(n, 2 * grid, 2 * grid)
    smooth = side_by_side(h, grid, 2).T @ wide @ side_by_side(w, grid, 2)
    inside = chosen.reshape(n, grid, grid).repeat(np.diff(edges(h, grid)), axis=1).repeat(np.diff(edges(w, grid)), axis=2)
    y, cb, cr = np.where(inside, smooth, ycc[0]), *(np.where(inside, neutral - 0.5, c) for c in ycc[1:])
    out = np.stack([y + RED_CR * cr, y - GREEN_CB * cb - GREEN_CR * cr, y + BLUE_CB * cb], axis=1)
    whole = (np.clip(out, 0, 1) * 255 + 1e-9).astype(np.int32)
    scales = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(scale[row, block]))
    return pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in NAMES), pa.array(list(whole.reshape(n, -1)), pa.list_(pa.int32())), scales], [*NAMES, "rgb", "scales"])


RELEASED = f"{RUNS}, rgb array<int>, scales array<double>"


def release(frames: DataFrame, grid: int, clip: float, sigma: float, seed: int = 42, neutral: float = 0.5) -> DataFrame:
    """Frames with the listed blocks replaced by their noisy low-frequency query: (…, rgb, scales).

    A selected block's luma is the inverse DCT of the clipped 2 x 2 query plus Gaussian
    noise, its chroma ``neutral``; other blocks pass through the colour conversion.
    Values are clipped and cut to whole numbers. Noise comes from a counter-based generator
    keyed by seed and video, whose counters name frame and block: frames are released in
    any order and on any partition alike, and all blocks of a batch draw at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, t in by_size(pa.Table.from_batches([batch])):
                row, block, _ = listed(t)
                noise = None
                if sigma > 0 and len(row):
                    keys, frame = named_keys(seed, t["video_id"].to_pylist()), t["frame_idx"].to_numpy()
                    noise = sigma * stream_normals(4, keys[row], frame[row], block, np.zeros(len(row), np.int64))
                yield released(t, h, w, grid, clip, neutral, noise)

    return frames.select("video_id", "frame_idx", "height", "width", "rgb", "blocks").mapInArrow(run, RELEASED)


def release_in_order(frames: DataFrame, grid: int, clip: float, sigma: float, seed: int = 42, neutral: float = 0.5, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """The same release with the noise that one generator a video draws, frame by frame and in the order of each frame's ``blocks``.

    Blocks without pixels draw nothing. Buckets of frames draw side by side: each jumps to
    its place in the video's stream, which ``stream_places`` finds.
    """
    held = frames.select("video_id", "frame_idx", "height", "width", "rgb", "blocks", F.floor(F.col("frame_idx") / bucket).alias("bucket"))
    full = F.size(F.filter(F.coalesce("blocks", F.array().cast("array<int>")), lambda b: (F.floor(b / grid) < F.col("height")) & (b % grid < F.col("width"))))
    asked = held.groupBy("video_id", "bucket").agg(F.sum(4 * full).cast("long").alias("draws")).checkpoint()
    seed_of = lambda video: stable_seed(seed, video, "release")
    places = stream_places(asked, seed_of, chunk)

    def run(t: pa.Table, place: pa.Table) -> pa.Table:
        t = t.sort_by("frame_idx")
        row, block, _ = listed(t)
        h, w = t["height"].to_numpy()[row], t["width"].to_numpy()[row]
        full = (block // grid < h) & (block % grid < w)
        noise = np.zeros((len(row), 4))
        if full.any():
            video, word, drop = t["video_id"][0].as_py(), place["word"][0].as_py(), place["drop"][0].as_py()
            noise[full] = sigma * normals_from(seed_of(video), word, drop, 4 * int(full.sum())).reshape(-1, 4)
        out = []
        for h, w, part in by_size(t.append_column("_row", pa.array(np.arange(len(t))))):
            mine = np.isin(row, part["_row"].to_numpy())
            out.append(released(part, h, w, grid, clip, neutral, noise[mine]))
        return pa.Table.from_batches(out)

    by = ["video_id", "bucket"]
    return held.groupBy(*by).cogroup(places.groupBy(*by)).applyInArrow(run, RELEASED)


def temporal_ema(frames: DataFrame, ema: float, column: str = "v", bucket: int = BUCKET) -> DataFrame:
    """Exponential smoothing of released frames: the carry isn't rounded, the output is; ``ema`` is clipped to 0..0.99.

    The recurrence is affine, so buckets of frames run side by side once their summaries are scanned.
    """
    ema = min(0.99, max(0.0, ema))

    def step(carry, cur):
        carry = cur if carry is None else ema * carry + (1 - ema) * cur
        return carry, np.clip(np.round(carry), 0, 255)

    return replay(frames, affine_carries(frames, ema, column, bucket), step, column, bucket)


def causal_smoothing(frames: DataFrame, mix: float = 0.72, keep: float = 0.82, column: str = "v", bucket: int = BUCKET, warm: int = WARM) -> DataFrame:
    """Each frame mixed twice with the smoothed one before it, rounded after each step.

    Rounding keeps steps from composing, but each forgets three fifths of its carry:
    buckets guess theirs from some frames before them and run again where the guess was wrong.
    """

    def step(carry, cur):
        if carry is not None:
            once = np.round(mix * cur + (1 - mix) * carry)
            cur = np.clip(np.round(keep * once + (1 - keep) * carry), 0, 255)
        return cur, cur

    return replay(frames, settled_carries(frames, step, column, bucket, warm), step, column, bucket)


def sigma_of_weight(weight: Column, low: float, high: float, gamma: float = 1.0, invert: bool = False) -> Column:
    """Noise scale of a normalised weight: clipped, perhaps inverted, raised to ``gamma``, spread between ``low`` and ``high``."""
    if not low < high or gamma <= 0:
        raise ValueError("need low < high and gamma > 0")
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))
    w = 1 - w if invert else w
    return low + (high - low) * F.pow(w, F.lit(gamma))


def soft_clip(x: Column, k: float) -> Column:
    """k tanh(x / k); x itself when k isn't positive."""
    return k * F.tanh(x / k) if k and k > 0 else x


def frequency_weights(height: Column | int, width: Column | int, low_cut: float, power: float) -> Column:
    """Array of (y, x, weight): exp(-f^power) of the normalised mean frequency above ``low_cut``, for blocks of one size or of a size a row."""
    h, w = (F.lit(n) if isinstance(n, int) else n for n in (height, width))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    f = lambda c: (c["y"] / F.greatest(F.lit(1), h - 1) + c["x"] / F.greatest(F.lit(1), w - 1)) / 2
    above = lambda c: F.greatest(F.lit(0.0), (f(c) - low_cut) / max(1e-6, 1 - low_cut))
    return F.transform(cells, lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), F.exp(-F.pow(above(c), F.lit(power))).alias("weight")))


def radial_ramp(size: int, r_low: float, r_high: float, cosine: bool = True, dc_zero: bool = True) -> Column:
    """Array of (y, x, weight): a ramp of the distance from the zero frequency between two radii, straight or half a cosine; a step where they coincide."""
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    r = lambda c: F.sqrt(c["y"] * c["y"] + c["x"] * c["x"])
    if r_high <= r_low:
        w = lambda c: (r(c) >= r_low).cast("double")
    else:
        t = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (r(c) - r_low) / (r_high - r_low)))
        w = (lambda c: 0.5 - 0.5 * F.cos(F.lit(float(np.pi)) * t(c))) if cosine else t
    return F.transform(cells, lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), (F.when(c["y"] + c["x"] > 0, w(c)).otherwise(0.0) if dc_zero else w(c)).alias("weight")))


def perturb_blocks(frames: DataFrame, grid: int, sigma: float, seed: int, low_cut: float = 0.0, power: float = 1.0, clip_k: float = 0.0, tubelet: int = 2) -> DataFrame:
    """Every block and channel perturbed over its whole DCT by frequency-weighted, softly clipped noise; clipped and rounded.

    The noise of a block's channel is keyed by the seed mix of frame, segment (``tubelet``
    frames), block row, block column and channel, beside 64 bits of the video's name.
    The transform is linear: the noise alone is turned back, for all blocks of equal-sized
    frames at once, and added to the pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, t in by_size(pa.Table.from_batches([batch])):
                ys, xs = edges(h, grid), edges(w, grid)
                place = lambda cut: np.concatenate([np.arange(s) / max(1, s - 1) for s in np.diff(cut)])
                g = (place(ys)[:, None] + place(xs)) / 2
                weight = np.exp(-(np.maximum(0, (g - low_cut) / max(1e-6, 1 - low_cut)) ** power))
                noise = np.zeros((len(t), 3, h, w))
                video = np.repeat(named_keys(seed, t["video_id"].to_pylist())[:, 1], 3)
                frame, channel = np.repeat(t["frame_idx"].to_numpy().astype(np.int64), 3), np.tile(np.arange(3), len(t))
                for b in range(grid * grid):
                    i, j = divmod(b, grid)
                    size = (int(ys[i + 1] - ys[i]), int(xs[j + 1] - xs[j]))
                    if size[0] * size[1]:
                        named = np.stack([frame, frame // tubelet, np.full_like(frame, i), np.full_like(frame, j), channel], axis=1)
                        mixed = seed_mix(np.full(len(frame), seed, np.uint64), named)
                        drawn = stream_normals(size[0] * size[1], np.stack([mixed, video], axis=1), *np.zeros((3, len(frame)), np.int64))
                        noise[:, :, ys[i] : ys[i + 1], xs[j] : xs[j + 1]] = drawn.reshape(len(t), 3, *size)
                noise *= sigma
                if clip_k > 0:
                    noise = clip_k * np.tanh(noise / clip_k)
                x = colours(t, h, w) / 255 + side_by_side(h, grid).T @ (weight * noise) @ side_by_side(w, grid)
                whole = np.round(np.clip(x, 0, 1) * 255).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in NAMES), pa.array(list(whole.reshape(len(t), -1)), pa.list_(pa.int32()))], [*NAMES, "rgb"])

    return frames.select("video_id", "frame_idx", "height", "width", "rgb").mapInArrow(run, f"{RUNS}, rgb array<int>")


@lru_cache(256)
def weights_between(size: int, lo: int, hi: int, full: int, pad: int = 0, out: int | None = None) -> np.ndarray:
    """[out, size]: rows ``pad`` .. ``pad + full`` interpolate linearly, pixel centres aligned, between positions lo .. hi of a side; other rows are zero."""
    y = np.clip((np.arange(full) + 0.5) * (hi - lo) / full - 0.5, 0, hi - lo - 1)
    y0 = np.floor(y).astype(int)
    m = np.zeros((full if out is None else out, size))
    rows = pad + np.arange(full)
    np.add.at(m, (rows, lo + y0), 1 - (y - y0))
    np.add.at(m, (rows, lo + np.minimum(y0 + 1, hi - lo - 1)), y - y0)
    return m


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest whole number, halves up; what is a half but for rounding noise counts as one."""
    return np.floor(x + 0.5 + 1e-9)


def letterbox_geometry(height: Column, width: Column, target: int) -> dict[str, Column]:
    """Scale, new size and centred pads that fit a frame into a square; sizes round half to even."""
    scale = F.lit(float(target)) / F.greatest(height, width)
    nh, nw = F.bround(height * scale).cast("int"), F.bround(width * scale).cast("int")
    top, left = F.floor((target - nh) / 2).cast("int"), F.floor((target - nw) / 2).cast("int")
    return {"scale": scale, "new_h": nh, "new_w": nw, "top": top, "left": left, "bottom": target - nh - top, "right": target - nw - left}


def fitted(h: int, w: int, target: int) -> tuple[int, int, int, int]:
    """New size and pads of a frame in a square."""
    s = target / max(h, w)
    nh, nw = round(h * s), round(w * s)
    return nh, nw, (target - nh) // 2, (target - nw) // 2


def sized(t: pa.Table, *names: str) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Rows of a table by the values of some whole-number columns."""
    values = np.stack([t[n].to_numpy() for n in names], axis=1)
    for v in np.unique(values, axis=0):
        yield tuple(v.tolist()), t.filter(pa.array((values == v).all(1)))


def resampled(frames: DataFrame, matrices: Callable[..., tuple[np.ndarray, np.ndarray]], sizes: tuple[str, ...], column: str) -> DataFrame:
    """Frames through one pair of matrices a combination of ``sizes``: rows @ frame @ columns, for all such frames of a batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, t in sized(pa.Table.from_batches([batch]), *sizes):
                rows, columns = matrices(*size)
                out = nearest(rows @ images(t[column], size[0], size[1]).astype(float) @ columns.T).astype(np.int32)
                n = pa.array(np.full(len(t), out.shape[1], np.int32)), pa.array(np.full(len(t), out.shape[2], np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * out[0].size), pa.array(out.ravel()))
                yield from pa.Table.from_arrays([t["video_id"], t["frame_idx"], *n, lists], [*NAMES, column]).to_batches()

    return frames.select("video_id", "frame_idx", *sizes, column).mapInArrow(run, f"{RUNS}, {column} array<int>")


def letterbox(frames: DataFrame, target: int, column: str = "v") -> DataFrame:
    """Frames resampled into a zero-padded square."""

    def matrices(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        nh, nw, top, left = fitted(h, w, target)
        return weights_between(h, 0, h, nh, top, target), weights_between(w, 0, w, nw, left, target)

    return resampled(frames, matrices, ("height", "width"), column)


def unletterbox(frames: DataFrame, column: str = "v") -> DataFrame:
    """Frames cut out of their square and resampled to ``full_h`` x ``full_w``."""

    def matrices(h: int, w: int, full_h: int, full_w: int) -> tuple[np.ndarray, np.ndarray]:
        nh, nw, top, left = fitted(full_h, full_w, h)
        return weights_between(h, top, top + nh, full_h), weights_between(w, left, left + nw, full_w)

    return resampled(frames, matrices, ("height", "width", "full_h", "full_w"), column)


def count_failures(frames: DataFrame, truth: DataFrame) -> DataFrame:
    """(video_id, n_frames, n_truth, reason) of videos whose frames can't stand beside the ground truth: another number of them, or other places."""
    of = lambda df, side: df.select("video_id", "frame_idx", F.lit(side).alias("side"))
    both = of(frames, 0).unionByName(of(truth, 1)).groupBy("video_id", "frame_idx").agg(F.sum(1 - F.col("side")).alias("a"), F.sum("side").alias("b"))
    n = both.groupBy("video_id").agg(F.sum("a").alias("n_frames"), F.sum("b").alias("n_truth"), F.sum((F.col("a") != F.col("b")).cast("int")).alias("apart"))
    reason = F.when(F.col("n_frames") != F.col("n_truth"), "frame count").when(F.col("apart") > 0, "frame places")
    return n.withColumn("reason", reason).where("reason is not null").select("video_id", "n_frames", "n_truth", "reason")


def match_size(frames: DataFrame, truth: DataFrame, column: str = "v") -> DataFrame:
    """Frames brought to the size of the ground truth: (…, column, resized). Only rows of another size go through Python."""
    sizes = truth.select("video_id", "frame_idx", F.col("height").alias("full_h"), F.col("width").alias("full_w"))
    rows = frames.select("video_id", "frame_idx", "height", "width", column).join(sizes, ["video_id", "frame_idx"])
    same = (F.col("height") == F.col("full_h")) & (F.col("width") == F.col("full_w"))
    matrices = lambda h, w, full_h, full_w: (weights_between(h, 0, h, full_h), weights_between(w, 0, w, full_w))
    changed = resampled(rows.where(~same), matrices, ("height", "width", "full_h", "full_w"), column)
    return rows.where(same).select("video_id", "frame_idx", "height", "width", column, F.lit(False).alias("resized")).unionByName(changed.withColumn("resized", F.lit(True)))


def aligned(frames: DataFrame, truth: DataFrame, column: str = "v") -> DataFrame:
    """As ``match_size``, for the videos without a failure of ``count_failures``; those are left out whole."""
    bad = count_failures(frames, truth).select("video_id")
    return match_size(frames.join(bad, "video_id", "left_anti"), truth.join(bad, "video_id", "left_anti"), column)


def warp(frames: DataFrame, column: str = "v") -> DataFrame:
    """Frames gathered at (x - dx, y - dy) of the flow arrays ``dx`` and ``dy``, mirrored at the border with the edge repeated.

    All frames of a size and batch are gathered at once, from four neighbours with their weights.
    """

    def mirrored(i: np.ndarray, n: int) -> np.ndarray:
        i = i % (2 * n)
        return np.where(i < n, i, 2 * n - 1 - i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, w, t in by_size(pa.Table.from_batches([batch])):
                x, dy, dx = (images(t[c], h, w).astype(float) for c in (column, "dy", "dx"))
                at_y, at_x = np.arange(h)[:, None] - dy, np.arange(w) - dx
                y, x0 = np.floor(at_y).astype(np.int64), np.floor(at_x).astype(np.int64)
                fy, fx = at_y - y, at_x - x0
                frame = np.arange(len(t))[:, None, None]
                row = lambda i: (1 - fx) * x[frame, i, mirrored(x0, w)] + fx * x[frame, i, mirrored(x0 + 1, w)]  # noqa: B023, E731
                out = nearest((1 - fy) * row(mirrored(y, h)) + fy * row(mirrored(y + 1, h))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * (h * w)), pa.array(out.ravel()))
                yield from pa.Table.from_arrays([*(t[c] for c in NAMES), lists], [*NAMES, column]).to_batches()

    return frames.select("video_id", "frame_idx", "height", "width", "dx", "dy", column).mapInArrow(run, f"{RUNS}, {column} array<int>")
