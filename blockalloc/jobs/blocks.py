"""Queries over frames and blocks: scores, masks, errors, release."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.jobs import cues as U
from blockalloc.jobs.statistics import rounded
from blockalloc.operators import blocks as K
from blockalloc.operators import integrity as I
from blockalloc.operators import release as R
from blockalloc.sources.views import PIXELS_SQL, frames, pixels, rgb, stored_frames

TOP = 4
#: Frames whose pixels a task holds as numbers at once where it only sums them up.
FRAMES_AT_ONCE = 512


def grays(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).withColumn("gray", F.transform("v", lambda v: K.gray(*rgb(v))))


def motion(spark: SparkSession, d: str, grid: int = 4) -> DataFrame:
    """Motion scores, clipped between quantiles: gray, difference, block mean, quantile clip."""
    return K.quantile_clip(K.motion_blocks(grays(spark, d), grid))


def at_sql(i: str, grid: int, length: int = 8) -> str:
    q, r = divmod(length, grid)
    return f"CAST(CASE WHEN {i} < {r * (q + 1)} THEN {i} // {q + 1} ELSE {r} + ({i} - {r * (q + 1)}) // {q} END AS INTEGER)"


def raw_sql(grid: int) -> str:
    return f"""{PIXELS_SQL},
gray AS (SELECT video_id, frame_idx, y, x, round(0.299e0 * v + 0.587e0 * (v * 3 % 256) + 0.114e0 * (v * 7 % 256)) AS g FROM pixels),
near AS (SELECT *, lag(g) OVER w AS p, lead(g) OVER w AS n FROM gray WINDOW w AS (PARTITION BY video_id, y, x ORDER BY frame_idx)),
raw AS (SELECT video_id, frame_idx, {at_sql('y', grid)} AS bi, {at_sql('x', grid)} AS bj,
               avg(CASE WHEN p IS NULL AND n IS NULL THEN 0 WHEN p IS NULL THEN abs(n - g) WHEN n IS NULL THEN abs(g - p) ELSE (abs(g - p) + abs(n - g)) / 2 END) AS score
        FROM near GROUP BY ALL)"""


def scores_sql(grid: int = 4) -> str:
    return f"""{raw_sql(grid)},
q AS (SELECT video_id, quantile_cont(score, 0.02) AS lo, quantile_cont(score, 0.98) AS hi FROM raw GROUP BY 1),
scores AS (SELECT video_id, frame_idx, bi, bj, CASE WHEN hi > lo + 1e-8 THEN least(1, greatest(0, (score - lo) / (hi - lo))) ELSE score END AS score FROM raw JOIN q USING (video_id))"""


def mask_sql(name: str = "mask", source: str = "scores", k: int = TOP) -> str:
    # scores are rounded before they are ranked, in both engines, so that no rounding noise decides a tie
    return f"{name} AS (SELECT video_id, frame_idx, bi, bj FROM {source} QUALIFY row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY round(score, 9) DESC, bi DESC, bj DESC) <= {k})"


def steady(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


def mask(spark: SparkSession, d: str, grid: int = 4) -> DataFrame:
    return K.top_blocks(steady(motion(spark, d, grid)), TOP)


def backend(f: DataFrame) -> DataFrame:
    """Frames as another stage would return them: a fixed pattern added."""
    return f.withColumn("back", F.transform("v", lambda v, i: F.least(F.lit(255), v + i % 5)))


def block_means(t: pa.Table, h: int, w: int, grid: int) -> np.ndarray:
    """Backend frames of one size with each selected block replaced by its rounded mean."""
    x = K.images(t["back"], h, w).astype(float)
    sums, n = K.block_sums(x, grid)
    chosen = np.zeros((len(t), grid * grid), bool)
    for i, bs in enumerate(t["blocks"].to_pylist()):
        chosen[i, bs or []] = True
    ys, xs = np.diff(K.edges(h, grid)), np.diff(K.edges(w, grid))
    mean = np.floor(sums / np.maximum(n, 1) + 0.5).repeat(ys, axis=1).repeat(xs, axis=2)
    return np.where(chosen.reshape(-1, grid, grid).repeat(ys, axis=1).repeat(xs, axis=2), mean, x)


def block_mean_release(f: DataFrame, grid: int) -> DataFrame:
    """Backend frames with each selected block replaced by its rounded mean, as array ``out``."""

    def run(batches):
        for b in batches:
            for h, w, t in K.by_size(pa.Table.from_batches([b])):
                x = block_means(t, h, w, grid)
                yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("video_id", "frame_idx", "height", "width", "v", "back")), pa.array(list(x.reshape(len(t), -1).astype(np.int32)), pa.list_(pa.int32()))], ["video_id", "frame_idx", "height", "width", "v", "back", "out"])

    return f.select("video_id", "frame_idx", "height", "width", "v", "back", "blocks").mapInArrow(run, f"{R.RUNS}, v array<int>, back array<int>, out array<int>")


def release_errors(f: DataFrame, grid: int) -> DataFrame:
    """The errors of ``block_mean_release`` against raw frames (``v``), in one step.

    A task has one Python worker instead of two, no released frame leaves it, and frames
    are taken ``FRAMES_AT_ONCE`` at a time, so that its memory follows neither the table nor a batch.
    """

    def run(batches):
        for b in batches:
            for at in range(0, len(b), FRAMES_AT_ONCE):
                for h, w, t in K.by_size(pa.Table.from_batches([b.slice(at, FRAMES_AT_ONCE)])):
                    d = block_means(t, h, w, grid) - K.images(t["v"], h, w)
                    sums, n = K.block_sums(d * d, grid)
                    yield from K.exploded(t["video_id"], t["frame_idx"].to_numpy(), grid, n_px=np.broadcast_to(n, sums.shape).astype(np.int64).copy(), sse=3 * sums).to_batches()

    return f.select("video_id", "frame_idx", "height", "width", "v", "back", "blocks").mapInArrow(run, "video_id string, frame_idx int, bi int, bj int, n_px long, sse double")


def chosen_blocks(m: DataFrame, grid: int) -> DataFrame:
    return m.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.col("bi") * grid + F.col("bj"))).alias("blocks"))


def released(spark: SparkSession, d: str, m: DataFrame, grid: int = 4) -> DataFrame:
    return block_mean_release(backend(frames(spark, d)).join(chosen_blocks(m, grid), ["video_id", "frame_idx"], "left"), grid)


def errors(rel: DataFrame, against: str, grid: int = 4) -> DataFrame:
    """Squared error by block against raw (``v``) or backend (``back``) frames; three equal channels."""
    e = K.block_errors(rel.withColumnRenamed("out", "a").withColumnRenamed(against, "b"), grid)
    return e.withColumn("sse", 3 * F.col("sse"))


def released_sql(grid: int = 4) -> str:
    return f"""{scores_sql(grid)}, {mask_sql()},
back AS (SELECT video_id, frame_idx, y, x, v, least(255, v + (y * 8 + x) % 5) AS b, {at_sql('y', grid)} AS bi, {at_sql('x', grid)} AS bj FROM pixels),
rel AS (SELECT back.*, CASE WHEN mask.bi IS NULL THEN b ELSE floor(avg(b) OVER (PARTITION BY video_id, frame_idx, bi, bj) + 0.5) END AS o, mask.bi IS NOT NULL AS m FROM back LEFT JOIN mask USING (video_id, frame_idx, bi, bj))"""


def region_sql(against: str) -> str:
    return f"""s AS (SELECT video_id, sum(CASE WHEN m THEN 3 * (o - {against}) ** 2 ELSE 0 END) AS hs, sum(CASE WHEN m THEN 0 ELSE 3 * (o - {against}) ** 2 END) AS ls, sum(3 * (o - {against}) ** 2) AS ts,
  3 * sum(CASE WHEN m THEN 1 ELSE 0 END) AS hn, 3 * sum(CASE WHEN m THEN 0 ELSE 1 END) AS ln, 3 * count(*) AS tn FROM rel GROUP BY 1),
r AS (SELECT video_id, hn / tn AS area, hs / greatest(hn, 1) AS h, ls / greatest(ln, 1) AS l, ts / tn AS t, CASE WHEN ts > 1e-12 THEN hs / ts ELSE 'NaN' END AS share FROM s),
region AS (SELECT video_id, round(area, 6) AS area, round({psnr_sql('t')}, 6) AS total_mse_psnr, round({psnr_sql('h')}, 6) AS high_psnr, round({psnr_sql('l')}, 6) AS low_psnr, round(share, 6) AS distortion_share,
  round(CASE WHEN area > 0 THEN share / area ELSE 'NaN' END, 6) AS distortion_lift, round(CASE WHEN l > 1e-12 THEN h / l ELSE 'Infinity' END, 6) AS high_low_mse_ratio FROM r)"""


def psnr_sql(mse: str) -> str:
    return f"CASE WHEN {mse} <= 1e-12 THEN 'Infinity' ELSE 20 * log10(255e0) - 10 * log10({mse}) END"


def e16(spark, d):
    return rounded(K.shifted(motion(spark, d), 4))


def e17(spark: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    """Key-hashed random score maps; any frame's map can be made by itself."""
    s = (motion(spark, d) if cells is None else cells).select("video_id", "frame_idx", "bi", "bj")
    return s.withColumn("score", F.round(K.hashed_uniform(F.lit("42"), "video_id", *(F.col(c).cast("string") for c in ("frame_idx", "bi", "bj"))), 6))


def e18(spark: SparkSession, d: str) -> DataFrame:
    s = steady(motion(spark, d))
    cells = s.select("video_id", "frame_idx", "bi", "bj", K.pixel_area(F.col("bi"), F.col("bj"), 8, 8, 4).alias("n_px"))
    return rounded(K.alignment(K.top_blocks(K.shifted(s, 4), TOP), K.top_blocks(s, TOP), cells))


def e19(spark: SparkSession, d: str) -> DataFrame:
    m = mask(spark, d)
    return rounded(K.region_error(errors(released(spark, d, m), "v"), m))


def e20(spark: SparkSession, d: str) -> DataFrame:
    """Share of the error inside the motion mask, against raw and against backend frames."""
    m = mask(spark, d)
    rel = released(spark, d, m)
    both = errors(rel, "v").withColumnRenamed("sse", "raw").join(errors(rel, "back").select("video_id", "frame_idx", "bi", "bj", F.col("sse").alias("inc")), ["video_id", "frame_idx", "bi", "bj"])
    out = [K.region_error(both, m, sse=c).select("video_id", F.col("distortion_share").alias(f"{c}_errshare")) for c in ("raw", "inc")]
    return rounded(out[0].join(out[1], "video_id"))


def e21(spark: SparkSession, d: str) -> DataFrame:
    """Mean PSNR over frames, of finite ones."""
    e = errors(released(spark, d, mask(spark, d)), "v").groupBy("video_id", "frame_idx").agg((F.sum("sse") / (3 * F.sum("n_px"))).alias("mse"))
    p = K.psnr(F.col("mse"))
    return rounded(e.groupBy("video_id").agg(F.avg(F.when(p < float("inf"), p)).alias("psnr")))


def e22(spark: SparkSession, d: str) -> DataFrame:
    f = released(spark, d, mask(spark, d)).select("video_id", "frame_idx", F.array("v").alias("a"), F.array("out").alias("b"))
    return rounded(K.error_map(f).select("video_id", "frame_idx", F.posexplode("e").alias("pos", "e")))


def given_maps(spark: SparkSession, d: str) -> DataFrame:
    """Motion maps as arrays a frame, of which some videos have one for all frames, one frame too few or a value too few."""
    m = motion(spark, d).groupBy("video_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("bi", "bj", "score"))), lambda x: x["score"]).alias("values"))
    kind = F.substring("video_id", 2, 9).cast("int") % 5
    m = m.where((kind > 1) | ((kind == 0) & (F.col("frame_idx") == 0)) | ((kind == 1) & (F.col("frame_idx") > 0)))
    return m.select("video_id", F.when(kind != 0, F.col("frame_idx")).alias("frame_idx"), F.when(kind == 2, F.slice("values", 1, 15)).otherwise(F.col("values")).alias("values"))


POLICIES = ("motion", "random", "semantic", "fusion", "trajectory", "shifted_fusion", "shifted_trajectory")


def policies(spark: SparkSession, d: str) -> DataFrame:
    """Score maps of the seven policies, with the offset of the shifted ones."""
    m = motion(spark, d).checkpoint()  # the shifted policies and the random one read what others have made
    found = {"motion": m, "random": e17(spark, d, m)} | {name: x.checkpoint() for name, x in U.policy_maps(spark, d).items()}
    none = F.lit(None).cast("int")
    rows = [(name, df, none) for name, df in found.items()] + [(f"shifted_{name}", K.shifted(found[name], 4), F.lit(1)) for name in ("fusion", "trajectory")]
    out = None
    for name, df, by in rows:
        df = df.select("video_id", "frame_idx", "bi", "bj", "score", F.lit(name).alias("policy"), by.alias("offset_row"), by.alias("offset_col"))
        out = df if out is None else out.unionByName(df)
    return out


RANDOM_SQL = "round(CAST(CAST('0x' || sha256('42|' || video_id || '|' || frame_idx || '|' || bi || '|' || bj)[1:13] AS UBIGINT) AS DOUBLE) / 4503599627370496e0, 6)"


def policies_sql() -> str:
    given = [(name, name) for name in ("semantic", "fusion", "trajectory")]
    parts = [f"SELECT video_id, frame_idx, bi, bj, score, '{name}' AS policy, CAST(NULL AS INTEGER) AS moved FROM {source}" for name, source in [("motion", "scores"), *given]]
    parts.append(f"SELECT video_id, frame_idx, bi, bj, {RANDOM_SQL}, 'random', NULL FROM scores")
    parts += [f"SELECT video_id, frame_idx, CAST((bi + 1) % 4 AS INTEGER), CAST((bj + 1) % 4 AS INTEGER), score, 'shifted_{name}', 1 FROM {name}" for name in ("fusion", "trajectory")]
    motion_views = scores_sql(4).replace(PIXELS_SQL + ",", "", 1)
    return f"{U.POLICY_MAPS_SQL}, {motion_views}, pol AS ({' UNION ALL '.join(parts)})"


def e24(spark: SparkSession, d: str) -> DataFrame:
    """One row a run (a policy on a video): where its error fell and how its mask lies, against motion, trajectory and own masks, with short names."""
    keys = ["video_id", "policy"]
    # the masks are read eight times below
    own = K.top_blocks(steady(policies(spark, d).select(*keys, *K.CELL, "score")), TOP, keys).checkpoint()
    every = lambda name: own.where(F.col("policy") == name).drop("policy").withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES))))
    motion_mask, rat = every("motion"), every("trajectory")
    # a run goes through the release as a video of its own
    run = F.concat_ws("/", *keys)
    f = frames(spark, d).withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES)))).withColumn("video_id", run)
    blocks = chosen_blocks(own.withColumn("video_id", run), 4)
    name = F.split("video_id", "/")
    e = release_errors(backend(f).join(blocks, ["video_id", "frame_idx"], "left"), 4).withColumns({"policy": name[1], "video_id": name[0]}).checkpoint()
    cells = e.select(*keys, *K.CELL, "n_px")
    parts = {"motion_": K.region_error(e, motion_mask, keys), "rat_region_": K.region_error(e, rat, keys), "own_region_": K.region_error(e, own, keys)}
    parts |= {"motion_alignment_": K.alignment(own, motion_mask, cells, keys), "rat_alignment_": K.alignment(own, rat, cells, keys)}
    out = None
    for prefix, df in parts.items():
        df = df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))
        out = df if out is None else out.join(df, keys)
    return rounded(out.withColumns({"cover": F.col("motion_alignment_reference_coverage"), "raw_errshare": F.col("motion_distortion_share")}))


def e24_sql() -> str:
    sums = ", ".join(f"sum(CASE WHEN {m} THEN e ELSE 0 END) AS {m}_s, sum(CASE WHEN {m} THEN 1 ELSE 0 END) AS {m}_n" for m in ("own", "motion", "rat"))
    both = ", ".join(f"sum(CASE WHEN own AND {m} THEN 1 ELSE 0 END) AS {m}_i" for m in ("motion", "rat"))
    columns = {}
    for m, prefix in (("motion", "motion_"), ("rat", "rat_region_"), ("own", "own_region_")):
        area, share = f"({m}_n / t_n)", f"(CASE WHEN t_s > 1e-12 THEN {m}_s / t_s ELSE 'NaN' END)"
        high, low = f"({m}_s / greatest(3 * {m}_n, 1))", f"((t_s - {m}_s) / greatest(3 * (t_n - {m}_n), 1))"
        columns |= {prefix + "area": area, prefix + "total_mse_psnr": psnr_sql("(t_s / (3 * t_n))"), prefix + "high_psnr": psnr_sql(high), prefix + "low_psnr": psnr_sql(low), prefix + "distortion_share": share}
        columns |= {prefix + "distortion_lift": f"CASE WHEN {area} > 0 THEN {share} / {area} ELSE 'NaN' END", prefix + "high_low_mse_ratio": f"CASE WHEN {low} > 1e-12 THEN {high} / {low} ELSE 'Infinity' END"}
    for m in ("motion", "rat"):
        prefix, recall = f"{m}_alignment_", f"({m}_i / greatest({m}_n, 1))"
        columns |= {prefix + "candidate_area": "own_n / t_n", prefix + "reference_area": f"{m}_n / t_n", prefix + "reference_coverage": recall, prefix + "candidate_precision": f"{m}_i / greatest(own_n, 1)"}
        columns |= {prefix + "iou": f"{m}_i / greatest(own_n + {m}_n - {m}_i, 1)", prefix + "coverage_lift": f"CASE WHEN own_n > 0 THEN {recall} / (own_n / t_n) ELSE 'NaN' END"}
    columns |= {"cover": columns["motion_alignment_reference_coverage"], "raw_errshare": columns["motion_distortion_share"]}
    on = "m.video_id = p.video_id AND m.frame_idx = p.frame_idx AND m.bi = p.bi AND m.bj = p.bj AND m.policy"
    marks = ", ".join(f"EXISTS (SELECT 1 FROM masks m WHERE {on} = {who}) AS {name}" for name, who in (("own", "p.policy"), ("motion", "'motion'"), ("rat", "'trajectory'")))
    return f"""WITH {policies_sql()}, masks AS (SELECT policy, video_id, frame_idx, bi, bj FROM pol QUALIFY row_number() OVER (PARTITION BY policy, video_id, frame_idx ORDER BY round(score, 9) DESC, bi DESC, bj DESC) <= {TOP}),
p AS (SELECT k.policy, video_id, frame_idx, {at_sql('y', 4)} AS bi, {at_sql('x', 4)} AS bj, v, least(255, v + (y * 8 + x) % 5) AS b FROM (SELECT DISTINCT policy FROM pol) k, pixels),
marked AS (SELECT p.*, {marks} FROM p), out_ AS (SELECT *, 3 * (CASE WHEN own THEN floor(avg(b) OVER (PARTITION BY policy, video_id, frame_idx, bi, bj) + 0.5) ELSE b END - v) ** 2 AS e FROM marked),
tot AS (SELECT video_id, policy, sum(e) AS t_s, count(*) AS t_n, {sums}, {both} FROM out_ GROUP BY ALL)
SELECT video_id, policy, {', '.join(f'round({x}, 6) AS {c}' for c, x in columns.items())} FROM tot"""


def with_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = chosen_blocks(mask(spark, d), 4)
    planes = F.concat("v", F.transform("v", lambda v: v * 3 % 256), F.transform("v", lambda v: v * 7 % 256))
    return frames(spark, d).withColumn("rgb", planes).join(m, ["video_id", "frame_idx"])


BASIS = "(CASE WHEN {k} = 0 THEN sqrt(0.5e0) ELSE cos(pi() * (2 * {i} + 1) / 4e0) END)"
LUMA = "(0.299e0 * v + 0.587e0 * (v * 3 % 256) + 0.114e0 * (v * 7 % 256)) / CASE WHEN top > 1 THEN 255 ELSE 1 END"


def query_sql(clip: float) -> str:
    """2 x 2 blocks: all four coefficients of the transform."""
    parts = ", ".join(f"sum(l * {BASIS.format(k=a, i='(y % 2)')} * {BASIS.format(k=b, i='(x % 2)')}) AS q{a}{b}" for a in (0, 1) for b in (0, 1))
    return f"""{scores_sql(4)}, {mask_sql()},
luma AS (SELECT *, {LUMA} AS l, {at_sql('y', 4)} AS bi, {at_sql('x', 4)} AS bj FROM (SELECT *, max(greatest(v, v * 3 % 256, v * 7 % 256)) OVER (PARTITION BY video_id, frame_idx) AS top FROM pixels)),
co AS (SELECT video_id, frame_idx, CAST(bi * 4 + bj AS INTEGER) AS block, {parts} FROM luma JOIN mask USING (video_id, frame_idx, bi, bj) GROUP BY ALL),
sc AS (SELECT *, least(1, {clip}e0 / (sqrt(q00 ** 2 + q01 ** 2 + q10 ** 2 + q11 ** 2) + 1e-6)) AS scale FROM co)"""


def f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.low_frequency_queries(with_blocks(spark, d), 4, 1.0))


def f2(spark: SparkSession, d: str) -> DataFrame:
    """The release without noise: what is deterministic in it."""
    r = R.release(with_blocks(spark, d), 4, 1.0, 0.0)
    return r.select("video_id", "frame_idx", F.aggregate("rgb", F.lit(0), lambda a, x: a + x).alias("total"), F.round(F.array_max("scales"), 6).alias("scale"))


def f2_noise(spark: SparkSession, d: str) -> DataFrame:
    r = R.release(with_blocks(spark, d), 4, 1.0, 2.0)
    return r.select("video_id", "frame_idx", F.sha2(F.array_join("rgb", ","), 256).alias("digest"))


def f3_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Released frames whose noise one generator a video draws in order."""
    r = R.release_in_order(with_blocks(spark, d), 4, 1.0, 2.0)
    return r.select("video_id", "frame_idx", F.sha2(F.array_join("rgb", ","), 256).alias("digest"))


def plain(f: DataFrame, column: str = "v") -> DataFrame:
    return f.select("video_id", "frame_idx", "height", "width", F.sha2(F.array_join(column, ","), 256).alias("digest"))


def e1_bounds(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("video_id").distinct().select("video_id", F.explode(F.array(*map(F.lit, (3, 4, 14)))).alias("parts"))
    rows = [f.where(F.col("parts") == p).select("video_id", "parts", F.inline(K.bounds(L, p)), F.lit(L).alias("length")) for p in (3, 4, 14) for L in (8, 240)]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def channel_sql(c: str) -> str:
    return f"floor(least(1, greatest(0, {c})) * 255 + 1e-9)"


RELEASE_SQL = f"""WITH {query_sql(1.0)}, c AS (SELECT *, v / 255e0 AS r, (v * 3 % 256) / 255e0 AS g, (v * 7 % 256) / 255e0 AS b, CAST({at_sql('y', 4)} * 4 + {at_sql('x', 4)} AS INTEGER) AS block FROM pixels),
j AS (SELECT video_id, frame_idx, scale, coalesce(scale, 1) * (0.299e0 * r + 0.587e0 * g + 0.114e0 * b) AS l, CASE WHEN scale IS NULL THEN -0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b ELSE 0 END AS cb,
  CASE WHEN scale IS NULL THEN 0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b ELSE 0 END AS cr FROM c LEFT JOIN sc USING (video_id, frame_idx, block))
SELECT video_id, frame_idx, CAST(sum({channel_sql('l + 1.402e0 * cr')} + {channel_sql('l - 0.344136e0 * cb - 0.714136e0 * cr')} + {channel_sql('l + 1.772e0 * cb')}) AS INTEGER) AS total, round(max(scale), 6) AS scale FROM j GROUP BY ALL"""


def recurrence_sql(carry: str, out: str) -> str:
    """Digests of frames after a recurrence: ``carry`` from r.carry and s.v, ``out`` from carry."""
    return f"""WITH RECURSIVE {PIXELS_SQL.strip()}, rec AS (SELECT video_id, frame_idx, y, x, CAST(v AS DOUBLE) AS carry FROM pixels WHERE frame_idx = 0
  UNION ALL SELECT s.video_id, s.frame_idx, s.y, s.x, {carry} FROM rec r JOIN pixels s ON s.video_id = r.video_id AND s.y = r.y AND s.x = r.x AND s.frame_idx = r.frame_idx + 1)
SELECT video_id, frame_idx, 8 AS height, 8 AS width, sha256(string_agg(CAST(CAST({out} AS INTEGER) AS VARCHAR), ',' ORDER BY y, x)) AS digest FROM rec GROUP BY video_id, frame_idx"""


EMA_SQL = recurrence_sql("0.4e0 * r.carry + 0.6e0 * s.v", "least(255, greatest(0, round_even(carry, 0)))")
ONCE = "round_even(0.72e0 * s.v + (1 - 0.72e0) * r.carry, 0)"
CAUSAL_SQL = recurrence_sql(f"least(255, greatest(0, round_even(0.82e0 * {ONCE} + (1 - 0.82e0) * r.carry, 0)))", "carry")



def axis_sql(name: str, size: int, out: int) -> str:
    """Where each of ``out`` positions stands between two of ``size``."""
    at = f"least({size - 1}, greatest(0, (i + 0.5e0) * {size} / {out}e0 - 0.5e0))"
    return f"{name} AS (SELECT CAST(i AS INTEGER) AS i, CAST(floor({at}) AS INTEGER) AS lo, CAST(least({size - 1}, floor({at}) + 1) AS INTEGER) AS hi, {at} - floor({at}) AS f FROM (SELECT unnest(range({out})) AS i))"


def resize_sql(name: str, source: str, size: int, out: int) -> str:
    """Square frames as lists, from one size to another."""
    row = lambda r: f"((1 - b.f) * v[a.{r} * {size} + b.lo + 1] + b.f * v[a.{r} * {size} + b.hi + 1])"
    value = f"CAST(floor((1 - a.f) * {row('lo')} + a.f * {row('hi')} + 0.5e0 + 1e-9) AS INTEGER)"
    return f"{axis_sql(name + '_axis', size, out)}, {name} AS (SELECT video_id, frame_idx, list({value} ORDER BY a.i, b.i) AS v FROM {source}, {name}_axis a, {name}_axis b GROUP BY ALL)"


LISTS_SQL = "lists AS (SELECT video_id, frame_idx, list(v ORDER BY y, x) AS v FROM pixels GROUP BY ALL)"
DIGEST = "sha256(array_to_string(v, ','))"


def truth_kinds(f: DataFrame) -> DataFrame:
    """Frames in another size, of which some videos lack the first and some are one place late."""
    kind = F.substring("video_id", 2, 9).cast("int") % 3
    return f.where((kind != 0) | (F.col("frame_idx") > 0)).withColumn("frame_idx", F.when(kind == 1, F.col("frame_idx") + 1).otherwise(F.col("frame_idx")))


def warped(spark: SparkSession, d: str) -> DataFrame:
    return R.warp(frames(spark, d).withColumns({"dx": F.transform("v", lambda v, i: (i % 5 - 2) * 0.5), "dy": F.transform("v", lambda v, i: (i % 3 - 1) * 0.75)}))


def warp_sql() -> str:
    mirrored = lambda k: f"(CASE WHEN ({k} + 16) % 16 < 8 THEN ({k} + 16) % 16 ELSE 15 - ({k} + 16) % 16 END)"
    at = lambda j, i: f"v[{mirrored(f'(y0 + {j})')} * 8 + {mirrored(f'(x0 + {i})')} + 1]"
    row = lambda j: f"((1 - fx) * {at(j, 0)} + fx * {at(j, 1)})"
    return f"""WITH {PIXELS_SQL}, {LISTS_SQL}, p AS (SELECT i, i // 8 - (i % 3 - 1) * 0.75e0 AS ay, i % 8 - (i % 5 - 2) * 0.5e0 AS ax FROM (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)),
    q AS (SELECT i, CAST(floor(ay) AS INTEGER) AS y0, CAST(floor(ax) AS INTEGER) AS x0, ay - floor(ay) AS fy, ax - floor(ax) AS fx FROM p),
    o AS (SELECT video_id, frame_idx, list(CAST(floor((1 - fy) * {row(0)} + fy * {row(1)} + 0.5e0 + 1e-9) AS INTEGER) ORDER BY i) AS v FROM lists, q GROUP BY ALL)
    SELECT video_id, frame_idx, 8 AS height, 8 AS width, {DIGEST} AS digest FROM o"""


def in_order_scores(spark: SparkSession, d: str) -> DataFrame:
    """Random maps of all videos as one generator a video draws them."""
    counted = frames(spark, d).groupBy("video_id").agg((F.max("frame_idx") + 1).alias("frames"))
    return K.random_maps(counted, 4)


def stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored frames beside a list of videos that names one more after each label."""
    raw = stored_frames(spark, d)
    number = F.substring("video_id", 2, 9).cast("int")
    some = raw.select("video_id").distinct()
    return I.frame_table(raw, some.unionByName(some.select(F.concat(F.lit("v"), (number + 1).cast("string")).alias("video_id"))))


STORED_SQL = f"""WITH {PIXELS_SQL}, s AS (SELECT video_id, frame_idx, unhex(string_agg(printf('%02X%02X%02X', v, v * 3 % 256, v * 7 % 256), '' ORDER BY y, x)) AS rgb, CAST(substring(video_id, 2) AS INTEGER) % 4 AS kind FROM pixels GROUP BY ALL)
SELECT video_id, frame_idx, 8 AS height, 8 AS width, CASE WHEN kind = 0 THEN 29.97e0 ELSE 25e0 END AS fps, CAST(octet_length(rgb) AS INTEGER) AS n_bytes, sha256(rgb) AS digest FROM s"""

P, S4 = f"WITH {PIXELS_SQL}", f"WITH {scores_sql(4)}"
CELLS = "video_id, frame_idx, bi, bj, round(score, 6) AS score"
YCC_SQL = "WITH {p}, c AS (SELECT *, v / 255e0 AS r, (v * 3 % 256) / 255e0 AS g, (v * 7 % 256) / 255e0 AS b FROM pixels)"
ALIGN_SQL = """c AS (SELECT 1 AS c, * FROM cand), r AS (SELECT 1 AS r, * FROM ref), j AS (SELECT s.video_id, coalesce(c, 0) AS c, coalesce(r, 0) AS r FROM scores s LEFT JOIN c USING (video_id, frame_idx, bi, bj) LEFT JOIN r USING (video_id, frame_idx, bi, bj)),
a AS (SELECT video_id, 4 * sum(c) AS c, 4 * sum(r) AS r, 4 * sum(c * r) AS i, 4 * count(*) AS t FROM j GROUP BY 1)"""

QUERIES = {
    "a3_score_cells": (
        lambda s, d: rounded(motion(s, d).groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("bi", "bj", "score"))).alias("m")).select("video_id", "frame_idx", F.posexplode(F.transform("m", lambda x: x["score"])).alias("pos", "score")).selectExpr("video_id", "frame_idx", "cast(pos div 4 as int) bi", "pos % 4 bj", "score")),
        f"{S4} SELECT {CELLS} FROM scores",
    ),
    "a4_static_masks": (
        lambda s, d: mask(s, d).where("frame_idx = 0").drop("frame_idx").join(frames(s, d).select("video_id", "frame_idx"), "video_id"),
        f"{S4}, {mask_sql()} SELECT m.video_id, f.frame_idx, m.bi, m.bj FROM mask m JOIN f ON f.video_id = m.video_id WHERE m.frame_idx = 0",
    ),
    "a3_shape_failures": (
        lambda s, d: K.shape_failures(given_maps(s, d), frames(s, d), 4),
        f"""WITH {PIXELS_SQL}, n AS (SELECT video_id, CAST(substring(video_id, 2) AS INTEGER) % 5 AS kind, count(*) AS n FROM f GROUP BY 1)
        SELECT video_id, n - 1 AS n_maps, n AS n_frames, CAST(0 AS BIGINT) AS n_bad, 'frame count' AS reason FROM n WHERE kind = 1 AND n > 1 UNION ALL SELECT video_id, n, n, n, 'map size' FROM n WHERE kind = 2""",
    ),
    "a4_map_cells": (
        lambda s, d: rounded(K.map_cells(given_maps(s, d), frames(s, d), 4)),
        f"""{S4} SELECT {CELLS} FROM scores WHERE CAST(substring(video_id, 2) AS INTEGER) % 5 > 2
        UNION ALL SELECT s.video_id, f.frame_idx, bi, bj, round(score, 6) FROM scores s JOIN f ON f.video_id = s.video_id WHERE s.frame_idx = 0 AND CAST(substring(s.video_id, 2) AS INTEGER) % 5 = 0""",
    ),
    "a5_frames": (
        lambda s, d: frames(s, d).select("video_id", "frame_idx", "height", "width", F.lit(25.0).alias("fps"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")),
        f"{P} SELECT video_id, frame_idx, 8 AS height, 8 AS width, 25e0 AS fps, CAST(sum(v) AS BIGINT) AS total FROM pixels GROUP BY 1, 2",
    ),
    "a5_stored_frames": (lambda s, d: stored(s, d)[0].select("video_id", "frame_idx", "height", "width", "fps", F.length("rgb").alias("n_bytes"), F.sha2("rgb", 256).alias("digest")), STORED_SQL),
    "a5_frame_failures": (
        lambda s, d: stored(s, d)[1],
        "WITH v AS (SELECT DISTINCT label AS v FROM embeddings WHERE label IS NOT NULL) SELECT DISTINCT 'v' || CAST(v + 1 AS VARCHAR) AS video_id, 'no frames' AS error FROM v WHERE v + 1 NOT IN (SELECT v FROM v)",
    ),
    "e1_block_bounds": (
        e1_bounds,
        """WITH v AS (SELECT DISTINCT 'v' || CAST(label AS VARCHAR) AS video_id FROM embeddings), g AS (SELECT * FROM v, (VALUES (3), (4), (14)) p(parts), (VALUES (8), (240)) l(length)),
        b AS (SELECT *, unnest(range(parts)) AS b FROM g) SELECT video_id, CAST(parts AS INTEGER) AS parts, CAST(b AS INTEGER) AS b, CAST(b * (length // parts) + least(b, length % parts) AS INTEGER) AS lo, CAST((b + 1) * (length // parts) + least(b + 1, length % parts) AS INTEGER) AS hi, CAST(length AS INTEGER) AS length FROM b""",
    ),
    "e1_block_of_pixel": (
        lambda s, d: pixels(frames(s, d)).groupBy("video_id", K.block_of(F.col("y"), 8, 3).alias("bi"), K.block_of(F.col("x"), 8, 3).alias("bj")).agg(F.count("*").alias("n")),
        f"{P} SELECT video_id, {at_sql('y', 3)} AS bi, {at_sql('x', 3)} AS bj, count(*) AS n FROM pixels GROUP BY ALL",
    ),
    "e2_gray": (lambda s, d: grays(s, d).select("video_id", "frame_idx", F.aggregate("gray", F.lit(0.0), lambda a, x: a + x).alias("total")), f"WITH {raw_sql(4)} SELECT video_id, frame_idx, sum(g) AS total FROM gray GROUP BY ALL"),
    "e3_colour": (
        lambda s, d: rounded(pixels(frames(s, d)).select("video_id", "frame_idx", "y", "x", *(c.alias(n) for n, c in zip(("luma", "cb", "cr"), R.to_ycc(*(c / 255 for c in rgb())), strict=True)))),
        f"{YCC_SQL.format(p=PIXELS_SQL)} SELECT video_id, frame_idx, y, x, round(least(1, greatest(0, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b)), 6) AS luma, round(least(1, greatest(0, -0.168736e0 * r - 0.331264e0 * g + 0.5e0 * b + 0.5e0)), 6) AS cb, round(least(1, greatest(0, 0.5e0 * r - 0.418688e0 * g - 0.081312e0 * b + 0.5e0)), 6) AS cr FROM c",
    ),
    "e3_colour_back": (
        lambda s, d: rounded(pixels(frames(s, d)).select("video_id", "frame_idx", "y", "x", *(c.alias(n) for n, c in zip("rgb", R.from_ycc(*(c / 255 for c in rgb())), strict=True)))),
        f"{YCC_SQL.format(p=PIXELS_SQL)} SELECT video_id, frame_idx, y, x, round(least(1, greatest(0, r + 1.402e0 * (b - 0.5))), 6) AS r, round(least(1, greatest(0, r - 0.344136e0 * (g - 0.5) - 0.714136e0 * (b - 0.5))), 6) AS g, round(least(1, greatest(0, r + 1.772e0 * (g - 0.5))), 6) AS b FROM c",
    ),
    "e4_letterbox_geometry": (
        lambda s, d: rounded(s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") * 7 + 50).alias("h"), (F.col("p_size") * 5 + 90).alias("w")).select("p_partkey", *(c.alias(n) for n, c in R.letterbox_geometry(F.col("h"), F.col("w"), 224).items()))),
        """WITH g AS (SELECT p_partkey, p_size * 7 + 50 AS h, p_size * 5 + 90 AS w, 224e0 / greatest(p_size * 7 + 50, p_size * 5 + 90) AS scale FROM part), n AS (SELECT *, CAST(round_even(h * scale, 0) AS INTEGER) AS new_h, CAST(round_even(w * scale, 0) AS INTEGER) AS new_w FROM g),
        t AS (SELECT *, CAST((224 - new_h) // 2 AS INTEGER) AS top, CAST((224 - new_w) // 2 AS INTEGER) AS l FROM n) SELECT p_partkey, round(scale, 6) AS scale, new_h, new_w, top, l AS "left", CAST(224 - new_h - top AS INTEGER) AS bottom, CAST(224 - new_w - l AS INTEGER) AS "right" FROM t""",
    ),
    "e5_letterbox": (lambda s, d: plain(R.letterbox(frames(s, d), 14)), f"WITH {PIXELS_SQL}, {LISTS_SQL}, {resize_sql('box', 'lists', 8, 14)} SELECT video_id, frame_idx, 14 AS height, 14 AS width, {DIGEST} AS digest FROM box"),
    "e5_letterbox_restore": (
        lambda s, d: plain(R.unletterbox(R.letterbox(frames(s, d), 16).withColumns({"full_h": F.lit(8), "full_w": F.lit(8)}))),
        f"WITH {PIXELS_SQL}, {LISTS_SQL}, {resize_sql('box', 'lists', 8, 16)}, {resize_sql('back', 'box', 16, 8)} SELECT video_id, frame_idx, 8 AS height, 8 AS width, {DIGEST} AS digest FROM back",
    ),
    "e6_aligned": (
        lambda s, d: (lambda f: R.aligned(truth_kinds(R.letterbox(f, 12)), f).select("video_id", "frame_idx", "height", "width", F.sha2(F.array_join("v", ","), 256).alias("digest"), "resized"))(frames(s, d)),
        f"WITH {PIXELS_SQL}, {LISTS_SQL}, {resize_sql('box', 'lists', 8, 12)}, {resize_sql('back', 'box', 12, 8)} SELECT video_id, frame_idx, 8 AS height, 8 AS width, {DIGEST} AS digest, true AS resized FROM back WHERE CAST(substring(video_id, 2) AS INTEGER) % 3 = 2",
    ),
    "e6_count_failures": (
        lambda s, d: (lambda f: R.count_failures(truth_kinds(f), f))(frames(s, d)),
        f"""WITH {PIXELS_SQL}, n AS (SELECT video_id, CAST(substring(video_id, 2) AS INTEGER) % 3 AS kind, count(*) AS n FROM f GROUP BY 1)
        SELECT video_id, CAST(n - 1 + kind AS BIGINT) AS n_frames, n AS n_truth, CASE kind WHEN 0 THEN 'frame count' ELSE 'frame places' END AS reason FROM n WHERE kind < 2""",
    ),
    "e6_match_size": (lambda s, d: R.match_size(R.letterbox(frames(s, d), 12).unionByName(frames(s, d).where("frame_idx = 0")), frames(s, d)).select("video_id", "frame_idx", "height", "width", "resized"), f"WITH {PIXELS_SQL} SELECT video_id, frame_idx, 8 AS height, 8 AS width, true AS resized FROM f UNION ALL SELECT video_id, frame_idx, 8, 8, false FROM f WHERE frame_idx = 0"),
    "e7_channel_normalisation": (
        lambda s, d: rounded(pixels(frames(s, d)).groupBy("video_id", "frame_idx").agg(*(F.avg((c / 255 - m) / sd).alias(n) for n, c, m, sd in zip("rgb", rgb(), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), strict=True)))),
        f"{P} SELECT video_id, frame_idx, round(avg((v / 255e0 - 0.485e0) / 0.229e0), 6) AS r, round(avg((v * 3 % 256 / 255e0 - 0.456e0) / 0.224e0), 6) AS g, round(avg((v * 7 % 256 / 255e0 - 0.406e0) / 0.225e0), 6) AS b FROM pixels GROUP BY ALL",
    ),
    "e8_e9_motion_block_mean": (lambda s, d: rounded(K.motion_blocks(grays(s, d), 3)), f"WITH {raw_sql(3)} SELECT {CELLS} FROM raw"),
    "e10_quantile_clip": (lambda s, d: rounded(K.quantile_clip(K.motion_blocks(grays(s, d), 3))), f"WITH {scores_sql(3)} SELECT {CELLS} FROM scores"),
    "e11_robust_normalise": (
        lambda s, d: rounded(K.quantile_clip(K.motion_blocks(grays(s, d), 4), low=0.05, high=0.95, clip_degenerate=True)),
        f"WITH {raw_sql(4)}, q AS (SELECT video_id, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM raw GROUP BY 1) SELECT video_id, frame_idx, bi, bj, round(CASE WHEN hi - lo >= 1e-8 THEN least(1, greatest(0, (score - lo) / (hi - lo))) ELSE least(1, greatest(0, score)) END, 6) AS score FROM raw JOIN q USING (video_id)",
    ),
    "e12_min_max": (
        lambda s, d: rounded(K.min_max(K.motion_blocks(grays(s, d), 4), ["video_id"])),
        f"WITH {raw_sql(4)} SELECT video_id, frame_idx, bi, bj, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8), 6) AS score FROM raw WINDOW w AS (PARTITION BY video_id)",
    ),
    "e13_motion_reference": (lambda s, d: rounded(motion(s, d)), f"{S4} SELECT {CELLS} FROM scores"),
    "e14_top_blocks": (mask, f"{S4}, {mask_sql()} SELECT * FROM mask"),
    "e14_top_blocks_array": (
        lambda s, d: K.top_blocks_array(steady(motion(s, d)).groupBy("video_id", "frame_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("bi", "bj", "score"))), lambda x: x["score"]).alias("scores")), TOP).select("video_id", "frame_idx", F.explode("blocks").alias("b")).selectExpr("video_id", "frame_idx", "cast(b div 4 as int) bi", "b % 4 bj"),
        f"{S4}, {mask_sql()} SELECT * FROM mask",
    ),
    "e15_mask_area": (
        lambda s, d: K.top_blocks(steady(motion(s, d, 3)), TOP).groupBy("video_id").agg(F.sum(K.pixel_area(F.col("bi"), F.col("bj"), 8, 8, 3)).alias("area")),
        f"WITH {scores_sql(3)}, {mask_sql()} SELECT video_id, CAST(sum((CASE WHEN bi < 2 THEN 3 ELSE 2 END) * (CASE WHEN bj < 2 THEN 3 ELSE 2 END)) AS BIGINT) AS area FROM mask GROUP BY 1",
    ),
    "e16_cyclic_shift": (e16, f"{S4} SELECT video_id, frame_idx, CAST((bi + 1) % 4 AS INTEGER) AS bi, CAST((bj + 1) % 4 AS INTEGER) AS bj, round(score, 6) AS score FROM scores"),
    "e17_random_scores": (
        e17,
        f"{S4} SELECT video_id, frame_idx, bi, bj, round(CAST(CAST('0x' || sha256('42|' || video_id || '|' || frame_idx || '|' || bi || '|' || bj)[1:13] AS UBIGINT) AS DOUBLE) / 4503599627370496e0, 6) AS score FROM scores",
    ),
    "e17_random_scores_in_order": (in_order_scores, None),
    "e18_alignment": (
        e18,
        f"{S4}, sh AS (SELECT video_id, frame_idx, (bi + 1) % 4 AS bi, (bj + 1) % 4 AS bj, score FROM scores), {mask_sql('cand', 'sh')}, {mask_sql('ref')}, {ALIGN_SQL} SELECT video_id, round(c / t, 6) AS candidate_area, round(r / t, 6) AS reference_area, round(i / r, 6) AS reference_coverage, round(i / c, 6) AS candidate_precision, round(i / (c + r - i), 6) AS iou, round(i / r / (c / t), 6) AS coverage_lift FROM a",
    ),
    "e19_region_error": (e19, f"WITH {released_sql()}, {region_sql('v')} SELECT * FROM region"),
    "e20_error_shares": (
        e20,
        f"WITH {released_sql()} SELECT video_id, round(sum(CASE WHEN m THEN (o - v) ** 2 ELSE 0 END) / sum((o - v) ** 2), 6) AS raw_errshare, round(CASE WHEN sum((o - b) ** 2) > 0 THEN sum(CASE WHEN m THEN (o - b) ** 2 ELSE 0 END) / sum((o - b) ** 2) ELSE 'NaN' END, 6) AS inc_errshare FROM rel GROUP BY 1",
    ),
    "e21_frame_psnr": (e21, f"WITH {released_sql()}, m AS (SELECT video_id, frame_idx, avg((o - v) ** 2) AS mse FROM rel GROUP BY ALL) SELECT video_id, round(avg({psnr_sql('mse')}) FILTER (mse > 1e-12), 6) AS psnr FROM m GROUP BY 1"),
    "e22_error_map": (
        e22,
        f"WITH {released_sql()}, e AS (SELECT video_id, frame_idx, CAST(y * 8 + x AS INTEGER) AS pos, abs(o - v) AS e FROM rel), eq AS (SELECT video_id, frame_idx, quantile_cont(e, 0.98) AS q FROM e GROUP BY ALL) SELECT video_id, frame_idx, pos, round(least(1, e / CASE WHEN q > 1e-6 THEN q ELSE 1 END), 6) AS e FROM e JOIN eq USING (video_id, frame_idx)",
    ),
    "e23_peak_frame": (
        lambda s, d: rounded(K.peak_frame(motion(s, d))),
        f"{S4}, t AS (SELECT video_id, frame_idx, round(sum(score), 9) AS total FROM scores GROUP BY ALL) SELECT video_id, frame_idx, round(total, 6) AS total FROM t QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY total DESC, frame_idx) = 1",
    ),
    "e24_run_rows": (e24, e24_sql()),
    "c7_policy_scores": (lambda s, d: rounded(policies(s, d)), f"WITH {policies_sql()} SELECT {CELLS}, policy, moved AS offset_row, moved AS offset_col FROM pol"),
    "f1_low_frequency_query": (f1, f"WITH {query_sql(1.0)} SELECT video_id, frame_idx, block, round(q00 * scale, 6) AS q00, round(q01 * scale, 6) AS q01, round(q10 * scale, 6) AS q10, round(q11 * scale, 6) AS q11, round(scale, 6) AS scale FROM sc"),
    "f2_release_without_noise": (f2, RELEASE_SQL),
    "f2_f3_release_with_noise": (f2_noise, None),
    "f3_release_in_order": (f3_in_order, None),
    "f4_temporal_ema": (lambda s, d: plain(R.temporal_ema(frames(s, d), 0.4)), EMA_SQL),
    "f9_full_block_perturbation": (lambda s, d: plain(R.perturb_blocks(with_blocks(s, d), 3, 0.1, 42, 0.18, 2.0, 1.0), "rgb"), None),
    "d9_clip_scales": (
        lambda s, d: rounded(R.low_frequency_queries(with_blocks(s, d), 4, 1.0).groupBy("video_id").agg(F.avg("scale").alias("avg_clip_scale"), F.count("*").alias("selected_blocks"), F.count_distinct("frame_idx").alias("frames"))),
        f"WITH {query_sql(1.0)} SELECT video_id, round(avg(scale), 6) AS avg_clip_scale, count(*) AS selected_blocks, count(DISTINCT frame_idx) AS frames FROM sc GROUP BY 1",
    ),
    "g22_causal_smoothing": (lambda s, d: plain(R.causal_smoothing(frames(s, d))), CAUSAL_SQL),
    "g23_warp": (lambda s, d: plain(warped(s, d)), warp_sql()),
}
