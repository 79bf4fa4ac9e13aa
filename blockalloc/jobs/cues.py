"""Queries over clips, cues and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.jobs.statistics import nine, rounded
from blockalloc.operators import cues as C
from blockalloc.operators import release as R
from blockalloc.operators.blocks import quantile_clip
from blockalloc.sources.views import FLOWS_SQL, MANIFEST_SQL, PIXELS_SQL, TOKENS_SQL, flows, frames, manifest, tokens

GRID, IMAGE, TUBELET = 4, 8, 2
ONLY = {"attn": 1.0, "temp": 0.0, "tex": 0.0, "flow": 0.0}


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Mean flow of each segment (two flows, one at the clip's end) and block."""
    return flows(spark, d).groupBy("video_id", "clip_idx", F.floor(F.col("flow_idx") / TUBELET).cast("int").alias("u"), "b").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))


SEGMENTS_SQL = "seg AS (SELECT video_id, clip_idx, CAST(flow_idx // 2 AS INTEGER) AS u, b, avg(dx) AS dx, avg(dy) AS dy FROM flows GROUP BY ALL)"


def cue_table(spark: SparkSession, d: str) -> DataFrame:
    """Cue columns by segment and block, from the flows."""
    f = segments(spark, d)
    return f.select("video_id", "clip_idx", "u", F.floor(F.col("b") / GRID).cast("int").alias("bi"), (F.col("b") % GRID).alias("bj"), F.round("dx", 6).alias("attn"), F.round("dy", 6).alias("temp"), F.round(F.col("dx") * F.col("dy"), 6).alias("tex"), F.round(F.col("dx") + F.col("dy"), 6).alias("flow"))


CUE_TABLE_SQL = """cues AS (SELECT video_id, clip_idx, u, CAST(b // 4 AS INTEGER) AS bi, CAST(b % 4 AS INTEGER) AS bj, round(dx, 6) AS attn, round(dy, 6) AS temp, round(dx * dy, 6) AS tex, round(dx + dy, 6) AS flow FROM seg)"""
CUES_SQL = f"{FLOWS_SQL}, {SEGMENTS_SQL}, {CUE_TABLE_SQL}"


def risk(spark: SparkSession, d: str, digits: int = 6) -> DataFrame:
    """(…, u, block, score) in 0..1, from the flows."""
    return segments(spark, d).select("video_id", "clip_idx", "u", F.col("b").alias("block"), C.unit(F.round(0.5 + F.col("dx") / 32, digits)).alias("score"))


RISK_SQL = f"{SEGMENTS_SQL}, risk AS (SELECT video_id, clip_idx, u, b AS block, least(1, greatest(0, round(0.5e0 + dx / 32, 6))) AS score FROM seg)"


def maps(spark: SparkSession, d: str) -> DataFrame:
    r = risk(spark, d, 4)  # four digits: halves and quarters of them never end between two roundings
    return r.select("video_id", "clip_idx", "u", F.floor(F.col("block") / GRID).cast("int").alias("bi"), (F.col("block") % GRID).alias("bj"), "score")


MAPS_SQL = f"{FLOWS_SQL}, {RISK_SQL.replace('32, 6', '32, 4')}, maps AS (SELECT video_id, clip_idx, u, CAST(block // 4 AS INTEGER) AS bi, CAST(block % 4 AS INTEGER) AS bj, score FROM risk)"


def mirror_sql(i: str, n: int = GRID) -> str:
    return f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN {2 * (n - 1)} - ({i}) ELSE {i} END)"


def smooth_sql(source: str, name: str, keys: str = "video_id, clip_idx, u", clamp: bool = True) -> str:
    mean = "sum(s.score) / 9"
    on = " AND ".join(f"s.{k.strip()} = t.{k.strip()}" for k in keys.split(","))
    out = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""{name} AS (SELECT {out}, t.bi, t.bj, {f'least(1, greatest(0, {mean}))' if clamp else mean} AS score FROM {source} t, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), {source} s
      WHERE {on} AND s.bi = {mirror_sql('t.bi + dy')} AND s.bj = {mirror_sql('t.bj + dx')} GROUP BY ALL)"""


def fuse_sql(weights: dict[str, float], name: str = "fused") -> str:
    w = "(PARTITION BY video_id, clip_idx)"
    norm = ", ".join(f"({n} - min({n}) OVER {w}) / (max({n}) OVER {w} - min({n}) OVER {w} + 1e-8) AS {n}" for n in weights)
    total = " + ".join(f"{v}e0 * {n}" for n, v in weights.items())
    return f"""{name}_1 AS (SELECT video_id, clip_idx, u, bi, bj, {norm} FROM cues), {name}_2 AS (SELECT video_id, clip_idx, u, bi, bj, {total} AS s FROM {name}_1),
    {name}_3 AS (SELECT video_id, clip_idx, u, bi, bj, least(1, greatest(0, (s - min(s) OVER {w}) / (max(s) OVER {w} - min(s) OVER {w} + 1e-8))) AS score FROM {name}_2), {smooth_sql(f'{name}_3', name)}"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Moves, with flows rounded first so that no rounding noise decides a nearest block."""
    f = flows(spark, d).withColumns({"dx": F.round("dx", 4), "dy": F.round("dy", 4)})
    return C.next_block(f, IMAGE, GRID, TUBELET)


NEXT_SQL = f"""{FLOWS_SQL}, m AS (SELECT video_id, clip_idx, CAST(flow_idx // 2 + 1 AS INTEGER) AS u, b, avg(round(dx, 4)) AS dx, avg(round(dy, 4)) AS dy FROM flows WHERE flow_idx // 2 + 1 < 8 GROUP BY ALL),
step AS (SELECT m.video_id, m.clip_idx, m.u, m.b, CAST(c AS INTEGER) AS dest, exp(-sqrt(dx ** 2 + dy ** 2) / 12) AS conf FROM m, (SELECT unnest(range(16)) AS c)
  QUALIFY row_number() OVER (PARTITION BY m.video_id, m.clip_idx, m.u, m.b ORDER BY round((2 * (c % 4) - 2 * (m.b % 4) - dx) ** 2 + (2 * (c // 4) - 2 * (m.b // 4) - dy) ** 2, 9), c) = 1)"""
WALK_SQL = f"""RECURSIVE {NEXT_SQL.strip()}, walk AS (SELECT DISTINCT video_id, clip_idx, t AS traj_id, 0 AS u, t AS block FROM step, (SELECT CAST(unnest(range(16)) AS INTEGER) AS t)
  UNION ALL SELECT w.video_id, w.clip_idx, w.traj_id, w.u + 1, s.dest FROM walk w JOIN step s ON s.video_id = w.video_id AND s.clip_idx = w.clip_idx AND s.u = w.u + 1 AND s.b = w.block)"""
SCORE_SQL = f"""{WALK_SQL}, {RISK_SQL}, v AS (SELECT w.video_id, w.clip_idx, traj_id, list_sort(list(score), 'DESC') AS v FROM walk w JOIN risk r ON r.video_id = w.video_id AND r.clip_idx = w.clip_idx AND r.u = w.u AND r.block = w.block GROUP BY ALL),
ts AS (SELECT video_id, clip_idx, traj_id, least(1, greatest(0, 0.6e0 * list_avg(v) + 0.4e0 * list_avg(v[1:greatest(1, CAST(ceil(0.25e0 * len(v)) AS BIGINT))]))) AS score FROM v),
tw AS (SELECT *, exp(4 * score) / sum(exp(4 * score)) OVER (PARTITION BY video_id, clip_idx) AS weight FROM ts)"""
SCATTER_SQL = f"""{SCORE_SQL}, sm AS (SELECT w.video_id, w.clip_idx, w.u, w.block, avg(weight) AS score FROM walk w JOIN tw ON tw.video_id = w.video_id AND tw.clip_idx = w.clip_idx AND tw.traj_id = w.traj_id GROUP BY ALL),
cell AS (SELECT DISTINCT w.video_id, w.clip_idx, w.u, c AS block FROM walk w, (SELECT CAST(unnest(range(16)) AS INTEGER) AS c)),
full_ AS (SELECT video_id, clip_idx, u, CAST(block // 4 AS INTEGER) AS bi, CAST(block % 4 AS INTEGER) AS bj, least(1, greatest(0, coalesce(score, 0))) AS score FROM cell LEFT JOIN sm USING (video_id, clip_idx, u, block)), {smooth_sql('full_', 'rawmap')}"""


def walk(spark: SparkSession, d: str) -> DataFrame:
    return C.along(C.paths(steps(spark, d), GRID))


def weights(spark: SparkSession, d: str, w: DataFrame | None = None) -> DataFrame:
    return C.softmax_weights(C.path_scores(walk(spark, d) if w is None else w, risk(spark, d), 0.6), 4.0)


def raw_map(spark: SparkSession, d: str) -> DataFrame:
    w = walk(spark, d).checkpoint()  # read by the weights and below
    return C.scatter_mean(w, weights(spark, d, w), GRID)


def trajectory_map(spark: SparkSession, d: str) -> DataFrame:
    moves = steps(spark, d).checkpoint()  # read by the walk and by the confidence
    w = C.along(C.paths(moves, GRID)).checkpoint()  # read three times
    raw = C.scatter_mean(w, weights(spark, d, w), GRID)
    return C.path_smoothing(w, raw, C.confidence(moves, base=0.0), 0.25, GRID)


TRAJECTORY_SQL = f"""{SCATTER_SQL}, cf AS (SELECT video_id, clip_idx, u, dest AS block, greatest(0, max(conf)) AS c FROM step GROUP BY ALL),
pw AS (SELECT w.video_id, w.clip_idx, w.traj_id, w.u, w.block, m.score AS w, coalesce(cf.c, 1) AS c FROM walk w JOIN rawmap m ON m.video_id = w.video_id AND m.clip_idx = w.clip_idx AND m.u = w.u AND m.bi * 4 + m.bj = w.block
  LEFT JOIN cf ON cf.video_id = w.video_id AND cf.clip_idx = w.clip_idx AND cf.u = w.u AND cf.block = w.block),
bars AS (SELECT video_id, clip_idx, traj_id, u, block, w AS bar FROM pw WHERE u = 0 UNION ALL SELECT p.video_id, p.clip_idx, p.traj_id, p.u, p.block, 0.25e0 * p.c * p.w + (1 - 0.25e0 * p.c) * b.bar
  FROM bars b JOIN pw p ON p.video_id = b.video_id AND p.clip_idx = b.clip_idx AND p.traj_id = b.traj_id AND p.u = b.u + 1),
mb AS (SELECT video_id, clip_idx, u, block, avg(bar) AS bar FROM bars GROUP BY ALL),
sb AS (SELECT m.video_id, m.clip_idx, m.u, m.bi, m.bj, least(1, greatest(0, coalesce(bar, score))) AS score FROM rawmap m LEFT JOIN mb ON mb.video_id = m.video_id AND mb.clip_idx = m.clip_idx AND mb.u = m.u AND mb.block = m.bi * 4 + m.bj), {smooth_sql('sb', 'done')}"""


def clip_frames(spark: SparkSession, d: str) -> DataFrame:
    return C.to_frames(maps(spark, d), TUBELET, 16)


def frames_sql(source: str, p: str = "") -> str:
    """Maps of segments between frames, and weighted sums over overlapping clips; ``p`` begins the names."""
    return f"""{p}top AS (SELECT video_id, clip_idx, max(u) AS top FROM {source} GROUP BY ALL), {p}tt AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS local_i),
{p}fs AS (SELECT a.video_id, a.clip_idx, local_i, a.bi, a.bj, (1 - (local_i / 2e0 - local_i // 2)) * a.score + (local_i / 2e0 - local_i // 2) * b.score AS score FROM {p}tt, {p}top
  JOIN {source} a USING (video_id, clip_idx) JOIN {source} b ON b.video_id = a.video_id AND b.clip_idx = a.clip_idx AND b.bi = a.bi AND b.bj = a.bj WHERE a.u = least(local_i // 2, top) AND b.u = least(local_i // 2 + 1, top)),
{p}wf AS (SELECT *, clip_idx * 8 + local_i AS frame_idx, greatest(0, 1 - abs(local_i - 7.5e0) / 7.5e0) ** 1.7e0 AS w FROM {p}fs),
{p}mg AS (SELECT video_id, CAST(frame_idx AS INTEGER) AS frame_idx, bi, bj, sum(w * score) AS ws, sum(w) AS w, avg(score) AS plain FROM {p}wf GROUP BY ALL)"""


MERGED = "least(1, greatest(0, CASE WHEN w > 0 THEN ws / greatest(w, 1e-6) ELSE coalesce(lag(ws) OVER (PARTITION BY video_id, bi, bj ORDER BY frame_idx), 0) END))"
FRAMES_SQL = f"{MAPS_SQL}, {frames_sql('maps')}"


def covered(spark: SparkSession, d: str) -> DataFrame:
    """Frame counts of the videos, two more than the clips cover."""
    return flows(spark, d).groupBy("video_id").agg((F.max("clip_idx") * 8 + 18).alias("frames"))


def g5(keys: list[str]):
    return lambda s, d: rounded(C.centrality(tokens(s, d), ["video_id", "clip_idx", "u", *keys]))


def g5_sql(keys: str) -> str:
    on = "".join(f" AND a.{k.strip()} = b.{k.strip()}" for k in keys.split(",") if k)
    out = "".join(f", {k.strip()}" for k in keys.split(",") if k)
    outa = "".join(f", a.{k.strip()}" for k in keys.split(",") if k)
    return f"""WITH {TOKENS_SQL}, s AS (SELECT a.video_id, a.clip_idx, a.u{outa}, a.py AS ay, a.px AS ax, exp(list_cosine_similarity(a.vec, b.vec) / 0.2e0) AS e FROM tokens a JOIN tokens b ON a.video_id = b.video_id AND a.clip_idx = b.clip_idx AND a.u = b.u{on}),
    p AS (SELECT *, e / sum(e) OVER (PARTITION BY video_id, clip_idx, u{out}, ay, ax) AS p FROM s) SELECT video_id, clip_idx, u{out}, CAST(sqrt(count(*)) AS INTEGER) AS n_tokens, round(least(1, greatest(0, avg(p))), 6) AS score FROM p GROUP BY ALL"""


def sigma_maps(spark: SparkSession, d: str) -> DataFrame:
    n = quantile_clip(maps(spark, d), ["video_id", "clip_idx"], 0.05, 0.95, clip_degenerate=True)
    return n.withColumn("score", R.sigma_of_weight(F.col("score"), 0.1, 0.6, 1.5, invert=True))


SIGMA_SQL = f"""{MAPS_SQL}, qq AS (SELECT video_id, clip_idx, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM maps GROUP BY ALL),
sig AS (SELECT video_id, clip_idx, u, bi, bj, 0.1e0 + 0.5e0 * (1 - CASE WHEN hi - lo >= 1e-8 THEN least(1, greatest(0, (score - lo) / (hi - lo))) ELSE score END) ** 1.5e0 AS score FROM maps JOIN qq USING (video_id, clip_idx))"""


def f7(spark: SparkSession, d: str) -> DataFrame:
    v = manifest(spark, d).select("class").distinct()
    a = v.select("class", F.lit("exponential").alias("kind"), F.inline(R.frequency_weights(4, 6, 0.18, 2.0)))
    b = v.select("class", F.lit("cosine").alias("kind"), F.inline(R.radial_ramp(5, 1.0, 4.0)))
    c = v.select("class", F.lit("linear").alias("kind"), F.inline(R.radial_ramp(5, 1.0, 4.0, cosine=False, dc_zero=False)))
    return rounded(a.unionByName(b).unionByName(c))


def f7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Frequency weights of blocks whose size follows each video's length."""
    v = manifest(spark, d).select("video_id", (F.col("frames") % 5 + 1).alias("height"), (F.col("frames") % 7 + 1).alias("width"))
    return rounded(v.select("video_id", "height", "width", F.inline(R.frequency_weights(F.col("height"), F.col("width"), 0.18, 2.0))))


F7_SIZES_SQL = f"""WITH {MANIFEST_SQL}, v AS (SELECT video_id, CAST(frames % 5 + 1 AS INTEGER) AS height, CAST(frames % 7 + 1 AS INTEGER) AS width FROM manifest),
g AS (SELECT *, CAST(i // width AS INTEGER) AS y, CAST(i % width AS INTEGER) AS x FROM (SELECT *, unnest(range(height * width)) AS i FROM v))
SELECT video_id, height, width, y, x, round(exp(-(greatest(0, ((CAST(y AS DOUBLE) / greatest(1, height - 1) + CAST(x AS DOUBLE) / greatest(1, width - 1)) / 2 - 0.18e0) / 0.82e0) ** 2)), 6) AS weight FROM g"""


F7_SQL = f"""WITH {MANIFEST_SQL}, v AS (SELECT DISTINCT class FROM manifest), a AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS i), g AS (SELECT p.i AS y, q.i AS x FROM a p, a q),
k AS (SELECT 'exponential' AS kind, y, x, exp(-(greatest(0, ((y / 3e0 + x / 5e0) / 2 - 0.18e0) / 0.82e0) ** 2)) AS weight FROM g WHERE y < 4
 UNION ALL SELECT 'cosine', y, x, CASE WHEN y + x = 0 THEN 0 ELSE 0.5e0 - 0.5e0 * cos(pi() * least(1, greatest(0, (sqrt(y * y + x * x) - 1) / 3e0))) END FROM g WHERE y < 5 AND x < 5
 UNION ALL SELECT 'linear', y, x, least(1, greatest(0, (sqrt(y * y + x * x) - 1) / 3e0)) FROM g WHERE y < 5 AND x < 5)
SELECT class, kind, y, x, round(weight, 6) AS weight FROM v, k"""

SOBEL_SQL = f"""WITH {PIXELS_SQL}, o AS (SELECT unnest([-1, 0, 1]) AS o), t AS (SELECT p.video_id, p.frame_idx, p.y, p.x,
  sum(s.v * (ox.o * CASE WHEN oy.o = 0 THEN 2 ELSE 1 END)) AS gx, sum(s.v * (oy.o * CASE WHEN ox.o = 0 THEN 2 ELSE 1 END)) AS gy
  FROM pixels p, o oy, o ox, pixels s WHERE s.video_id = p.video_id AND s.frame_idx = p.frame_idx AND s.y = {mirror_sql('p.y + oy.o', 8)} AND s.x = {mirror_sql('p.x + ox.o', 8)} GROUP BY ALL),
  m AS (SELECT video_id, frame_idx, CAST(y // 2 AS INTEGER) AS py, CAST(x // 2 AS INTEGER) AS px, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS score FROM t GROUP BY ALL)
  SELECT video_id, frame_idx, py, px, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8), 6) AS score FROM m WINDOW w AS (PARTITION BY video_id, frame_idx)"""


def texture_cue(spark: SparkSession, d: str) -> DataFrame:
    """The texture cue of clips of eight frames, four apart, by a block of 2 x 2 patches."""
    f = frames(spark, d).withColumnRenamed("v", "gray")
    n = f.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("frames"))
    return C.texture_cue(f, C.clips(n, 8, 4).select("video_id", "clip_idx", "start_idx"), 2, 2)


TEXTURE_SQL = f"""{SOBEL_SQL.rpartition('SELECT video_id, frame_idx, py, px, round')[0].rstrip()}, z AS (SELECT video_id, frame_idx, py, px, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8) AS score FROM m WINDOW w AS (PARTITION BY video_id, frame_idx)),
  cl AS (SELECT video_id, unnest(range(0, greatest(0, CAST(ceil((max(frame_idx) + 1 - 8) / 4e0) AS BIGINT)) + 1)) AS clip_idx FROM pixels GROUP BY 1)
  SELECT cl.video_id, CAST(clip_idx AS INTEGER) AS clip_idx, CAST(py // 2 AS INTEGER) AS bi, CAST(px // 2 AS INTEGER) AS bj, round(avg(score), 6) AS score FROM cl JOIN z ON z.video_id = cl.video_id AND z.frame_idx = clip_idx * 4 GROUP BY ALL"""

MAP = "video_id, clip_idx, u, bi, bj, round(score, 6) AS score"

def merged(there: DataFrame, clip_maps: DataFrame) -> DataFrame:
    """Maps of clips as maps of the frames ``there(video_id, frame_idx)``; a frame beyond the last clip takes the last map."""
    m = C.merge_overlaps(C.to_frames(clip_maps, TUBELET, 16), 16, 8)
    last = m.groupBy("video_id").agg(F.max("frame_idx").alias("last"))
    f = there.select("video_id", F.col("frame_idx").alias("at")).join(last, "video_id")
    f = f.select("video_id", "at", F.least("at", "last").alias("frame_idx"))
    return f.join(m, ["video_id", "frame_idx"]).select("video_id", F.col("at").alias("frame_idx"), "bi", "bj", "score")


def merged_sql(name: str, source: str) -> str:
    p = f"{name}_"
    return f"""{frames_sql(source, p)}, {p}all AS (SELECT video_id, frame_idx, bi, bj, {MERGED} AS score FROM {p}mg), {p}last AS (SELECT video_id, max(frame_idx) AS last FROM {p}all GROUP BY 1),
{name} AS (SELECT f.video_id, f.frame_idx, a.bi, a.bj, a.score FROM f JOIN {p}last l ON l.video_id = f.video_id JOIN {p}all a ON a.video_id = f.video_id AND a.frame_idx = least(f.frame_idx, l.last))"""


def policy_maps(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The three policies that come from cues: one cue alone, all fused, and along trajectories."""
    # the embeddings are numbered once for the cues and once for the frames, which all policies read
    cues, there = cue_table(spark, d).checkpoint(), frames(spark, d).select("video_id", "frame_idx").checkpoint()
    found = {"semantic": C.fuse(cues, GRID, ONLY), "fusion": C.fuse(cues, GRID), "trajectory": trajectory_map(spark, d)}
    return {name: merged(there, m) for name, m in found.items()}


#: To follow WITH, in front of the views of frames: three policies by frame.
POLICY_MAPS_SQL = f"""{TRAJECTORY_SQL}, {PIXELS_SQL}, {CUE_TABLE_SQL}, {fuse_sql(ONLY, 'one')}, {fuse_sql(C.WEIGHTS, 'every')},
{merged_sql('semantic', 'one')}, {merged_sql('fusion', 'every')}, {merged_sql('trajectory', 'done')}"""

QUERIES = {
    "g1_clips": (
        lambda s, d: C.clips(manifest(s, d)),
        f"""WITH {MANIFEST_SQL}, c AS (SELECT video_id, frames, unnest(range(0, greatest(0, CAST(ceil((frames - 16) / 8e0) AS BIGINT)) + 1)) AS clip_idx FROM manifest), l AS (SELECT *, unnest(range(16)) AS local_i FROM c)
        SELECT video_id, CAST(clip_idx AS INTEGER) AS clip_idx, CAST(clip_idx * 8 AS INTEGER) AS start_idx, CAST(local_i AS INTEGER) AS local_i, CAST(least(clip_idx * 8 + local_i, frames - 1) AS INTEGER) AS src_frame_idx FROM l""",
    ),
    "g2_padding": (lambda s, d: manifest(s, d).select("video_id", "frames", C.padded_length(F.col("frames"), 4).alias("padded")), f"WITH {MANIFEST_SQL} SELECT video_id, frames, CAST(ceil(frames / 4e0) * 4 AS INTEGER) AS padded FROM manifest"),
    "g3_clip_vectors": (
        lambda s, d: rounded(C.clip_vectors(tokens(s, d), 0.5).select("video_id", "clip_idx", "u", "py", "px", C.norm(F.col("vec")).alias("norm"), F.col("vec")[0].alias("first"))),
        f"WITH {TOKENS_SQL}, n AS (SELECT *, sqrt(list_inner_product(vec, vec)) AS n FROM tokens) SELECT video_id, clip_idx, u, py, px, round(n * least(1, 0.5e0 / greatest(n, 1e-12)), 6) AS norm, round(vec[1] * least(1, 0.5e0 / greatest(n, 1e-12)), 6) AS first FROM n",
    ),
    "g4_temporal_change": (
        lambda s, d: rounded(C.temporal_change(tokens(s, d))),
        f"""WITH {TOKENS_SQL}, d AS (SELECT video_id, clip_idx, u, py, px, coalesce(list_distance(vec, lag(vec) OVER (PARTITION BY video_id, clip_idx, py, px ORDER BY u)), 0) AS d FROM tokens)
        SELECT video_id, clip_idx, u, py, px, round(CASE WHEN max(u) OVER w > min(u) OVER w THEN (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-8) ELSE 0 END, 6) AS score FROM d WINDOW w AS (PARTITION BY video_id, clip_idx)""",
    ),
    "g5_centrality": (g5([]), g5_sql("")),
    "g5_centrality_one_token": (g5(["py", "px"]), g5_sql("py, px")),
    "g6_flow_magnitude": (
        lambda s, d: rounded(C.flow_magnitude(flows(s, d), TUBELET, 6.0)),
        f"WITH {FLOWS_SQL} SELECT video_id, clip_idx, CAST(flow_idx // 2 AS INTEGER) AS u, b, round(least(1, avg(sqrt(dx * dx + dy * dy) / 6)), 6) AS score FROM flows GROUP BY ALL",
    ),
    "g7_texture": (lambda s, d: rounded(C.sobel_patches(frames(s, d).withColumnRenamed("v", "gray"), 2)), SOBEL_SQL),
    "g7_texture_cue": (lambda s, d: rounded(texture_cue(s, d)), TEXTURE_SQL),
    "g8_fusion": (lambda s, d: rounded(C.fuse(cue_table(s, d), GRID)), f"WITH {CUES_SQL}, {fuse_sql(C.WEIGHTS)} SELECT {MAP} FROM fused"),
    "g8_single_cue": (lambda s, d: rounded(C.fuse(cue_table(s, d), GRID, ONLY)), f"WITH {CUES_SQL}, {fuse_sql(ONLY)} SELECT {MAP} FROM fused"),
    "g9_grid_smoothing": (lambda s, d: rounded(C.smooth_grid(maps(s, d), GRID, ["video_id", "clip_idx", "u"])), f"WITH {MAPS_SQL}, {smooth_sql('maps', 'sm')} SELECT {MAP} FROM sm"),
    "g10_noisy_map": (lambda s, d: rounded(C.noisy(maps(s, d), 0.1, 42, ["video_id", "clip_idx", "u", "bi", "bj"])), None),
    "g11_next_block": (lambda s, d: rounded(steps(s, d)), f"WITH {NEXT_SQL} SELECT video_id, clip_idx, u, b, dest, round(conf, 6) AS conf FROM step"),
    "g12_confidence": (lambda s, d: rounded(C.confidence(steps(s, d), 0.0)), f"WITH {NEXT_SQL} SELECT video_id, clip_idx, u, dest AS block, round(max(conf), 6) AS c FROM step GROUP BY ALL"),
    "g13_paths": (walk, f"WITH {WALK_SQL} SELECT video_id, clip_idx, traj_id, CAST(u AS INTEGER) AS u, block FROM walk"),
    "g14_path_scores": (lambda s, d: nine(C.path_scores(walk(s, d), risk(s, d), 0.6)), f"WITH {SCORE_SQL} SELECT video_id, clip_idx, traj_id, round(score, 9) AS score FROM ts"),
    "g15_softmax_weights": (lambda s, d: nine(weights(s, d)), f"WITH {SCORE_SQL} SELECT video_id, clip_idx, traj_id, round(score, 9) AS score, round(weight, 9) AS weight FROM tw"),
    "g16_scatter_mean": (lambda s, d: rounded(raw_map(s, d)), f"WITH {SCATTER_SQL} SELECT video_id, clip_idx, CAST(u AS INTEGER) AS u, bi, bj, round(score, 6) AS score FROM rawmap"),
    "g17_path_smoothing": (lambda s, d: rounded(trajectory_map(s, d)), f"WITH {TRAJECTORY_SQL} SELECT video_id, clip_idx, CAST(u AS INTEGER) AS u, bi, bj, round(score, 6) AS score FROM done"),
    "g18_frame_interpolation": (lambda s, d: rounded(clip_frames(s, d)), f"WITH {FRAMES_SQL} SELECT video_id, clip_idx, local_i, bi, bj, round(score, 6) AS score FROM fs"),
    "g19_merge_weighted": (
        lambda s, d: rounded(C.merge_overlaps(clip_frames(s, d), 16, 8)),
        f"WITH {FRAMES_SQL} SELECT video_id, frame_idx, bi, bj, round({MERGED}, 6) AS score FROM mg",
    ),
    "g20_merge_mean": (
        lambda s, d: rounded(C.merge_mean(clip_frames(s, d), 8, covered(s, d), GRID)),
        f"WITH {FRAMES_SQL}, cv AS (SELECT video_id, unnest(range(max(clip_idx) * 8 + 18)) AS frame_idx FROM flows GROUP BY 1), cl AS (SELECT video_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(b // 4 AS INTEGER) AS bi, CAST(b % 4 AS INTEGER) AS bj FROM cv, (SELECT unnest(range(16)) AS b)) SELECT cl.*, round(coalesce(plain, 0), 6) AS score FROM cl LEFT JOIN mg USING (video_id, frame_idx, bi, bj)",
    ),
    "g21_merge_frames": (
        lambda s, d: C.merge_overlaps(clip_frames(s, d).withColumn("score", F.round(255 * F.col("score"))), 16, 8, top=255.0, whole=True).withColumn("score", F.col("score").cast("int")),
        f"WITH {FRAMES_SQL}, pw AS (SELECT * REPLACE (round(255 * score) AS score) FROM wf), pm AS (SELECT video_id, CAST(frame_idx AS INTEGER) AS frame_idx, bi, bj, sum(w * score) AS ws, sum(w) AS w FROM pw GROUP BY ALL) SELECT video_id, frame_idx, bi, bj, CAST(floor(least(255, greatest(0, CASE WHEN w > 0 THEN ws / greatest(w, 1e-6) ELSE coalesce(lag(ws) OVER (PARTITION BY video_id, bi, bj ORDER BY frame_idx), 0) END)) + 1e-9) AS INTEGER) AS score FROM pm",
    ),
    "f5_sigma_map": (lambda s, d: rounded(sigma_maps(s, d)), f"WITH {SIGMA_SQL} SELECT {MAP} FROM sig"),
    "f6_sigma_smoothing": (
        lambda s, d: rounded(C.smooth_sigmas(sigma_maps(s, d), GRID)),
        f"""WITH RECURSIVE {SIGMA_SQL.strip()}, {smooth_sql('sig', 'bx', clamp=False)}, sq AS (SELECT *, row_number() OVER (PARTITION BY video_id, bi, bj ORDER BY clip_idx, u) AS n FROM bx),
        rec AS (SELECT video_id, clip_idx, u, bi, bj, score, n FROM sq WHERE n = 1 UNION ALL SELECT s.video_id, s.clip_idx, s.u, s.bi, s.bj, 0.85e0 * s.score + 0.15e0 * r.score, s.n FROM rec r JOIN sq s ON s.video_id = r.video_id AND s.bi = r.bi AND s.bj = r.bj AND s.n = r.n + 1)
        SELECT video_id, clip_idx, u, bi, bj, round(greatest(score, 1e-6), 6) AS score FROM rec""",
    ),
    "f7_frequency_weights": (f7, F7_SQL),
    "f7_frequency_weights_by_size": (f7_sizes, F7_SIZES_SQL),
    "f8_soft_clip": (
        lambda s, d: rounded(flows(s, d).select("video_id", "clip_idx", "flow_idx", "b", R.soft_clip(F.col("dx"), 1.5).alias("dx"), R.soft_clip(F.col("dy"), 0.0).alias("dy"))),
        f"WITH {FLOWS_SQL} SELECT video_id, clip_idx, flow_idx, b, round(1.5e0 * tanh(dx / 1.5e0), 6) AS dx, round(dy, 6) AS dy FROM flows",
    ),
}
