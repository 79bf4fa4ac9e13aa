"""Queries over manifests, files and reports: completeness, provenance and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.jobs.blocks import motion, scores_sql
from blockalloc.jobs.statistics import rounded
from blockalloc.operators import accounting as A
from blockalloc.operators import blocks as K
from blockalloc.operators import integrity as I
from blockalloc.sources.views import FILES_SQL, MANIFEST_SQL, PIXELS_SQL, RUNS_SQL, files, frames, manifest, runs
from blockalloc.session import dealt, table


def videos(spark: SparkSession, d: str) -> DataFrame:
    return I.with_path_parts(manifest(spark, d).select("path", "frames"))


VIDEOS_SQL = f"""{MANIFEST_SQL}, videos AS (SELECT path, frames, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS suffix, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS class, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem,
  regexp_extract(path, '([^/]+)/[^/]+$', 1) || '_' || regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS video_id FROM manifest WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('avi', 'mp4', 'mov', 'mkv'))"""


def listed(spark: SparkSession, d: str) -> DataFrame:
    """A checksum list made before some files changed and others went."""
    return files(spark, d).select("path", F.when(F.col("doc_id") % 97 == 0, F.sha2(F.lit("old").cast("binary"), 256)).otherwise(I.digest(F.col("content"))).alias("digest"))


def b3(spark: SparkSession, d: str) -> DataFrame:
    now = files(spark, d).where("doc_id % 89 <> 0")
    return I.verify_checksums(listed(spark, d), now).groupBy("status").agg(F.count("*").alias("n"))


def b4(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d).select("video_id", F.col("path").alias("source"), F.concat_ws("/", F.lit("data"), "video_id").alias("scores"))
    return I.unresolved(m, ["source", "scores"], manifest(spark, d).where("frames > 100"))


def b5(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).groupBy("video_id").agg(F.count("*").alias("n"))
    s = motion(spark, d).where("video_id <> 'v3'").groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    m = f.withColumn("n", F.col("n") + F.when(F.col("video_id") == "v2", 1).otherwise(0))
    return I.reconcile(manifest=m, decoded=f, scores=s)


def run_grid(spark: SparkSession, d: str) -> DataFrame:
    videos = dealt(runs(spark, d).select("video_id").distinct())  # few and small, so they would else be spread out in one task
    return videos.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("seed")).select("*", F.explode(F.array(*map(F.lit, (10, 20, 30, 40)))).alias("top_k")).select("*", F.explode(F.array(*map(F.lit, ("AF", "NO", "RF")))).alias("policy"))


KEYS = ["video_id", "seed", "top_k", "policy"]
GRID_SQL = f"{RUNS_SQL}, grid AS (SELECT v.video_id, CAST(seed AS INTEGER) AS seed, CAST(top_k AS INTEGER) AS top_k, policy FROM (SELECT DISTINCT video_id FROM runs) v, (SELECT unnest(range(1, 8)) AS seed), (SELECT unnest([10, 20, 30, 40]) AS top_k), (SELECT unnest(['AF', 'NO', 'RF']) AS policy))"


def b7(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("frames") > 350, "too many frames").when(~F.lower("path").rlike("(avi|mp4|mov|mkv)$"), "cannot open video")
    good, failed = I.split_failures(manifest(spark, d), bad)
    return failed.unionByName(good.select("video_id", F.lit(None).cast("string").alias("error")))


def seeded_scores(spark: SparkSession, d: str) -> DataFrame:
    m = motion(spark, d).withColumn("score", F.round("score", 4)).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"))
    u = F.round(K.hashed_uniform(F.col("seed").cast("string"), "video_id", *(F.col(c).cast("string") for c in ("frame_idx", "bi", "bj"))), 6)
    return m.withColumn("policy", F.lit("motion")).unionByName(m.withColumns({"policy": F.lit("random"), "score": u}))


def c1(spark: SparkSession, d: str) -> DataFrame:
    return I.balanced_subset(videos(spark, d), 10, 3).select("class", "path", "place")


def c6(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).where("not (policy = 'RF' and video_id like '%9')").groupBy("video_id", F.col("policy").alias("method")).agg(F.max("seed").alias("seed"))
    wide, failed = I.by_method(r, ["AF", "NO", "RF"], "seed")
    return wide.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Videos with the sigma that meets eps 8 at delta 1e-4 for 20 blocks of clip 2."""
    args = F.col("frames"), F.lit(20), F.lit(2.0)
    return dealt(manifest(spark, d)).withColumn("sigma", A.sigma_for(F.lit(8.0), *args, F.lit(1e-4)))


def d4(spark: SparkSession, d: str) -> DataFrame:
    b = A.best_epsilon(F.col("frames"), F.lit(20), F.lit(2.0), F.col("sigma"), F.lit(1e-4))
    # inlined, not picked field by field, which would evaluate the curve for each field
    return rounded(calibrated(spark, d).select("video_id", "frames", "sigma", F.inline(F.array(b))))


SIGMA_SQL = "list_min(list_transform(list_filter(range(2, 129), lambda a: 8 > ln(1e4) / (a - 1)), lambda a: sqrt(a * frames * 320 / (2 * (8 - ln(1e4) / (a - 1))))))"
CURVE_SQL = f"{MANIFEST_SQL}, cal AS (SELECT video_id, frames, {SIGMA_SQL} AS sigma FROM manifest), cu AS (SELECT *, frames * alpha * 320 / (2 * sigma * sigma) AS rho, frames * alpha * 320 / (2 * sigma * sigma) + ln(1e4) / (alpha - 1) AS eps FROM (SELECT *, CAST(unnest(range(2, 129)) AS INTEGER) AS alpha FROM cal))"


def reports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"),
        I.report_json(
            noise=F.when(k % 5 == 0, "correlated").otherwise("iid"), raw_mixing=k % 7 == 0, high_freq=F.when(k % 11 == 0, "kept").otherwise("zeroed"), chroma=F.lit("fixed"),
            kappa=F.when(k % 13 == 0, 2).otherwise(1), claim=F.when(k % 3 == 0, "covered").otherwise("not covered"), scope=F.when(k % 6 == 0, "covered").otherwise("not covered"),
        ).alias("json"),
    )


REPORT = "noise string, raw_mixing boolean, high_freq string, chroma string, kappa int, claim string, scope string"


def d7(spark: SparkSession, d: str) -> DataFrame:
    failed = A.release_rules(F.from_json("json", REPORT))
    return reports(spark, d).select("id", F.array_join(failed, ",").alias("failed"), (F.size(failed) == 0).alias("proceed"))


D7_SQL = """SELECT event_id AS id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'noise' END, CASE WHEN event_id % 7 = 0 THEN 'raw_mixing' END, CASE WHEN event_id % 11 = 0 THEN 'high_freq' END, CASE WHEN event_id % 13 = 0 THEN 'kappa' END,
  CASE WHEN (event_id % 3 = 0) <> (event_id % 6 = 0) THEN 'claim' END) AS failed, NOT (event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR (event_id % 3 = 0) <> (event_id % 6 = 0)) AS proceed FROM events"""


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    import uuid

    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def a1(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows written as CSV and read back with their schema."""
    path = folder(spark, "manifest")
    I.write_csv(manifest(spark, d), path, ["video_id", "class", "path", "frames"])
    return I.read_csv(spark, path, "video_id string, class string, path string, frames int")


def a6(spark: SparkSession, d: str) -> DataFrame:
    """Frames written by run and read back."""
    path = folder(spark, "frames")
    I.write_frames(frames(spark, d).withColumns({"seed": F.lit(42), "top_k": F.lit(20), "policy": F.lit("motion")}), path)
    return spark.read.parquet(path).groupBy("video_id", "seed", "top_k", "policy").agg(F.count("*").alias("frames"))


def d8(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d)
    return m.select("video_id", A.mixed_seed(F.col("frames").cast("long"), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(0)).alias("seed"))


def mix_sql(parts: list[int]) -> str:
    """The wrapping mix, a step a part, in whole numbers of 128 bits."""
    steps = ["mix_0 AS (SELECT video_id, CAST(frames AS UBIGINT) AS h FROM manifest)"]
    for i, p in enumerate(parts):
        times = f"CAST((CAST(xor(h, CAST({(p + A.MIX_ADD) % 2**64} AS UBIGINT)) AS UHUGEINT) * CAST({A.MIX_TIMES} AS UHUGEINT)) % CAST({2**64} AS UHUGEINT) AS UBIGINT)"
        steps.append(f"mix_{i + 1} AS (SELECT video_id, xor(h, h >> {A.MIX_SHIFT}) AS h FROM (SELECT video_id, {times} AS h FROM mix_{i}))")
    return ", ".join(steps)


M, V = f"WITH {MANIFEST_SQL}", f"WITH {VIDEOS_SQL}"

QUERIES = {
    "a1_a2_csv_round_trip": (a1, f"{M} SELECT * FROM manifest"),
    "a6_released_frames": (a6, f"WITH {PIXELS_SQL} SELECT video_id, 42 AS seed, 20 AS top_k, 'motion' AS policy, count(*) AS frames FROM f GROUP BY 1"),
    "a7_report_json": (
        lambda s, d: reports(s, d).select("id", F.get_json_object("json", "$.noise").alias("noise"), F.get_json_object("json", "$.kappa").cast("int").alias("kappa")),
        "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'correlated' ELSE 'iid' END AS noise, CAST(CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS INTEGER) AS kappa FROM events",
    ),
    "a8_unfinished_runs": (lambda s, d: I.unfinished(run_grid(s, d), runs(s, d), KEYS), f"WITH {GRID_SQL} SELECT * FROM grid ANTI JOIN runs USING (video_id, seed, top_k, policy)"),
    "b1_b2_checksum_list": (lambda s, d: I.checksum_list(files(s, d)), f"WITH {FILES_SQL} SELECT sha256(content) AS digest, path FROM files"),
    "b3_verify_checksums": (b3, "SELECT CASE WHEN doc_id % 89 = 0 THEN 'missing' WHEN doc_id % 97 = 0 THEN 'mismatch' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1"),
    "b4_unresolved_assets": (b4, f"{M} SELECT video_id, 'source' AS reference, path FROM manifest WHERE frames <= 100 UNION ALL SELECT video_id, 'scores', 'data/' || video_id FROM manifest"),
    "b5_frame_counts": (
        b5,
        f"WITH {PIXELS_SQL}, c AS (SELECT video_id, count(*) AS n FROM f GROUP BY 1) SELECT video_id, CAST(n + CASE WHEN video_id = 'v2' THEN 1 ELSE 0 END AS BIGINT) AS manifest, n AS decoded, CASE WHEN video_id <> 'v3' THEN n END AS scores, CASE WHEN video_id = 'v3' THEN 'missing: scores' WHEN video_id = 'v2' THEN 'mismatch' ELSE 'ok' END AS status FROM c",
    ),
    "b6_missing_runs": (lambda s, d: I.missing_runs(runs(s, d), run_grid(s, d), KEYS), f"WITH {GRID_SQL} SELECT * FROM grid EXCEPT SELECT video_id, seed, top_k, policy FROM runs"),
    "b6_completeness": (
        lambda s, d: I.completeness(runs(s, d), run_grid(s, d), KEYS),
        f"""WITH {GRID_SQL}, c AS (SELECT (SELECT count(*) FROM grid) AS expected, (SELECT count(*) FROM grid SEMI JOIN runs USING (video_id, seed, top_k, policy)) AS found, (SELECT count(*) FROM runs ANTI JOIN grid USING (video_id, seed, top_k, policy)) AS unexpected)
        SELECT expected, found, expected - found AS missing, unexpected, CAST(0 AS BIGINT) AS duplicates, CASE WHEN expected = found AND unexpected = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM c""",
    ),
    "b7_failures": (b7, f"{M} SELECT video_id, CASE WHEN frames > 350 THEN 'too many frames' WHEN NOT regexp_matches(lower(path), '(avi|mp4|mov|mkv)$') THEN 'cannot open video' END AS error FROM manifest"),
    "b8_seed_sensitivity": (
        lambda s, d: I.seed_sensitivity(seeded_scores(s, d)),
        "WITH v AS (SELECT DISTINCT 'v' || CAST(label AS VARCHAR) AS video_id FROM embeddings) SELECT video_id, 'motion' AS policy, CAST(3 AS BIGINT) AS seeds, CAST(1 AS BIGINT) AS digests, 'deterministic' AS kind FROM v UNION ALL SELECT video_id, 'random', 3, 3, 'random' FROM v",
    ),
    "b9_forbidden_paths": (lambda s, d: I.forbidden(manifest(s, d), ["Brand_11", "tmp"], ["txt", "mov"]).select("path"), f"{M} SELECT path FROM manifest WHERE list_has_any(string_split(path, '/'), ['Brand_11', 'tmp']) OR lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('txt', 'mov')"),
    "b10_asset_manifest": (
        lambda s, d: rounded(I.asset_manifest(motion(s, d).withColumns({"policy": F.lit("motion"), "seed": F.lit(42)})), "total"),
        f"""WITH {scores_sql(4)}, fd AS (SELECT video_id, frame_idx, max(bi) AS bi, count(*) AS n, sum(score) AS total, sha256(string_agg(CAST(CAST(round(score * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY bi, bj)) AS d FROM scores GROUP BY ALL)
        SELECT video_id, 'motion' AS policy, 42 AS seed, CAST(max(frame_idx) + 1 AS INTEGER) AS frames, CAST(max(bi) + 1 AS INTEGER) AS block_grid, CAST(sum(n) AS BIGINT) AS cells, round(sum(total), 6) AS total, sha256(string_agg(d, ',' ORDER BY frame_idx)) AS digest FROM fd GROUP BY 1""",
    ),
    "c1_balanced_subset": (
        c1,
        f"{V}, k AS (SELECT class FROM videos GROUP BY 1 HAVING count(*) >= 3 ORDER BY 1 LIMIT 10) SELECT class, path, CAST(row_number() OVER (PARTITION BY class ORDER BY path) AS INTEGER) AS place FROM videos JOIN k USING (class) QUALIFY place <= 3",
    ),
    "c2_path_parts": (lambda s, d: videos(s, d).select("path", "suffix", "class", "stem", "video_id"), f"{V} SELECT path, suffix, class, stem, video_id FROM videos"),
    "c3_manifest_expansion": (
        lambda s, d: I.expand_manifest(videos(s, d).select("video_id"), [0, 42], ["fusion", "random"]),
        f"{V} SELECT video_id, CAST(seed AS INTEGER) AS seed, method, 'out/' || video_id || '/seed' || seed || '/' || method AS output_dir FROM videos, (SELECT unnest([0, 42]) AS seed), (SELECT unnest(['fusion', 'random']) AS method)",
    ),
    "c4_first_of_method": (
        lambda s, d: I.first_of(I.expand_manifest(videos(s, d).select("video_id"), [42], ["fusion", "random"]), "random", 20, ["video_id"]).select("video_id", "method"),
        f"{V} SELECT video_id, 'random' AS method FROM videos ORDER BY video_id LIMIT 20",
    ),
    "c5_config_grid": (
        lambda s, d: videos(s, d).select("video_id").join(F.broadcast(I.config_grid(s))),
        f"{V}, g AS (SELECT 'E1' AS experiment, CAST(unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 42]) AS INTEGER) AS seed, 20 AS top_k UNION ALL SELECT 'E2', 42, CAST(unnest([10, 20, 30, 40]) AS INTEGER)) SELECT video_id, experiment, seed, top_k FROM videos, g",
    ),
    "c6_rows_by_method": (
        c6,
        f"""WITH {RUNS_SQL}, w AS (SELECT video_id, max(seed) FILTER (policy = 'AF') AS "AF", max(seed) FILTER (policy = 'NO') AS "NO", max(seed) FILTER (policy = 'RF' AND NOT video_id LIKE '%9') AS "RF" FROM runs GROUP BY 1)
        SELECT video_id, CASE WHEN e THEN NULL ELSE "AF" END AS "AF", CASE WHEN e THEN NULL ELSE "NO" END AS "NO", CASE WHEN e THEN NULL ELSE "RF" END AS "RF", CASE WHEN e THEN 'missing method: ' || concat_ws(',', CASE WHEN "AF" IS NULL THEN 'AF' END, CASE WHEN "NO" IS NULL THEN 'NO' END, CASE WHEN "RF" IS NULL THEN 'RF' END) END AS error FROM (SELECT *, "AF" IS NULL OR "NO" IS NULL OR "RF" IS NULL AS e FROM w)""",
    ),
    "d1_stable_seed": (
        lambda s, d: manifest(s, d).select("video_id", A.stable_seed(F.lit(42), F.col("video_id"), F.lit("random-mask")).alias("seed")),
        f"""{M}, h AS (SELECT video_id, sha256('42' || chr(0) || video_id || chr(0) || 'random-mask') AS h FROM manifest)
        SELECT video_id, CAST(CAST('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS UBIGINT) % 4294967295 AS BIGINT) AS seed FROM h""",
    ),
    "d2_sensitivity": (lambda s, d: rounded(manifest(s, d).select("video_id", A.sensitivity(F.lit(2.0), F.col("frames")).alias("sensitivity"))), f"{M} SELECT video_id, round(2 * 2e0 * sqrt(frames), 6) AS sensitivity FROM manifest"),
    "d3_rdp_curve": (
        lambda s, d: rounded(calibrated(s, d).select("video_id", F.inline(A.rdp_curve(F.col("frames"), F.lit(20), F.lit(2.0), F.col("sigma"), F.lit(1e-4))))),
        f"WITH {CURVE_SQL} SELECT video_id, alpha, round(rho, 6) AS rho, round(eps, 6) AS eps FROM cu",
    ),
    "d4_best_epsilon": (
        d4,
        f"WITH {CURVE_SQL} SELECT video_id, frames, round(sigma, 6) AS sigma, round(eps, 6) AS eps, alpha, round(rho, 6) AS rho, round(4 * sqrt(20e0), 6) AS sensitivity FROM cu QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY eps, alpha) = 1",
    ),
    "d5_sigma_for_epsilon": (lambda s, d: rounded(calibrated(s, d).select("video_id", "frames", "sigma")), f"{M} SELECT video_id, frames, round({SIGMA_SQL}, 6) AS sigma FROM manifest"),
    "d6_theorem_scope": (
        lambda s, d: (lambda c: reports(s, d).select("id", c[0].alias("claim"), c[1].alias("warning")))(A.theorem_scope(F.element_at(F.array(*map(F.lit, ("external", "fixed", "released"))), (F.col("id") % 3 + 1).cast("int")))),
        "SELECT event_id AS id, CASE WHEN event_id % 3 < 2 THEN 'covered' ELSE 'not covered' END AS claim, CASE WHEN event_id % 3 < 2 THEN NULL ELSE 'mask depends on the released data' END AS warning FROM events",
    ),
    "d7_release_gate": (d7, D7_SQL),
    "d8_seed_mix": (d8, f"{M}, {mix_sql([1, 2, 3, 4, 0])} SELECT video_id, CAST(h % 4294967295 AS BIGINT) AS seed FROM mix_5"),
}
