"""Published values, properties and edge cases of the operators."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockalloc.jobs import blocks as JB
from blockalloc.operators import accounting as A
from blockalloc.operators import blocks as K
from blockalloc.operators import bootstrap as B
from blockalloc.operators import cues as C
from blockalloc.operators import draws as W
from blockalloc.operators import integrity as I
from blockalloc.operators import release as R
from blockalloc.operators import statistics as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_published_seed(spark):
    got = one(spark, A.stable_seed(F.lit(42), F.lit("BalanceBeam_v_BalanceBeam_g01_c01"), F.lit("random-mask")))[0]
    assert got == 3361225653 == B.stable_seed(42, "BalanceBeam_v_BalanceBeam_g01_c01", "random-mask")


@pytest.mark.parametrize("frames, sigma", [(53, 82.949), (125, 127.387), (380, 222.108)])
def test_published_sigma_and_its_epsilon(spark, frames, sigma):
    s = A.sigma_for(F.lit(8.0), F.lit(frames), F.lit(20), F.lit(2.0), F.lit(1e-4))
    got, eps = one(spark, s, A.best_epsilon(F.lit(frames), F.lit(20), F.lit(2.0), s, F.lit(1e-4))["eps"])
    assert got == pytest.approx(sigma, abs=1e-3)
    assert eps == pytest.approx(8.0, abs=1e-9)


def test_sensitivity_and_invalid_accounting(spark):
    s, bad = one(spark, A.sensitivity(F.lit(2.0), F.lit(20)), A.best_epsilon(F.lit(0), F.lit(20), F.lit(2.0), F.lit(1.0), F.lit(1e-4)))
    assert s == pytest.approx(17.88854381999832) and bad is None


def test_seed_mix_wraps():
    def plain(seed, parts):
        x = seed
        for p in parts:
            x = ((x ^ ((p + A.MIX_ADD) % 2**64)) * A.MIX_TIMES) % 2**64
            x ^= x >> A.MIX_SHIFT
        return x % (2**32 - 1)

    rng = np.random.default_rng(0)
    seeds, parts = rng.integers(0, 2**63, 50), rng.integers(0, 1000, (50, 5))
    assert A.seed_mix(seeds, parts).tolist() == [plain(int(s), [int(p) for p in row]) for s, row in zip(seeds, parts, strict=True)]


@pytest.mark.parametrize("wins, losses, p", [(20, 0, 2 / 2**20), (17, 3, 0.002577), (12, 8, 0.503445), (0, 0, 1.0), (5, 5, 1.0), (400, 500, None), (540, 540, 1.0), (1500, 1400, None), (50_300, 49_700, None)])
def test_sign_test(spark, wins, losses, p):
    got = spark.createDataFrame([(wins, losses)], "w long, x long").select(S.sign_p("w", "x")).first()[0]
    n, term, total = wins + losses, 1, 0
    for i in range(min(wins, losses) + 1):
        total, term = total + term, term * (n - i) // (i + 1)
    assert got == pytest.approx(min(1.0, float(Fraction(2 * total, 2**n))) if n else 1.0, rel=1e-9)
    if p:
        assert got == pytest.approx(p, abs=1e-6)


def test_sign_test_of_ten_million_pairs(spark):
    n, lead = 10**7, 4000
    got = spark.createDataFrame([((n + lead) // 2, (n - lead) // 2)], "w long, x long").select(S.sign_p("w", "x")).first()[0]
    assert got == pytest.approx(math.erfc((lead - 1) / math.sqrt(2 * n)), rel=1e-4)  # the normal tail, corrected for continuity


def test_intervals_stand_beside_their_rows_and_turn(spark):
    rng = np.random.default_rng(9)
    rows = [("L vs R", m, f"v{i:02}", float(x)) for m in ("a", "b") for i, x in enumerate(rng.normal(0.3, 1, 40))] + [("L vs S", "a", "v00", 0.25)]
    d = spark.createDataFrame(rows, "comparison string, metric string, video_id string, difference double")
    t = B.with_interval(S.paired_table(d), d, ["comparison", "metric"], "video_id", lambda c, m: len(c + m), resamples=500)
    got = {(r.comparison, r.metric): r for r in t.collect()}
    assert (got["L vs R", "a"].ci95_low, got["L vs R", "a"].ci95_high) == B.exact_interval([x[3] for x in rows[:40]], 7, resamples=500)
    assert got["L vs S", "a"].ci95_low == got["L vs S", "a"].ci95_high == 0.25
    back = {r.metric: r for r in S.pair_lookup(t, [("R", "L")]).collect()}
    r = got["L vs R", "a"]
    assert (back["a"].ci95_low, back["a"].ci95_high, back["a"].left_wins) == (-r.ci95_high, -r.ci95_low, r.right_wins)


def test_bootstrap_edges_and_large_form(spark):
    assert all(map(math.isnan, B.exact_interval([], 1))) and B.exact_interval([0.5], 1) == (0.5, 0.5)
    rng = np.random.default_rng(3)
    rows = [("a", f"v{i}", float(x)) for i, x in enumerate(rng.normal(0.2, 1, 600))] + [("b", "v0", 0.25), ("b", "v1", float("nan")), ("b", "v2", None)]
    d = spark.createDataFrame(rows, "k string, u string, difference double")
    for statistic in ("mean", "median"):
        lo, hi = B.exact_interval([r[2] for r in rows[:600]], 1, statistic, 2000)
        found = [{r.k: (r.n, round(r.ci95_low, 12), round(r.ci95_high, 12)) for r in B.multinomial_intervals(d.repartition(parts), ["k"], "u", lambda _: 5, statistic, 2000, 64).collect()} for parts in (1, 5)]
        assert found[0] == found[1], "nothing depends on partitions"
        assert found[0]["a"] == (600, pytest.approx(lo, abs=0.02), pytest.approx(hi, abs=0.02)) and found[0]["b"] == (1, 0.25, 0.25)


@pytest.mark.parametrize("n, size", [(1, 4), (9, 4), (1000, 64), (1000, 1)])
def test_cells_share_one_multinomial(n, size):
    cells, resamples = -(-n // size), 400
    each = [B.cell_draws(n, c, size, 11, resamples) for c in range(cells)]
    counts = np.array([x[0] for x in each])
    assert (counts >= 0).all() and (counts.sum(0) == n).all(), "the draws of a resample are n"
    assert (np.cumsum(counts, axis=0) - counts == np.array([x[1] for x in each])).all()
    units = np.diff(np.minimum(np.arange(cells + 1) * size, n))
    if cells > 1 and size > 1:
        assert np.abs(counts.mean(1) - units).max() < 5 * np.sqrt(size / resamples)
        assert counts[0].var() == pytest.approx(units[0] * (1 - units[0] / n), rel=0.3)


def test_median_of_a_resample_is_that_of_its_draws(spark):
    values = np.sort(np.random.default_rng(8).normal(0, 1, 101))
    d = spark.createDataFrame([(f"v{i}", float(x)) for i, x in enumerate(values)], "u string, difference double").select(F.lit("k").alias("k"), "u", "difference")
    size, resamples, want = 10, 300, []
    for r in range(resamples):
        drawn = [c * size + np.random.default_rng([4, B.MIDDLE, c, r]).integers(0, min(size, 101 - c * size), B.cell_draws(101, c, size, 4, resamples)[0][r]) for c in range(11)]
        want.append(np.median(values[np.concatenate(drawn)]))
    got = B.multinomial_intervals(d, ["k"], "u", lambda _: 4, "median", resamples, size).first()
    assert (got.ci95_low, got.ci95_high) == (pytest.approx(np.quantile(want, 0.025), abs=1e-12), pytest.approx(np.quantile(want, 0.975), abs=1e-12))


def test_one_generator_in_order(spark):
    rng = np.random.default_rng(6)
    groups = {("x", "m"): rng.normal(0, 1, 20), ("y", "m"): rng.normal(1, 1, 20), ("x", "o"): rng.normal(2, 1, 13)}
    rows = [(*k, f"v{i:02}", float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(rows[::-1], "c string, m string, u string, difference double")
    order = [("y", "m"), ("nowhere", "m"), ("x", "m"), ("x", "o")]
    got = {(r.c, r.m): r for r in B.in_order_intervals(d, ["c", "m"], order, "u", 99, resamples=500).collect()}
    draws = np.random.default_rng(99)
    for k in (order[0], order[2], order[3]):
        for s, f in (("mean", np.mean), ("median", np.median)):
            v = groups[k]
            ends = np.quantile(f(draws.choice(v, size=(500, len(v)), replace=True), axis=1), [0.025, 0.975])
            assert (got[k][f"{s}_ci95_low"], got[k][f"{s}_ci95_high"]) == tuple(ends)
    assert len(got) == 3


def test_slices_of_many_pairs_follow_the_one_generator(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(c, f"u{i}", float(x)) for c, n in (("a", 37), ("b", 1), ("c", 64), ("d", 1001)) for i, x in enumerate(rng.normal(0, 1, n))]
    rows += [("c", "nan", math.nan), ("e", "u", None)]
    d = spark.createDataFrame(rows, "c string, u string, difference double").withColumn("m", F.lit("m"))
    order = [(c, "m") for c in "dbxecad"]
    one = B.in_order_intervals(d, ["c", "m"], order, "u", 7, resamples=300).collect()
    monkeypatch.setattr(B, "EXACT", 10)
    monkeypatch.setattr(B, "WORDS", 5000)
    monkeypatch.setattr(B, "SLICE", 70)
    many = B.in_order_intervals(d.repartition(3), ["c", "m"], order, "u", 7, resamples=300).collect()
    near = lambda found: sorted(tuple(round(x, 12) if isinstance(x, float) and not math.isnan(x) else str(x) for x in r) for r in found)
    assert len(one) == 6 and list(map(str, near(many))) == list(map(str, near(one)))


def test_words_passed_over_are_counted(spark, monkeypatch):
    monkeypatch.setattr(B, "WORDS", 100)
    n = 3_000_000_001  # nearly a third of all words is passed over
    places, end = B.slice_places(spark, 3, 5, n, [0, 250, 1000, 1001])
    whole = B.generator_at(3, 5).integers(0, n, 1001)
    for t, (word, drop) in zip((0, 250, 1000), places, strict=False):
        assert (B.generator_at(3, word).integers(0, n, drop + 1)[drop:] == whole[t : t + 1]).all()
    after = B.generator_at(3, 5)
    after.integers(0, n, 1001)
    assert (after.integers(0, 1 << 32, 9, dtype=np.uint32) == B.generator_at(3, end).integers(0, 1 << 32, 9, dtype=np.uint32)).all()


def test_tables_take_the_sign_test_of_many_pairs(spark):
    n, wins = 3000, 1450
    d = spark.range(n).select(F.lit("L vs R").alias("comparison"), F.lit("m").alias("metric"), F.when(F.col("id") < wins, 1.0).otherwise(-1.0).alias("difference"))
    exact = 2 * sum(math.comb(n, i) for i in range(wins + 1)) / 2**n
    for table in (S.paired_table(d), S.summary_table(d)):
        assert table.first()["exact_sign_p"] == pytest.approx(exact, rel=1e-9)


def test_intervals_draw_in_blocks_and_leave_many_pairs_to_cells(spark, monkeypatch):
    values = np.random.default_rng(5).normal(0.2, 1, 501)
    whole = np.random.default_rng(7).choice(values, size=(3000, 501), replace=True).mean(axis=1)
    monkeypatch.setattr(B, "BLOCK", 10_000)
    assert B.exact_interval(values, 7, resamples=3000) == tuple(np.quantile(whole, [0.025, 0.975]))
    rows = [(k, f"v{i:03}", float(x)) for k, size in (("few", 50), ("many", 501)) for i, x in enumerate(values[:size])]
    d = spark.createDataFrame(rows, "k string, u string, difference double").repartition(3)
    monkeypatch.setattr(B, "EXACT", 100)
    for statistic in ("mean", "median"):
        got = {r["k"]: r for r in B.intervals(d, ["k"], "u", lambda _: 7, statistic, 400).collect()}
        assert (got["few"]["ci95_low"], got["few"]["ci95_high"]) == B.exact_interval(values[:50], 7, statistic, 400)
        lo, hi = B.exact_interval(values, 7, statistic, 400)
        assert got["many"]["n"] == 501 and got["many"]["ci95_low"] == pytest.approx(lo, abs=0.06) and got["many"]["ci95_high"] == pytest.approx(hi, abs=0.06)
        assert statistic == "median" or got["many"]["ci95_low"] != lo  # other draws


@pytest.mark.parametrize("more", [0.0, 0.001])
def test_noise_of_means_is_no_win(spark, more):
    covers = {"A": 0.1 + 0.2 + 0.3, "B": 0.3 + 0.2 + 0.1}  # 0.6000000000000001 and 0.6, by order
    assert covers["A"] != covers["B"]
    d = S.paired_differences(spark.createDataFrame([("v", p, c / 3 + more * (p == "A")) for p, c in covers.items()], "video_id string, policy string, x double"), [("A", "B"), ("B", "A")], metrics=["x"])
    assert {(r.positive_pairs + r.negative_pairs, r.ties) for r in S.summary_table(d, places=12).collect()} == {(1, 0) if more else (0, 1)}
    assert {(r.left_wins + r.right_wins, r.ties) for r in S.paired_table(d, tie=more, places=12).collect()} == {(0, 1)}


@pytest.mark.parametrize("name", ["h8_wins_lower_is_better", "h13_summary", "h13_summary_with_intervals"])
def test_queries_by_means_tell_wins_to_twelve_places(spark, data, monkeypatch, name):
    from blockalloc.jobs import registry
    from blockalloc.jobs import statistics as T

    unit = T.e1(spark, data).limit(1).withColumn("difference", F.lit(0.0010000000000000001 if name[1] == "8" else 1e-17) * 1.0000000000000002)
    monkeypatch.setattr(T, "e1", lambda spark, d: unit)
    (row,) = registry.QUERIES[name](spark, data).collect()
    wins = (row.left_wins, row.right_wins) if name[1] == "8" else (row.positive_pairs, row.negative_pairs)
    assert (*wins, row.ties) == (0, 0, 1)


def test_paired_differences_skip_gaps_and_nan(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "L", 1.0), ("a", "R", 0.5), ("b", "L", nan), ("b", "R", 1.0), ("c", "L", 1.0), ("d", "L", inf), ("d", "R", 0.0)]
    d = S.paired_differences(spark.createDataFrame(rows, "video_id string, policy string, m double"), [("L", "R")], metrics=["m"])
    assert [(r.video_id, r.difference) for r in d.collect()] == [("a", 0.5)]
    t = S.summary_table(d).first()
    assert t.n == 1 and t.difference_sd is None and math.isnan(t.cohen_dz)


def test_effect_size_of_no_spread(spark):
    dz, gz = one(spark, *S.effect_sizes(F.lit(0.1), F.lit(0.0), F.lit(20)))
    assert math.isnan(dz) and math.isnan(gz)


def video(spark, frames, h, w, name="a"):
    return spark.createDataFrame([(name, i, h, w, [int(x) for x in np.ravel(f)]) for i, f in enumerate(frames)], "video_id string, frame_idx int, height int, width int, v array<int>")


def test_bounds_follow_array_split(spark):
    for length in (1, 3, 8, 17, 240, 320):
        for parts in (1, 3, 4, 14):
            want = [len(x) for x in np.array_split(np.arange(length), parts)]
            got = one(spark, K.bounds(length, parts))[0]
            assert [r.hi - r.lo for r in got] == want == np.diff(K.edges(length, parts)).tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 600])
def test_motion_across_buckets(spark, n):
    v = np.random.default_rng(n).integers(0, 255, (n, 3, 4))
    got = K.motion_blocks(video(spark, v, 3, 4).withColumn("gray", F.col("v").cast("array<double>")), 2, bucket=7).toPandas()
    step = np.abs(np.diff(v.astype(float), axis=0))
    want = np.zeros(v.shape) if n == 1 else np.concatenate([step[:1], (step[1:] + step[:-1]) / 2, step[-1:]])
    assert len(got) == 4 * n
    for r in got.itertuples():
        ys, xs = K.edges(3, 2), K.edges(4, 2)
        assert r.score == pytest.approx(want[r.frame_idx, ys[r.bi] : ys[r.bi + 1], xs[r.bj] : xs[r.bj + 1]].mean())


def test_more_blocks_than_pixels(spark):
    got = K.motion_blocks(video(spark, np.arange(8).reshape(2, 2, 2), 2, 2).withColumn("gray", F.col("v").cast("array<double>")), 3).toPandas()
    assert len(got) == 18 and (got.query("bi == 2 or bj == 2").score == 0).all()


def maps(spark, rows):
    return spark.createDataFrame(rows, "video_id string, frame_idx int, bi int, bj int, score double")


def test_top_blocks_ties_nan_and_large_k(spark):
    s = maps(spark, [("a", 0, i // 3, i % 3, 1.0) for i in range(9)])
    assert sorted((r.bi, r.bj) for r in K.top_blocks(s, 2).collect()) == [(2, 1), (2, 2)]
    assert K.top_blocks(s, 50).count() == 9
    n = maps(spark, [("a", 0, 0, 0, float("nan")), ("a", 0, 0, 1, 5.0)])
    assert K.top_blocks(n, 1).first().bj == 0
    with pytest.raises(ValueError):
        K.top_blocks(s, 0)


def test_shift_by_the_grid_is_the_identity(spark):
    s = maps(spark, [("a", 0, i // 3, i % 3, float(i)) for i in range(9)])
    assert sorted(K.shifted(s, 3, 3, 3).collect()) == sorted(s.select(*K.shifted(s, 3, 3, 3).columns).collect())


def test_alignment_with_itself_and_region_sums(spark):
    s = maps(spark, [("a", 0, i // 2, i % 2, float(i)) for i in range(4)])
    cells = s.select("video_id", "frame_idx", "bi", "bj", F.lit(4).alias("n_px"))
    m = K.top_blocks(s, 1)
    r = K.alignment(m, m, cells).first()
    assert r.reference_coverage == r.iou == 1.0 and r.coverage_lift == 4.0
    none = K.alignment(m.where("false"), m, cells).first()
    assert none.candidate_area == 0 and math.isnan(none.coverage_lift)
    e = cells.withColumn("sse", F.lit(0.0))
    z = K.region_error(e, m).first()
    assert math.isnan(z.distortion_share) and z.total_mse_psnr == math.inf == z.high_low_mse_ratio


def plain_query(block, clip):
    """The 2 x 2 low-frequency corner of one block, clipped, written out."""
    out = np.zeros((2, 2))
    h, w = (min(2, n) for n in block.shape)
    if block.size:
        out[:h, :w] = R.basis(block.shape[0])[:h] @ block @ R.basis(block.shape[1])[:w].T
    scale = min(1.0, clip / (float(np.sqrt((out**2).sum())) + 1e-6))
    return out * scale, scale


@pytest.mark.parametrize("h, w, grid", [(8, 8, 4), (7, 11, 3), (4, 5, 4), (2, 9, 3)])
def test_queries_of_all_blocks_equal_one_block_at_a_time(h, w, grid):
    assert np.allclose(R.side_by_side(h, grid) @ R.side_by_side(h, grid).T, np.eye(h))
    luma = np.random.default_rng(1).random((3, h, w))
    q, scale = R.queries_of(luma, grid, 0.8)
    ys, xs = K.edges(h, grid), K.edges(w, grid)
    for f in range(3):
        for b in range(grid * grid):
            i, j = divmod(b, grid)
            one_q, one_s = plain_query(luma[f, ys[i] : ys[i + 1], xs[j] : xs[j + 1]], 0.8)
            assert np.allclose(q[f, b], one_q) and scale[f, b] == pytest.approx(one_s)
            assert np.sqrt((q[f, b] ** 2).sum()) <= 0.8 + 1e-9


def test_release_and_perturbation_of_mixed_sizes_and_empty_lists(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, h, w, [int(v) for v in rng.integers(0, 255, 3 * h * w)], b) for i, (h, w, b) in enumerate([(4, 6, [0, 3]), (5, 3, [1]), (4, 6, []), (5, 3, None)])]
    f = spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, rgb array<int>, blocks array<int>").coalesce(1)
    got = {r.frame_idx: r for r in R.release(f, 2, 1.0, 0.0).collect()}
    assert [len(got[i].scales) for i in range(4)] == [2, 1, 0, 0] and [len(got[i].rgb) for i in range(4)] == [72, 45, 72, 45]
    ours = {(r.frame_idx, r.block): (r.q00, r.q01, r.q10, r.q11) for r in R.low_frequency_queries(f, 2, 1.0).collect()}
    assert sorted(ours) == [(0, 0), (0, 3), (1, 1)]
    x = np.array(rows[1][4], float).reshape(3, 5, 3) / 255
    assert np.allclose(ours[1, 1], plain_query(np.tensordot(R.YCC[0], x, 1)[:3, 2:], 1.0)[0].ravel())
    still = {r.frame_idx: r.rgb for r in R.perturb_blocks(f, 2, 0.0, 1).collect()}
    assert all(still[r[1]] == r[4] for r in rows)
    moved = {r.frame_idx: r.rgb for r in R.perturb_blocks(f, 2, 0.2, 1, clip_k=0.3).collect()}
    assert all(moved[r[1]] != r[4] for r in rows)


def test_texture_of_odd_sizes(spark):
    rng = np.random.default_rng(4)
    h, w, patch = 7, 5, 2
    g = rng.integers(0, 255, (h, w))
    f = spark.createDataFrame([("a", 0, h, w, g.ravel().tolist()), ("b", 0, 4, 4, [9] * 16), ("c", 0, 1, 1, [3])], "video_id string, frame_idx int, height int, width int, gray array<int>")
    got = {(r.video_id, r.py, r.px): r.score for r in C.sobel_patches(f, patch).collect()}
    at = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    size = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            near = [(dy, dx, g[at(y + dy, h), at(x + dx, w)]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            size[y, x] = math.hypot(sum(dx * (2 - abs(dy)) * v for dy, dx, v in near), sum(dy * (2 - abs(dx)) * v for dy, dx, v in near))
    mean = {(i, j): size[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for i in range(3) for j in range(2)}
    low, high = min(mean.values()), max(mean.values())
    assert {k[1:] for k in got if k[0] == "a"} == set(mean)
    assert all(got["a", *k] == pytest.approx((v - low) / (high - low + 1e-8)) for k, v in mean.items())
    assert all(v == 0 for k, v in got.items() if k[0] == "b") and not any(k[0] == "c" for k in got)


@pytest.mark.parametrize("keep", [0.85, 0.3, 1.0, 0.0])
def test_noise_scales_mix_along_a_long_video(spark, keep):
    values = np.random.default_rng(5).random(200)
    rows = [("a", i // 8, i % 8, y, x, float(v)) for i, v in enumerate(values) for y in (0, 1) for x in (0, 1)]
    f = spark.createDataFrame(rows, "video_id string, clip_idx int, u int, bi int, bj int, score double")
    got = [r.score for r in C.smooth_sigmas(f, 2, keep).where("bi = 0 and bj = 1").orderBy("clip_idx", "u").collect()]
    want = [values[0]]
    for v in values[1:]:
        want.append(keep * v + (1 - keep) * want[-1])
    assert got == pytest.approx(want, rel=1e-12)


def test_given_maps_are_checked_and_spread(spark):
    frames = spark.createDataFrame([(v, i) for v in "abcdef" for i in range(3)], "video_id string, frame_idx int")
    four = [0.1, 0.2, 0.3, 0.4]
    maps = [("a", i, four) for i in range(3)] + [("b", None, four), ("c", 0, four), ("d", 0, four), ("d", 1, four[:3]), ("d", 2, None), ("e", None, four), ("e", 1, four), ("f", 0, four), ("f", 0, four), ("f", 1, four), ("g", None, four)]
    maps = spark.createDataFrame(maps, "video_id string, frame_idx int, values array<double>")
    bad = {r.video_id: (r.n_maps, r.n_frames, r.n_bad, r.reason) for r in K.shape_failures(maps, frames, 2).collect()}
    assert bad == {"c": (1, 3, 0, "frame count"), "d": (3, 3, 2, "map size"), "e": (2, 3, 0, "frame count"), "f": (3, 3, 0, "frame count"), "g": (1, 0, 0, "frame count")}
    cells = sorted(tuple(r) for r in K.map_cells(maps, frames, 2).collect())
    assert cells == sorted((v, i, b // 2, b % 2, four[b]) for v in "ab" for i in range(3) for b in range(4))
    assert K.map_cells(maps.where("false"), frames, 2).count() == 0


def test_release_keeps_other_blocks_and_ignores_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, 4, 4, [int(v) for v in rng.integers(0, 255, 48)], [3]) for i in range(6)]
    f = spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, rgb array<int>, blocks array<int>")
    out = [sorted((r.frame_idx, tuple(r.rgb)) for r in R.release(f.repartition(n), 2, 1.0, 3.0).collect()) for n in (1, 4)]
    assert out[0] == out[1]
    for (_, got), row in zip(out[0], rows, strict=True):
        a, b = np.array(got).reshape(3, 4, 4), np.array(row[4]).reshape(3, 4, 4)
        assert np.abs(a - b)[:, :2].max() <= 1 and np.abs(a - b)[:, :, :2].max() <= 1


@pytest.mark.parametrize("key", [0, 1, 2**64 + 5, 2**127 + 12345])
def test_counter_based_words_are_those_of_philox(key):
    counter = np.zeros((10, 4), np.uint64)
    counter[:, 0] = np.arange(1, 11)
    words = W.philox(counter, np.array([key % 2**64, key >> 64], np.uint64))
    assert (words == np.random.Philox(key=key).random_raw(40).reshape(10, 4)).all()
    far = np.array([[2**64 - 1, 7, 0, 2**63], [3, 2**64 - 1, 2**64 - 1, 1]], np.uint64)
    for c, w in zip(far, W.philox(far, np.array([[key % 2**64, key >> 64]] * 2, np.uint64)), strict=True):
        at = sum(int(x) << (64 * i) for i, x in enumerate(c)) - 1
        assert (np.random.Philox(key=key, counter=at % 2**256).random_raw(4) == w).all()


def test_normals_have_the_moments_and_their_own_streams():
    keys = W.named_keys(1, ["plumless", "buckeroo"])  # names of one CRC-32
    zero = np.zeros(2, np.int64)
    x = W.stream_normals(4, keys, zero, zero, zero)
    assert not np.array_equal(x[0], x[1])
    x = W.stream_normals(50, keys[0], np.arange(4000), np.zeros(4000, np.int64), np.zeros(4000, np.int64))
    assert x.shape == (4000, 50) and abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x**3).mean()) < 0.03 and abs((x**4).mean() - 3) < 0.08
    assert np.abs(np.corrcoef(x[:6])[np.triu_indices(6, 1)]).max() < 0.6 and np.isfinite(x).all()
    again = W.stream_normals(50, keys[0], *[np.array([i]) for i in (77, 0, 0)])
    assert (again[0] == x[77]).all(), "a stream doesn't depend on the others of its batch"


@pytest.mark.parametrize("grid, bucket", [(14, 3), (3, 4), (3, 256)])
def test_random_maps_are_those_of_one_generator(spark, grid, bucket):
    videos = spark.createDataFrame([("a", 11), ("b", 1), ("none", 0)], "video_id string, frames int")
    rows = K.random_maps(videos, grid, bucket=bucket).collect()
    for video, n in (("a", 11), ("b", 1)):
        whole = np.random.default_rng(B.stable_seed(42, video, "random-mask")).random((n, grid, grid), dtype=np.float32)
        got = {(r.frame_idx, r.bi, r.bj): r.score for r in rows if r.video_id == video}
        assert got == {(t, i, j): float(whole[t, i, j]) for t in range(n) for i in range(grid) for j in range(grid)}
    assert len(rows) == 12 * grid * grid


@pytest.mark.parametrize("size", [8, 64, 4096])
def test_chunks_count_the_normals_of_a_stream(size):
    """Chunk after chunk, each from where the one before ended, gives the stream that one generator draws."""
    skip, first = 0, 0
    whole = np.random.default_rng(5).standard_normal(20 * size)
    for chunk in range(15):
        n, over = W.normals_of_chunk(5, chunk, skip, size)
        assert (W.normals_from(5, chunk * size + skip, 0, n) == whole[first : first + n]).all()
        first, skip = first + n, over
    assert 0.9 * 15 * size < first <= 15 * size


@pytest.mark.parametrize("bucket, chunk", [(3, 8), (2, 64), (256, 4096)])
def test_release_in_order_draws_from_one_generator(spark, bucket, chunk):
    rng = np.random.default_rng(2)
    rows = [(v, i, 4, 4 if v == "a" else 2, rng.integers(0, 255, 48 if v == "a" else 24).tolist(), rng.permutation(9)[: int(rng.integers(0, 6))].tolist() if i % 4 else None) for v, n in (("a", 40), ("b", 9)) for i in range(n)]
    schema = "video_id string, frame_idx int, height int, width int, rgb array<int>, blocks array<int>"
    f = spark.createDataFrame(rows, schema)
    got = {(r.video_id, r.frame_idx): r.rgb for r in R.release_in_order(f.repartition(3), 3, 1.0, 0.4, bucket=bucket, chunk=chunk).collect()}
    draws = {v: np.random.default_rng(B.stable_seed(42, v, "release")) for v in "ab"}
    for v, i, h, w, rgb, blocks in rows:
        t = pa.Table.from_pylist([{"video_id": v, "frame_idx": i, "height": h, "width": w, "rgb": rgb, "blocks": blocks}], pa.schema([("video_id", pa.string()), ("frame_idx", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.list_(pa.int32())), ("blocks", pa.list_(pa.int32()))]))
        noise = np.array([draws[v].normal(0, 0.4, 4) if b // 3 < h and b % 3 < w else np.zeros(4) for b in blocks or []]).reshape(-1, 4)
        assert got[v, i] == R.released(t, h, w, 3, 1.0, 0.5, noise).column("rgb")[0].as_py()


def sampled(image, y, x, reflect):
    """A value between four pixels, one at a time."""
    h, w = image.shape
    inside = (lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n))) if reflect else (lambda i, n: min(max(i, 0), n - 1))
    y0, x0 = math.floor(y), math.floor(x)
    at = lambda i, j: image[inside(y0 + i, h), inside(x0 + j, w)]
    fy, fx = y - y0, x - x0
    return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))


def test_resampling_is_pixel_by_pixel(spark):
    rng = np.random.default_rng(4)
    sizes = [(5, 7), (8, 3), (1, 1), (5, 7), (6, 6)]
    images = [rng.integers(0, 256, s) for s in sizes]
    rows = [("v", i, *x.shape, x.ravel().tolist(), 4, 9) for i, x in enumerate(images)]
    f = spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, v array<int>, full_h int, full_w int").coalesce(1)
    target = 10
    boxes = {r.frame_idx: np.array(r.v).reshape(r.height, r.width) for r in R.letterbox(f, target).collect()}
    for i, x in enumerate(images):
        h, w = x.shape
        nh, nw = round(h * target / max(h, w)), round(w * target / max(h, w))
        want = np.zeros((target, target))
        for y in range(nh):
            for z in range(nw):
                want[(target - nh) // 2 + y, (target - nw) // 2 + z] = math.floor(sampled(x, (y + 0.5) * h / nh - 0.5, (z + 0.5) * w / nw - 0.5, False) + 0.5 + 1e-9)
        assert (boxes[i] == want).all()
    truth = f.select("video_id", "frame_idx", F.lit(5).alias("height"), F.lit(7).alias("width"))
    matched = {r.frame_idx: r for r in R.match_size(f, truth).collect()}
    assert [matched[i].resized for i in range(5)] == [False, True, True, False, True] and {(r.height, r.width) for r in matched.values()} == {(5, 7)}
    back = {r.frame_idx: r for r in R.unletterbox(R.letterbox(f, 18).join(f.select("video_id", "frame_idx", F.col("height").alias("full_h"), F.col("width").alias("full_w")), ["video_id", "frame_idx"])).collect()}
    assert all((back[i].height, back[i].width) == s for i, s in enumerate(sizes)) and back[2].v == images[2].ravel().tolist()
    flow = [(float(a), float(b)) for a, b in rng.normal(0, 6, (35, 2))]
    g = f.where("height = 5").withColumns({"dx": F.array(*(F.lit(a) for a, _ in flow)), "dy": F.array(*(F.lit(b) for _, b in flow))})
    for r in R.warp(g).collect():
        x = images[r.frame_idx]
        assert r.v == [math.floor(sampled(x, i // 7 - dy, i % 7 - dx, True) + 0.5 + 1e-9) for i, (dx, dy) in enumerate(flow)]
    assert R.letterbox(f.where("false"), 4).count() == 0


def test_frames_that_cannot_stand_beside_the_truth(spark):
    f = spark.createDataFrame([(v, i, 1, 1, [i]) for v, places in (("ok", (0, 1)), ("short", (0,)), ("late", (1, 2)), ("extra", (0, 1))) for i in places], "video_id string, frame_idx int, height int, width int, v array<int>")
    truth = spark.createDataFrame([(v, i, 1, 2, [i, i]) for v in ("ok", "short", "late", "gone") for i in (0, 1)], f.schema)
    bad = {r.video_id: (r.n_frames, r.n_truth, r.reason) for r in R.count_failures(f, truth).collect()}
    assert bad == {"short": (1, 2, "frame count"), "late": (2, 2, "frame places"), "gone": (0, 2, "frame count"), "extra": (2, 0, "frame count")}
    assert sorted((r.video_id, r.frame_idx, r.v) for r in R.aligned(f, truth).collect()) == [("ok", 0, [0, 0]), ("ok", 1, [1, 1])]


def test_stored_frames_and_their_failures(spark):
    rows = [("a", 0, 1, 2, None, bytes(6)), ("a", 1, 1, 2, float("nan"), bytes(6)), ("b", 0, 1, 1, 24.0, bytes(3)), ("c", 0, 1, 1, -1.0, bytes(2)), ("d", 0, 1, 1, 30.0, None)]
    raw = spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, fps double, rgb binary")
    frames, failures = I.frame_table(raw, spark.createDataFrame([(v,) for v in "abcdde"], "video_id string"))
    assert sorted((r.video_id, r.frame_idx, r.fps) for r in frames.collect()) == [("a", 0, 25.0), ("a", 1, 25.0), ("b", 0, 24.0)]
    assert sorted(map(tuple, failures.collect())) == [("c", "frame size"), ("d", "frame size"), ("e", "no frames")]


def test_too_few_classes_are_an_error(spark):
    v = spark.createDataFrame([("x", "x/1"), ("x", "x/2"), ("y", "y/1")], "class string, path string")
    assert I.balanced_subset(v, 1, 2).count() == 2
    with pytest.raises(ValueError, match="1 classes"):
        I.balanced_subset(v, 2, 2)


def test_epsilon_at_the_bottom_of_the_curve(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(1, 10**5)), int(rng.integers(1, 60)), float(10 ** rng.uniform(-2, 3)), float(10 ** rng.uniform(-1, 7)), float(10 ** rng.uniform(-14, 0))) for _ in range(500)]
    df = spark.createDataFrame(rows, "t int, k int, c double, s double, d double")
    cols = [F.col(x) for x in "tkcsd"]
    curve = F.array_min(F.transform(A.rdp_curve(*cols), lambda p: F.struct(p["eps"].alias("eps"), p["alpha"].alias("alpha"), p["rho"].alias("rho"))))
    for r in df.select(A.best_epsilon(*cols).alias("a"), curve.alias("b")).collect():
        assert (r.a.eps, r.a.alpha, r.a.rho) == (r.b.eps, r.b.alpha, r.b.rho)


def test_ema_and_letterbox(spark):
    f = video(spark, np.array([[[0, 100]], [[100, 0]]]), 1, 2)
    assert [r.v for r in R.temporal_ema(f, 0.5).orderBy("frame_idx").collect()] == [[0, 100], [50, 50]]
    box = R.letterbox(video(spark, np.full((1, 2, 4), 7), 2, 4), 8).first()
    assert (box.height, box.width) == (8, 8) and box.v[:16] == [0] * 16 and box.v[16:48] == [7] * 32


def test_clip_split_edges(spark):
    v = spark.createDataFrame([("a", 1), ("b", 16), ("c", 17), ("d", 24), ("e", 0)], "video_id string, frames int")
    c = C.clips(v)
    assert {r.video_id: r["count"] for r in c.groupBy("video_id").count().collect()} == {"a": 16, "b": 16, "c": 32, "d": 32}
    assert c.where("video_id = 'a'").agg(F.max("src_frame_idx")).first()[0] == 0


def test_rows_that_become_many_are_dealt_out_first(spark, data):
    from blockalloc.jobs import integrity as J

    tasks = lambda rows: rows.select(F.spark_partition_id()).distinct().count()
    videos = spark.createDataFrame([(f"v{i}", 30) for i in range(200)], "video_id string, frames int").coalesce(1)
    for rows in (C.clips(videos), J.calibrated(spark, data), J.run_grid(spark, data)):
        assert tasks(rows) == 4


def test_policies_share_what_they_number(spark, data, monkeypatch):
    from blockalloc.jobs import blocks as J
    from blockalloc.sources import views as V

    calls, placed = [], V.placed
    monkeypatch.setattr(V, "placed", lambda spark, d: calls.append(d) or placed(spark, d))
    assert J.policies(spark, data).select("policy").distinct().count() == len(J.POLICIES)
    assert len(calls) <= 5, "motion, cues, moves, risk and frames"


def test_overlap_fallbacks(spark):
    rows = [("a", c, i, 0, 0, 0.5) for c in range(2) for i in range(16)]
    f = spark.createDataFrame(rows, "video_id string, clip_idx int, local_i int, bi int, bj int, score double")
    ref = {r.frame_idx: r.score for r in C.merge_overlaps(f, 16, 8).collect()}
    near = {r.frame_idx: r.score for r in C.merge_overlaps(f, 16, 8, fallback="nearest").collect()}
    assert ref[0] == 0 and ref[23] == pytest.approx(0.5 * (1 - 6.5 / 7.5) ** 1.7) and ref[10] == pytest.approx(0.5)
    assert near[0] == near[23] == 0.5


def test_no_moves_keep_paths_in_place(spark):
    f = spark.createDataFrame([("a", 0, i, b, 0.0, 0.0) for i in range(15) for b in range(16)], "video_id string, clip_idx int, flow_idx int, b int, dx double, dy double")
    p = C.paths(C.next_block(f, 8, 4, 2), 4).collect()
    assert len(p) == 16 and all(r.path == [r.traj_id] * 8 for r in p)


@pytest.mark.parametrize("axis", ["dx", "dy"])
def test_noise_of_a_mean_flow_decides_no_tie(spark, axis):
    pairs = [(-i / 10_000, round(2 + i / 10_000, 4)) for i in range(300_000, 303_000)]
    more, less = [p for p in pairs if sum(p) > 2][:40], [p for p in pairs if sum(p) < 2][:40]
    rows = [("v", k, i, 5, x, 0.0) for k, pair in enumerate(more) for i, x in enumerate(pair)]
    rows += [("w", k, i, 5, -x, 0.0) for k, pair in enumerate(less) for i, x in enumerate(pair)]
    f = spark.createDataFrame(rows, f"video_id string, clip_idx int, flow_idx int, b int, {axis} double, {'dy' if axis == 'dx' else 'dx'} double")
    got = {(r.video_id, r.dest) for r in C.next_block(f, 8, 4, 2).collect()}
    assert got == {("v", 5), ("w", 4 if axis == "dx" else 1)}, "halfway between two blocks the first one wins"


def test_missing_csv_has_no_rows(spark, tmp_path):
    assert I.read_csv(spark, str(tmp_path / "none"), "a int, b string").count() == 0
    I.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"), ["b", "a"])
    assert I.read_csv(spark, str(tmp_path / "t"), "b string, a int").collect() == [("x", 1)]


def test_completeness_counts(spark):
    grid = spark.createDataFrame([(i,) for i in range(3)], "k int")
    runs = spark.createDataFrame([(0,), (0,), (5,)], "k int")
    r = I.completeness(runs, grid, ["k"]).first()
    assert tuple(r) == (3, 1, 2, 1, 1, "INCOMPLETE")
    assert I.completeness(grid, grid, ["k"]).first().status == "COMPLETE"


def test_number_formats(spark):
    got = one(spark, *(S.fixed(F.lit(float(x)), 6) for x in ("nan", "inf", "-inf", "0.5")), S.p_text(F.lit(0.0000019)), S.p_text(F.lit(0.25)))
    assert list(got) == ["nan", "inf", "inf", "0.500000", "1.90e-06", "0.250000"]


#: Published differences in coverage of 20 videos, in order of their ids, and the seed of their interval.
COVER = [
    0.106581, 0.320654, 0.336321, 0.321459, 0.063062, 0.221784, 0.225846, 0.073988, 0.190250, 0.112027,
    0.197464, 0.089422, 0.082794, 0.035201, 0.024554, 0.100018, 0.179949, 0.183800, 0.012812, 0.162118,
]
COVER_SEED = 2734175551


def test_published_paired_statistics(spark):
    rows = [("L vs R", "cover", f"v{i:02}", x) for i, x in enumerate(COVER)]
    d = spark.createDataFrame(rows, "comparison string, metric string, video_id string, difference double")
    s = S.summary_table(d).first()
    assert s.n == s.positive_pairs == 20 and s.negative_pairs == s.ties == 0
    want = {"mean_difference": 0.1520052, "median_difference": 0.1370725, "difference_sd": 0.098729975, "cohen_dz": 1.539605373, "hedges_gz": 1.474551625, "exact_sign_p": 0.000001907}
    for name, x in want.items():
        assert s[name] == pytest.approx(x, abs=1e-9)
    ci = B.exact_intervals(d, ["comparison", "metric"], "video_id", lambda *_: COVER_SEED).first()
    assert (round(ci.ci95_low, 6), round(ci.ci95_high, 6)) == (0.111120, 0.195839)


def test_errors_of_a_release_in_one_python_step(spark):
    rng = np.random.default_rng(4)
    rows = [(f"v{i % 3}", i, 5, 8 - i % 2, rng.integers(0, 256, 5 * (8 - i % 2)).tolist(), None if i % 4 == 0 else sorted(rng.choice(16, i % 5, replace=False).tolist())) for i in range(1300)]
    f = JB.backend(spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, v array<int>, blocks array<int>"))
    one, two = JB.release_errors(f, 4), JB.errors(JB.block_mean_release(f, 4), "v")
    key = ["frame_idx", "bi", "bj"]
    got, want = (d.toPandas().sort_values(key, ignore_index=True) for d in (one, two))
    assert got.equals(want[got.columns]) and len(got) == 1300 * 16
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert plan(one) == 1 and plan(two) == 2
