"""Recurrences in buckets against one pass in order."""

import numpy as np
import pytest

from blockalloc.operators import recurrence as Q
from blockalloc.operators import release as R


def video(spark, frames, name="v", gaps=1, size=4, seed=0):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 256, (frames, size))
    rows = [(name, int(i * gaps), 2, size // 2, values[i].tolist()) for i in range(frames)]
    return spark.createDataFrame(rows, "video_id string, frame_idx int, height int, width int, v array<int>"), values


def in_order(df):
    return np.array([r.v for r in df.orderBy("frame_idx").collect()])


def ema(values, keep):
    carry, out = None, []
    for v in values.astype(float):
        carry = v if carry is None else keep * carry + (1 - keep) * v
        out.append(np.clip(np.round(carry), 0, 255))
    return np.array(out)


def causal(values, mix=0.72, keep=0.82):
    carry, out = None, []
    for v in values.astype(float):
        carry = v if carry is None else np.clip(np.round(keep * np.round(mix * v + (1 - mix) * carry) + (1 - keep) * carry), 0, 255)
        out.append(carry)
    return np.array(out)


@pytest.mark.parametrize("keep", [0.0, 0.4, 0.9, 0.99])
@pytest.mark.parametrize("bucket, gaps", [(1, 1), (7, 1), (8, 13), (1000, 1)])
def test_affine_scan_is_one_pass(spark, keep, bucket, gaps):
    df, values = video(spark, 60, gaps=gaps)
    assert (in_order(R.temporal_ema(df.repartition(3), keep, bucket=bucket)) == ema(values, keep)).all()


@pytest.mark.parametrize("bucket, gaps, warm", [(1, 1, 1), (7, 1, 3), (8, 13, 4), (16, 1, 0), (16, 1, 16), (1000, 1, 5)])
def test_guesses_are_checked_and_mended(spark, bucket, gaps, warm):
    df, values = video(spark, 60, gaps=gaps)
    assert (in_order(R.causal_smoothing(df.repartition(3), bucket=bucket, warm=warm)) == causal(values)).all()


def test_a_recurrence_that_never_forgets_still_ends(spark):
    df, values = video(spark, 40)
    step = lambda carry, v: (v if carry is None else (carry + v) % 251,) * 2
    got = Q.replay(df, Q.settled_carries(df, step, "v", 8, 2), step, "v", 8)
    want, carry = [], None
    for v in values.astype(float):
        carry, _ = step(carry, v)
        want.append(carry)
    assert (in_order(got) == np.array(want)).all()


def test_a_long_video_is_many_tasks(spark):
    df, values = video(spark, 100_000, size=2)
    df = df.repartition(8).cache()
    assert (in_order(R.temporal_ema(df, 0.4)) == ema(values, 0.4)).all()
    smoothed = R.causal_smoothing(df)
    assert (in_order(smoothed) == causal(values)).all()
    assert Q.dealt(df, "v", Q.BUCKET).select("bucket").distinct().count() == -(-100_000 // Q.BUCKET)
    df.unpersist()


def test_several_videos_and_none(spark):
    a, va = video(spark, 30, "a", seed=1)
    b, vb = video(spark, 5, "b", seed=2)
    both = a.unionByName(b)
    for f, plain in ((lambda x: R.temporal_ema(x, 0.6, bucket=4), lambda v: ema(v, 0.6)), (lambda x: R.causal_smoothing(x, bucket=4, warm=2), causal)):
        got = f(both)
        assert (in_order(got.where("video_id = 'a'")) == plain(va)).all() and (in_order(got.where("video_id = 'b'")) == plain(vb)).all()
        assert f(both.where("frame_idx < 0")).count() == 0
