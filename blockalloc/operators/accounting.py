"""Seeds and Renyi accounting as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

ALPHAS = (2, 128)


def stable_seed(seed: Column, *parts: Column) -> Column:
    """SHA-256 over the parts with a NUL before each after the first; its first eight bytes, little-endian, mod 2^32 - 1."""
    data = seed.cast("string").cast("binary")
    for p in parts:
        data = F.concat(data, F.unhex(F.lit("00")), p.cast("string").cast("binary"))
    digest = F.sha2(data, 256)
    swapped = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return (F.conv(swapped, 16, 10).cast("decimal(20,0)") % F.lit(4294967295).cast("decimal(20,0)")).cast("long")


#: Fixed values of the seed mix: what is added to each part, the multiplier and the fold.
MIX_ADD, MIX_TIMES, MIX_SHIFT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 27


def seed_mix(seeds: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Wrapping 64-bit mix of whole columns of seeds with rows of parts, mod 2^32 - 1."""
    h = seeds.astype(np.uint64)
    for column in parts.T.astype(np.uint64) + np.uint64(MIX_ADD):
        h = (h ^ column) * np.uint64(MIX_TIMES)
        h = h ^ (h >> np.uint64(MIX_SHIFT))
    return h % np.uint64(2**32 - 1)


@F.pandas_udf(LongType())
def mixed_seed(seed: pd.Series, frame: pd.Series, segment: pd.Series, bi: pd.Series, bj: pd.Series, channel: pd.Series) -> pd.Series:
    """A seed for each block and channel of a frame; vectorised, since 64-bit wrapping isn't to be had in ANSI SQL."""
    parts = np.stack([x.to_numpy(np.int64).view(np.uint64) for x in (frame, segment, bi, bj, channel)], axis=1)
    return pd.Series(seed_mix(seed.to_numpy(np.int64).view(np.uint64), parts).astype(np.int64))


def sensitivity(clip: Column, k: Column) -> Column:
    return 2 * clip * F.sqrt(k)


def clamped(delta: Column) -> Column:
    return F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), delta))


def rdp_curve(frames: Column, k: Column, clip: Column, sigma: Column, delta: Column) -> Column:
    """Array of (alpha, rho, eps) for alpha from 2 to 128; inline or explode it for the rows of the curve."""
    d = sensitivity(clip, k)
    rho = lambda a: frames * a * d * d / (2 * sigma * sigma)
    return F.transform(F.sequence(*map(F.lit, ALPHAS)), lambda a: F.struct(a.alias("alpha"), rho(a).alias("rho"), (rho(a) + F.log(1 / clamped(delta)) / (a - 1)).alias("eps")))


def best_epsilon(frames: Column, k: Column, clip: Column, sigma: Column, delta: Column) -> Column:
    """Struct (eps, alpha, rho, sensitivity) at the smallest eps, the first alpha that attains it.

    eps = c alpha + ln(1 / delta) / (alpha - 1) is convex in alpha, with its minimum at
    1 + sqrt(ln(1 / delta) / c): the whole numbers around it, inside the curve's ends, are all
    that is compared. Null where frames, k, clip or sigma isn't positive: such a row is invalid.
    """
    d = sensitivity(clip, k)
    low, high = ALPHAS
    per = lambda a: frames * a * d * d / (2 * sigma * sigma)
    loss = F.log(1 / clamped(delta))
    valid = (frames > 0) & (k > 0) & (clip > 0) & (sigma > 0)
    bottom = F.floor(F.least(F.lit(float(high)), 1 + F.sqrt(loss / F.when(valid, per(F.lit(1)))))).cast("int")
    near = F.sequence(F.greatest(F.lit(low), bottom - 1), F.greatest(F.lit(low), F.least(F.lit(high), bottom + 2)))
    best = F.array_min(F.transform(near, lambda a: F.struct((per(a) + loss / (a - 1)).alias("eps"), a.alias("alpha"), per(a).alias("rho"))))
    # through an array of one, so that the candidates are evaluated once and not for each field
    whole = lambda s: F.struct(s["eps"].alias("eps"), s["alpha"].alias("alpha"), s["rho"].alias("rho"), d.alias("sensitivity"))
    return F.when(valid, F.transform(F.array(best), whole)[0])


def sigma_for(target: Column, frames: Column, k: Column, clip: Column, delta: Column) -> Column:
    """The sigma at which the best eps is ``target``, in closed form: each alpha that can reach it gives one, the least counts."""
    d = sensitivity(clip, k)
    left = lambda a: target - F.log(1 / clamped(delta)) / (a - 1)
    reach = F.filter(F.sequence(*map(F.lit, ALPHAS)), lambda a: left(a) > 0)
    return F.array_min(F.transform(reach, lambda a: F.sqrt(a * frames * d * d / (2 * left(a)))))


def theorem_scope(mask_source: Column) -> tuple[Column, Column]:
    """(claim, warning): only a mask fixed before the data is covered."""
    fixed = mask_source.isin("external", "fixed")
    return F.when(fixed, F.lit("covered")).otherwise(F.lit("not covered")), F.when(fixed, F.lit(None).cast("string")).otherwise(F.lit("mask depends on the released data"))


def release_rules(report: Column) -> Column:
    """Names of the failed rules of a report struct; an empty array lets the release proceed."""
    checks = {
        "noise": report["noise"] == "iid", "raw_mixing": ~report["raw_mixing"], "high_freq": report["high_freq"] == "zeroed", "chroma": report["chroma"] == "fixed",
        "kappa": report["kappa"] == 1, "claim": report["claim"] == report["scope"],
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in checks.items())))
