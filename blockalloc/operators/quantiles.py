"""Exact quantiles of groups of any size, by histograms that narrow to a rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a group up to which one aggregation buffer holds all its values.
SMALL = 1 << 16
#: Bins of a histogram.
BINS = 1024


def alike(a: Sequence[str], b: Sequence[str]) -> Column:
    """Equality of key columns in which null equals null."""
    same = F.lit(True)
    for x, y in zip(a, b, strict=True):
        same = same & F.col(x).eqNullSafe(F.col(y))
    return same


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Where a value stands between two finite ends: infinities and NaN have bins of their own below and above."""
    wide = hi / 2 > lo / 2  # halves, since a difference may overflow
    inside = F.when(wide, F.least(F.lit(bins - 1), F.floor((x / 2 - lo / 2) / F.when(wide, hi / 2 - lo / 2) * bins))).otherwise(F.when(x > lo, bins - 1).otherwise(0))
    return F.when(F.isnan(x), bins + 1).when(x == float("inf"), bins).when(x == float("-inf"), -1).otherwise(inside).cast("int")


def order_statistics(values: DataFrame, wanted: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """(keys, rank, value): the value at each wanted rank (from 0) of its group, for groups of any size.

    ``values`` has the keys and a double ``_x``; ``wanted`` the keys and ``rank``. Each
    round adds up, for every wanted rank, how many of the values still in question fall
    into each of ``bins`` bins between their ends, with the smallest and largest of each
    bin; the bin that holds the rank becomes the next round's question. Counts of tasks add up, so what a task
    sends is bounded by bins and ranks, whatever the size of a group. A rank is settled
    once its bin holds a single value; as the smallest and largest value always part, it
    settles. No buffer grows with a group and no value is approximated.
    """
    names = [f"_key_{i}" for i in range(len(keys))]
    finite = F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x"))
    ends = values.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    ends = ends.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "_lo", "_hi")
    open_ = wanted.join(ends, alike(keys, names)).drop(*names).withColumn("_left", F.col("rank")).checkpoint()
    done = None
    while True:
        asked = open_.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "rank", "_left", "_lo", "_hi")
        x = F.col("_x")
        first = done is None
        inside = F.lit(True) if first else (x >= F.col("_lo")) & (x <= F.col("_hi")) & ~F.isnan(x)
        lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(0.0))
        hits = values.join(asked, alike(keys, names) & inside).withColumn("_bin", bin_of(x, lo, hi, bins))
        counts = hits.groupBy(*keys, "rank", "_left", "_bin").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("_below", below).where((F.col("_below") <= F.col("_left")) & (F.col("_left") < F.col("_below") + F.col("_n")))
        found = found.select(*keys, "rank", (F.col("_left") - F.col("_below")).alias("_left"), "_lo", "_hi").checkpoint()
        settled = (F.col("_lo") == F.col("_hi")) | F.isnan("_lo")
        part = found.where(settled).select(*keys, "rank", F.col("_lo").alias("value"))
        done = part if done is None else done.unionByName(part)
        open_ = found.where(~settled)
        if open_.isEmpty():
            return done


def exact_quantiles(rows: DataFrame, keys: Sequence[str], column: str, points: Sequence[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(keys, q): the array of exact quantiles of each group, interpolated linearly between neighbours; nulls don't count.

    Groups of up to ``small`` rows are aggregated in one buffer of that many values at
    most; larger ones go through ``order_statistics``. Both give the same numbers. NaN
    ranks above all others. ``rows`` is read several times: cut its lineage before.
    """
    keys = list(keys)
    values = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_x"))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n")).checkpoint()
    names = [f"_of_{i}" for i in range(len(keys))]
    large = sizes.where(F.col("_n") > small)
    renamed = large.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    if large.isEmpty():
        return values.groupBy(*keys).agg(F.percentile("_x", F.array(*map(F.lit, points))).alias("q"))
    rest = values.join(renamed, alike(keys, names), "left_anti").groupBy(*keys).agg(F.percentile("_x", F.array(*map(F.lit, points))).alias("q"))
    big = values.join(renamed, alike(keys, names), "left_semi").checkpoint()
    at = lambda p: (F.col("_n") - 1) * float(p)
    ranks = F.array_distinct(F.array(*(f(at(p)).cast("long") for p in points for f in (F.floor, F.ceil))))
    found = order_statistics(big, large.select(*keys, F.explode(ranks).alias("rank")), keys, bins)
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_v")).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "_v")
    out = large.join(found, alike(keys, names))

    def between(p: float) -> Column:
        lo, hi = F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")
        a, b = F.element_at("_v", lo), F.element_at("_v", hi)
        return F.when(a.eqNullSafe(b), a).otherwise((hi - at(p)) * a + (at(p) - lo) * b)

    return rest.unionByName(out.select(*keys, F.array(*map(between, points)).alias("q")))
