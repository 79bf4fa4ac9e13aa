"""Grouped summaries and paired comparisons of run metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from blockalloc.operators.quantiles import alike, exact_quantiles

METRICS = ("cover", "raw_errshare", "inc_errshare")


def finite(c: Column) -> Column:
    """The value where it is neither null, NaN nor infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def grouped_means(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric by any keys."""
    return rows.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))


def aggregate_table(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Rows, mean and population deviation of each metric by the keys."""
    spread = [c for m in metrics for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *spread)


def finite_aggregate(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """As ``aggregate_table``, skipping NaN and infinite values; NaN where nothing finite is left."""
    spread = [F.coalesce(f(finite(F.col(m))), F.lit(float("nan"))).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "avg"), (F.stddev_pop, "std"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *spread)


def in_order(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of the named keys with their rank; keys that the order doesn't name go."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    return rows.withColumn("rank", rank.cast("int")).where("rank > 0")


def seed_aggregate(rows: DataFrame, keys: Sequence[str] = ("video_id", "policy"), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Seeds, mean, population deviation, minimum and maximum of each metric."""
    parts = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *parts)


def checked_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], required: Sequence[str], method: str = "", methods: Sequence[str] = (), units: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Left join, one to one: (merged rows, problems as (problem, keys)).

    A key that stands twice on either side is a problem, and so is a required column
    that is null or NaN after the join. With ``methods``, so is each of them that the key column ``method`` lacks,
    or that doesn't have ``units`` different units (combinations of the other keys; by default as many as there are in all).
    """
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("key")
    twice = [x.groupBy(*keys).count().where("count > 1").select(F.lit(f"duplicate on the {side}").alias("problem"), name) for x, side in ((left, "left"), (right, "right"))]
    merged = left.join(right, list(keys), "left")
    gap = reduce(Column.__or__, (F.col(c).isNull() | F.isnan(c) for c in required))
    problems = twice[0].union(twice[1]).union(merged.where(gap).select(F.lit("missing metric").alias("problem"), name))
    if not methods:
        return merged, problems
    unit = F.struct(*(k for k in keys if k != method))
    seen = left.groupBy(F.col(method).alias("_method")).agg(F.count_distinct(unit).alias("_units"))
    whole = F.lit(units).cast("long") if units is not None else left.agg(F.count_distinct(unit)).scalar()
    wanted = left.sparkSession.createDataFrame([(m,) for m in methods], "key string")
    found = wanted.join(seen, F.col("key") == F.col("_method"), "left")
    problem = F.when(F.col("_units").isNull(), "missing method").when(F.col("_units") != whole, "units of a method")
    return merged, problems.union(found.select(problem.alias("problem"), "key").where("problem is not null"))


def paired_differences(rows: DataFrame, pairs: Sequence[tuple[str, str]], unit: Sequence[str] = ("video_id",), by: Sequence[str] = (), policy: str = "policy", metrics: Sequence[str] = METRICS) -> DataFrame:
    """(by, unit, comparison, metric, left_value, right_value, difference) for units that have both policies, finite.

    One shuffle: each unit's policies become columns by conditional aggregation, and the
    few comparisons and metrics are spread out from there, without a self-join.
    """
    names = sorted({p for pair in pairs for p in pair})
    keys = [*by, *unit]
    wide = rows.where(F.col(policy).isin(names)).groupBy(*keys).agg(*(F.max(F.when(F.col(policy) == p, F.col(m))).alias(f"{p}|{m}") for p in names for m in metrics))
    cells = [
        F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.lit(m).alias("metric"), F.col(f"`{a}|{m}`").alias("left_value"), F.col(f"`{b}|{m}`").alias("right_value"))
        for a, b in pairs
        for m in metrics
    ]
    long = wide.select(*keys, F.inline(F.array(*cells)))
    long = long.where(finite(F.col("left_value")).isNotNull() & finite(F.col("right_value")).isNotNull())
    return long.withColumn("difference", F.col("left_value") - F.col("right_value"))


@F.pandas_udf(DoubleType())
def sign_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Exact two-sided sign-test p in logarithms, for any number of pairs; 1 where no pair differs.

    Binomial terms are added from the largest down. They fall at least as exp(-2 j^2 / n),
    so the terms left out are below exp(-50) of the first.
    """
    out = []
    for w, x in zip(wins, losses, strict=True):
        n, tail = int(w + x), int(min(w, x))
        top = n * np.log(0.5)
        for lo in range(1, tail + 1, 1 << 20):  # sums of logarithms are exact where differences of lgamma are not
            i = np.arange(lo, min(tail + 1, lo + (1 << 20)))
            top += np.sum(np.log((n - tail) / i + 1))
        k = tail - np.arange(min(tail, 100 + int(5 * np.sqrt(n))))
        down = np.r_[0.0, np.cumsum(np.log(k) - np.log(n - k + 1))]
        out.append(min(1.0, 2 * float(np.exp(top + np.log(np.exp(down).sum())))))
    return pd.Series(out)


def judged(places: int | None = None) -> Column:
    """The difference as wins are told from it: to some places, where rounding noise of means would else break ties."""
    return F.col("difference") if places is None else F.round("difference", places)


def outcomes(tie: float = 0.0, direction: str = "higher", places: int | None = None) -> tuple[Column, Column, Column]:
    """Wins of the left side, of the right, and ties of at most ``tie``."""
    d = judged(places) if direction == "higher" else -judged(places)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return count(d > tie), count(d < -tie), count(F.abs(d) <= tie)


def paired_table(differences: DataFrame, by: Sequence[str] = (), tie: float = 0.0, direction: str = "higher", tie_in_test: float = 0.0, places: int | None = None) -> DataFrame:
    """Pairs, wins, losses, ties, mean difference and exact sign p of each comparison and metric; wins and ties are told from differences to ``places``."""
    w, x, t = outcomes(tie, direction, places)
    tw, tx, _ = outcomes(tie_in_test, places=places)
    out = differences.groupBy(*by, "comparison", "metric").agg(F.count("*").alias("paired_units"), w.alias("left_wins"), x.alias("right_wins"), t.alias("ties"), F.avg("difference").alias("mean_diff"), tw.alias("_w"), tx.alias("_x"))
    return out.withColumn("exact_sign_p", sign_p("_w", "_x")).drop("_w", "_x")


def effect_sizes(mean: Column, sd: Column, n: Column) -> tuple[Column, Column]:
    """Paired Cohen dz and Hedges gz (correction 1 - 3 / (4n - 9) as published); NaN for a zero or unknown deviation."""
    dz = F.when(sd > 0, mean / sd).otherwise(float("nan"))
    return dz, dz * (1 - 3 / (4 * n - 9))


def summary_table(differences: DataFrame, by: Sequence[str] = (), places: int | None = None) -> DataFrame:
    """Mean, median, sample deviation, effect sizes, wins and sign p of each comparison and metric; wins and ties are told from differences to ``places``."""
    tie = 1e-12
    w, x, t = outcomes(tie, places=places)
    keys = [*by, "comparison", "metric"]
    differences = differences.select(*keys, "difference").checkpoint()  # read by the medians and below
    names = [f"_key_{i}" for i in range(len(keys))]
    medians = exact_quantiles(differences, keys, "difference", (0.5,)).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("q")[0].alias("median_difference"))
    out = differences.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("difference_sd"),
        F.sum((judged(places) > 0).cast("int")).alias("positive_pairs"), F.sum((judged(places) < 0).cast("int")).alias("negative_pairs"), t.alias("ties"), w.alias("_w"), x.alias("_x"),
    )
    out = out.join(medians, alike(keys, names), "left").drop(*names)
    dz, gz = effect_sizes(F.col("mean_difference"), F.col("difference_sd"), F.col("n"))
    return out.withColumns({"cohen_dz": dz, "hedges_gz": gz, "exact_sign_p": sign_p("_w", "_x")}).drop("_w", "_x")


def pair_lookup(stats: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of the wanted comparisons; one that exists only the other way round is turned.

    Turning swaps wins and negates the mean difference; where the table has an interval,
    its bounds are negated and swapped.
    """
    ends = [(-F.col("ci95_high")).alias("ci95_low"), (-F.col("ci95_low")).alias("ci95_high")] if "ci95_low" in stats.columns else []
    turned = stats.select(
        F.concat(F.substring_index("comparison", " vs ", -1), F.lit(" vs "), F.substring_index("comparison", " vs ", 1)).alias("comparison"), "metric", "paired_units",
        F.col("right_wins").alias("left_wins"), F.col("left_wins").alias("right_wins"), "ties", (-F.col("mean_diff")).alias("mean_diff"), *ends, "exact_sign_p", F.lit(1).alias("turned"),
    )
    both = stats.select(*turned.columns[:-1], F.lit(0).alias("turned")).unionByName(turned)
    both = both.where(F.col("comparison").isin([f"{a} vs {b}" for a, b in wanted]))
    first = both.groupBy("comparison", "metric").agg(F.min_by(F.struct(*both.columns[2:]), "turned").alias("s"))
    return first.select("comparison", "metric", "s.*")


def fixed(c: Column, digits: int) -> Column:
    """A number as text with fixed decimals; nan and inf by name (inf for either sign), as the reports print them."""
    return F.when(F.isnan(c), F.lit("nan")).when(F.abs(c) == float("inf"), F.lit("inf")).otherwise(F.format_string(f"%.{digits}f", c))


def p_text(p: Column) -> Column:
    """A p value: scientific with two decimals below .001, else six decimals."""
    return F.when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.6f", p))
