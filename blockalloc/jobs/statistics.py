"""Queries over run metrics: summaries, paired tables and their report forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.operators import bootstrap as B
from blockalloc.operators import statistics as S
from blockalloc.sources.views import RUNS_SQL, runs

M = S.METRICS
PAIRS = [("AF", "NO"), ("AF", "RF"), ("NO", "RF"), ("NF", "AF")]
#: Seeds of the published intervals.
SUITE_SEED, MAIN_SEED, INCREMENTAL_SEED = 20260906, 20260901, 20260905
#: Means of several runs carry rounding noise, so the queries call differences of up to 1e-12 ties.
TIES = {"tie": 1e-12, "tie_in_test": 1e-12}
#: Places to which wins by means are told where the tolerance is none, or one that differences can meet.
PLACES = 12


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Named columns (all doubles unless told) to some places."""
    names = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) for n in names})


def nine(df: DataFrame) -> DataFrame:
    """Nine places: means of two-digit numbers over few runs end in a five at the seventh."""
    return rounded(df, digits=9)


def each(expr: str, metrics=M) -> str:
    return ", ".join(expr.format(m=m) for m in metrics)


def diff_sql(by: str = "", pairs=PAIRS, metrics=M, source: str = "runs", collapse: bool = True) -> str:
    """CTEs ``means`` (mean by unit and policy) and ``d`` (paired differences)."""
    keys = "".join(f"{b}, " for b in by.split(",") if b)
    on = "".join(f" AND l.{b.strip()} = r.{b.strip()}" for b in by.split(",") if b)
    out = "".join(f"l.{b.strip()}, " for b in by.split(",") if b)
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    parts = " UNION ALL ".join(f"SELECT {out}l.video_id, p.a || ' vs ' || p.b AS comparison, '{m}' AS metric, l.{m} AS left_value, r.{m} AS right_value, l.{m} - r.{m} AS difference FROM p JOIN means l ON l.policy = p.a JOIN means r ON r.policy = p.b AND l.video_id = r.video_id{on}" for m in metrics)
    return f"means AS (SELECT {keys}video_id, policy, {each('avg({m}) AS {m}', metrics)} FROM {source} GROUP BY ALL), p(a, b) AS (VALUES {values}), d AS ({parts})"


SIGN = "least(1, 2 * list_sum(list_transform(range(0, least(w, x) + 1), lambda i: exp(lgamma(w + x + 1) - lgamma(i + 1) - lgamma(w + x - i + 1) - (w + x) * ln(2)))))"


def table_sql(by: str = "", tie: str = "1e-12", direction: int = 1, tie_in_test: str = "1e-12") -> str:
    keys = "".join(f"{b.strip()}, " for b in by.split(",") if b)
    s = direction
    return f"""t AS (SELECT {keys}comparison, metric, count(*) AS paired_units,
      CAST(sum(CASE WHEN {s} * difference > {tie} THEN 1 ELSE 0 END) AS BIGINT) AS left_wins, CAST(sum(CASE WHEN {s} * difference < -{tie} THEN 1 ELSE 0 END) AS BIGINT) AS right_wins,
      CAST(sum(CASE WHEN abs(difference) <= {tie} THEN 1 ELSE 0 END) AS BIGINT) AS ties, avg(difference) AS mean_diff,
      CAST(sum(CASE WHEN difference > {tie_in_test} THEN 1 ELSE 0 END) AS BIGINT) AS w, CAST(sum(CASE WHEN difference < -{tie_in_test} THEN 1 ELSE 0 END) AS BIGINT) AS x FROM d GROUP BY ALL),
    t2 AS (SELECT {keys}comparison, metric, paired_units, left_wins, right_wins, ties, mean_diff, CASE WHEN w + x = 0 THEN 1 ELSE {SIGN} END AS exact_sign_p FROM t)"""


def pick(by: str = "", digits: int = 9) -> str:
    keys = "".join(f"{b.strip()}, " for b in by.split(",") if b)
    return f"SELECT {keys}comparison, metric, paired_units, left_wins, right_wins, ties, round(mean_diff, {digits}) AS mean_diff, round(exact_sign_p, {digits}) AS exact_sign_p FROM t2"


def e1(spark: SparkSession, d: str) -> DataFrame:
    """Seeds are averaged for each video and policy, then policies are paired over videos."""
    return S.paired_differences(S.grouped_means(runs(spark, d), ["video_id", "policy"]), PAIRS)


def e2(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_differences(S.grouped_means(runs(spark, d), ["video_id", "top_k", "policy"]), PAIRS, by=["top_k"])


def per_seed(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_differences(S.grouped_means(runs(spark, d), ["video_id", "seed", "policy"]), PAIRS, by=["seed"])


def holed(spark: SparkSession, d: str) -> DataFrame:
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return runs(spark, d).withColumn("cover", F.when(F.col("seed") == 3, nan).when(F.col("seed") == 4, inf).otherwise(F.col("cover")))


HOLED_SQL = f"{RUNS_SQL}, holed AS (SELECT * REPLACE (CASE WHEN seed = 3 THEN CAST('NaN' AS DOUBLE) WHEN seed = 4 THEN CAST('Infinity' AS DOUBLE) ELSE cover END AS cover) FROM runs)"


def h6(spark: SparkSession, d: str) -> DataFrame:
    m = S.grouped_means(runs(spark, d), ["video_id", "policy"])
    left = m.select("video_id", "policy", "cover").union(m.where("video_id = 'v1'").select("video_id", "policy", "cover"))
    right = m.where("video_id not like '%7'").select("video_id", "policy", "inc_errshare")
    return S.checked_merge(left, right, ["video_id", "policy"], ["inc_errshare"])[1]


def h10(spark: SparkSession, d: str) -> DataFrame:
    """Resampling of each comparison, seeded by its names; by partial sums for many pairs."""
    seeds = lambda c, m: B.stable_seed(SUITE_SEED, "E1", *c.split(" vs "), m)
    return nine(B.intervals(e1(spark, d), ["comparison", "metric"], "video_id", seeds))


def h10_large(spark: SparkSession, d: str) -> DataFrame:
    """Exact resampling cell by cell, for comparisons over millions of videos."""
    seeds = lambda c, m: B.stable_seed(SUITE_SEED, "E1", *c.split(" vs "), m)
    return nine(B.multinomial_intervals(steady(e1(spark, d)), ["comparison", "metric"], "video_id", seeds))


def h11_large(spark: SparkSession, d: str) -> DataFrame:
    seeds = lambda c, m: B.stable_seed(SUITE_SEED, "median", c, m)
    return nine(B.multinomial_intervals(steady(e1(spark, d)), ["comparison", "metric"], "video_id", seeds, "median"))


def h11_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Means and medians of all comparisons from one generator, metric by metric."""
    order = [(f"{a} vs {b}", m) for m in M for a, b in PAIRS]
    return nine(B.in_order_intervals(steady(e1(spark, d)), ["comparison", "metric"], order, "video_id", SUITE_SEED))


def h6_units(spark: SparkSession, d: str) -> DataFrame:
    """Methods that a merge requires and doesn't find whole, by metric rows of every run's method."""
    m = S.grouped_means(runs(spark, d), ["video_id", "policy"])
    left = m.where("not (policy = 'RF' and video_id like '%3')").select("video_id", "policy", "cover")
    right = m.select("video_id", "policy", "inc_errshare")
    return S.checked_merge(left, right, ["video_id", "policy"], ["inc_errshare"], "policy", ("AF", "NF", "NO", "RF", "XX"))[1]


def h8_exact(spark: SparkSession, d: str) -> DataFrame:
    """Wins and ties of single runs, where only equal values tie; seeds and budgets pair with themselves."""
    unit = F.concat_ws("/", "video_id", F.col("seed").cast("string"), F.col("top_k").cast("string"))
    return rounded(nine(S.paired_table(S.paired_differences(runs(spark, d).withColumn("video_id", unit), PAIRS), tie=0.0, tie_in_test=0.0)), "exact_sign_p")


RUN_UNITS_SQL = f"{RUNS_SQL}, unit AS (SELECT * REPLACE (video_id || '/' || seed || '/' || top_k AS video_id) FROM runs)"


def h11(spark: SparkSession, d: str) -> DataFrame:
    seeds = lambda c, m: B.stable_seed(SUITE_SEED, "median", c, m)
    return nine(B.intervals(e1(spark, d), ["comparison", "metric"], "video_id", seeds, "median"))


def h12(spark: SparkSession, d: str) -> DataFrame:
    s = e1(spark, d).groupBy("comparison", "metric").agg(F.avg("difference").alias("m"), F.stddev_samp("difference").alias("s"), F.count("*").alias("n"))
    dz, gz = S.effect_sizes(F.col("m"), F.col("s"), F.col("n"))
    return nine(s.select("comparison", "metric", "n", dz.alias("cohen_dz"), gz.alias("hedges_gz")))


def seeded(*first: object):
    """Seeds of a table's intervals from its name, what it is by, the two policies and the metric."""

    def seed_of(*keys: object) -> int:
        *by, comparison, metric = keys
        return B.stable_seed(first[0], *first[1:], *by, *comparison.split(" vs "), metric)

    return seed_of


def steady(d: DataFrame) -> DataFrame:
    """Differences to twelve places: the order in which means were added up then shows in no resample."""
    return d.withColumn("difference", F.round("difference", 12))


def with_ends(d: DataFrame, by: list[str], *first: object) -> DataFrame:
    """A paired table with the interval of each mean difference."""
    d = d.checkpoint()  # read by the table and by the intervals
    return nine(B.with_interval(S.paired_table(d, by=by, **TIES), steady(d), [*by, "comparison", "metric"], "video_id", seeded(*first)))


def h13_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The mean and median summary with an interval of each."""
    x, keys = e1(spark, d).checkpoint(), ["comparison", "metric"]  # read by the summary and both intervals
    out, x = S.summary_table(x, places=PLACES), steady(x)
    out = B.with_interval(out, x, keys, "video_id", seeded(SUITE_SEED, "mean"), name="mean_ci95")
    return nine(B.with_interval(out, x, keys, "video_id", seeded(SUITE_SEED, "median"), "median", "median_ci95"))


def h17_intervals(spark: SparkSession, d: str, seed: int, metrics=("cover", "raw_errshare")) -> DataFrame:
    return with_ends(S.paired_differences(S.grouped_means(runs(spark, d), ["video_id", "policy"]), CANDIDATES, metrics=metrics), [], seed)


def h19_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Looked-up pairs with intervals; what is turned has its bounds turned."""
    return S.pair_lookup(with_ends(e1(spark, d), [], SUITE_SEED, "E1"), [("AF", "NO"), ("RF", "AF"), ("RF", "NO")])


def h20_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The paired tables of all metrics under each other: the main one and the incremental one."""
    return h17_intervals(spark, d, MAIN_SEED).unionByName(h17_intervals(spark, d, INCREMENTAL_SEED, ("inc_errshare",)))


CANDIDATES = [*PAIRS, ("AF", "missing policy"), ("RF", "NF")]


def h17(spark: SparkSession, d: str, metrics=("cover", "raw_errshare")) -> DataFrame:
    """Candidate comparisons of whose policies both exist, with a tie tolerance."""
    return nine(S.paired_table(S.paired_differences(S.grouped_means(runs(spark, d), ["video_id", "policy"]), CANDIDATES, metrics=metrics), **TIES))


def h19(spark: SparkSession, d: str) -> DataFrame:
    return nine(S.pair_lookup(S.paired_table(e1(spark, d), **TIES), [("AF", "NO"), ("RF", "AF"), ("RF", "NO")]))


def h20(spark: SparkSession, d: str) -> DataFrame:
    """Method summary in display order beside the mean difference to the first method, over all metrics."""
    m = S.grouped_means(runs(spark, d), ["video_id", "policy"])
    summary = S.in_order(S.aggregate_table(m, ["policy"]), "policy", ["NO", "AF", "RF", "NF"])
    pairs = S.paired_table(S.paired_differences(m, [("NO", "AF"), ("NO", "RF"), ("NO", "NF")]), **TIES)
    against = pairs.groupBy(F.substring_index("comparison", " vs ", -1).alias("policy")).agg(*(F.max(F.when(F.col("metric") == x, F.col("mean_diff"))).alias(f"{x}_diff") for x in M))
    return nine(summary.join(against, "policy", "left").orderBy("rank"))


def h21(spark: SparkSession, d: str) -> DataFrame:
    a = S.finite_aggregate(holed(spark, d), ["seed", "policy"])
    return a.select("seed", "policy", *(S.fixed(F.col(f"{m}_avg"), 9).alias(m) for m in M), S.p_text(F.lit(1) / F.col("n") / 16).alias("p"))


def h22(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of seeds ordered as text and of budgets ordered as numbers, in one report order."""
    from pyspark.sql.window import Window

    k = runs(spark, d).select("seed", "top_k").distinct()
    return k.select("seed", "top_k", F.dense_rank().over(Window.partitionBy("top_k").orderBy(F.col("seed").cast("string"))).alias("seed_rank"), F.dense_rank().over(Window.partitionBy("seed").orderBy("top_k")).alias("k_rank")).orderBy(F.col("seed").cast("string"), "top_k")


AGG = each("round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std")
FIN = each("round(coalesce(avg({m}) FILTER (isfinite({m})), 'NaN'), 9) AS {m}_avg, round(coalesce(stddev_pop({m}) FILTER (isfinite({m})), 'NaN'), 9) AS {m}_std")
R = f"WITH {RUNS_SQL}"
D1 = f"{R}, {diff_sql()}"

QUERIES = {
    "h1_grouped_means": (lambda s, d: nine(S.grouped_means(runs(s, d), ["video_id", "policy"])), f"{R} SELECT video_id, policy, {each('round(avg({m}), 9) AS {m}')} FROM runs GROUP BY ALL"),
    "h2_aggregate_by_seed": (lambda s, d: nine(S.aggregate_table(runs(s, d), ["seed", "policy"])), f"{R} SELECT seed, policy, count(*) AS n, {AGG} FROM runs GROUP BY ALL"),
    "h2_aggregate_by_budget": (lambda s, d: nine(S.aggregate_table(runs(s, d), ["top_k", "policy"])), f"{R} SELECT top_k, policy, count(*) AS n, {AGG} FROM runs GROUP BY ALL"),
    "h3_finite_aggregate": (lambda s, d: nine(S.finite_aggregate(holed(s, d), ["seed", "policy"])), f"WITH {HOLED_SQL} SELECT seed, policy, count(*) AS n, {FIN} FROM holed GROUP BY ALL"),
    "h4_fixed_order": (
        lambda s, d: nine(S.in_order(S.aggregate_table(runs(s, d), ["policy"]), "policy", ["RF", "absent", "NO", "AF"]).orderBy("rank")),
        f"{R} SELECT * FROM (SELECT policy, count(*) AS n, {AGG}, CAST(list_position(['RF', 'absent', 'NO', 'AF'], policy) AS INTEGER) AS rank FROM runs GROUP BY policy) WHERE rank > 0",
    ),
    "h5_seed_aggregate": (
        lambda s, d: nine(S.seed_aggregate(runs(s, d))),
        f"{R} SELECT video_id, policy, count(*) AS n_seeds, {each('round(avg({m}), 9) AS {m}_mean, round(stddev_pop({m}), 9) AS {m}_std, round(min({m}), 9) AS {m}_min, round(max({m}), 9) AS {m}_max')} FROM runs GROUP BY ALL",
    ),
    "h6_checked_merge": (
        h6,
        f"{R}, m AS (SELECT video_id, policy FROM runs GROUP BY ALL) SELECT 'duplicate on the left' AS problem, video_id || '/' || policy AS key FROM m WHERE video_id = 'v1' UNION ALL SELECT 'missing metric', video_id || '/' || policy FROM (SELECT * FROM m UNION ALL SELECT * FROM m WHERE video_id = 'v1') WHERE video_id LIKE '%7'",
    ),
    "h6_method_units": (
        h6_units,
        f"""{R}, m AS (SELECT video_id, policy FROM runs GROUP BY ALL), l AS (SELECT * FROM m WHERE NOT (policy = 'RF' AND video_id LIKE '%3')), n AS (SELECT policy, count(DISTINCT video_id) AS n FROM l GROUP BY 1), w AS (SELECT unnest(['AF', 'NF', 'NO', 'RF', 'XX']) AS policy)
        SELECT 'missing method' AS problem, policy AS key FROM w WHERE policy NOT IN (SELECT policy FROM n) UNION ALL SELECT 'units of a method', policy FROM n JOIN w USING (policy) WHERE n.n <> (SELECT count(DISTINCT video_id) FROM l)""",
    ),
    "h8_exact_ties": (h8_exact, f"WITH {RUN_UNITS_SQL}, {diff_sql(source='unit')}, {table_sql(tie='0', tie_in_test='0')} {pick().replace('round(exact_sign_p, 9)', 'round(exact_sign_p, 6)')}"),
    "h11_bootstrap_median_large": (h11_large, None),
    "h11_bootstrap_in_order": (h11_in_order, None),
    "h7_paired_differences": (lambda s, d: nine(e1(s, d)), f"{D1} SELECT video_id, comparison, metric, round(left_value, 9) AS left_value, round(right_value, 9) AS right_value, round(difference, 9) AS difference FROM d"),
    "h8_wins_lower_is_better": (
        lambda s, d: nine(S.paired_table(e1(s, d), tie=0.001, direction="lower", tie_in_test=1e-12, places=PLACES)),
        f"{D1}, {table_sql(tie='0.001e0', direction=-1)} {pick()}",
    ),
    "h9_sign_test": (lambda s, d: nine(S.paired_table(e1(s, d), **TIES).select("comparison", "metric", "exact_sign_p")), f"{D1}, {table_sql()} SELECT comparison, metric, round(exact_sign_p, 9) AS exact_sign_p FROM t2"),
    "h9_sign_test_large": (
        lambda s, d: nine(S.paired_table(e1(s, d), **TIES).select("comparison", "metric", S.sign_p("left_wins", "right_wins").alias("exact_sign_p"))),
        f"{D1}, {table_sql()} SELECT comparison, metric, round(exact_sign_p, 9) AS exact_sign_p FROM t2",
    ),
    "h10_bootstrap_mean": (h10, None),
    "h10_bootstrap_mean_large": (h10_large, None),
    "h11_bootstrap_median": (h11, None),
    "h12_effect_sizes": (
        h12,
        f"{D1} SELECT comparison, metric, count(*) AS n, round(CASE WHEN stddev_samp(difference) > 0 THEN avg(difference) / stddev_samp(difference) ELSE 'NaN' END, 9) AS cohen_dz, round(CASE WHEN stddev_samp(difference) > 0 THEN avg(difference) / stddev_samp(difference) ELSE 'NaN' END * (1 - 3e0 / (4 * count(*) - 9)), 9) AS hedges_gz FROM d GROUP BY ALL",
    ),
    "h13_summary": (
        lambda s, d: nine(S.summary_table(e1(s, d), places=PLACES)),
        f"""{D1}, t AS (SELECT comparison, metric, count(*) AS n, avg(difference) AS m, median(difference) AS md, stddev_samp(difference) AS sd, CAST(sum(CASE WHEN difference > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_pairs,
        CAST(sum(CASE WHEN difference < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_pairs, CAST(sum(CASE WHEN abs(difference) <= 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS ties, CAST(sum(CASE WHEN difference > 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS w, CAST(sum(CASE WHEN difference < -1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS x FROM d GROUP BY ALL)
        SELECT comparison, metric, n, round(m, 9) AS mean_difference, round(md, 9) AS median_difference, round(sd, 9) AS difference_sd, positive_pairs, negative_pairs, ties, round(m / sd, 9) AS cohen_dz, round(m / sd * (1 - 3e0 / (4 * n - 9)), 9) AS hedges_gz, round(CASE WHEN w + x = 0 THEN 1 ELSE {SIGN} END, 9) AS exact_sign_p FROM t""",
    ),
    "h14_e1_paired": (lambda s, d: nine(S.paired_table(e1(s, d), **TIES)), f"{D1}, {table_sql()} {pick()}"),
    "h15_e2_paired": (lambda s, d: nine(S.paired_table(e2(s, d), by=["top_k"], **TIES)), f"{R}, {diff_sql('top_k')}, {table_sql('top_k')} {pick('top_k')}"),
    "h16_seed_deltas": (lambda s, d: nine(S.paired_table(per_seed(s, d), by=["seed"], **TIES)), f"{R}, {diff_sql('seed')}, {table_sql('seed')} {pick('seed')}"),
    "h17_main_paired": (h17, f"{R}, {diff_sql(pairs=CANDIDATES, metrics=('cover', 'raw_errshare'))}, {table_sql(tie='1e-12')} {pick()}"),
    "h18_incremental_paired": (lambda s, d: h17(s, d, ("inc_errshare",)), f"{R}, {diff_sql(pairs=CANDIDATES, metrics=('inc_errshare',))}, {table_sql(tie='1e-12')} {pick()}"),
    "h19_pair_lookup": (
        h19,
        f"""{D1}, {table_sql()}, b AS (SELECT *, 0 AS turned FROM t2 UNION ALL SELECT split_part(comparison, ' vs ', 2) || ' vs ' || split_part(comparison, ' vs ', 1), metric, paired_units, right_wins, left_wins, ties, -mean_diff, exact_sign_p, 1 FROM t2)
        SELECT comparison, metric, paired_units, left_wins, right_wins, ties, round(mean_diff, 9) AS mean_diff, round(exact_sign_p, 9) AS exact_sign_p, CAST(turned AS INTEGER) AS turned FROM b
        WHERE comparison IN ('AF vs NO', 'RF vs AF', 'RF vs NO') QUALIFY row_number() OVER (PARTITION BY comparison, metric ORDER BY turned) = 1""",
    ),
    "h20_report_tables": (
        h20,
        f"""{R}, {diff_sql(pairs=[("NO", "AF"), ("NO", "RF"), ("NO", "NF")])}, s AS (SELECT policy, count(*) AS n, {AGG}, CAST(list_position(['NO', 'AF', 'RF', 'NF'], policy) AS INTEGER) AS rank FROM means GROUP BY policy),
        a AS (SELECT split_part(comparison, ' vs ', 2) AS policy, {each("round(avg(difference) FILTER (metric = '{m}'), 9) AS {m}_diff")} FROM d GROUP BY 1) SELECT s.*, a.* EXCLUDE (policy) FROM s LEFT JOIN a USING (policy) WHERE rank > 0""",
    ),
    "h13_summary_with_intervals": (h13_intervals, None),
    "h14_e1_with_intervals": (lambda s, d: with_ends(e1(s, d), [], SUITE_SEED, "E1"), None),
    "h15_e2_with_intervals": (lambda s, d: with_ends(e2(s, d), ["top_k"], SUITE_SEED, "E2"), None),
    "h16_seeds_with_intervals": (lambda s, d: with_ends(per_seed(s, d), ["seed"], SUITE_SEED, "E1-seed-level"), None),
    "h17_main_with_intervals": (lambda s, d: h17_intervals(s, d, MAIN_SEED), None),
    "h18_incremental_with_intervals": (lambda s, d: h17_intervals(s, d, INCREMENTAL_SEED, ("inc_errshare",)), None),
    "h19_pair_lookup_with_intervals": (h19_intervals, None),
    "h20_paired_tables": (h20_intervals, None),
    "h21_formatting": (
        h21,
        f"""WITH {HOLED_SQL}, a AS (SELECT seed, policy, count(*) AS n, {each("coalesce(avg({m}) FILTER (isfinite({m})), 'NaN') AS {m}")} FROM holed GROUP BY ALL)
        SELECT seed, policy, {each("CASE WHEN isnan({m}) THEN 'nan' WHEN isinf({m}) THEN 'inf' ELSE format('{{:.9f}}', {m}) END AS {m}")}, CASE WHEN 1e0 / n / 16 < 0.001 THEN format('{{:.2e}}', 1e0 / n / 16) ELSE format('{{:.6f}}', 1e0 / n / 16) END AS p FROM a""",
    ),
    "h22_result_order": (
        h22,
        f"{R}, k AS (SELECT DISTINCT seed, top_k FROM runs) SELECT seed, top_k, CAST(dense_rank() OVER (PARTITION BY top_k ORDER BY CAST(seed AS VARCHAR)) AS INTEGER) AS seed_rank, CAST(dense_rank() OVER (PARTITION BY seed ORDER BY top_k) AS INTEGER) AS k_rank FROM k",
    ),
}
