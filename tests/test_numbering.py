"""Places in a sorted order, in two passes."""

import pytest
from pyspark.sql import functions as F

from blockalloc.operators.numbering import numbered


@pytest.mark.parametrize("parts", [1, 5])
def test_places_are_those_of_a_window(spark, parts):
    rows = [(g, (i * 7919) % 1000, i % 3) for i in range(1000) for g in (["hot"] if i % 3 else [None, "a"] if i % 2 else [f"g{i}"])]
    df = spark.createDataFrame(rows, "g string, id long, payload int").repartition(parts)
    got = {(r.g, r.id): r.place for r in numbered(df, ["g"], ["id"]).collect()}
    assert len(got) == len(rows)
    of = {}
    for g, i, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        assert got[g, i] == of.setdefault(g, 0)
        of[g] += 1


def test_places_without_groups_and_of_nothing(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    assert all(r.place == 499 - r.v for r in numbered(df, [], [F.desc("v")]).collect())
    assert numbered(df.where("v < 0"), [], ["v"]).count() == 0


def test_no_window_over_the_rows(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    plan = numbered(df, ["g"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") > plan.index("Window")  # it stands above the counts
