"""Connected components of an edge table, wholly as DataFrame work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A key with more rows than this is hot; and at most so many keys are, since beyond HOT * MOST rows the bound rises with the table.
HOT = MOST = 1 << 16


def hot_bound(rows: int, hot: int = HOT) -> int:
    """Rows beyond which a key counts as hot, so that a table of so many rows has at most ``MOST`` hot keys."""
    return max(hot, -(-rows // MOST))


def look_up(rows: DataFrame, values: DataFrame, key: str, value: str, spread: str, hot: int = HOT) -> DataFrame:
    """``rows`` with the ``value`` of their key, from ``values(key, value, n)``; n is at least the number of rows of a key.

    A key of more than ``hot`` rows gets its value by broadcast, and its rows are dealt by
    the long column ``spread``, so that no key meets in one task. With ``hot`` from
    ``hot_bound`` the broadcast has at most ``MOST`` keys, whatever the size of the table.
    """
    many = values.where(F.col("n") > hot).select(F.col(key).alias("_many"), F.col(value).alias("_hot_value"), F.lit(True).alias("_hot"))
    few = values.where(F.col("n") <= hot).select(F.col(key).alias("_few"), F.col(value).alias("_value"))
    out = rows.join(F.broadcast(many), F.col(key) == F.col("_many"), "left")
    out = out.withColumn("_at", F.when(F.col("_hot"), F.col(spread)).otherwise(F.col(key)))
    out = out.join(few, (F.col("_at") == F.col("_few")) & F.col("_hot").isNull(), "left")
    return out.select(*rows.columns, F.when(F.col("_hot"), F.col("_hot_value")).otherwise(F.col("_value")).alias(value))


def connected_components(edges: DataFrame, rounds: int = 60, hot: int = HOT) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``. Large-star and small-star rounds
    alternate (Kiveris et al., 2014): edges never outnumber the input's, each round
    shrinks the depth by a constant factor, and the minimum of a node's neighbours is
    aggregated before the shuffle and reaches the links of a hub by ``look_up``, so a
    hub with many links is no hot key. Rows with a null end and self-links are ignored;
    repeated links count once. An empty table gives an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct().checkpoint()
    last, hot = None, hot_bound(2 * e.count(), hot)
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = look_up(both.where("b > a"), low, "a", "m", "b", hot).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = look_up(large, low, "a", "m", "b", hot)
        small = small.select(F.col("a"), F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = small.where("a <> b").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
