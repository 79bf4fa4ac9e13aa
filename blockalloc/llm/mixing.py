"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockalloc.operators.numbering import numbered
from blockalloc.session import table

#: Words of a block, the unit that sources are given.
BLOCK_WORDS = 16
#: About how many words of a source a shard holds.
SHARD_WORDS = 1 << 20
WEIGHTS = (5, 2, 1)
#: How often a source, and each of its documents, may be taken at most.
REPEATS = 3


def fill(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``sources(weight, size, ...)`` with ``target``: shares of all sizes by weight, none above ``repeats`` times its size.

    What stops at its bound leaves its excess to the others by weight, until none is above.
    Each round is one aggregate of three sums, in whole numbers; what is bounded once stays so.
    """
    size, weight = F.col("size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    bound = repeats * size
    free, held, before = F.lit(True), None, None
    while held is None or held != before:
        before = held
        s = sources.agg(F.sum(size).alias("all"), F.sum(F.when(~free, bound)).alias("bounded"), F.sum(F.when(free, weight)).alias("weights")).first()
        held = (int(s["all"] or 0) - int(s["bounded"] or 0), int(s["weights"] or 0))
        left, weights = (F.lit(x).cast("decimal(38,0)") for x in held)
        free = bound.cast("double") * 1.0 > left.cast("double") * weight.cast("double") / float(max(1, held[1]))
    share = float(held[0]) * F.col("weight").cast("double") / float(max(1, held[1]))
    return sources.withColumn("target", F.when(free, share).otherwise((repeats * F.col("size")).cast("double")))


def apportion(parts: DataFrame, by: Sequence[str], part: str, votes: str, seats: str) -> DataFrame:
    """``parts`` with ``quota``: its group's ``seats`` go to the highest quotients votes / 1, / 3, / 5, ...; ties to the smaller ``part``.

    With S parts and V votes, the quotients above V / (2 (seats - S / 2)) are fewer than the
    seats and those above V / (2 (seats + S / 2)) at least as many, so all but some S seats
    of a group follow from one division. Only the quotients in between, about 4 S, are
    ranked, over range partitions, so that no group meets in one task. Parts without votes
    get none.
    """
    by = list(by)
    keys = [F.col(c) for c in by]
    v = F.col(votes).cast("double")
    group = parts.where(v > 0).groupBy(*by).agg(F.sum(v).alias("_votes"), F.count("*").alias("_parts"))
    same = F.lit(True)
    for i, c in enumerate(by):
        group = group.withColumnRenamed(c, f"_by_{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    n, s = F.col(seats).cast("double"), F.col("_parts").cast("double")
    sure = F.when(n > s / 2, F.floor(v * (n - s / 2) / F.col("_votes") + 0.5) - 1).otherwise(0)
    most = F.floor(v * (n + s / 2) / F.col("_votes") + 0.5) + 1
    known = parts.where((v > 0) & (F.col(seats) > 0)).join(group, same).withColumns({"_sure": F.greatest(sure.cast("long"), F.lit(0).cast("long")), "_most": most.cast("long")}).checkpoint()
    left = known.groupBy(*by).agg((F.first(seats) - F.sum("_sure")).alias("_left"))
    places = known.select(*keys, F.col(part), v.alias("_v"), F.explode(F.sequence(F.col("_sure"), F.greatest(F.col("_sure"), F.col("_most")))).alias("_k"))
    ranked = numbered(places.withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1)).drop("_v"), by, [F.desc("_q"), part, "_k"], "_place")
    more = _beside(ranked, left, by).where("_place < _left").groupBy(*by, part).agg(F.count("*").alias("_more"))
    out = _beside(_beside(parts, known.select(*by, part, "_sure"), [*by, part], "left"), more, [*by, part], "left")
    return out.withColumn("quota", F.coalesce("_sure", F.lit(0)) + F.coalesce("_more", F.lit(0))).drop("_sure", "_more")


def _beside(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match."""
    same = F.lit(True)
    for i, c in enumerate(keys):
        other = other.withColumnRenamed(c, f"_key_{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(other, same, how).drop(*(f"_key_{i}" for i in range(len(keys))))


def digits(text: Column, lo: int, n: int) -> Column:
    """A number from n hex digits."""
    return F.conv(F.substring(text, lo, n), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of each document a mix of as many words as there are takes.

    Sources, by code point and null last, weigh ``weights`` in turn. The mix is cut into
    blocks of ``block_words`` words. Blocks go to sources by the highest Sainte-Lague
    quotients of their targets, and each source's blocks to its shards (hash parts of about
    ``shard_words`` words) by those of the shards' sizes. In a shard documents stand in the
    order of a seeded hash, as one circle of words; its blocks are taken from a block on that
    the seed chooses, round and round, so a document is taken at most one time more
    often than another of its shard, and never more than ``repeats`` times. A source's taken
    words miss its target by less than two blocks, and up to one more a shard where a source is bounded.

    Hashes are over seed and doc_id (the text where that is null). Null text and text
    without words have size 0 and are taken 0 times; repeated rows each count. Without rows
    the result is empty. Other columns are not read. Everything is a DataFrame operation;
    the driver sees three sums a round of ``fill`` and the number of words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), who), 256)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), key.alias("key")).checkpoint()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("size"))
    place = numbered(by_source, [], [F.asc_nulls_last("source")], "rank")
    sources = fill(place.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), repeats)
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    given = apportion(sources.withColumn("seats", F.lit((2 * total + block_words) // (2 * block_words)).cast("long")), [], "rank", "target", "seats")
    given = given.select("rank", F.col("source").alias("of"), F.col("size").alias("source_size"), "target", F.col("quota").alias("blocks"), F.greatest(F.ceil(F.col("size") / shard_words), F.lit(1)).cast("long").alias("shards")).checkpoint()
    rows = sized.join(given, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("shard", digits(F.col("key"), 1, 7) % F.col("shards"))
    parts = rows.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quotas = apportion(parts, ["rank"], "shard", "words", "blocks").select("rank", "shard", "words", "quota")
    start = digits(F.sha2(F.concat_ws(":", F.lit(seed), "rank", "shard"), 256), 1, 7) % F.ceil(F.col("words") / block_words) * block_words
    circle = Window.partitionBy("rank", "shard").orderBy(digits(F.col("key"), 8, 15), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = _beside(rows.select("doc_id", "size", "source_size", "target", "key", "rank", "shard"), quotas, ["rank", "shard"])
    placed = placed.withColumns({"_end": F.sum("size").over(circle), "_take": F.least(F.col("quota") * block_words, repeats * F.col("words")), "_from": F.when(F.col("words") > 0, start).otherwise(0)})
    # the circle unrolled: words before a position that the take covers, counted from its beginning
    lo, hi = F.col("_end") - F.col("size") - F.col("_from"), F.col("_end") - F.col("_from")
    turns, rest = F.expr("_take div greatest(words, 1)"), F.expr("_take % greatest(words, 1)")
    inside = lambda a, b: F.greatest(F.least(b, rest) - F.greatest(a, F.lit(0).cast("long")), F.lit(0).cast("long"))
    taken = turns * F.col("size") + inside(lo, hi) + inside(lo + F.col("words"), hi + F.col("words"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM (SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY 1)),
w AS (SELECT *, sum(size) OVER () AS total, sum(weight) OVER (ORDER BY size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        coalesce(sum(3 * size) OVER (ORDER BY size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bounded FROM s),
c AS (SELECT *, CAST(3 * size AS DOUBLE) <= CAST(total - bounded AS DOUBLE) * weight / open AS full_ FROM w),
f AS (SELECT CAST(any_value(total) - coalesce(sum(3 * size) FILTER (full_), 0) AS DOUBLE) AS rest, greatest(1, coalesce(sum(weight) FILTER (NOT full_), 0)) AS open FROM c),
t AS (SELECT source, size, rank, total, CASE WHEN full_ THEN CAST(3 * size AS DOUBLE) ELSE f.rest * CAST(weight AS DOUBLE) / CAST(f.open AS DOUBLE) END AS target FROM c, f),
q AS (SELECT rank, target / (2 * k + 1) AS q, k FROM (SELECT rank, target, unnest(range(CAST(target / {BLOCK_WORDS} AS BIGINT) + 3)) AS k FROM t WHERE target > 0)),
g AS (SELECT rank, count(*) AS blocks FROM (SELECT rank FROM q QUALIFY row_number() OVER (ORDER BY q DESC, rank, k) <= (SELECT (2 * any_value(total) + {BLOCK_WORDS}) // {2 * BLOCK_WORDS} FROM t)) GROUP BY 1),
r AS (SELECT d.doc_id, d.size, t.size AS source_size, t.target, t.rank, coalesce(g.blocks, 0) AS blocks, CAST('0x' || key[8:22] AS BIGINT) AS ord, CAST('0x' || key[1:7] AS BIGINT) % greatest(CAST(ceil(t.size / {SHARD_WORDS}) AS BIGINT), 1) AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN g ON g.rank = t.rank),
p AS (SELECT rank, shard, sum(size) AS words, any_value(blocks) AS blocks FROM r GROUP BY 1, 2),
pq AS (SELECT rank, shard, blocks, k, words / (2 * k + 1) AS q FROM (SELECT rank, shard, blocks, CAST(words AS DOUBLE) AS words, unnest(range(blocks + 1)) AS k FROM p WHERE words > 0)),
h AS (SELECT rank, shard, count(*) AS quota FROM (SELECT rank, shard FROM pq QUALIFY row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard, k) <= blocks) GROUP BY 1, 2),
o AS (SELECT p.rank, p.shard, words, least(coalesce(quota, 0) * {BLOCK_WORDS}, 3 * words) AS take, CASE WHEN words > 0 THEN CAST('0x' || sha256('7:' || p.rank || ':' || p.shard)[1:7] AS BIGINT) % CAST(ceil(words / {BLOCK_WORDS}) AS BIGINT) * {BLOCK_WORDS} ELSE 0 END AS start FROM p LEFT JOIN h ON p.rank = h.rank AND p.shard = h.shard),
e AS (SELECT r.*, words, take, start, sum(r.size) OVER (PARTITION BY r.rank, r.shard ORDER BY ord, doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto FROM r JOIN o ON r.rank = o.rank AND r.shard = o.shard),
x AS (SELECT *, take // greatest(words, 1) AS turns, take % greatest(words, 1) AS rest, upto - size - start AS lo, upto - start AS hi FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(turns * size + greatest(0, least(hi, rest) - greatest(lo, 0)) + greatest(0, least(hi + words, rest) - greatest(lo + words, 0)) AS BIGINT) AS taken FROM x
"""
