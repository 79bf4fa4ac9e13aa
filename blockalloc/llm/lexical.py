"""Ranked lexical search: term-bucketed postings joined with the terms of items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockalloc.llm.words import words
from blockalloc.operators.numbering import numbered
from blockalloc.session import table

#: Most different terms of items that are sent to all tasks, so that postings of other terms are never made.
VOCABULARY = 1 << 20
#: Buckets of one term's postings.
SALTS = 16


def counts(texts: DataFrame, known: list[bytes] | None) -> DataFrame:
    """(term, documents, terms): how many rows have a term; under the null term, how many have any, and all terms of all rows."""
    held = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.large_binary()) if held else None
        documents = terms = 0
        for b in batches:
            kinds, code, row = words(b.column(0))
            documents, terms = documents + len(np.unique(row)), terms + len(row)
            if held:
                chosen = pc.is_in(kinds, wanted).to_numpy(zero_copy_only=False)[code]
                code, row = code[chosen], row[chosen]
            df = np.bincount(np.unique(row * max(1, len(kinds)) + code) % max(1, len(kinds)), minlength=len(kinds))
            some = np.flatnonzero(df)
            found = [kinds.take(pa.array(some)).cast(pa.string()), pa.array(df[some].astype(np.int64)), pa.array(np.zeros(len(some), np.int64))]
            yield pa.RecordBatch.from_arrays(found, ["term", "documents", "terms"])
        yield pa.RecordBatch.from_pydict({"term": pa.array([None], pa.string()), "documents": pa.array([documents], pa.int64()), "terms": pa.array([terms], pa.int64())})

    each = texts.select("text").mapInArrow(run, "term string, documents long, terms long")
    return each.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).checkpoint()


def postings(docs: DataFrame, documents: int, terms: int, known: list[bytes] | None) -> DataFrame:
    """(row, doc_id, term, part): how much each different term of a row counts before its weight.

    ``part`` is (10^9 tf) div (1000 tf + 20 m). Where ``known`` is given, other terms are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(held.value, pa.large_binary()) if held else None
        for b in batches:
            kinds, code, row = words(b.column(2))
            n = np.bincount(row, minlength=len(b))
            if held:
                chosen = pc.is_in(kinds, wanted).to_numpy(zero_copy_only=False)[code]
                code, row = code[chosen], row[chosen]
            key, tf = np.unique(row * max(1, len(kinds)) + code, return_counts=True)
            row, code = key // max(1, len(kinds)), key % max(1, len(kinds))
            m = 50 + (50 * n * documents) // max(1, terms)
            part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            at = pa.array(np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, kinds.take(pa.array(code)).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(part.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["row", "doc_id", "terms", "parts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, terms array<string>, parts array<long>")
    return rows.select("row", "doc_id", F.explode(F.arrays_zip("terms", "parts")).alias("p")).select("row", "doc_id", F.col("p.terms").alias("term"), F.col("p.parts").alias("part"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once; rows that share an item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, code, row = words(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), kinds.take(pa.array(code)).cast(pa.string())], ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 50, vocabulary: int = VOCABULARY, salts: int = SALTS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs(doc_id, text, ...)`` for each of ``items(item_id, text, ...)``.

    One pass over the texts counts documents by term. In another postings are dealt to buckets of terms, a term
    to ``salts`` of them by the number of its row, so that a word that stands in every text
    is no hot key, and meet the weighted terms of items in a join, where every match gets
    its whole-number score once, with the list of the items that ask for the term (as
    small numbers). Scored matches are dealt to their documents, spread over those items
    there and added up by item and document without another shuffle; a task sends on its k
    best of each item. Terms of weight 0 can't add to a score and drop out. Where items
    have at most ``vocabulary`` different terms, those are sent to all tasks and other
    postings are never made; beyond it the join alone sorts them out.

    Each row is a document of its own, also where a doc_id repeats; null ids come after all
    others on ties, and a null item_id is an item like any other. Null, empty and term-free
    texts match nothing. Without documents or items the result is empty. Other columns are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = item_terms(items).checkpoint()
    names = numbered(asked.select("item_id").distinct(), [], ["item_id"], "item").withColumn("item", F.col("item").cast("int")).checkpoint()
    asked = asked.join(names.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id"))).select("item", "term")
    some = asked.select("term").distinct().limit(vocabulary + 1).toArrow()["term"]
    known = some.cast(pa.large_binary()).to_pylist() if len(some) <= vocabulary else None
    held = counts(rows, known)
    total = held.where("term is null").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    salt = F.pmod("row", F.lit(salts)).cast("int").alias("salt")
    dealt = postings(rows, *total, known).select("row", "doc_id", "term", "part", salt).repartition("term", "salt")
    # 1000 ln of the share of documents without the term
    weight = F.floor(1000 * F.log((2.0 * total[0] + 2) / (2.0 * F.col("documents") + 1))).cast("long").alias("weight")
    wanted = asked.join(held.select("term", weight).where("weight > 0"), "term").groupBy("term", "weight").agg(F.collect_list("item").alias("items"))
    wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = dealt.join(wanted.hint("shuffle_hash"), ["term", "salt"]).select("row", "doc_id", (F.col("weight") * F.col("part")).alias("match"), "items")
    each = scored.repartition("row").select("row", "doc_id", "match", F.explode("items").alias("item"))
    found = each.groupBy("item", "row", "doc_id").agg(F.sum("match").alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w)) AS l FROM d),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (
  SELECT item_id, doc_id, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * t.n * s.n) // s.l))) AS part
  FROM q JOIN t USING (term) JOIN f USING (term), s
), g AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM m GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0
QUALIFY rank <= 50
"""
