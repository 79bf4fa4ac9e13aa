"""Importance resampling towards a target distribution of hashed word n-grams, through a dictionary of the different ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.packed import binary_parts
from blockalloc.llm.words import words
from blockalloc.operators.numbering import numbered
from blockalloc.session import shuffle_partitions, table

BUCKETS = 10_000
#: Bytes of text whose features are counted or weighed together: some twenty times as much is held meanwhile.
LOT_BYTES = 4 << 20
#: Owners of features for each shuffle partition, and into how many owners the features of one first word are dealt.
OWNERS, SPREAD = 16, 16


def lots(batches: Iterator[pa.RecordBatch], column: int, most: int = LOT_BYTES) -> Iterator[pa.Table]:
    """Batches put together until their text has so many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(binary_parts(b.column(column))[0])
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Features:
    """The different words and word pairs of a lot of texts: words by number, pairs as (first, second) sorted by first."""

    def __init__(self, texts: pa.ChunkedArray):
        self.words, self.code, self.row = words(texts)
        n = max(1, len(self.words))
        self.follows = np.flatnonzero(self.row[1:] == self.row[:-1])
        pairs, self.pair, self.pair_counts = np.unique(self.code[self.follows] * n + self.code[self.follows + 1], return_inverse=True, return_counts=True)
        self.first, self.second = pairs // n, pairs % n
        self.counts = np.bincount(self.code, minlength=len(self.words))

    def strings(self) -> pa.Array:
        """All features, words first."""
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(self.first)), self.words.take(pa.array(self.second)), pa.scalar(b" ", pa.large_binary()))
        return pa.concat_arrays([self.words, pairs])

    def crcs(self) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of every word and of every pair; a pair's goes on from that of its first word."""
        names = self.words.to_pylist()
        single, open_ = [crc32(w) for w in names], [crc32(w + b" ") for w in names]
        pairs = np.empty(len(self.first), np.int64)
        for lo in range(0, len(pairs), 1 << 16):
            some = slice(lo, lo + (1 << 16))
            pairs[some] = [crc32(names[b], open_[a]) for a, b in zip(self.first[some].tolist(), self.second[some].tolist(), strict=True)]
        return np.array(single, np.int64), pairs


def count_features(owners: int) -> Callable:
    """For each lot and owner one row with the owner's features, joined by line ends, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in lots(batches, 0):
            f = Features(t.column(0))
            h = np.array([crc32(w, 1) for w in f.words.to_pylist()], np.int64)
            owner = np.concatenate([h * SPREAD % owners, (h[f.first] * SPREAD + h[f.second] % SPREAD) % owners])
            order = np.argsort(owner, kind="stable")
            some, begins = np.unique(owner[order], return_index=True)
            at = pa.array(np.r_[begins, len(order)].astype(np.int32))
            texts = pa.ListArray.from_arrays(at, f.strings().take(pa.array(order)).cast(pa.string()))
            counts = pa.ListArray.from_arrays(at, pa.array(np.concatenate([f.counts, f.pair_counts])[order].astype(np.int32)))
            out = [pa.array(some.astype(np.int32)), pc.binary_join(texts, "\n"), counts]
            yield from pa.Table.from_arrays(out, ["owner", "features", "counts"]).to_batches(max_chunksize=64)

    return run


def dictionary(raw: DataFrame, target: DataFrame) -> DataFrame:
    """(feature, raw, target): every different feature of both tables' column ``text`` and how often it occurs in each.

    Lots of texts count their own features; those of an owner meet in its partition and
    are added up there row by row, so a frequent feature costs one entry a lot and no
    group is held as a whole.
    """
    owners = OWNERS * shuffle_partitions(raw.sparkSession)
    run, schema = count_features(owners), "owner int, features string, counts array<int>"
    both = raw.select("text").mapInArrow(run, schema).withColumn("side", F.lit(0)).unionByName(target.select("text").mapInArrow(run, schema).withColumn("side", F.lit(1)))
    each = both.repartition("owner").select("owner", "side", F.explode(F.arrays_zip(F.split("features", "\n").alias("feature"), F.col("counts").alias("n"))).alias("f")).select("owner", "side", "f.feature", "f.n")
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n").cast("long")).otherwise(0))
    return each.groupBy("owner", "feature").agg(of(0).alias("raw"), of(1).alias("target")).drop("owner")


def bucket_gains(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor(1000 ln) of how much likelier the target makes a feature of the bucket, with one count added to each bucket."""
    hashed = features.select((F.crc32(F.col("feature").cast("binary")) % buckets).cast("int").alias("bucket"), "raw", "target")
    found = hashed.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).checkpoint()  # at most ``buckets`` rows
    s, t = found.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    ratio = (F.col("target") + 1.0) * float(s + buckets) / ((F.col("raw") + 1.0) * float(t + buckets))
    return found.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the floored mean of its features' gains."""
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for t in lots(batches, 1):
            f = Features(t.column(1))
            single, pairs = f.crcs()
            n = len(t)
            total = np.bincount(f.row, gain[single % len(gain)][f.code], n) + np.bincount(f.row[f.follows], gain[pairs % len(gain)][f.pair], n)
            n_words = np.bincount(f.row, minlength=n)
            features = n_words + np.bincount(f.row[f.follows], minlength=n)
            weight = total.astype(np.int64) // np.maximum(features, 1)
            cols = [t.column(0).combine_chunks(), *(pa.array(x.astype(np.int64)) for x in (n_words, features, weight))]
            yield from pa.Table.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight"]).to_batches()

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): which rows of ``docs(doc_id, text, ...)`` a draw towards ``target(text, ...)`` takes.

    Features are words and pairs of following words, with repeats. All of them are counted
    by string over both tables; each different one is hashed once in that dictionary, to
    one of ``buckets`` buckets, whose gains compare the two distributions. The gains, a
    table of fixed size, meet each lot's own counts, whose different features are hashed once a
    lot, and give each row its floored mean. A row's score adds Gumbel noise from seed and
    doc_id; of the rows with at least ``least_words`` words, ``percent`` in a hundred with
    the highest scores are ranked from 1, ties to smaller ids, null ids last.

    Null, empty and word-free texts have weight 0 and aren't drawn. The noise of a null
    doc_id is that of an empty one. Repeated rows each count. Without rows the result is empty; without
    a target every gain follows from the added counts alone. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = bucket_gains(dictionary(rows, target.select(F.col("text").cast("string").alias("text"))), buckets).toPandas()
    gains = np.zeros(buckets)
    gains[found["bucket"].to_numpy()] = found["gain"].to_numpy()
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weigh(rows, gains).withColumn("score", F.col("weight") + noise).checkpoint()
    open_ = F.col("n_words") >= least_words
    drawn = scored.where(open_).count() * percent // 100
    ranked = numbered(scored.where(open_), [], [F.desc("score"), F.asc_nulls_last("doc_id")])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    return ranked.select("doc_id", "n_features", "weight", "score", rank).unionByName(scored.where(~open_).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
