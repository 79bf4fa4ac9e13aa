"""A corpus cleaned in stages: toxic documents go, then copies, near copies and repeated passages; the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.exact_dedup import one_of_each_text
from blockalloc.llm.packing import pack
from blockalloc.llm.simhash import simhash_groups
from blockalloc.llm.substrings import drop_repeats
from blockalloc.llm.toxicity import without_toxic
from blockalloc.session import ready, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null text counts as empty; a null doc_id is scored like any other."""
    ready(spark)
    return without_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: the one with the largest id; null text counts as empty, a null id as the smallest."""
    ready(spark)
    return one_of_each_text(docs.select(*COLUMNS))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (rows that share an id stay together)."""
    ready(spark)
    kept = simhash_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(*COLUMNS)
    return rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that also start earlier go; every document stays.

    A character that loses some of its bytes goes whole; n_chars counts what stays. Null
    text becomes empty.
    """
    ready(spark)
    left = drop_repeats(docs, keep_text=True, carry=("lang", "source"))
    return left.select("doc_id", F.col("kept").alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), F.length("kept").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts, packed into sequences; null and empty text are a piece of one token."""
    ready(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: No SQL expresses the trained first stage; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut from the one before by a checkpoint."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
