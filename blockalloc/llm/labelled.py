"""Labelled rows, bounded samples of them, and logistic calibration, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def fold():
    """Which of two folds a row is in, by a hash of its doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(2)).cast("int")


def known(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from: no null ids, null labels, ids with contradictory labels, or ids whose bucket is ``held_out``."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where("doc_id is not null and y in (0, 1)").where(bucket(modulus) != held_out)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, y, fold) of at most ``per_class`` labelled rows of each class, chosen by a hash of the id.

    Rows whose bucket is ``held_out`` are never taken. Null ids, null labels and ids
    with contradictory labels are left out. The bound makes the ids small enough to
    broadcast; each class is cut by its own sorted limit, so no group meets in one task.
    """
    rows = known(labels, label, modulus, held_out)
    chosen = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", fold().alias("fold"))


def logistic_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, summed over rows."""
    x = np.c_[x, np.ones(len(x))]
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def logistic(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, int]], width: int, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps from ``sums`` (gradient, Hessian and number of rows at some weights); standardises nothing."""
    w = np.zeros(width)
    hold = np.full(width, ridge)
    hold[-1] = 1e-9
    for _ in range(rounds):
        g, h, n = sums(w)
        step = np.linalg.solve(h / n + np.diag(hold + 1e-9), g / n + hold * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
