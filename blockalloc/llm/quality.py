"""Quality by random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.labelled import bucket, sample, sigmoid
from blockalloc.llm.tokens import strings, texts_of
from blockalloc.session import table

#: Terms: words, runs of other signs, line ends.
TERM = re.compile(r"\w+|[^\w\s]+|\n")
DIM = 32
#: Terms of the windows whose summed vectors give a document's second moments.
WIDTH = 5
#: Terms whose vectors are held at a time.
PIECE = 1 << 16
#: Rows of the word-vector table; terms share a row when their hashes agree. By cross-validation four times as many rows pass as many low documents, a fourth two more.
TABLE = 1 << 16
#: Ones in a sparse random index vector.
ONES = 6
WINDOW = 2
#: Pairs of neighbours that a task holds before it adds them up.
PAIRS = 3_000_000
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 6000
HIDDEN = 32


def row_of(term: str) -> int:
    """The table row of a term."""
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % TABLE


class Rows:
    """Table rows of terms, remembered."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = {}, most

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all terms of the texts in order, and how many each text has."""
        docs = [TERM.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        code, kinds = pd.factorize(np.array([w for d in docs for w in d], object))
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, kinds))
        for i, f in enumerate(found):
            if f is None:
                found[i] = self.known[kinds[i]] = row_of(kinds[i])
        return np.array(found, np.int64)[code], sizes


def index_places() -> list[tuple[np.ndarray, np.ndarray]]:
    """Where the ones of each row's sparse index vector stand, and their signs."""
    rng = np.random.default_rng(11)
    return [(rng.integers(0, DIM, TABLE), rng.choice(np.array([-1, 1], np.float32), TABLE)) for _ in range(ONES)]


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors, one a row of the table."""
    out = np.zeros((TABLE, DIM), np.float32)
    for place, sign in index_places():
        out[np.arange(TABLE), place] += sign
    return out


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's summed index vectors of what stands around each term: left neighbours rolled one way, right ones the other."""
    index, rows = index_places(), Rows()
    total, count = np.zeros(TABLE * DIM), np.zeros(TABLE, np.int64)
    held: list[np.ndarray] = []

    def add_up():
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        a, c = pairs // TABLE, pairs % TABLE
        for place, sign in index:
            total[:] += np.bincount(a * DIM + (place[c] + 1) % DIM, n * sign[c], TABLE * DIM)
            total[:] += np.bincount(c * DIM + (place[a] - 1) % DIM, n * sign[a], TABLE * DIM)
        held.clear()

    for b in batches:
        for some in batched(strings(b.column(0)), 500):
            r, sizes = rows.of(list(some))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            count += np.bincount(r, minlength=TABLE)
            for back in range(1, WINDOW + 1):
                ok = doc[back:] == doc[:-back]
                held.append(r[back:][ok] * np.int64(TABLE) + r[:-back][ok])
            if sum(map(len, held)) > PAIRS:
                add_up()
    if held:
        add_up()
    live = np.flatnonzero(count)
    vec = pa.ListArray.from_arrays(np.arange(len(live) + 1, dtype=np.int32) * DIM, total.reshape(TABLE, DIM)[live].astype(np.int64).ravel())
    for lo in range(0, len(live), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(live[lo : lo + 5000]), pa.array(count[live[lo : lo + 5000]]), vec[lo : lo + 5000].cast(pa.list_(pa.int32()))], ["row", "n", "vec"])


def pooled(texts: list[str], rows: Rows, vectors: np.ndarray) -> np.ndarray:
    """The mean word vector of each text, and the mean square of the sums over each ``WIDTH`` terms in a row; zero for a text without terms.

    Sums over windows tell how terms keep company: those of terms that repeat are long,
    those of different ones cancel out. A text shorter than a window is one window.
    """
    r, sizes = rows.of(texts)
    n, dim = len(texts), vectors.shape[1]
    doc, total, square = np.repeat(np.arange(n), sizes), np.zeros((n, dim)), np.zeros((n, dim))
    for lo in range(0, len(r), PIECE):
        a, z = max(0, lo - WIDTH + 1), min(len(r), lo + PIECE)
        upto = np.concatenate([np.zeros((1, dim)), np.cumsum(vectors[r[a:z]], axis=0, dtype=float)])
        cut = lo + np.flatnonzero(np.r_[True, doc[lo + 1 : z] != doc[lo : z - 1]])
        total[doc[cut]] += upto[np.r_[cut[1:], z] - a] - upto[cut - a]
        ends = np.arange(a + WIDTH - 1, z) if z - a >= WIDTH else np.zeros(0, np.int64)
        ends = ends[(ends >= lo) & (doc[ends - WIDTH + 1] == doc[ends])]
        if len(ends):
            of = doc[ends]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            square[of[first]] += np.add.reduceat((upto[ends + 1 - a] - upto[ends + 1 - WIDTH - a]) ** 2, first, axis=0)
    square = np.where((sizes < WIDTH)[:, None], total**2, square)
    return np.concatenate([total / np.maximum(sizes, 1)[:, None], square / (WIDTH * np.maximum(sizes - WIDTH + 1, 1))[:, None]], axis=1).astype(np.float32)


def pool_all(texts: Iterator[str], rows: Rows, vectors: np.ndarray) -> np.ndarray:
    parts = [pooled(list(some), rows, vectors) for some in batched(texts, 500)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * vectors.shape[1]), np.float32)


class Network:
    """One hidden layer, trained by Adam on half of the rows and cooled on the rest."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray, rounds: int = 60):
        rng = np.random.default_rng(5)
        use = np.flatnonzero(~check)
        self.mean, self.scale = x[use].mean(0), x[use].std(0) + 1e-6
        z = ((x - self.mean) / self.scale).astype(np.float32)
        share = np.clip(y[use].mean(), 1e-3, 1 - 1e-3)
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(share / (1 - share)))]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(rounds):
            order = rng.permutation(use)
            rate = 3e-3 * (1 - epoch / rounds)
            for lo in range(0, len(order), 128):
                i = order[lo : lo + 128]
                h = np.maximum(z[i] @ p[0] + p[1], 0)
                d = (sigmoid(h @ p[2] + p[3]) - y[i]) / len(i)
                back = np.outer(d, p[2]) * (h > 0)
                grads = [z[i].T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if check.any():
            logit, best = self.logit(x[check]), None
            for t in np.exp(np.linspace(np.log(0.25), np.log(8), 61)):
                q = np.clip(sigmoid(logit / t), 1e-9, 1 - 1e-9)
                loss = -(y[check] * np.log(q) + (1 - y[check]) * np.log(1 - q)).mean()
                if best is None or loss < best:
                    best, self.temperature = loss, float(t)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def fit(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, per_class: int) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all documents, and a network from a bounded sample of labelled rows."""
    rows = sample(docs, labels, "quality", modulus, held_out, per_class).checkpoint()
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = texts.mapInArrow(contexts, "row long, n long, vec array<int>")
    total, count = np.zeros((TABLE, DIM), np.float64), np.zeros(TABLE)
    summed = parts.groupBy("row").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("vec")[i].cast("double")) for i in range(DIM))).alias("vec")).toPandas()
    if len(summed):
        total[summed["row"]] = np.stack(summed["vec"].to_numpy())
        count[summed["row"]] = summed["n"]
    # a rare term leans on its own index vector; frequent ones on the company they keep
    own = index_vectors()
    vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9) * (count / (count + 3))[:, None] + own / np.sqrt(ONES) * (3 / (count + 3))[:, None]).astype(np.float32)

    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        known = Rows()
        for b in batches:
            x = pool_all(strings(b.column(0)), known, shipped.value)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "y", "fold", "x"])

    data = rows.select("text", "doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("check")), F.lit(5)).cast("int").alias("fold")).mapInArrow(features, "doc_id long, y int, fold int, x array<float>").toPandas().sort_values(["doc_id"])
    shipped.destroy()
    if data["y"].nunique() < 2:
        return vectors, None
    y = data["y"].to_numpy(float)
    return vectors, Network(np.stack(data["x"].to_numpy()), y, (data["fold"] == 0).to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text, ...)`` for quality as ``labels(doc_id, quality)`` marks it.

    Random indexing: each term has a sparse ternary index vector, and its word vector
    sums those of its neighbours, rolled by side. A document pools the vectors of all its
    terms and nothing else: their mean, and the mean square of their sums over windows; a
    two-layer network scores the pool, and a temperature chosen on rows
    that it wasn't trained on calibrates the probabilities. Word vectors come from all
    documents, without their labels. Network and temperature are fitted on at most
    ``per_class`` labelled rows of each class, never on rows whose crc32(doc_id) mod
    ``modulus`` is ``held_out``; the table of vectors has a fixed size.

    Result per row: doc_id, held_out, score, predicted. Null text counts as empty and is
    scored. A null doc_id is scored and not held out. Without labels of both classes
    every text scores 0.5. Repeated rows each get a row; other columns are not read.
    """
    vectors, network = fit(docs, labels, modulus, held_out, per_class)
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        rows = Rows()
        for b in batches:
            x = pool_all(strings(b.column(1)), rows, vectors)
            score = network.score(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score.astype(float)), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(bucket(modulus) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
