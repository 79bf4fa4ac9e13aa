"""Exact top-k inner-product search by ball trees."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.session import table

#: Vectors of a shard, and queries that meet it together: what one task holds.
SHARD, BLOCK = 8192, 512
#: Most vectors around which the others gather.
PIVOTS = 1024
LEAF = 64
LOW = np.iinfo(np.int64).min
HIGH = np.iinfo(np.int64).max


class BallTree:
    """Nodes in arrays: rows lo..hi, centre, radius, and two children (0 for a leaf)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        spans, centres, radii, children = [(0, len(ids))], [None], [0.0], [0]
        points = vectors.astype(float)
        at = 0
        while at < len(spans):
            lo, hi = spans[at]
            own = points[order[lo:hi]]
            c = own.mean(0) if hi > lo else np.zeros(vectors.shape[1])
            far = np.sqrt(((own - c) ** 2).sum(1)) if hi > lo else np.zeros(1)
            centres[at], radii[at] = c, float(far.max())
            if hi - lo > LEAF and far.max() > 0:
                a = own[far.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                split = np.argsort(own @ (b - a), kind="stable")
                order[lo:hi] = order[lo:hi][split]
                mid = (lo + hi) // 2
                children[at] = len(spans)
                spans += [(lo, mid), (mid, hi)]
                centres += [None, None]
                radii += [0.0, 0.0]
                children += [0, 0]
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.spans, self.centres, self.radii, self.children = spans, np.array(centres), np.array(radii), children

    def search(self, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for each query, at least as good as ``kth``; (LOW, HIGH) where there are fewer.

        Nodes leave the queue in the order of their upper bounds q.c + |q| r, each with
        the queries whose current kth score it may still reach.
        """
        m = len(queries)
        scores, ids, kth = np.full((m, k), LOW), np.full((m, k), HIGH), kth.copy()
        if not m or not len(self.ids):
            return scores, ids
        real = queries.astype(float)
        norm = np.sqrt((real**2).sum(1))
        exact = float(np.abs(real).max(initial=0)) * float(np.abs(self.vectors.astype(float)).max(initial=0)) * max(1, real.shape[1]) < 2**53

        def bound(node, rows):
            b = real[rows] @ self.centres[node] + norm[rows] * self.radii[node]
            return b + 1e-9 * (np.abs(b) + norm[rows] * self.radii[node]) + 1e-6

        rows = np.arange(m)
        queue = [(0.0, 0, rows, bound(0, rows))]
        while queue:
            _, node, rows, most = heapq.heappop(queue)
            live = most >= kth[rows]
            rows = rows[live]
            if not len(rows):
                continue
            first = self.children[node]
            if first:
                for child in (first, first + 1):
                    most = bound(child, rows)
                    heapq.heappush(queue, (-float(most.max()), child, rows, most))
                continue
            lo, hi = self.spans[node]
            for i in range(lo, hi, 4096):
                j = min(hi, i + 4096)
                part = self.vectors[i:j]
                if exact:
                    got = (real[rows] @ part.T.astype(float)).astype(np.int64)
                else:
                    got = np.clip(queries[rows].astype(object) @ part.T.astype(object), LOW + 1, HIGH).astype(np.int64)
                who = np.broadcast_to(self.ids[i:j], got.shape)
                mine = who == own[rows, None]
                got = np.where(mine, LOW, got)
                s = np.concatenate([scores[rows], got], axis=1)
                w = np.concatenate([ids[rows], np.where(mine, HIGH, who)], axis=1)
                best = np.lexsort((w, -s.astype(float) if exact else np.invert(s)), axis=1)[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(w, best, 1)
                kth[rows] = np.maximum(kth[rows], scores[rows, k - 1])
        return scores, ids


def whole_numbers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(256 x) of the usable vectors of an Arrow list column, as (row, first, after) of flat numbers; others are left out."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.list_(pa.float64()))
    offsets = a.offsets.to_numpy().astype(np.int64)
    flat = a.values.to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & a.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(good)
    return rows, offsets[rows], flat


def scaled(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors of one length, and their whole numbers (Python integers where 64 bits don't hold them)."""
    rows, first, flat = whole_numbers(column)
    x = np.floor(256 * flat[first[:, None] + np.arange(dim)]) if dim else np.zeros((len(rows), 0))
    if np.abs(x).max(initial=0) < 2**62:
        return rows, x.astype(np.int64)
    return rows, np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(len(rows), dim)


class Pivots:
    """Some vectors by length, around which all others are gathered; the radius of each gathering once it is known."""

    def __init__(self, vectors: list[list[float]]):
        self.of: dict[int, np.ndarray] = {}
        for dim in {len(v) for v in vectors}:
            self.of[dim] = np.unique(np.floor(256 * np.array([v for v in vectors if len(v) == dim], float).reshape(-1, dim)), axis=0)
        self.radius = {dim: np.zeros(len(c)) for dim, c in self.of.items()}
        self.shards = {dim: np.ones(len(c), np.int64) for dim, c in self.of.items()}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance, a little too large; -1 where the length has none."""
        centres = self.of.get(x.shape[1])
        if centres is None:
            return np.full(len(x), -1), np.zeros(len(x))
        with np.errstate(all="ignore"):
            at = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - centres[at]) ** 2).sum(1))
        return at, np.where(np.isfinite(away), away * (1 + 1e-9) + 1e-6, np.inf)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """At most how large a product with a member of each gathering can be, [queries, gatherings]."""
        dim = q.shape[1]
        if dim not in self.of:
            return np.full((len(q), 1), np.inf)
        with np.errstate(all="ignore"):
            norm = np.sqrt((q**2).sum(1))[:, None]
            b = q @ self.of[dim].T + norm * self.radius[dim]
            b += 1e-9 * (np.abs(b) + norm * self.radius[dim]) + 1e-6
        return np.where(np.isfinite(b), b, np.inf)


def gather(pivots: Pivots):
    """Usable rows with their length, pivot and distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in pc.unique(t["dim"]).to_pylist():
                part = t.filter(pc.equal(t["dim"], dim))
                rows, x = scaled(part["embedding"], dim)
                at, away = pivots.nearest(x.astype(float))
                part = part.take(pa.array(rows))
                yield from pa.Table.from_arrays([part["dim"], pa.array(at.astype(np.int32)), pa.array(away), part["vec_id"], part["embedding"]], ["dim", "pivot", "away", "vec_id", "embedding"]).to_batches()

    return run


BEST = "array<struct<score: bigint, vec_id: bigint>>"
BUILT = f"kind string, dim int, pivot int, shard long, query_id long, q binary, best {BEST}, blob binary"


def listed(scores: np.ndarray, ids: np.ndarray) -> list[list[dict]]:
    return [[{"score": int(s), "vec_id": int(i)} for s, i in zip(a, b, strict=True) if i != HIGH or s != LOW] for a, b in zip(scores, ids, strict=True)]


def shard_tree(every: int, k: int):
    """One shard's ball tree, and its own queries with their best scores inside the shard."""

    def run(t: pa.Table) -> pa.Table:
        place = [t[c][0].as_py() for c in ("dim", "pivot", "shard")]
        rows, vectors = scaled(t["embedding"], place[0])
        tree = BallTree(t["vec_id"].to_numpy()[rows].astype(np.int64), vectors)
        out = [("tree", *place, None, None, None, pickle.dumps(tree))]
        asked = np.flatnonzero(tree.ids % every == 0)
        q, own = tree.vectors[asked], tree.ids[asked]
        found = listed(*tree.search(q, own, np.full(len(q), LOW), k))
        out += [("query", *place, int(i), pickle.dumps(v), f, None) for i, v, f in zip(own, q, found, strict=True)]
        struct = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), struct, pa.binary())
        names = ("kind", "dim", "pivot", "shard", "query_id", "q", "best", "blob")
        return pa.table({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return run


def route(pivots: Pivots, lo: int, hi: int, k: int):
    """Queries packed for the gatherings that rank from lo to hi in their order of bounds, where the bound still reaches the kth score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            t = pa.Table.from_batches([b])
            for dim in pc.unique(t["dim"]).to_pylist():
                part = t.filter(pc.equal(t["dim"], dim))
                name, own, pivot, shard = (part[c].to_numpy() for c in ("query", "query_id", "pivot", "shard"))
                q = np.array([pickle.loads(v) for v in part["q"].to_pylist()]).reshape(len(part), dim)
                kth = np.array([x[k - 1]["score"] if len(x) >= k else LOW for x in part["best"].to_pylist()])
                bounds = pivots.bounds(q.astype(float))
                order = np.argsort(-bounds, axis=1, kind="stable")[:, lo:hi]
                reach = np.take_along_axis(bounds, order, 1) >= kth[:, None].astype(float)
                many = pivots.shards.get(dim)
                for p in np.unique(order[reach]).tolist():
                    i = np.flatnonzero((reach & (order == p)).any(1))
                    if many is not None and many[p] == 1:
                        i = i[pivot[i] != p]  # its only shard is theirs
                    for j in range(0, len(i), BLOCK):
                        some = i[j : j + BLOCK]
                        home = np.where(pivot[some] == (p if many is not None else -1), shard[some], -1)
                        out.append((dim, p if many is not None else -1, pickle.dumps((name[some], own[some], q[some], kth[some], home))))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([x[0] for x in out], pa.int32()), "pivot": pa.array([x[1] for x in out], pa.int32()), "asked": pa.array([x[2] for x in out], pa.binary())})

    return run


def search_shards(k: int):
    """Packed queries against the tree beside them, from the kth scores that they bring along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for b in batches:
            for shard, blob, asked in zip(*(b.column(i) for i in range(3)), strict=True):
                if held is None or not blob.equals(held):
                    held, tree = blob, pickle.loads(blob.as_py())
                name, own, q, kth, home = pickle.loads(asked.as_py())
                away = home != shard.as_py()
                scores, ids = tree.search(q[away], own[away], kth[away], k)
                r, c = np.nonzero(ids != HIGH)
                cols = [name[away][r], scores[r, c], ids[r, c]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["query", "score", "vec_id"])

    return run


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, shard: int = SHARD, pivots: int = PIVOTS) -> DataFrame:
    """The k highest integer inner products of each query among ``vectors(vec_id, embedding, ...)``.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    with another vec_id. Components become floor(256 x). Vectors gather around at most
    ``pivots`` of their own number, chosen by hash, and each gathering is cut into shards of
    about ``shard`` vectors with a ball tree each. A query first searches its own shard. Then, in rounds
    of 1, 3, 12, 48, ... gatherings in the order of their upper bounds, it visits those whose bound its
    kth score doesn't beat yet; every round starts from the kth scores of the one before, and a
    query that no further gathering can help drops out. Trees and queries meet in a
    join of packed queries with the one tree of a shard, so memory is bounded on both
    sides; only queries travel to more than one place, and only where they may find something.

    Result: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id; fewer
    than k rows where there are fewer candidates. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without vec_id; vectors of
    different lengths don't meet; scores beyond a long are cut to its range. Rows that
    repeat a vec_id are each candidates, and each a query if it is one; they spread over shards like any others.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null").withColumn("dim", F.size("embedding"))
    usable = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n = rows.count()
    chosen = usable.orderBy(F.xxhash64("vec_id", "embedding")).limit(max(1, min(pivots, -(-n // shard)))).select("embedding")
    around = Pivots([r["embedding"] for r in chosen.collect()])
    near = rows.select("dim", "vec_id", "embedding").mapInArrow(gather(around), "dim int, pivot int, away double, vec_id long, embedding array<double>").checkpoint()
    sizes = near.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).withColumn("shards", F.ceil(F.col("n") / shard)).checkpoint()
    for r in sizes.where("pivot >= 0").collect():  # as many as there are pivots
        around.radius[r["dim"]][r["pivot"]], around.shards[r["dim"]][r["pivot"]] = r["radius"], r["shards"]
    shards = sizes.select("dim", "pivot", "shards")
    dealt = near.withColumn("at", F.monotonically_increasing_id()).join(shards, ["dim", "pivot"]).withColumn("shard", F.pmod("at", "shards"))
    built = dealt.select("dim", "pivot", "shard", "vec_id", "embedding").groupBy("dim", "pivot", "shard").applyInArrow(shard_tree(every, k), BUILT).checkpoint()
    trees = built.where("kind = 'tree'").select("dim", "pivot", "shard", "blob")
    state = built.where("kind = 'query'").select(F.monotonically_increasing_id().alias("query"), "query_id", "dim", "pivot", "shard", "q", "best").checkpoint()
    lo, hi = 0, 1
    while lo < max([1, *map(len, around.of.values())]):
        asked = state.mapInArrow(route(around, lo, hi, k), "dim int, pivot int, asked binary").checkpoint()
        if asked.isEmpty():
            break
        asked = asked.join(shards, ["dim", "pivot"]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        found = asked.join(trees, ["dim", "pivot", "shard"]).select("shard", "blob", "asked").mapInArrow(search_shards(k), "query long, score long, vec_id long")
        both = found.unionByName(state.select("query", F.inline("best")))
        best = both.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "vec_id"))), 1, k).alias("_best"))
        best = best.select("query", F.transform("_best", lambda x: F.struct((-x["score"]).alias("score"), x["vec_id"].alias("vec_id"))).alias("_best"))
        state = state.join(best, "query", "left").select("query", "query_id", "dim", "pivot", "shard", "q", F.coalesce("_best", "best").alias("best")).checkpoint()
        lo, hi = hi, 4 * hi
    return state.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
