"""Best-fit packing of token pieces into sequences, improved by swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.tokens import library_ids, strings, texts_of
from blockalloc.session import table

#: Pieces that one task packs; the number of tasks grows with the pieces.
SHARD = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(path: str, size: int, end: int):
    """Ids of each text and the end id, cut into pieces of ``size``; the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = library_ids(path), np.uint32(end).tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), tokens.ids_of(strings(b.column(1))), strict=True):
                ids += last
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - at) % size or size
                    rows.append((doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, k = at + length, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        tokens.forget()

    return run


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room; a bit mask of free spaces finds it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = mask >> n
        if above:
            space = n + (above & -above).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = size, len(bins)
            bins.append([i])
        free[space - n].append(b)
        mask |= 1 << (space - n)
    return bins


class Search:
    """Moves and exchanges between underfull bins, each of which raises the sum of squared fills, until none is left.

    A bin gives nothing, an item or two, and takes an item of another bin that is longer in
    all; for nothing or an item it may take two. For every sum that one or two items of a bin
    have, the bins that can give it are held in order of fill: the emptiest is the best
    partner, so looking at it alone leaves none out. The squares are whole numbers with a ceiling, so the search ends.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], size: int):
        self.lengths, self.bins, self.size = lengths, bins, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.live = {b for b in range(len(bins)) if self.fill[b] < size}
        self.gives: dict[int, tuple[dict[int, tuple[int, ...]], ...]] = {}
        self.at: tuple[list[list[tuple[int, int]]], ...] = tuple([[] for _ in range(size + 1)] for _ in range(2))  # by sum: (fill, bin)
        self.low = np.full((2, size + 1), 2 * size)  # the least fill there
        for b in self.live:
            self.enter(b)

    def enter(self, b: int) -> None:
        ones: dict[int, tuple[int, ...]] = {}
        twos: dict[int, tuple[int, ...]] = {}
        alike = set()
        for i in self.bins[b]:
            n = self.lengths[i]
            if n in alike:
                continue
            if n in ones:  # two of a length give one sum more, further ones none
                alike.add(n)
                twos[2 * n] = (*ones[n], i)
                continue
            twos |= {n + m: (*j, i) for m, j in ones.items()}
            ones[n] = (i,)
        self.gives[b] = ones, twos
        for at, low, sums in zip(self.at, self.low, self.gives[b], strict=True):
            for n in sums:
                insort(at[n], (self.fill[b], b))
                low[n] = at[n][0][0]

    def leave(self, b: int) -> None:
        for at, low, sums in zip(self.at, self.low, self.gives.pop(b), strict=True):
            for n in sums:
                del at[n][bisect_left(at[n], (self.fill[b], b))]
                low[n] = at[n][0][0] if at[n] else 2 * self.size

    def improve(self, a: int) -> bool:
        ones, twos = self.gives[a]
        self.leave(a)
        room = self.size - self.fill[a]
        after = self.fill[a] + np.arange(1, room + 1)
        best = 0, (), 0, 0
        for give, items, kinds in [(0, (), (0, 1)), *((n, i, (0, 1)) for n, i in ones.items()), *((n, i, (0,)) for n, i in twos.items())]:
            for kind in kinds:
                # (fa + g)^2 + (fb - g)^2 > fa^2 + fb^2 when fa + g > fb
                hits = np.flatnonzero(self.low[kind, give + 1 : give + room + 1] < after)
                if len(hits) and hits[-1] + 1 > best[0]:
                    best = int(hits[-1]) + 1, items, kind, give
        gain, out, kind, give = best
        if not gain:
            self.enter(a)
            return False
        b = self.at[kind][give + gain][0][1]
        into = self.gives[b][kind][give + gain]
        self.leave(b)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + [*into]
        self.bins[b] = [i for i in self.bins[b] if i not in into] + [*out]
        self.fill[a] += gain
        self.fill[b] -= gain
        for x in (a, b):
            if 0 < self.fill[x] < self.size:
                self.enter(x)
            else:
                self.live.discard(x)
        return True

    def run(self) -> list[list[int]]:
        again = True
        while again:  # until a round over all bins finds nothing
            again = False
            for a in sorted(self.live, key=lambda b: (-self.fill[b], b)):
                while a in self.live and self.improve(a):
                    again = True
        return [b for b in self.bins if b]


def pack_shard(size: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        shard, lengths = t["shard"][0].as_py(), t["length"].to_pylist()
        bins = Search(lengths, best_fit(lengths, size), size).run()
        sequence, offset = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = (shard << 32) + k, at
                at += lengths[i]
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """Pack the token ids of ``docs(doc_id, text, ...)`` into as few sequences of ``size`` tokens as found.

    A document is its ids and the id ``end``; only longer ones are cut. Pieces are
    dealt at random to shards of about 8,192, whatever their number, and each shard is
    packed on its own: best fit, then moves and swaps between underfull bins. So a
    shard loses less than a sequence. Texts are read once; what moves is 40 bytes a
    piece, through a checkpoint, since the shards are counted first.

    Result per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty text are a piece of one token. Rows that repeat a doc_id are packed
    each. Other columns are not read. No rows give no rows.
    """
    pieces = texts_of(docs).mapInArrow(cut_pieces(path, size, end), PIECES).checkpoint()
    shards = max(1, -(-pieces.count() // SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack_shard(size), f"{PIECES}, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
