"""Removal of repeated byte strings by a hash-compared suffix sort.

Every string of ``length`` bytes contains the same sampled seed wherever it occurs (the
k-gram with the least hash in it), so repeats meet at the owner of their seed's hash.
An owner sorts the suffixes that start at its seeds, and the reversed prefixes that end
there, by a merge sort whose comparisons find common extensions by binary search over
prefix polynomial hashes; bytes then verify each common extension.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.packed import binary_parts, block_count, by_bucket, by_number, unpack_all
from blockalloc.session import table

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
#: A random 64-bit value for each byte value.
VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes hashed at a time (a longer document is taken alone).
CHUNK = 1 << 20
#: Rows of a bucket whose prefix hashes are in memory at a time (a larger group is taken alone).
ROWS = 1 << 15
#: A seed that occurs more often than this is split into the strings around it.
HOT = 1 << 13
#: Bytes of documents in a block.
BLOCK_BYTES = 8 << 20
#: The lowest bits of a hash say how often it occurs (a logarithm), or in a reply whether that is hot.
MARK = np.uint64(15)
#: A row without doc_id stands before all others.
NO_ID = np.iinfo(np.int64).min


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def seed_size(length: int) -> int:
    return max(1, 2 * length // 5)


def running(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        a = f(a[: len(a) - step], a[step:])
        have += step
    return a


class Prefixes:
    """Prefix polynomial hashes of a byte buffer, and from them the hash of any part."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = np.full(n + 1, INVERSE)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        power = np.full(n, BASE)
        if n:
            power[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUE[data] * np.cumprod(power), out=self.sums[1:])

    def part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.back[lo]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k]


def seeds(p: Prefixes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds: of each string of ``length`` bytes, the k-grams with the least hash."""
    k = seed_size(length)
    width = length - k + 1
    n = len(p.sums) - 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = spread(p.grams(k))
    rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = running(rank, width, True)
    # strings that would cross from one document to the next rule nothing
    inside = np.zeros(n + 1, np.int32)
    ok = ends - starts >= length
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, ends[ok] - length + 1, -1)
    low[np.cumsum(inside)[: len(low)] <= 0] = 0
    edge = np.zeros(width - 1, np.uint32)
    high = running(np.concatenate([edge, low, edge]), width, False)
    at = np.flatnonzero(rank == high)
    return at, h[at]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Runs of documents of about ``size`` bytes: (first, after the last)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def sorted_docs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null first), bytes and offsets of a block's rows by id, then text; and where each row stood."""
    t = t.select(["doc_id", "data"]).append_column("place", pa.array(np.arange(len(t))))
    t = t.sort_by([("doc_id", "ascending"), ("data", "ascending")])
    data, offsets = binary_parts(t["data"])
    ids = t["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    if (order != np.arange(len(ids))).any():  # nulls were sorted last
        lens = np.diff(offsets)[order]
        data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in order])
        offsets, ids = np.r_[0, np.cumsum(lens)], ids[order]
    return ids, data, offsets, t["place"].to_numpy()[order]


def find_seeds(length: int, buckets: int):
    """Of a block: each seed hash once with how often the block has it, dealt to owners."""

    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        _, data, offsets, _ = sorted_docs(t)
        found = []
        for lo, hi in chunks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            found.append(seeds(Prefixes(part), offsets[lo:hi] - offsets[lo], offsets[lo + 1 : hi + 1] - offsets[lo], length)[1])
        return to_owners([(0, b, blob) for b, blob in counted(found, buckets)], block)

    return run


def counted(hashes: list[np.ndarray], buckets: int):
    """(owner, packed hashes), each hash once with the logarithm of its count."""
    h, count = np.unique(np.concatenate(hashes) & ~MARK, return_counts=True)
    return by_bucket(bucket_of(h, buckets), h | np.minimum(np.log2(count).astype(np.uint64), MARK))


def to_owners(rows: list[tuple[int, int, bytes]], block: int) -> pa.Table:
    """Rows of (kind, owner, packed): kind 0 seeds or spans, 1 counts of strings."""
    kind, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "blob": pa.array(blob, pa.binary())})


def to_blocks(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kind, block, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int32()), "blob": pa.array(blob, pa.binary())})


TO_OWNERS, TO_BLOCKS = "kind int, bucket int, block int, blob binary", "kind int, block int, blob binary"


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def repeated(t: pa.Table, hot: int) -> list[tuple[int, bytes]]:
    """Of an owner's hashes, those that occur twice, sent back to the blocks that have them; marked where they occur more than ``hot`` times."""
    blocks, parts = t["block"].to_numpy(), [unpack_all([b], np.uint64)[0] for b in t["blob"].to_pylist()]
    block, h = np.repeat(blocks, [len(p) for p in parts]), np.concatenate(parts)
    order = np.argsort(h & ~MARK, kind="stable")
    h, block = h[order], block[order]
    key = h & ~MARK
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    many = np.repeat(np.add.reduceat(np.int64(1) << (h & MARK).astype(np.int64), cut), size)
    keep = many > 1
    return list(by_bucket(block[keep], (key | (many > hot).astype(np.uint64))[keep]))


def repeated_seeds(hot: int):
    return lambda t: to_blocks([(0, *x) for x in repeated(t, hot)])


#: What a seed travels with: hash, document, row and place in the block, bytes at hand to the left and right.
SEED = (np.uint64, np.int64, np.int32, np.int32, np.int16, np.int16)
#: A removed part: row in the block, first byte, byte after the last.
SPAN = (np.int32, np.int32, np.int32)


def around_seeds(length: int, buckets: int):
    """Of a block, the repeated seeds with the bytes around them, dealt to the owners of their hashes.

    Seeds whose whole surroundings stand earlier in the block, byte for byte, are
    settled here: their spans come back with bucket -1 - block. Of hot seeds only the
    hashes of the strings that contain them are sent, so no owner gets all of them.
    """
    k = seed_size(length)
    side = length - k

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs) or not len(replies):
            return to_owners([], 0)
        block = docs["block"][0].as_py()
        wanted = np.sort(unpack_all(replies["blob"].to_pylist(), np.uint64)[0])
        ids, data, offsets, _ = sorted_docs(docs)
        cols, strings = [], []
        for lo, hi in chunks(offsets):
            base = offsets[lo]
            p = Prefixes(data[base : offsets[hi]])
            at, h = seeds(p, offsets[lo:hi] - base, offsets[lo + 1 : hi + 1] - base, length)
            h = h & ~MARK
            spot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            good = (wanted[spot] & ~MARK) == h
            at, h, hot = at[good], h[good], (wanted[spot[good]] & MARK) > 0
            row = lo + np.searchsorted(offsets[lo + 1 : hi + 1] - base, at, "right")
            left = np.minimum(side, at + base - offsets[row])
            right = np.minimum(side, offsets[row + 1] - base - at - k)
            if hot.any():
                some = hot & (left + right >= side)
                inside = np.zeros(len(p.sums) + 1, np.int32)
                np.add.at(inside, (at - left)[some], 1)
                np.add.at(inside, (at + k + right - length + 1)[some], -1)
                start = np.flatnonzero(np.cumsum(inside) > 0)
                strings.append(spread(p.part(start, start + length)))
                at, h, row, left, right = (x[~hot] for x in (at, h, row, left, right))
            cols.append((h, row, at + base - offsets[row], left, right, p.part(at - left, at + k + right)))
        h, row, pos, left, right, whole = (np.concatenate(x) for x in zip(*cols, strict=True))
        kind = spread(whole ^ h * np.uint64(3)) ^ (left * 1000 + right).astype(np.uint64)
        start = offsets[row] + pos
        again = settled(kind, data, start - left, left, right, left + k + right)
        rows = [(1, b, blob) for b, blob in counted(strings, buckets)] if strings else []
        if again.any():
            rows += [(0, -1 - block, x[1]) for x in by_bucket(np.zeros(again.sum(), np.int64), row[again].astype(np.int32), (pos - left)[again].astype(np.int32), (pos + k + right)[again].astype(np.int32))]
        i = np.flatnonzero(~again)
        if len(i):
            rows += [(0, *x) for x in sent(i, h, ids, row, pos, left, right, data, start, k, side, buckets)]
        return to_owners(rows, block)

    return run


def settled(kind: np.ndarray, data: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which parts of a block stand byte for byte at an earlier place of like ``kind``."""
    _, first, back = np.unique(kind, return_index=True, return_inverse=True)
    first = first[back]
    again = np.flatnonzero(first != np.arange(len(kind)))
    same = (left[again] == left[first[again]]) & (right[again] == right[first[again]])
    for lo in range(0, len(again), ROWS):  # the bytes decide
        i = again[lo : lo + ROWS]
        same[lo : lo + ROWS] &= equal_parts(data, start[i], start[first[i]], size[i])
    out = np.zeros(len(kind), bool)
    out[again[same]] = True
    return out


def around_strings(length: int, buckets: int):
    """Of a block, the first of each repeated string around hot seeds, dealt to owners; later ones and the spans found so far come back at once."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(docs) or not len(found):
            return to_owners([], 0)
        block = docs["block"][0].as_py()
        blobs = found["blob"].to_pylist()
        rows = [(0, -1 - block, blob) for kind, blob in zip(found["kind"].to_pylist(), blobs, strict=True) if kind == 0]
        wanted = np.sort(unpack_all([blob for kind, blob in zip(found["kind"].to_pylist(), blobs, strict=True) if kind], np.uint64)[0] & ~MARK)
        if not len(wanted):
            return to_owners(rows, block)
        likely = np.zeros(1 << 20, bool)
        likely[(wanted >> np.uint64(4)) & np.uint64(len(likely) - 1)] = True
        ids, data, offsets, _ = sorted_docs(docs)
        cols = []
        for lo, hi in chunks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            if len(part) < length:
                continue
            h = spread(Prefixes(part).grams(length)) & ~MARK
            at = np.flatnonzero(likely[(h >> np.uint64(4)) & np.uint64(len(likely) - 1)])
            at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]]
            row = lo + np.searchsorted(offsets[lo + 1 : hi + 1] - offsets[lo], at, "right")
            good = at + offsets[lo] + length <= offsets[row + 1]
            cols.append((h[at][good], row[good], (at + offsets[lo] - offsets[row])[good]))
        if not cols:
            return to_owners(rows, block)
        h, row, pos = (np.concatenate(x) for x in zip(*cols, strict=True))
        start, none, size = offsets[row] + pos, np.zeros(len(h), np.int64), np.full(len(h), length)
        again = settled(h, data, start, none, none, size)
        i = np.flatnonzero(again)
        if len(i):  # neighbouring strings make one span
            new = np.flatnonzero(np.r_[True, (row[i][1:] != row[i][:-1]) | (pos[i][1:] != pos[i][:-1] + 1)])
            last = np.r_[new[1:], len(i)] - 1
            rows += [(0, -1 - block, x[1]) for x in by_bucket(np.zeros(len(new), np.int64), row[i][new].astype(np.int32), pos[i][new].astype(np.int32), (pos[i][last] + length).astype(np.int32))]
        i = np.flatnonzero(~again)
        return to_owners(rows + [(0, *x) for x in sent(i, h, ids, row, pos, none, none, data, start, length, 0, buckets)], block)

    return run


def sent(i, h, ids, row, pos, left, right, data, start, k, side, buckets):
    around = np.zeros((len(i), 2 * side + k), np.uint8)
    for lo in range(0, len(i), ROWS):
        j = i[lo : lo + ROWS]
        at = start[j][:, None] + np.arange(-side, k + side)
        good = (at >= (start[j] - left[j])[:, None]) & (at < (start[j] + k + right[j])[:, None])
        around[lo : lo + ROWS] = np.where(good, data[np.clip(at, 0, len(data) - 1)], 0)
    return list(by_bucket(bucket_of(h[i], buckets), h[i], ids[row[i]], row[i].astype(np.int32), pos[i].astype(np.int32), left[i].astype(np.int16), right[i].astype(np.int16), around))


def equal_parts(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], for each row."""
    step = np.arange(n.max() if len(n) else 0)
    live = step < n[:, None]
    last = len(data) - 1
    return ((data[np.minimum(a[:, None] + step, last)] == data[np.minimum(b[:, None] + step, last)]) | ~live).all(axis=1)


def common(hashes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of rows a and b, by binary search over their prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), np.minimum(sizes[a], sizes[b]).astype(np.int64)
    for _ in range(int(hi.max()).bit_length() if len(hi) else 0):
        mid = (lo + hi + 1) >> 1
        equal = hashes[a, mid] == hashes[b, mid]
        lo, hi = np.where(equal, mid, lo), np.where(equal, hi, np.maximum(lo, mid - 1))
    return lo


def before(text, hashes, sizes, a, b) -> np.ndarray:
    """Whether row a sorts before row b; equal rows keep their order."""
    n = common(hashes, sizes, a, b)
    short_a, short_b = n >= sizes[a], n >= sizes[b]
    x, y = text[a, np.minimum(n, text.shape[1] - 1)], text[b, np.minimum(n, text.shape[1] - 1)]
    return np.where(short_a & short_b, a < b, np.where(short_a, True, np.where(short_b, False, x < y)))


def suffix_sort(text: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows inside each group, and the bytes each shares with the row before it (-1 at a group's start).

    ``group`` is non-decreasing. Bottom-up merge sort: at each level every row finds its
    rank in the neighbouring run by binary search.
    """
    n = len(text)
    hashes = np.zeros((n, text.shape[1] + 1), np.uint64)
    np.cumsum(VALUE[text] * np.cumprod(np.full(text.shape[1], BASE)), axis=1, out=hashes[:, 1:])
    order = np.arange(n)
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[cut, n])
    first, many = np.repeat(cut, size), np.repeat(size, size)
    place = np.arange(n) - first  # of slot in group
    run = 1
    while run < many.max(initial=0):
        live = np.flatnonzero(many > run)
        own = (place[live] // run) * run
        mate = np.where((place[live] // run) % 2 == 0, own + run, own - run)
        stop = np.minimum(mate + run, many[live])
        lo, hi = mate.copy(), np.maximum(mate, stop)
        me = order[live]
        for _ in range(run.bit_length()):
            busy = np.flatnonzero(lo < hi)
            if not len(busy):
                break
            mid = (lo[busy] + hi[busy]) >> 1
            other = order[first[live][busy] + mid]
            less = before(text, hashes, sizes, other, me[busy])
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
        to = first[live] + np.minimum(own, mate) + (place[live] - own) + (lo - mate)
        order[to] = me
        run *= 2
    a, b = order[:-1], order[1:]
    joined = group[a] == group[b]
    shared = np.where(joined, common(hashes, sizes, a, b), -1)
    # verification: the bytes must agree up to there, and differ and be in order after it
    most = np.minimum(sizes[a], sizes[b])
    width = np.arange(text.shape[1])
    differ = (text[a] != text[b]) & (width < most[:, None])
    real = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    at = np.minimum(real, text.shape[1] - 1)
    r = np.arange(len(a))
    wrong = joined & ((shared != real) | (real < most) & (text[a][r, at] > text[b][r, at]) | (real == most) & (sizes[a] > sizes[b]))
    shared = np.where(joined, real, -1)
    for g in np.unique(group[a[wrong]]):  # a collision: this group is sorted by its bytes
        lo, hi = np.searchsorted(group, (g, g + 1))
        rows = sorted(range(lo, hi), key=lambda i: (text[i, : sizes[i]].tobytes(), i))
        order[lo:hi] = rows
        for j in range(lo, hi - 1):
            x, y = text[rows[j - lo], : sizes[rows[j - lo]]], text[rows[j - lo + 1], : sizes[rows[j - lo + 1]]]
            m = min(len(x), len(y))
            d = np.flatnonzero(x[:m] != y[:m])
            shared[j] = d[0] if len(d) else m
    return order, np.r_[-1, shared]


def covered(group, left, right, around, k: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset (seed minus string start) at which a row's string stands earlier in its group; -1 if none.

    Rows are in order inside a group. A string at offset d needs d shared bytes to the
    left and k + side - d from the seed on; rows that agree on both share a class pair.
    """
    n = len(group)
    least, most = np.full(n, side + 1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return least, most
    ro, rs = suffix_sort(around[:, side:], (k + right).astype(np.int64), group)
    lo_, ls = suffix_sort(np.ascontiguousarray(around[:, side - 1 :: -1] if side else around[:, :0]), left.astype(np.int64), group) if side else (np.arange(n), np.where(np.r_[True, group[1:] != group[:-1]], -1, 0))

    def best(order, shared):
        out = np.zeros(n, np.int64)
        out[order] = np.maximum(shared, np.r_[shared[1:], -1])
        return out

    can = np.minimum(best(lo_, ls), left) + np.minimum(best(ro, rs) - k, right) >= side
    can &= best(ro, rs) >= k
    if not can.any():
        return least, most

    def classes(order, shared, depth):
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(shared < depth)
        return out

    for d in range(side + 1):
        rows = np.flatnonzero(can & (left >= d) & (right >= side - d))
        if not len(rows):
            continue
        key = classes(lo_, ls, d)[rows] * np.int64(n + 1) + classes(ro, rs, k + side - d)[rows]
        by = np.argsort(key, kind="stable")
        again = rows[by[1:][key[by[1:]] == key[by[:-1]]]]
        least[again] = np.minimum(least[again], d)
        most[again] = d
    return least, most


def own_seeds(length: int, k: int):
    """One owner: the spans that earlier strings cover, and the strings that occur twice, for each block."""
    side = length - k

    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return t.select(["kind", "block", "blob"])
        strings, t = t.filter(pc.equal(t["kind"], 1)), t.filter(pc.equal(t["kind"], 0))
        rows = [(1, *x) for x in repeated(strings, len(strings))] if len(strings) else []
        if not len(t):
            return to_blocks(rows)
        blocks, blobs = t["block"].to_numpy(), t["blob"].to_pylist()
        *cols, around = unpack_all(blobs, *SEED, (np.uint8, 2 * side + k))
        block = np.repeat(blocks, [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs])
        h, doc, row, pos, left, right = cols
        order = np.lexsort((pos, block, row, doc, h))
        order = order[(left[order] + right[order]) >= side]
        h = h[order]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(h)])
        order = order[np.repeat(size > 1, size)]
        _, group = np.unique(h[np.repeat(size > 1, size)], return_inverse=True)
        out = []
        ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(group) else np.zeros(0, np.int64)
        at = 0
        while at < len(group):
            to = int(ends[max(np.searchsorted(ends, at + ROWS, "right") - 1, np.searchsorted(ends, at, "right"))])
            i = order[at:to]
            least, most = covered(group[at:to], left[i], right[i], around[i], k, side)
            hit = np.flatnonzero(most >= 0)
            i = i[hit]
            out.append((block[i], row[i], (pos[i] - most[hit]).astype(np.int32), (pos[i] - least[hit] + length).astype(np.int32)))
            at = to
        block, row, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return to_blocks(rows + [(0, *x) for x in by_bucket(block, row, lo, hi)])

    return run


def cut_spans(keep_text: bool, carry: list[str]):
    """A block's documents without their spans."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        _, data, offsets, place = sorted_docs(docs)
        gone = np.zeros(len(data) + 1, np.int32)
        row, lo, hi = unpack_all(spans["blob"].to_pylist(), *SPAN)
        np.add.at(gone, offsets[row] + lo, 1)
        np.add.at(gone, offsets[row] + hi, -1)
        gone = np.cumsum(gone)[:-1] > 0
        begins = gone & ~np.r_[False, gone[:-1]]
        begins[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
        total, runs = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
        digests, texts = [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            kept = data[a:b][~gone[a:b]].tobytes() if total[a] < total[b] else data[a:b].tobytes()
            digests.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                texts.append(kept.decode("utf-8", "ignore"))
        same = docs.select(["doc_id", *carry]).take(pa.array(place))
        out = {"doc_id": same["doc_id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(total[offsets[1:]] - total[offsets[:-1]]), "n_spans": pa.array(runs[offsets[1:]] - runs[offsets[:-1]]), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(texts, pa.string())} if keep_text else {}) | {c: same[c] for c in carry})

    return run


def drop_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Remove from ``docs(doc_id, text, ...)`` each byte of a ``length``-byte string that also starts earlier.

    Earlier means in a document with a smaller id, or earlier in the same one; strings
    are judged on the input and never cross documents. The text is shuffled once, to
    blocks of some ``block_bytes``; later steps reuse that exchange. Between blocks and
    owners go packed arrays: first each block's distinct seed hashes, then, for seeds
    that occur twice, the bytes around them. A passage that many documents share leaves
    each block once. A seed that occurs more than ``hot`` times in varied surroundings is
    split: each string that contains it has its own owner, and only strings that occur
    twice are sent whole, the first of each block.

    Result per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``keep_text`` the remaining text as ``kept``: a character that lost some of its bytes
    goes whole there. Null text counts as empty; a null
    doc_id stands before all others; rows that share a doc_id count as different
    documents, in an order of their own. Columns named in ``carry`` come along unchanged;
    others are not read.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = block_count(docs.select(data.alias("text")), block_bytes)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        data.cast("binary").alias("data"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(data)), F.lit(n)).cast("int").alias("block"),
        *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)),
    )
    carried = [f"carried_{i}" for i in range(len(carry))]
    by_block = by_number(rows, "block")
    found = by_block.applyInArrow(find_seeds(length, n), TO_OWNERS)
    replies = by_number(found, "bucket").applyInArrow(repeated_seeds(hot), TO_BLOCKS)
    around = by_block.cogroup(by_number(replies, "block")).applyInArrow(around_seeds(length, n), TO_OWNERS)
    spans = by_number(around, "bucket").applyInArrow(own_seeds(length, seed_size(length)), TO_BLOCKS)
    strings = by_block.cogroup(by_number(spans, "block")).applyInArrow(around_strings(length, n), TO_OWNERS)
    spans = by_number(strings, "bucket").applyInArrow(own_seeds(length, length), TO_BLOCKS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    out = by_block.cogroup(by_number(spans, "block")).applyInArrow(cut_spans(keep_text, carried), schema)
    return out.withColumnsRenamed(dict(zip(carried, carry, strict=True)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 99)) AS p, unnest(list_transform(range(n - 99), lambda p: md5(substring(h, 2 * p + 1, 200)))) AS s FROM d WHERE n >= 100),
again AS (SELECT doc_id, p, p AS q FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
b AS (SELECT doc_id, unnest(range(n)) AS p, unnest(regexp_extract_all(h, '..')) AS x FROM d),
m AS (SELECT doc_id, p, x, coalesce(max(q) OVER (PARTITION BY doc_id ORDER BY p) >= p - 99, false) AS gone FROM b LEFT JOIN again USING (doc_id, p)),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM m),
g AS (SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS r, sum(CASE WHEN begins THEN 1 ELSE 0 END) AS k, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS x FROM s GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
