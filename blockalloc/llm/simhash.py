"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from blockalloc.llm.components import HOT, connected_components, hot_bound, look_up
from blockalloc.llm.packed import by_bucket, components, unpack_all
from blockalloc.session import shuffle_partitions, table

#: BITS[v] are the eight bits of byte value v, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Pairs that one verification step holds at a time.
STEP = 1 << 20
#: Fingerprints with one value of a segment, beyond which its table key is split.
CROWDED = 1 << 14
#: Rows of a bucket, and rows of crowded keys that are dealt on at a time.
BUCKET, SPLIT = 1 << 19, 1 << 14


def fingerprint(data: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of word shingles, each weighing as often as it occurs."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    text = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    h = np.array([xxh64_intdigest(text[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)
    n = len(h)
    # how often each value of each of the eight bytes occurs gives the count of each bit
    spots = h.view(np.uint8).reshape(n, 8).astype(np.int64) + np.arange(0, 2048, 256)
    ones = np.bincount(spots.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * ones.ravel() > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_buffer().to_pybytes(), words) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(fingerprints_of(words), "doc_id long, fp long")


def segments(places: list[int], radius: int) -> list[tuple[np.uint64, np.ndarray]]:
    """Three segments of the given bits: each one's mask, and all differences inside it of at most its radius.

    Three segments with radii r1, r2, r3 find every pair within r1 + r2 + r3 + 2 bits:
    if each distance exceeded its radius, their sum would exceed that.
    """
    spare, out = max(0, radius - 2), []
    for i in range(3):
        own = places[len(places) * i // 3 : len(places) * (i + 1) // 3]
        out.append((np.uint64(sum(1 << p for p in own)), ball(own, spare // 3 + (i < spare % 3))))
    return out


def ball(places: list[int], radius: int) -> np.ndarray:
    """Every mask of at most ``radius`` ones among the given bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << p) for m in masks for p in places}
    return np.array(sorted(masks), np.uint64)


#: First bit and the one after the last of each segment of a whole fingerprint.
SPANS = ((0, 21), (21, 42), (42, 64))


def crowded_keys(prints: DataFrame, radius: int, hot: int) -> list[np.ndarray | None]:
    """For each segment a bitmap of its table keys that may be probed by many fingerprints.

    A key is crowded if its segment has more than ``hot`` fingerprints at that value or
    at another in the ball around it; any other key has at most ``hot`` for each value
    of the ball. The bitmaps have one bit a segment value, 1 MB in all; at most three
    values for every ``hot`` fingerprints come to the driver.
    """
    own = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("value")) for i, (lo, hi) in enumerate(SPANS)]
    counts = prints.select(F.explode(F.array(*own)).alias("s")).groupBy("s.i", "s.value").count()
    found = counts.where(F.col("count") > hot).select("i", "value").toPandas()
    out = []
    for i, ((lo, hi), (_, masks)) in enumerate(zip(SPANS, segments(list(range(64)), radius), strict=True)):
        value = found["value"][found["i"] == i].to_numpy(np.uint64)
        full = np.zeros(1 << hi - lo, bool)
        for m in masks:
            full[value ^ (m >> np.uint64(lo))] = True
        out.append(np.packbits(full, bitorder="little") if len(value) else None)
    return out


def probes_of(radius: int, buckets: int, crowded=None):
    """Table entries and the probes of each fingerprint's balls, dealt to buckets of table keys.

    What falls to a crowded key goes on to the tables of three segments of the remaining
    bits inside it, with their own balls, so that it is dealt by those bits as well.
    ``crowded`` is a broadcast of ``crowded_keys``.
    """
    first = segments(list(range(64)), radius)
    second = [segments([p for p in range(64) if not lo <= p < hi], radius) for lo, hi in SPANS]

    def rows(fp: np.ndarray, full: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        plain = []
        for i, (mask, masks) in enumerate(first):
            at = ((fp & mask)[:, None] ^ masks).ravel()
            who, probe = np.repeat(fp, len(masks)), np.tile(masks != 0, len(fp))
            if full[i] is not None:
                value = (at >> np.uint64(SPANS[i][0])).astype(np.int64)
                hot = (full[i][value >> 3] >> (value & 7).astype(np.uint8)) & 1 > 0
                for some in np.split(np.flatnonzero(hot), range(SPLIT, int(hot.sum()), SPLIT)):
                    for j, (inner, more) in enumerate(second[i]):
                        key = at[some][:, None] | ((who[some] & inner)[:, None] ^ more)
                        yield table_key(3 + 3 * i + j, key.ravel()), np.repeat(who[some], len(more)), (probe[some][:, None] | (more != 0)).ravel()
                at, who, probe = at[~hot], who[~hot], probe[~hot]
            plain.append((table_key(i, at), who, probe))
        yield tuple(np.concatenate(x) for x in zip(*plain, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = crowded.value if crowded else [None] * 3
        for batch in batches:
            for key, fp, probe in rows(batch.column(0).to_numpy().view(np.uint64), full):
                packed = list(by_bucket(((key >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64), key, fp, probe))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in packed], pa.int64()), pa.array([x[1] for x in packed], pa.binary())], ["bucket", "blob"])

    return run


def table_key(number: int, value: np.ndarray) -> np.ndarray:
    """A hash of a table's number and a key in it; where two share one, the whole distance still decides."""
    h = (value + np.uint64((number + 1) * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def flood(fp: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning links of a large group: each reached member looks only at those not yet reached.

    A dense group is reached in a few steps, so it never costs its square.
    """
    left, us, vs = np.arange(len(fp)), [], []
    while len(left):
        front, left = [left[:1]], left[1:]
        while front and len(left):
            for x in front.pop():
                hit = near(fp[left], fp[x], radius)
                if hit.any():
                    found, left = left[hit], left[~hit]
                    us.append(np.full(len(found), x))
                    vs.append(found)
                    front.append(found)
    return us, vs


def links_of(radius: int, dense: int = 1 << 22):
    """Verified links of a bucket, as a star from the smallest member of each local component."""

    def run(t: pa.Table) -> pa.Table:
        key, fp, probe = unpack_all(t["blob"].to_pylist(), np.uint64, np.uint64, np.bool_)
        order = np.lexsort((fp, probe, key))
        key, fp, probe = key[order], fp[order], probe[order]
        uniq, node = np.unique(fp, return_inverse=True)
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        entries = np.add.reduceat((~probe).astype(np.int64), cut)
        us, vs = [], []
        big = entries * size > dense
        for lo, n in zip(cut[big], size[big], strict=True):
            u, v = flood(fp[lo : lo + n], radius)
            us += [node[lo + x] for x in u]
            vs += [node[lo + x] for x in v]
        # small groups: every entry against every row after it, in steps of bounded size
        group = np.repeat(np.arange(len(cut)), size)
        stop = (cut + size)[group]
        rows = np.flatnonzero(~probe & ~big[group])
        many = stop[rows] - rows - 1
        rows, many = rows[many > 0], many[many > 0]
        upto = np.cumsum(many)
        at = 0
        while at < len(rows):
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + STEP, "right")))
            n = many[at:to]
            left = np.repeat(rows[at:to], n)
            right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = near(fp[left], fp[right], radius)
            us.append(node[left[hit]])
            vs.append(node[right[hit]])
            at = to
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        label = components(len(uniq), u, v)
        out = np.flatnonzero(label != np.arange(len(uniq)))
        return pa.table({"a": pa.array(uniq[out].view(np.int64)), "b": pa.array(uniq[label[out]].view(np.int64))})

    return run


def fingerprint_links(prints: DataFrame, radius: int = 4, hot: int = CROWDED) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within ``radius`` bits: spanning links, not all pairs.

    Table keys are dealt to buckets of some ``BUCKET`` rows; keys crowded by more than
    ``hot`` fingerprints are split (``crowded_keys``).
    """
    spark = prints.sparkSession
    tables = sum(len(masks) for _, masks in segments(list(range(64)), radius))
    buckets = max(4 * shuffle_partitions(spark), -(-prints.count() * tables // BUCKET))
    crowded = spark.sparkContext.broadcast(crowded_keys(prints, radius, hot))
    probes = prints.select("fp").mapInArrow(probes_of(radius, buckets, crowded), "bucket long, blob binary")
    return probes.groupBy("bucket").applyInArrow(links_of(radius), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, crowded: int = CROWDED, hot: int = HOT) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text, ...)`` by SimHash.

    Fingerprints link at ``radius`` or fewer differing bits; a group is all that links
    reach. Equal fingerprints merge first (smallest id each), so exact copies cost
    nothing further. Multi-index hashing: each distinct fingerprint enters the tables
    of its three segments and probes a small Hamming ball of each; matches are held to
    the whole distance. A bucket returns spanning links only; a crowded table key is
    split by the remaining bits, and flooded where many still meet. The smallest id
    reaches the members of a large group, and the rows of a frequent fingerprint, by
    broadcast (``look_up``); fingerprints without links join nothing.

    Result: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    group). Null text counts as empty (fingerprint zero, linked like any other); rows
    with a null doc_id take part and never name a group unless it has no other id.
    Repeated rows each get a row; ties cannot occur. Other columns are not read.
    """
    prints = fingerprints(docs, words).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).checkpoint()
    hot = hot_bound(prints.count(), hot)
    found = connected_components(fingerprint_links(distinct, radius, crowded), hot=hot)
    linked = found.join(distinct, found["node"] == distinct["fp"]).select("fp", "low", "component")
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    of = look_up(linked.select("fp", "component"), least, "component", "component_id", "fp", hot)
    ids = distinct.join(of.withColumn("linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"), "n")
    rows = look_up(prints.withColumn("spread", F.monotonically_increasing_id()), ids, "fp", "component_id", "spread", hot)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
