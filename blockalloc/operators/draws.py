"""Random draws for whole arrays: a counter-based generator, and places in a sequential one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of Philox 4x64: the multipliers, and what is added to the key after each round.
PHILOX_TIMES = (np.uint64(0xD2E7470EE14C6C93), np.uint64(0xCA5A826395121157))
PHILOX_ADD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBB67AE8584CAA73B))
ROUNDS = 10
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def high_product(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """Upper 64 bits of 64 x 64 bit products."""
    a0, a1, b0, b1 = a & LOW, a >> HALF, b & LOW, b >> HALF
    low, mid, other = a0 * b0, a1 * b0, a0 * b1
    carry = (low >> HALF) + (mid & LOW) + (other & LOW)
    return a1 * b1 + (mid >> HALF) + (other >> HALF) + (carry >> HALF)


def philox(counter: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Four words for each counter of four words, [n, 4], under keys of two words, [n, 2] or [2].

    The words of a counter don't depend on any other, so draws can be made for any block of
    any frame by itself, all of a batch at once.
    """
    c = [counter[:, i].astype(np.uint64) for i in range(4)]
    k = [np.broadcast_to(np.asarray(key, np.uint64)[..., i], len(counter)).copy() for i in range(2)]
    for r in range(ROUNDS):
        if r:
            k = [k[i] + PHILOX_ADD[i] for i in range(2)]
        high = [high_product(c[2 * i], PHILOX_TIMES[i]) for i in range(2)]
        low = [c[2 * i] * PHILOX_TIMES[i] for i in range(2)]
        c = [high[1] ^ c[1] ^ k[0], low[1], high[0] ^ c[3] ^ k[1], low[0]]
    return np.stack(c, axis=1)


def uniforms(words: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the upper 52 bits of words: never 0, so that they have logarithms."""
    return ((words >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def normals(counter: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Four standard normals for each counter, by the polar form of two pairs of uniforms (Box and Muller)."""
    u = uniforms(philox(counter, key))
    radius, angle = np.sqrt(-2 * np.log(u[:, 0::2])), 2 * np.pi * u[:, 1::2]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2).reshape(len(u), 4)


def streams(n: int, *words: np.ndarray) -> np.ndarray:
    """Counters [m * k, 4] of the k = ceil(n / 4) steps of m streams that three words name; a stream's steps are counted from 1."""
    k = -(-n // 4)
    named = np.stack([np.asarray(w, np.int64).view(np.uint64) for w in words], axis=1)
    steps = np.tile(np.arange(1, k + 1, dtype=np.uint64), len(named))
    return np.concatenate([steps[:, None], np.repeat(named, k, axis=0)], axis=1)


def stream_normals(n: int, key: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """[m, n] normals of m streams; ``key`` is one for all, [2], or one a stream, [m, 2]."""
    k = -(-n // 4)
    key = np.asarray(key, np.uint64)
    return normals(streams(n, *words), np.repeat(key, k, axis=0) if key.ndim > 1 else key).reshape(-1, 4 * k)[:, :n]


def named_keys(seed: int, names: Iterable[str]) -> np.ndarray:
    """A key of two words for each name, from a SHA-256 over seed and name; each different name is hashed once."""
    known: dict[str, np.ndarray] = {}
    rows = []
    for name in names:
        if name not in known:
            known[name] = np.frombuffer(hashlib.sha256(f"{seed}|{name}".encode()).digest()[:16], "<u8")
        rows.append(known[name])
    return np.array(rows, np.uint64).reshape(-1, 2)


def random_frames(seed: int, first: int, frames: int, cells: int) -> np.ndarray:
    """Frames first, first + 1, ... of the single-precision uniforms that one generator draws for all frames in order.

    A single-precision draw takes half a word, the lower half first, so the place of any frame in the stream
    is known and the generator jumps there; no frame waits for those before it.
    """
    start = first * cells
    source = np.random.PCG64(seed).advance(start // 2)
    skip = start % 2
    return np.random.Generator(source).random(skip + frames * cells, dtype=np.float32)[skip:].reshape(frames, cells)


#: Fixed value of PCG64: what a step multiplies the state by.
PCG_TIMES = 0x2360ED051FC65DA44385DF649FCCF645
#: Words of a chunk of a sequential stream.
CHUNK = 4096


def normals_of_chunk(seed: int, chunk: int, skip: int, size: int = CHUNK) -> tuple[int, int]:
    """How many standard normals of a generator begin in a chunk of its words, from its word ``skip`` on, and how many words the last of them takes from the next chunk.

    Normals are drawn by rejection, so each takes one word or more; which ones is seen from
    the generator's state, whose steps through the chunk are known beforehand.
    """
    source = np.random.PCG64(seed).advance(chunk * size + skip)
    draw = np.random.Generator(source).standard_normal
    inside = source.state["state"]
    state, inc, at = inside["state"], inside["inc"], {}
    for word in range(skip, 2 * size):
        at[state] = word
        state = (state * PCG_TIMES + inc) % 2**128
    n, word = 0, skip
    while word < size:
        many = (size - word) // 2 if size - word > 64 else 1  # half as many normals as words don't reach the end
        before = source.state
        draw(many)
        after = at.get(source.state["state"]["state"], 2 * size)
        if many > 1 and after >= size:  # all but impossible; then one at a time
            source.state, many = before, 1
            draw(1)
            after = at[source.state["state"]["state"]]
        n, word = n + many, after
    return n, word - size


def stream_places(asked: DataFrame, seed_of: Callable[[str], int], size: int = CHUNK) -> DataFrame:
    """(video_id, bucket, word, drop): where a bucket's normals begin in the stream that one generator a video draws for its buckets in order.

    ``asked(video_id, bucket, draws)`` tells how many normals each bucket takes. A stream is cut
    into chunks of words, which count their normals side by side, as if the one before ended
    at its border. Where its last normal reached over, the next chunk counts again from there,
    until all agree; sums over the chunks then tell which chunk a normal is in. A bucket's
    generator jumps to ``word`` and drops ``drop`` normals, fewer than a chunk has.
    """
    totals = asked.groupBy("video_id").agg(F.sum("draws").alias("total")).where("total > 0")
    many = F.floor(F.col("total") * 1.05 / size).cast("long") + 2
    chunks = totals.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), many)).alias("chunk"), F.lit(0).cast("long").alias("skip"))
    schema = "video_id string, chunk long, skip long, n long, over long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            video, chunk, skip = (b.column(i).to_pylist() for i in range(3))
            found = [normals_of_chunk(seed_of(v), c, s, size) for v, c, s in zip(video, chunk, skip, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array([f[i] for f in found], pa.int64()) for i in range(2))], ["video_id", "chunk", "skip", "n", "over"])

    held = chunks.repartition("video_id", "chunk").mapInArrow(run, schema).checkpoint()
    while True:
        last = held.select("video_id", (F.col("chunk") + 1).alias("chunk"), F.col("over").alias("wanted"))
        wrong = held.join(last, ["video_id", "chunk"]).where("skip <> wanted").select("video_id", "chunk", F.col("wanted").alias("skip")).checkpoint()
        if wrong.isEmpty():
            break
        held = held.join(wrong.select("video_id", "chunk"), ["video_id", "chunk"], "left_anti").unionByName(wrong.repartition("video_id", "chunk").mapInArrow(run, schema)).checkpoint()
    earlier = Window.partitionBy("video_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for some thousand normals
    lies = held.select(F.col("video_id").alias("_v"), "chunk", "skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"), "n")
    before = Window.partitionBy("video_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = asked.where("draws > 0").select("video_id", "bucket", F.coalesce(F.sum("draws").over(before), F.lit(0)).alias("_at"))
    inside = (F.col("video_id") == F.col("_v")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_first") + F.col("n"))
    return starts.join(lies, inside).select(F.col("video_id").alias("video_id"), F.col("bucket").alias("bucket"), (F.col("chunk") * size + F.col("skip")).alias("word"), (F.col("_at") - F.col("_first")).alias("drop"))


def normals_from(seed: int, word: int, drop: int, n: int) -> np.ndarray:
    """The n normals of a sequential stream that follow ``drop`` others after a word."""
    return np.random.Generator(np.random.PCG64(seed).advance(word)).standard_normal(drop + n)[drop:]
