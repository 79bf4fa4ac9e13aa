"""Recurrences over a video's frames in order, taken apart into buckets of frames that run side by side.

A video's frames are dealt to buckets by frame number. What a bucket must know of the
frames before it is one carry the size of a frame; how that is found depends on the
recurrence: an affine one composes (``affine_carries``), one that rounds doesn't, but
forgets its start soon enough to be guessed and checked (``settled_carries``). Then every
bucket replays its own frames from its carry (``replay``), so a long video is as many
tasks as it has buckets, and what any one task reads in order is a bucket or the summaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames of a bucket, and frames before it that a guess starts from.
BUCKET, WARM = 256, 16
Step = Callable[[np.ndarray | None, np.ndarray], tuple[np.ndarray, np.ndarray]]
CARRY = "video_id string, bucket long, carry array<double>"


def dealt(frames: DataFrame, column: str, bucket: int, warm: int = 0) -> DataFrame:
    """Frames by bucket, the last ``warm`` of each also in the next one, marked ``early``."""
    b = F.floor(F.col("frame_idx") / bucket)
    own = F.array(F.struct(b.alias("bucket"), F.lit(False).alias("early")))
    if warm:
        own = F.when(F.col("frame_idx") % bucket >= bucket - warm, F.concat(own, F.array(F.struct((b + 1).alias("bucket"), F.lit(True).alias("early"))))).otherwise(own)
    return frames.select("video_id", "frame_idx", "height", "width", column, F.inline(own))


def stacked(t: pa.Table, column: str) -> np.ndarray:
    """The values of equal-sized frames, one row a frame, in order."""
    return t[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)


def rows(kinds: list[tuple[str, pa.DataType]], values: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([v[i] for v in values], kind) for i, (name, kind) in enumerate(kinds)})


VECTOR = pa.list_(pa.float64())


def affine_carries(frames: DataFrame, keep: float, column: str, bucket: int) -> DataFrame:
    """(video_id, bucket, carry) of carry' = keep * carry + (1 - keep) * frame, whose first frame is its first carry.

    A bucket of m frames maps a carry c to keep^m c + b. Buckets work out m and b on their
    own; those summaries, one a bucket, are gone through in order to give each bucket the
    carry it starts with. The carry of a video's first bucket is null.
    """

    def summary(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame_idx")
        b = None
        for v in stacked(t, column):
            b = v if b is None else keep * b + (1 - keep) * v  # as if the bucket's first frame were the video's
        first = stacked(t.slice(0, 1), column)[0]
        return rows([("video_id", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("first", VECTOR), ("b", VECTOR)], [(t["video_id"][0].as_py(), t["bucket"][0].as_py(), len(t), first, b)])

    found = dealt(frames, column, bucket).groupBy("video_id", "bucket").applyInArrow(summary, "video_id string, bucket long, n long, first array<double>, b array<double>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, carry = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["video_id"] != of:
                    of, carry = r["video_id"], None
                out.append((of, r["bucket"], carry))
                b = np.array(r["b"])
                # the bucket began with its first frame in full; what it should have begun with differs by keep times (carry - first)
                carry = b if carry is None else b + keep ** r["n"] * (carry - np.array(r["first"]))
            yield from rows([("video_id", pa.string()), ("bucket", pa.int64()), ("carry", VECTOR)], out).to_batches()

    return found.repartition("video_id").sortWithinPartitions("video_id", "bucket").mapInArrow(scan, CARRY)


def settled_carries(frames: DataFrame, step: Step, column: str, bucket: int, warm: int) -> DataFrame:
    """(video_id, bucket, carry) of a recurrence that forgets its start, whatever its steps round.

    Every bucket first guesses: it runs ``step`` over the ``warm`` frames before it, from
    nothing, and goes on to its end. A guess is right if it equals what the bucket before
    ended with. Buckets whose guess differs run again from there, and so on until all
    agree; as the first bucket of a video has nothing to guess, agreement means that every carry is
    the one a single run in order would have had. Only mismatched buckets run again.
    """
    deal = dealt(frames, column, bucket, warm)

    def run(t: pa.Table, carry: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray | None]:
        start, started = carry, False
        for early, v in zip(t["early"].to_pylist(), stacked(t, column), strict=True):
            if not early and not started:
                start, started = carry, True
            carry, _ = step(carry, v)
        return (start, carry) if started else (None, None)

    kinds = [("video_id", pa.string()), ("bucket", pa.int64()), ("carry", VECTOR), ("ended", VECTOR)]

    def guess(t: pa.Table) -> pa.Table:
        t = t.sort_by("frame_idx")
        start, ended = run(t, None)
        return rows(kinds, [(t["video_id"][0].as_py(), t["bucket"][0].as_py(), start, ended)] if ended is not None else [])

    def again(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.filter(pa.array([not e for e in t["early"].to_pylist()], pa.bool_())).sort_by("frame_idx")
        carry = np.array(known["before"][0].as_py()) if known["before"][0].is_valid else None
        _, ended = run(t, carry)
        return rows(kinds, [(t["video_id"][0].as_py(), t["bucket"][0].as_py(), carry, ended)])

    state = "video_id string, bucket long, carry array<double>, ended array<double>"
    held = deal.groupBy("video_id", "bucket").applyInArrow(guess, state).checkpoint()
    while True:
        # a bucket's predecessor is the one before it that has frames; one row a bucket passes the window
        places = held.select("video_id", "bucket").groupBy("video_id").agg(F.array_sort(F.collect_list("bucket")).alias("all"))
        links = places.select("video_id", F.posexplode("all").alias("i", "bucket"), "all").select("video_id", "bucket", F.when(F.col("i") > 0, F.element_at("all", F.col("i"))).alias("last"))
        ends = held.select(F.col("video_id").alias("v"), F.col("bucket").alias("last"), F.col("ended").alias("before"))
        joined = held.join(links, ["video_id", "bucket"]).join(ends.withColumnRenamed("last", "l"), (F.col("video_id") == F.col("v")) & (F.col("last") == F.col("l")), "left").drop("v", "l")
        wrong = joined.where(~F.col("carry").eqNullSafe(F.col("before"))).select("video_id", "bucket", "before").checkpoint()
        if wrong.isEmpty():
            return held.select("video_id", "bucket", "carry")
        mine = deal.join(wrong.select("video_id", "bucket"), ["video_id", "bucket"], "left_semi")
        redone = mine.groupBy("video_id", "bucket").cogroup(wrong.groupBy("video_id", "bucket")).applyInArrow(again, state)
        held = held.join(wrong.select("video_id", "bucket"), ["video_id", "bucket"], "left_anti").unionByName(redone).checkpoint()


def replay(frames: DataFrame, carries: DataFrame, step: Step, column: str, bucket: int) -> DataFrame:
    """Frames after ``step``, each bucket from its carry."""

    def run(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("frame_idx")
        carry = np.array(known["carry"][0].as_py()) if len(known) and known["carry"][0].is_valid else None
        out = []
        for v in stacked(t, column):
            carry, shown = step(carry, v)
            out.append(shown.astype(np.int32))
        names = ["video_id", "frame_idx", "height", "width"]
        return pa.table([*(t[c] for c in names), pa.array(out, pa.list_(pa.int32()))], [*names, column])

    by = ["video_id", "bucket"]
    schema = f"video_id string, frame_idx int, height int, width int, {column} array<int>"
    return dealt(frames, column, bucket).groupBy(*by).cogroup(carries.groupBy(*by)).applyInArrow(run, schema)
