"""Exact deduplication by Patricia-trie owners."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.session import table

#: Bytes that one task's trie holds before it writes subtrees out.
TRIE_BYTES = 192 << 20
#: Bytes of different texts among which a task merges copies before the shuffle.
HELD_BYTES = 32 << 20
#: Bytes that a node takes beside its label: itself, its dictionary of children and what ends there.
NODE_BYTES = 500


class Node:
    """A node of the trie: the bytes on the edge that leads to it, its children by first byte, what ends here, and the file of a subtree that was written out."""

    __slots__ = ("label", "children", "end", "file")

    def __init__(self, label: bytes, children: dict | None = None, end: list | None = None, file=None):
        self.label, self.children, self.end, self.file = label, {} if children is None else children, end, file


class Written:
    """Texts of subtrees in files. When a subtree is written out that holds written ones, their files join its own."""

    def __init__(self):
        self.parts, self.into = [tempfile.TemporaryFile(prefix="subtree-")], None

    def whole(self) -> Written:
        found = self
        while found.into is not None:
            found = found.into
        return found

    def put(self, row: tuple) -> None:
        pickle.dump(row, self.whole().parts[0])

    def join(self, other: Written) -> None:
        other = other.whole()
        if other is not self:
            self.parts += other.parts
            other.parts, other.into = [], self

    def read(self) -> Iterator[tuple]:
        for f in self.parts:
            f.seek(0)
            while True:
                try:
                    row = pickle.load(f)
                except EOFError:
                    break
                yield row
            f.close()


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTrie:
    """A compressed radix trie over whole byte strings.

    A terminal node holds [best id, count, digest]; the best id is the largest. Beyond
    ``budget`` bytes, nodes included, subtrees are written to a file until half of the
    trie is free. A written subtree leaves a node of one byte, and what comes later for
    it is appended to its file. ``items`` makes a trie of each file in turn, which may
    write subtrees out again.
    """

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.held, self.most, self.files = Node(b""), budget, 0, budget, []

    def add(self, key: bytes, best: int | None, count: int, digest: bytes) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], None, [best, count, digest])
                self.held += len(key) - at + NODE_BYTES
                if self.held > self.most:
                    self.spill()
                return
            if child.file is not None:
                child.file.put((key, best, count, digest))
                return
            step = len(child.label)
            if key.startswith(child.label, at):
                node, at = child, at + step
                continue
            n = shared_prefix(child.label, key[at : at + step])
            middle = Node(child.label[:n], {child.label[n]: child})
            child.label = child.label[n:]
            node.children[key[at]] = middle
            node, at = middle, at + n
            self.held += NODE_BYTES
        if node.end is None:
            node.end = [best, count, digest]
            return
        if node.end[2] != digest:
            raise ValueError("one text came with two digests")
        if best is not None and (node.end[0] is None or best > node.end[0]):
            node.end[0] = best
        node.end[1] += count

    def spill(self) -> None:
        """Write subtrees below the shared prefix to a file until half of the trie is free.

        The way down follows the child that holds more than half; of the node where it
        ends, the heaviest children go, but never all texts of the trie.
        """
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.children.values())
        weight = {}
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE_BYTES + sum(weight[id(c)] for c in node.children.values())
        total = weight[id(self.root)]
        node = self.root
        while True:
            written = [c for c in node.children.values() if c.file is None]
            heavy = max(written, key=lambda c: weight[id(c)], default=None)
            if heavy is None or 2 * weight[id(heavy)] <= total or not (heavy.children or len(written) == 1 and node.end is None):
                break
            node = heavy
        written.sort(key=lambda c: -weight[id(c)])
        lone = len(written) == 1 and node.end is None or not written
        if lone:  # one text alone is over the budget, or all else is written out
            self.held, self.most = total, total + self.budget
            return
        out, freed, gone = Written(), 0, 0
        before = next(key for x, key in nodes(self.root) if x is node)
        for c in written:
            if 2 * freed >= total or gone and gone == len(written) - 1 and node.end is None:
                break
            for x, key in nodes(c, before):
                if x.file is not None:
                    out.join(x.file)
                elif x.end is not None:
                    out.put((key, *x.end))
            node.children[c.label[0]] = Node(c.label[:1], file=out)
            freed += weight[id(c)]
            gone += 1
        self.files.append(out)
        self.held = total - freed + gone * NODE_BYTES
        self.most = max(self.budget, self.held + self.budget // 2)

    def items(self) -> Iterator[tuple[bytes, list]]:
        """Every text with what ends there: of this trie, then of a trie for each file."""
        trie, files = self, []
        while True:
            yield from ((key, x.end) for x, key in nodes(trie.root) if x.end is not None)
            files += [f for f in trie.files if f.into is None]
            trie.root, trie.files = Node(b""), []
            if not files:
                return
            trie = RadixTrie(self.budget)
            for row in files.pop().read():
                trie.add(*row)


def nodes(root: Node, before: bytes = b"") -> Iterator[tuple[Node, bytes]]:
    """Every node of a trie, or of a subtree below ``before``, with the bytes that lead there."""
    todo = [(root, before)]
    while todo:
        node, before = todo.pop()
        key = before + node.label
        yield node, key
        todo.extend((x, key) for x in node.children.values())


RESULT = "digest binary, n_bytes long, keep_id long, group_size long"
LOCAL = "n_bytes long, digest binary, data binary, keep_id long, rows long"


def text_rows(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
    """Held texts as rows, some 4 MB at a time."""
    rows, size = [], 0
    for text, (best, count) in held.items():
        rows.append((len(text), hashlib.sha256(text).digest(), text, best, count))
        size += len(text) + 100
        if size > 4 << 20:
            yield batch_of(rows, LOCAL)
            rows, size = [], 0
    if rows:
        yield batch_of(rows, LOCAL)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def local_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts with their largest id and count: copies merge among some 32 MB of different texts before the shuffle."""
    held: dict[bytes, list] = {}
    size = 0
    for b in batches:
        for best, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = x.as_buffer().to_pybytes()
            have = held.get(text)
            if have is None:
                held[text] = [best, 1]
                size += len(text) + 200
            else:
                have[1] += 1
                if best is not None and (have[0] is None or best > have[0]):
                    have[0] = best
        if size > HELD_BYTES:
            yield from text_rows(held)
            held, size = {}, 0
    yield from text_rows(held)


def own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's owner: every text goes into the trie whole; each terminal gives a row."""
    trie = RadixTrie()
    for b in batches:
        for digest, text, best, rows in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
            trie.add(text, best, rows, digest)
    seen = []
    for some in batched(trie.items(), 10_000):
        # rows are joined back by the digest, so it must stand for one text; half of it is kept to tell
        seen.append(np.frombuffer(b"".join(digest[:16] for _, (_, _, digest) in some), np.dtype("V16")))
        yield batch_of([(digest, len(key), best, rows) for key, (best, rows, digest) in some], RESULT)
    marks = np.sort(np.concatenate(seen).view(">u8").reshape(-1, 2).view("u8,u8").ravel(), order=["f0", "f1"]) if seen else []
    if len(marks) > 1 and (marks[1:] == marks[:-1]).any():
        raise ValueError("two texts share a digest")


def text_groups(docs: DataFrame) -> DataFrame:
    """(digest, n_bytes, keep_id, group_size) for each distinct text of ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    texts = rows.mapInArrow(local_texts, LOCAL)
    return texts.repartition("n_bytes", "digest").mapInArrow(own_texts, RESULT)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Group the rows of ``docs(doc_id, text, ...)`` whose texts are the same bytes; the largest doc_id stays.

    Each task first merges its own copies, so a text that a third of all rows hold
    reaches its owner once for some 32 MB that a task reads. Owners are partitions by (length, SHA-256); each
    inserts whole byte strings into a compressed radix trie, so texts that share a hash
    stay apart (a digest that stands for two texts raises an error, since rows are
    joined back by it). The join back moves 48 bytes a row and adaptive execution
    splits it where a group is large.

    Result: doc_id, keep_id, group_size, kept, text_sha256, one row per input row.
    Null text counts as empty; null doc_id loses to any other id. Of rows that repeat
    (doc_id, text), all have kept = true when their id is the keeper. Columns beside
    doc_id and text are not read. No rows give no rows.
    """
    groups = text_groups(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)).alias("digest"))
    out = rows.join(groups, "digest")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_each_text(docs: DataFrame) -> DataFrame:
    """The kept rows of ``exact_dedup`` with all their columns; of rows that repeat id and text, one.

    Rows meet their group's keeper by (doc_id, digest), which no large group shares.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    kept = text_groups(docs).select(F.col("keep_id").alias("_keep_id"), F.col("digest").alias("_keep_digest"))
    rows = docs.withColumn("_digest", digest)
    rows = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept["_keep_id"]) & (rows["_digest"] == kept["_keep_digest"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_digest"]).drop("_digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
