"""Cross-entropy difference between matched n-gram models."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from blockalloc.llm.packed import block_count, by_number
from blockalloc.llm.tokens import strings
from blockalloc.session import table

WORD = re.compile(r"\w+|[^\w\s]")
#: Bytes of text in a block of documents, and so about what an owner of counts holds.
BLOCK_BYTES = 8 << 20
#: How many pairs' worth of trust a word gives to the model without context.
TRUST = 4.0
#: Documents that are split into words together.
TOGETHER = 500
COUNTS = "bucket int, block int, tokens long, inside long, members binary, blob binary"
SUMS = "block int, bucket int, words long, tokens long, inside long, members binary, blob binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths as one byte string, compressed by byte planes."""
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], np.int64).tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def loosen(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays again."""
    sizes, out, at = np.frombuffer(blob, np.int64, len(kinds)), [], 0
    width = [np.dtype(k).itemsize for k in kinds]
    body = np.frombuffer(pa.Codec("zstd").decompress(blob[8 * len(kinds) :], int(sizes @ width), asbytes=True), np.uint8)
    for n, w, kind in zip(sizes.tolist(), width, kinds, strict=True):
        out.append(np.ascontiguousarray(body[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Own(NamedTuple):
    """A document's different pairs as columns."""

    doc: np.ndarray
    kind: np.ndarray
    before: np.ndarray
    word: np.ndarray
    n_pair: np.ndarray
    n_before: np.ndarray
    n_word: np.ndarray


class Block:
    """A block of documents: their words by number, and the keys of its words, contexts and pairs.

    Words count from 1; 0 stands before a text's first word. ``pair`` is each token's
    place among ``kinds``, the different pairs (word before, word).
    """

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        known: dict[str, int] = {}
        sizes, words, some = [], [], []

        def add() -> None:
            code, kinds = pd.factorize(np.array([w for d in some for w in d], object))
            words.append(np.array([known.setdefault(k, len(known) + 1) for k in kinds], np.int64)[code])
            some.clear()

        for t in strings(texts):
            some.append(WORD.findall(t.lower()))
            sizes.append(len(some[-1]))
            if len(some) == TOGETHER:
                add()
        if some:
            add()
        self.sizes = np.array(sizes, np.int64)
        tokens = np.concatenate(words) if words else np.zeros(0, np.int64)
        before = np.r_[0, tokens[:-1]] if len(tokens) else tokens
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = 0
        hashes = [xxh3_128_intdigest(w.encode("utf-8", "surrogatepass")) for w in known]
        self.names = np.array([0, *(h & (2**64 - 1) for h in hashes)], np.uint64)
        more = np.array([0, *(h >> 64 for h in hashes)], np.uint64)
        self.pair, self.kinds = pd.factorize(before * len(self.names) + tokens)
        key, extra = self.keys(self.names), self.keys(more).astype(np.uint16) >> np.uint16(1)
        extra[: len(self.names) - 1] |= np.uint16(1 << 15)  # marks words, so that owners can tell how many differ
        self.order = np.argsort(key, kind="stable")
        self.key, self.extra = key[self.order], extra[self.order]

    def keys(self, names: np.ndarray) -> np.ndarray:
        """Keys of all words, all contexts and all pairs, from 64 bits a word."""
        before, word = self.kinds // len(names), self.kinds % len(names)
        one, context = np.array([[0xA0761D6478BD642F], [0xE7037ED1A0B428DB]], np.uint64)
        return np.concatenate([mix(one, names[1:]), mix(names, context), mix(names[before], names[word])])

    def counts(self, some: np.ndarray) -> np.ndarray:
        """How often each key, in order, occurs in some of the documents."""
        here = np.bincount(self.pair[np.repeat(some, self.sizes)], minlength=len(self.kinds))
        n = len(self.names)
        one, context = np.bincount(self.kinds % n, here, n)[1:], np.bincount(self.kinds // n, here, n)
        return np.concatenate([one, context, here]).astype(np.int64)[self.order]

    def own_counts(self) -> Own:
        """Each document's different pairs, and how often it has the pair, its word and its context."""
        n, doc = max(1, len(self.names)), np.repeat(np.arange(len(self.sizes)), self.sizes)
        at, both = pd.factorize(doc * max(1, len(self.kinds)) + self.pair)
        n_pair = np.bincount(at, minlength=len(both))
        doc, kind = both // max(1, len(self.kinds)), both % max(1, len(self.kinds))
        before, word = self.kinds[kind] // n, self.kinds[kind] % n

        def total(part: np.ndarray) -> np.ndarray:
            at, _ = pd.factorize(doc * n + part)
            return np.bincount(at, n_pair)[at]

        return Own(doc, kind, before, word, n_pair, total(before), total(word))

    def cuts(self, buckets: int) -> np.ndarray:
        """Where the keys of each part of the key range begin."""
        return np.searchsorted(((self.key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def count_block(buckets: int):
    """A block's keys with their counts in all its documents and in those of the target, dealt to the owners of the key range."""

    def run(docs: pa.Table, target: pa.Table) -> pa.Table:
        out = []
        if len(docs):
            block = Block(docs["text"])
            wanted = set(zip(target["id"].to_pylist(), target["hash"].to_pylist(), strict=True))
            inside = np.fromiter((x in wanted for x in zip(docs["doc_id"].to_pylist(), docs["text_hash"].to_pylist(), strict=True)), bool, len(docs))
            everything, own = block.counts(np.ones(len(docs), bool)), block.counts(inside)
            cuts, name = block.cuts(buckets), docs["block"][0].as_py()
            total, mine = int(block.sizes.sum()), int(block.sizes[inside].sum())  # on the first row alone, to be added up
            members = np.array(sorted(wanted), np.int64).tobytes()
            for b in np.flatnonzero(np.diff(cuts) > 0).tolist():
                s = slice(cuts[b], cuts[b + 1])
                out.append((b, name, total, mine, members, squeeze(np.diff(block.key[s], prepend=np.uint64(0)), block.extra[s], everything[s], own[s])))
                total, mine, members = 0, 0, None
        return rows_of(out, COUNTS)

    return run


def rows_of(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for c, (n, k) in zip(cols, fields, strict=True)})


def add_up(t: pa.Table) -> pa.Table:
    """A bucket's sums over all blocks, for each block in the order of its keys, with how many words the bucket has."""
    parts = [loosen(b, np.uint64, np.uint16, np.int64, np.int64) for b in t["blob"].to_pylist()]
    steps, extra, *counts = (list(x) for x in zip(*parts, strict=True))
    ends = np.cumsum([len(e) for e in extra])[:-1]
    key, extra = np.concatenate([np.cumsum(s, dtype=np.uint64) for s in steps]), np.concatenate(extra)
    order = np.lexsort((extra, key))
    key, extra = key[order], extra[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])][: len(key)]
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(new) - 1
    sums = []
    for c in counts:
        of_key = np.zeros(int(new.sum()), np.int64)
        np.add.at(of_key, group, np.concatenate(c))
        sums.append(np.split(of_key[group], ends))
    words, bucket = int((extra[new] >> np.uint16(15)).sum()), t["bucket"][0].as_py()
    blobs = [squeeze(a, i) for a, i in zip(*sums, strict=True)]
    heads = zip(*(t[c].to_pylist() for c in ("block", "tokens", "inside", "members")), strict=True)
    return rows_of([(block, bucket, 0 if i else words, tokens, inside, members, blob) for i, ((block, tokens, inside, members), blob) in enumerate(zip(heads, blobs, strict=True))], SUMS)


def score_block(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """Losses of a block's documents from the sums of its keys, each without what the document itself added."""
    cols = [np.zeros(0, np.int64), *[np.zeros(0)] * 3]
    if len(docs):
        block = Block(docs["text"])
        totals, sums = sums["totals"][0].as_py(), sums.sort_by("bucket")
        found = [np.concatenate(x) for x in zip(*(loosen(b, np.int64, np.int64) for b in sums["blob"].to_pylist()), strict=True)]
        if len(found[0]) != len(block.key):
            raise RuntimeError("a block's sums are not those of its documents")
        wanted = {tuple(x) for m in sums["members"].to_pylist() if m for x in np.frombuffer(m, np.int64).reshape(-1, 2).tolist()}
        inside = np.fromiter((x in wanted for x in zip(docs["doc_id"].to_pylist(), docs["text_hash"].to_pylist(), strict=True)), bool, len(docs))
        own = block.own_counts()
        size = block.sizes[own.doc]
        mean = []
        for tokens, here, counted in zip((totals["tokens"], totals["inside"]), found, (np.ones(len(docs)), inside.astype(float)), strict=True):
            counts = np.empty(len(here))
            counts[block.order] = here
            n = len(block.names)
            one, context, pair = np.split(counts, [n - 1, 2 * n - 1])
            # what a document itself added is taken off before it is scored
            off = counted[own.doc]
            single = (one[own.word - 1] - off * own.n_word + 1) / (tokens - off * size + totals["words"])
            loss = -np.log((pair[own.kind] - off * own.n_pair + TRUST * single) / (context[own.before] - off * own.n_before + TRUST))
            mean.append(np.bincount(own.doc, loss * own.n_pair, len(docs)) / np.maximum(block.sizes, 1))
        cols = [block.sizes, mean[1], mean[0], mean[0] - mean[1]]
    return pa.table({"doc_id": docs["doc_id"]} | dict(zip(("n_tokens", "target_loss", "background_loss", "score"), map(pa.array, cols), strict=True)))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score ``docs(doc_id, text, ...)`` by how much likelier the target's model finds each token than the background's.

    The background is all documents, the target those with an id in ``target_ids``.
    Both are word-pair models over one vocabulary and with one smoothing. Every word,
    context and pair of the input has its own count. Texts are dealt once, by a hash of
    id and text, to blocks of about ``block_bytes``; each block counts its own keys and
    sends each different one once to the owner of its part of the key range, owners add
    up over all blocks and send the sums back, and each block scores its documents by
    them. A hot word so costs its owner one entry a block, and nothing but three totals
    passes through the driver. Which documents belong to the target is found
    by a join of ids without texts. A document is scored by models that never saw it: what
    it added itself is taken off the counts and totals of both, so that a target document
    and one like it that nobody marked score alike. Keys are 79 bits of hashes: among 2 * 10^9 different
    keys the chance that any two agree is about 1 in 300,000. The number of blocks and
    of owners follows the bytes of text, so memory doesn't grow with the input.

    Result per row: doc_id, n_tokens, target_loss and background_loss (mean natural
    logarithms a token), score = background_loss - target_loss. Null or empty text has
    no tokens and scores 0. Rows without doc_id belong to the background only. Repeated
    rows each count and get a row; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = block_count(texts, block_bytes)
    block = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n)).cast("int").alias("block")
    by_block = by_number(texts.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text", "text_hash", block), "block")
    ids = target_ids.select(F.col("doc_id").cast("long").alias("id"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    target = by_number(own.join(ids, "id", "left_semi").select("id", "hash", F.pmod(F.xxhash64("id", "hash"), F.lit(n)).cast("int").alias("target_block")), "target_block")
    counted = by_block.cogroup(target).applyInArrow(count_block(n), COUNTS)
    sums = by_number(counted, "bucket").applyInArrow(add_up, SUMS)
    totals = sums.agg(F.struct(*(F.sum(c).alias(c) for c in ("tokens", "inside", "words")))).scalar()
    back = by_number(sums.select("block", "bucket", "members", "blob", totals.alias("totals")), "block")
    return by_block.cogroup(back).applyInArrow(score_block, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)
