"""Token ids of whole texts, byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.session import table

#: Pieces of text whose ids a worker remembers; past that it starts anew, with the same ids.
REMEMBERED = 800_000
#: Fewer pieces of like length than this are merged one by one, more of them side by side.
ALONE = 12


class Remembered:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, by remembering those of their parts.

    A space between two characters that are no white space always begins a token of
    the byte-level patterns, so the text falls apart there and each part is encoded
    once. ``encode`` gives the ids of a list of parts.
    """

    def __init__(self, encode, after_space=None, pieces: dict | None = None):
        # known: of parts after a space, which is left off the key; no other part is kept
        self.encode, self.known = encode, {}
        self.after_space = after_space or (lambda parts: encode([f" {p}" for p in parts]))
        self.pieces = pieces if pieces is not None else {}

    def forget(self) -> None:
        """Free what is remembered: workers outlive their tasks and go on to other stages."""
        self.known.clear()
        self.pieces.clear()

    def ids(self, text: str) -> bytes:
        return next(self.ids_of([text]))

    def ids_of(self, texts: Iterable[str], together: int = 256) -> Iterator[bytes]:
        """Ids of each text; what isn't known yet is encoded for many texts at once."""
        for some in batched(texts, together):
            plans, missing, others = [], set(), []
            for text in some:
                first, *parts = text.split(" ")
                found = list(map(self.known.get, parts))
                gaps = [i for i, f in enumerate(found) if f is None] if None in found else []
                new = {parts[i] for i in gaps}
                if parts and (not first or first[-1].isspace()) or not all(new) or any(p[0].isspace() or p[-1].isspace() for p in new):
                    whole = self.parts(text)
                    plans.append((len(others), len(others) + len(whole), None, None, None))
                    others += whole
                    continue
                missing |= new
                plans.append((len(others), len(others) + bool(first), parts, found, gaps))
                if first:
                    others.append(first)
            missing = list(missing)
            got, others = dict(zip(missing, self.after_space(missing), strict=True)), self.encode(others)
            if len(self.known) + len(got) > REMEMBERED:
                self.known.clear()
            self.known.update(got)
            for lo, hi, parts, found, gaps in plans:
                for i in gaps or ():
                    found[i] = got[parts[i]]
                yield b"".join([*others[lo:hi], *(found or ())])

    @staticmethod
    def parts(text: str) -> list[str]:
        """Parts of a text with runs of white space: neighbours stay together where the rule doesn't hold."""
        out, safe = [], False
        for i, p in enumerate(text.split(" ")):
            p = f" {p}" if i else p
            if i and safe and len(p) > 1 and not p[1].isspace():
                out.append(p)
            elif i:
                out[-1] += p
            else:
                out.append(p)
            safe = not p[-1:].isspace() and p != ""
        return out


class PairRanks:
    """What two neighbouring tokens merge into: every split of a token into two tokens, sorted by the pair."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        found = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        a, b, r = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
        order = np.argsort(a << 32 | b)
        self.pair, self.rank = np.r_[(a << 32 | b)[order], np.int64(1) << 62], np.r_[r[order], 0]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

        self.known: dict[int, int] = {}

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank, or -1 where the two don't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], -1)

    def of(self, a: int, b: int) -> int:
        """The same for one pair, remembered."""
        key = a << 32 | b
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[key] = int(self(np.array([a]), np.array([b]))[0])
        return found


def merge_tree(piece: bytes, pairs: PairRanks) -> bytes:
    """Ids of one piece: the segment tree of ``merge_trees`` in flat arrays, for pieces that have no company.

    An update stops climbing where a node keeps its minimum.
    """
    n = len(piece)
    width, none, rank_of = 1 << max(0, n - 1).bit_length(), 1 << 62, pairs.of
    shift, mask = width.bit_length() - 1, width - 1
    first = pairs.byte[np.frombuffer(piece, np.uint8)]
    ranks = pairs(first[:-1], first[1:])
    levels = [np.full(width, none)]
    levels[0][: n - 1] = np.where(ranks >= 0, ranks << shift | np.arange(n - 1), none)
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = array("q", np.concatenate([[none], *levels[::-1]]).astype(np.int64).tobytes())
    ids = array("q", first.astype(np.int64).tobytes())
    after, ahead = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
    while (top := tree[1]) < none:
        i = top & mask
        j = after[i]
        k, h = after[j], ahead[i]
        ids[i], ids[j], after[i] = top >> shift, -1, k
        changed = [(j, none)]
        if k < n:
            ahead[k] = i
            r = rank_of(ids[i], ids[k])
            changed.append((i, r << shift | i if r >= 0 else none))
        else:
            changed.append((i, none))
        if h >= 0:
            r = rank_of(ids[h], ids[i])
            changed.append((h, r << shift | h if r >= 0 else none))
        for at, value in changed:
            at += width
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out = np.frombuffer(ids, np.int64)
    return out[out >= 0].astype("<u4").tobytes()


def merge_trees(pieces: list[bytes], pairs: PairRanks, width: int) -> list[bytes]:
    """Ids of pieces of up to ``width`` bytes (a power of two), all of which merge side by side.

    Each piece has a segment tree over its byte positions. A leaf holds rank * width +
    position of the pair that starts there, so the root is the leftmost least pair; a
    merge updates the leaves of the merged token, of its live neighbour to the left, and
    of the one that is gone, each along its path to the root.
    """
    n, none = len(pieces), np.int64(1) << 62
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    place = np.arange(width)
    ids = np.full((n, width), -1, np.int64)
    ids[place < sizes[:, None]] = pairs.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    after, ahead = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    tree = np.full((n, 2 * width), none)
    row, at = np.nonzero(place < sizes[:, None] - 1)
    rank = pairs(ids[row, at], ids[row, at + 1])
    tree[row, width + at] = np.where(rank >= 0, rank * width + at, none)
    for level in range(width.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    flat = tree.reshape(-1)

    def put(row, at, value):
        node = row * (2 * width) + width + at
        flat[node] = value
        base = row * (2 * width)
        at = width + at
        while at.size and at[0] > 1:
            at = at >> 1
            flat[base + at] = np.minimum(flat[base + 2 * at], flat[base + 2 * at + 1])

    live = np.arange(n)
    while True:
        live = live[tree[live, 1] < none]
        if not len(live):
            break
        top = tree[live, 1]
        i = top % width
        j = after[live, i]
        k = after[live, j]
        ids[live, i], ids[live, j] = top // width, -1
        after[live, i] = k
        more = k < sizes[live]
        ahead[live[more], k[more]] = i[more]
        put(live, j, none)
        rank = np.full(len(live), -1)
        rank[more] = pairs(ids[live[more], i[more]], ids[live[more], k[more]])
        put(live, i, np.where(rank >= 0, rank * width + i, none))
        h = ahead[live, i]
        some = h >= 0
        h, who = h[some], live[some]
        rank = pairs(ids[who, h], ids[who, i[some]])
        put(who, h, np.where(rank >= 0, rank * width + h, none))
    keep = ids >= 0
    raw = ids[keep].astype("<u4").tobytes()
    ends = 4 * np.cumsum(keep.sum(1))
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairRanks) -> list[bytes]:
    """Ids of each piece: itself where it is a token, else merged among pieces of like length, a bounded number at a time."""
    out: list[bytes | None] = [None] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        whole = ranks.get(p)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        else:
            by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
    for width, members in by_width.items():
        if len(members) < ALONE:
            for i in members:
                out[i] = merge_tree(pieces[i], pairs)
            continue
        step = max(ALONE, (1 << 18) // width)
        for lo in range(0, len(members), step):
            some = members[lo : lo + step]
            for i, ids in zip(some, merge_trees([pieces[i] for i in some], pairs, width), strict=True):
                out[i] = ids
    return out


@lru_cache(2)
def read_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by bytes and bytes by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    back = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        back[r] = token
    return ranks, back


@lru_cache(2)
def byte_bpe(path: str, pattern: str) -> Remembered:
    ranks, _ = read_ranks(path)
    pairs, find = PairRanks(ranks), regex.compile(pattern).findall
    known: dict[str, bytes] = {}

    def encode(parts: list[str]) -> list[bytes]:
        cut = list(map(find, parts))
        new = list({m for c in cut for m in c if m not in known})
        got = dict(zip(new, merge_all([m.encode() for m in new], ranks, pairs), strict=True))
        out = [b"".join([known[m] if m in known else got[m] for m in c]) for c in cut]
        if len(known) + len(got) > REMEMBERED:
            known.clear()
        known.update((m, ids) for m, ids in got.items() if len(m) <= 64)
        return out

    return Remembered(encode, pieces=known)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens of a tokenizers file, if its merges are ranked by their ids and it splits texts by the byte-level pattern."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, split = d["model"], d.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or d.get("normalizer") or d.get("post_processor") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocab, byte = model["vocab"], byte_of()
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in d["added_tokens"]):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}, special


@lru_cache(2)
def library_ids(path: str) -> Remembered:
    """Ids of a tokenizers file.

    Where its merges are ranked by their ids, the same merges run in tiktoken, which
    gives the same ids at several times the speed; any other file is left to tokenizers.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = ranks_of(path)
    if not found:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return Remembered(lambda parts: [np.array(e.ids, np.uint32).tobytes() for e in t.encode_batch(parts, add_special_tokens=False)])
    import public_tokenizers
    import tiktoken

    ranks, special = found
    t = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    opens = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
    opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True

    def one(text: str) -> bytes:
        return np.array(t.encode(text, allowed_special="all"), np.uint32).tobytes()

    def after_space(parts: list[str]) -> list[bytes]:
        # each part begins with its only space, so all are encoded in one go and their first ids tell them apart
        if not parts:
            return []
        ids = np.array(t.encode(" " + " ".join(parts), allowed_special="all"), np.uint32)
        at = np.flatnonzero(opens[ids])
        if len(at) != len(parts):
            return [one(f" {p}") for p in parts]
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]

    return Remembered(lambda parts: list(map(one, parts)), after_space)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def strings(column: pa.Array) -> Iterator[str]:
    """Whole texts; bytes that aren't UTF-8 read as U+FFFD."""
    for x in column.cast(pa.binary()):
        yield x.as_buffer().to_pybytes().decode("utf-8", "replace")


def encode_texts(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (_, back) = byte_bpe(path, pattern), read_ranks(path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in bpe.ids_of(strings(b.column(1))):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(map(back.__getitem__, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return run


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with the ids of each whole text as an array of int; null text gives an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in bpe.ids_of(strings(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, data) from rows of (doc_id, ids): the bytes that the ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, back = read_ranks(path)
        for b in batches:
            data = [None if ids is None else b"".join(back[i] for i in ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each whole text of ``docs(doc_id, text, ...)`` by byte-level BPE and decode the ids again.

    Each match of ``pattern`` is encoded separately: a segment tree over its byte
    positions holds the leftmost least pair rank, and each merge makes logarithmic
    point updates on the live neighbours, so a match of any length stays n log n. New
    matches of many texts merge side by side, one tree each. No shuffle: a narrow map
    over the scan.

    Result per row: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit
    ids), decoded_sha256 (of the decoded bytes). Null and empty text give no ids.
    Repeated rows each get a row; other columns are not read.
    """
    return texts_of(docs).mapInArrow(encode_texts(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
