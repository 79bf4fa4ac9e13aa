"""Toxicity by class-conditional Kneser-Ney models of expressions."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockalloc.llm.labelled import bucket, fold, known, logistic, logistic_sums
from blockalloc.llm.tokens import strings, texts_of
from blockalloc.session import table

WORD = re.compile(r"\w+")
ORDER = 8
#: Longest part of a word that is modelled at once; longer words fall into such parts.
LONGEST = 40
#: Of five sets, the one with the least loss in cross-validation on learning rows alone.
CLASS_DISCOUNTS = (0.95, 1.4, 1.8)
SHARED_DISCOUNTS = (0.75, 0.75, 0.75)
#: Longest order whose counts go to all tasks; longer ones are dealt by the characters before the last.
BELOW = 3
#: Homes that words are dealt to, at least; there are as many as partitions of the documents.
LEAST_HOMES = 8
#: Words of all kinds that a task counts before it sends them on.
COUNTED_AT_ONCE = 250_000
#: Most frequent words whose scores go to all tasks; the others are joined.
FREQUENT = 1 << 17
#: Words whose scores a task remembers, some 200 bytes each; past that it starts anew, with the same scores.
REMEMBERED = 150_000
#: Most toxic shares of a text's words over which log-likelihoods are compared, and the least number of words in each.
SHARES = ((0.01, 2), (0.02, 3), (0.05, 3), (0.1, 3), (1.0, 1))
#: Texts whose words are looked up together.
TOGETHER = 500
#: Counts of a word by class and fold (learning texts of class y and fold f), and in other texts.
COUNTS = ("n00", "n01", "n10", "n11", "other")
HOME = "home int, words binary, counts binary"
NAMES = [f"f{i}" for i in range(len(SHARES))]
CROSS = [f"c{i}" for i in range(len(SHARES))]


def words(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def marked(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another with a sign that no word has before and after each: characters, the word each is of, and which stand in a word or end it."""
    marked = ["\x00" * ORDER + w + "\x00" for w in batch]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.repeat(np.arange(len(batch), dtype=np.int32), sizes), np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER


def grams(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1 up: every character of every word with its predecessors, and those alone, as hashes; and the word it is of.

    A sign that no word has stands before and after each word, so that beginnings and
    ends of words are modelled too.
    """
    code, of, real = marked(batch)
    code = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    of, key = of[real], np.zeros(len(code), np.uint64)
    for _ in range(ORDER):
        context = np.r_[np.zeros(1, np.uint64), key[:-1]]
        key = context * np.uint64(0x9E3779B97F4A7C15) + code
        yield key[real], context[real], of


class Level:
    """Discounted probabilities of one order: seen n-grams and what a context leaves to the order below.

    Counts of one and two are discounted by more of themselves than larger ones.
    """

    def __init__(self, key: np.ndarray, context: np.ndarray, weight: np.ndarray, discounts: tuple[float, float, float]):
        self.key, first, at = np.unique(key, return_index=True, return_inverse=True)
        count = np.bincount(at, weight, len(self.key))
        off = np.minimum(count, np.choose(np.clip(count.astype(int) - 1, 0, 2), discounts))
        self.left = (count - off).astype(np.float32)
        self.context, at = np.unique(context[first], return_inverse=True)
        self.total = np.bincount(at, count).astype(np.float32)
        self.spare = np.bincount(at, off).astype(np.float32)

    def apply(self, key: np.ndarray, context: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of n-grams, given those of the order below, and where the context was seen."""
        j = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        seen = np.flatnonzero(self.context[j] == context)
        i = np.minimum(np.searchsorted(self.key, key[seen]), len(self.key) - 1)
        left = np.where(self.key[i] == key[seen], self.left[i], 0)
        out, j = below.copy(), j[seen]
        out[seen] = (left + self.spare[j] * below[seen]) / self.total[j]
        return out, seen


class KneserNey:
    """Two character models of words, toxic and ordinary, above shared continuation counts, in one process: what ``word_scores`` gives from many tasks."""

    def __init__(self, batch: list[str], ordinary: np.ndarray, toxic: np.ndarray):
        if not batch:
            batch, ordinary, toxic = ["a"], np.ones(1), np.ones(1)
        self.shared, last = [], None
        for key, context, of in grams(batch):
            if last:  # shared: an n-gram counts once for each character that it was seen to follow
                _, first = np.unique(key, return_index=True)
                self.shared.append(Level(last[0][first], last[1][first], np.ones(len(first)), SHARED_DISCOUNTS))
            last = key, context
        self.top = []
        for weight in (ordinary, toxic):
            live = weight[of] > 0
            self.top.append(Level(key[live], context[live], weight[of][live], CLASS_DISCOUNTS) if live.any() else None)
        self.alphabet = len(self.shared[0].key) + 1

    def differences(self, batch: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word.

        A context that a shorter order hasn't seen has no longer one, so each order looks
        only at what is left from the one below.
        """
        p, live = None, slice(None)
        for n, (key, context, of) in enumerate(grams(batch)):
            p = np.full(len(of), 1 / self.alphabet) if p is None else p
            key, context = key[live], context[live]
            if n < ORDER - 1:
                here, seen = self.shared[n].apply(key, context, p[live])
                p[live] = here
                live = np.arange(len(p))[live][seen]
        gain = np.zeros(len(p))
        ordinary, toxic = (level.apply(key, context, p[live])[0] if level else p[live] for level in self.top)
        gain[live] = np.log(toxic) - np.log(ordinary)
        return np.bincount(of, gain, len(batch))


class Scorer:
    """Length-normalised comparisons of a document's log-likelihoods, from remembered word scores."""

    def __init__(self, model: KneserNey):
        self.model, self.known = model, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each text, divided by its words; likewise of the most toxic shares of its words."""
        docs = [words(t) for t in texts]
        out = np.zeros((len(texts), len(SHARES)))
        if not any(docs):
            return out
        code, kinds = pd.factorize(np.array([w for d in docs for w in d], object))
        found = list(map(self.known.get, kinds))
        missing = [w for w, f in zip(kinds, found, strict=True) if f is None]
        if missing:
            got = dict(zip(missing, self.model.differences(missing).tolist(), strict=True))
            found = [got[w] if f is None else f for w, f in zip(kinds, found, strict=True)]
            if len(self.known) + len(got) > REMEMBERED:
                self.known.clear()
            if len(got) <= REMEMBERED:
                self.known.update(got)
        value = np.array(found)[code]
        at = 0
        for i, d in enumerate(docs):
            if d:
                n = len(d)
                sums = np.cumsum(np.sort(value[at : at + n])[::-1])
                at += n
                for k, (share, least) in enumerate(SHARES):
                    m = min(n, max(least, math.ceil(share * n)))
                    out[i, k] = sums[m - 1] / m
        return out


def sets_of_texts(b: pa.RecordBatch) -> Iterable[Iterable[str]]:
    return (set(words(t)) for t in strings(b.column(0)))


def sets_of_packed(b: pa.RecordBatch) -> Iterable[Iterable[str]]:
    return (unpacked_words(x) for x in b.column(0).to_pylist())


def packed_words(found: list[str]) -> bytes:
    return zlib.compress("\n".join(found).encode(), 6) if found else b""


def unpacked_words(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split("\n") if packed else []


def count_words(batches: Iterator[pa.RecordBatch], homes: int = 1, read: Callable = sets_of_texts) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class and fold, and without either, a word stands: packed rows for each of the words' ``homes``."""
    kinds = [Counter() for _ in COUNTS]
    for b in batches:
        for some, y, f in zip(read(b), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            kinds[-1 if y is None else 2 * y + f].update(some)
        if sum(map(len, kinds)) > COUNTED_AT_ONCE:
            yield lots(kinds, homes)
            kinds = [Counter() for _ in COUNTS]
    yield lots(kinds, homes)


def lots(kinds: list[Counter], homes: int) -> pa.RecordBatch:
    found = sorted(set().union(*kinds))
    counts = np.array([[k.get(w, 0) for w in found] for k in kinds], np.int64)
    home = np.fromiter((zlib.crc32(w.encode()) % homes for w in found), np.int64, len(found))
    order = np.argsort(home, kind="stable")
    who, start = np.unique(home[order], return_index=True)
    parts = np.split(order, start[1:]) if len(who) else []
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array([packed_words([found[i] for i in p]) for p in parts], pa.binary()), pa.array([packed_counts(counts[:, p]) for p in parts], pa.binary())], ["home", "words", "counts"])


def packed_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(counts, np.int64).tobytes(), 1)


def unpacked_counts(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int64).reshape(rows, -1)


def add_up(t: pa.Table) -> pa.Table:
    """A home's words, in order, with the sums of their counts."""
    parts = [(unpacked_words(w), unpacked_counts(c, len(COUNTS))) for w, c in zip(t["words"].to_pylist(), t["counts"].to_pylist(), strict=True)]
    rows = pa.table({"word": pa.array([w for some, _ in parts for w in some], pa.string())} | {c: np.concatenate([n[i] for _, n in parts]) for i, c in enumerate(COUNTS)})
    rows = rows.group_by("word").aggregate([(c, "sum") for c in COUNTS]).sort_by("word")
    counts = packed_counts(np.stack([rows[f"{c}_sum"].to_numpy() for c in COUNTS]))
    return pa.table({"home": t["home"][:1], "words": pa.array([packed_words(rows["word"].to_pylist())], pa.binary()), "counts": pa.array([counts], pa.binary())})


def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of each text, compressed: what the join with the labels moves instead of texts."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed_words(sorted(set(words(t)))) for t in strings(b.column(1))], pa.binary())], ["doc_id", "words"])


def word_counts(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, homes: int) -> DataFrame:
    """(home, words, counts): a packed row a home, of all words with the number of texts that each stands in, by ``COUNTS``."""
    none = F.lit(None).cast("int")
    texts, mine = texts_of(docs), F.coalesce(bucket(modulus) != held_out, F.lit(False))
    learning = texts.where(mine).mapInArrow(pack_words, "doc_id long, words binary").join(known(labels, "toxic", modulus, held_out), "doc_id", "left")
    learning = learning.select("words", "y", fold().alias("fold")).mapInArrow(partial(count_words, homes=homes, read=sets_of_packed), HOME)
    rest = texts.where(~mine).select("text", none.alias("y"), none.alias("fold")).mapInArrow(partial(count_words, homes=homes), HOME)
    return learning.union(rest).groupBy("home").applyInArrow(add_up, HOME)


def orders(windows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 up the hashes of the last characters, and of those without the last one: as ``grams``, but from windows."""
    code = (windows.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    n, times = code.shape[1], np.uint64(0x9E3779B97F4A7C15)
    before, power, out = np.zeros(len(code), np.uint64), np.uint64(1), []
    for i in range(n):
        out.append((before * times + code[:, -1], before))
        if i < n - 1:
            before = before + code[:, n - 2 - i] * power
            with np.errstate(over="ignore"):
                power = power * times
    return out


def asked(batch: list[str], owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different windows (the ``ORDER`` characters that end at a character) of some words by their owners: windows, owner of each, place of each character's window, word of each character."""
    for i, (key, context, of) in enumerate(grams(batch)):
        if i == BELOW:
            before = context
    _, first, at = np.unique(key, return_index=True, return_inverse=True)
    owner = (before[first] % np.uint64(owners)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, _, real = marked(batch)
    ends = np.flatnonzero(real)[first[order]]
    return code[ends[:, None] + np.arange(1 - ORDER, 1)], owner[order], place[at], of


def ask(owners: int):
    """A home's words as requests: a row for each owner with the windows it is asked for and their counts by class and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for home, packed, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                windows, owner, place, of = asked(unpacked_words(packed), owners)
                counts = np.stack([np.bincount(place, c[of], len(owner)).astype(np.int64) for c in unpacked_counts(counts, len(COUNTS))[:-1]])
                who, start = np.unique(owner, return_index=True)
                ends = np.r_[start[1:], len(owner)]
                rows = [(zlib.compress(np.ascontiguousarray(windows[i:j].T).tobytes(), 6), packed_counts(counts[:, i:j])) for i, j in zip(start, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), home, np.int32)), pa.array(who), pa.array([w for w, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())], ["home", "owner", "windows", "counts"])

    return run


def unpacked(windows: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zlib.decompress(windows), np.uint32).reshape(ORDER, -1).T, unpacked_counts(counts, len(COUNTS) - 1)


def short_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different last ``BELOW + 1`` characters of windows that learning rows have."""
    for b in batches:
        parts = [w[c.sum(0) > 0, -BELOW - 1 :] for w, c in (unpacked(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))]
        found = np.unique(np.concatenate([np.zeros((0, BELOW + 1), np.uint32), *parts]), axis=0).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], [f"c{i}" for i in range(BELOW + 1)])


def short_levels(grams: np.ndarray, weight: np.ndarray) -> list[Level]:
    """Continuation counts of the orders up to ``BELOW``, from its different grams and how many characters each was seen to follow."""
    keys, levels = orders(grams), []
    for i in reversed(range(len(keys))):
        levels.append(Level(*keys[i], weight, SHARED_DISCOUNTS))
        _, first = np.unique(keys[i][0], return_index=True)
        keys, weight = [(k[first], c[first]) for k, c in keys], np.ones(len(first))
    return levels[::-1]


def gains(windows: np.ndarray, counts: np.ndarray, short: list[Level]) -> np.ndarray:
    """Toxic less ordinary log-likelihood of the last character of each window, by models without fold 0, without fold 1 and of all.

    The windows are all those, of learning rows and others, whose last ``BELOW`` characters
    before the last one hash alike, so that longer grams and contexts are whole here.
    """
    keys = orders(windows)
    _, first, at = np.unique(keys[-1][0], return_index=True, return_inverse=True)
    n = np.stack([np.bincount(at, c, len(first)) for c in counts])
    keys = [(k[first], c[first]) for k, c in keys]
    learnt = n.sum(0) > 0
    out = np.zeros((len(first), 3))
    if not learnt.any():
        return out[at]
    p, live = np.full(len(first), 1 / (len(short[0].key) + 1)), np.arange(len(first))
    for i, (key, context) in enumerate(keys[:-1]):
        if i < BELOW:
            level = short[i]
        else:  # shared: an n-gram counts once for each character that it was seen to follow
            _, one = np.unique(keys[i + 1][0][learnt], return_index=True)
            level = Level(key[learnt][one], context[learnt][one], np.ones(len(one)), SHARED_DISCOUNTS)
        p[live], seen = level.apply(key[live], context[live], p[live])
        live = live[seen]
    key, context = keys[-1]
    for m, folds in enumerate(([1], [0], [0, 1])):
        chance = []
        for y in (0, 1):
            weight = n[[2 * y + f for f in folds]].sum(0)
            some = weight > 0
            chance.append(Level(key[some], context[some], weight[some], CLASS_DISCOUNTS).apply(key[live], context[live], p[live])[0] if some.any() else p[live])
        out[live, m] = np.log(chance[1]) - np.log(chance[0])
    return out[at]


def answer(short: list[Level]):
    """An owner's answers: to each home the gains of the windows it asked for, in their order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("home")
        parts = [unpacked(*x) for x in zip(t["windows"].to_pylist(), t["counts"].to_pylist(), strict=True)]
        ends = np.cumsum([len(w) for w, _ in parts])[:-1]
        got = gains(np.concatenate([w for w, _ in parts]), np.concatenate([c for _, c in parts], 1), short).astype(np.float32)
        return pa.table({"home": t["home"], "owner": t["owner"], "gains": pa.array([zlib.compress(g.tobytes(), 1) for g in np.split(got, ends)], pa.binary())})

    return run


def tell(owners: int):
    """A home's words with the sums of their characters' gains, packed."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        found = unpacked_words(t["words"][0].as_py())
        _, _, place, of = asked(found, owners)
        got = np.frombuffer(b"".join(map(zlib.decompress, answers.sort_by("owner")["gains"].to_pylist())), np.float32).reshape(-1, 3)[place].astype(float)
        sums = np.stack([np.bincount(of, got[:, m], len(found)) for m in range(3)]).astype(np.float32)
        return pa.table({"home": t["home"], "words": t["words"], "counts": t["counts"], "gains": pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())})

    return run


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for packed, counts, sums in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            d = np.frombuffer(zlib.decompress(sums), np.float32).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(unpacked_words(packed), pa.string()), pa.array(unpacked_counts(counts, len(COUNTS)).sum(0)), *map(pa.array, d)], ["word", "n", "d0", "d1", "d2"])


def word_scores(counts: DataFrame, homes: int) -> DataFrame:
    """(word, n, d0, d1, d2): toxic less ordinary log-likelihood of every word, by models without fold 0, without fold 1 and of all learning rows.

    Words are dealt to homes, windows of characters to owners by the characters before
    the last one. An owner sees all grams of its contexts, so nothing is fitted in one
    place; only the shortest orders, as many as the alphabet allows, go to all tasks.
    """
    counts = counts.where("length(words) > 0").checkpoint()
    requests = counts.mapInArrow(ask(homes), "home int, owner int, windows binary, counts binary").checkpoint()
    names = [f"c{i}" for i in range(BELOW + 1)]
    found = requests.select("windows", "counts").mapInArrow(short_grams, ", ".join(f"{c} long" for c in names)).distinct()
    found = found.groupBy(*names[1:]).agg(F.count("*").alias("n")).orderBy(*names[1:]).toPandas()
    short = short_levels(found[names[1:]].to_numpy(np.uint32), found["n"].to_numpy(float))
    answers = requests.groupBy("owner").applyInArrow(answer(short), "home int, owner int, gains binary")
    told = counts.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(tell(homes), f"{HOME}, gains binary").checkpoint()
    return told.mapInArrow(word_rows, "word string, n long, d0 float, d1 float, d2 float")


def digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def most(share: float, least: int, n: int) -> int:
    return min(n, max(least, math.ceil(share * n)))


def shares_of(n: int, values: np.ndarray, total: float) -> list[float]:
    """The sums of the most toxic shares of ``n`` words over their numbers, from the highest values in descending order and the sum of all."""
    sums = np.cumsum(values)
    return [total / m if m == n else sums[m - 1] / m for m in (most(share, least, n) for share, least in SHARES)]


def ragged(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts and isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def summaries(frequent):
    """Each text as its number of words, the sum and the highest of its frequent words' scores by both models, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, scores = frequent.value
        place = dict(zip(kinds, range(len(kinds)), strict=True)).get
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                some = b.slice(at, TOGETHER)
                docs, folds = [words(t) for t in strings(some.column(1))], some.column(2).to_pylist()
                codes = np.array([place(w, -1) for d in docs for w in d], np.int64)
                ends = np.cumsum([0, *map(len, docs)])
                total, high, rare = ([], []), ([], []), []
                for d, f, i, j in zip(docs, folds, ends, ends[1:]):
                    code = codes[i:j]
                    rare.append([d[k] for k in np.flatnonzero(code < 0)])
                    code = code[code >= 0]
                    keep = max((most(*s, len(d)) for s in SHARES[:-1]), default=0)
                    for k, m in enumerate((2, f)):
                        v = np.sort(scores[code, m])[::-1] if m is not None else np.zeros(0, np.float32)
                        total[k].append(float(v.sum(dtype=float)))
                        high[k].append(v[:keep])
                n = len(docs)
                columns = [pa.array(np.arange(row, row + n)), some.column(0), some.column(2), some.column(3), pa.array([len(d) for d in docs], pa.int32()), *(pa.array(x, pa.float64()) for x in total), *(ragged(x, pa.float32()) for x in high), ragged(rare, pa.string())]
                row += n
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "fold", "key", "n", "total", "cross_total", "high", "cross_high", "rare"])

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each text from its summary and the scores of its other words."""
    for b in batches:
        rows = b.to_pydict()
        sizes = rows["n"]
        out = np.zeros((2, len(sizes), len(SHARES)))
        for k, (total, high, more) in enumerate((("total", "high", "more"), ("cross_total", "cross_high", "cross_more"))):
            for i, n in enumerate(sizes):
                if n and (k == 0 or rows["fold"][i] is not None):
                    other = np.sort(np.array(rows[more][i] or (), float))
                    # other words without a score of their own count as zeros
                    zeros = rows["n_rare"][i] - len(other)
                    top = np.sort(np.concatenate([rows[high][i], other, np.zeros(min(zeros, n))]))[::-1]
                    out[k, i] = shares_of(n, top, rows[total][i] + float(other.sum()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], b["fold"], *(pa.array(c) for c in out[0].T), *(pa.array(c) for c in out[1].T)], ["doc_id", "key", "fold", *NAMES, *CROSS])


def features(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, key: Column | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, key, fold, f0.., c0..): comparisons of each text by the models of all learning rows, and by those without its fold where it may be one.

    The most frequent words' scores, at most ``frequent``, go to all tasks; the other words
    of each text are joined with theirs, and what is highest or summed is merged.
    """
    homes = max(LEAST_HOMES, docs.rdd.getNumPartitions())
    scores = word_scores(word_counts(docs, labels, modulus, held_out, homes), homes)
    scores = scores.withColumn("size", F.floor(16 * F.log2("n")).cast("int"))  # groups of words about as frequent
    sizes = sorted(scores.groupBy("size").count().collect(), reverse=True)
    fits = [r["size"] for r, n in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if n <= frequent]
    often = F.col("size") >= (fits[-1] if fits else 1 << 20)
    top = scores.where(often).toPandas()
    known_words = docs.sparkSession.sparkContext.broadcast((top["word"].tolist(), top[["d0", "d1", "d2"]].to_numpy(np.float32)))
    mine = F.coalesce(bucket(modulus) != held_out, F.lit(False))
    schema = "row long, doc_id long, fold int, key binary, n int, total double, cross_total double, high array<float>, cross_high array<float>, rare array<string>"
    key = F.lit(None).cast("binary") if key is None else key
    rows = texts_of(docs).select("doc_id", "text", F.when(mine, fold()).alias("fold"), key.alias("key")).mapInArrow(summaries(known_words), schema).checkpoint()
    cross = F.when(F.col("fold") == 0, F.col("d0")).when(F.col("fold") == 1, F.col("d1"))
    others = rows.select("row", "fold", F.explode("rare").alias("word")).join(scores.where(~often).where("d0 != 0 or d1 != 0 or d2 != 0"), "word")
    others = others.groupBy("row").agg(F.collect_list("d2").alias("more"), F.collect_list(cross).alias("cross_more"))
    whole = rows.withColumn("n_rare", F.size("rare")).drop("rare").join(others, "row", "left")
    out = whole.mapInArrow(merged, "doc_id long, key binary, fold int, " + ", ".join(f"{c} double" for c in [*NAMES, *CROSS])).checkpoint()
    known_words.destroy()
    return out


def calibration(rows: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> np.ndarray:
    """Weights of the logistic function, from all learning rows, each seen through models without its fold; sums alone leave the tasks."""
    data = rows.select("doc_id", *CROSS).join(known(labels, "toxic", modulus, held_out), "doc_id").select(*CROSS, "y").checkpoint()
    if data.select("y").distinct().count() < 2:
        return np.r_[np.zeros(len(SHARES)), -2.0]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.stack([b.column(i).to_numpy() for i in range(len(SHARES))], 1), b.column(len(SHARES)).to_numpy())
                g, h = logistic_sums(x, y, w)
                yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([[*g, *h.ravel()]], pa.list_(pa.float64()))], ["n", "sums"])

        got = data.mapInArrow(run, "n long, sums array<double>").select(F.sum("n"), F.array(*(F.sum(F.get("sums", i)) for i in range(len(w) * (len(w) + 1))))).first()
        s = np.array(got[1])
        return s[: len(w)], s[len(w) :].reshape(len(w), len(w)), got[0]

    return np.round(logistic(sums, len(SHARES) + 1), 9)  # so that the order in which tasks are added up shows in no score


def scored(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, key: Column | None = None) -> DataFrame:
    """(doc_id, key, score) of every row."""
    rows = features(docs, labels, modulus, held_out, key)
    w = calibration(rows, labels, modulus, held_out)
    z = sum((F.col(c) * float(x) for c, x in zip(NAMES, w, strict=False)), F.lit(float(w[-1])))
    return rows.select("doc_id", "key", (1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), z))))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text, ...)`` for toxicity as ``labels(doc_id, toxic)`` marks it.

    Character 8-gram Kneser-Ney models of words, one of toxic and one of ordinary
    texts, smooth rare words through continuation counts that both share. The score
    compares a document's toxic and ordinary log-likelihoods, divided by the number of
    its words: over all of them, and over the most toxic tenth, twentieth, fiftieth and
    hundredth, so that a few expressions count in a long text as well. A logistic
    function of these differences, fitted across two halves, gives it. Models and
    weights come from all labelled rows but those whose crc32(doc_id) mod ``modulus`` is
    ``held_out``; the counts stay on the executors, dealt by word and by characters.

    Result per row: doc_id, held_out, score, predicted. Null text counts as empty and
    gets the score of a text without words, whose differences are all zero. A null
    doc_id is scored and not held out. Without labels of both classes every text scores
    the same, below the threshold. Repeated rows each get a row; other columns are not
    read.
    """
    rows = scored(docs, labels, modulus, held_out)
    return rows.select("doc_id", F.coalesce(bucket(modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` doesn't predict toxic, with all their columns.

    A score depends on id and text alone, so toxic rows are told from others by the id and a digest of the text.
    """
    rows = scored(docs, labels, modulus, held_out, digest())
    bad = rows.where(F.col("score") >= threshold).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (digest() == F.col("_key")), "left_anti")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
