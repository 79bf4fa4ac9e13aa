"""Ranked search, source mixing and importance resampling against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockalloc.llm.lexical import search
from blockalloc.llm.mixing import apportion, mix
from blockalloc.llm.registry import QUERIES
from blockalloc.llm.resampling import bucket_gains, dictionary, resample
from blockalloc.llm.words import words

DOCS = "doc_id long, text string, source string, term string, row int, features string, size int, rank int, weight double"


def docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "t", 1, "f", 2, 3, 0.5) for i, t, s in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, df int")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


TEXTS = [None, "", " \t", "Ab ab AB aB", "ÉA éa a1 1a", "x" * 50_000, "one two\nthree-four_five", "a b c d e f g " * 2000, "  lead and trail  ", "𝔸𝔹 c𝔸", "one", "two one two"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=30))))
def test_words_are_those_of_the_pattern(texts):
    kinds, code, row = words(pa.array(texts, pa.string()))
    got = [(int(r), kinds[int(c)].as_py().decode()) for r, c in zip(row, code, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in terms(t)]
    assert len(set(kinds.to_pylist())) == len(kinds)


# ranked search


def searched(rows, asked, k):
    held = [(i, terms(t)) for i, t, _ in rows]
    n, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(x for _, w in held for x in set(w))
    of = defaultdict(set)
    for item, t in asked:
        of[item] |= set(terms(t))
    out = []
    for item, wanted in of.items():
        scores = []
        for i, w in held:
            tf, m = Counter(w), 50 + (50 * len(w) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in wanted if tf[x])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("vocabulary", [1 << 20, 3])
def test_search_is_brute_force(spark, vocabulary):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "s"), (None, "one two three", "s"), (None, "one two three", "s"), (3, "c d", "s")] + [(100 + i, f"the w{i % 7} the w{i % 3} é", "s") for i in range(60)]
    asked = [(1, "One two three, é"), (2, None), (3, "..."), (4, "the"), (5, "nowhere"), (None, "a b"), (6, "w1"), (6, "w2 w2"), (7, "the the w5 c")]
    got = [tuple(r) for r in search(docs(spark, rows), items(spark, asked), 9, vocabulary, 3).collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(searched(rows, asked, 9), key=key)


def test_search_of_nothing(spark):
    assert search(docs(spark, []), items(spark, [(1, "a")])).count() == 0
    assert search(docs(spark, [(1, "a", "s")]), items(spark, [])).count() == 0
    assert search(docs(spark, [(1, "a", "s")]), items(spark, [(1, "a")])).collect()[0].score == math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 20 * 100))


# mixing


def targets(sizes, repeats=3, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    bounded, total = set(), sum(sizes.values())
    while True:
        open_ = sum(weight[s] for s in names if s not in bounded)
        left = total - sum(repeats * sizes[s] for s in bounded)
        out = {s: repeats * sizes[s] if s in bounded else left * weight[s] / max(1, open_) for s in names}
        more = {s for s in names if s not in bounded and out[s] >= repeats * sizes[s]}
        if not more:
            return out
        bounded |= more


def mixed(spark, rows, **options):
    return mix(docs(spark, rows), **options).toPandas()


def test_mix_meets_targets(spark):
    some = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(some.integers(0, 400))), ["b", "a", "ß", "Z", None][min(4, int(some.integers(0, 9)))]) for i in range(400)]
    got = mixed(spark, rows, block_words=16, shard_words=5000)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    want, taken = targets(totals), Counter()
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == totals[source[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size and r.target == pytest.approx(want[source[r.doc_id]], rel=1e-12)
        taken[source[r.doc_id]] += r.taken
    for s in totals:
        shards = -(-totals[s] // 5000)
        assert abs(taken[s] - want[s]) <= 32 + 16 * shards, s
    again = mixed(spark, rows[::-1], block_words=16, shard_words=5000)
    order = lambda f: sorted(f.itertuples(index=False, name=None))
    assert order(got) == order(again), "reruns agree, whatever the order of the rows"
    assert order(got) != order(mixed(spark, rows, block_words=16, shard_words=5000, seed=8))


def test_mix_repeats_documents_evenly_and_bounds_them(spark):
    rows = [(i, "w " * 40, "big" if i < 95 else "a") for i in range(100)]
    got = mixed(spark, rows, block_words=8)
    small = got[got.source_size == 200]
    assert (small.target == 600).all() and (small.taken == 120).all()
    assert set((got[got.source_size != 200].taken // 40)) <= {0, 1} and abs(got.taken.sum() - 4000) <= 16


def test_mix_edges(spark):
    assert len(mixed(spark, [])) == 0
    got = mixed(spark, [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "x y\x0bz\xa0w", "b"), (2, "x y\x0bz\xa0w", "b"), (None, "l " * 60_000, "c")])
    assert len(got) == 6 and got["size"].tolist().count(3) == 2 and (got.taken <= 3 * got["size"]).all()
    nothing = mixed(spark, [(1, None, "a"), (2, "  ", None)])
    assert (nothing[["size", "taken", "target"]] == 0).all().all()


def seats(votes, n):
    out = Counter()
    for _ in range(n):
        best = max(votes, key=lambda p: (votes[p] / (2 * out[p] + 1), -p))
        out[best] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_is_that_of_highest_quotients(spark, seed):
    some = np.random.default_rng(seed)
    groups = {g: ({p: float(some.integers(0, 4) * some.integers(0, 500)) for p in range(int(some.integers(1, 12)))}, int(some.integers(0, 60))) for g in range(6)}
    rows = [(g, p, v, n) for g, (votes, n) in groups.items() for p, v in votes.items()]
    got = {(r.g, r.p): r.quota for r in apportion(spark.createDataFrame(rows, "g int, p int, v double, n long"), ["g"], "p", "v", "n").collect()}
    for g, (votes, n) in groups.items():
        live = {p: v for p, v in votes.items() if v > 0}
        want = seats(live, n) if live else Counter()
        assert {p: got[g, p] for p in votes} == {p: want[p] for p in votes}


# resampling


def resampled(rows, target, percent=25, least=20, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    of = lambda f: crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t, _ in rows for f in features(t)[1])
    t = Counter(of(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, open_ = [], []
    for i, text, _ in rows:
        w, f = features(text)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(w) >= least:
            open_.append(out[-1])
    open_.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(open_[: len(open_) * percent // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=str)


def clean(df):
    return sorted((tuple(None if pd.isna(v) else int(v) for v in r) for r in df.toPandas().itertuples(index=False, name=None)), key=str)


def test_resampling_is_brute_force(spark):
    some = np.random.default_rng(1)
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(1000 + i, " ".join(f"w{x}" for x in some.integers(0, 30, int(some.integers(0, 60)))), "s") for i in range(200)]
    rows += [(1000, rows[12][1], "s"), (None, "a b " * 30, "s"), (None, None, "s")]
    target = ["w1 w2 w3 W4", None, "", "Éa b"]
    got = resample(docs(spark, rows), items(spark, list(enumerate(target))))
    assert clean(got) == resampled(rows, target)
    few = resample(docs(spark, rows), items(spark, list(enumerate(target))), buckets=7)
    assert clean(few) == resampled(rows, target, buckets=7), "with many features a bucket"


def test_resampling_of_the_given_documents(spark, data):
    docs_ = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    target = spark.read.parquet(f"{data}/benchmark.parquet").toPandas()["text"]
    assert clean(QUERIES["op13_importance_resampling"](spark, data)) == resampled([(int(i), t, None) for i, t in zip(docs_.doc_id, docs_.text)], target)


def test_dictionary_counts_each_string_once(spark):
    rows = docs(spark, [(i, "A b a B c", "s") for i in range(50)] + [(99, None, "s")])
    got = {r.feature: (r.raw, r.target) for r in dictionary(rows.repartition(7), items(spark, [(1, "a b"), (2, "")])).collect()}
    assert got == {"a": (100, 1), "b": (100, 1), "c": (50, 0), "a b": (100, 1), "b a": (50, 0), "b c": (50, 0)}
    assert bucket_gains(dictionary(docs(spark, []), items(spark, []))).count() == 0
    assert resample(docs(spark, []), items(spark, [])).count() == 0
    alone = resample(docs(spark, [(1, "a " * 30, "s")] * 4), items(spark, [])).select("rank").where(F.col("rank").isNotNull())
    assert [r.rank for r in alone.collect()] == [1]
