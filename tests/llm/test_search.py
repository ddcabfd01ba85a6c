"""Vector search, lexical ranking and resampling against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loppis.llm import lexical, resample, topk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- vectors --------------------------------------------------------------------------------------------------------


def vectors(seed=0, n=400, dim=6, spread=0.05):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, spread) for c in r.choice(centres)]) for i in range(n)]
    hot = rows[7][1]
    rows += [(n + i, hot) for i in range(n // 2)]  # a third of all rows is one vector
    rows += [(150, hot), (150, hot), (200, rows[200][1]), (200, rows[3][1])]  # ids that repeat, with equal and other vectors
    rows += [(None, rows[1][1]), (None, hot)]
    rows += [(5000, None), (5001, [1.0, None] + [0.0] * (dim - 2)), (5050, [math.nan] * dim), (5100, [math.inf] + [0.0] * (dim - 1))]
    rows += [(6000, []), (6050, [2.0, 3.0]), (6100, [-0.0] * dim)]
    return rows


def scores_of(rows, scale=256):
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    return kept


def nearest_brute(rows, k=5, every=50):
    kept = scores_of(rows)
    out = Counter()
    for a, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            found = [(-sum(x * y for x, y in zip(v, w)), math.inf if j is None else j, j) for b, (j, w) in enumerate(kept) if b != a]
            out.update((i, r, j, -s) for r, (s, _, j) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1))
    return out


def frame(spark, rows):
    """Extra columns clash with names that the operator uses inside."""
    return spark.createDataFrame([(i, v, b"x", "y", 1) for i, v in rows], "vec_id long, embedding array<double>, code binary, rank string, band int").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 3, "sample": 20, "most_bytes": 200}, {"pivots": 200, "sample": 1000, "most_bytes": 1 << 20}])
def test_nearest(spark, sizes):
    rows = vectors()
    got = topk.nearest(frame(spark, rows), k=5, every=50, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == nearest_brute(rows)


def test_nearest_small_tables(spark):
    none = frame(spark, [(1, [0.5])]).filter("vec_id > 1")
    assert topk.nearest(none).collect() == []
    assert topk.nearest(frame(spark, [(0, [0.5])])).collect() == []  # no row but the query's own
    assert topk.nearest(frame(spark, [(1, [0.5]), (2, [0.5])])).collect() == []  # no query
    few = [(0, [0.5]), (1, [0.5]), (2, [-0.5])]
    assert Counter(map(tuple, topk.nearest(frame(spark, few)).collect())) == nearest_brute(few)


def test_nearest_large_numbers(spark):
    """Sums beyond 2^53 stay exact, by Python's integers."""
    r = random.Random(3)
    rows = [(i, [float(r.randint(-(1 << 22), 1 << 22)) for _ in range(3)]) for i in range(60)]
    rows += [(100, [1e7, 1.0, 0.0]), (101, [1e7, 1.0, 1 / 256]), (102, [1e7, 1.0, 2 / 256]), (150, [0.0, 0.0, 1e300])]
    got = Counter(map(tuple, topk.nearest(frame(spark, rows[:-1])).collect()))
    assert got == nearest_brute(rows[:-1])
    assert topk.nearest(frame(spark, rows)).count() == sum(nearest_brute(rows).values())


def test_bounds_hold():
    """No score lies above the bound of its annulus, and far annuli are left out."""
    r = np.random.default_rng(1)
    v = np.rint(r.normal(0, 60, (500, 8)))
    centres = v[:4]
    d = topk.distances(v, centres)
    at = d.argmin(1)
    visited = 0
    for q in v[:50]:
        for p in range(4):
            own = v[at == p]
            near = d[at == p, p]
            reach = topk.bounds(np.array([[q @ centres[p]]]), topk.distances(q[None], centres[p][None]), np.array([q @ q]), near.min(keepdims=True), near.max(keepdims=True), topk.norms2(own).max(keepdims=True))[0, 0]
            assert (own @ q <= reach).all()
            visited += reach >= np.sort(v @ q)[-6]
    assert visited < 200


def test_search_leaves_parts_out(spark):
    """On clustered vectors the floor of the first visit keeps queries from most parts of the index."""
    rows = vectors(n=300, spread=0.01)
    coded = topk.quantised(frame(spark, rows)).cache()
    index = topk.build(coded, pivots=16)
    queries = coded.filter("vec_id % 50 = 0").select("code").distinct()
    low = queries.crossJoin(spark.range(1)).selectExpr("code", "double('-inf') AS floor")
    high = queries.selectExpr("code", "double(1e12) AS floor")
    assert topk._routed(index, low, False).count() == queries.count() * (sum(b.parts for b in index.bands) - 1)
    assert topk._routed(index, high, False).count() == 0


# --- lexical ranking --------------------------------------------------------------------------------------------------


def corpus(seed=0, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Über", "naïve", "日本", "ABC", "x-y"]
    rows = [(1, None), (2, ""), (3, " -- \n"), (4, "w1"), (5, "W1 w1 w1"), (None, "w1 w2 Über"), (7, "w3 " * 3000)]
    rows += [(100 + i, " ".join(r.choice(vocabulary[: r.choice([5, 35])]) for _ in range(r.randint(1, 60)))) for i in range(n)]
    hot = rows[20][1]
    rows += [(1000 + i, hot) for i in range(n // 2)] + [(20, hot), (20, hot), (20, "w2")]
    return rows


ITEMS = [(1, "w1 w2 W3 über"), (2, "w4 w4 ABC x-y naïve 日本"), (3, None), (4, "?!"), (5, "unknown terms"), (None, "w29 w28"), (6, "w7"), (6, "w8 w9"), (7, " ".join(f"w{i}" for i in range(30)))]


def rank_brute(docs, items, k):
    texts = [(i, Counter(words(t))) for i, t in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n, length = len(texts), sum(x for *_, x in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = Counter()
    for item, text in items:
        terms = set(words(text)) & set(df)
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        found = []
        for i, c, size in texts:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i, i))
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1))
    return out


def texts(spark, rows, names="doc_id long, text string, n string, terms int"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], names).repartition(3)


@pytest.mark.parametrize("k, probe, shard", [(3, 1 << 14, (2 << 20, 1 << 16)), (50, 20, (400, 20)), (7, 40, (1, 1))])
def test_rank(spark, monkeypatch, k, probe, shard):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lexical, "SHARD_POSTINGS", shard[0])
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard[1])
    rows = corpus()
    bench = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, rank int")
    got = lexical.rank(texts(spark, rows), bench, k=k, probe=probe)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == rank_brute(rows, ITEMS, k)
    if k == 3:  # items in several parts give the same rows
        parts = lexical.rank(texts(spark, rows), bench, k=k, max_bytes=40)
        assert Counter(map(tuple, parts.collect())) == rank_brute(rows, ITEMS, k)
        assert lexical.rank(texts(spark, rows).filter(F.lit(False)), bench).collect() == []
        assert lexical.rank(texts(spark, rows), bench.filter(F.lit(False))).collect() == []
        assert lexical.rank(texts(spark, rows).filter("doc_id IN (1, 2, 3)"), bench).collect() == []


def shard_of(seed, docs=300, terms=40):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 20, docs)
    held = np.concatenate([np.sort(r.permutation(terms)[:s]) for s in sizes])
    w = np.sort(r.integers(0, 9000, terms))[::-1].copy()
    return lexical.Shard(r.permutation(docs).astype(np.int64), r.integers(50, 400, docs), np.concatenate(([0], np.cumsum(sizes))), held, r.integers(1, 6, len(held)), w), w


@pytest.mark.parametrize("seed", range(4))
def test_stopping_is_exact(seed):
    """The best of a shard with early stops are those of whole scores, ties and floors included."""
    shard, w = shard_of(seed)
    r = np.random.default_rng(seed)
    docs = np.arange(len(shard.ids))
    for _ in range(30):
        wanted = np.sort(r.permutation(len(w))[: r.integers(1, 12)])
        whole = shard.complete(docs, wanted)
        k = int(r.integers(1, 30))
        order = np.lexsort((shard.ids, -whole))[:k]
        order = order[whole[order] > 0]
        for floor in (0, int(whole[order[-1]]) if len(order) == k else 0):
            found, scores = shard.best(wanted, k, floor)
            assert shard.ids[found].tolist() == shard.ids[order].tolist()
            assert scores.tolist() == whole[order].tolist()


def test_postings_stand_by_impact():
    shard, w = shard_of(9)
    for t in range(len(w)):
        run = shard.rising[shard.lists[t] : shard.lists[t + 1]]
        assert (np.diff(run) >= 0).all() and (run <= 0).all()


# --- resampling -------------------------------------------------------------------------------------------------------


def resample_brute(docs, target, percent=25, least=20, buckets=10000):
    def features(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    source, aim = Counter(), Counter()
    for _, t in docs:
        source.update(features(t))
    for t in target:
        aim.update(features(t))
    s, t = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((n + 1) * (t + buckets)))) for b, n in source.items()}
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    drawn = percent * len(fit) // 100
    out = Counter((*r[:4], None) for r in rows if not r[4])
    out.update((*r[:4], i if i <= drawn else None) for i, r in enumerate(fit, 1))
    return out


def test_resample(spark):
    rows = corpus(5)
    target = [t for _, t in ITEMS]
    bench = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    docs = texts(spark, rows, "doc_id long, text string, bucket string, weight int")
    got = resample.resample(docs, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(map(tuple, got.collect())) == resample_brute(rows, target)
    few = resample.resample(docs, bench.filter("text IS NULL"), percent=60, least_words=2, buckets=97)
    assert Counter(map(tuple, few.collect())) == resample_brute(rows, [], 60, 2, 97)
    assert resample.resample(docs.filter("doc_id > 10000"), bench).collect() == []
    assert resample.resample(docs, bench, buckets=100_000).count() == len(rows)


def test_longer_runs_of_words():
    found = resample.Buckets(3, 1 << 16).of([b"a", b"bc", b"d", b"e"])
    runs = [b"a", b"bc", b"d", b"e", b"a bc", b"bc d", b"d e", b"a bc d", b"bc d e"]
    assert found.tolist() == [zlib.crc32(r) % (1 << 16) for r in runs]
    assert resample.Buckets(3, 10).of([b"a"]).tolist() == [zlib.crc32(b"a") % 10]
    assert len(resample.Buckets(2, 10).of([])) == 0


def test_identical_texts_meet_once(spark):
    rows = [(i, "one text of some words") for i in range(50)] + [(99, "another"), (100, None), (101, "")]
    got = {(r.text, r.times) for r in resample.collapsed(texts(spark, rows)).collect()}
    assert got == {("one text of some words", 50), ("another", 1), ("", 2)}
