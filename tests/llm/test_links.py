"""The similarity join, its components and the whole pipeline against brute force."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from loppis.llm import decontaminate, htmltext, jaccard, quality
from loppis.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def near_texts(seed=1):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(30, 120))] for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "TWO  words"), (6, "lone"), (7, "x " * 3000)]
    for k, b in enumerate(base):
        for copy in range(8):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((100 + 10 * k + copy, " ".join(w)))
    return rows


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        n = min(size, len(w))
        out[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    return out


def classes(rows, size=5, percent=80):
    """doc_id to the smallest id of its component, by all pairs."""
    sets = sets_of(rows, size)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("percent, tile_size", [(80, 256), (80, 3), (50, 4)])
def test_join_equals_all_pairs(spark, percent, tile_size):
    rows = near_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    want, sets = classes(rows, percent=percent), sets_of(rows, 5)
    got = {r.doc_id: r for r in jaccard.join(df, percent=percent, tile_size=tile_size).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_prefix_tree_equals_all_pairs(percent):
    rng = random.Random(percent)
    for _ in range(150):
        given = {tuple(sorted(rng.sample(range(12), rng.randint(1, 9)))) for _ in range(rng.randint(1, 25))}
        sets = [np.array(x) for x in sorted(given, key=lambda _: rng.random())]

        def groups_of(pairs, n=len(sets)):
            label = list(range(n))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(i for i in range(n) if label[i] == x) for x in label}

        near = lambda a, b: 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
        found = jaccard.PrefixTree(sets).links(percent)
        assert all(near(sets[i], sets[j]) for i, j in found)
        assert groups_of(found) == groups_of(pairs)


def test_prefix_tree_leaves_subtrees_of_unlike_sizes(monkeypatch):
    """Each set begins the next and has twice its length: nothing can link, so only the root's path is counted."""
    tree, calls, gain = jaccard.PrefixTree([np.arange(2**k) for k in range(9)]), [], jaccard.PrefixTree._gain
    monkeypatch.setattr(jaccard.PrefixTree, "_gain", lambda self, tokens: calls.append(len(tokens)) or gain(self, tokens))
    assert tree.links(80) == [] and calls == [1]


def test_join_of_a_large_group_of_near_copies(spark):
    """One group of far more sets than a tile holds: two clusters of near copies, chains and loners, all exact."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(120)]
    other = base[:60] + [r.choice(words) for _ in range(60)]
    rows, chain = [], list(base[:80])
    for i in range(150):
        w = list(base if i % 3 else other)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(30):
        chain[r.randrange(80)] = r.choice(words)
        rows.append((500 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = classes(rows)
    got = {x.doc_id: x.component_id for x in jaccard.join(df, tile_size=8).collect()}
    assert got == want and 2 < len(set(want.values())) < 150


def test_join_of_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f")] * 3 + [(3, "A b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    rows = jaccard.join(df).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 3), (3, 3), (5, 3), (5, 3), (5, 3), (9, 9)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(0, 60)] + [("s", f"t{i}") for i in range(50)] + [("p", "q"), ("q", "p"), ("p", "q")]
    got = {r.node: r.root for r in components(spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")).collect()}
    assert {bytes(got[f"{i:04}".encode()]) for i in range(61)} == {b"0000"}
    assert {bytes(got[f"t{i}".encode()]) for i in range(50)} == {b"s"}
    assert bytes(got[b"q"]) == b"p"


def test_hot_host_keeps_its_template(spark):
    """Most pages on one host: split over salts, all of them lose the template."""
    box = "<div><p>Read on every day with us</p></div>"
    rows = [(i, f"http://hot.example/{i}", f"<body>{box}<p>story {i}</p></body>") for i in range(300)]
    rows += [(1000 + i, f"http://h{i}.example/", f"<body><p>own {i}</p></body>") for i in range(50)]
    done = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert all(done[i] == f"story {i}" for i in range(300)) and all(done[1000 + i] == f"own {i}" for i in range(50))


def pipeline_rows():
    r = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    bench = [(i, " ".join(r.choice(words) for _ in range(14))) for i in range(4)]
    rows = []
    for i in range(60):
        w = [r.choice(words) for _ in range(r.randint(40, 90))]
        if i % 13 == 5:
            w[20:20] = bench[i % 4][1].upper().split()
        text = " ".join(w)
        if i % 3 == 0:
            text += "\nShared licence LINE here"
        rows.append((i, text))
        if i % 6 == 0:
            rows.append((500 + i, text + " end"))
    rows += [(900, None), (901, ""), (902, "too short"), (903, "same words again and again here now ok " * 12)]
    return rows, bench


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, bench = pipeline_rows()
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in quality.report(docs).collect() if r.kept}
    assert kept >= {i for i, _ in rows if i < 900}  # clean documents stay
    assert not kept & {900, 901, 902, 903}
    now = [(i, t) for i, t in rows if i in kept]
    seen = {}
    for i, t in now:
        for k in {low(x).strip(" \t\n\x0b\x0c\r") for x in t.split("\n")}:
            seen.setdefault(k, set()).add(i)
    often = {k for k, v in seen.items() if len(v) >= 10 and k}
    now = [(i, "\n".join(x for x in t.split("\n") if low(x).strip(" \t\n\x0b\x0c\r") not in often)) for i, t in now]
    root = classes(now)
    now = [(i, t) for i, t in now if root[i] == i]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(norm(b)[j : j + 10]) for _, b in bench for j in range(len(norm(b)) - 9)}
    now = [(i, t) for i, t in now if not windows & {tuple(norm(t)[j : j + 10]) for j in range(len(norm(t)) - 9)}]
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in done) == sorted(i for i, _ in now)
    assert 40 < len(now) < 60
    texts = dict(now)
    for r in done:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)


def test_near_duplicates_go_by_row(spark, tmp_path):
    """Null ids, repeated rows and an id with two texts: one row of each group stays, rows without a word all stay."""
    a, b, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abde")
    rows = [(None, a), (None, a), (None, a + " end"), (1, b), (1, b), (2, b + " end"), (2, d), (None, e), (7, e), (3, ""), (3, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sum(t in (a, a + " end") for _, t in left) == 1
    want = [(1, b), (2, d), (7, e), (3, ""), (3, ""), (None, None), (None, None)]
    assert sorted((x for x in left if x[1] not in (a, a + " end")), key=str) == sorted(want, key=str)


def test_stages_return_documents_columns(spark, tmp_path):
    """Each stage but the last keeps the columns, extra ones too, and bears an empty table."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, key string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert decontaminate.clean(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
