"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import pytest

from loppis.llm import bpe, decontaminate, htmltext, linededup, pii, quality, secrets, sharding, substring
from loppis.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def corpus(seed=0, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "naïve", "日本", "x y", "###"]
    shared = " ".join(r.choice(words) for _ in range(50))
    line = "  Licensed under THESE terms.\t"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "\n\n"), (6, "a " * 4000), (6, "a " * 4000)]
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 90)))
        if i % 4 == 0:
            text += " " + shared
        if i % 3 == 0:
            text += "\n" + line + "\nown line " + str(i % 7)
        rows.append((100 + i, text))
    rows += [(900 + i, rows[10][1]) for i in range(3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns clash with names that the operators use inside."""
    rows = [(i, t, "x", 1, "y") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, shard int, kept string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert sharding.shard(empty).count() == 0
    assert linededup.digests(linededup.dedup(empty)).count() == 0
    assert substring.digests(substring.dedup(empty)).count() == 0
    assert decontaminate.report(decontaminate.find(empty, bench)).count() == 0
    assert secrets.report(secrets.scan(empty)).count() == 0
    assert quality.report(empty).count() == 0
    assert pii.scan(empty).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- sharding -------------------------------------------------------------------------------------------------------


def test_shards(docs):
    rows = sharding.shard(docs, shards=5, cells=4).collect()
    text = {}
    for i, t in corpus():
        text.setdefault(i, t or "")
    assert len(rows) == len(corpus())
    slots = Counter()
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 8
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard, r.slot] += 1
    assert max(slots.values()) == 1
    for s in range(5):
        assert sorted(k[1] for k in slots if k[0] == s) == list(range(sum(k[0] == s for k in slots)))


def test_jump_moves_the_least(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select(*[sharding.jump_shard(F.col("id"), n).alias(f"s{n}") for n in (1, 7, 8)])
    rows = df.collect()
    assert {r.s1 for r in rows} == {0}
    assert all(r.s8 == r.s7 or r.s8 == 7 for r in rows)
    moved = sum(r.s8 != r.s7 for r in rows) / len(rows)
    assert abs(moved - 1 / 8) < 0.02
    assert max(Counter(r.s7 for r in rows).values()) < 20000 / 7 * 1.1


def test_sharding_is_native(docs):
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- BPE ------------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    path = places.path("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path)
    r = random.Random(5)
    texts = [t or "" for _, t in corpus()] + ["It's <|endoftext|> ΑΣ İ ① 🙂👩‍👩‍👧 '  é", "a" * 5000, "<|endoftext|><|startoftext|>"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x3000), r.randrange(0xE000, 0x1FFFF), 39, 115])) for _ in range(12)) for _ in range(1500)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False) == own.encode_all([t])[0][1]
    done = by_id(bpe.digests(docs, path))
    for i, t in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert done[i][0].n_tokens == len(ids)
        assert done[i][0].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert done[i][0].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))


def test_bpe_rows_equal_single_trees():
    """Trees side by side merge as the single tree does, for every length and row count."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    own = bpe.WordBpe(path)
    r = random.Random(8)
    words = ["".join(r.choice("abcdeinorst'é日") for _ in range(n)) for n in range(1, 60) for _ in range(20)]
    words = [w for w in dict.fromkeys(words) if len(w.encode()) <= own.SHORT]
    made = own.merge_all(words)
    assert all(made[w].tolist() == own.merge(w.encode()) for w in words)


def test_bpe_long_pre_tokens_and_empty_tables(spark, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    assert bpe.digests(empty, path).count() == 0
    long = "abracadabra" * 3000
    rows = [(1, long, "x"), (1, long, "x"), (None, "!" * 9000 + " one", "x"), (3, None, "x"), (4, "\x1c\x1d a\x1fb", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs, path).collect()
    assert len(got) == 5
    for g in got:
        text = {1: long, None: rows[2][1], 3: "", 4: rows[4][1]}[g.doc_id]
        assert g.n_tokens == len(lib.encode(text, add_special_tokens=False).ids)
        assert g.decoded_sha256 == sha(lib.decode(lib.encode(text, add_special_tokens=False).ids, skip_special_tokens=False))


def test_bpe_memory_is_bounded_and_changes_nothing():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    own, small = bpe.WordBpe(path), bpe.WordBpe(path)
    small.memory = bpe.Memory(1 << 15)
    r = random.Random(3)
    for _ in range(60):
        texts = [" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(30)) for _ in range(4)]
        assert small.encode_all(texts) == own.encode_all(texts)
        assert small.memory.used <= small.memory.limit and len(small.memory.old) + len(small.memory.young) < 500


def test_merge_tree_gives_leftmost_lowest():
    t = bpe.MergeTree([5, 3, 9, 3])
    assert t.best() == (3, 1)
    t.set(1, bpe.NO_RANK)
    assert t.best() == (3, 3)
    t.set(3, bpe.NO_RANK)
    t.set(0, bpe.NO_RANK)
    t.set(2, bpe.NO_RANK)
    assert t.best()[0] >= bpe.NO_RANK


# --- line dedup -----------------------------------------------------------------------------------------------------


def lines_kept(rows, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and n[key(x)] >= min_docs)]
        out[i] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs", [3, 10])
def test_line_dedup(docs, min_docs):
    done = by_id(linededup.digests(linededup.dedup(docs, min_docs=min_docs)))
    for i, want in lines_kept(corpus(), min_docs).items():
        assert all((r.n_lines, r.n_dropped, r.kept_sha256) == want for r in done[i])


def test_line_index_is_reversible(spark, docs):
    """Documents inserted and deleted again leave the index as it was; lines are dropped and come back with it, whatever
    the number of buckets that the asking documents are dealt to."""
    rows = corpus()
    extra = [(5000 + i, f"own line {i % 7}\nnew {i}") for i in range(40)]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    first = linededup.build(linededup.local_counts(linededup.keyed(docs, 16), 64), 64)
    grown = cut(linededup.update(first, more, 1))
    dropped = lambda state, n: {i: (x[0].n_lines, x[0].n_dropped, x[0].kept_sha256) for i, x in by_id(linededup.digests(linededup.dedup(docs, state=state, n=n))).items()}
    alone, with_more = lines_kept(rows, 10), lines_kept(rows + extra, 10)
    assert alone != {i: with_more[i] for i in alone}
    assert dropped(first, 8) == alone
    for n in (8, 64, 96):
        assert dropped(grown, n) == {i: with_more[i] for i in alone}
    less = linededup.update(grown, more, -1)
    table = lambda state: {r.shard: (bytes(r.keys), bytes(r.counts)) for r in state.collect() if len(r.keys)}
    assert table(less) == table(first) and dropped(less, 8) == alone
    with pytest.raises(ValueError):
        linededup.shape(grown.union(linededup.build(linededup.local_counts(linededup.keyed(docs, 8), 8), 8)))


def test_cuckoo_filter():
    import numpy as np

    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    f = linededup.Cuckoo.holding(h)
    assert f.has(h).all()
    assert f.has(r.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.01
    f.drop(h[:4000])
    assert f.has(h[4000:]).all() and f.has(h[:4000]).mean() < 0.01
    assert linededup.Cuckoo.load(f.dump()).has(h[4000:]).all()


# --- substring dedup ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [5, 35])
def test_substring_dedup(docs, width):
    rows = corpus()
    windows = Counter()
    for _, t in rows:
        w = WORD.findall(t or "")
        windows.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    done = by_id(substring.digests(substring.dedup(docs, width=width)))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - width + 1):
            if windows[tuple(w[j : j + width])] > 1:
                gone |= set(range(j, j + width))
        want = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
        assert all((r.n_words, r.n_removed, r.kept_sha256) == want for r in done[i])


# --- decontamination ------------------------------------------------------------------------------------------------


def bench_rows():
    rows = corpus()
    clean = [(1, "short item"), (2, None), (3, "?!"), (None, "w1 w2 w3")]
    return clean + [(10 + k, (t or "").upper().replace(" ", "-")) for k, (_, t) in enumerate(rows[12:20])]


@pytest.mark.parametrize("max_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, max_bytes):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = bench_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    done = by_id(decontaminate.report(decontaminate.find(docs, bench, width=4, max_bytes=max_bytes)))
    kept = {r.doc_id for r in decontaminate.clean(docs, bench, width=4, max_bytes=max_bytes).collect()}
    for i, t in corpus():
        w = low(t)
        hit, names = set(), set()
        for k, b in items:
            v = low(b)
            n = min(4, len(v))
            for a in range(max(1, len(v) - 3) if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[a : a + n]:
                        hit |= set(range(j, j + n))
                        if k is not None:
                            names.add(str(k))
        want = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))
        assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want for r in done[i])
        assert (i in kept) == (not hit)
    assert sum(map(len, done.values())) == len(corpus())


def test_offsets_map_to_the_original():
    text = "¡Hola, MUNDO cruel!"
    a = decontaminate.Automaton([(1, b"mundo CRUEL")], 10)
    spans, names = a.scan(decontaminate.normal_words(text.encode()))
    assert names == {"1"}
    (start, end), = decontaminate.spans_of(text, spans)
    assert text[start:end] == "MUNDO cruel"


# --- secrets --------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secret_base_spans(spark):
    r = random.Random(4)
    bits = ["token=", "secret: ", "API_KEY='", "abc", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef01234567", "xyz", " ", "\n", "é", "🙂", "password", "=", "z" * 7, "passwd:token:abcdefgh"]
    rows = [(1, None), (2, ""), (3, "token=ab token=abcdef")] + [(10 + i, "".join(r.choice(bits) for _ in range(20))) for i in range(150)]
    done = by_id(secrets.report(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"))))
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m.group(1)) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        row = done[i][0]
        assert row.base_sha256 == sha(",".join(base))
        assert set(base) <= set(row.spans.split(",")) or not base
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))


def test_randomness_battery(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    letters = secrets.UPPER + secrets.LOWER + secrets.DIGITS
    rows = [(True, "".join(r.choice(letters) for _ in range(40))) for _ in range(30)]
    plain = ["thisisaverylongidentifierofwordsandmore", "getUserAccountInformationByIdentifierName", "some_long_variable_name_for_counting", "-" * 40, "0123456789" * 4, "ab" * 20, "Donaudampfschifffahrtsgesellschaftskapitaen"]
    df = spark.createDataFrame(rows + [(False, p) for p in plain], "random boolean, t string").withColumn("p", secrets.p_value(F.col("t")))
    found = df.collect()
    assert sum(x.p < 1e-3 for x in found if x.random) >= 28
    assert all(x.p > 1e-2 for x in found if not x.random)
    texts = [(i, f"see {t} there " + " ".join(plain)) for i, (_, t) in enumerate(rows)]
    done = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string"))
    named = {x.doc_id: {(s.start, s.end) for s in x.random} for x in done.collect()}
    assert sum((4, 44) in s for s in named.values()) >= 28
    assert sum(len(s) for s in named.values()) <= 32


def test_secret_scan_is_native(docs):
    plan = secrets.report(secrets.scan(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- personal data --------------------------------------------------------------------------------------------------


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def private_spans(t):
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]
    return found


def test_private_base_spans(spark):
    r = random.Random(9)
    bits = ["a.b", "@", "x-y.com", ".", " ", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0199", "+49", "é", "🙂", "\n", "7", "word", "٣"]
    rows = [(1, None), (2, ""), (3, "4111111111111111 4111111111111111")] + [(10 + i, "".join(r.choice(bits) for _ in range(15))) for i in range(300)]
    done = by_id(pii.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        want = private_spans(t or "")
        base = [f"{k}:{a}:{b}" for k, v in want.items() for a, b in v]
        row = done[i][0]
        assert row.base_sha256 == sha(",".join(base))
        assert row.spans.split(",")[: len(base)] == base or not base
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [len(v) for v in want.values()]


def test_crf_held_out():
    import numpy as np

    crf = pii.train(pii.labelled_rows(7, 40))
    hits = wrong = missed = 0
    for words, labels in pii.labelled_rows(99, 8):
        got = [pii.LABELS[x] for x in crf.decode(crf.features.sequence([w.encode() for w in words]), np.array([len(words)]))]
        for a, b in zip(labels, got, strict=True):
            hits += a == b != "O"
            wrong += b != "O" and a != b
            missed += a != "O" and a != b
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95


def test_viterbi_equals_brute_force():
    """Decoding stretches finds the best labels of whole lines of up to 60 words."""
    import numpy as np

    crf = pii.trained(7, 40)
    r = random.Random(2)
    vocab = [w for words, _ in pii.labelled_rows(5, 6) for w in words]
    labelled = 0
    for _ in range(600):
        words = [r.choice(vocab) for _ in range(r.randint(1, 60))]
        types = crf.features.sequence([w.encode() for w in words])
        first = np.zeros(len(types), np.int64)
        first[0] = 1
        e, trans = crf.emissions(types, first).astype(float), crf.trans.astype(float)
        best, back = e[0], []
        for i in range(1, len(e)):
            way = best[:, None] + trans
            back.append(way.argmax(0))
            best = way.max(0) + e[i]
        got = crf.decode(types, np.array([len(types)])).tolist()
        score = sum(e[i, x] for i, x in enumerate(got)) + sum(trans[a, b] for a, b in zip(got, got[1:], strict=False))
        assert score == pytest.approx(best.max(), abs=1e-3)
        labelled += any(got)
    assert labelled > 300


#: Sentences written by hand, apart from the templates; what is to be found stands in brackets.
NATURAL = """
My name is [John Carter] and I have lived here for years.
[Anna Miller] wrote this in the morning.
Dear [Wolfgang Amadeus Mozart], thank you for the letter.
Write to [john dot doe at example dot com] for the details.
Please call [555 123-4567] before noon.
Contact: [Priya Patel], tel. [(030) 123-4567]
The report was signed by Dr. [Keller] on Monday.
We spoke with Mrs. [O'Brien] about the garden.
Reach us by phone: [212-555-0199]
Her SSN is [078-05-1120] as far as we know.
Yesterday [Maria García] came home late.
Herr [Schmidt] hat das Buch gelesen.
Señora [López] vive en la casa azul.
Mme [Dubois] est partie hier.
His account, IBAN [DE89 3704 0044 0532 0130 00], was closed.
Nombre: [Juan Fernández]
Kontakt: [Hans Wagner] im zweiten Stock
Then [Paul Smith] and [Elena Rossi] left the room.
Telefon [0171 / 2345678] ist immer besetzt.
My card [4111 1111 1111 1112] does not work.
mail me at [info at example dot org] please
The New York Times wrote about the weather.
In 2019 we sold 1200 units at 45.50 each.
Version 2.10 fixes the crash at start.
He called at noon and left at three.
Le grand marché de Paris est ouvert.
Das ist ein Satz ohne Namen und Nummern.
Call me maybe, said the song in 2012.
The point at which two lines meet is open.
United Nations members met in Geneva today.
"""


def test_model_on_natural_sentences():
    """Held-out sentences that no template made: most spans are found, few others are."""
    crf = pii.trained(7, 40)
    hits = missed = wrong = 0
    for line in NATURAL.strip().split("\n"):
        want, text = set(), ""
        for part in re.split(r"(\[[^\]]*\])", line):
            if part.startswith("["):
                want.add((len(text), len(text) + len(part) - 2))
                part = part[1:-1]
            text += part
        got = {s for spans in pii.model_spans([text], crf)[0].values() for s in spans} | {s for spans in pii.base_spans(text).values() for s in spans}
        hits, missed, wrong = hits + len(want & got), missed + len(want - got), wrong + len(got - want)
    print(hits, missed, wrong)
    assert hits / (hits + missed) >= 0.8 and hits / (hits + wrong) >= 0.8


def test_shapes_and_emails_of_whole_words():
    assert pii.shape("a" * 41 + "1234567") == pii.shape("aa1234567") != pii.shape("aaa")
    text = "@x.y " * 20_000 + "a@b.c" + "@x.y" * 20_000
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert pii.emails(text[99_900:101_000]) == [m.span() for m in pattern.finditer(text[99_900:101_000])]
    assert len(pii.emails(text)) == 10_001 and pii.emails("a@b.c@d.e f@g.h") == [(0, 5), (10, 15)]


# --- quality --------------------------------------------------------------------------------------------------------


def test_quality_counts(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", "s") for i, t in corpus()]
    done = by_id(quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        rep = set()
        for j in range(len(w) - 7):
            if windows[tuple(w[j : j + 8])] > 1:
                rep |= set(range(j, j + 8))
        seen, dup = set(), 0
        for x in t.split("\n"):
            dup += x in seen and bool(WORD.search(x))
            seen.add(x)
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        want = (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), dup, len(rep), failed)
        for r in done[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            assert not (failed and r.kept)


def test_mcd_rejects_outliers_only(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(150)) + ".", "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + r.choice(["###", "%%%"]) for _ in range(150)), "en", "s") for i in range(40)]
    rows += [(2000 + i, " ".join(word().upper() for _ in range(150)), "en", "s") for i in range(20)]
    done = quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sum(not r.kept for r in done if r.doc_id < 1000) <= 1
    assert not any(r.kept for r in done if r.doc_id >= 1000)
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def fast_mcd(x, h, tries, rng):
    """Smallest determinant over many random starts with concentration steps to the end, in numpy."""
    import numpy as np

    best = (np.inf, None, None)
    for _ in range(tries):
        own = rng.choice(len(x), x.shape[1] + 2, replace=False)
        for _ in range(60):
            mu, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + 1e-9 * np.eye(x.shape[1])
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            new = np.sort(np.argsort(d)[:h])
            if np.array_equal(new, own):
                break
            own = new
        if (det := np.linalg.slogdet(np.cov(x[own].T, bias=True))[1]) < best[0]:
            best = (det, x[own].mean(0), np.cov(x[own].T, bias=True))
    return best


def test_mcd_equals_search_over_many_starts(spark, tmp_path):
    """Correlated groups with a quarter of shifted rows: determinant, centre and verdicts of a search in numpy."""
    import numpy as np

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(4)
    groups = {}
    for level, shift in (("a", 3.0), ("b", 8.0), ("c", 0.0)):
        mix = rng.normal(size=(quality.DIMS, quality.DIMS))
        x = rng.normal(size=(400, quality.DIMS)) @ mix * 2
        x[:80] += shift * rng.choice([-1, 1], quality.DIMS) * x.std(0)
        groups[level] = x
    rows = spark.createDataFrame([(row.tolist(), k) for k, x in groups.items() for row in x], "x array<double>, level string").checkpoint()
    cutoff, scale = quality.chi2_quantile(0.9999, quality.DIMS), 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, quality.DIMS), quality.DIMS + 2)
    for p in quality.fit(rows).collect():
        x = groups[p.level]
        det, mu, cov = fast_mcd(x, int(0.75 * len(x)), 200, rng)
        inv = np.array(p.inv).reshape(quality.DIMS, quality.DIMS)
        own = np.einsum("ij,jk,ik->i", x - p.mu, inv, x - p.mu) > cutoff
        want = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov * scale), x - mu) > cutoff
        assert -np.linalg.slogdet(inv)[1] == pytest.approx(det + quality.DIMS * np.log(scale), abs=0.35)
        assert (own == want).mean() >= 0.985


def test_moments_go_to_python_as_one_column(spark):
    """Each column of a task's input keeps memory of the executor, so no step sends the moments one by one."""
    rows = cut(spark.createDataFrame([("a", [random.Random(f"{i} {k}").gauss(0, 1) for k in range(quality.DIMS)]) for i in range(40)], "level string, x array<double>"))
    first = quality.starts(rows, True)
    for step in (first, quality.concentrate(rows, cut(first), 0.75, True)):
        todo, seen = [step._jdf.queryExecution().optimizedPlan()], 0
        while todo:
            node = todo.pop()
            below = [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() in ("MapInPandas", "FlatMapGroupsInPandas"):
                seen += 1
                assert below[0].output().size() <= 8
            todo += below
        assert seen == 1


def test_quality_keeps_columns_of_any_name(spark):
    """Columns named like the operator's own come back as they were."""
    r = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)), "en", None, f"k{i}", f"q{i}", 1.5, f"l{i}", f"x{i}", i, f"r{i}") for i in range(30)] + [(99, None) + ("en",) * 2 + ("k",) * 2 + (0.0, "l", "x", 1, "r")]
    names = "doc_id long, text string, lang string, source string, kept string, _q string, distance double, level string, _x string, _mu long, `_row` string"
    done = {x.doc_id: x for x in quality.keep(spark.createDataFrame(rows, names)).collect()}
    assert set(done) == set(range(30))
    assert all((d.kept, d["_q"], d.distance, d.level, d["_x"], d["_mu"], d["_row"]) == (f"k{i}", f"q{i}", 1.5, f"l{i}", f"x{i}", i, f"r{i}") for i, d in done.items())
    assert quality.keep(spark.createDataFrame(rows, names).limit(0)).count() == 0


def test_many_levels_join_over_salts(spark, tmp_path):
    """The join beyond the broadcast's bound gives the same estimates."""
    r = random.Random(6)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.createDataFrame([([r.gauss(i % 3, 1.0) for _ in range(quality.DIMS)], str(i % 3)) for i in range(600)], "x array<double>, level string").checkpoint()
    key = lambda df: {p.level: (p.n, [round(v, 6) for v in p.mu]) for p in df.collect()}
    assert key(quality.fit(rows, broadcast_rows=0)) == key(quality.fit(rows))


# --- pages ----------------------------------------------------------------------------------------------------------


def test_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><ul><li>a</ul></nav><!-- x -->
<div class="cookie-notice">c</div><main><article><header><h1>Title &eacute;&amp;</h1></header><p>One <b>two</b>
 three<br>four<p>five<script>var a = "</p>";</script><ul><li>x<li>y</ul><div class="ad">buy</div><form>f</form>
<div id="comments"><p>nice</p></div><table><tr><td>c1<td>c2<tr><td>c3</table><footer>by me</footer></article></main><aside>s</aside><footer>f</footer></body>"""
    assert htmltext.main_text(page) == "Title é&\nOne two three four\nfive\nx\ny\nc1\nc2\nc3"
    assert htmltext.main_text("") == "" and htmltext.main_text("plain & text") == "plain & text"
    assert htmltext.main_text("<div><p>a</p></div>" * 2000).count("\n") == 1999


def test_templates_go(spark):
    box = "<div><p>Subscribe to us and read on every day</p><p>Good offer</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<p>story {i} here</p></body>") for i in range(10)]
    rows += [(50 + i, "http://b.example/x", "<body><p>same copy</p></body>") for i in range(20)]  # copies are no template
    rows += [(80, None, None), (81, "http://a.example/z", ""), (82, "http://c.example/", f"<body>{box}</body>")]
    done = {r.page_id: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(done) == len(rows)
    assert done[3].text == "story 3 here" and done[55].text == "same copy"
    assert done[80].text == done[81].text == "" and done[80].n_chars == 0
    assert done[82].text == "Subscribe to us and read on every day\nGood offer"


def test_copied_articles_are_no_template(spark):
    """Copies that differ outside of the article, and an article beside different others, count once."""
    note = "<div><p>Read on every day</p></div>"
    around = lambda i, main: f"<html><head><title>{i}</title><script>track({i});</script></head><body><!-- {i} --><nav>n{i}</nav>{main}<footer>f{i}</footer></body>"
    story = f"<article><h1>One</h1><p>same story</p>{note}</article>"
    rows = [(i, "http://a.example/x", around(i, story)) for i in range(20)]
    rows += [(50 + i, "http://a.example/y", around(i, f"<article><p>story {i}</p>{note}</article>")) for i in range(5)]
    rows += [(100 + i, "http://b.example/x", around(i, f"<article><p>same story</p></article><article><p>other {i}</p></article>")) for i in range(20)]
    rows += [(150 + i, "http://c.example/x", around(i, "<p>same story</p>")) for i in range(20)]
    done = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {done[i] for i in range(20)} == {"One\nsame story"}
    assert [done[50 + i] for i in range(5)] == [f"story {i}" for i in range(5)]
    assert [done[100 + i] for i in range(20)] == [f"same story\nother {i}" for i in range(20)]
    assert {done[150 + i] for i in range(20)} == {"same story"}


def test_marks_inside_articles_stay():
    """Inside an article only whole names of adverts and comments, and elements by name, go."""
    page = """<div class="site-nav">menu</div><article><h1>T</h1><p class='alert'>Storm warning</p><div class='related-work'>Work</div>
<section id='legal'>Law</section><div class='share-price'>12 up</div><div class="ad">buy</div><div class="x comments">nice</div><nav>n</nav></article>"""
    assert htmltext.main_text(page) == "T\nStorm warning\nWork\nLaw\n12 up"
    page = "<body><div class='main-nav'>menu</div><div id='cookie_banner'>c</div><div class='share-price'>12 up</div><div class='related-work'>Work</div><p>x</p></body>"
    assert htmltext.main_text(page) == "12 up\nWork\nx"


def test_pages_of_any_depth_and_breakage():
    """Deep, open and broken pages take time in proportion to their length."""
    assert htmltext.main_text("<div>" * 100_000 + "deep") == "deep"
    assert htmltext.main_text("<span>" * 50_000 + "x" + "<h1>" * 50_000 + "y") == "x\ny"
    assert htmltext.main_text("<p><select>" + "<h1>" * 50_000 + "x") == ""
    assert htmltext.main_text("<a " * 350_000).count("<a") == 350_000
    assert htmltext.main_text("a" + '<a href="' * 100_001 + ">b") == "ab"
    assert htmltext.main_text("<p>a</p>" + "<" * 500_000 + "<p>b") == "a\n" + "<" * 500_000 + "\nb"
    assert htmltext.main_text("<ul>" + "<li>a" * 50_000).count("a") == 50_000
    assert htmltext.main_text("<div>" * 30_000 + "</b>" * 60_000 + "t") == "t"
    assert htmltext.main_text("x<script>" * 50_000) == "x" and htmltext.main_text("x<!-- y") == "x"
    assert htmltext.main_text("<p title='a > b'>c</p><p title=it's>d</p>") == "c\nd"


def test_wrappers_of_a_single_article_are_no_subtrees(spark):
    """An element around the outermost article is not deleted with it, wherever it starts and ends."""
    rows = [(i, "http://a.example/", f"<body><div><section><article><p>one</p><p>two</p></article></section></div><footer>{i}</footer></body>") for i in range(9)]
    rows += [(20 + i, "http://a.example/", f"<body><div><article><p>t{i}</p></article><article><p>s{i}</p></article></div>") for i in range(2)]
    done = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {done[i] for i in range(9)} == {"one\ntwo"} and done[21] == "t1\ns1"


def test_templates_equal_brute_force(spark):
    """Random trees: subtrees in half of a host's different main parts, and five of them, go, as counted over the trees."""
    r = random.Random(12)
    shared = [("div", [("p", [f"menu {i}"]), ("p", [r.choice(["a", "b"])])]) for i in range(4)]

    def tree(depth):
        kids = [r.choice(shared) if r.random() < 0.4 else tree(depth - 1) if depth and r.random() < 0.5 else ("p", [f"w{r.randrange(12)}"]) for _ in range(r.randint(1, 3))]
        return ("div", kids)

    def shown(t):
        return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(shown, t[1]))}</{t[0]}>"

    def blocks(t):
        return [] if isinstance(t, str) else [shown(t), *(b for k in t[1] for b in blocks(k))]

    def lines(t, gone):
        if isinstance(t, str):
            return [t]
        return [] if shown(t) in gone else [x for k in t[1] for x in lines(k, gone)]

    pages = [(i, r.choice("abc"), [tree(2), r.choice(shared), tree(1)]) for i in range(60)]
    pages += [(100 + i, h, t) for i, h, t in pages[:20]]
    want = {}
    for h in "abc":
        mains = {"".join(map(shown, t)): {b for x in t for b in blocks(x)} for _, g, t in pages if g == h}
        count = Counter(b for found in mains.values() for b in found)
        gone = {b for b, n in count.items() if n >= 5 and n >= 0.5 * len(mains)}
        assert gone
        want |= {i: "\n".join(x for k in t for x in lines(k, gone)) for i, g, t in pages if g == h}
    # the wrapping element takes part in the hash of the whole, not in the subtrees that the trees count
    rows = [(i, f"http://{h}.example/{i}", "".join(map(shown, t)), "x", 1) for i, h, t in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, trees int").repartition(4)
    assert {x.page_id: x.text for x in htmltext.extract(df).collect()} == want
    assert {x.page_id: x.text for x in htmltext.extract(df, broadcast_trees=0).collect()} == want


def test_unescape_matches_library():
    assert htmltext.main_text("<p>&lt;b&gt; &copy &#8364; &nosuch; &am</p>") == " ".join(html.unescape("&lt;b&gt; &copy &#8364; &nosuch; &am").split())
