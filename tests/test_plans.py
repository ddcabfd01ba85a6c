"""Every relational query against its SQL in DuckDB, golden values of the scalar functions, and stream against batch."""

import math
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loppis.functions import dates, money, stats, text
from loppis.operators import matching, ranking, similar, writes
from loppis.plans import landed, registry
from loppis.sources import extract
from loppis.streaming import ticks

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.6g}" if v != int(v) else str(int(v))
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


WHOLE = {"j16_resolve_canonical": "product_id", "j17_token_overlap": "p_partkey", "j18_clean_candidates": "id", "j19_suggestion_duplicates": "id", "j25_relations": "id"}


@needs_data
@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_table_of_parts(spark, name):
    """Neither the whole queries nor their SQL have a cut: parts of all sizes have results."""
    sql = registry.ORACLE_SQL[name]
    assert not any(x in sql for x in ("p_size <", "p_size >", "p_partkey <"))
    rows = registry.QUERIES[name](spark, SF).select(F.col(WHOLE[name]).alias("p_partkey"))
    sizes = spark.read.parquet(f"{SF}/part.parquet").join(rows, "p_partkey", "left_semi")
    assert sizes.filter("p_size BETWEEN 25 AND 40").count() > 0 and sizes.filter("p_size < 20").count() > 0 and sizes.filter("p_size > 45").count() > 0


@needs_data
def test_greedy_distinct_takes_all_parts(spark):
    """Against brute force over all parts, of which the middle sizes were left out."""

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.lower().split() for i in range(len(w) + 1)}

    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    want = {}
    for p in parts:
        a, found = grams(f"{p.p_name} {p.p_type}"), []
        for k in parts:
            if k.p_brand == p.p_brand and k.p_partkey != p.p_partkey:
                name = f"{k.p_name} {k.p_type} {k.p_size}"
                b = grams(name)
                if (sim := len(a & b) / len(a | b)) >= 0.4:
                    found.append((-sim, name, k.p_partkey))
        if found:
            want[p.p_partkey] = [name for _, name, _ in sorted(found)[:5]]
    got = {r.id: r.kept for r in registry.QUERIES["a21_greedy_distinct"](spark, SF).collect()}
    assert set(got) == set(want)
    assert any(20 <= p.p_size <= 40 for p in parts if p.p_partkey in got)
    for i in sorted(want, key=lambda i: (-len(want[i]), i))[:4]:
        kept = []
        for name in want[i]:
            if all(value(spark, text.dice(F.lit(name), F.lit(x))) <= 0.85 for x in kept):
                kept.append(name)
        assert got[i] == "|".join(kept)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- golden values --------------------------------------------------------------------------------------------------

NAMES = [
    (text.alnum_key, "Roland Juno-60", "rolandjuno60"),
    (text.normalize_query, "  Kjærhólm  PK22! ", "kjærholm pk22"),
    (text.normalize_query, "Über Größe", "uber groesse"),
    (text.normalize_query, "Jäger & Söhne", "jaeger soehne"),
    (text.normalize_query, "re-201*", "re-201*"),
    (text.normalize_query, "Tab\tA", "taba"),
    (text.strip_search_term, "Roland Roland Jupiter-8 61-Key Polyphonic Synthesizer 1983", "Roland Jupiter-8"),
    (text.strip_search_term, "Fender Stratocaster (2019) - Black", "Fender Stratocaster"),
    (text.strip_search_term, "Korg M1 [serviced] - ", "Korg M1"),
    (text.strip_search_term, "Moog Minimoog Model D Reissue Extra", "Moog Minimoog Model D"),
    (text.strip_search_term, "1234 Only", "1234 Only"),
    (text.clean_name, "JoMox JoMox Moonwind", "JoMox Moonwind"),
    (money.parse_amount, "6,513 DKK", 6513),
]


@pytest.mark.parametrize("f, given, want", NAMES)
def test_golden_strings(spark, f, given, want):
    assert value(spark, f(F.lit(given))) == want


TOKENS = [
    ("roland juno-60 synth", "juno-60", True), ("juno-600", "juno-60", False), ("x-juno-60", "juno-60", False), ("juno 106", "juno-106", False),
    ("boss sg", "sg", False), ("slider cap juno-6, juno-60, jupiter 8", "juno-60", True), ("pp58/3 stol", "PP58/3", True), ("tube-tech cl 1b", "CL 1B", True),
]


def test_golden_tokens(spark):
    rows = spark.createDataFrame(TOKENS, "t string, k string, want boolean")
    assert rows.filter(text.contains_token(F.col("t"), F.col("k")) != F.col("want")).count() == 0


PAIRS = [
    (text.trigram_similarity, "Roland Juno-60", "Roland Juno 60", 1.0), (text.trigram_similarity, "Roland Juno-60", "Roland Juno-106", 12 / 19),
    (text.trigram_similarity, "word", "two words", 4 / 11), (text.dice, "Roland Juno-60", "Roland Juno-106", 0.814815),
    (text.dice, "aaaa", "aa", 1.5), (text.dice, "aa", "aaaa", 0.5), (text.dice, "a", "b", 1.0), (text.dice, "a", "ab", 0.0),
    (text.token_score, "Roland Juno-60", "Roland Juno-60 61-Key Polyphonic Synthesizer", 1.0), (text.token_score, "Roland Juno-60", "Roland Juno-106", 0.67),
    (text.token_score, "A B C D", "x a b c", 0.75), (text.token_score, "Korg MS-20 mini", "Korg Volca", 0.25),
]


@pytest.mark.parametrize("f, a, b, want", PAIRS)
def test_golden_similarity(spark, f, a, b, want):
    assert value(spark, f(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-6)


def test_golden_ids_money_dates(spark):
    assert value(spark, text.deterministic_id(F.lit("thomann"), F.lit("https://x/y.htm"))) == "e4fbba9d-5592-4987-4ffd-69e0be7ead18"
    assert str(value(spark, dates.hammered_date(F.lit("Hammered 11 Dec 2016"))))[:10] == "2016-12-11"
    assert value(spark, dates.hammered_date(F.lit("Ends soon"))) is None


RANGES = [
    ([100, 110, 120, 130, 5000], (100, 130, 115, 4)), ([100, 5000, 9000], (100, 9000, 5000, 3)), ([100, 100], None), ([0, -5, 10, 20, 31, 40], (10, 40, 26, 4)),
    ([339, 9000, 9500, 10000, 10500, 11000, 12001, 45000], (9000, 12001, 10250, 6)), ([1, 2, 3, 100], (1, 100, 3, 4)),
]


def test_golden_robust_ranges(spark):
    rows = [(i, float(x)) for i, (xs, _) in enumerate(RANGES) for x in xs]
    got = {r.k: (r.low, r.high, r.median, r["count"]) for r in stats.robust_range(spark.createDataFrame(rows, "k int, x double"), ["k"], "x").collect()}
    assert got == {i: want for i, (_, want) in enumerate(RANGES) if want}


# --- operators ------------------------------------------------------------------------------------------------------


def test_percentiles_round_once(spark):
    """A quarter between two prices that is a half stays one; 0.75 * low + 0.25 * high of rounded products falls below it."""
    pairs = [(236.2, 237.4), (199.45, 199.65), (94.35, 94.95)]
    rows = [(k, x) for k, pair in enumerate(pairs) for x in pair] + [(9, None), (10, 5.0), (10, None), (11, float("inf")), (11, 1.0)]
    got = {r.k: (r["count"], r.p25, r.p50, r.p75) for r in stats.interpolated_percentiles(spark.createDataFrame(rows, "k int, x double"), ["k"], "x").collect()}
    assert [got[k][1] for k in range(3)] == [237, 200, 95]
    assert got[9] == (0, None, None, None) and got[10] == (1, 5, 5, 5) and got[11][0] == 2


def test_matcher_cascade(spark):
    """Identifiers beat synonyms beat models; EAN and abbreviations never match; unresolved synonyms are skipped."""
    listings = spark.createDataFrame([(1, "roland juno-60 synth"), (2, "space echo unit"), (3, "juno 106 ok"), (4, "ean 12345"), (5, None)], "listing_id long, title string")
    ids = spark.createDataFrame([(10, "juno-60", "SKU", 1), (11, "12345", "EAN", 2)], "product_id long, value string, type string, seq long")
    syn = spark.createDataFrame([(None, "space echo", "alias", 9, 1), (20, "space echo", "alias", 5, 2), (21, "unit", "abbrev", 9, 3), (22, "ean", "exact", 9, 4)], "product_id long, alias string, match_type string, priority int, seq long")
    models = spark.createDataFrame([(30, " Juno-106", 1), (31, "Juno-60", 2), (32, None, 3)], "product_id long, model string, seq long")
    told = {r.listing_id: r.explain for r in matching.cascade(listings, ids, syn, models).collect()}
    assert told == {1: '{"matched_identifier":"juno-60","type":"SKU"}', 2: '{"matched_alias":"space echo"}', 3: '{"matched_model_name":" Juno-106"}'}
    got = {r.listing_id: (r.product_id, r.method, r.score) for r in matching.cascade(listings, ids, syn, models).collect()}
    assert got == {1: (10, "SKU", 95), 2: (20, "SYNONYM", 80), 3: (30, "MODEL", 70)}


def test_null_keys_in_both_modes(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, v int")
    assert writes.dedup_rows(rows, ["k"], [F.col("v")], nulls_distinct=True).count() == 3
    assert writes.dedup_rows(rows, ["k"], [F.col("v")], nulls_distinct=False).count() == 2


def test_search_page_listings(spark):
    html = """<script type="application/ld+json">{"@type":"CollectionPage","mainEntity":{"itemListElement":[{"item":{"url":"u1","name":"Juno","image":"i","offers":{"price":"1200","priceCurrency":"DKK"}}},{"item":{"url":"","name":"x"}}]}}</script><script type="application/ld+json">{bad</script>"""
    rows = extract.collection_listings(spark.createDataFrame([(html,), (None,), ("",)], "html string"), "dba.dk", "DKK").collect()
    assert [(r.title, r.price, r.currency, r.url) for r in rows] == [("Juno", 1200, "DKK", "u1")]


def test_product_page_falls_back_to_meta(spark):
    a = '<script type="application/ld+json">{"@type":"Product","name":"Chair","offers":{"price":"500","priceCurrency":"DKK"}}</script>'
    b = '<meta property="og:title" content="Lamp"/><meta content="70" property="product:price:amount"/>'
    rows = extract.product_page(spark.createDataFrame([("a", a), ("b", b), ("c", "nothing")], "url string, html string")).collect()
    assert sorted((r.url, r.title, r.price) for r in rows) == [("a", "Chair", 500), ("b", "Lamp", 70)]


def test_bootstrap_articles_and_auctions(spark):
    js = """bootstrapModule('search.index', [{"articles":[{"relativeLink":"a.htm?x=1","texts":{"title":"A [b]"},"price":{"primary":{"rawPrice":"10.5"}},"mainImage":{"fileName":"f.jpg"}},{"relativeLink":"","texts":{"title":"no"}}]}])"""
    rows = extract.bootstrap_articles(spark.createDataFrame([(js,), ("none",)], "html string"), "https://s", "https://i").collect()
    assert [(r.url, r.name, r.price) for r in rows] == [("https://s/a.htm", "A [b]", 11)]
    page = '<div data-react-props="{&quot;items&quot;:[{&quot;title&quot;:&quot;T&quot;,&quot;url&quot;:&quot;u&quot;,&quot;amount&quot;:&quot;6,513 DKK&quot;,&quot;timeLeft&quot;:&quot;Hammered 11 Dec 2016&quot;,&quot;auctionIsEnded&quot;:true}]}" >'
    rows = extract.auction_items(spark.createDataFrame([(page,)], "html string")).collect()
    assert [(r.title, r.price, str(r.sold_on)[:10]) for r in rows] == [("T", 6513, "2016-12-11")]


# --- streams --------------------------------------------------------------------------------------------------------


@needs_data
def test_notify_once_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    once = ticks.notify_once(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    q = once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, e.select("user_id", "event_type").distinct().collect()))


@needs_data
def test_rate_limit_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.select("client", (F.col("us") / 1e6).alias("seconds"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = ticks.limit_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), "client")
    rows = []
    q = out.writeStream.foreachBatch(lambda df, i: rows.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    g = e.groupBy("client").agg(F.sort_array(F.collect_list("seconds")).alias("t"))
    want = g.select("client", F.size("t").alias("n"), F.size(F.filter(ticks.rate_limited(F.col("t")), lambda x: x)).alias("m")).collect()
    assert sorted(rows) == sorted(map(tuple, want))


def test_tick_marks_and_alerts_once(spark):
    schema = "url string, watchlist_id string, title string, price int, scraped_at timestamp, notified_at timestamp"
    lists = spark.createDataFrame([("w", True, 100), ("v", False, None)], "id string, active boolean, max_price int")
    state = spark.createDataFrame([], schema)
    batch = spark.sql("SELECT * FROM VALUES ('a', 'w', 'A', 50, timestamp'2026-01-01'), ('b', 'w', 'B', 500, timestamp'2026-01-01'), ('c', 'w', 'C', NULL, timestamp'2026-01-01'), ('d', 'v', 'D', 1, timestamp'2026-01-01') t(url, watchlist_id, title, price, scraped_at)")
    state, snaps, alerts = ticks.tick(batch, state, lists)
    assert sorted(r.url for r in alerts.collect()) == ["a", "c"] and snaps.count() == 2
    state = spark.createDataFrame(state.collect(), state.schema)
    again, _, alerts = ticks.tick(batch, state, lists)
    assert alerts.count() == 0 and again.count() == 2


def test_limited_table_equals_fold(spark):
    """A client that never pauses, one with pauses, equal times, a null client and a null time."""
    rows = [("busy", i * 0.7) for i in range(900)] + [("slow", float(i * i)) for i in range(60)] + [("tie", 5.0)] * 30 + [(None, 1.0), (None, 1.5), ("tie", None)]
    e = spark.createDataFrame(rows, "client string, t double").repartition(5)
    got = ticks.limited(e, "client", "t", 60.0, 20)
    g = e.groupBy("client").agg(F.sort_array(F.collect_list("t")).alias("t"))
    want = g.select("client", F.size("t").alias("n"), F.size(F.filter(ticks.rate_limited(F.col("t")), lambda x: x)).alias("m"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert ticks.limited(e.limit(0), "client", "t").count() == 0


def test_numbered_over_ranges(spark):
    """Numbers over all rows and within groups, a hot and a null group among them, equal a plain ranking."""
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"g{i % 12}", i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(6)
    got = {r.id: r.place for r in ranking.numbered(df, [F.col("v").desc(), F.col("id")], "place").collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    got = {r.id: r.place for r in ranking.numbered(df, [F.col("v").desc(), F.col("id")], "place", "g").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        want |= {r[0]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])))}
    assert got == want
    assert ranking.numbered(df.limit(0), [F.col("id")], "place", "g").count() == 0


def test_contained_pairs_are_all_pairs(spark):
    """Rare pieces as keys find what comparing every pair finds, in groups, for short, equal, empty and missing strings."""
    import random

    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcå ") for _ in range(r.randint(0, n)))
    texts = [(r.randint(1, 3), word(12)) for _ in range(150)] + [(1, None), (None, "abc"), (1, "abab"), (1, "abab")]
    names = [(r.randint(1, 3), word(5)) for _ in range(120)] + [(1, None), (None, "abc"), (1, "bab"), (1, "bab")]
    t, n = spark.createDataFrame(texts, "brand_id int, _text string"), spark.createDataFrame(names, "brand_id int, _name string")
    got = sorted(map(tuple, matching.contained_pairs(t, n, ("brand_id",)).select("brand_id", "_text", "_name").collect()))
    want = {(g, x, y) for g, x in texts for h, y in names if g is not None and g == h and x is not None and y and y in x}
    assert got == sorted(want) and len(got) > 100
    whole = sorted(map(tuple, matching.contained_pairs(t, n).select("_text", "_name").collect()))
    assert whole == sorted({(x, y) for _, x in texts for _, y in names if x is not None and y and y in x})


@needs_data
def test_payloads_are_dealt_to_all_cores(spark):
    """One small file of parts is read by one task; the payloads made of it are not worked on by one."""
    rows = landed.parts(spark, SF, F.col("p_name"))
    cores = spark.sparkContext.defaultParallelism
    assert rows.select(F.spark_partition_id()).distinct().count() >= cores and rows.count() == 200


def test_clean_candidates_of_equal_names(spark):
    """20000 rows of one name on either side: the 400 million pairs are never made; a row is no candidate of itself."""
    begun = time.monotonic()
    p = spark.range(20000).selectExpr("id", "'b' AS brand_id", "'hot bolt' AS name")
    got = similar.clean_candidates(p, p).groupBy("id").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.sum("candidate_id").alias("s"))
    assert {tuple(r) for r in got.filter("id > 5").select("a", "b", "s").distinct().collect()} == {(1, 5, 10)}
    assert got.count() == 20000 and got.filter("id = 2").first().s == 0 + 1 + 3 + 4 + 5
    k = spark.range(40).selectExpr("id", "'b' AS brand_id", "element_at(array('hot bolt', 'hot bolts', 'old hot bolt', 'ring'), int(id % 4) + 1) AS name")
    both = k.alias("x").join(k.alias("y"), F.expr("x.id <> y.id")).select(F.col("x.id").alias("id"), F.col("y.id").alias("candidate_id"), F.col("y.name").alias("candidate_name"), text.trigrams(F.col("x.name")).alias("a"), text.trigrams(F.col("y.name")).alias("b"))
    sim = both.withColumn("sim", F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).filter("sim >= 0.4")
    want = ranking.top_per_group(sim, ["id"], [F.col("sim").desc(), F.col("candidate_name"), F.col("candidate_id")], 5)
    cols = ["id", "candidate_id", "rank"]
    assert sorted(similar.clean_candidates(k, k).select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert time.monotonic() - begun < 90


def test_resolve_canonical_of_equal_names(spark):
    """Products of one slug count once, however many: no task and no broadcast holds them all."""
    p = spark.range(50000).selectExpr("id + 7 AS product_id", "'hot-bolt-7' AS slug", "'Acme Hot Bolt' AS name")
    names = spark.createDataFrame([("hot bolt 7",), ("hot bolt",), ("old hot bolt 7",), ("acme",), ("ring",)], "canonical string")
    found = matching.resolve_canonical(names, p)
    assert sorted(map(tuple, found.collect())) == [("acme", 7, 4), ("hot bolt", 7, 2), ("hot bolt 7", 7, 1), ("old hot bolt 7", 7, 3)]
    # the products are grouped before they meet the names, and never broadcast
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0


def test_suggestion_duplicates_are_all_pairs(spark):
    from loppis.operators import similar

    s = [(1, "b", "Juno 60"), (2, "b", "no"), (3, "b", ""), (4, "c", "x"), (5, "d", "y"), (6, "b", None), (7, None, "Juno"), (8, "b", "JUNO")]
    p = [(10, "b", "juno"), (11, "b", "Juno 60 synth"), (9, "b", "other one no"), (12, "c", ""), (13, "d", "z"), (14, None, "juno"), (15, "b", None)]
    got = {(r.id, r.product_id) for r in similar.suggestion_duplicates(spark.createDataFrame(s, "id int, brand_id string, name string"), spark.createDataFrame(p, "product_id int, brand_id string, name string")).collect()}
    hits = [(i, j) for i, b, x in s for j, d, y in p if b is not None and b == d and x is not None and y is not None and (x.lower() in y.lower() or y.lower() in x.lower())]
    assert got == {(i, min(j for k, j in hits if k == i)) for i, _ in hits}
