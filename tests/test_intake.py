"""Graph files, sold prices, the fetch queue, resolved pages and ticks on small tables."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from loppis.operators import graph, ingest
from loppis.streaming import ticks


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


GRAPH = {
    "version": "1.0.0",
    "categories": {
        "music-gear": {
            "brands": {
                "roland": {
                    "products": {
                        "juno-60": {"name": "Juno-60", "type": "synth", "era": "1982", "model": "Juno-60", "sku": ["J60", "Juno-60"], "ean": ["1"], "related": ["juno-106", "juno-106", "lost"], "clones": ["deep\"mind"], "price_range_dkk": [5, 9]},
                        "juno-106": {"name": "Juno-106", "model": "Juno-106", "sku": [], "reference_url": "", "price_range_dkk": [5]},
                    }
                },
                "emu": {"products": {}},
            }
        },
        "tech": {"brands": {"roland": {"products": {"deep\"mind": {"name": "Deep", "era": ""}, "juno-106": {"name": "Juno 106 (tech)", "type": ""}}}}},
        "empty": {"brands": {}},
    },
}
SYNONYMS = {"version": "1", "synonyms": {"juno 60": ["j60", "juno sixty"], "alone": []}}


def files(spark, tmp_path):
    for name, value in (("graph", GRAPH), ("synonyms", SYNONYMS)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    return graph.read_files(spark, str(tmp_path / "graph.json"), str(tmp_path / "synonyms.json"))


def test_graph_import(spark, tmp_path):
    got = graph.import_graph(*files(spark, tmp_path))
    assert sorted(rows(got["kg_category"], "slug", "name_da", "name_en")) == [("empty", "empty", "empty"), ("music-gear", "Musikudstyr", "Music Gear"), ("tech", "Teknologi", "Technology")]
    cats = dict(rows(got["kg_category"], "id", "slug"))
    # roland comes up again below tech, and the later one wins
    assert sorted((s, n, cats[i]) for s, n, i in rows(got["kg_brand"], "slug", "name", "category_id")) == [("emu", "E-mu", "music-gear"), ("roland", "Roland", "tech")]
    p = {r.slug: r for r in got["kg_product"].collect()}
    assert set(p) == {"juno-60", "juno-106", 'deep"mind'} and len({r.id for r in p.values()}) == 3
    assert (p["juno-60"].price_min_dkk, p["juno-60"].price_max_dkk, p["juno-60"].attributes, p["juno-60"].status) == (5, 9, '{"type":"synth"}', "active")
    assert (p["juno-106"].canonical_name, p["juno-106"].model_name, p["juno-106"].attributes) == ("Juno 106 (tech)", None, "{}")
    names = {r.id: s for s, r in p.items()}
    # a model that is among the SKUs is no identifier of its own; what the later juno-106 lacks is gone
    assert sorted((names[i], t, v) for i, t, v in rows(got["kg_identifier"], "product_id", "type", "value")) == [("juno-60", "EAN", "1"), ("juno-60", "SKU", "J60"), ("juno-60", "SKU", "Juno-60")]
    assert sorted((names[a], names[b], t) for a, b, t in rows(got["kg_relation"], "from_product_id", "to_product_id", "type")) == [('deep"mind', "juno-60", "clone"), ("juno-60", "juno-106", "sibling")]
    assert sorted(rows(got["synonym"], "alias", "canonical_query", "match_type", "priority")) == [("alone", "alone", "exact", 100), ("j60", "juno 60", "alias", 50), ("juno 60", "juno 60", "exact", 100), ("juno sixty", "juno 60", "alias", 50)]


def test_graph_import_again(spark, tmp_path):
    """A second import changes nothing; ids and columns that files don't set stay."""
    g, s = files(spark, tmp_path)
    first = graph.import_graph(g, s)
    old = {n: first[n] for n in ("kg_category", "kg_brand", "kg_product")}
    old["kg_product"] = old["kg_product"].withColumn("id", F.when(F.col("slug") == "juno-60", "mine").otherwise(F.col("id"))).withColumn("tier", F.lit("legendary"))
    again = graph.import_graph(g, s, old)
    assert sorted(rows(again["kg_product"], "id", "slug", "tier")) == sorted(rows(old["kg_product"], "id", "slug", "tier"))
    assert rows(again["kg_relation"].filter("type = 'clone'"), "to_product_id") == [("mine",)]


def test_graph_round_trip(spark, tmp_path):
    t = graph.import_graph(*files(spark, tmp_path))
    out = {r.category: json.loads(r.json) for r in graph.export_graph(*[t[n] for n in ("kg_category", "kg_brand", "kg_product", "kg_identifier", "kg_relation")]).collect()}
    assert out["empty"] == {"brands": {}} and out["music-gear"] == {"brands": {"emu": {"products": {}}}}
    roland = out["tech"]["brands"]["roland"]["products"]
    assert list(roland) == ['deep"mind', "juno-106", "juno-60"]
    assert roland["juno-60"] == {"name": "Juno-60", "type": "synth", "era": "1982", "related": ["juno-106"], "clones": ['deep"mind'], "price_range_dkk": [5, 9], "model": "Juno-60", "sku": ["J60", "Juno-60"], "ean": ["1"]}
    assert roland["juno-106"] == {"name": "Juno 106 (tech)"} and roland['deep"mind'] == {"name": "Deep"}
    assert rows(graph.export_synonyms(t["synonym"]), "canonical_query", "aliases") == [("juno 60", ["j60", "juno sixty"])]
    # what was exported comes in again as the same products
    back = spark.createDataFrame([(c, json.dumps({"categories": {c: v}})) for c, v in out.items()], "seq string, json string")
    read = back.select("seq", F.from_json("json", graph.GRAPH).alias("g")).select("seq", "g.categories")
    _, s = files(spark, tmp_path)
    assert sorted(rows(graph.import_graph(read, s)["kg_product"], "slug", "canonical_name", "price_max_dkk")) == sorted(rows(t["kg_product"], "slug", "canonical_name", "price_max_dkk"))


def test_empty_graph(spark):
    none = spark.createDataFrame([], graph.GRAPH)
    got = graph.import_graph(none, spark.createDataFrame([], graph.SYNONYMS))
    assert all(df.count() == 0 for df in got.values())
    assert graph.export_graph(*[got[n] for n in ("kg_category", "kg_brand", "kg_product", "kg_identifier", "kg_relation")]).count() == 0


SALE = "watchlist_id string, query string, title string, amount string, currency string, condition string, url string, published_at string, created_at string"


def test_marketplace_sold(spark):
    sales = [("w", "q", "t", "10.4", "USD", "Good", "u", None, "2024"), ("w", "q", "t", "1", "EUR", None, "v", "2023", "2024"), ("w", "q", "t", "2", "???", None, None, None, None), ("w", "q", "t", "0", "USD", None, "x", None, None), ("w", "q", "t", "x", "USD", None, "x", None, None), ("w", "q", "t", None, None, None, "x", None, None)]
    got = rows(ingest.marketplace_sold(spark.createDataFrame(sales, SALE)).orderBy("price"), "price", "currency", "condition", "listing_url", "sold_at")
    assert got == [(7.0, "DKK", None, "v", "2023"), (14.0, "DKK", None, None, None), (73.0, "DKK", "Good", "u", "2024")]


def test_ingest_keeps_the_first(spark):
    h = "listing_url string, watchlist_id string, price double, sold_at string"
    old = spark.createDataFrame([("u", "w", 1.0, "1")], h)
    new = spark.createDataFrame([("u", "w", 9.0, "0"), ("v", "w", 2.0, None), ("v", "w", 3.0, "5"), ("u", None, 4.0, "1"), ("u", None, 4.0, "1"), (None, "w", 5.0, "1")], h)
    got = sorted(rows(ingest.ingest_sold(old, new), "listing_url", "watchlist_id", "price"), key=str)
    # without a watchlist or link rows never conflict
    assert got == sorted([("u", "w", 1.0), ("v", "w", 3.0), ("u", None, 4.0), ("u", None, 4.0), (None, "w", 5.0)], key=str)


def test_auction_sold(spark):
    a = "watchlist_id string, query string, title string, amount_value string, estimate double, currency string, url string, ended string"
    sold = [("w", "q", "t", "6,513 DKK", 100.0, "SEK", "/1", "Hammered 11 Dec 2016"), ("w", "q", "t", "0 DKK", 1.0, "SEK", "/2", None), ("w", "q", "t", "No bids", 1.0, "SEK", "/3", None), ("w", "q", "t", "5 DKK", None, None, "/4", "Ended")]
    got = rows(ingest.auction_sold(spark.createDataFrame(sold, a), "https://a").orderBy("price"), "price", "listing_url", "estimate_low", F.col("sold_at").cast("string"))
    assert got[0][:3] == (5.0, "https://a/4", None) and got[0][3] is None
    assert got[1][:3] == (6513.0, "https://a/1", 65.0) and got[1][3].startswith("2016-12-11")


def test_unique_watchlists(spark):
    w = spark.createDataFrame([(2, " Juno "), (1, "juno"), (3, "JUNO 60"), (4, " "), (5, None)], "id long, query string")
    assert sorted(rows(ingest.unique_watchlists(w), "id")) == [(1,), (3,)]


def test_queue_run(spark):
    q = "id long, product_slug string, status string, created_at long, processed_at string"
    queue = spark.createDataFrame([(1, "a", "pending", 3, None), (2, "b", "pending", 1, None), (3, "lost", "pending", 1, None), (4, "c", "done", 0, "before"), (5, "d", "pending", 9, None)], q)
    p = spark.createDataFrame([(1, "a", "x", "M1"), (2, "b", "gone", "M2"), (3, "d", "x", "M3")], "id long, slug string, brand_id string, model_name string")
    landed = spark.createDataFrame([("t", "10", "USD", None, "u", None, "2024", "a"), ("t", "10", "USD", None, "u", None, "2024", "a"), ("t", "10", "USD", None, "v", None, "2024", "d")], "title string, amount string, currency string, condition string, url string, published_at string, created_at string, product_slug string")
    history = spark.createDataFrame([("u", None, "a", 1.0, None)], "listing_url string, watchlist_id string, query string, price double, sold_at string")
    got = ingest.run_queue(queue, p, spark.createDataFrame([("x", "Korg")], "id string, name string"), landed, history, F.lit("now"), most=3)
    # b's brand is gone; the fourth pending job waits
    assert sorted(rows(got["queue"], "id", "status", "processed_at")) == [(1, "done", "now"), (2, "failed", "now"), (3, "failed", "now"), (4, "done", "before"), (5, "pending", None)]
    assert rows(got["requests"], "product_slug", "search") == [("a", "Korg M1")]
    assert sorted(rows(got["history"], "listing_url", "query", "price")) == [("u", "a", 1.0), ("u", "a", 70.0), ("u", "a", 70.0)]


def test_resolutions(spark):
    p = spark.createDataFrame([("1", "Roland Juno 60", '{"type":"s","n":1,"reverb_csp_candidates":[9]}'), ("2", "Korg", None), ("3", "Moog One", "broken"), ("4", "x", '{"reverb_csp":{"csp_id":5}}')], "id string, canonical_name string, attributes string")
    f = "id string, arrival int, csp_id long, slug string, title string, image_url string, used_total long, low_amount string, low_currency string"
    found = spark.createDataFrame([("1", 0, 10, "a", "Juno 60", None, 1, "5", "EUR"), ("1", 1, 11, "b", "Roland Juno 60", None, None, "7.5", "USD"), ("1", 2, 12, "c", "Juno 60", None, 8, None, None), ("1", 3, 13, "d", "Roland Juno 60", None, 99, None, None), ("2", 0, 20, "e", "Korg MS-20", None, 1, None, None)], f)
    got = ingest.resolved_pages(p, found, F.lit("now"))
    told = {r.id: r for r in got.collect()}
    assert (told["1"].resolution.csp_id, told["1"].resolution.confidence, told["1"].resolution.used_low_price_usd) == (11, "high", 7.5)
    assert [x.csp_id for x in told["1"].candidates] == [12, 10] and told["2"].resolution.confidence == "low" and told["3"].resolution is None
    after = {r.id: json.loads(r.attributes) for r in ingest.with_resolutions(p, got.filter("id <> '4'"), F.lit("now")).collect()}
    assert after["1"]["type"] == "s" and after["1"]["n"] == 1 and after["1"]["reverb_csp"]["csp_id"] == 11 and len(after["1"]["reverb_csp_candidates"]) == 2
    assert after["3"] == {"reverb_csp": {"resolved_at": "now", "confidence": "none"}} and after["4"] == {"reverb_csp": {"csp_id": 5}}
    done = ingest.with_resolutions(p, got, F.lit("now")).withColumn("reverb_csp_id", F.when(F.col("id") == "2", "own"))
    assert dict(rows(ingest.promoted(done), "id", "reverb_csp_id")) == {"1": "11", "2": "own", "3": None, "4": None}
    assert sorted(rows(ingest.unresolved(ingest.with_resolutions(p, got, F.lit("now"))), "id")) == [("3",), ("4",)]
    # candidates of an earlier run go when there are none now
    once = ingest.with_resolutions(p, ingest.resolved_pages(p, found.filter("arrival = 0"), F.lit("now")), F.lit("now"))
    assert "reverb_csp_candidates" not in json.loads(once.filter("id = '1'").first().attributes)


DAY = dt.datetime(2024, 1, 1)
L = "id string, url string, watchlist_id long, title string, price double, scraped_at timestamp, notified_at timestamp"


def test_watch(spark):
    """Caps spare followed pages, old listings never told of are told of, marks hold, and matches come once."""
    lists = spark.createDataFrame([(1, "ann", "q", True, "query", 100.0), (2, "bo", "p", True, "listing", 1.0), (3, "cy", "r", False, "query", None), (4, "di", "s", True, "query", 5.0)], "id long, user_id string, query string, active boolean, type string, max_price double")
    was = spark.createDataFrame([("a", "a", 1, "old", 5.0, DAY, None), ("b", "b", 1, "told", 5.0, DAY, DAY), ("c", "c", 4, "waits", 5.0, DAY, None), ("z", "z", None, "nobody's", 5.0, DAY, None)], L)
    now = DAY + dt.timedelta(1)
    new = [("b", "b", 1, "told again juno-60", 6.0, now)] + [(f"n{i}", f"n{i}", 1, f"n{i}", None, now) for i in range(6)] + [("dear", "dear", 1, "dear", 101.0, now), ("p", "p", 2, "page", 99.0, now), ("x", "x", 3, "x", 1.0, now), ("y", "y", 4, "y", 6.0, now)]
    batch = spark.createDataFrame(new, "id string, url string, watchlist_id long, title string, price double, scraped_at timestamp")
    ids = spark.createDataFrame([(7, "juno-60", "SKU", 1)], "product_id long, value string, type string, seq long")
    none = [spark.createDataFrame([], ddl) for ddl in ("product_id long, alias string, match_type string, priority int, seq long", "product_id long, model string, seq long")]
    matches = spark.createDataFrame([], "listing_id string, product_id long, method string, score int, explain string")
    got = ticks.watch(batch, was, lists, matches, ids, *none)
    assert sorted(rows(got["snapshots"], "url")) == sorted([("b",), ("p",), *((f"n{i}",) for i in range(6))])
    # a comes from an earlier run that told nobody; c's watchlist has nothing new below its cap
    assert sorted(rows(got["alerts"], "url")) == sorted([("a",), ("p",), *((f"n{i}",) for i in range(6))])
    marks = dict(rows(got["listings"], "url", "notified_at"))
    assert marks["a"] == now and marks["b"] == DAY and marks["c"] is None and marks["z"] is None and "dear" not in marks
    assert rows(got["matches"], "listing_id", "product_id") == [("b", 7)]
    told = {r.watchlist_id: r for r in got["digests"].collect()}
    assert (told[1].user_id, told[1].n_new, told[1].digest) == ("ann", 7, "n0\nn1\nn2\nn3\nn4\n…and 2 more") and told[2].digest == "page" and len(told) == 2
    again = ticks.watch(batch, got["listings"], lists, got["matches"], ids, *none)
    assert again["alerts"].count() == 0 and again["matches"].count() == 1


def test_gzipped_files_are_read(spark, tmp_path):
    with gzip.open(tmp_path / "graph.json.gz", "wt") as f:
        json.dump(GRAPH, f)
    (tmp_path / "synonyms.json").write_text(json.dumps(SYNONYMS))
    g, _ = graph.read_files(spark, str(tmp_path / "graph.json.gz"), str(tmp_path / "synonyms.json"))
    assert g.first().version == "1.0.0"
