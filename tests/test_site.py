"""Page operators and the typed model on small tables: nulls, ties, cuts, empty tables."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from loppis.operators import constraints, pages
from loppis.schemas import DISTINCT, NOT_DISTINCT, PARTIAL, TABLES, Key, Reference, Table


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


c = F.col
DAY = dt.datetime(2024, 1, 1)
LISTING = "id long, price double, is_active boolean, scraped_at timestamp, watchlist_id long, image_url string, notified_at timestamp"
PRODUCT = "id long, slug string, canonical_name string, brand_id string, status string, tier string, subcategory_id int, image_url string, thomann_url string, thomann_price_dkk int, related array<string>"


# --- product page -----------------------------------------------------------------------------------------------------


def test_ranked_listings(spark):
    m = spark.createDataFrame([(1, 10, 90), (1, 11, 90), (1, 12, 95), (1, 13, 70), (1, 14, None), (1, 99, 99), (2, 10, 50)], "product_id long, listing_id long, score int")
    ls = spark.createDataFrame([(10, 5.0, True, DAY, None, None, None), (11, None, None, DAY, None, None, None), (12, 1.0, False, DAY, None, None, None), (13, 9.0, True, DAY, None, None, None), (14, 1.0, True, DAY, None, None, None)], LISTING)
    got = rows(pages.ranked_listings(m, ls), "product_id", "place", "listing_id")
    # 12 is gone and 99 is unknown; 11 has no price; an unknown state is shown; a missing score comes last
    assert sorted(got) == [(1, 1, 10), (1, 2, 11), (1, 3, 13), (1, 4, 14), (2, 1, 10)]
    # the cut comes before the filter: 99 and 12 take both places of it
    assert rows(pages.ranked_listings(m, ls, taken=2).filter("product_id = 1"), "listing_id") == []
    assert rows(pages.ranked_listings(m.limit(0), ls), "place") == []


def test_sold_series(spark):
    s = "product_id long, sold_at timestamp, price double, condition string"
    a = spark.createDataFrame([(1, DAY, 5.0, "B"), (1, DAY, 4.0, None), (1, None, 1.0, "A"), (2, DAY, 1.0, "A")], s)
    b = spark.createDataFrame([(1, DAY, 1.0, "A"), (1, DAY - dt.timedelta(1), 7.0, "A")], s)
    got = rows(pages.sold_series(a, b, "product_id").filter("product_id = 1").orderBy("place"), "place", "price", "source")
    assert got == [(1, 7.0, "auctionet"), (2, 4.0, "reverb"), (3, 5.0, "reverb"), (4, 1.0, "auctionet")]
    cut = rows(pages.sold_series(a, b, "product_id", most=1).filter("product_id = 1"), "price", "source")
    assert sorted(cut) == [(4.0, "reverb"), (7.0, "auctionet")]


def product(i, name="n", status="active", tier="standard", sub=1, image=None, url=None, price=None, related=None, brand="b"):
    return (i, f"p{i}", name, brand, status, tier, sub, image, url, price, related)


def test_related_products(spark):
    p = spark.createDataFrame([product(1, related=["p2", "p2", "gone", "p3", "p1", "p2", "p4"]), product(2, related=None), product(3, related=[]), product(4)], PRODUCT)
    assert sorted(rows(pages.related_products(p), "id", "place", "slug")) == [(1, 1, "p2"), (1, 4, "p3"), (1, 5, "p1")]


def test_product_pages(spark):
    p = spark.createDataFrame([product(1, related=["p2"]), product(2, brand="none")], PRODUCT)
    b = spark.createDataFrame([("b", "Brand")], "id string, name string")
    m = spark.createDataFrame([(1, 10, 90)], "product_id long, listing_id long, score int")
    ls = spark.createDataFrame([(10, 5.0, True, DAY, None, None, None)], LISTING)
    s = "product_id long, sold_at timestamp, price double, condition string"
    sold = spark.createDataFrame([(1, DAY, x, "A") for x in (0.0, 10.0, 11.0, 13.0, 500.0, 12.0)], s)
    got = {r.id: r for r in pages.product_pages(p, b, m, ls, sold, sold.limit(0)).collect()}
    assert (got[1].brand_name, got[1].low, got[1].high, got[1].median, got[1].n_prices) == ("Brand", 10.0, 13.0, 12, 4)
    assert len(got[1].price_history) == 6 and got[1].listings[0].listing_id == 10 and got[1].related_products[0].slug == "p2"
    assert (got[2].brand_name, got[2].low, got[2].listings, got[2].price_history) == (None, None, None, None)


def test_market_prices(spark):
    a = spark.createDataFrame([("p1", 1.0), ("p1", 5.0), ("p2", 1.0), ("p2", 2.0), (None, 1.0)], "query string, price double")
    b = spark.createDataFrame([("p1", 3.0), ("p2", 0.0), ("p2", None)], "query string, price double")
    assert rows(pages.market_prices(a, b), "query", "min", "max", "count") == [("p1", 1.0, 5.0, 3)]
    p = spark.createDataFrame([product(1), product(2)], PRODUCT)
    m = spark.createDataFrame([(7, 2, 50), (7, 1, 90), (8, 2, 90), (8, 1, 90), (9, 5, 99)], "listing_id long, product_id long, score int")
    # 8 is a tie, which the smaller product wins; 9 matches a product that is not there
    assert sorted(rows(pages.listing_market_prices(m, p, a, b), "listing_id", "slug", "min")) == [(7, "p1", 1.0), (8, "p1", 1.0)]


# --- browsing ---------------------------------------------------------------------------------------------------------

CATEGORY = "id int, slug string, parent_id int, name_en string, name_da string, domain string, image_url string"


@pytest.fixture(scope="module")
def shop(spark):
    cats = [(100, "gear", None, "Gear", "g", "music", "vertical.png"), (101, "keys", None, "Keys", "k", "music", "own.png"), (102, "drums", None, "Drums", "d", "music", None), (103, "chairs", None, "C", "c", "design", None), (104, "empty", None, "E", "e", "music", None)]
    cats += [(1, "keys/synths", 101, "Synths", "s", "music", None), (2, "keys/organs", 101, "Organs", "o", "music", None), (3, "drums/snares", 102, "Snares", "sn", "music", None), (4, "plain", 102, None, None, "music", None), (5, "chairs/x", 103, "X", "x", "design", None)]
    products = [product(i, sub=1, tier="classic") for i in range(1, 4)] + [product(4, sub=2), product(5, sub=2), product(6, sub=3, tier="legendary"), product(7, sub=4, tier="legendary", status="inactive"), product(8, sub=5, tier="classic"), product(9, sub=None, tier="classic"), product(10, sub=3), product(11, sub=4, tier="classic", brand="lost")]
    counts = spark.createDataFrame([(4, 2), (10, 1), (7, 9)], "product_id long, active_listing_count long")
    return spark.createDataFrame(cats, CATEGORY), spark.createDataFrame(products, PRODUCT), spark.createDataFrame([("b", "Brand")], "id string, name string"), counts


def test_active_counts(spark):
    m = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 11)], "product_id long, listing_id long")
    ls = spark.createDataFrame([(10, 1.0, True, DAY, None, None, None), (11, 1.0, None, DAY, None, None, None), (12, 1.0, False, DAY, None, None, None)], LISTING)
    assert rows(pages.active_counts(m, ls), "product_id", "active_listing_count") == [(1, 1)]  # a state that is not known is not active here


def test_browse(shop):
    cats, products, brands, counts = shop
    got = rows(pages.browse_roots(cats, products, counts, vertical="gear", heirs=("keys",), fallback="s").orderBy("place"), "place", "slug", "product_count", "image_url")
    # 11 counts here though its brand is lost; the page of a root shows only products with a brand
    assert got == [(1, "keys", 4, "vertical.png"), (2, "drums", 3, "s/categories/drums.webp")]
    members = pages.root_members(cats, products, brands, counts)
    tops = rows(pages.root_products(members, most=3).orderBy("root_slug", "place"), "root_slug", "place", "slug", "subcategory_slug", "active_listing_count")
    assert tops == [("drums", 1, "p10", "snares", 1), ("drums", 2, "p6", "snares", 0), ("keys", 1, "p4", "organs", 2), ("keys", 2, "p1", "synths", 0), ("keys", 3, "p2", "synths", 0)]
    assert sorted(rows(pages.root_pills(members), "root_slug", "place", "slug", "n")) == [("drums", 1, "snares", 2), ("keys", 1, "synths", 3)]


def test_discover(shop):
    _, products, brands, counts = shop
    got = rows(pages.discover(products, brands, counts, busiest=2), "shelf", "place", "slug", "active_listing_count")
    # 7 is among the two busiest but inactive, so one popular product is left
    assert sorted(got) == [("legendary", 1, "p6", 0), ("popular", 1, "p4", 2)]


# --- watchlists and saved listings ------------------------------------------------------------------------------------


def test_words_within_is_every_pair(spark):
    r = random.Random(1)
    letters = "abÅ- "
    text = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    queries = [(i, text(8)) for i in range(60)] + [(60, None), (61, "a%b"), (62, "AB ab")]
    names = [(i, text(14)) for i in range(60)] + [(60, None), (61, "xa%by"), (62, "ab")]
    got = pages.words_within(spark.createDataFrame(queries, "q long, query string"), spark.createDataFrame(names, "n long, name string"), "q", "n")
    want = []
    for i, q in queries:
        words = [w for w in (q or "").lower().split() if len(w) > 1]
        want += [(i, j) for j, n in names if words and n is not None and all(w in n.lower() for w in words)]
    assert sorted(rows(got, "q", "n")) == sorted(want)
    assert len(want) > 20


def test_first_within_is_the_head_of_every_pair(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abÅ- ") for _ in range(r.randint(0, n)))
    queries = [(i, text(4)) for i in range(80)] + [(80, None)]
    names = [(i, text(8)) for i in range(300)] + [(300, None)]
    q, n = spark.createDataFrame(queries, "q long, query string"), spark.createDataFrame(names, "n long, name string")
    want = {}
    for i, j in sorted(rows(pages.words_within(q, n, "q", "n"), "q", "n")):
        want.setdefault(i, []).append(j)
    got = rows(pages.answered(q, pages.first_within(q, n, "n", 3)), "q", "rank", "n")
    assert sorted(got) == sorted((i, k + 1, j) for i, js in want.items() for k, j in enumerate(js[:3]))
    assert max(map(len, want.values())) > 10


def test_search_of_equal_texts_and_equal_names(spark):
    """30000 queries of one text and 30000 products of one name: the 900 million pairs are never made."""
    begun = time.monotonic()
    q = spark.range(30000).select(c("id").alias("query_id"), F.lit("hot bolt").alias("query"))
    p = spark.range(30000).selectExpr("id", "'Hot Bolt' AS canonical_name", "'active' AS status", "concat('u', id) AS thomann_url", "1 AS thomann_price_dkk", "CAST(NULL AS STRING) AS image_url")
    hits = pages.catalogue_hits(q, p).groupBy("query_id").agg(F.max("position").alias("n"), F.max("url").alias("last"))
    assert rows(hits.groupBy("n", "last").count(), "n", "last", "count") == [(5, "u4", 30000)]
    held = pages.stored_hits(q, p.selectExpr("id", "canonical_name AS title", "'reverb' AS source", "true AS is_active", "thomann_url AS url", "1.0 AS price", "image_url"))
    assert held.count() == 20 * 30000
    assert time.monotonic() - begun < 60


def test_watchlist_cards(spark):
    w = spark.createDataFrame([(1, "MOOG one"), (2, "roland"), (3, "https://x/moog"), (4, "a"), (5, "korg"), (6, "nothing")], "id long, query string")
    p = spark.createDataFrame(
        [product(9, "Moog One", image=r"img\/9"), product(8, "moog one xl", image="img/8"), product(7, "Moog One", status="inactive", image="x"), product(3, "Roland", image="x/sbpics/3"), product(5, "Roland B", image="img/5"), product(4, "Korg", image=None)], PRODUCT
    )
    late = DAY + dt.timedelta(1)
    ls = spark.createDataFrame(
        [(1, 5.0, True, DAY, 2, "old", None), (2, 1.0, True, late, 2, "new", late), (3, None, True, None, 5, "undated", None), (4, 9.0, True, None, 5, None, None), (5, 9.0, True, DAY, 3, "link", None), (6, 1.0, True, DAY, None, "nobody", None)], LISTING
    )
    got = sorted(rows(pages.watchlist_cards(w, ls, p), "id", "new_count", "preview_image_url"))
    # the first product named by "roland" shows a portrait, so the latest listing's image is taken
    assert got == [(1, 0, "img/8"), (2, 1, "new"), (3, 1, "link"), (4, 0, None), (5, 2, "undated"), (6, 0, None)]


def test_watchlist_listings(spark):
    ls = spark.createDataFrame([(i, 1.0, True, None if i == 3 else DAY + dt.timedelta(i % 2), 1, None, None) for i in range(5)] + [(9, 1.0, True, DAY, None, None, None)], LISTING)
    got = rows(pages.watchlist_listings(ls, size=2).orderBy("page", "place"), "id", "page", "place", "total", "total_pages")
    assert got == [(1, 1, 1, 5, 3), (0, 1, 2, 5, 3), (2, 2, 1, 5, 3), (4, 2, 2, 5, 3), (3, 3, 1, 5, 3)]
    assert rows(pages.watchlist_listings(ls, size=1000).agg(F.max("page")), "max(page)") == [(1,)]


def test_saved_and_queue(spark):
    saved = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 13)], "user_id long, listing_id long")
    m = spark.createDataFrame([(10, 1, 50), (10, 2, 90), (11, 1, 50), (12, 77, 99), (12, 3, 1)], "listing_id long, product_id long, score int")
    p = spark.createDataFrame([product(1, price=5), product(2), product(3)], PRODUCT)
    got = sorted(rows(pages.saved_cards(saved, m, p), "listing_id", "product_slug", "thomann_price_dkk"), key=str)
    assert got == [(10, "p2", None), (11, "p1", 5), (12, "p3", None), (13, None, None)]
    sold = spark.createDataFrame([("p1",)] * 4 + [("p2",)] * 5, "query string")
    queue = spark.createDataFrame([("p3", "pending"), ("p1", "done")], "product_slug string, status string")
    assert rows(pages.queue_requests(saved, m, p, sold, queue), "product_slug", "status") == [("p1", "pending")]


def test_user_rollup(spark):
    users = spark.createDataFrame([(1, "a"), (2, None)], "id long, email string")
    w = spark.createDataFrame([(1,), (1,), (7,)], "user_id long")
    assert sorted(rows(pages.user_rollup(users, w, w.limit(0)), "id", "watchlist_count", "saved_count")) == [(1, 2, 0), (2, 0, 0)]


# --- search -----------------------------------------------------------------------------------------------------------


def test_search_results(spark):
    s = "query_id long, position int, title string, url string, price double, image_url string"
    hit = lambda q, n, u: (q, n, f"t{u}", u, 1.0, None)
    cat = spark.createDataFrame([hit(1, 1, "c"), hit(1, 2, "d")], s)
    scraped = spark.createDataFrame([hit(1, 1, "d"), hit(1, 2, "e"), hit(1, 3, "f"), hit(1, 4, "e"), hit(1, 5, "g"), hit(3, 1, "z")], s)
    held = spark.createDataFrame([hit(1, 1, "e"), hit(1, 2, "h"), hit(2, 1, "h")], s)
    got = rows(pages.search_results(cat, scraped, held).orderBy("query_id", "place"), "query_id", "kind", "url")
    assert got == [(1, "catalogue", "c"), (1, "catalogue", "d"), (1, "scraped", "e"), (1, "stored", "h"), (1, "scraped", "f"), (1, "scraped", "g"), (2, "stored", "h"), (3, "scraped", "z")]


def test_hits(spark):
    asked = spark.createDataFrame([(1, " juno  60"), (2, "x"), (3, "JX-8P")], "query_id long, query string")
    p = spark.createDataFrame([product(1, "Roland Juno 60", url="u1", price=5, image="a/sbpics/b"), product(2, "Juno 60", url=None, price=5), product(3, "juno-60 mk2", url="u3", price=1, image=r"a\/b"), product(4, "Juno 60", url="u4", price=1, status="inactive")], PRODUCT)
    got = rows(pages.catalogue_hits(asked, p).orderBy("position"), "query_id", "position", "url", "image_url")
    assert got == [(1, 1, "u1", None), (1, 2, "u3", "a/b")]
    titled = "id long, title string, source string, is_active boolean, url string, price double, image_url string"
    ls = spark.createDataFrame([(1, "Juno-60", "reverb", True, "a", 1.0, None), (2, "juno 106", "reverb", True, "b", 1.0, None), (3, "Juno 6 0", "reverb", True, "c", 1.0, None), (4, "Juno 60", "reverb", None, "d", 1.0, None), (5, "Juno 60", "dba.dk", True, "e", 1.0, None), (6, "Roland JX8P", "reverb", True, "f", 1.0, None)], titled)
    # JX-8P is sought with its hyphen first, so a title without one is not found
    assert rows(pages.stored_hits(asked, ls).orderBy("position"), "query_id", "position", "url") == [(1, 1, "a"), (1, 2, "c")]
    assert rows(pages.stored_hits(asked, ls, taken=2), "query_id", "url") == [(1, "a")]


def test_shop_rows(spark):
    s = "query_id long, position int, title string, url string, price double, image_url string"
    hits = spark.createDataFrame([(2, 1, "B", "u", 2.0, None), (1, 1, "A", "u", 1.0, None), (1, 2, "V", "v", 1.0, None)], s)
    got = pages.shop_listings(hits, F.lit(DAY))
    assert sorted(rows(got, "title", "currency", "source", "condition")) == [("A", "DKK", "thomann", "Ny"), ("V", "DKK", "thomann", "Ny")]
    assert rows(got.select(F.length("id")).distinct(), "length(id)") == [(36,)]
    old = spark.createDataFrame([("u", "old", 9.0), ("w", "kept", 9.0)], "thomann_url string, canonical_name string, price_dkk double")
    assert sorted(rows(pages.shop_prices(hits, old, F.lit(DAY)), "thomann_url", "canonical_name", "price_dkk")) == [("u", "A", 1.0), ("v", "V", 1.0), ("w", "kept", 9.0)]


# --- the model --------------------------------------------------------------------------------------------------------


def test_models_are_consistent():
    for t in TABLES.values():
        names = set(t.schema.names)
        assert len(names) == len(t.schema.names)
        assert {c for k in t.keys for c in (*k.columns, *k.where)} <= names
        assert set(t.enums) | set(t.ranges) | set(t.defaults) <= names
        for r in t.references:
            assert r.column in names and r.key in TABLES[r.table].schema.names
            # a reference that is set to null must be able to be null
            assert r.on_delete != "set null" or t.schema[r.column].nullable
        assert all(t.defaults[c] in v for c, v in t.enums.items() if c in t.defaults)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_empty_table_conforms(spark, name):
    model = TABLES[name]
    got = constraints.conform(spark.createDataFrame([], "nothing string"), model)
    assert got.schema.names == model.schema.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in model.schema]
    assert constraints.valid(got, model).count() == 0


def test_conform(spark):
    raw = spark.createDataFrame([(1, "12", None, "x"), (2, "many", "SEK", "y")], "id long, price string, currency string, extra string")
    got = rows(constraints.conform(raw, TABLES["listings"]).orderBy("id"), "id", "price", "currency", "source", "is_active", "title")
    # a default stands in for a missing column, not for a null; what is no number becomes null
    assert got == [("1", 12, None, "dba.dk", True, None), ("2", None, "SEK", "dba.dk", True, None)]


def test_row_rules(spark):
    model = TABLES["kg_identifier"]
    df = spark.createDataFrame([("1", "p", "EAN", "v", 80, "seed"), ("2", None, "ISBN", "v", 101, "seed"), ("3", "p", None, "v", None, "seed")], "id string, product_id string, type string, value string, confidence smallint, source string")
    got = dict(rows(constraints.with_broken(df, model), "id", "broken"))
    assert got == {"1": [], "2": ["product_id is missing", "type is none of its values", "confidence is out of range"], "3": ["type is missing", "confidence is missing"]}
    assert rows(constraints.valid(df, model), "id") == [("1",)]
    free = Table("free", df.schema)
    assert constraints.with_broken(df, free).filter(F.size("broken") > 0).count() == 0 and constraints.valid(df, free).count() == 3


def test_repeated_keys(spark):
    df = spark.createDataFrame([("u", "w"), ("u", "w"), ("u", None), ("u", None), (None, None), (None, None)], "url string, watchlist_id string")
    key = ("url", "watchlist_id")
    assert rows(constraints.repeated_keys(df, Key(key, DISTINCT)), *key, "n") == [("u", "w", 2)]
    assert sorted(rows(constraints.repeated_keys(df, Key(key, NOT_DISTINCT)), *key, "n"), key=str) == [("u", "w", 2), ("u", None, 2), (None, None, 2)]
    assert rows(constraints.repeated_keys(df, Key(("url",), PARTIAL, ("watchlist_id",))), "url", "n") == [("u", 2)]
    with pytest.raises(ValueError):
        constraints.repeated_keys(df, Key(key, "what"))


def test_report(spark):
    brands = spark.createDataFrame([("1", "a", "A", None), ("1", "b", None, "9")], "id string, slug string, name string, category_id string")
    cats = constraints.conform(spark.createDataFrame([("5", "s")], "id string, slug string"), TABLES["kg_category"])
    got = sorted(rows(constraints.report({"kg_brand": brands, "kg_category": cats}, TABLES), "table", "rule", "n"))
    assert got == [("kg_brand", "category_id is in no kg_category", 1), ("kg_brand", "id repeats", 1), ("kg_brand", "name is missing", 1)]


def test_delete_parents(spark):
    """Rows go with their parent, in turn with their own children; a restricted reference keeps the parent."""
    t = lambda data, ddl: spark.createDataFrame(data, ddl)
    tables = {
        "watchlists": t([("w1",), ("w2",), ("w3",)], "id string"),
        "listings": t([("l1", "w1", "b1"), ("l2", "w2", "b1"), ("l3", None, None), ("l4", "w3", None)], "id string, watchlist_id string, brand_id string"),
        "listing_product_match": t([("l1", "p1"), ("l2", "p1")], "listing_id string, product_id string"),
        "price_observation": t([("o1", "l1"), ("o2", "l2")], "id string, listing_id string"),
    }
    got = constraints.delete_parents("watchlists", t([("w1",), ("w1",), ("w9",)], "id string"), tables, TABLES)
    assert sorted(rows(got["watchlists"], "id")) == [("w2",), ("w3",)]
    assert sorted(rows(got["listings"], "id")) == [("l2",), ("l3",), ("l4",)]
    assert rows(got["listing_product_match"], "listing_id") == [("l2",)]
    assert sorted(rows(got["price_observation"], "id", "listing_id")) == [("o1", None), ("o2", "l2")]
    brands = {"kg_brand": t([("b1",), ("b2",)], "id string"), "kg_product": t([("p", "b1")], "id string, brand_id string")}
    assert rows(constraints.delete_parents("kg_brand", t([("b1",), ("b2",)], "id string"), brands, TABLES)["kg_brand"], "id") == [("b1",)]
    tree = {"kg_category": t([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")}
    assert sorted(rows(constraints.delete_parents("kg_category", t([("a",)], "id string"), tree, TABLES)["kg_category"], "id", "parent_id"), key=str) == [("b", None), ("c", "b")]


def test_row_security(spark):
    ws = spark.createDataFrame([(1, "ann"), (2, "bo"), (3, None)], "id long, user_id string")
    ls = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None), (14, 9)], "listing long, watchlist_id long")
    assert rows(constraints.own_rows(ws, F.lit("ann")), "id") == [(1,)]
    assert rows(constraints.own_rows(ws, F.lit(None)), "id") == []
    assert sorted(rows(constraints.visible_pairs(ls, ws.filter("user_id IS NOT NULL"), "watchlist_id"), "listing", "viewer")) == [(10, "ann"), (11, "bo")]
    assert rows(constraints.visible_to(ls, ws, "watchlist_id", F.lit("bo")), "listing") == [(11,)]
    prefs = spark.createDataFrame([("ann", True), ("ann", True), ("bo", False), ("cy", None)], "user_id string, is_admin boolean")
    assert rows(constraints.admin_pairs(ws, prefs), "id", "viewer") == [(1, "ann"), (2, "ann"), (3, "ann")]
    assert rows(constraints.admin_pairs(ws, prefs.limit(0)), "id") == []


def test_orphans(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 5)], "k long, ref long")
    parent = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    assert rows(constraints.orphans(child, parent, Reference("ref", "t")), "k") == [(3,)]
    assert math.isclose(constraints.orphans(child, parent.limit(0), Reference("ref", "t")).count(), 2)
