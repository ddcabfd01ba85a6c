"""The review desk on small tables: order of decisions, refusals, nulls, repeated and empty input."""

import pytest
from pyspark.sql import functions as F

from loppis.operators import review

S = "id string, canonical_name string, brand_id string, category_id string, status string, reviewed_by string, reviewed_at long, notes string"
P = "id string, slug string, canonical_name string, model_name string, brand_id string, category_id string, status string, tier string, cleanup_status string"
Y = "alias string, product_id string, canonical_query string, match_type string, lang string, priority int"
M = "listing_id string, product_id string, method string, score int, explain string"
D = "id string, action string, canonical_name string, model_name string, product_id string, reviewer string, decided_at long"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def suggestion(i, name, brand="b"):
    return (i, name, brand, "c", "pending", None, None, "n")


def product(i, slug, name=None, **more):
    return (i, slug, name or slug, None, "b", "c", more.get("status", "active"), more.get("tier", "standard"), more.get("cleanup"))


@pytest.fixture(scope="module")
def desk(spark):
    make = spark.createDataFrame
    return {
        "suggestions": make([suggestion("1", "Juno 60"), suggestion("2", "JUNO-60!"), suggestion("3", "Space Echo"), suggestion("4", "日本"), suggestion("5", "Juno-6"), suggestion("6", "x")], S),
        "products": make([product("p", "space-echo"), product("q", "juno-106")], P),
        "synonyms": make([("Space Echo", "p", "space-echo", "alias", "da", 9), ("Space Echo", None, None, "alias", "da", 9)], Y),
        "matches": make([("a", "z", "SYNONYM", 80, '{"matched_alias":"JUNO 60"}'), ("b", "z", "SYNONYM", 80, '{"matched_alias":"juno 6"}'), ("b", "q", "SKU", 95, None), ("c", "z", "SKU", 95, '{"matched_identifier":"日本"}'), ("d", "z", "SKU", 95, None)], M),
    }


def decide(spark, desk, *decisions):
    return review.decide(*[desk[n] for n in ("suggestions", "products", "synonyms", "matches")], spark.createDataFrame(list(decisions), D))


def test_approve(spark, desk):
    got = decide(spark, desk, ("1", "approve", None, " J60 ", None, "ann", 2), ("2", "approve", "", "", None, "bo", 1), ("3", "approve", None, None, None, "ann", 3), ("6", "approve", "Juno 60", None, None, "ann", 4), ("9", "approve", None, None, None, "ann", 5), ("5", "approve", "Jupiter 8", None, None, "cy", 6))
    # 2 comes first and takes the slug that 1 and 6 want; 3's is a product's already; 9 is unknown
    assert sorted(rows(got["refused"], "id", "reason")) == [("1", "slug is taken"), ("3", "slug is taken"), ("6", "slug is taken"), ("9", "no such suggestion")]
    new = got["products"].filter("id NOT IN ('p', 'q')")
    assert sorted(rows(new, "slug", "canonical_name", "model_name", "brand_id", "status", "tier")) == [("juno-60", "JUNO-60!", None, "b", "active", "standard"), ("jupiter-8", "Jupiter 8", None, "b", "active", "standard")]
    told = {r.id: r for r in got["suggestions"].collect()}
    assert (told["2"].status, told["2"].reviewed_by, told["2"].reviewed_at) == ("approved", "bo", 1)
    assert told["5"].canonical_name == "Jupiter 8"
    assert (told["1"].status, told["1"].reviewed_by) == ("pending", None)
    assert got["matches"].count() == 5 and got["synonyms"].count() == 2


def test_edit_reject_send_back(spark, desk):
    first = decide(spark, desk, ("1", "reject", None, None, None, "ann", 1), ("2", "edit", "New", None, None, "ann", 1), ("3", "edit", "", None, None, "ann", 1), ("4", "what", None, None, None, "ann", 1), ("5", None, None, None, None, "ann", 1), ("1", "approve", None, None, None, "ann", 2))
    told = {r.id: (r.canonical_name, r.status, r.reviewed_by, r.notes) for r in first["suggestions"].collect()}
    assert told["1"] == ("Juno 60", "rejected", "ann", "n") and told["2"] == ("New", "pending", None, "n")
    assert sorted(rows(first["refused"], "id", "reason")) == [("3", "no name"), ("4", "unknown action"), ("5", "unknown action")]
    again = decide(spark, desk | {"suggestions": first["suggestions"]}, ("1", "send-back", None, None, None, "ann", 3))
    assert rows(again["suggestions"].filter("id = '1'"), "status", "reviewed_by", "reviewed_at", "notes") == [("pending", None, None, None)]


def test_merge(spark, desk):
    got = decide(spark, desk, ("1", "merge", None, None, "q", "ann", 2), ("5", "merge", None, None, "p", "ann", 1), ("3", "merge", None, None, "p", "ann", 1), ("4", "merge", None, None, "p", "ann", 1), ("6", "merge", None, None, "lost", "ann", 1))
    assert rows(got["refused"], "id", "reason") == [("6", "no such product")]
    # "juno 6" is part of both explanations and its merge came first; a name without letters or digits explains nothing
    assert sorted(rows(got["matches"], "listing_id", "product_id"), key=str) == [("a", "p"), ("b", "p"), ("b", "q"), ("c", "z"), ("d", "z")]
    new = got["synonyms"].filter("lang = 'en'")
    assert sorted(rows(new, "alias", "product_id", "canonical_query", "priority"), key=str) == [("Juno 60", "q", None, 50), ("Juno-6", "p", None, 50), ("日本", "p", None, 50)]
    assert rows(got["suggestions"].filter("id = '1'"), "status", "notes") == [("approved", "merged into juno-106")]


def test_merged_matches_stay_unique(spark, desk):
    """A listing that the target has already keeps the stronger match."""
    twice = spark.createDataFrame([("a", "z", "SYNONYM", 80, '{"matched_alias":"juno 60"}'), ("a", "q", "FUZZY", 70, None)], M)
    got = decide(spark, desk | {"matches": twice}, ("1", "merge", None, None, "q", "ann", 1))
    assert rows(got["matches"], "listing_id", "product_id", "score") == [("a", "q", 80)]


G = "group_id string, product_id string, canonical_name string, model_name string, brand_id string, category_id string, suggestion_ids array<string>, variant_names array<string>, reviewer string, decided_at long"


def test_groups(spark, desk):
    groups = [
        ("g1", None, "Juno 60", "J", "b", "c", ["1", "2"], ["juno 60", "JUNO-60!", "JUNO-60!"], "ann", 2),
        ("g2", None, "JUNO-60", None, "b", "c", ["5"], [], "ann", 3),
        ("g3", "p", None, None, None, None, ["2", "3"], ["Space Echo", "RE-201"], "bo", 3),
        ("g4", "lost", None, None, None, None, ["3"], None, "bo", 1),
        ("g5", None, "X", None, None, None, ["3"], None, "bo", 1),
        ("g6", None, "Y", None, "b", None, None, None, "bo", 1),
        ("g7", None, "Z", None, "b", None, ["6"], None, "bo", 1),
    ]
    got = review.decide_groups(desk["suggestions"], desk["products"], desk["synonyms"], spark.createDataFrame(groups, G))
    assert sorted(rows(got["refused"], "group_id", "reason")) == [("g2", "slug is taken"), ("g4", "no such product"), ("g5", "missing fields"), ("g6", "missing fields")]
    told = {r.id: (r.status, r.notes) for r in got["suggestions"].collect()}
    assert told["1"] == told["2"] == ("approved", "bulk approved → juno-60")
    assert told["3"] == ("approved", "bulk merged → space-echo") and told["5"] == ("pending", "n") and told["6"][0] == "approved"
    made = {r.slug: r.id for r in got["products"].collect()}
    assert set(made) == {"space-echo", "juno-106", "juno-60", "z"}
    new = sorted(rows(got["synonyms"].filter("lang = 'en'"), "alias", "product_id", "canonical_query"))
    assert new == [("JUNO-60!", made["juno-60"], "juno-60"), ("RE-201", "p", "space-echo")]


def test_no_decisions(spark, desk):
    got = review.decide(*[desk[n] for n in ("suggestions", "products", "synonyms", "matches")], spark.createDataFrame([], D))
    assert got["suggestions"].count() == 6 and got["products"].count() == 2 and got["matches"].count() == 5 and got["refused"].count() == 0
    none = review.decide_groups(desk["suggestions"], desk["products"], desk["synonyms"], spark.createDataFrame([], G))
    assert none["suggestions"].count() == 6 and none["refused"].count() == 0


def test_mining(spark):
    brands = spark.createDataFrame([("1", "Roland ", "k"), ("2", "Roland Boss", "p"), ("3", "Korg", None)], "id string, name string, category_id string")
    known = spark.createDataFrame([("korg ms-20",)], "canonical_name string")
    titles = [(1, "Roland JUNO 60"), (2, " roland juno 60"), (3, "Roland Boss DD-3"), (4, "Korg MS-20"), (5, "Korg - M1  rare"), (6, "Roland"), (7, "Yamaha DX7"), (8, "Korg cable"), (9, None), (10, ""), (11, "Roland *NEW*"), (12, "Roland JUNO 60")]
    got = sorted(rows(review.mine_suggestions(spark.createDataFrame(titles, "id long, title string"), brands, known), "canonical_name", "brand_id", "category_id", "listing_count"))
    assert got == [("Korg M1 rare", "3", None, 1), ("Roland Boss DD-3", "2", "p", 1), ("Roland JUNO 60", "1", "k", 3)]
    old = spark.createDataFrame([("s1", "Roland JUNO 60", "1", "old", None, "x", 1, "rejected"), ("s2", "gone", "1", "old", None, "x", 7, "pending"), ("s3", "Korg M1 rare", None, "old", None, "x", 7, "pending")], "id string, canonical_name string, brand_id string, brand_name string, category_id string, source string, listing_count int, status string")
    mined = review.mine_suggestions(spark.createDataFrame(titles, "id long, title string"), brands, known)
    after = {(r.canonical_name, r.brand_id): (r.status, r.listing_count, r.source) for r in review.upsert_suggestions(old, mined).collect()}
    assert after[("Roland JUNO 60", "1")] == ("rejected", 3, "expand-script") and after[("gone", "1")] == ("pending", 7, "x")
    assert after[("Korg M1 rare", None)] == ("pending", 7, "x") and after[("Korg M1 rare", "3")] == ("pending", 1, "expand-script") and len(after) == 5


def test_dirty_products(spark):
    brands = spark.createDataFrame([("b", "Korg")], "id string, name string")
    p = spark.createDataFrame(
        [product("1", "korg-korg-ms20", "MS 20"), product("2", "ms10", "MS 10 1978 relic"), product("3", "ms50", "MS 50"), product("4", "a", "A 1999", tier="classic"), product("5", "b", "B 1999", status="inactive"), product("6", "c", "C 1999", cleanup="clean")], P
    )
    m = spark.createDataFrame([("x", "2"), ("y", "2")], "listing_id string, product_id string")
    found = review.flagged_products(p, brands, m)
    assert sorted(rows(found, "id", "flags", "listing_match_count")) == [("1", ["duplicated_brand"], 0), ("2", ["has_year", "has_condition_word"], 2), ("6", ["has_year"], 0)]
    assert review.flag_report(p, found).first().asDict() == {"total_scanned": 6, "total_flagged": 3, "breakdown": {"duplicated_brand": 1, "has_condition_word": 1, "has_year": 2}}
    assert dict(rows(review.mark_pending(p, brands), "id", "cleanup_status")) == {"1": "pending", "2": "pending", "3": None, "4": None, "5": None, "6": "clean"}
    empty = review.flag_report(p.limit(0), found.limit(0)).first()
    assert (empty.total_scanned, empty.total_flagged, empty.breakdown) == (0, 0, {})


def test_cleanup_queue(spark):
    brands = spark.createDataFrame([("b", "Korg")], "id string, name string")
    p = spark.createDataFrame([product("1", "korg-korg-ms20", "Korg MS 20 (1978)", cleanup="pending"), product("2", "ms20", "Korg MS 20"), product("3", "ms20x", "Korg  MS 20"), product("4", "ms20d", "Korg MS 20", status="inactive"), product("5", "z", "zzz", cleanup="pending")], P)
    got = {r.id: r for r in review.cleanup_queue(p, brands, spark.createDataFrame([("x", "1")], "listing_id string, product_id string")).collect()}
    # near duplicates of a better candidate are left out, and so is the product itself
    assert got["1"].candidates[0] in ("Korg MS 20", "Korg  MS 20") and got["1"].listing_match_count == 1 and set(got["1"].flags) == {"has_year", "duplicated_brand"}
    assert "Korg MS 20 (1978)" not in got["1"].candidates and got["5"].candidates == [] and len(got) == 2


def test_merge_into(spark):
    p = spark.createDataFrame([product("1", "a"), product("2", "b"), product("3", "c"), product("4", "d")], P)
    m = spark.createDataFrame([("x", "1", "SKU", 95, None), ("y", "1", "FUZZY", 70, None), ("x", "2", "FUZZY", 70, None), ("z", "4", "SKU", 95, None)], M)
    merges = spark.createDataFrame([("1", "2", 1), ("1", "3", 2), ("3", "3", 1), ("4", "lost", 1), ("lost", "1", 1), ("2", "4", 1)], "dirty_id string, clean_id string, decided_at long")
    got = review.merge_into(m, p, merges)
    # what the clean product has stays; the dirty product keeps its own rows
    assert sorted(rows(got["matches"], "listing_id", "product_id", "method")) == [("x", "1", "SKU"), ("x", "2", "FUZZY"), ("x", "4", "FUZZY"), ("y", "1", "FUZZY"), ("y", "2", "FUZZY"), ("z", "4", "SKU")]
    assert dict(rows(got["products"], "id", F.concat_ws(",", "status", "cleanup_status"))) == {"1": "inactive,merged", "2": "inactive,merged", "3": "active", "4": "active,clean"}
    assert sorted(rows(got["refused"], "dirty_id", "reason")) == [("3", "same product"), ("4", "no such product"), ("lost", "no such product")]


def test_clean_by_name(spark):
    p = spark.createDataFrame([product("1", "a", tier="classic"), product("2", "b"), product("3", "c", tier=None)], P)
    m = spark.createDataFrame([("x", "1", "SKU", 95, None)], M)
    names = spark.createDataFrame([("1", " Juno 60 ", 2), ("2", "juno-60", 1), ("3", " ", 1), ("9", "new", 1)], "dirty_id string, clean_name string, decided_at long")
    got = review.clean_by_name(m, p, names)
    assert sorted(rows(got["refused"], "dirty_id", "reason")) == [("1", "slug is taken"), ("3", "no name"), ("9", "no such product")]
    new = got["products"].filter("id NOT IN ('1', '2', '3')")
    assert rows(new, "slug", "canonical_name", "tier", "status", "cleanup_status") == [("juno-60", "juno-60", "standard", "active", "clean")]
    assert got["matches"].count() == 1
    moved = review.clean_by_name(m, p, names.filter("dirty_id = '1'"))
    assert sorted(rows(moved["matches"], "listing_id", "method", "score")) == [("x", "SKU", 95), ("x", "SKU", 95)]
    assert rows(moved["products"].filter("id = '1'"), "status", "cleanup_status") == [("inactive", "merged")]
    assert rows(moved["products"].filter("slug = 'juno-60'"), "tier") == [("classic",)]


def test_match_candidates_of_equal_names(spark):
    """By product and by name: equal to looking at every pair, also for products with more matches than a page holds."""
    p = spark.createDataFrame([(i, ("hot-bolt", "bolt hot", "old bolt")[i % 3]) for i in range(12)], "id long, canonical_name string")
    ls = spark.createDataFrame([(i, ("HOT bolt", "old bolt hot", "ring")[i % 3], i % 7 > 0) for i in range(90)], "id long, title string, is_active boolean")
    own = [(p_, l_) for p_ in range(12) for l_ in range(90) if (p_ == 3 and l_ < 50) or (p_ == 5 and l_ % 2 == 0) or l_ == p_]
    holds = lambda name, title: all(w in title.lower() for w in name.replace("-", " ").split())
    pairs = [(p_.id, p_.canonical_name, l_.id) for p_ in p.collect() for l_ in ls.collect() if l_.is_active and holds(p_.canonical_name, l_.title)]

    def head(out):
        want = {}
        for i, name, j in sorted(pairs):
            if not out(i, name, j):
                want.setdefault(i, []).append(j)
        return sorted((i, k + 1, j) for i, js in want.items() for k, j in enumerate(js[:4]))

    got = review.match_candidates(p, ls, spark.createDataFrame(own, "product_id long, listing_id long"), 4)
    assert sorted(rows(got, "product_id", "place", "listing_id")) == head(lambda i, name, j: (i, j) in own)
    named = [(n, j) for n in ("hot-bolt", "old bolt") for j in range(0, 90, 6)]
    got = review.match_candidates(p, ls, spark.createDataFrame(named, "canonical_name string, listing_id long"), 4)
    assert sorted(rows(got, "product_id", "place", "listing_id")) == head(lambda i, name, j: (name, j) in named)


def test_hand_matches(spark):
    p = spark.createDataFrame([("1", "Juno-60 X"), ("2", "a b")], "id string, canonical_name string")
    ls = spark.createDataFrame([("a", "JUNO 60", True), ("b", "60 juno", True), ("c", "Juno 60", None), ("d", None, True), ("e", "juno", True), ("f", "juno60", True)], "id string, title string, is_active boolean")
    m = spark.createDataFrame([("b", "1", "SKU", 95, None), ("z", "1", "SKU", 95, None)], M)
    found = review.match_candidates(p, ls, m)
    # "60" and "X" are too short to be asked for; a product of short words only finds nothing
    assert sorted(rows(found, "product_id", "place", "listing_id")) == [("1", 1, "a"), ("1", 2, "e"), ("1", 3, "f")]
    scores = spark.createDataFrame([("1", "e", "yes", "r"), ("1", "f", "no", "r")], "product_id string, listing_id string, score string, reason string")
    assert sorted(rows(review.judged_candidates(found, scores), "place", "listing_id", "score", "reason")) == [(1, "e", "yes", "r"), (2, "a", "maybe", "")]
    ok = review.confirm_matches(m, spark.createDataFrame([("b", "1"), ("b", "1"), ("n", "1")], "listing_id string, product_id string"))
    assert sorted(rows(ok, "listing_id", "method", "score")) == [("b", "FUZZY", 100), ("n", "FUZZY", 100), ("z", "SKU", 95)]


def test_keep_and_inactivate(spark):
    p = spark.createDataFrame([product("1", "a"), product("2", "b")], P)
    ids = spark.createDataFrame([("1",), ("1",), ("9",)], "id string")
    assert sorted(rows(review.keep(p, ids), "id", "cleanup_status"), key=str) == [("1", "clean"), ("2", None)]
    assert sorted(rows(review.inactivate(p, ids), "id", "status")) == [("1", "inactive"), ("2", "active")]
