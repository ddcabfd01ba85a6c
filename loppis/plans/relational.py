"""Scans, predicates, joins, aggregates, rankings, orders and set operations on the stand-in tables.

Listings are line items: source l_returnflag, active where l_linestatus is O, price l_extendedprice, seen l_shipdate.
Matches pair a line item with its part, scored by l_quantity. Categories are regions (roots) and nations (leaves).
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loppis.functions import stats, text
from loppis.operators import matching, ranking, writes
from loppis.session import table

from .base import Book

book = Book()
q = book.query
c = F.col
#: All columns of a line item: a total order for ties.
TIE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_TIE = ", ".join(TIE)
_TIER = "CASE WHEN p_size >= 45 THEN 'legendary' WHEN p_size >= 35 THEN 'classic' ELSE 'standard' END"


def products(spark, sf):
    p = table(spark, sf, "part")
    return p.withColumn("tier", F.when(c("p_size") >= 45, "legendary").when(c("p_size") >= 35, "classic").otherwise("standard"))


def items(spark, sf):
    return table(spark, sf, "lineitem")


# --- scans and predicates -------------------------------------------------------------------------------------------


@q("SELECT p_partkey, p_name FROM part")
def s01_scan_project(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name")


@q("SELECT event_id, event_type FROM events")
def s02_full_scan(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type")


@q("""SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders""")
def s03_parallel_scans(spark, sf):
    each = [table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "n") for n in ("customer", "supplier", "part", "orders")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@q("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' AND p_type = 'ECONOMY'")
def p01_equality(spark, sf):
    return table(spark, sf, "part").filter((c("p_brand") == "Brand#13") & (c("p_type") == "ECONOMY")).select("p_partkey", "p_name")


@q("SELECT event_id FROM events WHERE event_type <> 'view'")
def p02_not_equal(spark, sf):
    return table(spark, sf, "events").filter(c("event_type") != "view").select("event_id")


@q("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#2')")
def p03_in_list(spark, sf):
    return table(spark, sf, "part").filter(c("p_brand").isin("Brand#1", "Brand#2", "Brand#2")).select("p_partkey")


@q("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def p04_not_in(spark, sf):
    gone = items(spark, sf).filter("l_quantity > 45").select(c("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf, "part").select("p_partkey").join(gone, "p_partkey", "left_anti")


@q("""SELECT c_custkey, o_orderkey IS NULL AS idle FROM customer
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey""")
def p05_is_null(spark, sf):
    first = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(c("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o"))
    return table(spark, sf, "customer").join(first, "c_custkey", "left").select("c_custkey", c("o").isNull().alias("idle"))


@q("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%'")
def p06_ilike(spark, sf):
    return table(spark, sf, "part").filter(c("p_name").ilike("%RING%")).select("p_partkey")


@q("SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND text ILIKE '%tion%' AND text ILIKE '%of%'")
def p07_all_words(spark, sf):
    return table(spark, sf, "documents").filter(text.all_words(c("text"), F.array(*map(F.lit, ["the", "tion", "of"])))).select("doc_id")


@q("""SELECT doc_id FROM (SELECT doc_id, text FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id LIMIT 100)
WHERE contains(regexp_replace(lower(text), '[-\\s_]+', '', 'g'), 'thethe') ORDER BY doc_id LIMIT 20""")
def p08_two_phase(spark, sf):
    first = table(spark, sf, "documents").filter(c("text").ilike("%the%")).orderBy("doc_id").limit(100)
    return first.filter(F.contains(text.without_separators(c("text")), F.lit("thethe"))).orderBy("doc_id").limit(20).select("doc_id")


@q("SELECT event_id FROM events WHERE value < 5 OR ts < TIMESTAMP '2024-01-02'")
def p09_or(spark, sf):
    return table(spark, sf, "events").filter("value < 5 OR ts < TIMESTAMP_NTZ '2024-01-02'").select("event_id")


@q("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR")
def p10_staleness(spark, sf):
    return table(spark, sf, "events").filter("ts < TIMESTAMP_NTZ '2024-01-20' - INTERVAL 48 HOURS").select("event_id")


@q("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN customer ON l_orderkey % 1500 = c_custkey
WHERE c_nationkey % 3 = 0 OR c_acctbal <= 0 OR l_extendedprice <= c_acctbal * 10""")
def p11_price_cap(spark, sf):
    caps = table(spark, sf, "customer").select("c_custkey", F.when(c("c_nationkey") % 3 != 0, c("c_acctbal") * 10).alias("cap"))
    j = items(spark, sf).withColumn("c_custkey", c("l_orderkey") % 1500).join(caps, "c_custkey")
    none = c("cap").isNull() | (c("cap") <= 0)
    return j.filter(none | c("l_extendedprice").isNull() | (c("l_extendedprice") <= c("cap"))).select("l_orderkey", "l_linenumber", "l_partkey")


@q("SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def p12_positive(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")


@q("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END IS DISTINCT FROM false AS shown,
coalesce(CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END, false) AS strictly FROM part""")
def p13_null_bool(spark, sf):
    active = F.when(c("p_size") % 3 == 0, True).when(c("p_size") % 3 == 1, False)
    return table(spark, sf, "part").select("p_partkey", F.coalesce(active, F.lit(True)).alias("shown"), F.coalesce(active == F.lit(True), F.lit(False)).alias("strictly"))


@q(f"""SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey, count(*) n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 48 GROUP BY 1) ON p_partkey = l_partkey
WHERE coalesce(n, 0) >= 1 OR {_TIER} IN ('classic', 'legendary')""")
def p14_qualify(spark, sf):
    n = items(spark, sf).filter("l_linestatus = 'O' AND l_quantity > 48").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return products(spark, sf).join(n, "p_partkey", "left").filter((F.coalesce("n", F.lit(0)) >= 1) | c("tier").isin("classic", "legendary")).select("p_partkey")


@q("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def p15_json_path(spark, sf):
    return table(spark, sf, "events").filter(F.from_json("props", "k int")["k"] > 50).select("event_id")


@q("SELECT page_id FROM pages WHERE NOT (contains(url, 'utm_') OR contains(url, 'cheap'))")
def p16_not_junk(spark, sf):
    return table(spark, sf, "pages").filter(~(F.contains("url", F.lit("utm_")) | F.contains("url", F.lit("cheap")))).select("page_id")


@q("""SELECT doc_id, len(text) > 80 OR contains(text, '*') OR regexp_matches(lower(text), 'cover|case|dust|parts|replacement|adapter|cable|strap|stand|bag|gig|manual|knob|screw|bolt') AS noise FROM documents""")
def p17_noise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_noise(c("text")).alias("noise"))


@q("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag IN ('A') OR l_returnflag NOT IN ('A', 'R')")
def p18_source_toggle(spark, sf):
    known, on = ["A", "R"], ["A"]
    return items(spark, sf).filter(c("l_returnflag").isin(on) | ~c("l_returnflag").isin(known)).select("l_orderkey", "l_linenumber", "l_partkey")


@q("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def p19_owner(spark, sf):
    own = table(spark, sf, "customer").filter("c_nationkey = 7").select(c("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(own, "o_custkey", "left_semi").select("o_orderkey")


@q("SELECT o_orderkey AS id, coalesce(nullif(o_orderstatus, 'P'), '') AS status, coalesce(NULL, 0) AS price FROM orders")
def p20_projection(spark, sf):
    return table(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("")).alias("status"), F.lit(0).alias("price"))


@q("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def p21_exact_count(spark, sf):
    return table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bolt') AND contains(lower(p_brand), 'brand#1')")
def p22_name_brand_filter(spark, sf):
    return table(spark, sf, "part").filter(F.contains(F.lower("p_name"), F.lit("bolt")) & F.contains(F.lower("p_brand"), F.lit("brand#1"))).select("p_partkey")


# --- joins ----------------------------------------------------------------------------------------------------------


@q("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j01_embed_inner(spark, sf):
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "n_name")


@q("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def j02_embed_left(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey < 3")
    return table(spark, sf, "customer").join(n, c("c_nationkey") == c("n_nationkey"), "left").select("c_custkey", "n_name")


@q("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1")
def j03_two_hops(spark, sf):
    far = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_regionkey = 1"), c("n_regionkey") == c("r_regionkey"))
    return table(spark, sf, "customer").join(far, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "r_name")


@q(f"""SELECT l_orderkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, {_TIE}) rn FROM lineitem)
JOIN part ON l_partkey = p_partkey WHERE rn = 1""")
def j04_best_match_slug(spark, sf):
    best = ranking.best_match(items(spark, sf), "l_orderkey", "l_quantity", [c("l_linenumber"), *map(c, TIE)])
    return best.join(table(spark, sf, "part"), c("l_partkey") == c("p_partkey")).select("l_orderkey", "p_name")


@q(f"""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, {_TIE}) AS rank FROM lineitem) WHERE rank <= 3""")
def j05_ranked_listings(spark, sf):
    return ranking.top_per_group(items(spark, sf), ["l_partkey"], [c("l_quantity").desc(), c("l_orderkey"), c("l_linenumber"), *map(c, TIE)], 3).select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "rank")


@q("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def j06_active_count(spark, sf):
    active = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(c("o_orderkey").alias("l_orderkey"))
    return items(spark, sf).join(active, "l_orderkey", "left_semi").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT DISTINCT p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def j07_brands_with_match(spark, sf):
    hit = items(spark, sf).filter("l_quantity = 50").select(c("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(hit, "p_partkey", "left_semi").select("p_brand").distinct()


@q("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
def j08_unmatched_anti(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(items(spark, sf).filter("l_quantity > 20").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@q("SELECT DISTINCT p_name FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size > 48)")
def j09_new_names(spark, sf):
    p = table(spark, sf, "part")
    known = p.filter("p_size > 48").select(F.lower("p_name").alias("k"))
    return p.select("p_name").distinct().join(known, F.lower("p_name") == c("k"), "left_anti")


@q("SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) NOT IN (SELECT lower(trim(c_mktsegment)) FROM customer WHERE c_custkey < 2)")
def j10_existing_skip(spark, sf):
    cu = table(spark, sf, "customer").withColumn("k", F.lower(F.trim("c_mktsegment")))
    return cu.join(cu.filter("c_custkey < 2").select("k"), "k", "left_anti").select("c_custkey")


_TREE = """WITH tree AS (SELECT r_regionkey AS id, r_name AS slug, CAST(NULL AS INTEGER) AS parent FROM region
UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey FROM nation)"""


def tree(spark, sf):
    roots = table(spark, sf, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("slug"), F.lit(None).cast("int").alias("parent"))
    return roots.unionByName(table(spark, sf, "nation").select((c("n_nationkey") + 100).alias("id"), c("n_name").alias("slug"), c("n_regionkey").alias("parent")))


@q(_TREE + " SELECT a.id, coalesce(b.slug, a.slug) AS root FROM tree a LEFT JOIN tree b ON a.parent = b.id")
def j11_root_of(spark, sf):
    t = tree(spark, sf)
    up = t.select(c("id").alias("parent"), c("slug").alias("up"))
    return t.join(up, "parent", "left").select("id", F.coalesce("up", "slug").alias("root"))


@q(_TREE + " SELECT a.id, CASE WHEN a.parent IS NULL THEN a.slug ELSE b.slug || '/' || a.slug END AS path FROM tree a LEFT JOIN tree b ON a.parent = b.id")
def j12_compound_slug(spark, sf):
    t = tree(spark, sf)
    up = t.select(c("id").alias("parent"), c("slug").alias("up"))
    return t.join(up, "parent", "left").select("id", F.when(c("parent").isNull(), c("slug")).otherwise(F.concat_ws("/", "up", "slug")).alias("path"))


_NAMES = """WITH l AS (SELECT p_partkey, regexp_replace(lower(p_name || '-' || CASE WHEN p_size < 4 THEN p_brand ELSE p_type END), '[^a-z0-9]+', '', 'g') k FROM part WHERE p_size % 2 = 0),
r AS (SELECT regexp_replace(lower(p_name || ' ' || CASE WHEN p_size < 4 THEN p_brand ELSE p_type END), '[^a-z0-9]+', '', 'g') k, count(*) n, min(p_partkey) id FROM part WHERE p_size % 2 = 1 GROUP BY 1)"""


def unique_names(spark, sf):
    p = table(spark, sf, "part")
    tail = F.when(c("p_size") < 4, c("p_brand")).otherwise(c("p_type"))
    left = p.filter("p_size % 2 = 0").select("p_partkey", F.concat_ws("-", "p_name", tail).alias("name"))
    right = p.filter("p_size % 2 = 1").select(c("p_partkey").alias("match_id"), F.concat_ws(" ", "p_name", tail).alias("match_name"))
    return matching.unique_name_join(left, right, "p_partkey", "name", "match_id", "match_name")


@q(_NAMES + " SELECT p_partkey, CASE WHEN n = 1 THEN id END AS match_id, CASE WHEN n = 1 THEN 'will_map' WHEN n > 1 THEN 'ambiguous' ELSE 'no_match' END AS verdict FROM l LEFT JOIN r USING (k)")
def j13_unique_name_join(spark, sf):
    return unique_names(spark, sf)


@q(_NAMES + " SELECT count(*) FILTER (WHERE n = 1) AS will_map, count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) FILTER (WHERE n IS NULL) AS no_match FROM l LEFT JOIN r USING (k)")
def a16_match_preview(spark, sf):
    return unique_names(spark, sf).agg(*[F.count_if(c("verdict") == v).alias(v) for v in ("will_map", "ambiguous", "no_match")])


_WORDS = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_-]+')"


def dictionary(spark, sf):
    b = table(spark, sf, "benchmark")
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_-]+)"), F.lit(1))
    return b.select("item_id", F.get(words, F.lit(2)).alias("token")).filter("token IS NOT NULL")


@q(f"""WITH t AS (SELECT item_id, {_WORDS.format('text')}[3] AS token FROM benchmark)
SELECT doc_id, item_id FROM documents JOIN t ON len(token) >= 3 AND regexp_matches(' ' || text || ' ', '(?i)[^\\w-]' || token || '[^\\w-]')""")
def j14_token_containment(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return matching.token_hits(d, dictionary(spark, sf), "doc_id", "text", "token").select("doc_id", "item_id")


@q("""WITH n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_name FROM part),
t AS (SELECT p_partkey, lower(p_type || ' ' || p_name || p_brand) AS title FROM part)
SELECT p_partkey, name FROM (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY len(name) DESC, name) rn FROM t JOIN n ON contains(title, lower(name))) WHERE rn = 1""")
def j15_longest_brand(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(c("p_brand").alias("name")).union(p.select("p_name")).distinct()
    titles = p.select("p_partkey", F.concat(F.concat_ws(" ", "p_type", "p_name"), "p_brand").alias("title"))
    return matching.longest_contained(titles, names.withColumn("id", c("name")), "p_partkey", "title", "id", "name").select("p_partkey", c("id").alias("name"))


_RESOLVE = """WITH p AS (SELECT p_partkey AS id, replace(lower(p_name), ' ', '-') || '-' || lower(p_type) || '-' || p_size AS slug, lower(p_brand || ' ' || p_name) AS name FROM part WHERE p_size < 30),
c AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type || ' ' || p_size WHEN 1 THEN p_name WHEN 2 THEN 'old ' || p_name || ' ' || p_type || ' ' || p_size ELSE p_brand || ' ' || left(p_name, 3) END AS canonical FROM part WHERE p_partkey < 400),
s AS (SELECT canonical, regexp_replace(regexp_replace(lower(canonical), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM c),
f AS (SELECT canonical, id, CASE WHEN s.slug = p.slug THEN 1 WHEN starts_with(p.slug, s.slug || '-') THEN 2 WHEN len(p.slug) >= 4 AND ends_with(s.slug, '-' || p.slug) THEN 3 WHEN starts_with(name, lower(canonical)) THEN 4 END AS tier FROM s, p)
SELECT canonical, id AS product_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY tier, id) rn FROM f WHERE tier IS NOT NULL) WHERE rn = 1"""


def resolved(named, p):
    """Canonical names made of the parts `named`, resolved to the parts p."""
    prods = p.select(
        c("p_partkey").alias("product_id"), F.concat_ws("-", F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lower("p_type"), c("p_size").cast("string")).alias("slug"), F.concat_ws(" ", "p_brand", "p_name").alias("name")
    )
    full = F.concat_ws(" ", "p_name", "p_type", c("p_size").cast("string"))
    k = c("p_partkey") % 4
    name = F.when(k == 0, full).when(k == 1, c("p_name")).when(k == 2, F.concat_ws(" ", F.lit("old"), full)).otherwise(F.concat_ws(" ", "p_brand", F.substring("p_name", 1, 3)))
    return matching.resolve_canonical(named.select(name.alias("canonical")), prods)


@q(_RESOLVE.replace(" WHERE p_size < 30", "").replace(" WHERE p_partkey < 400", ""))
def j16_resolve_canonical(spark, sf):
    return resolved(table(spark, sf, "part"), table(spark, sf, "part"))


@q("""SELECT p_partkey, count(o) AS demand FROM part LEFT JOIN (SELECT o_orderkey AS o, lower(o_orderpriority || ' ' || p2.p_name || ' ' || p2.p_type) AS query FROM orders JOIN part p2 ON o_orderkey % 300 = p2.p_partkey) ON contains(query, lower(part.p_name || ' ' || part.p_type)) GROUP BY 1""")
def j20_demand(spark, sf):
    p = table(spark, sf, "part")
    q_ = table(spark, sf, "orders").withColumn("k", c("o_orderkey") % 300).join(p, c("k") == c("p_partkey")).select(F.concat_ws(" ", "o_orderpriority", "p_name", "p_type").alias("query"))
    return matching.demand(q_, p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name")), "query", "p_partkey", "name").select("p_partkey", "demand")


@q(f"""SELECT o_orderkey, p_name FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, {_TIE}) rn FROM lineitem) WHERE rn = 1) ON o_orderkey = l_orderkey
LEFT JOIN part ON l_partkey = p_partkey""")
def j21_saved_enriched(spark, sf):
    best = ranking.best_match(items(spark, sf), "l_orderkey", "l_quantity", [c("l_linenumber"), *map(c, TIE)]).select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("p_partkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(best, "o_orderkey", "left").join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "left").select("o_orderkey", "p_name")


@q("""SELECT a.p_partkey, b.p_partkey AS related, b.p_name FROM (SELECT p_partkey, unnest([p_partkey + 1, p_partkey + 7, p_partkey * 3, 99999999][1:3]) AS r FROM part) a JOIN part b ON a.r = b.p_partkey""")
def j22_related_from_list(spark, sf):
    p = table(spark, sf, "part")
    listed = F.array(c("p_partkey") + 1, c("p_partkey") + 7, c("p_partkey") * 3, F.lit(99999999))
    r = p.select("p_partkey", F.explode(F.slice(listed, 1, 3)).alias("related"))
    return r.join(p.select(c("p_partkey").alias("related"), "p_name"), "related").select("p_partkey", "related", "p_name")


@q("SELECT l.p_name || '/' || l.p_type AS slug, r.id FROM part l JOIN (SELECT p_name || '/' || p_type AS s, min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY 1) r ON l.p_name || '/' || l.p_type = r.s")
def j23_surrogate_resolution(spark, sf):
    p = table(spark, sf, "part").withColumn("slug", F.concat_ws("/", "p_name", "p_type"))
    ids = p.filter("p_size > 25").groupBy("slug").agg(F.min("p_partkey").alias("id"))
    return p.select("slug").join(ids, "slug")


@q("SELECT s_suppkey, (SELECT r_regionkey FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_nationkey = s_nationkey) AS region FROM supplier")
def j24_scalar_lookup(spark, sf):
    r = table(spark, sf, "nation").select(c("n_nationkey").alias("s_nationkey"), c("n_regionkey").alias("region"))
    return table(spark, sf, "supplier").join(r, "s_nationkey", "left").select("s_suppkey", "region")


_RELATIONS = """WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_returnflag = 'R' AS clone FROM lineitem WHERE l_quantity > 47)
SELECT p_partkey AS id, (SELECT string_agg(b, ',' ORDER BY b) FROM e WHERE NOT clone AND a = p_partkey) AS related, (SELECT string_agg(a, ',' ORDER BY a) FROM e WHERE clone AND b = p_partkey) AS clones FROM part WHERE p_partkey < 100"""


def relations(spark, sf, p):
    e = items(spark, sf).filter("l_quantity > 47").select(c("l_partkey").alias("a"), c("l_suppkey").alias("b"), (c("l_returnflag") == "R").alias("clone")).distinct()
    rel = e.filter("NOT clone").groupBy(c("a").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("b")).cast("array<string>"), ",").alias("related"))
    clones = e.filter("clone").groupBy(c("b").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("a")).cast("array<string>"), ",").alias("clones"))
    return p.select(c("p_partkey").alias("id")).join(rel, "id", "left").join(clones, "id", "left").select("id", "related", "clones")


@q(_RELATIONS.removesuffix(" WHERE p_partkey < 100"))
def j25_relations(spark, sf):
    return relations(spark, sf, table(spark, sf, "part"))


@q("""SELECT o_orderkey, coalesce(a.p_retailprice, b.p_retailprice) AS price FROM orders LEFT JOIN part a ON CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END = a.p_partkey
LEFT JOIN (SELECT p_name, min(p_retailprice) AS p_retailprice FROM part GROUP BY 1) b ON 'small ring' = b.p_name""")
def j26_id_else_name(spark, sf):
    p = table(spark, sf, "part")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(c("o_orderkey") % 2 == 0, c("o_orderkey")).alias("p_partkey"), F.lit("small ring").alias("p_name"))
    by_name = p.groupBy("p_name").agg(F.min("p_retailprice").alias("second"))
    return o.join(p.select("p_partkey", c("p_retailprice").alias("first")), "p_partkey", "left").join(by_name, "p_name", "left").select("o_orderkey", F.coalesce("first", "second").alias("price"))


@q("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey = 2))")
def j27_chained_semi(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_regionkey = 2").select(c("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    return table(spark, sf, "customer").join(n.select(c("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")


@q("""WITH p AS (SELECT p_partkey AS id, p_name AS cat, p_brand AS brand FROM part),
n AS (SELECT a.id, b.id AS r, 1 AS t FROM p a JOIN p b ON a.cat = b.cat AND a.id <> b.id UNION ALL SELECT a.id, b.id, 2 FROM p a JOIN p b ON a.brand = b.brand AND a.id <> b.id),
o AS (SELECT id, r, min(t) AS t FROM n GROUP BY 1, 2),
s AS (SELECT p.id FROM p LEFT JOIN (SELECT id, count(*) AS m FROM o GROUP BY 1) g ON p.id = g.id WHERE coalesce(m, 0) < 10),
x AS (SELECT s.id, b.id AS r, row_number() OVER (PARTITION BY s.id ORDER BY b.id) AS k FROM s JOIN p b ON s.id <> b.id WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.id = s.id AND o.r = b.id)),
a AS (SELECT id, r, t FROM o UNION ALL SELECT id, r, 3 FROM x WHERE k <= 40)
SELECT id, r AS related_id, rank FROM (SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY t, r) AS rank FROM a) WHERE rank <= 80""")
def j28_padded_candidates(spark, sf):
    from loppis.operators import similar

    p = table(spark, sf, "part").select(c("p_partkey").alias("id"), c("p_name").alias("category_id"), c("p_brand").alias("brand_id"))
    return similar.padded_candidates(p).select("id", "related_id", "rank")


# --- aggregates -----------------------------------------------------------------------------------------------------


@q("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def a01_active_per_product(spark, sf):
    return items(spark, sf).filter("l_linestatus = 'O'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def a02_count_per_key(spark, sf):
    n = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@q("SELECT s_nationkey, count(*) AS n, coalesce(min(n_name), CAST(s_nationkey AS VARCHAR)) AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20 GROUP BY 1")
def a03_count_with_name(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey < 20").select(c("n_nationkey").alias("s_nationkey"), "n_name")
    g = table(spark, sf, "supplier").join(n, "s_nationkey", "left").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("name"))
    return g.withColumn("name", F.coalesce("name", c("s_nationkey").cast("string")))


@q("SELECT l_partkey, min(x) AS low, max(x) AS high, count(*) AS count FROM (SELECT l_partkey, l_extendedprice x FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 UNION ALL SELECT l_partkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40) WHERE x > 0 GROUP BY 1 HAVING count(*) >= 3")
def a04_market_range_min3(spark, sf):
    i = items(spark, sf).filter("l_quantity > 40").select("l_partkey", "l_returnflag", "l_extendedprice")
    both = i.filter("l_returnflag = 'R'").unionByName(i.filter("l_returnflag = 'A'"))
    return stats.market_range(both, ["l_partkey"], "l_extendedprice")


@q("SELECT CASE WHEN count(*) >= 3 THEN min(l_extendedprice) END AS low, CASE WHEN count(*) >= 3 THEN max(l_extendedprice) END AS high, count(*) AS count FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%ring%' AND l_extendedprice > 0")
def a05_market_range_query(spark, sf):
    p = table(spark, sf, "part").filter(c("p_name").ilike("%ring%")).select(c("p_partkey").alias("l_partkey"))
    g = items(spark, sf).join(p, "l_partkey", "left_semi").filter("l_extendedprice > 0").agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b"), F.count(F.lit(1)).alias("count"))
    return g.select(F.when(c("count") >= 3, c("a")).alias("low"), F.when(c("count") >= 3, c("b")).alias("high"), "count")


_PCT = "CAST(floor(quantile_cont(value, {0}) + 0.5) AS BIGINT)"


@q(f"SELECT event_type, count(value) AS count, {_PCT.format(0.25)} AS p25, {_PCT.format(0.5)} AS p50, {_PCT.format(0.75)} AS p75 FROM events GROUP BY 1")
def a06_observation_percentiles(spark, sf):
    return stats.interpolated_percentiles(table(spark, sf, "events"), ["event_type"], "value")


_SMALL = """WITH v AS (SELECT l_orderkey, l_extendedprice x, l_partkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey) rn, count(*) OVER (PARTITION BY l_orderkey) n FROM v),
b AS (SELECT l_orderkey, max(CASE WHEN rn = CAST(floor(n * 0.25) AS BIGINT) + 1 THEN x END) q1, max(CASE WHEN rn = CAST(floor(n * 0.75) AS BIGINT) + 1 THEN x END) q3 FROM r GROUP BY 1)
SELECT r.l_orderkey, l_partkey, x AS price FROM r JOIN b ON r.l_orderkey = b.l_orderkey WHERE n < 4 OR x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5"""


@q(_SMALL)
def a07_iqr_small_groups(spark, sf):
    i = items(spark, sf).select("l_orderkey", "l_partkey", c("l_extendedprice").alias("price"))
    return stats.iqr_keep(i, ["l_orderkey"], "price", ["l_partkey"])


@q("SELECT p_type, CAST(floor(median(p_retailprice) + 0.5) AS BIGINT) AS median FROM part GROUP BY 1")
def a08_median(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(stats.round_half_up(F.median("p_retailprice")).alias("median"))


@q("SELECT n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a10_roll_up(spark, sf):
    from loppis.operators import catalog

    counts = table(spark, sf, "customer").groupBy(c("c_nationkey").alias("category_id")).agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, sf, "nation").select(c("n_nationkey").alias("category_id"), c("n_regionkey").alias("parent_id"))
    return catalog.roll_up(counts, t).select(c("root_id").alias("n_regionkey"), "n")


@q("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) >= 2")
def a11_subcategory_having2(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@q("SELECT DISTINCT p_brand, p_type FROM part")
def a12_distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@q("SELECT o_orderkey, lower(trim(o_orderpriority)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderpriority)) ORDER BY o_orderkey) rn FROM orders) WHERE rn = 1")
def a13_first_wins(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.lower(F.trim("o_orderpriority")))
    return writes.first_by(o, ["o_custkey", "k"], [c("o_orderkey")]).select("o_orderkey", "k")


@q("SELECT p_brand, lower(p_name) AS model, count(*) AS n, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1, 2")
def a14_count_representative(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", F.lower("p_name").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.min_by("p_name", "p_partkey").alias("name"))


@q("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def a15_tally_top20(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "p_name").limit(20)


@q("SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN len(text) > 2000 THEN 'long' END, CASE WHEN contains(text, '*') THEN 'star' END, CASE WHEN contains(text, '|') THEN 'bar' END]) AS flag FROM documents) WHERE flag IS NOT NULL GROUP BY 1")
def a17_flag_breakdown(spark, sf):
    t = c("text")
    flags = F.array_compact(F.array(F.when(F.length(t) > 2000, "long"), F.when(F.contains(t, F.lit("*")), "star"), F.when(F.contains(t, F.lit("|")), "bar")))
    return table(spark, sf, "documents").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT count(*) AS total, count(CASE WHEN p_size > 10 THEN 1 END) AS sized, count(nullif(p_type, 'SMALL')) AS typed FROM part")
def a18_coverage(spark, sf):
    return table(spark, sf, "part").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(c("p_size") > 10, 1)).alias("sized"), F.count(F.nullif("p_type", F.lit("SMALL"))).alias("typed"))


@q("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) rn FROM part) WHERE rn = 1")
def a19_argmax(spark, sf):
    return writes.first_by(table(spark, sf, "part"), ["p_brand"], [c("p_size").desc(), c("p_partkey")]).select("p_brand", "p_partkey")


@q("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) rn, n FROM (SELECT user_id, event_type, count(*) n FROM events WHERE value > 50 GROUP BY 1, 2)) WHERE rn = 1 AND n >= 2")
def a20_supported_mode(spark, sf):
    n = table(spark, sf, "events").filter("value > 50").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return writes.first_by(n, ["user_id"], [c("n").desc(), c("event_type")]).filter("n >= 2").select("user_id", "event_type")


@q("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def a22_collected(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@q("SELECT count(DISTINCT lower(p_name)) AS names, count(DISTINCT p_brand) AS brands FROM part")
def a23_distinct_sizes(spark, sf):
    return table(spark, sf, "part").agg(F.countDistinct(F.lower("p_name")).alias("names"), F.countDistinct("p_brand").alias("brands"))


@q("SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM orders")
def a24_totals(spark, sf):
    return ranking.with_totals(table(spark, sf, "orders"), 50)


@q("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 12")
def a25_enough_rows(spark, sf):
    return items(spark, sf).filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12").select("l_partkey")


# --- windows --------------------------------------------------------------------------------------------------------


@q(f"SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, {_TIE}) rn FROM lineitem) WHERE rn = 1")
def w01_best_match(spark, sf):
    return ranking.best_match(items(spark, sf), "l_orderkey", "l_quantity", [c("l_linenumber"), *map(c, TIE)]).select("l_orderkey", "l_partkey", "l_quantity")


_W2 = f"row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_shipdate DESC, {_TIE})"
W2_ORDER = ["l_quantity", "l_shipdate"]


@q(f"SELECT * EXCLUDE (rn) FROM (SELECT *, {_W2} rn FROM lineitem) WHERE rn = 1")
def w02_match_dedup(spark, sf):
    return writes.first_by(items(spark, sf), ["l_orderkey", "l_linenumber"], [*(c(x).desc() for x in W2_ORDER), *map(c, TIE)])


@q(f"SELECT l_orderkey, l_linenumber, count(*) AS deleted FROM (SELECT *, {_W2} rn FROM lineitem) WHERE rn > 1 GROUP BY 1, 2")
def w02_match_dedup_deletes(spark, sf):
    gone = writes.rest_by(items(spark, sf), ["l_orderkey", "l_linenumber"], [*(c(x).desc() for x in W2_ORDER), *map(c, TIE)])
    return gone.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("deleted"))


_IMG = "WITH i AS (SELECT user_id, CASE WHEN event_id % 3 > 0 THEN 'img' || event_id END AS image, value AS price, ts AS seen FROM events)"


def images(spark, sf):
    e = table(spark, sf, "events")
    return e.select("user_id", F.when(c("event_id") % 3 > 0, F.concat(F.lit("img"), c("event_id").cast("string"))).alias("image"), c("value").alias("price"), c("ts").alias("seen"))


@q(_IMG + " SELECT user_id, image FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, image) rn FROM i WHERE image IS NOT NULL) WHERE rn = 1")
def w03_latest_image(spark, sf):
    return writes.first_by(images(spark, sf).filter("image IS NOT NULL"), ["user_id"], [c("seen").desc(), c("image")]).select("user_id", "image")


@q(_IMG + " SELECT user_id, image FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, image) rn FROM i WHERE image IS NOT NULL) WHERE rn = 1")
def w04_dearest_image(spark, sf):
    return writes.first_by(images(spark, sf).filter("image IS NOT NULL"), ["user_id"], [c("price").desc(), c("image")]).select("user_id", "image")


@q(_IMG + """, l AS (SELECT user_id, image FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, image) rn FROM i WHERE image IS NOT NULL) WHERE rn = 1)
SELECT u.user_id, coalesce(CASE WHEN u.user_id % 2 = 0 THEN 'own' || u.user_id END, l.image) AS image FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)""")
def w05_image_priority(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    own = users.filter("user_id % 2 = 0").withColumn("image", F.concat(F.lit("own"), c("user_id").cast("string")))
    return ranking.image_priority(users, own, images(spark, sf), "user_id")


_MERGE = """WITH s AS (SELECT l_partkey AS url, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS source_rank, l_orderkey * 10 + l_linenumber AS position FROM lineitem WHERE l_quantity > 45),
o AS (SELECT url, source_rank, position FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_rank, position) rn FROM s) WHERE rn = 1)"""


def merged(spark, sf):
    s = items(spark, sf).filter("l_quantity > 45").select(
        c("l_partkey").alias("url"), F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "N", 2).otherwise(3).alias("source_rank"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("position")
    )
    return ranking.merged_sources(s, "url", "source_rank", "position")


@q(_MERGE + " SELECT url, source_rank, row_number() OVER (ORDER BY turn, source_rank, url) AS place FROM (SELECT url, source_rank, row_number() OVER (PARTITION BY source_rank ORDER BY position, url) AS turn FROM o)")
def w06_interleave(spark, sf):
    return ranking.interleaved(merged(spark, sf), "source_rank", [c("position"), c("url")]).select("url", "source_rank", "place")


@q(_MERGE + " SELECT url, source_rank, position FROM o")
def w07_cross_source_dedup(spark, sf):
    return merged(spark, sf).select("url", "source_rank", "position")


@q("SELECT p_brand, max(CASE WHEN rn = CAST(floor(n * 0.25) AS BIGINT) + 1 THEN p_retailprice END) AS q1, max(CASE WHEN rn = CAST(floor(n * 0.75) AS BIGINT) + 1 THEN p_retailprice END) AS q3 FROM (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) rn, count(*) OVER (PARTITION BY p_brand) n FROM part) GROUP BY 1")
def w08_nearest_rank(spark, sf):
    w = W.partitionBy("p_brand")
    r = table(spark, sf, "part").select("p_brand", "p_retailprice", F.row_number().over(w.orderBy("p_retailprice", "p_partkey")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda s: F.max(F.when(c("rn") == F.floor(c("n") * s) + 1, c("p_retailprice")))
    return r.groupBy("p_brand").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))


@q(f"SELECT p_type, p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) rn FROM (SELECT p_type, p_partkey, CASE {_TIER} WHEN 'legendary' THEN 6 WHEN 'classic' THEN 5 ELSE 2 END AS score FROM part)) WHERE rn = 1")
def w09_best_image_per_root(spark, sf):
    from loppis.functions import money

    p = products(spark, sf).withColumn("score", money.image_score(c("tier"), F.lit("hero.jpg"), F.lit(None).cast("string")))
    return writes.first_by(p, ["p_type"], [c("score").desc(), c("p_partkey")]).select("p_type", "p_partkey", "score")


@q("SELECT o_orderkey, spent FROM (SELECT o_orderkey, sum(CAST(1 + o_orderkey % 5 AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) WHERE spent <= 12")
def w10_budget(spark, sf):
    o = table(spark, sf, "orders").withColumn("cost", (1 + c("o_orderkey") % 5).cast("long"))
    return ranking.within_budget(o, "o_custkey", [c("o_orderdate"), c("o_orderkey")], "cost", 12).select("o_orderkey", "spent")


@q("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, u DESC, o_orderkey) AS rank FROM (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS s, o_orderkey % 7 AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders) WHERE rn <= 3""")
def w11_ranked_candidates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (c("o_orderkey") % 4).alias("s"), (c("o_orderkey") % 7).alias("u"))
    return ranking.ranked_candidates(o, "o_custkey", "o_orderkey", "s", "u").select("o_custkey", "o_orderkey", "rank")


@q("SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) - 1) / 50) AS BIGINT) AS batch FROM orders")
def w12_batches(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    o = ranking.numbered(o, [c("o_orderdate").desc(), c("o_orderkey")], "n", "o_orderpriority")
    return o.select("o_orderkey", F.floor((c("n") - 1) / 50).alias("batch"))


# --- orders, limits, sets -------------------------------------------------------------------------------------------


def _ranked(name, source, key, spark_order, sql_order, n=20, where=None):
    def run(spark, sf):
        d = table(spark, sf, source)
        d = d.filter(where) if where else d
        top = d.orderBy(*spark_order()).limit(n)
        return top.select(key, F.row_number().over(W.orderBy(*spark_order())).alias("place"))

    book.add(name, run, f"SELECT {key}, row_number() OVER (ORDER BY {sql_order}) AS place FROM {source}{f' WHERE {where}' if where else ''} ORDER BY place LIMIT {n}")


_ranked("o01_single_key", "part", "p_partkey", lambda: [c("p_retailprice").desc(), c("p_partkey")], "p_retailprice DESC, p_partkey")
_ranked("o02_mixed_keys", "lineitem", "l_orderkey", lambda: [c("l_orderkey"), c("l_linenumber"), c("l_quantity").desc(), c("l_shipdate").desc(), *map(c, TIE)], f"l_orderkey, l_linenumber, l_quantity DESC, l_shipdate DESC, {_TIE}")
_ranked("o06_categorical", "orders", "o_orderkey", lambda: [F.when(c("o_orderstatus") == "P", 0).when(c("o_orderstatus") == "O", 1).otherwise(2), c("o_orderkey")], "CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey")
_ranked("o08_oldest_first", "orders", "o_orderkey", lambda: [c("o_orderdate"), c("o_orderkey")], "o_orderdate, o_orderkey", 10, "o_orderstatus = 'P'")
_ranked("o11_ordered_limit", "customer", "c_custkey", lambda: [c("c_custkey")], "c_custkey", 500)
_ranked("o13_by_name", "supplier", "s_suppkey", lambda: [c("s_name"), c("s_suppkey")], "s_name, s_suppkey")
_ranked("o14_newest_first", "events", "event_id", lambda: [c("ts").desc(), c("event_id")], "ts DESC, event_id")
_nul = "CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END"
_ranked("o05_nulls_last", "orders", "o_orderkey", lambda: [F.expr(_nul).desc_nulls_last(), c("o_orderkey")], f"{_nul} DESC NULLS LAST, o_orderkey")
_ranked("o07_nulls_first", "orders", "o_orderkey", lambda: [F.expr(_nul).asc_nulls_first(), c("o_orderkey")], f"{_nul} ASC NULLS FIRST, o_orderkey")


@q(f"""SELECT p_partkey, n FROM (SELECT p_partkey, n, {_TIER} AS tier FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 40) JOIN part ON l_partkey = p_partkey) WHERE tier <> 'legendary' ORDER BY n DESC, p_partkey LIMIT 20""")
def o03_cut_then_filter(spark, sf):
    n = items(spark, sf).groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(c("n").desc(), "p_partkey").limit(40)
    return top.join(products(spark, sf), "p_partkey").filter("tier <> 'legendary'").orderBy(c("n").desc(), "p_partkey").limit(20).select("p_partkey", "n")


@q(f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT * FROM lineitem WHERE l_partkey = 7 ORDER BY l_quantity DESC, l_orderkey, l_linenumber, {_TIE} LIMIT 50) WHERE l_linestatus = 'O' ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey LIMIT 20""")
def o04_two_stage(spark, sf):
    i = items(spark, sf).filter("l_partkey = 7")
    return ranking.two_stage_top(i, [c("l_quantity").desc(), c("l_orderkey"), c("l_linenumber"), *map(c, TIE)], 50, c("l_linestatus") == "O", [c("l_quantity").desc(), c("l_extendedprice").desc(), c("l_orderkey")], 20).select("l_orderkey", "l_linenumber", "l_extendedprice")


@q("SELECT p_name, n, row_number() OVER (ORDER BY n DESC, p_name) AS place FROM (SELECT p_name, count(*) n FROM part GROUP BY 1)")
def o09_demand_then_name(spark, sf):
    n = table(spark, sf, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return ranking.numbered(n, [c("n").desc(), c("p_name")], "place")


@q("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def o10_page(spark, sf):
    return ranking.page(table(spark, sf, "orders"), [c("o_orderdate").desc(), c("o_orderkey")], 3, 80).select("o_orderkey")


@q(f"SELECT p_type, count(*) AS pill, (SELECT count(*) FROM (SELECT 1 FROM part LIMIT 48)) AS shown FROM part WHERE {_TIER} <> 'standard' OR p_size > 5 GROUP BY 1")
def o12_capped_with_pills(spark, sf):
    good = products(spark, sf).filter("tier <> 'standard' OR p_size > 5")
    rows, pills = ranking.capped(good, [c("p_size").desc(), c("p_partkey")], 48, "p_type")
    return pills.select("p_type", c("count").alias("pill")).withColumn("shown", rows.agg(F.count(F.lit(1))).scalar())


@q("SELECT 'R' AS source, l_partkey, l_extendedprice AS price, l_shipdate AS sold_at FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'A', l_partkey, l_extendedprice, l_shipdate FROM lineitem WHERE l_returnflag = 'A'")
def u01_price_history_union(spark, sf):
    part = lambda s: items(spark, sf).filter(c("l_returnflag") == s).select(F.lit(s).alias("source"), "l_partkey", c("l_extendedprice").alias("price"), c("l_shipdate").alias("sold_at"))
    return part("R").unionByName(part("A"))


@q("SELECT l_extendedprice AS price FROM lineitem WHERE l_quantity = 1 UNION ALL SELECT o_totalprice FROM orders WHERE o_totalprice < 2000")
def u02_values_union(spark, sf):
    return items(spark, sf).filter("l_quantity = 1").select(c("l_extendedprice").alias("price")).union(table(spark, sf, "orders").filter("o_totalprice < 2000").select("o_totalprice"))


@q(_MERGE + " SELECT count(*) AS urls, count(*) FILTER (WHERE source_rank = 1) AS first_source FROM o")
def u03_union_distinct(spark, sf):
    return merged(spark, sf).agg(F.count(F.lit(1)).alias("urls"), F.count_if(c("source_rank") == 1).alias("first_source"))


@q("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def u05_difference(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey").exceptAll(table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_nationkey").distinct())


@q("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: list_contains(['the', 'of', 'la'], x))) AS overlap FROM documents")
def u06_list_overlap(spark, sf):
    want = F.array(*map(F.lit, ["the", "of", "la"]))
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), lambda x: F.array_contains(want, x))).cast("long").alias("overlap"))


@q("""SELECT DISTINCT p_partkey, v AS variant FROM (SELECT p_partkey, unnest([lower(p_name) || '-x', lower(p_name) || ' x']) AS v FROM part)""")
def u07_query_variants(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lower("p_name"), F.lit("-x")).alias("q"))
    return p.select("p_partkey", F.explode(text.query_variants(c("q"))).alias("variant"))
