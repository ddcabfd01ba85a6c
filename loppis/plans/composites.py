"""Whole pipelines on the stand-in tables: writes, matching, similarity, catalogue, extraction and stream rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loppis.functions import money, stats, text
from loppis.operators import catalog, matching, ranking, review, similar, workflows, writes
from loppis.session import table
from loppis.sources import extract
from loppis.streaming import ticks

from .base import Book
from .relational import _TIE, _TIER, TIE, items, products
from .scalars import search_term_sql, token_score_sql

book = Book()
q = book.query
c = F.col

# --- writes ---------------------------------------------------------------------------------------------------------


def old_new(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    new = o.filter("o_orderkey % 3 = 0").select((c("o_orderkey") + c("o_orderkey") % 2 * 100000).alias("o_orderkey"), "o_custkey", (c("o_totalprice") + 1).alias("o_totalprice"))
    return o.filter("o_orderkey % 4 <> 3"), new


_OLD = """WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 3),
b AS (SELECT o_orderkey + o_orderkey % 2 * 100000 AS o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0)"""


@q(_OLD + " SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice, o_orderpriority FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def k01_upsert_latest(spark, sf):
    old, new = old_new(spark, sf)
    return writes.upsert(old, new, ["o_orderkey"], [c("o_totalprice").desc()])


@q(_OLD + " SELECT * FROM a UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, NULL FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def k02_insert_ignore(spark, sf):
    old, new = old_new(spark, sf)
    return writes.insert_ignore(old, new, ["o_orderkey"], [c("o_totalprice")])


_NUL = """WITH k AS (SELECT CASE WHEN user_id % 4 > 0 THEN user_id END AS user_id, event_type, event_id FROM events)"""


def null_keys(spark, sf):
    return table(spark, sf, "events").select(F.when(c("user_id") % 4 > 0, c("user_id")).alias("user_id"), "event_type", "event_id")


@q(_NUL + " SELECT user_id, event_type, min(event_id) AS event_id FROM k WHERE user_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT * FROM k WHERE user_id IS NULL")
def k02_nulls_distinct(spark, sf):
    return writes.dedup_rows(null_keys(spark, sf), ["user_id", "event_type"], [c("event_id")], nulls_distinct=True)


@q(_NUL + " SELECT user_id, event_type, min(event_id) AS event_id FROM k GROUP BY 1, 2")
def k02_nulls_not_distinct(spark, sf):
    return writes.dedup_rows(null_keys(spark, sf), ["user_id", "event_type"], [c("event_id")], nulls_distinct=False)


@q("SELECT l_orderkey AS listing, l_extendedprice AS price, l_shipdate AS scraped_at FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT l_orderkey, l_extendedprice + 1, l_shipdate FROM lineitem WHERE l_quantity > 49")
def k03_append_snapshots(spark, sf):
    s = items(spark, sf).filter("l_quantity > 49").select(c("l_orderkey").alias("listing"), c("l_extendedprice").alias("price"), c("l_shipdate").alias("scraped_at"))
    return s.unionByName(s.withColumn("price", c("price") + 1))


@q("SELECT p_partkey, upper(p_brand) AS value FROM part")
def k04_full_replace(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_brand").alias("value"))


@q("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def k05_predicate_update(spark, sf):
    return writes.update_where(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), F.expr("o_orderdate < TIMESTAMP_NTZ '1997-01-01'"), {"o_orderstatus": F.lit("X")}).drop("o_orderdate")


@q("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def k06_keyed_delete(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey"))
    return writes.delete_keys(table(spark, sf, "customer").select("c_custkey"), gone, ["c_custkey"])


@q("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size * 10 ELSE p_size END AS p_size FROM part")
def k07_patch(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    ops = p.filter("p_partkey % 4 < 3").select("p_partkey", (c("p_size") * 10).alias("p_size"), F.when(c("p_partkey") % 4 == 0, "clear").when(c("p_partkey") % 4 == 1, "set").otherwise("keep").alias("p_size_op"))
    return writes.patch(p, ops, "p_partkey", ["p_size"])


@q("""SELECT n_regionkey, '{"' || string_agg(n_name || '":' || n_nationkey, ',"' ORDER BY n_name) || '}' AS json FROM nation GROUP BY 1""")
def k08_json_report(spark, sf):
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(m).alias("json"))


@q("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey > 4) ON o_custkey = c_custkey")
def k09_set_null(spark, sf):
    return writes.set_null_on_delete(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_nationkey > 4"), "o_custkey", "c_custkey")


@q("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey > 4)")
def k09_cascade(spark, sf):
    return writes.cascade_delete(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_nationkey > 4"), "o_custkey", "c_custkey").select("o_orderkey")


@q("SELECT p_partkey, coalesce(nullif(p_type, 'SMALL'), 'other') AS domain FROM part")
def k10_default(spark, sf):
    return writes.with_default(table(spark, sf, "part").select("p_partkey", F.nullif("p_type", F.lit("SMALL")).alias("domain")), "domain", F.lit("other"))


# --- similarity -----------------------------------------------------------------------------------------------------

_FILES = "WITH f AS (SELECT DISTINCT p_brand || '/' || p_name || '/' || p_type AS url, regexp_split_to_array(lower(p_name || '_' || p_type), '[_ ]') AS parts, len(p_name || '_' || p_type) AS length FROM part WHERE p_size < 10)"


_OVERLAP = _FILES + """, n AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part WHERE p_size > 45),
s AS (SELECT p_partkey, url, length, len(list_filter(w, lambda x: list_contains(parts, x))) / len(w) AS score FROM n, f)
SELECT p_partkey, url, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, length, url) rn FROM s WHERE score >= 0.75) WHERE rn = 1"""


def overlaps(named, filed):
    """The best file made of the parts `filed` for each of the parts `named`."""
    files = filed.select(F.concat_ws("/", "p_brand", "p_name", "p_type").alias("url"), F.split(F.lower(F.concat_ws("_", "p_name", "p_type")), "[_ ]").alias("parts"), F.length(F.concat_ws("_", "p_name", "p_type")).alias("length")).distinct()
    names = named.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_name").alias("name"))
    return similar.token_overlap_best(names, files, "p_partkey", "name", "url")


@q(_OVERLAP.replace(" WHERE p_size < 10", "").replace(" WHERE p_size > 45", ""))
def j17_token_overlap(spark, sf):
    return overlaps(table(spark, sf, "part"), table(spark, sf, "part"))


_G = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_CAND = f"""WITH d AS (SELECT p_partkey AS id, p_brand, {_G.format("p_name || ' ' || p_type")} AS a FROM part WHERE p_size > 40),
k AS (SELECT p_partkey AS candidate_id, p_name || ' ' || p_type || ' ' || p_size AS candidate_name, p_brand, {_G.format("p_name || ' ' || p_type || ' ' || p_size")} AS b FROM part WHERE p_size < 20),
s AS (SELECT id, candidate_id, candidate_name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS sim FROM d JOIN k USING (p_brand))
SELECT id, candidate_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, candidate_name, candidate_id) AS rank FROM s WHERE sim >= 0.4) WHERE rank <= 5"""


def candidates(dirty, clean):
    """Clean names made of the parts `clean` for each of the parts `dirty`."""
    dirty = dirty.select(c("p_partkey").alias("id"), c("p_brand").alias("brand_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    clean = clean.select(c("p_partkey").alias("id"), c("p_brand").alias("brand_id"), F.concat_ws(" ", "p_name", "p_type", c("p_size").cast("string")).alias("name"))
    return similar.clean_candidates(dirty, clean)


_J18 = _CAND.replace(" WHERE p_size > 40", "").replace(" WHERE p_size < 20", "").replace("JOIN k USING (p_brand)", "JOIN k USING (p_brand) WHERE id <> candidate_id")
_N = "trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))"
#: CTEs that end in x (id, kept): of at most five candidates, those that no kept one before them is like.
_GREEDY = f"""{_J18.replace("SELECT id, candidate_id, round(sim, 6) AS sim, rank FROM", ", r AS (SELECT id, rank, candidate_name AS name FROM")}),
g AS (SELECT id, rank, name, {_N} AS n, list_transform(range(1, len({_N})), lambda i: substr({_N}, i, 2)) AS p FROM r),
near AS (SELECT a.id, a.rank AS i, b.rank AS j, a.n = b.n OR 2.0 * len(list_filter(a.p, lambda y: list_contains(b.p, y))) / (len(a.p) + len(b.p)) > 0.85 AS t FROM g a JOIN g b ON a.id = b.id AND b.rank < a.rank),
t AS (SELECT id, {", ".join(f"coalesce(bool_or(t) FILTER (WHERE i = {i} AND j = {j}), false) AS t{i}{j}" for i in range(2, 6) for j in range(1, i))} FROM near GROUP BY 1),
k2 AS (SELECT *, NOT t21 AS k2 FROM t), k3 AS (SELECT *, NOT (t31 OR k2 AND t32) AS k3 FROM k2), k4 AS (SELECT *, NOT (t41 OR k2 AND t42 OR k3 AND t43) AS k4 FROM k3),
k5 AS (SELECT *, NOT (t51 OR k2 AND t52 OR k3 AND t53 OR k4 AND t54) AS k5 FROM k4),
x AS (SELECT g.id, string_agg(name, '|' ORDER BY rank) AS kept FROM g LEFT JOIN k5 USING (id) WHERE [true, k2, k3, k4, k5][rank] GROUP BY 1)"""


@q(_J18)
def j18_clean_candidates(spark, sf):
    p = table(spark, sf, "part")
    return candidates(p, p).select("id", "candidate_id", F.round("sim", 6).alias("sim"), "rank")


_SUGGESTED = """SELECT id, min(product_id) AS product_id FROM (SELECT a.p_partkey AS id, b.p_partkey AS product_id FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size < 25 AND a.p_size > 40 AND (contains(lower(a.p_name || ' ' || a.p_type), lower(b.p_name)) OR contains(lower(b.p_name), lower(a.p_name || ' ' || a.p_type)))) GROUP BY 1"""


def suggested(suggestions, known):
    """The first of the parts `known` for each suggestion made of a part."""
    s = suggestions.select(c("p_partkey").alias("id"), c("p_brand").alias("brand_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    k = known.select(c("p_partkey").alias("product_id"), c("p_brand").alias("brand_id"), c("p_name").alias("name"))
    return similar.suggestion_duplicates(s, k)


@q(_SUGGESTED.replace(" AND b.p_size < 25 AND a.p_size > 40", ""))
def j19_suggestion_duplicates(spark, sf):
    return suggested(table(spark, sf, "part"), table(spark, sf, "part"))


@q(_GREEDY + " SELECT id, kept FROM x")
def a21_greedy_distinct(spark, sf):
    p = table(spark, sf, "part")
    five = candidates(p, p).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_name"))).alias("r"))
    return five.select("id", F.array_join(similar.distinct_names(c("r.candidate_name")), "|").alias("kept"))


# --- pipelines ------------------------------------------------------------------------------------------------------

_W = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_-]+')"
_C01 = f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark),
d AS (SELECT item_id AS product_id, w[3] AS token, CASE item_id % 3 WHEN 1 THEN 'SKU' ELSE 'MODEL' END AS method, 95 AS score, 0 AS priority, '{{"matched_identifier":"' || w[3] || '","type":"' || CASE item_id % 3 WHEN 1 THEN 'SKU' ELSE 'MODEL' END || '"}}' AS explain FROM b WHERE item_id % 3 > 0
UNION ALL SELECT item_id, w[5], 'SYNONYM', 80, -(item_id % 2), '{{"matched_alias":"' || w[5] || '","canonical_query":"q' || item_id || '"}}' FROM b WHERE item_id % 5 > 0 AND item_id % 7 < 5
UNION ALL SELECT item_id, w[7], 'MODEL', 70, 0, '{{"matched_model_name":"' || w[7] || '"}}' FROM b),
h AS (SELECT doc_id AS listing_id, d.* FROM documents JOIN d ON len(token) >= 3 AND regexp_matches(' ' || text || ' ', '(?i)[^\\w-]' || token || '[^\\w-]'))
SELECT listing_id, product_id, method, score, explain FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, priority, product_id) rn FROM h) WHERE rn = 1"""


def matcher_tables(spark, sf):
    """(identifiers, synonyms, models) of products made of benchmark items."""
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z0-9_-]+)"), F.lit(1)).alias("w"))
    i = c("item_id")
    identifiers = b.select(i.alias("product_id"), F.get("w", F.lit(2)).alias("value"), F.when(i % 3 == 0, "EAN").when(i % 3 == 1, "SKU").otherwise("MODEL").alias("type"), i.alias("seq"))
    synonyms = b.select(F.when(i % 5 > 0, i).alias("product_id"), F.get("w", F.lit(4)).alias("alias"), F.concat(F.lit("q"), i.cast("string")).alias("canonical_query"), F.when(i % 7 < 5, "alias").when(i % 7 == 5, "exact").otherwise("abbrev").alias("match_type"), (i % 2).alias("priority"), i.alias("seq"))
    models = b.select(i.alias("product_id"), F.get("w", F.lit(6)).alias("model"), i.alias("seq"))
    return identifiers, synonyms, models


@q(_C01)
def c01_matcher(spark, sf):
    listings = table(spark, sf, "documents").select(c("doc_id").alias("listing_id"), c("text").alias("title"))
    return matching.cascade(listings, *matcher_tables(spark, sf))


_RANGE = """r0 AS (SELECT l_partkey AS k, l_extendedprice AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) rn, count(*) OVER (PARTITION BY l_partkey) n FROM lineitem WHERE l_returnflag IN ('R', 'A')),
r1 AS (SELECT k, max(CASE WHEN rn = CAST(floor(n * 0.25) AS BIGINT) + 1 THEN x END) q1, max(CASE WHEN rn = CAST(floor(n * 0.75) AS BIGINT) + 1 THEN x END) q3 FROM r0 GROUP BY 1),
rng AS (SELECT r0.k, min(x) AS low, max(x) AS high, CAST(floor(median(x) + 0.5) AS BIGINT) AS median, count(*) AS n FROM r0 JOIN r1 ON r0.k = r1.k WHERE n < 4 OR x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 GROUP BY 1 HAVING count(*) >= 3)"""


@q(f"WITH {_RANGE} SELECT p_partkey, p_name, n_active, low, high, median, n FROM part LEFT JOIN rng ON p_partkey = k LEFT JOIN (SELECT l_partkey, count(*) AS n_active FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON p_partkey = l_partkey")
def c02_product_page(spark, sf):
    sold = items(spark, sf).filter("l_returnflag IN ('R', 'A')").select(c("l_partkey").alias("p_partkey"), "l_extendedprice")
    rng = stats.robust_range(sold, ["p_partkey"], "l_extendedprice").withColumnRenamed("count", "n")
    active = items(spark, sf).filter("l_linestatus = 'O'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_active"))
    return table(spark, sf, "part").select("p_partkey", "p_name").join(rng, "p_partkey", "left").join(active, "p_partkey", "left")


@q(f"""SELECT o_orderkey, low, high FROM (SELECT o_orderkey, l_partkey FROM orders JOIN (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, {_TIE}) rn FROM lineitem) WHERE rn = 1) ON o_orderkey = l_orderkey)
JOIN (SELECT l_partkey AS k, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1 HAVING count(*) >= 3) ON l_partkey = k""")
def c03_market_price(spark, sf):
    best = ranking.best_match(items(spark, sf), "l_orderkey", "l_quantity", [c("l_linenumber"), *map(c, TIE)]).select(c("l_orderkey").alias("o_orderkey"), "l_partkey")
    rng = stats.market_range(items(spark, sf).filter("l_returnflag IN ('R', 'A')"), ["l_partkey"], "l_extendedprice").drop("count")
    return table(spark, sf, "orders").select("o_orderkey").join(best, "o_orderkey").join(rng, "l_partkey").select("o_orderkey", "low", "high")


_PCT = "CAST(floor(quantile_cont(value, {0}) + 0.5) AS BIGINT)"


@q(f"SELECT user_id, count(value) AS count, {_PCT.format(0.25)} AS p25, {_PCT.format(0.5)} AS p50, {_PCT.format(0.75)} AS p75 FROM events WHERE event_type = 'purchase' GROUP BY 1")
def c04_observation_stats(spark, sf):
    return stats.interpolated_percentiles(table(spark, sf, "events").filter("event_type = 'purchase'"), ["user_id"], "value")


@q(f"""SELECT r_name, count(*) AS n FROM (SELECT p_partkey % 25 AS nation FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 48) ON p_partkey = l_partkey WHERE l_partkey IS NOT NULL OR {_TIER} <> 'standard')
JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def c05_browse_roots(spark, sf):
    seen = items(spark, sf).filter("l_linestatus = 'O' AND l_quantity > 48").select(c("l_partkey").alias("p_partkey"), F.lit(True).alias("seen")).distinct()
    good = products(spark, sf).join(seen, "p_partkey", "left").filter("seen OR tier <> 'standard'")
    counts = good.groupBy((c("p_partkey") % 25).cast("int").alias("category_id")).agg(F.count(F.lit(1)).alias("n"))
    t = table(spark, sf, "nation").select(c("n_nationkey").alias("category_id"), c("n_regionkey").alias("parent_id"))
    return catalog.roll_up(counts, t).join(table(spark, sf, "region"), c("root_id") == c("r_regionkey")).select("r_name", "n")


@q(f"SELECT p_partkey % 25 AS category, count(*) AS n FROM part WHERE {_TIER} <> 'standard' AND p_partkey % 5 = 2 GROUP BY 1 HAVING count(*) >= 2")
def c05_browse_root(spark, sf):
    return products(spark, sf).filter("tier <> 'standard' AND p_partkey % 5 = 2").groupBy((c("p_partkey") % 25).alias("category")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@q(f"""WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 40)
SELECT 'popular' AS shelf, p_partkey FROM (SELECT p_partkey FROM n JOIN part ON l_partkey = p_partkey WHERE {_TIER} <> 'legendary' ORDER BY n DESC, p_partkey LIMIT 20)
UNION ALL SELECT 'legendary', p_partkey FROM (SELECT p_partkey FROM part WHERE {_TIER} = 'legendary' ORDER BY p_name, p_partkey LIMIT 24)""")
def c06_discover(spark, sf):
    n = items(spark, sf).filter("l_linestatus = 'O'").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "p_partkey").limit(40)
    popular = n.join(products(spark, sf), "p_partkey").filter("tier <> 'legendary'").orderBy(c("n").desc(), "p_partkey").limit(20)
    legendary = products(spark, sf).filter("tier = 'legendary'").orderBy("p_name", "p_partkey").limit(24)
    return popular.select(F.lit("popular").alias("shelf"), "p_partkey").unionByName(legendary.select(F.lit("legendary").alias("shelf"), "p_partkey"))


@q("""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS key, CASE WHEN contains(url, 'blog.') THEN 1 WHEN contains(url, 'm.') THEN 2 ELSE 3 END AS s FROM pages),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, page_id) rn FROM u) WHERE rn = 1)
SELECT regexp_replace(left(sha256('shop:' || key), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id, s, row_number() OVER (PARTITION BY s ORDER BY page_id) AS turn FROM o""")
def c07_federated_search(spark, sf):
    u = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("key"), F.when(F.contains("url", F.lit("blog.")), 1).when(F.contains("url", F.lit("m.")), 2).otherwise(3).alias("s"))
    turns = ranking.numbered(ranking.merged_sources(u, "key", "s", "page_id"), [c("page_id"), c("key")], "turn", "s")
    return turns.select(text.deterministic_id(F.lit("shop"), c("key")).alias("id"), "s", "turn")


@q("""SELECT c_custkey, coalesce(n, 0) AS listings, latest FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey
LEFT JOIN (SELECT o_custkey, o_orderkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) rn FROM orders) WHERE rn = 1) b ON c_custkey = b.o_custkey""")
def c08_dashboard(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    n = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))
    last = writes.first_by(o, ["c_custkey"], [c("o_orderdate").desc(), c("o_orderkey")]).select("c_custkey", c("o_orderkey").alias("latest"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("listings"), "latest")


@q("""WITH t AS (SELECT p_partkey, p_brand, lower(p_name) AS model, p_name FROM part WHERE NOT regexp_matches(lower(p_name), 'cover|case|dust|parts|replacement|adapter|cable|strap|stand|bag|gig|manual|knob|screw|bolt')),
k AS (SELECT DISTINCT p_brand, lower(p_name) AS model FROM part WHERE p_size > 48)
SELECT p_brand, model, count(*) AS n, arg_min(p_name, p_partkey) AS name FROM t ANTI JOIN k USING (p_brand, model) GROUP BY 1, 2""")
def c09_suggestion_mining(spark, sf):
    p = table(spark, sf, "part").withColumn("model", text.extract_model(F.lower(F.concat_ws(" ", "p_brand", "p_name")), c("p_brand")))
    new = p.filter(~text.is_noise(c("p_name"))).join(p.filter("p_size > 48").select("p_brand", "model"), ["p_brand", "model"], "left_anti")
    return new.groupBy("p_brand", "model").agg(F.count(F.lit(1)).alias("n"), F.min_by("p_name", "p_partkey").alias("name"))


_DIRTY = """p_name || CASE p_size % 4 WHEN 0 THEN ' ' || (1900 + p_size) WHEN 1 THEN ' Murphy  Lab' WHEN 2 THEN ' chitarra relic' ELSE ' with hard case strap tools and papers' END"""


@q(rf"""WITH n AS (SELECT {_DIRTY} AS name, CASE WHEN p_type = 'SMALL' THEN 'acme-acme-one' ELSE 'acme-one' END AS slug FROM part)
SELECT flag, count(*) AS n FROM (SELECT unnest([CASE WHEN regexp_matches(name, '\d{{4}}') THEN 'has_year' END, CASE WHEN regexp_matches(name, '(?i)refin|relic|aged|murphy\s+lab|played\s+in') THEN 'has_condition_word' END,
CASE WHEN regexp_matches(name, '(?i)chitarra|basso|clavier|guitare|elektrisch|gitarre|acustica|elettrico|elettrica') THEN 'has_language_qualifier' END, CASE WHEN contains(slug, 'acme-acme') THEN 'duplicated_brand' END,
CASE WHEN len(regexp_split_to_array(trim(name), '\s+')) > 8 THEN 'too_long' END]) AS flag FROM n) WHERE flag IS NOT NULL GROUP BY 1""")
def c10_dirty_queue(spark, sf):
    size = c("p_size") % 4
    more = F.when(size == 0, (c("p_size") + 1900).cast("string")).when(size == 1, "Murphy  Lab").when(size == 2, "chitarra relic").otherwise("with hard case strap tools and papers")
    slug = F.when(c("p_type") == "SMALL", F.lit("acme-acme-one")).otherwise("acme-one")
    flags = text.dirty_flags(slug, F.concat_ws(" ", "p_name", more), F.lit("Acme"))
    return table(spark, sf, "part").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


_TERMS = search_term_sql("SELECT p_partkey AS key, p_name || ' ' || p_type || ' Vintage 1983 mint' AS t FROM part")


@q(f"{_GREEDY}, {_TERMS} SELECT id, value AS term, kept AS candidates FROM x JOIN z ON id = key")
def c11_cleanup_candidates(spark, sf):
    parts = table(spark, sf, "part")
    best = candidates(parts, parts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_name"))).alias("r"))
    p = table(spark, sf, "part").select(c("p_partkey").alias("id"), text.strip_search_term(F.concat_ws(" ", "p_name", "p_type", F.lit("Vintage 1983 mint"))).alias("term"))
    return p.join(best, "id").select("id", "term", F.array_join(similar.distinct_names(c("r.candidate_name")), "|").alias("candidates"))


_M = """WITH m AS (SELECT l_orderkey AS listing_id, l_partkey AS product_id, max(l_quantity) AS score FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2),
g AS (SELECT p_partkey AS dirty_id, p_partkey - 1 AS clean_id FROM part WHERE p_partkey % 10 = 1)"""


@q(_M + " SELECT * FROM m UNION ALL SELECT listing_id, clean_id, score FROM m JOIN g ON product_id = dirty_id ANTI JOIN (SELECT listing_id, product_id AS clean_id FROM m) USING (listing_id, clean_id)")
def c12_merge(spark, sf):
    m = items(spark, sf).filter("l_quantity > 40").groupBy(c("l_orderkey").alias("listing_id"), c("l_partkey").alias("product_id")).agg(F.max("l_quantity").alias("score"), F.lit("FUZZY").alias("method"))
    p = table(spark, sf, "part").select(c("p_partkey").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("cleanup_status"))
    g = p.filter("id % 10 = 1").select(c("id").alias("dirty_id"), (c("id") - 1).alias("clean_id"), F.lit(1).alias("decided_at"))
    return review.merge_into(m, p, g)["matches"].drop("method")


@q("SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'approved' ELSE 'pending' END AS status FROM part")
def c12_bulk_status(spark, sf):
    p = table(spark, sf, "part").select(c("p_partkey").alias("id"), "p_size", F.lit("pending").alias("status"))
    return workflows.set_status(p, p.filter("p_size > 40"), "approved").select("id", "status")


def clean_products(spark, sf):
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), text.slugify(c("p_name")).alias("slug"), c("p_name").alias("canonical_name"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("cleanup_status"), "p_size")


@q("""WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, upper(p_name) || ' (' || p_partkey || ')' AS clean, p_size % 3 = 0 AS dirty FROM part)
SELECT id, 'old-' || id AS slug, p_name AS canonical_name, CASE WHEN dirty THEN 'inactive' ELSE 'active' END AS status, CASE WHEN dirty THEN 'merged' END AS cleanup_status FROM n
UNION ALL SELECT regexp_replace(left(sha256('kg_product:' || replace(lower(p_name), ' ', '-') || '-' || id), 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'), replace(lower(p_name), ' ', '-') || '-' || id, clean, 'active', 'clean' FROM n WHERE dirty""")
def c12_self_clean(spark, sf):
    """A dirty product gives way to a new one under its clean name."""
    p = clean_products(spark, sf).withColumn("id", c("id").cast("string")).withColumn("slug", F.concat(F.lit("old-"), "id"))
    names = p.filter("p_size % 3 = 0").select(c("id").alias("dirty_id"), F.concat(F.upper("canonical_name"), F.lit(" ("), "id", F.lit(")")).alias("clean_name"), F.lit(1).alias("decided_at"))
    none = spark.createDataFrame([], "listing_id string, product_id string, method string, score int")
    return review.clean_by_name(none, p.drop("p_size"), names)["products"]


@q("SELECT p_partkey AS id, CASE WHEN p_size > 30 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN p_size > 30 THEN 'inactivated' END AS cleanup_status FROM part")
def c12_inactivate(spark, sf):
    p = clean_products(spark, sf)
    twice = p.filter("p_size > 30").select("id")
    return review.inactivate(p, twice.unionByName(twice)).select("id", "status", "cleanup_status")


def suggestions(spark, sf):
    """Suggestions made of parts; their names repeat."""
    p = table(spark, sf, "part")
    return p.select(c("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("canonical_name"), c("p_brand").alias("brand_id"), c("p_type").alias("category_id"), F.lit("pending").alias("status"), c("p_size").alias("listing_count"))


def accepted(spark, sf):
    """Products whose names some suggestions take."""
    p = table(spark, sf, "part").filter("p_type = 'SMALL'").select(F.concat_ws(" ", "p_name", "p_type").alias("canonical_name")).distinct()
    return p.select(text.slugify(c("canonical_name")).alias("slug"), "canonical_name", F.lit("old").alias("brand_id"), F.lit("old").alias("category_id"), F.lit("active").alias("status"), F.lit("classic").alias("tier"))


_SUG = """WITH s AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS canonical_name, p_brand, p_type, p_size FROM part),
old AS (SELECT DISTINCT replace(lower(p_name || ' ' || p_type), ' ', '-') AS slug, p_name || ' ' || p_type AS canonical_name FROM part WHERE p_type = 'SMALL')"""


@q(_SUG + """ SELECT slug, canonical_name, 'classic' AS tier, 'active' AS status FROM old
UNION ALL SELECT DISTINCT replace(lower(canonical_name), ' ', '-'), canonical_name, 'standard', 'active' FROM s WHERE p_size % 2 = 0 AND p_type <> 'SMALL'""")
def c12_approve(spark, sf):
    s = suggestions(spark, sf).withColumns({n: F.lit(None).cast("string") for n in ("reviewed_by", "reviewed_at", "notes")})
    old = accepted(spark, sf).withColumn("id", c("slug"))
    chosen = s.filter("listing_count % 2 = 0").select("id", F.lit("approve").alias("action"), F.lit("").alias("canonical_name"), F.lit("").alias("model_name"), F.lit("").alias("product_id"), F.lit("me").alias("reviewer"), F.lit("today").alias("decided_at"))
    synonyms = spark.createDataFrame([], "alias string, product_id string, canonical_query string, match_type string, lang string, priority int")
    matches = spark.createDataFrame([], "listing_id string, product_id string, method string, score int, explain string")
    return review.decide(s, old, synonyms, matches, chosen)["products"].select("slug", "canonical_name", "tier", "status")


@q("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'pending' ELSE 'approved' END AS status FROM part")
def c12_send_back(spark, sf):
    s = suggestions(spark, sf).withColumn("status", F.lit("approved"))
    return workflows.set_status(s, s.filter("listing_count > 25"), "pending").select("id", "status")


@q("""WITH m AS (SELECT l_orderkey AS listing_id, l_partkey AS product_id, max(l_quantity) AS score FROM lineitem WHERE l_quantity > 30 GROUP BY 1, 2),
a AS (SELECT DISTINCT l_orderkey AS listing_id, l_partkey AS product_id FROM lineitem WHERE l_returnflag = 'R')
SELECT listing_id, product_id, CASE WHEN a.listing_id IS NULL THEN 'SKU' ELSE 'FUZZY' END AS method, CASE WHEN a.listing_id IS NULL THEN CAST(score AS INT) ELSE 100 END AS score FROM m FULL JOIN a USING (listing_id, product_id)""")
def c12_approve_match(spark, sf):
    keys = [c("l_orderkey").alias("listing_id"), c("l_partkey").alias("product_id")]
    m = items(spark, sf).filter("l_quantity > 30").groupBy(*keys).agg(F.lit("SKU").alias("method"), F.max("l_quantity").cast("int").alias("score"))
    return review.confirm_matches(m, items(spark, sf).filter("l_returnflag = 'R'").select(*keys))


@q(_SUG + """, g AS (SELECT canonical_name, min(p_name) AS group_name FROM s JOIN (SELECT DISTINCT p_name, p_type FROM part) USING (p_type) WHERE p_size > 0 AND p_type = 'LARGE' GROUP BY 1)
SELECT group_name, array_to_string(list_sort(list(id)), ',') AS members, sum(p_size) AS listing_count, group_name IN (SELECT canonical_name FROM old) AS "exists" FROM (SELECT id, p_size, coalesce(g.group_name, canonical_name) AS group_name FROM s LEFT JOIN g USING (canonical_name)) GROUP BY 1""")
def c12_regroup(spark, sf):
    """Two groups claim each large item: one by its own name, and the first of all, which wins."""
    s = suggestions(spark, sf)
    large = table(spark, sf, "part").filter("p_type = 'LARGE'")
    first = large.agg(F.min("p_name")).scalar()
    own = large.select(c("p_name").alias("group_name"), F.concat_ws(" ", "p_name", "p_type").alias("member"))
    both = own.unionByName(own.select(first.alias("group_name"), "member")).unionByName(own.select("group_name", F.lit("nobody's").alias("member")))
    return workflows.regroup(s, both, accepted(spark, sf)).select("group_name", F.array_join("members", ",").alias("members"), "listing_count", "exists")


@q("SELECT p_type AS slug, p_size AS category, count(*) AS n FROM part WHERE p_type IN ('SMALL', 'LARGE') GROUP BY 1, 2 UNION ALL SELECT 'MISSING', -1, 1")
def c12_known_only(spark, sf):
    p = table(spark, sf, "part")
    assigned = p.groupBy(c("p_type").alias("slug"), c("p_size").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    good, rest = workflows.known_only(assigned, spark.createDataFrame([("SMALL",), ("LARGE",), ("MISSING",)], "slug string"))
    return good.unionByName(rest.select("slug", F.lit(-1).alias("category"), F.lit(1).cast("long").alias("n")))


@q("SELECT p_brand AS category, '{\"brands\":{\"' || string_agg(p_type || '\":{\"products\":' || n || '}', ',\"' ORDER BY p_type) || '}}' AS json FROM (SELECT p_brand, p_type, count(*) n FROM part GROUP BY 1, 2) GROUP BY 1")
def c13_graph_export(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("products"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_type", F.struct("products")))))
    return n.groupBy(c("p_brand").alias("category")).agg(F.to_json(F.struct(m.alias("brands"))).alias("json"))


@q("""WITH p AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || p_partkey AS slug, p_partkey AS key, p_type AS category, p_brand AS brand, p_name AS name FROM part)
SELECT a.slug, a.category, a.brand, a.name, b.slug AS sibling FROM p a LEFT JOIN p b ON b.key = a.key + 1""")
def c13_graph_round_trip(spark, sf):
    p = table(spark, sf, "part").select(F.concat_ws("-", text.slugify(c("p_name")), c("p_partkey").cast("string")).alias("slug"), c("p_type").alias("category"), c("p_brand").alias("brand"), c("p_name").alias("name"), c("p_partkey").alias("key"))
    rel = p.select(c("slug").alias("from"), (c("key") + 1).alias("key")).join(p.select(c("slug").alias("to"), "key"), "key").select("from", "to", F.lit("sibling").alias("type"))
    out = catalog.export_graph(p.drop("key"), rel, "1.0.0")
    schema = "brands map<string,struct<products:map<string,struct<name:string,related:array<string>>>>>"
    b = out.select("category", F.explode(F.from_json("json", schema)["brands"]).alias("brand", "b"))
    return b.select("category", "brand", F.explode("b.products").alias("slug", "p")).select("slug", "category", "brand", "p.name", F.explode_outer("p.related").alias("sibling"))


_FOUND = ["p_type || ' ' || split_part(p_name, ' ', 2)", "CASE WHEN p_size % 3 = 0 THEN p_name || ' ' || p_type || ' used' ELSE p_type || ' ' || p_brand END", "p_name || ' ' || p_brand", "p_name || ' ' || p_type"]


@q(f"""WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS name, unnest([0, 1, 2]) AS arrival, unnest([{", ".join(_FOUND[:3])}]) AS title, p_size % 2 AS odd FROM part),
s AS (SELECT *, CASE WHEN odd = arrival % 2 THEN 5 ELSE 0 END AS used, {token_score_sql("name", "title")} AS score FROM t)
SELECT id, len(string_split(name, ' ')) AS n_tokens, score, arrival FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, used DESC, arrival) AS rn FROM s) WHERE rn = 1""")
def c14_page_resolution(spark, sf):
    """The best of the first three pages found for each part; a fourth, with the full name, is not considered."""
    name = F.concat_ws(" ", "p_name", "p_type")
    found = F.posexplode(F.array(*map(F.expr, _FOUND))).alias("arrival", "title")
    e = table(spark, sf, "part").select(c("p_partkey").alias("id"), name.alias("name"), "p_size", found)
    e = e.withColumn("score", text.token_score(c("name"), c("title"))).withColumn("used", F.when(c("p_size") % 2 == c("arrival") % 2, 5).otherwise(0))
    best = ranking.ranked_candidates(e, "id", "arrival", "score", "used").filter("rank = 1")
    return best.select("id", F.size(text.tokens(c("name"))).cast("long").alias("n_tokens"), "score", "arrival")


@q("""SELECT l_partkey, l_orderkey, CAST(floor(l_extendedprice * CASE l_returnflag WHEN 'A' THEN 7.0 WHEN 'R' THEN 7.46 ELSE 7.0 END + 0.5) AS BIGINT) AS dkk FROM lineitem l SEMI JOIN (SELECT l_orderkey o, min(l_linenumber) m FROM lineitem GROUP BY 1) f ON l.l_orderkey = f.o AND l.l_linenumber = f.m WHERE l_quantity > 30""")
def c16_sold_ingest(spark, sf):
    i = items(spark, sf)
    first = i.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    cur = F.when(c("l_returnflag") == "A", "USD").when(c("l_returnflag") == "R", "EUR").otherwise("XYZ")
    return i.join(first, ["l_orderkey", "l_linenumber"], "left_semi").filter("l_quantity > 30").select("l_partkey", "l_orderkey", money.to_dkk(c("l_extendedprice"), cur, money.BATCH, "usd").alias("dkk"))


@q("SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS deleted FROM lineitem")
def c17_match_cleanup(spark, sf):
    i = items(spark, sf)
    order = [c("l_quantity").desc(), c("l_shipdate").desc(), *map(c, TIE)]
    kept = writes.first_by(i, ["l_orderkey", "l_linenumber"], order).agg(F.count(F.lit(1)))
    gone = writes.rest_by(i, ["l_orderkey", "l_linenumber"], order).agg(F.count(F.lit(1)))
    return i.agg(F.count(F.lit(1)).alias("rows")).withColumns({"keys": kept.scalar(), "deleted": gone.scalar()})


@q("SELECT r_name || '/' || n_name AS slug, r_name AS root, r_name AS parent, n_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name, NULL, r_name FROM region")
def c18_category_seed(spark, sf):
    r = table(spark, sf, "region")
    paths = table(spark, sf, "nation").join(r, c("n_regionkey") == c("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("slug")).unionByName(r.select(c("r_name").alias("slug")))
    return catalog.seed_categories(paths)


@q(f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 25 AS cat, p_partkey % 11 > 0 AS active, CASE WHEN p_partkey % 5 = 0 THEN 'standard' ELSE {_TIER} END AS tier,
CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'thumb72x72/' ELSE 'hero/' END || p_partkey END AS hero, CASE WHEN p_partkey % 2 = 0 THEN 'img/' || p_partkey END AS img FROM part),
b AS (SELECT n_regionkey, arg_min(coalesce(hero, img), (-score, id)) AS img, max(score) AS score FROM (SELECT *, CASE WHEN tier = 'legendary' AND hero IS NOT NULL THEN 6 WHEN tier = 'classic' AND hero IS NOT NULL THEN 5 WHEN tier = 'legendary' AND img IS NOT NULL THEN 4 WHEN tier = 'classic' AND img IS NOT NULL THEN 3 WHEN hero IS NOT NULL THEN 2 WHEN img IS NOT NULL THEN 1 ELSE 0 END AS score FROM p WHERE active)
JOIN nation ON cat = n_nationkey WHERE score > 0 AND NOT contains(coalesce(hero, img), 'thumb72x72') GROUP BY 1)
SELECT r_regionkey AS id, r_name AS slug, CASE WHEN r_name = 'ASIA' THEN 'editor.jpg' WHEN r_name <> 'EUROPE' AND score >= 2 THEN img ELSE 'old.jpg' END AS image_url FROM region LEFT JOIN b ON r_regionkey = n_regionkey""")
def c18_category_images(spark, sf):
    roots = table(spark, sf, "region").select(c("r_regionkey").alias("id"), c("r_name").alias("slug"), F.lit("old.jpg").alias("image_url"))
    tree = table(spark, sf, "nation").select(c("n_nationkey").alias("id"), c("n_regionkey").alias("parent_id"))
    key = c("p_partkey")
    hero = F.when((key % 5 > 0) & (key % 3 == 0), F.concat(F.when(key % 7 == 0, "thumb72x72/").otherwise("hero/"), key.cast("string")))
    p = products(spark, sf).select(
        key.alias("id"), (key % 25).cast("int").alias("category_id"), F.when(key % 11 > 0, "active").otherwise("inactive").alias("status"), F.when(key % 5 == 0, "standard").otherwise(c("tier")).alias("tier"),
        hero.alias("hero_image_url"), F.when(key % 2 == 0, F.concat(F.lit("img/"), key.cast("string"))).alias("image_url"),
    )
    chosen = spark.createDataFrame([("ASIA", "editor.jpg"), ("EUROPE", None)], "slug string, choice string")
    return catalog.category_images(roots, tree, p, chosen)


@q("SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 10) AS typed, round(100.0 * count(*) FILTER (WHERE p_size > 10) / count(*), 1) AS percent, (SELECT max(n) FROM (SELECT count(*) n FROM part GROUP BY p_type)) AS largest FROM part")
def c19_coverage(spark, sf):
    p = table(spark, sf, "part")
    most = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"))
    a = p.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("p_size") > 10).alias("typed"))
    return a.select("total", "typed", F.round(c("typed") * 100 / c("total"), 1).alias("percent"), most.scalar().alias("largest"))


@q(f"SELECT o_custkey, count(*) AS saved, count(l_partkey) AS matched FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, {_TIE}) rn FROM lineitem) WHERE rn = 1) ON o_orderkey = l_orderkey GROUP BY 1")
def c20_saved_listings(spark, sf):
    best = ranking.best_match(items(spark, sf), "l_orderkey", "l_quantity", [c("l_linenumber"), *map(c, TIE)]).select(c("l_orderkey").alias("o_orderkey"), "l_partkey")
    return table(spark, sf, "orders").join(best, "o_orderkey", "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("saved"), F.count("l_partkey").alias("matched"))


@q("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS watchlists, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS saved FROM customer")
def c21_admin_rollup(spark, sf):
    n = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("a"), F.count_if(c("o_orderstatus") == "F").alias("b"))
    return table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("a", F.lit(0)).alias("watchlists"), F.coalesce("b", F.lit(0)).alias("saved"))


@q("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80 THEN event_type ELSE 'none' END AS image FROM events")
def c22_promote_image(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.lit("none").alias("image"), "event_type", F.from_json("props", "k int").alias("p"))
    return writes.update_where(e, c("p.k") >= 80, {"image": c("event_type")}).select("event_id", "image")


@q("""SELECT o_custkey, string_agg(CASE WHEN rn <= 5 THEN '#' || o_orderkey END, ', ' ORDER BY o_orderkey) || CASE WHEN max(n) > 5 THEN ' and ' || (max(n) - 5) || ' more' ELSE '' END AS digest FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn, count(*) OVER (PARTITION BY o_custkey) n FROM orders) GROUP BY 1""")
def c23_alert_digest(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    five = F.array_join(F.transform(F.slice("o", 1, 5), lambda x: F.concat(F.lit("#"), x.cast("string"))), ", ")
    more = F.when(F.size("o") > 5, F.concat(F.lit(" and "), (F.size("o") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("o_custkey", F.concat(five, more).alias("digest"))


# --- extraction -----------------------------------------------------------------------------------------------------


@q("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(html, 'lang="([a-z]+)', 1) AS lang, len(regexp_extract_all(html, 'href=')) AS links FROM pages""")
def s14_page_titles(spark, sf):
    h = c("html")
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract(h, 'lang="([a-z]+)', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit("href="), F.lit(0))).cast("long").alias("links")
    )


@q("SELECT page_id, left(coalesce(list_reduce(list_transform(regexp_extract_all(html, '<p>([^<]{40,})</p>', 1), lambda x: trim(x)), lambda a, b: a || chr(10) || chr(10) || b), ''), 1000) AS body FROM pages WHERE regexp_matches(html, '<p>[^<]{40,}</p>')")
def s15_paragraphs(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.paragraphs(c("html")).alias("body")).filter("body <> ''")


# --- stream rules in batch form -------------------------------------------------------------------------------------


@q("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn = 1")
def st04_notify_once(spark, sf):
    return ticks.notify_once_batch(table(spark, sf, "events"), ["user_id", "event_type"], [c("ts"), c("event_id")]).select("user_id", "event_type", "event_id")


@q("SELECT user_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS is_active FROM events GROUP BY 1")
def st06_expiry(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    seen = e.groupBy("user_id").agg(F.max("ts").alias("scraped_at")).withColumn("is_active", F.lit(True))
    return ticks.expire(seen, e.agg(F.max("ts")).scalar(), hours=2).select("user_id", "is_active")


@q("SELECT o_orderkey AS id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 > 0 THEN o_orderdate END AS t FROM orders) WHERE t IS NULL OR t < TIMESTAMP '2001-12-18' ORDER BY t ASC NULLS FIRST, id LIMIT 200")
def st07_refresh(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 50 > 0, c("o_orderdate").cast("timestamp")).alias("refreshed_at"))
    return ticks.refresh_selection(o, F.lit("2002-01-01").cast("timestamp")).select("id")


@q("SELECT o_orderkey AS product_slug, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 10) THEN 'processing' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS status FROM orders")
def st08_queue(spark, sf):
    o = table(spark, sf, "orders").select(c("o_orderkey").alias("product_slug"), F.when(c("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), c("o_orderdate").alias("created_at"))
    return ticks.take_jobs(o).select("product_slug", "status")


@q("SELECT DISTINCT o_custkey AS product_slug, 'pending' AS status FROM orders LEFT JOIN (SELECT l_partkey, count(*) n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20 GROUP BY 1) ON o_custkey = l_partkey WHERE coalesce(n, 0) < 5")
def st09_enqueue(spark, sf):
    sold = items(spark, sf).filter("l_returnflag = 'R' AND l_quantity > 20").select(c("l_partkey").alias("product_slug"))
    return ticks.enqueue(table(spark, sf, "orders").select(c("o_custkey").alias("product_slug")), sold)


@q("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, t + 3600 AS ends, 1 AS n, true AS ok FROM e WHERE i = 1
UNION ALL SELECT e.user_id, e.i, CASE WHEN e.t > f.ends THEN e.t + 3600 ELSE f.ends END, CASE WHEN e.t > f.ends THEN 1 WHEN f.n < 2 THEN f.n + 1 ELSE f.n END, e.t > f.ends OR f.n < 2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, count(*) AS requests, count(*) FILTER (WHERE ok) AS allowed FROM f GROUP BY 1""")
def st10_rate_limit(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("t"))
    return ticks.limited(e, "user_id", "t", 3600.0, 2)
