"""What comes in, on the stand-in tables: graph files, resolved pages, sold prices, the fetch queue and whole ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loppis.operators import graph, ingest
from loppis.session import spread, table
from loppis.streaming import ticks

from .base import Book
from .scalars import token_score_sql

book = Book()
q = book.query
c = F.col

_UUID = "regexp_replace(left(sha256({0}), 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def _id(name: str, slug: str) -> str:
    return _UUID.format(f"'{name}:' || {slug}")


# --- graph files ------------------------------------------------------------------------------------------------------

#: Entries of the file, one document a part; every tenth part repeats the slug of the one before it.
_ENTRY = """CASE WHEN p_partkey % 10 = 9 THEN concat('p', p_partkey - 1) ELSE concat('p', p_partkey) END AS slug, p_partkey AS seq, p_type AS category, lower(p_brand) AS brand, p_name AS name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS type,
CASE WHEN p_size % 4 > 0 THEN concat('M', p_partkey) END AS model, CASE p_size % 3 WHEN 0 THEN array(concat('S', p_partkey), concat('M', p_partkey)) WHEN 1 THEN array(concat('S', p_partkey)) END AS sku, CASE WHEN p_size % 7 = 0 THEN array(concat('E', p_partkey)) END AS ean,
CASE WHEN p_size % 2 = 0 THEN array(CAST(p_size AS BIGINT), CAST(p_size + 10 AS BIGINT)) END AS price_range_dkk, array(concat('p', p_partkey + 1), concat('p', p_partkey + 1), CASE WHEN p_size = 4 THEN 'elder' ELSE 'nowhere' END) AS related, array(concat('p', p_partkey * 2)) AS clones"""
_OLD = "concat('old-', p_partkey) AS id, concat('p', p_partkey) AS slug, 'x' AS canonical_name, 'legendary' AS tier, 'kept' AS era"
_SYN = "p_name AS canonical_query, array_sort(collect_set(concat(p_name, ' ', p_type))) AS aliases"

_FILE = f"""entry AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY seq DESC) AS rn FROM (SELECT {_ENTRY.replace("array(", "list_value(")} FROM part)) WHERE rn = 1),
old AS (SELECT {_OLD} FROM part WHERE p_size = 3 UNION ALL SELECT 'old-e', 'elder', 'e', 'standard', NULL),
brand AS (SELECT lower(p_brand) AS slug, arg_max(p_type, p_partkey) AS category FROM part GROUP BY 1),
prod AS (SELECT coalesce(old.id, {_id("kg_product", "slug")}) AS id, slug, coalesce(entry.name, old.canonical_name) AS canonical_name, entry.model AS model_name, {_id("kg_brand", "brand")} AS brand_id, {_id("kg_category", "category")} AS category_id, entry.price_range_dkk[1] AS price_min_dkk, entry.price_range_dkk[2] AS price_max_dkk,
CASE WHEN entry.slug IS NULL THEN NULL WHEN coalesce(entry.type, '') = '' THEN '{{}}' ELSE '{{"type":"' || entry.type || '"}}' END AS attributes, old.tier FROM old FULL JOIN entry USING (slug)),
ident AS (SELECT prod.id AS product_id, i.type, i.value FROM (SELECT slug, unnest(list_concat(list_transform(coalesce(sku, []), lambda v: {{'type': 'SKU', 'value': v}}), list_transform(coalesce(ean, []), lambda v: {{'type': 'EAN', 'value': v}}), CASE WHEN model IS NOT NULL AND NOT list_contains(coalesce(sku, []), model) THEN [{{'type': 'MODEL', 'value': model}}] ELSE [] END)) AS i FROM entry) JOIN prod USING (slug)),
rel AS (SELECT a.id AS from_product_id, b.id AS to_product_id, type, 50 AS weight FROM (SELECT slug AS f, unnest(related) AS t, 'sibling' AS type FROM entry UNION SELECT unnest(clones), slug, 'clone' FROM entry) JOIN prod a ON f = a.slug JOIN prod b ON t = b.slug)"""


def imported(spark, sf):
    part = spread(table(spark, sf, "part"), "p_partkey")
    e = spark.sql(f"SELECT {_ENTRY} FROM {{t}}", t=part)
    product = F.struct("name", "type", F.lit(None).cast("string").alias("era"), F.lit(None).cast("string").alias("reference_url"), "model", "sku", "ean", "price_range_dkk", "related", "clones")
    nested = F.create_map("category", F.struct(F.create_map("brand", F.struct(F.create_map("slug", product).alias("products"))).alias("brands")))
    # through text, as a file would bring it
    files = e.select("seq", F.from_json(F.to_json(F.struct(nested.alias("categories"))), graph.GRAPH).alias("g")).select("seq", "g.categories")
    aliases = spark.sql(f"SELECT {_SYN} FROM {{t}} GROUP BY p_name", t=part)
    synonyms = aliases.select(F.from_json(F.to_json(F.struct(F.create_map("canonical_query", "aliases").alias("synonyms"))), graph.SYNONYMS).alias("s")).select("s.synonyms")
    elder = spark.createDataFrame([("old-e", "elder", "e", "standard", None)], "id string, slug string, canonical_name string, tier string, era string")
    old = spark.sql(f"SELECT {_OLD} FROM {{t}} WHERE p_size = 3", t=part).unionByName(elder)
    wide = old.select("id", "slug", "canonical_name", *[F.lit(None).cast(t).alias(n) for n, t in (("model_name", "string"), ("brand_id", "string"), ("category_id", "string"), ("price_min_dkk", "bigint"), ("price_max_dkk", "bigint"), ("reference_url", "string"), ("attributes", "string"), ("status", "string"))], "era", "tier")
    tables = {"kg_category": spark.createDataFrame([], graph.CATEGORY), "kg_brand": spark.createDataFrame([], graph.BRAND), "kg_product": wide}
    return graph.import_graph(files, synonyms, tables)


@q(f"SELECT DISTINCT {_id('kg_category', 'p_type')} AS id, p_type AS slug, p_type AS name_da, p_type AS name_en FROM part")
def c13_import_categories(spark, sf):
    return imported(spark, sf)["kg_category"]


@q(f"WITH {_FILE} SELECT {_id('kg_brand', 'slug')} AS id, slug, upper(left(slug, 1)) || substr(slug, 2) AS name, {_id('kg_category', 'category')} AS category_id FROM brand")
def c13_import_brands(spark, sf):
    return imported(spark, sf)["kg_brand"]


@q(f"WITH {_FILE} SELECT * FROM prod")
def c13_import_products(spark, sf):
    return imported(spark, sf)["kg_product"].drop("era", "reference_url", "status")


@q(f"WITH {_FILE} SELECT product_id, type, value, 80 AS confidence, 'seed' AS source FROM ident")
def c13_import_identifiers(spark, sf):
    return imported(spark, sf)["kg_identifier"]


@q(f"WITH {_FILE} SELECT * FROM rel")
def c13_import_relations(spark, sf):
    return imported(spark, sf)["kg_relation"]


@q("SELECT DISTINCT p_name AS alias, p_name AS canonical_query, 'da' AS lang, 'exact' AS match_type, 100 AS priority FROM part UNION ALL SELECT DISTINCT p_name || ' ' || p_type, p_name, 'da', 'alias', 50 FROM part")
def c13_import_synonyms(spark, sf):
    return imported(spark, sf)["synonym"]


@q(
    f"""WITH {_FILE}, sl AS (SELECT id, slug FROM prod), r AS (SELECT from_product_id AS id, string_agg(slug, ',' ORDER BY slug) AS related FROM rel JOIN sl ON to_product_id = sl.id WHERE type = 'sibling' GROUP BY 1),
k AS (SELECT to_product_id AS id, string_agg(slug, ',' ORDER BY slug) AS clones FROM rel JOIN sl ON from_product_id = sl.id WHERE type = 'clone' GROUP BY 1)
SELECT b.category, b.slug AS brand, p.slug, canonical_name AS name, json_extract_string(attributes, '$.type') AS type, model_name AS model, price_max_dkk AS top, related, clones, (SELECT string_agg(value, ',' ORDER BY value) FROM ident i WHERE i.product_id = p.id AND i.type = 'SKU') AS sku, (SELECT string_agg(value, ',' ORDER BY value) FROM ident i WHERE i.product_id = p.id AND i.type = 'EAN') AS ean
FROM prod p JOIN brand b ON brand_id = {_id("kg_brand", "b.slug")} LEFT JOIN r ON p.id = r.id LEFT JOIN k ON p.id = k.id"""
)
def c13_export_entries(spark, sf):
    """The tables of an import exported again and read as a file would be."""
    t = imported(spark, sf)
    out = graph.export_graph(t["kg_category"], t["kg_brand"], t["kg_product"], t["kg_identifier"], t["kg_relation"])
    brands = out.select("category", F.explode(F.from_json("json", f"brands map<string,struct<products:map<string,{graph.PRODUCT}>>>")["brands"]).alias("brand", "b"))
    p = brands.select("category", "brand", F.explode("b.products").alias("slug", "p"))
    joined = lambda x: F.array_join(c(f"p.{x}"), ",").alias(x)
    return p.select("category", "brand", "slug", "p.name", "p.type", "p.model", F.get("p.price_range_dkk", F.lit(1)).alias("top"), joined("related"), joined("clones"), joined("sku"), joined("ean"))


@q("SELECT p_name AS canonical_query, string_agg(DISTINCT p_name || ' ' || p_type, ',' ORDER BY p_name || ' ' || p_type) AS aliases FROM part GROUP BY 1")
def c13_export_synonyms(spark, sf):
    return graph.export_synonyms(imported(spark, sf)["synonym"]).withColumn("aliases", F.array_join("aliases", ","))


# --- resolved pages ---------------------------------------------------------------------------------------------------

_FOUND = """fnd AS (SELECT CAST(p_partkey AS STRING) AS id, concat(p_name, ' ', p_type) AS canonical_name, arrival, CAST(p_partkey * 10 + arrival AS BIGINT) AS csp_id, CASE arrival WHEN 0 THEN concat(p_type, ' ', p_name) WHEN 1 THEN p_name WHEN 2 THEN concat(p_name, ' ', p_type, ' mk2') ELSE concat(p_name, ' ', p_type) END AS title,
CASE WHEN p_size % 2 = arrival % 2 THEN CAST(5 AS BIGINT) END AS used_total, CASE WHEN p_size % 3 = 0 THEN 'USD' ELSE 'EUR' END AS low_currency FROM {part} WHERE p_size % 6 > 0 AND (p_size > 5 OR arrival = 0))"""
_RANKED = (
    "WITH " + _FOUND.format(part="part, (SELECT unnest([0, 1, 2, 3]) AS arrival)") + f""", sc AS (SELECT *, {token_score_sql("canonical_name", "title")} AS score, len(string_split(canonical_name, ' ')) AS n FROM fnd WHERE arrival < 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, coalesce(used_total, 0) DESC, arrival) AS rank, CASE WHEN n < 2 THEN 'low' WHEN score >= 0.95 THEN 'high' WHEN score >= 0.75 THEN 'medium' WHEN score >= 0.5 THEN 'low' ELSE 'none' END AS confidence FROM sc)"""
)


def pages(spark, sf):
    part = table(spark, sf, "part")
    products = part.select(c("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("canonical_name"), F.when(c("p_size") % 4 == 0, F.lit('{"type":"t","n":1,"reverb_csp":{"csp_id":7},"reverb_csp_candidates":[1]}')).when(c("p_size") % 4 == 1, "broken").alias("attributes"), F.when(c("p_size") == 7, "own").alias("reverb_csp_id"))
    rows = part.withColumn("arrival", F.explode(F.array(*map(F.lit, range(4)))))
    found = spark.sql(_FOUND.format(part="{t}").removeprefix("fnd AS (").removesuffix(")"), t=rows).drop("canonical_name")
    found = found.withColumns({"slug": F.concat(F.lit("s"), c("csp_id").cast("string")), "image_url": F.lit(None).cast("string"), "low_amount": F.lit("12.5")})
    return products, ingest.resolved_pages(products, found, F.lit("now"))


@q(_RANKED + " SELECT CAST(p_partkey AS VARCHAR) AS id, r.csp_id, r.score, r.confidence, r.used_total, r.low, (SELECT string_agg(CAST(k.csp_id AS VARCHAR), ',' ORDER BY rank) FROM rk k WHERE k.id = CAST(p_partkey AS VARCHAR) AND rank > 1) AS others FROM part LEFT JOIN (SELECT id, csp_id, score, confidence, coalesce(used_total, 0) AS used_total, CASE WHEN low_currency = 'USD' THEN 12.5 END AS low FROM rk WHERE rank = 1) r ON CAST(p_partkey AS VARCHAR) = r.id")
def c14_resolved_pages(spark, sf):
    r = c("resolution")
    others = F.nullif(F.array_join(F.transform("candidates", lambda x: x["csp_id"].cast("string")), ","), F.lit(""))
    return pages(spark, sf)[1].select("id", r["csp_id"].alias("csp_id"), r["score"].alias("score"), r["confidence"].alias("confidence"), r["used_total"].alias("used_total"), r["used_low_price_usd"].alias("low"), others.alias("others"))


_TOLD = ", best AS (SELECT id, csp_id, confidence, max(rank) OVER (PARTITION BY id) - 1 AS n, rank FROM rk)"


def resolved(spark, sf):
    products, found = pages(spark, sf)
    return ingest.with_resolutions(products, found, F.lit("now"))


@q(_RANKED + _TOLD + " SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(csp_id AS VARCHAR) AS csp_id, coalesce(confidence, 'none') AS confidence, nullif(n, 0) AS candidates, CASE WHEN p_size % 4 = 0 THEN 't' END AS type, CASE WHEN p_size % 4 = 0 THEN '1' END AS n FROM part LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON CAST(p_partkey AS VARCHAR) = b.id")
def c14_attributes(spark, sf):
    get = lambda path: F.get_json_object("attributes", path)
    return resolved(spark, sf).select("id", get("$.reverb_csp.csp_id").alias("csp_id"), get("$.reverb_csp.confidence").alias("confidence"), F.json_array_length(get("$.reverb_csp_candidates")).cast("long").alias("candidates"), get("$.type").alias("type"), get("$.n").alias("n"))


@q(_RANKED + _TOLD + " SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size = 7 THEN 'own' WHEN confidence IN ('high', 'medium') THEN CAST(csp_id AS VARCHAR) END AS reverb_csp_id FROM part LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON CAST(p_partkey AS VARCHAR) = b.id")
def c14_promoted(spark, sf):
    return ingest.promoted(resolved(spark, sf)).select("id", "reverb_csp_id")


# --- sold prices ------------------------------------------------------------------------------------------------------

_SALE = """concat('u', l_partkey % 50) AS url, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_suppkey AS STRING) END AS watchlist_id, concat('q', l_suppkey) AS query, l_returnflag AS title, CASE WHEN l_linenumber = 5 THEN 'free' WHEN l_linenumber = 6 THEN '0' ELSE CAST(CAST(floor(l_quantity) AS INT) AS STRING) END AS amount,
CASE l_returnflag WHEN 'A' THEN 'EUR' WHEN 'R' THEN 'SEK' ELSE 'XXX' END AS currency, l_linestatus AS condition, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END AS published_at, l_shipdate AS created_at"""
_RATE = "CASE currency WHEN 'EUR' THEN 7.46 WHEN 'SEK' THEN 0.65 ELSE 7.0 END"
_SALES = f"""sale AS (SELECT {_SALE} FROM lineitem), sold AS (SELECT watchlist_id, query, floor(CAST(amount AS DOUBLE) * {_RATE} + 0.5) AS price, condition, url AS listing_url, created_at AS sold_at FROM sale WHERE amount NOT IN ('free', '0'))"""


@q(f"WITH {_SALES} SELECT watchlist_id, listing_url, min(sold_at) AS sold_at FROM sold WHERE watchlist_id IS NOT NULL AND (listing_url, watchlist_id) NOT IN (SELECT ('u' || s_suppkey % 50, CAST(s_suppkey AS STRING)) FROM supplier) GROUP BY 1, 2 UNION ALL SELECT NULL, listing_url, sold_at FROM sold WHERE watchlist_id IS NULL UNION ALL SELECT CAST(s_suppkey AS STRING), 'u' || s_suppkey % 50, TIMESTAMP '1990-01-01' FROM supplier")
def c16_marketplace_history(spark, sf):
    rows = spark.sql(f"SELECT {_SALE} FROM {{t}}", t=table(spark, sf, "lineitem"))
    old = table(spark, sf, "supplier").select(c("s_suppkey").cast("string").alias("watchlist_id"), F.concat(F.lit("u"), (c("s_suppkey") % 50).cast("string")).alias("listing_url"), F.expr("TIMESTAMP_NTZ '1990-01-01'").alias("sold_at"), F.lit(1.0).alias("price"))
    return ingest.ingest_sold(old, ingest.marketplace_sold(rows)).drop("price")


@q(f"WITH {_SALES} SELECT watchlist_id, query, listing_url, price, condition, sold_at FROM sold")
def c16_marketplace_rows(spark, sf):
    return ingest.marketplace_sold(spark.sql(f"SELECT {_SALE} FROM {{t}}", t=table(spark, sf, "lineitem"))).select("watchlist_id", "query", "listing_url", "price", "condition", "sold_at")


@q("""SELECT p_partkey AS watchlist_id, 'https://a.example/' || p_partkey AS listing_url, CAST(p_size * 1000 + 5 AS DOUBLE) AS price, CAST(DATE '2016-12-11' + CAST(p_size AS INT) % 15 AS VARCHAR) AS sold_on, CASE WHEN p_size % 2 = 0 THEN floor(p_size * 7.46 + 0.5) END AS estimate_low FROM part WHERE p_size % 3 > 0""")
def c16_auction_rows(spark, sf):
    p, size = table(spark, sf, "part"), c("p_size")
    day = F.concat(F.lit("Hammered "), (size % 15 + 11).cast("string"), F.lit(" Dec 2016"))
    rows = p.select(c("p_partkey").alias("watchlist_id"), F.lit("q").alias("query"), c("p_name").alias("title"), F.when(size % 3 > 0, F.concat(size.cast("string"), F.lit(",005 DKK"))).when(size % 2 == 0, "0 DKK").otherwise("withdrawn").alias("amount_value"),
                    F.when(size % 2 == 0, size.cast("double")).alias("estimate"), F.lit("EUR").alias("currency"), F.concat(F.lit("/"), c("p_partkey").cast("string")).alias("url"), day.alias("ended"))
    return ingest.auction_sold(rows, "https://a.example").select("watchlist_id", "listing_url", "price", c("sold_at").cast("date").cast("string").alias("sold_on"), "estimate_low")


@q("SELECT id, query FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN ' ' || upper(p_name) ELSE p_name END AS query, row_number() OVER (PARTITION BY p_name ORDER BY c_custkey) AS rn FROM customer JOIN part ON c_custkey = p_partkey) WHERE rn = 1")
def a13_unique_watchlists(spark, sf):
    w = table(spark, sf, "customer").join(table(spark, sf, "part"), c("c_custkey") == c("p_partkey")).select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(c("p_name")).alias("query"))
    return ingest.unique_watchlists(w)


# --- fetch queue ------------------------------------------------------------------------------------------------------

_QUEUE = "job AS (SELECT o_orderkey AS id, concat('p', o_custkey) AS product_slug, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders)"
_TAKEN = _QUEUE + ", taken AS (SELECT * FROM job WHERE status = 'pending' ORDER BY created_at, id LIMIT 10), known AS (SELECT concat('p', p_partkey) AS slug, p_brand || ' ' || CASE WHEN p_size % 3 > 0 THEN p_name ELSE 'null' END AS search FROM part WHERE p_brand <> 'Brand#7' AND p_size % 4 > 0)"


def worked(spark, sf):
    part = table(spark, sf, "part")
    queue = spark.sql("SELECT o_orderkey AS id, concat('p', o_custkey) AS product_slug, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, o_orderdate AS created_at, CAST(NULL AS STRING) AS processed_at FROM {t}", t=table(spark, sf, "orders"))
    products = part.filter("p_size % 4 > 0").select(c("p_partkey").alias("id"), F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("slug"), c("p_brand").alias("brand_id"), F.when(c("p_size") % 3 > 0, c("p_name")).alias("model_name"))
    brands = part.filter("p_brand <> 'Brand#7'").select(c("p_brand").alias("id"), c("p_brand").alias("name")).distinct()
    landed = spark.sql(f"SELECT {_SALE}, concat('p', l_partkey) AS product_slug FROM {{t}}", t=table(spark, sf, "lineitem"))
    history = spark.createDataFrame([], "watchlist_id string, query string, price double, listing_url string, sold_at timestamp_ntz")
    return ingest.run_queue(queue, products, brands, landed, history, F.lit("now"))


@q(f"WITH {_TAKEN} SELECT job.id, CASE WHEN taken.id IS NULL THEN job.status WHEN job.product_slug IN (SELECT slug FROM known) THEN 'done' ELSE 'failed' END AS status, CASE WHEN taken.id IS NOT NULL THEN 'now' END AS processed_at FROM job LEFT JOIN taken ON job.id = taken.id")
def st08_queue_run(spark, sf):
    return worked(spark, sf)["queue"].select("id", "status", "processed_at")


@q(f"WITH {_TAKEN} SELECT product_slug, search FROM taken JOIN known ON product_slug = slug")
def st08_queue_requests(spark, sf):
    return worked(spark, sf)["requests"]


@q(f"WITH {_TAKEN}, sale AS (SELECT {_SALE}, concat('p', l_partkey) AS product_slug FROM lineitem) SELECT product_slug AS query, floor(CAST(amount AS DOUBLE) * {_RATE} + 0.5) AS price, url AS listing_url, created_at AS sold_at FROM sale WHERE amount NOT IN ('free', '0') AND product_slug IN (SELECT product_slug FROM taken JOIN known ON product_slug = slug)")
def st08_queue_history(spark, sf):
    return worked(spark, sf)["history"].drop("watchlist_id")


# --- whole ticks ------------------------------------------------------------------------------------------------------

_WATCH = """wl AS (SELECT c_custkey AS id, c_nationkey AS user_id, c_name AS query, c_custkey % 5 > 0 AS active, CASE WHEN c_custkey % 7 = 0 THEN 'listing' ELSE 'query' END AS type, CASE WHEN c_custkey % 3 > 0 THEN 200000.0 ELSE 0.0 END AS max_price FROM customer),
was AS (SELECT 'u' || o_orderkey AS url, o_custkey AS watchlist_id, 'old ' || o_orderpriority AS title, o_totalprice AS price, o_orderdate AS scraped_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS notified_at FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT 'u' || o_orderkey AS url, o_custkey AS watchlist_id, 'new ' || o_orderpriority AS title, o_totalprice + 1 AS price, o_orderdate + INTERVAL 1 DAY AS scraped_at FROM orders WHERE o_orderkey % 3 = 0),
kept AS (SELECT new.* FROM new JOIN wl ON watchlist_id = wl.id WHERE active AND (type = 'listing' OR max_price = 0 OR price <= max_price)),
grown AS (SELECT url, watchlist_id, coalesce(kept.title, was.title) AS title, coalesce(kept.price, was.price) AS price, coalesce(kept.scraped_at, was.scraped_at) AS scraped_at, was.notified_at FROM was FULL JOIN kept USING (url, watchlist_id)),
ticked AS (SELECT watchlist_id, max(scraped_at) AS now FROM kept GROUP BY 1), alert AS (SELECT grown.* FROM grown JOIN ticked USING (watchlist_id) WHERE notified_at IS NULL)"""


def watched(spark, sf):
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    wl = customer.selectExpr("c_custkey AS id", "c_nationkey AS user_id", "c_name AS query", "c_custkey % 5 > 0 AS active", "CASE WHEN c_custkey % 7 = 0 THEN 'listing' ELSE 'query' END AS type", "CASE WHEN c_custkey % 3 > 0 THEN 200000.0D ELSE 0.0D END AS max_price")
    was = orders.filter("o_orderkey % 2 = 0").selectExpr("concat('u', o_orderkey) AS id", "concat('u', o_orderkey) AS url", "o_custkey AS watchlist_id", "concat('old ', o_orderpriority) AS title", "o_totalprice AS price", "o_orderdate AS scraped_at", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS notified_at")
    new = orders.filter("o_orderkey % 3 = 0").selectExpr("concat('u', o_orderkey) AS id", "concat('u', o_orderkey) AS url", "o_custkey AS watchlist_id", "concat('new ', o_orderpriority) AS title", "o_totalprice + 1 AS price", "o_orderdate + INTERVAL 1 DAY AS scraped_at")
    matches = spark.createDataFrame([], "listing_id string, product_id long, method string, score int, explain string")
    old = orders.filter("o_orderkey % 9 = 0").select(F.concat(F.lit("u"), c("o_orderkey").cast("string")).alias("listing_id"), F.lit(1).cast("long").alias("product_id"), F.lit("SKU").alias("method"), F.lit(95).alias("score"), F.lit(None).cast("string").alias("explain"))
    identifiers = spark.createDataFrame([(7, "3-medium", "SKU", 1), (8, "high", "EAN", 2)], "product_id long, value string, type string, seq long")
    synonyms = spark.createDataFrame([(9, "high", "alias", 1, 1)], "product_id long, alias string, match_type string, priority int, seq long")
    models = spark.createDataFrame([(10, "4-NOT", 1)], "product_id long, model string, seq long")
    return ticks.watch(new, was, wl, matches.unionByName(old), identifiers, synonyms, models)


@q(f"WITH {_WATCH} SELECT url, watchlist_id, title, price, CASE WHEN notified_at IS NULL THEN now ELSE notified_at END AS notified_at FROM grown LEFT JOIN ticked USING (watchlist_id)")
def st02_watch_listings(spark, sf):
    return watched(spark, sf)["listings"].select("url", "watchlist_id", "title", "price", "notified_at")


@q(f"WITH {_WATCH} SELECT listing_id, product_id, method, score FROM (SELECT 'u' || o_orderkey AS listing_id, 1 AS product_id, 'SKU' AS method, 95 AS score FROM orders WHERE o_orderkey % 9 = 0) UNION ALL SELECT url, CASE WHEN contains(title, '3-MEDIUM') THEN 7 WHEN contains(title, 'HIGH') THEN 9 ELSE 10 END, CASE WHEN contains(title, '3-MEDIUM') THEN 'SKU' WHEN contains(title, 'HIGH') AND NOT contains(title, '-HIGH') THEN 'SYNONYM' ELSE 'MODEL' END, CASE WHEN contains(title, '3-MEDIUM') THEN 95 ELSE 70 END FROM kept WHERE (contains(title, '3-MEDIUM') OR contains(title, '4-NOT')) AND CAST(substr(url, 2) AS BIGINT) % 9 > 0")
def st02_watch_matches(spark, sf):
    return watched(spark, sf)["matches"].drop("explain")


@q(f"WITH {_WATCH}, n AS (SELECT *, row_number() OVER (PARTITION BY watchlist_id ORDER BY title, url) AS rn, count(*) OVER (PARTITION BY watchlist_id) AS n FROM alert) SELECT user_id, watchlist_id, wl.query, max(n) AS n_new, string_agg(title, chr(10) ORDER BY rn) FILTER (WHERE rn <= 5) || CASE WHEN max(n) > 5 THEN chr(10) || '…and ' || (max(n) - 5) || ' more' ELSE '' END AS digest FROM n JOIN wl ON watchlist_id = wl.id GROUP BY 1, 2, 3")
def st02_watch_digests(spark, sf):
    return watched(spark, sf)["digests"]
