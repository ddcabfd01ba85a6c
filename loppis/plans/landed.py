"""Extraction from landed payloads and incremental runs: payloads are made of the tables' columns, in all their forms,
and the SQL states what is to come out of them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampNTZType

from loppis.operators import catalog, ranking, similar
from loppis.session import shared_folder, spread, table
from loppis.sinks.keyed import KeyedTable
from loppis.sources import extract
from loppis.streaming import ticks

from .base import Book
from .composites import _C01, matcher_tables
from .relational import _MERGE, merged

book = Book()
q = book.query
c = F.col


def cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ld(*fields):
    """A JSON-LD script of a page."""
    return cat('<html><script type="application/ld+json">', F.to_json(F.struct(*fields)), "</script>")


def parts(spark, sf, payload, name="html"):
    return spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", payload.alias(name))


# --- nested and flat documents --------------------------------------------------------------------------------------


def graph(spark, sf):
    """A nested document for each part; every second one has no SKU, prices are missing for every third."""
    k = c("p_partkey")
    product = F.struct(
        c("p_name").alias("name"), c("p_type").alias("type"), cat("M", k).alias("model"), F.when(k % 2 == 0, cat("S", k)).alias("sku"),
        F.when(k % 3 != 0, F.array(c("p_size"), c("p_size") + 10)).alias("price_range_dkk"),
        F.array(cat("p", k + 1)).alias("related"), F.array(cat("p", k * 2), F.lit("nowhere")).alias("clones"),
    )
    nested = F.create_map(c("p_type"), F.struct(F.create_map(c("p_brand"), F.struct(F.create_map(cat("p", k), product).alias("products"))).alias("brands")))
    payload = F.to_json(F.struct(F.lit("1.0.0").alias("version"), nested.alias("categories")))
    return catalog.flatten_graph(parts(spark, sf, payload).select(F.from_json("html", catalog.GRAPH).alias("g")).select("g.*"))


@q("SELECT 'p' || p_partkey AS slug, p_type AS category, p_brand AS brand, p_name AS name, p_type AS type, 'M' || p_partkey AS model, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS price_min, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 10 END AS price_max FROM part")
def s04_graph_products(spark, sf):
    return graph(spark, sf)["products"].drop("era")


@q("SELECT 'p' || p_partkey AS slug, 'MODEL' AS type, 'M' || p_partkey AS value FROM part UNION ALL SELECT 'p' || p_partkey, 'SKU', 'S' || p_partkey FROM part WHERE p_partkey % 2 = 0")
def s04_graph_identifiers(spark, sf):
    return graph(spark, sf)["identifiers"]


@q("""SELECT 'p' || a.p_partkey AS "from", 'p' || b.p_partkey AS "to", 'sibling' AS type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
UNION ALL SELECT 'p' || b.p_partkey, 'p' || a.p_partkey, 'clone' FROM part a JOIN part b ON b.p_partkey = a.p_partkey * 2""")
def s04_graph_relations(spark, sf):
    return graph(spark, sf)["relations"]


@q("""WITH f AS (SELECT 'p' || p_partkey AS slug, p_brand AS brand, p_type AS category FROM part)
SELECT category, count(DISTINCT brand) AS brands, count(*) AS products FROM f GROUP BY 1""")
def c13_graph_import_export(spark, sf):
    """The imported graph exported again, with its relations, and counted."""
    g = graph(spark, sf)
    out = catalog.export_graph(g["products"].select("slug", "category", "brand", "name"), g["relations"], "1.0.1")
    brands = F.from_json("json", "brands map<string,struct<products:map<string,struct<name:string>>>>")["brands"]
    n = F.aggregate(F.map_values(brands), F.lit(0), lambda acc, b: acc + F.size(b["products"]))
    return out.select("category", F.size(brands).cast("long").alias("brands"), n.cast("long").alias("products"))


@q("SELECT p_partkey, p_brand AS slug, p_size AS size FROM part UNION ALL SELECT p_partkey, p_type, p_size + 1 FROM part")
def s05_flat_list(spark, sf):
    rows = F.array(F.struct(c("p_brand").alias("slug"), c("p_size").alias("size")), F.struct(c("p_type").alias("slug"), (c("p_size") + 1).alias("size")))
    return extract.flat_rows(parts(spark, sf, F.to_json(F.struct(rows.alias("categories"))), "payload"), "categories", "struct<slug:string,size:int>")


@q("SELECT p_partkey, 'https://shop.example/' || p_partkey AS url FROM part UNION ALL SELECT p_partkey, 'https://shop.example/more/' || p_size FROM part WHERE p_size % 3 = 0")
def s06_sitemap(spark, sf):
    more = F.when(c("p_size") % 3 == 0, cat("<url>\n<loc>https://shop.example/more/", c("p_size"), "</loc></url>")).otherwise("")
    return extract.locations(parts(spark, sf, cat("<urlset><url><loc>https://shop.example/", c("p_partkey"), "</loc></url>", more, "</urlset>"), "payload"))


# --- pages ----------------------------------------------------------------------------------------------------------


@q("SELECT p_partkey, p_name AS title, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 2 = 0 THEN 'SEK' ELSE 'DKK' END AS currency, 'https://l.example/' || p_partkey AS url, CASE WHEN p_size % 3 = 0 THEN p_type END AS image_url, 'finn' AS source FROM part")
def s07_search_page(spark, sf):
    offers = F.struct(c("p_retailprice").cast("string").alias("price"), F.when(c("p_size") % 2 == 0, "SEK").alias("priceCurrency"))
    item = F.struct(cat("https://l.example/", c("p_partkey")).alias("url"), c("p_name").alias("name"), F.when(c("p_size") % 3 == 0, c("p_type")).alias("image"), offers.alias("offers"))
    nameless = F.struct(F.lit("https://l.example/none").alias("url"), F.lit("").alias("name"), F.lit(None).cast("string").alias("image"), offers.alias("offers"))
    listed = F.struct(F.array(F.struct(item.alias("item")), F.struct(nameless.alias("item"))).alias("itemListElement"))
    other = ld(F.lit("BreadcrumbList").alias("@type"), c("p_name").alias("name"))
    page = cat(other, ld(F.lit("CollectionPage").alias("@type"), listed.alias("mainEntity")), '<script type="application/ld+json">{broken</script>')
    return extract.collection_listings(parts(spark, sf, page), "finn", "DKK")


@q("""SELECT p_partkey, p_name AS title, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'EUR' ELSE 'DKK' END AS currency, p_type AS image_url, p_size % 3 = 1 AS structured
FROM part WHERE p_size % 3 < 2""")
def s08_listing_page(spark, sf):
    offers = F.struct(c("p_retailprice").cast("string").alias("price"), F.when(c("p_size") % 2 == 0, "EUR").alias("priceCurrency"))
    product = ld(F.lit("Product").alias("@type"), c("p_name").alias("name"), F.array(c("p_type"), F.lit("second.jpg")).alias("image"), offers.alias("offers"))
    first = ld(F.lit("Product").alias("@type"), F.lit("an earlier one").alias("name"))
    tags = cat('<meta property="og:title" content=" ', c("p_name"), '"><meta content="', c("p_type"), '" property="og:image"><meta property="product:price:amount" content="', c("p_retailprice"), '">')
    return extract.product_page(parts(spark, sf, F.when(c("p_size") % 3 == 1, cat(first, product, tags)).when(c("p_size") % 3 == 0, tags).otherwise("<p>gone</p>")))


@q("""SELECT p_partkey, p_name AS title, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS price, CASE WHEN p_size % 2 = 0 THEN p_type END AS image_url FROM part WHERE p_size % 5 < 4""")
def s09_shop_page(spark, sf):
    title = cat('<meta property="og:title" content="', c("p_name"), ' | Shop of Things">')
    image = F.when(c("p_size") % 2 == 0, cat('<meta property="og:image" content="', c("p_type"), '">')).otherwise("")
    product = ld(F.lit("Product").alias("@type"), F.struct(c("p_retailprice").cast("string").alias("price"), F.lit("DKK").alias("priceCurrency")).alias("offers"))
    ahead, behind = cat('{"rawPrice":"', c("p_retailprice"), '","text":"x","currency":"DKK"}'), cat('{"currency":"DKK","rawPrice":"', c("p_retailprice"), '"}')
    far = cat('{"rawPrice":"1","x":"', F.repeat(F.lit("y"), 90), '","currency":"DKK"}')
    kind = c("p_size") % 5
    return extract.shop_product(parts(spark, sf, cat(title, image, F.when(kind < 2, product).when(kind == 2, ahead).when(kind == 3, behind).otherwise(far))))


@q("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN CAST(floor(p_retailprice + 0.5) AS BIGINT) END AS price FROM part")
def s10_anchored_price(spark, sf):
    block = cat('{"price":1},{"affiliation":"Online Store","currency":"DKK","id":"x","price":', c("p_retailprice"), "}")
    micro = cat('<span itemprop="price" data-x="1" content="', c("p_retailprice"), '">')
    rows = parts(spark, sf, F.when(c("p_size") % 3 == 0, block).when(c("p_size") % 3 == 1, micro).otherwise('{"price":12}'))
    return rows.select("p_partkey", extract.anchored_price(c("html")).alias("price"))


@q("""SELECT p_partkey, 'https://shop.example/' || p_partkey || '_' || i || '.htm' AS url, p_name || ' [' || i || ']' AS name, 'https://img.example/' || i || '.jpg' AS image_url, CAST(floor(p_retailprice + i + 0.5) AS BIGINT) AS price
FROM part, unnest([1, 2, 4, 5, 6]) u(i)""")
def s11_bootstrap_articles(spark, sf):
    def article(i):
        title = F.when(i == 3, F.lit(" ")).otherwise(cat(" ", c("p_name"), " [", i, "]"))
        raw = (c("p_retailprice") + i).cast("string")
        return F.struct(
            cat(c("p_partkey"), "_", i, ".htm?ref=search[1]").alias("relativeLink"), F.struct(title.alias("title")).alias("texts"),
            F.struct(F.struct(raw.alias("rawPrice")).alias("primary")).alias("price"), F.struct(cat(i, ".jpg").alias("fileName")).alias("mainImage"),
        )

    data = F.to_json(F.array(F.struct(F.transform(F.sequence(F.lit(1), F.lit(8)), article).alias("articles"))))
    page = cat("<script>var a = [1];bootstrapModule('search.index', ", data, ", [2]);</script>")
    return extract.bootstrap_articles(parts(spark, sf, page), "https://shop.example", "https://img.example")


@q("SELECT o_orderkey, o_orderpriority AS title, 'https://a.example/' || o_custkey AS url, CAST(1000 + o_custkey AS BIGINT) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderstatus = 'F'")
def s12_auctions(spark, sf):
    item = F.struct(
        c("o_orderpriority").alias("title"), cat("https://a.example/", c("o_custkey")).alias("url"), cat(F.format_number(c("o_custkey") + 1000, 0), " DKK").alias("amount"),
        cat("Hammered ", F.date_format("o_orderdate", "d MMM yyyy")).alias("timeLeft"), (c("o_orderstatus") == "F").alias("auctionIsEnded"),
    )
    props = F.replace(F.to_json(F.struct(F.array(item).alias("items"))), F.lit('"'), F.lit("&quot;"))
    rows = table(spark, sf, "orders").select("o_orderkey", cat('<div data-react-class="X" data-react-props="', props, '" id="r"></div>').alias("html"))
    found = extract.auction_items(rows)
    return found.select("o_orderkey", "title", "url", c("price").cast("long").alias("price"), F.date_format("sold_on", "yyyy-MM-dd").alias("day"))


@q("SELECT p_partkey, 0 AS arrival, 'i' || p_partkey AS id, p_brand AS slug, p_name AS title, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS used_total, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS low_usd FROM part")
def s13_api_pages(spark, sf):
    low = F.struct(c("p_retailprice").cast("string").alias("amount"), F.when(c("p_size") % 3 > 0, "USD").otherwise("EUR").alias("currency"))
    page = F.array(F.struct(cat("i", c("p_partkey")).alias("id"), c("p_brand").alias("slug"), c("p_name").alias("title"), F.when(c("p_size") % 4 != 0, c("p_size")).alias("used_total"), low.alias("used_low_price")))
    payload = F.when(c("p_size") % 2 == 0, F.to_json(F.struct(page.alias("csps")))).otherwise(F.to_json(F.struct(page.alias("comparison_shopping_pages"))))
    return extract.hal_pages(parts(spark, sf, payload, "payload")).withColumn("used_total", c("used_total").cast("int"))


@q("SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title, 'https://www.synth.example/b' || p_size || '/m' || p_partkey AS url, 'b' || p_size AS brand_slug, 'm' || p_partkey AS model_slug FROM part")
def s14_embedded_catalogue(spark, sf):
    def entry(path):
        return cat('{"title":"', c("p_name"), ' ","url":"https:\\/\\/www.synth.example\\/', path, '","key":"', c("p_partkey"), '"}')

    good = entry(cat("b", c("p_size"), "\\/m", c("p_partkey")))
    page = cat("[", entry(F.lit("taxonomy\\/x")), ",", good, ",", entry(c("p_brand")), ",", entry(F.lit("a\\/b\\/c")), ",", good, "]")
    return extract.embedded_catalogue(parts(spark, sf, page), "synth.example")


@q("SELECT p_partkey, p_size || ' kg' AS weight, CASE WHEN p_size % 2 = 0 THEN p_type END AS finish, 2 - p_size % 2 AS terms FROM part")
def s15_spec_table(spark, sf):
    def row(term, value):
        return cat(f'<td class="specification-term" title="{term}"> {term}</td>\n<td class="specification-value"> ', value, " </td>")

    page = cat(row("Weight", F.lit("wrong")), row("Finish", F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("None")), row("Colour", F.lit("-")), row("Weight", cat(c("p_size"), " kg")))
    spec = extract.spec_table(c("html"))
    return parts(spark, sf, page).select("p_partkey", spec["Weight"].alias("weight"), spec["Finish"].alias("finish"), F.size(spec).alias("terms"))


@q("SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS title, CASE WHEN p_size % 3 > 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS price, 'https://f.example/' || p_partkey AS url, 'facebook' AS source FROM part")
def s16_marketplace_rows(spark, sf):
    rows = table(spark, sf, "part").select(
        c("p_partkey").cast("string").alias("id"), F.when(c("p_size") % 2 == 0, c("p_name")).alias("marketplace_listing_title"), c("p_type").alias("title"),
        F.when(c("p_size") % 3 > 0, F.floor("p_retailprice").cast("string")).otherwise("NaN").alias("price"), cat("https://f.example/", c("p_partkey")).alias("listingUrl"),
    )
    return extract.marketplace_rows(rows)


# --- incremental runs -----------------------------------------------------------------------------------------------


def landed(spark, sf, name):
    """A table's file, or all files of its folder, as a stream of landed files; a stream's path to one file has to be a pattern."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{{{name}}}.parquet")


def ran(stream, folder, work):
    """An availableNow run of `work` over all landed files, to its end."""
    ticks.each_batch(stream, work, f"{folder}/checkpoint").awaitTermination()


@q("SELECT event_id, user_id, event_type, value AS price, ts AS scraped_at FROM events WHERE value IS NOT NULL")
def st03_price_snapshots(spark, sf):
    """Every priced row of each tick, appended by a file sink that repeats no batch."""
    folder = shared_folder(spark)
    rows = landed(spark, sf, "events").filter("value IS NOT NULL").select("event_id", "user_id", "event_type", c("value").alias("price"), c("ts").alias("scraped_at"))
    sink = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@q("SELECT user_id, event_type, count(*) AS seen FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def st05_seen_keys(spark, sf):
    """Keys seen in a batch, once each, from a stream of landed files."""
    folder = shared_folder(spark)
    work = lambda batch, _: batch.dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type").write.mode("append").parquet(f"{folder}/rows")
    ran(landed(spark, sf, "events"), folder, work)
    return spark.read.schema("user_id long, event_type string").parquet(f"{folder}/rows").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("seen"))


_TICK = """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS watchlist_id, event_type AS url, value AS price, ts, event_id FROM events WHERE user_id % 4 <> 0),
k AS (SELECT * FROM b WHERE NOT (CAST(watchlist_id AS BIGINT) % 3 > 0) OR price IS NULL OR price <= CAST(watchlist_id AS BIGINT) % 3 * 40)"""


LISTINGS = StructType([StructField(n, k) for n, k in (("url", StringType()), ("watchlist_id", StringType()), ("title", StringType()), ("price", DoubleType()), ("scraped_at", TimestampNTZType()), ("notified_at", TimestampNTZType()))])


def listings_table(spark, path):
    """Listings on disk, the listings of a watchlist in one bucket."""
    return KeyedTable.create(spark, path, LISTINGS, ["url", "watchlist_id"], ["watchlist_id"], buckets=8)


def watchlists(spark, sf):
    """Users are watchlists; every fourth is not active, those not divisible by three have a cap."""
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.select(c("user_id").cast("string").alias("id"), (c("user_id") % 4 != 0).alias("active"), (c("user_id") % 3 * 40).cast("double").alias("max_price"))


def scraped(events):
    return events.select(c("event_type").alias("url"), c("user_id").cast("string").alias("watchlist_id"), c("event_id").cast("string").alias("title"), c("value").cast("double").alias("price"), c("ts").cast("timestamp_ntz").alias("scraped_at"))


def tick_run(spark, sf):
    """Folder of the listings, snapshots and alerts after an availableNow run of the tick over landed events."""
    folder = shared_folder(spark)
    lists = watchlists(spark, sf)
    kept = listings_table(spark, f"{folder}/listings")
    ran(landed(spark, sf, "events"), folder, lambda batch, at: ticks.keep_tick(scraped(batch), at, kept, lists, folder))
    return folder


@q(_TICK + " SELECT watchlist_id, url, count(*) AS snapshots FROM k GROUP BY 1, 2")
def st01_tick_snapshots(spark, sf):
    folder = tick_run(spark, sf)
    rows = spark.read.schema("url string, watchlist_id string, title string, price double, scraped_at timestamp_ntz").parquet(f"{folder}/snapshots")
    return rows.groupBy("watchlist_id", "url").agg(F.count(F.lit(1)).alias("snapshots"))


@q(_TICK + " SELECT watchlist_id, url, max(ts) AS scraped_at FROM k GROUP BY 1, 2")
def st02_tick_alerts(spark, sf):
    """Each listing of a tick is alerted once, with its last row."""
    return spark.read.schema(LISTINGS).parquet(f"{tick_run(spark, sf)}/alerts").select("watchlist_id", "url", "scraped_at")


@q(_MERGE + " SELECT url, source_rank, row_number() OVER (PARTITION BY source_rank ORDER BY position, url) AS turn FROM o")
def u04_interleaving_union(spark, sf):
    return ranking.interleaved(merged(spark, sf), "source_rank", [c("position"), c("url")]).select("url", "source_rank", "turn")


@q(_C01)
def st11_incremental_matching(spark, sf):
    """Landed listings matched in ticks; a second run over the same files finds nothing left to match."""
    folder = shared_folder(spark)
    tables = matcher_tables(spark, sf)
    schema = "listing_id long, product_id long, method string, score int, explain string"
    none = spark.createDataFrame([], schema)
    for run in range(2):
        old = spark.read.schema(schema).parquet(f"{folder}/rows") if run else none
        work = lambda batch, _, old=old: ticks.match_unmatched(batch, old, *tables).write.mode("append").parquet(f"{folder}/rows")
        listings = landed(spark, sf, "documents").select(c("doc_id").alias("listing_id"), c("text").alias("title"))
        ran(listings, f"{folder}/run{run}", work)
    return spark.read.schema(schema).parquet(f"{folder}/rows")


_FILES = "replace(p_name || ' ' || p_type, ' ', '_')"


@q(f"""WITH u AS (SELECT DISTINCT 'https://www.thomann.dk/gb/' || {_FILES} || CASE WHEN p_size % 3 = 0 THEN '_set' ELSE '' END || '.htm' AS url, {_FILES} || CASE WHEN p_size % 3 = 0 THEN '_set' ELSE '' END AS file FROM part),
f AS (SELECT url, string_split(lower(file), '_') AS parts, len(file) AS length FROM u WHERE NOT regexp_matches(file, '(?i)[_-](bundle|pack|set|kit|rig|starter|combo|value|deal)\\b')),
n AS (SELECT p_partkey AS id, list_filter(string_split(lower(p_name || ' ' || p_type || ' ' || p_name), ' '), lambda x: x <> '') AS w FROM part WHERE p_size % 2 = 0),
s AS (SELECT id, url, length, len(list_filter(w, lambda x: list_contains(parts, x))) / len(w) AS score FROM n, f),
b AS (SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, length, url) rn FROM s WHERE score >= 0.75) WHERE rn = 1)
SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN b.url ELSE 'own' END AS url FROM part LEFT JOIN b ON b.id = p_partkey""")
def c15_url_assignment(spark, sf):
    """Pages of a sitemap assigned to the products that have none."""
    file = cat(F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("_")), F.when(c("p_size") % 3 == 0, "_set").otherwise(""))
    pages = extract.locations(parts(spark, sf, cat("<url><loc>https://www.thomann.dk/gb/", file, ".htm</loc></url>"), "payload"))
    products = table(spark, sf, "part").select(c("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("name"), F.when(c("p_size") % 2 != 0, "own").alias("url"))
    return similar.assign_urls(products, pages).select("id", "url")
