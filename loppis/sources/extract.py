"""Records from landed HTML, JSON and XML payloads, with built-in expressions.

Each function takes a table of payloads and returns rows; malformed JSON yields nulls, which are dropped. Only the
balanced-bracket array needs Python, as brackets are not regular.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loppis.functions import money, text

LD = r"(?s)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
OFFERS = "offers struct<price:string,priceCurrency:string>"


def meta(page: Column, name: str) -> Column:
    """Content of a meta property in either attribute order, or null."""
    a = F.regexp_extract(page, rf'property="{name}"\s+content="([^"]+)"', 1)
    b = F.regexp_extract(page, rf'content="([^"]+)"\s+property="{name}"', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def _scripts(page: Column, schema: str) -> Column:
    return F.transform(F.regexp_extract_all(page, F.lit(LD), F.lit(1)), lambda s: F.from_json(s, schema))


def collection_listings(pages: DataFrame, source: str, currency: str, html: str = "html") -> DataFrame:
    """Listings of a search page's item list: the last CollectionPage script of each page; items need url and name."""
    item = f"struct<url:string,name:string,image:string,{OFFERS.replace(' ', ':', 1)}>"
    schema = f"`@type` string, mainEntity struct<itemListElement:array<struct<item:{item}>>>"
    found = F.filter(_scripts(F.col(html), schema), lambda s: s["@type"] == "CollectionPage")
    last = F.try_element_at(found, F.lit(-1))
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(last["mainEntity"]["itemListElement"]["item"]).alias("i"))
    return rows.filter("coalesce(i.url, '') <> '' AND coalesce(i.name, '') <> ''").select(
        *[c for c in pages.columns if c not in (html, "url")],
        F.col("i.name").alias("title"),
        money.parse_int(F.col("i.offers.price")).alias("price"),
        F.coalesce("i.offers.priceCurrency", F.lit(currency)).alias("currency"),
        F.col("i.url").alias("url"),
        F.col("i.image").alias("image_url"),
        F.lit(source).alias("source"),
    )


def product_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """title, price, currency, image of a listing page: the last Product script, else its meta tags; none without a
    title."""
    schema = f"`@type` string, name string, image string, {OFFERS}"
    p = F.try_element_at(F.filter(_scripts(F.col(html), schema), lambda s: s["@type"] == "Product"), F.lit(-1))
    image = F.coalesce(F.get(F.from_json(p["image"], "array<string>"), F.lit(0)), p["image"])
    has = p.isNotNull()
    out = pages.select(
        *[c for c in pages.columns if c != html],
        F.when(has, F.coalesce(p["name"], F.lit(""))).otherwise(F.trim(meta(F.col(html), "og:title"))).alias("title"),
        F.when(has, money.parse_int(p["offers"]["price"])).otherwise(money.parse_int(meta(F.col(html), "product:price:amount"))).alias("price"),
        F.when(has, F.coalesce(p["offers"]["priceCurrency"], F.lit("DKK"))).otherwise("DKK").alias("currency"),
        F.when(has, image).otherwise(meta(F.col(html), "og:image")).alias("image_url"),
        has.alias("structured"),
    )
    return out.filter(F.col("structured") | (F.coalesce("title", F.lit("")) != ""))


def shop_product(pages: DataFrame, html: str = "html") -> DataFrame:
    """Price of a shop page in two tiers: the first Product script with a price, else a raw price and a currency
    within 80 characters of each other, in either order."""
    page = F.col(html)
    p = F.get(F.filter(_scripts(page, f"`@type` string, {OFFERS}"), lambda s: (s["@type"] == "Product") & s["offers"]["price"].isNotNull()), F.lit(0))
    ahead = r'"rawPrice":"([\d.]+)"[^}]{0,80}"currency":"([A-Z]{3})"'
    behind = r'"currency":"([A-Z]{3})"[^}]{0,80}"rawPrice":"([\d.]+)"'
    first = F.regexp_like(page, F.lit(ahead))
    raw = F.when(first, F.regexp_extract(page, ahead, 1)).otherwise(F.regexp_extract(page, behind, 2))
    cur = F.when(first, F.regexp_extract(page, ahead, 2)).otherwise(F.regexp_extract(page, behind, 1))
    price = F.coalesce(money.parse_float(p["offers"]["price"]), raw.try_cast("double"))
    currency = F.when(p.isNotNull(), F.coalesce(p["offers"]["priceCurrency"], F.lit("EUR"))).otherwise(cur)
    title = F.coalesce(meta(page, "og:title"), F.nullif(F.regexp_extract(page, "<title>([^<]+)</title>", 1), F.lit("")))
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.trim(F.regexp_replace(title, r" \| [A-Z].*$", "")).alias("title"),
        money.to_dkk(price, currency, money.BATCH, "one").alias("price"),
        meta(page, "og:image").alias("image_url"),
    ).filter("price IS NOT NULL")


def anchored_price(page: Column) -> Column:
    """Kroner from the store's own analytics block, else from microdata."""
    block = r'"affiliation":"Online Store","currency":"([A-Z]{3})"[^}]*?"price":([\d.]+)'
    has = F.regexp_like(page, F.lit(block))
    raw = F.when(has, F.regexp_extract(page, block, 2)).otherwise(F.regexp_extract(page, r'itemprop="price"[^>]*content="([\d.]+)"', 1)).try_cast("double")
    return money.to_dkk(raw, F.when(has, F.regexp_extract(page, block, 1)).otherwise("DKK"), money.BATCH, "one")


def _balanced(page: str, marker: str) -> str | None:
    at = page.find(marker)
    start = page.find("[", at) if at >= 0 else -1
    depth = 0
    for i in range(start, len(page)) if start >= 0 else ():
        depth += (page[i] == "[") - (page[i] == "]")
        if depth == 0:
            return page[start : i + 1]
    return None


def bootstrap_array(marker: str):
    """A column function: the JSON array that follows the marker, by counting brackets, or null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _balanced(x, marker))

    return F.pandas_udf(run, T.StringType())


ARTICLE = "struct<relativeLink:string,texts:struct<title:string>,price:struct<primary:struct<rawPrice:string>>,mainImage:struct<fileName:string>>"


def bootstrap_articles(pages: DataFrame, base: str, images: str, most: int = 5, html: str = "html", marker: str = "bootstrapModule('search.index'") -> DataFrame:
    """First `most` articles of a script's data array; links lose their query, articles need title and link."""
    data = F.get(F.from_json(bootstrap_array(marker)(F.col(html)), f"array<struct<articles:array<{ARTICLE}>>>"), F.lit(0))
    whole = F.filter(data["articles"], lambda a: (F.coalesce(F.trim(a["texts"]["title"]), F.lit("")) != "") & (F.coalesce(a["relativeLink"], F.lit("")) != ""))
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(F.slice(whole, 1, most)).alias("a"))
    return rows.select(
        *[c for c in pages.columns if c != html],
        F.concat_ws("/", F.lit(base), F.split("a.relativeLink", r"\?")[0]).alias("url"),
        F.trim("a.texts.title").alias("name"),
        F.concat_ws("/", F.lit(images), "a.mainImage.fileName").alias("image_url"),
        money.round_half_up(F.col("a.price.primary.rawPrice").try_cast("double")).alias("price"),
    )


def auction_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """Ended auctions from an entity-escaped JSON attribute, with amount and date parsed."""
    from loppis.functions import dates

    raw = F.nullif(F.regexp_extract(F.col(html), r'(?s)data-react-props="(\{.*?\})"(?:\s|>)', 1), F.lit(""))
    schema = "items array<struct<title:string,url:string,amount:string,timeLeft:string,auctionIsEnded:boolean>>"
    items = F.from_json(text.unescape_entities(raw), schema)["items"]
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(items).alias("i")).filter("i.auctionIsEnded")
    return rows.select(*[c for c in pages.columns if c != html], "i.title", "i.url", money.parse_amount(F.col("i.amount")).alias("price"), dates.hammered_date(F.col("i.timeLeft")).alias("sold_on"))


def hal_pages(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Catalogue pages of an API answer; the list goes by either of two names."""
    page = "struct<id:string,slug:string,title:string,used_total:long,used_low_price:struct<amount:string,currency:string>>"
    j = F.from_json(F.col(payload), f"csps array<{page}>, comparison_shopping_pages array<{page}>")
    rows = payloads.select(*[c for c in payloads.columns if c != payload], F.posexplode(F.coalesce(j["csps"], j["comparison_shopping_pages"])).alias("arrival", "p"))
    usd = F.when(F.col("p.used_low_price.currency") == "USD", F.col("p.used_low_price.amount").try_cast("double"))
    return rows.select(*[c for c in payloads.columns if c != payload], "arrival", "p.id", "p.slug", "p.title", F.coalesce("p.used_total", F.lit(0)).alias("used_total"), usd.alias("low_usd"))


def embedded_catalogue(pages: DataFrame, site: str, html: str = "html") -> DataFrame:
    """Entries {"title","url","key"} of a script whose path has two parts, the first of each url."""
    from loppis.operators.writes import first_by

    entry = r'\{"title":"([^"]+)","url":"([^"]+)","key":"(\d+)"\}'
    whole = F.regexp_extract_all(F.col(html), F.lit(entry), F.lit(0))
    rows = pages.select(F.posexplode(whole).alias("at", "e"))
    rel = F.regexp_replace(F.col("url"), rf"^https?://www\.{site.replace('.', '[.]')}", "")
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    out = rows.select(
        "at", F.trim(F.replace(F.regexp_extract("e", entry, 1), F.lit("\\'"), F.lit("'"))).alias("title"), text.unescape_slashes(F.regexp_extract("e", entry, 2)).alias("url"), F.regexp_extract("e", entry, 3).alias("key")
    )
    good = out.filter(F.contains("url", F.lit(f"{site}/"))).withColumn("parts", parts)
    good = good.filter((F.size("parts") == 2) & ~F.regexp_like(F.get("parts", F.lit(0)), F.lit("^(taxonomy|node)")))
    return first_by(good, ["url"], [F.col("at")]).select("key", "title", "url", F.col("parts")[0].alias("brand_slug"), F.col("parts")[1].alias("model_slug"))


def spec_table(page: Column) -> Column:
    """Map of specification terms to values, without "none" and "-"."""
    pattern = r'(?s)class="specification-term"[^>]*title="([^"]+)"[^>]*>.*?class="specification-value">([^<]+)'
    keys = F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)), lambda k: F.trim(k))
    values = F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(2)), lambda v: F.trim(v))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: ~F.lower(p["v"]).isin("none", "-", ""))
    # the last value of a repeated term wins
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(once)


def paragraphs(page: Column, most: int = 1000) -> Column:
    """Paragraphs of 40 characters or more, joined by an empty line, cut at `most`."""
    return F.substring(F.array_join(F.transform(F.regexp_extract_all(page, F.lit("<p>([^<]{40,})</p>"), F.lit(1)), lambda p: F.trim(p)), "\n\n"), 1, most)


def locations(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Locations of sitemaps held in a column."""
    urls = F.regexp_extract_all(F.col(payload), F.lit("<loc>([^<]+)</loc>"), F.lit(1))
    return payloads.select(*[c for c in payloads.columns if c != payload], F.explode(urls).alias("url"))


def sitemap(spark, path: str) -> DataFrame:
    """Locations of a sitemap file, gzipped or not."""
    return locations(spark.read.text(path, wholetext=True), "value")


def flat_rows(payloads: DataFrame, name: str, schema: str, payload: str = "payload") -> DataFrame:
    """Rows of {"<name>": [...]} held in a column."""
    found = F.from_json(F.col(payload), f"{name} array<{schema}>")[name]
    return payloads.select(*[c for c in payloads.columns if c != payload], F.inline(found))


def flat_list(spark, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a file of {"<name>": [...]}."""
    return flat_rows(spark.read.text(path, wholetext=True), name, schema, "value")


def marketplace_rows(df: DataFrame) -> DataFrame:
    """Actor rows with fields renamed; prices that are no numbers are null."""
    return df.select(
        F.col("id").alias("external_id"), F.coalesce("marketplace_listing_title", "title").alias("title"), money.parse_float(F.col("price").cast("string")).try_cast("long").alias("price"), F.col("listingUrl").alias("url"), F.lit("facebook").alias("source")
    )
