"""Sold prices and catalogue pages taken in: from landed rows to histories, the fetch queue, and what products resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loppis.functions import dates, money, text

from .ranking import top_per_group
from .writes import first_by, insert_ignore

c = F.col

#: A listing and watchlist is in a history once; rows without a watchlist never conflict, as in the source tables.
SOLD_KEY = ["listing_url", "watchlist_id"]


def unique_watchlists(watchlists: DataFrame) -> DataFrame:
    """The first watchlist by id of each query, whatever its case and outer blanks: one fetch serves them all."""
    return first_by(watchlists.filter(F.trim("query") != ""), [F.lower(F.trim("query"))], [c("id")])


def marketplace_sold(rows: DataFrame, rates: dict[str, float] = money.BATCH) -> DataFrame:
    """Sold listings of the marketplace as history rows: priced ones in kroner, an unknown currency counting as dollars.

    rows: watchlist_id, query, title, amount (text), currency, condition, url, published_at, created_at.
    """
    amount = money.parse_float(c("amount"))
    priced = rows.withColumn("_amount", amount).filter("_amount > 0")
    return priced.select(
        "watchlist_id", "query", F.lit("reverb").alias("source"), money.to_dkk(c("_amount"), c("currency"), rates, "usd").cast("double").alias("price"), F.lit("DKK").alias("currency"),
        "condition", c("url").alias("listing_url"), c("title").alias("listing_title"), F.coalesce("published_at", "created_at").alias("sold_at"),
    )


def auction_sold(rows: DataFrame, site: str, rates: dict[str, float] = money.BATCH) -> DataFrame:
    """Hammered auctions as history rows: those with a readable price above 0, which the page gives in kroner; the estimate is
    converted.

    rows: watchlist_id, query, title, amount_value ("6,513 DKK"), estimate, currency, url (path), ended ("Hammered 11 Dec 2016").
    """
    priced = rows.withColumn("_amount", money.parse_amount(c("amount_value"))).filter("_amount > 0")
    return priced.select(
        "watchlist_id", "query", F.lit("auctionet").alias("source"), c("_amount").cast("double").alias("price"), F.lit("DKK").alias("currency"), F.lit(None).cast("string").alias("condition"),
        F.concat(F.lit(site), "url").alias("listing_url"), c("title").alias("listing_title"), dates.hammered_date(c("ended")).alias("sold_at"),
        money.to_dkk(c("estimate"), c("currency"), rates, "usd").cast("double").alias("estimate_low"), F.lit(None).cast("double").alias("estimate_high"),
    )


def ingest_sold(history: DataFrame, sold: DataFrame) -> DataFrame:
    """history with the sales that it doesn't have yet; of equal new ones the earliest stays."""
    return insert_ignore(history, sold.select(*[x for x in history.columns if x in sold.columns]), SOLD_KEY, [c("sold_at").asc_nulls_last(), c("price")])


def run_queue(queue: DataFrame, products: DataFrame, brands: DataFrame, landed: DataFrame, history: DataFrame, now: Column, most: int = 10) -> dict[str, DataFrame]:
    """queue, history and requests (product_slug, search) after one run of the worker.

    The `most` oldest pending jobs are taken. One whose product or brand is not there fails; the others are done, whether
    or not sales were found for them. landed: sales as `marketplace_sold` takes them, with product_slug. They are kept under
    the slug and without a watchlist, so another run adds them again.
    """
    taken = queue.filter("status = 'pending'").orderBy("created_at", "id").limit(most).select("id", "product_slug")
    known = first_by(products.join(brands.select(c("id").alias("brand_id"), c("name").alias("_brand")), "brand_id"), ["slug"], [c("id")])
    named = known.select(c("slug").alias("product_slug"), F.concat_ws(" ", "_brand", F.coalesce("model_name", F.lit("null"))).alias("search"))
    jobs = taken.join(named, "product_slug", "left")
    after = jobs.select("id", F.when(c("search").isNull(), "failed").otherwise("done").alias("_status"))
    ended = queue.join(after, "id", "left").withColumns({"status": F.coalesce("_status", "status"), "processed_at": F.when(c("_status").isNotNull(), now).otherwise(c("processed_at"))})
    good = jobs.filter("search IS NOT NULL").select("product_slug").distinct()
    sold = marketplace_sold(landed.join(good, "product_slug", "left_semi").withColumns({"query": c("product_slug"), "watchlist_id": F.lit(None).cast("string")}))
    return {"queue": ended.select(*queue.columns), "history": ingest_sold(history, sold), "requests": jobs.filter("search IS NOT NULL").select("product_slug", "search")}


# --- what products resolve to -----------------------------------------------------------------------------------------


def resolved_pages(products: DataFrame, found: DataFrame, now: Column, considered: int = 3) -> DataFrame:
    """(id, resolution, candidates) of products: of the first pages found for each, the best by score, then use; the others
    as candidates in that order. A product without pages has a null resolution.

    products: id, canonical_name. found: id, arrival, csp_id, slug, title, image_url, used_total, low_amount, low_currency.
    """
    few = top_per_group(found, ["id"], [c("arrival")], considered).drop("rank").join(products.select("id", "canonical_name"), "id")
    score = text.token_score(c("canonical_name"), c("title"))
    low = F.when(c("low_currency") == "USD", money.parse_float(c("low_amount")))
    record = F.struct(
        "csp_id", "slug", "title", "image_url", F.coalesce("used_total", F.lit(0)).alias("used_total"), low.alias("used_low_price_usd"), c("_score").alias("score"),
        text.confidence(c("_score"), F.size(text.tokens(c("canonical_name")))).alias("confidence"), now.alias("resolved_at"),
    )
    ranked = top_per_group(few.withColumn("_score", score).withColumn("used_total", F.coalesce("used_total", F.lit(0))), ["id"], [c("_score").desc(), c("used_total").desc(), c("arrival")], considered)
    gathered = ranked.select("id", "rank", record.alias("record")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "record"))).alias("r"))
    records = gathered.select("id", F.get("r.record", F.lit(0)).alias("resolution"), F.slice("r.record", 2, considered).alias("candidates"))
    return products.select("id").join(records, "id", "left")


def unresolved(products: DataFrame) -> DataFrame:
    """Products whose attributes name no page yet."""
    return products.filter(F.get_json_object("attributes", "$.reverb_csp.csp_id").isNull())


def with_resolutions(products: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """products with the resolution and its candidates in their attributes (JSON); whatever else these hold stays. One that was
    looked for in vain notes that; candidates of an earlier run go if there are none now."""
    none = F.to_json(F.struct(now.alias("resolved_at"), F.lit("none").alias("confidence")))
    told = resolved.select("id", F.coalesce(F.to_json("resolution"), none).alias("_page"), F.when(F.size("candidates") > 0, F.to_json("candidates")).alias("_others"), F.lit(True).alias("_seen"))
    held = F.coalesce(F.expr("cast(try_parse_json(attributes) AS map<string, variant>)"), F.expr("cast(map() AS map<string, variant>)"))
    rest = F.map_filter(held, lambda k, _: ~k.isin("reverb_csp", "reverb_csp_candidates"))
    own = F.map_from_arrays(F.array(F.lit("reverb_csp")), F.array(F.parse_json("_page")))
    more = F.when(c("_others").isNotNull(), F.map_from_arrays(F.array(F.lit("reverb_csp_candidates")), F.array(F.parse_json("_others")))).otherwise(F.expr("cast(map() AS map<string, variant>)"))
    merged = F.to_json(F.map_concat(rest, own, more))
    return products.join(told, "id", "left").withColumn("attributes", F.when(c("_seen"), merged).otherwise(c("attributes"))).select(*products.columns)


def promoted(products: DataFrame) -> DataFrame:
    """Pages resolved with high or medium confidence become the product's own, unless it has one."""
    page = F.get_json_object("attributes", "$.reverb_csp.csp_id")
    sure = F.get_json_object("attributes", "$.reverb_csp.confidence").isin("high", "medium")
    return products.withColumn("reverb_csp_id", F.when(c("reverb_csp_id").isNull() & sure & page.isNotNull(), page).otherwise(c("reverb_csp_id")))
