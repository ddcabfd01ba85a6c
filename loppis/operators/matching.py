"""Resolving listings to products: tokens in titles, tier cascade, canonical names, unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loppis.functions import text
from loppis.functions.nested import let

from .writes import first_by

WORD_SPLIT = r"[^A-Za-z0-9_-]+"


def _runs_of(w: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.when(F.size(w) >= n, F.array_join(F.slice(w, i, n), " "))), lambda g: g.isNotNull())


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), WORD_SPLIT), lambda w: w != "")


def token_hits(titles: DataFrame, dictionary: DataFrame, title_id: str, title: str, token: str, longest: int = 4, broadcast_rows: int = 200_000) -> DataFrame:
    """(title_id, dictionary columns) for each dictionary token in a title, at word boundaries.

    A token that is one word is in a title just where it equals one of its words, so words are joined and no text
    moves; the dictionary is broadcast after a count, or else joined by a shuffle of the words. Other tokens are joined
    by their first words, of `longest` at most and only in numbers that occur, and tested at their boundaries on the
    few candidates. A token without a word never matches.
    """
    usable = dictionary.filter(F.length(token) >= 3).withColumn("_plain", F.regexp_like(F.col(token), F.lit("^[A-Za-z0-9_-]+$")))
    usable = usable.withColumn("_n", F.when(F.col("_plain"), F.lit(1)).otherwise(F.least(F.size(_words(F.col(token))), F.lit(longest)))).filter("_n > 0")
    counts = {(r["_plain"], r["_n"]): r["count"] for r in usable.groupBy("_plain", "_n").count().collect()}  # at most 2 * longest rows
    small = sum(counts.values()) <= broadcast_rows

    def beside(tokens: DataFrame) -> DataFrame:
        return F.broadcast(tokens.drop("_plain", "_n")) if small else tokens.drop("_plain", "_n")

    # split before lower-casing: letters that only become ASCII in lower case are no word characters
    own = F.array_distinct(F.transform(F.filter(F.split(F.col(title), WORD_SPLIT), lambda w: w != ""), F.lower))
    plain = beside(usable.filter("_plain").withColumn("_gram", F.lower(token)))
    found = titles.select(title_id, F.explode(own).alias("_gram")).join(plain, "_gram").drop("_gram")
    lengths = sorted(n for is_plain, n in counts if not is_plain)
    if not lengths:
        return found
    rest = beside(usable.filter(~F.col("_plain")).withColumn("_gram", F.array_join(F.slice(_words(F.col(token)), 1, longest), " ")))
    grams = let(_words(F.col(title)), lambda w: F.array_distinct(F.concat(*[_runs_of(w, n) for n in lengths])))
    maybe = titles.select(title_id, F.explode(grams).alias("_gram")).join(rest, "_gram").drop("_gram").distinct()
    tested = maybe.join(titles.select(title_id, title), title_id).filter(text.contains_token(F.col(title), F.col(token))).drop(title)
    return found.unionByName(tested)


def token_hits_naive(titles: DataFrame, dictionary: DataFrame, title_id: str, title: str, token: str) -> DataFrame:
    """The same by comparing every pair; the yardstick of tests on small tables."""
    return titles.select(title_id, title).join(dictionary, text.contains_token(F.col(title), F.col(token))).drop(title)


def resolve_canonical(canonicals: DataFrame, products: DataFrame) -> DataFrame:
    """(canonical, product_id): equal slug, else slug that starts with the canonical and a hyphen, else canonical
    that ends with a hyphen and a slug of four characters or more, else name that starts with it. Lowest id of a tier.

    Each tier is an equi join on a prefix or suffix cut at hyphens or spaces, never a comparison of all pairs. Of products
    that share a slug, a beginning of it or a name's beginning only the lowest id takes part.
    """

    def lowest(rows: DataFrame, key: str) -> DataFrame:
        # files of repeated names look small enough to broadcast when their rows are not, hence the merge join
        return rows.groupBy(key).agg(F.min("product_id").alias("product_id")).hint("merge")

    c = canonicals.select("canonical").distinct().withColumn("slug", text.slugify_accents(F.col("canonical")))
    p = products.groupBy("slug").agg(F.min("product_id").alias("product_id"))
    n = products.groupBy(F.lower("name").alias("name")).agg(F.min("product_id").alias("product_id"))
    parts = F.split("slug", "-")
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    heads = p.select("product_id", F.explode(F.when(F.size(parts) > 1, upto).otherwise(F.array().cast("array<string>"))).alias("slug"))
    tails_of = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "-"))
    tails = c.select("canonical", F.explode(F.when(F.size(parts) > 1, tails_of).otherwise(F.array().cast("array<string>"))).alias("slug"))
    named = n.select("product_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(F.col("name"), F.lit(1), i)))).alias("low"))
    found = (
        c.join(lowest(p, "slug"), "slug").select("canonical", "product_id", F.lit(1).alias("tier"))
        .unionByName(c.join(lowest(heads, "slug"), "slug").select("canonical", "product_id", F.lit(2).alias("tier")))
        .unionByName(tails.join(lowest(p.filter(F.length("slug") >= 4), "slug"), "slug").select("canonical", "product_id", F.lit(3).alias("tier")))
        .unionByName(c.withColumn("low", F.lower("canonical")).join(lowest(named, "low"), "low").select("canonical", "product_id", F.lit(4).alias("tier")))
    )
    return first_by(found, ["canonical"], [F.col("tier"), F.col("product_id")]).select("canonical", "product_id", "tier")


def cascade(listings: DataFrame, identifiers: DataFrame, synonyms: DataFrame, models: DataFrame, listing_id: str = "listing_id", title: str = "title") -> DataFrame:
    """(listing_id, product_id, method, score, explain): the best tier of each listing, explained as JSON.

    identifiers: product_id, type, value, seq (types SKU and MODEL match, 95). synonyms: product_id (null if its
    canonical name resolves to none), alias, canonical_query (optional), match_type, priority, seq (only "alias" matches,
    80). models: product_id, model, seq (the name or its form with spaces for hyphens, as MODEL, 70). The first hit of a
    tier wins; a synonym without a product is skipped, not final.
    """

    def tier(rows: DataFrame, token: Column, method: Column, score: int, priority: Column, *explain: Column) -> DataFrame:
        return rows.select("product_id", token.alias("token"), method.alias("method"), F.lit(score).alias("score"), priority.alias("priority"), "seq", F.to_json(F.struct(*explain)).alias("explain"))

    query = F.col("canonical_query") if "canonical_query" in synonyms.columns else F.lit(None).cast("string")
    trimmed = F.trim("model")
    spaced = models.filter("model IS NOT NULL").withColumn("_form", F.explode(F.array_distinct(F.array(trimmed, F.replace(trimmed, F.lit("-"), F.lit(" "))))))
    dictionary = (
        tier(identifiers.filter(F.col("type").isin("SKU", "MODEL")), F.col("value"), F.col("type"), 95, F.lit(0), F.col("value").alias("matched_identifier"), F.col("type"))
        .unionByName(tier(synonyms.filter((F.col("match_type") == "alias") & F.col("product_id").isNotNull()), F.col("alias"), F.lit("SYNONYM"), 80, -F.col("priority"), F.col("alias").alias("matched_alias"), query.alias("canonical_query")))
        .unionByName(tier(spaced, F.col("_form"), F.lit("MODEL"), 70, F.lit(0), F.col("model").alias("matched_model_name")))
    )
    hits = token_hits(listings.select(listing_id, title), dictionary, listing_id, title, "token")
    return first_by(hits, [listing_id], [F.col("score").desc(), F.col("priority"), F.col("seq"), F.col("product_id")]).select(listing_id, "product_id", "method", "score", "explain")


def unique_name_join(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """(left_id, right_id, verdict) by normalised name: will_map for exactly one partner, ambiguous for more, no_match."""
    r = right.select(F.col(right_id), text.alnum_key(F.col(right_name)).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(right_id).alias("_id"))
    j = left.select(left_id, text.alnum_key(F.col(left_name)).alias("_key")).join(r, "_key", "left")
    verdict = F.when(F.col("_n") == 1, "will_map").when(F.col("_n") > 1, "ambiguous").otherwise("no_match")
    return j.select(left_id, F.when(F.col("_n") == 1, F.col("_id")).alias(right_id), verdict.alias("verdict"))


def _pieces(x: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(x) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(x, i, F.lit(size))))


def contained_pairs(texts: DataFrame, names: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, _text, _name): each different text with each different name of the same group that it contains; empty names
    are in none.

    A name is looked for by that of its three-character pieces which the fewest texts of its group hold, so a piece that many
    texts or names share is a key only for names that have no other, and a name with a piece that no text has falls away.
    Names of one or two characters are looked for whole.
    """
    t = texts.select(*on, "_text").filter("_text IS NOT NULL").distinct()
    n = names.select(*on, "_name").filter("_name <> ''").distinct()
    grams = t.filter(F.length("_text") >= 3).select(*on, "_text", F.explode(_pieces(F.col("_text"), 3)).alias("_g"))
    seen = grams.groupBy(*on, "_g").agg(F.count(F.lit(1)).alias("_df"))
    own = n.filter(F.length("_name") >= 3).withColumn("_p", _pieces(F.col("_name"), 3)).select(*on, "_name", F.size("_p").alias("_k"), F.explode("_p").alias("_g"))
    rarest = own.join(seen, [*on, "_g"]).groupBy(*on, "_name", "_k").agg(F.min(F.struct("_df", "_g")).alias("_r"), F.count(F.lit(1)).alias("_m"))
    keyed = rarest.filter("_m = _k").select(*on, "_name", F.col("_r._g").alias("_g"))
    found = grams.join(keyed, [*on, "_g"]).filter(F.contains("_text", F.col("_name")))
    short = n.filter(F.length("_name") < 3).withColumn("_g", F.col("_name"))
    small = t.select(*on, "_text", F.explode(F.array_union(_pieces(F.col("_text"), 1), _pieces(F.col("_text"), 2))).alias("_g")).join(short, [*on, "_g"])
    return found.select(*on, "_text", "_name").unionByName(small.select(*on, "_text", "_name"))


def longest_contained(titles: DataFrame, names: DataFrame, title_id: str, title: str, name_id: str, name: str) -> DataFrame:
    """(title_id, name_id): the longest name that a title contains as a substring, lowest id on ties; each different title is
    looked at once."""
    low = names.select(F.col(name_id).alias("_id"), F.lower(name).alias("_name")).filter("_name <> ''").groupBy("_name").agg(F.min("_id").alias(name_id))
    t = titles.select(title_id, F.lower(title).alias("_text"))
    best = first_by(contained_pairs(t, low).join(low, "_name"), ["_text"], [F.length("_name").desc(), F.col(name_id)])
    return t.join(best.select("_text", name_id), "_text").select(title_id, name_id)


def demand(watched: DataFrame, products: DataFrame, query: str, product_id: str, name: str) -> DataFrame:
    """How many watched queries contain each product's name, whatever the case; products without any count 0, and so do
    names of fewer than three characters. Equal queries, and equal names, are compared once."""
    q = watched.select(F.lower(query).alias("_text")).groupBy("_text").agg(F.count(F.lit(1)).alias("_times"))
    named = products.select(product_id, name, F.lower(name).alias("_name"))
    counted = contained_pairs(q, named.filter(F.length("_name") >= 3)).join(q, "_text").groupBy("_name").agg(F.sum("_times").alias("demand"))
    return named.join(counted, "_name", "left").select(product_id, name, F.coalesce("demand", F.lit(0)).alias("demand"))
