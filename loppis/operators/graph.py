"""The knowledge graph as files and as tables: whole import into the model's tables, whole export out of them.

A file nests categories, brands and products in maps; a second one lists synonyms. Import upserts categories, brands and
products by slug, and replaces identifiers, relations and synonyms by what the files hold. Where a slug comes up again, later
entries win. Ids of known slugs stay; new ones follow from table and slug.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loppis.functions import text

from .writes import first_by, upsert

c = F.col

#: Schemas of the two files.
PRODUCT = "struct<name:string,type:string,era:string,reference_url:string,model:string,sku:array<string>,ean:array<string>,price_range_dkk:array<bigint>,related:array<string>,clones:array<string>>"
GRAPH = f"version string, description string, categories map<string,struct<brands:map<string,struct<products:map<string,{PRODUCT}>>>>>"
SYNONYMS = "version string, description string, synonyms map<string,array<string>>"

#: Display names of known categories.
CATEGORY_NAMES = {"music-gear": ("Musikudstyr", "Music Gear"), "danish-modern": ("Dansk Design", "Danish Modern"), "photography": ("Fotografi", "Photography"), "tech": ("Teknologi", "Technology")}

#: Columns that import sets; a table may have more, which it leaves alone.
CATEGORY = "id string, slug string, name_da string, name_en string"
BRAND = "id string, slug string, name string, category_id string"
PRODUCTS = "id string, slug string, canonical_name string, model_name string, brand_id string, category_id string, price_min_dkk bigint, price_max_dkk bigint, era string, reference_url string, attributes string, status string"


def read_files(spark: SparkSession, graph: str, synonyms: str) -> tuple[DataFrame, DataFrame]:
    """The two files; a broken one fails the read."""
    one = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return one.schema(GRAPH).json(graph), one.schema(SYNONYMS).json(synonyms)


def _ids(table: DataFrame, name: str) -> DataFrame:
    return table.withColumn("id", F.coalesce("id", text.deterministic_id(F.lit(name), c("slug"))))


def _known(slugs: DataFrame, old: DataFrame, name: str) -> DataFrame:
    """(slug, id) of all slugs, new and old: what a table's rows refer to, without the rest of its columns."""
    return _ids(slugs.join(old.filter("slug IS NOT NULL").select("slug", "id"), "slug", "full_outer"), name)


def _category_name(slug: Column, at: int) -> Column:
    known = F.create_map(*[F.lit(x) for s, names in CATEGORY_NAMES.items() for x in (s, names[at])])
    return F.coalesce(F.try_element_at(known, slug), slug)


def import_graph(graph: DataFrame, synonyms: DataFrame, old: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """kg_category, kg_brand, kg_product, kg_identifier, kg_relation and synonym after the files are imported.

    graph: categories, and seq where it has several rows, by which these are ordered. old: kg_category, kg_brand and kg_product as
    they are; without them the tables are new. Relations to slugs that no product has, in the files or before, are dropped.
    """
    spark = graph.sparkSession
    old = old or {n: spark.createDataFrame([], ddl) for n, ddl in (("kg_category", CATEGORY), ("kg_brand", BRAND), ("kg_product", PRODUCTS))}
    seq = c("seq") if "seq" in graph.columns else F.lit(0)
    cats = graph.select(seq.alias("seq"), F.posexplode("categories").alias("i", "category", "c"))
    brands = cats.select("seq", "i", "category", F.posexplode("c.brands").alias("j", "brand", "b"))
    rows = brands.select("seq", "i", "j", "category", "brand", F.posexplode("b.products").alias("k", "slug", "p"))

    new = cats.select(c("category").alias("slug"), _category_name(c("category"), 0).alias("name_da"), _category_name(c("category"), 1).alias("name_en"))
    categories = _ids(upsert(old["kg_category"], new.distinct(), ["slug"], [c("slug")]), "kg_category")
    cat_id = _known(new.select("slug").distinct(), old["kg_category"], "kg_category").select(c("slug").alias("category"), c("id").alias("category_id"))

    last = first_by(brands, ["brand"], [c("seq").desc(), c("i").desc(), c("j").desc()]).select("brand", "category")
    named = last.join(cat_id, "category").select(c("brand").alias("slug"), text.brand_name(c("brand")).alias("name"), "category_id")
    all_brands = _ids(upsert(old["kg_brand"], named, ["slug"], [c("name")]), "kg_brand")
    brand_id = _known(brands.select(c("brand").alias("slug")).distinct(), old["kg_brand"], "kg_brand").select(c("slug").alias("brand"), c("id").alias("brand_id"))

    entries = first_by(rows, ["slug"], [c("seq").desc(), c("i").desc(), c("j").desc(), c("k").desc()])
    # an entry without a type has an empty object, not none
    kind = F.coalesce(F.to_json(F.struct(F.nullif("p.type", F.lit("")).alias("type"))), F.lit("{}"))
    shaped = entries.join(cat_id, "category").join(brand_id, "brand").select(
        "slug", c("p.name").alias("canonical_name"), c("p.model").alias("model_name"), "brand_id", "category_id", F.get("p.price_range_dkk", F.lit(0)).alias("price_min_dkk"),
        F.get("p.price_range_dkk", F.lit(1)).alias("price_max_dkk"), c("p.era").alias("era"), c("p.reference_url").alias("reference_url"), kind.alias("attributes"), F.lit("active").alias("status"),
    )
    products = _ids(upsert(old["kg_product"], shaped, ["slug"], [c("canonical_name")]), "kg_product")
    product_id = _known(rows.select("slug").distinct(), old["kg_product"], "kg_product").withColumnRenamed("id", "product_id")

    none = F.array().cast("array<string>")
    sku, ean = F.coalesce("p.sku", none), F.coalesce("p.ean", none)
    model = F.when((c("p.model") != "") & ~F.array_contains(sku, c("p.model")), F.array("p.model")).otherwise(none)

    def coded(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    listed = F.concat(coded("SKU", sku), coded("EAN", ean), coded("MODEL", model))
    identifiers = entries.select("slug", F.inline(listed)).join(product_id, "slug").select("product_id", "type", "value", F.lit(80).alias("confidence"), F.lit("seed").alias("source"))

    siblings = entries.select(c("slug").alias("from_slug"), F.explode("p.related").alias("to_slug"), F.lit("sibling").alias("type"))
    clones = entries.select(F.explode("p.clones").alias("from_slug"), c("slug").alias("to_slug"), F.lit("clone").alias("type"))
    ends = [product_id.select(c("slug").alias(f"{end}_slug"), c("product_id").alias(f"{end}_product_id")) for end in ("from", "to")]
    relations = siblings.unionByName(clones).distinct().join(ends[0], "from_slug").join(ends[1], "to_slug").select("from_product_id", "to_product_id", "type", F.lit(50).alias("weight"))

    pairs = synonyms.select(F.explode("synonyms").alias("canonical_query", "aliases"))
    exact = pairs.select(c("canonical_query").alias("alias"), "canonical_query", F.lit("da").alias("lang"), F.lit("exact").alias("match_type"), F.lit(100).alias("priority"))
    alias = pairs.select(F.explode("aliases").alias("alias"), "canonical_query", F.lit("da").alias("lang"), F.lit("alias").alias("match_type"), F.lit(50).alias("priority"))
    return {"kg_category": categories, "kg_brand": all_brands, "kg_product": products, "kg_identifier": identifiers, "kg_relation": relations, "synonym": exact.unionByName(alias)}


def export_graph(categories: DataFrame, brands: DataFrame, products: DataFrame, identifiers: DataFrame, relations: DataFrame) -> DataFrame:
    """(category, json): one row for each category, {"brands": {...}} with brands and products in order of their slugs.

    A product stands below its brand, and a brand below its own category, whatever category the product names. Empty
    categories and brands are there; fields without a value, and empty lists, are not. Clones are listed at their original,
    all other relations where they start. A category's row holds all its products, so categories bound what a task holds.
    """
    slug = products.select(c("id").alias("_id"), c("slug").alias("_slug"))
    out = relations.filter("type <> 'clone'").join(slug, c("to_product_id") == c("_id")).groupBy(c("from_product_id").alias("id")).agg(F.sort_array(F.collect_list("_slug")).alias("related"))
    back = relations.filter("type = 'clone'").join(slug, c("from_product_id") == c("_id")).groupBy(c("to_product_id").alias("id")).agg(F.sort_array(F.collect_list("_slug")).alias("clones"))
    codes = identifiers.groupBy(c("product_id").alias("id")).agg(
        *[F.nullif(F.sort_array(F.collect_list(F.when(c("type") == kind, c("value")))), F.array().cast("array<string>")).alias(name) for kind, name in (("SKU", "sku"), ("EAN", "ean"))]
    )
    rich = products.join(out, "id", "left").join(back, "id", "left").join(codes, "id", "left")
    said = lambda x: F.nullif(x, F.lit(""))
    prices = F.when(c("price_min_dkk").isNotNull() & c("price_max_dkk").isNotNull(), F.array("price_min_dkk", "price_max_dkk"))
    body = F.struct(
        c("canonical_name").alias("name"), said(F.get_json_object("attributes", "$.type")).alias("type"), said(c("era")).alias("era"), "related", "clones", said(c("reference_url")).alias("reference_url"),
        prices.alias("price_range_dkk"), said(c("model_name")).alias("model"), "sku", "ean",
    )
    listed = rich.groupBy("brand_id").agg(F.sort_array(F.collect_list(F.struct("slug", F.to_json(body).alias("json")))).alias("products"))
    shelf = brands.select(c("id").alias("brand_id"), c("slug").alias("brand"), "category_id").join(listed, "brand_id", "left")
    shelf = shelf.select("category_id", "brand", F.concat(F.lit('{"products":'), _object("products", "slug"), F.lit("}")).alias("json"))
    whole = shelf.groupBy("category_id").agg(F.sort_array(F.collect_list(F.struct("brand", "json"))).alias("brands"))
    named = categories.select(c("id").alias("category_id"), c("slug").alias("category")).join(whole, "category_id", "left")
    return named.select("category", F.concat(F.lit('{"brands":'), _object("brands", "brand"), F.lit("}")).alias("json"))


def _object(entries: str, key: str) -> Column:
    """A JSON object of an array of (key, json) pairs; null makes an empty one."""
    quoted = lambda e: F.regexp_extract(F.to_json(F.struct(e[key].alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    inside = F.array_join(F.transform(c(entries), lambda e: F.concat(quoted(e), F.lit(":"), e["json"])), ",")
    return F.concat(F.lit("{"), F.coalesce(inside, F.lit("")), F.lit("}"))


def export_synonyms(synonyms: DataFrame) -> DataFrame:
    """(canonical_query, aliases): aliases in order; exact rows and those without a canonical name are left out."""
    kept = synonyms.filter("canonical_query IS NOT NULL AND match_type <> 'exact'")
    return kept.groupBy("canonical_query").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
