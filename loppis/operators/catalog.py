"""The knowledge graph: import from and export to nested JSON, relations, the category tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loppis.functions import money, text

S = T.StringType()
PRODUCT = T.StructType(
    [T.StructField(n, S) for n in ("name", "type", "era", "reference_url", "model", "sku", "ean")]
    + [T.StructField("price_range_dkk", T.ArrayType(T.LongType())), T.StructField("related", T.ArrayType(S)), T.StructField("clones", T.ArrayType(S))]
)
GRAPH = T.StructType(
    [
        T.StructField("version", S),
        T.StructField("description", S),
        T.StructField(
            "categories",
            T.MapType(S, T.StructType([T.StructField("brands", T.MapType(S, T.StructType([T.StructField("products", T.MapType(S, PRODUCT))])))])),
        ),
    ]
)


def read_graph(spark, path: str) -> DataFrame:
    return spark.read.schema(GRAPH).option("multiLine", True).option("mode", "FAILFAST").json(path)


def flatten_graph(graph: DataFrame) -> dict[str, DataFrame]:
    """categories, brands, products, identifiers and relations of the nested document."""
    cats = graph.select(F.explode("categories").alias("category", "c"))
    brands = cats.select("category", F.explode("c.brands").alias("brand", "b"))
    rows = brands.select("category", "brand", F.explode("b.products").alias("slug", "p"))
    products = rows.select(
        "slug", "category", "brand", F.col("p.name").alias("name"), F.col("p.type").alias("type"), F.col("p.era").alias("era"), F.col("p.model").alias("model"),
        F.get("p.price_range_dkk", F.lit(0)).alias("price_min"), F.get("p.price_range_dkk", F.lit(1)).alias("price_max"),
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), F.col(f"p.{f}").alias("value")) for k, f in (("MODEL", "model"), ("SKU", "sku"), ("EAN", "ean"))])
    identifiers = rows.select("slug", F.explode(kinds).alias("i")).select("slug", "i.type", "i.value").filter("value IS NOT NULL")
    edges = rows.select("slug", F.explode("p.related").alias("to"), F.lit("sibling").alias("type")).unionByName(
        rows.select(F.explode("p.clones").alias("slug"), F.col("slug").alias("to"), F.lit("clone").alias("type"))
    )
    known = products.select("slug").distinct()
    relations = (
        edges.select(F.col("slug").alias("from"), "to", "type").distinct()
        .join(known.withColumnRenamed("slug", "from"), "from", "left_semi")
        .join(known.withColumnRenamed("slug", "to"), "to", "left_semi")
        .select("from", "to", "type")
    )
    return {
        "categories": cats.select(F.col("category").alias("slug")),
        "brands": brands.select("brand", "category").groupBy("brand").agg(F.min("category").alias("category")).withColumn("name", text.brand_name(F.col("brand"))),
        "products": products,
        "identifiers": identifiers,
        "relations": relations,
    }


def relation_lists(relations: DataFrame) -> DataFrame:
    """(slug, related, clones): clone edges point from the clone to its original, so they are read backwards."""
    rel = relations.filter("type <> 'clone'").groupBy(F.col("from").alias("slug")).agg(F.sort_array(F.collect_set("to")).alias("related"))
    clones = relations.filter("type = 'clone'").groupBy(F.col("to").alias("slug")).agg(F.sort_array(F.collect_set("from")).alias("clones"))
    return rel.join(clones, "slug", "full_outer")


def export_graph(products: DataFrame, relations: DataFrame, version: str) -> DataFrame:
    """One nested JSON document: a row for each category, with brands and products in maps.

    products: slug, category, brand, name and further scalar columns. Categories are rows, so no task holds the
    whole graph.
    """
    rich = products.join(relation_lists(relations), "slug", "left")
    fields = [c for c in rich.columns if c not in ("slug", "category", "brand")]

    def ordered(key: str, value) -> Column:
        """Map of a group in key order; the values (maps) have no order of their own."""
        entries = F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))

    by_brand = rich.groupBy("category", "brand").agg(ordered("slug", F.struct(*fields)).alias("products"))
    by_category = by_brand.groupBy("category").agg(ordered("brand", F.struct("products")).alias("brands"))
    return by_category.select("category", F.lit(version).alias("version"), F.to_json(F.struct("brands")).alias("json"))


def seed_categories(paths: DataFrame) -> DataFrame:
    """(slug, root, parent): "root/sub" slugs below their roots, roots without a parent."""
    parts = F.split("slug", "/")
    return paths.select("slug", parts[0].alias("root"), F.when(F.size(parts) > 1, parts[0]).alias("parent"), text.slug_tail(F.col("slug")).alias("tail"))


def category_images(roots: DataFrame, tree: DataFrame, products: DataFrame, chosen: DataFrame, least: int = 2) -> DataFrame:
    """Roots with the image of their best active product, unless an editor chose one.

    roots: id, slug, image_url. tree: id, parent_id. products: id, category_id, status, tier, hero_image_url, image_url.
    chosen: slug, choice; a null choice keeps the root from taking a product's image. A best score below `least` or no
    usable image leaves the old one. Ties go to the smallest product id.
    """
    image = F.coalesce("hero_image_url", "image_url")
    score = money.image_score(F.col("tier"), F.col("hero_image_url"), F.col("image_url"))
    usable = products.filter("status = 'active'").select("category_id", F.col("id").alias("product_id"), image.alias("image"), score.alias("score"))
    usable = usable.filter((F.col("score") > 0) & (F.col("image") != "") & money.usable_image(F.col("image")))
    below = tree.filter("parent_id IS NOT NULL").select(F.col("id").alias("category_id"), F.col("parent_id").alias("id"))
    rank = F.struct((-F.col("score")).alias("s"), "product_id", "image")
    best = usable.join(below, "category_id").groupBy("id").agg(F.min(rank).alias("best"))
    picked = roots.join(best, "id", "left").join(chosen.withColumn("edited", F.lit(True)), "slug", "left")
    found = F.when(F.col("edited").isNull() & (-F.col("best.s") >= least), F.col("best.image"))
    return picked.select("id", "slug", F.coalesce("choice", found, "image_url").alias("image_url"))


def roll_up(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """Sums (category_id, n) at the roots: a category without a parent is its own root. tree: category_id, parent_id."""
    j = counts.join(tree, "category_id").withColumn("root_id", F.coalesce("parent_id", "category_id"))
    return j.groupBy("root_id").agg(F.sum("n").alias("n"))
