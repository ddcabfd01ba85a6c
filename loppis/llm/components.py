"""Connected components of a link table, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, removed, stored_at


def _beside(edges: DataFrame, least: DataFrame, nodes: int, many: int, salts: int, broadcast_nodes: int) -> DataFrame:
    """Edges (u, v) with the value m of their u, from cut rows (u, m, n), of which there are `nodes`: few are broadcast,
    more are joined; then edges of nodes with `many` or more are dealt over salts, with the value beside each."""
    if nodes <= broadcast_nodes:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    hot = F.broadcast(least.filter(F.col("n") >= many).select("u", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = edges.join(hot, "u", "left").withColumn("salt", salt).drop("hot")
    return dealt.join(least.join(hot, "u", "left").select("u", "m", F.explode(copies).alias("salt")), ["u", "salt"]).drop("salt")


def components(links: DataFrame, salts: int = 64, broadcast_nodes: int = 200_000, part_rows: int = 500_000) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of (a, b) links.

    Alternates star contractions (Kiveris et al., 2014) until nothing changes: each node links its larger neighbours to
    its smallest one, then its smaller neighbours. Links only shrink towards the roots; each round is stored in the
    shared folder, in parts of about part_rows. Values of nodes are broadcast where the nodes were counted to be few.
    Otherwise nodes with a thousandth of all links or more, of which there are at most 2000 by that, have theirs dealt
    over salts; minima combine before their shuffle.
    """
    spark = links.sparkSession
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    edges, folder = stored_at(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # a fixed point is a forest of stars: every node points straight at a root
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        many, parts = max(1000, now[0] // 1000), max(8, now[0] // part_rows)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        low = cut(low.coalesce(parts))
        large = _beside(both.filter("v > u"), low, low.count(), many, salts, broadcast_nodes)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(parts))
        joined = _beside(large, least, least.count(), many, salts, broadcast_nodes)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old = folder
        edges, folder = stored_at(small.coalesce(parts))
        removed(spark, old)
    roots = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("v", "node").alias("root"))
