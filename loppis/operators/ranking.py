"""Top rows of groups, merged and paged rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loppis.session import shared_folder

from .writes import first_by


def best_match(matches: DataFrame, key: str, score: str, tie: list[Column]) -> DataFrame:
    """Highest score of each key, ties by the given order."""
    return first_by(matches, [key], [F.col(score).desc_nulls_last(), *tie])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def numbered(df: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """Rows with their number from 1 in a total order, over all rows or within each `group`.

    Rows are sorted into ranges and numbered inside these; each range adds the rows of the ranges before it, so no task
    holds more than a range, however large a group is. The ranges are written to the shared folder once: both their
    counts and their rows come from what was written.
    """
    by = [F.col(group), *order] if group else order
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    folder = shared_folder(df.sparkSession)
    ranged.write.parquet(folder)
    # the id holds the number of the range above 33 bits that count its rows
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rows = df.sparkSession.read.schema(ranged.schema).parquet(folder).withColumn("_range", F.shiftright("_at", 33)).withColumn(name, inside).drop("_at")
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # one row a range, and there are at most as many ranges as shuffle partitions
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
    if group:
        first = placed.groupBy(F.col(group).alias("_group")).agg((F.min(name) - 1).alias("_skip"))
        placed = placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_skip"))
    return placed.select(*df.columns, name)


def merged_sources(df: DataFrame, key: str, source_rank: str, position: str) -> DataFrame:
    """First occurrence of each key by source priority and position."""
    return first_by(df, [key], [F.col(source_rank), F.col(position)])


def interleaved(df: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """Rows with their `turn` within the source and their `place` when sources take turns one by one, in the order of
    the sources. Of a place all that matters is how many rows each source has, so nothing is sorted over all rows."""
    rows = numbered(df, order, "turn", source)
    # one row a source: the few places that listings come from
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct(F.col(source).alias("source"), "n")).alias("counts"))
    before = F.aggregate("_counts", F.lit(0).cast("long"), lambda acc, s: acc + F.least(s["n"], F.col("turn") - 1))
    same = F.aggregate("_counts", F.lit(0).cast("long"), lambda acc, s: acc + ((s["source"] <= F.col(source)) & (s["n"] >= F.col("turn"))).cast("long"))
    return rows.withColumn("_counts", counts.scalar()).withColumn("place", before + same).drop("_counts")


def image_priority(watchlists: DataFrame, catalogue: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """Catalogue image, else the latest listing image, else that of the dearest listing.

    listings: key, image, price, seen; rows without an image are skipped.
    """
    shown = listings.filter(F.col("image").isNotNull())
    latest = first_by(shown, [key], [F.col("seen").desc_nulls_last(), F.col("image")]).select(key, F.col("image").alias("_latest"))
    dearest = first_by(shown, [key], [F.col("price").desc_nulls_last(), F.col("image")]).select(key, F.col("image").alias("_dear"))
    named = catalogue.select(key, F.col("image").alias("_own"))
    joined = watchlists.join(named, key, "left").join(latest, key, "left").join(dearest, key, "left")
    return joined.withColumn("image", F.coalesce("_own", "_latest", "_dear")).drop("_own", "_latest", "_dear")


def page(df: DataFrame, order: list[Column], number: int, size: int, largest: int = 50) -> DataFrame:
    """A page counted from 1, its size held between 1 and `largest`."""
    size = min(max(size, 1), largest)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def with_totals(df: DataFrame, size: int) -> DataFrame:
    """total and pages of the whole table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def capped(df: DataFrame, order: list[Column], n: int, pill: str) -> tuple[DataFrame, DataFrame]:
    """The first n rows, and counts by `pill` over all rows."""
    return df.orderBy(*order).limit(n), df.groupBy(pill).agg(F.count(F.lit(1)).alias("count"))


def within_budget(df: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows whose running cost in their group stays within the budget."""
    running = F.sum(cost).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return df.withColumn("spent", running).filter(F.col("spent") <= budget)


def ranked_candidates(df: DataFrame, key: str, arrival: str, score: str, used: str, considered: int = 3) -> DataFrame:
    """Rank among the first `considered` arrivals of each key: by score, then use, both falling, then arrival."""
    first = top_per_group(df, [key], [F.col(arrival)], considered).drop("rank")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(score).desc(), F.col(used).desc(), F.col(arrival))))


def two_stage_top(df: DataFrame, first: list[Column], cut: int, keep: Column, then: list[Column], n: int) -> DataFrame:
    """The cut comes before the filter: top `cut`, filtered, ordered anew, top n."""
    return df.orderBy(*first).limit(cut).filter(keep).orderBy(*then).limit(n)
