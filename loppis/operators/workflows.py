"""Statuses in bulk, and what becomes of proposed groups and classes; single decisions are in `review`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .writes import update_where


def set_status(suggestions: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Reject, send back (pending) or approve in bulk."""
    mark = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return update_where(suggestions.join(mark, "id", "left"), F.col("_hit"), {"status": F.lit(status)}).drop("_hit")


def regroup(suggestions: DataFrame, groups: DataFrame, products: DataFrame) -> DataFrame:
    """Joins proposed groups back to suggestions; whoever was missed becomes a group of its own.

    groups: group_name, member. suggestions: id, canonical_name, listing_count. Members nobody suggested are dropped;
    one that several groups name belongs to the first of these by name.
    """
    member = groups.groupBy(F.col("member").alias("canonical_name")).agg(F.min("group_name").alias("group_name"))
    named = suggestions.join(member, "canonical_name", "left").withColumn("group_name", F.coalesce("group_name", "canonical_name"))
    grouped = named.groupBy("group_name").agg(F.sort_array(F.collect_list("id")).alias("members"), F.sum("listing_count").alias("listing_count"))
    known = products.select(F.lower("canonical_name").alias("_n")).distinct()
    return grouped.join(known, F.lower("group_name") == F.col("_n"), "left").withColumn("exists", F.col("_n").isNotNull()).drop("_n")


def known_only(assigned: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classifications of known slugs, and the products that got none."""
    good = assigned.join(products.select("slug"), "slug", "left_semi")
    return good, products.join(good.select("slug"), "slug", "left_anti")
