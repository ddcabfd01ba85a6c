"""Robust price statistics.

Two definitions of a quantile live side by side on purpose: observation statistics interpolate, the outlier fence
takes the nearest rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def _between(low: Column, high: Column, t: Column) -> Column:
    """low * (1 - t) + high * t for quarters t, rounded once as by a fused multiply and add: 0.75 * low goes in two exact halves."""
    x, y, h = F.when(t == 0.25, low * 0.5).otherwise(low * (1 - t)), F.when(t == 0.25, low * 0.25).otherwise(F.lit(0.0)), high * t
    p = x + y
    s = p + h
    # what the two sums lost; infinite and missing values lose nothing that counts
    lost = (y - (p - x)) + ((p - (s - h)) + (h - (s - (s - h))))
    return s + F.when(F.isnan(lost) | (F.abs(s) == float("inf")), 0.0).otherwise(lost)


def interpolated_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, p25, p50, p75 of each group by linear interpolation, rounded; nulls and a zero count for no values.

    The two values beside a rank are interpolated with one rounding, as halves are told apart afterwards. Equal values are
    counted before they are ranked.
    """
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count(value).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(W.partitionBy(*keys))})
    at = {q: (F.col("_n") - 1) * share for q, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    ends = [F.min(F.when(F.col("_upto") > edge(rank), F.col("_x"))).alias(f"_{side}_{q}") for q, rank in at.items() for side, edge in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *ends)
    return found.select(*keys, F.col("_n").alias("count"), *[round_half_up(_between(F.col(f"_low_{q}"), F.col(f"_high_{q}"), rank - F.floor(rank))).alias(q) for q, rank in at.items()])


def iqr_keep(df: DataFrame, keys: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles; groups of fewer than four rows pass whole.

    The quartiles are the values at 0-based ranks floor(n / 4) and floor(3n / 4). Rows without a value are dropped.
    """
    valued = df.filter(F.col(value).isNotNull())
    ranked = valued.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(value, *(order or [])))).withColumn(
        "_n", F.count(F.lit(1)).over(W.partitionBy(*keys))
    )
    group = W.partitionBy(*keys)

    def at(share: float) -> Column:
        return F.max(F.when(F.col("_r") == F.floor(F.col("_n") * share) + 1, F.col(value))).over(group)

    fenced = ranked.withColumn("_q1", at(0.25)).withColumn("_q3", at(0.75)).withColumn("_f", (F.col("_q3") - F.col("_q1")) * 1.5)
    inside = F.col(value).between(F.col("_q1") - F.col("_f"), F.col("_q3") + F.col("_f"))
    return fenced.filter((F.col("_n") < 4) | inside).drop("_r", "_n", "_q1", "_q3", "_f")


def market_range(df: DataFrame, keys: list[str], value: str, at_least: int = 3) -> DataFrame:
    """low, high and count of positive values, for groups with enough of them."""
    return (
        df.filter(F.col(value) > 0)
        .groupBy(*keys)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("count"))
        .filter(F.col("count") >= at_least)
    )


def robust_range(df: DataFrame, keys: list[str], value: str, at_least: int = 3) -> DataFrame:
    """Positive values, fenced, then low, high, rounded median and count of groups with enough left."""
    kept = iqr_keep(df.filter(F.col(value) > 0), keys, value)
    return (
        kept.groupBy(*keys)
        .agg(F.min(value).alias("low"), F.max(value).alias("high"), round_half_up(F.median(value)).alias("median"), F.count(value).alias("count"))
        .filter(F.col("count") >= at_least)
    )
