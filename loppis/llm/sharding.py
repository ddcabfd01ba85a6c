"""Stable sharding by jump consistent hashing, in DataFrame functions only.

The shard of a key depends on nothing but the key and the number of shards: the key's pseudo-random jumps
(Lamping and Veach, 2014) are followed until they pass the last shard. With one more shard a key either stays or
moves into the new shard.

Nulls: a null key is one more key value; a null text has no bytes. An empty table gives an empty result. Repeated
rows each get a slot of their own. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key among 0 to shards - 1.

    The i-th draw is a 31-bit hash of the key and i, a generator seeded by the key. Each jump goes at least one
    shard forward, so `shards` draws are enough.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    # the first jump always lands on shard 0; each later one starts from the shard it left
    def jump(acc: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1
        ahead = F.floor((acc["next"] + 1) * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(acc["next"] >= shards, acc).otherwise(F.struct(acc["next"].alias("at"), ahead.alias("next")))

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)["at"].cast("int")


def shard(docs: DataFrame, shards: int = 24, cells: int = 1024, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots count from 0 without gaps in each shard, by cell and then key. A shard is counted in `cells` cells, so no
    task orders a whole shard: rows are numbered within their cell, and the cell's offset is added. Only ids and
    checksums are shuffled, never texts. The table of cell offsets has at most shards * cells rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(key_col)
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    ).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("cell")), F.lit(cells)).cast("int"))
    counted = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # at most shards * cells rows of three numbers: a proven bound
    bounded = F.broadcast(offsets) if shards * cells <= 1 << 20 else offsets
    place = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("place", place)
        .join(bounded, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).alias("slot"), "grown_shard")
    )
