"""Keyed tables on disk against the same changes made in memory, and what a change leaves alone."""

import random
import tempfile
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from loppis.plans.landed import landed, listings_table, ran
from loppis.sinks.keyed import BUCKET, KeyedTable, write_once
from loppis.streaming import ticks

SCHEMA = StructType().add("a", LongType()).add("b", StringType()).add("v", DoubleType()).add("note", StringType())


def made(spark, rows=(), nulls_distinct=True, deal=None, buckets=8):
    t = KeyedTable.create(spark, tempfile.mkdtemp(prefix="loppis-kept-") + "/t", SCHEMA, ["a", "b"], deal, buckets, nulls_distinct)
    if rows:
        t.append(spark.createDataFrame(list(rows), SCHEMA))
    return t


def found(t):
    return sorted(map(tuple, KeyedTable.open(t.spark, t.path).read().collect()), key=repr)


def files(t):
    return {f for f in Path(t.path).rglob("*.parquet")}


def rows_of(seed, n, nulls=0.0):
    r = random.Random(seed)
    return [(None if r.random() < nulls else r.randrange(30), r.choice("xyz"), float(r.randrange(100)), r.choice(["p", None])) for _ in range(n)]


def first(rows):
    """The row of each key with the largest v, then the note, nulls last."""
    out = {}
    for x in sorted(rows, key=lambda x: (-x[2], x[3] is None, x[3] or "")):
        out.setdefault(x[:2], x)
    return out


def order():
    return [F.col("v").desc(), F.col("note").asc_nulls_last()]


@pytest.mark.parametrize("deal", [None, ["a"]])
def test_changes_equal_those_in_memory(spark, deal):
    want = first(rows_of(1, 60))
    t = made(spark, want.values(), deal=deal)
    new = rows_of(2, 80)
    t.upsert(spark.createDataFrame(new, SCHEMA), order())
    want |= first(new)
    assert found(t) == sorted(want.values(), key=repr)
    more = rows_of(3, 80)
    t.insert_ignore(spark.createDataFrame(more, SCHEMA), order())
    want = first(more) | want
    assert found(t) == sorted(want.values(), key=repr)
    gone = {k for k in want if k[0] % 3 == 0} | {(999, "x")}
    t.delete(spark.createDataFrame([*gone, (None, "x")], "a int, b string"))
    want = {k: x for k, x in want.items() if k not in gone}
    assert found(t) == sorted(want.values(), key=repr)
    t.update_where(F.col("v") > 50, {"note": F.lit("dear")})
    want = {k: (*x[:3], "dear") if x[2] > 50 else x for k, x in want.items()}
    assert found(t) == sorted(want.values(), key=repr)


def test_supplied_columns_only_and_other_types(spark):
    t = made(spark, [(1, "x", 5.0, "old"), (2, "x", 6.0, "old")])
    t.upsert(spark.createDataFrame([(1, "x", 9), (3, "x", 7)], "a int, b string, v int"), order()[:1])
    assert found(t) == [(1, "x", 9.0, "old"), (2, "x", 6.0, "old"), (3, "x", 7.0, None)]
    t.upsert(spark.createDataFrame([("x", 1, None)], "b string, a long, note string"), order()[1:])
    assert found(t)[0] == (1, "x", 9.0, None)


@pytest.mark.parametrize("change", ["insert_ignore", "upsert"])
def test_nulls_in_keys(spark, change):
    rows = [(None, "x", 1.0, "p"), (None, "x", 2.0, "q"), (1, None, 3.0, "r")]
    apart, equal = made(spark), made(spark, nulls_distinct=False)
    for t in (apart, equal):
        for _ in range(2):
            getattr(t, change)(spark.createDataFrame(rows, SCHEMA), order())
    assert len(found(apart)) == 6
    assert found(equal) == sorted([rows[1], rows[2]], key=repr)
    many = made(spark)
    many.append(spark.createDataFrame([(None, "x", float(i), "p") for i in range(200)], SCHEMA))
    assert many._rows().select(BUCKET).distinct().count() == 8  # a hot null is spread over the buckets


def test_a_change_leaves_other_buckets_alone(spark):
    t = made(spark, [(i, "x", 1.0, None) for i in range(200)], buckets=16)
    before = files(t)
    t.upsert(spark.createDataFrame([(7, "x", 2.0, None)], SCHEMA), order())
    kept = before & files(t)
    assert len({f.parent for f in before}) - len({f.parent for f in kept}) == 1
    before = files(t)
    t.insert_ignore(spark.createDataFrame([(7, "x", 3.0, None), (777, "x", 1.0, None)], SCHEMA), order())
    assert before < files(t) and t.read().count() == 201  # nothing is rewritten
    plan = t.around(spark.createDataFrame([(7, "x")], "a long, b string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_repeats_empty_buckets_and_empty_changes(spark):
    rows = list(first(rows_of(5, 60)).values())
    t = made(spark, rows)
    none = spark.createDataFrame([], SCHEMA)
    for change in (t.upsert, t.insert_ignore):
        change(none, order())
        change(spark.createDataFrame(rows, SCHEMA), order())
    t.delete(none)
    t.update_where(F.lit(None).cast("boolean"), {"v": F.lit(0)})
    t.append(none)
    assert found(t) == sorted(rows, key=repr)
    t.delete(t.read())
    assert found(t) == []
    t.delete(spark.createDataFrame(rows, SCHEMA))
    t.upsert(spark.createDataFrame(rows, SCHEMA), order())
    assert found(t) == sorted(rows, key=repr)
    t.replace_all(t.read().filter("a < 5"))
    assert found(t) == sorted([x for x in rows if x[0] < 5], key=repr)
    t.replace_all(none)
    assert found(t) == [] and found(made(spark)) == []


def test_a_hot_value_of_the_dealt_column(spark):
    """A third of all rows in one bucket, whose rows go to several files where the shuffle is large enough."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t = made(spark, deal=["a"])
        hot = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("a"), F.col("id").cast("string").alias("b"), F.rand(1).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("note"))
        t.append(hot.repartition(8))
        assert t.read().count() == 60_000 and len({f.parent for f in files(t)}) == 8
        most = max(sum(f.parent.name == d for f in files(t)) for d in {f.parent.name for f in files(t)})
        assert most > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_what_is_refused(spark):
    t = made(spark)
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(1, "x", 2)], "a long, b string, other int"), order())
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(1,)], "a long"))
    with pytest.raises(ValueError):
        t.update_where(F.lit(True), {"a": F.lit(1)})
    with pytest.raises(ValueError):
        KeyedTable.create(spark, t.path + "2", SCHEMA, ["a"], ["b"])


def test_a_tick_run_again_tells_each_listing_once(spark):
    """Death after the alerts, or after the listings: the tick's second run leaves the same alerts and listings."""
    folder = tempfile.mkdtemp(prefix="loppis-tick-")
    lists = spark.createDataFrame([("w", True, None), ("v", True, 5.0), ("off", False, None)], "id string, active boolean, max_price double")
    when = F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")
    batches = [[("u1", "w", "a", 1.0), ("u2", "w", "b", 2.0), ("u3", "v", "c", 9.0), ("u4", "off", "d", 1.0)], [("u1", "w", "a2", 3.0), ("u5", "v", "e", 4.0)]]
    once, twice = (listings_table(spark, f"{folder}/{n}/listings") for n in ("once", "twice"))
    for at, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "url string, watchlist_id string, title string, price double").withColumn("scraped_at", when)
        ticks.keep_tick(batch, at, once, lists, f"{folder}/once")
        _, _, alerts = ticks.tick(batch, twice.around(batch), lists)
        write_once(alerts, f"{folder}/twice/alerts/tick={at}")
        for _ in range(2):
            ticks.keep_tick(batch, at, twice, lists, f"{folder}/twice")
    for t, n in ((once, "once"), (twice, "twice")):
        told = spark.read.parquet(f"{folder}/{n}/alerts")
        assert sorted((r.tick, r.url) for r in told.collect()) == [(0, "u1"), (0, "u2"), (1, "u5")]
        assert sorted((r.url, r.title, r.notified_at is not None) for r in t.read().collect()) == [("u1", "a2", True), ("u2", "b", True), ("u5", "e", True)]


def test_landed_files_of_a_folder(spark):
    """A table is one file or a folder of files; both are streams of all rows."""
    sf = tempfile.mkdtemp(prefix="loppis-landed-")
    spark.range(10).repartition(3).write.parquet(f"{sf}/many.parquet")
    pd.DataFrame({"id": range(4)}).to_parquet(f"{sf}/one.parquet")
    for name, n in (("many", 10), ("one", 4)):
        ran(landed(spark, sf, name), f"{sf}/run-{name}", lambda batch, at, name=name: batch.write.mode("append").parquet(f"{sf}/out-{name}"))
        assert spark.read.parquet(f"{sf}/out-{name}").count() == n
