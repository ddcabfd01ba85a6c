"""Writes that really happen: tables created on disk, changed in place in several steps, and read back. The SQL states what
the table then holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loppis.session import shared_folder, table
from loppis.sinks.keyed import KeyedTable
from loppis.streaming import ticks

from .base import Book
from .composites import _NUL, _OLD, null_keys, old_new
from .landed import _TICK, graph, listings_table, scraped, watchlists

book = Book()
q = book.query
c = F.col

#: Buckets of the tables here; a large table has as many as make buckets of a few files each.
BUCKETS = 8


def kept(rows, keys, nulls_distinct=True):
    """A new table on disk that holds the rows."""
    t = KeyedTable.create(rows.sparkSession, f"{shared_folder(rows.sparkSession)}/kept", rows.schema, keys, buckets=BUCKETS, nulls_distinct=nulls_distinct)
    t.append(rows)
    return t


@q(_OLD + " SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice, o_orderpriority FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def k01_stored_upsert(spark, sf):
    """Orders upserted in two steps, the second of which is run twice, as after a failure."""
    old, new = old_new(spark, sf)
    t = kept(old, ["o_orderkey"])
    for step in (0, 1, 1):
        t.upsert(new.filter(c("o_custkey") % 2 == step), [c("o_totalprice").desc()])
    return t.read()


@q(_OLD + " SELECT * FROM a UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, NULL FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def k02_stored_ignore(spark, sf):
    """New orders added twice; only the first time adds any."""
    old, new = old_new(spark, sf)
    t = kept(old, ["o_orderkey"])
    for _ in range(2):
        t.insert_ignore(new, [c("o_totalprice")])
    return t.read()


@q(_NUL + " SELECT user_id, event_type, min(event_id) AS event_id FROM k GROUP BY 1, 2")
def k02_stored_nulls(spark, sf):
    """Events by user and type where a null user is a user; the second half finds the first half's keys."""
    rows = null_keys(spark, sf)
    t = KeyedTable.create(spark, f"{shared_folder(spark)}/kept", rows.schema, ["user_id", "event_type"], buckets=BUCKETS, nulls_distinct=False)
    middle = rows.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0] or 0
    for half in (c("event_id") <= middle, c("event_id") > middle):
        t.insert_ignore(rows.filter(half), [c("event_id")])
    return t.read()


@q("SELECT event_id AS id, user_id AS listing, value AS price, ts AS scraped_at FROM events UNION ALL SELECT event_id, user_id, value + 1, ts FROM events")
def k03_stored_snapshots(spark, sf):
    """Snapshots of two ticks, appended."""
    rows = table(spark, sf, "events").select(c("event_id").alias("id"), c("user_id").alias("listing"), c("value").alias("price"), c("ts").alias("scraped_at"))
    t = kept(rows, ["id"])
    t.append(rows.withColumn("price", c("price") + 1))
    return t.read()


@q("SELECT 'p' || p_partkey AS slug, 'MODEL' AS type, 'M' || p_partkey AS value FROM part UNION ALL SELECT 'p' || p_partkey, 'SKU', 'S' || p_partkey FROM part WHERE p_partkey % 2 = 0")
def k04_stored_replace(spark, sf):
    """Identifiers of an older graph give way to all of the new one's."""
    new = graph(spark, sf)["identifiers"]
    t = kept(new.withColumn("value", F.lit("old")), ["slug", "type"])
    t.replace_all(new)
    return t.read()


@q("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders")
def k05_stored_update(spark, sf):
    t = kept(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderkey"])
    t.update_where(F.expr("o_orderdate < TIMESTAMP_NTZ '1997-01-01'"), {"o_orderstatus": F.lit("X")})
    return t.read()


@q("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def k06_stored_delete(spark, sf):
    t = kept(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    t.delete(table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(c("o_custkey").alias("c_custkey")))
    return t.read()


TICKS = 4
_TICKS = (
    _TICK
    + f""", e AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
t AS (SELECT k.*, {TICKS} * (epoch_us(ts) - lo) // (hi - lo + 1) AS tick FROM k, e WHERE ts IS NOT NULL),
n AS (SELECT watchlist_id, tick, max(ts) AS now FROM t GROUP BY 1, 2),
f AS (SELECT watchlist_id, url, min(tick) AS tick FROM t GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY watchlist_id, url ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS rn FROM t)"""
)


@q(_TICKS + " SELECT l.watchlist_id, l.url, CAST(l.event_id AS VARCHAR) AS title, l.price, l.ts AS scraped_at, n.now AS notified_at FROM l JOIN f USING (watchlist_id, url) JOIN n ON n.watchlist_id = f.watchlist_id AND n.tick = f.tick WHERE rn = 1")
def st02_kept_listings(spark, sf):
    """Listings on disk after four ticks in the order of time, each of which writes only the buckets of its watchlists."""
    folder, lists = shared_folder(spark), watchlists(spark, sf)
    t = listings_table(spark, f"{folder}/listings")
    events = table(spark, sf, "events")
    micros = F.unix_micros(c("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    for at in range(TICKS if low is not None else 0):
        batch = events.filter(F.expr(f"({TICKS} * (unix_micros(cast(ts as timestamp)) - {low})) div {high - low + 1} = {at}"))
        ticks.keep_tick(scraped(batch), at, t, lists, folder)
    return t.read()


@q("""WITH d AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY doc_id ORDER BY lang NULLS LAST, source NULLS LAST, n_chars NULLS LAST) AS rn FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY doc_id ORDER BY quality NULLS LAST, toxic NULLS LAST) AS rn FROM labels WHERE doc_id IS NOT NULL)
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, source, n_chars, quality, toxic FROM (SELECT * FROM d WHERE rn = 1) d FULL JOIN (SELECT * FROM l WHERE rn = 1) l ON d.doc_id = l.doc_id WHERE toxic IS DISTINCT FROM 1""")
def k01_stored_documents(spark, sf):
    """A register of documents on disk: inserted once each, labels upserted by themselves, toxic ones deleted."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").filter("doc_id IS NOT NULL")
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic").filter("doc_id IS NOT NULL")
    schema = docs.join(labels.limit(0), "doc_id", "left").schema
    t = KeyedTable.create(spark, f"{shared_folder(spark)}/kept", schema, ["doc_id"], buckets=BUCKETS)
    t.insert_ignore(docs, [c(n).asc_nulls_last() for n in ("lang", "source", "n_chars")])
    t.upsert(labels, [c(n).asc_nulls_last() for n in ("quality", "toxic")])
    t.delete(t.read().filter("toxic = 1"))
    return t.read()
