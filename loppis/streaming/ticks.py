"""Incremental runs: landed rows to upserts, snapshots, alerts, expiry, queue steps and rate limits.

Each streaming function has a batch twin or is the batch function itself under foreachBatch, so an `availableNow`
run over landed files gives the batch answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from loppis.operators.matching import cascade
from loppis.operators.writes import first_by, update_where, upsert
from loppis.sinks.keyed import KeyedTable, write_once


def within_cap(price: Column, cap: Column) -> Column:
    """Prices up to the cap; no price passes, a cap of null or 0 is none."""
    return cap.isNull() | (cap == 0) | price.isNull() | (price <= cap)


def tick(batch: DataFrame, listings: DataFrame, watchlists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listings, snapshots, alerts) after one micro-batch of scraped rows.

    batch: url, watchlist_id, title, price, scraped_at, and other columns of listings. Rows above the watchlist's cap are
    dropped, but for a watchlist of type "listing", which follows one page whatever its price. Every listing of a watchlist
    with rows in the batch that was never alerted is alerted now, also one that came before, and is marked at once, whatever
    becomes of the message.
    """
    kind = F.col("type") if "type" in watchlists.columns else F.lit("query")
    caps = watchlists.filter("active").select(F.col("id").alias("watchlist_id"), F.when(kind != "listing", F.col("max_price")).alias("max_price"))
    # a batch and the watchlists meet by hash; Spark broadcasts either side itself where it is small
    kept = batch.join(caps, "watchlist_id").filter(within_cap(F.col("price"), F.col("max_price"))).drop("max_price")
    grown = upsert(listings, kept, ["url", "watchlist_id"], [F.col("scraped_at").desc(), F.col("title")])
    noted = [x for x in ("url", "watchlist_id", "price", "currency", "title", "scraped_at") if x in kept.columns]
    ticked = kept.groupBy("watchlist_id").agg(F.max("scraped_at").alias("_now"))
    joined = grown.join(ticked, "watchlist_id", "left")
    alerts = joined.filter("_now IS NOT NULL AND notified_at IS NULL").select(*grown.columns)
    marked = update_where(joined, F.col("_now").isNotNull() & F.col("notified_at").isNull(), {"notified_at": F.col("_now")}).select(*grown.columns)
    return marked, kept.select(*noted), alerts


def keep_tick(batch: DataFrame, at: int, listings: KeyedTable, watchlists: DataFrame, folder: str) -> None:
    """One tick over a table on disk that is dealt by watchlist: only the buckets of the batch's watchlists are read and
    written. Snapshots and alerts of tick `at` go to folders of their own before the listings are marked, so a tick that
    is run again after a failure tells of each listing once."""
    marked, snapshots, alerts = tick(batch, listings.around(batch), watchlists)
    write_once(snapshots, f"{folder}/snapshots/tick={at}")
    write_once(alerts, f"{folder}/alerts/tick={at}")
    listings.rewrite(marked)


def watch(batch: DataFrame, listings: DataFrame, watchlists: DataFrame, matches: DataFrame, identifiers: DataFrame, synonyms: DataFrame, models: DataFrame) -> dict[str, DataFrame]:
    """listings, snapshots, matches, alerts and digests after one whole tick.

    The tick's own listings are matched to products, those that have a match are left alone. digests has a row for each user
    and watchlist with something new: n_new, and the first five titles, then how many more there are.
    """
    grown, snapshots, alerts = tick(batch, listings, watchlists)
    own = grown.join(snapshots.select("url", "watchlist_id").distinct(), ["url", "watchlist_id"], "left_semi")
    new = match_unmatched(own.select(F.col("id").alias("listing_id"), "title"), matches, identifiers, synonyms, models)
    place = F.row_number().over(W.partitionBy("watchlist_id").orderBy("title", "url"))
    numbered = alerts.withColumn("_place", place).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("watchlist_id")))
    # five titles at most are gathered, however many are new
    told = numbered.filter("_place <= 5").groupBy("watchlist_id").agg(F.max("_n").alias("n_new"), F.array_sort(F.collect_list(F.struct("_place", "title"))).alias("_t"))
    more = F.when(F.col("n_new") > 5, F.concat(F.lit("…and "), (F.col("n_new") - 5).cast("string"), F.lit(" more")))
    lines = F.concat_ws("\n", F.transform("_t.title", lambda t: F.coalesce(t, F.lit(""))), more)
    users = watchlists.select(F.col("id").alias("watchlist_id"), "user_id", "query")
    digests = told.join(users, "watchlist_id").select("user_id", "watchlist_id", "query", "n_new", lines.alias("digest"))
    return {"listings": grown, "snapshots": snapshots, "matches": matches.unionByName(new, allowMissingColumns=True), "alerts": alerts, "digests": digests}


def match_unmatched(batch: DataFrame, matches: DataFrame, identifiers: DataFrame, synonyms: DataFrame, models: DataFrame) -> DataFrame:
    """New rows for the table of matches after one micro-batch of listings (listing_id, title): those that have a match
    already are left alone."""
    new = batch.dropDuplicates(["listing_id"]).join(matches.select("listing_id").distinct(), "listing_id", "left_anti")
    return cascade(new, identifiers, synonyms, models)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `work` on every micro-batch that has landed, then stops."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notify_once(stream: DataFrame, keys: list[str], time: str, horizon: str) -> DataFrame:
    """First row of each key, with state kept for the horizon; the same key within it is never alerted again."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def notify_once_batch(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_by(rows, keys, order)


def expire(listings: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Listings not seen for `hours` become inactive."""
    return update_where(listings, F.col("scraped_at") < now - F.make_dt_interval(F.lit(0), F.lit(hours)), {"is_active": F.lit(False)})


def last_seen(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Running last observation of each key, for expiry in update or complete mode."""
    return stream.withWatermark(time, lateness).groupBy(key).agg(F.max(time).alias("last_seen"))


def refresh_selection(products: DataFrame, now: Column, days: int = 14, most: int = 200) -> DataFrame:
    """Products never refreshed or not for `days`, oldest first."""
    due = F.col("refreshed_at").isNull() | (F.col("refreshed_at") < now - F.make_dt_interval(F.lit(days)))
    return products.filter(due).orderBy(F.col("refreshed_at").asc_nulls_first(), "id").limit(most)


def enqueue(saved: DataFrame, sold: DataFrame, enough: int = 5) -> DataFrame:
    """Pending jobs for saved products with fewer than `enough` sold rows."""
    n = sold.groupBy("product_slug").agg(F.count(F.lit(1)).alias("n"))
    return saved.select("product_slug").distinct().join(n, "product_slug", "left").filter(F.coalesce("n", F.lit(0)) < enough).select("product_slug", F.lit("pending").alias("status"))


def take_jobs(queue: DataFrame, most: int = 10) -> DataFrame:
    """The queue with its oldest pending jobs marked as processing."""
    chosen = queue.filter("status = 'pending'").orderBy("created_at", "product_slug").limit(most).select("product_slug", F.lit(True).alias("_go"))
    return update_where(queue.join(F.broadcast(chosen), "product_slug", "left"), F.col("_go") & (F.col("status") == "pending"), {"status": F.lit("processing")}).select(*queue.columns)


def finish_jobs(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Processing jobs become done or failed; results: product_slug, ok."""
    j = queue.join(results.select("product_slug", "ok"), "product_slug", "left")
    over = (F.col("status") == "processing") & F.col("ok").isNotNull()
    return update_where(j, over, {"processed_at": now, "status": F.when(F.col("ok"), "done").otherwise("failed")}).select(*queue.columns)


def rate_limited(times: Column, window_seconds: float = 60.0, most: int = 20) -> Column:
    """Whether each of the sorted times of one client is allowed: at most `most` in a window that its first request
    opens and that starts anew after it has run out. A fold over the client's requests."""
    start = F.struct(F.lit(-1e18).alias("ends"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        fresh = t > acc["ends"]
        allowed = fresh | (acc["n"] < most)
        return F.struct(
            F.when(fresh, t + window_seconds).otherwise(acc["ends"]).alias("ends"),
            F.when(fresh, 1).otherwise(acc["n"] + allowed.cast("int")).alias("n"),
            F.concat(acc["ok"], F.array(allowed)).alias("ok"),
        )

    return F.aggregate(times, start, step)["ok"]


def limited(requests: DataFrame, client: str, seconds: str, window: float = 60.0, most: int = 20) -> DataFrame:
    """(client, requests, allowed) by the same rule over a table, however many requests a client has; requests without
    a time are left out.

    A pause longer than the window closes any open one, so what lies between two such pauses stands alone. Pauses are
    found between slices of the window's length, a row each. Sessions are dealt over tasks, sorted, and read in batches
    that pass the open window on; only a client that never pauses has all its requests in one task, never in one row.
    """
    rows = requests.filter(F.col(seconds).isNotNull()).select(client, seconds, F.floor(F.col(seconds) / window).alias("_slice"))
    edges = rows.groupBy(F.col(client).alias("_client"), F.col("_slice").alias("_part")).agg(F.min(seconds).alias("_first"), F.max(seconds).alias("_last"))
    by = W.partitionBy("_client").orderBy("_part")
    edges = edges.withColumn("_new", (F.col("_first") > F.lag("_last").over(by) + window).cast("long"))
    session = F.sum(F.coalesce("_new", F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    sessions = edges.select("_client", "_part", session.cast("string").alias("_session"))
    joined = rows.join(sessions, F.col(client).eqNullSafe(F.col("_client")) & (F.col("_slice") == F.col("_part")))
    key = F.concat("_session", F.lit(" "), F.coalesce(F.concat(F.lit("="), F.col(client).cast("string")), F.lit("")))
    dealt = joined.select(client, F.col(seconds).cast("double").alias("_t"), key.alias("_key")).repartition("_key").sortWithinPartitions("_key", "_t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, ends, n = None, float("-inf"), 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys, t = pdf["_key"].to_numpy(), pdf["_t"].to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            stops = np.r_[starts[1:], len(t)]
            allowed = []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if keys[a] != open_key:
                    open_key, ends, n = keys[a], float("-inf"), 0
                i, ok = a, 0
                while i < b:  # one step a window
                    if t[i] > ends:
                        ends, n = t[i] + window, 0
                    j = i + int(np.searchsorted(t[i:b], ends, side="right"))
                    taken = min(most - n, j - i)
                    i, n, ok = j, n + taken, ok + taken
                allowed.append(ok)
            yield pd.DataFrame({client: pdf[client].iloc[starts].array, "requests": stops - starts, "allowed": allowed})

    type_ = requests.schema[client].dataType.simpleString()
    some = dealt.mapInPandas(run, f"`{client}` {type_}, requests long, allowed long")
    return some.groupBy(client).agg(F.sum("requests").alias("requests"), F.sum("allowed").alias("allowed"))


LIMITED = "client string, requests long, allowed long"


class RateLimiter(StatefulProcessor):
    """The same rule over a stream, with the open window of each client as state."""

    WINDOW, MOST = 60.0, 20

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", StructType([StructField("ends", DoubleType()), StructField("n", IntegerType())]))

    def handleInputRows(self, key, rows, timerValues):
        ends, n = self.open.get() if self.open.exists() else (float("-inf"), 0)
        total = allowed = 0
        times = sorted(t for pdf in rows for t in pdf["seconds"].tolist())
        for t in times:
            total += 1
            if t > ends:
                ends, n, allowed = t + self.WINDOW, 1, allowed + 1
            elif n < self.MOST:
                n, allowed = n + 1, allowed + 1
        self.open.update((ends, n))
        yield pd.DataFrame({"client": [str(key[0])], "requests": [total], "allowed": [allowed]})

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, client: str) -> DataFrame:
    """Requests and allowed requests of each client and micro-batch; needs the RocksDB state store."""
    return stream.groupBy(client).transformWithStateInPandas(statefulProcessor=RateLimiter(), outputStructType=LIMITED, outputMode="Append", timeMode="None")
