"""Ranked lexical search, score-at-a-time over an impact-ordered index.

Terms are the words of `decontaminate.normal_words`. A posting's impact is its whole contribution to a score,
w * ((10^9 tf) div (1000 tf + 20 m)), an integer. Documents make shards of a bounded number of postings, each with an index
of its own: a term's postings by falling impact, equal impacts in one group. An item takes the groups of all its terms
in falling order of impact, a level at a time, into accumulators. When the terms' next impacts together can no longer lift
a document that is not among the candidates to the k-th score, the shard's best are proven to be among the candidates, whose
scores are then completed from the documents' own postings. The best of all shards are ranked once more.

Items come in parts of bounded bytes, each part a pass over the documents. A first pass over a share of the documents
gives each item a score that k documents reach; it only prunes, so results don't depend on it.

Nulls and texts without a term are in no ranking and count in no statistic. Rows that repeat an id or a text are documents
of their own; a null id is larger than any other. An item without terms, or whose terms no document holds, has no rows;
items that repeat an id each give theirs. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, utf8
from .decontaminate import _parts, normal_words

#: Postings of one shard, and its documents.
SHARD_POSTINGS, SHARD_DOCS = 2 << 20, 1 << 16
#: Each level of impacts ends at this share of the highest impact left.
STEP = 0.6
#: Documents that set the first floor of each item.
PROBE = 1 << 14


class Items:
    """Different terms of each item as numbers, and the terms' numbers."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.terms = [np.array(sorted({self.number.setdefault(w, len(self.number)) for w in normal_words(t)}), np.int64) for _, t in items]


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def counted(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: n counts all terms, the others only the items'."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            at, n, terms, tfs = [], [], [], []
            for i, text in enumerate(utf8(b.column(1))):
                words = normal_words(text)
                if words:
                    tf = Counter(words)
                    both = [(known[w], c) for w, c in tf.items() if w in known]
                    at.append(i)
                    n.append(len(words))
                    t = np.array(both, np.uint32).reshape(-1, 2)
                    terms.append(t[:, 0].tobytes())
                    tfs.append(t[:, 1].tobytes())
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequency(rows: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each of the items' terms; at most `terms` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), minlength=terms)
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Shard:
    """Postings of some documents by document, and by term in falling order of impact."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, w: np.ndarray):
        self.ids, self.starts, self.terms = ids, starts, terms
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
        tf = tfs.astype(np.int64)
        self.impact = w[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
        order = np.lexsort((-self.impact, terms))
        self.docs, self.rising = docs[order], -self.impact[order]
        self.lists = np.searchsorted(terms[order], np.arange(len(w) + 1))

    def best(self, wanted: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) and scores of the k best of at least the floor, ties by id."""
        at, end = self.lists[wanted].copy(), self.lists[wanted + 1]
        held = np.zeros(len(self.ids), np.int64)
        while True:
            live = at < end
            heads = np.where(live, -self.rising[np.minimum(at, len(self.rising) - 1)], 0) if live.any() else np.zeros(len(at), np.int64)
            rest = int(heads.sum())
            top = int(held.max(initial=0))
            if rest < max(floor, 1) or rest < top:  # only then can the bound prove anything
                if len(held) >= k:
                    floor = max(floor, int(np.partition(held, -k)[-k]))
                if rest < max(floor, 1):
                    break
            level = max(int(heads.max() * STEP), 1)
            docs, impacts = [], []
            for i in np.nonzero(heads >= level)[0]:
                # the run of impacts at or above the level; groups of one impact are never cut
                to = at[i] + int(np.searchsorted(self.rising[at[i] : end[i]], -level, "right"))
                docs.append(self.docs[at[i] : to])
                impacts.append(self.rising[at[i] : to])
                at[i] = to
            np.subtract.at(held, np.concatenate(docs), np.concatenate(impacts))
        candidates = np.nonzero((held > 0) & (held + rest >= max(floor, 1)))[0]
        if rest:
            held = self.complete(candidates, wanted)
        else:
            held = held[candidates]
        order = np.lexsort((self.ids[candidates], -held))[:k]
        order = order[held[order] >= max(floor, 1)]
        return candidates[order], held[order]

    def complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of some documents from their own postings."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        own = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[docs], sizes)
        counts = np.where(np.isin(self.terms[own], wanted), self.impact[own], 0)
        sums = np.concatenate(([0], np.cumsum(counts)))
        return sums[ends] - sums[ends - sizes]


#: Stands for a null id, which is larger than any other.
NO_ID = np.iinfo(np.int64).max


def scored(rows: DataFrame, items: Items, w: np.ndarray, n: int, length: int, k: int, floors: list[int]) -> DataFrame:
    """(item, doc_id, score): for each item the best of every shard that reach its floor; `item` is the item's number."""
    sent = rows.sparkSession.sparkContext.broadcast((items.terms, w, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, least = sent.value
        held: list[tuple] = []

        def ranked() -> pa.RecordBatch:
            ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            sizes = np.concatenate([h[2] for h in held])
            terms, tfs = (np.concatenate([h[i] for h in held]) for i in (3, 4))
            shard = Shard(ids, 50 + 50 * lengths * n // length, np.concatenate(([0], np.cumsum(sizes))), terms, tfs, weight)
            item, doc, score = [], [], []
            for i, t in enumerate(wanted):
                found, scores = shard.best(t, k, least[i])
                item.append(np.full(len(found), i, np.int32))
                doc.append(ids[found])
                score.append(scores)
            docs = np.concatenate(doc)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(item)), pa.array(docs, mask=docs == NO_ID), pa.array(np.concatenate(score))], names=["item", "doc_id", "score"])

        postings = docs = 0
        for b in batches:
            if not b.num_rows:
                continue
            terms = b.column(2).to_pylist()
            sizes = np.fromiter((len(t) // 4 for t in terms), np.int64, len(terms))
            for s, e in _cuts(sizes, SHARD_POSTINGS, SHARD_DOCS):
                size = int(sizes[s:e].sum())
                if held and (postings + size > SHARD_POSTINGS or docs + e - s > SHARD_DOCS):
                    yield ranked()
                    postings = docs = 0
                ids = b.column(0).slice(s, e - s).fill_null(int(NO_ID)).to_numpy()
                flat = [np.frombuffer(b"".join(x[s:e]), "<u4") for x in (terms, b.column(3).to_pylist())]
                held.append((ids, b.column(1).slice(s, e - s).to_numpy(), sizes[s:e], *flat))
                postings, docs = postings + size, docs + e - s
        if held:
            yield ranked()

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def _cuts(sizes: np.ndarray, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of at most so many postings and rows; a row beyond the bound is a run of its own."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield at, to
        at = to


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank(docs: DataFrame, benchmark: DataFrame, k: int = 50, max_bytes: int = 16 << 20, probe: int = PROBE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item."""
    spark = docs.sparkSession
    id_type = benchmark.select(item_col).schema[0].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    parts, part = _parts(benchmark, max_bytes, item_col, item_text_col)
    out = []
    for p in range(parts):
        items = Items(part(p))
        if not items.number:
            continue
        rows = stored(counted(docs, items.number, id_col, text_col))
        n, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            continue
        w = weights(document_frequency(rows, len(items.number)), n)
        # a share of the documents: k of them reach these scores, so no ranking can end below
        share = rows.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(max(1, n // probe))) == 0)
        reached = _ranked(scored(share, items, w, n, length, k, [0] * len(items.ids)), k).filter(F.col("rank") == k).select("item", "score")
        floors = [0] * len(items.ids)
        for r in reached.collect():  # at most one row an item of the part
            floors[r.item] = r.score
        best = _ranked(scored(rows, items, w, n, length, k, floors), k)
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {id_type}")
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0] if out else empty
