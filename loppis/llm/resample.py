"""Importance resampling towards a target distribution, by hashed word and word-pair features.

Words are those of `decontaminate.normal_words`. Features are all runs of 1 to `most` consecutive words joined by one space,
repeats counted; a feature's bucket is the crc32 of its UTF-8 bytes modulo `buckets`. Identical texts are collapsed by
grouping the full text: features and weight of a text are computed once, its counts are multiplied by its multiplicity, and
the weight is joined back to the documents before each gets noise of its own.

A null text has no words, as an empty one. A null id is larger than any other and its noise is that of the empty name; rows
that repeat an id are documents of their own with equal noise. An empty target has no features; empty documents give
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loppis.operators.ranking import numbered

from .common import stored, utf8
from .decontaminate import normal_words

#: Different words whose checksums a task remembers.
REMEMBERED = 1 << 18


class Tails(dict):
    """A word with a space before it, kept once made."""

    def __missing__(self, word: bytes) -> bytes:
        tail = self[word] = b" " + word
        return tail


class Buckets:
    """Buckets of a text's features. The checksum of a run of words is carried on from that of the run one word shorter."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets, self.tails = most, buckets, Tails()

    def of(self, words: list[bytes]) -> np.ndarray:
        """Runs of one word first, then of two, and so on."""
        if len(self.tails) > REMEMBERED:
            self.tails.clear()
        sums = list(map(crc32, words))
        tails = list(map(self.tails.__getitem__, words))
        out = list(sums)
        for _ in range(1, self.most):
            tails = tails[1:]
            # the sums of runs that end the text have no further word and fall away
            sums = list(map(crc32, tails, sums))
            out += sums
        return np.array(out, np.uint32) % np.uint32(self.buckets)


def featured(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(text_key, n_words, features, times) of (text, times) rows: features are the buckets as unsigned 16- or 32-bit
    integers, text_key the text's SHA-256."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Buckets(most, buckets)
        for b in batches:
            words = [normal_words(t) for t in utf8(b.column(1))]
            features = [found.of(w).astype(kind).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, words), pa.int64()), pa.array(features, pa.binary()), b.column(2)], names=["text_key", "n_words", "features", "times"]
            )

    named = texts.select(text_key(F.col("text")).alias("text_key"), "text", "times")
    return named.mapInArrow(run, "text_key binary, n_words long, features binary, times long")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, texts times their multiplicity; `buckets` rows reach the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for features, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts += times * np.bincount(np.frombuffer(features, kind), minlength=buckets)
        held = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("features", "times").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    all_s, all_t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(text_key, n_words, n_features, weight): the floored mean gain of each text's features, 0 without any."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features = [np.frombuffer(x, kind) for x in b.column(2).to_pylist()]
            weight = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in features]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, features), pa.int64()), pa.array(weight, pa.int64())], names=["text_key", "n_words", "n_features", "weight"])

    return rows.select("text_key", "n_words", "features").mapInArrow(run, "text_key binary, n_words long, n_features long, weight long")


def collapsed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, times) of each different text; null counts as empty."""
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("times"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of sha256(`seed:doc_id`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, most: int = 2, buckets: int = 10000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those that are not drawn.

    Of the documents with at least `least_words` words, floor(percent * N / 100) of the highest score are drawn, ties to
    the smaller id.
    """
    texts = stored(featured(collapsed(docs, text_col), most, buckets))
    aim = featured(collapsed(target, target_text_col), most, buckets)
    weights = weighted(texts, gains(bucket_counts(texts, buckets), bucket_counts(aim, buckets)))
    # only ids and keys move; a third of all documents may share one key, which the join splits
    ids = docs.select(F.col(id_col).alias("doc_id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    scored = ids.join(weights, "text_key").select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("fit"))
    scored = stored(scored)
    drawn = (scored.filter("fit").count() * percent) // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = numbered(scored.filter("fit"), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~F.col("fit")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
