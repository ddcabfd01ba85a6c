"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line contracts: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Java and Python pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text bytes of a document bucket, at which it stays a small part of a task's memory.
BUCKET_BYTES = 8 << 20


def groups(docs: DataFrame, text_col: str = "text", n: int | None = None) -> int:
    """Number of document buckets and of key shards: the texts' bytes over the bytes of a bucket, whatever the input's
    size or the session's partitions. Buckets send shards only what they hold, so rows between them stay fewer than
    the keys."""
    if n is None:
        total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
        n = max(8, -(-total // BUCKET_BYTES))
    return n


def ensure_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the shared one the cluster names; a folder of its own only on a local master."""
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    if here.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="loppis-checkpoints-")
        sc.setCheckpointDir(named)
        here = sc._jsc.sc().getCheckpointDir()
        _gone_at_end(spark, here.get())
    return here.get()


def _gone_at_end(spark: SparkSession, folder: str) -> None:
    """The session's end removes the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """stored() and the table's folder, for removed()."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoints(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder, compression="zstd")
    _gone_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a compressed table beside the checkpoints, of which later steps read single columns. The
    planner sees the table's own size, not an estimate over all that went before."""
    return stored_at(df)[0]


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a stored table that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = ()) -> DataFrame:
    """(bucket, doc_id, text, carried): documents dealt to n buckets by a hash of id and text, copies under other ids
    apart."""
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("bucket"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def runs(texts: pa.Array, most_chars: int) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of texts of up to so many code points; a longer text makes a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, before + most_chars, "right")))
        yield at, to - at
        at, before = to, int(ends[to - 1])


class WordHash(dict):
    """64-bit hash of each word, computed once for the lifetime of the table (a bucket)."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: An odd multiplier: invertible modulo 2^64, so a window's hash follows from two prefix sums.
BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 15), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every window of `width` consecutive word hashes."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    words = mix(words + np.uint64(seed)) if seed else words
    up, down = _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def pack32(values: np.ndarray) -> bytes:
    """Sorted 32-bit values byte plane by byte plane: the high planes of sorted values compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack32(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def inside(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the ordered ones; costs a binary search a value, not a pass over the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def split_sorted(shards: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard (stable) and the bounds of each shard's run."""
    order = np.argsort(shards, kind="stable")
    return order, np.searchsorted(shards[order], np.arange(n + 1))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
