"""Removal of repeated passages by fixed-block anchors.

Each text is cut into reference blocks of `block` words that do not overlap. With block = (width + 1) // 2 every
window of `width` words holds a whole reference block of its own document, so a window can only repeat where one of
its document's blocks occurs as a rolling window somewhere else. Rolling windows probe the index of blocks; hits are
extended to all windows around the hit block, and the windows that repeat join up to maximal repeats.

Buckets of documents and shards of hashes exchange packed arrays: a bucket sends a rolling hash once with a flag for
"more than once here", so a passage of a third of all documents costs a shard one entry for each bucket.

Null and empty texts have no words. Each row is a document, repeated rows repeat each other. An empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, groups, inside, keyed, pack32, rolling, split_sorted, unpack32, utf8

U32 = np.uint64(0xFFFFFFFF)


def _words(t: pa.Table) -> list[tuple[list[bytes], np.ndarray]]:
    """Words (split at the contract's white space, as bytes.split does) and their hashes, for each document."""
    hashed = WordHash()
    out = []
    for text in utf8(t.column("text")):
        words = text.split()
        out.append((words, hashed.of(words)))
    return out


def _once(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and whether each came more than once."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)]) > 1


def _shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def probes(docs: DataFrame, block: int, n: int) -> DataFrame:
    """Of each bucket, for each shard: its distinct rolling hashes (32 bits), which of them repeat, and its blocks'."""

    def run(t: pa.Table) -> pa.Table:
        roll, own = [], []
        for _, w in _words(t):
            r = rolling(w, block)
            roll.append(r)
            own.append(r[::block])
        h, again = _once(np.concatenate(roll) if roll else np.empty(0, np.uint64))
        blocks = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        order, at = split_sorted(_shard_of(h, n), n)
        b_order, b_at = split_sorted(_shard_of(blocks, n), n)
        rows = []
        for s in np.flatnonzero(np.diff(at)).tolist():
            i = order[at[s] : at[s + 1]]
            low = (h[i] & U32).astype(np.uint32)
            by = np.argsort(low, kind="stable")
            low_b = np.unique((blocks[b_order[b_at[s] : b_at[s + 1]]] & U32).astype(np.uint32))
            rows.append((s, pack32(low[by]), np.packbits(again[i][by]).tobytes(), pack32(low_b)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "rolling": pa.array(cols[1], pa.binary()), "again": pa.array(cols[2], pa.binary()), "blocks": pa.array(cols[3], pa.binary())})

    return docs.groupBy("bucket").applyInArrow(run, "shard int, bucket int, rolling binary, again binary, blocks binary")


def anchors(sent: DataFrame) -> DataFrame:
    """(bucket, shard, blocks): the blocks of each bucket that occur at another place too.

    32-bit collisions inside a shard let a few blocks through that do not repeat; the next step is exact.
    """

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        rolled = [unpack32(x) for x in t.column("rolling").to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(r)).astype(bool) for x, r in zip(t.column("again").to_pylist(), rolled, strict=True)]
        every, many = _once(np.concatenate(rolled))
        live = np.union1d(every[many], np.concatenate([r[a] for r, a in zip(rolled, again, strict=True)]))
        buckets, found = [], []
        for b, x in zip(t.column("bucket").to_pylist(), t.column("blocks").to_pylist(), strict=True):
            own = unpack32(x)
            own = own[inside(own, live)]
            if len(own):
                buckets.append(b)
                found.append(pack32(own))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array([shard] * len(buckets), pa.int32()), "blocks": pa.array(found, pa.binary())})

    return sent.groupBy("shard").applyInArrow(run, "bucket int, shard int, blocks binary")


def _near_anchors(w: np.ndarray, live: np.ndarray, width: int, block: int, n: int) -> np.ndarray:
    """Which windows of the document hold a live block of it."""
    windows = len(w) - width + 1
    near = np.zeros(max(0, windows), bool)
    if windows < 1:
        return near
    own = rolling(w, block)[::block]
    tag = (_shard_of(own, n).astype(np.uint64) << np.uint64(32)) | (own & U32)
    for at in (np.flatnonzero(inside(tag, live)) * block).tolist():
        near[max(0, at + block - width) : at + 1] = True
    return near


def _live(found: pa.Table) -> np.ndarray:
    parts = [(np.uint64(s) << np.uint64(32)) | unpack32(x).astype(np.uint64) for s, x in zip(found.column("shard").to_pylist(), found.column("blocks").to_pylist(), strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def candidates(docs: DataFrame, live: DataFrame, width: int, block: int, n: int) -> DataFrame:
    """Of each bucket, for each shard: the distinct hashes (64 bits) of its windows around live blocks, and which repeat.

    The shard comes from a second hash of the window, which adds its bits to the 64 compared.
    """

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if len(t) and len(found):
            mine = _live(found)
            hashes, second = [], []
            for _, w in _words(t):
                near = _near_anchors(w, mine, width, block, n)
                if near.any():
                    hashes.append(rolling(w, width)[near])
                    second.append(_shard_of(rolling(w, width, seed=1)[near], n))
            if hashes:
                h, s = np.concatenate(hashes), np.concatenate(second)
                order = np.lexsort((h, s))
                h, s = h[order], s[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
                many = np.diff(np.r_[first, len(h)]) > 1
                h, s = h[first], s[first]
                at = np.searchsorted(s, np.arange(n + 1))
                bucket = t.column("bucket")[0].as_py()
                for k in np.flatnonzero(np.diff(at)).tolist():
                    i = slice(at[k], at[k + 1])
                    rows.append((k, bucket, h[i].astype("<u8").tobytes(), np.packbits(many[i]).tobytes()))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({x: pa.array(c, k) for x, c, k in zip(("shard", "bucket", "hashes", "again"), cols, kinds, strict=True)})

    return docs.groupBy("bucket").cogroup(live.groupBy("bucket")).applyInArrow(run, "shard int, bucket int, hashes binary, again binary")


def repeats(sent: DataFrame) -> DataFrame:
    """(bucket, shard, hashes): the windows of each bucket that repeat, inside it or across buckets."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        hashes = [np.frombuffer(x, "<u8") for x in t.column("hashes").to_pylist()]
        again = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(t.column("again").to_pylist(), hashes, strict=True)]
        every, many = _once(np.concatenate(hashes))
        shared = every[many]
        buckets, found = [], []
        for b, h, a in zip(t.column("bucket").to_pylist(), hashes, again, strict=True):
            own = h[a | inside(h, shared)]
            if len(own):
                buckets.append(b)
                found.append(own.tobytes())
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array([shard] * len(buckets), pa.int32()), "hashes": pa.array(found, pa.binary())})

    return sent.groupBy("shard").applyInArrow(run, "bucket int, shard int, hashes binary")


def _remove(docs: DataFrame, found: DataFrame, width: int, n: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table, hits: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in hits.column("hashes").to_pylist()]
        shards = [np.full(len(p), s, np.int64) for p, s in zip(parts, hits.column("shard").to_pylist(), strict=True)]
        gone = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        of = np.concatenate(shards) if parts else np.empty(0, np.int64)
        order = np.argsort(gone, kind="stable")
        gone, of = gone[order], of[order]
        # the same 64 bits under two shards are two windows: keep every shard of a hash
        several = bool(len(gone)) and bool((gone[1:] == gone[:-1]).any())
        pairs = set(zip(gone.tolist(), of.tolist(), strict=True)) if several else set()
        n_words, n_removed, kept = [], [], []
        for words, w in _words(t):
            drop = np.zeros(len(words) + 1, np.int64)
            if len(gone) and len(words) >= width:
                h = rolling(w, width)
                at = np.searchsorted(gone, h)
                hit = gone[np.minimum(at, len(gone) - 1)] == h
                if hit.any():
                    s = _shard_of(rolling(w, width, seed=1), n)
                    same = of[np.minimum(at, len(gone) - 1)] == s
                    if several:
                        for i in np.flatnonzero(hit & ~same).tolist():
                            same[i] = (int(h[i]), int(s[i])) in pairs
                    start = np.flatnonzero(hit & same)
                    np.add.at(drop, start, 1)
                    np.subtract.at(drop, start + width, 1)
            gone_words = np.cumsum(drop[:-1]) > 0
            removed = int(gone_words.sum())
            n_words.append(len(words))
            n_removed.append(removed)
            kept.append(b" ".join([x for x, g in zip(words, gone_words.tolist(), strict=True) if not g] if removed else words))
        return pa.table({"doc_id": t.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, width: int = 35, n: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: words without those in windows of `width` words that occur again anywhere."""
    n = groups(docs, text_col, n)
    block = (width + 1) // 2
    dealt = keyed(docs, n, id_col, text_col)
    live = anchors(probes(dealt, block, n))
    return _remove(dealt, repeats(candidates(dealt, live, width, block, n)), width, n)


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
