"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of white space with A-Z lower-cased. The index counts in how many documents each
key occurs, in tables dealt to shards by the key's hash. A cuckoo filter beside each table holds the keys that have
reached `min_docs` documents: most lines are turned away by the filter, the table's exact count decides on the rest.
Inserted documents raise counts and put keys into the filter as they reach min_docs; deleted ones lower counts and
take keys out of it again, so lines come back when they are no longer frequent.

An index knows its number of shards and its min_docs, and works with no others. Data moves in packed form: documents
are dealt to buckets, a bucket counts its own keys first and sends each shard one row. A key found in a third of all
documents thus reaches its shard once for each bucket.

Nulls: a null text is one empty line; empty lines have no key and always stay. Each row is a document, so repeated
rows count repeatedly. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, keyed, split_sorted, utf8

BLANK_BYTES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """Stripped and lower-cased (bytes.lower changes A-Z only)."""
    return line.strip(BLANK_BYTES).lower()


class Keys:
    """128-bit key hashes in two columns, with counts."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, count: np.ndarray):
        self.hi, self.lo, self.count = hi, lo, count

    @classmethod
    def unpack(cls, keys: bytes, counts: bytes = b"") -> Keys:
        pair = np.frombuffer(keys, ">u8").reshape(-1, 2).astype(np.uint64)
        return cls(pair[:, 0], pair[:, 1], np.frombuffer(counts, "<i8") if counts else np.zeros(len(pair), np.int64))

    def pack(self) -> tuple[bytes, bytes]:
        return np.stack([self.hi, self.lo], 1).astype(">u8").tobytes(), self.count.astype("<i8").tobytes()

    @classmethod
    def merge(cls, parts: list[Keys]) -> Keys:
        """Sums the counts of equal keys, in key order; keys whose count is zero or less are gone."""
        if not parts:
            return cls(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
        hi, lo, n = (np.concatenate([getattr(p, x) for p in parts]) for x in ("hi", "lo", "count"))
        order = np.lexsort((lo, hi))
        hi, lo, n = hi[order], lo[order], n[order]
        first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else np.empty(0, np.int64)
        n = np.add.reduceat(n, first) if len(first) else n[:0]
        keep = n > 0
        return cls(hi[first][keep], lo[first][keep], n[keep])

    def counts_of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Counts of the asked keys, 0 for those that are absent."""
        out = np.zeros(len(hi), np.int64)
        if not len(self.hi):
            return out
        at = np.searchsorted(self.hi, hi)
        open_ = np.arange(len(hi))
        while len(open_):  # more than one step only where two keys share their first 64 bits
            pos = at[open_]
            inside = pos < len(self.hi)
            open_, pos = open_[inside], pos[inside]
            same = self.hi[pos] == hi[open_]
            open_, pos = open_[same], pos[same]
            hit = self.lo[pos] == lo[open_]
            out[open_[hit]] = self.count[pos[hit]]
            open_ = open_[~hit]
            at[open_] += 1
        return out


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a slot row, over 64-bit hashes."""

    WIDTH, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        rows = 1
        while rows * cls.WIDTH * 0.8 < n + 1:
            rows *= 2
        return cls(np.zeros((rows, cls.WIDTH), np.uint16))

    @classmethod
    def holding(cls, hashes: np.ndarray) -> Cuckoo:
        made = cls.sized(len(hashes))
        while not made.add(hashes):
            made = cls(np.zeros((2 * len(made.table), cls.WIDTH), np.uint16))
        return made

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, "<u2").reshape(-1, cls.WIDTH).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (hashes & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = ((hashes >> np.uint64(16)) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def add(self, hashes: np.ndarray) -> bool:
        """False, with the filter spoilt, if some hash found no place."""
        mark, first, second = self.places(hashes)
        left = np.arange(len(hashes))
        for target in (first, second):  # whoever fits without a kick, all at once
            order = left[np.argsort(target[left], kind="stable")]
            row = target[order]
            new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
            rank = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
            used = (self.table[row] != 0).sum(1)
            fits = rank + used < self.WIDTH
            # a row keeps its marks to the left, so its first free place is the number of marks in it
            self.table[row[fits], (rank + used)[fits]] = mark[order[fits]]
            left = order[~fits]
        for x in left.tolist():
            at, m = int(second[x]), int(mark[x])
            for kick in range(self.KICKS):
                row = self.table[at]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = m
                    break
                slot = (x + kick) % self.WIDTH
                m, row[slot] = int(row[slot]), m
                at = int(self.other(np.array([at]), np.array([m], np.uint16))[0])
            else:
                return False
        return True

    def drop(self, hashes: np.ndarray) -> None:
        """Takes out one copy of each hash's fingerprint; the hashes must have been added."""
        for m, a, b in zip(*(x.tolist() for x in self.places(hashes)), strict=True):
            for at in (a, b):
                found = np.flatnonzero(self.table[at] == m)
                if len(found):
                    rest = np.delete(self.table[at], found[0])
                    self.table[at] = np.r_[rest, np.uint16(0)]
                    break

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(hashes)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)


STATE = "shard int, shards int, min_docs int, keys binary, counts binary, filter binary"
LOCAL = "shard int, bucket int, keys binary, counts binary"


def local_counts(docs: DataFrame, shards: int, min_chars: int = 1) -> DataFrame:
    """Of each bucket, for each shard: the keys and in how many of the bucket's documents each occurs."""

    def run(t: pa.Table) -> pa.Table:
        counter: Counter[bytes] = Counter()
        for text in utf8(t.column("text")):
            counter.update({k for k in map(line_key, text.split(b"\n")) if k and (min_chars <= 1 or len(k.decode()) >= min_chars)})
        data = b"".join(map(xxhash.xxh3_128_digest, counter))
        found = Keys.unpack(data, np.fromiter(counter.values(), np.int64, len(counter)).tobytes())
        bucket = t.column("bucket")[0].as_py()
        order, at = split_sorted((found.lo % np.uint64(shards)).astype(np.int64), shards)
        rows = []
        for s in np.flatnonzero(np.diff(at)).tolist():
            own = order[at[s] : at[s + 1]]
            rows.append((s, bucket, *Keys(found.hi[own], found.lo[own], found.count[own]).pack()))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("shard", "bucket", "keys", "counts"), cols, kinds, strict=True)})

    return docs.groupBy("bucket").applyInArrow(run, LOCAL)


def _merged(parts: pa.Table) -> Keys:
    return Keys.merge([Keys.unpack(k, c) for k, c in zip(parts.column("keys").to_pylist(), parts.column("counts").to_pylist(), strict=True)])


def _changed(shard: int, shards: int, min_docs: int, had: Keys, cuckoo: Cuckoo, change: Keys, sign: int) -> pa.Table:
    """The shard's row after documents came (sign 1) or went (-1): only keys that cross min_docs touch its filter, which
    is made anew when it is too full for them."""
    before = had.counts_of(change.hi, change.lo)
    after = before + sign * change.count
    table = Keys.merge([had, Keys(change.hi, change.lo, sign * change.count)])
    cuckoo.drop(change.hi[(before >= min_docs) & (after < min_docs)])
    enter = change.hi[(before < min_docs) & (after >= min_docs)]
    often = int((table.count >= min_docs).sum())
    if often > 0.9 * cuckoo.table.size or not cuckoo.add(enter):
        cuckoo = Cuckoo.holding(table.hi[table.count >= min_docs])
    keys, counts = table.pack()
    values = {"shard": shard, "shards": shards, "min_docs": min_docs, "keys": keys, "counts": counts, "filter": cuckoo.dump()}
    return pa.table({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for k, v in values.items()})


def build(local: DataFrame, shards: int, min_docs: int = 10) -> DataFrame:
    """An index from nothing: one row a shard, all documents inserted into an empty one."""

    def run(t: pa.Table) -> pa.Table:
        return _changed(t.column("shard")[0].as_py(), shards, min_docs, Keys.merge([]), Cuckoo.sized(0), _merged(t), 1)

    return local.groupBy("shard").applyInArrow(run, STATE)


def shape(state: DataFrame) -> tuple[int, int] | None:
    """(shards, min_docs) of an index, None if it is empty; no index mixes them."""
    found = state.select("shards", "min_docs").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError("the index mixes numbers of shards or thresholds")
    return (found[0].shards, found[0].min_docs) if found else None


def update(state: DataFrame, docs: DataFrame, sign: int = 1, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A filled index with the documents inserted (sign 1) or deleted (-1)."""
    made = shape(state)
    if made is None:
        raise ValueError("the index is empty: build one")
    shards, min_docs = made
    local = local_counts(keyed(docs, groups(docs, text_col), id_col, text_col), shards, min_chars)

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        if not len(new):
            return old
        shard = new.column("shard")[0].as_py()
        cuckoo = Cuckoo.load(old.column("filter")[0].as_py()) if len(old) else Cuckoo.sized(0)
        return _changed(shard, shards, min_docs, _merged(old), cuckoo, _merged(new), sign)

    return state.groupBy("shard").cogroup(local.groupBy("shard")).applyInArrow(run, STATE)


def frequent(local: DataFrame, state: DataFrame) -> DataFrame:
    """(bucket, keys): the keys of each bucket that the index has in at least its min_docs documents.

    The shard's filter turns most of the bucket's keys away; the exact counts decide on the rest.
    """

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        buckets, hits = [], []
        if len(asked) and len(index):
            table, cuckoo = _merged(index), Cuckoo.load(index.column("filter")[0].as_py())
            least = index.column("min_docs")[0].as_py()
            for b, k in zip(asked.column("bucket").to_pylist(), asked.column("keys").to_pylist(), strict=True):
                own = Keys.unpack(k)
                maybe = np.flatnonzero(cuckoo.has(own.hi))
                sure = maybe[table.counts_of(own.hi[maybe], own.lo[maybe]) >= least]
                if len(sure):
                    buckets.append(b)
                    hits.append(Keys(own.hi[sure], own.lo[sure], own.count[sure]).pack()[0])
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "keys": pa.array(hits, pa.binary())})

    return local.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(run, "bucket int, keys binary")


def drop_lines(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: texts without the lines whose keys were found."""
    same = [c for c in ("doc_id", "carried") if c in docs.columns]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in same]

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        gone = {d[i : i + 16] for d in found.column("keys").to_pylist() for i in range(0, len(d), 16)}
        verdict: dict[bytes, bool] = {}
        n_lines, n_dropped, kept = [], [], []
        for text in utf8(t.column("text")):
            lines = text.split(b"\n")
            rest = []
            for line in lines:
                drop = verdict.get(line)
                if drop is None:
                    key = line_key(line)
                    drop = verdict[line] = bool(key) and xxhash.xxh3_128_digest(key) in gone
                if not drop:
                    rest.append(line)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(rest))
            kept.append(b"\n".join(rest))
        return pa.table({c: t.column(c) for c in same} | {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return docs.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(run, ", ".join([*kinds, "n_lines long", "n_dropped long", "kept string"]))


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n: int | None = None, id_col: str = "doc_id", text_col: str = "text", state: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept of every document, against an index of these documents or a given one.

    A given index brings its own number of shards and its min_docs.
    """
    n = groups(docs, text_col, n)
    dealt = keyed(docs, n, id_col, text_col)
    if state is None:
        local = local_counts(dealt, n, min_chars)
        return drop_lines(dealt, frequent(local, build(local, n, min_docs)))
    shards, _ = shape(state) or (n, min_docs)
    return drop_lines(dealt, frequent(local_counts(dealt, shards, min_chars), state))


def cleaned(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, n: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the frequent lines gone from their texts, other columns unchanged."""
    n = groups(docs, text_col, n)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    dealt = keyed(docs, n, id_col, text_col, rest)
    local = local_counts(dealt.drop("carried"), n, min_chars)
    done = drop_lines(dealt, frequent(local, build(local, n, min_docs)))
    place = {id_col: F.col("doc_id").alias(id_col), text_col: F.col("kept").alias(text_col)}
    return done.select(*[place[c] if c in place else F.col("carried").getField(c).alias(c) for c in docs.columns])


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
