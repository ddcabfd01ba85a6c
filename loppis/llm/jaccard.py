"""Exact n-gram Jaccard join with a prefix tree.

A document's set is its distinct word shingles. Sets are put in one global order, rare shingles first, by exact
document frequencies. Two sets that reach the threshold share a shingle in their prefixes (the first |x| - ceil(t |x|)
+ 1 of each); shingles that occur in one document only link nothing, so most documents drop out at once. Groups of
documents that share prefix shingles are stored in a prefix tree, which is traversed once with the overlap of every
set kept along the path: sets that share a path share the counting. A subtree is left as soon as the remaining length
cannot lift any set outside it to the threshold and no two of its own sets are of close enough sizes.

Identical sets are one set with members; copies are never expanded into pairs. A large group is dealt to tiles of
bounded size. First each tile meets itself and a few pivots of the group, which joins clusters of near copies at a cost
in proportion to the group. Then only the sets that are still outside of the group's largest component meet the other
tiles. So no link that joins two components is lost; links inside one are not all listed.

Nulls: a null or wordless text has an empty set, linked with nothing. A text of fewer words than a shingle has one
shingle, its whole word sequence. Repeated rows share a set. Null ids are ignored by the smallest id of a component,
which is null where all its ids are. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, cut, groups, keyed, pack32, rolling, split_sorted, stored, unpack32, utf8
from .components import components

U32 = np.uint64(0xFFFFFFFF)


def shingles(words: list[bytes], hashed: WordHash, size: int) -> np.ndarray:
    """Distinct shingle hashes in order."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashed.of(words), min(size, len(words)), seed=0 if len(words) >= size else len(words)))


def _sets(t: pa.Table, size: int) -> list[np.ndarray]:
    hashed = WordHash()
    return [shingles(text.lower().split(), hashed, size) for text in utf8(t.column("text"))]


def _shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def local_frequencies(docs: DataFrame, size: int, n: int) -> DataFrame:
    """Of each bucket, for each shard: its shingles (32 bits) and in how many of its documents each occurs."""

    def run(t: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate(_sets(t, size)))
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(h)])
        h = h[first]
        order, at = split_sorted(_shard_of(h, n), n)
        rows = []
        for s in np.flatnonzero(np.diff(at)).tolist():
            i = order[at[s] : at[s + 1]]
            low = (h[i] & U32).astype(np.uint32)
            by = np.argsort(low, kind="stable")
            rows.append((s, pack32(low[by]), pack32(count[i][by].astype(np.uint32))))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        bucket = t.column("bucket")[0].as_py()
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "low": pa.array(cols[1], pa.binary()), "count": pa.array(cols[2], pa.binary())})

    return docs.groupBy("bucket").applyInArrow(run, "shard int, bucket int, low binary, count binary")


def frequencies(sent: DataFrame) -> DataFrame:
    """(bucket, shard, low, count): the shingles of each bucket that occur in two documents or more, with how many."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        lows = [unpack32(x) for x in t.column("low").to_pylist()]
        counts = [unpack32(x).astype(np.int64) for x in t.column("count").to_pylist()]
        every, inverse = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64)
        buckets, found, n_docs = [], [], []
        at = 0
        for b, low in zip(t.column("bucket").to_pylist(), lows, strict=True):
            own = total[inverse[at : at + len(low)]]
            at += len(low)
            more = own > 1
            if more.any():
                buckets.append(b)
                found.append(pack32(low[more]))
                n_docs.append(pack32(np.minimum(own[more], 0xFFFFFFFF).astype(np.uint32)))
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array([shard] * len(buckets), pa.int32()), "low": pa.array(found, pa.binary()), "count": pa.array(n_docs, pa.binary())})

    return sent.groupBy("shard").applyInArrow(run, "bucket int, shard int, low binary, count binary")


def prefix_length(size: int, percent: int) -> int:
    """Two sets of at least percent / 100 similarity share one of so many first members of either."""
    return size - -(-percent * size // 100) + 1


def ordered_sets(docs: DataFrame, shared: DataFrame, size: int, percent: int, n: int) -> DataFrame:
    """doc_id, n_shingles, key (128-bit digest of the set, null if empty), prefix (array), members (binary).

    prefix holds the shared shingles of the prefix; members holds the whole set in the global order as pairs of
    frequency and hash. Both are null for sets without a shared shingle in the prefix and for further copies of a
    set in the bucket.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(t: pa.Table, found: pa.Table) -> pa.Table:
        tags, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
        for s, low, c in zip(found.column("shard").to_pylist(), found.column("low").to_pylist(), found.column("count").to_pylist(), strict=True):
            tags.append((np.uint64(s) << np.uint64(32)) | unpack32(low).astype(np.uint64))
            counts.append(unpack32(c))
        tag, count = np.concatenate(tags), np.concatenate(counts)
        order = np.argsort(tag)
        tag, count = tag[order], count[order]
        seen: set[bytes] = set()
        n_shingles, keys, prefixes, members = [], [], [], []
        for h in _sets(t, size) if len(t) else []:
            n_shingles.append(len(h))
            key = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
            keys.append(key)
            prefix = whole = None
            if len(h) and len(tag) and key not in seen:
                seen.add(key)
                own = (_shard_of(h, n).astype(np.uint64) << np.uint64(32)) | (h & U32)
                at = np.minimum(np.searchsorted(tag, own), len(tag) - 1)
                df = np.where(tag[at] == own, count[at], np.uint32(1))
                rank = np.lexsort((h, df))
                first = rank[: prefix_length(len(h), percent)]
                first = first[df[first] > 1]
                if len(first):
                    prefix = h[first].view(np.int64)
                    whole = df[rank].astype("<u4").tobytes() + h[rank].astype("<u8").tobytes()
            prefixes.append(prefix)
            members.append(whole)
        return pa.table({"doc_id": t.column("doc_id"), "n_shingles": pa.array(n_shingles, pa.int64()), "key": pa.array(keys, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "members": pa.array(members, pa.binary())})

    return docs.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(run, f"doc_id {id_type}, n_shingles long, key binary, prefix array<bigint>, members binary")


class PrefixTree:
    """Sets as sequences of ranks in the global order, sorted, so that a node is a range of them at a depth."""

    def __init__(self, sets: list[np.ndarray]):
        """sets: each a sorted array of ranks 0..m-1 in the global order."""
        self.by = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets = [sets[i] for i in self.by]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        ranks = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        order = np.argsort(ranks, kind="stable")
        self.owner = owner[order]
        self.post = np.searchsorted(ranks[order], np.arange(int(ranks.max()) + 2))

    def _gain(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        starts, sizes = self.post[tokens], self.post[tokens + 1] - self.post[tokens]
        total = int(sizes.sum())
        at = np.arange(total) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def links(self, percent: int, across: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that span the same components as all pairs at the threshold; across: tile of each set, to link only
        sets of different tiles."""
        label = np.arange(len(self.sets))
        found: list[tuple[int, int]] = []
        tile = None if across is None else across[np.array(self.by)]
        stack = [(0, len(self.sets), 0, np.zeros(len(self.sets), np.int64))]
        longest = self.size
        while stack:
            lo, hi, depth, overlap = stack.pop()
            a, b = self.sets[lo], self.sets[hi - 1]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            if end > depth:
                overlap = overlap + self._gain(a[depth:end])
            # the best any set can still reach: all that is left below this node, or all that is left of itself
            rest = int(longest[lo:hi].max()) - end
            least = int(self.size[lo:hi].min())
            reach = np.minimum(overlap + rest, self.size)
            alive = 100 * reach >= percent * (self.size + least - np.minimum(reach, least))
            # pairs within the subtree: only if two neighbouring sizes are close enough, which one set alone never is
            inside = np.sort(self.size[lo:hi])
            alive[lo:hi] = bool((100 * inside[:-1] >= percent * inside[1:]).any())
            if not alive.any():
                continue
            i = lo
            while i < hi and len(self.sets[i]) == end:  # sets that end here
                union = self.size + end - overlap
                same = np.flatnonzero(100 * overlap >= percent * union)
                if tile is not None:
                    same = same[(tile[same] != tile[i]) | (same == i)]
                mine = np.unique(label[same])
                if len(mine) > 1:
                    first = same[np.unique(label[same], return_index=True)[1]]
                    found += [(self.by[i], self.by[j]) for j in first.tolist() if label[j] != label[i]]
                    label[np.isin(label, mine)] = mine[0]
                i += 1
            while i < hi:  # children: runs of the same next rank
                t = self.sets[i][end]
                j = i + 1
                step = 1
                while j < hi and self.sets[j][end] == t:  # gallop, then halve
                    i_low, j = j, min(hi, j + step)
                    step *= 2
                    if j == hi or self.sets[j][end] != t:
                        low, high = i_low, j
                        while low + 1 < high:
                            mid = (low + high) // 2
                            low, high = (mid, high) if self.sets[mid][end] == t else (low, mid)
                        j = low + 1
                        break
                stack.append((i, j, end, overlap))
                i = j
        return found


def _tree_links(t: pa.Table, percent: int, across: bool = False) -> pa.Table:
    """Links of one group, or across only those of sets with different `side`."""
    freq, hashes = [], []
    for data in t.column("members").to_pylist():
        m = len(data) // 12
        freq.append(np.frombuffer(data, "<u4", m))
        hashes.append(np.frombuffer(data, "<u8", m, offset=4 * m))
    every, at = np.unique(np.concatenate(hashes), return_index=True)
    order = np.lexsort((every, np.concatenate(freq)[at]))  # rare first, as everywhere
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    sets = [rank[np.searchsorted(every, h)] for h in hashes]
    keys = t.column("key").to_pylist()
    found = PrefixTree(sets).links(percent, t.column("side").to_numpy() if across else None)
    return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.binary()), "b": pa.array([keys[j] for _, j in found], pa.binary())})


def link_groups(sets: DataFrame, grouped: DataFrame, percent: int, tile_size: int, pivots: int = 32) -> DataFrame:
    """(a, b): links between keys of one group (root, key) that span the same components as all of them."""
    sizes = cut(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    giant = sizes.filter(F.col("n") > tile_size)
    n_giant = giant.count()
    # at most a group for every tile_size sets, counted before it is broadcast
    large = F.broadcast(giant) if n_giant <= 100_000 else giant
    small = grouped.join(large, "root", "left_anti").join(sets, "key").groupBy("root").applyInArrow(lambda t: _tree_links(t, percent), "a binary, b binary")
    if not n_giant:
        return small
    tiles = F.ceil(F.col("n") / tile_size).cast("int")
    dealt = grouped.join(large, "root").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = stored(dealt.join(sets, "key"))
    every_tile = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    chosen = dealt.filter(F.pmod(F.xxhash64("key", F.lit("pivot")), F.ceil(F.col("n") / pivots)) == 0).select("root", every_tile, "key", "members")
    first = stored(dealt.select("root", "tile", "key", "members").union(chosen).groupBy("root", "tile").applyInArrow(lambda t: _tree_links(t, percent), "a binary, b binary"))
    # what is not in its group's largest component yet
    label = components(first).withColumnRenamed("root", "label")
    labelled = cut(dealt.select("root", "key", "tiles").join(label, F.col("key") == F.col("node"), "left").select("root", "key", "tiles", F.coalesce("label", "key").alias("label")))
    most = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("root").agg(F.max(F.struct("m", "label")).alias("most"))
    most = most.select("root", F.col("most.label").alias("main"))
    rest = labelled.join(F.broadcast(most) if n_giant <= 100_000 else most, "root").filter(F.col("label") != F.col("main"))
    rest = cut(rest.select("root", "key", "tiles"))
    count = rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile_size).cast("int").alias("parts"))
    parts = F.broadcast(count) if n_giant <= 100_000 else count
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
    left = rest.join(parts, "root").select("root", "tiles", "key", part).join(sets, "key").select("root", "part", every_tile, "key", "members", F.lit(1).alias("side"))
    own = dealt.join(parts, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tile", "key", "members", F.lit(0).alias("side"))
    second = own.unionByName(left).groupBy("root", "part", "tile").applyInArrow(lambda t: _tree_links(t, percent, True), "a binary, b binary")
    return small.union(first).union(second)


def join(docs: DataFrame, size: int = 5, percent: int = 80, tile_size: int = 256, n: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least percent similarity."""
    n = groups(docs, text_col, n)
    dealt = keyed(docs, n, id_col, text_col)
    shared = frequencies(local_frequencies(dealt, size, n))
    rows = cut(ordered_sets(dealt, shared, size, percent, n))
    # copies of a set hold equal prefix and members wherever these are not null
    sets = cut(
        rows.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.first("prefix", True).alias("prefix"), F.first("members", True).alias("members"))
    )
    open_ = sets.filter("members IS NOT NULL")
    posts = open_.select("key", F.explode("prefix").alias("shingle"))
    # a star of each shingle's sets around the smallest key is enough to bring them into one group
    heads = posts.groupBy("shingle").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle", "head")
    near = posts.join(heads, "shingle").filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    links = cut(link_groups(open_.select("key", "members"), components(near).select("root", F.col("node").alias("key")), percent, tile_size))
    roots = components(links)
    labelled = sets.select("key", "least").join(roots, sets.key == roots.node, "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "root").select("key", "component_id")
    linked = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    return linked.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
