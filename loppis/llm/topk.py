"""Exact top-k by inner product over a pivot-distance index.

Vectors are quantised, component x to floor(scale * x). Each is keyed by its nearest pivot and the distance to it.
Of a pivot's vectors, sorted by distance, an annulus is a run. For a query q at distance a from the pivot and a vector
v at distance r, the triangle inequality gives |q - v| >= |a - r|, so q.v <= (|q|^2 + |v|^2 - (a - r)^2) / 2, and
q.v = q.p + q.(v - p) <= q.p + |q| r. Each query first visits the part of the index nearest to it; its k-th best score
there is a floor for the rest. Then it visits only those parts whose bound reaches the floor, and in a part expands the
annuli best bound first until none can reach it. Bounds have slack for rounding, scores are exact integers: doubles where
all sums stay below 2^53, Python's integers beyond.

Pivots are fitted on a bounded sample of the rows (`sample`); every row is indexed, and the result is exact whatever
the pivots are. Equal vectors are one entry with their k + 1 smallest ids, which is all that any query can need; equal
queries are searched once. Parts are bounded in bytes, by pivot, then distance, then a hash where one distance is full,
and so are the queries that meet one part in one task.

Vectors that are null, or hold a null or a component that is not finite (after scaling), take no part. Vectors of
unlike lengths compare as if padded with zeros; an empty one scores 0. A null id is larger than any other and never a
query. Rows that repeat an id are rows of their own: a query leaves out its own row, not its like. Scores beyond a long
are held at its ends. Further columns are ignored. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Integers up to here are exact in a double.
EXACT = float(1 << 53)
#: Vectors of an annulus; the unit of one matrix product with a block of queries.
ANNULUS = 256
QUERY_BLOCK = 1024
#: Bands of distance that are counted for each pivot before they are merged into parts of the index.
BINS = 64
#: Bytes of vectors in a part of the index, and of queries that meet it in one task.
PART_BYTES = 16 << 20


def pack(values: np.ndarray) -> bytes:
    """Integral doubles in the narrowest of int16, int32 and double that holds them, behind its letter."""
    most = np.abs(values).max(initial=0.0)
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"
    return kind.encode() + values.astype(f"<{kind}").tobytes()


def unpack(code: bytes) -> np.ndarray:
    return np.frombuffer(code, f"<{chr(code[0])}", offset=1).astype(np.float64)


def matrix(codes: list[bytes]) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    if not codes:
        return np.zeros((0, 0))
    size, kind = len(codes[0]), codes[0][0]
    if all(len(c) == size and c[0] == kind for c in codes):
        flat = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), size)[:, 1:]
        return np.ascontiguousarray(flat).view(f"<{chr(kind)}").astype(np.float64)
    rows = [unpack(c) for c in codes]
    out = np.zeros((len(rows), max(map(len, rows))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widened(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: doubles, or Python's integers where a double could round."""
    dim = max(q.shape[1], v.shape[1])
    q, v = widened(q, dim), widened(v, dim)
    if np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * max(dim, 1) < EXACT:
        return q @ v.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(v.T), -(1 << 63), (1 << 63) - 1)


def quantised(rows: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, code): packed integers of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes = [], []
            for vec_id, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not values.is_valid or values.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * values.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    codes.append(pack(x + 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, code binary")


def norms2(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m, m)


def distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    dim = max(m.shape[1], centres.shape[1])
    m, centres = widened(m, dim), widened(centres, dim)
    return np.sqrt(np.maximum(norms2(m)[:, None] + norms2(centres) - 2 * (m @ centres.T), 0))


@dataclass(frozen=True)
class Pivots:
    centres: np.ndarray
    width: float

    def key(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance to it and band of distance of each vector."""
        with np.errstate(over="ignore", invalid="ignore"):
            d = distances(matrix(codes), self.centres)
            at = d.argmin(1)
            near = d[np.arange(len(d)), at]
            return at, near, np.nan_to_num(np.clip(near // self.width, 0, BINS - 1)).astype(np.int64)


def fit(codes: list[bytes], pivots: int, rounds: int = 8) -> Pivots:
    """Rounded centres of a few rounds of k-means over different sampled vectors, from a fixed start."""
    codes = sorted(set(codes))
    rows = matrix(codes)
    start = np.random.default_rng(0).permutation(len(rows))[:pivots]
    centres = rows[start].copy()
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(rounds):
            at = distances(rows, centres).argmin(1)
            for j in np.unique(at):
                centres[j] = np.rint(rows[at == j].mean(0))
        centres = np.nan_to_num(centres)
        far = distances(rows, centres).min(1).max(initial=0.0)
    return Pivots(centres, max(float(far) / BINS, 1.0) if np.isfinite(far) else 1.0)


@dataclass(frozen=True)
class Band:
    """Neighbouring bins of one pivot that make a part of the index, or several by a hash."""

    pivot: int
    first: int
    last: int
    parts: int
    least: float
    most: float
    norm2: float


def bands_of(counted: list[tuple[int, int, int, float, float, float]], most_bytes: int) -> list[Band]:
    """Bands over counted bins (pivot, bin, bytes, least and largest distance, largest squared norm): bins join while they
    fit, and a bin beyond the bound is dealt to as many parts as it needs."""
    out: list[Band] = []
    held: list[tuple] = []

    def close() -> None:
        if held:
            size = sum(h[2] for h in held)
            out.append(Band(held[0][0], held[0][1], held[-1][1], max(1, -(-size // most_bytes)), min(h[3] for h in held), max(h[4] for h in held), max(h[5] for h in held)))
            held.clear()

    for row in sorted(counted):
        if held and (held[0][0] != row[0] or sum(h[2] for h in held) + row[2] > most_bytes):
            close()
        held.append(row)
    close()
    return out


def bounds(dots: np.ndarray, away: np.ndarray, q2: np.ndarray, least: np.ndarray, most: np.ndarray, norm2: np.ndarray) -> np.ndarray:
    """Largest score each query (row) can have with vectors at distances least to most from a pivot (column); dots and
    away: the query's inner product with the pivot and distance from it."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(np.maximum(least - away, away - most), 0)
        gap = np.maximum(gap - 1e-9 * (away + most) - 1e-6, 0)
        near = (q2[:, None] + norm2 - gap**2) / 2
        ball = dots + np.sqrt(q2)[:, None] * most
        slack = 1e-9 * (q2[:, None] + norm2 + np.abs(dots)) + 1e-3
        return np.minimum(near, ball) + slack


@dataclass(frozen=True)
class Index:
    """rows (stored): code, ids, pivot, dist, bin, norm2. The pivots and bands are bounded by `pivots` and BINS."""

    rows: DataFrame
    pivots: Pivots
    bands: list[Band]
    most_bytes: int


def build(vectors: DataFrame, k: int = 5, pivots: int = 64, sample: int = 4096, most_bytes: int = PART_BYTES) -> Index | None:
    """Index of (vec_id, code) rows; None if there are none."""
    # as hashes of ids and vectors deal them, copies of one vector can't fill the sample
    drawn = vectors.orderBy(F.xxhash64("vec_id", "code"), "code").limit(sample).select("code")
    codes = [bytes(r.code) for r in drawn.collect()]
    if not codes:
        return None
    fitted = fit(codes, pivots)
    first = F.row_number().over(W.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_last()))
    few = vectors.withColumn("at", first).filter(F.col("at") <= k + 1)
    entries = few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id"))).alias("held")).select("code", F.col("held.vec_id").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = b.column(0).to_pylist()
                at, near, bins = fitted.key(held)
                with np.errstate(over="ignore"):
                    n2 = norms2(matrix(held))
                cols = [b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(near), pa.array(bins, pa.int32()), pa.array(n2)]
                yield pa.RecordBatch.from_arrays(cols, names=["code", "ids", "pivot", "dist", "bin", "norm2"])

    rows = stored(entries.mapInArrow(run, "code binary, ids array<long>, pivot int, dist double, bin int, norm2 double"))
    counted = rows.groupBy("pivot", "bin").agg(F.sum(F.length("code")), F.min("dist"), F.max("dist"), F.max("norm2"))
    return Index(rows, fitted, bands_of([tuple(r) for r in counted.collect()], most_bytes), most_bytes)  # at most pivots * BINS rows


def _routed(index: Index, queries: DataFrame, home: bool) -> DataFrame:
    """(band, part, code, floor): the home band of each query, or all others whose bound reaches its floor."""
    fitted, bands = index.pivots, index.bands
    pivot = np.array([b.pivot for b in bands])
    least, most, norm2 = (np.array([getattr(b, n) for b in bands]) for n in ("least", "most", "norm2"))
    mid, parts = (least + most) / 2, np.array([b.parts for b in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, QUERY_BLOCK):
                codes = b.column(0).slice(s, QUERY_BLOCK).to_pylist()
                floor = b.column(1).slice(s, QUERY_BLOCK).to_numpy(zero_copy_only=False).astype(np.float64)
                q = matrix(codes)
                dim = max(q.shape[1], fitted.centres.shape[1])
                q, centres = widened(q, dim), widened(fitted.centres, dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    away, dots, q2 = distances(q, centres), q @ centres.T, norms2(q)
                    # home is the band nearest in distance among those of the nearest pivot that has any
                    far = np.abs(away[:, pivot] - mid) + np.where(away[:, pivot] == away[:, pivot].min(1)[:, None], 0, 1e300)
                at = np.nan_to_num(far, nan=1e308, posinf=1e308).argmin(1)
                if home:
                    to = np.zeros((len(codes), len(bands)), bool)
                else:
                    to = ~(bounds(dots[:, pivot], away[:, pivot], q2, least, most, norm2) < floor[:, None])
                to[np.arange(len(codes)), at] = home
                qi, bi = np.nonzero(to)
                again = parts[bi]
                part = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                cols = [pa.array(np.repeat(bi, again), pa.int32()), pa.array(part, pa.int32()), pa.array([codes[i] for i in np.repeat(qi, again)], pa.binary()), pa.array(np.repeat(floor[qi], again))]
                yield pa.RecordBatch.from_arrays(cols, names=["band", "part", "code", "floor"])

    return queries.select("code", "floor").mapInArrow(run, "band int, part int, code binary, floor double")


def _visited(index: Index, routed: DataFrame, chunks: int, k: int) -> DataFrame:
    """(code, score, ids, same): of each query and part, the k + 1 entries of the highest scores."""
    fitted, bands = index.pivots, index.bands
    # a bin belongs to one band: at most pivots * BINS of them
    lookup = index.rows.sparkSession.createDataFrame([(b.pivot, i, n, b.parts) for n, b in enumerate(bands) for i in range(b.first, b.last + 1)], "pivot int, bin int, band int, parts int")
    placed = index.rows.join(F.broadcast(lookup), ["pivot", "bin"]).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    entries = placed.select("band", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "code", "ids", "dist", "norm2")
    asked = routed.withColumn("chunk", F.pmod(F.xxhash64("code", F.lit("chunk")), F.lit(chunks)).cast("int"))

    def run(key: tuple, there: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if there.num_rows and queries.num_rows:
            there = there.sort_by([("dist", "ascending")]).combine_chunks()
            centre = fitted.centres[bands[key[0].as_py()].pivot][None, :]
            found = list(expanded(there["code"].to_pylist(), there["ids"].to_pylist(), there["dist"].to_numpy(), there["norm2"].to_numpy(), centre, queries["code"].to_pylist(), queries["floor"].to_numpy(), k + 1))
        code, score, ids, same = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.table({"code": pa.array(code, pa.binary()), "score": pa.array(score, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "same": pa.array(same, pa.bool_())})

    keys = ["band", "part", "chunk"]
    return entries.groupBy(*keys).cogroup(asked.select(*keys, "code", "floor").groupBy(*keys)).applyInArrow(run, "code binary, score long, ids array<long>, same boolean")


def expanded(codes: list[bytes], ids: list[list[int | None]], dist: np.ndarray, norm2: np.ndarray, centre: np.ndarray, queries: list[bytes], floors: np.ndarray, keep: int) -> Iterator[tuple[bytes, int, list, bool]]:
    """For each query the `keep` entries of the highest scores at or above its floor, ties by the smallest id; entries come
    sorted by their distance from the centre."""
    starts = np.arange(0, len(codes), ANNULUS)
    least, most, top2 = dist[starts], np.maximum.reduceat(dist, starts), np.maximum.reduceat(norm2, starts)
    smallest = np.array([np.iinfo(np.int64).max if x[0] is None else x[0] for x in ids], np.int64)
    held: dict[int, np.ndarray] = {}
    for s in range(0, len(queries), QUERY_BLOCK):
        block = queries[s : s + QUERY_BLOCK]
        q, floor = matrix(block), floors[s : s + QUERY_BLOCK].copy()
        dim = max(q.shape[1], centre.shape[1])
        with np.errstate(over="ignore", invalid="ignore"):
            dots, away, q2 = widened(q, dim) @ widened(centre, dim).T, distances(q, centre), norms2(q)
        reach = bounds(dots, away, q2, least, most, top2)
        best: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query, entry, score
        for j in np.argsort(-np.nan_to_num(reach, nan=np.inf).max(0), kind="stable"):
            asking = np.nonzero(~(reach[:, j] < floor))[0]
            if not len(asking):
                continue
            if j not in held:
                if len(held) >= 64:
                    held.clear()
                held[j] = matrix(codes[starts[j] : starts[j] + ANNULUS])
            scores = products(q[asking], held[j])
            need = floor[asking]
            if scores.shape[1] > keep and scores.dtype != object:
                need = np.maximum(need, np.partition(scores, -keep, axis=1)[:, -keep])
            qi, vi = np.nonzero(scores >= need[:, None])
            best = tuple(np.concatenate(x) for x in zip(best, (asking[qi], starts[j] + vi, scores[qi, vi]), strict=True))
            order = np.lexsort((smallest[best[1]], np.negative(best[2]), best[0])) if best[2].dtype != object else np.array(sorted(range(len(best[2])), key=lambda i: (best[0][i], -best[2][i], smallest[best[1][i]])), np.int64)
            owner = best[0][order]
            place = np.arange(len(order)) - np.searchsorted(owner, owner)
            last = order[place == keep - 1]
            floor[best[0][last]] = np.maximum(floor[best[0][last]], np.nextafter(best[2][last].astype(np.float64), -np.inf))
            best = tuple(x[order[place < keep]] for x in best)
        for i, v, score in zip(*best, strict=True):
            yield block[i], int(score), ids[v], block[i] == codes[v]


def _top(found: DataFrame, keep: int) -> DataFrame:
    """(code, at, score, vec_id, same): the first `keep` rows of each query, by falling score, then id."""
    rows = found.select("code", "score", "same", F.explode("ids").alias("vec_id"))
    order = W.partitionBy("code").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep)


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(code, found) of each different code of the queries: its k + 1 best rows in order, as (at, score, vec_id, same);
    `same` tells the query's own vector."""
    asked = stored(queries.select("code").distinct())
    size = asked.agg(F.sum(F.length("code"))).first()[0] or 0
    chunks = max(1, -(-size // index.most_bytes))
    near = stored(_visited(index, _routed(index, asked.withColumn("floor", F.lit(float("-inf"))), True), chunks, k))
    low = (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15 - 1).alias("floor")
    enough = _top(near, k + 1).filter(F.col("at") == k + 1).select("code", low)
    floors = asked.join(enough, "code", "left").select("code", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    ranked = _top(near.unionByName(_visited(index, _routed(index, floors, False), chunks, k)), k + 1)
    return ranked.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("at", "score", "vec_id", "same"))).alias("found"))


def nearest(rows: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, salts: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", **index: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows of highest score."""
    vectors = stored(quantised(rows, scale, id_col, vector_col))
    built = build(vectors, k, **index)
    if built is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = vectors.filter(F.col("vec_id") % every == 0)
    # any number of queries can be copies of one vector, so each answer is dealt over salts
    answers = search(built, queries, k).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = queries.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(answers, ["code", "salt"])
    own = F.array_position(F.transform("found", lambda x: x["same"] & x["vec_id"].eqNullSafe(F.col("vec_id"))), True)
    hits = met.select(F.col("vec_id").alias("query_id"), own.alias("own"), F.explode("found").alias("hit")).filter("hit.at <> own")
    rank = F.col("hit.at") - F.when((F.col("own") > 0) & (F.col("hit.at") > F.col("own")), 1).otherwise(0)
    return hits.select("query_id", rank.cast("int").alias("rank"), "hit.vec_id", "hit.score").filter(F.col("rank") <= k)
