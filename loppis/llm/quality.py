"""Quality rules: base counts and robust multivariate outliers.

Each text gets counts; shares of them are transformed to a vector. For each language and source the minimum
covariance determinant (MCD) estimate of centre and scatter is found by concentration steps over all rows: a step
bins every row's distance, sums moments by group and bin, and refits on the closest rows. The steps begin at four
deterministic starts (as in DetMCD: Hubert, Rousseeuw and Verdonck, 2012), and go on from the one whose scatter has the
smallest determinant. A document is rejected if its robust Mahalanobis distance is beyond the cutoff of its group, or
if it fails the base rules. Groups of fewer than `least_rows` documents use their language's estimate, small languages
the estimate of all; each row is reported with the level that judged it.

Nulls: a null text has no words and fails the base rules; null languages and sources are values of their own. Ties
and repeated rows each get a verdict. An empty table gives an empty result. Further columns stay as they are, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, cut, rolling, utf8

SYMBOLS = b"#*$%&|<>"
#: Deleted before counting code points in words: white space and all but the first byte of each code point.
NOT_WORD_CHARS = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_twins")
#: Smallest standard deviation taken for each part of the vector, so that parts which are mostly 0 do not reject
#: every document that has one: log word length, roots of the shares of symbols, repeated lines, repeated words,
#: capitals and words equal to the one before. On the tables at hand every variance of the larger groups is below
#: these, so they and not the estimated scatter decide there; README.md has the figures.
FLOORS = (0.06, 0.05, 0.16, 0.12, 0.06, 0.08)
DIMS = len(FLOORS)


def counts(text: bytes, hashed: WordHash) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    words = text.split()
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(b" \t\n\x0b\x0c\r"))
            else:
                seen.add(line)
    repeat = twins = 0
    if len(words) > 1:
        each = hashed.of(words)
        twins = int((each[1:] == each[:-1]).sum())
        h = rolling(each, WINDOW)
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            start = np.flatnonzero(np.isin(h, twice))
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.subtract.at(edge, start + WINDOW, 1)
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return (
        len(words),
        len(text.translate(None, NOT_WORD_CHARS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        dup,
        repeat,
        len(lines),
        len(text.translate(None, NOT_CAPITALS)),
        twins,
    )


STRUCT = ", ".join(f"{c}: bigint" for c in COUNTS)


#: Distinct words whose hashes a task remembers.
REMEMBER = 100_000


def _counted(text: pa.Array) -> pa.Array:
    hashed = WordHash()
    cols: list[list[int]] = [[] for _ in COUNTS]
    for t in utf8(text):
        if len(hashed) > REMEMBER:
            hashed.clear()
        for into, n in zip(cols, counts(t, hashed), strict=True):
            into.append(n)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(COUNTS))


def counted(text: Column) -> Column:
    """Struct of the counts of a text."""
    # "nondeterministic" keeps the planner from counting once for the filter and again for the columns
    return F.arrow_udf(_counted, f"struct<{STRUCT}>").asNondeterministic()(text)


def base_failed(q: str = "_q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * n)


def vector(q: str = "_q") -> list[Column]:
    """Transformed statistics; the added constants shrink short texts, whose shares scatter, towards the middle."""
    c = {x: F.col(f"{q}.{x}").cast("double") for x in COUNTS}
    return [
        F.log((c["word_chars"] + 250) / (c["n_words"] + 50)),
        F.sqrt(c["n_symbols"] / (c["word_chars"] + 100)),
        F.sqrt(c["n_dup_lines"] / (c["n_lines"] + 5)),
        F.sqrt(c["n_repeat_words"] / (c["n_words"] + 50)),
        F.sqrt(c["n_capitals"] / (c["word_chars"] + 100)),
        F.sqrt(c["n_twins"] / (c["n_words"] + 50)),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the lower incomplete gamma function."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= h / (a + n)
        total += term
        n += 1
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


#: Distances are binned by their logarithm, so many bins to a unit.
BINS = 16
PARAMS = "level string, start int, n long, logdet double, mu array<double>, inv array<double>"
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _squared(x: str, mu: str, inv: str) -> Column:
    """Squared Mahalanobis distance of array column x."""
    d = [F.col(x)[i] - F.col(mu)[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(inv)[i * DIMS + j] * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def _param_row(level: str, start: int, n: int, mu: np.ndarray, cov: np.ndarray) -> dict:
    cov = cov + np.diag(np.maximum(0, np.square(FLOORS) - np.diag(cov)))
    inv = np.round(np.linalg.inv(cov), 9)
    return {"level": level, "start": start, "n": n, "logdet": round(float(np.linalg.slogdet(cov)[1]), 6), "mu": np.round(mu, 9).tolist(), "inv": inv.ravel().tolist()}


def _moments(x: Callable[[int], Column]) -> Column:
    """Array of the sums of a vector's parts and of their products. One column, as each column that goes to Python costs
    an executor memory outside of its heap, which stays taken after the task."""
    return F.array(*[F.sum(x(i)) for i in range(DIMS)], *[F.sum(x(i) * x(j)) for i, j in PAIRS])


def _mean_cov(sums: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    mu = sums[:DIMS] / m
    cov = np.zeros((DIMS, DIMS))
    for (i, j), total in zip(PAIRS, sums[DIMS:], strict=True):
        cov[i, j] = cov[j, i] = total / m - mu[i] * mu[j]
    return mu, cov


def _beside(rows: DataFrame, params: DataFrame, small: bool, salts: int = 64) -> DataFrame:
    """Rows with the estimates of their level: broadcast if the levels were counted to be few, else dealt over salts,
    as the level of all documents holds a third of the rows. The rows are a cut table, so their salts are stable."""
    if small:
        return rows.join(F.broadcast(params), "level")
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    copies = params.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, ["level", "salt"]).drop("salt")


def starts(rows: DataFrame, small: bool) -> DataFrame:
    """Four first estimates of each level: coordinatewise medians and quartile ranges; about these the correlation of
    the hyperbolic tangents and the spatial sign covariance of the standardised vectors; and mean and covariance."""
    quart = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(DIMS)]
    quart = rows.groupBy("level").agg(*quart)
    spread = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOORS[i] / 10)) for i in range(DIMS)]
    quart = quart.select("level", F.array(*[F.col(f"p{i}")[1] for i in range(DIMS)]).alias("middle"), F.array(*spread).alias("spread"))
    z = _beside(rows, quart, small).withColumn("z", F.array(*[(F.col("x")[i] - F.col("middle")[i]) / F.col("spread")[i] for i in range(DIMS)]))
    z = z.withColumn("norm", F.greatest(F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(DIMS)), F.lit(0.0))), F.lit(1e-9)))
    sums = [
        _moments(lambda i: F.col("x")[i]).alias("s"),
        _moments(lambda i: F.tanh(F.col("z")[i])).alias("t"),
        _moments(lambda i: F.col("z")[i] / F.col("norm")).alias("u"),
    ]
    summed = z.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.first("middle").alias("middle"), F.first("spread").alias("spread"), *sums)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for r in b.to_dict("records"):
                n, middle, d = int(r["n"]), np.array(r["middle"], float), np.diag(np.array(r["spread"], float))
                s, t, u = (np.array(r[x], float) for x in "stu")
                tanh = _mean_cov(t, n)[1] + np.eye(DIMS) * 1e-6
                root = np.diag(1 / np.sqrt(np.diag(tanh)))
                mean_u, cov_u = _mean_cov(u, n)
                sign = DIMS * (cov_u + np.outer(mean_u, mean_u)) + np.eye(DIMS) * 1e-6
                for k, (mu, cov) in enumerate([(middle, d @ d), (middle, d @ root @ tanh @ root @ d), (middle, d @ sign @ d), _mean_cov(s, n)]):
                    made.append(_param_row(r["level"], k, n, mu, cov))
            yield pd.DataFrame(made, columns=["level", "start", "n", "logdet", "mu", "inv"])

    return summed.mapInPandas(begin, PARAMS)


def concentrate(rows: DataFrame, params: DataFrame, keep: float, small: bool) -> DataFrame:
    """One concentration step of every level and start over all rows: the estimates from the whole bins of distance
    that the closest `keep` of the level's rows reach into, scaled to be consistent for normal data."""
    share = keep / chi2_cdf(chi2_quantile(keep, DIMS), DIMS + 2)
    binned = _beside(rows, params.select("level", "start", "mu", "inv"), small).withColumn("bin", F.floor(F.log(_squared("x", "mu", "inv") + 1e-6) * BINS).cast("int"))
    moments = binned.groupBy("level", "start", "bin").agg(F.count(F.lit(1)).alias("m"), _moments(lambda i: F.col("x")[i]).alias("s"))

    def refit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("bin")
        n = int(t["m"].sum())
        reach = int(np.searchsorted(t["m"].cumsum().to_numpy(), keep * n)) + 1
        near = t.iloc[:reach]
        mu, cov = _mean_cov(np.stack(near["s"].to_list()).sum(0), float(near["m"].sum()))
        return pd.DataFrame([_param_row(t["level"].iloc[0], int(t["start"].iloc[0]), n, mu, cov * share)])

    return moments.groupBy("level", "start").applyInPandas(refit, PARAMS)


def fit(rows: DataFrame, keep: float = 0.75, first: int = 2, steps: int = 4, broadcast_rows: int = 10_000) -> DataFrame:
    """MCD estimates (level, start, n, logdet, mu, inv) from cut rows (level, x), every row counted in every step.

    All starts take `first` steps, the one of the smallest determinant takes `steps` more.
    """
    small = rows.select("level").distinct().count() <= broadcast_rows
    params = starts(rows, small)
    for _ in range(first):
        params = concentrate(rows, params, keep, small)
    best = params.groupBy("level").agg(F.min(F.struct("logdet", "start", "n", "mu", "inv")).alias("b"))
    params = cut(best.select("level", "b.start", "b.n", "b.logdet", "b.mu", "b.inv"))
    for _ in range(steps):
        params = concentrate(rows, params, keep, small)
    return params


def _levels() -> list[Column]:
    """Names of a row's groups, from fine to coarse."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return [F.concat(lang, F.lit("\x1f"), source), lang, F.lit("")]


LEVELS = ("source", "lang", "all")


def estimate(rows: DataFrame) -> DataFrame:
    """MCD estimates of all levels from rows (lang, source, _q) that pass the base rules."""
    x = cut(rows.filter(~base_failed()).select(F.array(*vector()).alias("x"), F.array(*_levels()).alias("levels")))
    return fit(x.select("x", F.explode("levels").alias("level")))


def judge(rows: DataFrame, params: DataFrame, least_rows: int = 100, certainty: float = 0.9999, broadcast_rows: int = 10_000) -> DataFrame:
    """Rows (lang, source, _q and further ones) with base_failed, distance and level (null without an estimate), kept."""
    cutoff = chi2_quantile(certainty, DIMS)
    params = cut(params)
    # broadcast only after a look at its size; more groups than that are joined
    small = params.count() <= broadcast_rows
    out = rows
    for i, level in enumerate(_levels()):
        own = params.filter(F.col("n") >= least_rows) if i < 2 else params
        p = own.select(F.col("level").alias(f"_l{i}"), F.col("mu").alias(f"_m{i}"), F.col("inv").alias(f"_i{i}"))
        out = out.join(F.broadcast(p) if small or i == 2 else p, level == F.col(f"_l{i}"), "left")
    mu, inv = (F.coalesce(*[F.col(f"_{c}{i}") for i in range(3)]) for c in "mi")
    level = F.coalesce(*[F.when(F.col(f"_l{i}").isNotNull(), F.lit(x)) for i, x in enumerate(LEVELS)])
    out = out.withColumn("_x", F.array(*vector())).withColumn("_mu", mu).withColumn("_inv", inv).withColumn("level", level)
    out = out.withColumn("base_failed", base_failed()).withColumn("distance", _squared("_x", "_mu", "_inv"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    return out.drop("_x", "_mu", "_inv", *[f"_{c}{i}" for i in range(3) for c in "lmi"])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the squared distance and the level whose estimate judged the row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counted(F.col(text_col)).alias("_q"))
    rows = cut(rows)
    done = judge(rows, estimate(rows))
    return done.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in COUNTS[:5]], "base_failed", "kept", F.round("distance", 3).alias("distance"), "level")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", broadcast_rows: int = 500_000) -> DataFrame:
    """The documents that are kept, with their columns.

    Texts are counted once. A verdict depends on text, language and source alone, so the counts are kept under 128-bit
    hashes of these, and the rejected hashes, broadcast after a count or else joined, take the documents out.
    """
    parts = [F.col(f"`{c}`") for c in (text_col, lang_col, source_col)]
    nulls = [p.isNull() for p in parts]
    name = F.struct(F.xxhash64(F.lit(1), *parts, *nulls).alias("a"), F.xxhash64(F.lit(2), *parts, *nulls).alias("b"))
    rows = cut(docs.select(name.alias("name"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counted(F.col(text_col)).alias("_q")))
    gone = cut(judge(rows, estimate(rows)).filter(~F.col("kept")).select("name").distinct())
    small = gone.count() <= broadcast_rows
    # the row is carried in a struct, so that no column's name can clash
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    return carried.join(F.broadcast(gone) if small else gone, "name", "left_anti").select("row.*")
