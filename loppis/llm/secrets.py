"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame functions only.

Fixed patterns find assignments, access keys and long hex runs. Beyond them every run of 20 or more encoding
characters is a candidate. For its inferred encoding (hex, decimal, base 32, one-case, letters, base 62 or 64) it is
tested for

* uniform use of the alphabet: chi-squared, against the hypothesis that the token is as uneven as words are,
* runs above and below the middle of the alphabet (Wald and Wolfowitz),
* serial correlation of neighbouring characters.

A token whose runs or neighbours are not those of a random string cannot be a discovery. The p-values of the rest
are for "no more random than words"; within each band of lengths the Benjamini-Hochberg rule holds the share of false
discoveries at `fdr`, over all tokens of the corpus. Short tokens cannot reach small p-values, so the control is
aware of length twice.

Nulls and empty texts have no spans. Repeated rows each get a result. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the first pattern that a whole token matches, with the alphabet in the order of its values.
ENCODINGS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    (r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    (r"^[a-z0-9]+$", LOWER + DIGITS),
    (r"^[A-Z0-9]+$", UPPER + DIGITS),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
)
ANY = UPPER + LOWER + DIGITS + "+/-_"
#: Chance that two letters of ordinary words are equal; structured strings of few symbols are at least 1.6 times as
#: uneven as random ones.
COINCIDENCE, UNEVEN = 0.065, 1.6
#: Largest absolute z of runs and of serial correlation for a random token (two-sided 0.001).
GATE = 3.29
#: Lower ends of the length bands of the false-discovery control.
BANDS = (20, 24, 32, 48, 96)
#: p-values are binned by tenths of their decimal logarithm, down to 1e-30.
STEP, DEEPEST = 10, 300


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, token) of the leftmost non-overlapping matches, in code points."""
    gaps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, token: F.struct(F.length(gap).alias("gap"), F.length(token).alias("n"), token.alias("token")),
    )
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.when(x["token"].isNull(), acc).otherwise(
            F.struct(
                (start + x["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["token"].alias("token")))).alias("out"),
            )
        )

    # most texts hold no match and are scanned once only
    return F.when(text.rlike(pattern), F.aggregate(gaps, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]).otherwise(none)


def _lower_tail(z: Column) -> Column:
    """P(Z <= z) of the normal distribution, from Sampford's bound of the tail (within a few per cent, from above)."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * 4 / (x * 3 + F.sqrt(x * x + 8))
    return F.when(z <= 0, tail).otherwise(1 - tail)


def alphabet(token: Column) -> Column:
    chain = F
    for pattern, letters in ENCODINGS:
        chain = chain.when(token.rlike(pattern), F.lit(letters))
    return chain.otherwise(F.lit(ANY))


def p_value(token: Column) -> Column:
    """p of "no more random than words" for one token; 1 if its runs or neighbours are not random."""

    def battery(letters: Column) -> Column:
        n, k = F.length(token).cast("double"), F.length(letters).cast("double")
        chars = F.split(token, "")
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0))
        )
        values = F.transform(chars, lambda c: (F.instr(letters, c) - 1).cast("double"))
        return F.transform(F.array(F.struct(n.alias("n"), k.alias("k"), (squares * k / n - n).alias("chi2"), values.alias("v"))), _combine)[0]

    return F.transform(F.array(alphabet(token)), battery)[0]


def _combine(x: Column) -> Column:
    n, k, v = x["n"], x["k"], x["v"]
    shift = n * (F.greatest(k * COINCIDENCE, F.lit(UNEVEN)) - 1)
    z = (x["chi2"] - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift))
    # moments of the character values: sums of v, v * v, v * next v, highs, and changes between low and high
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "q", "x", "h", "r")], F.lit(-1.0).alias("last"))

    def add(acc: Column, value: Column) -> Column:
        high, was = value * 2 >= k, acc["last"] * 2 >= k
        first = acc["last"] < 0
        return F.struct(
            (acc["s"] + value).alias("s"),
            (acc["q"] + value * value).alias("q"),
            F.when(first, acc["x"]).otherwise(acc["x"] + value * acc["last"]).alias("x"),
            (acc["h"] + high.cast("double")).alias("h"),
            F.when(first, F.lit(1.0)).otherwise(acc["r"] + (high != was).cast("double")).alias("r"),
            value.alias("last"),
        )

    def decide(m: Column) -> Column:
        mean = m["s"] / n
        spread = m["q"] - n * mean * mean
        ends = v[0] + m["last"]
        serial = (m["x"] - mean * (2 * m["s"] - ends) + (n - 1) * mean * mean) / spread
        z_serial = (serial + 1 / n) * F.sqrt(n)
        pairs = 2 * m["h"] * (n - m["h"])
        z_runs = (m["r"] - pairs / n - 1) / F.sqrt(pairs * (pairs - n) / (n * n * (n - 1)))
        random = (spread > 0) & (pairs > n) & (F.abs(z_serial) < GATE) & (F.abs(z_runs) < GATE)
        return F.when(random, _lower_tail(z)).otherwise(F.lit(1.0))

    return F.transform(F.array(F.aggregate(v, start, add)), decide)[0]


def _bin(p: Column) -> Column:
    """Number of the bin whose upper end is 10 ** (-bin / STEP)."""
    return F.least(F.floor(-F.log10(p) * STEP), F.lit(DEEPEST)).cast("int")


def _band(n: Column) -> Column:
    return sum(((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))


def thresholds(found: DataFrame, fdr: float) -> DataFrame:
    """(band, least bin that is a discovery) by Benjamini-Hochberg in each band; a row for each band at most.

    The rule is applied to the upper ends of the bins, which errs on the safe side.
    """
    tokens = found.select(F.explode("candidates").alias("c")).select(_band(F.col("c.end") - F.col("c.start")).alias("band"), _bin(F.col("c.p")).alias("bin"))
    counted = tokens.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("m"))
    deeper = W.partitionBy("band").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.withColumn("rank", F.sum("m").over(deeper)).withColumn("all", F.sum("m").over(W.partitionBy("band")))
    passing = F.pow(F.lit(10.0), -F.col("bin") / STEP) * F.col("all") <= fdr * F.col("rank")
    return ranked.filter(passing).groupBy("band").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, fdr: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and arrays of (start, end) spans: assign, access, hex, random."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["end"]))
    assign = F.filter(located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 6)
    tested = F.transform(located(text, CANDIDATE), lambda s: F.struct(s["start"], s["end"], p_value(s["token"]).alias("p")))
    found = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            bare(assign).alias("assign"),
            bare(located(text, ACCESS)).alias("access"),
            bare(located(text, HEX)).alias("hex"),
            tested.alias("candidates"),
        )
    )
    limits = thresholds(found, fdr).agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("limits"))
    base = F.concat("assign", "access", "hex")

    def discovered(c: Column) -> Column:
        return _bin(c["p"]) >= F.coalesce(F.col("limits")[_band(c["end"] - c["start"])], F.lit(DEEPEST + 1))

    def apart(c: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    # a single-row scalar subquery: at most one limit for each band
    return found.withColumn("limits", limits.scalar()).select(
        "doc_id", "assign", "access", "hex", bare(F.filter("candidates", lambda c: discovered(c) & apart(c))).alias("random")
    )


def _joined(*kinds: str) -> Column:
    """kind:start:end of the spans by start, then kind as listed, joined by commas."""

    def tagged(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts, the digest of the base spans and the text of all spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined("assign", "access", "hex"), 256).alias("base_sha256"),
        _joined("assign", "access", "hex", "random").alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
