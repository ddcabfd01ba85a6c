"""Benchmark decontamination with one Aho-Corasick automaton.

Words are maximal runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased. Every run of
`width` consecutive words of a benchmark item is a pattern; an item of fewer words, but not none, is one pattern.
A text is scanned once; ends of matches are mapped back to word numbers and, on request, to character offsets.

Nulls and empty texts have no words. Items with a null id still hit words but are not named. An empty benchmark
hits nothing. Repeated rows each get a result. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Bytes of a text to bytes of its normal form: A-Z lower-cased, other ASCII than letters and digits to a space.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code-point bounds of each word in the original text."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


class Automaton:
    """Windows of benchmark items as one automaton over words joined by single spaces."""

    def __init__(self, items: list[tuple[object, bytes]], width: int):
        patterns: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - width + 1) if words else 0):
                window = words[i : i + width]
                found = patterns.setdefault(f" {b' '.join(window).decode()} ", (len(window), set()))[1]
                if item is not None:
                    found.add(str(item))
        self.automaton = ahocorasick.Automaton()
        for p, (n, names) in patterns.items():
            self.automaton.add_word(p, (n, tuple(names)))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [start, end) of all matches, and the ids of the items they come from."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if self.empty or not words:
            return spans, names
        hits = list(self.automaton.iter(f" {b' '.join(words).decode('utf-8', 'replace')} "))
        if hits:
            lengths = np.fromiter((len(w.decode("utf-8", "replace")) + 1 for w in words), np.int64, len(words))
            ends = np.cumsum(lengths)  # where the space behind each word stands
            last = np.searchsorted(ends, [e for e, _ in hits])
            for at, (_, (n, ids)) in zip(last.tolist(), hits, strict=True):
                spans.append((at + 1 - n, at + 1))
                names.update(ids)
        return spans, names


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BUILT: dict[tuple, Automaton] = {}


def _built(key: tuple, items: list[tuple[object, bytes]], width: int) -> Automaton:
    """The worker's automaton for a part of the benchmark; only a few are held at once."""
    if key not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        _BUILT[key] = Automaton(items, width)
    return _BUILT[key]


def _scan(docs: DataFrame, items: list[tuple[object, bytes]], width: int) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) of each row, against one automaton built once a worker."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    key = (xxhash.xxh3_128_hexdigest(repr(items).encode()), width)
    schema = docs.select(F.col("doc_id")).schema
    full = f"doc_id {schema[0].dataType.simpleString()}, n_words long, starts array<int>, ends array<int>, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _built(key, sent.value, width)
        for b in batches:
            out: list[tuple] = []
            for text in utf8(b.column(1)):
                words = normal_words(text)
                spans, names = found.scan(words)
                union = covered(spans)
                out.append((len(words), [a for a, _ in union], [z for _, z in union], sorted(names)))
            n, starts, ends, names = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "starts", "ends", "items"],
            )

    return docs.mapInArrow(run, full)


def _parts(benchmark: DataFrame, max_bytes: int, item_col: str, item_text_col: str) -> tuple[int, Callable[[int], list[tuple[object, bytes]]]]:
    """How many parts of at most about max_bytes the benchmark makes, and the items of each."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, -(-size // max_bytes))

    def part(k: int) -> list[tuple[object, bytes]]:
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("body"), F.lit(parts)) == k)
        return [(r.item, r.body.encode()) for r in chosen.collect()]

    return parts, part


def _has_window(sent: Broadcast, key: tuple, width: int):
    """A column function: whether a text holds a window of the part of the benchmark that was sent."""

    def hit(text: pa.Array) -> pa.Array:
        found = _built(key, sent.value, width)
        return pa.array([bool(found.scan(normal_words(t))[0]) for t in utf8(text)], pa.bool_())

    return F.arrow_udf(hit, "boolean")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a window of the benchmark, with their columns."""
    parts, part = _parts(benchmark, max_bytes, item_col, item_text_col)
    out = docs
    for k in range(parts):
        items = part(k)
        sent = docs.sparkSession.sparkContext.broadcast(items)
        key = (xxhash.xxh3_128_hexdigest(repr(items).encode()), width)

        out = out.filter(~_has_window(sent, key, width)(F.col(text_col)))
    return out


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, starts and ends of the hit word intervals, items found.

    A benchmark of at most `max_bytes` is broadcast and makes one automaton. A larger one is dealt by a hash of its
    text into as many parts as needed, each within the bound; the documents are scanned against each part and the
    hits merged by row.
    """
    parts, part = _parts(benchmark, max_bytes, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    if parts == 1:
        return _scan(rows, part(0), width)
    # rows are told apart by id, text and how often the pair has come before; equal rows have equal hits
    marked = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    ids = marked.select(F.struct("doc_id", "mark").alias("doc_id"), "text")
    each = [_scan(ids, part(k), width) for k in range(parts)]
    union = each[0]
    for more in each[1:]:
        union = union.unionByName(more)
    merged = union.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.lit(1)).alias("copies"),
        F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    apart = merged.withColumn("again", F.explode(F.sequence(F.lit(1), (F.col("copies") / parts).cast("int"))))
    joined = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<starts:int,ends:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= s["starts"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return apart.select("doc_id.doc_id", "n_words", joined.alias("spans"), "items").select("doc_id", "n_words", "spans.starts", "spans.ends", "items")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of `find`."""
    named = F.array_join(F.array_sort("items"), ",")
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda acc, s: acc + (s["ends"] - s["starts"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256")
    ).withColumn("contaminated", F.col("n_hit") > 0)


def spans_of(text: str, intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of word intervals."""
    at = word_offsets(text)
    return [(at[a][0], at[b - 1][1]) for a, b in intervals]


__all__ = ["Automaton", "clean", "covered", "find", "normal_words", "report", "spans_of", "word_offsets"]
