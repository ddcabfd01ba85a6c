"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token starts as its byte symbols, the last one marked as the end of a word. A segment tree holds the merge
rank of every adjacent pair; its root gives the leftmost pair of the lowest rank. A merge updates three leaves in
logarithmic time, until the root holds no rank.

Short pre-tokens are merged many at a time: their trees are rows of one numpy array, and each round takes the root of
every row and makes its three updates. Long ones have a tree of their own. A worker remembers what pieces of text
between white space gave, up to a bound in bytes.

Null and empty texts have no tokens and decode to an empty text. Further columns are ignored; repeated rows each
get a result. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs

#: Rank of pairs that do not merge.
NO_RANK = 1 << 40

#: Code points that Unicode made letters or numbers after version 16, which the tokenizer file is read with.
LATER = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 "
    "A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 "
    "11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)

#: Capitals that version 16 pairs with another small letter than Python's tables: first-last:distance.
LOWER_16 = (
    "1C89-1C89:+1 A7CB-A7CB:-42343 A7CC-A7CC:+1 A7CE-A7CE:+1 A7D2-A7D2:+1 A7D4-A7D4:+1 A7DA-A7DA:+1 "
    "A7DC-A7DC:-42561 10D50-10D65:+32 16EA0-16EB8:+27"
)


def spans(listed: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in (x.split("-") for x in listed.split())]


def moves(listed: str) -> list[tuple[int, int, int]]:
    return [(*spans(at)[0], int(by)) for at, by in (x.split(":") for x in listed.split())]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else one from 256 upwards."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class MergeTree:
    """Leaves: rank of the pair that starts at each symbol. Nodes: the lowest key of their half, leftmost on ties.

    A key is rank * size + position, so the minimum is the leftmost pair of the lowest rank.
    """

    __slots__ = ("size", "node")

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        self.node = [NO_RANK * size] * size + [r * size + i for i, r in enumerate(ranks)] + [NO_RANK * size] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        a, b = self.node[2 * i], self.node[2 * i + 1]
        self.node[i] = a if a <= b else b

    def set(self, at: int, rank: int) -> None:
        i = self.size + at
        self.node[i] = rank * self.size + at
        i //= 2
        while i:
            a, b = self.node[2 * i], self.node[2 * i + 1]
            low = a if a <= b else b
            if self.node[i] == low:
                break
            self.node[i] = low
            i //= 2

    def best(self) -> tuple[int, int]:
        """(rank, position) of the root."""
        return divmod(self.node[1], self.size)


class Memory:
    """Results of pieces of text in two generations, each bounded in bytes; what is asked for moves to the younger."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def take(self, piece: str) -> tuple[bytes, str] | None:
        """From the older generation; the younger one is for the caller to ask first."""
        made = self.old.pop(piece, None)
        if made is not None:
            self.put(piece, made)
        return made

    def put(self, piece: str, made: tuple[bytes, str]) -> None:
        cost = 350 + 4 * len(piece) + len(made[0]) + 4 * len(made[1])
        if cost > self.limit // 64:
            return
        if self.used + cost > self.limit:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[piece] = made
        self.used += cost


class WordBpe:
    """Encoder and decoder for a tokenizer file of the word-end BPE kind."""

    #: Bytes, by estimate, that each of the two generations of remembered pieces may take in a worker.
    REMEMBER = 96 << 20
    #: Pre-tokens of up to so many bytes are merged side by side, so many at a time; longer ones alone.
    SHORT, ROWS = 65, 4096

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        self.letter = byte_letters()
        self.plain = [self.vocab[c] for c in self.letter]
        self.last = [self.vocab[c + self.suffix] for c in self.letter]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # arrays for merging side by side; symbols count from 1 there, 0 is no symbol
        self.base = max(self.token) + 2
        pairs = np.array([(a + 1) * self.base + b + 1 for a, b in self.rank], np.int64)
        ranks = np.array([r for r, _ in self.rank.values()], np.int64)
        self.made = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        self.made[ranks] = [i + 1 for _, i in self.rank.values()]
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = np.append(pairs[order], np.int64(1) << 62), np.append(ranks[order], NO_RANK)
        self.plain_row, self.last_row = np.array(self.plain, np.int64) + 1, np.array(self.last, np.int64) + 1
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.early = regex.compile(split)  # for texts without any letter or number as late as that
        self.beyond = regex.compile(f"[\\U{spans(LATER)[0][0]:08X}-\\U0010FFFF]")
        later = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans(LATER))
        for kind in ("L", "N"):  # version 1 sets of the regex module can subtract
            split = split.replace(f"[\\p{{{kind}}}]", f"[\\p{{{kind}}}--[{later}]]")
        rest = "[^\\s\\p{L}\\p{N}]+"
        split = split.replace(rest, f"(?:{rest[:-1]}|[{later}])+")
        self.split = regex.compile(split, regex.V1)
        self.lower = {c: c + d for a, b, d in moves(LOWER_16) for c in range(a, b + 1)}
        self.capitals = regex.compile("[" + "".join(map(chr, self.lower)) + "]")
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.memory = Memory(self.REMEMBER)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.plain[b] for b in data[:-1]] + [self.last[data[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        none = (NO_RANK, 0)
        tree = MergeTree([self.rank.get((ids[i], ids[i + 1]), none)[0] for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        while True:
            rank, at = tree.best()
            if rank >= NO_RANK:
                return [x for x, a in zip(ids, alive, strict=True) if a]
            right = after[at]
            ids[at] = self.rank[ids[at], ids[right]][1]
            alive[right] = False
            after[at] = after[right]
            if right < n - 1:
                tree.set(right, NO_RANK)
            if after[at] < n:
                before[after[at]] = at
                tree.set(at, self.rank.get((ids[at], ids[after[at]]), none)[0])
            else:
                tree.set(at, NO_RANK)
            if before[at] >= 0:
                tree.set(before[at], self.rank.get((ids[before[at]], ids[at]), none)[0])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of symbols, NO_RANK for those that do not merge."""
        key = a * self.base + b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NO_RANK)

    def merge_rows(self, pieces: list[bytes], depth: int) -> list[np.ndarray]:
        """Ids of pre-tokens of 1 to 2 ** depth + 1 bytes, whose segment trees are the rows of one array."""
        leaves = 1 << depth
        n, wide = len(pieces), leaves + 2
        length = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(wide)
        there = column[None] < length[:, None]
        bytes_ = np.zeros((n, wide), np.int64)
        bytes_[there] = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = np.where(there, np.where(column[None] == length[:, None] - 1, self.last_row[bytes_], self.plain_row[bytes_]), 0)
        node = np.full((n, 2 * leaves), NO_RANK * leaves, np.int64)
        node[:, leaves:] = self._ranks(symbol[:, :leaves], symbol[:, 1 : leaves + 1]) * leaves + column[:leaves]
        for level in range(depth - 1, -1, -1):
            low = 1 << level
            node[:, low : 2 * low] = np.minimum(node[:, 2 * low : 4 * low : 2], node[:, 2 * low + 1 : 4 * low : 2])
        after = np.tile(column + 1, (n, 1)).ravel()
        before = np.tile(np.append(leaves + 1, column[:-1]), (n, 1)).ravel()  # the last column stands for "none"
        symbol, node = symbol.ravel(), node.ravel()
        rows = np.arange(n)
        while len(rows):
            root = node[rows * (2 * leaves) + 1]
            live = root < NO_RANK * leaves
            if not live.all():
                rows, root = rows[live], root[live]
                if not len(rows):
                    break
            s, t = rows * wide, rows * (2 * leaves)
            at = root & (leaves - 1)
            right, left = after[s + at], before[s + at]
            beyond = after[s + right]
            new = self.made[root >> depth]
            symbol[s + at], symbol[s + right] = new, 0
            after[s + at], before[s + beyond] = beyond, at
            leaf = np.concatenate([np.minimum(right, leaves - 1), np.where(left <= leaves, left, at), at])
            # in this order: without a left neighbour, and at the last symbol, the pair's own leaf is written last
            node[t + leaves + leaf[: len(rows)]] = NO_RANK * leaves
            node[t + leaves + leaf[len(rows) : 2 * len(rows)]] = self._ranks(symbol[s + left], new) * leaves + leaf[len(rows) : 2 * len(rows)]
            node[t + leaves + at] = self._ranks(new, symbol[s + beyond]) * leaves + at
            three, up = np.concatenate([t, t, t]), leaf + leaves
            for _ in range(depth):
                up >>= 1
                node[three + up] = np.minimum(node[three + 2 * up], node[three + 2 * up + 1])
        symbol = symbol.reshape(n, wide)
        left_over = symbol > 0
        return np.split((symbol[left_over] - 1).astype("<u4"), np.cumsum(left_over.sum(1))[:-1])

    def merge_all(self, pieces: list[str]) -> dict[str, np.ndarray]:
        """Ids of distinct pre-tokens."""
        out: dict[str, np.ndarray] = {}
        rows: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if len(data) > self.SHORT:
                out[piece] = np.array(self.merge(data), "<u4")
            else:
                rows.setdefault(max(0, len(data) - 2).bit_length(), []).append((piece, data))
        for depth, some in rows.items():
            for i in range(0, len(some), self.ROWS):
                part = some[i : i + self.ROWS]
                out.update(zip([p for p, _ in part], self.merge_rows([d for _, d in part], depth), strict=True))
        return out

    def learn(self, pieces: list[str]) -> dict[str, tuple[bytes, str]]:
        """(ids as little-endian words, decoded tokens joined by spaces) of distinct pieces between white space."""
        split = {}
        for piece in pieces:
            text = self.normal(piece)
            split[piece] = (self.split if self.beyond.search(text) else self.early).findall(text)
        ids = self.merge_all(list(dict.fromkeys(w for words in split.values() for w in words)))
        shown = {w: " ".join([self.token[i] for i in x.tolist()]) for w, x in ids.items()}
        made = {p: (b"".join([ids[w].tobytes() for w in words]), " ".join([shown[w] for w in words])) for p, words in split.items()}
        for p, x in made.items():
            self.memory.put(p, x)
        return made

    def normal(self, text: str) -> str:
        """NFC, lower-cased letter by letter (a final sigma is no special case)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.capitals.search(text):
                text = text.translate(self.lower)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[str | int]:
        """The text between white space, and ids of special tokens, taken from the raw text first."""
        if "<|" not in text:
            return self._pieces(text)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self._pieces(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._pieces(text[at:])

    @staticmethod
    def _pieces(text: str) -> list[str]:
        # no pre-token holds white space, and neither letter case nor composition reaches across it; the four
        # separators are white space to str.split but not to the pattern
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in text.replace("\n", " ").split(" ") if x]
        return text.split()

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian words, decoded text) of each text."""
        split = [self.pieces(t) for t in texts]
        known: dict[str | int, tuple[bytes, str]] = {}
        young, take = self.memory.young, self.memory.take
        asked = set().union(*split)
        unknown = []
        for x in asked:
            if isinstance(x, int):
                known[x] = (np.array([x], "<u4").tobytes(), self.token[x])
            elif (made := young.get(x) or take(x)) is not None:
                known[x] = made
            else:
                unknown.append(x)
        if unknown:
            known |= self.learn(unknown)
        out = []
        for pieces in split:
            made = [known[x] for x in pieces]
            out.append((b"".join([m[0] for m in made]), " ".join([m[1] for m in made if m[1]])))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder gives them."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def round_trip(
    docs: DataFrame, path: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", with_ids: bool = True, batch_chars: int = 2_000_000
) -> DataFrame:
    """The id columns, n_tokens, decoded, and ids (binary, little-endian unsigned 32-bit) if asked for.

    Texts are encoded `batch_chars` code points at a time; a longer text makes a batch of its own.
    """
    names = list(id_cols)
    kinds = docs.select(*names).schema
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["n_tokens long", "ids binary", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            column = b.column(len(names))
            for at, n in runs(column, batch_chars):
                done = bpe.encode_all([t or "" for t in column.slice(at, n).to_pylist()])
                ids = [i for i, _ in done]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(at, n) for c in b.columns[: len(names)]),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([d for _, d in done], pa.string()),
                    ],
                    names=[*names, "n_tokens", "ids", "decoded"],
                )

    out = docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, full)
    return out if with_ids else out.drop("ids")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return round_trip(rows, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


