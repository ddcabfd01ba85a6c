"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

Fixed patterns find e-mail addresses, IP addresses, payment cards and international phone numbers. A conditional
random field (CRF) labels the words of each line as parts of a person's name, of a personal number (national phone
numbers, identity and account numbers, cards that fail the check digit) or of a spelled-out contact. It is trained
on the driver from a small labelled table of at most MAX_TOKENS tokens, is a few kilobytes, and is decoded by Viterbi
in numpy over batches of lines, sorted by length.

Nulls and empty texts have no spans. Repeated rows each get a result. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, sha

# --- fixed patterns -------------------------------------------------------------------------------------------------

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot start inside a run of digits: the run's start would match as well
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, in linear time."""
    out: list[Span] = []
    done = at = 0
    while (m := DOMAIN.search(text, at)) is not None:
        start = m.start()
        while start > done and text[start - 1] in LOCAL:  # no further than the last @, which is no local character
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            done = at = m.end()
        else:
            at = m.start() + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if ANY_DIGIT.search(text) is None:
        return found
    if "." in text:
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return found


# --- features -------------------------------------------------------------------------------------------------------

LABELS = ("O", "B-person", "I-person", "B-number", "I-number", "B-contact", "I-contact")
KINDS = ("person", "number", "contact")
BEGINS = [i for i, x in enumerate(LABELS) if x[0] == "B"]
INSIDES = [i for i, x in enumerate(LABELS) if x[0] == "I"]
#: Common given names, which a name may begin with where nothing announces it.
GIVEN = (
    "Anna Peter Maria Juan Sophie Luca Hans Claire Miguel Ingrid Paul Elena John Mary James Linda Robert Susan Michael Karen David Nancy William Lisa Richard Sarah Thomas Emma "
    "Daniel Laura Mark Julia George Alice Kevin Helen Brian Ruth Edward Jane Wolfgang Ursula Klaus Sabine Jürgen Monika Stefan Petra Andreas Heike Martin Birgit Uwe Katrin Dieter "
    "Renate Pierre Marie Jean Isabelle Michel Nathalie Philippe Camille Jacques Amélie François Chloé José Carmen Antonio Isabel Manuel Lucía Francisco Pilar Javier Sofía Carlos "
    "Marta Diego Rosa Pablo Teresa Lars Karin Erik Astrid Marco Giulia Giovanni Francesca Ivan Olga Dmitri Natasha Ahmed Fatima Ali Leila Wei Yuki Hiroshi Priya Ravi Amir"
).split()
#: Fixed words that announce personal data, in four languages, by what they announce.
CUES = {
    "title": "mr mrs ms dr prof herr frau señor señora sr sra monsieur madame mme don doña",
    "name": "name named nombre nom contact kontakt contacto ansprechpartner signed dear sincerely",
    "phone": "tel phone telefon teléfono téléphone mobile mobil móvil fax call",
    "card": "card karte tarjeta carte visa mastercard",
    "id": "id ssn passport ausweis dni nif iban account konto cuenta compte steuernummer",
    "mail": "email e-mail mail correo courriel",
    "at": "at (at) [at] arroba",
    "dot": "dot (dot) [dot] punkt punto point",
    "zone": "com org net de es fr info",
    "given": " ".join(GIVEN).lower(),
}
CUE_OF = {w: i + 1 for i, words in enumerate(CUES.values()) for w in words.split()}
EDGES = ".,;:!?()[]{}\"'*#$%&|<>«»“”"


def shape(word: str) -> str:
    """X for capitals, x for other letters, d for digits, else the character; digit runs keep up to six places,
    letter runs two."""
    out: list[str] = []
    last, run = "", 0
    for c in word:
        k = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        run = run + 1 if k == last else 1
        last = k
        if run <= (6 if k == "d" else 2):
            out.append(k)
    return "".join(out)


class Features(dict):
    """Types of words (as UTF-8): shape number * cue classes + cue class. Shapes outside the training table share
    number 0."""

    REMEMBER = 300_000

    def __init__(self, shapes: dict[str, int]):
        super().__init__()
        self.shapes = shapes

    def __reduce__(self):  # sent to workers without the words seen so far
        return Features, (self.shapes,)

    def __missing__(self, data: bytes) -> int:
        if len(self) >= self.REMEMBER:
            self.clear()
        word = data.decode("utf-8", "replace")
        bare = word.strip(EDGES) or word
        cue = CUE_OF.get(word.lower()) or CUE_OF.get(bare.lower(), 0)
        ends = word[-1] if word[-1] in ".:,;!?" and len(word) > 1 else ""
        made = self[data] = self.shapes.get(shape(bare) + ends, self.shapes.get(shape(bare), 0)) * (len(CUES) + 1) + cue
        return made

    def sequence(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Crf:
    """Linear-chain CRF: weights of the word's own, previous two and next types, and of label transitions."""

    PLACES = (0, -1, -2, 1)

    def __init__(self, features: Features, own: np.ndarray, trans: np.ndarray):
        """own: places x types x labels, already summed over a type's shape and cue; trans: labels x labels."""
        self.features, self.own, self.trans = features, own, trans
        allowed = np.where(t_forbidden(), -np.inf, trans)
        at_most, plain = float(allowed.max()), float(trans[0, 0])
        #: Most that a word gains over "other" from one transition; most that paths through m other labels gain a word
        #: over m words of "other", between two of those or at an end of the line.
        self.lift = at_most - plain
        inner = np.zeros(len(LABELS) - 1)
        through, least = allowed[1:, 1:], self.lift
        start, back = allowed[0, 1:], allowed[1:, 0]
        ways = [start, inner]
        for m in range(1, 65):
            between, opening = ways
            gains = [(between + back).max() - (m + 1) * plain, between.max() - m * plain, (opening + back).max() - m * plain, opening.max() - (m - 1) * plain]
            least = max(least, float(max(gains)) / m)
            ways = [(w[:, None] + through).max(0) for w in ways]
        self.anchor = least
        #: Most that transitions lose where a run of other labels is ended early, or begun late.
        self.end_loss = at_most - float(back.min())
        begins = allowed[[[b] for b in BEGINS], :]
        self.begin_loss = 2 * at_most - float(allowed[0, BEGINS].min()) - float(begins[np.isfinite(begins)].min())

    def emissions(self, types: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of each word and label in a run of lines; first marks where lines start (types of no word: -1)."""
        n = len(types)
        line = np.cumsum(first, dtype=np.int32)
        out = self.own[0][types]
        for k, place in enumerate(self.PLACES[1:], 1):
            if place < 0:
                there = np.arange(-place, n)
                ok = line[there] == line[there + place]
                out[there[ok]] += self.own[k][types[there[ok] + place]]
            else:
                there = np.arange(0, max(0, n - place))
                ok = line[there] == line[there + place]
                out[there[ok]] += self.own[k][types[there[ok] + place]]
        return out

    def decode(self, types: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of lines laid end to end, by Viterbi over blocks of stretches of similar length.

        Only stretches that may hold other labels are decoded, with "other" on both sides, which loses nothing. A run
        of other labels holds an anchor: a word whose score for one of them comes within `anchor` of "other". The words
        after its last anchor are in it only while their worth (by how much the score of a label other than "other" and
        `lift` exceed that of "other") adds up to -`end_loss` or more, or else ending it before them scores better; the
        words before an anchor only while theirs adds up to -`begin_loss` less what the anchor loses as a beginning.
        Stretches reach one word further, so where two of them do not meet, "other" stands between.
        """
        labels = np.zeros(len(types), np.int8)
        if not len(types):
            return labels
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        line_of = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(types), np.int64)
        first[starts[sizes > 0]] = 1
        score = self.emissions(types, first)
        gap = score[:, 1:].max(1) - score[:, 0]
        anchors = np.flatnonzero(gap >= -self.anchor)
        if not len(anchors):
            return labels
        fall = np.cumsum(np.where(gap >= -self.anchor, 0.0, -(gap + self.lift)), dtype=np.float64)  # rises at every other word
        loss = np.maximum((score[anchors][:, INSIDES] - score[anchors][:, BEGINS]).max(1), 0) + self.begin_loss
        line_start, line_end = starts[line_of[anchors]], starts[line_of[anchors]] + sizes[line_of[anchors]]
        right = np.searchsorted(fall, fall[anchors] + self.end_loss, "right") + 1
        left = np.searchsorted(fall, np.where(anchors > 0, fall[anchors - 1], 0.0) - loss, "left")
        edge = np.zeros(len(types) + 1, np.int64)
        np.add.at(edge, np.maximum(left, line_start), 1)
        np.subtract.at(edge, np.minimum(right, line_end), 1)
        near = np.cumsum(edge[:-1]) > 0
        begin = np.flatnonzero(near & np.r_[True, ~near[:-1] | (line_of[1:] != line_of[:-1])])
        last = np.flatnonzero(near & np.r_[~near[1:] | (line_of[1:] != line_of[:-1]), True])
        starts, sizes = begin, last + 1 - begin
        inner = np.flatnonzero(first[starts] == 0)
        score[starts[inner]] += self.trans[0]
        after = np.flatnonzero(np.r_[first, 1][last + 1] == 0)
        score[last[after]] += self.trans[:, 0]
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 4096):
            block = order[at : at + 4096]
            m = sizes[block]
            steps, b = int(m.max()), len(block)
            best = score[starts[block]]
            back = np.zeros((steps, b, len(LABELS)), np.int8)
            final = np.where((m == 1)[:, None], best, np.float32(0))
            for t in range(1, steps):
                live = m > t
                where = starts[block] + np.minimum(t, m - 1)
                way = best[:, :, None] + self.trans[None]
                back[t] = way.argmax(1)
                best = way.max(1) + score[where]
                done = live & (m == t + 1)
                final[done] = best[done]
            now = final.argmax(1).astype(np.int64)
            rows = np.arange(b)
            for t in range(steps - 1, -1, -1):
                live = m > t
                labels[starts[block][live] + t] = now[live]
                if t:
                    step = back[t, rows, now]
                    now = np.where(live, step, now)
        return labels


# --- training -------------------------------------------------------------------------------------------------------

#: Bound of the labelled table.
MAX_TOKENS = 40_000
FAMILY = "Miller Schmidt García Dubois Rossi Jensen López Bernard Wagner Smith Moreau Keller Carter O'Brien Müller-Lüdenscheidt Mozart Nguyen Fernández McDonald Lefèvre".split()
PARTICLES = "von de van der la del di le zu dos".split()
SYLLABLES = "an er on th re en ti es ing ou sch keit lich eau oi que ado mente ción ra".split()
DOMAINS = "example mail post home".split()
#: Labelled templates: {name} and so on are filled, other words are "other". The text before a slot may announce it.
TEMPLATES = (
    "My name is {name} {w} {w} {w}", "{full} {w} {w} {w}", "{w} {w} {full} {w}", "{w} {w}. {full} , {w} {w}",
    "{w} {w} Mr. {name} {w} {w}", "{w} Frau {name} , {w} {w} {w}", "Señora {name} {w} {w}", "{w} {w} Mme {name} {w}",
    "Name: {name}", "Kontakt: {name} , Tel. {tel}", "{w} Dr. {name} {w} {w} {w}", "Dear {name} , {w} {w}",
    "{w} {w} Tel. {tel} {w}", "Phone: {tel}", "{w} {w} call {tel} {w} {w}", "{w} {w} {w} {tel} {w} {w}", "Teléfono {tel} {w} {w}",
    "{w} {w} {digits} {w} {w} {w}", "Card: {digits}", "{w} Karte {digits} , {w} {w}", "{w} {w} {w} {digits} {digits} {w}",
    "{w} SSN {ssn} {w}", "{w} {w} {w} {ssn} {w} {w}", "IBAN {iban} {w}", "{w} {w} Konto {iban} {w}",
    "{w} {w} e-mail {mail} {w}", "E-Mail: {mail}", "{w} {w} {w} {mail} {w} {w}", "Correo {mail}",
    "{w} {w} {w} {w} {w} {w} {w} {w}", "{W} {w} {w} {w} {w}. {W} {w} {w} {w}.", "{W}. {w} {w}, {W} {w} {w}.", "{U} {U} {U} {U}",
    "{w} {w} {year} {w} {w}", "{w} {n} {w} {w} {n} {w}", "{w} {w} {price} {w} {w}", "{w} | {w} | {w} | {w}", "{s} {s} {s} {s}",
    "Version {version} {w} {w}", "{w} {w} {ip} {w} {w}", "{w} {w} {date} {w}", "{w} card {w} {w} {w} call {w}", "{w} at {w} {w} point {w}", "{W} {w}. At. {W} {w}", "{w} {w} at. {W} {W} {w}", "{W} de de de {w} at at {w}",
    "{w} token = {hex} {w}", "{w} {w} {email} {w} {w}", "{w} {W} {W} {w} {w}", "{w} de {W} {w}, {w} Name {w} {w}",
)


def labelled_rows(seed: int, each: int) -> list[tuple[list[str], list[str]]]:
    """The labelled table: `each` fillings of every template, as words and labels."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def fill(slot: str) -> tuple[str, str]:
        if slot == "name":
            given = " ".join(r.sample(GIVEN, r.choice([1, 1, 1, 2, 3])))
            family = f"{r.choice(PARTICLES)} {r.choice(FAMILY)}" if r.random() < 0.15 else r.choice(FAMILY)
            return "person", f"{given} {family}" if r.random() < 0.7 else r.choice(FAMILY)
        if slot == "full":
            return "person", f"{r.choice(GIVEN)} {r.choice([r.choice(FAMILY), word().capitalize(), r.choice(PARTICLES) + ' ' + r.choice(FAMILY)])}"
        if slot == "tel":
            return "number", r.choice(["({a}) {b}-{c}", "{a}-{b}-{c}", "0{a} {d}", "0{b} / {d}", "{a} {b} {c}", "0{a}-{d}"]).format(a=digits(3), b=digits(3), c=digits(4), d=digits(6))
        if slot == "digits":
            return "number", digits(r.choice([14, 15, 16, 16, 16])) if r.random() < 0.7 else " ".join(digits(4) for _ in range(4))
        if slot == "ssn":
            return "number", f"{digits(3)}-{digits(2)}-{digits(4)}"
        if slot == "iban":
            return "number", f"{r.choice(['DE', 'FR', 'ES'])}{digits(2)} " + " ".join(digits(4) for _ in range(5))
        if slot == "mail":
            at, dot = r.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")])
            local = f"{word()} {dot} {word()}" if r.random() < 0.3 else word()
            return "contact", f"{local} {at} {r.choice(DOMAINS)} {dot} {r.choice(['com', 'org', 'net', 'de'])}"
        plain = {
            "w": word(),
            "W": word().capitalize(),
            "U": word().upper() + "!!",
            "s": word() + r.choice(["***", "%%%", "&&&", "$$$", "###"]),
            "year": str(r.randint(1900, 2030)),
            "n": digits(r.randint(1, 5)),
            "price": f"{digits(2)}.{digits(2)}",
            "version": f"{r.randint(0, 9)}.{r.randint(0, 20)}",
            "ip": ".".join(str(r.randint(0, 255)) for _ in range(4)),
            "date": f"{digits(2)}.{digits(2)}.{r.randint(1990, 2030)}",
            "hex": '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"',
            "email": f"{word()}.{digits(2)}@mail.example.com",
        }
        return "", plain[slot]

    rows = []
    for _ in range(each):
        for template in TEMPLATES:
            words: list[str] = []
            labels: list[str] = []
            for part in template.split():
                m = re.fullmatch(r"\{(\w+)\}(\W*)", part)
                kind, text = fill(m.group(1)) if m else ("", part)
                for i, x in enumerate(f"{text}{m.group(2) if m else ''}".split()):
                    words.append(x)
                    labels.append(f"{'BI'[min(i, 1)]}-{kind}" if kind else "O")
            if r.random() < 0.3 and words[-1][-1].isalnum():
                words[-1] += "."
            rows.append((words, labels))
    return rows


@cache
def trained(seed: int, each: int) -> Crf:
    """The model of the labelled table with that seed, trained once in a driver's life."""
    return train(labelled_rows(seed, each))


def train(rows: list[tuple[list[str], list[str]]], steps: int = 120, ridge: float = 0.01) -> Crf:
    """Maximum likelihood with a ridge penalty, by Adam over the whole table."""
    if sum(len(w) for w, _ in rows) > MAX_TOKENS:
        raise ValueError(f"the labelled table is bounded to {MAX_TOKENS} tokens")
    shapes: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            bare = w.strip(EDGES) or w
            for s in (shape(bare), shape(bare) + (w[-1] if w[-1] in ".:,;!?" and len(w) > 1 else "")):
                shapes.setdefault(s, len(shapes) + 1)
    features = Features(shapes)
    n_cue, n_shape, n_label = len(CUES) + 1, len(shapes) + 1, len(LABELS)
    longest = max(len(w) for w, _ in rows)
    b = len(rows)
    none = n_shape * n_cue  # no word at this place
    types = np.full((b, longest + 3), none, np.int64)
    gold = np.zeros((b, longest), np.int64)
    size = np.array([len(w) for w, _ in rows])
    for i, (words, labels) in enumerate(rows):
        types[i, 2 : 2 + len(words)] = features.sequence([w.encode() for w in words])
        gold[i, : len(labels)] = [LABELS.index(x) for x in labels]
    mask = np.arange(longest)[None] < size[:, None]
    at = [types[:, 2 + p : 2 + p + longest] for p in Crf.PLACES]
    shape_of = [np.where(a == none, n_shape, a // n_cue) for a in at]
    cue_of = [np.where(a == none, n_cue, a % n_cue) for a in at]
    k = len(Crf.PLACES)
    weights = {"s": np.zeros((k, n_shape + 1, n_label)), "c": np.zeros((k, n_cue + 1, n_label)), "t": np.zeros((n_label, n_label))}
    moment = {x: (np.zeros_like(v), np.zeros_like(v)) for x, v in weights.items()}
    hot = np.eye(n_label)[gold] * mask[:, :, None]
    rows_at = np.arange(b)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = sum(weights["s"][p][shape_of[p]] + weights["c"][p][cue_of[p]] for p in range(k))
        t = weights["t"]
        a = np.zeros((longest, b, n_label))
        z = np.zeros((longest, b, n_label))
        a[0] = e[:, 0]
        for i in range(1, longest):
            a[i] = np.where(mask[:, i, None], lse(a[i - 1][:, :, None] + t[None], 1) + e[:, i], a[i - 1])
        total = lse(a[longest - 1], 1)
        for i in range(longest - 2, -1, -1):
            z[i] = np.where(mask[:, i + 1, None], lse(t[None] + (e[:, i + 1] + z[i + 1])[:, None, :], 2), 0.0)
        marginal = np.exp(np.transpose(a + z, (1, 0, 2)) - total[:, None, None]) * mask[:, :, None]
        gap = hot - marginal
        gradient = {"s": np.zeros_like(weights["s"]), "c": np.zeros_like(weights["c"]), "t": np.zeros_like(t)}
        for p in range(k):
            np.add.at(gradient["s"][p], shape_of[p], gap)
            np.add.at(gradient["c"][p], cue_of[p], gap)
        for i in range(1, longest):
            on = mask[:, i]
            joint = np.exp(a[i - 1][:, :, None] + t[None] + (e[:, i] + z[i])[:, None, :] - total[:, None, None])
            gradient["t"] -= joint[on].sum(0)
            np.add.at(gradient["t"], (gold[rows_at[on], i - 1], gold[rows_at[on], i]), 1.0)
        for x, w in weights.items():
            g = gradient[x] / b - ridge / 10 * w
            m, v = moment[x]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    # a missing word scores like the padding; decoding leaves it out, so its weights move into the others
    own = (weights["s"][:, :n_shape, None, :] + weights["c"][:, None, :n_cue, :]).reshape(k, n_shape * n_cue, n_label)
    absent = weights["s"][:, n_shape] + weights["c"][:, n_cue]
    own[0] += absent[1:].sum(0)
    own[1:] -= absent[1:, None]
    forbidden = t_forbidden()
    return Crf(features, own.astype(np.float32), np.where(forbidden, -1e4, weights["t"]).astype(np.float32))


def t_forbidden() -> np.ndarray:
    """Transitions that no labelling has: into the inside of a kind from another label."""
    return np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])


# --- application ----------------------------------------------------------------------------------------------------

WORDS = re.compile(WORD)


def _spelled(text: str) -> bool:
    """Whether words for @ and then for the dot stand between other words."""
    cues = [CUE_OF.get(w.lower(), 0) for w in text.split()]
    at, dot = CUE_OF["at"], CUE_OF["dot"]
    return at in cues[1:-1] and dot in cues[cues.index(at, 1) + 2 : -1]


#: What a labelled span must be to be reported.
PLAUSIBLE = {"person": lambda t: any(c.isalpha() for c in t), "number": lambda t: len(NOT_DIGIT.sub("", t)) >= 7, "contact": _spelled}



def model_spans(texts: list[str], crf: Crf) -> list[dict[str, list[Span]]]:
    """Person, number and contact spans of each text."""
    every, sizes, owner = [], [], []
    for i, text in enumerate(texts):
        for line in text.encode("utf-8", "replace").split(b"\n"):
            words = line.split()  # at the white space of WORD
            every += words
            sizes.append(len(words))
            owner.append(i)
    out: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    size = np.array(sizes, np.int64)
    labels = crf.decode(crf.features.sequence(every), size)
    line_starts = set(np.cumsum(size)[:-1].tolist())
    of_text = np.repeat(np.array(owner, np.int64), size)
    for i in np.unique(of_text[labels > 0]).tolist():
        first = int(np.searchsorted(of_text, i))
        text = texts[i]
        open_: tuple[str, int, int] | None = None
        for j, m in enumerate(WORDS.finditer(text), first):
            label = LABELS[labels[j]]
            if open_ and (label[0] != "I" or label[2:] != open_[0] or j in line_starts):
                _close(open_, text, out[i])
                open_ = None
            if label != "O":
                open_ = (label[2:], open_[1] if open_ else m.start(), m.end())
        if open_:
            _close(open_, text, out[i])
    return out


def _close(span: tuple[str, int, int], text: str, into: dict[str, list[Span]]) -> None:
    """Keeps a span without punctuation at its edges; an implausible span goes."""
    kind, a, b = span
    while a < b and text[a] in ".,;:!?\"'*#$%&|<>«»“”":
        a += 1
    while a < b and text[b - 1] in ".,;:!?\"'*#$%&|<>«»“”":
        b -= 1
    if a < b and PLAUSIBLE[kind](text[a:b]):
        into[kind].append((a, b))


def _text(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan(docs: DataFrame, seed: int = 7, each: int = 40, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """doc_id, counts, base_sha256, spans and the numbers of spans that the model adds.

    The model's spans that overlap a fixed pattern's are left out; the patterns' spans always stay.
    """
    crf = docs.sparkSession.sparkContext.broadcast(trained(seed, each))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    counts = [f"n_{k}" for k in (*BASE_KINDS, *KINDS)]
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string"

    def rows(texts: list[str]) -> Iterator[tuple]:
        model = crf.value
        for text, more in zip(texts, model_spans(texts, model), strict=True):
            base = base_spans(text)
            taken = [s for k in BASE_KINDS for s in base[k]]
            for k in KINDS:
                more[k] = [s for s in more[k] if not any(a < s[1] and s[0] < b for a, b in taken)]
            every = base | more
            yield (*(len(every[k]) for k in (*BASE_KINDS, *KINDS)), sha(_text(base, BASE_KINDS).encode()), _text(every, (*BASE_KINDS, *KINDS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            made: list[tuple] = []
            at = 0
            while at < len(texts):  # a bounded run of texts at a time; a longer text makes a run of its own
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= batch_chars):
                    chars += len(texts[to])
                    to += 1
                made += rows(texts[at:to])
                at = to
            cols = list(zip(*made, strict=True)) or [[]] * (len(counts) + 2)
            kinds = [pa.int64()] * len(counts) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *counts, "base_sha256", "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
