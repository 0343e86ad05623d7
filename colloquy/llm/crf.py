"""Personal data by patterns and a linear-chain conditional random field.

Four patterns give the base spans: mail addresses, internet addresses, card numbers, telephone numbers. The field adds what they
miss, such as "name (at) host (dot) org", "10[.]1[.]2[.]3", cards in groups parted by dots and telephone numbers without a plus. It
labels tokens (words, digit groups, single marks) by features of their shapes, of their neighbours' shapes and of the group of digits
they stand in, with Begin and Inside for each kind. It is trained on a small labelled table (at most MAX_TRAIN rows; by default
one composed by rule) by gradient steps on the whole sequence's likelihood, and decoded by Viterbi for many stretches of text at once.

Every token of a text is scored, by tables of shapes for a batch at once. Labels other than Outside pay only where a run of tokens can gain on
Outside by its own scores and the best transitions there are; where none can, the best labels are Outside, and only what is left is walked. So the
labels are those of the whole text. An added span has to have the parts of its kind (four numbers up to 255;
16 to 19 digits with the right checksum; 8 to 15 digits; a name, a host and its domain) and touches no other span.

Defined results: null and empty texts have no spans; repeated rows are treated one by one; very long texts are read whole;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import texts, tidy

KINDS = ("email", "ip", "card", "phone")
OUTSIDE, LABELS = 0, 1 + 2 * len(KINDS)  # 1 + 2k: Begin, 2 + 2k: Inside of kind k
MAX_TRAIN = 2000
TOKENS_AT_ONCE = 100_000
DENSE = 1 << 23  # numbers of joined shapes that have a place each
# The base patterns, and words that stand for signs or announce numbers.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGNS = {"at": "AT", "arobase": "AT", "arroba": "AT", "dot": "DOT", "punkt": "DOT", "point": "DOT", "punto": "DOT"}
CALLS = frozenset("tel phone call mobile fax telefon téléphone teléfono".split())
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\x20\x09-\x0D]")
PIECE = re.compile(r"[\x20\x09-\x0D]+|" + TOKEN.pattern)  # tokens and what parts them
BASE = re.compile("[0-9@]")  # each base span holds one of them


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern LOCAL+@DOMAIN finds them from the left, without trying each beginning of a name."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(0, *s) for s in _emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ---- features ----


def _shape(word: str) -> str:
    if word[0].isdecimal():
        n = len(word)
        return f"{n}" if n < 6 else "6-7" if n < 8 else "8-15" if n < 16 else "16-19" if n < 20 else "20+"
    if word[0].isalpha():
        return SIGNS.get(low := word.lower()) or ("CALL" if low in CALLS else "w" if word == low else "W" if word.isupper() else "Ww")
    return word


class Stretch:
    """Tokens of a part of a text, with their places in the whole text."""

    def __init__(self, text: str, start: int, end: int):
        found = list(TOKEN.finditer(text, start, end))
        self.words = [m[0] for m in found]
        self.spans = [m.span() for m in found]
        self.glued = [k > 0 and self.spans[k - 1][1] == a for k, (a, _) in enumerate(self.spans)]

    def features(self) -> list[list[str]]:
        words, n = self.words, len(self.words)
        shapes = [("" if g else "_") + _shape(w) for w, g in zip(words, self.glued)]  # _: space before
        at = lambda k: shapes[k] if 0 <= k < n else "#"
        groups = _groups(words, [k for k, w in enumerate(words) if w[0].isdecimal()])
        out = []
        for k, w in enumerate(words):
            f = [
                f"0{at(k)}", f"-1{at(k - 1)}", f"+1{at(k + 1)}", f"-2{at(k - 2)}", f"+2{at(k + 2)}", f"-3{at(k - 3)}", f"+3{at(k + 3)}",
                f"a{at(k - 1)}|{at(k)}", f"b{at(k)}|{at(k + 1)}", f"c{at(k - 1)}|{at(k)}|{at(k + 1)}", f"d{at(k - 2)}|{at(k - 1)}|{at(k)}", f"e{at(k)}|{at(k + 1)}|{at(k + 2)}",
            ]
            out.append(f + _of_numbers(w, shapes[k], groups.get(k)))
        return out


def _of_numbers(word: str, shape: str, group: tuple[str, str, str] | None) -> list[str]:
    f = ["octet" if len(word) < 4 and int(word) < 256 else "large"] if word[0].isdecimal() else []
    return f + [f"g{group[0]}", f"h{group[1]}", f"i{group[1]}|{shape}", f"j{group[2]}|{group[0]}"] if group else f


def _groups(words: list[str], numbers: list[int]) -> dict[int, tuple[str, str, str]]:
    """For each token of a group of digits: how many digits (with their checksum), the lengths of its parts, where the token stands. numbers: tokens of digits."""
    out: dict = {}
    n, done = len(words), 0
    for k in numbers:
        if k < done:
            continue
        parts, z = [k], k + 1
        while z < n and z - parts[-1] <= 3 and (words[z][0].isdecimal() or words[z] in "-./()[]_+" or words[z].lower() in SIGNS):
            if words[z][0].isdecimal():
                parts.append(z)
            z += 1
        first = k
        while first > 0 and words[first - 1] in "+(":
            first -= 1
        digits = "".join(words[p] for p in parts)
        size = len(digits)
        total = "few" if size < 8 else "8-15" if size < 16 else f"16-19{luhn(digits)}" if size < 20 else "many"
        lengths = "-".join(str(min(len(words[p]), 9)) for p in parts[:6])
        small = "octets" if len(parts) == 4 and all(len(words[p]) < 4 and int(words[p]) < 256 for p in parts) else ""
        for j in range(first, parts[-1] + 1):
            out[j] = (total, lengths + small, "first" if j == first else "rest")
        done = parts[-1] + 1
    return out


# ---- the field ----


def _allowed() -> np.ndarray:
    """What may follow what: Inside only its own Begin or Inside."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
FIRST = np.array([label == 0 or label % 2 == 1 for label in range(LABELS)])
NO = -1e4


class Field:
    """Weights of (feature, label) and (label, label)."""

    def __init__(self, names: dict[str, int], w: np.ndarray, t: np.ndarray):
        self.names, self.w, self.t = names, w, t
        self._tables = None

    def tables(self) -> Tables:
        """Made once, where they are used."""
        self._tables = self._tables or Tables(self)
        return self._tables

    def rows(self, found: list[list[list[str]]]) -> list[np.ndarray]:
        """Emission scores of each token, per stretch; unknown features add nothing."""
        get, none = self.names.get, len(self.names)
        w = np.vstack([self.w, np.zeros(LABELS)])
        width = max((len(f) for s in found for f in s), default=1)
        flat = np.full((sum(map(len, found)), width), none)
        at = 0
        for s in found:
            for f in s:
                flat[at, : len(f)] = [get(x, none) for x in f]
                at += 1
        scores = w[flat].sum(1)
        return np.split(scores, np.cumsum([len(s) for s in found])[:-1]) if found else []

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each stretch: Viterbi over stretches of like length at once."""
        out: list = [None] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        t = np.where(ALLOWED, self.t, NO)
        at = 0
        while at < len(order):
            z = at + 1
            while z < len(order) and len(scores[order[z]]) * (z - at + 1) <= TOKENS_AT_ONCE:
                z += 1
            own = order[at:z]
            at = z
            sizes = np.array([len(scores[k]) for k in own])
            steps = int(sizes.max())
            if not steps:
                for k in own:
                    out[k] = np.zeros(0, int)
                continue
            e = np.zeros((len(own), steps, LABELS))
            for r, k in enumerate(own):
                e[r, : sizes[r]] = scores[k]
            best = e[:, 0] + np.where(FIRST, 0, NO)
            back = np.zeros((len(own), steps, LABELS), np.int8)
            for s in range(1, steps):
                ways = best[:, :, None] + t
                back[:, s] = ways.argmax(1)
                best = np.where((s < sizes)[:, None], ways.max(1) + e[:, s], best)
            label = best.argmax(1)
            path = np.zeros((len(own), steps), int)
            rows = np.arange(len(own))
            for s in range(steps - 1, -1, -1):
                path[:, s] = label
                label = np.where((s < sizes) & (s > 0), back[rows, s, label], label)
            for r, k in enumerate(own):
                out[k] = path[r, : sizes[r]]
        return out


class _Codes(dict):
    """Of a piece of text: the numbers of its shape without and with a space before, and whether it is digits, in one number; -1 for white space."""

    BITS, PART, KEPT = 24, (1 << 24) - 1, 200_000

    def __init__(self, shapes: dict[str, int]):
        self.shapes = shapes

    def __missing__(self, piece: str) -> int:
        if piece[0] in " \t\n\v\f\r":
            code = -1
        else:
            shape = _shape(piece)
            code = (self.shapes.get("_" + shape, 1) << self.BITS | self.shapes.get(shape, 1)) << 1 | piece[0].isdecimal()
        if len(piece) < 20:
            self[piece] = code
        return code

    def trim(self) -> None:
        if len(self) > self.KEPT:
            self.clear()


class Tables:
    """The weights of a field by numbers of shapes, so that the scores of all tokens are looked up at once."""

    ONE = (("0", 0), ("-1", -1), ("+1", 1), ("-2", -2), ("+2", 2), ("-3", -3), ("+3", 3))
    MORE = (("a", (-1, 0)), ("b", (0, 1)), ("c", (-1, 0, 1)), ("d", (-2, -1, 0)), ("e", (0, 1, 2)))

    def __init__(self, field: Field):
        self.field = field
        self.shapes = {n[1:]: k + 2 for k, n in enumerate(n for n in field.names if n[0] == "0")}  # 0: no token, 1: not known
        self.size = len(self.shapes) + 2
        known = {"#": 0} | self.shapes
        row = lambda name: field.w[f] if (f := field.names.get(name)) is not None else np.zeros(LABELS)
        self.one = [(off, np.array([row(prefix + s) for s in sorted(known, key=known.get)])) for prefix, off in self.ONE]
        self.one = [(off, np.insert(w, 1, 0, 0)) for off, w in self.one]
        self.more = []
        for prefix, offs in self.MORE:
            found = sorted((code, f) for n, f in field.names.items() if n[0] == prefix for code in self._codes(n[1:], len(offs), known))
            codes = np.array([c for c, _ in found] or [-1], np.int64)
            w = np.vstack([field.w[[f for _, f in found]] if found else np.zeros((1, LABELS)), np.zeros(LABELS)])
            if self.size ** len(offs) <= DENSE:
                place = np.full(self.size ** len(offs), len(w) - 1, np.int32)
                place[[c for c, _ in found]] = np.arange(len(found))
                self.more.append((offs, place, None, w))
            else:
                self.more.append((offs, None, codes, w))
        self.codes = _Codes(self.shapes)

    def _codes(self, joined: str, n: int, known: dict[str, int]) -> list[int]:
        """The numbers of n shapes joined by bars, as one; a shape may be a bar itself."""
        if n == 1:
            return [known[joined]] if joined in known else []
        cuts = [k for k, c in enumerate(joined) if c == "|" and joined[:k] in known]
        return [known[joined[:k]] * self.size ** (n - 1) + rest for k in cuts for rest in self._codes(joined[k + 1 :], n - 1, known)]

    def scores(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and scores (token, label) of all tokens of a text."""
        pieces = PIECE.findall(text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        code = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        self.codes.trim()
        at = np.flatnonzero(code >= 0)
        code, n = code[at], len(at)
        starts, ends = ends[at] - lengths[at], ends[at]
        glued = np.diff(at, prepend=-2) == 1  # no white space before
        ids = np.zeros(n + 6, np.int64)
        ids[3:-3] = np.where(glued, code >> 1 & _Codes.PART, code >> _Codes.BITS + 1)
        e = np.zeros((n, LABELS))
        part = lambda off: ids[3 + off : 3 + off + n]
        for off, w in self.one:
            e += w.take(part(off), 0)
        for offs, place, codes, w in self.more:
            joined = part(offs[0])
            for off in offs[1:]:
                joined = joined * self.size + part(off)
            if place is not None:
                e += w.take(place.take(joined), 0)
            else:
                k = np.minimum(np.searchsorted(codes, joined), len(codes) - 1)
                e += w.take(np.where(codes[k] == joined, k, len(w) - 1), 0)
        numbers = np.flatnonzero(code & 1).tolist()
        if numbers:
            words = [pieces[k] for k in at.tolist()]
            groups = _groups(words, numbers)
            for k in {*numbers, *groups}:
                shape = ("" if glued[k] else "_") + _shape(words[k])
                for f in _of_numbers(words[k], shape, groups.get(k)):
                    if (j := self.field.names.get(f)) is not None:
                        e[k] += self.field.w[j]
        return starts, ends, e

    def parts(self, e: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first token, scores) of the parts of a text where the best labels may be others than Outside, each with a neighbour on both sides that is Outside."""
        n, t = len(e), np.where(ALLOWED, self.field.t, NO)
        if not n:
            return
        stay = t[OUTSIDE, OUTSIDE]
        gain = (e[:, 1:] + t.max(0)[1:] - e[:, :1] - stay).max(1)
        gain[0] = (e[0, 1:] - e[0, 0]).max()
        total = np.cumsum(gain)
        before = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        most = np.maximum.accumulate(total[::-1])[::-1] - before + max(0.0, (t[1:, OUTSIDE] - stay).max())  # of a run that holds the token
        edges = np.flatnonzero(np.diff(np.concatenate([[False], most > -1e-6, [False]]).astype(np.int8)))
        for a, z in edges.reshape(-1, 2).tolist():
            low, high = max(0, a - 1), min(n, z + 1)
            own = e[low:high].copy()
            if low < a:
                own[0, 1:] += 10 * NO
            if high > z:
                own[-1, 1:] += 10 * NO
            yield low, own


def _spans(labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(kind, first token, last token)."""
    kind = None
    for k, label in enumerate([*labels.tolist(), OUTSIDE]):
        if kind is not None and label != 2 + 2 * kind:
            yield kind, start, k - 1
            kind = None
        if label % 2 == 1:
            kind, start = label // 2, k


def complete(kind: int, text: str) -> bool:
    """Whether a span has the parts of its kind."""
    digits = _digits(text)
    if kind == 0:
        words = [w for w in re.findall(r"\w+", text) if w.lower() not in SIGNS]
        signs = {SIGNS.get(w.lower()) for w in re.findall(r"\w+", text)} | {"AT" if "@" in text else None, "DOT" if "." in text else None}
        return len(words) >= 3 and {"AT", "DOT"} <= signs
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def added_spans(found: list[str], field: Field, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans of the field that are complete and touch no base span."""
    tables = field.tables()
    out: list[list] = [[] for _ in found]
    held: list[tuple] = []

    def walk() -> None:
        for (k, starts, ends, first, _), path in zip(held, field.decode([h[4] for h in held])):
            for kind, x, y in _spans(path):
                a, b = int(starts[first + x]), int(ends[first + y])
                if complete(kind, found[k][a:b]) and all(b <= x or a >= y for _, x, y in base[k]):
                    out[k].append((kind, a, b))
        held.clear()

    size = 0
    for k, text in enumerate(found):
        starts, ends, e = tables.scores(text)
        for first, own in tables.parts(e):
            held.append((k, starts, ends, first, own))
            size += len(own)
        if size > TOKENS_AT_ONCE:
            walk()
            size = 0
    walk()
    return out


# ---- training ----


def fit(rows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 9, batch: int = 48, rate: float = 0.1, decay: float = 1e-4, seed: int = 1) -> Field:
    """rows: (text, spans). Gradient steps (Adam) on the negative log-likelihood of the labels."""
    data, names = [], {}
    for text, spans in rows:
        s = Stretch(text, 0, len(text))
        if not s.words:
            continue
        labels = np.zeros(len(s.words), int)
        for kind, a, b in spans:
            inside = [k for k, (x, y) in enumerate(s.spans) if x >= a and y <= b]
            labels[inside] = 2 + 2 * kind
            if inside:
                labels[inside[0]] = 1 + 2 * kind
        ids = [[names.setdefault(f, len(names)) for f in fs] for fs in s.features()]
        data.append((ids, labels))
    w, t = np.zeros((len(names) + 1, LABELS)), np.zeros((LABELS, LABELS))
    moments = [np.zeros_like(x) for x in (w, t, w, t)]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(len(data)), max(1, len(data) // batch)) if data else []:
            gw, gt = _gradient([data[k] for k in own], w, t)
            step += 1
            for x, g, m, v in ((w, gw + decay * w, moments[0], moments[2]), (t, gt + decay * t, moments[1], moments[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(names, w[:-1], t)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _gradient(data: list, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts, by forward and backward sums over the batch's sequences at once; a mean over sequences."""
    n, steps, width = len(data), max(len(y) for _, y in data), max(len(f) for x, _ in data for f in x)
    ids, gold, there = np.full((n, steps, width), len(w) - 1), np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for r, (x, y) in enumerate(data):
        for k, f in enumerate(x):
            ids[r, k, : len(f)] = f
        gold[r, : len(y)], there[r, : len(y)] = y, True
    e, masked = w[ids].sum(2), np.where(ALLOWED, t, NO)
    ahead, behind = np.zeros_like(e), np.zeros_like(e)
    ahead[:, 0] = e[:, 0] + np.where(FIRST, 0, NO)
    for s in range(1, steps):
        ahead[:, s] = np.where(there[:, s, None], _lse(ahead[:, s - 1][:, :, None] + masked, 1) + e[:, s], ahead[:, s - 1])
    for s in range(steps - 2, -1, -1):
        behind[:, s] = np.where(there[:, s + 1, None], _lse(masked + (e[:, s + 1] + behind[:, s + 1])[:, None, :], 2), 0)
    total = _lse(ahead[:, -1], 1)
    expected = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
    expected[np.arange(n)[:, None], np.arange(steps), gold] -= there
    gw = np.zeros_like(w)
    flat = ids.reshape(n * steps, width)
    for label in range(LABELS):
        gw[:, label] = np.bincount(flat.ravel(), np.repeat(expected[:, :, label].ravel(), width), len(w))
    gw[-1] = 0
    gt = np.zeros_like(t)
    for s in range(1, steps):
        live = there[:, s]
        pair = np.exp(ahead[:, s - 1][:, :, None] + masked + (e[:, s] + behind[:, s])[:, None, :] - total[:, None, None])[live]
        gt += pair.sum(0)
        np.subtract.at(gt, (gold[live, s - 1], gold[live, s]), 1)
    return gw / n, np.where(ALLOWED, gt, 0) / n


def train(labelled: DataFrame) -> Field:
    """labelled(text string, spans array<struct<kind:int,start:int,end:int>>): at most MAX_TRAIN rows, in the order of their texts, are used."""
    rows = labelled.orderBy("text").limit(MAX_TRAIN).collect()
    return fit([(r.text, [(s.kind, s.start, s.end) for s in r.spans]) for r in rows])


# ---- the labelled table ----


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _card(rng: random.Random, right: bool = True) -> str:
    while True:
        d = _number(rng, 15)
        check = next(c for c in "0123456789" if luhn(d + c))
        return d + (check if right else str((int(check) + rng.randint(1, 9)) % 10))


def _word(rng: random.Random) -> str:
    word = "".join(rng.choice(("ka", "lo", "mi", "ter", "en", "sch", "ou", "ion", "é", "va", "ra", "st")) for _ in range(rng.randint(1, 4)))
    return word.capitalize() if rng.random() < 0.15 else word


def _email(rng: random.Random) -> str:
    user = rng.choice(("{a}", "{a}.{b}", "{a}{n}", "{a}_{b}", "{n}")).format(a=_name(rng), b=_name(rng), n=rng.randint(1, 99))
    host, top = rng.choice(("{a}", "{a}{n}", "{a}-{b}")).format(a=_name(rng), b=_name(rng), n=rng.randint(1, 9)), rng.choice(("com", "org", "net", "example", "de", "fr", "es"))
    at = rng.choice(("@", "@", " @ ", " (at) ", " [at] ", "(at)", "[at]", " at ", " {at} ", " arobase "))
    dot = rng.choice((" (dot) ", " [dot] ", " dot ", "[.]", " . ", "(dot)", " punkt ", " {dot} ")) if at not in (" @ ", "(at)", "[at]", " (at) ", " [at] ") or rng.random() < 0.5 else "."
    if at == "@" and rng.random() < 0.4:
        dot = "."
    return user + at + host + dot + (rng.choice(("mail", "example")) + dot if rng.random() < 0.25 else "") + top


def _name(rng: random.Random) -> str:
    return "".join(rng.choice(("ka", "lo", "mi", "ter", "en", "jo", "ann", "ra", "be")) for _ in range(rng.randint(1, 3)))


def _ip(rng: random.Random) -> str:
    dot = rng.choice((".", " . ", "[.]", "(.)", " dot ", "[dot]", " . ", "[.]"))
    return dot.join(str(rng.randint(0, 255)) for _ in range(4))


def _grouped(rng: random.Random) -> str:
    card, sep = _card(rng), rng.choice((" ", "-", ".", "/", "  ", "_", " - ", ".", ""))
    return sep.join(card[k : k + 4] for k in range(0, 16, 4))


def _phone(rng: random.Random) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    form = rng.choice(("+1 ({a}) {b}-{c}", "({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "00 1 {a} {b} {c}", "0049 {a} {b}{c}", "1-{a}-{b}-{c}", "{a} {b} {c}", "({a}) {b} {c}", "0{a}/{b}{c}"))
    return form.format(a=a, b=b, c=c)


def _other(rng: random.Random) -> str:
    """What looks like personal data and is not."""
    n = rng.randint
    return rng.choice((
        f"{n(1990, 2030)}-{n(1, 12):02d}-{n(1, 28):02d}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"{n(0, 23)}:{n(0, 59):02d}", f"{n(0, 9)}.{n(0, 9)}", f"{n(0, 9)}.{n(0, 19)}.{n(0, 9)}",
        f"{n(256, 999)}.{n(0, 999)}.{n(0, 99)}.{n(256, 900)}", _number(rng, n(1, 12)), _card(rng, False), f"{n(1, 99)},{n(100, 999)}.{n(10, 99)}", f"password={_hex(rng)}", f'token = "{_hex(rng)}"',
        f"AKIA{_hex(rng).upper()}", f"{n(1, 20)} @ {n(1, 90)}", f"@{_name(rng)}", f"{_name(rng)} at {_name(rng)}", f"{_name(rng)} dot {_name(rng)}", f"{n(1, 99)}-{n(1, 99)}", f"{_number(rng, 3)}-{_number(rng, 4)}",
        _number(rng, 20), f"{n(1, 9)} {n(10, 99)} {n(100, 999)}", f"{n(1, 50)} / {n(1, 50)}", f"v{n(1, 9)}.{n(0, 9)}.{n(0, 9)}-{n(1, 9)}", f"{n(1000, 9999)} {n(1000, 9999)}", f"{n(1, 99)}%", f"§ {n(1, 99)}.{n(1, 9)}",
        f"{_number(rng, 5)} {_number(rng, 16)}",
    ))


def _hex(rng: random.Random) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40)))


def composed(n: int = 700, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans): words with personal data in many spellings, and with numbers and signs that are none."""
    rng, out = random.Random(seed), []
    makers = (_email, _ip, _grouped, _phone)
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(_word(rng) for _ in range(rng.randint(1, 6))) + rng.choice((" ", " ", " ", ": ", ". ", ", ", "\n"))
            if rng.random() < 0.6:
                kind = rng.randrange(len(KINDS))
                made = makers[kind](rng)
                if kind == 3 and rng.random() < 0.3:
                    text += rng.choice(("tel ", "tel: ", "phone ", "call ", "fax: "))
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += _other(rng)
            text += rng.choice((" ", " ", " ", ". ", ", ", ".\n", "; "))
        out.append((text + _word(rng), spans))
    return out


def labelled_table(spark: SparkSession, n: int = 700, seed: int = 7) -> DataFrame:
    """The composed rows as a table for train()."""
    return spark.createDataFrame(composed(n, seed), "text string, spans array<struct<kind:int,start:int,end:int>>")


# ---- over a table ----


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _found(found: list[str], field: Field) -> Iterator[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if BASE.search(t) else [] for t in found]
    for b, more in zip(base, added_spans(found, field, base)):
        yield b, sorted(b + more)


def _spans_of(field: Field):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = list(b.text)
            named = [[{"kind": KINDS[k], "start": x, "end": y, "text": t[x:y]} for k, x, y in spans] for t, (_, spans) in zip(found, _found(found, field))]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "spans": named})

    return run


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of docs: doc_id, spans (kind, start, end, text); places are code points, end exclusive."""
    return texts(docs).mapInPandas(tidy(_spans_of(field)), "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string>>")


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _digests_of(field: Field):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, (base, spans) in zip(b.doc_id, _found(list(b.text), field)):
                counts = [sum(k == kind for k, _, _ in spans) for kind in range(len(KINDS))]
                out.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            d = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
            yield d.assign(doc_id=d.doc_id.astype("Int64"))

    return run


def personal_data_digests(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of all spans by kind, the digest of the base spans, all spans."""
    return texts(docs).mapInPandas(tidy(_digests_of(train(labelled))), _OUT)
