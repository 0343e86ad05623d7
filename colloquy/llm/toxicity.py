"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: whole words and word stems that occur almost only in rows labelled 1. It is
kept as a trie, and every hit comes from running a token's Levenshtein automaton down that trie: a word is reached when the
token ends near it, a stem when any beginning of the token does. One edit is allowed for words of 5 to 9 letters and stems from 7, two for
words from 10. A pigeonhole test on pieces of the entries spares most tokens the walk. Each hit is weighed
by its entry's log-odds, and a window of words around it tells whether it is quoted (quotation marks, verbs of
report) or addresses someone (second person). A logistic model, fitted on the same rows, weighs the hits that nobody quotes, all
hits, and the shares that are quoted and that address, so where labels tell quotation from abuse the window decides.

Learning takes labelled rows outside the held-out fold only, at most MAX_TRAIN of them (those with the smallest
hash of doc_id), whole texts; near-copies among them count once, so that a much copied text lends no weight to its words.
Everything else covers all rows.

Defined results: null and empty texts get the score of a text without hits; without labelled rows of both kinds
every score is the share of rows labelled 1 (0 if none); repeated rows are scored one by one; very long tokens are matched like
others; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, texts, tidy

MAX_TRAIN = 20_000  # labelled rows that the model is fitted on
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
WINDOW = 6  # words on each side of a hit
MIN_WORD, MIN_STEM = 5, 8  # rows labelled 1 that support an entry
STEMS = range(4, 10)  # lengths of stems
CACHE = 250_000  # tokens whose match is remembered
TOKEN = re.compile(r"[^\W_]+")
# Marks and verbs of quotation, words of address.
MARKS = "\"“”„«»‹›"
REPORT = frozenset("said says wrote writes quote quoted quotes called calls term word dit disait écrit mot terme sagte sagt schrieb wort begriff dijo dice escribió palabra término".split())
ADDRESS = frozenset("you your youre du dich dir dein ihr tu te toi ton vous tú usted eres".split())


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def edits_allowed(entry: str, stem: bool = False) -> int:
    if stem:
        return 1 if len(entry) > 6 else 0
    return 0 if len(entry) < 5 else 1 if len(entry) < 10 else 2


class Automaton:
    """The Levenshtein automaton of a token; a state is a set of (letters read, edits spent)."""

    def __init__(self, token: str, k: int):
        self.token, self.k = token, k
        self.start = ((0, 0),)

    def step(self, state: tuple, letter: str) -> tuple:
        token, k, n, out = self.token, self.k, len(self.token), {}
        for i, e in state:
            for skip in range(0, k - e + 1):  # letters of the token left out before this one
                if i + skip < n and token[i + skip] == letter:
                    out[i + skip + 1] = min(out.get(i + skip + 1, 9), e + skip)
                    break
            if e < k:
                out[i] = min(out.get(i, 9), e + 1)
                if i < n:
                    out[i + 1] = min(out.get(i + 1, 9), e + 1)
        return tuple(sorted(out.items()))

    def distance(self, state: tuple) -> int:
        return min((e + len(self.token) - i for i, e in state), default=9)

    def prefix_distance(self, state: tuple) -> int:
        """Of the nearest beginning of the token."""
        return min((e for _, e in state), default=9)


class Lexicon:
    """Entries (text, is_stem) in a trie."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.plain = {kind: {w for w, stem in entries if stem is kind} for kind in (False, True)}
        self.sizes = sorted({len(w) for w in self.plain[True]})
        self.root: dict = {}
        # pieces of words by their length, and of stems
        self.pieces: dict[tuple[bool, int], dict[tuple[int, int], set[str]]] = {}
        for n, (w, stem) in enumerate(entries):
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(n)
            if k := edits_allowed(w, stem):
                cuts = [len(w) * p // (k + 1) for p in range(k + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    self.pieces.setdefault((stem, len(w)), {}).setdefault((a, b), set()).add(w[a:b])
        self.slices: dict[int, list[tuple[int, int, set[str]]]] = {}
        self.longest = max((len(w) for w, _ in entries), default=0) + 3
        self.seen: dict[str, tuple[int, int] | None] = {}
        self.bad: set[str] = set()  # tokens seen that match

    def _slices(self, n: int) -> list[tuple[int, int, set[str]]]:
        """Where in a token of n letters which pieces would stand, moved by k places at most; if only the first piece is left whole,
        nothing stands before it. Stems themselves stand at the beginning."""
        out: dict[tuple[int, int], set[str]] = {}
        for size in self.sizes:
            out.setdefault((0, size), set()).update(w for w in self.plain[True] if len(w) == size)
        for (stem, size), cuts in self.pieces.items():
            k = 1 if stem or size < 10 else 2
            if n < size - k or n > size + k and not stem:
                continue
            for (a, b), found in cuts.items():
                for move in range(-k, k + 1) if a else (0,):
                    if a + move >= 0:
                        out.setdefault((a + move, b + move), set()).update(found)
        return [(a, b, found) for (a, b), found in out.items()]

    def _possible(self, token: str) -> bool:
        """Whether an entry can be near: it is there as it is, or it shares one of its k+1 pieces with the token."""
        if token in self.plain[False]:
            return True
        n = min(len(token), self.longest)
        slices = self.slices.get(n)
        if slices is None:
            slices = self.slices[n] = self._slices(n)
        for a, b, found in slices:
            if token[a:b] in found:
                return True
        return False

    def search(self, token: str) -> tuple[int, int] | None:
        """The nearest entry and its edits, by a walk through the trie with the token's automaton."""
        automaton, best = Automaton(token, 2 if len(token) >= 8 else 1), None
        stack = [(self.root, automaton.start)]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    for n in below:
                        w, stem = self.entries[n]
                        d = automaton.prefix_distance(state) if stem else automaton.distance(state)
                        if d <= edits_allowed(w, stem) and (best is None or (d, n) < (best[1], best[0])):
                            best = (n, d)
                elif reached := automaton.step(state, c):
                    stack.append((below, reached))
        return best

    def match(self, token: str) -> tuple[int, int] | None:
        """(entry, edits) of a lower-case token, or None."""
        if token not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            found = self.seen[token] = self.search(token) if self._possible(token) else None
            if found:
                self.bad.add(token)
        return self.seen[token]

    def hits(self, text: str) -> tuple[list[tuple[int, int, bool, bool]], int]:
        """((entry, edits, quoted, addressed) of each hit; number of tokens)."""
        c = Context(text)
        for t in set(c.tokens).difference(self.seen):
            self.match(t)
        if self.bad.isdisjoint(c.tokens):
            return [], len(c.tokens)
        return [(*self.match(t), c.quoted(i), not ADDRESS.isdisjoint(c.around(i))) for i, t in enumerate(c.tokens) if t in self.bad], len(c.tokens)


class Context:
    """The tokens of a text and what stands within WINDOW words of each."""

    def __init__(self, text: str):
        self.low = text.lower()
        self.tokens = TOKEN.findall(self.low)
        self._at: list[tuple[int, int]] | None = None
        self._marked: bool | None = None

    def around(self, i: int) -> list[str]:
        return self.tokens[max(0, i - WINDOW) : i] + self.tokens[i + 1 : i + 1 + WINDOW]

    def quoted(self, i: int) -> bool:
        """Between quotation marks, or near a verb of report."""
        if not REPORT.isdisjoint(self.around(i)):
            return True
        if self._marked is None:
            self._marked = any(m in self.low for m in MARKS)
        if not self._marked:
            return False
        self._at = self._at or [m.span() for m in TOKEN.finditer(self.low)]
        before = self.low[self._at[max(0, i - WINDOW)][0] : self._at[i][0]]
        after = self.low[self._at[i][1] : self._at[min(len(self._at) - 1, i + WINDOW)][1] + 1]
        return any(m in before for m in MARKS) and any(m in after for m in MARKS)

    def meant(self) -> set[str]:
        """Tokens that occur outside quotation."""
        if not REPORT.intersection(self.tokens) and not any(m in self.low for m in MARKS):
            return set(self.tokens)
        return {t for i, t in enumerate(self.tokens) if not self.quoted(i)}


def features(found: list, n: int, weights: dict[tuple[int, int], float]) -> list[float]:
    """found: (entry, edits, quoted, addressed) of each hit of a text with n tokens."""
    hits = [(w, *h[1:]) for h in found if (w := weights.get((h[0], min(h[1], 1)), 0.0)) > 0]
    total = sum(h[0] for h in hits)
    share = lambda k: sum(h[0] for h in hits if h[k]) / total if total else 0.0
    meant = max((w for w, _, quoted, _ in hits if not quoted), default=0.0)
    return [meant, min(total, 30.0), math.log1p(len(hits)), 100 * len(hits) / (n + 20), float(any(h[1] == 0 for h in hits)), float(bool(hits)), share(2), share(3)]


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three min-hashes of word 5-grams: near-copies share one nearly always."""
    for b in batches:
        out = []
        for text in b.text:
            ws = text.encode("utf-8", "surrogatepass").lower().split()
            grams = {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
            out.append([min(xxhash.xxh64_intdigest(g, s) for g in grams) - (1 << 63) for s in (1, 2, 3)])
        yield pd.DataFrame(out, columns=["a", "b", "c"]).assign(doc_id=b.doc_id.to_numpy(), toxic=b.toxic.to_numpy())


def pick_entries(rows: pd.DataFrame, negatives: int, positives: int) -> list[tuple[str, bool]]:
    rows = rows.sort_values("term")
    prior = max(negatives, 1) / max(positives, 1)
    entries, stems = [], set()
    rows = rows.assign(size=rows.term.str.len(), p=rows.p0 + rows.p1, n=rows.n0 + rows.n1)
    pure = rows[(rows.p0 > 0) & (rows.p1 > 0) & (rows.p * prior > 12 * rows.n)]
    support = dict(zip(pure.term, pure.p))
    longer: dict[str, int] = {}  # the best supported term with one letter more
    for t, n in support.items():
        stem = t.rstrip("*")[:-1]
        longer[stem] = max(longer.get(stem, 0), n)
    for r in pure[pure.term.str.endswith("*") & (pure.p >= MIN_STEM)].sort_values(["size", "term"]).itertuples():
        stem = r.term[:-1]
        if any(stem[:k] in stems for k in range(4, len(stem))):
            continue
        # A prefix that stands for one word or one longer prefix says no more than that does.
        if max(support.get(stem, 0), longer.get(stem, 0)) < 0.9 * r.p:
            stems.add(stem)
            entries.append((stem, True))
    for r in pure[~pure.term.str.endswith("*") & (pure.p >= MIN_WORD)].sort_values(["p", "term"], ascending=[False, True]).itertuples():
        entries.append((r.term, False))
    return entries


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ridge = np.r_[np.full(x.shape[1] - 1, 0.3), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model as a plain dict of bounded size."""
    spark = docs.sparkSession
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = saved(texts(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "text"]), "toxicity")
    sig = rows.mapInPandas(tidy(_signatures), "a long, b long, c long, doc_id long, toxic int").toPandas().sort_values("doc_id")
    seen, keep = set(), []
    for r in sig.itertuples():
        own = {("a", r.a), ("b", r.b), ("c", r.c)}
        if not own & seen:
            keep.append(int(r.doc_id))
        seen |= own
    y = sig[sig.doc_id.isin(keep)].toxic
    share = float(sig.toxic.mean()) if len(sig) else 0.0
    if not len(y) or not 0 < y.sum() < len(y):
        return {"entries": [], "weights": {}, "w": None, "share": share}
    kept = spark.createDataFrame(pd.DataFrame({"doc_id": keep}), "doc_id long")
    rows = rows.join(F.broadcast(kept), "doc_id")
    # Partial counts of each partition meet in one sum; only terms that rows labelled 1 support reach the driver.
    counts = rows.mapInPandas(tidy(_both_terms), "term string, n0 long, p0 long, n1 long, p1 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")))
    strong = counts.where((F.col("p0") > 0) & (F.col("p1") > 0) & (F.col("p0") + F.col("p1") >= MIN_WORD) & ((F.col("p0") + F.col("p1")) * (float(len(y) - y.sum()) / float(y.sum())) > 12 * (F.col("n0") + F.col("n1"))))
    picked = strong.toPandas()  # terms of the bounded sample
    lexicon = Lexicon(pick_entries(picked, int(len(y) - y.sum()), int(y.sum())))
    found = saved(rows.mapInPandas(tidy(_hits_of(lexicon.entries)), f"toxic int, n int, hits {_HITS}"), "toxicity")
    kinds = F.array_distinct(F.transform("hits", lambda h: F.struct(h["entry"].alias("entry"), F.least(h["edits"], F.lit(1)).alias("kind"))))
    sides = found.select("toxic", F.inline(kinds)).groupBy("entry", "kind").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).collect()  # two rows an entry
    pos, neg = ({(r.entry, r.kind): r[c] for r in sides} for c in ("pos", "neg"))
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    weights = {}
    for n, _ in enumerate(lexicon.entries):
        for kind, (a, b) in enumerate(((0.5, 0.5), (1.0, 0.5 * n_neg / n_pos))):
            p, q = (pos.get((n, kind), 0) + a) / (n_pos + 1), (neg.get((n, kind), 0) + b) / (n_neg + 1)
            weights[n, kind] = math.log(p / q) if kind == 0 or neg.get((n, 1)) else math.log((pos.get((n, 1), 0) + 2.0) / n_pos * n_neg)
    fitted = found.mapInPandas(tidy(_features_of(weights)), "toxic int, x array<double>").toPandas()  # at most MAX_TRAIN rows
    w = _logistic(np.stack(fitted.x.to_list()), fitted.toxic.to_numpy(float))
    return {"entries": lexicon.entries, "weights": weights, "w": w.tolist(), "share": share}


def _both_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one partition for every term, as negatives elsewhere count too."""
    total: Counter = Counter()
    folds: list[Counter] = [Counter() for _ in range(4)]
    for b in batches:
        for doc_id, text, toxic in zip(b.doc_id, b.text, b.toxic):
            ws = Context(text).meant()  # what a text only quotes says nothing about it
            ws |= {w[:k] + "*" for w in ws for k in STEMS if k < len(w)}
            folds[2 * (xxhash.xxh64_intdigest(str(doc_id), 9) & 1) + (1 if toxic else 0)].update(ws)
            total.update(ws)
            if len(total) > 150_000:
                yield _counted(total, folds)
                total.clear()
                for f in folds:
                    f.clear()
    if total:
        yield _counted(total, folds)


def _counted(total: Counter, folds: list[Counter]) -> pd.DataFrame:
    terms = list(total)
    return pd.DataFrame({"term": terms, **{c: np.fromiter((f[t] for t in terms), np.int64, len(terms)) for f, c in zip(folds, ("n0", "p0", "n1", "p1"))}})


_HITS = "array<struct<entry:int,edits:int,quoted:boolean,addressed:boolean>>"


def _hits_of(entries: list):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(entries)
        for b in batches:
            found = [lexicon.hits(t) for t in b.text]
            named = [[dict(zip(("entry", "edits", "quoted", "addressed"), h)) for h in hits] for hits, _ in found]
            yield pd.DataFrame({"toxic": b.toxic, "n": [n for _, n in found], "hits": named})

    return run


def _features_of(weights: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [[(h["entry"], h["edits"], h["quoted"], h["addressed"]) for h in hits] for hits in b.hits]
            yield pd.DataFrame({"toxic": b.toxic, "x": [features(h, n, weights) for h, n in zip(rows, b.n)]})

    return run


def scores(batch_texts, lexicon: Lexicon, model: dict) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(batch_texts), model["share"])
    if not len(batch_texts):
        return np.zeros(0)
    x = np.array([features(*lexicon.hits(t), model["weights"]) for t in batch_texts])
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ np.array(model["w"]), -30, 30)))


def _scores_of(model: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model["entries"])
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "score": scores(list(b.text), lexicon, model)})

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    scored = texts(docs).mapInPandas(tidy(_scores_of(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, all columns, in one pass that moves no row."""
    model = train(docs, labels)

    def run(batches):
        import pyarrow as pa

        lexicon = Lexicon(model["entries"])
        for b in slices(batches):
            found = [t or "" for t in b.column(b.schema.get_field_index("text")).cast(pa.large_string()).to_pylist()]
            yield b.filter(pa.array(scores(found, lexicon, model) < THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
