"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table predicts, for every document, the posterior of each domain. Rates r >= 0 are then
sought for which the expected token totals of the domains, sum over documents of tokens * r * posterior, match the
targets in least squares. The descent is projected: from the same start rate for all, r <- project(r - p . y), where y
is the residual of the totals, scaled by the inverse of the k x k second moments of the documents whose rates are not at a
bound. Each step is one pass over a narrow table that returns k + k * k numbers; a document's rate is recomputed from its posterior and the
few vectors y of the steps before, so nothing is stored per document. A document gets floor(r + u) copies, u
being a hash of it in [0, 1).

By default domains are the labels' quality classes. The total is the largest at which the targets need no
domain more often than it is there, and rates stay at or below max_rate.

Learning takes at most MAX_TRAIN labelled rows (those with the smallest hash of doc_id), whole texts.

Defined results: null and empty texts have no tokens and posteriors from their (empty) features; if only one domain is
labelled, all documents belong to it; without labelled rows every rate is 1; repeated rows get their own
equal decisions; an empty table gives an empty result; other columns are kept by mix() and ignored by rates().
"""

from __future__ import annotations

import json
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, saved, slices, text_key_of, texts, tidy

MAX_TRAIN = 20_000
TARGETS = {"quality0": 0.08, "quality1": 0.92}
STEPS = 40
TOLERANCE = 1e-5
MISSED = 1e-3  # share of all tokens by which a domain may miss its target without a warning
BUCKETS = 64  # hashed word-ending shares besides the shape features
SHAPE = 23


def features(text: str) -> np.ndarray:
    """Shape of a text: how long its words and lines are, how much repeats, what characters it uses."""
    ws, n = text.split(), len(text)
    lines = text.split("\n")
    out = np.zeros(SHAPE + BUCKETS)
    if not ws:
        out[0] = 1
        return out
    m = len(ws)
    sizes = np.fromiter(map(len, ws), np.int64, m)
    kinds = len(set(ws))
    pairs = len(set(zip(ws, ws[1:])))
    upper = sum(map(str.isupper, ws))
    title = sum(map(str.isupper, [w[0] for w in ws]))
    alpha = sum(map(str.isalpha, ws))
    marks = {c: text.count(c) for c in ",.!?*#%&$|:;\"()@/"}
    digits = sum(map(text.count, "0123456789"))
    longest = max(map(len, lines))
    out[1:SHAPE] = [
        np.log1p(m), kinds / m, pairs / max(1, m - 1), sizes.mean(), sizes.std(), upper / m, title / m, alpha / m,
        marks[","] / m, marks["."] / m, (marks["!"] + marks["?"]) / m, (marks["*"] + marks["#"] + marks["%"] + marks["&"] + marks["$"]) / m, marks["|"] / m,
        (marks[":"] + marks["/"] + marks["@"]) / m, digits / n, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(longest),
        sum(x[-1:] in ".!?" for x in lines) / len(lines), (ws[0] == ws[-1]), float(sizes.max() > 40), np.log1p(n / len(lines)),
    ]
    for e, c in Counter([w[-2:] for w in ws]).items():
        out[SHAPE + zlib.crc32(e.encode("utf-8", "surrogatepass")) % BUCKETS] += c / m
    return out


class Softmax:
    """A linear classifier on standardised features, fitted by full-batch descent with momentum."""

    def __init__(self, domains: list[str]):
        self.domains = domains

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> Softmax:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))]
        hot = np.eye(len(self.domains))[y]
        self.w = np.zeros((z.shape[1], len(self.domains)))
        speed = np.zeros_like(self.w)
        for _ in range(steps):
            gap = self._soft(z @ self.w) - hot
            speed = 0.9 * speed - 0.1 * (z.T @ gap / len(z) + ridge * self.w)
            self.w += speed
        return self

    @staticmethod
    def _soft(a: np.ndarray) -> np.ndarray:
        e = np.exp(a - a.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))]
        return self._soft(z @ self.w)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in chunks(batches):
        yield pd.DataFrame({"domain": b.domain, "x": [features(t).astype(np.float32).tobytes() for t in b.text]})


def train(docs: DataFrame, labels: DataFrame, domain: Column) -> Softmax | None:
    """The classifier, of bounded size; None without labelled rows."""
    sample = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.cast("string").alias("domain")).where("doc_id is not null and domain is not null")
    sample = sample.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    rows = texts(docs).join(F.broadcast(sample), "doc_id").mapInPandas(tidy(_features), "domain string, x binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["domain", "x"])
    domains = sorted(rows.domain.unique())
    x = np.frombuffer(b"".join(rows.x), np.float32).reshape(len(rows), -1).astype(np.float64)
    return Softmax(domains).fit(x, rows.domain.map({d: k for k, d in enumerate(domains)}).to_numpy())


def _posteriors_of(model: Softmax):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in chunks(batches):
            p = model.posteriors(np.stack([features(t) for t in b.text]))
            keys = np.array([text_key_of(t.encode("utf-8", "surrogatepass")) for t in b.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "text_key": keys, "n_tokens": [len(t.split()) for t in b.text], "posterior": list(p)})

    return run


def rate_of(p: np.ndarray, start: float, moves: list[np.ndarray], max_rate: float) -> np.ndarray:
    """Rates of documents with posteriors p (n, k) after the steps so far."""
    r = np.full(len(p), start)
    for y in moves:
        r = np.clip(r - p @ y, 0.0, max_rate)
    return r


def _totals_of(start: float, moves: list[np.ndarray], max_rate: float):
    """Cells 0 .. k-1: expected tokens of each domain; the k * k after them: second moments of the documents whose rates are
    not at a bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for b in batches:
            if len(b):
                p, n = np.stack(b.posterior.to_list()), b.n_tokens.to_numpy(float)
                r = rate_of(p, start, moves, max_rate)
                free = n * ((r > 0) & (r < max_rate))
                total = total + np.r_[(n * r) @ p, ((p * free[:, None]).T @ p).reshape(-1)]
        if not isinstance(total, float):
            yield pd.DataFrame({"cell": np.arange(len(total)), "tokens": total})

    return run


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = 0.0
    for b in batches:
        if len(b):
            p, n = np.stack(b.posterior.to_list()), b.n_tokens.to_numpy(float)
            total = total + (p * n[:, None]).T @ p
    if not isinstance(total, float):
        yield pd.DataFrame({"cell": np.arange(total.size), "tokens": total.reshape(-1)})


def solve(members: DataFrame, domains: list[str], targets: dict[str, float], max_rate: float) -> tuple[float, list[np.ndarray], dict]:
    """members(n_tokens, posterior) -> start rate, the steps' vectors, and what they reach."""
    k = len(domains)
    cells = {r.cell: r.tokens for r in members.mapInPandas(tidy(_moments), "cell int, tokens double").groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect()}  # k * k rows
    moment = np.array([cells.get(c, 0.0) for c in range(k * k)]).reshape(k, k)
    there = moment.sum(1)  # expected tokens per domain at rate 1
    weight = np.array([targets.get(d, 0.0) for d in domains])
    weight = weight / weight.sum() if weight.sum() else there / max(there.sum(), 1e-9)
    if not there.sum():
        return 1.0, [], {"totals": there, "wanted": there, "steps": 0, "gap": 0.0}
    wanted = weight * np.min((there * min(max_rate, 1e9) / np.maximum(weight, 1e-12))[weight > 0]) if max_rate < 1e9 else weight * there.sum()
    start = float(min(max_rate, wanted.sum() / there.sum()))
    whole = metric = np.linalg.pinv(moment + 1e-9 * np.trace(moment) * np.eye(k))
    moves: list[np.ndarray] = []
    totals, before = start * there, np.inf
    for _ in range(STEPS):
        gap = totals - wanted
        worst = np.abs(gap).max() / wanted.sum()
        if worst < TOLERANCE:
            break
        if worst > 0.9 * before:  # the documents left free don't suffice: all of them set the next step's length
            if metric is whole and worst > 0.999 * before:
                break
            metric = whole
        before = worst
        moves.append(metric @ gap)
        passed = members.mapInPandas(tidy(_totals_of(start, moves, max_rate)), "cell int, tokens double").groupBy("cell").agg(F.sum("tokens").alias("tokens"))
        sums = {r.cell: r.tokens for r in passed.collect()}  # k + k * k rows
        totals = np.array([sums.get(c, 0.0) for c in range(k)])
        free = np.array([sums.get(k + c, 0.0) for c in range(k * k)]).reshape(k, k)
        metric = np.linalg.pinv(free + 1e-9 * np.trace(free) * np.eye(k)) if np.trace(free) > 0 else whole
    gap = float(np.abs(totals - wanted).max() / max(wanted.sum(), 1e-9))
    return start, moves, {"totals": totals, "wanted": wanted, "steps": len(moves), "gap": gap}


def _uniform(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row from its doc_id and text."""
    return (mix64(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys) >> np.uint64(11)) / float(1 << 53)


def _plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: Column | None, max_rate: float):
    """(members, model, start, moves, report): what rates follow from; model is None without labelled rows. A warning says if the targets
    are missed."""
    domain = F.concat(F.lit("quality"), F.col("quality")) if domain is None else domain
    model = train(docs, labels, domain)
    if model is None:
        return None, None, 1.0, [], {}
    members = saved(texts(docs).mapInPandas(tidy(_posteriors_of(model)), "doc_id long, text_key long, n_tokens long, posterior array<double>"), "mixing")
    start, moves, report = solve(members, model.domains, targets, max_rate)
    if report["gap"] > MISSED:
        warnings.warn(f"mixing targets are missed by {report['gap']:.3g} of all tokens", stacklevel=3)
    return members, model, start, moves, report


def _copies(rate: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return np.floor(rate + _uniform(ids, keys)).astype(np.int64)


def _rates_of(model: Softmax, start: float, moves: list[np.ndarray], max_rate: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = np.stack(b.posterior.to_list())
                rate = rate_of(p, start, moves, max_rate)
                copies = _copies(rate, b.doc_id.fillna(0).to_numpy(np.int64), b.text_key.to_numpy(np.int64).view(np.uint64))
                yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_tokens": b.n_tokens, "posterior": [json.dumps(dict(zip(model.domains, map(float, x)))) for x in p], "rate": rate, "copies": copies})

    return run


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, max_rate: float = 1.0) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, posterior (JSON of domain to probability), rate, copies, and target_gap: by what
    share of all tokens the expected totals miss the targets at most (null without labelled rows)."""
    members, model, start, moves, report = _plan(docs, labels, targets, domain, max_rate)
    if model is None:
        n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long")
        return texts(docs).select("doc_id", n.alias("n_tokens"), F.lit("{}").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(None).cast("double").alias("target_gap"))
    return members.mapInPandas(tidy(_rates_of(model, start, moves, max_rate)), "doc_id long, n_tokens long, posterior string, rate double, copies long").withColumn("target_gap", F.lit(report["gap"]))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, domain: Column | None = None, max_rate: float = 1.0) -> DataFrame:
    """docs as often as their copies say, all columns. The last pass reads the texts once more to find their rates, so no
    row is moved."""
    _, model, start, moves, _ = _plan(docs, labels, targets, domain, max_rate)
    if model is None:
        return docs

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            found = [t or "" for t in b.column(b.schema.get_field_index("text")).cast(pa.large_string()).to_pylist()]
            ids = np.asarray(b.column(b.schema.get_field_index("doc_id")).cast(pa.int64()).fill_null(0)).astype(np.int64)
            keys = np.array([text_key_of(t.encode("utf-8", "surrogatepass")) for t in found], np.uint64)
            p = model.posteriors(np.stack([features(t) for t in found]))
            copies = _copies(rate_of(p, start, moves, max_rate), ids, keys)
            yield b.take(pa.array(np.repeat(np.arange(b.num_rows), copies)))

    return docs.mapInArrow(tidy(run), docs.schema)
