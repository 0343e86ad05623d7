"""Speaker clustering on a session's embedding windows, and evaluation against references."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans
from .graph import checkpointed


def two_clusters(e: np.ndarray) -> np.ndarray:
    """Average-linkage clustering on cosine distance down to two clusters; labels by first appearance.

    The average distance of two clusters is 1 minus the product of their mean unit vectors, so no distances are kept: chains of
    nearest neighbours grow until two clusters are nearest to each other and merge, at one look over all clusters a step. Average linkage never
    makes a merged cluster nearer than its parts were, so the merges are those of the greedy order, and the two clusters are what the last of
    them by distance joins. Steps are 3 n at most, of n times the vectors' width.
    """
    n = len(e)
    if n < 2:
        return np.zeros(n, int)
    unit = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    mean, size, alive = unit.copy(), np.ones(n), np.ones(n, bool)
    parent, merges = np.arange(n), []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            at = chain[-1]
            near = mean @ mean[at]
            near[~alive] = -np.inf
            near[at] = -np.inf
            best = int(near.argmax())
            if len(chain) > 1 and near[chain[-2]] >= near[best]:
                best = chain[-2]
                break
            chain.append(best)
        a, b = min(at, best), max(at, best)
        merges.append((1 - near[best], a, b))
        del chain[-2:]
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    order = sorted(range(n - 1), key=lambda k: (merges[k][0], k))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k in order[:-1]:
        a, b = root(merges[k][1]), root(merges[k][2])
        parent[max(a, b)] = min(a, b)
    first = root(0)
    return np.array([0 if root(i) == first else 1 for i in range(n)])


def confidences(labelled: DataFrame) -> DataFrame:
    """labelled(session_id, label, embedding) -> (session_id, confidence): the mean cosine within clusters (1 without pairs) minus that between
    them (0 without), cut to 0..1. A cluster's sum of unit vectors holds the cosines of all its pairs, so sums are all that is shuffled."""
    norm = F.greatest(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    parts = labelled.select("session_id", "label", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / norm)).alias("pos", "x"))
    sums = parts.groupBy("session_id", "label", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    own = sums.groupBy("session_id", "label").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("self"), F.max("n").alias("n"))
    inner = own.groupBy("session_id").agg(F.sum((F.col("all") - F.col("self")) / 2).alias("inner"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("self").alias("self"), F.sum("n").alias("n"))
    both = sums.groupBy("session_id", "pos").agg(F.sum("s").alias("s")).groupBy("session_id").agg(F.sum(F.col("s") * F.col("s")).alias("total"))
    met = inner.join(both, "session_id")
    within = F.when(F.col("pairs") > 0, F.col("inner") / F.col("pairs")).otherwise(1.0)
    across, crossing = (F.col("total") - F.col("self")) / 2 - F.col("inner"), F.col("n") * (F.col("n") - 1) / 2 - F.col("pairs")
    between = F.when(crossing > 0, across / crossing).otherwise(0.0)
    return met.select("session_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), within - between)).alias("confidence"))


def confidence(e: np.ndarray, labels: np.ndarray) -> float:
    """As confidences(), for one session."""
    unit = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12)
    sums = [unit[labels == k].sum(0) for k in np.unique(labels)]
    own = (unit * unit).sum()
    inner = (sum(s @ s for s in sums) - own) / 2
    across = (unit.sum(0) @ unit.sum(0) - own) / 2 - inner
    n, counts = len(e), np.bincount(np.unique(labels, return_inverse=True)[1])
    pairs = (counts * (counts - 1)).sum() / 2
    crossing = n * (n - 1) / 2 - pairs
    return float(np.clip((inner / pairs if pairs else 1.0) - (across / crossing if crossing else 0.0), 0, 1))


def _labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("window_idx")
    labels = two_clusters(np.stack(pdf.embedding.to_list()).astype(float))
    return pd.DataFrame({"session_id": pdf.session_id, "window_idx": pdf.window_idx, "label": labels})


def reclustered(windows: DataFrame, least: float = 0.30) -> DataFrame:
    """windows(session_id, window_idx, embedding) -> window_idx, speaker, confidence; a session whose clusters are no
    clearer than `least` keeps one speaker. A session's windows are clustered in one call, in memory that grows with their number, and checkpointed, as they are read twice; how sure that is, is an aggregate."""
    w = windows.select("session_id", "window_idx", "embedding")
    labels = checkpointed(w.groupBy("session_id").applyInPandas(_labelled, "session_id long, window_idx long, label int"))
    sure = confidences(labels.join(w, ["session_id", "window_idx"]))
    speaker = F.format_string("SPEAKER_%02d", F.when(F.col("confidence") < least, 0).otherwise(F.col("label")))
    return labels.join(sure, "session_id").select("session_id", "window_idx", speaker.alias("speaker"), F.round("confidence", 6).alias("confidence"))


def anchors(turns: DataFrame, least: float = 0.6, apart: float = 8.0) -> DataFrame:
    """turns(session_id, speaker, start_sec, end_sec, f0, embedding): the openings' turns of each speaker -> (session_id, low, high): the mean embedding of the deeper and
    of the higher voice, as unit vectors, from turns of at least `least` seconds. Only sessions of two speakers whose median pitches lie `apart` Hz or more
    from each other have anchors. Sums by position are partial aggregates."""
    voice = turns.groupBy("session_id", "speaker").agg(F.percentile("f0", F.lit(0.5)).alias("f0"))
    pair = voice.groupBy("session_id").agg(F.count("*").alias("n"), F.min(F.struct("f0", "speaker")).alias("low"), F.max(F.struct("f0", "speaker")).alias("high"), F.count("f0").alias("known"))
    pair = pair.where((F.col("n") == 2) & (F.col("known") == 2) & (F.col("high.f0") - F.col("low.f0") >= apart))
    long = turns.where((F.col("end_sec") - F.col("start_sec") >= least) & F.col("embedding").isNotNull())
    means = long.select("session_id", "speaker", F.posexplode("embedding").alias("pos", "x")).groupBy("session_id", "speaker", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("session_id", "speaker").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).where("norm >= 1e-9")
    unit = vectors.select("session_id", "speaker", F.transform("v", lambda p: p["x"] / F.col("norm")).alias("v"))
    side = lambda name: unit.select("session_id", F.col("speaker").alias(f"{name}_speaker"), F.col("v").alias(name))
    named = pair.select("session_id", F.col("low.speaker").alias("low_speaker"), F.col("high.speaker").alias("high_speaker"))
    return named.join(side("low"), ["session_id", "low_speaker"]).join(side("high"), ["session_id", "high_speaker"]).select("session_id", "low", "high")


def best_assignment(gain: np.ndarray) -> int:
    """Largest sum of an integer (n, m) matrix, n <= m, with one cell in each row and no two in a column: shortest
    augmenting paths, n * n * m steps."""
    n, m = gain.shape
    cost = -gain.astype(np.int64)
    u, v = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
    row_of = np.zeros(m + 1, int)  # rows and columns count from 1; column 0 holds the row that is being placed
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        low, before, done = np.full(m + 1, np.iinfo(np.int64).max), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[at]:
            done[at] = True
            free = np.flatnonzero(~done)
            new = cost[row_of[at] - 1, free - 1] - u[row_of[at]] - v[free]
            better = new < low[free]
            low[free[better]], before[free[better]] = new[better], at
            nearest = int(free[low[free].argmin()])
            step = low[nearest]
            u[row_of[done]] += step
            v[done] -= step
            low[free] -= step
            at = nearest
        while at:
            row_of[at] = row_of[before[at]]
            at = before[at]
    return int(sum(gain[row_of[j] - 1, j - 1] for j in range(1, m + 1) if row_of[j]))


def permutation_accuracy(pairs: DataFrame, a: str, b: str) -> float:
    """Share of rows whose labels agree under the best one-to-one mapping. The confusion matrix is aggregated natively;
    the assignment is solved on the whole of it."""
    cells = {(r[a], r[b]): r["n"] for r in pairs.groupBy(a, b).agg(F.count("*").alias("n")).collect()}  # labels squared
    left, right = sorted({x for x, _ in cells}, key=str), sorted({y for _, y in cells}, key=str)
    if len(left) > len(right):
        cells, left, right = {(y, x): n for (x, y), n in cells.items()}, right, left
    total = sum(cells.values())
    gain = np.array([[cells.get((x, y), 0) for y in right] for x in left], np.int64)
    return best_assignment(gain) / total if total else 0.0


def best_matches(pairs: DataFrame, least: float = 0.05) -> DataFrame:
    """pairs(la, lb, c): similarity of labels of two sides -> (la, lb, c, mutual, ok, clear): each label's best match (ties: the first label), whether that
    match's best is the label itself, whether both also lead their second best (-1 without one) by `least`, and whether all labels are so."""

    def lead(own: str, other: str) -> DataFrame:
        two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), F.col(other).alias("to")))), 1, 2)  # labels are few
        best = pairs.where("c is not null").groupBy(own).agg(two.alias("t"))
        c, second = -F.col("t")[0]["d"], F.coalesce(-F.get("t", F.lit(1))["d"], F.lit(-1.0))
        return best.select(own, F.col("t")[0]["to"].alias(other), c.alias("c"), (c - second >= least).alias("leads"))

    back = lead("lb", "la").select("lb", F.col("la").alias("back"), F.col("leads").alias("back_leads"))
    met = lead("la", "lb").join(back, "lb").withColumn("mutual", F.col("back") == F.col("la")).withColumn("ok", F.col("leads") & F.col("back_leads") & F.col("mutual"))
    every = pairs.agg(F.count_distinct("la").alias("labels"))
    clear = met.agg(F.count_if("ok").alias("oks")).crossJoin(F.broadcast(every)).select((F.col("oks") == F.col("labels")).alias("clear"))  # one row
    return met.crossJoin(F.broadcast(clear)).select("la", "lb", "c", "mutual", "ok", "clear")


def mutual_map(pairs: DataFrame, least: float = 0.05) -> DataFrame:
    """pairs as above -> the map (la, lb, c) if it is clear as a whole, else no row."""
    return best_matches(pairs, least).where("clear").select("la", "lb", "c")


def greedy_mapping(areas: list[tuple[str, str, float]]) -> dict[str, str]:
    """(a, b, seconds) -> one-to-one map, largest overlap first."""
    out: dict[str, str] = {}
    for a, b, _ in sorted(areas, key=lambda x: (-x[2], x[0], x[1])):
        if a not in out and b not in out.values():
            out[a] = b
    return out


PARTS = (("train", 0.70), ("val", 0.15), ("test", 0.15))


def greedy_counts(sizes: list[tuple[int, int]], parts=PARTS) -> list[tuple[int, str, int, int]]:
    """sizes: (size, how many components have it) -> (size, part, first, last): which ranks among the components of a size go to a part, when the largest
    come first and each goes to the part that lacks most of its share, earlier parts winning ties. One step per size and part: of components of one size,
    a part takes as many as its lack exceeds the others' lacks for."""
    total = sum(s * m for s, m in sizes)
    lack = {p: Fraction(str(share)) * total for p, share in parts}
    out = []
    for size, m in sorted(sizes, reverse=True):
        if size <= 0:
            continue
        # lacks after j components are lack - j * size; the m largest of all parts are taken
        low = min(lack.values()) - size * m
        floor_, top = low, max(lack.values())
        took = lambda t: {p: max(0, -((t - n) // size)) for p, n in lack.items()}  # noqa: B023, E731  how many lie above t
        a, b = 0, int((top - low) // size) + 1  # steps of size above low: at b none lies above, at a at least m do
        while b - a > 1:
            c = (a + b) // 2
            a, b = (c, b) if sum(took(floor_ + c * size).values()) >= m else (a, c)
        taken = took(floor_ + b * size)
        rest = sorted(((-(lack[p] - taken[p] * size), k, p) for k, (p, _) in enumerate(parts)))
        while sum(taken.values()) < m:
            _, k, p = rest.pop(0)
            taken[p] += 1
            rest = sorted([*rest, (-(lack[p] - taken[p] * size), k, p)])
        at = 1
        for p, _ in parts:
            if taken[p]:
                out.append((size, p, at, at + taken[p] - 1))
                at += taken[p]
            lack[p] -= taken[p] * size
    return out


def component_split(members: DataFrame, component: str, parts=PARTS) -> DataFrame:
    """members(component, ...) -> (component, size, part). The plan is made from counts of component sizes, as many numbers as there are different sizes; a component's
    rank within its size is a scan over their hashes, so neither components nor members meet in one place."""
    sizes = checkpointed(members.groupBy(component).agg(F.count("*").alias("size")))
    counts = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]  # different sizes: at most the square root of twice the members
    plan = members.sparkSession.createDataFrame(greedy_counts(counts, parts), "size long, part string, first long, last long")
    ranked = scans.Sliced(sizes.withColumn("_h", F.xxhash64(component)), ["size"], ["_h", component]).add("rank", scans.row_number()).result()
    met = ranked.join(plan, "size").where(F.col("rank").between(F.col("first"), F.col("last")))
    return met.select(component, "size", "part")


def greedy_split(sizes: list[tuple[str, int]], shares=(("train", 0.70), ("val", 0.15), ("test", 0.15))) -> dict[str, str]:
    """Components, largest first, to the part that lacks most of its share; earlier parts win ties."""
    total = sum(n for _, n in sizes)
    have = dict.fromkeys((p for p, _ in shares), 0)
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        part = max(shares, key=lambda p: (p[1] * total - have[p[0]], -[q for q, _ in shares].index(p[0])))[0]
        out[name] = part
        have[part] += n
    return out
