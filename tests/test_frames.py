"""Audio as rows against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import frames

RATE = 1000


def gain_by_windows(a, rate, gated):
    w, hop = rate // 2, rate // 10
    if len(a) < w:
        return a
    starts = range(0, len(a) - w + 1, hop)
    level = np.array([np.sqrt(np.mean(a[s : s + w] ** 2)) for s in starts])
    gain = np.array([max(1.0, min(0.1 / x, 10.0)) if x > 1e-7 else 1.0 for x in level])
    if gated:
        some = level[level > 1e-9]
        floor = max(np.percentile(some, 10) if len(some) else 0, 10 ** (-50 / 20))
        gain[level < 3 * floor] = 1.0
    return np.clip(a * np.interp(np.arange(len(a)), [s + w // 2 for s in starts], gain), -1, 1)


def without_silence(a, rate):
    n = rate // 50
    f = a[: len(a) // n * n].reshape(-1, n)
    quiet = np.sqrt((f**2).mean(1)) < 0.005
    out, k = [], 0
    while k < len(f):
        z = k
        while z < len(f) and quiet[z] == quiet[k]:
            z += 1
        out.append(np.zeros(rate // 2) if quiet[k] and (z - k) * n > rate else f[k:z].ravel())
        k = z
    return np.concatenate([*out, a[len(f) * n :]]) if len(f) else a


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(3)
    loud, soft, nothing = (lambda n: 0.3 * np.sin(np.arange(n) / 3)), (lambda n: 0.01 * rng.normal(size=n)), np.zeros
    return {
        1: np.r_[loud(1210), soft(2300), nothing(1500), loud(333), soft(777)],
        2: soft(4999),
        3: loud(499),
        4: nothing(1234),
        5: np.clip(3 * loud(2000), -1, 1),
        6: np.r_[nothing(1001), loud(501), nothing(1020), loud(20), nothing(999)],
        7: loud(500),
    }


@pytest.fixture(scope="module")
def pieces(spark, signals):
    rng, rows = np.random.default_rng(1), []
    for rec, a in signals.items():
        cuts = np.unique(np.r_[0, rng.integers(0, len(a), 9), len(a)])
        rows += [(rec, RATE, k, a[x:y].tolist()) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    rows.append((1, RATE, 99, []))
    return spark.createDataFrame(rows, "rec_id int, rate int, piece long, samples array<double>")


def whole(df):
    return {r.rec_id: np.array(r.samples) for r in frames.joined(df).collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k]) and np.allclose(got[k], want[k], atol=1e-9), k


@pytest.mark.parametrize("ms", [20, 100, 37])
def test_frames(pieces, signals, ms):
    f = frames.framed(pieces, ms)
    close(whole(frames.as_pieces(f)), signals)
    n = RATE * ms // 1000
    assert {(r.rec_id, r.frame): len(r.samples) for r in f.collect()} == {(k, i): min(n, len(a) - i * n) for k, a in signals.items() for i in range(-(-len(a) // n))}


@pytest.mark.parametrize("gated", [False, True])
def test_local_gain(pieces, signals, gated):
    close(whole(frames.locally_gained(pieces, gated)), {k: gain_by_windows(a, RATE, gated) for k, a in signals.items()})


def test_silence(pieces, signals):
    close(whole(frames.silence_compressed(pieces)), {k: without_silence(a, RATE) for k, a in signals.items()})


def test_normalized_and_statistics(pieces, signals):
    raised = {}
    for k, a in signals.items():
        rms = np.sqrt(np.mean(a**2))
        raised[k] = a if rms < 1e-7 or rms >= 0.1 else np.clip(a * min(0.1 / rms, 10), -1, 1)
    close(whole(frames.normalized(pieces)), raised)
    got = {r.rec_id: r for r in frames.statistics(pieces).collect()}
    for k, a in signals.items():
        f = a[: len(a) // 100 * 100].reshape(-1, 100)
        level = np.sort(np.sqrt((f**2).mean(1)))
        noise, speech = level[: max(1, len(f) // 10)].mean(), level[len(f) // 2 :].mean()
        assert got[k].rms == round(np.sqrt(np.mean(a**2)), 4) and got[k].clipping_ratio == round(np.mean(np.abs(a) > 0.99), 5)
        assert abs(got[k].snr_db - (20 * np.log10(speech / noise) if noise > 1e-8 else 60.0)) <= 0.051


def test_only(spark, pieces, signals):
    spans = spark.createDataFrame([(1, 0.5, 0.9), (1, 0.85, 1.2345), (1, 3.0, 99.0), (3, -1.0, 0.1)], "rec_id int, start_sec double, end_sec double")
    inside, outside = whole(frames.only(pieces, spans)), whole(frames.only(pieces, spans, keep=False))
    for k, a in signals.items():
        m = np.zeros(len(a), bool)
        for r, s, e in [(1, 500, 1234), (1, 3000, 99000), (3, 0, 100)]:
            if r == k:
                m[s:e] = True
        assert np.allclose(inside[k], np.where(m, a, 0)) and np.allclose(outside[k], np.where(m, 0, a))


def test_one_long_recording_is_many_rows(pieces):
    assert frames.locally_gained(pieces).where("rec_id = 1").select(F.max(F.size("samples"))).first()[0] == RATE // 10
