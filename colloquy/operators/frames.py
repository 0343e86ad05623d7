"""Audio as rows: pieces of recordings become frames of equal length, gains and silences are decided per frame, frames become pieces again.

pieces(rec_id, rate, piece, samples array<double>): a recording's samples in order of `piece`, in parts of any length, so that a long recording
is many rows. All operators return such rows; joined() makes one array of a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .sequences import differs, islands

# Aimed level, greatest gain, window and hop of the gain, the gate (share of windows that are noise, its level in dB, how far
# above it speech is), silences (level, longest, what is left of one, frame), what counts as clipped.
TARGET, MOST_GAIN, WINDOW_MS, HOP_MS = 0.1, 10.0, 500, 100
NOISE_SHARE, GATE_DB, GATE_MARGIN = 0.10, -50.0, 3.0
QUIET, LONGEST, LEFT, FRAME_MS = 0.005, 1.0, 0.5, 20
CLIPPED, CLEAN_DB = 0.99, 60.0


def _squares(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x)


def framed(pieces: DataFrame, ms: int) -> DataFrame:
    """(rec_id, rate, frame, samples, whole): frames of ms milliseconds, numbered from 0; whole is false for a last one that is shorter. A piece is
    cut where frames begin, its place being the running number of samples before it; parts of a frame meet by their places."""
    length = F.greatest(F.lit(1), F.floor(F.col("rate") * ms / 1000)).cast("long")
    p = pieces.select("rec_id", "rate", "piece", "samples", F.size("samples").cast("long").alias("n"), length.alias("length")).where("n > 0")
    p = scans.Sliced(p, ["rec_id"], ["piece"]).add("until", scans.running_sum(F.col("n"))).result().withColumn("at", F.col("until") - F.col("n"))
    p = p.withColumn("frame", F.explode(F.sequence(F.floor(F.col("at") / F.col("length")), F.floor((F.col("until") - 1) / F.col("length")))))
    low, high = F.greatest(F.col("at"), F.col("frame") * F.col("length")), F.least(F.col("until"), (F.col("frame") + 1) * F.col("length"))
    part = F.slice("samples", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(low.alias("low"), part.alias("part")))), lambda x: x["part"]))
    f = p.groupBy("rec_id", "rate", "frame", "length").agg(whole.alias("samples"))
    return f.select("rec_id", "rate", "frame", "samples", (F.size("samples") == F.col("length")).alias("whole"))


def as_pieces(frames: DataFrame) -> DataFrame:
    return frames.select("rec_id", "rate", F.col("frame").alias("piece"), "samples")


def joined(pieces: DataFrame) -> DataFrame:
    """(rec_id, rate, samples): all of a recording in one array."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "samples"))), lambda x: x["samples"])
    return pieces.groupBy("rec_id", "rate").agg(F.flatten(parts).alias("samples"))


def window_levels(frames: DataFrame, per: int) -> DataFrame:
    """frames and, where `per` whole frames begin with one, their root mean square (level), else null."""
    ahead = Window.partitionBy("rec_id").orderBy("frame").rowsBetween(0, per - 1)
    energy, n = F.sum(_squares(F.col("samples"))).over(ahead), F.sum(F.size("samples")).over(ahead)
    return frames.withColumn("level", F.when(F.count_if("whole").over(ahead) == per, F.sqrt(energy / n)))


def locally_gained(pieces: DataFrame, gated: bool = False) -> DataFrame:
    """Quiet stretches are raised: the gain of half-second windows, a tenth of a second apart, runs evenly between their middles. gated: windows that are not
    clearly above the noise keep their level; noise is the lowest tenth of a recording's windows that are not empty, or the fixed floor.
    Recordings shorter than a window stay as they are. A frame's gain needs its neighbours' windows only, and three numbers of its recording."""
    per = WINDOW_MS // HOP_MS
    f = window_levels(framed(pieces, HOP_MS), per)
    gain = F.when(F.col("level") > 1e-7, F.greatest(F.lit(1.0), F.least(TARGET / F.col("level"), F.lit(MOST_GAIN)))).otherwise(1.0)
    if gated:
        noise = F.greatest(F.coalesce(F.percentile(F.when(F.col("level") > 1e-9, F.col("level")), F.lit(NOISE_SHARE)), F.lit(0.0)), F.lit(10 ** (GATE_DB / 20)))
        f = f.join(f.groupBy("rec_id").agg((noise * GATE_MARGIN).alias("gate")), "rec_id")
        gain = F.when(F.col("level") < F.col("gate"), 1.0).otherwise(gain)
    f = f.withColumn("gain", F.when(F.col("level").isNotNull(), gain)).drop("level", "gate")
    known = F.when(F.col("gain").isNotNull(), F.col("frame"))
    ends = f.groupBy("rec_id").agg(F.min_by("gain", known).alias("first"), F.max_by("gain", known).alias("last"), F.max(known).alias("last_at"), F.max(F.size("samples")).alias("hop"))
    f = f.join(ends, "rec_id")
    # the middle of window k is (per / 2 + k) hops in, so a frame lies between the windows that begin `back` + 1, `back` and `back` - 1 frames before
    middle = F.floor(F.col("hop") * per / 2).cast("long")
    back, rest = per // 2, middle - (per // 2) * F.col("hop")
    w = Window.partitionBy("rec_id").orderBy("frame")

    def near(offset: int) -> Column:
        there = F.col("frame") - offset
        value = F.lag("gain", offset).over(w) if offset >= 0 else F.lead("gain", -offset).over(w)
        return F.when(there < 0, F.col("first")).when(there >= F.col("last_at"), F.col("last")).otherwise(value)

    f = f.withColumn("g", F.array(near(back + 1), near(back), near(back - 1))).withColumn("rest", rest)

    def raised(x: Column, j: Column) -> Column:
        early = j < F.col("rest")
        a, b = F.when(early, F.col("g")[0]).otherwise(F.col("g")[1]), F.when(early, F.col("g")[1]).otherwise(F.col("g")[2])
        share = (j - F.col("rest")) / F.col("hop") + F.when(early, 1.0).otherwise(0.0)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * (a + share * (b - a))))

    return as_pieces(f.withColumn("samples", F.when(F.col("last_at").isNull(), F.col("samples")).otherwise(F.transform("samples", raised))))


def normalized(pieces: DataFrame) -> DataFrame:
    """A recording below the aimed level is raised as a whole, by the greatest gain at most."""
    level = pieces.groupBy("rec_id").agg(F.sqrt(F.sum(_squares(F.col("samples"))) / F.sum(F.size("samples"))).alias("rms"))
    gain = F.when(F.col("rms") >= 1e-7, F.greatest(F.lit(1.0), F.least(TARGET / F.col("rms"), F.lit(MOST_GAIN)))).otherwise(1.0)
    met = pieces.join(level, "rec_id").withColumn("gain", gain)
    return met.select("rec_id", "rate", "piece", F.when(F.col("gain") > 1, F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.col("gain"))))).otherwise(F.col("samples")).alias("samples"))


def silence_compressed(pieces: DataFrame, quiet: float = QUIET) -> DataFrame:
    """Silences of more than LONGEST seconds become LEFT seconds of nothing. Runs of quiet frames are islands, counted by scans."""
    f = framed(pieces, FRAME_MS)
    f = f.withColumn("quiet", F.col("whole") & (F.sqrt(_squares(F.col("samples")) / F.size("samples")) < quiet))
    f = islands(f, ["rec_id"], ["frame"], differs("quiet"), "run")
    runs = f.groupBy("rec_id", "run").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    f = f.join(runs, ["rec_id", "run"])
    size, rate = F.size("samples"), F.col("rate")
    cut = F.col("quiet") & (F.col("n") * size > F.floor(LONGEST * rate))
    left = F.greatest(F.lit(0), F.least(size, F.floor(LEFT * rate).cast("int") - ((F.col("frame") - F.col("first")) * size).cast("int")))
    return as_pieces(f.withColumn("samples", F.when(cut, F.array_repeat(F.lit(0.0), left)).otherwise(F.col("samples"))).where(F.size("samples") > 0))


def statistics(pieces: DataFrame) -> DataFrame:
    """(rec_id, rms, clipping_ratio, snr_db): the level, the share of samples at the limit, and by how much the louder half of tenth-second frames
    lies above the quietest tenth."""
    clipped = F.size(F.filter("samples", lambda x: F.abs(x) > CLIPPED))
    whole = pieces.groupBy("rec_id").agg(F.sum(_squares(F.col("samples"))).alias("e"), F.sum(F.size("samples")).alias("n"), F.sum(clipped).alias("c"))
    levels = framed(pieces, 100).where("whole").groupBy("rec_id").agg(F.array_sort(F.collect_list(F.sqrt(_squares(F.col("samples")) / F.size("samples")))).alias("l"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    k = F.size("l")
    noise, speech = mean(F.slice("l", F.lit(1), F.greatest(F.lit(1), F.floor(k / 10).cast("int")))), mean(F.slice("l", F.floor(k / 2).cast("int") + 1, k))
    snr = F.when(k > 1, F.when(noise > 1e-8, 20 * F.log10(speech / noise)).otherwise(CLEAN_DB)).otherwise(0.0)
    met = whole.join(levels.select("rec_id", snr.alias("snr")), "rec_id", "left")
    return met.select("rec_id", F.round(F.sqrt(F.col("e") / F.col("n")), 4).alias("rms"), F.round(F.col("c") / F.col("n"), 5).alias("clipping_ratio"), F.round(F.coalesce("snr", F.lit(0.0)), 1).alias("snr_db"))


def only(pieces: DataFrame, spans: DataFrame, keep: bool = True) -> DataFrame:
    """Samples inside (keep) or outside of spans(rec_id, start_sec, end_sec) stay, the others become nothing; bounds are cut to whole samples. Spans are merged first."""
    from .intervals import merged, overlap_join

    size = framed(pieces, FRAME_MS).withColumn("at", F.col("frame") * F.greatest(F.lit(1), F.floor(F.col("rate") * FRAME_MS / 1000)))
    f = size.withColumn("start_sec", F.col("at") / F.col("rate")).withColumn("end_sec", (F.col("at") + F.size("samples")) / F.col("rate"))
    s = merged(spans.where("end_sec > start_sec"), ["rec_id"]).select("rec_id", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"))
    met = overlap_join(f.select("rec_id", "frame", "start_sec", "end_sec"), s, ["rec_id"], (F.col("r_start") < F.col("end_sec")) & (F.col("r_end") > F.col("start_sec")))
    own = met.groupBy("rec_id", "frame").agg(F.collect_list(F.struct(F.col("r_start").alias("a"), F.col("r_end").alias("b"))).alias("spans"))
    f = f.join(own, ["rec_id", "frame"], "left")
    inside = lambda i: F.coalesce(F.exists("spans", lambda s: (i >= F.floor(s["a"] * F.col("rate"))) & (i < F.floor(s["b"] * F.col("rate")))), F.lit(False))
    return as_pieces(f.withColumn("samples", F.transform("samples", lambda x, j: F.when(inside(F.col("at") + j) == F.lit(keep), x).otherwise(0.0))))
