"""Series and vector operators: beats, onsets, peaks, profiles, levels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import MAJOR_PROFILE, MINOR_PROFILE, MINOR_WEIGHT


def beats_in_window(grids: DataFrame, until_ms: int) -> DataFrame:
    """(track_id, beat, at_ms, in_bar) of every beat before ``until_ms``; grids without a tempo or anchor have none."""
    step = F.lit(60_000.0) / F.col("bpm")
    ok = (F.col("bpm") > 0) & F.col("beat_offset_ms").isNotNull() & (F.col("beat_offset_ms") < until_ms)
    n = F.ceil((F.lit(until_ms) - F.col("beat_offset_ms")) / step).cast("int")
    own = grids.filter(ok).withColumn("step", step).withColumn("n", n).filter("n > 0")
    long = own.select("track_id", "beat_offset_ms", "step", F.coalesce("first_beat_number", F.lit(1)).alias("first"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("beat"))
    return long.select("track_id", "beat", F.round(F.col("beat_offset_ms") + F.col("beat") * F.col("step"), 3).alias("at_ms"), (F.pmod(F.col("first") - 1 + F.col("beat"), F.lit(4)) + 1).cast("int").alias("in_bar"))


def beats_of_track(grids: DataFrame, lengths: DataFrame) -> DataFrame:
    """(track_id, beat, at_ms, in_bar) of every beat up to the track's end, inclusive; ``lengths``: (track_id, duration_ms).

    The last beat is the last one whose position, rounded to milliseconds, isn't beyond the end. A track without a tempo,
    anchor or length has none.
    """
    step = F.lit(60_000.0) / F.col("bpm")
    own = grids.filter((F.col("bpm") > 0) & F.col("beat_offset_ms").isNotNull()).join(lengths.filter("duration_ms > 0"), "track_id")
    last = F.ceil((F.col("duration_ms") + F.lit(0.5) - F.col("beat_offset_ms")) / step).cast("int") - 1
    own = own.withColumn("step", step).withColumn("last", last).filter("last >= 0")
    long = own.select("track_id", "beat_offset_ms", "step", F.coalesce("first_beat_number", F.lit(1)).alias("first"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("beat"))
    return long.select("track_id", "beat", F.round(F.col("beat_offset_ms") + F.col("beat") * F.col("step"), 3).alias("at_ms"), (F.pmod(F.col("first") - 1 + F.col("beat"), F.lit(4)) + 1).cast("int").alias("in_bar"))


def shifted(bpm: Column, offset_ms: Column, by_ms: int) -> Column:
    """The anchor moved; before 0 it rolls on by whole bars of four."""
    bar = 4 * 60_000.0 / bpm
    moved_to = offset_ms + by_ms
    return F.when(moved_to < 0, moved_to + F.ceil(-moved_to / bar) * bar).otherwise(moved_to.cast("double"))


def scaled_tempo(bpm: Column, factor: float) -> Column:
    """Halved or doubled, unless it would leave 40 to 300."""
    new = bpm * factor
    return F.when(new.between(40, 300), new).otherwise(bpm)


def onset_flux(series: DataFrame, part: str, order: str, value: str, radius: int = 16) -> DataFrame:
    """Rises of ln(1 + value), less their mean over ±radius steps, not below 0."""
    w = Window.partitionBy(part).orderBy(order)
    rise = F.greatest(F.log1p(F.col(value)) - F.coalesce(F.log1p(F.lag(value).over(w)), F.lit(0.0)), F.lit(0.0))
    flux = series.withColumn("flux", rise)
    local = F.avg("flux").over(w.rowsBetween(-radius, radius))
    return flux.select(part, order, F.round(F.greatest(F.col("flux") - local, F.lit(0.0)), 6).alias("onset"))


def autocorrelation(series: DataFrame, part: str, order: str, value: str, lags: int) -> DataFrame:
    """(part, lag, acf): mean-removed, normalised by lag 0; one window pass for each lag and no self-join."""
    mean = F.avg(value).over(Window.partitionBy(part))
    x = series.withColumn("x", F.col(value) - mean)
    w = Window.partitionBy(part).orderBy(order)
    x = x.select(part, *[(F.col("x") * (F.lag("x", k).over(w) if k else F.col("x"))).alias(f"p{k}") for k in range(lags + 1)])
    terms = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{k}").alias("p")) for k in range(lags + 1)])
    sums = x.select(part, F.explode(terms).alias("t")).groupBy(part, F.col("t.lag").alias("lag")).agg(F.sum("t.p").alias("s"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(Window.partitionBy(part))
    return sums.withColumn("zero", zero).filter("lag > 0").select(part, "lag", F.round(F.coalesce(F.try_divide(F.col("s"), F.col("zero")), F.lit(0.0)), 6).alias("acf"))


def peaks(series: DataFrame, part: str, order: str, value: str, floor: float = 0.1) -> DataFrame:
    """Values at least ``floor`` of the part's maximum and not below their neighbours."""
    w = Window.partitionBy(part).orderBy(order)
    top = F.max(value).over(Window.partitionBy(part))
    v = F.col(value)
    return series.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w)).withColumn("top", top).filter((v >= floor * F.col("top")) & (v >= F.coalesce("before", v)) & (v >= F.coalesce("after", v))).select(part, order, value)


def profile_scores(profiles: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, tonic, is_major, score): best of 24 correlations of a 12-vector with the turned profiles; silent vectors none.

    Of equal scores the lower tonic wins, major before minor.
    """
    best = None
    v = F.col(vec)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / 12
    options = []
    for tonic in range(12):
        for major, profile, weight in ((True, MAJOR_PROFILE, 1.0), (False, MINOR_PROFILE, MINOR_WEIGHT)):
            turned = [profile[(k - tonic) % 12] for k in range(12)]
            m = sum(turned) / 12
            dev = [p - m for p in turned]
            norm = math.sqrt(sum(d * d for d in dev))
            dot = sum((F.try_element_at(v, F.lit(k + 1)) - F.col("mean")) * F.lit(dev[k]) for k in range(12))
            score = F.round(dot / (F.col("norm") * norm), 9)
            options.append(F.struct(F.when(score > 0, score * weight).otherwise(score).alias("score"), F.lit(-(2 * tonic + (0 if major else 1))).alias("first"), F.lit(tonic).alias("tonic"), F.lit(major).alias("is_major")))
    best = F.array_max(F.array(*options))
    own = profiles.withColumn("mean", mean).withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))))
    return own.filter("norm > 0").withColumn("b", best).select(id_col, F.col("b.tonic").alias("tonic"), F.col("b.is_major").alias("is_major"), F.round(F.col("b.score"), 6).alias("score"))


def levels(vec: Column) -> tuple[Column, Column]:
    """(peak, rms in dBFS): the largest absolute value; -120 for silence."""
    peak = F.aggregate(vec, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    mean_sq = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.greatest(F.size(vec), F.lit(1))
    return peak, F.when(mean_sq > 0, 10 * F.log10(mean_sq)).otherwise(F.lit(-120.0))


def smoothed(series: DataFrame, part: str, order: str, value: str, radius: int = 5) -> DataFrame:
    """The mean over ±radius steps, over what there is at the edges."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-radius, radius)
    return series.select(part, order, F.round(F.avg(value).over(w), 6).alias("smooth"))


def sharpened(series: DataFrame, part: str, order: str, value: str, radius: int = 6, amount: float = 1.2) -> DataFrame:
    """Values raised above their local mean and lowered below it, not below 0."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-radius, radius)
    v = F.col(value)
    return series.select(part, order, F.round(F.greatest(v + F.lit(amount) * (v - F.avg(v).over(w)), F.lit(0.0)), 6).alias("sharp"))


def novelties(profiles: DataFrame, part: str, order: str, vec: str) -> DataFrame:
    """Sum of absolute differences of each vector from the one before in its part; 0 for the first."""
    before = F.lag(vec).over(Window.partitionBy(part).orderBy(order))
    apart = F.aggregate(F.zip_with(F.col(vec), before, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return profiles.withColumn("before", before).select(part, order, F.round(F.when(F.col("before").isNull(), F.lit(0.0)).otherwise(apart), 6).alias("novelty"))


def periods(acf: DataFrame, part: str, lags: int, centre: float, spread: float, harmonics: int = 4) -> DataFrame:
    """(part, lag, refined, confidence): the best period of each part from its autocorrelation (part, lag, acf).

    A lag's score is the sum of the values at its multiples, the k-th by 1/k, times a bell over the logarithm of the lag
    around ``centre``; lags up to ``lags`` are scored, multiples beyond what is given count 0. The peak is refined by the
    parabola through its neighbours; confidence is 1 less the median of the positive scores over the best. Equal scores: the
    shorter lag.
    """
    teeth = acf.select(part, "lag", "acf", F.explode(F.array(*[F.lit(k) for k in range(1, harmonics + 1)])).alias("k")).filter((F.col("lag") % F.col("k") == 0) & (F.col("lag") / F.col("k") <= lags))
    sums = teeth.groupBy(part, (F.col("lag") / F.col("k")).cast("int").alias("lag")).agg(F.sum(F.col("acf") / F.col("k")).alias("s"))
    bell = F.exp(F.lit(-0.5) * F.pow(F.log2(F.col("lag") / F.lit(centre)) / F.lit(spread), F.lit(2)))
    scored = sums.select(part, "lag", F.round(F.col("s") * bell, 9).alias("score"))
    w = Window.partitionBy(part).orderBy("lag")
    scored = scored.withColumn("b", F.lag("score").over(w)).withColumn("a", F.lead("score").over(w))
    bend = F.col("b") - 2 * F.col("score") + F.col("a")
    shift = F.when(F.abs(bend) > 1e-9, F.least(F.greatest(F.lit(0.5) * (F.col("b") - F.col("a")) / bend, F.lit(-1.0)), F.lit(1.0)))
    top = scored.groupBy(part).agg(F.max_by(F.struct("lag", F.round(F.col("lag") + F.coalesce(shift, F.lit(0.0)), 6).alias("refined"), "score"), F.struct("score", -F.col("lag"))).alias("m"), F.percentile(F.when(F.col("score") > 0, F.col("score")), F.lit(0.5)).alias("mid"))
    return top.filter("m.score > 0").select(part, F.col("m.lag").alias("lag"), F.col("m.refined").alias("refined"), F.round(1 - F.col("mid") / F.col("m.score"), 6).alias("confidence"))


def followed(rows: DataFrame, id_col: str, vec: str, attack: float, release: float) -> DataFrame:
    """(id, follow): vectors through a follower that is fast up and slow down. Each value depends on the last, so a vector is
    walked once in a worker."""
    from ..functions.dsp import follower

    def run(batches):
        for b in batches:
            b["follow"] = [np.round(follower(np.asarray(v, dtype=np.float64), attack, release), 6) for v in b[vec]]
            yield b[[id_col, "follow"]]

    return rows.select(id_col, vec).mapInPandas(run, f"{id_col} bigint, follow array<double>")


def binned(vec: Column, bins: int) -> Column:
    """Largest absolute value of each of ``bins`` stretches of equal length (rounded up), as a byte; missing ones are 0."""
    per = F.greatest(F.ceil(F.size(vec) / bins), F.lit(1)).cast("int")
    stretch = lambda i: F.when(i * per < F.size(vec), F.array_max(F.transform(F.slice(vec, i * per + 1, per), lambda x: F.abs(x.cast("double")))))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.round(F.least(F.coalesce(stretch(i), F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))


# -- grids as (bpm, first beat in ms, phase: index of the first downbeat) -----------------------------------------------


def grid_shifted(bpm: Column, first: Column, phase: Column, by_ms: Column) -> Column:
    """The grid moved; an anchor before 0 rolls on by whole beats and the phase with it, so downbeats stay where they are."""
    period = F.lit(60_000.0) / F.greatest(bpm, F.lit(1.0))
    moved = first + by_ms
    beats = F.when(moved < 0, F.ceil(-moved / period)).otherwise(F.lit(0)).cast("bigint")
    return F.struct(bpm.alias("bpm"), (moved + beats * period).alias("first"), F.pmod(phase - beats, F.lit(4)).cast("int").alias("phase"))


def grid_snapped(bpm: Column, first: Column, phase: Column, at_ms: Column) -> Column:
    """The grid moved so that its nearest beat lies at ``at_ms``."""
    period = F.lit(60_000.0) / F.greatest(bpm, F.lit(1.0))
    return grid_shifted(bpm, first, phase, at_ms - (first + F.round((at_ms - first) / period) * period))


def grid_beat_one(bpm: Column, first: Column, phase: Column, at_ms: Column) -> Column:
    """The grid snapped to ``at_ms``, and that beat made a downbeat."""
    g = grid_snapped(bpm, first, phase, at_ms)
    period = F.lit(60_000.0) / F.greatest(bpm, F.lit(1.0))
    return F.struct(g["bpm"].alias("bpm"), g["first"].alias("first"), F.pmod(F.round((at_ms - g["first"]) / period), F.lit(4)).cast("int").alias("phase"))


def grid_scaled(bpm: Column, first: Column, phase: Column, factor: float) -> Column:
    """The tempo times ``factor`` within 40 to 300; the first downbeat keeps its place and stays one."""
    downbeat = first + phase * (F.lit(60_000.0) / F.greatest(bpm, F.lit(1.0)))
    return grid_beat_one(F.least(F.greatest(bpm * factor, F.lit(40.0)), F.lit(300.0)), first, phase, downbeat)


def beat_lines(grids: DataFrame, from_s: float, to_s: float, width_px: float) -> DataFrame:
    """(track_id, x, is_downbeat) of the lines drawn for a stretch of time: none where beats lie less than 2 px apart, only
    downbeats below 6 px. grids: (track_id, bpm, first, phase); the rows of a track are bounded by the width."""
    period = F.lit(60.0) / F.greatest(F.col("bpm"), F.lit(1.0))
    px = period / F.lit(to_s - from_s) * width_px
    start = F.col("first") / 1000
    own = grids.filter(F.col("bpm") > 0).withColumn("period", period).withColumn("px", px).filter("px >= 2").withColumn("start", start)
    i0, i1 = F.floor((F.lit(from_s) - F.col("start")) / F.col("period")), F.ceil((F.lit(to_s) - F.col("start")) / F.col("period"))
    long = own.withColumn("i", F.explode(F.sequence(i0, i1))).withColumn("t", F.col("start") + F.col("i") * F.col("period"))
    bar = F.pmod(F.col("i") - F.col("phase"), F.lit(4)) == 0
    return long.filter(F.col("t").between(from_s, to_s) & (bar | (F.col("px") >= 6))).select("track_id", F.round((F.col("t") - from_s) / (to_s - from_s) * width_px, 3).alias("x"), bar.alias("is_downbeat"))
