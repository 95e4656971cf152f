from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crateline.functions import dsp
from crateline.operators import catalog, duplicates, series
from crateline.plans.signals import made_prints
from crateline.session import shared_folder, table

RATE = 44100


def clicks(bpm, seconds=30, offset_ms=0.0, accent=None, seed=0):
    """Short noise bursts at a tempo; every ``accent``-th one louder."""
    rng = np.random.default_rng(seed)
    x = np.zeros(RATE * seconds)
    k = 0
    while (at := int((offset_ms / 1000 + k * 60 / bpm) * RATE)) < len(x) - 400:
        x[at : at + 400] += rng.normal(size=400) * (1.0 if accent is None or k % accent == 0 else 0.5)
        k += 1
    return x


def kicks(bpm, offset_ms, seconds=20):
    """Decaying low tones, as of a drum."""
    x = np.zeros(RATE * seconds)
    t = np.arange(int(0.12 * RATE)) / RATE
    hit = np.sin(2 * np.pi * 60 * t) * np.exp(-t * 30)
    k = 0
    while (at := int((offset_ms / 1000 + k * 60 / bpm) * RATE)) < len(x) - len(hit):
        x[at : at + len(hit)] += hit
        k += 1
    return x


@pytest.mark.parametrize("bpm, most", [(120, 1.0), (127.3, 0.6), (90, 0.8), (128, 0.8), (140, 0.8), (174, 0.8)])
def test_tempo(bpm, most):
    got, confidence = dsp.tempo(dsp.onsets(dsp.spectrogram(clicks(bpm))), RATE / dsp.HOP)
    assert abs(got - bpm) < most and 0 < confidence < 1


def test_tempo_with_accents_and_off_beats():
    got, _ = dsp.tempo(dsp.onsets(dsp.spectrogram(clicks(138, accent=3))), RATE / dsp.HOP)
    assert abs(got - 138) < 1.5
    off = clicks(130) + 0.35 * clicks(130, offset_ms=30_000 / 130, seed=5)
    got, _ = dsp.tempo(dsp.onsets(dsp.spectrogram(off)), RATE / dsp.HOP)
    assert abs(got - 130) < 1.5


@pytest.mark.parametrize("bpm", [120, 128, 174])
@pytest.mark.parametrize("offset", [0.0, 37.0, 123.0, 400.0])
def test_anchor(bpm, offset):
    period = 60_000 / bpm
    got = dsp.snapped(kicks(bpm, offset), RATE, bpm, (offset + 20) % period)
    apart = (got - offset) % period
    assert min(apart, period - apart) < 10


def test_anchor_stays_without_attacks():
    t = np.arange(RATE * 20) / RATE
    assert dsp.snapped(np.sin(2 * np.pi * 220 * t), RATE, 128.0, 350.0) == 350.0


def bars(bpm=128, n=8):
    """Kick on every beat, claps on the second and fourth, a new chord on the first."""
    beat = int(60 / bpm * RATE)
    rng = np.random.default_rng(1)
    x = np.zeros(beat * 4 * n)
    t = np.arange(beat * 4) / RATE
    for b in range(4 * n):
        at = b * beat
        k = np.arange(int(0.1 * RATE)) / RATE
        x[at : at + len(k)] += (np.sin(2 * np.pi * 55 * k) * np.exp(-k * 30))[: len(x) - at]
        if b % 4 == 0:
            x[at : at + beat * 4] += 0.15 * np.sin(2 * np.pi * (220.0, 277.0, 330.0)[b // 4 % 3] * t)
        if b % 2 == 1:
            x[at : at + beat // 4] += rng.uniform(-0.5, 0.5, beat // 4) * np.linspace(1, 0, beat // 4)
    return x


def test_downbeat():
    x = bars()
    assert dsp.downbeat_phase(dsp.spectrogram(x), RATE, 128.0, 0.0) == 0
    assert dsp.downbeat_phase(dsp.spectrogram(x[int(60 / 128 * RATE) :]), RATE, 128.0, 0.0) == 3
    assert dsp.downbeat_phase(np.zeros((0, 2049)), RATE, 128.0, 0.0) == 0


def walls(cut_hz, seconds=6):
    rng = np.random.default_rng(3)
    n = RATE * seconds
    f = np.fft.rfft(rng.normal(size=n))
    hz = np.fft.rfftfreq(n, 1 / RATE)
    return np.fft.irfft(np.where(hz <= cut_hz, f, 0), n) * 0.1, hz, f, n


def test_low_pass():
    full, hz, f, n = walls(RATE)
    assert dsp.low_pass(dsp.spectrogram(full), RATE)[0] is None
    cut, edge = dsp.low_pass(dsp.spectrogram(walls(16_000)[0]), RATE)
    assert abs(cut - 16_000) < 600 and edge >= 25
    assert abs(dsp.low_pass(dsp.spectrogram(walls(20_000)[0]), RATE)[0] - 20_000) < 700
    ramp = np.fft.irfft(f * 10 ** (-np.maximum(hz - 12_000, 0) / 1000 * 15 / 20), n) * 0.1
    assert dsp.low_pass(dsp.spectrogram(ramp), RATE)[1] < 25
    assert dsp.low_pass(np.zeros((0, 2049)), RATE) == (None, None)


def test_previews_and_levels():
    x = np.concatenate([np.zeros(RATE * 5), 0.5 * np.sin(2 * np.pi * 60 * np.arange(RATE * 5) / RATE), 0.5 * np.sin(2 * np.pi * 5000 * np.arange(RATE * 5) / RATE)])
    c = dsp.colour_bands(x, RATE)
    assert c.shape == (400, 4)
    quiet, low, high = c[20:110].mean(axis=0), c[160:240].mean(axis=0), c[290:380].mean(axis=0)
    assert quiet.max() < 10 and low[0] > 200 > 60 > low[2] and high[2] > 200 > 60 > high[0]
    fine = dsp.fine_bands(x, RATE)
    assert fine.shape == (30_000, 4) and fine[15_000:19_000, 0].mean() > 4 * fine[25_000:29_000, 0].mean()
    assert dsp.colour_bands(np.zeros(100), RATE).shape == (1, 4) and dsp.fine_bands(np.zeros(0), RATE).shape == (0, 4)
    p = dsp.preview(np.concatenate([np.zeros(400), -np.ones(400)]))
    assert len(p) == 400 and p[0] == 0 and p[399] == 255
    gains = dsp.loudness_weights()
    assert gains[0] < 0.01 and 1.0 < gains[400] < 3.0
    assert dsp.content_hash(x) == dsp.content_hash(x.copy()) != dsp.content_hash(x[1:])
    y = np.random.default_rng(0).normal(size=1000)
    a, slow = 1 - np.exp(-2 * np.pi * 200 / RATE), []
    last = 0.0
    for v in y:
        last += a * (v - last)
        slow.append(last)
    assert np.allclose(dsp.one_pole(y, 200, RATE), slow)
    assert np.allclose(dsp.follower(np.array([0.0, 1, 1, 0]), 0.5, 0.1), [0, 0.5, 0.75, 0.675])
    assert (dsp.sharpened(np.array([1.0, 1, 5, 1, 1]), 2, 1.0)[2], dsp.sharpened(np.ones(5), 2, 1.0)[2]) == (pytest.approx(8.2), 1)


def test_analysed_whole():
    a = dsp.analysed(bars(128, 12).astype(np.float32), RATE)
    # the anchor is the first beat at or after zero, which may be the second of the bar
    assert abs(a["bpm"] - 128) < 1 and a["first_beat_number"] == round(a["beat_offset_ms"] / 468.75) % 4 + 1 and a["error"] is None and len(a["waveform"]) == 400 and len(a["waveform_bands"]) % 4 == 0
    assert min(a["beat_offset_ms"] % 468.75, 468.75 - a["beat_offset_ms"] % 468.75) < 12


def test_print_candidates_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 24, 900) for _ in range(60)]

    def changed(w, share):
        return w ^ np.array([sum(1 << k for k in range(24) if rng.random() < share) for _ in w])

    prints, hot = [], int(rng.integers(0, 1 << 24))
    for i, w in enumerate(base):
        w = w.copy()
        w[:5] = hot  # a word that all share
        prints.append((10 * i, w))
        prints.append((10 * i + 1, changed(w, 0.05)))
        prints.append((10 * i + 2, np.concatenate([rng.integers(0, 1 << 24, 20), changed(w, 0.083)])))
        prints.append((10 * i + 3, w[:79]))
    d = spark.createDataFrame([(int(i), [int(x) for x in w]) for i, w in prints], "rep bigint, words array<bigint>")
    found = {(r.a, r.b) for r in duplicates.print_matches(d, duplicates.print_candidates(d)).collect()}
    words = dict(prints)
    want = {(10 * i + x, 10 * i + y) for i in range(60) for x in range(3) for y in range(x + 1, 3) if dsp.bit_error_rate(words[10 * i + x], words[10 * i + y]) <= 0.18}
    assert len(want) == 180 and not found - want and len(found & want) >= 0.9 * len(want)
    assert duplicates.print_candidates(d.limit(0)).count() == 0


def test_print_candidates_do_not_meet_by_chance(spark):
    rng = np.random.default_rng(6)
    # a table so large that any two sketches share words: here words of a small vocabulary
    some = rng.integers(0, 1 << 24, 4000)
    prints = [(i, rng.choice(some, 120)) for i in range(300)]
    prints += [(1000 + i, np.where(np.arange(120) % 3 == 0, w ^ (1 << int(rng.integers(24))), w)) for i, w in prints[:50]]
    d = spark.createDataFrame([(int(i), [int(x) for x in w]) for i, w in prints], "rep bigint, words array<bigint>")
    found = {(r.a, r.b) for r in duplicates.print_candidates(d).collect()}
    copies = {(i, 1000 + i) for i in range(50)}
    assert copies <= found and len(found) < 500
    assert {(r.a, r.b) for r in duplicates.print_matches(d, duplicates.print_candidates(d)).collect()} == copies
    # any number of parts gives the same pairs; a limit to v leaves those within it
    assert {(r.a, r.b) for r in duplicates.print_candidates(d, parts=7).collect()} == found
    near = d.withColumn("v", F.pmod(F.col("rep"), F.lit(1000)) * 10 + F.when(F.col("rep") >= 1025, 6).otherwise(5))
    assert {(r.a, r.b) for r in duplicates.print_candidates(near, 5).collect()} & copies == copies
    assert {(r.a, r.b) for r in duplicates.print_candidates(near, 0).collect()} == {(i, 1000 + i) for i in range(25)}


def test_acoustic_classes_with_equal_and_long_prints(spark):
    rng = np.random.default_rng(7)
    made = [rng.integers(0, 1 << 24, 120) for _ in range(8)] + [rng.integers(0, 1 << 60, 120), rng.integers(0, 1 << 24, 79)]
    rows = [(k, int(rng.integers(100_000, 190_000)), [int(x) ^ (int(k % 7 == 0 and j % 2) << (j % 24)) for j, x in enumerate(made[k % 10])]) for k in range(400)]
    t = spark.createDataFrame([(k, v, None, None, None) for k, v, _ in rows], "id bigint, duration_ms bigint, fingerprint string, artist string, title string")
    p = spark.createDataFrame([(k, w) for k, _, w in rows] + [(5000, rows[0][2]), (0 - 1, [])], "id bigint, words array<bigint>")
    root = {k: k for k, _, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, va, wa in rows:
        for b, vb, _ in rows:
            if a < b and a % 10 == b % 10 and len(wa) >= 80 and abs(va - vb) <= 15_000:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    tops = [top(k) for k in root]
    want = {(k, top(k), tops.count(top(k))) for k in root if tops.count(top(k)) > 1}
    assert {tuple(r) for r in duplicates.acoustic_classes(t, p).collect()} == want


def test_acoustic_classes_keep_no_prints(spark, monkeypatch):
    rng = np.random.default_rng(8)
    made = [rng.integers(0, 1 << 24, 120) for _ in range(100)]
    rows = [(k, 100_000 + 10 * k, [int(x) ^ (1 << int(rng.integers(24))) if j % 2 else int(x) for j, x in enumerate(made[k % 100])]) for k in range(300)]
    t = spark.createDataFrame([(k, v, None, None, None) for k, v, _ in rows], "id bigint, duration_ms bigint, fingerprint string, artist string, title string")
    p = spark.createDataFrame([(k, w) for k, _, w in rows], "id bigint, words array<bigint>")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    tables = lambda: {x for x in folder.glob("table-*") if any("words" in pq.read_schema(f).names for f in x.glob("*.parquet"))}
    before = tables()
    whole = {tuple(r) for r in duplicates.acoustic_classes(t, p).collect()}
    assert whole == {(k, k % 100, 3) for k in range(300)} and tables() == before
    # the duration given, and everything in small parts
    for name, most in (("PASS_WORDS", 3000), ("PASS_PAIRS", 70), ("PICK_ROWS", 50)):
        monkeypatch.setattr(duplicates, name, most)
    given = p.join(t.select("id", F.col("duration_ms").alias("v")), "id")
    assert {tuple(r) for r in duplicates.acoustic_classes(t, given).collect()} == whole and tables() == before


def test_sketches_of_one_length_as_of_several():
    rng = np.random.default_rng(9)
    words = [b"\x03" + rng.integers(0, 40, (120, 3), np.uint8).tobytes() for _ in range(6)] + [b"\x03" + bytes(3) * 7]
    rep = np.arange(7)
    for part in range(3):
        one, several = duplicates._sketched(rep[:6], rep[:6], words[:6], part, 3), duplicates._sketched(rep, rep, words, part, 3)
        own = several[2] < 6
        assert len(one[0]) and all(np.array_equal(x, y[own]) for x, y in zip(one, several, strict=True))


def test_made_prints(spark, data):
    made = made_prints(spark, data)
    number = lambda hexed: F.conv(hexed, 16, 10).cast("int")
    word = lambda i: number(F.substring(F.md5(F.concat(F.lower(F.trim("title")), F.lit("/"), i.cast("string"))), 1, 6))
    bit = lambda i: F.pmod(number(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("/"), i.cast("string"))), 1, 4)), F.lit(24))
    words = F.transform(F.sequence(F.lit(0), F.lit(119)), lambda i: F.when(i % 2 == 0, word(i)).otherwise(word(i).bitwiseXOR(F.call_function("shiftleft", F.lit(1), bit(i)))))
    t = catalog.latest(table(spark, data, "tracks"), "title", "duration_ms").filter(F.trim("title") != "")
    want = {r.id: (r.v, list(r.words)) for r in t.select("id", F.coalesce("duration_ms", F.lit(0)).alias("v"), words.alias("words")).collect()}
    assert {r.id: (r.v, duplicates.unpacked(bytes(r.words)).tolist()) for r in made.collect()} == want and want
    # titles are shuffled, never words
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_grid_edits(spark):
    g = spark.createDataFrame([(1, 120.0, 100.0, 0)], "track_id bigint, bpm double, first double, phase int")
    b, f, p = F.col("bpm"), F.col("first"), F.col("phase")
    r = g.select(series.grid_shifted(b, f, p, F.lit(-300.0)).alias("s"), series.grid_snapped(b, f, p, F.lit(730.0)).alias("n"), series.grid_beat_one(b, f, p, F.lit(1130.0)).alias("o"), series.grid_scaled(F.lit(128.0), f, p, 2.0).alias("d"), series.grid_scaled(F.lit(50.0), f, p, 0.5).alias("h")).first()
    assert (r.s.first, r.s.phase) == (300.0, 3) and (r.n.first, r.n.phase) == (230.0, 0) and (r.o.first, r.o.phase) == (130.0, 2) and r.d.bpm == 256 and r.h.bpm == 40
    one = spark.createDataFrame([(1, 120.0, 250.0, 1)], "track_id bigint, bpm double, first double, phase int")
    lines = sorted((x.x, x.is_downbeat) for x in series.beat_lines(one, 0.0, 4.0, 400.0).collect())
    assert len(lines) == 8 and lines[0][0] == 25.0 and [k for k, (_, down) in enumerate(lines) if down] == [1, 5]
    assert series.beat_lines(one, 0.0, 600.0, 400.0).count() == 0


def test_near_signatures_recall(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 400)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        flip = sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 12)), replace=False))
        rows.append((1000 + i, b ^ flip))
    rows.append((5000, None))
    d = spark.createDataFrame(rows, "id bigint, bits bigint")
    got = {(r.a, r.b) for r in duplicates.near_signatures(d, "id", 11).collect()}
    want = {(min(a, b), max(a, b)) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and bin((x ^ y) & (2**64 - 1)).count("1") <= 11}
    assert got == want and len(want) >= 400
    with pytest.raises(ValueError):
        duplicates.near_signatures(d, "id", 30)
