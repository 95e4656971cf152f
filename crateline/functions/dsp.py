"""Signal processing kernels in NumPy, and one entry that turns decoded audio into analysis rows.

Everything that looks at one track's spectrum shares one spectrogram; a task holds one track at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .keys import MAJOR_PROFILE, MINOR_PROFILE, MINOR_WEIGHT

# Fixed values of the analysis: frame and hop of the spectrogram, seconds looked at, tempo range and its prior.
FRAME, HOP, HEAD_S = 4096, 512, 150
BPM_LOW, BPM_HIGH, BPM_PRIOR, BPM_SPREAD = 70.0, 185.0, 125.0, 0.65
HARMONICS, FINE, FINE_STEPS, RELATIVES, MARGIN = 4, 0.035, 321, (5 / 4, 4 / 3, 3 / 2, 2), 1.05
# Fixed values of the anchor: block and hop in samples, the kick's band and the weight of all, search step and least lift.
SNAP_BLOCK, SNAP_HOP, SNAP_HZ, SNAP_ALL, SNAP_STEP_MS, SNAP_LIFT = 256, 64, 200.0, 0.35, 0.5, 1.25
# Fixed values of bars: beats, bands of claps and of harmony with their weights.
BAR, CLAP_HZ, HARMONY_HZ, CLAP_WEIGHT, CHANGE_WEIGHT = 4, (2000.0, 8000.0), (150.0, 2000.0), 1.0, 0.5
# The two stages of the public loudness weighting at 48 kHz (b and a of each).
SHELF = ((1.53512485958697, -2.69169618940638, 1.19839281085285), (1.0, -1.69065929318241, 0.73248077421585))
HIGH_PASS = ((1.0, -2.0, 1.0), (1.0, -1.99004745483398, 0.99007225036621))
# Fixed values of the coloured previews: stretches a second and how many, bands, the loudness range, what counts as in use.
COLOURS_A_SECOND, COLOUR_BINS, BAND_HZ, LOUD_DB, IN_USE_DB, IN_USE_HZ = 20.0, (400, 24_000), (120.0, 2000.0), 45.0, 60.0, (30.0, 15_000.0)
FINES_A_SECOND, SHARP_RADIUS, SHARP_AMOUNTS = 2000.0, 6, (1.15, 0.85, 0.85)
DECODED_S = 20 * 60
PITCH_LOW, PITCH_HIGH = 90.0, 4000.0
PRINT_LOW, PRINT_HIGH, PRINT_RATE = 55.0, 5000.0, 8.0


def spectrogram(x: np.ndarray) -> np.ndarray:
    """Magnitudes (frames, bins) under a squared-sine window."""
    if len(x) < FRAME:
        return np.zeros((0, FRAME // 2 + 1), dtype=np.float32)
    window = np.sin(np.pi * np.arange(FRAME) / (FRAME - 1)) ** 2
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    return np.concatenate([np.abs(np.fft.rfft(frames[i : i + 256] * window)) for i in range(0, len(frames), 256)]).astype(np.float32)


def moving_mean(x: np.ndarray, radius: int) -> np.ndarray:
    """Mean over ±radius, over what there is at the edges."""
    c = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    lo, hi = np.maximum(i - radius, 0), np.minimum(i + radius + 1, len(x))
    return (c[hi] - c[lo]) / (hi - lo)


def onsets(spec: np.ndarray) -> np.ndarray:
    logs = np.log1p(spec)
    flux = np.concatenate([[0.0], np.maximum(np.diff(logs, axis=0), 0).sum(axis=1)])
    return np.maximum(flux - moving_mean(flux, 16), 0)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Mean-removed, 1 at lag 0; zeros for silence."""
    x = x - x.mean()
    n = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfft(x, n)
    acf = np.fft.irfft(f * np.conj(f), n)[: len(x)]
    return acf / acf[0] if acf[0] > 1e-12 else np.zeros(len(x))


def prior(bpm: np.ndarray | float) -> np.ndarray | float:
    """How likely a tempo is before anything is heard."""
    return np.exp(-0.5 * (np.log2(np.asarray(bpm) / BPM_PRIOR) / BPM_SPREAD) ** 2)


def comb(acf: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """The autocorrelation at each lag and its first multiples, each multiple counting less."""
    k = np.arange(1, HARMONICS + 1)
    at = lags[:, None] * k
    return np.where(at < len(acf), acf[np.minimum(at, len(acf) - 1)] / k, 0.0).sum(axis=1)


def parabolic(y: np.ndarray, at: int) -> float:
    """Where the parabola through a peak and its neighbours has its top, within one step; the peak itself at the edges."""
    if not 0 < at < len(y) - 1:
        return float(at)
    bend = y[at - 1] - 2 * y[at] + y[at + 1]
    return at + (float(np.clip(0.5 * (y[at - 1] - y[at + 1]) / bend, -1, 1)) if abs(bend) > 1e-9 else 0.0)


def pulse(envelope: np.ndarray, period: float, step: float = 1.0) -> tuple[float, float]:
    """(phase, mean of the envelope there) of the pulse of this period that fits best."""
    n = int(len(envelope) / period)
    if n < 4:
        return 0.0, 0.0
    phase = np.arange(0, period, step)
    at = phase[:, None] + np.arange(n)[None, :] * period
    low = np.minimum(at.astype(int), len(envelope) - 2)
    part = at - low
    means = (envelope[low] * (1 - part) + envelope[low + 1] * part).mean(axis=1)
    best = int(means.argmax())
    return float(phase[best]), float(means[best])


def refined(envelope: np.ndarray, rate: float, bpm: float) -> tuple[float, float, float]:
    """(bpm, phase in frames, energy) of the best pulse near a tempo, within the range of tempi."""
    near = np.linspace(max(bpm * (1 - FINE), BPM_LOW), min(bpm * (1 + FINE), BPM_HIGH), FINE_STEPS)
    energies = [pulse(envelope, rate * 60 / b)[1] for b in near]
    best = float(near[int(np.argmax(energies))])
    return best, *pulse(envelope, rate * 60 / best, 0.25)


def tempo_lock(envelope: np.ndarray, rate: float) -> tuple[float | None, float, float]:
    """(bpm, phase in frames, confidence) of an onset envelope with ``rate`` frames a second."""
    if len(envelope) < 64 or not envelope.any():
        return None, 0.0, 0.0
    acf = autocorrelation(envelope)
    lags = np.arange(max(1, int(rate * 60 / BPM_HIGH)), min(int(np.ceil(rate * 60 / BPM_LOW)), len(acf) - 1) + 1)
    scores = comb(acf, lags) * prior(rate * 60 / lags)
    top = parabolic(scores, int(scores.argmax())) + lags[0]
    bpm, phase, energy = refined(envelope, rate, rate * 60 / top)
    # a faster metrical relative must beat this first lock clearly
    least = best = energy * float(prior(bpm))
    chosen = (bpm, phase)
    for ratio in RELATIVES:
        if BPM_LOW <= bpm * ratio <= BPM_HIGH:
            other, at, loud = refined(envelope, rate, bpm * ratio)
            score = loud * float(prior(other))
            if score > MARGIN * least and score > best:
                chosen, best = (other, at), score
    positive = scores[scores > 0]
    confidence = 1 - float(np.median(positive)) / float(scores.max()) if len(positive) else 0.0
    return round(chosen[0], 2), chosen[1], confidence


def tempo(envelope: np.ndarray, rate: float) -> tuple[float | None, float]:
    """(bpm, confidence) of an onset envelope with ``rate`` frames a second."""
    bpm, _, confidence = tempo_lock(envelope, rate)
    return bpm, confidence


def one_pole(x: np.ndarray, hz: float, sample_rate: int) -> np.ndarray:
    """A low-pass of one pole, run in blocks: each block is a weighted sum of itself and of what the last one left."""
    a = 1 - np.exp(-2 * np.pi * hz / sample_rate)
    block = 256
    decay = (1 - a) ** np.arange(block + 1)
    kernel = np.tril(a * decay[np.abs(np.arange(block)[:, None] - np.arange(block)[None, :])])
    padded = np.zeros(-(-len(x) // block) * block)
    padded[: len(x)] = x
    parts = padded.reshape(-1, block) @ kernel.T
    ends, state = np.empty(len(parts)), 0.0
    for i, last in enumerate(parts[:, -1]):
        ends[i] = state
        state = last + state * decay[block]
    return (parts + ends[:, None] * decay[1:][None, :]).reshape(-1)[: len(x)]


def attack_flux(x: np.ndarray, sample_rate: int) -> np.ndarray:
    """Rises of short blocks' level, of the kick's band and of all, each by its own mean."""

    def rises(y: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(y.astype(np.float64) ** 2)])
        starts = np.arange(0, len(y) - SNAP_BLOCK + 1, SNAP_HOP)
        level = np.sqrt(np.maximum(sums[starts + SNAP_BLOCK] - sums[starts], 0) / SNAP_BLOCK)
        up = np.concatenate([[0.0], np.maximum(np.diff(level), 0)])
        return up / up.mean() if up.any() else up

    return rises(one_pole(x, SNAP_HZ, sample_rate)) + SNAP_ALL * rises(x)


def snapped(x: np.ndarray, sample_rate: int, bpm: float, anchor: float) -> float:
    """The anchor (ms) moved by at most half a beat onto the attacks, where they stand out; otherwise as it was."""
    if bpm <= 0 or len(x) < 4 * SNAP_BLOCK:
        return anchor
    flux = attack_flux(x, sample_rate)
    if len(flux) < 8:
        return anchor
    step = SNAP_HOP / sample_rate * 1000
    zero = (SNAP_BLOCK - SNAP_HOP) / 2 / sample_rate * 1000
    period = 60_000 / bpm
    half = max(round(period / SNAP_STEP_MS), 1) // 2
    offsets = anchor + np.arange(-half, half + 1) * SNAP_STEP_MS
    span = len(flux) * step + zero
    times = (offsets % period)[:, None] + np.arange(int(span / period) + 1)[None, :] * period
    inside = times < span
    values = np.interp((times - zero) / step, np.arange(len(flux)), flux, left=0.0, right=0.0)
    scores = np.where(inside, values, 0).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
    best = int(scores.argmax())
    if not scores[best] > SNAP_LIFT * scores.mean():
        return anchor
    found = float(offsets[best])
    return found if found >= 0 else found + period


def anchor_ms(envelope: np.ndarray, rate: float, bpm: float) -> float:
    phase, _ = pulse(envelope, rate * 60 / bpm, 0.25)
    return phase / rate * 1000 + FRAME / 2 / (rate * HOP) * 1000


def novelty(profiles: np.ndarray) -> np.ndarray:
    """How much each row differs from the one before (sum of absolute differences); 0 for the first."""
    return np.concatenate([[0.0], np.abs(np.diff(profiles, axis=0)).sum(axis=1)]) if len(profiles) else np.zeros(0)


def downbeat_phase(spec: np.ndarray, sample_rate: int, bpm: float, first_ms: float) -> int:
    """Index of the first beat that begins a bar of four: loud claps on its second and fourth beat, new harmony on its first.

    Needs eight beats, otherwise 0; of equals the first.
    """
    if bpm <= 0 or not len(spec):
        return 0
    rate = sample_rate / HOP
    beat = 60 / bpm * rate
    if beat < 1:
        return 0
    starts = np.round((first_ms / 1000 * sample_rate - FRAME / 2) / HOP + np.arange(int(len(spec) / beat) + 2) * beat).astype(int)
    number = np.arange(len(starts))
    ok = (starts >= 0) & (starts < len(spec))
    starts, number = starts[ok], number[ok]
    if len(starts) < 2 * BAR:
        return 0
    bins = lambda lo, hi: slice(round(lo * FRAME / sample_rate), min(round(hi * FRAME / sample_rate), spec.shape[1] - 1) + 1)
    width = max(int(beat / 2), 1)
    means = np.stack([spec[f : f + width].mean(axis=0) for f in starts])
    claps = means[:, bins(*CLAP_HZ)].sum(axis=1)
    change = novelty(means[:, bins(*HARMONY_HZ)])
    clap_mean, change_mean = max(claps.mean(), 1e-7), max(change.mean(), 1e-7)

    def at(values: np.ndarray, phase: int, places: tuple[int, ...]) -> float:
        here = np.isin((number - phase) % BAR, places)
        return float(values[here].mean()) if here.any() else 0.0

    scores = [CLAP_WEIGHT * (at(claps, p, (1, 3)) - at(claps, p, (0, 2))) / clap_mean + CHANGE_WEIGHT * (at(change, p, (0,)) - change_mean) / change_mean for p in range(BAR)]
    return int(np.argmax(scores))


def biquad_power(w: np.ndarray, b: tuple[float, ...], a: tuple[float, ...]) -> np.ndarray:
    """Squared magnitude of a second-order filter at angular frequencies."""
    z = np.exp(-1j * w)
    return np.abs(np.polyval(b[::-1], z)) ** 2 / np.maximum(np.abs(np.polyval(a[::-1], z)) ** 2, 1e-12)


def loudness_weights(bins: int = FRAME // 2 + 1) -> np.ndarray:
    """Power gain of each bin by how loud an ear finds it: a high shelf times a high-pass."""
    w = np.pi * np.arange(bins) / (bins - 1)
    return biquad_power(w, *SHELF) * biquad_power(w, *HIGH_PASS)


def frames_of(x: np.ndarray, chunk: int = 256):
    """Magnitudes of all frames of a signal, ``chunk`` at a time, so that a long one needs little memory."""
    if len(x) < FRAME:
        return
    window = np.sin(np.pi * np.arange(FRAME) / (FRAME - 1)) ** 2
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, len(frames), chunk):
        yield i, np.abs(np.fft.rfft(frames[i : i + chunk] * window))


def colour_bands(x: np.ndarray, sample_rate: int) -> np.ndarray:
    """(bins, 4) bytes: level of the low, middle and high band and the energy of each stretch of the whole signal.

    About 20 stretches a second. Levels are square roots of the share of the loudest; energy is the weighted loudness over
    45 dB times how much of the spectrum is in use. Two passes: the second needs the loudest bin of the first.
    """
    total = max((len(x) - FRAME) // HOP + 1, 0)
    bins = min(int(np.clip(round(len(x) / sample_rate * COLOURS_A_SECOND), *COLOUR_BINS)), max(total, 1))
    if not total:
        return np.zeros((bins, 4), dtype=np.uint8)
    gain = loudness_weights()
    at = lambda hz: min(round(hz * FRAME / sample_rate), FRAME // 2 + 1)
    low, mid = at(BAND_HZ[0]), max(at(BAND_HZ[1]), at(BAND_HZ[0]))
    lo = int(np.clip(at(IN_USE_HZ[0]), 1, FRAME // 2))
    hi = int(np.clip(at(IN_USE_HZ[1]), lo + 1, FRAME // 2 + 1))
    place = np.minimum((np.arange(total) * HOP + FRAME // 2) * bins // len(x), bins - 1)
    count = np.maximum(np.bincount(place, minlength=bins), 1)
    sums = np.zeros((4, bins))
    top = 0.0
    for i, m in frames_of(x):
        p = m**2
        here = place[i : i + len(p)]
        for k, v in enumerate((p[:, :low].sum(axis=1), p[:, low:mid].sum(axis=1), p[:, mid:].sum(axis=1), p @ gain)):
            sums[k] += np.bincount(here, v, minlength=bins)
        top = max(top, float(p[:, lo:hi].max()))
    used = np.zeros(bins)
    for i, m in frames_of(x):
        used += np.bincount(place[i : i + len(m)], (m[:, lo:hi] ** 2 > top * 10 ** (-IN_USE_DB / 10)).mean(axis=1), minlength=bins)
    sums, used = sums / count, used / count
    level = np.sqrt(np.maximum(sums[:3], 0))
    db = 10 * np.log10(np.maximum(sums[3], 1e-12))
    loud = np.clip((db - db.max() + LOUD_DB) / LOUD_DB, 0, 1)
    energy = loud**0.4 * (used / max(used.max(), 1e-9)) ** 0.2
    shown = np.sqrt(np.clip(level / max(level.max(), 1e-12), 0, 1))
    return np.round(np.concatenate([shown, [np.clip(energy / max(energy.max(), 1e-9), 0, 1)]]).T * 255).astype(np.uint8)


def sharpened(x: np.ndarray, radius: int, amount: float) -> np.ndarray:
    """Raised above the local mean and lowered below it, not below 0."""
    return np.maximum(x + amount * (x - moving_mean(x, radius)), 0) if len(x) else x


def fine_bands(x: np.ndarray, sample_rate: int) -> np.ndarray:
    """(bins, 4) bytes of 2000 stretches a second: sharpened peaks of three bands and the level of each."""
    if not len(x):
        return np.zeros((0, 4), dtype=np.uint8)
    bins = min(max(int(np.ceil(len(x) / sample_rate * FINES_A_SECOND)), 1), len(x))
    low_hz = float(np.clip(BAND_HZ[0], 20, sample_rate / 2))
    low = one_pole(x, low_hz, sample_rate)
    below = one_pole(x, float(np.clip(BAND_HZ[1], low_hz, sample_rate / 2)), sample_rate)
    edges = -(-np.arange(bins) * len(x) // bins)
    peaks = [np.maximum.reduceat(np.abs(y), edges) for y in (low, below - low, x - below)]
    count = np.diff(np.append(edges, len(x)))
    level = np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, edges) / count)
    shown = [sharpened(p, SHARP_RADIUS, a) for p, a in zip(peaks, SHARP_AMOUNTS, strict=True)] + [level]
    return (np.sqrt(np.clip(np.stack(shown, axis=1), 0, 1)) * 255).astype(np.uint8)


def follower(x: np.ndarray, attack: float, release: float) -> np.ndarray:
    """Each value moves from the last one towards the input, fast up and slow down; it begins at the first input."""
    out = np.array(x, dtype=np.float64)
    for i in range(1, len(out)):
        out[i] = out[i - 1] + (attack if x[i] >= out[i - 1] else release) * (x[i] - out[i - 1])
    return out


def content_hash(x: np.ndarray) -> str:
    """16 hex digits of the length and of every 997th sample: the sound's identity, whatever its tags."""
    import hashlib

    h = hashlib.blake2b(len(x).to_bytes(8, "little"), digest_size=8)
    h.update(np.ascontiguousarray(x[::997], dtype="<f4").tobytes())
    return h.hexdigest()


def chroma(spec: np.ndarray, sample_rate: int) -> np.ndarray:
    """Twelve pitch classes from spectral peaks, frames weighted alike, tuning corrected."""
    freq = np.fft.rfftfreq(FRAME, 1 / sample_rate)
    band = (freq >= PITCH_LOW) & (freq <= PITCH_HIGH)
    first = int(np.argmax(band))
    s = spec[:, band]
    if s.size == 0 or not s.any():
        return np.zeros(12)
    inner = s[:, 1:-1]
    is_peak = (inner >= s[:, :-2]) & (inner >= s[:, 2:]) & (inner >= 0.1 * s.max(axis=1, keepdims=True)) & (inner > 0)
    t, k = np.nonzero(is_peak)
    a, b, c = s[t, k], s[t, k + 1], s[t, k + 2]
    shift = np.clip(0.5 * (a - c) / np.where(a - 2 * b + c == 0, 1, a - 2 * b + c), -1, 1)
    hz = (first + k + 1 + shift) * sample_rate / FRAME
    pitch = 12 * np.log2(hz / 440.0) + 69
    off = pitch - np.round(pitch)
    tuning = np.arctan2((b * np.sin(2 * np.pi * off)).sum(), (b * np.cos(2 * np.pi * off)).sum()) / (2 * np.pi)
    pc = np.round(pitch - tuning).astype(int) % 12
    out = np.zeros((len(s), 12))
    np.add.at(out, (t, pc), b)
    sums = out.sum(axis=1, keepdims=True)
    total = (out / np.where(sums == 0, 1, sums)).sum(axis=0)
    return total / total.sum() if total.sum() else total


def key_of(profile: np.ndarray) -> tuple[int, bool] | None:
    if not profile.any() or profile.std() == 0:
        return None
    best, choice = -np.inf, None
    for tonic in range(12):
        for major, p, weight in ((True, MAJOR_PROFILE, 1.0), (False, MINOR_PROFILE, MINOR_WEIGHT)):
            r = float(np.corrcoef(profile, np.roll(p, tonic))[0, 1])
            r = r * weight if r > 0 else r
            if r > best:
                best, choice = r, (tonic, major)
    return choice


def fingerprint(spec: np.ndarray, sample_rate: int) -> np.ndarray:
    """24-bit words, about eight a second: twelve bits of chroma shape and twelve of its motion; silent frames dropped."""
    freq = np.fft.rfftfreq(FRAME, 1 / sample_rate)
    band = (freq >= PRINT_LOW) & (freq <= PRINT_HIGH)
    pc = np.round(12 * np.log2(freq[band] / 440.0) + 69).astype(int) % 12
    logs = np.log1p(spec[:, band])
    c = np.stack([logs[:, pc == k].sum(axis=1) for k in range(12)], axis=1)
    per = max(1, round(sample_rate / HOP / PRINT_RATE))
    n = len(c) // per
    c = c[: n * per].reshape(n, per, 12).mean(axis=1) if n else np.zeros((0, 12))
    sums = c.sum(axis=1)
    c = c[sums > 1e-6] / sums[sums > 1e-6, None]
    if len(c) < 2:
        return np.zeros(0, dtype=np.int64)
    shape = c[1:] > c[1:].mean(axis=1, keepdims=True)
    motion = c[1:] > c[:-1]
    bits = np.concatenate([shape, motion], axis=1).astype(np.int64)
    return bits @ (1 << np.arange(24))


def bit_error_rate(a: np.ndarray, b: np.ndarray, reach: int = 48, least: int = 80) -> float | None:
    """Least share of differing bits over all shifts with enough overlap; None if either is too short."""
    if len(a) < least or len(b) < least:
        return None
    best = 1.0
    for lag in range(-reach, reach + 1):
        x, y = (a[lag:], b) if lag >= 0 else (a, b[-lag:])
        n = min(len(x), len(y))
        if n >= least:
            best = min(best, float(np.bitwise_count((x[:n] ^ y[:n]).astype(np.uint64)).sum()) / (24 * n))
    return best


def first_match(a: np.ndarray, b: np.ndarray, most: float, reach: int = 48, least: int = 80) -> float | None:
    """The bit error rate at the first shift, from none outwards, at which it is at most ``most``; None if there is none.

    Whether two prints match is that :func:`bit_error_rate` is at most ``most``; copies mostly do without a shift.
    """
    for lag in sorted(range(-reach, reach + 1), key=abs):
        x, y = (a[lag:], b) if lag >= 0 else (a, b[-lag:])
        n = min(len(x), len(y))
        if n >= least and min(len(a), len(b)) >= least:
            error = int(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (24 * n)
            if error <= most:
                return error
    return None


def low_pass(spec: np.ndarray, sample_rate: int) -> tuple[float | None, float | None]:
    """(cut-off Hz, edge dB/kHz) of the loud frames' mean spectrum; nothing if it reaches Nyquist."""
    energy = (spec**2).sum(axis=1)
    if not len(energy) or energy.max() <= 0:
        return None, None
    loud = spec[energy >= np.sort(energy)[len(energy) // 2]].mean(axis=0)
    freq = np.fft.rfftfreq(FRAME, 1 / sample_rate)
    ref = loud[(freq >= 200) & (freq <= 6000)].max()
    if ref <= 0:
        return None, None
    db = moving_mean(20 * np.log10(np.maximum(loud / ref, 1e-9)), 5)
    present = np.nonzero((db >= -60) & (freq > 2000))[0]
    if not len(present):
        return None, None
    cut = float(freq[present[-1]])
    if cut >= 0.95 * sample_rate / 2:
        return None, None
    below, above = np.interp([cut - 500, cut + 700], freq, db)
    return cut, float((below - above) / 1.2)


def levels(x: np.ndarray) -> tuple[float, float]:
    if not len(x):
        return 0.0, -120.0
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    return float(np.abs(x).max()), 20 * np.log10(rms) if rms > 0 else -120.0


def preview(x: np.ndarray, bins: int = 400) -> list[int]:
    """Peak of each of ``bins`` equal stretches, 0 to 255; missing ones are 0."""
    per = -(-len(x) // bins) if len(x) else 1
    padded = np.zeros(per * bins)
    padded[: len(x)] = np.abs(x)
    return np.minimum(padded.reshape(bins, per).max(axis=1) * 255, 255).astype(int).tolist()


ANALYSIS = T.StructType(
    [
        T.StructField("track_id", T.LongType()), T.StructField("bpm", T.DoubleType()), T.StructField("key_tonic", T.IntegerType()), T.StructField("key_mode", T.IntegerType()), T.StructField("beat_offset_ms", T.LongType()), T.StructField("first_beat_number", T.IntegerType()),
        T.StructField("peak", T.DoubleType()), T.StructField("loudness", T.DoubleType()), T.StructField("lowpass_hz", T.DoubleType()), T.StructField("lowpass_edge", T.DoubleType()), T.StructField("audio_fingerprint", T.ArrayType(T.LongType())),
        T.StructField("waveform", T.BinaryType()), T.StructField("waveform_bands", T.BinaryType()), T.StructField("content_hash", T.StringType()), T.StructField("error", T.StringType()),
    ]
)


def analysed(x: np.ndarray, sample_rate: int) -> dict:
    """All that is known of a sound: its head gives tempo, key, quality and print, the whole of it levels and previews."""
    x = x[: DECODED_S * sample_rate]
    head = x[: HEAD_S * sample_rate]
    spec = spectrogram(head)
    rate = sample_rate / HOP
    bpm, phase, _ = tempo_lock(onsets(spec), rate)
    key = key_of(chroma(spec, sample_rate))
    cut_hz, edge = low_pass(spec, sample_rate)
    peak, loud = levels(x)
    first = at = None
    if bpm:
        at = snapped(head, sample_rate, bpm, (phase * HOP + FRAME / 2) / sample_rate * 1000)
        first = (BAR - downbeat_phase(spec, sample_rate, bpm, at)) % BAR + 1
    return {
        "bpm": bpm, "key_tonic": key[0] if key else None, "key_mode": int(key[1]) if key else None, "beat_offset_ms": round(at) if at is not None else None, "first_beat_number": first,
        "peak": peak, "loudness": loud, "lowpass_hz": cut_hz, "lowpass_edge": edge, "audio_fingerprint": fingerprint(spec, sample_rate).tolist(),
        "waveform": bytes(preview(x)), "waveform_bands": colour_bands(x, sample_rate).tobytes(), "content_hash": content_hash(x), "error": None,
    }


def _rows(found: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=ANALYSIS.fieldNames())
    for c in ("key_tonic", "key_mode", "first_beat_number"):
        out[c] = out[c].astype("Int32")
    out["beat_offset_ms"] = out["beat_offset_ms"].astype("Int64")
    return out


def analyse(audio: DataFrame) -> DataFrame:
    """Analysis rows of (track_id, sample_rate, samples array<float>); a track that fails has its error and nulls.

    For samples that are made in the query. Long sounds are better decoded where they are analysed (:func:`analyse_files`);
    ``spark.sql.execution.arrow.maxBytesPerBatch`` bounds what a worker gets at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, rate, s in zip(b["track_id"], b["sample_rate"], b["samples"], strict=True):
                try:
                    found = {"track_id": i, **analysed(np.asarray(s, dtype=np.float32), int(rate))}
                except Exception as e:  # one bad file must not end the job
                    found = {"track_id": i, "error": str(e)}
                yield _rows([found])

    return audio.select("track_id", "sample_rate", "samples").mapInPandas(run, ANALYSIS)


def analyse_files(files: DataFrame) -> DataFrame:
    """Analysis rows of (track_id, path): each task opens its files one after the other, so it holds one sound at a time.

    Paths are local ones or in a file system mounted on the executors; a file that can't be read has its error and nulls.
    """
    from ..sources.files import decoded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, path in zip(b["track_id"], b["path"], strict=True):
                try:
                    rate, x = decoded(path)
                    found = {"track_id": i, **analysed(x.mean(axis=1), rate)}
                except Exception as e:
                    found = {"track_id": i, "error": str(e) or type(e).__name__}
                yield _rows([found])

    return files.select("track_id", "path").mapInPandas(run, ANALYSIS)
