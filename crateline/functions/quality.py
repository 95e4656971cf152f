"""Audio quality as columns: verdicts on the spectral roll-off, bit rates, ranking keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the verdict: an edge of this many dB/kHz is an encoder's wall, a wall from this frequency on is only suspect.
STEEP_DB_PER_KHZ = 25.0
HIGH_WALL_HZ = 20_000.0
# Cut-off frequency (Hz, at least) and the source it hints at; what is shown for a verdict.
SOURCE_GUESSES = [(20_000.0, "~320 kbps (or lossless w/ 20 kHz shelf)"), (18_500.0, "~256 kbps"), (15_500.0, "~192 kbps / AAC"), (13_500.0, "~128 kbps")]
LOWEST_GUESS = "≤96 kbps"
CHIPS = {"clean": "clean", "inconclusive": "clean", "suspect": "~320?", "likely_lossy": "lossy"}
BLURBS = {
    "clean": "No transcode signature. Looks fine.", "inconclusive": "No transcode signature. Looks fine.", "suspect": "Sharp cutoff near 20 kHz, possibly a 320 kbps transcode",
    "likely_lossy": "Brick wall well below Nyquist, almost certainly a lossy transcode",
}
UNCHECKED = "Not checked yet. Run Analyze to scan for lossy transcodes."
LOSSLESS = ["flac", "wav", "aiff"]
SEVERITY = {"clean": 0, "inconclusive": 1, "suspect": 2, "likely_lossy": 3}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def verdict(cut_hz: Column | str, edge: Column | str) -> Column:
    """clean, inconclusive, suspect or likely_lossy; no cut-off means clean."""
    cut_hz, edge = _c(cut_hz), _c(edge)
    return (
        F.when(cut_hz.isNull(), "clean")
        .when(edge.isNull() | (edge < STEEP_DB_PER_KHZ), "inconclusive")
        .when(cut_hz >= HIGH_WALL_HZ, "suspect")
        .otherwise("likely_lossy")
    )


def verdict_word(text: Column | str) -> Column:
    """A verdict however it is written ("Likely-Lossy", "CLEAN ", "suspect?"), null where it says nothing."""
    w = F.regexp_replace(F.lower(_c(text)), "[^a-z]", "")
    return F.when(w == "clean", "clean").when(w == "suspect", "suspect").when(w == "inconclusive", "inconclusive").when(w == "likelylossy", "likely_lossy")


def verdict_is_transcode(text: Column | str) -> Column:
    return verdict_word(text).isin("suspect", "likely_lossy")


def severity(word: Column | str) -> Column:
    w = _c(word)
    out = F.lit(None).cast("int")
    for k, v in SEVERITY.items():
        out = F.when(w == k, v).otherwise(out)
    return out


def source_guess(cut_hz: Column | str) -> Column:
    c = _c(cut_hz)
    out = F.when(c.isNotNull(), LOWEST_GUESS)
    for hz, text in reversed(SOURCE_GUESSES):
        out = F.when(c >= hz, text).otherwise(out)
    return out


def true_bitrate(kbps: Column | str) -> Column:
    """Bit rate in kbps where some rows hold bits a second: no codec reaches 20 000 kbps."""
    k = _c(kbps)
    return F.when(k >= 20_000, F.floor(k / 1000)).otherwise(k).cast("bigint")


def is_lossless(fmt: Column | str) -> Column:
    return F.coalesce(F.lower(_c(fmt)).isin(LOSSLESS), F.lit(False))


def copy_rank(is_clean: Column, fmt: Column, kbps: Column, ordinal: Column) -> Column:
    """Comparable rank of a copy, larger is better; the later of equals wins."""
    return F.struct(is_clean.cast("int"), is_lossless(fmt).cast("int"), F.coalesce(kbps, F.lit(0)).cast("bigint"), ordinal)


def _shown(word: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in texts.items():
        out = F.when(word == k, v).otherwise(out)
    return out


def chip(word: Column) -> Column:
    """The short label of a verdict; gentle roll-offs are no flaw."""
    return _shown(word, CHIPS)


def blurb(word: Column, cut_hz: Column) -> Column:
    """The verdict in words with the cut-off, and for a transcode its likely source; what to do if there is none."""
    cut = F.when(cut_hz.isNotNull(), F.concat(F.lit("\nLow-pass cutoff: "), F.format_string("%.1f", cut_hz / 1000), F.lit(" kHz")))
    source = F.when(word.isin("suspect", "likely_lossy"), F.concat(F.lit("\nEstimated source: "), source_guess(cut_hz)))
    return F.when(word.isNull(), UNCHECKED).otherwise(F.concat_ws("", _shown(word, BLURBS), cut, source))
