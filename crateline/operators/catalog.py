"""Views of the catalogue: latest scans, library, inbox, missing and outdated rows, siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import camelot, camelot_number, wheel_order
from ..functions.quality import severity, verdict
from ..functions.text import duration, search

SEARCHED = ["artist", "title", "album", "genre", "album_artist"]
LOWEST = -(1 << 62)
#: Analyser version that counts as current.
CURRENT = 20


def latest(tracks: DataFrame, *columns: str) -> DataFrame:
    """One row per id, the newest scan; only ``columns`` (all by default) are carried through the shuffle."""
    cols = [c for c in (columns or tracks.columns) if c != "id"]
    order = F.struct(*[F.coalesce(F.col(c).cast("bigint"), F.lit(LOWEST)) for c in ("src_mtime", "discogs_meta_fetched_at", "src_size")])
    picked = tracks.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("t"))
    return picked.select("id", *[F.col(f"t.{c}").alias(c) for c in cols])


def with_analysis(tracks: DataFrame, analysis: DataFrame) -> DataFrame:
    """Tracks with their analysis where there is one; tracks without keep nulls."""
    a = analysis.filter(F.col("track_id").isNotNull()).select("track_id", "bpm", "key_tonic", "key_mode", "lowpass_hz", "lowpass_edge", "analyzer_version", F.col("src_size").alias("a_size"), F.col("src_mtime").alias("a_mtime"))
    return tracks.join(a, tracks["id"] == a["track_id"], "left").drop("track_id")


def is_major() -> Column:
    return F.col("key_mode") == 1


def library_view(tracks: DataFrame, analysis: DataFrame, text: str | None = None) -> DataFrame:
    """Display rows: formatted and sortable values of each track, analysed or not, filtered by a search text."""
    t = latest(tracks, "title", "artist", "album", "genre", "album_artist", "duration_ms", "bitrate_kbps").filter(search(SEARCHED, text))
    v = with_analysis(t, analysis)
    word = verdict("lowpass_hz", "lowpass_edge")
    known = F.col("analyzer_version") >= 6
    return v.select(
        "id", "title", "artist", "album", duration(F.coalesce("duration_ms", F.lit(0))).alias("length"), F.round("bpm", 1).alias("bpm"),
        camelot(F.col("key_tonic"), is_major()).alias("camelot"), wheel_order(camelot_number(F.col("key_tonic"), is_major()), is_major()).alias("key_order"),
        F.when(known, word).alias("quality"), F.when(known, severity(word)).alias("quality_order"),
    )


def inbox(tracks: DataFrame, analysis: DataFrame, as_of: int, window_s: int = 86_400, version: int = CURRENT) -> DataFrame:
    """Tracks added within the window that still lack fetched data or a current analysis."""
    fresh = latest(tracks, "added_at", "discogs_meta_fetched_at").filter((F.lit(as_of) - F.col("added_at") < window_s))
    done = analysis.filter((F.col("analyzer_version") >= version) & F.col("track_id").isNotNull()).select(F.col("track_id").alias("id"), F.lit(True).alias("done")).distinct()
    return fresh.join(done, "id", "left").filter(F.col("discogs_meta_fetched_at").isNull() | F.col("done").isNull()).select("id", "added_at")


def needs_analysis(tracks: DataFrame, analysis: DataFrame, version: int = CURRENT) -> DataFrame:
    """Tracks without an analysis, or whose analysis is of another version or another file; unknown signatures differ."""
    t = latest(tracks, "src_size", "src_mtime")
    v = with_analysis(t, analysis)
    same = (F.col("src_size") == F.col("a_size")) & (F.col("src_mtime") == F.col("a_mtime"))
    reason = (
        F.when(F.col("analyzer_version").isNull(), "none").when(F.col("analyzer_version") != version, "version").when(~F.coalesce(same, F.lit(False)), "file")
    )
    return v.select("id", reason.alias("reason")).filter("reason is not null")


def album_key() -> Column:
    return F.lower(F.trim(F.col("album")))


def album_artist_key() -> Column:
    return F.lower(F.coalesce(F.when(F.trim("album_artist") != "", F.trim("album_artist")), F.col("artist"), F.lit("")))


def siblings(tracks: DataFrame) -> DataFrame:
    """(album, album artist) groups of at least two tracks with their size and ids; blank albums have no siblings.

    A group stands for all its pairs, so a huge one costs a row and not the square of its size.
    """
    t = latest(tracks, "album", "album_artist", "artist").filter(F.trim("album") != "")
    return t.groupBy(album_key().alias("album_key"), album_artist_key().alias("artist_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n >= 2")


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``; a null key is in nothing."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def missing_files(tracks: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, source_path, label) of tracks whose path isn't in ``listing`` (source_path), by path; null paths aren't files."""
    from ..functions.text import file_name, filled

    t = latest(tracks, "source_path", "artist", "title").filter(F.col("source_path").isNotNull())
    a, b = filled(F.col("artist")), filled(F.col("title"))
    label = F.coalesce(F.concat(a, F.lit(" — "), b), b, a, file_name(F.col("source_path")))
    return without(t, listing, "source_path").select("id", "source_path", label.alias("label")).orderBy("source_path", "id")


def display_rows(tracks: DataFrame, analysis: DataFrame, art: DataFrame) -> DataFrame:
    """Latest tracks with their analysis and whether they have art, embedded or outside (``art``: track_id)."""
    outside = art.filter(F.col("track_id").isNotNull()).select(F.col("track_id").alias("id"), F.lit(True).alias("outside")).distinct()
    v = with_analysis(tracks, analysis).join(outside, "id", "left")
    shown = F.coalesce(F.concat(F.col("bitrate_kbps").cast("string"), F.lit(" kbps")), F.lit(""))
    return v.select(
        "id", "artist", "title", "album", "genre", "album_artist", "comment", "year", "format", shown.alias("bitrate"), "bitrate_kbps", "duration_ms", "added_at", F.round("bpm", 1).alias("bpm"),
        (F.col("has_cover") | F.coalesce("outside", F.lit(False))).alias("has_art"),
    )


def grades(tracks: DataFrame, analysis: DataFrame) -> DataFrame:
    """(key_grade, tempo_grade, n) of analysed tracks against their tags (wheel labels and tempi).

    Keys: exact, relative (the other side of one place), adjacent (the next place on one side), other. Tempi: ok within 2,
    octave if half or double is, else miss. 'unknown' where either side is missing or no wheel label.
    """
    from ..functions.keys import parse_camelot

    v = with_analysis(tracks, analysis).filter("analyzer_version is not null")
    n, side = parse_camelot(F.trim("initial_key_tag"))
    mine, mine_side = camelot_number(F.col("key_tonic"), is_major()), is_major()
    step = F.pmod(n - mine, F.lit(12))
    key = F.when(n.isNull() | mine.isNull(), "unknown").when((step == 0) & (side == mine_side), "exact").when(step == 0, "relative").when((side == mine_side) & step.isin(1, 11), "adjacent").otherwise("other")
    off = lambda f: F.abs(F.col("bpm") * f - F.col("bpm_tag"))
    tempo = F.when(F.col("bpm").isNull() | F.col("bpm_tag").isNull(), "unknown").when(off(1) <= 2, "ok").when((off(2) <= 2) | (off(0.5) <= 2), "octave").otherwise("miss")
    return v.groupBy(key.alias("key_grade"), tempo.alias("tempo_grade")).agg(F.count(F.lit(1)).alias("n"))
