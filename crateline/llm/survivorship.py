"""One surviving record for each group of copies: the copy to keep, and the best known value of each field.

The fields of all copies are unpivoted to long rows (group, field, value). Each row is a vote for its normalised value, of
the weight source trust times recency decay; votes for one value are summed, the winner of each field is the value of the
greatest score, and the winners are pivoted back to one row per group. The copy itself is one more field, in which all
members vote for one value and the best ranked of them stands for it: no transcode, lossless container, bit rate, then
completeness and recency of the tags, packed into one number. The members are made once; all steps after that are
aggregates with partial sums before the shuffle, so a group with a third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quality import true_bitrate, verdict_is_transcode

TAGS = ["title", "artist", "album", "album_artist", "remixer", "composer", "genre", "label", "year", "release_country", "release_date", "catalog_number"]
LOSSLESS = ["flac", "wav", "aiff"]
#: Number of the field that stands for the copy itself.
COPY = len(TAGS)
#: Bits of the parts of a packed rank: bit rates up to two million, times up to the year 3058.
BITRATE_BITS, RECENT_BITS = 21, 35
#: Days in which a vote loses half its weight.
HALF_LIFE_DAYS = 365.0
#: Words typed into a tag that say nothing.
EMPTY_WORDS = ["", "none", "unknown", "n/a", "na", "untagged", "various", "?", "???", "***", "-"]


def filled(c: Column) -> Column:
    """The trimmed value, null if blank."""
    t = F.trim(c)
    return F.when(t != "", t)


def _votes_for(c: Column) -> Column:
    """What spellings of one value share: case (both small sigmas are one) and white space don't count."""
    return F.translate(F.lower(F.regexp_replace(c, r"\s+", " ")), "ς", "σ")


def _members(copies: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per (group_key, track_id): the copy's true quality, container and bit rate, and its newest scan."""
    own = copies.filter(F.col("group_key").isNotNull() & F.col("track_id").isNotNull())
    # repeated rows of a copy, and an analysed one among them, come down to one
    own = own.groupBy("group_key", "track_id").agg(F.max(F.coalesce(verdict_is_transcode("quality"), F.lit(False))).alias("transcode"), F.max("fmt").alias("fmt"))
    newest = F.struct(F.coalesce("src_mtime", F.lit(-(1 << 62))), F.coalesce("discogs_meta_fetched_at", F.lit(-1)))
    kept = ["format", "bitrate_kbps", "bit_depth", "src_mtime", "discogs_meta_fetched_at", "user_edited", *TAGS]
    wanted = tracks.select("id", *kept).join(own.select(F.col("track_id").alias("id")).distinct(), "id", "left_semi")
    scans = wanted.groupBy("id").agg(F.max_by(F.struct(*kept), newest).alias("t"))
    return own.join(scans.withColumnRenamed("id", "track_id"), "track_id", "left").select(
        "group_key", "track_id", "transcode", F.lower(F.coalesce(F.col("t.format"), F.col("fmt"))).alias("format"), *[F.col(f"t.{c}").alias(c) for c in kept if c != "format"]
    )


def _packed_rank() -> Column:
    """The ranking of a copy in one number, larger is better: clean, lossless, bit rate, filled tags, edited, newest."""
    complete = sum((F.when(filled(F.col(c).cast("string")).isNotNull(), 1).otherwise(0) for c in TAGS), F.lit(0))
    parts = [
        ((~F.col("transcode")).cast("int"), 1),
        (F.coalesce(F.col("format").isin(LOSSLESS), F.lit(False)).cast("int"), 1),
        (F.coalesce(true_bitrate("bitrate_kbps"), F.lit(0)), BITRATE_BITS),
        (complete, 4),
        (F.coalesce(F.col("user_edited"), F.lit(False)).cast("int"), 1),
        (F.col("recent"), RECENT_BITS),
    ]
    out = F.lit(0).cast("bigint")
    for value, bits in parts:
        inside = F.least(F.greatest(value.cast("bigint"), F.lit(0)), F.lit((1 << bits) - 1))
        out = F.shiftleft(out, bits).bitwiseOR(inside)
    return out


def ranked(copies: DataFrame, tracks: DataFrame) -> DataFrame:
    """Members with ``rank`` (one number, larger is better) and ``recent``, the newest time known of their scan."""
    recent = F.greatest(F.coalesce("src_mtime", F.lit(0)), F.coalesce(F.col("discogs_meta_fetched_at"), F.lit(0)))
    return _members(copies, tracks).withColumn("recent", recent).withColumn("rank", _packed_rank())


def survivors(copies: DataFrame, tracks: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row per group_key: ``track_id`` of the copy to keep, its bit rate and bit depth, and the best value of each tag.

    ``as_of``: unix seconds from which age is counted; by default the newest scan of all tracks. A field that no copy has
    is null. Copies without a track row count with what ``copies`` says (bit rate 0). Null group keys and null track ids
    have no row; repeated rows vote once for each track. Equal votes go to the value of the better copy; level copies to
    the smaller track_id.
    """
    if as_of is None:  # one number from two columns
        as_of = tracks.agg(F.max(F.greatest(F.coalesce("src_mtime", F.lit(0)), F.coalesce("discogs_meta_fetched_at", F.lit(0))))).first()[0] or 0
    age = F.greatest((F.lit(as_of) - F.col("recent")) / 86400.0, F.lit(0.0))
    # a scan that a user corrected is trusted most, then one with outside data, then one of a clean source
    trust = F.lit(1.0) + F.when(F.coalesce("user_edited", F.lit(False)), 2.0).otherwise(0.0) + F.when(F.col("discogs_meta_fetched_at").isNotNull(), 0.5).otherwise(0.0) + F.when(F.col("transcode"), 0.0).otherwise(0.25)
    weighed = ranked(copies, tracks).withColumn("weight", trust * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS))
    # the copy itself is the last field: one value for each group, so its winner is the best ranked member
    fields = [F.struct(F.lit(i).cast("tinyint").alias("field"), filled(F.col(c).cast("string")).alias("value")) for i, c in enumerate(TAGS)]
    itself = F.struct(F.lit(COPY).cast("tinyint").alias("field"), F.coalesce(F.col("bit_depth").cast("string"), F.lit("")).alias("value"))
    long = weighed.select("group_key", "rank", "weight", F.col("track_id"), F.explode(F.array(*fields, itself)).alias("f")).select("group_key", "rank", "weight", "track_id", "f.field", "f.value")
    is_copy = F.col("field") == COPY
    long = long.filter(is_copy | (F.col("value").isNotNull() & ~F.lower("value").isin(EMPTY_WORDS)))
    by_value = long.groupBy("group_key", "field", F.when(~is_copy, _votes_for(F.col("value"))).alias("norm")).agg(
        F.sum("weight").alias("votes"), F.count(F.lit(1)).alias("n"), F.max(F.struct("rank", (-F.col("track_id")).alias("first"), "value")).alias("best")
    )
    scored = by_value.select("group_key", "field", "n", F.struct(F.round("votes", 9).alias("votes"), "best.rank", "best.first", "best.value").alias("score"))
    winners = [F.max(F.when(F.col("field") == i, F.col("score"))).alias(c) for i, c in enumerate([*TAGS, "copy"])]
    pivoted = scored.groupBy("group_key").agg(*winners, F.sum(F.when(is_copy, F.col("n"))).alias("copies"))
    bitrate = F.shiftrightunsigned("copy.rank", 4 + 1 + RECENT_BITS).bitwiseAND(F.lit((1 << BITRATE_BITS) - 1))
    return pivoted.select(
        "group_key", (-F.col("copy.first")).alias("track_id"), "copies", F.when(bitrate > 0, bitrate).alias("bitrate_kbps"), F.nullif(F.col("copy.value"), F.lit("")).cast("int").alias("bit_depth"),
        *[(F.col("year.value").cast("int") if c == "year" else F.col(f"{c}.value")).alias(c) for c in TAGS],
    )
