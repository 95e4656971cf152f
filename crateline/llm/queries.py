"""Queries of the training-data operators (name, spark, folder of tables) and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, matching, mixing, mojibake, names, styles, survivorship, truncation

P2_FIELDS = ["title", "artist", "album"]


P3_PEOPLE, P3_LABELS = ["artist", "remixer", "album_artist"], ["label"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(table(spark, d, "tracks"), table(spark, d, "release_candidates")).select("track_id", "release_id")


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(table(spark, d, "tracks"), table(spark, d, "release_candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_cells(table(spark, d, "tracks"), "id", P2_FIELDS).select(F.col("id").alias("track_id"), "field").distinct()


def p2_repairs(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_cells(table(spark, d, "tracks"), "id", P2_FIELDS).select(F.col("id").alias("track_id"), "field", "cell", "restored", "pairs").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(names.linked_names(table(spark, d, "tracks"), P3_PEOPLE, P3_LABELS, {}, frozenset()))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_names(table(spark, d, "tracks"), P3_PEOPLE, P3_LABELS, {}, frozenset())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "copies"), table(spark, d, "tracks")).select("group_key", "track_id")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "copies"), table(spark, d, "tracks"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return styles.canonical_styles(table(spark, d, "tracks"), table(spark, d, "release_json"), table(spark, d, "style_list"), styles.Learnt())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("src", "rec_id", "pos", "style_id").distinct()


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, with how often each occurs."""
    return _canonical(spark, d).filter("style_id = 0").groupBy("src", "val").agg(F.count(F.lit(1)).alias("n"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_ids(table(spark, d, "documents"))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    return bpe.id_summary(table(spark, d, "documents"), "source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents")).filter("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.judged(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_confidence, p2_found, p2_repairs, p3_found, p3_entities, p4_found, p4_survivors, p6_found, p6_unmatched, p7_ids, p7_sizes, p8_mix, p8_shares, p9_found, p9_rates)}

TAGS = survivorship.TAGS
# Members of the groups of copies with their place in the ranking, as SQL.
RANKED = f"""t AS (
            SELECT * FROM (
                SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(src_mtime, -4611686018427387904) DESC, coalesce(discogs_meta_fetched_at, -1) DESC) AS rn FROM tracks
            ) WHERE rn = 1
        ), c AS (
            SELECT group_key, track_id, max(fmt) AS fmt, max(CASE WHEN regexp_replace(lower(coalesce(quality, '')), '[^a-z]', '', 'g') IN ('suspect', 'likelylossy') THEN 1 ELSE 0 END) AS transcode
            FROM copies WHERE group_key IS NOT NULL AND track_id IS NOT NULL GROUP BY group_key, track_id
        ), r AS (
            SELECT c.group_key, c.track_id, 1 - c.transcode AS clean, CASE WHEN lower(coalesce(t.format, c.fmt)) IN ('flac', 'wav', 'aiff') THEN 1 ELSE 0 END AS lossless,
                CASE WHEN t.bitrate_kbps >= 20000 THEN CAST(floor(t.bitrate_kbps / 1000) AS BIGINT) ELSE coalesce(t.bitrate_kbps, 0) END AS bitrate,
                {" + ".join(f"(CASE WHEN trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' THEN 1 ELSE 0 END)" for c in TAGS)} AS complete,
                CASE WHEN user_edited THEN 1 ELSE 0 END AS edited, greatest(coalesce(src_mtime, 0), coalesce(discogs_meta_fetched_at, 0)) AS recent, discogs_meta_fetched_at, bit_depth, {", ".join(TAGS)}
            FROM c LEFT JOIN t ON t.id = c.track_id
        ), m AS (
            SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY clean DESC, lossless DESC, bitrate DESC, complete DESC, edited DESC, recent DESC, track_id) AS place FROM r
        )"""

ORACLE = {
    "p4_found": f"WITH {RANKED} SELECT group_key, track_id FROM m WHERE place = 1",
    "p4_survivors": f"""WITH {RANKED}, w AS (
            SELECT *, (1 + 2 * edited + CASE WHEN discogs_meta_fetched_at IS NULL THEN 0 ELSE 0.5 END + 0.25 * clean)::DOUBLE
                * pow(0.5, greatest(((SELECT max(greatest(coalesce(src_mtime, 0), coalesce(discogs_meta_fetched_at, 0))) FROM tracks) - recent) / 86400.0::DOUBLE, 0) / 365.0::DOUBLE) AS weight FROM m
        ), l AS (
            {" UNION ALL ".join(f"SELECT group_key, place, weight, '{c}' AS field, nullif(trim(CAST({c} AS VARCHAR)), '') AS val FROM w" for c in TAGS)}
        ), v AS (
            SELECT group_key, field, replace(lower(regexp_replace(val, '\\s+', ' ', 'g')), 'ς', 'σ') AS norm, round(sum(weight), 9) AS votes, min(place) AS place, arg_min(val, place) AS val
            FROM l WHERE val IS NOT NULL AND lower(val) NOT IN ({", ".join(repr(x) for x in survivorship.EMPTY_WORDS)}) GROUP BY 1, 2, 3
        ), b AS (
            SELECT group_key, field, val FROM (SELECT *, row_number() OVER (PARTITION BY group_key, field ORDER BY votes DESC, place) AS n FROM v) WHERE n = 1
        ), f AS (
            SELECT group_key, {", ".join(f"max(CASE WHEN field = '{c}' THEN val END) AS {c}" for c in TAGS)} FROM b GROUP BY group_key
        )
        SELECT m.group_key, m.track_id, k.copies, CASE WHEN m.bitrate > 0 THEN CAST(m.bitrate AS BIGINT) END AS bitrate_kbps, m.bit_depth, {", ".join(f"CAST(f.{c} AS INTEGER) AS {c}" if c == "year" else f"f.{c}" for c in TAGS)}
        FROM m JOIN (SELECT group_key, count(*) AS copies FROM m GROUP BY 1) k ON k.group_key = m.group_key LEFT JOIN f ON f.group_key = m.group_key WHERE m.place = 1
    """,
}
