"""Queries of the library's ordered views, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, library
from ..session import table
from ..skew import union_all
from .queries import AS_OF, NUMBER, SEVERITY, VERDICT, T, tracks
from .registry import query

LIKE = "(" + " OR ".join(f"lower(coalesce({c},'')) LIKE '%{{w}}%'" for c in catalog.SEARCHED) + ")"


@query(f"""WITH {T} SELECT id, artist, title, CAST(row_number() OVER (ORDER BY artist NULLS FIRST, title NULLS FIRST, id) AS INTEGER) AS place FROM t WHERE {LIKE.format(w="e")} AND {LIKE.format(w="mix")} ORDER BY place LIMIT 200""")
def track_listing(s, d):
    """The first 200 hits of a search in the order of a listing."""
    found = catalog.latest(tracks(s, d), *catalog.SEARCHED).filter(text.search(catalog.SEARCHED, "E mix")).select("id", "artist", "title")
    return library.numbered(found, library.listing_order(), 200)


@query(f"""WITH {T} SELECT id, title FROM t WHERE id IN (SELECT track_id FROM copies WHERE kind = 'acoustic') AND {LIKE.format(w="o")}""")
def listed_ids_with_search(s, d):
    ids = table(s, d, "copies").filter("kind = 'acoustic'").select(F.col("track_id").alias("id"))
    found = catalog.latest(tracks(s, d), *catalog.SEARCHED).filter(text.search(catalog.SEARCHED, " O "))
    return library.by_ids(found, ids).select("id", "title")


ROWS = f"""{T}, v AS (SELECT t.id, t.artist, t.title, t.album, t.genre, t.format, t.comment, t.duration_ms, t.bitrate_kbps, t.added_at, a.bpm, {NUMBER} * 2 + CASE WHEN key_mode = 1 THEN 1 ELSE 0 END AS key_order,
    CASE WHEN analyzer_version >= 6 THEN {SEVERITY.format(v=VERDICT)} END AS quality_order FROM t LEFT JOIN analysis a ON a.track_id = t.id)"""


def _sorted_sql(column: str, up: bool) -> str:
    c = f"lower(coalesce({column}, ''))" if column in library.TEXTS else column
    nulls = ("LAST" if up else "FIRST") if column in library.NULLS_LAST else ("FIRST" if up else "LAST")
    return f"(SELECT '{column}' AS \"column\", {str(up).lower()} AS ascending, CAST(row_number() OVER (ORDER BY {c} {'ASC' if up else 'DESC'} NULLS {nulls}, id) AS INTEGER) AS place, id FROM v ORDER BY place LIMIT 20)"


@query(f"WITH {ROWS} " + " UNION ALL ".join(_sorted_sql(c, up) for c in library.TEXTS + library.NUMBERS + library.NULLS_LAST for up in (True, False)))
def table_sorts(s, d):
    """The head of the track table by each of its twelve columns, both ways."""
    t = catalog.latest(tracks(s, d), "artist", "title", "album", "genre", "format", "comment", "duration_ms", "bitrate_kbps", "added_at")
    v = catalog.with_analysis(t, table(s, d, "analysis"))
    number = catalog.wheel_order(catalog.camelot_number(F.col("key_tonic"), catalog.is_major()), catalog.is_major())
    word = catalog.verdict("lowpass_hz", "lowpass_edge")
    return library.table_tops(v.withColumn("key_order", number).withColumn("quality_order", F.when(F.col("analyzer_version") >= 6, catalog.severity(word))), 20)


VINYL = """r AS (SELECT release_id, min(trim(split_part(title, ' - ', 1))) AS artist, min(trim(title)) AS title, min(nullif(trim(year), '')) AS added, CASE WHEN TRY_CAST(release_id AS BIGINT) % 3 = 0 THEN NULL ELSE (TRY_CAST(release_id AS BIGINT) % 97) * 1.25 END AS price, CAST(release_id AS BIGINT) AS instance_id FROM release_candidates WHERE title IS NOT NULL GROUP BY release_id)"""


def _vinyl_sql(by: str, up: bool) -> str:
    way = "ASC" if up else "DESC"
    keys = f"lower(artist) {way} NULLS LAST, lower(title) NULLS FIRST, instance_id" if by == "artist" else f"{by} {way} NULLS LAST, artist NULLS FIRST, instance_id"
    return f"(SELECT '{by}' AS sorted_by, {str(up).lower()} AS ascending, CAST(row_number() OVER (ORDER BY {keys}) AS INTEGER) AS place, instance_id FROM r ORDER BY place LIMIT 25)"


@query(f"WITH {VINYL} " + " UNION ALL ".join(_vinyl_sql(by, up) for by in ("artist", "added", "price") for up in (True, False)))
def record_sorts(s, d):
    """Records by artist, date or price, both ways; what is missing comes last."""
    r = table(s, d, "release_candidates").filter("title is not null")
    n = F.col("release_id").cast("bigint")
    own = r.groupBy("release_id").agg(F.min(F.trim(F.split_part("title", F.lit(" - "), F.lit(1)))).alias("artist"), F.min(F.trim("title")).alias("title"), F.min(text.filled(F.col("year"))).alias("added")).withColumn("price", F.when(n % 3 != 0, (n % 97) * 1.25)).withColumn("instance_id", n)
    out = [library.numbered(own, library.vinyl_order(by, up), 25).select(F.lit(by).alias("sorted_by"), F.lit(up).alias("ascending"), "place", "instance_id") for by in ("artist", "added", "price") for up in (True, False)]
    return union_all(out)


@query(f"""WITH {T}, i AS (SELECT id, added_at FROM t WHERE {AS_OF} - added_at < 31536000 AND (discogs_meta_fetched_at IS NULL OR NOT EXISTS (SELECT 1 FROM analysis a WHERE a.track_id = t.id AND a.analyzer_version >= 20)))
    SELECT id, max(added_at) AS added_at FROM (SELECT * FROM i UNION ALL SELECT id, added_at FROM t WHERE user_edited) GROUP BY id""")
def inbox_with_pinned(s, d):
    """The inbox and the rows pinned in it, newest first."""
    pinned = catalog.latest(tracks(s, d), "added_at", "user_edited").filter("user_edited")
    return library.with_pinned(catalog.inbox(tracks(s, d), table(s, d, "analysis"), AS_OF, window_s=31_536_000), pinned)


@query(f"""WITH {T}, k AS (SELECT t.id, {NUMBER} AS n, key_mode AS m FROM t LEFT JOIN analysis a ON a.track_id = t.id), c AS (SELECT * FROM k WHERE n IS NOT NULL AND m IS NOT NULL ORDER BY id LIMIT 1),
    f AS (SELECT k.id FROM k JOIN c ON k.id <> c.id AND (k.n = c.n OR (k.m = c.m AND abs(k.n - c.n) IN (1, 11)))) SELECT id FROM f ORDER BY md5('5/' || id), id LIMIT 1""")
def smart_pick(s, d):
    """A track at random (seed 5) that goes with the first track that has a key."""
    rows = catalog.with_analysis(catalog.latest(tracks(s, d), "format"), table(s, d, "analysis")).select("id", "key_tonic", "key_mode")
    first = rows.filter("key_tonic is not null and key_mode is not null").agg(F.min("id")).first()[0]
    return library.next_track(rows, first, 5).select("id")


@query(f"""WITH {T} SELECT id FROM t WHERE lower(concat_ws(' ', coalesce(artist, ''), coalesce(title, ''), coalesce(album, ''), coalesce(genre, ''), coalesce(source_path, ''))) LIKE '%crate03/20%'""")
def device_rows(s, d):
    cols = ["artist", "title", "album", "genre", "source_path"]
    return catalog.latest(tracks(s, d), *cols).filter(library.concat_filter(cols, " Crate03/20 ")).select("id")


@query(f"WITH {T} SELECT id, artist, title FROM t WHERE user_edited")
def edited_tracks(s, d):
    """Rows that a user edited, in the order of a listing."""
    return library.listed(catalog.latest(tracks(s, d), "artist", "title", "user_edited").filter("user_edited")).select("id", "artist", "title")


@query("""SELECT release_id, artist, lower(artist) AS sort_key FROM (SELECT DISTINCT release_id, trim(split_part(title, ' - ', 1)) AS artist FROM release_candidates WHERE title IS NOT NULL)""")
def records_without_case(s, d):
    """Records in an order in which case doesn't count."""
    r = table(s, d, "release_candidates").filter("title is not null").select("release_id", F.trim(F.split_part("title", F.lit(" - "), F.lit(1))).alias("artist")).distinct()
    return r.withColumn("sort_key", F.lower("artist")).orderBy("sort_key", "release_id")


PATHS = "p AS (SELECT DISTINCT path FROM (SELECT source_path AS path, id FROM tracks WHERE src_mtime IS NOT NULL) WHERE id NOT IN (SELECT track_id FROM copies WHERE marked_delete AND track_id IS NOT NULL))"


@query(f"""WITH {T}, {PATHS} SELECT id, source_path, CASE WHEN trim(artist) <> '' AND trim(title) <> '' THEN trim(artist) || ' — ' || trim(title) WHEN trim(title) <> '' THEN trim(title) WHEN trim(artist) <> '' THEN trim(artist) ELSE regexp_extract(source_path, '[^/]*$') END AS label
    FROM t WHERE source_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = t.source_path)""")
def missing_files(s, d):
    """Tracks whose file isn't in the listing of the volume, with their labels, by path."""
    gone = table(s, d, "copies").filter("marked_delete and track_id is not null").select(F.col("track_id").alias("id"))
    listing = tracks(s, d).filter("src_mtime is not null and source_path is not null").join(gone, "id", "left_anti").select("source_path")
    return catalog.missing_files(tracks(s, d), listing)


@query(f"""WITH {T}, b AS (SELECT id, coalesce(source_path, '') AS source, '/usb/' || coalesce(format, 'other') || '/' || coalesce(nullif(trim(regexp_replace(lower(left(title, 3)), '[^a-z]+', '', 'g')), ''), 'x') || '.mp3' AS base FROM t),
    used AS (SELECT '/usb/mp3/the.mp3' AS path UNION SELECT '/usb/mp3/the (2).mp3' UNION SELECT '/usb/flac/x (1).mp3'),
    c AS (SELECT base, count(*) AS m FROM b GROUP BY 1), o AS (SELECT base, unnest(generate_series(0, m + 3)) AS k FROM c), n AS (SELECT base, k, CASE WHEN k = 0 THEN base ELSE regexp_replace(base, '\\.mp3$', '') || ' (' || k || ').mp3' END AS target FROM o),
    f AS (SELECT base, target, row_number() OVER (PARTITION BY base ORDER BY k) AS turn FROM n WHERE target NOT IN (SELECT path FROM used)), r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS turn FROM b)
    SELECT r.id, f.target FROM r JOIN f ON f.base = r.base AND f.turn = r.turn""")
def free_targets(s, d):
    """A file name of its own for each track where many would share one."""
    t = catalog.latest(tracks(s, d), "source_path", "format", "title")
    short = text.filled(F.regexp_replace(F.lower(F.substring("title", 1, 3)), "[^a-z]+", ""))
    base = F.concat(F.lit("/usb/"), F.coalesce("format", F.lit("other")), F.lit("/"), F.coalesce(short, F.lit("x")), F.lit(".mp3"))
    used = s.createDataFrame([("/usb/mp3/the.mp3",), ("/usb/mp3/the (2).mp3",), ("/usb/flac/x (1).mp3",)], "path string")
    return library.free_names(t.select("id", F.coalesce("source_path", F.lit("")).alias("source"), base.alias("base")), used)


@query(f"""WITH {T} SELECT t.id, artist, title, album, genre, album_artist, comment, year, format, coalesce(bitrate_kbps || ' kbps', '') AS bitrate, bitrate_kbps, duration_ms, added_at, round(a.bpm, 1) AS bpm, has_cover OR EXISTS (SELECT 1 FROM copies c WHERE c.track_id = t.id AND c.is_best) AS has_art FROM t LEFT JOIN analysis a ON a.track_id = t.id""")
def display_rows(s, d):
    """Rows of the track table: shown texts beside the values they sort by."""
    t = catalog.latest(tracks(s, d), "artist", "title", "album", "genre", "album_artist", "comment", "year", "format", "bitrate_kbps", "duration_ms", "added_at", "has_cover")
    art = table(s, d, "copies").filter("is_best").select("track_id")
    return catalog.display_rows(t, table(s, d, "analysis"), art)


MANAGED = ["title", "artist", "album", "album_artist", "genre", "label", "year", "comment"]


@query(f"""WITH {T}
    SELECT t.id, t.source_path, t.has_cover AS write_cover, {" + ".join(f"CASE WHEN nullif(trim(CAST(t.{c} AS VARCHAR)), '') IS NOT NULL THEN 1 ELSE 0 END" for c in MANAGED)} AS fields FROM t WHERE t.user_edited AND t.source_path IS NOT NULL""")
def tag_worklist(s, d):
    """What is to be written back into files: edited tracks, how many managed fields they have, whether with a cover."""
    t = catalog.latest(tracks(s, d), "source_path", "has_cover", "user_edited", *MANAGED)
    return library.tag_worklist(t, MANAGED)
