"""Queries of records, artwork and release documents, each beside the SQL that gives the same rows.

The test tables have no table of outside artwork; the members of duplicate groups stand for one: a row for each track, whose
outside id is its number (behind "master-" for acoustic groups).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, text
from ..operators import catalog, library, records, state
from ..session import table
from ..sources.files import release_documents
from .queries import AS_OF, NUMBER, T, tracks
from .registry import query
from .scalars import MATCH

ART = "art AS (SELECT track_id, min(CASE kind WHEN 'acoustic' THEN 'master-' ELSE '' END || track_id) AS external_id, coalesce(bool_or(is_best), false) AS has_png, bool_or(kind = 'identical') AS has_full, coalesce(bool_or(marked_delete), false) AS prefer FROM copies WHERE track_id IS NOT NULL GROUP BY track_id)"
REC = "rec AS (SELECT TRY_CAST(release_id AS BIGINT) AS release_id, min(trim(split_part(title, ' - ', 1))) AS artist, min(trim(split_part(title, ' - ', 2))) AS title, min(format) AS format, max(cover_image_url) AS cover_url FROM release_candidates WHERE title IS NOT NULL AND release_id IS NOT NULL GROUP BY release_id)"


def art(s, d):
    outside = F.concat(F.when(F.col("kind") == "acoustic", "master-").otherwise(""), F.col("track_id").cast("string"))
    c = table(s, d, "copies").filter("track_id is not null").withColumn("outside", outside)
    return c.groupBy("track_id").agg(F.min("outside").alias("external_id"), F.coalesce(F.max("is_best"), F.lit(False)).alias("has_png"), F.max(F.col("kind") == "identical").alias("has_full"), F.coalesce(F.max("marked_delete"), F.lit(False)).alias("prefer"))


def recs(s, d):
    part = lambda k: F.trim(F.split_part("title", F.lit(" - "), F.lit(k)))
    r = table(s, d, "release_candidates").filter("title is not null and release_id is not null")
    return r.groupBy("release_id").agg(F.min(part(1)).alias("artist"), F.min(part(2)).alias("title"), F.min("format").alias("format"), F.max("cover_image_url").alias("cover_url")).withColumn("release_id", F.col("release_id").try_cast("bigint"))


@query(f"""WITH {T}, {ART} SELECT count(*) AS tracks, count(*) FILTER (has_png) AS with_png, count(*) FILTER (has_full) AS with_full, count(*) FILTER (prefer AND has_png) AS preferred, count(*) FILTER (has_cover OR coalesce(has_png, false)) AS with_art FROM t LEFT JOIN art ON art.track_id = t.id""")
def art_predicates(s, d):
    j = catalog.latest(tracks(s, d), "has_cover").join(art(s, d).withColumnRenamed("track_id", "id"), "id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(F.count(F.lit(1)).alias("tracks"), n(F.col("has_png")).alias("with_png"), n(F.col("has_full")).alias("with_full"), n(F.col("prefer") & F.col("has_png")).alias("preferred"), n(F.col("has_cover") | F.coalesce("has_png", F.lit(False))).alias("with_art"))


@query(f"WITH {T}, {ART} SELECT id FROM t WHERE NOT coalesce(has_cover, false) AND id NOT IN (SELECT track_id FROM art)")
def art_unmatched(s, d):
    return records.without_art(catalog.latest(tracks(s, d), "has_cover"), art(s, d))


@query(f"WITH {T}, {ART} SELECT t.id, external_id FROM t LEFT JOIN art ON art.track_id = t.id WHERE NOT coalesce(has_full, false)")
def art_not_fetched(s, d):
    return records.not_fetched(catalog.latest(tracks(s, d), "has_cover"), art(s, d))


ALBUMS = f"WITH {T}, {ART}, g AS (SELECT t.id, lower(trim(album)) AS k, lower(coalesce(nullif(trim(album_artist), ''), artist, '')) AS a, coalesce(has_cover, false) OR coalesce(has_png, false) AS has_art FROM t LEFT JOIN art ON art.track_id = t.id WHERE trim(album) <> '')"


@query(f"""{ALBUMS}, n AS (SELECT k, a, count(*) AS n, count(*) FILTER (has_art) AS m FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT id, n - 1 AS siblings, m - CASE WHEN has_art THEN 1 ELSE 0 END AS with_art, has_art FROM g JOIN n USING (k, a)""")
def sibling_art_flags(s, d):
    return records.sibling_flags(catalog.latest(tracks(s, d), "album", "album_artist", "artist", "has_cover"), art(s, d))


@query(f"{ALBUMS} SELECT id, from_id FROM g JOIN (SELECT k, a, min(id) AS from_id FROM g WHERE has_art GROUP BY 1, 2) USING (k, a) WHERE NOT has_art")
def cover_propagation(s, d):
    return records.covers_to_spread(catalog.latest(tracks(s, d), "album", "album_artist", "artist", "has_cover"), art(s, d))


@query(f"""WITH {ART}, f AS (SELECT DISTINCT track_id, 'new-' || track_id AS external_id, true AS has_png, analyzer_version = 20 AS has_full FROM analysis WHERE track_id IS NOT NULL)
    SELECT coalesce(art.track_id, f.track_id) AS track_id, CASE WHEN f.track_id IS NULL THEN art.external_id ELSE f.external_id END AS external_id, CASE WHEN f.track_id IS NULL THEN art.has_png ELSE f.has_png END AS has_png,
    CASE WHEN f.track_id IS NULL THEN art.has_full ELSE f.has_full END AS has_full, coalesce(prefer, false) AS prefer, f.track_id IS NOT NULL AND coalesce(f.has_full, false) AS edited FROM art FULL JOIN f ON f.track_id = art.track_id""")
def art_upserted(s, d):
    got = table(s, d, "analysis").filter("track_id is not null").select("track_id", F.concat(F.lit("new-"), F.col("track_id").cast("string")).alias("external_id"), F.lit(True).alias("has_png"), (F.col("analyzer_version") == 20).alias("has_full")).distinct()
    return records.art_upsert(art(s, d), got)


LINKS = f"""{T}, {ART}, {REC}, e AS (SELECT DISTINCT TRY_CAST(trim(external_id) AS BIGINT) AS release_id, track_id FROM art WHERE TRY_CAST(trim(external_id) AS BIGINT) IS NOT NULL),
    x AS (SELECT e.release_id, e.track_id FROM e JOIN rec USING (release_id)), r AS (SELECT release_id, {MATCH.format(c="coalesce(title, '')")} AS k, {MATCH.format(c="coalesce(artist, '')")} AS ra FROM rec WHERE release_id NOT IN (SELECT release_id FROM x)),
    n AS (SELECT id, {MATCH.format(c="coalesce(album, '')")} AS al, {MATCH.format(c="coalesce(title, '')")} AS ti, {MATCH.format(c="coalesce(artist, '')")} AS ar FROM t),
    links AS (SELECT release_id, track_id, 'id' AS how FROM x UNION ALL SELECT release_id, id, 'text' FROM (SELECT release_id, id FROM r JOIN n ON al = k WHERE k <> '' UNION SELECT release_id, id FROM r JOIN n ON ti = k WHERE k <> '' AND ra <> '' AND ar <> '' AND (contains(ar, ra) OR contains(ra, ar))))"""


def links(s, d):
    r = recs(s, d)
    exact = records.id_links(art(s, d)).join(r.select("release_id"), "release_id", "left_semi")
    return records.record_links(r, catalog.latest(tracks(s, d), "artist", "album", "title"), exact)


@query(f"WITH {LINKS} SELECT * FROM links")
def record_links(s, d):
    """Records linked to tracks: by id, those without such a link by album, or by title and artist."""
    return links(s, d)


@query(f"WITH {LINKS} SELECT DISTINCT track_id FROM links JOIN release_json j ON TRY_CAST(j.release_id AS BIGINT) = links.release_id")
def linked_in_list(s, d):
    """Tracks linked to a release of the list of documents."""
    members = table(s, d, "release_json").select(F.col("release_id").try_cast("bigint").alias("release_id")).filter("release_id is not null")
    return records.in_list(links(s, d), members)


@query(f"""WITH {LINKS} SELECT release_id, t.id, title, round(bpm, 1) AS bpm, CAST({NUMBER} AS VARCHAR) || CASE WHEN key_mode = 1 THEN 'B' ELSE 'A' END AS camelot FROM links JOIN t ON t.id = links.track_id LEFT JOIN analysis a ON a.track_id = t.id""")
def local_tracks_of_releases(s, d):
    v = catalog.with_analysis(catalog.latest(tracks(s, d), "title"), table(s, d, "analysis"))
    own = links(s, d).select("release_id", F.col("track_id").alias("id"))
    return own.join(v, "id").select("release_id", "id", "title", F.round("bpm", 1).alias("bpm"), keys.camelot(F.col("key_tonic"), catalog.is_major()).alias("camelot"))


@query(f"WITH {REC} SELECT release_id, format FROM rec WHERE list_contains(list_transform(string_split(format, ','), lambda x: lower(trim(x))), 'vinyl')")
def vinyl_records(s, d):
    return recs(s, d).filter(records.is_vinyl(F.col("format"))).select("release_id", "format")


@query(f"WITH {REC} SELECT release_id, cover_url FROM rec WHERE trim(cover_url) <> '' AND release_id NOT IN (SELECT TRY_CAST(release_id AS BIGINT) FROM release_json WHERE TRY_CAST(release_id AS BIGINT) IS NOT NULL)")
def records_without_cover(s, d):
    """Records with the address of a cover that wasn't fetched: those without a document."""
    have = table(s, d, "release_json").select(F.col("release_id").try_cast("bigint").alias("release_id"))
    return catalog.without(recs(s, d).filter(F.trim("cover_url") != ""), have, "release_id").select("release_id", "cover_url")


@query(f"WITH {T} SELECT id, CAST(row_number() OVER (ORDER BY discogs_meta_fetched_at IS NOT NULL, discogs_meta_fetched_at, id) AS INTEGER) AS place FROM t WHERE discogs_meta_fetched_at IS NULL OR {AS_OF} - discogs_meta_fetched_at > 2592000 ORDER BY place LIMIT 100")
def price_queue(s, d):
    """The next hundred to be asked for: never checked first, then the oldest."""
    due, order = records.price_queue(catalog.latest(tracks(s, d), "discogs_meta_fetched_at").withColumnRenamed("discogs_meta_fetched_at", "checked_at"), AS_OF, 2_592_000)
    return library.numbered(due, order, 100).select("id", "place")


@query(f"""WITH {REC}, s AS (SELECT DISTINCT TRY_CAST(release_id AS BIGINT) AS instance_id, 'old' AS title, CAST(min(detail_version) AS DOUBLE) AS price FROM release_json WHERE release_id IS NOT NULL GROUP BY release_id), n AS (SELECT release_id AS instance_id, title FROM rec WHERE list_contains(string_split(format, ', '), 'Vinyl'))
    SELECT coalesce(s.instance_id, n.instance_id) AS instance_id, CASE WHEN n.instance_id IS NULL THEN s.title ELSE n.title END AS title, price, CASE WHEN s.instance_id IS NULL THEN 'added' WHEN n.instance_id IS NULL THEN 'gone' ELSE 'kept' END AS status FROM s FULL JOIN n ON s.instance_id = n.instance_id""")
def record_upserted(s, d):
    """Stored records merged with a fetched list: the price stays with the instance."""
    stored = table(s, d, "release_json").filter("release_id is not null").groupBy("release_id").agg(F.min("detail_version").cast("double").alias("price")).select(F.col("release_id").try_cast("bigint").alias("instance_id"), F.lit("old").alias("title"), "price")
    new = recs(s, d).filter(F.array_contains(F.split("format", ", "), "Vinyl")).select(F.col("release_id").alias("instance_id"), "title")
    return records.record_upsert(stored, new, ["title"], ["price"])


@query("""SELECT c.release_id, CASE WHEN c.release_id IN (SELECT release_id FROM release_json WHERE detail_version >= 2 AND json_valid(detail_json)) THEN 'hit' ELSE 'fetch' END AS status FROM (SELECT DISTINCT release_id FROM release_candidates WHERE release_id IS NOT NULL) c""")
def release_cache_plan(s, d):
    """Which releases the cache has in the current form and which must be fetched."""
    return records.cache_plan(table(s, d, "release_candidates").filter("release_id is not null"), table(s, d, "release_json"))


def docs(s, d):
    """One current document of each release: of the highest version, then the greatest text."""
    raw = table(s, d, "release_json").filter("release_id is not null and detail_version >= 2 and try_parse_json(detail_json) is not null")
    one = raw.groupBy("release_id").agg(F.max(F.struct("detail_version", "detail_json")).alias("m")).select("release_id", "m.detail_json", "m.detail_version")
    return release_documents(one, 2)


DOCS = "docs AS (SELECT release_id, detail_json AS j FROM (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY detail_version DESC, detail_json DESC) AS n FROM release_json WHERE release_id IS NOT NULL AND detail_version >= 2 AND json_valid(detail_json)) WHERE n = 1)"


@query(f"""WITH {DOCS}, e AS (SELECT release_id, unnest(json_extract(j, '$.tracklist[*]')) AS x, generate_subscripts(json_extract(j, '$.tracklist[*]'), 1) AS ix FROM docs),
    k AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY ix) AS place FROM e WHERE coalesce(json_extract_string(x, '$.type'), '') IN ('', 'track') AND trim(json_extract_string(x, '$.title')) <> '')
    SELECT release_id, CAST(place AS INTEGER) AS place, json_extract_string(x, '$.position') AS position, json_extract_string(x, '$.title') AS title, json_extract_string(x, '$.duration') AS duration FROM k""")
def release_tracklists(s, d):
    """The tracks of each current document."""
    own = docs(s, d).select("release_id", F.posexplode(records.tracklist(F.col("d"))).alias("p", "x"))
    return own.select("release_id", (F.col("p") + 1).alias("place"), "x.position", "x.title", "x.duration")


def _blank(c: str) -> str:
    return f"(t.{c} IS NULL OR trim(CAST(t.{c} AS VARCHAR)) = '')"


DETAIL = f"""{T}, {DOCS}, v AS (SELECT TRY_CAST(release_id AS BIGINT) AS id, nullif(trim(CASE WHEN json_array_length(j, '$.styles') > 0 THEN array_to_string(CAST(json_extract(j, '$.styles') AS VARCHAR[]), ', ') ELSE array_to_string(CAST(json_extract(j, '$.genres') AS VARCHAR[]), ', ') END), '') AS genre,
    nullif(trim(json_extract_string(j, '$.label')), '') AS label, nullif(trim(json_extract_string(j, '$.catalog_number')), '') AS catalog_number, nullif(trim(json_extract_string(j, '$.country')), '') AS release_country, nullif(trim(json_extract_string(j, '$.title')), '') AS album,
    nullif(trim(json_extract_string(j, '$.released')), '') AS release_date, json_extract_string(j, '$.year') AS year FROM docs)"""


def _fills_sql(overwrite: bool) -> str:
    changes = {c: f"v.{c} IS NOT NULL AND " + (f"(t.{c} IS NULL OR trim(CAST(t.{c} AS VARCHAR)) <> v.{c})" if overwrite else _blank(c)) for c in records.FILLED}
    cols = ", ".join(f"CASE WHEN {changes[c]} THEN v.{c} ELSE CAST(t.{c} AS VARCHAR) END AS {c}" for c in records.FILLED)
    return f"WITH {DETAIL} SELECT t.id, {cols}, {' + '.join(f'CASE WHEN {x} THEN 1 ELSE 0 END' for x in changes.values())} AS n_changed FROM t JOIN v ON v.id = t.id"


def _filled(s, d, overwrite):
    t = catalog.latest(tracks(s, d), *records.FILLED)
    values = records.fill_values(F.col("d"))
    detail = docs(s, d).select(F.col("release_id").try_cast("bigint").alias("id"), *[v.alias(c) for c, v in values.items()])
    tags = t.select("id", *[F.col(c).cast("string").alias(c) for c in records.FILLED]).join(detail.select("id"), "id", "left_semi")
    return state.fills(tags, detail, "id", records.FILLED, overwrite)


@query(_fills_sql(False))
def fills_of_blanks(s, d):
    """Album-level tags filled from the document of the track's number where they are blank, with how many were."""
    return _filled(s, d, False)


@query(_fills_sql(True))
def fills_overwriting(s, d):
    """The same, replacing what differs."""
    return _filled(s, d, True)


@query()
def tracklist_players(s, d):
    """What plays each track of a release: a linked local file with its title, otherwise a video."""
    files = links(s, d).select(F.col("release_id").cast("string").alias("release_id"), "track_id").join(catalog.latest(tracks(s, d), "title").withColumnRenamed("id", "track_id"), "track_id")
    own = docs(s, d).select("release_id", records.tracklist(F.col("d")).alias("entries"), records.videos(F.col("d")).alias("videos"))
    return records.players(own.join(records.claimable(files, own), "release_id", "left"))


@query(f"""WITH {T}, {ART} SELECT id, CASE WHEN id IN (SELECT track_id FROM art WHERE has_png) THEN {AS_OF} WHEN id IN (SELECT track_id FROM art WHERE has_full) THEN NULL ELSE discogs_meta_fetched_at END AS fetched_at FROM t""")
def fetched_marks(s, d):
    """The time of fetching set for the tracks whose cover was found, and cleared for those to be fetched again."""
    a = art(s, d)
    marked = a.filter("has_png").select(F.col("track_id").alias("id"))
    cleared = a.filter("has_full and not has_png").select(F.col("track_id").alias("id"))
    return state.fetched_marked(state.fetched_cleared(catalog.latest(tracks(s, d), "discogs_meta_fetched_at").withColumnRenamed("discogs_meta_fetched_at", "fetched_at"), cleared), marked, AS_OF)
