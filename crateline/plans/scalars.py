"""Queries of the scalar functions over the whole catalogue, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, quality, text
from ..operators import catalog
from ..session import table
from .queries import AS_OF, NUMBER, VERDICT, T, tracks
from .registry import query

#: A leading number goes with the signs behind it, unless nothing else is left.
BARE = r"CASE WHEN regexp_matches(ltrim({c}), '^[0-9]*[.)\-]*\s*$') THEN ltrim({c}) ELSE regexp_replace(ltrim({c}), '^[0-9]*[.)\-]*\s*', '') END"
STEM = r"regexp_replace(regexp_extract({c}, '[^/]*$'), '\.[^.]*$', '')"


@query(f"""WITH {T}, a AS (SELECT id, replace({STEM.format(c="source_path")}, chr(8208), '-') AS stem FROM t WHERE source_path IS NOT NULL), b AS (SELECT id, stem, list_transform(string_split(stem, ' - '), lambda x: trim(x)) AS p FROM a),
    c AS (SELECT id, stem, p, list_position(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 0 ELSE 1 END), 1) AS k FROM b), d AS (SELECT id, stem, k, CASE WHEN k > 0 THEN p[k:] END AS kept FROM c)
    SELECT id, nullif(trim(CASE WHEN len(kept) >= 2 THEN {BARE.format(c="kept[1]")} END), '') AS artist, nullif(trim(CASE WHEN k IS NULL OR k = 0 THEN stem WHEN len(kept) >= 2 THEN array_to_string(kept[2:], ' - ') ELSE {BARE.format(c="kept[1]")} END), '') AS title FROM d""")
def filename_fields(s, d):
    """Artist and title as a file's name has them."""
    artist, title = text.parse_filename(text.file_stem(F.col("source_path")))
    return catalog.latest(tracks(s, d), "source_path").filter("source_path is not null").select("id", artist.alias("artist"), title.alias("title"))


@query(f"""WITH {T} SELECT id, CASE WHEN CAST(regexp_extract(release_date, '^(\\d+)', 1) AS VARCHAR) <> '' AND TRY_CAST(regexp_extract(release_date, '^(\\d+)', 1) AS INTEGER) BETWEEN 1900 AND 2200 THEN TRY_CAST(regexp_extract(release_date, '^(\\d+)', 1) AS INTEGER) END AS released,
    CASE WHEN bpm_tag BETWEEN 1 AND 400 THEN bpm_tag END AS tempo, CASE WHEN floor(bpm_tag) = bpm_tag THEN CAST(CAST(bpm_tag AS BIGINT) AS VARCHAR) ELSE CAST(CAST(bpm_tag AS DECIMAL(9, 2)) AS VARCHAR) END AS tempo_text,
    CAST(CAST(round(CAST(floor(bpm_tag::DOUBLE) / 8 - 12 AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2)) AS VARCHAR) || ' dB' AS gain, CAST(round(CAST(floor(bpm_tag::DOUBLE) / 8 - 12 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS gain_back FROM t""")
def tag_numbers(s, d):
    """Numbers of tags read and written: years, tempi, gains."""
    t = catalog.latest(tracks(s, d), "release_date", "bpm_tag")
    gain = text.decibels(F.floor("bpm_tag") / 8 - 12)
    whole = F.col("bpm_tag") == F.floor("bpm_tag")
    shown = F.when(whole, text.plain_number(F.col("bpm_tag"))).otherwise(F.col("bpm_tag").cast("decimal(9,2)").cast("string"))
    return t.select("id", text.parse_year(F.col("release_date")).alias("released"), text.tempo_tag(F.col("bpm_tag")).alias("tempo"), shown.alias("tempo_text"), gain.alias("gain"), F.round(text.parse_decibels(gain), 6).alias("gain_back"))


@query("""WITH n AS (SELECT l_linenumber, l_quantity, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
    SELECT CAST(l_linenumber AS INTEGER) AS track, CAST(l_quantity AS INTEGER) AS tracks_in_all, l_returnflag = 'A' AS compilation, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1, 2, 3""")
def numbers_of_sides(s, d):
    """'3/12' as a tag has it, read back; a flag as programs write it."""
    li = table(s, d, "lineitem").select(F.format_string(" %d/%d", F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("tag"), F.when(F.col("l_returnflag") == "A", " True ").otherwise("no").alias("flag"))
    return li.groupBy(text.head_number(F.col("tag")).alias("track"), F.substring_index("tag", "/", -1).cast("int").alias("tracks_in_all"), text.is_compilation(F.col("flag")).alias("compilation")).agg(F.count(F.lit(1)).alias("n"))


SAFE = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({c}, '[\x00-\x1f\x7f]', ' ', 'g'), '[/\\:*?"<>|]', '-', 'g'), '\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g')"""
JOINED = "CASE WHEN trim(artist) <> '' AND trim(title) <> '' THEN trim(artist) || ' - ' || trim(title) WHEN trim(artist) <> '' THEN trim(artist) WHEN trim(title) <> '' THEN trim(title) END"
UNDOT = r"CASE WHEN length({c}) > 1 THEN substr({c}, 1, 1) || regexp_replace(substr({c}, 2), '\.[^.]*$', '') ELSE {c} END"


@query(f"""WITH {T}, a AS (SELECT id, source_path, bitrate_kbps, CASE WHEN format IN ('flac', 'wav', 'aiff') THEN 'mp3' ELSE 'aac' END AS target, {SAFE.format(c=JOINED)} AS safe FROM t WHERE source_path IS NOT NULL),
    b AS (SELECT *, CASE WHEN regexp_matches(safe, '[\\p{{L}}\\p{{N}}]') THEN safe END AS stem FROM a)
    SELECT id, stem, regexp_replace(source_path, '/[^/]*$', '') || '/' || {UNDOT.format(c=STEM.format(c="source_path"))} || '.' || CASE target WHEN 'mp3' THEN 'mp3' ELSE 'm4a' END AS beside,
        '/usb/crate/' || {UNDOT.format(c=f"coalesce(stem, {STEM.format(c='source_path')})")} || '.' || CASE target WHEN 'mp3' THEN 'mp3' ELSE 'm4a' END AS named, CAST(CASE target WHEN 'mp3' THEN 320 ELSE coalesce(bitrate_kbps, 256) END AS INTEGER) AS kbps FROM b""")
def conversion_targets(s, d):
    """Where each file goes when converted, beside itself or by its tags, and at which rate."""
    t = catalog.latest(tracks(s, d), "source_path", "artist", "title", "format", "bitrate_kbps").filter("source_path is not null")
    target = F.when(quality.is_lossless("format"), "mp3").otherwise("aac")
    wanted = F.when(target == "aac", F.col("bitrate_kbps"))
    stem = text.metadata_stem(F.col("artist"), F.col("title"))
    return t.select("id", stem.alias("stem"), text.target_path(F.col("source_path"), target).alias("beside"), text.target_path(F.col("source_path"), target, "/usb/crate/", stem).alias("named"), text.target_bitrate(target, wanted).alias("kbps"))


@query(f"""WITH {T}, a AS (SELECT id, added_at, year, format, label, catalog_number, concat_ws(' ', nullif(trim(artist), ''), coalesce(nullif(trim(album), ''), nullif(trim(title), ''))) AS search, concat_ws(' - ', nullif(trim(artist), ''), nullif(trim(title), '')) AS pair FROM t)
    SELECT id, search, pair, 'https://www.discogs.com/search/?type=release&q=' || url_encode(search) AS link, concat_ws(' · ', CAST(year AS VARCHAR), format) AS brief,
        concat_ws(' · ', CAST(year AS VARCHAR), format, nullif(concat_ws(' ', label, catalog_number), '')) AS caption,
        CASE WHEN added_at IS NULL OR added_at <= 0 OR added_at > {AS_OF} THEN '—' WHEN ({AS_OF} - added_at) // 86400 = 0 THEN 'today' WHEN ({AS_OF} - added_at) // 86400 = 1 THEN 'yesterday' WHEN ({AS_OF} - added_at) // 86400 < 7 THEN (({AS_OF} - added_at) // 86400) || 'd ago'
        WHEN ({AS_OF} - added_at) // 86400 < 30 THEN (({AS_OF} - added_at) // 86400 // 7) || 'w ago' WHEN ({AS_OF} - added_at) // 86400 < 365 THEN (({AS_OF} - added_at) // 86400 // 30) || 'mo ago' ELSE (({AS_OF} - added_at) // 86400 // 365) || 'y ago' END AS added,
        CASE WHEN length(label) > 12 THEN substr(label, 1, 11) || '…' ELSE label END AS short_label FROM a""")
def captions_and_links(s, d):
    """Texts shown for a track: what to search for, links, captions, ages."""
    t = catalog.latest(tracks(s, d), "artist", "album", "title", "year", "format", "label", "catalog_number", "added_at")
    c = F.col
    search = text.search_text(c("artist"), c("album"), c("title"))
    return t.select(
        "id", search.alias("search"), text.pair_text(c("artist"), c("title")).alias("pair"), text.release_link(F.lit(None).cast("string"), search).alias("link"), text.caption(c("year"), c("format")).alias("brief"),
        text.caption(c("year"), c("format"), c("label"), c("catalog_number")).alias("caption"), text.age(c("added_at"), F.lit(AS_OF), " ago").alias("added"), text.shortened(c("label"), 12).alias("short_label"),
    )


@query("""SELECT DISTINCT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '$' || printf('%.2f', o_totalprice) WHEN '2-HIGH' THEN '€' || printf('%.2f', o_totalprice) WHEN '3-MEDIUM' THEN printf('%.2f', o_totalprice) || ' SEK' WHEN '5-LOW' THEN '$' || printf('%.2f', o_totalprice) ELSE printf('%.2f', o_totalprice) END AS exact,
    CASE o_orderpriority WHEN '1-URGENT' THEN '$' || CAST(round(o_totalprice) AS BIGINT) WHEN '2-HIGH' THEN '€' || CAST(round(o_totalprice) AS BIGINT) WHEN '3-MEDIUM' THEN CAST(round(o_totalprice) AS BIGINT) || ' SEK' WHEN '5-LOW' THEN '$' || CAST(round(o_totalprice) AS BIGINT) ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) END AS rounded FROM orders""")
def prices(s, d):
    p = F.col("o_orderpriority")
    code = F.when(p == "1-URGENT", " usd").when(p == "2-HIGH", "EUR").when(p == "3-MEDIUM", "sek").when(p == "5-LOW", "AUD")
    return table(s, d, "orders").select("o_orderkey", text.price(F.col("o_totalprice"), code).alias("exact"), text.price(F.col("o_totalprice"), code, False).alias("rounded")).distinct()


@query(f"""WITH {T}, v AS (SELECT t.id, lowpass_hz AS hz, CASE WHEN a.analyzer_version >= 6 THEN {VERDICT} END AS v FROM t LEFT JOIN analysis a ON a.track_id = t.id)
    SELECT id, CASE v WHEN 'suspect' THEN '~320?' WHEN 'likely_lossy' THEN 'lossy' WHEN 'clean' THEN 'clean' WHEN 'inconclusive' THEN 'clean' END AS chip,
        CASE WHEN v IS NULL THEN 'Not checked yet. Run Analyze to scan for lossy transcodes.' ELSE CASE v WHEN 'suspect' THEN 'Sharp cutoff near 20 kHz, possibly a 320 kbps transcode' WHEN 'likely_lossy' THEN 'Brick wall well below Nyquist, almost certainly a lossy transcode' ELSE 'No transcode signature. Looks fine.' END
        || CASE WHEN hz IS NULL THEN '' ELSE chr(10) || 'Low-pass cutoff: ' || CAST(CAST(round(CAST(hz / 1000 AS DECIMAL(18, 6)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || ' kHz' END
        || CASE WHEN v IN ('suspect', 'likely_lossy') THEN chr(10) || 'Estimated source: ' || CASE WHEN hz >= 20000 THEN '~320 kbps (or lossless w/ 20 kHz shelf)' WHEN hz >= 18500 THEN '~256 kbps' WHEN hz >= 15500 THEN '~192 kbps / AAC' WHEN hz >= 13500 THEN '~128 kbps' ELSE '≤96 kbps' END ELSE '' END END AS blurb FROM v""")
def quality_texts(s, d):
    v = catalog.with_analysis(catalog.latest(tracks(s, d), "format"), table(s, d, "analysis"))
    word = F.when(F.col("analyzer_version") >= 6, quality.verdict("lowpass_hz", "lowpass_edge"))
    return v.select("id", quality.chip(word).alias("chip"), quality.blurb(word, F.col("lowpass_hz")).alias("blurb"))


@query(f"""WITH {T}, k AS (SELECT id, trim(initial_key_tag) AS k, initial_key_tag AS raw FROM t WHERE initial_key_tag IS NOT NULL), p AS (SELECT *, regexp_matches(k, '^[A-Ga-g][#b]?\\s*(m|min|minor|maj|major)?$') AS ok, regexp_matches(raw, '^\\s*(1[0-2]|[1-9])[ABab]\\s*$') AS wheel FROM k)
    SELECT id, CASE WHEN ok THEN CAST((([9, 11, 0, 2, 4, 5, 7])[ascii(upper(k[1])) - 64] + CASE WHEN k[2] = '#' THEN 1 WHEN k[2] = 'b' THEN -1 ELSE 0 END + 12) % 12 AS INTEGER) END AS tonic, CASE WHEN ok THEN NOT regexp_matches(k, '(m|min|minor)$') END AS major,
        CASE WHEN wheel THEN CAST(regexp_extract(raw, '(\\d+)', 1) AS INTEGER) END AS number, CASE WHEN wheel THEN upper(regexp_extract(raw, '([ABab])\\s*$', 1)) = 'B' END AS outer FROM p""")
def key_tags(s, d):
    """Keys as tags name them, as notes or as places on the wheel."""
    t = catalog.latest(tracks(s, d), "initial_key_tag").filter("initial_key_tag is not null")
    tonic, major = keys.parse_key(F.col("initial_key_tag"))
    number, outer = keys.parse_camelot(F.col("initial_key_tag"))
    return t.select("id", tonic.alias("tonic"), major.alias("major"), number.alias("number"), outer.alias("outer"))


@query(f"""WITH k AS (SELECT DISTINCT key_tonic, key_mode, {NUMBER} AS n FROM analysis WHERE key_tonic IS NOT NULL AND key_mode IS NOT NULL)
    SELECT CAST(a.key_tonic AS INTEGER) AS a_tonic, CAST(a.key_mode AS INTEGER) AS a_mode, CAST(b.key_tonic AS INTEGER) AS b_tonic, CAST(b.key_mode AS INTEGER) AS b_mode, (a.n = b.n OR (a.key_mode = b.key_mode AND abs(a.n - b.n) IN (1, 11))) AS compatible FROM k a, k b""")
def key_compatibility(s, d):
    """Whether each two of the (at most 24) keys in use go together; the one row of all keys has no more than 24."""
    k = table(s, d, "analysis").filter("key_tonic is not null and key_mode is not null").select("key_tonic", "key_mode").distinct()
    number = keys.camelot_number(F.col("key_tonic"), catalog.is_major())
    own = k.select("key_tonic", "key_mode", number.alias("n"), (F.col("key_mode") == 1).alias("major"))
    # each key's partners are listed from the wheel: 24 rows for a key whatever the number of tracks
    others = own.groupBy().agg(F.collect_list(F.struct("key_tonic", "key_mode", "n", "major")).alias("all"))
    both = own.withColumn("one", F.lit(1)).join(others.withColumn("one", F.lit(1)), "one").select(own["key_tonic"].alias("a_tonic"), own["key_mode"].alias("a_mode"), own["n"].alias("a_n"), own["major"].alias("a_major"), F.explode("all").alias("b"))
    return both.select("a_tonic", "a_mode", F.col("b.key_tonic").alias("b_tonic"), F.col("b.key_mode").alias("b_mode"), keys.compatible(F.col("a_n"), F.col("a_major"), F.col("b.n"), F.col("b.major")).alias("compatible"))


FORMS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.WORD_FORMS.items())
LOOSE = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
MATCH = "array_to_string(list_transform(string_split(" + LOOSE + ", ' '), lambda w: CASE w " + FORMS + " ELSE w END), ' ')"


@query(f"""WITH r AS (SELECT DISTINCT title FROM release_candidates WHERE title IS NOT NULL), p AS (SELECT title, regexp_split_to_array(title, '[-–—|•]') AS a FROM r)
    SELECT title, {MATCH.format(c="title")} AS same, {LOOSE.format(c="title")} AS loose, array_to_string(list_transform(a[-1:], lambda x: {LOOSE.format(c="x")}), '') AS last_tail, CAST(len(a) AS INTEGER) AS parts,
        {LOOSE.format(c="title")} <> '' AND {LOOSE.format(c="a[1]")} <> '' AND (contains({LOOSE.format(c="title")}, {LOOSE.format(c="a[1]")}) OR contains({LOOSE.format(c="a[1]")}, {LOOSE.format(c="title")})) AS shares FROM p""")
def title_forms(s, d):
    """The forms under which titles are compared."""
    r = table(s, d, "release_candidates").filter("title is not null").select("title").distinct()
    parts = F.split("title", r"[-–—|•]")
    loose = text.norm_loose(F.col("title"))
    tail = text.norm_loose(F.try_element_at(parts, F.lit(-1)))
    return r.select("title", text.norm_match(F.col("title")).alias("same"), loose.alias("loose"), tail.alias("last_tail"), F.size(parts).alias("parts"), text.overlaps(loose, text.norm_loose(F.try_element_at(parts, F.lit(1)))).alias("shares"))
