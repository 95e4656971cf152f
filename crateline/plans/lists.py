"""Queries of lists, trees and state changes, each beside the SQL that gives the same rows.

Orders stand for playlists and their lines for members; regions, nations and suppliers for a forest of folders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality
from ..operators import catalog, duplicates, playlists, state
from ..session import table
from ..skew import union_all
from .queries import AS_OF, NUMBER, TREE, WORD, T, tracks
from .registry import query

OWN = "o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2), q AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_partkey) - 1 AS position FROM o)"
MEMBERS = ("l_orderkey", "l_partkey", "l_linenumber")


@query(f"WITH {OWN} SELECT l_orderkey, l_partkey, CAST(position AS INTEGER) AS position FROM q")
def playlist_contents(s, d):
    """The members of every list in order."""
    return playlists.positioned(table(s, d, "lineitem"), *MEMBERS)


@query(f"""WITH {OWN}, a AS (SELECT l_orderkey, l_suppkey AS l_partkey, min(l_linenumber) AS turn FROM lineitem GROUP BY 1, 2), n AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.l_orderkey = a.l_orderkey AND o.l_partkey = a.l_partkey)),
    b AS (SELECT l_orderkey, l_partkey, 0 AS part, p FROM o UNION ALL SELECT l_orderkey, l_partkey, 1, turn FROM n) SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY part, p, l_partkey) - 1 AS INTEGER) AS position FROM b""")
def playlist_added(s, d):
    """Each list with the numbers of its suppliers appended as members."""
    li = table(s, d, "lineitem")
    return playlists.added(li, *MEMBERS, li.select("l_orderkey", F.col("l_suppkey").alias("l_partkey"), F.col("l_linenumber").alias("turn")))


@query(f"""WITH {OWN}, g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_partkey) - 1 AS INTEGER) AS position FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.l_orderkey = o.l_orderkey AND g.l_partkey = o.l_partkey)""")
def playlist_removed(s, d):
    li = table(s, d, "lineitem")
    return playlists.removed(li, *MEMBERS, li.filter("l_returnflag = 'R'"))


REORDER = f"""WITH {OWN}, w AS (SELECT l_orderkey, CASE WHEN l_discount < 0.005 THEN l_partkey + 1 ELSE l_partkey END AS l_partkey, -l_linenumber AS turn FROM lineitem), a AS (SELECT l_orderkey, l_partkey, count(*) AS times, min(turn) AS turn FROM w GROUP BY 1, 2),
    j AS (SELECT coalesce(q.l_orderkey, a.l_orderkey) AS l_orderkey, q.position, a.times FROM q FULL JOIN a ON q.l_orderkey = a.l_orderkey AND q.l_partkey = a.l_partkey),
    f AS (SELECT l_orderkey, count(*) FILTER (times IS NULL) AS lacking, count(*) FILTER (position IS NULL) AS strange, count(*) FILTER (times > 1) AS repeated FROM j GROUP BY 1)"""


def _reordered(s, d):
    li = table(s, d, "lineitem")
    item = F.when(F.col("l_discount") < 0.005, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    return playlists.reordered(li, *MEMBERS, li.select("l_orderkey", item.alias("l_partkey"), (-F.col("l_linenumber")).alias("turn")))


@query(f"""{REORDER} SELECT q.l_orderkey, q.l_partkey, CAST(row_number() OVER (PARTITION BY q.l_orderkey ORDER BY CASE WHEN lacking + strange + repeated = 0 THEN a.turn ELSE q.position END, q.l_partkey) - 1 AS INTEGER) AS position
    FROM q JOIN f USING (l_orderkey) LEFT JOIN a ON a.l_orderkey = q.l_orderkey AND a.l_partkey = q.l_partkey""")
def playlist_reordered(s, d):
    """Lists turned round where the new order names just their members."""
    return _reordered(s, d)[0]


@query(f"{REORDER} SELECT * FROM f WHERE lacking + strange + repeated > 0")
def playlist_orders_refused(s, d):
    """New orders that are no permutation of the list's members, with what is wrong."""
    return _reordered(s, d)[1]


@query(f"""WITH {OWN} SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN p_size <= 10 THEN 1 WHEN position < 2 THEN 0 ELSE 2 END, position) - 1 AS INTEGER) AS position FROM q LEFT JOIN part ON p_partkey = l_partkey""")
def block_moved_before(s, d):
    """Small parts brought together before the third place."""
    small = table(s, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return playlists.block_before(table(s, d, "lineitem"), *MEMBERS, small, 2)


def forest(s, d):
    r = table(s, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("position"), F.lit(True).alias("is_folder"))
    n = table(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("position"), F.lit(True).alias("is_folder"))
    p = table(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.col("s_suppkey").alias("position"), F.lit(False).alias("is_folder"))
    return r.unionByName(n).unionByName(p)


@query("""WITH n AS (SELECT CAST(NULL AS VARCHAR) AS parent, r_regionkey AS position FROM region UNION ALL SELECT 'R' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'N' || s_nationkey, s_suppkey FROM supplier), p AS (SELECT NULL AS parent UNION SELECT 'R' || r_regionkey FROM region UNION SELECT 'N' || n_nationkey FROM nation UNION SELECT 'S' || s_suppkey FROM supplier)
    SELECT p.parent, CAST(coalesce(max(position) + 1, 0) AS INTEGER) AS next FROM p LEFT JOIN n ON n.parent IS NOT DISTINCT FROM p.parent GROUP BY p.parent""")
def next_sibling_places(s, d):
    f = forest(s, d)
    return playlists.next_places(f, f.select(F.col("id").alias("parent")).unionByName(f.select("parent").filter("parent is null").limit(1)))


UP = f"{TREE}, u AS (SELECT id, parent AS ancestor FROM n WHERE parent IS NOT NULL UNION ALL SELECT u.id, n.parent FROM u JOIN n ON n.id = u.ancestor WHERE n.parent IS NOT NULL)"


@query(f"""WITH RECURSIVE {UP}, m AS (SELECT id, parent AS target FROM n WHERE id LIKE 'S%' UNION ALL SELECT parent, id FROM n WHERE parent IS NOT NULL UNION ALL SELECT id, id FROM n WHERE id LIKE 'N%' UNION ALL SELECT id, NULL FROM n WHERE id LIKE 'N%' UNION ALL SELECT id || 'x', parent FROM n WHERE id LIKE 'N%' UNION ALL SELECT id, parent || 'x' FROM n WHERE id LIKE 'N%')
    SELECT m.id, m.target, CASE WHEN k.id IS NULL THEN 'unknown' WHEN m.target IS NULL THEN 'ok' WHEN m.id = m.target THEN 'self' WHEN t.id IS NULL THEN 'unknown' WHEN t.id LIKE 'S%' THEN 'no folder' WHEN u.id IS NOT NULL THEN 'cycle' ELSE 'ok' END AS verdict
    FROM m LEFT JOIN n k ON k.id = m.id LEFT JOIN n t ON t.id = m.target LEFT JOIN u ON u.id = m.target AND u.ancestor = m.id""")
def playlist_moves(s, d):
    """Moves within the forest, sound and unsound, with what is wrong."""
    f = forest(s, d)
    n = f.filter("id like 'N%'")
    pick = lambda df, a, b: df.select(a.alias("id"), b.alias("target"))
    i, p, x = F.col("id"), F.col("parent"), F.lit("x")
    moves = pick(f.filter("id like 'S%'"), i, p).unionByName(pick(f.filter("parent is not null"), p, i)).unionByName(pick(n, i, i)).unionByName(pick(n, i, F.lit(None).cast("string"))).unionByName(pick(n, F.concat(i, x), p)).unionByName(pick(n, i, F.concat(p, x)))
    return playlists.move_checks(f, moves)


@query(f"""WITH RECURSIVE {UP} SELECT id FROM n WHERE id NOT IN ('N3', 'R1') AND id NOT IN (SELECT id FROM u WHERE ancestor IN ('N3', 'R1'))""")
def playlist_deleted(s, d):
    """The forest without two folders and all below them."""
    f = forest(s, d)
    return playlists.without_nodes(f, f.filter("id in ('N3', 'R1')").select("id")).select("id")


@query(f"""WITH RECURSIVE {UP} SELECT n.id, CAST((SELECT count(*) FROM u WHERE u.id = n.id) AS INTEGER) AS depth, (SELECT count(*) FROM u WHERE u.ancestor = n.id AND u.id NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)) AS leaves FROM n""")
def tree_leaf_counts(s, d):
    return playlists.leaf_counts(forest(s, d))


@query("""WITH f AS (SELECT lower(p_brand || '/' || p_name) AS k, min(p_partkey) AS file_id FROM part WHERE p_size > 10 GROUP BY 1), e AS (SELECT l_orderkey, l_linenumber, lower(p_brand || '/' || p_name) AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 20)
    SELECT o_orderkey AS playlist_id, l_linenumber AS position, file_id FROM orders LEFT JOIN (SELECT * FROM e JOIN f USING (k)) x ON x.l_orderkey = o_orderkey""")
def device_playlists(s, d):
    """A device's lists resolved to scanned files by their paths."""
    part = table(s, d, "part")
    path = F.concat("p_brand", F.lit("/"), "p_name")
    entries = table(s, d, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("playlist_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("track_id"))
    files = part.filter("p_size > 10").select(F.col("p_partkey").alias("file_id"), F.upper(path).alias("path"))
    return playlists.resolved(table(s, d, "orders").select(F.col("o_orderkey").alias("playlist_id")), entries, part.select(F.col("p_partkey").alias("track_id"), path.alias("path")), files)


# -- state ------------------------------------------------------------------------------------------------------------

OLD, NEW = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(src_mtime, -4611686018427387904) {w}, coalesce(discogs_meta_fetched_at, -4611686018427387904) {w}, coalesce(src_size, -4611686018427387904) {w}) AS rn FROM tracks WHERE id IS NOT NULL) WHERE rn = 1" for w in ("ASC", "DESC"))
MERGED = f"""{T}, st AS (SELECT id, CASE WHEN user_edited THEN '/gone/' || id ELSE source_path END AS path, fingerprint, user_edited, discogs_meta_fetched_at AS fetched_at, album, genre, year, duration_ms, NOT user_edited AS on_disk FROM t WHERE has_cover AND source_path IS NOT NULL),
    sc AS (SELECT source_path AS path, min(fingerprint) AS fingerprint, min(album) AS album, min(genre) AS genre, min(year) AS year, max(duration_ms) + 1 AS duration_ms FROM t WHERE source_path IS NOT NULL GROUP BY 1),
    bp AS (SELECT sc.*, st.id AS by_path FROM sc LEFT JOIN st ON st.path = sc.path), orp AS (SELECT fingerprint, min(id) AS orphan FROM st WHERE NOT on_disk AND fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
    mv AS (SELECT orphan, min(path) AS path FROM bp JOIN orp USING (fingerprint) WHERE by_path IS NULL GROUP BY 1), m AS (SELECT bp.*, orphan, coalesce(by_path, orphan) AS id, CASE WHEN by_path IS NOT NULL THEN 'updated' WHEN orphan IS NOT NULL THEN 'moved' ELSE 'added' END AS status FROM bp LEFT JOIN mv ON mv.path = bp.path),
    merged AS (SELECT coalesce(m.id, st.id) AS id, coalesce(m.path, st.path) AS path, CASE WHEN status IS NOT NULL AND NOT coalesce(user_edited, false) THEN m.album ELSE st.album END AS album, CASE WHEN status IS NOT NULL AND NOT coalesce(user_edited, false) THEN m.genre ELSE st.genre END AS genre,
        CASE WHEN status IS NOT NULL AND NOT coalesce(user_edited, false) THEN m.year ELSE st.year END AS year, CASE WHEN status IS NOT NULL THEN m.duration_ms ELSE st.duration_ms END AS duration_ms, coalesce(user_edited, false) AS user_edited,
        CASE WHEN status = 'added' THEN CASE WHEN trim(m.album) <> '' AND trim(m.genre) <> '' AND m.year IS NOT NULL THEN {AS_OF} END ELSE fetched_at END AS fetched_at, coalesce(status, 'kept') AS status FROM m FULL JOIN st ON st.id = m.id)"""


def _merged(s, d):
    t = catalog.latest(tracks(s, d), "source_path", "fingerprint", "user_edited", "discogs_meta_fetched_at", "album", "genre", "year", "duration_ms", "has_cover").filter("source_path is not null")
    # tracks with a cover are stored; edited ones have lost their file, which the scan finds under another path
    path = F.when(F.col("user_edited"), F.concat(F.lit("/gone/"), F.col("id").cast("string"))).otherwise(F.col("source_path"))
    stored = t.filter("has_cover").select("id", path.alias("path"), "fingerprint", "user_edited", F.col("discogs_meta_fetched_at").alias("fetched_at"), "album", "genre", "year", "duration_ms", (~F.col("user_edited")).alias("on_disk"))
    scanned = t.groupBy(F.col("source_path").alias("path")).agg(*[F.min(c).alias(c) for c in ("fingerprint", "album", "genre", "year")], (F.max("duration_ms") + 1).alias("duration_ms"))
    return state.scan_by_path(stored, scanned, ["album", "genre", "year"], ["duration_ms"], AS_OF)


@query(f"WITH {MERGED} SELECT * FROM merged")
def scan_merged_by_path(s, d):
    """A scan of the whole library merged by path, then by the fingerprints of files that are gone."""
    return _merged(s, d)


@query(f"WITH {MERGED} SELECT status, count(*) AS n FROM merged GROUP BY 1 UNION ALL SELECT 'failed', count(*) FROM tracks WHERE source_path IS NULL HAVING count(*) > 0")
def scan_tally(s, d):
    """How many files were added, updated, moved, kept and unreadable (without a path)."""
    return state.tallied(_merged(s, d), tracks(s, d).filter("source_path is null").select(F.col("source_path").alias("path"), F.lit("no path").alias("error")))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT n.id, n.source_path FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source_path = n.source_path AND o.src_size = n.src_size AND o.src_mtime = n.src_mtime) AND n.source_path IS NOT NULL")
def incremental_scan(s, d):
    """Files of the newest scan whose size or time differs from the oldest one's: only these are read again."""
    from ..sources.files import changed

    least = F.lit(catalog.LOWEST)
    order = F.struct(*[F.coalesce(c, least) for c in ("src_mtime", "discogs_meta_fetched_at", "src_size")])
    t = tracks(s, d).filter("id is not null").withColumn("scan", order).withColumn("row", F.struct("source_path", "src_size", "src_mtime"))
    both = t.groupBy("id").agg(F.min_by("row", "scan").alias("o"), F.max_by("row", "scan").alias("n"))
    stored = both.select(F.col("o.source_path").alias("path"), "o.src_size", "o.src_mtime")
    listed = both.select("id", F.col("n.source_path").alias("path"), F.col("n.src_size").alias("length"), F.col("n.src_mtime").alias("mtime")).filter("path is not null")
    return changed(stored, listed).select("id", F.col("path").alias("source_path"))


@query(f"""WITH {T}, c AS (SELECT track_id AS id, min(fmt) AS genre FROM copies WHERE marked_delete AND track_id IS NOT NULL GROUP BY 1), x AS (SELECT DISTINCT track_id AS id FROM analysis WHERE analyzer_version < 20 AND track_id IS NOT NULL)
    SELECT t.id, CASE WHEN c.id IS NOT NULL THEN c.genre ELSE t.genre END AS genre, CASE WHEN t.id IN (SELECT id FROM x) THEN false ELSE c.id IS NOT NULL OR coalesce(user_edited, false) END AS user_edited FROM t LEFT JOIN c ON c.id = t.id""")
def tag_edits(s, d):
    """Tags typed by a user, then the mark of editing taken back for some."""
    typed = table(s, d, "copies").filter("marked_delete and track_id is not null").groupBy(F.col("track_id").alias("id")).agg(F.min("fmt").alias("genre"))
    undone = table(s, d, "analysis").filter("analyzer_version < 20 and track_id is not null").select(F.col("track_id").alias("id"))
    return state.edits_cleared(state.tags_updated(catalog.latest(tracks(s, d), "genre", "user_edited"), typed, ["genre"]), undone)


@query("""WITH b AS (SELECT track_id, bpm, beat_offset_ms, first_beat_number, coalesce(grid_edited, false) AS e, peak > 0.9 AS hand, loudness < -12 AS undo FROM analysis WHERE track_id IS NOT NULL),
    g AS (SELECT track_id, CASE WHEN hand THEN 128.0::DOUBLE ELSE bpm END AS bpm, CASE WHEN hand THEN 280 ELSE beat_offset_ms END AS beat_offset_ms, CASE WHEN hand THEN 3 ELSE first_beat_number END AS first_beat_number,
        CASE WHEN hand AND NOT e THEN bpm END AS auto_bpm, CASE WHEN hand AND NOT e THEN beat_offset_ms END AS auto_beat_offset_ms, CASE WHEN hand AND NOT e THEN first_beat_number END AS auto_first_beat_number, e OR coalesce(hand, false) AS grid_edited, coalesce(undo, false) AS undo FROM b)
    SELECT track_id, CASE WHEN undo AND grid_edited THEN coalesce(auto_bpm, bpm) ELSE bpm END AS bpm, CASE WHEN undo AND grid_edited THEN auto_beat_offset_ms ELSE beat_offset_ms END AS beat_offset_ms, CASE WHEN undo AND grid_edited THEN auto_first_beat_number ELSE first_beat_number END AS first_beat_number,
        CASE WHEN NOT (undo AND grid_edited) THEN auto_bpm END AS auto_bpm, CASE WHEN NOT (undo AND grid_edited) THEN auto_beat_offset_ms END AS auto_beat_offset_ms, CASE WHEN NOT (undo AND grid_edited) THEN auto_first_beat_number END AS auto_first_beat_number, grid_edited AND NOT undo AS grid_edited, undo AND grid_edited AS was_reset FROM g""")
def grids_set_and_reset(s, d):
    """Grids set by hand, the detected ones kept aside; some brought back."""
    a = table(s, d, "analysis").filter("track_id is not null")
    none = {"auto_bpm": "double", "auto_beat_offset_ms": "bigint", "auto_first_beat_number": "int"}
    for c, kind in none.items():
        a = a.withColumn(c, F.lit(None).cast(kind))
    manual = a.filter("peak > 0.9").select("track_id", F.lit(128.0).alias("bpm"), F.lit(280).cast("bigint").alias("beat_offset_ms"), F.lit(3).alias("first_beat_number"))
    return state.grid_reset(state.grid_set(a, manual), a.filter("loudness < -12").select("track_id"))


@query(f"""WITH {T}, w AS (SELECT track_id AS id, '/media/new/' || track_id AS new_path FROM copies WHERE track_id IS NOT NULL UNION SELECT -id, source_path FROM t WHERE user_edited AND source_path IS NOT NULL UNION SELECT id, source_path FROM t WHERE has_cover AND source_path IS NOT NULL UNION SELECT id, '/media/new/-' || id FROM (SELECT -id AS id FROM t WHERE user_edited))
    SELECT w.id, new_path, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.source_path = w.new_path AND t.id <> w.id) THEN 'taken' WHEN w.id NOT IN (SELECT id FROM t) THEN 'unknown' ELSE 'ok' END AS verdict FROM w""")
def source_relinks(s, d):
    """New files for tracks: sound, taken by another track, or for an unknown one."""
    t = catalog.latest(tracks(s, d), "source_path", "user_edited", "has_cover")
    new = lambda df, i: df.select(i.alias("id"), F.concat(F.lit("/media/new/"), i.cast("string")).alias("new_path"))
    edited = t.filter("user_edited")
    odd = edited.select((-F.col("id")).alias("id"))
    wanted = new(table(s, d, "copies").filter("track_id is not null"), F.col("track_id"))
    wanted = wanted.unionByName(edited.filter("source_path is not null").select((-F.col("id")).alias("id"), F.col("source_path").alias("new_path"))).unionByName(t.filter("has_cover and source_path is not null").select("id", F.col("source_path").alias("new_path")))
    wanted = wanted.unionByName(odd.select("id", F.concat(F.lit("/media/new/-"), F.col("id").cast("string")).alias("new_path")))
    return state.source_relinks(t.select("id", F.col("source_path").alias("path")), wanted.distinct())


@query(f"""WITH {T}, g AS (SELECT id FROM t WHERE user_edited) SELECT 'tracks' AS "table", count(*) AS n FROM t WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'analysis', count(*) FROM analysis WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = track_id) UNION ALL SELECT 'copies', count(*) FROM copies WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = track_id)""")
def delete_cascade(s, d):
    """What is left of each table when the edited tracks are deleted."""
    t = catalog.latest(tracks(s, d), "user_edited")
    left = state.deleted({"tracks": (t, "id"), "analysis": (table(s, d, "analysis"), "track_id"), "copies": (table(s, d, "copies"), "track_id")}, t.filter("user_edited"))
    return union_all([rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, rows in left.items()])


# -- groups of copies and counts --------------------------------------------------------------------------------------


@query(f"""WITH {T}, r AS (SELECT DISTINCT group_key, track_id, {WORD} AS clean, CASE WHEN t.format IN ('flac', 'wav', 'aiff') THEN 1 ELSE 0 END AS lossless, coalesce(bitrate_kbps, 0) AS rate FROM copies c JOIN t ON t.id = c.track_id),
    b AS (SELECT group_key, arg_max(track_id, clean * 100000000000000000 + lossless * 10000000000000000 + CAST(rate AS BIGINT) * 100000000 + track_id) AS best_id FROM r GROUP BY group_key)
    SELECT DISTINCT r.group_key, track_id, CASE WHEN track_id = best_id THEN 'keep' ELSE 'delete' END AS proposal FROM r JOIN b USING (group_key)""")
def copy_proposals(s, d):
    """Which copy of each group to keep, and which to delete."""
    c = table(s, d, "copies").select("group_key", "track_id", F.coalesce(~quality.verdict_is_transcode("quality"), F.lit(True)).alias("clean")).distinct()
    t = catalog.latest(tracks(s, d), "format", "bitrate_kbps")
    return duplicates.proposals(c.join(t, c["track_id"] == t["id"]))


@query("""SELECT kind, count(DISTINCT group_key) AS groups, count(DISTINCT track_id) AS members, count(DISTINCT CASE WHEN quality IS NULL THEN track_id END) AS not_analysed FROM copies WHERE group_key IS NOT NULL AND track_id IS NOT NULL GROUP BY kind""")
def group_overview(s, d):
    """Groups, members and members without an analysis of each kind."""
    c = table(s, d, "copies").filter("group_key is not null and track_id is not null")
    one = c.groupBy("kind", "group_key", "track_id").agg(F.max(F.col("quality").isNull().cast("int")).alias("open"))
    by_track = one.groupBy("kind", "track_id").agg(F.max("open").alias("open"))
    counts = by_track.groupBy("kind").agg(F.count(F.lit(1)).alias("members"), F.sum("open").alias("not_analysed"))
    return one.select("kind", "group_key").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("groups")).join(counts, "kind")


@query(f"""WITH {T} SELECT 'tracks' AS what, count(*) AS n FROM t UNION ALL SELECT 'edited', count(*) FROM t WHERE user_edited UNION ALL SELECT 'inbox', count(*) FROM t WHERE {AS_OF} - added_at < 31536000 AND (discogs_meta_fetched_at IS NULL OR NOT EXISTS (SELECT 1 FROM analysis a WHERE a.track_id = t.id AND a.analyzer_version >= 20))
    UNION ALL SELECT 'not analysed', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.track_id = t.id) UNION ALL SELECT 'records', count(DISTINCT release_id) FROM release_candidates UNION ALL SELECT 'documents', count(DISTINCT release_id) FROM release_json""")
def library_counts(s, d):
    t = catalog.latest(tracks(s, d), "user_edited")
    open_ = catalog.without(t.select("id"), table(s, d, "analysis").select(F.col("track_id").alias("id")), "id")
    counted = {"tracks": t, "edited": t.filter("user_edited"), "inbox": catalog.inbox(tracks(s, d), table(s, d, "analysis"), AS_OF, window_s=31_536_000), "not analysed": open_, "records": table(s, d, "release_candidates").filter("release_id is not null").select("release_id").distinct(), "documents": table(s, d, "release_json").filter("release_id is not null").select("release_id").distinct()}
    return union_all([rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, rows in counted.items()])


LABEL = "CASE WHEN regexp_matches(k, '^(1[0-2]|[1-9])[ABab]$') THEN CAST(regexp_extract(k, '^(\\d+)', 1) AS INTEGER) END AS n, upper(right(k, 1)) = 'B' AS side"


@query(f"""WITH {T}, g AS (SELECT t.id, trim(initial_key_tag) AS k, {NUMBER} AS dn, key_mode = 1 AS ds, a.bpm, bpm_tag FROM t JOIN analysis a ON a.track_id = t.id), p AS (SELECT *, {LABEL} FROM g)
    SELECT CASE WHEN n IS NULL OR dn IS NULL THEN 'unknown' WHEN n = dn AND side = ds THEN 'exact' WHEN n = dn THEN 'relative' WHEN side = ds AND abs(n - dn) IN (1, 11) THEN 'adjacent' ELSE 'other' END AS key_grade,
        CASE WHEN bpm IS NULL OR bpm_tag IS NULL THEN 'unknown' WHEN abs(bpm - bpm_tag) <= 2 THEN 'ok' WHEN abs(bpm * 2 - bpm_tag) <= 2 OR abs(bpm / 2 - bpm_tag) <= 2 THEN 'octave' ELSE 'miss' END AS tempo_grade, count(*) AS n FROM p GROUP BY 1, 2""")
def grading(s, d):
    """Detected keys and tempi against the tags: how many are exact, near or wrong."""
    return catalog.grades(catalog.latest(tracks(s, d), "initial_key_tag", "bpm_tag"), table(s, d, "analysis"))
