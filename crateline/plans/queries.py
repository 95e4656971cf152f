"""The catalogue queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, quality, text
from ..operators import catalog, duplicates, linkage, playlists, series, state
from ..session import table
from .registry import query

AS_OF = 1_686_000_000
# The newest scan of each track, as SQL.
T = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(src_mtime, -4611686018427387904) DESC, coalesce(discogs_meta_fetched_at, -4611686018427387904) DESC, coalesce(src_size, -4611686018427387904) DESC) AS rn FROM tracks WHERE id IS NOT NULL) WHERE rn = 1)"
NUMBER = "((((CASE WHEN key_mode = 1 THEN key_tonic ELSE key_tonic + 3 END) * 7 + 7) % 12) + 1)"
VERDICT = "CASE WHEN lowpass_hz IS NULL THEN 'clean' WHEN lowpass_edge IS NULL OR lowpass_edge < 25 THEN 'inconclusive' WHEN lowpass_hz >= 20000 THEN 'suspect' ELSE 'likely_lossy' END"
SEVERITY = "CASE {v} WHEN 'clean' THEN 0 WHEN 'inconclusive' THEN 1 WHEN 'suspect' THEN 2 ELSE 3 END"


def tracks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "tracks")


@query(f"""WITH {T} SELECT t.id, t.title, t.artist, t.album,
    CAST(coalesce(duration_ms, 0) // 1000 // 60 AS VARCHAR) || ':' || lpad(CAST((coalesce(duration_ms, 0) // 1000) % 60 AS VARCHAR), 2, '0') AS length, round(bpm, 1) AS bpm,
    CAST({NUMBER} AS VARCHAR) || CASE WHEN key_mode = 1 THEN 'B' ELSE 'A' END AS camelot, CAST({NUMBER} * 2 + CASE WHEN key_mode = 1 THEN 1 ELSE 0 END AS INTEGER) AS key_order,
    CASE WHEN analyzer_version >= 6 THEN {VERDICT} END AS quality, CASE WHEN analyzer_version >= 6 THEN {SEVERITY.format(v=VERDICT)} END AS quality_order
    FROM t LEFT JOIN analysis a ON a.track_id = t.id""")
def library_view(s, d):
    return catalog.library_view(tracks(s, d), table(s, d, "analysis"))


@query(f"""WITH {T} SELECT id FROM t WHERE
    (lower(coalesce(artist,'')) LIKE '%remix%' OR lower(coalesce(title,'')) LIKE '%remix%' OR lower(coalesce(album,'')) LIKE '%remix%' OR lower(coalesce(genre,'')) LIKE '%remix%' OR lower(coalesce(album_artist,'')) LIKE '%remix%')
    AND (lower(coalesce(artist,'')) LIKE '%house%' OR lower(coalesce(title,'')) LIKE '%house%' OR lower(coalesce(album,'')) LIKE '%house%' OR lower(coalesce(genre,'')) LIKE '%house%' OR lower(coalesce(album_artist,'')) LIKE '%house%')""")
def search_multi_term(s, d):
    return catalog.latest(tracks(s, d), *catalog.SEARCHED).filter(text.search(catalog.SEARCHED, "Remix HOUSE")).select("id")


@query(f"""WITH {T} SELECT id, artist, genre FROM t WHERE (lower(coalesce(genre,'')) LIKE '%dub%' OR lower(coalesce(genre,'')) LIKE '%jazz%') AND lower(coalesce(artist,'')) = 'orrin taveskard'""")
def column_filter_or_exact(s, d):
    t = catalog.latest(tracks(s, d), "artist", "genre")
    return t.filter(text.cell_filter(F.col("genre"), "dub, jazz,") & text.cell_filter(F.col("artist"), '"Orrin Taveskard"')).select("id", "artist", "genre")


@query("""WITH o AS (SELECT track_id, bpm, row_number() OVER (ORDER BY bpm DESC NULLS FIRST, track_id) AS by_bpm, row_number() OVER (ORDER BY lowpass_hz ASC NULLS FIRST, track_id) AS by_cut FROM analysis WHERE track_id IS NOT NULL)
    SELECT track_id, CAST(by_bpm AS INTEGER) AS place FROM (SELECT * FROM o ORDER BY by_bpm LIMIT 100)""")
def sort_null_rules_topk(s, d):
    a = table(s, d, "analysis").filter("track_id is not null").select("track_id", "bpm").orderBy(F.col("bpm").desc_nulls_first(), "track_id").limit(100)
    # the limit is the feature; only the hundred rows are numbered
    return a.select("track_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("bpm").desc_nulls_first(), "track_id")).alias("place"))


@query(f"""WITH {T}, w AS (SELECT DISTINCT track_id FROM copies WHERE kind = 'identical') SELECT t.id, t.source_path FROM t JOIN w ON t.id = w.track_id""")
def point_and_id_list(s, d):
    wanted = table(s, d, "copies").filter("kind = 'identical'").select(F.col("track_id").alias("id")).distinct()
    return catalog.latest(tracks(s, d), "source_path").join(wanted, "id", "left_semi")


@query(f"""WITH {T} SELECT id, added_at FROM t WHERE {AS_OF} - added_at < 31536000 AND (discogs_meta_fetched_at IS NULL OR NOT EXISTS (SELECT 1 FROM analysis a WHERE a.track_id = t.id AND a.analyzer_version >= 20))""")
def recent_inbox(s, d):
    return catalog.inbox(tracks(s, d), table(s, d, "analysis"), AS_OF, window_s=31_536_000)


@query(f"""WITH {T} SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM analysis a WHERE a.track_id = t.id)""")
def missing_rows(s, d):
    return catalog.without(catalog.latest(tracks(s, d), "source_path").select("id"), table(s, d, "analysis").select(F.col("track_id").alias("id")), "id")


@query(f"""WITH {T} SELECT * FROM (SELECT t.id, CASE WHEN a.analyzer_version IS NULL THEN 'none' WHEN a.analyzer_version <> 20 THEN 'version' WHEN NOT coalesce(a.src_size = t.src_size AND a.src_mtime = t.src_mtime, false) THEN 'file' END AS reason
    FROM t LEFT JOIN analysis a ON a.track_id = t.id) WHERE reason IS NOT NULL""")
def needs_analysis(s, d):
    return catalog.needs_analysis(tracks(s, d), table(s, d, "analysis"))


@query(f"""WITH {T} SELECT id, CASE WHEN discogs_meta_fetched_at IS NULL THEN 'never' ELSE 'old' END AS why FROM t WHERE discogs_meta_fetched_at IS NULL OR {AS_OF} - discogs_meta_fetched_at > 2592000""")
def stale_refresh_queue(s, d):
    t = catalog.latest(tracks(s, d), "discogs_meta_fetched_at")
    at = F.col("discogs_meta_fetched_at")
    return t.filter(at.isNull() | (F.lit(AS_OF) - at > 2_592_000)).select("id", F.when(at.isNull(), "never").otherwise("old").alias("why"))


@query(f"""WITH {T} SELECT id, has_cover OR EXISTS (SELECT 1 FROM copies c WHERE c.track_id = t.id AND c.is_best) AS flag FROM t""")
def existence_flag(s, d):
    best = table(s, d, "copies").filter("is_best").select(F.col("track_id").alias("id"), F.lit(True).alias("b")).distinct()
    return catalog.latest(tracks(s, d), "has_cover").join(best, "id", "left").select("id", (F.col("has_cover") | F.coalesce("b", F.lit(False))).alias("flag"))


@query(f"""WITH {T} SELECT lower(trim(album)) AS album_key, lower(coalesce(nullif(trim(album_artist), ''), artist, '')) AS artist_key, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM t WHERE trim(album) <> '' GROUP BY 1, 2 HAVING count(*) >= 2""")
def album_siblings(s, d):
    return catalog.siblings(tracks(s, d))


@query(f"""WITH {T}, g AS (SELECT *, lower(trim(album)) AS k, lower(coalesce(nullif(trim(album_artist), ''), artist, '')) AS a FROM t WHERE trim(album) <> '')
    SELECT g.id FROM g WHERE NOT has_cover AND EXISTS (SELECT 1 FROM g o WHERE o.k = g.k AND o.a = g.a AND o.has_cover)""")
def siblings_missing_cover(s, d):
    t = catalog.latest(tracks(s, d), "album", "album_artist", "artist", "has_cover").filter(F.trim("album") != "").withColumn("k", catalog.album_key()).withColumn("a", catalog.album_artist_key())
    covered = t.filter("has_cover").select("k", "a").distinct()
    return t.filter("not has_cover").join(covered, ["k", "a"], "left_semi").select("id")


@query("""WITH o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, p * 100000000 + l_partkey) AS head, arg_max(l_partkey, p * 100000000 + l_partkey) AS tail FROM o GROUP BY 1""")
def playlist_members(s, d):
    return playlists.members(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber")


@query("""SELECT o_orderkey, CAST(coalesce(max(l_linenumber) + 1, 0) AS INTEGER) AS next_position FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def next_position(s, d):
    last = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("m"))
    return table(s, d, "orders").select("o_orderkey").join(last, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.col("m") + 1, F.lit(0)).alias("next_position"))


IDENTICAL = "SELECT 'identical' AS kind, 'identical' || chr(31) || fingerprint AS group_key, count(*) AS n, min(id) AS first_id FROM t WHERE trim(fingerprint) <> '' GROUP BY fingerprint HAVING count(*) >= 2"
SAME = """SELECT 'sametrack' AS kind, 'sametrack' || chr(31) || lower(trim(artist)) || chr(31) || lower(trim(title)) AS group_key, count(*) AS n, min(id) AS first_id FROM t WHERE trim(artist) <> '' AND trim(title) <> ''
    GROUP BY lower(trim(artist)), lower(trim(title)) HAVING count(*) >= 2 AND NOT (count(nullif(trim(fingerprint), '')) = count(*) AND count(DISTINCT fingerprint) = 1)"""


@query(f"WITH {T} {IDENTICAL}")
def identical_groups(s, d):
    return duplicates.identical_groups(catalog.latest(tracks(s, d), "fingerprint"))


@query(f"WITH {T} {SAME}")
def same_key_groups(s, d):
    return duplicates.same_track_groups(catalog.latest(tracks(s, d), "fingerprint", "artist", "title"))


@query(f"WITH {T}, g AS ({IDENTICAL} UNION ALL {SAME}) SELECT * FROM g WHERE group_key NOT IN (SELECT 'identical' || chr(31) || fingerprint FROM tracks WHERE user_edited AND fingerprint IS NOT NULL)")
def duplicate_report(s, d):
    ignored = tracks(s, d).filter("user_edited and fingerprint is not null").select(F.concat(F.lit("identical\x1f"), F.col("fingerprint")).alias("group_key"))
    return duplicates.report(catalog.latest(tracks(s, d), "fingerprint", "artist", "title"), ignored)


@query(f"WITH {T}, g AS ({IDENTICAL} UNION ALL {SAME}) SELECT kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members FROM g GROUP BY kind")
def group_kind_counts(s, d):
    t = catalog.latest(tracks(s, d), "fingerprint", "artist", "title")
    return duplicates.identical_groups(t).unionByName(duplicates.same_track_groups(t)).groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"))


@query(f"""WITH {T}, b AS (SELECT id, lower(trim(album)) AS k, coalesce(duration_ms, 0) AS v FROM t WHERE trim(album) <> '')
    SELECT id, n - 1 AS partners FROM (SELECT id, count(*) OVER (PARTITION BY k ORDER BY v RANGE BETWEEN 15000 PRECEDING AND 15000 FOLLOWING) AS n FROM b) WHERE n > 1""")
def band_join_partners(s, d):
    t = catalog.latest(tracks(s, d), "album", "duration_ms").filter(F.trim("album") != "").withColumn("k", catalog.album_key())
    return duplicates.band_partners(t, "id", "duration_ms", ["k"], 15_000)


@query(f"""WITH {T}, b AS (SELECT id, coalesce(duration_ms, 0) AS v FROM t)
    SELECT id, n - 1 AS partners FROM (SELECT id, count(*) OVER (ORDER BY v RANGE BETWEEN 15000 PRECEDING AND 15000 FOLLOWING) AS n FROM b) WHERE n > 1""")
def duration_band_partners(s, d):
    return duplicates.band_partners_all(catalog.latest(tracks(s, d), "duration_ms"), "id", "duration_ms", 15_000)


SIGNS = "s AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM embeddings)"
NEAR = f"{SIGNS}, e AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS INTEGER) AS errors FROM s a JOIN s b ON a.vec_id < b.vec_id)"


def signatures(s, d):
    return table(s, d, "embeddings").select("vec_id", duplicates.bits_of_signs(F.col("embedding")).alias("bits"))


@query(f"WITH {NEAR} SELECT * FROM e WHERE errors <= 16")
def bit_error_pairs(s, d):
    return duplicates.near_signatures(signatures(s, d), "vec_id", 16)


@query(f"""WITH RECURSIVE {NEAR}, l AS (SELECT a, b FROM e WHERE errors <= 16 UNION SELECT b, a FROM e WHERE errors <= 16),
    r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id) SELECT id, min(root) AS component FROM r GROUP BY id""")
def similar_components(s, d):
    return duplicates.components(duplicates.near_signatures(signatures(s, d), "vec_id", 16).select("a", "b"))


@query(f"""WITH RECURSIVE {T}, {NEAR}, p AS (SELECT a, b FROM e JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE errors <= 11 AND abs(coalesce(x.duration_ms, 0) - coalesce(y.duration_ms, 0)) <= 15000), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(root) AS component FROM r GROUP BY id),
    k AS (SELECT component, id, nullif(trim(fingerprint), '') AS fp, CASE WHEN trim(artist) <> '' AND trim(title) <> '' THEN lower(trim(artist)) || chr(31) || lower(trim(title)) END AS song FROM m JOIN t USING (id)),
    g AS ({IDENTICAL} UNION ALL {SAME} UNION ALL SELECT 'acoustic', 'acoustic' || chr(31) || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), count(*), min(id) FROM k GROUP BY component
        HAVING count(*) >= 2 AND NOT (count(fp) = count(*) AND count(DISTINCT fp) = 1) AND NOT (count(song) = count(*) AND count(DISTINCT song) = 1))
    SELECT * FROM g WHERE group_key NOT IN (SELECT 'identical' || chr(31) || fingerprint FROM tracks WHERE user_edited AND fingerprint IS NOT NULL)""")
def duplicate_report_acoustic(s, d):
    """All three kinds; the vectors' signs stand for the signatures of the tracks of their numbers."""
    ignored = tracks(s, d).filter("user_edited and fingerprint is not null").select(F.concat(F.lit("identical\x1f"), F.col("fingerprint")).alias("group_key"))
    return duplicates.report(catalog.latest(tracks(s, d), "fingerprint", "artist", "title", "duration_ms"), ignored, signatures(s, d).withColumnRenamed("vec_id", "id"))


WORD = "CASE regexp_replace(lower(coalesce(quality, '')), '[^a-z]', '', 'g') WHEN 'suspect' THEN 0 WHEN 'likelylossy' THEN 0 ELSE 1 END"


@query(f"""WITH {T}, r AS (SELECT DISTINCT group_key, track_id, {WORD} AS clean, CASE WHEN t.format IN ('flac', 'wav', 'aiff') THEN 1 ELSE 0 END AS lossless, coalesce(bitrate_kbps, 0) AS rate FROM copies c JOIN t ON t.id = c.track_id)
    SELECT group_key, arg_max(track_id, clean * 100000000000000000 + lossless * 10000000000000000 + CAST(rate AS BIGINT) * 100000000 + track_id) AS best_id, count(*) AS n FROM r GROUP BY group_key""")
def best_copy(s, d):
    c = table(s, d, "copies").select("group_key", "track_id", F.coalesce(~quality.verdict_is_transcode("quality"), F.lit(True)).alias("clean")).distinct()
    t = catalog.latest(tracks(s, d), "format", "bitrate_kbps")
    j = c.join(t, c["track_id"] == t["id"])
    return j.groupBy("group_key").agg(F.max_by("track_id", quality.copy_rank(F.col("clean"), F.col("format"), F.col("bitrate_kbps"), F.col("track_id"))).alias("best_id"), F.count(F.lit(1)).alias("n"))


LOOSE = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


LINKED = f"""WITH r AS (SELECT DISTINCT release_id, {LOOSE.format(c="title")} AS k FROM release_candidates WHERE trim(title) <> ''), c AS (SELECT DISTINCT release_id, {LOOSE.format(c="label")} AS k FROM release_json j JOIN (SELECT DISTINCT release_id, title AS label FROM release_candidates) USING (release_id)),
    x AS (SELECT DISTINCT r.release_id AS record_id, c.release_id AS row_id FROM r JOIN c ON TRY_CAST(trim(r.release_id) AS BIGINT) = TRY_CAST(trim(c.release_id) AS BIGINT))
    SELECT record_id, row_id, 'id' AS how FROM x UNION ALL SELECT DISTINCT r.release_id, c.release_id, 'text' FROM r JOIN c ON r.k = c.k WHERE r.k <> '' AND r.release_id NOT IN (SELECT record_id FROM x)"""


@query(LINKED)
def linkage_all_documents(s, d):
    """Candidates linked to every release document: by id, those without a document of their own by text."""
    cand = table(s, d, "release_candidates").select("release_id", "title").distinct()
    records = cand.filter(F.trim("title") != "").select(F.col("release_id").alias("id"), text.norm_loose(F.col("title")).alias("text")).distinct()
    docs = table(s, d, "release_json").select("release_id").distinct().join(cand, "release_id")
    return linkage.exact_then_fallback(records, docs.select(F.col("release_id").alias("id"), text.norm_loose(F.col("title")).alias("text")).distinct())


@query(f"""WITH {T}, lost AS (SELECT * FROM t WHERE source_path LIKE '/media/crate0%'), f AS (SELECT fingerprint, count(*) AS n, min(id) AS found_id FROM t WHERE source_path NOT LIKE '/media/crate0%' AND fingerprint IS NOT NULL GROUP BY 1)
    SELECT lost.id AS lost_id, found_id FROM lost JOIN f USING (fingerprint) WHERE n = 1""")
def moved_unique_match(s, d):
    t = catalog.latest(tracks(s, d), "source_path", "fingerprint")
    gone = F.col("source_path").startswith("/media/crate0")
    return linkage.unique_match(t.filter(gone), t.filter(~gone), "fingerprint")


@query(f"""WITH {T}, b AS (SELECT id, lower(trim(title)) AS name, fingerprint AS mark, source_path LIKE '/media/crate0%' AS gone FROM t WHERE title IS NOT NULL),
    n AS (SELECT name, count(*) AS n, min(id) AS only_id FROM b WHERE NOT gone GROUP BY 1), m AS (SELECT name, mark, count(*) AS m, min(id) AS marked FROM b WHERE NOT gone AND mark IS NOT NULL GROUP BY 1, 2)
    SELECT b.id AS lost_id, CASE WHEN n = 1 THEN only_id WHEN m = 1 THEN marked END AS found_id FROM b JOIN n USING (name) LEFT JOIN m USING (name, mark) WHERE gone AND (n = 1 OR m = 1)""")
def relocate_by_name(s, d):
    t = catalog.latest(tracks(s, d), "source_path", "fingerprint", "title").filter("title is not null").select("id", F.lower(F.trim("title")).alias("name"), F.col("fingerprint").alias("mark"), F.col("source_path").startswith("/media/crate0").alias("gone"))
    return linkage.relocated(t.filter("gone"), t.filter("not gone"), "name", "mark")


@query("""SELECT DISTINCT release_id, EXISTS (SELECT 1 FROM release_json j WHERE j.release_id = c.release_id) AS in_other FROM release_candidates c""")
def cross_list_flag(s, d):
    other = table(s, d, "release_json").select("release_id", F.lit(True).alias("o")).distinct()
    return table(s, d, "release_candidates").select("release_id").distinct().join(other, "release_id", "left").select("release_id", F.coalesce("o", F.lit(False)).alias("in_other"))


@query("""SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 200000""")
def set_difference(s, d):
    o = table(s, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").exceptAll(o.filter("o_totalprice > 200000").select("o_custkey", "o_orderpriority"))


@query("""SELECT track_id, kind FROM copies WHERE track_id IN (SELECT track_id FROM analysis WHERE analyzer_version = 20)""")
def prune_not_in(s, d):
    return state.pruned(table(s, d, "copies").select("track_id", "kind"), table(s, d, "analysis").filter("analyzer_version = 20 and track_id is not null"), "track_id")


TREE = """n AS (SELECT 'R' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier)"""


@query(f"""WITH RECURSIVE {TREE}, w AS (SELECT id, name, 0 AS depth, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.name, w.depth + 1, w.path || '/' || n.name FROM n JOIN w ON n.parent = w.id) SELECT id, depth, path FROM w""")
def tree_depth_listing(s, d):
    for name in ("region", "nation", "supplier"):
        table(s, d, name).createOrReplaceTempView(f"tree_{name}")
    return s.sql("""WITH RECURSIVE w(id, depth, path) AS (
        SELECT concat('R', r_regionkey), 0, r_name FROM tree_region UNION ALL
        SELECT n.id, w.depth + 1, concat(w.path, '/', n.name) FROM (
            SELECT concat('N', n_nationkey) AS id, concat('R', n_regionkey) AS parent, n_name AS name FROM tree_nation UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey), s_name FROM tree_supplier
        ) n JOIN w ON n.parent = w.id) SELECT id, depth, path FROM w""")


@query("""WITH p AS (SELECT format, string_split(regexp_replace(source_path, '/[^/]*$', ''), '/') AS a FROM tracks WHERE source_path IS NOT NULL), b AS (SELECT format, min(a) AS lo, max(a) AS hi FROM p GROUP BY format),
    k AS (SELECT format, lo, (SELECT count(*) FROM (SELECT unnest(generate_series(1, least(len(lo), len(hi)))) AS i) WHERE list_slice(lo, 1, i) = list_slice(hi, 1, i)) AS n FROM b) SELECT format, array_to_string(list_slice(lo, 1, n), '/') AS prefix FROM k""")
def common_prefix(s, d):
    dirs = F.split(F.regexp_replace("source_path", "/[^/]*$", ""), "/")
    b = tracks(s, d).filter("source_path is not null").select("format", dirs.alias("a")).groupBy("format").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i))
    return b.select("format", F.array_join(F.slice("lo", F.lit(1), F.greatest(F.size(same), F.lit(0))), "/").alias("prefix"))


@query(f"""WITH {T}, m AS (SELECT id, source_path AS old_path, '/media/crate02' || substr(source_path, 15) AS new_path FROM t WHERE source_path LIKE '/media/crate01/%'), w AS (SELECT new_path, min(id) AS winner FROM m GROUP BY 1)
    SELECT m.id, old_path, m.new_path, CASE WHEN m.new_path IN (SELECT source_path FROM t WHERE source_path IS NOT NULL) OR m.id <> winner THEN 'skipped' ELSE 'moved' END AS status FROM m JOIN w USING (new_path)""")
def relink_prefix_plan(s, d):
    return state.relink_plan(catalog.latest(tracks(s, d), "source_path"), "source_path", "/media/crate01", "/media/crate02")


STORED, SCANNED = (f"SELECT id, user_edited, title, src_size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(src_mtime, -4611686018427387904) {way}, coalesce(discogs_meta_fetched_at, -4611686018427387904) {way}, coalesce(src_size, -4611686018427387904) {way}, coalesce(title, '') {way}, coalesce(user_edited, false) {way}) AS rn FROM tracks WHERE id IS NOT NULL) WHERE rn = 1" for way in ("ASC", "DESC"))


@query(f"""WITH s AS ({STORED}), n AS ({SCANNED})
    SELECT n.id, CASE WHEN coalesce(s.user_edited, false) THEN s.title ELSE n.title END AS title, n.src_size, coalesce(s.user_edited, false) AS user_edited,
    CASE WHEN n.src_size IS NOT DISTINCT FROM s.src_size THEN 'unchanged' ELSE 'updated' END AS status FROM s JOIN n ON s.id = n.id""")
def upsert_oldest_newest(s, d):
    """The newest row of every track merged into its oldest one: two real scans of the whole library."""
    least = F.lit(-4611686018427387904)
    order = F.struct(*[F.coalesce(c, least) for c in ("src_mtime", "discogs_meta_fetched_at", "src_size")], F.coalesce("title", F.lit("")), F.coalesce("user_edited", F.lit(False)))
    t = tracks(s, d).filter("id is not null").withColumn("scan", order).withColumn("row", F.struct("user_edited", "title", "src_size"))
    both = t.groupBy("id").agg(F.min_by("row", "scan").alias("stored"), F.max_by("row", "scan").alias("new"))
    stored = both.select("id", F.coalesce("stored.user_edited", F.lit(False)).alias("user_edited"), "stored.title", "stored.src_size")
    return state.scan_upsert(stored, both.select("id", "new.title", "new.src_size"), ["title"], ["src_size"])


@query("""SELECT track_id, CASE WHEN grid_edited OR analyzer_version >= 20 THEN bpm ELSE bpm * 2 END AS bpm, CASE WHEN grid_edited OR analyzer_version >= 20 THEN beat_offset_ms ELSE beat_offset_ms + 7 END AS beat_offset_ms, first_beat_number,
    peak, CASE WHEN grid_edited AND analyzer_version < 20 THEN bpm * 2 END AS auto_bpm, CASE WHEN grid_edited AND analyzer_version < 20 THEN beat_offset_ms + 7 END AS auto_offset_ms, coalesce(grid_edited, false) AS grid_edited FROM analysis WHERE track_id IS NOT NULL""")
def manual_override_merge(s, d):
    a = table(s, d, "analysis").filter("track_id is not null")
    fresh = a.filter("analyzer_version < 20").select("track_id", (F.col("bpm") * 2).alias("bpm"), (F.col("beat_offset_ms") + 7).alias("beat_offset_ms"), "first_beat_number", "peak")
    return state.grid_merge(a, fresh)


@query("""WITH o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_partkey) AS r FROM o)
    SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN p_size <= 10 THEN 0 ELSE 1 END, r) - 1 AS INTEGER) AS position FROM q LEFT JOIN part ON p_partkey = l_partkey""")
def reorder_block_move(s, d):
    small = table(s, d, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return playlists.block_moved(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", small, True)


@query("""WITH o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2), s AS (SELECT p_partkey AS drop_id, p_partkey + 1 AS keep FROM part WHERE p_partkey % 10 = 0),
    n AS (SELECT l_orderkey, coalesce(keep, l_partkey) AS l_partkey, p, CASE WHEN keep IS NULL THEN 1 ELSE 0 END AS k FROM o LEFT JOIN s ON drop_id = l_partkey), b AS (SELECT l_orderkey, l_partkey, arg_max(p, k * 1000 - p) AS p FROM n GROUP BY 1, 2)
    SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_partkey) - 1 AS INTEGER) AS position FROM b""")
def replace_members(s, d):
    subs = table(s, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("drop"), (F.col("p_partkey") + 1).alias("keep"))
    return playlists.replaced(table(s, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", subs)


@query("""SELECT track_id, key_tonic, key_mode, CAST(((((CASE WHEN key_mode = 1 THEN key_tonic ELSE key_tonic + 3 END) * 7 + 7) % 12) + 1) AS VARCHAR) || CASE WHEN key_mode = 1 THEN 'B' ELSE 'A' END AS camelot,
    CAST(((((((CASE WHEN key_mode = 1 THEN key_tonic ELSE key_tonic + 3 END) * 7 + 7) % 12) + 1) + 4) % 12) + 1 AS VARCHAR) || CASE WHEN key_mode = 1 THEN 'd' ELSE 'm' END AS open_key,
    (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[key_tonic + 1] || CASE WHEN key_mode = 1 THEN '' ELSE 'm' END AS name FROM analysis WHERE track_id IS NOT NULL AND key_tonic IS NOT NULL AND key_mode IS NOT NULL""")
def key_notation(s, d):
    a = table(s, d, "analysis").filter("track_id is not null and key_tonic is not null and key_mode is not null")
    t, m = F.col("key_tonic"), catalog.is_major()
    return a.select("track_id", "key_tonic", "key_mode", keys.camelot(t, m).alias("camelot"), keys.open_key(t, m).alias("open_key"), keys.key_name(t, m).alias("name"))


@query("""WITH k AS (SELECT n, m FROM (SELECT unnest(generate_series(1, 12)) AS n), (SELECT unnest([true, false]) AS m))
    SELECT CAST(a.n AS INTEGER) AS a, a.m AS a_major, CAST(b.n AS INTEGER) AS b, b.m AS b_major FROM k a, k b WHERE a.n = b.n OR (a.m = b.m AND (abs(a.n - b.n) = 1 OR abs(a.n - b.n) = 11))""")
def key_compat_pairs(s, d):
    wheel = s.range(1, 13).select(F.col("id").cast("int").alias("n"), F.explode(F.array(F.lit(True), F.lit(False))).alias("m"))
    # each key's few neighbours are listed, so this is no join
    near = wheel.select(F.col("n").alias("a"), F.col("m").alias("a_major"), F.explode(F.expr("array(struct(n as b, m as bm), struct(n as b, not m as bm), struct(pmod(n, 12) + 1 as b, m as bm), struct(pmod(n - 2, 12) + 1 as b, m as bm))")).alias("x"))
    return near.select("a", "a_major", F.col("x.b").alias("b"), F.col("x.bm").alias("b_major"))


@query("""SELECT track_id, CASE WHEN bpm_tag IS NULL OR a.bpm IS NULL THEN 'unknown' WHEN abs(a.bpm - bpm_tag) <= 2 THEN 'ok' WHEN abs(a.bpm * 2 - bpm_tag) <= 2 OR abs(a.bpm / 2 - bpm_tag) <= 2 THEN 'octave' ELSE 'miss' END AS grade
    FROM analysis a JOIN (SELECT id, max(bpm_tag) AS bpm_tag FROM tracks GROUP BY id) t ON t.id = a.track_id""")
def accuracy_grading(s, d):
    a = table(s, d, "analysis").filter("track_id is not null").select("track_id", "bpm")
    t = tracks(s, d).groupBy(F.col("id").alias("track_id")).agg(F.max("bpm_tag").alias("tag"))
    off = lambda f: F.abs(F.col("bpm") * f - F.col("tag"))
    grade = F.when(F.col("tag").isNull() | F.col("bpm").isNull(), "unknown").when(off(1) <= 2, "ok").when((off(2) <= 2) | (off(0.5) <= 2), "octave").otherwise("miss")
    return a.join(t, "track_id").select("track_id", grade.alias("grade"))


@query(f"""WITH {T} SELECT track_id, CAST(b AS INTEGER) AS beat, round(beat_offset_ms + b * (60000.0 / bpm), 3) AS at_ms, CAST(((coalesce(first_beat_number, 1) - 1 + b) % 4) + 1 AS INTEGER) AS in_bar
    FROM (SELECT a.*, unnest(generate_series(0, CAST(ceil((duration_ms + 0.5::DOUBLE - beat_offset_ms) / (60000.0 / bpm)) AS BIGINT) - 1)) AS b FROM analysis a JOIN t ON t.id = track_id WHERE duration_ms > 0 AND bpm > 0 AND beat_offset_ms IS NOT NULL AND beat_offset_ms <= duration_ms)""")
def beat_grid_full(s, d):
    """The beats of every track up to its duration."""
    lengths = catalog.latest(tracks(s, d), "duration_ms").select(F.col("id").alias("track_id"), "duration_ms")
    return series.beats_of_track(table(s, d, "analysis"), lengths)


@query("""SELECT track_id, round(CASE WHEN beat_offset_ms - 300 < 0 THEN beat_offset_ms - 300 + ceil((300 - beat_offset_ms) / (240000.0 / bpm)) * (240000.0 / bpm) ELSE CAST(beat_offset_ms - 300 AS DOUBLE) END, 3) AS offset_ms, CASE WHEN bpm * 2 BETWEEN 40 AND 300 THEN bpm * 2 ELSE bpm END AS doubled,
    CASE WHEN bpm * 0.5 BETWEEN 40 AND 300 THEN bpm * 0.5 ELSE bpm END AS halved FROM analysis WHERE track_id IS NOT NULL AND bpm > 0 AND beat_offset_ms IS NOT NULL""")
def grid_edits(s, d):
    a = table(s, d, "analysis").filter("track_id is not null and bpm > 0 and beat_offset_ms is not null")
    b, o = F.col("bpm"), F.col("beat_offset_ms")
    return a.select("track_id", F.round(series.shifted(b, o, -300), 3).alias("offset_ms"), series.scaled_tempo(b, 2.0).alias("doubled"), series.scaled_tempo(b, 0.5).alias("halved"))


HOURS = "h AS (SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS hour, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


def hourly(s, d):
    return table(s, d, "events").groupBy("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("v"))


@query(f"""WITH {HOURS}, f AS (SELECT *, greatest(ln(1 + v) - coalesce(lag(ln(1 + v)) OVER (PARTITION BY event_type ORDER BY hour), 0), 0) AS flux FROM h)
    SELECT event_type, hour, round(greatest(flux - avg(flux) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING), 0), 6) AS onset FROM f""")
def onset_flux_series(s, d):
    return series.onset_flux(hourly(s, d), "event_type", "hour", "v")


@query(f"""WITH {HOURS}, x AS (SELECT *, v - avg(v) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS r FROM h), z AS (SELECT event_type, sum(x * x) AS zero FROM x GROUP BY 1)
    SELECT a.event_type, CAST(b.r - a.r AS INTEGER) AS lag, round(sum(a.x * b.x) / max(zero), 6) AS acf FROM x a JOIN x b ON a.event_type = b.event_type AND b.r - a.r BETWEEN 1 AND 24 JOIN z ON z.event_type = a.event_type GROUP BY 1, 2""")
def acf_comb_period(s, d):
    return series.autocorrelation(hourly(s, d), "event_type", "hour", "v", 24)


@query(f"""WITH {HOURS}, w AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY hour) AS b, lead(v) OVER (PARTITION BY event_type ORDER BY hour) AS a, max(v) OVER (PARTITION BY event_type) AS top FROM h) SELECT event_type, hour, v FROM w WHERE v >= 0.1 * top AND v >= coalesce(b, v) AND v >= coalesce(a, v)""")
def peak_pick(s, d):
    return series.peaks(hourly(s, d), "event_type", "hour", "v")


@query("""SELECT event_type, round(atan2(sum(value * sin(2 * pi() * hour(ts) / 24)), sum(value * cos(2 * pi() * hour(ts) / 24))), 6) AS angle FROM events GROUP BY 1""")
def circular_mean(s, d):
    a = F.lit(2 * 3.141592653589793) * F.hour("ts") / 24
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.atan2(F.sum(F.col("value") * F.sin(a)), F.sum(F.col("value") * F.cos(a))), 6).alias("angle"))


@query("""SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS peak, round(10 * log10(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding)), 6) AS rms_db FROM embeddings""")
def levels_of_vectors(s, d):
    peak, rms = series.levels(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", F.round(peak, 6).alias("peak"), F.round(rms, 6).alias("rms_db"))


def profile_sql() -> str:
    parts = []
    for tonic in range(12):
        for major, profile in ((True, keys.MAJOR_PROFILE), (False, keys.MINOR_PROFILE)):
            turned = [profile[(k - tonic) % 12] for k in range(12)]
            parts.append(f"SELECT {tonic} AS tonic, {str(major).lower()} AS is_major, {turned} AS p")
    return " UNION ALL ".join(parts)


@query(f"""WITH p AS ({profile_sql()}), v AS (SELECT vec_id, list_transform(embedding[1:12], lambda x: CAST(abs(x) AS DOUBLE)) AS c FROM embeddings), l AS (SELECT vec_id, tonic, is_major, unnest(c) AS x, unnest(p) AS y FROM v, p),
    r AS (SELECT vec_id, tonic, is_major, round(corr(x, y), 9) AS r FROM l GROUP BY 1, 2, 3), w AS (SELECT *, CASE WHEN r > 0 AND NOT is_major THEN r * 1.2 ELSE r END AS score FROM r)
    SELECT vec_id, tonic, is_major, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, tonic, is_major DESC) AS n FROM w) WHERE n = 1""")
def template_correlation(s, d):
    v = table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x).cast("double")).alias("c"))
    return series.profile_scores(v, "vec_id", "c")


@query("""SELECT release_id, CAST(p AS INTEGER) AS place, json_extract_string(j, '$.position') AS position, json_extract_string(j, '$.title') AS title FROM (SELECT DISTINCT release_id, detail_json, unnest(json_extract(detail_json, '$.tracklist[*]')) AS j, generate_subscripts(json_extract(detail_json, '$.tracklist[*]'), 1) AS p FROM release_json WHERE json_valid(detail_json)) WHERE trim(json_extract_string(j, '$.title')) <> ''""")
def json_release_docs(s, d):
    from ..sources.files import release_documents

    docs = release_documents(table(s, d, "release_json").select("release_id", "detail_json", "detail_version")).distinct()
    return docs.select("release_id", F.posexplode("d.tracklist").alias("p", "x")).filter(F.trim("x.title") != "").select("release_id", (F.col("p") + 1).cast("int").alias("place"), F.col("x.position").alias("position"), F.col("x.title").alias("title")).distinct()


@query("""SELECT DISTINCT release_id, regexp_replace(title, ' \\(\\d*\\)$', '') AS bare, TRY_CAST(nullif(regexp_extract(year, '^\\s*(\\d+)', 1), '') AS INTEGER) AS y FROM release_candidates""")
def parse_fields(s, d):
    y = F.nullif(F.regexp_extract("year", r"^\s*(\d+)", 1), F.lit("")).try_cast("int")
    return table(s, d, "release_candidates").select("release_id", text.strip_release_number(F.col("title")).alias("bare"), y.alias("y")).distinct()


@query(f"""WITH {T} SELECT count(*) AS n, count(*) FILTER (trim(album) <> '' AND trim(genre) <> '' AND year IS NOT NULL) AS complete, count(*) FILTER (user_edited) AS edited, count(*) FILTER (has_cover) AS covered, count(*) FILTER (lower(format) IN ('flac','wav','aiff')) AS lossless FROM t""")
def predicate_suite(s, d):
    t = catalog.latest(tracks(s, d), "album", "genre", "year", "user_edited", "has_cover", "format")
    n = lambda c: F.count(F.when(c, 1))
    return t.agg(F.count(F.lit(1)).alias("n"), n((F.trim("album") != "") & (F.trim("genre") != "") & F.col("year").isNotNull()).alias("complete"), n(F.col("user_edited")).alias("edited"), n(F.col("has_cover")).alias("covered"), n(quality.is_lossless("format")).alias("lossless"))


@query(f"""WITH {T} SELECT id, CASE WHEN trim(artist) <> '' AND trim(title) <> '' THEN trim(artist) || ' — ' || trim(title) WHEN trim(title) <> '' THEN trim(title) WHEN trim(artist) <> '' THEN trim(artist) ELSE regexp_extract(source_path, '[^/]*$') END AS label FROM t""")
def display_labels(s, d):
    t = catalog.latest(tracks(s, d), "artist", "title", "source_path")
    a, b = text.filled(F.col("artist")), text.filled(F.col("title"))
    return t.select("id", F.coalesce(F.concat(a, F.lit(" — "), b), b, a, text.file_name(F.col("source_path"))).alias("label"))


@query(f"""WITH {T} SELECT id, CASE WHEN added_at IS NULL OR added_at <= 0 OR added_at > {AS_OF} THEN '—' WHEN dd = 0 THEN 'today' WHEN dd = 1 THEN 'yesterday' WHEN dd < 7 THEN dd || 'd' WHEN dd < 30 THEN (dd // 7) || 'w' WHEN dd < 365 THEN (dd // 30) || 'mo' ELSE (dd // 365) || 'y' END AS age FROM (SELECT *, ({AS_OF} - added_at) // 86400 AS dd FROM t)""")
def age_format(s, d):
    return catalog.latest(tracks(s, d), "added_at").select("id", text.age(F.col("added_at"), F.lit(AS_OF)).alias("age"))


@query("""SELECT format, count(*) AS files, CAST(sum(CASE WHEN user_edited THEN 1 ELSE 0 END) AS BIGINT) AS edited FROM tracks GROUP BY format""")
def status_tally(s, d):
    return tracks(s, d).groupBy("format").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("user_edited").cast("bigint")).alias("edited"))


@query(f"""WITH {T} SELECT t.id, a.track_id IS NOT NULL AS analysed, {VERDICT} AS verdict, CASE WHEN lowpass_hz >= 20000 THEN '~320 kbps (or lossless w/ 20 kHz shelf)' WHEN lowpass_hz >= 18500 THEN '~256 kbps' WHEN lowpass_hz >= 15500 THEN '~192 kbps / AAC' WHEN lowpass_hz >= 13500 THEN '~128 kbps' WHEN lowpass_hz IS NOT NULL THEN '≤96 kbps' END AS source FROM t LEFT JOIN analysis a ON a.track_id = t.id""")
def rolloff_verdicts(s, d):
    v = catalog.with_analysis(catalog.latest(tracks(s, d), "format"), table(s, d, "analysis"))
    return v.select("id", F.col("analyzer_version").isNotNull().alias("analysed"), quality.verdict("lowpass_hz", "lowpass_edge").alias("verdict"), quality.source_guess("lowpass_hz").alias("source"))


@query()
def file_listing_signatures(s, d):
    """Path, size, time and content mark of the input files themselves."""
    from ..sources.files import listing

    return listing(s, d, ["parquet"], with_content=True)


@query()
def mapinpandas_features(s, d):
    """Synthesised click tracks of every distinct tempo tag, analysed."""
    from ..functions.dsp import analyse

    tempos = tracks(s, d).filter("bpm_tag is not null").select(F.round("bpm_tag").cast("bigint").alias("track_id")).distinct()
    rate, seconds = 8000, 12
    step = F.lit(60.0 * rate) / F.col("track_id")
    samples = F.transform(F.sequence(F.lit(0), F.lit(rate * seconds - 1)), lambda i: F.when(F.pmod(i.cast("double"), step) < 60, 0.8 * F.cos(i * 0.7)).otherwise(0.0).cast("float"))
    audio = tempos.select("track_id", F.lit(rate).alias("sample_rate"), samples.alias("samples"))
    return analyse(audio.repartition(16, "track_id")).select("track_id", "bpm", "peak", "loudness", "error")


def scans_folder(s, d, *columns):
    """The scans as a folder of files, as they would arrive; and a folder for what becomes of them."""
    import uuid

    from ..session import shared_folder

    folder = f"{shared_folder(s)}/scans-{uuid.uuid4().hex}"
    src = tracks(s, d).select("id", *columns)
    src.write.parquet(folder + "/in")
    return folder, src.schema


@query(f"WITH {T} SELECT id, src_size, src_mtime, discogs_meta_fetched_at, title FROM t")
def stream_incremental_upsert(s, d):
    """The newest scan of each track from a stream over the scan files, run until all is processed."""
    from ..streaming import rescan

    folder, schema = scans_folder(s, d, "src_size", "src_mtime", "discogs_meta_fetched_at", "title")
    return rescan.upserted(rescan.scan_stream(s, folder + "/in", schema), ["src_mtime", "discogs_meta_fetched_at", "src_size"], folder)


@query("""SELECT added_at // 86400 * 86400 AS "from", format, count(*) AS n FROM tracks WHERE added_at IS NOT NULL GROUP BY 1, 2""")
def stream_arrivals(s, d):
    """Scans per day of arrival and format, counted from the stream; late rows are waited for ten years."""
    from ..streaming import rescan

    folder, schema = scans_folder(s, d, "added_at", "format")
    return rescan.counted(rescan.arrivals(rescan.scan_stream(s, folder + "/in", schema), "added_at", late="3650 days"), folder)
