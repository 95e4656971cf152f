import pytest
from pyspark.sql import functions as F

from crateline.functions import keys, quality, text
from crateline.operators import catalog, library, playlists, records, series, state
from crateline.skew import join_salted


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize("stem, want", [("01-Foo", (None, "Foo")), ("03) Foo", (None, "Foo")), ("7. Foo", (None, "Foo")), ("123", (None, "123")), ("01 - 02", (None, "01 - 02")), ("-Foo", (None, "Foo")), ("808 State - X", ("State", "X")), ("A - B - C", ("A", "B - C")), ("", (None, None)), ("A‐B", (None, "A-B"))])
def test_filename_numbers(spark, stem, want):
    a, t = text.parse_filename(F.lit(stem))
    r = one(spark, a=a, t=t)
    assert (r.a, r.t) == want


def test_stems_and_targets(spark):
    s = F.lit
    none = s(None).cast("string")
    r = one(spark, a=text.metadata_stem(s("Nairobi"), none), b=text.metadata_stem(none, s("Nairobi Market")), c=text.metadata_stem(s(" "), none), d=text.metadata_stem(s("/"), s(":")), e=text.target_path(s("/music/01 - Artist - Title.flac"), s("mp3")), f=text.target_path(s("/music/a.b.flac"), s("aac"), "/out/"), g=text.target_bitrate(s("mp3"), s(None).cast("int")), h=text.target_bitrate(s("aac"), s(192)), i=text.target_bitrate(s("flac"), s(999)))
    assert (r.a, r.b, r.c, r.d) == ("Nairobi", "Nairobi Market", None, None)
    assert (r.e, r.f, r.g, r.h, r.i) == ("/music/01 - Artist - Title.mp3", "/out/a.m4a", 320, 192, None)


def test_texts(spark):
    s = F.lit
    none = s(None).cast("string")
    r = one(
        spark, a=text.price(s(24.4), s("USD"), False), b=text.price(s(9.5), none), c=text.price(s(3.0), s(" cad ")), d=text.release_link(s(" 7 "), s("x")), e=text.release_link(none, s("a b&c~*")), f=text.search_text(s(" A "), s(" "), s("T")), g=text.pair_text(none, s("T")), h=text.caption(s(1993), none, s("L"), s("C 1")),
        i=text.tempo_tag(s(0.5)), j=text.tempo_tag(s(400.0)), k=text.is_compilation(s(" 1 ")), m=text.parse_decibels(s("-7.23 dB")), n=text.plain_number(s(128.0)), o=text.plain_number(s(128.5)), p=text.head_number(s("70000")), q=text.shortened(s("abcdef"), 4), u=text.age(s(100), s(100 + 86400 * 5), " ago"), v=text.parse_year(s(" 1999")), w=text.decibels(s(-7.234)),
    )
    assert (r.a, r.b, r.c) == ("$24", "9.50", "$3.00") and r.d.endswith("/release/7") and r.e.endswith("q=a%20b%26c~%2A")
    assert (r.f, r.g, r.h, r.i, r.j, r.k, r.m, r.n, r.o, r.p, r.q, r.u, r.v, r.w) == ("A T", "T", "1993 · L C 1", None, 400.0, True, -7.23, "128", "128.5", None, "abc…", "5d ago", None, "-7.23 dB")


def test_quality_texts(spark):
    r = one(spark, a=quality.chip(F.lit("inconclusive")), b=quality.blurb(F.lit("likely_lossy"), F.lit(16_000.0)), c=quality.blurb(F.lit("clean"), F.lit(None).cast("double")), d=quality.blurb(F.lit(None).cast("string"), F.lit(None).cast("double")), e=quality.chip(F.lit(None).cast("string")))
    assert r.a == "clean" and r.b.split("\n")[1:] == ["Low-pass cutoff: 16.0 kHz", "Estimated source: ~192 kbps / AAC"] and "\n" not in r.c and r.d.startswith("Not checked") and r.e is None


@pytest.mark.parametrize("typed, want", [("Am", (9, False)), ("F#", (6, True)), ("Bb", (10, True)), ("D min", (2, False)), ("H", (None, None)), ("", (None, None))])
def test_parse_key(spark, typed, want):
    t, m = keys.parse_key(F.lit(typed))
    r = one(spark, t=t, m=m)
    assert (r.t, r.m) == want


def test_sorts_and_picks(spark):
    d = spark.createDataFrame([(1, "b", None, 1.0), (2, "A", "x", None), (3, None, "y", 2.0)], "id bigint, artist string, title string, bpm double")
    ids = lambda keys_: [r.id for r in d.orderBy(*keys_).collect()]
    assert ids(library.sort_keys("artist", True)) == [3, 2, 1] and ids(library.sort_keys("bpm", True)) == [1, 3, 2] and ids(library.sort_keys("bpm", False)) == [2, 3, 1]
    assert [r.id for r in library.listed(d).collect()] == [3, 2, 1] and library.listed(d, 2).count() == 2
    assert library.by_ids(d, d.limit(0)).count() == 0 and library.one(d, 2)["artist"] == "A"
    with pytest.raises(LookupError):
        library.one(d, 9)
    assert library.picked(d, 1).first().id == library.picked(d, 1).first().id and library.picked(d.limit(0), 1).count() == 0
    k = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 6, 0), (4, None, None)], "id bigint, key_tonic int, key_mode int")
    assert library.next_track(k, 1, 3).first().id == 2 and library.next_track(k, 3, 3).first().id in (1, 2, 4) and library.next_track(k, 4, 3).count() == 1
    r = spark.createDataFrame([(1, "b", "t", 2.0), (2, "a", "t", None), (3, "a", "t", 1.0)], "instance_id bigint, artist string, title string, price double")
    order = lambda by, up: [x.instance_id for x in r.orderBy(*library.vinyl_order(by, up)).collect()]
    assert order("price", True) == [3, 1, 2] and order("price", False) == [1, 3, 2] and order("artist", False) == [1, 2, 3]


def test_free_names(spark):
    w = spark.createDataFrame([(1, "/s/1", "/o/a.mp3"), (2, "/s/2", "/o/a.mp3"), (3, "/o/b.mp3", "/o/b.mp3"), (4, "/s/4", "/o/b.mp3"), (5, "/s/5", "/o/c"), (6, "/s/6", "/o/c")], "id bigint, source string, base string")
    t = spark.createDataFrame([("/o/a (1).mp3",), ("/o/b.mp3",)], "path string")
    assert {r.id: r.target for r in library.free_names(w, t).collect()} == {1: "/o/a.mp3", 2: "/o/a (2).mp3", 3: "/o/b.mp3", 4: "/o/b (1).mp3", 5: "/o/c", 6: "/o/c (1)"}
    assert library.free_names(w.limit(0), t).count() == 0


def test_title_assignment():
    tracks = [("A1", "Safe Harbour"), ("A2", "One Light"), ("B1", "Lately Gone"), ("B2", "Song Of The Mill")]
    videos = ["Mira Band - One Light", "Safe Harbour (Night Mix)", "B1. Lately Gone", "Blue Rows - Full Album"]
    assert records.assign_titles(tracks, [records._tails(v) for v in videos], True) == [1, 0, 2, None]
    assert records.assign_titles([("", "Light")], [records._tails("One Light")], True) == [None]
    assert records.assign_titles([("A1", "Other"), ("1", "Third")], [["a1 something"], ["1 third thing"]], True) == [0, None]
    assert records.assign_titles([("A1", "Same"), ("A2", "Same")], [["same"], ["same"]], False) == [0, 1] and records.assign_titles([("A1", "")], [["x"]], True) == [None]


def test_players(spark):
    entry, video, file = "struct<position:string,title:string>", "struct<uri:string,title:string>", "struct<id:bigint,title:string>"
    d = spark.createDataFrame([("r", [("A1", "One Light"), ("A2", "Lately Gone")], [("u1", "Mira - Lately Gone"), ("u2", "Mira - One Light")], [(7, "one light!")]), ("s", [("A1", "X")], None, None)], f"release_id string, entries array<{entry}>, videos array<{video}>, files array<{file}>")
    got = {(r.release_id, r.place): (r.file_id, r.video, r.plays) for r in records.players(d).collect()}
    assert got == {("r", 1): (7, "u2", "file"), ("r", 2): (None, "u1", "video"), ("s", 1): (None, None, None)}
    few = records.claimable(spark.createDataFrame([("r", i, "One light") for i in range(9)] + [("r", 90, "other")], "release_id string, track_id bigint, title string"), d)
    assert [sorted(f.id for f in r.files) for r in few.collect()] == [[0, 1]]


def test_documents(spark):
    from crateline.sources.files import release_documents

    j = '{"title": "T", "styles": [], "genres": ["Electronic"], "label": " ", "year": 1993, "tracklist": [{"position": "", "title": "Side", "type": "heading"}, {"position": "A1", "title": "X", "type": "track"}, {"position": "A2", "title": "Y"}], "videos": [{"uri": "u", "title": "v", "duration": 0}, {"uri": " ", "title": "w", "duration": 5}]}'
    d = release_documents(spark.createDataFrame([("1", j, 2), ("2", j, 1), ("3", "{", 2), ("4", None, 2)], "release_id string, detail_json string, detail_version int"), 2)
    v = records.fill_values(F.col("d"))
    r = d.select("release_id", records.tracklist(F.col("d")).alias("t"), records.videos(F.col("d")).alias("v"), v["genre"].alias("genre"), v["label"].alias("label"), v["year"].alias("year")).collect()
    assert len(r) == 1 and [x.title for x in r[0].t] == ["X", "Y"] and [(x.uri, x.seconds, x.embeddable) for x in r[0].v] == [("u", None, True)] and (r[0].genre, r[0].label, r[0].year) == ("Electronic", None, "1993")
    tags = spark.createDataFrame([(1, None, "L", "1990"), (2, "g", None, None)], "id bigint, genre string, label string, year string")
    detail = spark.createDataFrame([(1, "Acid, Techno", "L", "1993"), (2, "g", "M", "1993")], "id bigint, genre string, label string, year string")
    n = lambda over: {x.id: x.n_changed for x in state.fills(tags, detail, "id", ["genre", "label", "year"], over).collect()}
    assert n(False) == {1: 1, 2: 2} and n(True) == {1: 2, 2: 2}


def test_record_links(spark):
    r = spark.createDataFrame([(1, "Mira", "Club Nights Volume Two"), (2, "Mira", "Harbour"), (7000, "Any", "Thing"), (4, "Mira", " "), (5, None, None)], "release_id bigint, artist string, title string")
    t = spark.createDataFrame([(10, "x", "Club Nights, Vol. 2", "a"), (11, "Mira, Olo", None, "harbour!"), (12, "Other", None, "Harbour"), (13, None, "thing", "b"), (14, None, " ", None)], "id bigint, artist string, album string, title string")
    exact = spark.createDataFrame([(7000, 12)], "release_id bigint, track_id bigint")
    got = {(x.release_id, x.track_id, x.how) for x in records.record_links(r, t, exact).collect()}
    assert got == {(1, 10, "text"), (2, 11, "text"), (7000, 12, "id")}
    assert records.id_links(spark.createDataFrame([(1, "555"), (1, "555"), (2, "master-1"), (None, "3"), (3, None)], "track_id bigint, external_id string")).count() == 1
    assert {x.track_id for x in records.in_list(records.record_links(r, t, exact), r.filter("release_id = 2")).collect()} == {11}


def test_playlist_edits(spark):
    rows = spark.createDataFrame([("A", 1, 0), ("A", 2, 1), ("A", 3, 2), ("B", 1, 0)], "l string, i int, p int")
    at = lambda d: {k: [i for _, i in sorted(v)] for k, v in _lists(d).items()}
    more = spark.createDataFrame([("A", 2, 0), ("A", 9, 1), ("A", 8, 2), ("A", 9, 3), ("C", 5, 0)], "l string, i int, turn int")
    assert at(playlists.added(rows, "l", "i", "p", more)) == {"A": [1, 2, 3, 9, 8], "B": [1], "C": [5]}
    assert at(playlists.removed(rows, "l", "i", "p", spark.createDataFrame([("A", 2), ("B", 7)], "l string, i int"))) == {"A": [1, 3], "B": [1]}
    good = spark.createDataFrame([("A", 3, 0), ("A", 1, 1), ("A", 2, 2), ("B", 1, 0), ("B", 2, 1)], "l string, i int, turn int")
    members, refused = playlists.reordered(rows, "l", "i", "p", good)
    assert at(members) == {"A": [3, 1, 2], "B": [1]} and [tuple(r) for r in refused.collect()] == [("B", 0, 1, 0)]
    assert at(playlists.block_before(rows, "l", "i", "p", spark.createDataFrame([(3,)], "i int"), 1)) == {"A": [1, 3, 2], "B": [1]}
    assert playlists.added(rows.limit(0), "l", "i", "p", more.limit(0)).count() == 0


def _lists(d):
    out = {}
    for r in d.collect():
        out.setdefault(r.l, []).append((r.position, r.i))
    return out


def test_forest(spark):
    n = spark.createDataFrame([("r", None, True), ("a", "r", True), ("b", "a", True), ("x", "b", False), ("y", "r", False)], "id string, parent string, is_folder boolean")
    moves = spark.createDataFrame([("a", "b"), ("x", "r"), ("x", "y"), ("a", "a"), ("b", None), ("q", "r"), ("x", "q")], "id string, target string")
    assert {(r.id, r.target): r.verdict for r in playlists.move_checks(n, moves).collect()} == {("a", "b"): "cycle", ("x", "r"): "ok", ("x", "y"): "no folder", ("a", "a"): "self", ("b", None): "ok", ("q", "r"): "unknown", ("x", "q"): "unknown"}
    assert {r.id for r in playlists.without_nodes(n, spark.createDataFrame([("a",)], "id string")).collect()} == {"r", "y"}
    assert {r.id: (r.depth, r.leaves) for r in playlists.leaf_counts(n).collect()} == {"r": (0, 2), "a": (1, 1), "b": (2, 1), "x": (3, 0), "y": (1, 0)}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    assert playlists.ancestors(ring).count() == 4 and playlists.ancestors(ring.limit(0)).count() == 0


def test_state(spark):
    rows = spark.createDataFrame([(1, 128.0, 250, 1, None, None, None, False)], "track_id bigint, bpm double, beat_offset_ms bigint, first_beat_number int, auto_bpm double, auto_beat_offset_ms bigint, auto_first_beat_number int, grid_edited boolean")
    manual = spark.createDataFrame([(1, 128.0, 280, 3)], "track_id bigint, bpm double, beat_offset_ms bigint, first_beat_number int")
    ids = manual.select("track_id")
    edited = state.grid_set(rows, manual)
    again = state.grid_set(edited, manual.withColumn("beat_offset_ms", F.lit(300).cast("bigint")))
    r = state.grid_reset(again, ids).first()
    assert (edited.first().beat_offset_ms, again.first().auto_beat_offset_ms) == (280, 250) and (r.beat_offset_ms, r.first_beat_number, r.was_reset, r.grid_edited) == (250, 1, True, False)
    assert not state.grid_reset(state.grid_reset(again, ids).drop("was_reset"), ids).first().was_reset
    t = spark.createDataFrame([(1, "/a"), (2, "/b")], "id bigint, path string")
    w = spark.createDataFrame([(1, "/b"), (1, "/a"), (1, "/c"), (9, "/d")], "id bigint, new_path string")
    assert {(x.id, x.new_path): x.verdict for x in state.source_relinks(t, w).collect()} == {(1, "/b"): "taken", (1, "/a"): "ok", (1, "/c"): "ok", (9, "/d"): "unknown"}
    left = state.deleted({"t": (t, "id")}, spark.createDataFrame([(1,)], "id bigint"))
    assert left["t"].count() == 1
    f = spark.createDataFrame([(1, 5), (2, None)], "id bigint, fetched_at bigint")
    assert {x.id: x.fetched_at for x in state.fetched_cleared(state.fetched_marked(f, f.filter("id = 2"), 9), f.filter("id = 1")).collect()} == {1: None, 2: 9}
    assert all(x.fetched_at is None for x in state.fetched_cleared(f).collect())


def test_scan_by_path(spark):
    cols = "id bigint, path string, fingerprint string, user_edited boolean, fetched_at bigint, album string, genre string, year int, duration_ms bigint, on_disk boolean"
    stored = spark.createDataFrame([(1, "/a", "f1", True, 5, "mine", "g", 1, 1000, True), (2, "/gone", "f2", False, None, "o", "g", 1, 1, False), (3, "/c", "f3", False, None, None, None, None, 1, True), (4, "/d1", "f4", False, None, None, None, None, 1, False), (5, "/d2", "f4", False, None, None, None, None, 1, False)], cols)
    scanned = spark.createDataFrame([("/a", "f1", "new", "n", 2, 2000), ("/moved", "f2", "o2", "g", 1, 7), ("/copy", "f1", "al", "ge", 3, 8), ("/twice", "f4", None, "g", 3, 9)], "path string, fingerprint string, album string, genre string, year int, duration_ms bigint")
    got = {r.path: r for r in state.scan_by_path(stored, scanned, ["album", "genre", "year"], ["duration_ms"], 77).collect()}
    assert {p: (r.id, r.status) for p, r in got.items()} == {"/a": (1, "updated"), "/moved": (2, "moved"), "/copy": (None, "added"), "/twice": (None, "added"), "/c": (3, "kept"), "/d1": (4, "kept"), "/d2": (5, "kept")}
    assert (got["/a"].album, got["/a"].duration_ms, got["/a"].fetched_at) == ("mine", 2000, 5) and got["/moved"].album == "o2" and got["/copy"].fetched_at == 77 and got["/twice"].fetched_at is None


def test_join_salted(spark):
    fact = spark.createDataFrame([(i, "hot") for i in range(500)] + [(1000, "cold"), (1001, None), (1002, "alone")], "id bigint, k string")
    dim = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("cold", "z"), ("none", "w"), (None, "v")], "k string, v string")
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"))
    got = sorted((r.id, r.v) for r in join_salted(fact, dim, "k", counts, part_rows=50).collect())
    assert got == sorted([(i, v) for i in range(500) for v in "xy"] + [(1000, "z")])


def test_series_helpers(spark):
    d = spark.createDataFrame([(1, [0.0, -0.5, 1.0, 2.0])], "id bigint, v array<double>")
    assert d.select(series.binned(F.col("v"), 6).alias("b")).first().b == [0, 128, 255, 255, 0, 0] and d.select(series.binned(F.col("v"), 2).alias("b")).first().b == [128, 255]
    x = spark.createDataFrame([("a", k, float(k % 6 == 0)) for k in range(120)], "p string, t int, v double")
    r = series.periods(series.autocorrelation(x, "p", "t", "v", 48), "p", 12, 6.0, 0.65).collect()
    assert [(q.lag, round(q.refined)) for q in r] == [(6, 6)] and r[0].confidence > 0
    assert series.periods(series.autocorrelation(x.limit(0), "p", "t", "v", 48), "p", 12, 6.0, 0.65).count() == 0


def test_missing_and_display(spark):
    t = spark.createDataFrame([(1, "/a/x.mp3", "A", "T", 1, 1, 1), (2, "/a/y.mp3", None, " ", 1, 1, 1), (3, None, "A", "B", 1, 1, 1)], "id bigint, source_path string, artist string, title string, src_mtime bigint, discogs_meta_fetched_at bigint, src_size bigint")
    gone = catalog.missing_files(t, spark.createDataFrame([("/a/x.mp3",)], "source_path string"))
    assert [(r.id, r.label) for r in gone.collect()] == [(2, "y.mp3")]
