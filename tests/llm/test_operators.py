import base64
import random

import pytest
from pyspark.sql import functions as F

from crateline.llm import bpe, matching, mixing, mojibake, names, styles, survivorship, truncation
from crateline.session import written


def test_encoder_equals_reference_and_round_trip():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.load(bpe.default_vocabulary())
    rng = random.Random(5)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "日本" * 500, " " * 500] + ["".join(rng.choice("abcdeé 漢😀\n\t019'sx") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    for t in texts:
        ids = own.encode(t)
        assert ids == enc.encode_ordinary(t) and own.decode(ids).decode() == t


def test_encode_rows(spark):
    d = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (1, "hello world", 0)], "doc_id bigint, text string, ids int")
    got = bpe.encode_ids(d).collect()
    assert len(got) == 4 and sorted(len(r.ids) for r in got) == [0, 0, 2, 2]
    assert {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_ids(d)).collect()}[1] == "hello world"
    assert bpe.encode_ids(d.limit(0)).count() == 0


def test_mix(spark):
    docs = [(i, "word " * (1 + i % 7), "big") for i in range(900)] + [(1000 + i, "word " * 5, "small") for i in range(30)] + [(5000, None, "big"), (5001, "x", None), (5002, "y", "none")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.plan_mix(d, t)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].actual_share - 0.8) < 0.01 and abs(s["small"].actual_share - 0.2) < 0.01 and s["absent"].mix_tokens == 0
    m = mix.collect()
    assert all(r.repeats <= (1 if r.source == "big" else 3) for r in m) and len({r.doc_id for r in m}) == len(m)
    mix, shares = mixing.plan_mix(d, t, total_tokens=10**6)
    assert {r.source: r.most_repeats for r in shares.collect()} == {"big": 1, "small": 3, "absent": 0}
    assert mixing.plan_mix(d.limit(0), t)[0].count() == 0


def test_styles(spark):
    st = spark.createDataFrame(list(enumerate(["House", "Velvet House", "Drum & Brass", "Sea Song", "Techno", "Rust Techno"], 1)), "style_id int, style string")
    m = styles.Matcher([(r.style_id, r.style) for r in st.collect()])
    want = {"velvet_hse": 2, "House - Velvet": 2, "Vlvt Haus": 2, "velevt house": 2, "drum n brass": 3, "HOUSE!": 1, "S Song": 4, "rust tek": 6, "Tango": 0, "2003": 0, "***": 0, "": 0}
    assert {v: m.match(v)[0] for v in want} == want
    t = spark.createDataFrame([(1, "velvt house; House"), (2, "House"), (3, None), (4, " "), (1, "velvt house; House")], "id bigint, genre string")
    r = spark.createDataFrame([("7", '{"styles": ["", "tekno", "House"]}', 1), ("8", '{"styles": ["tek', 1), ("9", None, 1), ("7", '{"styles": ["", "tekno", "House"]}', 2)], "release_id string, detail_json string, detail_version int")
    got = {(x.src, x.rec_id, x.pos, x.style_id) for x in styles.canonical_styles(t, r, st).collect()}
    assert got == {("track", "1", 1, 2), ("release", "7", 2, 5)}
    # blocks of the list give the same as the whole
    v = spark.createDataFrame([("tekno",), ("velvet hse",), ("zzz",)], "val string")
    assert {(x.val, x.style_id) for x in styles.match_values(v, st, block=2).collect()} == {("tekno", 5), ("velvet hse", 2), ("zzz", 0)}


def test_trie_against_brute_force():
    from crateline.llm.names import edits

    entries = [(i, w) for i, w in enumerate(["harbour", "harvest", "saffron", "quartz"], 1)]
    t = styles.Trie(entries)
    rng = random.Random(3)
    for _, w in entries:
        for _ in range(30):
            x = list(w)
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = rng.choice("abrst")
            x = "".join(x)
            got = {e: d for e, (d, _) in t.search(x, 2).items()}
            for e, full in entries:
                if edits(x, full, 2) <= 2:
                    assert got.get(e, 9) <= edits(x, full, 2)


@pytest.mark.parametrize("pair", mojibake.PAIRS)
def test_restore_inverts_garble(pair):
    for t in ("Jürgen Movadoštañ", "Señal", "Поезд", "Λιμάνι", "砂時計"):
        g = mojibake.garble(t, pair)
        if g is not None and g != t:
            assert mojibake.restore(g, pair) == t


def test_garbled_cells(spark):
    rng = random.Random(2)
    made = ["".join(rng.choice(["jür", "señ", "grö", "fên", "té", "kü", "nô", "lav", "mor", "ßa", "ro", "dal"]) for _ in range(3)).capitalize() for _ in range(400)]
    clean = ["Señal Niño", "Größe Küste", "SÃO TOMÉ", "Поезд окно", "Ночь мост"] * 6 + made
    bad = [mojibake.garble("Señal Niño", ("utf-8", "cp1252", 1)), mojibake.garble("Größe Küste", ("utf-8", "cp437", 1)), mojibake.garble("Поезд окно", ("cp1251", "cp1252", 1)), "N�chte"]
    rows = [(i, t, None) for i, t in enumerate(clean + bad)] + [(900, None, None), (901, "", None), (902, "plain", None), (903, made[0] * 400, None)]
    d = spark.createDataFrame(rows, "id bigint, title string, cell string")
    got = {r.id: r.restored for r in mojibake.garbled_cells(d, "id", ["title"]).collect()}
    n = len(clean)
    assert set(got) == {n, n + 1, n + 2, n + 3} and got[n] == "Señal Niño" and got[n + 1] == "Größe Küste" and got[n + 2] == "Поезд окно"
    assert mojibake.garbled_cells(d.limit(0), "id", ["title"]).count() == 0


def test_names(spark):
    assert names.monge_elkan(["michael", "denfikriban"], ["m", "dnfikriban"]) >= names.VERIFIED
    assert names.monge_elkan(["benjamin", "kustakugam"], ["valentina", "kustakugam"]) == 0
    assert names.collision(0.5, 3, names.bands_for(0.33, 0.9, 3)) > 0.99
    cells = ["Michael Denfikriban", "M. Dnfikriban", "Mick Denfikriban", "Denfikriban, Michael", "Valentina Denfikriban", "Robert Lengatrennom", "Bob Lengatrennom", "The Zahenkisten Ensemble", "Zahenksiten Ens.", "Michael Denfikriban & Robert Lengatrennom"]
    d = spark.createDataFrame([(c, None, None, l) for c, l in zip(cells, ["Rizidrapol Music", "rizidrapol", "Rizidrapol Music Ltd", None, "", "Tiluvono Tapes"] + [None] * 4)] * 2, "artist string, remixer string, album_artist string, label string")
    linked = names.linked_names(d, ["artist", "remixer", "album_artist"], ["label"])
    got = {frozenset(x) for x in [(r.name_a, r.name_b) for r in names.name_pairs(linked).collect()]}
    same = [["Michael Denfikriban", "M. Dnfikriban", "Mick Denfikriban", "Denfikriban, Michael"], ["Robert Lengatrennom", "Bob Lengatrennom"], ["The Zahenkisten Ensemble", "Zahenksiten Ens."], ["Rizidrapol Music", "rizidrapol", "Rizidrapol Music Ltd"]]
    assert got == {frozenset((a, b)) for g in same for a in g for b in g if a != b}
    assert names.linked_names(d.limit(0), ["artist"], ["label"]).count() == 0


def test_matching(spark):
    assert matching.parse_candidate('A (2) & B* – Some Title (C Remix) / Other 12"')[1] == "Some Title (C Remix)"
    assert matching.parse_title("07 - Some_Title_(C Remix)") == (("some", "title"), "c remix")
    tr, rc = [], []
    for i in range(40):
        who, what = f"Performer Nr{chr(97 + i % 26)}{i}kru", f"Song{i}word Other{i}"
        tr.append((i, who, what, 2000, "x"))
        rc.append((str(i), f"{who} - {what}", "2000"))
        rc.append((str(100 + i), f"{who} - {what} (Live)", "2000"))
        rc.append((str(200 + i), f"{who} - {what}", "1980"))
        rc.append((str(300 + i), f"Someone Else{i}zzz - {what}", "2000"))
    tr += [(900, None, "x", None, "x"), (901, "A", " ", None, "x"), (0, *tr[0][1:])]
    rc += [("999", "no separator", ""), ("998", "", None)]
    t = spark.createDataFrame(tr, "id bigint, artist string, title string, year int, cls string")
    c = spark.createDataFrame(rc, "release_id string, title string, year string")
    got = {(r.track_id, r.release_id) for r in matching.matched(t, c).collect()}
    assert got == {(i, str(i)) for i in range(40)}
    assert matching.matched(t.limit(0), c).count() == 0


def test_survivors(spark):
    c = spark.createDataFrame([("g", 1, "flac", "likely lossy"), ("g", 2, "mp3", None), ("g", 3, "mp3", "CLEAN "), ("g", 3, "mp3", "CLEAN "), (None, 4, "mp3", None)], "group_key string, track_id bigint, fmt string, quality string")
    cols = "id bigint, format string, bitrate_kbps int, bit_depth int, sample_rate int, src_mtime bigint, discogs_meta_fetched_at bigint, user_edited boolean, added_at bigint, " + ", ".join(f"{x} string" for x in survivorship.TAGS)
    row = lambda i, f, b, title, genre: (i, f, b, None, 44100, 1000 * i, None, False, 1, title, "A", None, None, None, None, genre, None, "1999", None, None, None)
    t = spark.createDataFrame([row(1, "flac", 900, "T", None), row(2, "mp3", 320000, "T", "Dub"), row(3, "mp3", 192, "t ", "Jazz"), row(2, "mp3", 320000, "T", "Dub")], cols)
    got = survivorship.survivors(c, t).collect()
    assert len(got) == 1 and got[0].track_id == 2 and got[0].bitrate_kbps == 320 and got[0].title.lower().strip() == "t" and got[0].artist == "A" and got[0].album is None
    assert survivorship.survivors(c.limit(0), t).count() == 0


def test_truncation(spark):
    full = [f"The {a} was pressed in {b} last year. Nobody remembers who paid for the {c} batch." for a in ("record", "tape", "single") for b in ("Hask", "Vellin", "Lurein") for c in ("first", "second", "third")]
    cut_ = ["The record was pressed in Hask last ye", "The tape was pressed in Vellin last year. Nobody remembers who paid for the", "The single was pressed in Lurein last year. Nobody rem"]
    other = ["The record was pressed in Hask last year.", None, "", "   ", "It trails off…", "no stop but nobody remembers who paid for the first batch"]
    rows = [(i, t, "s", "x") for i, t in enumerate(full * 3 + cut_ + other)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, reason string")
    j = truncation.judged(d)
    n = len(full) * 3
    assert {r.doc_id for r in j.filter("truncated").collect()} == {n, n + 1, n + 2}
    assert truncation.rates(j).first().truncated_docs == 3 and truncation.judged(d.limit(0)).count() == 0
    p = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, "abd"), (4, "abcd")], "text_id bigint, text string")
    assert {(r.text_id, r.next_char) for r in truncation.prefixes_of_longer(p).collect()} == {(1, "d"), (4, "e")}


def test_matching_restores_all_pairs(spark):
    rng = random.Random(4)
    parts = ["jür", "señ", "grö", "fên", "té", "kü", "nô", "lav", "mor", "ßa", "ro", "dal"]
    filler = ["".join(rng.choice(parts) for _ in range(3)).capitalize() for _ in range(300)]
    titles = ["Туман окно", "Зима река", "Ночь мост", "砂時計", "Señal Größe"]
    pairs = [("cp1251", "cp1252", 1), ("koi8_r", "cp1252", 1), ("cp1251", "cp1252", 1), ("euc_jp", "cp1252", 1), ("cp1252", "cp1251", 1)]
    tr = [(1000 + i, "Noor Filler", w, 2001) for i, w in enumerate(filler + titles * 6)]
    tr += [(i, f"Performer{chr(97 + i)}kru", mojibake.garble(t, p), 2000) for i, (t, p) in enumerate(zip(titles, pairs))]
    rc = [(str(i), f"Performer{chr(97 + i)}kru - {t}", "2000") for i, t in enumerate(titles)]
    for i in range(40):
        tr.append((100 + i, f"Artist{i}x", f"Song{i}word Other{i}", 2000))
        rc += [(str(100 + i), f"Artist{i}x - Song{i}word Other{i}", "2000"), (str(200 + i), f"Someone{i}zzz - Song{i}word Other{i}", "2000")]
    t = spark.createDataFrame(tr, "id bigint, artist string, title string, year int")
    c = spark.createDataFrame(rc, "release_id string, title string, year string")
    got = {(r.track_id, r.release_id) for r in matching.matched(t, c).collect() if r.track_id < 100}
    assert got == {(i, str(i)) for i in range(len(titles))}


def test_truncation_by_last_sign(spark):
    full = [f"The {a} was pressed in {b} last year." for a in ("record", "tape", "single") for b in ("Hask", "Vellin", "Lurein")]
    cut_ = ["The tape was pressed in H�", "Cellarの新作は明るい一枚だ。低音が柔らかく響き、夜によく�", "It cost the shop about £", 'The label only said "', "The sleeve is graded VG+"]
    whole = ["It cost the shop about £20 in Hask.", "The sleeve is graded VG+plus by the shop.", 'The label only said "no".', "A fine tape. 🎶", "A fine sleeve, graded NM+", "(fine)", "「夜」"]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(full + cut_ + whole)], "doc_id bigint, text string, source string")
    n = len(full)
    assert {r.doc_id for r in truncation.judged(d).filter("truncated").collect()} == set(range(n, n + len(cut_)))


def test_names_of_frequent_words(spark):
    rng = random.Random(7)
    made = lambda: "".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(5))
    cells = [f"{made().capitalize()} Smith" for _ in range(names.RARE + 20)] + [f"R. {made().capitalize()}" for _ in range(3)]
    same = ["Robert Smith", "Bob Smith"]
    d = spark.createDataFrame([(c,) for c in cells + same + ["R. Smith", "Valentina Smith"]], "artist string")
    nodes = names.classes(d.selectExpr("'people' as kind", "artist as name", "1L as n")).groupBy("class", "kind").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    got = {frozenset((r.a.split("\t")[1], r.b.split("\t")[1])) for r in names.class_links(nodes).collect()}
    want = {frozenset(x) for x in [("robert smith", "bob smith"), ("robert smith", "r smith"), ("bob smith", "r smith")]}
    assert want <= got and not any("valentina smith" in x for x in got)


def test_summary_counts_each_row(spark):
    d = spark.createDataFrame([(1, "hello world", "a"), (1, "hello world", "a"), (2, "", "a"), (3, None, None)], "doc_id bigint, text string, source string")
    got = {r.source: (r.docs, r.empty_docs, r.tokens) for r in bpe.id_summary(d, "source").collect()}
    assert got == {"a": (3, 1, 4), None: (1, 1, 0)} and bpe.id_summary(d.limit(0), "source").count() == 0


def test_blocks_of_the_list_rank_as_the_whole(spark):
    st = spark.createDataFrame(list(enumerate(["House", "Haus", "Techno", "Tekno", "Velvet House"], 1)), "style_id int, style string")
    v = spark.createDataFrame([("haus!",), ("tekno!",), ("velvet",), ("hous",), ("zzzzzz",), (None,)], "val string")
    whole = {(r.val, r.style_id, r.distance) for r in styles.match_values(v, st).collect()}
    for block in (1, 2, 3):
        assert {(r.val, r.style_id, r.distance) for r in styles.match_values(v, st, block=block).collect()} == whole
    assert {("haus!", 2, 0), ("tekno!", 4, 0)} <= whole


def test_long_words_keep_their_evidence(spark):
    rng = random.Random(6)
    parts = ["jür", "señ", "grö", "fên", "té", "kü", "nô", "lav", "mor", "ßa", "ro", "dal"]
    clean = ["".join(rng.choice(parts) for _ in range(3)) for _ in range(300)]
    long = "".join(rng.choice(parts) for _ in range(120))
    assert len(long) > 2 * mojibake.WINDOW
    rows = [(i, w) for i, w in enumerate(clean)] + [(900, mojibake.garble(long, ("utf-8", "cp1252", 1))), (901, long)]
    got = {r.id: r.restored for r in mojibake.garbled_cells(spark.createDataFrame(rows, "id bigint, title string"), "id", ["title"]).collect()}
    assert got == {900: long}


def test_matching_splits_hot_titles(spark, monkeypatch):
    tr = [(i, f"Performer{i}kru Band{i % 7}", "Intro", 2000) for i in range(60)] + [(1000 + i, f"Artist{i}x", f"Song{i}word", 2000) for i in range(40)]
    rc = [(str(i), f"Performer{i}kru Band{i % 7} - Intro", "2000") for i in range(60)] + [(str(1000 + i), f"Artist{i}x - Song{i}word", "2000") for i in range(40)] + [(str(2000 + i), f"Artist{i}x - Song{i}word", "1970") for i in range(40)]
    t = spark.createDataFrame(tr, "id bigint, artist string, title string, year int")
    c = spark.createDataFrame(rc, "release_id string, title string, year string")
    rows = matching.described(t, c)
    _, classes = matching.recording_classes(rows)
    whole = {(r.t_cls, r.c_cls) for r in matching.candidate_pairs(classes).collect()}
    monkeypatch.setattr(matching, "HOT_PAIRS", 10)
    assert {(r.t_cls, r.c_cls) for r in matching.candidate_pairs(classes).collect()} == whole and len(whole) >= 100


def test_mixture_is_monotone_and_transitive(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    x = np.vstack([np.clip(rng.normal(0.95, 0.04, (300, 4)), 0, 1), np.clip(rng.normal(0.4, 0.2, (700, 4)), 0, 1)])
    g, model = matching.fit_mixture(x, np.ones(1000))
    assert (g[:300] > 0.5).mean() > 0.98 and (g[300:] < 0.5).mean() > 0.98 and 0.2 < model["share"] < 0.4
    best = matching.fit_mixture(np.vstack([x, np.ones((1, 4))]), np.ones(1001))[0]
    assert best[-1] >= best[:-1].max() - 1e-9
    pairs = [(1, 10, 0.99), (2, 10, 0.99), (2, 11, 0.99), (1, 11, 0.3), (3, 12, 0.6), (3, 13, 0.99), (4, 12, 0.99), (4, 13, 0.001)]
    scored = spark.createDataFrame(pd.DataFrame(pairs, columns=["tc", "rc", "g"])).withColumn("cell", F.lit(0))
    assert {(r.tc, r.rc): round(r.new, 2) for r in matching._transitive(scored).collect()} == {(1, 11): 0.99, (3, 12): 0.49}


def test_truncation_by_added_ellipsis(spark):
    full = [f"The {a} was pressed in {b} last year. Nobody remembers who paid for the {c} batch." for a in ("record", "tape", "single") for b in ("Hask", "Vellin", "Lurein") for c in ("first", "second", "third")]
    cut_ = ["The record was pressed in Hask last ye...", "The tape was pressed in Vellin last year. Nobody remem…"]
    whole = ["The record was pressed in Hask last year...", "The tape was pressed in Vellin last year…", "…", "..."]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(full * 2 + cut_ + whole)], "doc_id bigint, text string, source string")
    n = 2 * len(full)
    assert {r.doc_id for r in truncation.judged(d).filter("truncated").collect()} == {n, n + 1}


def test_truncation_prefix_of_a_longer_copy(spark):
    texts = ["zorvak melind prusted", "zorvak melind prusted quarnly over brel", "zorvak melind prus", "brel tanvo", "brel tanvo.", "dovin kess", "dovin kess\nNext Line"]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(50, texts[0], None)], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.judged(d).filter("reason = 'prefix'").collect()} == {0, 2, 50}


def test_short_forms_are_learnt(spark):
    rng = random.Random(11)
    made = lambda: "".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(5))
    given = ["robert", "valentina", "konstantin", "ximena", "orla", "tove"] + [made()[:6] for _ in range(30)]
    rows = []
    for k in range(500):
        family = made()
        g = given[k % len(given)]
        rows.append([g, family])
        if g == "robert":
            rows.append(["bob", family])
    rows += [["valentina", rows[0][1]], ["x", "y"], ["one"], []]
    d = spark.createDataFrame([(r,) for r in rows], "words array<string>")
    got = {(r.a, r.b) for r in names.short_forms(d).collect()}
    assert got == {("bob", "robert"), ("robert", "bob")}
    assert names.short_forms(d.limit(0)).count() == 0
    # a learnt form makes one person's names alike, and no other's
    cells = [" ".join(r).title() for r in rows if len(r) == 2 and len(r[0]) > 1]
    t = spark.createDataFrame([(c,) for c in cells], "artist string")
    pairs = {frozenset((r.name_a, r.name_b)) for r in names.name_pairs(names.linked_names(t, ["artist"], [], {})).collect()}
    want = {frozenset((f"Robert {f.title()}", f"Bob {f.title()}")) for g, f in (r for r in rows if len(r) == 2) if g == "bob"}
    assert pairs == want


def test_short_forms_of_family_names_with_many_given_names(spark):
    rng = random.Random(17)
    made = lambda n: "".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(n))
    given = sorted({made(3) for _ in range(100)})
    rows = []
    for k in range(300):
        family = made(6)
        rows += [[g, family] for g in rng.sample(given, 20)] + ([["bob", family], ["robert", family]] if k < 30 else [])
    few = [[g, family] for family in (made(6) for _ in range(60)) for g in rng.sample(given, 4)]
    for own in (rows, rows + few):
        d = spark.createDataFrame([(r,) for r in own], "words array<string>")
        assert {(r.a, r.b) for r in names.short_forms(d).collect()} >= {("bob", "robert"), ("robert", "bob")}


def test_names_of_families_with_many_given_names(spark):
    rng = random.Random(18)
    made = lambda n: "".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(n))
    given = sorted({made(3) for _ in range(100)})
    cells, want = [], set()
    for k in range(300):
        family = made(6)
        cells += [f"{g} {family}".title() for g in rng.sample(given, 20)]
        if k < 30:
            cells += [f"{g} {family}".title() for g in ("bob", "robert")]
            want.add((f"Bob {family.title()}", f"Robert {family.title()}"))
    t = spark.createDataFrame([(c,) for c in cells], "artist string")
    assert want <= {(r.name_a, r.name_b) for r in names.name_pairs(names.linked_names(t, ["artist"], [], {}, frozenset())).collect()}


def test_names_of_families_with_more_given_names_than_these_have_families(spark):
    rng = random.Random(19)
    made = lambda n: "".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(n))
    given = sorted({made(3) for _ in range(100)})
    rows = [[g, family] for family in (made(6) for _ in range(300)) for g in rng.sample(given, 20)]
    # bob and robert have fewer family names than each of these has given names
    large = [made(6) for _ in range(20)]
    rows += [[g, family] for family in large for g in [*rng.sample(given, 40), "bob", "robert"]]
    rows += [[g, family] for family in (made(6) for _ in range(90)) for g in rng.sample(given, 40)]
    d = spark.createDataFrame([(r,) for r in rows], "words array<string>")
    assert {(r.a, r.b) for r in names.short_forms(d).collect()} == {("bob", "robert"), ("robert", "bob")}
    t = spark.createDataFrame([(" ".join(r).title(),) for r in rows], "artist string")
    pairs = {(r.name_a, r.name_b) for r in names.name_pairs(names.linked_names(t, ["artist"], [], {}, frozenset())).collect()}
    assert {(f"Bob {f.title()}", f"Robert {f.title()}") for f in large} <= pairs
    # words that are alike in all are read both ways, none is left out
    ties = spark.createDataFrame([(["anna", "smith"],), (["smith", "anna"],), (["bert", "jones"],)], "words array<string>")
    read = names.sides_of(ties.select(F.sort_array("words").alias("w")).distinct())
    assert {(r.s, r.g) for r in read.collect()} == {("anna", "smith"), ("smith", "anna"), ("bert", "jones"), ("jones", "bert")}


def test_vocabulary_is_not_broadcast(spark):
    words = written(spark.createDataFrame([(w,) for w in ("harbour", "harbor", "harbours", "smith", "smyth")], "word string"))
    links = names.word_links(words)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert {("harbor", "harbour"), ("harbour", "harbours"), ("smith", "smyth")} <= {(r.a, r.b) for r in links.collect()}
    nodes = spark.createDataFrame([("people\tanna smith", "people", ["anna", "smith"], 2), ("people\tanna smyth", "people", ["anna", "smyth"], 1)], "class string, kind string, words array<string>, n bigint")
    assert names.class_links(nodes).count() == 2


def test_banding_recall_against_brute_force(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnoprstuvz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 13))) for _ in range(1500)]
    words = set(base)
    for w in base:
        for edits_ in (1, 2):
            x = list(w)
            for _ in range(edits_):
                k = rng.randrange(len(x))
                kind = rng.randrange(4)
                if kind == 0:
                    x[k] = rng.choice(letters)
                elif kind == 1:
                    del x[k]
                elif kind == 2:
                    x.insert(k, rng.choice(letters))
                elif k + 1 < len(x):
                    x[k], x[k + 1] = x[k + 1], x[k]
            words.add("".join(x))
    words = sorted(words)
    got = {(r.a, r.b) for r in names.word_links(spark.createDataFrame([(w,) for w in words], "word string").repartition(8)).collect()}
    by_distance = {1: [0, 0], 2: [0, 0]}
    # brute force over pairs that share a third of their letters' pairs would lose some: all pairs of the first 700 words
    part = words[:700]
    for i, a in enumerate(part):
        for b in part[i + 1 :]:
            d = names.edits(a, b, 2)
            if d <= names.word_limit(min(len(a), len(b))):
                by_distance[d][0] += 1
                by_distance[d][1] += (a, b) in got
    for d, (n, hit) in by_distance.items():
        assert n > 50 and hit >= 0.9 * n, (d, n, hit)


def test_label_words_are_learnt(spark):
    rng = random.Random(13)
    made = lambda: "".join(rng.choice("bdfgklmnprtvz") + rng.choice("aeiou") for _ in range(4)).title()
    stems = [made() for _ in range(12)]
    cells = [f"{x} {w}" for k, x in enumerate(stems) for w in (("Diskosan", "Zound Werks") if k % 2 else ("Zound Werks", "Diskosan Lmtd"))] + stems + ["Werks", "Grey Harbour", None, " "]
    d = spark.createDataFrame([("label", c) for c in cells if c and c.strip()], "kind string, name string")
    assert names.learnt_label_words(d) == {"diskosan", "werks", "zound", "lmtd"} and names.learnt_label_words(d.limit(0)) == frozenset()
    assert names.name_words("Grey Werks", "label", {"werks"}) == ["grey"] and names.name_words("Werks", "label", {"werks"}) == ["werks"]
