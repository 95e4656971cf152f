from crateline.operators.values import PEOPLE, WRITERS, split_values, style_rule

S = "id bigint, artist string, genre string, composer string, remixer string, album_artist string, pos string, val string"


def rows(spark, cells, field="artist"):
    names = [("Ann Bee", None), ("Carl Dent", None), ("Ann Foe", None), ("Carl Gum", None), ("The Old Trio", None), ("The New Trio", None), ("Mono", None), ("Poly", None)]
    data = [(1000 + i, n, None, None, None, None, "x", "y") for i, (n, _) in enumerate(names)]
    data += [(i, *[c if f == field else None for f in ("artist", "genre", "composer")], None, None, "x", "y") for i, c in enumerate(cells)]
    return spark.createDataFrame(data, S)


def found(spark, cells, field="artist", rule=PEOPLE):
    out = {}
    for r in split_values(rows(spark, cells, field), "id", {field: rule}, ["remixer", "album_artist"] + (["artist"] if field != "artist" else [])).collect():
        if r.id < 1000:
            out.setdefault(r.id, {})[r.pos] = r.val
    return {i: [v[k] for k in sorted(v)] for i, v in out.items()}


def test_people(spark):
    cells = ["Ann Bee & Carl Dent", '"Ann Bee"; "Dent, Carl"', "Mono feat. Poly;;", "Bell, Book, Candle", "Bell, Book, Candle / Mono", "Old Trio, The", "Dent, Carl", "  ", None, "Mono |", "Mono + Mono", "Mono\\\\Poly\nAnn Bee", "Mono and Poly"]
    got = found(spark, cells)
    assert got[0] == ["Ann Bee", "Carl Dent"] and got[1] == ["Ann Bee", "Dent, Carl"] and got[2] == ["Mono", "Poly"]
    assert 3 not in got and got[4] == ["Bell, Book, Candle", "Mono"]
    assert 5 not in got and 6 not in got and 7 not in got and 8 not in got and 9 not in got
    assert got[10] == ["Mono", "Mono"] and got[11] == ["Mono", "Poly", "Ann Bee"] and got[12] == ["Mono", "Poly"]


def test_placeholder_characters_survive(spark):
    odd = "0; Mono; 0"
    assert found(spark, [odd])[0] == ["0", "Mono", "0"]


def test_styles_and_long_cells(spark):
    rule = style_rule(["Drum & Brass", "Hymn, March & Brass", "Dub/Steady"])
    long = "; ".join(f"style {i}" for i in range(3000))
    got = found(spark, ["Hymn, March & Brass, Funk", "dub/steady/House", "Rock & Drum & Brass", long], "genre", rule)
    assert got[0] == ["Hymn, March & Brass", "Funk"] and got[1] == ["dub/steady", "House"] and got[2] == ["Rock", "Drum & Brass"] and len(got[3]) == 3000


def test_writers(spark):
    got = found(spark, ["Dent, Carl; Bee, Ann", "A. Bee - C. Dent", "Bee, Ann"], "composer", WRITERS)
    assert got == {0: ["Dent, Carl", "Bee, Ann"], 1: ["A. Bee", "C. Dent"]}


def test_empty_table_and_repeats(spark):
    e = rows(spark, []).limit(0)
    assert split_values(e, "id", {"artist": PEOPLE}, []).count() == 0
    twice = rows(spark, ["Mono & Poly"])
    assert split_values(twice.unionByName(twice), "id", {"artist": PEOPLE}, []).filter("id < 1000").count() == 2
