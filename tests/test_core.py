import importlib
import pkgutil
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from crateline.functions import dsp, keys, text
from crateline.operators import duplicates, playlists, series, state
from crateline.plans import queries, registry  # noqa: F401
from crateline.sources.files import device_export


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_key_notation(spark):
    k = [(0, True, "8B", "1d", "C"), (9, False, "8A", "1m", "Am"), (7, True, "9B", "2d", "G"), (4, False, "9A", "2m", "Em"), (9, True, "11B", "4d", "A"), (6, False, "11A", "4m", "F#m")]
    df = spark.createDataFrame(k, "t int, m boolean, c string, o string, n string")
    for r in df.select("*", keys.camelot(F.col("t"), F.col("m")).alias("x"), keys.open_key(F.col("t"), F.col("m")).alias("y"), keys.key_name(F.col("t"), F.col("m")).alias("z")).collect():
        assert (r.x, r.y, r.z) == (r.c, r.o, r.n)


@pytest.mark.parametrize("stem, want", [("Barker - Birmingham Screwdriver", ("Barker", "Birmingham Screwdriver")), ("01 - Barker - Cascade Effect", ("Barker", "Cascade Effect")), ("01 - 07 - SCSI-9 - 303 Views", ("SCSI-9", "303 Views")), ("01 - Elevation", (None, "Elevation")), ("01 Destiny", (None, "Destiny")), ("Sentient", (None, "Sentient"))])
def test_filename(spark, stem, want):
    a, t = text.parse_filename(F.lit(stem))
    r = one(spark, a.alias("a"), t.alias("t"))
    assert (r.a, r.t) == want


def test_scalars(spark):
    r = one(
        spark, text.norm_match(F.lit("Club Styling Volume Two")).alias("a"), text.norm_match(F.lit("Club Styling Vol. 2")).alias("b"), text.youtube_id(F.lit("https://www.youtube.com/watch?t=9&v=xyz789")).alias("y"), text.youtube_id(F.lit("https://vimeo.com/1")).alias("v"),
        text.price(F.lit(24.4), F.lit("USD")).alias("p"), text.price(F.lit(9.5), F.lit("SEK")).alias("q"), text.version_newer(F.lit("1.0.1"), F.lit("1")).alias("n"), text.version_newer(F.lit("1"), F.lit("1.0.0")).alias("m"), text.version_newer(F.lit("x"), F.lit("1")).alias("g"),
        text.metadata_stem(F.lit("AC/DC"), F.lit("Who Made Who?")).alias("s"), text.nfc(F.lit("Liège Trinité")).alias("f"), text.percent_encoded(F.lit("a b&c")).alias("e"), text.moved(F.lit("/Music/Old/x"), "/Music/Old", "/L").alias("w"), text.moved(F.lit("/Music/OldStuff/x"), "/Music/Old", "/L").alias("w2"), text.parse_year(F.lit("1999-05")).alias("yr"), text.head_number(F.lit("3/12")).alias("h"),
    )
    assert r.a == r.b and r.y == "xyz789" and r.v is None and r.p == "$24.40" and r.q == "9.50 SEK" and r.n and not r.m and not r.g
    assert r.s == "AC-DC - Who Made Who-" and r.f == "Liège Trinité" and r.e == "a%20b%26c" and r.w == "/L/x" and r.w2 is None and r.yr == 1999 and r.h == 3


def test_components_and_near(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9), (5, 5)], "a bigint, b bigint")
    assert {(r.id, r.component) for r in duplicates.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}
    assert duplicates.components(e.limit(0)).count() == 0
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 30)
    bits = list(map(int, base)) + [int(x) ^ 0b1011 for x in base] + [int(base[0])]
    df = spark.createDataFrame(list(enumerate(bits)), "id bigint, bits bigint")
    got = {(r.a, r.b) for r in duplicates.near_signatures(df, "id", 5).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if bin((bits[i] ^ bits[j]) & (2**64 - 1)).count("1") <= 5} | {(0, 60)}
    assert got == want


def test_replace_and_move(spark):
    rows = spark.createDataFrame([("A", 2, 0), ("A", 30, 1), ("A", 3, 2), ("B", 30, 0), ("B", 40, 1), ("B", 2, 2)], "l string, i int, p int")
    subs = spark.createDataFrame([(30, 40)], "drop int, keep int")
    got = {}
    for r in playlists.replaced(rows, "l", "i", "p", subs).collect():
        got.setdefault(r.l, {})[r.position] = r.i
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {"A": [2, 40, 3], "B": [40, 2]}


def test_relink(spark):
    rows = spark.createDataFrame([(1, "/A/x"), (2, "/B/x"), (3, "/A/y"), (4, "/AB/z")], "id bigint, path string")
    assert {(r.id, r.status) for r in state.relink_plan(rows, "path", "/A", "/B").collect()} == {(1, "skipped"), (3, "moved")}


def test_beats(spark):
    g = spark.createDataFrame([(1, 120.0, 250, 1), (2, None, 0, 1)], "track_id bigint, bpm double, beat_offset_ms bigint, first_beat_number int")
    b = sorted((r.at_ms, r.in_bar) for r in series.beats_in_window(g, 4000).collect())
    assert [x for x, _ in b] == [250 + 500 * k for k in range(8)] and [y for _, y in b][:5] == [1, 2, 3, 4, 1]


def test_kernels():
    rate = 44100
    t = np.arange(rate * 20) / rate
    a = dsp.analysed(np.sin(2 * np.pi * 440 * t).astype(np.float32), rate)
    assert int(np.argmax(dsp.chroma(dsp.spectrogram(np.sin(2 * np.pi * 440 * t)), rate))) == 9 and a["error"] is None
    for bpm in (90, 128, 140):
        x = np.zeros(rate * 30)
        for k in range(int(30 * bpm / 60)):
            at = int(k * 60 / bpm * rate)
            x[at : at + 400] += np.random.default_rng(k).normal(size=len(x[at : at + 400]))
        got, _ = dsp.tempo(dsp.onsets(dsp.spectrogram(x)), rate / dsp.HOP)
        assert abs(got - bpm) < 1.0, (bpm, got)
    f = np.random.default_rng(0).integers(0, 1 << 24, 200)
    assert dsp.bit_error_rate(f, f) == 0 and dsp.bit_error_rate(f[20:], f) == 0 and dsp.bit_error_rate(f[:79], f) is None
    assert dsp.bit_error_rate(f, np.random.default_rng(1).integers(0, 1 << 24, 200)) > 0.4


def test_device_export():
    with pytest.raises(ValueError):
        device_export(b"plain text")
    size = 512
    head = struct.pack("<IIIIIII", 0, size, 1, 0, 0, 0, 0) + struct.pack("<IIII", 8, 0, 1, 1)
    page = bytearray(size)
    struct.pack_into("<III", page, 0, 0, 1, 8)
    page[0x18] = 1
    struct.pack_into("<III", page, 0x28, 3, 77, 5)
    struct.pack_into("<H", page, size - 4, 1)
    struct.pack_into("<H", page, size - 6, 0)
    assert device_export(head.ljust(size, b"\0") + bytes(page))["entries"] == [{"playlist_id": 5, "position": 3, "track_id": 77}]


@pytest.mark.parametrize("name", ["library_view", "mapinpandas_features", "stream_incremental_upsert", "file_listing_signatures", "p5_found"])
def test_queries_run(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_core_imports_without_extras():
    import crateline

    for m in pkgutil.walk_packages(crateline.__path__, "crateline."):
        if not m.name.startswith("crateline.llm"):
            importlib.import_module(m.name)


def test_linkage_reaches_every_document(spark, data):
    docs = {r[0] for r in spark.read.parquet(f"{data}/release_json.parquet").select("release_id").distinct().collect()}
    named = {r[0] for r in spark.read.parquet(f"{data}/release_candidates.parquet").filter("trim(title) <> ''").select("release_id").distinct().collect()}
    got = registry.QUERIES["linkage_all_documents"](spark, data).collect()
    assert {r.row_id for r in got if r.how == "id"} == docs & named and any(int(x) % 2 for x in docs & named)
    assert all(r.record_id not in docs for r in got if r.how == "text")


def test_scan_merge_of_whole_library(spark, data):
    ids = {r[0] for r in spark.read.parquet(f"{data}/tracks.parquet").filter("id is not null").select("id").distinct().collect()}
    got = registry.QUERIES["upsert_oldest_newest"](spark, data).collect()
    assert len(got) == len(ids) and {r.id for r in got} == ids and {r.status for r in got} <= {"unchanged", "updated"}


def test_acoustic_groups(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 12)]
    rows = [(i, int(rng.integers(0, 60_000)), None, f"A{i}", f"T{i}") for i in range(120)]
    flips = [sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 9), replace=False)) for _ in rows]
    bits = [base[i % 12] ^ f for i, f in enumerate(flips)]
    rows += [(200, 1000, "f", "X", "Y"), (201, 1000, "f", "Z", "W"), (300, 0, None, "Q", "q"), (301, 9, None, "q ", "Q")]
    bits += [base[0] ^ (1 << 62), base[0] ^ (1 << 62), 2**62, 2**62]
    t = spark.createDataFrame(rows, "id bigint, duration_ms bigint, fingerprint string, artist string, title string")
    s = spark.createDataFrame([(r[0], b) for r, b in zip(rows, bits)], "id bigint, bits bigint")
    root = {r[0]: r[0] for r in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(rows)):
        for j in range(i):
            if abs(rows[i][1] - rows[j][1]) <= 15_000 and bin((bits[i] ^ bits[j]) & (2**64 - 1)).count("1") <= 11:
                root[find(rows[i][0])] = find(rows[j][0])
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append(r[0])
    want = {"acoustic\x1f" + ",".join(map(str, sorted(g))) for g in groups.values() if len(g) > 1 and sorted(g) not in ([200, 201], [300, 301])}
    got = {r.group_key for r in duplicates.report(t, spark.createDataFrame([], "group_key string"), s).filter("kind = 'acoustic'").collect()}
    assert got == want and len(want) > 5
    partners = {r.id: r.partners for r in duplicates.band_partners_all(t, "id", "duration_ms", 15_000).collect()}
    assert partners == {a[0]: n for a in rows if (n := sum(abs(a[1] - b[1]) <= 15_000 for b in rows) - 1)}


def test_beats_to_the_end(spark):
    g = spark.createDataFrame([(1, 120.0, 250, 2), (2, None, 0, 1), (3, 120.0, 9000, 1), (4, 120.0, 0, 1), (5, 120.0, 500, None)], "track_id bigint, bpm double, beat_offset_ms bigint, first_beat_number int")
    n = spark.createDataFrame([(1, 30_250), (2, 5000), (3, 9499), (4, None), (5, 400)], "track_id bigint, duration_ms int")
    got = {}
    for r in series.beats_of_track(g, n).collect():
        got.setdefault(r.track_id, {})[r.beat] = (r.at_ms, r.in_bar)
    assert got == {1: {k: (250 + 500 * k, (1 + k) % 4 + 1) for k in range(61)}, 3: {0: (9000, 1)}}
