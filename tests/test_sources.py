import struct
import wave

import numpy as np
import pytest

from crateline.sources import audio, files


def id3(**frames):
    body = b"".join(k.encode() + struct.pack(">I", len(v.encode()) + 1) + b"\0\0" + b"\3" + v.encode() for k, v in frames.items())
    n = len(body)
    return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def write_wav(path, x, width=2, channels=1, rate=8000, extra=b""):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.asarray(x).reshape(-1)
        if width == 3:
            v = (scaled * (2**23 - 1)).astype(np.int32)
            w.writeframes(np.stack([v & 255, v >> 8 & 255, v >> 16 & 255], axis=1).astype(np.uint8).tobytes())
        else:
            w.writeframes((scaled * (2**15 - 1)).astype("<i2").tobytes())
    if extra:
        with open(path, "ab") as f:
            f.write(extra)


def write_aiff(path, x, rate=8000):
    mantissa = rate << (63 - (rate.bit_length() - 1))
    comm = struct.pack(">hIh", 1, len(x), 16) + struct.pack(">HQ", 16383 + rate.bit_length() - 1, mantissa)
    sound = struct.pack(">II", 0, 0) + (np.asarray(x) * 32767).astype(">i2").tobytes()
    body = b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(sound)) + sound
    path.write_bytes(b"FORM" + struct.pack(">I", len(body)) + body)


def write_flac(path):
    info = bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + bytes(16)
    notes = [b"TITLE=Lie\xcc\x80ge", b"artist=Mira", b"BPM=128", b"DATE=1999-05-01"]
    c = struct.pack("<I", 0) + struct.pack("<I", len(notes)) + b"".join(struct.pack("<I", len(n)) + n for n in notes)
    path.write_bytes(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + len(c).to_bytes(3, "big") + c)


def write_mp3(path, tags=b"", trailer=b"", frames=100):
    head = bytes([0xFF, 0xFB, 0x90, 0x00])  # 128 kbps, 44.1 kHz, stereo
    path.write_bytes(tags + (head + bytes(413)) * frames + trailer)


@pytest.fixture
def folder(tmp_path):
    x = np.sin(np.linspace(0, 900, 16000)) * 0.5
    (tmp_path / "deep").mkdir()
    tag = id3(TIT2="Harbour", TPE1="Mira", TBPM="127.5")
    write_wav(tmp_path / "deep" / "a.wav", x, extra=b"id3 " + struct.pack("<I", len(tag)) + tag)
    write_wav(tmp_path / "01 - Some One - Some Song.WAV", np.stack([x, -x], axis=1), channels=2, width=3)
    write_aiff(tmp_path / "b.aif", x)
    write_flac(tmp_path / "c.flac")
    v1 = b"TAG" + b"Old Title".ljust(30, b"\0") + b"Old Artist".ljust(30, b"\0") + b"".ljust(30, b"\0") + b"1987" + bytes(31)
    write_mp3(tmp_path / "d.mp3", id3(TALB="Long Player"), v1)
    (tmp_path / "e.mp3").write_bytes(b"nothing of a sound")
    (tmp_path / "f.txt").write_text("no sound")
    return tmp_path


def test_scan(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.scan(audio.sounds_below(spark, str(folder), str(folder / "b.aif"))).collect()}
    assert set(got) == {"a.wav", "01%20-%20Some%20One%20-%20Some%20Song.WAV", "b.aif", "c.flac", "d.mp3", "e.mp3"} or set(got) == {"a.wav", "01 - Some One - Some Song.WAV", "b.aif", "c.flac", "d.mp3", "e.mp3"}
    a, named = got["a.wav"], next(r for n, r in got.items() if n.startswith("01"))
    assert (a.title, a.artist, a.bpm, a.sample_rate, a.duration_ms, a.format, a.error) == ("Harbour", "Mira", "127.5", 8000, 2000, "wav", None)
    assert (named.artist, named.title, named.channels, named.bit_depth) == ("Some One", "Some Song", 2, 24)
    assert (got["b.aif"].format, got["b.aif"].sample_rate, got["b.aif"].duration_ms, got["b.aif"].title) == ("aiff", 8000, 2000, "b")
    assert (got["c.flac"].title, got["c.flac"].date, got["c.flac"].duration_ms) == ("Liège", "1999-05-01", 2000)
    d = got["d.mp3"]
    assert (d.title, d.album, d.date, d.bitrate_kbps) == ("Old Title", "Long Player", "1987", 128) and abs(d.duration_ms - 2612) < 15
    assert got["e.mp3"].error and got["e.mp3"].title is None


def test_decoded_and_marks(spark, folder):
    rate, x = audio.decoded(str(folder / "deep" / "a.wav"))
    assert rate == 8000 and x.shape == (16000, 1) and abs(np.abs(x).max() - 0.5) < 0.01
    _, stereo = audio.decoded(str(folder / "01 - Some One - Some Song.WAV"))
    assert stereo.shape == (16000, 2) and np.abs(audio.mono(stereo)).max() < 1e-3 and len(audio.mono(stereo, 10)) == 10
    _, y = audio.decoded(str(folder / "b.aif"))
    assert np.allclose(x[:, 0], y[:, 0], atol=1e-3)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.wav_audio(spark, str(folder), 100).collect()}
    assert len(rows) == 3 and all(len(r.samples) == 100 and r.error is None for r in rows.values())
    mark = audio.content_mark(str(folder / "d.mp3"), 5)
    write_mp3(folder / "g.mp3", id3(TALB="Another Name Of It"), (folder / "d.mp3").read_bytes()[-128:], 100)
    assert len(mark) == 16 and mark != audio.content_mark(str(folder / "d.mp3"), 6)
    big = folder / "h.mp3"
    write_mp3(big, b"", b"x" * 128, 1000)
    one = audio.content_mark(str(big), 5)
    write_mp3(big, id3(TIT2="Tagged"), b"y" * 128, 1000)
    assert one == audio.content_mark(str(big), 5)


def test_changed(spark):
    stored = spark.createDataFrame([("/a", 1, 5), ("/b", 1, None), ("/c", 2, 5)], "path string, src_size bigint, src_mtime bigint")
    seen = spark.createDataFrame([("/a", 1, 5), ("/b", 1, 5), ("/c", 3, 5), ("/d", 1, 1)], "path string, length bigint, mtime bigint")
    assert {r.path for r in files.changed(stored, seen).collect()} == {"/b", "/c", "/d"}


def test_answers_and_settings(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"pagination": {"page": 1, "pages": 2}, "results": [{"id": 7, "type": "master", "title": "x"}, {"id": 8, "type": "release", "title": "Mira - Harbour", "year": "1999", "label": ["L", "M"], "format": ["Vinyl", "LP"]}, {"id": 9, "type": "release", "title": "y"}]}')
    got = files.search_answers(spark, str(tmp_path / "page.json"), 1).collect()
    assert [(r.release_id, r.label, r.format, r.place) for r in got] == [("8", "L", "Vinyl, LP", 1)]
    assert (files.next_page(1, 2), files.next_page(2, 2), files.next_page(None, None)) == (2, None, None)
    assert [files.retry_wait(k) for k in range(4)] == [2.0, 4.0, 6.0, None] and files.retry_wait(0, "9") == 9.0
    (tmp_path / "s.toml").write_text('theme = "dark"\nsize = "big"\nown = 3\n')
    assert files.settings(str(tmp_path / "s.toml"), {"theme": "light", "size": 4}) == {"theme": "dark", "size": 4, "own": 3} and files.settings(None, {"a": 1}) == {"a": 1}
    stick = tmp_path / "stick" / "PIONEER" / "rekordbox"
    stick.mkdir(parents=True)
    (stick / "export.pdb").write_bytes(b"")
    assert files.device_databases([str(tmp_path / "stick"), str(tmp_path)]) == [str(stick / "export.pdb")]


def page_of(kind, rows, size=4096):
    page = bytearray(size)
    struct.pack_into("<III", page, 0, 0, 1, kind)
    page[0x18] = len(rows)
    at = 0
    for k, row in enumerate(rows):
        page[0x28 + at : 0x28 + at + len(row)] = row
        struct.pack_into("<H", page, size - 6 - 2 * k, at)
        at += len(row)
    struct.pack_into("<H", page, size - 4, (1 << len(rows)) - 1)
    return struct.pack("<IIIIIII", 0, size, 1, 0, 0, 0, 0) + struct.pack("<IIII", kind, 0, 1, 1), bytes(page), size


def short(s):
    return bytes([2 * (len(s) + 1) + 1]) + s.encode()


def test_device_tables(spark, tmp_path):
    track = bytearray(0x88)
    struct.pack_into("<I", track, 0x48, 42)
    struct.pack_into("<H", track, 0x86, 0x88)
    wide = "Über".encode("utf-16-le")
    rows = {0: [bytes(track) + short("/Contents/a.mp3")], 7: [struct.pack("<IIIII", 0, 0, 1, 5, 1) + short("Crate"), struct.pack("<IIIII", 5, 0, 2, 6, 0) + b"\x90" + struct.pack("<H", 4 + len(wide)) + b"\0" + wide]}
    for kind, name in ((0, "tracks"), (7, "playlists")):
        head, page, size = page_of(kind, rows[kind])
        data = head.ljust(size, b"\0") + page
        got = files.device_export(data)[name]
        (tmp_path / f"{name}.pdb").write_bytes(data)
        if kind == 0:
            assert got == [{"id": 42, "path": "/Contents/a.mp3"}]
        else:
            assert [(r["id"], r["parent_id"], r["is_folder"], r["name"]) for r in got] == [(5, 0, True, "Crate"), (6, 5, False, "Über")]
    tracks, playlists, entries = files.device_exports(spark, str(tmp_path / "*.pdb"))
    assert tracks.count() == 1 and playlists.count() == 2 and entries.count() == 0
    with pytest.raises(ValueError):
        files.device_export(bytes(16))
