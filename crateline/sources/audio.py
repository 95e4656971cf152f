"""Sound files: properties, samples and tags of RIFF, AIFF, FLAC and MPEG files, read where they lie.

A task opens one file after the other and reads only what it needs of each: headers, tags, the end. Paths are local or in a
file system that the executors have mounted. A file that can't be read has a row with its error.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .files import AUDIO, TAIL, listing

#: Bytes at a file's end that may hold a trailer of tags.
TRAILER = 128
# The fields' names in the tags of each kind of file.
FRAMES = {
    "TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album_artist", "TCON": "genre", "TDRC": "date", "TYER": "date", "TBPM": "bpm", "TKEY": "initial_key", "COMM": "comment", "TPUB": "label", "TRCK": "track", "TCOM": "composer", "TPE4": "remixer", "TCMP": "compilation",
}
INFO = {"INAM": "title", "IART": "artist", "IPRD": "album", "IGNR": "genre", "ICRD": "date", "ICMT": "comment"}
COMMENTS = {
    "TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "ALBUMARTIST": "album_artist", "GENRE": "genre", "DATE": "date", "BPM": "bpm", "INITIALKEY": "initial_key", "COMMENT": "comment", "LABEL": "label", "ORGANIZATION": "label", "TRACKNUMBER": "track", "COMPOSER": "composer",
    "REMIXER": "remixer", "COMPILATION": "compilation",
}
FIELDS = ["title", "artist", "album", "album_artist", "genre", "date", "bpm", "initial_key", "comment", "label", "track", "composer", "remixer", "compilation"]
# Kbps and Hz by the header of an MPEG layer 3 frame (version 1; version 2), samples of a frame.
KBPS = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass
class Sound:
    """What a file says of itself. ``data``: where uncompressed samples lie (offset, bytes)."""

    sample_rate: int | None = None
    channels: int | None = None
    bit_depth: int | None = None
    frames: int | None = None
    kbps: int | None = None
    data: tuple[int, int] | None = None
    big_endian: bool = False
    floats: bool = False
    has_cover: bool = False
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def duration_ms(self) -> int | None:
        return None if not self.sample_rate or self.frames is None else self.frames * 1000 // self.sample_rate

    def note(self, name: str, value: str) -> None:
        if value.strip():
            self.tags.setdefault(name, value.strip())


def _chunks(f: BinaryIO, big_endian: bool) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset, size) of the chunks behind a 12-byte head; a size beyond the end is cut."""
    end = f.seek(0, os.SEEK_END)
    at = 12
    while at + 8 <= end:
        f.seek(at)
        name, size = struct.unpack(">4sI" if big_endian else "<4sI", f.read(8))
        size = min(size, end - at - 8)
        yield name, at + 8, size
        at += 8 + size + size % 2


def _extended(b: bytes) -> int:
    """An 80-bit float as whole number."""
    exponent, mantissa = struct.unpack(">HQ", b)
    return mantissa >> max(16383 + 63 - (exponent & 0x7FFF), 0)


def _frame_text(b: bytes) -> str:
    kind, body = b[:1], b[1:]
    codec = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(kind, "latin-1")
    return body.decode(codec, "replace").replace("\0", "; ").strip("; ")


def _read_frames(b: bytes, s: Sound) -> int:
    """Tags of a frame header at the start of ``b``; how many bytes it takes (0: there is none)."""
    if b[:3] != b"ID3" or len(b) < 10:
        return 0
    seven = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    version, size = b[3], seven(b[6:10])
    at, end = 10, min(10 + size, len(b))
    while version in (3, 4) and at + 10 <= end and b[at : at + 1].isalnum():
        name = b[at : at + 4].decode("latin-1")
        n = seven(b[at + 4 : at + 8]) if version == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
        body = b[at + 10 : min(at + 10 + n, end)]
        if name == "APIC":
            s.has_cover = True
        elif name == "COMM" and len(body) > 4:
            wide = body[0] in (1, 2)
            head, gap, rest = body[4:].partition(b"\0\0" if wide else b"\0")
            s.note("comment", _frame_text(body[:1] + (rest if gap else head)))
        elif name in FRAMES and body:
            s.note(FRAMES[name], _frame_text(body))
        at += 10 + n
    return 10 + size


def _read_riff(f: BinaryIO, s: Sound, aiff: bool) -> None:
    for name, at, size in _chunks(f, aiff):
        f.seek(at)
        if name == b"fmt ":
            kind, s.channels, s.sample_rate, _, _, s.bit_depth = struct.unpack("<HHIIHH", f.read(16))
            s.floats = kind == 3
        elif name == b"COMM":
            s.channels, s.frames, s.bit_depth = struct.unpack(">hIh", f.read(8))
            s.sample_rate = _extended(f.read(10))
            s.big_endian = True
        elif name == b"data":
            s.data = (at, size)
        elif name == b"SSND":
            s.data = (at + 8, size - 8)
        elif name in (b"id3 ", b"ID3 "):
            _read_frames(f.read(size), s)
        elif name == b"LIST" and f.read(4) == b"INFO":
            block = f.read(size - 4)
            k = 0
            while k + 8 <= len(block):
                n = int.from_bytes(block[k + 4 : k + 8], "little")
                key = INFO.get(block[k : k + 4].decode("latin-1"))
                if key:
                    s.note(key, block[k + 8 : k + 8 + n].split(b"\0")[0].decode("utf-8", "replace"))
                k += 8 + n + n % 2
    if s.channels and s.bit_depth and s.data:
        s.frames = s.data[1] // (s.channels * (s.bit_depth // 8))


def _read_flac(f: BinaryIO, s: Sound) -> None:
    f.seek(4)
    last = False
    while not last:
        head = f.read(4)
        if len(head) < 4:
            return
        last, kind, size = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        body = f.read(size)
        if kind == 0 and len(body) >= 18:
            packed = int.from_bytes(body[10:18], "big")
            s.sample_rate, s.channels, s.bit_depth, s.frames = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        elif kind == 4:
            at = 4 + int.from_bytes(body[:4], "little")
            for _ in range(int.from_bytes(body[at : at + 4], "little")):
                at += 4
                n = int.from_bytes(body[at : at + 4], "little")
                key, _, value = body[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
                if key.upper() in COMMENTS:
                    s.note(COMMENTS[key.upper()], value)
                at += n
        elif kind == 6:
            s.has_cover = True


def _read_mpeg(f: BinaryIO, s: Sound, head: bytes, size: int) -> None:
    skip = _read_frames(head, s)
    if skip > len(head) - 4096:
        f.seek(0)
        head = f.read(skip + 4096)
        s.tags.clear()
        _read_frames(head, s)
    f.seek(max(size - TRAILER, 0))
    tail = f.read(TRAILER)
    trailer = tail[:3] == b"TAG"
    if trailer:
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("date", 93, 97)):
            s.note(name, tail[lo:hi].split(b"\0")[0].decode("latin-1"))
    for at in range(skip, len(head) - 4):
        if head[at] == 0xFF and head[at + 1] & 0xE6 == 0xE2:  # layer 3
            version, k, r = head[at + 1] >> 3 & 3, head[at + 2] >> 4, head[at + 2] >> 2 & 3
            if version == 1 or k in (0, 15) or r == 3:
                continue
            s.sample_rate, s.channels = RATES[version][r], 1 if head[at + 3] >> 6 == 3 else 2
            s.kbps = KBPS[3 if version == 3 else 2][k]
            samples = 1152 if version == 3 else 576
            counted = max(head.find(b"Xing", at, at + 200), head.find(b"Info", at, at + 200))
            if counted > 0 and head[counted + 7] & 1:
                s.frames = int.from_bytes(head[counted + 8 : counted + 12], "big") * samples
            else:
                s.frames = (size - skip - (TRAILER if trailer else 0)) * 8 * s.sample_rate // (s.kbps * 1000)
            return


def read_sound(path: str) -> Sound:
    """Properties and tags of a file; ValueError if it is of no known kind."""
    s = Sound()
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(65536)
        if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
            _read_riff(f, s, False)
        elif head[:4] == b"FORM" and head[8:12] == b"AIFF":
            _read_riff(f, s, True)
        elif head[:4] == b"fLaC":
            _read_flac(f, s)
        else:
            _read_mpeg(f, s, head, size)
    if not s.sample_rate:
        raise ValueError("no sound found: likely a truncated or incomplete file")
    if s.kbps is None and s.duration_ms:
        s.kbps = round(size * 8 / s.duration_ms)
    return s


def decoded(path: str) -> tuple[int, np.ndarray]:
    """(sample rate, samples as (frames, channels) floats) of an uncompressed file; ValueError for others."""
    s = read_sound(path)
    if s.data is None or not s.channels or not s.bit_depth:
        raise ValueError("compressed sound can't be decoded here")
    with open(path, "rb") as f:
        f.seek(s.data[0])
        raw = f.read(s.data[1])
    width, order = s.bit_depth // 8, ">" if s.big_endian else "<"
    raw = raw[: len(raw) // (width * s.channels) * width * s.channels]
    if s.floats:
        x = np.frombuffer(raw, dtype=f"{order}f{width}").astype(np.float32)
    elif width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)[:, :: -1 if s.big_endian else 1].astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = (x / float(1 << 23)).astype(np.float32)
    elif width == 1 and not s.big_endian:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    else:
        x = (np.frombuffer(raw, dtype=f"{order}i{width}") / float(1 << (8 * width - 1))).astype(np.float32)
    return s.sample_rate, x.reshape(-1, s.channels)


def mono(x: np.ndarray, most: int | None = None) -> np.ndarray:
    """The mean of the channels of the first ``most`` frames (all by default)."""
    return x[:most].mean(axis=1)


def content_mark(path: str, duration_ms: int | None) -> str:
    """16 hex digits of the duration and the file's end without a trailer: the same after a move or new tags at the start."""
    size = os.path.getsize(path)
    end = max(size - TRAILER, 0)
    with open(path, "rb") as f:
        f.seek(max(end - TAIL, 0))
        tail = f.read(end - max(end - TAIL, 0))
    return hashlib.blake2b(str(duration_ms).encode() + b"/" + tail, digest_size=8).hexdigest()


SCAN = "path string, length bigint, mtime bigint, format string, sample_rate int, bit_depth int, channels int, duration_ms bigint, bitrate_kbps int, has_cover boolean, fingerprint string, untagged boolean, " + ", ".join(f"{c} string" for c in FIELDS) + ", error string"


def _scanned(path: str, length: int, mtime: int, fmt: str) -> dict:
    local = path.removeprefix("file://").removeprefix("file:")
    row: dict = {"path": path, "length": length, "mtime": mtime, "format": fmt}
    try:
        s = read_sound(local)
        row |= {"sample_rate": s.sample_rate, "bit_depth": s.bit_depth, "channels": s.channels, "duration_ms": s.duration_ms, "bitrate_kbps": s.kbps, "has_cover": s.has_cover, "fingerprint": content_mark(local, s.duration_ms), "untagged": not s.tags, **s.tags}
    except (ValueError, OSError, struct.error, IndexError, KeyError) as e:
        row["error"] = str(e) or type(e).__name__
    return row


def scan(files: DataFrame) -> DataFrame:
    """A row for each listed file (path, length, mtime, format): properties, tags, content mark, or the error.

    A sound without tags gets artist and title from its name. Texts are normalised to composed characters.
    """
    names = [c.split()[0] for c in SCAN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([_scanned(*r) for r in zip(b["path"], b["length"], b["mtime"], b["format"], strict=True)], columns=names)
            for c, kind in (c.split() for c in SCAN.split(", ")):
                if kind in ("int", "bigint"):
                    out[c] = out[c].astype("Int32" if kind == "int" else "Int64")
                elif kind == "boolean":
                    out[c] = out[c].astype("boolean")
                else:
                    out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out

    rows = files.select("path", "length", "mtime", "format").mapInPandas(run, SCAN)
    artist, title = text.parse_filename(text.file_stem(F.col("path")))
    plain = F.col("untagged") & F.col("error").isNull()
    filled = rows.withColumn("artist", F.when(plain, artist).otherwise(F.col("artist"))).withColumn("title", F.when(plain, F.coalesce(title, text.file_stem(F.col("path")))).otherwise(F.col("title")))
    return filled.withColumns({c: text.nfc(F.col(c)) for c in FIELDS})


def sounds_below(spark: SparkSession, *folders: str) -> DataFrame:
    """Listed sound files of folders (walked) and single files, each once, by path."""
    from functools import reduce

    parts = [listing(spark, p) for p in folders]
    return reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(["path"]).filter(text.extension(F.col("path")).isin(AUDIO)).orderBy("path")
