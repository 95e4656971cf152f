"""Files as tables: listings with signatures, WAV audio, JSON release documents, device exports."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extension, format_of

# Extensions of audio files.
AUDIO = ["mp3", "flac", "aiff", "aif", "wav", "m4a", "aac", "ogg"]
#: Bytes at a file's end that its fingerprint covers.
TAIL = 256 * 1024


def listing(spark: SparkSession, folder: str, extensions: list[str] = AUDIO, with_content: bool = False) -> DataFrame:
    """(path, length, mtime, format[, fingerprint]) of all files below a folder with one of the extensions, by path.

    Only the folder is read, unless a content mark is asked for: then each task opens its files and reads their ends.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    own = files.filter(extension(F.col("path")).isin(extensions)).select("path", "length", F.unix_timestamp(F.col("modificationTime")).alias("mtime"), format_of(F.col("path")).alias("format"))
    if not with_content:
        return own.orderBy("path")

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .audio import content_mark

        for b in batches:
            yield b.assign(fingerprint=[content_mark(p.removeprefix("file://").removeprefix("file:"), None) for p in b["path"]])

    return own.mapInPandas(marks, "path string, length bigint, mtime bigint, format string, fingerprint string").orderBy("path")


def changed(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed files that are new or whose size or time differs from the stored; an unknown signature is always read again."""
    s = stored.select("path", F.col("src_size").alias("length"), F.col("src_mtime").alias("mtime"))
    return listed.join(s, ["path", "length", "mtime"], "left_anti")


def wav_audio(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(path, sample_rate, samples, error): uncompressed files as mono floats, channels averaged, the first ``most`` frames.

    Files are opened in the tasks, one at a time, and sent on one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                try:
                    rate, x = decoded(path)
                    row = (path, rate, x[:most].mean(axis=1), None)
                except (ValueError, OSError, struct.error) as e:
                    row = (path, None, None, str(e))
                yield pd.DataFrame([row], columns=["path", "sample_rate", "samples", "error"]).astype({"sample_rate": "Int32"})

    files = listing(spark, folder, ["wav", "aif", "aiff"])
    return files.select("path").mapInPandas(run, "path string, sample_rate int, samples array<float>, error string")


def decoded(path: str) -> tuple[int, np.ndarray]:
    """(sample rate, (frames, channels) floats) of an uncompressed file."""
    from .audio import decoded as read

    return read(path.removeprefix("file://").removeprefix("file:"))


# Fixed value: where a player's database lies on a volume.
DEVICE_DATABASE = "PIONEER/rekordbox/export.pdb"


def device_databases(volumes: list[str]) -> list[str]:
    """The export databases of mounted volumes."""
    return [p for v in volumes if os.path.isfile(p := os.path.join(v, DEVICE_DATABASE))]


SEARCH = "pagination struct<page:int,pages:int,per_page:int,items:bigint>, results array<struct<id:bigint,type:string,title:string,year:string,label:array<string>,country:string,format:array<string>,thumb:string,cover_image:string>>"


def search_answers(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """(source, release_id, title, year, label, country, format, thumb_url, cover_image_url, place): saved answers of a release
    search as JSON files, the first ``most`` releases of each; other kinds of hits are left out."""
    pages = spark.read.schema(SEARCH).option("multiLine", True).json(path).select(F.input_file_name().alias("source"), F.posexplode("results").alias("p", "r"))
    kept = pages.filter((F.col("r.type") == "release") & F.col("r.id").isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("p")))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    return kept.filter(F.col("place") <= most).select(
        "source", F.col("r.id").cast("string").alias("release_id"), "r.title", "r.year", first("r.label").alias("label"), "r.country", F.array_join("r.format", ", ").alias("format"), F.col("r.thumb").alias("thumb_url"), F.col("r.cover_image").alias("cover_image_url"), "place",
    )


def next_page(page: int | None, pages: int | None) -> int | None:
    """The page to ask for after this one, None after the last."""
    return page + 1 if page is not None and pages is not None and page < pages else None


def retry_wait(attempt: int, retry_after: str | None = None, most: int = 3) -> float | None:
    """Seconds to wait before asking again after being told to slow down, None when it was tried often enough."""
    if attempt >= most:
        return None
    return float(retry_after) if retry_after and retry_after.strip().isdigit() else 2.0 * (attempt + 1)


def settings(path: str | None, defaults: dict) -> dict:
    """Settings of a TOML file over their defaults: unknown keys stay, a value of another type than its default is ignored."""
    import tomllib

    if path is None or not os.path.isfile(path):
        return dict(defaults)
    with open(path, "rb") as f:
        read = tomllib.load(f)
    return {**defaults, **{k: v for k, v in read.items() if k not in defaults or defaults[k] is None or isinstance(v, type(defaults[k]))}}


RELEASE = "release_id string, title string, year int, released string, country string, genres array<string>, styles array<string>, label string, catalog_number string, tracklist array<struct<position:string,title:string,duration:string,type:string>>, videos array<struct<uri:string,title:string,duration:double,embed:boolean>>"


def release_documents(rows: DataFrame, least_version: int = 0) -> DataFrame:
    """(release_id, d): parsed documents of (release_id, detail_json, detail_version); one that isn't whole JSON is a miss."""
    whole = rows.filter((F.coalesce("detail_version", F.lit(0)) >= least_version) & F.expr("try_parse_json(detail_json) is not null"))
    return whole.select("release_id", F.from_json("detail_json", RELEASE).alias("d"))


class RowKind(NamedTuple):
    """Where a row of an export table has its numbers, and its string: name, offset, whether that only says where it lies."""

    name: str
    numbers: dict[str, int]
    string: tuple[str, int, bool] | None = None


# The rows of the tables that are read, by the table's number.
ROW_KINDS = {
    0: RowKind("tracks", {"id": 0x48}, ("path", 0x86, True)),
    7: RowKind("playlists", {"parent_id": 0, "position": 8, "id": 12, "is_folder": 16}, ("name", 20, False)),
    8: RowKind("entries", {"position": 0, "track_id": 4, "playlist_id": 8}),
}


def device_export(data: bytes) -> dict[str, list[dict]]:
    """Tracks, playlists and entries of a device's export database (paged tables of packed rows).

    A page chain ends at its last page, outside the file, at a page that doesn't carry its own number, or when it repeats.
    """
    u16 = lambda at: struct.unpack_from("<H", data, at)[0] if 0 <= at <= len(data) - 2 else None
    u32 = lambda at: struct.unpack_from("<I", data, at)[0] if 0 <= at <= len(data) - 4 else None
    size, tables = u32(4), u32(8)
    if u32(0) != 0 or size is None or not 512 <= size <= 65536 or tables is None or tables > 64:
        raise ValueError("not an export database")

    def text(at: int) -> str | None:
        if at >= len(data):
            return None
        head = data[at]
        if head % 2:
            n = head // 2 - 1
            return data[at + 1 : at + 1 + n].decode("utf-8", "replace") if n >= 0 and at + 1 + n <= len(data) else None
        n = u16(at + 1)
        if n is None or n < 4 or at + n > len(data):
            return None
        body = data[at + 4 : at + n]
        if head == 0x40:
            return body.decode("utf-8", "replace")
        if head == 0x90:
            return body[1:].split(b"\0")[0].decode("utf-8", "replace") if body[:1] == b"\x03" else body[: len(body) // 2 * 2].decode("utf-16-le", "replace")
        return None

    def rows(kind: int, page: int, last: int) -> Iterator[int]:
        seen = set()
        while page not in seen and (page + 1) * size <= len(data):
            seen.add(page)
            base = page * size
            if u32(base) != 0 or u32(base + 4) != page:
                return
            if u32(base + 8) == kind and not data[base + 0x1B] & 0x40:
                small, large = data[base + 0x18], u16(base + 0x22)
                count = large if small < large != 0x1FFF else small
                for group in range(-(-count // 16)):
                    foot = base + size - 36 * group
                    present = u16(foot - 4) or 0
                    for slot in range(16):
                        if present >> slot & 1:
                            at = base + 0x28 + u16(foot - 6 - 2 * slot)
                            if at < base + size:
                                yield at
            if page == last:
                return
            page = u32(base + 0x0C)

    out: dict[str, list[dict]] = {k.name: [] for k in ROW_KINDS.values()}
    for t in range(tables):
        kind, first, last = (u32(0x1C + 16 * t + k) for k in (0, 8, 12))
        layout = ROW_KINDS.get(kind)
        if layout is None or last is None:
            continue
        for at in rows(kind, first, last):
            row = {f: u32(at + offset) for f, offset in layout.numbers.items()}
            if layout.string:
                name, offset, indirect = layout.string
                step = u16(at + offset) if indirect else offset
                row[name] = text(at + step) if step is not None else None
            if None not in row.values():
                out[layout.name].append({**row, "is_folder": row["is_folder"] != 0} if "is_folder" in row else row)
    return out


def device_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, playlists, entries) of all export databases that ``path`` names, one row each with its source path."""
    files = spark.read.format("binaryFile").load(path)
    schemas = {"tracks": "source string, id bigint, path string", "playlists": "source string, id bigint, parent_id bigint, position bigint, is_folder boolean, name string", "entries": "source string, playlist_id bigint, position bigint, track_id bigint"}

    def reader(which: str):
        names = [c.split()[0] for c in schemas[which].split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for source, data in zip(b["path"], b["content"], strict=True):
                    try:
                        got = device_export(data)[which]
                    except ValueError:
                        got = []
                    yield pd.DataFrame([{"source": source, **r} for r in got], columns=names)

        return run

    return tuple(files.select("path", "content").mapInPandas(reader(w), s) for w, s in schemas.items())
