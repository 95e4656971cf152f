"""Records of physical releases, their links to tracks, outside artwork, and what release documents fill in."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import filled, norm_loose, norm_match, overlaps
from ..skew import join_salted
from .catalog import album_artist_key, album_key
from .linkage import numeric_id


def is_vinyl(formats: Column) -> Column:
    """Whether one of the comma-separated formats is vinyl, without regard to case."""
    return F.exists(F.split(formats, ","), lambda f: F.lower(F.trim(f)) == "vinyl")


def id_links(art: DataFrame) -> DataFrame:
    """(release_id, track_id) from the outside ids (track_id, external_id) that are numbers."""
    return art.select(numeric_id(F.col("external_id")).alias("release_id"), "track_id").filter("release_id is not null and track_id is not null").distinct()


def record_links(records: DataFrame, tracks: DataFrame, exact: DataFrame) -> DataFrame:
    """(release_id, track_id, how) of records (release_id, artist, title) and tracks (id, artist, album, title).

    ``exact`` (release_id, track_id) are links by id. A record without one is linked by text: the track's album is its
    title, or the track's title is and the artists overlap. Texts are compared in one form (:func:`norm_match`); blank ones
    match nothing. The alternative is two equi-joins, each split where very many tracks share a text.
    """
    form = lambda c: norm_match(F.coalesce(F.col(c), F.lit("")))
    loose = records.join(exact.select("release_id").distinct(), "release_id", "left_anti").select("release_id", form("title").alias("key"), form("artist").alias("r_artist")).filter("key <> ''").distinct()
    t = tracks.select(F.col("id").alias("track_id"), form("album").alias("album"), form("title").alias("title"), form("artist").alias("t_artist"))
    wanted = loose.select("key").distinct()

    def side(column: str) -> DataFrame:
        own = t.withColumn("key", F.col(column)).filter("key <> ''").select("track_id", "key", "t_artist").join(wanted, "key", "left_semi")
        return join_salted(own, loose, "key", own.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")))

    by_album = side("album").select("release_id", "track_id")
    by_title = side("title").filter(overlaps(F.col("t_artist"), F.col("r_artist"))).select("release_id", "track_id")
    text = by_album.unionByName(by_title).distinct().withColumn("how", F.lit("text"))
    return exact.select("release_id", "track_id").distinct().withColumn("how", F.lit("id")).unionByName(text)


def in_list(links: DataFrame, members: DataFrame) -> DataFrame:
    """(track_id): tracks linked to a release of a list (release_id)."""
    return links.join(members.select("release_id").distinct(), "release_id", "left_semi").select("track_id").distinct()


def price_queue(rows: DataFrame, as_of: int, max_age_s: int) -> tuple[DataFrame, list[Column]]:
    """Rows (id, checked_at) that were never checked or too long ago, and their order: never first, then oldest, then id."""
    at = F.col("checked_at")
    return rows.filter(at.isNull() | (F.lit(as_of) - at > max_age_s)), [at.isNotNull(), at, F.col("id")]


def record_upsert(stored: DataFrame, new: DataFrame, described: list[str], kept: list[str]) -> DataFrame:
    """Stored records merged with a fetched list by instance: what describes them is replaced, cover and price stay."""
    s = stored.select("instance_id", *[F.col(c).alias("s_" + c) for c in described + kept], F.lit(True).alias("s"))
    n = new.select("instance_id", *described, F.lit(True).alias("n"))
    j = s.join(n, "instance_id", "full_outer")
    pick = [F.when(F.col("n").isNotNull(), F.col(c)).otherwise(F.col("s_" + c)).alias(c) for c in described]
    status = F.when(F.col("s").isNull(), "added").when(F.col("n").isNull(), "gone").otherwise("kept")
    return j.select("instance_id", *pick, *[F.col("s_" + c).alias(c) for c in kept], status.alias("status"))


def cache_plan(wanted: DataFrame, cache: DataFrame, least_version: int = 2) -> DataFrame:
    """(release_id, status): 'hit' where the cache has a whole document of at least this version, else 'fetch'."""
    whole = cache.filter((F.col("detail_version") >= least_version) & F.expr("try_parse_json(detail_json) is not null")).select("release_id", F.lit(True).alias("hit")).distinct()
    return wanted.select("release_id").distinct().join(whole, "release_id", "left").select("release_id", F.when(F.col("hit"), "hit").otherwise("fetch").alias("status"))


# -- artwork ----------------------------------------------------------------------------------------------------------


def without_art(tracks: DataFrame, art: DataFrame) -> DataFrame:
    """(id): tracks that have neither an embedded cover nor a row of outside art, not even one that says none was found."""
    seen = art.select(F.col("track_id").alias("id"))
    return tracks.filter(~F.coalesce("has_cover", F.lit(False))).join(seen, "id", "left_anti").select("id")


def not_fetched(tracks: DataFrame, art: DataFrame) -> DataFrame:
    """(id, external_id): tracks whose outside art isn't there in full, with the release id where one is known."""
    a = art.select(F.col("track_id").alias("id"), "external_id", "has_full")
    return tracks.select("id").join(a, "id", "left").filter(~F.coalesce("has_full", F.lit(False))).select("id", "external_id")


def sibling_flags(tracks: DataFrame, art: DataFrame) -> DataFrame:
    """(id, siblings, with_art, has_art): each track of an album of several with how many others there are and have art.

    The album's counts stand for its pairs; a track's own row is taken off.
    """
    a = art.filter("has_png").select(F.col("track_id").alias("id"), F.lit(True).alias("png")).distinct()
    t = tracks.filter(F.trim("album") != "").withColumn("k", album_key()).withColumn("a", album_artist_key()).join(a, "id", "left")
    t = t.withColumn("has_art", F.coalesce("has_cover", F.lit(False)) | F.coalesce("png", F.lit(False))).select("id", "k", "a", "has_art")
    sizes = t.groupBy("k", "a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_art").cast("int")).alias("m")).filter("n >= 2")
    return t.join(sizes, ["k", "a"]).select("id", (F.col("n") - 1).alias("siblings"), (F.col("m") - F.col("has_art").cast("int")).alias("with_art"), "has_art")


def covers_to_spread(tracks: DataFrame, art: DataFrame) -> DataFrame:
    """(id, from_id): the art-less tracks of each album with the member whose cover they get: the smallest id that has one."""
    a = art.filter("has_png").select(F.col("track_id").alias("id"), F.lit(True).alias("png")).distinct()
    t = tracks.filter(F.trim("album") != "").withColumn("k", album_key()).withColumn("a", album_artist_key()).join(a, "id", "left")
    t = t.withColumn("has_art", F.coalesce("has_cover", F.lit(False)) | F.coalesce("png", F.lit(False))).select("id", "k", "a", "has_art")
    source = t.filter("has_art").groupBy("k", "a").agg(F.min("id").alias("from_id"))
    return t.filter("not has_art").join(source, ["k", "a"]).select("id", "from_id")


def art_upsert(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Art rows (track_id, external_id, has_png, has_full, prefer) after a fetch (track_id, external_id, has_png, has_full).

    A fetched row replaces the stored one but keeps whether the user prefers it; ``edited``: full art marks the track as
    edited, because it must be written into the file.
    """
    s = stored.select("track_id", F.col("external_id").alias("s_id"), F.col("has_png").alias("s_png"), F.col("has_full").alias("s_full"), "prefer")
    n = fetched.select("track_id", "external_id", "has_png", "has_full", F.lit(True).alias("n"))
    j = s.join(n, "track_id", "full_outer")
    new = F.col("n").isNotNull()
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b)).alias(a)
    return j.select("track_id", pick("external_id", "s_id"), pick("has_png", "s_png"), pick("has_full", "s_full"), F.coalesce("prefer", F.lit(False)).alias("prefer"), (new & F.coalesce("has_full", F.lit(False))).alias("edited"))


# -- documents --------------------------------------------------------------------------------------------------------


def tracklist(d: Column) -> Column:
    """Entries of a document that are tracks (of that type or none, with a title), in order."""
    kind = lambda x: F.coalesce(x["type"], F.lit("")).isin("", "track")
    return F.filter(d["tracklist"], lambda x: kind(x) & (F.trim(x["title"]) != ""))


def videos(d: Column) -> Column:
    """Videos with an address; an unknown length is null, what doesn't say may be embedded."""
    own = F.filter(d["videos"], lambda v: F.trim(v["uri"]) != "")
    return F.transform(own, lambda v: F.struct(v["uri"].alias("uri"), v["title"].alias("title"), F.when(v["duration"] > 0, v["duration"]).alias("seconds"), F.coalesce(v["embed"], F.lit(True)).alias("embeddable")))


FILLED = ["genre", "label", "catalog_number", "release_country", "album", "release_date", "year"]


def fill_values(d: Column) -> dict[str, Column]:
    """What a document has for each album-level field: styles before genres, joined."""
    names = lambda c: F.array_join(d[c], ", ")
    values = {"genre": F.when(F.size(d["styles"]) > 0, names("styles")).otherwise(names("genres")), "label": d["label"], "catalog_number": d["catalog_number"], "release_country": d["country"], "album": d["title"], "release_date": d["released"]}
    return {c: filled(v) for c, v in values.items()} | {"year": d["year"].cast("string")}


def _words(text: str | None) -> str:
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def _tails(title: str | None) -> list[str]:
    parts = re.split(r"[-–—|•]", title or "")
    return [w for w in dict.fromkeys(_words(" ".join(parts[k:])) for k in range(len(parts))) if w]


def assign_titles(wanted: list[tuple[str, str]], offered: list[list[str]], by_position: bool) -> list[int | None]:
    """For each wanted (position, title) the offer it takes: in order, one that says just the title, else one that begins
    with it or (``by_position``) with the position; an offer is taken once. Offers are lists of normalised forms."""
    free = dict(enumerate(offered))
    out: list[int | None] = []
    for position, title in wanted:
        want, place = _words(title), _words(position)
        starts = [want]
        if by_position and len(place) >= 2 and "a" <= place[0] <= "z":
            starts.append(place)
        taken = None
        if want:
            taken = next((i for i, forms in free.items() if want in forms), None)
            if taken is None:
                taken = next((i for i, forms in free.items() if any((f + " ").startswith(w + " ") for f in forms for w in starts)), None)
        free.pop(taken, None)
        out.append(taken)
    return out


def claimable(files: DataFrame, docs: DataFrame) -> DataFrame:
    """(release_id, files): the linked files (release_id, track_id, title) that a document's entries could take.

    Of files with one title at most as many as there are entries, those of the smallest ids: no more can be claimed, so a
    release with very many copies makes no long array.
    """
    form = norm_loose(F.col("title"))
    turn = F.row_number().over(Window.partitionBy("release_id", "form").orderBy("track_id"))
    entries = docs.select("release_id", F.size("entries").alias("most"), F.transform("entries", lambda e: norm_loose(e["title"])).alias("wanted"))
    own = files.withColumn("form", form).join(entries, "release_id").filter(F.exists("wanted", lambda w: (F.col("form") == w) | F.startswith("form", F.concat(w, F.lit(" ")))))
    few = own.withColumn("turn", turn).filter("turn <= most")
    return few.groupBy("release_id").agg(F.collect_list(F.struct(F.col("track_id").alias("id"), "title")).alias("files"))


def players(docs: DataFrame) -> DataFrame:
    """(release_id, place, position, title, file_id, video, plays) of documents with their local files.

    docs: (release_id, entries array<struct<position,title>>, videos array<struct<uri,title>>, files array<struct<id,title>>).
    A tracklist entry is played by a local file where one has its title, otherwise by a video; each is used once. The order
    of claims matters, so a document's short lists are walked in Python, Arrow batch by batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, entries, vids, files in zip(b["release_id"], b["entries"], b["videos"], b["files"], strict=True):
                want = [(e["position"] or "", e["title"] or "") for e in entries]
                files = sorted(files if files is not None else [], key=lambda f: f["id"])
                vids = list(vids) if vids is not None else []
                by_file = assign_titles(want, [[_words(f["title"])] for f in files], False)
                by_video = assign_titles(want, [_tails(v["title"]) for v in vids], True)
                for k, ((position, title), f, v) in enumerate(zip(want, by_file, by_video, strict=True), 1):
                    rows.append((i, k, position, title, None if f is None else int(files[f]["id"]), None if v is None else vids[v]["uri"], "file" if f is not None else "video" if v is not None else None))
            out = pd.DataFrame(rows, columns=["release_id", "place", "position", "title", "file_id", "video", "plays"])
            out["file_id"] = pd.array(out["file_id"].tolist(), dtype="Int64")
            yield out

    return docs.select("release_id", "entries", "videos", "files").mapInPandas(run, "release_id string, place int, position string, title string, file_id bigint, video string, plays string")
