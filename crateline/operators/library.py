"""Ordered and limited views of the library: listings, table sorts, the inbox with pinned rows, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import camelot_number, compatible
from ..skew import union_all
from .catalog import is_major

#: Sortable columns of the track table: text without regard to case, numbers, and the one number whose nulls come last.
TEXTS = ["artist", "title", "album", "genre", "format", "comment"]
NUMBERS = ["duration_ms", "bitrate_kbps", "added_at", "key_order", "quality_order"]
NULLS_LAST = ["bpm"]


def listing_order() -> list[Column]:
    """By artist and title in binary order, nulls first; the id settles ties."""
    return [F.col("artist").asc_nulls_first(), F.col("title").asc_nulls_first(), F.col("id")]


def listed(tracks: DataFrame, limit: int = 0) -> DataFrame:
    """Tracks in the order of a listing, at most ``limit`` of them (0: all)."""
    ordered = tracks.orderBy(*listing_order())
    return ordered.limit(limit) if limit else ordered


def by_ids(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    """The tracks whose id is in ``ids`` (id); no ids, no tracks."""
    return tracks.join(ids.select("id").distinct(), "id", "left_semi")


def one(tracks: DataFrame, id: int) -> dict:
    """The row of one id; LookupError if there is none."""
    row = tracks.filter(F.col("id") == id).limit(1).collect()
    if not row:
        raise LookupError(f"no track {id}")
    return row[0].asDict()


def sort_keys(column: str, ascending: bool) -> list[Column]:
    """What a click on a column's head sorts by.

    Text: case doesn't count, a missing one is the empty text. Numbers: missing ones are less than all others. The tempo:
    missing ones are greater than all others. Descending reverses the whole order. Ties go to the smaller id.
    """
    c = F.col(column)
    if column in TEXTS:
        c = F.lower(F.coalesce(c, F.lit("")))
    if column in NULLS_LAST:
        return [c.asc_nulls_last() if ascending else c.desc_nulls_first(), F.col("id")]
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last(), F.col("id")]


def numbered(rows: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in an order with their place from 1: a top-k, of which only ``limit`` rows are numbered."""
    top = rows.orderBy(*keys).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys)))


def table_tops(rows: DataFrame, limit: int) -> DataFrame:
    """(column, ascending, place, id): the head of the table for each column and direction."""
    out = []
    for column in TEXTS + NUMBERS + NULLS_LAST:
        for up in (True, False):
            out.append(numbered(rows.select("id", column), sort_keys(column, up), limit).select(F.lit(column).alias("column"), F.lit(up).alias("ascending"), "place", "id"))
    return union_all(out)


def with_pinned(inbox: DataFrame, pinned: DataFrame) -> DataFrame:
    """Inbox rows and pinned ones (id, added_at), each once, newest first."""
    both = inbox.select("id", "added_at").unionByName(pinned.select("id", "added_at"))
    return both.groupBy("id").agg(F.max("added_at").alias("added_at")).orderBy(F.col("added_at").desc_nulls_last(), F.col("id").desc())


def picked(rows: DataFrame, seed: int) -> DataFrame:
    """One row at random, the same for the same seed: the least hash of seed and id."""
    return rows.withColumn("lot", F.md5(F.concat(F.lit(f"{seed}/"), F.col("id").cast("string")))).orderBy("lot", "id").limit(1).drop("lot")


def next_track(rows: DataFrame, current: int, seed: int, smart: bool = True) -> DataFrame:
    """A track to play after ``current``: one that goes with its key, or any other where none does.

    rows: (id, key_tonic, key_mode). The current key is one row, so its comparison is sent to the others.
    """
    others = rows.filter(F.col("id") != current)
    if smart:
        mine = rows.filter(F.col("id") == current).select("key_tonic", "key_mode").limit(1).collect()
        if mine and mine[0].key_tonic is not None and mine[0].key_mode is not None:
            tonic, major = F.lit(mine[0].key_tonic), F.lit(mine[0].key_mode == 1)
            fits = compatible(camelot_number(F.col("key_tonic"), is_major()), is_major(), camelot_number(tonic, major), major)
            good = others.filter(F.coalesce(fits, F.lit(False)))
            if not good.isEmpty():
                others = good
    return picked(others, seed)


def concat_filter(columns: list[str], needle: str) -> Column:
    """Whether one text made of all columns contains the needle, without regard to case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])).contains(needle.strip().lower())


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, target): a path of its own for each of (id, source, base), in the order of ids.

    ``base`` if it is free or the row's own source, otherwise ``base`` with " (1)", " (2)" ... before the extension.
    ``taken`` (path) holds the paths that exist. Each base's free numbers are the whole numbers less those taken; the k-th
    row gets the k-th of them, so nothing is tried one by one.
    """
    name = F.regexp_extract("base", r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    rows = wanted.withColumn("ext", ext).withColumn("stem", F.expr("substring(base, 1, length(base) - length(ext))"))
    stays = rows.filter(F.col("base") == F.col("source")).select("id", F.col("base").alias("target"))
    rows = rows.filter(F.col("base") != F.col("source"))
    # numbers in use: 0 is the base itself
    t_name = F.regexp_extract("path", r"([^/]*)$", 1)
    t = taken.select("path").distinct().withColumn("ext", F.regexp_extract(t_name, r".(\.[^.]*)$", 1)).withColumn("cut", F.expr("substring(path, 1, length(path) - length(ext))"))
    number = F.regexp_extract("cut", r" \((\d{1,9})\)$", 1)
    used = t.select(F.col("cut").alias("stem"), "ext", F.lit(0).alias("k")).unionByName(t.filter(number != "").select(F.regexp_replace("cut", r" \(\d{1,9}\)$", "").alias("stem"), "ext", number.cast("int").alias("k"))).distinct()
    counts = rows.groupBy("stem", "ext").agg(F.count(F.lit(1)).alias("m"))
    have = used.join(counts.select("stem", "ext"), ["stem", "ext"], "left_semi").groupBy("stem", "ext").agg(F.count(F.lit(1)).alias("t"))
    options = counts.join(have, ["stem", "ext"], "left").select("stem", "ext", F.explode(F.sequence(F.lit(0), (F.col("m") + F.coalesce("t", F.lit(0)) - 1).cast("int"))).alias("k"))
    free = options.join(used, ["stem", "ext", "k"], "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy("stem", "ext").orderBy("k")))
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy("stem", "ext").orderBy("id")))
    placed = turns.join(free, ["stem", "ext", "turn"])
    target = F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat("stem", F.lit(" ("), F.col("k").cast("string"), F.lit(")"), "ext"))
    return stays.unionByName(placed.select("id", target.alias("target")))


def vinyl_order(by: str, ascending: bool) -> list[Column]:
    """Records by artist, added or price: what is missing comes last both ways, ties by artist, then by instance."""
    if by == "artist":
        return [F.lower("artist").asc_nulls_last() if ascending else F.lower("artist").desc_nulls_last(), F.lower("title"), F.col("instance_id")]
    c = F.col(by)
    return [c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col("artist").asc_nulls_first(), F.col("instance_id")]




def tag_worklist(tracks: DataFrame, managed: list[str]) -> DataFrame:
    """(id, source_path, write_cover, fields): edited tracks with a file, and how many of the managed fields are filled."""
    fields = sum((F.when(F.trim(F.col(c).cast("string")) != "", 1).otherwise(0) for c in managed), F.lit(0))
    return tracks.filter(F.col("user_edited") & F.col("source_path").isNotNull()).select("id", "source_path", F.col("has_cover").alias("write_cover"), fields.alias("fields"))
