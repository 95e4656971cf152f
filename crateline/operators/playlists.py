"""Ordered memberships and trees, edited copy-on-write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def members(rows: DataFrame, list_col: str, item: str, position: str) -> DataFrame:
    """(list, n, head, tail): size, first and last member in order of (position, item); repeated items count once."""
    one = rows.groupBy(list_col, item).agg(F.min(position).alias("p"))
    order = F.struct("p", item)
    return one.groupBy(list_col).agg(F.count(F.lit(1)).alias("n"), F.min_by(item, order).alias("head"), F.max_by(item, order).alias("tail"))


def positioned(rows: DataFrame, list_col: str, item: str, position: str) -> DataFrame:
    """(list, item, position from 0): gaps closed, the first of repeated items wins."""
    one = rows.groupBy(list_col, item).agg(F.min(position).alias("p"))
    return one.select(list_col, item, (F.row_number().over(Window.partitionBy(list_col).orderBy("p", item)) - 1).cast("int").alias("position"))


def replaced(rows: DataFrame, list_col: str, item: str, position: str, substitutes: DataFrame) -> DataFrame:
    """Members with each ``drop`` of ``substitutes`` (drop, keep) handed over to its ``keep``.

    Where a list holds ``keep`` already its own place stays, otherwise it takes the dropped one's; places are closed up.
    """
    own = rows.groupBy(list_col, item).agg(F.min(position).alias("p"))
    s = substitutes.select(F.col("drop").alias(item), "keep").dropDuplicates([item])
    new = own.join(s, item, "left").withColumn("was_kept", F.col("keep").isNull().cast("int")).withColumn(item, F.coalesce("keep", item))
    best = new.groupBy(list_col, item).agg(F.max_by("p", F.struct("was_kept", -F.col("p"))).alias("p"))
    return positioned(best, list_col, item, "p")


def block_moved(rows: DataFrame, list_col: str, item: str, position: str, moved: DataFrame, to_top: bool) -> DataFrame:
    """Members with those in ``moved`` (item) brought to the top or bottom of each list; the order within both parts stays."""
    own = positioned(rows, list_col, item, position)
    flagged = own.join(moved.select(item).distinct().withColumn("m", F.lit(1)), item, "left")
    part = F.when(F.col("m").isNotNull(), 0 if to_top else 1).otherwise(1 if to_top else 0)
    w = Window.partitionBy(list_col).orderBy(part, "position")
    return flagged.select(list_col, item, (F.row_number().over(w) - 1).cast("int").alias("position"))


def added(rows: DataFrame, list_col: str, item: str, position: str, more: DataFrame) -> DataFrame:
    """Members after appending ``more`` (list, item, turn): what a list holds already is skipped, the first of repeated
    additions counts, new ones come behind the last in order of ``turn``."""
    own = rows.groupBy(list_col, item).agg(F.min(position).alias("p"))
    new = more.groupBy(list_col, item).agg(F.min("turn").alias("turn")).join(own.select(list_col, item), [list_col, item], "left_anti")
    both = own.select(list_col, item, F.lit(0).alias("part"), F.col("p").cast("bigint").alias("p")).unionByName(new.select(list_col, item, F.lit(1).alias("part"), F.col("turn").cast("bigint").alias("p")))
    place = F.row_number().over(Window.partitionBy(list_col).orderBy("part", "p", item)) - 1
    return both.select(list_col, item, place.cast("int").alias("position"))


def removed(rows: DataFrame, list_col: str, item: str, position: str, gone: DataFrame) -> DataFrame:
    """Members without those in ``gone`` (list, item), places closed up."""
    return positioned(rows.join(gone.select(list_col, item).distinct(), [list_col, item], "left_anti"), list_col, item, position)


def reordered(rows: DataFrame, list_col: str, item: str, position: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, refused): members in the order of ``wanted`` (list, item, turn) where it is a permutation of the list's.

    A list whose wanted order lacks a member, names a stranger or repeats one is refused as a whole: (list, lacking,
    strange, repeated). Lists without a wanted order stay as they are.
    """
    own = positioned(rows, list_col, item, position)
    asked = wanted.groupBy(list_col, item).agg(F.count(F.lit(1)).alias("times"), F.min("turn").alias("turn"))
    touched = wanted.select(list_col).distinct()
    both = own.join(touched, list_col, "left_semi").join(asked, [list_col, item], "full_outer")
    faults = both.groupBy(list_col).agg(F.count(F.when(F.col("times").isNull(), 1)).alias("lacking"), F.count(F.when(F.col("position").isNull(), 1)).alias("strange"), F.count(F.when(F.col("times") > 1, 1)).alias("repeated"))
    refused = faults.filter("lacking + strange + repeated > 0")
    good = faults.filter("lacking + strange + repeated = 0").select(list_col, F.lit(True).alias("good"))
    j = own.join(good, list_col, "left").join(asked.select(list_col, item, "turn"), [list_col, item], "left")
    order = F.when(F.col("good"), F.col("turn").cast("bigint")).otherwise(F.col("position").cast("bigint"))
    place = F.row_number().over(Window.partitionBy(list_col).orderBy(order, item)) - 1
    return j.select(list_col, item, place.cast("int").alias("position")), refused


def block_before(rows: DataFrame, list_col: str, item: str, position: str, moved: DataFrame, before: int) -> DataFrame:
    """Members with those in ``moved`` (item) brought together before what stood at place ``before``; the order within both
    parts stays. A place behind the end is the bottom."""
    own = positioned(rows, list_col, item, position)
    flagged = own.join(moved.select(item).distinct().withColumn("m", F.lit(1)), item, "left")
    part = F.when(F.col("m").isNotNull(), 1).when(F.col("position") < before, 0).otherwise(2)
    place = F.row_number().over(Window.partitionBy(list_col).orderBy(part, "position")) - 1
    return flagged.select(list_col, item, place.cast("int").alias("position"))


def next_places(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, next): the place behind the last child of each parent (null: the top level), 0 where there is none.

    nodes: (parent, position). A null parent is a parent of its own, so the join is null-safe.
    """
    last = nodes.groupBy(F.col("parent").alias("p")).agg(F.max("position").alias("m"))
    return parents.select("parent").distinct().join(last, F.col("parent").eqNullSafe(F.col("p")), "left").select("parent", F.coalesce(F.col("m") + 1, F.lit(0)).cast("int").alias("next"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor) of a forest (id, parent), by pointer doubling: each round doubles the distance looked at, and the
    lineage is cut. A ring ends too, its members are each other's ancestors."""
    hop = cut(nodes.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("ancestor")).distinct())
    while True:
        further = hop.join(hop.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("beyond")), "ancestor").select("id", F.col("beyond").alias("ancestor"))
        new = cut(hop.unionByName(further).distinct())
        if new.count() == hop.count():
            return new
        hop = new


def move_checks(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, target, verdict) of moves (id, target) in a forest (id, parent, is_folder); a null target is the top level.

    'unknown' node or target, 'self', 'no folder', 'cycle' where the target lies below the node, else 'ok'.
    """
    known = nodes.select("id", F.lit(True).alias("known"))
    targets = nodes.select(F.col("id").alias("target"), F.col("is_folder").alias("folder"))
    below = ancestors(nodes).select(F.col("id").alias("target"), F.col("ancestor").alias("id"), F.lit(True).alias("below"))
    j = moves.select("id", "target").join(known, "id", "left").join(targets, "target", "left").join(below, ["target", "id"], "left")
    verdict = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("target").isNull(), "ok").when(F.col("id") == F.col("target"), "self")
        .when(F.col("folder").isNull(), "unknown").when(~F.col("folder"), "no folder").when(F.col("below"), "cycle").otherwise("ok")
    )
    return j.select("id", "target", verdict.alias("verdict"))


def without_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The forest without the nodes in ``gone`` (id) and all that lies below them."""
    below = ancestors(nodes).join(gone.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select("id")
    return nodes.join(gone.select("id").unionByName(below).distinct(), "id", "left_anti")


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """(id, depth, leaves): how deep each node of a forest (id, parent) lies and how many leaves are below it (0 for a leaf)."""
    up = ancestors(nodes)
    inner = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    leaves = nodes.select("id").join(inner, "id", "left_anti")
    depth = up.groupBy("id").agg(F.count(F.lit(1)).alias("depth"))
    below = up.join(leaves, "id", "left_semi").groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("leaves"))
    return nodes.select("id").join(depth, "id", "left").join(below, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def resolved(playlists: DataFrame, entries: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """(playlist_id, position, file_id): a device's playlists with the scanned files their entries stand for.

    playlists (playlist_id), entries (playlist_id, position, track_id), paths (track_id, path), files (file_id, path). Paths
    are compared without regard to case; an entry without a file is left out, a playlist without entries stays, with nulls.
    """
    by_path = files.groupBy(F.lower("path").alias("key")).agg(F.min("file_id").alias("file_id"))
    found = entries.join(paths.select("track_id", F.lower("path").alias("key")), "track_id").join(by_path, "key").select("playlist_id", "position", "file_id")
    return playlists.select("playlist_id").distinct().join(found, "playlist_id", "left").select("playlist_id", "position", "file_id")
