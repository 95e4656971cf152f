"""State changes as joins that return new tables; there is no table format with transactions to rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, moved


def scan_upsert(stored: DataFrame, scanned: DataFrame, tags: list[str], properties: list[str]) -> DataFrame:
    """Stored rows merged with a new scan by id: properties are always refreshed, tags unless the user edited the row.

    ``status`` tells what happened: added, updated, unchanged or kept (not scanned).
    """
    s = stored.select("id", F.lit(True).alias("s"), "user_edited", *[F.col(c).alias("s_" + c) for c in tags + properties])
    n = scanned.select("id", F.lit(True).alias("n"), *[F.col(c).alias("n_" + c) for c in tags + properties])
    j = s.join(n, "id", "full_outer")
    edited = F.coalesce("user_edited", F.lit(False))
    scanned_now = F.col("n").isNotNull()
    out_tags = [F.when(scanned_now & ~edited, F.col("n_" + c)).when(F.col("s").isNull(), F.col("n_" + c)).otherwise(F.col("s_" + c)).alias(c) for c in tags]
    out_props = [F.when(scanned_now, F.col("n_" + c)).otherwise(F.col("s_" + c)).alias(c) for c in properties]
    same = F.lit(True)
    for c in properties:
        same = same & F.col("n_" + c).eqNullSafe(F.col("s_" + c))
    status = F.when(F.col("s").isNull(), "added").when(~scanned_now, "kept").when(same, "unchanged").otherwise("updated")
    return j.select("id", *out_tags, *out_props, edited.alias("user_edited"), status.alias("status"))


def grid_merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Analyses merged by track: a grid edited by hand keeps its values and parks the new detection beside them."""
    s = stored.select("track_id", F.col("bpm").alias("s_bpm"), F.col("beat_offset_ms").alias("s_off"), F.col("first_beat_number").alias("s_first"), F.col("peak").alias("s_peak"), "grid_edited")
    f = fresh.select("track_id", F.col("bpm").alias("f_bpm"), F.col("beat_offset_ms").alias("f_off"), F.col("first_beat_number").alias("f_first"), F.col("peak").alias("f_peak"), F.lit(True).alias("has_fresh"))
    j = s.join(f, "track_id", "full_outer")
    by_hand = F.coalesce("grid_edited", F.lit(False))
    new = F.col("has_fresh").isNotNull()
    pick = lambda a, b: F.when(by_hand | ~new, F.col(a)).otherwise(F.col(b))
    return j.select(
        "track_id", pick("s_bpm", "f_bpm").alias("bpm"), pick("s_off", "f_off").alias("beat_offset_ms"), pick("s_first", "f_first").alias("first_beat_number"),
        F.when(new, F.col("f_peak")).otherwise(F.col("s_peak")).alias("peak"), F.when(by_hand & new, F.col("f_bpm")).alias("auto_bpm"), F.when(by_hand & new, F.col("f_off")).alias("auto_offset_ms"), by_hand.alias("grid_edited"),
    )


def relink_plan(rows: DataFrame, path: str, old: str, new: str) -> DataFrame:
    """(id, old_path, new_path, status): rows under the old root with their new path; one that is taken is skipped.

    Paths are compared with the table as it was before; of several rows that would get one path the smallest id does.
    """
    m = rows.select("id", F.col(path).alias("old_path"), moved(F.col(path), old, new).alias("new_path")).filter("new_path is not null")
    taken = rows.select(F.col(path).alias("new_path")).distinct().withColumn("taken", F.lit(True))
    first = m.groupBy("new_path").agg(F.min("id").alias("winner"))
    j = m.join(taken, "new_path", "left").join(first, "new_path")
    return j.select("id", "old_path", "new_path", F.when(F.col("taken").isNotNull() | (F.col("id") != F.col("winner")), "skipped").otherwise("moved").alias("status"))


def fills(tags: DataFrame, detail: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """``columns`` of ``tags`` filled from ``detail`` where blank, or overwritten where different; ``n_changed`` counts them."""
    d = detail.select(key, *[F.col(c).alias("d_" + c) for c in columns])
    j = tags.join(d, key, "left")
    out, changed = [], F.lit(0)
    for c in columns:
        old, new = filled(F.col(c)), filled(F.col("d_" + c))
        change = new.isNotNull() & (old.isNull() | (F.lit(overwrite) & (old != new)))
        out.append(F.when(change, new).otherwise(F.col(c)).alias(c))
        changed = changed + change.cast("int")
    return j.select(key, *out, changed.alias("n_changed"))


def pruned(rows: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key is to be kept; with nothing to keep nothing stays."""
    return rows.join(keep.select(key).distinct(), key, "left_semi")


def fetched_marked(rows: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """``fetched_at`` of (id, fetched_at) set to ``now`` for the ids (id)."""
    m = ids.select("id").distinct().withColumn("m", F.lit(True))
    return rows.join(m, "id", "left").select("id", F.when(F.col("m"), F.lit(now)).otherwise(F.col("fetched_at")).cast("bigint").alias("fetched_at"))


def fetched_cleared(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``fetched_at`` of (id, fetched_at) cleared for the ids (id); without ids for all rows."""
    if ids is None:
        return rows.select("id", F.lit(None).cast("bigint").alias("fetched_at"))
    m = ids.select("id").distinct().withColumn("m", F.lit(True))
    return rows.join(m, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("fetched_at")).alias("fetched_at"))


def scan_by_path(stored: DataFrame, scanned: DataFrame, tags: list[str], properties: list[str], now: int) -> DataFrame:
    """A scan merged by path: rows (id, path, tags, properties, user_edited, fetched_at, status).

    stored: (id, path, fingerprint, user_edited, fetched_at, tags, properties, on_disk); scanned: (path, fingerprint, tags,
    properties), one row for each path. A scanned file updates the row of its path ('updated'), otherwise the only stored row
    of its fingerprint whose file is gone ('moved'), otherwise it is added ('added', id null). Properties are always
    refreshed, tags unless the user edited the row. A new row whose album, genre and year are known is stamped as fetched.
    Of several new files that could be one moved row the least path is it. Stored rows that no file touches are 'kept'.
    """
    n = scanned.select(F.col("path").alias("n_path"), F.col("fingerprint").alias("n_fp"), *[F.col(c).alias("n_" + c) for c in tags + properties])
    by_path = n.join(stored.select(F.col("path").alias("n_path"), F.col("id").alias("by_path")), "n_path", "left")
    orphans = stored.filter(~F.col("on_disk") & F.col("fingerprint").isNotNull()).groupBy(F.col("fingerprint").alias("n_fp")).agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("orphan")).filter("m = 1")
    strangers = by_path.filter("by_path is null").join(orphans.select("n_fp", "orphan"), "n_fp").groupBy("orphan").agg(F.min("n_path").alias("n_path"))
    matched = by_path.join(strangers, "n_path", "left").withColumn("id", F.coalesce("by_path", "orphan"))
    status = F.when(F.col("by_path").isNotNull(), "updated").when(F.col("orphan").isNotNull(), "moved").otherwise("added")
    matched = matched.withColumn("status", status)
    s = stored.select("id", F.col("path").alias("s_path"), "user_edited", F.col("fetched_at").alias("s_fetched"), *[F.col(c).alias("s_" + c) for c in tags + properties])
    j = matched.filter("id is not null").join(s, "id", "full_outer").unionByName(matched.filter("id is null"), allowMissingColumns=True)
    new, edited = F.col("status").isNotNull(), F.coalesce("user_edited", F.lit(False))
    out_tags = [F.when(new & ~edited, F.col("n_" + c)).otherwise(F.col("s_" + c)).alias(c) for c in tags]
    out_props = [F.when(new, F.col("n_" + c)).otherwise(F.col("s_" + c)).alias(c) for c in properties]
    complete = filled(F.col("n_album")).isNotNull() & filled(F.col("n_genre")).isNotNull() & F.col("n_year").isNotNull()
    fetched = F.when(F.col("status") == "added", F.when(complete, F.lit(now))).otherwise(F.col("s_fetched"))
    return j.select("id", F.coalesce("n_path", "s_path").alias("path"), *out_tags, *out_props, edited.alias("user_edited"), fetched.cast("bigint").alias("fetched_at"), F.coalesce("status", F.lit("kept")).alias("status"))


def tallied(merged: DataFrame, failures: DataFrame) -> DataFrame:
    """(status, n) of a merge (status) and of the files that failed (path, error)."""
    return merged.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(failures.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("failed").alias("status"), "n"))


def tags_updated(rows: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (id, columns, user_edited) with the values a user typed (id, columns); they are marked as edited."""
    c = changes.select("id", *[F.col(x).alias("c_" + x) for x in columns], F.lit(True).alias("c"))
    j = rows.join(c, "id", "left")
    return j.select("id", *[F.when(F.col("c"), F.col("c_" + x)).otherwise(F.col(x)).alias(x) for x in columns], (F.coalesce("c", F.lit(False)) | F.coalesce("user_edited", F.lit(False))).alias("user_edited"))


def edits_cleared(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with ``user_edited`` taken back for the ids (id), so that the next scan refreshes their tags."""
    m = ids.select("id").distinct().withColumn("m", F.lit(True))
    return rows.join(m, "id", "left").withColumn("user_edited", F.when(F.col("m"), F.lit(False)).otherwise(F.coalesce("user_edited", F.lit(False)))).drop("m")


GRID = ["bpm", "beat_offset_ms", "first_beat_number"]


def grid_set(rows: DataFrame, manual: DataFrame) -> DataFrame:
    """Analyses with grids set by hand (track_id, GRID): the first edit keeps the detected one in ``auto_*``, later ones don't."""
    m = manual.select("track_id", *[F.col(c).alias("m_" + c) for c in GRID], F.lit(True).alias("m"))
    j = rows.join(m, "track_id", "left")
    by_hand, set_now = F.coalesce("grid_edited", F.lit(False)), F.col("m").isNotNull()
    auto = [F.when(set_now & ~by_hand, F.col(c)).otherwise(F.col("auto_" + c)).alias("auto_" + c) for c in GRID]
    return j.select("track_id", *[F.when(set_now, F.col("m_" + c)).otherwise(F.col(c)).alias(c) for c in GRID], *auto, (by_hand | set_now).alias("grid_edited"))


def grid_reset(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Analyses with the detected grid brought back for the ids (track_id); ``was_reset`` says where one was edited."""
    m = ids.select("track_id").distinct().withColumn("m", F.lit(True))
    j = rows.join(m, "track_id", "left")
    back = F.coalesce(F.col("m") & F.col("grid_edited"), F.lit(False))
    value = lambda c: F.coalesce("auto_bpm", "bpm") if c == "bpm" else F.col("auto_" + c)
    return j.select("track_id", *[F.when(back, value(c)).otherwise(F.col(c)).alias(c) for c in GRID], *[F.when(~back, F.col("auto_" + c)).alias("auto_" + c) for c in GRID], (F.coalesce("grid_edited", F.lit(False)) & ~back).alias("grid_edited"), back.alias("was_reset"))


def source_relinks(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, new_path, verdict) of new files for tracks (id, new_path): 'unknown' id, 'taken' path of another row, else 'ok'."""
    have = rows.select("id", F.lit(True).alias("known"))
    holders = rows.filter("path is not null").groupBy(F.col("path").alias("new_path")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    j = wanted.select("id", "new_path").join(have, "id", "left").join(holders, "new_path", "left")
    taken = F.col("low").isNotNull() & ((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")))
    return j.select("id", "new_path", F.when(taken, "taken").when(F.col("known").isNull(), "unknown").otherwise("ok").alias("verdict"))


def deleted(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables {name: (rows, column of the track's id)} without the rows of the deleted tracks (id)."""
    gone = ids.select("id").distinct()
    return {name: rows.join(gone.withColumnRenamed("id", column), column, "left_anti") for name, (rows, column) in tables.items()}
