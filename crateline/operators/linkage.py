"""Linking records to catalogue rows by id first, by normalised text otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric_id(c: Column) -> Column:
    """The id as a number, null where it isn't one."""
    return F.trim(c).try_cast("bigint")


def exact_then_fallback(records: DataFrame, rows: DataFrame) -> DataFrame:
    """(record_id, row_id, how) for records and rows of (id, text): equal numeric ids, and for records without such a link
    equal texts. The alternative is two equi-joins and not one join on a disjunction. Blank texts link to nothing."""
    r = records.select(F.col("id").alias("record_id"), numeric_id(F.col("id")).alias("num"), F.col("text").alias("record_text"))
    c = rows.select(F.col("id").alias("row_id"), numeric_id(F.col("id")).alias("num"), F.col("text").alias("row_text"))
    exact = r.join(c, "num").select("record_id", "row_id").distinct()
    open_ = r.join(exact.select("record_id").distinct(), "record_id", "left_anti")
    by_text = open_.filter(F.col("record_text") != "").join(c, F.col("record_text") == F.col("row_text")).select("record_id", "row_id").distinct()
    return exact.withColumn("how", F.lit("id")).unionByName(by_text.withColumn("how", F.lit("text")))


def unique_match(lost: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(lost_id, found_id): lost rows whose key has exactly one found row. Keys are counted, never gathered."""
    one = found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("found_id")).filter("n = 1")
    return lost.select(F.col("id").alias("lost_id"), key).join(one, key).select("lost_id", "found_id")


def relocated(lost: DataFrame, found: DataFrame, name: str, mark: str) -> DataFrame:
    """(lost_id, found_id): by file name if one file has it, else the only one of the name with the same ``mark``."""
    by_name = found.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    by_mark = found.filter(F.col(mark).isNotNull()).groupBy(name, mark).agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("marked"))
    j = lost.select(F.col("id").alias("lost_id"), name, mark).join(by_name, name).join(by_mark, [name, mark], "left")
    pick = F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("marked"))
    return j.select("lost_id", pick.alias("found_id")).filter("found_id is not null")
