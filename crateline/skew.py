"""Joins that survive hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of the fact rows; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 500


def join_counted(fact: DataFrame, dim: DataFrame, keys: list[str], count_col: str = "n_rows", total: int | None = None) -> DataFrame:
    """Inner join of a skewed fact table with a table that is unique by ``keys``.

    ``dim`` holds in ``count_col`` how many fact rows each key has, ``total`` how many there are. Keys with at least
    HOT_SHARE of all rows are at most 1 / HOT_SHARE many, which bounds what is broadcast; the rest is shuffled, where no
    key is large. Null keys match nothing, empty inputs give an empty result, column names beside the keys must differ.
    """
    if total is None:
        total = dim.agg(F.sum(count_col)).first()[0] or 0
    hot = dim.filter(F.col(count_col) >= max(2, total * HOT_SHARE)).drop(count_col)
    cold = dim.filter(F.col(count_col) < max(2, total * HOT_SHARE)).drop(count_col)
    hot_keys = hot.select(*keys).withColumn("__hot", F.lit(True))
    marked = fact.join(F.broadcast(hot_keys), keys, "left")
    left = marked.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot), keys)
    right = marked.filter(F.col("__hot").isNull()).drop("__hot").join(cold, keys)
    return left.unionByName(right)


def apart(df: DataFrame) -> DataFrame:
    """One side of a join that is sorted and merged, never broadcast.

    Spark takes what a function or explode makes of a few rows for as large as those rows, and a packed file for its size on
    disk, so it would send tables through the driver that are many times the limit for that.
    """
    return df.hint("merge")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


#: Fact rows of one key that are joined in one part, about.
PART_ROWS = 50_000


def join_salted(fact: DataFrame, dim: DataFrame, key: str, counts: DataFrame, count_col: str = "n_rows", part_rows: int = PART_ROWS) -> DataFrame:
    """Inner join of a skewed fact table with a table that may hold several rows of a key.

    ``counts`` has each key's fact rows. A key with more than ``part_rows`` of them is cut into parts and its rows of
    ``dim`` are repeated for each; at most one key in ``part_rows`` fact rows is such, which bounds what is broadcast. Null
    keys match nothing.
    """
    hot = counts.filter(F.col(count_col) > part_rows).select(key, F.ceil(F.col(count_col) / part_rows).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = fact.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(*fact.columns), parts).cast("int")).drop("__parts")
    right = dim.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"]).drop("__part")
