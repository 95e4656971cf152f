"""All queries of the core: name -> function of (spark, folder), and the equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.values import PEOPLE, WRITERS, packed_entries, split_values, style_rule
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: The modules whose queries are registered when they are imported.
MODULES = ["queries", "scalars", "library", "records", "lists", "signals"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of each cell of artist, genre and composer that holds several."""
    rules = {"artist": PEOPLE, "genre": style_rule(packed_entries(table(spark, d, "style_list"))), "composer": WRITERS}
    return split_values(table(spark, d, "tracks"), "id", rules, ["remixer", "album_artist"]).select(F.col("id").alias("track_id"), "field", "pos", "val")
