"""Mixing sources to target weights, sized in tokens.

Each document gets a hash key. Within a source documents are ordered by that key, and a prefix of the order is taken whose
tokens fill the source's budget; a budget beyond the source's size takes whole passes first. The order is never sorted
globally: the key range is cut into fixed equal parts, which uniform keys fill evenly, so part sums give the offset of each
part and a running sum within the part gives that of each document. A source with a third of all rows is split like any
other, because a part holds about PART_ROWS documents however large the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .bpe import count_tokens

#: Sources with a target (a few dozen bytes each) that are sent to the documents at most; more are joined by a shuffle.
TARGETS_SENT = 10_000
#: Documents that one part of the key range holds, about.
PART_ROWS = 20_000


def _sized(docs: DataFrame, seed: int, path: str | None) -> DataFrame:
    own = docs.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull())
    one = count_tokens(own, ["doc_id", "source"], "text", path).groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    return one.select("doc_id", "d.source", "d.n_tokens").filter("n_tokens > 0").withColumn("key", F.xxhash64("doc_id", F.lit(seed)))


def plan_mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    ``mix``: (doc_id, source, n_tokens, repeats) for every document taken at least once, ``repeats`` at most its source's
    ``max_repeats``. ``shares``: one row for each row of ``targets`` with the budget, what was available and what was
    reached. Without ``total_tokens`` the total is the largest at which every source that has documents reaches its share;
    with a larger total a source gives all its permitted repeats and its row shows the shortfall.

    A document without tokens (null, empty) is never taken. Sources without targets are left out; targets without
    documents get zero tokens. Null sources belong to no target. A repeated doc_id counts once, with its least source and
    the fewest tokens there; ties of the hash key are ordered by doc_id. An empty corpus gives an empty mix.
    """
    sized = cut(_sized(docs, seed, path))
    goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
    goals = goals.join(have, "source", "left").fillna(0, ["available", "docs"])
    if total_tokens is None:
        # one number: the least of the sources' limits
        row = goals.filter("available > 0 and target_share > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share"))).first()
        total_tokens = int(row[0] or 0)
    wanted = F.round(F.col("target_share") * F.lit(total_tokens)).cast("bigint")
    budget = F.least(wanted, F.col("available") * F.col("max_repeats"))
    goals = (
        goals.withColumn("wanted", wanted)
        .withColumn("passes", F.when(F.col("available") > 0, F.floor(budget / F.col("available"))).otherwise(0).cast("int"))
        .withColumn("rest", (budget - F.col("passes") * F.col("available")).cast("bigint"))
    )
    goals = cut(goals)
    most = sized.count()
    parts = max(1, -(-most // PART_ROWS))
    # the top of the key's range, as 0 .. parts - 1
    part = F.least(F.floor((F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))) * parts), F.lit(parts - 1)).cast("int")
    asked = goals.select("source", "passes", "rest", "max_repeats")
    few = goals.count() <= TARGETS_SENT
    keyed = sized.join(F.broadcast(asked) if few else asked, "source").withColumn("part", part)
    sums = keyed.groupBy("source", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "part", before.alias("offset"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = keyed.withColumn("upto", running).join(offsets, ["source", "part"]).withColumn("mid", F.col("offset") + F.col("upto") - F.col("n_tokens") / 2)
    # the document across the border is taken if the larger half lies inside
    extra = F.when((F.col("mid") < F.col("rest")) & (F.col("passes") < F.col("max_repeats")), 1).otherwise(0)
    mix = placed.withColumn("repeats", (F.col("passes") + extra).cast("int")).filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    mix = cut(mix)
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"), F.sum("repeats").alias("mix_docs"), F.max("repeats").alias("most_repeats"))
    shares = goals.join(got, "source", "left").fillna(0, ["mix_tokens", "mix_docs", "most_repeats"])
    everything = F.sum("mix_tokens").over(Window.partitionBy())  # a row for each target: small
    shares = shares.select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("wanted").alias("budget_tokens"),
        F.col("mix_tokens").cast("bigint").alias("mix_tokens"), F.col("mix_docs").cast("bigint").alias("mix_docs"), F.col("most_repeats").cast("int").alias("most_repeats"),
        F.round(F.coalesce(F.try_divide(F.col("mix_tokens"), everything), F.lit(0.0)), 6).alias("actual_share"),
    )
    return mix, shares
