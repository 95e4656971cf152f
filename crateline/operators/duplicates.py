"""Duplicate groups: identical files, same artist and title, similar signatures; components; the best copy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, removed, written
from ..skew import apart


def _keyed(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + "\x1f"), key)


def identical_groups(tracks: DataFrame) -> DataFrame:
    """(kind, group_key, n, first_id): two or more tracks with one non-empty fingerprint."""
    own = tracks.filter(F.trim("fingerprint") != "")
    return own.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n >= 2").select(F.lit("identical").alias("kind"), _keyed("identical", F.col("fingerprint")).alias("group_key"), "n", "first_id")


def same_track_groups(tracks: DataFrame) -> DataFrame:
    """(kind, group_key, n, first_id): one artist and title, unless all members share one non-empty fingerprint."""
    artist, title = F.lower(F.trim("artist")), F.lower(F.trim("title"))
    own = tracks.filter((artist != "") & (title != "")).select("id", F.concat(artist, F.lit("\x1f"), title).alias("k"), F.when(F.trim("fingerprint") != "", F.col("fingerprint")).alias("fp"))
    g = own.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.count("fp").alias("with_fp"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    one_file = (F.col("with_fp") == F.col("n")) & (F.col("low") == F.col("high"))
    return g.filter((F.col("n") >= 2) & ~one_file).select(F.lit("sametrack").alias("kind"), _keyed("sametrack", F.col("k")).alias("group_key"), "n", "first_id")


def report(tracks: DataFrame, ignored: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """All kinds of groups, acoustic ones where there are ``signatures`` (id, bits), without the dismissed ones (``ignored``: group_key)."""
    groups = identical_groups(tracks).unionByName(same_track_groups(tracks))
    if signatures is not None:
        groups = groups.unionByName(acoustic_groups(tracks, signatures))
    return groups.join(ignored.select("group_key").distinct(), "group_key", "left_anti").select("kind", "group_key", "n", "first_id")


def band_partners(rows: DataFrame, id_col: str, value: str, keys: list[str], width: int) -> DataFrame:
    """(id, partners): how many other rows with the same ``keys`` lie within ``width`` of a row's value, inclusive.

    Counted by a range frame over the sorted values, so no pairs are made; a null value counts as 0.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("v").rangeBetween(-width, width)
    return rows.withColumn("v", F.coalesce(F.col(value), F.lit(0)).cast("bigint")).select(F.col(id_col), (F.count(F.lit(1)).over(w) - 1).alias("partners")).filter("partners > 0")


def band_partners_all(rows: DataFrame, id_col: str, value: str, width: int) -> DataFrame:
    """The same over all rows, without keys: values are counted and cut into buckets of ``width``, of which a value sees
    its own and both neighbours, so a window holds at most three buckets' distinct values however many rows there are."""
    from pyspark.sql.window import Window

    own = rows.select(F.col(id_col), F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias("v"))
    counts = own.groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("home", F.floor(F.col("v") / width))
    near = counts.withColumn("bucket", F.explode(F.sequence(F.col("home") - 1, F.col("home") + 1)))
    w = Window.partitionBy("bucket").orderBy("v").rangeBetween(-width, width)
    within = near.withColumn("within", F.sum("n").over(w)).filter("bucket = home").select("v", "within")
    return own.join(within, "v").select(id_col, (F.col("within") - 1).alias("partners")).filter("partners > 0")


def acoustic_groups(tracks: DataFrame, signatures: DataFrame, most: int = 11, width: int = 15_000) -> DataFrame:
    """(kind, group_key, n, first_id): components of tracks (id, duration_ms, fingerprint, artist, title) whose signatures
    (id, bits) differ in at most ``most`` of 64 bits (0.18) and whose durations lie within ``width``; a null one is 0.

    Groups of one file or of one artist and title are the other kinds'. The rows of two like signatures are sorted by
    duration and each linked to the one before: what lies between two rows of the band is linked in small steps, so the
    components are those of all pairs, which are never made.
    """
    from pyspark.sql.window import Window

    sig = cut(signatures.filter(F.col("id").isNotNull() & F.col("bits").isNotNull()).select("id", "bits").join(tracks.select("id", F.coalesce("duration_ms", F.lit(0)).alias("v")), "id"))
    reps = sig.groupBy("bits").agg(F.min("id").alias("rep"))
    near = near_signatures(reps.select(F.col("rep").alias("id"), "bits"), "id", most).select("a", "b")
    pairs = near.unionByName(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    rows = sig.join(reps, "bits").select("id", "v", "rep")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("rep"))
    before = Window.partitionBy("a", "b").orderBy("v", "id")
    steps = sides.join(rows, "rep").withColumn("other", F.lag("id").over(before)).withColumn("gap", F.col("v") - F.lag("v").over(before))
    found = components(steps.filter(F.col("gap") <= width).select(F.col("id").alias("a"), F.col("other").alias("b")))
    artist, title = F.lower(F.trim("artist")), F.lower(F.trim("title"))
    tagged = tracks.select("id", F.when(F.trim("fingerprint") != "", F.col("fingerprint")).alias("fp"), F.when((artist != "") & (title != ""), F.concat(artist, F.lit("\x1f"), title)).alias("k"))
    g = found.join(tagged, "id").groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), *[f(c).alias(m + c) for c in ("fp", "k") for m, f in (("n_", F.count), ("low_", F.min), ("high_", F.max))])
    one = lambda c: (F.col("n_" + c) == F.col("n")) & F.coalesce(F.col("low_" + c) == F.col("high_" + c), F.lit(False))
    return g.filter((F.col("n") >= 2) & ~one("fp") & ~one("k")).select(F.lit("acoustic").alias("kind"), _keyed("acoustic", F.array_join("ids", ",")).alias("group_key"), "n", "first_id")


def bits_of_signs(vec: Column) -> Column:
    """The signs of a vector's first 64 values as one integer."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(F.try_element_at(vec, i) > 0, 1).otherwise(0).cast("bigint")))


#: Bits of a signature's blocks: long enough that two unrelated ones seldom agree.
BLOCK_BITS = 16


def _flips(radius: int) -> list[int]:
    """The masks that flip at most ``radius`` bits of a block."""
    return [sum(1 << k for k in bits) for r in range(radius + 1) for bits in combinations(range(BLOCK_BITS), r)]


def near_signatures(rows: DataFrame, id_col: str, most: int = 11) -> DataFrame:
    """(a, b, errors), a < b: 64-bit signatures that differ in at most ``most`` bits.

    Of four blocks of 16 bits one differs in at most ``most // 4`` bits, so each signature looks up the neighbourhood of
    each of its blocks, and no pair is lost. A wide neighbourhood (more than two bits) is met half way by both sides. Limits
    beyond 19 bits, where nearly all pairs would meet, are refused. Equal signatures are compared once for all their rows and
    come out as links to the smallest id. Null signatures are near to nothing.
    """
    if not 0 <= most < 20:
        raise ValueError("signatures are compared up to 19 bits")
    radius = most // 4
    near_side = radius if radius <= 2 else radius // 2
    reps = rows.filter(F.col("bits").isNotNull()).groupBy("bits").agg(F.min(id_col).alias("rep"))
    block = lambda k: F.shiftrightunsigned("bits", BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    parts = F.array(*[F.struct(F.lit(k).alias("block"), block(k).alias("piece")) for k in range(64 // BLOCK_BITS)])
    long = cut(reps.select("rep", "bits", F.explode(parts).alias("p")).select("rep", "bits", "p.block", "p.piece"))
    around = lambda r: long.withColumn("piece", F.explode(F.array(*[F.col("piece").bitwiseXOR(F.lit(m)) for m in _flips(r)]))) if r else long
    left = around(near_side).select("block", "piece", F.col("rep").alias("a"), F.col("bits").alias("x"))
    right = around(radius - near_side).select("block", "piece", F.col("rep").alias("b"), F.col("bits").alias("y"))
    errors = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    near = left.join(right, ["block", "piece"]).filter((F.col("a") < F.col("b")) & (errors <= most)).select("a", "b", errors.cast("int").alias("errors")).distinct()
    same = rows.join(reps, "bits").filter(F.col(id_col) > F.col("rep")).select(F.col("rep").alias("a"), F.col(id_col).alias("b"), F.lit(0).alias("errors"))
    return near.unionByName(same)


#: Words of a track's print that are compared, those of the least hash, and the rows from which a word is frequent.
SKETCH, FREQUENT = 96, 200
#: Low bits of each word behind a shared one that are compared, and how many may differ of one, two and three words' bits.
BEHIND_BITS, BEHIND = 20, (-1, 5, 10, 16)
#: Parts that sketches are shuffled in at most, so that a part's disk stays below that of the prints, and words of a part at
#: least; pairs that are matched at once; parts that prints are picked in, of so many rows at least. None changes the rows.
PARTS, PASS_WORDS, PASS_PAIRS, PICKS, PICK_ROWS = 16, 5_000_000, 500_000, 8, 100_000


def _cut_up(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, none empty: a print has a thousand words and more."""
    for b in batches:
        yield from (b.slice(i, rows) for i in range(0, b.num_rows, rows))


def packed(prints: DataFrame) -> DataFrame:
    """The prints with their ``words`` as bytes: how many each word has (3, or 8 for long ones), then the words. Empty prints are left out."""
    if dict(prints.dtypes)["words"] == "binary":
        return prints
    own = prints.filter(F.size("words") > 0)
    at = own.columns.index("words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _cut_up(batches):
            ends = b.column(at).offsets.to_numpy()
            values = b.column(at).values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype("<i8")
            ends = ends - ends[0]
            raw = values.view(np.uint8).reshape(-1, 8)
            short, full = np.ascontiguousarray(raw[:, :3]).tobytes(), raw.tobytes()
            long = np.maximum.reduceat((values >> 24) != 0, ends[:-1])
            words = [b"\x08" + full[8 * i : 8 * j] if x else b"\x03" + short[3 * i : 3 * j] for i, j, x in zip(ends[:-1], ends[1:], long, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return own.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'words' else t}" for c, t in own.dtypes))


def unpacked(words: bytes) -> np.ndarray:
    raw = np.frombuffer(words, np.uint8, offset=1).reshape(-1, words[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : words[0]] = raw
    return out.view("<u8").ravel()


def _sketched(rep: np.ndarray, place: np.ndarray, words: list[bytes], part: int, parts: int) -> list[np.ndarray]:
    """(key, other, rep, v, behind) of the sketches' words that belong to a part: the word, the sketch's next one (-1 for
    none), and the low bits of up to three words behind it in the print, above them how many."""
    each = [unpacked(b"".join([words[0], *(x[1:] for x in words[1:])]))] if len({(x[0], len(x)) for x in words}) == 1 else [unpacked(x) for x in words]
    values = np.concatenate(each)
    sizes = np.array([(len(x) - 1) // x[0] for x in words])
    row = np.repeat(np.arange(len(words)), sizes)
    start = np.concatenate([[0], np.cumsum(sizes)])
    h = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    if sizes.min() == sizes.max():
        order = (np.argsort(h.reshape(len(words), -1), axis=1, kind="stable") + start[:-1, None]).ravel()
    else:
        order = np.lexsort((h, row))
    r, w = row[order], values[order]
    own = np.ones(len(order), bool)
    own[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    order, r = order[own], r[own]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    order, r = order[rank < SKETCH], r[rank < SKETCH]
    word = values[order].view(np.int64)
    other = np.full(len(word), -1, np.int64)
    other[:-1] = np.where(r[1:] == r[:-1], word[1:], -1)
    mine = (h[order] >> np.uint64(20)) % np.uint64(parts) == part
    order, r, word, other = order[mine], r[mine], word[mine], other[mine]
    there = np.minimum(start[r + 1] - 1 - order, 3)
    behind = there.astype(np.int64) << (3 * BEHIND_BITS)
    for k in (1, 2, 3):
        bits = (values[np.minimum(order + k, len(values) - 1)] & np.uint64((1 << BEHIND_BITS) - 1)).astype(np.int64)
        behind |= np.where(there >= k, bits, 0) << ((k - 1) * BEHIND_BITS)
    return [word, other, rep[r], place[r], behind]


def _band(key: np.ndarray, rep: np.ndarray, v: np.ndarray, behind: np.ndarray, old: int, width: int) -> np.ndarray:
    """Pairs of rows, sorted by key and v, with one key, v within ``width`` and like words behind; not those among the first ``old``."""
    most, mask = np.array(BEHIND), np.array([(1 << (k * BEHIND_BITS)) - 1 for k in range(4)])
    i, d, out = np.arange(len(key)), 0, []
    while len(i):
        d += 1
        i = i[: np.searchsorted(i, len(key) - d)]
        i = i[(key[i + d] == key[i]) & (v[i + d] - v[i] <= width)]
        j = i + d
        there = np.minimum(behind[i], behind[j]) >> (3 * BEHIND_BITS)
        like = np.bitwise_count((behind[i] ^ behind[j]) & mask[there]) <= most[there]
        like &= (j >= old) & (rep[i] != rep[j])
        out.append(np.stack([np.minimum(rep[i], rep[j])[like], np.maximum(rep[i], rep[j])[like]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def print_candidates(prints: DataFrame, width: int = 0, parts: int | None = None) -> DataFrame:
    """(a, b), a < b: prints (rep, words, and v if only those with v within ``width`` are wanted) that share a word of their
    sketches behind which they go on alike.

    A sketch is the SKETCH distinct words of the least hash, so it doesn't matter where in the track they stand. A word
    that more than FREQUENT sketches hold counts only together with the next one of the sketch. Of two copies with two of 24
    bits changed in each word an eighth of the words is equal; they share six sketch words on average, and one at least in
    99 of 100 cases. Unrelated prints share one by chance, the more the larger the table; of the 60 bits behind it hardly
    ever less than 17 differ then. A print's last word has none behind it and makes no candidates.

    The words are shuffled in ``parts``, by default PARTS unless they are few. In a part the rows of a word are sorted by v
    and each is compared with those within ``width``, so no pairs are made beyond the band.
    """
    own = packed(prints if "v" in prints.columns else prints.withColumn("v", F.lit(0).cast("bigint"))).select("rep", F.col("v").cast("bigint").alias("v"), "words")
    if parts is None:
        parts = min(PARTS, max(1, -(-own.count() * SKETCH // PASS_WORDS)))

    def sketch(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _cut_up(batches):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _sketched(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist(), part, parts)], names=["key", "other", "rep", "v", "behind"])

        return run

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 4
        for b in batches:
            old = len(kept[0])
            rows = [np.concatenate([x, b.column(k).to_numpy()]) for k, x in enumerate(kept)]
            found = _band(*rows, old, width)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])
            if len(rows[0]):
                open_ = (rows[0] == rows[0][-1]) & (rows[2] >= rows[2][-1] - width)
                kept = [x[open_] for x in rows]

    from pyspark.sql.window import Window

    met = None
    for part in range(parts):
        words = own.mapInArrow(sketch(part), "key bigint, other bigint, rep bigint, v bigint, behind bigint").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key")))
        hot = F.col("size") > FREQUENT
        # rows of one word stay where they are, so the sort needs no shuffle
        rows = words.filter((F.col("size") > 1) & ~(hot & (F.col("other") == -1))).select(F.when(hot, F.xxhash64("key", "other")).otherwise(F.col("key")).alias("key"), "rep", "v", "behind")
        new = written(rows.sortWithinPartitions("key", "v").mapInArrow(band, "a bigint, b bigint").distinct(), free=True)
        if met is None:
            met = new
            continue
        # copies meet in every part, so pairs are kept once
        last, met = met, written(met.unionByName(new).distinct(), free=True)
        removed(last, new)
    return met


def picked(prints: DataFrame, reps: DataFrame) -> DataFrame:
    """The prints (rep, words) of ``reps`` (rep), as a table of their own; shuffled in parts, so few of them at once."""
    parts = min(PICKS, max(1, prints.count() // PICK_ROWS))
    mine = lambda part: F.pmod(F.xxhash64("rep"), F.lit(parts)) == part
    out = None
    for part in range(parts):
        out = written(prints.filter(mine(part)).join(apart(reps.filter(mine(part))), "rep", "left_semi"), free=True, onto=out)
    return out


def print_matches(prints: DataFrame, candidates: DataFrame, most: float = 0.18) -> DataFrame:
    """(a, b, error): candidates whose bit error rate is at most ``most`` at some shift, with the rate at the nearest such;
    too short ones never match. Matched in parts of PASS_PAIRS; each shuffles the prints, so give those with candidates."""
    from ..functions.dsp import first_match

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = [first_match(unpacked(x), unpacked(y), most) for x, y in zip(b["x"], b["y"], strict=True)]
            keep = [e is not None for e in errors]
            yield pd.DataFrame({"a": b["a"][keep], "b": b["b"][keep], "error": [e for e, k in zip(errors, keep, strict=True) if k]})

    own = packed(prints)
    parts = max(1, -(-candidates.count() // PASS_PAIRS))
    found = None
    for part in range(parts):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)) == part  # noqa: B023, E731
        x, y = (own.select(F.col("rep").alias(s), F.col("words").alias(w)) for s, w in (("a", "x"), ("b", "y")))
        pairs = candidates.filter(mine("a")).join(apart(x.filter(mine("a"))), "a").join(apart(y), "b")
        found = written(pairs.mapInPandas(run, "a bigint, b bigint, error double"), free=True, onto=found)
    return found


def acoustic_classes(tracks: DataFrame, prints: DataFrame, width: int = 15_000, most: float = 0.18) -> DataFrame:
    """(id, component, n): the tracks of each acoustic group, by its smallest id.

    tracks: (id, duration_ms, fingerprint, artist, title); prints: (id, words), with the duration as v if it needn't be joined
    to them, for that shuffles them all. Two tracks are linked if their prints match and their durations lie within ``width`` (a null one is 0); groups are the components of the links. Groups of one file
    (one fingerprint, all non-empty) or of one artist and title are the other kinds' and left out.

    Equal prints are one class, and a class's tracks are cut by duration into stretches of ``width``, in which all are
    linked. Links are made between stretches, never between all tracks, so a class with a third of the rows has a few
    hundred of them.
    """
    size = F.expr("(length(words) - 1) / case when substring(words, 1, 1) = X'08' then 8 else 3 end").cast("int")
    own = packed(prints)
    if "v" not in prints.columns:
        own = own.join(apart(tracks.select("id", F.coalesce("duration_ms", F.lit(0)).cast("bigint").alias("v"))), "id")
    # prints are the most of the disk: there is one copy of them, and only until those with candidates are picked
    heads = written(own.select(F.col("id").alias("rep"), "v", "words"), free=True)
    own = written(heads.select(F.col("rep").alias("id"), "v", size.alias("size"), F.xxhash64("words").alias("h1"), F.xxhash64("words", F.lit(1)).alias("h2"), F.floor(F.col("v") / width).alias("place")))
    stretch = ["h1", "h2", "place"]
    nodes = written(own.groupBy(*stretch).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("id").alias("node"), F.count(F.lit(1)).alias("m"), F.max("size").alias("size")), free=True)
    single = nodes.filter("m > 1").isEmpty()
    if not single:
        every, heads = heads, picked(heads, nodes.select(F.col("node").alias("rep")))
        removed(every)
    # a stretch's least id may lie anywhere in it
    met = print_candidates(heads, width if single else 3 * width)
    reps = written(met.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), free=True)
    with_others = picked(heads.select("rep", "words"), reps)
    removed(heads)
    near = print_matches(with_others, met, most).select("a", "b")
    removed(with_others, met, reps)
    # stretches of like prints, and the next one of the same print
    one = nodes.select(F.col("node").alias("a"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = nodes.select(F.col("node").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    within = (F.col("lo2") - F.col("hi1") <= width) & (F.col("lo1") - F.col("hi2") <= width)
    edges = near.join(apart(one), "a").join(apart(two), "b").filter(within).select("a", "b")
    if not single:
        nexts = nodes.select("h1", "h2", (F.col("place") - 1).alias("place"), F.col("node").alias("b"), F.col("lo").alias("lo2"))
        edges = edges.unionByName(nodes.filter("size >= 80").join(apart(nexts), stretch).filter(F.col("lo2") - F.col("hi") <= width).select(F.col("node").alias("a"), "b"))
    groups = components(edges)
    alone = nodes.filter("m >= 2 and size >= 80").join(groups.select(F.col("id").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    by_node = written(groups.select(F.col("id").alias("node"), "component").unionByName(alone), free=True)
    if single:
        found = by_node.select(F.col("node").alias("id"), "component")
    else:
        found = written(own.select("id", *stretch).join(apart(nodes.select(*stretch, "node")), stretch).join(apart(by_node), "node").select("id", "component"), free=True)
    artist, title = F.lower(F.trim("artist")), F.lower(F.trim("title"))
    tagged = tracks.select("id", F.when(F.trim("fingerprint") != "", F.col("fingerprint")).alias("fp"), F.when((artist != "") & (title != ""), F.concat(artist, F.lit("\x1f"), title)).alias("k"))
    g = found.join(tagged, "id").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), *[f(c).alias(m + c) for c in ("fp", "k") for m, f in (("n_", F.count), ("low_", F.min), ("high_", F.max))])
    same = lambda c: (F.col("n_" + c) == F.col("n")) & F.coalesce(F.col("low_" + c) == F.col("high_" + c), F.lit(False))
    kept = g.filter((F.col("n") >= 2) & ~same("fp") & ~same("k")).select("component", "n", "first")
    return found.join(kept, "component").select("id", F.col("first").alias("component"), "n")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each vertex of the edges (a, b) is connected with.

    Alternates large-star and small-star: neighbours are linked to the least vertex of a neighbourhood until nothing moves,
    which takes about the logarithm of the longest path's length in rounds. Lineage is cut in each round.
    """
    both = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        sym = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("m"))
        small = large.select(F.col("b").alias("v"), "a").join(down, "v")
        new = cut(small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(down.select(F.col("m").alias("a"), F.col("v").alias("b"))).distinct())
        same = new.count() == both.count() and new.exceptAll(both).isEmpty()
        both = new
        if same:
            break
    members = both.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = both.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots).distinct()


def proposals(copies: DataFrame) -> DataFrame:
    """(group_key, track_id, proposal): 'keep' for the best copy of each group, 'delete' for the others.

    copies: (group_key, track_id, clean, format, bitrate_kbps). The best one is found by a partial maximum and joined back.
    """
    from ..functions.quality import copy_rank

    rank = copy_rank(F.col("clean"), F.col("format"), F.col("bitrate_kbps"), F.col("track_id"))
    best = copies.groupBy("group_key").agg(F.max_by("track_id", rank).alias("best_id"))
    return copies.select("group_key", "track_id").distinct().join(best, "group_key").select("group_key", "track_id", F.when(F.col("track_id") == F.col("best_id"), "keep").otherwise("delete").alias("proposal"))
