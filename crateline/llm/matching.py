"""Matching records of two sources that share no key, by a Gaussian mixture over similarity vectors, without labels.

A track and a release candidate each name a recording: performers, title, version, year. Rows are reduced to classes of
equal canonical descriptions, so copies cost nothing more. Cells that were decoded wrongly are restored first, by the
hidden Markov model over all encoding pairs. Title words are set right against the vocabulary of both
sources first (a word with a typing error is near one that is far more frequent). Compared are classes with the same
corrected title (in scripts without spaces also those within one edit) that have a piece of a performer's word in common:
its first or its last three letters. Titles that very many classes share are joined by title and piece, which gives the
same pairs.

Each pair has a vector of four similarities (performers, title, version, year). Two Gaussians with regularised covariances,
matched and unmatched, are fitted by expectation maximisation on the histogram of the vectors, whose size is bounded by the
number of cells and not by the data. Transitivity is a constraint of each expectation step: where a links to x, x to b and
b to y, a and y can't be strangers, and the weakest of four that contradict each other gives way; the next maximisation
starts from these posteriors, until they move no more. The posterior is the confidence, and it alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread, written
from ..skew import join_salted
from .mojibake import garbled_texts
from .names import WORD, class_similarity, edits, folded, monge_elkan, name_words, short_forms, with_forms

STEP = 0.05  # cell width of the histogram
DIMENSIONS = 4
JOINERS = {"feat", "ft", "featuring", "vs", "versus", "with", "and", "x"}
# What marks the original version of a recording.
ORIGINALS = {"", "original", "original mix", "original version"}
KINDS = ["remix", "rework", "edit", "mix", "version", "instrumental", "live", "acapella", "dub"]
FREQUENT = 8  # times as frequent as a misspelling a word must be to be taken for what was meant


NUMBERED = re.compile(r"\s*\(\d+\)|\*")
BETWEEN = re.compile(r"(?i)\s(?:feat|ft|vs)\.?\s|\s(?:featuring|with|and)\s|\sx\s|[;,/|\\\n&+\"·]+")
TRACK_NUMBER = re.compile(r"^\d{1,3}\s*[-.)]\s+")
IN_BRACKETS = re.compile(r"[(\[]([^()\[\]]*)[)\]]\s*$")
BEHIND_DASH = re.compile(r"(?i)\s+[-–—]\s+(.*\b(?:remix|rework|edit|mix|version|instrumental|live|acapella))\s*$")


@lru_cache(maxsize=200_000)
def performer_words(text: str) -> tuple[str, ...]:
    """Sorted canonical words of all performers of a cell."""
    t = text.replace("\ufffd", "ʔ")
    if "(" in t or "*" in t:
        t = NUMBERED.sub("", t)
    t = BETWEEN.sub(" ", t)
    return tuple(sorted(w for w in name_words(t) if w not in JOINERS or w == "x"))


def parse_title(text: str) -> tuple[tuple[str, ...], str]:
    """(title words, version): the version is '' for an original, else the words of the last brackets."""
    t = text.replace("\ufffd", "ʔ").replace("_", " ").strip()
    if t[:1].isdigit():
        t = TRACK_NUMBER.sub("", t)
    version = ""
    m = IN_BRACKETS.search(t) if t[-1:] in (")", "]") else None
    if not (m and m.start() > 0):
        m = BEHIND_DASH.search(t) if "-" in t or "–" in t or "—" in t else None
    if m and m.start() > 0:
        version = " ".join(WORD.findall(folded(m.group(1))))
        t = t[: m.start()]
    words = ["part" if w in ("pt", "part") else w for w in WORD.findall(folded(t)) if w != "and"]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    if version in ORIGINALS:
        version = ""
    return tuple(words), version


def parse_candidate(text: str) -> tuple[str, str] | None:
    """(performers, work) of 'Performer - Work'; the work without a second side and without the kind of release."""
    m = re.search(r"\s+[-–—]\s*|:\s+", text)
    if not m:
        return None
    performer, work = text[: m.start()], text[m.end() :]
    work = re.sub(r"\s*(?:-\s*Single|\bE\.?\s?P\.?|\bL\.?P\.?|\b(?:7|10|12)\")\s*$", "", work.strip())
    return performer, re.split(r"\s+/\s+", work)[0]


@lru_cache(maxsize=100_000)
def _version(version: str) -> tuple[str, tuple[str, ...]]:
    words = version.split(" ") if version else []
    kind = ""
    for i in range(len(words) - 1, -1, -1):
        near = [k for k in KINDS if edits(words[i], k, 1 if len(k) < 6 else 2) <= (0 if len(k) < 5 else 1 if len(k) < 6 else 2)]
        if near:
            kind = near[0]
            words = words[:i] + words[i + 1 :]
            break
    return kind, tuple(name_words(" ".join(words))) if words else ()


def version_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (ka, wa), (kb, wb) = _version(a), _version(b)
    if ka != kb:
        return 0.0
    if not wa and not wb:
        return 0.95
    return monge_elkan(list(wa), list(wb), {}) if wa and wb else 0.0


def year_similarity(a: float | None, b: float | None) -> float:
    if a is None or b is None or a != a or b != b:
        return 0.75
    d = abs(int(a) - int(b))
    return 1.0 if d == 0 else 0.9 if d == 1 else 0.4 if d == 2 else 0.0


def title_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    na, nb = re.findall(r"\d+", a), re.findall(r"\d+", b)
    if na != nb:
        return 0.0
    d = edits(a, b, 4)
    return max(0.0, 1.0 - 2.5 * d / max(len(a), len(b), 1))


SCHEMA = "id string, performers string, raw string, version string, year int"
#: Titles with corrections, garbled cells with their originals, or performers with short forms (a few dozen bytes each) that
#: are broadcast at most; beyond it they are joined by a shuffle, with the same rows.
CHANGES_SENT = 200_000


def _track_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    title = lru_cache(maxsize=100_000)(parse_title)
    for b in batches:
        perf = [" ".join(performer_words(x)) for x in b["artist"]]
        tv = [title(x) for x in b["title"]]
        yield pd.DataFrame({"id": b["id"], "performers": perf, "raw": [" ".join(w) for w, _ in tv], "version": [v for _, v in tv], "year": pd.array([None if y != y else int(y) for y in b["year"].astype(float)], dtype="Int32")})


def _candidate_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text, year in zip(b["id"], b["title"], b["year"], strict=True):
            got = parse_candidate(text)
            if got is None:
                continue
            words, version = parse_title(got[1])
            rows.append((i, " ".join(performer_words(got[0])), " ".join(words), version, int(year) if isinstance(year, str) and re.fullmatch(r"\d{4}", year.strip()) else None))
        out = pd.DataFrame(rows, columns=["id", "performers", "raw", "version", "year"])
        out["year"] = pd.array(out["year"].tolist(), dtype="Int32")
        yield out


def _with_originals(rows: DataFrame, field: str, originals: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the restored text in place of the garbled cells of a field; few originals are sent to the rows."""
    own = originals.select(F.col("cell").alias(field), "restored")
    return rows.join(F.broadcast(own) if few else own, field, "left").withColumn(field, F.coalesce("restored", field)).drop("restored")


def described(tracks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(side, id, performers, raw title, version, year) of every row that names performers and a title."""
    t = tracks.filter(F.col("id").isNotNull() & (F.trim("title") != "") & (F.trim("artist") != "")).select(F.col("id").cast("string").alias("id"), "artist", "title", "year")
    c = candidates.filter(F.col("release_id").isNotNull() & (F.trim("title") != "")).select(F.col("release_id").cast("string").alias("id"), "title", F.col("year").cast("string").alias("year")).distinct()
    cells = t.select(F.explode(F.array("artist", "title")).alias("cell")).unionByName(c.select(F.col("title").alias("cell")))
    originals = written(garbled_texts(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))).select("cell", "restored"))
    few = originals.count() <= CHANGES_SENT
    t = _with_originals(_with_originals(t, "artist", originals, few), "title", originals, few)
    c = _with_originals(c, "title", originals, few)
    both = t.mapInPandas(_track_rows, SCHEMA).withColumn("side", F.lit("t")).unionByName(spread(c, "id").mapInPandas(_candidate_rows, SCHEMA).withColumn("side", F.lit("c")))
    return both.filter((F.col("raw") != "") & (F.col("performers") != ""))


def _lacking(word: str, n: int) -> set[str]:
    out = {word}
    for _ in range(n):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def _spaced(word: str) -> bool:
    """Whether the word is of a script that puts spaces between words."""
    return not any(0x3040 <= ord(c) < 0xA000 for c in word)


def corrections(words: DataFrame) -> DataFrame:
    """(word, right) for (word, df): words that lie within the edit limit of one FREQUENT times as frequent.

    Two words within k edits share a string that lacks at most k of their letters, so the join is exact and has small keys.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            ws, ds, ks = [], [], []
            for w, d in zip(b["word"], b["df"], strict=True):
                if len(w) < 4 or not _spaced(w):
                    continue
                for x in _lacking(w, 1 if len(w) < 7 else 2):
                    ws.append(w)
                    ds.append(d)
                    ks.append(xxhash.xxh64_intdigest(x) - (1 << 63))
            if ws:
                yield pd.DataFrame({"word": ws, "df": ds, "key": ks})

    schema = "word string, df bigint, key bigint"
    wide = spread(words)
    left = wide.mapInPandas(keys, schema)
    right = spread(words.filter(F.col("df") >= FREQUENT)).mapInPandas(keys, schema).select(F.col("word").alias("right"), F.col("df").alias("rdf"), "key")
    pairs = left.join(right, "key").filter(F.col("rdf") >= FREQUENT * F.col("df")).select("word", "right", "rdf").distinct()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [edits(x, y, 2) for x, y in zip(b["word"], b["right"], strict=True)]
            out = b.assign(d=d)
            yield out[[x <= (1 if min(len(a), len(c)) < 7 else 2) for x, a, c in zip(d, b["word"], b["right"], strict=True)]]

    good = pairs.mapInPandas(near, "word string, right string, rdf bigint, d bigint")
    return good.groupBy("word").agg(F.max_by("right", F.struct(-F.col("d"), F.col("rdf"), F.col("right"))).alias("right"))


def recording_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (side, id, cls) and (side, cls, performers, title, version, year, n, and what candidate_pairs needs);
    titles are corrected."""
    df = written(rows.select(F.explode(F.split("raw", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    right = written(corrections(df))
    # only titles with a word to correct are looked at; the corrections are sent to them where there are few
    sent = F.broadcast(right) if right.count() <= CHANGES_SENT else right
    hits = rows.select("raw", F.posexplode(F.split("raw", " ")).alias("pos", "word")).join(sent, "word").select("raw", "pos", "right").distinct()
    changes = written(hits.groupBy("raw").agg(F.map_from_entries(F.collect_list(F.struct("pos", "right"))).alias("by_pos")))
    # few titles have misspelt words: where they are few enough they are sent to the rows, else both sides are shuffled
    few = changes.count() <= CHANGES_SENT
    fixed = F.array_join(F.transform(F.split("raw", " "), lambda w, i: F.coalesce(F.try_element_at("by_pos", i), w)), " ")
    whole = rows.join(F.broadcast(changes) if few else changes, "raw", "left").withColumn("title", F.when(F.col("by_pos").isNull(), F.col("raw")).otherwise(fixed)).drop("raw", "by_pos")
    identity = F.xxhash64("performers", "title", "version", F.coalesce("year", F.lit(-1)))
    members = whole.withColumn("cls", identity)
    classes = whole.groupBy("side", "performers", "title", "version", "year").agg(F.count(F.lit(1)).alias("n")).withColumn("cls", identity)
    joined = F.replace("title", F.lit(" "), F.lit(""))
    classes = classes.withColumn("joined", joined).withColumn("pieces", pieces(F.col("performers"))).withColumn("unspaced", F.col("title").rlike(r"[぀-鿿]"))
    return members.select("side", "id", "cls"), written(classes)


#: A title with more possible pairs than this is joined by title and piece; the pairs are the same.
HOT_PAIRS = 10_000


def pieces(performers: Column) -> Column:
    """Hashes of the first and of the last three letters of each performer's word."""
    ends = lambda w: F.array(F.hash(F.lit("^"), F.substring(w, 1, 3)), F.hash(F.lit("$"), F.substring(w, -3, 3)))
    return F.array_distinct(F.flatten(F.transform(F.split(performers, " "), ends)))


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Both descriptions of each pair of classes of the two sides with a piece of a performer in common and one title, or
    titles within an edit without spaces."""
    is_track = (F.col("side") == "t").cast("bigint")
    hot = classes.groupBy("joined").agg(F.sum(is_track).alias("n_t"), F.sum(1 - is_track).alias("n_c")).filter(F.col("n_t") * F.col("n_c") > HOT_PAIRS).select("joined", F.lit(True).alias("hot"))
    marked = classes.join(hot, "joined", "left")
    by_piece = F.transform("pieces", lambda x: F.xxhash64("joined", x))
    spread_out = marked.withColumn("key", F.explode(F.when(F.col("hot"), by_piece).otherwise(F.array(F.xxhash64("joined")))))
    described_by = ("cls", "performers", "title", "version", "year")
    sided = lambda d, p, *more: d.filter(F.col("side") == p).select(*more, *[F.col(c).alias(f"{p}_{c}") for c in (*described_by, "joined", "pieces")])
    met = sided(spread_out, "t", "key", "hot").join(sided(spread_out, "c", "key"), "key").filter(F.col("t_joined") == F.col("c_joined"))
    # a pair that meets in several pieces counts in the least of them
    least = F.xxhash64("t_joined", F.array_min(F.array_intersect("t_pieces", "c_pieces")))
    same = met.filter(F.arrays_overlap("t_pieces", "c_pieces") & (F.col("hot").isNull() | (F.col("key") == least)))
    out = [f"{p}_{c}" for p in "tc" for c in described_by]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, j, p in zip(b["cls"], b["joined"], b["performers"], strict=True):
                if not _spaced(j):
                    first = max(p.split(" "), key=lambda w: (len(w), w))[:1]
                    rows += [(c, first + x) for x in _lacking(j, 1)]
            yield pd.DataFrame(rows, columns=["cls", "key"])

    cjk = classes.filter("unspaced")
    lk = cjk.filter("side = 't'").select("cls", "joined", "performers").mapInPandas(keys, "cls bigint, key string").withColumnRenamed("cls", "t_cls")
    rk = cjk.filter("side = 'c'").select("cls", "joined", "performers").mapInPandas(keys, "cls bigint, key string").withColumnRenamed("cls", "c_cls")
    near = lk.join(rk, "key").select("t_cls", "c_cls").distinct()
    near = near.join(sided(cjk, "t"), "t_cls").join(sided(cjk, "c"), "c_cls").filter((F.col("t_joined") != F.col("c_joined")) & F.arrays_overlap("t_pieces", "c_pieces"))
    return same.select(*out).unionByName(near.select(*out))


def vectors(pairs: DataFrame) -> DataFrame:
    """(tc, rc, cell): the histogram cell of each pair's similarity vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = lru_cache(maxsize=200_000)(lambda a, b: 1.0 if a == b else class_similarity(a, b))
        side = round(1 / STEP) + 1
        for b in batches:
            cells = []
            for pa_, pb, ta, tb, va, vb, ya, yb in zip(b["t_performers"], b["c_performers"], b["t_title"], b["c_title"], b["t_version"], b["c_version"], b["t_year"], b["c_year"], strict=True):
                cell = 0
                for x in (names(pa_, pb), title_similarity(ta.replace(" ", ""), tb.replace(" ", "")), version_similarity(va, vb), year_similarity(ya, yb)):
                    cell = cell * side + round(x / STEP)
                cells.append(cell)
            yield pd.DataFrame({"tc": b["t_cls"], "rc": b["c_cls"], "cell": cells})

    return pairs.mapInPandas(run, "tc bigint, rc bigint, cell int")


def with_short_forms(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose performers say which short forms their words have, learnt from all performers of two words."""
    people = written(classes.select("performers").distinct().select("performers", F.split("performers", " ").alias("words")))
    named = people.select(F.concat(F.lit("\t"), "performers").alias("class"), "performers", "words")
    own = with_forms(named, short_forms(people)).filter(~F.endswith("class", F.lit("\t"))).select("performers", "class")
    own = written(own)
    sent = F.broadcast(own) if own.count() <= CHANGES_SENT else own
    for side in ("t_performers", "c_performers"):
        pairs = pairs.join(sent.withColumnRenamed("performers", side), side, "left").withColumn(side, F.coalesce("class", F.concat(F.lit("\t"), side))).drop("class")
    return pairs


def cell_vectors(cells: np.ndarray) -> np.ndarray:
    side = round(1 / STEP) + 1
    out = np.empty((len(cells), DIMENSIONS))
    rest = cells.astype(np.int64)
    for k in range(DIMENSIONS - 1, -1, -1):
        out[:, k] = (rest % side) * STEP
        rest = rest // side
    return out


def _normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    inv = np.linalg.inv(cov)
    return -0.5 * (np.einsum("ij,jk,ik->i", d, inv, d) + np.linalg.slogdet(cov)[1] + len(mean) * np.log(2 * np.pi))


def fit_mixture(x: np.ndarray, n: np.ndarray, gamma: np.ndarray | None = None, rounds: int = 60, ridge: float = 0.004) -> tuple[np.ndarray, dict]:
    """Posteriors of the matched component for vectors ``x`` with weights ``n``; regularised full covariances.

    Likeness beyond the matched mean counts as the mean, so it is never evidence against a match.
    """
    if gamma is None:
        gamma = 1 / (1 + np.exp(-20 * (x.min(axis=1) - 0.6)))
    model = {}
    for _ in range(rounds):
        gamma = np.clip(gamma, 1e-6, 1 - 1e-6)
        parts = []
        for g in (gamma, 1 - gamma):
            w = n * g
            total = max(w.sum(), 1e-9)
            mean = (w[:, None] * x).sum(axis=0) / total
            d = x - mean
            cov = (w[:, None, None] * d[:, :, None] * d[:, None, :]).sum(axis=0) / total
            # shrink to the diagonal and keep away from singular: a match has hardly any variance
            cov = 0.7 * cov + 0.3 * np.diag(np.diag(cov)) + ridge * np.eye(x.shape[1])
            parts.append((total / max(n.sum(), 1e-9), mean, cov))
        (pm, mm, cm), (pu, mu, cu) = parts
        held = np.minimum(x, mm)
        log = np.log(max(pm, 1e-9)) + _normal(held, mm, cm) - np.log(max(pu, 1e-9)) - _normal(held, mu, cu)
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        moved = float((n * np.abs(new - gamma)).sum() / max(n.sum(), 1e-9))
        gamma = new
        model = {"share": pm, "matched": mm, "unmatched": mu, "moved": moved}
        if moved < 1e-5:
            break
    return gamma, model


#: Expectation steps with transitivity at most, the maximisations between two of them, and the change that ends them.
ROUNDS, STEPS, STILL = 6, 10, 1e-4


def posteriors(vecs: DataFrame) -> DataFrame:
    """(tc, rc, confidence) with transitive posteriors, from a table of (tc, rc, cell)."""
    hist = vecs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if hist.empty:
        return vecs.select("tc", "rc", F.lit(0.0).alias("confidence"))
    spark = vecs.sparkSession
    x, n = cell_vectors(hist["cell"].to_numpy()), hist["n"].to_numpy(dtype=float)
    gamma, changes, scored = None, None, None
    for _ in range(ROUNDS):
        fitted, model = fit_mixture(x, n, gamma, rounds=STEPS)
        table = spark.createDataFrame(pd.DataFrame({"cell": hist["cell"], "g": fitted}))
        scored = vecs.join(F.broadcast(table), "cell")  # at most (1 / STEP + 1) ** 4 cells
        if not n[(fitted > 0.02) & (fitted < 0.9)].sum():  # transitivity can change no pair
            gamma, changes = fitted, None
            if model["moved"] < STILL:
                break
            continue
        changes = written(_transitive(scored))
        moves = changes.groupBy("cell").agg(F.sum(F.col("new") - F.col("g")).alias("move")).toPandas()
        by_cell = dict(zip(moves["cell"], moves["move"], strict=True))
        new = np.clip(fitted + np.array([by_cell.get(c, 0.0) for c in hist["cell"]]) / n, 0.0, 1.0)
        gamma = new
        # transitivity moves nothing that a maximisation would follow
        if model["moved"] + float((n * np.abs(new - fitted)).sum() / n.sum()) < STILL:
            break
    if changes is None:
        return scored.select("tc", "rc", F.col("g").alias("confidence"))
    return scored.join(changes.select("tc", "rc", "new"), ["tc", "rc"], "left").select("tc", "rc", F.coalesce("new", "g").alias("confidence"))


def _transitive(scored: DataFrame) -> DataFrame:
    """(tc, rc, cell, g, new) of the pairs whose posterior transitivity changes.

    A pair that three strong ones imply is raised to the least of them; a middling one that contradicts stronger ones is
    lowered below a half.
    """
    strong = scored.filter("g >= 0.5").select("tc", "rc", "g")
    open_pairs = scored.filter("g < 0.5 and g > 0.02").select(F.col("tc").alias("a"), F.col("rc").alias("y"), "cell", F.col("g").alias("g0"))
    # a - x - b - y
    ax = open_pairs.join(strong.select(F.col("tc").alias("a"), F.col("rc").alias("x"), F.col("g").alias("g1")), "a")
    xb = ax.join(strong.select(F.col("rc").alias("x"), F.col("tc").alias("b"), F.col("g").alias("g2")), "x")
    by = xb.join(strong.select(F.col("tc").alias("b"), F.col("rc").alias("y"), F.col("g").alias("g3")), ["b", "y"])
    raised = by.groupBy(F.col("a").alias("tc"), F.col("y").alias("rc")).agg(F.first("cell").alias("cell"), F.first("g0").alias("g"), F.max(F.least("g1", "g2", "g3")).alias("new"))
    weak = strong.filter("g < 0.9").select(F.col("tc").alias("a"), F.col("rc").alias("x"))
    sure = strong.filter("g >= 0.9")
    no = scored.filter("g < 0.02").select(F.col("tc").alias("b"), F.col("rc").alias("y"))
    against = (
        weak.join(sure.select(F.col("tc").alias("a"), F.col("rc").alias("y")), "a")
        .join(sure.select(F.col("rc").alias("x"), F.col("tc").alias("b")), "x")
        .join(no, ["b", "y"])
        .select(F.col("a").alias("tc"), F.col("x").alias("rc"))
        .distinct()
    )
    lowered = scored.join(against, ["tc", "rc"]).select("tc", "rc", "cell", "g", F.lit(0.49).alias("new"))
    return raised.select("tc", "rc", "cell", "g", "new").unionByName(lowered)


def matched(tracks: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """(track_id, release_id, confidence): every track and candidate that name one recording, all copies and candidates.

    Rows with a null or blank title or performer, and null ids, match nothing; a missing or unreadable year agrees with
    any. A repeated row counts once. The posterior alone decides. Empty tables give an empty result.
    """
    rows = written(described(tracks, candidates))
    members, classes = recording_classes(rows)
    vecs = written(vectors(with_short_forms(candidate_pairs(classes), classes)))
    good = written(posteriors(vecs).filter(F.col("confidence") >= least).select("tc", "rc", F.round("confidence", 4).alias("confidence")))
    of_releases = members.filter("side = 'c'").select(F.col("cls").alias("rc"), F.col("id").alias("release_id"))
    with_release = good.join(of_releases, "rc").select(F.col("tc").alias("cls"), "release_id", "confidence")
    of_tracks = members.filter("side = 't'").select("cls", F.col("id").cast("bigint").alias("track_id"))
    # tracks of one class may be very many
    counts = classes.filter("side = 't'").select("cls", F.col("n").alias("n_rows"))
    out = join_salted(of_tracks, with_release, "cls", counts).select("track_id", "release_id", "confidence")
    return out.groupBy("track_id", "release_id").agg(F.max("confidence").alias("confidence"))
