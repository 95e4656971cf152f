"""Freely typed values mapped to a canonical list: a trie of the list with alias paths, searched by Levenshtein automaton.

Every entry is a path in one trie, spelled in folded letters without spaces. Beside it lie its alias paths, made by rule
from the entry's words: word order turned round, plurals, consonant skeletons, abbreviations, phonetic respellings, and
other spellings of single words. Those are learnt from the typed values (:func:`learnt_words`): a word that stands in the
place of one word of several entries, and is like it, is another spelling of it; a word that follows several whole entries
says nothing. The automaton walks the trie with the set of edit distances of one row at a
time (optimal string alignment: a swap of neighbours is one edit) and leaves a branch as soon as no path in it can end
within its limit. The limit depends on the length; an abbreviation must match exactly. The search returns all entries
within the limit with their distances; of these the nearest is the match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.values import cell_values, packed_entries, style_rule, trimmed
from ..session import cut, spread
from ..skew import join_counted

#: Entries in one trie; a longer list is searched in blocks, one trie each, so what a worker holds is bounded. The result is
#: the same: the blocks' best hits are compared by the whole ranking.
BLOCK = 1_000

NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
JOINING = {"and", "n", "und", "et", "y"}
#: Entries in which a word must stand for another, or that it must follow, to be learnt; and how like the two must be.
SPELLED_IN, FOLLOWED, LIKE = 2, 4, 0.5


@dataclass(frozen=True)
class Learnt:
    """``spellings``: (typed word, word of entries); ``fillers``: words that add nothing."""

    spellings: tuple[tuple[str, str], ...] = ()
    fillers: frozenset[str] = frozenset()


def words(text: str) -> list[str]:
    """Folded words: no accents, lower case, letters and digits, number words as digits, joining words left out."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ł", "l").replace("ø", "o"))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return [NUMBERS.get(w, w) for w in re.findall(r"[^\W_]+", t) if w not in JOINING]


def limit(n: int) -> int:
    """Edits allowed for a typed text of n letters."""
    return 0 if n <= 3 else 1 if n <= 6 else 2


def _phonetic(w: str) -> str:
    for a, b in (("ph", "f"), ("qu", "kw"), ("ck", "k"), ("y", "i"), ("ea", "ee"), ("er", "ur")):
        w = w.replace(a, b)
    return re.sub(r"c(?![hei]|$)", "k", w)


def word_forms(w: str, others: tuple[str, ...] = ()) -> dict[str, bool]:
    """Alias spellings of a word, ``others`` among them; True: typing errors on top of it are looked for too."""
    forms = {w: True}
    skeleton = w[0] + re.sub(r"[aeiou]", "", w[1:])
    more = [skeleton, re.sub(r"(.)\1", r"\1", skeleton)] if len(w) >= 3 else []
    more += [w[:k] for k in range(3, min(7, len(w)))]
    if w.isalpha():
        more += [w + "s", w + "es"] + ([w[:-1]] if w.endswith("s") else [])
    p = _phonetic(w)
    more += [p, re.sub(r"([^aeiou])\1", r"\1", p), re.sub(r"([^aeiou])\1", r"\1", w), w.replace("c", "k"), w.replace("ou", "u"), w.replace("ou", "ow")]
    for m in more:
        if m:
            forms.setdefault(m, False)
    for m in others:
        forms.setdefault(m, False)
    return forms


def likeness(a: str, b: str) -> float:
    """Length of the longest common subsequence of two words as they sound, by the shorter's length."""
    a, b = _phonetic(a), _phonetic(b)
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(min(len(a), len(b)), 1)


def learnt_words(values: DataFrame, entries: list[tuple[int, str]]) -> Learnt:
    """What the typed values (val) teach about the words of the entries.

    A typed word that is no word of any entry stands for the word of entries in whose place it is found while all other words
    agree: in SPELLED_IN entries at least, more than in any other word's place, and at least LIKE it. A word that is typed
    behind FOLLOWED whole entries or more, and in at least half of the other values that end in it, is a filler. Counts are over distinct values; what is returned is as large as the
    entries' vocabulary of misspellings, whatever the number of values.
    """
    own = {i: tuple(words(t)) for i, t in entries}
    known = {w for ws in own.values() for w in ws}
    whole = {ws: i for i, ws in own.items()}
    gaps: dict[tuple, list[tuple[int, str]]] = {}
    for i, ws in own.items():
        if len(ws) >= 2:
            for k in range(len(ws)):
                gaps.setdefault((k, ws[:k], ws[k + 1 :]), []).append((i, ws[k]))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v in b["val"]:
                ws = tuple(words(v))
                for k, w in enumerate(ws):
                    if w not in known and len(ws) >= 2:
                        rows += [(w, y, i) for i, y in gaps.get((k, ws[:k], ws[k + 1 :]), ())]
                if len(ws) >= 2 and ws not in whole:
                    rows.append((ws[-1], "", whole.get(ws[:-1])))
            out = pd.DataFrame(rows, columns=["typed", "meant", "entry"])
            yield out.assign(entry=out["entry"].astype("Int32"))

    found = spread(values.select("val").filter(F.col("val").isNotNull()).distinct()).mapInPandas(read, "typed string, meant string, entry int")
    counted = found.groupBy("typed", "meant", "entry").agg(F.count(F.lit(1)).alias("m")).groupBy("typed", "meant").agg(F.count("entry").alias("n"), F.sum(F.when(F.col("entry").isNotNull(), F.col("m"))).alias("behind"), F.sum("m").alias("all"))
    counted = counted.filter(F.when(F.col("meant") == "", (F.col("n") >= FOLLOWED) & (2 * F.col("behind") >= F.col("all"))).otherwise(F.col("n") >= SPELLED_IN)).collect()
    fillers = frozenset(r.typed for r in counted if r.meant == "")
    best: dict[str, list[tuple[int, str]]] = {}
    for r in counted:
        if r.meant and r.typed not in fillers and likeness(r.typed, r.meant) >= LIKE:
            best.setdefault(r.typed, []).append((r.n, r.meant))
    spellings = []
    for typed, options in sorted(best.items()):
        options.sort(reverse=True)
        if len(options) == 1 or options[0][0] > options[1][0]:
            spellings.append((typed, options[0][1]))
    return Learnt(tuple(spellings), fillers)




def sole_firsts(entries: list[tuple[int, str]]) -> set[int]:
    """Entries whose first word begins no other."""
    by_word: dict[str, list[int]] = {}
    for i, text in entries:
        for w in words(text)[:1]:
            by_word.setdefault(w, []).append(i)
    return {ids[0] for ids in by_word.values() if len(ids) == 1}


# Examples of what is learnt, for values too few to learn from: other spellings of words, and words that add nothing.
LEARNT = Learnt((("hse", "house"), ("haus", "house"), ("tek", "techno"), ("tekno", "techno")), frozenset({"music"}))


class Trie:
    """Entries (id, text) with their alias paths. Nodes are parallel lists; ``most`` is the largest limit below a node."""

    def __init__(self, entries: list[tuple[int, str]], sole_first: set[int] | None = None, learnt: Learnt = LEARNT):
        """``learnt``: other spellings of words. ``sole_first``: entries whose first word begins no other entry of the whole list; by default of ``entries``."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool]]] = [[]]  # (entry, limit, is the entry's own spelling)
        self.most = [0]
        if sole_first is None:
            sole_first = sole_firsts(entries)
        others: dict[str, tuple[str, ...]] = {}
        for typed, meant in learnt.spellings:
            others[meant] = (*others.get(meant, ()), typed)
        for i, text in entries:
            ws = words(text)
            if not ws:
                continue
            orders = {tuple(ws), tuple(reversed(ws)), tuple(ws[-1:] + ws[:-1]), tuple(ws[1:] + ws[:1])}
            if len(ws) <= 3:
                for order in sorted(orders):
                    straight = order == tuple(ws)
                    for combo in product(*[word_forms(w, others.get(w, ())).items() for w in order]):
                        path = "".join(f for f, _ in combo)
                        full = all(ok for _, ok in combo)
                        # an alias that spells another entry loses to that entry's own spelling in the ranking
                        self.add(path, i, 9 if full else 0, full and straight)
            else:
                for order in sorted(orders):
                    self.add("".join(order), i, 9, order == tuple(ws))
            if len(ws) == 2 and i in sole_first and len(ws[0]) >= 7:
                self.add(ws[0], i, 0, False)
            if len(ws) >= 2 and re.search(r"&|\band\b", text):  # X & Y: X'n'Y, XnYr
                self.add(ws[0][0] + ws[-1], i, 0, False)
                self.add(ws[0][:1] + ws[-1][:2], i, 0, False)
                for k in (1, 2):
                    self.add(ws[0][:k] + "n" + ws[-1][:2], i, 0, False)
                self.add("".join(w[0] for w in ws) + "".join(ws), i, 0, False)

    def add(self, path: str, entry: int, most: int, own: bool) -> None:
        at = 0
        self.most[0] = max(self.most[0], most)
        for c in path:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = len(self.next)
                self.next.append({})
                self.ends.append([])
                self.most.append(0)
            at = to
            self.most[at] = max(self.most[at], most)
        self.ends[at].append((entry, most, own))

    def exact(self, typed: str) -> list[tuple[int, int, bool]]:
        at = 0
        for c in typed:
            at = self.next[at].get(c, -1)
            if at < 0:
                return []
        return self.ends[at]

    def search(self, typed: str, most: int) -> dict[int, tuple[int, int]]:
        """Every entry within ``most`` edits: {entry: (distance, 0 if by its own spelling else 1)}."""
        found: dict[int, tuple[int, int]] = {}
        n = len(typed)

        def note(node: int, distance: int) -> None:
            for entry, allowed, own in self.ends[node]:
                if distance <= allowed:
                    key = (distance, 0 if own else 1)
                    if entry not in found or key < found[entry]:
                        found[entry] = key

        stack = [(c, to, 0, "", list(range(n + 1)), None) for c, to in self.next[0].items()]
        while stack:
            c, node, depth, before, row, older = stack.pop()
            depth += 1
            lo, hi = max(1, depth - most), min(n, depth + most)
            new = [most + 1] * (n + 1)
            if depth <= most:
                new[0] = depth
            best = new[0]
            for j in range(lo, hi + 1):
                t = typed[j - 1]
                d = row[j - 1] if t == c else 1 + min(row[j - 1], row[j], new[j - 1])
                if older is not None and j > 1 and t == before and typed[j - 2] == c and t != c:
                    d = min(d, older[j - 2] + 1)
                new[j] = d
                if d < best:
                    best = d
            if best > min(most, self.most[node]):
                # one swap more can come from the row before
                if min(row) + 1 > min(most, self.most[node]):
                    continue
            if new[n] <= most:
                note(node, new[n])
            for c2, to in self.next[node].items():
                stack.append((c2, to, depth, c, new, row))
        return found


class Matcher:
    """Typed values to entries."""

    def __init__(self, entries: list[tuple[int, str]], sole_first: set[int] | None = None, learnt: Learnt = LEARNT):
        self.learnt = learnt
        self.trie = Trie(entries, sole_first, learnt)
        self.text = dict(entries)
        self.folded = {i: "".join(words(t)) for i, t in entries}
        self.seen_words = {w for _, t in entries for w in words(t)}

    def _readings(self, value: str) -> Iterator[list[str]]:
        """The value's words, then with less and less around the name."""
        ws = words(value)
        yield ws
        kept = [w for w in ws if w not in self.learnt.fillers]
        if kept and kept != ws:
            yield kept
        inner = re.search(r"\(([^()]+)\)", value)
        if inner:
            iw = words(inner.group(1))
            if len(iw) >= 2:
                yield iw

    def candidates(self, value: str) -> dict[int, tuple]:
        """{entry: (distance, alias or own, first letters differ)} within the limit, by the first reading that has any."""
        for exact in (True, False):
            for ws in self._readings(value):
                typed = "".join(ws)
                if not typed:
                    continue
                if exact:
                    hits = {e: (0, 0 if own else 1) for e, _, own in sorted(self.trie.exact(typed), key=lambda x: x[2])}
                else:
                    hits = self.trie.search(typed, limit(len(typed)))
                if hits:
                    return {e: (*k, self.folded[e][0] != typed[0]) for e, k in hits.items()}
        return {}

    def ranked(self, value: str) -> tuple[int, int, int, bool]:
        """(entry id, distance, 0 by its own spelling else 1, first letters differ) of the best entry; id 0 if none is near."""
        got = self.candidates(value)
        if not got:
            return 0, -1, 0, False
        e, k = min(got.items(), key=lambda x: (x[1], x[0]))
        return e, *k

    def match(self, value: str) -> tuple[int, int]:
        """(entry id, distance), or (0, -1) if no entry lies within the limit. Of equals the smaller id."""
        return self.ranked(value)[:2]


@lru_cache(maxsize=4)
def _matcher(entries: tuple[tuple[int, str], ...], sole_first: frozenset[int], learnt: Learnt) -> Matcher:
    return Matcher(list(entries), set(sole_first), learnt)


def match_values(values: DataFrame, styles: DataFrame, block: int = BLOCK, known: Learnt = LEARNT) -> DataFrame:
    """Each distinct value of ``values.val`` with its entry: (val, style_id, distance); style_id 0 where none is near.

    ``known``: other spellings and fillers known beforehand, beside those that the values teach. Null values have no row. An
    empty list leaves every value unmatched. Of entries at the same distance one matched by its own spelling wins over one
    matched by an alias, then one with the same first letter, then the smaller id.
    """
    distinct = values.select("val").filter(F.col("val").isNotNull()).distinct()
    rows = styles.filter(F.col("style_id").isNotNull() & F.col("style").isNotNull()).select("style_id", "style").distinct().orderBy("style_id")
    # the list is given by hand; its ids and texts pass the driver, the tries are made in the workers block by block
    listed = [(r.style_id, r.style) for r in rows.toLocalIterator()]
    sole = sole_firsts(listed)
    taught = learnt_words(distinct, listed)
    learnt = Learnt(tuple(dict.fromkeys(known.spellings + taught.spellings)), known.fillers | taught.fillers)
    blocks = [tuple(listed[k : k + block]) for k in range(0, len(listed), block)] or [()]

    def mapper(entries):
        first = frozenset(i for i, _ in entries if i in sole)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = _matcher(entries, first, learnt)
            for b in batches:
                got = [m.ranked(v) for v in b["val"]]
                yield pd.DataFrame({"val": b["val"], **{c: [g[k] for g in got] for k, c in enumerate(("style_id", "distance", "alias", "other_letter"))}}).astype({"style_id": "int32", "distance": "int32", "alias": "int32"})

        return run

    cores = distinct.sparkSession.sparkContext.defaultParallelism
    # match time varies a lot with the value, so small tasks; the values are few. (By the value itself it would be no shuffle
    # of its own, and joined to fewer tasks.)
    spreadout = distinct.repartition(4 * cores, F.xxhash64("val"))
    schema = "val string, style_id int, distance int, alias int, other_letter boolean"
    parts = [spreadout.mapInPandas(mapper(e), schema) for e in blocks]
    if len(parts) == 1:
        return parts[0].select("val", "style_id", "distance")
    from ..skew import union_all

    # a block that reads the value exactly comes before one that finds it by edits, as within one trie
    nearest = F.struct(F.when(F.col("style_id") == 0, 1).otherwise(0), F.col("distance"), F.col("alias"), F.col("other_letter"), F.col("style_id"))
    return union_all(parts).groupBy("val").agg(F.min(nearest).alias("m")).select("val", F.col("m.style_id").alias("style_id"), F.col("m.distance").alias("distance"))


def release_styles(releases: DataFrame) -> DataFrame:
    """(rec_id, pos, val): the styles of each document that is whole JSON; pos is the place in the array, from 1."""
    whole = releases.filter(F.col("release_id").isNotNull() & F.expr("try_parse_json(detail_json) is not null"))
    styles = F.from_json("detail_json", "styles array<string>")["styles"]
    return whole.select("release_id", F.posexplode(styles).alias("p", "v")).select(F.col("release_id").alias("rec_id"), (F.col("p") + 1).cast("int").alias("pos"), trimmed(F.col("v")).alias("val")).filter("val <> ''")


def canonical_styles(tracks: DataFrame, releases: DataFrame, styles: DataFrame, known: Learnt = LEARNT) -> DataFrame:
    """(src, rec_id, pos, val, style_id, distance) of every value that is not literally an entry.

    Null and blank cells, null ids and documents that are not whole JSON give no rows; a repeated row counts once; a value
    without an entry has style_id 0.
    """
    listed = styles.filter(F.col("style").isNotNull()).select("style").distinct()
    cells = cell_values(tracks, {"genre": style_rule(packed_entries(listed))}, [])
    per_cell = cut(cells.select("cell", "n_rows", F.posexplode("values").alias("p", "val")).select("cell", "n_rows", (F.col("p") + 1).cast("int").alias("pos"), "val").join(listed.withColumnRenamed("style", "val"), "val", "left_anti"))
    found = cut(release_styles(releases).distinct().join(listed.withColumnRenamed("style", "val"), "val", "left_anti"))
    all_values = per_cell.select("val").unionByName(found.select("val"))
    matched = cut(match_values(all_values, styles, known=known))
    by_cell = per_cell.join(matched, "val").groupBy("cell").agg(F.first("n_rows").alias("n_rows"), F.collect_list(F.struct("pos", "val", "style_id", "distance")).alias("hits"))
    fact = tracks.filter(F.col("id").isNotNull() & F.col("genre").isNotNull()).select(F.col("id").cast("string").alias("rec_id"), F.col("genre").alias("cell")).distinct()
    of_tracks = join_counted(fact, cut(by_cell), ["cell"]).select(F.lit("track").alias("src"), "rec_id", F.explode("hits").alias("h")).select("src", "rec_id", "h.*")
    of_releases = found.join(matched, "val").select(F.lit("release").alias("src"), "rec_id", "pos", "val", "style_id", "distance")
    return of_tracks.unionByName(of_releases)
