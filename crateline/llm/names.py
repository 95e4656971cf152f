"""Variant spellings of names: candidates by MinHash banding, verified by Monge-Elkan similarity, grouped by star clustering.

A name is reduced to canonical words (no accents or case, titles and kinds of groups in one form, what only says "label"
left out). Spellings with the same words in any order are one class. Different words are compared once for the whole
vocabulary: words whose padded 3-grams collide in a band are candidates, and stay linked if their edit distance is small.
Which given names are forms of one another is learnt from the corpus: two given names that family names bear together far
more often than by chance (:func:`short_forms`); a table of known forms may be added.
Two classes become candidates through a linked rare word, which at most RARE classes share, or through a frequent word and
a letter of another one (a class that has frequent words and given names only, with any other), and are verified by the
Monge-Elkan similarity of all their words, where an initial or a nickname stands for the full given name. Star clustering
then makes each class either a hub or the satellite of one adjacent hub, so that a chain of small steps doesn't join
people who differ.

Recall of the banding: with r rows and b bands two sets of 3-grams of Jaccard similarity s collide with probability
1 - (1 - s**r)**b. One typing error in a word of nine letters leaves s = 0.5 or more, two leave 0.3; for r = 3 and
b = 64 that is a recall of 0.9998 and 0.83, and unrelated words (s about 0.05) collide with probability 0.008. Bands and
rows are chosen from the curve by :func:`bands_for`.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.values import PEOPLE, cell_values, trimmed
from ..session import cut, written
from ..skew import apart
from .mojibake import garbled_texts

#: A word that more classes share doesn't make them candidates alone (a given name, a kind of group), but with a letter of
#: another word; a name of such words only is also compared through its rarest one.
RARE = 64
#: Similarity from which a pair is verified.
VERIFIED = 0.86

# Short and pet forms of given names, by full form: an example of a table of known forms, for collections too small to
# learn from. The queries do without.
NICKNAMES = {
    "alexander": "alex sasha sandy xander lex alec sascha", "anthony": "tony ant anton", "benjamin": "ben benny benji benno", "bjorn": "bjorni bear", "christopher": "chris kit topher kris",
    "daniel": "dan danny dani", "elizabeth": "liz lizzy betty beth eliza lisa elsie libby betsy lizzie", "emre": "em", "francesca": "fran franny chessa frankie cesca",
    "frederick": "fred freddy freddie fritz rick", "gabriela": "gabi gaby ela gabby", "helene": "lena leni helen elle", "ingrid": "inga inge ingi", "isabella": "izzy bella isa isabel bel",
    "johannes": "hannes jo hans johann", "joseph": "joe joey jojo jo sepp", "jurgen": "jurg jorg", "katherine": "kate kathy katie kat kitty kath", "kenji": "ken", "konstantin": "kostya stan konni costa",
    "leonardo": "leo nardo len lenny", "lucia": "lucy luz lu", "madeleine": "maddie maddy mads lena", "marek": "mark", "margaret": "maggie peggy greta meg marge madge rita", "matthias": "matt matze matti hias",
    "maximilian": "max maxi maxim", "michael": "mike mick mickey mikey micha", "nicholas": "nick nico nicky klaus", "noor": "nora", "orla": "orly", "pawel": "pav pawlo", "philippa": "pip pippa phil",
    "radka": "rada", "richard": "rick dick richie ricky rich", "robert": "bob bobby rob robbie bert", "samuel": "sam sammy", "soren": "sor", "susanna": "sue susie sanna suzy susan", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "tove": "tova", "ulrike": "uli ulli rike", "valentina": "val tina vali", "vincent": "vince vinnie vin vinny", "william": "will bill billy willy liam", "ximena": "xime mena", "yusra": "yus", "zoe": "zo",
}
# One form for kinds of groups and titles.
KINDS = {
    "proj": "project", "projekt": "project", "coll": "collective", "kollektiv": "collective", "soundsystem": "soundsystem", "ss": "soundsystem", "ens": "ensemble", "orch": "orchestra", "orchestre": "orchestra", "orchester": "orchestra",
    "qtet": "quartet", "quartett": "quartet", "quatuor": "quartet", "bros": "brothers", "tr": "trio", "3": "trio", "emcee": "mc", "deejay": "dj",
}
GROUP_WORDS = {"project", "collective", "soundsystem", "ensemble", "orchestra", "quartet", "brothers", "trio"}
TITLES = {"dj", "mc"}
# Words of label names that say only that it is one: an example, as NICKNAMES; the queries learn such words.
LABEL_WORDS = set("records record recs rec rcds recordings recording music mus musik tapes tape cassettes cassette discs disc discos disques editions edition eds ed audio aud sound works soundworks wks ltd limited co company label inc productions publishing the and".split())
ARTICLES = {"the", "and"}
SPECIAL = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"})
Forms = dict[str, frozenset[str]]


def known_forms(table: dict[str, str]) -> Forms:
    """Each form's other forms, from a table of short forms by full form."""
    full: dict[str, set[str]] = {}
    for name, shorts in table.items():
        for w in [name, *shorts.split()]:
            full.setdefault(w, set()).add(name)
    return {w: frozenset(x for x, fx in full.items() if x != w and fx & fw) for w, fw in full.items()}


KNOWN = known_forms(NICKNAMES)


DOTTED_TITLE = re.compile(r"\b([DM])\.\s?([JC])\.?(?=\s|$)")
GLUED_TITLE = re.compile(r"\b(MC|DJ)(?=[^\W\d_a-z])(?=\w*[^\W\d_A-Z])")
SOUND_SYSTEM = re.compile(r"\bS\.\s?S\.")
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text.translate(SPECIAL))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


def name_words(text: str, kind: str = "people", label_words: frozenset[str] | set[str] = LABEL_WORDS) -> list[str]:
    """The canonical words of a name, in order; of a label's without ``label_words``, unless it has no others."""
    t = text
    if "." in t:
        t = DOTTED_TITLE.sub(r"\1\2 ", t)
    if "MC" in t or "DJ" in t:
        t = GLUED_TITLE.sub(r"\1 ", t)
    if "." in t:
        t = SOUND_SYSTEM.sub("SS", t)
    words = WORD.findall(folded(t))
    if kind == "label":
        own = [w for w in words if w not in label_words and w not in ARTICLES]
        return own or words
    words = [KINDS.get(w, w) for w in words]
    out: list[str] = []
    for w in words:
        if w == "system" and out and out[-1] == "sound":
            out[-1] = "soundsystem"
        elif w not in ("the", "and"):
            out.append(w)
    long = [w for w in out if len(w) > 1]
    if len(long) >= 2 and len(long) < len(out):
        # a middle initial: not the first word, nor the last of two
        out = [w for i, w in enumerate(out) if len(w) > 1 or not (0 < i < len(out) - 1)]
    return out or words


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, most + 1 if larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            new[j] = d
        if min(new) > most:
            return most + 1
        older, row = row, new
    return min(row[-1], most + 1)


def word_limit(n: int) -> int:
    """Edits allowed between two words, by the length of the shorter."""
    return 0 if n <= 3 else 1 if n <= 6 else 2


@lru_cache(maxsize=100_000)
def _letters(word: str) -> frozenset[str]:
    return frozenset(word)


def word_similarity(a: str, b: str, forms: Forms = KNOWN) -> float:
    """1 for equal words, 0.97 for forms of one given name, 0.95 for an initial, less by edits, 0 beyond the limit."""
    if a == b:
        return 1.0
    if a in GROUP_WORDS | TITLES and b in GROUP_WORDS | TITLES:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        if a[0] == b[0]:
            return 0.95
        one, full = (a, b) if len(a) == 1 else (b, a)
        return 0.94 if any(f[0] == one for f in forms.get(full, ())) else 0.0
    fa, fb = forms.get(a), forms.get(b)
    if fa and b in fa:
        return 0.97
    if fa and fb:
        # two given names: the same person's only if one is a form of the other
        return 0.0
    k = word_limit(min(len(a), len(b)))
    # each edit brings at most one letter that the other word lacks
    if abs(len(a) - len(b)) > k or len(_letters(a) - _letters(b)) > k or len(_letters(b) - _letters(a)) > k:
        return 0.0
    d = edits(a, b, k)
    return 0.0 if d > k else 1.0 - d / max(len(a), len(b)) * 0.8


def monge_elkan(a: list[str], b: list[str], forms: Forms = KNOWN) -> float:
    """The lesser of both directions' means of each word's best similarity; 0 if a word of either side has no counterpart.

    The smaller of the best similarities also counts, so one good word can't carry a bad one. Names whose only common word
    is an initial's are not similar.
    """
    if not a or not b:
        return 0.0
    table = [[word_similarity(x, y, forms) for y in b] for x in a]
    best_a = [max(row) for row in table]
    best_b = [max(column) for column in zip(*table, strict=True)]
    if min(best_a) == 0 or min(best_b) == 0:
        return 0.0
    if not any(len(x) > 1 and s > 0.5 for x, s in zip(a, best_a, strict=True)):
        return 0.0
    return min(sum(best_a) / len(a), sum(best_b) / len(b))


def collision(s: float, rows: int, bands: int) -> float:
    return 1 - (1 - s**rows) ** bands


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands needed for a recall at a similarity, from the collision curve."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(word: str, q: int = 3) -> list[str]:
    padded = "^" * (q - 1) + word + "$" * (q - 1)
    return sorted({padded[i : i + q] for i in range(len(padded) - q + 1)})


def _hash(grams_: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(g) for g in grams_], dtype=np.uint64)


def word_links(words: DataFrame, similarity: float = 0.33, recall: float = 0.9, rows: int = 3) -> DataFrame:
    """(a, b) of different words within the edit limit, both ways, from distinct words (word).

    Words of a band that is full (many words with the same 3-grams) are also joined exactly: two words within two edits
    share a string that lacks up to two of their letters.
    """
    bands = bands_for(similarity, recall, rows)
    seeds = np.random.default_rng(11).integers(1, (1 << 31) - 1, size=(2, bands * rows), dtype=np.uint64)
    prime = np.uint64((1 << 31) - 1)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws, keys = [], []
            for w in b["word"]:
                h = _hash(grams(w)) % prime
                m = ((h[None, :] * seeds[0][:, None] + seeds[1][:, None]) % prime).min(axis=1).reshape(bands, rows)
                mixed = m[:, 0]
                for k in range(1, rows):
                    mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + m[:, k]
                mixed = mixed * np.uint64(bands) + np.arange(bands, dtype=np.uint64)
                ws += [w] * bands
                keys.append(mixed.view(np.int64))
            if ws:
                yield pd.DataFrame({"word": ws, "key": np.concatenate(keys)})

    signed = words.mapInPandas(sign, "word string, key bigint")
    full = F.count(F.lit(1)).over(Window.partitionBy("key"))
    return _verified_words(signed.withColumn("size", full))


FULL_BAND = 200


def _verified_words(signed: DataFrame) -> DataFrame:
    signed = cut(signed.filter("size > 1"))
    normal = signed.filter(F.col("size") <= FULL_BAND)
    pairs = normal.select(F.col("word").alias("a"), "key").join(apart(normal.select(F.col("word").alias("b"), "key")), "key").filter("a < b").select("a", "b")
    crowded = signed.filter(F.col("size") > FULL_BAND).select("word").distinct()

    def lacking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w in b["word"]:
                less = {w}
                for _ in range(word_limit(len(w))):
                    less |= {x[:i] + x[i + 1 :] for x in less for i in range(len(x))}
                rows += [(w, x) for x in less]
            yield pd.DataFrame(rows, columns=["word", "less"])

    short = crowded.mapInPandas(lacking, "word string, less string")
    exact = short.select(F.col("word").alias("a"), "less").join(apart(short.select(F.col("word").alias("b"), "less")), "less").filter("a < b").select("a", "b")
    candidates = pairs.unionByName(exact).filter(F.abs(F.length("a") - F.length("b")) <= 2).distinct()

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [edits(x, y, word_limit(min(len(x), len(y)))) <= word_limit(min(len(x), len(y))) for x, y in zip(b["a"], b["b"], strict=True)]
            yield b[keep]

    linked = candidates.mapInPandas(near, "a string, b string")
    return linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))


def spellings(tracks: DataFrame, people: list[str], labels: list[str]) -> DataFrame:
    """(kind, name, n): distinct cells that are one name and aren't garbled, as stored, with their rows."""
    # all fields of people follow one rule, so they are analysed as one
    stacked = tracks.select(F.explode(F.array(*[F.col(f) for f in people])).alias("people"))
    cells = cell_values(stacked, {"people": PEOPLE}, [])
    single = cells.filter(F.size("values") == 1).select(F.lit("people").alias("kind"), F.col("cell").alias("name"), "n_rows")
    long = tracks.select(F.explode(F.array(*[F.col(f) for f in labels])).alias("name")).filter(trimmed(F.col("name")) != "")
    found = single.unionByName(long.select(F.lit("label").alias("kind"), "name", F.lit(1).cast("bigint").alias("n_rows")))
    found = cut(found.groupBy("kind", "name").agg(F.sum("n_rows").alias("n")))
    bad = garbled_texts(found.groupBy(F.col("name").alias("cell")).agg(F.sum("n").alias("n_rows"))).select(F.col("cell").alias("name"))
    return found.join(apart(bad), "name", "left_anti")


#: Names that a word must end, and of the names that hold it the share, to say only that it is a label.
ENDS, ENDS_SHARE = 4, 0.5


def learnt_label_words(names: DataFrame, rounds: int = 3) -> frozenset[str]:
    """Words that end so many labels' names (kind, name) that they tell none from another.

    Each round looks at what stands before the words known so far, so "Sound Works" is learnt from its end. As each such word
    ends ENDS names at least, there are at most a quarter as many as labels, and hardly more than there are words for a label.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"words": [[w for w in WORD.findall(folded(x)) if w not in ARTICLES] for x in b["name"]]})

    words = written(names.filter("kind = 'label'").select("name").mapInPandas(split, "words array<string>").filter(F.size("words") > 0).distinct())
    known: list[str] = []
    for _ in range(rounds):
        bare = words
        if known:
            ends = F.array(*[F.lit(w) for w in known])
            # as many known words as stand at the end, but never all
            cut_off = F.aggregate(F.reverse("words"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, w: F.struct((a["n"] + (a["go"] & F.array_contains(ends, w)).cast("int")).alias("n"), (a["go"] & F.array_contains(ends, w)).alias("go")))["n"]
            bare = words.select(F.slice("words", F.lit(1), F.greatest(F.size("words") - cut_off, F.lit(1))).alias("words")).distinct()
        holding = bare.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("all"))
        ending = bare.filter(F.size("words") > 1).groupBy(F.try_element_at("words", F.lit(-1)).alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= ENDS)
        new = sorted(r.word for r in ending.join(holding, "word").filter(F.col("n") >= ENDS_SHARE * F.col("all")).select("word").collect() if r.word not in known)
        if not new:
            break
        known += new
    return frozenset(known)


def classes(names: DataFrame, label_words: frozenset[str] | set[str] = LABEL_WORDS) -> DataFrame:
    """Adds ``words`` and ``class`` (kind and sorted words) to (kind, name, n)."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [name_words(x, k, label_words) for x, k in zip(b["name"], b["kind"], strict=True)]
            yield b.assign(words=words, **{"class": [k + "\t" + " ".join(sorted(w)) for k, w in zip(b["kind"], words, strict=True)]})

    return names.select("kind", "name", "n").mapInPandas(reduce, "kind string, name string, n bigint, words array<string>, class string").filter(F.size("words") > 0)


#: Family names with at most so many given names are judged first: with more two meet by chance more often.
FEW = 16
#: Family names that must bear a given name, and two together; how many times as often as by chance; and how seldom chance
#: does so.
BORNE, TOGETHER, LIFT, CHANCE = 3, 2, 4.0, 0.01


def short_forms(words: DataFrame) -> DataFrame:
    """(a, b), both ways: given names that are forms of one another, learnt from names (words) of two words.

    Which of the two words is the given name is told by :func:`sides_of`. Two given names are forms of one another if family names bear
    both at least TOGETHER times, LIFT times as often as independent names would, and so often by chance (of a Poisson
    count) in less than CHANCE of cases. Chance is reckoned apart for family names of at most FEW given names, of at most
    twice as many, and so on, and added up; the evidence of each size and all smaller ones may decide, so every family name
    counts. Spellings of one given name are learnt as well; they are no harm.
    """
    two = words.filter((F.size("words") == 2) & (F.length(F.col("words")[0]) > 1) & (F.length(F.col("words")[1]) > 1)).select(F.sort_array("words").alias("w")).distinct()
    sides = sides_of(two).filter(F.col("n") >= BORNE).select("s", "g")
    sizes = sides.groupBy("s").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / FEW))).cast("int").alias("level"))
    kept = written(sides.join(sizes, "s"))
    names_ = written(kept.groupBy("g", "level").agg(F.count(F.lit(1)).alias("n")))
    totals = kept.select("s", "level").distinct().groupBy("level").agg(F.count(F.lit(1)).alias("all"))
    met = kept.select("s", "level", F.col("g").alias("a")).join(kept.select("s", F.col("g").alias("b")), "s").filter("a < b").groupBy("a", "b", "level").agg(F.count(F.lit(1)).alias("k"))
    together = met.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("level", "k"))).alias("k"), F.sum("k").alias("sum")).filter(F.col("sum") >= TOGETHER)
    by_level = together.join(names_.select(F.col("g").alias("a"), "level", F.col("n").alias("na")), "a").join(names_.select(F.col("g").alias("b"), "level", F.col("n").alias("nb")), ["b", "level"]).join(totals, "level")
    evidence = F.struct("level", F.coalesce(F.try_element_at("k", "level"), F.lit(0)).alias("k"), (F.col("na") * F.col("nb") / F.col("all")).alias("by_chance"))
    expected = by_level.groupBy("a", "b").agg(F.sort_array(F.collect_list(evidence)).alias("e")).select("a", "b", F.col("e.k").alias("k"), F.col("e.by_chance").alias("by_chance"))

    def seldom(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[any(_beyond_chance(int(n), rate) for n, rate in zip(np.cumsum(k), np.cumsum(r), strict=True)) for k, r in zip(b["k"], b["by_chance"], strict=True)]][["a", "b"]]

    found = expected.mapInPandas(seldom, "a string, b string")
    return written(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def sides_of(two: DataFrame) -> DataFrame:
    """(s, g, n): family and given name of each name of two words (w), and how many family names bear the given one.

    Given names are borne by more others than family names are. A name alone may tell it wrongly, for a family name with
    many given names has some that are rarer than it. So a word's side is told from all its names: the share in which it is
    the more frequent word, less the mean of that share over the words that it stands with. What is equal in both and as
    frequent is read both ways, so every name counts.
    """
    long = two.select(F.explode(F.array(F.struct(F.col("w")[0].alias("s"), F.col("w")[1].alias("g")), F.struct(F.col("w")[1].alias("s"), F.col("w")[0].alias("g")))).alias("x")).select("x.*")
    borne = long.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    both = written(long.join(apart(borne), "g").join(apart(borne.select(F.col("g").alias("s"), F.col("n").alias("m"))), "s"))
    more = both.groupBy("g").agg(F.avg(F.when(F.col("n") > F.col("m"), 1.0).when(F.col("n") == F.col("m"), 0.5).otherwise(0.0)).alias("more"), F.first("n").alias("n"))
    near = both.join(apart(more.select(F.col("g").alias("s"), F.col("more").alias("others"))), "s").groupBy("g").agg(F.avg("others").alias("others"))
    side = written(more.join(apart(near), "g").select("g", "n", F.struct(F.round(F.col("more") - F.col("others"), 6), "n").alias("side")))
    return long.join(apart(side), "g").join(apart(side.select(F.col("g").alias("s"), F.col("side").alias("other"))), "s").filter("side >= other").select("s", "g", "n")


def _beyond_chance(k: int, rate: float) -> bool:
    """Whether ``k`` is more than LIFT times ``rate``, and a Poisson count so high in less than CHANCE of cases."""
    if k < TOGETHER or k < LIFT * rate:
        return False
    term = less = math.exp(-rate)
    for i in range(1, k):
        term *= rate / i
        less += term
    return 1 - less < CHANCE


def with_forms(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Names (class, words) whose class says behind another tab which other forms (a, b) its words have."""
    of_word = forms.groupBy(F.col("a").alias("word")).agg(F.array_join(F.sort_array(F.collect_set("b")), ",").alias("others"))
    of_class = names.select("class", F.explode("words").alias("word")).join(apart(of_word), "word").groupBy("class").agg(F.array_join(F.sort_array(F.collect_set(F.concat("word", F.lit("="), "others"))), ";").alias("forms"))
    return names.join(apart(of_class), "class", "left").withColumn("class", F.concat("class", F.lit("\t"), F.coalesce("forms", F.lit("")))).drop("forms")


@lru_cache(maxsize=100_000)
def parts_of(class_: str) -> tuple[list[str], Forms]:
    """The words of a class, and the other forms of those that have any: KNOWN ones if the class doesn't say."""
    words, says, text = class_.split("\t", 1)[1].partition("\t")
    if not says:
        return words.split(" "), KNOWN
    return words.split(" "), {w: frozenset(o.split(",")) for w, _, o in (x.partition("=") for x in text.split(";") if x)}


def class_similarity(a: str, b: str) -> float:
    (wa, fa), (wb, fb) = parts_of(a), parts_of(b)
    return monge_elkan(wa, wb, {**fa, **fb})


def letters_of(word: str, forms: Forms = KNOWN) -> set[str]:
    """Letters of which two similar words share one: the first ones, as many as edits may move, and those of other forms."""
    return set(word[: word_limit(len(word)) + 1]) | {f[0] for f in forms.get(word, ())}


def _common_pairs(ranked: DataFrame, links: DataFrame, given: DataFrame) -> DataFrame:
    """(ca, cb), ca < cb, of classes with a common frequent word and a common letter of another word, one of them common.

    ``given`` (a): known given names. A class is common if all its full words are frequent, near a frequent one, or given names: only such a class can lack
    a rare word through which a similar one is found. A word near a frequent one stands for that as well.
    """
    frequent = ranked.filter((F.length("word") > 1) & (F.col("df") > RARE)).select("kind", F.col("word").alias("b")).distinct()
    near = ranked.select("class", "kind", F.col("word").alias("a")).join(apart(links), "a").join(apart(frequent), ["kind", "b"]).select("class", "kind", "a", F.col("b").alias("hot"))
    near = cut(near.distinct())
    own = ranked.filter(F.length("word") > 1).select("class", F.col("word").alias("a"))
    rare = own.join(apart(near.select("class", "a")), ["class", "a"], "left_anti").join(apart(given.select("a")), "a", "left_anti").select("class").distinct()

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, k, h, x) for c, k, a, h in zip(b["class"], b["kind"], b["a"], b["hot"], strict=True) for x in _other_letters(c, a)]
            if rows:
                yield pd.DataFrame(rows, columns=["class", "kind", "hot", "letter"])

    keys = cut(near.mapInPandas(spell, "class string, kind string, hot string, letter string").distinct())
    common = keys.join(apart(rare), "class", "left_anti").select(F.col("class").alias("x"), "kind", "hot", "letter")
    met = common.join(apart(keys.select(F.col("class").alias("y"), "kind", "hot", "letter")), ["kind", "hot", "letter"]).filter("x <> y")
    return met.select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct()


def _other_letters(class_: str, word: str) -> set[str]:
    words, forms = parts_of(class_)
    others = list(words)
    others.remove(word)
    return set().union(*(letters_of(w, forms) for w in others)) if others else {""}


def _given(nodes: DataFrame) -> DataFrame:
    """Words that have other forms: those that the classes name, KNOWN ones where classes don't say."""
    own = F.explode(F.split(F.split_part("class", F.lit("\t"), F.lit(3)), ";")).alias("x")
    named = nodes.select(own).select(F.split_part("x", F.lit("="), F.lit(1)).alias("a")).filter("a <> ''").distinct()
    if nodes.filter(F.size(F.split("class", "\t")) < 3).isEmpty():
        return named
    return named.unionByName(nodes.sparkSession.createDataFrame([(w,) for w in KNOWN], "a string")).distinct()


def class_links(nodes: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), both ways, of verified classes; nodes: (class, kind, words, n); ``given`` (a): given names that
    have other forms, by default those that the classes name."""
    if given is None:
        given = _given(nodes)
    long = nodes.select("class", "kind", F.explode(F.array_distinct("words")).alias("word"))
    freq = long.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("df"))
    least = F.min(F.when(F.length("word") > 1, F.col("df"))).over(Window.partitionBy("class"))
    ranked = cut(long.join(apart(freq), ["kind", "word"]).withColumn("least", least))
    keyed = ranked.filter((F.length("word") > 1) & ((F.col("df") <= RARE) | (F.col("df") == F.col("least")))).select("class", "kind", "word")
    vocabulary = ranked.filter(F.length("word") > 1).select("word").distinct()
    links = word_links(vocabulary.repartition(2 * nodes.sparkSession.sparkContext.defaultParallelism, "word"))
    same = vocabulary.select(F.col("word").alias("a"), F.col("word").alias("b"))
    links = cut(links.unionByName(same))
    left = keyed.select(F.col("class").alias("ca"), "kind", F.col("word").alias("a"))
    right = keyed.select(F.col("class").alias("cb"), "kind", F.col("word").alias("b"))
    pairs = left.join(apart(links), "a").join(apart(right), ["b", "kind"]).filter("ca < cb").select("ca", "cb").unionByName(_common_pairs(ranked, links, given)).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [class_similarity(x, y) for x, y in zip(b["ca"], b["cb"], strict=True)]
            yield b.assign(similarity=s)[[x >= VERIFIED for x in s]]

    good = pairs.mapInPandas(verify, "ca string, cb string, similarity double").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "similarity")
    return cut(good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")))


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(class, hub): every class is a hub or the satellite of the adjacent hub it is most similar to.

    Round by round a class that outranks all its open neighbours (by the sum of its similarities, then rows, then text)
    becomes a hub, and its open neighbours become satellites. A round settles at least the highest class of each component,
    so it ends; only open classes and the links between them go into the next round.
    """
    strength = links.groupBy("a").agg(F.sum("similarity").alias("s"))
    rank = F.struct(F.round(F.coalesce("s", F.lit(0.0)), 6).alias("s"), F.col("n"), F.col("class"))
    ranked = cut(nodes.join(apart(strength), nodes["class"] == strength["a"], "left").select("class", rank.alias("rank")))
    lonely = ranked.join(apart(links.select(F.col("a").alias("class")).distinct()), "class", "left_anti").select("class", F.col("class").alias("hub"))
    edges = cut(links.join(apart(ranked.select(F.col("class").alias("a"), F.col("rank").alias("ra"))), "a").join(apart(ranked.select(F.col("class").alias("b"), F.col("rank").alias("rb"))), "b"))
    done = [lonely]
    while True:
        hubs = cut(edges.groupBy("a").agg(F.max("rb").alias("top"), F.first("ra").alias("own")).filter("own > top").select("a"))
        if hubs.isEmpty():
            break
        reach = edges.join(hubs.select(F.col("a").alias("b")), "b")
        taken = cut(reach.groupBy("a").agg(F.max_by("b", F.struct("similarity", "rb")).alias("hub")))
        settled = hubs.select(F.col("a").alias("class"), F.col("a").alias("hub")).unionByName(taken.select(F.col("a").alias("class"), "hub"))
        done.append(settled)
        gone = settled.select("class")
        before = edges
        edges = cut(edges.join(gone.withColumnRenamed("class", "a"), "a", "left_anti").join(gone.withColumnRenamed("class", "b"), "b", "left_anti"))
        # an open class all of whose neighbours are settled stands alone
        left = before.select("a").distinct().join(gone.withColumnRenamed("class", "a"), "a", "left_anti").join(edges.select("a").distinct(), "a", "left_anti")
        done.append(left.select(F.col("a").alias("class"), F.col("a").alias("hub")))
    from ..skew import union_all

    return cut(union_all(done))


def linked_names(tracks: DataFrame, people: list[str], labels: list[str], known: Forms = KNOWN, label_words: frozenset[str] | set[str] = frozenset(LABEL_WORDS)) -> DataFrame:
    """(kind, name, n, hub): every spelling with the class of its entity.

    ``known``, ``label_words``: forms of given names, and words of labels that say only that it is one, known beforehand,
    beside those that are learnt. A spelling is a whole cell as stored;
    letter case and white space make spellings different. Null and blank cells, cells with several names and garbled cells
    are no spellings. A table without names gives an empty result.
    """
    cells = written(spellings(tracks, people, labels))
    plain = written(classes(cells, label_words | learnt_label_words(cells)))
    forms = short_forms(plain.filter("kind = 'people'").select("words"))
    if known:
        forms = forms.unionByName(tracks.sparkSession.createDataFrame([(a, b) for a, others in known.items() for b in others], "a string, b string")).distinct()
    names = written(with_forms(plain, forms))
    nodes = written(names.groupBy("class", "kind").agg(F.sum("n").alias("n"), F.first("words").alias("words")))
    hubs = star_clusters(nodes, class_links(nodes, forms.select("a").distinct()))
    return names.join(apart(hubs), "class").select("kind", "name", "n", "hub")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a before name_b by code points: each two spellings of one entity."""
    one = linked.select("hub", "name").distinct()
    return one.select("hub", F.col("name").alias("name_a")).join(apart(one.select("hub", F.col("name").alias("name_b"))), "hub").filter("name_a < name_b").select("name_a", "name_b").distinct()
