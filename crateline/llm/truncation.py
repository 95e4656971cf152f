"""Texts that end before their author's end, found by what follows the same beginning elsewhere.

Two self-joins by prefix, of different grain, both fed by one pass over the distinct texts in sorted order:

* Whole texts: distinct texts are range-partitioned and sorted; a text that is a strict prefix of another is a prefix of
  its successor in the order, so each text is compared with one neighbour.
* Last sentences: only few cut texts have a longer copy, but the sentences they break off recur in part. Every sentence of
  the corpus is cut into prefixes of fixed length (a word and the one, two or three tokens before it, hashed), counted by
  how the sentence goes on: it ends, it goes on, or the word itself is longer. The last such prefixes of a text that ends
  without a sign are joined with these counts, and the longest one seen often enough decides. Statistics are over all
  distinct texts and leave the text's own end out.

A text that stands at the limit of its source's field (a length that very many of its texts share, in characters or
bytes of UTF-8) needs stronger evidence to count as complete. What some programs add to a text they cut (an ellipsis) is
taken off before. Digits are alike to each other, letter case doesn't count, names (capitalised words within a sentence)
are alike in the context of a word.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import splits_for, written

#: Words or codes with inner marks; a character of a script without spaces; any other sign.
TOKEN = re.compile(r"https?://\S+|[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:['’\-./:_][^\W_぀-ヿ㐀-鿿]+)*|\n|[^\w\s]")
DIGIT = re.compile(r"\d")
END_SIGNS = set(".!?。！？…)]}»›”\"'’」』】）〉》］｝")
BREAK_SIGNS = set(".!?。！？…\n")
OPEN_SIGNS = set(",;:(/&„“«-–—=<[{#@、，：「『（【・¿¡")
#: What is left of a character whose bytes were cut.
BROKEN = "\ufffd"
#: An ellipsis, as a program adds it to what it cuts and as an author trails off.
ELLIPSIS = re.compile(r"(?:\.{3}|…)$")
#: Occurrences (of ending, going on or being longer) that a context needs to decide.
LEAST = 3
#: Share of endings below which a text counts as cut: usually, at the field's limit, and before an ellipsis elsewhere.
USUAL, AT_LIMIT, TRAILING = 0.35, 0.8, 0.05
#: A word with one token before it decides alone only if its share of endings lies outside these bounds.
UNSURE = (0.05, 0.8)

START, NAME, SEP = "<s>", "<name>", "\x1f"
#: Tokens of context before a word: of words as they are, and of names as they are.
WIDEST, WIDEST_NAMED = 3, 2
#: Distinct tokens remembered by a worker, which starts anew beyond.
TOKENS_HELD = 500_000
#: Distinct runs held by a task before they are handed on.
RUNS_HELD = 500_000


def is_word(t: str) -> bool:
    return t[0].isalnum()


class _Lower(dict):
    """Tokens to lower case, remembered."""

    def __missing__(self, x: str) -> str:
        if len(self) > TOKENS_HELD:
            self.clear()
        self[x] = START if x in BREAK_SIGNS else x.lower()
        return self[x]


class _General(dict):
    """Tokens to what they count as in a context: a sentence's border, a name, or themselves in lower case."""

    def __missing__(self, x: str) -> str:
        if len(self) > TOKENS_HELD:
            self.clear()
        self[x] = START if x in BREAK_SIGNS else NAME if x[0].isupper() and x[-1].isalpha() else x.lower()
        return self[x]


_lower, _general = _Lower(), _General()


def tokens(text: str) -> tuple[list[str], list[str], list[int]]:
    """The text's tokens in lower case, the same with a class in place of names, and where names stand.

    Signs between sentences are START. A capitalised word at the start of a sentence is no name.
    """
    raw = TOKEN.findall(DIGIT.sub("0", text))
    exact = [START, *map(_lower.__getitem__, raw)]
    general = [START, *map(_general.__getitem__, raw)]
    names = []
    for i in [k for k, x in enumerate(general) if x == NAME]:
        j = i - 1
        while not general[j][0].isalnum() and general[j] != START and general[j] != NAME:
            j -= 1  # brackets and quotes before the first word
        if general[j] == START:
            general[i] = exact[i]
        else:
            names.append(i)
    return exact, general, names


def without_pictures(text: str) -> str:
    """The text without the emoji it ends in, which may follow the end of a sentence."""
    n = len(text)
    while n and (text[n - 1].isspace() or unicodedata.category(text[n - 1]) in ("So", "Sk", "Mn", "Cf") and text[n - 1] != BROKEN):
        n -= 1
    return text[:n]


def _key(context: tuple[str, ...]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(SEP.join(context)) - (1 << 63)


def _kind(follower: str) -> int:
    """0 if a sentence ends before this token, 1 if it goes on, 2 at the end of the text."""
    if follower == "":
        return 2
    return 0 if follower == START or (not follower[0].isalnum() and ord(follower[0]) > 0x2000 and follower not in OPEN_SIGNS) else 1


class Runs:
    """Counts of runs of tokens, handed on as (context, word, ends, goes, last) rows.

    A context that begins a sentence is only counted with the sentence's start: it goes on otherwise elsewhere.
    """

    def __init__(self) -> None:
        self.plain: Counter = Counter()
        self.named: Counter = Counter()

    def add(self, exact: list[str], general: list[str], names: list[int]) -> None:
        g = ["", "", *general, ""]
        self.plain.update(zip(g, g[1:], g[2:], g[3:], g[4:]))
        self.named.update([(g[i], g[i + 1], exact[i], g[i + 3]) for i in names])

    def __len__(self) -> int:
        return len(self.plain) + len(self.named)

    def rows(self) -> pd.DataFrame:
        sums: dict[tuple, list[int]] = {}
        for counted, widest in ((self.plain, WIDEST), (self.named, WIDEST_NAMED)):
            for run, n in counted.items():
                word = run[-2]
                if not word or word == START or not (word[0].isalnum() or word == NAME):
                    continue
                k = _kind(run[-1])
                for width in range(widest + 1):
                    c = run[-2 - width : -2]
                    if START in c[1:] or "" in c or (0 < width < widest and c[0] != START and run[-3 - width] == START):
                        continue
                    key = (c, word)
                    row = sums.get(key)
                    if row is None:
                        row = sums[key] = [0, 0, 0]
                    row[k] += n
        self.plain.clear()
        self.named.clear()
        keys: dict[tuple, int] = {}
        contexts = [keys[c] if c in keys else keys.setdefault(c, _key(c)) for c, _ in sums]
        return _frame(RUN, context=contexts, word=[w for _, w in sums], ends=[v[0] for v in sums.values()], goes=[v[1] for v in sums.values()], last=[v[2] for v in sums.values()])


def asked(exact: list[str], general: list[str]) -> list[tuple[int, int, int, str]]:
    """(place, width, context, word) of the last word, in the order in which its prefixes are believed.

    The word as it is with 3, 2 and 1 tokens before it; the word as a name (places 4 to 6); the word alone (place 7).
    """
    out = []
    for width in range(WIDEST, 0, -1):
        c = tuple(general[-1 - width : -1])
        if len(c) < width or START in c[1:] or (width < WIDEST and c[0] != START and general[-2 - width : -1 - width] == [START]):
            continue
        out.append((WIDEST - width, width, _key(c), exact[-1]))
        out.append((WIDEST - width + 4, width, _key(c), NAME))
    out.append((7, 0, _key(()), exact[-1]))
    return out


#: Kinds of rows of the pass: a text, one prefix of its end, the counts of a run, the texts at a partition's borders.
TEXT, ASK, RUN, BORDER = range(4)
COLUMNS = {
    "kind": "tinyint", "text_id": "bigint", "h1": "bigint", "h2": "bigint", "verdict": "string", "trails": "boolean", "named": "boolean", "longer": "boolean", "goes_on": "boolean", "next_char": "string",
    "place": "tinyint", "width": "tinyint", "context": "bigint", "word": "string", "ends": "bigint", "goes": "bigint", "last": "bigint", "pid": "int", "first_text": "string", "last_text": "string",
}
PANDAS = {"tinyint": "Int8", "bigint": "Int64", "int": "Int32", "boolean": "boolean", "string": object}


def _frame(kind: int, **columns: list) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    data = {c: columns.get(c, [kind] * n if c == "kind" else [None] * n) for c in COLUMNS}
    return pd.DataFrame({c: pd.array(v, dtype=PANDAS[COLUMNS[c]]) if PANDAS[COLUMNS[c]] is not object else pd.Series(v, dtype=object) for c, v in data.items()})


def _verdict(text: str) -> tuple[str, bool]:
    """(verdict by the last sign, whether an ellipsis was taken off): '' where the last words must decide."""
    s = text.rstrip()
    if not s:
        return "complete", False
    if s[-1] == BROKEN:
        return "broken", False
    cut = ELLIPSIS.sub("", s).rstrip()
    if cut != s:
        return ("", True) if cut and is_word(cut[-1]) else ("complete", True)
    if s[-1] in OPEN_SIGNS or (s[-1] in "\"'" and s[-2:-1].isspace()):  # a quote after a space opens
        return "open", False
    if not is_word(s[-1]) and without_pictures(s)[-1:] in END_SIGNS:
        return "complete", False
    return "", False


def _goes_on(text: str, longer: str) -> bool:
    """Whether the longer copy goes on within the word or the sentence where ``text`` stops."""
    rest = longer[len(text) :]
    if text[-1:].isalnum() and rest[:1].isalnum():
        return True
    rest = rest.lstrip(" \t")
    return rest[:1].islower() or rest[:1].isdigit() or rest[:1] in (",", ";", ":")


def _pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of all kinds from the distinct texts of a partition, which come sorted."""
    runs = Runs()
    held: tuple | None = None  # the text before, until its successor is known
    first = None
    for b in batches:
        texts: dict[str, list] = {c: [] for c in ("text_id", "h1", "h2", "verdict", "trails", "named", "longer", "goes_on", "next_char")}
        asks: dict[str, list] = {c: [] for c in ("text_id", "place", "width", "context", "word")}

        def note(row: tuple, successor: str | None, texts: dict[str, list] = texts) -> None:
            text = row[-1]
            is_prefix = successor is not None and successor.startswith(text)
            for c, v in zip(texts, [*row[:-1], is_prefix, is_prefix and _goes_on(text, successor), successor[len(text)] if is_prefix else None], strict=True):
                texts[c].append(v)

        for i, h1, h2, text in zip(b["text_id"], b["h1"], b["h2"], b["text"], strict=True):
            first = text if first is None else first
            if held is not None:
                note(held, text)
            verdict, trails = _verdict(text)
            exact, general, names = tokens(text)
            runs.add(exact, general, names)
            named = False
            if verdict == "":
                if trails:
                    exact, general, _ = tokens(ELLIPSIS.sub("", text.rstrip()))
                if is_word(exact[-1]):
                    named = general[-1] == NAME
                    for place, width, context, word in asked(exact, general):
                        for c, v in zip(asks, (i, place, width, context, word), strict=True):
                            asks[c].append(v)
            held = (i, h1, h2, verdict, trails, named, text)
        if texts["text_id"]:
            yield _frame(TEXT, **texts)
        if asks["text_id"]:
            yield _frame(ASK, **asks)
        if len(runs) > RUNS_HELD:
            yield runs.rows()
    if held is not None:
        row = dict(zip(("text_id", "h1", "h2", "verdict", "trails", "named"), ([v] for v in held), strict=False))
        yield _frame(BORDER, **row, pid=[TaskContext.get().partitionId()], first_text=[first], last_text=[held[-1]])
        yield runs.rows()


def _read(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows of the pass, its texts) of distinct texts (text_id, text).

    The last text of a partition has its successor in the next one: a row for each partition settles that.
    """
    hashed = texts.filter(F.length("text") > 0).select("text_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text")
    placed = hashed.repartitionByRange(splits_for(texts), "text").sortWithinPartitions("text")
    rows = written(placed.mapInPandas(_pass, ", ".join(f"{c} {t}" for c, t in COLUMNS.items())))
    kept = ["text_id", "h1", "h2", "verdict", "trails", "named", "longer", "goes_on", "next_char"]
    after = F.lead("first_text").over(Window.partitionBy(F.lit(1)).orderBy("pid"))
    border = rows.filter(F.col("kind") == BORDER).withColumn("after", after)
    is_prefix = F.coalesce(F.col("after").startswith(F.col("last_text")), F.lit(False))
    rest = F.substr("after", F.length("last_text") + 1)
    on = (F.col("last_text").rlike(r"[\p{L}\p{N}]$") & rest.rlike(r"^[\p{L}\p{N}]")) | rest.rlike(r"^[ \t]*[\p{Ll}\p{Nd},;:]")
    border = border.withColumn("longer", is_prefix).withColumn("goes_on", is_prefix & F.coalesce(on, F.lit(False))).withColumn("next_char", F.when(is_prefix, F.substring(rest, 1, 1)))
    return rows, rows.filter(F.col("kind") == TEXT).select(*kept).unionByName(border.select(*kept))


def prefixes_of_longer(texts: DataFrame) -> DataFrame:
    """(text_id, longer, next_char): for each distinct text (text_id, text) that is a strict prefix of another, what follows.

    Sorted texts are compared with their successor only. Empty texts have no row.
    """
    return _read(texts)[1].filter("longer").select("text_id", "longer", "next_char")


def _scores(rows: DataFrame) -> DataFrame:
    """(text_id, score): the share of endings among all readings of each asked text's end."""
    asks = rows.filter(F.col("kind") == ASK).select("text_id", "place", "width", "context", "word")
    runs = rows.filter(F.col("kind") == RUN).groupBy("context", "word").agg(*[F.sum(c).alias(c) for c in ("ends", "goes", "last")])
    wanted = asks.select("context", "word").distinct()
    near = written(runs.join(wanted.select("context").distinct(), "context", "left_semi"))
    # every strict beginning of a word in its context
    parts = F.expr("transform(sequence(1, length(word) - 1), k -> substring(word, 1, k))")
    longer = near.filter((F.length("word") > 1) & (F.col("word") != NAME)).select("context", F.explode(parts).alias("word"), (F.col("ends") + F.col("goes") + F.col("last")).alias("c"))
    longer = longer.groupBy("context", "word").agg(F.sum("c").alias("longer"))
    stats = wanted.join(near, ["context", "word"], "left").join(longer, ["context", "word"], "left").fillna(0, ["ends", "goes", "last", "longer"])
    j = asks.join(stats, ["context", "word"])
    # the text's own end is one of the "last"
    ending = F.col("ends") + F.greatest(F.col("last") - 1, F.lit(0))
    weight = ending + F.col("goes") + F.col("longer")
    j = j.withColumn("weight", weight).withColumn("score", ending / F.greatest(weight, F.lit(1)))
    enough = F.col("weight") >= LEAST
    sure = enough & ((F.col("width") != 1) | (F.col("score") <= UNSURE[0]) | (F.col("score") >= UNSURE[1]))
    as_name = F.col("place").between(4, 6)
    pick = F.struct("place", "score")
    texts = rows.filter(F.col("kind").isin(TEXT, BORDER)).select("text_id", "named")
    best = j.groupBy("text_id").agg(
        F.min(F.when(sure & ~as_name, pick)).alias("sure"), F.min(F.when(sure, pick)).alias("sure_named"), F.min(F.when(enough & ~as_name, pick)).alias("some"), F.min(F.when(enough, pick)).alias("some_named"),
        F.max(F.when(F.col("width") == 0, F.col("ends") + F.col("goes"))).alias("whole"), F.max(F.when(F.col("width") == 0, F.col("longer"))).alias("begins"), F.max(F.when(F.col("width") == 0, F.col("word"))).alias("word"),
    )
    best = best.join(texts, "text_id")
    known = F.col("whole") > 0
    # a word that stands nowhere else may be a name in lower case
    special = F.col("named") | (~known & F.col("word").rlike(r"^\p{L}+$"))
    chosen = F.when(special, F.coalesce("sure_named", "some_named")).otherwise(F.coalesce("sure", "some"))
    # nowhere else a word, but the beginning of one: cut inside, unless the word's own contexts say otherwise
    first = F.coalesce(F.when(special, F.col("sure_named.place")).otherwise(F.col("sure.place")), F.lit(99))
    score = F.when(~known & (F.col("begins") > 0) & (first > 3), F.lit(0.0)).otherwise(chosen["score"])
    return best.select("text_id", score.alias("score"))


def field_limits(docs: DataFrame) -> DataFrame:
    """(source, unit, at): lengths that very many texts of a source share, and none exceeds by much."""
    sized = docs.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("n")))).alias("s")).select("source", "s.*")
    counts = sized.filter("n >= 20").groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("source", "unit").agg(F.sum("c").alias("all"), F.max_by("n", F.struct("c", "n")).alias("at"), F.max("c").alias("c"), F.count(F.lit(1)).alias("lengths"))
    usual = (F.col("all") - F.col("c")) / F.greatest(F.col("lengths") - 1, F.lit(1))
    above = counts.join(totals.select("source", "unit", "at"), ["source", "unit"]).groupBy("source", "unit").agg(F.sum(F.when(F.col("n") > F.col("at") + 4, F.col("c")).otherwise(0)).alias("above"))
    return totals.join(above, ["source", "unit"]).filter((F.col("c") >= 5) & (F.col("c") >= 0.02 * F.col("all")) & (F.col("c") >= 8 * usual) & (F.col("above") <= 0.002 * F.col("all"))).select("source", "unit", "at")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, truncated, reason, score, at_limit, longer) of every document with a text.

    Null, empty and blank texts are complete. Equal texts of one source get one verdict. Texts that end in a sign of the
    end are complete, those that end in U+FFFD are cut inside a character. An ellipsis after a whole sentence trails off on
    purpose; after a part of a word or sentence it doesn't. A text without any known prefix (as one whose last sign says
    nothing) is complete unless it has a longer copy or stands at its field's limit. Null doc_ids have no row; of the rows
    of a repeated doc_id a truncated one counts, then the greatest source.
    """
    own = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "source", "text")
    rows, texts = _read(own.groupBy("text").agg(F.min("doc_id").alias("text_id")))
    verdicts = texts.join(_scores(rows), "text_id", "left").select("h1", "h2", "verdict", "trails", "longer", "goes_on", "score").filter("verdict <> 'complete'")
    limits = field_limits(own)
    chars = limits.filter("unit = 'chars'").select("source", F.col("at").alias("most_chars"))
    octets = limits.filter("unit = 'bytes'").select("source", F.col("at").alias("most_bytes"))
    out = own.select("doc_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("octets"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    at_limit = F.coalesce(F.col("chars") == F.col("most_chars"), F.lit(False)) | F.coalesce((F.col("octets") <= F.col("most_bytes")) & (F.col("octets") > F.col("most_bytes") - 4), F.lit(False))
    out = out.join(verdicts, ["h1", "h2"], "left").join(chars, "source", "left").join(octets, "source", "left").withColumn("at_limit", at_limit)
    trails = F.coalesce("trails", F.lit(False))
    below = F.when(F.col("at_limit"), AT_LIMIT).when(trails, TRAILING).otherwise(USUAL)
    reason = (
        F.when(F.col("verdict").isNull(), None)
        .when(F.col("verdict") != "", F.col("verdict"))
        .when(F.col("goes_on"), "prefix")
        .when(F.col("score") < below, "context")
        .when(F.col("score").isNull() & F.col("at_limit"), "limit")
    )
    row = F.struct(reason.isNotNull().alias("truncated"), "source", reason.alias("reason"), "score", "at_limit", F.coalesce("longer", F.lit(False)).alias("longer"))
    one = out.groupBy("doc_id").agg(F.max(row).alias("r"))
    return one.select("doc_id", "r.source", "r.truncated", "r.reason", "r.score", "r.at_limit", "r.longer")


def rates(verdicts: DataFrame) -> DataFrame:
    """How often each source cuts: (source, docs, truncated_docs, rate, at_limit_docs)."""
    return verdicts.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col("truncated").cast("bigint")).alias("truncated_docs"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"),
        F.sum(F.col("at_limit").cast("bigint")).alias("at_limit_docs"),
    )
