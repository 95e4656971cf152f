r"""Several values packed in one cell: one row per value, with its position.

The cell is split on its delimiters, but what must stay whole is first taken out: quoted spans, and names that contain a
delimiter themselves. Each such span is replaced by an indexed placeholder, the rest is split, the span is restored by a
lookup in the cell's own array of spans, and the array is exploded with positions.

Which names contain a delimiter is learnt from the column itself:

* an *act* is a whole cell none of whose parts ever stands alone in the table ("Bell, Book & Candle": neither Bell, Book
  nor Candle is a cell of its own), while the parts of a list do stand alone elsewhere;
* in an *inverted name* ("Doe, Jane", "Foo Quartet, The") the part behind the comma is one that begins other names;
* a *catalogue entry* ("Drum & Bass" in a list of styles) is given by the caller.

Only distinct cells are analysed; the rows join their cell's result through :func:`crateline.skew.join_counted`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, written
from ..skew import join_counted, union_all

#: Private-use characters. One that already occurs in a cell is escaped, so a placeholder can't be mistaken for text.
HOLD, ESC, MARK = "", "", ""
QUOTED = r'(?:(?<=^)|(?<=[;,/|\\\n\t&+·\-])|(?<=\s))"([^"]*)"(?=\s*(?:$|[;,/|\\\n\t&+·]|-\s))'
#: A comma with a single word behind it, as in every inverted name.
LAST_WORD = r",\s*[^\s;,/|\\&+]+\s*(?:$|[;,/|\\\n&+·]|-\s|and\s|feat|ft|vs|with|x\s)"


@dataclass(frozen=True)
class FieldRule:
    """How one field packs values.

    ``weak`` delimiters may belong to a name, ``strong`` ones never do. ``inverted``: the field holds names that may be
    turned round a comma. ``act_rows``: rows a whole cell needs to be learnt as an act (None: learn none). ``entries``:
    catalogue entries that contain a delimiter. ``case_sensitive_strong`` are strong delimiters matched with their case.
    """

    weak: str
    strong: str
    strong_cased: str = r"\s+x\s+"
    inverted: bool = True
    act_rows: int | None = 1
    entries: tuple[str, ...] = field(default=())

    @property
    def any_strong(self) -> str:
        return f"(?:(?i:{self.strong})|(?:{self.strong_cased}))"

    @property
    def any(self) -> str:
        return f"(?:(?i:{self.strong})|(?:{self.strong_cased})|(?i:{self.weak}))"


PEOPLE = FieldRule(
    weak=r"\s*[;,/]\s*|\s+[&+]\s+|\s+and\s+",
    strong=r"\s*[|\\\n\t]\s*|\s*//+\s*|\s+·\s+|\s+(?:feat\.?|ft\.?|featuring|vs\.?|with)\s+",
)
WRITERS = FieldRule(
    weak=r"\s*[;,/]\s*|\s+[&+]\s+|\s+and\s+",
    strong=r"\s*[|\\\n\t]\s*|\s*//+\s*|\s+[·-]\s+",
    act_rows=None,
)


def packed_entries(catalogue: DataFrame, column: str = "style") -> list[str]:
    """All entries of a fixed catalogue that contain a delimiter: a list given by hand, which is read whole."""
    found = catalogue.filter(F.col(column).rlike("[,/&;+]")).select(column).distinct()
    return sorted(r[0] for r in found.collect())


def style_rule(entries: list[str]) -> FieldRule:
    """Styles: entries of the catalogue that contain a delimiter stay whole; the catalogue is small and given."""
    return FieldRule(
        weak=r"\s*[;,/]\s*|\s+[&+]\s+", strong=r"\s*[|\\\n\t]\s*|\s*//+\s*|\s+·\s+", strong_cased=r"(?!)", inverted=False, act_rows=3,
        entries=tuple(e for e in entries if any(c in e for c in ",/&;+")),
    )


def trimmed(c: Column) -> Column:
    """Without white space at both ends, of whatever Unicode kind."""
    return F.regexp_replace(c, r"(?U)^[\s ﻿]+|[\s ﻿]+$", "")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC), F.lit(ESC + "1")), F.lit(HOLD), F.lit(ESC + "0"))


def _unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESC + "0"), F.lit(HOLD)), F.lit(ESC + "1"), F.lit(ESC))


def _masked(cells: DataFrame, rule: FieldRule) -> DataFrame:
    """Adds ``masked`` (quoted spans and catalogue entries replaced by placeholders), ``held`` (those spans) and ``arr``
    (parts at even places, the delimiters between them at odd places)."""
    pattern = QUOTED
    if rule.entries:
        import re

        entries = "|".join(re.escape(e).replace(r"\ ", r"\s+") for e in sorted(rule.entries, key=len, reverse=True))
        pattern = rf"{QUOTED}|(?i)(?<![\p{{L}}\p{{N}}])(?:{entries})(?![\p{{L}}\p{{N}}])"
    e = _escaped(F.col("cell"))
    pieces = F.split(e, pattern, -1)
    masked = F.array_join(F.transform(pieces, lambda x, i: F.when(i > 0, F.concat(F.lit(HOLD), (i - 1).cast("string"), F.lit(HOLD), x)).otherwise(x)), "")
    held = F.transform(F.regexp_extract_all(e, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, '^"([^"]*)"$', "$1"))
    return (
        cells.withColumn("masked", masked)
        .withColumn("held", held)
        .withColumn("arr", F.split(F.regexp_replace("masked", rule.any, f"{MARK}$0{MARK}"), MARK))
    )


def _simple(cells: DataFrame, rule: FieldRule) -> DataFrame:
    """Cells without any delimiter, lower-cased: the names that stand alone."""
    t = trimmed(F.col("cell"))
    return cells.filter(~F.col("cell").rlike(rule.any) & ~F.col("cell").contains('"')).select(F.lower(t).alias("name"), t.alias("as_typed")).filter("name <> ''")


def _spans(parsed: DataFrame, sizes: list[int]) -> DataFrame:
    """Runs of neighbouring parts of each cell, with the text between, of each of the numbers of parts in ``sizes``."""
    n = F.size("arr")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: (i % 2 == 0) & (i + 2 < n))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: i + 2 * k - 2 < n),
        lambda k: F.struct(i.alias("start"), k.alias("parts"), trimmed(F.array_join(F.slice("arr", i + 1, 2 * k - 1), "")).alias("text"), F.try_element_at("arr", i + 2).alias("sep"), F.try_element_at("arr", i + 3).alias("next"), F.try_element_at("arr", i + 1).alias("first")),
    )))
    return parsed.filter(n >= 3).select("field", "cell", F.explode(runs).alias("r")).select("field", "cell", "r.*")


def _acts(parsed: DataFrame, names: DataFrame, rule: FieldRule) -> tuple[DataFrame, list[int]]:
    """(text) of whole cells none of whose parts stands alone, and that contain no smaller such cell; and the numbers of
    parts that such cells have: as many as there are lengths of lists, whatever the number of rows."""
    # some part is one word: two full names between delimiters are a list, even if both are rare
    one_word = F.exists(F.filter("arr", lambda x, i: i % 2 == 0), lambda x: ~trimmed(x).rlike(r"\s"))
    several = parsed.filter((F.size("arr") >= 3) & (F.col("n_rows") >= rule.act_rows) & (F.size("held") == 0) & one_word & ~F.col("cell").rlike(rule.any_strong))
    parts = several.select("field", "cell", ((F.size("arr") + 1) / 2).cast("int").alias("parts"), F.explode(F.filter("arr", lambda x, i: i % 2 == 0)).alias("part")).select("field", "cell", "parts", F.lower(trimmed(F.col("part"))).alias("name"))
    # an empty part (a delimiter doubled or at an end) makes it a list
    unknown = written(
        parts.join(names.select("name").distinct().withColumn("alone", F.lit(1)), "name", "left")
        .groupBy("field", "cell", "parts")
        .agg(F.max(F.when((F.col("name") == "") | F.col("alone").isNotNull(), 1).otherwise(0)).alias("some"))
        .filter("some = 0")
        .select("field", "cell", "parts", F.lower(trimmed(F.col("cell"))).alias("text"))
    )
    sizes = sorted(r.parts for r in unknown.select("parts").distinct().collect())
    if len(sizes) > 1:  # a smaller one inside has fewer parts
        inside = _spans(parsed.join(unknown.filter(F.col("parts") > sizes[0]).select("field", "cell"), ["field", "cell"], "left_semi"), sizes[:-1]).filter(F.length("text") < F.length(trimmed(F.col("cell")))).select("cell", F.lower("text").alias("text"))
        wider = inside.join(unknown.select("text"), "text", "left_semi").select("cell")
        unknown = unknown.join(wider, "cell", "left_anti")
    return unknown.select("text").distinct(), sizes


def _kept(parsed: DataFrame, acts: DataFrame | None, sizes: list[int], prefixes: DataFrame | None, names: DataFrame) -> DataFrame:
    """The spans of each cell that stay whole: acts, and inverted names."""
    kinds = []
    if acts is not None:
        kinds.append(_spans(parsed, sizes).withColumn("text", F.lower("text")).join(acts, "text", "left_semi").select("field", "cell", "start", "parts"))
    if prefixes is not None:
        turned = _spans(parsed.filter(F.col("cell").rlike(LAST_WORD)), [2]).filter(F.col("sep").rlike(r"^\s*,\s*$")).withColumn("token", trimmed(F.col("next"))).filter(~F.col("token").rlike(r"\s") & (trimmed(F.col("first")) != ""))
        initial = turned.filter(F.col("token").rlike(r"^\p{Lu}\.?$"))
        given = turned.filter(~F.col("token").rlike(r"^\p{Lu}\.?$")).withColumn("name", F.lower("token")).join(prefixes, "name", "left_semi").join(names.select("name"), "name", "left_anti")
        kinds += [x.select("field", "cell", "start", "parts") for x in (initial, given)]
    return union_all(kinds).groupBy("field", "cell").agg(F.sort_array(F.collect_set(F.struct("start", (-F.col("parts")).alias("less"), "parts"))).alias("spans"))


def _values(parsed: DataFrame, kept: DataFrame | None, rule: FieldRule) -> DataFrame:
    """``values``: the array of the cell's values in order."""
    if kept is None:
        parsed = parsed.withColumn("picked", F.expr("cast(array() as array<struct<start:int,parts:int>>)"))
    else:
        # leftmost first, longest first, none that overlaps one before
        step = "aggregate(spans, cast(array() as array<struct<start:int,parts:int>>), (a, s) -> if(size(a) = 0 or try_element_at(a, -1).start + 2 * try_element_at(a, -1).parts <= s.start, array_append(a, struct(s.start as start, s.parts as parts)), a))"
        parsed = parsed.join(kept, ["field", "cell"], "left").withColumn("picked", F.coalesce(F.expr(step), F.expr("cast(array() as array<struct<start:int,parts:int>>)")))
    whole = F.transform("picked", lambda s: trimmed(F.array_join(F.slice("arr", s["start"] + 1, 2 * s["parts"] - 1), "")))
    # each picked span becomes one placeholder, its other parts vanish
    remasked = F.array_join(F.transform("arr", lambda x, i: F.coalesce(
        F.try_element_at(F.filter(F.transform("picked", lambda s, k: F.when(i == s["start"], F.concat(F.lit(HOLD), (k + F.size("held")).cast("string"), F.lit(HOLD))).when((i > s["start"]) & (i < s["start"] + 2 * s["parts"] - 1), F.lit(""))), lambda y: y.isNotNull()), F.lit(1)), x)), "")
    parsed = parsed.withColumn("look", F.concat("held", whole)).withColumn("remasked", remasked)

    def restored(v: Column) -> Column:
        lookup = lambda k: F.try_element_at("look", F.expr("cast(1 as int)") + k.cast("int"))
        # a kept span may hold a quoted one: two passes restore both
        once = lambda t: F.array_join(F.transform(F.split(t, HOLD, -1), lambda x, i: F.when(i % 2 == 1, lookup(x)).otherwise(x)), "")
        return _unescaped(trimmed(once(once(v))))

    values = F.filter(F.transform(F.split("remasked", rule.any, -1), restored), lambda v: v != "")
    return parsed.select("field", "cell", "n_rows", values.alias("values"))


def cell_values(rows: DataFrame, rules: dict[str, FieldRule], name_fields: list[str]) -> DataFrame:
    """Distinct non-blank cells of the ruled fields: (field, cell, n_rows, values).

    ``name_fields`` are further columns whose undivided cells also count as names that stand alone. Null and blank cells
    have no row, an empty table gives an empty result; other columns are ignored.
    """
    fields = list(dict.fromkeys([*rules, *name_fields]))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields])).alias("s")).select("s.*")
    cells = cut(long.filter(trimmed(F.col("cell")) != "").groupBy("field", "cell").agg(F.count(F.lit(1)).alias("n_rows")))
    names = None
    if any(r.inverted or r.act_rows for r in rules.values()):
        person = [f for f in fields if f not in rules or rules[f].inverted]
        alone = _simple(cells.filter(F.col("field").isin(person)), PEOPLE)
        names = cut(alone.groupBy("name").agg(F.min("as_typed").alias("as_typed")))
        first = F.split("as_typed", r"\s+", 2)
        prefixes = cut(
            names.filter(F.size(first) == 2).select(F.lower(first[0]).alias("name"), F.lower(first[1]).alias("rest")).groupBy("name").agg(F.min("rest").alias("low"), F.max("rest").alias("high")).filter("low <> high").select("name")
        )
    out = []
    for f, rule in rules.items():
        parsed = _masked(cells.filter(F.col("field") == f), rule)
        acts, sizes, kept = None, [], None
        own = names
        if rule.act_rows:
            if not rule.inverted:
                own = _simple(cells.filter(F.col("field") == f), rule).select("name").distinct()
            acts, sizes = _acts(parsed, own, rule)
            if not sizes:  # none was learnt
                acts = None
        if acts is not None or rule.inverted:
            kept = _kept(parsed, acts, sizes, prefixes if rule.inverted else None, own)
        out.append(_values(parsed, kept, rule))
    return union_all(out)


def split_values(rows: DataFrame, id_col: str, rules: dict[str, FieldRule], name_fields: list[str] = [], least: int = 2) -> DataFrame:  # noqa: B006
    """One row per value of each cell with at least ``least`` values: (``id_col``, field, pos, val), distinct.

    ``pos`` counts non-empty values from 1; ``val`` is trimmed and without enclosing quotes. Null or blank cells and null
    ids give no row; a repeated row counts once; ties can't occur, because the order is that of the cell.
    """
    cells = cell_values(rows, rules, name_fields)
    cells = cut(cells.filter(F.size("values") >= least))
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in rules]))
    some = "|".join(f"(?:{r.any})" for r in rules.values()) if least > 1 else None
    fact = rows.filter(F.col(id_col).isNotNull()).select(id_col, fields.alias("s")).select(id_col, "s.*").filter(F.col("cell").isNotNull())
    if some:
        fact = fact.filter(F.col("cell").rlike(some))
    fact = fact.dropDuplicates([id_col, "field", "cell"])
    joined = join_counted(fact, cells, ["field", "cell"])
    exploded = joined.select(id_col, "field", F.posexplode("values").alias("p", "val"))
    return exploded.select(id_col, "field", (F.col("p") + 1).cast("int").alias("pos"), "val")
