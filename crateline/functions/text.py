"""Text functions of a music catalogue as columns, all inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say the same in titles.
WORD_FORMS = {"volume": "vol", "part": "pt", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12"}
# Extension to format, target formats' default bit rates, currency symbols.
FORMATS = {"mp3": "mp3", "aac": "aac", "m4a": "aac", "wav": "wav", "aif": "aiff", "aiff": "aiff", "flac": "flac"}
BITRATES = {"mp3": 320, "aac": 256}
EXTENSIONS = {"mp3": "mp3", "aac": "m4a", "wav": "wav", "aiff": "aiff", "flac": "flac"}
CURRENCIES = {"USD": "$", "CAD": "$", "AUD": "$", "NZD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
# Pages of the public release database.
RELEASE_PAGE, SEARCH_PAGE = "https://www.discogs.com/release/", "https://www.discogs.com/search/?type=release&q="


def filled(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def norm_loose(c: Column) -> Column:
    """Lower-case words of letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def norm_match(c: Column) -> Column:
    """As :func:`norm_loose`, with one form for words that say the same."""
    forms = F.create_map(*[F.lit(x) for kv in WORD_FORMS.items() for x in kv])
    return F.array_join(F.transform(F.split(norm_loose(c), " "), lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")


def overlaps(a: Column, b: Column) -> Column:
    """Both non-empty, and equal or one within the other."""
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def strip_release_number(c: Column) -> Column:
    return F.regexp_replace(c, r" \(\d*\)$", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def without_number(c: Column) -> Column:
    """Without a leading track number and the dots, brackets and dashes behind it, unless nothing else is left."""
    return F.regexp_replace(F.ltrim(c), r"^\d*+[.)\-]*+\s*+(?=\S)", "")


def parse_filename(stem: Column) -> tuple[Column, Column]:
    """(artist, title) of 'NN - Artist - Title': leading numbers go, the first part is the artist, the rest the title."""
    plain = F.replace(stem, F.lit("‐"), F.lit("-"))
    trimmed = F.transform(F.split(plain, " - "), lambda p: F.trim(p))
    first_word = F.array_position(F.transform(trimmed, lambda p: F.when(p.rlike(r"^[0-9]+$"), 0).otherwise(1)), 1).cast("int")
    kept = F.slice(trimmed, F.greatest(first_word, F.lit(1)), F.size(trimmed))
    several = (first_word > 0) & (F.size(kept) >= 2)
    first = without_number(F.try_element_at(kept, F.lit(1)))
    rest = F.array_join(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(1))), " - ")
    return filled(F.when(several, first)), filled(F.when(several, rest).when(first_word > 0, first).otherwise(plain))


def parse_year(c: Column) -> Column:
    y = F.regexp_extract(c, r"^(\d+)", 1).try_cast("int")
    return F.when(y.between(1900, 2200), y)


def head_number(c: Column) -> Column:
    """The number before '/' or '-': 3 of '3/12'; at most 65 535."""
    n = F.regexp_extract(c, r"^\s*(\d{1,9})\s*(?:[/-].*)?$", 1).try_cast("int")
    return F.when(n <= 65_535, n)


def tempo_tag(c: Column) -> Column:
    """A tempo tag, null outside 1 to 400."""
    return F.when(c.between(1.0, 400.0), c)


def is_compilation(c: Column) -> Column:
    return F.trim(c).isin("1", "true", "True")


def parse_decibels(c: Column) -> Column:
    """A gain with or without its unit: -7.23 of '-7.23 dB'."""
    return F.regexp_replace(F.trim(c), r"[A-Za-z ]+$", "").try_cast("double")


def decibels(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.format_string("%.2f", c.cast("double")), F.lit(" dB")))


def plain_number(c: Column) -> Column:
    """A number for a tag: 128 and not 128.0."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def age(then: Column, now: Column, suffix: str = "") -> Column:
    """today, yesterday, 5d, 3w, 2mo, 1y (with ``suffix``, as ' ago'); a dash for nothing or the future."""
    d = F.floor((now - then) / 86400)
    n = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(unit + suffix))
    return (
        F.when(then.isNull() | (then <= 0) | (then > now), "—").when(d == 0, "today").when(d == 1, "yesterday").when(d < 7, n(d, "d")).when(d < 30, n(d / 7, "w")).when(d < 365, n(d / 30, "mo")).otherwise(n(d / 365, "y"))
    )


def price(amount: Column, currency: Column, exact: bool = True) -> Column:
    """The amount with its currency's sign before it, or else its code behind it."""
    code = F.upper(F.trim(F.coalesce(currency, F.lit(""))))
    symbol = F.lit(None).cast("string")
    for known, sign in CURRENCIES.items():
        symbol = F.when(code == known, sign).otherwise(symbol)
    number = F.format_string("%.2f", amount) if exact else F.round(amount).cast("bigint").cast("string")
    return F.when(symbol.isNotNull(), F.concat(symbol, number)).when(code != "", F.concat(number, F.lit(" "), code)).otherwise(number)


def shortened(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def version_newer(a: Column, b: Column) -> Column:
    """Dotted numbers, what follows a dash ignored; false if either is no version."""
    nums = lambda c: F.transform(F.split(F.regexp_replace(c, r"[-+].*$", ""), r"\."), lambda x: x.try_cast("int"))
    ok = lambda c: c.rlike(r"^\d+(\.\d+)*([-+].*)?$")
    na, nb = nums(a), nums(b)
    most = F.greatest(F.size(na), F.size(nb))
    wide = lambda x: F.transform(F.sequence(F.lit(1), most), lambda i: F.coalesce(F.try_element_at(x, i), F.lit(0)))
    return F.coalesce(ok(a) & ok(b) & (wide(na) > wide(nb)), F.lit(False))


def youtube_id(url: Column) -> Column:
    v = F.regexp_extract(url, r"(?:youtu\.be/|/embed/|[?&]v=)([A-Za-z0-9_-]+)", 1)
    return F.when((v != "") & url.rlike(r"youtu\.?be"), v)


def title_tails(c: Column) -> Column:
    """The whole normalised title and every tail behind a dash, bar or bullet, without repeats."""
    parts = F.split(c, r"[-–—|•]")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: norm_loose(F.array_join(F.slice(parts, i, F.size(parts)), " ")))
    return F.filter(F.array_distinct(tails), lambda t: t != "")


def under_prefix(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def moved(path: Column, old: str, new: str) -> Column:
    """The path under its new root, null if it isn't under the old one; only whole components count."""
    return F.when(under_prefix(path, old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1))))


def safe_file_name(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r'[/\\:*?"<>|]', "-")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    return F.when(t.rlike(r"[\p{L}\p{N}]"), t)


def metadata_stem(artist: Column, title: Column) -> Column:
    """'Artist - Title' as a file's name, or the one there is; null if nothing of a name is left."""
    return safe_file_name(F.coalesce(F.concat(filled(artist), F.lit(" - "), filled(title)), filled(artist), filled(title)))


def target_path(path: Column, fmt: Column, folder: str | None = None, stem: Column | None = None) -> Column:
    """Where a file goes when converted: its folder or ``folder``, its stem or ``stem``, the format's extension.

    What follows a stem's last dot is taken for an extension and replaced.
    """
    where = F.lit(folder.rstrip("/")) if folder is not None else F.regexp_replace(path, "/[^/]*$", "")
    name = F.regexp_replace(file_stem(path) if stem is None else F.coalesce(stem, file_stem(path)), r"(?<=.)\.[^.]*$", "")
    ext = F.lit("bin")
    for f, e in EXTENSIONS.items():
        ext = F.when(fmt == f, e).otherwise(ext)
    return F.concat(where, F.lit("/"), name, F.lit("."), ext)


def target_bitrate(fmt: Column, kbps: Column) -> Column:
    """kbps asked for or the format's default; null where the format has no such choice."""
    out = F.lit(None).cast("int")
    for f, default in BITRATES.items():
        out = F.when(fmt == f, F.coalesce(kbps, F.lit(default))).otherwise(out)
    return out.cast("int")


def search_text(artist: Column, album: Column, title: Column) -> Column:
    """What to search a release by: artist and album, without an album the title."""
    return F.concat_ws(" ", filled(artist), F.coalesce(filled(album), filled(title)))


def pair_text(artist: Column, title: Column) -> Column:
    return F.concat_ws(" - ", filled(artist), filled(title))


def release_link(release_id: Column, query: Column) -> Column:
    """The page of a known release, otherwise that of a search."""
    return F.coalesce(F.concat(F.lit(RELEASE_PAGE), filled(release_id)), F.concat(F.lit(SEARCH_PAGE), percent_encoded(query)))


def caption(year: Column, fmt: Column, label: Column | None = None, number: Column | None = None) -> Column:
    """'1993 · Vinyl · Label CAT 1' of what there is."""
    parts = [year.cast("string"), fmt]
    if label is not None:
        both = F.concat_ws(" ", label, number)
        parts.append(F.when(both != "", both))
    return F.concat_ws(" · ", *parts)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def format_of(path: Column) -> Column:
    e = extension(path)
    out = F.lit("other")
    for k, v in FORMATS.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def percent_encoded(c: Column) -> Column:
    """All but letters, digits and -_.~ as %XX of their UTF-8 bytes."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def nfc(c: Column) -> Column:
    """Canonical composition; there is no such function in the JVM's SQL library."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(c)


def search(columns: list[str], text: str | None) -> Column:
    """All terms, each in any of the columns, without regard to case; a blank text finds everything."""
    terms = (text or "").lower().split()
    each = [reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t) for c in columns]) for t in terms]
    return reduce(lambda a, b: a & b, each) if each else F.lit(True)


def cell_filter(c: Column, needle: str) -> Column:
    """Comma means or; a needle in quotes must equal the whole cell; commas alone filter nothing."""
    n = needle.strip()
    shown = F.lower(F.coalesce(c, F.lit("")))
    if len(n) >= 2 and n[0] == n[-1] == '"':
        return shown == n[1:-1].lower()
    wanted = [p.strip().lower() for p in n.split(",") if p.strip()]
    return reduce(lambda a, b: a | b, [shown.contains(w) for w in wanted]) if wanted else F.lit(True)
