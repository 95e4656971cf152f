"""Musical keys as columns. A key is a tonic (0 = C .. 11 = B) and a mode (0 = minor, 1 = major in ``is_major``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the tonics, and semitones of the note letters.
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
# Tonal profiles of major and minor pieces of electronic dance music, and the weight of minor scores.
MAJOR_PROFILE = [1.0, 0.2875, 0.5020, 0.4048, 0.6050, 0.5614, 0.3205, 0.7966, 0.3159, 0.4506, 0.4202, 0.3889]
MINOR_PROFILE = [1.0, 0.3096, 0.4415, 0.5827, 0.3262, 0.4948, 0.2889, 0.7804, 0.4328, 0.2903, 0.5331, 0.3217]
MINOR_WEIGHT = 1.2


def camelot_number(tonic: Column, is_major: Column) -> Column:
    """1 to 12 on the wheel; a minor key stands where its relative major does."""
    major = F.when(is_major, tonic).otherwise(tonic + 3)
    return (F.pmod(major * 7 + 7, F.lit(12)) + 1).cast("int")


def camelot(tonic: Column, is_major: Column) -> Column:
    return F.concat(camelot_number(tonic, is_major).cast("string"), F.when(is_major, "B").otherwise("A"))


def open_key(tonic: Column, is_major: Column) -> Column:
    n = F.pmod(camelot_number(tonic, is_major) + 4, F.lit(12)) + 1
    return F.concat(n.cast("int").cast("string"), F.when(is_major, "d").otherwise("m"))


def key_name(tonic: Column, is_major: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SHARPS])
    return F.concat(F.try_element_at(names, (tonic + 1).cast("int")), F.when(is_major, "").otherwise("m"))


def compatible(number_a: Column, major_a: Column, number_b: Column, major_b: Column) -> Column:
    """Same place on the wheel, or neighbours on one side of it."""
    step = F.pmod(number_a - number_b, F.lit(12))
    return (step == 0) | ((major_a == major_b) & step.isin(1, 11))


def wheel_order(number: Column, is_major: Column) -> Column:
    return (number * 2 + F.when(is_major, 1).otherwise(0)).cast("int")


def parse_key(text: Column) -> tuple[Column, Column]:
    """(tonic, is_major) of 'Am', 'F#', 'Bb', 'D min'; nulls if it is no key."""
    t = F.trim(text)
    letter = F.upper(F.regexp_extract(t, r"^([A-Ga-g])", 1))
    rest = F.regexp_extract(t, r"^[A-Ga-g]([#b]?)\s*(m|min|minor|maj|major)?$", 0)
    base = F.lit(None).cast("int")
    for k, v in LETTERS.items():
        base = F.when(letter == k, v).otherwise(base)
    accidental = F.regexp_extract(t, r"^[A-Ga-g]([#b]?)", 1)
    shift = F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)
    mode = F.regexp_extract(t, r"^[A-Ga-g][#b]?\s*(m|min|minor|maj|major)?$", 1)
    ok = rest != ""
    return F.when(ok, F.pmod(base + shift, F.lit(12))).cast("int"), F.when(ok, ~mode.isin("m", "min", "minor"))


def parse_camelot(text: Column) -> tuple[Column, Column]:
    """(number, is_major) of '8A' .. '12b'; nulls otherwise."""
    n = F.regexp_extract(text, r"^\s*(1[0-2]|[1-9])([ABab])\s*$", 1)
    side = F.upper(F.regexp_extract(text, r"^\s*(1[0-2]|[1-9])([ABab])\s*$", 2))
    return F.when(n != "", n).try_cast("int"), F.when(n != "", side == "B")
