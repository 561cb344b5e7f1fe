"""Column functions on pitches, times and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def frequency(pitch: Column) -> Column:
    """Hertz of a MIDI pitch (A4 is 440)."""
    return 440.0 * F.pow(F.lit(2.0), (pitch - 69) / 12.0)


def note_name(pitch: Column) -> Column:
    """C4 for 60."""
    return F.concat(F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.pmod(pitch, F.lit(12)).cast("int") + 1), (F.floor(pitch / 12) - 1).cast("string"))


def clock(seconds: Column) -> Column:
    """mm:ss of whole seconds, none under 0."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int"))


def thousandths(seconds: Column) -> Column:
    """Three decimals, rounded from the exact binary value as C does (half to
    even); ``format_string`` rounds the shortest decimal text, so it makes 1.001
    of 1.0005, which lies a little below the half."""
    size = F.abs(seconds)
    whole = F.floor(size)
    part = size - whole
    # 26 leading bits and the rest: both times 1000 are exact
    head = F.floor(part * 67_108_864.0) / 67_108_864.0
    low = F.floor(head * 1000.0)
    over = (head * 1000.0 - low - 0.5) + (part - head) * 1000.0
    up = F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    n = whole * 1000 + low + up
    sign = F.when(F.startswith(seconds.cast("string"), F.lit("-")), "-").otherwise("")
    text = F.concat(sign, F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when(size < 1e12, text).otherwise(F.format_string("%.3f", seconds))


def character(human_score: Column) -> Column:
    """The label of a score: humanized from 70, mechanical to 45."""
    return F.when(human_score >= 70, "Humanized timing").when(human_score <= 45, "Mechanically stable").otherwise("Mixed timing evidence")


def pulse(age_s: Column) -> Column:
    """How strongly the last beat still shows."""
    return F.when(age_s >= 0, F.exp(-6.5 * age_s)).otherwise(0.0)


def cadence(functions: Column) -> Column:
    """Label of the last two functions of an array (blanks and sevenths left
    out), or ''."""
    plain = F.transform(F.filter(functions, lambda x: x != ""), lambda x: F.replace(x, F.lit("7"), F.lit("")))
    last, before = F.try_element_at(plain, F.lit(-1)), F.try_element_at(plain, F.lit(-2))
    home = last.isin("I", "i")
    return (
        F.when(home & (before == "V"), "AUTHENTIC CADENCE")
        .when(home & before.isin("IV", "iv"), "PLAGAL CADENCE")
        .when((last == "V") & before.isin("II", "ii", "ii°", "IV", "iv"), "PREDOMINANT TO DOMINANT")
        .otherwise("")
    )
