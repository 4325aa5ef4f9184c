"""Column expressions over note strings (one character per slot)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Note classes of the chart text format.
NORMAL_NOTES = "1234"
ACTIVITY_NOTES = "123457"
SPECIAL_NOTES = "5679"
NOTE_STARTS = "1234579"
BALLOON_NOTES = "79"
SUPPORTED_NOTES = "01234578"
REST = "0"


def count_chars(notes: Column, chars: str) -> Column:
    """How many slots hold one of the characters."""
    return F.length(notes) - F.length(F.translate(notes, chars, ""))


def normal_count(notes: Column) -> Column:
    return count_chars(notes, NORMAL_NOTES)


def activity_count(notes: Column) -> Column:
    return count_chars(notes, ACTIVITY_NOTES)


def special_count(notes: Column) -> Column:
    return count_chars(notes, SPECIAL_NOTES)


def start_count(notes: Column) -> Column:
    return count_chars(notes, NOTE_STARTS)


def nonrest_count(notes: Column) -> Column:
    return F.length(notes) - count_chars(notes, REST)


def in_class(note: Column, chars: str) -> Column:
    return note.isin(*list(chars))


def slots(notes: Column) -> Column:
    """Array of slot characters; an empty string gives an empty array."""
    return F.filter(F.split(notes, ""), lambda c: c != "")


def project_slot(position: Column, length: Column, ticks: Column) -> Column:
    """Slot to tick (or tick to slot), half-even, clamped to the last one."""
    return F.least(ticks - 1, F.rint(position / length * ticks).cast("int"))


def reduced_fraction(position: Column, length: Column) -> Column:
    """position/length in lowest terms as text; whole numbers drop the denominator."""
    divisors = F.sequence(F.lit(1), length)
    gcd = F.when(position == 0, length).otherwise(
        F.array_max(F.filter(divisors, lambda k: (position % k == 0) & (length % k == 0)))
    )
    den = (length / gcd).cast("int")
    num = (position / gcd).cast("int")
    return F.when(den == 1, num.cast("string")).otherwise(F.concat_ws("/", num, den))


def pattern_key(notes: Column, chars: str | None = None, with_note: bool = True) -> Column:
    """Resolution-invariant pattern: reduced positions of the chosen notes joined by '|'."""
    length = F.length(notes)
    indexed = F.transform(slots(notes), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    keep = F.filter(indexed, lambda x: in_class(x["c"], chars) if chars else x["c"] != REST)
    parts = F.transform(
        keep,
        lambda x: F.concat_ws(":", reduced_fraction(x["i"], length), x["c"])
        if with_note
        else reduced_fraction(x["i"], length),
    )
    return F.array_join(parts, "|")
