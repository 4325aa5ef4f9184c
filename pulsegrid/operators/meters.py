"""Meters as data: bars of different lengths in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quarters of a bar and where its beats fall, in quarters, by time signature.
METERS = {"4/4": (4.0, (0.0, 1.0, 2.0, 3.0)), "3/4": (3.0, (0.0, 1.0, 2.0)), "6/8": (3.0, (0.0, 1.5))}
TICKS_PER_QUARTER = 12


def _by_meter(meter: Column, values: dict[str, Column]) -> Column:
    """The value of the row's meter; null for a meter that is not known."""
    found = F.lit(None)
    for name, value in values.items():
        found = F.when(meter == name, value).otherwise(found)
    return found


def ticks_per_bar(meter: Column, per_quarter: int = TICKS_PER_QUARTER) -> Column:
    return _by_meter(meter, {m: F.lit(round(quarters * per_quarter)) for m, (quarters, _) in METERS.items()})


def beat_ticks(meter: Column, resolution: Column) -> Column:
    """The ticks of the beats in a bar of ``resolution`` ticks."""
    def at(quarters: float, beats: tuple[float, ...]) -> Column:
        return F.array(*[F.rint(F.lit(b / quarters) * resolution).cast("int") for b in beats])

    return _by_meter(meter, {m: at(*spec) for m, spec in METERS.items()})


def meter_grid(
    events: DataFrame, keys: Sequence[str], meter: str, time: Column, value: Column, *, start: int | float, quarter: int | float
) -> DataFrame:
    """Times rounded to the ticks of each row's own meter: the largest value and the number of
    events per (bar, tick), and whether a beat falls there.

    Times before the start are dropped. A key with a meter that is not known gives one row
    with an issue instead of bars. The maximum is combined before the shuffle.
    """
    ticks = ticks_per_bar(F.col(meter))
    absolute = F.rint((time - F.lit(start)) / F.lit(quarter / TICKS_PER_QUARTER)).cast("long")
    placed = events.filter(ticks.isNull() | (time >= start)).select(
        *keys,
        meter,
        F.floor(absolute / ticks).cast("int").alias("bar"),
        F.pmod(absolute, ticks).cast("int").alias("tick"),
        F.coalesce(F.array_contains(beat_ticks(F.col(meter), ticks), F.pmod(absolute, ticks).cast("int")), F.lit(False)).alias("is_beat"),
        F.when(ticks.isNull(), F.lit("unknown-meter")).alias("issue"),
        F.when(ticks.isNotNull(), value).alias("_v"),
    )
    return placed.groupBy(*keys, meter, "bar", "tick", "is_beat", "issue").agg(
        F.max("_v").alias("value"), F.count(F.lit(1)).alias("event_count")
    )
