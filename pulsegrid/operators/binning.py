"""From times and frames to bars and ticks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import clean_unit, flag_sum, round_half_even, unit

# Loudness floor, sustained range and silence limits.
FLOOR_DBFS = -120.0
LOUDNESS_EPSILON = 1e-6
SUSTAINED_RANGE_DB = 20.0
SILENT_ENERGY = 0.015
QUIET_ENERGY = 0.03
QUIET_ACTIVITY = 0.05
NOISE_RMS_DBFS = -50.0
NOISE_RELATIVE_DB = -40.0
NOISE_PEAK_DBFS = -40.0
NOISE_SUSTAINED = 0.15
SPARSE_MINIMUM = 0.05


def bar_grid(
    events: DataFrame,
    keys: Sequence[str],
    time: Column,
    value: Column,
    *,
    start: int | float,
    tick: int | float,
    ticks: int,
    end: Column | None = None,
) -> DataFrame:
    """Round times to ticks and keep the largest value per (bar, tick).

    Times before the start, or after the track's ``end`` if there is one, are dropped. The maximum is combined
    before the shuffle, so a hot track costs one row per occupied tick.
    """
    inside = (time >= start) if end is None else (time >= start) & (time <= end)
    placed = events.filter(inside).select(*keys, time.alias("_t"), value.alias("_v"))
    absolute = F.rint((F.col("_t") - F.lit(start)) / F.lit(float(tick))).cast("long")
    gridded = placed.select(
        *keys,
        F.floor(absolute / ticks).cast("int").alias("bar"),
        F.pmod(absolute, F.lit(ticks)).cast("int").alias("tick"),
        "_v",
    )
    return gridded.groupBy(*keys, "bar", "tick").agg(F.max("_v").alias("value"), F.count(F.lit(1)).alias("event_count"))


def expand_frames(arrays: DataFrame, keys: Sequence[str], channels: Sequence[str], hop_seconds: Column) -> DataFrame:
    """Parallel arrays to one row per frame; short arrays are padded with 0, values cleaned."""
    zipped = F.arrays_zip(*[F.col(c) for c in channels])
    rows = arrays.select(*keys, hop_seconds.alias("_hop"), F.posexplode(zipped).alias("frame", "_z"))
    return rows.select(
        *keys,
        "frame",
        (F.col("frame") * F.col("_hop")).alias("time_s"),
        *[clean_unit(F.col(f"_z.{c}").cast("double")).alias(c) for c in channels],
    )


def bar_summary(points: DataFrame, keys: Sequence[str], peaks: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Per bar: maxima of attack channels, means of the others, ticks that are not sparse."""
    strongest = F.greatest(*[F.col(c) for c in peaks])
    return points.groupBy(*keys, "bar").agg(
        *[round_half_even(F.max(c), 3).alias(c) for c in peaks],
        *[round_half_even(F.avg(c), 3).alias(c) for c in means],
        flag_sum(strongest >= SPARSE_MINIMUM).alias("grid_count"),
    )


def dbfs(value: Column) -> Column:
    return 20.0 * F.log10(F.greatest(value, F.lit(LOUDNESS_EPSILON)))


def bar_loudness(frames: DataFrame, keys: Sequence[str], time: Column, rms: Column, start: float, bar_length: float) -> DataFrame:
    """RMS, peak and relative level per bar and the share of frames near the bar's peak.

    The bar is the floor of the elapsed bars, unlike the rounded tick of ``bar_grid``.
    """
    keys = list(keys)
    valid = frames.select(*keys, time.alias("_t"), rms.alias("_x")).filter(
        (F.col("_x") >= 0) & ~F.isnan("_x") & (F.col("_x") < float("inf"))
    )
    top = valid.groupBy(*keys).agg(F.max("_x").alias("_top"))
    placed = valid.filter(F.col("_t") >= start).withColumn("bar", F.floor((F.col("_t") - start) / bar_length).cast("int"))
    sums = placed.groupBy(*keys, "bar").agg(F.avg(F.col("_x") * F.col("_x")).alias("_power"), F.max("_x").alias("_peak"))
    limit = F.col("_peak") * (10 ** (-SUSTAINED_RANGE_DB / 20.0))
    near = placed.join(sums, [*keys, "bar"]).groupBy(*keys, "bar", "_power", "_peak").agg(
        F.avg((F.col("_x") >= limit).cast("double")).alias("_near")
    )
    level = dbfs(F.sqrt("_power"))
    return near.join(top, keys).select(
        *keys,
        "bar",
        round_half_even(level, 3).alias("rms_dbfs"),
        round_half_even(dbfs(F.col("_peak")), 3).alias("peak_rms_dbfs"),
        round_half_even(level - dbfs(F.col("_top")), 3).alias("relative_rms_db"),
        round_half_even(F.when(F.col("_peak") <= LOUDNESS_EPSILON, 0.0).otherwise(F.col("_near")), 3).alias("sustained_ratio"),
    )


def bar_energy(points: DataFrame, keys: Sequence[str], slots: int, ticks: int, beat: int) -> DataFrame:
    """Energy and accents per bar from sparse points (tick, onset, strength, activity).

    Accents are the onsets on beats; without any, all strongest onsets.
    """
    onset = F.col("onset")
    strength = F.when(onset, F.col("strength"))
    on_beat = F.when(onset & (F.col("tick") % beat == 0), F.col("tick"))
    best = F.max(strength)
    sums = points.groupBy(*keys, "bar").agg(
        F.sum(F.coalesce(strength, F.lit(0.0))).alias("_strength"),
        F.sum("activity").alias("_activity"),
        flag_sum(onset).alias("onset_count"),
        F.array_sort(F.collect_list(on_beat)).alias("_beats"),
        F.array_sort(F.collect_list(F.when(onset, F.struct("tick", "strength")))).alias("_onsets"),
        best.alias("_best"),
    )
    top = F.transform(F.filter("_onsets", lambda x: x["strength"] == F.col("_best")), lambda x: x["tick"])
    accents = F.when(F.size("_beats") > 0, F.col("_beats")).otherwise(top)
    energy = F.greatest(
        F.least(F.lit(1.0), F.col("_strength") / slots), F.least(F.lit(1.0), F.col("_activity") / ticks)
    )
    return sums.select(*keys, "bar", round_half_even(energy, 3).alias("energy"), "onset_count", accents.alias("accents"))


def silent_bar(onsets: Column, energy: Column, mean_activity: Column) -> Column:
    quiet = (energy <= QUIET_ENERGY) & (mean_activity <= QUIET_ACTIVITY)
    return (onsets == 0) & ((energy <= SILENT_ENERGY) | quiet)


def edge_noise(onsets: Column, slots: int, rms: Column, relative: Column, peak: Column, sustained: Column) -> Column:
    """Very quiet bar with few onsets; false when a level is missing."""
    low = (
        (rms <= NOISE_RMS_DBFS)
        & (relative <= NOISE_RELATIVE_DB)
        & (peak <= NOISE_PEAK_DBFS)
        & (sustained <= NOISE_SUSTAINED)
        & (onsets <= max(1, slots // 4))
    )
    return F.coalesce(low, F.lit(False))


def bar_range(bars: DataFrame, keys: Sequence[str], first: int, last: int, bar: str = "bar") -> DataFrame:
    """The bars from ``first`` to ``last``; a track that has none of them gets a row that says so."""
    if first > last:
        raise ValueError("the first bar lies behind the last one")
    inside = F.col(bar).between(first, last)
    values = [n for n in bars.columns if n not in keys]
    empty = bars.groupBy(*keys).agg(F.bool_or(inside).alias("_any")).filter(~F.col("_any"))
    refused = empty.select(
        *keys, *[F.lit(None).cast(bars.schema[n].dataType).alias(n) for n in values], F.lit("empty-bar-range").alias("issue")
    )
    return bars.filter(inside).withColumn("issue", F.lit(None).cast("string")).unionByName(refused)


def edge_runs(bars: DataFrame, keys: Sequence[str], condition: Column, bar: str = "bar") -> DataFrame:
    """Flag the bars of the leading and trailing runs where the condition holds.

    The leading run needs bar 0, the trailing one the last bar. Only the first and last
    bar that break the condition matter, so no window is needed.
    """
    marked = bars.withColumn("_hold", condition)
    breaks = marked.groupBy(*keys).agg(
        F.min(F.when(~F.col("_hold"), F.col(bar))).alias("_first"),
        F.max(F.when(~F.col("_hold"), F.col(bar))).alias("_last"),
        F.min(bar).alias("_begin"),
    )
    joined = marked.join(breaks, list(keys))
    leading = (F.col("_begin") == 0) & (F.col("_first").isNull() | (F.col(bar) < F.col("_first")))
    trailing = F.col("_last").isNull() | (F.col(bar) > F.col("_last"))
    return joined.withColumn("edge", leading | trailing).drop("_hold", "_first", "_last", "_begin")


def dominant_source(bars: DataFrame, keys: Sequence[str], sources: dict[str, str]) -> DataFrame:
    """Strongest source when loud enough and clearly ahead of the second one."""
    entries = F.array(*[F.struct((-F.col(c)).alias("neg"), F.lit(n).alias("name")) for n, c in sources.items()])
    ranked = F.array_sort(entries)
    top, second = -ranked[0]["neg"], -ranked[1]["neg"]
    gap = top - second
    clear = (top >= 0.12) & (gap >= 0.08)
    return bars.select(
        *keys,
        *sources.values(),
        F.when(clear, ranked[0]["name"]).alias("dominant_source"),
        F.when(clear, round_half_even(F.least(F.lit(1.0), top * 0.7 + gap * 0.6), 3)).otherwise(0.0).alias("source_confidence"),
    )


def profile12(ticks: DataFrame, keys: Sequence[str], value: str, size: int, how: str) -> DataFrame:
    """Resample the ticks of a bar to 12 bins by maximum or mean."""
    bins = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(round(i * size / 12)).alias("a"),
                F.lit(max(round(i * size / 12) + 1, round((i + 1) * size / 12))).alias("b"),
            )
            for i in range(12)
        ]
    )
    mine = F.filter(bins, lambda x: (F.col("tick") >= x["a"]) & (F.col("tick") < x["b"]))
    spread = ticks.select(*keys, value, F.inline(mine))
    agg = F.max(value) if how == "max" else F.sum(value) / (F.first("b") - F.first("a"))
    per_bin = spread.groupBy(*keys, "i").agg(round_half_even(agg, 6).alias("v"))
    empty = F.sequence(F.lit(0), F.lit(11))
    mapped = per_bin.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return mapped.select(*keys, F.transform(empty, lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("profile"))


def grid_coarsen(points: DataFrame, keys: Sequence[str], step: int, ticks: int, flags: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Ticks to a coarser step: flags are or-ed, values take the maximum."""
    target = F.least(F.lit(ticks - step), F.greatest(F.lit(0), (F.rint(F.col("tick") / step) * step).cast("int")))
    return points.withColumn("tick", target).groupBy(*keys, "tick").agg(
        *[F.bool_or(c).alias(c) for c in flags], *[F.max(c).alias(c) for c in values]
    )


def per_mille(value: Column) -> Column:
    return F.rint(unit(value) * 1000).cast("int")


def bar_window(keys: Sequence[str]) -> Window:
    """Window over the bars of a track; its size follows the length of the track."""
    return Window.partitionBy(*keys).orderBy("bar")
