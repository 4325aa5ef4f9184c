"""Runs, gaps, intervals and spaced picks over ordered events."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import flag_sum, ratio, round_half_even
from pulsegrid.operators.scan import gap_islands, ordered_scan, time_cell


def streams(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], gap_limit: int | float, cell_width: int | float
) -> DataFrame:
    """Sessions of events whose gaps stay within the limit: start, end, count."""
    time = order[0]
    islands = gap_islands(events, keys, order, time_cell(F.col(time), cell_width), gap_limit, "stream")
    return islands.groupBy(*keys, "stream").agg(
        F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count(F.lit(1)).alias("event_count")
    )


def longest_stream(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], gap_limit: int | float, cell_width: int | float
) -> DataFrame:
    """The longest session per key, by count and then by length."""
    found = streams(events, keys, order, gap_limit, cell_width)
    best = F.max(F.struct("event_count", (F.col("end_t") - F.col("start_t")).alias("length"))).alias("best")
    return found.groupBy(*keys).agg(best).select(
        *keys,
        F.col("best.event_count").alias("longest_stream_count"),
        F.col("best.length").alias("longest_stream_length"),
    )


def true_runs(
    rows: DataFrame, keys: Sequence[str], position: str, condition: Column, cell: Column | None = None
) -> DataFrame:
    """Maximal runs of consecutive positions where the condition holds: start, end, length.

    A missing position breaks a run, so the rows may be a selection of all positions.
    """
    hit = rows.filter(condition)
    scan_cell = time_cell(F.col(position), 4096) if cell is None else cell
    numbered = ordered_scan(hit, keys, [position], scan_cell, cumsum={"_n": F.lit(1)})
    grouped = numbered.withColumn("_run", F.col(position) - F.col("_n"))
    return grouped.groupBy(*keys, "_run").agg(
        F.min(position).alias("run_start"), F.max(position).alias("run_end"), F.count(F.lit(1)).alias("run_length")
    ).drop("_run")


def same_value_runs(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, value: Column
) -> DataFrame:
    """Runs of equal values in order; a null value ends a run and belongs to none."""
    valued = rows.withColumn("run_value", value)
    stepped = ordered_scan(valued, keys, order, cell, lag={"_prev": F.coalesce(F.col("run_value"), F.lit(""))})
    changed = F.col("run_value").isNull() | F.col("_prev").isNull() | (F.col("_prev") != F.col("run_value"))
    flagged = stepped.withColumn("_new", F.when(changed, 1).otherwise(0))
    numbered = ordered_scan(flagged, keys, order, cell, cumsum={"run_id": F.col("_new")})
    return (
        numbered.filter(F.col("run_value").isNotNull())
        .groupBy(*keys, "run_id", "run_value")
        .agg(F.count(F.lit(1)).alias("run_length"))
    )


def grouped_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[Column, float]],
    cell_width: int | float,
    index_rule: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles of several values per key in one pass, without gathering a group.

    ``wanted`` maps an output name to (value, q); null values are skipped. Values are
    counted first, ranked by a running count, and only the one or two values around each
    target rank are kept. Names in ``index_rule`` take the value at ``int(n*q)`` instead
    of interpolating.
    """
    keys = list(keys)
    entries = [
        F.struct(F.lit(name).alias("_name"), value.cast("double").alias("_value"))
        for name, (value, _q) in wanted.items()
    ]
    long_form = rows.select(*keys, F.inline(F.array(*entries))).filter(F.col("_value").isNotNull())
    counted = long_form.groupBy(*keys, "_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(
        counted, [*keys, "_name"], ["_value"], time_cell(F.col("_value"), cell_width), cumsum={"_upto": F.col("_n")}
    )
    totals = counted.groupBy(*keys, "_name").agg(F.sum("_n").alias("_total"))
    placed = ranked.join(totals, [*keys, "_name"])
    first, last, total = F.col("_upto") - F.col("_n"), F.col("_upto") - 1, F.col("_total")
    aggs = []
    for name, (_value, q) in wanted.items():
        if name in index_rule:
            low = F.least(total - 1, F.floor(total * F.lit(q)))
            high, part = low, F.lit(0.0)
        else:
            spot = (total - 1) * F.lit(q)
            low = F.floor(spot)
            high, part = F.least(total - 1, low + 1), spot - low
        mine = F.col("_name") == name
        lower = F.max(F.when(mine & (first <= low) & (low <= last), F.col("_value")))
        upper = F.max(F.when(mine & (first <= high) & (high <= last), F.col("_value")))
        fraction = F.max(F.when(mine, part))
        aggs.append((lower * (1.0 - fraction) + upper * fraction).alias(name))
    return placed.groupBy(*keys).agg(*aggs)


def intervals(
    events: DataFrame, keys: Sequence[str], time: str, cell_width: int | float
) -> DataFrame:
    """Positive gaps between consecutive distinct times: time, gap, index from 0."""
    times = events.select(*keys, time).distinct()
    gaps = ordered_scan(
        times,
        keys,
        [time],
        time_cell(F.col(time), cell_width),
        lag={"_prev": F.col(time)},
        cumsum={"_n": F.lit(1)},
    )
    return gaps.filter(F.col("_prev").isNotNull()).select(
        *keys, time, (F.col(time) - F.col("_prev")).alias("gap"), (F.col("_n") - 2).alias("gap_index")
    )


def interval_stats(
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    duration: int | float,
    cell_width: int | float,
    gap_cell: int | float,
) -> DataFrame:
    """Count, mean, variation, stability and coverage of the gaps between events."""
    gaps = intervals(events, keys, time, cell_width)
    median = grouped_quantiles(gaps, keys, {"median_gap": (F.col("gap"), 0.5)}, gap_cell)
    spread = gaps.join(median, list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("interval_count"),
        F.avg("gap").alias("mean_gap"),
        F.stddev_pop("gap").alias("_sd"),
        F.max("median_gap").alias("median_gap"),
        F.avg(F.abs(F.col("gap") - F.col("median_gap"))).alias("_mad"),
        F.sum("gap").alias("_span"),
    )
    stable = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_mad") / F.col("median_gap")))
    return spread.select(
        *keys,
        "interval_count",
        "mean_gap",
        (F.col("_sd") / F.col("mean_gap")).alias("variation"),
        F.when(F.col("interval_count") < 2, 0.0).otherwise(stable).alias("stability"),
        F.least(F.lit(1.0), F.col("_span") / F.lit(float(duration))).alias("coverage"),
    )


def period_fit(
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    interval: int | float,
    cell_width: int | float,
    outlier_deviation: float = 0.08,
) -> DataFrame:
    """How well a fixed interval explains the event times of each key."""
    keys = list(keys)
    times = events.select(*keys, time).distinct()
    origin = times.groupBy(*keys).agg(F.min(time).alias("_t0"), F.count(F.lit(1)).alias("_count"))
    cell = time_cell(F.col(time), cell_width)
    gaps = ordered_scan(
        times, keys, [time], cell, lag={"_prev": F.col(time)}, cumsum={"_n": F.lit(1)}
    ).withColumn("gap", F.col(time) - F.col("_prev"))
    gaps = ordered_scan(gaps, keys, [time], cell, lag={"_prev_gap": F.col("gap")})
    rows = gaps.filter(F.col("gap").isNotNull()).join(origin, keys)
    step = F.lit(float(interval))
    offset = F.col(time) - F.col("_t0")
    error = F.abs(offset - F.rint(offset / step) * step)
    size = F.greatest(F.lit(1), F.floor((F.col("_count") - 1) / 3))
    index = F.col("_n") - 2
    rows = rows.withColumn("_error", error).withColumn("_early", index < size).withColumn(
        "_late", index >= F.col("_count") - 1 - size
    )
    gap = F.col("gap")
    ranks = grouped_quantiles(
        rows,
        keys,
        {
            "p95_error": (F.col("_error"), 0.95),
            "_early_gap": (F.when(F.col("_early"), gap), 0.5),
            "_late_gap": (F.when(F.col("_late"), gap), 0.5),
        },
        interval / 16,
    )
    summary = rows.groupBy(*keys).agg(
        F.avg("_error").alias("mean_error"),
        F.max("_error").alias("max_error"),
        F.avg(F.when(F.abs(F.col("gap") - step) / step >= outlier_deviation, 1.0).otherwise(0.0)).alias(
            "outlier_ratio"
        ),
        F.coalesce(F.max(F.abs(F.col("gap") - F.col("_prev_gap")) / step), F.lit(0.0)).alias(
            "max_adjacent_change"
        ),
    )
    return (
        summary.join(ranks, keys).select(
            *keys,
            "mean_error",
            "p95_error",
            "max_error",
            (F.col("mean_error") / step).alias("error_ratio"),
            "outlier_ratio",
            ((F.col("_late_gap") - F.col("_early_gap")) / step).alias("drift_ratio"),
            "max_adjacent_change",
        )
    )


def spaced_picks(
    events: DataFrame, keys: Sequence[str], time: str, min_gap: int | float, cell_width: int | float
) -> DataFrame:
    """Keep the first event and then always the next one more than ``min_gap`` later.

    Which events are kept depends on the last one kept before. A cell of the time axis is a
    step function from the last time kept on entry to the last one kept on exit: its
    breakpoints are the few events that can be the first one kept in it, and the exit of each
    is found by doubling the links from event to next event inside the cell. One scan over a
    key's cells composes the functions; then every cell walks from its own entry. A key's
    scan has a row for each cell, so it follows the length of the timeline.
    """
    keys = list(keys)
    hops = 32
    times = events.select(*keys, time).distinct()
    width = max(cell_width, min_gap * hops)
    doublings = max(1, math.ceil(math.log2(width / min_gap + 2))) if min_gap > 0 else 40
    celled = times.select(*keys, F.col(time).alias("_t"), time_cell(F.col(time), width).alias("_cell"))
    names = ", ".join(f"`{k}`" for k in keys)
    upto = F.expr(f"count(1) OVER (PARTITION BY {names}, _cell ORDER BY _t RANGE BETWEEN UNBOUNDED PRECEDING AND {min_gap} FOLLOWING)")
    linked = celled.select(*keys, "_cell", "_t", upto.cast("int").alias("_upto"))
    cells = linked.groupBy(*keys, "_cell").agg(F.array_sort(F.collect_list(F.struct("_t", "_upto"))).alias("_rows"))
    # The link of an event is the place of the next one that may follow it, or none inside.
    cells = cells.select(*keys, "_cell", F.col("_rows._t").alias("_times"), F.col("_rows._upto").alias("_next"))
    size = F.size("_times")
    last = F.transform("_next", lambda n, i: F.when(n < size, n).otherwise(i))
    stepped = cells.withColumn("_last", last)
    for _ in range(doublings):
        stepped = stepped.withColumn("_last", F.transform("_last", lambda n: F.get(F.col("_last"), n)))
    # Only an event within the gap of the cell's start, or the one behind, can be the first kept.
    edge = F.col("_cell") * F.lit(width) + F.lit(min_gap)
    first = F.filter("_times", lambda t: t <= edge)
    entries = F.slice("_times", 1, F.size(first) + 1)
    exits = F.transform(entries, lambda t, i: F.struct(t.alias("entry"), F.get("_times", F.get("_last", i)).alias("exit")))
    steps = stepped.select(*keys, "_cell", exits.alias("_steps"))
    # Of neighbouring breakpoints with one exit the last one stands for all.
    ends = F.filter("_steps", lambda s, i: (i + 1 == F.size("_steps")) | (F.get("_steps.exit", i + 1) != s["exit"]))
    steps = steps.select(*keys, "_cell", ends.alias("_steps"))
    walked = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_cell", "_steps"))).alias("_cells"))
    kind = dict(times.dtypes)[time]

    def passed(before: Column, pieces: Column) -> Column:
        taken = F.get(F.filter(pieces, lambda s: before.isNull() | (s["entry"] - before > F.lit(min_gap))), F.lit(0))
        return F.coalesce(taken["exit"], before)

    def enter(state: Column, cell: Column) -> Column:
        entry = F.struct(cell["_cell"].alias("cell"), state["at"].alias("before"))
        return F.struct(passed(state["at"], cell["_steps"]).alias("at"), F.array_append(state["entries"], entry).alias("entries"))

    start = F.struct(F.lit(None).cast(kind).alias("at"), F.array().cast(f"array<struct<cell:bigint,before:{kind}>>").alias("entries"))
    entered = walked.select(*keys, F.inline(F.aggregate("_cells", start, enter)["entries"]))
    entered = entered.select(*keys, F.col("cell").alias("_cell"), "before")
    here = cells.join(entered, [*keys, "_cell"])
    skipped = F.when(F.col("before").isNull(), 0).otherwise(
        F.size(F.filter("_times", lambda t: t - F.col("before") <= F.lit(min_gap)))
    )
    # Links from the entry on; a walk has a step for each gap that fits into the cell at most.
    here = here.withColumn("_at", skipped)
    walk = F.aggregate(
        "_times",
        F.struct(F.col("_at").alias("at"), F.array().cast(f"array<{kind}>").alias("kept")),
        lambda state, _: F.when(state["at"] >= size, state).otherwise(
            F.struct(F.get("_next", state["at"]).alias("at"), F.array_append(state["kept"], F.get("_times", state["at"])).alias("kept"))
        ),
    )
    return here.select(*keys, F.explode(walk["kept"]).alias(time))


def cycle_stats(
    numbered: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, number: Column, size: int
) -> DataFrame:
    """Completeness of a repeating 1..size counter and the share of whole cycles."""
    keys = list(keys)
    rows = numbered.withColumn("_num", number)
    seen = ordered_scan(
        rows,
        keys,
        order,
        cell,
        lag={"_prev": F.col("_num")},
        cumsum={"_cycle": F.when(F.col("_num") == 1, 1).otherwise(0), "_pos": F.lit(1)},
        ffill={"_lead_t": F.when(F.col("_num") == 1, F.col(order[0]))},
    )
    valid = F.col("_num").between(1, size)
    follows = F.col("_prev").between(1, size) & (F.col("_num") == F.col("_prev") % size + 1)
    overall = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        flag_sum(valid).alias("_valid"),
        flag_sum(follows).alias("_follows"),
        F.max("_num").alias("_max"),
        F.max("_cycle").alias("_last"),
    )
    starts = seen.filter(F.col("_num") == 1).select(*keys, "_cycle", F.col("_pos").alias("_first"))
    cycles = (
        seen.filter(F.col("_cycle") > 0)
        .join(starts, [*keys, "_cycle"])
        .groupBy(*keys, "_cycle")
        .agg(
            F.count(F.lit(1)).alias("_len"),
            F.bool_and(F.col("_num") == F.col("_pos") - F.col("_first") + 1).alias("_in_order"),
        )
        .join(overall.select(*keys, "_last"), keys)
    )
    counted = cycles.filter((F.col("_cycle") < F.col("_last")) | (F.col("_len") == size))
    whole = counted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cycles"), flag_sum(F.col("_in_order") & (F.col("_len") == size)).alias("_whole")
    )
    meter = F.when(F.col("_max") == 3, "3/4").when(F.col("_max") == 6, "6/8").otherwise("4/4")
    complete = ratio(F.col("_valid"), F.col("_rows")) * ratio(F.col("_follows"), F.col("_rows") - 1)
    return overall.join(whole, keys, "left").select(
        *keys,
        F.when(F.col("_rows") < 2, 0.0).otherwise(complete).alias("number_completeness"),
        ratio(F.coalesce("_whole", F.lit(0)), F.coalesce("_cycles", F.lit(0))).alias("cycle_stability"),
        meter.alias("meter"),
    )


def local_peaks(
    frames: DataFrame, keys: Sequence[str], frame: str, value: str, threshold: float, cell: int = 4096
) -> DataFrame:
    """Frames at least as high as the one before and higher than the one after.

    A missing neighbour frame counts as 0.
    """
    near = ordered_scan(
        frames,
        keys,
        [frame],
        time_cell(F.col(frame), cell),
        lag={"_left": F.struct(frame, value)},
        lead={"_right": F.struct(frame, value)},
    )
    left = F.when(F.col(f"_left.{frame}") == F.col(frame) - 1, F.col(f"_left.{value}")).otherwise(0.0)
    right = F.when(F.col(f"_right.{frame}") == F.col(frame) + 1, F.col(f"_right.{value}")).otherwise(0.0)
    here = F.col(value)
    return near.filter((here >= threshold) & (here >= left) & (here > right)).select(*keys, frame, value)


def strongest_apart(
    peaks: DataFrame, keys: Sequence[str], frame: str, value: str, separation: int
) -> DataFrame:
    """Strongest first, keep peaks at least ``separation`` frames from every kept one.

    Equal strengths prefer the later frame; of rows of one frame the highest counts. Frames
    are cut into cells. What a cell keeps depends on its neighbours only through the one peak
    that each of them may keep within reach, so every cell becomes a transfer map: from what
    is kept beyond either border to what it keeps near them. Whether a peak is kept is settled
    by stronger peaks alone, so for any choice beyond the right border exactly one row of the
    map agrees with all cells before: a scan over a key's cells keeps these rows, and the way
    back picks the one that agrees with the cell behind. Jobs do not depend on the data.
    """
    keys = list(keys)
    if separation <= 1:
        return peaks.groupBy(*keys, frame).agg(F.max(value).alias(value))
    width = max(64, separation)
    reach = separation - 1
    rows = peaks.groupBy(*keys, F.col(frame).cast("long").alias("_f")).agg(F.max(value).alias("_v"))
    cell, place = F.floor(F.col("_f") / width).cast("long"), F.pmod(F.col("_f"), F.lit(width))
    peak = F.struct("_v", "_f")
    # A peak near a border is a guest of the cell beyond it.
    spots = F.array(
        F.struct(cell.alias("_cell"), F.lit(0).alias("_side")),
        F.when(place < reach, F.struct((cell - 1).alias("_cell"), F.lit(1).alias("_side"))),
        F.when(place >= width - reach, F.struct((cell + 1).alias("_cell"), F.lit(-1).alias("_side"))),
    )
    placed = rows.select(*keys, peak.alias("_peak"), F.inline(F.array_compact(spots)))
    sides = {"_left": -1, "_own": 0, "_right": 1}
    cells = placed.groupBy(*keys, "_cell").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("_side") == n, F.col("_peak"))), asc=False).alias(c) for c, n in sides.items()]
    )
    cells = cells.filter(F.size("_own") > 0)
    none = F.lit(None).cast(dict(placed.dtypes)["_peak"])

    def kept(left: Column, right: Column) -> Column:
        """The cell's peaks that stay, given the kept guest of either side."""

        def beaten(guest: Column, p: Column) -> Column:
            return F.coalesce((F.abs(guest["_f"] - p["_f"]) < separation) & (guest > p), F.lit(False))

        def keep(acc: Column, p: Column) -> Column:
            blocked = F.exists(acc, lambda k: F.abs(k["_f"] - p["_f"]) < separation) | beaten(left, p) | beaten(right, p)
            return F.when(blocked, acc).otherwise(F.array_append(acc, p))

        return F.aggregate("_own", F.array().cast(dict(cells.dtypes)["_own"]), keep)

    low, high = F.col("_cell") * width + reach, F.col("_cell") * width + width - reach

    def mapped(left: Column, right: Column) -> Column:
        def summary(own: Column) -> Column:
            near_left = F.get(F.filter(own, lambda p: p["_f"] < low), F.lit(0))["_f"]
            near_right = F.get(F.filter(own, lambda p: p["_f"] >= high), F.lit(0))["_f"]
            return F.struct(left["_f"].alias("left"), right["_f"].alias("right"), near_left.alias("to_left"), near_right.alias("to_right"))

        return F.get(F.transform(F.array(kept(left, right)), summary), F.lit(0))

    either = {c: F.concat(F.array(none), F.col(c)) for c in ("_left", "_right")}
    table = F.flatten(F.transform(either["_left"], lambda a: F.transform(either["_right"], lambda b: mapped(a, b))))
    maps = cells.select(*keys, "_cell", table.alias("_map"))
    walked = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_cell", "_map"))).alias("_cells"))
    row = "struct<left:bigint,right:bigint,to_left:bigint,to_right:bigint>"

    def answer(rows: Column, right: Column) -> Column:
        return F.get(F.filter(rows, lambda r: r["right"].eqNullSafe(right)), F.lit(0))

    def forward(state: Column, item: Column) -> Column:
        beside = state["cell"] == item["_cell"] - 1
        agreed = F.filter(
            item["_map"],
            lambda r: F.when(beside, r["left"].eqNullSafe(answer(state["rows"], r["to_left"])["to_right"])).otherwise(r["left"].isNull()),
        )
        step = F.struct(item["_cell"].alias("cell"), agreed.alias("rows"))
        return F.struct(item["_cell"].alias("cell"), agreed.alias("rows"), F.array_append(state["trail"], step).alias("trail"))

    start = F.struct(
        F.lit(None).cast("long").alias("cell"),
        F.array().cast(f"array<{row}>").alias("rows"),
        F.array().cast(f"array<struct<cell:bigint,rows:array<{row}>>>").alias("trail"),
    )
    trail = walked.select(*keys, F.aggregate("_cells", start, forward)["trail"].alias("_trail"))

    def backward(state: Column, item: Column) -> Column:
        right = F.when(state["cell"] == item["cell"] + 1, state["right"])
        found = answer(item["rows"], right)
        choice = F.struct(item["cell"].alias("cell"), found["left"].alias("left"), right.alias("right"))
        return F.struct(item["cell"].alias("cell"), found["to_left"].alias("right"), F.array_append(state["choices"], choice).alias("choices"))

    start = F.struct(
        F.lit(None).cast("long").alias("cell"),
        F.lit(None).cast("long").alias("right"),
        F.array().cast("array<struct<cell:bigint,left:bigint,right:bigint>>").alias("choices"),
    )
    chosen = trail.select(*keys, F.inline(F.aggregate(F.reverse("_trail"), start, backward)["choices"]))
    settled = cells.join(chosen.withColumnRenamed("cell", "_cell"), [*keys, "_cell"])

    def guest(peaks_there: str, side: str) -> Column:
        return F.get(F.filter(peaks_there, lambda p: p["_f"] == F.col(side)), F.lit(0))

    kind = dict(peaks.dtypes)[frame]
    out = settled.select(*keys, F.explode(kept(guest("_left", "left"), guest("_right", "right"))).alias("_peak"))
    return out.select(*keys, F.col("_peak._f").cast(kind).alias(frame), F.col("_peak._v").alias(value))


def energy_rank(rows: DataFrame, keys: Sequence[str], position: str, value: str, cell: int = 4096) -> DataFrame:
    """Mid-rank percentile of a value among its key's rows, and the step from the row before.

    Ranks come from counted values: below + half of the equal ones, over all.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    below = ordered_scan(
        counted, keys, [value], time_cell(F.col(value), 0.125), cumsum={"_upto": F.col("_n")}
    )
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    share = (F.col("_upto") - F.col("_n") + F.col("_n") / 2) / F.col("_total")
    ranks = below.join(totals, keys).select(*keys, value, share.alias("energy_percentile"))
    placed = rows.join(ranks, [*keys, value])
    stepped = ordered_scan(
        placed, keys, [position], time_cell(F.col(position), cell), lag={"_prev": F.col("energy_percentile")}
    )
    return stepped.withColumn(
        "energy_delta", F.coalesce(F.col("energy_percentile") - F.col("_prev"), F.lit(0.0))
    ).drop("_prev")


def rolling_best(rows: DataFrame, keys: Sequence[str], position: str, value: str, size: int) -> DataFrame:
    """Start of the window of ``size`` rows with the highest mean; the earliest wins.

    A window shorter than ``size`` only counts when the key has fewer rows. Means are
    compared at nine digits. Rows are one per bar, so the window follows the length of a
    track.
    """
    ordered = Window.partitionBy(*keys).orderBy(position)
    scored = rows.select(
        *keys,
        position,
        round_half_even(F.avg(value).over(ordered.rowsBetween(0, size - 1)), 9).alias("_mean"),
        F.row_number().over(ordered).alias("_rn"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_rows"),
    )
    full = (F.col("_rn") + size - 1 <= F.col("_rows")) | ((F.col("_rows") < size) & (F.col("_rn") == 1))
    best = F.max(F.struct(F.col("_mean"), (-F.col(position)).alias("_neg"))).alias("_best")
    return scored.filter(full).groupBy(*keys).agg(best).select(
        *keys, (-F.col("_best._neg")).alias("window_start"), F.col("_best._mean").alias("window_mean")
    )
