"""Ordered scans that do not sort a whole track on one task.

A plain window over ``track`` puts all rows of one track into one task.  Here the
rows are windowed per (track, cell), where a cell is a bounded stretch of the time
axis, and one summary row per cell carries the state over the cell borders.  The
window over summaries has one row per cell, so its size follows the length of the
timeline and not the number of rows of a hot track.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import plain_unions


def time_cell(value: Column, width: int | float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    *,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    cumsum: Mapping[str, Column] | None = None,
    ffill: Mapping[str, Column] | None = None,
    bfill: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add previous/next values, running sums and filled values in (keys, order).

    ``order`` must be unique inside the keys and non-decreasing in ``cell``.
    ``cumsum`` includes the row itself; ``ffill``/``bfill`` take the nearest non-null
    value at or before / at or after the row.
    """
    lag, lead, cumsum = dict(lag or {}), dict(lead or {}), dict(cumsum or {})
    ffill, bfill = dict(ffill or {}), dict(bfill or {})
    keys = list(keys)
    plain_unions(df.sparkSession)
    sources = {**lag, **lead, **cumsum, **ffill, **bfill}
    work = df.select("*", cell.alias("_cell"), *[e.alias(f"_v_{n}") for n, e in sources.items()])
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])

    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reverse = (
        Window.partitionBy(*keys, "_cell")
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    aggs = [F.max_by(f"_v_{n}", position).alias(f"_s_{n}") for n in lag]
    aggs += [F.min_by(f"_v_{n}", position).alias(f"_s_{n}") for n in lead]
    aggs += [F.sum(f"_v_{n}").alias(f"_s_{n}") for n in cumsum]
    for pick, names in ((F.max_by, ffill), (F.min_by, bfill)):
        for n in names:
            known = F.when(F.col(f"_v_{n}").isNotNull(), position)
            aggs.append(pick(F.col(f"_v_{n}"), known).alias(f"_s_{n}"))

    across = Window.partitionBy(*keys).orderBy("_cell")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*keys).orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = [F.lag(f"_s_{n}").over(across).alias(f"_c_{n}") for n in lag]
    carried += [F.lead(f"_s_{n}").over(across).alias(f"_c_{n}") for n in lead]
    carried += [F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in cumsum]
    carried += [F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in ffill]
    carried += [F.last(f"_s_{n}", ignorenulls=True).over(after).alias(f"_c_{n}") for n in bfill]
    carry = work.groupBy(*keys, "_cell").agg(*aggs).select(*keys, "_cell", *carried)

    local = [F.row_number().over(inside).alias("_rn")] if lag else []
    local += [F.lead(F.lit(1)).over(inside).alias("_more")] if lead else []
    local += [F.lag(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in lag]
    local += [F.lead(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in lead]
    local += [F.sum(f"_v_{n}").over(upto).alias(f"_l_{n}") for n in cumsum]
    local += [F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}") for n in ffill]
    local += [F.last(f"_v_{n}", ignorenulls=True).over(reverse).alias(f"_l_{n}") for n in bfill]
    joined = work.select(*df.columns, "_cell", *local).join(carry, [*keys, "_cell"], "left")

    out: list[Column] = []
    for n in lag:
        out.append(F.when(F.col("_rn") == 1, F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")).alias(n))
    for n in lead:
        out.append(F.when(F.col("_more").isNull(), F.col(f"_c_{n}")).otherwise(F.col(f"_l_{n}")).alias(n))
    for n in cumsum:
        out.append((F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n))
    for n in [*ffill, *bfill]:
        out.append(F.coalesce(f"_l_{n}", f"_c_{n}").alias(n))
    return joined.select(*df.columns, *out)


def gap_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cell: Column,
    gap_limit: int | float,
    island: str = "island",
) -> DataFrame:
    """Number the runs of rows whose consecutive gaps stay within the limit.

    The first ``order`` column is the time.
    """
    time = order[0]
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    gap = F.col(time) - F.lag(time).over(inside)
    celled = df.select("*", cell.alias("_cell"))
    opened = celled.select("*", F.when(gap > F.lit(gap_limit), 1).otherwise(0).alias("_opens"))
    local = F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    counted = opened.select(*df.columns, "_cell", local.alias("_inner"))
    # One row per cell settles whether a run crosses the border.
    cells = counted.groupBy(*keys, "_cell").agg(
        F.min(time).alias("_lo"), F.max(time).alias("_hi"), F.max("_inner").alias("_n")
    )
    across = Window.partitionBy(*keys).orderBy("_cell")
    border = F.col("_lo") - F.lag("_hi").over(across)
    bordered = cells.select(
        *keys, "_cell", "_n", F.when(border.isNull() | (border > F.lit(gap_limit)), 1).otherwise(0).alias("_b")
    )
    earlier = F.sum(F.col("_n") + F.col("_b")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    base = bordered.select(*keys, "_cell", (F.coalesce(earlier, F.lit(0)) + F.col("_b")).alias("_base"))
    return counted.join(base, [*keys, "_cell"]).select(*df.columns, (F.col("_base") + F.col("_inner")).alias(island))
