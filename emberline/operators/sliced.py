"""Ordered operators over groups of any size.

A window per session would put a session that holds a third of all rows into one task.  Here every
session is cut into slices (a span of time or of positions); windows run per (session, slice), and
what a slice needs to know about the rows before it arrives by one of two ways:

* ``carry``: one summary row per slice (a sum, a maximum, a last value), accumulated over the slices
  of a session and joined back.  A session has as many summary rows as slices, not as rows.
* ``with_halo``: the last rows of a slice are copied to the next one, for frames of fixed reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per slice, for orders without a time axis.
SLICE_ROWS = 1000


def carry(
    df: DataFrame, keys: list[str], slice_by: str, order: list[str], specs: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Add running columns over each key group in ``order``.

    ``order`` must be total within a key group, and ``slice_by`` must never fall along it.  Kinds:
    ``sum`` and ``max`` up to the current row; ``last``: latest non-null value up to the current row;
    ``before``: latest non-null value strictly before it; ``prev``: value of the previous row.
    """
    inputs = {out: f"_in_{out}" for out in specs}
    df = df.select("*", *[column.alias(inputs[out]) for out, (_, column) in specs.items()])
    inside = Window.partitionBy(*keys, slice_by).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    slices = Window.partitionBy(*keys).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    totals, carried, local = [], [], []
    for out, (kind, _) in specs.items():
        value = F.col(inputs[out])
        total = F.col(f"_total_{out}")
        if kind == "sum":
            totals.append(F.sum(value).alias(f"_total_{out}"))
            carried.append(F.sum(total).over(slices).alias(f"_carry_{out}"))
            local.append(F.sum(value).over(so_far).alias(f"_local_{out}"))
        elif kind == "max":
            totals.append(F.max(value).alias(f"_total_{out}"))
            carried.append(F.max(total).over(slices).alias(f"_carry_{out}"))
            local.append(F.max(value).over(so_far).alias(f"_local_{out}"))
        elif kind in ("last", "before"):
            totals.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(f"_total_{out}"))
            carried.append(F.last(total, ignorenulls=True).over(slices).alias(f"_carry_{out}"))
            local.append(F.last(value, ignorenulls=True).over(so_far if kind == "last" else earlier).alias(f"_local_{out}"))
        elif kind == "prev":
            totals.append(F.max_by(F.struct(value.alias("v")), at).alias(f"_total_{out}"))
            carried.append(F.last(total).over(slices).alias(f"_carry_{out}"))
            local.append(F.lag(F.struct(value.alias("v"))).over(inside).alias(f"_local_{out}"))
        else:
            raise ValueError(kind)
    summary = df.groupBy(*keys, slice_by).agg(*totals)
    summary = summary.select(*keys, slice_by, *carried)
    rows = df.select("*", *local).join(summary, [*keys, slice_by])
    results = []
    for out, (kind, _) in specs.items():
        here, came = F.col(f"_local_{out}"), F.col(f"_carry_{out}")
        if kind == "sum":
            value = F.when(here.isNotNull() | came.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(came, F.lit(0)))
        elif kind == "max":
            value = F.greatest(here, came)
        elif kind == "prev":
            value = F.coalesce(here, came)["v"]
        else:
            value = F.coalesce(here, came)
        results.append(value.alias(out))
    kept = [c for c in df.columns if c not in inputs.values()]
    return rows.select(*kept, *results)


def positions(df: DataFrame, keys: list[str], slice_by: str, order: list[str], out: str = "pos") -> DataFrame:
    """Row number from 0 within each key group."""
    numbered = carry(df, keys, slice_by, order, {out: ("sum", F.lit(1))})
    return numbered.withColumn(out, F.col(out) - 1)


def with_halo(df: DataFrame, along: str, width: int, reach: int) -> DataFrame:
    """Add ``slice`` and ``home``; a row also appears in every later slice that ``reach`` touches.

    ``along`` is a whole number: a gap-free position, or a time for frames that reach back by time.
    """
    here = F.expr(f"{along} div {width}")
    copies = F.sequence(here, F.expr(f"({along} + {reach}) div {width}"))
    return df.withColumn("slice", F.explode(copies)).withColumn("home", F.col("slice") == here)


def ordered_concat(df: DataFrame, keys: list[str], slice_by: str, order: list[str], text: str, out: str, separator: str = "") -> DataFrame:
    """The texts of each group joined in order.

    Slices are joined first, where their rows are; only the slice texts meet, because the result of
    a group is one string by definition.
    """

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["_text"]), separator)

    parts = df.groupBy(*keys, slice_by).agg(joined(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_part"))
    return parts.groupBy(*keys).agg(
        joined(F.collect_list(F.struct(slice_by, F.col("_part").alias("_text")))).alias(out)
    )
