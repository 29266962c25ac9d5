"""Cheapest blend under limits, searched on a lattice of shares.

A scenario is one row with its components in an array.  Shares are whole steps of ``1 / steps``, placed
one component after the other; a partial blend goes on only while the steps left can still be placed and
every limit can still be kept by some choice of the remaining components (their least and greatest
values bound what can come).  No limit is ever dropped.  Two ways give the same result, and a scenario is
searched where its row is:

* groups of few lattice points have all of them computed, for many scenarios of one size at a time;
* groups of any size go level by level through the undominated partial blends of their scenario.  A partial
  blend is dominated by one with as many steps left that is not dearer and, at each limit that the
  other can still break, not nearer to it; sums of doubles keep that order whatever is added to both.
  A first run over the cheapest partial blends only gives a cost that no better blend exceeds.  Of a large
  group only components that can be part of the result are searched (see ``cheapest_shares``).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.blend import LIMITED_METRICS, stated_limits

EPSILON = 1e-9
SPREAD_COMPONENTS = 16  # up to which a group can have all its points computed
POINTS = 20_000  # lattice points up to which it has
POINTS_AT_ONCE = 100_000  # of several scenarios
FIRST = 32  # cheapest components that are searched first
CLOSE = 2e-6  # costs so close can be equal once they are rounded to six places
RIVALS = 256  # cheapest partial blends that the others are compared with
BEAM = 50  # cheapest partial blends per number of steps left in the first run


def limit_columns(limits: DataFrame) -> DataFrame:
    """One row per scenario with ``lo_<metric>`` and ``hi_<metric>``, infinite where nothing is stated."""
    stated = stated_limits(limits)
    columns = []
    for metric in LIMITED_METRICS:
        mine = F.col("metric") == metric
        columns.append(F.coalesce(F.max(F.when(mine, F.col("lo"))), F.lit(float("-inf"))).alias(f"lo_{metric}"))
        columns.append(F.coalesce(F.min(F.when(mine, F.col("hi"))), F.lit(float("inf"))).alias(f"hi_{metric}"))
    return stated.groupBy("scenario_id").agg(*columns)


def scenario_rows(candidates: DataFrame, properties: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per scenario: ``parts`` sorted by name, limit columns, and an error when it cannot be searched.

    ``candidates`` is (scenario_id, limit_set, component); the row holds the properties of the scenario's components.
    """
    asked = candidates.select("scenario_id", "limit_set", "component").distinct()
    joined = asked.join(properties.select("component", "price", *LIMITED_METRICS), "component", "left")
    # Small rows grow into many partial blends, so the tasks are set by number, not by input size: an
    # explicit count keeps adaptive execution from merging them.  The groups need no other shuffle.
    tasks = int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.struct("component", F.array("price", *LIMITED_METRICS).alias("v"))
    grouped = joined.repartition(tasks, "scenario_id").groupBy("scenario_id").agg(F.collect_list(F.struct("limit_set", part.alias("part"))).alias("_rows"))
    sets = grouped.select("scenario_id", "_rows", F.explode(F.array_distinct(F.transform("_rows", lambda r: r["limit_set"]))).alias("limit_set"))
    mine = F.filter("_rows", lambda r: r["limit_set"].eqNullSafe(F.col("limit_set")))
    unknown = F.exists(mine, lambda r: F.get(r["part"]["v"], F.lit(0)).isNull())
    parts = F.array_sort(F.transform("_rows", lambda r: r["part"]))
    sizes = sets.select("scenario_id", "limit_set", F.size(mine).cast("long").alias("n"), F.when(unknown, F.lit("unknown component")).alias("error"), parts.alias("parts"))
    rows = sizes.withColumn("parts", F.when(F.col("error").isNull() & F.col("scenario_id").isNotNull(), F.col("parts")))
    bounds = limit_columns(limits).withColumnRenamed("scenario_id", "limit_set")
    rows = rows.join(bounds, "limit_set", "left")
    for metric in LIMITED_METRICS:
        rows = rows.withColumn(f"lo_{metric}", F.coalesce(f"lo_{metric}", F.lit(float("-inf"))))
        rows = rows.withColumn(f"hi_{metric}", F.coalesce(f"hi_{metric}", F.lit(float("inf"))))
    return rows


def cheapest_on_lattice(scenarios: DataFrame, steps: int = 20, max_share_steps: int = 12, spread_components: int = SPREAD_COMPONENTS) -> DataFrame:
    """The cheapest feasible lattice point per scenario, or a row that says there is none.

    Of equal costs (to six places) the least shares in the order of names count.
    """
    names = F.transform("parts", lambda p: p["component"])
    rows = scenarios.select("scenario_id", "n", "error", names.alias("components"), F.flatten(F.transform("parts", lambda p: p["v"])).alias("values"), *_bounds())
    passed = ("scenario_id", "n", "error", "components")
    kinds = dict(rows.dtypes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, found in _search(batch, steps, max_share_steps, spread_components):
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in passed), found], [*passed, "found"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in passed) + ", found array<struct<cost: double, shares: array<int>>>"
    found = rows.mapInArrow(search, schema)
    rounded = F.transform("found", lambda f: F.struct(F.round(f["cost"], 6).alias("cost"), f["shares"].alias("shares")))
    return found.withColumn("best", F.array_min(rounded)).select(
        "scenario_id",
        "n",
        F.col("best.cost").alias("cost"),
        F.col("best.shares").alias("shares"),
        "components",
        F.coalesce("error", F.when(F.col("best.cost").isNull(), F.lit("no feasible blend"))).alias("error"),
        F.lit("lattice").alias("optimizer"),
    )


def _bounds() -> list[str]:
    return [f"{end}_{m}" for m in LIMITED_METRICS for end in ("lo", "hi")]


def _n_points(n: int, steps: int, most: int) -> int:
    """How many ways there are to place the steps on ``n`` components."""
    ways = [1] + [0] * steps
    for _ in range(n):
        ways = [sum(ways[left - s] for s in range(min(most, left) + 1)) for left in range(steps + 1)]
    return ways[steps]


@cache
def _points(n: int, steps: int, most: int) -> np.ndarray:
    """All ways to place the steps on ``n`` components, one per row, in the order of shares."""
    shares, left = np.zeros((1, 0), "i4"), np.array([steps])
    for level in range(n):
        parent, choice = np.divmod(np.arange(len(left) * (most + 1)), most + 1)
        fits = (choice <= left[parent]) & (left[parent] - choice <= (n - level - 1) * most)
        parent, choice = parent[fits], choice[fits].astype("i4")
        shares, left = np.column_stack([shares[parent], choice]), left[parent] - choice
    return shares[left == 0]


def _near_cheapest(values: np.ndarray, low: np.ndarray, high: np.ndarray, points: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scenarios of one size: place of the scenario, cost and place of the point, for all points that can be the cheapest."""
    sums = np.zeros((len(values), len(points), values.shape[2]))
    for level in range(points.shape[1]):
        sums += values[:, level, None, :] * (points[:, level] / float(steps))[None, :, None]
    price, have = sums[..., 0], sums[..., 1:]
    ok = ((have <= high[:, None, :] + EPSILON) & (have >= low[:, None, :] - EPSILON)).all(axis=2)
    known = np.where(ok & ~np.isnan(price), price, np.inf)
    scenario, point = np.nonzero(ok & (known <= known.min(axis=1, initial=np.inf)[:, None] + CLOSE))
    return scenario, price[scenario, point], point


def _found(n_rows: int, row: np.ndarray, cost: np.ndarray, shares: list[np.ndarray] | np.ndarray) -> pa.Array:
    """Costs and shares as a list per row; ``row`` is sorted."""
    ends = np.concatenate([[0], np.cumsum([len(s) for s in shares])]).astype("i4")
    flat = np.concatenate([*shares, []]).astype("i4") if len(shares) else np.zeros(0, "i4")
    entries = pa.StructArray.from_arrays([pa.array(cost, pa.float64()), pa.ListArray.from_arrays(ends, pa.array(flat))], ["cost", "shares"])
    return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n_rows + 1)).astype("i4"), entries)


def _search(batch: pa.RecordBatch, steps: int, most: int, spread_components: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows of a batch by number of components, with the points that can be their cheapest."""
    width = 1 + len(LIMITED_METRICS)
    values = batch.column("values")
    count = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False) // width
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("f8")
    starts = (np.cumsum(count) - count) * width
    ends = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _bounds()])
    for n in np.unique(count).tolist():
        rows = np.flatnonzero(count == n)
        dense = 0 < n <= spread_components and _n_points(n, steps, most) <= POINTS
        points = _points(n, steps, most) if dense else None
        at_once = max(1, POINTS_AT_ONCE // max(1, len(points))) if dense else 1
        for some in (rows[i : i + at_once] for i in range(0, len(rows), at_once)) if n else (rows,):
            low, high = ends[some, ::2], ends[some, 1::2]
            if dense:
                own = flat[starts[some][:, None] + np.arange(n * width)].reshape(len(some), n, width)
                row, cost, point = _near_cheapest(own, low, high, points, steps)
                shares = points[point]
            else:
                own = flat[starts[some[0]] :][: n * width].reshape(n, width) if n else None
                best = cheapest_shares(own, low[0], high[0], steps, most) if n else None
                row, cost, shares = (np.zeros(0, "i8"), [], []) if best is None else (np.zeros(1, "i8"), [best[0]], [best[1]])
            yield batch.take(pa.array(some)), _found(len(some), row, cost, shares)


def _undominated(sums: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Places of the partial blends that no other one stands for; rows are in the order of shares, price first.

    Each is compared with the ``RIVALS`` cheapest that stay and with its neighbours, so that work grows
    with the rows; what is dominated by others only stays, which changes no result.
    ``upper`` and ``lower`` are the sums where a limit can still be broken on that side, infinite where it cannot.
    """
    order = np.lexsort((np.arange(len(sums)), sums[:, 0]))
    kept, parts = np.zeros(0, "i8"), []
    for start in range(0, len(order), 64):
        some = order[start : start + 64]
        rivals = np.concatenate([kept, some])
        dearer = sums[some, 0][:, None] - sums[rivals, 0][None, :]
        beaten = (dearer > CLOSE) | (dearer >= 0) & (rivals[None, :] < some[:, None])
        for metric in range(upper.shape[1]):
            value = sums[some, metric + 1][:, None]
            beaten &= (upper[rivals, metric][None, :] <= value) & (lower[rivals, metric][None, :] >= value)
        parts.append(some[~beaten.any(axis=1)])
        if len(kept) < RIVALS:
            kept = np.concatenate([kept, parts[-1]])
    return np.sort(np.concatenate(parts)) if parts else kept


def _follow_levels(values: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, most: int, ceiling: float, beam: int | None) -> tuple[float, np.ndarray] | None:
    """Cost and shares of the cheapest blend not above the ceiling; with ``beam`` only of some of them."""
    n = len(values)
    shares, left, sums = np.zeros((1, 0), "i8"), np.array([steps]), np.zeros((1, values.shape[1]))
    watched = np.flatnonzero(np.isfinite(low) | np.isfinite(high)) + 1
    for level in range(n):
        if not len(left):
            return None
        parent, choice = np.divmod(np.arange(len(left) * (most + 1)), most + 1)
        fits = (choice <= left[parent]) & (left[parent] - choice <= (n - level - 1) * most)
        parent, choice = parent[fits], choice[fits]
        shares, left = np.column_stack([shares[parent], choice]), left[parent] - choice
        sums = sums[parent] + values[level] * (choice / float(steps))[:, None]
        tail, part = values[level + 1 :], (left / float(steps))[:, None]
        least, greatest = (tail.min(axis=0), tail.max(axis=0)) if len(tail) else (np.zeros(values.shape[1]),) * 2
        down, up = sums + part * least, sums + part * greatest
        ok = (down[:, watched] <= high[watched - 1] + EPSILON).all(axis=1) & (up[:, watched] >= low[watched - 1] - EPSILON).all(axis=1) & (down[:, 0] <= ceiling + CLOSE)
        shares, left, sums, down, up = (x[ok] for x in (shares, left, sums, down, up))
        upper = np.where(up[:, watched] <= high[watched - 1], -np.inf, sums[:, watched])
        lower = np.where(down[:, watched] >= low[watched - 1], np.inf, sums[:, watched])
        own = np.column_stack([sums[:, :1], sums[:, watched]])
        keep = []
        for rest in np.unique(left):
            at = np.flatnonzero(left == rest)
            at = at[_undominated(own[at], upper[at], lower[at])]
            keep.append(np.sort(at[np.argsort(down[at, 0], kind="stable")[:beam]]))
        at = np.sort(np.concatenate(keep)) if keep else np.zeros(0, "i8")
        shares, left, sums = shares[at], left[at], sums[at]
    if not len(left):
        return None
    near = np.flatnonzero(sums[:, 0] <= sums[:, 0].min() + CLOSE)
    rounded = [Decimal(repr(float(sums[i, 0]))).quantize(Decimal("0.000001"), ROUND_HALF_UP) for i in near]
    best = near[rounded.index(min(rounded))]
    return float(sums[best, 0]), shares[best]


def _useful(values: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, most: int) -> np.ndarray:
    """Places of the components that can be part of the cheapest blend; rows are in the order of names, price first.

    A component is left out for as many others as can take all steps, each of them cheaper, or as cheap and
    later in the order of names, and at each limit that any component breaks not nearer to it: its steps
    can move to them, which makes a cheaper blend, or one that comes first among equals.
    """
    others = -(-steps // most)
    upper = values[:, 1:][:, (values[:, 1:] > high).any(axis=0)]
    lower = values[:, 1:][:, (values[:, 1:] < low).any(axis=0)]
    watched = np.column_stack([upper, -lower])
    order = np.lexsort((-np.arange(len(values)), values[:, 0]))
    kept = np.zeros(0, "i8")
    for start in range(0, len(order), 64):
        some = order[start : start + 64]
        rivals = np.concatenate([kept, some])
        dearer = values[some, 0][:, None] - values[rivals, 0][None, :]
        beaten = (dearer > 2 * CLOSE * steps) | (dearer == 0) & (rivals[None, :] > some[:, None])
        for at in range(watched.shape[1]):
            beaten &= watched[rivals, at][None, :] <= watched[some, at][:, None]
        kept = np.concatenate([kept, some[beaten.sum(axis=1) < others]])
    return np.sort(kept)


def cheapest_shares(values: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, most: int) -> tuple[float, np.ndarray] | None:
    """Cost and shares of the cheapest blend of components (rows; price and metrics) within the limits, or None.

    The cheapest components are searched first.  A blend with one step of a dearer one costs at least that
    step and the cheapest price for the rest; what costs more than the blend found is not searched.
    """
    if np.isnan(values).any():
        return None
    if not np.isfinite(values).all():
        return _search_levels(values, low, high, steps, most)
    price = values[:, 0]
    order, size = np.argsort(price, kind="stable"), min(FIRST, len(values))
    while True:
        some = np.sort(order[:size])
        some = some[_useful(values[some], low, high, steps, most)]
        found = _search_levels(values[some], low, high, steps, most)
        if found is not None:
            least = price / steps + price[order[0]] * ((steps - 1) / steps)
            needed = int((least <= found[0] + CLOSE + abs(found[0]) * EPSILON).sum())
            if needed <= size:
                shares = np.zeros(len(values), "i8")
                shares[some] = found[1]
                return found[0], shares
            size = needed
        elif size == len(values):
            return None
        else:
            size = min(size * 4, len(values))


def _search_levels(values: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, most: int) -> tuple[float, np.ndarray] | None:
    some = _follow_levels(values, low, high, steps, most, np.inf, BEAM)
    return _follow_levels(values, low, high, steps, most, np.inf if some is None else some[0], None)
