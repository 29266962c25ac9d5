"""Mixing, allocation and the lattice on small fixtures."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from emberline.operators import blend as bl
from emberline.operators import lattice
from emberline.operators.lattice import cheapest_on_lattice, scenario_rows
from emberline.plans.blend_tools import list_components, optimize_blends


def test_unknown_component_counts_in_the_divisor(spark):
    asked = spark.createDataFrame([(1, "a", 50.0), (1, "ghost", 50.0)], "blend_id int, component string, pct double")
    known = spark.createDataFrame([("a", *[10.0] * 7)], "component string, " + ", ".join(f"{c} double" for c in bl.FEATURES))
    row = bl.mix(asked, known).first()
    assert [row[c] for c in bl.FEATURES] == [5.0] * 7


def allocation(spark, prices):
    rows = [(1, f"c{i:02d}", float(p)) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "blend_id int, component string, price double")
    return bl.allocate(df.select("blend_id", "component"), df.select("component", "price")).orderBy("component").collect()


def test_allocation_bounds(spark):
    assert allocation(spark, [1]) == [] and allocation(spark, range(21)) == []
    shares = [r["share"] for r in allocation(spark, [3, 1, 2])]
    assert [round(s, 9) for s in shares] == [0.05, 0.6, 0.35]
    assert abs(sum(r["share"] for r in allocation(spark, range(20))) - 1) < 1e-9


def brute_force(parts, limits, steps, most):
    best = None
    for shares in itertools.product(range(most + 1), repeat=len(parts)):
        if sum(shares) != steps:
            continue
        sums = {m: sum(p[m] * s / steps for p, s in zip(parts, shares)) for m in ("price", *bl.LIMITED_METRICS)}
        if all(lo - 1e-9 <= sums[m] <= hi + 1e-9 for m, lo, hi in limits):
            key = (round(sums["price"], 6), shares)
            best = key if best is None or key < best else best
    return best


def test_lattice_equals_brute_force(spark):
    rng = random.Random(3)
    names = ("price", *bl.LIMITED_METRICS)
    parts = {f"p{i}": {m: round(rng.uniform(10, 90), 1) for m in names} for i in range(6)}
    properties = spark.createDataFrame(
        [(n, *[p[m] for m in names]) for n, p in parts.items()], "component string, " + ", ".join(f"{m} double" for m in names)
    )
    limits = {"a": [("cri", 20.0, 50.0), ("g", 40.0, None)], "b": [("csr", None, 1.0)], "c": []}
    rows = [(s, m, lo, hi) for s, given in limits.items() for m, lo, hi in given]
    limit_rows = spark.createDataFrame(rows, "scenario_id string, metric string, lo double, hi double")
    picks = {i: sorted(rng.sample(sorted(parts), rng.randint(2, 5))) for i in range(12)}
    wanted = [(i, "abc"[i % 3], n) for i, chosen in picks.items() for n in chosen] + [(99, "c", "ghost"), (98, "c", "p0")]
    wanted += [(97, "c", n) for n in parts]
    candidates = spark.createDataFrame(wanted, "scenario_id int, limit_set string, component string")
    got = {r["scenario_id"]: r for r in cheapest_on_lattice(scenario_rows(candidates, properties, limit_rows), 10, 6, 5).collect()}
    for i, chosen in picks.items():
        given = [(m, 0.0 if lo is None else lo, (100.0 if m in bl.QUALITY_METRICS else 1e300) if hi is None else hi) for m, lo, hi in limits["abc"[i % 3]]]
        want = brute_force([parts[n] for n in chosen], given, 10, 6)
        if want is None:
            assert got[i]["error"] == "no feasible blend"
        else:
            assert (got[i]["cost"], tuple(got[i]["shares"])) == want
    assert got[99]["error"] == "unknown component" and got[98]["error"] == "no feasible blend"
    assert (got[97]["cost"], tuple(got[97]["shares"])) == brute_force([parts[n] for n in parts], [], 10, 6)  # beyond what is spread
    plan = {r["scenario_id"]: r for r in optimize_blends(candidates, properties, limit_rows, 10, 6).collect()}
    assert abs(sum(h["ratio"] for h in plan[2]["hoppers"]) - 100) < 1e-6


def test_levels_equal_brute_force():
    rng = random.Random(4)
    names = ("price", *bl.LIMITED_METRICS)
    for case in range(150):
        n, steps, most = rng.randint(1, 5), rng.choice([4, 7]), rng.choice([2, 3, 4])
        grid = rng.choice([None, 3])  # few values make many equal costs
        parts = [{m: float(rng.randint(1, grid) * 10) if grid else round(rng.uniform(10, 90), 1) for m in names} for _ in range(n)]
        limits = [(m, *rng.choice([(20.0, 50.0), (-float("inf"), 45.0), (40.0, float("inf"))])) for m in rng.sample(bl.LIMITED_METRICS, rng.randint(0, 3))]
        given = {m: (lo, hi) for m, lo, hi in limits}
        values = np.array([[p[m] for m in names] for p in parts])
        ends = np.array([given.get(m, (-np.inf, np.inf)) for m in bl.LIMITED_METRICS])
        got = lattice.cheapest_shares(values, ends[:, 0], ends[:, 1], steps, most)
        want = brute_force(parts, limits, steps, most)
        assert (got and (round(got[0], 6), tuple(got[1].tolist()))) == want, case


def test_groups_of_twenty_parts_are_searched():
    rng = random.Random(6)
    values = np.array([[rng.uniform(10, 90) for _ in range(1 + len(bl.LIMITED_METRICS))] for _ in range(20)])
    low, high = np.full(len(bl.LIMITED_METRICS), -np.inf), np.full(len(bl.LIMITED_METRICS), np.inf)
    low[0], high[0], high[1], low[2] = 40, 45, 40, 60
    cost, shares = lattice.cheapest_shares(values, low, high, 20, 12)
    sums = (values * shares[:, None] / 20).sum(axis=0)
    assert shares.sum() == 20 and shares.max() <= 12 and abs(sums[0] - cost) < 1e-9
    assert (sums[1:] >= low - 1e-9).all() and (sums[1:] <= high + 1e-9).all()
    # no exchange of up to two steps between two components gives a cheaper feasible blend
    for i, j, k in itertools.product(range(20), range(20), (1, 2)):
        other = shares.copy()
        other[i] -= k
        other[j] += k
        if i != j and other.min() >= 0 and other.max() <= 12:
            sums = (values * other[:, None] / 20).sum(axis=0)
            assert sums[0] > cost - 1e-9 or (sums[1:] < low).any() or (sums[1:] > high).any()


def test_allocation_is_not_dearer_than_the_lattice(spark):
    rng = random.Random(5)
    prices = [rng.randint(1, 99) for _ in range(4)]
    cost = sum(r["share"] * r["price"] for r in allocation(spark, prices))
    points = (s for s in itertools.product(range(1, 13), repeat=4) if sum(s) == 20)
    assert cost <= min(sum(p * x / 20 for p, x in zip(prices, s)) for s in points) + 1e-9


def test_empty_component_table_gives_an_error_row(spark):
    columns = "id long, name string, type string, price double, " + ", ".join(
        f"{c} double" for c in ("mad", "ad", "vdaf", "std", "g", "x", "y", "cri", "csr", "m10", "m25", "m40")
    )
    rows = list_components(spark.createDataFrame([], columns)).collect()
    assert [(r["error"], r["count"]) for r in rows] == [(bl.NO_COMPONENTS, 0)]
    one = spark.createDataFrame([(1, "a", "t", 2.0, *[1.0] * 12)], columns)
    assert [(r["煤种"], r["error"], r["count"]) for r in list_components(one).collect()] == [("a", None, 1)]


def test_last_property_row_wins_and_null_is_zero(spark):
    columns = "id long, name string, " + ", ".join(f"{c} double" for c in bl.PROPERTIES)
    rows = spark.createDataFrame([(1, "a", *[1.0] * 12), (2, "a", *[None] * 12)], columns)
    assert [r["price"] for r in bl.property_table(rows).collect()] == [0.0]
    assert bl.page(rows, 2, 1, "id").select("id", "total").collect()[0] == (2, 2)


def test_half_open_limits(spark):
    limits = spark.createDataFrame([("s", "cri", None, 30.0), ("s", "ad", None, None)], "scenario_id string, metric string, lo double, hi double")
    assert [tuple(r) for r in bl.stated_limits(limits).collect()] == [("s", "cri", 0.0, 30.0)]
    mixed = spark.createDataFrame([("s", 1, 31.0), ("s", 2, 30.0), ("t", 3, 99.0)], "scenario_id string, blend_id int, cri double")
    got = bl.check_limits(mixed, limits).orderBy("blend_id").select("feasible").collect()
    assert [r[0] for r in got] == [False, True, True]


def test_large_groups_are_searched_among_useful_components():
    rng = random.Random(8)
    columns = 1 + len(bl.LIMITED_METRICS)
    calls = []
    follow = lattice._follow_levels
    for case in range(12):
        grid = case % 2  # few values make many equal costs
        values = np.array([[float(rng.randint(1, 4) * 10) if grid else rng.uniform(10, 90) for _ in range(columns)] for _ in range(60)])
        low, high = np.full(columns - 1, -np.inf), np.full(columns - 1, np.inf)
        low[0], high[0], low[2] = [(40, 45, -np.inf), (-np.inf, 30, 60), (20, np.inf, 25)][case % 3]
        some = follow(values, low, high, 4, 3, np.inf, lattice.BEAM)
        whole = follow(values, low, high, 4, 3, np.inf if some is None else some[0], None)
        got = lattice.cheapest_shares(values, low, high, 4, 3)
        assert (got and (round(got[0], 6), got[1].tolist())) == (whole and (round(whole[0], 6), whole[1].tolist())), case
    try:
        lattice._follow_levels = lambda values, *rest: calls.append(len(values)) or follow(values, *rest)
        values = np.array([[rng.uniform(10, 90) for _ in range(columns)] for _ in range(3000)])
        assert lattice.cheapest_shares(values, low, high, 4, 3) is not None
    finally:
        lattice._follow_levels = follow
    assert max(calls) <= 300  # not all 3000


def test_scenario_rows_keep_what_cannot_be_searched(spark):
    names = ("price", *bl.LIMITED_METRICS)
    properties = spark.createDataFrame([("a", *[1.0] * 8), ("b", 2.0, *[None] * 7)], "component string, " + ", ".join(f"{m} double" for m in names))
    limits = spark.createDataFrame([], "scenario_id string, metric string, lo double, hi double")
    wanted = [(1, "x", "a"), (1, "x", "a"), (2, None, "a"), (2, None, "b"), (3, "x", "ghost"), (3, "x", "a"), (None, "x", "a")]
    rows = scenario_rows(spark.createDataFrame(wanted, "scenario_id int, limit_set string, component string"), properties, limits)
    got = {r["scenario_id"]: (r["n"], r["cost"], r["shares"], r["components"], r["error"]) for r in cheapest_on_lattice(rows, 4, 4).collect()}
    assert got == {
        1: (1, 1.0, [4], ["a"], None), 2: (2, None, None, ["a", "b"], "no feasible blend"),
        3: (2, None, None, None, "unknown component"), None: (1, None, None, None, "no feasible blend"),
    }
