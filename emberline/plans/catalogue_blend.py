"""Named blend queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators import blend as bl
from emberline.operators.lattice import cheapest_on_lattice, scenario_rows
from emberline.plans.blend_tools import optimize_blends, predict_quality
from emberline.sources.tables import blends, components, table

#: Limits per order priority: (priority, metric, low, high); one row has neither end.
LIMITS = [
    ("1-URGENT", "cri", 22.0, 26.0),
    ("1-URGENT", "g", 30.0, None),
    ("2-HIGH", "csr", 55.0, None),
    ("2-HIGH", "vdaf", None, 27.0),
    ("3-MEDIUM", "m10", None, 10.5),
    ("3-MEDIUM", "ad", None, None),
    ("4-NOT SPECIFIED", "m25", 88.0, 88.5),
    ("5-LOW", "ad", None, 12.5),
]
LIMIT_SCHEMA = "scenario_id string, metric string, lo double, hi double"

SQL_COMPONENTS = """
sold AS (
  SELECT l_partkey, avg(l_discount) * 100 AS mad, avg(l_tax) * 200 + 5 AS ad, avg(l_quantity) AS vdaf,
         avg(l_extendedprice) / 10000 AS std, avg(l_linenumber) * 5 AS x, avg(l_quantity) / 2 AS y
  FROM lineitem GROUP BY l_partkey
),
comp AS (
  SELECT p_partkey AS id, p_name || ' ' || p_partkey AS name, p_type AS type, p_retailprice AS price,
         mad, ad, vdaf, std, CASE WHEN l_partkey IS NOT NULL THEN p_size * 2.0::DOUBLE END AS g, x, y,
         mad + 20 AS cri, ad * 2 + 40 AS csr, x / 2 AS m10, ad + 75 AS m25, mad + 70 AS m40, p_size
  FROM part LEFT JOIN sold ON p_partkey = l_partkey
),
bl AS (SELECT l_orderkey AS blend_id, l_partkey AS component, sum(l_quantity) AS pct FROM lineitem GROUP BY 1, 2)"""
SQL_LIMITS = "lim(scenario_id, metric, lo, hi) AS (VALUES " + ", ".join(
    f"('{s}', '{m}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE)" for s, m, lo, hi in LIMITS
) + ")"
SQL_MIXED = SQL_COMPONENTS + """,
mixed AS (
  SELECT blend_id, """ + ", ".join(
    f"sum(pct * coalesce({c}, 0)) / sum(pct) AS {c}" for c in ("mad", "ad", "vdaf", "std", "g", "x", "y", "price", "cri", "csr", "m10", "m25")
) + """
  FROM bl LEFT JOIN (SELECT * FROM comp WHERE p_size >= 10) k ON k.id = component GROUP BY blend_id
)"""
SQL_ALLOCATION = SQL_COMPONENTS + """,
sized AS (SELECT blend_id, component, count(*) OVER (PARTITION BY blend_id) AS n FROM bl),
ok AS (SELECT * FROM sized WHERE n * 0.05::DOUBLE <= 1 AND n * 0.60::DOUBLE >= 1),
ranked AS (
  SELECT ok.*, price, row_number() OVER (PARTITION BY blend_id ORDER BY price, component) - 1 AS before
  FROM ok JOIN comp ON id = component
),
alloc AS (
  SELECT blend_id, component, price, n,
    0.05::DOUBLE + least(greatest(1.0::DOUBLE - n * 0.05::DOUBLE - before * (0.60::DOUBLE - 0.05::DOUBLE), 0.0::DOUBLE), 0.60::DOUBLE - 0.05::DOUBLE) AS share
  FROM ranked
)"""
SHORT_METRICS = bl.LIMITED_METRICS


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _known(spark, d):
    """Property rows of components with an assay: those of size 10 and more."""
    sized = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return components(spark, d).join(sized, "id").where("p_size >= 10").withColumnRenamed("id", "component")


def _limits(spark):
    return spark.createDataFrame(LIMITS, LIMIT_SCHEMA)


def component_scan(spark, d):
    return _rounded(bl.scan_components(components(spark, d)), "mad", "ad", "vdaf", "std", "x", "y", "cri", "csr", "m10", "m25", "m40")


def component_properties(spark, d):
    """Properties per part name: 64 names, the last part of a name wins."""
    source = components(spark, d).withColumn("name", F.regexp_replace("name", r" \d+$", ""))
    return _rounded(bl.property_table(source), *bl.PROPERTIES)


def component_list(spark, d):
    return _rounded(bl.list_components(components(spark, d)), "Vdaf", "Ad", "CRI", "CSR")


def component_page(spark, d):
    rows = bl.scan_components(components(spark, d)).select("id", "name", "price")
    return bl.page(rows, 3, 10, "name", "id")


def components_by_fragment(spark, d):
    """Case-insensitive containment on the component name."""
    from emberline.functions.text import contains_ignoring_case

    return components(spark, d).where(contains_ignoring_case(F.col("name"), F.lit("ANVIL"))).select("id", "name", "type")


def blend_features(spark, d):
    return _rounded(bl.mix(blends(spark, d), _known(spark, d)), *bl.FEATURES)


def blend_features_normalised(spark, d):
    scaled = bl.normalised(bl.mix(blends(spark, d), _known(spark, d)))
    return _rounded(scaled.select("blend_id", *[f"{c}_n" for c in bl.FEATURES]), *[f"{c}_n" for c in bl.FEATURES])


def _feasible(spark, d):
    mixed = bl.mix(blends(spark, d), _known(spark, d), ("price", *SHORT_METRICS))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("blend_id"), F.col("o_orderpriority").alias("scenario_id"))
    return bl.check_limits(mixed.join(orders, "blend_id"), _limits(spark))


def blend_cost_and_limits(spark, d):
    # the small shift keeps means such as k/64 away from the rounding boundary
    rows = _feasible(spark, d).withColumn("price", F.col("price") + 1e-9)
    return _rounded(rows.select("blend_id", "scenario_id", "price", "feasible"), "price")


def stated_limits(spark, d):
    """Limits in force, with the number of orders they apply to."""
    orders = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("scenario_id")).agg(F.count("*").alias("orders"))
    inf = F.col("hi") == float("inf")
    rows = bl.stated_limits(_limits(spark)).join(orders, "scenario_id")
    return rows.select(
        "scenario_id", "metric", "orders",
        F.when(F.col("lo") != float("-inf"), F.col("lo")).alias("lo"), F.when(~inf, F.col("hi")).alias("hi"),
    )


def missing_components(spark, d):
    return bl.missing_components(blends(spark, d), _known(spark, d)).select("blend_id", "component")


def candidate_properties(spark, d):
    """Components of each blend with their properties; unknown ones are left to the report above."""
    rows = blends(spark, d).join(_known(spark, d).select("component", "price", "g", "cri"), "component")
    return _rounded(rows.select("blend_id", "component", "price", "g", "cri"), "cri")


def _allocation(spark, d):
    prices = components(spark, d).select(F.col("id").alias("component"), "price")
    return bl.allocate(blends(spark, d), prices)


def blend_allocation(spark, d):
    return _rounded(_allocation(spark, d).select("blend_id", "component", "price", "share"), "share")


def blend_plans(spark, d):
    plans = bl.plan_rows(_allocation(spark, d))
    shown = bl.shown(F.col("hoppers"))
    return plans.select(
        "blend_id", F.round("cost_per_ton", 6).alias("cost_per_ton"), "optimizer", "total_weight_g",
        F.size(shown).cast("long").alias("shown"),
        F.array_join(F.transform(shown, lambda h: h["component"].cast("string")), ",").alias("parts"),
    )


def blend_plan_tables(spark, d):
    return bl.plan_markdown(bl.plan_rows(_allocation(spark, d)))


def blend_lattice(spark, d):
    """Cheapest lattice blend per order in steps of a fifth, limits by order priority."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("limit_set"))
    wanted = blends(spark, d).select(F.col("blend_id").alias("scenario_id"), "component").join(orders, "scenario_id")
    known = components(spark, d).withColumnRenamed("id", "component")
    scenarios = scenario_rows(wanted, known, _limits(spark))
    best = cheapest_on_lattice(scenarios, steps=5, max_share_steps=3)
    return best.select(
        "scenario_id", F.round("cost", 4).alias("cost"), F.array_join("shares", ",").alias("shares"), "error"
    )


def blend_lattice_types(spark, d):
    """Cheapest lattice blend of all sold parts of a type and band of sizes, about twenty; the band says which limits hold."""
    known = components(spark, d).where("g IS NOT NULL").withColumnRenamed("id", "component")
    priorities = F.array(*[F.lit(name) for name in dict.fromkeys(limit[0] for limit in LIMITS)])
    band = F.expr("cast(g as int) div 6")
    limit_set = F.element_at(priorities, (band % 5 + 1).cast("int"))
    wanted = known.select(F.concat("type", F.lit(" "), band.cast("string")).alias("scenario_id"), limit_set.alias("limit_set"), "component")
    best = cheapest_on_lattice(scenario_rows(wanted, known, _limits(spark)), steps=4, max_share_steps=3)
    return best.select("scenario_id", "n", F.round("cost", 4).alias("cost"), F.array_join("shares", ",").alias("shares"), "error")


def tool_optimize(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario_id"), F.col("o_orderpriority").alias("limit_set"))
    wanted = blends(spark, d).select(F.col("blend_id").alias("scenario_id"), "component").join(orders, "scenario_id")
    known = components(spark, d).withColumnRenamed("id", "component")
    plans = optimize_blends(wanted, known, _limits(spark), steps=5, max_share_steps=3)
    return plans.groupBy("optimizer", "error").agg(
        F.count("*").alias("scenarios"), F.round(F.sum("cost_per_ton"), 2).alias("cost_sum")
    )


def tool_predict(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("blend_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Unheard")).otherwise(F.lit("KNN")).alias("model"),
    )
    reference = _knn_reference(spark, d)
    rows = predict_quality(blends(spark, d), _known(spark, d), orders, reference)
    return rows.select("blend_id", "model", "error", *[F.round(c, 2).alias(c) for c in ("ad", "cri", "csr")])


def _knn_reference(spark, d):
    """Training rows: the mean assay per type and size, normalised."""
    known = components(spark, d)
    sized = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    profile = (
        known.where("g IS NOT NULL").join(sized, "id")
        .groupBy(F.concat_ws("/", "type", F.col("p_size").cast("string")).alias("profile"))
        .agg(*[F.avg(c).alias(c) for c in (*bl.FEATURES, "cri", "csr")])
    )
    return bl.normalised(profile)


QUERIES = {
    f.__name__: f
    for f in (
        component_scan, component_properties, component_list, component_page, components_by_fragment,
        blend_features, blend_features_normalised, blend_cost_and_limits, stated_limits, missing_components,
        candidate_properties, blend_allocation, blend_plans, blend_plan_tables, blend_lattice, blend_lattice_types, tool_optimize,
        tool_predict,
    )
}

_R = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_PARTS = """
  SELECT blend_id, component, o_orderpriority AS limit_set, price, cri, csr, m10, m25, vdaf, g, ad,
    row_number() OVER (PARTITION BY blend_id ORDER BY component) AS pos, count(*) OVER (PARTITION BY blend_id) AS n
  FROM bl JOIN comp ON id = component JOIN orders ON o_orderkey = blend_id"""
_TYPE_PARTS = f"""
  SELECT type || ' ' || band AS blend_id, id AS component, [{', '.join(f"'{name}'" for name in dict.fromkeys(limit[0] for limit in LIMITS))}][band % 5 + 1] AS limit_set,
    price, cri, csr, m10, m25, vdaf, g, ad, row_number() OVER (PARTITION BY type, band ORDER BY id) AS pos, count(*) OVER (PARTITION BY type, band) AS n
  FROM (SELECT *, g::BIGINT // 6 AS band FROM comp WHERE g IS NOT NULL)"""


def _lattice(parts: str, steps: int) -> str:
    """All lattice points with shares of at most three steps."""
    sums = ", ".join(f"w.{c} + p.{c} * (s / {steps}.0::DOUBLE) AS {c}" for c in ("price", "cri", "csr", "m10", "m25", "vdaf", "g", "ad"))
    return SQL_COMPONENTS + f""", {SQL_LIMITS},
lims AS (
  SELECT scenario_id AS limit_set, metric,
    coalesce(lo, CASE WHEN metric IN ('cri', 'csr', 'm10', 'm25') THEN 0 ELSE -1e300 END) AS lo,
    coalesce(hi, CASE WHEN metric IN ('cri', 'csr', 'm10', 'm25') THEN 100 ELSE 1e300 END) AS hi
  FROM lim WHERE lo IS NOT NULL OR hi IS NOT NULL
),
parts AS (
{parts}
),
walk AS (
  WITH RECURSIVE w AS (
    SELECT blend_id, limit_set, n, 0::BIGINT AS pos, {steps}::BIGINT AS rest, ''::VARCHAR AS shares, 0.0::DOUBLE AS price, 0.0::DOUBLE AS cri,
      0.0::DOUBLE AS csr, 0.0::DOUBLE AS m10, 0.0::DOUBLE AS m25, 0.0::DOUBLE AS vdaf, 0.0::DOUBLE AS g, 0.0::DOUBLE AS ad
    FROM (SELECT DISTINCT blend_id, limit_set, n FROM parts)
    UNION ALL
    SELECT w.blend_id, w.limit_set, w.n, p.pos, rest - s, CASE WHEN shares = '' THEN '' ELSE shares || ',' END || s,
      {sums}
    FROM w JOIN parts p ON p.blend_id = w.blend_id AND p.pos = w.pos + 1, (VALUES (0), (1), (2), (3)) v(s) WHERE s <= rest AND rest - s <= 3 * (w.n - p.pos)
  )
  SELECT * FROM w WHERE pos = n AND rest = 0
),
vals AS (UNPIVOT walk ON cri, csr, m10, m25, vdaf, g, ad INTO NAME metric VALUE value),
bad AS (
  SELECT DISTINCT blend_id, shares FROM vals JOIN lims USING (limit_set, metric)
  WHERE value < lo - 1e-9 OR value > hi + 1e-9
),
best AS (
  SELECT blend_id, round(price, 6) AS cost, shares FROM walk ANTI JOIN bad USING (blend_id, shares)
  QUALIFY row_number() OVER (PARTITION BY blend_id ORDER BY cost, string_split(shares, ',')) = 1
),
lattice AS (
  SELECT DISTINCT p.blend_id AS scenario_id, n, cost, shares,
    CASE WHEN cost IS NULL THEN 'no feasible blend' END AS error
  FROM parts p LEFT JOIN best USING (blend_id)
)"""


_LATTICE = _lattice(_PARTS, 5)

ORACLES = {
    "component_scan": f"""WITH {SQL_COMPONENTS}
SELECT id, name, type, price, {_R('mad', 'ad', 'vdaf', 'std', 'x', 'y', 'cri', 'csr', 'm10', 'm25', 'm40')}, g
FROM comp WHERE name IS NOT NULL AND g IS NOT NULL AND cri IS NOT NULL""",
    "component_properties": f"""WITH {SQL_COMPONENTS},
named AS (SELECT *, regexp_replace(name, ' [0-9]+$', '') AS short FROM comp)
SELECT short AS name, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in bl.PROPERTIES)}
FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY short ORDER BY id DESC) = 1)""",
    "component_list": f"""WITH {SQL_COMPONENTS}
SELECT name AS "煤种", type AS "类型", price AS "价格", round(vdaf, 6) AS "Vdaf", g AS "G", round(ad, 6) AS "Ad", round(cri, 6) AS "CRI",
  round(csr, 6) AS "CSR", NULL::VARCHAR AS error, count(*) OVER () AS count FROM comp WHERE g IS NOT NULL""",
    "component_page": f"""WITH {SQL_COMPONENTS}
SELECT id, name, price, (SELECT count(*) FROM comp WHERE g IS NOT NULL) AS total FROM comp WHERE g IS NOT NULL
ORDER BY name, id LIMIT 10 OFFSET 20""",
    "components_by_fragment": f"""WITH {SQL_COMPONENTS}
SELECT id, name, type FROM comp WHERE contains(lower(name), lower('ANVIL'))""",
    "blend_features": f"WITH {SQL_MIXED} SELECT blend_id, {_R(*bl.FEATURES)} FROM mixed",
    "blend_features_normalised": f"WITH {SQL_MIXED} SELECT blend_id, " + ", ".join(
        f"round(({c} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE), 6) AS {c}_n"
        for c, lo, hi in zip(bl.FEATURES, bl.FEATURE_MIN, bl.FEATURE_MAX)
    ) + " FROM mixed",
    "blend_cost_and_limits": f"""WITH {SQL_MIXED}, {SQL_LIMITS},
long AS (UNPIVOT (SELECT blend_id, cri, csr, m10, m25, vdaf, g, ad FROM mixed) ON cri, csr, m10, m25, vdaf, g, ad INTO NAME metric VALUE value),
bad AS (
  SELECT DISTINCT blend_id FROM long JOIN orders ON o_orderkey = blend_id JOIN lim ON scenario_id = o_orderpriority AND lim.metric = long.metric
  WHERE (lo IS NOT NULL OR hi IS NOT NULL) AND (value < lo OR value > hi
     OR (lim.metric IN ('cri', 'csr', 'm10', 'm25') AND (value < coalesce(lo, 0) OR value > coalesce(hi, 100))))
)
SELECT mixed.blend_id, o_orderpriority AS scenario_id, round(price + 1e-9, 6) AS price, bad.blend_id IS NULL AS feasible
FROM mixed JOIN orders ON o_orderkey = mixed.blend_id LEFT JOIN bad USING (blend_id)""",
    "stated_limits": f"""WITH {SQL_LIMITS}
SELECT scenario_id, metric, (SELECT count(*) FROM orders WHERE o_orderpriority = scenario_id) AS orders,
  coalesce(lo, CASE WHEN metric IN ('cri', 'csr', 'm10', 'm25') THEN 0 END) AS lo,
  coalesce(hi, CASE WHEN metric IN ('cri', 'csr', 'm10', 'm25') THEN 100 END) AS hi
FROM lim WHERE lo IS NOT NULL OR hi IS NOT NULL""",
    "missing_components": """SELECT DISTINCT l_orderkey AS blend_id, l_partkey AS component
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10""",
    "candidate_properties": f"""WITH {SQL_COMPONENTS}
SELECT blend_id, component, price, g, round(cri, 6) AS cri FROM bl JOIN comp ON id = component WHERE p_size >= 10""",
    "blend_allocation": f"""WITH {SQL_ALLOCATION}
SELECT blend_id, component, price, round(share, 6) AS share FROM alloc""",
    "blend_plans": f"""WITH {SQL_ALLOCATION}
SELECT blend_id, round(sum(share * price), 6) AS cost_per_ton, 'LP' AS optimizer, 1000.0::DOUBLE AS total_weight_g,
  count(*) FILTER (round(share * 100, 1) > 0.1) AS shown, string_agg(component::VARCHAR, ',' ORDER BY component) AS parts
FROM alloc GROUP BY blend_id""",
    "blend_plan_tables": f"""WITH {SQL_ALLOCATION}
SELECT blend_id, '**配煤方案：**' || chr(10) || chr(10) || '| 煤种 | 配比(%) | 重量(g) |' || chr(10) || '|------|---------|---------|' || chr(10)
  || string_agg('| ' || component || ' | ' || printf('%.1f', share * 100) || ' | ' || printf('%.1f', share * 1000) || ' |', chr(10) ORDER BY component)
  || chr(10) || chr(10) || '- 总重量：1000.0g' || chr(10) || '- 吨煤成本：' || printf('%.1f', round(sum(share * price), 6)) || ' 元' || chr(10) || '- 优化算法：LP' AS markdown
FROM alloc GROUP BY blend_id""",
    "blend_lattice": f"WITH {_LATTICE} SELECT scenario_id, round(cost, 4) AS cost, shares, error FROM lattice",
    "blend_lattice_types": f"WITH {_lattice(_TYPE_PARTS, 4)} SELECT scenario_id, n, round(cost, 4) AS cost, shares, error FROM lattice",
    "tool_optimize": f"""WITH {_LATTICE}
SELECT 'lattice' AS optimizer, error, count(*) AS scenarios, round(sum(cost), 2) AS cost_sum FROM lattice GROUP BY error""",
    "tool_predict": f"""WITH {SQL_MIXED},
profile AS (
  SELECT type || '/' || p_size AS profile, {', '.join(f'avg({c}) AS {c}' for c in (*bl.FEATURES, 'cri', 'csr'))}
  FROM comp WHERE g IS NOT NULL GROUP BY 1
),
dist AS (
  SELECT blend_id, profile, p.cri, p.csr, round({' + '.join(
      f'(((m.{c} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)) - ((p.{c} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE))) ** 2'
      for c, lo, hi in zip(bl.FEATURES, bl.FEATURE_MIN, bl.FEATURE_MAX))}, 9) AS dd
  FROM mixed m, profile p
),
near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY blend_id ORDER BY dd, profile) <= 5),
pred AS (SELECT blend_id, avg(cri) AS cri, avg(csr) AS csr FROM near GROUP BY blend_id)
SELECT blend_id, CASE WHEN o_orderstatus = 'F' THEN 'Unheard' ELSE 'KNN' END AS model,
  CASE WHEN o_orderstatus = 'F' THEN 'Model ''Unheard'' not available' END AS error, round(ad, 2) AS ad,
  CASE WHEN o_orderstatus <> 'F' THEN round(pred.cri, 2) END AS cri, CASE WHEN o_orderstatus <> 'F' THEN round(pred.csr, 2) END AS csr
FROM mixed JOIN orders ON o_orderkey = blend_id JOIN pred USING (blend_id)""",
}
