"""Blend analytics: property table, mixing, limits, allocation and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.numbers import fixed, round_binary

# Feature order, and the constant bounds of each feature's range.
FEATURES = ("mad", "ad", "vdaf", "std", "g", "x", "y")
FEATURE_MIN = (0.68, 7.03, 21.36, 0.15, 56.46, 16.00, 11.63)
FEATURE_MAX = (12.024, 21.660, 39.800, 4.410, 103.000, 41.000, 31.000)
# The numeric properties kept per component.
PROPERTIES = ("price", "mad", "ad", "vdaf", "std", "g", "x", "y", "cri", "csr", "m10", "m25")
# Which metrics can be limited, and the default limits of the quality metrics.
QUALITY_METRICS = ("cri", "csr", "m10", "m25")
LIMITED_METRICS = (*QUALITY_METRICS, "vdaf", "g", "ad")
DEFAULT_LOW, DEFAULT_HIGH = 0.0, 100.0
# Shares allowed per component in an allocation, and the smallest share shown.
SHARE_LOW, SHARE_HIGH = 0.05, 0.60
SHOWN_RATIO = 0.1
TOTAL_WEIGHT_G = 1000.0
# Text of the result tables.
BLEND_HEAD = "**配煤方案：**\n\n| 煤种 | 配比(%) | 重量(g) |\n|------|---------|---------|"
PREDICT_HEAD = "**焦炭质量预测：**\n\n| 指标 | 预测值 |\n|------|--------|"
NO_COMPONENTS = "数据库中没有煤样数据"
NOT_FEASIBLE = "无法找到满足约束的配煤方案，请放宽约束条件"


def scan_components(source: DataFrame) -> DataFrame:
    """The usable components: name, G and CRI must be known; sorted by name."""
    known = F.col("name").isNotNull() & F.col("g").isNotNull() & F.col("cri").isNotNull()
    return (
        source.where(known)
        .select("id", "name", "type", "price", "mad", "ad", "vdaf", "std", "g", "x", "y", "cri", "csr", "m10", "m25", "m40")
        .orderBy("name", "id")
    )


def property_table(source: DataFrame) -> DataFrame:
    """Numeric properties per name, null as zero; the row with the highest id wins."""
    numbers = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in PROPERTIES])
    return source.groupBy("name").agg(F.max_by(numbers, "id").alias("p")).select("name", "p.*")


def list_components(source: DataFrame) -> DataFrame:
    """Eight columns under their display names, with the row count beside them.

    An empty table yields one row that carries only an error.
    """
    rows = scan_components(source)
    total = rows.agg(F.count("*").alias("n"))
    listed = rows.select(
        F.col("name").alias("煤种"), F.col("type").alias("类型"), F.col("price").alias("价格"),
        F.col("vdaf").alias("Vdaf"), F.col("g").alias("G"), F.col("ad").alias("Ad"),
        F.col("cri").alias("CRI"), F.col("csr").alias("CSR"), F.lit(None).cast("string").alias("error"),
    )
    missing = total.where("n = 0").select(
        *[F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in listed.columns[:-1]],
        F.lit(NO_COMPONENTS).alias("error"),
    )
    return listed.unionByName(missing).withColumn("count", total.scalar())


def page(source: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """One page of the sorted rows, with the total beside it."""
    total = source.agg(F.count("*").alias("n")).scalar()
    return source.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def mix(requests: DataFrame, properties: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Weighted mean of the properties per blend.

    Components without a property row add nothing but still count in the divisor.  ``requests`` is
    (blend_id, component, pct), ``properties`` is keyed by ``component``.
    """
    joined = requests.join(properties.select("component", *columns), "component", "left")
    weighted = [F.sum(F.col("pct") * F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns]
    summed = joined.groupBy("blend_id").agg(F.sum("pct").alias("_total"), *weighted)
    return summed.select("blend_id", *[(F.col(c) / F.col("_total")).alias(c) for c in columns])


def normalised(features: DataFrame) -> DataFrame:
    """Min-max normalisation with the constant bounds; values outside are not clipped."""
    scaled = [
        ((F.col(c) - lo) / (hi - lo)).alias(f"{c}_n") for c, lo, hi in zip(FEATURES, FEATURE_MIN, FEATURE_MAX)
    ]
    return features.select("*", *scaled)


def missing_components(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """Names asked for that have no property row."""
    return requests.select("blend_id", "component").join(properties.select("component"), "component", "left_anti")


def stated_limits(limits: DataFrame) -> DataFrame:
    """Only limits that are present; a half-open quality limit gets the default other end.

    ``limits`` is (scenario_id, metric, lo, hi).
    """
    quality = F.col("metric").isin(*QUALITY_METRICS)
    return limits.where(F.col("lo").isNotNull() | F.col("hi").isNotNull()).select(
        "scenario_id",
        "metric",
        F.coalesce("lo", F.when(quality, F.lit(DEFAULT_LOW)).otherwise(F.lit(float("-inf")))).alias("lo"),
        F.coalesce("hi", F.when(quality, F.lit(DEFAULT_HIGH)).otherwise(F.lit(float("inf")))).alias("hi"),
    )


def limit_arrays(limits: DataFrame) -> DataFrame:
    """All stated limits of a scenario in one array; a scenario has at most a few metrics."""
    return stated_limits(limits).groupBy("scenario_id").agg(
        F.array_sort(F.collect_list(F.struct("metric", "lo", "hi"))).alias("limits")
    )


def within_limits(metrics: Column, limits: Column) -> Column:
    """Whether a map of metric values keeps all limits; no limits means yes."""
    ok = F.forall(limits, lambda b: F.element_at(metrics, b["metric"]).between(b["lo"], b["hi"]))
    return F.coalesce(ok, F.lit(True))


def metric_map(*columns: str) -> Column:
    return F.create_map(*[piece for c in columns for piece in (F.lit(c), F.col(c))])


def check_limits(mixed: DataFrame, limits: DataFrame) -> DataFrame:
    """Mark each blend (with ``scenario_id`` and its metrics) as feasible or not."""
    columns = [c for c in LIMITED_METRICS if c in mixed.columns]
    joined = mixed.join(limit_arrays(limits), "scenario_id", "left")
    return joined.withColumn("feasible", within_limits(metric_map(*columns), F.col("limits"))).drop("limits")


def allocate(requests: DataFrame, prices: DataFrame, total_weight_g: float = TOTAL_WEIGHT_G) -> DataFrame:
    """Cheapest shares per blend when only the sum and the share limits bind.

    Everybody gets the lower share, the rest goes to the cheapest first.  Numbers of components that
    admit no solution yield no row; they are removed by a partial count before the window, which so
    never sees more than 20 rows per blend.
    """
    asked = requests.select("blend_id", "component").distinct()
    sizes = asked.groupBy("blend_id").agg(F.count("*").alias("n")).where(
        (F.col("n") * SHARE_LOW <= 1.0) & (F.col("n") * SHARE_HIGH >= 1.0)
    )
    rows = asked.join(sizes, "blend_id").join(prices.select("component", "price"), "component")
    width = SHARE_HIGH - SHARE_LOW
    before = Window.partitionBy("blend_id").orderBy("price", "component").rowsBetween(Window.unboundedPreceding, -1)
    slack = F.lit(1.0) - F.col("n") * SHARE_LOW
    used = F.coalesce(F.count("*").over(before), F.lit(0)) * width
    extra = F.least(F.greatest(slack - used, F.lit(0.0)), F.lit(width))
    share = rows.withColumn("share", F.lit(SHARE_LOW) + extra)
    return share.select(
        "blend_id", "component", "price", "share",
        round_binary(F.col("share") * 100, 1).alias("ratio"),
        round_binary(F.col("share") * total_weight_g, 1).alias("weight_g"),
    )


def plan_rows(allocation: DataFrame, total_weight_g: float = TOTAL_WEIGHT_G, optimizer: str = "LP") -> DataFrame:
    """One row per blend: component array, cost per ton, total weight, optimiser name."""
    part = F.struct("component", "ratio", "weight_g")
    return allocation.groupBy("blend_id").agg(
        F.array_sort(F.collect_list(part)).alias("hoppers"), F.round(F.sum(F.col("share") * F.col("price")), 6).alias("cost_per_ton")
    ).select(
        "blend_id", "hoppers", "cost_per_ton", F.lit(total_weight_g).alias("total_weight_g"), F.lit(optimizer).alias("optimizer")
    )


def shown(hoppers: Column) -> Column:
    """Components with a share above a tenth of a percent."""
    return F.filter(hoppers, lambda h: h["ratio"] > SHOWN_RATIO)


def plan_markdown(plans: DataFrame) -> DataFrame:
    line = F.transform(
        shown(F.col("hoppers")),
        lambda h: F.concat(
            F.lit("| "), h["component"].cast("string"), F.lit(" | "), h["ratio"].cast("string"),
            F.lit(" | "), h["weight_g"].cast("string"), F.lit(" |"),
        ),
    )
    cost = F.when(
        F.col("cost_per_ton") > 0,
        F.concat(F.lit("- 吨煤成本："), fixed(F.col("cost_per_ton"), 1), F.lit(" 元")),
    )
    text = F.concat_ws(
        "\n", F.lit(BLEND_HEAD), F.array_join(line, "\n"), F.lit(""),
        F.concat(F.lit("- 总重量："), F.col("total_weight_g").cast("string"), F.lit("g")),
        cost, F.concat(F.lit("- 优化算法："), F.col("optimizer")),
    )
    return plans.select("blend_id", text.alias("markdown"))


def prediction_markdown(rows: DataFrame, metrics: tuple[str, ...], model: Column) -> DataFrame:
    lines = [
        F.concat(F.lit(f"| {m.upper() if m != 'ad' else 'Ad'} | "), fixed(F.col(m), 2), F.lit(" |"))
        for m in metrics
    ]
    text = F.concat_ws("\n", F.lit(PREDICT_HEAD), *lines, F.concat(F.lit("\n- 预测模型："), model))
    return rows.select("blend_id", text.alias("markdown"))
