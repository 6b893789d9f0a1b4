"""Composite trend scores, categories, early warning, ablation of components, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEIGHTS = {"volume": 0.2, "growth": 0.4, "engagement": 0.3, "novelty": 0.1}


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def growth_norm(percent: Column) -> Column:
    """Percent growth to 0..1; no growth is 0.5, 500 % and more is 1."""
    return (
        F.when(percent <= -100, 0.0)
        .when(percent < 0, 0.5 + percent / 200)
        .when(percent == 0, 0.5)
        .otherwise(0.5 + F.least(percent / 1000, F.lit(0.5)))
    )


def novelty(days: Column, scale: float = 7.0) -> Column:
    return F.exp(-days / scale)


def share_of_max(col: str, over: Window | None = None) -> Column:
    top = F.max(col).over(over if over is not None else Window.partitionBy(F.lit(1)))
    return F.least(F.col(col) / F.greatest(top, F.lit(1)), F.lit(1.0))


def min_max(col: str, over: Window) -> Column:
    lo, hi = F.min(col).over(over), F.max(col).over(over)
    return F.when(hi == lo, 0.5).otherwise((F.col(col) - lo) / (hi - lo))


def score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds components and score from volume_norm, growth_norm, engagement_norm, novelty. Weights sum to 1 (within 0.01)."""
    weights = weights or WEIGHTS
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    inputs = {"volume": "volume_norm", "growth": "growth_norm", "engagement": "engagement_norm", "novelty": "novelty"}
    df = df.withColumns({f"{k}_component": F.lit(float(weights.get(k, 0.0))) * F.col(c) for k, c in inputs.items()})
    return df.withColumn("score", clamp(sum((F.col(f"{k}_component") for k in inputs), F.lit(0.0))))


def normalised(latest: DataFrame, days: str = "days_active") -> DataFrame:
    """Inputs of score() for one row per topic; maxima by a one-row aggregate, not a window over everything."""
    top = latest.agg(F.max("volume").alias("_v"), F.max("engagement").alias("_e"))
    out = latest.crossJoin(F.broadcast(top))
    return out.withColumns(
        {
            "volume_norm": F.least(F.col("volume") / F.greatest(F.col("_v"), F.lit(1)), F.lit(1.0)),
            "engagement_norm": F.least(F.col("engagement") / F.greatest(F.col("_e"), F.lit(1)), F.lit(1.0)),
            "growth_norm": growth_norm(F.col("volume_growth")),
            "novelty": novelty(F.col(days)),
        }
    ).drop("_v", "_e")


def ranked(df: DataFrame, by: str = "score", name: str = "rank", over: list[str] | None = None) -> DataFrame:
    """1.. by falling score, ties by topic."""
    w = (Window.partitionBy(*over) if over else Window.partitionBy(F.lit(1))).orderBy(F.desc(by), "topic")
    return df.withColumn(name, F.row_number().over(w))


def frequency_score(df: DataFrame) -> DataFrame:
    return df.withColumn("frequency_score", F.col("volume_norm"))


def volume_growth_score(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    return df.withColumn("volume_growth_score", alpha * F.col("volume_norm") + (1 - alpha) * F.col("growth_norm"))


def classify(
    df: DataFrame, low: float = 10, emerging: float = 0.5, viral: float = 2.0, stable: float = 0.1, periods: int = 2, growth_pct: str = "volume_growth"
) -> DataFrame:
    """Category, confidence and criteria from volume growth (percent), baseline_volume, rises and falls."""
    g = F.col(growth_pct) / 100.0
    b = F.col("baseline_volume")
    is_viral, is_new, is_up, is_flat, is_down = g >= viral, (b < low) & (g >= emerging), g > 0, F.abs(g) <= stable, g < 0
    unknown = g.isNull() | F.isnan(g)
    cat = F.when(unknown, "UNKNOWN").when(is_viral, "VIRAL").when(is_new, "EMERGING").when(is_up, "RISING").when(is_flat, "STABLE").when(is_down, "DECLINING")
    conf = (
        F.when(unknown, 0.0)
        .when(is_viral, F.least(F.lit(1.0), g / (2 * viral)))
        .when(is_new, 0.8)
        .when(is_up, F.when(F.col("rises") >= periods, 0.7).otherwise(0.5))
        .when(is_flat, 0.7)
        .when(is_down, F.when(F.col("falls") >= periods, 0.8).otherwise(0.6))
    )
    pct = lambda x, d=1: F.format_string(f"%.{d}f%%", x * 100)
    reasons = (
        F.when(unknown, F.array().cast("array<string>"))
        .when(is_viral, F.array(F.concat(F.lit("growth "), pct(g), F.lit(f" >= {viral:.0%}"))))
        .when(is_new, F.array(F.concat(F.lit("baseline "), F.format_string("%.0f", b), F.lit(f" < {low:.0f}")), F.concat(F.lit("growth "), pct(g), F.lit(f" >= {emerging:.0%}"))))
        .when(is_up, F.array(F.when(F.col("rises") >= periods, F.format_string("growth for %d periods", F.col("rises"))).otherwise("growth")))
        .when(is_flat, F.array(F.concat(F.lit("change within "), F.lit(f"{stable:.0%}"))))
        .otherwise(F.array_compact(F.array(F.concat(F.lit("decline "), pct(g)), F.when(F.col("falls") >= periods, F.format_string("decline for %d periods", F.col("falls"))))))
    )
    return df.withColumns({"category": cat, "confidence": conf, "criteria": reasons})


def early_warning(df: DataFrame, growth_pct: str = "volume_growth") -> DataFrame:
    """For EMERGING rows: growth, distance from the baseline and momentum, together at most 1."""
    g, v, b = F.col(growth_pct) / 100.0, F.col("volume"), F.col("baseline_volume")
    away = F.when(b > 0, F.least(F.try_divide(v - b, b) / 5, F.lit(0.3))).otherwise(0.3)
    total = F.least(g / 3, F.lit(0.5)) + away + F.least(v / 100, F.lit(0.2))
    return df.withColumn("early_warning", F.when(F.col("category") == "EMERGING", F.least(total, F.lit(1.0))))


def emerging(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category").isin("EMERGING", "VIRAL", "RISING"))


def ablation_grid(spark: SparkSession, components: dict[str, float] | None = None) -> DataFrame:
    """Configurations: all components, each left out, each alone; weights shared anew."""
    base = components or WEIGHTS
    grid = {"full": base}
    grid |= {f"without_{k}": {c: w for c, w in base.items() if c != k} for k in base}
    grid |= {f"only_{k}": {k: 1.0} for k in base}
    rows = []
    for name, use in grid.items():
        total = sum(use.values())
        rows.append((name, *[use.get(k, 0.0) / total for k in WEIGHTS]))
    return spark.createDataFrame(rows, "config string, " + ", ".join(f"w_{k} double" for k in WEIGHTS))


def ablate(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Scores under every configuration in one pass (the grid is a handful of rows)."""
    inputs = {"volume": "volume_norm", "growth": "growth_norm", "engagement": "engagement_norm", "novelty": "novelty"}
    total = sum((F.col(f"w_{k}") * F.col(c) for k, c in inputs.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(grid)).withColumn("score", clamp(total))


def importance(scored: DataFrame, metric: str) -> DataFrame:
    """How much the metric falls when a component is left out. scored: config, metric."""
    full = scored.filter("config = 'full'").select(F.col(metric).alias("_full"))
    out = scored.filter("config like 'without_%'").crossJoin(F.broadcast(full))
    return out.select(F.expr("substr(config, 9)").alias("component"), (F.col("_full") - F.col(metric)).alias("importance")).orderBy(F.desc("importance"), "component")


# Explanations -------------------------------------------------------------------------------------------------------


def explain_quick(df: DataFrame) -> DataFrame:
    line = F.format_string(
        "%s: %s, score %.3f, volume %d, growth %.1f%%, engagement %.0f", "topic", "category", "score", F.col("volume").cast("long"), "volume_growth", F.col("engagement").cast("double")
    )
    return df.withColumn("explanation", line)


def reasons(growth: Column, engagement: Column, novel: Column, speed: Column, sources: Column, authors: Column) -> Column:
    """Why a topic moves: thresholds on growth, engagement, novelty, velocity, sources and authors."""
    found = F.array_compact(
        F.array(
            F.when(growth > 50, F.format_string("volume up %.0f%%", growth)).when(growth < -30, F.format_string("volume down %.0f%%", -growth)),
            F.when(engagement > 50, F.format_string("engagement up %.0f%%", engagement)),
            F.when(novel > 0.7, F.format_string("new topic (%.2f)", novel)),
            F.when(speed > 20, F.format_string("velocity %.1f%%", speed)),
            F.when(sources > 3, F.format_string("%d sources", sources.cast("long"))),
            F.when(authors > 20, F.format_string("%d authors", authors.cast("long"))),
        )
    )
    return F.when(F.size(found) > 0, F.concat_ws("; ", found)).otherwise("no significant changes")


def explain_full(df: DataFrame) -> DataFrame:
    """Header, reasons and metrics as one text."""
    why = reasons(F.col("volume_growth"), F.col("engagement_growth"), F.col("novelty"), F.col("velocity"), F.col("sources"), F.col("unique_authors"))
    head = F.format_string("%s | %s | score %.3f | confidence %.2f", "topic", "category", "score", "confidence")
    tail = F.format_string("volume %d (baseline %.1f), velocity %.1f%%, %d days active", F.col("volume").cast("long"), "baseline_volume", "velocity", F.col("days_active").cast("long"))
    warn = F.when(F.col("early_warning").isNotNull(), F.format_string("early warning %.3f", "early_warning"))
    return df.withColumns({"reasons": why, "explanation": F.concat_ws("\n", head, why, tail, warn)})


def explain_components(df: DataFrame) -> DataFrame:
    parts = [F.format_string(f"{k} %.3f", f"{k}_component") for k in WEIGHTS]
    return df.withColumn("components", F.concat_ws(", ", F.format_string("score %.3f", "score"), *parts))


def explain_comparison(df: DataFrame, base: str, new: str, margin: float = 0.1) -> DataFrame:
    gap = F.col(new) - F.col(base)
    pct = F.when(F.col(base) > 0, F.try_divide(gap * 100, F.col(base))).otherwise(0.0)
    verdict = F.when(gap > margin, "higher: growth, engagement or novelty").when(gap < -margin, "lower: volume without growth").otherwise("similar")
    return df.withColumns({"difference": gap, "difference_pct": pct, "verdict": verdict})
