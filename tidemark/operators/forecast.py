"""Forecasts of equally spaced series and their errors. Series are rows (series, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def naive(series: DataFrame, horizon: int = 3) -> DataFrame:
    """The last value, repeated."""
    return steps(series.groupBy("series").agg(F.max_by("value", "ts").alias("forecast")), horizon)


def moving_average(series: DataFrame, horizon: int = 3, window: int = 7) -> DataFrame:
    """Mean of the last values, with a band of one population deviation."""
    last = Window.partitionBy("series").orderBy(F.desc("ts"))
    tail = series.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= window)
    out = tail.groupBy("series").agg(F.avg("value").alias("forecast"), F.stddev_pop("value").alias("_sd"))
    return steps(out, horizon).select("series", "step", "forecast", (F.col("forecast") - F.col("_sd")).alias("lower"), (F.col("forecast") + F.col("_sd")).alias("upper"))


def numbered(series: DataFrame) -> DataFrame:
    return series.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("ts")) - 1)


def linear(series: DataFrame, horizon: int = 3) -> DataFrame:
    """Least-squares line over 0..n-1, continued; a single point repeats."""
    fit = numbered(series).groupBy("series").agg(F.regr_slope("value", "i").alias("b"), F.regr_intercept("value", "i").alias("a"), F.count("*").alias("n"), F.first("value").alias("v"))
    line = F.coalesce(F.col("a") + F.col("b") * (F.col("n") + F.col("step") - 1), F.col("v").cast("double"))
    return steps(fit, horizon).select("series", "step", line.alias("forecast"))


def lag_features(series: DataFrame, lags: int = 7) -> DataFrame:
    """Lags (filled with the first value), trailing mean and deviation of three, growth, place in the series, next value."""
    w = Window.partitionBy("series").orderBy("ts")
    first = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    three = w.rowsBetween(-2, 0)
    out = {f"lag_{k}": F.coalesce(F.lag("value", k).over(w), first) for k in range(1, lags + 1)}
    before = F.lag("value").over(w)
    out |= {
        "rolling_mean_3": F.avg("value").over(three),
        "rolling_std_3": F.when(F.row_number().over(w) > 2, F.stddev_pop("value").over(three)).otherwise(0.0),
        "growth_rate": F.coalesce((F.col("value") - before) / (before + 1e-6), F.lit(0.0)),
        "time_index": (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("series")),
        "target": F.lead("value").over(w),
    }
    return series.withColumns(out)


def features_of(lags: int) -> list[str]:
    return [*[f"lag_{k}" for k in range(1, lags + 1)], "rolling_mean_3", "rolling_std_3", "growth_rate", "time_index"]


def tree_forecast(series: DataFrame, horizon: int = 3, lags: int = 7, method: str = "gbt", seed: int = 42):
    """(forecasts, importances): trees over lag features of all series with enough points, each step fed with the one before.

    The band is 1.96 deviations of the training residuals. One job for each step; series stay distributed.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    spark = series.sparkSession
    enough = series.groupBy("series").agg(F.count("*").alias("n")).filter(F.col("n") >= lags + 2).select("series")
    series = series.join(enough, "series", "left_semi").select("series", "ts", F.col("value").cast("double").alias("value"))
    cols = features_of(lags)
    build = VectorAssembler(inputCols=cols, outputCol="features")
    train = build.transform(lag_features(series, lags).filter("target is not null"))
    if method == "gbt":
        learner = GBTRegressor(labelCol="target", maxIter=20, maxDepth=5, stepSize=0.1, seed=seed)
    else:
        learner = RandomForestRegressor(labelCol="target", numTrees=100, maxDepth=10, seed=seed)
    model = learner.fit(train)
    sd = model.transform(train).agg(F.stddev_pop(F.col("target") - F.col("prediction"))).first()[0] or 0.0
    last = Window.partitionBy("series").orderBy(F.desc("ts"))
    current, out = series, None
    for step in range(1, horizon + 1):
        tail = lag_features(current, lags).withColumn("_r", F.row_number().over(last)).filter("_r = 1")
        guess = model.transform(build.transform(tail)).select("series", "ts", F.lit(step).alias("step"), F.col("prediction").alias("forecast"))
        out = guess if out is None else out.unionByName(guess)
        nxt = guess.select("series", (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.col("forecast").alias("value"))
        current = current.unionByName(nxt)
    out = out.select("series", "step", "forecast", (F.col("forecast") - 1.96 * sd).alias("lower"), (F.col("forecast") + 1.96 * sd).alias("upper"))
    importances = spark.createDataFrame(list(zip(cols, map(float, model.featureImportances.toArray()), strict=True)), "feature string, importance double")
    return out, importances


def errors(pairs: DataFrame, *keys: str) -> DataFrame:
    """mae, rmse, mape (zeros left out), direction accuracy and r2 of rows (ts, actual, forecast)."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("ts")
    turn = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    rows = pairs.withColumn("_same", (turn("actual") == turn("forecast")).cast("double"))
    gap = F.col("actual") - F.col("forecast")
    grouped = rows.groupBy(*keys) if keys else rows.groupBy()
    return grouped.agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (F.avg(F.when(F.col("actual") != 0, F.abs(gap / F.col("actual")))) * 100).alias("mape"),
        (F.avg("_same") * 100).alias("direction"),
        (1 - F.try_divide(F.sum(gap * gap), F.regr_syy("actual", F.lit(1.0)))).alias("r2"),
    )


def best_method(scores: DataFrame, metric: str, high: bool = False) -> DataFrame:
    pick = F.max_by if high else F.min_by
    return scores.agg(pick("method", metric).alias("method"), (F.max(metric) if high else F.min(metric)).alias(metric))


def top_topic(activity: DataFrame, topic: str = "topic", volume: str = "volume") -> DataFrame:
    return activity.groupBy(topic).agg(F.sum(volume).alias("total")).orderBy(F.desc("total"), topic).limit(1)


def one_step(series: DataFrame, window: int = 7) -> DataFrame:
    """Walk-forward forecasts of each next value: naive and moving average."""
    w = Window.partitionBy("series").orderBy("ts")
    mean: Column = F.avg("value").over(w.rowsBetween(-window, -1))
    return series.select("series", "ts", F.col("value").alias("actual"), F.lag("value").over(w).alias("naive"), mean.alias("moving_average")).filter("naive is not null")


def time_split(rows: DataFrame, ts: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """split by the share of the rows' time range that has passed, from two numbers, not a sort of everything."""
    ends = rows.agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("_a"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("_b"))
    at = (F.unix_micros(F.col(ts).cast("timestamp")) - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1))
    name = F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")
    return rows.crossJoin(F.broadcast(ends)).withColumn("split", name).drop("_a", "_b")
