"""Topic activity over time: buckets, growth, baselines, velocity. One shuffle by topic serves all window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: Column, grain: str = "day") -> Column:
    """Start of the hour or day; a week is named by the Sunday that ends it."""
    cut = F.date_trunc(grain, ts).cast("timestamp_ntz")
    return (cut + F.expr("interval 6 days")).cast("timestamp_ntz") if grain == "week" else cut


def assign(posts: DataFrame, topics: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Posts with their topic, and the topic's label; unassigned and unlabelled posts drop out. Spark chooses the join."""
    out = posts.join(topics.filter("topic_id is not null and topic_id <> -1"), "post_id")
    return out.join(labels, "topic_id") if labels is not None else out


def aggregate(posts: DataFrame, grain: str = "day", ts: str = "timestamp", topic: str = "topic_id", author: str = "author") -> DataFrame:
    """Volume, distinct authors and engagement for each observed (bucket, topic)."""
    have = set(posts.columns)

    def total(c: str) -> Column:
        return F.sum(F.coalesce(F.col(c), F.lit(0))) if c in have else F.lit(0)

    out = posts.groupBy(bucket(F.col(ts), grain).alias("bucket"), F.col(topic).alias("topic")).agg(
        F.count("*").alias("volume"),
        F.countDistinct(author).alias("unique_authors"),
        *[total(c).alias(c) for c in ("likes", "comments", "shares", "views")],
        *([F.sum("engagement").alias("engagement")] if "engagement" in have else []),
    )
    if "engagement" not in have:
        out = out.withColumn("engagement", F.col("likes") + F.col("comments") + F.col("shares") + 0.01 * F.col("views"))
    return out


def by_topic() -> Window:
    return Window.partitionBy("topic").orderBy("bucket")


def change(col: str) -> Column:
    """Percent change to the previous observed bucket; 0 where there is none or it was 0."""
    before = F.lag(col).over(by_topic())
    return F.coalesce(F.try_divide((F.col(col) - before) * 100.0, before), F.lit(0.0))


def growth(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "volume_growth": change("volume"),
            "engagement_growth": change("engagement"),
            "volume_growth_absolute": F.col("volume") - F.lag("volume").over(by_topic()),
        }
    )


def baseline(df: DataFrame, periods: int = 3, exclude_current: bool = False) -> DataFrame:
    """Rolling mean of volume, and how many buckets so far were active."""
    w = by_topic()
    span = w.rowsBetween(-periods, -1) if exclude_current else w.rowsBetween(1 - periods, 0)
    return df.withColumns(
        {
            "baseline_volume": F.avg("volume").over(span),
            "days_active": F.sum(F.when(F.col("volume") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "days_since_first": F.datediff(F.col("bucket"), F.min("bucket").over(Window.partitionBy("topic"))),
        }
    )


def velocity(df: DataFrame, periods: int = 3) -> DataFrame:
    w = by_topic()
    return df.withColumns(
        {
            "velocity": F.avg("volume_growth").over(w.rowsBetween(1 - periods, 0)),
            "acceleration": F.col("volume_growth") - F.lag("volume_growth").over(w),
        }
    )


def features(posts: DataFrame, grain: str = "day", **cols: str) -> DataFrame:
    return velocity(baseline(growth(aggregate(posts, grain, **cols))))


def fill_gaps(df: DataFrame, step: str = "interval 1 day") -> DataFrame:
    """Zero rows for buckets without posts between a topic's first and last."""
    span = df.groupBy("topic").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = span.select("topic", F.explode(F.sequence("a", "b", F.expr(step))).alias("bucket"))
    rest = [c for c in df.columns if c not in ("topic", "bucket")]
    return grid.join(df, ["topic", "bucket"], "left").na.fill(0, rest)


def latest(df: DataFrame) -> DataFrame:
    """The last row of each topic: max_by keeps partial aggregation, where a row number would sort."""
    row = F.max_by(F.struct(*df.columns), "bucket").alias("row")
    return df.groupBy(F.col("topic").alias("_t")).agg(row).select("row.*")


def timeline(df: DataFrame, topic: str) -> DataFrame:
    return df.filter(F.col("topic") == topic)


def runs(df: DataFrame, col: str = "volume_growth") -> DataFrame:
    """Lengths of the run of rises and of falls that ends at each row."""
    w = by_topic()
    n = F.row_number().over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_n", n)
    since = lambda stop: F.col("_n") - F.coalesce(F.max(F.when(stop, F.col("_n"))).over(upto), F.lit(0))
    return df.withColumns({"rises": since(F.col(col) <= 0), "falls": since(F.col(col) >= 0)}).drop("_n")
