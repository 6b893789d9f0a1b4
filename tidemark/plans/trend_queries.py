"""Queries on events: temporal features, scores, categories, forecasts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate, forecast, posts, temporal, trends
from tidemark.plans.registry import plan, table

COLS = {"ts": "ts", "topic": "event_type", "author": "user_id"}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("engagement", F.col("value"))


def feats(spark: SparkSession, sf: str, grain: str = "day") -> DataFrame:
    return temporal.features(events(spark, sf), grain, **COLS)


def when(c: str = "bucket") -> F.Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH").alias("bucket")


def r(c: str, name: str | None = None) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


# SQL pieces ---------------------------------------------------------------------------------------------------------

WEEK = "date_trunc('week', ts) + interval 6 days"


def agg(grain: str) -> str:
    b = WEEK if grain == "week" else f"date_trunc('{grain}', ts)"
    return f"agg as (select {b} as bucket, event_type as topic, count(*) as volume, count(distinct user_id) as unique_authors, sum(value) as engagement from events group by 1, 2)"


FEATS = """
g as (select *, coalesce((volume - lag(volume) over w) * 100.0 / nullif(lag(volume) over w, 0), 0) as volume_growth,
  coalesce((engagement - lag(engagement) over w) * 100.0 / nullif(lag(engagement) over w, 0), 0) as engagement_growth,
  volume - lag(volume) over w as volume_growth_absolute,
  avg(volume) over (partition by topic order by bucket rows between 2 preceding and current row) as baseline_volume,
  count(*) filter (volume > 0) over (partition by topic order by bucket rows between unbounded preceding and current row) as days_active,
  date_diff('day', min(bucket) over (partition by topic), bucket) as days_since_first
  from agg window w as (partition by topic order by bucket)),
f as (select *, avg(volume_growth) over (partition by topic order by bucket rows between 2 preceding and current row) as velocity,
  volume_growth - lag(volume_growth) over (partition by topic order by bucket) as acceleration,
  row_number() over (partition by topic order by bucket) as n from g),
q as (select *, n - coalesce(max(case when volume_growth <= 0 then n end) over u, 0) as rises, n - coalesce(max(case when volume_growth >= 0 then n end) over u, 0) as falls
  from f window u as (partition by topic order by bucket rows between unbounded preceding and current row))"""
LAST = "last as (select * from q qualify row_number() over (partition by topic order by bucket desc) = 1)"
GROWTH_NORM = "case when volume_growth <= -100 then 0.0 when volume_growth < 0 then 0.5 + volume_growth / 200 when volume_growth = 0 then 0.5 else 0.5 + least(volume_growth / 1000, 0.5) end"
NORM = f"""norm as (select *, least(volume * 1.0 / greatest(max(volume) over (), 1), 1.0) as volume_norm, least(engagement / greatest(max(engagement) over (), 1), 1.0) as engagement_norm,
  {GROWTH_NORM} as growth_norm, exp(-days_active / 7.0) as novelty from last)"""
SCORED = "scored as (select *, greatest(0, least(1, 0.2 * volume_norm + 0.4 * growth_norm + 0.3 * engagement_norm + 0.1 * novelty)) as score from norm)"
CATEGORY = "case when volume_growth / 100 >= 2 then 'VIRAL' when baseline_volume < 10 and volume_growth / 100 >= 0.5 then 'EMERGING' when volume_growth > 0 then 'RISING' when abs(volume_growth / 100) <= 0.1 then 'STABLE' else 'DECLINING' end"
CONFIDENCE = "case when volume_growth / 100 >= 2 then least(1.0, volume_growth / 400) when baseline_volume < 10 and volume_growth / 100 >= 0.5 then 0.8 when volume_growth > 0 then case when rises >= 2 then 0.7 else 0.5 end when abs(volume_growth / 100) <= 0.1 then 0.7 else case when falls >= 2 then 0.8 else 0.6 end end"
AT = "strftime(bucket, '%Y-%m-%d %H') as bucket"


def day(tail: str, grain: str = "day", *more: str) -> str:
    return f"with {agg(grain)}, " + ", ".join([FEATS, *more]) + " " + tail


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return trends.score(trends.normalised(temporal.latest(temporal.runs(feats(spark, sf)))))


@plan(
    day(
        f"""select topic, volume, unique_authors, round(engagement, 6) as engagement, round(volume_growth, 6) as volume_growth, round(baseline_volume, 6) as baseline_volume, round(velocity, 6) as velocity,
    round(acceleration, 6) as acceleration, days_active, round(score, 6) as score, {CATEGORY} as category, round({CONFIDENCE}, 6) as confidence, row_number() over (order by score desc, topic) as "rank" from scored""",
        "day", LAST, NORM, SCORED,
    )
)
def trend_flagship(spark, sf):
    """Latest day of each topic: features, composite score, category, rank."""
    out = trends.ranked(trends.classify(scored(spark, sf)))
    return out.select("topic", "volume", "unique_authors", r("engagement"), r("volume_growth"), r("baseline_volume"), r("velocity"), r("acceleration"), F.col("days_active").cast("long").alias("days_active"), r("score"), "category", r("confidence"), "rank")


def temporal_query(grain: str):
    def query(spark, sf):
        out = temporal.aggregate(events(spark, sf), grain, **COLS)
        return out.select(when(), "topic", "volume", "unique_authors", r("engagement"))

    query.__name__ = f"temporal_{grain}"
    return plan(f"with {agg(grain)} select {AT}, topic, volume, unique_authors, round(engagement, 6) as engagement from agg")(query)


for _grain in ("day", "hour", "week"):
    temporal_query(_grain)


@plan(day(f"select {AT}, topic, round(volume_growth, 6) as volume_growth, round(engagement_growth, 6) as engagement_growth, cast(volume_growth_absolute as bigint) as volume_growth_absolute from f"))
def growth_rates(spark, sf):
    return feats(spark, sf).select(when(), "topic", r("volume_growth"), r("engagement_growth"), "volume_growth_absolute")


@plan(day(f"select {AT}, topic, round(baseline_volume, 6) as baseline_volume, days_active, cast(days_since_first as bigint) as days_since_first from f"))
def baseline_days_active(spark, sf):
    return feats(spark, sf).select(when(), "topic", r("baseline_volume"), F.col("days_active").cast("long").alias("days_active"), F.col("days_since_first").cast("long").alias("days_since_first"))


@plan(day(f"select {AT}, topic, round(velocity, 6) as velocity, round(acceleration, 6) as acceleration from f"))
def velocity_acceleration(spark, sf):
    return feats(spark, sf).select(when(), "topic", r("velocity"), r("acceleration"))


@plan(day(f"select {AT}, topic, volume, round(engagement, 6) as engagement, round(velocity, 6) as velocity from last", "day", LAST))
def latest_metrics(spark, sf):
    return temporal.latest(feats(spark, sf)).select(when(), "topic", "volume", r("engagement"), r("velocity"))


@plan(day(f"select {AT}, topic, rises, falls from q"))
def consecutive_runs(spark, sf):
    return temporal.runs(feats(spark, sf)).select(when(), "topic", F.col("rises").cast("long").alias("rises"), F.col("falls").cast("long").alias("falls"))


@plan(day(f"select {AT}, volume from f where topic = 'click'"))
def topic_timeline(spark, sf):
    return temporal.timeline(feats(spark, sf), "click").select(when(), "volume")


@plan(
    f"with {agg('day')}, span as (select topic, min(bucket) a, max(bucket) b from agg where topic <> 'view' or day(bucket) % 3 <> 0 group by 1), grid as (select topic, unnest(generate_series(a, b, interval 1 day)) as bucket from span) "
    "select strftime(grid.bucket, '%Y-%m-%d %H') as bucket, grid.topic, coalesce(volume, 0) as volume from grid left join (select * from agg where topic <> 'view' or day(bucket) % 3 <> 0) x on x.topic = grid.topic and x.bucket = grid.bucket"
)
def filled_gaps(spark, sf):
    have = temporal.aggregate(events(spark, sf), "day", **COLS).filter("topic <> 'view' or day(bucket) % 3 <> 0")
    return temporal.fill_gaps(have).select(when(), "topic", "volume")


@plan(
    day(
        """select topic, round(0.2 * volume_norm, 6) as volume_component, round(0.4 * growth_norm, 6) as growth_component, round(0.3 * engagement_norm, 6) as engagement_component, round(0.1 * novelty, 6) as novelty_component,
    round(score, 6) as score from scored""",
        "day", LAST, NORM, SCORED,
    )
)
def trend_score(spark, sf):
    return scored(spark, sf).select("topic", *[r(f"{k}_component") for k in trends.WEIGHTS], r("score"))


@plan(day("select topic, round(volume_norm, 6) as frequency_score, round(0.5 * volume_norm + 0.5 * growth_norm, 6) as volume_growth_score from scored", "day", LAST, NORM, SCORED))
def trend_baselines(spark, sf):
    return trends.volume_growth_score(trends.frequency_score(scored(spark, sf))).select("topic", r("frequency_score"), r("volume_growth_score"))


@plan(
    day(
        f"select {AT}, topic, round(case when max(volume) over d = min(volume) over d then 0.5 else (volume - min(volume) over d) * 1.0 / (max(volume) over d - min(volume) over d) end, 6) as volume_scaled from f window d as (partition by bucket)"
    )
)
def minmax_by_day(spark, sf):
    from pyspark.sql import Window

    return feats(spark, sf).withColumn("volume_scaled", trends.min_max("volume", Window.partitionBy("bucket"))).select(when(), "topic", r("volume_scaled"))


@plan(day(f"select {AT}, topic, {CATEGORY} as category, round({CONFIDENCE}, 6) as confidence from q", "hour"))
def trend_category_hourly(spark, sf):
    return trends.classify(temporal.runs(feats(spark, sf, "hour"))).select(when(), "topic", "category", r("confidence"))


@plan(
    day(
        f"""select {AT}, topic, round(least(least(volume_growth / 300, 0.5) + case when baseline_volume > 0 then least((volume - baseline_volume) / baseline_volume / 5, 0.3) else 0.3 end + least(volume / 100.0, 0.2), 1.0), 6) as early_warning
    from q where {CATEGORY} = 'EMERGING'""",
        "hour",
    )
)
def early_warning(spark, sf):
    out = trends.early_warning(trends.classify(temporal.runs(feats(spark, sf, "hour"))))
    return out.filter("category = 'EMERGING'").select(when(), "topic", r("early_warning"))


@plan(day(f"select {CATEGORY} as category, count(*) as n from q where {CATEGORY} in ('EMERGING', 'VIRAL', 'RISING') group by 1", "hour"))
def emerging_counts(spark, sf):
    return trends.emerging(trends.classify(temporal.runs(feats(spark, sf, "hour")))).groupBy("category").agg(F.count("*").alias("n"))


REASONS = """concat_ws('; ', case when volume_growth > 50 then 'volume up ' || printf('%.0f', volume_growth) || '%' when volume_growth < -30 then 'volume down ' || printf('%.0f', -volume_growth) || '%' end,
 case when engagement_growth > 50 then 'engagement up ' || printf('%.0f', engagement_growth) || '%' end, case when novelty > 0.7 then 'new topic (' || printf('%.2f', novelty) || ')' end,
 case when velocity > 20 then 'velocity ' || printf('%.1f', velocity) || '%' end, case when unique_authors > 20 then unique_authors || ' authors' end)"""


@plan(day(f"select topic, coalesce(nullif({REASONS}, ''), 'no significant changes') as reasons from norm", "day", LAST, NORM))
def trend_explain(spark, sf):
    df = scored(spark, sf)
    why = trends.reasons(F.col("volume_growth"), F.col("engagement_growth"), F.col("novelty"), F.col("velocity"), F.lit(0), F.col("unique_authors"))
    return df.select("topic", why.alias("reasons"))


@plan(None)
def trend_explain_full(spark, sf):
    df = trends.early_warning(trends.classify(scored(spark, sf))).withColumn("sources", F.lit(1))
    return trends.explain_components(trends.explain_full(trends.explain_quick(df).withColumnRenamed("explanation", "quick"))).select("topic", "quick", "explanation", "components", "criteria")


@plan(
    day(
        """select topic, round((score - volume_norm), 6) as difference, round(case when volume_norm > 0 then (score - volume_norm) * 100 / volume_norm else 0 end, 6) as difference_pct,
    case when score - volume_norm > 0.1 then 'higher: growth, engagement or novelty' when score - volume_norm < -0.1 then 'lower: volume without growth' else 'similar' end as verdict from scored""",
        "day", LAST, NORM, SCORED,
    )
)
def trend_comparison(spark, sf):
    out = trends.explain_comparison(trends.frequency_score(scored(spark, sf)), "frequency_score", "score")
    return out.select("topic", r("difference"), r("difference_pct"), "verdict")


GRID = """grid(config, a, b, c, d) as (values ('full', .2, .4, .3, .1), ('without_volume', 0, .4/.8, .3/.8, .1/.8), ('without_growth', .2/.6, 0, .3/.6, .1/.6), ('without_engagement', .2/.7, .4/.7, 0, .1/.7),
 ('without_novelty', .2/.9, .4/.9, .3/.9, 0), ('only_volume', 1, 0, 0, 0), ('only_growth', 0, 1, 0, 0), ('only_engagement', 0, 0, 1, 0), ('only_novelty', 0, 0, 0, 1))"""
ABLATED = "ablated as (select config, topic, greatest(0, least(1, a * volume_norm + b * growth_norm + c * engagement_norm + d * novelty)) as score from norm cross join grid)"


@plan(day("select config, topic, round(score, 6) as score from ablated", "day", LAST, NORM, GRID, ABLATED))
def ablation_grid(spark, sf):
    return trends.ablate(scored(spark, sf), trends.ablation_grid(spark)).select("config", "topic", r("score"))


@plan(
    day(
        """, m as (select config, avg(score) as s from ablated group by 1) select substr(config, 9) as component, round((select s from m where config = 'full') - s, 6) as importance from m where config like 'without_%'""",
        "day", LAST, NORM, GRID, ABLATED,
    ).replace(" ,  m as", ", m as").replace(" , m as", ", m as")
)
def ablation_importance(spark, sf):
    per = trends.ablate(scored(spark, sf), trends.ablation_grid(spark)).groupBy("config").agg(F.avg("score").alias("m"))
    return trends.importance(per, "m").select("component", r("importance"))


@plan("select topic, total from (select event_type as topic, count(*) as total from events group by 1) order by total desc, topic limit 1")
def top_topic(spark, sf):
    return forecast.top_topic(temporal.aggregate(events(spark, sf), "day", **COLS))


@plan(
    "select count(*) as posts, count(distinct event_type) as topics, count(distinct user_id) as authors, strftime(min(ts), '%Y-%m-%d %H') as first_at, strftime(max(ts), '%Y-%m-%d %H') as last_at, string_agg(distinct event_type, ',' order by event_type) as names from events"
)
def batch_stats(spark, sf):
    return events(spark, sf).agg(
        F.count("*").alias("posts"), F.countDistinct("event_type").alias("topics"), F.countDistinct("user_id").alias("authors"), F.date_format(F.min("ts"), "yyyy-MM-dd HH").alias("first_at"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH").alias("last_at"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("names"),
    )


@plan("select event_id, least(row_number() over (partition by user_id order by ts, event_id) / 5.0, 1.0) as frequency from events")
def author_frequency(spark, sf):
    return posts.author_frequency(events(spark, sf), "user_id", ["ts", "event_id"]).select("event_id", "frequency")


# Joins and engagement -----------------------------------------------------------------------------------------------


@plan(
    "select l.label as topic, count(*) as volume from events e join (values ('click', 1, 'navigation'), ('view', 1, 'navigation'), ('purchase', 2, 'commerce'), ('signup', -1, 'noise')) l(event_type, topic_id, label) using (event_type) where l.topic_id <> -1 group by 1"
)
def topic_assignment(spark, sf):
    e = events(spark, sf).withColumn("post_id", F.col("event_id"))
    ids = F.when(F.col("event_type").isin("click", "view"), 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", -1)
    topics = e.select("post_id", ids.alias("topic_id"))
    labels = spark.createDataFrame([(1, "navigation"), (2, "commerce")], "topic_id int, label string")
    return temporal.assign(e, topics, labels).groupBy(F.col("label").alias("topic")).agg(F.count("*").alias("volume"))


@plan(
    "with e as (select event_id, event_id % 50 as likes, event_id % 7 as comments, event_id % 5 as shares, event_id * 3 as views, event_id % 3 as retweets, event_id % 2 as upvotes from events) "
    "select event_id, likes + comments + shares + views + retweets + upvotes as total, round(likes + 2.0 * comments + 3 * shares + 2.5 * retweets + upvotes + 0.01 * views, 6) as weighted, round(likes + comments + shares + 0.01 * views, 6) as temporal from e"
)
def engagement_scores(spark, sf):
    from tidemark.sources import posts as P

    i = F.col("event_id")
    e = F.struct((i % 50).alias("likes"), (i % 7).alias("comments"), (i % 5).alias("shares"), (i * 3).alias("views"), (i % 3).alias("retweets"), (i % 2).alias("upvotes"), F.lit(0).cast("long").alias("downvotes"))
    df = events(spark, sf).select("event_id", e.alias("engagement"))
    g = lambda c: F.col(f"engagement.{c}")
    return df.select("event_id", P.total_engagement().alias("total"), F.round(P.engagement_score(), 6).alias("weighted"), F.round(g("likes") + g("comments") + g("shares") + 0.01 * g("views"), 6).alias("temporal"))


# Forecasts ----------------------------------------------------------------------------------------------------------

SERIES = "series as (select o_orderpriority as series, date_trunc('week', o_orderdate) as ts, count(*) as value from orders group by 1, 2)"


def series(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("week", "o_orderdate").alias("ts")).agg(F.count("*").alias("value"))


STEPS = "unnest(generate_series(1, 3)) as step"


@plan(f"with {SERIES}, l as (select series, max_by(value, ts) as forecast from series group by 1) select series, forecast, {STEPS} from l")
def naive_forecast(spark, sf):
    return forecast.naive(series(spark, sf)).select("series", "forecast", F.col("step").cast("long").alias("step"))


@plan(
    f"with {SERIES}, t as (select series, avg(value) m, stddev_pop(value) s from (select * from series qualify row_number() over (partition by series order by ts desc) <= 7) group by 1) select series, {STEPS}, round(m, 6) as forecast, round(m - s, 6) as lower, round(m + s, 6) as upper from t"
)
def moving_average_forecast(spark, sf):
    return forecast.moving_average(series(spark, sf)).select("series", F.col("step").cast("long").alias("step"), r("forecast"), r("lower"), r("upper"))


@plan(
    f"with {SERIES}, n as (select *, row_number() over (partition by series order by ts) - 1 as i from series), t as (select series, regr_slope(value, i) b, regr_intercept(value, i) a, count(*) c from n group by 1), x as (select *, {STEPS} from t) select series, step, round(a + b * (c + step - 1), 6) as forecast from x"
)
def ols_forecast(spark, sf):
    return forecast.linear(series(spark, sf)).select("series", F.col("step").cast("long").alias("step"), r("forecast"))


ONE = f"{SERIES}, one as (select series, ts, value as actual, lag(value) over w as naive, avg(value) over (partition by series order by ts rows between 7 preceding and 1 preceding) as moving_average from series window w as (partition by series order by ts)), o as (select * from one where naive is not null)"


@plan(
    f"with {ONE}, d as (select *, sign(actual - lag(actual) over w) = sign(naive - lag(naive) over w) as same from o window w as (partition by series order by ts)) "
    "select series, round(avg(abs(actual - naive)), 6) as mae, round(sqrt(avg((actual - naive) * (actual - naive))), 6) as rmse, round(avg(case when actual <> 0 then abs((actual - naive) * 1.0 / actual) end) * 100, 6) as mape, "
    "round(avg(case when same is null then null when same then 1.0 else 0.0 end) * 100, 6) as direction, round(1 - sum((actual - naive) * (actual - naive)) / nullif(var_pop(actual) * count(*), 0), 6) as r2 from d group by 1"
)
def forecast_metrics(spark, sf):
    pairs = forecast.one_step(series(spark, sf)).select("series", "ts", "actual", F.col("naive").alias("forecast"))
    out = forecast.errors(pairs.withColumn("actual", F.col("actual").cast("double")), "series")
    return out.select("series", r("mae"), r("rmse"), r("mape"), r("direction"), r("r2"))


@plan(
    f"with {ONE}, e as (select 'naive' as method, avg(abs(actual - naive)) as mae from o union all select 'moving_average', avg(abs(actual - moving_average)) from o) select min_by(method, mae) as method, round(min(mae), 6) as mae from e"
)
def best_forecaster(spark, sf):
    one = forecast.one_step(series(spark, sf))
    rows = [one.agg(F.avg(F.abs(F.col("actual") - F.col(m))).alias("mae")).withColumn("method", F.lit(m)) for m in ("naive", "moving_average")]
    return forecast.best_method(rows[0].unionByName(rows[1]), "mae").select("method", r("mae"))


@plan(
    f"with {SERIES} select series, strftime(ts, '%Y-%m-%d %H') as ts, coalesce(lag(value, 1) over w, first_value(value) over w) as lag_1, coalesce(lag(value, 7) over w, first_value(value) over w) as lag_7, "
    "round(avg(value) over (partition by series order by ts rows between 2 preceding and current row), 6) as rolling_mean_3, round(case when row_number() over w > 2 then stddev_pop(value) over (partition by series order by ts rows between 2 preceding and current row) else 0 end, 6) as rolling_std_3, "
    "round(coalesce((value - lag(value) over w) / (lag(value) over w + 1e-6), 0), 6) as growth_rate, round((row_number() over w - 1) * 1.0 / count(*) over (partition by series), 6) as time_index from series window w as (partition by series order by ts)"
)
def lag_features(spark, sf):
    out = forecast.lag_features(series(spark, sf))
    return out.select("series", F.date_format("ts", "yyyy-MM-dd HH").alias("ts"), "lag_1", "lag_7", r("rolling_mean_3"), r("rolling_std_3"), r("growth_rate"), r("time_index"))


@plan(None)
def gbt_forecast(spark, sf):
    return forecast.tree_forecast(series(spark, sf))[0]


@plan(None)
def forest_importance(spark, sf):
    return forecast.tree_forecast(series(spark, sf), horizon=1, method="forest")[1]


@plan(
    "with e as (select epoch_us(min(ts)) a, epoch_us(max(ts)) b from events), x as (select (epoch_us(ts) - a) * 1.0 / greatest(b - a, 1) as place from events cross join e) select case when place < 0.7 then 'train' when place < 0.7 + 0.15 then 'validation' else 'test' end as split, count(*) as n from x group by 1"
)
def temporal_split(spark, sf):
    return forecast.time_split(events(spark, sf), "ts").groupBy("split").agg(F.count("*").alias("n"))


@plan(
    "select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) as ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) as ci_high, min(value) as min, max(value) as max from events group by 1"
)
def summary_report(spark, sf):
    return evaluate.summary(events(spark, sf), "value", "event_type").select("event_type", "n", r("mean"), r("std"), r("ci_low"), r("ci_high"), "min", "max")
