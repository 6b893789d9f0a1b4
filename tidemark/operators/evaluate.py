"""Evaluation: classification, trend detection, ranking, agreement, topic quality, experiment log."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import folder


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Confusion counts and accuracy, precision, recall, f1, fpr of 0/1 columns; 0 where a denominator is."""
    t, p = F.col(actual) == 1, F.col(predicted) == 1
    n = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns(
        {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)}
    )


def per_class(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1, support of each class."""
    a = pairs.groupBy(F.col(actual).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(actual) == F.col(predicted)).alias("hits"))
    b = pairs.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("claimed"))
    out = a.join(b, "class", "full").na.fill(0, ["support", "hits", "claimed"])
    p, r = ratio(F.col("hits"), F.col("claimed")), ratio(F.col("hits"), F.col("support"))
    return out.select("class", "support", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")).alias("f1"))


def macro_f1(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return per_class(pairs, actual, predicted).agg(F.avg("f1").alias("macro_f1"))


def trend_detection(pairs: DataFrame) -> DataFrame:
    """pairs: actual, predicted, t_actual, t_predicted. Classification with early detections among the true positives."""
    base = classification(pairs)
    both = (F.col("actual") == 1) & (F.col("predicted") == 1)
    early = pairs.agg(
        ratio(F.count_if(both & (F.col("t_predicted") <= F.col("t_actual"))), F.count_if(both)).alias("early_rate"),
        F.avg(F.when(both, (F.unix_micros(F.col("t_actual").cast("timestamp")) - F.unix_micros(F.col("t_predicted").cast("timestamp"))) / 3.6e9)).alias("lead_hours"),
    )
    return base.crossJoin(early)


def ndcg(rows: DataFrame, k: int = 10, by: list[str] | None = None, score: str = "score", relevance: str = "relevance", tie: str = "id") -> DataFrame:
    """NDCG with gain 2^rel - 1 over the k best of each group, ties by id; 0 where the ideal is."""
    keys = by or []
    part = Window.partitionBy(*(keys or [F.lit(1)]))
    gain = (F.pow(F.lit(2.0), F.col(relevance)) - 1) / F.log2(F.col("_r") + 1.0)
    rows = rows.withColumns({"_p": F.row_number().over(part.orderBy(F.desc(score), tie)), "_i": F.row_number().over(part.orderBy(F.desc(relevance), tie))})
    rows = rows.filter((F.col("_p") <= k) | (F.col("_i") <= k))
    own = F.sum(F.when(F.col("_p") <= k, F.expr(f"(power(2D, {relevance}) - 1) / log2(_p + 1D)")))
    best = F.sum(F.when(F.col("_i") <= k, F.expr(f"(power(2D, {relevance}) - 1) / log2(_i + 1D)")))
    assert gain is not None
    return rows.groupBy(*keys).agg(ratio(own, best).alias("ndcg"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their rank from 1 in this order: ranges are sorted each for itself, written, and added up by their sizes."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, "ranked")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()).write.parquet(path)
    back = spark.read.parquet(path).withColumns({"_p": F.shiftright("_i", 33), "_i": F.col("_i").bitwiseAND((1 << 33) - 1)})
    sizes = back.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    return back.join(F.broadcast(starts), "_p").withColumn(name, F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def spearman(rows: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """Correlation of ordinal ranks (no averaging), ties by the tie column."""
    plain = rows.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(tie).alias("t"))
    return numbered(numbered(plain, ["a", "t"], "ra"), ["b", "t"], "rb").agg(F.corr("ra", "rb").alias("spearman"))


def concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs that x and y order alike less those they order unlike. Two ranks of x part at one highest bit: bit by bit, those with it are counted against those without."""
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    width, total = int(y.max(initial=0)) + 1, 0
    for bit in range(int(x.max(initial=0)).bit_length()):
        key = (x >> (bit + 1)) * width + y
        upper = (x >> bit) & 1 == 1
        low = np.sort(key[~upper])
        first = key[upper] - y[upper]
        less, most = np.searchsorted(low, key[upper], "left"), np.searchsorted(low, key[upper], "right")
        total += int((less - np.searchsorted(low, first, "left")).sum() - (np.searchsorted(low, first + width, "left") - most).sum())
    return total


def kendall(rows: DataFrame, a: str, b: str, key: str, block: int = 100_000) -> DataFrame:
    """Kendall's tau (a) over all pairs, exact, without making them.

    Both columns are cut at quantiles into ranges of about `block` rows (a thousand at most), each cut value a range of its own, so
    that no frequent value fills one. Pairs apart in both ranges follow from the counts of range pairs; those that share a range
    are counted within it by sorting. Pairs within one value of either column count nothing. Rows without either value are left out.
    """
    plain = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    n = plain.count()
    spark = rows.sparkSession
    if n < 2:
        return spark.createDataFrame([(0.0,)], "tau double")
    parts = max(1, min(1000, n // block))
    cuts = [sorted(set(c)) for c in plain.approxQuantile(["a", "b"], [i / parts for i in range(1, parts)], 1 / (4 * parts))] if parts > 1 else [[], []]

    def placer(cut: list[float]):
        def place(value: pd.Series) -> pd.Series:  # even: between cuts, odd: on one
            return pd.Series((np.searchsorted(cut, value, "left") + np.searchsorted(cut, value, "right")).astype(np.int32))

        return F.pandas_udf(place, "int")

    marked = plain.withColumns({"i": placer(cuts[0])("a"), "j": placer(cuts[1])("b")})
    grid = marked.groupBy("i", "j").agg(F.count("*").alias("n")).toArrow()  # ranges by ranges
    apart = np.zeros((2 * parts + 1, 2 * parts + 1))
    apart[grid["i"].to_numpy(), grid["j"].to_numpy()] = grid["n"].to_numpy()
    below = apart.cumsum(0).cumsum(1)
    left = np.zeros_like(apart)
    left[1:, 1:] = below[:-1, :-1]  # smaller in both
    right = np.zeros_like(apart)
    right[1:, :] = below[:-1, -1:] - below[:-1, :]  # smaller in a, larger in b
    total = float((apart * (left - right)).sum())

    def within(x: str, y: str):
        def work(table: pa.Table) -> pa.Table:
            return pa.table({"s": pa.array([concordance(table[x].to_numpy(), table[y].to_numpy())], pa.int64())})

        return work

    same = marked.filter("i % 2 = 0").groupBy("i").applyInArrow(within("a", "b"), "s long")
    other = marked.filter("j % 2 = 0").groupBy("j").applyInArrow(within("i", "b"), "s long")
    near = same.union(other).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    return near.select(((F.col("s") + F.lit(total)) / (n * (n - 1) / 2)).alias("tau"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns, from the contingency table."""
    table = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    agree = table.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    rows, cols = table.groupBy("x").agg(F.sum("n").alias("r")), table.groupBy("y").agg(F.sum("n").alias("c"))
    chance = rows.join(cols, rows.x == cols.y).agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return agree.crossJoin(chance).select(po.alias("observed"), pe.alias("expected"), ratio(po - pe, 1 - pe).alias("kappa"))


def precision_at_k(ranked: DataFrame, k: int, score: str, relevant: str, tie: str) -> DataFrame:
    """precision, recall and f1 of the k best against all relevant (1) rows."""
    top = ranked.orderBy(F.desc(score), tie).limit(k).agg(F.count("*").alias("k"), F.coalesce(F.sum(relevant), F.lit(0)).alias("hits"))
    every = ranked.agg(F.coalesce(F.sum(relevant), F.lit(0)).alias("relevant"))
    p, r = ratio(F.col("hits"), F.col("k")), ratio(F.col("hits"), F.col("relevant"))
    return top.crossJoin(every).select("k", "hits", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def unique_word_ratio(topics: DataFrame, topic: str = "topic", words: str = "words") -> DataFrame:
    """Distinct words over words of each topic; 0 under two words. topics: (topic, words array)."""
    n = F.size(words)
    return topics.select(topic, F.when(n < 2, 0.0).otherwise(F.size(F.array_distinct(words)) / n).alias("coherence"))


def topic_diversity(topics: DataFrame, top: int = 10, topic: str = "topic", words: str = "words") -> DataFrame:
    """Distinct over all of the topics' first words; 1 with fewer than two topics."""
    rows = topics.select(topic, F.explode_outer(F.slice(words, 1, top)).alias("w"))
    n = rows.agg(F.countDistinct(topic).alias("t"), F.countDistinct("w").alias("u"), F.count("w").alias("n"))
    return n.select(F.when(F.col("t") < 2, 1.0).otherwise(ratio(F.col("u"), F.col("n"))).alias("diversity"))


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, deviation, 95 % interval, extremes."""
    half = 1.96 * F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.sqrt(F.count(value))
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        (F.avg(value) - half).alias("ci_low"), (F.avg(value) + half).alias("ci_high"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


def paired_t(rows: DataFrame, a: str, b: str, comparisons: int = 1) -> DataFrame:
    """t statistic, Cohen's d and the corrected significance level of paired differences."""
    d = F.col(a) - F.col(b)
    out = rows.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    return out.select("n", "mean", ratio(F.col("mean") * F.sqrt("n"), F.col("sd")).alias("t"), ratio(F.col("mean"), F.col("sd")).alias("cohen_d"), F.lit(0.05 / comparisons).alias("alpha"))


# Experiment log -----------------------------------------------------------------------------------------------------

LOG = (
    "experiment_id string, timestamp timestamp_ntz, website string, category string, method string, scraping_strategy string, schema_fields string, num_fields int, success int, precision double, "
    "recall double, f1 double, exact_match double, latency_ms double, input_tokens long, output_tokens long, estimated_cost double, retry_count int, validation_errors int, final_confidence double, "
    "html_size long, cleaned_size long, token_reduction_pct double"
)


def log_columns(df: DataFrame) -> DataFrame:
    """Derived columns of a log row: token reduction, cost, field count, success."""
    return df.withColumns(
        {
            "token_reduction_pct": ratio((F.col("html_size") - F.col("cleaned_size")) * 100.0, F.col("html_size")),
            "estimated_cost": F.col("input_tokens") / 1e6 * 0.10 + F.col("output_tokens") / 1e6 * 0.40,
            "num_fields": F.size(F.filter(F.split("schema_fields", ","), lambda x: F.trim(x) != "")),
            "success": (F.col("f1") > 0).cast("int"),
        }
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append rows; readers take the latest row of each id."""
    df.write.mode("append").parquet(path)


def latest_log(log: DataFrame) -> DataFrame:
    """The latest row of each experiment, by aggregation."""
    row = F.max_by(F.struct(*log.columns), F.struct("timestamp", F.xxhash64(*log.columns))).alias("row")
    return log.groupBy(F.col("experiment_id").alias("_k")).agg(row).select("row.*")


def by_method(log: DataFrame) -> DataFrame:
    means = [F.round(F.avg(c), 4).alias(c) for c in ("f1", "precision", "recall", "latency_ms")]
    return log.groupBy("method").agg(*means, F.round(F.sum("estimated_cost"), 4).alias("estimated_cost"))


def compare_methods(log: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("f1", "precision", "recall", "latency_ms")]
    return log.groupBy("method").agg(*means, F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("estimated_cost").alias("cost"), F.avg("success").alias("success_rate"))


def best_and_worst(log: DataFrame, metric: str) -> DataFrame:
    per = log.groupBy("method").agg(F.avg(metric).alias("value"))
    key = F.struct("value", "method")
    return per.agg(F.max(key)["method"].alias("best"), F.max("value").alias("best_value"), F.min(key)["method"].alias("worst"), F.min("value").alias("worst_value"))


def llm_totals(calls: DataFrame, price_in: float = 0.10, price_out: float = 0.40) -> DataFrame:
    """Requests, tokens and cost (prices a million tokens)."""
    return calls.agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out), F.lit(0.0)).alias("cost"),
    )
