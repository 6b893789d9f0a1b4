"""Streaming forms of the operators that keep state: windows, seen hashes, author counters, hashtag counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import text as T
from tidemark.sources.scratch import folder


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def topic_windows(events: DataFrame, late: str = "1 day", size: str = "1 day", slide: str | None = None, ts: str = "ts", topic: str = "event_type", author: str = "user_id", value: str = "value") -> DataFrame:
    """Volume, approximate authors and engagement of each window and topic; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), topic).agg(F.count("*").alias("volume"), F.approx_count_distinct(author).alias("authors"), F.sum(value).alias("engagement"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), topic, "volume", "authors", "engagement")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day", ts: str = "ts", user: str = "user_id") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), user, "n")


def new_posts(posts: DataFrame, ts: str = "ts", text: str = "text", late: str = "7 days") -> DataFrame:
    """Posts whose normalised text was not seen within the watermark."""
    return posts.withColumn("hash", T.text_hash(text)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["hash"])


def hashtag_counts(posts: DataFrame, text: str = "text") -> DataFrame:
    return posts.select(F.explode(T.hashtags(text)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def author_frequency(events: DataFrame, author: str = "user_id", key: str = "event_id", most: int = 5, forget: str | None = None) -> DataFrame:
    """(author, key, posts so far, frequency): one long of state for each author, forgotten after `forget` without posts (a stream that is never done, then)."""
    limit = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None

    def count(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for pdf in frames:
            pdf = pdf.sort_values(key)
            seen = range(n + 1, n + len(pdf) + 1)
            n += len(pdf)
            yield pd.DataFrame({author: who[0], key: pdf[key].to_numpy(), "posts": list(seen), "frequency": [min(x / most, 1.0) for x in seen]})
        state.update((n,))
        if limit:
            state.setTimeoutDuration(limit)

    schema = f"{author} long, {key} long, posts long, frequency double"
    return events.select(author, key).groupBy(author).applyInPandasWithState(count, schema, "n long", "append", GroupStateTimeout.ProcessingTimeTimeout if limit else GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream to the end of its input: new rows into Parquet in the shared folder, whole results (small ones) into a memory table."""
    spark = stream.sparkSession
    if mode == "append":
        path = folder(spark, name)
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint or f"{path}-state").trigger(availableNow=True).start().awaitTermination()
        try:
            return spark.read.schema(stream.schema).parquet(path)
        except Exception as e:  # no input, no file
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], stream.schema)
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return spark.table(name)


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Exactly-once Parquet sink."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
