"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes what the one before kept, as Parquet, with the columns of documents (doc_id, text, lang, source, n_chars);
the last returns shards. Rows are never sampled; what a stage drops is what its operator rejects:

- toxicity drops texts whose score reaches the threshold (the model learns from the labels of the documents at hand);
- near_duplicates keeps the smallest id of each component, once (rows without an id are kept; rows with one id and different
  texts are different documents, with equal texts one);
- decontamination drops documents that hold a passage of a benchmark item;
- mixing repeats each document as often as the mix takes it (rounded to whole documents) and drops what it takes less than half of;
- sharding gives every remaining row a shard and a slot.

Null texts count as empty throughout; an empty table passes through all stages empty. No stage has SQL for its rows (the stages
are tested against brute force), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, minhash, mixing, sharding, toxicity
from tidemark.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.filter_clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows whose id occurs again are told apart by their texts."""
    rows = docs.select(*COLUMNS)
    again = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again"))
    again = materialise(again, "again")
    if again.isEmpty():
        found = minhash.near_duplicates(rows).filter("not kept").select("doc_id").distinct()
        return rows.join(found, "doc_id", "left_anti").select(*COLUMNS)
    own = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 2) + F.lit(1 << 62)
    rows = rows.join(again, "doc_id", "left").withColumn("near_id", F.when(F.col("again"), own).otherwise(F.col("doc_id")))
    rows = materialise(rows.select("near_id", *COLUMNS), "told_apart")
    found = minhash.near_duplicates(rows, id_col="near_id").filter("not kept").selectExpr("doc_id near_id").distinct()
    rest = rows.join(found, "near_id", "left_anti")
    once = rest.filter("near_id is not null").dropDuplicates(["near_id"])
    return once.unionByName(rest.filter("near_id is null")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.filter_clean(docs.select(*COLUMNS), items)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole."""
    return mixing.repeat(docs.select(*COLUMNS)).select(*COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for each row."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
