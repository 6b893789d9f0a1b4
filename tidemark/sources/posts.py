"""Posts: schema, alias mapping, validation, readers, sinks and a seeded generator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = ["likes", "comments", "shares", "views", "retweets", "upvotes", "downvotes"]
SCHEMA = (
    "post_id string, platform string, timestamp timestamp, text string, author_id_hash string, language string, url string, hashtags array<string>, mentions array<string>, media_type string, "
    f"media_urls array<string>, engagement struct<{','.join(f'{c}:bigint' for c in COUNTS)}>, metadata map<string,string>"
)
# Column names that stand for each field, in order, and closed vocabularies.
ALIASES = {
    "post_id": ["post_id", "id", "tweet_id"],
    "timestamp": ["timestamp", "created_at", "date", "time", "published_at", "datetime"],
    "text": ["text", "content", "body", "message", "tweet", "post", "description"],
    "author": ["author_id_hash", "author", "user_id", "username"],
}
PLATFORMS = ["twitter", "reddit", "youtube", "news", "forum", "synthetic", "other", "unknown"]
MEDIA = ["text", "image", "video", "link", "mixed"]


def pick(df: DataFrame, names: list[str]) -> Column:
    """The first non-empty of the columns that exist, as a string."""
    have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(None).cast("string"))


def as_given(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that is more than spaces, as it stands; without one, the first that is not null."""
    have = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in have], *have, F.lit(None).cast("string"))


def words_of(df: DataFrame, name: str) -> Column:
    """An array column as it is, or a comma-separated string split and trimmed."""
    if name not in df.columns:
        return F.array().cast("array<string>")
    if dict(df.dtypes)[name].startswith("array"):
        return F.coalesce(F.col(name).cast("array<string>"), F.array().cast("array<string>"))
    parts = F.transform(F.split(F.coalesce(F.col(name).cast("string"), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def to_posts(raw: DataFrame, platform: str | None = None) -> DataFrame:
    """Raw columns under any alias to the post schema, texts and authors unchanged. A row's own platform wins; the given one fills in."""
    text = as_given(raw, ALIASES["text"])
    times = [F.try_to_timestamp(F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit(""))) for n in ALIASES["timestamp"] if n in raw.columns]
    nested = dict(raw.dtypes).get("engagement", "").startswith("struct")
    fields = raw.select("engagement.*").columns if nested else []

    def count(c: str) -> Column:
        found = [F.col(x).cast("string").try_cast("double").cast("long") for x in ([f"engagement.{c}"] if c in fields else []) + [f"`{n}`" for n in (c, f"engagement_{c}") if n in raw.columns]]
        return F.coalesce(*found, F.lit(0).cast("long")).alias(c)

    kind = F.lower(pick(raw, ["platform"]))
    media = F.lower(pick(raw, ["media_type"]))
    used = {x for names in ALIASES.values() for x in names} | {"platform", "language", "url", "hashtags", "mentions", "media_type", "media_urls", "engagement", *COUNTS, *(f"engagement_{c}" for c in COUNTS)}
    rest = [x for c in raw.columns if c not in used for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return raw.select(
        F.coalesce(pick(raw, ALIASES["post_id"]), F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)).alias("post_id"),
        F.when(kind.isNull(), F.lit(platform or "unknown")).when(kind.isin(PLATFORMS), kind).otherwise("unknown").alias("platform"),
        F.coalesce(*times, F.lit(None).cast("timestamp")).alias("timestamp"),
        text.alias("text"),
        F.substring(F.sha2(as_given(raw, ALIASES["author"]), 256), 1, 16).alias("author_id_hash"),
        pick(raw, ["language"]).alias("language"),
        pick(raw, ["url"]).alias("url"),
        words_of(raw, "hashtags").alias("hashtags"),
        words_of(raw, "mentions").alias("mentions"),
        F.when(media.isin(MEDIA), media).otherwise("text").alias("media_type"),
        words_of(raw, "media_urls").alias("media_urls"),
        F.struct(*[count(c) for c in COUNTS]).alias("engagement"),
        (F.create_map(*rest) if rest else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def total_engagement(e: str = "engagement") -> Column:
    return sum((F.col(f"{e}.{c}") for c in ("likes", "comments", "shares", "views", "retweets", "upvotes")), F.lit(0))


def engagement_score(e: str = "engagement") -> Column:
    weights = {"likes": 1.0, "comments": 2.0, "shares": 3.0, "retweets": 2.5, "upvotes": 1.0}
    views = F.when(F.col(f"{e}.views") > 0, 0.01 * F.col(f"{e}.views")).otherwise(0.0)
    return sum((w * F.col(f"{e}.{c}") for c, w in weights.items()), F.lit(0.0)) + views


def errors(text: str = "text") -> Column:
    """What keeps a post from being valid."""
    e = lambda c: F.col(f"engagement.{c}") < 0
    found = [
        (F.col("post_id").isNull(), "missing post_id"),
        (F.col(text).isNull(), "missing text"),
        (F.col("timestamp").isNull(), "missing timestamp"),
        (F.length(F.trim(text)) < 3, "text too short"),
        *[(e(c), f"negative {c}") for c in ("likes", "comments", "shares", "views")],
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in found]))


def validated(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid posts, rejects with their errors)."""
    marked = posts.withColumn("errors", errors())
    return marked.filter(F.size("errors") == 0).drop("errors"), marked.filter(F.size("errors") > 0)


def defaults(posts: DataFrame) -> DataFrame:
    """Fill what a post may lack: clean_text, collection date."""
    have = posts.columns
    return posts.withColumns(
        {
            "clean_text": F.coalesce("clean_text", "text") if "clean_text" in have else F.col("text"),
            "collection_date": F.coalesce("collection_date", F.current_timestamp()) if "collection_date" in have else F.current_timestamp(),
        }
    )


def to_json_rows(posts: DataFrame) -> DataFrame:
    return posts.select(F.to_json(F.struct("*")).alias("json"))


def from_json_rows(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.from_json(column, SCHEMA).alias("p")).select("p.*")


# Readers ------------------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """All columns as strings, so that no second pass infers types; broken rows keep what they have."""
    return spark.read.csv(list(paths), header=True, mode="PERMISSIVE", multiLine=True, escape='"')


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """One object a line; blank and broken lines are left out."""
    return spark.read.json(list(paths), mode="DROPMALFORMED")


def read_json(spark: SparkSession, *paths: str) -> DataFrame:
    """An array, {"posts": […]}, {"data": […]}, one object, or lines of objects."""
    df = spark.read.json(list(paths), multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    kinds = dict(df.dtypes)
    for wrap in ("posts", "data"):
        if kinds.get(wrap, "").startswith("array<struct"):
            return df.select(F.explode(wrap).alias("p")).select("p.*")
    if "_corrupt" in kinds:
        return read_jsonl(spark, *paths)
    return df


READERS = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "parquet": lambda spark, *p: spark.read.parquet(*p)}


def load(spark: SparkSession, path: str, platform: str | None = None) -> DataFrame:
    """Posts of one file or glob, by its suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported format: {suffix}")
    return to_posts(READERS[suffix](spark, path), platform)


def load_many(spark: SparkSession, paths: list[str], platform: str | None = None) -> DataFrame:
    out = load(spark, paths[0], platform)
    for p in paths[1:]:
        out = out.unionByName(load(spark, p, platform), allowMissingColumns=True)
    return out


def load_directory(spark: SparkSession, path: str, recursive: bool = True, platform: str | None = None) -> DataFrame:
    """All files under a folder, each suffix by its reader; suffixes without files are skipped."""
    out = None
    for suffix, options in (("csv", {"header": True, "escape": '"'}), ("json", {"multiLine": True}), ("jsonl", {})):
        reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*.{suffix}").option("ignoreCorruptFiles", "true").options(**options)
        try:
            df = reader.csv(path) if suffix == "csv" else reader.json(path)
        except Exception as e:  # no file of this kind gives no schema
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        if df.columns:
            posts = to_posts(unwrap(df), platform)
            out = posts if out is None else out.unionByName(posts)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def unwrap(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    wrap = next((w for w in ("posts", "data") if kinds.get(w, "").startswith("array<struct")), None)
    return df.select(F.explode(wrap).alias("p")).select("p.*") if wrap else df


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def cached_embeddings(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Texts with their cached vector, or null: keyed by the text's md5."""
    keyed = texts.withColumn("text_md5", F.md5(F.col(text).cast("binary")))
    return keyed.join(cache.select("text_md5", "embedding"), "text_md5", "left")


# Sinks --------------------------------------------------------------------------------------------------------------


def flat(posts: DataFrame) -> DataFrame:
    """Engagement as engagement_* columns, arrays and maps as JSON."""
    cols = []
    for name, kind in posts.dtypes:
        if name == "engagement":
            cols += [F.col(f"engagement.{c}").alias(f"engagement_{c}") for c in COUNTS]
        else:
            cols.append(F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct")) else F.col(name))
    return posts.select(*cols)


def write_csv(posts: DataFrame, path: str) -> None:
    flat(posts).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_jsonl(posts: DataFrame, path: str) -> None:
    posts.write.mode("overwrite").json(path)


def write_json_array(posts: DataFrame, path: str, most: int = 16 << 20) -> None:
    """Arrays in order of post_id: one up to `most` bytes, else a file with one array for each range of ids of about that size.

    A reader of arrays holds one whole, so that a file's size bounds its memory; rows are written as they come.
    """
    rows = posts.select("post_id", F.to_json(F.struct("*")).alias("j"))
    total = rows.agg(F.sum(F.octet_length("j"))).first()[0] or 0
    if not total:
        posts.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    ranged = rows.repartitionByRange(-(-total // most), "post_id", F.xxhash64("j")) if total > most else rows.coalesce(1)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            if batch.num_rows:
                heads = pa.array([lead] + [","] * (batch.num_rows - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(heads, batch.column(0), "")], ["value"])
                lead = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if lead == "[" else "]"]})

    ranged.sortWithinPartitions("post_id").select("j").mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def report(values: dict, spark: SparkSession, path: str) -> None:
    """A dictionary of results as one JSON file."""
    import json

    spark.createDataFrame([(json.dumps(values, default=float, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def markdown_report(title: str, sections: dict[str, list[dict]]) -> str:
    """Small result tables as Markdown."""
    out = [f"# {title}"]
    for name, rows in sections.items():
        out += ["", f"## {name}", ""]
        if rows:
            head = list(rows[0])
            out += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
            out += ["| " + " | ".join(f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in head) + " |" for r in rows]
        else:
            out.append("No rows.")
    return "\n".join(out)


# Generator ----------------------------------------------------------------------------------------------------------

TOPICS = {
    "ai_release": ["model", "launch", "benchmark", "agents"],
    "cricket_final": ["match", "wicket", "captain", "crowd"],
    "festival": ["lights", "music", "food", "family"],
    "election": ["vote", "debate", "results", "turnout"],
    "new_phone": ["camera", "battery", "price", "display"],
}
BANDS = [(1, 10), (10, 100), (100, 1000), (1000, 10000)]


def generate(spark: SparkSession, posts: int = 500, topics: int = 3, days: int = 14, seed: int = 42, start: str = "2026-07-01") -> DataFrame:
    """Seeded synthetic posts: each topic grows slowly, rises, peaks and declines over the days."""
    names = list(TOPICS)[:topics]
    shape = [1] * 4 + [2, 3, 5, 8] + [12, 12] + [6, 4, 2, 1]
    shape = [shape[i * len(shape) // days] for i in range(days)]
    slots = [d for d, n in enumerate(shape) for _ in range(n)]
    day = F.element_at(F.array(*[F.lit(d) for d in slots]), (F.rand(seed) * len(slots)).cast("int") + 1)
    rows = spark.range(posts).withColumns({"topic": F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names) + 1).cast("int")), "day": day, "second": (F.rand(seed + 1) * 86400).cast("int")})
    words = F.lit(None).cast("array<string>")
    for n in names:
        words = F.when(F.col("topic") == n, F.array(*[F.lit(w) for w in TOPICS[n]])).otherwise(words)
    heat = F.element_at(F.array(*[F.lit(min(3, x // 3)) for x in shape]), F.col("day") + 1)
    low = F.element_at(F.array(*[F.lit(a) for a, _ in BANDS]), heat + 1)
    high = F.element_at(F.array(*[F.lit(b) for _, b in BANDS]), heat + 1)
    word = F.element_at(words, (F.rand(seed + 2) * 4).cast("int") + 1)
    likes = (low + F.rand(seed + 3) * (high - low)).cast("long")
    ts = F.to_timestamp(F.lit(start)) + F.make_dt_interval(F.col("day"), F.lit(0), F.lit(0), F.col("second"))
    text = F.format_string("Everyone talks about %s and the %s #%s", F.replace("topic", F.lit("_"), F.lit(" ")), word, F.initcap(word))
    return rows.select(F.format_string("%s_%05d", "topic", "id").alias("post_id"), text.alias("text"), ts.alias("timestamp"), likes.alias("likes"), (likes / 5).cast("long").alias("comments"), (likes / 10).cast("long").alias("shares"), F.lit("synthetic").alias("platform"))
