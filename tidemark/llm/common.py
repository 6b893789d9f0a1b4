"""Helpers shared by the operators of this subpackage: numpy word scanning over Arrow text, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and \t \n \v \f \r; every other byte belongs to a word.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII upper case to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes that a worker handles at once; one longer text is handled alone.
SLICE_BYTES = 4 << 20

_OWN_DIR: list[str] = []
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one where that is unset, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _OWN_DIR[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def partitions(df: DataFrame, part_bytes: int = 8 << 20) -> int:
    """How many tasks to deal df's texts to, by the size that the optimizer knows without reading: the session's number at least."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // part_bytes) if size < 1 << 60 else least  # larger: unknown


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and no later plan reads."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, counts: DataFrame, total: int, by: str, how: str = "inner", share: int = 512, least: int = 500, salts: int = 32) -> DataFrame:
    """rows joined with groups on key, the rows of large keys dealt to `salts` tasks each by a hash of column `by`.

    counts (key, n) says how many rows a key has. Large is a key with `least` rows or more and over a `share`-th of all `total`
    rows: there are fewer than `share` such keys, which bounds what is broadcast. Rows of groups with large keys are repeated
    for each salt. This only deals rows: the result is the plain join's.
    """
    large = F.broadcast(counts.filter(F.col("n") > max(total // share, least - 1)).select(key, F.lit(True).alias("_large")))
    salt = F.when(F.col("_large"), F.pmod(F.xxhash64(by, F.lit(3)), F.lit(salts))).otherwise(0)
    salted = rows.join(large, key, "left").withColumn("_salt", salt.cast("int")).drop("_large")
    copies = F.when(F.col("_large"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = groups.join(large, key, "left").withColumn("_salt", F.explode(copies)).drop("_large")
    return salted.join(dealt, [key, "_salt"], how).drop("_salt")


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds at most limit bytes of the text column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_buffers(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """Rows of df whose text passes; keep() is called once a task and gives a function from texts to a mask."""
    column = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = keep()
        for part in slices(batches, column):
            yield part.filter(pa.array(passes(part.column(column))))

    return df.mapInArrow(work, df.schema)


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its row offsets (int64, from 0); null counts as empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of a run of texts: byte spans, the row of each word, and per row the first word's index."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def scan(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE) -> Words:
    """Maximal runs of bytes that are not `outside`, none across rows."""
    inside = ~outside[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = inside[:-1], inside[1:]
        heads = offsets[:-1]
        before[heads[heads < n]] = False
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), start
    left = length
    while len(live):
        some = left > 0
        if not some.all():
            live, at, left = live[some], at[some], left[some]
            if not len(live):
                break
        word = eights[at]
        short = left < 8
        if short.any():
            shift = (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))
            word[short] = (word[short] << shift) >> shift
        h[live] = mix(h[live] * np.uint64(0xD6E8FEB86659FD93) + word)
        at, left = at + 8, left - 8
    return h


def grams(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words within a row, and the index of each window's first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[at + j])
    return out, at


def by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
