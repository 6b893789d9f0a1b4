"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule, a piecewise linear density over training time from 0 to 1. Targets share the corpus'
words by weight, none above `cap` times its source's words; the excess is shared again among the others. A source's documents,
in the order of a hash and again for each further pass, form a line of words; the mix takes the line up to the target. The
integral of the schedule is the source's cumulative token demand over time; its inverse, at the place on the line where a
document begins, is the document's training position. Documents are finally sorted by position in ranges.

All steps are DataFrame expressions. Running sums over a source are split at 256 times 256 buckets of the hash: totals of both
levels first, then sums within a bucket, so that one source may hold any share of the rows; sources themselves are ranked range
by range, so that there may be as many as hosts. Only one row of totals comes to the driver.

Defined results: null and empty texts have no words and nothing of them is taken; the null source is a source like others and
sorts last; rows that are equal in all columns read share out equal places; an empty table gives an empty table; columns other
than id, text and source are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread_join

WORD = r"[^\x20\x09-\x0D]+"
#: Schedules by weight class: (time, density) knots; early, even and late sources.
SCHEDULES = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with its rank from 1 in this order: ranges are sorted each for itself, then added up by their sizes."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_i", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_p", F.shiftright("_i", 33)).withColumn("_i", F.col("_i").bitwiseAND((1 << 33) - 1)), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    starts = sizes.withColumn("_o", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_o") + F.col("_i") + 1).drop("_p", "_i", "_o")


def weigh(sources: DataFrame, classes: int = 3) -> DataFrame:
    """sources (source, source_size), a row each: weights 1, 2, ... by code point, null last."""
    ranked = numbered(sources, F.col("source").asc_nulls_last(), "sid")
    return ranked.withColumn("weight", (F.col("sid") - 1) % classes + 1)


def fill(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Targets by weight under cap * source_size: the common level rises until no source is above its cap."""
    total = sources.agg(F.sum("source_size").alias("t")).first().t or 0
    num, den = 0, 1
    while True:
        above = F.lit(float(num)) * F.col("weight") >= F.lit(float(den)) * cap * F.col("source_size")
        capped = above if num else F.lit(False)
        r = sources.agg(F.sum(F.when(capped, cap * F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("w")).first()
        if not r.w:
            num, den = num or 1, den
            break
        new = (total - r.full, r.w)
        if new[0] * den == num * new[1] and (num or not total):
            break
        num, den = new
        if not num:
            break
    level = F.lit(float(num)) * F.col("weight") / F.lit(float(den))
    return sources.withColumn("target", F.least(level, cap * F.col("source_size").cast("double")) if total else F.lit(0.0))


def invert(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral reaches `share` (0 to 1) of its total."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done = sum(areas), 0.0
    out = F.lit(float(knots[-1][0]))
    steps = []
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        steps.append((a, b, done, done + area))
        done += area
    for (t0, w0), (t1, w1), lo, hi in reversed(steps):
        left = F.greatest(share * total - lo, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        x = 2 * left / F.greatest(w0 + F.sqrt(F.greatest(w0 * w0 + 2 * left * slope, F.lit(0.0))), F.lit(1e-12))
        out = F.when(share * total < hi, t0 + x).otherwise(out)
    return out


def identity(id_col: str, text_col: str) -> Column:
    """A hash of id and text: the order of documents within a source."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def known(source_col: str) -> Column:
    """The source as a key that joins, nulls too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cap: int = 3,
    schedules: dict[int, Sequence[tuple[float, float]]] | None = None,
) -> DataFrame:
    """A row per document: doc_id, source, known (the source as a key), h (the order in it), size, source_size, target, taken, passes, position, sorted by position in ranges.

    passes: for each pass over the source, the words taken and the training position; position is the first pass's.
    """
    schedules = schedules or SCHEDULES
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        known(source_col).alias("known"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        identity(id_col, text_col).alias("h"),
    )
    sizes = materialise(sizes, "sizes")
    per = sizes.groupBy("known").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialise(fill(materialise(weigh(per, len(schedules)), "sources"), cap).drop("source"), "targets")
    rows = spread_join(sizes, sources.drop("n"), "known", sources.select("known", "n"), sizes.count(), "h")
    rows = rows.withColumns({"part": F.conv(F.substring("h", 1, 2), 16, 10).cast("int"), "bucket": F.conv(F.substring("h", 3, 2), 16, 10).cast("int")})
    totals = rows.groupBy("sid", "part", "bucket").agg(F.sum("size").alias("n"))
    parts = totals.groupBy("sid", "part").agg(F.sum("n").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy("sid").orderBy("part")) - F.col("m"))
    inner = F.sum("n").over(Window.partitionBy("sid", "part").orderBy("bucket")) - F.col("n")
    before = totals.withColumn("inner", inner).join(parts, ["sid", "part"]).select("sid", "part", "bucket", (F.col("upto") + F.col("inner")).alias("before"))
    inside = Window.partitionBy("sid", "part", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(before, ["sid", "part", "bucket"]).withColumn("at", F.col("before") + F.sum("size").over(inside) - F.col("size"))

    whole = F.round("target").cast("long")
    start = [F.lit(p) * F.col("source_size") + F.col("at") for p in range(cap)]
    position = F.lit(None).cast("double")

    def when(at: Column) -> Column:
        out = position
        for k, knots in schedules.items():
            out = F.when(F.col("weight") == k, invert(at / F.greatest(F.col("target"), F.lit(1.0)), knots)).otherwise(out)
        return out

    words = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - s)) for s in start]
    kept = [(s * 2 + F.col("size") < whole * 2) & (F.lit(p == 0) | (F.col("size") > 0)) for p, s in enumerate(start)]
    passes = F.array(*[F.struct(w.alias("words"), k.alias("whole"), when(s).alias("position")) for w, k, s in zip(words, kept, start, strict=True)])
    taken = words[0]
    for w in words[1:]:
        taken = taken + w
    out = placed.select("doc_id", "source", "known", "h", "size", "source_size", "target", taken.alias("taken"), F.filter(passes, lambda p: (p["words"] > 0) | p["whole"]).alias("passes"), when(start[0]).alias("position"))
    return out.repartitionByRange("position", "h").sortWithinPartitions("position", "h")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows of docs, all columns, as often as the mix takes them, each pass rounded to whole documents (half a document or more counts).

    Rows with equal id, text and source share what the mix takes of them all, as evenly as whole rows can.
    """
    times = F.sum(F.size(F.filter("passes", lambda p: p["whole"])))
    taken = mix(docs, id_col, text_col, source_col, **options).groupBy("known", "h").agg(times.alias("n"), F.count("*").alias("k")).filter("n > 0")
    rows = docs.select(known(source_col).alias("known"), identity(id_col, text_col).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("known", "h").orderBy(F.xxhash64("row")))
    copies = ((F.col("n") + F.col("k") - place) / F.col("k")).cast("int")
    placed = rows.join(taken, ["known", "h"]).withColumn("copies", copies)
    return placed.filter("copies > 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
