"""Sharding by balanced label propagation under the law `rows` (shard counts at most one apart).

Documents are linked by equal texts. Every document starts at the shard of a hash. In each round a join tells every member where
most of its neighbours are, and it asks to move there; the flows that would pass a shard's quota are scaled down, and a group
moves as a whole (one of more than 1/128 of all rows in part). Members of one group in one shard are interchangeable, so rounds
join cells (group, shard, count) rather than documents, at most one cell for each shard and group: hot groups cost what others
do. Last, documents of groups take their cells' shards; what exceeds a quota and all unlinked documents fill the open places,
in the order of a hash. Cut edges (cut_edges() counts them) therefore come only from groups that no quota can hold whole, and
from what a full shard turns away.

All steps are DataFrame expressions; ranks are bucket offsets plus ranks within buckets, never one sort of everything; the rows
of large groups are dealt to many tasks. Only shard totals (one row a shard) come to the driver.

Defined results: a null text counts as an empty one (size 1, checksum 0); equal rows each get their own slot; fewer rows than
shards leave shards empty; columns other than id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, spread_join

BUCKETS = 1024
SALTS = 64


def ranks(df: DataFrame, part: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds `name`: the row's rank (from 0) within part, in the order of (bucket, order)."""
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*part, "_b").agg(F.count("*").alias("_n"))
    offsets = totals.withColumn("_o", F.sum("_n").over(Window.partitionBy(*part).orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(*part, "_b").orderBy(*order))
    return df.join(offsets, [*part, "_b"]).withColumn(name, F.col("_o") + place - 1).drop("_b", "_o")


def propagate(cells: DataFrame, shards: int, rows: int, rounds: int) -> DataFrame:
    """Move cells (link, shard, n) towards their group's largest cell, shard totals staying under the quota."""
    quota, hot = rows // shards, max(1, rows // (8 * shards))
    unit = F.pmod(F.xxhash64("link", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    for k in range(rounds):
        most = F.max(F.struct("n", (-F.col("shard")).alias("s")))
        homes = cells.groupBy("link").agg(most.alias("m"), F.sum("n").alias("total")).selectExpr("link", "-m.s goal", "total")
        seen = materialise(cells.join(homes, "link"), f"round{k}")
        flow = seen.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("goal") != F.col("shard"), F.col("n")).otherwise(0)).alias("away")).collect()
        into = {r.goal: r.n for r in seen.filter("goal <> shard").groupBy("goal").agg(F.sum("n").alias("n")).collect()}
        here, away = {r.shard: r.n for r in flow}, {r.shard: r.away for r in flow}
        if not into:
            return cells
        part = dict.fromkeys(range(shards), 1.0)
        for _ in range(50):  # shrink inflows until every quota holds, outflows shrinking along with them
            least = min(part.values())
            for s in range(shards):
                room = max(0.0, quota - here.get(s, 0) + least * away.get(s, 0))
                part[s] = min(part[s], room / into[s]) if into.get(s) else part[s]
        share = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, part[s])]), F.col("goal"))
        moved = F.when(F.col("goal") == F.col("shard"), 0).when(F.col("total") > hot, F.floor(F.col("n") * share)).otherwise(F.when(unit < share, F.col("n")).otherwise(0))
        seen = seen.withColumn("moved", moved.cast("long"))
        both = F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("goal").alias("shard"), F.col("moved").alias("n")))
        cells = seen.select("link", F.explode(both).alias("c")).select("link", "c.shard", "c.n").filter("n > 0").groupBy("link", "shard").agg(F.sum("n").alias("n"))
    return cells


def cut_edges(placed: DataFrame, link: str = "text_crc32") -> DataFrame:
    """One row: edges (pairs of documents with equal links) and cut (those across shards), from counts, without making pairs."""
    cells = placed.groupBy(link, "size", "shard").agg(F.count("*").cast("double").alias("n"))
    groups = cells.groupBy(link, "size").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    edges = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return groups.agg(F.coalesce(edges, F.lit(0.0)).cast("long").alias("edges"), F.coalesce(edges - F.sum("inside"), F.lit(0.0)).cast("long").alias("cut"))


def shard(docs: DataFrame, shards: int = 16, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("link"))
    base = materialise(base.withColumn("first", F.pmod(F.xxhash64("doc_id", "link"), F.lit(shards)).cast("int")), "base")
    rows = base.count()
    buckets = max(BUCKETS, rows // 1_000_000)
    quota = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    cells = base.groupBy("link", F.col("first").alias("shard")).agg(F.count("*").alias("n"))
    several = cells.groupBy("link").agg(F.sum("n").alias("total")).filter("total > 1").select("link")
    cells = materialise(propagate(materialise(cells.join(several, "link"), "cells"), shards, rows, rounds), "cells")

    limit = max(1, rows // (8 * shards))
    sizes = cells.groupBy("link").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"))
    sizes = materialise(sizes, "sizes")
    counts = sizes.select("link", F.col("total").alias("n"))
    marked = materialise(spread_join(base.drop("first"), sizes, "link", counts, rows, "doc_id", "left"), "marked")
    linked = marked.filter("total is not null")
    hot = F.col("total") > limit
    salt = F.when(hot, F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SALTS))).otherwise(0)
    ranked = ranks(linked.withColumn("salt", salt), ["link"], F.col("salt"), ["doc_id"], "r").drop("salt")
    goal = F.aggregate(
        "cells",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(-1).alias("shard")),
        lambda a, c: F.struct((a["end"] + c["n"]).alias("end"), F.when((a["shard"] < 0) & (F.col("r") < a["end"] + c["n"]), c["shard"]).otherwise(a["shard"]).alias("shard")),
    )["shard"]
    labelled = materialise(ranked.select("doc_id", "size", "text_crc32", "link", goal.alias("goal"), F.pmod(F.xxhash64("link", F.when(hot, F.col("doc_id"))), F.lit(buckets)).alias("b")), "labelled")
    placed = ranks(labelled, ["goal"], F.col("b"), ["link", "doc_id"], "slot").drop("b")
    full = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, quota[s])]), F.col("goal"))
    placed = materialise(placed.withColumn("over", F.col("slot") >= full), "placed")
    discard(base, cells, sizes, labelled)

    stay = placed.filter("not over").select("doc_id", "size", "text_crc32", F.col("goal").alias("shard"), F.col("slot").cast("long").alias("slot"))
    held = {r.shard: r.n for r in stay.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    pool = marked.filter("total is null").select("doc_id", "size", "text_crc32").unionByName(placed.filter("over").select("doc_id", "size", "text_crc32"))
    pool = ranks(pool.withColumn("all", F.lit(0)), ["all"], F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(13)), F.lit(buckets)), ["doc_id", "text_crc32"], "r")
    to, at, done = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    cuts = []
    for s in range(shards):
        room = quota[s] - held.get(s, 0)
        cuts.append((s, done, done + room, held.get(s, 0)))
        done += room
    for s, lo, hi, have in reversed(cuts):
        to = F.when(F.col("r") < hi, F.lit(s)).otherwise(to)
        at = F.when(F.col("r") < hi, F.col("r") - lo + have).otherwise(at)
    rest = pool.select("doc_id", "size", "text_crc32", to.alias("shard"), at.cast("long").alias("slot"))
    out = stay.unionByName(rest)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
