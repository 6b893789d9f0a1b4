"""MinHash near-duplicates by a multi-index Hamming join.

Words (ASCII lower-cased) form five-word shingles; a text's set of 64-bit shingle hashes gives a signature of `symbols`
minima, `b` bits each. Two signatures within `radius` differing symbols, split into `chunks` pieces, must agree in at least
one piece up to floor(radius / chunks) symbols; each piece is therefore emitted once for every choice of that many symbols
left out, so that equal keys find every pair within the radius. All candidates are confirmed on full sets, those beyond the
radius that a key found by the way too. At a Jaccard similarity of 0.75, 96 symbols differ in 24 on average (deviation 4.2):
the radius 43 misses about eight in a million of the pairs that lie exactly on the threshold.

Groups are never expanded into all pairs. Texts with equal sets are one class. Within a key's group, members are first tried
against the member that shares most keys with others (the text that the group's copies come from, as a rule). Groups that are
then still in several components are compared exactly, block against block, in memory: only links come out, so that none that
could join two components is lost. What belongs to a key, a class, a hub or a family is counted by aggregation and joined back
with the rows of large ones dealt to many tasks; no group is sorted or held whole.

Defined results: null and empty texts have an empty set, are linked with nothing and kept; fewer than five words form one
shingle; repeated rows give a row each (rows with equal ids share a component, whatever their texts); null ids get a null component and are kept;
only the id and text columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, grams, materialise, mix, scan, slices, span_hash, spread_join, text_buffers

SIZE = 5


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_buffers(texts)
    words = scan(LOWER[data], offsets)
    h = span_hash(words.data, words.start, words.end)
    gram, at = grams(h, words.row, size)
    first = np.searchsorted(at, words.first)
    counts = words.counts
    out = []
    for i, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(gram[first[i] : first[i + 1]]))
        elif n:
            whole = np.array([n], np.uint64)
            for x in h[words.first[i] : words.first[i + 1]]:
                whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def seeds(symbols: int) -> np.ndarray:
    """Odd 32-bit multipliers and offsets, one pair for each symbol."""
    x = mix(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(x >> np.uint64(32)).astype(np.uint32) | np.uint32(1), x.astype(np.uint32)])


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """Minima of `symbols` hash functions, 16 bits each; empty sets give zeros."""
    out = np.zeros((len(sets), symbols), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    low = np.concatenate([(sets[i] >> np.uint64(32)).astype(np.uint32) for i in full])
    heads = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    mul, add = seeds(symbols)
    for k in range(symbols):
        least = np.minimum.reduceat(low * mul[k] + add[k], heads)
        out[full, k] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return out


def profiles(docs: DataFrame, symbols: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = shingle_sets(part.column(1))
            sig = signatures(sets, symbols)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )

    return docs.mapInArrow(work, "doc_id long, n_shingles long, digest binary, sig binary")


def pieces(symbols: int, radius: int, chunks: int) -> list[list[int]]:
    """For each chunk and each choice of floor(radius / chunks) symbols left out, the symbols that stay."""
    errors = radius // chunks
    cuts = [symbols * i // chunks for i in range(chunks + 1)]
    if min(b - a for a, b in itertools.pairwise(cuts)) <= errors:
        raise ValueError("chunks too small for the errors they must allow")
    return [[x for x in range(a, b) if x not in out] for a, b in itertools.pairwise(cuts) for out in itertools.combinations(range(a, b), errors)]


def keys(sigs: DataFrame, symbols: int, radius: int, chunks: int) -> DataFrame:
    """(key, doc_id): one row for each piece of each signature."""
    stay = pieces(symbols, radius, chunks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(text_buffers(part.column(1))[0].tobytes(), np.uint16).reshape(part.num_rows, symbols).astype(np.uint64)
                out = np.empty((len(stay), part.num_rows), np.uint64)
                for k, cols in enumerate(stay):
                    h = np.full(part.num_rows, k, np.uint64)
                    for c in cols:
                        h = mix(h * np.uint64(0x9FB21C651E98DF25) + sig[:, c])
                    out[k] = h
                ids = np.tile(part.column(0).to_numpy(), len(stay))
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(ids)], names=["key", "doc_id"])

    return sigs.select("doc_id", "sig").mapInArrow(work, "key long, doc_id long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(sa[i].as_py(), np.uint64), np.frombuffer(sb[i].as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    hubs = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")), "hubs")
    joined = spread_join(pairs.join(right, "b"), left, "a", hubs, pairs.count(), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(work, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for all nodes of edges.

    In each round every node moves to the smallest neighbour's smallest neighbour, and edges are drawn anew between what nodes
    moved to, until none is left; at last the moves are followed from the last round to the first. A node that was moved to while
    it moved itself is met again later and ends where its first move does.
    """

    def per(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("n"))

    live = edges.selectExpr(f"least({a}, {b}) lo", f"greatest({a}, {b}) hi").filter("lo < hi").distinct()
    live, moves = materialise(live, "edges"), []
    left = live.count()
    while left:
        up = materialise(live.groupBy("hi").agg(F.min("lo").alias("up")), "up")
        top = up.selectExpr("hi up", "up top")
        move = materialise(spread_join(up, top, "up", per(up, "up"), left, "hi", "left").selectExpr("hi node", "coalesce(top, up) to"), "move")
        moved = spread_join(live, move.selectExpr("node hi", "to b"), "hi", per(live, "hi"), left, "lo")
        moved = spread_join(moved, move.selectExpr("node lo", "to c"), "lo", per(live, "lo"), left, "hi", "left").selectExpr("coalesce(c, lo) a", "b")
        after = materialise(moved.selectExpr("least(a, b) lo", "greatest(a, b) hi").filter("lo < hi").distinct(), "edges")
        discard(live, up)
        live, left = after, after.count()
        moves.append(move)
    if not moves:
        return live.selectExpr("lo node", "hi root")
    found = moves[-1].selectExpr("node", "to root")
    for move in reversed(moves[:-1]):
        later = spread_join(move, found.selectExpr("node to", "root"), "to", per(move, "to"), move.count(), "node", "left")
        found = later.selectExpr("node", "coalesce(root, to) root").union(found).distinct()
    found = materialise(found, "roots")
    return found.union(found.selectExpr("root node", "root").distinct())


def cross_links(ids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the roots of texts, as few as join all that are linked, by counting common shingles in an inverted index.

    The most frequent root's texts don't ask: they are met by those that do.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    holders, first = owner[order], np.searchsorted(token[order], np.arange(token.max() + 2))
    mine = np.split(token, np.cumsum(size)[:-1])
    names, count = np.unique(roots, return_counts=True)
    out, group = [], {}

    def top(x: int) -> int:
        while group.get(x, x) != x:
            x = group[x]
        return x

    for r in np.flatnonzero(roots != names[np.argmax(count)]):
        both = np.bincount(np.concatenate([holders[first[t] : first[t + 1]] for t in mine[r]]), minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (size + size[r] - both)) & (roots != roots[r]))
        for k in np.unique(roots[near], return_index=True)[1]:
            x, y = top(int(roots[r])), top(int(roots[near[k]]))
            if x == y:
                continue
            group[max(x, y)] = min(x, y)
            out.append((int(min(ids[r], ids[near[k]])), int(max(ids[r], ids[near[k]]))))
    return out


def open_links(open_: DataFrame, sets: DataFrame, percent: int, block_bytes: int = 2 << 20) -> DataFrame:
    """Links (a, b) across roots among texts that share keys (key, doc_id, root), complete.

    Roots connected by keys form a family. A family larger than a block is cut into blocks by a hash; every two blocks meet in one
    task, which compares their texts in memory and puts out links only.
    """
    counts = materialise(open_.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a")), "counts")
    near = spread_join(open_, counts.select("key", "a"), "key", counts, open_.count(), "doc_id").filter("a <> root").selectExpr("a", "root b").distinct()
    family = components(near).selectExpr("node root", "root family")
    members = materialise(open_.select("doc_id", "root").distinct(), "members")
    rows = spread_join(members, family, "root", members.groupBy("root").agg(F.count("*").alias("n")), members.count(), "doc_id")
    rows = materialise(rows.join(sets.selectExpr("doc_id", "length(shingles) bytes"), "doc_id").select("doc_id", "root", "family", "bytes"), "members")
    sizes = rows.groupBy("family").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.sum("bytes") / block_bytes), F.lit(1)).cast("int").alias("blocks"))
    sizes, total = materialise(sizes, "families"), rows.count()
    rows = rows.drop("bytes").join(sets.select("doc_id", "shingles"), "doc_id")
    rows = spread_join(rows, sizes.select("family", "blocks"), "family", sizes, total, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.selectExpr("family", "least(own, other) i", "greatest(own, other) j", "doc_id", "root", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        links = cross_links(table["doc_id"].to_numpy(), table["root"].to_numpy(), found, percent)
        cols = list(zip(*links, strict=True)) if links else [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return rows.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 75,
    symbols: int = 96,
    radius: int = 43,
    chunks: int = 22,
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id reachable over confirmed links), kept."""
    docs = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    prof = materialise(profiles(docs, symbols), "profiles")
    known = prof.filter("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("n"))
    reps = materialise(classes.selectExpr("rep doc_id", "digest", "sig", "n"), "classes")

    keyed, rows = keys(reps, symbols, radius, chunks), reps.count() * len(pieces(symbols, radius, chunks))
    counts = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    met = materialise(spread_join(keyed, counts, "key", counts, rows, "doc_id"), "met")
    degree = materialise(met.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degrees")
    met_rows = met.count()
    hub = F.max(F.struct("degree", (-F.col("doc_id")).alias("id")))
    hubs = materialise(met.join(degree, "doc_id").groupBy("key").agg(F.count("*").alias("n"), hub.alias("hub")).selectExpr("key", "n", "-hub.id a"), "hubs")
    shared = met.select("key", "doc_id")
    tried = spread_join(shared, hubs.select("key", "a"), "key", hubs, met_rows, "doc_id").filter("a <> doc_id").selectExpr("a", "doc_id b")
    tried = materialise(tried.distinct(), "pairs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            found = pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "shingles"])

    texts = docs.join(degree.select("doc_id"), "doc_id", "left_semi")
    sets = materialise(texts.mapInArrow(work, "doc_id long, shingles binary"), "sets")
    links = materialise(verify(tried, sets, percent), "links")
    discard(counts, degree, tried)
    roots = materialise(components(links), "roots")

    seen = shared.join(roots, F.col("doc_id") == F.col("node"), "left").selectExpr("key", "doc_id", "coalesce(root, doc_id) root")
    seen = materialise(seen, "seen")
    split = materialise(seen.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key", "n"), "split")
    open_ = spread_join(seen, split.select("key"), "key", split, met_rows, "doc_id").select("key", "doc_id", "root")
    more = materialise(open_links(materialise(open_, "open"), sets, percent), "links")
    discard(met, hubs, seen, split, roots)
    roots = components(links.union(more))

    owner = reps.join(roots, F.col("doc_id") == F.col("node"), "left").selectExpr("digest", "coalesce(root, doc_id) root")
    out = spread_join(prof, owner, "digest", reps.select("digest", "n"), prof.count(), "doc_id", "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    comp = F.when(F.col("doc_id").isNotNull(), comp)
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
