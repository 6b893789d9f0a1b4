"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are words (lower-cased runs of letters and digits; ASCII punctuation separates them). A CGK random walk reads a window
of words: at each step it emits the current word and stays or advances by one, as a random bit of that word and step says.
Edits between windows become few differences between walks that soon run together again, so edit distance becomes Hamming
distance. Each of `repeats` walks samples some of its steps into one key. Items put the keys of a walk from each of their words
(as far as the walk stays inside) into a table; documents look up the keys of walks from every `stride`-th word, so that a
passage meets the item's window that begins at the same place whatever its alignment. Windows follow the item's size: short items
have short walks, longer ones long walks.
Candidates are confirmed by the exact word edit distance of the whole item to the best-matching stretch around.

Walks find a passage with a probability that falls with its edits, so they alone lose passages near the limit. Exact pieces
complete them: an item that may have e edits is cut into e + 1 pieces, of which a passage within the limit holds one unedited;
the first (at most PIECE) words of every piece are looked up at every word of the documents. No passage within the limit is lost.
`recall` and `hit` only set how many walks there are.

The benchmark is a stated query set: it is read in parts of about `block` items (dealt by a hash of the item) that go to all
tasks one after the other; every document is tried against every part. With several parts, each part's result is written before
the next part is read, so that neither the driver nor a task holds more than one. Documents are never cut, shuffled or gathered.

Defined results: null and empty texts and items match nothing; an item of fewer than `least` words (1: no such item) is not
searched; items too short to allow an edit match exactly; repeated rows give their matches each; several passages of one item
in a document give the best one; repeated items count once; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, filter_rows, grams, materialise, mix, scan, slices, span_hash, text_buffers

#: Bytes that separate words: ASCII except letters and digits.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = [not chr(i).isalnum() for i in range(128)]
LEAKS = "doc_id long, item_id long, start_word long, end_word long, distance long, item_words long"
#: (steps of the walk, sampled steps, least words of the item)
CLASSES = ((12, 5, 0), (30, 8, 24))
#: Most words of an item's piece that are looked up.
PIECE = 4


def words_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    data, offsets = text_buffers(texts)
    words = scan(data, offsets, OUTSIDE)
    return words, span_hash(data, words.start, words.end)


def sampled_steps(repeat: int, size: tuple[int, int, int]) -> list[int]:
    """The first and the last step and steps between them, at random but fixed."""
    rng = np.random.default_rng([repeat, size[0]])
    return sorted({0, size[0] - 1, *rng.choice(np.arange(1, size[0] - 1), size[1] - 2, replace=False).tolist()})


def walk(h: np.ndarray, starts: np.ndarray, repeat: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each class, keys of the walks from starts and the last word each has read."""
    steps = max(c[0] for c in CLASSES)
    seeded = np.concatenate([mix(h + np.array([1 + repeat], np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.zeros(steps + 1, np.uint64)])
    sample = [set(sampled_steps(repeat, c)) for c in CLASSES]
    keys = [np.full(len(starts), 1000 * repeat + k, np.uint64) for k in range(len(CLASSES))]
    last = [starts] * len(CLASSES)
    at = starts.copy()
    for t in range(steps):
        seen = seeded[at]
        for k, c in enumerate(CLASSES):
            if t in sample[k]:
                keys[k] = keys[k] * np.uint64(0x9FB21C651E98DF25) + (seen ^ (seen >> np.uint64(29)))
            if t == c[0] - 1:
                last[k] = at.copy()
        at += ((seen >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
    return [mix(k) for k in keys], last


def item_table(words: Words, h: np.ndarray, repeats: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of all items' windows, with item row and offset in the item."""
    starts = np.arange(len(h))
    row = words.row
    end = words.first[row + 1]
    size = words.counts[row]
    keys, rows, offs = [], [], []
    for r in range(repeats):
        found, last = walk(h, starts, r)
        for k, c in enumerate(CLASSES):
            upper = CLASSES[k + 1][2] if k + 1 < len(CLASSES) else math.inf
            ok = (last[k] < end) & (size >= max(c[2], least)) & (size < upper)
            keys.append(found[k][ok])
            rows.append(row[ok])
            offs.append((starts - words.first[row])[ok])
    key, item, off = (np.concatenate(x) for x in (keys, rows, offs))
    order = np.argsort(key, kind="stable")
    return key[order], item[order], off[order]


def piece_table(words: Words, h: np.ndarray, max_edits: float, least: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length in words: sorted keys of pieces of which a passage within max_edits holds one, with item row and offset in the item."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for row, n in enumerate(words.counts.tolist()):
        if n < max(least, 1):
            continue
        pieces = min(int(max_edits * n) + 1, n)
        size = min(PIECE, n // pieces)
        found.setdefault(size, []).extend((int(words.first[row]) + k * n // pieces, row, k * n // pieces) for k in range(pieces))
    out = {}
    for size, rows in found.items():
        start, item, off = (np.array(x) for x in zip(*rows, strict=True))
        key, at = grams(h, words.row, size)
        key = key[np.searchsorted(at, start)]
        order = np.argsort(key, kind="stable")
        out[size] = key[order], item[order], off[order]
    return out


def fit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the whole item to any stretch of text, and the stretch [a, b) (the first shortest such)."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, w in enumerate(item):
        sub = np.concatenate([[i + 1], cost[:-1] + (text != w)])
        gap = cost + 1
        new = np.minimum(sub, gap)
        first = np.where(sub <= gap, np.concatenate([[0], begin[:-1]]), begin)
        ramp = new - np.arange(n + 1)
        low = np.minimum.accumulate(ramp)
        src = np.maximum.accumulate(np.where(ramp == low, np.arange(n + 1), 0))
        cost, begin = low + np.arange(n + 1), first[src]
    b = int(np.argmin(cost))
    return int(cost[b]), int(begin[b]), b


def repeats_for(recall: float, hit: float = 0.75) -> int:
    """Walks needed so that one of them hits with probability `recall`, if each hits with probability `hit` (few edits)."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    max_edits: float = 0.2,
    recall: float = 0.995,
    stride: int = 4,
    least: int = 1,
    block: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, item_words): passages within max_edits * item words of an item."""
    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    repeats = repeats_for(recall)

    def found(shared: Broadcast) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches, 1):
                yield search(piece, shared.value, repeats, stride, max_edits)

        return source.mapInArrow(work, LEAKS)

    items, parts = in_parts(benchmark, item_col, item_text, block)
    if parts == 1:
        return found(index_of(items, repeats, max_edits, least))
    tables = []
    for k in range(parts):
        shared = index_of(items.filter(F.col("part") == k), repeats, max_edits, least)
        tables.append(materialise(found(shared), "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionByName, tables)


def filter_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_edits: float = 0.2, recall: float = 0.995, stride: int = 4, least: int = 1, block: int = 20_000
) -> DataFrame:
    """Rows of docs, all columns, that hold no passage of any item."""
    repeats = repeats_for(recall)

    def clean(docs: DataFrame, shared: Broadcast) -> DataFrame:
        def keep():
            def passes(texts: pa.Array) -> np.ndarray:
                rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), texts], names=["doc_id", "text"])
                ok = np.ones(len(texts), bool)
                ok[search(rows, shared.value, repeats, stride, max_edits).column(0).to_numpy()] = False
                return ok

            return passes

        return filter_rows(docs, text_col, keep)

    items, parts = in_parts(benchmark, item_col, item_text, block)
    if parts == 1:
        return clean(docs, index_of(items, repeats, max_edits, least))
    for k in range(parts):
        shared = index_of(items.filter(F.col("part") == k), repeats, max_edits, least)
        docs = materialise(clean(docs, shared), "clean")
        shared.destroy()
    return docs


def in_parts(benchmark: DataFrame, item_col: str, item_text: str, block: int) -> tuple[DataFrame, int]:
    """(item_id, text, part), repeated rows once, and the number of parts."""
    items = benchmark.selectExpr(f"cast(`{item_col}` as long) item_id", f"cast(`{item_text}` as string) text").distinct()
    parts = max(1, -(-items.count() // block))
    return items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), parts


def index_of(part: DataFrame, repeats: int, max_edits: float, least: int) -> Broadcast:
    """One part of the items: ids, word hashes, first words, the sorted table of keys with a sieve before it, and the pieces."""
    rows = part.select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")]).combine_chunks()
    words, h = words_of(pa.array(rows.column("text").to_pylist(), pa.string()))
    key, item, off = item_table(words, h, repeats, least)
    pieces = piece_table(words, h, max_edits, least)
    sieve = np.zeros(1 << 22, bool)
    for k in (key, *(x[0] for x in pieces.values())):
        sieve[(k >> np.uint64(42)).astype(np.int64)] = True
    return part.sparkSession.sparkContext.broadcast((rows.column("item_id").to_pylist(), h, words.first, key, item, off, sieve, pieces))


def search(piece: pa.RecordBatch, index: tuple, repeats: int, stride: int, max_edits: float) -> pa.RecordBatch:
    ids, item_h, item_first, key, item, off, sieve, pieces = index
    doc_ids = piece.column(0).to_pylist()
    words, h = words_of(piece.column(1))
    row_start = words.first[words.row]
    starts = np.flatnonzero((np.arange(len(h)) - row_start) % stride == 0)
    hits = [np.zeros((0, 3), np.int64)]

    def look(k: np.ndarray, starts: np.ndarray, key: np.ndarray, item: np.ndarray, off: np.ndarray) -> None:
        near = np.flatnonzero(sieve[(k >> np.uint64(42)).astype(np.int64)])
        a, b = np.searchsorted(key, k[near], "left"), np.searchsorted(key, k[near], "right")
        n = b - a
        at = np.repeat(starts[near], n)
        j = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        hits.append(np.stack([words.row[at], item[j], at - off[j]], axis=1))

    for r in range(repeats if len(key) else 0):
        for k in walk(h, starts, r)[0]:
            look(k, starts, key, item, off)
    for size, table in pieces.items():
        look(*grams(h, words.row, size), *table)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], tuple[int, int]] = {}
    for row, it, guess in np.unique(np.concatenate(hits), axis=0).tolist():
        w = item_h[item_first[it] : item_first[it + 1]]
        most = int(max_edits * len(w))
        lo, hi = int(words.first[row]), int(words.first[row + 1])
        a, b = max(lo, guess - most), min(hi, guess + len(w) + most)
        x, y = done.get((row, it), (0, 0))  # guesses ascend, so that the last look reaches furthest
        if x <= a and b <= y:
            continue
        pad = len(w)  # one look settles the guesses nearby
        a, b = max(lo, a - pad), min(hi, b + pad)
        done[row, it] = (a, b)
        if np.isin(h[a:b], w).sum() < len(w) - most:
            continue
        cost, begin, end = fit_distance(w, h[a:b])
        if cost <= most and ((row, it) not in best or (cost, a + begin) < best[row, it][:2]):
            best[row, it] = (cost, a + begin, a + end)
    rows = [(doc_ids[r], ids[i], s - int(words.first[r]), e - int(words.first[r]), c, int(item_first[i + 1] - item_first[i])) for (r, i), (c, s, e) in sorted(best.items())]
    names = [x.split()[0] for x in LEAKS.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)
