"""Quality rules by suffix-array repetition.

Each text is a sequence of words. The suffixes that share at least three words with another suffix of the same text are
sorted by prefix doubling; adjacent longest common prefixes bound the LCP intervals, whose strings are the maximal repeated
substrings. The union of the spans of repeats of at least `min_repeat` words gives the covered fraction; the deepest
interval gives the longest repeat. A text fails if either passes its limit.

Defined results: null and empty texts have no words (base_failed, not kept); repeated rows give a row each; only the id and
text columns are read, so other columns and their names don't matter; an empty table gives an empty table. Texts are never
cut: a worker takes whole texts, several megabytes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WHITE, by_row, grams, mix, scan, slices, span_hash, text_buffers

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "covered_words long, longest_repeat long, kept boolean"
)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
BASE = 3


def repeat_lengths(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all suffixes that share BASE or more words with another suffix of the same row, and the longest such share.

    Prefix doubling over only those suffixes: level k ranks strings of BASE * 2^k words. The longest common prefix of suffixes
    that are adjacent in suffix order is added up over the levels, from the coarsest down.
    """
    gram, at = grams(h, row, BASE)
    gram = mix(gram + mix(row[at].astype(np.uint64)))
    order = np.argsort(gram, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    pos, rank = at[order[many]], group[many]
    if not len(pos):
        return pos, pos
    back = np.argsort(pos, kind="stable")
    pos, rank = pos[back], rank[back]
    levels = [(BASE, rank)]
    width = BASE
    while True:
        rank = levels[-1][1]
        nxt = np.searchsorted(pos, pos + width)
        found = (nxt < len(pos)) & (pos[np.minimum(nxt, len(pos) - 1)] == pos + width)
        found &= row[np.minimum(pos + width, len(row) - 1)] == row[pos]
        second = np.where(found, rank[np.minimum(nxt, len(pos) - 1)], -1 - np.arange(len(pos)))
        ahead = [word_at(h, row, pos, width + k) for k in range(BASE - 1)]  # so that neighbours share most, even where the share ends within a level
        order = np.lexsort((second, *ahead[::-1], rank))
        a, b = rank[order], second[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if new.all():
            break
        wider = np.empty(len(order), np.int64)
        wider[order] = np.cumsum(new) - 1
        width *= 2
        levels.append((width, wider))
    suffixes = order
    i, j = pos[suffixes[:-1]].copy(), pos[suffixes[1:]].copy()
    lcp = np.zeros(len(i), np.int64)
    for width, rank in reversed(levels):
        x, y = np.searchsorted(pos, i), np.searchsorted(pos, j)
        last = len(pos) - 1
        x, y = np.minimum(x, last), np.minimum(y, last)
        same = (pos[x] == i) & (pos[y] == j) & (rank[x] == rank[y])
        step = np.where(same, width, 0)
        lcp, i, j = lcp + step, i + step, j + step
    for _ in range(BASE - 1):  # what is left is shorter than the finest level
        ok = (i < len(h)) & (j < len(h))
        x, y = np.minimum(i, len(h) - 1), np.minimum(j, len(h) - 1)
        home = pos[suffixes]
        ok &= (row[x] == row[home[:-1]]) & (row[y] == row[home[1:]]) & (h[x] == h[y]) & (row[x] == row[y])
        lcp, i, j = lcp + ok, np.where(ok, i + 1, len(h)), np.where(ok, j + 1, len(h))
    best = np.zeros(len(pos), np.int64)
    best[suffixes[1:]] = lcp
    best[suffixes[:-1]] = np.maximum(best[suffixes[:-1]], lcp)
    return pos, best


def word_at(h: np.ndarray, row: np.ndarray, pos: np.ndarray, off: int) -> np.ndarray:
    """The word off places after each position; 0 past the row."""
    to = np.minimum(pos + off, len(h) - 1)
    return np.where((pos + off < len(h)) & (row[to] == row[pos]), h[to], 0)


def cover(pos: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Marks of the union of spans over n words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + length, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(ids: pa.Array, texts: pa.Array, min_repeat: int, max_covered: float, max_repeat: int) -> pa.RecordBatch:
    data, offsets = text_buffers(texts)
    rows = len(offsets) - 1
    words = scan(data, offsets)
    n = words.counts
    white = WHITE[data]
    word_chars = by_row(~white & ((data & 0xC0) != 0x80), offsets)
    symbols = by_row(SYMBOLS[data], offsets)

    lines = scan(data, offsets, NEWLINE)
    has = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    s, e, r = lines.start[has], lines.end[has], lines.row[has]
    key = mix(span_hash(data, s, e) + mix(r.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(r[order][1:][again], minlength=rows)

    h = span_hash(data, words.start, words.end)
    pos, best = repeat_lengths(h, words.row)
    triple = cover(pos, np.full(len(pos), BASE), len(h))
    repeat_words = by_row(triple, words.first)
    long = best >= min_repeat
    covered = by_row(cover(pos[long], best[long], len(h)), words.first)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, words.row[pos], best)
    base_failed = (n < 50) | (100 * repeat_words > 50 * n)
    kept = ~base_failed & (covered <= max_covered * n) & (longest <= max_repeat)
    arrays = [ids, n, word_chars, symbols, dup_lines, repeat_words, base_failed, covered, longest, kept]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names)


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.2, max_repeat: int = 50
) -> DataFrame:
    """A row per text: base counts, words covered by repeats of min_repeat words or more, the longest repeat, and the verdict."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield measure(part.column(0), part.column(1), min_repeat, max_covered, max_repeat)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(work, SCHEMA)
