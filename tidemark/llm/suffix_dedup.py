"""Removal of passages that an earlier document has: two-stage suffix sorting over candidate segments.

A byte goes if a string of `span` bytes that covers it also starts in a document with a smaller id. Every window of `span`
bytes belongs to its minimiser, the smallest of the hashed `gram`-byte strings in it (the last one among equals), which depends
on the window's content alone; neighbouring windows with one minimiser form a segment of less than twice `span` bytes. Equal
windows therefore lie in segments with equal minimisers, so that comparing segments minimiser by minimiser loses nothing.

Segments with equal bytes (minimiser, 128-bit hash and size) form a class, whose smallest document keeps it. Classes that share
a minimiser and the bytes next to it on one side, as all that share a window do, go to a suffix array: their bytes are laid end to end; only suffixes smaller than their successors are sorted
directly; one scan over the buckets of first bytes induces the rest; common prefixes of neighbours in the array join equal
windows, and each window whose smallest document is another goes. A minimiser with more than `many` classes is divided by the
bytes on its left and, once more, by those on its right: all that share a window are together in one of the two groups. Only
groups that then still have more than `many` classes are split into windows, dealt by their own hash.

Hot groups: a minimiser that (by a scan of the texts of about `probe` documents, which only plans the dealing and decides
nothing) has more than `crowd` classes is divided in that way before it is dealt. A group that then still has more than `crowd`
is dealt by segment, and all its classes are split into windows. Equal segments within a task,
and equal windows of split classes within a task (by their bytes), are combined before the shuffle; windows arrive in the order
of documents and are compared in bounded runs that carry the smallest document's along. A row whose key no other row has can
equal none and stays out of the suffix array.

Ids and positions, not texts, are shuffled to find classes; texts are dealt once, by document.

Defined results: null and empty texts have no bytes and no spans; rows with a null id are returned whole and compared with
nothing; equal rows (same id and text) are one document and each get its result; rows with one id and different texts count as
one document whose removed spans are the union; only the id and text columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, text_buffers

SPAN, GRAM = 50, 16
#: Text bytes whose windows are looked at together: a dozen numbers for each byte stand in memory meanwhile.
SCAN_BYTES = 1 << 20
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start, length, minimiser hash, two segment hashes, hash of its sides) of all segments of a run of texts."""
    none = np.zeros(0, np.int64)
    n = len(data) - gram + 1
    if len(data) < span:
        return none, none, none, *[none.astype(np.uint64)] * 4
    eight = words8(data)
    key = (eight[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[gram - 8 : gram - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
    width, have = span - gram + 1, 1
    least = key
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)
    edge = np.zeros(len(place) + 1, np.int64)  # windows that run over a text's end
    for a, b in zip(np.maximum(offsets[1:] - span + 1, offsets[:-1]), offsets[1:], strict=True):
        edge[min(a, len(place))] += 1
        edge[min(b, len(place))] -= 1
    good = np.cumsum(edge[:-1]) == 0
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~good[:-1]
    new &= good
    first = np.flatnonzero(new)
    last = np.flatnonzero(good & np.append(new[1:] | ~good[1:], True))
    row = np.searchsorted(offsets, first, "right") - 1
    at = place[first]
    mini = mix(eight[at] * np.uint64(0x9FB21C651E98DF25) + mix(eight[at + gram - 8]))
    end = last + span
    return row, first - offsets[row], end - first, mini, *span_hash2(data, first, end), sides(eight, first, end, at, span, gram)


def sides(eight: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Hashes of the bytes next to the minimiser, left in the upper and right in the lower half; 0 where the segment ends before.

    A window has span - gram bytes besides its minimiser, so that at least half of them lie on one side: segments that share a
    window share that side's half. Halves too short to read are all alike.
    """
    half = (span - gram) // 2
    out = []
    for inside, begin in ((at - half >= first, at - half), (at + gram + half <= end, at + gram)):
        h = np.zeros(len(at), np.uint64)
        for k in (*range(0, half - 8, 8), half - 8) if half >= 8 else ():
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + eight[np.where(inside, begin + k, 0)])
        out.append(np.where(inside, (h >> np.uint64(32)) | np.uint64(1), np.uint64(0)))
    return (out[0] << np.uint64(32)) | out[1]


def ways(mini: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """Keys of minimisers with the bytes on their left, and with those on their right; 0 where the segment ends before."""
    out = []
    for k, half in enumerate((side >> np.uint64(32), side & np.uint64(0xFFFFFFFF))):
        out.append(np.where(half != 0, mix(mini ^ mix(half | np.uint64((k + 1) << 32))) | np.uint64(1), np.uint64(0)))
    return out


def met(mini: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries share minimiser and (not empty) side with an entry of another document."""
    out = np.zeros(len(mini), bool)
    live = np.flatnonzero(side)
    if not len(live):
        return out
    key = mix(mini[live] ^ (side[live] * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(key)
    live, key = live[order], key[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    unlike = np.maximum.reduceat(doc[live], head) != np.minimum.reduceat(doc[live], head)
    out[live] = np.repeat(unlike, np.diff(np.append(head, len(live))))
    return out


def span_hash2(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unlike 64-bit hashes of byte spans of at least eight bytes: eight bytes a step, the last step overlapping."""
    eight = words8(data)
    a = mix((end - start).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    b = ~a
    for k in range(0, int((end - start).max(initial=0)), 8):
        live = np.flatnonzero(start + k < end)
        word = eight[np.minimum(start[live] + k, end[live] - 8)]
        a[live] = mix(a[live] * np.uint64(0xD6E8FEB86659FD93) + word)
        x = (b[live] ^ word) * np.uint64(0xA0761D6478BD642F)
        b[live] = x ^ (x >> np.uint64(32))
    return a, mix(b)


def classes(mini: np.ndarray, seg: np.ndarray, also: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (minimiser, segment, document), where classes begin in it, and which entries belong to a class's smallest document."""
    order = np.lexsort((doc, also, seg, mini))
    m, s, t, n, d = mini[order], seg[order], also[order], size[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1]) | (n[1:] != n[:-1])
    head = np.flatnonzero(new)
    lowest = np.repeat(d[head], np.diff(np.append(head, len(order))))
    return order, head, d == lowest


def pack(mini, seg, also, side, doc, start, size) -> bytes:
    """Entries in the order of documents, column by column, so that the shuffle's compression finds the small numbers."""
    step = np.diff(doc, prepend=doc[:1])
    return b"".join([np.array([len(doc), doc[0]], np.int64).tobytes(), mini.tobytes(), seg.tobytes(), also.tobytes(), side.tobytes(), step.tobytes(), start.astype(np.uint32).tobytes(), size.astype(np.uint8).tobytes()])


def unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n, first = np.frombuffer(raw, np.int64, 2)
    at = 16
    out = []
    for kind in (np.uint64, np.uint64, np.uint64, np.uint64, np.int64, np.uint32, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    mini, seg, also, side, step, start, size = out
    return mini, seg, also, side, first + np.cumsum(step), start.astype(np.int64), size.astype(np.int64)


def below(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors (the last is not)."""
    n = len(text)
    up = np.zeros(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    if len(change):
        at = np.searchsorted(change, np.arange(n - 1))
        inside = at < len(change)
        c = change[np.minimum(at, len(change) - 1)]
        up[:-1] = inside & (text[c] < text[c + 1])
    return up


def suffix_array(data: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Suffixes ordered by at least their first `depth` bytes, in two stages.

    Directly sorted: suffixes smaller than their successors. Induced: from each bucket of a first byte in turn, first the larger
    suffixes already placed in it and then its sorted smaller ones put their left neighbours, if those are larger than their
    successors, at the next free place of the neighbour's bucket.
    """
    n = len(data)
    small = below(data)
    eight = words8(data).byteswap()
    pos = np.flatnonzero(small)
    reach = -(-depth // 8) * 8
    keys = [eight[np.minimum(pos + k, n)] for k in range(0, reach, 8)]
    keys = [np.where(pos + k < n, x, 0) for k, x in zip(range(0, reach, 8), keys, strict=True)]
    pos = pos[np.lexsort((n - pos, *keys[::-1]) if n < reach else keys[::-1])] if len(pos) else pos
    first = data[pos]
    cut = np.searchsorted(first, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[data[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(source: np.ndarray, c: int) -> np.ndarray:
        left = source[source > 0] - 1
        left = left[~small[left]]
        if not len(left):
            return left
        byte = data[left]
        order = np.argsort(byte, kind="stable")
        left, byte = left[order], byte[order]
        edges = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
        same = np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(byte)), strict=True):
            if byte[a] == c:
                same = left[a:b]
            else:
                larger[byte[a]].append(left[a:b])
        return same

    for c in range(256):
        wave = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        part = pos[cut[c] : cut[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the array, up to depth; 0 for the first."""
    n = len(data)
    eight = words8(data)
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, depth, 8):
        a, b = order[live - 1] + k, order[live] + k
        inside = np.minimum(n - a, n - b)
        x = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        equal = np.full(len(live), 8)
        some = x != 0
        low = x[some] & (~x[some] + np.uint64(1))
        equal[some] = np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8
        equal = np.minimum(equal, np.maximum(inside, 0))
        lcp[live] += equal
        live = live[equal == 8]
    return np.minimum(lcp, depth)


def repeated(pieces: list[bytes], docs: np.ndarray, groups: np.ndarray, span: int = SPAN) -> list[tuple[int, int, int]]:
    """(piece, a, b): bytes of pieces covered by windows that a piece of the same group and a smaller document has too."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    end = np.cumsum(size)
    order = suffix_array(data, span)
    piece = np.searchsorted(end, order, "right")
    window = order + span <= end[piece]
    lcp = common_prefixes(data, order, span)
    run = np.cumsum(lcp < span)
    order, piece, run = order[window], piece[window], run[window]
    key = np.lexsort((docs[piece], groups[piece], run))
    order, piece, run = order[key], piece[key], run[key]
    new = np.ones(len(order), bool)
    new[1:] = (run[1:] != run[:-1]) | (groups[piece][1:] != groups[piece][:-1])
    head = np.flatnonzero(new)
    lowest = np.repeat(docs[piece[head]], np.diff(np.append(head, len(order)))) if len(head) else docs[:0]
    gone = np.sort(order[docs[piece] > lowest])
    if not len(gone):
        return []
    owner = np.searchsorted(end, gone, "right")
    cut = np.ones(len(gone), bool)
    cut[1:] = (gone[1:] > gone[:-1] + span) | (owner[1:] != owner[:-1])
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(gone)) - 1
    base = (end - size)[owner[a]]
    return list(zip(owner[a].tolist(), (gone[a] - base).tolist(), (gone[b] + span - base).tolist(), strict=True))


def crowded(source: DataFrame, span: int, probe: int, crowd: int) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and (sorted) minimisers that probably have more than `crowd` classes, with those of their ways that do.

    One scan: all texts are measured; those of about `probe` documents, chosen by a hash of the id, show how classes spread. At
    most one minimiser for each eight segments of these documents comes to the driver. If there are any, another scan of the
    chosen documents counts the classes of their ways, of which at most two for each eight segments come.
    """
    rate = min(1.0, probe / max(1, source.count()))

    def look(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in slices(batches, 1, SCAN_BYTES):
            total += int(np.sum(part.column(0).fill_null(0).to_numpy()))
            _, _, size, mini, seg, also, side = segments(*text_buffers(part.column(1)), span)
            order, head, _ = classes(mini, seg, also, size, np.zeros(len(mini), np.int64))
            keys, side = mini[order[head]], side[order[head]]
            if hot is not None:
                of = among(keys, hot)
                keys = np.concatenate(ways(keys[of], side[of]))
            found, n = np.unique(keys[keys != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["mini", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], names=["mini", "n"])

    def count(texts: DataFrame, hot: np.ndarray | None = None) -> tuple[int, np.ndarray]:
        many = texts.mapInArrow(lambda batches: look(batches, hot), "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n")).filter(F.col("mini").isNull() | (F.col("n") > max(8, crowd * rate))).toArrow()
        mini, n = many["mini"].combine_chunks(), many["n"].to_numpy()
        none = mini.is_null().to_numpy(zero_copy_only=False)
        return int(n[none].sum()), np.sort(mini.drop_null().to_numpy().view(np.uint64))

    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30))
    seen = source.select(F.octet_length("text").cast("long").alias("n"), F.when(chosen, F.col("text")).alias("text"))
    total, hot = count(seen)
    if len(hot):
        hot = np.union1d(hot, count(source.filter(chosen).select(F.lit(0).cast("long").alias("n"), "text"), hot)[1])
    return total, hot


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def alone(keys: np.ndarray) -> np.ndarray:
    """Which of a batch's ordered keys have one row in all; the batch's first and last may go on in others and never count."""
    out = np.zeros(len(keys), bool)
    out[1:-1] = (keys[1:-1] != keys[:-2]) & (keys[1:-1] != keys[2:])
    return out


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, many: int = 4000, part_bytes: int = 16 << 20, probe: int = 32_000, crowd: int = 100_000, run_bytes: int = 1 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each document."""
    spark = docs.sparkSession
    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    known = source.filter("doc_id is not null")
    total, hot = crowded(source, span, probe, crowd)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_bytes + 1)
    buckets = 4 * parts
    names = ["bucket", "entries", "doc_id", "start", "size"]

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        mini, seg, also, side, doc, start, size = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, _, keep = classes(mini, seg, also, size, doc)
        gone, order = order[~keep], order[keep]
        if len(gone):
            m = len(gone)
            yield pa.RecordBatch.from_arrays([pa.array((doc[gone] % buckets).astype(np.int32)), pa.nulls(m, pa.binary()), pa.array(doc[gone]), pa.array(start[gone]), pa.array(size[gone])], names=names)
        mini = mini[order]
        of = among(mini, hot)
        if of.any():
            both = ways(mini[of], side[order[of]])
            order = np.concatenate([order[~of], *(order[of][key != 0] for key in both)])
            mini = np.concatenate([mini[~of], *(key[key != 0] for key in both)])
        home = ((np.where(among(mini, hot), seg[order], mini) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        sort = np.lexsort((start[order], doc[order], home))
        order, mini, home = order[sort], mini[sort], home[sort]
        edge = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
        blobs, first, full = [], 0, 0  # blobs go in batches: one for each bucket and flush would cost the square of the input
        for k, (a, b) in enumerate(zip(edge, np.append(edge[1:], len(home)), strict=True)):
            i = order[a:b]
            blobs.append(pack(mini[a:b], seg[i], also[i], side[i], doc[i], start[i], size[i]))
            full += len(blobs[-1])
            if full > SCAN_BYTES or k == len(edge) - 1:
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(home[edge[first : k + 1]]), pa.array(blobs, pa.binary()), *[pa.nulls(n, pa.int64())] * 3], names=names)
                blobs, first, full = [], k + 1, 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches, 1, SCAN_BYTES):
            data, offsets = text_buffers(part.column(1))
            row, start, size, mini, seg, also, side = segments(data, offsets, span)
            if len(row):
                held.append((mini, seg, also, side, part.column(0).to_numpy()[row], start, size))
                n += len(row)
            if n > 800_000:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    shape = "kind int, key long, doc_id long, start long, size long, others binary"
    outs = ["kind", "key", "doc_id", "start", "size", "others"]

    def settle(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        """One bucket: spans that go (kind 0), and segments for the suffix array (kind 1; 2 to be split into windows)."""
        mini, seg, also, side, doc, start, size = (np.concatenate(x) for x in zip(*map(unpack, held), strict=True))
        order, head, keep = classes(mini, seg, also, size, doc)
        gone = order[~keep]
        if len(gone):
            m = len(gone)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(doc[gone]), pa.array(start[gone]), pa.array(size[gone]), pa.nulls(m, pa.binary())], names=outs)
        firsts = order[head]
        of_mini, of_side, lowest = mini[firsts], side[firsts], doc[firsts]
        dealt = among(of_mini, hot)
        ask = np.flatnonzero(met(of_mini, of_side >> np.uint64(32), lowest) | met(of_mini, of_side & np.uint64(0xFFFFFFFF), lowest) | dealt)
        if not len(ask):
            return
        _, group, size_of = np.unique(of_mini[ask], return_inverse=True, return_counts=True)
        large = (size_of[group] > many) & ~dealt[ask]
        split = dealt
        small = ask[~large & ~dealt[ask]]
        asks = [(of_mini[small], small)]
        apart = ask[large]
        for key in ways(of_mini[apart], of_side[apart]):
            _, group, size_of = np.unique(key, return_inverse=True, return_counts=True)
            n = np.where(key != 0, size_of[group], 0)
            asks.append((key[(n > 1) & (n <= many)], apart[(n > 1) & (n <= many)]))
            split[apart[n > many]] = True
        windows = np.flatnonzero(split)
        kind = np.repeat(np.array([1, 2], np.int32), [sum(len(c) for _, c in asks), len(windows)])
        key, which = (np.concatenate(x) for x in zip(*asks, (of_mini[windows], windows), strict=True))
        ask, back = np.unique(which, return_inverse=True)
        upto = np.append(head[1:], len(order))
        kept = np.concatenate([[0], np.cumsum(keep)])
        mine = order[keep]
        firsts = order[head[ask]]
        others = []
        for c in ask:
            i = mine[kept[head[c]] : kept[upto[c]]]
            others.append(np.unique(start[i])[1:].tobytes() if len(i) > 1 else None)
        first_start = np.array([int(start[mine[kept[head[c]] : kept[upto[c]]]].min()) if o is not None else int(start[f]) for c, f, o in zip(ask, firsts, others, strict=True)], np.int64)
        firsts = firsts[back]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind), pa.array(key.view(np.int64)), pa.array(doc[firsts]), pa.array(first_start[back]), pa.array(size[firsts]), pa.array(others, pa.binary()).take(pa.array(back))],
            names=outs,
        )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            loose = batch.filter(batch.column(1).is_null())
            if loose.num_rows:
                m = loose.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), loose.column(2), loose.column(3), loose.column(4), pa.nulls(m, pa.binary())], names=outs)
            packed = batch.filter(batch.column(1).is_valid())
            for b, raw in zip(packed.column(0).to_pylist(), packed.column(1).to_pylist(), strict=True):
                if b != bucket:
                    if held:
                        yield from settle(held)
                    bucket, held = b, []
                held.append(raw)
        if held:
            yield from settle(held)

    entries = known.mapInArrow(find, "bucket int, entries binary, doc_id long, start long, size long")
    found = materialise(entries.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, shape), "segments")

    wanted = found.filter("kind > 0").groupBy("doc_id").agg(F.collect_list(F.struct("kind", "key", "start", "size", "others")).alias("asks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the segments and windows asked for; windows that this task has met in a smaller document go at once (no key)."""
        least: dict[bytes, int] = {}
        for part in slices(batches, 1):
            rows = []
            for doc, text, asks in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode() if asks else b""
                for a in asks or ():
                    body = raw[a["start"] : a["start"] + a["size"]]
                    if a["kind"] == 1:
                        rows.append((a["key"], doc, a["start"], a["others"], body))
                        continue
                    starts = np.append(np.frombuffer(a["others"] or b"", np.int64), a["start"])
                    for i in range(len(body) - span + 1):
                        w = body[i : i + span]
                        if least.get(w, doc) < doc:
                            rows += [(None, doc, int(x) + i, None, None) for x in starts]
                            continue
                        if len(least) >= 1 << 19:
                            least.clear()
                        least[w] = doc
                        key = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True)
                        rows.append((key, doc, a["start"] + i, (starts[:-1] + i).tobytes() or None, w))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "doc_id", "start", "others", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            spans = []
            keys, docs, starts, others, bodies = zip(*rows, strict=True)
            for p, a, b in repeated(list(bodies), np.array(docs), np.array(keys), span):
                spans.append((docs[p], starts[p] + a, b - a))
                spans += [(docs[p], int(s) + a, b - a) for s in np.frombuffer(others[p] or b"", np.int64)]
            cols = list(zip(*spans, strict=True)) if spans else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "size"])

        rows, size, group = [], 0, 0
        most = max(run_bytes, 4 * span * many)  # no group of unsplit segments is larger
        for batch in batches:
            loose = batch.filter(batch.column(0).is_null())
            if loose.num_rows:
                yield pa.RecordBatch.from_arrays([loose.column(1), loose.column(2), pa.array(np.full(loose.num_rows, span))], names=["doc_id", "start", "size"])
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(~alone(batch.column(0).to_numpy())))
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                same = bool(rows) and row[0] == rows[-1][0]
                if group > most if same else size > run_bytes:
                    yield out(rows)
                    first: dict[bytes, tuple] = {}  # a window's documents arrive in order: the first one's row stays
                    for r in rows:
                        if r[0] == row[0]:
                            first.setdefault(r[4], r)
                    rows = list(first.values())
                    size = group = sum(len(r[4]) for r in rows)
                rows.append(row)
                size += len(row[4])
                group = group + len(row[4]) if same else len(row[4])
        if rows:
            yield out(rows)

    # An outer join like the last one, so that both read one exchange of the texts.
    asked = source.join(wanted.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.when(F.col("asks").isNotNull(), F.col("text")).alias("text"), "asks")
    bodies = asked.mapInArrow(cut, "key long, doc_id long, start long, others binary, body binary")
    dealt = F.coalesce("key", F.xxhash64("doc_id"))
    more = bodies.repartition(parts, dealt).sortWithinPartitions("key", "doc_id").mapInArrow(compare, "doc_id long, start long, size long")
    spans = found.filter("kind = 0").select("doc_id", "start", "size").unionByName(more)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for doc, text, gone in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                if not gone:
                    rows.append((doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                edge = np.zeros(len(raw) + 1, np.int64)
                a = np.minimum(np.array([g["start"] for g in gone]), len(raw))
                b = np.minimum(a + np.array([g["size"] for g in gone]), len(raw))
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                off = np.cumsum(edge[:-1]) > 0
                runs = int(np.count_nonzero(off & ~np.append(False, off[:-1])))
                left = np.frombuffer(raw, np.uint8)[~off].tobytes()
                rows.append((doc, len(raw), int(off.sum()), runs, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return source.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(remove, OUT)
