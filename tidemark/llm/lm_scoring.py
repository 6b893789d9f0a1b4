"""Language-model scores by subword lattice likelihood.

The pieces of a public tokenizer's vocabulary span a lattice over each word; every path is a segmentation. A path begins with
a piece that carries the word mark, goes on with inner pieces, and ends with a stop; the forward recursion adds all paths'
probabilities in log space, so that a word's probability is the marginal over all its segmentations. Characters without a
piece are spelled in bytes. The vocabulary's existing scores weight all segmentations (log probabilities as they are; merge
ranks of a BPE file as Zipf weights): alone where pieces' expected uses over the training words are found, and with a share of
`existing` in every piece's final weight, which those uses fill up. Words seen in training are arcs of their own across the
whole lattice, with discounted counts; the discounts' mass goes to the lattice of pieces, so that the model is a proper
distribution over texts that grows with the corpus. The lattice thus carries all of an unknown word's probability, and the
discounted part of a known one's.

A text comes from one of a few domains (values of `domain_col` in training rows; at most `domains` of them), each with its own
counts and piece weights that back off to the common ones, and is written either afresh or partly by repeating its own words.
Which of these is not known when a text is scored: its probability is the marginal over all of them. Domain, source and id are
never inputs of a score.

Counts are exact over all training texts. At most `hot` most frequent words are broadcast (a few megabytes, whatever the corpus);
all other words meet their scores in a shuffle by a 64-bit hash of the word (among a billion distinct words the chance that any
two collide is 0.03).

Defined results: null and empty texts have one token, the end; a null id counts as training; a null domain is a domain;
repeated rows count and are returned once each; only the id, text and domain columns are read; an empty table gives an empty
table; with no training rows all words are unknown and N is 0. Texts and words are never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WHITE, materialise, mix, partitions, scan, slices, span_hash, text_buffers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
LN10 = math.log(10)
#: Code points from which a word's lattice is built on its own.
LONG = 200


class Pieces:
    """Vocabulary pieces: hash table from code point strings to log weights, for word beginnings and for inner places."""

    def __init__(self, names: list[str], weights: np.ndarray, byte_weight: float):
        self.names = names
        self.longest = max(map(len, names))
        self.begins = np.array([n[0] == chr(MARK) for n in names])
        key = np.array([string_hash(np.array([[ord(c) for c in n]], np.uint32))[-1][0] for n in names], np.uint64)
        order = np.argsort(key)
        self.key, self.index = key[order], order
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(key >> np.uint64(42)).astype(np.int64)] = True
        self.set_weights(weights[None], np.array([byte_weight]), np.array([0.4]))

    def set_weights(self, weights: np.ndarray, byte_weight: np.ndarray, stop: np.ndarray) -> None:
        """By domain (rows): relative weights of the pieces, of each of 256 bytes; the chance that a word ends after a piece."""
        self.weights, self.byte_weight = weights, byte_weight
        first = self.begins[None]
        inner = (weights * ~first).sum(1) + 256 * byte_weight
        share = np.where(first, weights / (weights * first).sum(1)[:, None], ((1 - stop) / inner)[:, None] * weights)
        self.log, self.log_byte, self.log_stop = np.log(share), np.log((1 - stop) * byte_weight / inner), np.log(stop)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose hash is a piece's, and the pieces."""
        near = np.flatnonzero(self.sieve[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.key, h[near]), len(self.key) - 1)
        ok = self.key[at] == h[near]
        return near[ok], self.index[at[ok]]


def string_hash(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the prefixes of each row of code points, one array for each length."""
    out, h = [], np.full(len(codes), 7, np.uint64)
    for j in range(codes.shape[1]):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + codes[:, j])
        out.append(h)
    return out


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces and existing scores of a sentencepiece model; control and byte pieces aside."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    names = [sp.id_to_piece(i) for i in ids]
    score = np.array([sp.get_score(i) for i in ids], float)
    usable = [k for k, n in enumerate(names) if chr(MARK) not in n[1:]]
    names, score = [names[k] for k in usable], score[usable]
    weights = 1 / (10 - score) if (score == np.round(score)).all() else np.exp(score)
    if chr(MARK) not in names:
        names.append(chr(MARK))
        weights = np.append(weights, weights.min())
    weights = weights / weights.sum()
    return Pieces(names, weights, float(weights.min()) / 4)


def utf8_bytes(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


def lattice(codes: np.ndarray, pieces: Pieces, uses: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """Log probabilities (domain, word) of words of one length: forward recursion over all segmentations.

    codes: a row of code points for each word. With uses (domain; pieces, bytes and words) and counts (domain, word), adds the
    expected uses of the words under the first domain's weights by a backward pass.
    """
    n, size = codes.shape
    marked = np.concatenate([np.full((n, 1), MARK, np.uint32), codes], axis=1)
    size += 1
    alpha = np.full((size + 1, len(pieces.log), n), -np.inf)
    alpha[0] = 0
    arcs: list[tuple[int, int, np.ndarray, np.ndarray | None, np.ndarray]] = []
    for i in range(size):
        h = np.full(n, 7, np.uint64)
        for j in range(i, min(size, i + pieces.longest)):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + marked[:, j])
            rows, which = pieces.find(h)
            ok = pieces.begins[which] == (i == 0)
            rows, which = rows[ok], which[ok]
            if len(rows):
                arcs.append((i, j + 1, rows, which, pieces.log[:, which]))
            if j == i and i:
                bare = np.ones(n, bool)
                bare[rows] = False
                rows = np.flatnonzero(bare)
                if len(rows):
                    arcs.append((i, j + 1, rows, None, utf8_bytes(marked[rows, j])[None] * pieces.log_byte[:, None]))
    for i, j, rows, _, log in arcs:
        alpha[j][:, rows] = np.logaddexp(alpha[j][:, rows], alpha[i][:, rows] + log)
    total = alpha[size]
    if uses is not None:
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        for i, j, rows, which, log in sorted(arcs, key=lambda a: -a[0]):
            through = beta[j, rows] + log[0]
            beta[i, rows] = np.logaddexp(beta[i, rows], through)
            post = np.exp(alpha[i, 0, rows] + through - total[0, rows])
            for d in range(len(counts)):
                if which is not None:
                    uses[d, : len(pieces.names)] += np.bincount(which, post * counts[d, rows], len(pieces.names))
                else:
                    uses[d, -2] += (post * counts[d, rows] * utf8_bytes(marked[rows, j - 1])).sum()
        uses[:, -1] += counts.sum(1)
    return total + pieces.log_stop[:, None]


def lattice_long(code: np.ndarray, pieces: Pieces, uses: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """lattice() of one long word: arcs of all places are found together, the recursion goes place by place."""
    marked = np.concatenate([[MARK], code]).astype(np.uint32)
    n = len(marked)
    h, start, end, piece = np.full(n, 7, np.uint64), [], [], []
    bare = np.ones(n, bool)
    for k in range(min(pieces.longest, n)):
        h = mix(h[: n - k] * np.uint64(0x9FB21C651E98DF25) + marked[k:])
        at, which = pieces.find(h)
        ok = pieces.begins[which] == (at == 0)
        at, which = at[ok], which[ok]
        if k == 0:
            bare[at] = False
        start.append(at)
        end.append(at + k + 1)
        piece.append(which)
    bare[0] = False
    left = np.flatnonzero(bare)
    start, end, piece = np.concatenate([*start, left]), np.concatenate([*end, left + 1]), np.concatenate([*piece, np.full(len(left), -1)])
    log = np.where(piece < 0, utf8_bytes(marked[start])[None] * pieces.log_byte[:, None], pieces.log[:, piece])

    def recur(frm: np.ndarray, to: np.ndarray, first: int, weight: np.ndarray) -> np.ndarray:
        out = np.full((n + 1, len(weight)), -np.inf)
        out[first] = 0
        order = np.argsort(frm if first == 0 else -frm, kind="stable")
        for a, b, w in zip(frm[order].tolist(), to[order].tolist(), weight.T[order], strict=True):
            out[b] = np.logaddexp(out[b], out[a] + w)
        return out

    alpha = recur(start, end, 0, log)
    if uses is not None:
        beta = recur(end, start, n, log[:1])
        post = np.exp(alpha[start, 0] + log[0] + beta[end, 0] - alpha[n, 0])
        for d in range(len(counts)):
            uses[d, : len(pieces.names)] += np.bincount(piece[piece >= 0], post[piece >= 0] * counts[d], len(pieces.names))
            uses[d, -2] += (post * utf8_bytes(marked[start]))[piece < 0].sum() * counts[d]
        uses[:, -1] += counts
    return alpha[n] + pieces.log_stop


def lattice_all(words: pa.Array, pieces: Pieces, uses: np.ndarray | None = None, counts: np.ndarray | None = None) -> np.ndarray:
    """lattice() over words of any length, those of one length together, in runs of bounded size."""
    out = np.zeros((len(pieces.log), len(words)))
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    text = words.to_pylist()
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        if size > LONG:
            for r in rows:
                code = np.frombuffer(text[r].encode("utf-32-le"), np.uint32)
                out[:, r] = lattice_long(code, pieces, uses, None if counts is None else counts[:, r])
            continue
        step = max(1, 200_000 // int(size + 1))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            codes = np.frombuffer("".join(text[r] for r in part).encode("utf-32-le"), np.uint32).reshape(len(part), int(size))
            out[:, part] = lattice(codes, pieces, uses, None if counts is None else counts[:, part])
    return out


def word_strings(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words as an Arrow array, their hashes, the row of each, and words per row."""
    data, offsets = text_buffers(text)
    data = LOWER[data]
    words = scan(data, offsets)
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)])
    kind, size = (pa.string(), np.int32) if ends[-1] < 2**31 else (pa.large_string(), np.int64)
    strings = pa.Array.from_buffers(kind, len(words.start), [None, pa.py_buffer(ends.astype(size)), pa.py_buffer(np.ascontiguousarray(data[~WHITE[data]]))])
    return strings, span_hash(data, words.start, words.end), words.row, words.counts


def base_log10(count: np.ndarray, tokens: int, types: int) -> np.ndarray:
    return np.log10((count + 0.5) / (tokens + 0.5 * (types + 1)))


class Discounts:
    """Discounts of counts of one, two and more, from the counts of counts, and the share of probability they free."""

    def __init__(self, tokens: int, of: list[int]):
        n1, n2, n3, n4 = (max(x, 0) for x in of)
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [k - (k + 1) * y * b / a if a else 0.75 * k for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        self.by = np.array([0.0, *(min(max(x, 0.3), k - 0.05) for k, x in enumerate(raw, 1))])
        self.tokens = max(tokens, 1)

    def whole(self, n: np.ndarray) -> np.ndarray:
        return (n - self.by[np.minimum(n, 3).astype(np.int64)]) / self.tokens

    def free(self, singles: int, doubles: int, types: int) -> float:
        return float(self.by[1] * singles + self.by[2] * doubles + self.by[3] * (types - singles - doubles)) / self.tokens


def score(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    folds: int = 5,
    held: int = 1,
    hot: int = 200_000,
    domains: int = 6,
    repeat: float = 0.1,
    existing: float = 0.25,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str | None = "lang",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == held
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(fold, F.lit(False)).alias("held_out"),
        (F.coalesce(F.col(domain_col).cast("string"), F.lit("")) if domain_col else F.lit("")).alias("domain"),
    )
    common = source.filter("not held_out").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(domains).collect()
    names = [r.domain for r in common] or [""]
    ends = source.filter("not held_out").count()
    of_domain = np.array([r.n for r in common] or [0])
    of_domain[-1] += ends - of_domain.sum()  # rarer domains join the last
    width = len(names)
    pieces = load_pieces(vocabulary)
    parts = partitions(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).group_by(["word", "d"], use_threads=False).aggregate([("n", "sum")])
            yield from whole.select(["word", "n_sum", "d"]).rename_columns(["word", "n", "d"]).to_batches()

        held, rows = [], 0
        for part in slices(batches, 1):
            train = ~part.column(2).to_numpy(zero_copy_only=False)
            place = np.array([names.index(d) if d in names else width - 1 for d in part.column(3).to_pylist()])
            words, _, row, _ = word_strings(part.column(1))
            side = np.where(train, place, -1)[row]
            for d in np.unique(side):
                both = pc.value_counts(words.filter(pa.array(side == d)))
                held.append(pa.RecordBatch.from_arrays([both.field("values").cast(pa.string()), both.field("counts"), pa.array(np.full(len(both), d, np.int32))], names=["word", "n", "d"]))
                rows += len(both)
            if rows > 1_000_000:
                yield from combined(held)
                held, rows = [], 0
        if held:
            yield from combined(held)

    columns = [f"n{d}" for d in range(width)]
    sums = [F.sum(F.when(F.col("d") == d, F.col("n")).otherwise(0)).alias(c) for d, c in enumerate(columns)]
    counted = source.mapInArrow(count, "word string, n long, d int").repartition(parts, "word").groupBy("word").agg(*sums)
    counted = materialise(counted.withColumn("n", sum((F.col(c) for c in columns), F.lit(0)).cast("long")), "words")
    facts = counted.agg(*[F.sum(c).alias(f"{c}_sum") for c in ("n", *columns)], *[F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in ("n", *columns)], *[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("n", *columns) for k in (1, 2, 3, 4)]).first().asDict()
    tokens, types = (facts["n_sum"] or 0) + ends, facts["n_types"] + (ends > 0)
    discounts, free = [], []
    for c, extra in (("n", ends), *zip(columns, of_domain.tolist(), strict=True)):
        discounts.append(Discounts((facts[f"{c}_sum"] or 0) + extra, [facts[f"{c}_{k}"] for k in (1, 2, 3, 4)]))
        free.append(discounts[-1].free(facts[f"{c}_1"], facts[f"{c}_2"], facts[f"{c}_types"]) or 1.0)

    shared = spark.sparkContext.broadcast(pieces)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in columns])

    def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        uses = np.zeros((width, len(shared.value.names) + 2))
        for batch in batches:
            lattice_all(batch.column(0), shared.value, uses, of(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(uses.size)), pa.array(uses.ravel())], names=["piece", "uses"])

    used = counted.filter("n > 0").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    uses = np.zeros(width * (len(pieces.names) + 2))
    uses[used["piece"].to_numpy()] = used["uses"].to_numpy()
    uses = uses.reshape(width, -1)
    every = uses.sum(0)
    trust = 2000.0
    common_weights = (every[:-2] + pieces.weights[0]) / (every[:-1].sum() + 1)
    common_byte = (every[-2] / 256 + pieces.byte_weight[0]) / (every[:-1].sum() + 1)
    seen = uses[:, :-1].sum(1)[:, None]
    learned = (uses[:, :-2] + trust * common_weights) / (seen + trust)
    learned_byte = (uses[:, -2] / 256 + trust * common_byte) / (seen[:, 0] + trust)
    stop = np.clip((uses[:, -1] + 0.4 * trust) / (seen[:, 0] + trust), 0.05, 0.95)
    pieces.set_weights(existing * pieces.weights[0] + (1 - existing) * learned, existing * pieces.byte_weight[0] + (1 - existing) * learned_byte, stop)
    final = spark.sparkContext.broadcast(pieces)
    logs = [f"l{d}" for d in range(width)]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0), batch.column(batch.schema.get_field_index("n")).to_numpy().astype(float)
            data, offsets = text_buffers(words)
            low = np.logaddexp(lattice_all(words, final.value) + math.log(free[0]), np.log(np.maximum(discounts[0].whole(n), 1e-300))[None])
            for d, m in enumerate(of(batch)):
                low[d] = np.logaddexp(low[d] + math.log(free[d + 1]), np.log(np.maximum(discounts[d + 1].whole(m), 1e-300)))
            key = span_hash(data, offsets[:-1], offsets[1:]).view(np.int64)
            arrays = [pa.array(key), pa.array(n.astype(np.int64)), pa.array(base_log10(n, tokens, types)), *[pa.array(x / LN10) for x in low]]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "base", *logs])

    weighed = materialise(counted.mapInArrow(weigh, "key long, n long, base double, " + ", ".join(f"{x} double" for x in logs)), "weighed")
    level = F.floor(F.log2("n") * 16)  # a thousand levels at most: the broadcast takes the uppermost that hold `hot` words together
    cut, room = math.inf, hot
    for r in weighed.filter("n > 0").groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        room -= r.words
        if room < 0:
            break
        cut = r.level
    often = weighed.filter(F.col("n") > 0).filter(level >= cut).toArrow().sort_by("key")
    top = spark.sparkContext.broadcast((often["key"].to_numpy(), often["base"].to_numpy(), np.stack([often[x].to_numpy() for x in logs])))
    end_base = float(base_log10(np.array([float(ends)]), tokens, types)[0])
    end_log = np.log10(np.maximum(of_domain - 0.5, 0.25) / np.array([x.tokens for x in discounts[1:]]))
    afresh, again = [f"a{d}" for d in range(width)], [f"r{d}" for d in range(width)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, log = top.value
        fresh = math.log10(1 - repeat)
        columns = ["id", "key", "tf", "share", "doc_id", "held_out", "n_tokens", "known", "base", *afresh, *again]
        for part in slices(batches, 1):
            ids, n = part.column(4).to_numpy(), part.num_rows
            _, h, row, counts = word_strings(part.column(1))
            place = np.arange(len(h)) - (np.cumsum(counts) - counts)[row]
            order = np.argsort(mix(h ^ mix(row.astype(np.uint64))), kind="stable")
            hs, rs, place = h[order], row[order], place[order]
            new = np.ones(len(hs), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
            first = np.flatnonzero(new)
            tf = np.diff(np.append(first, len(hs)))
            before = np.arange(len(hs)) - np.repeat(first, tf)
            share = before / np.maximum(place, 1)
            ks = hs[first].view(np.int64)
            at = np.minimum(np.searchsorted(key, ks), max(len(key) - 1, 0))
            ok = key[at] == ks if len(key) else np.zeros(len(ks), bool)
            r1 = rs[first]
            known = np.bincount(r1[ok], tf[ok], n).astype(np.int64) + (ends > 0)
            b = np.bincount(r1[ok], tf[ok] * base[at[ok]], n) + end_base
            more = np.repeat(ok, tf) & (before > 0)
            word, rows_more, shares = np.repeat(at, tf)[more], rs[more], share[more]
            fa, fr = [], []
            for d in range(width):
                l = log[d]
                fa.append(np.bincount(r1[ok], tf[ok] * l[at[ok]], n) + end_log[d])
                once = np.bincount(r1[ok], l[at[ok]] + fresh, n)
                fr.append(once + np.bincount(rows_more, np.log10((1 - repeat) * 10 ** l[word] + repeat * shares), n) + end_log[d] + fresh)
            arrays = [ids, mix(ids.astype(np.uint64)).view(np.int64), None, None, part.column(0), part.column(2), counts + 1, known, b, *fa, *fr]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * (1 + 2 * width)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if a is None else a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=columns)
            cold = np.repeat(~ok, tf)
            m = int(cold.sum())
            arrays = [ids[rs[cold]], hs[cold].view(np.int64), np.ones(m, np.int64), share[cold]]
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=False)] + [pa.nulls(m, k) for k in kinds[4:]], names=columns)

    shape = "id long, key long, tf long, share double, doc_id long, held_out boolean, n_tokens long, known long, base double, " + ", ".join(f"{x} double" for x in (*afresh, *again))
    rows = source.withColumn("id", F.monotonically_increasing_id()).mapInArrow(meet, shape)
    other = weighed.select("key", F.col("n").alias("wn"), F.col("base").alias("wb"), *logs).repartition(parts, "key").hint("shuffle_hash")
    whole = F.col("tf").isNull()
    joined = rows.repartition(parts, "key").join(other, "key", "left").select(
        "id",
        "doc_id",
        "held_out",
        "n_tokens",
        F.when(whole, F.col("known")).when(F.col("wn") > 0, 1).otherwise(0).alias("known"),
        F.when(whole, F.col("base")).otherwise(F.col("wb")).alias("base"),
        *[F.when(whole, F.col(a)).otherwise(F.col(x)).alias(a) for a, x in zip(afresh, logs, strict=True)],
        *[F.when(whole, F.col(r)).otherwise(F.log10((1 - repeat) * F.pow(F.lit(10.0), F.col(x)) + repeat * F.col("share"))).alias(r) for r, x in zip(again, logs, strict=True)],
    )
    out = joined.repartition(parts, "id").groupBy("id").agg(
        F.max("doc_id").alias("doc_id"),
        F.bool_or("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        *[F.sum(c).alias(c) for c in (*afresh, *again)],
    )
    shares = np.log10((of_domain + 1) / (of_domain + 1).sum() / 2)
    paths = [F.col(c) + float(w) for c, w in zip((*afresh, *again), (*shares, *shares), strict=True)]
    best = F.greatest(*paths)
    marginal = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in paths), F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", marginal.alias("score"))
