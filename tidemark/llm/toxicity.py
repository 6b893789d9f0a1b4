"""Toxicity by a weighted lexicon.

Text is folded (compatibility forms, case, accents, homoglyphs, digit and symbol substitutions; everything that is neither
letter nor digit separates words) and searched by an Aho-Corasick automaton whose patterns are whole words and word
beginnings. Occurrences covered by an exception phrase don't count. A word counts with the largest weight among its patterns;
the sum of weights is normalised by the text's length, and a logistic curve turns both into a score from 0 to 1.

The lexicon's weights are log odds learned from labelled texts: a bounded sample (`sample`, in the order of a hash of the id)
of labelled rows, near copies counted once; one half learns the lexicon, the other fits the curve. Exception phrases are a few
given ones and those learned from the first half: pairs of words round a lexicon word that `min_clean` clean texts or more have
and no toxic one. Nothing but the text is an input of the score.

Defined results: null and empty texts get the score of a text without matches; unlabelled documents are scored like others;
repeated labels of one document count each; if no label of one kind exists, the score is the base rate; repeated rows give a
row each; only the id and text columns (and the label columns) are read. Texts are never cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, slices

# Letters of other scripts, and digits and symbols, that stand in for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "ⅼ": "l", "ӏ": "l", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ß": "ss", "ø": "o", "đ": "d", "ł": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l", "|": "l", "!": "i", "+": "t"}
EXCEPTIONS = ("trash can", "trash cans", "clown fish", "class clown", "scum line", "pathetic fallacy", "sore loser rule")
INNER = re.compile(r"(?<=[^\W_])[@$€£!|+](?=[^\W_])|(?<!\S)[@$€£](?=[^\W\d_])")


class Folds(dict):
    """Code point to folded string; filled as characters come."""

    def __missing__(self, code: int) -> str:
        out = []
        for ch in unicodedata.normalize("NFKD", chr(code).casefold()):
            if unicodedata.combining(ch) or unicodedata.category(ch) == "Cf":
                continue
            ch = HOMOGLYPHS.get(ch, ch)
            ch = SUBSTITUTES[ch] if ch.isdigit() and ch in SUBSTITUTES else ch
            out.append(ch if ch.isalnum() else " ")
        self[code] = "".join(out)
        return self[code]


FOLDS = Folds()


def fold(text: str) -> str:
    """Folded words, one space between and around them."""
    text = INNER.sub(lambda m: SUBSTITUTES[m[0]], text) if INNER.search(text) else text
    return " " + " ".join(text.translate(FOLDS).split()) + " "


def terms(folded: str, shortest: int = 4, longest: int = 7) -> set[str]:
    """Candidates for the lexicon: ' word ' and the beginnings ' wor' of its words."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w) - 1) + 1))
    return out


def phrases(folded: str, auto: ahocorasick.Automaton) -> set[str]:
    """Pairs of neighbouring words of which the lexicon has one."""
    words = folded.split()
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    hit = {int(np.searchsorted(starts, end - size + 1)) for end, (size, _) in auto.iter(folded)} if len(auto) else set()
    return {f"{words[i]} {words[i + 1]}" for k in hit for i in (k - 1, k) if 0 <= i < len(words) - 1}


def near_key(folded: str) -> int:
    """One minimum over hashed five-word windows: near copies mostly agree."""
    w = folded.split()
    if not w:
        return 0
    return min(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4)))


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    base: float = 0.1
    curve: list[float] = field(default_factory=list)

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            auto.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            p = fold(phrase)
            auto.add_word(p, (len(p), None))
        if len(auto):
            auto.make_automaton()
        return auto


def features(folded: str, auto: ahocorasick.Automaton) -> list[float]:
    """Summed weight, weight for its length, number of matched words, largest weight."""
    n = max(1, folded.count(" ") - 1)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(auto):
        for end, (size, weight) in auto.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, -9.0):
                best[start] = weight
    for a, b in spared:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    total = sum(best.values())
    return [math.log1p(max(total, 0.0)), math.log1p(max(total, 0.0) * 100 / n), math.log1p(len(best)), max(best.values(), default=0.0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method with a ridge on all but the constant."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    pen = np.full(len(w), ridge)
    pen[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pen * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bucket(col: str, parts: int) -> F.Column:
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(parts))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """The bounded sample: doc_id, text, toxic of the first `sample` labelled rows by a hash of the id."""
    first = labels.filter("doc_id is not null and toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    return docs.join(F.broadcast(first), "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 24_000, entries: int = 4_000, min_docs: int = 4, min_z: float = 3.0, min_clean: int = 8, exceptions: int = 1_000) -> Model:
    """Learn the lexicon and the curve. docs: doc_id, text; labels: doc_id, toxic (0 or 1)."""

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            texts = [fold(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), part.column(2), pa.array([near_key(t) for t in texts], pa.int64())],
                names=["doc_id", "folded", "toxic", "near"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pos: Counter, neg: Counter) -> pa.RecordBatch:
            names = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([pos[k] for k in names], pa.int64()), pa.array([neg[k] for k in names], pa.int64())],
                names=["term", "pos", "neg"],
            )

        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if toxic else neg).update(terms(text))
                if len(pos) + len(neg) > 300_000:
                    yield out(pos, neg)
                    pos, neg = Counter(), Counter()
        if pos or neg:
            yield out(pos, neg)

    rows = sampled(docs, labels, sample).selectExpr("doc_id", "text", "cast(toxic > 0 as int) toxic")
    once = rows.mapInArrow(folds, "doc_id long, folded string, toxic int, near long").groupBy("near", "toxic").agg(F.min(F.struct("doc_id", "folded")).alias("m"))
    once = once.selectExpr("m.doc_id", "m.folded", "toxic").persist()
    half = bucket("doc_id", 10) < 6
    sizes = {r.toxic: r.n for r in once.filter(half).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    model = Model({}, base=(n_pos + 0.5) / (n_pos + n_neg + 1))
    if n_pos and n_neg:
        counted = once.filter(half).select("folded", "toxic").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        p, q = (F.col("pos") + 0.5) / (n_pos + 1.0), (F.col("neg") + 0.5) / (n_neg + 1.0)
        odds = F.log(p / q)
        z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
        top = counted.filter(F.col("pos") >= min_docs).withColumns({"w": odds, "z": z}).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "term").limit(entries)
        model.lexicon = prune({r.term: r.w for r in top.collect()})

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = Model(model.lexicon, ()).automaton()
            for batch in batches:
                found = [(p, int(y)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in phrases(t, auto)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([y for _, y in found], pa.int64())], names=["phrase", "toxic"])

        met = once.filter(half).select("folded", "toxic").mapInArrow(meet, "phrase string, toxic long").groupBy("phrase").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
        harmless = met.filter((F.col("pos") == 0) & (F.col("neg") >= min_clean)).orderBy(F.desc("neg"), "phrase").limit(exceptions)
        model.exceptions = (*EXCEPTIONS, *(r.phrase for r in harmless.collect()))
        names = ["f0", "f1", "f2", "f3"]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = model.automaton()
            for batch in batches:
                found = np.array([features(t, auto) for t in batch.column(0).to_pylist()], float).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in found.T], batch.column(1)], names=[*names, "toxic"])

        rest = once.filter(~half).select("folded", "toxic").mapInArrow(measure, ", ".join(f"{n} double" for n in names) + ", toxic int").toArrow()
        y = rest["toxic"].to_numpy().astype(float)
        if 0 < y.sum() < len(y):
            model.curve = logistic(np.stack([rest[n].to_numpy() for n in names], 1), y).tolist()
    once.unpersist()
    return model


def prune(lexicon: dict[str, float]) -> dict[str, float]:
    """Leave out beginnings and words that a shorter beginning of at least nearly their weight covers."""
    out: dict[str, float] = {}
    for term in sorted(lexicon, key=len):
        shorter = [out[term[:k]] for k in range(5, len(term)) if term[:k] in out]
        if not shorter or lexicon[term] > max(shorter) + 0.5:
            out[term] = lexicon[term]
    return out


def probability(model: Model, found: list[float]) -> float:
    if not model.curve:
        return model.base
    x = model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], found, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def scores(texts: Iterable[str | None], model: Model, auto: ahocorasick.Automaton) -> list[float]:
    return [probability(model, features(fold(t or ""), auto)) for t in texts]


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.automaton()
        for part in slices(batches, 1):
            s = np.array(scores(part.column(1).to_pylist(), model, auto), float)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(work, "doc_id long, score double, predicted int")


def filter_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, whose score is under the threshold."""

    def keep():
        auto = model.automaton()
        return lambda texts: np.array(scores(texts.to_pylist(), model, auto), float) < threshold

    return filter_rows(docs, text_col, keep)
