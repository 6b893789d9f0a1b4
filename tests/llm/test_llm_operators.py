"""The ten operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, decontam, html_text, lm_scoring, minhash, mixing, quality, sharding, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "a null id"), (6, "x" * 200_000), (7, "tie tie tie"), (8, "tie tie tie"), (9, "\x00 odd é 你好 ▁ ÿ")]


def test_words_and_hashes_follow_the_contract():
    texts = ["", "a  b\x0bc", None, "é\xa0x y\n", "  "]
    w = common.scan(*common.text_buffers(pa.array(texts)))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in texts for x in WORD.findall(t or "")]
    h = common.span_hash(*common.text_buffers(pa.array(["abcdefgh12", "abcdefgh12", "abcdefgh13", "", ""]))[:1], np.array([0, 10, 20, 30, 30]), np.array([10, 20, 30, 30, 30]))
    assert h[0] == h[1] != h[2] and h[3] == h[4]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_plain_join(spark, how):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 0 else id % 40 end k")
    groups = spark.createDataFrame([(0, "a"), (0, "b"), (7, "c"), (50, "d")], "k long, v string")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.spread_join(rows, groups, "k", counts, 3000, "id", how, share=16, least=20, salts=5).select("id", "k", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(groups, "k", how).select("id", "k", "v").collect()))


# 1 ------------------------------------------------------------------------------------------------------------------


def all_segmentations(word: str, pieces: lm_scoring.Pieces, d: int) -> float:
    log = {n: pieces.log[d, i] for i, n in enumerate(pieces.names)}
    marked = chr(lm_scoring.MARK) + word
    total = -math.inf
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        parts, a = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(marked[a:i])
                a = i
        lp = 0.0
        for k, part in enumerate(parts):
            if k and part[0] == chr(lm_scoring.MARK) or part not in log:
                if k and len(part) == 1 and part not in log:
                    lp += len(part.encode()) * pieces.log_byte[d]
                    continue
                lp = -math.inf
                break
            lp += log[part]
        total = np.logaddexp(total, lp)
    return total + pieces.log_stop[d]


def test_lattice_is_the_sum_over_all_segmentations():
    pieces = lm_scoring.load_pieces()
    rng = np.random.default_rng(1)
    weights = pieces.weights[0] * rng.uniform(0.5, 2, (2, len(pieces.names)))
    pieces.set_weights(weights, np.array([1e-7, 2e-7]), np.array([0.3, 0.5]))
    for word in ["the", "thndor", "ciónosgata", "x你é!!", "\U0001f600a"]:
        got = lm_scoring.lattice_all(pa.array([word]), pieces)[:, 0]
        assert got == pytest.approx([all_segmentations(word, pieces, 0), all_segmentations(word, pieces, 1)], rel=1e-9)


def test_long_words_agree_with_short_ones():
    pieces = lm_scoring.load_pieces()
    for word in ["thndor", "x你é!!" * 5, "ciónosgata" * 6]:
        a, b = np.zeros((1, len(pieces.names) + 2)), np.zeros((1, len(pieces.names) + 2))
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        short = lm_scoring.lattice(code[None], pieces, a, np.array([[3.0]]))[:, 0]
        assert short == pytest.approx(lm_scoring.lattice_long(code, pieces, b, np.array([3.0])), rel=1e-9)
        assert np.allclose(a, b)


def test_expected_uses_are_the_gradient():
    pieces = lm_scoring.load_pieces()
    uses = np.zeros((1, len(pieces.names) + 2))
    lm_scoring.lattice_all(pa.array(["thndor"]), pieces, uses, np.array([[2.0]]))
    k = pieces.names.index("or")
    before = lm_scoring.lattice_all(pa.array(["thndor"]), pieces)[0, 0]
    pieces.log[0, k] += 1e-6
    after = lm_scoring.lattice_all(pa.array(["thndor"]), pieces)[0, 0]
    assert uses[0, k] / 2 == pytest.approx((after - before) / 1e-6, rel=1e-3)


def test_scores_base_matches_brute_force_and_beats_it_where_words_are_known(spark, docs, texts):
    got = {r.doc_id: r for r in lm_scoring.score(docs, hot=500).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    lower = {i: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t)) for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in lower.items() if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, ws in lower.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    known = [r for r in got.values() if r.held_out and r.n_known >= 0.95 * r.n_tokens]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)


def test_scores_agree_whatever_is_broadcast(docs):
    few = {r.doc_id: r.score for r in lm_scoring.score(docs, hot=5).collect()}
    many = {r.doc_id: r.score for r in lm_scoring.score(docs, hot=10**6).collect()}
    assert few == pytest.approx(many, rel=1e-9)


def test_scores_edges(spark):
    got = lm_scoring.score(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(math.isfinite(r.score) for r in got)
    assert lm_scoring.score(frame(spark, [])).collect() == []


# 2 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["1d10t", "іdіоt", "ÍDIOT", "ｉｄｉｏｔ", "id​iot", "$tup1d idiot"])
def test_folding(text):
    assert " idiot " in toxicity.fold(text) or " stupid " in toxicity.fold(text)


def test_exceptions_and_length():
    model = toxicity.Model({" trash ": 3.0})
    auto = model.automaton()
    assert toxicity.features(toxicity.fold("a trash can here"), auto)[0] == 0
    short, long = toxicity.features(toxicity.fold("trash"), auto), toxicity.features(toxicity.fold("trash " + "w " * 99), auto)
    assert short[0] == long[0] and short[1] > long[1]


def test_exceptions_are_learned_from_clean_texts(spark):
    rng = random.Random(6)
    filler = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(filler) for _ in range(20)]
        toxic = i % 3 == 0
        w[5:5] = ["grumpf", rng.choice(filler)] if toxic else ["grumpf", "cheese"] if i % 3 == 1 and i % 2 else []
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(frame(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    auto = model.automaton()
    assert "grumpf cheese" in model.exceptions and any(t.startswith(" grum") for t in model.lexicon)
    clean, bad = toxicity.scores(["a fine grumpf cheese here", "a fine grumpf of a man here"], model, auto)
    assert clean < 0.3 < bad


def test_toxicity_held_out(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.bucket("doc_id", 4) == 2
    model = toxicity.fit(docs.select("doc_id", "text"), labels.filter(~held))
    rows = toxicity.score(docs, model).join(labels.filter(held), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    base = sum(r.toxic == 0 for r in rows)
    assert right > base and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, EDGES).select("doc_id", "text"), labels)
    assert toxicity.score(frame(spark, EDGES), model).count() == len(EDGES)
    assert toxicity.filter_clean(frame(spark, EDGES), model).columns == frame(spark, EDGES).columns
    empty = toxicity.fit(frame(spark, []).select("doc_id", "text"), labels.limit(0))
    assert toxicity.score(frame(spark, []), empty).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------------


def expected_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        c = out.setdefault(conv, [0, "", ""])
        c[0] += 1
        c[1] += f"{role or ''}\n{text or ''}\n"
        c[2] += (text or "") if role == "assistant" else ""
    return {k: (n, hashlib.sha256(t.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()) for k, (n, t, loss) in out.items()}


@pytest.mark.parametrize("limit", [common.SLICE_BYTES, 40])
def test_chat_round_trip(spark, sf, monkeypatch, limit):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, None, None), (None, 0, "a<|text|>b", "<\\[\\"), (None, 0, "assistant", "é<|end|>\n<")]
    table = pa.table({"conv_id": [r[0] for r in rows], "turn": [r[1] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1], rows[i][2] or "", rows[i][3] or ""))
    batches = table.take(order).combine_chunks().to_batches()
    monkeypatch.setattr(chat, "slices", lambda b, c: common.slices(b, c, limit))
    parts = list(chat.parts(iter(batches)))
    got = {r["conv_id"]: r for b in chat.digests(iter(parts)) for r in b.to_pylist()}
    want = expected_chat(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want
    assert all("[INST]" not in t and "</s>" not in t for b in parts for t in b.column(2).to_pylist())
    if limit == common.SLICE_BYTES:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert {r.conv_id: r.turns_sha256 for r in chat.read_back(chat.format_chats(df)).collect()} == {k: v[1] for k, v in want.items()}
        assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    w = WORD.findall(text or "")
    n = len(w)

    def repeats(m):
        at = collections.defaultdict(list)
        for i in range(n - m + 1):
            at[tuple(w[i : i + m])].append(i)
        return {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + m)}

    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    longest = 0
    while n >= longest + 1 and repeats(longest + 1):
        longest += 1
    longest = longest if longest >= 3 else 0
    r3, r10 = len(repeats(3)), len(repeats(10))
    failed = n < 50 or 100 * r3 > 50 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r3, failed, r10, longest, not failed and r10 <= 0.2 * n and longest <= 50)


def test_quality_matches_brute_force(spark, texts):
    rng = random.Random(3)
    rows = [(i, t) for i, t in texts.items() if len(t) < 6000][:150]
    rows += [(10**6 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 80)))) for i in range(60)]
    rows += [r for r in EDGES if r[0] is not None and r[0] != 6]
    got = sorted(tuple(r) for r in quality.quality(frame(spark, rows)).collect())
    assert got == sorted((i, *brute_quality(t)) for i, t in rows)


def test_quality_edges(spark):
    assert quality.quality(frame(spark, EDGES)).count() == len(EDGES)
    assert quality.quality(frame(spark, [])).count() == 0


# 5 ------------------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", text.lower())


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_fit_distance_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        cost, s, e = decontam.fit_distance(a, b)
        assert cost == brute_distance(a.tolist(), b.tolist()) == brute_distance(a.tolist(), b[s:e].tolist())


def test_leaks_recall_and_precision(spark, sf, docs, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    bench = {r.item_id: r.text for r in items.collect()}
    rng = random.Random(7)
    filler = [w for t in list(texts.values())[:40] for w in plain_words(t)]
    planted, rows = {}, []
    for k in range(300):
        item = rng.choice(list(bench))
        w = plain_words(bench[item])
        for _ in range(rng.randrange(0, int(0.1 * len(w)) + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["changed"], [w[at], "more"]])
        pad = [rng.choice(filler) for _ in range(rng.randrange(0, 60))]
        rows.append((10**6 + k, " ".join([*pad, *w, *pad[::-1]]).upper()))
        planted[10**6 + k] = item
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, rows), items).collect()}
    assert sum((d, i) in found for d, i in planted.items()) >= 0.99 * len(planted)
    whole = collections.defaultdict(set)
    for i, t in texts.items():
        flat = " " + " ".join(plain_words(t)) + " "
        for b, bt in bench.items():
            if " " + " ".join(plain_words(bt)) + " " in flat:
                whole[i].add(b)
    got = collections.defaultdict(set)
    for r in decontam.leaks(docs, items).collect():
        got[r.doc_id].add(r.item_id)
        assert r.distance <= 0.2 * r.item_words and brute_distance(plain_words(bench[r.item_id]), plain_words(texts[r.doc_id])[r.start_word : r.end_word]) == r.distance
    assert all(whole[i] <= got[i] for i in whole)
    clean = decontam.filter_clean(docs, items)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == set(texts) - set(got)


@pytest.mark.parametrize("even", [False, True])
def test_leaks_at_the_limit_by_item_length(spark, even):
    rng = random.Random(11)
    new = (f"w{i}" for i in itertools.count())
    bench, rows, want = [], [], {}
    for n in [8, 10, 11, 14, 15, 19, 20, 23, 24, 26, 30, 35, 40, 59]:
        for _ in range(15):
            item, edits = [next(new) for _ in range(n)], int(0.2 * n)
            places = [(k + 1) * n // (edits + 1) for k in range(edits)] if even else rng.sample(range(1, n - 1), edits)
            w = list(item)
            for at in sorted(places, reverse=True):
                w[at : at + 1] = rng.choice([[], [next(new)], [w[at], next(new)]]) if not even else [next(new)]
            bench.append((len(bench), " ".join(item)))
            want[len(rows)] = (n, edits)
            rows.append((len(rows), " ".join([next(new) for _ in range(rng.randrange(9))] + w + [next(new) for _ in range(5)])))
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(frame(spark, rows), items).collect()}
    lost = collections.Counter(n for i, (n, _) in want.items() if (i, i) not in found)
    assert not lost and all(found[i, i] <= e for i, (_, e) in want.items())
    assert decontam.filter_clean(frame(spark, rows), items).count() == 0


@pytest.mark.parametrize("block", [20_000, 12])
def test_leaks_match_brute_force(spark, block):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)]
    bench = [[rng.choice(vocabulary) for _ in range(n)] for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 31, 60, 200] for _ in range(2)]
    rows = [(0, None), (1, ""), (2, "w1"), (2, "w1"), (None, " ".join(bench[10]))]
    for k in range(150):
        w = list(rng.choice(bench)) if k % 3 else []
        for _ in range(rng.randrange(0, len(w) // 4 + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]])
        pad = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))]
        rows.append((10 + k, " ".join([*pad, *w, *pad[::-1]])))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(bench)] + [(3, " ".join(bench[3])), (900, None), (901, "")], "item_id long, text string").withColumn("doc_id", F.lit(5))
    docs = frame(spark, rows).withColumns({"item_id": F.lit(1), "start_word": F.lit("own")})
    want = collections.Counter()
    for d, t in rows:
        words = (t or "").split()
        for i, w in enumerate(bench):
            cost = brute_distance(w, words)
            if words and cost <= int(0.2 * len(w)):
                want[d, i, cost] += 1
    got = decontam.leaks(docs, items, block=block).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.distance) for r in got) == want
    kept = decontam.filter_clean(docs, items, block=block)
    dirty = {d for d, _, _ in want}
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(d for d, t in rows if d not in dirty)


def test_leaks_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "tie " * 10), (5, "tie tie tie"), (6, "word")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(frame(spark, EDGES), items).collect())
    assert got == [(4, 6, 0), (4, 6, 0), (7, 5, 0), (8, 5, 0)]
    assert decontam.leaks(frame(spark, EDGES), items, least=4).count() == 0
    assert decontam.leaks(frame(spark, []), items).count() == 0
    assert decontam.leaks(frame(spark, EDGES), items.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------------------------


def check_shards(rows, n):
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(16)), default=0) <= 1
    assert len(rows) == n
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes.get(s, 0)))


def test_sharding_keeps_groups_and_law(spark, docs, texts):
    rows = sharding.shard(docs).collect()
    check_shards(rows, len(texts))
    home = {r.doc_id: r.shard for r in rows}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    several = [g for g in groups.values() if len(g) > 1]
    assert sum(len({home[i] for i in g}) > 1 for g in several) <= 0.05 * len(several)


def test_sharding_hot_group_and_edges(spark):
    rows = [(i, "same" if i % 3 else f"other {i % 40}") for i in range(600)]
    got = sharding.shard(frame(spark, rows)).collect()
    check_shards(got, 600)
    same = collections.Counter(r.shard for r in got if r.doc_id % 3)
    assert len(same) <= 16
    check_shards(sharding.shard(frame(spark, EDGES)).collect(), len(EDGES))
    assert sharding.shard(frame(spark, [])).count() == 0


def test_sharding_cuts_no_more_than_the_best_placement_must(spark):
    """Groups that fit stay whole; a group that no quota holds is cut as the best split cuts it, found by trying all."""
    rows = [(i, f"g{i % 4}") for i in range(32)] + [(100 + i, f"own {i}") for i in range(32)]
    got = sharding.cut_edges(sharding.shard(frame(spark, rows), shards=4)).first()
    assert (got.edges, got.cut) == (4 * 28, 0)
    rows = [(i, "big") for i in range(9)] + [(100 + i, f"own {i}") for i in range(3)]
    placed = sharding.shard(frame(spark, rows), shards=3).collect()
    best = min(sum(a * b for a, b in itertools.combinations(split, 2)) for split in itertools.product(range(5), repeat=3) if sum(split) == 9)
    home = [r.shard for r in placed if r.doc_id < 100]
    cut = sum(a != b for a, b in itertools.combinations(home, 2))
    assert cut == sharding.cut_edges(spark.createDataFrame(placed, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")).first().cut
    assert best <= cut <= 27


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        more = {s for s in free if share[s] > cap * sizes[s]}
        if not more:
            return share | {s: float(cap * sizes[s]) for s in full}
        full |= more


@pytest.mark.parametrize("kind", ["corpus", "skewed"])
def test_mixing_meets_targets(spark, docs, kind):
    if kind == "skewed":
        docs = spark.createDataFrame([(i, "w " * (i % 50), "en", None if i < 20 else "tiny" if i < 23 else "big" if i < 400 else f"s{i % 4}", 1) for i in range(600)], DOCS)
    rows = mixing.mix(docs).collect()
    text = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    sizes = collections.Counter()
    for s, n in text.values():
        sizes[s] += n
    want, got = brute_targets(sizes), collections.Counter()
    assert len(rows) == len(text)
    for r in rows:
        s, n = text[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(want[s], abs=1e-6) and 0 <= r.taken <= 3 * n
        assert sum(p.words for p in r.passes) == r.taken and all(0 <= p.position <= 1 for p in r.passes)
        got[s] += r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES.values():
        rows = spark.range(101).select((F.col("id") / 100).alias("x"), mixing.invert(F.col("id") / 100, knots).alias("t")).collect()
        xs, ys = zip(*knots, strict=True)
        for r in rows:
            grid = np.linspace(0, r.t, 20001)
            assert np.trapezoid(np.interp(grid, xs, ys), grid) / np.trapezoid(np.interp(np.linspace(0, 1, 20001), xs, ys), np.linspace(0, 1, 20001)) == pytest.approx(r.x, abs=1e-6)


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark, EDGES)).count() == len(EDGES)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, ""), (2, None)])).agg({"taken": "sum"}).first()[0] == 0
    out = mixing.repeat(frame(spark, [(i, "w " * 5) for i in range(60)]))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and 40 <= out.count() <= 80


def test_repeat_keeps_sources_and_columns_apart(spark):
    rows = [(i, "w " * 5, "a" if i % 2 else None, i) for i in range(40)] + [(7, "w " * 5, None, 99)] + [(50, "x y z", "a", k) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h long").withColumnsRenamed({"h": "h"}).withColumn("n", F.lit("own")).withColumn("known", F.lit(1)).withColumn("row", F.lit(2))
    out = mixing.repeat(docs)
    assert out.columns == docs.columns
    got = out.collect()
    times = collections.Counter((r.doc_id, r.source, r.h) for r in got)
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += sum(p.whole for p in r.passes)
    have = collections.Counter()
    for (i, s, _), n in times.items():
        have[i, s] += n
    assert have == +want
    five = [times.get((50, "a", k), 0) for k in range(5)]
    assert max(five) - min(five) <= 1 and all(r.n == "own" for r in got)


# 8 ------------------------------------------------------------------------------------------------------------------


def brute_removal(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        off = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                off[k : k + span] = True
        off = off[: len(b)]
        runs = int(np.count_nonzero(off & ~np.append(False, off[:-1]))) if len(b) else 0
        out.append((i, len(b), int(off.sum()), runs, hashlib.sha256(bytes(x for x, o in zip(b, off, strict=True) if not o)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", [2, 3, 256])
def test_suffix_array_matches_sorting(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 7, 60, 400):
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        order = suffix_dedup.suffix_array(data, 24)
        raw = data.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        heads = [raw[i : i + 24] for i in order]
        assert [h.ljust(24, b"\0") for h in heads] == sorted(h.ljust(24, b"\0") for h in heads)
        lcp = suffix_dedup.common_prefixes(data, order, 24)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            want = next((x for x in range(min(len(a), len(b), 24)) if a[x] != b[x]), min(len(a), len(b), 24))
            assert lcp[k] == want


@pytest.mark.parametrize("options", [{}, {"many": 1}, {"many": 1, "crowd": 1, "run_bytes": 100}, {"many": 3, "run_bytes": 100}])
def test_suffix_dedup_matches_brute_force(spark, texts, options):
    rows = [(i, t) for i, t in texts.items() if i < 300]
    rng = random.Random(9)
    pool = ["the quick brown fox ", "aaaaaaaaaa", "ab" * 20, "é你" * 9, "x" * 60, "0123456789" * 7]
    rows += [(5000 + k, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(80)]
    passage = "every document has this passage of more than fifty bytes, in a context of its own"
    rows += [(6000 + k, f"{rng.randrange(10**9)} {passage[: rng.randrange(45, 82)]} {rng.randrange(10**9)}") for k in rng.sample(range(400), 400)]
    got = sorted(tuple(r) for r in suffix_dedup.deduplicate(frame(spark, rows), part_bytes=1 << 18, **options).collect())
    assert got == brute_removal(rows)


def test_suffix_dedup_keeps_segments_whose_hashes_share_32_bits(spark):
    a, b = "rarfzrevqczpqxehuruavmnqhzbhjokdbdzkatuxxitxgauanz", "wacqtkukcxurcjxvsruavmnqhzbhjokdbrhfxncvennxjkbolr"
    mini = suffix_dedup.segments(*common.text_buffers(pa.array([a, b])))[3]
    assert mini[0] == mini[1]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(frame(spark, [(1, a), (2, b), (3, b)])).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


@pytest.mark.parametrize("crowd", [100_000, 1000])
def test_suffix_dedup_keeps_many_unlike_texts_round_one_string(spark, crowd):
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    n = 300_000
    data = letters[rng.integers(0, 26, (n, 50))]
    data[:, 17:33] = np.frombuffer(b"ruavmnqhzbhjokdb", np.uint8)
    texts = [bytes(x).decode() for x in data]
    df = spark.createDataFrame(pa.table({"doc_id": pa.array(np.arange(n)), "text": pa.array(texts)}).to_pandas()).repartition(4)
    mini = suffix_dedup.segments(*common.text_buffers(pa.array(texts)))[3]
    assert np.unique(mini, return_counts=True)[1].max() > n / 100
    gone = suffix_dedup.deduplicate(df, crowd=crowd).filter("n_removed > 0").count()
    assert gone == n - len(set(texts)) == 0


@pytest.mark.parametrize("options", [{"many": 20}, {"many": 20, "crowd": 1}])
def test_suffix_dedup_splits_no_windows_where_sides_divide_a_minimiser(spark, monkeypatch, options):
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    text = lambda n: bytes(letters[rng.integers(0, 26, n)]).decode()
    core = "ruavmnqhzbhjokdb"
    while len({*suffix_dedup.segments(*common.text_buffers(pa.array([text(20) + core + text(20) for _ in range(40)])))[3].tolist()}) > 20:
        core = text(16)
    left, right = [text(17) for _ in range(40)], [text(18) for _ in range(40)]
    rows = [(4 * k + i, (text(9) + left[k] if i < 2 else text(26)) + core + (right[k] if i % 2 == 0 else text(18)) + text(5)) for k in range(40) for i in range(4)]
    rows += [(1000 + k, rows[4 * k][1][5:60] + text(9)) for k in range(40)]
    tables, was = [], suffix_dedup.materialise
    monkeypatch.setattr(suffix_dedup, "materialise", lambda df, name: tables.append(was(df, name)) or tables[-1])
    got = sorted(tuple(r) for r in suffix_dedup.deduplicate(frame(spark, rows), **options).collect())
    assert got == brute_removal(rows) and sum(r[2] > 0 for r in got) >= 40
    kinds = [r.kind for r in tables[0].collect()]
    assert kinds.count(1) >= 40 and kinds.count(2) == 0


def test_suffix_dedup_compares_no_row_that_is_alone():
    for keys, want in (([], []), ([4], [0]), ([4, 5], [0, 0]), ([4, 4, 5, 6, 6, 7], [0, 0, 1, 0, 0, 0]), ([1, 2, 3, 4], [0, 1, 1, 0])):
        assert suffix_dedup.alone(np.array(keys, np.int64)).tolist() == [bool(x) for x in want]


def test_segment_hashes_follow_the_bytes():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(8, 12, 3000)
    a, b = suffix_dedup.span_hash2(data, start, end)
    spans = [data[s:e].tobytes() for s, e in zip(start, end, strict=True)]
    assert len(set(spans)) == len(set(a.tolist())) == len(set(b.tolist())) == len({*zip(spans, a.tolist(), b.tolist(), strict=True)})


def test_suffix_dedup_edges(spark):
    rows = [r for r in EDGES if r[0] is not None]
    got = sorted(tuple(r) for r in suffix_dedup.deduplicate(frame(spark, EDGES)).collect() if r.doc_id is not None)
    assert got == brute_removal(rows)
    assert suffix_dedup.deduplicate(frame(spark, [])).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></li></ul></nav><div class="cookie-notice">We use cookies on this site for you</div>
<article><h1>A &amp; B</h1><p>First  paragraph
of the text that is long enough for a decision about it, because it has many words and the stop words of a language in it, as one would expect.<br>
<p>Short &lt;one&gt;.<p>Another <b>bold</b> and <a href=x>linked</a> word.</p><aside>Ad here</aside><form><input value=x>Sign up</form>
<p>Last &nbsp; one&#33; &bogus; &am</p></article><section id="comments"><p>I disagree with all of this, and the author is wrong about it in so many ways that it is hard to say.</p></section>
<footer>&copy; 2024 the site and the owner of it</footer></body></html>"""


def test_extraction_of_an_article():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "A & B",
        "First paragraph of the text that is long enough for a decision about it, because it has many words and the stop words of a language in it, as one would expect.",
        "Short <one>.",
        "Another bold and linked word.",
        "Last one! &bogus; &am",
    ]


def test_extraction_without_article():
    long = "This is a paragraph of the main text, and it has the stop words that one would expect in it, so that it is content for the rules at hand. "
    page = f"<body><div class=menu><a href=1>a</a> <a href=2>b</a></div><div><h2>Head of it</h2><p>{long}</p><p>And so on.</p><p>{long}</p></div><div><a href=1>link one</a> <a href=2>link two</a></div></body>"
    assert html_text.main_text(page).split("\n\n") == ["Head of it", long.strip(), "And so on.", long.strip()]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>cut <b", "<!-- open", "<script>x", "plain text", "<p>" * 3000 + "deep"])
def test_extraction_survives_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


LONG = "This is a paragraph of the main text, and it has the stop words that one would expect in it, so that it is content for the rules at hand."


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ('<p class="a>Hello there</p><p>and more</p>', ["Hello there", "and more"]),
        ('<p class="a>Hello there</p><p class="b">and more</p>', ["Hello there", "and more"]),
        ("<p title='it's ok'>Hello there</p>", ["Hello there"]),
        ('<p title="a > b" data-x="<b>x</b>" id=7>Hello there</p>', ["Hello there"]),
        ('<p a"b=\'c\' d>Hello there</p>', ["Hello there"]),
        ("<p class=x/>Hello there</p>", ["Hello there"]),
        ('<a href="?q=">Hello</a> there', ["Hello there"]),
        (f'<div class="search-results"><p>{LONG}</p><p>Short one.</p></div>', [LONG, "Short one."]),
        ('<h2 class="legal-title">The law of it</h2>', ["The law of it"]),
        ('<p class="social share">Real text here</p>', ["Real text here"]),
        ('<div class="share">Tell your friends</div><div class="share"><a href=x>Post</a></div>', []),
        ('<div class="ad">Buy this, and that, for the best of all prices in the world of the web and so on and on and on.</div>', []),
        ("<p>one<b>two<p>three</b>four</p>", ["onetwo", "threefour"]),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", ["one", "two", "three", "four"]),
    ],
)
def test_extraction_inside_an_article(inner, want):
    page = f"<nav><a href=1>Menu</a></nav><article><p>{LONG}</p>{inner}<p>{LONG}</p></article><footer>The end of the page</footer>"
    assert html_text.main_text(page).split("\n\n") == [LONG, *want, LONG]


def test_extraction_is_linear_in_the_page():
    import time

    n = 100_000
    pages = ["<div>" * n + LONG, "<b>" * n + "<p>x" * n, "<p>" + "<b>x" * n, "<ul><li>" * n, "</b>" * n, "<a>" * n + "</a>" * n, '<p class="a>x' * n, "<p title='x" * n, "<b><p></b>" * n, "<script>" * n, "<" * n, "<p " + "a " * n, "&" * n]
    for page in pages:
        start = time.perf_counter()
        assert isinstance(html_text.main_text(page), str)
        assert time.perf_counter() - start < 10, page[:20]


def test_extraction_of_pages_takes_the_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    import html

    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]*>?", " \n\n ", re.sub(r"</?b>|<br>", " ", body))
        assert r.text.split() == html.unescape(body).split() and r.n_chars == len(r.text)


# 10 -----------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    tried = set()
    for v in index.values():
        for a, b in itertools.combinations(v, 2):
            if (a, b) not in tried:
                tried.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(base, rng, k):
    w = base.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark, texts):
    rng = random.Random(11)
    rows = [(i, t) for i, t in texts.items() if len(t) < 20_000]
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    rows += [(20_000 - k, edited(base, rng, rng.randrange(0, 8))) for k in range(150)]  # many near the threshold, the original in between
    chain = base
    for k in range(20):
        chain = edited(chain, rng, 2)
        rows.append((30_000 + k, chain))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_pigeonhole_finds_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(2)
    symbols, radius, chunks = 24, 7, 5
    base = rng.integers(0, 9, symbols).astype(np.uint16)
    sigs = []
    for _ in range(80):
        s = base.copy()
        s[rng.choice(symbols, rng.integers(0, 6), replace=False)] = 77 + rng.integers(0, 50)
        sigs.append(s)
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "doc_id long, sig binary")
    groups = collections.defaultdict(set)
    for r in minhash.keys(df, symbols, radius, chunks).collect():
        groups[r.key].add(r.doc_id)
    together = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    for a, b in itertools.combinations(range(80), 2):
        if (sigs[a] != sigs[b]).sum() <= radius:
            assert (a, b) in together


@pytest.mark.parametrize("shape", ["none", "chain", "star", "random"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(3)
    n = 300
    edges = {"none": [], "chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]}[shape]
    names = list(range(n + 1))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges if a != b]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = [(r.node, r.root) for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in list(parent))


def test_near_duplicates_edges(spark):
    got = minhash.near_duplicates(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.kept and r.n_shingles == 0 for i in (1, 2, 3) for r in by[i])
    assert by[None][0].component_id is None and by[8][0].component_id == 7 and not by[8][0].kept
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
