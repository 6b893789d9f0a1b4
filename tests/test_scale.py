"""What keeps operators whole on larger tables: plans, bounds of memory, and the same results as the plain definition."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import posts as O
from tidemark.operators import topics, vectors
from tidemark.sources import posts as P
from tidemark.streaming import jobs


@pytest.fixture(scope="module")
def points(spark):
    """600 vectors, some of them copies, one of zeros and one missing."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).astype("float32")
    x[500:520] = x[7]
    x[599] = 0
    rows = [(int(i), [float(c) for c in v], int(i % 3)) for i, v in enumerate(x)] + [(600, None, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).cache(), x.astype(float)


def cosines(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1))
    return np.divide(x @ x.T, size[:, None] * size, out=np.zeros((len(x), len(x))), where=size[:, None] * size > 0)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_k_meets_blocks_and_broadcasts_no_query_set(spark, points, metric, capsys):
    rows, x = points
    some = rows.filter("vec_id % 20 = 0 and embedding is not null")
    found = vectors.top_k(some, rows.filter("embedding is not null"), 25, metric=metric)
    assert "ArrayAggregate" not in found._jdf.queryExecution().optimizedPlan().toString() and "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    sim = cosines(x) if metric == "cosine" else -np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = found.toPandas()
    for q, part in got.groupby("query_id"):
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-round(sim[q, i], 9), i))[:25]
        assert part.sort_values("rank")["id"].tolist() == want
        assert np.allclose(part.sort_values("rank")["similarity"], sim[q, want])


def test_close_pairs_compares_matrices(spark, points):
    rows, x = points
    found = vectors.close_pairs(rows, 0.5)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    sim = cosines(x)
    got = {(r.id_a, r.id_b): r.similarity for r in found.collect()}
    want = {(i, j): sim[i, j] for i in range(600) for j in range(i + 1, 600) if sim[i, j] >= 0.5}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_close_pairs_lsh_compares_few_and_loses_few(spark, points, monkeypatch):
    rows, x = points
    sim = cosines(x)
    want = {(i, j): sim[i, j] for i in range(600) for j in range(i + 1, 600) if sim[i, j] >= 0.9}
    monkeypatch.setattr(vectors, "ROWS", 5)  # the copies' bucket is compared in blocks
    found = vectors.close_pairs_lsh(rows, 0.9).collect()
    got = {(r.id_a, r.id_b): r.similarity for r in found}
    assert len(found) == len(got) and got.keys() <= want.keys() and len(got) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    exact = [(r.id_a, r.id_b) for r in vectors.close_pairs_lsh(rows, 0.4).collect()]  # signs would save nothing
    assert sorted(exact) == [(i, j) for i in range(600) for j in range(i + 1, 600) if sim[i, j] >= 0.4]


def test_silhouette_sums_by_cluster_within_a_task(spark, points):
    rows, x = points
    got = vectors.silhouette(rows.filter("vec_id < 600"))
    assert "lambdafunction(sqrt" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    d, c = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.arange(600) % 3
    score = []
    for i in range(600):
        own = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        near = min(d[i][c == k].mean() for k in range(3) if k != c[i])
        score.append((near - own) / max(near, own))
    assert abs(got.first().silhouette - np.mean(score)) < 1e-6
    assert vectors.silhouette(rows.filter("label = 0")).first().silhouette == 0.0


def test_hash_embedding_reads_tokens_once(spark):
    rows = spark.createDataFrame([(1, "One two, two three"), (2, ""), (3, None)], "i int, text string")
    got = rows.select("i", vectors.hash_embedding(F.col("text"), 4).alias("e"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    found = {r.i: r.e for r in got.collect()}
    assert abs(sum(x * x for x in found[1]) - 1) < 1e-9 and found[2] == [0.0] * 4 and not any(found[3] or [])


def test_posts_keep_texts_and_authors_as_they_are(spark):
    texts = [" two  spaces ", "", "   ", None, "plain\n"]
    raw = spark.createDataFrame([(i, t, " me ") for i, t in enumerate(texts)], "id long, content string, username string")
    mapped = P.to_posts(raw)
    assert {int(r.post_id): r.text for r in mapped.collect()} == dict(enumerate(texts))
    assert {int(r.post_id): r.text for r in P.from_json_rows(P.to_json_rows(mapped)).collect()} == dict(enumerate(texts))
    assert {r.author_id_hash for r in mapped.collect()} == {hashlib.sha256(b" me ").hexdigest()[:16]}
    other = spark.createDataFrame([(" ", "b")], "text string, content string")
    assert P.to_posts(other).first().text == "b"


def test_json_arrays_are_bounded_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:04d}", f' say "{i}"\n' * 5, 3) for i in range(500)] + [("0007", "again", 3)] * 100, "post_id string, text string, likes int").repartition(4)
    posts = P.to_posts(rows)
    P.write_json_array(posts, str(tmp_path / "many"), most=20_000)
    parts = sorted((tmp_path / "many").glob("part-*"))
    arrays = [json.loads(p.read_text()) for p in parts]
    assert len(parts) > 4 and max(p.stat().st_size for p in parts) < 60_000
    ids = [x["post_id"] for a in arrays for x in a]
    assert len(ids) == 600 and ids == sorted(ids)
    back = P.to_posts(P.read_json(spark, str(tmp_path / "many")))
    assert sorted((r.post_id, r.text) for r in back.collect()) == sorted((r.post_id, r.text) for r in posts.collect())
    P.write_json_array(posts.limit(0), str(tmp_path / "none"))
    assert [json.loads(p.read_text()) for p in (tmp_path / "none").glob("part-*")] == [[]]
    P.write_csv(posts, str(tmp_path / "csv"))
    assert sorted(r.text for r in P.read_csv(spark, str(tmp_path / "csv")).collect()) == sorted(r.text for r in posts.collect())


def test_streams_of_rows_leave_the_driver(spark, sf):
    events = jobs.read_stream(spark, f"{sf}/events.parquet*", spark.read.parquet(f"{sf}/events.parquet").schema)
    out = jobs.run_once(jobs.author_frequency(events), "rows_of_authors")
    assert "LocalTableScan" not in out._jdf.queryExecution().optimizedPlan().toString() and "MemoryPlan" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 10_000 and out.inputFiles()


def test_mean_overlap_compares_blocks_as_matrices(spark):
    rng = np.random.default_rng(5)
    sets = [("a" if i % 3 else "b", i, [f"w{int(w)}" for w in rng.zipf(1.3, 40) % 300]) for i in range(900)] + [("one", 1000, ["x"]), ("b", 1001, [])]
    found = topics.mean_overlap(spark.createDataFrame(sets, "c string, doc_id long, ws array<string>"), "c", "ws", most=100)
    assert "array_union" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.c: r.overlap for r in found.collect()}
    for c in "ab":
        own = [set(w) for k, _, w in sets if k == c and w]
        want = np.mean([len(x & y) / len(x | y) for i, x in enumerate(own) for y in own[i + 1 :]])
        assert abs(got[c] - want) < 1e-9
    assert got["one"] == 0.0


def test_repetition_counts_in_slices(monkeypatch):
    rng = np.random.default_rng(9)
    texts = np.array(["".join(rng.choice(list("ab c"), int(n))) for n in rng.integers(0, 90, 200)], object)
    whole, sizes, work = O.repeated(texts), [], O.repeated
    monkeypatch.setattr(O, "CHARACTERS", 300)
    monkeypatch.setattr(O, "repeated", lambda t: sizes.append(sum(map(len, t))) or work(t))
    got = O.repetition.__wrapped__(pd.Series([None if t == "" else t for t in texts], index=range(5, 205)))
    assert np.array_equal(got.to_numpy(), whole) and list(got.index) == list(range(5, 205)) and max(sizes) <= 300


def test_keywords_are_counted_where_texts_are_read(spark):
    rows = spark.createDataFrame([(1, "Zeta beta zeta by alpha, beta gamma"), (2, ""), (3, None), (4, "for the")], "doc_id long, text string")
    found = O.keywords(rows, 3)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.word, r.n, r["rank"]) for r in found.collect()] == [(1, "zeta", 2, 1), (1, "beta", 2, 2), (1, "alpha", 1, 3)]


def test_minhash_pairs_meet_in_buckets_of_many_values(spark):
    rng = np.random.default_rng(11)
    base = [rng.choice(500, 60, replace=False) for _ in range(60)]
    sets = [set(np.concatenate([b[:56], rng.choice(range(500, 900), 4)]).tolist()) for b in base for _ in range(3)]
    rows = [(i, " ".join(f"w{w}" for w in s)) for i, s in enumerate(sets)] + [(1000 + i, " ".join(f"w{w}" for w in sets[0])) for i in range(300)] + [(2000, ""), (2001, None)]
    found = O.minhash_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 0.2).collect()
    got = {(r.id_a, r.id_b): r.distance for r in found}
    want = {(i, j): 1 - len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 1 - len(x & y) / len(x | y) < 0.2}
    assert len(found) == len(got) and got.keys() <= want.keys() and len(got) >= 0.9 * len(want) > 100
    assert all(abs(got[p] - want[p]) < 1e-12 for p in got)
