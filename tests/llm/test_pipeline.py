"""The corpus pipeline stage by stage against what its operators say, and the entry point without it."""

from __future__ import annotations

import collections
import zlib

import pytest

import corpus_pipeline as cp
from tidemark.llm import decontam, minhash, mixing, queries, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input and output on the small tables."""
    from tidemark.llm.common import materialise

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        done = materialise(stage(spark, docs, SMALL), name)
        out[name] = (docs, done)
        docs = done
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    for name, (before, after) in steps.items():
        if name != "sharding":
            assert after.columns == cp.COLUMNS and [t for _, t in after.dtypes] == [t for _, t in before.select(*cp.COLUMNS).dtypes]


def test_toxicity_stage(spark, steps):
    before, after = steps["toxicity"]
    model = toxicity.fit(before.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(after) == sorted(r.doc_id for r in toxicity.score(before, model).filter("predicted = 0").collect())


def test_near_duplicate_stage(steps):
    before, after = steps["near_duplicates"]
    assert ids(after) == sorted({r.component_id for r in minhash.near_duplicates(before).collect()})


def test_near_duplicate_stage_tells_texts_of_one_id_apart(spark):
    a, b, c = ("one two three four five six seven", "other words that nobody else has here", "a third text of words without any copies")
    rows = [(5, a), (5, b), (6, a), (7, c), (7, c), (8, None), (9, ""), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, SMALL).collect())
    assert got in [collections.Counter([x, (5, b), (7, c), (8, None), (9, ""), (None, a), (None, a)]) for x in ((5, a), (6, a))]


def test_decontamination_stage(spark, steps):
    before, after = steps["decontamination"]
    leaked = {r.doc_id for r in decontam.leaks(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids(after) == sorted(set(ids(before)) - leaked)


def test_mixing_stage(steps):
    before, after = steps["mixing"]
    want = collections.Counter()
    for r in mixing.mix(before).collect():
        want[r.doc_id] += sum(p.whole for p in r.passes)
    assert collections.Counter(ids(after)) == {k: n for k, n in want.items() if n}


def test_sharding_stage(steps):
    before, after = steps["sharding"]
    rows = after.collect()
    assert sorted((r.doc_id, r.text_crc32) for r in rows) == sorted((r.doc_id, zlib.crc32(r.text.encode())) for r in before.collect())
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1


def test_empty_tables_pass(spark, steps):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = out if out.columns == cp.COLUMNS else docs


def test_null_rows_pass(spark):
    rows = [(None, "no id", None, None, None), (1, None, "en", None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "some words here", "en", "a", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == cp.COLUMNS, name
    assert cp.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
