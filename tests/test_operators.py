"""Golden values of the library's own operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import providers
from tidemark.functions import text as T
from tidemark.operators import evaluate, extraction, forecast, posts, sentiment, temporal, topics, trends, vectors, web
from tidemark.sources import posts as P


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


# Temporal and trends ------------------------------------------------------------------------------------------------


def daily(spark, volumes):
    rows = [(f"{topic}{day}{i}", f"2026-08-{1 + day:02d} 10:00:00", topic, f"u{i % 5}", 1, 0, 0, 10) for topic, days in volumes.items() for day, n in enumerate(days) for i in range(n)]
    df = spark.createDataFrame(rows, "post_id string, ts string, topic string, author string, likes int, comments int, shares int, views int")
    return df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz"))


def test_temporal_aggregation(spark):
    rows = temporal.aggregate(daily(spark, {"a": [10, 20, 30]}), topic="topic").orderBy("bucket").collect()
    assert [(r.volume, r.unique_authors, r.likes) for r in rows] == [(10, 5, 10), (20, 5, 20), (30, 5, 30)]
    assert rows[0].engagement == pytest.approx(11.0)
    assert temporal.aggregate(daily(spark, {"a": [5, 10], "b": [15, 20]}), topic="topic").count() == 4


def test_growth_baseline_velocity_runs(spark):
    df = temporal.runs(temporal.features(daily(spark, {"a": [100, 200, 300]}), topic="topic")).orderBy("bucket").collect()
    assert [r.volume_growth for r in df] == [0.0, 100.0, 50.0]
    assert [r.volume_growth_absolute for r in df] == [None, 100, 100]
    assert [r.baseline_volume for r in df] == [100.0, 150.0, 200.0]
    assert [r.days_active for r in df] == [1, 2, 3] and [r.days_since_first for r in df] == [0, 1, 2]
    assert df[2].velocity == pytest.approx(50.0) and df[2].acceleration == -50.0
    assert [r.rises for r in df] == [0, 1, 2] and [r.falls for r in df] == [0, 0, 0]


def test_gaps_and_assignment(spark):
    df = temporal.aggregate(daily(spark, {"a": [1, 0, 2]}), topic="topic")
    assert df.count() == 2 and temporal.fill_gaps(df).filter("volume = 0").count() == 1
    post = spark.createDataFrame([(1,), (2,), (3,)], "post_id int")
    topic = spark.createDataFrame([(1, 5), (2, -1), (3, 6)], "post_id int, topic_id int")
    label = spark.createDataFrame([(5, "five")], "topic_id int, label string")
    assert [r.post_id for r in temporal.assign(post, topic, label).collect()] == [1]


@pytest.mark.parametrize(("v", "g", "e", "n", "want"), [(0.8, 300.0, 0.8, 0.8, 0.80), (0.5, 4.0, 0.5, 0.2, 0.4716)])
def test_score_golden(spark, v, g, e, n, want):
    df = spark.createDataFrame([(v, g, e, n)], "volume_norm double, g double, engagement_norm double, novelty double").withColumn("growth_norm", trends.growth_norm(F.col("g")))
    assert trends.score(df).first().score == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        trends.score(df, {"volume": 0.5})


@pytest.mark.parametrize(
    ("volume", "base", "growth", "rises", "falls", "cat", "conf"),
    [
        (200, 10, 2.5, 0, 0, "VIRAL", 0.625), (100, 100, 0.02, 1, 0, "RISING", 0.5), (20, 100, -0.5, 0, 1, "DECLINING", 0.6), (25, 8, 2.12, 0, 0, "VIRAL", 0.53),
        (180, 120, 0.5, 3, 0, "RISING", 0.7), (80, 150, -0.47, 0, 3, "DECLINING", 0.8), (9, 5, 0.6, 1, 0, "EMERGING", 0.8), (9, 5, -0.05, 0, 1, "STABLE", 0.7), (9, 5, None, 0, 0, "UNKNOWN", 0.0),
    ],
)
def test_categories(spark, volume, base, growth, rises, falls, cat, conf):
    g = None if growth is None else growth * 100
    df = spark.createDataFrame([(volume, float(base), g, rises, falls)], "volume int, baseline_volume double, volume_growth double, rises int, falls int")
    r = trends.early_warning(trends.classify(df)).first()
    assert (r.category, round(r.confidence, 6)) == (cat, conf)
    assert (r.early_warning is not None) == (cat == "EMERGING")
    if cat == "EMERGING":
        assert r.early_warning == pytest.approx(0.2 + 0.16 + 0.09)


# Text ---------------------------------------------------------------------------------------------------------------


def test_cleaning(spark):
    df = texts(spark, "Check out this link! https://example.com #AI @user", "Great work! 👍👍👍", "Woooooow!!!!! Amazinggggg", "ﬁne &amp; good", None)
    r = posts.clean(df).orderBy("doc_id").collect()
    assert r[0].hashtags == ["AI"] and r[0].urls == ["https://example.com"] and r[0].mentions == ["@user"]
    assert r[1].has_emoji and r[1].clean_text == "Great work! [THUMBS_UP] [THUMBS_UP] [THUMBS_UP]"
    assert r[2].clean_text == "Wooow!!! Amazinggg"
    assert r[3].clean_text == "fine & good" and r[4].clean_text == ""
    marked = posts.clean(df, urls=True, mentions=True, hashtags=True, unicode=False).orderBy("doc_id").first()
    assert marked.clean_text == "Check out this link! [URL] [HASHTAG] [MENTION]"


def test_exact_and_near_duplicates(spark):
    df = texts(spark, "Hello  World @you", "other text", "hello world", "the quick brown fox jumps", "the quick brown fox leaps", "quick THE brown fox jumps")
    g = posts.exact_groups(df).collect()
    assert [(r.n, r.first_id) for r in g] == [(2, 0)]
    s = posts.duplicate_stats(df).first()
    assert (s.total, s.unique_texts, s.duplicates, s.groups) == (6, 5, 1, 1)
    assert sorted(r.doc_id for r in posts.drop_duplicates(df, keep="last").collect()) == [1, 2, 3, 4, 5]
    assert posts.near_pairs(df, 0.95).count() == 0
    assert [(r.id_a, r.id_b) for r in posts.near_pairs(df, 0.6).collect()] == [(3, 4)]
    assert {r.id: r.class_id for r in posts.class_members(df).collect()}[5] == 3


def test_spam_golden(spark):
    df = texts(spark, "BUY NOW BUY NOW BUY NOW LIMITED TIME OFFER!!!", "Click here: http://spam1.com http://spam2.com http://spam3.com", "1234567890123", "")
    r = {x.doc_id: x for x in posts.spam(df).collect()}
    assert r[0].spam_score == pytest.approx(0.5378, abs=1e-4) and "Promotional content" in r[0].reasons
    assert r[1].spam_score == pytest.approx(0.347, abs=1e-3)
    assert r[2].malformed > 0 and r[3].spam_score == 0
    with_author = posts.spam(df.withColumn("a", F.lit("x")), author="a", order=["doc_id"]).orderBy("doc_id").collect()
    assert [x.frequency for x in with_author[:3]] == [0.2, 0.4, 0.6]


@pytest.mark.parametrize(("text", "want"), [("मशीन लर्निंग", "hi"), ("मशीन learning", "hi-en"), ("yaar kya hua", "hi-en"), ("plain words", "en"), ("12345", "unknown"), ("a", "unknown")])
def test_language(spark, text, want):
    assert posts.detect_language(texts(spark, text)).first().language == want


def test_keywords_and_hashtags(spark):
    df = texts(spark, "Alpha beta alpha #One #two", "beta beta gamma #one #Two", "#one #three")
    assert [(r.word, r.n) for r in posts.keywords(df.filter("doc_id = 0"), 2).orderBy("rank").collect()] == [("alpha", 2), ("beta", 1)]
    assert {r.tag: r.n for r in posts.hashtag_counts(df).collect()} == {"one": 3, "two": 2, "three": 1}
    edges = posts.cooccurrence(df, T.hashtags("text"), 2)
    assert [tuple(r) for r in edges.collect()] == [("one", "two", 2)]
    assert [r.tag for r in posts.cooccurring(edges, "two").collect()] == ["one"]
    snaps = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["c", "a"])], "snapshot int, words array<string>")
    assert [r.word for r in posts.trending(snaps, 1).collect()] == ["c"]
    assert posts.trending(snaps.filter("snapshot < 2"), 1).count() == 0


def test_sentiment_and_providers(spark):
    df = texts(spark, "I love this great phone!", "This is terrible and bad", "", "not good")
    r = {x.doc_id: x for x in sentiment.analyze(df).collect()}
    assert [r[i].sentiment for i in range(4)] == ["positive", "negative", "neutral", "negative"]
    assert sentiment.distribution(sentiment.analyze(df)).first().negative == 2
    made = providers.ask(df, "text", lambda: providers.Offline(lambda p: '```json\n{"sentiment": "Positive", "score": 3, "confidence": 0.5}\n```'))
    m = made.select(providers.read_sentiment("answer").alias("m")).first().m
    assert (m.sentiment, m.sentiment_score) == ("positive", 1.0)

    def fail(prompt):
        raise RuntimeError

    assert providers.ask(df, "text", lambda: providers.Offline(fail), retries=2).first().attempts == 2
    e = df.select(providers.read_emotion(F.lit('{"emotion": "joy", "intensities": {"joy": 2}}')).alias("m")).first().m
    assert e.emotion == "joy" and e.intensities["joy"] == 1.0


# Vectors, topics, forecasts -----------------------------------------------------------------------------------------


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.9, 0.1], 0), (2, [0.0, 1.0], 1), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    top = vectors.top_k(df.filter("vec_id = 0"), df, 2).orderBy("rank").collect()
    assert [r.id for r in top] == [1, 2] and top[1].similarity == 0.0
    assert [(r.id_a, r.id_b) for r in vectors.close_pairs(df, 0.9).collect()] == [(0, 1)]
    assert vectors.purity(df.withColumn("c", F.lit(1)), "c", "label").first().purity == 0.5
    assert vectors.silhouette(df.filter("label = 0")).first().silhouette == 0.0


def test_density_clusters():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), rng.uniform(-20, 20, (5, 2))])
    got = topics.hdbscan_labels(x, 10, 5)
    assert len(set(got[:40])) == 1 and len(set(got[40:80])) == 1 and got[0] != got[40] and got[0] >= 0


def test_lda_query_makes_twenty_whole_passes(spark, monkeypatch):
    from pyspark.ml.clustering import LDA

    from tidemark.plans import text_queries

    seen, fit = [], LDA._fit
    monkeypatch.setattr(LDA, "_fit", lambda self, data: (seen.append((self.getMaxIter(), self.getSubsamplingRate())), fit(self, data))[1])
    assert text_queries.lda_topics(spark, "/root/testdata/sf0.001").count() == 5
    assert seen == [(20, 1.0)]


def test_labels_and_coherence(spark):
    df = texts(spark, "apple banana apple cherry", "apple banana", "banana apple").withColumn("c", F.lit(1))
    assert topics.labels(df, "c").first().label == "apple, banana, cherry"
    r = topics.coherence(df, "c").first()
    assert 0 < r.similarity <= 1 and r.keyword_overlap > 0


def series(spark, values):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series string, ts int, value double")


def test_forecasts(spark):
    s = series(spark, [1, 2, 3, 4])
    assert [r.forecast for r in forecast.naive(s, 2).collect()] == [4.0, 4.0]
    assert [r.forecast for r in forecast.linear(s, 2).orderBy("step").collect()] == pytest.approx([5.0, 6.0])
    m = forecast.moving_average(s, 1, 2).first()
    assert (m.forecast, m.lower, m.upper) == (3.5, 3.0, 4.0)
    p = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 3.0), (2, 0.0, 1.0)], "ts int, actual double, forecast double")
    e = forecast.errors(p).first()
    assert (e.mae, round(e.mape, 6), e.direction) == (pytest.approx(2 / 3), 25.0, 100.0)


# Evaluation ---------------------------------------------------------------------------------------------------------


def test_evaluation(spark):
    p = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "actual int, predicted int")
    c = evaluate.classification(p).first()
    assert (c.tp, c.fp, c.fn, c.tn, c.accuracy) == (2, 1, 1, 1, 0.6)
    r = spark.createDataFrame([(1, 3.0, 1), (2, 2.0, 0), (3, 1.0, 1)], "id int, score double, relevance int")
    assert evaluate.ndcg(r, 3).first().ndcg == pytest.approx((1 + 0.5) / (1 + 1 / 1.5849625007), rel=1e-6)
    assert evaluate.spearman(r, "score", "id", "id").first().spearman == pytest.approx(-1.0)
    assert evaluate.kendall(r, "score", "id", "id").first().tau == -1.0
    assert evaluate.precision_at_k(r, 1, "score", "relevance", "id").first().precision == 1.0
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"])], "topic int, words array<string>")
    assert evaluate.topic_diversity(t).first().diversity == 0.75
    assert evaluate.kappa(p, "actual", "predicted").first().kappa == pytest.approx((0.6 - 0.52) / 0.48)


def test_log_keeps_the_latest(spark, tmp_path):
    row = "experiment_id string, timestamp timestamp_ntz, f1 double"
    df = spark.createDataFrame([("a", None, 0.1), ("a", None, 0.2)], row).withColumn("timestamp", F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(f1 * 10 as int))"))
    evaluate.append_log(df.filter("f1 < 0.15"), str(tmp_path / "log"))
    evaluate.append_log(df.filter("f1 > 0.15"), str(tmp_path / "log"))
    assert [r.f1 for r in evaluate.latest_log(spark.read.parquet(str(tmp_path / "log"))).collect()] == [0.2]


# Web and extraction -------------------------------------------------------------------------------------------------

PRODUCT = """<html><head><meta property="og:title" content="P"><script type="application/ld+json">{"name": "W"}</script><script>var x = {"a": 1, "b": 2, "c": 3}; var s="</p>";</script></head>
<body><nav><a href="/">Home</a></nav><article><h1>Widget one</h1><p>Price $19.99 and <b>4.5/5</b></p><p>2024-05-06</p></article><table><tr><td>1</td></tr><tr><td>2</td></tr></table><div class="cookie-banner">no</div><footer>f</footer></body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PRODUCT), (2, None), (3, "<div id=root></div><noscript>" + "needs javascript to run " * 5 + "</noscript>")], "page_id long, html string")
    f = {r.page_id: r for r in web.classify(web.with_features(df)).collect()}
    assert f[1].json_ld_count == 1 and f[1].table_rows_total == 2 and f[1].opengraph_present and f[1].page_type == "STRUCTURED" and f[1].fallbacks == ["STATIC", "DYNAMIC"]
    assert f[2].page_type == "UNKNOWN"
    c = {r.page_id: r for r in web.clean_pages(df).collect()}
    assert c[1].text.split("\n") == ["# Widget one", "Price $19.99 and 4.5/5", "2024-05-06", "1", "2"] or "# Widget one" in c[1].text
    assert c[1].json_ld == ['{"name": "W"}'] and c[1].opengraph == {"title": "P"} and len(c[1].inline_json) == 1 and c[1].title == "Widget one"
    assert "cookie" not in c[1].text and "Home" not in c[1].text
    s = web.relevance(df, ["widget"])
    assert s.filter("page_id = 1").count() >= 2 and web.relevant(s, 2.0).filter("page_id = 1").count() <= 3


def test_chunks(spark):
    body = "\n".join(f"paragraph {i} " + "x" * 50 for i in range(20))
    df = spark.createDataFrame([(1, body), (2, "short"), (3, ""), (4, "y" * 950)], "id long, text string")
    rows = web.chunk(df, "text", "id", 100, 10).orderBy("id", "chunk").collect()
    assert [r.id for r in rows].count(1) > 2 and [r.content for r in rows if r.id == 2] == ["short"]
    assert [r for r in rows if r.id == 1][1].content.startswith("[...] ") and [len(r.content) for r in rows if r.id == 4] == [400, 400, 150]
    assert not [r for r in rows if r.id == 3]


def test_extraction(spark):
    t = spark.createDataFrame([("Price: $1,299.50 rated 4.5/5 on 2024-05-06, mail a.b@c.org",)], "text string")
    r = extraction.rule_extract(t).first()
    assert (r.price, r.rating, r.date, r.email) == ("$1,299.50", "4.5", "2024-05-06", "a.b@c.org")
    schema = extraction.schema_frame(spark, [("price", "number", True, {"min": "0"}), ("rating", "number", False, None), ("link", "url", True, None)])
    cells = spark.createDataFrame(
        [(1, "price", "$5", "FOUND", "x" * 60), (1, "rating", "11", "FOUND", None), (1, "link", "http://a.b/c", "UNCERTAIN", "abc"), (2, "price", "-3", "FOUND", "s")],
        "record_id int, field string, value string, status string, snippet string",
    )
    v = {(r.record_id, r.name): r for r in extraction.confidence(extraction.validate(extraction.grid(cells, schema))).collect()}
    assert v[1, "price"].confidence == pytest.approx(0.98) and v[1, "rating"].warnings == ["unusual rating"]
    assert "negative price" in v[2, "price"].errors and v[2, "link"].missing and v[2, "link"].confidence == 0
    s = {r.record_id: r for r in extraction.validation_summary(extraction.validate(extraction.grid(cells, schema)), "record_id").collect()}
    assert s[1].is_valid and not s[2].is_valid and s[2].completeness == 0.5


# Sources ------------------------------------------------------------------------------------------------------------


def test_reading_posts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,content,created_at,username,likes\n1,"hello, there",2026-01-02T03:04:05Z,me,3\n2,,bad,you,\n')
    (tmp_path / "b.jsonl").write_text('{"id": "7", "text": "a line of it", "date": "2026-01-01"}\n\nbroken\n')
    (tmp_path / "c.json").write_text('{"posts": [{"id": 8, "text": "wrapped post", "timestamp": "2026-01-01", "engagement": {"likes": 4}}]}')
    (tmp_path / "d.json").write_text('[{"id": 9, "body": "in an array", "time": "2026-01-01", "hashtags": "a, b"}]')
    csv = P.load(spark, str(tmp_path / "a.csv"), "twitter")
    good, bad = P.validated(csv)
    assert [(r.post_id, r.text, r.platform, r.engagement.likes) for r in good.collect()] == [("1", "hello, there", "twitter", 3)]
    assert "missing text" in bad.first().errors
    assert P.load(spark, str(tmp_path / "b.jsonl")).first().post_id == "7"
    assert P.load(spark, str(tmp_path / "c.json")).first().engagement.likes == 4
    assert P.load(spark, str(tmp_path / "d.json")).first().hashtags == ["a", "b"]
    assert P.load_directory(spark, str(tmp_path)).count() >= 4
    with pytest.raises(ValueError):
        P.load(spark, "x.xml")
    P.write_csv(csv, str(tmp_path / "out"))
    P.write_json_array(csv, str(tmp_path / "array"))
    assert "engagement_likes" in spark.read.csv(str(tmp_path / "out"), header=True).columns
    assert P.from_json_rows(P.to_json_rows(csv)).count() == 2


def test_generator_is_seeded(spark):
    a, b = P.generate(spark, 50, 2), P.generate(spark, 50, 2)
    assert a.collect() == b.collect() and a.select("text").distinct().count() > 2
