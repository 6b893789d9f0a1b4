"""Queries on embeddings, labels, pages, orders: vectors, evaluation, web extraction, experiment log, streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import providers
from tidemark.functions import text as T
from tidemark.operators import evaluate, extraction, topics, vectors, web
from tidemark.plans.registry import plan, table
from tidemark.streaming import jobs


def r(c: str, name: str | None = None) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


def emb(spark: SparkSession, sf: str):
    return table(spark, sf, "embeddings")


# Vectors ------------------------------------------------------------------------------------------------------------

E = "e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@plan(
    f"with {E}, p as (select a.vec_id as query_id, b.vec_id as id, {COS} as s from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id) select query_id, id, round(s, 6) as similarity, row_number() over (partition by query_id order by s desc, id) as \"rank\" from p qualify row_number() over (partition by query_id order by s desc, id) <= 5"
)
def cosine_topk(spark, sf):
    e = emb(spark, sf)
    return vectors.top_k(e.filter("vec_id % 20 = 0"), e, 5).select("query_id", "id", r("similarity"), F.col("rank").cast("long").alias("rank"))


@plan(f"with {E} select id, round(s, 6) as similarity from (select b.vec_id as id, -list_distance(a.v, b.v) as s from e a join e b on a.vec_id = 0 and b.vec_id <> 0) order by s desc, id limit 5")
def euclidean_search(spark, sf):
    e = emb(spark, sf)
    return vectors.top_k(e.filter("vec_id = 0"), e, 5, metric="euclidean").select("id", r("similarity"))


@plan(f"with {E} select a.vec_id as id_a, b.vec_id as id_b, round({COS}, 6) as similarity from e a join e b on a.vec_id < b.vec_id where {COS} >= 0.4")
def cosine_pairs(spark, sf):
    return vectors.close_pairs(emb(spark, sf), 0.4).select("id_a", "id_b", r("similarity"))


@plan(None)
def cosine_pairs_lsh(spark, sf):
    return vectors.close_pairs_lsh(emb(spark, sf), 0.4)


@plan("select label, count(*) as n, round(avg(embedding[1]), 6) as first, round(avg(embedding[64]), 6) as last from embeddings group by 1")
def centroids(spark, sf):
    c = vectors.centroids(emb(spark, sf))
    return c.select("label", "n", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", 64), 6).alias("last"))


@plan("with g as (select vec_id % 7 as c, label, count(*) as n from embeddings group by 1, 2), t as (select c, max(n) as top, sum(n) as n from g group by 1) select round(sum(top) * 1.0 / sum(n), 6) as purity, count(*) as clusters from t")
def cluster_purity(spark, sf):
    return vectors.purity(emb(spark, sf).withColumn("c", F.col("vec_id") % 7), "c", "label").select(r("purity"), "clusters")


@plan("select label as cluster_id, count(*) as n from embeddings group by 1")
def cluster_sizes(spark, sf):
    return vectors.cluster_sizes(emb(spark, sf).withColumn("cluster_id", F.col("label")))


@plan(
    f"with {E}, s as (select a.vec_id, a.label as c, b.label as d, avg(list_distance(a.v, b.v)) as m from e a join e b on a.vec_id <> b.vec_id group by 1, 2, 3), p as (select vec_id, c, max(case when c = d then m end) as own, min(case when c <> d then m end) as near from s group by 1, 2) "
    "select round(avg(case when own is null or near is null then 0 else (near - own) / greatest(near, own) end), 6) as silhouette from p"
)
def silhouette_exact(spark, sf):
    return vectors.silhouette(emb(spark, sf)).select(r("silhouette"))


@plan(None)
def kmeans_clusters(spark, sf):
    return topics.kmeans(emb(spark, sf), 10)[0]


@plan(None)
def hdbscan_clusters(spark, sf):
    return topics.hdbscan(emb(spark, sf), 10, 5)


@plan(None)
def reduced_vectors(spark, sf):
    return topics.reduce(emb(spark, sf), 10)


@plan(None)
def hashed_embeddings(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", vectors.hash_embedding(F.col("text"), 16).alias("embedding"))


# Evaluation ---------------------------------------------------------------------------------------------------------

PAIRS = "p as (select l.doc_id, l.quality as actual, case when d.n_chars > 700 then 1 else 0 end as predicted, l.toxic, d.n_chars, d.lang from labels l join documents d using (doc_id))"


def pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("actual"), F.when(F.col("n_chars") > 700, 1).otherwise(0).alias("predicted"), "toxic", "n_chars", "lang")


COUNTS = f"{PAIRS}, n as (select count(*) filter (actual = 1 and predicted = 1) as tp, count(*) filter (actual <> 1 and predicted = 1) as fp, count(*) filter (actual = 1 and predicted <> 1) as fn, count(*) filter (actual <> 1 and predicted <> 1) as tn from p)"


@plan(f"with {COUNTS} select tp, fp, fn, tn, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) as accuracy, round(tp * 1.0 / (tp + fp), 6) as precision, round(tp * 1.0 / (tp + fn), 6) as recall, round(2.0 * tp / (2 * tp + fp + fn), 6) as f1, round(fp * 1.0 / (fp + tn), 6) as fpr from n")
def classification_metrics(spark, sf):
    return evaluate.classification(pairs(spark, sf)).select("tp", "fp", "fn", "tn", *[r(c) for c in ("accuracy", "precision", "recall", "f1", "fpr")])


@plan(f"with {COUNTS} select round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1 from n")
def macro_f1(spark, sf):
    return evaluate.macro_f1(pairs(spark, sf)).select(r("macro_f1"))


@plan(f"with {COUNTS} select 1 as class, tp + fn as support, round(tp * 1.0 / (tp + fp), 6) as precision, round(tp * 1.0 / (tp + fn), 6) as recall from n union all select 0, tn + fp, round(tn * 1.0 / (tn + fn), 6), round(tn * 1.0 / (tn + fp), 6) from n")
def per_class_metrics(spark, sf):
    return evaluate.per_class(pairs(spark, sf)).select("class", "support", r("precision"), r("recall"))


@plan(
    f"with {PAIRS}, t as (select *, timestamp '2024-01-01' + interval 1 hour * (doc_id % 5) as tp_at, timestamp '2024-01-01' + interval 1 hour * (doc_id % 3) as t_at from p where actual = 1 and predicted = 1) select round(count(*) filter (tp_at <= t_at) * 1.0 / count(*), 6) as early_rate, round(avg(epoch(t_at) - epoch(tp_at)) / 3600, 6) as lead_hours from t"
)
def trend_detection_metrics(spark, sf):
    at = lambda k: F.timestamp_seconds(F.lit(1704067200) + 3600 * (F.col("doc_id") % k))
    return evaluate.trend_detection(pairs(spark, sf).withColumns({"t_predicted": at(5), "t_actual": at(3)})).select(r("early_rate"), r("lead_hours"))


@plan(
    f"with {PAIRS}, x as (select lang, actual as rel, row_number() over (partition by lang order by n_chars desc, doc_id) as p, row_number() over (partition by lang order by actual desc, doc_id) as i from p) "
    "select lang, round(sum(case when p <= 10 then (power(2, rel) - 1) / log2(p + 1.0) else 0 end) / sum(case when i <= 10 then (power(2, rel) - 1) / log2(i + 1.0) else 0 end), 6) as ndcg from x group by 1"
)
def ndcg_at_10(spark, sf):
    return evaluate.ndcg(pairs(spark, sf), 10, ["lang"], "n_chars", "actual", "doc_id").select("lang", r("ndcg"))


@plan("with x as (select row_number() over (order by p_retailprice, p_partkey) as a, row_number() over (order by p_size, p_partkey) as b from part) select round(corr(a, b), 6) as spearman from x")
def spearman_rank(spark, sf):
    return evaluate.spearman(table(spark, sf, "part"), "p_retailprice", "p_size", "p_partkey").select(r("spearman"))


@plan("with x as (select s_suppkey as k, s_acctbal as a, s_nationkey as b from supplier) select round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) as tau from x join x y on x.k < y.k")
def kendall_tau(spark, sf):
    return evaluate.kendall(table(spark, sf, "supplier"), "s_acctbal", "s_nationkey", "s_suppkey").select(r("tau"))


@plan(f"with {PAIRS}, n as (select count(*) as n, count(*) filter (actual = toxic) as same, sum(actual) as a1, sum(toxic) as b1 from p), k as (select same * 1.0 / n as po, (a1 * 1.0 * b1 + (n - a1) * 1.0 * (n - b1)) / (n * 1.0 * n) as pe from n) select round(po, 6) as observed, round(pe, 6) as expected, round((po - pe) / (1 - pe), 6) as kappa from k")
def cohen_kappa(spark, sf):
    return evaluate.kappa(pairs(spark, sf), "actual", "toxic").select(r("observed"), r("expected"), r("kappa"))


@plan(f"with {PAIRS}, t as (select * from p order by n_chars desc, doc_id limit 20), x as (select sum(actual) as h, (select sum(actual) from p) as rel from t) select cast(20 as bigint) as k, cast(h as bigint) as hits, round(h / 20.0, 6) as precision, round(h * 1.0 / rel, 6) as recall, round(2.0 * h / (20 + rel), 6) as f1 from x")
def precision_at_k(spark, sf):
    return evaluate.precision_at_k(pairs(spark, sf), 20, "n_chars", "actual", "doc_id").select("k", "hits", r("precision"), r("recall"), r("f1"))


@plan("select count(*) as n, round(avg(l_extendedprice - l_quantity), 4) as mean, round(avg(l_extendedprice - l_quantity) * sqrt(count(*)) / stddev_samp(l_extendedprice - l_quantity), 4) as t, round(avg(l_extendedprice - l_quantity) / stddev_samp(l_extendedprice - l_quantity), 6) as cohen_d from lineitem")
def paired_t_test(spark, sf):
    out = evaluate.paired_t(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return out.select("n", F.round("mean", 4).alias("mean"), F.round("t", 4).alias("t"), r("cohen_d"))


# Experiment log -----------------------------------------------------------------------------------------------------

LOG = """log as (select cast(o_custkey as varchar) as experiment_id, o_orderdate as timestamp, o_orderpriority as method, o_totalprice / 600000 as f1, o_totalprice / 700000 as precision, o_totalprice / 800000 as recall, o_totalprice as latency_ms,
 o_orderkey % 1000 as input_tokens, o_orderkey % 100 as output_tokens, 1000 + o_orderkey % 500 as html_size, o_orderkey % 900 as cleaned_size, o_orderkey from orders)"""


def log(spark, sf):
    o = table(spark, sf, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    base = o.select(
        F.col("o_custkey").cast("string").alias("experiment_id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("method"), (p / 600000).alias("f1"), (p / 700000).alias("precision"),
        (p / 800000).alias("recall"), p.alias("latency_ms"), (k % 1000).alias("input_tokens"), (k % 100).alias("output_tokens"), (1000 + k % 500).alias("html_size"), (k % 900).alias("cleaned_size"), F.lit("a, b").alias("schema_fields"),
    )
    return evaluate.log_columns(base)


@plan(f"with {LOG} select method, round(avg(f1), 4) as f1, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(latency_ms), 4) as latency_ms, round(sum(input_tokens / 1e6 * 0.1 + output_tokens / 1e6 * 0.4), 4) as estimated_cost from log group by 1")
def experiment_log_by_method(spark, sf):
    return evaluate.by_method(log(spark, sf))


@plan(f"with {LOG} select experiment_id, max(timestamp)::date::varchar as day, count(*) as rows from log group by 1")
def experiment_log_latest(spark, sf):
    rows = log(spark, sf)
    latest = evaluate.latest_log(rows).select("experiment_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
    return latest.join(rows.groupBy("experiment_id").agg(F.count("*").alias("rows")), "experiment_id")


@plan(f"with {LOG} select method, round(avg(f1), 6) as f1, cast(sum(input_tokens + output_tokens) as bigint) as tokens, round(sum(input_tokens / 1e6 * 0.1 + output_tokens / 1e6 * 0.4), 6) as cost, round(avg(case when f1 > 0 then 1.0 else 0.0 end), 6) as success_rate from log group by 1")
def method_comparison(spark, sf):
    return evaluate.compare_methods(log(spark, sf)).select("method", r("f1"), "tokens", r("cost"), r("success_rate"))


@plan(f"with {LOG}, m as (select method, avg(f1) as v from log group by 1) select max_by(method, v) as best, round(max(v), 6) as best_value, min_by(method, v) as worst, round(min(v), 6) as worst_value from m")
def best_and_worst_method(spark, sf):
    return evaluate.best_and_worst(log(spark, sf), "f1").select("best", r("best_value"), "worst", r("worst_value"))


@plan(f"with {LOG} select experiment_id, o_orderkey, round((html_size - cleaned_size) * 100.0 / html_size, 6) as token_reduction_pct from log")
def experiment_log_columns(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("experiment_id"), (1000 + F.col("o_orderkey") % 500).alias("html_size"), (F.col("o_orderkey") % 900).alias("cleaned_size"))
    out = evaluate.log_columns(o.withColumns({"input_tokens": F.lit(0), "output_tokens": F.lit(0), "schema_fields": F.lit(""), "f1": F.lit(0.0)}))
    return out.select("experiment_id", "o_orderkey", r("token_reduction_pct"))


@plan(f"with {LOG} select count(*) as requests, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, round(sum(input_tokens / 1e6 * 0.1 + output_tokens / 1e6 * 0.4), 6) as cost from log")
def llm_totals(spark, sf):
    return evaluate.llm_totals(log(spark, sf)).select("requests", "input_tokens", "output_tokens", r("cost"))


# Web ----------------------------------------------------------------------------------------------------------------


def pages(spark, sf):
    return table(spark, sf, "pages")


def tag_count(t: str) -> str:
    return f"len(regexp_extract_all(lower(html), '<{t}[ >]')) as "


@plan(f"select page_id, {tag_count('script')} scripts, {tag_count('table')} tables, {tag_count('a')} links, {tag_count('img')} images, {tag_count('p')} paragraphs, {tag_count('meta')} metas, strlen(html) as size from pages")
def pages_tag_counts(spark, sf):
    n = ["scripts", "tables", "links", "images", "paragraphs", "metas", "size"]
    return web.tag_counts(pages(spark, sf)).select("page_id", *[F.col(c).cast("long").alias(c) for c in n])


@plan(None)
def pages_features(spark, sf):
    return web.with_features(pages(spark, sf)).drop("html")


@plan(None)
def page_classes(spark, sf):
    return web.classify(web.with_features(pages(spark, sf))).select("page_id", "page_type", "strategy", "fallbacks", "cost")


@plan(None)
def dom_clean(spark, sf):
    return web.clean_pages(pages(spark, sf)).drop("html")


@plan(None)
def page_relevance(spark, sf):
    return web.relevant(web.relevance(pages(spark, sf), ["the", "price"])).drop("text")


@plan(None)
def text_chunks(spark, sf):
    return web.chunk(table(spark, sf, "documents"), "text", "doc_id", 200, 20)


@plan(None)
def html_chunks(spark, sf):
    return web.chunk(pages(spark, sf), "html", "page_id", 300, 20, html=True)


@plan("select page_id, regexp_matches(url, '^https?://[^ ]+$') as valid from pages")
def valid_urls(spark, sf):
    return pages(spark, sf).select("page_id", web.is_valid_url(F.col("url")).alias("valid"))


@plan(
    r"select doc_id, nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') as date, nullif(regexp_extract(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+'), '') as email from documents"
)
def rule_extract(spark, sf):
    d = table(spark, sf, "documents")
    found = extraction.first_match(F.col("text"), [extraction.DATE[0]])
    return extraction.rule_extract(d).select("doc_id", found.alias("date"), "email")


@plan(None)
def sniffed_tables(spark, sf):
    d = table(spark, sf, "documents").filter("contains(text, '|')")
    return d.select("doc_id", web.sniff_table("text").alias("rows"))


# Extraction ---------------------------------------------------------------------------------------------------------

FIELDS = [("product_name", "string", True, None), ("price", "number", True, {"min": "0"}), ("rating", "number", False, {"min": "0", "max": "5"}), ("availability", "categorical", True, {"enum": "yes,no"}), ("link", "url", False, None)]


def cells(spark, sf):
    p = table(spark, sf, "part")
    i = F.col("p_partkey")
    cell = lambda f, v, s, t: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), s.alias("status"), t.alias("snippet"))
    found = F.when(i % 7 == 0, "NOT_FOUND").when(i % 5 == 0, "UNCERTAIN").otherwise("FOUND")
    rows = F.array(
        cell("product_name", F.col("p_name"), F.lit("FOUND"), F.col("p_name")),
        cell("price", F.when(i % 11 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("$"), (i - 50).cast("string"))), F.lit("FOUND"), F.lit("a snippet of middle size")),
        cell("rating", i % 12, found, F.lit(None).cast("string")),
        cell("availability", F.when(i % 2 == 0, "yes").otherwise("maybe"), found, F.lit("abc")),
    )
    return p.select(i.alias("record_id"), F.explode(rows).alias("c")).select("record_id", "c.*")


CELLS = """x as (select p_partkey as i, p_name from part), s as (select *, case when i % 7 = 0 then 'NOT_FOUND' when i % 5 = 0 then 'UNCERTAIN' else 'FOUND' end as st from x),
chk as (select i, 3 as required, case when st = 'NOT_FOUND' then 1 else 0 end as missing, case when st = 'NOT_FOUND' then 2 else 4 end as present,
 case when i % 11 = 0 then 1 when i < 50 then 2 else 0 end + case when st <> 'NOT_FOUND' and i % 12 > 5 then 1 else 0 end as errors,
 case when i % 11 = 0 or i < 50 then 1 else 0 end + case when st <> 'NOT_FOUND' and i % 12 > 5 then 1 else 0 end as bad from s)"""


@plan(f"with {CELLS} select i as record_id, round((3 - missing) / 3.0, 6) as completeness, round((present - bad) * 1.0 / present, 6) as validity, errors, (3 - missing) / 3.0 >= 0.8 and (present - bad) * 1.0 / present >= 0.8 and bad = 0 as is_valid from chk")
def validation(spark, sf):
    checked = extraction.validate(extraction.grid(cells(spark, sf), extraction.schema_frame(spark, FIELDS)))
    return extraction.validation_summary(checked, "record_id").select("record_id", r("completeness"), r("validity"), F.col("errors").cast("int").alias("errors"), "is_valid")


SIGNALS = """f as (select i, st, p_name, i - 50 as price, i % 12 as rating, case st when 'FOUND' then 1.0 when 'UNCERTAIN' then 0.5 else 0.0 end as sure from s),
g as (select i as record_id, 'product_name' as name, 0.3 + 0.25 + 0.2 * case when length(p_name) > 50 then 0.9 when length(p_name) > 20 then 0.7 when length(p_name) > 5 then 0.5 when length(p_name) > 0 then 0.3 else 0 end + 0.15 + 0.1 as confidence from f
union all select i, 'price', 0.3 + 0.25 * case when i % 11 = 0 or price < 0 then 0.1 else 1 end + 0.2 * 0.7 + 0.15 * case when i % 11 = 0 then 0.2 else 1 end + 0.1 * case when i % 11 <> 0 and price < 0 then 0.3 else 1 end from f
union all select i, 'rating', case when st = 'NOT_FOUND' then 0 else 0.3 * sure + 0.25 * case when rating > 5 then 0.1 else 1 end + 0.15 + 0.1 * case when rating > 5 then 0.3 else 1 end end from f
union all select i, 'availability', case when st = 'NOT_FOUND' then 0 else 0.3 * sure + 0.25 * case when i % 2 = 0 then 1 else 0.6 end + 0.2 * 0.3 + 0.15 + 0.1 end from f
union all select i, 'link', 0 from f)"""


@plan(f"with {CELLS}, {SIGNALS} select record_id, name, round(cast(confidence as double), 6) as confidence from g")
def confidence_scores(spark, sf):
    checked = extraction.validate(extraction.grid(cells(spark, sf), extraction.schema_frame(spark, FIELDS)))
    return extraction.confidence(checked).select("record_id", "name", r("confidence"))


@plan("select 'availability' as name where exists (select 1 from part where p_partkey % 7 = 0)")
def missing_fields(spark, sf):
    return extraction.missing_fields(extraction.validate(extraction.grid(cells(spark, sf), extraction.schema_frame(spark, FIELDS))))


@plan(
    "with p as (select p_partkey as i from part), a as (select i, case when i % 3 = 0 then 'NOT_FOUND' else 'FOUND' end as s from p where i % 5 <> 0), b as (select i, case when i % 2 = 0 then 'FOUND' else 'UNCERTAIN' end as s from p where i % 4 <> 0) "
    "select coalesce(a.i, b.i) as record_id, 'f' as field, case when b.s = 'FOUND' then 'new' when a.s = 'FOUND' then 'old' when b.i is not null then 'new' else 'old' end as value, case when b.s = 'FOUND' then b.s when a.s = 'FOUND' then a.s when b.i is not null then b.s else a.s end as status from a full join b on a.i = b.i"
)
def merged_extractions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.lit("f").alias("field"), F.lit(None).cast("string").alias("snippet"))
    a = p.filter("record_id % 5 <> 0").withColumns({"value": F.lit("old"), "status": F.when(F.col("record_id") % 3 == 0, "NOT_FOUND").otherwise("FOUND")})
    b = p.filter("record_id % 4 <> 0").withColumns({"value": F.lit("new"), "status": F.when(F.col("record_id") % 2 == 0, "FOUND").otherwise("UNCERTAIN")})
    return extraction.merge_extractions(a, b).select("record_id", "field", "value", "status")


@plan(
    "with x as (select p_size as field, p_retailprice / 3000 as confidence from part), g as (select field, avg(confidence) as m, max(confidence) - min(confidence) as s, count(*) as n from x group by 1) select field, round(greatest(0, least(1, m + case when n = 1 then 0 when s < 0.2 then 0.1 else -0.1 end)), 6) as confidence from g"
)
def multi_run_confidence(spark, sf):
    runs = table(spark, sf, "part").select(F.col("p_size").alias("field"), (F.col("p_retailprice") / 3000).alias("confidence"))
    return extraction.combine_runs(runs).select("field", r("confidence"))


@plan("select p_partkey, try_cast(regexp_replace('$ ' || p_partkey || ',5', '[₹$€£¥,\\s]', '', 'g') as double) as price from part")
def money_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.number(F.concat(F.lit("$ "), F.col("p_partkey").cast("string"), F.lit(",5"))).alias("price"))


@plan("select * from (values ('product_name', 'string'), ('price', 'number'), ('publication_date', 'date'), ('page_link', 'url')) t(name, type)")
def parsed_schema(spark, sf):
    ask = spark.createDataFrame([(1, "Extract the product name, price, publication date, and page link.")], "request_id int, requirement string")
    return extraction.parse_requirement(ask).select("name", "type")


@plan(
    "select p_partkey, 'a' as field, p_brand as value, 'FOUND' as status, 's' as snippet from part union all select p_partkey, 'b', 'bare', 'FOUND', null from part "
    "union all select p_partkey, 'c', null, 'NOT_FOUND', null from part"
)
def decoded_answers(spark, sf):
    answer = F.concat(F.lit('```json\n{"a": {"value": "'), F.col("p_brand"), F.lit('", "status": "found", "source_snippet": "s"}, "b": "bare", "c": null}\n```'))
    return extraction.decode_answer(table(spark, sf, "part").select("p_partkey", answer.alias("answer"))).drop("answer")


@plan("select conv_id, count(*) as n, cast(sum(length(text)) as bigint) as tokens, bool_and(role <> 'system') as success from conversations group by 1")
def merged_results(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk"), F.array("text").alias("records"), F.lit(1.0).alias("latency_ms"), F.length("text").alias("tokens"), (F.col("role") != "system").alias("success"))
    return extraction.merge_results(c, "conv_id").select("conv_id", F.size("records").cast("long").alias("n"), F.col("tokens").cast("long").alias("tokens"), "success")


@plan(None)
def self_correction(spark, sf):
    """Records corrected by a stand-in that finds what was missing."""
    def fix(rows):
        return rows.withColumns({"value": F.when(F.col("field") == "price", "10").when(F.col("field") == "availability", "yes").when(F.col("field") == "rating", "4").otherwise(F.col("value")), "status": F.lit("FOUND")})

    return extraction.self_correct(cells(spark, sf), extraction.schema_frame(spark, FIELDS), fix, 1)


@plan("select conv_id, turn, '{}' as answer, cast(length(coalesce(text, '')) // 4 as bigint) as input_tokens, cast(0 as bigint) as output_tokens, cast(1 as integer) as attempts, true as success from conversations")
def completions(spark, sf):
    return providers.ask(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", providers.Offline).drop("text", "latency_ms")


# Streams ------------------------------------------------------------------------------------------------------------


def stream(spark, sf):
    return jobs.read_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


@plan("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as volume, round(sum(value), 6) as engagement from events group by 1, 2")
def stream_topic_windows(spark, sf):
    out = jobs.run_once(jobs.topic_windows(stream(spark, sf)), "topic_windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "volume", r("engagement"))


@plan("select event_type as hash, count(*) as n from (select event_type from events group by 1) group by 1")
def stream_new_posts(spark, sf):
    posts = stream(spark, sf).select("ts", F.col("event_type").alias("text"))
    out = jobs.run_once(jobs.new_posts(posts, late="365 days"), "new_posts", "append")
    return out.groupBy(F.col("text").alias("hash")).agg(F.count("*").alias("n"))


@plan("select user_id, count(*) as posts, max(least(n / 5.0, 1.0)) as frequency from (select user_id, row_number() over (partition by user_id order by event_id) as n from events) group by 1")
def stream_author_frequency(spark, sf):
    out = jobs.run_once(jobs.author_frequency(stream(spark, sf)), "author_frequency", "append")
    return out.groupBy("user_id").agg(F.max("posts").alias("posts"), F.max("frequency").alias("frequency"))
