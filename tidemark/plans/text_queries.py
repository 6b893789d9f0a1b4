"""Queries on documents and conversations: cleaning, duplicates, spam, language, keywords, topics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import providers
from tidemark.functions import text as T
from tidemark.operators import evaluate, posts, sentiment, topics
from tidemark.plans.registry import plan, table
from tidemark.sources import posts as P


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def r(c: str, name: str | None = None) -> F.Column:
    return F.round(F.col(c).cast("double"), 6).alias(name or c)


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


WS = r"\s+"
NORM = r"trim(lower(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '@[\p{L}\p{N}_]+', '', 'g'), '\s+', ' ', 'g')))"
WORDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> '')"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def kw(stop: list[str]) -> str:
    return f"list_filter({TOKENS}, lambda x: length(x) > 3 and x not in ({quoted(stop)}))"


# Cleaning and functions ---------------------------------------------------------------------------------------------


@plan(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean_text, list_count(regexp_extract_all(text, 'https?://[!$-_a-z]+')) as urls, list_count(regexp_extract_all(text, '@([\p{L}\p{N}_]+)')) as mentions, list_count(regexp_extract_all(text, '#([\p{L}\p{N}_]+)')) as hashtags from documents")
def clean_text_plain(spark, sf):
    """Whitespace form and counts of what is extracted (no squashing, which SQL lacks)."""
    t = F.col("text")
    n = lambda c: F.size(c).cast("long")
    return docs(spark, sf).select("doc_id", T.collapse(t).alias("clean_text"), n(T.urls(t)).alias("urls"), n(T.mentions(t)).alias("mentions"), n(T.hashtags(t)).alias("hashtags"))


@plan(None)
def clean_text_full(spark, sf):
    return posts.clean(docs(spark, sf)).select("doc_id", "clean_text", "urls", "mentions", "hashtags", "has_emoji")


@plan(r"select page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) as domain, string_split(regexp_extract(url, '^https?://([^/?#]*)', 1), '.')[1] as tag from pages")
def url_domains(spark, sf):
    d = F.get(T.domains(F.col("url")), F.lit(0))
    return table(spark, sf, "pages").select("page_id", d.alias("domain"), F.get(F.split(d, r"\."), F.lit(0)).alias("tag"))


@plan(
    r"select doc_id, regexp_replace(text, '[^a-zA-Z0-9\s]', '', 'g') as plain, regexp_replace(text, '\p{Nd}+', '', 'g') as no_digits, case when length(text) > 50 then substr(text, 1, 50) || '...' else text end as preview, length(text) as chars, list_count("
    + WORDS.format("text")
    + ") as words from documents"
)
def text_forms(spark, sf):
    return docs(spark, sf).select("doc_id", T.only_alphanumeric("text").alias("plain"), T.without_numbers("text").alias("no_digits"), T.clip("text", 50).alias("preview"), F.length("text").cast("long").alias("chars"), F.size(T.words("text")).cast("long").alias("words"))


@plan("select doc_id, i as chunk, substr(text, cast(i * 6000 + 1 as bigint), 6000) as content from (select doc_id, text, unnest(generate_series(0, greatest(1, cast(ceil(length(text) / 6000.0) as bigint)) - 1)) as i from documents)")
def fixed_chunks(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.chunks("text")).alias("chunk", "content")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "content")


@plan(r"select conv_id, turn, list_count(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as tokens, md5(text) as digest from conversations where role = 'assistant'")
def conversation_tokens(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", F.size(T.tokens("text")).cast("long").alias("tokens"), F.md5(F.col("text").cast("binary")).alias("digest"))


# Posts --------------------------------------------------------------------------------------------------------------


def raw_posts(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.col("source").alias("username"), F.col("n_chars").alias("likes"), F.lit("News").alias("platform"))


@plan("select cast(doc_id as varchar) as post_id, 'news' as platform, text, substr(sha256(source), 1, 16) as author_id_hash, n_chars as likes, 0 as shares, n_chars as total_engagement from documents")
def post_mapping(spark, sf):
    p = P.to_posts(raw_posts(spark, sf))
    return p.select("post_id", "platform", "text", "author_id_hash", F.col("engagement.likes").alias("likes"), F.col("engagement.shares").cast("int").alias("shares"), P.total_engagement().alias("total_engagement"))


@plan("select count(*) filter (length(trim(text)) >= 3 and doc_id % 10 <> 0) as valid, count(*) filter (length(trim(text)) < 3 or doc_id % 10 = 0) as rejected from documents")
def post_validation(spark, sf):
    raw = raw_posts(spark, sf).withColumn("created_at", F.when(F.col("id") % 10 != 0, F.col("created_at")))
    good, bad = P.validated(P.to_posts(raw))
    return good.agg(F.count("*").alias("valid")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@plan("select cast(doc_id as varchar) as post_id, text from documents")
def post_json_round_trip(spark, sf):
    return P.from_json_rows(P.to_json_rows(P.to_posts(raw_posts(spark, sf)))).select("post_id", "text")


@plan(None)
def generated_posts(spark, sf):
    return P.generate(spark, 500, 3)


# Duplicates ---------------------------------------------------------------------------------------------------------

H = f"h as (select doc_id, text, md5({NORM}) as hash from documents)"


@plan(f"with {H} select hash, count(*) as n, min(doc_id) as first_id, arg_min(text, doc_id) as first_text from h group by 1 having count(*) > 1")
def exact_dup_groups(spark, sf):
    return posts.exact_groups(docs(spark, sf))


@plan(f"with {H}, g as (select hash, count(*) as n from h group by 1) select cast(sum(n) as bigint) as total, count(*) as unique_texts, count(*) filter (n > 1) as groups, cast(sum(n) - count(*) as bigint) as duplicates, round((sum(n) - count(*)) * 1.0 / sum(n), 6) as ratio from g")
def exact_dup_stats(spark, sf):
    return posts.duplicate_stats(docs(spark, sf)).withColumn("ratio", r("ratio"))


@plan(f"with {H} select min(doc_id) as doc_id from h group by hash")
def dedup_keep_first(spark, sf):
    return posts.drop_duplicates(docs(spark, sf)).select("doc_id")


@plan(f"with {H} select max(doc_id) as doc_id from h group by hash")
def dedup_keep_last(spark, sf):
    return posts.drop_duplicates(docs(spark, sf), keep="last").select("doc_id")


@plan(f"with {H} select doc_id from h where doc_id % 2 = 1 and hash in (select hash from h where doc_id % 2 = 0)")
def seen_hashes(spark, sf):
    d = docs(spark, sf)
    seen = d.filter("doc_id % 2 = 0").select(T.text_hash("text").alias("hash"))
    return posts.seen_before(d.filter("doc_id % 2 = 1"), seen).select("doc_id")


SETS = f"sets as (select doc_id, list_sort(list_distinct({WORDS.format('norm')})) as ws from (select doc_id, {NORM} as norm from documents)), cls as (select min(doc_id) as id, ws from sets where len(ws) > 0 group by ws)"


@plan(
    f"with {SETS}, e as (select id, len(ws) as n, unnest(ws) as w from cls), p as (select a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as common from e a join e b on a.w = b.w and a.id < b.id and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n group by 1, 2, 3, 4) "
    "select id_a, id_b, round(common * 1.0 / (na + nb - common), 6) as similarity from p where common * 1.0 / (na + nb - common) >= 0.8"
)
def near_dup_jaccard(spark, sf):
    """Pairs of word-set classes; members of classes: near_dup_members."""
    return posts.near_pairs(docs(spark, sf), 0.8).select("id_a", "id_b", r("similarity"))


@plan(f"with {SETS} select s.doc_id as id, min(t.doc_id) as class_id from sets s join sets t on s.ws = t.ws group by 1")
def near_dup_members(spark, sf):
    return posts.class_members(docs(spark, sf))


@plan(None)
def near_dup_minhash(spark, sf):
    return posts.minhash_pairs(docs(spark, sf))


# Spam ---------------------------------------------------------------------------------------------------------------

LEN = "length(text)"
SPAM = f"""w as (select doc_id, source, text, {WORDS.format('text')} as ws from documents where text <> ''),
cb as (select doc_id, max(n) * 1.0 / sum(n) as s from (select doc_id, bg, count(*) as n from (select doc_id, unnest(list_transform(generate_series(1, length(text) - 1), lambda i: substr(text, i, 2))) as bg from w) group by 1, 2) group by 1),
wb as (select doc_id, max(n) * 1.0 / sum(n) as s from (select doc_id, bg, count(*) as n from (select doc_id, unnest(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) as bg from w where len(ws) >= 3) group by 1, 2) group by 1),
wu as (select doc_id, sum(case when n > 1 then n else 0 end) * 1.0 / sum(n) as s from (select doc_id, x, count(*) as n from (select doc_id, unnest(ws) as x from w) group by 1, 2) group by 1),
c as (select w.doc_id, w.source, case when {LEN} < 10 then 0 else greatest(coalesce(cb.s, 0), coalesce(wb.s, 0), coalesce(wu.s, 0)) end as repetition,
 coalesce(list_sum(list_transform(regexp_extract_all(text, 'https?://[!$-_a-z]+'), lambda u: length(u))), 0) * 1.0 / {LEN} as url_share,
 least(({' + '.join(f"(case when contains(lower(text), '{p}') then 1 else 0 end)" for p in posts.PROMO)}) / 3.0, 1) as promotion,
 least(2.0 * length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / {LEN}, 1) as special, least(2.0 * length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) / {LEN}, 1) as digits,
 coalesce(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) * 1.0 / nullif(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 0), 0) as caps, {LEN} as n
 from w left join cb using (doc_id) left join wb using (doc_id) left join wu using (doc_id)),
s as (select doc_id, source, repetition, url_share, promotion, case when n > 10 then (special + digits + case when caps > 0.7 then caps else 0 end) / 3 else (special + digits) / 2 end as malformed from c),
spam as (select *, 0.3 * repetition + 0.2 * url_share + 0.3 * promotion + 0.1 * malformed as spam_score from s)"""


@plan(f"with {SPAM} select doc_id, round(repetition, 6) as repetition, round(url_share, 6) as url_share, round(promotion, 6) as promotion, round(malformed, 6) as malformed, round(spam_score, 6) as spam_score, spam_score > 0.3 as is_spam from spam")
def spam_score(spark, sf):
    out = posts.spam(docs(spark, sf).filter("text <> ''"), threshold=0.3)
    return out.select("doc_id", r("repetition"), r("url_share"), r("promotion"), r("malformed"), r("spam_score"), "is_spam")


@plan(f"with {SPAM} select count(*) as total, count(*) filter (spam_score > 0.3) as spam, count(*) filter (spam_score <= 0.3) as ham, round(count(*) filter (spam_score > 0.3) * 1.0 / count(*), 6) as ratio, round(avg(spam_score), 6) as avg_score from spam")
def spam_stats(spark, sf):
    return posts.spam_stats(posts.spam(docs(spark, sf).filter("text <> ''"), threshold=0.3)).select("total", "spam", "ham", r("ratio"), r("avg_score"))


@plan(f"with {SPAM} select doc_id from spam where spam_score > 0.3")
def spam_split(spark, sf):
    return posts.split_spam(posts.spam(docs(spark, sf).filter("text <> ''"), threshold=0.3))[1].select("doc_id")


WHY = " ".join(f"|| case when {c} > 0.5 then '{name}; ' else '' end" for name, c in [("High repetition", "repetition"), ("Excessive URLs", "url_share"), ("Promotional content", "promotion"), ("High posting frequency", "frequency"), ("Malformed content", "malformed")])


@plan(f"with {SPAM}, f as (select *, least(row_number() over (partition by source order by doc_id) / 5.0, 1) as frequency from spam) select doc_id, cast(frequency as double) as frequency, round(cast(spam_score + 0.1 * frequency as double), 6) as spam_score, rtrim('' {WHY}, '; ') as reasons from f")
def spam_with_authors(spark, sf):
    return posts.spam(docs(spark, sf), author="source", order=["doc_id"]).select("doc_id", "frequency", r("spam_score"), F.array_join("reasons", "; ").alias("reasons"))


# Language -----------------------------------------------------------------------------------------------------------

HITS = f"list_count(list_filter(regexp_extract_all(regexp_replace(lower(text), '[\\p{{N}}_]|[^\\x00-\\x7F]', chr(1), 'g'), '[a-z\\x01]+'), lambda x: x in ({quoted(posts.HINGLISH)})))"
LANG = f"""l as (select doc_id, lang, regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') as deva, regexp_matches(text, '[a-zA-Z]') as latin, length(trim(text)) < 3 as short, {HITS} >= 2 as mixed from documents),
d as (select doc_id, lang, case when short then 'unknown' when deva and latin then 'hi-en' when deva then 'hi' when latin and mixed then 'hi-en' when latin then 'en' else 'unknown' end as language,
 case when short then 0.0 when deva then 0.95 when latin and mixed then 0.9 when latin then 0.5 else 0.0 end as confidence, case when short then 'unknown' when deva and latin then 'mixed' when deva then 'devanagari' when latin then 'latin' else 'unknown' end as script from l)"""


@plan(f"with {LANG} select doc_id, language, cast(confidence as double) as confidence, script from d")
def language_detect(spark, sf):
    return posts.detect_language(docs(spark, sf)).select("doc_id", "language", F.col("language_confidence").alias("confidence"), "script")


@plan(f"with {LANG} select language, count(*) as n from d group by 1")
def language_distribution(spark, sf):
    return posts.detect_language(docs(spark, sf)).groupBy("language").agg(F.count("*").alias("n"))


@plan(f"with {LANG} select doc_id from d where language = 'hi-en' and confidence >= 0.8")
def language_filter(spark, sf):
    return posts.in_languages(posts.detect_language(docs(spark, sf)), ["hi-en"], 0.8).select("doc_id")


@plan(r"select doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as latin_count, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) as devanagari_count from documents")
def script_stats(spark, sf):
    s = posts.scripts(F.col("text"))
    return docs(spark, sf).select("doc_id", s["latin_count"].cast("long").alias("latin_count"), s["devanagari_count"].cast("long").alias("devanagari_count"))


# Keywords -----------------------------------------------------------------------------------------------------------

KW = f"t as (select doc_id, lang, source, {kw(T.STOP_KEYWORDS)} as ws from documents), e as (select doc_id, lang, source, unnest(ws) as word, generate_subscripts(ws, 1) as pos from t), c as (select doc_id, lang, source, word, count(*) as n, min(pos) as pos from e group by 1, 2, 3, 4)"


@plan(f"with {KW} select doc_id, word, n, row_number() over (partition by doc_id order by n desc, pos) as \"rank\" from c qualify row_number() over (partition by doc_id order by n desc, pos) <= 5")
def keyword_tf_topk(spark, sf):
    return posts.keywords(docs(spark, sf), 5).select("doc_id", "word", "n", F.col("rank").cast("long").alias("rank"))


@plan(f"with {KW}, k as (select * from c qualify row_number() over (partition by doc_id order by n desc, pos) <= 10) select word, cast(sum(n) as bigint) as n from k group by 1 order by 2 desc, 1 limit 10")
def corpus_keywords(spark, sf):
    return posts.corpus_keywords(docs(spark, sf), 10)


@plan(f"with {KW}, g as (select word, sum(n) as tf, count(*) as df from c group by 1) select word, cast(tf as bigint) as tf, df, round(tf * ln((select count(*) from documents) * 1.0 / df), 6) as score from g order by tf * ln((select count(*) from documents) * 1.0 / df) desc, word limit 50")
def tfidf_rank(spark, sf):
    return posts.tfidf(docs(spark, sf), 50).select("word", "tf", "df", r("score"))


TAGS = f"g as (select doc_id, list_sort(list_distinct(list_filter({TOKENS}, lambda x: length(x) >= 12))) as tags from documents)"


def tags() -> F.Column:
    return F.filter(T.tokens("text"), lambda w: F.length(w) >= 12)


@plan(f"with {TAGS}, e as (select doc_id, unnest(tags) as tag from g) select tag, count(*) as n from e group by 1 order by 2 desc, 1 limit 20")
def top_hashtags(spark, sf):
    rows = docs(spark, sf).select(F.array_join(F.transform(F.array_distinct(tags()), lambda w: F.concat(F.lit("#"), w)), " ").alias("text"))
    return posts.hashtag_counts(rows).orderBy(F.desc("n"), "tag").limit(20)


@plan(f"with {TAGS}, e as (select doc_id, unnest(tags) as tag from g) select x.tag as a, y.tag as b, count(*) as n from e x join e y on x.doc_id = y.doc_id and x.tag < y.tag group by 1, 2 having count(*) >= 4")
def cooccurrence_edges(spark, sf):
    return posts.cooccurrence(docs(spark, sf), tags(), 4)


@plan(
    f"with {KW}, k as (select source, word, sum(n) as n from c group by 1, 2 qualify row_number() over (partition by source order by sum(n) desc, word) <= 10), o as (select source, row_number() over (order by source desc) as age from (select distinct source from k)) "
    "select distinct word from k join o using (source) where age <= 2 and word not in (select word from k join o using (source) where age in (3, 4))"
)
def trending_keywords(spark, sf):
    return posts.trending(snapshots(spark, sf))


def snapshots(spark, sf):
    counts = posts.term_counts(docs(spark, sf), "source", T.keywords("text")).groupBy("source", "word").agg(F.sum("n").alias("n"))
    return posts.top_terms(counts, "source", 10, "word").groupBy(F.col("source").alias("snapshot")).agg(F.collect_list("word").alias("words"))


@plan(f"with {KW}, k as (select source, word, sum(n) as n from c group by 1, 2 qualify row_number() over (partition by source order by sum(n) desc, word) <= 10) select source as snapshot, max(case when word = 'this' then 1 else 0 end) as present from k group by 1")
def keyword_timeline(spark, sf):
    return posts.keyword_timeline(snapshots(spark, sf), "this")


@plan(f"with {KW}, o as (select source from documents group by 1) select lang, count(distinct source) as sources, string_agg(distinct source, ',' order by source) as names from documents group by 1")
def source_stats(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("names"))


# Models -------------------------------------------------------------------------------------------------------------


@plan(None)
def sentiment_scores(spark, sf):
    return sentiment.analyze(docs(spark, sf)).select("doc_id", "sentiment", "sentiment_score", "sentiment_confidence")


@plan(None)
def sentiment_distribution(spark, sf):
    return sentiment.distribution(sentiment.analyze(docs(spark, sf)))


@plan(None)
def sentiment_model_agreement(spark, sf):
    d = docs(spark, sf)
    asked = providers.ask(d, "text", providers.Offline)
    model = asked.withColumn("m", providers.read_sentiment("answer")).select("doc_id", "m.*")
    return sentiment.compare(sentiment.analyze(d), model)


@plan(None)
def emotions(spark, sf):
    asked = providers.ask(docs(spark, sf), "text", providers.Offline)
    return asked.withColumn("m", providers.read_emotion("answer")).select("doc_id", "m.*", sentiment.dominant(F.col("m.intensities")).alias("dominant"))


@plan(r"select 'MISC' as label, lower(e) as entity, count(*) as n from (select unnest(regexp_extract_all(text, '[a-z,;] ([A-Z][\p{L}\p{N}_]+(?: [A-Z][\p{L}\p{N}_]+)*)', 1)) as e from documents) group by 2")
def entity_counts(spark, sf):
    return posts.entity_counts(providers.entities(docs(spark, sf)), by_label=True)


@plan(None)
def entities_by_label(spark, sf):
    return posts.entities_by_label(providers.entities(docs(spark, sf)))


@plan("select map_keys as emotion from (select unnest(['joy']) as map_keys)")
def dominant_emotion(spark, sf):
    return spark.createDataFrame([({"joy": 0.9, "anger": 0.2},)], "m map<string,double>").select(sentiment.dominant(F.col("m")).alias("emotion"))


# Topics -------------------------------------------------------------------------------------------------------------

LAB = f"e as (select lang, unnest({kw(T.STOP_LABELS)}) as word from documents), c as (select lang, word, count(*) as n from e group by 1, 2), k as (select *, row_number() over (partition by lang order by n desc, word) as rk from c qualify rk <= 10)"


@plan(f"with {LAB}, g as (select lang, list(word order by rk) as ws from k group by 1) select lang, case when length(array_to_string(ws[1:3], ', ')) > 50 then substr(array_to_string(ws[1:3], ', '), 1, 47) || '...' else array_to_string(ws[1:3], ', ') end as label, array_to_string(ws[1:7], ',') as keywords from g")
def topic_label_keywords(spark, sf):
    return topics.labels(docs(spark, sf), "lang").select("lang", "label", F.array_join("keywords", ",").alias("keywords"))


COH = f"b as (select source as c, doc_id, {kw(T.STOP_COHERENCE)} as ws from documents), e as (select c, doc_id, unnest(ws) as word from b), n as (select c, word, count(*) as n from e group by 1, 2), k as (select c, word from n qualify row_number() over (partition by c order by n desc, word) <= 10), h as (select distinct e.c, doc_id, e.word from e join k on e.c = k.c and e.word = k.word)"


@plan(
    f"with {COH}, s as (select c, word, count(*) as d from h group by 1, 2), p as (select x.c, x.word as a, y.word as b, count(*) as d2 from h x join h y on x.c = y.c and x.doc_id = y.doc_id and x.word < y.word group by 1, 2, 3), t as (select source as c, count(*) as docs from documents group by 1), "
    "v as (select p.c, ln(d2 * 1.0 * docs / (sa.d * sb.d)) / -ln(d2 * 1.0 / docs) as v from p join s sa on sa.c = p.c and sa.word = a join s sb on sb.c = p.c and sb.word = b join t on t.c = p.c where d2 < docs) select t.c as source, round(coalesce(avg(v), 0), 6) as npmi from t left join v using (c) group by 1"
)
def npmi_coherence(spark, sf):
    return topics.npmi(docs(spark, sf), "source").select("source", r("npmi"))


@plan(
    f"with x as (select source as c, doc_id, list_distinct({WORDS.format('text')}) as s from documents) select a.c as source, round(avg(len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))), 6) as overlap from x a join x b on a.c = b.c and a.doc_id < b.doc_id and len(a.s) > 0 and len(b.s) > 0 group by 1"
)
def text_similarity(spark, sf):
    return topics.mean_overlap(docs(spark, sf).withColumn("_w", T.words("text")), "source", "_w").select("source", r("overlap"))


JACCARD = "avg(len(list_intersect(a.s, b.s)) * 1.0 / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"


@plan(
    f"with {COH}, s as (select c, word, count(*) as d from h group by 1, 2), p as (select x.c, x.word as a, y.word as b, count(*) as d2 from h x join h y on x.c = y.c and x.doc_id = y.doc_id and x.word < y.word group by 1, 2, 3), t as (select source as c, count(*) as docs from documents group by 1), "
    "v as (select p.c, ln(d2 * 1.0 * docs / (sa.d * sb.d)) / -ln(d2 * 1.0 / docs) as v from p join s sa on sa.c = p.c and sa.word = a join s sb on sb.c = p.c and sb.word = b join t on t.c = p.c where d2 < docs), "
    f"one as (select t.c, coalesce(avg(v), 0) as m from t left join v using (c) group by 1), w as (select source as c, doc_id, list_distinct({WORDS.format('text')}) as s from documents), "
    f"two as (select a.c, {JACCARD} as m from w a join w b on a.c = b.c and a.doc_id < b.doc_id and len(a.s) > 0 and len(b.s) > 0 group by 1), "
    "ew as (select c, doc_id, word, count(*) as n, min(pos) as pos from (select c, doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from b) group by 1, 2, 3), "
    "ks as (select c, doc_id, list(word) as s from (select * from ew qualify row_number() over (partition by doc_id order by n desc, pos) <= 5) group by 1, 2), "
    f"three as (select a.c, {JACCARD} as m from ks a join ks b on a.c = b.c and a.doc_id < b.doc_id group by 1), "
    "z as (select (one.m + coalesce(two.m, 0) + coalesce(three.m, 0)) / 3 as x from one left join two using (c) left join three using (c)) "
    "select round(avg(x), 6) as mean, round(median(x), 6) as median, round(min(x), 6) as min, round(max(x), 6) as max, round(stddev_pop(x), 6) as std from z"
)
def topic_coherence(spark, sf):
    return topics.overall(topics.coherence(docs(spark, sf), "source")).select(*[r(c) for c in ("mean", "median", "min", "max", "std")])


@plan(f"with {LAB}, x as (select count(distinct word) as u, count(*) as n, count(distinct lang) as t from k) select case when t < 2 then 1.0 else round(u * 1.0 / n, 6) end as diversity from x")
def topic_diversity(spark, sf):
    return evaluate.topic_diversity(topic_words(spark, sf)).select(r("diversity"))


def topic_words(spark, sf):
    counts = docs(spark, sf).select("lang", F.explode(T.keywords("text", T.STOP_LABELS)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return posts.top_terms(counts, "lang", 10, "word").groupBy(F.col("lang").alias("topic")).agg(F.collect_list("word").alias("words"))


@plan(f"with {LAB} select lang as topic, round(count(distinct word) * 1.0 / count(*), 6) as coherence from k group by 1")
def unique_word_ratio(spark, sf):
    return evaluate.unique_word_ratio(topic_words(spark, sf)).select("topic", r("coherence"))


@plan("select lang as cluster_id, count(*) as n, array_to_string(list(doc_id order by doc_id)[1:3], ',') as samples from documents group by 1")
def cluster_info(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster_id"))
    info = topics.cluster_info(d.withColumn("cluster_id", F.col("cluster_id")), d.select("id", F.col("id").cast("string").alias("text")), 3)
    return info.select("cluster_id", "n", F.array_join("samples", ",").alias("samples"))


@plan(None)
def tfidf_kmeans(spark, sf):
    return topics.tfidf_kmeans(docs(spark, sf), 8)[0]


@plan(None)
def lda_topics(spark, sf):
    return topics.lda(docs(spark, sf), 5)[1]
