"""The registered queries of the engine's own operators, each with the SQL that gives the same rows in DuckDB where SQL can."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone import fixtures, schemas
from marlstone.functions import bodies, captions, chunker, crossrefs, scope, vectors
from marlstone.functions import text as T
from marlstone.operators import assets
from marlstone.operators import chunks as C
from marlstone.operators import facts as FA
from marlstone.operators import layout as L
from marlstone.operators import memory as M
from marlstone.operators import retrieval as R
from marlstone.operators import tables as TB
from marlstone.plans import guard, models, pipeline, prompts
from marlstone.session import ship
from marlstone.sources import jobs, readers
from marlstone.store import own_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- retrieval ---------------------------------------------------------------

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BM25 = f"""
with t as (select doc_id, {TOKENS} as tokens from {{docs}}), l as (select doc_id, len(tokens) as dl from t),
s as (select count(*) as n, avg(dl) as avgdl from l),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from t) group by all),
d as (select term, count(*) as df from p group by term),
q as (select query_id, term, count(*) as times from (select item_id as query_id, unnest({TOKENS}) as term from {{queries}}) group by all),
m as (select q.query_id, p.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (case when avgdl > 0 then avgdl else 1 end)))) as score
  from q join d using (term) join p using (term) join l using (doc_id), s group by all),
a as (select query_id, doc_id, round(coalesce(score, 0), 9) as score from (select distinct query_id from q) cross join (select doc_id from l) left join m using (query_id, doc_id)),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from a)
"""
BM25_ROWS = "select query_id, doc_id, rank::int as rank, round(score, 6) as score from r where rank <= 10"


@query(BM25.format(docs="documents", queries="benchmark") + BM25_ROWS)
def bm25_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.bm25_topk(read(spark, sf_dir, "documents"), asked(spark, sf_dir), F.col("text"), 10)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(BM25.format(docs="documents", queries="(select * from benchmark where item_id = 0)") + BM25_ROWS)
def bm25_topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.bm25_topk(read(spark, sf_dir, "documents"), asked(spark, sf_dir).filter("query_id = 0"), F.col("text"), 10)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(BM25.format(docs="(select * from documents where lang = 'en')", queries="benchmark") + BM25_ROWS)
def bm25_scoped_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.bm25_topk(read(spark, sf_dir, "documents").filter("lang = 'en'"), asked(spark, sf_dir), F.col("text"), 10)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""with t as (select doc_id, unnest(list_distinct({TOKENS})) as term from documents),
s as (select count(*) as n, avg(len({TOKENS})) as avgdl from documents)
select term, count(*) as df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf, round(avgdl, 6) as avgdl from t, s group by term, n, avgdl""")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = R.tokenised(read(spark, sf_dir, "documents"), F.col("text"))
    rows = R.term_stats(tokens).crossJoin(F.broadcast(R.collection_stats(tokens)))  # one row
    return rows.select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"), F.round("avgdl", 6).alias("avgdl"))


COSINE = """with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0),
s as (select query_id, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.v), 9) as score from embeddings e, q),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100, against all rows."""
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(COSINE + "select query_id, vec_id, round(score, 6) as score from r where rank = 1")
def vector_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.vector_topk(read(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 1)
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(COSINE + "select query_id, vec_id, rank::int as rank, round(score, 6) as score from r where rank <= 10")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.vector_topk(read(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 10)
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(COSINE + "select query_id, vec_id, round(score, 6) as score from s where coalesce(score, 0) >= 0.2")
def vector_threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.vector_scores(read(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), threshold=0.2)
    return R.above_threshold(scores, 0.2).select("query_id", "vec_id", F.round("score", 6).alias("score"))


HYBRID = BM25.format(docs="documents", queries="benchmark").replace("r as (", "br as (") + """,
vq as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id in (select item_id from benchmark)),
vs as (select query_id, e.vec_id as doc_id, round(list_cosine_similarity(e.embedding::double[], vq.v), 9) as score from embeddings e, vq),
vr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from vs),
u as (select query_id, doc_id, v.rank as vector_rank, b.rank as bm25_rank, coalesce(v.score, b.score) as score
  from (select * from vr where rank <= 10) v full join (select * from br where rank <= 10) b using (query_id, doc_id)),
h as (select *, row_number() over (partition by query_id order by vector_rank is null, vector_rank, bm25_rank) as rank from u)
"""


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries, each with the vector of its id."""
    vectors_ = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return asked(spark, sf_dir).join(vectors_, "query_id", "left")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    v = R.vector_topk(vectors_, asked_vectors(spark, sf_dir).filter("query_vector is not null"), 10, "doc_id")
    b = R.bm25_topk(read(spark, sf_dir, "documents"), asked(spark, sf_dir), F.col("text"), 10)
    return R.hybrid_merge(v, b)


@query(HYBRID + """select query_id, doc_id, rank::int as rank, round(score, 6) as score, vector_rank::int as vector_rank, bm25_rank::int as bm25_rank,
array_to_string(list_filter([case when vector_rank is not null then 'vector' end, case when bm25_rank is not null then 'bm25' end], lambda x: x is not null), ',') as sources from h""")
def hybrid_merge_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "vector_rank", "bm25_rank", F.array_join("retrieval_sources", ",").alias("sources"))


CONFIDENCE = """, n as (select query_id, max(case when rank <= 3 then score end) as best from h group by query_id)
select item_id as query_id, round(best, 6) as best_text, best is null or best < 0.6 as weak_text, true as weak_table, best is null or best < 0.6 as should_retry from benchmark left join n on query_id = item_id"""


@query(HYBRID + CONFIDENCE)
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = hybrid(spark, sf_dir).filter("rank <= 3").withColumn("rerank_score", F.col("score"))
    out = R.confidence(hits, hits.limit(0), asked(spark, sf_dir))
    return out.select("query_id", F.round("best_text", 6).alias("best_text"), "weak_text", "weak_table", "should_retry")


def search_index(spark: SparkSession, sf_dir: str) -> pipeline.Index:
    """Documents with the vectors of their ids, and as tables the vectors in reverse under their labels."""
    vectors_ = read(spark, sf_dir, "embeddings")
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).join(vectors_.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return pipeline.Index(chunks, vectors_.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("table_key"), F.col("label").cast("string").alias("caption"), F.reverse("embedding").alias("embedding")))


SETTINGS = pipeline.Settings(table_threshold=0.3)
MEMORY_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}'))"


def attempt_sql(x: str, queries: str) -> str:
    """One attempt over ``queries`` (query_id, query, v) as named tables: {x}h merged hits, {x}anchor, {x}table."""
    return f"""{x}q as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+')) as term from {queries}) group by all),
{x}m as (select q.query_id, p.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (case when avgdl > 0 then avgdl else 1 end)))) as score
  from {x}q q join df using (term) join p using (term) join l using (doc_id), st group by all),
{x}a as (select query_id, doc_id, round(coalesce(score, 0), 9) as score from (select distinct query_id from {x}q) cross join (select doc_id from l) left join {x}m using (query_id, doc_id)),
{x}b as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {x}a qualify rank <= 10),
{x}v as (select query_id, e.vec_id as doc_id, round(list_cosine_similarity(e.embedding::double[], v), 9) as score, row_number() over (partition by query_id order by score desc, e.vec_id) as rank from embeddings e join documents on doc_id = e.vec_id, {queries} where v is not null qualify rank <= 10),
{x}u as (select query_id, doc_id, v.rank as vector_rank, b.rank as bm25_rank, coalesce(v.score, b.score) as score from {x}v v full join {x}b b using (query_id, doc_id)),
{x}h as (select *, row_number() over (partition by query_id order by vector_rank is null, vector_rank, bm25_rank) as rank, count(*) over (partition by query_id) as hits from {x}u),
{x}o as (select h.*, round(case when len(w) > 0 then len(list_intersect(w, {MEMORY_TOKENS.format('text')})) * 1.0 / len(w) else 0 end, 6)::double as share from {x}h h join (select query_id, {MEMORY_TOKENS.format('query')} as w from {queries}) using (query_id) join documents using (doc_id)),
{x}anchor as (select query_id, doc_id, row_number() over (partition by query_id order by case when hits > 3 then -share end, rank) as place, case when hits > 3 then share end as rerank_score from {x}o qualify place <= 3),
{x}table as (select query_id, 't' || e.vec_id as table_key, round(list_cosine_similarity(list_reverse(e.embedding)::double[], v), 9) as score, row_number() over (partition by query_id order by score desc, 't' || e.vec_id) as rank from embeddings e, {queries} where v is not null qualify rank <= 8)"""


ATTEMPT = f"""with t as (select doc_id, {TOKENS} as tokens from documents), l as (select doc_id, len(tokens) as dl from t), st as (select count(*) as n, avg(dl) as avgdl from l),
p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from t) group by all), df as (select term, count(*) as df from p group by term),
asked as (select item_id as query_id, text as query, embedding::double[] as v from benchmark left join embeddings on vec_id = item_id),
""" + attempt_sql("x", "asked")


@query(ATTEMPT + " select query_id, doc_id, place::int as rank, rerank_score from xanchor")
def retrieval_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt: vector and BM25 hits merged and reranked by a scorer."""
    out = pipeline.attempt(search_index(spark, sf_dir), asked_vectors(spark, sf_dir), models.overlap_scorer, SETTINGS)
    return out["anchors"].select("query_id", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


@query(ATTEMPT + " select query_id, table_key, rank::int as rank, round(score, 6) as score from xtable where score >= 0.3")
def retrieval_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table captions by vector, above the threshold."""
    out = pipeline.attempt(search_index(spark, sf_dir), asked_vectors(spark, sf_dir), models.overlap_scorer, SETTINGS)
    return out["tables"].select("query_id", "table_key", "rank", F.round("score", 6).alias("score"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(ATTEMPT + """, sure as (select query_id, coalesce((select max(rerank_score) from xanchor a where a.query_id = q.query_id) < 0.6, true) and coalesce((select max(score) from xtable t where t.query_id = q.query_id and score >= 0.3) < 0.3, true) as weak from asked q),
again as (select query_id, coalesce(""" + SENTENCES.replace("text", "query") + """[1], '') as query, v from asked join sure using (query_id) where weak),
""" + attempt_sql("y", "again") + """,
pick as (select query_id, case when b.best >= coalesce(a.best, -1e300) then 'retry' else 'first' end as attempt from (select query_id, round(max(score), 6) as best from xh group by 1) a full join (select query_id, round(max(score), 6) as best from yh group by 1) b using (query_id))
select query_id, doc_id, place::int as rank, rerank_score, 'first' as attempt from xanchor join pick using (query_id) where attempt = 'first'
union all select query_id, doc_id, place::int, rerank_score, 'retry' from yanchor join pick using (query_id) where attempt = 'retry'""")
def retrieval_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: an attempt, confidence, another one with the first sentence of weak queries, the better of both."""
    def rewrite(q: DataFrame) -> DataFrame:
        return q.withColumn("query", T.first_sentences(F.col("query"), 1))

    out = pipeline.retrieve(search_index(spark, sf_dir), asked_vectors(spark, sf_dir), models.overlap_scorer, rewrite, SETTINGS)
    return out["anchors"].join(out["attempts"], "query_id").select("query_id", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "attempt")


@query(HYBRID + """, ctx as (select query_id, 'chunk' as kind, (doc_id // 2)::varchar as id, min(rank) as first from h group by all union all select query_id, 'table', 'g' || (doc_id // 3), min(rank) from h group by all)
select query_id, kind, id, row_number() over (partition by query_id, kind order by first)::int as place from ctx qualify place <= case kind when 'chunk' then 10 else 3 end""")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of a query: distinct chunks of its hits and distinct tables, each up to a cap; two documents are a chunk here, three a table."""
    hits = hybrid(spark, sf_dir)
    anchors = hits.select("query_id", "rank", F.floor(F.col("doc_id") / 2).cast("string").alias("chunk_id"))
    ids = read(spark, sf_dir, "documents").select("doc_id").union(read(spark, sf_dir, "embeddings").select("vec_id")).distinct()
    tables = ids.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("table_key"), F.concat(F.lit("g"), F.floor(F.col("doc_id") / 3).cast("string")).alias("table_id"))
    chunks, found = R.assembled_context(anchors, hits.select("query_id", "rank", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("table_key")), tables)
    return chunks.select("query_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "place").union(found.select("query_id", F.lit("table"), "table_id", "place"))


@query("""with w as (select item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9-]+')), lambda x: length(x) > 2) as terms from benchmark),
o as (select item_id, doc_id, len(list_filter(terms, lambda t: contains(lower(coalesce(text, '')), t)))::bigint as overlap from documents, w),
r as (select *, row_number() over (partition by item_id order by overlap desc, doc_id) as rank from o where overlap > 0) select item_id, doc_id, overlap, rank::int as rank from r where rank <= 8""")
def lexical_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.lexical_topk(read(spark, sf_dir, "documents"), asked(spark, sf_dir), F.col("text"), 8)
    return hits.select(F.col("query_id").alias("item_id"), "doc_id", "overlap", "rank")


@query(HYBRID + ", f as (select query_id, vector_rank is not null as by_vector, min(rank) as rank from h group by all) select query_id, by_vector, rank::int as rank, row_number() over (partition by query_id order by rank)::int as place from f")
def display_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as they are shown: of each kind of source the first, five at most."""
    hits = hybrid(spark, sf_dir).withColumn("by_vector", F.col("vector_rank").isNotNull())
    return R.capped(hits, "query_id", "rank", 5, "by_vector").select("query_id", "by_vector", "rank", "place")


# --- text --------------------------------------------------------------------

@query(rf"select doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+'))::bigint as tokens, len({TOKENS})::bigint as words, len({SENTENCES})::bigint as sentences, length(coalesce(text, ''))::bigint as chars from documents")
def token_and_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", T.token_count(t).alias("tokens"), F.size(T.bm25_tokens(t)).cast("bigint").alias("words"), F.size(T.sentences(t)).cast("bigint").alias("sentences"), F.length(t).cast("bigint").alias("chars"))


@query(rf"with s as (select doc_id, {SENTENCES} as x from documents) select doc_id, array_to_string(x[1:2], ' ') as first_two, array_to_string(x[greatest(len(x) - 1, 1):len(x)], ' ') as last_two from s")
def sentence_window_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.first_sentences(F.col("text"), 2).alias("first_two"), T.last_sentences(F.col("text"), 2).alias("last_two"))


@query(rf"""with c as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as text from documents), s as (select doc_id, text, {SENTENCES} as x from c),
b as (select doc_id, case when len(x) > 1 then x[1] || ' ' || x[len(x)] else text end as t from s)
select doc_id, case when length(t) > 420 then rtrim(substr(t, 1, 419)) || '…' else t end as excerpt from b""")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.reference_excerpt(F.col("text")).alias("excerpt"))


@query(r"select page_id, trim(regexp_replace(translate(html, chr(160), ' '), '\s+', ' ', 'g')) as clean, sha1(lower(html)) as digest from pages")
def whitespace_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"), F.sha1(F.lower("html").cast("binary")).alias("digest"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(text || ' [[TABLE:t1]]', '\[\[TABLE:[^\]]+\]\]', ' ', 'g'), '\s+', ' ', 'g')) as content from documents""")
def embed_text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.embedding_text(F.concat("text", F.lit(" [[TABLE:t1]]"))).alias("content"))


@query(r"""select page_id, len(regexp_extract_all(html, '(?i)<img\b'))::bigint as images, len(regexp_extract_all(html, '(?i)<a\s[^>]*href'))::bigint as links,
array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') as targets from pages""")
def html_img_and_link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return read(spark, sf_dir, "pages").select("page_id", count(r"(?i)<img\b").alias("images"), count(r"(?i)<a\s[^>]*href").alias("links"), F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " ").alias("targets"))


@query("""with v as (select o_orderkey, unnest([o_totalprice * 1000, o_totalprice, round(o_totalprice / 100) * 50000, -round(o_totalprice / 1000) * 5000000]) as v from orders)
select o_orderkey, v, case when abs(v) >= 1e9 then printf('$%.2fB', v / 1e9) when abs(v) >= 1e6 then printf('$%.1fM', v / 1e6) else '$' || format('{:,}', round_even(v, 0)::bigint) end as shown from v""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as text, many of them on the edge between two last digits."""
    p = F.col("o_totalprice")
    each = F.explode(F.array(p * 1000, p, F.round(p / 100) * 50000, -F.round(p / 1000) * 5000000)).alias("v")
    return read(spark, sf_dir, "orders").select("o_orderkey", each).select("o_orderkey", "v", T.money(F.col("v")).alias("shown"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, event_type from events where json_extract_string(props, '$.k') is not null")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json(T.bare_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k bigint")
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), "event_type").filter("k is not null")


# --- chunks ------------------------------------------------------------------


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') as x from documents),
b as (select doc_id, x, unnest(range(0, len(x), 430)) as pos from w)
select doc_id, floor(pos / 430)::int as piece, array_to_string(x[pos + 1:pos + 430], ' ') as content from b""".replace("\\\\", "\\"))
def chunk_fixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "").alias("x")).filter(F.size("x") > 0)
    at = w.select("doc_id", "x", F.posexplode(F.sequence(F.lit(0), F.size("x") - 1, F.lit(430))).alias("piece", "at"))
    return at.select("doc_id", "piece", F.array_join(F.slice("x", F.col("at") + 1, 430), " ").alias("content"))


def doc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("file"), F.col("lang").alias("section_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("unit_id"), F.col("doc_id").alias("unit_seq"), F.concat(F.lit("Part > "), "lang").alias("header"), F.col("text").alias("body"))


CHUNKS = r"""with recursive d as (select doc_id, source, case when lang is null then '' else 'Part > ' || lang || chr(10) || chr(10) end as prefix, case when lang is null then 0 else 3 end as taken,
  trim(regexp_replace(translate(coalesce(text, ''), chr(160), ' '), '\s+', ' ', 'g')) as body from documents),
w as (select *, string_split(body, ' ') as words, 480 - taken as size from d where body <> ''),
s as (select doc_id, size, list_transform(string_split(regexp_replace(body, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: len(string_split(x, ' '))) as n from w where taken + len(words) > 500),
p as (select *, list_transform(range(0, len(n) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)::bigint) as upto, list_transform(range(0, len(n)), lambda k: coalesce(list_max(list_filter(range(1, k + 1), lambda j: n[j] > size)), 0)) as low,
  list_transform(range(0, len(n)), lambda k: coalesce(list_min(list_filter(range(k + 1, len(n) + 1), lambda j: n[j] > size)) - 1, len(n))) as high from s),
r as (select doc_id, 0::bigint as k, 0::bigint as b, (case when n[1] > size then 1 else least(high[1], greatest(1, len(list_filter(upto, lambda x: x <= size)) - 1)) end)::bigint as e from p
  union all select doc_id, k + 1, b, (case when n[f + 1] > size then f + 1 else least(high[f + 1], greatest(f + 1, len(list_filter(upto, lambda x: x <= upto[b + 1] + size)) - 1)) end)::bigint
  from (select p.*, r.k, r.e as f, case when n[r.e + 1] > size then r.e else greatest(r.b, r.e - 2, low[r.e + 1]) end::bigint as b from r join p using (doc_id) where r.e < len(n))),
g as (select r.doc_id, k, upto[b + 1] as first, upto[e + 1] - upto[b + 1] as total, case when n[b + 1] > size then size when upto[e + 1] - upto[b + 1] > 520 then 430 else upto[e + 1] - upto[b + 1] end as block from r join p using (doc_id)),
q as (select doc_id, k, off, first + off as first, least(block, total - off) as len from (select *, unnest(range(0, total, block)) as off from g)),
o as (select q.*, words, taken, prefix, (row_number() over z = 1 or taken + len >= 100)::int as opens from q join w using (doc_id) window z as (partition by q.doc_id order by k, off)),
m as (select *, sum(opens) over (partition by doc_id order by k, off) as grp from o),
c as (select doc_id, grp, any_value(taken) as taken, any_value(prefix) as prefix, string_split(string_agg(array_to_string(words[first + 1:first + len], ' '), ' ' order by k, off), ' ') as x from m group by doc_id, grp),
h as (select *, case when taken + len(x) <= 500 then len(x) else greatest(500 - taken, 80) end as room from c),
t as (select doc_id, grp, off, prefix || array_to_string(x[off + 1:off + room], ' ') as text, taken + least(room, len(x) - off) as token_count from (select *, unnest(range(0, len(x), room)) as off from h)
  union all select doc_id, 0, 0, prefix || body, taken + len(words) from w where taken + len(words) <= 500),
u as (select t.*, source, row_number() over (partition by doc_id order by grp, off) - 1 as split_index, count(*) over (partition by doc_id) as split_count from t join d using (doc_id)),
v as (select source as file, 'text_' || lpad((row_number() over (partition by source order by doc_id, split_index))::varchar, 5, '0') as chunk_id, 'u' || doc_id as unit_id, text, token_count::bigint as token_count, split_index::int as split_index, split_count from u)
"""


@query(CHUNKS + "select * from v")
def chunk_sentence_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunked(doc_units(spark, sf_dir)).select("file", "chunk_id", "unit_id", "text", "token_count", "split_index", "split_count")


@query(CHUNKS + "select count(*) as chunks, count(*) filter (where token_count > 500) as long, count(*) filter (where token_count < 100) as short, count(*) filter (where split_index > 0) as continued from v")
def chunk_payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.counters(C.chunked(doc_units(spark, sf_dir)))


LINKS = """with b as (select doc_id, source, lang, row_number() over (partition by source order by doc_id) as seq, text from documents),
l as (select *, lag(doc_id) over (partition by source, lang order by seq) as prev_id, lead(doc_id) over (partition by source, lang order by seq) as next_id from b)
"""


def linked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return read(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("chunk_id"), F.lag("doc_id").over(w).alias("prev_id"), F.lead("doc_id").over(w).alias("next_id"), F.concat_ws("/", "source", "lang").alias("section_id"), F.col("text").alias("content"))


@query(LINKS + "select source, doc_id as chunk_id, prev_id, next_id, prev_id is not null as is_continuation from l")
def chunk_links_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"), F.concat_ws("/", "source", "lang").alias("unit_id"), F.col("lang").alias("section_id"))
    return C.linked(rows).select(F.col("file").alias("source"), "chunk_id", F.col("unit_prev").alias("prev_id"), F.col("unit_next").alias("next_id"), "is_continuation")


@query(LINKS + f""", s as (select doc_id, {SENTENCES} as x from documents)
select l.doc_id as chunk_id, concat_ws(chr(10) || chr(10), nullif(array_to_string(p.x[greatest(len(p.x) - 1, 1):len(p.x)], ' '), ''), l.text, nullif(array_to_string(n.x[1:2], ' '), '')) as expanded
from l left join s p on p.doc_id = l.prev_id left join s n on n.doc_id = l.next_id""")
def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked_docs(spark, sf_dir)
    return R.neighbour_expansion(rows.select("chunk_id"), rows)


# --- facts -------------------------------------------------------------------


@query(fixtures.FACTS_SQL + """select ticker, field, "end", val, filed from (select *, row_number() over (partition by ticker, field, "end" order by priority, filed desc, pos) as turn from f
where form = '10-K' and date_diff('day', "start"::date, "end"::date) between 350 and 380) where turn = 1""")
def priority_dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FA.filtered(fixtures.facts(spark), FA.INCOME)
    return FA.one_per_field(rows, True).select("ticker", "field", "end", "val", "filed")


WIDE = """, o as (select *, row_number() over (partition by ticker, field, "end" order by priority, filed desc, pos) as turn from f where form = '10-K' and {test} and year("end"::date) between 2023 and 2025)
select ticker as company_ticker, year("end"::date)::int as fiscal_year, {start}"end" as period_end, 'FY' as period_type, {fields} from o where turn = 1 group by ticker, "end" """


def wide_sql(fields: dict, test: str, start: str = "") -> str:
    real = {"eps_basic", "eps_diluted"}
    return WIDE.format(test=test, start=start, fields=", ".join(f"max(case when field = '{f}' then val end)" + ("" if f in real else "::bigint") + f" as {f}" for f in fields))


INCOME_WIDE = fixtures.FACTS_SQL + wide_sql(FA.INCOME, """date_diff('day', "start"::date, "end"::date) between 350 and 380""", 'min_by("start", field_pos) as period_start, ')
BALANCE_WIDE = fixtures.facts_sql(fixtures.BALANCES, FA.BALANCE) + wide_sql(FA.BALANCE, "fp = 'FY'")


@query(INCOME_WIDE)
def facts_pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.income_statements(fixtures.documents(spark))


@query(BALANCE_WIDE)
def balance_pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.balance_sheets(fixtures.documents(spark, fixtures.BALANCES))


@query(INCOME_WIDE)
def facts_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income statements from nested documents as files."""
    files = {f"{t}_companyfacts.json": json.dumps(body, indent=1) for t, body in fixtures.nested(fixtures.FACTS).items()}
    return FA.income_statements(readers.company_facts(spark, fixtures.landed(spark, "companyfacts", files)))


@query(fixtures.rows_sql("table, rows", [("companies", 2), ("income_statements", 2), ("balance_sheets", 2), ("segment_revenue", 3), ("geographic_revenue", 2)]))
def star_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables written and counted."""
    return FA.write_star(f"{own_dir(spark)}/star-{uuid.uuid4().hex}", fixtures.star(spark))


@query(fixtures.rows_sql("company_ticker, fiscal_year, margin, return_on_assets", [("ABC", 2024, 29.70, 5.88), ("XYZ", 2025, -4.00, -2.22)]))
def income_balance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checked statement that joins income statements and balance sheets on company and year."""
    for name, df in fixtures.star(spark).items():
        df.createOrReplaceTempView(name)
    said = "SELECT i.company_ticker, i.fiscal_year, round(100.0 * i.net_income / nullif(i.revenue, 0), 2) AS margin, round(100.0 * i.net_income / nullif(b.total_assets, 0), 2) AS return_on_assets FROM income_statements i JOIN balance_sheets b ON i.company_ticker = b.company_ticker AND i.fiscal_year = b.fiscal_year"
    if guard.problem(spark, said) is not None:
        raise ValueError(guard.problem(spark, said))
    return spark.sql(said).select("company_ticker", "fiscal_year", F.col("margin").cast("double").alias("margin"), F.col("return_on_assets").cast("double").alias("return_on_assets"))


@query(fixtures.rows_sql("question, status, sql, corrected, rows, error, ok", [
    ("ok", "success", "SELECT ticker FROM companies", False, 2, None, True), ("wrong", "success", "SELECT name FROM companies", True, 2, None, True), ("none", "cannot_answer", "CANNOT_ANSWER", False, 0, None, True),
    ("empty", "empty_result", "SELECT ticker FROM companies WHERE name = 'nobody'", False, 0, None, True), ("bad", "error", "DELETE FROM companies", False, 0, "forbidden keyword DELETE", False),
]))
def question_to_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered by statements of a stand-in generator, one of them corrected."""
    fixtures.star(spark)["companies"].createOrReplaceTempView("companies")
    says = {"ok": "```sql\nSELECT ticker FROM companies;\n```", "wrong": "SELECT nme FROM companies", "none": "CANNOT_ANSWER", "empty": "SELECT ticker FROM companies WHERE name = 'nobody'", "bad": "DELETE FROM companies"}
    out = [guard.answer(spark, q, says.__getitem__, (lambda *_: "SELECT name FROM companies") if q == "wrong" else None) for q in says]
    shown = [guard.payload(a) for a in out]
    return spark.createDataFrame([(a["question"], a["status"], a["sql"], a["correction_used"], a["row_count"], a["error_message"], a["ok"]) for a in shown], "question string, status string, sql string, corrected boolean, rows int, error string, ok boolean")


@query("select 'region' as field, n_regionkey::varchar as key, array_to_string(list_sort(list(distinct n_name)), ',') as names from nation group by 2 union all select 'segment', c_nationkey::varchar, array_to_string(list_sort(list(distinct c_mktsegment)), ',') from customer group by 2")
def enum_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values of columns per key: nations of a region, market segments of a nation."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("company_ticker"), F.col("n_name").alias("region"))
    segments = read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("company_ticker"), F.col("c_mktsegment").alias("segment"))
    return FA.enum_catalog({"region": nations, "segment": segments}).select("field", "key", F.array_join("names", ",").alias("names"))


SCHEMA_LINES = ["Table: segment_revenue", "Columns:", "- company_ticker TEXT ('ABC' | 'XYZ')", "- fiscal_year INTEGER (2024 | 2025)", "- period_end TEXT", "- period_type TEXT ('FY')", "- segment_name TEXT", "  when company_ticker = 'ABC': 'North' | 'South'", "  when company_ticker = 'XYZ': 'All'", "- revenue BIGINT"]


@query("select " + fixtures._literal("\n".join(SCHEMA_LINES)) + " as text")
def schema_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of a table as a model reads it."""
    own = {"segment_revenue": fixtures.star(spark)["segment_revenue"]}
    text = prompts.schema_text(own, FA.enum_catalog({"segment_name": own["segment_revenue"]}), {"company_ticker": ["ABC", "XYZ"], "fiscal_year": ["2024", "2025"], "period_type": ["FY"]})
    return spark.createDataFrame([(text,)], "text string")


@query(fixtures.FACTS_SQL + """select ticker, field, "start", "end", coalesce(date_diff('day', try_cast("start" as date), try_cast("end" as date)) between 350 and 380, false) as annual from f""")
def annual_duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FA.flat_facts(fixtures.documents(spark)).join(F.broadcast(FA.concepts(spark, FA.INCOME)), "concept")
    return rows.select("ticker", "field", "start", "end", FA.annual(F.col("start"), F.col("end")).alias("annual"))


@query("""with l as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as net, sum(l_quantity) as qty from lineitem group by 1)
select o_custkey, year(o_orderdate)::int as y, round(100.0 * sum(net) / nullif(sum(o_totalprice), 0), 4) as margin, count(*) as orders from orders join l on l_orderkey = o_orderkey group by all""")
def ratio_join_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    rows = read(spark, sf_dir, "orders").join(net, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(100.0 * F.try_divide(F.sum("net"), F.sum("o_totalprice")), 4).alias("margin"), F.count("*").alias("orders"))


@query("""with y as (select year(o_orderdate)::int as y, o_orderpriority as p, sum(o_totalprice) as total from orders group by all)
select p, y, round(total, 2) as total, round(100.0 * (total - lag(total) over (partition by p order by y)) / nullif(lag(total) over (partition by p order by y), 0), 6) as growth from y""")
def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))
    last = F.lag("total").over(Window.partitionBy("p").orderBy("y"))
    return rows.select("p", "y", F.round("total", 2).alias("total"), F.round(100.0 * F.try_divide(F.col("total") - last, last), 6).alias("growth"))


@query("""with r as (select n_name, sum(c_acctbal) as bal from customer join nation on c_nationkey = n_nationkey group by 1)
select n_name, round(bal, 2) as bal, round(100.0 * bal / nullif(sum(bal) over (), 0), 6) as share from r""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("bal"))  # 25 nations
    total = rows.agg(F.sum("bal").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("n_name", F.round("bal", 2).alias("bal"), F.round(100.0 * F.try_divide("bal", "total"), 6).alias("share"))  # one row


@query("""select o_orderpriority, o_orderkey, rank::int as rank, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 10""")
def top_n_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("o_orderpriority", "o_orderkey", "rank", "o_totalprice")


@query("select r_name, array_to_string(list_sort(list(distinct n_name)), ',') as names from nation join region on n_regionkey = r_regionkey group by r_name")
def distinct_enum_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("""(select 'both' as kind, k from (select c_nationkey as k from customer intersect select s_nationkey from supplier))
union all (select 'customer_only', k from (select c_custkey as k from customer except select s_suppkey from supplier))
union all (select 'either', k from (select c_nationkey as k from customer union select s_nationkey from supplier))""")
def set_ops_union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    ck, sk = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    only = c.select(F.col("c_custkey").alias("k")).subtract(s.select(F.col("s_suppkey").alias("k")))
    return named(ck.intersect(sk).select(F.col("k").cast("bigint").alias("k")), "both").union(named(only, "customer_only")).union(named(ck.union(sk).distinct().select(F.col("k").cast("bigint").alias("k")), "either"))


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as turn from events) where turn = 1")
def keep_last_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.keep_last(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by event_id) as turn from events) where turn = 1")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


# --- layout and tables -------------------------------------------------------


@query("""with o as (select o_orderkey as asset_id, o_custkey as section_ref_id, o_orderdate as t from orders), h as (select l.l_orderkey, o2.o_custkey as section_ref_id, min(l_shipdate) as t from lineitem l join orders o2 on l.l_orderkey = o2.o_orderkey group by all)
select asset_id, (select max_by(l_orderkey, (date_diff('day', date '1990-01-01', h.t::date), l_orderkey))::varchar from h where h.section_ref_id = o.section_ref_id and date_diff('day', date '1990-01-01', h.t::date) <= date_diff('day', date '1990-01-01', o.t::date)) as sub_id from o""")
def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: for every order the latest first shipment of the customer's orders at or before its day (days as pages)."""
    day = lambda c: F.date_diff(F.to_date(c), F.lit("1990-01-01").cast("date"))
    orders = read(spark, sf_dir, "orders")
    assets = orders.select(F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("section_ref_id"), day("o_orderdate").alias("page"), F.lit(1e12).alias("y0"))
    ship_ = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("t"))
    heads = ship_.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("section_ref_id"), day("t").alias("page"), F.col("l_orderkey").cast("double").alias("y0"), F.col("l_orderkey").alias("sub_id"))
    return L.heading_before(assets, heads)


SECTION_OF = """with r as (select o_custkey as file, o_orderkey as id, date_diff('day', date '1990-01-01', o_orderdate::date) // 200 as first, row_number() over w as pos, lead(first) over w as nxt from orders window w as (partition by o_custkey order by o_orderkey)),
s as (select file, id, pos, first, greatest(coalesce(nxt - 1, 1 << 30), first) as last from r),
a as (select l_orderkey * 10 + l_linenumber as asset, o_custkey as file, date_diff('day', date '1990-01-01', l_shipdate::date) // 200 as page, l_quantity * 16 as y0 from lineitem join orders on l_orderkey = o_orderkey),
j as (select a.*, s.id, s.pos, s.first, s.last from a left join s using (file)),
c as (select asset, any_value(y0) as y0, max_by(id, pos) filter (where first < page and last >= page) as goes_on, max_by(id, pos) filter (where last = page - 1) as ended, count(*) filter (where first = page) as starts,
  min_by(id, pos) filter (where first = page) as first_here, max_by(id, pos) filter (where first = page) as last_here, max_by(id, pos) filter (where first <= page and page <= last) as holds, max_by(id, pos) filter (where first <= page) as before from j group by asset)
select asset as asset_id, coalesce(case when y0 < 150 then coalesce(goes_on, ended) end, case when starts >= 2 then case when y0 >= 720.72 then last_here else first_here end end, holds, before) as section_ref_id from c"""


@query(SECTION_OF)
def interval_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: each line item in the order of its customer whose span of days holds its shipment (200 days as a page)."""
    page = lambda c: F.floor(F.date_diff(F.to_date(c), F.lit("1990-01-01").cast("date")) / 200).cast("int")
    orders = read(spark, sf_dir, "orders")
    refs = orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("section_ref_id"), F.col("o_orderkey").alias("start_offset"), page("o_orderdate").alias("start_page"))
    placed = read(spark, sf_dir, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("pos"))  # any_value takes a line's first row in the table
    lines = placed.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    assets_ = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"), F.col("o_custkey").alias("file"), page("l_shipdate").alias("page"), (F.col("l_quantity") * 16).alias("y0"), "pos")
    return L.section_of(assets_, refs)


@query("""with r as (select l_orderkey as file, concat_ws('-', l_linenumber, l_partkey, l_suppkey) as id, l_linenumber // 4 as page, 40 + (l_partkey % 3) * 20 as x0, 420 + (l_suppkey % 5) * 40 as wide, l_linenumber * 24.0 + l_quantity / 8 as y0, y0 + 12 as y1, l_returnflag as sec, l_linenumber % 6 + 1 as cols from lineitem),
p as (select *, lag(page) over w as page_, lag(x0) over w as x0_, lag(wide) over w as wide_, lag(y1) over w as y1_, lag(sec) over w as sec_, lag(cols) over w as cols_ from r window w as (partition by file order by page, y0, x0, id)),
b as (select *, case when page = page_ and sec = sec_ and abs(x0 - x0_) <= 25 and abs(wide - wide_) <= 80 and ((wide >= 480 and wide_ >= 480 and y0 - y1_ between -35 and 50)
  or (y0 - y1_ between -2 and 28 and abs(cols - cols_) <= 2 and ((cols between 2 and 4 and cols_ between 2 and 4) or greatest(cols, cols_) >= 4))) then 0 else 1 end as breaks from p)
select file, id, sum(breaks) over (partition by file order by page, y0, x0, id)::bigint as island from b""")
def islands_same_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: the lines of an order as table regions, linked where they continue each other on a page."""
    top, left = F.col("l_linenumber") * 24.0 + F.col("l_quantity") / 8, (40 + (F.col("l_partkey") % 3) * 20).cast("double")
    box = F.array(left, top, left + 420 + (F.col("l_suppkey") % 5) * 40, top + 12)
    row = F.transform(F.sequence(F.lit(1), (F.col("l_linenumber") % 6 + 1).cast("int")), lambda k: F.when(k == 1, "x").otherwise("1"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_file"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("table_id"), F.floor(F.col("l_linenumber") / 4).alias("page_start"), box.alias("bbox"), F.array(row).alias("raw_rows"), F.col("l_returnflag").alias("section_ref_id"), F.lit(None).cast("string").alias("subsection_ref_id"))
    return TB.same_page_islands(rows).select(F.col("source_file").alias("file"), F.col("table_id").alias("id"), "island")


@query(fixtures.REGIONS_SQL + """select table_id, y0, y1 from g a where not exists (select 1 from g b where a.page = b.page and a.sub is not distinct from b.sub and a.table_id <> b.table_id
and a.y0 >= b.y0 - 2 and a.y1 <= b.y1 + 2 and (b.y1 - b.y0 > a.y1 - a.y0 or (b.y1 - b.y0 = a.y1 - a.y0 and b.table_id < a.table_id)))""")
def containment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.contained(fixtures.regions(spark)).select("table_id", F.col("bbox")[1].alias("y0"), F.col("bbox")[3].alias("y1"))


@query("""select conv_id, turn, (coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) + 13)::bigint as "offset" from conversations""")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.lit(1).alias("page"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return L.offsets(lines).select(F.col("file").alias("conv_id"), F.col("line_no").alias("turn"), "offset")


@query("""select event_id, round(value - lag(value) over w, 6) as gap_before, round(lead(value) over w - value, 6) as gap_after from events window w as (partition by user_id, event_type order by value, event_id)""")
def vertical_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("page"), F.col("value").alias("y0"), F.col("value").alias("y1"), F.col("event_id").cast("double").alias("x0"), "event_id")
    return L.gaps(rows).select("event_id", F.round("gap_before", 6).alias("gap_before"), F.round("gap_after", 6).alias("gap_after"))


@query(fixtures.rows_sql("grid_id, prose, header_only", fixtures.GRID_FLAGS))
def prose_grid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.grids(spark).select("grid_id", TB.prose_grid(F.col("raw_rows")).alias("prose"), TB.header_only(F.col("raw_rows")).alias("header_only"))


@query(fixtures.GRIDS_SQL + """, c as (select grid_id, raw_rows, flatten(raw_rows) as cells, bbox from g),
s as (select grid_id, len(raw_rows) as n_rows, list_max(list_transform(raw_rows, lambda r: len(r))) as cols, len(cells) as n, len(list_filter(cells, lambda x: coalesce(x, '') <> '')) as f,
len(list_filter(cells, lambda x: regexp_matches(coalesce(x, ''), '^[\\s$€£(]*-?[\\d,]+(\\.\\d+)?\\s*[%)]*\\s*$') or regexp_matches(trim(coalesce(x, '')), '^[—–-]+$'))) as nums, bbox from c)
select grid_id, ((case when cols > 8 then 3 else 0 end) + (case when cols > 14 then 2 else 0 end) + (case when n_rows > 15 then 2 else 0 end) + (case when (n - f) * 1.0 / greatest(n, 1) > 0.25 then 2 else 0 end)
+ (case when nums * 1.0 / greatest(f, 1) > 0.45 then 1 else 0 end) + (case when bbox[3] - bbox[1] > 480 then 1 else 0 end))::int as score from s""".replace("\\\\", "\\"))
def table_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.grids(spark).select("grid_id", TB.complexity(F.col("raw_rows"), F.col("bbox"))["score"].alias("score"))


@query(fixtures.rows_sql("table_id, asset_type, page_start, source_ids, n_rows", fixtures.GROUPS))
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = TB.grouped(TB.same_page_islands(fixtures.regions(spark)))
    return g.select("table_id", "asset_type", "page_start", F.array_join("source_table_ids", ",").alias("source_ids"), F.size("raw_rows").cast("bigint").alias("n_rows"))


@query(fixtures.rows_sql("a, b, similarity", fixtures.SIMILARITIES))
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.titles(ship(spark)).select("a", "b", F.round(L.title_similarity("a", "b"), 6).alias("similarity"))


@query(fixtures.rows_sql("sentence_id, cue_type, target_type, target_label, part, item, title, char_start, char_end", fixtures.REFERENCES))
def crossref_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.sentences(ship(spark)).select("sentence_id", F.explode(crossrefs.extract_udf("sentence")).alias("r"))
    return rows.select("sentence_id", "r.cue_type", "r.target_type", "r.target_label", "r.part", "r.item", "r.title", "r.char_start", "r.char_end")


@query("with r as (" + fixtures.rows_sql("sentence_id, cue_type, target_type, target_label, part, item, title, char_start, char_end", fixtures.REFERENCES) + ") select 'cue' as kind, cue_type as name, count(*) as n from r group by all union all select 'target', target_type, count(*) from r group by all")
def crossref_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossrefs.summary(fixtures.sentences(ship(spark)).select(crossrefs.extract_udf("sentence").alias("cross_refs")))


@query(fixtures.SCOPES_SQL + """, y as (select *, list_sort(list_distinct(list_transform(regexp_extract_all(question, '\\b(20[0-9]{2})\\b', 1), lambda x: x::int))) as years, (select max(regexp_extract(u, '([0-9]{4})', 1)::int) from (select unnest(available) as u)) as top_n from s),
t as (select *, 'FY' || top_n as top, case when regexp_matches(upper(trim(requested)), '^[0-9]{4}$') then 'FY' || trim(requested) else nullif(upper(trim(requested)), '') end as wanted from y),
r as (select *, case when wanted is not null and not list_contains(available, wanted) then 'requested_filing_not_indexed' when len(years) = 0 then null
 when not list_contains(available, 'FY' || years[1]) and (wanted is null or wanted <> top) then 'metric_year_not_indexed_as_filing'
 when years[1] < regexp_extract(wanted, '([0-9]{4})', 1)::int and wanted <> top then 'metric_year_older_than_filing_scope' end as reason from t)
select id, case when reason is not null then top else wanted end as resolved, reason from r""".replace("\\\\", "\\"))
def year_scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope.filing_year(F.col("question"), F.col("requested"), F.col("available"))
    return fixtures.scopes(spark).select("id", found["resolved"].alias("resolved"), found["reason"].alias("reason"))


@query(fixtures.rows_sql("id, statement, problem", [(k, s, p) for k, (s, p) in enumerate(fixtures.STATEMENTS)]))
def sql_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, s, guard.problem(spark, s)) for k, (s, _) in enumerate(fixtures.STATEMENTS)]  # a constant list of statements
    return spark.createDataFrame(rows, "id int, statement string, problem string")


# --- memory ------------------------------------------------------------------


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")


@query("select conv_id as session_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 4")
def short_term_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recent(turns(spark, sf_dir)).select("session_id", "turn", "role", "text")


@query("""with b as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations),
f as (select conv_id, trim(string_agg('- ' || role || ': ' || substr(replace(coalesce(text, ''), chr(10), ' '), 1, 400), chr(10) order by turn)) as s from b where back > 4 group by conv_id)
select conv_id as session_id, case when length(s) > 6000 then right(s, 6000) else s end as summary from f""")
def summary_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summaries(turns(spark, sf_dir))


@query(r"""with m as (select conv_id as session_id, 'user_email' as key, turn, generate_subscripts(x, 1) as pos, unnest(x) as value from (select conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as x from conversations where role = 'user')),
p as (select conv_id as session_id, 'user_preference' as key, turn, 0 as pos, substr(trim(text), 1, 320) as value from conversations where role = 'user' and regexp_matches(lower(text), 'i prefer|always use|from now on|remember that i'))
select session_id, key, max_by(value, (turn, pos)) as value from (select * from m union all select * from p) where trim(value) <> '' group by all""")
def facts_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.facts(turns(spark, sf_dir))


@query("""with q as (select conv_id, max_by(text, turn) as query from conversations where role = 'user' group by 1),
c as (select conv_id, turn, role, list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]{2,}')) as x, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) as y from conversations join q using (conv_id)),
s as (select conv_id, turn, role, case when len(x) > 0 then len(list_intersect(x, y)) * 1.0 / len(x) else 0 end as score from c),
r as (select *, row_number() over (partition by conv_id order by score desc, role, turn) as rank from s where score >= 0.06)
select conv_id as session_id, role as kind, turn as pos, rank::int as rank, round(score, 6)::double as score from r where rank <= 8""")
def memory_overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each session that answer its last question best."""
    said = turns(spark, sf_dir)
    last = said.filter("role = 'user'").groupBy("session_id").agg(F.max_by("text", "turn").alias("query"))
    lines = said.select("session_id", F.col("role").alias("kind"), F.col("turn").alias("pos"), F.col("text").alias("line"))
    return M.retrieved(lines, last).select("session_id", "kind", "pos", "rank", F.round("score", 6).alias("score"))


@query("""with m as (select conv_id, count(*) as messages, max(turn) as last_turn from conversations group by 1),
p as (select *, lead(text) over w as answer, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)),
n as (select conv_id, least(50, count(*)) as notes from p where role = 'user' and next_role = 'assistant' and trim(coalesce(answer, '')) <> '' group by 1),
b as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations),
f as (select conv_id, trim(string_agg('- ' || role || ': ' || substr(replace(coalesce(text, ''), chr(10), ' '), 1, 400), chr(10) order by turn)) as s from b where back > 4 group by conv_id)
select conv_id as session_id, messages, last_turn, coalesce(notes, 0) as notes, case when s is null then 0 else least(6000, length(s)) end::bigint as summary_chars from m left join n using (conv_id) left join f using (conv_id)""")
def memory_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.snapshot(turns(spark, sf_dir))


# --- audits ------------------------------------------------------------------


@query("""select lang, count(*) as n, count(*) filter (where trim(coalesce(ticker, '')) = '') as missing_ticker, count(*) filter (where source_file = 'source.pdf') as stale,
case when stale > 0 then 'stale_source' when missing_ticker > 0 then 'missing_ticker' end as reason, reason is null as valid
from (select lang, case when doc_id % 7 = 0 and lang = 'en' then '' else source end as ticker, case when doc_id % 11 = 0 and lang = 'de' then 'source.pdf' else 'f.pdf' end as source_file from documents) group by lang""")
def index_health_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of an index by language; some rows of two languages are made faulty here."""
    faulty = lambda n, lang: (F.col("doc_id") % n == 0) & (F.col("lang") == lang)
    rows = read(spark, sf_dir, "documents").select("lang", F.when(faulty(7, "en"), "").otherwise(F.col("source")).alias("ticker"), F.when(faulty(11, "de"), "source.pdf").otherwise("f.pdf").alias("source_file"))
    return readers.health(rows, ["lang"])


@query("select upper(lang) as ticker, 'FY' || lpad((doc_id % 4 + 2022)::varchar, 4, '0') as fiscal_year, text from documents where lang in ('en', 'de') and doc_id % 4 in (1, 2)")
def scoped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.upper("lang").alias("ticker"), F.concat(F.lit("FY"), (F.col("doc_id") % 4 + 2022).cast("string")).alias("fiscal_year"), "text")
    return readers.scoped(rows, ["en", " DE"], ["2023", "FY2024"])


# --- identity, captions, assets ----------------------------------------------


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return ship(spark).createDataFrame(rows, schema)


@query(fixtures.values("with i", "id, part, item, title", fixtures.ITEMS) + r""", n as (select *, nullif(regexp_extract(item, '(?i)^item\s+(\d+)([A-Z]?)$', 1), '') as num, nullif(upper(regexp_extract(item, '(?i)^item\s+(\d+)([A-Z]?)$', 2)), '') as letter, nullif(trim(coalesce(title, '')), '') as name from i)
select id, array_to_string(list_filter([part, case when num is not null then 'Item ' || num else item end, case when letter is not null then 'Item ' || num || letter end, case when letter is null and num is not null then coalesce(name, item) else name end], lambda x: x is not null and x <> ''), ' > ') as header,
case when num::int <= 4 then 'Part I' when num::int <= 9 then 'Part II' when num::int <= 14 then 'Part III' when num::int <= 16 then 'Part IV' end as part_of_item from n""")
def item_header_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, fixtures.ITEMS, "id int, part string, item string, title string")
    return rows.select("id", F.array_join(scope.header_path(F.col("part"), F.col("item"), F.col("title")), " > ").alias("header"), scope.part_of_item(F.col("item")).alias("part_of_item"))


@query(fixtures.values("with s", "id, name", fixtures.SOURCES) + """select id, nullif(upper(regexp_extract(name, '(?i)^([A-Za-z]+)_FY([0-9]{4})_', 1)), '') as ticker, 'FY' || nullif(regexp_extract(name, '(?i)^([A-Za-z]+)_FY([0-9]{4})_', 2), '') as fiscal_year,
case when name = 'source.pdf' then 'new.pdf' else name end as renamed from s""")
def filing_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = scope.source_identity(F.col("name"))
    return literal(spark, fixtures.SOURCES, "id int, name string").select("id", who["ticker"].alias("ticker"), who["fiscal_year"].alias("fiscal_year"), scope.renamed(F.col("name"), "source.pdf", "new.pdf").alias("renamed"))


@query("""select doc_id, upper(trim(lang)) as ticker, 'FY' || lpad((doc_id % 4 + 2022)::varchar, 4, '0') as fiscal_year, sha1(source)[1:10] as short from documents""")
def scope_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", scope.ticker(F.col("lang")).alias("ticker"), scope.fiscal_year((F.col("doc_id") % 4 + 2022).cast("string")).alias("fiscal_year"), F.substring(F.sha1(F.col("source").cast("binary")), 1, 10).alias("short"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand|m|b))?', '[amount]', 'g'), '\(?[\d,]+(?:\.\d+)?\)?%?', '[num]', 'g'), '\s+', ' ', 'g')) as masked from documents""")
def caption_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", captions.masked_context(F.col("text")).alias("masked"))


@query(fixtures.values("with c", "id, topic", fixtures.CAPTIONS) + r"""select id, topic = '' or regexp_matches(topic, '(?i)\bfinancial table\b$') or (len(regexp_split_to_array(trim(topic), '\s+')) <= 4 and regexp_matches(topic, '(?i)fy20\d{2}')) as weak,
regexp_matches(topic, '(?i)^(?:(?:the\s+)?table\s+(?:presents|shows|displays|contains|summarizes|lists)\b|(?:key\s+)?financial performance metrics\b)') as boilerplate from c""")
def caption_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, fixtures.CAPTIONS, "id int, topic string")
    return rows.select("id", captions.weak_topic(F.col("topic")).alias("weak"), captions.boilerplate(F.col("topic")).alias("boilerplate"))


@query(fixtures.rows_sql("id, topic, labels", [(t[0], t[4], t[5]) for t in fixtures.TOPICS]))
def caption_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, [t[:4] for t in fixtures.TOPICS], "id int, raw_rows array<array<string>>, corpus string, markdown string")
    return rows.select("id", captions.inferred_topic(F.col("raw_rows"), F.col("corpus")).alias("topic"), F.array_join(captions.markdown_labels(F.col("markdown")), ",").alias("labels"))


@query(fixtures.values("with t", "source_file, table_id, ids, pos", [(a, b, c if c is not None else [], d) for a, b, c, d in fixtures.LOOKUP]).replace("[]", "[]::varchar[]") + """, k as (select source_file, table_id, pos, unnest([table_id] || ids || list_transform(ids, lambda x: x || '_merged')) as key from t),
r as (select source_file || '::' || key as table_key, table_id, pos, row_number() over (partition by source_file || '::' || key order by pos, case when key = table_id then 0 else 1 end) as turn from k)
select table_key, table_id from r where turn = 1""")
def table_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, fixtures.LOOKUP, "source_file string, table_id string, source_table_ids array<string>, load_pos int")
    return R.table_lookup(rows).select("table_key", "table_id")


@query(fixtures.values("with w", "file, page, x0, top, t", fixtures.WORDS) + "select file, page, string_agg(t, ' ' order by x0) as line from w group by file, page, round_even(top / 3, 0)")
def word_layer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, fixtures.WORDS, "file string, page int, x0 double, top double, text string")
    return TB.word_rows(rows).select("file", "page", F.col("text").alias("line"))


@query(fixtures.values("with p", "source_file, table_id, page, status", fixtures.PARSES) + "select source_file, count(*) as tables, count(*) filter (where status = 'success') as parsed, count(*) filter (where status is null) as missing, count(*) filter (where status <> 'success') as failed from p group by 1")
def table_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.parse_status(literal(spark, fixtures.PARSES, "source_file string, table_id string, page int, status string"))


@query(fixtures.values("with s", "file, part, seq, item", fixtures.SECTIONS) + "select coalesce(part, 'Unknown') as part, string_agg(item, ',' order by seq) as items from s group by 1")
def part_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets.parts(literal(spark, fixtures.SECTIONS, "file string, part string, seq int, item string"))
    return rows.select("part", F.array_join("items", ",").alias("items"))


@query(fixtures.values("with j", "job_id, step, state", fixtures.JOBS) + "select job_id, (case when count(*) filter (where state = 'done') >= 3 then 100 else least(95, floor(100 * count(*) filter (where state = 'done') / 3) + case when count(*) filter (where state = 'running') > 0 then 8 else 0 end) end)::int as percent from j group by 1")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.progress(literal(spark, fixtures.JOBS, "job_id int, step int, state string"))


@query("select user_id as job_id, event_id as seq, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as back from events) where back <= 80")
def last_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "event_type")
    return assets.last_events(rows)


@query("""with s as (select conv_id as run_id, turn as step, role as tool, text as input, length(text)::varchar as output from conversations)
select run_id, step * 2 - 1 as pos, 'tool_call' as kind, tool, input as content from s union all select run_id, step * 2, 'observation', tool, output from s""")
def trace_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.col("role").alias("tool"), F.col("text").alias("input"), F.length("text").cast("string").alias("output"))
    return assets.trace_rows(steps).select("run_id", "pos", "kind", "tool", "content")


@query("""with p as (select *, lead(text) over w as answer, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)),
n as (select conv_id as session_id, turn, 'Q: ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 220) || ' / A: ' || substr(trim(regexp_replace(answer, '\\s+', ' ', 'g')), 1, 480) as note, row_number() over (partition by conv_id order by turn desc) as back from p where role = 'user' and next_role = 'assistant' and trim(coalesce(answer, '')) <> '')
select session_id, turn, note from n where back <= 50""".replace("\\\\", "\\"))
def session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.notes(turns(spark, sf_dir))


@query("""with a as (select 'table_' || lpad(row_number() over (partition by source order by doc_id)::varchar, 3, '0') as table_id, source as source_file, doc_id from documents) select source_file, table_id, doc_id from a""")
def dense_asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), "doc_id")
    return TB.dense_ids(rows, "table", ["doc_id"])


@query(HYBRID + """, sc as (select *, row_number() over (partition by query_id order by doc_id desc) as position, count(*) over (partition by query_id) as n from h)
select query_id, doc_id, row_number() over (partition by query_id order by position, rank)::int as rank, (1.0 / position)::double as rerank_score from sc where n > 3 qualify row_number() over (partition by query_id order by position, rank) <= 3""")
def rerank_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer's order joined back to hits: here the larger document ids first."""
    hits = hybrid(spark, sf_dir)
    w = Window.partitionBy("query_id").orderBy(F.desc("doc_id"))
    scored = hits.select("query_id", "doc_id", F.row_number().over(w).alias("position")).withColumn("rerank_score", 1.0 / F.col("position"))
    return R.reranked(hits, scored, 3).select("query_id", "doc_id", "rank", "rerank_score")


@query(fixtures.rows_sql("file, page, line, score, level", [("f", 1, "MARKET RISK", 5, 2), ("f", 1, "Note 3 – Leases", 1, 1)]))
def layout_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a small page: candidates with score and level."""
    lines = literal(spark, [("f", 1, 0, "MARKET RISK", False, 250.0, 362.0, 100.0, 112.0, 612.0, 12.0, False, False, ["A"]), ("f", 1, 1, "We hold notes that pay interest at fixed rates.", False, 72.0, 540.0, 140.0, 152.0, 612.0, 10.0, False, False, ["A"]), ("f", 1, 2, "Note 3 – Leases", False, 72.0, 200.0, 180.0, 192.0, 612.0, 10.0, True, False, ["A"])], schemas.LINE)
    return L.heading_candidates(lines).select("file", "page", "line", "score", "level")


@query(fixtures.rows_sql("body, table_refs", [("Sales grew, as follows. [[TABLE:t1]]", "t1"), ("First comes revenue. [[TABLE:t1]] Then we turn to assets. [[TABLE:t2]] That is all.", "t1,t2"), ("No table is here.", ""), ("", "")]))
def table_marked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = ("t1", [["Revenue", "100", "90"], ["Costs", "40", "35"]]), ("t2", [["Assets", "7", "6"]])
    rows = literal(spark, [("Heading Sales grew, as follows: Revenue 100 90 Costs 40 35", "Heading", [one]), ("First comes revenue. Revenue 100 90 Costs 40 35 Then we turn to assets. Assets 7 6 That is all.", "", [two, one]), ("No table is here.", "", []), (None, None, None)], "body string, heading string, tables array<struct<table_id: string, raw_rows: array<array<string>>>>")
    return rows.select(bodies.clean_udf("body", "heading", "tables").alias("x")).select("x.body", F.array_join("x.table_refs", ",").alias("table_refs"))


# --- sources and stores --------------------------------------------------------


def filing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text chunks of filings: language and three years name the filing."""
    name = F.concat(F.upper(F.coalesce("lang", F.lit("xx"))), F.lit("_FY"), (2023 + F.col("doc_id") % 3).cast("string"), F.lit("_10-K.pdf"))
    none = F.lit(None).cast("string")
    return read(spark, sf_dir, "documents").select(name.alias("source_file"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("text").alias("chunk_type"), none.alias("section_ref_id"), F.array("source").alias("header_path"), "text", none.alias("prev_id"), none.alias("next_id"), F.col("doc_id").alias("load_seq"))


@query(r"""with d as (select upper(coalesce(lang, 'xx')) as ticker, 'FY' || (2023 + doc_id % 3) as fiscal_year, doc_id, trim(regexp_replace(translate(text, chr(160), ' '), '\s+', ' ', 'g')) as content from documents)
select ticker || '_' || fiscal_year || '_10-K.pdf::' || doc_id as chunk_id, ticker, fiscal_year, case when ticker = 'EN' and fiscal_year = 'FY2024' then 'new ' || content else content end as content, 64 as dim from d where content <> ''""".replace("\\\\", "\\"))
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text index built from chunks, then one filing's chunks replaced."""
    path = f"{own_dir(spark)}/index-{uuid.uuid4().hex}"
    chunks = filing_chunks(spark, sf_dir)
    jobs.build_index(readers.index_rows(chunks, "load_seq"), path, models.embedding)
    again = chunks.filter("source_file = 'EN_FY2024_10-K.pdf'").withColumn("text", F.concat(F.lit("new "), "text"))
    jobs.build_index(readers.index_rows(again, "load_seq"), path, models.embedding, rebuild=False)
    return jobs.read_index(spark, path).select("chunk_id", "ticker", "fiscal_year", "content", F.size("embedding").alias("dim"))


@query("select 'EM_FY2025_x.pdf::table::t' || vec_id as chunk_id, 't' || vec_id as table_id, 'EM' as ticker, 'FY2025' as fiscal_year, 'topic ' || label as content from embeddings where label % 2 = 0")
def table_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of table captions: only tables with a successful summary."""
    path = f"{own_dir(spark)}/captions-{uuid.uuid4().hex}"
    state = F.when(F.col("label") % 2 == 0, "success").otherwise("error")
    assets_ = read(spark, sf_dir, "embeddings").select(F.lit("EM_FY2025_x.pdf").alias("source_file"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("table_id"), state.alias("status"), F.concat(F.lit("topic  [num]"), F.col("label").cast("string")).alias("summary"))
    jobs.build_table_index(assets_, path, models.embedding)
    return jobs.read_index(spark, path).select("chunk_id", "table_id", "ticker", "fiscal_year", "content")


@query(fixtures.rows_sql("workspace, n, status, reason", fixtures.AUDITS))
def workspace_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces found on disk, their chunks indexed and audited; one has no chunks yet."""
    files = {f"{w}/chunks.json": json.dumps(rows) for w, rows in fixtures.WORKSPACES.items()} | {f"w{k}/metadata.json": "{}" for k in (1, 2, 3, 4)}
    root = fixtures.landed(spark, "workspaces", files)
    return jobs.rebuild_indexes(spark, root, f"{root}-index", fixtures.CHUNK_ROW, models.embedding)


@query("select event_id, event_type, null as broken from events union all select null, null, '{broken'")
def json_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact written as JSON and read back, a broken line beside it."""
    path = f"{own_dir(spark)}/artifact-{uuid.uuid4().hex}"
    jobs.write_json(read(spark, sf_dir, "events").select("event_id", "event_type"), path)
    good, _ = jobs.read_json(spark, path, "event_id bigint, event_type string")
    _, bad = jobs.read_json(spark, fixtures.landed(spark, "broken", {"a.json": '{broken\n{"event_id": 1, "event_type": "x"}\n'}), "event_id bigint, event_type string")
    return good.withColumn("broken", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query(fixtures.rows_sql("name, valid", [(r[0], r[4]) for r in fixtures.FILINGS]))
def valid_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, [r[:4] for r in fixtures.FILINGS], "name string, length bigint, pages int, first string")
    return rows.select("name", jobs.valid_filing(F.col("length"), F.col("pages"), F.col("first")).alias("valid"))


@query("select vec_id, len(embedding)::bigint * 4 as bytes, true as same from embeddings")
def vector_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to bytes and back."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).withColumn("blob", vectors.to_blob("v"))
    return rows.select("vec_id", F.octet_length("blob").cast("bigint").alias("bytes"), (vectors.from_blob("blob") == F.col("v")).alias("same"))


@query("""with f as (select source, list(doc_id order by doc_id) filter (where n_chars > 500) as t, list(doc_id order by doc_id) filter (where n_chars <= 500 and lang = 'en') as i from documents group by source)
select count(*) filter (where len(coalesce(t, [])) + len(coalesce(i, [])) > 0) as sources, sum(len(coalesce(t, [])))::bigint as tables, sum(len(coalesce(i, [])))::bigint as images from f""")
def assets_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of all filings merged and counted."""
    when = lambda test: F.collect_list(F.when(test, F.col("doc_id").cast("string")))
    own = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_file")).agg(when(F.col("n_chars") > 500).alias("tables"), when((F.col("n_chars") <= 500) & (F.col("lang") == "en")).alias("images"))
    return jobs.merged_assets(own)[1]


@query(fixtures.rows_sql("address, ok, reason", [(m[0], m[3], m[4]) for m in fixtures.MAILS]))
def delivery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, [m[:3] for m in fixtures.MAILS], "address string, subject string, body string")
    return rows.withColumn("x", T.deliverable(F.col("address"), F.col("subject"), F.col("body"))).select("address", "x.ok", "x.reason")


@query(fixtures.rows_sql("seq, item, title, page, text", fixtures.SECTION_ROWS))
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line records to sections: contents pages, entries, headings in the body, texts."""
    return L.section_payload(fixtures.layout_lines(ship(spark)))[0].select("seq", "item", "title", "page", "text")


@query(fixtures.rows_sql("section_seq, sub_seq, title, level, page, path", fixtures.SUBSECTION_ROWS))
def document_subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.section_payload(fixtures.layout_lines(ship(spark)))[1].select("section_seq", "sub_seq", "title", "level", "page", F.array_join("path", " > ").alias("path"))


@query(fixtures.rows_sql("item, n, every", [("Item 1", 2, False), ("Item 1a", 1, False), ("Item 1", 2, True), ("Item 1a", 1, True), ("Item 2", 0, True)]))
def subsection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, subs = L.section_payload(fixtures.layout_lines(ship(spark)))
    return L.subsection_counts(own, subs).select("item", "n", F.lit(False).alias("every")).union(L.subsection_counts(own, subs, True).select("item", "n", F.lit(True)))


@query("""with h as (select conv_id, turn, case when turn % 3 = 0 then turn else -1 end as off, case when turn % 3 = 1 then role else 'no title' end as title from conversations),
r as (select conv_id, turn, role, length(text) as y from conversations)
select h.conv_id, h.turn, coalesce((select y from r where r.conv_id = h.conv_id and r.turn = h.off), (select min_by(y, r.turn) from r where r.conv_id = h.conv_id and r.role = h.title))::double as y0 from h""")
def heading_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings joined to their line records: by offset, else by text, the first of several."""
    rows = read(spark, sf_dir, "conversations")
    heads = rows.select(F.col("conv_id").alias("file"), "turn", F.lit(1).alias("page"), F.when(F.col("turn") % 3 == 0, F.col("turn")).otherwise(-1).alias("offset"), F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("no title").alias("title"))
    records = rows.select(F.col("conv_id").alias("file"), F.lit(1).alias("page"), F.col("turn").alias("offset"), F.col("role").alias("line"), F.col("turn").alias("line_no"), F.lit(0.0).alias("x0"), F.length("text").cast("double").alias("y0"))
    return L.record_of(heads, records).select(F.col("file").alias("conv_id"), "turn", "y0")


@query(fixtures.rows_sql("table_id, asset_type, page_start, page_end, section_ref_id, subsection_ref_id, n_rows, sources", fixtures.TABLES))
def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected regions of a document through all table steps."""
    d = fixtures.table_document(ship(spark))
    own = TB.run_tables(d["regions"], d["lines"], d["refs"], d["heads"])[0]
    return own.select("table_id", "asset_type", "page_start", "page_end", "section_ref_id", "subsection_ref_id", F.size("raw_rows").alias("n_rows"), F.array_join("source_table_ids", ",").alias("sources"))


@query(fixtures.rows_sql("step, n", fixtures.TABLE_STEPS))
def table_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table_document(ship(spark))
    return TB.run_tables(d["regions"], d["lines"], d["refs"], d["heads"])[1]


@query(fixtures.rows_sql("image_id, page, section_ref_id", fixtures.IMAGES))
def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fixtures.table_document(ship(spark))
    blocks = literal(spark, [("t.pdf", *b) for b in fixtures.BLOCKS], "file string, block_no int, page int, bbox array<double>")
    return assets.payload(d["regions"], d["lines"], blocks, d["refs"], d["heads"])["images"].select("image_id", "page", "section_ref_id")


@query(fixtures.rows_sql("ref, table_id", [("t1", "g1"), ("t3", "t3"), ("t9", None), ("t2", "g2")]))
def table_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to tables: by id, else by an id that a group took in, first one that has page crops."""
    tables = literal(spark, [("f", "g0", ["t2"], None), ("f", "g1", ["t1"], None), ("f", "g2", ["t2"], ["p1.png"]), ("f", "t3", [], None), ("f", "g3", ["t3"], ["p2.png"])], "source_file string, table_id string, source_table_ids array<string>, crops array<string>")
    return TB.by_alias(literal(spark, [("f", "t1"), ("f", "t3"), ("f", "t9"), ("f", "t2")], "source_file string, ref string"), tables).select("ref", "table_id")


@query(fixtures.rows_sql("chunk_id, header, text, token_count", [("table_00001", "Item 8", "Revenue | 10\nCosts | ", 5), ("table_00002", "Item 8", "x", 1), ("image_00001", "Item 7 > Liquidity", "Item 7 > Liquidity Image/figure on page 4 with bbox [1.0, 2.0].", 12)]))
def asset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and images as chunks of their own, header paths without empty parts."""
    tables = literal(spark, [("f", "t2", ["Item 8", ""], [["x"]], 3, 3, [0.0, 5.0]), ("f", "t1", ["", "Item 8", None], [["Revenue", "10"], ["Costs", None]], 2, 2, [0.0, 9.0])], "source_file string, table_id string, header_path array<string>, raw_rows array<array<string>>, page_start int, page_end int, bbox array<double>")
    images = literal(spark, [("f", "i1", ["Item 7", "", "Liquidity"], 4, [1.0, 2.0])], "source_file string, image_id string, header_path array<string>, page int, bbox array<double>")
    shown = ["chunk_id", F.array_join("header_path", " > ").alias("header"), "text", "token_count"]
    return C.table_chunks(tables).select(*shown).union(C.image_chunks(images).select(*shown))


@query("""with e as (select *, row_number() over (partition by user_id order by event_id desc) as back from events)
select 'artifact' as kind, user_id as session_id, event_id::varchar as name, value as v, 0 as n from e where back <= 24
union all select 'semantic', user_id, event_type, max_by(value, event_id), count(*)::int - 1 from events group by user_id, event_type""")
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results and notes of sessions as tables: the newest of a session, the last importance of a note."""
    events = read(spark, sf_dir, "events")
    own = M.store(turns(spark, sf_dir), events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.lit("t").alias("tool"), F.col("value").cast("string").alias("input"), F.lit("").alias("output")), events.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("content"), F.col("value").alias("importance"), F.col("event_id").alias("seq")))
    a = own["tool_artifacts"].select(F.lit("artifact").alias("kind"), "session_id", F.col("seq").cast("string").alias("name"), F.col("input_preview").cast("double").alias("v"), F.lit(0).alias("n"))
    return a.union(own["memory_semantic"].select(F.lit("semantic"), "session_id", "content", "importance", F.col("access_count").cast("int")))


@query("""with m as (select conv_id, min(turn) as created, max(turn) as updated, count(*) as messages from conversations group by 1),
b as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations),
f as (select conv_id, trim(string_agg('- ' || role || ': ' || substr(replace(coalesce(text, ''), chr(10), ' '), 1, 400), chr(10) order by turn)) as s from b where back > 4 group by conv_id)
select conv_id as session_id, coalesce(case when length(s) > 6000 then right(s, 6000) else s end, '') as summary, created, updated, messages from m left join f using (conv_id)""")
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = M.store(turns(spark, sf_dir))
    n = own["messages"].groupBy("session_id").agg(F.count("*").alias("messages"))
    return own["sessions"].join(n, "session_id")


@query(HYBRID + r""", c as (select query_id, rank, '[' || rank || '] ' || coalesce(source, 'unknown') || chr(10) || trim(regexp_replace(translate(coalesce(text, ''), chr(160), ' '), '\s+', ' ', 'g')) as b from h join documents using (doc_id) where rank <= 8)
select query_id, string_agg(b, chr(10) || chr(10) order by rank) as context from c group by 1""".replace("\\\\", "\\"))
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contexts of a question as one text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return prompts.contexts(hybrid(spark, sf_dir).join(docs, "doc_id"), F.col("text"))


# --- texts, predicates and lookups ---------------------------------------------


@query("""select doc_id, case when coalesce(source, '') = '' and coalesce(text, '') = '' then 'none' else concat_ws(chr(10), nullif(coalesce(source, ''), ''), nullif(coalesce(text, ''), '')) end as searched,
concat_ws(chr(10), case when coalesce(source, '') <> '' then 'Section: ' || source end, nullif(substr(coalesce(text, ''), 1, 100), '')) as reranked from documents""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are searched and as a reranker reads them."""
    path = F.array(F.coalesce("source", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", T.searchable_text(path, F.col("text"), F.lit("none")).alias("searched"), T.rerank_text(path, F.col("text"), 100).alias("reranked"))


@query("""with b as (select o_orderkey, (o_orderkey % 300)::double as x0, (o_custkey % 400)::double as y0, x0 + 50 + o_orderkey % 260 as x1, y0 + 40 + o_custkey % 350 as y1 from orders)
select o_orderkey, greatest(x0 - 8, 0) as left_, greatest(y0 - 6, 0) as top, least(x1 + 8, 612) as right_, least(y1 + 6, 792) as bottom,
coalesce(list_max(list_filter(range(72, 145, 6), lambda d: (x1 - x0) * (y1 - y0) / 5184 * d * d <= 850000)), 72)::int as dpi from b""")
def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with margins on the page, and the largest resolution of their pictures."""
    x, y = (F.col("o_orderkey") % 300).cast("double"), (F.col("o_custkey") % 400).cast("double")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.array(x, y, x + 50 + F.col("o_orderkey") % 260, y + 40 + F.col("o_custkey") % 350).alias("b"))
    p = TB.padded(F.col("b"), 8.0, 6.0)
    return rows.select("o_orderkey", p[0].alias("left_"), p[1].alias("top"), p[2].alias("right_"), p[3].alias("bottom"), TB.largest_dpi(F.col("b")).alias("dpi"))


ROW_FLAGS = [
    (1, ["Revenue", "10", "9"], True, False, True), (2, ["(in millions)", "2025", "2024"], True, False, True), (3, ["Year", "Amount per share"], False, True, True), (4, ["January 5, 2024", "Declared"], True, False, True),
    (5, ["Total of it", "x"], False, False, True), (6, ["Net income", "many words"], False, False, True), (7, ["We sell things", "in many places"], False, False, False), (8, [None, ""], False, False, False), (9, ["Thereafter", "5"], False, False, True), (10, ["x", "5"], False, False, False),
]


@query(fixtures.rows_sql("id, data, header, item", [(r[0], *r[2:]) for r in ROW_FLAGS]))
def table_row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, [r[:2] for r in ROW_FLAGS], "id int, r array<string>")
    return rows.select("id", TB.data_row(F.col("r")).alias("data"), TB.header_row(F.col("r")).alias("header"), TB.line_item_row(F.col("r")).alias("item"))


@query(r"""with w as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '\S+')) as n, len(list_filter(regexp_extract_all(coalesce(text, ''), '\S+'), lambda x: regexp_matches(x, '[0-9]'))) as d, len(regexp_extract_all(coalesce(text, ''), '[.!?](\s|$)')) as e from documents)
select doc_id, n >= 5 and ((d / greatest(n, 1) > 0.30 and e = 0) or (d / greatest(n, 1) > 0.22 and e < 3)) as residue from w""")
def table_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that read like the rest of a flattened table."""
    return read(spark, sf_dir, "documents").select("doc_id", C.table_residue(F.coalesce("text", F.lit(""))).alias("residue"))


@query("select doc_id::varchar as table_id, n_chars as page_start from documents where n_chars >= 100 and coalesce(lang, '') <> 'en' order by n_chars, doc_id::varchar limit 50")
def tables_to_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tables to parse, in page order, behind a page and outside some items."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("table_id"), F.col("n_chars").alias("page_start"), F.col("lang").alias("item"))
    return assets.to_parse(rows, min_page=100, without_items=["en"], n=50).select("table_id", "page_start")


@query("""select d.doc_id::varchar as table_id, coalesce(case when d.lang = 'en' then 'success' end, case when l.quality = 1 then 'success' end) as status, coalesce(case when d.lang = 'en' then 'own' end, case when l.quality = 1 then 'old ' || l.toxic end) as summary
from documents d left join labels l using (doc_id)""")
def parse_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier successful parses fill in where a table has none."""
    own = F.col("lang") == "en"
    now = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("table_id"), F.when(own, "success").alias("status"), F.when(own, "own").alias("summary"))
    old = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("table_id"), F.when(F.col("quality") == 1, "success").otherwise("error").alias("status"), F.concat(F.lit("old "), F.col("toxic").cast("string")).alias("summary"))
    return assets.carried_over(now, old).select("table_id", "status", "summary")


GATES = [(1, "abc", "2025", "ok", "FY2025"), (2, "abc, xyz", None, "needs_decomposition", None), (3, "ABC", "2024,FY2025", "ok", None), (4, None, " fy2024 ", "ok", "FY2024"), (5, " , ", "", "ok", None)]


@query(fixtures.rows_sql("id, status, fiscal_year", [(g[0], g[3], g[4]) for g in GATES]))
def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company at a time, one year or none."""
    rows = literal(spark, [g[:3] for g in GATES], "id int, tickers string, years string")
    status, year = scope.one_scope(scope.scope_list(F.col("tickers"), scope.ticker), scope.scope_list(F.col("years"), scope.fiscal_year))
    return rows.select("id", F.coalesce(status, F.lit("ok")).alias("status"), year.alias("fiscal_year"))


MARKED = "One. Two. Three. [[TABLE:a]] Four. Five. Six. [[TABLE:b]] Seven."


@query(fixtures.rows_sql("id, near", [(1, "Two. Three. [[TABLE:a]] Four. Five. Five. Six. [[TABLE:b]] Seven."), (2, "Five. Six. [[TABLE:b]] Seven."), (3, MARKED), (4, "No marker.")]))
def text_around_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = literal(spark, [(1, MARKED, None), (2, MARKED, ["b"]), (3, MARKED, ["z"]), (4, "No marker.", None)], "id int, content string, wanted array<string>")
    return rows.select("id", bodies.around_udf("content", "wanted").alias("near"))


@query(fixtures.rows_sql("kind, page, top, rows", [("table_header_band", 1, 700.0, "Year | Amount"), ("table_continuation", 2, 60.0, "2025 | 7 | 8")]))
def header_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header at the bottom of a page that no region holds, and the data row that goes on under it."""
    lines = literal(spark, [("f", 1, 700.0, ["Year", "Amount"]), ("f", 1, 690.0, ["We sell things"]), ("f", 1, 100.0, ["Year", "Amount"]), ("f", 1, 770.0, ["Year", "Fair value"]), ("f", 2, 60.0, ["2025", "7", "8"]), ("f", 2, 90.0, ["2024", "5", "6"])], "file string, page int, top double, cells array<string>")
    regions = literal(spark, [("f", 1, [0.0, 765.0, 500.0, 780.0]), ("f", 2, [0.0, 300.0, 500.0, 400.0])], "source_file string, page_start int, bbox array<double>")
    bands = assets.header_bands(lines, regions)
    shown = ["page", "top", F.array_join(F.transform("raw_rows", TB.row_text), "; ").alias("rows")]
    return bands.select(F.col("asset_type").alias("kind"), *shown).union(assets.continuations(bands, lines, regions).select("asset_type", *shown))


@query("""with n as (select user_id, event_type, event_id, value, lag(value) over (partition by user_id, event_type order by value, event_id) as before from events)
select event_id, sum(case when abs(value - before) <= 4 then 0 else 1 end) over (partition by user_id, event_type order by value, event_id)::bigint as cluster from n""")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments in lines: a new one where the place moves by more than four points."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("page"), F.col("value").alias("y0"), F.col("event_id").alias("x0"))
    return TB.line_clusters(rows).select(F.col("x0").alias("event_id"), "cluster")


@query(fixtures.rows_sql("table_id, text_anchor", [("table_001", "The following table shows sales"), ("table_002", None), ("table_003", "Assets are as follows here"), ("table_004", None), ("table_005", None)]))
def table_text_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest line above a region that says something."""
    lines = literal(spark, [("f.pdf", 1, 95.0, "(in millions)"), ("f.pdf", 1, 90.0, "short"), ("f.pdf", 1, 80.0, "The following table shows sales"), ("f.pdf", 1, 60.0, "A line that is farther away"), ("f.pdf", 1, 250.0, "Assets are as follows here"), ("f.pdf", 2, 400.0, "A line below the regions")], "file string, page int, y1 double, line string")
    own = TB.text_anchors(fixtures.regions(ship(spark)), lines)
    return own.select("table_id", F.when(F.col("table_id") != "table_002", F.col("text_anchor")).alias("text_anchor"))


@query(fixtures.rows_sql("ref_id, table_refs", [("I1", "table_group_001"), ("I1::sub_001", "table_group_001"), ("I2", "table_group_002,table_004"), ("I2::sub_001", "table_group_002,table_004")]))
def section_table_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table ids of each section and subsection, without those that groups took in."""
    d = fixtures.table_document(ship(spark))
    own = TB.run_tables(d["regions"], d["lines"], d["refs"], d["heads"])[0]
    return TB.unit_refs(own).select("ref_id", F.array_join("table_refs", ",").alias("table_refs"))


@query("select doc_id::varchar as chunk_id, coalesce(source, '') || ' > ' || coalesce(lang, '') as header, substr(trim(regexp_replace(translate(coalesce(text, ''), chr(160), ' '), '\\s+', ' ', 'g')), 1, 260) as preview, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::bigint as token_count from documents".replace("\\\\", "\\"))
def chunk_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a list shows them."""
    none = F.lit(None).cast("bigint").alias("token_count")
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("header_path"), "text", none)
    return assets.chunk_rows(rows)


@query("""with s as (select conv_id, row_number() over (partition by conv_id order by turn) as n, role, length(coalesce(text, '')) as size from conversations), m as (select conv_id, max(n) as n from s group by 1)
select conv_id as run_id, 0::bigint as pos, '{"type":"started"}' as line from m union all select conv_id, 2 * n - 1, '{"type":"step_start","step":' || n || ',"tool":"' || role || '"}' from s
union all select conv_id, 2 * n, '{"type":"step","step":' || n || ',"tool":"' || role || '","size":' || size || '}' from s
union all select conv_id, 2 * n + 1, case when conv_id % 5 = 0 then '{"type":"error","error":"stopped"}' else '{"type":"done","steps":' || n || '}' end from m""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as lines of events: started, steps, done or error."""
    rows = read(spark, sf_dir, "conversations")
    steps = rows.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.col("role").alias("tool"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    runs = rows.select(F.col("conv_id").alias("run_id")).distinct().withColumn("error", F.when(F.col("run_id") % 5 == 0, "stopped"))
    return assets.event_lines(steps, runs).select("run_id", F.col("pos").cast("bigint").alias("pos"), "line")


@query(fixtures.rows_sql("file_id, chunks, tables, index_ready, index_reason", [("a", 5, 2, True, None), ("b", 7, 0, False, "stale_source"), ("c", 0, 3, False, None)]))
def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the state of their index, missing counts from their payloads."""
    files = literal(spark, [("a", 5, None), ("b", None, 0), ("c", None, None)], "file_id string, chunks int, tables int")
    audit = literal(spark, [("a", True, None), ("b", False, "stale_source")], "file_id string, valid boolean, reason string")
    return assets.enriched(files, audit, literal(spark, [("a", 9, 2), ("b", 7, 9), ("c", None, 3)], "file_id string, chunks int, tables int"))


@query(fixtures.rows_sql("id, body", [(1, "We sold more."), (2, "Costs 40 35 stay where no row of three cells is."), (3, "A (b) [c] d")]))
def flattened_rows_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without the flattened rows of a table; cells are taken as they are written."""
    rows = literal(spark, [(1, "We sold Total 10  9 more.", [["Total", "10", "9"], ["x", None, None]]), (2, "Costs 40 35 stay where no row of three cells is.", [["Costs", "40"]]), (3, "A (b) [c] x.y (1) 2 d", [["x.y", "(1)", "2"]])], "id int, body string, rows array<array<string>>")
    return rows.select("id", C.without_rows(F.col("body"), F.col("rows")).alias("body"))


@query("select count(*) as n, count(distinct status) as kinds, max(question) as last from (select case when turn % 2 = 0 then 'a' else 'b' end as status, text as question from conversations union all select 'c', 'zzz')")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log of questions, read back."""
    path = f"{own_dir(spark)}/audit-{uuid.uuid4().hex}"
    readers.append_log(read(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("status"), F.col("text").alias("question")), path)
    readers.append_log(literal(spark, [("c", "zzz")], "status string, question string"), path)
    return spark.read.schema("status string, question string").json(path).agg(F.count("*").alias("n"), F.count_distinct("status").alias("kinds"), F.max("question").alias("last"))


@query(fixtures.rows_sql("id, shown, plain", [(1, "a | \nb | c", "It rose."), (2, "| a |", "One.\nTwo."), (3, "raw", "")]))
def table_and_answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as text, parsed markdown first; answers without the agent's own lines."""
    rows = literal(spark, [(1, " ", [["a", None], ["b", "c"]], "raw", "Thought: x\nIt rose.\n Action: y"), (2, "| a |", [["x"]], "raw", "One.\nObservation: z\nTwo."), (3, None, [], "raw", None)], "id int, parsed string, rows array<array<string>>, raw string, answer string")
    return rows.select("id", T.markdown(F.col("parsed"), F.col("rows"), F.col("raw")).alias("shown"), T.without_meta_lines(F.col("answer")).alias("plain"))


__all__ = ["ORACLE_SQL", "QUERIES", "chunker", "readers", "vectors"]
