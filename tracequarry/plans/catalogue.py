"""The registry of demonstration queries: operators bound to the given tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions import text as tx
from tracequarry.functions import trees
from tracequarry.operators import evidence, graph, hybrid, retrieval, versions
from tracequarry.plans.registry import QUERIES, SQL
from tracequarry.plans.registry import query as _query
from tracequarry.plans.registry import table as _t
from tracequarry.streaming import sync

def queries() -> dict:
    from tracequarry.plans import hybrid, ingestion, knowledge, lineage, lines, links, releases, requirements, reviews, sources  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


# ---- retrieval

_BM25 = r"""
with corpus as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_./:-]+') as tokens from documents),
post as (select doc_id, term, count(*) as tf, any_value(len(tokens)) as dl from (select doc_id, tokens, unnest(tokens) as term from corpus) group by doc_id, term),
stats as (select count(*) as n, avg(coalesce(len(tokens), 0)) as avgdl from corpus),
raw as (select term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) as raw from post, stats group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
asked as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as term from benchmark) group by all),
bm25 as (
  select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from asked join post using (term) join idf using (term), stats group by query_id, doc_id having sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)
"""

_DENSE = """
asked_v as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id in (select item_id from benchmark)),
near as (select query_id, vec_id as doc_id, round(list_cosine_similarity(q, embedding::double[]), 9) as score from asked_v, embeddings where vec_id <> query_id),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from near) where rank <= 50)
"""


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text, tokens) and queries(query_id, text, tokens)"""
    corpus = _t(spark, d, "documents").select("doc_id", "text", F.coalesce(tx.search_tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    return corpus, _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", tx.search_tokens(F.col("text")).alias("tokens"))


def _bm25(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    corpus, asked = _texts(spark, d)
    return retrieval.bm25(corpus.select("doc_id", "tokens"), asked.select("query_id", "tokens"), k=k).withColumn("score", F.round("score", 9))


def _dense(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return retrieval.nearest(vectors, vectors.join(items, "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id"), k)


@_query(_BM25 + "select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from bm25) where rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(_bm25(spark, d, 10), 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(
    """with near as (select q.vec_id as query_id, e.vec_id as doc_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as score
    from embeddings q, embeddings e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id)
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from near) where rank <= 10"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.nearest(vectors, asked, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(
    _BM25 + "," + _DENSE + """, lexical as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25 qualify rank <= 50),
    fused as (select query_id, doc_id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9) as score from dense d full join lexical l using (query_id, doc_id))
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from fused) where rank <= 10"""
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    fused = retrieval.reciprocal_rank_fusion(_dense(spark, d), retrieval.top(_bm25(spark, d, 50), 50)).withColumn("score", F.round("score", 9))
    return retrieval.top(fused, 10).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(
    _BM25 + "," + _DENSE + """, both_s as (select query_id, doc_id, coalesce(b.score, 0) as bm25, greatest(coalesce(d.score, 0), 0) as vector from bm25 b full join dense d using (query_id, doc_id)),
    lin as (select query_id, doc_id, round(0.6 * coalesce(bm25 / nullif(max(bm25) over (partition by query_id), 0), 0) + 0.4 * coalesce(vector / nullif(max(vector) over (partition by query_id), 0), 0), 9) as score from both_s),
    cut as (select * from (select *, max(score) over (partition by query_id) as best from lin) where score >= greatest(0.30, 0.58 * best))
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from cut) where rank <= 10"""
)
def hybrid_linear_cutoff(spark: SparkSession, d: str) -> DataFrame:
    lexical = _bm25(spark, d).withColumnRenamed("score", "bm25")
    dense = _dense(spark, d).select("query_id", "doc_id", F.greatest("score", F.lit(0.0)).alias("vector"))
    fused = retrieval.linear_fusion(lexical.join(dense, ["query_id", "doc_id"], "full_outer"), {"bm25": 0.6, "vector": 0.4}, digits=9)
    return fused.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_EVERY = """
asked_v as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id in (select item_id from benchmark)),
near as (select query_id, vec_id as doc_id, round(list_cosine_similarity(q, embedding::double[]), 9) as score from asked_v, embeddings where vec_id <> query_id)
"""


@_query(
    _BM25 + "," + _EVERY + """, dense as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from near qualify rank <= 80),
    lexical as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25),
    fused as (select query_id, doc_id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0), 9) as score from dense d full join lexical l using (query_id, doc_id))
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from fused) where rank <= 10"""
)
def hybrid_rrf_whole(spark: SparkSession, d: str) -> DataFrame:
    """hybrid_rrf with the reference's 8 k dense candidates and the lexical rank of every document with a score above 0."""
    found = hybrid.fused_search(*_texts(spark, d), _dense(spark, d, 80), k=10, boosted=False)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(
    _BM25 + "," + _EVERY + """, both_s as (select query_id, doc_id, coalesce(b.score, 0) as bm25, greatest(coalesce(d.score, 0), 0) as vector from bm25 b full join near d using (query_id, doc_id)),
    lin as (select query_id, doc_id, round(0.6 * coalesce(bm25 / nullif(max(bm25) over (partition by query_id), 0), 0) + 0.4 * coalesce(vector / nullif(max(vector) over (partition by query_id), 0), 0), 9) as score from both_s),
    cut as (select * from (select *, max(score) over (partition by query_id) as best from lin) where score >= greatest(0.30, 0.58 * best))
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from cut) where rank <= 10"""
)
def hybrid_linear_whole(spark: SparkSession, d: str) -> DataFrame:
    """hybrid_linear_cutoff with the vector score of every document."""
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.join(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    near = retrieval.similarities(vectors, asked).select("query_id", "doc_id", F.greatest("score", F.lit(0.0)).alias("vector"))
    lexical = _bm25(spark, d).withColumnRenamed("score", "bm25")
    fused = retrieval.linear_fusion(lexical.join(near, ["query_id", "doc_id"], "full_outer"), {"bm25": 0.6, "vector": 0.4}, digits=9)
    return fused.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@_query(
    """with near as (select q.vec_id as query_id, q.label as ql, e.label as el, e.vec_id as doc_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as score
    from embeddings q, embeddings e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id),
    ranked as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from near qualify rank <= 10),
    n as (select q.vec_id as query_id, count(*) - 1 as n_relevant from embeddings q join embeddings e on q.label = e.label where q.vec_id % 20 = 0 group by q.vec_id),
    g as (select query_id, count(*) as found, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from ranked where ql = el group by query_id)
    select n.query_id, round(coalesce(found, 0) / 10, 6) as "precision", round(coalesce(found, 0) / n_relevant, 6) as recall, round(coalesce(1 / first, 0), 6) as reciprocal_rank,
      round(coalesce(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda r: 1 / log2(r + 1))), 0), 6) as ndcg
    from n left join g using (query_id) where n_relevant > 0"""
)
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    asked = e.where("doc_id % 20 = 0")
    ranked = retrieval.nearest(e.select("doc_id", "vector"), asked.select(F.col("doc_id").alias("query_id"), "vector"), 10)
    labelled = ranked.join(e.select("doc_id", "label"), "doc_id").join(asked.select(F.col("doc_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    totals = asked.select(F.col("doc_id").alias("query_id"), "label").join(e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label")
    out = retrieval.evaluate_hits(labelled.where("label = wanted"), totals, 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")])


@_query("select doc_id, quality = 1 as positive, upper(lang) as scope from labels join documents using (doc_id) where quality is not null")
def eval_case_build(spark: SparkSession, d: str) -> DataFrame:
    joined = _t(spark, d, "labels").where("quality is not null").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return joined.select("doc_id", (F.col("quality") == 1).alias("positive"), F.upper("lang").alias("scope"))


# ---- text and scope

_PADDED = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')) || ' '"


@_query(
    r"""select page_id, case when length(p) > 1 then regexp_replace(p, '/$', '') else p end as endpoint
    from (select page_id, regexp_replace(regexp_replace(regexp_replace(split_part(url, '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+', '/', 'g'), '\{[^/}]*\}', '{}', 'g') as p from pages)"""
)
def endpoint_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", tx.endpoint_key(F.col("url")).alias("endpoint"))


@_query(r"select regexp_replace(lower(replace(trim(url), '\', '/')), '/+$', '') as scope, count(*) as n_pages from pages group by 1")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").groupBy(tx.scope_key(F.col("url")).alias("scope")).agg(F.count("*").alias("n_pages"))


@_query(f"select doc_id, term from (select doc_id, {_PADDED} as p from documents), (values ('the'), ('of the'), ('est'), ('that the'), ('and')) v(term) where contains(p, ' ' || term || ' ')")
def mention_join(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spark.sql("values ('the'), ('of the'), ('est'), ('that the'), ('and') as v(term)")
    return retrieval.mention_join(_t(spark, d, "documents"), vocabulary)


@_query(
    """select kind, document_id, n_chars from (
      select 'DOCUMENT' as kind, left(sha256('DOCUMENT:' || doc_id), 40) as document_id, length(text) as n_chars from documents union all
      select 'PAGE', left(sha256('PAGE:' || page_id), 40), length(html) from pages union all
      select 'TURN', left(sha256('TURN:' || conv_id || '/' || turn), 40), length(text) from conversations)"""
)
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    def kind(name: str, table: str, key, body: str) -> DataFrame:
        return _t(spark, d, table).select(F.lit(name).alias("kind"), tx.document_id(F.lit(name), key.cast("string")).alias("document_id"), F.length(body).cast("long").alias("n_chars"))

    turn = F.concat_ws("/", "conv_id", "turn")
    return kind("DOCUMENT", "documents", F.col("doc_id"), "text").unionByName(kind("PAGE", "pages", F.col("page_id"), "html")).unionByName(kind("TURN", "conversations", turn, "text"))


@_query(
    """select doc_id, number::int as number, length(chunk) as n_chars, md5(chunk) as digest
    from (select doc_id, unnest(range(0, greatest(length(text) - 1, 0) // 500 + 1)) as number, text from documents) r, lateral (select substr(text, number * 500 + 1, 600) as chunk) c where trim(chunk) <> ''"""
)
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    cut = _t(spark, d, "documents").select("doc_id", F.explode(tx.fixed_chunks(F.col("text"), 500, 600)).alias("c"))
    return cut.select("doc_id", "c.number", F.length("c.chunk").cast("long").alias("n_chars"), F.md5(F.col("c.chunk").cast("binary")).alias("digest"))


@_query(
    r"""select doc_id, to_json(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[a-z0-9.]+[a-z]')).list_sort()) as emails, len(regexp_extract_all(text, '[0-9]+'))::int as n_numbers from documents where text is not null"""
)
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.to_json(F.array_sort(F.array_distinct(every("[A-Za-z0-9._]+@[a-z0-9.]+[a-z]")))).alias("emails"), F.size(every("[0-9]+")).alias("n_numbers"))


@_query(
    """select p_partkey, v.value, case when v.value is null then false else v.value <= p_size end as expected
    from part, lateral (select unnest([p_size - step, p_size::double, p_size + step, null]) as value from (select case when p_size > 1000 then p_size * 0.001 else 0.01 end as step)) v"""
)
def boundary_values(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    cases = _t(spark, d, "part").select("p_partkey", F.explode(tx.boundary_values(size, F.lit("<="))).alias("v"))
    return cases.select("p_partkey", "v.value", "v.expected")


@_query(
    """with c as (select c_custkey, upper(left(c_mktsegment, 2)) as m, upper(left(r_name, 2)) as r, c_custkey % 4 as k from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select c_custkey as doc_id, case when c_custkey % 3 = 0 then 'regionCode' else 'unitCode' end as attribute, array_to_string(list_sort([m, r].list_distinct()), ',') as accepted,
      array_to_string(list_sort((case k when 0 then [r] when 1 then [m, 'ZZ'] when 2 then [r, m] end).list_distinct()), ',') as rejected, array_to_string(list_sort((case k when 0 then [r] when 1 then [m] when 2 then [r, m] end).list_distinct()), ',') as contradicted from c where k < 3"""
)
def value_rule_conflict(spark: SparkSession, d: str) -> DataFrame:
    joined = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m, r = (F.upper(F.substring(c, 1, 2)) for c in ("c_mktsegment", "r_name"))
    k = F.col("c_custkey") % 4
    rejected = F.when(k == 0, r).when(k == 1, F.concat(m, F.lit(", ZZ"))).when(k == 2, F.concat(r, F.lit(" and "), m)).otherwise("ZZ")
    name = F.when(F.col("c_custkey") % 3 == 0, "regionCode").otherwise("unitCode")
    texts = joined.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("For "), name, F.lit(" accept "), m, F.lit(", "), r, F.lit(". It shall reject "), rejected, F.lit(".")).alias("text"))
    out = evidence.rule_conflicts(evidence.value_rules(texts))
    return out.select("doc_id", "attribute", *[F.array_join(c, ",").alias(c) for c in ("accepted", "rejected", "contradicted")])


@_query(r"select page_id, len(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*'))::int as n_tags, len(regexp_extract_all(html, 'href=\"[^\"]*\"'))::int as n_links from pages")
def html_symbols(spark: SparkSession, d: str) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return _t(spark, d, "pages").select("page_id", count("<[a-zA-Z][a-zA-Z0-9]*").alias("n_tags"), count('href="[^"]*"').alias("n_links"))


# ---- versions

_LINES = "select l_partkey, l_suppkey, l_returnflag, l_linestatus, cast(l_discount as varchar) as disc, l_orderkey * 10 + l_linenumber as seq, month(l_shipdate) % 2 as side from lineitem"


@_query(
    f"""with l as ({_LINES}),
    o as (select l_partkey, l_suppkey, [m[2], m[3]] as v from (select l_partkey, l_suppkey, max((seq, l_returnflag, l_linestatus)) as m from l where side = 1 group by all)),
    n as (select l_partkey, l_suppkey, [m[2], m[3]] as v from (select l_partkey, l_suppkey, max((seq, l_returnflag, l_linestatus)) as m from l where side = 0 group by all))
    select l_partkey, l_suppkey, case when o.v is null then 'ADDED' when n.v is null then 'REMOVED' when o.v <> n.v then 'CHANGED' else 'UNCHANGED' end as change,
      case when o.v is null or n.v is null then 0 else (o.v[1] <> n.v[1])::int + (o.v[2] <> n.v[2])::int end as n_changed
    from o full join n using (l_partkey, l_suppkey)"""
)
def version_full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    odd = F.month("l_shipdate") % 2 == 1
    out = versions.compare_versions(lines.where(odd), lines.where(~odd), ["l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"], "seq")
    return out.select("l_partkey", "l_suppkey", "change", F.size("changed").alias("n_changed"))


@_query(
    """with l as (select *, lag(l_returnflag) over w as rf, lag(l_linestatus) over w as ls, row_number() over w as rn from lineitem window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber))
    select l_partkey, l_orderkey, l_linenumber, case when rn = 1 then 'INITIAL' when rf <> l_returnflag or ls <> l_linestatus then 'CHANGED' else 'UNCHANGED' end as status from l"""
)
def version_lag_timeline(spark: SparkSession, d: str) -> DataFrame:
    out = versions.timeline(_t(spark, d, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "status")


@_query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def latest_per_family(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest(_t(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@_query(
    """with q as (select lower(trim(p_name)) as source, count(distinct lower(p_brand)) as targets, count(distinct lower(p_type)) as rules, count(distinct p_size) as transforms, count(*) as n,
      count(distinct (lower(p_brand), lower(p_type), p_size)) as kinds from part group by 1 having count(*) > 1 and lower(trim(p_name)) <> '')
    select source, 'COMPETING_TARGETS' as issue from q where targets > 1 union all select source, 'CONFLICTING_NULL_RULES' from q where rules > 1
    union all select source, 'CONFLICTING_TRANSFORMS' from q where transforms > 1 union all select source, 'DUPLICATE_ACTIVE_DEFINITION' from q where n > kinds"""
)
def quality_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return versions.quality_issues(_t(spark, d, "part"), "p_name", "p_brand", "p_type", "p_size")


@_query(
    """with d as (select doc_id, doc_id // 2 as path, sha256(case when doc_id // 2 % 3 = 0 then lang else text end) as h from documents), e as (select * from d where doc_id % 2 = 0 and doc_id % 14 > 0), o as (select * from d where doc_id % 2 = 1 and doc_id % 11 > 0)
    select cast(path as varchar) as path, case when e.h is null then 'ADDED' when o.h is null then 'REMOVED' when e.h <> o.h then 'MODIFIED' else 'UNCHANGED' end as change from e full join o using (path)"""
)
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    path = F.floor(F.col("doc_id") / 2)
    docs = _t(spark, d, "documents").select("doc_id", path.cast("string").alias("path"), F.when(path % 3 == 0, F.col("lang")).otherwise(F.col("text")).alias("content"))
    return versions.snapshot_diff(docs.where("doc_id % 2 = 0 and doc_id % 14 > 0"), docs.where("doc_id % 2 = 1 and doc_id % 11 > 0"))


@_query("select source, lang, 1 as version from documents group by source, lang")
def fingerprint_capture(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    prints = versions.fingerprint(files, ["source", "lang"])
    history = prints.where("false").withColumn("version", F.lit(1))
    return versions.capture(prints, history, ["source", "lang"]).select("source", "lang", "version")


@_query(
    """with s as (select o_custkey, year(o_orderdate) as year, list_sort(list_distinct(list(o_orderpriority))) as items from orders group by all),
    b as (select *, lag(items) over (partition by o_custkey order by year) as before from s)
    select o_custkey, year::int as year, len(list_filter(items, lambda x: not list_contains(before, x)))::int as n_added, len(list_filter(before, lambda x: not list_contains(items, x)))::int as n_removed, len(list_intersect(items, before))::int as n_kept from b where before is not null"""
)
def set_changes(spark: SparkSession, d: str) -> DataFrame:
    out = versions.set_changes(_t(spark, d, "orders").withColumn("year", F.year("o_orderdate")), ["o_custkey"], "year", "o_orderpriority")
    return out.select("o_custkey", "year", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), "n_kept")


@_query(
    """with p as (select s_suppkey, (case when s_acctbal < 0 then 40 else 0 end + case when s_nationkey % 2 = 0 then 20 else 0 end + case when s_acctbal > 5000 then 25 else 0 end)::int as points from supplier)
    select s_suppkey, points, case when points >= 60 then 'HIGH' when points >= 25 then 'MEDIUM' else 'LOW' end as level from p"""
)
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    rules = {"NEGATIVE_BALANCE": (F.col("s_acctbal") < 0, 40), "EVEN_NATION": (F.col("s_nationkey") % 2 == 0, 20), "LARGE_BALANCE": (F.col("s_acctbal") > 5000, 25)}
    return versions.risk(_t(spark, d, "supplier"), rules).select("s_suppkey", "points", "level")


@_query(
    """select split_part(lower(trim(text)), ' ', 1) as case_key, count(*) as n_rows, count(distinct role) > 1 as conflict, count(distinct conv_id) as n_sources from conversations group by 1"""
)
def dedup_consolidate(spark: SparkSession, d: str) -> DataFrame:
    out = versions.consolidate(_t(spark, d, "conversations"), F.split(F.lower(F.trim("text")), " ")[0], F.struct("conv_id", "turn"), ["role"], "conv_id")
    return out.select("case_key", "n_rows", "conflict", F.size("sources").cast("long").alias("n_sources"))


# ---- JSON

@_query("""select event_id, k as path, json_extract(props, '$.' || k)::varchar as value from (select event_id, props, unnest(json_keys(props)) as k from events)""")
def json_leaf_flatten(spark: SparkSession, d: str) -> DataFrame:
    return trees.leaves(_t(spark, d, "events"), "event_id", "props")


@_query(
    """with o as (select o_orderkey, nullif(o_orderstatus, 'P') as a, o_orderpriority as b, nullif(lag(o_orderstatus) over w, 'P') as pa, lag(o_orderpriority) over w as pb from orders window w as (partition by o_custkey order by o_orderkey))
    select o_orderkey, 'status' as path, case when pa is null then 'ADDED' when a is null then 'REMOVED' else 'CHANGED' end as change from o where pb is not null and pa is distinct from a union all select o_orderkey, 'order.priority', 'CHANGED' from o where pb is not null and pb <> b"""
)
def json_leaf_diff(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.struct(F.col("o_orderpriority").alias("priority")).alias("order")))
    pairs = _t(spark, d, "orders").withColumn("new", body).withColumn("old", F.lag("new").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("old is not null")
    return trees.leaf_diff(pairs.select("o_orderkey", "old", "new"), "o_orderkey", "old", "new").select("o_orderkey", "path", "change")


@_query(
    """with t as (select conv_id, turn, role, text, lag(role) over w as r0, lag(text) over w as t0, lag(1) over w as has from conversations window w as (partition by conv_id order by turn)),
    p as (select conv_id || '/' || turn as pair_id, r0, role as r1, length(t0) as c0, length(text) as c1, string_split(t0, ' ') as w0, string_split(text, ' ') as w1 from t where has is not null),
    w as (select pair_id, i, w0[i] as a, w1[i] as b from (select *, unnest(range(1, greatest(len(w0), len(w1)) + 1)) as i from p where w0 is not null and w1 is not null)),
    n as (select pair_id, 'role' as path, to_json(r0)::varchar as e, to_json(r1)::varchar as a from p where r0 is distinct from r1 union all select pair_id, 'said.chars', c0::varchar, c1::varchar from p where c0 is distinct from c1
      union all select pair_id, 'said.words', to_json(w0)::varchar, to_json(w1)::varchar from p where (w0 is null) <> (w1 is null) union all select pair_id, 'said.words[' || (i - 1) || ']', to_json(a)::varchar, to_json(b)::varchar from w where a is distinct from b),
    m as (select pair_id, path, nullif(e, 'null') as expected, nullif(a, 'null') as actual from n)
    select pair_id, path, case when actual is null then 'MISSING_IN_ACTUAL' when expected is null then 'UNEXPECTED_IN_ACTUAL' else 'VALUE_MISMATCH' end as issue, expected, actual from m
    union all select pair_id, 'said.words', 'LIST_LENGTH_MISMATCH', to_json(w0)::varchar, to_json(w1)::varchar from p where len(w0) <> len(w1)"""
)
def json_structural_compare(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    body = F.to_json(F.struct("role", F.struct(F.length("text").alias("chars"), F.split("text", " ").alias("words")).alias("said")))
    pairs = _t(spark, d, "conversations").withColumn("actual", body).withColumn("expected", F.lag("actual").over(w)).where("expected is not null")
    pairs = pairs.select(F.concat_ws("/", "conv_id", "turn").alias("pair_id"), "expected", "actual")
    return trees.compare(pairs, "pair_id", "expected", "actual")


# ---- joins, evidence

@_query("select c_custkey, o.n is not null as found from customer left join (select o_custkey, count(*) as n from orders group by 1) o on c_custkey = o_custkey")
def semi_anti_validate(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = _t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    gone = evidence.without(customers, orders, ["c_custkey"]).withColumn("found", F.lit(False))
    return customers.join(orders, "c_custkey", "left_semi").withColumn("found", F.lit(True)).unionByName(gone)


@_query(
    """with b as (select event_id, user_id, ts from events where event_type = 'purchase'), e as (select event_id as other_id, user_id, ts as other_ts from events where event_type = 'error'),
    p as (select event_id as id, other_id, abs(epoch_us(ts) - epoch_us(other_ts)) / 86.4e9 as days_apart from b join e using (user_id))
    select id, other_id, round(days_apart, 6) as days_apart, rank from (select *, row_number() over (partition by id order by days_apart, other_id)::int as rank from p where days_apart <= 1) where rank <= 3"""
)
def interval_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts")
    failed = e.where("event_type = 'error'").select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_ts"))
    return evidence.nearest_in_time(bought, failed, ["user_id"], 1).select("id", "other_id", F.round("days_apart", 6).alias("days_apart"), "rank")


@_query(
    """with b as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts as seen_at, max(event_id) as seen_id from events where event_type = 'view' group by all)
    select event_id, seen_id from b asof left join v on b.user_id = v.user_id and b.ts >= v.seen_at"""
)
def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("seen_at")).agg(F.max("event_id").alias("seen_id"))
    return evidence.as_of(bought, viewed, ["user_id"], "ts", "seen_at").select("event_id", "seen_id")


@_query(
    """with parts as (select distinct l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45), brands as (select distinct p_brand from part where p_partkey in (select l_partkey from parts))
    select p_partkey, case when p_partkey in (select l_partkey from parts) then 'DIRECTLY_AFFECTED' when p_brand in (select p_brand from brands) then 'POSSIBLY_AFFECTED' else 'UNAFFECTED' end as impact from part"""
)
def impact_classify(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part").select("p_partkey", "p_brand")
    changed = _t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    brands = part.join(changed, "p_partkey", "left_semi").select("p_brand").distinct()
    return evidence.classify_impact(part, changed, part.join(brands, "p_brand", "left_semi"), "p_partkey").select("p_partkey", "impact")


@_query(
    """select l_partkey, count(distinct n_regionkey) as n_regions, count(distinct o_custkey) as n_customers, count(distinct n_regionkey) >= 2 as shared
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"""
)
def shared_component(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    uses = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(o.select("o_orderkey", "o_custkey", "n_regionkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return evidence.reverse_rollup(uses, "l_partkey", {"n_regions": "n_regionkey", "n_customers": "o_custkey"})


@_query(
    """with strong as (select l_partkey as ticket, count(distinct l_orderkey) as n from lineitem where l_returnflag = 'A' and l_quantity > 48 group by 1), every as (select l_partkey as ticket, count(distinct l_orderkey) as n from lineitem where l_quantity > 48 group by 1)
    select p_partkey as ticket, case when s.n is not null then 'ACCEPTED_LINE' when e.n is not null then 'ANY_LINE' end as covered_by, coalesce(e.n, 0) as n_items, case when e.n is null then 'GAP' else 'VERIFIED' end as classification
    from part left join strong s on p_partkey = s.ticket left join every e on p_partkey = e.ticket"""
)
def coverage_explode(spark: SparkSession, d: str) -> DataFrame:
    links = _t(spark, d, "lineitem").where("l_quantity > 48").groupBy("l_orderkey", "l_returnflag").agg(F.collect_set("l_partkey").alias("ticket_list")).withColumnRenamed("l_orderkey", "item")
    return evidence.coverage([("ACCEPTED_LINE", links.where("l_returnflag = 'A'")), ("ANY_LINE", links)], _t(spark, d, "part").select(F.col("p_partkey").alias("ticket")))


@_query(
    """with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as term from documents), b as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as term from benchmark),
    s as (select item_id, doc_id, count(*) filter (where length(term) >= 8) as code, count(*) filter (where length(term) between 5 and 7) as tests, count(*) as overlap from w join b using (term) where length(term) >= 5 group by all),
    p as (select item_id, doc_id, greatest(0, least(100, case when code > 0 then least(12, 2 * code) else 0 end + case when tests > 0 then least(15, 5 + 2 * tests) else 0 end + least(10, overlap)))::int as score from s)
    select item_id, doc_id, score, case when score >= 30 then 'HIGH' when score >= 25 then 'MEDIUM' else 'LOW' end as band from p where score >= 20"""
)
def correlation_score(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t, key: _t(spark, d, t).select(key, F.explode(F.array_distinct(tx.search_tokens(F.col("text")))).alias("term")).where("length(term) >= 5")
    hits = words("documents", "doc_id").join(words("benchmark", "item_id"), "term")
    counts = hits.groupBy("item_id", "doc_id").agg(F.count_if(F.length("term") >= 8).alias("code"), F.count_if(F.length("term") < 8).alias("tests"), F.count("*").alias("overlap"))
    none = F.lit(0)
    score = evidence.correlation_score(none, F.col("code"), none, F.col("tests"), none, none, F.col("overlap")).cast("int")
    return counts.select("item_id", "doc_id", score.alias("score")).where("score >= 20").withColumn("band", evidence.band(F.col("score"), 30, 25))


@_query(
    """with n as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as pos, count(*) over (partition by event_type) as n from events where value is not null)
    select event_type, any_value(n) as n, round(median(value), 6) as p50, round(min(value) filter (where pos = floor(0.95 * (n - 1))), 6) as p95 from n group by event_type"""
)
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.percentiles(_t(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@_query(
    """with p as (select page_id, string_split(regexp_replace(split_part(url, '?', 1), '^[a-z]+://', ''), '/') as seg from pages),
    e as (select page_id, array_to_string(seg[1:k], '/') as prefix, k from p, lateral (select unnest(range(1, len(seg) + 1)) as k) s)
    select prefix, count(distinct page_id) as n_pages from e group by 1"""
)
def prefix_join(spark: SparkSession, d: str) -> DataFrame:
    seg = F.split(F.regexp_replace(F.split("url", r"\?")[0], "^[a-z]+://", ""), "/")
    pages = _t(spark, d, "pages").select("page_id", seg.alias("seg"))
    prefixes = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("seg")), lambda k: F.array_join(F.slice(F.col("seg"), F.lit(1), k), "/"))).alias("prefix"))
    return prefixes.groupBy("prefix").agg(F.countDistinct("page_id").alias("n_pages"))


@_query(
    """select p_partkey, p_name, p_brand, a - o as n_others from (select p_partkey, p_name, p_brand, count(*) over (partition by p_name) as a, count(*) over (partition by p_name, p_brand) as o from part) where a > o"""
)
def configuration_collisions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.collisions(_t(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_name"], "p_brand")


# ---- graphs

_EDGES = """edges as (select 'n' || c_nationkey as source, 'c' || c_custkey as target from customer union select 'c' || o_custkey, 'o' || o_orderkey from orders union select 'o' || l_orderkey, 'p' || l_partkey from lineitem)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    link = lambda t, a, x, b, y: _t(spark, d, t).select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit(f"{a}{b}".upper()).alias("type"))
    return link("customer", "n", "c_nationkey", "c", "c_custkey").unionByName(link("orders", "c", "o_custkey", "o", "o_orderkey")).unionByName(link("lineitem", "o", "l_orderkey", "p", "l_partkey"))


@_query(f"with recursive {_EDGES}, r(seed, node, depth) as (select 'n' || n_nationkey, 'n' || n_nationkey, 0 from nation union select seed, target, depth + 1 from r join edges on node = source where depth < 3) select seed, node, min(depth) as depth from r group by all")
def bfs_bounded(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_edges(spark, d), _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("seed")), 3)


@_query(
    f"with recursive {_EDGES}, both_ as (select source as a, target as b from edges union select target, source from edges), r(seed, node, depth) as (select 's' || s_suppkey, 'n' || s_nationkey, 0 from supplier where s_acctbal < 0 union select seed, b, depth + 1 from r join both_ on node = a where depth < 2) select seed, node, min(depth)::int as depth from r group by all"
)
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    low = _t(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("who"), F.concat(F.lit("n"), "s_nationkey").alias("seed"))
    near = graph.reach(_edges(spark, d), low.select("seed").distinct(), 2, undirected=True, plain=True)
    # few seeds have many rows each: near ones are dealt out in ranges, into tasks of about 20 million rows of the result, which no task holds;
    # those of a seed lie together, so that files repeat its list and stay small
    per_seed = low.groupBy("seed").agg(F.count("*").alias("_n"))
    n_rows = near.groupBy("seed").agg(F.count("*").alias("_m")).join(per_seed, "seed").agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()[0]
    near = near.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // 20_000_000), "seed", "node")
    if low.limit(100_001).count() > 100_000:
        return near.hint("merge").join(low, "seed").select(F.col("who").alias("seed"), "node", "depth")
    lists = low.groupBy("seed").agg(F.collect_list("who").alias("who"))
    return near.join(F.broadcast(lists), "seed").select(F.explode("who").alias("seed"), "node", "depth")


@_query("select doc_id as node, min(doc_id) over (partition by text) as component from documents where text in (select text from documents group by text having count(*) > 1)")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n > 1 and h is not null")
    return graph.components(docs.join(first, "h").select("source", F.col("doc_id").alias("target")))


@_query(f"with {_EDGES} select left(target, 1) as kind, count(distinct target) as n_nodes, count(*) as n_edges from edges group by 1")
def graph_build(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).distinct()
    return edges.groupBy(F.substring("target", 1, 1).alias("kind")).agg(F.countDistinct("target").alias("n_nodes"), F.count("*").alias("n_edges"))


# ---- incremental, reports

@_query(
    """with i as (select doc_id, case when doc_id % 5 = 0 then 'x' else md5(text) end as h from documents where doc_id % 3 <> 0), c as (select doc_id, md5(text) as h, case when doc_id % 7 = 0 then 'INACTIVE' else 'ACTIVE' end as s from documents where doc_id % 2 = 0)
    select coalesce(i.doc_id, c.doc_id)::varchar as external_id, case when c.h is null then 'CREATED' when i.h is null then case when c.s = 'ACTIVE' then 'DEACTIVATED' else 'KEPT' end when i.h <> c.h then 'UPDATED' when c.s <> 'ACTIVE' then 'REACTIVATED' else 'SKIPPED' end as action
    from i full join c using (doc_id)"""
)
def incremental_actions(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("external_id"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    incoming = docs.where("doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("content_hash"))).withColumn("version_token", F.lit("1"))
    known = docs.where("doc_id % 2 = 0").select("external_id", "content_hash", F.when(F.col("doc_id") % 7 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"), F.lit("folder").alias("source_id"))
    return sync.actions(incoming, known).select("external_id", "action")


@_query(
    """with v as (select o_custkey, o_orderkey, md5(o_orderstatus) as h, lag(md5(o_orderstatus)) over (partition by o_custkey order by o_orderkey) as p from orders)
    select o_custkey, max(o_orderkey) as last_batch, arg_max(h, o_orderkey) as content_hash, count(*) filter (where p is not null and p <> h) as n_updates from v group by 1"""
)
def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.md5(F.col("o_orderstatus").cast("binary")).alias("h"))
    return sync.replayed(orders, ["o_custkey"], "o_orderkey", "h")


@_query(
    """select n_name, count(distinct year(o_orderdate)) as n_years, count(*) as n_orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"""
)
def release_history_nest(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    years = o.groupBy("n_name", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    nest = years.groupBy("n_name").agg(F.sort_array(F.collect_list(F.struct("year", "n"))).alias("years"))
    return nest.select("n_name", F.size("years").cast("long").alias("n_years"), F.aggregate("years", F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("n_orders"))


@_query("select o_orderkey, o_custkey, (select count(*) from orders) as total from orders order by o_orderkey limit 50 offset 100")
def paging(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    page = orders.select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(100).limit(50)
    return page.crossJoin(F.broadcast(orders.agg(F.count("*").alias("total"))))  # one row


@_query(
    """select 'orders' as sheet, o_orderstatus as status, count(*) as n from orders group by 2 union all select 'lines', l_returnflag, count(*) from lineitem group by 2 union all select 'events', event_type, count(*) from events group by 2"""
)
def report_sheets(spark: SparkSession, d: str) -> DataFrame:
    sheet = lambda name, table, c: _t(spark, d, table).groupBy(F.col(c).alias("status")).agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "status", "n")
    return sheet("orders", "orders", "o_orderstatus").unionByName(sheet("lines", "lineitem", "l_returnflag")).unionByName(sheet("events", "events", "event_type"))
