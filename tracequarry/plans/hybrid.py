"""Queries of hybrid searches with all their parts, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import text as tx
from tracequarry.operators import hybrid, knowledge
from tracequarry.plans import catalogue
from tracequarry.plans.knowledge import _CHANGE, _DOMAINS, _GENERIC, _HISTORY, _RELEASE
from tracequarry.plans.registry import query, table
from tracequarry.store import spread


@query(
    catalogue._BM25 + "," + catalogue._EVERY + r""", dense as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from near qualify rank <= 80),
    lexical as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bm25),
    q as (select item_id as query_id, lower(text) as q, text as raw from benchmark where text <> ''), t as (select doc_id, lower(text) as t from documents where text <> ''),
    needles as (select query_id, unnest(list_filter(list_distinct(regexp_extract_all(q, '[a-z0-9_./:-]+')), lambda x: length(x) > 2)) as needle, 0.003 as w from q
      union all select query_id, lower(unnest(list_distinct(regexp_extract_all(raw, '[A-Za-z][A-Za-z0-9_]*-[0-9]+|[A-Za-z_][A-Za-z0-9_]*')))), 0.012 from q),
    words as (select distinct doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+')) as needle from t),
    runs as (select distinct doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_./:-]+')) as run from t),
    odd as (select distinct needle from needles where regexp_matches(needle, '[./:-]')),
    held as (select run, needle from (select distinct run from runs), odd where contains(run, needle)),
    alone as (select run, needle from held where regexp_matches(run, '(^|[^\p{L}\p{N}_])' || replace(needle, '.', '\.') || '($|[^\p{L}\p{N}_])')),
    hits as (select doc_id, needle from words where needle in (select needle from needles) union select doc_id, needle from runs join alone using (run)),
    parts as (select query_id, doc_id, sum(w)::double as b from needles join hits using (needle) group by all union all select query_id, doc_id, 0.03 from q, t where contains(t, q)),
    boosted as (select query_id, doc_id, least(sum(b), 0.09) as b from parts group by all),
    fused as (select query_id, doc_id, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) + coalesce(b, 0), 9) as score from dense d full join lexical l using (query_id, doc_id) full join boosted using (query_id, doc_id))
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from fused where score > 0) where rank <= 10"""
)
def hybrid_rrf_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Dense ranks within the budget of ten results, all lexical ranks, and boosts of every document."""
    found = hybrid.fused_search(*catalogue._texts(spark, d), catalogue._dense(spark, d, hybrid.dense_budget(10)), k=10)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_ASKS = ("reer", "erst")


@query(
    catalogue._BM25 + "," + catalogue._EVERY + rf""", q as (select item_id as query_id, lower(text) as q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as ts, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as c from benchmark where text <> ''),
    t as (select doc_id, lower(text) as t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w, ['test_baseline', 'release', 'scenario'][doc_id % 3 + 1] as kind, regexp_replace(regexp_extract(lower(text), '([a-z]{{6,}})', 1), '[^a-z]', '', 'g') as name, n_chars % 4 > 0 as released from documents where text <> ''),
    e as (select query_id, doc_id, case when contains(t, q) then 80 else 0 end + coalesce(list_sum(list_transform(ts, lambda x: least(12.0 * (length(t) - length(replace(t, x, ''))) / length(x), 48.0))), 0) as exact from q, t),
    s as (select query_id, doc_id, coalesce(exact, 0) as x, coalesce(bm25.score, 0) as b, greatest(coalesce(near.score, 0), 0) as v from e full join bm25 using (query_id, doc_id) left join near using (query_id, doc_id) where coalesce(exact, 0) > 0 or bm25.score > 0),
    n as (select query_id, doc_id, kind, name, w as dw, released, coalesce(x / nullif(max(x) over o, 0), 0) as x, coalesce(b / nullif(max(b) over o, 0), 0) as b, v from s join t using (doc_id) window o as (partition by query_id)),
    m as (select *, round(0.45 * x + 0.30 * b + 0.25 * v + case when kind = 'test_baseline' and (x > 0 or b > 0) then 0.06 else 0 end, 7) as score from n),
    near_ as (select *, max(score) over (partition by query_id) as best from m qualify score >= greatest(0.30, round(0.58 * best, 7))),
    child as (select near_.*, q.w as qw, q.c, kind = 'test_baseline' and name <> '' and contains(q.c, name) as is_child from near_ join q using (query_id)),
    scoped as (select * from (select *, count(*) filter (is_child) over (partition by query_id) as n_child from child) where is_child or n_child = 0),
    a as (select *, len(list_intersect(qw, {list(_HISTORY)})) > 0 as h, list_intersect(qw, {list(_DOMAINS)}) as dom, list_filter(qw, lambda z: length(z) > 6 and not list_contains({list(_GENERIC)}, z)) as sub from scoped),
    g as (select * from a where not (h or list_contains(qw, 'whou')) or ((len(dom) = 0 or len(list_intersect(dom, dw)) > 0) and (len(sub) = 0 or len(list_intersect(sub, dw)) > 0) and (not list_contains(qw, 'hein') or released))),
    f as (select * from (select *, count(*) filter (kind = 'release') over (partition by query_id) as n_release from g) where len(list_intersect(qw, {list(_ASKS)})) = 0 or kind = 'release' or n_release = 0)
    select query_id, doc_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from f) where rank <= 10"""
)
def hybrid_linear_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Exact, lexical and vector parts of all documents, the scope of a named baseline, the filter on what may be quoted and releases as a whole."""
    documents = table(spark, d, "documents").where("text <> ''")
    items = table(spark, d, "benchmark").where("text <> ''").select(F.col("item_id").alias("query_id"), "text")
    kind = F.get(F.array(*map(F.lit, ("test_baseline", "release", "scenario"))), F.col("doc_id") % 3)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    directions = vectors.join(items.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    texts, questions = catalogue._texts(spark, d)
    scores = hybrid.linear_scores(texts.select("doc_id", "text", kind.alias("kind")), questions, vectors, directions)
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    known = documents.select("doc_id", kind.alias("kind"), F.regexp_extract(F.lower("text"), "([a-z]{6,})", 1).alias("baseline"))
    terms = documents.select("doc_id", tokens("text").alias("tokens"), F.when(F.col("n_chars") % 4 > 0, "R1").alias("release"), F.lit(1).alias("n_tests"))
    asked = items.withColumn("tokens", tokens("text"))
    required = knowledge.constraints(asked.withColumns({"subjects": F.filter("tokens", lambda x: F.length(x) > 6), "intents": F.lit(None).cast("array<string>")}), _HISTORY, _CHANGE, _RELEASE, _DOMAINS, _GENERIC)
    found = hybrid.linear_search(scores, known, asked, lambda rows: knowledge.grounded(rows, required, terms), release=_ASKS, digits=7)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    """with w as (select distinct doc_id as ticket, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as term from documents where doc_id % 9 > 0),
    c as (select distinct item_id as change, unnest(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as term from benchmark),
    k as (select *, case when length(term) >= 9 then 'ATTRIBUTE' when length(term) >= 7 then 'CODE' when length(term) >= 5 then 'SCENARIO' else 'TEST' end as kind from c union all select *, 'CODE' from c where length(term) in (9, 10)),
    h as (select change, ticket, count(distinct term) filter (kind = 'ATTRIBUTE') as n_attributes, count(distinct term) filter (kind = 'CODE' and length(term) < 9) as n_code, count(distinct term) filter (kind = 'SCENARIO') as n_scenario, count(distinct term) filter (kind = 'TEST') as n_test, count(distinct term) filter (kind <> 'ATTRIBUTE') as n_overlap from k join w using (term) group by all),
    s as (select doc_id as ticket, unnest([source || '>' || (n_chars % 9), source]) as rule from documents where doc_id % 9 > 0),
    r as (select item_id as change, 'src' || (item_id % 10) || '>' || (item_id % 9) as new, 'src' || ((item_id + 3) % 10) as old from benchmark),
    m as (select change, ticket, bool_or(rule = new) as n, bool_or(rule = old) as o from r join s on rule = new or rule = old group by all),
    j as (select change, ticket, coalesce(n_attributes, 0) as n_attributes, coalesce(n_code, 0) as n_code, coalesce(n_scenario, 0) as n_scenario, coalesce(n_test, 0) as n_test, case when n then 1 else 0 end as n_new_rules, coalesce(o and not n, false) as old_only, coalesce(n_overlap, 0) as n_overlap from h full join m using (change, ticket)),
    p as (select *, greatest(0, least(100, case when n_attributes > 0 then least(20, 12 + 4 * n_attributes) else 0 end + least(12, 2 * n_code) + case when n_scenario > 0 then least(15, 5 + 2 * n_scenario) else 0 end + case when n_test > 0 then least(15, 5 + 2 * n_test) else 0 end + 38 * n_new_rules - case when old_only then 25 else 0 end + least(10, n_overlap)))::int as score from j)
    select change, ticket, n_attributes, n_code, n_scenario, n_test, n_new_rules::bigint as n_new_rules, old_only, n_overlap, score, case when score >= 70 then 'HIGH' when score >= 45 then 'MEDIUM' else 'LOW' end as band, rank
    from (select *, row_number() over (partition by change order by score desc, ticket)::int as rank from p where score >= 25)"""
)
def correlation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All words of questions as terms of changes, by length of a kind, against all words of all documents."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("change"), F.explode(F.array_distinct(tx.search_tokens(F.col("text")))).alias("term"))
    length = F.length("term")
    kinds = F.when(length >= 9, F.when(length <= 10, F.array(F.lit("ATTRIBUTE"), F.lit("CODE"))).otherwise(F.array(F.lit("ATTRIBUTE")))).when(length >= 7, F.array(F.lit("CODE"))).when(length >= 5, F.array(F.lit("SCENARIO"))).otherwise(F.array(F.lit("TEST")))
    changes = words.select("change", F.explode(kinds).alias("kind"), F.col("term").alias("name"), "term")
    item = F.col("item_id")
    rules = table(spark, d, "benchmark").select(item.alias("change"), F.lit(1).alias("rule"), F.concat(F.lit("src"), (item + 3) % 10).alias("old"), F.concat(F.lit("src"), item % 10, F.lit(">"), item % 9).alias("new"), F.lit(True).alias("differs"))
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id", each=1 << 22)
    tickets = documents.select(F.col("doc_id").alias("ticket"), F.array_distinct(tx.search_tokens(F.col("text"))).alias("terms"), F.array(F.concat("source", F.lit(">"), F.col("n_chars") % 9), F.col("source")).alias("rules"))
    return hybrid.correlated(changes, rules, tickets, table(spark, d, "documents").where("doc_id % 9 = 0").select(F.col("doc_id").alias("ticket")), first=None)
