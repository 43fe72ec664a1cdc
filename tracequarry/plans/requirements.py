"""Queries from requirements to code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import graph
from tracequarry.operators import requirements as rq
from tracequarry.plans.registry import query, table

_L = lambda text: rf"list_distinct(regexp_extract_all(lower(regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+'))"


@query(
    f"""with v as (select distinct item_id % 7 as k, unnest({_L("text")}) as w from benchmark), d as (select distinct doc_id, unnest({_L("text")}) as w from documents),
    f as (select doc_id, list_sort(list(distinct 'I' || k)) as intents from d join v using (w) where length(w) >= 9 group by 1) select doc_id, coalesce(intents, ['CHANGE']) as intents from (select distinct doc_id from documents) left join f using (doc_id)"""
)
def intent_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.concat(F.lit("I"), F.col("item_id") % 7).alias("intent"), F.explode(rq.letters(F.col("text"), 9)).alias("word"))
    return rq.intents(table(spark, d, "documents").select("doc_id", "text"), words, "doc_id")


@query(
    f"""with r as (select item_id as requirement, {_L("text")} as ws, [['READ'], ['ADD', 'READ'], ['PERSIST', 'UPDATE'], ['REMOVE'], ['BUSINESS_RULE'], ['CHANGE']][item_id % 6 + 1] as i from benchmark),
    e as (select page_id as endpoint, ['GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD'][length(url) % 6 + 1] as verb, case when page_id % 2 = 0 then true else false end as u, {_L("html")} as ws from pages),
    m as (select requirement, endpoint, count(*) as n_subjects from (select requirement, unnest(ws) as w from r) join (select endpoint, unnest(ws) as w from e) using (w) where length(w) >= 7 group by all),
    s as (select m.*, verb, case verb when 'GET' then case when list_contains(i, 'READ') then 6 when list_contains(i, 'BUSINESS_RULE') then 1 else -2 end
      when 'POST' then case when list_has_any(i, ['ADD', 'PERSIST']) then 6 when list_contains(i, 'BUSINESS_RULE') then 2 else 0 end
      when 'DELETE' then case when list_contains(i, 'REMOVE') then 6 else -10 end when 'HEAD' then 0
      else case when list_contains(i, 'UPDATE') then 6 when list_has_any(i, ['ADD', 'PERSIST', 'BUSINESS_RULE']) then 3 when u then 1 else -1 end end as operation from m join r using (requirement) join e using (endpoint))
    select requirement, endpoint, n_subjects, operation, 3 + least(n_subjects, 3) + operation as score from s where verb <> 'DELETE' or operation = 6"""
)
def endpoint_candidates(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*(F.array(*map(F.lit, i.split())) for i in ("READ", "ADD READ", "PERSIST UPDATE", "REMOVE", "BUSINESS_RULE", "CHANGE")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("requirement"), rq.letters(F.col("text"), 7).alias("subjects"), F.get(wanted, F.col("item_id") % 6).alias("intents"))
    verbs = F.array(*map(F.lit, ("get", "POST", "PUT", "PATCH", "DELETE", "HEAD")))
    name = F.when(F.col("page_id") % 2 == 0, "updateOwner").otherwise("ownerOf")
    return rq.endpoint_candidates(asked, table(spark, d, "pages").select(F.col("page_id").alias("endpoint"), F.get(verbs, F.length("url") % 6).alias("verb"), name.alias("name"), rq.letters(F.col("html"), 7).alias("words")))


_BEHAVIOURS = {"validate": "validate erthe", "update": "update with", "run": "run from"}
_FIRST = r"coalesce(regexp_extract_all(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '(^|[^a-z])([a-z]{4,})', 2)[1], '')"  # lists of distinct items have no order in DuckDB
_NAME = f"['get', 'update', 'validate', 'run'][doc_id % 4 + 1] || upper(substr({_FIRST}, 1, 1)) || substr({_FIRST}, 2)"
_DID = lambda ws: "list_filter([" + ", ".join(f"case when list_has_any({ws}, {v.split()}) then '{k}' end" for k, v in _BEHAVIOURS.items()) + "], lambda x: x is not null)"
_CANDIDATES = f"""r as (select item_id as requirement, 'DOC-' || item_id as ticket, list_filter({_L("text")}, lambda x: length(x) >= 3) as ws from benchmark), n as (select doc_id as method, {_NAME} as name, source || 'Rows' as owner, coalesce(text, '') || ' (DOC-' || doc_id || ')' as body from documents),
    m as (select *, list_filter({_L("concat_ws(' ', owner, name)")}, lambda x: length(x) >= 3) as terms, list_filter({_L("name")}, lambda x: length(x) >= 3) as own from n),
    t as (select requirement, method, count(*) as n, bool_or(list_contains(own, w)) as o from (select requirement, unnest(ws) as w from r) join (select method, own, unnest(terms) as w from m) using (w) group by all),
    b as (select requirement, method, count(*) as n from (select requirement, unnest({_DID("ws")}) as k from r) join (select method, unnest({_DID("own")}) as k from m) using (k) group by all),
    i as (select distinct method, regexp_replace(lower(regexp_replace(w, '^(get|set|is)([A-Z])', '\\2')), '[^a-z0-9]', '', 'g') as k from (select method, unnest(regexp_extract_all(name || ' ' || body, '[A-Za-z_][A-Za-z0-9_]*')) as w from m)),
    a as (select requirement, method, count(*) as n from (select distinct requirement, unnest(ws) as k from r) join i using (k) where length(k) >= 10 group by all),
    x as (select distinct requirement, method from r join (select method, unnest(regexp_extract_all(upper(body), '[A-Z][A-Z0-9]*-[0-9]+')) as ticket from m) using (ticket)),
    u as (select requirement, method from t union select requirement, method from b union select requirement, method from a union select * from x),
    s as (select u.*, m.name, coalesce(t.n, 0) as n_terms, coalesce(b.n, 0) as n_behaviours, coalesce(a.n, 0) as n_attributes, x.method is not null as direct, coalesce(t.o, false) as o, regexp_matches(m.name, '^(get|set|is)[A-Z]') as p,
      regexp_matches(m.name, '^(delete|replace|update|remove)') and not list_has_any(r.ws, ['update', 'delete']) as odd from u join m using (method) join r using (requirement) left join t using (requirement, method) left join b using (requirement, method) left join a using (requirement, method) left join x using (requirement, method)),
    z as (select *, round(0.22::double * least(n_terms, 4) + 0.18::double * n_behaviours + case when n_attributes > 0 then 1.1::double else 0 end + case when direct then 0.35::double else 0 end - case when p then 0.65::double else 0 end - case when odd then 0.5::double else 0 end, 3) as raw from s),
    c as (select requirement, method, name, n_terms, n_behaviours, n_attributes, direct, greatest(raw, 0) as score, case when direct then 'REFERENCED' else 'CANDIDATE' end as classification, not (p or odd) and raw >= 0.55 as seed
      from z where direct or (not (p or odd) and (o or n_behaviours > 0 or n_attributes > 0) and raw >= 0.15))"""


def _requirements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("requirement"), F.concat(F.lit("doc-"), "item_id").alias("ticket"), "text")
    word = F.coalesce(F.get(rq.letters(F.col("text"), 4), F.lit(0)), F.lit(""))
    name = F.concat(F.get(F.array(*map(F.lit, ("get", "update", "validate", "run"))), F.col("doc_id") % 4), F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(" (DOC-"), "doc_id", F.lit(")"))
    methods = table(spark, d, "documents").select(F.col("doc_id").alias("method"), F.concat("source", F.lit("Rows")).alias("owner"), name.alias("name"), body.alias("body"))
    return asked, methods, asked.select("requirement", F.explode(rq.letters(F.col("text"), 10)).alias("attribute"))


@query(f"with {_CANDIDATES} select * from c")
def method_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rq.method_candidates(*_requirements(spark, d), behaviours=_BEHAVIOURS)


@query(
    f"""with {_CANDIDATES}, e as (select distinct method, callee from (select doc_id as method, unnest([doc_id + 1, doc_id * 2, doc_id - 7]) as callee from documents) where method <> callee and callee in (select doc_id from documents)), f as (select method, count(*) as n from e group by 1),
    h1 as (select distinct requirement, callee as method from c join e using (method) where seed), h2 as (select distinct requirement, callee as method from h1 join e using (method)),
    h as (select requirement, method, min(k) as k from (select requirement, method, 0 as k from c where seed union all select *, 1 from h1 union all select *, 2 from h2) group by all),
    w as (select requirement, method, score, 0 as call_depth, classification from c union all select requirement, method, round(0.35::double / k, 3), k, 'CANDIDATE' from h join n using (method) where k > 0 and not regexp_matches(name, '^(get|set|is)[A-Z]') and (requirement, method) not in (select (requirement, method) from c))
    select requirement, method, round(score + 0.12::double * least(coalesce(n, 0), 3), 3) as score, call_depth, classification, coalesce(n, 0) as n_calls from w left join f using (method)"""
)
def called_candidates(spark: SparkSession, d: str) -> DataFrame:
    asked, methods, attributes = _requirements(spark, d)
    calls = methods.select("method", F.explode(F.array(F.col("method") + 1, F.col("method") * 2, F.col("method") - 7)).alias("callee"))
    return rq.called_candidates(rq.method_candidates(asked, methods, attributes, _BEHAVIOURS), calls, methods)


@query(
    f"""with c as (select item_id, unnest(list_filter({_L("text")}, lambda x: length(x) >= 4)) as concept from benchmark), e as (select distinct doc_id as item_id, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') as concept, 1 as hit from (select doc_id, unnest(string_split_regex(text, '\\s+')) as w from documents))
    select item_id, concept, case when hit = 1 then 'CONFIRMED' else 'CANDIDATE_ONLY' end as status from c left join e using (item_id, concept)"""
)
def concept_confirmation(spark: SparkSession, d: str) -> DataFrame:
    concepts = table(spark, d, "benchmark").select("item_id", F.explode(rq.letters(F.col("text"), 4)).alias("concept"))
    entities = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.explode(F.split("text", r"[\t\n\f\r ]+")).alias("entity"))
    return rq.confirmed(concepts, entities, "item_id")


@query("select o_orderkey, o_custkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority = '1-URGENT'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return rq.narrowed(table(spark, d, "orders"), "o_orderstatus", ["F", "P"], "o_orderpriority", "1-URGENT").select("o_orderkey", "o_custkey")


@query("select lang, count(distinct lower(coalesce(case when n_chars % 3 > 0 then source end, 'D' || doc_id))) as n_files, count(*) as n_records from documents group by 1")
def counts_by_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("lang", F.when(F.col("n_chars") % 3 > 0, F.col("source")).alias("reference"), F.concat(F.lit("D"), "doc_id").alias("name"))
    return rq.counts_by_scope(rows, "lang", "reference", "name")


@query(
    """with e as (select distinct o_custkey, case o_orderstatus when 'F' then 'tests' when 'P' then 'mappings' else 'other' end as bucket, o_orderkey from orders), r as (select *, row_number() over (partition by o_custkey, bucket order by o_orderkey) as r from e)
    select o_custkey, bucket, count(*) as n_items, list(o_orderkey order by o_orderkey) filter (where r <= 3) as items from r group by all"""
)
def evidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rq.bucketed(table(spark, d, "orders"), "o_custkey", "o_orderstatus", {"F": "tests", "P": "mappings"}, "o_orderkey", first=3)


@query(
    """with c as (select l_suppkey as file, l_orderkey as line, lower('Qty' || l_returnflag) as lhs, case when l_tax > 0.04 then '>' else '<=' end as operator, l_quantity as number, l_linestatus as s from lineitem),
    r as (select *, row_number() over (partition by file, lhs, s order by line, operator, number) as i from c)
    select o.file, o.lhs, o.line as old_line, o.operator as old_operator, o.number as old_number, n.line as new_line, n.operator as new_operator, n.number as new_number from r o join r n using (file, lhs, i) where o.s = 'F' and n.s = 'O' and (o.operator <> n.operator or o.number <> n.number)"""
)
def paired_conditions(spark: SparkSession, d: str) -> DataFrame:
    operator = F.when(F.col("l_tax") > 0.04, ">").otherwise("<=")
    side = lambda s, lhs: table(spark, d, "lineitem").where(F.col("l_linestatus") == s).select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), F.concat(F.lit(lhs), "l_returnflag").alias("lhs"), operator.alias("operator"), F.col("l_quantity").alias("number"))
    return rq.paired_conditions(side("F", "Qty"), side("O", "qty"))


_PLACES = "select *, case when p_size % 3 = 0 then 'src/test/' else 'src/' end || p_brand as path, 'MAX_' || (p_size % 9) as constant from part"


@query(
    f"with p as ({_PLACES}) select distinct 'n' || regexp_replace(lower(l.p_name), '[^a-z]', '', 'g') as attribute, constant from p l where p_size % 3 > 0 and exists (select 1 from p c where c.p_type = 'PROMO' and c.path = l.path and c.constant = l.constant)"
)
def constant_attributes(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("p_size") % 3 == 0, "src/test/").otherwise("src/"), "p_brand").alias("path")
    constant = F.concat(F.lit("MAX_"), F.col("p_size") % 9)
    part = table(spark, d, "part")
    text = F.concat(F.lit("return "), constant, F.lit(" > row.getN"), F.regexp_replace(F.lower("p_name"), "[^a-z]", ""), F.lit("()"))
    return rq.constant_attributes(part.where("p_type = 'PROMO'").select(path, constant.alias("constant")), part.select(path, text.alias("text")))


@query(
    """with a as (select distinct upper(split_part(p_name, ' ', 1)) as attribute from part where p_size = 10), b as (select p_brand as class_name, p_type as method, case when p_size > 25 then 'IF' else 'ELSE' end as type, 'size > ' || p_size as condition, unnest(string_split(p_name, ' ')) as w from part)
    select distinct attribute, class_name, method, type, condition from b join a on regexp_replace(lower(w), '[^a-z0-9]', '', 'g') = regexp_replace(lower(attribute), '[^a-z0-9]', '', 'g')"""
)
def branch_evidence(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    kind = F.when(F.col("p_size") > 25, "IF").otherwise("ELSE").alias("type")
    branches = part.select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("method"), kind, F.concat(F.lit("size > "), "p_size").alias("condition"), F.split("p_name", " ").alias("attributes"))
    return rq.branch_evidence(branches, part.where("p_size = 10").select(F.upper(F.split("p_name", " ")[0]).alias("attribute")))


@query(
    """with e as (select distinct 'P' || l_partkey as source, 'S' || l_suppkey as target, l_returnflag as type from lineitem where l_quantity > 45), s as (select 'P' || p_partkey as id from part where p_size = 50 union select 'S' || s_suppkey from supplier where s_acctbal < 0),
    n as (select * from e where type in ('A', 'R') and (source in (select id from s) or target in (select id from s))), p as (select distinct 'N' || s_nationkey as p from supplier where 'S' || s_suppkey in (select target from n))
    select * from n union select 'N' || a.n_nationkey, 'N' || b.n_nationkey, 'DEPENDS_ON' from nation a join nation b on b.n_regionkey = a.n_regionkey and b.n_nationkey > a.n_nationkey where 'N' || a.n_nationkey in (select p from p) and 'N' || b.n_nationkey in (select p from p)"""
)
def focused_subgraph(spark: SparkSession, d: str) -> DataFrame:
    name = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    uses = table(spark, d, "lineitem").where("l_quantity > 45").select(name("P", "l_partkey").alias("source"), name("S", "l_suppkey").alias("target"), F.col("l_returnflag").alias("type"))
    near = nation.select(F.col("n_nationkey").alias("k"), "n_regionkey").join(nation, "n_regionkey").where("n_nationkey > k").select(name("N", "k").alias("source"), name("N", "n_nationkey").alias("target"), F.lit("DEPENDS_ON").alias("type"))
    seeds = table(spark, d, "part").where("p_size = 50").select(name("P", "p_partkey").alias("id")).unionByName(supplier.where("s_acctbal < 0").select(name("S", "s_suppkey").alias("id")))
    nodes = supplier.select(name("S", "s_suppkey").alias("id"), name("N", "s_nationkey").alias("project"))
    return graph.focused(nodes, uses.unionByName(near), seeds, ["A", "R"])


@query(
    """with recursive n as (select p_partkey as id, case when p_partkey >= 40 then p_partkey // 2 end as parent, p_size as pos, p_brand as symbol from part where p_size > 5), c as (select distinct p_brand as symbol from part where p_size > 40 and p_type = 'PROMO' and p_name < 'g'),
    w as (select id as flow, id, symbol, [symbol] as path, [pos] as places from n where parent is null union all select flow, n.id, n.symbol, list_append(path, n.symbol), list_append(places, pos) from w join n on n.parent = w.id where not list_contains(path, n.symbol)),
    k as (select flow, symbol, path, min(places) as places from w where symbol in (select symbol from c) group by all)
    select flow, symbol, array_to_string(path, '>') as path, rank from (select *, row_number() over (partition by flow order by places, path)::int as rank from k) where rank <= 8"""
)
def dependency_paths(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    parent = F.when(F.col("p_partkey") >= 40, F.floor(F.col("p_partkey") / 2))
    calls = part.select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.col("p_size").alias("pos"), F.col("p_brand").alias("symbol"), (F.col("p_size") > 5).alias("verified"))
    changes = part.where("p_size > 40 and p_type = 'PROMO' and p_name < 'g'").select(F.col("p_brand").alias("symbol"))
    return graph.dependency_paths(calls, changes).withColumn("path", F.array_join("path", ">"))


@query(
    """select distinct l_orderkey::varchar as source, l_partkey::varchar as target, case l_returnflag when 'R' then 'REFERENCES_JIRA' when 'A' then 'COVERS_JIRA' else 'POSSIBLY_COVERS_JIRA' end as type, l_linestatus as evidence, case l_returnflag when 'N' then 'INFERRED' else 'VERIFIED' end as classification from lineitem
    union select distinct p_partkey::varchar, p_name, 'MAPS_TO_ATTRIBUTE', 'EXACT_ATTRIBUTE_MATCH', 'VERIFIED' from part"""
)
def evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    links = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linestatus").alias("evidence"))
    maps = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_name").alias("target"), F.lit("EXACT_ATTRIBUTE_MATCH").alias("evidence"))
    return graph.evidence_edges(links("R"), links("A"), links("N"), maps)
