"""Queries that review changes, requirements and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import reviews as rv
from tracequarry.plans.registry import query, table

_L = lambda text: rf"list_filter(list_distinct(regexp_extract_all(lower(regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z]+')), lambda x: length(x) >= 3)"


@query(
    """with recursive s as (select o_orderkey as scenario, ['GET', 'POST'][o_custkey % 2 + 1] as v, '/api/c/' || o_custkey as k from orders),
    e as (select ['GET', 'POST'][c_custkey % 2 + 1] as v, case c_custkey % 3 when 0 then '/api/c/' || c_custkey when 1 then '/c/' || c_custkey else '/v1/api/c/' || c_custkey end as k, c_custkey as method from customer where c_custkey % 5 > 0),
    x as (select scenario, method from s join e using (v, k)), r as (select * from s where scenario not in (select scenario from x)),
    y as (select scenario, method, count(*) over (partition by scenario) as n from r join e on r.v = e.v and split_part(r.k, '/', 4) = regexp_extract(e.k, '[0-9]+$') and (ends_with(r.k, e.k) or ends_with(e.k, r.k))),
    st as (select * from x union select scenario, method from y where n = 1),
    g as (select c_custkey as a, unnest([c_custkey * 2, c_custkey + 7]) as b from customer), c as (select c_custkey as method from customer where c_custkey % 31 = 0),
    t(seed, node, depth) as (select method, method, 0 from c union select seed, a, depth + 1 from t join g on g.b = t.node where depth < 6),
    m as (select scenario, count(distinct seed) as n_methods from st join t on st.method = t.node group by 1),
    k as (select o_orderkey as scenario, count(*) as n_classes from orders where 'cls' || (o_orderkey % 90) in (select 'cls' || (method % 40) from c) group by 1)
    select scenario, case when m.n_methods > 0 then 'ENDPOINT_CALL_PATH' else 'DECLARED_CLASS_OVERLAP' end as evidence, coalesce(n_methods, 0) as n_methods, coalesce(n_classes, 0) as n_classes from m full join k using (scenario)"""
)
def scenario_candidates(spark: SparkSession, d: str) -> DataFrame:
    verb = lambda k: F.get(F.array(F.lit("get"), F.lit("POST")), F.col(k) % 2).alias("verb")
    classes = F.array(F.concat(F.lit("app.model.Cls"), F.col("o_orderkey") % 90), F.lit("Other")).alias("classes")
    scenarios = table(spark, d, "orders").select(F.col("o_orderkey").alias("scenario"), verb("o_custkey"), F.concat(F.lit("http://host/api//c/"), "o_custkey", F.lit("/?a=1")).alias("path"), classes)
    customer = table(spark, d, "customer")
    path = F.concat(F.get(F.array(*map(F.lit, ("/api/c/", "/c/", "/v1/api/c/"))), F.col("c_custkey") % 3), "c_custkey").alias("path")
    entries = customer.where("c_custkey % 5 > 0").select(verb("c_custkey"), path, F.col("c_custkey").alias("method"))
    calls = customer.select(F.col("c_custkey").alias("source"), F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") + 7)).alias("target"))
    return rv.scenario_candidates(scenarios, entries, calls, customer.where("c_custkey % 31 = 0").select(F.col("c_custkey").alias("method"), F.concat(F.lit("CLS"), F.col("c_custkey") % 40).alias("owner")))


_ROUTES = {"primaryEmail": {"primary-email", "email"}, "countryCode": {"country-code", "country"}, "lastName": {"last-name"}}
_SEGMENTS = ["email", "country", "last-name", "{id}", "status"]


@query(
    f"""with e as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'PUT' else 'patch' end as v, {_SEGMENTS}[l_partkey % 5 + 1] as s, ['primaryEmail', 'countryCode', 'unknown'][l_suppkey % 3 + 1] as a from lineitem)
    select v as verb, s as segment, a as attribute, count(*) as n, bool_or(v = 'patch' and s in ('email', 'country', 'last-name') and not (a = 'primaryEmail' and s = 'email') and not (a = 'countryCode' and s = 'country')) as conflict from e group by all"""
)
def route_vetoes(spark: SparkSession, d: str) -> DataFrame:
    segment, attribute = F.get(F.array(*map(F.lit, _SEGMENTS)), F.col("l_partkey") % 5), F.get(F.array(*map(F.lit, ("primaryEmail", "countryCode", "unknown"))), F.col("l_suppkey") % 3)
    verb = F.when(F.col("l_returnflag") == "R", "PUT").otherwise("patch")
    rows = table(spark, d, "lineitem").select(verb.alias("verb"), segment.alias("segment"), attribute.alias("attribute"))
    conflict = rv.route_conflict(F.concat("verb", F.lit(" /Customers/7/"), F.initcap("segment"), F.lit("/?x=1")), F.col("attribute"), _ROUTES)
    return rows.withColumn("conflict", conflict).groupBy("verb", "segment", "attribute").agg(F.count("*").alias("n"), F.bool_or("conflict").alias("conflict"))


@query(
    """with t as (select l_orderkey as pair, case when l_returnflag = 'R' and l_tax > 0.04 then 'FAIL' when l_returnflag = 'A' and l_tax > 0.06 then 'NOT_RUN' when l_linenumber = 7 then 'X' else 'PASS' end as s from lineitem),
    c as (select pair, count(*) filter (s = 'PASS') as n_pass, count(*) filter (s = 'FAIL') as n_fail, count(*) filter (s = 'NOT_RUN') as n_not_run, count(*) filter (s = 'X') as n_unknown from t group by 1),
    p as (select o_orderkey as pair, o_custkey % 3 as m, o_orderpriority = '1-URGENT' as e, o_orderstatus = 'F' as b, o_totalprice > 400000 as w, o_custkey % 11 > 0 as complete, coalesce(n_pass, 0) as n_pass, coalesce(n_fail, 0) as n_fail, coalesce(n_not_run, 0) as n_not_run, coalesce(n_unknown, 0) as n_unknown from orders left join c on pair = o_orderkey),
    q as (select *, n_not_run + n_unknown > 0 or n_pass + n_fail = 0 as u from p),
    r as (select *, least(100, case when m > 0 then 20 else 0 end + case when e then 25 else 0 end + case when b then 20 else 0 end + case when w then 15 else 0 end + case when n_fail > 0 then 40 else 0 end + case when u then 20 else 0 end) as points from q)
    select pair, n_pass, n_fail, n_not_run, n_unknown, points, concat_ws(',', case when m > 0 then 'DEPENDENCY_FILES' end, case when e then 'ENDPOINT' end, case when b then 'DATABASE' end, case when w then 'MEMBERS' end, case when n_fail > 0 then 'FAILED_TESTS' end, case when u then 'NO_RESULTS' end) as reasons,
      case when not complete then 'UNKNOWN' when points >= 60 then 'HIGH' when points >= 25 then 'MEDIUM' else 'LOW' end as level from r"""
)
def pair_review(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.expr("l_returnflag = 'R' and l_tax > 0.04"), "fail").when(F.expr("l_returnflag = 'A' and l_tax > 0.06"), "NOT_RUN").when(F.expr("l_linenumber = 7"), F.lit(None)).otherwise("PASS")
    tests = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), status.alias("status"))
    flags = ["o_orderkey as pair", "o_custkey % 3 as n_matches", "o_orderpriority = '1-URGENT' as endpoint_changed", "o_orderstatus = 'F' as db_changed", "o_totalprice > 400000 as members_changed", "o_custkey % 11 > 0 as complete"]
    out = rv.pair_review(table(spark, d, "orders").selectExpr(*flags), tests)
    return out.select("pair", "n_pass", "n_fail", "n_not_run", "n_unknown", "points", F.array_join("reasons", ",").alias("reasons"), "level")


@query(
    """with n as (select l_suppkey as change, l_partkey as ticket, count(distinct l_returnflag) as n_matches from lineitem group by all)
    select *, row_number() over (partition by change order by n_matches desc, ticket) as rank from n"""
)
def relevance_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("change"), F.col("l_partkey").alias("ticket")).agg(F.countDistinct("l_returnflag").alias("n_matches"))
    return rv.by_relevance(rows)


@query(
    """with n as (select l_suppkey as change, 'S' || (l_partkey % 97) as symbol, count(distinct l_orderkey % 50) as n_scenarios, count(distinct l_linenumber) as n_endpoints from lineitem group by all)
    select *, row_number() over (partition by change order by n_scenarios desc, n_endpoints desc, symbol) as rank from n"""
)
def reach_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("change"), F.concat(F.lit("S"), F.col("l_partkey") % 97).alias("symbol"), (F.col("l_orderkey") % 50).alias("scenario"), F.col("l_linenumber").alias("endpoint"))
    return rv.by_reach(rows)


@query(
    """with f as (select field, count(distinct file) as n_files from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as field, case when item_id % 4 > 0 then item_id end as file from benchmark) where length(field) in (3, 4, 9) group by 1),
    w as (select distinct doc_id as requirement, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as field from documents), m as (select * from w join f using (field)),
    d as (select requirement from m where field in ('and', 'that') group by 1 having count(*) = 2), e as (select requirement from m where field in ('the', 'with') group by 1 having count(*) = 2)
    select requirement, field, 'EXISTING_FIELD_IMPACT' as kind, n_files from m where n_files > 0
    union all select requirement, field, 'PROPOSED_DERIVED_ATTRIBUTE', coalesce(n_files, 0) from w left join f using (field) where (field = 'of' and requirement in (from d)) or (field = 'for' and requirement in (from e))"""
)
def what_if(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where(F.length("w").isin(3, 4, 9))
    fields = words.select(F.initcap("w").alias("field"), F.when(F.col("item_id") % 4 > 0, F.col("item_id")).alias("file"))
    return rv.what_if(table(spark, d, "documents").select(F.col("doc_id").alias("requirement"), "text"), fields, {"Of": ["and", "That"], "For": ["the", "with"]})


_FIRST, _LAST = "regexp_extract(lower(text), '([a-z]{4,})', 1)", "regexp_extract(lower(text), '([a-z]{4,})[^a-z]*$', 1)"
_CAP = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"


@query(
    f"""with a as (select item_id as requirement, unnest({_L("text")}) as w from benchmark union select item_id, unnest({_L(_LAST)}) from benchmark),
    f as (select doc_id as path, {_CAP(_FIRST)} as c, 'update' || {_CAP(_FIRST)} as m1, 'hash' || {_CAP(_LAST)} as m2, coalesce(text, '') as content from documents),
    l as (select path, 'c' as part, '' as item, unnest({_L("c")}) as w from f union select path, 's', '', unnest({_L("content")}) from f
      union select path, 'm', m1, unnest({_L("m1")}) from f union select path, 'm', m2, unnest({_L("m2")}) from f),
    n as (select requirement, path, count(distinct w) filter (part = 'c') as n_class, count(distinct w) filter (part = 's') as n_source, count(distinct item) filter (part = 'm') as n_methods from a join l using (w) group by all),
    h as (select doc_id % (select count(*) from benchmark) as requirement, doc_id as path, 1 + (doc_id % 3 = 0)::int as n_hits from documents where doc_id % 2 = 0),
    k as (select distinct item_id as requirement, path from (select item_id, {_LAST} as w from benchmark) join f on lower(c) = w where w <> ''),
    u as (select requirement, path from n union select requirement, path from h union select * from k),
    z as (select requirement, path, coalesce(n_class, 0) as n_class, coalesce(n_source, 0) as n_source, coalesce(n_methods, 0) as n_methods, coalesce(n_hits, 0) as n_hits, (requirement, path) in (select (requirement, path) from k) as concept from u left join n using (requirement, path) left join h using (requirement, path))
    select *, case when n_class > 0 then 6 + n_class else 0 end + least(n_source, 6) + least(2 * n_methods, 4) + case when n_hits > 0 then least(3 + n_hits, 8) else 0 end + case when concept then 4 else 0 end as score from z"""
)
def file_scores(spark: SparkSession, d: str) -> DataFrame:
    asked, documents = table(spark, d, "benchmark").withColumnRenamed("item_id", "requirement"), table(spark, d, "documents").withColumnRenamed("doc_id", "path")
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    first, last = F.expr(_FIRST), F.expr(_LAST)
    files = documents.select("path", cap(first).alias("class_name"), F.array(F.concat(F.lit("update"), cap(first)), F.concat(F.lit("hash"), cap(last))).alias("methods"), F.col("text").alias("content"))
    hits = documents.join(asked.agg(F.count("*").alias("n")).hint("broadcast")).where("path % 2 = 0")  # one row
    hits = hits.select((F.col("path") % F.col("n")).alias("requirement"), "path", F.explode(F.when(F.col("path") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rv.file_scores(asked.select("requirement", "text"), asked.select("requirement", last.alias("concept")), files, hits)


_ABSENT = ["Which release tested lunar tides?", "Where was the tea round changed?"]


@query(
    f"""with t as (select o_custkey as scenario, case when o_orderkey % 2 = 0 then 'Check ' else 'check ' end || (o_custkey % 40) as test, unnest(['ORD-' || (o_orderkey % 500), upper(o_orderpriority)]) as ticket from orders),
    m as (select lower(test) as k, ticket, min({{'scenario': scenario, 'test': test}}) as m from t group by all)
    select 'POSITIVE' as case_type, 'Which ticket is linked to ' || m.test || '?' as query, ticket, m.test as test, m.scenario as scenario from m union all select 'NEGATIVE', unnest({_ABSENT}), null, null, null"""
)
def evaluation_cases(spark: SparkSession, d: str) -> DataFrame:
    test = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Check ").otherwise("check "), F.col("o_custkey") % 40, F.lit(" "))
    tickets = F.array(F.concat(F.lit("ord-"), F.col("o_orderkey") % 500), F.col("o_orderpriority"), F.lit(" "))
    return rv.evaluation_cases(table(spark, d, "orders").select(F.col("o_custkey").alias("scenario"), test.alias("test"), tickets.alias("tickets")), "Which ticket is linked to %s?", _ABSENT)


@query(
    """with c as (select c_custkey as k, c_nationkey, c_custkey % 3 > 0 as p from customer), r as (select o_custkey as k, o_orderstatus = 'F' as g, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders where o_custkey % 12 > 0 or o_orderkey % 5 = 0),
    f as (select k, count(*) as n, count(*) filter (g) as good, min(rank) filter (g) as first from r where rank <= 8 group by 1), o as (select c.*, coalesce(n, 0) as n, coalesce(good, 0) as good, first from c left join f using (k)),
    v as (select *, (case when p then case when n > 0 then round(10000 * good / n) else 0 end else case when n = 0 then 10000 else 0 end end)::bigint as a, (case when p then case when good > 0 then 10000 else 0 end end)::bigint as b, (case when p then coalesce(round(10000 / first), 0) end)::bigint as m from o)
    select c_nationkey, count(*) as n_cases, count(*) filter (case when p then good > 0 else n = 0 end) as n_passed, floor((2 * sum(a) + count(a)) / (2 * count(a))) / 10000 as precision,
      coalesce(floor((2 * sum(b) + count(b)) / (2 * count(b))) / 10000, 0) as recall, coalesce(floor((2 * sum(m) + count(m)) / (2 * count(m))) / 10000, 0) as mrr, sum(case when p then n - good else n end)::bigint as n_noise from v group by 1"""
)
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case"), "c_nationkey", F.when(F.col("c_custkey") % 3 > 0, "POSITIVE").otherwise("NEGATIVE").alias("case_type"))
    kept = table(spark, d, "orders").where("o_custkey % 12 > 0 or o_orderkey % 5 = 0")
    ranked = kept.selectExpr("o_custkey as case", "o_orderstatus = 'F' as relevant", "row_number() over (partition by o_custkey order by o_orderkey) as rank")
    return rv.evaluation_summary(cases, ranked, ["c_nationkey"])


@query(
    """with p as (select p_partkey as document, p_size % 4 as z, case when p_partkey % 3 > 0 then p_name || '_v' || (p_size % 4) || '.xlsx' else p_name || '.xlsx' end as f, case when p_partkey % 3 > 0 then 'V' || (p_size % 4) end as v, upper(p_name) as i,
      case p_partkey % 6 when 0 then null when 1 then 'OTHER' else upper(p_name) end as family, case when p_partkey % 2 = 0 then 'V2' else 'V1' end as version, case when p_partkey % 10 = 9 then 'ARCHIVED' else 'ACTIVE' end as status, p_size % 3 as n_rows, p_partkey % 4 as s from part where p_partkey % 7 > 0),
    q as (select *, case when status = 'ACTIVE' then max((case when n_rows > 0 then 1 else 0 end)::bigint * 1000000000 + document) over (partition by f, z, status) end as best from p)
    select document, 'C:\\Work\\Maps' as project, case when v is not null or family is null then i else family end as family, coalesce(v, version) as version, case when status = 'ACTIVE' and best % 1000000000 <> document then 'DUPLICATE' else status end as status,
      case when v is not null then family is distinct from i or version <> v else family is null end as metadata_fixed, s <> 0 as project_fixed from q"""
)
def document_reconcile(spark: SparkSession, d: str) -> DataFrame:
    where = F.when(F.col("p_partkey") % 7 == 0, r"C:\Work\Others").otherwise(F.get(F.array(*map(F.lit, ("C:\\Work\\Maps", "c:/work/maps/", "C:/Work/Maps", "C:\\WORK\\MAPS\\"))), F.col("p_partkey") % 4))
    name = F.when(F.col("p_partkey") % 3 > 0, F.concat("p_name", F.lit("_v"), F.col("p_size") % 4, F.lit(".xlsx"))).otherwise(F.concat("p_name", F.lit(".xlsx")))
    family = F.when(F.col("p_partkey") % 6 == 1, "OTHER").when(F.col("p_partkey") % 6 > 1, F.upper("p_name"))
    documents = table(spark, d, "part").select(
        F.col("p_partkey").alias("document"), where.alias("project"), name.alias("filename"), family.alias("family"), F.when(F.col("p_partkey") % 2 == 0, "V2").otherwise("V1").alias("version"),
        F.when(F.col("p_partkey") % 10 == 9, "ARCHIVED").otherwise("ACTIVE").alias("status"), F.when(F.col("p_partkey") % 2 == 0, "").alias("source_ref"), (F.col("p_size") % 4).alias("checksum"), (F.col("p_size") % 3).alias("n_rows"),
    )
    return rv.reconciled(documents, "C:/Work/Maps/")


@query(
    """with l as (select l_orderkey as k, 'S' || (l_suppkey % 5) || '.' || lower(l_returnflag) || 'Run' as m, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate) as r from lineitem where l_tax > 0.01),
    o as (select o_orderkey as k, 'Order.' || lower(o_orderstatus) || 'Start' as m, 0 as r from orders union all select * from l), d as (select k, m, min(r) as r from o group by all) select k as flow, string_agg(m, ' ' order by r) as methods from d group by 1"""
)
def flow_methods(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_tax > 0.01").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate").alias("l"))
    flows = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    # the first three calls hang one below the other, the rest beside the first
    node = lambda l: F.struct(F.concat(F.lit("S"), l["l_suppkey"] % 5).alias("class_name"), F.concat(F.lower(l["l_returnflag"]), F.lit("Run")).alias("method_name"))
    calls = F.transform("ls", node)
    at = lambda i: F.get(calls, F.lit(i))
    below = F.array_compact(F.array(F.when(at(2).isNotNull(), at(2))))
    second = F.when(at(1).isNotNull(), F.struct(at(1)["class_name"].alias("class_name"), at(1)["method_name"].alias("method_name"), below.alias("calls")))
    top = F.struct(at(0)["class_name"].alias("class_name"), at(0)["method_name"].alias("method_name"), F.array_compact(F.array(second)).alias("calls"))
    rest = F.when(F.size(calls) > 3, F.to_json(F.slice(calls, 4, 1 << 20)))
    head = F.concat(F.lit('{"flow":{"class_name":"Order","method_name":"'), F.lower("o_orderstatus"), F.lit('Start","calls":['))
    body = F.when(F.col("ls").isNotNull(), F.concat(F.to_json(top), F.coalesce(F.concat(F.lit(","), F.regexp_replace(rest, r"^\[|\]$", "")), F.lit("")))).otherwise("")
    trees = table(spark, d, "orders").join(flows, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("flow"), F.concat(head, body, F.lit("]}}")).alias("tree"))
    return rv.flow_methods(trees, "flow", "tree").select("flow", F.array_join("methods", " ").alias("methods"))


_VERBS = ["POST", "PUT", "PATCH", "GET", "DELETE", "HEAD"]


@query(
    f"""with e as (select {_VERBS}[l_partkey % 6 + 1] as v, l_suppkey % 2 = 0 as t, l_linenumber % 3 as c, l_linenumber % 2 as o, l_returnflag = 'R' as u from lineitem)
    select v as verb, t as targets, c as n_changed, o as n_output, u as unresolved, count(*) as n,
      case when v in ('POST', 'PUT') or (v = 'PATCH' and t) then 'INPUT PERSISTENCE' when v = 'GET' then 'OUTPUT' when v = 'PATCH' then 'INDIRECT_REGRESSION' when v = 'DELETE' then 'LIFECYCLE_REGRESSION' else 'UNDETERMINED' end as roles,
      case when v in ('POST', 'PUT') or (v = 'PATCH' and t) then 'HIGH' when v = 'GET' then 'MEDIUM' when v in ('PATCH', 'DELETE') then 'LOW' else 'REVIEW' end as priority,
      case when u then 'PROVISIONAL_PENDING_CLARIFICATION' when c = 0 or v = 'DELETE' or (v = 'GET' and o = 0) then 'REGRESSION_ONLY_OR_UNRELATED' when v = 'GET' then 'PROPOSED_IMPLEMENTATION' when v = 'PATCH' and not t then 'INDIRECT_REGRESSION' when v = 'HEAD' then 'REVIEW_ONLY' else 'PROPOSED_IMPLEMENTATION' end as scope
    from e group by all"""
)
def operation_roles(spark: SparkSession, d: str) -> DataFrame:
    names = ["verb", "targets", "n_changed", "n_output", "unresolved"]
    verb: Column = F.get(F.array(*map(F.lit, _VERBS)), F.col("l_partkey") % 6)
    rows = table(spark, d, "lineitem").select(verb.alias("verb"), (F.col("l_suppkey") % 2 == 0).alias("targets"), (F.col("l_linenumber") % 3).alias("n_changed"), (F.col("l_linenumber") % 2).alias("n_output"), (F.col("l_returnflag") == "R").alias("unresolved"))
    role, scope = rv.operation_role(F.lower("verb"), F.col("targets")), rv.change_scope(*map(F.col, names))
    return rows.groupBy(*names).agg(F.count("*").alias("n")).select(*names, "n", F.array_join(role["roles"], " ").alias("roles"), role["priority"].alias("priority"), scope.alias("scope"))


@query(
    """with f as (select distinct 'f' || (l_suppkey % 60) as field from lineitem where l_partkey in (select p_partkey from part where p_size % 5 = 0) and l_returnflag = 'R' and l_tax > 0.05),
    n as (select 'f' || (l_suppkey % 80) as field, count(distinct l_partkey) as n_files, count(distinct (l_partkey, l_orderkey)) as n_lines from lineitem where l_suppkey % 3 > 0 group by 1) select field, coalesce(n_files, 0) as n_files, coalesce(n_lines, 0) as n_lines from f left join n using (field)"""
)
def revision_refresh(spark: SparkSession, d: str) -> DataFrame:
    part, lines, field = table(spark, d, "part").withColumnRenamed("p_partkey", "path"), table(spark, d, "lineitem").withColumnRenamed("l_partkey", "path"), lambda k: F.concat(F.lit("f"), F.col("l_suppkey") % k).alias("field")
    declared = lines.where("l_returnflag = 'R' and l_tax > 0.05").select("path", field(60))
    return rv.refreshed(part.where("p_size % 5 = 0").select("path"), declared, lines.where("l_suppkey % 3 > 0").select(field(80), "path", F.col("l_orderkey").alias("line")), part.select("path"), part.select("path"))


_STEM = f"substr({_FIRST}, 1, 3)"


@query(
    f"""with s as (select doc_id as path, {_CAP(_STEM)} || ['Mapper', 'Service'][doc_id % 2 + 1] as c, 'run' || (doc_id % 3) as m, n_chars as line, sha256(text) as sha256 from documents where text is not null),
    r as (select item_id as request, {_CAP(_STEM)} || ['Mapper', 'Service', 'Helper'][item_id % 3 + 1] as c, case when item_id % 4 > 0 then 'run' || (item_id % 3) end as m from benchmark where text is not null)
    select distinct request, c as class_name, r.m as method, path, case when r.m is not null then line end as line, sha256 from r join s using (c) where r.m is null or r.m = s.m"""
)
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    cap = F.expr(f"concat(upper(substr({_STEM}, 1, 1)), substr({_STEM}, 2))")
    role = lambda key, *names: F.get(F.array(*map(F.lit, names)), F.col(key) % len(names))
    symbols = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.concat(cap, role("doc_id", "Mapper", "Service")).alias("class_name"), F.concat(F.lit("run"), F.col("doc_id") % 3).alias("method"), F.col("n_chars").alias("line"), F.col("text").alias("content"))
    asked = F.concat(F.lit("where does "), cap, role("item_id", "Mapper", "Service", "Helper"), F.when(F.col("item_id") % 4 > 0, F.concat(F.lit(".run"), F.col("item_id") % 3, F.lit("()"))).otherwise(" stand"), F.lit(" ?"))
    return rv.symbol_lookup(table(spark, d, "benchmark").select(F.col("item_id").alias("request"), asked.alias("text")), symbols, ("Service", "Mapper"))


@query(
    """with a as (select 'attr_' || (p_size % 37) || '_' || lower(p_type) as attribute from part group by 1), k as (select attribute, regexp_replace(attribute, '[^a-z0-9]', '', 'g') as k from a),
    t as (select 'attr' || (l_quantity::int % 29) || lower(p_type) as k, count(distinct l_orderkey) as tickets from lineitem join part on p_partkey = l_partkey where l_tax > 0.06 group by 1),
    m as (select 'attr' || (p_size % 30) || lower(p_type) as k, count(distinct p_partkey) as mappings from part group by 1), s as (select 'attr' || (p_size % 11) || lower(p_type) as k, count(distinct p_brand) as scenarios from part group by 1)
    select attribute, coalesce(tickets, 0) as tickets, coalesce(mappings, 0) as mappings, coalesce(scenarios, 0) as scenarios, case when coalesce(tickets, 0) + coalesce(mappings, 0) + coalesce(scenarios, 0) > 0 then 'EVIDENCE_FOUND' else 'NO_EVIDENCE' end as status from k left join t using (k) left join m using (k) left join s using (k)"""
)
def attribute_impact(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    named = lambda n, item: [F.concat(F.lit("Attr"), n, F.lit("-"), F.lower("p_type")).alias("attribute"), F.col(item).alias("item")]
    lines = table(spark, d, "lineitem").where("l_tax > 0.06").join(part, F.col("l_partkey") == F.col("p_partkey"))
    evidence = {"tickets": lines.select(*named(F.col("l_quantity").cast("int") % 29, "l_orderkey")), "mappings": part.select(*named(F.col("p_size") % 30, "p_partkey")), "scenarios": part.select(*named(F.col("p_size") % 11, "p_brand"))}
    return rv.attribute_impact(part.select(F.concat(F.lit("attr_"), F.col("p_size") % 37, F.lit("_"), F.lower("p_type")).alias("attribute")), evidence)
