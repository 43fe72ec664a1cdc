"""Queries of joins by what rows share, rankings, text work and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import text as tx
from tracequarry.operators import evidence, graph, linking, mappings, retrieval
from tracequarry.plans.registry import query, table
from tracequarry.store import spread

_KEY = r"regexp_replace(regexp_replace(regexp_replace(split_part(url, '?', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+', '/', 'g'), '\{[^/}]*\}', '{}', 'g')"
_CANON = f"case when length({_KEY}) > 1 then regexp_replace({_KEY}, '/$', '') else {_KEY} end"
_WORDS = lambda table, key, n: f"select distinct {key}, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) as w from {table}"


def _words(spark: SparkSession, d: str, name: str, key: str, least: int) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+"))
    return table(spark, d, name).select(key, F.explode(words).alias("w")).where(F.length("w") >= least)


@query(
    """with r as (select a.p_brand, a.p_partkey, a.p_name as target, ' use ' || b.p_name || ' when ' || lower(a.p_type) || ' ' as rule from part a join part b on b.p_partkey = a.p_partkey + 1), t as (select distinct p_brand, p_name as other from part)
    select distinct r.p_brand, p_partkey, target, other from r join t on r.p_brand = t.p_brand and contains(rule, ' ' || other || ' ') and other <> target"""
)
def rule_references(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("n"))
    rows = part.join(after, F.col("k") == F.col("p_partkey"), "left").select("p_brand", "p_partkey", F.col("p_name").alias("target"), F.concat(F.lit("use "), "n", F.lit(" when "), "p_type").alias("rule"))
    return mappings.rule_references(rows, "p_brand", "p_partkey", "target", "rule")


_PATHS = "select page_id, url, string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', ''), '/') as seg from pages"


@query(
    f"""with p as ({_PATHS}), o as (select seg[1] as prefix, 'H' || min(page_id) as owner from p where url like 'http:%' group by 1 union all select seg[1] || '/' || seg[2], 'S' || min(page_id) from p where url like 'https:%' group by 1),
    e as (select page_id, array_to_string(seg[1:k], '/') as prefix from p, lateral (select unnest(range(1, len(seg) + 1)) as k) x)
    select page_id, owner, prefix as matched_prefix from (select page_id, owner, prefix, row_number() over (partition by page_id order by length(prefix) desc, owner) as r from e join o using (prefix)) where r = 1"""
)
def prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_replace(F.split(F.split("url", r"\?")[0], "#")[0], "^[a-z]+://", "").alias("path"))
    head = lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")
    one = lambda test, mark, n: pages.where(F.col("url").startswith(test)).groupBy(head(n).alias("prefix")).agg(F.concat(F.lit(mark), F.min("page_id")).alias("owner"))
    owners = one("http:", "H", 1).unionByName(one("https:", "S", 2))
    return mappings.owners_by_prefix(pages.select("page_id", "path"), owners, "page_id", "path", "owner", "prefix", "/").select("page_id", "owner", "matched_prefix")


@query(
    f"""with a as (select page_id as scenario, case when url like 'http:%' then {_CANON} else '/' || split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) end as k from pages), e as (select distinct url as endpoint, {_CANON} as k from pages where url like '%?%'),
    x as (select distinct scenario, endpoint from a join e using (k) where k <> ''), l as (select * from a where k not in ('', '/') and scenario not in (select scenario from x)),
    s as (select scenario, count(*) as n, min(endpoint) as endpoint from l join e on ends_with('/' || ltrim(e.k, '/'), '/' || ltrim(l.k, '/')) group by 1)
    select scenario, endpoint, 'EXACT' as basis from x union all select scenario, endpoint, 'UNIQUE_SUFFIX' from s where n = 1"""
)
def endpoint_match(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    short = F.concat(F.lit("/"), F.element_at(F.split(F.split(F.split("url", r"\?")[0], "#")[0], "/"), -1))
    scenarios = pages.select(F.col("page_id").alias("scenario"), F.when(F.col("url").startswith("http:"), F.col("url")).otherwise(short).alias("path"))
    return linking.endpoint_matches(scenarios, pages.where(F.contains("url", F.lit("?"))).select(F.col("url").alias("endpoint")))


@query(
    """with t as (select distinct l_orderkey as test, l_partkey as c from lineitem), ta as (select distinct l_orderkey as test, l_linenumber as a from lineitem where l_quantity > 40), s as (select distinct l_suppkey as scenario, l_partkey as c from lineitem where l_quantity > 47),
    sa as (select distinct l_suppkey as scenario, l_linenumber as a from lineitem where l_quantity > 47), e as (select scenario, min(c) as entry from s group by 1),
    b as (select * from (select scenario, test, count(*) as n_calls from t join s using (c) group by all) join (select scenario, test, count(*) as n_attributes from ta join sa using (a) group by all) using (scenario, test)),
    k as (select b.*, case when t.test is not null then 0 when n_calls >= 2 then 1 else 2 end as o from b join e using (scenario) left join t on t.test = b.test and t.c = e.entry)
    select scenario, test, n_calls, n_attributes, ['DIRECT', 'TRANSITIVE', 'SHARED'][o + 1] as basis, rank from (select *, row_number() over (partition by scenario order by o, n_calls + n_attributes desc, test)::int as rank from k) where rank <= 30"""
)
def test_overlap(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    tests = lines.groupBy(F.col("l_orderkey").alias("test")).agg(F.collect_set("l_partkey").alias("calls"), F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_linenumber"))).alias("attributes"))
    scenarios = lines.where("l_quantity > 47").groupBy(F.col("l_suppkey").alias("scenario")).agg(F.collect_set("l_partkey").alias("calls"), F.collect_set("l_linenumber").alias("attributes"), F.min("l_partkey").alias("entry"))
    return linking.overlapping_tests(tests, scenarios)


@query(f"with a as (select item_id, w from ({_WORDS('benchmark', 'item_id', 9)}) where length(w) >= 9), b as (select doc_id, w from ({_WORDS('documents', 'doc_id', 9)}) where length(w) >= 9) select item_id, doc_id, count(*) as n_shared from a join b using (w) where item_id <> doc_id group by all")
def shared_entity_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda name, key: _words(spark, d, name, key, 9).withColumnRenamed("w", "entity")
    return linking.sharing_entities(rows("benchmark", "item_id"), rows("documents", "doc_id"), "item_id", "doc_id")


@query("with m as (select distinct l_orderkey as d, l_partkey as e from lineitem), s as (select p_partkey as seed from part where p_size = 50) select seed, m.e as entity, count(*) as n_documents from m v join s on v.e = seed join m on m.d = v.d where m.e <> seed group by all")
def entity_expansion(spark: SparkSession, d: str) -> DataFrame:
    mentions = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("entity"))
    return linking.expanded(mentions, table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("entity")))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_linestatus = 'F' and l_quantity > 2 and l_returnflag in ('A', 'R') and (l_partkey, l_suppkey) in (select p_partkey, p_size from part)")
def trusted_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ticket"), F.col("l_suppkey").alias("scope"), (F.col("l_linestatus") == "F").alias("verified"), F.when(F.col("l_quantity") > 2, F.col("l_orderkey")).alias("evidence_id"), F.col("l_returnflag").alias("source_type"))
    tickets = table(spark, d, "part").select(F.col("p_partkey").alias("ticket"), F.col("p_size").alias("scope"))
    return linking.trusted_links(links, tickets, ["A", "R"]).select("l_orderkey", "l_linenumber", F.col("ticket").alias("l_partkey"))


@query(
    """with t as (select distinct item_id as ticket, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as attribute from benchmark), tk as (select ticket, attribute, regexp_replace(lower(attribute), '[^a-z0-9]', '', 'g') as k from t where length(attribute) >= 10),
    l as (select doc_id as path, list_transform(string_split(text, chr(10)), lambda x, i: case when i % 3 = 1 then '// ' || x else x end) as ls from documents), n as (select path, unnest(range(1, len(ls) + 1)) as line, ls from l), w as (select distinct path, line, ls[line] as text, unnest(regexp_extract_all(ls[line], '[A-Za-z_][A-Za-z0-9_]*')) as word from n),
    m as (select ticket, path, line, attribute, max(round(least(0.9, 0.65 + case when regexp_matches(word, '^(get|set|is)[A-Z]') then 0.15 else 0 end + case when not regexp_matches(trim(text), '^(//|\\*|/\\*)') then 0.1 else 0 end), 2)) as score
      from w join tk on regexp_replace(lower(case when regexp_matches(word, '^(get|set|is)[A-Z]') then regexp_replace(word, '^(get|set|is)', '') else word end), '[^a-z0-9]', '', 'g') = k group by all)
    select ticket, path, line, attribute, score::double as score, rank from (select *, row_number() over (partition by ticket order by score desc, path, line, attribute)::int as rank from m) where rank <= 40"""
)
def attribute_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), F.when(F.col("at") % 3 == 0, F.concat(F.lit("// "), "text")).otherwise(F.col("text")).alias("text"))
    named = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    tickets = table(spark, d, "benchmark").select(F.col("item_id").alias("ticket"), named.alias("attribute")).where("length(attribute) >= 10")
    return linking.attribute_lines(lines, tickets)


@query(
    f"""with t as (select page_id as test, case when url like 'http:%' then {_CANON} end as declared, lower(regexp_extract(html, '<title>([^<]*)', 1)) as scenario from pages), o as (select page_id + 1000000 as operation, {_CANON} as endpoint, null::varchar as method from pages where url like 'https:%' union all select item_id, null, lower(split_part(text, ' ', 1)) from benchmark),
    c as (select distinct test, operation, 'CONFIRMED' as basis from t join o on lower(declared) = lower(endpoint) where trim(declared) <> ''), s as (select distinct test, unnest(string_split_regex(scenario, '[^a-z0-9_]+')) as w from t where coalesce(trim(declared), '') = '')
    select * from c union all select distinct test, operation, 'SUGGESTION' from s join o on w = method where method <> ''"""
)
def test_operation(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    tests = pages.select(F.col("page_id").alias("test"), F.when(F.col("url").startswith("http:"), F.col("url")).alias("declared"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("scenario"))
    ends = pages.where(F.col("url").startswith("https:")).select((F.col("page_id") + 1000000).alias("operation"), F.col("url").alias("endpoint"), F.lit(None).cast("string").alias("method"))
    named = table(spark, d, "benchmark").select(F.col("item_id").alias("operation"), F.lit(None).cast("string").alias("endpoint"), F.split("text", " ")[0].alias("method"))
    return linking.test_operations(tests, ends.unionByName(named))


@query("select o_orderkey, coalesce(n, 0) as n_evidence from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on l_orderkey = o_orderkey")
def file_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return linking.with_evidence(table(spark, d, "orders").select("o_orderkey"), found, "o_orderkey")


@query(
    """with r as (select lower(case when p_type < 'N' then p_brand end) as rc, lower(p_name) as m, max((p_retailprice, p_partkey, case when p_size > 10 then 'PASSED' else 'FAILED' end)) as run from part group by all), m as (select distinct case when p_size > 25 then 'com.x.' || p_brand end as test_class, p_name || '()' as test_method, lower(case when p_size > 25 then p_brand end) as c, lower(p_name) as k from part),
    b as (select test_class, test_method, max(run) as run from m join r on m.k = r.m and (rc is null or c is null or c = rc) group by all)
    select m.test_class, m.test_method, coalesce(run[3], 'NO_RUNTIME_EVIDENCE') as status from m left join b on b.test_class is not distinct from m.test_class and b.test_method = m.test_method"""
)
def runtime_status(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    methods = part.select(F.when(F.col("p_size") > 25, F.concat(F.lit("com.x."), "p_brand")).alias("test_class"), F.concat("p_name", F.lit("()")).alias("test_method"))
    reports = part.select(F.when(F.col("p_type") < "N", F.col("p_brand")).alias("class_name"), F.concat("p_name", F.lit("[1]")).alias("method"), F.when(F.col("p_size") > 10, "PASSED").otherwise("FAILED").alias("status"), F.col("p_retailprice").alias("created"), F.col("p_partkey").alias("report_id"))
    return linking.runtime_status(methods, reports)


@query("with k as (select distinct l_suppkey as scenario, p_brand as class_name from lineitem join part on l_partkey = p_partkey where l_quantity > 49) select c.p_brand as class_name, coalesce(array_to_string(list_sort(list(scenario) filter (where scenario is not null)), ','), '') as scenarios from (select distinct p_brand from part where p_size = 50) c left join k on k.class_name = c.p_brand group by 1")
def class_scenarios(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    used = table(spark, d, "lineitem").where("l_quantity > 49").join(part, F.col("l_partkey") == F.col("p_partkey"))
    of = lambda test, c: F.collect_set(F.when(test, c))
    scenarios = used.groupBy(F.col("l_suppkey").alias("scenario")).agg(
        of(F.col("l_returnflag") == "A", F.col("p_brand")).alias("classes"), of(F.col("l_returnflag") == "R", F.concat_ws(".", "p_brand", "p_name")).alias("methods"), of(F.col("l_returnflag") == "N", F.col("p_brand")).alias("path_classes"),
    )
    out = linking.class_scenarios(part.where("p_size = 50").select(F.col("p_brand").alias("class_name")), scenarios)
    return out.withColumn("scenarios", F.array_join("scenarios", ","))


@query(
    """with m as (select distinct o_custkey as project, l_partkey as method from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 48), r as (select distinct o_custkey as project, o_orderpriority as class_name from orders where o_orderstatus = 'P')
    select distinct o_custkey as project, o_orderkey as endpoint from orders join lineitem on l_orderkey = o_orderkey where (o_custkey, l_partkey) in (select project, method from m) union select o_custkey, o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem) and (o_custkey, o_orderpriority) in (select project, class_name from r)"""
)
def project_endpoints(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    controllers = lines.groupBy(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("class_name"), F.col("o_orderkey").alias("endpoint")).agg(F.collect_set("l_partkey").alias("calls"))
    matched = lines.where("l_quantity > 48").select(F.col("o_custkey").alias("project"), F.col("l_partkey").alias("method"))
    return linking.project_endpoints(controllers, matched, orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("class_name")))


@query(
    """with m as (select distinct l_partkey as a, l_orderkey as t from lineitem where l_quantity > 45), c as (select distinct l_suppkey as s, l_orderkey as t from lineitem where l_returnflag = 'R'), v as (select distinct l_suppkey as s, l_partkey as a from lineitem where l_linestatus = 'F')
    select m.a as attribute, m.t as ticket, count(c.s) as n_commits, count(v.s) as n_verified, case when count(v.s) > 0 then 'VERIFIED' else 'EXAMINED' end as status from m left join c on c.t = m.t left join v on v.s = c.s and v.a = m.a group by all"""
)
def ticket_chain(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    mentions = lines.where("l_quantity > 45").select(F.col("l_partkey").alias("attribute"), F.col("l_orderkey").alias("ticket"))
    commits = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sha"), F.col("l_orderkey").alias("ticket"))
    return linking.ticket_chain(mentions, commits, lines.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("sha"), F.col("l_partkey").alias("attribute")))


@query("select p_partkey, case when p_size > 25 then regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') = 'large' else contains(' ' || regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_]+', ' ', 'g') || ' ', ' large ') end as about from part")
def attribute_match(spark: SparkSession, d: str) -> DataFrame:
    declared = F.when(F.col("p_size") > 25, F.concat(F.lit("Part."), "p_type"))
    return table(spark, d, "part").select("p_partkey", linking.attribute_match(declared, F.lit("Large"), F.concat_ws(" ", "p_name", "p_type")).alias("about"))


@query(
    """select o_custkey, case when bool_or(o_orderpriority = '1-URGENT' and o_orderstatus = 'P') then 'NEW_BEHAVIOUR' when bool_or(o_orderpriority = '2-HIGH' and o_orderstatus = 'P') then 'PROTECTED_BEHAVIOUR' when bool_or(o_orderstatus = 'P') then 'CHANGED_ATTRIBUTE' else 'RELATED' end as role from orders group by 1"""
)
def test_role(spark: SparkSession, d: str) -> DataFrame:
    names = F.collect_set(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))
    every = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    tests = table(spark, d, "orders").groupBy("o_custkey").agg(names.alias("a"))
    known = F.when(F.size("a") > 0, F.concat(every, F.col("a"))).otherwise(every)
    return tests.select("o_custkey", linking.test_role(F.col("a"), F.array(F.lit("1-URGENT")), F.array(F.lit("2-HIGH")), known).alias("role"))


@query(
    """with i as (select o_custkey as scenario, o_orderpriority as attribute, case o_orderstatus when 'F' then 'DIRECT' when 'O' then 'TRANSITIVE' else 'SHARED' end as relevance, floor(o_totalprice / 10000) as score from orders), r as (select *, list_position(['DIRECT', 'TRANSITIVE', 'SHARED'], relevance) as o from i),
    b as (select scenario, max((score, -o)) as b, array_to_string(list_sort(list_distinct(list(attribute))), ',') as attributes from r group by 1)
    select scenario, ['DIRECT', 'TRANSITIVE', 'SHARED'][-b[2]] as relevance, b[1] as score, attributes, (-b[2])::int as reach_order from b"""
)
def merged_impacts(spark: SparkSession, d: str) -> DataFrame:
    relevance = F.when(F.col("o_orderstatus") == "F", "DIRECT").when(F.col("o_orderstatus") == "O", "TRANSITIVE").otherwise("SHARED")
    impacts = table(spark, d, "orders").select(F.col("o_custkey").alias("scenario"), F.col("o_orderpriority").alias("attribute"), relevance.alias("relevance"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("score"))
    return linking.merged_impacts(impacts).withColumn("attributes", F.array_join("attributes", ","))


@query(
    """with h as (select p_brand || case when p_size % 3 = 0 then 'Mapper' when p_size % 3 = 1 then 'Service' else 'Thing' end as owner, p_type as scope, p_name as item from part where p_size > 40),
    g as (select owner, scope, count(distinct item) as n_items, case when owner like '%Mapper' then 'mapper' when owner like '%Service' then 'service' else 'component' end as role from h group by all) select * from g where role = 'mapper' or n_items > 1"""
)
def owner_roles(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "Mapper").when(F.col("p_size") % 3 == 1, "Service").otherwise("Thing")
    hits = table(spark, d, "part").where("p_size > 40").select(F.concat("p_brand", kind).alias("owner"), F.col("p_type").alias("scope"), F.col("p_name").alias("item"))
    return linking.owner_roles(hits)


@query(
    """with a as (select distinct p_brand as attribute, split_part(p_name, ' ', 1) as token from part where p_size > 47), s as (select distinct p_brand as attribute, split_part(p_name, ' ', 1) as token from part where p_size < 4), b as (select attribute, count(*) as n, min(token) as token from a join s using (attribute, token) group by 1)
    select a.attribute, case when n = 1 then b.token end as domain from (select distinct attribute from a) a left join b using (attribute)"""
)
def domain_inference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("attribute"), F.split("p_name", " ")[0].alias("token"), "p_size")
    return linking.domains(rows.where("p_size > 47"), rows.where("p_size < 4"))


@query(
    f"""with a as (select distinct w as attribute from ({_WORDS('benchmark', 'item_id', 5)}) where length(w) >= 5), b as (select doc_id as body_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as attribute from documents), c as (select attribute, body_id, count(*) as n from b join a using (attribute) group by all)
    select attribute, body_id, n, rank from (select *, row_number() over (partition by attribute order by n desc, body_id)::int as rank from c) where rank <= 120"""
)
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "documents").select(F.col("doc_id").alias("body_id"), F.col("text").alias("body"))
    return linking.mention_counts(bodies, _words(spark, d, "benchmark", "item_id", 5).select(F.col("w").alias("attribute")))


@query(
    """with t as (select doc_id, regexp_extract_all(text, '[A-Za-z]{7,}') as ws from documents), p as (select doc_id, unnest(range(1, len(ws) + 1)) as pos, ws from t), f as (select doc_id, lower(ws[pos]) as k, min((pos, ws[pos])) as f from p group by all)
    select doc_id, f[2] as word, rank from (select *, row_number() over (partition by doc_id order by f[1], k)::int as rank from f) where rank <= 20"""
)
def first_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))
    return linking.ordered_first(table(spark, d, "documents").select("doc_id", F.posexplode(found).alias("pos", "word")), "doc_id", "word", "pos", 20)


@query(
    """with u as (select 0 as n, o_custkey, o_orderkey, o_totalprice from orders where o_orderstatus = 'P' union all select 1, o_custkey, o_orderkey, o_totalprice from orders where o_orderstatus <> 'O'), f as (select o_custkey, o_orderkey, min((n, o_totalprice)) as f from u group by all)
    select o_custkey, o_orderkey, round(f[2], 2) as o_totalprice from (select *, row_number() over (partition by o_custkey order by f[1], o_orderkey) as r from f) where r <= 20"""
)
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderstatus")
    frames = [orders.where("o_orderstatus = 'P'").drop("o_orderstatus"), orders.where("o_orderstatus <> 'O'").drop("o_orderstatus")]
    return linking.first_wins(frames, "o_orderkey", 20, "o_custkey")


@query("select l_partkey, l_orderkey, l_linenumber, rank from (select *, row_number() over (partition by l_partkey order by l_returnflag = 'R' desc, l_quantity desc, l_linenumber, l_orderkey, l_suppkey)::int as rank from lineitem where l_quantity >= 25) where rank <= 30")
def candidate_sort(spark: SparkSession, d: str) -> DataFrame:
    order = [(F.col("l_returnflag") == "R").desc(), F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_orderkey"), F.asc("l_suppkey")]
    return linking.best_per(table(spark, d, "lineitem"), "l_partkey", order, 30, ("l_quantity", 25)).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query(
    """with n as (select p_brand, p_name, p_size, p_partkey, row_number() over (partition by p_brand order by case p_type when 'LARGE' then 0 when 'MEDIUM' then 1 when 'SMALL' then 2 else 3 end, p_name, p_size, p_partkey)::int as rank from part) select p_brand, p_partkey, rank from n"""
)
def occurrence_order(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("p_type") == "LARGE", 0).when(F.col("p_type") == "MEDIUM", 1).when(F.col("p_type") == "SMALL", 2).otherwise(3)
    return linking.best_per(table(spark, d, "part"), "p_brand", [role.asc(), F.asc("p_name"), F.asc("p_size"), F.asc("p_partkey")], None).select("p_brand", "p_partkey", "rank")


@query(
    """with m as (select distinct l_suppkey as change, l_partkey as a from lineitem where l_quantity > 49), t as (select distinct l_orderkey as ticket, l_partkey as a from lineitem where l_returnflag = 'R')
    select change, ticket, count(*) as n_matches from m join t using (a) where (change, ticket) not in (select l_suppkey, l_orderkey from lineitem) group by all"""
)
def relevance_candidates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    mentions = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ticket"), F.col("l_partkey").alias("attribute"))
    changed = lines.where("l_quantity > 49").select(F.col("l_suppkey").alias("change"), F.col("l_partkey").alias("attribute"))
    return linking.relevance_candidates(mentions, changed, lines.select(F.col("l_suppkey").alias("change"), F.col("l_orderkey").alias("ticket")).distinct())


@query(
    f"""with a as (select distinct w as attribute from ({_WORDS('benchmark', 'item_id', 9)}) where length(w) >= 9), t as (select conv_id * 1000 + turn as ticket, regexp_extract(text, '^[^\n]*') as title, text from conversations where turn >= 0),
    w as (select distinct ticket, title, text, unnest(string_split_regex(lower(title || ' ' || text), '[^a-z0-9_]+')) as attribute from t), m as (select w.*, list_contains(string_split_regex(lower(title), '[^a-z0-9_]+'), attribute) as in_title from w join a using (attribute)),
    p as (select *, case when in_title then title else text end as src from m), q as (select *, strpos(' ' || regexp_replace(lower(src), '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || attribute || ' ') as place from p)
    select attribute, ticket, case when in_title then 'TITLE' else 'TEXT' end as matched_in, md5(substr(src, greatest(place - 100, 1), place - greatest(place - 100, 1) + length(attribute) + 140)) as excerpt from q"""
)
def ticket_lookup(spark: SparkSession, d: str) -> DataFrame:
    tickets = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ticket"), F.regexp_extract("text", "^[^\n]*", 0).alias("title"), "text")
    out = linking.ticket_lookup(tickets, _words(spark, d, "benchmark", "item_id", 9).select(F.col("w").alias("attribute")))
    return out.withColumn("excerpt", F.md5(F.col("excerpt").cast("binary")))


@query("select k, item from (select s_suppkey as k, unnest([case when s_acctbal < 0 then 'GAP' end, case when s_acctbal < 2000 then 'PLAN_TEST' end, case when s_nationkey < 10 then 'RISK' end]) as item from supplier) where item is not null")
def plan_rows(spark: SparkSession, d: str) -> DataFrame:
    rules = {"GAP": F.col("s_acctbal") < 0, "PLAN_TEST": F.col("s_acctbal") < 2000, "RISK": F.col("s_nationkey") < 10}
    return linking.plan_rows(table(spark, d, "supplier").withColumnRenamed("s_suppkey", "k"), rules, "k")


@query(
    """with o as (select p_brand, p_name, max((p_type, p_size)) as a from part where p_size <= 30 group by all), n as (select p_brand, p_name, max((p_type, p_size)) as b from part where p_size > 20 group by all), j as (select coalesce(o.p_brand, n.p_brand) as p_brand, coalesce(o.p_name, n.p_name) as c, a, b from o full join n on o.p_brand = n.p_brand and o.p_name = n.p_name)
    select p_brand, """
    + ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list(c) filter (where {t}))), ','), '') as {n}" for n, t in (("added", "a is null"), ("removed", "b is null"), ("changed", "a is not null and b is not null and a <> b")))
    + " from j group by 1"
)
def contract_diff(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_brand", "p_name", "p_type", "p_size")
    out = linking.contract_diff(part.where("p_size <= 30"), part.where("p_size > 20"), ["p_brand"], "p_name")
    return out.select("p_brand", *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed")])


# ---- text, scores and graphs that had no query

@query(
    r"""with q as (select item_id, lower(text) as q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:-]+')) as ts, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as c from benchmark where text <> ''),
    d as (select doc_id, lower(text) as t, [source, regexp_extract(lower(text), '([a-z]{6,} [a-z]+)', 1), regexp_extract(lower(text), '([a-z]{6,} [a-z]+)', 1)] as ids from documents),
    n as (select doc_id, t, list_filter(list_transform(ids, lambda i: regexp_replace(lower(i), '[^a-z0-9]', '', 'g')), lambda i: i <> '') as ids from d),
    s as (select item_id, doc_id, case when contains(t, q) then 80 else 0 end + coalesce(list_sum(list_transform(ts, lambda x: least(12.0 * (length(t) - length(replace(t, x, ''))) / length(x), 48.0))), 0) + 90 * len(list_filter(ids, lambda i: contains(c, i))) as score from q, n)
    select item_id, doc_id, round(score, 6)::double as score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0) where rank <= 10"""
)
def exact_scores(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_extract(F.lower("text"), "([a-z]{6,} [a-z]+)", 1)  # of a document that has no other identifier than its source
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id", each=1 << 22).select("doc_id", "text", F.array("source", name, name).alias("identifiers"))
    ranked = retrieval.top(retrieval.exact_scores(documents, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10), 10)
    return ranked.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    """with s as (select p_partkey as doc_id, lower(p_name) as lhs, case when p_size % 3 = 0 then '<=' else '<' end as op, (p_size + 30)::double as t from part where p_size < 20), c as (select lower(p_name) as lhs, case when p_size % 2 = 0 then '<' else '<=' end as op, p_size::double as t from part where p_size > 48)
    select distinct s.doc_id, s.lhs, s.op as stated_op, s.t as stated_threshold, c.op as code_op, c.t as code_threshold from s join c using (lhs) where s.op <> c.op or s.t <> c.t"""
)
def threshold_mismatch(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("lhs"), F.col("p_size").cast("double").alias("threshold"), "p_size")
    even = F.when(F.col("p_size") % 2 == 0, "<").otherwise("<=")
    return evidence.threshold_mismatches(part.where("p_size < 20").withColumns({"op": F.when(F.col("p_size") % 3 == 0, "<=").otherwise("<"), "threshold": F.col("threshold") + 30}), part.where("p_size > 48").withColumn("op", even))


@query(
    """with u as (select 0 as o, 'k' || c_custkey as id, 'CUSTOMER' as label, c_name as name from customer union all select 1, 'k' || s_suppkey, 'SUPPLIER', s_name from supplier), m as (select id, max((o, label, name)) as m from u group by 1) select id, m[2] as label, m[3] as name from m"""
)
def graph_union(spark: SparkSession, d: str) -> DataFrame:
    nodes = lambda name, k, label, n: table(spark, d, name).select(F.concat(F.lit("k"), k).alias("id"), F.lit(label).alias("label"), F.col(n).alias("name"))
    return graph.merge_nodes([nodes("customer", "c_custkey", "CUSTOMER", "c_name"), nodes("supplier", "s_suppkey", "SUPPLIER", "s_name")])


_G = """e as (select distinct 'c' || o_custkey as s, 'o' || o_orderkey as t, 'CALLS' as y from orders union select 'o' || l_orderkey, 'p' || l_partkey, 'CALLS' from lineitem where l_quantity > 49 union select distinct 'c' || c_custkey, 'n' || c_nationkey, 'BELONGS_TO' from customer union select 'o' || o_orderkey, 'd' || year(o_orderdate), 'RELEASED_IN' from orders)"""


@query(
    f"""with recursive {_G}, seeds as (select 'p' || p_partkey as seed from part where p_size = 50), a(seed, node, depth) as (select seed, seed, 0 from seeds union select seed, e.s, depth + 1 from a join e on e.t = node and y = 'CALLS' where depth < 8), am as (select seed, node, min(depth) as depth from a group by all),
    b as (select am.seed, e.t as node, min(am.depth + 1) as depth from am join e on e.s = am.node and y <> 'CALLS' group by all)
    select seed, node, 'CALLERS' as direction, depth::int as depth from am where depth > 0 union all select seed, node, 'BUSINESS', depth::int from b"""
)
def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    link = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"), F.lit(kind).alias("type"))
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    edges = link(orders, "c", "o_custkey", "o", "o_orderkey", "CALLS").unionByName(link(table(spark, d, "lineitem").where("l_quantity > 49"), "o", "l_orderkey", "p", "l_partkey", "CALLS"))
    edges = edges.unionByName(link(customer, "c", "c_custkey", "n", "c_nationkey", "BELONGS_TO")).unionByName(link(orders.withColumn("y", F.year("o_orderdate")), "o", "o_orderkey", "d", "y", "RELEASED_IN"))
    seeds = table(spark, d, "part").where("p_size = 50").select(F.concat(F.lit("p"), "p_partkey").alias("seed"))
    return graph.impact(edges, seeds, ["CALLS"], ["BELONGS_TO", "RELEASED_IN"])


_RARE = """w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{14,}')) as w from documents), r as (select w, min(doc_id) as a from w group by 1 having count(*) between 2 and 6), e as (select a, doc_id as b from w join r using (w) where doc_id <> a)"""


@query(f"with recursive {_RARE}, l as (select a, b from e union select b, a from e), c(n, m) as (select a, a from l union select n, b from c join l on m = a) select n as node, min(m) as component from c group by 1")
def rare_word_components(spark: SparkSession, d: str) -> DataFrame:
    """Documents that rare long words tie together, over any number of steps: each row of a word is tied to the word's first."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{14,}"), F.lit(0)))).alias("w"))
    rare = words.groupBy("w").agg(F.min("doc_id").alias("source"), F.count("*").alias("n")).where("n between 2 and 6")
    return graph.components(words.join(rare, "w").where("doc_id <> source").select("source", F.col("doc_id").alias("target")))


@query(
    """select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{4})\\b', 1), lambda m: upper(m[1]) || lower(regexp_replace(m[2:], '\\s+', ' ', 'g'))))), ',') as releases
    from (select doc_id, 'In ' || ['january', 'MAY', 'August', 'december'][doc_id % 4 + 1] || '  20' || (10 + doc_id % 90) || ' and May 2031, ' || text as t from documents where text is not null)"""
)
def month_releases(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("january", "MAY", "August", "december"))), (F.col("doc_id") % 4 + 1).cast("int"))
    told = F.concat(F.lit("In "), names, F.lit("  20"), (10 + F.col("doc_id") % 90).cast("string"), F.lit(" and May 2031, "), "text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(tx.month_releases(told)), ",").alias("releases"))


@query(
    """select event_id, epoch_us(ts) as micros, round(abs(epoch_us(ts) - epoch_us(timestamp '2024-01-02 00:00:00')) / 86.4e9, 6) as days from events"""
)
def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Times written as ISO text, half of them with an offset, read back as one instant."""
    e = table(spark, d, "events").select("event_id", "ts")
    plain = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    told = F.when(F.col("event_id") % 2 == 0, F.concat(plain, F.lit("Z"))).otherwise(plain)
    at = F.unix_micros(tx.utc_timestamp(told))
    noon = F.unix_micros(tx.utc_timestamp(F.lit("2024-01-02T00:00:00")))
    return e.select("event_id", at.alias("micros"), F.round(F.abs(at - noon) / 86.4e9, 6).alias("days"))


@query()
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").select("doc_id", F.explode(tx.paragraph_chunks(F.col("text"))).alias("c"))
    return cut.select("doc_id", "c.number", F.length("c.chunk").alias("n_chars"), F.md5(F.col("c.chunk").cast("binary")).alias("digest"))
