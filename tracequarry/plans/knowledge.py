"""Queries on evidence from several sources, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import knowledge, lineage
from tracequarry.plans.registry import query, table
from tracequarry.store import spread

_HISTORY, _CHANGE, _RELEASE, _DOMAINS, _GENERIC = ("with", "hein"), ("whou",), ("hein",), ("reer", "thre", "itin"), ("the", "and", "of", "with", "that", "hein", "whou", "reer", "thre", "itin")


@query(
    f"""with q as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from benchmark),
    a as (select query_id, t, len(list_intersect(t, {list(_HISTORY)})) > 0 as h, list_intersect(t, {list(_DOMAINS)}) as dom, list_filter(t, lambda x: length(x) > 6 and not list_contains({list(_GENERIC)}, x)) as sub from q),
    d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as t, source in ('src1', 'src3', 'src4', 'src7', 'src9') and n_chars % 4 > 0 as released from documents),
    pairs as (select query_id, doc_id from q join documents on doc_id % 40 = query_id % 40),
    j as (select query_id, doc_id, not (h or list_contains(a.t, 'whou')) or ((len(dom) = 0 or len(list_intersect(dom, d.t)) > 0) and (len(sub) = 0 or len(list_intersect(sub, d.t)) > 0) and (not list_contains(a.t, 'hein') or coalesce(released, false))) as ok
      from pairs join a using (query_id) join d using (doc_id))
    select query_id, doc_id from j where ok"""
)
def grounded_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Frequent words of the given texts stand for the words of history, change, release and domain."""
    items = table(spark, d, "benchmark")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    asked = items.select(F.col("item_id").alias("query_id"), tokens("text").alias("tokens")).withColumns({"subjects": F.filter("tokens", lambda x: F.length(x) > 6), "intents": F.lit(None).cast("array<string>")})
    documents = table(spark, d, "documents")
    ranked = items.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k")).join(documents.select("doc_id", (F.col("doc_id") % 40).alias("k")), "k").select("query_id", "doc_id")
    release = F.when(F.col("source").isin("src1", "src3", "src4", "src7", "src9"), F.col("source")).when(F.col("source") == "src5", " Unknown Release").when(F.col("source") == "src6", "")
    known = documents.select("doc_id", tokens("text").alias("tokens"), release.alias("release"), (F.col("n_chars") % 4).alias("n_tests"))
    return knowledge.grounded(ranked, knowledge.constraints(asked, _HISTORY, _CHANGE, _RELEASE, _DOMAINS, _GENERIC), known)


_J = lambda *parts: "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x is not null and trim(x) <> ''), chr(10))"


@query(
    f"""with s as (select c_custkey as sid, 'OP-' || c_custkey as code, c_name as s_name, c_mktsegment as description, 'Endpoint ' || case when c_custkey % 2 = 0 then 'GET' else 'POST' end || ' /c/' || c_nationkey as plc, case when c_custkey % 5 > 0 then ' tk-' || (c_custkey % 50) end as own from customer),
    b as (select o_orderkey as bid, o_custkey as sid, case when o_orderstatus <> 'P' then o_orderpriority end as b_name, o_orderkey % 4 as version, coalesce(case when o_orderstatus = 'F' then 100 + o_orderkey % 7 end, o_orderkey % 4) as release from orders where o_orderkey % 3 = 0),
    t as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as tid, o_custkey as sid, case when l_returnflag = 'R' then null when l_tax > 0.03 then l_orderkey else l_orderkey + 3 end as of, l_linenumber % 4 as cv, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 46),
    tt as (select 't' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_quantity::int as tid, sid, any_value(of) as of, cv, 'T' || l_partkey as t_name, case when l_linenumber < 6 then 'PASS' end as status, case when l_quantity > 48 then ['TK-' || (l_partkey % 50), 'TK-' || (l_partkey % 7)] else [] end as raw from t group by all),
    tk as (select *, list_sort(list_distinct(raw)) as keys from tt),
    k as (select 'TK-' || s_suppkey as k, case when s_suppkey % 3 > 0 then s_name end as title, case when s_suppkey % 2 = 0 then 'needs ' || s_nationkey else '' end as requirement from supplier where s_suppkey < 45),
    told as (select tid, string_agg({_J("'JIRA ' || k", "'JIRA title ' || title", "'JIRA requirement ' || nullif(requirement, '')")}, chr(10) order by p) as told from (select tid, unnest(keys) as kk, generate_subscripts(keys, 1) as p from tk) join k on k = kk group by tid),
    rel as (select distinct tid, bid from tk join b on tk.sid = b.sid and (tk.of = b.bid or tk.cv = b.version)),
    orph as (select tid, null::bigint as bid from tk where of is not null and not exists (select 1 from b where b.sid = tk.sid and b.bid = tk.of)),
    listed as (select bid, string_agg(t_name, ', ' order by tid, t_name) as names, list_sort(list_distinct(flatten(list(keys)))) as keys, count(*) as n from rel join tk using (tid) group by bid),
    each as (select * from (select * from rel union all select * from orph) join tk using (tid))
    select 'scenario:' || sid as document_id, 'scenario' as kind, sid as scenario_id, code || ' · Operation' as title, {_J("'Operation scenario ' || code", "s_name", "description", "plc")} as text, case when own is null then '' else upper(trim(own)) end as tickets, 0::bigint as n_tests from s
    union all select 'scenario:' || sid || ':release:' || bid, 'release', sid, code || ' · ' || coalesce(b_name, 'Release') || ' V' || release, {_J("'Release baseline for ' || code", "plc", "'Release ' || coalesce(b_name, 'Release') || ' V' || release", "'Code baseline V' || version", "'Test baselines ' || coalesce(names, '')", "'JIRAs ' || coalesce(array_to_string(keys, ', '), '')")}, coalesce(array_to_string(keys, ','), ''), coalesce(n, 0) from b join s using (sid) left join listed using (bid)
    union all select 'scenario:' || sid || ':test:' || tid || ':release:' || coalesce(bid::varchar, 'orphan'), 'test_baseline', sid, t_name || ' · ' || coalesce(b_name, 'Unknown Release') || ' V' || coalesce(release, cv), {_J("'Test baseline ' || t_name", "'Parent scenario ' || code", "plc", "'Release ' || coalesce(b_name, 'Unknown Release') || ' V' || coalesce(release, cv)", "'Status ' || status", "told")}, array_to_string(keys, ','), 1
      from each join s using (sid) left join (select bid, b_name, release from b) using (bid) left join told using (tid)"""
)
def registry_documents(spark: SparkSession, d: str) -> DataFrame:
    customer, orders, supplier = (table(spark, d, n) for n in ("customer", "orders", "supplier"))
    text = lambda p, c: F.concat(F.lit(p), c)
    scenarios = customer.select(F.col("c_custkey").alias("scenario_id"), text("OP-", "c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.when(F.col("c_custkey") % 2 == 0, "GET").otherwise("POST").alias("http_method"), text("/c/", "c_nationkey").alias("endpoint"), F.when(F.col("c_custkey") % 5 > 0, text(" tk-", F.col("c_custkey") % 50)).alias("ticket"))
    baselines = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("baseline_id"), F.col("o_custkey").alias("scenario_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderstatus") == "F", 100 + F.col("o_orderkey") % 7).alias("release_version"), (F.col("o_orderkey") % 4).alias("version"))
    lines = table(spark, d, "lineitem").where("l_quantity > 46").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("scenario_id")), "l_orderkey")
    of = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_tax") > 0.03, F.col("l_orderkey")).otherwise(F.col("l_orderkey") + 3)
    key = F.concat(F.lit("t"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int")))
    keys = F.when(F.col("l_quantity") > 48, F.array(text("TK-", F.col("l_partkey") % 50), text("tk-", F.col("l_partkey") % 7), F.lit(" "))).otherwise(F.array(F.lit("")))
    tests = lines.select(key.alias("test_id"), "scenario_id", of.alias("baseline_id"), (F.col("l_linenumber") % 4).alias("code_version"), text("T", "l_partkey").alias("name"), F.when(F.col("l_linenumber") < 6, "PASS").alias("status"), keys.alias("tickets")).dropDuplicates(["test_id"])
    tickets = supplier.where("s_suppkey < 45").select(text("TK-", "s_suppkey").alias("ticket"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("title"), F.when(F.col("s_suppkey") % 2 == 0, text("needs ", "s_nationkey")).otherwise("").alias("requirement"))
    return knowledge.registry_documents(scenarios, baselines, tests, tickets).withColumn("tickets", F.array_join("tickets", ","))


_KINDS = ["REQUIREMENT", "TEST", "CODE_CHANGE", "Notes"]


@query(
    f"""with q as (select o_orderkey as query_id, 'P' || (o_custkey % 20) as project, case when o_orderkey % 3 = 0 then ['tk-' || (o_custkey % 400)] else [] end as keys, case when o_orderkey % 3 = 1 then ['Part' || (o_custkey % 3000)] else ['none'] end as ents from orders where o_orderstatus = 'P'),
    tk as (select 'TK-' || c_custkey as ticket, case when c_custkey % 4 > 0 then 'P' || (c_custkey % 20) end as p, 'part' || (c_custkey * 3) as e from customer where c_custkey % 2 = 0),
    docs as (select l_orderkey * 10 + l_linenumber as doc_id, 'P' || (l_partkey % 20) as project, {_KINDS}[l_suppkey % 4 + 1] as y, 'part' || l_partkey as e1, 'sup' || l_suppkey as e2 from lineitem where l_quantity > 44 qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) = 1),
    ents as (select distinct doc_id, project, unnest([e1, e2]) as e from docs),
    found as (select query_id, project, ticket, e from (select query_id, project, unnest(keys) as k from q) join tk on lower(ticket) = k and (p is null or p = project)),
    seeds as (select query_id, project, lower(unnest(ents)) as e from q union select query_id, project, unnest(keys) from q union select query_id, project, e from found),
    exact as (select distinct query_id, project, doc_id from seeds join ents using (project, e)),
    auth as (select query_id from exact union select query_id from found),
    sem as (select distinct query_id, q.project, doc_id from q join docs on doc_id = query_id * 10 + 1 or doc_id = query_id * 10 + 2 where q.project = docs.project and query_id not in (from auth)),
    disc as (select * from seeds union select s.query_id, s.project, e from (select * from exact union all select * from sem) s join ents using (doc_id, project)),
    more as (select * from disc union select query_id, project, 'sup' || (s_suppkey + 1) from disc join supplier on e = 'sup' || s_suppkey and s_suppkey % 10 = 0),
    hit as (select distinct query_id, doc_id from more join ents using (project, e) union select query_id, doc_id from sem),
    rows_ as (select query_id, case y when 'REQUIREMENT' then 'requirements' when 'TEST' then 'tests' when 'CODE_CHANGE' then 'code_changes' else 'notes' end as bucket, 'DOCUMENT' as source, doc_id::varchar as ref from hit join docs using (doc_id) union select query_id, 'requirements', 'TICKET', ticket from found)
    select query_id, case when query_id in (from auth) then 'EXACT_ENTITY' else 'SEMANTIC' end as mode, bucket, source, ref from rows_"""
)
def evidence_search(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    text = lambda p, c: F.concat(F.lit(p), c)
    k, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    queries = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("query_id"), text("P", c % 20).alias("project"), F.when(k == 0, F.array(text("tk-", c % 400))).alias("tickets"), F.when(k == 1, F.array(text("Part", c % 3000))).otherwise(F.array(F.lit("none"), F.lit(" "))).alias("entities"))
    key = F.col("c_custkey")
    tickets = table(spark, d, "customer").where("c_custkey % 2 = 0").select(text("TK-", key).alias("ticket"), F.when(key % 4 > 0, text("P", key % 20)).alias("project"), F.array(text("PART", key * 3)).alias("entities"))
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))
    lines = table(spark, d, "lineitem").where("l_quantity > 44").withColumn("r", first).where("r = 1")
    documents = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), text("P", F.col("l_partkey") % 20).alias("project"), F.get(F.array(*map(F.lit, _KINDS)), F.col("l_suppkey") % 4).alias("source_type"), F.array(text("part", "l_partkey"), text("sup", "l_suppkey")).alias("entities"))
    matches = queries.select("query_id", F.explode(F.array(F.col("query_id") * 10 + 1, F.col("query_id") * 10 + 2)).alias("doc_id"))
    links = table(spark, d, "supplier").where("s_suppkey % 10 = 0").select(text("sup", "s_suppkey").alias("entity"), text("sup", F.col("s_suppkey") + 1).alias("other"))
    return knowledge.evidence_search(queries, tickets, documents, matches, links)


@query(
    r"""with t as (select conv_id, turn, role, text, regexp_replace(text, '^[ \t\n\r\x0b\x0c\x1c-\x1f]+|[ \t\n\r\x0b\x0c\x1c-\x1f]+$', '', 'g') as s from conversations)
    select conv_id, turn, case when turn % 3 = 0 then trim(role || ' ' || s, chr(10) || ' ') || chr(10) || chr(10) || 'end' when turn % 3 = 1 then coalesce(text, '') else s end as text from t where role is not null and text is not null"""
)
def rich_texts(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as trees of several shapes; what each must say is known from how it is built."""
    leaf = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    nested = F.struct(F.array(F.struct(F.col("role").alias("text"), F.array(leaf).alias("content"))).alias("content"))
    row = F.to_json(F.struct(nested.alias("a"), leaf.alias("b")))
    parts = F.from_json(row, "a string, b string")
    tree = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), parts["a"], F.lit(", {}, {\"type\": \"rule\", \"attrs\": {\"n\": [1, null]}, \"text\": \" end \"}]"))).when(F.col("turn") % 3 == 1, F.to_json(F.array("text"))).otherwise(F.concat(F.repeat(F.lit('{"content":['), 40), parts["b"], F.repeat(F.lit("]}"), 40)))
    rows = table(spark, d, "conversations").where("role is not null and text is not null").select("conv_id", "turn", "role", "text").withColumn("tree", tree)
    return knowledge.rich_text(rows.select("conv_id", "turn", "tree")).select("conv_id", "turn", "text")


_CODES = ["x.setSum(r.getSum().trim());", "x.setSum(null);", "x.setSum(r.sum());", "// x.setSum(1);", "if (sum > 1) {", "sum = other;", "repository.save(x);", "y = r.getSum();", "x.setSum(5);", "log(sum);"]
_USES = ["VALUE_TRANSFORMED", "NULL_OVERWRITE", "MAPPING", "COMMENTED_OUT", "CONDITIONAL_PATH", "ASSIGNMENT", "PERSISTENCE", "READ", "MAPPING", "OVERWRITE"]
_EVENTS = f"""ev as (select o_custkey as defect, 'C' || l_suppkey % 7 as class_name, 'm' || l_partkey % 5 as method, case when l_linenumber < 7 then l_quantity::bigint end as line, {_CODES}[l_partkey % 10 + 1] as code, {_USES}[l_partkey % 10 + 1] as usage, min(l_linenumber) as step, bool_or(l_tax > 0.06) as direct
      from lineitem join orders on o_orderkey = l_orderkey where o_custkey % 3 > 0 or l_partkey % 10 in (2, 3, 6, 7, 8, 9) group by all),
    sc as (select *, case usage {" ".join(f"when '{u}' then {w}" for u, w in lineage.WEIGHTS.items())} else 0 end + case when direct and usage <> 'COMMENTED_OUT' then 20 else 0 end as score from ev),
    ranked as (select *, row_number() over (partition by defect order by score desc, line nulls last, step, class_name, method, code)::int as rank from sc)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("o_custkey % 3 > 0 or l_partkey % 10 in (2, 3, 6, 7, 8, 9)")
    code = F.get(F.array(*map(F.lit, _CODES)), F.col("l_partkey") % 10)
    return lines.select(
        F.col("o_custkey").alias("defect"), F.lit("sum").alias("attribute"), F.concat(F.lit("C"), F.col("l_suppkey") % 7).alias("class_name"), F.concat(F.lit("m"), F.col("l_partkey") % 5).alias("method"),
        F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("long")).alias("line"), F.col("l_linenumber").alias("step"), code.alias("code"), F.when(F.col("l_partkey") % 10 == 9, "overwrite").alias("usage_type"), (F.col("l_tax") > 0.06).alias("direct"),
    )


@query(f"with {_EVENTS} select defect, class_name, method, line, step::int as step, code, usage, score::int as score, rank from ranked where rank <= 12")
def divergence_ranking(spark: SparkSession, d: str) -> DataFrame:
    return lineage.divergence_ranking(_events(spark, d)).drop("attribute")


@query(
    f"""with {_EVENTS}, m as (select *, usage in ('MAPPING', 'ASSIGNMENT') as map, code like '%setSum(%' or code like 'sum =%' as w from ranked),
    e as (select *, max(case when w then line end) over (partition by defect, class_name, method order by line range between unbounded preceding and 1 preceding) as earlier from m where map),
    o as (select defect, min((class_name, method, line)) as o from e where earlier is not null and code = 'x.setSum(5);' group by 1),
    b as (select defect, min((rank, usage, class_name, method, line)) filter (usage in ('NULL_OVERWRITE', 'CONDITIONAL_PATH', 'VALUE_TRANSFORMED')) as risk, min((rank, usage, class_name, method, line)) filter (map) as mapping, min((rank, usage, class_name, method, line)) filter (usage = 'COMMENTED_OUT' and w) as comment from m group by 1),
    df as (select c_custkey as defect, case when c_custkey % 5 > 0 then '7' end as expected, case when c_custkey % 6 = 0 then null when c_custkey % 2 = 0 then '5' else '8' end as actual, case when c_custkey % 11 > 0 then '7' end as input from customer),
    j as (select df.*, risk, mapping, comment, case when actual = '5' then o end as o, actual is null and expected is not null and mapping is null as lost from df left join b using (defect) left join o using (defect)),
    k as (select *, case when input is null and expected is not null then 1 when risk is not null then 2 when lost and comment is not null then 3 when lost then 4 when o is not null then 5 when mapping is not null then 6 else 7 end as n from j),
    p as (select *, case n when 2 then (risk[3], risk[4], risk[5]) when 3 then (comment[3], comment[4], comment[5]) when 5 then o when 6 then (mapping[3], mapping[4], mapping[5]) end as p from k)
    select defect, case n when 1 then 'INPUT_MISSING_OR_NULL' when 2 then risk[2] when 3 then 'MISSING_MAPPING' when 4 then 'MISSING_MAPPING' when 5 then 'VALUE_OVERWRITTEN' when 6 then 'MAPPING_REVIEW_REQUIRED' else 'NO_DETERMINISTIC_DIVERGENCE_FOUND' end as classification,
      ['HIGH', 'HIGH', 'HIGH', 'MEDIUM', 'HIGH', 'MEDIUM', 'LOW'][n] as confidence, p[1] as class_name, p[2] as method, p[3] as line from p"""
)
def likely_divergence(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    actual = F.when(key % 6 == 0, None).when(key % 2 == 0, "5").otherwise("8")
    defects = table(spark, d, "customer").select(key.alias("defect"), F.lit("sum").alias("attribute"), F.when(key % 5 > 0, "7").alias("expected"), actual.alias("actual"), F.when(key % 11 > 0, "7").alias("input"))
    return lineage.likely_divergence(lineage.divergence_ranking(_events(spark, d), first=None), defects).drop("attribute")


@query(
    """with o as (select o_orderkey as k, o_custkey as c, ['Requirement', 'MAPPING', 'JIRA', null][o_orderkey % 4 + 1] as y from orders),
    e as (select k, y, unnest([('jira_ids', 1, 'TK-' || c), ('jira_ids', 2, 'ORD-' || k), ('attributes', 1, 'total' || c), ('attributes', 2, 'status'), ('attributes', 3, case when y in ('Requirement', 'JIRA') then 'extra' || k end), ('scenarios', 1, 'S_' || c % 9), ('endpoints', 1, case when y is distinct from 'MAPPING' then '/o/' || k end),
      ('endpoints', 2, case when y is distinct from 'MAPPING' then '/c/' || c end), ('http_methods', 1, 'POST'), ('classes', 1, 'Order' || k % 5), ('classes', 2, case when y in ('Requirement', 'JIRA') then 'Customer' end), ('classes', case when y in ('Requirement', 'JIRA') then 3 else 2 end, 'OrderService'), ('methods', 1, 'find' || k % 7), ('release_names', 1, 'September 2026'),
      ('release_names', 2, 'R' || c % 3), ('tests', 1, 'T' || k), ('tests', 2, 'OrderTest'), ('commits', 1, lpad(k::varchar, 8, 'a')), ('files', 1, 'src/O' || k || '.java'), ('files', 2, 'pom.xml')]) as e from o)
    select k as doc_id, e[1] as kind, e[2]::int as rank, e[3] as entity from e where e[3] is not null"""
)
def entity_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A text for each order that names all kinds of entities, some twice, some only in prose and some out of scope."""
    from tracequarry.operators import entities

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [
        "JIRA: TK-", c, " and ORD-", k, " and TK-", c, ". Attribute: total", c, ", `status`, TOTAL", c, "; Scenario: S_", c % 9, ".\nEndpoint: /c/", c, "\npost /o/", k, ", post /c/", c, "\nClass: Order", k % 5, ".\nfind", k % 7, "() by the OrderService and x.find", k % 7,
        "( ).\nRelease: R", c % 3, ". It came in september 2026\nTest: T", k, ". See OrderTest; commit ", F.lpad(k.cast("string"), 8, "a"), "\nFiles: src/O", k, ".java, pom.xml\nAdd a new Customer attribute named extra", k, ".\nOut of scope\nsecret belongs to the Vault.\n",
    ]
    kind = F.get(F.array(*[F.lit(x) for x in ("Requirement", "MAPPING", "JIRA")]), k % 4)
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return entities.extracted(spread(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(k.alias("doc_id"), kind.alias("source_type"), text.alias("text")))


@query(
    """with c as (select c_custkey as k, upper(left(c_mktsegment, 4)) as a, 'R' || chr(65 + c_nationkey) as b, c_custkey % 6 as m from customer),
    i as (select k, unnest([('region', 'ACCEPT', a, 0), ('region', 'ACCEPT', b, 0), ('region', 'REJECT', case when m < 3 then b else 'ZZ' end, 1), ('segment', case when m % 2 = 0 then 'ACCEPT' else 'REJECT' end, a, 2), ('segment', 'REJECT', case when m % 3 = 0 then a else 'NONE' end, 3), ('region', 'REJECT', case when m = 5 then a end, 4)]) as i from c),
    x as (select distinct k, i[1] as attribute, i[2] as polarity, i[3] as value, i[4] as pos from i where i[3] is not null),
    v as (select k, attribute, value, list_sort(list(pos) filter (polarity = 'ACCEPT')) as a, list_sort(list(pos) filter (polarity = 'REJECT')) as r from x group by all having bool_or(polarity = 'ACCEPT') and bool_or(polarity = 'REJECT'))
    select k as doc_id, attribute, array_to_string(list_sort(list(value)), ',') as values_, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') as accepting, array_to_string(list_sort(list_distinct(flatten(list(r)))), ',') as rejecting from v group by all"""
)
def instruction_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Five clauses for each customer, some of which contradict an earlier one, name another attribute or go on with the last."""
    from tracequarry.operators import evidence

    k = F.col("c_custkey")
    a, b, m = F.upper(F.substring("c_mktsegment", 1, 4)), F.concat(F.lit("r"), F.char(F.lit(97) + F.col("c_nationkey"))), k % 6
    parts = ["The Region shall accept only ", a, " and ", b, ". Continue to reject ", F.when(m < 3, b).otherwise("zz"), "; the segment: ", F.when(m % 2 == 0, "supporting values ").otherwise("disallow "), a, "\nexcluding ", F.when(m % 3 == 0, a).otherwise("none"), F.when(m == 5, F.concat(F.lit(". region deny "), a)).otherwise("")]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    customer = spread(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    attributes = customer.select(k.alias("doc_id"), F.explode(F.array(F.lit("region"), F.lit("segment"), F.lit("other"))).alias("attribute"))
    out = evidence.instruction_conflicts(evidence.value_instructions(customer.select(k.alias("doc_id"), text.alias("text")), attributes))
    return out.select("doc_id", "attribute", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(n) for c, n in (("values", "values_"), ("accepting", "accepting"), ("rejecting", "rejecting"))])
