"""Queries on the lineage of attributes, bound to the given tables as if these told of classes, calls and mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import lineage
from tracequarry.plans.registry import query, table

_MARKS = {"ECONOMY": ["Entity"], "PROMO": ["RestController"], "LARGE": ["Service", "Component"], "SMALL": ["Mapper", "Component"], "MEDIUM": ["Component"]}


def _named(prefix: str, number, name: str):
    return F.concat(F.lit(prefix), number).alias(name)


@query(
    f"""with recursive c as (select 'P' || p_partkey as c, p_type as t, p_size = 7 as repo from part),
    own as (select c, unnest(case t {" ".join(f"when '{t}' then {[r for r in {'ECONOMY': ['ENTITY'], 'PROMO': ['CONTROLLER'], 'LARGE': ['SERVICE', 'COMPONENT'], 'SMALL': ['MAPPER'], 'MEDIUM': ['COMPONENT']}[t]]}" for t in _MARKS)} else [] end) as role from c union select c, 'REPOSITORY' from c where repo),
    sig as (select 'P' || l_partkey as c, 'P' || (l_partkey * 3 + 1) as body, 'P' || (l_partkey + 7) as ret from lineitem where l_quantity = 50 and l_linenumber < 3),
    m as (select body as c, 'REQUEST_MODEL' as role from sig where c in (select c from own where role = 'CONTROLLER') union select ret, 'RESPONSE_MODEL' from sig where c in (select c from own where role = 'CONTROLLER')),
    f as (select distinct 'P' || l_partkey as a, 'P' || ((l_partkey * 31 + l_suppkey) % (select count(*) + 50 from part)) as b from lineitem where l_linenumber = 1 and l_tax = 0.08),
    e as (select a, b from f where b in (select c from c)),
    r(c, role, seed, depth) as (select c, role, c, 0 from m where c in (select c from c) union select b, role, seed, depth + 1 from r join e on a = c where depth < 15),
    n as (select c, role, arg_min(seed, (depth, seed)) as seed, min(depth) as depth from r group by all),
    every as (select c, role, c as seed, 0 as depth from own union all from n)
    select c as class_name, role, seed, depth::int as depth from every union all select c, 'JAVA_CLASS', c, 0 from c where c not in (select c from every)"""
)
def class_roles(spark: SparkSession, d: str) -> DataFrame:
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    marks = F.array().cast("array<string>")
    for kind, names in _MARKS.items():
        marks = F.when(F.col("p_type") == kind, F.array(*map(F.lit, names))).otherwise(marks)
    classes = part.select(_named("P", "p_partkey", "class_name"), marks.alias("annotations"), F.when(F.col("p_size") == 7, F.array(F.lit("JpaRepository"))).alias("bases"))
    signatures = lines.where("l_quantity = 50 and l_linenumber < 3").select(_named("P", "l_partkey", "class_name"), F.array(_named("P", F.col("l_partkey") * 3 + 1, "b")).alias("body_types"), F.array(F.lit("List"), _named("P", F.col("l_partkey") + 7, "r")).alias("return_types"))
    fields = lines.where("l_linenumber = 1 and l_tax = 0.08").select(_named("P", "l_partkey", "class_name"), _named("P", (F.col("l_partkey") * 31 + F.col("l_suppkey")) % (part.count() + 50), "type"))
    return lineage.class_roles(classes, signatures, fields)


_CONTRACT = """maps as (select 'Obj.attr' || (p_size % 12) as target, case when p_partkey % 3 = 0 then 'TRIM it' else 'copy' end as rule from part where p_size % 4 > 0),
    wanted as (select distinct 'attr' || (split_part(target, '.attr', 2)) as a from maps where rule = 'TRIM it'),
    sets as (select distinct 'S' || l_suppkey as c, 'm' || (l_partkey % 20) as m, 'Attr' || (l_partkey % 12) as attribute, case l_returnflag when 'R' then 'row.get().trim()' when 'A' then 'this.help' || (l_partkey % 5) || '(row)' else 'row' end as expression, 'f' || l_suppkey as file, l_orderkey as line from lineitem where l_linenumber = 7 and l_quantity > 40),
    helps as (select 'S' || l_suppkey as c, 'help' || (l_partkey % 5) as m, count(*) = 1 as one, bool_or(l_tax > 0.04) as trims from lineitem where l_linenumber = 6 and l_quantity > 47 group by all),
    checks as (select attribute, s.c || '.' || s.m as method, expression, case when contains(expression, '.trim(') then 'LOCAL_TRIM_PRESENT' when one and trims and expression = 'this.' || h.m || '(row)' then 'HELPER_TRIM_PRESENT_CANDIDATE' else 'POTENTIAL_MISMATCH_NO_LOCAL_TRIM' end as status, file, line
      from sets s left join helps h on s.c = h.c and expression = 'this.' || h.m || '(row)' where lower(attribute) in (from wanted))"""


def _contract(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    l = F.col  # noqa: E741
    supplier = _named("S", "l_suppkey", "class_name")
    rule = F.when(F.col("p_partkey") % 3 == 0, "TRIM it").otherwise("copy")
    expression = F.when(l("l_returnflag") == "R", "row.get().trim()").when(l("l_returnflag") == "A", F.concat(F.lit("this.help"), l("l_partkey") % 5, F.lit("(row)"))).otherwise("row")
    caller = F.concat(F.lit("S"), "l_suppkey", F.lit("."), F.when(l("l_partkey") % 4 == 0, _named("updateAttr", l("l_partkey") % 12, "u")).otherwise(_named("m", l("l_partkey") % 20, "m")))
    method = F.concat(F.lit("S"), "l_suppkey", F.lit("."), F.when(l("l_partkey") % 3 == 0, _named("updateAttr", l("l_partkey") % 12, "u")).otherwise(_named("m", l("l_partkey") % 20, "m")))
    return {
        "mappings": part.where("p_size % 4 > 0").select(_named("Obj.attr", F.col("p_size") % 12, "target"), rule.alias("mapping_rule"), F.lit(None).cast("string").alias("validation_rule")),
        "setters": lines.where("l_linenumber = 7 and l_quantity > 40").select(supplier, _named("m", l("l_partkey") % 20, "method"), _named("Attr", l("l_partkey") % 12, "attribute"), expression.alias("expression"), _named("f", "l_suppkey", "file"), l("l_orderkey").alias("line")),
        "methods": lines.where("l_linenumber = 6 and l_quantity > 47").select(supplier, _named("help", l("l_partkey") % 5, "method"), (l("l_tax") > 0.04).alias("trims")),
        "calls": lines.where("l_linenumber < 4 and l_quantity > 30").select(caller.alias("caller"), F.when(l("l_tax") > 0, _named("S", l("l_orderkey") % 100, "r")).alias("receiver_type"), _named("m", l("l_orderkey") % 20, "name"), _named("f", "l_suppkey", "file"), l("l_orderkey").alias("line")),
        "endpoints": lines.where("l_linenumber = 5 and l_quantity > 35").select(method.alias("method"), F.lit("GET").alias("http_method"), _named("/c/", l("l_suppkey"), "endpoint")),
        "observed": lines.where("l_linenumber = 4 and l_quantity > 25").select(_named("Attr", l("l_partkey") % 12, "attribute"), method.alias("method"), _named("f", "l_suppkey", "file"), l("l_orderkey").alias("line")),
        "scenarios": table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(_named("SC", "s_suppkey", "scenario"), F.lit("get").alias("http_method"), F.concat(F.lit("C/"), "s_suppkey", F.lit("/")).alias("endpoint")),
    }


@query(f"with {_CONTRACT} select * from checks")
def contract_checks(spark: SparkSession, d: str) -> DataFrame:
    t = _contract(spark, d)
    return lineage.contract_checks(t["mappings"], t["setters"], t["methods"])


_U = lambda k: f"'S' || l_suppkey || '.' || case when l_partkey % {k} = 0 then 'updateAttr' || (l_partkey % 12) else 'm' || (l_partkey % 20) end"
_PATHS = f"""{_CONTRACT},
    typed as (select {_U(4)} as caller, 'S' || (l_orderkey % 100) || '.m' || (l_orderkey % 20) as callee, min(('f' || l_suppkey, l_orderkey)) as plc from lineitem where l_linenumber < 4 and l_quantity > 30 and l_tax > 0 group by 1, 2 having caller <> callee),
    seeds as (select distinct attribute, method from checks),
    ends as (select distinct {_U(3)} as method, '/c/' || l_suppkey as endpoint from lineitem where l_linenumber = 5 and l_quantity > 35),
    observed as (select distinct 'Attr' || (l_partkey % 12) as attribute, {_U(3)} as method, 'f' || l_suppkey as file, l_orderkey as line from lineitem where l_linenumber = 4 and l_quantity > 25),
    one as (select attribute, [caller, method] as chain, plc from seeds join typed on callee = method where split_part(caller, '.', 1) <> split_part(method, '.', 1)),
    two as (select attribute, [caller] || chain as chain, one.plc from one join typed on callee = chain[1] where not list_contains(chain, caller)),
    ways as (from one union all from two),
    kept as (select attribute, chain, endpoint, plc from ways join ends on method = chain[1]
      where len(list_filter(chain[1:len(chain) - 1], lambda m: contains(m, '.updateAttr') and lower(split_part(m, '.update', 2)) <> lower(attribute))) = 0),
    lone as (select attribute, chain, plc from one where exists (select 1 from observed o where o.attribute = one.attribute and o.method = chain[1]) and not exists (select 1 from kept k where k.attribute = one.attribute and k.chain[len(k.chain) - 1:] = one.chain)),
    paths as (select attribute, chain, 'GET' as http_method, endpoint, plc[1] as file, plc[2] as line from kept union all select attribute, chain, null, null, plc[1], plc[2] from lone)"""


@query(f"with {_PATHS} select * from paths")
def contract_paths(spark: SparkSession, d: str) -> DataFrame:
    t = _contract(spark, d)
    checks = lineage.contract_checks(t["mappings"], t["setters"], t["methods"])
    return lineage.contract_paths(checks, t["calls"], t["endpoints"], t["observed"])


@query(
    f"""with {_PATHS}, ended as (select distinct endpoint, chain[1] as m from paths where endpoint is not null)
    select 'attribute:' || attribute as source, 'method:' || method as target, 'SOURCE_REFERENCE_ONLY' as status, file, line from observed
    union all select distinct 'method:' || s[1], 'method:' || s[2], 'LEXICAL_NOT_TYPE_RESOLVED', null, null::bigint from (select unnest(list_zip(chain[1:len(chain) - 1], chain[2:])) as s from paths)
    union all select 'api:GET ' || endpoint, 'method:' || m, 'ENDPOINT_SOURCE_CANDIDATE', null, null from ended
    union all select distinct 'api:GET ' || endpoint, 'scenario:SC' || s_suppkey, 'ENDPOINT_MATCH_ONLY', null, null from ended join supplier on endpoint = '/c/' || s_suppkey and s_suppkey % 3 = 0"""
)
def contract_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _contract(spark, d)
    paths = lineage.contract_paths(lineage.contract_checks(t["mappings"], t["setters"], t["methods"]), t["calls"], t["endpoints"], t["observed"])
    return lineage.contract_edges(t["observed"], paths, t["scenarios"])


_VERSIONS = """side as (select p_brand as family, p_name as attribute, 'Obj' || (p_size % 4) || '.' || replace(p_name, ' ', '') || (p_size % 3) as target, p_type as rule, p_size from part where p_size % 10 < 8),
    o as (select family, lower(target) as t, max((rule, target, attribute)) as o from side where p_size <= 30 group by all), n as (select family, lower(target) as t, max((rule, target, attribute)) as n from side where p_size > 20 group by all),
    b as (select coalesce(o.family, n.family) as family, coalesce(n[3], o[3]) as attribute, case when o is null then 'ADDED' when n is null then 'REMOVED' when o[1] = n[1] then 'UNCHANGED' else 'CHANGED' end as status, o[2] as old_target, n[2] as new_target from o full join n on o.family = n.family and o.t = n.t),
    g as (select family, attribute, max(old_target) filter (status = 'REMOVED') as f, max(new_target) filter (status = 'ADDED') as t from b group by all having count(*) filter (status = 'REMOVED') = 1 and count(*) filter (status = 'ADDED') = 1),
    changes as (select family, attribute, case when f is not null and status = 'ADDED' then 'RENAMED' else status end as status, case when f is not null and status = 'ADDED' then f else old_target end as old_target, new_target from b left join g using (family, attribute) where not (f is not null and status = 'REMOVED'))"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    target = F.concat(F.lit("Obj"), F.col("p_size") % 4, F.lit("."), F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size") % 3)
    side = table(spark, d, "part").where("p_size % 10 < 8").select(F.col("p_brand").alias("family"), F.col("p_name").alias("attribute"), target.alias("target"), F.col("p_type").alias("rule"), "p_size")
    return lineage.mapping_changes(side.where("p_size <= 30"), side.where("p_size > 20"))


@query(f"with {_VERSIONS} select * from changes")
def mapping_renames(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d)


@query(
    f"""with recursive {_VERSIONS}, nodes as (select 'n' || p_partkey as id, replace(p_name, ' ', '') || (p_size % 3) as name from part where p_size % 7 = 0 and p_type = 'PROMO'),
    e as (select distinct 'm' || l_suppkey as s, 'n' || l_partkey as t, 'READS' as y from lineitem where l_linenumber = 1 union select distinct 'm' || l_suppkey, 'm' || (l_partkey % 100), 'CALLS' from lineitem where l_linenumber = 2 and l_quantity = 50 and l_tax > 0.05
      union select distinct 'e' || (l_partkey % 50), 'm' || l_suppkey, 'INVOKES' from lineitem where l_linenumber = 3 and l_quantity = 50 union select 'm' || s_suppkey, 's' || s_nationkey, 'BELONGS_TO' from supplier),
    ch as (select * from changes where status <> 'UNCHANGED'), targets as (select distinct family, unnest([old_target, new_target]) as target from ch), tt as (select * from targets where target is not null),
    placed as (select family, target, id as seed from tt join nodes on lower(name) = lower(split_part(target, '.', 2))),
    a(seed, node, depth) as (select distinct seed, seed, 0 from placed union select seed, e.s, depth + 1 from a join e on e.t = node and y in ('READS', 'CALLS', 'INVOKES') where depth < 3), am as (select seed, node, min(depth) as depth from a group by all),
    bu as (select am.seed, e.t as node, min(am.depth + 1) as depth from am join e on e.s = am.node and y = 'BELONGS_TO' group by all),
    reached as (select seed, 'CALLERS' as kind, node, depth from am where depth > 0 union all select seed, 'BUSINESS', node, depth from bu)
    select family, 'RENAME' as kind, old_target as target, new_target as other, null::bigint as depth from ch where status = 'RENAMED'
    union all select family, kind, target, node, min(depth)::bigint from placed join reached using (seed) group by all
    union all select distinct family, 'TARGET_NOT_FOUND_IN_CODE', new_target, 'HIGH', null from ch where new_target is not null and lower(split_part(new_target, '.', 2)) not in (select lower(name) from nodes)
    union all select family, 'REMOVED_MAPPING', null, 'MEDIUM', count(*) from ch where status = 'REMOVED' group by family"""
)
def mapping_change_impact(spark: SparkSession, d: str) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    nodes = part.where("p_size % 7 = 0 and p_type = 'PROMO'").select(_named("n", "p_partkey", "id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size") % 3).alias("name"))
    link = lambda df, a, b, kind: df.select(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    method = _named("m", "l_suppkey", "m")
    edges = link(lines.where("l_linenumber = 1"), method, _named("n", "l_partkey", "n"), "READS")
    edges = edges.unionByName(link(lines.where("l_linenumber = 2 and l_quantity = 50 and l_tax > 0.05"), method, _named("m", F.col("l_partkey") % 100, "n"), "CALLS"))
    edges = edges.unionByName(link(lines.where("l_linenumber = 3 and l_quantity = 50"), _named("e", F.col("l_partkey") % 50, "e"), method, "INVOKES"))
    edges = edges.unionByName(link(table(spark, d, "supplier"), _named("m", "s_suppkey", "m"), _named("s", "s_nationkey", "s"), "BELONGS_TO"))
    return lineage.mapping_change_impact(_versions(spark, d), nodes, edges, ["READS", "CALLS", "INVOKES"], ["BELONGS_TO"], up=3, down=1)
