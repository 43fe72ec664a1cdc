"""Queries of versions, releases and mappings: orders stand for baselines of their customer, line items for tests and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import mappings, releases, versions
from tracequarry.plans.registry import query, table


@query(
    """with n as (select o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as release_version from orders)
    select o_orderkey, version, release_version from n where year(o_orderdate) >= 1996"""
)
def release_sequences(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    none = orders.select("o_custkey", "o_orderpriority", F.lit(0).alias("version"), F.lit(0).alias("release_version")).where("false")
    step = lambda have, rows: releases.next_sequences(have, rows, "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    before = step(none, orders.where("year(o_orderdate) < 1996"))
    return step(before, orders.where("year(o_orderdate) >= 1996")).select("o_orderkey", "version", "release_version")


@query("select o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) = 1 as is_active from orders")
def active_version(spark: SparkSession, d: str) -> DataFrame:
    return releases.activated(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select("o_orderkey", "is_active")


@query(
    """with v as (select o_custkey, year(o_orderdate) as y, max(o_orderstatus) as p from orders group by all), r as (select *, row_number() over (partition by o_custkey order by y desc) as r from v),
    b as (select o_custkey, max(y) filter (where r = 1) as new_version, max(y) filter (where r = 2) as old_version, max(p) filter (where r = 1) as a, max(p) filter (where r = 2) as b from r where r <= 2 group by 1)
    select o_custkey, new_version, old_version, case when old_version is null then 'INSUFFICIENT' when a = b then 'UNCHANGED' else 'CHANGED' end as status from b"""
)
def latest_two_versions(spark: SparkSession, d: str) -> DataFrame:
    return releases.latest_two(table(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "o_custkey", "y", "o_orderstatus")


@query(
    """with f as (select p_type, p_brand, count(*) as n from part group by all), t as (select p_type, max(n) as n from f group by 1), b as (select f.p_type, count(*) as ties, min(p_brand) as family from f join t using (p_type, n) group by 1),
    v as (select p_type, p_brand, p_size, row_number() over (partition by p_type, p_brand order by p_size desc) as r from (select distinct p_type, p_brand, p_size from part))
    select b.p_type, case when ties = 1 then family end as family, case when ties = 1 then p_size end as version, case when ties > 1 then 'AMBIGUOUS' when p_size is not null then 'FOUND' else 'NOT_FOUND' end as status
    from b left join v on v.p_type = b.p_type and v.p_brand = family and r = 2"""
)
def relative_version(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return releases.relative_version(part, part, "p_type", "p_brand", F.col("p_size"), 1)


@query(
    """with c as (select l_partkey, l_orderkey, case when l_quantity < 49 then l_shipdate end as created from lineitem), g as (select l_partkey, max((created, l_orderkey)) filter (where created is not null) as last, count(*) filter (where created is null) as undated, count(*) as n_candidates from c group by 1)
    select l_partkey, case when undated = 0 then last[2] end as ticket, n_candidates, case when undated = 0 then 'LATEST' else 'RECENCY_NOT_VERIFIED' end as status from g"""
)
def latest_mention(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.when(F.col("l_quantity") < 49, F.col("l_shipdate")).alias("created"))
    return releases.latest_mention(c, "l_partkey", "l_orderkey", "created")


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') as versions, count(*) as n_documents, max(year(o_orderdate))::varchar as latest from orders group by 1")
def family_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("v", F.year("o_orderdate").cast("string"))
    return releases.family_rollup(rows, "o_custkey", "v", F.year("o_orderdate")).select("o_custkey", F.array_join("versions", ",").alias("versions"), "n_documents", "latest")


@query("select o_custkey, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_orderstatus = 'O') as n_o, count(*) filter (where o_orderstatus = 'P') as n_p, count(*) as n from orders group by 1")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return releases.pivoted(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query(
    """with h as (select l_partkey, max(l_suppkey) as active_version, count(distinct l_suppkey) as n_versions from lineitem where l_returnflag = 'A' group by 1), t as (select l_partkey, count(distinct l_orderkey) as n_tests from lineitem where l_returnflag = 'R' group by 1)
    select p_partkey, active_version, coalesce(n_versions, 0) as n_versions, coalesce(n_tests, 0) as n_tests from part left join h on h.l_partkey = p_partkey left join t on t.l_partkey = p_partkey"""
)
def scenario_overview(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    baselines = lines.where("l_returnflag = 'A'").select("p_partkey", F.col("l_suppkey").alias("version"))
    tests = lines.where("l_returnflag = 'R'").select("p_partkey", F.col("l_orderkey").alias("test_id"))
    return releases.scenario_overview(table(spark, d, "part").select("p_partkey"), baselines, tests, "p_partkey")


@query(
    """with s as (select o_orderpriority, o_custkey, count(*) as n_scenarios from orders group by all), w as (select o_orderpriority, o_custkey, md5(max(o_orderstatus)) as f from orders where o_orderstatus < 'P' group by all), n as (select o_orderpriority, o_custkey, md5(max(o_orderstatus)) as f from orders group by all)
    select o_orderpriority, o_custkey, n_scenarios, case when w.f is null then 'NO_BASELINE' when w.f = n.f then 'UNCHANGED' else 'CODE_CHANGED' end as change_status from s left join w using (o_orderpriority, o_custkey) left join n using (o_orderpriority, o_custkey)"""
)
def operation_overview(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    keys = ["o_orderpriority", "o_custkey"]
    prints = lambda df: df.groupBy(*keys).agg(F.md5(F.max("o_orderstatus").cast("binary")).alias("fingerprint"))
    return releases.operation_overview(orders, prints(orders.where("o_orderstatus < 'P'")), prints(orders), keys)


@query(
    """with f as (select source, lang, doc_id::varchar as path, text, case when lang = 'de' then text || '!' else text end as text2 from documents),
    leaf as (select source, lang, 1 as v, sha256(path || chr(0) || sha256(text)) as h from f union all select source, lang, 2, sha256(path || chr(0) || sha256(text2)) from f),
    s as (select source, lang, v, count(*) as n, sum(('0x' || h[1:15])::bigint::hugeint) as a, sum(('0x' || h[16:30])::bigint::hugeint) as b, sum(('0x' || h[31:45])::bigint::hugeint) as c, sum(('0x' || h[46:60])::bigint::hugeint) as e from leaf group by all),
    p as (select source, lang, v, sha256(concat_ws(':', n, a, b, c, e)) as fingerprint from s)
    select x.source, x.lang, x.fingerprint, 1 as version from p x where v = 1 union all
    select y.source, y.lang, y.fingerprint, 2 from p x join p y on x.v = 1 and y.v = 2 and x.source is not distinct from y.source and x.lang is not distinct from y.lang where x.fingerprint <> y.fingerprint"""
)
def fingerprint_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two captures of all documents, the second with texts of one language changed: new versions for changed groups only."""
    files = table(spark, d, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    later = files.withColumn("content", F.when(F.col("lang") == "de", F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    empty = versions.fingerprint(files, ["source", "lang"]).where("false").withColumn("version", F.lit(1))
    first = versions.capture(versions.fingerprint(files, ["source", "lang"]), empty, ["source", "lang"])
    return first.unionByName(versions.capture(versions.fingerprint(later, ["source", "lang"]), first, ["source", "lang"]))


@query(
    """with c as (select l_partkey as k, md5(max(l_returnflag)) as f from lineitem where l_linestatus = 'F' group by 1), w as (select l_partkey as k, md5(max(l_returnflag)) as f from lineitem where l_linestatus = 'O' group by 1)
    select coalesce(c.k, w.k) as l_partkey, sha256('code:' || coalesce(c.f, '') || chr(10) || 'flow:' || coalesce(w.f, '')) as fingerprint from c full join w on c.k = w.k"""
)
def combined_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    prints = lambda s: table(spark, d, "lineitem").where(F.col("l_linestatus") == s).groupBy("l_partkey").agg(F.md5(F.max("l_returnflag").cast("binary")).alias("fingerprint"))
    return releases.combined_fingerprint(prints("F"), prints("O"), ["l_partkey"])


_ITEMS = "select year(o_orderdate) as release, l_partkey as ticket, l_returnflag = 'A' as covered, case when l_returnflag = 'R' and l_quantity > 45 then 'FAILED' else 'PASSED' end as status, case when l_linestatus = 'F' then 'EXPLICIT' else 'INFERRED' end as basis from lineitem join orders on l_orderkey = o_orderkey"


@query(
    f"""with t as (select release, ticket, bool_or(covered) as c, bool_or(status = 'FAILED') as f, bool_or(basis = 'EXPLICIT') as l from ({_ITEMS}) group by all)
    select release, count(*) as n_tickets, count(*) filter (where c) as n_covered, count(*) filter (where not c) as n_gaps, count(*) filter (where f) as n_failed, count(*) filter (where l) as n_linked, count(*) filter (where not l) as n_inferred from t group by 1"""
)
def release_summary(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = lines.select(
        F.year("o_orderdate").alias("release"), F.col("l_partkey").alias("ticket"), (F.col("l_returnflag") == "A").alias("covered"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "FAILED").otherwise("PASSED").alias("status"), F.when(F.col("l_linestatus") == "F", "EXPLICIT").otherwise("INFERRED").alias("basis"),
    )
    return releases.release_summary(items, "release")


@query(
    """with p as (select distinct l_suppkey, l_orderkey, l_linenumber from lineitem) select l_suppkey, md5(string_agg(l_orderkey || '/' || l_linenumber, ',' order by l_orderkey, l_linenumber)) as evidence, count(distinct l_orderkey) as n_tickets, count(distinct l_linenumber) as n_tests from p group by 1"""
)
def endpoint_evidence(spark: SparkSession, d: str) -> DataFrame:
    out = releases.endpoint_evidence(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber")
    told = F.array_join(F.transform("evidence", lambda e: F.concat_ws("/", e["l_orderkey"], e["l_linenumber"])), ",")
    return out.select("l_suppkey", F.md5(told.cast("binary")).alias("evidence"), "n_tickets", "n_tests")


@query(
    """with c as (select l_orderkey, l_suppkey, case l_returnflag when 'A' then 'PASSED' when 'R' then 'FAILED' else 'SKIPPED' end as s from lineitem), t as (select l_orderkey, count(*) as n, count(*) filter (where s = 'PASSED') as n_passed, count(*) filter (where s = 'FAILED') as n_failed, count(*) filter (where s = 'SKIPPED') as n_skipped, count(distinct l_suppkey) as n_classes from c group by 1)
    select *, case when n_failed > 0 then 'FAILED' when n_passed = n then 'PASSED' else 'PARTIAL' end as status from t"""
)
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "PASSED").when(F.col("l_returnflag") == "R", "FAILED").otherwise("SKIPPED")
    return releases.report_totals(table(spark, d, "lineitem").withColumn("s", status), "l_orderkey", "l_suppkey", "s")


@query(
    """with t as (select l_partkey, year(l_shipdate) >= 1996 as side, list_sort(list_distinct(list(l_linenumber % 2))) as a, list_sort(list_distinct(list(l_suppkey % 2))) as b, list_sort(list_distinct(list(l_returnflag))) as c from lineitem where l_quantity > 35 group by all),
    o as (select * from t where not side), n as (select * from t where side), b as (select coalesce(o.l_partkey, n.l_partkey) as l_partkey, o.a is distinct from n.a as tests_changed, o.b is distinct from n.b as tickets_changed, o.c is distinct from n.c as statuses_changed from o full join n on o.l_partkey = n.l_partkey)
    select *, tests_changed or tickets_changed or statuses_changed as changed from b"""
)
def test_summary_changes(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "lineitem").where("l_quantity > 35").select("l_partkey", (F.col("l_linenumber") % 2).alias("test_id"), (F.col("l_suppkey") % 2).alias("ticket"), F.col("l_returnflag").alias("status"), "l_shipdate")
    return releases.test_summary_changes(tests, "l_partkey", F.year("l_shipdate") >= 1996).drop("old", "new")


@query(
    """with b as (select l_partkey as k, l_suppkey % 10 as t, case when l_linestatus = 'F' then 'TEST' else 'RELEASE' end as kind from lineitem), r as (select l_partkey as k, bool_or(l_returnflag = 'R') as failed, bool_and(l_returnflag = 'A') as every, bool_or(l_returnflag = 'A') as any_ from lineitem where l_quantity > 48 group by 1),
    s as (select p_partkey as k, p_partkey % 10 as t from part),
    j as (select s.k, s.t, count(*) filter (where kind = 'TEST' and b.t = s.t) as n_current_tests, count(*) filter (where kind = 'TEST' and b.t <> s.t) as n_historical_tests, count(*) filter (where kind = 'RELEASE' and b.t = s.t) as n_current_releases, count(*) filter (where kind = 'RELEASE' and b.t <> s.t) as n_historical_releases from s left join b on b.k = s.k group by all),
    o as (select j.*, case when failed then 'FAIL' when every then 'PASS' when any_ then 'PARTIAL' else 'NOT_RUN' end as runtime from j left join r on r.k = j.k),
    g as (select *, concat_ws(',', case when n_current_tests = 0 then 'NO_CAPTURED_TEST_BASELINE' end, case when n_current_releases = 0 then 'NO_RELEASE_BASELINE' end, case when runtime <> 'PASS' then 'RUNTIME_NOT_PASSED' end) as gaps from o)
    select *, case when gaps = '' then 'TRACEABILITY_COMPLETE' else 'ACTION_REQUIRED' end as overall from g"""
)
def lifecycle_closure(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    baselines = lines.select(F.col("l_partkey").alias("k"), (F.col("l_suppkey") % 10).alias("t"), F.when(F.col("l_linestatus") == "F", "TEST").otherwise("RELEASE").alias("kind"))
    runs = lines.where("l_quantity > 48").select(F.col("l_partkey").alias("k"), F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "PASSED").otherwise("SKIPPED").alias("status"))
    scenarios = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 10).alias("t"))
    return releases.lifecycle(scenarios, baselines, runs, "k", "t").withColumn("gaps", F.array_join("gaps", ","))


@query(
    """with c as (select o_custkey, o_orderpriority as i, max(o_orderstatus) filter (where year(o_orderdate) < 1996) as a, max(o_orderstatus) filter (where year(o_orderdate) >= 1996) as b from orders group by all),
    y as (select o_custkey, month(o_orderdate)::varchar as i, max(o_orderpriority) filter (where year(o_orderdate) < 1996) as a, max(o_orderpriority) filter (where year(o_orderdate) >= 1996) as b from orders group by all),
    e as (select 'methods' as part, * from c union all select 'files', * from y)
    select o_custkey, """
    + ", ".join(f"count(*) filter (where part = '{p}' and {t}) as {p}_{n}" for p in ("methods", "files") for n, t in (("added", "a is null and b is not null"), ("removed", "a is not null and b is null"), ("changed", "a <> b")))
    + ", bool_or(a is distinct from b) as changed from e group by 1"
)
def baseline_pair_compare(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    late = F.year("o_orderdate") >= 1996

    def part(item, value) -> DataFrame:
        return orders.groupBy("o_custkey", item.alias("item")).agg(F.max(F.when(~late, value)).alias("old"), F.max(F.when(late, value)).alias("new"))

    parts = {"methods": part(F.col("o_orderpriority"), F.col("o_orderstatus")), "files": part(F.month("o_orderdate").cast("string"), F.col("o_orderpriority"))}
    return releases.pair_compare(parts, ["o_custkey"])


@query(
    """with f as (select page_id, split_part(url, '?', 1) as path from pages), s as (select *, regexp_replace(split_part(path, '/', -1), '\\.[A-Za-z0-9]+$', '') as stem from f), i as (select distinct source as k, stem from documents join s on s.page_id = doc_id where source is not null)
    select k, page_id from s join i using (stem)"""
)
def relevant_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("page_id", F.split("url", r"\?")[0].alias("path"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    involved = table(spark, d, "documents").join(files, F.col("doc_id") == F.col("page_id")).where("source is not null").select(F.col("source").alias("k"), stem.alias("class_name"))
    return releases.relevant_files(files, involved, "k").select("k", "page_id")


@query(
    """with a as (select o_custkey, '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' order by o_orderkey, o_orderstatus) || ']' as archive from orders group by 1)
    select o_custkey, sha256(archive) as archive_sha256, o_custkey % 7 > 0 as intact from a"""
)
def archive_verified(spark: SparkSession, d: str) -> DataFrame:
    archive = releases.archived(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"])
    out = releases.verified(archive.withColumn("archive", F.when(F.col("o_custkey") % 7 == 0, F.replace("archive", F.lit("]"), F.lit(",{}]"))).otherwise(F.col("archive"))))  # some were changed since
    return out.select("o_custkey", "archive_sha256", "intact")


@query(
    """with r as (select c_nationkey as s, max((o_orderkey, case when o_orderstatus = 'F' then 'SUCCESS' else 'FAILED' end))[2] as last_status from orders join customer on o_custkey = c_custkey where year(o_orderdate) = 1997 and month(o_orderdate) = 3 group by 1),
    c as (select s_nationkey as s, count(*) as n_records, count(*) filter (where s_acctbal > 0) as n_indexed, count(*) filter (where s_acctbal < 500) as n_out_of_scope from supplier group by 1)
    select n_nationkey, last_status, coalesce(n_records, 0) as n_records, coalesce(n_indexed, 0) as n_indexed, coalesce(n_out_of_scope, 0) as n_out_of_scope,
      case when last_status is null or coalesce(n_records, 0) = 0 then 'NOT_VERIFIED' when last_status = 'SUCCESS' and n_records = n_indexed and n_out_of_scope = 0 then 'VERIFIED' else 'PARTIAL' end as verification
    from nation left join r on r.s = n_nationkey left join c on c.s = n_nationkey"""
)
def source_verification(spark: SparkSession, d: str) -> DataFrame:
    bought = table(spark, d, "orders").where("year(o_orderdate) = 1997 and month(o_orderdate) = 3").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = bought.select(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("status"))
    records = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_acctbal") > 0).alias("indexed"), (F.col("s_acctbal") >= 500).alias("in_scope"))
    return releases.source_verification(table(spark, d, "nation").select("n_nationkey"), runs, records, "n_nationkey")


@query(
    """with k as (select distinct p_brand, p_name from part where p_size > 40), n as (select distinct p_brand, p_name from part except select * from k), c as (select p_brand, p_name, upper(left(p_name, 4)) as stem, row_number() over (partition by upper(left(p_name, 4)) order by p_brand, p_name) as r from n),
    u as (select distinct upper(left(p_name, 4)) as stem from k), x as (select c.*, r + case when u.stem is null then 0 else 1 end as number from c left join u using (stem))
    select p_brand, p_name, case when number = 1 then stem else stem || '_' || number end as code from x"""
)
def registered_operations(spark: SparkSession, d: str) -> DataFrame:
    part, keys = table(spark, d, "part"), ["p_brand", "p_name"]
    code = F.upper(F.substring("p_name", 1, 4))
    known = part.where("p_size > 40").select(*keys).distinct().withColumn("code", code)
    return releases.registered(known, part, keys, code)


@query(
    """with g as (select p_partkey as k, unnest(['NO_CAPTURED_TEST_BASELINE', 'NO_RELEASE_BASELINE']) as gap from part where p_size <= 30), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'A' and l_quantity > 40)
    select k, gap, gap = 'NO_CAPTURED_TEST_BASELINE' and b.k is not null as removed from g left join b using (k)"""
)
def gaps_left(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "part").where("p_size <= 30").select(F.col("p_partkey").alias("k"), F.explode(F.array(F.lit("NO_CAPTURED_TEST_BASELINE"), F.lit("NO_RELEASE_BASELINE"))).alias("gap"))
    captured = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity > 40").select(F.col("l_partkey").alias("k"))
    return releases.gaps_left(gaps, captured, "k")


@query(
    """with e as (select l_suppkey, l_partkey, case l_returnflag when 'A' then 'SCENARIO' when 'R' then 'TEST_BASELINE' else 'LINKED_ID' end as kind from lineitem) select l_suppkey, l_partkey, array_to_string(list_sort(list_distinct(list(kind))), ',') as evidence from e group by all"""
)
def authoritative_links(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    kinds = {"SCENARIO": "A", "TEST_BASELINE": "R", "LINKED_ID": "N"}
    out = releases.authoritative_links({k: lines.where(F.col("l_returnflag") == f) for k, f in kinds.items()}, "l_suppkey", "l_partkey")
    return out.withColumn("evidence", F.array_join("evidence", ","))


# ---- mappings

@query(
    """select l_orderkey, l_linenumber, l_suppkey, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey and year(l_shipdate) = year(o_orderdate) where l_linestatus = 'F' and o_orderstatus = 'F'"""
)
def active_definitions(spark: SparkSession, d: str) -> DataFrame:
    status = lambda c: F.when(F.col(c) == "F", "ACTIVE").otherwise("RETIRED").alias("status")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.year("l_shipdate").alias("scope"), status("l_linestatus"), "l_linenumber", "l_suppkey")
    documents = table(spark, d, "orders").select(F.col("o_orderkey").alias("document"), F.year("o_orderdate").alias("scope"), status("o_orderstatus"), "o_orderpriority")
    out = mappings.active_definitions(rows, documents, "document", "scope")
    return out.select(F.col("document").alias("l_orderkey"), "l_linenumber", "l_suppkey", "o_orderpriority")


@query("select l.doc_id, quality, coalesce(lang, 'UNKNOWN') as lang, coalesce(source, 'UNKNOWN') as source from labels l left join documents d on d.doc_id = l.doc_id + 3")
def parent_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", "quality", (F.col("doc_id") + 3).alias("parent"))
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("parent"), "lang", "source")
    return mappings.with_parent(rows, parents, "parent").drop("parent")


@query(
    """with q as (select item_id as query_id, lower(trim(left(trim(text), 16))) as q from benchmark) select query_id, doc_id, rank from (select query_id, doc_id, row_number() over (partition by query_id order by doc_id)::int as rank from q join documents on contains(lower(concat_ws(chr(1), text, lang, source)), q) where q <> '') where rank <= 250"""
)
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring(F.trim("text"), 1, 16).alias("query"))
    return mappings.substring_search(table(spark, d, "documents"), asked, ["text", "lang", "source"], "doc_id", 1000)


@query(
    """with k as (select 'JSON: $.' || p_brand as path, lower('$.' || p_brand) as k from (select distinct p_brand from part where p_size < 40)), m as (select lower('$.' || p_brand) as k, p_type as target from part where p_size > 10)
    select path, md5(coalesce(array_to_string(list_sort(list_distinct(list(target) filter (where target is not null))), ','), '')) as targets, count(target) as n_rows, case when count(target) > 0 then 'FOUND' else 'NO_MATCH' end as status from k left join m using (k) group by path"""
)
def source_path_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    asked = part.where("p_size < 40").select(F.concat(F.lit("JSON: $."), "p_brand").alias("path"))
    rows = part.where("p_size > 10").select(F.concat(F.lit("jsonpath:$."), "p_brand").alias("path"), F.col("p_type").alias("target"))
    return mappings.by_source_path(asked, rows, "path", "target").withColumn("targets", F.md5(F.array_join("targets", ",").cast("binary")))


@query(
    """select regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as p_brand, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as p_type, array_to_string(list_sort(list_distinct(list(p_size))), ',') as sources, count(*) as n_rows from part group by 1, 2"""
)
def mapping_consolidation(spark: SparkSession, d: str) -> DataFrame:
    return mappings.consolidated(table(spark, d, "part"), ["p_brand", "p_type"], "p_size").withColumn("sources", F.array_join("sources", ","))


@query(
    """with m as (select l_orderkey * 10 + l_linenumber as mapping_id, lower(p_type) as a, case when l_returnflag = 'A' then lower(p_brand) end as o from lineitem join part on l_partkey = p_partkey where l_quantity > 48),
    a as (select s_suppkey, lower(p_type) as a, lower(p_brand) as o from supplier join part on p_partkey = s_suppkey)
    select mapping_id, count(distinct s_suppkey)::int as n_nodes, case when count(s_suppkey) > 0 then 'FOUND' else 'NOT_FOUND' end as status from m left join a on a.a = m.a and (m.o is null or m.o = a.o) group by 1"""
)
def graph_attributes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = table(spark, d, "lineitem").where("l_quantity > 48").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mapping_id"), F.col("p_type").alias("attribute"), F.when(F.col("l_returnflag") == "A", F.col("p_brand")).alias("owner"))
    nodes = table(spark, d, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("node_id"), F.col("p_type").alias("attribute"), F.col("p_brand").alias("owner"))
    return mappings.graph_attribute_counts(rows, nodes)


_ROWS = "select p_size as document_id, p_partkey as row, 'xpath:/' || p_brand as source, p_type as target, case when p_size > 25 then p_name end as attribute from part"


@query(
    f"""with m as ({_ROWS}) select distinct * from (select 'source:' || lower(replace(source, 'xpath:', '')) as source, document_id || '/' || row as target, 'SOURCE_OF' as type, document_id || '/' || row as provenance from m
    union all select document_id || '/' || row, 'target:' || lower(target), 'MAPS_TO', document_id || '/' || row from m union all select document_id || '/' || row, 'document:' || document_id, 'DEFINED_IN', document_id || '/' || row from m
    union all select document_id || '/' || row, 'attribute:' || lower(attribute), 'TARGETS', document_id || '/' || row from m where attribute is not null)"""
)
def mapping_edges(spark: SparkSession, d: str) -> DataFrame:
    return mappings.mapping_edges(_mapping_rows(spark, d))


def _mapping_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_size").alias("document_id"), F.col("p_partkey").alias("row"), F.concat(F.lit("xpath:/"), "p_brand").alias("source"), F.col("p_type").alias("target"),
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("attribute"),
    )


@query(
    """with q as (select distinct '/' || p_brand as source from part where p_size < 49 union select '/none'), m as (select distinct lower('/' || p_brand) as k, lower(p_name || p_size) as t from part where p_size > 9), g as (select distinct lower(p_name || p_size) as t from part where p_size > 46 and p_type = 'PROMO')
    select source, count(m.t) as n_targets, count(g.t) as n_in_graph, case when count(g.t) > 0 then 'FOUND' when count(m.t) > 0 then 'DOCUMENT_ONLY' else 'NO_MATCH' end as status from q left join m on m.k = lower(source) left join g on g.t = m.t group by source"""
)
def mapping_lineage(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    asked = part.where("p_size < 49").select(F.concat(F.lit("/"), "p_brand").alias("source")).unionByName(part.agg(F.lit("/none").alias("source")))
    target = F.concat("p_name", "p_size").alias("target")
    rows = part.where("p_size > 9").select(F.concat(F.lit("xpath:/"), "p_brand").alias("source"), target)
    return mappings.lineage(asked, rows, part.where("p_size > 46 and p_type = 'PROMO'").select(target))


@query(
    """with i as (select distinct p_type as attribute, case when p_size < 25 then 'TARGET_NOT_FOUND' else 'CONFLICTING_RULES' end as issue from part), e as (select distinct p_type from part where p_type < 'N')
    select attribute, case when issue = 'TARGET_NOT_FOUND' and p_type is not null then 'GRAPH_SYNC_MISMATCH' else issue end as issue from i left join e on p_type = attribute"""
)
def quality_reconcile(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    issues = part.select(F.col("p_type").alias("attribute"), F.when(F.col("p_size") < 25, "TARGET_NOT_FOUND").otherwise("CONFLICTING_RULES").alias("issue")).distinct()
    return mappings.reconciled(issues, part.where("p_type < 'N'").select(F.col("p_type").alias("attribute")), "attribute")


@query(
    """with m as (select p_name as attribute, p_brand as family, p_size as version, p_type as rule from part), n as (select family, max(version) as newest from m group by 1), r as (select m.*, version = newest as is_latest from m join n using (family)),
    b as (select attribute, bool_or(is_latest) as latest, count(distinct (family, rule)) filter (where is_latest) as rules, count(distinct family) filter (where is_latest) as families from r group by 1), g as (select distinct p_name as attribute from part where p_name < 'm'), a as (select distinct p_name as attribute from part union select 'none at all')
    select a.attribute, case when latest is null then 'NONE' when not latest then 'HISTORICAL_ONLY' when rules > families then 'CONFLICTING' when g.attribute is null then 'TARGET_MISSING' else 'LATEST' end as evidence from a left join b using (attribute) left join g using (attribute)"""
)
def mapping_evidence_class(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.select(F.col("p_name").alias("attribute"), F.col("p_brand").alias("family"), F.col("p_size").alias("version"), F.col("p_type").alias("rule"))
    asked = rows.select("attribute").unionByName(part.agg(F.lit("none at all").alias("attribute")))
    return mappings.evidence_class(asked, rows, part.where("p_name < 'm'").select(F.col("p_name").alias("attribute")))


@query("select l_partkey, l_suppkey, count(distinct (l_returnflag, l_linestatus)) as variants from lineitem group by all having count(distinct (l_returnflag, l_linestatus)) > 1")
def definition_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return versions.conflicts(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])
