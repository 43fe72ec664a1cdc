"""Queries on changed lines and conditions, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import lines
from tracequarry.plans.registry import query, table


@query(
    r"""with d as (select doc_id, string_split(regexp_replace(text, '\r\n|[\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) as ls from documents where text is not null and doc_id % 3 > 0),
    l as (select doc_id, case when ls[-1] = '' then ls[1:len(ls) - 1] else ls end as ls from d),
    e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from l),
    c as (select doc_id, '-' as change, line from e where pos % 7 = 3 union all select doc_id, '+', '~ ' || pos || ' ~' from e where pos % 5 = 4)
    select doc_id, change, line, count(*) as n from c group by all"""
)
def line_diff(spark: SparkSession, d: str) -> DataFrame:
    """The new version lacks some lines of the old one and has some that the old one does not have, so what must be found is known."""
    old = table(spark, d, "documents").select("doc_id", "text")
    pieces = F.split("text", lines.BREAKS)
    own = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    edited = F.flatten(F.transform(own, lambda x, i: F.concat(F.when(i % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(x)), F.when(i % 5 == 4, F.array(F.concat(F.lit("~ "), i, F.lit(" ~")))).otherwise(F.array().cast("array<string>")))))
    new = old.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.array_join(edited, "\n")).alias("text"))
    return lines.line_changes(old, new, "doc_id").groupBy("doc_id", "change", "line").agg(F.count("*").alias("n"))


@query(
    """with recursive c as (select l_suppkey * 2 + l_orderkey % 2 as file, l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as line, lower('Qty' || l_returnflag) as lhs, case when l_tax > 0.04 then '>' else '<=' end as operator, (l_quantity::int % 3)::double as number, l_linestatus as s from lineitem where l_quantity > 25),
    r as (select file, lhs, list((line, operator, number) order by line, operator, number) as rs from c where s = 'F' group by all),
    a as (select file, lhs, list((line, operator, number) order by line, operator, number) as ns from c where s = 'O' group by all),
    g as (select file, lhs, list_filter(rs, lambda x: x is not null) as rs, list_filter(ns, lambda x, i: i = 1 or x[1] <> ns[i - 1][1]) as ns from r join a using (file, lhs)),
    w as (select file, lhs, rs, ns, 0 as i, []::bigint[] as used, null::bigint as taken from g
      union all select file, lhs, rs, ns, i + 1, case when t is null then used else used || [t] end, t
      from (select *, list_filter(range(1, len(ns) + 1), lambda j: not list_contains(used, j) and (ns[j][2] <> rs[i + 1][2] or ns[j][3] <> rs[i + 1][3]))[1] as t from w where i < len(rs)))
    select file, lhs, rs[i][1] as old_line, rs[i][2] as old_operator, rs[i][3] as old_number, ns[taken][1] as new_line, ns[taken][2] as new_operator, ns[taken][3] as new_number from w where taken is not null"""
)
def first_unused_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Lines have one left side here; tests have lines with several."""
    rows = table(spark, d, "lineitem").where("l_quantity > 25").select(
        (F.col("l_suppkey") * 2 + F.col("l_orderkey") % 2).alias("file"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("line"), F.lit(0).alias("place"), F.concat(F.lit("Qty"), "l_returnflag").alias("lhs"),
        F.when(F.col("l_tax") > 0.04, ">").otherwise("<=").alias("operator"), (F.col("l_quantity").cast("int") % 3).cast("double").alias("number"), "l_linestatus",
    )
    return lines.unused_pairs(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus = 'O'"))
