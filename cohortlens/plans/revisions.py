"""The query of a revision's invariance: 23 comparisons of tables with changed copies of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import invariance
from cohortlens.plans.catalog import query, table

#: Table, key, a number, and the remainder modulo 1009 of keys that the copy loses (-1: none).
EXACT = (("region", "r_regionkey", -1), ("nation", "n_nationkey", 3), ("customer", "c_custkey", 5), ("supplier", "s_suppkey", -1), ("part", "p_partkey", 7), ("orders", "o_orderkey", 2), ("events", "event_id", 11), ("pages", "page_id", -1))
CLOSE = (("customer", "c_custkey", "c_acctbal", 1e-12), ("supplier", "s_suppkey", "s_acctbal", 1e-6), ("part", "p_partkey", "p_retailprice", 1e-12), ("orders", "o_orderkey", "o_totalprice", 1e-6), ("events", "event_id", "value", 1e-12), ("documents", "doc_id", "n_chars", 0.5))
PARTS = (("customer", "c_custkey", "c_mktsegment"), ("orders", "o_orderkey", "o_orderpriority"), ("documents", "doc_id", "lang"), ("events", "event_id", "event_type"), ("part", "p_partkey", "p_brand"))
JSONS = ("same", "reordered", "changed", "ignored")


def _sql() -> str:
    out = []
    for t, k, gone in EXACT:
        out.append(f"select '{t}' as artifact, 'rows' as method, case when l = 0 then 'PASS' else 'FAIL' end as status, 'rows=' || n || ', only left=' || l || ', only right=0' as detail from (select count(*) as n, count(*) filter ({k} % 1009 = {gone}) as l from {t})")
    for t, k, v, tolerance in CLOSE:
        other = f"{v} * (1 + 1e-9 * ({k} % 3))"
        out.append(f"select '{t}.{v}', 'close', case when o = 0 then 'PASS' else 'FAIL' end, 'keys=' || n || ', unmatched=0, {v}=' || o from (select count(*) as n, count(*) filter (abs({v} - {other}) > {tolerance!r}::double * greatest(1, abs({v}), abs({other}))) as o from {t})")
    for t, k, c in PARTS:
        b = f"case when {k} % 1013 = 4 then 'moved' else md5({c}) end"
        out.append(f"""select '{t}.{c}', 'partition', case when moved = 0 then 'PASS' else 'FAIL' end, 'members=' || n || ', unmatched=0, moved=' || moved || ', clusters=' || ca || '/' || cb from (
  select count(*) as n, count(*) filter (la <> lb or sa <> sb) as moved, count(distinct la) as ca, count(distinct lb) as cb from (
    select min({k}::varchar) over (partition by {c}) as la, count(*) over (partition by {c}) as sa, min({k}::varchar) over (partition by {b}) as lb, count(*) over (partition by {b}) as sb from {t}))""")
    for kind in JSONS:
        n, x = ("count(*) filter (event_id % 5 = 0)", "count(*) filter (event_id % 5 = 0)") if kind == "changed" else ("count(*) filter (false)", "count(*) filter (false)")
        out.append(f"select 'events.{kind}', 'json', case when {n} = 0 then 'PASS' else 'FAIL' end, 'texts=' || {n} || ', only left=0, only right=0, other values=' || {x} from events")
    return " union all ".join(out)


@query(_sql())
def invariance_report(spark, sf):
    """Exact rows, numbers within a tolerance, partitions under other names, JSON leaf by leaf: a row each."""
    items = []
    for t, k, gone in EXACT:
        a = table(spark, sf, t)
        items.append(invariance.compare_rows(t, a, a.where(F.col(k) % 1009 != gone).withColumn("note", F.lit("x")), ("note",)))
    for t, k, v, tolerance in CLOSE:
        a = table(spark, sf, t, k, v)
        items.append(invariance.compare_close(f"{t}.{v}", a, a.withColumn(v, F.col(v) * (1 + 1e-9 * (F.col(k) % 3))), [k], [v], tolerance))
    for t, k, c in PARTS:
        a = table(spark, sf, t, k, c)
        items.append(invariance.compare_partition(f"{t}.{c}", a, a.withColumn(c, F.when(F.col(k) % 1013 == 4, "moved").otherwise(F.md5(F.col(c)))), k, c))
    e = table(spark, sf, "events", "event_id", "event_type", "value")
    text = lambda value, *more: F.to_json(F.struct(*more, F.struct(value.alias("v"), F.array(F.lit(1), F.lit(2)).alias("l")).alias("in")))
    kind, at = F.col("event_type").alias("kind"), F.col("event_id").alias("at")
    sides = {
        "same": (text(F.col("value"), kind), text(F.col("value"), kind)), "reordered": (text(F.col("value"), kind, at), text(F.col("value"), at, kind)),
        "changed": (text(F.col("event_id"), kind), text(F.when(F.col("event_id") % 5 == 0, -1).otherwise(F.col("event_id")), kind)), "ignored": (text(F.col("value"), kind, at), text(F.col("value"), kind, (F.col("event_id") + 1).alias("at"))),
    }
    for name in JSONS:
        a, b = (e.select("event_id", s.alias("json")) for s in sides[name])
        items.append(invariance.compare_json(f"events.{name}", a, b, "event_id", "json", ("at",) if name == "ignored" else ()))
    return invariance.report(items)
