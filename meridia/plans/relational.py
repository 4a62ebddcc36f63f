"""Queries over the star schema that show the generic relational surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import load


def money(c):
    return c.cast("decimal(18,4)")


def queries():
    t = load
    line = lambda s, d: t(s, d, "lineitem").withColumn("net", money(F.col("l_extendedprice")) * (1 - money(F.col("l_discount"))))

    def join_agg(s, d):
        o = t(s, d, "orders").filter("o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1996-01-01'").select("o_orderkey", "o_custkey")
        j = line(s, d).select("l_orderkey", "l_suppkey", "net").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        j = j.join(t(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(s, d, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        return j.groupBy("r_name", "n_name").agg(F.round(F.sum("net").cast("double"), 2).alias("revenue"), F.count("*").alias("lines"))

    def semi_anti(s, d):
        c, o = t(s, d, "customer").select("c_custkey", "c_mktsegment"), t(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
        got = c.join(o, "c_custkey", "left_semi").withColumn("has", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has", F.lit(False)))
        return got.groupBy("c_mktsegment", "has").agg(F.count("*").alias("customers"))

    def cube(s, d):
        c = line(s, d).cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("net").cast("double"), 2).alias("net"), F.grouping_id().cast("int").alias("level"))
        return c.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "net", "level")

    def setops(s, d):
        a, b = t(s, d, "part").filter("p_size > 20").select("p_partkey"), t(s, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
        return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b.distinct()).withColumn("side", F.lit("first")))

    def top(s, d):
        return t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")

    def ranking(s, d):
        w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
        return t(s, d, "customer").select("c_custkey", F.rank().over(w).alias("rank"), F.ntile(4).over(w).alias("quarter"), F.round(F.sum(money(F.col("c_acctbal"))).over(w).cast("double"), 2).alias("upto")).filter("rank <= 20")

    def as_of(s, d):
        """For each purchase the user's last earlier event of another kind: the left rows are marked in one ordered union, no pairs are made."""
        e = t(s, d, "events").select("user_id", "ts", "event_id", "event_type")
        w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.last(F.when(F.col("event_type") != "purchase", F.col("event_id")), ignorenulls=True).over(w)
        return e.withColumn("before", seen).filter("event_type = 'purchase'").select("event_id", F.coalesce("before", F.lit(-1)).alias("before"))

    def sessions(s, d):
        e = t(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
        return e.select("user_id", F.col("w.start").alias("start"), "events")

    return {"tpch_join_agg": join_agg, "semi_anti_customers": semi_anti, "cube_rollup_sales": cube, "setops_parts": setops, "topk_orders": top, "window_ranking": ranking, "asof_events": as_of, "session_counts": sessions}


def oracle_sql():
    net = "cast(l_extendedprice as decimal(18,4)) * (1 - cast(l_discount as decimal(18,4)))"
    return {
        "tpch_join_agg": f"select r_name, n_name, round(cast(sum({net}) as double), 2) as revenue, count(*) as lines from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01' group by all",
        "semi_anti_customers": "select c_mktsegment, exists (select 1 from orders where o_custkey = c_custkey) as has, count(*) as customers from customer group by all",
        "cube_rollup_sales": f"select coalesce(l_returnflag, 'all') as flag, coalesce(l_linestatus, 'all') as status, round(cast(sum({net}) as double), 2) as net, cast(grouping(l_returnflag, l_linestatus) as int) as level from lineitem group by cube (l_returnflag, l_linestatus)",
        "setops_parts": "with a as (select p_partkey from part where p_size > 20), b as (select l_partkey from lineitem where l_quantity > 45) select p_partkey, case when p_partkey in (select l_partkey from b) then 'both' else 'first' end as side from a",
        "topk_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100",
        "window_ranking": "select * from (select c_custkey, rank() over w as rank, ntile(4) over w as quarter, round(cast(sum(cast(c_acctbal as decimal(18,4))) over w as double), 2) as upto from customer window w as (partition by c_nationkey order by c_acctbal desc, c_custkey)) where rank <= 20",
        "asof_events": "select event_id, coalesce((select arg_max(b.event_id, (b.ts, b.event_id)) from events b where b.user_id = a.user_id and b.event_type <> 'purchase' and (b.ts, b.event_id) < (a.ts, a.event_id)), -1) as before from events a where event_type = 'purchase'",
        "session_counts": "with a as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 else 0 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts) as k from a) select user_id, min(ts) as start, count(*) as events from b group by user_id, k",
    }
