"""Aggregation and description."""

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright import operators as op

from .registry import query, rounded


@query("""
select n_name as nation, year(o_orderdate)::int as order_year,
       round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, count(*) as items
from lineitem join orders on l_orderkey = o_orderkey
     join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where l_returnflag <> 'R'
group by all order by nation, order_year
""")
def flagship_revenue(t):
    lines = op.filter_value(t.lineitem, "l_returnflag", "!=", "R")
    lines = op.derive(lines, {"revenue": F.col("l_extendedprice") * (1 - F.col("l_discount"))})
    joined = op.join(lines, t.orders, [("l_orderkey", "o_orderkey")])
    joined = op.join(joined, t.customer, [("o_custkey", "c_custkey")])
    joined = op.join(joined, t.nation, [("c_nationkey", "n_nationkey")])
    keyed = op.derive(joined, {"nation": F.col("n_name"), "order_year": fn.year("o_orderdate")})
    out = op.aggregate(keyed, {"revenue": ("sum", "revenue"), "items": "count"}, ["nation", "order_year"])
    return op.sort(rounded(out, 4, "revenue"), ["nation", "order_year"])


@query("""
select l_returnflag,
  count(*) as n, count(l_quantity) as n_valid, count(*) - count(l_quantity) as n_invalid,
  count(distinct l_linenumber) as n_distinct,
  round(sum(l_quantity), 2) as s, round(avg(l_extendedprice), 4) as m,
  min(l_extendedprice) as lo, max(l_extendedprice) as hi,
  round(quantile_cont(l_extendedprice, 0.5), 4) as med,
  round(stddev_samp(l_extendedprice), 4) as sd, round(var_samp(l_quantity), 4) as va,
  round(stddev_pop(l_extendedprice), 4) as sdp, round(var_pop(l_quantity), 4) as vap
from lineitem group by l_returnflag
""")
def agg_all_functions(t):
    out = op.aggregate(
        t.lineitem,
        {
            "n": "count", "n_valid": ("valid", "l_quantity"), "n_invalid": ("invalid", "l_quantity"),
            "n_distinct": ("distinct", "l_linenumber"), "s": ("sum", "l_quantity"), "m": ("mean", "l_extendedprice"),
            "lo": ("min", "l_extendedprice"), "hi": ("max", "l_extendedprice"), "med": ("median", "l_extendedprice"),
            "sd": ("stdev", "l_extendedprice"), "va": ("variance", "l_quantity"), "sdp": ("stdevp", "l_extendedprice"),
            "vap": ("variancep", "l_quantity"),
        },
        ["l_returnflag"],
    )
    return rounded(out, 4, "s", "m", "med", "sd", "va", "sdp", "vap")


@query("""
select count(*) as n, round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 4) as m,
  min(o_orderdate) as first_day, max(o_orderdate) as last_day, count(distinct o_custkey) as customers,
  round(quantile_cont(o_totalprice, 0.5), 4) as med
from orders
""")
def agg_whole_table(t):
    out = op.aggregate(
        t.orders,
        {
            "n": "count", "s": ("sum", "o_totalprice"), "m": ("average", "o_totalprice"),
            "first_day": ("min", "o_orderdate"), "last_day": ("max", "o_orderdate"),
            "customers": ("distinct", "o_custkey"), "med": ("median", "o_totalprice"),
        },
    )
    return rounded(rounded(out, 2, "s"), 4, "m", "med")


@query("""
with o as (select nullif(o_orderstatus, 'P') as status, case when o_totalprice > 100000 then o_orderpriority end as priority, o_totalprice from orders)
select status, count(*) as n, count(priority) as n_valid, count(*) - count(priority) as n_invalid,
  count(distinct priority) + max(case when priority is null then 1 else 0 end) as n_distinct,
  round(sum(o_totalprice), 2) as s
from o group by status
""")
def agg_null_groups(t):
    o = t.orders.select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("priority"),
        "o_totalprice",
    )
    out = op.aggregate(
        o,
        {
            "n": "count", "n_valid": ("valid", "priority"), "n_invalid": ("invalid", "priority"),
            "n_distinct": ("distinct", "priority"), "s": ("sum", "o_totalprice"),
        },
        ["status"],
    )
    return rounded(out, 2, "s")


@query("""
select user_id, arg_min(event_type, (ts, event_id)) as first_type, arg_max(event_type, (ts, event_id)) as last_type,
  arg_max(value, (ts, event_id)) as last_value
from events group by user_id
""")
def agg_first_last(t):
    return op.aggregate(
        t.events,
        {"first_type": ("first", "event_type"), "last_type": ("last", "event_type"), "last_value": ("last", "value")},
        ["user_id"],
        order_by=["ts", "event_id"],
    )


@query("""
with c as (select l_shipdate, l_quantity, count(*) as n from lineitem group by all),
r as (select *, row_number() over (partition by l_shipdate order by n desc, l_quantity) as k from c)
select l_shipdate, l_quantity as mode_quantity from r where k = 1
""")
def agg_mode(t):
    return op.aggregate(t.lineitem, {"mode_quantity": ("mode", "l_quantity")}, ["l_shipdate"])


@query("""
select o_custkey, round(product(1 + o_totalprice / 1000000), 6) as growth from orders group by o_custkey
""")
def agg_product(t):
    rated = op.derive(t.orders, {"rate": 1 + F.col("o_totalprice") / 1000000})
    return rounded(op.aggregate(rated, {"growth": ("product", "rate")}, ["o_custkey"]), 6, "growth")


@query("""
select c_nationkey, min(c_mktsegment) is not null as has_segment, count(*) as n from customer group by c_nationkey
""")
def agg_any(t):
    out = op.aggregate(t.customer, {"segment": ("any", "c_mktsegment"), "n": "count"}, ["c_nationkey"])
    return out.select("c_nationkey", F.col("segment").isNotNull().alias("has_segment"), "n")


@query("""
select user_id, array_to_string(list(event_type order by event_id), '>') as path,
  array_to_string(list_sort(list_distinct(list(event_type))), '|') as kinds
from events group by user_id
""")
def agg_arrays(t):
    out = op.aggregate(
        t.events,
        {"path": ("array_agg", "event_type"), "kinds": ("array_agg_distinct", "event_type")},
        ["user_id"],
        order_by="event_id",
    )
    return out.withColumns({"path": F.array_join("path", ">"), "kinds": F.array_join("kinds", "|")})


@query("""
with s as (
  select count(p_size) as c1, count(distinct p_size) as u1, avg(p_size) as m1, quantile_cont(p_size, 0.5) as d1,
    stddev_samp(p_size) as s1, min(p_size) as lo1, max(p_size) as hi1,
    count(p_retailprice) as c2, count(distinct p_retailprice) as u2, avg(p_retailprice) as m2,
    quantile_cont(p_retailprice, 0.5) as d2, stddev_samp(p_retailprice) as s2, min(p_retailprice) as lo2,
    max(p_retailprice) as hi2, count(p_type) as c3, count(distinct p_type) as u3 from part),
t as (select p_type as top, count(*) as freq from part group by p_type order by freq desc, top limit 1)
select 'count' as statistic, round(c1, 4) as p_size, round(c2, 4) as p_retailprice, c3::varchar as p_type from s
union all select 'unique', u1, u2, u3::varchar from s
union all select 'top', null, null, top from t union all select 'freq', null, null, freq::varchar from t
union all select 'mean', round(m1, 4), round(m2, 4), null from s
union all select 'median', round(d1, 4), round(d2, 4), null from s
union all select 'stdev', round(s1, 4), round(s2, 4), null from s
union all select 'min', lo1, lo2, null from s union all select 'max', hi1, hi2, null from s
""")
def describe_part(t):
    out = op.describe(t.part, ["p_size", "p_retailprice", "p_type"])
    numbers = {c: F.round(F.col(c).cast("double"), 4) for c in ("p_size", "p_retailprice")}
    return out.withColumns(numbers)


@query("""
with t as (select event_type as top, count(*) as freq from events group by 1 order by freq desc, top limit 1),
d as (select ts::date as day, count(*) as freq from events group by 1 order by freq desc, day limit 1)
select 'count' as statistic, count(event_type)::varchar as event_type, count(ts)::varchar as day from events
union all select 'unique', count(distinct event_type)::varchar, count(distinct ts::date)::varchar from events
union all select 'top', top, (select day::varchar from d) from t
union all select 'freq', freq::varchar, (select freq::varchar from d) from t
union all select 'min', null, min(ts::date)::varchar from events
union all select 'max', null, max(ts::date)::varchar from events
""")
def describe_temporal(t):
    events = t.events.select("event_type", F.to_date("ts").alias("day"))
    return op.describe(events, ["event_type", "day"])
