"""Joins, lookups and appended tables."""

from pyspark.sql import functions as F

from tablewright import operators as op

from .registry import query, rounded


@query("select c.*, o.* exclude (o_custkey), o_custkey from customer c join orders o on c_custkey = o_custkey")
def join_inner(t):
    return op.join(t.customer, t.orders, [("c_custkey", "o_custkey")])


@query("""
select c_custkey, c_name, o_orderkey, o_totalprice
from customer left join (select * from orders where o_totalprice > 400000) on c_custkey = o_custkey
""")
def join_left(t):
    big = op.filter_value(t.orders, "o_totalprice", ">", 400000.0)
    out = op.join(t.customer, big, [("c_custkey", "o_custkey")], "left")
    return op.select(out, ["c_custkey", "c_name", "o_orderkey", "o_totalprice"])


@query("""
select o_orderkey, o_custkey, c_name
from (select * from customer where c_acctbal > 5000) right join orders on c_custkey = o_custkey
""")
def join_right(t):
    rich = op.filter_value(t.customer, "c_acctbal", ">", 5000.0)
    return op.select(op.join(rich, t.orders, [("c_custkey", "o_custkey")], "right"), ["o_orderkey", "o_custkey", "c_name"])


@query("""
select coalesce(a.key, b.key) as key, a.n as n_x, b.n as n_y
from (select c_custkey as key, c_nationkey as n from customer where c_acctbal > 2000) a
full join (select o_custkey as key, count(*) as n from orders where o_totalprice > 200000 group by 1) b on a.key = b.key
""")
def join_full(t):
    a = op.filter_value(t.customer, "c_acctbal", ">", 2000.0).select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("n"))
    b = op.filter_value(t.orders, "o_totalprice", ">", 200000.0).withColumnRenamed("o_custkey", "key")
    b = op.aggregate(b, {"n": "count"}, ["key"])
    return op.join(a, b, "key", "full")


@query("select r_name, n_name from region cross join nation")
def join_cross(t):
    return op.join(t.region.select("r_name"), t.nation.select("n_name"), how="cross")


@query("""
select l_orderkey, l_linenumber, l_quantity, q from lineitem
join (select l_orderkey as k, l_linenumber as n, max(l_quantity) as q from lineitem group by all)
  on l_orderkey = k and l_linenumber = n
""")
def join_two_keys(t):
    best = op.aggregate(t.lineitem, {"q": ("max", "l_quantity")}, ["l_orderkey", "l_linenumber"])
    out = op.join(t.lineitem, best, ["l_orderkey", "l_linenumber"])
    return op.select(out, ["l_orderkey", "l_linenumber", "l_quantity", "q"])


@query("""
select a.id, a.v as v_l, b.v as v_r from (select c_nationkey as id, round(sum(c_acctbal), 2) as v from customer group by 1) a
join (select s_nationkey as id, round(sum(s_acctbal), 2) as v from supplier group by 1) b on a.id = b.id
""")
def join_suffixes(t):
    a = op.aggregate(t.customer.withColumnRenamed("c_nationkey", "id"), {"v": ("sum", "c_acctbal")}, ["id"])
    b = op.aggregate(t.supplier.withColumnRenamed("s_nationkey", "id"), {"v": ("sum", "s_acctbal")}, ["id"])
    return op.join(rounded(a, 2, "v"), rounded(b, 2, "v"), "id", suffixes=("_l", "_r"))


@query("""
with l as (select c_custkey, nullif(c_nationkey, 7) as k from customer),
r as (select k, count(*) as m from (select nullif(s_nationkey, 3) as k from supplier) group by k)
select c_custkey, l.k as k, m from l left join r on l.k = r.k
""")
def join_null_keys(t):
    left = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(7)).alias("k"))
    right = t.supplier.select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("k"))
    return op.join(left, op.aggregate(right, {"m": "count"}, ["k"]), "k", "left")


@query("select * from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def semi(t):
    return op.semijoin(t.customer, op.filter_value(t.orders, "o_totalprice", ">", 450000.0), [("c_custkey", "o_custkey")])


@query("select * from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def anti(t):
    return op.antijoin(t.customer, op.filter_value(t.orders, "o_totalprice", ">", 450000.0), [("c_custkey", "o_custkey")])


@query("""
with l as (select c_custkey, nullif(c_nationkey, 5) as k from customer)
select l.* from l where k is null or not exists (select 1 from supplier where s_nationkey = k and s_acctbal > 5000)
""")
def anti_null_keys(t):
    left = t.customer.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(5)).alias("k"))
    return op.antijoin(left, op.filter_value(t.supplier, "s_acctbal", ">", 5000.0), [("k", "s_nationkey")])


@query("""
select c.*, o_orderkey, o_totalprice from customer c left join (
  select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey,
    arg_max(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice from orders group by 1) on c_custkey = o_custkey
""")
def lookup_last(t):
    return op.lookup(
        t.customer, t.orders, [("c_custkey", "o_custkey")], ["o_orderkey", "o_totalprice"],
        order_by=["o_orderdate", "o_orderkey"],
    )


@query("""
with l as (select c_custkey as k, count(*) as n from customer group by 1),
r as (select nullif(o_custkey, 17) as k, count(*) as m from orders group by 1),
j as (select l.k as a, r.k as b, coalesce(n, 0) as n, coalesce(m, 0) as m from l full join r on l.k = r.k)
select 'c_custkey' as left_column, 'key' as right_column,
  count(a) as left_unique, count(b) as right_unique,
  sum(n) filter (a is not null) > count(a) as left_has_duplicates,
  sum(m) filter (b is not null) > count(b) as right_has_duplicates,
  count(*) filter (a is not null and b is not null) as matches,
  count(*) filter (a is not null and b is null) as left_only,
  count(*) filter (b is not null and a is null) as right_only,
  sum(n)::bigint as left_rows, sum(m)::bigint as right_rows,
  coalesce(sum(n) filter (a is null), 0)::bigint as left_nulls, coalesce(sum(m) filter (b is null), 0)::bigint as right_nulls,
  floor(100.0 * sum(n) filter (a is not null and b is not null) / sum(n) filter (a is not null) + 0.5)::int as left_match_percent,
  floor(100.0 * sum(m) filter (a is not null and b is not null) / sum(m) filter (b is not null) + 0.5)::int as right_match_percent,
  floor(100.0 * coalesce(sum(n) filter (a is not null and b is null), 0) / sum(n) filter (a is not null) + 0.5)::int as left_only_percent,
  floor(100.0 * coalesce(sum(m) filter (b is not null and a is null), 0) / sum(m) filter (b is not null) + 0.5)::int as right_only_percent
from j
""")
def join_key_report(t):
    orders = t.orders.select(F.nullif(F.col("o_custkey"), F.lit(17)).alias("key"))
    return op.join_key_report(t.customer, orders, [("c_custkey", "key")])


@query("""
select 'left' as side, c_custkey::varchar as value from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)
union all
select distinct 'right', o_custkey::varchar from orders where o_totalprice > 300000 and o_custkey not in (select c_custkey from customer)
""")
def join_unmatched_values(t):
    big = op.filter_value(t.orders, "o_totalprice", ">", 300000.0)
    return op.unmatched_values(t.customer, big, ("c_custkey", "o_custkey"))


@query("""
select s_name as name, s_acctbal as balance, s_nationkey as nation from supplier
union all select c_name, c_acctbal, null from customer
""")
def concat(t):
    a = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    b = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    return op.concat(a, b)


@query("""
select s_nationkey as nation, s_suppkey::varchar as id from supplier union all select c_nationkey, c_mktsegment from customer
""")
def concat_promoted(t):
    a = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    b = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("id"))
    return op.concat(a, b)


@query("select s_nationkey as nation from supplier union select c_nationkey from customer")
def union(t):
    a = t.supplier.select(F.col("s_nationkey").alias("nation"))
    return op.union(a, t.customer.select(F.col("c_nationkey").alias("nation")))
