"""Order, positions, duplicates and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright import UniqueOrder
from tablewright import operators as op
from tablewright import sources

from .registry import query

BY_TIME = UniqueOrder(["ts", "event_id"])


@query("select * from customer order by c_acctbal desc, c_custkey")
def sort_table(t):
    return op.sort(t.customer, [("c_acctbal", "desc"), "c_custkey"])


@query("select * from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(t):
    return op.top_k(t.orders, [("o_totalprice", "desc"), "o_orderkey"], 25)


@query("""
select * exclude (k) from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3
""")
def top_k_per_group(t):
    return op.top_k(t.orders, [("o_totalprice", "desc"), "o_orderkey"], 3, ["o_custkey"])


@query("""
select * exclude (k) from (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as k from lineitem) where k <= 1500
""")
def top_k_per_group_deep(t):
    return op.top_k(t.lineitem, [("l_extendedprice", "desc"), "l_orderkey", "l_linenumber"], 1500, ["l_returnflag"])


@query("select * from events order by ts, event_id limit 100")
def slice_first(t):
    return op.slice_rows(t.events, 100, "first", BY_TIME)


@query("select * from orders order by o_orderdate desc, o_orderkey desc limit 40")
def slice_last(t):
    return op.slice_rows(t.orders, 40, "last", ["o_orderdate", "o_orderkey"])


@query("select * exclude (k) from (select *, row_number() over (order by o_orderdate, o_orderkey) as k from orders) where k > 50")
def slice_remove_first(t):
    return op.slice_rows(t.orders, 50, "removeFirst", ["o_orderdate", "o_orderkey"])


@query("select * exclude (k) from (select *, row_number() over (order by ts desc, event_id desc) as k from events) where k > 30")
def slice_remove_last(t):
    return op.slice_rows(t.events, 30, "removeLast", BY_TIME)


@query("select *, row_number() over (order by ts, event_id) + 99 as idx from events")
def add_index(t):
    return op.add_index(t.events, "idx", BY_TIME, start=100)


@query("select * exclude (k) from (select *, row_number() over (order by event_id) - 1 as k from events) where k in (0, 5, 17, 999)")
def keep_rows(t):
    return op.keep_rows(t.events, [0, 5, 17, 999], "event_id")


@query("select * exclude (k) from (select *, row_number() over (order by event_id) - 1 as k from events) where k not in (0, 5, 17, 999)")
def remove_rows(t):
    return op.remove_rows(t.events, [0, 5, 17, 999], "event_id")


@query("""
with h as (select 'id' as a, 'name' as b, -1 as k union all select n_nationkey::varchar, n_name, n_nationkey from nation)
select a as id, b as name, k as "-1" from h where k >= 0
""")
def promote_header(t):
    head = t.nation.filter("n_nationkey = 0").select(F.lit("id").alias("a"), F.lit("name").alias("b"), F.lit(-1).alias("k"))
    body = t.nation.select(F.col("n_nationkey").cast("string").alias("a"), F.col("n_name").alias("b"), F.col("n_nationkey").alias("k"))
    return op.promote_header(op.concat(head, body), "k")


@query("""
select * exclude (k) from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1
""")
def dedupe_first(t):
    return op.dedupe(t.events, ["user_id", "event_type"], order_by=BY_TIME)


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def dedupe_rows(t):
    return op.dedupe(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("""
with k as (select doc_id, case when lang <> 'fr' then source end as source, lang, n_chars from documents)
select * exclude (c) from (select *, count(*) over (partition by source, lang, n_chars) as c from k) where c > 1
""")
def dedupe_keep(t):
    d = t.documents.select("doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("source"), "lang", "n_chars")
    return op.dedupe(d, ["source", "lang", "n_chars"], mode="keep")


@query()
def sample_seeded(t):
    return op.sample(t.orders, 500, seed=7, keys=["o_orderkey"])


@query("select 500 as n, 500 as distinct_keys, true as all_known")
def sample_properties(t):
    drawn = op.sample(t.orders, 500, seed=11, keys=["o_orderkey"])
    known = op.semijoin(drawn, t.orders, "o_orderkey")
    return known.agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("distinct_keys"),
        F.bool_and(F.col("o_orderkey") >= 0).alias("all_known"),
    )


@query("""
with p as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all), s as (select sum(n) as total from p)
select o_orderpriority, o_orderstatus, n, least(400, total)::bigint as drawn, true as within_six_deviations from p, s
""")
def sample_of_copies(t):
    """A table of few distinct rows: every value is drawn about as often as it is there."""
    cells = t.orders.select("o_orderpriority", "o_orderstatus")
    drawn = op.aggregate(op.sample(cells, 400, seed=3), {"__taken": "count"}, ["o_orderpriority", "o_orderstatus"])
    both = op.lookup(op.aggregate(cells, {"n": "count"}, ["o_orderpriority", "o_orderstatus"]), drawn, ["o_orderpriority", "o_orderstatus"], ["__taken"], ["__taken"])
    everything = Window.partitionBy()
    taken, total = F.coalesce("__taken", F.lit(0)), F.sum("n").over(everything)
    both = both.select("o_orderpriority", "o_orderstatus", "n", F.sum(taken).over(everything).alias("drawn"), taken.alias("taken"), (F.col("n") / total).alias("share"))
    mean = F.col("drawn") * F.col("share")
    near = F.abs(F.col("taken") - mean) <= 6 * F.sqrt(mean * (1 - F.col("share"))) + 1
    return both.select("o_orderpriority", "o_orderstatus", "n", "drawn", near.alias("within_six_deviations"))


@query("""
with n as (select range as i from range((select count(*) from customer)))
select c.*, (10 + 5 * i)::bigint as step, (date '2024-01-01' + i::int) as day,
  (date_trunc('month', timestamp '2024-01-31') + to_months(i::int))::date + 30 as month_end,
  timestamp '2024-01-01 00:00:00' + to_minutes(15 * i) as slot
from n join customer c on c_custkey = i
""")
def generate_sequences(t):
    made = sources.generate(
        t.spark,
        [
            sources.NumberSequence("id", 0), sources.NumberSequence("step", 10, 5),
            sources.DateSequence("day", "2024-01-01", 1, "days"), sources.DateSequence("month_end", "2024-01-31", 1, "months"),
            sources.DateSequence("slot", "2024-01-01 00:00", 15, "minutes"),
        ],
        rows=t.customer.count(),
    )
    return op.join(t.customer, made, [("c_custkey", "id")]).drop("id")


@query("select count(*) as n, true as low_ok, true as high_ok, true as share_ok, 3 as labels from orders")
def generate_random(t):
    made = sources.generate(
        t.spark,
        [
            sources.RandomNumber("x", 5, 15, 2), sources.RandomBoolean("flag", 0.25),
            sources.RandomCategory("label", ("a", "b", "c"), (1, 2, 7)),
            sources.RandomDate("day", "2024-01-01", "2024-12-31"),
        ],
        rows=t.orders.count(), seed=3,
    )
    return made.agg(
        F.count(F.lit(1)).alias("n"), (F.min("x") >= 5).alias("low_ok"), (F.max("x") <= 15).alias("high_ok"),
        F.avg(F.col("flag").cast("int")).between(0.2, 0.3).alias("share_ok"),
        F.count_distinct("label").cast("int").alias("labels"),
    )
