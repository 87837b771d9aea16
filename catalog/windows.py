"""Window functions."""

from pyspark.sql import functions as F

from tablewright import UniqueOrder
from tablewright import operators as op

from .registry import query, rounded

BY_TIME = UniqueOrder(["ts", "event_id"])

BY_USER = "(partition by user_id order by ts, event_id {})"


@query("""
select o_orderkey,
  row_number() over (partition by o_custkey order by o_orderdate, o_orderkey, o_orderpriority) as rn,
  rank() over p as rk, dense_rank() over p as dr,
  rank() over p + (count(*) over (partition by o_custkey, o_orderpriority) - 1) / 2 as ar,
  round(percent_rank() over p, 8) as pr, round(cume_dist() over p, 8) as cd,
  ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey, o_orderpriority) as nt
from orders window p as (partition by o_custkey order by o_orderpriority)
""")
def window_rank_family(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    positions = op.window(o, {"rn": "row_number", "nt": ("ntile", 4)}, ["o_orderdate", "o_orderkey"], ["o_custkey"])
    out = op.window(
        positions,
        {"rk": "rank", "dr": "dense_rank", "ar": "avg_rank", "pr": "percent_rank", "cd": "cume_dist"},
        "o_orderpriority", ["o_custkey"],
    )
    out = rounded(out, 8, "pr", "cd")
    return op.select(out, ["o_orderkey", "rn", "rk", "dr", "ar", "pr", "cd", "nt"])


@query("""
select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as rn, rank() over (order by o_orderdate) as rk,
  dense_rank() over (order by o_orderdate) as dr, round(cume_dist() over (order by o_orderdate), 8) as cd
from orders
""")
def window_rank_whole_table(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    numbered = op.window(o, {"rn": "row_number"}, ["o_totalprice", "o_orderkey"])
    out = op.window(numbered, {"rk": "rank", "dr": "dense_rank", "cd": "cume_dist"}, "o_orderdate")
    return op.select(rounded(out, 8, "cd"), ["o_orderkey", "rn", "rk", "dr", "cd"])


@query(f"""
select event_id, lag(value, 1, -1) over w as previous, lead(event_type, 2) over w as later
from events window w as {BY_USER.format('')}
""")
def window_offsets(t):
    out = op.window(
        t.events, {"previous": ("lag", "value", 1, -1.0), "later": ("lead", "event_type", 2)}, BY_TIME, ["user_id"]
    )
    return op.select(out, ["event_id", "previous", "later"])


@query(f"""
select event_id, first_value(value) over w as first_value, last_value(value) over w as last_value, nth_value(value, 3) over w as third
from events window w as {BY_USER.format('rows between unbounded preceding and unbounded following')}
""")
def window_values(t):
    derive = {"first_value": ("first_value", "value"), "last_value": ("last_value", "value"), "third": ("nth_value", "value", 3)}
    out = op.window(t.events, derive, BY_TIME, ["user_id"])
    return op.select(out, ["event_id", "first_value", "last_value", "third"])


@query("""
with e as (select *, case when event_type not in ('view', 'click') then value end as v from events)
select event_id,
  last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as down,
  first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as up
from e
""")
def window_fill(t):
    e = op.derive(t.events, {"v": "case when event_type not in ('view', 'click') then value end"})
    out = op.window(e, {"down": ("fill_down", "v"), "up": ("fill_up", "v")}, BY_TIME, ["user_id"])
    return op.select(out, ["event_id", "down", "up"])


@query(f"""
select event_id, round(sum(value) over w, 4) as s, round(avg(value) over w, 6) as m, min(value) over w as lo, max(value) over w as hi,
  count(*) over w as n, round(stddev_samp(value) over w, 6) as sd, round(var_samp(value) over w, 6) as va,
  round(quantile_cont(value, 0.5) over w, 6) as med, round(product(1 + value / 1000) over w, 6) as pr
from events window w as {BY_USER.format('rows between 2 preceding and current row')}
""")
def window_rolling(t):
    e = op.derive(t.events, {"rate": F.lit(1) + F.col("value") / 1000})
    derive = {
        "s": ("sum", "value"), "m": ("mean", "value"), "lo": ("min", "value"), "hi": ("max", "value"),
        "n": ("count", "value"), "sd": ("stdev", "value"), "va": ("variance", "value"), "med": ("median", "value"),
        "pr": ("product", "rate"),
    }
    out = op.window(e, derive, BY_TIME, ["user_id"], {k: (-2, 0) for k in derive})
    out = rounded(rounded(out, 4, "s"), 6, "m", "sd", "va", "med", "pr")
    return op.select(out, ["event_id", *derive])


@query(f"""
select event_id, round(sum(value) over w, 4) as s, count(*) over w as n, max(value) over w as hi
from events window w as {BY_USER.format('rows between 1 preceding and 1 following')}
""")
def window_centered(t):
    derive = {"s": ("sum", "value"), "n": ("count", "value"), "hi": ("max", "value")}
    out = op.window(t.events, derive, BY_TIME, ["user_id"], {k: (-1, 1) for k in derive})
    return op.select(rounded(out, 4, "s"), ["event_id", *derive])


@query(f"""
select event_id, round(sum(value) over w, 4) as s, round(avg(value) over w, 9) as m, min(value) over w as lo,
  round(sum(value) over (partition by user_id), 4) as total,
  round(value / sum(value) over (partition by user_id), 8) as share
from events window w as {BY_USER.format('rows between unbounded preceding and current row')}
""")
def window_running(t):
    derive = {"s": ("sum", "value"), "m": ("mean", "value"), "lo": ("min", "value"), "total": ("sum", "value")}
    out = op.window(t.events, derive, BY_TIME, ["user_id"], {"total": (None, None)})
    out = op.derive(out, {"share": F.round(F.col("value") / F.col("total"), 8)})
    return op.select(rounded(rounded(out, 4, "s", "total"), 9, "m"), ["event_id", *derive, "share"])


@query("""
select event_id, round(sum(value) over (order by ts, event_id rows unbounded preceding), 2) as running,
  round(avg(value) over (order by ts, event_id rows between 3 preceding and 3 following), 6) as smooth,
  count(*) over (order by ts, event_id rows between current row and unbounded following) as still_to_come
from events
""")
def window_whole_table(t):
    derive = {"running": ("sum", "value"), "smooth": ("mean", "value"), "still_to_come": ("count", "value")}
    out = op.window(t.events, derive, BY_TIME, frames={"smooth": (-3, 3), "still_to_come": (0, None)})
    return op.select(rounded(rounded(out, 2, "running"), 6, "smooth"), ["event_id", *derive])


@query("""
with w as (select user_id, event_id, event_type,
    list(event_type) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as seen from events),
u as (select event_id, unnest(seen) as v from w),
c as (select event_id, v, count(*) as n from u group by all)
select event_id, arg_min(v, (-n, v)) as usual from c group by event_id
""")
def window_mode(t):
    out = op.window(t.events, {"usual": ("mode", "event_type")}, BY_TIME, ["user_id"], {"usual": (-4, 0)})
    return op.select(out, ["event_id", "usual"])


@query("""
select event_id,
  round(quantile_cont(value, 0.5) over (order by ts, event_id rows between unbounded preceding and current row), 6) as so_far,
  round(quantile_cont(value, 0.5) over (order by ts, event_id rows between 2 following and unbounded following), 6) as to_come,
  round(quantile_cont(value, 0.5) over (partition by event_type order by ts, event_id rows between unbounded preceding and 3 following), 6) as of_type
from events
""")
def window_running_median(t):
    out = op.window(t.events, {"so_far": ("median", "value"), "to_come": ("median", "value")}, BY_TIME, frames={"to_come": (2, None)})
    out = op.window(out, {"of_type": ("median", "value")}, BY_TIME, ["event_type"], {"of_type": (None, 3)})
    return op.select(rounded(out, 6, "so_far", "to_come", "of_type"), ["event_id", "so_far", "to_come", "of_type"])


@query("""
with e as (select *, nullif(event_type, 'view') as kind from events)
select event_id, row_number() over (partition by kind order by ts, event_id) as rn from e
""")
def window_null_partition(t):
    e = op.derive(t.events, {"kind": F.nullif(F.col("event_type"), F.lit("view"))})
    return op.select(op.window(e, {"rn": "row_number"}, BY_TIME, ["kind"]), ["event_id", "rn"])
