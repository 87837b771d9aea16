"""Profiles and chart aggregations."""

from pyspark.sql import functions as F

from tablewright import operators as op

from .registry import query, rounded


@query("""
select 'event_type' as "column", round(100.0 * count(*) filter (event_type = 'view') / count(*), 6) as null_pct, 0.0 as error_pct from events
union all
select 'value', 0.0, round(100.0 * count(*) filter (event_type = 'click') / count(*), 6) from events
""")
def profile_quality(t):
    e = t.events.select(
        "event_id", F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") == "click", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
    )
    return rounded(op.quality(op.types(e, {"value": "float"}, errors=True)), 6, "null_pct", "error_pct")


def _numeric_sql(table, columns):
    return " union all ".join(
        f"""select '{c}' as "column", count(*) as total_count, 0::bigint as null_count, 0.0::double as null_pct, 0::bigint as error_count,
  0.0::double as error_pct, count(distinct {c}) as unique_count, round(100.0 * count(distinct {c}) / count(*), 8) as unique_pct,
  min({c})::double as min, max({c})::double as max, round(avg({c}), 8) as mean, round(quantile_cont({c}, 0.25), 8) as p25,
  round(quantile_cont({c}, 0.5), 8) as median, round(quantile_cont({c}, 0.75), 8) as p75, round(stddev_pop({c}), 8) as std,
  round(avg({c}) - 3 * stddev_pop({c}), 8) as mean_minus_3_sigma, round(avg({c}) + 3 * stddev_pop({c}), 8) as mean_plus_3_sigma
from {table}"""
        for c in columns
    )


@query(_numeric_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def profile_numeric(t):
    out = op.numeric_profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out, 8, "unique_pct", "mean", "p25", "median", "p75", "std", "mean_minus_3_sigma", "mean_plus_3_sigma")


@query("""
with c as (select p_brand as value, count(*) as n from part group by 1),
r as (select *, row_number() over (order by n desc, value) as k from c)
select k::int as position, value, n as count, 'value' as kind, round(100.0 * n / (select count(*) from part), 6) as pct from r where k <= 5
union all
select 6, 'Other (' || count(*) || ')', sum(n)::bigint, 'other', round(100.0 * sum(n) / (select count(*) from part), 6) from r where k > 5
""")
def profile_categorical(t):
    return rounded(op.categorical_profile(t.part, "p_brand"), 6, "pct")


@query("""
with s as (select nullif(o_orderpriority, '1-URGENT') as v from orders),
c as (select v as value, count(*) as n from s where v is not null group by 1),
r as (select *, row_number() over (order by n desc, value) as k from c)
select k::int as position, value, n as count, 'value' as kind, round(100.0 * n / (select count(*) from s), 6) as pct from r
union all select 7, '(null)', count(*), 'null', round(100.0 * count(*) / (select count(*) from s), 6) from s where v is null
""")
def profile_categorical_nulls(t):
    o = op.replace_value(t.orders, "o_orderpriority", "1-URGENT", None)
    return rounded(op.categorical_profile(o, "o_orderpriority"), 6, "pct")


@query("""
with p as (select quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as q2, quantile_cont(o_totalprice, 0.75) as q3,
  min(o_totalprice) as lo, max(o_totalprice) as hi from orders)
select 'o_totalprice' as "column", lo as min, round(q1, 6) as p25, round(q2, 6) as median, round(q3, 6) as p75, hi as max,
  round(greatest(lo, q1 - 1.5 * (q3 - q1)), 6) as whisker_low, round(least(hi, q3 + 1.5 * (q3 - q1)), 6) as whisker_high from p
""")
def boxplot(t):
    return rounded(op.boxplot(t.orders, ["o_totalprice"]), 6, "p25", "median", "p75", "whisker_low", "whisker_high")


@query("""
with s as (select min(l_extendedprice) as lo, (max(l_extendedprice) - min(l_extendedprice)) / 40 as w from lineitem),
b as (select least(floor((l_extendedprice - lo) / w), 39)::int as bin, count(*) as count from lineitem, s group by 1)
select bin, round(lo + w * bin, 6) as low, round(lo + w * (bin + 1), 6) as high, count from b, s
""")
def histogram(t):
    return rounded(op.histogram(t.lineitem, "l_extendedprice"), 6, "low", "high")


@query("select date_trunc('month', o_orderdate)::date as period, count(*) as count from orders group by 1")
def temporal_counts(t):
    return op.temporal_counts(t.orders, "o_orderdate")


@query("select ts::date as period, count(*) as count from events group by 1")
def temporal_counts_days(t):
    return op.temporal_counts(t.events, "ts")


@query("select event_type as category, round(avg(value), 6) as mean, count(*) as count from events group by 1")
def mean_by(t):
    return rounded(op.mean_by(t.events, "event_type", "value"), 6, "mean")


@query("select date_trunc('month', l_shipdate)::date as period, round(avg(l_quantity), 6) as mean, count(*) as count from lineitem group by 1")
def mean_over_time(t):
    return rounded(op.mean_over_time(t.lineitem, "l_shipdate", "l_quantity"), 6, "mean")


@query("select o_orderstatus as a, o_orderpriority as b, count(*) as count from orders group by all")
def contingency(t):
    return op.contingency(t.orders, "o_orderstatus", "o_orderpriority")


@query()
def point_sample(t):
    return op.point_sample(t.lineitem, ["l_quantity", "l_extendedprice"], seed=5)


def _all_sql(table, numeric, texts):
    numbers = " union all ".join(f"select '{c}' as \"column\", 0 as position, round(median({c}), 6)::varchar as value, count(distinct {c}) as count, 'numeric' as kind, 0.0 as pct from {table}" for c in numeric)
    lines = " union all ".join(f"""select '{c}', k, v, n, 'value', pct from (
  select {c} as v, count(*) as n, row_number() over (order by count(*) desc, {c})::int as k, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from {table} group by 1) where k <= 5
union all select '{c}', 6, 'Other (' || count(*) || ')', sum(n)::bigint, 'other', round(100.0 * sum(n) / any_value(total), 6) from (
  select {c} as v, count(*) as n, row_number() over (order by count(*) desc, {c})::int as k, sum(count(*)) over () as total from {table} group by 1) where k > 5 having count(*) > 0""" for c in texts)
    return f"{numbers} union all {lines}"


@query(_all_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def profile_all(t):
    """Every column of a table: medians and distinct counts of numbers, frequent values of texts."""
    found = op.profile(t.part)
    median = F.round("median", 6).cast("decimal(20,6)").cast("double").cast("string")
    numbers = found["numeric"].select("column", F.lit(0).alias("position"), median.alias("value"), F.col("unique_count").alias("count"), F.lit("numeric").alias("kind"), F.lit(0.0).alias("pct"))
    lines = [d.select(F.lit(c).alias("column"), "position", "value", "count", "kind", F.round("pct", 6).alias("pct")) for c, d in found["categorical"].items()]
    for d in lines:
        numbers = numbers.unionByName(d)
    return numbers


@query("""
select 'o_orderstatus' as "column", o_orderstatus as value, count(*) as count from orders group by all
union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by all
""")
def profile_categories(t):
    return op.categorical_profiles(t.orders, ["o_orderstatus", "o_orderpriority"], top=5).select("column", "value", "count")
