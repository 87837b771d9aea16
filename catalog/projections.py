"""Projections, derived columns, filters and replacements."""

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright import operators as op
from tablewright.plans import jobs

from .registry import query, rounded


@query("select c_name, c_custkey from customer")
def select(t):
    return op.select(t.customer, ["c_name", "c_custkey"])


@query("select * exclude (p_name, p_size) from part")
def remove(t):
    return op.remove(t.part, ["p_name", "p_size"])


@query("select n_nationkey as id, n_name as name, n_regionkey from nation")
def rename(t):
    return op.rename(t.nation, {"n_nationkey": "id", "n_name": "name"})


@query("select o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, o_custkey from orders")
def select_pattern(t):
    return op.select_pattern(t.orders, "o_order", "prefix", include=["o_custkey"])


@query("select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def remove_pattern(t):
    return op.remove_pattern(t.orders, r"date$|custkey", "regex")


@query("select s_suppkey as supplier_suppkey, s_name as supplier_name, s_nationkey as supplier_nationkey, s_acctbal as supplier_acctbal from supplier")
def rename_pattern(t):
    return op.rename_pattern(t.supplier, "^s_", "supplier_", regex=True)


@query("""
select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross
from lineitem
""")
def derive(t):
    out = op.derive(t.lineitem, {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": "net * (1 + l_tax)"})
    return op.select(out, ["l_orderkey", "l_linenumber", "net", "gross"])


@query("""
select p_partkey, p_size, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as bucket from part
""")
def cond_bucket(t):
    out = op.conditional(t.part, "bucket", [("p_size < 10", "small"), ("p_size < 30", "medium")], "large")
    return op.select(out, ["p_partkey", "p_size", "bucket"])


@query("""
select c_custkey, concat(c_name, ' / ', coalesce(nullif(c_mktsegment, 'MACHINERY'), ''), ' / ', c_nationkey::varchar) as label from customer
""")
def merge_columns(t):
    c = op.replace_value(t.customer, "c_mktsegment", "MACHINERY", None)
    return op.select(op.merge(c, ["c_name", "c_mktsegment", "c_nationkey"], "label", " / "), ["c_custkey", "label"])


@query("""
select doc_id, lower(regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+', ''), '[ \\t\\n\\r\\f\\v]+$', '')) as text_text from documents
""")
def clean_text(t):
    return op.select(op.clean_text(t.documents, "text", ["trim", "lowercase"]), ["doc_id", "text_text"])


@query("""
select event_id, year(ts)::int as ts_year, month(ts)::int as ts_month, day(ts)::int as ts_day, hour(ts)::int as ts_hour,
  minute(ts)::int as ts_minute, second(ts)::int as ts_second, (isodow(ts) - 1)::int as ts_weekday, week(ts)::int as ts_week,
  quarter(ts)::int as ts_quarter, date_trunc('month', ts)::date as ts_month_trunc, date_trunc('week', ts)::date as ts_week_trunc,
  date_trunc('hour', ts) as ts_hour_trunc
from events
""")
def date_parts(t):
    out = op.date_parts(
        t.events.select("event_id", "ts"), "ts",
        ["year", "month", "day", "hour", "minute", "second", "weekday", "week", "quarter"], ["month", "week", "hour"],
    )
    return op.remove(out, ["ts"])


@query("""
select o_orderkey, case when o_orderpriority = '5-LOW' then null else o_orderdate::date end as text_parsed from orders
""")
def parse_dates(t):
    shown = fn.if_(F.col("o_orderpriority") == "5-LOW", F.lit("soon"), F.date_format("o_orderdate", "dd/MM/yyyy"))
    out = op.parse_dates(op.derive(t.orders, {"text": shown}), "text", "DD/MM/YYYY")
    return op.select(out, ["o_orderkey", "text_parsed"])


@query("select count(*) as total, count(*) filter (o_orderpriority <> '5-LOW') as parsed, count(*) filter (o_orderpriority = '5-LOW') as failed from orders")
def parse_dates_report(t):
    shown = fn.if_(F.col("o_orderpriority") == "5-LOW", F.lit("31/02/2020"), F.date_format("o_orderdate", "dd/MM/yyyy"))
    return op.parse_dates_report(op.derive(t.orders, {"text": shown}), "text", "DD/MM/YYYY")


@query("select * from orders where o_totalprice > 300000 and o_orderdate >= timestamp '1998-01-01' and o_orderstatus <> 'F'")
def filter_expression(t):
    return op.filter_rows(t.orders, "o_totalprice > 300000 and o_orderdate >= timestamp_ntz'1998-01-01' and o_orderstatus <> 'F'")


@query("select event_id, event_type from (select *, nullif(event_type, 'view') as k from events) where k is distinct from 'click'")
def filter_null_rules(t):
    e = op.derive(t.events, {"k": F.nullif(F.col("event_type"), F.lit("view"))})
    return op.select(op.filter_rows(e, fn.ne("k", "click")), ["event_id", "event_type"])


@query("""
select event_id, value from events where value >= 50 and event_type <> 'click'
""")
def value_filter(t):
    e = op.filter_value(op.filter_value(t.events, "value", ">=", 50.0), "event_type", "!=", "click")
    return op.select(e, ["event_id", "value"])


@query("""
select o_orderkey from orders where o_orderstatus = 'P' or o_orderpriority not like '1%'
""")
def value_filter_nulls(t):
    o = op.derive(t.orders, {"p": F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1))})
    return op.select(op.filter_value(o, "p", "!=", "1"), ["o_orderkey"])


@query("""
select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k')::bigint >= 50
""")
def value_filter_errors(t):
    text = F.when(fn.json_extract("props", "k").cast("int") >= 50, fn.json_extract("props", "k")).otherwise("n/a")
    e = op.types(t.events.select("event_id", text.alias("k")), {"k": "integer"}, errors=True)
    return op.select(op.filter_value(e, "k", "not_error"), ["event_id", "k"])


@query("select p_partkey, p_size from part where p_size between 10 and 20")
def range_filter(t):
    return op.select(op.filter_range(t.part, "p_size", 10, 20), ["p_partkey", "p_size"])


@query("select o_orderkey, case when o_orderstatus = 'P' then 'PENDING' else o_orderstatus end as o_orderstatus from orders")
def replace_exact(t):
    return op.select(op.replace_value(t.orders, "o_orderstatus", "P", "PENDING"), ["o_orderkey", "o_orderstatus"])


@query("select doc_id, regexp_replace(text, '[0-9]+', '#', 'g') as text from documents")
def replace_regex(t):
    return op.select(op.replace_regex(t.documents, "text", "[0-9]+", "#"), ["doc_id", "text"])


@query("select part.p_partkey, regexp_replace(p_brand, 'brand#([0-9]+)', 'B\\1', 'gi') as p_brand from part")
def replace_regex_flags(t):
    return op.select(op.replace_regex(t.part, "p_brand", "(?i)brand#([0-9]+)", "B$1"), ["p_partkey", "p_brand"])


@query("select event_id, coalesce(case when event_type <> 'view' then value end, 0) as value from events")
def replace_null(t):
    e = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return op.replace_nulls(e, "value", 0.0)


@query("""
select p_partkey, case when p_type = 'PROMO' then regexp_extract(p_brand, '[0-9]+')::bigint else -1 end as code, null::varchar as code__error from part
""")
def replace_errors(t):
    text = F.when(F.col("p_type") == "PROMO", fn.regexp_extract("p_brand", "[0-9]+")).otherwise(F.col("p_brand"))
    p = op.types(t.part.select("p_partkey", text.alias("code")), {"code": "integer"}, errors=True)
    return op.replace_errors(p, "code", -1)


@query("""
select year(o_orderdate)::int as order_year, o_orderpriority, count(*) as n, round(avg(o_totalprice), 8) as mean_price
from orders where o_orderstatus <> 'P' group by all
""")
def pipeline_job(t):
    steps = [
        {"filter": "o_orderstatus <> 'P'"},
        {"derive": {"order_year": "year(o_orderdate)"}},
        {"aggregate": {"groupby": ["order_year", "o_orderpriority"], "rollup": {"n": "count", "mean_price": ["mean", "o_totalprice"]}}},
        {"sort": [{"field": "order_year", "order": "desc"}, {"field": "o_orderpriority", "order": "asc"}]},
    ]
    return rounded(jobs.run_steps(t.orders, steps), 8, "mean_price")


@query("""
with net as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) as net, count(*) as items from lineitem group by 1),
priced as (select o_orderkey, o_custkey, net, items from orders left join net on o_orderkey = l_orderkey)
select c_mktsegment, round(sum(net), 2) as net, sum(items)::bigint as items, count(*) as orders
from priced join customer on o_custkey = c_custkey group by 1
""")
def multi_model_job(t):
    job = {
        "sources": {"lineitem": {}, "orders": {}, "customer": {}},
        "models": {
            "net": {
                "source": "lineitem",
                "steps": [
                    {"derive": {"net": "l_extendedprice * (1 - l_discount)"}},
                    {"aggregate": {"groupby": ["l_orderkey"], "rollup": {"net": ["sum", "net"], "items": "count"}}},
                ],
            },
            "priced": {
                "source": "orders",
                "steps": [
                    {"join": {"right": "net", "on": [["o_orderkey", "l_orderkey"]], "how": "left"}},
                    {"select": ["o_orderkey", "o_custkey", "net", "items"]},
                ],
            },
            "segments": {
                "source": "priced",
                "steps": [
                    {"join": {"right": "customer", "on": [["o_custkey", "c_custkey"]], "how": "inner"}},
                    {"aggregate": {"groupby": ["c_mktsegment"], "rollup": {"net": ["sum", "net"], "items": ["sum", "items"], "orders": "count"}}},
                ],
            },
        },
        "outputs": ["segments"],
    }
    built = jobs.build_models(job, {"lineitem": t.lineitem, "orders": t.orders, "customer": t.customer})
    return rounded(built["segments"], 2, "net").withColumn("items", F.col("items").cast("long"))
