"""Type conversion, inference and imputation."""

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright import UniqueOrder
from tablewright import operators as op

from .registry import query, rounded

BY_TIME = UniqueOrder(["ts", "event_id"])


@query("""
select event_id, trunc(value)::bigint as whole, value as number, value > 0 as flag, ts::date as day, ts as moment,
  props as doc
from events
""")
def types_from_text(t):
    text = t.events.select(
        "event_id", F.concat(F.lit(" "), F.col("value").cast("string")).alias("whole"),
        F.col("value").cast("string").alias("number"), F.col("value").cast("string").alias("flag"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").cast("string").alias("moment"),
        F.col("props").alias("doc"),
    )
    return op.types(
        text, {"whole": "integer", "number": "float", "flag": "boolean", "day": "date", "moment": "datetime", "doc": "json"}
    )


@query("""
select p_partkey, regexp_extract(p_brand, '[0-9]+')::bigint as n, null::bigint as p_brand,
  'cannot convert "' || p_brand || '" to integer' as p_brand__error, null::varchar as n__error
from part
""")
def types_errors(t):
    p = t.part.select("p_partkey", fn.regexp_extract("p_brand", "[0-9]+").alias("n"), "p_brand")
    return op.types(p, {"n": "integer", "p_brand": "integer"}, errors=True)


@query("""
select o_orderkey, case when o_orderstatus = 'F' then true when o_orderstatus = 'O' then false end as flag,
  case when o_orderstatus = 'P' then 'cannot convert "P" to boolean' end as flag__error
from orders
""")
def types_boolean_words(t):
    words = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "off").otherwise("P")
    return op.types(t.orders.select("o_orderkey", words.alias("flag")), {"flag": "boolean"}, errors=True)


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, epoch_ms(o_orderdate)::bigint as millis,
  o_totalprice::bigint as cents
from (select * exclude (o_totalprice), trunc(o_totalprice) as o_totalprice from orders)
""")
def types_from_values(t):
    o = t.orders.select("o_orderkey", "o_orderdate", F.col("o_orderdate").alias("millis"), F.col("o_totalprice").alias("cents"))
    return op.types(o, {"o_orderdate": "string", "millis": "integer", "cents": "integer"})


@query("""
select unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as "column",
  unnest(['integer', 'integer', 'string', 'float', 'date', 'string']) as type,
  unnest([1, 2, 3, 4, 5, 6]) as position, count(*) as rows, 6 as columns from orders
""")
def infer_types(t):
    text = t.orders.select(
        *[F.date_format(c, "yyyy-MM-dd").alias(c) if c == "o_orderdate" else F.col(c).cast("string") for c in t.orders.columns]
    )
    return op.schema_report(text)


@query("""
select unnest(['missing', 'new', 'type_changed']) as change, unnest(['event_type', 'kind', 'value']) as "column",
  unnest(['string', null, 'float']) as old_type, unnest([null, 'string', 'string']) as new_type
""")
def schema_diff(t):
    before = t.events.select("event_id", "event_type", "value")
    after = t.events.select("event_id", F.col("event_type").alias("kind"), F.concat("value", F.lit("kg")).alias("value"))
    return op.schema_diff(before, after)


@query("""
select 'customer' as source, unnest(['missing_column', 'column_case_mismatch', 'type_mismatch']) as kind,
  unnest(['phone', 'C_NAME', 'c_acctbal']) as "column", unnest(['phone', 'C_NAME', 'integer']) as expected,
  unnest([null, 'c_name', 'float']) as actual
""")
def contract_check(t):
    expected = {"c_custkey": "integer", "phone": "string", "C_NAME": "string", "c_acctbal": "integer"}
    return op.contract_check(t.customer, expected, "customer").drop("message")


GAPS = "case when event_type not in ('view', 'click') then value end"


def _gaps(t):
    return op.derive(t.events.select("event_id", "event_type", "ts", "value"), {"v": GAPS}).drop("value")


@query(f"select event_id, coalesce({GAPS}, -1) as v from events")
def impute_constant(t):
    return op.select(op.impute(_gaps(t), "v", "constant", -1.0), ["event_id", "v"])


@query(f"select event_id, round(coalesce({GAPS}, (select avg({GAPS}) from events)), 6) as v from events")
def impute_mean(t):
    return op.select(rounded(op.impute(_gaps(t), "v", "mean"), 6, "v"), ["event_id", "v"])


@query(f"select event_id, round(coalesce({GAPS}, (select quantile_cont({GAPS}, 0.5) from events)), 6) as v from events")
def impute_median(t):
    return op.select(rounded(op.impute(_gaps(t), "v", "median"), 6, "v"), ["event_id", "v"])


@query(f"select event_id, coalesce({GAPS}, (select min({GAPS}) from events)) as v from events")
def impute_min(t):
    return op.select(op.impute(_gaps(t), "v", "min"), ["event_id", "v"])


@query(f"select event_id, coalesce({GAPS}, (select max({GAPS}) from events)) as v from events")
def impute_max(t):
    return op.select(op.impute(_gaps(t), "v", "max"), ["event_id", "v"])


@query(f"""
select event_id, last_value({GAPS} ignore nulls) over (order by ts, event_id rows between unbounded preceding and current row) as v from events
""")
def impute_forward(t):
    return op.select(op.impute(_gaps(t), "v", "forwardFill", order_by=BY_TIME), ["event_id", "v"])


@query(f"""
select event_id, first_value({GAPS} ignore nulls) over (order by ts, event_id rows between current row and unbounded following) as v from events
""")
def impute_backward(t):
    return op.select(op.impute(_gaps(t), "v", "backwardFill", order_by=BY_TIME), ["event_id", "v"])


@query(f"""
with e as (select event_id, {GAPS} as v, row_number() over (order by ts, event_id) as i from events),
n as (select event_id, v, i,
  last_value(v ignore nulls) over b as v0, last_value(case when v is not null then i end ignore nulls) over b as i0,
  first_value(v ignore nulls) over a as v1, first_value(case when v is not null then i end ignore nulls) over a as i1
  from e window b as (order by i rows between unbounded preceding and current row), a as (order by i rows between current row and unbounded following))
select event_id, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / (i1 - i0)), 6) as v from n
""")
def impute_linear(t):
    out = op.impute(_gaps(t), "v", "linearInterpolation", order_by=BY_TIME)
    return op.select(rounded(out, 6, "v"), ["event_id", "v"])
