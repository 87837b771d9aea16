"""Failing cells, unlike keys, files read with the defaults, and statistics far from zero."""

from pyspark.sql import functions as F

from tablewright import functions as fn
from tablewright import operators as op
from tablewright import sources
from tablewright.plans import jobs

from .files import _folder
from .registry import query, rounded


@query("""
select o_orderkey, case when o_custkey % 7 <> 0 then round(o_totalprice / (o_custkey % 7), 6) end as ratio, try_cast(o_orderstatus as integer) as status
from orders
""")
def derive_failing(t):
    made = op.derive(t.orders, {"ratio": "o_totalprice / (o_custkey % 7)", "status": "cast(o_orderstatus as int)"})
    return rounded(op.select(made, ["o_orderkey", "ratio", "status"]), 6, "ratio")


@query("select o_orderkey from orders where o_custkey % 7 <> 0 and o_totalprice / (o_custkey % 7) > 50000")
def filter_failing(t):
    return op.select(op.filter_rows(t.orders, "o_totalprice / (o_custkey % 7) > 50000"), ["o_orderkey"])


@query("""
select o_orderkey, case when o_custkey % 7 <> 0 and o_totalprice / (o_custkey % 7) > 50000 then 'high' else 'low' end as class from orders
""")
def conditional_failing(t):
    made = op.conditional(t.orders, "class", [("o_totalprice / (o_custkey % 7) > 50000", "high")], "low")
    return op.select(made, ["o_orderkey", "class"])


@query("select o_orderkey, o_orderkey % 3 = 0 as failed from orders")
def is_error(t):
    text = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("12").alias("v"))
    made = op.types(text, {"v": "integer"}, errors=True)
    return made.select("o_orderkey", fn.is_error("v").alias("failed"))


@query("select o_orderkey, c_mktsegment from orders join customer on o_custkey::varchar = case when c_custkey % 5 = 0 then 'x' else c_custkey::varchar end")
def join_unlike_keys(t):
    """A number against text, some of which isn't a number."""
    key = F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("c_custkey").cast("string"))
    right = t.customer.select(key.alias("key"), "c_mktsegment")
    return op.select(op.join(t.orders, right, [("o_custkey", "key")]), ["o_orderkey", "c_mktsegment"])


@query("select o_orderkey, o_custkey from orders")
def join_empty_right(t):
    """A left join with a table without columns keeps the left rows as they are."""
    return op.join(op.select(t.orders, ["o_orderkey", "o_custkey"]), t.customer.select(), "o_custkey", "left")


@query("""
select event_id, round(stddev_samp(value + 1e7) over w, 3) as spread, round(var_samp(value + 1e7) over w, 3) as variance
from events window w as (partition by event_type order by event_id rows unbounded preceding)
""")
def running_spread_far_from_zero(t):
    far = t.events.select("event_id", "event_type", (F.col("value") + 1e7).alias("x"))
    made = op.window(far, {"spread": ("stdev", "x"), "variance": ("variance", "x")}, ["event_id"], ["event_type"])
    return rounded(op.select(made, ["event_id", "spread", "variance"]), 3, "spread", "variance")


@query("""
select event_id, round(stddev_samp(x) over w, 6) as spread, round(var_samp(x) over w, 6) as variance,
       round(var_samp(x) over (partition by event_type order by event_id rows between 5 preceding and 3 following), 6) as near
from (select *, (round(value, 3) + 1e9) - 1e9 as x from events) window w as (partition by event_type order by event_id rows unbounded preceding)
""")
def running_spread_at_a_billion(t):
    """Spreads don't change with the distance from zero; SQL gets the values moved back there."""
    far = t.events.select("event_id", "event_type", (F.round("value", 3) + 1e9).alias("x"))
    made = op.window(
        far, {"spread": ("stdev", "x"), "variance": ("variance", "x"), "near": ("variance", "x")}, ["event_id"], ["event_type"], frames={"near": (-5, 3)},
    )
    return rounded(op.select(made, ["event_id", "spread", "variance", "near"]), 6, "spread", "variance", "near")


@query("select o_orderkey::varchar as column_1, o_orderstatus as column_2 from orders")
def csv_generated_header(t):
    path = _folder(t)
    t.orders.select("o_orderkey", "o_orderstatus").write.csv(path)
    return sources.read_csv(t.spark, path, header="auto-generate", infer=False)


@query("select doc_id, text, lang from documents")
def csv_line_breaks(t):
    """Texts with line breaks and quotes, read with the defaults."""
    path = _folder(t)
    sources.write_csv(t.documents.select("doc_id", "text", "lang"), path)
    return sources.read_csv(t.spark, path)


@query("""
select o_orderkey, try_cast(o_orderstatus as integer) as n, try_cast(o_clerk as integer) is null and o_clerk is not null as failed,
       case when o_custkey % 5 <> 0 then 100 // (o_custkey % 5) end as share, o_custkey % 5 = 0 as share_failed
from (select *, case when o_orderkey % 2 = 0 then o_orderstatus else '17' end as o_clerk from orders)
""")
def derive_errors(t):
    """A failure and a value of one expression; a null input isn't a failure."""
    mixed = t.orders.withColumn("clerk", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("17"))
    made = op.derive(mixed, {"n": "cast(o_orderstatus as int)", "c": "cast(clerk as int)", "share": "100 div (o_custkey % 5)"}, errors=True)
    return made.select("o_orderkey", "n", F.col("c__error").isNotNull().alias("failed"), "share", F.col("share__error").isNotNull().alias("share_failed"))


@query("""
select o_orderkey, try_cast(s as integer) + 1 as n, try_cast(s as integer) + 2 as m, try_cast(s as integer) + 3 as k,
       case when o_custkey % 7 <> 0 then round(o_totalprice / (o_custkey % 7) + 1, 6) end as x,
       case when o_custkey % 7 <> 0 then round(o_totalprice / (o_custkey % 7) + 2, 6) end as y
from (select *, case when o_orderkey % 3 = 0 then o_orderstatus else o_custkey::varchar end as s from orders)
""")
def derive_shared(t):
    """Failing parts that several expressions share, also through an earlier column."""
    mixed = t.orders.withColumn("s", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string")))
    ratio = "o_totalprice / (o_custkey % 7)"
    made = op.derive(mixed, {"n": "cast(s as int) + 1", "m": "cast(s as int) + 2", "k": "n + 2", "x": f"{ratio} + 1", "y": f"{ratio} + 2"})
    return rounded(op.select(made, ["o_orderkey", "n", "m", "k", "x", "y"]), 6, "x", "y")


@query("""
select o_orderkey, case when try_cast(s as integer) > 900 then 'high' when try_cast(s as integer) > 500 then 'middle' else 'low' end as class
from (select *, case when o_orderkey % 3 = 0 then o_orderstatus else o_custkey::varchar end as s from orders)
""")
def conditional_shared(t):
    mixed = t.orders.withColumn("s", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string")))
    made = op.conditional(mixed, "class", [("cast(s as int) > 900", "high"), ("cast(s as int) > 500", "middle")], "low")
    return op.select(made, ["o_orderkey", "class"])


@query("""
select o_orderkey, case when o_custkey % 7 = 0 then -1 else round(o_totalprice / (o_custkey % 7), 6) end as ratio
from orders where o_custkey % 7 = 0 or o_totalprice / nullif(o_custkey % 7, 0) < 100000
""")
def job_derive_errors(t):
    """Failed cells of a derive that a later step of the job replaces."""
    steps = [
        {"derive": {"ratio": "o_totalprice / (o_custkey % 7)"}},
        {"replace": {"column": "ratio", "matchMode": "errors", "replace": -1.0}},
        {"filter": "ratio < 100000"},
        {"select": ["o_orderkey", "ratio"]},
    ]
    return rounded(jobs.run_steps(t.orders, steps), 6, "ratio")


@query("""
select o_orderkey from orders
where o_orderkey > 100 and o_orderstatus <> 'P' and o_custkey % 7 <> 0 and o_totalprice / nullif(o_custkey % 7, 0) between 20000 and 60000
""")
def filter_mixed(t):
    """Parts that can't fail go to the scan, the others are tried."""
    condition = "o_orderkey > 100 and o_totalprice / (o_custkey % 7) between 20000 and 60000 and o_orderstatus <> 'P'"
    return op.select(op.filter_rows(t.orders, condition), ["o_orderkey"])


@query("""
select o_orderkey::bigint as n, (o_custkey + 9007199254740993)::decimal(38,2) + (o_orderkey % 4) * 0.25::decimal(38,2) as amount,
       timestamp '2024-01-02 10:00:00' - (o_orderkey % 5 - 2) * interval 1 hour as moment, o_orderkey + 9007199254740992 as wide
from orders
""")
def csv_infer_lossless(t):
    """Whole numbers beyond 2^53, also beside fractions, and times with UTC offsets, read with the defaults."""
    path = _folder(t)
    k = F.col("o_orderkey")
    whole = (F.col("o_custkey") + F.lit(9007199254740993)).cast("string")
    amount = F.concat(whole, F.element_at(F.array(F.lit(""), F.lit(".25"), F.lit(".5"), F.lit(".75")), (k % 4 + 1).cast("int")))
    offset = F.element_at(F.array(*[F.lit(z) for z in ("-02:00", "-01:00", "Z", "+0100", "+02:00")]), (k % 5 + 1).cast("int"))
    cells = t.orders.select(k.alias("n"), amount.alias("amount"), F.concat(F.lit("2024-01-02T10:00:00"), offset).alias("moment"), (k + F.lit(9007199254740992)).alias("wide"))
    cells.write.csv(path, header=True)
    return sources.read_csv(t.spark, path)


@query("select o_orderkey::varchar as id, o_custkey::varchar as id_2, o_orderstatus as id_3, o_orderpriority as name from orders")
def csv_repeated_header(t):
    """A header that names three columns alike."""
    path = _folder(t)
    line = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    t.orders.select(line.alias("id,id,id,name")).write.csv(path, header=True, sep="|")
    return sources.read_csv(t.spark, path, delimiter=",", infer=False)


@query("""
select o_orderkey::varchar as a, case when o_orderkey % 3 > 0 then o_custkey::varchar end as b, case when o_orderkey % 3 > 1 then o_orderstatus end as c from orders
""")
def csv_ragged_rows(t):
    """Rows of one, two, three and four fields read into three columns."""
    path = _folder(t)
    k, cells = F.col("o_orderkey"), [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    width = (k % 3 + 1 + (k % 6 == 5).cast("int")).cast("int")
    t.orders.select(F.concat_ws(",", F.slice(F.array(*cells), F.lit(1), width)).alias("line")).write.text(path)
    return sources.read_csv(t.spark, path, delimiter=",", header="manual", names=["a", "b", "c"], skip_first=False, infer=False, strict=False)
