"""Wide to long, long to wide, cells to columns and rows."""

from pyspark.sql import functions as F

from tablewright import operators as op
from tablewright.sources import flatten, serialize_nested

from .registry import query, rounded


@query("""
select l_orderkey, l_linenumber, 'l_quantity' as measure, l_quantity as amount from lineitem
union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem
union all select l_orderkey, l_linenumber, 'l_tax', nullif(l_tax, 0) from lineitem
""")
def fold(t):
    l = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))
    return op.fold(l, ["l_quantity", "l_discount", "l_tax"], ("measure", "amount"))


@query("""
select l_returnflag, round(sum(l_extendedprice) filter (l_linestatus = 'F'), 2) as "F", round(sum(l_extendedprice) filter (l_linestatus = 'O'), 2) as "O"
from lineitem group by 1
""")
def pivot_sum(t):
    return rounded(op.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", "l_extendedprice"), 2, "F", "O")


@query("""
with o as (select c_nationkey, nullif(c_mktsegment, 'MACHINERY') as seg from customer)
select c_nationkey, nullif(count(*) filter (seg = 'AUTOMOBILE'), 0) as "AUTOMOBILE", nullif(count(*) filter (seg = 'BUILDING'), 0) as "BUILDING"
from o group by 1
""")
def pivot_count_limit(t):
    c = op.replace_value(t.customer, "c_mktsegment", "MACHINERY", None)
    return op.pivot(c, ["c_nationkey"], "c_mktsegment", "c_custkey", "count", limit=2)


@query("""
select round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as "F", round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as "O",
  round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as "P" from orders
""")
def pivot_no_rows(t):
    return rounded(op.pivot(t.orders, [], "o_orderstatus", "o_totalprice", "mean"), 4, "F", "O", "P")


@query("""
select p_partkey, string_split(p_name, ' ')[1] as p_name_1, string_split(p_name, ' ')[2] as p_name_2 from part
""")
def split_all(t):
    return op.split(t.part.select("p_partkey", "p_name"), "p_name", " ")


@query("select page_id, url, string_split(url, '/')[1] as url_1, string_split(url, '/')[2] as url_2, string_split(url, '/')[3] as url_3 from pages")
def split_first_n(t):
    return op.split(t.pages.select("page_id", "url"), "url", "/", "firstN", 3, keep_original=True)


@query("""
with p as (select page_id, string_split_regex(url, '[/.]+') as s from pages)
select page_id, s[len(s) - 1] as url_1, s[len(s)] as url_2 from p
""")
def split_last_n(t):
    return op.split(t.pages.select("page_id", "url"), "url", "[/.]+", "lastN", 2, regex=True)


@query("select page_id, string_split(url, '://')[1] as url_1 from pages")
def split_left(t):
    return op.split(t.pages.select("page_id", "url"), "url", "://", "left")


@query("select vec_id, embedding[1] as embedding_1, embedding[2] as embedding_2, embedding[3] as embedding_3, embedding[4] as embedding_4 from embeddings")
def spread(t):
    return op.spread(t.embeddings.select("vec_id", "embedding"), "embedding", limit=4)


@query(f"select vec_id, {', '.join(f'embedding[{i}] as embedding_{i}' for i in range(1, 65))} from embeddings")
def spread_full_width(t):
    return op.spread(t.embeddings.select("vec_id", "embedding"), "embedding")


@query("select page_id, list_last(string_split(url, '/')) as url_1 from pages")
def split_right(t):
    return op.split(t.pages.select("page_id", "url"), "url", "/", "right")


@query("""
select user_id, case when n >= 1 then l[1] end as kinds_1, case when n >= 2 then l[2] end as kinds_2, case when n >= 3 then l[3] end as kinds_3
from (select user_id, list_sort(list_distinct(list(event_type))) as l, len(l) as n from events group by 1)
""")
def spread_json_text(t):
    e = op.aggregate(t.events, {"kinds": ("array_agg_distinct", "event_type")}, ["user_id"])
    return op.spread(serialize_nested(e), "kinds", limit=3)


@query("select doc_id, unnest(string_split(text, ' ')) as word from documents")
def unroll(t):
    return op.unroll(t.documents.select("doc_id", F.split("text", " ").alias("word")), "word")


@query("""
select vec_id, label, unnest(embedding) as embedding, (generate_subscripts(embedding, 1) - 1)::int as embedding__unroll_index from embeddings
""")
def unroll_index(t):
    return op.unroll(t.embeddings.select("vec_id", "label", "embedding"), "embedding", indices=True)


@query("""
select event_id, user_id as who_id, event_type as who_kind, value as what_value, json_extract_string(props, '$.k')::bigint as what_more_k from events
""")
def flatten_nested(t):
    more = F.from_json("props", "k bigint")
    nested = t.events.select(
        "event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("who"),
        F.struct("value", more.alias("more")).alias("what"),
    )
    return flatten(nested)


@query("""
select event_id, '{"id":' || user_id || ',"kind":"' || event_type || '"}' as who from events
""")
def serialize_nested_values(t):
    nested = t.events.select("event_id", F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("who"))
    return serialize_nested(nested)
