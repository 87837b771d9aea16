"""Tables written to files and read back."""

import uuid

from pyspark.sql import functions as F

from tablewright import operators as op
from tablewright import sources
from tablewright.plans.layout import staging_dir

from .registry import query


def _folder(t) -> str:
    return f"{staging_dir(t.spark)}/tablewright-files-{uuid.uuid4().hex}"


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def csv_round_trip(t):
    """Types come back by inference over all rows."""
    path = _folder(t)
    sources.write_csv(t.orders, path)
    return sources.read_csv(t.spark, path)


@query("select doc_id::varchar as column_1, text as column_2, lang as column_3 from documents")
def csv_quoted_text(t):
    """Line breaks, quotes and delimiters inside cells, no header names."""
    path = _folder(t)
    sources.write_csv(t.documents.select("doc_id", "text", "lang"), path, delimiter="|")
    df = sources.read_csv(t.spark, path, delimiter="|", header="manual", names=["column_1", "column_2", "column_3"], infer=False, multiline=True)
    return df


@query("select conv_id, turn, role, text from conversations")
def json_round_trip(t):
    path = _folder(t)
    sources.write_json(t.conversations, path)
    return op.select(sources.read_json(t.spark, path, lines=True), ["conv_id", "turn", "role", "text"])


@query("""
select l_orderkey as order_key, l_linenumber as line_no, l_quantity as line_amount_quantity, '["' || l_returnflag || '","' || l_linestatus || '"]' as line_flags
from lineitem
""")
def json_records(t):
    """Nested documents with a record array, flattened and serialized."""
    path = _folder(t)
    line = F.struct(
        F.col("l_linenumber").alias("no"), F.array("l_returnflag", "l_linestatus").alias("flags"),
        F.struct(F.col("l_quantity").alias("quantity")).alias("amount"),
    )
    record = F.struct(F.struct(F.col("l_orderkey").alias("key")).alias("order"), line.alias("line"))
    t.lineitem.select(F.array(record).alias("records")).write.json(path)
    df = sources.read_json(t.spark, path, "records", flatten_nested=True, serialize=True, lines=True)
    return df.withColumn("line_no", F.col("line_no").cast("int"))
